"""Corpus operators against brute force on small tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kvlog.llm import bytegrams, decontaminate, exact_dedup, jaccard, licenses, line_dedup, packing, quality, sampling, sharding, toxicity, warc
from kvlog.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string"


def words(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def rows():
    base = words(1, 120)
    near = base.replace(base.split()[60], "changed")
    texts = [base, near, base.upper(), " " + base.replace(" ", "\n"), None, "", "  ", "one two", "One  two", words(2, 3000), words(3, 9), base, "İstanbul É straße " * 5, words(4, 40)]
    out = [(i, t, None if i % 3 else "en", "s", None, "x") for i, t in enumerate(texts)]
    return [*out, (None, words(5, 30), None, None, None, None), (13, texts[13], "en", "s", None, "x")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(spark, docs, none):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t, *_ in rows():
        groups.setdefault(norm(t), []).append(i)
    best = {t: min(ids, key=lambda i: (i is None, i or 0)) for t, ids in groups.items()}
    want = sorted(((i, best[norm(t)], len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t, *_ in rows()), key=str)
    found = exact_dedup.verdicts(exact_dedup.digests(docs))[0].collect()
    assert sorted(((r["id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in found), key=str) == want
    kept_by_text = {}
    for r in found:
        if r["kept"]:
            kept_by_text.setdefault(r["text_sha256"], []).append(r["id"])
    assert {h: [best[t]] for t in groups for h in [hashlib.sha256(t.encode()).hexdigest()]} == kept_by_text
    clash = docs.withColumnsRenamed({"lang": "_bucket", "source": "_sha", "n_chars": "kept", "_id": "row"}).withColumns({"sha": F.lit(1), "_w": F.lit(2), "_mask": F.lit(3), "_maybe": F.lit(4)})
    for table in (docs, clash):
        kept = exact_dedup.exact_dedup(table)
        assert kept.columns == table.columns
        assert sorted(((r["doc_id"], norm(r["text"])) for r in kept.collect()), key=str) == sorted(((i, t) for t, i in best.items()), key=str)
    assert exact_dedup.exact_dedup(none).count() == 0
    exact_dedup.MAX_LOG_BITS, most = 16, exact_dedup.MAX_LOG_BITS  # as if there were more words than bits
    try:
        many = spark.range(20000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t "), F.col("id") % 15000).alias("text"))
        assert exact_dedup.Filter(exact_dedup.digests(many)).log_words > 16 or exact_dedup.suspects(exact_dedup.digests(many), 20000)[1] == 17
        assert exact_dedup.exact_dedup(many).count() == 15000
    finally:
        exact_dedup.MAX_LOG_BITS = most
    hot = spark.createDataFrame([(i % 7 if i % 2 else None, "same  text") for i in range(600)], "doc_id long, text string").repartition(5)
    assert [tuple(r) for r in exact_dedup.exact_dedup(hot).collect()] == [(1, "same  text")] or exact_dedup.exact_dedup(hot).count() == 1


def test_decontamination(spark, docs, none):
    long = words(1, 120).split()
    items = [(1, " ".join(long[20:45])), (2, "one two"), (3, None), (4, "..."), (5, words(99, 12)), (6, " ".join(long[20:45]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    got = sorted(((r["id"], r["n_words"], r["n_hit"], ",".join(r["items"])) for r in decontaminate.decontaminate(docs, bench).collect()), key=str)
    want = []
    for i, t, *_ in rows():
        w, hit, found = split(t), set(), set()
        for k, x in items:
            x = split(x)
            n = min(10, len(x))
            for a in range(len(x) - n + 1 if n else 0):
                for b in range(len(w) - n + 1):
                    if w[b : b + n] == x[a : a + n]:
                        hit.update(range(b, b + n))
                        found.add(str(k))
        want.append((i, len(w), len(hit), ",".join(sorted(found))))
    assert got == sorted(want, key=str)
    assert decontaminate.decontaminate(none, bench).count() == 0
    clash = docs.withColumnsRenamed({"lang": "_row", "source": "found", "n_chars": "len", "_id": "items"})
    assert sorted(((r["id"], r["n_hit"]) for r in decontaminate.decontaminate(clash, bench.withColumn("fp", F.lit(1))).collect()), key=str) == sorted(((i, h) for i, _, h, _ in want), key=str)
    assert not decontaminate.decontaminate(docs, bench.limit(0)).where("contaminated").count()


def brute_hits(items, text):
    """(n_words, n_hit, item ids) by comparing every window with every place."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, found = split(text), set(), set()
    for k, x in items:
        x = split(x)
        n = min(10, len(x))
        windows = {tuple(x[a : a + n]) for a in range(len(x) - n + 1)} if n else set()
        for b in range(len(w) - n + 1):
            if tuple(w[b : b + n]) in windows:
                hit.update(range(b, b + n))
                found.add(str(k))
    return len(w), len(hit), sorted(found)


def test_decontamination_of_repetitive_texts(spark):
    r = random.Random(8)
    few = lambda n, v: " ".join(r.choice("abcdefgh"[:v]) for _ in range(n))
    items = [(i, few(r.choice([1, 3, 5, 9, 10, 11, 30, 60]), r.choice([1, 2, 3, 8]))) for i in range(40)]
    texts = [few(r.choice([2, 9, 10, 40, 300]), r.choice([1, 2, 3, 8])) for _ in range(60)] + [items[5][1] + " x " + items[7][1], "a " * 5000]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.decontaminate(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), bench).collect()
    for x in got:
        assert (x["n_words"], x["n_hit"], x["items"]) == brute_hits(items, texts[x["id"]]), texts[x["id"]]
        assert (x["n_items"], x["contaminated"]) == (len(x["items"]), x["n_hit"] > 0)


def shingle_set(t):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


@pytest.mark.parametrize("limits", [{}, {"HOT_ROWS": 4, "TILE_ROWS": 3, "STAR_ROWS": 2, "COMMON_DF": 2}, {"ROUNDS": 0, "TILE_ROWS": 2}])
def test_jaccard_against_all_pairs(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(jaccard, name, value)
    r = random.Random(3)
    texts = []
    for k in range(12):
        base = words(100 + k, r.randrange(3, 200)).split()
        for _ in range(r.randrange(1, 7)):
            copy = list(base)
            for _ in range(r.randrange(0, max(1, len(base) // 40) + 1)):
                copy[r.randrange(len(copy))] = f"e{r.randrange(1000)}"
            texts.append(" ".join(copy))
    texts += [None, "", "a b", "A  b", "a b c"]
    data = [(i, t) for i, t in enumerate(texts)]
    sets = [shingle_set(t) for t in texts]
    parent = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(parent, a), root(parent, b)))
                parent[y] = x
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.links(spark.createDataFrame(data, "doc_id long, text string").repartition(3)).collect()}
    assert got == {i: (len(sets[i]), root(parent, i)) for i in range(len(texts))}


def root(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def test_periodic_words_are_told_apart():
    """The words of the Thue-Morse sequence and its complement collide under any polynomial modulo 2**64."""
    morse = "".join("ab"[bin(i).count("1") % 2] for i in range(2048)).encode()
    other = morse.translate(bytes.maketrans(b"ab", b"ba"))
    t = bytegrams.Texts([morse, other, morse + b" " + other, b"x" * 9, b"x" * 8 + b" x", b"", b"abcdefgh", b"abcdefg"])
    t.split(bytegrams.SPACE)
    h = t.word_hashes().tolist()
    assert h[:2] == h[2:4] and len(set(h)) == len(h) - 2


def test_jaccard_edges(docs, none):
    got = [r for r in jaccard.links(docs).collect()]
    assert len(got) == len(rows())
    assert {r["component_id"] for r in got if r["id"] in (0, 1, 2, 3, 11)} == {0}
    assert jaccard.links(none).count() == 0


def test_bound_never_loses_a_link():
    r = np.random.default_rng(5)
    for n in (1, 3, 20, 90, 300, 900):
        a = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
        for share in (0.0, 0.02, 0.1, 0.2):
            b = np.unique(np.concatenate([a[int(n * share) :], r.integers(0, 1 << 63, int(n * share / 4), dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if both and 100 * both >= 80 * (len(a) + len(b) - both):
                assert jaccard.may_link(len(a), jaccard.signature(a), np.array([len(b)]), jaccard.signature(b)[None])[0]


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(150), r.randrange(150)) for _ in range(110)] + [(200 + i, 201 + i) for i in range(30)]
    parent = list(range(300))
    for a, b in edges:
        x, y = sorted((root(parent, a), root(parent, b)))
        parent[y] = x
    got = {x["id"]: x["component"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: root(parent, i) for a, b in edges if a != b for i in (a, b)}


def test_packing_round_trip(docs, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    data = [r for r in rows() if r[0] not in (None, 13)]
    want = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 2] for i, t, *_ in data}
    pieces = packing.pack(docs.where("doc_id <> 13"), length=256).collect()
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_seq.setdefault(p["sequence_id"], []).append(p)
    assert set(by_doc) == set(want)
    for i, ps in by_doc.items():
        at = 0
        for p in sorted(ps, key=lambda p: p["start"]):
            ids = want[i][p["start"] : p["start"] + p["length"]]
            assert p["start"] == at and len(ids) == p["length"] and p["doc_tokens"] == len(want[i])
            assert p["ids_crc32"] == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
            at += p["length"]
        assert at == len(want[i])
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 256
    assert packing.pack(none).count() == 0


def test_cuts_are_cheapest():
    r = random.Random(2)
    for _ in range(30):
        pos = [0]
        while len(pos) < 12:
            pos.append(pos[-1] + r.randrange(1, 9))
        pen = [0] + [r.randrange(0, 6) for _ in pos[1:]]

        def cost(ends, pos=pos, pen=pen):
            at = total = 0
            for e in ends:
                total += 10 - (e - at) + pen[pos.index(e)]
                at = e
            return total

        best = [0.0] + [1e9] * (len(pos) - 1)
        for j in range(1, len(pos)):
            best[j] = min((best[i] + 10 - (pos[j] - pos[i]) + pen[j] for i in range(j) if pos[j] - pos[i] <= 10), default=1e9)
        assert cost(packing.cuts(pos, pen, 10)) == best[-1]
        last = lambda n: n * n % 7
        ends = packing.cuts(pos, pen, 10, last)
        at = ends[-2] if len(ends) > 1 else 0
        assert cost(ends[:-1]) + last(pos[-1] - at) == min(best[i] + last(pos[-1] - pos[i]) for i in range(len(pos) - 1) if pos[-1] - pos[i] <= 10)


def test_special_texts_tokenize_alike():
    own = packing.Encoder(packing.tokenizer_path())
    for t in ["It's <|endoftext|> a\x85b\x1cc d", "ÀÉ ß µ ª İ ﬁ é Σας", "x'll don't 12ab ab12 ...!!! a<|b", "\t\n\x0b"]:
        assert own.encode(t) == np.array(own.tok.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_ends_of_streams_are_cheapest():
    r = random.Random(6)
    for tokens in [1, 2, 3, 5, 8, 13, 31, 32, 48, 63, *[r.randrange(1, 64) for _ in range(30)]]:
        cost_at = [r.randrange(0, 40) for _ in range(65)]
        got, told = packing.tail(tokens, 64, lambda n, c=cost_at: c[n])
        assert sum(got) == tokens and all(x & (x - 1) == 0 for x in got[:-1])

        def cost(parts, c=cost_at, tokens=tokens):
            at = total = 0
            for x in parts:
                at += x
                total += (c[at] if at < tokens else 0) + (64 - x if x & (x - 1) else 0)
            return total

        powers, left = [], tokens
        while left:
            powers.append(1 << left.bit_length() - 1)
            left -= powers[-1]
        options = [[*powers[:k], *([sum(powers[k:])] if k < len(powers) else [])] for k in range(len(powers) + 1)]
        assert told == cost(got) == min(map(cost, options))


def test_packing_over_many_shares_pads_little(spark):
    data = [(i, words(i, 5 + i % 40)) for i in range(300)]
    pieces = packing.pack(spark.createDataFrame(data, "doc_id long, text string").repartition(30), length=256).collect()
    filled, first = {}, {}
    for p in pieces:
        filled[p["sequence_id"]] = filled.get(p["sequence_id"], 0) + p["length"]
    padded = sum(256 - n for n in filled.values() if n & (n - 1))
    assert padded < 0.08 * sum(filled.values()) and sum(n < 64 for n in filled.values()) < 8
    for p in pieces:
        first.setdefault(p["doc_id"], []).append((p["start"], p["length"]))
    for i, parts in first.items():
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert at == next(p["doc_tokens"] for p in pieces if p["doc_id"] == i)


def test_warc(spark, tmp_path):
    big = "x" * 150
    pages = [(3, "u", big), (1, "v", big), (2, None, "short"), (4, "w", "short"), (5, "a\r\nb", None), (None, "n", big), (6, "é", "é" * 60), (7, "z", "y" * 200000), (7, "z", "y" * 200000)]
    path = f"file://{tmp_path}/a"
    schema = "page_id long, url string, html string"
    warc.write_archive(spark.createDataFrame(pages, schema).withColumns({"digest": F.lit(1), "_row": F.lit(2), "kind": F.lit(3)}).repartition(3), path)
    out = warc.read_archive(spark, path).collect()
    assert len(out) == len(pages)
    got = {r["page_id"]: r for r in out}
    assert {i: (r["record_type"], r["refers_to"]) for i, r in got.items() if i != 7} == {1: ("response", None), 3: ("revisit", 1), None: ("revisit", 1), 2: ("response", None), 4: ("response", None), 5: ("response", None), 6: ("response", None)}
    assert sorted((r["record_type"], r["refers_to"]) for r in out if r["page_id"] == 7) == [("response", None), ("revisit", 7)]
    for i, _, html in pages:
        data = (html or "").encode()
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(data), hashlib.sha256(data).hexdigest())
    ids, html_of = [], {hashlib.sha256((h or "").encode()).hexdigest(): (h or "").encode() for _, _, h in pages}
    for r in warc.records(spark, path).collect():
        head, _, body = bytes(r["record"]).partition(b"\r\n\r\n")
        assert head + b"\r\n\r\n" == r["header"].encode()
        size = int(re.search(rb"Content-Length: (\d+)", head)[1])
        ids.append(re.search(rb"WARC-Record-ID: (\S+)", head)[1])
        assert body == (html_of[r["payload_digest"]] if b"WARC-Type: response" in head else b"") + b"\r\n\r\n" and len(body) == size + 4
    assert len(set(ids)) == len(pages)
    refers = [re.search(rb"WARC-Refers-To: (\S+)", bytes(r["record"])) for r in warc.records(spark, path).collect()]
    assert {m[1] for m in refers if m} < set(ids)


def test_warc_of_other_ids_and_broken_archives(spark, tmp_path):
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import PySparkException

    named = spark.createDataFrame([("a b\r\n", "u", "h" * 120), ("", "u", "h" * 120), (None, None, None)], "page_id string, url string, html string")
    warc.write_archive(named, f"file://{tmp_path}/s")
    assert {r["page_id"]: r["refers_to"] for r in warc.read_archive(spark, f"file://{tmp_path}/s", "string").collect()} == {"": None, "a b\r\n": "", None: None}
    warc.write_archive(named.limit(0), f"file://{tmp_path}/e")
    assert warc.read_archive(spark, f"file://{tmp_path}/e").count() == 0
    kept = spark.read.parquet(f"file://{tmp_path}/s/payloads")
    kept.where("small = 'true'").write.partitionBy("small").parquet(f"file://{tmp_path}/m/payloads")
    kept.withColumn("payload", F.concat("payload", F.lit(b"!"))).write.partitionBy("small").parquet(f"file://{tmp_path}/c/payloads")
    for bad in ("m", "c"):
        spark.read.parquet(f"file://{tmp_path}/s/headers").write.parquet(f"file://{tmp_path}/{bad}/headers")
        with pytest.raises((PySparkException, Py4JJavaError)):
            warc.read_archive(spark, f"file://{tmp_path}/{bad}").collect()


def test_line_dedup(spark, none):
    def varied(i, text):
        return " ".join(x if x != "?" else "v" + chr(97 + i) for x in text.split())

    forms = [
        "one word in the ? middle of this line",
        "here early ? and again late in this same ? line of fourteen words",
        "lines of four ?",
        "and now ? but ? or ? with all of what else stands here alike",
        "user ? logged in from the main office today at noon",
        "the report was opened by reader ? early this morning again",
        "build 7? finished on host-? without any error at all",
    ]
    data = [(i, "\n".join([f"own {chr(97 + i) * 5} text {chr(110 + i) * 4}", "", *(varied(i, f).replace("7v", f"7{i}") for f in forms), "short"]), "x") for i in range(12)]
    data += [(50, None, "x"), (51, "", "x"), (52, "own aaaaa text nnnn\nlines of four", "x"), (None, "lines of four indeed\nkept", "x"), (53, "w " * 20000 + "\nlines of four long", "x")]
    # one document with many lines of a form, and one row repeated many times: no recurring templates
    data += [(60, "\n".join(f"row {chr(97 + i)} stays as it is" for i in range(15)), "x")] + [(61, "this row is repeated as a whole", "x")] * 15
    docs = spark.createDataFrame(data, "doc_id long, text string, sha string").repartition(3)
    got = line_dedup.drop_lines(docs)
    assert got.columns == ["doc_id", "text", "sha", "n_lines", "n_dropped"]
    out = {r["doc_id"]: r for r in got.collect()}
    for i in range(12):
        assert out[i]["text"] == data[i][1].split("\n")[0] + "\n\nshort" and (out[i]["n_lines"], out[i]["n_dropped"]) == (10, 7)
    assert [out[i]["text"] for i in (50, 51, 52)] == [None, "", data[14][1]]
    assert out[None]["text"] == "kept" and out[53]["text"] == "w " * 20000
    assert out[60]["n_dropped"] == out[61]["n_dropped"] == 0 and got.where("doc_id = 61").count() == 15
    assert line_dedup.drop_lines(none).count() == 0


def test_long_lines_in_few_unrelated_documents(spark):
    passage, copied = " ".join(f"p{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)), " ".join(f"c{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    own = [" ".join(f"{chr(97 + i)}{chr(97 + j)}x" for j in range(20)) for i in range(6)]
    data = [(i, f"{own[i]}\n{passage}\nshort line of few words") for i in range(4)] + [(10 + i, f"{own[4]}\nagain here {chr(97 + i)}\n{copied}") for i in range(5)]
    data = [(i, t.replace("short line of few words", f"short line {own[i % 4]}")) for i, t in data]
    out = {r["doc_id"]: r["text"] for r in line_dedup.drop_lines(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    for i, text in data:
        assert out[i] == (text if i >= 10 else f"{own[i]}\nshort line {own[i]}")


def test_sharding(spark, docs):
    slots = 211
    owner = sharding.fill(["a", "b", "c"], slots)
    # the same by hand
    want, at, free = [-1] * slots, {}, slots
    perm = {}
    for s in "abc":
        h = hashlib.sha256(s.encode()).digest()
        o, k = int.from_bytes(h[:8], "big") % slots, int.from_bytes(h[8:16], "big") % (slots - 1) + 1
        perm[s] = [(o + j * k) % slots for j in range(slots)]
        assert sorted(perm[s]) == list(range(slots))
    while free:
        for n, s in enumerate("abc"):
            slot = next((x for x in perm[s] if want[x] < 0), None)
            if slot is not None:
                want[slot], free = n, free - 1
    assert owner == want
    less = sharding.fill(["a", "c"], slots)
    moved = sum(x != 1 and "abc"[x] != "ac"[y] for x, y in zip(owner, less, strict=True))
    assert moved < slots * 0.25
    clash = docs.withColumnsRenamed({"lang": "shard", "source": "slot", "_id": "_kv_slot"})
    placed = sharding.shard(clash, "doc_id", ["a", "b", "c"], slots)
    assert placed.columns == ["doc_id", "text", "slot", "n_chars", "_kv_slot", "shard"]
    out = placed.collect()
    assert len(out) == len(rows()) and all(r["slot"] in ("s", None) and r["_kv_slot"] in ("x", None) for r in out)
    for r in out:
        key = "" if r["doc_id"] is None else str(r["doc_id"])
        assert r["shard"] == owner[int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % slots]
    assert sharding.shard(clash.limit(0), "doc_id", ["a"], slots).count() == 0
    assert set(sharding.fill(["a", "b", "c"], slots, {"b": 0})) == {0, 2}
    for weights in ({"a": 0, "b": 0, "c": 0}, {"a": -1}):
        with pytest.raises(ValueError):
            sharding.fill(["a", "b", "c"], slots, weights)


def test_license_scan(docs, none, spark):
    texts = ["x Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "The MIT License and the Apache LICENSE", "mit", None]
    got = [licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).where(F.col("doc_id") == i).first() for i in range(4)]
    assert got[0]["labels"] == "mit-grant" and got[0]["n_base"] == 0 and got[0]["score"] > 0.7
    assert (got[1]["base_labels"], got[1]["n_base"], got[1]["first_word"], got[1]["last_word"]) == ("apache,mit", 2, 1, 5)
    assert got[2]["labels"] == "" and got[3]["n_words"] == 0
    assert licenses.scan(none).count() == 0


def test_license_scan_finds_every_notice(spark):
    mit = "Released under the MIT License. All rights reserved. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    bsd = "Copyright A. All rights reserved. Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
    apache = "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. You may obtain a copy of the License at x"
    every = " / ".join(t for t, _ in licenses.TEMPLATES.values())
    texts = [mit, bsd, apache, every, "word " * 30000 + apache, *["nothing here"] * 50]
    out = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    found = [{x.split(":")[0] for x in out[i]["templates"].split(",")} for i in range(5)]
    assert found[0] == {"mit-notice", "all-rights-reserved", "mit-grant"}
    assert found[1] == {"all-rights-reserved", "bsd-terms"}
    assert found[2] == found[4] == {"apache-2.0-notice", "apache-2.0-terms"}
    assert found[3] == set(licenses.TEMPLATES)


def brute_base(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    return len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


def brute_templates(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    out = set()
    for label, (passage, phrases) in licenses.TEMPLATES.items():
        t = passage.split()
        spans = [next(i for i in range(len(t)) if t[i : i + len(p)] == p) for p in map(str.split, phrases)]
        for s in range(-len(t), len(w)):
            whole = all(s + i >= 0 and w[s + i : s + i + len(p.split())] == p.split() for i, p in zip(spans, phrases, strict=True))
            if whole and sum(0 <= s + k < len(w) and w[s + k] == x for k, x in enumerate(t)) / len(t) >= licenses.MIN_SHARE:
                out.add(label)
    return out


def test_licenses_against_brute_force(spark):
    r = random.Random(4)
    passages = [t for t, _ in licenses.TEMPLATES.values()]
    texts = [f"{a} . {b}" for a in passages for b in passages]
    pool = [*" ".join([*passages, *licenses.BASE]).split(), "mit license", "General PUBLIC license", "the mit license", "zz"]
    texts += [" ".join(r.choice(pool) for _ in range(r.randrange(0, 60))) for _ in range(150)] + [None, "", "...", "MIT License " * 4000, "é mit license ü"]
    for t in passages:  # some words changed
        w = t.split()
        texts.append(" ".join(x if r.random() > 0.2 else "changed" for x in w))
    data = [(f"d{i}" if i else None, t) for i, t in enumerate(texts)] + [("d1", texts[1])]
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.concat(F.lit("r"), "doc_id").alias("doc_id"), "text")
    docs = spark.createDataFrame(data, "doc_id string, text string").unionByName(real).withColumn("labels", F.lit("x"))
    text_of = {x["doc_id"]: x["text"] for x in docs.collect()}
    got = licenses.scan(docs).collect()
    assert len(got) == len(data) + real.count()
    for x in got:
        t = text_of[x["doc_id"]]
        assert (x["n_words"], x["n_base"], x["first_word"], x["last_word"], x["base_labels"]) == brute_base(t)
        assert {y.split(":")[0] for y in x["templates"].split(",") if y} == brute_templates(t), t
        assert x["labels"] == ",".join(sorted(brute_templates(t) | {y for y in x["base_labels"].split(",") if y})) and 0 <= x["score"] <= 1


@pytest.mark.parametrize("module,column,least", [(quality, "quality", (0.95, 0.95)), (toxicity, "toxic", (0.82, 0.9))])
def test_classifiers_on_held_out_rows(spark, module, column, least):
    """Recall and precision of both classes; see the README on toxicity."""
    d = "/root/testdata/sf0.1"
    run = quality.op3_quality if column == "quality" else toxicity.op6_toxicity
    out = run(spark, d)
    assert out.count() == spark.read.parquet(f"{d}/documents.parquet").count() and not out.where("score < 0 OR score > 1 OR score IS NULL").count()
    found = {(r["predicted"], r[column]): r["count"] for r in out.where("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").groupBy("predicted", column).count().collect()}
    n = lambda p, y: found.get((p, y), 0)
    for y in (0, 1):
        assert n(y, y) / (n(y, y) + n(1 - y, y)) >= least[0] and n(y, y) / (n(y, y) + n(y, 1 - y)) >= least[1]


def _mix(h):
    m = (1 << 64) - 1
    h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & m
    h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & m
    return h ^ (h >> 31)


def _grams(text, n):
    """n-byte grams of a text between spaces, white space as one character, none of it inside."""
    blank = b" \t\n\x0b\x0c\r"
    b = b" " + bytes(32 if x in blank else x for x in text) + b" "
    return [b[i : i + n] for i in range(len(b) - n + 1) if 32 not in b[i + 1 : i + n - 1]]


def _hash(gram):
    return _mix((int.from_bytes(gram, "big") * 0x9E3779B97F4A7C15 + len(gram)) & ((1 << 64) - 1))


SCORED = ["", "one", "a a a b", "Some text, with UPPER and lower words.", "w\x0bx\ty", "é ü straße", "x" * 3000, " lead and trail "]


def test_toxicity_scores_against_brute_force():
    texts = [f"{'bad' if i % 2 else 'good'} words {words(i, 30)}".encode() for i in range(200)]
    model = toxicity.train(texts, [i % 2 for i in range(200)], [0.5, 0.5])
    assert len(model["ids"])
    weight = dict(zip(model["ids"].tolist(), model["weights"].tolist(), strict=True))
    import pyarrow as pa

    all_texts = [*SCORED, *[t.decode() for t in texts[:5]], None]
    got = toxicity.score(pa.array(all_texts), model)
    for t, s in zip(all_texts, got, strict=True):
        low = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())
        seen = {_hash(g) >> (64 - toxicity.BUCKETS_LOG2) for n in toxicity.GRAMS for g in _grams(low, n)}
        z = model["bias"] + sum(weight.get(x, 0.0) for x in seen)
        assert abs(s - 1 / (1 + np.exp(-z))) < 1e-9, t


def test_quality_scores_against_brute_force():
    import pyarrow as pa

    model = {"table": np.random.default_rng(2).normal(size=1 << quality.BUCKETS_LOG2).astype(np.float32), "bias": 0.3}
    got = quality.score(pa.array([*SCORED, None]), model)
    for t, s in zip([*SCORED, None], got, strict=True):
        raw = (t or "").encode()
        w = [x for x in re.split(rb"[\x20\x09-\x0D]+", raw) if x]
        one = lambda x: int(_word_hash(x)) >> (64 - quality.BUCKETS_LOG2)
        values = [model["table"][one(x)] for x in w] + [model["table"][quality.REPEAT]] * sum(a == b for a, b in zip(w, w[1:], strict=False))
        values += [model["table"][_hash(g) >> (64 - quality.BUCKETS_LOG2)] for n in quality.GRAMS for g in _grams(raw, n)]
        z = (sum(map(float, values)) / len(values) if values else 0.0) + model["bias"]
        assert abs(s - 1 / (1 + np.exp(-z))) < 1e-6, t


def _word_hash(x):
    m = (1 << 64) - 1
    h = _mix((len(x) * 0x9E3779B97F4A7C15) & m)
    for i in range(0, len(x), 8):
        h = _mix(((h ^ int.from_bytes(x[i : i + 8], "little")) * 0x9E3779B97F4A7C15) & m)
    return h


def test_samples_are_bounded(spark):
    docs = spark.createDataFrame([(i % 40, f"text {i % 40} " + "x" * 100, "extra") for i in range(4000)] + [(50, None, "extra")], "doc_id long, text string, _t string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(3, 0), (None, 1)], "doc_id long, toxic int")
    texts, ys, shares = sampling.labelled_sample(docs, labels, "toxic", 10)
    assert 0 < len(texts) <= 20 and len(set(texts)) == len(texts) and set(ys) == {0, 1} and abs(sum(shares) - 1) < 1e-9
    small = sampling.labelled_sample(docs, labels, "toxic", 10, most_bytes=250)[0]
    assert 0 < len(small) <= 6 and sum(map(len, small)) <= 500
    assert sampling.labelled_sample(docs.limit(0), labels.limit(0), "toxic", 10) == ([], [], [0.5, 0.5])


def test_classifiers_without_labels_and_texts(spark, docs, none):
    import pyarrow as pa

    for module in (quality, toxicity):
        model = module.train([], [], [0.5, 0.5])
        assert abs(module.score(pa.array(["a", None, ""]), model) - 0.5).max() < 1e-6
        out = quality.with_scores(docs, lambda texts, m=module, x=model: m.score(texts, x), "lang")
        assert out.columns == ["doc_id", "text", "source", "n_chars", "_id", "lang"] and out.count() == len(rows())
        assert quality.with_scores(none, lambda texts, m=module, x=model: m.score(texts, x), "score").count() == 0


def brute_pipeline(spark, docs, d):
    """Rows (doc_id, text) that reach the last stage, by plain loops; the trained model is taken as it is."""
    import corpus_pipeline as p
    import pyarrow as pa

    known = p.quality_model(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
    kept = [x for x in docs if quality.score(pa.array([x[1]], pa.string()), known)[0] >= quality.THRESHOLD]
    least = lambda xs: min(xs, key=lambda x: (x[0] is None, x[0] or 0))
    groups = {}
    for x in kept:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", x[1] or ""), []).append(x)
    kept = [least(xs) for xs in groups.values()]
    sets, parent = [shingle_set(t) for _, t in kept], list(range(len(kept)))
    for a in range(len(kept)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(parent, a), root(parent, b)))
                parent[y] = x
    groups = {}
    for i, x in enumerate(kept):
        groups.setdefault(root(parent, i), []).append(x)
    kept = [least(xs) for xs in groups.values()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    return [x for x in kept if not brute_hits(items, x[1])[1]]


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline as p

    d = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    item = spark.read.parquet(f"{d}/benchmark.parquet").first()["text"]
    clean = next(t for i, t in docs if t and len(t) > 400)
    # null and repeated ids: a contaminated row without one, a clean and a contaminated row of one id, near copies without ids
    docs += [(None, f"{clean} {item} {clean}"), (5, f"{words(70, 90)} {item}"), (None, clean), (None, clean + " more"), (None, None), (None, "")]
    docs += [(9, words(71, 90)), (9, words(72, 90))]
    table = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{d}/{name}.parquet").write.parquet(f"file://{tmp_path}/{name}.parquet")
    table.write.parquet(f"file://{tmp_path}/documents.parquet")
    d = f"file://{tmp_path}"
    docs, was = spark.read.parquet(f"{d}/documents.parquet"), None
    # a null and an empty text without ids tie, so either stays
    want = sorted(((i, t or "") for i, t in brute_pipeline(spark, [(r["doc_id"], r["text"]) for r in docs.collect()], d)), key=str)
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), out.schema)
        assert was is None or docs.count() <= was
        was = docs.count()
    assert sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=str) == want
    packed = p.run(spark, d)
    assert sorted((r["doc_id"] for r in packed.where("start = 0").collect()), key=str) == sorted((i for i, _ in want), key=str)
