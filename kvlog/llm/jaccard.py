"""N-gram Jaccard join: every pair of documents whose sets of 5-word shingles have a Jaccard similarity of at least 0.8.

1. Texts that are equal up to case of A-Z and white space collapse to the least id (see exact_dedup).
2. Every text gives its ``n - ceil(0.8 n) + 1`` first shingles in a global order as keys: two sets that are similar
   enough share one (prefix filter, any order is exact).  The order puts shingles that many documents share last, by
   heavy-hitter counts that every task gathers over all its documents; so a common passage makes no large groups.
3. Within a key documents are ordered by set size.  Each (key, size band) links to the two documents with the most shared keys, each
   band to the one before, and in further rounds components that still share a key; these few pairs are verified.  Keys that
   the counts show to be hot are dealt out in parts first, which the rounds join again.
4. Keys whose documents lie in several components become tiles: size-ordered blocks of hashed bitmap signatures.  For sets A,
   B the bits of A's signature that B's lacks prove as many elements outside the intersection, so bit counts bound
   the overlap from above.  Pairs in different components that pass are verified by intersecting the sorted arrays.
   Pairs already connected need no test, so large groups of near copies never expand into all pairs.  A tile of many
   documents is split into chunks, and each two chunks meet in one task.

Defined cases: null, empty and blank texts have no shingles and no links; rows with equal ids are one document; null ids
get a null component; an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kvlog.llm import exact_dedup as exact
from kvlog.llm.bytegrams import SPACE, Texts, give_back, groups, lean, mix, shingle_sets, small
from kvlog.llm.common import cut, forget, ship, stored, table
from kvlog.llm.components import components

SIZE = 5
#: Shingles of at least so many documents count as common; at most MAX_COMMON are told to the tasks (4 MiB). Order only.
COMMON_DF, MAX_COMMON = 8, 1 << 18
#: Reported from a block of BLOCK_SHINGLES when so many of its texts have the shingle.
LOCAL_DF = 2
BLOCK_SHINGLES = 1 << 21
#: A key of at least so many documents is dealt out in parts of about HOT_ROWS / 2, a tile in chunks, a star in shares.
HOT_ROWS, TILE_ROWS, STAR_ROWS = 1024, 1024, 256
#: Rounds of links between components before the tiles; more only save work.
ROUNDS = 2


def _sets(batch: pa.RecordBatch, column: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word hashes, shingle set) of each text."""
    for _, part in groups(batch.column(column)):
        t = Texts(part, lower=True)
        t.split(SPACE)
        sets = shingle_sets(t, SIZE)
        words = t.words
        for k, one in enumerate(sets):
            yield words[t.first[k] : t.first[k + 1]], one


def _digest(words: np.ndarray) -> bytes:
    """128 bits of a text's word hashes in their order."""
    at = np.arange(1, len(words) + 1, dtype=np.uint64)
    return (int(mix(words + at * np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64)) << 64 | int(mix(words * np.uint64(3) ^ mix(at)).sum(dtype=np.uint64))).to_bytes(16, "little")


def _surveyed(docs: DataFrame) -> DataFrame:
    """Rows (id, n, sha) for every document, rows (hash, df) for shingles that several documents of a block have.

    Within a block each text counts once, however many copies it has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        known: set[bytes] = set()
        size = 0

        def often() -> tuple[np.ndarray, np.ndarray]:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            keep = n >= LOCAL_DF
            return h[keep].view(np.int64), n[keep]

        def emit(ids, ns, shas, hs, dfs) -> pa.RecordBatch:
            k, m = len(ids), len(hs)
            none = lambda x, t=pa.int64(): pa.nulls(x, t)
            cols = [
                [pa.array(ids, pa.int64()), none(m)],
                [pa.array(ns, pa.int64()), none(m)],
                [pa.array(shas, pa.binary()), none(m, pa.binary())],
                [none(k), pa.array(hs, pa.int64())],
                [none(k), pa.array(dfs, pa.int64())],
            ]
            return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in cols], names=["id", "n", "sha", "hash", "df"])

        for batch in batches:
            ns, shas = [], []
            hs, dfs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for words, one in _sets(batch, 1):
                ns.append(len(one))
                shas.append(sha := _digest(words))
                if sha in known:
                    continue
                known.add(sha)
                held.append(one)
                size += len(one)
                if size >= BLOCK_SHINGLES:
                    h, n = often()
                    hs.append(h)
                    dfs.append(n)
                    held, size, known = [], 0, set()
            yield emit(batch.column(0).to_pylist(), ns, shas, np.concatenate(hs), np.concatenate(dfs))
        if held:
            yield emit([], [], [], *often())

    return docs.mapInArrow(lean(run), "id long, n long, sha binary, hash long, df long")


def _with_digest(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shas = []
            for _, part in groups(batch.column(1)):
                t = Texts(part, lower=True)
                t.split(SPACE)
                words = t.word_hashes()
                shas.extend(_digest(words[a:b]) for a, b in zip(t.first[:-1].tolist(), t.first[1:].tolist(), strict=True))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shas, pa.binary())], names=["id", "text", "_sha"])

    return docs.mapInArrow(lean(run), "id long, text string, _sha binary")


def _keyed(docs: DataFrame, common: tuple[np.ndarray, np.ndarray, np.ndarray]) -> DataFrame:
    """(key, part, id, n): the first shingles of every document in the global order; part is over 0 for hot keys alone."""
    hashes, ranks, counts = common
    hot = hashes[counts >= HOT_ROWS]
    parts = (2 * counts[counts >= HOT_ROWS] // HOT_ROWS).astype(np.uint64)

    def part_of(one: np.ndarray, i: int) -> np.ndarray:
        out = np.zeros(len(one), dtype=np.int32)
        if len(hot):
            at = np.minimum(np.searchsorted(hot, one), len(hot) - 1)
            hit = hot[at] == one
            out[hit] = 1 + (mix(np.array([i], dtype=np.int64).view(np.uint64)) % parts[at[hit]]).astype(np.int32)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            keys, dealt, who, ns = [], [], [], []
            held = 0

            def out() -> pa.RecordBatch:
                each = list(map(len, keys))
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(dealt)), pa.array(np.repeat(np.array(who, dtype=np.int64), each)), pa.array(np.repeat(np.array(ns, dtype=np.int64), each))], names=["key", "part", "id", "n"])

            for i, (_, one) in enumerate(_sets(batch, 1)):
                n = len(one)
                if not n:
                    continue
                take = n - (4 * n + 4) // 5 + 1
                if len(hashes):
                    at = np.minimum(np.searchsorted(hashes, one), len(hashes) - 1)
                    known = hashes[at] == one
                    if known.any():
                        rare = one[~known]
                        if len(rare) < take:  # both parts stay in the global order: rare by hash, then common by rank
                            rest = one[known]
                            rest = rest[np.argsort(ranks[at[known]], kind="stable")]
                            rare = np.concatenate([rare, rest[: take - len(rare)]])
                        one = rare
                keys.append(one[:take])
                dealt.append(part_of(one[:take], int(ids[i])))
                who.append(int(ids[i]))
                ns.append(n)
                held += take
                if held > 200_000:
                    yield out()
                    keys, dealt, who, ns, held = [], [], [], [], 0
            if keys:
                yield out()

    return docs.mapInArrow(lean(run), "key long, part int, id long, n long")


def _bits(n: int) -> int:
    """Signature bits of a size band, a power of two: two to four a shingle, twice that for sets of up to 256."""
    band = (max(n, 1) - 1).bit_length()
    return 64 << max(0, band - (4 if band <= 8 else 5))


def signature(one: np.ndarray) -> np.ndarray:
    m = _bits(len(one))
    at = (one >> np.uint64(7)) & np.uint64(m - 1)
    flags = np.zeros(m, dtype=np.uint8)
    flags[at.astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little").view(np.uint64)


def _fold(sig: np.ndarray, words: int) -> np.ndarray:
    while sig.shape[-1] > words:
        half = sig.shape[-1] // 2
        sig = sig[..., :half] | sig[..., half:]
    return sig


def may_link(n: int, sig: np.ndarray, ns: np.ndarray, sigs: np.ndarray) -> np.ndarray:
    """Which of the sets (ns, sigs; one width) can reach 0.8 with the set (n, sig), by the bound on their overlap."""
    width = min(sig.shape[-1], sigs.shape[-1])
    sig, sigs = _fold(sig, width), _fold(sigs, width)
    most = np.minimum(n - np.bitwise_count(sig & ~sigs).sum(-1).astype(np.int64), ns - np.bitwise_count(sigs & ~sig).sum(-1).astype(np.int64))
    return 180 * most >= 80 * (n + ns)


def _with_arrays(docs: DataFrame, arrays: bool) -> DataFrame:
    """(id, n, sig) of every document, with the sorted array too if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for begin, part in groups(batch.column(1)):
                t = Texts(part, lower=True)
                t.split(SPACE)
                sets = shingle_sets(t, SIZE)
                columns = [ids.slice(begin, len(sets)), pa.array([len(x) for x in sets], pa.int64()), pa.array([signature(x).tobytes() for x in sets], pa.binary())]
                if arrays:
                    columns.append(pa.array([x.tobytes() for x in sets], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "sig", "arr"][: len(columns)])

    return docs.mapInArrow(lean(run), "id long, n long, sig binary" + ", arr binary" * arrays)


def _possible(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """The pairs (a, b) that the bound on their overlap allows."""
    a = sigs.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
    b = sigs.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            _, _, na, sa, nb, sb = (c.to_pylist() for c in batch.columns)
            ok = [bool(may_link(n, np.frombuffer(x, np.uint64), np.array([m]), np.frombuffer(y, np.uint64)[None])[0]) for n, x, m, y in zip(na, sa, nb, sb, strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.join(a, "a").join(b, "b").select("a", "b", "na", "sa", "nb", "sb").mapInArrow(lean(run), "a long, b long")


def _verified(pairs: DataFrame, arrays: DataFrame) -> DataFrame:
    """The pairs (a, b) that link.  Each a's array comes first in its run of rows, then those of its partners, one at a time."""
    # a star of many partners is dealt out in shares, each with its centre's array
    shares = pairs.groupBy("a").agg(F.floor(F.count(F.lit(1)) / STAR_ROWS).alias("shares")).where(F.col("shares") > 0)
    pairs = pairs.join(shares, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("shares", F.lit(0)) + 1).alias("share"))
    left = pairs.select("a", "share").distinct().join(arrays, F.col("a") == F.col("id")).select("a", "share", F.lit(0).alias("k"), "id", "sig", "arr")
    right = pairs.join(arrays, F.col("b") == F.col("id")).select("a", "share", F.lit(1).alias("k"), "id", "sig", "arr")
    n = max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = left.unionByName(right).repartition(n, "a", "share").sortWithinPartitions("a", "share", "k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[tuple[np.ndarray, np.ndarray]] = []  # arrays of the current a: one, unless rows share an id
        current = None
        for batch in small(batches):
            out_a, out_b = [], []
            for a, share, k, b, sig, arr in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (a, share) != current:
                    current, own = (a, share), []
                one, s = np.frombuffer(arr, dtype=np.uint64), np.frombuffer(sig, dtype=np.uint64)
                if k == 0:
                    own.append((one, s))
                    continue
                for mine, ms in own:
                    if not may_link(len(mine), ms, np.array([len(one)]), s[None])[0]:
                        continue
                    fewer, most = (mine, one) if len(mine) <= len(one) else (one, mine)
                    at = np.minimum(np.searchsorted(most, fewer), len(most) - 1)
                    both = int((most[at] == fewer).sum())
                    if 100 * both >= 80 * (len(mine) + len(one) - both):
                        out_a.append(a)
                        out_b.append(b)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    return dealt.mapInArrow(lean(run), "a long, b long")


def _tiles(rows: DataFrame, sigs: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components that share a key and pass the bound; rows: key, n, id, component; sigs: id, sig."""
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    # a large tile: each document is of one chunk and goes to the tile of every two chunks that has its own
    chunks = rows.groupBy("key").agg(F.floor(F.count(F.lit(1)) / TILE_ROWS).cast("int").alias("more")).where(F.col("more") > 0)
    split = rows.join(chunks, "key", "left").withColumn("more", F.coalesce("more", F.lit(0))).withColumn("own", F.pmod(F.xxhash64("id"), F.col("more") + 1).cast("int"))
    split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("more"))))
    split = split.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "n", "id", "component", F.when(F.col("own") == F.col("other"), -1).otherwise(F.col("own")).alias("lane"))
    split = split.join(sigs, "id").select("key", "lo", "hi", "n", "id", "component", "sig", "lane")
    dealt = split.repartition(n, "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "n", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = None
        sent: set[tuple[int, int]] = set()  # a pair shares many keys; once a task is enough (a bounded memory of it)
        tile: list[tuple[int, int, int, np.ndarray, int]] = []
        blocks: dict[int, tuple] = {}

        def block(lo: int, width: int) -> tuple:
            """Arrays over the rows lo.. of the tile, grown by doubling."""
            got = blocks.get(width)
            if got is None or got[0] < len(tile):
                part = [r for r in tile if len(r[3]) == width]
                got = (len(tile), np.array([r[0] for r in part]), np.array([r[1] for r in part]), np.array([r[2] for r in part]), np.array([r[3] for r in part]), np.array([r[4] for r in part]))
                blocks[width] = got
            return got

        for batch in small(batches):
            out_a, out_b = [], []
            waiting: list[tuple[int, int, int, np.ndarray, int]] = []

            def settle() -> None:
                """Tests the waiting rows of one key against the tile and each other."""
                nonlocal tile
                if not waiting:
                    return
                least = -(-4 * waiting[0][0] // 5)
                tile = [r for r in tile if r[0] >= least] + waiting
                blocks.clear()
                if len({r[2] for r in tile}) > 1:
                    for size, i, c, s, lane in waiting:
                        for width in {len(r[3]) for r in tile}:
                            _, ns, ids, cs, sigs, lanes = block(0, width)
                            ok = (cs != c) & ((lanes != lane) | (lane < 0)) & (5 * ns >= 4 * size) & ((ns < size) | ((ns == size) & (ids < i)))
                            if ok.any():
                                at = np.flatnonzero(ok)
                                hit = at[may_link(size, s, ns[at], sigs[at])]
                                for j in ids[hit].tolist():
                                    pair = (min(i, j), max(i, j))
                                    if pair not in sent:
                                        sent.add(pair)
                                        out_a.append(pair[0])
                                        out_b.append(pair[1])
                if len(sent) > 100_000:
                    sent.clear()
                waiting.clear()

            for k, lo, hi, size, i, c, sig, lane in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                if (k, lo, hi) != key:
                    settle()
                    key, tile = (k, lo, hi), []
                waiting.append((size, i, c, np.frombuffer(sig, dtype=np.uint64), lane))
                if len(waiting) >= 1024:
                    settle()
            settle()
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    return dealt.mapInArrow(lean(run), "a long, b long")


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs whose id is in ids (id), and few others: a bitmap of bounded size is broadcast, nothing is shuffled."""
    ids = cut(ids.select(F.col("id").cast("string").alias("sha")).distinct())
    masks, log_words = exact.masks_of(ids, ids.count())
    return exact.marked(docs.withColumn("sha", F.col("id").cast("string")), cut(masks), log_words).where("_maybe").drop("sha", "_maybe")


def _distinct(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """docs without the ids whose every row repeats a kept text; rows repeated under one id once.

    Only rows flagged by a bitmap of bounded size are shuffled.
    """
    by_text = verdicts.where("_maybe").groupBy("id", "text_sha256").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    ids = by_text.groupBy(F.col("id").alias("_id")).agg(F.max("kept").alias("_kept"), F.max(F.when(F.col("kept"), F.col("n"))).alias("_n"))
    ids = cut(ids.where(~F.col("_kept") | (F.col("_n") > 1)))
    masks, log_words = exact.masks_of(ids.select(F.col("_id").cast("string").alias("sha")), ids.count())
    tested = exact.marked(docs.withColumn("sha", F.col("id").cast("string")), cut(masks), log_words)
    judged = tested.where("_maybe").join(ids, F.col("id") == F.col("_id"), "left")
    out = tested.where(~F.col("_maybe")).select("id", "text").unionByName(judged.where(F.col("_id").isNull()).select("id", "text"))
    if not ids.where("_kept").isEmpty():
        out = out.unionByName(_with_digest(judged.where("_kept").select("id", "text")).dropDuplicates(["id", "_sha"]).drop("_sha"))
    return out


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("id"))


def _ordered(pairs: DataFrame) -> DataFrame:
    """(x, y) as distinct (a, b) with a < b."""
    return pairs.where(F.col("x") != F.col("y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _checked(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    arrays = stored(_with_arrays(_only(docs, _ends(pairs)), True), "arrays")
    found = cut(_verified(pairs, arrays))
    forget(arrays)
    return found


def _open(shared: DataFrame, parts: DataFrame) -> DataFrame:
    """(key, n, id, shares, component) of the keys whose documents lie in several components."""
    named = shared.select("key", "id", "n", "shares").join(parts, "id", "left").withColumn("component", F.coalesce("component", "id"))
    several = named.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where(F.col("lo") != F.col("hi")).select("key")
    return named.join(several, "key").select("key", "n", "id", "shares", "component")


def _hot_stars(rows: DataFrame) -> DataFrame:
    """(x, y) as the windows over (key, band) would give them, by aggregates: no task gets all rows of a hot key."""
    rank = F.struct("shares", (-F.col("n")).alias("n"), (-F.col("id")).alias("i"))
    top = lambda df, name: df.groupBy("key", "band").agg((-F.max(rank)["i"]).alias(name))
    one = rows.join(top(rows, "c"), ["key", "band"]).where(F.col("id") != F.col("c"))
    two = one.join(top(one, "c2"), ["key", "band"])
    return two.select(F.explode(F.array("c", "c2")).alias("x"), F.col("id").alias("y"))


def _joined(parts: DataFrame, edges: DataFrame) -> DataFrame:
    """Components (id, component) after more links: only the components that these join are worked on."""
    as_a = parts.select(F.col("id").alias("a"), F.col("component").alias("ca"))
    as_b = parts.select(F.col("id").alias("b"), F.col("component").alias("cb"))
    over = edges.join(as_a, "a", "left").join(as_b, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    merged = components(over).select(F.col("id").alias("component"), F.col("component").alias("to"))
    every = parts.unionByName(_ends(edges).distinct().join(parts, "id", "left_anti").select("id", F.col("id").alias("component")))
    return stored(every.join(merged, "component", "left").select("id", F.coalesce("to", "component").alias("component")), "parts")


def links(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document row: id, n_shingles, component_id, keep_id (least id with the same words)."""
    ship(docs.sparkSession)
    base = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    survey = stored(_surveyed(base), "survey")
    rows = cut(survey.where(F.col("sha").isNotNull()).select("id", "sha", "n", F.monotonically_increasing_id().alias("_row")))
    verdicts, _ = exact.verdicts(rows.select("id", "sha", "_row"))
    named_docs = base.where(F.col("id").isNotNull())
    hot = survey.where(F.col("hash").isNotNull()).groupBy("hash").agg(F.sum("df").alias("df")).where(F.col("df") >= COMMON_DF).orderBy(F.desc("df"), "hash").limit(MAX_COMMON).toArrow()
    hashes = hot.column("hash").to_numpy().astype(np.int64).view(np.uint64)
    ranks = np.arange(len(hashes), 0, -1, dtype=np.int32)  # the commonest last
    counts = hot.column("df").to_numpy()
    order = np.argsort(hashes)
    forget(survey)
    del hot
    give_back()
    keyed = _keyed(_distinct(named_docs, verdicts), (hashes[order], ranks[order], counts[order]))

    by_key = Window.partitionBy("key", "part").orderBy("n", "id")
    fits = (5 * F.col("pn") >= 4 * F.col("n")) | (5 * F.col("n") >= 4 * F.col("nn"))
    seen = keyed.withColumns({"pid": F.lag("id").over(by_key), "pn": F.lag("n").over(by_key), "nn": F.lead("n").over(by_key)}).where((F.col("part") > 0) | F.coalesce(fits, F.lit(False)))
    shared = stored(seen.withColumn("band", F.floor(F.log("n") / F.log(F.lit(1.25)))).select("key", "part", "id", "n", "band", "pid", "pn"), "shared")
    sigs = stored(_with_arrays(_only(named_docs, shared.select("id")), False), "signatures")

    # first links: every (key, band) to its two documents with the most shared keys (the text that near copies were
    # made from has more in common with them than they have with each other), every band to the one before
    wide = shared.groupBy("id").agg(F.count(F.lit(1)).alias("shares"))
    seen, shared = shared, stored(shared.join(wide, "id"), "shared")
    forget(seen)
    in_band = Window.partitionBy("key", "band").orderBy(F.desc("shares"), "n", "id")
    star = shared.where("part = 0").withColumn("c", F.first("id").over(in_band)).withColumn("c2", F.nth_value("id", 2).over(in_band))
    below = F.when((F.floor(F.log("pn") / F.log(F.lit(1.25))) < F.col("band")) & (5 * F.col("pn") >= 4 * F.col("n")), F.col("pid"))
    pairs = star.select(F.explode(F.array("c", "c2", below)).alias("x"), F.col("id").alias("y")).unionByName(_hot_stars(shared.where("part > 0")))
    tested = cut(_possible(_ordered(pairs), sigs))
    parts = components(_checked(tested, named_docs))
    # more links between what is still apart, so that large groups become one component before tiles compare all
    for k in range(ROUNDS):
        # keys that lie in one component stay so: later rounds read what is left alone
        closed, shared = shared, stored(_open(shared, parts), "open")
        forget(closed)
        lead = shared.groupBy("key", "component").agg(F.max(F.struct("shares", F.xxhash64("id", F.lit(k)).alias("r"), "n", "id")).alias("m")).select("key", "m.shares", "m.n", "m.id")
        w = Window.partitionBy("key").orderBy("n", "id")
        top = Window.partitionBy("key").orderBy(F.desc("shares"), "n", "id")
        apart = lead.withColumns({"pid": F.lag("id").over(w), "pn": F.lag("n").over(w), "tid": F.first("id").over(top), "tn": F.first("n").over(top)})
        fits = lambda a, b: (5 * F.col(a) >= 4 * F.col(b)) & (5 * F.col(b) >= 4 * F.col(a))
        both = apart.where(fits("pn", "n")).select(F.col("pid").alias("x"), F.col("id").alias("y")).unionByName(apart.where(fits("tn", "n")).select(F.col("tid").alias("x"), F.col("id").alias("y")))
        more = cut(_possible(_ordered(both).join(tested, ["a", "b"], "left_anti"), sigs))
        if more.isEmpty():
            break
        parts = _joined(parts, _checked(more, named_docs))
        tested = cut(tested.unionByName(more))
    closed, shared = shared, stored(_open(shared, parts), "open")
    forget(closed)
    last = cut(_tiles(shared, sigs.select("id", "sig")).distinct().join(tested, ["a", "b"], "left_anti"))
    forget(shared)
    forget(sigs)
    final = _joined(parts, _checked(last, named_docs))

    sizes = rows.join(verdicts.where("kept").select("id", F.col("text_sha256").alias("sha")), ["id", "sha"]).groupBy("id").agg(F.max("n").alias("n_shingles"))
    known = cut(sizes.join(final.groupBy("id").agg(F.min("component").alias("component")), "id", "left").select(F.col("id").alias("keep_id"), "n_shingles", F.coalesce("component", "id").alias("component_id")))
    return verdicts.select("id", "keep_id").join(known, "keep_id", "left").select("id", F.coalesce("n_shingles", F.lit(0)).cast("long").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id"))).alias("component_id"), "keep_id")


def op7_jaccard(spark, sf_dir: str) -> DataFrame:
    out = links(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


OP7_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM w),
g AS (SELECT s2.doc_id, unnest(s2.s) AS x, len(s2.s) AS n FROM s s2),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*)))
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles,
       least(doc_id, coalesce((WITH RECURSIVE r(v) AS (SELECT s.doc_id UNION SELECT p.b FROM r JOIN p ON p.a = r.v) SELECT min(v) FROM r), doc_id)) AS component_id
FROM s
"""
