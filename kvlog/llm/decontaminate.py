"""Benchmark decontamination by winnowing; DataFrame functions only.

A window of L words has w = L - k + 1 k-grams, k = (L + 1) / 2 rounded down; its fingerprint is the least hash of these and
the place of the first one that has it.  Both sides winnow alike, so two equal windows select equal k-grams: every shared
span of L words or more is found.  Windows that follow each other mostly select the same place, which is kept once.
Selected places are joined by their hash alone, and each hit is extended word by word to both sides, by up to w - 1 words,
as no window of that k-gram reaches further; where the run has L words or more, all its words are hit.

Items of at least WINDOW words use L = WINDOW; a shorter item is one window of its own length, and each length that occurs
is winnowed in the same way.  A document is winnowed only if some k-gram is in a bitmap of the benchmark's fingerprints
(BITS_EACH bits a fingerprint, 2**MAX_LOG_WORDS words at most), and only places in the bitmap leave its row.

Defined cases: null or wordless texts have no words and no hits; null item ids count as one item but are not listed; repeated
document rows are judged one by one; with an empty benchmark nothing is hit; an empty table gives no rows; ids are returned
with their own type, and extra columns of either side don't matter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvlog.llm.common import cut, let, table, words

WINDOW = 10
#: The bitmap is part of the plan: 64-bit words, at least and at most (2 MiB); more fingerprints make it less selective.
BITS_EACH, MIN_LOG_WORDS, MAX_LOG_WORDS = 32, 8, 18
#: The benchmark's places are broadcast up to this many bytes of text; beyond, the join shuffles.
BROADCAST_BYTES = 16 << 20
_PLACE = "array<struct<len:int,at:int,fp:bigint,before:array<string>,gram:string,after:array<string>>>"


def _gram(length: int) -> tuple[int, int]:
    k = (length + 1) // 2
    return k, length - k + 1


def _grams(ws: Column, length: int) -> Column:
    """Hash of each k-gram; ws must have at least ``length`` words.  Words are got one by one: a slice would copy the array."""
    k, _ = _gram(length)
    return F.transform(F.sequence(F.lit(0), F.size(ws) - k), lambda i: F.xxhash64(F.lit(length), *[F.get(ws, i + j) for j in range(k)]))


def _selected(grams: Column, length: int) -> Column:
    """The places (from 0) that the windows select, each once."""
    _, w = _gram(length)
    of = lambda i: F.struct(F.get(grams, i).alias("h"), i.alias("at"))
    least = lambda i: F.least(*[of(i + j) for j in range(w)]) if w > 1 else of(i)
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(grams) - w), lambda i: least(i)["at"]))


def _places(ws: Column, grams: Column, at: Column, length: int) -> Column:
    """The k-grams at the places, with up to w - 1 words before and after."""
    k, w = _gram(length)

    def one(i: Column) -> Column:
        before = F.least(i, F.lit(w - 1))
        return F.struct(
            F.lit(length).alias("len"), i.alias("at"), F.get(grams, i).alias("fp"), F.slice(ws, i - before + 1, before).alias("before"), F.array_join(F.slice(ws, i + 1, k), " ").alias("gram"), F.slice(ws, i + k + 1, w - 1).alias("after")
        )

    return F.transform(at, one)


def benchmark_places(benchmark: DataFrame, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """(len, fp, before, gram, after, items, unnamed): every distinct selected place and the items that have it."""
    base = benchmark.select(F.col(item_id).cast("string").alias("item"), words(F.col(text)).alias("ws")).where(F.size("ws") > 0)

    def winnowed(n: int) -> Column:
        return let(_grams(F.col("ws"), n), lambda g: _places(F.col("ws"), g, _selected(g, n), n))

    found = F.array().cast(_PLACE)
    for n in range(1, WINDOW + 1):
        found = F.when(F.size("ws") >= n if n == WINDOW else F.size("ws") == n, winnowed(n)).otherwise(found)
    each = base.select("item", F.inline(found)).drop("at")
    return each.groupBy("len", "fp", "before", "gram", "after").agg(F.collect_set("item").alias("items"), F.max(F.col("item").isNull()).alias("unnamed"))


def _slot(fp: Column, log_words: int) -> tuple[Column, Column]:
    return F.shiftrightunsigned(fp, 64 - log_words).cast("int"), fp.bitwiseAND(63).cast("int")


def _equal(a: Column, b: Column) -> Column:
    """How many leading elements of two arrays are equal, pair by pair."""
    n = F.least(F.size(a), F.size(b))
    differ = F.array_position(F.transform(F.sequence(F.lit(0), n), lambda i: (i < n) & (F.get(a, i) == F.get(b, i))), F.lit(False))
    return (differ - 1).cast("int")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document row: id, n_words, n_hit, n_items, items (sorted ids), contaminated."""
    known = cut(benchmark_places(benchmark))
    size = known.agg(F.coalesce(F.sum(F.length("gram") + 8 * F.size("before") + 8 * F.size("after") + 16 * F.size("items") + 40), F.lit(0)).alias("b"), F.count(F.lit(1)).alias("n"), F.collect_set("len").alias("lens")).first()
    log_words = min(MAX_LOG_WORDS, max(MIN_LOG_WORDS, math.ceil(math.log2(max(size.n, 1) * BITS_EACH / 64))))
    slot, bit = _slot(F.col("fp"), log_words)
    filled = {r.slot: r.bits for r in known.groupBy(slot.alias("slot")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits")).collect()}
    bitmap = F.split(F.lit(",".join(str(filled.get(i, 0)) for i in range(1 << log_words))), ",").cast("array<bigint>")

    def maybe(fp: Column) -> Column:
        slot, bit = _slot(fp, log_words)
        return F.call_function("bit_get", F.get(bitmap, slot), bit) == 1

    none = F.array().cast(_PLACE)

    def candidates(ws: Column, n: int) -> Column:
        def of(g: Column) -> Column:
            own = F.filter(_selected(g, n), lambda i: maybe(F.get(g, i)))
            return F.when(F.exists(g, maybe), _places(ws, g, own, n)).otherwise(none)

        return F.when(F.size(ws) >= n, let(_grams(ws, n), of)).otherwise(none)

    def judged(ws: Column) -> Column:
        found = F.concat(*[candidates(ws, n) for n in sorted(size.lens)]) if size.lens else none
        return F.struct(F.size(ws).cast("long").alias("n_words"), found.alias("found"))

    scanned = cut(docs.select(F.col(doc_id).alias("id"), F.monotonically_increasing_id().alias("_row"), let(words(F.col(text)), judged).alias("j")).select("id", "_row", "j.*"))
    cand = scanned.where(F.size("found") > 0).select("_row", F.inline("found"))
    side = known.select("len", "fp", "gram", F.col("before").alias("b_before"), F.col("after").alias("b_after"), "items", "unnamed")
    pairs = cand.join(F.broadcast(side) if size.b <= BROADCAST_BYTES else side, ["len", "fp", "gram"])
    k = F.floor((F.col("len") + 1) / 2).cast("int")
    runs = pairs.select("_row", "items", "unnamed", "len", "at", k.alias("k"), _equal(F.reverse("before"), F.reverse("b_before")).alias("left"), _equal(F.col("after"), F.col("b_after")).alias("right")).where(F.col("left") + F.col("k") + F.col("right") >= F.col("len"))
    span = F.struct((F.col("at") - F.col("left")).alias("s"), (F.col("at") + F.col("k") + F.col("right")).alias("e"))
    merged = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("e")),
        lambda a, x: F.struct((a["n"] + F.greatest(a["e"], x["e"]) - F.greatest(a["e"], x["s"])).cast("long").alias("n"), F.greatest(a["e"], x["e"]).alias("e")),
        lambda a: a["n"],
    )
    # bounded by the document's places and the benchmark's items
    hit = runs.groupBy("_row").agg(F.collect_set(span).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), F.max("unnamed").alias("unnamed"))
    hit = hit.select("_row", merged.alias("n_hit"), "items", (F.size("items") + F.col("unnamed").cast("int")).cast("long").alias("n_items"))
    nothing = F.array().cast("array<string>")
    zero = F.lit(0).cast("long")
    clean = scanned.where(F.size("found") == 0).select("id", "n_words", zero.alias("n_hit"), zero.alias("n_items"), nothing.alias("items"))
    rest = scanned.where(F.size("found") > 0).select("id", "_row", "n_words").join(hit, "_row", "left")
    rest = rest.select("id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"), F.coalesce("items", nothing).alias("items"))
    return clean.unionByName(rest).withColumn("contaminated", F.col("n_hit") > 0)


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

OP2_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, l, array_to_string(w[i:i + l - 1], ' ') AS win
  FROM (SELECT item_id, w, least(len(w), 10) AS l, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, l, i, array_to_string(w[i:i + l - 1], ' ') AS win
  FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, (SELECT DISTINCT l FROM iw) WHERE len(w) >= l)),
hit AS (SELECT DISTINCT doc_id, l, i FROM dw WHERE (l, win) IN (SELECT (l, win) FROM iw)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM hit) GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM dw JOIN iw USING (l, win)) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
