"""Exact dedup by two-pass Bloom filtering; DataFrame functions only.

Pass 1 hashes each normalised text to one bit of a filter of 64-bit words, four words a row however many rows there are.  A
word whose bits number fewer than its rows has seen some bit twice: its rows are *possibly repeated*.  Neither texts nor
digests take part: a row sends its word's number and bit (about 12 bytes as compressed), which is less than a bitmap a task
would be once tasks have fewer rows than the filter has bytes.  Pass 2 tests every row against the flagged words, broadcast
as a bitmap of at most 2**MAX_LOG_BITS bits: rows of clean words pass straight through, the rest are grouped by
SHA-256, so a false positive costs a shuffled digest and never a result.

Defined cases: null text counts as empty; equal texts keep the row with the smallest id, null ids last, one row alone
even where (id, text) rows repeat; an empty table gives an empty result; other columns, whatever their names, stay.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvlog.llm.common import cut, packed, smallest_of_group, table

#: Bits of a broadcast bitmap (at most 2**21 rows of 16 bytes), and of the words of pass 1, which aren't broadcast.
MIN_LOG_BITS, MAX_LOG_BITS = 16, 27
MAX_LOG_WORDS = 48


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(id, sha, _row) of every row, kept in the shared folder: the text is read and hashed once."""
    return cut(docs.select(F.col(doc_id).alias("id"), F.sha2(normalised(F.col(text)), 256).alias("sha"), F.monotonically_increasing_id().alias("_row")))


def _word(key: Column, log_words: int) -> tuple[Column, Column]:
    h = F.xxhash64(key)
    return F.shiftrightunsigned(h, 64 - log_words), h.bitwiseAND(63).cast("int")


def suspects(rows: DataFrame, n: int, sha: str = "sha") -> tuple[DataFrame, int]:
    """Pass 1: (w) the filter words that saw a bit twice; log2 of the words."""
    log_words = min(MAX_LOG_WORDS, max(MIN_LOG_BITS, math.ceil(math.log2(4 * max(n, 1)))))
    word, bit = _word(F.col(sha), log_words)
    seen = rows.select(word.alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("m")).groupBy("w")
    return seen.agg(F.bit_or("m").alias("bits"), F.count(F.lit(1)).alias("n")).where(F.col("n") > F.bit_count("bits")).select("w"), log_words


def masks_of(keys: DataFrame, n: int, key: str = "sha") -> tuple[DataFrame, int]:
    """(_bucket, _mask) that flag every one of the keys, and few others while they are fewer than 2**MAX_LOG_BITS / 32."""
    log_bits = min(MAX_LOG_BITS, max(MIN_LOG_BITS, math.ceil(math.log2(32 * max(n, 1)))))
    return _bitmap(keys.select(_word(F.col(key), log_bits)[0].alias("w"))), log_bits


def _bitmap(numbers: DataFrame) -> DataFrame:
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("w").bitwiseAND(63).cast("int"))
    return numbers.groupBy(F.shiftright("w", 6).alias("_bucket")).agg(F.bit_or(one).alias("_mask"))


def marked(rows: DataFrame, masks: DataFrame, log_bits: int, key: str = "sha", number: Column | None = None) -> DataFrame:
    """rows with ``_maybe``: whether the bitmap has the key; number: the key's bit, where it isn't that of its hash.  Callers
    keep columns _bucket, _mask, _w free."""
    word = _word(F.col(key), log_bits)[0] if number is None else number
    with_word = rows.withColumn("_w", word).withColumn("_bucket", F.shiftright("_w", 6))
    hit = F.call_function("bit_get", F.col("_mask"), F.col("_w").bitwiseAND(63).cast("int")) == 1
    return with_word.join(F.broadcast(masks), "_bucket", "left").withColumn("_maybe", F.coalesce(hit, F.lit(False))).drop("_w", "_bucket", "_mask")


class Filter:
    """The finished filter: tests the digests of rows."""

    def __init__(self, rows: DataFrame, sha: str = "sha"):
        words, self.log_words = suspects(rows, rows.count(), sha)
        words = cut(words)
        self.log_bits = self.log_words
        if self.log_words <= MAX_LOG_BITS:  # a bit a word
            self.masks = cut(_bitmap(words))
        else:  # more words than bits: flagged words share bits with few others while they are few
            masks, self.log_bits = masks_of(words, words.count(), "w")
            self.masks = cut(masks)

    def test(self, rows: DataFrame, sha: str = "sha") -> DataFrame:
        word = _word(F.col(sha), self.log_words)[0]
        return marked(rows, self.masks, self.log_bits, number=word if self.log_bits == self.log_words else _word(word, self.log_bits)[0])


def verdicts(rows: DataFrame) -> tuple[DataFrame, Filter]:
    """For rows (id, sha, _row) that can be read again cheaply: id, keep_id, group_size, kept, text_sha256, _maybe, _row; the filter."""
    seen = Filter(rows)
    tested = seen.test(rows)
    alone = tested.where(~F.col("_maybe")).select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"), "_maybe", "_row")
    order = F.struct(F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), F.col("_row").alias("row"))
    grouped = smallest_of_group(tested.where("_maybe"), "sha", order)
    shared = grouped.select("id", F.col("first.id").alias("keep_id"), "group_size", (F.col("first.row") == F.col("_row")).alias("kept"), F.col("sha").alias("text_sha256"), "_maybe", "_row")
    return alone.unionByName(shared), seen


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows that stay, all columns.  Only flagged rows are shuffled with their texts."""
    found, seen = verdicts(digests(docs, text, doc_id))
    own = F.col("row").getField
    tested = seen.test(packed(docs).withColumn("sha", F.sha2(normalised(own(text)), 256)))
    # what becomes of each (sha, id) among the flagged rows; a key of many rows (null ids) is a skewed join, which AQE splits
    lost = found.where("_maybe").groupBy(F.col("text_sha256").alias("_sha"), F.col("id").alias("_id")).agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")).where(~F.col("kept") | (F.col("n") > 1))
    judged = tested.where("_maybe").join(lost, (F.col("sha") == F.col("_sha")) & own(doc_id).eqNullSafe(F.col("_id")), "left")
    single = judged.where(F.col("n").isNull()).select("row")
    repeated = judged.where("kept").groupBy("_sha", "_id").agg(F.first("row").alias("row")).select("row")
    return tested.where(~F.col("_maybe")).select("row").unionByName(single).unionByName(repeated).select("row.*")


def op9_exact_dedup(spark, sf_dir: str) -> DataFrame:
    out, _ = verdicts(digests(table(spark, sf_dir, "documents")))
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


OP9_SQL = r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept,
       text_sha256
FROM n
"""
