"""Bounded, reproducible samples of labelled rows for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvlog.llm.common import cut

#: Bytes of text a class that a sample takes to the driver at most.
SAMPLE_BYTES = 48 << 20


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of the id's text is a multiple of 5 (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, text: str = "text", doc_id: str = "doc_id", most_bytes: int = SAMPLE_BYTES) -> tuple[list[bytes], list[int], list[float]]:
    """Texts, labels (0/1) and the classes' shares among all learnable labels.

    At most ``rows`` ids of each class, those of the smallest hash, so the sample doesn't depend on the layout, and of these,
    in the same order, no more than ``most_bytes`` bytes of text a class (the first one always).  Of rows that repeat an id
    the least text counts; of an id with both labels, the greater one.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id))).groupBy(F.col(doc_id).alias("_id")).agg(F.max(F.col(label).cast("int")).alias("_y"))
    counts = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    picked = None
    for y in (0, 1):
        part = known.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(rows)
        picked = part if picked is None else picked.unionByName(part)
    # bounded by 2 * rows ids
    own = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_t")).join(F.broadcast(picked), "_id").groupBy("_id", "_y").agg(F.min("_t").alias("_t"))
    own = cut(own.select("_id", "_y", F.xxhash64("_id").alias("_h"), F.col("_t").cast("binary").alias("_t"), F.octet_length("_t").cast("long").alias("_n")))
    spent, chosen = {0: 0, 1: 0}, []
    sizes = sorted(own.select("_id", "_y", "_h", "_n").collect(), key=lambda r: (r["_h"], r["_id"]))
    for r in sizes:
        if not spent[r["_y"]] or spent[r["_y"]] + r["_n"] <= most_bytes:
            spent[r["_y"]] += max(r["_n"], 1)
            chosen.append(r["_id"])
    if len(chosen) < len(sizes):
        own = own.where(F.col("_id").isin(chosen))
    got = sorted(own.select("_id", "_y", "_t").collect(), key=lambda r: r["_id"])
    shares = [counts.get(y, 0) / total if total else 0.5 for y in (0, 1)]
    return [bytes(r["_t"]) for r in got], [r["_y"] for r in got], shares
