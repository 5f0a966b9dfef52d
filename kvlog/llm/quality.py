"""Quality classifier: supervised subword embeddings.

Words and character n-grams are hashed to vectors, averaged over the whole text and classified by a softmax layer; all
of it is learned by numpy stochastic gradient descent from at most ``SAMPLE`` labelled ids of each class (sampling.py
has the bound in bytes).  A word that repeats the one before it also counts as the pseudo-word REPEAT, as runs of one word
are otherwise like any text of that word.  A trained model is linear in the average, so scoring needs one number a bucket:
the table goes out with the tasks (256 KiB).

Defined cases: null and empty texts score the model's bias; without rows of both classes every score is the share of
label 1, kept within 0.01 to 0.99 (0.5 without labels); null labels are never learned from; repeated rows score alike; an
empty table gives no scores; other columns stay, and one that has the score's name is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kvlog.llm.bytegrams import SPACE, Texts, give_back, groups, lean
from kvlog.llm.sampling import held_out, labelled_sample
from kvlog.llm.common import ship, table

SAMPLE = 2000
BUCKETS_LOG2, DIM, EPOCHS, RATE = 16, 16, 6, 0.5
GRAMS = (3, 4)
THRESHOLD = 0.3
#: Bucket of the pseudo-word "same as the word before".
REPEAT = 0


def _features(t: Texts) -> list[tuple[np.ndarray, np.ndarray]]:
    """(bucket, share bounds by text) for words and each n-gram size."""
    shift = np.uint64(64 - BUCKETS_LOG2)
    t.split(SPACE)
    words = t.word_hashes()
    again = np.flatnonzero(words[1:] == words[:-1]) + 1  # a word that repeats the one before it counts as one more word
    out = [((words >> shift).astype(np.int64), t.first), (np.full(len(again), REPEAT), np.searchsorted(again, t.first))]
    for n in GRAMS:
        at, h = t.grams(n)
        out.append(((h >> shift).astype(np.int64), t.owner(at)))
    return out


def train(texts: list[bytes], labels: list[int], shares: list[float], seed: int = 7) -> dict:
    """Table of one number a bucket and a bias: P(1) = 1 / (1 + exp(-(mean over features + bias)))."""
    if len(set(labels)) < 2:
        p = min(max(shares[1], 0.01), 0.99)
        return {"table": np.zeros(1 << BUCKETS_LOG2, dtype=np.float32), "bias": float(np.log(p / (1 - p)))}
    rows = []
    for at in range(0, len(texts), 64):
        part = texts[at : at + 64]
        found = _features(Texts(part))
        for i in range(len(part)):
            ids, n = np.unique(np.concatenate([f[b[i] : b[i + 1]] for f, b in found]), return_counts=True)
            rows.append((ids, (n / max(n.sum(), 1)).astype(np.float32)))
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1 / DIM, 1 / DIM, (1 << BUCKETS_LOG2, DIM)).astype(np.float32)
    out, bias = np.zeros((2, DIM), dtype=np.float32), np.zeros(2, dtype=np.float32)
    y = np.array(labels)
    weight = np.array([shares[c] / max(np.mean(y == c), 1e-9) for c in (0, 1)])
    steps, total = 0, EPOCHS * len(rows)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            ids, share = rows[i]
            rate = RATE * (1 - steps / total) * weight[y[i]]
            steps += 1
            e = emb[ids]
            v = share @ e
            z = out @ v + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = out.T @ p
            out -= rate * np.outer(p, v).astype(np.float32) * 4
            bias -= (rate * p * 0.1).astype(np.float32)
            # the gradient of an average reaches each vector scaled by its share; rescaled so that rare features move too
            emb[ids] = e - (rate * 8 * np.sqrt(share)[:, None] * back[None, :]).astype(np.float32)
    return {"table": (emb @ (out[1] - out[0])).astype(np.float32), "bias": float(bias[1] - bias[0])}


def score(texts: pa.Array, model: dict) -> np.ndarray:
    out = np.zeros(len(texts))
    for begin, part in groups(texts):
        t = Texts(part)
        total, n = np.zeros(t.n), np.zeros(t.n)
        for ids, bounds in _features(t):
            run = np.concatenate(([0.0], np.cumsum(model["table"][ids], dtype=np.float64)))
            total += run[bounds[1:]] - run[bounds[:-1]]
            n += bounds[1:] - bounds[:-1]
        out[begin : begin + t.n] = total / np.maximum(n, 1) + model["bias"]
    return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def with_scores(docs: DataFrame, scorer, column: str, text: str = "text") -> DataFrame:
    """All columns of docs, then the double ``column``: scorer(Arrow array of texts) of each row."""
    ship(docs.sparkSession)
    docs = docs.select(*["`" + c.replace("`", "``") + "`" for c in docs.columns if c != column])
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = pa.array(scorer(batch.column(place)), type=pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, got], names=[*batch.schema.names, column])

    return docs.mapInArrow(lean(run), T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())]))


def quality_model(docs: DataFrame, labels: DataFrame) -> dict:
    model = train(*labelled_sample(docs, labels, "quality", SAMPLE))
    give_back()
    return model


def op3_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_model(docs, table(spark, sf_dir, "labels"))
    scored = with_scores(docs.select("doc_id", "text"), lambda texts: score(texts, model), "score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
