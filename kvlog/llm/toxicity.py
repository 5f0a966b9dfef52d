"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A feature is the presence of a hashed n-gram (lower-cased A-Z, white space as one character, so word ends count) in the
text, its value the smoothed log ratio of the n-gram's shares among toxic and other texts.  N-grams of fewer than
MIN_TEXTS sampled texts, or whose ratio is under MIN_Z standard errors, are left out; all others (at most 2**BUCKETS_LOG2)
get weights by L2-regularised logistic regression.  Learned from at most ``SAMPLE`` labelled ids of each class
(sampling.py has the bound in bytes); the weights go out with the tasks, and a task's lookup table holds 4 MiB.

Defined cases: null and empty texts score the bias; without rows of both classes every score is label 1's share, kept
within 0.01 to 0.99 (0.5 without labels); null labels are never learned from; repeated rows score alike; an empty table
gives no scores; other columns stay (``with_scores``), and one that has the score's name is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvlog.llm.bytegrams import Texts, groups
from kvlog.llm.common import table
from kvlog.llm.quality import with_scores
from kvlog.llm.sampling import held_out, labelled_sample

SAMPLE = 2500
BUCKETS_LOG2 = 20
GRAMS = (4, 5, 6)
MIN_TEXTS, MIN_Z = 4, 3.0
THRESHOLD = 0.5
L2, STEPS = 1.0, 200


def _grams(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    t = Texts(texts, lower=True)
    out = []
    for n in GRAMS:
        at, h = t.grams(n)
        out.append(((h >> np.uint64(64 - BUCKETS_LOG2)).astype(np.int32), t.owner(at)))
    return out


def train(texts: list[bytes], labels: list[int], shares: list[float]) -> dict:
    if len(set(labels)) < 2:
        p = min(max(shares[1], 0.01), 0.99)
        return {"ids": np.zeros(0, dtype=np.int32), "weights": np.zeros(0), "bias": float(np.log(p / (1 - p)))}
    y = np.array(labels)
    rows = []
    counts = np.zeros((2, 1 << BUCKETS_LOG2), dtype=np.int32)
    for at in range(0, len(texts), 64):
        part = texts[at : at + 64]
        found = _grams(part)
        for i in range(len(part)):
            ids = np.unique(np.concatenate([f[b[i] : b[i + 1]] for f, b in found]))
            counts[y[at + i], ids] += 1
            rows.append(ids)
    n = np.array([np.sum(y == 0), np.sum(y == 1)])
    share = (counts + 0.5) / (n[:, None] + 1)
    ratio = np.log(share[1] / share[0])
    both = counts.sum(0)
    z = np.abs(ratio) / np.sqrt((1 / (counts + 0.5)).sum(0))
    chosen = np.flatnonzero((both >= MIN_TEXTS) & (z >= MIN_Z))
    col = np.full(1 << BUCKETS_LOG2, -1, dtype=np.int32)
    col[chosen] = np.arange(len(chosen))
    row_of, col_of = [], []
    for i, ids in enumerate(rows):
        c = col[ids]
        c = c[c >= 0]
        row_of.append(np.full(len(c), i))
        col_of.append(c)
    ri, ci = np.concatenate(row_of), np.concatenate(col_of)
    r = ratio[chosen]
    value = r[ci]
    weight = np.array([shares[c] / (n[c] / len(y)) for c in (0, 1)])[y] / len(y)
    w, b = np.zeros(len(chosen)), 0.0
    m, v, k = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1), 0
    for _ in range(STEPS):  # full-batch Adam: the problem is convex and small
        s = np.bincount(ri, weights=w[ci] * value, minlength=len(y)) + b
        d = weight * (1 / (1 + np.exp(-s)) - y)
        g = np.append(np.bincount(ci, weights=d[ri] * value, minlength=len(w)) + L2 * w / len(y), d.sum())
        k += 1
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.05 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return {"ids": chosen.astype(np.int32), "weights": w * r, "bias": float(b)}


def score(texts: pa.Array, model: dict) -> np.ndarray:
    col = np.full(1 << BUCKETS_LOG2, -1, dtype=np.int32)
    col[model["ids"]] = np.arange(len(model["ids"]))
    weights, k = model["weights"], max(1, len(model["ids"]))
    out = np.full(len(texts), model["bias"])
    for begin, part in groups(texts):
        pairs = []
        for ids, bounds in _grams(part):
            c = col[ids]
            at = np.flatnonzero(c >= 0)
            doc = np.searchsorted(bounds[1:], at, side="right")
            pairs.append(doc * k + c[at])
        pairs = np.unique(np.concatenate(pairs))
        if len(pairs):
            out[begin : begin + len(part)] += np.bincount(pairs // k, weights=weights[pairs % k], minlength=len(part))
    return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def toxicity_model(docs: DataFrame, labels: DataFrame) -> dict:
    return train(*labelled_sample(docs, labels, "toxic", SAMPLE))


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    scored = with_scores(docs.select("doc_id", "text"), lambda texts: score(texts, model), "score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
