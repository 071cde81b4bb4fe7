"""Toxic passages as maximum-scoring segments of token log-odds.

The tokens of a word (lower case, hashed) are the word and its beginnings. A token's score is its log-odds
between toxic and other labelled texts under a Dirichlet prior in proportion to its frequency, less its
uncertainty and less a drift; a word has the best score of its tokens, and most words score below zero. A linear scan finds all maximal segments of a text. Under such scores the best segment
of a text of n words follows an extreme-value law: lambda solves E exp(lambda s) = 1 over other texts,
K comes from the median of their best segments, and a segment is significant if its expected number,
K n exp(-lambda S), is below one. A document's statistic adds up the logarithms of its significant
segments; a logistic curve, fitted to binned counts of the labelled rows, turns it into a probability.

At most ``SAMPLE`` labelled documents are learned from (those with the least hash of their id; whole
texts), so the list of their ids is small at any size of the input and is broadcast. Only the words that
score above zero (at most one for each of 2^BITS buckets) and the bins come to the driver.

Defined cases: a null text is empty and has no segment; null labels are not learned; with labels of one
class only no word scores; rows are scored one by one, so repeated rows, ties and extra columns have no
effect.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import chosen, ship
from termloom.session import checkpointed

ship(__name__)

SAMPLE = 20_000
BITS = 20
PRIOR = 500.0
#: Added to every token's prior, so that a token unseen in one class is not boundless.
FLOOR = 1.0
CAUTION = 1.5
DRIFT = 1.0
LEAST = 5
EDGE = ".,;:!?()[]{}<>\"'#$%&*|"
BEGINNINGS = (4, 5, 6)
#: Words whose tokens or score a task keeps; the others are worked out each time.
KEPT_WORDS = 200_000


def tokens(word: str) -> list[int]:
    """Buckets of a word and of its beginnings."""
    bare = word.strip(EDGE)
    parts = [f"={bare}", *(f"{n}{bare[:n]}" for n in BEGINNINGS if len(bare) > n)]
    return [zlib.crc32(p.encode("utf-8", "surrogatepass")) & (1 << BITS) - 1 for p in parts]


class Kept(dict):
    """A function's values, kept for the first KEPT_WORDS arguments."""

    def __init__(self, of) -> None:
        super().__init__()
        self.of = of

    def __missing__(self, key):
        value = self.of(key)
        if len(self) < KEPT_WORDS:
            self[key] = value
        return value


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, n0, n1): in how many texts of either label a bucket occurs, per batch."""
    kept = Kept(tokens)
    for batch in batches:
        counts = np.zeros((2, 1 << BITS), np.int64)
        for value, label in zip(batch.column(0), batch.column(1)):
            words = set((value.as_py() or "").lower().split())
            counts[label.as_py()][list({t for w in words for t in kept[w]})] += 1
        at = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(c[at]) for c in counts)], ["bucket", "n0", "n1"])


def word_scores(docs: DataFrame, ids: DataFrame) -> tuple[np.ndarray, np.ndarray, float, float]:
    """(buckets above zero, their scores, lambda, score of every other word)."""
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("id")).select("text", "label")
    counts = checkpointed(
        rows.mapInArrow(_count, "bucket long, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    )
    n0, n1 = (x or 0 for x in counts.agg(F.sum("n0"), F.sum("n1")).first())
    if not n0 or not n1:
        return np.empty(0, np.int64), np.empty(0), 1.0, -DRIFT
    prior = FLOOR + PRIOR * (F.col("n0") + F.col("n1")) / float(n0 + n1)
    a1, a0 = F.col("n1") + prior, F.col("n0") + prior
    odds = F.log(a1 / (n1 + PRIOR - a1)) - F.log(a0 / (n0 + PRIOR - a0))
    score = odds - CAUTION * F.sqrt(1 / a1 + 1 / a0) - DRIFT
    above = (
        counts.withColumn("score", score).filter((F.col("score") > 0) & (F.col("n1") >= LEAST))
        .orderBy("bucket").select("bucket", "score", "n0").toPandas()
    )
    share = above["n0"].to_numpy(np.float64) / n0
    values = above["score"].to_numpy(np.float64)
    low, high = 1e-6, 50.0
    for _ in range(100):  # E exp(lambda s) - 1 changes its sign once above zero
        middle = (low + high) / 2
        grown = (share * np.exp(middle * values)).sum() + (1 - share.sum()) * np.exp(-middle * DRIFT)
        low, high = (middle, high) if grown < 1 else (low, middle)
    return above["bucket"].to_numpy(np.int64), values, low, -DRIFT


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), in linear time.

    Candidates are kept with the sums before and after them; ``link`` names the nearest earlier one
    that begins lower, so each is passed at most once.
    """
    at = np.flatnonzero(scores > 0)
    if not len(at):
        return []
    after = np.cumsum(scores)[at]
    kept: list[list] = []  # start, end, sum before, sum after, link
    for i, b, r in zip(at.tolist(), (after - scores[at]).tolist(), after.tolist()):
        start, before, j = i, b, len(kept) - 1
        while True:
            while j >= 0 and kept[j][2] >= before:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= r:
                break
            start, before = kept[j][0], kept[j][2]
            del kept[j:]
            j -= 1
        kept.append([start, i + 1, before, r, j])
    return [(s, e, r - b) for s, e, b, r, _ in kept]


def _passages(at: np.ndarray, values: np.ndarray, other: float):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.full(1 << BITS, other)
        table[at] = values
        kept = Kept(lambda word: float(table[tokens(word)].max()))
        for batch in batches:
            counts, found = [], []
            for value in batch.column(1):
                words = (value.as_py() or "").lower().split()
                scores = np.fromiter(map(kept.__getitem__, words), np.float64, len(words))
                counts.append(len(words))
                found.append([{"start": s, "end": e, "score": x} for s, e, x in segments(scores)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(found, _SEGMENTS)], ["doc_id", "n", "segments"]
            )

    return scan


_SEGMENTS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def passages(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float, float]) -> DataFrame:
    """(doc_id, n, segments) of every row; segments are word ranges with their scores."""
    kind = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, segments array<struct<start:long,end:long,score:double>>"
    at, values, _, other = model
    return docs.select("doc_id", "text").mapInArrow(_passages(at, values, other), kind)


def logistic(x: np.ndarray, good: np.ndarray, bad: np.ndarray) -> tuple[float, float]:
    """Intercept and slope (not below zero) for weighted counts, by Newton steps with a small ridge."""
    w = np.zeros(2)
    inputs = np.c_[np.ones_like(x), x]
    for _ in range(50):
        p = 1 / (1 + np.exp(-inputs @ w))
        n = good + bad
        slope = inputs.T @ (good - n * p) - 1e-3 * w
        curve = (inputs * (n * p * (1 - p))[:, None]).T @ inputs + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), max(float(w[1]), 0.0)


def scored(docs: DataFrame, labels: DataFrame, label: str, learn: Column, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, score, n_passages, statistic) of every row, learned from the rows ``learn`` allows."""
    ids = checkpointed(chosen(labels, label, learn, sample))
    model = word_scores(docs, ids)
    rate = model[2]
    found = checkpointed(passages(docs, model))
    best = F.coalesce(F.array_max(F.col("segments.score")), F.lit(0.0))
    size = F.log(F.greatest(F.col("n"), F.lit(1)))
    known = found.join(F.broadcast(ids), F.col("doc_id") == F.col("id"))
    middle = known.filter("label = 0").agg(F.percentile_approx(rate * best - size, 0.5, 10_000)).first()[0]
    k = (middle or 0.0) + np.log(np.log(2))  # median of the extreme-value law
    excess = F.transform("segments", lambda s: rate * s["score"] - size - float(k))
    told = found.withColumn("_excess", F.filter(excess, lambda x: x > 0)).select(
        "doc_id",
        F.size("_excess").cast("long").alias("n_passages"),
        F.log1p(F.aggregate("_excess", F.lit(0.0), lambda a, x: a + x)).alias("statistic"),
    )
    bins = (
        told.join(F.broadcast(ids), F.col("doc_id") == F.col("id"))
        .groupBy(F.round("statistic", 1).alias("x"))  # a logarithm of a sum: some hundred values
        .agg(F.sum("label").alias("good"), F.sum(1 - F.col("label")).alias("bad"))
        .orderBy("x").toPandas()
    )
    a, b = logistic(*(bins[c].to_numpy(np.float64) for c in ("x", "good", "bad"))) if len(bins) else (0.0, 0.0)
    return told.select(
        "doc_id", (1 / (1 + F.exp(-(a + b * F.col("statistic"))))).alias("score"), "n_passages", "statistic"
    )
