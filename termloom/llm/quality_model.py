"""A supervised subword classifier of text quality.

Hashed words, word pairs and character n-grams each have a learned vector. A document is the mean
vector of its words plus that of its n-grams; softmax of a linear map gives the classes. Vectors and map
are trained together by stochastic gradient descent in numpy, one document a step, in one task, on
at most ``SAMPLE`` labelled documents (those with the least hash of their id; whole texts). Words that
repeat the word before, a line or a window of five words of the same text carry a mark of their own.
For two classes the output is linear in the vectors, so scoring needs one number for each bucket.

Defined cases: a null text is empty and gets the score of the bias; labels that are null are not learned;
without any label of one class the score is the share of label 1 (0.5 with none). Rows are scored one by
one, so repeated rows, ties and extra columns have no effect.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from termloom.llm.common import chosen, ship

ship(__name__)

SAMPLE = 4000
BITS = 16
SIZE = 12
ROUNDS = 6
RATE = 3.0
GRAMS = (2, 3, 4)
BLOCK = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xD6E8FEB86659FD93)


def _bucket(values: np.ndarray, salt: int) -> np.ndarray:
    mixed = (values + np.uint64(salt)) * _Q
    return ((mixed ^ (mixed >> np.uint64(32))) * _P >> np.uint64(64 - BITS)).astype(np.int64)


def word_features(raw: bytes) -> np.ndarray:
    """Buckets of words, word pairs and marks of repetition."""
    words = raw.split()
    if not words:
        return np.empty(0, np.int64)
    hashes = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    out = [_bucket(hashes, 1), _bucket(hashes[:-1] * _P + hashes[1:], 2)]
    same = int((hashes[1:] == hashes[:-1]).sum())
    marks = [np.full(same, 3)]
    if len(hashes) > 5:
        windows = hashes[:-4]
        for k in range(1, 5):
            windows = windows * _P + hashes[k : len(hashes) - 4 + k]
        marks.append(np.full(len(windows) - len(np.unique(windows)), 4))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    if len(set(lines)) < len(lines):
        seen: set[bytes] = set()
        again = 0
        for x in lines:
            again += len(x.split()) if x in seen else 0
            seen.add(x)
        marks.append(np.full(again, 5))
    return np.concatenate([*out, *(_bucket(m.astype(np.uint64), 99) for m in marks)])


def gram_features(text: str) -> Iterator[np.ndarray]:
    """Buckets of the character n-grams, in blocks of a long text."""
    width = max(GRAMS) - 1
    for at in range(0, max(len(text), 1), BLOCK):
        codes = np.frombuffer(text[at : at + BLOCK + width].encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        rolled = codes
        for n in range(2, max(GRAMS) + 1):
            rolled = rolled[:-1] * _P + codes[n - 1 :]
            if n in GRAMS and len(rolled):
                yield _bucket(rolled[:BLOCK], 10 + n)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, weights) of a text; the words' weights add up to one, and so do the n-grams'."""
    size = 1 << BITS
    words = np.bincount(word_features(text.encode("utf-8", "surrogatepass")), minlength=size).astype(np.float64)
    grams = np.zeros(size)
    for some in gram_features(text):
        grams += np.bincount(some, minlength=size)
    total = words / max(words.sum(), 1) + grams / max(grams.sum(), 1)
    at = np.flatnonzero(total)
    return at, total[at].astype(np.float32)


def train(texts: list[str], labels: np.ndarray) -> tuple[np.ndarray, float]:
    """(score of each bucket, bias): label 1 against label 0."""
    order = np.random.default_rng(11)
    size = 1 << BITS
    share = float(np.mean(labels)) if len(labels) else 0.5
    if share in (0.0, 1.0) or not len(labels):
        share = min(max(share, 1e-6), 1 - 1e-6)
        return np.zeros(size, np.float32), float(np.log(share / (1 - share)))
    vectors = order.uniform(-1 / SIZE, 1 / SIZE, (size, SIZE)).astype(np.float32)
    out, bias = np.zeros((SIZE, 2), np.float32), np.log([1 - share, share]).astype(np.float32)
    bags = [features(t) for t in texts]
    steps, step = ROUNDS * len(bags), 0
    for _ in range(ROUNDS):
        for i in order.permutation(len(bags)):
            rate = RATE * (1 - step / steps)
            step += 1
            at, weight = bags[i]
            held = vectors[at]
            mean = weight @ held
            logits = mean @ out + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = out @ p
            out -= rate * 0.1 * np.outer(mean, p)
            bias -= rate * 0.01 * p
            vectors[at] = held - rate * np.outer(weight, back)
    turn = out[:, 1] - out[:, 0]
    return (vectors @ turn).astype(np.float32), float(bias[1] - bias[0])


def _fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows = pd.concat([pd.DataFrame({"text": [], "label": []}), *batches]).sort_values(["label", "text"])
    scores, bias = train(rows["text"].tolist(), rows["label"].to_numpy(np.int64))
    yield pd.DataFrame({"scores": [scores.tobytes()], "bias": [bias]})


def fit(docs: DataFrame, labels: DataFrame, label: str, learn: Column, sample: int = SAMPLE) -> tuple[bytes, float]:
    """Train on rows of ``labels`` for which ``learn`` holds: at most ``sample`` rows, one for each id (the least text
    if rows of an id differ)."""
    ids = chosen(labels, label, learn, sample)
    rows = (
        docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("id"))
        .groupBy("id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).select("text", "label")  # one row an id
    )
    model = rows.repartition(1).mapInPandas(_fit, "scores binary, bias double").first()
    if model is None:
        scores, bias = train([], np.empty(0, np.int64))
        return scores.tobytes(), bias
    return bytes(model["scores"]), model["bias"]


def _scored(model: bytes, bias: float):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(model, np.float32)
        for batch in batches:
            out = []
            for value in batch.column(1):
                text = value.as_py() or ""
                words = word_features(text.encode("utf-8", "surrogatepass"))
                total, n = 0.0, 0
                for some in gram_features(text):
                    total += float(table[some].sum(dtype=np.float64))
                    n += len(some)
                z = bias + (float(table[words].mean(dtype=np.float64)) if len(words) else 0) + (total / n if n else 0)
                out.append(1 / (1 + np.exp(-z)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], ["doc_id", "score"])

    return score


def scored(docs: DataFrame, model: tuple[bytes, float]) -> DataFrame:
    """(doc_id, score) of every row."""
    schema = StructType([docs.schema["doc_id"]]).add("score", DoubleType())
    return docs.select("doc_id", "text").mapInArrow(_scored(*model), schema)
