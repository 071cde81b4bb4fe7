"""Packing documents into sequences by exact-complement hashing, then best fit.

Texts become token ids in Arrow batches; longer ones than a sequence are cut into full pieces and a
rest. Only the histogram of piece lengths (at most ``capacity`` numbers) is planned, on the driver:
from the longest length down, the gap that a piece leaves is looked up among single, pair and triple
sums of the lengths that are still available, and a combination that fills it exactly is taken as
often as all its lengths last. Lengths without an exact complement are packed by best fit, again in bulk.
The plan is a list of patterns with a number of sequences for each; every step uses up a length or a
kind of gap, so it has a few patterns for each length, whatever the number of documents.

Pieces find their place by their rank among the pieces of their length. Ranks are counted in hash
buckets of about ``bucket_rows`` pieces, so no task sorts a length as a whole.

Defined cases: a null text is empty and gives the end id alone; equal rows are documents of their own;
an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termloom.llm.common import ship, text_groups
from termloom.session import checkpointed

ship(__name__)

CAPACITY = 4096
END_ID = 1
BUCKET_ROWS = 1000
#: The number of a piece's row.
ROW = "_row"
#: Words whose ids a worker keeps.
CACHED_WORDS = 300_000
#: Characters that a worker encodes together.
GROUP = 1 << 20

# The tokenizer's own steps for texts of plain characters: lower case, these pieces, each by itself.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff]*")
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^\sa-z0-9\xdf-\xf6\xf8-\xff]+")


class Encoder:
    """Texts to ids (little-endian, 32 bits each).

    Texts made of ASCII and Latin letters are cut into the tokenizer's pieces here, and the distinct
    pieces of a group of texts that are not yet known are encoded together, with spaces between;
    the tokens that end a word tell them apart. Other texts, and those that name a special token,
    go to the tokenizer as a whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        words = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(words.values()) + 1, bool)
        self.ends[[i for t, i in words.items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, pieces: list[str]) -> None:
        blocks = [pieces[i : i + 1000] for i in range(0, len(pieces), 1000)]
        encoded = self.tokenizer.encode_batch_fast([" ".join(b) for b in blocks], add_special_tokens=False)
        for block, found in zip(blocks, encoded):
            ids = np.array(found.ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(block):
                flat, starts = ids.tobytes(), [0, *(4 * ends[:-1]).tolist()]
                self.known.update((w, flat[s:e]) for w, s, e in zip(block, starts, (4 * ends).tolist()))
            else:
                self.known.update((w, self.whole(w)) for w in block)

    def ids(self, texts: list[str]) -> list[bytes]:
        known, plain = self.known, []
        for text in texts:
            own = _PLAIN.fullmatch(text) is not None and not any(t in text for t in self.special)
            plain.append(_PIECES.findall(text.lower()) if own else None)
        fresh = [w for w in set().union(*filter(None, plain)) if w not in known]
        self.learn(fresh)
        out = [self.whole(t) if p is None else b"".join(map(known.__getitem__, p)) for t, p in zip(texts, plain)]
        if len(known) > CACHED_WORDS:
            for word in fresh:
                del known[word]
        return out


_ENCODERS: dict[str, Encoder] = {}


def _pieces(path: str, capacity: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path not in _ENCODERS:
            _ENCODERS[path] = Encoder(path)
        encoder = _ENCODERS[path]
        for batch in batches:
            at, piece, start, length, crc, i = [], [], [], [], [], -1
            for texts in text_groups(batch.column(1), GROUP):
                for ids in encoder.ids(texts):
                    i += 1
                    ids += end
                    for k, s in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[s : s + 4 * capacity]
                        at.append(i)
                        piece.append(k)
                        start.append(s // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return cut


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of all pieces."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        _pieces(tokenizer, capacity, end_id), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    )


def exact_complement(left: np.ndarray, gap: int) -> tuple[int, ...] | None:
    """One, two or three available lengths that sum to ``gap``; the longest first, as few as can be.

    ``left[i]`` pieces of length i are available; a length is used no more often than that.
    """
    if gap < len(left) and left[gap] > 0:
        return (gap,)
    there = left > 0
    pair = _pair(left, there, gap, gap - 1)
    if pair:
        return pair
    for a in np.flatnonzero(there[: gap - 1])[::-1].tolist():
        left[a] -= 1
        there[a] = left[a] > 0
        pair = _pair(left, there, gap - a, a)
        left[a] += 1
        there[a] = True
        if pair:
            return (a, *pair)
    return None


def _pair(left: np.ndarray, there: np.ndarray, total: int, most: int) -> tuple[int, int] | None:
    """a >= b, a + b = total, a <= most; the pair with the longest a."""
    low, high = (total + 1) // 2, min(most, total - 1)
    if high < low:
        return None
    fits = there[low : high + 1] & there[total - high : total - low + 1][::-1]
    if 2 * low == total and left[low] < 2:
        fits[0] = False
    found = np.flatnonzero(fits)
    if not len(found):
        return None
    a = low + int(found[-1])
    return a, total - a


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths that share a sequence) and how many sequences take each."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] += n
    patterns: list[tuple[tuple[int, ...], int]] = []
    if left[capacity]:
        patterns.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    for length in range(capacity - 1, 0, -1):
        while left[length] > 0:
            left[length] -= 1
            rest = exact_complement(left, capacity - length)
            left[length] += 1
            if rest is None:
                break
            used = (length, *rest)
            times = min(int(left[x]) // used.count(x) for x in set(used))
            for x in used:
                left[x] -= times
            patterns.append((used, times))
    # residuals: best fit in decreasing order, all sequences with one content at once
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length in range(capacity - 1, 0, -1):
        n = int(left[length])
        while n > 0:
            gap = min((g for g in open_ if g >= length), default=None)
            if gap is None:
                each = min(capacity // length, n)
                held, times = (length,) * each, n // each
                n -= each * times
                room = capacity - each * length
            else:
                content, there = open_[gap].pop()
                each = min(gap // length, n)
                times = min(there, n // each)
                if there > times:
                    open_[gap].append((content, there - times))
                if not open_[gap]:
                    del open_[gap]
                held = content + (length,) * each
                n -= each * times
                room = gap - each * length
            open_.setdefault(room, []).append((held, times))
    for some in open_.values():
        patterns += some
    return patterns


def places(patterns: list[tuple[tuple[int, ...], int]]) -> pd.DataFrame:
    """(length, first, n, sequence, offset, step): ranks first..first+n-1 of a length and where they go.

    Rank first + i stands in sequence ``sequence + i`` at ``offset``.
    """
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for held, times in patterns:
        offset = 0
        for length in held:
            first = used.get(length, 0)
            rows.append((length, first, times, sequence, offset))
            used[length] = first + times
            offset += length
        sequence += times
    return pd.DataFrame(rows, columns=["length", "first", "n", "sequence", "offset"]).sort_values(["length", "first"])


def _placed(where: pd.DataFrame):
    slots = {
        length: tuple(g[c].to_numpy(np.int64) for c in ("first", "sequence", "offset"))
        for length, g in where.groupby("length")
    }

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rank = batch["rank"].to_numpy(np.int64)
            lengths = batch["length"].to_numpy(np.int64)
            sequence, offset = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for length in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == length)
                first, sequences, offsets = slots[length]
                slot = np.searchsorted(first, rank[at], "right") - 1
                sequence[at] = sequences[slot] + rank[at] - first[slot]
                offset[at] = offsets[slot]
            yield batch.drop(columns=["rank"]).assign(sequence_id=sequence, offset=offset)

    return put


def ranked(parts: DataFrame, counts: dict[int, int], bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Adds ``rank``, from 0 within each length; ``parts`` is a written table, ``counts`` its lengths.

    ``parts`` has a number for each row, so that repeated rows are dealt out like others. A length has one bucket for every ``bucket_rows`` of its pieces, so tasks stay even at any size.
    """
    spark = parts.sparkSession
    # at most ``capacity`` rows
    widths = spark.createDataFrame([(n, -(-c // bucket_rows)) for n, c in counts.items()], "length long, _n long")
    bucket = F.pmod(F.xxhash64(ROW), F.col("_n"))
    dealt = parts.join(F.broadcast(widths), "length").withColumn("_b", bucket).drop("_n")
    sizes = dealt.groupBy("length", "_b").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_from", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = Window.partitionBy("length", "_b").orderBy(ROW)
    return (
        dealt.withColumn("_i", F.row_number().over(inside) - 1)
        .join(starts, ["length", "_b"])
        .withColumn("rank", F.col("_from") + F.col("_i"))
        .drop("_b", "_i", "_from", ROW)
    )


def packed(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of all pieces."""
    parts = checkpointed(pieces(docs, tokenizer, capacity, end_id).withColumn(ROW, F.monotonically_increasing_id()))
    counts = {r[0]: r[1] for r in parts.groupBy("length").count().collect()}  # at most ``capacity`` rows
    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return ranked(parts, counts).select(*columns, "rank").mapInPandas(
        _placed(places(plan(counts, capacity))),
        f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )
