"""Line dedup: a sharded minimal perfect hash over the distinct hashes of repeated lines.

A line's key is the line without blanks at its ends and with A-Z lowered; keys of at least ``SHORTEST`` code points
count. Distinct (key, document) pairs are aggregated to documents and largest doc_id by key. The keys found in at
least ``COPIES`` documents (no other can lose a line) are dealt to shards by their hash. Each shard gets a minimal
perfect hash by levels: every key still without a place sets a bit of the level's array, bits set once are final, and the keys
that collide go to the next level; the number of bits set before a key's bit is its index. There it has a fingerprint
of 64 other bits, its count and the largest doc_id holding it, in plain arrays: about 21 bytes a key.

Documents probe these arrays, lines are never joined. Arrays that together stay within ``BROADCAST_BYTES`` (their
size is known from the number of keys) are sent to all tasks, and texts are rewritten where they are read. Beyond it, the hashes of a
document's lines travel to the shards, of which each can be held by several tasks: a shard is repeated by the number of its
probes, which are counted first, so a line in a third of all documents is spread. Only numbers of dropped lines come back.

Defined cases: a null or empty text is one empty line; rows that share a doc_id are one document, in the count and as the one that
keeps its lines; rows without a doc_id are together one document that never keeps a line; doc_id is an integer.
Extra columns stay as they are, but for those named like the two new ones, which are replaced. Keys are told
apart by 128 bits of hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import BLANKS, ship
from termloom.session import checkpointed

ship(__name__)

SHORTEST = 20
COPIES = 3
#: Keys of a shard, bits of a level for each key, and levels (each leaves fewer than half of the keys).
SHARD_KEYS = 1 << 15
BITS_A_KEY = 2
MOST_LEVELS = 64
BYTES_A_KEY = 21
BROADCAST_BYTES = 48 << 20
#: Probes that one task of a shard takes.
PROBES = 1 << 20
#: Lines in one batch that a task sends on.
LINES = 1 << 15


def line_hash(line: str, shortest: int = SHORTEST) -> bytes | None:
    """16 bytes for the line's key, or None if the key is too short to count."""
    key = line.strip(BLANKS)
    if len(key) < shortest:
        return None
    return xxhash.xxh3_128_digest(key.encode("utf-8", "surrogatepass").lower())


def hashes_of(lines: list[str], shortest: int = SHORTEST) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the lines that count, and their hashes as rows of two integers."""
    some = [(i, h) for i, line in enumerate(lines) if (h := line_hash(line, shortest)) is not None]
    at = np.fromiter((i for i, _ in some), np.int64, len(some))
    return at, np.frombuffer(b"".join(h for _, h in some), "<i8").reshape(-1, 2)


# ---- the perfect hash


def mixed(keys: np.ndarray, level: int) -> np.ndarray:
    """A hash of each key (two integers) for a level."""
    a, b = keys[:, 0].view(np.uint64), keys[:, 1].view(np.uint64)
    x = a ^ (b * np.uint64(0x9E3779B97F4A7C15) + np.uint64((level * 0xD1B54A32D192ED03) % (1 << 64)))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """``index``: keys of the set to 0 .. n - 1, each once; any other key to some index or -1."""

    def __init__(self, words: list[np.ndarray]):
        self.words = words
        counts = np.concatenate([np.zeros(1, np.int64), *(np.bitwise_count(w).astype(np.int64) for w in words)])
        before = np.cumsum(counts)
        starts = np.cumsum([0] + [len(w) for w in words])
        self.before = [before[s : s + len(w)] for s, w in zip(starts, words)]

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        words = []
        while len(keys):
            if len(words) == MOST_LEVELS:
                raise ValueError("keys are not distinct")
            size = -(-len(keys) * BITS_A_KEY // 64) * 64
            at = mixed(keys, len(words)) % np.uint64(size)
            count = np.bincount(at.astype(np.int64), minlength=size)
            words.append(np.packbits(count == 1, bitorder="little").view("<u8"))
            keys = keys[count[at.astype(np.int64)] > 1]
        return cls(words)

    def index(self, keys: np.ndarray) -> np.ndarray:
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (words, before) in enumerate(zip(self.words, self.before)):
            if not len(left):
                break
            at = mixed(keys[left], level) % np.uint64(len(words) * 64)
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            held = words[word]
            found = (held >> bit) & np.uint64(1) == 1
            below = held & ((np.uint64(1) << bit) - np.uint64(1))
            out[left[found]] = before[word[found]] + np.bitwise_count(below[found])
            left = left[~found]
        return out


SHARD = "shard int, levels array<int>, bits binary, prints binary, counts binary, owners binary"


def shard_row(shard: int, keys: np.ndarray, counts: np.ndarray, owners: np.ndarray) -> dict:
    """A shard as plain arrays. ``keys`` are distinct rows of two integers."""
    hashed = PerfectHash.build(keys)
    at = hashed.index(keys)
    prints, n, owner = np.zeros(len(keys), "<i8"), np.zeros(len(keys), "<u4"), np.zeros(len(keys), "<i8")
    prints[at], n[at], owner[at] = keys[:, 1], np.minimum(counts, (1 << 32) - 1), owners
    return {
        "shard": shard, "levels": [len(w) for w in hashed.words], "bits": b"".join(w.tobytes() for w in hashed.words),
        "prints": prints.tobytes(), "counts": n.tobytes(), "owners": owner.tobytes(),
    }


class Shard:
    """A shard read back from its arrays."""

    def __init__(self, levels, bits: bytes, prints: bytes, counts: bytes, owners: bytes):
        words = np.frombuffer(bits, "<u8")
        self.hash = PerfectHash(np.split(words, np.cumsum(levels)[:-1]))
        self.prints, self.counts, self.owners = (np.frombuffer(x, t) for x, t in ((prints, "<i8"), (counts, "<u4"), (owners, "<i8")))

    def dropped(self, keys: np.ndarray, ids: np.ndarray, nameless: np.ndarray, copies: int) -> np.ndarray:
        """Which keys are found in ``copies`` documents and are not held by their last one."""
        at = self.hash.index(keys)
        known = at >= 0
        known[known] = self.prints[at[known]] == keys[known, 1]
        out = np.zeros(len(keys), bool)
        at = at[known]
        out[known] = (self.counts[at] >= copies) & ((self.owners[at] != ids[known]) | nameless[known])
        return out


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (keys[:, 0].view(np.uint64) % np.uint64(shards)).astype(np.int64)


# ---- Spark


def _held(shortest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(a, b, doc_id): the distinct keys of each document."""
        def sent(keys, ids, sizes):
            at = np.concatenate(keys)
            return pa.RecordBatch.from_arrays(
                [pa.array(at[:, 0]), pa.array(at[:, 1]), pa.array(ids, pa.int64()).take(pa.array(np.repeat(np.arange(len(ids)), sizes)))],
                ["a", "b", "doc_id"],
            )

        for batch in batches:
            keys, ids, sizes, n = [], [], [], 0
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                _, found = hashes_of((text.as_py() or "").split("\n"), shortest)
                found = np.unique(found, axis=0)
                keys.append(found)
                ids.append(doc_id.as_py())
                sizes.append(len(found))
                n += len(found)
                if n >= LINES:
                    yield sent(keys, ids, sizes)
                    keys, ids, sizes, n = [], [], [], 0
            if n:
                yield sent(keys, ids, sizes)

    return run


def repeated(docs: DataFrame, shortest: int = SHORTEST, copies: int = COPIES) -> DataFrame:
    """(a, b, n, owner): keys in at least ``copies`` documents, how many, and the largest doc_id."""
    pairs = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(_held(shortest), "a bigint, b bigint, doc_id bigint")
    return (
        pairs.groupBy("a", "b", "doc_id").agg(F.lit(1).alias("one"))  # repeated rows are one document
        .groupBy("a", "b").agg(F.count("*").alias("n"), F.max("doc_id").alias("owner")).filter(F.col("n") >= copies)
    )


def _built(rows: pd.DataFrame) -> pd.DataFrame:
    keys = np.ascontiguousarray(rows[["a", "b"]].to_numpy("int64"))
    return pd.DataFrame([shard_row(int(rows["shard"].iloc[0]), keys, rows["n"].to_numpy(), rows["owner"].to_numpy("int64"))])


def unsigned_mod(column: str, n: int):
    """The remainder of the 64 bits of a long, taken as unsigned."""
    high = F.shiftrightunsigned(column, 1) % n
    return ((high * 2 + F.col(column).bitwiseAND(F.lit(1))) % n).cast("int")


def index(keys: DataFrame, shards: int) -> DataFrame:
    """The shards' arrays, one row for each shard that has keys."""
    return keys.withColumn("shard", unsigned_mod("a", shards)).groupBy("shard").applyInPandas(_built, SHARD)


class Index:
    """All shards in one process."""

    def __init__(self, rows: list[tuple], shards: int):
        self.shards, self.by_shard = shards, {r[0]: Shard(*r[1:]) for r in rows}

    def dropped(self, keys: np.ndarray, ids: np.ndarray, nameless: np.ndarray, copies: int) -> np.ndarray:
        out, shard = np.zeros(len(keys), bool), shard_of(keys, self.shards)
        for s in np.unique(shard):
            if int(s) in self.by_shard:
                at = np.flatnonzero(shard == s)
                out[at] = self.by_shard[int(s)].dropped(keys[at], ids[at], nameless[at], copies)
        return out


def without(text: str, dropped: np.ndarray) -> tuple[str, int]:
    """The text without some of its lines, by number, and how many lines it had."""
    lines = text.split("\n")
    gone = set(dropped.tolist())
    return ("\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else text), len(lines)


def _rewritten(sent, shortest: int, copies: int):
    """Probe the arrays for every document of a batch and write its text anew."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Index(*sent.value)
        for batch in batches:
            ids = batch.column("_line_id")
            texts, n_lines, n_dropped = [], [], []
            for doc_id, text in zip(ids, batch.column("text")):
                text, doc_id = text.as_py() or "", doc_id.as_py()
                at, keys = hashes_of(text.split("\n"), shortest)
                gone = held.dropped(keys, np.full(len(at), doc_id or 0), np.full(len(at), doc_id is None), copies)
                kept, n = without(text, at[gone])
                texts.append(kept)
                n_lines.append(n)
                n_dropped.append(int(gone.sum()))
            yield _with(batch, texts, n_lines, n_dropped)

    return run


def _with(batch: pa.RecordBatch, texts, n_lines, n_dropped) -> pa.RecordBatch:
    names = [n for n in batch.schema.names if not n.startswith("_line_")]
    columns = [pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in names]
    return pa.RecordBatch.from_arrays(
        [*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], [*names, "line_count", "dropped_lines"]
    )


def _probes(shortest: int, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(shard, a, b, at, doc_id, row): every line that counts."""
        for batch in batches:
            for doc_id, row, text in zip(*(batch.column(k) for k in range(3))):
                at, keys = hashes_of((text.as_py() or "").split("\n"), shortest)
                for k in range(0, len(at), LINES):
                    some, n = keys[k : k + LINES], len(at[k : k + LINES])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(shard_of(some, shards).astype(np.int32)), pa.array(some[:, 0]), pa.array(some[:, 1]),
                            pa.array(at[k : k + LINES]), pa.array([doc_id.as_py()] * n, pa.int64()), pa.array([row.as_py()] * n, pa.string()),
                        ],
                        ["shard", "a", "b", "at", "doc_id", "row"],
                    )

    return run


def _found(copies: int):
    def run(probes: pd.DataFrame, arrays: pd.DataFrame) -> pd.DataFrame:
        if not len(probes) or not len(arrays):
            return pd.DataFrame({"row": [], "at": []})
        r = arrays.iloc[0]
        keys = np.ascontiguousarray(probes[["a", "b"]].to_numpy("int64"))
        nameless = probes["doc_id"].isna().to_numpy()
        ids = probes["doc_id"].fillna(0).to_numpy("int64")
        gone = Shard(r["levels"], r["bits"], r["prints"], r["counts"], r["owners"]).dropped(keys, ids, nameless, copies)
        return probes.loc[gone, ["row", "at"]]

    return run


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        some = [without(t.as_py() or "", np.array(at.as_py() or [], np.int64)) for t, at in zip(batch.column("text"), batch.column("_line_at"))]
        yield _with(batch, [x for x, _ in some], [n for _, n in some], [len(at.as_py() or []) for at in batch.column("_line_at")])


def deduplicated(
    docs: DataFrame, shortest: int = SHORTEST, copies: int = COPIES, broadcast_bytes: int = BROADCAST_BYTES, probes: int = PROBES
) -> DataFrame:
    """``docs`` with repeated lines only in the largest doc_id that holds them, ``line_count`` (before) and ``dropped_lines``."""
    columns = [c for c in docs.columns if c not in ("line_count", "dropped_lines") and not c.startswith("_line_")]
    spark, docs = docs.sparkSession, docs.select(*columns)
    keys = checkpointed(repeated(docs, shortest, copies))
    n = keys.count()
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", line_count bigint, dropped_lines bigint"
    shards = max(1, -(-n // SHARD_KEYS))
    arrays = index(keys, shards)
    if n * BYTES_A_KEY <= broadcast_bytes:
        sent = spark.sparkContext.broadcast(([tuple(r) for r in arrays.collect()], shards))
        with_id = docs.withColumn("_line_id", F.col("doc_id").cast("bigint"))
        return with_id.mapInArrow(_rewritten(sent, shortest, copies), schema)
    arrays = checkpointed(arrays)
    # a document's row is named by its id and two hashes of its text: rows equal in these have equal results
    text = F.coalesce("text", F.lit(""))
    row = F.concat_ws(":", F.col("doc_id").cast("string"), F.xxhash64(text), F.md5(text))
    sent_on = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), row.alias("row"), "text").mapInArrow(
        _probes(shortest, shards), "shard int, a bigint, b bigint, at bigint, doc_id bigint, row string"
    )
    lines = checkpointed(sent_on)
    parts = checkpointed(lines.groupBy("shard").agg((F.floor(F.count("*") / probes) + 1).cast("int").alias("parts")))
    dealt = lines.join(parts, "shard").withColumn("part", F.pmod(F.xxhash64("row", "at"), F.col("parts")).cast("int")).drop("parts")
    spread = arrays.join(parts, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    gone = dealt.groupBy("shard", "part").cogroup(spread.groupBy("shard", "part")).applyInPandas(_found(copies), "row string, at bigint")
    listed = checkpointed(gone.groupBy(F.col("row").alias("_line_row")).agg(F.collect_set("at").alias("_line_at")))
    joined = docs.withColumn("_line_row", row).join(listed, "_line_row", "left")
    return joined.select(*columns, "_line_at").mapInArrow(_applied, schema)
