"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint's bit is set if more than half of the text's shingle hashes (XXH64, seed 42) have it.
For radius r every bit position gets one of the non-zero vectors of r + 1 bits, and table v keeps the
positions whose vector has an odd inner product with v. r differing positions leave some v to which
all their vectors are orthogonal, so each pair within the radius agrees on that table's key: none is
missed. Only distinct fingerprints are compared. Buckets of up to ``most`` fingerprints compare
their members. Fuller ones are not compared pairwise: fingerprints within two bits share a member of
their balls of radius one, so each emits its ball over the positions outside the mask, and those that
meet link to the least of them. Links become components by alternating large and small stars.

Defined cases: a null text is empty, and an empty text has fingerprint zero and links like any other;
rows with a null id link others but never name a component (null if no member has an id); copies share
one fingerprint and are never paired. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import ship
from termloom.session import checkpointed

ship(__name__)

SHINGLE = 3
SEED = 42
RADIUS = 2
#: Buckets with more fingerprints are linked through balls.
MOST = 64
BLOCK = 1 << 14


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The fingerprint as a signed 64-bit integer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # ASCII blanks and letters only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        value = xxhash.xxh64_intdigest(joined, SEED)
        return value - (1 << 64) if value >> 63 else value
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - size + 1].tolist()
    ends = ends[size - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, len(starts), BLOCK):
        some = [digest(joined[s:e], SEED) for s, e in zip(starts[at : at + BLOCK], ends[at : at + BLOCK])]
        bits = np.unpackbits(np.array(some, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32)
    packed = np.packbits(2 * ones > len(starts), bitorder="little")
    return int(packed.view("<i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = pa.array([fingerprint(x.as_py()) for x in batch.column(1)], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), values], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_fingerprints, f"doc_id {kind}, fp bigint")


def masks(radius: int = RADIUS) -> list[int]:
    """One mask of the 64 positions for each table, as signed integers."""
    vectors = (1 << radius + 1) - 1
    out = []
    for v in range(1, vectors + 1):
        mask = sum(1 << i for i in range(64) if (i % vectors + 1 & v).bit_count() % 2)
        out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def ball(fp: Column, mask: int) -> Column:
    """``fp`` and all that differ from it at one position outside the mask."""
    ones = [1 << i for i in range(64) if not mask >> i & 1]
    signed = [x - (1 << 64) if x >> 63 else x for x in ones]
    return F.array(fp, *[fp.bitwiseXOR(F.lit(x)) for x in signed])


def links(fps: DataFrame, radius: int = RADIUS, most: int = MOST) -> DataFrame:
    """(a, b), a < b: pairs of distinct fingerprints that connect all within the radius.

    Buckets of up to ``most`` give each of their pairs within the radius; fuller ones give a star
    around the least of those that share a ball member (radius 2 only), which connects the same ones.
    """
    if radius != 2:
        raise ValueError("balls link fingerprints within two bits")
    tables = F.array(*[
        F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(masks(radius))
    ])
    placed = fps.select("fp", F.explode(tables).alias("x")).select("fp", "x.t", "x.key")
    sizes = placed.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1")
    members = checkpointed(placed.join(sizes, ["t", "key"]))
    few = members.filter(F.col("n") <= most)
    other = few.select("t", "key", F.col("fp").alias("b"))
    near = (
        few.select("t", "key", F.col("fp").alias("a")).join(other, ["t", "key"])
        .filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius))
        .select("a", "b")
    )
    many = members.filter(F.col("n") > most)
    around = F.lit(None).cast("array<bigint>")
    for k, m in enumerate(masks(radius)):
        around = F.when(F.col("t") == k, ball(F.col("fp"), m)).otherwise(around)
    met = many.select("t", "key", "fp", F.explode(around).alias("z"))
    least = met.groupBy("t", "key", "z").agg(F.min("fp").alias("a"), F.count("*").alias("n")).filter("n > 1").drop("n")
    stars = met.join(least, ["t", "key", "z"]).filter(F.col("a") < F.col("fp")).select("a", F.col("fp").alias("b"))
    return near.unionByName(stars).distinct()


def components(pairs: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the least node reachable, for every node of ``pairs``.

    Large star: every greater neighbour of a node links to the least of its neighbourhood. Small star:
    the others do. Each is two aggregates and a join on the node; the links are written after
    every round, and the work ends when a round changes nothing.
    """
    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both if large else both.filter("b < a")
        least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        if large:
            moved = near.filter("b > a").join(least, "a").select(F.col("m"), F.col("b").alias("n"))
        else:
            moved = near.join(least, "a").select(F.col("m"), F.col("b").alias("n"))
            moved = moved.unionByName(least.select("m", F.col("a").alias("n")))
        return moved.filter("m < n").select(F.col("m").alias("a"), F.col("n").alias("b")).distinct()

    def mark(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = checkpointed(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    before = mark(edges)
    for _ in range(rounds):
        edges = checkpointed(star(star(edges, True), False))
        now = mark(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components are not settled after {rounds} rounds")
    nodes = edges.groupBy("b").agg(F.min("a").alias("root")).select(F.col("b").alias("node"), "root")
    return nodes.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def grouped(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of every row."""
    prints = checkpointed(fingerprints(docs))
    distinct = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    return named(prints, distinct, components(links(distinct.select("fp"))))


def named(prints: DataFrame, distinct: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``prints``: the least id of its component in ``found``."""
    rooted = distinct.join(found, distinct.fp == found.node, "left").select(
        "fp", "least_id", F.coalesce("root", "fp").alias("root")
    )
    names = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    by_print = rooted.join(names, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each component: that with the least id; columns as before.

    Rows that share this id are one document. Rows without an id stay only if no row of their
    component has one, and then one for each fingerprint does.
    """
    columns = docs.columns
    found = grouped(docs)
    kept = found.groupBy("doc_id").agg(
        F.count("*").alias("n"), F.max(F.col("doc_id") == F.col("component_id")).alias("least")
    ).filter("least")
    keys = kept.select(F.col("doc_id").alias("_llm_id"), F.col("n").alias("_llm_n"))
    held = docs.join(keys, F.col("doc_id") == F.col("_llm_id"))
    same = held.filter(F.col("_llm_n") > 1).dropDuplicates(["_llm_id"])
    nameless = found.filter(F.col("component_id").isNull()).select("fp").distinct()
    bare = docs.filter(F.col("doc_id").isNull())
    bare_prints = bare.mapInArrow(_with_fingerprint, _with_print_schema(bare))
    bare_kept = bare_prints.join(nameless.select(F.col("fp").alias("_llm_fp")), "_llm_fp", "left_semi").dropDuplicates(["_llm_fp"])
    return (
        held.filter(F.col("_llm_n") == 1).select(*columns)
        .unionByName(same.select(*columns))
        .unionByName(bare_kept.select(*columns))
    )


def _with_print_schema(docs: DataFrame):
    from pyspark.sql.types import LongType, StructType

    return StructType([*docs.schema.fields]).add("_llm_fp", LongType())


def _with_fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("text")
        values = pa.array([fingerprint(x.as_py()) for x in batch.column(at)], pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns, values], [*batch.schema.names, "_llm_fp"])
