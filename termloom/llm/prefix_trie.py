"""Prefix trie of conversations: which beginnings they share and what computing those once saves.

Turns are dictionary encoded: one id per distinct (role, text). Every conversation becomes a sequence of
ids; equal sequences are counted first, so copies are one row from there on. Distinct sequences are
range partitioned, so a shard holds a run of the sorted order, and each shard builds a ternary search
tree over ids, inserting medians first to keep it balanced. A sequence that no other one follows any
further is held whole by its last node and never unrolled. An iterative traversal adds up members,
children, leaves and savings.

Nodes that two shards share are just the common beginnings of the last sequence of one shard and the
first of the next. A shard adds to them what it alone sees: its members, the children that begin in it,
its leaves, its savings. These parts are additive, so one sum for each boundary node merges them.

A single conversation's ids (eight bytes a turn) have to fit in one task; nothing else does: copies
of a conversation, common turns and common beginnings are all counted before they meet, and the list
of conversations that end in a node is hashed as a stream of sorted runs.

Defined cases: rows without a conv_id are dropped; a null role or text is empty; turns that are equal
or null are ordered by the MD5 of role and text, so repeated rows are turns like any other; an empty
table has no nodes, not even a root. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from termloom.llm.common import ship
from termloom.operators.spread import lookup_join
from termloom.session import checkpointed

ship(__name__)

#: The head of a conversation comes from the first of its block of so many ids, and has fewer turns than HEADS.
BLOCK = 20
HEADS = 4
#: Turns a shard holds, about.
SHARD_TURNS = 1 << 14

NODES = (
    "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, "
    "saved_tokens bigint, ends binary, node binary, above binary"
)


def encoded(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, id, words) of every turn: its place from 1, its dictionary id, the words of its text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    told = checkpointed(
        conversations.filter(F.col("conv_id").isNotNull()).select(
            F.col("conv_id").cast("bigint").alias("conv_id"), "turn",
            F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("key"),
            F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).alias("words"),
        )
    )
    dictionary = checkpointed(told.select("key").distinct().withColumn("id", F.monotonically_increasing_id()))
    known = lookup_join(told, dictionary, ["key"], ["conv_id", "turn"], stored=True)
    in_order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "key")
    return known.select("conv_id", F.row_number().over(in_order).alias("pos"), "id", "words")


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, ids, words, seq): every conversation with the head of its block; ``seq`` is equal for equal ids."""
    turns = checkpointed(turns)
    head = F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % HEADS
    convs = turns.select("conv_id").distinct().withColumn("h", head)
    first = turns.filter((F.col("pos") < HEADS) & (F.col("conv_id") % BLOCK == 0)).withColumnRenamed("conv_id", "base")
    heads = (
        convs.filter("h > 0").withColumn("base", F.col("conv_id") - F.col("conv_id") % BLOCK)
        .join(first, "base").filter("pos <= h")
    )
    said = F.struct("pos", "id", "words").alias("said")
    parts = (
        turns.filter(F.col("pos") > head).select("conv_id", said)
        .unionByName(heads.select("conv_id", said))
        .unionByName(convs.select("conv_id", F.lit(None).cast("struct<pos:int,id:bigint,words:int>").alias("said")))
    )
    whole = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list("said")).alias("said"))
    ids = F.col("said.id")
    return whole.select(
        "conv_id", ids.alias("ids"), F.col("said.words").alias("words"),
        F.unhex(F.md5(F.array_join(F.transform(ids, lambda x: x.cast("string")), ","))).alias("seq"),
    )


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (seq, conv_id) to runs: (seq, least id, ids in it, the ids comma-joined)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        seqs, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        starts = [0] + [i for i in range(1, len(ids)) if seqs[i] != seqs[i - 1]]
        out = [
            (seqs[a], ids[a], b - a, ",".join(map(str, ids[a:b])).encode())
            for a, b in zip(starts, starts[1:] + [len(ids)])
        ]
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, t) for x, t in zip(zip(*out), (pa.binary(), pa.int64(), pa.int64(), pa.binary()))],
            ["seq", "conv_id", "n", "listed"],
        )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs in order to (conv_id, n, ends) of each seq; only one run is held at a time."""
    def made(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary()))],
            ["conv_id", "n", "ends"],
        )

    seq = least = sha = None
    n = 0
    for batch in batches:
        done = []
        for x, first, size, listed in zip(*(batch.column(k).to_pylist() for k in range(4))):
            if x != seq:
                if sha is not None:
                    done.append((least, n, sha.digest()))
                seq, least, n, sha = x, first, 0, hashlib.sha256()
            elif n:
                sha.update(b",")
            n += size
            sha.update(listed)
        yield made(done)
    if sha is not None:
        yield made([(least, n, sha.digest())])


def distinct_sequences(whole: DataFrame) -> DataFrame:
    """(conv_id, ids, words, n, ends): each sequence once, under its least id, and the hash of all its ids."""
    members = whole.select("seq", "conv_id")
    runs = members.repartitionByRange("seq", "conv_id").sortWithinPartitions("seq", "conv_id").mapInArrow(
        _runs, "seq binary, conv_id bigint, n bigint, listed binary"
    )
    digests = runs.repartition("seq").sortWithinPartitions("seq", "conv_id").mapInArrow(
        _digests, "conv_id bigint, n bigint, ends binary"
    )
    return whole.select("conv_id", "ids", "words").join(digests, "conv_id")


def _common(a: Column, b: Column) -> Column:
    """How many first elements two arrays share; -1 if either is null."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), True)
    return F.coalesce(F.when(differs == 0, F.size(a)).otherwise(differs - 1).cast("int"), F.lit(-1))


def sharded(sequences: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The sequences with their shard, and how deep it is shared with the one before (up) and after (down)."""
    sequences = checkpointed(sequences)
    turns = sequences.agg(F.coalesce(F.sum(F.size("ids") + 1), F.lit(0))).first()[0]
    dealt = checkpointed(
        sequences.repartitionByRange(max(1, -(-turns // shard_turns)), "ids").withColumn("shard", F.spark_partition_id())
    )
    ends = dealt.groupBy("shard").agg(F.min("ids").alias("least"), F.max("ids").alias("most"))
    order = Window.partitionBy(F.lit(0)).orderBy("shard")  # one row a shard
    sides = ends.select(
        "shard", _common(F.lag("most").over(order), F.col("least")).alias("up"),
        _common(F.col("most"), F.lead("least").over(order)).alias("down"),
    )
    return dealt.join(sides, "shard")


class SearchTree:
    """Ternary search tree over sequences of ids. Node 0 is the root, without an id.

    ``one`` is the only sequence through a node until a second one comes; it then moves one node down.
    """

    def __init__(self, sequences: list[np.ndarray]):
        self.sequences = sequences
        self.key, self.less, self.equal, self.more, self.one, self.end = [], [], [], [], [], []
        self._node(-1, -1)

    def _node(self, key: int, one: int) -> int:
        for values, value in ((self.key, key), (self.less, -1), (self.equal, -1), (self.more, -1), (self.one, one), (self.end, -1)):
            values.append(value)
        return len(self.key) - 1

    def unfold(self, at: int, depth: int) -> None:
        """Move the sequence that a node holds to its next node, or let it end here."""
        i = self.one[at]
        if i < 0:
            return
        self.one[at] = -1
        if len(self.sequences[i]) == depth:
            self.end[at] = i
        else:
            self.equal[at] = self._node(int(self.sequences[i][depth]), i)

    def child(self, at: int, key: int) -> tuple[list[int], int, int]:
        """The node of ``key`` below ``at`` or -1, and the link (list, place) that leads or would lead to it."""
        links, place = self.equal, at
        while (n := links[place]) >= 0:
            if key == self.key[n]:
                break
            links, place = (self.less if key < self.key[n] else self.more), n
        return links, place, n

    def insert(self, i: int) -> None:
        sequence, at, depth = self.sequences[i], 0, 0
        while True:
            if self.one[at] < 0 and self.equal[at] < 0 and self.end[at] < 0:
                self.one[at] = i
                return
            self.unfold(at, depth)
            if len(sequence) == depth:
                self.end[at] = i
                return
            key = int(sequence[depth])
            links, place, n = self.child(at, key)
            if n < 0:
                n = self._node(key, i)
                links[place] = n
                return
            at, depth = n, depth + 1

    def path(self, i: int, deepest: int) -> list[int]:
        """The nodes of sequence ``i`` from the root to a depth, all unfolded."""
        nodes = []
        for depth in range(deepest + 1):
            at = 0 if not nodes else self.child(nodes[-1], int(self.sequences[i][depth - 1]))[2]
            self.unfold(at, depth)
            nodes.append(at)
        return nodes

    def levels(self) -> tuple[list[int], list[int], list[int]]:
        """All nodes, parents first, with the place of the parent in that list and the depth."""
        nodes, parents, depths = [0], [-1], [0]
        k = 0
        while k < len(nodes):
            todo = [self.equal[nodes[k]]]
            while todo:
                n = todo.pop()
                if n >= 0:
                    nodes.append(n)
                    parents.append(k)
                    depths.append(depths[k] + 1)
                    todo += (self.less[n], self.more[n])
            k += 1
        return nodes, parents, depths


def medians(n: int) -> Iterator[int]:
    """0 to n - 1, the middle of every range before its halves."""
    todo = [(0, n)]
    while todo:
        low, high = todo.pop()
        if low < high:
            middle = (low + high) // 2
            yield middle
            todo += ((low, middle), (middle + 1, high))


def prefix_keys(sequence: np.ndarray, deepest: int) -> list[bytes]:
    """A key of each beginning of a sequence, from the empty one to that of ``deepest`` ids."""
    state, out = hashlib.md5(), []
    for depth in range(deepest + 1):
        if depth:
            state.update(int(sequence[depth - 1]).to_bytes(8, "little"))
        out.append(state.copy().digest())
    return out


def _shard_nodes(table: pa.Table) -> pa.Table:
    def lists(name):
        column = table.column(name).combine_chunks()
        values, starts = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy() - column.offsets[0].as_py()
        return [values[a:b] for a, b in zip(starts[:-1], starts[1:])]

    ids, words = lists("ids"), lists("words")
    order = sorted(range(len(ids)), key=lambda i: ids[i].astype(">i8").tobytes())  # ids are not negative
    convs, copies, ends = ([values[i] for i in order] for values in (table.column(c).to_pylist() for c in ("conv_id", "n", "ends")))
    ids, words = [ids[i] for i in order], [words[i] for i in order]
    up, down = table.column("up")[0].as_py(), table.column("down")[0].as_py()

    tree = SearchTree(ids)
    for i in medians(len(ids)):
        tree.insert(i)
    before, after = tree.path(0, up), tree.path(len(ids) - 1, down)
    keys = dict(zip(before, prefix_keys(ids[0], up))) | dict(zip(after, prefix_keys(ids[-1], down)))
    before, after = set(before), set(after)

    nodes, parents, depths = tree.levels()
    size = len(nodes)
    members, least, kids, leaves, saved, via = [0] * size, [None] * size, [0] * size, [0] * size, [0] * size, [-1] * size
    with_child = [False] * size
    for k in range(size - 1, -1, -1):
        at, depth = nodes[k], depths[k]
        held = tree.one[at]
        i = held if held >= 0 else tree.end[at]
        if i >= 0:
            via[k] = i
            members[k] += copies[i]
            least[k] = convs[i] if least[k] is None else min(least[k], convs[i])
        if held >= 0 and len(ids[held]) > depth:
            with_child[k], kids[k], leaves[k] = True, 1, 1
            saved[k] += (copies[held] - 1) * int(words[held][depth:].sum(dtype=np.int64))
        if not with_child[k] and at not in after:  # what the next shard shares goes on there
            leaves[k] = 1
        begins = at not in before
        if depth:
            saved[k] += (members[k] - begins) * int(words[via[k]][depth - 1])
            p = parents[k]
            members[p] += members[k]
            least[p] = least[k] if least[p] is None else min(least[p], least[k])
            leaves[p] += leaves[k]
            saved[p] += saved[k]
            kids[p] += begins
            with_child[p] = True
            via[p] = via[k]

    columns: list[list] = [[] for _ in range(10)]

    def add(*values):
        for column, value in zip(columns, values):
            column.extend(value)

    for k in range(size):
        at, p = nodes[k], parents[k]
        node, above = keys.get(at), keys.get(nodes[p]) if p >= 0 else None
        i = tree.one[at]
        here = tree.end[at] if i < 0 else i if len(ids[i]) == depths[k] else -1
        add(
            [least[k]], [depths[k]], [None if above is not None or p < 0 else least[p]], [members[k]], [kids[k]],
            [leaves[k]], [saved[k]], [ends[here] if here >= 0 else None], [node], [above],
        )
        if i >= 0 and (rest := len(ids[i]) - depths[k]):  # the nodes that only this sequence has
            left = np.cumsum(words[i][depths[k]:][::-1], dtype=np.int64)[::-1] * (copies[i] - 1)
            add(
                [convs[i]] * rest, range(depths[k] + 1, depths[k] + rest + 1), [convs[i]] * rest, [copies[i]] * rest,
                [1] * (rest - 1) + [0], [1] * rest, left.tolist(), [None] * (rest - 1) + [ends[i]], [None] * rest, [None] * rest,
            )
    return pa.table(
        [pa.array(c, pa.int64() if k < 7 else pa.binary()) for k, c in enumerate(columns)],
        names=[c.split()[0] for c in NODES.split(", ")],
    )


def trie(conversations: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row for each node of the trie of rebuilt conversations.

    ``conv_id`` is the smallest member and names the node together with ``depth``; ``ends`` is the SHA-256
    of the ids of the conversations that end in it (null: none does).
    """
    shards = sharded(distinct_sequences(checkpointed(rebuilt(encoded(conversations)))), shard_turns)
    parts = checkpointed(shards.groupBy("shard").applyInArrow(_shard_nodes, NODES))
    merged = checkpointed(
        parts.filter(F.col("node").isNotNull()).groupBy("node").agg(
            F.max("above").alias("above"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
            *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], F.max("ends").alias("ends"),
        )
    )
    names = merged.select(F.col("node").alias("above"), F.col("conv_id").alias("named"))
    inner = lookup_join(parts.filter(F.col("node").isNull()), names, ["above"], ["conv_id", "depth"], stored=True)
    outer = merged.join(names, "above", "left").withColumn("parent_conv_id", F.lit(None).cast("bigint"))
    columns = [
        "conv_id", "depth", F.coalesce("parent_conv_id", "named").alias("parent_conv_id"), "n_convs", "n_children",
        "n_leaves", "saved_tokens", "ends",
    ]
    return inner.select(*columns).unionByName(outer.select(*columns))
