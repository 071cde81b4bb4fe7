"""Line dedup: the perfect hash, both ways to probe it, odd input, against a brute-force version."""

import collections

import numpy as np
import pytest

from termloom.llm import line_index

DOC = "doc_id long, text string"


def by_hand(rows):
    """(doc_id, kept text, lines, dropped) of every row."""
    def key(line):
        k = line.strip(" \t\n\x0b\f\r")
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in k)

    held = collections.defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20:
                held[key(line)].add(doc_id)
    often = {k: max(i for i in ids if i is not None) for k, ids in held.items() if len(ids) >= 3}
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in often or often[key(x)] == doc_id]
        out.append((doc_id, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.doc_id, r.text, r.line_count, r.dropped_lines) for r in df.collect()), key=str)


def corpus():
    rng = np.random.default_rng(5)
    lines = [f"line {'x' * (i % 23)} number {i} É" for i in range(60)] + ["short", "", "  ", "A" * 20, " " + "a" * 20 + "\t", "é" * 20, "É" * 20, "b" * 19]
    rows = [(i, "\n".join(rng.choice(lines, rng.integers(0, 9)))) for i in range(-3, 120)]
    common = "this line stands in a third of all documents"
    rows += [(i, f"{common}\nown {i}\n{common}") for i in range(200, 260)]
    return rows + [(7, rows[3][1]), (None, common), (None, "A" * 20), (300, None), (301, ""), (302, common.upper() + "\n" + "z" * 300000)]


@pytest.mark.parametrize("broadcast_bytes, shard_keys, probes", [(1 << 20, 1 << 15, 1 << 20), (1 << 20, 4, 9), (0, 4, 9), (0, 1 << 15, 1 << 20)])
def test_lines_go_as_by_hand(spark, monkeypatch, broadcast_bytes, shard_keys, probes):
    rows = corpus()
    monkeypatch.setattr(line_index, "SHARD_KEYS", shard_keys)
    got = line_index.deduplicated(spark.createDataFrame(rows, DOC), broadcast_bytes=broadcast_bytes, probes=probes)
    assert rows_of(got) == by_hand(rows)


@pytest.mark.parametrize("broadcast_bytes", [0, 1 << 20])
def test_odd_tables(spark, broadcast_bytes):
    assert line_index.deduplicated(spark.createDataFrame([], DOC), broadcast_bytes=broadcast_bytes).collect() == []
    line = "a line that is long enough"
    rows = [(i, f"{line}\n{i}", "en", [i], 5, "x") for i in (1, 2, 2, 3)]
    docs = spark.createDataFrame(rows, DOC + ", lang string, shard array<int>, line_count int, _line_at string")
    got = line_index.deduplicated(docs, broadcast_bytes=broadcast_bytes)
    assert got.columns == ["doc_id", "text", "lang", "shard", "line_count", "dropped_lines"]
    assert sorted(tuple(r) for r in got.collect()) == [
        (1, "1", "en", [1], 2, 1), (2, "2", "en", [2], 2, 1), (2, "2", "en", [2], 2, 1), (3, f"{line}\n3", "en", [3], 2, 0),
    ]


def test_perfect_hash_is_minimal_and_rejects_others():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(-(1 << 63), 1 << 63, (20000, 2)), axis=0)
    keys[:50, 0] = keys[0, 0]  # the first half alone need not differ
    hashed = line_index.PerfectHash.build(keys)
    assert sorted(hashed.index(keys).tolist()) == list(range(len(keys)))
    row = line_index.shard_row(0, keys, np.full(len(keys), 3), np.arange(len(keys)))
    shard = line_index.Shard(*[row[c] for c in ("levels", "bits", "prints", "counts", "owners")])
    none = np.zeros(len(keys), bool)
    assert not shard.dropped(keys, np.arange(len(keys)), none, 3).any()
    assert shard.dropped(keys, np.arange(len(keys)) + 1, none, 3).all()
    assert shard.dropped(keys, np.arange(len(keys)), ~none, 3).all()
    others = rng.integers(-(1 << 63), 1 << 63, (20000, 2))
    assert not shard.dropped(others, np.zeros(len(others), np.int64), none[:1].repeat(len(others)), 3).any()
    bits = sum(len(w) for w in hashed.words) * 64
    assert bits < 5 * len(keys)


def test_equal_keys_cannot_be_hashed():
    with pytest.raises(ValueError):
        line_index.PerfectHash.build(np.zeros((2, 2), np.int64))
