"""Prefix trie of conversations against a brute-force version, over one and many shards."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest

from termloom.llm import prefix_trie

CONV = "conv_id long, turn long, role string, text string"


def by_hand(rows):
    told = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            told[c].append((turn is not None, turn or 0, tie, role, text))
    said = {c: [x[3:] for x in sorted(v)] for c, v in told.items()}
    whole = {}
    for c in said:
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = tuple(said.get(c - c % 20, [])[:h] + said[c][h:])
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, s in whole.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
        ends[s].append(c)
    kids = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, convs in members.items():
        own = (len(convs) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += own
    return sorted(
        (
            min(convs), len(p), min(members[p[:-1]]) if p else None, len(convs), kids[p], leaves[p], saved[p],
            hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest() if ends[p] else None,
        )
        for p, convs in members.items()
    )


def rows_of(df):
    return sorted(
        (r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends.hex() if r.ends else None)
        for r in df.collect()
    )


def talk():
    rng = np.random.default_rng(2)
    rows = []
    for c in range(300):
        words = ["a b", "a b", "c", "d e f", ""]
        for t in range(rng.integers(0, 7)):
            rows.append((c, t, ["user", "assistant"][t % 2], str(rng.choice(words))))
    rows += [(c, t, "user", "the same words") for c in range(400, 520) for t in range(4)]  # copies
    rows += [(c, t, "user", f"long {min(t, c)}") for c in range(600, 612) for t in range(60)]
    rows += [(700, None, None, None), (700, 1, "user", None), (700, 1, "user", "x"), (700, 1, "user", "x"), (700, None, "a", "é  z")]
    rows += [(None, 0, "user", "nobody"), (1 << 40, 3, "user", "alone"), (19, 0, "user", "one turn")]
    return rows


@pytest.mark.parametrize("shard_turns", [1, 40, 1 << 14])
def test_nodes_are_as_by_hand(spark, shard_turns):
    rows = talk()
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], CONV + ", ids int, node string")
    assert rows_of(prefix_trie.trie(df, shard_turns)) == by_hand(rows)


def test_empty_and_textless(spark):
    assert prefix_trie.trie(spark.createDataFrame([], CONV)).collect() == []
    rows = [(22, 0, "user", "gone with the head")]  # conversation 20 is absent
    assert zlib.crc32(b"22") % 4 > 0
    assert rows_of(prefix_trie.trie(spark.createDataFrame(rows, CONV))) == by_hand(rows)
    assert by_hand(rows)[0][:5] == (22, 0, None, 1, 0)


def test_tree_is_balanced_and_copes_with_long_sequences():
    tree = prefix_trie.SearchTree([np.array([i]) for i in range(1023)])
    for i in prefix_trie.medians(1023):
        tree.insert(i)
    deepest, level = 0, [tree.equal[0]]
    while level := [n for n in level if n >= 0]:
        deepest, level = deepest + 1, [x for n in level for x in (tree.less[n], tree.more[n])]
    assert deepest == 10
    long = prefix_trie.SearchTree([np.arange(200_000), np.arange(200_000) + 1])
    for i in prefix_trie.medians(2):
        long.insert(i)
    assert len(long.key) == 3  # what only one sequence has is never unrolled
