"""Hot groups: the spread forms give the same rows as the plain ones."""

import random

from pyspark.sql import functions as F

from termloom.operators.spread import exploded_copies, hot_keys, key_counts, left_join_spread, lookup_join, ranked
from termloom.operators.summaries import counted_lists, list_text
from tests.conftest import collect


def skewed(spark, n=3000):
    """A third of all rows hold one key, a tenth hold none."""
    def key(i):
        return 7 if i % 3 == 0 else None if i % 10 == 1 else i % 97

    return spark.createDataFrame([(i, key(i)) for i in range(n)], "row long, k int")


def test_ranked_is_row_number(spark):
    rng = random.Random(1)
    values = [(rng.choice("abc"), i) for i in range(500)]
    df = spark.createDataFrame(values, "g string, i long").repartition(6)
    got = collect(ranked(df, ["g", "i"]), "rank")
    assert got == [(g, i, n) for n, (g, i) in enumerate(sorted(values))]


def test_ranked_of_nothing(spark):
    assert ranked(spark.createDataFrame([], "v long"), ["v"]).count() == 0


def test_hot_keys(spark):
    rows = skewed(spark).filter("k = 7").count()
    assert collect(hot_keys(key_counts(skewed(spark), ["k"]), ["k"], 100), "k", "_salts") == [(7, rows // 100 + 1)]


def test_left_join_spread_equals_left_join(spark):
    left = skewed(spark)
    right = spark.createDataFrame([(k, f"v{k}") for k in range(0, 60)], "k int, v string")
    plain = left.join(right, "k", "left").select("row", "k", "v")
    spread = left_join_spread(left, right, ["k"], ["row"], least_rows=100)
    assert collect(plain, "row") == collect(spread, "row")


def test_hot_key_is_split(spark):
    left = skewed(spark)
    right = spark.createDataFrame([(7, "hot")], "k int, v string")
    spread = left_join_spread(left, right, ["k"], ["row"], least_rows=100)
    plan = spread._jdf.queryExecution().toString()
    assert "_salt" in plan


def test_lookup_join_beyond_the_bound(spark):
    left = skewed(spark)
    right = spark.createDataFrame([(k, f"v{k}") for k in range(0, 60)], "k int, v string")
    within = collect(lookup_join(left, right, ["k"], ["row"]), "row")
    beyond = collect(lookup_join(left, right, ["k"], ["row"], most_bytes=1), "row")
    assert within == beyond


def test_exploded_copies(spark):
    df = spark.createDataFrame([(1, 0), (2, 1), (3, 25)], "id long, times long")
    got = collect(exploded_copies(df, "times", "j", chunk=10).select("id", "j"), "id", "j")
    assert got == [(2, 0)] + [(3, j) for j in range(25)]


def test_counted_lists_have_one_grain(spark):
    rows = [(1, f"c{i % 50:02d}") for i in range(100_000)] + [(2, "b"), (2, "a"), (2, "b"), (3, None), (None, "z")]
    df = spark.createDataFrame(rows, "id long, course string")
    lists = counted_lists(df, ["id"], {"courses": "course"}).withColumn("text", list_text("courses"))
    got = collect(lists.select("id", "size", "text"), "id")
    assert got[0] == (1, 100_000, " ".join(f"c{i:02d}*2000" for i in range(50)))
    assert got[1:] == [(2, 3, "a b*2"), (3, 1, "")]


def test_lists_of_small_and_large_groups_agree(spark):
    """Every group below the bound, and every one above it."""
    rows = [(i % 7, i % 3, None if i % 11 == 0 else i % 5, f"é{i % 4}" if i % 6 else None) for i in range(500)] + [(8, 0, None, None)]
    df = spark.createDataFrame(rows, "k int, t int, a long, b string")
    lists = {"first": "a", "second": "b"}
    few, many = (counted_lists(df, ["k", "t"], lists, hot_rows=n) for n in (10_000, 1))
    assert few.schema["first"].dataType == many.schema["first"].dataType
    assert collect(few, "k", "t") == collect(many, "k", "t") and few.count() == 22
    got = {(r["k"], r["t"]): r for r in few.collect()}
    assert got[8, 0]["size"] == 1 and got[8, 0]["first"] == [] and got[8, 0]["second"] == []
    own = [r for r in rows if r[:2] == (2, 1)]
    assert got[2, 1]["size"] == len(own)
    assert [tuple(x) for x in got[2, 1]["first"]] == [(str(a), sum(r[2] == a for r in own)) for a in sorted({r[2] for r in own} - {None})]


def test_lists_of_small_groups_are_shuffled_once(spark):
    df = spark.range(1000).selectExpr("id % 300 as k", "id % 7 as a", "id % 5 as b")
    for n, exchanges in ((10_000, ["k"]), (1, [])):
        lists = counted_lists(df, ["k"], {"x": "a", "y": "b"}, hot_rows=n)
        lists.collect()
        plan = lists._jdf.queryExecution().executedPlan().toString()
        rest = plan.split("Initial Plan")[0] if n > 1 else ""
        assert [x for x in ("k", "list") if f"{x}#" in "".join(l for l in rest.splitlines() if "Exchange hashpartitioning" in l)] == exchanges


def test_first_per_key_and_flags_on_hot_keys(spark):
    from termloom.operators.rows import first_per_key, flag_repeated

    df = skewed(spark)
    first = collect(first_per_key(df, ["k"], ["row"]).filter("k IS NOT NULL"), "k")
    expected = {}
    for r in df.orderBy("row").collect():
        if r["k"] is not None:
            expected.setdefault(r["k"], r["row"])
    assert first == sorted(((row, k) for k, row in expected.items()), key=lambda x: x[1])
    flagged = flag_repeated(df, ["k"], ["row"])
    assert flagged.count() == df.count()
    counts = {k: n for k, n in collect(df.groupBy("k").count(), "k")}
    assert all(r["dup"] == (counts[r["k"]] > 1) for r in flagged.collect())
    one_null = spark.createDataFrame([(1, None, 2), (2, None, 3), (3, 5, 3), (4, 5, 3)], "row long, a int, b int")
    assert [r["dup"] for r in flag_repeated(one_null, ["a", "b"], ["row"]).orderBy("row").collect()] == [
        False, False, True, True,
    ]


def test_group_mode_on_hot_group(spark):
    from termloom.operators.summaries import group_mode

    rows = [(1, i % 400) for i in range(4000)] + [(1, 17), (1, 5), (2, 9), (2, None)]
    df = spark.createDataFrame(rows, "g int, v int")
    assert collect(group_mode(df, ["g"], "v"), "g") == [(1, 5), (2, 9)]
    assert df.filter(F.col("v") == 5).count() == df.filter(F.col("v") == 17).count()
