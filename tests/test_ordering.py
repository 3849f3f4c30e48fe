"""Blocked prefix sums equal a single-partition window, across many blocks."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from stancelab.operators import ordering
from stancelab.operators.ordering import default_block, first_k, first_seen_rank, prefix_sum, ranged_sum, row_index


def test_row_index_and_prefix_sum_match_window(spark):
    random.seed(1)
    rows = [(i, random.choice("abc"), random.randint(0, 9)) for i in random.sample(range(5000), 700)]
    df = spark.createDataFrame(rows, "id long, g string, v long")
    got = row_index(df, ["id"], "pos", partition=["g"], block=default_block("id", 64))
    got = prefix_sum(got, "v", ["id"], "run", partition=["g"], block=default_block("id", 64), inclusive=True)
    w = Window.partitionBy("g").orderBy("id")
    want = df.select("id", (F.row_number().over(w) - 1).alias("pos"),
                     F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("run"))
    a = sorted((r.id, r.pos, r.run) for r in got.select("id", "pos", "run").collect())
    b = sorted((r.id, r.pos, r.run) for r in want.collect())
    assert a == b
    # many super-blocks: fanout 2 over blocks of width 8
    got2 = row_index(df, ["id"], "pos", partition=["g"], block=default_block("id", 8), fanout=2)
    c = sorted((r.id, r.pos) for r in got2.select("id", "pos").collect())
    assert c == [(i, p) for i, p, _ in b]


def test_first_k(spark):
    rows = [(i, "a" if i % 3 else "b") for i in range(300)]
    df = spark.createDataFrame(rows, "id long, g string")
    got = first_k(df, 5, ["id"], ["g"]).collect()
    by = {}
    for r in got:
        by.setdefault(r.g, []).append((r.rank_in_group, r.id))
    assert sorted(by["b"]) == [(i, 3 * i) for i in range(5)]
    assert [i for _, i in sorted(by["a"])] == [1, 2, 4, 5, 7]


def test_first_seen_rank_merges_null_and_empty(spark):
    df = spark.createDataFrame([(5, "b"), (1, None), (2, "a"), (3, ""), (4, "b"), (0, "c")], "id long, v string")
    got = {r.id: r.first_seen_rank for r in first_seen_rank(df, "v", "id").collect()}
    assert got == {0: 1, 1: 2, 3: 2, 2: 3, 4: 4, 5: 4}


def test_numbering_keeps_rows_with_null_keys(spark):
    rows = [(None, "a"), (1, "a"), (2, None), (None, None), (3, "a")]
    df = spark.createDataFrame(rows, "id long, g string")
    got = {(r.id, r.g): r.pos for r in row_index(df, ["id"], "pos", partition=["g"]).collect()}
    assert got == {(None, "a"): 0, (1, "a"): 1, (3, "a"): 2, (None, None): 0, (2, None): 1}
    assert first_k(df, 3, ["id"], ["g"]).count() == 5
    assert row_index(df, ["id"], "pos").count() == 5


def test_ranged_sum_matches_window(spark):
    """Repeated, null, negative and text keys, several partitions, inclusive or not."""
    rng = random.Random(4)
    rows = [(rng.choice([None, "x", "y"]), rng.choice([None, -5, 0, 7, 7, 7]), i, rng.randrange(9)) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, k int, id int, v int")
    for part in ([], ["g"]):
        for inclusive in (False, True):
            got = ranged_sum(df, F.col("v").cast("long"), ["k", "id"], "run", part, inclusive, rows=50)
            w = Window.partitionBy(*part).orderBy("k", "id").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
            want = df.withColumn("run", F.coalesce(F.sum("v").over(w), F.lit(0)))
            assert sorted(got.select("id", "run").collect()) == sorted(want.select("id", "run").collect())
    by_text = row_index(df.withColumn("t", F.col("id").cast("string")), ["t"], "pos", most=100).collect()
    assert [r.t for r in sorted(by_text, key=lambda r: r.pos)] == sorted(str(i) for i in range(900))
    assert row_index(df.limit(0), ["g"], "pos").count() == 0


def test_equal_keys_are_spread(spark, monkeypatch):
    """A million rows of one key get a number each, and no range is twice as large as the median one."""
    df = spark.range(1_000_000).select(F.lit(7).alias("k"))
    seen = []

    class Seen(ordering.Landing):
        def table(self, df, tag="t"):
            seen.append(super().table(df, tag))
            return seen[-1]
    monkeypatch.setattr(ordering, "Landing", Seen)
    got = row_index(df, ["k"], "pos").agg(F.count_distinct("pos"), F.min("pos"), F.max("pos")).first()
    assert tuple(got) == (1_000_000, 0, 999_999)
    sizes = sorted(r["count"] for r in seen[0].groupBy("_blk").count().collect())
    assert len(sizes) >= 4 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
