import datetime
import random
import re

import pytest
from moments import at
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from inboxlake.operators import skew
from inboxlake.operators.skew import hot_keys, newest, skew_join, with_place
from inboxlake.sources.tables import SCHEMAS, workspace

NOW = at("2024-01-31")


@pytest.fixture(scope="module")
def facts(spark):
    rnd = random.Random(1)
    rows = [(i, None if i % 50 == 0 else "hot" if rnd.random() < 0.4 else f"k{rnd.randrange(30)}") for i in range(3000)]
    return spark.createDataFrame(rows, "id long, k string")


@pytest.fixture(scope="module")
def dims(spark):
    return spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), ("k2", 4), ("none", 5)], "k string, v long")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("hot_rows", [100, 10_000_000])
def test_same_as_plain_join(facts, dims, rows, how, hot_rows):
    split = skew_join(facts, dims, ["k"], how, spread=["id"], hot_rows=hot_rows, salts=7)
    plain = facts.join(dims, "k", how)
    assert rows(split.select(*plain.columns)) == rows(plain)


def test_hot_rows_are_spread(facts, dims):
    joined = skew_join(facts, dims, ["k"], spread=["id"], hot_rows=100, salts=7)
    assert joined.filter("k = 'hot'").count() == 2 * facts.filter("k = 'hot'").count()
    assert [r["k"] for r in hot_keys(facts, ["k"], 500).collect()] == ["hot"]


def test_hot_keys_are_bounded(facts):
    assert hot_keys(facts, ["k"], 1, most=3).count() == 3


def test_place_is_row_number(spark, rows):
    rnd = random.Random(2)
    data = [(rnd.choice("ab"), rnd.choice([None, -5, -1, 0, 3, 12]), i * 37) for i in range(1000)]
    df = spark.createDataFrame(data, "k string, o int, id long")
    order = W.partitionBy("k").orderBy(F.col("o").asc_nulls_last(), "id")
    expected = df.withColumn("place", F.row_number().over(order) - 1)
    placed = with_place(df, ["k"], ["o"], "id", ids=500)
    assert rows(placed, "k", "o", "id", "place") == rows(expected.select("k", "o", "id", F.col("place").cast("long")))


def test_place_splits_one_key(spark):
    df = spark.range(100_000).selectExpr("'one' as k", "cast(null as int) as o", "id")
    placed = with_place(df, ["k"], ["o"], "id")
    assert placed.agg(F.count_if(F.col("place") == F.col("id"))).first()[0] == 100_000
    sizes = placed.groupBy(F.floor(F.col("id") / 4_096)).count().agg(F.max("count"), F.count("*")).first()
    assert sizes[0] <= 4_096 and sizes[1] == 25


def test_newest_puts_null_times_first(spark, rows):
    df = spark.sql(
        "select * from values ('a', null, 1), ('a', timestamp '2024-01-01', 2), ('b', timestamp '2024-01-01', 3), ('b', timestamp '2024-01-01', 4) as t(k, at, id)"
    )
    assert rows(newest(df, ["k"], "at", ["id"]), "k", "id") == [("a", 1), ("b", 4)]


def test_newest_limits_before_the_shuffle(facts):
    plan = newest(facts.withColumn("t", F.col("id")), ["k"], "t", ["id"], 6)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_newest_rows_of_a_hot_author(spark, table, rows):
    """One author has half of all rows; ranks are those of one window, and no text is ranked."""
    messages = table("messages", *[dict(id=i, author_id="hot" if i % 2 else f"a{i % 40}", text=f"t{i}", direction="entrada", created_at=None if i % 97 == 0 else NOW - datetime.timedelta(minutes=i % 50)) for i in range(1, 900)])
    for k in (1, 5, 30):
        ranked = skew.newest_rows(messages, ["author_id"], "created_at", "id", k, salts=4)
        assert rows(ranked, "id", "rank", "text") == rows(skew.newest(messages, ["author_id"], "created_at", ["id"], k), "id", "rank", "text")
    path = workspace(spark)
    messages.write.parquet(path)
    plan = skew.newest_rows(spark.read.schema(SCHEMAS["messages"]).parquet(path).select("author_id", "created_at", "id", "text"), ["author_id"], "created_at", "id", 5)
    scans = re.findall(r"ReadSchema: struct<([^>\n]*)", plan._jdf.queryExecution().executedPlan().toString())
    # the scan below the ranks has keys, times and ids only
    assert sorted("text:" in x for x in scans) == [False, True]
