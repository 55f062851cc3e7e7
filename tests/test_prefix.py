import random

from pyspark.sql import functions as F

from millrace.operators import prefix


def plain(rows):
    """k, p, v in order of k, then falling p."""
    out, total, number = [], {}, {}
    for k, p, v in sorted(rows, key=lambda r: -r[1]):
        total[k] = total.get(k, 0) + (v or 0)
        number[k] = number.get(k, 0) + 1
        out.append((k, p, v, total[k], number[k]))
    return out


def test_against_a_loop_with_a_hot_key(spark):
    rng = random.Random(1)
    places = rng.sample(range(10**6), 3000)
    rows = [("hot" if rng.random() < 0.6 else rng.choice(["a", None, "é", ""]), p, rng.choice([None, 0, 5, -3, 10**12])) for p in places]
    df = spark.createDataFrame(rows, "k string, p long, v long").repartition(7)
    got = prefix.running_totals(df, [F.col("p").desc()], {"total": F.col("v"), "number": F.lit(1)}, [F.col("k")])
    assert got.columns == ["k", "p", "v", "total", "number"]
    key = lambda r: r[1]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain(rows), key=key)
    # the hot key lies in several ranges, none of which holds it all
    plan = got._jdf.queryExecution().toString()
    assert "__range" in plan and "rangepartitioning" not in plan.split("== Physical Plan ==")[1]


def test_numbers_of_all_rows(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    got = {r.x: r.row_number for r in prefix.row_numbers(df, [F.col("x").asc()]).collect()}
    assert got == {x: x + 1 for x in range(1000)}


def test_no_rows_and_equal_rows(spark):
    df = spark.createDataFrame([], "k string, v int")
    assert prefix.row_numbers(df, [F.col("v")], by=[F.col("k")]).collect() == []
    same = spark.createDataFrame([("k", 1)] * 50, "k string, v int")
    assert sorted(r.row_number for r in prefix.row_numbers(same, [F.col("v")], by=[F.col("k")]).collect()) == list(range(1, 51))
