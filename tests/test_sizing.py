from pyspark.sql import functions as F

from areapanel.operators import panel as P
from areapanel.operators import sizing as Z


def test_a_dimension_of_long_texts_is_not_broadcast_though_its_rows_are_few(spark, values):
    dim = spark.range(2000).select(F.col("id").cast("string").alias("tract"), F.repeat(F.lit("x"), 20_000).alias("location"))
    pinned = Z.pin_small(dim)
    assert not pinned.is_small and pinned.frame.count() == 2000
    facts = spark.range(10).select(F.col("id").cast("string").alias("tract"))
    joined = P.dimension_join(facts, dim)
    assert joined.count() == 10
    assert "strategy=broadcast" not in joined._jdf.queryExecution().optimizedPlan().toString()
    small = P.dimension_join(facts, dim.select("tract"))
    assert "strategy=broadcast" in small._jdf.queryExecution().optimizedPlan().toString()


def test_bytes_are_counted_within_nested_values(values):
    df = values([(1, "abc", [[1.0, 2.0], [3.0]], {"k": "v" * 100}, (5, "zz"))],
                "a int, b string, c array<array<double>>, d map<string,string>, e struct<f:int,g:string>")
    rows, size = Z.measured(df)
    assert rows == 1 and 200 < size < 1000
    assert Z.measured(df.limit(0)) == (0, 0)


def test_the_side_is_evaluated_once_also_beyond_the_bound(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    for most in (1000, 10):
        before = seen.value
        pinned = Z.pin_small(spark.range(100).mapInArrow(count, "id long"), max_rows=most)
        assert pinned.is_small == (most == 1000) and pinned.frame.count() == 100 and pinned.frame.count() == 100
        assert seen.value - before == 100
