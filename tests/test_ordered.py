import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from loomtrace.plans.ordered import along


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def events(spark):
    """A hot key, small keys, and NULL as a key."""
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 11 == 0, None).otherwise(F.concat(F.lit("k"), F.col("id") % 4))
    return spark.range(2000).select(
        key.alias("key"), (F.col("id") * 7919 % 2003).alias("ts"), F.col("id")
    )


@pytest.mark.parametrize("ranges", [None, 1, 7, 40])
@pytest.mark.parametrize("keys", [["key"], []])
def test_ranges_give_the_rows_of_a_plain_window(events, ranges, keys):
    plain = Window.partitionBy(*keys).orderBy("ts", "id")
    laid = along(events, keys, ["ts", "id"], ranges=ranges)
    want = events.withColumn("pos", (F.row_number().over(plain) - 1).cast("long"))
    assert rows(laid.positions().frame().select(want.columns)) == rows(want)
    want = events.withColumn("before", F.lag("ts").over(plain)).withColumn("who", F.lag("id").over(plain))
    assert rows(laid.previous({"before": "ts", "who": "id"}).frame().select(want.columns)) == rows(want)
    want = events.withColumn("total", F.sum(F.col("id") % 5).over(plain))
    assert rows(laid.running_sum(F.col("id") % 5, "total").frame().select(want.columns)) == rows(want)
    known = events.withColumn("seen", F.when(F.col("id") % 41 == 0, F.col("ts")))
    upto = plain.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    want = known.withColumn("last", F.last("seen", ignorenulls=True).over(upto))
    got = along(known, keys, ["ts", "id"], ranges=ranges).last_known("seen", "last").frame()
    assert rows(got.select(want.columns)) == rows(want)


def test_chained_steps(events):
    def run(ranges):
        laid = along(events, ["key"], ["ts", "id"], ranges=ranges).previous({"b": "ts"})
        fresh = F.col("b").isNull() | (F.col("ts") - F.col("b") > 1)
        return rows(laid.running_sum(fresh.cast("long"), "c").positions().frame())

    assert run(30) == run(1)
