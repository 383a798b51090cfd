from pyspark.sql import functions as F

from onefold.operators import resolve


def test_most_sources_of_one_value(spark):
    """Counted over sorted pairs; a source that gives a value twice counts once, and no values have none."""
    groups = [[("a", ["x", "y"]), ("b", ["y"]), ("a", ["y"]), ("c", ["z", "y"])], [("a", ["x"]), ("a", ["x"])], [("a", [])], []]
    frame = spark.createDataFrame(list(enumerate(groups)), "i int, recs array<struct<source:string,emails:array<string>>>")
    found = frame.select("i", resolve._most_sources(F.col("recs"), "emails").alias("n")).orderBy("i").collect()
    assert [r.n for r in found] == [3, 1, 0, 0]
