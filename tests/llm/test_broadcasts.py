"""What the groups broadcast is counted, not estimated from files."""

import pytest
from pyspark.sql import functions as F

from kinloom.config import Written, counted_broadcasts
from kinloom.llm import simhash

THRESHOLD = "spark.sql.autoBroadcastJoinThreshold"


def test_exploded_tables_are_not_broadcast(spark):
    """100,000 fingerprints are 1.2 MB of files, but over 3 million rows around them: Spark's default broadcast them."""
    points = Written(spark.range(100_000).select(F.xxhash64("id").alias("fp"), F.col("id").alias("rep")), "points").df
    before = spark.conf.get(THRESHOLD)
    spark.conf.set(THRESHOLD, "10MB")
    try:
        with counted_broadcasts(spark):
            plan = simhash.links(points)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastExchange" not in plan and spark.conf.get(THRESHOLD) == "10MB"
        for own in ("-1", "64k"):
            spark.conf.set(THRESHOLD, own)
            with counted_broadcasts(spark):
                assert spark.conf.get(THRESHOLD) == own
    finally:
        spark.conf.set(THRESHOLD, before)


@pytest.mark.parametrize("made, inner", [(simhash.near_duplicates, "_near_duplicates"), (simhash.similar_groups, "_similar_groups")])
def test_operators_count_their_broadcasts(spark, monkeypatch, made, inner):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    seen, real, before = [], getattr(simhash, inner), spark.conf.get(THRESHOLD)
    monkeypatch.setattr(simhash, inner, lambda *a: (seen.append(spark.conf.get(THRESHOLD)), real(*a))[1])
    assert [r.component_id for r in made(docs).collect()] == [1, 1]
    assert seen == [str(256 * 1024)] and spark.conf.get(THRESHOLD) == before
