"""Connected components of a graph given as a table of links, without bringing it to the driver.

Each round every node looks at its parent's parent and at those of its neighbours, takes the least, and hooks
its parent there, too (the FastSV scheme); the rounds grow with the logarithm of the longest path. Rounds are
cut by tables written to the shared folder. Minima are aggregated before the shuffle, and joins are salted, so that
neither a node with very many links nor the root of a giant component is a hot key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written

SALT = 8


def salted(df: DataFrame, by: str) -> DataFrame:
    """One side of a join: rows with equal keys are dealt over SALT parts."""
    return df.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALT)).cast("int"))


def repeated(df: DataFrame) -> DataFrame:
    """The other side, of unique keys: in each part."""
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))


def components(links: DataFrame) -> DataFrame:
    """links: (a long, b long), not null, in any order and number. Returns (node, root): every node of a link
    and the least node it is connected to."""
    turned = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    both = Written(turned.union(turned.select("v", "u")).where("u <> v").distinct(), "links", few=True)
    labels = Written(both.df.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("p")).select(F.col("u").alias("node"), "p"), "labels", few=True)
    total = None
    while (now := labels.df.agg(F.sum(F.col("p").cast("decimal(38,0)"))).head()[0]) != total:
        total = now  # labels only fall: an equal sum means that none has changed
        up = labels.df.select(F.col("node").alias("p"), F.col("p").alias("gp"))
        above = salted(labels.df, "node").join(repeated(up), ["p", "salt"]).drop("salt")
        near = salted(both.df, "u").join(repeated(above.select(F.col("node").alias("v"), "gp")), ["v", "salt"]).groupBy("u").agg(F.min("gp").alias("c"))
        step = above.join(near.withColumnRenamed("u", "node"), "node")
        least = step.select(F.explode(F.array(F.struct("node", F.least("p", "gp", "c").alias("p")), F.struct(F.col("p").alias("node"), F.col("c").alias("p")))).alias("x")).select("x.*")
        new = Written(least.groupBy("node").agg(F.min("p").alias("p")), "labels", few=True)
        labels.drop()
        labels = new
    both.drop()
    return labels.df.select("node", F.col("p").alias("root"))
