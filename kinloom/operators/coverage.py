"""Copy number from coverage, joins of intervals, repeat families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import written
from .numbering import in_ranges


def _any_prefix(column: str, prefixes: list[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | F.col(column).startswith(p)
    return out


def median_baseline(regions: DataFrame, prefix: str = "") -> DataFrame:
    """One row: the median coverage of regions whose name has the prefix, 0 for none."""
    return regions.where(F.col("name").startswith(prefix)).agg(F.coalesce(F.median("mean_coverage"), F.lit(0.0)).alias("baseline"))


def estimate_cn(regions: DataFrame, baseline: DataFrame | float) -> DataFrame:
    """Adds relative_cn, coverage over the baseline (itself if that is not over 0)."""
    if not isinstance(baseline, DataFrame):
        return regions.withColumn("relative_cn", F.col("mean_coverage") / (baseline if baseline > 0 else 1.0))
    one = regions.crossJoin(F.broadcast(baseline.select("baseline")))  # one row
    return one.withColumn("relative_cn", F.col("mean_coverage") / F.when(F.col("baseline") > 0, F.col("baseline")).otherwise(1.0)).drop("baseline")


def summarise_cluster(estimates: DataFrame, name: str, prefixes: list[str]) -> DataFrame:
    """One row: cluster, n, total_cn and mean_cn of the regions that have any of the prefixes, each once."""
    return estimates.where(_any_prefix("name", prefixes)).agg(F.lit(name).alias("cluster"), F.count("*").alias("n"), F.coalesce(F.sum("relative_cn"), F.lit(0.0)).alias("total_cn"), F.coalesce(F.avg("relative_cn"), F.lit(0.0)).alias("mean_cn"))


def paralog_cluster_cn(regions: DataFrame, names: list[str], baseline: float) -> DataFrame:
    """One row: total_cn, the summed coverage of the named regions over the baseline, and per_gene_cn."""
    total = F.coalesce(F.sum("mean_coverage"), F.lit(0.0)) / (baseline if baseline > 0 else 1.0)
    return regions.where(F.col("name").isin(names)).agg(total.alias("total_cn"), F.when(F.count("*") > 0, total / F.count("*")).otherwise(0.0).alias("per_gene_cn"))


def overlapping(left: DataFrame, right: DataFrame, bin_bp: int = 1 << 14) -> DataFrame:
    """Pairs of intervals of one chrom with a common base; columns of the right side get the prefix r_. Both
    sides are cut at bins, so the join is one of equal keys and no chrom is one task; a pair that shares
    several bins comes from the first of them alone."""
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bin_bp), F.floor((F.greatest(F.col(b), F.col(a) + 1) - 1) / bin_bp)))
    r = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    a = left.withColumn("_bin", bins("start", "end"))
    b = r.withColumn("_bin", bins("r_start", "r_end"))
    met = a.join(b, (a["chrom"] == b["r_chrom"]) & (a["_bin"] == b["_bin"]) & (F.col("start") < F.col("r_end")) & (F.col("end") > F.col("r_start"))).drop(b["_bin"])
    return met.where(F.col("_bin") == F.floor(F.greatest("start", "r_start") / bin_bp)).drop("_bin")


def query_intervals(entries: DataFrame, queries: DataFrame, **how) -> DataFrame:
    """Entries that overlap each query: columns of the query, then the entry's with the prefix r_."""
    return overlapping(queries, entries, **how)


def painted(regions: DataFrame, order: str = "row_idx") -> DataFrame:
    """Disjoint segments (chrom, start, end, cov): where regions overlap, the last one in order counts; its
    coverage is rounded to an integer."""
    edges = in_ranges(regions.select("chrom", F.explode(F.array("start", "end")).alias("at")).distinct(), "chrom", "at")
    # The next edge is in the same range of edges, or the first of the next range.
    first = edges.groupBy("_part").agg(F.min(F.struct("chrom", "at")).alias("first"))
    after = first.select("_part", F.lead("first").over(Window.orderBy("_part")).alias("next"))  # a row for each range
    step = edges.withColumn("to", F.lead("at").over(Window.partitionBy("_part", "chrom").orderBy("at"))).join(F.broadcast(after), "_part")
    to = F.coalesce("to", F.when(F.col("next.chrom") == F.col("chrom"), F.col("next.at")))
    segments = step.select("chrom", F.col("at").alias("start"), to.alias("end")).where("end IS NOT NULL")
    met = overlapping(segments, regions.select("chrom", "start", "end", order, "mean_coverage"))
    last = met.groupBy("chrom", "start", "end").agg(F.max_by("r_mean_coverage", f"r_{order}").alias("c"))
    return last.select("chrom", "start", "end", F.floor(F.col("c") + 0.5).cast("long").alias("cov"))


def family_cn(repeats: DataFrame, regions: DataFrame, baseline: float, order: str = "row_idx") -> DataFrame:
    """(family, total_bp, mean_cov, cn): coverage of each repeat family over the bases up to the end of the
    last region of their chrom; bases no region covers count as 0. cn is twice the mean over the baseline."""
    ends = regions.groupBy("chrom").agg(F.max("end").alias("chrom_end"))
    base = repeats.select("family", "chrom", "start", "end").join(ends, "chrom").withColumn("end", F.least("end", "chrom_end")).where("end > start").drop("chrom_end")
    base = written(base.select("family", "chrom", "start", "end"), "repeats")
    met = overlapping(base, painted(regions, order))
    covered = met.groupBy("family").agg(F.sum(F.col("r_cov") * (F.least("end", "r_end") - F.greatest("start", "r_start"))).alias("covered"))
    total = base.groupBy("family").agg(F.sum(F.col("end") - F.col("start")).alias("total_bp"))
    out = total.join(covered, "family", "left").withColumn("mean_cov", F.coalesce(F.col("covered"), F.lit(0)) / F.col("total_bp"))
    return out.select("family", "total_bp", "mean_cov", (F.col("mean_cov") / baseline * 2 if baseline > 0 else F.lit(0.0)).alias("cn"))


def merge_intervals(intervals: DataFrame, label: str = "name") -> DataFrame:
    """(chrom, start, end, names): overlapping and touching intervals become one, with the set of labels."""
    rows = in_ranges(intervals.select("chrom", "start", "end", label), "chrom", "start", "end")
    # How far intervals reach is told within a range, and from range to range by its largest end: a row for each.
    by = Window.partitionBy("_part", "chrom").orderBy("_at")
    ranges, earlier = Window.partitionBy("chrom").orderBy("_part"), Window.partitionBy("chrom").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    reach = rows.groupBy("_part", "chrom").agg(F.max("end").alias("far")).withColumn("before", F.max("far").over(earlier)).drop("far")
    reached = F.greatest(F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.col("before"))
    marked = rows.join(F.broadcast(reach), ["_part", "chrom"]).withColumn("new", F.when(F.col("start") <= reached, 0).otherwise(1)).drop("before")
    runs = marked.groupBy("_part", "chrom").agg(F.sum("new").alias("n")).withColumn("runs", F.sum("n").over(ranges) - F.col("n")).drop("n")
    run = marked.withColumn("run", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0))).join(F.broadcast(runs), ["_part", "chrom"]).withColumn("run", F.col("run") + F.col("runs"))
    return run.groupBy("chrom", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.array_join(F.array_sort(F.collect_set(label)), ",").alias("names")).drop("run")


def roi_classes(coverage: DataFrame, roi: DataFrame) -> DataFrame:
    """Adds the class of the region of interest with the same place, "unknown" where there is none."""
    classes = roi.select("chrom", "start", "end", "roi_class").dropDuplicates(["chrom", "start", "end"])
    return coverage.join(classes, ["chrom", "start", "end"], "left").withColumn("roi_class", F.coalesce("roi_class", F.lit("unknown")))


def roi_stats(df: DataFrame, by: str = "roi_class", value: str = "mean_coverage") -> DataFrame:
    r = lambda x, name: F.round(x, 3).alias(name)
    return df.groupBy(by).agg(F.count("*").alias("n"), r(F.avg(value), "mean"), r(F.median(value), "median"), r(F.coalesce(F.stddev_samp(value), F.lit(0.0)), "stdev"), r(F.min(value), "min"), r(F.max(value), "max"))
