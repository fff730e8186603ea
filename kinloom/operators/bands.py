"""Accuracy of called alleles, by bands of allele fraction."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import BANDS, LENGTH_BUCKET, VAF_MATCH, ship
from ..functions.sequence import band


def aggregate_by_length(nodes: DataFrame, bucket_bp: int = LENGTH_BUCKET, order: str = "row_idx") -> DataFrame:
    """(node_id, est_copy_count, length_bp, read_support, est_vaf): nodes of about one length are one call; its
    copy count is the most frequent (of equal ones the first seen), its length the mean, its allele fraction
    the share of nodes."""
    b = F.floor((F.col("length_bp") + bucket_bp // 2) / bucket_bp)
    placed = nodes.withColumn("bucket", b)
    counts = placed.groupBy("bucket", "est_copy_count").agg(F.count("*").alias("n"), F.min(order).alias("seen"), F.min("node_id").alias("node_id"), F.sum("length_bp").alias("len"), F.sum("read_support").alias("rc"))
    calls = counts.groupBy("bucket").agg(F.min("node_id").alias("node_id"), F.max_by("est_copy_count", F.struct(F.col("n"), -F.col("seen"))).alias("est_copy_count"), (F.sum("len") / F.sum("n")).cast("long").alias("length_bp"), F.sum("rc").alias("read_support"), F.sum("n").alias("n"))
    total = nodes.agg(F.count("*").alias("total"))
    return calls.crossJoin(F.broadcast(total)).select("node_id", "est_copy_count", "length_bp", "read_support", (F.col("n") / F.col("total")).alias("est_vaf"))  # one row


def calls_from_nodes(nodes: DataFrame, bucket_bp: int = LENGTH_BUCKET) -> DataFrame:
    """Each node's share of all read support; where there is none at all, calls by length."""
    if nodes.where("read_support > 0").isEmpty():
        return aggregate_by_length(nodes, bucket_bp)
    total = nodes.agg(F.sum("read_support").alias("total"))
    return nodes.crossJoin(F.broadcast(total)).select("node_id", "est_copy_count", "length_bp", "read_support", (F.col("read_support") / F.col("total")).alias("est_vaf"))  # one row


def claims(truth: np.ndarray, calls: np.ndarray, tolerance: float = VAF_MATCH) -> np.ndarray:
    """For each true fraction, in order, the nearest call not yet claimed within the tolerance (of equally
    near ones the first), or -1. Fractions in no band claim nothing."""
    free, out = np.ones(len(calls), bool), np.full(len(truth), -1)
    for i, t in enumerate(truth):
        if not 0 < t <= 1:
            continue
        d = np.where(free, np.abs(calls - t), np.inf)
        if len(d) and d[j := int(np.argmin(d))] < tolerance + 1e-12:
            out[i], free[j] = j, False
    return out


def match(truth: DataFrame, calls: DataFrame, sample: str = "sample") -> DataFrame:
    """truth: (sample, row_idx, vaf_target, copy_count); calls: (sample, row_idx, est_vaf, est_copy_count).
    Rows (sample, kind, band, residual, cn_ok): truth, hit (a claimed call, in its truth's band) and false
    (an unclaimed call, in its own). A sample's alleles come together in one task: they are matched in order."""

    def matched(t, c):
        import pyarrow as pa

        t, c = t.sort_by("row_idx"), c.sort_by("row_idx")
        name = (t if t.num_rows else c).column(sample)[0].as_py()
        vaf, est = (np.array(x.to_pylist(), float) for x in (t.column("vaf_target"), c.column("est_vaf")))
        at, rows = claims(vaf, est), []
        cn, est_cn = t.column("copy_count").to_pylist(), c.column("est_copy_count").to_pylist()
        for v, j, n in zip(vaf, at, cn):
            rows.append((name, "truth", v, None, None))
            if j >= 0:
                rows.append((name, "hit", v, abs(est[j] - v), est_cn[j] == n))
        rows += [(name, "false", est[j], None, None) for j in sorted({*range(len(est))} - {*at.tolist()})]
        kinds = (t.schema.field(sample).type, pa.string(), pa.float64(), pa.float64(), pa.bool_())
        return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [sample, "kind", "vaf", "residual", "cn_ok"])

    ship(truth.sparkSession)
    kind = truth.schema[sample].dataType.simpleString()
    # Both may come from one table: fresh columns tell them apart.
    t = truth.select(F.col(sample).alias(sample), F.col("row_idx").alias("row_idx"), F.col("vaf_target").cast("double").alias("vaf_target"), F.col("copy_count").cast("long").alias("copy_count"))
    c = calls.select(F.col(sample).alias(sample), F.col("row_idx").alias("row_idx"), F.col("est_vaf").cast("double").alias("est_vaf"), F.col("est_copy_count").cast("long").alias("est_copy_count"))
    rows = t.groupBy(sample).cogroup(c.groupBy(sample)).applyInArrow(matched, f"{sample} {kind}, kind string, vaf double, residual double, cn_ok boolean")
    return rows.withColumn("band", band("vaf"))


def band_stats(truth: DataFrame, calls: DataFrame, sample: str = "sample") -> DataFrame:
    """A row for each sample and band: n_truth, n_called, tp, fp, recall, precision, median_abs_vaf_residual,
    copy_count_accuracy; rates of nothing are null."""
    rows = match(truth, calls, sample)
    bands = rows.sparkSession.createDataFrame([(i, *b) for i, b in enumerate(BANDS)], "band int, name string, lo double, hi double")
    samples = truth.select(sample).union(calls.select(sample)).distinct()
    n = lambda kind: F.count(F.when(F.col("kind") == kind, 1))
    counted = rows.where("band IS NOT NULL").groupBy(sample, "band").agg(n("truth").alias("n_truth"), n("hit").alias("tp"), n("false").alias("fp"), F.count(F.when(F.col("cn_ok"), 1)).alias("cn"), F.median("residual").alias("median_abs_vaf_residual"))
    out = samples.crossJoin(F.broadcast(bands)).join(counted, [sample, "band"], "left").fillna(0, ["n_truth", "tp", "fp", "cn"])  # five rows
    rate = lambda a, b: F.when(b > 0, a / b)
    tp = F.col("tp")
    return out.select(sample, "name", "lo", "hi", "n_truth", tp.alias("n_called"), "tp", "fp", rate(tp, F.col("n_truth")).alias("recall"), rate(tp, tp + F.col("fp")).alias("precision"), "median_abs_vaf_residual", rate(F.col("cn"), tp).alias("copy_count_accuracy"))


def fractions(df: DataFrame, support: str = "read_support", by: str | None = None) -> DataFrame:
    """Adds vaf: the row's share of all support (of its group), null where there is none."""
    total = F.sum(support).over(Window.partitionBy(by)) if by else None
    if total is not None:
        return df.withColumn("vaf", F.when(total > 0, F.col(support) / total))
    one = df.agg(F.sum(support).alias("_total"))
    return df.crossJoin(F.broadcast(one)).withColumn("vaf", F.when(F.col("_total") > 0, F.col(support) / F.col("_total"))).drop("_total")  # one row
