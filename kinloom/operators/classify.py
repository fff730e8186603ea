"""What a bubble is: candidates, features, the cascade, and the fused decision.

Feature columns: flank (Jaccard of flank k-mers), depth (support over the diploid baseline), span (support over
the entry's reads), iqr, gc (difference of GC content), segdup and repeat (0 or 1), length (bp).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import FLANK_BP, FLANK_K, Cascade, Disambiguator, ship, written
from ..functions.sequence import gc_content, iqr, jaccard, kmers, logistic, wilson
from .graph import Graph

# The labels.
SPLIT, DUPLICATION, MIXED, NONSEPARABLE = "Split", "Duplication", "Mixed", "NonSeparable"


def candidates(bubbles: DataFrame, graph: Graph) -> DataFrame:
    """(entry, exit, support_first, support_alt, length): the first way's support, that of the others, and
    the length of entry, longest way and exit (a way ends with the exit, which so counts twice)."""
    each = bubbles.select("entry", "exit", F.posexplode("alts").alias("i", "alt"))
    length = graph.nodes.select(F.col("id").alias("node"), "length_bp")
    nodes = each.select("entry", "exit", "i", F.explode("alt.nodes").alias("node")).join(length, "node")
    longest = nodes.groupBy("entry", "exit", "i").agg(F.sum("length_bp").alias("l")).groupBy("entry", "exit").agg(F.max("l").alias("longest"))
    support = bubbles.select("entry", "exit", F.get("alts", F.lit(0))["support"].alias("support_first"), F.aggregate("alts", F.lit(0).cast("long"), lambda s, x: s + x["support"]).alias("total"))
    ends = lambda c: length.select(F.col("node").alias(c), F.col("length_bp").alias(f"{c}_bp"))
    joined = support.join(longest, ["entry", "exit"]).join(ends("entry"), "entry").join(ends("exit"), "exit")
    return joined.select("entry", "exit", "support_first", (F.col("total") - F.col("support_first")).alias("support_alt"), (F.col("entry_bp") + F.col("longest") + F.col("exit_bp")).alias("length"))


def diploid_baseline(graph: Graph) -> DataFrame:
    """One row: the mean support of an edge, 1 at least."""
    return graph.edges.agg(F.greatest(F.coalesce(F.avg("read_support"), F.lit(1.0)), F.lit(1.0)).alias("baseline"))


def features(found: DataFrame, graph: Graph) -> DataFrame:
    """Adds the feature columns to candidates. Optional columns read_spans (array), segdup, repeat."""
    node = lambda c: graph.nodes.select(F.col("id").alias(c), F.col("consensus").alias(f"{c}_seq"), F.col("read_support").alias(f"{c}_reads"))
    out = found.join(node("entry"), "entry", "left").join(node("exit"), "exit", "left").crossJoin(F.broadcast(diploid_baseline(graph)))  # one row
    total = F.col("support_first") + F.col("support_alt")
    tail = F.expr(f"right(entry_seq, {FLANK_BP})")
    head = F.expr(f"left(exit_seq, {FLANK_BP})")
    has = lambda c, other: F.col(c) if c in found.columns else other
    none = F.array().cast("array<double>")
    return out.select(
        *found.columns,
        F.coalesce(jaccard(kmers(tail, FLANK_K), kmers(head, FLANK_K)), F.lit(0.0)).alias("flank"),
        (total / F.col("baseline")).alias("depth"),
        F.when(F.col("entry_reads") > 0, F.least(F.lit(1.0), total / F.col("entry_reads"))).otherwise(0.0).alias("span"),
        iqr(has("read_spans", none)).alias("iqr"),
        F.coalesce(F.abs(gc_content("entry_seq") - gc_content("exit_seq")), F.lit(0.0)).alias("gc"),
        *[F.lit(0.0).alias(c) for c in ("segdup", "repeat") if c not in found.columns],
    )


def cascade(df: DataFrame, config: Cascade = Cascade()) -> DataFrame:
    """Adds label, confidence and stage: the first rule that holds decides."""
    c, prior = config, F.greatest("segdup", "repeat")
    rules: list[tuple[Column, str, Column, int]] = [
        (F.col("length") < c.min_length, NONSEPARABLE, F.lit(0.0), 0),
        (F.col("flank") >= c.flank_exit, SPLIT, F.col("flank"), 0),
        (F.col("depth") >= c.depth_dup, DUPLICATION, F.least(F.lit(1.0), F.col("depth") / (1.5 * c.depth_dup)), 1),
        (F.col("span") >= c.span, SPLIT, F.col("span"), 2),
        (prior > c.prior, DUPLICATION, prior, 3),
        ((F.col("flank") >= c.mixed_flank) & (F.col("depth") >= c.mixed_depth), MIXED, F.least("flank", F.col("depth") / c.depth_dup), 3),
    ]
    verdict = F.struct(F.lit(NONSEPARABLE).alias("label"), F.lit(c.emit).alias("confidence"), F.lit(3).alias("stage"))
    for holds, label, confidence, stage in reversed(rules):
        verdict = F.when(holds, F.struct(F.lit(label).alias("label"), confidence.cast("double").alias("confidence"), F.lit(stage).alias("stage"))).otherwise(verdict)
    return df.withColumn("_v", verdict).select(*df.columns, "_v.label", "_v.confidence", "_v.stage")


def disambiguate(df: DataFrame, config: Disambiguator = Disambiguator(), prior: Column | None = None) -> DataFrame:
    """Adds label, confidence and the scores: clear splits first, then mixed, then duplications, else the
    most confident label, or none if no confidence suffices."""
    c = config
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    scored = df.withColumns({
        "score_flank": logistic(F.col("flank"), c.flank_mid, c.slope),
        "score_depth": logistic(F.col("depth"), (c.depth_one + c.depth_two) / 2, c.slope),
        "score_span": logistic(F.col("span"), c.span_mid, c.slope),
        "score_prior": clamp(F.lit(c.prior) if prior is None else prior),
    })
    f, d, s, p = (F.col(f"score_{x}") for x in ("flank", "depth", "span", "prior"))
    centred = lambda x: 1 - F.abs(x - 0.5) * 2
    both = F.least(f, d)
    scored = scored.withColumns({
        "_split": clamp(c.w_flank * f + c.w_depth * (1 - d) + c.w_span * s + c.w_prior * p),
        "_dup": clamp(c.w_flank * (1 - f) + c.w_depth * d + c.w_span * (1 - s) + c.w_prior * (1 - p)),
        "_mixed": clamp((c.w_flank + c.w_depth) * both + c.w_span * F.greatest(F.lit(0.0), centred(s)) + c.w_prior * centred(p)),
    })
    is_split = (F.col("flank") >= c.split_flank) & (F.col("span") >= c.split_span) & (F.abs(F.col("depth") - c.depth_one) <= c.split_depth)
    is_mixed = (F.col("flank") >= c.mixed_flank) & (F.col("depth") >= c.mixed_depth)
    is_dup = (F.col("depth") >= c.dup_depth) & (F.col("flank") < c.split_flank)
    says = lambda label, x: F.struct(F.lit(label).alias("label"), x.alias("confidence"))
    top = F.greatest("_split", "_dup", "_mixed")
    best = F.when(top < c.emit, says(NONSEPARABLE, top)).when(F.col("_split") == top, says(SPLIT, top)).when(F.col("_dup") == top, says(DUPLICATION, top)).otherwise(says(MIXED, top))
    verdict = F.when(F.col("length") < c.min_length, says(NONSEPARABLE, F.lit(0.0)))
    verdict = verdict.when((F.col("depth") <= 0) & (F.col("span") <= 0) & (F.col("flank") <= 0), says(NONSEPARABLE, F.lit(0.0)))
    for holds, column, label in ((is_split, "_split", SPLIT), (is_mixed, "_mixed", MIXED), (is_dup, "_dup", DUPLICATION)):
        verdict = verdict.when(holds & (F.col(column) >= c.emit), says(label, F.col(column)))
    out = scored.withColumn("_v", verdict.otherwise(best))
    return out.select(*df.columns, "_v.label", "_v.confidence", "score_flank", "score_depth", "score_span", "score_prior")


def two_clusters(vectors: list, least: int = 3) -> list[tuple[list[int], float]]:
    """Single-linkage clusters of SNP vectors, closest pair first (of equally close ones the first), until two
    are left: members and their share. Nothing for too few vectors, or if a cluster is too small."""
    n = len(vectors)
    if n < max(2, 2 * least):
        return []
    far = np.iinfo(np.int64).max
    same = len({len(v) for v in vectors}) == 1
    if same:
        a = np.array([[ord(c) for c in v] for v in vectors]).reshape(n, -1)
        d = (a[:, None, :] != a[None, :, :]).sum(axis=2).astype(np.int64)
    else:
        d = np.array([[sum(x != y for x, y in zip(u, v)) if len(u) == len(v) else far - 1 for v in vectors] for u in vectors], np.int64)
    np.fill_diagonal(d, far)
    groups = [[i] for i in range(n)]
    while len(groups) > 2:  # d holds the clusters' distances: of two merged ones the lesser
        i, j = sorted(divmod(int(np.argmin(d)), len(groups)))
        groups[i] += groups.pop(j)
        d[i] = np.minimum(d[i], d[j])
        d[:, i] = d[i]
        d = np.delete(np.delete(d, j, 0), j, 1)
        d[i, i] = far
    if min(map(len, groups)) < least:
        return []
    return [(g, len(g) / n) for g in groups]


def decompose(reads: DataFrame, key: str, vector: str = "snps", order: str = "read_id", least: int = 3) -> DataFrame:
    """(key, cluster, read_ids, vaf) of each key's SNP vectors (strings), taken in the given order. A key's
    reads come together in one task: they are those of one bubble."""

    def clusters(table):
        import pyarrow as pa

        t = table.sort_by(order)
        ids, vectors = t.column(order).to_pylist(), t.column(vector).to_pylist()
        found = two_clusters(vectors, least)
        return pa.table({key: pa.array([t.column(key)[0].as_py()] * len(found), t.schema.field(key).type), "cluster": pa.array(range(len(found)), pa.int32()), "read_ids": pa.array([[ids[i] for i in g] for g, _ in found], pa.list_(pa.int64())), "vaf": pa.array([v for _, v in found], pa.float64())})

    ship(reads.sparkSession)
    kind = reads.schema[key].dataType.simpleString()
    named = reads.select(key, F.col(order).cast("long").alias(order), F.col(vector).cast("string").alias(vector))
    return named.groupBy(key).applyInArrow(clusters, f"{key} {kind}, cluster int, read_ids array<bigint>, vaf double")


def hierarchical(df: DataFrame, key: str, snps: DataFrame | None = None, config: Disambiguator = Disambiguator(), reclassify: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """As disambiguate, and mixed bubbles are decomposed once by their reads' SNP vectors: the parts, with
    depth scaled by twice their share and span no less than it, are decided alone, and the bubble's confidence
    becomes the mean of theirs by reads; it stays mixed. Adds decomposed. reclassify, if given, decides the parts instead: it
    takes their rows (those of df, with cluster, read_ids and vaf) and returns them with label and confidence."""
    top = disambiguate(df, config)
    if snps is None or config.depth_limit == 0:
        return top.withColumn("decomposed", F.lit(False))
    top = written(top, "decided")
    mixed = top.where(F.col("label") == MIXED)
    parts = decompose(snps.join(mixed.select(key), key, "left_semi"), key)
    sub = parts.join(mixed.select(*df.columns), key).withColumn("depth", F.col("depth") * 2 * F.col("vaf")).withColumn("span", F.greatest("span", "vaf"))
    decided = disambiguate(sub, config) if reclassify is None else reclassify(sub)
    w = F.size("read_ids")
    mean = decided.groupBy(key).agg((F.sum(w * F.col("confidence")) / F.sum(w)).alias("_mean"))
    out = top.join(mean, key, "left")
    return out.withColumn("decomposed", F.col("_mean").isNotNull()).withColumn("confidence", F.coalesce("_mean", "confidence")).drop("_mean")


def allele_fractions(df: DataFrame, successes: str = "support_first", others: str = "support_alt") -> DataFrame:
    """Adds vaf, ci_low and ci_high: the Wilson interval of the first way's share of support."""
    w = wilson(F.col(successes), F.col(successes) + F.col(others))
    return df.withColumn("_w", w).select(*df.columns, F.col("_w.point").alias("vaf"), "_w.ci_low", "_w.ci_high")


def prior_fractions(ids: DataFrame) -> DataFrame:
    """What is known of a bubble by its id alone: (0.5, 0, 1)."""
    return ids.select("*", F.lit(0.5).alias("vaf"), F.lit(0.0).alias("ci_low"), F.lit(1.0).alias("ci_high"))
