"""Conservation of read flow through the graph: what a node lets out should be what it takes in, times its
copy number."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Conservation, written
from .graph import Graph


@dataclass(frozen=True)
class Report:
    node_violations: DataFrame  # node, inflow, outflow, expected_cn, residual
    bubble_violations: DataFrame  # entry, exit, entry_outflow, exit_inflow, alt_flow_sum, residual
    edge_flow: DataFrame  # edge_idx, src, dst, flow after the last sweep
    sweeps: int
    converged: bool
    residual: float


def node_flow(nodes: DataFrame, flow: DataFrame) -> DataFrame:
    """nodes: (id, expected_cn); flow: (src, dst, flow). (id, expected_cn, inflow, outflow, n_in, n_out,
    residual): residual is outflow less inflow times the expected copy number. One aggregation of both ends."""
    ends = flow.select(F.inline(F.array(F.struct(F.col("dst").alias("id"), F.col("flow").alias("i"), F.lit(0.0).alias("o"), F.lit(1).alias("ni"), F.lit(0).alias("no")), F.struct(F.col("src").alias("id"), F.lit(0.0).alias("i"), F.col("flow").alias("o"), F.lit(0).alias("ni"), F.lit(1).alias("no")))))
    sums = ends.groupBy("id").agg(F.sum("i").alias("inflow"), F.sum("o").alias("outflow"), F.sum("ni").alias("n_in"), F.sum("no").alias("n_out"))
    filled = nodes.select("id", "expected_cn").join(sums, "id", "left").fillna(0, ["inflow", "outflow", "n_in", "n_out"])
    return filled.withColumn("residual", F.col("outflow") - F.col("inflow") * F.col("expected_cn"))


def expected(graph: Graph, hints: DataFrame | None = None) -> DataFrame:
    """(id, expected_cn): the hint of a node (hints: id, relative_cn) if it is over 0, else its copy count."""
    own = F.when(F.col("copy_count") > 0, F.col("copy_count")).otherwise(1).cast("double")
    if hints is None:
        return graph.nodes.select("id", own.alias("expected_cn"))
    joined = graph.nodes.join(hints.select("id", F.col("relative_cn").cast("double").alias("hint")), "id", "left")
    return joined.select("id", F.when(F.col("hint") > 0, F.col("hint")).otherwise(own).alias("expected_cn"))


def sweep(flow: DataFrame, state: DataFrame, config: Conservation = Conservation()) -> DataFrame:
    """Each interior node beyond the tolerance takes its damped residual off its edges out, evenly, and no
    edge falls below 0. All nodes act on the flows as they were."""
    damp = min(1.0, max(0.0, config.damping))
    acts = state.where((F.col("n_in") > 0) & (F.col("n_out") > 0) & (F.abs("residual") >= config.node_tolerance))
    cut = acts.select(F.col("id").alias("src"), (damp * F.col("residual") / F.col("n_out")).alias("cut"))
    return flow.join(cut, "src", "left").select("edge_idx", "src", "dst", F.when(F.col("cut").isNotNull(), F.greatest(F.lit(0.0), F.col("flow") - F.col("cut"))).otherwise(F.col("flow")).alias("flow"))


def _residual(state: DataFrame) -> float:
    return float(state.where("n_in > 0 AND n_out > 0").agg(F.coalesce(F.sum(F.abs("residual")), F.lit(0.0))).head()[0])


def conserve(graph: Graph, bubbles: DataFrame | None = None, hints: DataFrame | None = None, config: Conservation = Conservation()) -> Report:
    """Violations before any sweep; then sweeps until the sum of residuals is small or no longer falls (the
    sweep that doesn't help is kept), at most config.max_sweeps."""
    cn = written(expected(graph, hints), "expected")
    flow = graph.edges.select("edge_idx", "src", "dst", F.col("read_support").cast("double").alias("flow"))
    state = written(node_flow(cn, flow), "flow")
    inner = state.where("n_in > 0 AND n_out > 0").where(F.abs("residual") >= config.node_tolerance)
    nodes = inner.select(F.col("id").alias("node"), "inflow", "outflow", "expected_cn", "residual")
    at = None
    if bubbles is not None:
        entry = state.select(F.col("id").alias("entry"), F.col("outflow").alias("entry_outflow"), "expected_cn")
        exit_ = state.select(F.col("id").alias("exit"), F.col("inflow").alias("exit_inflow"))
        total = F.aggregate("alts", F.lit(0.0), lambda s, x: s + x["support"])
        joined = bubbles.select("entry", "exit", total.alias("alt_flow_sum")).join(entry, "entry").join(exit_, "exit")
        joined = joined.withColumn("residual", F.col("exit_inflow") - F.col("entry_outflow") * F.col("expected_cn"))
        at = joined.where(F.abs("residual") >= config.bubble_tolerance).select("entry", "exit", "entry_outflow", "exit_inflow", "alt_flow_sum", "residual")
    left, sweeps = _residual(state), 0
    while sweeps < config.max_sweeps and left >= config.epsilon:
        flow = written(sweep(flow, state, config), "edge-flow")
        state = written(node_flow(cn, flow), "flow")
        sweeps, before, left = sweeps + 1, left, _residual(state)
        if not left < before:
            break
    return Report(nodes, at, flow, sweeps, left < config.epsilon, left)
