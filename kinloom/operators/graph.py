"""The overlap graph: a node for each read, an edge for each overlap; and its reduction."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import FUZZ, few_or_all, written
from . import adjacency
from .numbering import numbered

OPPOSITE = 16  # flag of an edge between opposite strands


@dataclass(frozen=True)
class Graph:
    """nodes: id, length_bp, copy_count, cn_conf, read_support, consensus. edges: edge_idx (their order),
    src, dst, read_support, vaf, vaf_conf, flags. Parallel edges and self-loops are allowed. adjacent: the edges
    packed (adjacency.py), where they were built from overlaps; edges are then made from it each time they are read."""

    nodes: DataFrame
    edges: DataFrame
    adjacent: DataFrame | None = None


def node_columns(df: DataFrame) -> DataFrame:
    """Fills what is missing of a node's columns with defaults."""
    default = {"copy_count": F.lit(1), "cn_conf": F.lit(1.0).cast("float"), "read_support": F.lit(0), "consensus": F.lit("")}
    kinds = {"id": "long", "length_bp": "long", "copy_count": "int", "cn_conf": "float", "read_support": "long", "consensus": "string"}
    return df.select(*[(F.col(c) if c in df.columns else default[c]).cast(k).alias(c) for c, k in kinds.items()])


def edge_columns(df: DataFrame) -> DataFrame:
    default = {"read_support": F.lit(1), "vaf": F.lit(1.0), "vaf_conf": F.lit(0.0), "flags": F.lit(0)}
    kinds = {"edge_idx": "long", "src": "long", "dst": "long", "read_support": "long", "vaf": "float", "vaf_conf": "float", "flags": "int"}
    return df.select(*[(F.col(c) if c in df.columns else default[c]).cast(k).alias(c) for c, k in kinds.items()])


def numbered_reads(reads: DataFrame, id_col: str = "read_id", length_col: str = "length_bp") -> DataFrame:
    """(read_id, length_bp, node): nodes are numbered by read id."""
    return written(numbered(reads.select(F.col(id_col).cast("long").alias("read_id"), F.col(length_col).cast("long").alias("length_bp")), ["read_id"], "node"), "nodes")


def build_graph(reads: DataFrame, overlaps: DataFrame, id_col: str = "read_id", length_col: str = "length_bp") -> tuple[Graph, DataFrame]:
    """The graph, and (read_id, node). Nodes are numbered by read id; overlaps of unknown reads are left out."""
    ids = numbered_reads(reads, id_col, length_col)
    nodes = node_columns(ids.select(F.col("node").alias("id"), "length_bp", F.lit(1).alias("read_support")))
    # Nodes are in the order of the reads' ids. Edges are packed as they come, sorted and numbered packed.
    packed = adjacency.adjacent(both_known(overlaps, ids).select(F.col("node_a").alias("src"), F.col("node_b").alias("dst"), "strand"))
    return Graph(nodes, unpacked(packed), packed), ids.select("read_id", "node")


def unpacked(packed: DataFrame, whole: DataFrame | None = None) -> DataFrame:
    """The edges of packed rows; they are numbered among those of `whole`."""
    return edge_columns(adjacency.expanded(packed, whole).select("edge_idx", "src", "dst", (F.col("strand") * OPPOSITE).alias("flags")))


def both_known(overlaps: DataFrame, ids: DataFrame) -> DataFrame:
    """Overlaps with both reads' nodes, node_a and node_b. The nodes are broadcast where they are few, as overlaps are many."""
    of = lambda c: ids.select(F.col("read_id").alias(f"read_{c}"), F.col("node").alias(f"node_{c}"))
    return overlaps.join(few_or_all(of("a")), "read_a").join(few_or_all(of("b")), "read_b")


def degrees(graph: Graph) -> DataFrame:
    """(id, n_out, n_in) of every node, parallel edges counted."""
    ends = graph.edges.select(F.inline(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))))
    none = graph.nodes.select("id", F.lit(0).alias("o"), F.lit(0).alias("i"))
    return none.unionByName(ends).groupBy("id").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))


def contained(graph: Graph) -> DataFrame:
    """(id) of nodes with a strictly longer predecessor that has an edge to each of their successors (other
    than itself). Containment is transitive and lengths strictly rise, so one pass finds them all. Packed edges are compared
    in arrays; the joins make a row for every two successive edges, which few nodes of many edges make very many."""
    if graph.adjacent is not None:
        return adjacency.contained(graph.adjacent, graph.nodes)
    pairs = graph.edges.select("src", "dst").distinct()
    length = graph.nodes.select("id", "length_bp")
    by = pairs.where("src <> dst").join(length.select(F.col("id").alias("src"), F.col("length_bp").alias("p")), "src").join(length.select(F.col("id").alias("dst"), F.col("length_bp").alias("v")), "dst")
    candidates = by.where("p > v").select("src", "dst")
    following = pairs.select(F.col("src").alias("dst"), F.col("dst").alias("w"))
    needed = candidates.join(following, "dst").where("w <> src")
    lacking = needed.join(pairs.select("src", F.col("dst").alias("w")), ["src", "w"], "left_anti").select("src", "dst").distinct()
    return candidates.join(lacking, ["src", "dst"], "left_anti").select(F.col("dst").alias("id")).distinct()


def transitive(graph: Graph, fuzz: int = FUZZ) -> DataFrame:
    """(edge_idx) of edges a to c that a way over a node b of at most `fuzz` bases makes redundant; of parallel
    edges the last. (That the direct length be within fuzz of the sum of both is that condition on b.)"""
    # Only edges at short nodes are joined, and of the others only those that a way goes beside are looked at.
    short = few_or_all(written(graph.nodes.where(F.col("length_bp") <= fuzz).select(F.col("id").alias("b")), "short"))
    into = graph.edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).join(short, "b").distinct()
    onward = graph.edges.select(F.col("src").alias("b"), F.col("dst").alias("c")).join(short, "b").distinct()
    ways = written(into.join(onward, "b").where("c <> a AND c <> b").select("a", "c").distinct(), "ways")
    beside = graph.edges.select(F.col("src").alias("a"), F.col("dst").alias("c"), "edge_idx").join(few_or_all(ways, 1 << 17), ["a", "c"], "left_semi")
    return beside.groupBy("a", "c").agg(F.max("edge_idx").alias("edge_idx")).select("edge_idx")


def filter_graph(graph: Graph, drop_contained: bool = True, reduce_transitive: bool = True, fuzz: int = FUZZ) -> tuple[Graph, dict[str, int]]:
    """Drops the edges at contained nodes, then transitive edges. Nodes keep their numbers. Returns the graph
    and the counts before and after."""
    before = graph.edges.count() if graph.adjacent is None else graph.adjacent.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    stats = {"edges_before": before, "nodes_dropped_contained": 0, "transitive_edges_removed": 0}
    edges = graph.edges
    if drop_contained:
        gone = written(contained(graph), "contained")
        stats["nodes_dropped_contained"] = gone.count()
        at = lambda c: few_or_all(gone.select(F.col("id").alias(c)))
        if graph.adjacent is None:
            edges = edges.join(at("src"), "src", "left_anti")
        else:
            edges = unpacked(graph.adjacent.join(at("src"), "src", "left_anti"), graph.adjacent)
        edges = edges.join(at("dst"), "dst", "left_anti")
        edges = written(edge_columns(edges), "kept-edges")
    if reduce_transitive:
        gone = written(transitive(Graph(graph.nodes, edges), fuzz), "transitive")
        stats["transitive_edges_removed"] = gone.count()
        edges = written(edge_columns(edges.join(gone, "edge_idx", "left_anti")), "kept-edges")
    stats["edges_after"] = edges.count()
    return Graph(graph.nodes, edges), stats


def read_paths(reads: DataFrame, read_to_node: DataFrame, overlaps: DataFrame, length_col: str = "length_bp") -> DataFrame:
    """(read_id, read_length, path): the read's own node, then those of its partners by offset and number;
    partners that come twice stay twice."""
    partners = both_known(overlaps, read_to_node).select(F.inline(F.array(F.struct(F.col("read_a").alias("read_id"), F.col("offset_a").alias("o"), F.col("node_b").alias("n")), F.struct(F.col("read_b").alias("read_id"), F.col("offset_b").alias("o"), F.col("node_a").alias("n")))))
    lists = partners.groupBy("read_id").agg(F.array_sort(F.collect_list(F.struct("o", "n"))).alias("p"))
    own = reads.select(F.col("read_id").cast("long").alias("read_id"), F.col(length_col).cast("long").alias("read_length")).join(read_to_node, "read_id", "left")
    path = F.concat(F.array_compact(F.array("node")), F.coalesce(F.transform("p", lambda x: x["n"]), F.array().cast("array<bigint>")))
    return own.join(lists, "read_id", "left").select("read_id", "read_length", path.alias("path"))


def reads_of_nodes(paths: DataFrame) -> DataFrame:
    """The other way round: (node, read_id), a row for each time a read's path visits the node."""
    return paths.select(F.explode("path").alias("node"), "read_id")


def visits_of_nodes(read_to_node: DataFrame, partners: DataFrame) -> DataFrame:
    """(node, n, low, high): how often the reads' paths visit each node, the least and the greatest of those reads. A path visits its
    read's own node and those of the read's partners, so a node is visited once by its own read and once for each overlap of it."""
    met = read_to_node.join(partners, "read_id", "left")
    return met.select("node", (F.coalesce("n", F.lit(0)) + 1).alias("n"), F.least("read_id", "low").alias("low"), F.greatest("read_id", "high").alias("high"))
