"""Bubbles: parallel ways from an entry to an exit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import MAX_ALT_PATH, written
from .graph import Graph


def adjacency(graph: Graph) -> DataFrame:
    """(src, k, dst, read_support, n_out): edges with their ordinal at the source."""
    by = Window.partitionBy("src")
    return graph.edges.select("src", "dst", "read_support", (F.row_number().over(by.orderBy("edge_idx")) - 1).alias("k"), F.count("*").over(by).alias("n_out"))


def reach(adj: DataFrame, starts: DataFrame, max_steps: int = MAX_ALT_PATH) -> DataFrame:
    """(start, node, path, support): for every node within the steps, the walk that a depth-first search that
    takes the last edge first comes along first. A walk's rank is the list of its negated ordinals, compared
    from the front, a prefix first; of walks of one length to one node only the first is kept, which bounds
    them by the nodes in reach."""
    empty = F.array().cast("array<bigint>")
    now = starts.select(F.col("start"), F.col("start").alias("node"), empty.alias("ord"), empty.alias("path"), F.lit(0).cast("long").alias("support"))
    levels = []
    for _ in range(max_steps):
        step = now.join(adj.select(F.col("src").alias("node"), "k", "dst", "read_support"), "node")
        step = step.select("start", F.col("dst").alias("node"), F.concat("ord", F.array(-F.col("k").cast("long"))).alias("ord"), F.concat("path", F.array("dst")).alias("path"), (F.col("support") + F.col("read_support")).alias("support"))
        first = step.groupBy("start", "node").agg(F.min(F.struct("ord", "path", "support")).alias("w"))
        now = written(first.select("start", "node", "w.*"), "walks")
        if now.isEmpty():
            break
        levels.append(now)
    every = reduce(DataFrame.unionByName, levels) if levels else now
    return every.where("node <> start").groupBy("start", "node").agg(F.min(F.struct("ord", "path", "support")).alias("w")).select("start", "node", "w.path", "w.support")


def detect_bubbles(graph: Graph, max_alt_path: int = MAX_ALT_PATH) -> DataFrame:
    """(entry, exit, total_read_support, alts): alts, sorted by nodes, are (nodes, support); nodes begin with
    the entry's successor and end with the exit. The bubble's support is that of the first edges of its two
    last ways. An exit is reached from two successors or more and is neither of them, nor the entry."""
    adj = written(adjacency(graph), "adjacency")
    opening = adj.where("n_out >= 2").select(F.col("src").alias("entry"), "k", F.col("dst").alias("start"), "read_support")
    within = reach(adj, opening.select("start").distinct(), max_alt_path)
    ways = opening.join(within, "start").where("node <> entry")
    alt = F.struct(F.concat(F.array("start"), F.col("path")).alias("nodes"), (F.col("read_support") + F.col("support")).alias("support"))
    ways = ways.select("entry", F.col("node").alias("exit"), "k", "read_support", alt.alias("alt"))
    last = F.slice(F.sort_array(F.collect_list(F.struct("k", "read_support")), False), 1, 2)
    met = ways.groupBy("entry", "exit").agg(last.alias("last"), F.collect_list("alt").alias("alts"), F.count("*").alias("n")).where("n >= 2")
    # Of equal node lists with other supports the one of most support stays.
    ranked = F.array_sort("alts", lambda a, b: F.when(a["nodes"] < b["nodes"], -1).when(a["nodes"] > b["nodes"], 1).when(a["support"] > b["support"], -1).when(a["support"] < b["support"], 1).otherwise(0))
    met = met.withColumn("alts", ranked)
    unique = F.filter("alts", lambda x, i: (i == 0) | (F.get(F.col("alts"), i - 1)["nodes"] != x["nodes"]))
    return met.select("entry", "exit", F.aggregate("last", F.lit(0).cast("long"), lambda s, x: s + x["read_support"]).alias("total_read_support"), unique.alias("alts"))
