"""Helpers that the training-data operators share: scratch tables, label splits and connected components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import Scratch, shared_root  # noqa: F401

#: White space of the word contracts: space and the ASCII controls 09 to 0D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clean_text(df: DataFrame, column: str = "text") -> Column:
    """The text with null as the empty text."""
    return F.coalesce(df[column], F.lit(""))


def unused(df: DataFrame, *names: str) -> list[str]:
    """A column name for each of names that df does not have: the name itself, or with underscores after it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def held_out(doc_id: Column) -> Column:
    """True for the quarter of the documents that no model may learn from. A null id is never held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def spread(df: DataFrame) -> DataFrame:
    """Deals rows out evenly when the files give fewer partitions than the cluster has cores; else unchanged."""
    least = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= least else df.repartition(2 * least)


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index of each node's component, for nodes 0..n-1 and undirected edges a[i], b[i]."""
    label = np.arange(n)
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped
    return label


def components(scratch: Scratch, edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Connected components of undirected edges (a, b): one row (node, root) per node that has an edge.

    root is the smallest node of the component. Every round points each node at its smallest neighbour,
    shortens the pointers twice, and moves the edges to where they point; what has become a loop goes. A
    path of n nodes needs about log4(n) rounds. No neighbour list is gathered: minima are pre-aggregated,
    and each join has written tables below both its exchanges, so that AQE can split hot nodes.
    """
    scratch.drop("edges0")
    edges = scratch.save(
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges0"
    )
    found: DataFrame | None = None
    for k in range(max_rounds):
        if edges.isEmpty():
            break
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("to"))
        to = scratch.save(to, f"to{k}")
        for turn in range(2):
            hop = to.select(F.col("node").alias("to"), F.col("to").alias("next"))
            to = scratch.save(to.join(hop, "to", "left").select("node", F.coalesce("next", "to").alias("to")), f"to{k}.{turn}")
        ends = edges
        for end in ("a", "b"):
            ends = ends.join(to.select(F.col("node").alias(end), F.col("to").alias(f"to_{end}")), end)
        moved = ends.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).where("a < b")
        edges = scratch.save(moved.distinct(), f"edges{k + 1}")
        if found is None:
            found = to.select("node", F.col("to").alias("root"))
        else:
            hop = to.select(F.col("node").alias("root"), F.col("to").alias("next"))
            found = found.join(hop, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
        found = scratch.save(found, f"found{k}")
        for old in (f"edges{k}", f"to{k}", f"to{k}.0", f"to{k}.1", f"found{k - 1}"):
            scratch.drop(old)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    if found is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return found
