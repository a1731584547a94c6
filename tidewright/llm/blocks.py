"""Similarity joins by shared bucket keys, with hot buckets cut into blocks.

Rows that share a (table, key) bucket are compared. A bucket of more than `most` rows is cut into blocks by
a hash of the row's id, and every pair of blocks becomes a group of its own: no task sees more than two blocks,
no row and no pair is dropped, and no pair is ever emitted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def blocked(rows: DataFrame, keys: list[str], node: str, most: int, weight: Column | None = None, scratch: Scratch | None = None) -> DataFrame:
    """rows with the columns block, bi and bj: the row's own block and the pair of blocks that a group holds.

    Rows of a bucket with at most `most` rows get block = bi = bj = 0. The counts are pre-aggregated; only
    the hot buckets, at most 1 in `most` rows, are joined back. With a weight, a row counts as that many rows. With a
    scratch the hot buckets are written first, so that Spark knows their size and does not deal out the rows to join a few.
    """
    hot = rows.groupBy(*keys).agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("n_rows")).where(F.col("n_rows") > most)
    hot = hot.select(*keys, F.ceil(F.col("n_rows") / most).cast("int").alias("n_blocks"))
    hot = hot if scratch is None else scratch.save(hot, "hot")
    out = rows.join(hot, keys, "left").withColumn("n_blocks", F.coalesce("n_blocks", F.lit(1)))
    out = out.withColumn("block", F.pmod(F.xxhash64(node, F.lit(7)), F.col("n_blocks")).cast("int"))
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    return out.withColumns({"bi": F.least("block", "other"), "bj": F.greatest("block", "other")}).drop("n_blocks", "other")
