"""Operator 1: near-duplicate embeddings by random-hyperplane sign hashing, exact cosine and components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import blocked
from .common import Scratch, components, local_components


def plan_tables(most_rows: int, threshold: float, recall: float, bucket_rows: int) -> tuple[int, int]:
    """Bits per table and number of tables.

    Bits grow with the logarithm of the largest label's rows, so that a bucket of unrelated vectors keeps about
    `bucket_rows` rows. Two vectors at the threshold share a bit with probability 1 - angle / pi; the number of
    tables is the least that finds such a pair with probability `recall`, at any size.
    """
    bits = min(62, max(2, math.ceil(math.log2(max(1, most_rows) / bucket_rows)) if most_rows > bucket_rows else 2))
    hit = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - hit))


def hyperplanes(dim: int, bits: int, tables: int, seed: int) -> np.ndarray:
    """The normals, made anew from the seed by whoever needs them."""
    return np.random.default_rng([seed, dim]).standard_normal((dim, tables * bits))


def bucket_keys(unit: np.ndarray, bits: int, tables: int, seed: int, step: int = 256) -> np.ndarray:
    """The bucket number of each row (n x dim) in each table (n x tables, int64).

    Rows are multiplied in blocks of one shape, the last one filled up with zeros, so that a row's signs do not depend
    on the rows that come with it.
    """
    planes, powers = hyperplanes(unit.shape[1], bits, tables, seed), 1 << np.arange(bits, dtype=np.int64)
    out = np.empty((len(unit), tables), dtype=np.int64)
    block = np.zeros((step, unit.shape[1]))
    for k in range(0, len(unit), step):
        n = min(step, len(unit) - k)
        block[:n], block[n:] = unit[k : k + n], 0
        out[k : k + n] = ((block @ planes)[:n] >= 0).reshape(n, tables, bits) @ powers
    return out


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def near_duplicates(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = 0.93,
    recall: float = 0.9995,
    bucket_rows: int = 1024,
    block_rows: int = 4096,
    seed: int = 17,
) -> DataFrame:
    """One row per row of df: id, label, n_links, component_id, kept.

    Two vectors link when their labels are equal and not null and their cosine, in double precision, reaches the
    threshold. Equal vectors of a label are joined to one class first, so copies cost one row however many they
    are; a class is known by 128 bits of hash, so that vectors are shuffled once for it and once for each table. Classes
    meet in the buckets of several tables of sign bits, as bytes of the type that they came in; within a bucket every
    pair is verified exactly by matrix products, counted at the first table in which it meets, and reduced to the
    links' number per class and a spanning forest before it leaves the task.

    Vectors that are null, empty, zero or hold a null or non-finite component, and rows with a null label, link with
    nothing: 0 links, their own id as component, kept. Vectors of different lengths never link. Rows that repeat an
    id each count as a vector of their own. A null id never names a component; kept is id = component_id with null
    equal to null. An empty table gives an empty result. Other columns of df are not read.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "embedding_dedup")
    kind = "float" if df.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    dtype = np.dtype("<f4" if kind == "float" else "<f8")
    ok = F.col("label").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0)
    finite = ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast(f"array<{kind}>").alias("vector"))
    rows = rows.withColumn("ok", F.coalesce(ok & finite & F.exists("vector", lambda x: x != 0), F.lit(False)))
    same = ["label", "h0", "h1"]
    rows = rows.withColumns({"h0": F.xxhash64("vector"), "h1": F.xxhash64(F.lit(seed), F.reverse("vector"))})
    classes = rows.where("ok").groupBy(*same).agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector"))
    classes = scratch.save(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    most = classes.groupBy("label", F.size("vector")).count().agg(F.max("count")).first()[0] or 0
    bits, tables = plan_tables(most, threshold, recall, bucket_rows)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = b.column("vector")
            sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(sizes).tolist():
                part = b.take(pa.array(np.flatnonzero(sizes == dim)))
                n = part.num_rows
                x = part.column("vector").flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(n, dim)
                keys = bucket_keys(unit_rows(x), bits, tables, seed)
                raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(dim * dtype.itemsize), n, [None, pa.py_buffer(x.tobytes())]).cast(pa.binary())
                dims = pa.array(np.full(n, dim, np.int32))
                for t in range(tables):
                    place = [dims, pa.array(np.full(n, t, np.int32)), pa.array(np.ascontiguousarray(keys[:, t]))]
                    yield pa.record_batch([part.column("cid"), part.column("label"), part.column("copies"), raw, *place], names=["cid", "label", "copies", "raw", "dim", "tab", "bucket"])

    def verified(pdf: pd.DataFrame) -> pd.DataFrame:
        own, bi, bj = pdf["block"].to_numpy(), pdf["bi"].iat[0], pdf["bj"].iat[0]
        left, right = np.flatnonzero(own == bi), np.flatnonzero(own == bj)
        unit = unit_rows(np.frombuffer(b"".join(pdf["raw"]), dtype).reshape(len(pdf), -1))
        copies, table_no = pdf["copies"].to_numpy(), pdf["tab"].iat[0]
        links = np.zeros(len(pdf), dtype=np.int64)
        keys, keyed = np.zeros((len(pdf), table_no), dtype=np.int64), np.zeros(len(pdf), dtype=bool)
        a, b = [], []
        for k in range(0, len(left), 256):
            near = unit[left[k : k + 256]] @ unit[right].T >= threshold
            if bi == bj:
                near = np.triu(near, k + 1)
            x, y = near.nonzero()
            x, y = left[k + x], right[y]
            if table_no and len(x):
                ends = np.unique(np.concatenate((x, y)))
                ends = ends[~keyed[ends]]
                keys[ends], keyed[ends] = bucket_keys(unit[ends], bits, tables, seed)[:, :table_no], True
                new = (keys[x] != keys[y]).all(axis=1)
                x, y = x[new], y[new]
            np.add.at(links, x, copies[y])
            np.add.at(links, y, copies[x])
            a.append(x)
            b.append(y)
        root = local_components(len(pdf), np.concatenate([np.zeros(0, np.int64), *a]), np.concatenate([np.zeros(0, np.int64), *b]))
        some = links > 0
        cid = pdf["cid"].to_numpy()
        return pd.DataFrame({"cid": cid[some], "links": links[some], "root": cid[root[some]]})

    label_type = classes.schema["label"].dataType.simpleString()
    met = classes.select("cid", "label", "vector", "copies").mapInArrow(
        hashed, f"cid long, label {label_type}, copies long, raw binary, dim int, tab int, bucket long"
    )
    keys = ["label", "dim", "tab", "bucket"]
    links = blocked(met, keys, "cid", block_rows).groupBy(*keys, "bi", "bj").applyInPandas(verified, "cid long, links long, root long")
    links = scratch.save(links, "links")
    counts = links.groupBy("cid").agg(F.sum("links").alias("links"))
    roots = components(scratch, links.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    told = classes.drop("vector").join(counts, "cid", "left").join(roots.withColumnRenamed("node", "cid"), "cid", "left")
    told = scratch.save(told.withColumn("root", F.coalesce("root", "cid")), "told")
    # written, so that both sides of the join have an exchange of their own and a hot root can be split
    least = scratch.save(told.groupBy("root").agg(F.min("first").alias("least")), "least")
    told = told.join(least, "root").select(*same, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "least")
    told = scratch.save(told, "result")
    out = rows.drop("vector").alias("r").join(told.alias("t"), [F.col("ok"), *(F.col(f"r.{c}") == F.col(f"t.{c}") for c in same)], "left")
    component = F.when(F.col("ok"), F.col("least")).otherwise(F.col("id"))
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        component.eqNullSafe(F.col("id")).alias("kept"),
        F.col("r.label").alias(label_col),
    )
