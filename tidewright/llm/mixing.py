"""Operator 10: mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Only DataFrame and SQL functions run here. A block is a document; a source's blocks are in the order of a keyed
digest, which is a fixed random permutation. The source's quota is the number of its blocks that meet its target: whole
passes over them, a partial pass, and one closing block that brings the sum nearest to the target. A binary tree over
the output shards splits the quotas of all sources at every node by a multivariate-hypergeometric draw with exact
margins, and the leaves' quotas cut the passes into disjoint runs of the permuted blocks: what a shard draws, and so
what the mix takes of a document, is what lies between the ends of its runs. Documents are never sorted or shuffled
as a whole: bins of the digest are counted, and only the bins that hold the end of a run are ordered.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, unused


def bin_digits(blocks: int) -> int:
    """Hex digits of the digest that name a bin, such that a source has about as many bins as a bin has blocks."""
    return max(1, math.ceil(math.log(max(2, blocks), 16) / 2))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def block_key(doc_id: Column, size: Column, seed: int) -> Column:
    """A block's place in the permutation. Rows equal in id and size share a key and are drawn together."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), size.cast("string"), F.lit(f":{seed}")))


def targets(sizes: DataFrame, weights: list[int], share: float, most: int) -> DataFrame:
    """sizes (source, source_size, blocks) with target, in words, by filling up to the cap.

    Sources by code point, null last, weigh `weights`, repeating. Those whose cap (most times their size) lies
    below their share stop there and the excess is shared anew by weight, until none is above: the fixed point
    is target = min(cap, level x weight), found here in the order of cap by weight.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8")))
    at = sizes.withColumn("place", rank - 1).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod("place", F.lit(len(weights))).cast("int") + 1).cast("long"))
    at = at.withColumn("cap", F.col("source_size") * most)
    order = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    below = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    whole = F.sum("source_size").over(Window.partitionBy()) * share
    at = at.withColumn("level", (whole - below) / rest)
    at = at.withColumn("open", F.col("cap") > F.col("level") * F.col("weight"))
    level = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), F.col("place"), F.col("level")))).over(Window.partitionBy())["level"]
    return at.withColumn("target", F.when(F.col("open"), level * F.col("weight")).otherwise(F.col("cap").cast("double"))).select(
        "source", "place", "blocks", "source_size", "target"
    )


def same_source(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def ordered_bins(blocks: DataFrame, digits: int) -> DataFrame:
    """(source, bin, words_before, blocks_before, words, blocks): counts of the bins and of what lies before them."""
    bins = blocks.groupBy("source", F.substring("key", 1, digits).alias("bin")).agg(F.sum("words").alias("words"), F.count(F.lit(1)).alias("blocks"))
    before = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    return bins.withColumns({"words_before": F.coalesce(F.sum("words").over(before), F.lit(0)), "blocks_before": F.coalesce(F.sum("blocks").over(before), F.lit(0))})


def plan_sources(scratch: Scratch, blocks: DataFrame, goal: DataFrame, digits: int) -> DataFrame:
    """goal with passes (whole ones), cutoff (last key of the partial pass), closing (key or null) and draws, the quota in blocks."""
    whole = goal.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int"))
    whole = scratch.save(whole.withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")), "whole")
    bins = ordered_bins(blocks, digits).alias("b")
    need = whole.select(F.col("source").alias("s"), "rest").where("rest > 0")
    edge = bins.join(need, same_source("source", "s")).where("words_before <= rest AND rest < words_before + words").drop("s")
    edge = edge.select(F.col("source").alias("s"), F.col("bin").alias("at"), "rest", "words_before", "blocks_before")
    inner = blocks.join(edge, same_source("source", "s") & (F.substring("key", 1, digits) == F.col("at")))
    run = Window.partitionBy("s", "at").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    inner = inner.withColumns({"through": F.col("words_before") + F.sum("words").over(run), "blocks_through": F.col("blocks_before") + F.count(F.lit(1)).over(run)})
    cut = inner.groupBy(F.col("s"), F.col("at")).agg(
        F.max(F.when(F.col("through") <= F.col("rest"), F.col("key"))).alias("cutoff"),
        F.coalesce(F.max(F.when(F.col("through") <= F.col("rest"), F.col("through"))), F.first("words_before")).alias("drawn"),
        F.coalesce(F.max(F.when(F.col("through") <= F.col("rest"), F.col("blocks_through"))), F.first("blocks_before")).alias("drawn_blocks"),
    )
    cut = cut.select("s", F.coalesce("cutoff", F.col("at")).alias("cutoff"), "drawn", "drawn_blocks")
    planned = scratch.save(whole.join(cut, same_source("source", "s"), "left").drop("s"), "cut")
    gap = F.col("rest") - F.col("drawn")
    late = blocks.select(F.col("source").alias("s"), "key", "words").join(planned.select("source", "cutoff", gap.alias("gap")), same_source("s", "source"))
    late = late.where((F.col("key") > F.col("cutoff")) & (F.abs(F.col("words") - F.col("gap")) < F.col("gap")))
    close = late.groupBy("s").agg(F.min(F.struct(F.abs(F.col("words") - F.col("gap")).alias("off"), "key"))["key"].alias("closing"))
    planned = planned.join(close, same_source("source", "s"), "left").drop("s")
    draws = F.col("passes") * F.col("blocks") + F.coalesce("drawn_blocks", F.lit(0)) + F.col("closing").isNotNull().cast("long")
    return scratch.save(planned.select("source", "place", "blocks", "source_size", "target", "passes", "cutoff", "closing", draws.cast("long").alias("draws")), "plan")


def hypergeometric(total: str, marked: str, taken: str, u: str) -> str:
    """SQL for the number of marked blocks among `taken` of `total`, at the quantile u.

    The inverse of the distribution function, whose terms are summed over mean +- 10 standard deviations (what lies
    beyond weighs less than a double's last digit), at any size: even 10^11 blocks give runs of some 10^6 terms. The
    margins hold: max(0, taken + marked - total) <= x <= min(taken, marked).
    """
    n, k, m = f"CAST({total} AS DOUBLE)", f"CAST({marked} AS DOUBLE)", f"CAST({taken} AS DOUBLE)"
    low, high = f"greatest(0L, {taken} + {marked} - {total})", f"least({taken}, {marked})"
    mean = f"({m} * {k} / greatest({n}, 1D))"
    spread = f"sqrt(greatest({mean} * ({n} - {k}) / greatest({n}, 1D) * ({n} - {m}) / greatest({n} - 1, 1D), 0D))"
    first = f"greatest({low}, CAST(floor({mean} - 10 * {spread}) AS BIGINT) - 2)"
    last = f"least({high}, CAST(ceil({mean} + 10 * {spread}) AS BIGINT) + 2)"
    ratio = f"(({k} - j) * ({m} - j) / ((j + 1D) * ({n} - {k} - {m} + j + 1D)))"
    run = f"CASE WHEN {last} > {first} THEN sequence({first}, {last} - 1) ELSE CAST(array() AS ARRAY<BIGINT>) END"
    whole = f"aggregate({run}, named_struct('w', 1D, 's', 1D), (a, j) -> named_struct('w', a.w * {ratio}, 's', a.s + a.w * {ratio}), a -> a.s)"
    return (
        f"CASE WHEN {high} <= {low} THEN {low} ELSE aggregate({run}, named_struct('w', 1D, 's', 1D, 'x', {first}, 't', {whole}),"
        f" (a, j) -> named_struct('w', a.w * {ratio}, 's', a.s + a.w * {ratio}, 'x', CASE WHEN a.s < {u} * a.t THEN j + 1 ELSE a.x END, 't', a.t), a -> a.x) END"
    )


def splitting_tree(plan: DataFrame, shards: int, seed: int) -> DataFrame:
    """(source, shard, until): the last position, counted from 1, of each shard's run of the source's draws.

    One row per tree node carries the draws of all sources as an array, ordered by place. A node over h shards gives
    its left child floor(h / 2) / h of its draws; the sources' parts are drawn one after the other, each given what
    the earlier ones left, which is the multivariate-hypergeometric distribution. A path of nodes sums exactly.
    """
    row = plan.agg(F.sort_array(F.collect_list(F.struct("place", "draws"))).alias("p")).select(
        F.transform("p", lambda x: x["draws"]).alias("counts"), F.lit(0).alias("shard"), F.lit(shards).alias("span"), F.lit("r").alias("path")
    )
    span = shards
    while span > 1:
        row = row.withColumn("total", F.expr("aggregate(counts, 0L, (a, x) -> a + x)"))
        row = row.withColumn("want", F.expr("CAST(floor(total * (span div 2) / span) AS BIGINT)"))
        u = f"((pmod(xxhash64(path, size(s.got), {seed}), 4503599627370496) + 0.5D) / 4503599627370496D)"
        draw = hypergeometric("s.total", "x", "s.want", u)
        fold = (
            "aggregate(counts, named_struct('got', CAST(array() AS ARRAY<BIGINT>), 'total', total, 'want', want),"
            f" (s, x) -> transform(array({draw}), d -> named_struct('got', concat(s.got, array(d)), 'total', s.total - x, 'want', s.want - d))[0], s -> s.got)"
        )
        row = row.withColumn("left", F.when(F.col("span") > 1, F.expr(fold)).otherwise(F.col("counts")))
        halves = F.array(
            F.struct(F.col("left").alias("counts"), F.col("shard"), F.greatest(F.lit(1), F.expr("span div 2")).alias("span"), F.concat("path", F.lit("l")).alias("path")),
            F.struct(
                F.expr("transform(counts, (x, i) -> x - left[i])").alias("counts"),
                F.expr("shard + span div 2").alias("shard"),
                F.expr("span - span div 2").alias("span"),
                F.concat("path", F.lit("r")).alias("path"),
            ),
        )
        kept = F.when(F.col("span") > 1, halves).otherwise(F.slice(halves, 1, 1))
        row = row.select(F.explode(kept).alias("n")).select("n.*")
        span = -(-span // 2)
    quota = row.select("shard", F.posexplode("counts").alias("place", "quota"))
    until = F.sum("quota").over(Window.partitionBy("place").orderBy("shard"))
    return quota.select("shard", F.col("place").alias("p"), until.alias("until")).join(plan.select("source", "place"), F.col("p") == F.col("place")).select("source", "shard", "until")


def shard_bounds(scratch: Scratch, blocks: DataFrame, plan: DataFrame, tree: DataFrame, digits: int) -> DataFrame:
    """(source, bounds): for each shard the code of the last draw that goes to it or an earlier one.

    A draw's code is the number of its pass followed by its key, so that codes are ordered as the draws are. The
    closing block, which is always the last draw, has the code of the cutoff followed by '!', which comes before all keys beyond it.
    """
    ends = tree.join(plan.select(F.col("source").alias("s"), "passes", "blocks", "draws", "closing", "cutoff"), same_source("source", "s")).drop("source")
    ends = ends.withColumn("closes", F.col("closing").isNotNull() & (F.col("until") == F.col("draws")))
    ends = ends.withColumn("turn", F.when((F.col("until") > 0) & (F.col("blocks") > 0), F.expr("(until - 1) div blocks")).otherwise(F.lit(0)).cast("int"))
    ends = scratch.save(ends.withColumn("place", F.col("until") - F.col("turn") * F.col("blocks")), "ends")
    bins = ordered_bins(blocks, digits).select("source", "bin", "blocks_before", F.col("blocks").alias("inside"))
    hits = bins.join(ends.where("until > 0 AND NOT closes").select("s", "shard", "place"), same_source("source", "s"))
    hits = hits.where("blocks_before < place AND place <= blocks_before + inside").select("s", "shard", "place", "bin", "blocks_before")
    wanted = hits.select("s", "bin", "blocks_before").distinct().withColumnsRenamed({"s": "hs", "bin": "hbin"})
    inner = blocks.join(wanted, same_source("source", "hs") & (F.substring("key", 1, digits) == F.col("hbin")))
    nth = F.row_number().over(Window.partitionBy("hs", "hbin").orderBy("key"))
    inner = inner.select("hs", F.col("key").alias("found_key"), (F.col("blocks_before") + nth).alias("found_place"))
    found = hits.join(inner, same_source("s", "hs") & (F.col("place") == F.col("found_place"))).select(F.col("s").alias("fs"), F.col("shard").alias("fshard"), "found_key")
    all_ = ends.join(found, same_source("s", "fs") & (F.col("shard") == F.col("fshard")), "left")
    code = F.when(F.col("until") <= 0, F.lit("")).when(F.col("closes"), closing_code("passes", "cutoff")).otherwise(F.concat(F.col("turn").cast("string"), "found_key"))
    packed = all_.groupBy("s").agg(F.sort_array(F.collect_list(F.struct("shard", code.alias("code")))).alias("c"))
    return packed.select(F.col("s").alias("source"), F.expr("transform(c, x -> x.code)").alias("bounds"))


def closing_code(passes: str, cutoff: str) -> Column:
    return F.concat(F.col(passes).cast("string"), F.col(cutoff), F.lit("!"))


def mix(
    df: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    most: int = 2,
    shards: int = 8,
    seed: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """df with size, source_size, target, taken and drawn_shards (the output shard of each draw of the row).

    size is the number of words of the text, 0 for null. The mix takes whole documents; a source's taken words miss
    its target by less than half of the document that would close the gap best, and a row is drawn at most `most`
    times. Rows that are equal in id and size are one block and are drawn together. A null
    source is a source like any other, the last in order; a null id is permuted as an empty one. The same rows give the
    same mix in any order and partitioning. An empty table gives an empty result, columns of the added names are
    replaced, and all others stay.
    """
    scratch = Scratch(df.sparkSession, "mixing")
    size = word_count(df[text_col])
    narrow = df.select(F.col(source_col).cast("string").alias("source"), df[id_col].alias("id"), size.alias("size"))
    narrow = narrow.select("source", "size", block_key(F.col("id"), F.col("size"), seed).alias("key"))
    blocks = scratch.save(narrow.groupBy("source", "key").agg(F.sum("size").alias("words")), "blocks")
    sizes = blocks.groupBy("source").agg(F.sum("words").alias("source_size"), F.count(F.lit(1)).alias("blocks"))
    goal = scratch.save(targets(sizes, list(weights), share, most), "targets")
    digits = bin_digits(goal.agg(F.max("blocks")).first()[0] or 0)
    plan = plan_sources(scratch, blocks, goal, digits)
    bounds = shard_bounds(scratch, blocks, plan, splitting_tree(plan, shards, seed), digits)
    told = plan.join(bounds.withColumnRenamed("source", "bs"), same_source("source", "bs"), "left")
    rows = df.withColumn("size", size)
    its, key, codes = unused(rows.withColumns(dict.fromkeys(("source_size", "target", "drawn_shards", "taken"), F.lit(0))), "its", "key", "codes")
    told = scratch.save(told.select(F.struct("source", "source_size", "target", "passes", "closing", "bounds", closing_code("passes", "cutoff").alias("code")).alias(its)), "told")
    rows = rows.withColumn(key, block_key(F.col(id_col), F.col("size"), seed))
    rows = rows.join(told, F.col(source_col).cast("string").eqNullSafe(F.col(f"{its}.source")))
    turns = F.transform(F.sequence(F.lit(0), F.col(f"{its}.passes")), lambda p: F.concat(p.cast("string"), F.col(key)))
    last = F.array_compact(F.array(F.when(F.col(key) == F.col(f"{its}.closing"), F.col(f"{its}.code"))))
    # the shards' runs end with the last shard's: what lies beyond is not drawn
    rows = rows.withColumn(codes, F.filter(F.concat(turns, last), lambda c: c <= F.element_at(F.col(f"{its}.bounds"), -1)))
    rows = rows.withColumns({
        "source_size": F.col(f"{its}.source_size"),
        "target": F.col(f"{its}.target"),
        "drawn_shards": F.expr(f"transform(`{codes}`, c -> size(filter(`{its}`.bounds, b -> b < c)))"),
    })
    return rows.withColumn("taken", F.size("drawn_shards") * F.col("size")).drop(its, key, codes)


def mixed_rows(df: DataFrame, shards: int = 8, seed: int = 20, id_col: str = "doc_id", **options) -> DataFrame:
    """The mix itself: a row of df for each draw with its shard, dealt by shard and shuffled within it.

    The added column is named shard, with an underscore after it where df has one of that name.
    """
    out = mix(df, shards=shards, seed=seed, id_col=id_col, **options)
    shard, draw = unused(df, "shard", "draw")
    out = out.select(*df.columns, F.posexplode("drawn_shards").alias(draw, shard))
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(shard), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(draw)))
    return out.repartition(shard, F.substring(order, 1, 2)).sortWithinPartitions(shard, order).drop(draw)
