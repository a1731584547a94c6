"""Operator 9: SimHash fingerprints and near duplicates by searching BK-trees."""

from __future__ import annotations

import math
import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import blocked
from .common import Scratch, clean_text, components, local_components

UPPER = {c: c + 32 for c in range(65, 91)}
#: bytes.split() without an argument splits at exactly space and 09 to 0D.
LOWER = bytes(UPPER.get(c, c) for c in range(256))


def shingle_hashes(text: str, words: int, seed: int = 42) -> Iterator[np.ndarray]:
    """Hashes of a text's word shingles, repeats included, in runs of at most 65,536; fewer words make one shingle."""
    parts = text.encode().translate(LOWER).split()
    if not parts:
        return
    joined = b" ".join(parts)
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        yield np.array([digest(joined, seed)], dtype="<u8")
        return
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    a, b = starts[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist()
    for k in range(0, len(a), 1 << 16):
        yield np.array([digest(joined[x:y], seed) for x, y in zip(a[k : k + (1 << 16)], b[k : k + (1 << 16)], strict=True)], dtype="<u8")


def mixed(h: np.ndarray, turn: int) -> np.ndarray:
    """Another 64 bits of each hash; turn 0 gives the hash itself."""
    if not turn:
        return h
    h = h + np.uint64(turn * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def simhash(runs: Iterable[np.ndarray], width: int) -> list[int]:
    """The SimHash of runs of hashes in `width` words of 64 bits: a bit is 1 if it is set in over half of them; 0 without any."""
    votes, n = np.zeros((width, 64), dtype=np.int64), 0
    for h in runs:
        n += len(h)
        for k in range(width):
            votes[k] += np.unpackbits(mixed(h, k).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return [int.from_bytes(np.packbits(v * 2 > n, bitorder="little").tobytes(), "little") for v in votes]


def fingerprints_of(text: str, shingle_words: int, width: int) -> list[int]:
    """The SimHash of a text's shingles, repeats included."""
    return simhash(shingle_hashes(text, shingle_words), width)


def shingle_set(text: str, words: int) -> np.ndarray:
    """The distinct hashes of a text's word shingles, ascending."""
    return np.unique(np.concatenate([np.zeros(0, "<u8"), *shingle_hashes(text, words)]))


def digest_of(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set of hashes, as two signed longs."""
    return struct.unpack("<qq", xxhash.xxh3_128_digest(hashes.tobytes()))


def fingerprint(text: str, words: int = 4) -> int:
    """The 64-bit SimHash of a text's word shingles."""
    return fingerprints_of(text, words, 1)[0]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of rows."""
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


class Forest:
    """BK-trees over rows of unsigned 64-bit words, built and searched for all trees at once.

    A child hangs below its parent at the integer Hamming distance between them, one child per distance; an item
    that meets a taken distance goes on to that child. Edges are kept as sorted codes parent * 1024 + distance,
    so that the edges within the radius of a query's distance are one contiguous run. Values have at most 15 words.
    """

    def __init__(self, values: np.ndarray, tree: np.ndarray):
        """values: one row, or one number, each; tree: the tree's number of each, ascending; values of a tree are distinct."""
        self.values = values = values.reshape(len(values), -1)
        starts = np.flatnonzero(np.diff(tree, prepend=-1)) if len(tree) else np.zeros(0, np.int64)
        self.root = dict(zip(tree[starts].tolist(), starts.tolist(), strict=True))
        at = np.repeat(starts, np.diff(np.append(starts, len(tree))))
        item = np.setdiff1d(np.arange(len(values)), starts)
        at = at[item]
        codes, children = [], []
        while len(item):
            code = at * 1024 + distances(values[item], values[at])
            new, first, which = np.unique(code, return_index=True, return_inverse=True)
            codes.append(new)
            children.append(item[first])
            at = item[first][which]
            rest = np.ones(len(item), dtype=bool)
            rest[first] = False
            item, at = item[rest], at[rest]
        code = np.concatenate(codes) if codes else np.zeros(0, np.int64)
        order = np.argsort(code)
        self.code = code[order]
        self.child = np.concatenate(children)[order] if codes else np.zeros(0, np.int64)

    def search(self, queries: np.ndarray, root: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query index, item index) within the radius; root: the root item from which each query starts."""
        queries = queries.reshape(len(queries), -1)
        who, at = np.arange(len(queries)), root
        while len(who):
            d = distances(queries[who], self.values[at])
            hit = d <= radius
            yield who[hit], at[hit]
            low = np.searchsorted(self.code, at * 1024 + np.maximum(d - radius, 0))
            n = np.searchsorted(self.code, at * 1024 + np.minimum(d + radius, 1023), "right") - low
            who = np.repeat(who, n)
            at = self.child[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())] if n.sum() else at[:0]


def bands(bits: int, radius: int) -> list[tuple[int, int]]:
    """(shift, width) of radius + 1 bands: fingerprints within the radius agree on one of them."""
    n = radius + 1
    edges = [round(bits * k / n) for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def forest_edges(pdf: pd.DataFrame, radius: int, words: list[str], node: str, step: int = 1 << 19, first: int = 32) -> pd.DataFrame:
    """A spanning forest of the links in whole shards (band, value, bi, bj).

    words: the columns with the fingerprint's words; node: the column that names it. Every block of a shard has one tree;
    rows search their own block's tree, or in a pair of blocks that of the other. The first few rows of each block search
    at once. From then on the component that is the largest of its shard needs no search of its own rows: what links
    them to others is found by the others. So a group of near copies costs its size and not the square of it.
    """
    pdf = pdf.sort_values(["band", "value", "bi", "bj", "block"], kind="stable", ignore_index=True)
    new = (pdf[["band", "value", "bi", "bj"]] != pdf[["band", "value", "bi", "bj"]].shift()).any(axis=1)
    shard = new.cumsum().to_numpy() - 1
    fp = np.column_stack([pdf[c].to_numpy().view(np.uint64) for c in words])
    block, bi, bj = (pdf[c].to_numpy() for c in ("block", "bi", "bj"))
    tree = shard * 2 + ((bi != bj) & (block == bj))
    wanted = np.where(bi == bj, tree, tree ^ 1)
    forest = Forest(fp, tree)
    size = np.bincount(tree, minlength=2 * (shard[-1] + 1) if len(shard) else 0)
    starts = np.cumsum(size) - size
    label = np.arange(len(pdf))

    def search(rows: np.ndarray) -> None:
        nonlocal label
        a, b = [label], [np.arange(len(label))]
        for q, i in forest.search(fp[rows], starts[wanted[rows]], radius):
            a.append(rows[q])
            b.append(i)
        label = local_components(len(label), np.concatenate(a), np.concatenate(b))

    def parts(rows: np.ndarray) -> Iterator[np.ndarray]:
        """Rows in their order, so many at once that they meet about `step` rows of their trees."""
        at = 0
        while at < len(rows):
            end = at + max(1, int(np.searchsorted(np.cumsum(size[wanted[rows[at : at + step]]]), step)))
            yield rows[at:end]
            at = end

    asks = np.flatnonzero(size[wanted] > 0)
    early = asks - starts[tree[asks]] < first
    for part in parts(asks[early]):
        search(part)
    rest = asks[~early]
    if len(rest):
        key, at, n = np.unique(shard * len(pdf) + label, return_index=True, return_counts=True)
        order = np.lexsort((n, key // len(pdf)))
        ends = np.flatnonzero(np.diff(key[order] // len(pdf), append=-1))
        anchor = np.zeros(shard[-1] + 1, dtype=np.int64)
        anchor[key[order][ends] // len(pdf)] = at[order][ends]
        while len(rest := rest[label[rest] != label[anchor[shard[rest]]]]):
            part = next(parts(rest))
            search(part)
            rest = rest[len(part) :]
    names = pdf[node].to_numpy()
    return pd.DataFrame({"a": names, "b": names[label]})[label != np.arange(len(label))]


def fingerprints(df: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, fp) of every row."""

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                fp = np.array([fingerprint(t, words) for t in part.column(1).to_pylist()], dtype=np.uint64)
                yield pa.record_batch([part.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), clean_text(df, text_col).alias("text"))
    return rows.mapInArrow(marked, "id long, fp long")


def set_fingerprints(df: DataFrame, id_col: str, text_col: str, words: int, width: int) -> DataFrame:
    """(id, d0, d1, n, f0, f1, …) of every row: digest, size and SimHash of its shingle set."""
    names = ["id", "d0", "d1", "n", *[f"f{k}" for k in range(width)]]

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(1).to_pylist():
                h = shingle_set(t, words)
                fp = simhash((h[k : k + (1 << 16)] for k in range(0, len(h), 1 << 16)), width)
                rows.append((*digest_of(h), len(h), *np.array(fp, dtype=np.uint64).view(np.int64).tolist()))
            columns = np.array(rows, dtype=np.int64).reshape(-1, len(names) - 1)
            yield pa.record_batch([b.column(0), *(pa.array(np.ascontiguousarray(c)) for c in columns.T)], names=names)

    rows = df.select(F.col(id_col).cast("long").alias("id"), clean_text(df, text_col).alias("text"))
    return rows.mapInArrow(marked, ", ".join(f"{n} long" for n in names))


def sets_of(df: DataFrame, text_col: str, words: int) -> DataFrame:
    """(d0, d1, hashes) of every different shingle set of df."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t, words) for t in b.column(0).to_pylist()]
            digests = np.array([digest_of(h) for h in sets], dtype=np.int64).reshape(-1, 2)
            columns = [*(pa.array(np.ascontiguousarray(c)) for c in digests.T), pa.array([h.tobytes() for h in sets], pa.binary())]
            yield pa.record_batch(columns, names=["d0", "d1", "hashes"])

    return df.select(clean_text(df, text_col).alias("text")).mapInArrow(told, "d0 long, d1 long, hashes binary").dropDuplicates(["d0", "d1"])


def shard_links(rows: DataFrame, words: list[str], node: str, radius: int, block_rows: int, scratch: Scratch | None = None) -> DataFrame:
    """Spanning edges (a, b) of the links in the shards (band, value) of rows; hot shards are cut into block pairs.

    The scratch is that of blocked.
    """
    place = ["band", "value", "bi", "bj"]
    columns = list(dict.fromkeys([node, *words, *place, "block"]))
    shards = blocked(rows, ["band", "value"], node, block_rows, scratch=scratch).select(*columns)
    return edges_by_place(shards, place, lambda pdf: forest_edges(pdf, radius, words, node))


def edges_by_place(rows: DataFrame, place: list[str], edges: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """The edges (a, b) that a function finds in rows, which it gets sorted by place and with no place cut apart."""

    def searched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in batches:
            if not len(pdf):
                continue
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            last = pdf.iloc[-1][place]
            open_ = (pdf[place] == last).all(axis=1)
            rest = pdf[open_]
            if not open_.all():
                yield edges(pdf[~open_])
        if rest is not None:
            yield edges(rest)

    return rows.repartition(*place).sortWithinPartitions(*place).mapInPandas(searched, "a long, b long")


def alike_edges(sets: list[np.ndarray], fp: np.ndarray, block: np.ndarray, similarity: float, first: int = 16) -> list[tuple[int, int]]:
    """A spanning forest (x, y) of the pairs of sets with at least that Jaccard similarity.

    With two different blocks only pairs across them count. Each set is compared with the nearest few by fingerprint
    first, then with all that are not yet in its tree; fingerprints set the order only and exclude no pair.
    """
    size = np.array([len(h) for h in sets], dtype=np.int64)
    code = np.unique(np.concatenate(sets), return_inverse=True)[1]
    start = np.cumsum(size) - size
    across = block.min() != block.max()
    label, mark, out = np.arange(len(sets)), np.zeros(code.max(initial=0) + 1, dtype=bool), []
    for x in range(1, len(sets)):
        fit = np.minimum(size[:x], size[x]) >= similarity * np.maximum(size[:x], size[x]) - 1e-6
        if across:
            fit &= block[:x] != block[x]
        others = np.flatnonzero(fit)
        if not len(others):
            continue
        others = others[np.argsort(distances(fp[others], fp[x]), kind="stable")]
        mine = code[start[x] : start[x] + size[x]]
        mark[mine] = True
        for part in (others[:first], others[first:]):
            part = part[label[part] != label[x]]
            if not len(part):
                continue
            n = size[part]
            ends = np.cumsum(n)
            shared = np.add.reduceat(mark[code[np.repeat(start[part] - ends + n, n) + np.arange(ends[-1])]], ends - n, dtype=np.int64)
            for y in part[shared / (n + size[x] - shared) >= similarity].tolist():
                if label[y] != label[x]:
                    out.append((x, y))
                    label[label == label[y]] = label[x]
        mark[mine] = False
    return out


def verified_edges(pdf: pd.DataFrame, words: list[str], similarity: float) -> pd.DataFrame:
    """Spanning edges of the alike sets in whole groups (root, bi, bj)."""
    at = pdf[["root", "bi", "bj"]].to_numpy()
    new = np.flatnonzero(np.append((at[1:] != at[:-1]).any(axis=1), True)) + 1
    fp = np.column_stack([pdf[c].to_numpy().view(np.uint64) for c in words])
    names, block, hashes = pdf["nid"].to_numpy(), pdf["block"].to_numpy(), pdf["hashes"].to_numpy()
    found, low = [], 0
    for high in new.tolist():
        # a group of two blocks of which one has no rows has nothing to compare
        if high - low > 1 and (at[low, 1] == at[low, 2] or len(np.unique(block[low:high])) == 2):
            sets = [np.frombuffer(h, "<u8") for h in hashes[low:high]]
            found += [(names[low + x], names[low + y]) for x, y in alike_edges(sets, fp[low:high], block[low:high], similarity)]
        low = high
    return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)


def linked(scratch: Scratch, marks: DataFrame, radius: int, block_rows: int) -> DataFrame:
    """One row per distinct fingerprint of marks (id, fp): fp and component_id, the smallest id of its component."""
    nodes = scratch.save(marks.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    keys = [
        F.struct(F.lit(k).alias("band"), F.shiftrightunsigned("fp", s).bitwiseAND(F.lit((1 << w) - 1)).alias("value"))
        for k, (s, w) in enumerate(bands(64, radius))
    ]
    rows = nodes.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.band", "k.value")
    found = components(scratch, shard_links(rows, ["fp"], "fp", radius, block_rows))
    told = nodes.join(found.select(F.col("node").alias("fp"), "root"), "fp", "left")
    told = scratch.save(told.withColumn("root", F.coalesce("root", "fp")), "told")
    # written, so that both sides of the join have an exchange of their own and a hot root can be split
    least = scratch.save(told.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    return scratch.save(told.join(least, "root").select("fp", "component_id"), "components")


def sampled_tables(rows: int, differing: int, total: int, recall: float, shard_rows: int) -> tuple[int, int]:
    """Bits per key and number of keys, such that a pair that differs in that many of `total` bits shares a key with
    probability `recall` or more, and that a shard of unrelated rows keeps about shard_rows rows, at any number of rows.

    The bits of a key are drawn without replacement; pairs that differ in fewer bits share one more often.
    """
    bits = max(12, math.ceil(math.log2(max(2, rows / shard_rows))))
    alike = math.prod((total - differing - k) / (total - k) for k in range(bits))
    return bits, math.ceil(math.log(1 - recall) / math.log1p(-alike))


def sampled_places(bits: int, tables: int, total: int, seed: int) -> np.ndarray:
    """The places of the bits of each table's key, one row a table."""
    return np.random.default_rng(seed).permuted(np.tile(np.arange(total), (tables, 1)), axis=1)[:, :bits]


def rounds(tables: int, most: int) -> list[range]:
    """The tables in as few rounds as there can be with at most so many each, all of about the same size."""
    n = -(-tables // most)
    edges = [round(tables * k / n) for k in range(n + 1)]
    return [range(a, b) for a, b in zip(edges, edges[1:], strict=False)]


def similar_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, recall: float = 0.99, block_rows: int = 4096, seed: int = 9, round_rows: int = 1 << 24) -> DataFrame:
    """One row per row of df: id and component_id, with links between texts of at least that shingle similarity.

    64 bits tell a similarity of 0.8 from unrelated texts only at a radius that no band of them serves; so this form
    takes four words of SimHash, over the distinct shingles. Texts of Jaccard similarity s differ in a share
    acos(2 s / (1 + s)) / pi of the bits, give or take; those that differ in at most that share and 3 standard
    deviations more are candidates. Within the components of the candidates the shingle sets themselves are compared, and
    only pairs of at least the similarity link. Shards are the values of sampled bits, as many tables of them as the recall asks for.
    Tables are searched in rounds, one after the other, each of about round_rows rows or of 24 tables; what a round has dealt
    out is deleted with its end. So the disk that it takes does not grow with the number of tables.
    Null, empty and repeated texts and ids are as in near_duplicates.
    """
    scratch, sure = Scratch(df.sparkSession, "simhash_wide"), Scratch(df.sparkSession, "simhash_sure")
    width = 4
    names, digest = [f"f{k}" for k in range(width)], ["d0", "d1"]
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    total = 64 * width
    radius = round(total * share + 3 * math.sqrt(total * share * (1 - share)))
    marks = scratch.save(set_fingerprints(df, id_col, text_col, words, width), "marks")
    nodes = marks.groupBy(*digest, "n", *names).agg(F.min("id").alias("least")).withColumn("nid", F.monotonically_increasing_id())
    nodes = scratch.save(nodes, "nodes")
    count = nodes.count()
    bits, tables = sampled_tables(count, radius, total, recall, 64)
    places = sampled_places(bits, tables, total, seed)

    def keyed(some: range) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                fp = np.column_stack([pdf[c].to_numpy() for c in names]).astype("<i8")
                ones = np.unpackbits(fp.view(np.uint8).reshape(len(pdf), -1), axis=1, bitorder="little")
                for t in some:
                    yield pdf.assign(band=np.int32(t), value=ones[:, places[t]].astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64)))

        return keys

    longs = ", ".join(f"{n} long" for n in names)
    for some in rounds(tables, max(24, round_rows // max(1, count))):
        rows = nodes.select("nid", *names).mapInPandas(keyed(some), f"nid long, {longs}, band int, value long")
        links = scratch.save(shard_links(rows, names, "nid", radius, block_rows, scratch), "links", "append")
    loose = components(scratch, links)
    scratch.drop("links")
    loose = scratch.save(nodes.join(loose.select(F.col("node").alias("nid"), "root"), "nid"), "loose")

    ids = loose.select(F.col("least").alias("_loose_id")).where("_loose_id IS NOT NULL").distinct()
    texts = df.join(ids, df[id_col].cast("long") == F.col("_loose_id"), "left_semi").select(text_col)
    texts = texts.unionByName(df.where(df[id_col].cast("long").isNull()).select(text_col))
    sets = sets_of(texts, text_col, words)
    # a group holds about two blocks of 256 * block_rows hashes, or of block_rows sets
    held = blocked(loose, ["root"], "nid", block_rows, F.greatest(F.lit(1.0), F.col("n") / 256))
    held = held.select("nid", "root", "bi", "bj", "block", *names, *digest).join(sets, digest).drop(*digest)
    found = components(sure, edges_by_place(held, ["root", "bi", "bj"], lambda pdf: verified_edges(pdf, names, similarity)))

    told = nodes.join(found.select(F.col("node").alias("nid"), "root"), "nid", "left")
    told = scratch.save(told.withColumn("root", F.coalesce("root", "nid")), "told")
    # written, so that both sides of the join have an exchange of their own and a hot root can be split
    least = scratch.save(told.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    told = scratch.save(told.join(least, "root").select(*digest, "component_id"), "components")
    return marks.join(told, digest).select(F.col("id").alias(id_col), "component_id")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, radius: int = 4, block_rows: int = 4096) -> DataFrame:
    """One row per row of df: id, fingerprint (16 lowercase hex digits) and component_id.

    Fingerprints link when they differ in at most `radius` bits, and components follow the links. The distinct
    fingerprints are dealt by radius + 1 bands of bits, one of which any linked pair shares; every band value is a
    shard with a BK-tree, sent to the tasks that search it, and a shard with more than `block_rows` fingerprints is
    cut into block pairs. A tree thus never holds more than about `block_rows` values, however hot the shard is.

    A null text counts as empty; texts without words have fingerprint zero and link like any other. A null id never
    names a component; one whose ids are all null has a null component_id. Rows that repeat an id keep one output
    row each. Other columns of df are not read; an empty table gives an empty result.
    """
    scratch = Scratch(df.sparkSession, "simhash")
    marks = scratch.save(fingerprints(df, id_col, text_col, words), "marks")
    found = linked(scratch, marks, radius, block_rows)
    out = marks.join(found, "fp")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of df whose id is the smallest of their component, with df's columns. Rows with a null id stay.

    Rows that repeat the id of a kept row stay with it.
    """
    found = similar_components(df, id_col, text_col, words, similarity)
    kept = found.where(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias("_kept_id")).distinct()
    named = df.join(kept, df[id_col] == F.col("_kept_id"), "left_semi")
    return named.unionByName(df.where(df[id_col].isNull()))
