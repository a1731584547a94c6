"""Operator 8: exact duplicates owned by the terminal nodes of Patricia tries."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clean_text, unused


def shared_prefix(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by bisection over slice comparisons."""
    least = min(len(a), len(b))
    if a[:least] == b[:least]:
        return least
    low, high = 0, least
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class Node:
    __slots__ = ("edge", "down", "owner")

    def __init__(self, edge: bytes, owner: list | None = None):
        self.edge, self.down, self.owner = edge, {}, owner


class PatriciaTrie:
    """A radix trie over whole byte strings. A terminal node's owner is [smallest id, largest id, rows].

    Edges hold runs of bytes, so that a trie of n strings has fewer than 2 n nodes. spill() gives up the
    heaviest subtree, whose strings then come as partial owners that another trie merges.
    """

    def __init__(self):
        self.root, self.bytes = Node(b""), 0

    def insert(self, text: bytes, low: int | None, high: int | None, rows: int) -> None:
        node, rest = self.root, text
        while rest:
            child = node.down.get(rest[0])
            if child is None:
                node.down[rest[0]] = child = Node(rest)
                self.bytes += len(rest) + 200
                node, rest = child, b""
                break
            if rest.startswith(child.edge):
                node, rest = child, rest[len(child.edge) :]
                continue
            k = shared_prefix(rest, child.edge)
            fork = Node(child.edge[:k])
            child.edge = child.edge[k:]
            fork.down[child.edge[0]] = child
            node.down[rest[0]] = fork
            self.bytes += 200
            node, rest = fork, rest[k:]
        if node.owner is None:
            node.owner = [low, high, rows]
        else:
            own = node.owner
            own[0] = low if own[0] is None or (low is not None and low < own[0]) else own[0]
            own[1] = high if own[1] is None or (high is not None and high > own[1]) else own[1]
            own[2] += rows

    def walk(self, top: Node | None = None, prefix: bytes = b"") -> Iterator[tuple[bytes, list]]:
        todo = [(top or self.root, prefix)]
        while todo:
            node, before = todo.pop()
            text = before + node.edge
            if node.owner is not None:
                yield text, node.owner
            todo += [(x, text) for x in node.down.values()]

    def spill(self) -> list[tuple[bytes, list]]:
        """Takes the root's heaviest subtree out and returns its strings with their owners."""
        sizes = {k: sum(len(t) + 200 for t, _ in self.walk(x)) for k, x in self.root.down.items()}
        if not sizes:
            return []
        heavy = max(sizes, key=sizes.get)
        self.bytes = max(0, sum(sizes.values()) - sizes[heavy])
        return list(self.walk(self.root.down.pop(heavy)))


OWNED = pa.schema([("n_bytes", pa.int64()), ("hash", pa.int64()), ("text", pa.string()), ("low", pa.int64()), ("high", pa.int64()), ("rows", pa.int64())])


def told(found: list[tuple[int, int, bytes, list]]) -> pa.RecordBatch:
    n, h, t, own = zip(*found, strict=True)
    text = pa.array(t, pa.binary()).cast(pa.string())
    return pa.record_batch([pa.array(n, pa.int64()), pa.array(h, pa.int64()), text, *(pa.array([o[i] for o in own], pa.int64()) for i in range(3))], schema=OWNED)


def sent(found: list, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of a few megabytes."""
    part, size = [], 0
    for x in found:
        part.append(x)
        size += len(x[2])
        if size >= most:
            yield told(part)
            part, size = [], 0
    if part:
        yield told(part)


def values(batch: pa.RecordBatch, step: int = 256) -> Iterator[tuple]:
    """The batch's rows, of which only some at a time are Python objects."""
    for k in range(0, batch.num_rows, step):
        yield from zip(*(c.to_pylist() for c in batch.slice(k, step).columns), strict=True)


def combine(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    """Partial owners of a partition: one trie per (length, hash); beyond the budget, heavy subtrees leave first."""
    tries: dict[tuple[int, int], PatriciaTrie] = {}
    held = 0
    for batch in batches:
        for text, low, key in values(batch):
            raw = text.encode()
            at = (len(raw), key)
            trie = tries.get(at) or tries.setdefault(at, PatriciaTrie())
            held -= trie.bytes
            trie.insert(raw, low, low, 1)
            held += trie.bytes
        if held > budget:
            out = []
            for at in sorted(tries, key=lambda k: -tries[k].bytes):
                if held <= budget // 2:
                    break
                held -= tries[at].bytes
                out += [(*at, t, own) for t, own in tries[at].spill()]
                held += tries[at].bytes
                if not tries[at].root.down and tries[at].root.owner is None:
                    del tries[at]
            yield from sent(out)
    yield from sent([(*at, t, own) for at, trie in tries.items() for t, own in trie.walk()])


OWNERS = pa.schema([("sha", pa.string()), ("size", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("rows", pa.int64())])


def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Owners of whole partitions sorted by (length, hash): a trie lives until its key ends, and then tells all."""
    at, trie, out = None, PatriciaTrie(), []

    def ended() -> list:
        return [(hashlib.sha256(t).hexdigest(), len(t), *own) for t, own in trie.walk()]

    def batch(rows: list) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), OWNERS, strict=True)], schema=OWNERS)

    for b in batches:
        for n, h, text, low, high, rows in values(b):
            if at != (n, h):
                out += ended()
                at, trie = (n, h), PatriciaTrie()
            trie.insert(text.encode(), low, high, rows)
        if len(out) > 20_000:
            yield batch(out)
            out = []
    out += ended()
    if out:
        yield batch(out)


def owners(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = 48 << 20) -> DataFrame:
    """One row per distinct text: sha, size (bytes), low and high (smallest and largest id), rows."""
    rows = df.select(clean_text(df, text_col).alias("text"), F.col(id_col).cast("long").alias("id"))
    rows = rows.withColumn("hash", F.xxhash64("text"))
    partial = rows.mapInArrow(lambda x: combine(x, budget), "n_bytes long, hash long, text string, low long, high long, rows long")
    dealt = partial.repartition("n_bytes", "hash").sortWithinPartitions("n_bytes", "hash")
    return dealt.mapInArrow(merge, "sha string, size long, low long, high long, rows long")


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", budget: int = 48 << 20) -> DataFrame:
    """df with keep_id, group_size, kept and text_sha256 for the groups of byte-wise equal texts.

    Partitions of length and content hash insert whole texts into Patricia tries, whose terminal nodes hold the
    owners. Each input partition combines its own copies first, so that a text which makes up a third of all
    rows leaves a partition once; a task holds at most `budget` bytes of tries and gives up heavy subtrees as partial
    owners. `keep` chooses the smallest (default) or largest id of a group.

    A null text counts as empty. A null id owns nothing unless all of a group's ids are null; keep_id is then null
    and its rows stay. Rows that repeat an id and a text stand or fall together. Existing columns of the added names
    are replaced; an empty table gives an empty result.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    added = df.withColumns(dict.fromkeys(("keep_id", "group_size", "kept", "text_sha256"), F.lit(0)))
    sha, size, its, low, rows = unused(added, "sha", "size", "its", "low", "rows")
    own = owners(df, id_col, text_col, budget).select(
        F.col("sha").alias(sha), F.col("size").alias(size), F.col("low" if keep == "smallest" else "high").alias(low), F.col("rows").alias(rows)
    )
    text = clean_text(df, text_col)
    here = df.withColumn(its, F.struct(F.sha2(text, 256).alias("sha"), F.octet_length(text).cast("long").alias("size")))
    out = here.join(own, (F.col(f"{its}.sha") == F.col(sha)) & (F.col(f"{its}.size") == F.col(size)))
    out = out.withColumns({
        "keep_id": F.col(low).cast(df.schema[id_col].dataType),
        "group_size": F.col(rows),
        "kept": F.col(low).eqNullSafe(F.col(id_col).cast("long")),
        "text_sha256": F.col(sha),
    })
    return out.drop(sha, size, its, low, rows)
