"""Operator 2: token ids in patched frame-of-reference files."""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_bpe import byte_letters
from .common import Scratch, clean_text

MAGIC = b"TWPFOR01"
FOOTER = struct.Struct("<QQQQId8s")  # values, blocks, documents, index offset, block length, percentile, magic


class PforWriter:
    """Writes unsigned 32-bit values as patched frame-of-reference blocks to a binary stream.

    A block's minimum is subtracted and the rest is packed at the width that holds the given percentile of the block;
    larger values keep their low bits there and have their positions and high parts in the block's exception list.
    After the blocks come an index (starts, minima, widths, exceptions of the blocks), the documents (id, null flag,
    length) and a footer. Only the index and one chunk of blocks are held in memory.
    """

    def __init__(self, out, block: int = 128, percentile: float = 0.9, chunk_blocks: int = 4096):
        self.out, self.block, self.percentile, self.chunk = out, block, percentile, block * chunk_blocks
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.n_values = 0
        self.at = out.write(MAGIC) and len(MAGIC)
        self.index: list[list[np.ndarray]] = [[], [], [], []]
        self.docs: list[tuple[int | None, int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= self.chunk:
            whole = np.concatenate(self.waiting)
            cut = len(whole) // self.block * self.block
            for k in range(0, cut, self.chunk):
                self._blocks(whole[k : min(cut, k + self.chunk)])
            self.waiting, self.n_waiting = [whole[cut:].copy()], len(whole) - cut

    def _blocks(self, values: np.ndarray) -> None:
        self.n_values += len(values)
        short = -len(values) % self.block
        v = np.concatenate([values, np.full(short, values[-1], np.uint32)]).reshape(-1, self.block).astype(np.uint32)
        least = v.min(axis=1)
        rest = v - least[:, None]
        k = min(self.block - 1, int(self.block * self.percentile))
        typical = np.partition(rest, k, axis=1)[:, k]
        width = np.ceil(np.log2(typical.astype(np.float64) + 1)).astype(np.uint8)
        high = (rest.astype(np.uint64) >> width[:, None].astype(np.uint64)).astype(np.uint32)
        patched = high > 0
        n_patched = patched.sum(axis=1).astype(np.uint16)
        packed = width.astype(np.int64) * self.block // 8
        size = packed + 5 * n_patched.astype(np.int64)
        start = np.cumsum(size) - size
        buffer = np.zeros(int(size.sum()), np.uint8)
        for w in np.unique(width[width > 0]):
            rows = np.flatnonzero(width == w)
            bits = ((rest[rows][:, :, None] >> np.arange(w, dtype=np.uint32)) & 1).astype(np.uint8).reshape(len(rows), -1)
            buffer[start[rows][:, None] + np.arange(int(w) * self.block // 8)] = np.packbits(bits, axis=1, bitorder="little")
        row, column = patched.nonzero()
        if len(row):
            nth = np.arange(len(row)) - np.repeat(np.cumsum(n_patched.astype(np.int64)) - n_patched, n_patched)
            lists = start[row] + packed[row]
            buffer[lists + nth] = column
            at = lists + n_patched[row].astype(np.int64) + 4 * nth
            buffer[at[:, None] + np.arange(4)] = high[row, column].astype("<u4").view(np.uint8).reshape(-1, 4)
        for have, new in zip(self.index, (self.at + start, least, width, n_patched), strict=True):
            have.append(new)
        self.out.write(buffer.tobytes())
        self.at += len(buffer)

    def close(self) -> int:
        if self.n_waiting:
            self._blocks(np.concatenate(self.waiting))
        starts, least, width, patched = (np.concatenate(x) if x else np.zeros(0) for x in self.index)
        ids = [d for d, _ in self.docs]
        parts = [
            starts.astype("<u8"), least.astype("<u4"), width.astype("u1"), patched.astype("<u2"),
            np.array([d or 0 for d in ids], "<i8"), np.array([d is None for d in ids], "u1"), np.array([n for _, n in self.docs], "<u8"),
        ]
        for p in parts:
            self.out.write(p.tobytes())
        self.out.write(FOOTER.pack(self.n_values, len(starts), len(ids), self.at, self.block, self.percentile, MAGIC))
        return self.n_values


class PforReader:
    """Reads what PforWriter wrote; source is a seekable binary file (pyarrow's read_at is not needed)."""

    def __init__(self, source):
        self.source = source
        size = source.seek(0, os.SEEK_END)
        source.seek(size - FOOTER.size)
        self.n_values, blocks, docs, self.end, self.block, _, magic = FOOTER.unpack(source.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        source.seek(self.end)
        tail = source.read(size - FOOTER.size - self.end)
        out, at = [], 0
        for kind, n in (("<u8", blocks), ("<u4", blocks), ("u1", blocks), ("<u2", blocks), ("<i8", docs), ("u1", docs), ("<u8", docs)):
            out.append(np.frombuffer(tail, kind, n, at))
            at += out[-1].nbytes
        self.start, self.least, self.width, self.patched, self.doc_id, self.null_id, self.length = out

    def blocks(self, first: int, last: int) -> np.ndarray:
        """The values of blocks first to last - 1, from one read."""
        low = int(self.start[first])
        high = int(self.start[last]) if last < len(self.start) else self.end
        self.source.seek(low)
        buffer = np.frombuffer(self.source.read(high - low), np.uint8)
        start, width, patched = self.start[first:last].astype(np.int64) - low, self.width[first:last], self.patched[first:last]
        rest = np.zeros((last - first, self.block), np.uint32)
        for w in np.unique(width[width > 0]):
            rows = np.flatnonzero(width == w)
            raw = buffer[start[rows][:, None] + np.arange(int(w) * self.block // 8)]
            bits = np.unpackbits(raw, axis=1, bitorder="little").reshape(len(rows), self.block, int(w))
            out = np.zeros((len(rows), self.block), np.uint32)
            for k in range(int(w)):
                out |= bits[:, :, k].astype(np.uint32) << np.uint32(k)
            rest[rows] = out
        if patched.any():
            n = patched.astype(np.int64)
            row = np.repeat(np.arange(last - first), n)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            lists = start[row] + width[row].astype(np.int64) * self.block // 8
            column = buffer[lists + nth]
            at = lists + n[row] + 4 * nth
            high_part = np.ascontiguousarray(buffer[at[:, None] + np.arange(4)]).view("<u4").ravel()
            rest[row, column] |= (high_part.astype(np.uint64) << width[row].astype(np.uint64)).astype(np.uint32)
        return (rest + self.least[first:last][:, None]).ravel()[: self.n_values - first * self.block]

    def read(self, start: int, count: int) -> np.ndarray:
        """count values from position start; only the blocks that hold them are read."""
        if not count:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (start + count - 1) // self.block + 1
        return self.blocks(first, last)[start - first * self.block :][:count]

    def documents(self, step_blocks: int = 4096) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start, ids) of every document, reading long runs of blocks."""
        ends = np.cumsum(self.length.astype(np.int64))
        held, low = np.zeros(0, np.uint32), 0
        next_block = 0
        for doc_id, null, n, end in zip(self.doc_id.tolist(), self.null_id.tolist(), self.length.tolist(), ends.tolist(), strict=True):
            start = end - n
            if end > low + len(held):
                parts, have = [held[start - low :]], low + len(held)
                while have < end:
                    last = min(len(self.start), next_block + step_blocks)
                    parts.append(self.blocks(next_block, last))
                    have += len(parts[-1])
                    next_block = last
                held, low = np.concatenate(parts), start
            yield None if null else doc_id, start, held[start - low : end - low]


class Remembered(dict):
    """What a function gave for each key that was asked for."""

    def __init__(self, find: Callable[[str], bytes]):
        self.find = find

    def __missing__(self, key: str) -> bytes:
        self[key] = found = self.find(key)
        return found


class WordEncoder:
    """Encodes with the tokenizers library, remembering what it gave for pieces of words.

    The model's normaliser makes every run of white space one space, and its splitter drops that space, so chunks
    between white space are encoded alone. A text of ASCII and Latin-1 letters is lower-cased and cut as the splitter
    cuts it, by one search; each piece that is not remembered goes to the library's merges, its bytes in their letters.
    Any other text is cut into chunks first, which are remembered too: one of plain letters is cut like a text, another
    takes the library's whole way. So does a text that holds the start of a special token's string, or a control that
    Python alone takes for white space. A memory that is full is emptied.
    """

    PLAIN = re.compile("[\x00-\x1b -\x7fÀ-ÖØ-öø-ÿ]*")
    PIECES = re.compile("[a-zß-öø-ÿ]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^a-z0-9ß-öø-ÿ\\s]+")
    WHOLE = re.compile("<\\||[\x1c-\x1f]")
    #: pieces whose bytes are their own letters
    OWN = re.compile("[!-~]+")

    def __init__(self, path: str, most: int = 700_000):
        # workers are as many as cores; threads of the library would only wait for each other
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.most = Tokenizer.from_file(path), most
        self.merges = self.library.model.tokenize
        self.letters = dict(enumerate(byte_letters()))
        self.chunks: dict[str, bytes] = {}
        self.words = Remembered(self._word)

    def _library(self, texts: list[str]) -> list[bytes]:
        found = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        return [struct.pack(f"<{len(ids)}I", *ids) for ids in found]

    def _word(self, piece: str) -> bytes:
        if not self.OWN.fullmatch(piece):
            piece = piece.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.merges(piece)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _plain(self, texts: list[str]) -> list[bytes]:
        """The ids of texts of ASCII and Latin-1 letters."""
        get, find = self.words.__getitem__, self.PIECES.findall
        if len(self.words) > self.most:
            self.words.clear()
        return [b"".join(map(get, find(t.lower()))) for t in texts]

    def _mixed(self, texts: list[str]) -> list[bytes]:
        """The ids of any texts, by their chunks."""
        chunks = self.chunks
        if len(chunks) > self.most:
            chunks.clear()
        cut = [t.split() for t in texts]
        new = set().union(*cut).difference(chunks)
        plain = [c for c in new if self.PLAIN.fullmatch(c)]
        odd = list(new.difference(plain))
        chunks.update(zip(plain, self._plain(plain), strict=True))
        chunks.update(zip(odd, self._library(odd), strict=True))
        get = chunks.__getitem__
        return [b"".join(map(get, parts)) for parts in cut]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        ways: tuple[list[int], ...] = [], [], []
        for i, t in enumerate(texts):
            ways[0 if "<|" not in t and self.PLAIN.fullmatch(t) else 2 if self.WHOLE.search(t) else 1].append(i)
        out = [b""] * len(texts)
        for which, way in zip(ways, (self._plain, self._mixed, self._library), strict=True):
            for i, ids in zip(which, way([texts[i] for i in which]), strict=True):
                out[i] = ids
        return out


ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder a Python worker and file."""
    return ENCODERS.get(path) or ENCODERS.setdefault(path, WordEncoder(path))


def file_count(df: DataFrame, file_bytes: int) -> int:
    """One file for each file_bytes of df by the optimizer's estimate, but no fewer than four for each core as far as each gets a megabyte."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 60:  # nobody knows, as with rows that come from the driver
        size = df.agg(F.sum(F.octet_length("text") + 8)).first()[0] or 0
    return max(1, -(-size // file_bytes), min(4 * df.sparkSession.sparkContext.defaultParallelism, -(-size // (1 << 20))))


def write_token_files(df: DataFrame, folder: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", files: int | None = None, file_bytes: int = 128 << 20) -> DataFrame:
    """Writes the ids of all texts, each followed by end_id, to files in ascending order of the ids of the documents.

    Documents are dealt by ranges of their ids, so that file k holds smaller ids than file k + 1; rows that repeat an
    id follow each other in the order of their texts, and null ids come first. A null text counts as empty. The number
    of files follows the bytes of the input, so that a file's documents and index always fit a worker. Files get
    their final names when they are whole, and a task that runs again writes the same file. Returns (shard, path,
    n_documents, n_values); an empty table gives files without documents, or none. folder must be a place that all
    executors share and pyarrow's file systems know.
    """
    rows = df.select(df[id_col].cast("long").alias("id"), clean_text(df, text_col).alias("text"))
    files = files or file_count(rows, file_bytes)
    rows = rows.repartitionByRange(files, "id").sortWithinPartitions("id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        shard, attempt = context.partitionId(), context.taskAttemptId()
        store, place = fs.FileSystem.from_uri(folder)
        store.create_dir(place, recursive=True)
        path, part = f"{place}/tokens-{shard:06d}.pfor", f"{place}/.tokens-{shard:06d}.{attempt}"
        tail = np.array([end_id], "<u4").tobytes()
        with store.open_output_stream(part) as out:
            writer = PforWriter(out)
            for b in batches:
                for k in range(0, b.num_rows, 512):
                    ids, texts = (c.to_pylist() for c in b.slice(k, 512).columns)
                    for doc_id, raw in zip(ids, encoder(tokenizer).encode(texts), strict=True):
                        writer.add(doc_id, np.frombuffer(raw + tail, "<u4"))
            n = writer.close()
        store.move(part, path)
        yield pa.record_batch([pa.array([shard], pa.int32()), pa.array([path]), pa.array([len(writer.docs)], pa.int64()), pa.array([n], pa.int64())], names=["shard", "path", "n_documents", "n_values"])

    return rows.mapInArrow(write, "shard int, path string, n_documents long, n_values long")


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """(id, start, n_tokens, ids binary) of every document in the files of a manifest; start counts over all files."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_values").over(before), F.lit(0)))
    placed = placed.repartition(max(1, manifest.count()), "shard")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        names = ["id", "start", "n_tokens", "ids"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for b in batches:
            for path, base in zip(b.column("path").to_pylist(), b.column("base").to_pylist(), strict=True):
                part, size = [], 0
                with store.open_input_file(path) as source:
                    for doc_id, start, ids in PforReader(source).documents():
                        part.append((doc_id, base + start, len(ids), ids.astype("<u4").tobytes()))
                        size += len(part[-1][3]) + 50
                        if size > 4 << 20:
                            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*part, strict=True), kinds, strict=True)], names=names)
                            part, size = [], 0
                if part:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*part, strict=True), kinds, strict=True)], names=names)

    return placed.select("path", "base").mapInArrow(read, "id long, start long, n_tokens long, ids binary")


def token_files(df: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes df's token files below the shared folder and reads them back: one row per document, see read_token_files."""
    scratch = Scratch(df.sparkSession, "token_files")
    folder = f"{scratch.root}/files"
    folder = folder if "://" in folder or folder.startswith("/") else re.sub("^file:/+", "file:///", folder)
    manifest = scratch.save(write_token_files(df, folder, tokenizer, end_id, id_col, text_col), "manifest")
    return read_token_files(manifest, folder)


