"""Operator 4: language identification by nearest centroids of TF-IDF character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clean_text, held_out, unused
from .quality import sample_hash

LETTERS: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """For each code point its lower-case letter, or 32 where it is no letter; made once a process."""
    if not LETTERS:
        table = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            x = chr(c)
            if x.isalpha():
                low = x.lower()
                table[c] = ord(low) if len(low) == 1 else c
        LETTERS.append(table)
    return LETTERS[0]


def gram_counts(text: str, buckets: int) -> np.ndarray | None:
    """Counts of hashed letter pairs and triples of a whole text, words set off by single spaces; None without letters."""
    codes = letter_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
    letter = codes != 32
    if not letter.any():
        return None
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    body = codes[keep]
    body = body[:-1] if body[-1] == 32 else body
    x = np.concatenate(([np.uint32(32)], body, [np.uint32(32)])).astype(np.uint64)
    pairs = (x[:-1] * np.uint64(0x9E3779B1) + x[1:] * np.uint64(0x85EBCA77)) & np.uint64(0xFFFFFFFF)
    triples = (pairs[:-1] * np.uint64(0xC2B2AE3D) + x[2:] * np.uint64(0x27D4EB2F)) & np.uint64(0xFFFFFFFF)
    both = np.concatenate((pairs, triples))
    both = ((both ^ (both >> np.uint64(15))) * np.uint64(0x2C1B3C6D) & np.uint64(0xFFFFFFFF)) >> np.uint64(12)
    return np.bincount((both % np.uint64(buckets)).astype(np.int64), minlength=buckets)


class CentroidModel:
    """Several unit centroids per language over TF-IDF vectors, with a distance beyond which a text is rejected."""

    def __init__(self, langs: list[str], centroids: np.ndarray, idf: np.ndarray, farthest: np.ndarray):
        self.langs, self.centroids, self.idf, self.farthest = langs, centroids.astype(np.float32), idf.astype(np.float32), farthest
        self.names = sorted(set(langs))
        self.of = np.array([self.names.index(x) for x in langs], dtype=np.int64)

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        x = np.sqrt(counts, dtype=np.float32)
        x *= self.idf
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), np.float32(1e-12))
        return x

    def predict(self, texts: list[str], sharpness: float = 30.0) -> list[tuple[str, float, bool]]:
        """(language, score, rejected) of each text; ('und', 0, True) without a letter."""
        out: list[tuple[str, float, bool]] = [("und", 0.0, True)] * len(texts)
        if not self.names:
            return out
        counts = [gram_counts(t, len(self.idf)) for t in texts]
        some = [i for i, c in enumerate(counts) if c is not None]
        if not some:
            return out
        near = self.vectors(np.stack([counts[i] for i in some])) @ self.centroids.T
        best = np.stack([near[:, self.of == k].max(axis=1) for k in range(len(self.names))], axis=1)
        odds = np.exp(sharpness * (best - best.max(axis=1, keepdims=True)))
        odds /= odds.sum(axis=1, keepdims=True)
        for i, b, p, c in zip(some, best, odds, near.argmax(axis=1), strict=True):
            k = int(self.of[c])
            out[i] = (self.names[k], float(p[k]), bool(1 - b[k] > self.farthest[k]))
        return out


def clusters(x: np.ndarray, k: int, rounds: int = 20, seed: int = 4) -> np.ndarray:
    """Spherical k-means; empty clusters go. The first centre is the mean's nearest row, the next the farthest rows."""
    at = [int((x @ x.mean(axis=0)).argmax())]
    while len(at) < min(k, len(x)):
        at.append(int((x @ x[at].T).max(axis=1).argmin()))
    c = x[at]
    for _ in range(rounds):
        who = (x @ c.T).argmax(axis=1)
        c = np.stack([x[who == j].mean(axis=0) for j in range(len(c)) if (who == j).any()])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def fit_rows(rows: list[tuple[str, str]], buckets: int = 1 << 14, per_language: int = 4, quantile: float = 0.995) -> CentroidModel:
    """Fits on (language, text) rows; rows without a letter are left out, and without rows nothing is ever predicted.

    Counts are kept sparse, and one language at a time is made dense: 64 KiB for each of its sampled rows.
    """
    sparse: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    n, seen = 0, np.zeros(buckets)
    for lang, text in rows:
        counts = gram_counts(text, buckets)
        if counts is not None:
            at = np.flatnonzero(counts)
            sparse.setdefault(lang, []).append((at, counts[at].astype(np.float32)))
            seen[at] += 1
            n += 1
    if not n:
        return CentroidModel([], np.zeros((0, buckets)), np.ones(buckets), np.zeros(0))
    idf = np.log((1 + n) / (1 + seen)) + 1
    model = CentroidModel([], np.zeros((0, buckets)), idf, np.zeros(0))
    langs, centroids, farthest = [], [], []
    for lang in sorted(sparse):
        dense = np.zeros((len(sparse[lang]), buckets), np.float32)
        for row, (at, counts) in zip(dense, sparse[lang], strict=True):
            row[at] = counts
        x = model.vectors(dense)
        c = clusters(x, per_language)
        langs += [lang] * len(c)
        centroids.append(c)
        farthest.append(float(np.quantile(1 - (x @ c.T).max(axis=1), quantile)) + 0.05)
    return CentroidModel(langs, np.concatenate(centroids), idf, np.array(farthest))


def fit(docs: DataFrame, sample_per_language: int = 400, sample_bytes: int = 32 << 10, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", seed: int = 4) -> CentroidModel:
    """Fits on at most sample_per_language rows of each language, of texts of at most sample_bytes bytes.

    Held-out rows and rows without a language teach nothing. The bound holds at any size of the input.
    """
    known = docs.select(docs[id_col].alias("_id"), docs[lang_col].cast("string").alias("_lang"), clean_text(docs, text_col).alias("_text"))
    known = known.where(F.col("_lang").isNotNull() & ~held_out(F.col("_id")) & (F.octet_length("_text") <= sample_bytes))
    sizes = {r["_lang"]: r["count"] for r in known.groupBy("_lang").count().collect()}
    share = F.lit(0.0)
    for lang, n in sorted(sizes.items()):
        share = F.when(F.col("_lang") == lang, F.lit(1.25 * sample_per_language / n)).otherwise(share)
    known = known.withColumn("_at", sample_hash(F.col("_id"), seed)).where(F.col("_at") < share)
    rows = sorted(((r["_lang"], r["_at"], r["_id"], r["_text"]) for r in known.collect()), key=lambda r: (r[0], r[1], str(r[2]), r[3]))
    picked, seen = [], {}
    for lang, _, _, text in rows:
        seen[lang] = seen.get(lang, 0) + 1
        if seen[lang] <= sample_per_language:
            picked.append((lang, text))
    return fit_rows(picked)


def identify_languages(docs: DataFrame, model: CentroidModel, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score (0 to 1) and rejected, from whole texts, row by row.

    lang_pred is the language of the nearest centroid, `und` with score 0 where the text is null or has no letter.
    rejected marks texts farther from it than nearly all training texts of that language; whoever wants no guess
    there takes `und` for them. Of languages that are equally near the first in code point order is taken. Rows are
    judged alone, so repeated rows agree; a long text is counted whole, in memory of a few times its own size. An
    empty table gives an empty result, a model fitted on no rows `und` everywhere. Columns of the added names are
    replaced, all others stay.
    """
    added = ("lang_pred", "score", "rejected")
    others = [c for c in docs.columns if c not in added]
    (letters,) = unused(docs, "lang_text")
    rows = docs.select(*others, clean_text(docs, text_col).alias(letters))
    schema = rows.drop(letters).schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                found = model.predict(part.column(len(others)).to_pylist())
                columns = [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
                yield pa.record_batch([*part.columns[: len(others)], *columns], names=[*others, *added])

    return rows.mapInArrow(predict, schema)
