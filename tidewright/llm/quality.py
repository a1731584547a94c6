"""Operator 3: a compression classifier of text quality."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import clean_text, held_out, unused


class CompressionModel:
    """Two zstandard dictionaries, of good and of bad text, and a logistic calibration of one number.

    A text is compressed with either dictionary in chunks, each from a fresh state, so that the dictionary counts as
    much at the end of a long text as at its start. The number is the difference of the compressed sizes, normalised by
    the raw size: what a byte of the text saves with the good dictionary against the bad one. Text that repeats one
    word shrinks alike with both and lies near zero, far below good text.
    """

    def __init__(self, good: bytes, bad: bytes, weights: np.ndarray, prior: float, chunk: int, level: int = 3):
        """weights: the calibration's constant and its slope over the difference."""
        self.good, self.bad, self.weights, self.prior, self.chunk, self.level = good, bad, weights, prior, chunk, level
        self._ready = None

    def __getstate__(self):
        return self.__dict__ | {"_ready": None}

    def _compressors(self):
        if self._ready is None:
            self._ready = [
                zstandard.ZstdCompressor(level=self.level, dict_data=zstandard.ZstdCompressionDict(d), write_checksum=False, write_content_size=False, write_dict_id=False)
                for d in (self.good, self.bad)
            ]
        return self._ready

    def difference(self, text: str) -> float:
        """(compressed size with the bad dictionary - with the good one) / raw size; 0 for the empty text."""
        raw = text.encode()
        good, bad = (sum(len(c.compress(raw[k : k + self.chunk])) for k in range(0, len(raw), self.chunk)) for c in self._compressors())
        return (bad - good) / max(1, len(raw))

    def scores(self, texts: list[str]) -> np.ndarray:
        z = self.weights[0] + self.weights[1] * np.array([self.difference(t) for t in texts])
        p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        return np.where([not t for t in texts], self.prior, p)


def dictionaries(classes: list[list[str]], common: set[str], size: int) -> list[bytes]:
    """A zstandard dictionary of each class of texts without the common lines, all of the same number of bytes.

    Trained ones are as large as the smallest class allows; raw content where training has too little.
    """
    pieces = []
    for texts in classes:
        raw = ["\n".join(line for line in t.split("\n") if line not in common).encode() for t in texts]
        pieces.append([t[k : k + 1024] for t in raw for k in range(0, len(t), 1024) if len(t) - k >= 8])
    try:
        # without k and d the library tries several and often ends after a few kilobytes
        found = [zstandard.train_dictionary(size, p, k=400, d=8).as_bytes() for p in pieces]
        least = min(map(len, found))
        found = [d if len(d) == least else zstandard.train_dictionary(least, p, k=400, d=8).as_bytes() for d, p in zip(found, pieces, strict=True)]
        if {len(d) for d in found} == {least}:
            return found
    except (zstandard.ZstdError, ValueError):
        pass
    whole = [b"".join(p) for p in pieces]
    least = min(size, *map(len, whole))
    return [x[len(x) - least :] if least >= 8 else b"\n" * 8 for x in whole]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01, rounds: int = 200) -> np.ndarray:
    """Ridge logistic regression by damped Newton steps; the first weight is the constant.

    Each step is halved until the loss falls enough, so the fit converges from any sample; an error if it does not.
    """
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.sum(np.logaddexp(0, z) - y * z) + ridge / 2 * w @ w)

    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        slope = x.T @ (p - y) + ridge * w
        if np.abs(slope).max() <= 1e-8 * len(y):
            return w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), slope)
        t = 1.0
        while (then := loss(w - t * step)) > now - 1e-4 * t * (slope @ step):
            t /= 2
            if t < 1e-12:
                return w
        w, now = w - t * step, then
    raise RuntimeError("the calibration did not converge")


def fit_rows(rows: list[tuple[int, str]], sizes: dict[int, int] | None = None, dictionary_bytes: int = 112 << 10, chunk: int = 1024) -> CompressionModel:
    """Fits on (quality, text) rows in their order: every other text goes to the dictionaries, the rest to the calibration.

    A text that a class repeats counts once, so that no copy of a dictionary's text calibrates it. Lines that several
    texts of the dictionary half share say nothing about quality and are left out. Both dictionaries have the same size,
    so that neither wins by its own. sizes, the classes' numbers of labelled rows where rows is a sample, set the
    calibration's prior odds. With rows of one class, or none, every score is the smoothed share of class 1.
    """
    ones, zeros = (sizes.get(1, 0), sizes.get(0, 0)) if sizes else (sum(q == 1 for q, _ in rows), sum(q == 0 for q, _ in rows))
    prior = float((ones + 1) / (ones + zeros + 2))
    different = {q: list(dict.fromkeys(t for c, t in rows if c == q and t)) for q in (0, 1)}
    shown = {q: different[q][::2] for q in (0, 1)}
    kept = [(q, t) for q in (0, 1) for t in different[q][1::2]]
    lines = Counter(line for q in (0, 1) for t in shown[q] for line in set(t.split("\n")))
    common = {line for line, n in lines.items() if n > 1}
    good, bad = dictionaries([shown[1], shown[0]], common, dictionary_bytes)
    model = CompressionModel(good, bad, np.array([np.log(prior / (1 - prior)), 0.0]), prior, chunk)
    y = np.array([q for q, _ in kept], dtype=np.float64)
    if len(set(y.tolist())) < 2:
        return model
    x = np.array([model.difference(t) for _, t in kept])
    center, scale = float(x.mean()), float(x.std()) + 1e-9
    w = logistic(((x - center) / scale)[:, None], y)
    drawn = y.mean()
    model.weights += [w[0] - np.log(drawn / (1 - drawn)) - w[1] * center / scale, w[1] / scale]
    return model


def sample_hash(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) by which rows are sampled; it does not depend on order or partitions."""
    return F.pmod(F.xxhash64(doc_id.cast("string"), F.lit(seed)), F.lit(1 << 40)) / (1 << 40)


def fit(docs: DataFrame, labels: DataFrame, sample_per_class: int = 4000, sample_bytes: int = 32 << 10, id_col: str = "doc_id", text_col: str = "text", seed: int = 3) -> CompressionModel:
    """Fits on at most sample_per_class rows of either class, of texts of at most sample_bytes bytes each.

    That bound (and 1/4 more, which the hash threshold may let through before the cut) is all that reaches the
    driver, at any size of the input. The sampled ids and labels, no more than so many rows, are broadcast to the
    documents, whose texts are not shuffled. Rows that are held out, or whose label is not 0 or 1, teach nothing.
    """
    known = labels.select(labels[id_col].cast("long").alias("_id"), labels["quality"].alias("_quality")).where("_quality IN (0, 1)")
    known = known.where(~held_out(F.col("_id"))).dropDuplicates(["_id"])
    sizes = {r["_quality"]: r["count"] for r in known.groupBy("_quality").count().collect()}
    share = F.lit(0.0)
    for q, n in sizes.items():
        share = F.when(F.col("_quality") == q, F.lit(1.25 * sample_per_class / n)).otherwise(share)
    known = known.withColumn("_at", sample_hash(F.col("_id"), seed)).where(F.col("_at") < share)
    texts = docs.select(docs[id_col].cast("long").alias("_id"), clean_text(docs, text_col).alias("_text"))
    texts = texts.where(F.octet_length("_text") <= sample_bytes)
    rows = sorted((r["_at"], r["_id"], r["_quality"], r["_text"]) for r in texts.join(F.broadcast(known), "_id").collect())
    picked = [x for q in (0, 1) for x in [r for r in rows if r[2] == q][:sample_per_class]]
    return fit_rows([(q, t) for _, _, q, t in sorted(picked)], sizes)


def score_quality(docs: DataFrame, model: CompressionModel, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """docs with score (0 to 1, likelier good when higher) and predicted (1 where the score reaches the threshold).

    Whole texts are scored, row by row and in chunks, so that long texts need no more memory than themselves, and
    repeated rows score alike. A null or empty text gets the training share of good rows; a score that ties with the
    threshold is predicted good; an empty table gives an empty result. Columns named score or predicted are replaced,
    all others stay.
    """
    others = [c for c in docs.columns if c not in ("score", "predicted")]
    (text,) = unused(docs, "scored_text")
    rows = docs.select(*others, clean_text(docs, text_col).alias(text))
    schema = rows.drop(text).schema.add("score", "double").add("predicted", "integer")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                p = model.scores(part.column(len(others)).to_pylist())
                yield pa.record_batch([*part.columns[: len(others)], pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))], names=[*others, "score", "predicted"])

    return rows.mapInArrow(score, schema)
