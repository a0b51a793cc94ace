"""Compression classifier: zstandard dictionaries of good and bad text, one calibrated score.

Dictionaries are trained on good and on bad labelled text, once on the text itself and
once on its shape (letters, capitals and digits each as one sign, so all languages share
it). A text is cut into blocks; every block is compressed with either dictionary, and the
difference of the summed sizes divided by the text's bytes says which side it is nearer
to. A logistic calibration, fitted on labelled texts that are not in the dictionaries,
turns the two differences into a score between 0 and 1.

The fit uses a bounded sample of labelled documents: ``most_rows``, half of them of either
label, in hash order, and one row of each. Each row then counts for as many as its label has rows to a drawn
one, so the score is calibrated to the labels' own shares at every size. Dictionaries
learn ``pieces`` stretches of ``piece_chars`` characters at even distances of a whole
text; calibration and scoring read whole texts, and scoring is one pass without a shuffle.

Edge cases: null or empty text scores the calibrated value of a zero difference;
labels that are null are ignored; without labels of both kinds every score is the
share of good labels (0.5 if there are none); repeated rows score alike; repeated labels
count once, and of rows that share a doc_id the first in hash order is learnt from, so the
fit does not grow with them; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import bounded, chunks, doc_columns


@dataclass(frozen=True)
class FitRules:
    most_rows: int = 6000
    dictionary_bytes: int = 112_640
    segment: int = 256
    pieces: int = 4
    piece_chars: int = 512
    block_bytes: int = 2_048
    level: int = 3


@dataclass(frozen=True)
class Model:
    """Dictionaries and calibration; small and of fixed size, so tasks carry it."""

    dictionaries: tuple[bytes, bytes, bytes, bytes]  # good, bad; good, bad of shapes
    slope: np.ndarray
    block_bytes: int
    level: int

    def compressors(self) -> list:
        return [zstandard.ZstdCompressor(level=self.level, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False) for d in self.dictionaries]

    def differences(self, text: bytes, compressors: list) -> tuple[float, float]:
        """Normalised size differences (positive: nearer to good) of the text and of its shape."""
        out: list[float] = []
        n = len(text)
        for view, (to_good, to_bad) in ((memoryview(text), compressors[:2]), (memoryview(shape(text)), compressors[2:])):
            by = 0
            for at in range(0, n, self.block_bytes):
                part = view[at : at + self.block_bytes]
                by += len(to_bad.compress(part)) - len(to_good.compress(part))
            out.append(by / max(1, n))
        return out[0], out[1]

    def score(self, differences: np.ndarray) -> np.ndarray:
        z = np.clip(design(differences) @ self.slope, -30, 30)
        return 1 / (1 + np.exp(-z))


#: Shape of a byte: letters a, capitals A, digits 0, all others themselves; a byte of a longer character counts as a letter.
SHAPE = bytes(97 if 97 <= b <= 122 or b >= 128 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256))


def shape(text: bytes) -> bytes:
    return text.translate(SHAPE)


def design(differences: np.ndarray) -> np.ndarray:
    """Scaled terms of the calibration."""
    return np.column_stack([np.ones(len(differences)), differences * 20])


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.1, rounds: int = 50) -> np.ndarray:
    """Weighted ridge logistic regression by Newton's method; the constant is not penalised."""
    w = np.zeros(x.shape[1])
    keep = ridge * np.eye(x.shape[1])
    keep[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + keep, x.T @ (weight * (y - p)) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def encoded(texts: pa.Array) -> list[bytes]:
    return [(t or "").encode("utf-8", "replace") for t in texts.to_pylist()]


def dictionary(pieces: list[bytes], rules: FitRules) -> bytes:
    """A trained dictionary; of too little text, the text itself."""
    size = min(rules.dictionary_bytes, sum(map(len, pieces)) // 4)
    try:
        return zstandard.train_dictionary(size, pieces, k=rules.segment, d=8).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"\n".join(pieces)[-rules.dictionary_bytes :] or b"."


def fit(docs: DataFrame, labels: DataFrame, rules: FitRules | None = None) -> Model:
    """A model from the labelled rows of ``labels``; pass only rows that may be learnt from.

    The sample is drawn on the narrow label table and then joined to its texts by a
    broadcast of the drawn ids, whose number is bounded; the texts stay on the executors.
    Repeats go before the draw and after the join, so a drawn id gives one row.
    """
    rules = rules or FitRules()
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).distinct()
    n = {r.quality: r.n for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    blank = Model((b".",) * 4, np.array([math.log((n.get(1, 0) + 1) / (n.get(0, 0) + 1)) if n else 0.0, 0, 0]), rules.block_bytes, rules.level)
    half = rules.most_rows // 2
    parts = [known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(half) for q in (0, 1)]
    drawn = parts[0].unionByName(parts[1]).withColumn("learn", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)) == 0)
    first = F.min(F.struct(F.xxhash64("text").alias("at"), "text"))
    rows = doc_columns(docs).join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "quality", "learn").agg(first["text"].alias("text"))
    # stretches at even distances, one for a short text
    last = F.greatest(F.length("text") - rules.piece_chars, F.lit(0))
    every = F.transform(F.sequence(F.lit(0), F.lit(rules.pieces - 1)), lambda i: F.substring("text", F.floor(i * last / (rules.pieces - 1)).cast("int") + 1, F.lit(rules.piece_chars)))
    whole = F.length("text") <= rules.pieces * rules.piece_chars
    learnt = rows.where("learn").select("doc_id", "quality", F.explode(F.when(whole, F.array("text")).otherwise(every)).alias("piece")).collect()
    sides = {q: [r.piece.encode("utf-8", "replace") for r in sorted(learnt, key=lambda r: (r.doc_id, r.piece)) if r.quality == q and r.piece] for q in (1, 0)}
    if not sides[0] or not sides[1]:
        return blank
    model = Model(tuple(dictionary([f(p) for p in sides[q]], rules) for f in (bytes, shape) for q in (1, 0)), blank.slope, rules.block_bytes, rules.level)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = model.compressors()
        for b in chunks(batches):
            x = np.array([model.differences(t, c) for t in encoded(b.column("text"))]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), pa.array(x[:, 0]), pa.array(x[:, 1])], ["doc_id", "quality", "x", "z"])

    held = sorted(map(tuple, rows.where("NOT learn").select("doc_id", "quality", "text").mapInArrow(measure, "doc_id long, quality int, x double, z double").collect()))
    y = np.array([r[1] for r in held], float)
    if len(set(y)) < 2:
        return blank
    weight = np.where(y > 0, n[1] / (y > 0).sum(), n[0] / (y == 0).sum())
    return Model(model.dictionaries, logistic(design(np.array([r[2:] for r in held])), y, weight * len(y) / weight.sum()), rules.block_bytes, rules.level)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score for every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = model.compressors()
        for b in chunks(batches):
            x = np.array([model.differences(t, c) for t in encoded(b.column("text"))])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(x))], ["doc_id", "score"])

    return doc_columns(docs).mapInArrow(run, "doc_id long, score double")


def select(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``, all columns as they were."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = model.compressors()
        for b in chunks(batches):
            x = np.array([model.differences(t, c) for t in encoded(b.column(at))])
            yield b.filter(pa.array(model.score(x) >= threshold))

    return bounded(docs).withColumn("text", F.coalesce("text", F.lit(""))).mapInArrow(run, docs.schema)
