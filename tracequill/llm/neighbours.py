"""Quality by nearest-neighbour voting over latent-semantic vectors.

A bounded sample of labelled rows (``MAX_LABELLED``, the smallest hashes of
doc_id) gives the fit: hashed byte trigrams and binned shape terms of whole texts,
weighted by inverse document frequency, and their first ``DIMS`` singular
directions. The sample's vectors (at most MAX_LABELLED x DIMS floats, 0.8 MB) and the
projection are broadcast. Every document is projected, its cosine with every
labelled vector is computed in blocks, and its K nearest vote with weight
max(0, cosine) ** SHARPNESS. All that tie with the K-th nearest vote too, so the order
of the sample decides nothing. Blocks are filled up to one shape and scores
rounded to ``DIGITS``, so equal texts have equal scores wherever they stand.

Labels, lang, source and doc_id are no inputs of a score. Defined results: null
text is empty and scored by its shape terms; labelled rows with a null label are no
labels; a doc_id labelled twice has the mean label, 1 from 0.5 up; no usable label
gives 0.5 everywhere; no similar neighbour gives the sample's share of ones; an
empty table gives an empty result; extra columns are ignored; repeated rows have a
row each; a long text is read whole, in steps of ``_STEP`` bytes.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAMS = 2048
MAX_LABELLED = 4096
DIMS = 48
K = 15
SHARPNESS = 4
SHAPE_WEIGHT = 0.3
BLOCK = 512
#: Cosines that differ by less are a tie.
TIE = 1e-6
DIGITS = 6
_STEP = 1 << 20
_BINS = (
    (0.02, 0.05, 0.1, 0.3, 0.6),  # share of words equal to the one before
    (0.2, 0.4, 0.6, 0.8, 1.0),  # distinct words against what the length lets expect
    (0.01, 0.03, 0.06, 0.1, 0.2),  # share of symbol bytes
    (0.02, 0.05, 0.1, 0.3, 0.6),  # share of capitals
    (2, 4, 6, 8, 10),  # log2 of words
    (0.02, 0.05, 0.1, 0.3, 0.6),  # share of lines seen before
)
SIZE = GRAMS + 6 * len(_BINS)


def features(text: bytes) -> np.ndarray:
    """Square roots of trigram counts, then one shape term for each of the measures."""
    counts = np.zeros(GRAMS, np.int64)
    raw = np.frombuffer(text, np.uint8)
    for lo in range(0, max(0, len(raw) - 2), _STEP):
        b = raw[lo : lo + _STEP + 2].astype(np.uint32)
        mixed = b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(0x2C1B3C6D)
        counts += np.bincount(mixed >> np.uint32(21), minlength=GRAMS)
    words = text.split()
    n, size = len(words), max(1, len(text))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    measures = (
        sum(map(operator.eq, words, words[1:])) / max(1, n - 1),
        len(set(words)) / max(1, n) ** 0.85,
        (len(text) - len(text.translate(None, b"#*$%&|<>!"))) / size,
        (len(text) - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))) / size,
        np.log2(1 + n),
        1 - len(set(lines)) / max(1, len(lines)),
    )
    out = np.zeros(SIZE, np.float32)
    out[:GRAMS] = np.sqrt(counts)
    for k, (value, edges) in enumerate(zip(measures, _BINS, strict=True)):
        out[GRAMS + 6 * k + int(np.searchsorted(edges, value))] = SHAPE_WEIGHT * np.sqrt(size)
    return out


def _rows_normed(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(1e-12, np.linalg.norm(x, axis=1, keepdims=True))


class Voters:
    """The fitted projection with the labelled vectors."""

    def __init__(self, x: np.ndarray, labels: np.ndarray, dims: int = DIMS):
        n = len(x)
        self.labels = labels.astype(np.float32)
        self.idf = (np.log((1 + n) / (1 + (x > 0).sum(axis=0))) + 1).astype(np.float32)
        weighted = _rows_normed(x * self.idf)
        dims = min(dims, n)
        y = weighted @ np.random.default_rng(1).standard_normal((x.shape[1], dims + 16)).astype(np.float32)
        for _ in range(3):
            y = weighted @ (weighted.T @ np.linalg.qr(y)[0])
        base = np.linalg.qr(y)[0]
        self.directions = np.linalg.svd(base.T @ weighted, full_matrices=False)[2][:dims].T.astype(np.float32)
        self.vectors = _rows_normed(weighted @ self.directions)

    def project(self, x: np.ndarray) -> np.ndarray:
        return _rows_normed(_rows_normed(x * self.idf) @ self.directions)

    def score(self, x: np.ndarray, k: int = K) -> np.ndarray:
        cosines = self.project(x) @ self.vectors.T
        k = min(k, len(self.vectors))
        least = np.partition(cosines, cosines.shape[1] - k, axis=1)[:, [cosines.shape[1] - k]]
        weight = np.where(cosines >= least - TIE, np.maximum(0, cosines), 0).astype(np.float64) ** SHARPNESS
        total = weight.sum(axis=1)
        votes = (weight * self.labels).sum(axis=1)
        return np.clip(np.where(total > 0, votes / np.maximum(total, 1e-12), self.labels.mean()), 0.0, 1.0)


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``limit`` labelled documents that aren't held out.

    Of several texts under one doc_id the one with the least hash counts.
    """
    chosen = (
        labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(limit)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [features(x.as_py() or b"").astype(np.float16).tobytes() for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(vectors, pa.binary())], ["doc_id", "label", "x"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    # At most ``limit`` rows of 12 bytes: a proven bound.
    least = F.min_by("text", F.struct(F.xxhash64("text"), F.col("text"))).alias("text")
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(least)
    rows = sorted(found.mapInArrow(run, "doc_id long, label int, x binary").collect())
    x = np.array([np.frombuffer(r.x, np.float16) for r in rows], np.float32).reshape(len(rows), SIZE)
    return x, np.array([r.label for r in rows], np.float32)


def scored(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``."""
    x, y = labelled_sample(docs, labels, limit)
    voters = docs.sparkSession.sparkContext.broadcast(Voters(x, y) if len(x) else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = voters.value
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                if own is None:
                    scores = np.full(part.num_rows, 0.5)
                else:
                    x = np.zeros((BLOCK, SIZE), np.float32)
                    x[: part.num_rows] = [features(t.as_py() or b"") for t in part.column(1)]
                    scores = np.round(own.score(x)[: part.num_rows], DIGITS)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores.astype(np.float64))], ["doc_id", "score"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    found = texts.mapInArrow(run, "doc_id long, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_neighbours(spark, sf_dir: str) -> DataFrame:
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
