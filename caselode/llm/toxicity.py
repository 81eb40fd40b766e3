"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc32_mod, stage_table
from .quality import labelled_texts

_STRIP = b".,;:!?\"'()[]{}<>|*#&$%-_"
_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)


class Features:
    """Distinct hashed features of a text: words, pairs of neighbours, and pairs with one word between them.

    Words are lower-cased in A-Z and stripped of punctuation at both ends.
    """

    def __init__(self, bits: int, most: int = 250_000):
        import xxhash

        self.digest, self.shift, self.known, self.most = xxhash.xxh64_intdigest, np.uint64(64 - bits), {}, most

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "replace").lower().split()
        if not words:
            return np.empty(0, np.int64)
        known = self.known
        new = [w for w in set(words) if w not in known]
        if len(known) + len(new) > self.most:
            known.clear()
            new = set(words)
        for w in new:
            known[w] = self.digest(w.strip(_STRIP) or w, 7)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        one, two, skip = h * _MIX[0], (h[:-1] ^ (h[1:] * _MIX[1])) * _MIX[0], (h[:-2] ^ (h[2:] * _MIX[2])) * _MIX[0]
        return np.unique(np.concatenate((one, two, skip)) >> self.shift).astype(np.int64)


def _train(z: np.ndarray, n: np.ndarray, docs: list[tuple[np.ndarray, int]], alpha: float, beta: float, l1: float, l2: float, weight: float) -> None:
    """One FTRL-proximal pass in place; the last coordinate is the intercept, which has no L1. weight: of toxic rows."""
    bias = len(z) - 1
    for index, y in docs:
        index = np.append(index, bias)
        zi, ni = z[index], n[index]
        penalty = np.full(len(index), l1)
        penalty[-1] = 0
        w = np.where(np.abs(zi) <= penalty, 0, -(zi - np.sign(zi) * penalty) / ((beta + np.sqrt(ni)) / alpha + l2))
        p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
        g = (p - y) * (weight if y else 1)
        rate = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
        z[index] += g - rate * w
        n[index] += g * g


def fit(
    labelled: DataFrame,
    *,
    bits: int = 20,
    alpha: float = 1.0,
    beta: float = 1.0,
    l1: float = 8.0,
    l2: float = 0.1,
    weight: float = 3.0,
    least: int = 3,
    epochs: int = 5,
) -> tuple[np.ndarray, np.ndarray, float]:
    """(indices, weights, intercept) from (text, label) rows.

    FTRL-proximal is an online algorithm: one task passes `epochs` times over
    the rows in hash order, so the caller bounds their number and bytes
    (labelled_texts does). Features of fewer than `least` rows are left out, and toxic rows
    count `weight` times. What L1 leaves are at most 2**bits weights, usually
    a few thousand.
    """
    rows = labelled.where("label in (0, 1)").select("text", F.col("label").cast("int").alias("label"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(bits)
        for b in batches:
            found = [features(t.as_py()).astype(np.int32).tobytes() for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), b.column(1)], ["index", "label"])

    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by([("nth", "ascending"), ("label", "ascending")])
        found = [np.frombuffer(i, np.int32) for i in table["index"].to_pylist()]
        count = np.zeros(1 << bits, np.int32)
        for i in found:
            count[i] += 1
        docs = [(i[count[i] >= least], y) for i, y in zip(found, table["label"].to_pylist(), strict=True)]
        z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
        for _ in range(epochs):
            _train(z, n, docs, alpha, beta, l1, l2, weight)
        penalty = np.full(len(z), l1)
        penalty[-1] = 0
        w = np.where(np.abs(z) <= penalty, 0, -(z - np.sign(z) * penalty) / ((beta + np.sqrt(n)) / alpha + l2))
        at = np.append(np.flatnonzero(w[:-1]), 1 << bits)
        return pa.table({"at": pa.array(at), "w": pa.array(w[at])})

    examples = rows.mapInArrow(extract, "index binary, label int")
    examples = stage_table(examples.select(F.xxhash64("index").alias("nth"), "index", "label"), "toxic")
    if examples.select("label").distinct().count() < 2:
        return np.empty(0, np.int64), np.empty(0), 0.0
    learned = examples.groupBy().applyInArrow(learn, "at long, w double").toPandas().sort_values("at")
    at, w = learned["at"].to_numpy(), learned["w"].to_numpy()
    return at[:-1], w[:-1], float(w[-1])


def _scorer(spark: SparkSession, model: tuple[np.ndarray, np.ndarray, float], bits: int = 20):
    """Makes, in a task, a function from a column of texts to probabilities; the weights, 2**bits at most, are broadcast."""
    shared = spark.sparkContext.broadcast(model)

    def make():
        features, (at, w, bias) = Features(bits), shared.value
        dense = np.zeros(1 << bits)
        dense[at] = w

        def run(column: pa.Array) -> np.ndarray:
            logit = np.array([dense[features(t.as_py() or "")].sum() for t in column], float) + bias
            return 1 / (1 + np.exp(-np.clip(logit, -35, 35)))

        return run

    return make


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score): the probability that a text is toxic."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    make = _scorer(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = make()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scorer(b.column(1)))], ["doc_id", "score"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, score double")


def drop_toxic(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7, max_docs: int = 24_000) -> DataFrame:
    """The rows of docs, with all columns, that classify would predict 0; no row is moved.

    Defined cases: a null or empty text has no features and gets the
    intercept's probability; a score equal to the threshold goes; repeated
    rows are judged alike; without usable labels every score is 0.5; an empty
    table gives an empty result; columns keep their names, whatever they are.
    """
    make = _scorer(docs.sparkSession, fit(labelled_texts(docs, labels, "toxic", lambda i: crc32_mod(i, 3) != 1, max_docs)))
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = make()
        for b in batches:
            yield b.filter(pa.array(scorer(b.column(text)) < threshold))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7, max_docs: int = 24_000) -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    Fitted on at most max_docs labelled rows whose crc32(doc_id) mod 3 is not
    1. Defined cases: a null or empty text has no features and gets the
    intercept's probability; null labels and null ids teach nothing; repeated
    rows are scored again; other columns are ignored; without usable labels
    every score is 0.5.
    """
    model = fit(labelled_texts(docs, labels, "toxic", lambda i: crc32_mod(i, 3) != 1, max_docs))
    return score(docs, model).select(
        "doc_id",
        (crc32_mod(F.col("doc_id"), 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
