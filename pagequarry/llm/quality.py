"""Quality scores from a compression classifier.

Two zstandard dictionaries are built, one from good and one from bad labelled
texts.  A text compresses better with the dictionary of its own kind; the
difference of the two compressed sizes, divided by the text's bytes, is
calibrated to a probability by logistic regression.  The calibration also sees
the size under the good dictionary per byte: endlessly repeated words are small
under both, so their difference alone says little.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Model:
    """Two dictionaries, and a logistic curve over the standardised sizes and their squares."""

    good: bytes
    bad: bytes
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    level: int
    block: int

    def scores(self, sizes: np.ndarray) -> np.ndarray:
        z = _terms(sizes, self.mean, self.scale) @ np.array(self.weights)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _terms(sizes: np.ndarray, mean, scale) -> np.ndarray:
    z = np.clip((sizes.reshape(-1, 2) - np.array(mean)) / np.array(scale), -4, 4)
    return np.concatenate((z, z**2, np.ones((len(z), 1))), axis=1)


class _Sizer:
    """Compressed sizes of a whole text, block by block.

    Short blocks keep the dictionary, and not what the text has already said,
    the main thing that a block is compared with.
    """

    def __init__(self, good: bytes, bad: bytes, level: int, block: int):
        self.block = block
        self.sides = []
        for d in (good, bad):
            d = zstandard.ZstdCompressionDict(d)
            d.precompute_compress(level=level)
            self.sides.append(zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_dict_id=False))

    def sizes(self, text: str | None) -> tuple[float, float]:
        """(bad - good) and good, per byte of text; an empty text counts as one byte."""
        data = (text or "").encode("utf-8", "surrogatepass")
        good = bad = 0
        for k in range(0, len(data), self.block):
            part = data[k : k + self.block]
            good += len(self.sides[0].compress(part))
            bad += len(self.sides[1].compress(part))
        n = max(1, len(data))
        return (bad - good) / n, good / n


def _logistic(a: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weights by Newton steps, each halved until the loss falls; ``ridge`` bounds them where the classes part cleanly."""

    def loss(beta: np.ndarray) -> float:
        z = a @ beta
        return float(weight @ (np.logaddexp(0, z) - y * z) + ridge / 2 * beta @ beta)

    beta, now = np.zeros(a.shape[1]), loss(np.zeros(a.shape[1]))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -40, 40)))
        gradient = a.T @ (weight * (y - p)) - ridge * beta
        hessian = (a * (weight * p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(beta))
        step = np.linalg.solve(hessian, gradient)
        while (after := loss(beta + step)) > now and np.abs(step).max() > 1e-9:
            step /= 2
        if np.abs(step).max() < 1e-8 or after > now:
            break
        beta, now = beta + step, after
    return beta


def _dictionary(texts: list[str], size: int, piece: int = 1 << 10) -> bytes:
    """A zstandard dictionary of whole texts, in pieces, each a sample; or where they are too few to train on, parts from all over them."""
    whole = [t.encode("utf-8", "surrogatepass") for t in texts if t]
    data = [t[k : k + piece] for t in whole for k in range(0, len(t), piece)]
    try:
        return zstandard.train_dictionary(size, data).as_bytes()
    except (zstandard.ZstdError, ValueError):
        joined = b"".join(whole)
        piece = max(1, size // 64)
        if len(joined) > size:
            joined = b"".join(joined[k : k + piece] for k in np.linspace(0, len(joined) - piece, size // piece).astype(int).tolist())
        return joined or b" " * 64


def fit(documents: DataFrame, labels: DataFrame, per_class: int = 1500, dictionary_bytes: int = 1 << 17, level: int = 3, block: int = 1 << 11) -> Model:
    """Learn from ``documents`` (``doc_id, text``) and ``labels`` (``doc_id, label``; other labels than 0 and 1 are left out).

    A bounded sample of labelled rows is enough here and only here: ``per_class``
    of each kind, chosen by hash of doc_id.  The ids are chosen before any text is
    read, so the documents are filtered by a broadcast of at most ``2 * per_class``
    ids and only the chosen are shuffled.  The odd half of the sample builds the dictionaries
    from its whole texts, those of a kind in one task.  The even
    half calibrates, by the sizes of its whole texts, worked out in tasks.  With a
    class missing every score is the other class's share.
    """
    labels = labels.where("label in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label"))
    order = F.xxhash64("doc_id")
    chosen = [labels.where(F.col("label") == k).select("doc_id", "label", order.alias("h")).orderBy("h", "doc_id").limit(per_class) for k in (0, 1)]
    chosen = chosen[0].unionByName(chosen[1]).withColumn("odd", F.pmod(F.shiftright("h", 7), F.lit(2)) == 1)
    shares = {r["label"]: r["n"] for r in labels.groupBy("label").agg(F.count("*").alias("n")).collect()}
    total = sum(shares.values())
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    drawn = texts.where("odd").groupBy("label", "h", "doc_id").agg(F.min("text").alias("text"))  # a repeated doc_id is one sample

    def train(group: pa.Table) -> pa.Table:
        group = group.sort_by([("h", "ascending"), ("doc_id", "ascending")])
        made = _dictionary(group.column("text").to_pylist(), dictionary_bytes)
        return pa.table({"label": group.column("label").slice(0, 1).cast(pa.int32()), "dictionary": pa.array([made], pa.binary())})

    trained = {r["label"]: bytes(r["dictionary"]) for r in drawn.groupBy("label").applyInArrow(train, "label int, dictionary binary").collect()}
    good, bad = (trained.get(k, b" " * 64) for k in (1, 0))

    def sizes(batches):
        sizer = _Sizer(good, bad, level, block)
        for batch in batches:
            found = [sizer.sizes(t.as_py()) for t in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([a for a, _ in found], pa.float64()), pa.array([b for _, b in found], pa.float64())], names=["label", "h", "doc_id", "a", "b"])

    measured = texts.where("not odd").select("label", "h", "doc_id", "text").mapInArrow(sizes, "label int, h long, doc_id long, a double, b double")
    measured = measured.groupBy("label", "h", "doc_id").agg(F.min(F.struct("a", "b")).alias("s")).collect()
    measured = sorted((r["label"], r["h"], r["doc_id"], r["s"]["a"], r["s"]["b"]) for r in measured)
    y = np.array([float(r[0]) for r in measured])
    if len(set(y.tolist())) < 2:
        share = 1.0 if total == 0 else shares.get(1, 0) / total
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model(good, bad, (0.0, 0.0), (1.0, 1.0), (0.0, 0.0, 0.0, 0.0, math.log(share / (1 - share))), level, block)
    x = np.array([r[3:] for r in measured])
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    each = {k: shares[k] / total / int((y == k).sum()) * len(y) for k in (0, 1)}  # the classes' true shares
    weights = _logistic(_terms(x, mean, scale), y, np.where(y == 1, each[1], each[0]))
    return Model(good, bad, tuple(mean.tolist()), tuple(scale.tolist()), tuple(weights.tolist()), level, block)


def score(model: Model, text="text"):
    """Column with the probability of label 1 of a text column, from the whole text.

    A null text counts as empty, whose sizes are 0 and which scores as such.
    """

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        sizer = _Sizer(model.good, model.bad, model.level, model.block)
        for texts in batches:
            yield pd.Series(model.scores(np.array([sizer.sizes(t) for t in texts])) if len(texts) else np.zeros(0))

    return scores(F.col(text) if isinstance(text, str) else text)


def learn(documents: DataFrame, labels: DataFrame, folds: int = 5, **options) -> Model:
    """:func:`fit` on the labels outside fold 0 of ``crc32(doc_id as text) mod folds``."""
    known = labels.where(F.col("quality").isin(0, 1)).where(~held_out(folds)).select("doc_id", F.col("quality").alias("label"))
    return fit(documents, known, **options)


def held_out(folds: int = 5) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % folds == 0


def judge(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document.

    Nulls, empty and very long texts are scored whole like any other; rows with
    the same doc_id each get a row; other columns of either table are ignored.
    A null doc_id has ``held_out`` false.
    """
    model = learn(documents, labels, **options)
    scored = documents.select("doc_id", score(model).alias("score"))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """The rows of ``documents`` that are predicted to be good, all columns kept; no shuffle of texts."""
    return documents.where(score(learn(documents, labels, **options)) >= threshold)
