"""Quality by compression: dictionaries of good and of bad text, and a calibrated size difference.

A bounded sample of labelled texts makes two zstandard dictionaries. Every text is compressed with
each; the difference of the two sizes per byte tells which dictionary knows the text better. A
logistic curve, fitted on labelled texts that are in neither dictionary, turns it into a score.

Bounds (parameters): at most ``per_class`` labelled rows of each class, chosen by a hash of doc_id,
none longer than ``longest`` characters; a third of them calibrates. A dictionary takes whole texts
of the others, in the order of the hash, until its ``size`` in bytes is full. Everything else sees
all rows.

Cases: a null text counts as empty; an empty text has difference 0 and gets the curve's value there;
without labelled rows of both classes every score is the share of good ones (0.5 without any);
equal rows each give a row; a null doc_id is kept, and its remainder is that of the empty text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, id_and_text, table

PER_CLASS, LONGEST, DICTIONARY, LEVEL = 3_000, 20_000, 1 << 20, 9


@dataclass(frozen=True)
class Model:
    """Two dictionaries and the curve score = 1 / (1 + exp(-(slope * difference + offset)))."""

    good: bytes
    bad: bytes
    slope: float
    offset: float


def held_out():
    """Whether a row's labels must not be learnt from: crc32(doc_id as text) mod 3 is 1."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def compressor(dictionary: bytes, level: int = LEVEL) -> zstandard.ZstdCompressor:
    if not dictionary:
        return zstandard.ZstdCompressor(level=level, write_content_size=False)
    made = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    made.precompute_compress(level=level)
    return zstandard.ZstdCompressor(dict_data=made, level=level, write_content_size=False, write_dict_id=False)


def difference(text: bytes, good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> float:
    """Compressed size with the bad dictionary less that with the good one, per byte of their mean."""
    if not text:
        return 0.0
    a, b = len(good.compress(text)), len(bad.compress(text))
    return 2 * (b - a) / (a + b)


def build_dictionary(texts: list[bytes], size: int) -> bytes:
    """Content of a dictionary: whole texts in the sample's order; a text that no longer fits is passed over."""
    taken, used = [], 0
    for text in texts:
        if used + len(text) + bool(taken) <= size:
            used += len(text) + bool(taken)
            taken.append(text)
    return b"\n".join(taken)


def fit_curve(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Logistic regression of y on x with smoothed targets (Platt), by Newton's method."""
    n1 = float(y.sum())
    n0 = len(y) - n1
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    slope, offset = 0.0, math.log((n1 + 1) / (n0 + 1))
    loss = math.inf
    for _ in range(rounds):
        z = np.clip(slope * x + offset, -30, 30)
        p = 1 / (1 + np.exp(-z))
        now = float(np.sum(np.logaddexp(0, z) - t * z))
        if loss - now < 1e-9:
            break
        loss, g, w = now, p - t, np.maximum(p * (1 - p), 1e-9)
        h = np.array([[np.sum(w * x * x) + 1e-6, np.sum(w * x)], [np.sum(w * x), np.sum(w) + 1e-6]])
        step = np.linalg.solve(h, [np.sum(g * x), np.sum(g)])
        slope, offset = slope - step[0], offset - step[1]
    return float(slope), float(offset)


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, longest: int = LONGEST) -> DataFrame:
    """(doc_id, text, quality): the bounded sample that a model is fitted on.

    Rows are chosen by id and hash, so no text is shuffled but the chosen ones.
    """
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    ids = ids.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.min("quality").alias("least")).filter("quality = least")
    known = id_and_text(docs).filter(~held_out() & F.col("text").isNotNull() & (F.length("text") <= longest)).withColumn("pick", F.xxhash64("doc_id", "text"))
    rows = known.select("doc_id", "pick").join(ids.select("doc_id", "quality"), "doc_id").distinct()
    chosen = [rows.filter(F.col("quality") == q).orderBy("pick", "doc_id").limit(per_class) for q in (0, 1)]
    chosen = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most 2 * per_class small rows
    return known.join(chosen, ["doc_id", "pick"]).dropDuplicates(["doc_id", "pick"]).select("doc_id", "text", "quality", "pick")


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, longest: int = LONGEST, size: int = DICTIONARY, level: int = LEVEL) -> Model:
    """At most 2 * per_class rows of at most ``longest`` characters reach the driver."""
    rows = sorted((x["pick"], x["doc_id"], x["quality"], x["text"].encode()) for x in labelled_sample(docs, labels, per_class, longest).collect())
    share = np.mean([x[2] for x in rows]) if rows else 0.5
    if not 0 < share < 1:
        return Model(b"", b"", 0.0, math.log((share + 1e-3) / (1 - share + 1e-3)))
    made = [[x[3] for i, x in enumerate(v) if i % 3] for v in ([x for x in rows if x[2] == q] for q in (0, 1))]
    rest = [x for q in (0, 1) for i, x in enumerate([x for x in rows if x[2] == q]) if i % 3 == 0]
    bad, good = (build_dictionary(x, size) for x in made)
    by_good, by_bad = compressor(good, level), compressor(bad, level)
    slope, offset = fit_curve(np.array([difference(x[3], by_good, by_bad) for x in rest]), np.array([x[2] for x in rest]))
    return Model(good, bad, slope, offset)


def score_column(spark: SparkSession, model: Model, level: int = LEVEL):
    """A function from a text column to its score (null texts count as empty).

    The model is sent to every task; its two dictionaries have a fixed size.
    """
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = sent.value
        good, bad = compressor(m.good, level), compressor(m.bad, level)
        for texts in batches:
            z = np.array([m.slope * difference((x or "").encode(), good, bad) + m.offset for x in texts], dtype=float)
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -700, 700))))

    return scores


def score(docs: DataFrame, model: Model, level: int = LEVEL) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; one pass without a shuffle."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.select("doc_id", held_out().alias("held_out"), score_column(docs.sparkSession, model, level)("text").alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows with a score of at least one half, with all their columns."""
    scores = score_column(docs.sparkSession, fit(docs, labels))
    (name,) = fresh(docs, "_lw_score")
    return docs.withColumn(name, scores(F.col("text").cast("string"))).filter(F.col(name) >= 0.5).drop(name)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
