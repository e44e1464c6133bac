"""A partitioned index of unit vectors with exact pruning by the triangle inequality (C2), and joins over its cells.

Centroids are fitted on a sample of at most ``SAMPLE`` vectors (those with the least hashes of their
ids); every vector is indexed, in the cell of its nearest centroid, with its distance to it. A query
at distance d from a centroid is at least \\|d - r\\| away from a vector at distance r, so once k hits
are known, only cells whose range of r can come closer than the k-th are read. That is exact; with
``probes`` only the nearest cells are read, and recall has to be measured.

Cells are dealt in pieces of at most about ``PIECE`` vectors and as many queries, so neither a cell
with a third of all vectors nor many queries meet in one task. Only the centroids (at most ``CELLS``)
and two distances of each are sent to all tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import materialise

SAMPLE, CELLS, PIECE, TURNS = 20_000, 1_024, 4_096, 6
#: Cells read first for each query; slack of distances for rounding; decimals of scores, since equal vectors' products differ in the last bits.
FIRST, SLACK, DECIMALS = 4, 1e-9, 12
#: Vectors that are held against centroids or others at once, and rows that leave a task at once.
SLICE, BATCH = 512, 8_192


def units(vectors) -> np.ndarray:
    """Rows of length one; a zero vector stays zero."""
    x = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-30)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    square = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * x @ y.T
    return np.sqrt(np.maximum(square, 0))


def closest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector and the distance to it, a slice at a time."""
    found = [(d.argmin(axis=1), d.min(axis=1)) for d in (distances(x[at : at + SLICE], centroids) for at in range(0, len(x), SLICE))]
    home, r = (np.concatenate(part) for part in zip(*found, strict=True))
    return home, r


def top_of(cos: np.ndarray, pk: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, pk, score) of the k best of each row of cos; ties to the smaller pk."""
    if cos.shape[1] > k:
        rows, at = np.nonzero(cos >= np.partition(cos, -k, axis=1)[:, -k:][:, :1])  # with all ties
    else:
        rows, at = np.divmod(np.arange(cos.size), max(1, cos.shape[1]))
    order = np.lexsort((pk[at], -cos[rows, at], rows))
    rows, at = rows[order], at[order]
    kept = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[kept], pk[at][kept], cos[rows, at][kept]


def fit(vectors: DataFrame, cells: int | None = None, sample: int = SAMPLE) -> np.ndarray:
    """Centroids of the sample by a few rounds of k-means; about as many as the square root of the number of vectors, halved."""
    n = vectors.count()
    rows = vectors.select("pk", "vector").orderBy(F.xxhash64("pk"), "pk").limit(sample).collect()  # ``sample`` rows at most
    if not rows:
        return np.zeros((0, 0))
    x = units([r["vector"] for r in rows])
    centroids = x[: max(1, min(CELLS, len(x), cells or int(n**0.5 / 2) or 1))].copy()
    for _ in range(TURNS):
        home, _ = closest(x, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, home, x)
        size = np.bincount(home, minlength=len(centroids))[:, None]
        centroids = np.where(size > 0, sums / np.maximum(size, 1), centroids)
    return centroids


@dataclass
class VectorIndex:
    """rows(kb_id, cell, pk, vector, r), cells(kb_id, cell, n) and the centroids with the least and greatest r of their cells."""

    rows: DataFrame
    cells: DataFrame
    centroids: np.ndarray
    near: np.ndarray
    far: np.ndarray

    def write(self, folder: str) -> None:
        self.rows.write.mode("overwrite").parquet(f"{folder}/rows")
        self.cells.write.mode("overwrite").parquet(f"{folder}/cells")
        table = [(k, c.tolist(), float(a), float(b)) for k, (c, a, b) in enumerate(zip(self.centroids, self.near, self.far, strict=True))]
        self.rows.sparkSession.createDataFrame(table, "cell int, vector array<double>, near double, far double").write.mode("overwrite").parquet(f"{folder}/centroids")

    @classmethod
    def read(cls, spark: SparkSession, folder: str) -> VectorIndex:
        table = spark.read.parquet(f"{folder}/centroids").orderBy("cell").collect()
        parts = (np.array([r[c] for r in table]) for c in ("vector", "near", "far"))
        return cls(spark.read.parquet(f"{folder}/rows"), spark.read.parquet(f"{folder}/cells"), *parts)


def build(vectors: DataFrame, cells: int | None = None, sample: int = SAMPLE) -> VectorIndex:
    """The index of vectors(pk, kb_id, vector)."""
    centroids = fit(vectors, cells, sample)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                x = units(rows["vector"])
                home, r = closest(x, centroids)
                yield pd.DataFrame({"kb_id": rows["kb_id"], "cell": home.astype(np.int32), "pk": rows["pk"], "vector": list(x), "r": r})

    rows = materialise(vectors.select("kb_id", "pk", "vector").mapInPandas(assign, "kb_id long, cell int, pk long, vector array<double>, r double"), "vectors")
    near, far = np.full(len(centroids), np.inf), np.full(len(centroids), -np.inf)
    for r in rows.groupBy("cell").agg(F.min("r").alias("near"), F.max("r").alias("far")).collect():  # CELLS rows at most
        near[r["cell"]], far[r["cell"]] = r["near"], r["far"]
    return VectorIndex(rows, rows.groupBy("kb_id", "cell").agg(F.count("*").alias("n")), centroids, near, far)


def nothing(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.lit(0).cast("long").alias("pk"), F.lit(0.0).alias("score")).limit(0)


def meet(requests: DataFrame, index: VectorIndex, found: Callable[[np.ndarray, np.ndarray, pd.DataFrame], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> DataFrame:
    """(query_id, pk, score): requests(query_id, kb_id, cell, vector) held against the vectors of their cells, piece by piece.

    ``found(cosines, pk, requests)`` names what is kept, as (row, pk, score).
    """
    asked = requests.groupBy("kb_id", "cell").agg(F.count("*").alias("asked"))
    sizes = index.cells.join(asked, ["kb_id", "cell"]).select("kb_id", "cell", F.ceil(F.col("n") / PIECE).alias("pieces"), F.ceil(F.col("asked") / PIECE).alias("chunks"))
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = requests.join(sizes, ["kb_id", "cell"]).withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.col("chunks"))).withColumn("piece", upto("pieces")).drop("pieces", "chunks")
    right = index.rows.join(sizes, ["kb_id", "cell"]).withColumn("piece", F.pmod(F.xxhash64("pk"), F.col("pieces"))).withColumn("chunk", upto("chunks"))
    right = right.select(F.col("kb_id").alias("kb"), F.col("cell").alias("c"), F.col("piece").alias("p"), F.col("chunk").alias("h"), "pk", F.col("vector").alias("v"))

    def compare(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({"query_id": [], "pk": [], "score": []})
        theirs, pks, asked_by, parts = np.stack(y["v"]).T, y["pk"].to_numpy(), x["query_id"].to_numpy(), []
        for at in range(0, len(x), SLICE):
            row, pk, score = found(np.stack(x["vector"].iloc[at : at + SLICE]) @ theirs, pks, x.iloc[at : at + SLICE])
            parts.append((asked_by[at : at + SLICE][row], pk, score))
        query, pk, score = (np.concatenate(part) for part in zip(*parts, strict=True))
        return pd.DataFrame({"query_id": query, "pk": pk, "score": score})

    return left.groupBy("kb_id", "cell", "piece", "chunk").cogroup(right.groupBy("kb", "c", "p", "h")).applyInPandas(compare, "query_id long, pk long, score double")


def requests(queries: DataFrame, choose: Callable[[np.ndarray, pd.DataFrame], np.ndarray]) -> Callable:
    """Rows for the cells that ``choose`` marks for each query, given unit vectors and the other columns."""
    return queries.mapInPandas(lambda batches: ask(batches, choose), "query_id long, kb_id long, cell int, vector array<double>")


def ask(batches: Iterator[pd.DataFrame], choose: Callable[[np.ndarray, pd.DataFrame], np.ndarray]) -> Iterator[pd.DataFrame]:
    """A query may reach all cells, so its rows leave in frames of at most ``BATCH``."""
    for batch in batches:
        for start in range(0, len(batch), SLICE):
            rows = batch.iloc[start : start + SLICE]
            x = units(rows["vector"])
            row, cell = np.nonzero(choose(x, rows))
            ids, kbs = rows["query_id"].to_numpy(), rows["kb_id"].to_numpy()
            for at in range(0, len(row), BATCH):
                r, c = row[at : at + BATCH], cell[at : at + BATCH]
                yield pd.DataFrame({"query_id": ids[r], "kb_id": kbs[r], "cell": c.astype(np.int32), "vector": list(x[r])})


def nearest(d: np.ndarray, n: int) -> np.ndarray:
    """Marks the n least of each row."""
    marked = np.zeros(d.shape, dtype=bool)
    np.put_along_axis(marked, np.argsort(d, axis=1, kind="stable")[:, :n], True, axis=1)
    return marked


def search(queries: DataFrame, index: VectorIndex, k: int, probes: int | None = None) -> DataFrame:
    """(query_id, pk, score, rank): cosine top-k of queries(query_id, kb_id, vector) in their base; ties to the smaller pk.

    Exact without ``probes``; with it, only so many nearest cells are read.
    """
    centroids, near, far = index.centroids, index.near, index.far
    if not len(centroids):
        return nothing(queries).withColumn("rank", F.lit(0))
    asked = queries.select("query_id", "kb_id", "vector")
    keep = lambda cos, pk, _: top_of(np.round(cos, DECIMALS), pk, k)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "pk"))
    ranked = lambda hits: hits.withColumn("rank", rank).filter(F.col("rank") <= k)
    first = ranked(meet(requests(asked, lambda x, _: nearest(distances(x, centroids), probes or FIRST)), index, keep))
    if probes:
        return first
    first = materialise(first, "first")

    def reachable(x: np.ndarray, rows: pd.DataFrame) -> np.ndarray:
        d = distances(x, centroids)
        least = np.maximum(np.maximum(d - far, near - d), 0)
        return ~nearest(d, FIRST) & (least <= rows["most"].to_numpy()[:, None] + SLACK)

    kth = first.filter(F.col("rank") == k).select("query_id", F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * (F.col("score") - 10.0**-DECIMALS))).alias("most"))
    rest = asked.join(kth, "query_id", "left").withColumn("most", F.coalesce("most", F.lit(3.0)))  # no two unit vectors are farther apart than 2
    return ranked(first.drop("rank").unionByName(meet(requests(rest, reachable), index, keep)))


def within(queries: DataFrame, index: VectorIndex, least: float) -> DataFrame:
    """(query_id, pk, score) of all vectors with a cosine of at least ``least``: a vector goes to each cell that can hold such a one.

    Cells are left out by their greatest distance, and if the plane between their centroid and the
    vector's own is farther away than the radius.
    """
    centroids, far, radius = index.centroids, index.far, float(np.sqrt(max(0.0, 2 - 2 * least)))
    if not len(centroids):
        return nothing(queries)
    between = distances(centroids, centroids)

    def reachable(x: np.ndarray, _: pd.DataFrame) -> np.ndarray:
        d = distances(x, centroids)
        home = d.argmin(axis=1)
        apart = between[home]
        plane = np.divide(d**2 - d.min(axis=1)[:, None] ** 2, 2 * apart, out=np.zeros_like(d), where=apart > 0)
        return (d <= far + radius + SLACK) & (plane <= radius + SLACK)

    def keep(cos: np.ndarray, pk: np.ndarray, _: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, at = np.nonzero(cos >= least)
        return row, pk[at], cos[row, at]

    return meet(requests(queries.select("query_id", "kb_id", "vector"), reachable), index, keep)
