"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import materialise, release, shared_folder

__all__ = ["LAST_ID", "fresh", "gathered", "id_and_text", "known_id", "materialise", "null_ids", "release", "shared_folder", "table"]
#: Stands in for a missing doc_id where ids are compared: it sorts after every other id.
LAST_ID = 2**63 - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(rows: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores after it until no column of the rows is called so."""
    taken, out = {c.lower() for c in rows.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def known_id(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(LAST_ID))


def null_ids(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.withColumns({c: F.nullif(F.col(c), F.lit(LAST_ID)) for c in columns or ("doc_id",)})


def id_and_text(docs: DataFrame, text: str = "text") -> DataFrame:
    """Only the two columns an operator works on, so that other columns' names can't clash.

    A missing doc_id becomes LAST_ID, since pandas turns integers with gaps into floats; ``null_ids`` undoes it.
    """
    return docs.select(known_id().alias("doc_id"), F.col(text).cast("string").alias("text"))


def gathered(rows: DataFrame, splits: int = 8) -> DataFrame:
    """The rows in fewer partitions, for tasks that each send a table of fixed size.

    A task then serves up to ``splits`` input splits, as long as that leaves every core with work.
    """
    n = rows.rdd.getNumPartitions()
    return rows.coalesce(max(1, -(-n // splits), min(n, 2 * rows.sparkSession.sparkContext.defaultParallelism)))
