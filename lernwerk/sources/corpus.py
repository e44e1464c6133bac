"""Text files and exports."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENCODINGS = ("gb18030", "gbk", "big5")
TYPE_NAMES = ["单选题", "多选题", "判断题", "填空题", "名词解释", "简答题", "论述题", "代码题", "对比题"]
DIFFICULTY_NAMES = ["易", "中", "难"]


def decode_text(content: Column) -> Column:
    """UTF-8 where it is valid, on the JVM; the rest tries GB18030, GBK and Big5, at last UTF-8 with replacement (A2)."""

    @F.pandas_udf(T.StringType())
    def other(raw: pd.Series) -> pd.Series:
        def text(b: bytes | None) -> str | None:
            if b is None:
                return None
            for name in ENCODINGS:
                try:
                    return b.decode(name)
                except UnicodeDecodeError:
                    pass
            return b.decode("utf-8", "replace")

        return raw.map(text)

    valid = F.is_valid_utf8(content.cast("string"))
    return F.when(valid, content.cast("string")).otherwise(other(F.when(~valid, content)))


def load_text_corpus(spark: SparkSession, path: str, pattern: str = "*.{txt,md}") -> DataFrame:
    """(path, size, text) of the text files in a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("size"), decode_text(F.col("content")).alias("text"))


def admit_files(files: DataFrame, extensions: list[str], most: int) -> DataFrame:
    """files(path, size) with the reason why one is not admitted, null if it is (A3)."""
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    reason = F.when(F.col("size") <= 0, "empty").when(F.col("size") > most, "too large").when(~extension.isin([e.lower() for e in extensions]), "extension not allowed")
    return files.withColumns({"extension": extension, "reason": reason})


def name_of(names: list[str], code: Column) -> Column:
    return F.coalesce(F.try_element_at(F.array(*map(F.lit, names)), code.cast("int")), F.lit(""))


def export_questions_json(questions: DataFrame, options: DataFrame, question_tags: DataFrame, tags: DataFrame) -> DataFrame:
    """Questions by type and id with nested options and tag names; write with ``.write.json`` (A5)."""
    o = options.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("sort_order", "option_key", "content", "is_correct"))).alias("o"))
    o = o.select("question_id", F.transform("o", lambda x: F.struct(x["option_key"].alias("key"), x["content"].alias("content"), (x["is_correct"] == 1).alias("correct"))).alias("options"))
    t = question_tags.join(tags.select("tag_id", "name"), "tag_id").groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("tag_id", "name"))), lambda x: x["name"]).alias("tags"))
    return questions.join(o, "question_id", "left").join(t, "question_id", "left")


def _one_line(c: Column, blank: str = " ") -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"\r\n|[\r\n]", blank)


def export_questions_csv(exported: DataFrame) -> DataFrame:
    """Rows of the CSV export, from ``export_questions_json`` (A6); write with header, quote and escape set to '"'."""
    options = F.array_join(F.transform("options", lambda x: F.concat(x["key"], F.lit("."), x["content"], F.when(x["correct"], "(√)").otherwise(""))), " | ")
    return exported.select(
        F.col("question_id").alias("id"), name_of(TYPE_NAMES, F.col("q_type")).alias("type"), name_of(DIFFICULTY_NAMES, F.col("difficulty")).alias("difficulty"), _one_line(F.col("stem")).alias("stem"), _one_line(options).alias("options"),
        _one_line(F.col("answer")).alias("answer"), _one_line(F.col("analysis")).alias("analysis"), F.coalesce(F.array_join("tags", "、"), F.lit("")).alias("tags"), F.col("status").alias("status"), F.col("kb_id").alias("kb"),
    )


def export_anki(exported: DataFrame) -> DataFrame:
    """(id, value): tab-separated front, back and tags of each card (A7); write ``value`` with ``.write.text``."""
    field = lambda c: F.replace(_one_line(c, "<br>"), F.lit("\t"), F.lit("    "))
    options = F.array_join(F.transform("options", lambda x: F.concat(x["key"], F.lit(". "), x["content"])), "\n")
    front = F.concat_ws("\n", "stem", F.nullif(options, F.lit("")))
    back = F.concat_ws("\n", F.concat(F.lit("答案："), "answer"), F.concat(F.lit("解析："), F.col("analysis")))
    tag = lambda c: F.regexp_replace(c, r"[\s,，]", "_")
    tags = F.concat_ws(" ", name_of(TYPE_NAMES, F.col("q_type")), name_of(DIFFICULTY_NAMES, F.col("difficulty")), F.array_join(F.transform("tags", tag), " "))
    return exported.select(F.col("question_id").alias("id"), F.concat_ws("\t", field(front), field(back), F.trim(tags)).alias("value"))


def write_csv(rows: DataFrame, path: str, bom: bool = False) -> None:
    """CSV with RFC quoting. With ``bom`` the first header starts with a byte order mark, for spreadsheet programs."""
    rows = rows.withColumnRenamed(rows.columns[0], "﻿" + rows.columns[0]) if bom else rows
    rows.write.mode("overwrite").option("header", True).option("quoteAll", False).option("quote", '"').option("escape", '"').csv(path)


def snapshot_tables(tables: dict[str, DataFrame], path: str, version: str = "1") -> DataFrame:
    """Write every table under ``path`` and return the manifest (table, rows, version, tables, created), which is written too.

    tables is how many there are, created when the manifest was made, after all tables were written.
    """
    manifest = None
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{path}/{name}")
        count = rows.sparkSession.read.parquet(f"{path}/{name}").agg(F.lit(name).alias("table"), F.count("*").alias("rows"), F.lit(version).alias("version"))
        manifest = count if manifest is None else manifest.unionByName(count)
    manifest = manifest.withColumns({"tables": F.lit(len(tables)), "created": F.current_timestamp()})
    manifest.write.mode("overwrite").parquet(f"{path}/_manifest_")
    return manifest.sparkSession.read.parquet(f"{path}/_manifest_")


def restore_tables(spark: SparkSession, path: str, target: str, names: list[str]) -> DataFrame:
    """Replace all rows of the listed tables under ``target`` by those of a snapshot; returns (table, rows, restored).

    Tables that the snapshot lacks stay as they are. A table whose rows are fewer or more than the
    manifest says isn't touched: its snapshot is broken.
    """
    manifest = {r["table"]: r["rows"] for r in spark.read.parquet(f"{path}/_manifest_").collect()}  # one row per table
    done = []
    for name in names:
        rows = spark.read.parquet(f"{path}/{name}") if name in manifest else None
        whole = rows is not None and rows.count() == manifest[name]
        if whole:
            rows.write.mode("overwrite").parquet(f"{target}/{name}")
        done.append((name, manifest.get(name), whole))
    return spark.createDataFrame(done, "table string, rows long, restored boolean")
