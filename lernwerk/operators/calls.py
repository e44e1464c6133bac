"""Batch model calls (I): prompts, calls through a client of the user's, tolerant JSON."""

from __future__ import annotations

import contextlib
import json
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.shared import materialise, new_path, release
from ..sources.views import Registry

R = Registry()
REMINDER = "Answer with one JSON object and nothing else."


def render_prompts(rows: DataFrame, template: Column, variables: dict[str, Column], into: str = "prompt") -> DataFrame:
    """The template with only the given {names} replaced, null as nothing."""
    out = template
    for name, value in variables.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return rows.withColumn(into, out)


def holds_json(answer: str | None) -> bool:
    """Whether an answer holds an object, as ``parse_llm_json`` reads it."""
    bare = re.sub(r"```(?:json)?", "", answer or "")
    inner = re.search(r"\{.*\}", bare, re.S)
    for text in (inner[0], re.sub(r",\s*([}\]])", r"\1", inner[0])) if inner else ():
        with contextlib.suppress(ValueError):
            return isinstance(json.loads(text), dict)
    return False


def llm_map(rows: DataFrame, client: Callable[[list[str]], list[str]], key: str, prompt: str = "prompt", attempts: int = 3, wait: float = 1.0, batch: int = 16, as_json: bool = False, asks: int = 2) -> DataFrame:
    """(key, response, success, retries, asked_again, latency_ms) of every row through a client for batches of prompts.

    A failing batch is tried again after 1, 2, ... seconds, at most 8; then its rows are logged as
    failed. With ``as_json``, prompts whose answers hold no object are asked up to ``asks`` times more,
    with a reminder; what then still holds none is no success.
    """

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def answers_to(prompts: list[str]) -> tuple[list[str | None], int]:
            for tries in range(attempts):
                try:
                    return client(prompts), tries
                except Exception:
                    if tries + 1 < attempts:
                        time.sleep(min(8.0, wait * 2**tries))
            return [None] * len(prompts), attempts

        for part in batches:
            for at in range(0, len(part), batch):
                some, began = part.iloc[at : at + batch], time.monotonic()
                prompts = some["prompt"].tolist()
                found, retries = answers_to(prompts)
                again = [0] * len(found)
                for _ in range(asks if as_json else 0):
                    open_ = [i for i, x in enumerate(found) if x is not None and not holds_json(x)]
                    if open_:
                        more, tries = answers_to([f"{prompts[i]}\n\n{REMINDER}" for i in open_])
                        retries += tries
                        for i, x in zip(open_, more, strict=True):
                            found[i], again[i] = x if x is not None else found[i], again[i] + 1
                success = [int(x is not None and (not as_json or holds_json(x))) for x in found]
                yield pd.DataFrame({"key": some["key"], "response": found, "success": success, "retries": retries, "asked_again": again, "latency_ms": int((time.monotonic() - began) * 1000)})

    asked = rows.select(F.col(key).alias("key"), F.col(prompt).alias("prompt"))
    kind = asked.schema["key"].dataType.simpleString()
    return asked.mapInPandas(call, f"key {kind}, response string, success int, retries int, asked_again int, latency_ms long").withColumnRenamed("key", key)


LEDGER = "digest string, response string, success int, retries int, asked_again int, latency_ms long, prompt_tokens int, completion_tokens int"


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    """All calls that are written down in the folder, by the SHA-256 of their prompt; none if it is new."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(conf).exists(path):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(folder)


def llm_map_once(rows: DataFrame, client: Callable[[list[str]], list[str]], key: str, folder: str, prompt: str = "prompt", portions: int = 16, **options) -> DataFrame:
    """``llm_map`` with a ledger of calls: equal prompts are asked once, and a job that is started again asks only what is missing.

    Distinct prompts without a successful call in the ledger are dealt into portions by their digest;
    each portion's answers are appended to the ledger in one commit. A job that is killed loses the
    portion it is at (a task that runs again asks its prompts again), so more portions lose less.
    Returns (key, response, success, retries, asked_again, latency_ms, prompt_tokens,
    completion_tokens, calls); tokens are estimates, ``calls`` counts the prompt's rows in the ledger.
    """
    spark = rows.sparkSession
    asked = rows.select(key, F.coalesce(prompt, F.lit("")).alias("prompt")).withColumn("digest", F.sha2("prompt", 256))
    known = ledger(spark, folder).filter("success = 1").select("digest")
    missing = asked.groupBy("digest").agg(F.first("prompt").alias("prompt")).join(known, "digest", "left_anti")
    missing = materialise(missing.withColumn("portion", F.pmod(F.xxhash64("digest"), F.lit(portions))), "prompts")
    for (portion,) in sorted(missing.select("portion").distinct().collect()):  # ``portions`` at most
        part = missing.filter(F.col("portion") == portion)
        found = llm_map(part, client, "digest", **options).join(part.select("digest", "prompt"), "digest")
        found = found.withColumns({"prompt_tokens": X.estimate_tokens(F.col("prompt")), "completion_tokens": X.estimate_tokens(F.col("response"))})
        found.select(*(c.split()[0] for c in LEDGER.split(", "))).write.mode("append").parquet(folder)
    release(missing)
    columns = [c.split()[0] for c in LEDGER.split(", ")][1:]
    last = ledger(spark, folder).groupBy("digest").agg(F.max_by(F.struct(*columns), "success").alias("r"), F.count("*").alias("calls"))
    return asked.join(last, "digest", "left").select(key, "r.*", "calls")


def parse_llm_json(text: Column) -> Column:
    """The object in a model's answer as a variant: fenced or bare, else from the first to the last brace, also without trailing commas; null for anything else."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    bare = F.when(fenced != "", fenced).otherwise(F.regexp_replace(text, r"```(?:json)?", ""))
    inner = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    parsed = F.coalesce(F.try_parse_json(F.trim(bare)), F.try_parse_json(inner), F.try_parse_json(F.regexp_replace(inner, r",\s*([}\]])", "$1")))
    return F.when(F.schema_of_variant(parsed).startswith("OBJECT"), parsed)



def _answers(s) -> DataFrame:
    n = F.col("p_size").cast("string")
    body = F.concat(F.lit('{"n": '), n, F.lit("}"))
    kind = F.col("p_partkey") % 6
    text = F.when(kind == 0, body).when(kind == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(kind == 2, F.concat(F.lit("Sure: "), body, F.lit(" ok"))).when(kind == 3, F.concat(F.lit('{"n": '), n, F.lit(",}"))).when(kind == 4, "[1, 2]").otherwise("no")
    return s["part"].select(F.col("p_partkey").alias("id"), text.alias("answer"))


def _offline_client() -> Callable[[list[str]], list[str]]:
    """A stand-in model: each task's first call fails; some prompts need one reminder, some two, some never give JSON."""
    calls = 0

    def client(prompts: list[str]) -> list[str]:
        nonlocal calls
        calls += 1
        if calls == 1:
            raise ConnectionError("not yet")
        out = []
        for p in prompts:
            kind, reminders = int(p.split(" ", 1)[0]) % 5, p.count(REMINDER)
            name = json.dumps(p.split("\n", 1)[0].split(" ", 1)[1].upper())
            out.append(f'```json\n{{"name": {name}}}\n```' if kind < 2 or kind == 2 and reminders else f'{{"name": {name},}}' if kind == 3 else "I can't")
        return out

    return client


R.add("render_prompts", lambda s: render_prompts(s["part"], F.lit("About {name} ({size}): {other}"), {"name": F.col("p_name"), "size": F.col("p_size")}).select("p_partkey", "prompt"),
      "SELECT p_partkey, concat('About ', p_name, ' (', p_size, '): ', chr(123), 'other', chr(125)) AS prompt FROM {part}")
R.add("llm_map", lambda s: llm_map(s["part"].select("p_partkey", F.concat_ws(" ", "p_partkey", "p_name").alias("prompt")), _offline_client(), "p_partkey", wait=0.01, as_json=True).select("p_partkey", F.try_variant_get(parse_llm_json(F.col("response")), "$.name", "string").alias("name"), "success", "asked_again"),
      "SELECT p_partkey, CASE WHEN p_partkey % 5 < 4 THEN upper(p_name) END AS name, CASE WHEN p_partkey % 5 < 4 THEN 1 ELSE 0 END AS success, CASE p_partkey % 5 WHEN 2 THEN 1 WHEN 4 THEN 2 ELSE 0 END AS asked_again FROM {part}")


def _once(s) -> DataFrame:
    """Prompts that repeat, asked in two runs over one ledger: the second one asks what the first has left."""
    prompts = s["part"].select("p_partkey", F.concat_ws(" ", F.col("p_partkey") % 20, "p_brand").alias("prompt"))
    folder = new_path(s.spark, "ledger")
    llm_map_once(prompts.filter("p_partkey % 2 = 0"), _offline_client(), "p_partkey", folder, portions=3, wait=0.01, as_json=True)
    return llm_map_once(prompts, _offline_client(), "p_partkey", folder, portions=3, wait=0.01, as_json=True)


#: Prompts that never give an object are asked by both runs if both have them.
R.add("llm_map_once", lambda s: _once(s).select("p_partkey", F.try_variant_get(parse_llm_json(F.col("response")), "$.name", "string").alias("name"), "success", "prompt_tokens", "calls"),
      """WITH p AS (SELECT p_partkey, p_partkey % 5 AS kind, concat(p_partkey % 20, ' ', p_brand) AS prompt, p_brand FROM {part}), b AS (SELECT prompt, CASE WHEN kind = 4 AND count(*) FILTER (WHERE p_partkey % 2 = 0) > 0 THEN 2 ELSE 1 END AS calls FROM p GROUP BY prompt, kind)
      SELECT p_partkey, CASE WHEN kind < 4 THEN upper(p_brand) END AS name, CASE WHEN kind < 4 THEN 1 ELSE 0 END AS success, CAST(greatest(1, floor(length(prompt) / 4)) AS INT) AS prompt_tokens, calls FROM p JOIN b USING (prompt)""")  # fmt: skip
R.add("parse_llm_json", lambda s: _answers(s).select("id", F.try_variant_get(parse_llm_json(F.col("answer")), "$.n", "int").alias("n")), "SELECT p_partkey AS id, CASE WHEN p_partkey % 6 < 4 THEN CAST(p_size AS INT) END AS n FROM {part}")
