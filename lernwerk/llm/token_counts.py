"""Token counts by separator scan over flat token files.

A flat token file is a run of little-endian unsigned 16-bit ids with an end-of-document id after
each document and no index. It is held as a table of equal blocks (file, block, data), which are cut
without regard to documents. Every block is searched for separators with one vectorised comparison;
a prefix scan over the blocks of a file (tokens, separators, last separator so far), in two levels, gives
each block its place, so that a document that spans blocks is measured from the separator before it.

Cases: a null text counts as empty and has 0 tokens; empty documents are two separators in a row; a
file whose last document has no separator reports it as unterminated; an empty file has no documents.
Equal rows each give a row; a null doc_id is kept; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import encoding
from .common import id_and_text, materialise, null_ids, table

VOCABULARY, SEPARATOR = public_tokenizers.path("byte_bpe_50k.tiktoken"), 50_256
#: Tokens of a block.
BLOCK = 1 << 18
#: Blocks of a file whose prefix scan is one group.
SPAN = 1 << 10
FLAT = "file int, block int, data binary, doc_ids array<long>"


def write_flat(docs: DataFrame, vocabulary: str = VOCABULARY, separator: int = SEPARATOR, block: int = BLOCK) -> DataFrame:
    """Flat token files of the texts, one per partition, as blocks.

    ``doc_ids`` lists the ids of the documents that end in a block, in order: a list of names, kept
    apart from the tokens, that says nothing about where documents begin or end. A task holds the
    tokens of one block and one document at a time.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        file, no = TaskContext.get().partitionId(), 0
        encode = encoding(vocabulary).encode_ordinary
        parts: list[np.ndarray] = []
        held, ids, ends = 0, [], []  # tokens held; documents waiting for the block they end in

        def cut(flat: np.ndarray) -> pd.DataFrame:
            nonlocal no, ids, ends
            n = next((i for i, e in enumerate(ends) if e > len(flat)), len(ends))
            made = pd.DataFrame({"file": [file], "block": [no], "data": [flat.tobytes()], "doc_ids": [ids[:n]]})
            ids, ends, no = ids[n:], [e - len(flat) for e in ends[n:]], no + 1
            return made

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                tokens = np.array([*encode(text), separator], dtype="<u2")
                held += len(tokens)
                parts.append(tokens)
                ids.append(int(doc_id))
                ends.append(held)
                if held >= block:
                    flat = np.concatenate(parts)
                    for at in range(0, held - block + 1, block):
                        yield cut(flat[at : at + block])
                    parts, held = [flat[held - held % block :]], held % block
        if held:
            yield cut(np.concatenate(parts))

    return id_and_text(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(rows, FLAT)


def scanned(blocks: DataFrame, separator: int = SEPARATOR) -> DataFrame:
    """(file, block, tokens, found): places of the separators in every block, written as a table."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            flat = [np.frombuffer(x, dtype="<u2") for x in rows["data"]]
            yield pd.DataFrame({"file": rows["file"], "block": rows["block"], "tokens": [len(x) for x in flat], "found": [np.flatnonzero(x == separator) for x in flat]})

    return materialise(blocks.select("file", "block", "data").mapInPandas(find, "file int, block int, tokens long, found array<long>"), "separators")


def prefix(rows: DataFrame, into: str, kind: str, column: str, start: int) -> DataFrame:
    """``into``: the sum or max of a column over all blocks of the file before each one, from ``start`` on.

    The scan has two levels, so a task has SPAN blocks of a file or one row for each SPAN of them.
    """
    merge = {"sum": F.sum, "max": F.max}[kind]
    combine = (lambda a, b: a + b) if kind == "sum" else F.greatest
    before = lambda keys, order: W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_span", F.floor(F.col("block") / SPAN))
    spans = rows.groupBy("file", "_span").agg(merge(column).alias("_v"))
    spans = spans.select("file", "_span", F.coalesce(merge("_v").over(before(["file"], "_span")), F.lit(start)).alias("_far"))
    near = F.coalesce(merge(column).over(before(["file", "_span"], "block")), F.lit(start))
    return rows.withColumn("_near", near).join(spans, ["file", "_span"]).withColumn(into, combine(F.col("_far"), F.col("_near"))).drop("_span", "_near", "_far")


def scan(blocks: DataFrame, separator: int = SEPARATOR) -> DataFrame:
    """(file, document, start, n_tokens, terminated) of every document in flat token files.

    Only counts and last places of the blocks take part in the prefix scan; the places of the
    separators are joined to its result.
    """
    found = scanned(blocks, separator)
    slim = found.select("file", "block", "tokens", F.size("found").cast("long").alias("n"), F.try_element_at("found", F.lit(-1)).alias("last"))
    slim = prefix(prefix(slim, "base", "sum", "tokens", 0), "first", "sum", "n", 0)
    slim = prefix(slim.withColumn("last", F.coalesce(F.col("base") + F.col("last"), F.lit(-1))), "previous", "max", "last", -1)
    ends = slim.groupBy("file").agg(F.max("block").alias("end"))
    slim = slim.join(ends, "file").withColumn("end", F.col("block") == F.col("end"))
    found = found.select("file", "block", "found").join(slim, ["file", "block"])
    at = F.expr("transform(found, x -> x + base)")
    # What is left after the last separator of a file is a document without one.
    tail = F.when(F.col("end") & (F.col("base") + F.col("tokens") > F.greatest("last", "previous") + 1), F.array(F.col("base") + F.col("tokens"))).otherwise(F.array().cast("array<long>"))
    pairs = F.expr("transform(at, (x, i) -> struct(if(i = 0, previous, at[i - 1]) as before, x as at))")
    rows = found.select("file", "first", "previous", "n", F.concat(at, tail).alias("at")).withColumn("pair", pairs)
    rows = rows.select("file", "first", "n", F.posexplode("pair").alias("i", "p"))
    rows = rows.select("file", (F.col("first") + F.col("i")).alias("document"), (F.col("p.before") + 1).alias("start"), F.col("p.at").alias("stop"), (F.col("i") < F.col("n")).alias("terminated"))
    return rows.select("file", "document", "start", (F.col("stop") - F.col("start")).alias("n_tokens"), "terminated")


def names(blocks: DataFrame) -> DataFrame:
    """(file, document, doc_id): the documents' order in each file."""
    slim = prefix(blocks.select("file", "block", F.size("doc_ids").cast("long").alias("n")), "first", "sum", "n", 0)
    lists = blocks.select("file", "block", "doc_ids").join(slim, ["file", "block"])
    return lists.select("file", "first", F.posexplode("doc_ids").alias("i", "doc_id")).select("file", (F.col("first") + F.col("i")).alias("document"), "doc_id")


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, separator: int = SEPARATOR, block: int = BLOCK) -> DataFrame:
    """(doc_id, file, document, start, n_tokens) of every row, through flat token files in the shared folder."""
    blocks = materialise(write_flat(docs, vocabulary, separator, block), "tokens")
    return null_ids(scan(blocks, separator).join(names(blocks), ["file", "document"]).select("doc_id", "file", "document", "start", "n_tokens"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which file a document is in depends on how the input is split, so only its own count is returned."""
    return count_tokens(table(spark, sf_dir, "documents")).select("doc_id", "n_tokens")
