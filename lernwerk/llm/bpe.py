"""Byte-level BPE encoding and decoding with overlapping chunks.

A text of up to ``chunk`` characters is one piece. A longer one is cut into chunks that each reach
``overlap`` characters into the next; the chunks are pre-tokenised in parallel, each from its own
start. Where two neighbours agree on a pre-token boundary inside the overlap, their scans have
resynchronised (the pattern never looks back), so the text may be cut there. Chunks without such a
boundary are joined with the chunk before them. The pieces are then encoded on their own and the
ids put together again in order; decoding concatenates the bytes of the ids.

Cases: a null text counts as empty and gives no ids; equal rows each keep their own result row; a
null doc_id is kept; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import regex
import tiktoken
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_and_text, null_ids, table

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
CHUNK, OVERLAP = 32_768, 1_024
PIECE = "doc_id long, doc_key string, copies int, piece int, ids binary"  # ids packed by zstandard
DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


@lru_cache(maxsize=4)
def encoding(vocabulary: str) -> tiktoken.Encoding:
    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode_text(text: str, vocabulary: str = VOCABULARY) -> bytes:
    """Ids of one piece as little-endian unsigned 32-bit integers."""
    return np.asarray(encoding(vocabulary).encode_ordinary(text), dtype="<u4").tobytes()


def decode_ids(ids: bytes, vocabulary: str = VOCABULARY) -> bytes:
    return encoding(vocabulary).decode_bytes(np.frombuffer(ids, dtype="<u4").tolist())


@lru_cache(maxsize=1)
def _pattern() -> regex.Pattern:
    return regex.compile(public_tokenizers.PATTERN)


def safe_boundaries(text: str, low: int, high: int) -> list[int]:
    """Starts of pre-tokens in [low, high) that follow a character other than white space.

    A piece that ends at such a place has the same pre-tokens alone as inside the whole text.
    """
    return [s for m in _pattern().finditer(text) if low <= (s := m.start()) < high and s and not text[s - 1].isspace()]


def pack(ids: bytes) -> bytes:
    return zstandard.compress(ids, 1)


def unpack(packed: bytes) -> bytes:
    return zstandard.decompress(packed)


def _chunks(size: int, overlap: int):
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for doc_id, text in zip(rows["doc_id"].astype("Int64"), rows["text"], strict=True):
                key = hashlib.sha256(f"{doc_id} {text}".encode()).hexdigest()
                for no, at in enumerate(range(0, len(text), size)):
                    yield pd.DataFrame({"doc_id": pd.array([doc_id], dtype="Int64"), "doc_key": [key], "chunk": [no], "text": [text[at : at + size + overlap]]})

    return cut


def _edges(size: int, overlap: int) -> Column:
    @F.pandas_udf("struct<head: array<int>, tail: array<int>>")
    def edges(chunk: pd.Series, text: pd.Series) -> pd.DataFrame:
        heads, tails = [], []
        for no, part in zip(chunk, text, strict=True):
            found = safe_boundaries(part, 0, len(part))
            heads.append([no * size + x for x in found if x < overlap])
            tails.append([no * size + x for x in found if x >= size])
        return pd.DataFrame({"head": heads, "tail": tails})

    return edges(F.col("chunk"), F.col("text"))


def _encoded(size: int, vocabulary: str):
    def ids(parts: list, start: int, end: int | None) -> bytes:
        parts = sorted(parts, key=lambda x: x["chunk"])
        text = "".join(p["text"][:size] for p in parts[:-1]) + parts[-1]["text"]
        first = parts[0]["chunk"] * size
        return pack(encode_text(text[start - first : None if end is None else end - first], vocabulary))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            ends = [None if pd.isna(x) else int(x) for x in rows["end"]]
            rows["ids"] = [ids(list(p), int(s), e) for p, s, e in zip(rows["parts"], rows["start"], ends, strict=True)]
            yield rows[["doc_id", "doc_key", "copies", "piece", "ids"]].astype({"doc_id": "Int64"})

    return encode


def long_pieces(docs: DataFrame, vocabulary: str = VOCABULARY, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of texts longer than ``size``: (doc_id, doc_key, copies, piece, ids).

    Chunks, not documents, are dealt to the tasks, so one long text is pre-tokenised and encoded by
    many; only arrays of boundaries meet per document. Chunks that can't be cut from the one before
    are grouped with it; all others are encoded where they lie.
    """
    chunks = id_and_text(docs).filter(F.length("text") > size).mapInPandas(_chunks(size, overlap), "doc_id long, doc_key string, chunk int, text string")
    chunks = chunks.groupBy("doc_key", "chunk").agg(F.first("text").alias("text"), F.first("doc_id").alias("doc_id"), F.count("*").cast("int").alias("copies"))
    order = W.partitionBy("doc_key").orderBy("chunk")
    cuts = chunks.select("doc_key", "chunk", _edges(size, overlap).alias("e")).withColumn("before", F.lag("e.tail").over(order))
    start = F.when(F.col("chunk") == 0, 0).otherwise(F.array_min(F.array_intersect("before", "e.head")))
    cuts = cuts.select("doc_key", "chunk", start.alias("start"))
    starts = F.when(F.col("start").isNotNull(), F.col("chunk"))
    later = order.rowsBetween(1, W.unboundedFollowing)
    cuts = cuts.withColumns({"piece": F.last(starts, ignorenulls=True).over(order), "end": F.first("start", ignorenulls=True).over(later), "next": F.lead("start").over(order), "more": F.lead("chunk").over(order).isNotNull()})
    alone = F.col("start").isNotNull() & (F.col("next").isNotNull() | ~F.col("more"))
    cuts = cuts.select("doc_key", "chunk", "piece", "start", "end", alone.alias("alone"))
    parts = chunks.join(cuts, ["doc_key", "chunk"]).withColumn("part", F.struct("chunk", "text"))
    single = parts.filter("alone").select("doc_id", "doc_key", "copies", "piece", F.array("part").alias("parts"), "start", "end")
    joined = parts.filter("not alone").groupBy("doc_key", "piece").agg(F.first("doc_id").alias("doc_id"), F.first("copies").alias("copies"), F.collect_list("part").alias("parts"), F.max("start").alias("start"), F.max("end").alias("end"))
    return single.unionByName(joined).mapInPandas(_encoded(size, vocabulary), PIECE)


def short_texts(docs: DataFrame, size: int = CHUNK) -> DataFrame:
    return id_and_text(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter(F.length("text") <= size)


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Ids of every text by pieces: (doc_id, doc_key, copies, piece, ids).

    ``ids`` are little-endian unsigned 32-bit integers, packed by zstandard (``unpack``). Texts of one piece have a null doc_key and
    one row for each input row; rows of longer texts that are equal share pieces, counted in copies.
    """

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            ids = [pack(encode_text(x, vocabulary)) for x in rows["text"]]
            yield pd.DataFrame({"doc_id": rows["doc_id"].astype("Int64"), "doc_key": None, "copies": 1, "piece": 0, "ids": ids})

    return null_ids(short_texts(docs, size).mapInPandas(whole, PIECE).unionByName(long_pieces(docs, vocabulary, size, overlap)))


def decode(pieces: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Bytes of every piece: (doc_id, doc_key, copies, piece, bytes)."""

    @F.pandas_udf(T.BinaryType())
    def to_bytes(ids: pd.Series) -> pd.Series:
        return ids.map(lambda x: decode_ids(unpack(x), vocabulary))

    return pieces.select("doc_id", "doc_key", "copies", "piece", to_bytes("ids").alias("bytes"))


def digest(docs: DataFrame, vocabulary: str = VOCABULARY, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Per document: number of ids, SHA-256 of the ids and of the bytes they decode to."""

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            ids = [encode_text(x, vocabulary) for x in rows["text"]]
            yield pd.DataFrame({
                "doc_id": rows["doc_id"].astype("Int64"), "n_tokens": [len(x) // 4 for x in ids],
                "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
                "decoded_sha256": [hashlib.sha256(decode_ids(x, vocabulary)).hexdigest() for x in ids],
            })

    def in_order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Pieces come sorted by document and place; a document may span batches."""
        now, n, copies, ids, out = None, 0, 0, hashlib.sha256(), hashlib.sha256()

        def done() -> pd.DataFrame:
            row = {"doc_id": now[0], "n_tokens": n, "ids_sha256": ids.hexdigest(), "decoded_sha256": out.hexdigest()}
            return pd.DataFrame([row] * copies).astype({"doc_id": "Int64"})

        for rows in batches:
            for doc_id, key, times, part in zip(rows["doc_id"].astype("Int64"), rows["doc_key"], rows["copies"], rows["ids"], strict=True):
                if now is None or now[1] != key:
                    if now:
                        yield done()
                    now, n, copies, ids, out = (doc_id, key), 0, int(times), hashlib.sha256(), hashlib.sha256()
                part = unpack(part)
                n += len(part) // 4
                ids.update(part)
                out.update(decode_ids(part, vocabulary))
        if now:
            yield done()

    joined = long_pieces(docs, vocabulary, size, overlap).repartition("doc_key").sortWithinPartitions("doc_key", "piece")
    return null_ids(short_texts(docs, size).mapInPandas(whole, DIGEST).unionByName(joined.mapInPandas(in_order, DIGEST)))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))
