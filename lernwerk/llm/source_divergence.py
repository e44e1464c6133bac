"""Audit of how far each source's wording lies from its language and from the other sources, by chunk factorization.

A term never spans ASCII white space, so texts are cut into white-space chunks, and the chunks are
counted once for each document. Documents are taken in blocks; a block numbers its distinct chunks
and keeps which document has which chunk how often as packed arrays. Only the chunks themselves meet
globally: every distinct chunk is taken apart into terms once, and the terms are joined back to the
blocks. There the documents of all chunks that hold a term are merged, which gives distinct
documents and occurrences; blocks only have to be added up. Terms that stand in enough documents of
a language are kept. Smoothed shares are exact integers (parts of 10^9); distances between sources
are sums over blocks of terms.

Blocks are written to the shared folder, since document numbers hold within a block only: a lost
executor can't mix two numberings.

Cases: a null text, lang or source counts as ''; every row is a document of its own, also if rows or
ids repeat; a group without terms still has its pairs; a language without kept terms has distance 0
everywhere; an empty table gives no rows; other columns are ignored. Very long texts are blocks of
their own. Equal values are ranked by the item's UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, release, table

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A term is kept in a language if it stands in so many of its documents; added to each count; parts of a share.
LEAST_DOCS, SMOOTHING, PARTS = 30, 5, 1_000_000_000
TOP_TERMS = 50
#: Bytes of text in a block; cells of a dense block of sources and terms.
BLOCK_BYTES, BLOCK_CELLS = 32 << 20, 1 << 20
#: Chunks in a row of a block.
PART = 1 << 14

_ARRAYS = ("starts", "docs", "counts", "groups", "langs")
_BLOCK = pa.schema([
    ("block", pa.int64()), ("first", pa.int32()), ("chunks", pa.list_(pa.string())), ("n_docs", pa.list_(pa.int32())),
    *((c, pa.binary()) for c in _ARRAYS),
])
_KINDS = "block long, first int, chunks array<string>, n_docs array<int>, starts binary, docs binary, counts binary, groups binary, langs binary"


def slices(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Rows in order, in tables of about ``most`` bytes of text."""
    held, size = [], 0
    for batch in batches:
        ends = np.cumsum(np.asarray(pc.binary_length(batch.column("text"))))
        at = 0
        while at < len(ends):
            base = int(ends[at - 1]) if at else 0
            end = max(at + 1, int(np.searchsorted(ends, base + most - size, "right")))
            held.append(batch.slice(at, end - at))
            size += int(ends[end - 1]) - base
            at = end
            if size >= most:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _numbered(values: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """A number for each value, and the distinct values by number."""
    found = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    found = found.dictionary_encode()
    found = found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found
    return found.indices.to_numpy(zero_copy_only=False), found.dictionary


def block_of(rows: pa.Table) -> tuple[pa.Array, dict]:
    """Distinct chunks of a block and its arrays: for each chunk, the documents that hold it and how often."""
    lists = pc.ascii_split_whitespace(rows["text"]).combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    ids, chunks = _numbered(lists.flatten())
    docs = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    empty = np.flatnonzero(np.asarray(pc.equal(chunks, "")))
    if len(empty):  # before the first and after the last chunk
        real = ids != empty[0]
        ids, docs = ids[real], docs[real]
    keys, counts = np.unique(ids.astype(np.int64) * len(lists) + docs, return_counts=True)
    starts = np.searchsorted(keys // len(lists), np.arange(len(chunks) + 1))
    arrays = {"starts": starts, "docs": np.diff(keys, prepend=0), "counts": counts, "groups": rows["group"].to_numpy(), "langs": rows["lang_no"].to_numpy()}
    return chunks, np.diff(starts), {c: packed(x) for c, x in arrays.items()}


def packed(values: np.ndarray) -> bytes:
    """Non-negative integers in as few bytes as the largest needs, all lowest bytes first, packed; the first byte tells how many."""
    kind = np.min_scalar_type(int(values.max(initial=0))).newbyteorder("<")
    return bytes([kind.itemsize]) + zstandard.compress(np.ascontiguousarray(values.astype(kind).view(np.uint8).reshape(-1, kind.itemsize).T).tobytes(), 1)


def unpacked(values: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(values[1:]), dtype=np.uint8).reshape(values[0], -1)
    return np.ascontiguousarray(planes.T).view(f"<u{values[0]}").ravel().astype(np.int64)


def numbers_in(values: np.ndarray, row: np.ndarray, rows: int) -> pa.Array:
    """Binary of each row with its values, 7 bits a byte, low ones first; the high bit says that more follow. Values come by row."""
    n_bytes = np.ones(len(values), dtype=np.int64)
    for k in range(1, 9):
        n_bytes += values >= 1 << 7 * k
    first = np.cumsum(n_bytes) - n_bytes
    out = np.zeros(int(n_bytes.sum()), dtype=np.uint8)
    for k in range(int(n_bytes.max(initial=0))):
        has = n_bytes > k
        out[first[has] + k] = values[has] >> 7 * k & 127 | np.where(n_bytes[has] > k + 1, 128, 0)
    ends = np.append(0, np.cumsum(np.bincount(row, weights=n_bytes, minlength=rows))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(out.tobytes())])


def numbers_of(cells: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values and the row of each, as ``numbers_in`` wrote them."""
    sizes = np.asarray(pc.binary_length(cells)).astype(np.int64)
    data = np.frombuffer(b"".join(cells.to_pylist()), dtype=np.uint8)
    last = np.flatnonzero(data < 128)
    first = np.append(0, last[:-1] + 1)[: len(last)]
    shift = np.arange(len(data)) - np.repeat(first, last - first + 1)
    values = np.add.reduceat((data & 127).astype(np.int64) << 7 * shift, first) if len(last) else np.zeros(0, dtype=np.int64)
    return values, np.searchsorted(np.cumsum(sizes), last, "right")


def numbered_groups(docs: DataFrame) -> DataFrame:
    """(lang, source, group, lang_no): all groups and languages that occur, numbered from 0."""
    groups = docs.select("lang", "source").distinct()
    lang = groups.select("lang").distinct().withColumn("lang_no", F.row_number().over(W.orderBy("lang")) - 1)
    ranged = materialise(groups.join(lang, "lang").repartitionByRange("lang", "source").withColumn("part", F.spark_partition_id()), "groups")
    before = ranged.groupBy("part").count().withColumn("before", F.coalesce(F.sum("count").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(W.partitionBy("part").orderBy("lang", "source")) - 1
    return materialise(ranged.withColumn("at", inside).join(before, "part").select("lang", "source", (F.col("before") + F.col("at")).cast("int").alias("group"), "lang_no"), "groups")


def chunk_blocks(texts: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of two kinds from (group, lang_no, text): a block's distinct chunks from number ``first`` on with their documents, and one with its arrays."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, rows in enumerate(slices(batches, block_bytes)):
            block = TaskContext.get().partitionId() << 32 | k
            chunks, n_docs, arrays = block_of(rows)
            yield pa.RecordBatch.from_pylist([{"block": block} | arrays], schema=_BLOCK)
            edges = pa.array(np.append(np.arange(0, len(chunks), PART), len(chunks)).astype(np.int32))
            n = len(edges) - 1
            columns = {
                "block": pa.array(np.full(n, block)), "first": edges.slice(0, n), "chunks": pa.ListArray.from_arrays(edges, chunks.cast(pa.string())),
                "n_docs": pa.ListArray.from_arrays(edges, pa.array(n_docs.astype(np.int32))),
            }
            yield pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in _BLOCK], schema=_BLOCK)

    return texts.mapInArrow(blocks, _KINDS)


def chunk_terms(chunks: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(chunk, term): every globally distinct chunk taken apart once; a term that repeats in it repeats.

    Terms whose chunks together stand in too few documents are left out, since they can't be kept.
    """
    once = chunks.groupBy("chunk").agg(F.sum(F.when(F.col("block").isNotNull(), F.col("at").bitwiseAND(F.lit(2**32 - 1)))).alias("n_docs"))
    terms = once.select("chunk", "n_docs", F.explode(F.regexp_extract_all(F.translate("chunk", UPPER, LOWER), F.lit(TERM), F.lit(0))).alias("term"))
    return terms.withColumn("most", F.sum("n_docs").over(W.partitionBy("term"))).filter(F.col("most") >= least_docs).select("chunk", "term")


def _merged(arrays: pa.Table, found: pa.Table, groups: int) -> pa.Table:
    """Adds up one block: rows of ``found`` are (no, term); documents of a term's chunks count once."""
    get = {c: unpacked(arrays[c][0].as_py()) for c in _ARRAYS}
    terms, names = _numbered(found["term"])
    no = found["no"].to_numpy()
    get["docs"] = np.cumsum(get["docs"]) % len(get["groups"])
    first = get["starts"][no]
    many = get["starts"][no + 1] - first
    at = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())
    n_docs = len(get["groups"])
    keys = np.repeat(terms.astype(np.int64), many) * n_docs + get["docs"][at]
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], get["counts"][at][order]
    new = np.flatnonzero(np.diff(keys, prepend=-1))  # one for each term and document
    counts, keys = np.add.reduceat(counts, new), keys[new]
    lang, group = get["langs"][keys % n_docs], get["groups"][keys % n_docs]
    order = np.lexsort((group, lang, keys // n_docs))
    term, lang, group, counts = keys[order] // n_docs, lang[order], group[order], counts[order]
    new = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(group, prepend=-1) != 0))
    n, docs, term, lang, group = np.add.reduceat(counts, new), np.diff(np.append(new, len(term))), term[new], lang[new], group[new]
    new = (np.diff(term, prepend=-1) != 0) | (np.diff(lang, prepend=-1) != 0)  # term and language
    row = np.cumsum(new) - 1
    new = np.flatnonzero(new)
    return pa.table({"lang_no": pa.array(lang[new].astype(np.int32)), "term": names.take(pa.array(term[new])), "n_docs": pa.array(np.add.reduceat(docs, new)), "cells": numbers_in(n * groups + group, row, len(new))})


def term_counts(blocks: DataFrame, groups: int, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang_no, term, group, n): occurrences of every kept term in every group that has it; groups are numbers under ``groups``."""
    empty = pa.schema([("lang_no", pa.int32()), ("term", pa.string()), ("n_docs", pa.int64()), ("cells", pa.binary())]).empty_table()

    def merge(arrays: pa.Table, found: pa.Table) -> pa.Table:
        return _merged(arrays, found, groups) if len(found) else empty

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            values, row = numbers_of(rows.column("cells"))
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([rows.column("lang_no").take(at), rows.column("term").take(at), pa.array((values % groups).astype(np.int32)), pa.array(values // groups)], names=["lang_no", "term", "group", "n"])

    chunks = blocks.select("block", "first", F.posexplode(F.arrays_zip("chunks", "n_docs")).alias("place", "c"))
    at = F.shiftleft((F.col("first") + F.col("place")).cast("long"), 32) + F.col("c.n_docs")  # both in one, so that count and join read one exchange
    chunks = chunks.select("block", at.alias("at"), F.col("c.chunks").alias("chunk")).filter("chunk is not null").repartition("chunk")
    found = chunks.join(chunk_terms(chunks, least_docs), "chunk").select("block", F.shiftright("at", 32).cast("int").alias("no"), "term")
    arrays = blocks.filter("starts is not null").select(F.col("block").alias("own"), *_ARRAYS)
    counted = arrays.groupBy("own").cogroup(found.groupBy("block")).applyInArrow(merge, "lang_no int, term string, n_docs long, cells binary")
    kept = counted.withColumn("n_docs", F.sum("n_docs").over(W.partitionBy("lang_no", "term"))).filter(F.col("n_docs") >= least_docs)
    found = kept.select("lang_no", "term", "cells").mapInArrow(cells, "lang_no int, term string, group int, n long")
    return found.groupBy("lang_no", "term", "group").agg(F.sum("n").alias("n"))


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (n + 5) / (total + 5 kept)) in exact integers; 1 where nothing is kept."""
    above = (F.lit(PARTS).cast("decimal(20,0)") * (n + SMOOTHING).cast("decimal(18,0)")).cast("decimal(38,0)")
    below = (total + SMOOTHING * kept).cast("decimal(38,0)")
    whole = F.call_function("div", above, below)
    return F.when(kept > 0, F.lit(1) + whole).otherwise(F.lit(1)).cast("long")


def _distances(rows: pd.DataFrame) -> pd.DataFrame:
    """Distances of all pairs of a language's sources over one block of terms; rows without a term are the sources."""
    sources = rows[rows["term"].isna()].sort_values("source")
    cells = rows[rows["term"].notna()]
    terms, names = pd.factorize(cells["term"])
    shares = np.repeat(sources["p"].to_numpy()[:, None], len(names), axis=1)
    shares[pd.Index(sources["source"]).get_indexer(cells["source"]), terms] = cells["p"].to_numpy()
    n = len(shares)
    values = np.array([np.abs(shares - own).sum(axis=1) for own in shares]).reshape(n, n)
    own, other = np.nonzero(~np.eye(n, dtype=bool))
    ids = sources["source"].to_numpy()
    return pd.DataFrame({"lang": rows["lang"].iloc[0], "source": ids[own], "item": ids[other], "value": values[own, other]})


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(lang, source, part, item, value, rank): distances of each source to the others, and its most overused terms."""
    texts = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    numbered = numbered_groups(texts)
    blocks = materialise(chunk_blocks(texts.join(numbered, ["lang", "source"]).select("group", "lang_no", "text"), block_bytes), "chunks", "zstd")
    counted = materialise(term_counts(blocks, max(1, numbered.count()), least_docs), "cells")
    release(blocks)
    cells = counted.join(numbered.drop("lang_no"), "group").select("lang", "term", "source", "n")
    groups = numbered.select("lang", "source")
    kept = cells.groupBy("lang").agg(F.countDistinct("term").alias("kept"), F.sum("n").alias("lang_total"))
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = groups.join(totals, ["lang", "source"], "left").join(kept, "lang", "left").na.fill(0, ["total", "kept", "lang_total"])
    groups = groups.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("kept") * F.count("*").over(W.partitionBy("lang")) / BLOCK_CELLS), F.ceil(F.col("kept") / 4096)).cast("int"))
    groups = materialise(groups, "groups")
    rows = cells.withColumn("in_lang", F.sum("n").over(W.partitionBy("lang", "term"))).join(groups, ["lang", "source"])
    rows = rows.withColumns({"p": share(F.col("n"), F.col("total"), F.col("kept")), "q": share(F.col("in_lang"), F.col("lang_total"), F.col("kept"))})
    order = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    over = rows.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    over = over.withColumn("rank", order).filter(F.col("rank") <= top)
    no_term = groups.select("lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "source", F.lit(None).cast("string").alias("term"), share(F.lit(0), F.col("total"), F.col("kept")).alias("p"))
    dense = rows.select("lang", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"), "source", "term", "p").unionByName(no_term)
    pairs = dense.groupBy("lang", "block").applyInPandas(_distances, "lang string, source string, item string, value long")
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    out = over.unionByName(pairs.withColumn("rank", order))
    return out.withColumn("rank", F.col("rank").cast("int"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


SQL = f"""
with d as (select coalesce(lang, '') lang, coalesce(source, '') source, coalesce(text, '') body, row_number() over () doc from documents),
words as (select lang, source, doc, translate(unnest(regexp_extract_all(body, '{TERM}')), '{UPPER}', '{LOWER}') term from d),
kept as (select lang, term, count(*) lang_n from words group by all having count(distinct doc) >= {LEAST_DOCS}),
langs as (select lang, count(*) v, sum(lang_n) lang_total from kept group by all),
counts as (select lang, source, term, count(*) n from words semi join kept using (lang, term) group by all),
groups as (select distinct lang, source from d),
totals as (select lang, source, sum(n) total from counts group by all),
dense as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) n, 1 + ({PARTS}::hugeint * (coalesce(c.n, 0) + {SMOOTHING})) // (coalesce(t.total, 0) + {SMOOTHING} * l.v)::hugeint p,
         1 + ({PARTS}::hugeint * (k.lang_n + {SMOOTHING})) // (l.lang_total + {SMOOTHING} * l.v)::hugeint q
  from groups g join kept k using (lang) join langs l using (lang) left join totals t using (lang, source) left join counts c on c.lang = g.lang and c.source = g.source and c.term = k.term),
sums as (select a.lang, a.source, b.source item, sum(abs(a.p - b.p)) value from dense a join dense b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
rows as (
  select a.lang, a.source, 'pair' part, b.source item, coalesce(s.value, 0) value from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join sums s on s.lang = a.lang and s.source = a.source and s.item = b.source
  union all select lang, source, 'term', term, p - q from dense where n > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item) rank from rows)
select lang, source, part, item, value::bigint as value, rank::int as rank from ranked where part = 'pair' or rank <= {TOP_TERMS}
"""
