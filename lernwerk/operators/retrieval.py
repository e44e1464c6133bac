"""Embedding and hybrid retrieval (C)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.views import Registry
from . import lexical_index, vector_index

R = Registry()
RECALL, TOP, RRF_K = 30, 8, 60


def unit_vector(v) -> np.ndarray:
    x = np.asarray(v, dtype=np.float64)
    return x / max(float(np.sqrt(x @ x)), 1e-30)


def hashed_encoder(dimension: int = 64) -> Callable[[list[str]], np.ndarray]:
    """Offline encoder: hashed letter trigrams with signs. Any other encoder of texts may take its place."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimension))
        for row, text in zip(out, texts, strict=True):
            c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
            h = 961 * c[:-2] + 31 * c[1:-1] + c[2:]
            row += np.bincount(h % dimension, weights=1 - 2 * (h // dimension % 2), minlength=dimension)
        return out

    return encode


def embed_texts(rows: DataFrame, encoder: Callable[[list[str]], np.ndarray], key: str = "chunk_id", text: str = "content", batch: int = 32) -> DataFrame:
    """(key, vector) of length one; texts are sorted by length inside partitions so that batches need little padding."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            texts = part["text"].fillna("").tolist()
            found = [unit_vector(v).astype(np.float32) for at in range(0, len(texts), batch) for v in encoder(texts[at : at + batch])]
            yield pd.DataFrame({"key": part["key"], "vector": found})

    sorted_rows = rows.select(F.col(key).alias("key"), F.col(text).alias("text")).withColumn("_n", F.length("text")).sortWithinPartitions("_n").drop("_n")
    return sorted_rows.mapInPandas(encode, "key long, vector array<float>").withColumnRenamed("key", key)


def retrieval_filter(chunks: DataFrame, doc_ids: list[int] | None = None, tag_ids: list[int] | None = None) -> DataFrame:
    """Chunks of the documents that have any of the tags, before anything is ranked (C4)."""
    rows = chunks if doc_ids is None else chunks.filter(F.col("doc_id").isin(doc_ids))
    return rows if tag_ids is None else rows.filter(F.arrays_overlap("tag_ids", F.array(*(F.lit(t).cast("long") for t in tag_ids))))


def dense_topk(queries: DataFrame, chunks: DataFrame, k: int = RECALL, probes: int | None = None) -> DataFrame:
    """Cosine top-k of every query(query_id, kb_id, vector) among chunks(pk, kb_id, vector) of its base.

    Builds the index of the chunks and searches it, exactly unless ``probes`` limits the cells that
    are read; ``vector_index`` stores one for many searches.
    """
    return vector_index.search(queries, vector_index.build(chunks), k, probes)


def bm25_topk(queries: DataFrame, chunks: DataFrame, k: int = RECALL) -> DataFrame:
    """BM25 top-k of every query(query_id, kb_id, text) in its base (C3); N, df and mean length are per base.

    Builds the index of chunks(kb_id, pk, text) for the queries' terms and searches it;
    ``lexical_index`` stores one of all terms for many searches.
    """
    terms = lexical_index.query_words(queries).select("kb_id", "term")
    return lexical_index.search(queries, lexical_index.build(chunks, only=terms), k)


def rrf_fuse(first: DataFrame, second: DataFrame, top: int = TOP, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists (C5); ties to the smaller pk."""
    a, b = (x.select("query_id", "pk", F.col("rank").alias(n)) for x, n in ((first, "a"), (second, "b")))
    part = lambda c: F.coalesce(1 / (k + F.col(c)), F.lit(0.0))
    fused = a.join(b, ["query_id", "pk"], "full_outer").withColumn("score", F.round(part("a") + part("b"), 12))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "pk"))
    return fused.withColumn("rank", rank).filter(F.col("rank") <= top).select("query_id", "rank", "pk", "score")


def enrich_hits(hits: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Hits with their chunk and document; hits without either stay."""
    rows = hits.join(chunks.select(F.col("chunk_id").alias("pk"), "doc_id", "chunk_index"), "pk", "left")
    return rows.join(documents.select("doc_id", "file_name"), "doc_id", "left")


def hybrid_search(queries: DataFrame, vectors: DataFrame, texts: DataFrame | None, chunks: DataFrame, documents: DataFrame, top: int = TOP, recall: int = RECALL, doc_ids: list[int] | None = None, tag_ids: list[int] | None = None) -> DataFrame:
    """Chunks are filtered (C4), ranked by vectors and by words (C2, C3), fused (C5) and given their documents.

    chunks(chunk_id, doc_id, chunk_index, tag_ids) names what may be found; without texts the dense
    list stands alone. ``source`` says which.
    """
    allowed = retrieval_filter(chunks, doc_ids, tag_ids)
    if doc_ids is not None or tag_ids is not None:
        may = allowed.select(F.col("chunk_id").alias("pk")).distinct()
        vectors = vectors.join(may, "pk", "left_semi")
        texts = None if texts is None else texts.join(may, "pk", "left_semi")
    if texts is None:
        hits = dense_topk(queries, vectors, top).withColumn("source", F.lit("dense"))
    else:
        hits = rrf_fuse(dense_topk(queries, vectors, recall), bm25_topk(queries, texts, recall), top).withColumn("source", F.lit("hybrid"))
    return enrich_hits(hits, chunks, documents).select("query_id", "rank", "pk", "score", "source", "doc_id", "chunk_index", "file_name")


QUERIES_TEXT = "SELECT CAST(b.item_id AS BIGINT) AS query_id, k.kb_id, b.text FROM {benchmark} b CROSS JOIN {v_kb} k WHERE b.item_id % 5 = k.kb_id"
CHUNK_TEXTS = "SELECT chunk_id AS pk, kb_id, content AS text, doc_id FROM {v_chunk}"
DENSE = """SELECT * FROM (SELECT query_id, pk, s AS score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, pk) AS rank FROM (SELECT q.query_id, c.pk, list_cosine_similarity(CAST(q.vector AS DOUBLE[]), CAST(c.vector AS DOUBLE[])) AS s FROM {v_query_vector} q JOIN {v_chunk_vector} c ON c.kb_id = q.kb_id) x) y"""
WORDS = r"regexp_extract_all(regexp_replace(lower({0}), '([㐀-䶿一-鿿豈-﫿])', ' \1 ', 'g'), '[\p{L}\p{N}]+')"
BM25 = f"""w AS (SELECT kb_id, pk, {WORDS.replace("{0}", "text")} AS ws FROM ({CHUNK_TEXTS}) c), base AS (SELECT kb_id, count(*) AS n, avg(len(ws)) AS avgdl FROM w GROUP BY kb_id),
    tf AS (SELECT kb_id, pk, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT kb_id, pk, len(ws) AS dl, unnest(ws) AS term FROM w) x GROUP BY kb_id, pk, term), df AS (SELECT kb_id, term, count(*) AS df FROM tf GROUP BY kb_id, term),
    asked AS (SELECT DISTINCT query_id, kb_id, unnest({WORDS.replace("{0}", "text")}) AS term FROM ({QUERIES_TEXT}) q),
    hits AS (SELECT a.query_id, t.pk, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS score FROM asked a JOIN tf t ON t.kb_id = a.kb_id AND t.term = a.term JOIN df d ON d.kb_id = t.kb_id AND d.term = t.term JOIN base b ON b.kb_id = t.kb_id GROUP BY 1, 2),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pk) AS rank FROM hits)"""



def _bm25(s, k: int = RECALL) -> DataFrame:
    return bm25_topk(s.sql(QUERIES_TEXT), s.sql(CHUNK_TEXTS), k)


R.add("embed_texts", lambda s: embed_texts(s["v_chunk"], hashed_encoder()).select("chunk_id", F.size("vector").alias("dimension"), F.array_join(F.transform("vector", lambda x: F.round(x * F.lit(1000).cast("float"), 0).cast("int").cast("string")), ",").alias("thousandths")),
      """WITH c AS (SELECT chunk_id, string_split(concat(' ', lower(content), ' '), '') AS l FROM {v_chunk}), p AS (SELECT chunk_id, unnest(list_transform(l, lambda x: unicode(x))) AS c, unnest(range(1, len(l) + 1)) AS i FROM c),
      t AS (SELECT chunk_id, 961 * c + 31 * lead(c, 1) OVER w + lead(c, 2) OVER w AS h FROM p WINDOW w AS (PARTITION BY chunk_id ORDER BY i)), d AS (SELECT chunk_id, h % 64 AS slot, sum(1 - 2 * ((h // 64) % 2)) AS v FROM t WHERE h IS NOT NULL GROUP BY ALL),
      n AS (SELECT chunk_id, sqrt(sum(v * v)) AS n FROM d GROUP BY 1) SELECT n.chunk_id, 64 AS dimension, string_agg(CAST(CAST(round(CAST(coalesce(v, 0) / greatest(n, 1e-30) AS FLOAT) * 1000, 0) AS INT) AS VARCHAR), ',' ORDER BY s.s) AS thousandths FROM n CROSS JOIN range(0, 64) s(s) LEFT JOIN d ON d.chunk_id = n.chunk_id AND d.slot = s.s GROUP BY n.chunk_id""")  # fmt: skip
R.add("dense_topk", lambda s: dense_topk(s["v_query_vector"], s["v_chunk_vector"]).select("query_id", "rank", "pk", F.round("score", 5).alias("score")), f"SELECT query_id, rank, pk, round(score, 5) AS score FROM ({DENSE}) d WHERE rank <= 30")
R.add("bm25_topk", lambda s: _bm25(s).select("query_id", "rank", "pk", F.round("score", 5).alias("score")), f"WITH {BM25} SELECT query_id, rank, pk, round(score, 5) AS score FROM ranked WHERE rank <= 30")
#: Chinese questions, one for each twentieth note, against notes that hold Chinese sentences.
HAN_QUERIES = "SELECT doc_id AS query_id, kb_id, concat('分布式缓存的吞吐量 src', doc_id % 20, ' 第', doc_id, '次') AS text FROM {v_note} WHERE doc_id % 20 = 0"
HAN_TEXTS = "SELECT doc_id AS pk, kb_id, text FROM {v_note}"
R.add("bm25_topk_chinese", lambda s: bm25_topk(s.sql(HAN_QUERIES), s.sql(HAN_TEXTS)).select("query_id", "rank", "pk", F.round("score", 5).alias("score")),
      f"WITH {BM25.replace(CHUNK_TEXTS, HAN_TEXTS).replace(QUERIES_TEXT, HAN_QUERIES)} SELECT query_id, rank, pk, round(score, 5) AS score FROM ranked WHERE rank <= 30")
R.add("retrieval_filter", lambda s: retrieval_filter(s["v_chunk_vector"].selectExpr("pk", "pk % 10 as doc_id", "array(tag_id) as tag_ids"), [1, 2, 3], [0, 2, 4]).select("pk", "doc_id"),
      "SELECT pk, pk % 10 AS doc_id FROM {v_chunk_vector} WHERE pk % 10 IN (1, 2, 3) AND tag_id IN (0, 2, 4)")
FUSED = f"""WITH {BM25}, a AS (SELECT query_id, pk, rank FROM ({DENSE}) d WHERE rank <= 30), b AS (SELECT query_id, pk, rank FROM ranked WHERE rank <= 30), f AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.pk, b.pk) AS pk, round(coalesce(1 / (60 + a.rank), 0.0) + coalesce(1 / (60 + b.rank), 0.0), 12) AS score FROM a FULL JOIN b ON a.query_id = b.query_id AND a.pk = b.pk),
    top AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pk) AS rank, pk, score FROM f)"""
R.add("rrf_fuse", lambda s: rrf_fuse(dense_topk(s["v_query_vector"], s["v_chunk_vector"]), _bm25(s)), FUSED + " SELECT query_id, rank, pk, score FROM top WHERE rank <= 8")
R.add("enrich_hits", lambda s: enrich_hits(_bm25(s, TOP), s["v_chunk"], s["v_doc"]).select("query_id", "rank", "pk", "doc_id", "chunk_index", "file_name"),
      f"WITH {BM25} SELECT r.query_id, r.rank, r.pk, c.doc_id, c.chunk_index, d.file_name FROM ranked r LEFT JOIN {{v_chunk}} c ON c.chunk_id = r.pk LEFT JOIN {{v_doc}} d ON d.doc_id = c.doc_id WHERE r.rank <= 8")


def _hybrid(s, texts: bool = True, **filters) -> DataFrame:
    """Queries with both a vector and a text: every benchmark item with the vector of its number."""
    both = s.sql(QUERIES_TEXT).join(s["v_chunk_vector"].select(F.col("pk").alias("query_id"), "vector"), "query_id")
    chunks = s["v_chunk"].withColumn("tag_ids", F.expr("array(chunk_id % 3, 10 + chunk_id % 4)"))
    return hybrid_search(both, s["v_chunk_vector"], s.sql(CHUNK_TEXTS) if texts else None, chunks, s["v_doc"], **filters)


ENRICHED = "x.query_id, x.rank, x.pk, x.score, x.source, c.doc_id, c.chunk_index, d.file_name FROM ({0}) x LEFT JOIN {v_chunk} c ON c.chunk_id = x.pk LEFT JOIN {v_doc} d ON d.doc_id = c.doc_id"
MAY = "c.doc_id % 50 < 20 AND (c.chunk_id % 3 = 1 OR c.chunk_id % 4 = 2)"
HYBRID = FUSED.replace("{v_query_vector} q", "(SELECT x.query_id, x.kb_id, v.vector FROM (" + QUERIES_TEXT + ") x JOIN {v_chunk_vector} v ON v.pk = x.query_id) q")
R.add("hybrid_search", _hybrid, HYBRID + " SELECT " + ENRICHED.replace("{0}", "SELECT query_id, rank, pk, score, 'hybrid' AS source FROM top WHERE rank <= 8"))
FILTERED = HYBRID.replace("JOIN {v_chunk_vector} c ON", "JOIN (SELECT v.* FROM {v_chunk_vector} v JOIN {v_chunk} c ON c.chunk_id = v.pk WHERE " + MAY + ") c ON").replace("(" + CHUNK_TEXTS + ") c", "(SELECT chunk_id AS pk, kb_id, content AS text FROM {v_chunk} c WHERE " + MAY + ") c")
R.add("hybrid_search_filtered", lambda s: _hybrid(s, doc_ids=list(range(20)), tag_ids=[1, 12]), FILTERED + " SELECT " + ENRICHED.replace("{0}", "SELECT query_id, rank, pk, score, 'hybrid' AS source FROM top WHERE rank <= 8"))
R.add("hybrid_search_dense", lambda s: _hybrid(s, texts=False).withColumn("score", F.round("score", 5)), "SELECT " + ENRICHED.replace("{0}", "SELECT query_id, rank, pk, round(score, 5) AS score, 'dense' AS source FROM (" + DENSE.replace("{v_query_vector} q", "(SELECT x.query_id, x.kb_id, v.vector FROM (" + QUERIES_TEXT + ") x JOIN {v_chunk_vector} v ON v.pk = x.query_id) q") + ") d WHERE rank <= 8"))
