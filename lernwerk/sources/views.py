"""Study tables derived from the generic test tables, as one text for Spark and for the SQL twins.

In a view's text, ``{name}`` stands for a table or another view.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    "v_kb": "SELECT CAST(r_regionkey AS BIGINT) AS kb_id, r_name AS name, CAST(r_regionkey AS BIGINT) AS created_order FROM {region}",
    "v_tag": """SELECT CAST(1000 + n_nationkey AS BIGINT) AS tag_id, CAST(n_regionkey AS BIGINT) AS kb_id, CAST(0 AS BIGINT) AS parent_id, n_name AS name, 1 AS level, CAST(n_nationkey AS BIGINT) AS sort_order FROM {nation}
        UNION ALL SELECT CAST(100000 + s_suppkey AS BIGINT), CAST(n_regionkey AS BIGINT), CAST(1000 + n_nationkey AS BIGINT), s_name, 2, CAST(s_suppkey AS BIGINT) FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey
        UNION ALL SELECT CAST(1000000 + s_suppkey * 10 + f.k AS BIGINT), CAST(n_regionkey AS BIGINT), CAST(100000 + s_suppkey AS BIGINT), concat(s_name, ' ', f.flag), 3, CAST(f.k AS BIGINT)
        FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey CROSS JOIN (SELECT 0 AS k, 'A' AS flag UNION ALL SELECT 1, 'N' UNION ALL SELECT 2, 'R') f""",
    "v_question": """SELECT CAST(p_partkey AS BIGINT) AS question_id, CAST(p_partkey % 5 AS BIGINT) AS kb_id, CAST((p_size - 1) % 9 + 1 AS INT) AS q_type,
        CAST(p_partkey % 3 + 1 AS INT) AS difficulty, p_name AS stem, p_brand AS answer, p_type AS analysis,
        CASE WHEN p_partkey % 10 = 0 THEN 0 WHEN p_partkey % 10 = 9 THEN 2 ELSE 1 END AS status FROM {part}""",
    "v_option": """SELECT question_id, k.option_key, concat(stem, ' ', k.option_key) AS content, CASE WHEN k.i = question_id % 4 THEN 1 ELSE 0 END AS is_correct, k.i AS sort_order
        FROM {v_question} CROSS JOIN (SELECT 0 AS i, 'A' AS option_key UNION ALL SELECT 1, 'B' UNION ALL SELECT 2, 'C' UNION ALL SELECT 3, 'D') k WHERE q_type IN (1, 2)""",
    "v_question_tag": """SELECT DISTINCT CAST(l_partkey AS BIGINT) AS question_id,
        CAST(1000000 + l_suppkey * 10 + CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS BIGINT) AS tag_id, CAST(n_regionkey AS BIGINT) AS kb_id
        FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey WHERE l_partkey % 5 = n_regionkey""",
    "v_exam": """SELECT CAST(o_orderkey AS BIGINT) AS exam_id, CAST(o_custkey AS BIGINT) AS user_id, CAST(o_orderkey % 5 AS BIGINT) AS kb_id,
        CASE o_orderstatus WHEN 'P' THEN 0 ELSE 3 END AS status, CAST(o_orderdate AS TIMESTAMP) AS submitted_at, CAST(o_orderdate AS TIMESTAMP) AS graded_at FROM {orders}""",
    "v_answer": """SELECT answer_id, exam_id, question_id, q_type, full_score, round(full_score * (1 - 10 * l_discount), 1) AS score
        FROM (SELECT CAST(l_orderkey * 1000000 + l_partkey AS BIGINT) AS answer_id, CAST(l_orderkey AS BIGINT) AS exam_id, CAST(l_partkey AS BIGINT) AS question_id, l_discount,
        CAST((p_size - 1) % 9 + 1 AS INT) AS q_type, CASE WHEN (p_size - 1) % 9 + 1 <= 4 THEN 5.0E0 ELSE 10.0E0 END AS full_score,
        row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber, l_suppkey, l_extendedprice) AS rn FROM {lineitem} JOIN {part} ON l_partkey = p_partkey) x WHERE rn = 1""",
    "v_attempt": """SELECT user_id, question_id, exam_id, ts, rate FROM (SELECT CAST(o_custkey % 20 AS BIGINT) AS user_id, CAST(l_partkey % 100 AS BIGINT) AS question_id, CAST(o_orderkey AS BIGINT) AS exam_id,
        CAST(o_orderdate AS TIMESTAMP) AS ts, round(1 - 10 * l_discount, 1) AS rate, row_number() OVER (PARTITION BY o_orderkey, l_partkey % 100 ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey) x WHERE rn = 1""",
    "v_mistake": """SELECT user_id, question_id, question_id % 5 AS kb_id, CAST(sum(CASE WHEN rate < 0.8 THEN 1 ELSE 0 END) AS INT) AS wrong_count, CAST(count(*) % 4 AS INT) AS repetitions, CAST(count(*) % 40 AS INT) AS interval_days,
        CAST(max(ts) AS TIMESTAMP) AS next_review_at, CASE WHEN count(*) % 11 = 0 THEN 1 ELSE 0 END AS mastered FROM {v_attempt} GROUP BY user_id, question_id""",
    "v_call_log": """SELECT CAST(event_id AS BIGINT) AS call_id, ts AS created_at, event_type AS task_type, concat('vendor', CAST(user_id % 3 AS STRING)) AS vendor, concat('model', CAST(user_id % 7 AS STRING)) AS model,
        CAST(floor(value) AS BIGINT) AS prompt_tokens, CAST(floor(value / 2) AS BIGINT) AS completion_tokens, CAST(floor(value * 10) AS BIGINT) AS latency_ms,
        CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS success FROM {events}""",
    "v_doc": "SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(doc_id % 5 AS BIGINT) AS kb_id, source AS file_name, replace(text, chr(10), concat(chr(10), chr(10))) AS text FROM {documents}",
    "v_book": """SELECT doc_id, kb_id, concat('# Book ', doc_id % 7, chr(10), chr(10), substring(text, 1, 300), chr(10), chr(10), '## Part one', chr(10), chr(10), substring(text, 301, 300), chr(10), chr(10), '1.2 Scope of the part', chr(10), chr(10), substring(text, 601, 400), chr(10), chr(10),
        CASE WHEN doc_id % 3 = 0 THEN '### Deeper' WHEN doc_id % 3 = 1 THEN '第二章 方法' ELSE '# Book two' END, chr(10), chr(10), substring(text, 1001, 2500), chr(10), chr(10), '三、小结', chr(10), chr(10), '分布式系统里的缓存要防止穿透；一致性由协议保证。', chr(10), chr(10), substring(text, 3501)) AS text FROM {v_doc}""",
    "v_note": """SELECT doc_id, kb_id, concat(text, chr(10), CASE WHEN doc_id % 2 = 0 THEN concat('我们使用', file_name, '与MyBatis实现一个分布式缓存，因为系统需要处理大量请求；例如布隆过滤器可以拦截不存在的键', doc_id, '。这个结论在第', doc_id, '次压力测试里得到验证，吞吐量提高了一倍，延迟下降了一半，错误率也降低了许多，所以团队决定在所有服务里推广这一方案，并且持续观察它在高峰期的表现和资源占用情况。')
        ELSE concat('The Kafka broker keeps `', chr(123), 'a` and b for Redis and its clients; Redis answers Kafka. A `', chr(123), 'c', chr(125), '` is no sentence of theirs.') END) AS text FROM {v_doc}""",
    "v_speech": """SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS seq, CASE role WHEN 'assistant' THEN 2 ELSE 1 END AS role, CASE (conv_id + turn) % 12 WHEN 0 THEN concat('嗯，那个，', text) WHEN 1 THEN concat('我我我觉得', text, '，对吧') WHEN 2 THEN concat('就是就是，应该应该应该', text, '。。。') WHEN 3 THEN concat('哈哈哈，请做个自我介绍', text, ' ')
        WHEN 4 THEN concat('额……就是说，  排序的复杂度，，', text) WHEN 5 THEN concat('你做的项目。这个问题，啊啊啊，', text) WHEN 6 THEN concat('如果线上故障，', text, '，嗯。') WHEN 7 THEN concat('你有什么想问我们的', text) WHEN 8 THEN concat('为什么', text) WHEN 9 THEN concat(text, '？') WHEN 10 THEN concat('，、 ', text) ELSE text END AS text FROM {conversations}""",
    "v_turn": "SELECT CAST(conv_id AS BIGINT) AS interview_id, CAST(turn AS BIGINT) AS seq, CASE role WHEN 'assistant' THEN 2 ELSE 1 END AS role, text AS content FROM {conversations} WHERE role <> 'system'",
    "v_chunk": """SELECT CAST(doc_id AS BIGINT) AS chunk_id, CAST(doc_id % 50 AS BIGINT) AS doc_id, CAST(doc_id % 5 AS BIGINT) AS kb_id, CAST(floor(doc_id / 50) AS INT) AS chunk_index, text AS content, CAST(n_chars AS INT) AS n_chars FROM {documents}""",
    "v_chunk_tag": """SELECT c.chunk_id, t.tag_id, t.kb_id FROM {v_chunk} c JOIN {v_tag} t ON c.kb_id = t.kb_id AND (c.chunk_id + t.sort_order) % 7 = 0 WHERE t.level = 2""",
    "v_paper_item": "SELECT CAST(l_orderkey AS BIGINT) AS paper_id, question_id, CAST(sort_order AS INT) AS sort_order FROM (SELECT l_orderkey, CAST(l_partkey AS BIGINT) AS question_id, min(l_linenumber) AS sort_order FROM {lineitem} GROUP BY l_orderkey, l_partkey) x",
    "v_paper": "SELECT CAST(o_orderkey AS BIGINT) AS paper_id, CAST(o_orderkey % 5 AS BIGINT) AS kb_id FROM {orders}",
    "v_review_log": "SELECT user_id, question_id, exam_id, ts AS reviewed_at, rate AS score_rate FROM {v_attempt} WHERE rate >= 0.8",
    "v_query_vector": "SELECT CAST(vec_id AS BIGINT) AS query_id, embedding AS vector, CAST(vec_id % 5 AS BIGINT) AS kb_id FROM {embeddings} WHERE vec_id % 20 = 0",
    "v_chunk_vector": "SELECT CAST(vec_id AS BIGINT) AS pk, embedding AS vector, CAST(vec_id % 5 AS BIGINT) AS kb_id, CAST(label AS BIGINT) AS tag_id FROM {embeddings}",
}
#: Pieces that the chunks of one base and remainder are dealt in.
PIECES = 16
#: Points in time that time-dependent queries are asked for.
AS_OF, EVENTS_AS_OF = "TIMESTAMP '2001-08-02 00:00:00'", "TIMESTAMP '2024-01-31 00:00:00'"


def names_in(text: str) -> list[str]:
    """Views a text needs, each after those it needs itself."""
    out: list[str] = []
    for name in re.findall(r"\{(v_\w+)\}", text):
        out += [x for x in [*names_in(VIEWS[name]), name] if x not in out]
    return out


def twin(text: str) -> str:
    """Stand-alone SQL: the views a text uses become common table expressions."""
    needed = names_in(text)
    plain = lambda x: re.sub(r"\{([a-z]\w+)\}", lambda m: m[1] if m[1] in TABLES or m[1] in VIEWS else m[0], x)
    if not needed:
        return plain(text)
    recursive = "RECURSIVE " if re.match(r"\s*WITH RECURSIVE", text) else ""
    body = re.sub(r"^\s*WITH (RECURSIVE )?", ", ", text) if re.match(r"\s*WITH ", text) else text
    return f"WITH {recursive}" + ", ".join(f"{n} AS ({plain(VIEWS[n])})" for n in needed) + " " + plain(body)


def chunk_tags(chunks: DataFrame, tags: DataFrame) -> DataFrame:
    """The rows of ``v_chunk_tag``, whose join by base alone would have as many tasks as there are bases.

    The remainder becomes part of the key, so no pair is made that it drops, and chunks are dealt in pieces.
    """
    c = chunks.select("chunk_id", F.col("kb_id").alias("_kb"), F.pmod("chunk_id", F.lit(7)).alias("_left"), F.pmod(F.xxhash64("chunk_id"), F.lit(PIECES)).alias("_piece"))
    t = tags.filter("level = 2").select("tag_id", "kb_id", F.pmod(-F.col("sort_order"), F.lit(7)).alias("_rest"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PIECES - 1).cast("long"))).alias("_part"))
    return c.join(t, (c["_kb"] == t["kb_id"]) & (c["_left"] == t["_rest"]) & (c["_piece"] == t["_part"])).select("chunk_id", "tag_id", "kb_id")


class Source:
    """Tables and views of one folder, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getitem__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name == "v_chunk_tag":
            return chunk_tags(self["v_chunk"], self["v_tag"])
        return self.sql(VIEWS[name])

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text, **{x: self[x] for x in set(re.findall(r"\{(\w+)\}", text))})


Query = Callable[[Source], DataFrame]


class Registry:
    """Queries of a module with their SQL twins."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, query: Query, oracle: str | None = None) -> None:
        self.queries[name] = lambda spark, sf_dir: query(Source(spark, sf_dir))
        if oracle:
            self.oracles[name] = twin(oracle)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
