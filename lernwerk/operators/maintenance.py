"""Table maintenance (A): duplicates, reconciliation, cascades, merges and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources import corpus
from ..sources.shared import new_path
from ..sources.views import Registry, union_all
from .digests import reconcile_differences

R = Registry()


def dedup_by_hash(docs: DataFrame) -> DataFrame:
    """docs(doc_id, kb_id, text) with their content hash and the first document of the base that has it (A4).

    The first id per hash is aggregated before it is joined, so many equal documents cost one row.
    """
    rows = docs.select("doc_id", "kb_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("hash"))
    first = rows.groupBy("kb_id", "hash").agg(F.min("doc_id").alias("first_id"))
    return rows.join(first, ["kb_id", "hash"]).withColumn("duplicate", F.col("doc_id") != F.col("first_id"))


def new_documents(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Documents whose hash the base doesn't have yet: known(kb_id, hash) (A4)."""
    return dedup_by_hash(docs).filter("not duplicate").join(known, ["kb_id", "hash"], "left_anti")


def reconcile_index(chunks: DataFrame, index: DataFrame) -> DataFrame:
    """(pk, status): orphan (only in the index), missing (only in the table), misplaced (wrong partition) or ok."""
    a, b = chunks.select("pk", "kb_id"), index.select("pk", "partition")
    rows = a.withColumn("_a", F.lit(True)).join(b.withColumn("_b", F.lit(True)), "pk", "full_outer")
    status = F.when(F.col("_a").isNull(), "orphan").when(F.col("_b").isNull(), "missing").when(F.col("partition") != F.concat(F.lit("kb_"), F.col("kb_id").cast("string")), "misplaced").otherwise("ok")
    return rows.select("pk", status.alias("status"))


def reconcile_report(statuses: DataFrame) -> DataFrame:
    """One row of counts and whether the index is healthy."""
    n = lambda s: F.count_if(F.col("status") == s)
    return statuses.agg(F.count("*").alias("total"), n("orphan").alias("orphan"), n("missing").alias("missing"), n("misplaced").alias("misplaced")).withColumn("healthy", F.col("orphan") + F.col("missing") + F.col("misplaced") == 0)


def purge_orphans(index: DataFrame, chunks: DataFrame) -> DataFrame:
    """The index without rows that have no chunk; all of them go (A10)."""
    return index.join(chunks.select("pk"), "pk", "left_semi")


#: What goes with a row: (table, the table above, their columns in both). No row is left that points to a removed one.
CASCADES = {
    "kb": [("exam", "kb", {"kb_id": "kb_id"}), ("answer", "exam", {"exam_id": "exam_id"}), ("mistake", "kb", {"kb_id": "kb_id"}), ("review_log", "mistake", {"user_id": "user_id", "question_id": "question_id"}), ("question", "kb", {"kb_id": "kb_id"}), ("option", "question", {"question_id": "question_id"}),
           ("question_tag", "question", {"question_id": "question_id"}), ("answer", "question", {"question_id": "question_id"}), ("paper", "kb", {"kb_id": "kb_id"}), ("paper_item", "paper", {"paper_id": "paper_id"}), ("paper_item", "question", {"question_id": "question_id"}),
           ("document", "kb", {"kb_id": "kb_id"}), ("chunk", "kb", {"kb_id": "kb_id"}), ("chunk_tag", "kb", {"kb_id": "kb_id"}), ("tag", "kb", {"kb_id": "kb_id"})],
    "document": [("chunk", "document", {"doc_id": "doc_id"}), ("chunk_tag", "chunk", {"chunk_id": "chunk_id"})],
    "tag": [("tag", "tag", {"parent_id": "tag_id"}), ("tag", "tag", {"parent_id": "tag_id"}), ("chunk_tag", "tag", {"tag_id": "tag_id"}), ("question_tag", "tag", {"tag_id": "tag_id"})],
    "interview": [("turn", "interview", {"interview_id": "interview_id"})],
    "resume": [("interview", "resume", {"resume_id": "resume_id"}), ("turn", "interview", {"interview_id": "interview_id"})],
    "paper": [("paper_item", "paper", {"paper_id": "paper_id"})],
    "paper_with_questions": [("paper_item", "paper", {"paper_id": "paper_id"}), ("question", "paper_item", {"question_id": "question_id"}), ("option", "question", {"question_id": "question_id"}), ("question_tag", "question", {"question_id": "question_id"}), ("paper_item", "question", {"question_id": "question_id"})],
}


def cascade_delete(tables: dict[str, DataFrame], kind: str, key: str, gone: DataFrame) -> dict[str, DataFrame]:
    """Tables after rows of one kind and all their dependents are deleted (A11): gone(key).

    A table meets the keys of what is removed above it; its own removed rows are never held against it.
    """
    top = kind.partition("_with_")[0]
    removed, left = {top: tables[top].join(gone, key, "left_semi") if top in tables else gone}, dict(tables)
    if top in tables:
        left[top] = tables[top].join(gone, key, "left_anti")
    for table, above, columns in CASCADES[kind]:
        if table in tables and above in removed:
            keys = removed[above].select(*(F.col(theirs).alias(own) for own, theirs in columns.items())).distinct()
            more = tables[table].join(keys, list(columns), "left_semi")
            removed[table] = removed[table].unionByName(more) if table in removed else more
            left[table] = left[table].join(keys, list(columns), "left_anti")
    return left


def merge_ignore(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is taken are ignored; of equal new keys one stays."""
    return existing.unionByName(new.dropDuplicates(keys).join(existing, keys, "left_anti").select(*existing.columns))


def merge_replace(existing: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last new row of each key by ``order`` replaces what was there."""
    both = existing.withColumns({"_new": F.lit(0), "_o": F.lit(None).cast("long")}).unionByName(new.withColumns({"_new": F.lit(1), "_o": F.col(order).cast("long")}).select(*existing.columns, "_new", "_o"))
    best = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("_new"), F.desc("_o")))
    return both.withColumn("_r", best).filter("_r = 1").select(*existing.columns)


def merge_partial(existing: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Columns of the changes that aren't null overwrite those of the row with the same key."""
    given = [c for c in changes.columns if c not in keys]
    rows = existing.join(changes.withColumnsRenamed({c: f"_{c}" for c in given}), keys, "left")
    return rows.withColumns({c: F.coalesce(f"_{c}", c) for c in given}).select(*existing.columns)


#: Rows of a page at most; pages also end at a megabyte.
PAGE = 1_000_000


def snapshot_and_restore(s) -> DataFrame:
    """A snapshot of some tables, changes to them, and what a restore leaves: rows, sum of ids and whether each table was in it."""
    path, target = new_path(s.spark, "snapshot"), new_path(s.spark, "restored")
    saved = {"question": s["v_question"], "tag": s["v_tag"], "option": s["v_option"]}
    manifest = corpus.snapshot_tables(saved, path)
    changed = {"question": s["v_question"].filter("kb_id < 2"), "tag": s["v_tag"].withColumn("name", F.lit("")), "option": s["v_option"].limit(0), "chunk_tag": s["v_chunk_tag"]}
    for name, rows in changed.items():  # links repeat the same tags for chunk after chunk, which pages of many rows and this codec tell
        rows.write.option("parquet.page.row.count.limit", PAGE).parquet(f"{target}/{name}", compression="zstd")
    report = corpus.restore_tables(s.spark, path, target, list(changed))
    left = union_all([s.spark.read.parquet(f"{target}/{n}").agg(F.lit(n).alias("table"), F.count("*").alias("left_rows"), F.sum(k).alias("ids")) for n, k in (("question", "question_id"), ("tag", "tag_id"), ("option", "question_id"), ("chunk_tag", "tag_id"))])
    left = left.join(manifest.select("table", "version"), "table", "left")
    return left.join(report, "table").select(F.col("table").alias("table_name"), "left_rows", "ids", "restored", "version")


INDEX = "SELECT CASE WHEN chunk_id % 97 = 0 THEN -chunk_id - 1 ELSE chunk_id END AS pk, concat('kb_', CAST(CASE WHEN chunk_id % 89 = 0 THEN kb_id + 1 ELSE kb_id END AS STRING)) AS partition FROM {v_chunk}"
STATUS = f"""SELECT coalesce(c.chunk_id, i.pk) AS pk, CASE WHEN c.chunk_id IS NULL THEN 'orphan' WHEN i.pk IS NULL THEN 'missing' WHEN i.partition <> concat('kb_', c.kb_id) THEN 'misplaced' ELSE 'ok' END AS status FROM {{v_chunk}} c FULL JOIN ({INDEX}) i ON i.pk = c.chunk_id"""


def _chunks(s) -> DataFrame:
    return s["v_chunk"].withColumnRenamed("chunk_id", "pk")


def _exported(s) -> DataFrame:
    return corpus.export_questions_json(s["v_question"], s["v_option"], s["v_question_tag"], s["v_tag"])


def _cascade(s, kind: str, key: str, gone: DataFrame) -> DataFrame:
    names = {"question": "v_question", "option": "v_option", "question_tag": "v_question_tag", "tag": "v_tag", "chunk": "v_chunk", "chunk_tag": "v_chunk_tag", "exam": "v_exam", "answer": "v_answer", "mistake": "v_mistake", "review_log": "v_review_log", "paper": "v_paper", "paper_item": "v_paper_item", "document": "v_doc"}
    left = cascade_delete({n: s[v] for n, v in names.items()}, kind, key, gone)
    return union_all([rows.agg(F.lit(n).alias("table_name"), F.count("*").alias("rows")) for n, rows in left.items()])


R.add("scan_tables", lambda s: s["v_question"].agg(F.count("*").alias("questions"), F.sum("question_id").alias("ids")), "SELECT count(*) AS questions, CAST(sum(question_id) AS BIGINT) AS ids FROM {v_question}")
R.add("load_text_corpus", lambda s: s["documents"].select("doc_id", F.length(corpus.decode_text(F.encode("text", "UTF-8"))).alias("n")), "SELECT doc_id, length(text) AS n FROM {documents}")
R.add("admit_files", lambda s: corpus.admit_files(s["v_doc"].select("doc_id", F.concat("file_name", F.when(F.col("doc_id") % 3 == 0, ".PDF").when(F.col("doc_id") % 3 == 1, ".exe").otherwise(".md")).alias("path"), F.length("text").alias("size")), ["pdf", "md"], 5000).select("doc_id", "reason"),
      "SELECT doc_id, CASE WHEN length(text) <= 0 THEN 'empty' WHEN length(text) > 5000 THEN 'too large' WHEN doc_id % 3 = 1 THEN 'extension not allowed' END AS reason FROM {v_doc}")
R.add("dedup_by_hash", lambda s: dedup_by_hash(s["v_doc"]), "SELECT d.doc_id, d.kb_id, sha256(d.text) AS hash, min(d.doc_id) OVER (PARTITION BY d.kb_id, d.text) AS first_id, d.doc_id <> min(d.doc_id) OVER (PARTITION BY d.kb_id, d.text) AS duplicate FROM {v_doc} d")
R.add("export_questions_json", lambda s: _exported(s).select("question_id", F.array_join(F.transform("options", lambda o: o["key"]), ",").alias("keys"), F.array_join("tags", ",").alias("tags")),
      """SELECT q.question_id, o.k AS keys, t.t AS tags FROM {v_question} q LEFT JOIN (SELECT question_id, string_agg(option_key, ',' ORDER BY sort_order) AS k FROM {v_option} GROUP BY 1) o ON o.question_id = q.question_id
      LEFT JOIN (SELECT question_id, string_agg(t.name, ',' ORDER BY t.tag_id) AS t FROM {v_question_tag} x JOIN {v_tag} t ON t.tag_id = x.tag_id GROUP BY 1) t ON t.question_id = q.question_id""")  # fmt: skip
R.add("export_questions_csv", lambda s: corpus.export_questions_csv(_exported(s)).select("id", "type", "difficulty", "options"),
      """SELECT q.question_id AS id, ['单选题', '多选题', '判断题', '填空题', '名词解释', '简答题', '论述题', '代码题', '对比题'][q.q_type] AS type, ['易', '中', '难'][q.difficulty] AS difficulty, coalesce(o.k, '') AS options FROM {v_question} q
      LEFT JOIN (SELECT question_id, string_agg(concat(option_key, '.', content, CASE WHEN is_correct = 1 THEN '(√)' ELSE '' END), ' | ' ORDER BY sort_order) AS k FROM {v_option} GROUP BY 1) o ON o.question_id = q.question_id""")  # fmt: skip
CARD = lambda c: f"replace(regexp_replace(coalesce({c}, ''), '\\r\\n|[\\r\\n]', '<br>', 'g'), chr(9), '    ')"
ODD = "SELECT * EXCLUDE (stem, analysis), CASE WHEN question_id % 3 = 0 THEN concat(stem, chr(13), chr(10), 'second', chr(9), 'part') ELSE stem END AS stem, CASE WHEN question_id % 5 = 0 THEN NULL ELSE analysis END AS analysis FROM {v_question}"
R.add("export_anki", lambda s: corpus.export_anki(corpus.export_questions_json(s.sql(ODD.replace("EXCLUDE", "EXCEPT")), s["v_option"], s["v_question_tag"], s["v_tag"].withColumn("name", F.concat("name", F.lit(", x"))))),
      f"""SELECT q.question_id AS id, concat_ws(chr(9), {CARD("concat_ws(chr(10), q.stem, o.k)")}, {CARD("concat_ws(chr(10), '答案：' || q.answer, '解析：' || q.analysis)")}, trim(concat_ws(' ', ['单选题', '多选题', '判断题', '填空题', '名词解释', '简答题', '论述题', '代码题', '对比题'][q.q_type], ['易', '中', '难'][q.difficulty], t.t))) AS value FROM ({ODD}) q
      LEFT JOIN (SELECT question_id, string_agg(concat(option_key, '. ', content), chr(10) ORDER BY sort_order) AS k FROM {{v_option}} GROUP BY 1) o ON o.question_id = q.question_id
      LEFT JOIN (SELECT question_id, string_agg(regexp_replace(concat(t.name, ', x'), '[\\s,，]', '_', 'g'), ' ' ORDER BY t.tag_id) AS t FROM {{v_question_tag}} x JOIN {{v_tag}} t ON t.tag_id = x.tag_id GROUP BY 1) t ON t.question_id = q.question_id""")  # fmt: skip
R.add("reconcile_index", lambda s: reconcile_index(_chunks(s), s.sql(INDEX)), STATUS)
R.add("reconcile_report", lambda s: reconcile_report(reconcile_index(_chunks(s), s.sql(INDEX))),
      f"SELECT count(*) AS total, count(*) FILTER (WHERE status = 'orphan') AS orphan, count(*) FILTER (WHERE status = 'missing') AS missing, count(*) FILTER (WHERE status = 'misplaced') AS misplaced, count(*) FILTER (WHERE status <> 'ok') = 0 AS healthy FROM ({STATUS}) x")
R.add("reconcile_differences", lambda s: reconcile_differences(_chunks(s), s.sql(INDEX)), f"SELECT * FROM ({STATUS}) x WHERE status <> 'ok'")
R.add("purge_orphans", lambda s: purge_orphans(s.sql(INDEX), _chunks(s)), f"SELECT * FROM ({INDEX}) i WHERE pk IN (SELECT chunk_id FROM {{v_chunk}})")
PLAIN = ("tag", "chunk", "chunk_tag", "exam", "mistake", "paper", "document")
LEFT = " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS rows FROM {{v_{'doc' if n == 'document' else n}}} WHERE kb_id >= 2" for n in PLAIN)
R.add("cascade_delete", lambda s: _cascade(s, "kb", "kb_id", s["v_kb"].filter("kb_id < 2").select("kb_id")),
      f"""WITH q AS (SELECT * FROM {{v_question}} WHERE kb_id >= 2) {LEFT} UNION ALL SELECT 'question', count(*) FROM q UNION ALL SELECT 'option', count(*) FROM {{v_option}} WHERE question_id IN (SELECT question_id FROM q) UNION ALL SELECT 'question_tag', count(*) FROM {{v_question_tag}} WHERE question_id IN (SELECT question_id FROM q)
      UNION ALL SELECT 'answer', count(*) FROM {{v_answer}} WHERE question_id IN (SELECT question_id FROM q) AND exam_id IN (SELECT exam_id FROM {{v_exam}} WHERE kb_id >= 2)
      UNION ALL SELECT 'paper_item', count(*) FROM {{v_paper_item}} WHERE question_id IN (SELECT question_id FROM q) AND paper_id IN (SELECT paper_id FROM {{v_paper}} WHERE kb_id >= 2)
      UNION ALL SELECT 'review_log', count(*) FROM {{v_review_log}} l WHERE NOT EXISTS (SELECT 1 FROM {{v_mistake}} m WHERE m.user_id = l.user_id AND m.question_id = l.question_id AND m.kb_id < 2)""")  # fmt: skip
R.add("cascade_delete_paper", lambda s: _cascade(s, "paper_with_questions", "paper_id", s["v_paper"].filter("paper_id % 50 = 0").select("paper_id")).filter("table_name in ('paper', 'paper_item', 'question', 'option', 'question_tag')"),
      """WITH g AS (SELECT DISTINCT question_id FROM {v_paper_item} WHERE paper_id % 50 = 0) SELECT 'paper' AS table_name, count(*) AS rows FROM {v_paper} WHERE paper_id % 50 <> 0 UNION ALL SELECT 'paper_item', count(*) FROM {v_paper_item} WHERE paper_id % 50 <> 0 AND question_id NOT IN (SELECT question_id FROM g WHERE question_id IN (SELECT question_id FROM {v_question}))
      UNION ALL SELECT 'question', count(*) FROM {v_question} WHERE question_id NOT IN (SELECT question_id FROM g) UNION ALL SELECT 'option', count(*) FROM {v_option} WHERE question_id NOT IN (SELECT question_id FROM g) UNION ALL SELECT 'question_tag', count(*) FROM {v_question_tag} WHERE question_id NOT IN (SELECT question_id FROM g)""")  # fmt: skip
R.add("cascade_delete_tag", lambda s: _cascade(s, "tag", "tag_id", s["v_tag"].filter("level = 1 and tag_id % 2 = 0").select("tag_id")).filter("table_name in ('tag', 'chunk_tag', 'question_tag')"),
      """WITH RECURSIVE g AS (SELECT tag_id FROM {v_tag} WHERE level = 1 AND tag_id % 2 = 0 UNION ALL SELECT t.tag_id FROM {v_tag} t JOIN g ON t.parent_id = g.tag_id) SELECT 'tag' AS table_name, count(*) AS rows FROM {v_tag} WHERE tag_id NOT IN (SELECT tag_id FROM g)
      UNION ALL SELECT 'chunk_tag', count(*) FROM {v_chunk_tag} WHERE tag_id NOT IN (SELECT tag_id FROM g) UNION ALL SELECT 'question_tag', count(*) FROM {v_question_tag} WHERE tag_id NOT IN (SELECT tag_id FROM g)""")  # fmt: skip
PRICES_OLD, PRICES_NEW = "SELECT question_id AS id, stem AS name, difficulty AS level FROM {v_question} WHERE question_id % 2 = 0", "SELECT question_id AS id, concat('new ', stem) AS name, CASE WHEN question_id % 5 = 0 THEN NULL ELSE 9 END AS level FROM {v_question} WHERE question_id % 3 = 0"
R.add("merge_ignore", lambda s: merge_ignore(s.sql(PRICES_OLD), s.sql(PRICES_NEW), ["id"]), f"SELECT * FROM ({PRICES_OLD}) o UNION ALL SELECT * FROM ({PRICES_NEW}) n WHERE id % 2 <> 0")
R.add("merge_upsert", lambda s: merge_replace(s.sql(PRICES_OLD), s.sql(PRICES_NEW), ["id"], "id"), f"SELECT * FROM ({PRICES_NEW}) n UNION ALL SELECT * FROM ({PRICES_OLD}) o WHERE id % 3 <> 0")
R.add("merge_partial", lambda s: merge_partial(s.sql(PRICES_OLD), s.sql(PRICES_NEW), ["id"]), f"SELECT o.id, coalesce(n.name, o.name) AS name, coalesce(n.level, o.level) AS level FROM ({PRICES_OLD}) o LEFT JOIN ({PRICES_NEW}) n ON n.id = o.id")
R.add("snapshot_restore", snapshot_and_restore,
      " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS left_rows, CAST(sum({k}) AS BIGINT) AS ids, {r} AS restored, {v} AS version FROM {{v_{n}}}" for n, k, r, v in (("question", "question_id", "true", "'1'"), ("tag", "tag_id", "true", "'1'"), ("option", "question_id", "true", "'1'"), ("chunk_tag", "tag_id", "false", "NULL"))))
