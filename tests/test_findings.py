"""Queries against their SQL twins on tables that the small test tables don't hold, and plans that must not grow with a group."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_queries import SF, rows

from lernwerk.operators import bank, grading, maintenance, registry, review, vector_index
from lernwerk.sources.views import TABLES, VIEWS, Source
from lernwerk.streaming import exam_totals, review_stream


@pytest.fixture
def agree(spark, tmp_path):
    """Holds a query against its twin, with some tables replaced."""

    def compare(name: str, **tables) -> int:
        for t in TABLES:
            frame = tables.get(t)
            (tmp_path / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet") if frame is None else frame.coalesce(1).write.parquet(str(tmp_path / f"{t}.parquet"))
        c = duckdb.connect()
        for t in TABLES:
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet{'/*.parquet' if t in tables else ''}'")
        found, expected = registry.QUERIES[name](spark, str(tmp_path)).toPandas(), c.execute(registry.ORACLE_SQL[name]).df()
        assert sorted(found.columns) == sorted(expected.columns)
        assert rows(found) == rows(expected)
        return len(found)

    return compare


def test_citations_of_answers_that_share_an_id(spark, agree):
    """Ids are orders times a million plus questions, so from a million questions on two answers can have the same."""
    lines, parts = spark.read.parquet(f"{SF}/lineitem.parquet"), spark.read.parquet(f"{SF}/part.parquet")
    far = lines.filter("l_orderkey > 0").withColumns({"l_orderkey": F.col("l_orderkey") - 1, "l_partkey": F.col("l_partkey") + 1_000_000})
    assert agree("verify_citations", lineitem=lines.unionByName(far), part=parts.unionByName(parts.withColumn("p_partkey", F.col("p_partkey") + 1_000_000))) > 0


def test_a_repeated_citation_counts_once(spark):
    cited = spark.createDataFrame([(1, 7, 0, 3, "a"), (1, 7, 0, 3, "a"), (1, 7, 1, 4, "b"), (1, 8, 0, 3, "c")], "answer_id long, question_id long, place int, chunk_id long, quote string")
    sources = spark.createDataFrame([(7, 3), (7, 4), (8, 3)], "question_id long, chunk_id long")
    chunks = spark.createDataFrame([(3, 1, 0, "x"), (4, 1, 1, "y")], "chunk_id long, doc_id long, chunk_index int, content string")
    found = grading.verify_citations(cited, sources, chunks).select("rank", "question_id", "chunk_id").collect()
    assert sorted(map(tuple, found)) == [(1, 7, 3), (2, 8, 3), (3, 7, 4)]


def test_vectors_are_rounded_in_their_own_width(spark, agree):
    """Thousandths of a four-byte number, times a four-byte thousand, fall on a half where eight bytes stay below it."""
    text = "dfhbb f fbecd hc gefh" * 8
    docs = spark.createDataFrame([(1, text, "en", "s", len(text)), (2, "plain", "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    assert agree("embed_texts", documents=docs) == 2


def optimized(frame) -> str:
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_cascade_takes_rows_with_other_ids_missing(spark):
    """A removed row goes whatever its other ids are, since only the keys above it are looked at."""
    tables = {"exam": spark.createDataFrame([(1, 0, None), (2, 0, 5), (3, 1, None)], "exam_id long, kb_id long, user_id long"), "answer": spark.createDataFrame([(7, 1, None), (8, 3, 4)], "answer_id long, exam_id long, question_id long")}
    left = maintenance.cascade_delete(tables, "kb", "kb_id", spark.createDataFrame([(0,)], "kb_id long"))
    assert [r["exam_id"] for r in left["exam"].collect()] == [3] and [r["answer_id"] for r in left["answer"].collect()] == [8]


def test_chunk_tags_are_dealt_by_more_than_their_base(spark):
    s = Source(spark, SF)
    found, plain = s["v_chunk_tag"], s.sql(VIEWS["v_chunk_tag"])
    assert found.dtypes == plain.dtypes and sorted(found.collect()) == sorted(plain.collect())
    assert "_piece" in optimized(found)


def test_cascade_looks_at_tags_before_chunks_meet_them(spark):
    """Links of chunks and tags are many times their tables: what goes is taken out of the tags, not out of the links."""
    s = Source(spark, SF)
    gone = s["v_tag"].filter("level = 1 and tag_id % 2 = 0").select("tag_id")
    left = maintenance.cascade_delete({"tag": s["v_tag"], "chunk_tag": s["v_chunk_tag"]}, "tag", "tag_id", gone)["chunk_tag"]
    joins = [x for x in optimized(left).splitlines() if "Join " in x]
    assert "Join Inner" in joins[0] and any("LeftAnti" in x for x in joins)


def test_tags_are_cut_before_questions_meet_them(spark):
    """Chunks have many tags: a question meets the first of each list only, with the result of all of them."""
    r = random.Random(4)
    sources = {q: [r.randrange(5) for _ in range(r.randrange(4))] for q in range(30)}
    own = {(q, r.randrange(40)) for q in range(30) for _ in range(r.randrange(20))}
    tagged = {(c, r.randrange(40)) for c in range(5) for _ in range(25)}
    closure = [(t, t // 3, 1) for t in range(3, 40)] + [(t, t // 9, 2) for t in range(9, 40)]
    rows = lambda x, schema: spark.createDataFrame(sorted(x), schema)
    found = bank.inherit_tags(rows(sources.items(), "question_id long, source_chunk_ids array<long>"), rows(own, "question_id long, tag_id long"), rows(tagged, "chunk_id long, tag_id long"), rows(closure, "tag_id long, ancestor_id long, distance int"))
    want = []
    for q, chunks in sources.items():
        direct = [(-1, t) for k, t in own if k == q] + [(at, t) for at, c in enumerate(chunks) for k, t in tagged if k == c]
        places = [(src, t, 0, t) for src, t in direct] + [(src, t, d, a) for src, t in direct for x, a, d in closure if x == t]
        once = {}
        for *at, tag in sorted(places):
            once.setdefault(tag, at)
        want += [(q, n, t) for n, t in enumerate(sorted(once, key=lambda t: (once[t], t))[:12], 1)]
    assert sorted(map(tuple, found.collect())) == want
    assert optimized(found).count("Window [") >= 5


def test_totals_of_many_exams_in_one_call():
    """A block of exams is settled at once, as answer by answer in the order they come."""

    class State:
        exists, get = False, None

        def update(self, value):
            self.exists, self.get = True, value

    r, state, known = np.random.default_rng(3), State(), {}
    for _ in range(6):
        part = pd.DataFrame({"exam_id": r.integers(0, 20, 80), "answer_id": r.integers(0, 6, 80), "version": r.integers(0, 4, 80), "score": r.integers(0, 51, 80) / 10, "full_score": 5.0})
        changed: dict[int, int] = {}
        for exam, answer, version, score, full in part.itertuples(index=False):
            old = known.setdefault(exam, {}).get(answer)
            if old is None or old[0] < version:
                known[exam][answer] = (version, round(score * 1000), round(full * 1000))
                changed[exam] = changed.get(exam, 0) + 1
        want = [[e, sum(x[1] for x in known[e].values()), sum(x[2] for x in known[e].values()), sum(x[1] >= 0.999 * x[2] for x in known[e].values()), len(known[e]), n] for e, n in sorted(changed.items())]
        assert [row for x in exam_totals.advance((0,), iter([part[:30], part[30:]]), state) for row in x.values.tolist()] == want


def test_totals_stream_shares_a_state_among_exams(spark, tmp_path):
    schema = "exam_id long, answer_id long, version long, score double, full_score double"
    spark.createDataFrame([(1, 1, 0, 1.0, 5.0)], schema).write.parquet(str(tmp_path / "in"))
    plan = exam_totals.totals_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))._jdf.queryExecution().analyzed().toString()
    assert f"{exam_totals.BLOCK}" in plan and "FLOOR" in plan.upper()


def test_requests_leave_in_bounded_frames():
    """Queries that reach all cells make many rows, none of which wait for the others."""
    x, cells = np.random.default_rng(5).normal(size=(3000, 4)), 40
    batch = pd.DataFrame({"query_id": range(3000), "kb_id": 0, "vector": list(x)})
    asked = []

    def choose(x, rows):
        asked.append(len(x))
        return np.ones((len(x), cells), dtype=bool)

    frames = list(vector_index.ask(iter([batch, batch[:0]]), choose))
    assert max(map(len, frames)) <= vector_index.BATCH and max(asked) <= vector_index.SLICE
    every = pd.concat(frames)
    assert len(every) == 3000 * cells and not every.duplicated(["query_id", "cell"]).any()
    assert np.allclose(np.stack(every["vector"][:100]), np.stack([vector_index.units(x)[q] for q in every["query_id"][:100]]))


def test_equal_vectors_tie_to_the_smaller_pk(spark):
    """Products of equal vectors may differ in the last bits, by their place in a block."""
    v = np.random.default_rng(7).normal(size=64)
    vectors = spark.createDataFrame([(k, 0, v.tolist()) for k in range(700)], "pk long, kb_id long, vector array<double>")
    for n in (1, 3, 600):
        queries = spark.createDataFrame([(q, 0, (v + 1e-3 * q).tolist()) for q in range(n)], "query_id long, kb_id long, vector array<double>")
        found = vector_index.search(queries, vector_index.build(vectors), 5).collect()
        assert {r["pk"] for r in found} == set(range(5)) and len(found) == 5 * n


def test_scores_that_differ_in_the_last_bits_are_equal():
    cos = np.nextafter(np.full((1, 9), 0.5), np.where(np.arange(9) % 2, 1.0, 0.0))
    _, pk, _ = vector_index.top_of(np.round(cos, vector_index.DECIMALS), np.arange(9), 3)
    assert pk.tolist() == [0, 1, 2]


def test_review_log_holds_no_group_whole(spark):
    """Long histories, of learners who mostly fail and mostly pass, as the stream's transition has them."""
    r, day = random.Random(6), datetime(2020, 1, 1)
    attempts = [(u, q, k, day + timedelta(days=k // 2), r.choice([0.2, 0.9, 1.0, 0.8, 0.7, None] if u == 0 else [0.1, 0.1, 0.95, 0.5]) if (k + 1) % 9 else 0.0) for u in range(2) for q in range(3) for k in range(400)]
    want = []
    for u in range(2):
        for q in range(3):
            state = review_stream.FRESH
            for _, _, exam, ts, rate in [x for x in attempts if x[:2] == (u, q)]:
                before, state = state, review_stream.advance(state, ts, 0.9 if rate is None else rate)
                if before[0] and not (rate is not None and rate < 0.8):
                    want.append((u, q, exam, ts, 5 if rate is not None and rate >= 0.95 else 4, rate, before[5], state[5]))
    frame = spark.createDataFrame(attempts, "user_id long, question_id long, exam_id long, ts timestamp, rate double").repartition(5)
    log = review.review_log(frame)
    assert sorted(map(tuple, log.collect()), key=lambda x: x[:3]) == want
    assert "collect_list" not in optimized(log) and dict(log.dtypes)["interval_after"] == "int"


def test_exam_results_meet_texts_last(spark):
    s = Source(spark, SF)
    items = s["v_paper_item"].withColumnRenamed("paper_id", "exam_id")
    questions = s["v_question"].selectExpr("*", "cast(array() as array<struct<option_key: string, content: string>>) as options", "'' as tags")
    plan = optimized(grading.exam_result(s["v_answer"], s["v_exam"], questions, items))
    joins = [x for x in plan.splitlines() if "Join " in x]
    assert "question_id" in joins[0] and "exam_id" not in joins[0]


def test_links_are_written_small(spark, tmp_path, monkeypatch):
    """The table that no snapshot has is the largest; its pages hold more rows than the writer's 20,000."""
    import pyarrow.parquet as pq

    monkeypatch.setattr(maintenance, "new_path", lambda _, what: str(tmp_path / what))
    maintenance.snapshot_and_restore(Source(spark, SF)).collect()
    parts = [pq.ParquetFile(f).metadata for f in (tmp_path / "restored" / "chunk_tag").glob("*.parquet")]
    assert {m.row_group(k).column(0).compression for m in parts for k in range(m.num_row_groups)} == {"ZSTD"}
