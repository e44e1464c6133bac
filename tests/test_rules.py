"""Rules that SQL doesn't express, against cases and plain versions."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import numpy as np
import plain_terms
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lernwerk.functions import text as X
from lernwerk.operators import bank, calls, dedup_vector, documents, grading, interviews, review, stats, tags, transcripts
from lernwerk.sources import corpus
from lernwerk.streaming import review_stream

SPEECH = [
    ("嗯，那个，我先自我介绍一下，我叫张三。", "我先自我介绍一下，我叫张三。"),
    ("啊，这个这个问题，我我我觉得是这样的。", "这个问题，我觉得是这样的。"),
    ("额……就是说，缓存穿透是是指查询一个不存在的数据。", "缓存穿透是是指查询一个不存在的数据。"),
    ("然后呢，嗯，我们当时用的是 Redis，对，Redis。", "然后呢，我们当时用的是 Redis，对，Redis。"),
    ("哈哈哈，这个我确实不太清楚。", "哈，这个我确实不太清楚。"),
    ("我们项目里用到了 Spring Boot，还有，那个，MyBatis。", "我们项目里用到了 Spring Boot，还有，MyBatis。"),
    ("真的啊，那挺好的。", "真的啊，那挺好的。"),
    ("就是就是，我觉得应该应该先做限流。", "就是，我觉得应该先做限流。"),
    ("啊啊啊，不好意思。", "不好意思。"),
    ("好的，谢谢面试官。", "好的，谢谢面试官。"),
    ("嗯，我用 Redis 做缓存，QPS 大概 3000 左右。", "我用 Redis 做缓存，QPS 大概 3000 左右。"),
    ("那个，MyBatis-Plus 的 Wrapper 我一般用 lambda 写法。", "MyBatis-Plus 的 Wrapper 我一般用 lambda 写法。"),
    ("呃，这个接口的响应时间是 200ms，额，还可以再优化。", "这个接口的响应时间是 200ms，还可以再优化。"),
    ("", ""),
]
QUESTIONS = [("请你介绍一下这个项目的难点", True), ("缓存击穿怎么解决？", True), ("嗯我平时喜欢看技术书", False), ("你有什么想问我的吗", False), ("你先说说这块怎么做的", True), ("我用的是 Spring Boot", False)]
WORDS = ["缓存穿透", "缓存击穿", "缓存雪崩", "布隆过滤器", "分布式锁", "Redis", "自动装配", "事务隔离级别", "聚簇索引", "回表", "主从复制"]
TERMS = [
    ("缓存穿透可以用布隆过滤器解决缓存击穿用互斥锁重建，缓存雪崩就给过期时间加随机值。", None),
    ("缓存激穿用互斥锁重建", "缓存击穿用互斥锁重建"),
    ("布隆过滤起解决穿透", "布隆过滤器解决穿透"),
    ("缓存穿斗加分布式琐", "缓存穿透加分布式锁"),
    ("缓存穿透、缓存击穿、缓存雪崩、布隆过滤器", None),
    ("今天天气不错适合学习", None),
    ("我用 Rediss 做缓存", "我用 Redis 做缓存"),
]


def test_clean_speech(spark):
    rows = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(SPEECH)], "id int, text string")
    found = {r["id"]: r["clean_text"] for r in transcripts.clean_speech(rows).collect()}
    assert [found[i] for i in range(len(SPEECH))] == [b for _, b in SPEECH]


def test_is_question(spark):
    rows = spark.createDataFrame([(a,) for a, _ in QUESTIONS], "text string").select("text", transcripts.is_question(F.col("text")).alias("q"))
    assert {r["text"]: r["q"] for r in rows.collect()} == dict(QUESTIONS)


def plain_distance(a: str, b: str) -> int:
    return max(len(a), len(b)) if not a or not b else min(plain_distance(a[1:], b) + 1, plain_distance(a, b[1:]) + 1, plain_distance(a[1:], b[1:]) + (a[0] != b[0]))


@given(st.text("缓存穿透", max_size=5), st.text("缓存穿透", max_size=5))
def test_edit_distance(a, b):
    assert plain_terms.edit_distance(a, b) == plain_distance(a, b)


def test_a_dropped_and_an_added_character_are_two_edits():
    assert plain_terms.correct_text("讲讲分布系统一致性呢。", ["分布式系统一致性"]) == ("讲讲分布式系统一致性。", [("分布系统一致性呢", "分布式系统一致性", 0.75)])


@given(st.text("缓存穿透击雪崩x，", max_size=14))
def test_han_terms_against_a_plain_scan(text):
    words, at, out = ["缓存穿透", "缓存击穿", "存雪崩", "透x"], 0, ""
    while at < len(text):
        here = [w for w in words if w[0] == text[at]]
        exact = max((w for w in here if text[at:].startswith(w)), key=len, default=None)
        alike = [(1 - plain_distance(text[at : at + len(w)], w) / len(w), w) for w in here if at + len(w) <= len(text)]
        best = max(alike, default=(0, ""), key=lambda x: x[0])
        word = exact or (best[1] if best[0] >= 0.75 else text[at])
        out += word
        at += len(word)
    assert plain_terms.correct_text(text, words)[0] == out


@pytest.mark.parametrize(("text", "expected"), TERMS)
def test_correct_text(text, expected):
    assert plain_terms.correct_text(text, WORDS)[0] == (expected or text)


def test_sm2_wrong_then_right(spark):
    t = datetime(2024, 1, 1)
    rows = spark.createDataFrame([(1, 1, 1, t, 0.2), (1, 1, 2, t + timedelta(days=2), 1.0), (2, 1, 3, t, 1.0)], "user_id long, question_id long, exam_id long, ts timestamp, rate double")
    found = review.sm2_fold(rows).collect()
    assert [(r["repetitions"], r["ease_factor"], r["interval_days"], r["right_streak"]) for r in found] == [(1, 2.6, 1, 1)]


def test_stream_equals_batch(spark, tmp_path):
    random.seed(3)
    t = datetime(2024, 1, 1)
    data = [(u, q, i, t + timedelta(days=i), random.choice([0.1, 0.7, 0.85, 1.0])) for u in range(3) for q in range(4) for i in range(9)]
    schema = "user_id long, question_id long, exam_id long, ts timestamp, rate double"
    rows = spark.createDataFrame(data, schema)
    for part in range(3):
        rows.filter((F.col("exam_id") >= 3 * part) & (F.col("exam_id") < 3 * part + 3)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = review_stream.sm2_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("reviews").outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(180)
    last = {}
    for r in spark.table("reviews").collect():
        k = (r["user_id"], r["question_id"])
        if k not in last or r["updated_at"] >= last[k]["updated_at"]:
            last[k] = r
    columns = ("wrong_count", "right_streak", "ease_factor", "interval_days", "repetitions", "mastered")
    batch = {(r["user_id"], r["question_id"]): tuple(r[c] for c in columns) for r in review.sm2_fold(rows).collect()}
    assert {k: tuple(r[c] for c in columns) for k, r in last.items()} == batch


def test_section_path(spark):
    lines = ["# A", "one", "## B", "two", "### C", "three", "## D", "four", "# E", "five", "第一章 开始", "six", "1.2 细节", "seven"]
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "doc_id int, pos int, text string")
    found = {r["text"]: r["section_path"] for r in documents.section_path(rows).collect()}
    assert found == {"one": "A", "two": "A > B", "three": "A > B > C", "four": "A > D", "five": "E", "six": "第一章 开始", "seven": "第一章 开始 > 1.2 细节"}


def plain_ranges(units: list[tuple[int, str]], target: int, overlap: int) -> list[tuple[int, int]]:
    """A chunk is full at the target, or at half of it when the path changes; the longest tail that fits the overlap goes on."""
    out, first = [], 0
    tail = lambda first, last: next(s for s in range(first, last + 2) if sum(t for t, _ in units[s : last + 1]) <= overlap)
    for i, (_, path) in enumerate(units):
        before = units[i - 1][1]
        if i > first and path and before and path != before and sum(t for t, _ in units[first:i]) >= target / 2:
            out.append((first, i - 1))
            first = tail(first, i - 1)
        if sum(t for t, _ in units[first : i + 1]) >= target:
            out.append((first, i))
            first = tail(first, i)
    return out + [(first, len(units) - 1)] * (first < len(units) and out[-1:] != [(first, len(units) - 1)])


def test_chunks_against_a_plain_fold(spark):
    random.seed(9)
    docs = {d: [(random.choice([1, 20, 60, 150, 399]), random.choice(["", "a", "b"])) for _ in range(random.randrange(1, 40))] for d in range(150)}
    rows = [(d, i + 1, p, f"t{i}", t) for d, units in docs.items() for i, (t, p) in enumerate(units)]
    found = documents.pack_chunks(spark.createDataFrame(rows, "doc_id long, unit int, section_path string, text string, tokens int"), 300, 100).collect()
    got = {(r["doc_id"], r["chunk_index"]): (r["text"], r["n_units"], r["tokens"], r["section_path"]) for r in found}
    expected = {}
    for d, units in docs.items():
        for i, (a, b) in enumerate(plain_ranges(units, 300, 100)):
            expected[d, i] = ("\n".join(f"t{k}" for k in range(a, b + 1)), b - a + 1, sum(t for t, _ in units[a : b + 1]), units[a][1] or units[b][1])
    assert got == expected


def test_dedup_vector_is_the_sequential_result(spark):
    random = np.random.default_rng(0)
    centres = random.standard_normal((6, 8))
    vectors = [centres[i % 6] + 0.25 * random.standard_normal(8) for i in range(60)]
    unit = [v / np.linalg.norm(v) for v in vectors]
    kept: list[int] = []
    for i, v in enumerate(unit):
        if i >= 10 and all(v @ unit[j] < 0.92 for j in [*range(10), *kept]):
            kept.append(i)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "pos long, vector array<double>")
    found = dedup_vector.dedup_vector(rows.filter("pos >= 10"), rows.filter("pos < 10").withColumnRenamed("pos", "id"))
    assert sorted(r["pos"] for r in found.collect()) == kept


def test_grade_rubric_points(spark):
    rows = spark.createDataFrame([(1, [("Redis cache", 5.0), ("Kafka queue", 5.0)], "Redis and cache", 10.0)], "id int, rubric array<struct<point: string, score: double>>, user_answer string, full_score double")
    r = grading.grade_rubric(rows).first()
    assert r["score"] == 5.0 and [x["point"] for x in r["miss_points"]] == ["Kafka queue"]


def test_terms_and_tokens(spark):
    r = spark.range(1).select(X.terms(F.lit("Redis 缓存 Redis 一个 x C++"), 8).alias("t"), X.estimate_tokens(F.lit("缓存abcd")).alias("n"), X.estimate_tokens(F.lit("")).alias("z")).first()
    assert r["t"] == ["Redis", "缓存", "C++"] and r["n"] == 3 and r["z"] == 0


def test_items_from_sentences(spark):
    pool = spark.createDataFrame([(1, i, f"Sentence number{i} about Redis{i} and Kafka{i} streams") for i in range(6)], "doc_id long, pos int, sentence string")
    single = bank.make_single_items(pool).collect()
    assert all(len(r["options"]) == 4 and len(r["answer"]) == 1 for r in single)
    assert all(o["content"].startswith("Sentence") for r in single for o in r["options"])
    assert all("______" in r["stem"] and r["answer"] == "Sentence" for r in bank.make_blank_items(pool).collect())
    assert all(abs(sum(p["score"] for p in r["rubric"]) - 10) < 0.01 for r in bank.make_short_items(pool).collect())


def test_weak_points_prefer_equal_names(spark):
    points = spark.createDataFrame([(1, 1, 0, "缓存"), (1, 1, 1, "Redis缓存雪崩"), (1, 1, 2, "网络")], "interview_id int, kb_id int, pos int, point string")
    tags = spark.createDataFrame([(1, 1, "缓存基础", 3), (2, 1, "缓存雪崩", 2), (3, 1, "线程", 0)], "tag_id int, kb_id int, name string, chunk_count int")
    found = {r["pos"]: (r["tag_id"], r["tier"]) for r in interviews.match_weak_points(points, tags).collect()}
    assert found == {0: (1, 1), 1: (2, 3)}


def test_llm_map_retries_and_logs(spark):
    def failing(prompts):
        raise RuntimeError("no answer")

    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, prompt string")
    assert {(r["success"], r["retries"]) for r in calls.llm_map(rows, failing, "id", wait=0.0).collect()} == {(0, 3)}


@pytest.mark.parametrize(("answer", "holds"), [('{"a": 1}', True), ('```json\n{"a": [1,],}\n```', True), ('Sure: {"a": {"b": 2}} ok', True), ("[1, 2]", False), ("no", False), ("{a}", False), (None, False), ("", False)])
def test_holds_json_as_it_is_parsed(spark, answer, holds):
    assert calls.holds_json(answer) == holds
    parsed = spark.createDataFrame([(answer,)], "t string").select(calls.parse_llm_json(F.col("t")).isNotNull().alias("p")).first()["p"]
    assert parsed == holds


def test_text_corpus_and_snapshots(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("缓存穿透".encode())
    (tmp_path / "b.txt").write_bytes("缓存雪崩".encode("gb18030"))
    found = {r["text"] for r in corpus.load_text_corpus(spark, str(tmp_path)).collect()}
    assert found == {"缓存穿透", "缓存雪崩"}
    manifest = corpus.snapshot_tables({"t": spark.range(3), "u": spark.range(2)}, str(tmp_path / "snap"))
    assert {(r["table"], r["rows"], r["tables"], r["created"] is None) for r in manifest.collect()} == {("t", 3, 2, False), ("u", 2, 2, False)}
    spark.range(9).write.parquet(str(tmp_path / "now" / "t"))
    spark.range(9).write.parquet(str(tmp_path / "now" / "missing"))
    done = corpus.restore_tables(spark, str(tmp_path / "snap"), str(tmp_path / "now"), ["t", "missing"])
    assert {tuple(r) for r in done.collect()} == {("t", 3, True), ("missing", None, False)}
    assert [spark.read.parquet(str(tmp_path / "now" / n)).count() for n in ("t", "missing")] == [3, 9]
    spark.range(5).write.mode("append").parquet(str(tmp_path / "snap" / "u"))  # not what the manifest says
    assert not corpus.restore_tables(spark, str(tmp_path / "snap"), str(tmp_path / "now"), ["u"]).first()["restored"]
    corpus.write_csv(spark.createDataFrame([(1, 'say "hi", you')], "id int, t string"), str(tmp_path / "csv"), bom=True)
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).first()[1] == 'say "hi", you'


def test_numbered_paragraphs_that_are_no_headings_stay(spark):
    text = "\n\n".join(["# Book", "3 replicas keep the data safe", "1.2 Scope", "Second text", "第三篇 不是标题", "第四章 方法", "2.1.3 Deep", "inner", "三、小结", "end", "1.2.3.4 four numbers"])
    rows = {r["text"]: r["section_path"] for r in documents.section_path(documents.split_paragraphs(spark.createDataFrame([(1, text)], "doc_id long, text string"))).collect()}
    assert rows == {"3 replicas keep the data safe": "Book", "Second text": "Book > 1.2 Scope", "第三篇 不是标题": "Book > 1.2 Scope", "inner": "第四章 方法 > 2.1.3 Deep", "end": "三、小结", "1.2.3.4 four numbers": "三、小结"}


def test_blank_answers_miss_every_point(spark):
    kind = "answer_id long, q_type int, full_score double, reference string, user_answer string, rubric array<struct<point: string, score: double>>"
    rows = [(1, 5, 10.0, "r", " ", [("缓存", 5.0), ("锁", 5.0)]), (2, 1, 5.0, "A", None, None), (3, 1, 5.0, "A", "", [("A", 5.0)]), (4, 5, 10.0, "r", "缓存穿透", [("缓存穿透", 10.0)])]
    found = {r["answer_id"]: r for r in grading.grade_answers(spark.createDataFrame(rows, kind)).collect()}
    missed = {k: [(p["point"], p["hint"]) for p in r["miss_points"] or []] for k, r in found.items()}
    assert missed == {1: [("缓存", "未作答"), ("锁", "未作答")], 2: [], 3: [("A", "未作答")], 4: []}
    assert [(found[k]["score"], found[k]["method"]) for k in (1, 2, 3)] == [(0.0, 1)] * 3


def test_projects_that_are_texts(spark):
    rows = [(1, '{"projects": ["Search engine", {"title": "T", "period": "2020", "stack": "S"}, null]}'), (2, '{"projects": null}'), (3, "no json")]
    found = {r["id"]: [(p["title"], p["period"], p["stack"]) for p in r["profile"]["projects"]] for r in interviews.normalize_profiles(spark.createDataFrame(rows, "id int, profile string")).collect()}
    assert found == {1: [("Search engine", "", ""), ("T", "2020", "S")], 2: [], 3: []}


def test_profile_fields_of_the_fixed_lists(spark):
    rows = [(1, "王小明\n3 年以上工作经验 专科 软件工程 北京邮电大学"), (2, "5年开发经验 研究生"), (3, "2 年经验，硕士"), (4, None)]
    lexicon = spark.createDataFrame([("Java", 1)], "word string, rank int")
    found = {r["resume_id"]: (r["years"], r["degree"], r["major"]) for r in interviews.extract_profiles(spark.createDataFrame(rows, "resume_id long, raw_text string"), lexicon).collect()}
    assert found == {1: (3, "专科", "软件工程"), 2: (0, None, ""), 3: (2, "硕士", ""), 4: (0, None, "")}


def test_endings_of_names_are_left_out(spark):
    points = spark.createDataFrame([(1, 1, 0, "缓存模块"), (1, 1, 1, "锁·专题"), (1, 1, 2, "队列原理")], "interview_id int, kb_id int, pos int, point string")
    tags = spark.createDataFrame([(7, 1, "缓存系列", 1), (8, 1, "锁", 1), (9, 1, "队列", 1)], "tag_id int, kb_id int, name string, chunk_count int")
    assert {r["pos"]: (r["tag_id"], r["tier"]) for r in interviews.match_weak_points(points, tags).collect()} == {0: (7, 1), 1: (8, 1), 2: (9, 3)}


def test_words_of_order(spark):
    rows = [(1, "背景是这样", None), (2, "第一步做这个", None), (3, "因为 所以 first then", None)]
    found = {r["id"]: r["structure"] for r in interviews.evaluate_answers(spark.createDataFrame(rows, "id int, answer string, expected string")).collect()}
    assert found == {1: 85.0, 2: 85.0, 3: 28.0}


def test_mean_rate_is_over_all_answers(spark):
    answers = spark.createDataFrame([(1, 1, 5.0, 5.0), (2, 1, 0.0, 5.0), (2, 2, 1.0, 5.0)], "exam_id int, question_id int, score double, full_score double")
    exams = spark.createDataFrame([(1, stats.GRADED), (2, 0)], "exam_id int, status int")
    assert [tuple(r) for r in stats.question_stats(answers, exams).collect()] == [(1, 1, 1, 0.5)]


def test_late_answers_are_rows_of_their_own():
    import datetime as dt

    import pandas as pd

    from lernwerk.streaming.review_stream import FRESH, Reviews

    class Value:
        value = None

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

    one = Reviews()
    one.state = Value()
    day = lambda n: dt.datetime(2024, 1, n)
    batch = lambda *rows: list(one.handleInputRows((1, 2), iter([pd.DataFrame(rows, columns=["ts", "exam_id", "rate"])]), None))
    assert FRESH[0] is False and [r["late"].item() for r in batch((day(5), 1, 0.1))] == [False]
    out = pd.concat(batch((day(3), 2, 0.2), (day(7), 3, 0.9)))
    assert out[["wrong_count", "repetitions", "late"]].values.tolist() == [[1, 1, False], [1, 1, True]]
    assert out["updated_at"].dt.day.tolist() == [7, 3]


def test_lexical_tags_meet_few_chunks(spark):
    import random

    rng = random.Random(5)
    han = [chr(0x4E00 + k) for k in range(2000)]
    few = han[:60]
    names = ["".join(rng.sample(rng.choice([han, han, han, few]), rng.randint(1, 4))) for _ in range(300)] + ["cache", "a", "", "aa"]
    tags_ = [(k, k % 3, n) for k, n in enumerate(names * 2)]
    texts = ["".join(rng.choices(han, k=50)) + "".join(rng.choices(few, k=4)) + rng.choice(["", " cache", " ab ca"]) for _ in range(200)]
    chunks_ = [(k, k % 3, t) for k, t in enumerate(texts)] + [(900, 1, ""), (901, 1, None), (902, 7, "cache")]
    tag_rows = spark.createDataFrame(tags_, "tag_id long, kb_id long, name string")
    chunks = spark.createDataFrame(chunks_, "chunk_id long, kb_id long, content string")
    expected = set()
    for c, kb, text in chunks_:
        scored = []
        for t, b, name in tags_:
            if b == kb and name and text:
                n = text.count(name) or int(len(name) >= 2 and all(x in text for x in name))
                scored += [(n, t)] if n else []
        expected |= {(c, r + 1, t, n) for r, (n, t) in enumerate(sorted(scored, reverse=True)[:3])}
    assert set(map(tuple, tags.tag_lexical(chunks, tag_rows).collect())) == expected
    pairs = tags.candidates(chunks.filter("content is not null"), tag_rows.filter("name <> ''").select("kb_id", "name").distinct()).count()
    assert pairs < 0.05 * len(chunks_) * len(tags_) / 3


def test_second_answer_replaces_the_first(spark):
    first = spark.createDataFrame([(1, 10), (1, 11), (2, 20), (3, 30)], "pk long, tag_id long")
    second = spark.createDataFrame([(1, [12]), (2, []), (3, None)], "pk long, tag_ids array<long>")
    assert sorted(map(tuple, tags.refine_tags(first, second).collect())) == [(1, 12), (3, 30)]


def test_a_job_that_is_started_again_asks_only_what_is_missing(spark, tmp_path):
    log, folder = tmp_path / "log", str(tmp_path / "ledger")
    rows = spark.createDataFrame([(k, f"prompt {k % 30}" if k else None) for k in range(90)], "id long, prompt string")

    def client(stop_at: int):
        def ask(prompts: list[str]) -> list[str]:
            with log.open("a") as file:
                file.write("".join(f"{p}\n" for p in prompts))
            if stop_at and len(log.read_text().splitlines()) > stop_at:
                raise SystemExit("killed")
            return [p.upper() for p in prompts]

        return ask

    with pytest.raises(Exception):  # noqa: B017
        calls.llm_map_once(rows, client(10), "id", folder, portions=8, wait=0.0, batch=2).collect()
    written = {r["digest"] for r in calls.ledger(spark, folder).collect()}
    before = log.read_text().splitlines()
    log.write_text("")
    found = {r["id"]: r for r in calls.llm_map_once(rows, client(0), "id", folder, portions=8, wait=0.0, batch=2).collect()}
    after = log.read_text().splitlines()
    assert written and len(after) == len(set(after)) == 31 - len(written) and before
    assert {r["response"] for r in found.values()} == {f"PROMPT {k}" for k in range(30)} | {""} and all(r["calls"] == 1 for r in found.values())
    log.write_text("")
    assert calls.llm_map_once(rows, client(0), "id", folder).count() == 90 and not log.read_text()


def test_totals_take_back_what_is_graded_again():
    import pandas as pd

    from lernwerk.streaming.exam_totals import advance

    class State:
        exists, get = False, None

        def update(self, value):
            self.exists, self.get = True, value

    state = State()
    columns = ["answer_id", "version", "score", "full_score"]
    batch = lambda *rows: [r for x in advance((1,), iter([pd.DataFrame(rows, columns=columns)]), state) for r in x[["got", "total", "correct_count", "n", "changed"]].values.tolist()]
    assert batch((1, 0, 5.0, 5.0), (2, 0, 0.1, 5.0)) == [[5100, 10_000, 1, 2, 2]]
    assert batch((1, 0, 5.0, 5.0)) == []
    assert batch((2, 1, 5.0, 5.0), (1, 2, 0.3, 5.0), (1, 1, 4.0, 5.0)) == [[5300, 10_000, 1, 2, 2]]
