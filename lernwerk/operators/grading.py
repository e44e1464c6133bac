"""Exams and grading (F)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.rounding import half_up
from ..sources.views import Registry, twin
from .bank import enrich_questions
from .tags import tag_briefs
from .stats import exam_summary

R = Registry()
PARTIAL, KEYWORD_SHARE = 0.5, 0.6
# Hints of points that an answer misses.
UNANSWERED, PARTLY, ABSENT = "未作答", "只答出一部分，还差：", "未提及该要点，应包含："
POINTS, HINTS, CORRECTIONS = "array<struct<point: string, score: double>>", "array<struct<point: string, hint: string>>", "array<struct<point: string, correction: string>>"


def full_score(q_type: Column) -> Column:
    return F.when(q_type <= 4, 5.0).otherwise(10.0)


def start_exam(items: DataFrame, questions: DataFrame, published_only: bool = True) -> DataFrame:
    """Blank answer rows of each paper's questions in order, with their points and the exam's total (F1)."""
    questions = questions.filter("status = 1") if published_only else questions
    rows = items.join(questions.select("question_id", "q_type"), "question_id").withColumn("full_score", full_score(F.col("q_type")))
    paper = W.partitionBy("paper_id")
    return rows.select("paper_id", "question_id", F.row_number().over(paper.orderBy("sort_order", "question_id")).alias("seq"), "full_score", F.sum("full_score").over(paper).alias("total_score"), F.lit("").alias("user_answer"))


def apply_answers(answers: DataFrame, updates: DataFrame, exams: DataFrame) -> DataFrame:
    """Last update per (exam, question) wins; blanks keep what was there; only running exams change (F2).

    updates(exam_id, question_id, seq, user_answer, asr_text, input_mode).
    """
    last = updates.groupBy("exam_id", "question_id").agg(F.max_by(F.struct("user_answer", "asr_text", "input_mode"), "seq").alias("u"))
    rows = answers.join(last, ["exam_id", "question_id"], "left").join(exams.select("exam_id", F.col("status").alias("_status")), "exam_id", "left")
    running = F.col("_status") == 0
    spoken = F.when(F.trim("u.asr_text") != "", F.col("u.asr_text"))
    return rows.withColumns({"user_answer": F.when(running, F.coalesce("u.user_answer", "user_answer")).otherwise(F.col("user_answer")),
                             "asr_text": F.when(running, F.coalesce(spoken, "asr_text")).otherwise(F.col("asr_text")),
                             "input_mode": F.when(running, F.coalesce("u.input_mode", "input_mode")).otherwise(F.col("input_mode"))}).drop("u", "_status")


def load_answers(answers: DataFrame, questions: DataFrame, chunks: DataFrame, n_chunks: int = 6, cut: int = 2500) -> DataFrame:
    """Answers with their question and its first source chunks in order.

    questions(question_id, ..., source_chunk_ids array<long>).
    """
    sources = questions.select("question_id", F.posexplode(F.slice("source_chunk_ids", 1, n_chunks)).alias("at", "chunk_id"))
    sources = sources.join(chunks.select("chunk_id", F.substring("content", 1, cut).alias("content")), "chunk_id")
    sources = sources.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("at", "chunk_id", "content"))).alias("sources"))
    rows = answers.join(questions.drop("source_chunk_ids"), "question_id").join(sources, "question_id", "left")
    return rows.withColumn("full_score", F.when(F.coalesce("full_score", F.lit(0.0)) == 0, 5.0).otherwise(F.col("full_score")))


def exact_score(full: Column, expected: Column, actual: Column) -> Column:
    """full if the normalised choices are equal and not empty."""
    e, a = X.choice_letters(expected), X.choice_letters(actual)
    return F.when((e == a) & (e != ""), full).otherwise(0.0)


def multi_score(full: Column, expected: Column, actual: Column) -> Column:
    """full for the same set, nothing for a wrong pick, half for a part of it."""
    letters = lambda c: F.split(X.choice_letters(c), "")
    e, a = F.array_remove(letters(expected), ""), F.array_remove(letters(actual), "")
    same = (F.size(F.array_except(e, a)) == 0) & (F.size(F.array_except(a, e)) == 0)
    return F.when(F.size(e) == 0, exact_score(full, expected, actual)).when(same, full).when(F.size(F.array_except(a, e)) > 0, 0.0).otherwise(F.bround(full * PARTIAL, 1))


def blank_score(full: Column, expected: Column, actual: Column) -> Column:
    """full if equal, contained either way, or if enough keywords occur; null leaves it to another grader.

    An expected answer that normalises to nothing matches any answer.
    """
    e, a = X.bare(expected), X.bare(actual)
    keywords = X.all_matches(expected, X.KEYWORD)
    found = F.size(F.filter(keywords, lambda k: a.contains(X.bare(k))))
    return F.when((a != "") & (a.contains(e) | e.contains(a)), full).when((F.size(keywords) > 0) & (found / F.size(keywords) >= KEYWORD_SHARE), full)


def rubric_points(rubric: Column, answer: Column) -> Column:
    """F8, per point: keywords, those missing and the points given."""
    compact = F.regexp_replace(answer, r"\s+", "")

    def point(p: Column) -> Column:
        keywords = X.terms(p["point"], 6)
        missing = F.filter(keywords, lambda k: ~compact.contains(k))
        share = F.coalesce(F.try_divide(F.size(keywords) - F.size(missing), F.size(keywords)), F.lit(0.0))
        given = F.when(share >= 0.5, p["score"]).when(share > 0, F.bround(p["score"] / 2 * 2, 0) / 2).otherwise(0.0)
        return F.struct(p["point"].alias("point"), p["score"].alias("score"), share.alias("share"), given.alias("given"), keywords.alias("keywords"), missing.alias("missing"))

    return F.transform(rubric, point)


def grade_rubric(rows: DataFrame) -> DataFrame:
    """Score, points hit and points missed of answers with a rubric (F8): rows(..., rubric, user_answer, full_score)."""
    rows = rows.withColumn("_p", rubric_points(F.col("rubric"), F.coalesce("user_answer", F.lit(""))))
    total = F.aggregate("_p", F.lit(0.0), lambda t, p: t + p["given"])
    hit = F.transform(F.filter("_p", lambda p: p["share"] > 0), lambda p: F.struct(p["point"].alias("point"), p["given"].alias("score")))
    hint = lambda p: F.when(p["share"] > 0, F.concat(F.lit(PARTLY), F.substring(F.array_join(p["missing"], "、"), 1, 40))).otherwise(F.concat(F.lit(ABSENT), F.array_join(F.slice(p["keywords"], 1, 3), "、")))
    miss = F.transform(F.filter("_p", lambda p: p["share"] < 0.5), lambda p: F.struct(p["point"].alias("point"), hint(p).alias("hint")))
    return rows.withColumns({"score": F.bround(F.least(total, F.col("full_score")), 1), "hit_points": hit, "miss_points": miss}).drop("_p")


def grade_answers(rows: DataFrame) -> DataFrame:
    """blank answers get 0; types 1 and 3 are graded as F5, 2 as F6, 4 as F7, else by rubric.

    rows(answer_id, q_type, full_score, reference, user_answer, rubric). method is 1 for rules, 2 for
    a blank left to the rubric, 3 for the rubric. A blank answer misses every point of its rubric.
    """
    full, expected, actual = F.col("full_score"), F.col("reference"), F.col("user_answer")
    by_rule = F.when(F.col("q_type").isin(1, 3), exact_score(full, expected, actual)).when(F.col("q_type") == 2, multi_score(full, expected, actual)).when(F.col("q_type") == 4, blank_score(full, expected, actual))
    blank = F.trim(F.coalesce(actual, F.lit(""))) == ""
    rows = rows.withColumn("_rule", F.when(blank, 0.0).otherwise(by_rule))
    # Only answers that no rule settles are held against a rubric.
    rubric = F.coalesce("rubric", F.expr("array(struct(reference as point, full_score as score))"))
    points = F.coalesce("rubric", F.expr(f"cast(array() as {POINTS})"))
    unsaid = F.transform(points, lambda p: F.struct(p["point"].alias("point"), F.lit(UNANSWERED).alias("hint")))
    graded = grade_rubric(rows.withColumns({"rubric": F.when(F.col("_rule").isNull(), rubric), "_unsaid": F.when(blank, unsaid)}))
    graded = graded.withColumn("miss_points", F.coalesce("_unsaid", "miss_points")).drop("_unsaid")
    method = F.when(F.col("_rule").isNotNull(), 1).when(F.col("q_type") == 4, 2).otherwise(3)
    return graded.withColumns({"score": clamp(F.coalesce("_rule", "score"), full), "method": method}).drop("_rule")


def clamp(score: Column, full: Column) -> Column:
    """within [0, full]; NaN and infinities are 0."""
    odd = F.isnan(score) | score.isin(float("inf"), float("-inf"))
    return F.when(odd, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(score, full)))


def clean_points(points: Column) -> Column:
    """points need a text (cut to 500 characters); scores have one decimal, missing ones are 0."""
    cut = lambda p: F.substring(F.trim(p["point"]), 1, 500)
    kept = F.filter(points, lambda p: F.coalesce(cut(p), F.lit("")) != "")
    return F.transform(kept, lambda p: F.struct(cut(p).alias("point"), F.bround(F.coalesce(p["score"], F.lit(0.0)), 1).alias("score")))


def verify_citations(cited: DataFrame, question_sources: DataFrame, chunks: DataFrame, keep: int = 4) -> DataFrame:
    """cited chunks that are among the question's sources, the first ``keep`` per answer, with their text.

    cited(answer_id, question_id, place, chunk_id, quote); question_sources(question_id, chunk_id). A citation
    counts once, but the same chunk cited for two questions is two.
    """
    rows = cited.join(question_sources.select("question_id", "chunk_id").distinct(), ["question_id", "chunk_id"], "left_semi").dropDuplicates(["answer_id", "question_id", "chunk_id", "place"])
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("answer_id").orderBy("place", "chunk_id", "question_id"))).filter(F.col("rank") <= keep)
    rows = rows.join(chunks.select("chunk_id", "doc_id", "chunk_index", F.substring("content", 1, 300).alias("snippet")), "chunk_id")
    return rows.withColumn("quote", F.substring("quote", 1, 500))


def exam_list(summaries: DataFrame, exams: DataFrame) -> DataFrame:
    """exams with their rate in percent, one decimal half up, 0 where the total is 0."""
    rows = exams.select("exam_id", "user_id", "kb_id", "status").join(summaries.select("exam_id", "got_score", "total_score"), "exam_id", "left").na.fill(0.0, ["got_score", "total_score"])
    return rows.withColumn("rate", F.coalesce(half_up(F.try_divide(F.col("got_score") * 100, "total_score"), 1), F.lit(0.0)))


def exam_result(answers: DataFrame, exams: DataFrame, questions: DataFrame, items: DataFrame) -> DataFrame:
    """items of every exam with their place in its paper; answer, analysis and score are hidden until it is graded.

    questions carry options and tags (E21), of which options show key and content only;
    items(exam_id, question_id, sort_order) give the place, which is missing for an item that the paper no longer has.
    Questions come last: until then the rows that are dealt out hold no texts.
    """
    shown = questions.select("question_id", "stem", "answer", "analysis", F.transform("options", lambda o: F.struct(o["option_key"], o["content"])).alias("options"), "tags")
    rows = answers.join(items, ["exam_id", "question_id"], "left").join(exams.select("exam_id", "status"), "exam_id").join(shown, "question_id")
    return rows.withColumns({c: F.when(F.col("status") == 3, F.col(c)) for c in ("answer", "analysis", "score")})


def apply_regrades(answers: DataFrame, regrades: DataFrame) -> tuple[DataFrame, DataFrame]:
    """answers with appealed scores replaced (appeal_status 2), and the totals of all exams anew.

    regrades(answer_id, score) replace; the score before is kept as appeal_from.
    """
    new = regrades.groupBy("answer_id").agg(F.max("score").alias("new_score"))
    rows = answers.join(new, "answer_id", "left")
    rows = rows.withColumns({"appeal_from": F.when(F.col("new_score").isNotNull(), F.col("score")), "appeal_status": F.when(F.col("new_score").isNotNull(), 2).otherwise(0), "score": clamp(F.coalesce("new_score", "score"), F.col("full_score"))}).drop("new_score")
    return rows, exam_summary(rows)


def recite_coverage(rows: DataFrame, limit: int = 40, shown: int = 10) -> DataFrame:
    """terms of the source that a recital names: rows(id, content, recital)."""
    source, said = X.terms(F.col("content"), limit), X.terms(F.col("recital"), limit)
    rows = rows.withColumns({"_h": F.array_sort(F.array_intersect(source, said)), "_m": F.array_sort(F.array_except(source, said)), "_n": F.size(source)})
    return rows.select("id", F.floor(100 * F.size("_h") / F.greatest(F.lit(1), F.col("_n"))).alias("coverage"), F.slice("_h", 1, shown).alias("hit"), F.slice("_m", 1, shown).alias("miss"))


#: Answers to grade: reference and given answer of every order line's question.
RESPONSE = """SELECT answer_id, exam_id, question_id, q_type, full_score, CASE WHEN q_type = 1 THEN chr(CAST(65 + k % 4 AS INT)) WHEN q_type = 2 THEN concat(chr(CAST(65 + k % 3 AS INT)), chr(CAST(66 + k % 3 AS INT))) WHEN q_type = 3 THEN 'T' ELSE p_type END AS reference,
    CASE WHEN n % 9 = 0 THEN ' ' WHEN q_type = 1 THEN concat('(', lower(chr(CAST(65 + n % 4 AS INT))), ')') WHEN q_type = 2 THEN concat(chr(CAST(65 + n % 3 AS INT)), ' ', chr(CAST(66 + n % 4 AS INT))) WHEN q_type = 3 THEN CASE WHEN n % 2 = 0 THEN 't' ELSE 'F' END
    WHEN n % 4 = 0 THEN lower(p_type) WHEN n % 4 = 1 THEN concat(split_part(p_type, ' ', 1), ' ', p_name) WHEN n % 4 = 2 THEN concat(split_part(p_type, ' ', 1), ' ', split_part(p_type, ' ', 2)) ELSE p_name END AS user_answer
    FROM (SELECT a.*, p.p_type, p.p_name, a.question_id AS k, a.answer_id % 1000 + a.exam_id AS n FROM {v_answer} a JOIN {part} p ON p.p_partkey = a.question_id) x"""
BARE = r"""lower(regexp_replace({0}, '[\s，。、；：！？,.;:!?（）()【】\[\]"''`*#>_-]', '', 'g'))"""
LETTERS = "coalesce(nullif(array_to_string(list_sort(list_distinct(regexp_extract_all(upper({0}), '[A-Z]'))), ''), ''), " + BARE + ")"
KEYS = r"regexp_extract_all(reference, '[A-Za-z][A-Za-z0-9+#.\-]{1,17}|[\x{4e00}-\x{9fff}]{2,12}')"
E_, A_ = LETTERS.replace("{0}", "reference"), LETTERS.replace("{0}", "user_answer")
EB, AB = BARE.replace("{0}", "reference"), BARE.replace("{0}", "user_answer")
EXACT = f"CASE WHEN {E_} = {A_} AND {E_} <> '' THEN full_score ELSE 0.0 END"
SET = lambda x: f"string_split({x}, '')"
WRONG = f"len(list_filter({SET(A_)}, lambda c: c <> '' AND NOT contains({E_}, c)))"
MULTI = f"CASE WHEN {E_} = '' THEN {EXACT} WHEN {E_} = {A_} THEN full_score WHEN {WRONG} > 0 THEN 0.0 ELSE round_even(full_score * 0.5, 1) END"
SHARE = f"len(list_filter({KEYS}, lambda k: contains({AB}, {BARE.replace('{0}', 'k')}))) / len({KEYS})"
BLANK = f"CASE WHEN {AB} <> '' AND (contains({AB}, {EB}) OR contains({EB}, {AB})) THEN full_score WHEN len({KEYS}) > 0 AND {SHARE} >= 0.6 THEN full_score END"
COMPACT = r"regexp_replace(user_answer, '\s+', '', 'g')"
TERMS6 = r"list_distinct(regexp_extract_all(reference, '[A-Za-z][A-Za-z0-9+#.\-]{1,17}|[\x{4e00}-\x{9fff}]{2,10}'))"
HITS = f"len(list_filter({TERMS6}, lambda k: contains({COMPACT}, k))) / len({TERMS6})"
RUBRIC = f"CASE WHEN {HITS} >= 0.5 THEN full_score WHEN {HITS} > 0 THEN round_even(full_score, 0) / 2 ELSE 0.0 END"


def _response(s) -> DataFrame:
    return s.sql(RESPONSE)


def _with_rubric(s) -> DataFrame:
    return _response(s).withColumn("rubric", F.expr(f"case when q_type > 4 then cast(array(struct(reference as point, full_score as score)) as {POINTS}) end"))


def _add(name: str, query, select: str, where: str = "") -> None:
    R.add(name, query)
    head = twin("WITH response AS (" + RESPONSE + ") SELECT")
    R.oracles[name] = f"{head} {select} FROM response {where}"


_add("normalize_answer", lambda s: _response(s).select("answer_id", X.choice_letters(F.col("user_answer")).alias("norm")), f"answer_id, {A_} AS norm")
_add("grade_exact", lambda s: _response(s).filter("q_type in (1, 3)").select("answer_id", exact_score(F.col("full_score"), F.col("reference"), F.col("user_answer")).alias("score")), f"answer_id, {EXACT} AS score", "WHERE q_type IN (1, 3)")
_add("grade_multi", lambda s: _response(s).filter("q_type = 2").select("answer_id", multi_score(F.col("full_score"), F.col("reference"), F.col("user_answer")).alias("score")), f"answer_id, {MULTI} AS score", "WHERE q_type = 2")
_add("grade_blank", lambda s: _response(s).filter("q_type = 4").select("answer_id", blank_score(F.col("full_score"), F.col("reference"), F.col("user_answer")).alias("score")), f"answer_id, {BLANK} AS score", "WHERE q_type = 4")
_add("grade_rubric", lambda s: grade_rubric(_response(s).filter("q_type > 4").withColumn("rubric", F.expr("array(struct(reference as point, full_score as score))"))).select("answer_id", "score", F.size("hit_points").alias("n_hit"), F.size("miss_points").alias("n_miss")),
     f"answer_id, {RUBRIC} AS score, CASE WHEN {HITS} > 0 THEN 1 ELSE 0 END AS n_hit, CASE WHEN {HITS} < 0.5 THEN 1 ELSE 0 END AS n_miss", "WHERE q_type > 4")
GRADE = f"CASE WHEN trim(user_answer) = '' THEN 0.0 WHEN q_type IN (1, 3) THEN {EXACT} WHEN q_type = 2 THEN {MULTI} WHEN q_type = 4 THEN coalesce({BLANK}, {RUBRIC}) ELSE {RUBRIC} END"
_add("grade_answers", lambda s: grade_answers(_with_rubric(s)).select("answer_id", "score", "method", F.coalesce(F.size("miss_points"), F.lit(0)).alias("n_miss"), F.coalesce(F.size(F.filter("miss_points", lambda p: p["hint"] == "未作答")), F.lit(0)).alias("unanswered")),
     f"answer_id, {GRADE} AS score, CASE WHEN trim(user_answer) = '' OR q_type <= 3 OR q_type = 4 AND {BLANK} IS NOT NULL THEN 1 WHEN q_type = 4 THEN 2 ELSE 3 END AS method, CASE WHEN trim(user_answer) = '' THEN CASE WHEN q_type > 4 THEN 1 ELSE 0 END WHEN q_type > 4 OR q_type = 4 AND {BLANK} IS NULL THEN CASE WHEN {HITS} < 0.5 OR {HITS} IS NULL THEN 1 ELSE 0 END ELSE 0 END AS n_miss, CASE WHEN trim(user_answer) = '' THEN CASE WHEN q_type > 4 THEN 1 ELSE 0 END ELSE 0 END AS unanswered")
R.add("start_exam", lambda s: start_exam(s["v_paper_item"], s["v_question"]),
      """SELECT paper_id, i.question_id, CAST(row_number() OVER (PARTITION BY paper_id ORDER BY sort_order, i.question_id) AS INT) AS seq, CASE WHEN q_type <= 4 THEN 5.0 ELSE 10.0 END AS full_score,
      sum(CASE WHEN q_type <= 4 THEN 5.0 ELSE 10.0 END) OVER (PARTITION BY paper_id) AS total_score, '' AS user_answer FROM {v_paper_item} i JOIN {v_question} q ON q.question_id = i.question_id AND q.status = 1""")  # fmt: skip
R.add("apply_answers", lambda s: apply_answers(s["v_answer"].selectExpr("exam_id", "question_id", "'' as user_answer", "'' as asr_text", "0 as input_mode"),
      s["v_answer"].selectExpr("exam_id", "question_id", "answer_id as seq", "concat('answer ', question_id) as user_answer", "if(question_id % 2 = 0, ' ', 'spoken') as asr_text", "if(question_id % 3 = 0, 1, null) as input_mode"), s["v_exam"]),
      """SELECT a.exam_id, a.question_id, CASE WHEN e.status = 0 THEN concat('answer ', a.question_id) ELSE '' END AS user_answer, CASE WHEN e.status = 0 AND a.question_id % 2 <> 0 THEN 'spoken' ELSE '' END AS asr_text,
      CASE WHEN e.status = 0 AND a.question_id % 3 = 0 THEN 1 ELSE 0 END AS input_mode FROM {v_answer} a LEFT JOIN {v_exam} e ON e.exam_id = a.exam_id""")  # fmt: skip
SOURCES = "SELECT question_id, stem, answer, array(question_id % 200, question_id % 90, question_id % 7) AS source_chunk_ids FROM {v_question}"
R.add("load_answers", lambda s: load_answers(s["v_answer"].drop("q_type"), s.sql(SOURCES), s["v_chunk"]).select("answer_id", "stem", "full_score", F.array_join(F.transform("sources", lambda x: x["chunk_id"].cast("string")), ",").alias("chunks"), F.aggregate("sources", F.lit(0), lambda t, x: t + F.length(x["content"])).alias("n_chars")),
      """SELECT a.answer_id, q.stem, a.full_score, concat_ws(',', q.question_id % 200, q.question_id % 90, q.question_id % 7) AS chunks, length(substring(c1.content, 1, 2500)) + length(substring(c2.content, 1, 2500)) + length(substring(c3.content, 1, 2500)) AS n_chars
      FROM {v_answer} a JOIN {v_question} q ON q.question_id = a.question_id JOIN {v_chunk} c1 ON c1.chunk_id = q.question_id % 200 JOIN {v_chunk} c2 ON c2.chunk_id = q.question_id % 90 JOIN {v_chunk} c3 ON c3.chunk_id = q.question_id % 7""")  # fmt: skip
R.add("clamp_and_clean", lambda s: s["v_answer"].select("answer_id", clamp(F.when(F.col("answer_id") % 13 == 0, float("nan")).otherwise(F.col("score") * 3 - 1), F.col("full_score")).alias("score")),
      "SELECT answer_id, CASE WHEN answer_id % 13 = 0 THEN 0.0 ELSE greatest(0.0, least(score * 3 - 1, full_score)) END AS score FROM {v_answer}")
CITED = "SELECT answer_id, question_id, f.i AS place, CASE f.i WHEN 0 THEN question_id % 200 WHEN 1 THEN question_id % 90 ELSE answer_id % 100 END AS chunk_id, 'quote' AS quote FROM {v_answer} CROSS JOIN (SELECT 0 AS i UNION ALL SELECT 1 UNION ALL SELECT 2) f"
KNOWN = "SELECT question_id, question_id % 200 AS chunk_id FROM {v_question} UNION SELECT question_id, question_id % 90 FROM {v_question} UNION SELECT question_id, question_id % 7 FROM {v_question}"
R.add("verify_citations", lambda s: verify_citations(s.sql(CITED), s.sql(KNOWN), s["v_chunk"], 2).select("answer_id", "rank", "chunk_id", "doc_id", F.length("snippet").alias("n")),
      f"SELECT r.answer_id, r.rank, r.chunk_id, c.doc_id, length(substring(c.content, 1, 300)) AS n FROM (SELECT *, row_number() OVER (PARTITION BY answer_id ORDER BY place, chunk_id) AS rank FROM ({CITED}) x WHERE (question_id, chunk_id) IN (SELECT question_id, chunk_id FROM ({KNOWN}) k)) r JOIN {{v_chunk}} c ON c.chunk_id = r.chunk_id WHERE rank <= 2")
TOTALS = "SELECT exam_id, round(sum(score), 1) AS got, round(sum(full_score), 1) AS total FROM {v_answer} GROUP BY exam_id"
R.add("exam_list", lambda s: exam_list(exam_summary(s["v_answer"]), s["v_exam"]), f"SELECT e.exam_id, e.user_id, e.kb_id, e.status, coalesce(got, 0.0) AS got_score, coalesce(total, 0.0) AS total_score, coalesce(round(got * 100 / nullif(total, 0) + 1e-7, 1), 0.0) AS rate FROM {{v_exam}} e LEFT JOIN ({TOTALS}) t ON t.exam_id = e.exam_id")
ITEMS = "SELECT paper_id AS exam_id, question_id, sort_order FROM {v_paper_item}"
R.add("exam_result", lambda s: exam_result(s["v_answer"], s["v_exam"], enrich_questions(s["v_question"], s["v_option"], tag_briefs(s["v_question_tag"], s["v_tag"], "question_id")), s.sql(ITEMS)).select("answer_id", "sort_order", "stem", "answer", "analysis", "score",
      F.array_join(F.transform("options", lambda o: F.concat_ws(":", o["option_key"], o["content"])), ",").alias("options"), F.array_join(F.transform("tags", lambda t: F.concat_ws(":", t["id"].cast("string"), t["name"], t["level"].cast("string"))), ",").alias("tags")),
      f"""SELECT a.answer_id, i.sort_order, q.stem, CASE WHEN e.status = 3 THEN q.answer END AS answer, CASE WHEN e.status = 3 THEN q.analysis END AS analysis, CASE WHEN e.status = 3 THEN a.score END AS score, o.options, g.tags FROM {{v_answer}} a JOIN {{v_exam}} e ON e.exam_id = a.exam_id JOIN {{v_question}} q ON q.question_id = a.question_id
      LEFT JOIN ({ITEMS}) i ON i.exam_id = a.exam_id AND i.question_id = a.question_id LEFT JOIN (SELECT question_id, string_agg(concat(option_key, ':', content), ',' ORDER BY sort_order) AS options FROM {{v_option}} GROUP BY 1) o ON o.question_id = a.question_id
      LEFT JOIN (SELECT question_id, string_agg(concat_ws(':', x.tag_id, name, level), ',' ORDER BY x.tag_id) AS tags FROM {{v_question_tag}} x JOIN {{v_tag}} t ON t.tag_id = x.tag_id GROUP BY 1) g ON g.question_id = a.question_id""")  # fmt: skip
R.add("apply_regrades", lambda s: apply_regrades(s["v_answer"], s["v_answer"].filter("answer_id % 10 = 3").selectExpr("answer_id", "score + 2 as score"))[1].select("exam_id", "got_score", "correct_count"),
      """SELECT exam_id, round(sum(s), 1) AS got_score, count(*) FILTER (WHERE s >= 0.999 * full_score) AS correct_count FROM (SELECT *, CASE WHEN answer_id % 10 = 3 THEN least(score + 2, full_score) ELSE score END AS s FROM {v_answer}) x GROUP BY exam_id""")  # fmt: skip
R.add("recite_coverage", lambda s: recite_coverage(s["v_doc"].selectExpr("doc_id as id", "text as content", "substring(text, 1, 300) as recital")).select("id", "coverage", F.array_join("hit", ",").alias("hit")),
      r"""SELECT id, CAST(floor(100 * len(h) / greatest(1, len(a))) AS BIGINT) AS coverage, array_to_string(h[1:10], ',') AS hit FROM (SELECT id, a, list_sort(list_filter(a, lambda x: list_contains(b, x))) AS h FROM (
      SELECT doc_id AS id, list_transform(list_filter(list_zip(t, range(1, len(t) + 1)), lambda z: list_position(t, z[1]) = z[2]), lambda z: z[1])[1:40] AS a, list_transform(list_filter(list_zip(r, range(1, len(r) + 1)), lambda z: list_position(r, z[1]) = z[2]), lambda z: z[1])[1:40] AS b
      FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z][A-Za-z0-9+#.\-]{1,17}|[\x{4e00}-\x{9fff}]{2,10}') AS t, regexp_extract_all(substring(text, 1, 300), '[A-Za-z][A-Za-z0-9+#.\-]{1,17}|[\x{4e00}-\x{9fff}]{2,10}') AS r FROM {v_doc}) y) x) w""")  # fmt: skip
