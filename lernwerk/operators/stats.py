"""Statistics: overview, streaks, mastery, trends and cost (H), and counters kept on other tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.rounding import half_up
from ..sources.shared import new_path
from ..sources.views import AS_OF, EVENTS_AS_OF, Registry
from ..streaming import exam_totals

R = Registry()
#: A score counts as correct from this share of the full score.
CORRECT = 0.999
GRADED = 3


def rate() -> Column:
    """Share of the full score; null where that is zero."""
    return F.try_divide("score", "full_score")


def is_correct() -> Column:
    return F.col("score") >= CORRECT * F.col("full_score")


def days(n_past: int, n_future: int, as_of: Column) -> Column:
    """Every date from as_of - n_past to as_of + n_future."""
    day = F.to_date(as_of)
    return F.explode(F.sequence(F.date_sub(day, n_past), F.date_add(day, n_future)))


def tag_mastery(answers: DataFrame, exams: DataFrame, question_tags: DataFrame, tags: DataFrame) -> DataFrame:
    """Per tag over graded exams: answers, correct ones and the mean rate.

    Answers are added up by question before they meet the tags, so a frequent tag costs one row per question.
    """
    graded = answers.join(exams.filter(F.col("status") == GRADED).select("exam_id"), "exam_id")
    by_question = graded.groupBy("question_id").agg(F.count("*").alias("n"), F.count_if(is_correct()).alias("c"), F.sum(rate()).alias("r"), F.count(rate()).alias("k"))
    found = question_tags.join(by_question, "question_id").groupBy("tag_id").agg(F.sum("n").alias("answered"), F.sum("c").alias("correct"), F.try_divide(F.sum("r"), F.sum("k")).alias("avg_rate"))
    return tags.select("tag_id", "kb_id", "name", "level").join(found, "tag_id").select("tag_id", "kb_id", "name", "level", "answered", "correct", F.round("avg_rate", 6).alias("avg_rate"))


def weakest_tags(mastery: DataFrame, n: int = 8) -> DataFrame:
    """The n tags with the lowest mean rate of every knowledge base (a top-k report)."""
    order = W.partitionBy("kb_id").orderBy("avg_rate", "tag_id")
    return mastery.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def score_trend(answers: DataFrame, exams: DataFrame, as_of: Column, n_days: int) -> DataFrame:
    """Per day of grading in the last n_days: exams, answers, mean rate in percent; days without are zero."""
    n_days = min(365, max(1, n_days))
    window = exams.filter(F.to_date("graded_at").between(F.date_sub(F.to_date(as_of), n_days), F.to_date(as_of)) & (F.col("status") == GRADED))
    found = answers.join(window.select("exam_id", F.to_date("graded_at").alias("day")), "exam_id")
    found = found.groupBy("day").agg(F.countDistinct("exam_id").alias("exams"), F.count("*").alias("answers"), F.avg(rate()).alias("r"))
    every = exams.sparkSession.range(1).select(days(n_days, 0, as_of).alias("day"))
    zero = F.lit(0).cast("long")
    return every.join(found, "day", "left").select("day", F.coalesce("exams", zero).alias("exams"), F.coalesce("answers", zero).alias("answers"), F.coalesce(half_up(F.col("r") * 100, 2), F.lit(0.0)).alias("avg_rate"))


def activity_days(reviews: DataFrame, exams: DataFrame) -> DataFrame:
    """(user_id, day) of every day with a review or a submission, each once."""
    return reviews.select("user_id", F.to_date("ts").alias("day")).union(exams.filter("submitted_at is not null").select("user_id", F.to_date("submitted_at"))).distinct()


def activity_streak(active: DataFrame, as_of: Column) -> DataFrame:
    """Per user: length of the run of active days that ends on as_of or the day before, else 0."""
    today = F.to_date(as_of)
    order = W.partitionBy("user_id").orderBy("day")
    runs = active.filter(F.col("day") <= today).withColumn("run", F.date_sub("day", F.row_number().over(order)))
    runs = runs.groupBy("user_id", "run").agg(F.count("*").alias("n"), F.max("day").alias("last"))
    return runs.groupBy("user_id").agg(F.coalesce(F.max(F.when(F.col("last") >= F.date_sub(today, 1), F.col("n"))), F.lit(0)).cast("long").alias("streak"))


def ai_cost_daily(calls: DataFrame, prices: DataFrame, as_of: Column, n_days: int) -> DataFrame:
    """Per day, vendor and model: calls, failures, tokens, cost and mean latency."""
    rows = estimate_cost(in_window(calls, as_of, n_days), prices).withColumn("day", F.to_date("created_at"))
    return rows.groupBy("day", "vendor", "model").agg(
        F.count("*").alias("calls"), F.count_if(F.col("success") == 0).alias("failed"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"),
        half_up(F.sum("cost"), 4).cast("double").alias("cost"), F.floor(F.avg("latency_ms")).cast("long").alias("avg_latency"),
    )


def ai_cost_total(calls: DataFrame, prices: DataFrame, as_of: Column, n_days: int) -> DataFrame:
    """Calls, tokens, cost and mean latency of the window; zeros for none."""
    rows = estimate_cost(in_window(calls, as_of, n_days), prices)
    zero = lambda c: F.coalesce(c, F.lit(0))
    return rows.agg(F.count("*").alias("calls"), zero(F.sum(F.col("prompt_tokens") + F.col("completion_tokens"))).cast("long").alias("tokens"), zero(half_up(F.sum("cost"), 4)).cast("double").alias("cost"), zero(F.floor(F.avg("latency_ms"))).cast("long").alias("avg_latency"))


def in_window(calls: DataFrame, as_of: Column, n_days: int) -> DataFrame:
    return calls.filter((F.col("created_at") >= F.date_sub(F.to_date(as_of), n_days)) & (F.col("created_at") < F.date_add(F.to_date(as_of), 1)))


def estimate_cost(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """cost = tokens in and out per million times their prices, six decimals; 0 without a price (I4)."""
    priced = calls.join(prices.select("model", "price_in", "price_out"), "model", "left")
    per = lambda tokens, price: F.coalesce(F.col(tokens), F.lit(0)) / F.lit(1e6) * F.coalesce(F.col(price), F.lit(0.0))
    return priced.withColumn("cost", half_up(per("prompt_tokens", "price_in") + per("completion_tokens", "price_out"), 6)).drop("price_in", "price_out")


def kb_mastery(kbs: DataFrame, questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Per knowledge base: published questions, all answers and their mean rate."""
    published = questions.filter("status = 1").groupBy("kb_id").agg(F.count("*").alias("questions"))
    done = answers.groupBy("question_id").agg(F.count("*").alias("n"), F.sum(rate()).alias("r"), F.count(rate()).alias("k"))
    done = done.join(questions.select("question_id", "kb_id"), "question_id").groupBy("kb_id").agg(F.sum("n").alias("answers"), F.try_divide(F.sum("r"), F.sum("k")).alias("r"))
    zero = F.lit(0).cast("long")
    return kbs.select("kb_id", "name").join(published, "kb_id", "left").join(done, "kb_id", "left").select("kb_id", "name", F.coalesce("questions", zero).alias("questions"), F.coalesce("answers", zero).alias("answers"), F.round("r", 6).alias("avg_rate"))


def overview(kbs: DataFrame, documents: DataFrame, chunks: DataFrame, questions: DataFrame, mistakes: DataFrame, exams: DataFrame, answers: DataFrame, log: DataFrame, active: DataFrame, as_of: Column) -> DataFrame:
    """One row of totals (H1): ready documents(doc_id), the review log(reviewed_at), active(user_id, day) among them; every table is read once."""
    streak = activity_streak(active.select(F.lit(0).alias("user_id"), "day").distinct(), as_of)
    graded = exams.filter(F.col("status") == GRADED)
    got = answers.join(graded.select("exam_id"), "exam_id").agg(F.sum("score").alias("got"), F.sum("full_score").alias("total"))
    parts = [
        kbs.agg(F.count("*").alias("kbs")),
        documents.agg(F.count("*").alias("documents")),
        log.agg(F.count_if(F.to_date("reviewed_at") == F.to_date(as_of)).alias("reviewed_today")),
        streak.agg(F.coalesce(F.max("streak"), F.lit(0)).alias("streak")),
        chunks.agg(F.count("*").alias("chunks")),
        questions.agg(F.count("*").alias("questions"), F.count_if(F.col("status") == 1).alias("published"), F.count_if(F.col("status") == 0).alias("draft")),
        mistakes.agg(F.count("*").alias("mistakes"), F.count_if(F.col("mastered") == 1).alias("mastered"), F.count_if((F.col("mastered") == 0) & (F.col("next_review_at") <= as_of)).alias("due")),
        exams.agg(F.count("*").alias("exams"), F.count_if(F.col("status") == GRADED).alias("graded")),
        answers.agg(F.count("*").alias("answers")),
        got.select(F.coalesce(F.round(F.try_divide("got", "total") * 1000) / 10, F.lit(0.0)).alias("avg_rate")),
    ]
    out = parts[0]
    for part in parts[1:]:  # one row each
        out = out.join(part)
    return out


def exam_summary(answers: DataFrame) -> DataFrame:
    """Per exam: points, correct and wrong answers, rate in percent."""
    found = answers.groupBy("exam_id").agg(F.round(F.sum("score"), 1).alias("got_score"), F.round(F.sum("full_score"), 1).alias("total_score"), F.count_if(is_correct()).alias("correct_count"), F.count("*").alias("n"))
    share = F.coalesce(F.round(F.try_divide(F.col("got_score") * 100, F.col("total_score")), 1), F.lit(0.0))
    return found.select("exam_id", "got_score", "total_score", "correct_count", (F.col("n") - F.col("correct_count")).alias("wrong_count"), share.alias("rate"))


def question_stats(answers: DataFrame, exams: DataFrame) -> DataFrame:
    """Per question of a graded exam: uses and correct answers there, and the mean rate over all its answers."""
    graded = exams.filter(F.col("status") == GRADED).select("exam_id", F.lit(True).alias("graded"))
    rows = answers.join(graded, "exam_id", "left").groupBy("question_id").agg(F.count_if("graded").alias("use_count"), F.count_if(F.col("graded") & is_correct()).alias("correct_count"), half_up(F.coalesce(F.avg(rate()), F.lit(0.0)), 4).alias("avg_score_rate"))
    return rows.filter("use_count > 0")


def tag_counts(tags: DataFrame, chunk_tags: DataFrame, question_tags: DataFrame) -> DataFrame:
    """Chunks and questions of every tag, zero without any."""
    out = tags.select("tag_id", "kb_id")
    for rows, name in ((chunk_tags, "chunk_count"), (question_tags, "question_count")):
        out = out.join(rows.groupBy("tag_id").agg(F.count("*").alias(name)), "tag_id", "left")
    return out.na.fill(0, ["chunk_count", "question_count"])


def kb_counters(kbs: DataFrame, chunks: DataFrame, questions: DataFrame, tags: DataFrame) -> DataFrame:
    """Documents, chunks, questions and tags of every knowledge base."""
    out = kbs.select("kb_id", "name")
    counted = (chunks.groupBy("kb_id").agg(F.countDistinct("doc_id").alias("documents"), F.count("*").alias("chunks")), questions.groupBy("kb_id").agg(F.count("*").alias("questions")), tags.groupBy("kb_id").agg(F.count("*").alias("tags")))
    for rows in counted:
        out = out.join(rows, "kb_id", "left")
    return out.na.fill(0)


def kb_top_tags(counts: DataFrame, n: int = 20) -> DataFrame:
    """The n tags with most chunks of every knowledge base (a top-k report)."""
    order = W.partitionBy("kb_id").orderBy(F.desc("chunk_count"), "tag_id")
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n).select("kb_id", "rank", "tag_id", "chunk_count")


def now() -> Column:
    return F.expr(AS_OF)


def events_now() -> Column:
    return F.expr(EVENTS_AS_OF)


MASTERY = """SELECT t.tag_id, t.kb_id, t.name, t.level, count(*) AS answered, count(*) FILTER (WHERE a.score >= 0.999 * a.full_score) AS correct, round(avg(a.score / nullif(a.full_score, 0)), 6) AS avg_rate
    FROM {v_answer} a JOIN {v_exam} e ON a.exam_id = e.exam_id AND e.status = 3 JOIN {v_question_tag} q ON q.question_id = a.question_id JOIN {v_tag} t ON t.tag_id = q.tag_id GROUP BY t.tag_id, t.kb_id, t.name, t.level"""
PRICES = "SELECT 'model' || CAST(i AS VARCHAR) AS model, i * 0.5 AS price_in, i * 1.5 AS price_out FROM range(1, 7) x(i)"


def _mastery(s) -> DataFrame:
    return tag_mastery(s["v_answer"], s["v_exam"], s["v_question_tag"], s["v_tag"])


def _prices(s) -> DataFrame:
    """Model 0 has no price."""
    return s.spark.range(1, 7).selectExpr("concat('model', id) as model", "id * 0.5D as price_in", "id * 1.5D as price_out")


R.add("tag_mastery", _mastery, MASTERY)
R.add("weakest_tags", lambda s: weakest_tags(_mastery(s)), f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kb_id ORDER BY avg_rate, tag_id) AS rank FROM ({MASTERY}) m) x WHERE rank <= 8")
R.add("score_trend", lambda s: score_trend(s["v_answer"], s["v_exam"], now(), 365).withColumn("day", F.col("day").cast("string")),
      """SELECT CAST(d.day AS VARCHAR) AS day, coalesce(exams, 0) AS exams, coalesce(answers, 0) AS answers, coalesce(avg_rate, 0.0) AS avg_rate
      FROM (SELECT CAST(x AS DATE) AS day FROM generate_series(DATE '2001-08-02' - INTERVAL 365 DAY, TIMESTAMP '2001-08-02', INTERVAL 1 DAY) g(x)) d LEFT JOIN
      (SELECT CAST(e.graded_at AS DATE) AS day, count(DISTINCT e.exam_id) AS exams, count(*) AS answers, round(avg(a.score / nullif(a.full_score, 0)) * 100 + 1e-8, 2) AS avg_rate FROM {v_answer} a JOIN {v_exam} e ON a.exam_id = e.exam_id AND e.status = 3 GROUP BY 1) f ON d.day = f.day""")  # fmt: skip
R.add("activity_streak", lambda s: activity_streak(activity_days(s["v_attempt"], s["v_exam"]), now()),
      f"""WITH days AS (SELECT user_id, CAST(ts AS DATE) AS day FROM {{v_attempt}} UNION SELECT user_id, CAST(submitted_at AS DATE) FROM {{v_exam}}),
      runs AS (SELECT user_id, day, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INT) AS run FROM days WHERE day <= CAST({AS_OF} AS DATE)),
      sized AS (SELECT user_id, run, count(*) AS n, max(day) AS last FROM runs GROUP BY user_id, run)
      SELECT user_id, coalesce(max(CASE WHEN last >= CAST({AS_OF} AS DATE) - 1 THEN n END), 0) AS streak FROM sized GROUP BY user_id""")  # fmt: skip
COST = f"""SELECT c.*, round(c.prompt_tokens / 1e6 * coalesce(p.price_in, 0.0) + c.completion_tokens / 1e6 * coalesce(p.price_out, 0.0) + 1e-12, 6) AS cost FROM {{v_call_log}} c LEFT JOIN ({PRICES}) p ON p.model = c.model
    WHERE created_at >= CAST({EVENTS_AS_OF} AS DATE) - 30 AND created_at < CAST({EVENTS_AS_OF} AS DATE) + 1"""
R.add("ai_cost_daily", lambda s: ai_cost_daily(s["v_call_log"], _prices(s), events_now(), 30).withColumn("day", F.col("day").cast("string")),
      f"SELECT CAST(CAST(created_at AS DATE) AS VARCHAR) AS day, vendor, model, count(*) AS calls, count(*) FILTER (WHERE success = 0) AS failed, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, CAST(round(sum(cost) + 1e-10, 4) AS DOUBLE) AS cost, CAST(floor(avg(latency_ms)) AS BIGINT) AS avg_latency FROM ({COST}) x GROUP BY 1, 2, 3")
R.add("ai_cost_total", lambda s: ai_cost_total(s["v_call_log"], _prices(s), events_now(), 30),
      f"SELECT count(*) AS calls, CAST(coalesce(sum(prompt_tokens + completion_tokens), 0) AS BIGINT) AS tokens, CAST(coalesce(round(sum(cost) + 1e-10, 4), 0) AS DOUBLE) AS cost, CAST(coalesce(floor(avg(latency_ms)), 0) AS BIGINT) AS avg_latency FROM ({COST}) x")
R.add("estimate_cost", lambda s: estimate_cost(s["v_call_log"], _prices(s)).select("call_id", "cost"),
      f"SELECT c.call_id, round(c.prompt_tokens / 1e6 * coalesce(p.price_in, 0.0) + c.completion_tokens / 1e6 * coalesce(p.price_out, 0.0) + 1e-12, 6) AS cost FROM {{v_call_log}} c LEFT JOIN ({PRICES}) p ON p.model = c.model")
R.add("kb_mastery", lambda s: kb_mastery(s["v_kb"], s["v_question"], s["v_answer"]),
      """SELECT k.kb_id, k.name, (SELECT count(*) FROM {v_question} q WHERE q.kb_id = k.kb_id AND q.status = 1) AS questions, coalesce(n, 0) AS answers, avg_rate FROM {v_kb} k
      LEFT JOIN (SELECT q.kb_id, count(*) AS n, round(avg(a.score / nullif(a.full_score, 0)), 6) AS avg_rate FROM {v_answer} a JOIN {v_question} q ON q.question_id = a.question_id GROUP BY q.kb_id) f ON f.kb_id = k.kb_id""")  # fmt: skip
R.add("overview", lambda s: overview(s["v_kb"], s["v_doc"], s["v_chunk"], s["v_question"], s["v_mistake"], s["v_exam"], s["v_answer"], s["v_review_log"], activity_days(s["v_attempt"], s["v_exam"]), now()),
      f"""SELECT (SELECT count(*) FROM {{v_kb}}) AS kbs, (SELECT count(*) FROM {{v_doc}}) AS documents, (SELECT count(*) FROM {{v_review_log}} WHERE CAST(reviewed_at AS DATE) = CAST({AS_OF} AS DATE)) AS reviewed_today,
      (SELECT coalesce(max(CASE WHEN last >= CAST({AS_OF} AS DATE) - 1 THEN n END), 0) FROM (SELECT count(*) AS n, max(day) AS last FROM (SELECT day, day - CAST(row_number() OVER (ORDER BY day) AS INT) AS run FROM (SELECT CAST(ts AS DATE) AS day FROM {{v_attempt}} UNION SELECT CAST(submitted_at AS DATE) FROM {{v_exam}}) d
      WHERE day <= CAST({AS_OF} AS DATE)) r GROUP BY run) z) AS streak, (SELECT count(*) FROM {{v_chunk}}) AS chunks, q.*, m.*, e.*, (SELECT count(*) FROM {{v_answer}}) AS answers,
      (SELECT round(sum(score) / sum(full_score) * 1000) / 10 FROM {{v_answer}} a JOIN {{v_exam}} x ON a.exam_id = x.exam_id AND x.status = 3) AS avg_rate
      FROM (SELECT count(*) AS questions, count(*) FILTER (WHERE status = 1) AS published, count(*) FILTER (WHERE status = 0) AS draft FROM {{v_question}}) q,
      (SELECT count(*) AS mistakes, count(*) FILTER (WHERE mastered = 1) AS mastered, count(*) FILTER (WHERE mastered = 0 AND next_review_at <= {AS_OF}) AS due FROM {{v_mistake}}) m,
      (SELECT count(*) AS exams, count(*) FILTER (WHERE status = 3) AS graded FROM {{v_exam}}) e""")  # fmt: skip
R.add("exam_summary", lambda s: exam_summary(s["v_answer"]),
      """SELECT exam_id, round(sum(score), 1) AS got_score, round(sum(full_score), 1) AS total_score, count(*) FILTER (WHERE score >= 0.999 * full_score) AS correct_count, count(*) FILTER (WHERE score < 0.999 * full_score) AS wrong_count,
      round(round(sum(score), 1) * 100 / sum(full_score), 1) AS rate FROM {v_answer} GROUP BY exam_id""")  # fmt: skip
#: Answers as they were graded, and graded again: every third gets a point more, every fifth's first grade arrives once more.
GRADES = "SELECT exam_id, answer_id, CAST(0 AS BIGINT) AS version, score, full_score FROM {v_answer}"
REGRADES = "SELECT exam_id, answer_id, CAST(1 AS BIGINT) AS version, least(full_score, score + 1.0) AS score, full_score FROM {v_answer} WHERE answer_id % 3 = 0"


def _streamed_totals(s) -> DataFrame:
    """Totals as a stream over two arrivals of files, with the same state."""
    spark, first, again = s.spark, s.sql(GRADES), s.sql(REGRADES)
    arriving, state, out = (new_path(spark, x) for x in ("grades", "totals-state", "totals"))
    for step, rows in enumerate((first, again.unionByName(first.filter("answer_id % 5 = 0")))):
        rows.select(*first.columns).write.mode("append").parquet(arriving)
        updates = exam_totals.totals_stream(spark.readStream.schema(first.schema).parquet(arriving))
        write = lambda part, no, step=step: part.withColumn("step", F.lit(step)).write.mode("append").parquet(out)
        updates.writeStream.outputMode("update").option("checkpointLocation", state).foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    last = F.row_number().over(W.partitionBy("exam_id").orderBy(F.desc("step")))
    return exam_totals.summary(spark.read.parquet(out).withColumn("r", last).filter("r = 1"))


R.add("exam_totals_stream", _streamed_totals,
      """WITH a AS (SELECT exam_id, full_score, CASE WHEN answer_id % 3 = 0 THEN least(full_score, score + 1.0) ELSE score END AS score FROM {v_answer})
      SELECT exam_id, round(sum(score), 1) AS got_score, round(sum(full_score), 1) AS total_score, count(*) FILTER (WHERE score >= 0.999 * full_score) AS correct_count, count(*) FILTER (WHERE score < 0.999 * full_score) AS wrong_count,
      round(round(sum(score), 1) * 100 / sum(full_score), 1) AS rate FROM a GROUP BY exam_id""")  # fmt: skip
R.add("question_stats", lambda s: question_stats(s["v_answer"], s["v_exam"]),
      "SELECT a.question_id, count(e.exam_id) AS use_count, count(e.exam_id) FILTER (WHERE score >= 0.999 * full_score) AS correct_count, round(coalesce(avg(score / nullif(full_score, 0)), 0) + 1e-10, 4) AS avg_score_rate FROM {v_answer} a LEFT JOIN {v_exam} e ON a.exam_id = e.exam_id AND e.status = 3 GROUP BY a.question_id HAVING count(e.exam_id) > 0")
R.add("refresh_tag_counts", lambda s: tag_counts(s["v_tag"], s["v_chunk_tag"], s["v_question_tag"]),
      """SELECT t.tag_id, t.kb_id, coalesce(c.n, 0) AS chunk_count, coalesce(q.n, 0) AS question_count FROM {v_tag} t LEFT JOIN (SELECT tag_id, count(*) AS n FROM {v_chunk_tag} GROUP BY tag_id) c ON c.tag_id = t.tag_id
      LEFT JOIN (SELECT tag_id, count(*) AS n FROM {v_question_tag} GROUP BY tag_id) q ON q.tag_id = t.tag_id""")  # fmt: skip
R.add("kb_counters", lambda s: kb_counters(s["v_kb"], s["v_chunk"], s["v_question"], s["v_tag"]),
      """SELECT k.kb_id, k.name, (SELECT count(DISTINCT doc_id) FROM {v_chunk} c WHERE c.kb_id = k.kb_id) AS documents, (SELECT count(*) FROM {v_chunk} c WHERE c.kb_id = k.kb_id) AS chunks,
      (SELECT count(*) FROM {v_question} q WHERE q.kb_id = k.kb_id) AS questions, (SELECT count(*) FROM {v_tag} t WHERE t.kb_id = k.kb_id) AS tags FROM {v_kb} k""")  # fmt: skip
R.add("kb_top_tags", lambda s: kb_top_tags(tag_counts(s["v_tag"], s["v_chunk_tag"], s["v_question_tag"])),
      """SELECT * FROM (SELECT t.kb_id, row_number() OVER (PARTITION BY t.kb_id ORDER BY coalesce(c.n, 0) DESC, t.tag_id) AS rank, t.tag_id, coalesce(c.n, 0) AS chunk_count FROM {v_tag} t
      LEFT JOIN (SELECT tag_id, count(*) AS n FROM {v_chunk_tag} GROUP BY tag_id) c ON c.tag_id = t.tag_id) x WHERE rank <= 20""")  # fmt: skip
