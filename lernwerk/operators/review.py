"""Spaced repetition (G): the fold over a learner's attempts, its log, and what is due."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import new_path
from ..sources.views import AS_OF, Registry
from ..streaming.review_stream import sm2_stream

R = Registry()
#: Ease at the start and at least, in tenths.
START, FLOOR = 25, 13
PASS, MASTERED_STREAK, MASTERED_INTERVAL = 0.8, 4, 30
STATE = "struct(false as in_book, 0 as wrong, 0 as reps, 0 as streak, 2.5D as ease, 0 as gap, false as mastered, cast(null as timestamp) as wrong_at, cast(null as timestamp) as seen_at)"


def step() -> str:
    """Transition of the state s by an attempt x, as SQL. Ease keeps two decimals after each step; gaps round half to even."""
    lower, higher = "greatest(1.3D, round(s.ease - 0.2D, 2))", "greatest(1.3D, round(s.ease + 0.1D, 2))"
    gap = f"case s.reps when 0 then 1 when 1 then 6 else cast(bround(s.gap * {higher}) as int) end"
    failed = f"struct(true as in_book, s.wrong + 1 as wrong, 0 as reps, 0 as streak, if(s.in_book, {lower}, 2.5D) as ease, 1 as gap, false as mastered, x.ts as wrong_at, x.ts as seen_at)"
    passed = f"struct(true as in_book, s.wrong as wrong, s.reps + 1 as reps, s.streak + 1 as streak, {higher} as ease, {gap} as gap, s.streak + 1 >= {MASTERED_STREAK} and {gap} >= {MASTERED_INTERVAL} as mastered, s.wrong_at as wrong_at, x.ts as seen_at)"
    return f"if(x.rate < {PASS}D, {failed}, if(s.in_book, {passed}, s))"


def _fold(attempts: DataFrame) -> DataFrame:
    ordered = attempts.groupBy("user_id", "question_id").agg(F.array_sort(F.collect_list(F.struct("ts", "exam_id", "rate"))).alias("xs"))
    return ordered.select("user_id", "question_id", F.expr(f"aggregate(xs, {STATE}, (s, x) -> {step()})").alias("s"))


def sm2_fold(attempts: DataFrame) -> DataFrame:
    """Mistake book after all attempts, per user and question; only pairs that were ever wrong.

    A group holds one learner's attempts at one question, in time order.
    """
    rows = _fold(attempts).filter("s.in_book")
    return rows.selectExpr("user_id", "question_id", "s.wrong as wrong_count", "s.streak as right_streak", "s.ease as ease_factor", "s.gap as interval_days", "s.reps as repetitions",
                           "s.wrong_at as last_wrong_at", "s.seen_at + make_dt_interval(s.gap) as next_review_at", "cast(s.mastered as int) as mastered")


def review_log(attempts: DataFrame) -> DataFrame:
    """One row per successful review of an item in the book, with the interval before and after.

    The fold's state is told by running sums, so no group is held whole. Ease in tenths is a walk that
    a floor holds up: its sum, less the deepest it has been under the floor. A failure starts a run;
    within one, ease rises with each success, so the interval follows from the ease at its start.
    """
    pair = W.partitionBy("user_id", "question_id").orderBy("ts", "exam_id", "rate")
    so_far = pair.rowsBetween(W.unboundedPreceding, W.currentRow)
    failed = F.coalesce(F.col("rate") < PASS, F.lit(False))
    rows = attempts.select("user_id", "question_id", "ts", "exam_id", "rate", failed.alias("_bad"), F.row_number().over(pair).alias("_i"), F.sum(failed.cast("long")).over(so_far).alias("_fails"))
    step = F.when(F.col("_fails") == 0, 0).when(F.col("_bad"), F.when(F.col("_fails") == 1, 0).otherwise(-2)).otherwise(1)
    rows = rows.withColumns({"_walk": START + F.sum(step).over(so_far), "_at": F.max(F.when(F.col("_bad"), F.col("_i"))).over(so_far)})
    rows = rows.withColumn("_ease", F.col("_walk") - F.least(F.lit(0), F.min(F.col("_walk") - FLOOR).over(so_far)))
    rows = rows.filter("_fails > 0 and not _bad").withColumn("_n", F.col("_i") - F.col("_at"))
    gap = lambda n: f"case when {n} = 0 then 1 when {n} = 1 then 1 else aggregate(if({n} < 3, array(), sequence(3, {n})), 6, (g, i) -> cast(bround(g * ((_ease - _n + i) / 10D)) as int)) end"
    return rows.selectExpr("user_id", "question_id", "exam_id", "ts as reviewed_at", "if(rate >= 0.95, 5, 4) as grade", "round(rate, 4) as score_rate", f"{gap('(_n - 1)')} as interval_before", f"{gap('_n')} as interval_after")


def due_today(mistakes: DataFrame, questions: DataFrame, as_of: Column, kb_id: int | None = None, limit: int = 200) -> DataFrame:
    """Due items, oldest first. The limit comes before the check that the question may still be used."""
    due = mistakes.filter((F.col("mastered") == 0) & (F.col("next_review_at") <= as_of))
    due = due if kb_id is None else due.filter(F.col("kb_id") == kb_id)
    due = due.orderBy("next_review_at", "user_id", "question_id").limit(min(200, max(1, limit)))
    due = due.join(questions.filter("status <> 2").select("question_id", "stem", "q_type"), "question_id")
    return due.withColumn("overdue_days", F.greatest(F.lit(0), F.datediff(F.to_date(as_of), F.to_date("next_review_at"))))


def stage() -> Column:
    return (
        F.when(F.col("mastered") == 1, "mastered").when((F.col("repetitions") == 0) & (F.col("wrong_count") >= 3), "stubborn").when(F.col("repetitions") == 0, "new")
        .when(F.col("repetitions") == 1, "first review").when(F.col("interval_days") >= 15, "nearly mastered").otherwise("in review")
    )


def list_mistakes(mistakes: DataFrame, kb_id: int | None = None, mastered: int | None = None, question_tags: DataFrame | None = None, tag_id: int | None = None, page: int = 1, size: int = 20) -> DataFrame:
    """A page of the mistake book with the total and each item's stage; filters come before paging."""
    rows = mistakes if kb_id is None else mistakes.filter(F.col("kb_id") == kb_id)
    rows = rows if mastered is None else rows.filter(F.col("mastered") == mastered)
    if question_tags is not None and tag_id is not None:
        rows = rows.join(question_tags.filter(F.col("tag_id") == tag_id), "question_id", "left_semi")
    total = rows.agg(F.count("*").alias("total"))
    shown = rows.orderBy("next_review_at", "user_id", "question_id").offset((page - 1) * size).limit(size)
    return shown.withColumn("stage", stage()).join(F.broadcast(total))


def compose_review_paper(due: DataFrame, limit: int = 20) -> DataFrame:
    """Items of a review paper, in the order they fell due, with their points and the paper's total."""
    rows = due.orderBy("next_review_at", "user_id", "question_id").limit(min(50, limit))
    rows = rows.withColumns({"sort_order": F.row_number().over(W.orderBy("next_review_at", "user_id", "question_id")), "score": F.when(F.col("q_type") <= 4, 5.0).otherwise(10.0)})
    return rows.select("sort_order", "user_id", "question_id", "score", F.sum("score").over(W.partitionBy()).alias("total_score"), F.first("kb_id").over(W.orderBy("sort_order").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("kb_id"))


def mark_mastered(mistakes: DataFrame, marks: DataFrame, as_of: Column) -> DataFrame:
    """marks(user_id, question_id, mastered): mastered items rest a year, others start anew; the rest is untouched."""
    rows = mistakes.join(marks.select("user_id", "question_id", F.col("mastered").alias("mark")), ["user_id", "question_id"], "left")
    on, off = F.col("mark") == 1, F.col("mark") == 0
    return rows.select(
        "user_id", "question_id", F.coalesce("mark", "mastered").alias("mastered"), F.when(on, 365).when(off, 1).otherwise(F.col("interval_days")).alias("interval_days"),
        F.when(off, 0).otherwise(F.col("repetitions")).alias("repetitions"), F.when(on, as_of + F.expr("interval 365 days")).when(off, as_of).otherwise(F.col("next_review_at")).alias("next_review_at"),
    )


def review_calendar(mistakes: DataFrame, log: DataFrame, as_of: Column, past: int, future: int) -> DataFrame:
    """Items due and reviews done on each day from past to future; the last day's due count is always 0."""
    day = F.to_date(as_of)
    every = mistakes.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(day, past), F.date_add(day, future))).alias("day"))
    due = mistakes.filter((F.col("mastered") == 0) & (F.col("next_review_at") < F.date_add(day, future))).groupBy(F.to_date("next_review_at").alias("day")).agg(F.count("*").alias("due"))
    done = log.groupBy(F.to_date("reviewed_at").alias("day")).agg(F.count("*").alias("reviewed"))
    return every.join(due, "day", "left").join(done, "day", "left").na.fill(0, ["due", "reviewed"])


def due_by_kb(due: DataFrame, shown: int = 8) -> DataFrame:
    """Per knowledge base: the first items, how many are due and how many overdue."""
    order = W.partitionBy("kb_id").orderBy("next_review_at", "user_id", "question_id")
    rows = due.withColumn("n", F.row_number().over(order))
    first = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("n") <= shown, F.struct("n", "question_id")))), lambda x: x["question_id"].cast("string")), ",")
    return rows.groupBy("kb_id").agg(F.count("*").alias("items"), F.count_if(F.col("overdue_days") > 0).alias("overdue"), first.alias("first_items"))


def now() -> Column:
    return F.expr(AS_OF)


def _due(s, limit: int = 200) -> DataFrame:
    return due_today(s["v_mistake"], s["v_question"], now(), limit=limit)


def _text(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in columns})


#: The fold written as a recursion over each pair's numbered attempts.
FOLD = """WITH RECURSIVE xs AS (SELECT *, row_number() OVER (PARTITION BY user_id, question_id ORDER BY ts, exam_id, rate) AS i FROM {v_attempt}),
    f AS (SELECT user_id, question_id, CAST(0 AS BIGINT) AS i, false AS in_book, 0 AS wrong, 0 AS reps, 0 AS streak, CAST(2.5 AS DOUBLE) AS ease, 0 AS gap, 0 AS before, false AS mastered, CAST(NULL AS TIMESTAMP) AS wrong_at, CAST(NULL AS TIMESTAMP) AS seen_at, CAST(NULL AS DOUBLE) AS rate, CAST(NULL AS BIGINT) AS exam_id, false AS logged FROM (SELECT DISTINCT user_id, question_id FROM xs)
    UNION ALL SELECT user_id, question_id, i, in_book OR rate < 0.8, wrong + bad, CASE WHEN bad = 1 THEN 0 WHEN in_book THEN reps + 1 ELSE reps END, CASE WHEN bad = 1 THEN 0 WHEN in_book THEN streak + 1 ELSE streak END,
    CASE WHEN NOT in_book THEN ease WHEN bad = 1 THEN greatest(1.3, round(ease - 0.2, 2)) ELSE higher END, CASE WHEN bad = 1 THEN 1 WHEN in_book THEN longer ELSE gap END, gap,
    CASE WHEN bad = 1 THEN false WHEN in_book THEN streak + 1 >= 4 AND longer >= 30 ELSE mastered END, CASE WHEN bad = 1 THEN ts ELSE wrong_at END, CASE WHEN bad = 1 OR in_book THEN ts ELSE seen_at END, rate, exam_id, in_book AND bad = 0
    FROM (SELECT *, CASE reps WHEN 0 THEN 1 WHEN 1 THEN 6 ELSE CAST(round_even(gap * higher, 0) AS INT) END AS longer FROM (SELECT f.* EXCLUDE (i, rate, exam_id), x.i, x.ts, x.rate, x.exam_id, CASE WHEN x.rate < 0.8 THEN 1 ELSE 0 END AS bad, greatest(1.3, round(f.ease + 0.1, 2)) AS higher FROM f JOIN xs x ON x.user_id = f.user_id AND x.question_id = f.question_id AND x.i = f.i + 1) y) z)"""
R.add("sm2_fold", lambda s: _text(sm2_fold(s["v_attempt"]), "last_wrong_at", "next_review_at"),
      FOLD + """ SELECT user_id, question_id, wrong AS wrong_count, streak AS right_streak, ease AS ease_factor, gap AS interval_days, reps AS repetitions, strftime(wrong_at, '%Y-%m-%d %H:%M:%S') AS last_wrong_at,
      strftime(seen_at + to_days(gap), '%Y-%m-%d %H:%M:%S') AS next_review_at, CAST(mastered AS INT) AS mastered FROM (SELECT *, row_number() OVER (PARTITION BY user_id, question_id ORDER BY i DESC) AS n FROM f) x WHERE n = 1 AND in_book""")  # fmt: skip
R.add("review_log", lambda s: _text(review_log(s["v_attempt"]), "reviewed_at"),
      FOLD + """ SELECT user_id, question_id, exam_id, strftime(seen_at, '%Y-%m-%d %H:%M:%S') AS reviewed_at, CASE WHEN rate >= 0.95 THEN 5 ELSE 4 END AS grade, round(rate, 4) AS score_rate, before AS interval_before, gap AS interval_after FROM f WHERE logged""")
DUE = f"""SELECT m.*, q.stem, q.q_type, greatest(0, datediff('day', CAST(m.next_review_at AS DATE), CAST({AS_OF} AS DATE))) AS overdue_days FROM (SELECT * FROM {{v_mistake}} WHERE mastered = 0 AND next_review_at <= {AS_OF} ORDER BY next_review_at, user_id, question_id LIMIT 200) m
    JOIN {{v_question}} q ON q.question_id = m.question_id AND q.status <> 2"""
R.add("due_today", lambda s: _due(s).select("user_id", "question_id", "kb_id", "stem", "overdue_days"), f"SELECT user_id, question_id, kb_id, stem, CAST(overdue_days AS INT) AS overdue_days FROM ({DUE}) x")
R.add("list_mistakes", lambda s: list_mistakes(s["v_mistake"], kb_id=2, question_tags=None, size=50).select("user_id", "question_id", "stage", "total"),
      """SELECT user_id, question_id, CASE WHEN mastered = 1 THEN 'mastered' WHEN repetitions = 0 AND wrong_count >= 3 THEN 'stubborn' WHEN repetitions = 0 THEN 'new' WHEN repetitions = 1 THEN 'first review' WHEN interval_days >= 15 THEN 'nearly mastered' ELSE 'in review' END AS stage,
      (SELECT count(*) FROM {v_mistake} WHERE kb_id = 2) AS total FROM {v_mistake} WHERE kb_id = 2 ORDER BY next_review_at, user_id, question_id LIMIT 50""")  # fmt: skip
R.add("compose_review_paper", lambda s: compose_review_paper(_due(s)),
      f"""SELECT CAST(n AS INT) AS sort_order, user_id, question_id, CASE WHEN q_type <= 4 THEN 5.0 ELSE 10.0 END AS score, sum(CASE WHEN q_type <= 4 THEN 5.0 ELSE 10.0 END) OVER () AS total_score, first_value(kb_id) OVER (ORDER BY n) AS kb_id
      FROM (SELECT *, row_number() OVER (ORDER BY next_review_at, user_id, question_id) AS n FROM ({DUE}) d) x WHERE n <= 20""")  # fmt: skip
R.add("mark_mastered", lambda s: _text(mark_mastered(s["v_mistake"], s["v_mistake"].filter("question_id % 3 = 0").selectExpr("user_id", "question_id", "cast(user_id % 2 as int) as mastered"), now()), "next_review_at"),
      f"""SELECT user_id, question_id, CASE WHEN question_id % 3 = 0 THEN user_id % 2 ELSE mastered END AS mastered, CASE WHEN question_id % 3 <> 0 THEN interval_days WHEN user_id % 2 = 1 THEN 365 ELSE 1 END AS interval_days,
      CASE WHEN question_id % 3 = 0 AND user_id % 2 = 0 THEN 0 ELSE repetitions END AS repetitions, strftime(CASE WHEN question_id % 3 <> 0 THEN next_review_at WHEN user_id % 2 = 1 THEN {AS_OF} + INTERVAL 365 DAY ELSE {AS_OF} END, '%Y-%m-%d %H:%M:%S') AS next_review_at FROM {{v_mistake}}""")  # fmt: skip
R.add("review_calendar", lambda s: review_calendar(s["v_mistake"], s["v_attempt"].withColumnRenamed("ts", "reviewed_at"), now(), 30, 7).withColumn("day", F.col("day").cast("string")),
      f"""SELECT CAST(d.day AS VARCHAR) AS day, coalesce(due, 0) AS due, coalesce(reviewed, 0) AS reviewed FROM (SELECT CAST(x AS DATE) AS day FROM generate_series(DATE '2001-08-02' - INTERVAL 30 DAY, DATE '2001-08-02' + INTERVAL 7 DAY, INTERVAL 1 DAY) g(x)) d
      LEFT JOIN (SELECT CAST(next_review_at AS DATE) AS day, count(*) AS due FROM {{v_mistake}} WHERE mastered = 0 AND next_review_at < TIMESTAMP '2001-08-09' GROUP BY 1) m ON m.day = d.day LEFT JOIN (SELECT CAST(ts AS DATE) AS day, count(*) AS reviewed FROM {{v_attempt}} GROUP BY 1) a ON a.day = d.day""")  # fmt: skip
R.add("due_by_kb", lambda s: due_by_kb(_due(s)),
      f"""SELECT kb_id, count(*) AS items, count(*) FILTER (WHERE overdue_days > 0) AS overdue, string_agg(CAST(question_id AS VARCHAR), ',' ORDER BY n) FILTER (WHERE n <= 8) AS first_items
      FROM (SELECT *, row_number() OVER (PARTITION BY kb_id ORDER BY next_review_at, user_id, question_id) AS n FROM ({DUE}) d) x GROUP BY kb_id""")  # fmt: skip


def _streamed(s) -> DataFrame:
    """The fold as a stream: half of the attempts arrive as files and are folded, then the others with the same state."""
    spark, rows = s.spark, s["v_attempt"]
    arriving, state, out = (new_path(spark, x) for x in ("attempts", "review-state", "reviews"))
    middle = rows.agg(F.percentile_approx(F.unix_timestamp("ts"), 0.5)).first()[0] or 0
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for step, part in enumerate((F.unix_timestamp("ts") < middle, F.unix_timestamp("ts") >= middle)):
            rows.filter(part).write.mode("append").parquet(arriving)
            updates = sm2_stream(spark.readStream.schema(rows.schema).parquet(arriving))
            write = lambda part, no, step=step: part.withColumn("step", F.lit(step)).write.mode("append").parquet(out)
            updates.writeStream.outputMode("update").option("checkpointLocation", state).foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(provider, before)
    last = F.row_number().over(W.partitionBy("user_id", "question_id").orderBy(F.desc("step")))
    return spark.read.parquet(out).filter("not late").withColumn("_n", last).filter("_n = 1").drop("_n", "step")


R.add("sm2_stream", lambda s: _text(_streamed(s), "last_wrong_at", "next_review_at").select("user_id", "question_id", "wrong_count", "right_streak", "ease_factor", "interval_days", "repetitions", "last_wrong_at", "next_review_at", "mastered"), R.oracles["sm2_fold"])
