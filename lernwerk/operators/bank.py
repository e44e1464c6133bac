"""Question bank (E): materials, question making, validation, duplicates, papers and lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.views import Registry

R = Registry()
# Names of question types and difficulties.
TYPES = {"SINGLE": "SINGLE", "单选": "SINGLE", "MULTI": "MULTI", "多选": "MULTI", "JUDGE": "JUDGE", "判断": "JUDGE", "BLANK": "BLANK", "填空": "BLANK", "TERM": "TERM", "名词解释": "TERM",
         "SHORT": "SHORT", "简答": "SHORT", "ESSAY": "ESSAY", "论述": "ESSAY", "CODE": "CODE", "代码": "CODE", "COMPARE": "COMPARE", "对比": "COMPARE"}
DIFFICULTIES = {"EASY": "EASY", "易": "EASY", "MEDIUM": "MEDIUM", "中": "MEDIUM", "HARD": "HARD", "难": "HARD"}
TYPE_CODES = {"SINGLE": 1, "MULTI": 2, "JUDGE": 3, "BLANK": 4, "TERM": 5, "SHORT": 6, "ESSAY": 7, "CODE": 8, "COMPARE": 9}
WITH_RUBRIC = (5, 6, 7, 9)
#: Sentences whose digest is below this, four in ten, may become false statements.
FALSE_BELOW = "66"


def select_materials(requests: DataFrame, chunks: DataFrame, chunk_tags: DataFrame, documents: DataFrame, limit: int = 400, least: int = 40) -> DataFrame:
    """Chunks for each request(request_id, kb_id, tag_ids) in document order; all of the base if no tag hits."""
    rows = chunks.filter(F.length("content") > least)
    slim, asked = rows.select("chunk_id", "kb_id", "doc_id", "chunk_index"), requests.select("request_id", "kb_id")
    wanted = requests.select("request_id", F.explode("tag_ids").alias("tag_id")).join(chunk_tags.select("tag_id", "chunk_id"), "tag_id").select("request_id", "chunk_id").distinct()
    tagged = wanted.join(slim, "chunk_id").join(asked, ["request_id", "kb_id"])
    # Only requests without a hit need their whole base; of either no more than ``limit`` chunks meet the texts.
    missed = asked.join(tagged.select("request_id").distinct(), "request_id", "left_anti").join(slim, "kb_id")
    order = W.partitionBy("request_id").orderBy("doc_id", "chunk_index", "chunk_id")
    chosen = tagged.unionByName(missed.select(*tagged.columns)).withColumn("seq", F.row_number().over(order)).filter(F.col("seq") <= limit)
    return chosen.select("request_id", "seq", "chunk_id").join(rows, "chunk_id").join(documents.select("doc_id", "file_name"), "doc_id", "left")


def even_sample(rows: DataFrame, group: str, order: str, n: int = 60) -> DataFrame:
    """Of groups over n rows the rows at floor(i * size / n), i from 0 to n - 1."""
    w = W.partitionBy(group)
    rows = rows.withColumns({"_i": F.row_number().over(w.orderBy(order)) - 1, "_n": F.count("*").over(w)})
    # Row k is taken if some i has floor(i * size / n) = k.
    first = F.ceil(F.col("_i") * n / F.col("_n"))
    return rows.filter((F.col("_n") <= n) | (F.floor(first * F.col("_n") / n) == F.col("_i")) & (first < n)).drop("_i", "_n")


def expand_ratio(ratio: Column, count: Column, aliases: dict[str, str], fallback: str) -> Column:
    """Exactly ``count`` labels in the proportions of a map; unknown names count as nothing."""
    table = F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair))
    known = F.filter(F.transform(F.map_entries(ratio), lambda e: F.struct(F.coalesce(table[e["key"]], table[F.upper(e["key"])]).alias("label"), e["value"].cast("double").alias("w"))), lambda e: e["label"].isNotNull() & (e["w"] > 0))
    total = F.aggregate(known, F.lit(0.0), lambda t, e: t + e["w"])
    labels = F.flatten(F.transform(known, lambda e: F.array_repeat(e["label"], F.bround(count * e["w"] / total, 0).cast("int"))))
    pad = F.coalesce(F.try_element_at(F.transform(known, lambda e: e["label"]), F.lit(1)), F.lit(fallback))
    return F.slice(F.concat(labels, F.array_repeat(pad, count)), F.lit(1), count)


def assign_slots(requests: DataFrame, materials: DataFrame, batch: int = 5) -> DataFrame:
    """Materials of every slot of a request(request_id, count): each round of ``batch`` slots takes a stretch with wrap-around."""
    sizes = materials.groupBy("request_id").agg(F.count("*").alias("n"))
    slots = requests.select("request_id", "count", F.explode(F.sequence(F.lit(0), F.floor((F.col("count") - 1) / batch))).alias("round")).join(sizes, "request_id")
    need = F.least(F.lit(batch), F.col("count") - F.col("round") * batch)
    take = F.least(F.col("n"), F.greatest(F.lit(3), F.least(F.col("n"), need + 1)))
    slots = slots.withColumn("take", take).select("request_id", "round", "n", F.explode(F.sequence(F.lit(0), F.col("take").cast("int") - 1)).alias("j"))
    slots = slots.withColumn("seq", ((F.col("round") * batch) % F.col("n") + F.col("j")) % F.col("n") + 1)
    return slots.join(materials.select("request_id", "seq", "chunk_id"), ["request_id", "seq"]).select("request_id", "round", "j", "chunk_id")


def sentence_pool(docs: DataFrame) -> DataFrame:
    """Sentences fit for questions, in order: rows(doc_id, text) -> (doc_id, pos, sentence) (E5)."""
    rows = docs.select("doc_id", F.posexplode(F.split("text", r"(?<=[。！？!?；;.\n])")).alias("pos", "raw")).withColumn("sentence", X.squeeze(F.col("raw")))
    han, braces = X.count_of(F.col("sentence"), X.HAN), X.count_of(F.col("sentence"), "[`{}]")
    ascii_only = ~F.col("sentence").rlike(r"[^\x00-\x7f]")
    fit = F.length("sentence").between(12, 220) & ((han >= 8) | (ascii_only & (braces <= 2)))
    return rows.filter(fit).select("doc_id", "pos", "sentence")


def extract_terms(rows: DataFrame, column: str = "text", limit: int = 8) -> DataFrame:
    return rows.withColumn("terms", X.terms(F.col(column), limit))


def shorten(text: Column, limit: int) -> Column:
    text = F.regexp_replace(X.squeeze(text), r"^[`*#> \-]+|[`*#> \-]+$", "")
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("…"))).otherwise(text)


def make_blank_items(pool: DataFrame) -> DataFrame:
    """The first term of a sentence becomes the gap."""
    term = F.element_at(F.concat(X.terms(F.col("sentence"), 3), F.array(F.lit(""))), 1)
    rows = pool.withColumn("_t", term)
    return rows.select("doc_id", "pos", F.concat(F.lit("填空："), X.replace_first(F.col("sentence"), F.col("_t"), F.lit("______"))).alias("stem"), F.when(F.col("_t") != "", F.col("_t")).otherwise(F.substring("sentence", 1, 20)).alias("answer"))


def make_judge_items(pool: DataFrame) -> DataFrame:
    """Four in ten sentences have their first Latin term replaced by the second and are false."""
    latin = F.filter(X.terms(F.col("sentence"), 6), lambda t: ~t.rlike(r"[^\x00-\x7f]") & (F.length(t) >= 3))
    rows = pool.withColumn("_l", latin)
    swapped = X.replace_first(F.col("sentence"), F.try_element_at("_l", F.lit(1)), F.try_element_at("_l", F.lit(2)))
    wrong = (F.md5("sentence") < FALSE_BELOW) & (F.size("_l") >= 2) & (swapped != F.col("sentence"))
    return rows.select("doc_id", "pos", F.concat(F.lit("判断："), F.when(wrong, swapped).otherwise(F.col("sentence"))).alias("stem"), F.when(wrong, "错误").otherwise("正确").alias("answer"))


def _with_distractors(pool: DataFrame, n: int, cut: int) -> DataFrame:
    """Each sentence with the next n of its document's ring, ordered by hash."""
    order, every = W.partitionBy("doc_id").orderBy(F.md5("sentence"), "pos"), W.partitionBy("doc_id")
    rows = pool.withColumns({"_i": F.row_number().over(order) - 1, "_n": F.count("*").over(every)})
    ahead = pool.select("doc_id", "sentence", (F.row_number().over(order) - 1).alias("_j"))
    wanted = rows.select("doc_id", "pos", "_i", "_n", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("k")).withColumn("_j", ((F.col("_i") + F.col("k")) % F.col("_n")).cast("int")).filter(F.col("_j") != F.col("_i"))
    found = wanted.join(ahead, ["doc_id", "_j"]).groupBy("doc_id", "pos").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("k", "sentence"))), lambda x: shorten(x["sentence"], cut))).alias("wrong"))
    return rows.drop("_i", "_n").join(found, ["doc_id", "pos"], "left").withColumn("wrong", F.array_remove(F.coalesce("wrong", F.array().cast("array<string>")), shorten(F.col("sentence"), cut)))


def _lettered(right: Column, wrong: Column) -> Column:
    """Options in the order of a hash, with letters."""
    both = F.concat(F.transform(wrong, lambda x: F.struct(F.md5(x).alias("h"), x.alias("content"), F.lit(0).alias("is_correct"))), F.transform(right, lambda x: F.struct(F.md5(x).alias("h"), x.alias("content"), F.lit(1).alias("is_correct"))))
    return F.transform(F.array_sort(both), lambda x, i: F.struct(F.char(i + 65).alias("option_key"), x["content"].alias("content"), x["is_correct"].alias("is_correct")))


def _choice(rows: DataFrame, right: Column, n_wrong: int) -> DataFrame:
    filler = F.transform(F.sequence(F.lit(1), F.lit(n_wrong)), lambda i: F.concat(F.lit("以上说法均不成立（"), i.cast("string"), F.lit("）")))
    rows = rows.withColumn("options", _lettered(right, F.slice(F.concat("wrong", filler), 1, n_wrong)))
    answer = F.array_join(F.transform(F.filter("options", lambda o: o["is_correct"] == 1), lambda o: o["option_key"]), "")
    return rows.select("doc_id", "pos", F.concat(F.lit("下列说法与原文一致的是？（"), F.element_at(F.concat(X.terms(F.col("sentence"), 1), F.array(F.substring("sentence", 1, 12))), 1), F.lit("）")).alias("stem"), "options", answer.alias("answer"))


def make_single_items(pool: DataFrame) -> DataFrame:
    """The sentence among three distractors from its document, in the order of a hash."""
    return _choice(_with_distractors(pool, 3, 90), F.array(shorten(F.col("sentence"), 90)), 3)


def make_multi_items(pool: DataFrame) -> DataFrame:
    """The sentence, a statement on its second term if it has one, and two distractors."""
    second = F.try_element_at(X.terms(F.col("sentence"), 2), F.lit(2))
    right = F.array_compact(F.array(shorten(F.col("sentence"), 80), F.when(second.isNotNull(), F.concat(F.lit("原文提到了「"), second, F.lit("」")))))
    return _choice(_with_distractors(pool, 2, 80), right, 2)


def make_short_items(pool: DataFrame) -> DataFrame:
    """Long sentences give up to three points of 10 / n, the last with what is left; others one point."""
    parts = F.filter(F.transform(F.split("sentence", "[，,；;]"), lambda p: F.trim(p)), lambda p: F.length(p) > 6)
    rows = pool.withColumn("_p", F.when(F.length("sentence") > 70, F.slice(parts, 1, 3)).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("_p", F.when(F.size("_p") > 0, F.col("_p")).otherwise(F.array("sentence")))
    n = F.size("_p")
    each = F.bround(F.lit(10.0) / n, 1)
    rubric = F.transform("_p", lambda p, i: F.struct(F.substring(p, 1, 60).alias("point"), F.when(i == n - 1, F.bround(F.lit(10.0) - each * (n - 1), 1)).otherwise(each).alias("score")))
    return rows.select("doc_id", "pos", F.element_at(F.concat(X.terms(F.col("sentence"), 1), F.array(F.substring("sentence", 1, 12))), 1).alias("topic"), F.col("sentence").alias("answer"), rubric.alias("rubric"))


def validate_questions(questions: DataFrame) -> DataFrame:
    """Every question with its reason for rejection (null if valid), clipped and with defaults.

    questions(question_id, q_type, difficulty, stem, answer, analysis, options array<struct<option_key, content>>,
    rubric array<struct<point, score>>, full_score).
    """
    options = F.filter(F.coalesce("options", F.expr("cast(array() as array<struct<option_key: string, content: string>>)")), lambda o: (F.trim(o["option_key"]) != "") & (F.trim(o["content"]) != ""))
    options = F.transform(options, lambda o: F.struct(F.substring(F.upper(F.trim(o["option_key"])), 1, 2).alias("option_key"), F.substring(F.trim(o["content"]), 1, 1000).alias("content")))
    rubric = F.filter("rubric", lambda p: (F.trim(p["point"]) != "") & (p["score"] > 0))
    rows = questions.withColumns({"options": options, "rubric": rubric})
    letters = X.all_matches(F.upper("answer"), "[A-Z]")
    outside = F.size(F.array_except(letters, F.transform("options", lambda o: o["option_key"]))) > 0
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    choice = F.col("q_type").isin(1, 2)
    reason = (
        F.when(~F.coalesce(F.col("q_type").between(1, 9), F.lit(False)), "unknown type").when(blank("stem") | blank("answer"), "blank stem or answer").when(choice & (F.size("options") < 3), "too few options")
        .when(choice & ((F.size(letters) == 0) | outside), "answer is no option").when(F.col("q_type").isin(*WITH_RUBRIC) & (F.coalesce(F.size("rubric"), F.lit(0)) < 1), "no rubric")
    )
    clipped = {"stem": F.substring(F.trim("stem"), 1, 4000), "answer": F.substring(F.trim("answer"), 1, 6000), "analysis": F.substring("analysis", 1, 4000), "difficulty": F.greatest(F.lit(1), F.least(F.lit(3), F.coalesce("difficulty", F.lit(2))))}
    return rows.withColumns({"reason": reason, "full_score": F.coalesce("full_score", F.when(F.col("q_type") <= 4, 5.0).otherwise(10.0)), **clipped})


def self_check(questions: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Structural problems, quality 0.9 without and 0.4 with any, and whether the question is kept."""
    sums = F.aggregate(F.coalesce("rubric", F.expr("cast(array() as array<struct<point: string, score: double>>)")), F.lit(0.0), lambda t, p: t + p["score"])
    choice, subjective = F.col("q_type").isin(1, 2), F.col("q_type").isin(*WITH_RUBRIC)
    problems = F.array_compact(F.array(
        F.when(F.trim(F.coalesce("stem", F.lit(""))) == "", "no stem"), F.when(choice & (F.coalesce(F.size("options"), F.lit(0)) < 4), "under four options"), F.when(choice & (F.trim(F.coalesce("answer", F.lit(""))) == ""), "no answer"),
        F.when(subjective & (F.coalesce(F.size("rubric"), F.lit(0)) < 1), "no rubric"), F.when(subjective & (F.abs(sums - F.col("full_score")) > 0.01), "points don't add up"),
    ))
    rows = questions.withColumn("problems", problems).withColumn("quality_score", F.when(F.size("problems") == 0, 0.9).otherwise(0.4))
    return rows.withColumn("kept", (F.size("problems") == 0) & (F.col("quality_score") >= threshold))


def dedup_literal(new: DataFrame, existing: DataFrame) -> DataFrame:
    """rows(kb_id, pos, stem, ...) whose bare stem is new; of equal ones the last stays, at the first's place."""
    keyed = new.withColumn("_k", X.bare(F.col("stem")))
    known = existing.select("kb_id", X.bare(F.col("stem")).alias("_k")).distinct()
    fresh = keyed.join(known, ["kb_id", "_k"], "left_anti")
    best = fresh.groupBy("kb_id", "_k").agg(F.max_by(F.struct(*[c for c in new.columns if c not in ("kb_id", "pos")]), "pos").alias("r"), F.min("pos").alias("pos"))
    return best.select("kb_id", "pos", "r.*")


def inherit_tags(questions: DataFrame, question_tags: DataFrame, chunk_tags: DataFrame, closure: DataFrame, limit: int = 12) -> DataFrame:
    """Own tags, then those of source chunks, each followed by its ancestors; first seen first, at most 12.

    questions(question_id, source_chunk_ids); question_tags(question_id, tag_id); closure(tag_id, ancestor_id, distance).
    A tag that isn't among the first 12 of its own list can't be among the first 12 of a question, so
    lists are cut to them before questions meet them; only chunks that are a source have one.
    """
    own = first_tags(question_tags, closure, "question_id", limit).select("question_id", F.lit(-1).alias("src"), "tag_id", "at")
    sources = questions.select("question_id", F.posexplode(F.slice("source_chunk_ids", 1, 6)).alias("src", "chunk_id"))
    named = chunk_tags.join(sources.select("chunk_id").distinct(), "chunk_id", "left_semi")
    given = sources.join(first_tags(named, closure, "chunk_id", limit), "chunk_id").select("question_id", "src", "tag_id", "at")
    first = own.unionByName(given).groupBy("question_id", "tag_id").agg(F.min(F.struct("src", "at")).alias("at"))
    order = W.partitionBy("question_id").orderBy("at", "tag_id")
    return first.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).select("question_id", "rank", "tag_id")


def first_tags(links: DataFrame, closure: DataFrame, key: str, limit: int) -> DataFrame:
    """(key, tag_id, at): the first ``limit`` tags of links(key, tag_id) and their ancestors; ``at`` is the tag that brings one and the distance to it."""
    nth = lambda *order: F.row_number().over(W.partitionBy(key).orderBy(*order))
    bases = links.select(key, F.col("tag_id").cast("long").alias("base")).distinct().withColumn("_n", nth("base")).filter(F.col("_n") <= limit)  # each brings itself
    direct = bases.select(key, "base", F.col("base").alias("tag_id"), F.lit(0).alias("distance"))
    upward = direct.drop("tag_id", "distance").join(closure.select(F.col("tag_id").alias("base"), F.col("ancestor_id").alias("tag_id"), "distance"), "base").select(*direct.columns)
    rows = direct.unionByName(upward).groupBy(key, "tag_id").agg(F.min(F.struct("base", "distance")).alias("at"))
    return rows.withColumn("_n", nth("at", "tag_id")).filter(F.col("_n") <= limit).drop("_n")


def explode_options(questions: DataFrame) -> DataFrame:
    """Option rows of questions(question_id, answer, options)."""
    rows = questions.select("question_id", X.all_matches(F.upper("answer"), "[A-Z]").alias("_a"), F.posexplode("options").alias("sort_order", "o"))
    return rows.select("question_id", "o.option_key", "o.content", F.array_contains("_a", F.col("o.option_key")).cast("int").alias("is_correct"), "sort_order")


def generation_funnel(batches: DataFrame, staged: DataFrame) -> DataFrame:
    """Per batch how many questions were asked for, made, dropped by which step, and saved: batches(batch, requested), rows(batch, stage)."""
    count = lambda stage: F.count_if(F.col("stage") == stage)
    made = staged.groupBy("batch").agg(F.count("*").alias("generated"), count("validate").alias("dropped_validate"), count("check").alias("dropped_check"), count("dedup").alias("dropped_dedup"), count("saved").alias("saved"))
    return batches.select("batch", "requested").join(made, "batch", "left").na.fill(0, made.columns[1:])


def paper_totals(papers: DataFrame, items: DataFrame, questions: DataFrame) -> DataFrame:
    """Items, points, drafts and status of every paper (any draft: review, else ready; failed if nothing was saved)."""
    rows = items.join(questions.select("question_id", "q_type", "status"), "question_id")
    rows = rows.groupBy("paper_id").agg(F.count("*").alias("total_count"), F.sum(F.when(F.col("q_type") <= 4, 5.0).otherwise(10.0)).alias("total_score"), F.count_if(F.col("status") == 0).alias("drafts"), F.count_if(F.col("status") == 1).alias("published"))
    rows = papers.select("paper_id").join(rows, "paper_id", "left").na.fill(0)
    return rows.withColumn("status", F.when(F.col("total_count") == 0, "failed").when(F.col("drafts") > 0, "review").otherwise("ready"))


def search_questions(questions: DataFrame, kb_id: int | None = None, status: int | None = None, q_type: int | None = None, keyword: str | None = None, question_tags: DataFrame | None = None, tag_id: int | None = None, page: int = 1, size: int = 20, difficulty: int | None = None) -> DataFrame:
    """A page of the newest questions that meet all conditions, with the total; case and accents don't count in keywords."""
    rows = questions
    for column, value in (("kb_id", kb_id), ("status", status), ("q_type", q_type), ("difficulty", difficulty)):
        rows = rows if value is None else rows.filter(F.col(column) == value)
    if keyword:
        rows = rows.filter(F.contains(F.collate("stem", "UNICODE_CI_AI"), F.collate(F.lit(keyword), "UNICODE_CI_AI")))
    if question_tags is not None and tag_id is not None:
        rows = rows.join(question_tags.filter(F.col("tag_id") == tag_id), "question_id", "left_semi")
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(F.desc("question_id")).offset((page - 1) * size).limit(size).join(F.broadcast(total))


def enrich_questions(questions: DataFrame, options: DataFrame, tag_briefs: DataFrame) -> DataFrame:
    """Questions with their options in order and their tags as text: tag_briefs(question_id, tags)."""
    listed = F.array_sort(F.collect_list(F.struct("sort_order", "option_key", "content", "is_correct")))
    grouped = options.groupBy("question_id").agg(listed.alias("options"))
    return questions.join(grouped, "question_id", "left").join(tag_briefs, "question_id", "left")


def approve_questions(questions: DataFrame, chosen: DataFrame) -> DataFrame:
    """Drafts among chosen(question_id) become published; everything else stays."""
    marked = chosen.select("question_id").distinct().withColumn("_m", F.lit(True))
    rows = questions.join(marked, "question_id", "left").withColumn("approved", F.coalesce(F.col("_m") & (F.col("status") == 0), F.lit(False)))
    return rows.withColumn("status", F.when(F.col("approved"), 1).otherwise(F.col("status"))).drop("_m")


def drop_paper_drafts(questions: DataFrame, items: DataFrame, papers: DataFrame, *parts: DataFrame) -> list[DataFrame]:
    """Questions without the drafts of the given papers(paper_id), then options, tags or other parts(question_id, ...) without theirs."""
    gone = questions.filter("status = 0").join(items.join(papers, "paper_id", "left_semi"), "question_id", "left_semi").select("question_id")
    return [rows.join(gone, "question_id", "left_anti") for rows in (questions, *parts)]


def list_rows(rows: DataFrame, name: str, keyword: str | None = None, kb_id: int | None = None, order: str = "doc_id", page: int = 1, size: int = 20) -> DataFrame:
    """A page of documents or knowledge bases, newest first, with the total."""
    rows = rows if kb_id is None else rows.filter(F.col("kb_id") == kb_id)
    rows = rows if not keyword else rows.filter(F.contains(F.collate(name, "UNICODE_CI_AI"), F.collate(F.lit(keyword), "UNICODE_CI_AI")))
    return rows.orderBy(F.desc(order)).offset((page - 1) * size).limit(size).join(F.broadcast(rows.agg(F.count("*").alias("total"))))


REQUESTS = "SELECT kb_id AS request_id, kb_id, array(100000 + kb_id, 100003 + kb_id * 7) AS tag_ids FROM {v_kb}"


def _materials(s) -> DataFrame:
    return select_materials(s.sql(REQUESTS), s["v_chunk"], s["v_chunk_tag"], s["v_doc"])


def _pool(s) -> DataFrame:
    return sentence_pool(s["v_note"])


def _option_text(items: DataFrame) -> DataFrame:
    shown = F.transform("options", lambda o: F.concat(o["option_key"], F.lit("."), o["content"], F.when(o["is_correct"] == 1, "*").otherwise("")))
    return items.select("doc_id", "pos", "stem", "answer", F.array_join(shown, "|").alias("options"))


def terms_sql(c: str, n: int) -> str:
    stop = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
    pattern = X.TERM.replace("一-鿿", r"\x{4e00}-\x{9fff}")
    return f"(list_filter(regexp_extract_all({c}, '{pattern}'), lambda x, i: list_position(regexp_extract_all({c}, '{pattern}'), x) = i AND x NOT IN ({stop})))[1:{n}]"


def shorten_sql(c: str, n: int) -> str:
    bare = f"regexp_replace(trim(regexp_replace({c}, '\\s+', ' ', 'g')), '^[`*#> \\-]+|[`*#> \\-]+$', '', 'g')"
    return f"CASE WHEN length({bare}) > {n} THEN concat(substring({bare}, 1, {n}), '…') ELSE {bare} END"


def first_replaced_sql(text: str, old: str, new: str) -> str:
    return f"CASE WHEN length({old}) > 0 AND strpos({text}, {old}) > 0 THEN concat(substring({text}, 1, strpos({text}, {old}) - 1), {new}, substring({text}, strpos({text}, {old}) + length({old}))) ELSE {text} END"


def choice_sql(n: int, cut: int, right: str) -> str:
    """Each sentence with the next n of its ring; ``right`` lists the right contents. Columns as in ``_option_text``."""
    return f"""{POOL}, ring AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY md5(sentence), pos) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n, {shorten_sql("sentence", cut)} AS own, {terms_sql("sentence", 2)} AS two FROM pool),
    near AS (SELECT a.doc_id, a.pos, b.own AS content, min(k.k) AS k FROM ring a CROSS JOIN range(1, {n + 1}) k(k) JOIN ring b ON b.doc_id = a.doc_id AND b.i = (a.i + k.k) % a.n AND b.i <> a.i WHERE b.own <> a.own GROUP BY ALL),
    wrong AS (SELECT doc_id, pos, list(content ORDER BY k) AS w FROM near GROUP BY doc_id, pos),
    every AS (SELECT r.doc_id, r.pos, r.sentence, r.two, unnest(list_concat(list_transform(list_concat(coalesce(w, CAST([] AS VARCHAR[])), [{", ".join(f"'以上说法均不成立（{i}）'" for i in range(1, n + 1))}])[1:{n}], lambda x: {{'content': x, 'right': 0}}), list_transform({right}, lambda x: {{'content': x, 'right': 1}}))) AS o FROM ring r LEFT JOIN wrong v ON v.doc_id = r.doc_id AND v.pos = r.pos),
    lettered AS (SELECT *, chr(CAST(64 + row_number() OVER (PARTITION BY doc_id, pos ORDER BY md5(o.content), o.content, o.right) AS INT)) AS letter FROM every)
    SELECT doc_id, pos, concat('下列说法与原文一致的是？（', coalesce(any_value(two)[1], substring(any_value(sentence), 1, 12)), '）') AS stem, string_agg(letter, '' ORDER BY letter) FILTER (WHERE o.right = 1) AS answer, string_agg(concat(letter, '.', o.content, CASE WHEN o.right = 1 THEN '*' ELSE '' END), '|' ORDER BY letter) AS options FROM lettered GROUP BY doc_id, pos"""


POOL = r"""WITH cut AS (SELECT doc_id, i - 1 AS pos, trim(regexp_replace(ps[i], '\s+', ' ', 'g')) AS sentence FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT doc_id, string_split(regexp_replace(text, '([。！？!?；;.\n])', concat('\1', chr(1)), 'g'), chr(1)) AS ps FROM {v_note}) a) b),
    pool AS (SELECT * FROM cut WHERE length(sentence) BETWEEN 12 AND 220 AND (length(sentence) - length(regexp_replace(sentence, '[\x{4e00}-\x{9fff}]', '', 'g')) >= 8 OR NOT regexp_matches(sentence, '[^\x00-\x7f]') AND length(sentence) - length(regexp_replace(sentence, '[`{}]', '', 'g')) <= 2))"""


MATERIALS = """WITH base AS (SELECT * FROM {v_chunk} WHERE length(content) > 40), hit AS (SELECT DISTINCT r.kb_id AS request_id, c.chunk_id FROM {v_kb} r JOIN {v_chunk_tag} c ON c.tag_id IN (100000 + r.kb_id, 100003 + r.kb_id * 7)),
    tagged AS (SELECT h.request_id, b.* FROM hit h JOIN base b ON b.chunk_id = h.chunk_id AND b.kb_id = h.request_id), every AS (SELECT * FROM tagged UNION ALL SELECT kb_id, * FROM base WHERE kb_id NOT IN (SELECT request_id FROM tagged)),
    material AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY doc_id, chunk_index, chunk_id) AS seq FROM every) x WHERE seq <= 400)"""
R.add("select_materials", lambda s: _materials(s).select("request_id", "seq", "chunk_id"), MATERIALS + " SELECT request_id, seq, chunk_id FROM material")
R.add("even_sample", lambda s: even_sample(_materials(s).select("request_id", "seq", "chunk_id"), "request_id", "seq"),
      MATERIALS + ", sized AS (SELECT *, count(*) OVER (PARTITION BY request_id) AS n FROM material) SELECT request_id, seq, chunk_id FROM sized WHERE n <= 60 OR seq - 1 IN (SELECT CAST(floor(i * n / 60) AS BIGINT) FROM range(0, 60) r(i))")
R.add("expand_ratio", lambda s: s["v_question"].select("question_id", F.array_join(expand_ratio(F.create_map(F.lit("单选"), F.col("q_type"), F.lit("JUDGE"), F.col("difficulty"), F.lit("none"), F.lit(5)), F.lit(10), TYPES, "SHORT"), ",").alias("labels")),
      """SELECT question_id, array_to_string((list_concat(list_concat(list_transform(range(0, CAST(round_even(10.0 * q_type / (q_type + difficulty), 0) AS BIGINT)), lambda i: 'SINGLE'), list_transform(range(0, CAST(round_even(10.0 * difficulty / (q_type + difficulty), 0) AS BIGINT)), lambda i: 'JUDGE')), list_transform(range(0, 10), lambda i: 'SINGLE')))[1:10], ',') AS labels FROM {v_question}""")  # fmt: skip
R.add("assign_slot_materials", lambda s: assign_slots(s.sql(REQUESTS).withColumn("count", F.lit(12)), _materials(s)),
      MATERIALS + """, sized AS (SELECT request_id, count(*) AS n FROM material GROUP BY 1), slots AS (SELECT request_id, r.i AS round, j.j AS j, (((r.i * 5) % n) + j.j) % n + 1 AS seq FROM sized CROSS JOIN range(0, 3) r(i) CROSS JOIN range(0, 6) j(j) WHERE j.j < least(n, greatest(3, least(n, least(5, 12 - r.i * 5) + 1))))
      SELECT s.request_id, s.round, s.j, m.chunk_id FROM slots s JOIN material m ON m.request_id = s.request_id AND m.seq = s.seq""")  # fmt: skip
R.add("sentence_pool", _pool, POOL + " SELECT doc_id, pos, sentence FROM pool")
R.add("extract_terms", lambda s: extract_terms(s["v_question"], "stem", 8).select("question_id", F.array_join("terms", ",").alias("terms")),
      r"""SELECT question_id, array_to_string(list_transform(list_filter(list_zip(t, range(1, len(t) + 1)), lambda z: list_position(t, z[1]) = z[2]), lambda z: z[1])[1:8], ',') AS terms FROM (SELECT question_id, regexp_extract_all(stem, '[A-Za-z][A-Za-z0-9+#.\-]{1,17}|[\x{4e00}-\x{9fff}]{2,10}') AS t FROM {v_question}) x""")  # fmt: skip
R.add("make_blank_items", lambda s: make_blank_items(_pool(s)),
      f"{POOL}, t AS (SELECT *, coalesce({terms_sql('sentence', 3)}[1], '') AS t FROM pool) SELECT doc_id, pos, concat('填空：', {first_replaced_sql('sentence', 't', repr('______'))}) AS stem, CASE WHEN t <> '' THEN t ELSE substring(sentence, 1, 20) END AS answer FROM t")
R.add("make_judge_items", lambda s: make_judge_items(_pool(s)),
      f"""{POOL}, t AS (SELECT *, list_filter({terms_sql("sentence", 6)}, lambda x: NOT regexp_matches(x, '[^\\x00-\\x7f]') AND length(x) >= 3) AS t FROM pool), w AS (SELECT *, {first_replaced_sql("sentence", "t[1]", "t[2]")} AS swapped FROM t), f AS (SELECT *, coalesce(md5(sentence) < '{FALSE_BELOW}' AND len(t) >= 2 AND swapped <> sentence, false) AS wrong FROM w)
      SELECT doc_id, pos, concat('判断：', CASE WHEN wrong THEN swapped ELSE sentence END) AS stem, CASE WHEN wrong THEN '错误' ELSE '正确' END AS answer FROM f""")  # fmt: skip
R.add("make_single_items", lambda s: _option_text(make_single_items(_pool(s))), choice_sql(3, 90, f"[{shorten_sql('r.sentence', 90)}]"))
R.add("make_multi_items", lambda s: _option_text(make_multi_items(_pool(s))), choice_sql(2, 80, f"CASE WHEN r.two[2] IS NULL THEN [{shorten_sql('r.sentence', 80)}] ELSE [{shorten_sql('r.sentence', 80)}, concat('原文提到了「', r.two[2], '」')] END"))
R.add("make_short_items", lambda s: make_short_items(_pool(s)).select("doc_id", "pos", "topic", "answer", F.array_join(F.transform("rubric", lambda p: F.concat(p["point"], F.lit("="), p["score"].cast("string"))), "|").alias("rubric")),
      f"""{POOL}, t AS (SELECT *, coalesce({terms_sql("sentence", 1)}[1], substring(sentence, 1, 12)) AS topic, CASE WHEN length(sentence) > 70 THEN list_filter(list_transform(regexp_split_to_array(sentence, '[，,；;]'), lambda x: trim(x)), lambda x: length(x) > 6)[1:3] ELSE [] END AS p0 FROM pool), p AS (SELECT *, CASE WHEN len(p0) > 0 THEN p0 ELSE [sentence] END AS p FROM t),
      r AS (SELECT *, len(p) AS n, round_even(10.0::DOUBLE / len(p), 1) AS each FROM p) SELECT doc_id, pos, topic, sentence AS answer, array_to_string(list_transform(p, lambda x, i: concat(substring(x, 1, 60), '=', CAST(CASE WHEN i = n THEN round_even(10.0::DOUBLE - each * (n - 1), 1) ELSE each END AS VARCHAR))), '|') AS rubric FROM r""")  # fmt: skip
QUESTIONS = """SELECT question_id, kb_id, CASE WHEN question_id % 50 = 0 THEN 12 ELSE q_type END AS q_type, CASE WHEN question_id % 4 = 0 THEN NULL ELSE difficulty + question_id % 3 END AS difficulty, CASE WHEN question_id % 17 = 0 THEN ' ' ELSE stem END AS stem,
    CASE WHEN q_type IN (1, 2) THEN CASE WHEN question_id % 11 = 0 THEN 'AX' ELSE 'AB' END ELSE answer END AS answer, analysis, question_id % 6 AS n_options, CASE WHEN question_id % 5 = 0 THEN 0 ELSE 1 END AS n_points FROM {v_question}"""


def _unchecked(s) -> DataFrame:
    rows = s.sql(QUESTIONS)
    return rows.withColumns({"options": F.expr("transform(slice(array('A','B','C','D','E'), 1, cast(n_options as int)), k -> struct(k as option_key, concat(stem, k) as content))"), "rubric": F.expr("transform(slice(array(1), 1, n_points), k -> struct(stem as point, if(question_id % 7 = 0, 8D, 10D) as score))"), "full_score": F.expr("cast(null as double)")})


OPTIONS_OK = "CASE WHEN n_options >= 1 THEN CAST(n_options AS BIGINT) ELSE 0 END"
REASON = f"""CASE WHEN q_type > 9 THEN 'unknown type' WHEN trim(stem) = '' THEN 'blank stem or answer' WHEN q_type IN (1, 2) AND {OPTIONS_OK} < 3 THEN 'too few options' WHEN q_type IN (1, 2) AND answer = 'AX' THEN 'answer is no option'
    WHEN q_type IN (5, 6, 7, 9) AND n_points = 0 THEN 'no rubric' END"""
R.add("validate_questions", lambda s: validate_questions(_unchecked(s)).select("question_id", "reason", "difficulty", "full_score"),
      f"SELECT question_id, {REASON} AS reason, greatest(1, least(3, coalesce(difficulty, 2))) AS difficulty, CASE WHEN q_type <= 4 THEN 5.0 ELSE 10.0 END AS full_score FROM ({QUESTIONS}) q")
R.add("self_check_structure", lambda s: self_check(validate_questions(_unchecked(s)).filter("reason is null")).select("question_id", F.array_join("problems", ",").alias("problems"), "quality_score", "kept"),
      f"""SELECT question_id, concat_ws(',', CASE WHEN q_type IN (1, 2) AND n_options < 4 THEN 'under four options' END, CASE WHEN q_type IN (5, 6, 7, 9) AND question_id % 7 = 0 THEN 'points don''t add up' END) AS problems,
      CASE WHEN q_type IN (1, 2) AND n_options < 4 OR q_type IN (5, 6, 7, 9) AND question_id % 7 = 0 THEN 0.4 ELSE 0.9 END AS quality_score, NOT (q_type IN (1, 2) AND n_options < 4 OR q_type IN (5, 6, 7, 9) AND question_id % 7 = 0) AS kept FROM ({QUESTIONS}) q WHERE {REASON} IS NULL""")  # fmt: skip
R.add("dedup_literal", lambda s: dedup_literal(s["v_question"].selectExpr("kb_id", "question_id as pos", "concat(upper(split_part(stem, ' ', 1)), '!') as stem", "question_id"), s["v_question"].filter("question_id % 40 = 0").selectExpr("kb_id", "split_part(stem, ' ', 1) as stem")).select("kb_id", "pos", "stem", "question_id"),
      """WITH k AS (SELECT kb_id, question_id, concat(upper(split_part(stem, ' ', 1)), '!') AS stem, lower(split_part(stem, ' ', 1)) AS key FROM {v_question}) SELECT kb_id, min(question_id) AS pos, max_by(stem, question_id) AS stem, max(question_id) AS question_id FROM k
      WHERE (kb_id, key) NOT IN (SELECT (kb_id, key) FROM k WHERE question_id % 40 = 0) GROUP BY kb_id, key""")  # fmt: skip
CLOSURE = "SELECT tag_id, parent_id AS ancestor_id, 1 AS distance FROM {v_tag} WHERE parent_id <> 0 UNION ALL SELECT t.tag_id, p.parent_id, 2 FROM {v_tag} t JOIN {v_tag} p ON p.tag_id = t.parent_id WHERE p.parent_id <> 0"
FROM_CHUNKS = "SELECT question_id, array(question_id % 200, question_id % 90) AS source_chunk_ids FROM {v_question}"
R.add("inherit_tags", lambda s: inherit_tags(s.sql(FROM_CHUNKS), s["v_question_tag"], s["v_chunk_tag"], s.sql(CLOSURE)),
      f"""WITH direct AS (SELECT question_id, -1 AS src, tag_id FROM {{v_question_tag}} UNION ALL SELECT q.question_id, f.i, c.tag_id FROM {{v_question}} q CROSS JOIN range(0, 2) f(i) JOIN {{v_chunk_tag}} c ON c.chunk_id = CASE f.i WHEN 0 THEN q.question_id % 200 ELSE q.question_id % 90 END),
      every AS (SELECT question_id, src, tag_id AS base, tag_id, 0 AS distance FROM direct UNION ALL SELECT d.question_id, d.src, d.tag_id, c.ancestor_id, c.distance FROM direct d JOIN ({CLOSURE}) c ON c.tag_id = d.tag_id),
      firsts AS (SELECT question_id, tag_id, min((src, base, distance)) AS place FROM every GROUP BY 1, 2) SELECT question_id, rank, tag_id FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY place, tag_id) AS rank FROM firsts) x WHERE rank <= 12""")  # fmt: skip
R.add("explode_options", lambda s: explode_options(_unchecked(s)).select("question_id", "option_key", "content", "is_correct"),
      f"SELECT question_id, k.k AS option_key, concat(stem, k.k) AS content, CAST(regexp_matches(upper(answer), k.k) AS INT) AS is_correct FROM ({QUESTIONS}) q JOIN (SELECT chr(CAST(65 + i AS INT)) AS k, i FROM range(0, 5) r(i)) k ON k.i < q.n_options")
#: What was asked for by each base; one base has made nothing.
BATCHES = "SELECT kb_id AS batch, 100 + 10 * kb_id AS requested FROM {v_kb} UNION ALL SELECT CAST(99 AS BIGINT), CAST(5 AS BIGINT)"
R.add("generation_funnel", lambda s: generation_funnel(s.sql(BATCHES), self_check(validate_questions(_unchecked(s))).selectExpr("kb_id as batch", "case when reason is not null then 'validate' when not kept then 'check' when question_id % 9 = 0 then 'dedup' else 'saved' end as stage")),
      f"""WITH st AS (SELECT kb_id AS batch, CASE WHEN {REASON} IS NOT NULL THEN 'validate' WHEN q_type IN (1, 2) AND n_options < 4 OR q_type IN (5, 6, 7, 9) AND question_id % 7 = 0 THEN 'check' WHEN question_id % 9 = 0 THEN 'dedup' ELSE 'saved' END AS stage FROM ({QUESTIONS}) q)
      SELECT b.batch, b.requested, count(st.batch) AS generated, count(*) FILTER (WHERE stage = 'validate') AS dropped_validate, count(*) FILTER (WHERE stage = 'check') AS dropped_check, count(*) FILTER (WHERE stage = 'dedup') AS dropped_dedup, count(*) FILTER (WHERE stage = 'saved') AS saved FROM ({BATCHES}) b LEFT JOIN st ON st.batch = b.batch GROUP BY b.batch, b.requested""")  # fmt: skip
#: Every tenth paper has a fellow for which nothing was saved.
PAPERS = "SELECT paper_id FROM {v_paper} UNION ALL SELECT -1 - paper_id FROM {v_paper} WHERE paper_id % 10 = 0"
R.add("paper_totals", lambda s: paper_totals(s.sql(PAPERS), s["v_paper_item"], s["v_question"]),
      f"""SELECT p.paper_id, count(q.question_id) AS total_count, coalesce(sum(CASE WHEN q_type <= 4 THEN 5.0 WHEN q_type > 4 THEN 10.0 END), 0) AS total_score, count(*) FILTER (WHERE status = 0) AS drafts, count(*) FILTER (WHERE status = 1) AS published,
      CASE WHEN count(q.question_id) = 0 THEN 'failed' WHEN count(*) FILTER (WHERE status = 0) > 0 THEN 'review' ELSE 'ready' END AS status
      FROM ({PAPERS}) p LEFT JOIN {{v_paper_item}} i ON i.paper_id = p.paper_id LEFT JOIN {{v_question}} q ON q.question_id = i.question_id GROUP BY p.paper_id""")  # fmt: skip
R.add("search_questions", lambda s: search_questions(s["v_question"], kb_id=1, status=1, keyword="RING", size=30).select("question_id", "stem", "total"),
      "SELECT question_id, stem, (SELECT count(*) FROM {v_question} WHERE kb_id = 1 AND status = 1 AND stem ILIKE '%ring%') AS total FROM {v_question} WHERE kb_id = 1 AND status = 1 AND stem ILIKE '%ring%' ORDER BY question_id DESC LIMIT 30")
R.add("search_questions_by_difficulty", lambda s: search_questions(s["v_question"], q_type=2, difficulty=3, page=2, size=15).select("question_id", "difficulty", "total"),
      "SELECT question_id, difficulty, (SELECT count(*) FROM {v_question} WHERE q_type = 2 AND difficulty = 3) AS total FROM {v_question} WHERE q_type = 2 AND difficulty = 3 ORDER BY question_id DESC LIMIT 15 OFFSET 15")
R.add("enrich_questions", lambda s: enrich_questions(s["v_question"], s["v_option"], s["v_question_tag"].groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("tag_id")), lambda x: x.cast("string")), ",").alias("tags"))).select("question_id", F.array_join(F.transform("options", lambda o: F.concat(o["option_key"], o["is_correct"].cast("string"))), ",").alias("options"), "tags"),
      """SELECT q.question_id, o.options, t.tags FROM {v_question} q LEFT JOIN (SELECT question_id, string_agg(concat(option_key, is_correct), ',' ORDER BY sort_order) AS options FROM {v_option} GROUP BY 1) o ON o.question_id = q.question_id
      LEFT JOIN (SELECT question_id, string_agg(CAST(tag_id AS VARCHAR), ',' ORDER BY tag_id) AS tags FROM {v_question_tag} GROUP BY 1) t ON t.question_id = q.question_id""")  # fmt: skip
R.add("approve_questions", lambda s: approve_questions(s["v_question"], s["v_question"].filter("question_id % 4 = 0")).select("question_id", "status", "approved"),
      "SELECT question_id, CASE WHEN question_id % 4 = 0 AND status = 0 THEN 1 ELSE status END AS status, question_id % 4 = 0 AND status = 0 AS approved FROM {v_question}")
def _without_drafts(s) -> DataFrame:
    left = drop_paper_drafts(s["v_question"], s["v_paper_item"], s["v_exam"].filter("status = 0").selectExpr("exam_id as paper_id"), s["v_option"], s["v_question_tag"])
    options, tags = (x.groupBy("question_id").agg(F.count("*").alias(n)) for x, n in zip(left[1:], ("options", "tags"), strict=True))
    rows = left[0].select("question_id", "status").join(options, "question_id", "full_outer").join(tags, "question_id", "full_outer")
    return rows.na.fill(0, ["options", "tags"])


DRAFTS = "SELECT question_id FROM {v_question} WHERE status = 0 AND question_id IN (SELECT question_id FROM {v_paper_item} WHERE paper_id IN (SELECT exam_id FROM {v_exam} WHERE status = 0))"
R.add("drop_paper_drafts", _without_drafts,
      f"""SELECT q.question_id, q.status, coalesce(o.n, 0) AS options, coalesce(t.n, 0) AS tags FROM {{v_question}} q LEFT JOIN (SELECT question_id, count(*) AS n FROM {{v_option}} GROUP BY 1) o ON o.question_id = q.question_id
      LEFT JOIN (SELECT question_id, count(*) AS n FROM {{v_question_tag}} GROUP BY 1) t ON t.question_id = q.question_id WHERE q.question_id NOT IN ({DRAFTS})""")  # fmt: skip
R.add("list_documents", lambda s: list_rows(s["v_doc"], "file_name", "SRC1", 3, size=40).select("doc_id", "file_name", "total"),
      "SELECT doc_id, file_name, (SELECT count(*) FROM {v_doc} WHERE kb_id = 3 AND file_name ILIKE '%src1%') AS total FROM {v_doc} WHERE kb_id = 3 AND file_name ILIKE '%src1%' ORDER BY doc_id DESC LIMIT 40")
R.add("list_kbs", lambda s: list_rows(s["v_kb"], "name", "a", order="kb_id").select("kb_id", "name", "total"),
      "SELECT kb_id, name, (SELECT count(*) FROM {v_kb} WHERE name ILIKE '%a%') AS total FROM {v_kb} WHERE name ILIKE '%a%' ORDER BY kb_id DESC LIMIT 20")
