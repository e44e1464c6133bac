"""Résumés and interviews (J)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.rounding import half_up
from ..sources.views import Registry
from .bank import terms_sql
from .tags import blocks

R = Registry()
# Endings of names and what is left out of them, degrees, majors, words of risk and of order, dimensions of an answer's score.
SUFFIXES = "篇|章|节|模块|部分|专题|系列|基础|入门|详解"
IGNORED = r"[\s　（）()【】\[\]·、,，.。/\\\-—:：;；'\"“”]"
DEGREES = ["博士", "硕士", "本科", "大专", "专科"]
MAJORS = "计算机科学与技术|软件工程|信息管理|电子信息工程|网络工程|通信工程|人工智能|数据科学"
RISKS = ["精通", "熟练掌握", "架构", "主导", "负责整体", "高并发", "千万级", "从 0 到 1", "亿级", "优化了", "提升了"]
ORDERING = ["首先", "其次", "然后", "最后", "第一步", "背景"]
DIMENSIONS = ["relevance", "tech", "structure", "specificity", "consistency"]
#: Words of a lexicon sent to the tasks at once.
LEXICON_BLOCK = 50_000


def distinct_folded(items: Column, limit: int) -> Column:
    """Items in order, each once regardless of case, blanks and hyphens."""
    key = lambda x: F.lower(F.regexp_replace(x, r"[\s\-_]", ""))
    kept = F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != "")
    keys = F.transform(kept, key)
    return F.slice(F.filter(kept, lambda x, i: F.array_position(keys, key(x)) == i + 1), 1, limit)


def normalize_profiles(rows: DataFrame, column: str = "profile") -> DataFrame:
    """Profile JSON as a struct with defaults; lists without repeats, years as a number; a project that is a text is its title."""
    schema = "name string, years string, degree string, school string, skills array<string>, highlights array<string>, risks array<string>, projects array<string>"
    p = F.from_json(column, schema)
    listed = lambda name, n: distinct_folded(F.coalesce(p[name], F.array().cast("array<string>")), n).alias(name)
    text = lambda name: F.coalesce(F.trim(p[name]), F.lit("")).alias(name)
    years = F.coalesce(F.regexp_extract(p["years"], r"\d+", 0).try_cast("int"), F.lit(0)).alias("years")
    kind = "struct<title: string, period: string, stack: string>"
    titled = lambda x: F.struct(x.alias("title"), F.lit("").alias("period"), F.lit("").alias("stack"))
    project = lambda x: F.when(F.ltrim(x).startswith("{"), F.from_json(x, kind)).otherwise(titled(x))
    projects = F.coalesce(F.transform(F.array_compact(p["projects"]), project), F.expr(f"cast(array() as array<{kind}>)")).alias("projects")
    return rows.withColumn("profile", F.struct(text("name"), years, text("degree"), text("school"), listed("skills", 20), listed("highlights", 8), listed("risks", 8), projects))


def words_in(texts: DataFrame, lexicon: DataFrame, most: int, block: int = LEXICON_BLOCK) -> DataFrame:
    """(resume_id, word, rank): of the words of the lexicon that stand in each text, the ``most`` first by rank in every block.

    The whole lexicon is sought: it goes out in blocks of bounded size, each in one automaton.
    """
    out = None
    for words in blocks(lexicon.filter("low <> ''"), block):
        sent = texts.sparkSession.sparkContext.broadcast([(r["low"], r["word"], r["rank"]) for r in words])

        def seek(batches: Iterator[pd.DataFrame], known=sent) -> Iterator[pd.DataFrame]:
            finder, of = ahocorasick.Automaton(), {}
            for low, word, rank in known.value:
                of.setdefault(low, []).append((rank, word))
                finder.add_word(low, low)
            finder.make_automaton()
            for rows in batches:
                found = [(i, word, rank) for i, t in zip(rows["resume_id"], rows["t"], strict=True) for rank, word in sorted(x for low in {low for _, low in finder.iter(t)} for x in of[low])[:most]]
                yield pd.DataFrame(found, columns=["resume_id", "word", "rank"])

        part = texts.mapInPandas(seek, "resume_id long, word string, rank long")
        out = part if out is None else out.unionByName(part)
    return out


def extract_profiles(resumes: DataFrame, lexicon: DataFrame, most: int = 12) -> DataFrame:
    """Profile fields of resumes(resume_id, raw_text) by rules; skills by a lexicon(word, rank)."""
    text = F.coalesce("raw_text", F.lit(""))
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"[\s|·•]+", "")), lambda x: x != "")
    name = F.try_element_at(F.filter(F.slice(lines, 1, 6), lambda x: x.rlike(f"^{X.HAN}{{2,4}}$")), F.lit(1))
    degree = reduce(lambda c, d: c.when(text.contains(d), d), DEGREES, F)
    risks = F.slice(F.array_compact(F.array(*(F.when(text.contains(w), w) for w in RISKS))), 1, 5)
    rows = resumes.select("resume_id", name.alias("name"), F.coalesce(F.regexp_extract(text, r"(\d+)\s*年(?:以上)?(?:工作)?经验", 1).try_cast("int"), F.lit(0)).alias("years"), degree.alias("degree"), F.regexp_extract(text, f"({X.HAN}{{2,12}}(?:大学|学院|职业技术学院))", 1).alias("school"), F.regexp_extract(text, f"({MAJORS})", 1).alias("major"), risks.alias("risks"))
    found = words_in(resumes.select("resume_id", F.lower(text).alias("t")), lexicon.select("word", F.lower("word").alias("low"), F.col("rank").cast("long").alias("rank")), most)
    found = found.withColumn("n", F.row_number().over(W.partitionBy("resume_id").orderBy("rank", "word"))).filter(F.col("n") <= most)
    return rows.join(found.groupBy("resume_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "word"))), lambda x: x["word"]).alias("skills")), "resume_id", "left")


def build_transcripts(turns: DataFrame) -> DataFrame:
    """Per interview its text with role heads, and what has been said since the last question."""
    line = F.concat(F.when(F.col("role") == 1, "面试官：").otherwise("候选人："), "content")
    rows = turns.withColumns({"_l": line, "_last": F.max(F.when(F.col("role") == 1, F.col("seq"))).over(W.partitionBy("interview_id"))})
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["_l"]), "\n")
    return rows.groupBy("interview_id").agg(joined(F.struct("seq", "_l")).alias("transcript"), joined(F.when(F.col("seq") >= F.col("_last"), F.struct("seq", "_l"))).alias("recent_qa"))


def evaluate_answers(rows: DataFrame) -> DataFrame:
    """Rule scores of rows(id, answer, expected): length bands, overlap of terms and five dimensions."""
    answer = F.trim(F.coalesce("answer", F.lit("")))
    n = F.length(answer)
    length = F.when(n >= 220, 90).when(n >= 120, 78).when(n >= 60, 62).when(n >= 25, 45).otherwise(28)
    key = X.terms(F.coalesce("expected", F.lit("")), 30)
    overlap = F.when(F.size(key) > 0, 100 * F.size(F.array_intersect(key, X.terms(answer, 30))) / F.size(key)).otherwise(0.0)
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(100.0), c.cast("double")))
    ordered = reduce(Column.__or__, (answer.contains(w) for w in ORDERING))
    scores = {"relevance": 0.5 * length + 0.5 * overlap, "tech": F.when(F.size(key) > 0, 50 + 0.5 * overlap).otherwise(30.0), "structure": F.when(ordered, 85).otherwise(length), "specificity": 0.6 * length + 0.4 * overlap, "consistency": F.lit(88)}
    rows = rows.select("id", n.alias("_n"), *(F.bround(clamp(scores[d]), 1).alias(d) for d in DIMENSIONS))
    mean = reduce(Column.__add__, (F.col(d) for d in DIMENSIONS)) / len(DIMENSIONS)
    return rows.select("id", *DIMENSIONS, F.bround(mean, 0).alias("total"), (F.col("_n") < 120).alias("follow_up"))


def normalize_evaluations(rows: DataFrame) -> DataFrame:
    """Dimensions within 0 to 100 with one decimal; a missing or non-positive total is their mean: rows(id, scores map, total)."""
    score = lambda d: F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(F.col("scores")[d].try_cast("double"), F.lit(0.0)))), 1)
    rows = rows.select("id", *(score(d).alias(d) for d in DIMENSIONS), F.col("total").try_cast("double").alias("_t"))
    mean = F.bround(reduce(Column.__add__, (F.col(d) for d in DIMENSIONS)) / len(DIMENSIONS), 1)
    return rows.select("id", *DIMENSIONS, F.when(F.col("_t") > 0, F.bround(F.least(F.col("_t"), F.lit(100.0)), 1)).otherwise(mean).alias("total"))


def interview_report(turns: DataFrame, skills: DataFrame) -> DataFrame:
    """Mean score of the turns and up to six skills(interview_id, skill) that no answer names."""
    scores = turns.groupBy("interview_id").agg(half_up(F.avg("score"), 1).alias("overall"), F.transform(F.array_sort(F.collect_list(F.when(F.col("score").isNotNull(), F.struct("seq", "score")))), lambda x: x["score"]).alias("scores"))
    answers = turns.filter("role = 2").groupBy("interview_id").agg(F.lower(F.array_join(F.collect_list("content"), "\n")).alias("said"))
    named = skills.join(answers, "interview_id", "left").withColumn("named", F.coalesce(F.col("said").contains(F.lower("skill")), F.lit(False)))
    named = named.withColumn("n", F.row_number().over(W.partitionBy("interview_id", "named").orderBy("skill")))
    pick = lambda c, n: F.array_sort(F.collect_list(F.when(c & (F.col("n") <= n), F.col("skill"))))
    lists = named.groupBy("interview_id").agg(pick(~F.col("named"), 6).alias("unverified"), pick(F.col("named"), 2).alias("to_deepen"))
    return scores.join(lists, "interview_id", "left")


def parts_of(text: Column, lengths: Column) -> Column:
    """All different substrings of the given lengths."""
    return F.array_distinct(F.flatten(F.transform(lengths, lambda n: F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, n)))))


def match_weak_points(points: DataFrame, tags: DataFrame) -> DataFrame:
    """Best tag of the base for each weak point: equal, then tag in which the point stands, then point in which the tag stands.

    points(interview_id, kb_id, pos, point), tags(tag_id, kb_id, name, chunk_count). Tags without
    chunks take part only if the base has no others. Ties go to the longer overlap, then the smaller id.

    Containment is a join of substrings: those of names that are as long as some point, and those of
    points that are as long as some name. Every name and every different point has few of them, and
    the first tag of each is chosen before the join, so no point meets all tags of its base.
    """
    folded = lambda c: F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(F.col(c), F.lit(""))), IGNORED, ""), f"({SUFFIXES})$", "")
    used = tags.withColumn("_m", F.max("chunk_count").over(W.partitionBy("kb_id"))).filter((F.col("chunk_count") > 0) | (F.col("_m") == 0))
    named = used.select("kb_id", "tag_id", folded("name").alias("name")).filter("name <> ''").groupBy("kb_id", "name").agg(F.min("tag_id").alias("tag_id"))
    asked = points.select("interview_id", "pos", "kb_id", folded("point").alias("point")).filter("point <> ''")
    texts = asked.select("kb_id", "point").distinct()
    lengths = lambda rows, c: rows.groupBy("kb_id").agg(F.collect_set(F.length(c)).alias("lengths"))
    fitting = lambda c: F.filter("lengths", lambda n: n <= F.length(c))
    within = named.join(lengths(texts, "point"), "kb_id").select("kb_id", "tag_id", F.explode(parts_of(F.col("name"), fitting("name"))).alias("point")).groupBy("kb_id", "point").agg(F.min("tag_id").alias("tag_id"))
    around = texts.join(lengths(named, "name"), "kb_id").select("kb_id", "point", F.explode(parts_of(F.col("point"), fitting("point"))).alias("name")).join(named, ["kb_id", "name"])
    tiers = named.select("kb_id", F.col("name").alias("point"), F.lit(1).alias("tier"), F.lit(0).alias("n"), "tag_id").join(texts, ["kb_id", "point"], "left_semi")
    tiers = tiers.unionByName(within.select("kb_id", "point", F.lit(2).alias("tier"), F.lit(0).alias("n"), "tag_id").join(texts, ["kb_id", "point"], "left_semi"))
    tiers = tiers.unionByName(around.select("kb_id", "point", F.lit(3).alias("tier"), (-F.length("name")).alias("n"), "tag_id"))
    best = tiers.groupBy("kb_id", "point").agg(F.min(F.struct("tier", "n", "tag_id")).alias("x"))
    return asked.join(best, ["kb_id", "point"]).select("interview_id", "pos", "x.tag_id", "x.tier")


def weak_point_plan(points: DataFrame, matched: DataFrame) -> DataFrame:
    """Per interview the distinct tags, the points without one and the number of items to make."""
    rows = points.join(matched, ["interview_id", "pos"], "left")
    rows = rows.groupBy("interview_id").agg(F.array_sort(F.collect_set("tag_id")).alias("tags"), F.count_if(F.col("tag_id").isNull()).alias("unmatched"))
    return rows.withColumn("items", F.greatest(F.lit(5), F.least(F.lit(30), 3 * F.size("tags"))))


def list_interviews(interviews: DataFrame, resumes: DataFrame, kbs: DataFrame) -> DataFrame:
    """Interviews, newest first, with the names of their résumé and base where they have one."""
    rows = interviews.join(resumes.select("resume_id", F.col("name").alias("resume_name")), "resume_id", "left")
    return rows.join(kbs.select("kb_id", F.col("name").alias("kb_name")), "kb_id", "left").orderBy(F.desc("interview_id"))


def render_profiles(rows: DataFrame) -> DataFrame:
    """Profile struct as labelled lines; empty fields are left out."""
    p = F.col("profile")
    field = lambda label, c: F.when(c != "", F.concat(F.lit(f"- {label}："), c))
    listed = lambda label, c: F.when(F.size(c) > 0, F.concat(F.lit(f"- {label}："), F.array_join(c, "、")))
    projects = F.when(F.size(p["projects"]) > 0, F.concat(F.lit("- 项目：\n"), F.array_join(F.transform(p["projects"], lambda x, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), F.concat_ws(" | ", F.nullif(x["title"], F.lit("")), F.nullif(x["period"], F.lit("")), F.nullif(x["stack"], F.lit(""))))), "\n")))
    years = F.when(p["years"] > 0, F.concat(F.lit("- 年限："), p["years"].cast("string")))
    return rows.withColumn("rendered", F.concat_ws("\n", field("姓名", p["name"]), years, field("学历", p["degree"]), field("学校", p["school"]), listed("技能", p["skills"]), listed("亮点", p["highlights"]), listed("风险", p["risks"]), projects))


def _profiles(s) -> DataFrame:
    return normalize_profiles(s.sql(PROFILES))


#: Malformed JSON, and profiles with different fields.
PROFILES = """SELECT CAST(s_suppkey AS BIGINT) AS resume_id, CASE s_suppkey % 4 WHEN 0 THEN '[name]' WHEN 1 THEN concat(chr(123), '"name":" ', s_name, ' ","years":"about ', s_suppkey % 12, ' years","degree":"本科","skills":["Spark","spark"," My-SQL","mysql","T', s_suppkey % 3, '"],"projects":[', chr(123), '"title":"P', s_suppkey % 5, '","period":"","stack":"X"', chr(125), ',"Search engine"]', chr(125))
    WHEN 2 THEN concat(chr(123), '"name":null,"years":', s_suppkey % 12, ',"school":"S","highlights":["a","A","b"],"risks":["r', s_suppkey % 2, '"]', chr(125)) ELSE concat(chr(123), '"skills":[MANY]', chr(125)) END AS profile FROM {supplier}""".replace("MANY", ",".join(f'"k{i}"' for i in range(25)))
KIND = "s_suppkey % 4"


def _turns(s) -> DataFrame:
    return s["v_turn"].dropDuplicates(["interview_id", "seq"])


POINTS = """SELECT DISTINCT interview_id, interview_id % 5 AS kb_id, seq AS pos, CASE (interview_id + seq) % 6 WHEN 0 THEN 'Supplier#000000001' WHEN 1 THEN 'zzz' WHEN 2 THEN 'supplier' WHEN 3 THEN concat('knows Supplier#00000000', interview_id % 9, ' A not, or Supplier#00000000', interview_id % 9) WHEN 4 THEN '0003 N系列' ELSE ' ,. ' END AS point FROM {v_turn}"""
COUNTED = "SELECT tag_id, kb_id, name, CASE WHEN kb_id = 3 THEN 0 ELSE tag_id % 4 END AS chunk_count FROM {v_tag}"
R.add("normalize_profiles", lambda s: _profiles(s).select("resume_id", "profile.name", "profile.years", "profile.degree", "profile.school", *(F.array_join(f"profile.{c}", ",").alias(c) for c in ("skills", "highlights", "risks")), F.size("profile.projects").alias("projects")),
      f"""SELECT s_suppkey AS resume_id, CASE WHEN {KIND} = 1 THEN s_name ELSE '' END AS name, CAST(CASE WHEN {KIND} IN (1, 2) THEN s_suppkey % 12 ELSE 0 END AS INT) AS years, CASE WHEN {KIND} = 1 THEN '本科' ELSE '' END AS degree, CASE WHEN {KIND} = 2 THEN 'S' ELSE '' END AS school,
      CASE {KIND} WHEN 1 THEN concat('Spark,My-SQL,T', s_suppkey % 3) WHEN 3 THEN '{",".join(f"k{i}" for i in range(20))}' ELSE '' END AS skills, CASE WHEN {KIND} = 2 THEN 'a,b' ELSE '' END AS highlights, CASE WHEN {KIND} = 2 THEN concat('r', s_suppkey % 2) ELSE '' END AS risks, CASE WHEN {KIND} = 1 THEN 2 ELSE 0 END AS projects FROM {{supplier}}""")  # fmt: skip
R.add("extract_profiles", lambda s: extract_profiles(s["v_doc"].selectExpr("doc_id as resume_id", "concat('王小明\n', doc_id % 9, ' 年', case doc_id % 3 when 0 then '' when 1 then '以上工作' else '开发' end, '经验，', case doc_id % 2 when 0 then '专科' else '研究生' end, '，软件工程，主导\n', text) as raw_text"), s.sql("SELECT DISTINCT n_name AS word, n_nationkey AS rank FROM {nation} UNION ALL SELECT 'the', 100 UNION ALL SELECT 'der', 101")).select("resume_id", "name", "years", "degree", "major", F.array_join("risks", ",").alias("risks"), F.array_join("skills", ",").alias("skills")),
      "SELECT doc_id AS resume_id, '王小明' AS name, CAST(CASE WHEN doc_id % 3 = 2 THEN 0 ELSE doc_id % 9 END AS INT) AS years, CASE WHEN doc_id % 2 = 0 THEN '专科' END AS degree, '软件工程' AS major, '主导' AS risks, (SELECT string_agg(w, ',' ORDER BY r) FROM (SELECT n_name AS w, n_nationkey AS r FROM {nation} UNION ALL SELECT 'the', 100 UNION ALL SELECT 'der', 101) x WHERE contains(lower(text), lower(w))) AS skills FROM {v_doc}")
R.add("build_transcripts", lambda s: build_transcripts(_turns(s)),
      """WITH t AS (SELECT *, concat(CASE WHEN role = 1 THEN '面试官：' ELSE '候选人：' END, content) AS l, max(CASE WHEN role = 1 THEN seq END) OVER (PARTITION BY interview_id) AS m FROM {v_turn})
      SELECT interview_id, string_agg(l, chr(10) ORDER BY seq) AS transcript, coalesce(string_agg(l, chr(10) ORDER BY seq) FILTER (WHERE seq >= m), '') AS recent_qa FROM t GROUP BY interview_id""")  # fmt: skip
ANSWERED = """SELECT DISTINCT interview_id * 1000 + seq AS id, CASE seq % 4 WHEN 0 THEN concat(CASE interview_id % 3 WHEN 0 THEN '背景 ' WHEN 1 THEN '因为 Then ' ELSE '' END, substring(content, 1, 30)) WHEN 1 THEN concat('首先 ', substring(content, 1, 90)) WHEN 2 THEN content ELSE ' ' END AS answer, CASE WHEN interview_id % 3 = 0 THEN '' ELSE substring(content, 11, 80) END AS expected FROM {v_turn}"""
CLAMPED = lambda c: f"round_even(greatest(0.0::DOUBLE, least(100.0::DOUBLE, CAST({c} AS DOUBLE))), 1)"
EVALUATED = f"""WITH a AS (SELECT id, trim(coalesce(answer, '')) AS t, {terms_sql("coalesce(expected, '')", 30)} AS k, {terms_sql("trim(coalesce(answer, ''))", 30)} AS w FROM ({ANSWERED}) x),
    b AS (SELECT *, CASE WHEN length(t) >= 220 THEN 90 WHEN length(t) >= 120 THEN 78 WHEN length(t) >= 60 THEN 62 WHEN length(t) >= 25 THEN 45 ELSE 28 END AS n, CASE WHEN len(k) > 0 THEN 100.0::DOUBLE * len(list_filter(k, lambda y: list_contains(w, y))) / len(k) ELSE 0.0 END AS o, regexp_matches(t, '首先|其次|然后|最后|第一步|背景') AS ordered FROM a),
    c AS (SELECT id, t, {CLAMPED("0.5::DOUBLE * n + 0.5::DOUBLE * o")} AS relevance, {CLAMPED("CASE WHEN len(k) > 0 THEN 50 + 0.5::DOUBLE * o ELSE 30.0 END")} AS tech, {CLAMPED("CASE WHEN ordered THEN 85 ELSE n END")} AS structure, {CLAMPED("0.6::DOUBLE * n + 0.4::DOUBLE * o")} AS specificity, 88.0::DOUBLE AS consistency FROM b)"""
R.add("evaluate_answers", lambda s: evaluate_answers(s.sql(ANSWERED)), EVALUATED + " SELECT id, relevance, tech, structure, specificity, consistency, round_even((relevance + tech + structure + specificity + consistency) / 5, 0) AS total, length(t) < 120 AS follow_up FROM c")
SCORED = "SELECT interview_id * 1000 + seq AS id, seq * 37.55 - 20 AS a, seq * 11.0 AS b, CASE WHEN seq % 2 = 0 THEN 61.25 ELSE -1.0 END AS total FROM {v_turn}"
R.add("normalize_evaluations", lambda s: normalize_evaluations(s.sql(SCORED).selectExpr("id", "map('relevance', cast(a as string), 'tech', cast(b as string), 'structure', 'x') as scores", "cast(total as string) as total")).select("id", "relevance", "tech", "structure", "total"),
      f"WITH x AS (SELECT id, round_even(greatest(0.0, least(100.0, CAST(a AS DOUBLE))), 1) AS relevance, round_even(greatest(0.0, least(100.0, CAST(b AS DOUBLE))), 1) AS tech, 0.0 AS structure, CAST(total AS DOUBLE) AS t FROM ({SCORED}) y) SELECT id, relevance, tech, structure, CASE WHEN t > 0 THEN round_even(t, 1) ELSE round_even((relevance + tech) / 5, 1) END AS total FROM x")
R.add("interview_report", lambda s: interview_report(_turns(s).withColumn("score", F.expr("if(role = 2, double(seq * 7 % 100), null)")), s["v_turn"].select("interview_id", F.explode(F.array(*map(F.lit, ["the", "der", "qqq", "zzz"]))).alias("skill")).distinct()).select("interview_id", "overall", F.array_join("unverified", ",").alias("unverified"), F.array_join("to_deepen", ",").alias("to_deepen")),
      """WITH a AS (SELECT interview_id, round(avg(CASE WHEN role = 2 THEN CAST(seq * 7 % 100 AS DOUBLE) END) + 1e-7, 1) AS overall, lower(string_agg(content, chr(10)) FILTER (WHERE role = 2)) AS said FROM {v_turn} GROUP BY interview_id)
      SELECT interview_id, overall, (SELECT coalesce(string_agg(k, ',' ORDER BY k), '') FROM (VALUES ('the'), ('der'), ('qqq'), ('zzz')) v(k) WHERE NOT coalesce(contains(said, k), false)) AS unverified, (SELECT coalesce(string_agg(k, ',' ORDER BY k), '') FROM (VALUES ('the'), ('der'), ('qqq'), ('zzz')) v(k) WHERE coalesce(contains(said, k), false)) AS to_deepen FROM a""")  # fmt: skip
FOLDED = r"""regexp_replace(regexp_replace(lower(coalesce({0}, '')), '[\s　（）()【】\[\]·、,，.。/\\\-—:：;；''"“”]', '', 'g'), '(篇|章|节|模块|部分|专题|系列|基础|入门|详解)$', '')"""
MATCHED = f"""p AS (SELECT *, {FOLDED.format("point")} AS f FROM ({POINTS}) x), g AS (SELECT *, {FOLDED.format("name")} AS g FROM (SELECT *, max(chunk_count) OVER (PARTITION BY kb_id) AS m FROM ({COUNTED}) t) y WHERE chunk_count > 0 OR m = 0),
    c AS (SELECT interview_id, pos, tag_id, CASE WHEN f = g THEN 1 WHEN contains(g, f) THEN 2 ELSE 3 END AS tier, length(f) AS lf, length(g) AS lg FROM p JOIN g ON g.kb_id = p.kb_id WHERE f <> '' AND g <> '' AND (contains(g, f) OR contains(f, g))),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY interview_id, pos ORDER BY tier, CASE WHEN tier = 2 THEN lf ELSE lg END DESC, tag_id) AS n FROM c) z WHERE n = 1)"""
R.add("match_weak_points", lambda s: match_weak_points(s.sql(POINTS), s.sql(COUNTED)), f"WITH {MATCHED} SELECT interview_id, pos, tag_id, tier FROM best")
R.add("weak_point_plan", lambda s: (lambda p: weak_point_plan(p, match_weak_points(p, s.sql(COUNTED))).select("interview_id", F.size("tags").alias("n_tags"), "unmatched", "items"))(s.sql(POINTS)),
      f"WITH {MATCHED} SELECT p.interview_id, count(DISTINCT b.tag_id) AS n_tags, count(*) FILTER (WHERE b.tag_id IS NULL) AS unmatched, greatest(5, least(30, 3 * count(DISTINCT b.tag_id))) AS items FROM ({POINTS}) p LEFT JOIN best b ON b.interview_id = p.interview_id AND b.pos = p.pos GROUP BY p.interview_id")
INTERVIEWS = "SELECT DISTINCT interview_id, interview_id % 40 AS resume_id, interview_id % 7 AS kb_id FROM {v_turn}"
R.add("list_interviews", lambda s: list_interviews(s.sql(INTERVIEWS), s.sql("SELECT CAST(s_suppkey AS BIGINT) AS resume_id, s_name AS name FROM {supplier} WHERE s_suppkey % 2 = 0"), s["v_kb"]),
      f"SELECT i.*, s.s_name AS resume_name, k.name AS kb_name FROM ({INTERVIEWS}) i LEFT JOIN {{supplier}} s ON s.s_suppkey = i.resume_id AND s.s_suppkey % 2 = 0 LEFT JOIN {{v_kb}} k ON k.kb_id = i.kb_id")
R.add("render_profiles", lambda s: render_profiles(_profiles(s)).select("resume_id", "rendered"),
      f"""SELECT s_suppkey AS resume_id, CASE {KIND} WHEN 1 THEN concat_ws(chr(10), concat('- 姓名：', s_name), CASE WHEN s_suppkey % 12 > 0 THEN concat('- 年限：', s_suppkey % 12) END, '- 学历：本科', concat('- 技能：Spark、My-SQL、T', s_suppkey % 3), concat('- 项目：', chr(10), '  1. P', s_suppkey % 5, ' | X', chr(10), '  2. Search engine'))
      WHEN 2 THEN concat_ws(chr(10), CASE WHEN s_suppkey % 12 > 0 THEN concat('- 年限：', s_suppkey % 12) END, '- 学校：S', '- 亮点：a、b', concat('- 风险：r', s_suppkey % 2)) WHEN 3 THEN '- 技能：{"、".join(f"k{i}" for i in range(20))}' ELSE '' END AS rendered FROM {{supplier}}""")  # fmt: skip
