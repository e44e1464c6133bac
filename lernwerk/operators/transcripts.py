"""Conversation transcripts (K)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.views import Registry
from .corrections import PHRASE, correct_terms

R = Registry()
INTERVIEWER, CANDIDATE = 1, 2
# Fillers, words that stutter, marks of questions and classes of questions.
FILLERS = ["嗯", "呃", "额", "哦", "唔", "唉", "诶", "哎", "噢", "喔", "啊", "呀", "哇", "呐", "咧", "咦", "嗨", "那个", "这个", "就是说", "然后就是", "怎么说呢", "对吧", "是吧", "你知道吧", "你懂我意思吧", "反正吧", "对不对"]
STUTTERS = ["就是", "这个", "那个", "我们", "你们", "然后", "因为", "所以", "但是", "其实", "可能", "应该", "觉得", "知道", "进行", "的话"]
MARKERS = ["介绍一下", "说说", "讲讲", "谈谈", "聊一下", "为什么", "怎么", "如何", "什么是", "有没有", "能不能", "是否", "举个例子", "你了解", "你来", "你负责"]
CLASSES = {
    "INTRO": ["自我介绍", "介绍一下你自己", "介绍下自己"],
    "ALGO": ["算法", "复杂度", "时间复杂度", "手写", "排序", "链表", "二叉树", "动态规划"],
    "PROJECT": ["项目", "你做的", "负责", "这块", "业务"],
    "SCENARIO": ["如果", "假设", "线上", "故障", "怎么设计", "如何设计", "方案"],
    "REVERSE": ["你有什么想问", "反问", "想问我们"],
}
EDGE = r"[，。！？、；：…—·～~,.!?;:\"'“”‘’（）()【】{}《》<>\s]"


def normalize_utterances(rows: DataFrame) -> DataFrame:
    """Blank sentences dropped, times as whole milliseconds, speaker 0 by default, numbered anew (K1)."""
    rows = rows.filter(F.trim(F.coalesce("text", F.lit(""))) != "").withColumns({"speaker_id": F.coalesce("speaker_id", F.lit(0)), "start_ms": F.expr("cast(try_cast(start_ms as double) as long)"), "end_ms": F.expr("cast(try_cast(end_ms as double) as long)")})
    return renumber(rows)


def renumber(rows: DataFrame) -> DataFrame:
    return rows.withColumn("seq", F.row_number().over(W.partitionBy("conv_id").orderBy("seq")))


def speaker_samples(rows: DataFrame, cut: int = 200, limit: int = 40) -> DataFrame:
    """First, middle and last utterance of every speaker, cut, at most 40 lines per conversation (K2)."""
    w = W.partitionBy("conv_id", "speaker_id")
    rows = rows.withColumns({"_i": F.row_number().over(w.orderBy("seq")), "_n": F.count("*").over(w)})
    rows = rows.filter((F.col("_i") == 1) | ((F.col("_n") > 1) & (F.col("_i") == F.col("_n"))) | ((F.col("_n") > 2) & (F.col("_i") == F.floor(F.col("_n") / 2) + 1)))
    rows = rows.withColumn("line", F.row_number().over(W.partitionBy("conv_id").orderBy("speaker_id", "seq"))).filter(F.col("line") <= limit)
    return rows.select("conv_id", "line", "speaker_id", "seq", F.substring("text", 1, cut).alias("text"))


def assign_roles(rows: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """(conv_id, speaker_id, role): a given mapping with both roles holds, else who says least asks; one speaker answers (K3)."""
    said = rows.groupBy("conv_id", "speaker_id").agg(F.sum(F.length("text")).alias("chars"))
    w = W.partitionBy("conv_id")
    said = said.withColumns({"_n": F.count("*").over(w), "_i": F.row_number().over(w.orderBy("chars", "speaker_id"))})
    role = F.when((F.col("_n") > 1) & (F.col("_i") == 1), INTERVIEWER).otherwise(CANDIDATE)
    if given is not None:
        valid = given.groupBy("conv_id").agg(F.countDistinct("role").alias("roles")).filter("roles = 2").select("conv_id")
        named = given.join(valid, "conv_id").select("conv_id", "speaker_id", F.col("role").alias("_given"))
        said = said.join(named, ["conv_id", "speaker_id"], "left")
        role = F.coalesce("_given", role)
    return said.select("conv_id", "speaker_id", role.alias("role"))


def allocate_times(pieces: DataFrame) -> DataFrame:
    """Times of pieces(conv_id, block, piece, text, start_ms, end_ms): the block's span by length, whole milliseconds (K4)."""
    w = W.partitionBy("conv_id", "block")
    share = F.floor((F.col("end_ms") - F.col("start_ms")) * F.length("text") / F.greatest(F.sum(F.length("text")).over(w), F.lit(1)))
    rows = pieces.withColumn("_d", share)
    rows = rows.withColumn("_before", F.coalesce(F.sum("_d").over(w.orderBy("piece").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return rows.select("conv_id", "block", "piece", "text", (F.col("start_ms") + F.col("_before")).alias("start_ms"), (F.col("start_ms") + F.col("_before") + F.col("_d")).alias("end_ms"))


def similarity(a: Column, b: Column) -> Column:
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def segmentation_guard(blocks: DataFrame, pieces: DataFrame, least: float = 0.75) -> DataFrame:
    """Pieces of a block if they are alike enough to it when joined, else the block whole as the candidate's (K5)."""
    joined = pieces.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(F.struct("piece", "role", "text"))).alias("p"))
    rows = blocks.join(joined, ["conv_id", "block"], "left")
    whole = F.array(F.struct(F.lit(0).alias("piece"), F.lit(CANDIDATE).alias("role"), F.col("text").alias("text")))
    alike = similarity(X.bare(F.array_join(F.transform("p", lambda x: x["text"]), "")), X.bare(F.col("text"))) >= least
    return rows.select("conv_id", "block", F.explode(F.when(F.coalesce(alike, F.lit(False)), F.col("p")).otherwise(whole)).alias("x")).select("conv_id", "block", "x.*")


def clean_speech(rows: DataFrame, column: str = "text") -> DataFrame:
    """Text without stutters, fillers and doubled punctuation, and the distinct words removed, in order (K6).

    Stutters are joined before fillers go, so that a drawn-out filler stands alone when it is sought.
    """
    twice = r"([一-鿿])\1{2,}"
    words = "(" + "|".join(STUTTERS) + r")\1+"
    filler = rf"(?:(?<=^)|(?<={EDGE}))(" + "|".join(sorted(FILLERS, key=len, reverse=True)) + rf")(?={EDGE}|$)"
    rows = rows.withColumn("_a", F.coalesce(column, F.lit("")))
    rows = rows.withColumn("_b", F.regexp_replace("_a", twice, "$1"))
    rows = rows.withColumn("_c", F.regexp_replace("_b", words, "$1"))
    removed = F.array_distinct(F.concat(X.all_matches(F.col("_a"), twice), X.all_matches(F.col("_b"), words), X.all_matches(F.col("_c"), filler)))
    steps = ((filler, ""), (r"([，。！？、；：])\1+", "$1"), (r"[ \t　]{2,}", " "), (r"^[，。、；：！？…—～·\s]+", ""), (r"\s+$", ""))
    clean = reduce(lambda c, step: F.regexp_replace(c, *step), steps, F.col("_c"))
    return rows.withColumns({"clean_text": clean, "removed_words": removed}).drop("_a", "_b", "_c")


def is_question(text: Column) -> Column:
    return F.coalesce(F.rtrim(text).rlike("[？?]$") | reduce(Column.__or__, (text.contains(m) for m in MARKERS)), F.lit(False))


def classify_questions(rows: DataFrame) -> DataFrame:
    """question_type of interviewer rows by the first rule that holds, else TECH for questions and OTHER (K7)."""
    kind = F
    for label, keywords in CLASSES.items():
        kind = kind.when(reduce(Column.__or__, (F.col("text").contains(k) for k in keywords)), label)
    return rows.withColumn("question_type", F.when(F.col("role") == INTERVIEWER, kind.when(is_question(F.col("text")), "TECH").otherwise("OTHER")))


def polish_guard(rows: DataFrame, rewrites: DataFrame) -> DataFrame:
    """clean_text replaced by a rewrite(conv_id, seq, rewrite) that isn't too short; an empty one clears it (K8)."""
    joined = rows.join(rewrites.select("conv_id", "seq", "rewrite"), ["conv_id", "seq"], "left")
    new = F.trim("rewrite")
    return joined.withColumn("clean_text", F.when(new == "", "").when(F.length(new) >= F.greatest(F.lit(2), F.floor(F.length("clean_text") / 4)), new).otherwise(F.col("clean_text"))).drop("rewrite")


def drop_and_renumber(rows: DataFrame) -> DataFrame:
    """Rows with clean text, numbered anew (K9)."""
    return renumber(rows.filter(F.trim(F.coalesce("clean_text", F.lit(""))) != ""))


def timed_transcript(rows: DataFrame, most: int = 24_000) -> DataFrame:
    """One text per conversation: [mm:ss] role：text, cut with a notice."""
    seconds = F.floor(F.coalesce("start_ms", F.lit(0)) / 1000)
    line = F.concat(F.format_string("[%02d:%02d] ", F.floor(seconds / 60), seconds % 60), F.when(F.col("role") == INTERVIEWER, "面试官").otherwise("候选人"), F.lit("："), "text")
    whole = rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", line.alias("t")))), lambda x: x["t"]), "\n").alias("transcript"))
    return whole.withColumn("transcript", F.when(F.length("transcript") > most, F.concat(F.substring("transcript", 1, most), F.lit("\n…（后文已截断）"))).otherwise(F.col("transcript")))


def note_counts(rows: DataFrame) -> DataFrame:
    """Turns, interviewer questions and speakers of every conversation."""
    asked = F.count_if((F.col("role") == INTERVIEWER) & is_question(F.col("text")))
    return rows.groupBy("conv_id").agg(F.count("*").alias("turns"), asked.alias("questions"), F.countDistinct("speaker_id").alias("speakers"))


def hotword_dictionary(tags: DataFrame, builtin: DataFrame, limit: int = 300) -> DataFrame:
    """(kb_id, words): up to 300 tag names by level and id, and built-in(kb_id, word), 2 to 20 characters, longest first."""
    first = tags.withColumn("_i", F.row_number().over(W.partitionBy("kb_id").orderBy("level", "tag_id"))).filter(F.col("_i") <= limit)
    words = first.select("kb_id", F.trim("name").alias("word")).union(builtin.select("kb_id", F.trim("word"))).filter(F.length("word").between(2, 20)).distinct()
    return words.groupBy("kb_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.length("word")).alias("n"), "word"))), lambda x: x["word"]).alias("words"))


def display_turns(rows: DataFrame) -> DataFrame:
    """Turns in order with the clean text, or the raw one where that is blank."""
    return rows.withColumn("shown", F.coalesce(F.when(F.trim("clean_text") != "", F.col("clean_text")), F.col("text")))


UTTERANCES = """SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS seq, CASE role WHEN 'assistant' THEN 2 WHEN 'user' THEN 1 ELSE 0 END AS speaker_id, CASE role WHEN 'assistant' THEN 2 ELSE 1 END AS role, CAST(turn * 1500 AS STRING) AS start_ms, CAST(turn * 1500 + 1400 AS STRING) AS end_ms,
    CASE WHEN turn % 5 = 3 THEN ' ' ELSE text END AS text FROM {conversations}"""
KEPT = f"u AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY seq) AS n FROM ({UTTERANCES}) x WHERE trim(text) <> '')"


def _rows(s) -> DataFrame:
    return normalize_utterances(s.sql(UTTERANCES).dropDuplicates(["conv_id", "seq"]))


R.add("normalize_utterances", lambda s: _rows(s).select("conv_id", "seq", "speaker_id", "start_ms", "end_ms"), f"WITH {KEPT} SELECT conv_id, n AS seq, speaker_id, CAST(start_ms AS BIGINT) AS start_ms, CAST(end_ms AS BIGINT) AS end_ms FROM u")
R.add("speaker_samples", lambda s: speaker_samples(_rows(s)).select("conv_id", "line", "speaker_id", "seq"),
      f"""WITH {KEPT}, c AS (SELECT *, row_number() OVER (PARTITION BY conv_id, speaker_id ORDER BY n) AS i, count(*) OVER (PARTITION BY conv_id, speaker_id) AS k FROM u)
      SELECT * FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY speaker_id, n) AS line, speaker_id, n AS seq FROM c WHERE i = 1 OR k > 1 AND i = k OR k > 2 AND i = CAST(floor(k / 2) AS BIGINT) + 1) y WHERE line <= 40""")  # fmt: skip
R.add("assign_roles", lambda s: assign_roles(_rows(s)),
      f"WITH {KEPT} SELECT conv_id, speaker_id, CASE WHEN k > 1 AND i = 1 THEN 1 ELSE 2 END AS role FROM (SELECT conv_id, speaker_id, count(*) OVER (PARTITION BY conv_id) AS k, row_number() OVER (PARTITION BY conv_id ORDER BY sum(length(text)), speaker_id) AS i FROM u GROUP BY conv_id, speaker_id) x")
PIECES = "SELECT conv_id, CAST(floor(n / 3) AS BIGINT) AS block, n AS piece, text, CAST(1000 AS BIGINT) AS start_ms, CAST(9000 AS BIGINT) AS end_ms FROM u"
R.add("allocate_times", lambda s: allocate_times(_rows(s).selectExpr("conv_id", "cast(floor(seq / 3) as bigint) as block", "seq as piece", "text", "1000L as start_ms", "9000L as end_ms")).drop("text"),
      f"""WITH {KEPT}, p AS ({PIECES}), d AS (SELECT *, CAST(floor(8000 * length(text) / sum(length(text)) OVER (PARTITION BY conv_id, block)) AS BIGINT) AS d FROM p) SELECT conv_id, block, piece, CAST(1000 + coalesce(sum(d) OVER w, 0) AS BIGINT) AS start_ms, CAST(1000 + coalesce(sum(d) OVER w, 0) + d AS BIGINT) AS end_ms FROM d
      WINDOW w AS (PARTITION BY conv_id, block ORDER BY piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")  # fmt: skip
#: Two pieces of each utterance: its first half, and of the other half a share that differs.
GUARDED = "SELECT conv_id, n AS block, text, CAST(floor(length(text) / 2) AS INT) AS h, CAST(floor(length(text) * (n % 11) / 20) AS INT) AS k, role FROM u"
BARE = "lower(regexp_replace({0}, '" + X.UNCOUNTED.replace("'", "''") + "', '', 'g'))"
R.add("segmentation_guard", lambda s: (lambda u: segmentation_guard(u.select("conv_id", "block", "text"), u.selectExpr("conv_id", "block", "1 as piece", "role", "substring(text, 1, h) as text").unionByName(u.selectExpr("conv_id", "block", "2 as piece", "3 - role as role", "substring(text, h + 1, k) as text"))))(_rows(s).selectExpr("conv_id", "seq as block", "role", "text", "cast(floor(length(text) / 2) as int) as h", "cast(floor(length(text) * (seq % 11) / 20) as int) as k")).select("conv_id", "block", "piece", "role", "text"),
      f"""WITH {KEPT}, g AS ({GUARDED}), s AS (SELECT *, length({BARE.format("substring(text, 1, h + k)")}) / greatest(length({BARE.format("text")}), 1) >= 0.75 AS alike FROM g)
      SELECT conv_id, block, 1 AS piece, role, substring(text, 1, h) AS text FROM s WHERE alike UNION ALL SELECT conv_id, block, 2, 3 - role, substring(text, h + 1, k) FROM s WHERE alike UNION ALL SELECT conv_id, block, 0, 2, text FROM s WHERE NOT alike""")  # fmt: skip


def spoken_sql() -> str:
    """Cleaning as SQL without look-around and back references: letters and words of the view are listed, and fillers are whole parts between edges."""
    letters, fillers = "我就应个是啊嗯哈这", ", ".join(f"'{x}'" for x in FILLERS)
    nested = lambda c, pairs: reduce(lambda x, y: f"regexp_replace({x}, '{y[0]}', '{y[1]}', 'g')", pairs, c)
    thrice, twice = [(f"{x}{{3,}}", x) for x in letters], [(f"({x}){{2,}}", x) for x in STUTTERS]
    every = lambda pairs: "|".join(x for x, _ in pairs)
    edge = EDGE.replace("'", "''")
    parts = f"string_split(regexp_replace(c, '({edge})', concat(chr(1), '\\1', chr(1)), 'g'), chr(1))"
    last = nested("array_to_string(list_filter(p, lambda x: x NOT IN (" + fillers + ")), '')", [*((f"{x}{{2,}}", x) for x in "，。！？、；："), (r"[ \t　]{2,}", " "), (r"^[，。、；：！？…—～·\s]+", ""), (r"\s+$", "")])
    words = f"list_concat(list_concat(regexp_extract_all(a, '{every(thrice)}'), regexp_extract_all(b, '{every(twice)}')), list_filter(p, lambda x: x IN ({fillers})))"
    return f"""v AS (SELECT conv_id, seq, text AS a, {nested("text", thrice)} AS b FROM {{v_speech}}), w AS (SELECT *, {nested("b", twice)} AS c FROM v), x AS (SELECT *, {parts} AS p FROM w), y AS (SELECT conv_id, seq, {last} AS clean_text, {words} AS r FROM x),
    z AS (SELECT conv_id, seq, clean_text, array_to_string(list_filter(r, lambda x, i: list_position(r, x) = i), ',') AS removed FROM y)"""


QUESTION = "(regexp_matches(rtrim(text), '[？?]$') OR " + " OR ".join(f"contains(text, '{m}')" for m in MARKERS) + ")"
CLASSED = "CASE " + " ".join(f"WHEN {' OR '.join(f"contains(text, '{k}')" for k in ks)} THEN '{label}'" for label, ks in CLASSES.items()) + f" WHEN {QUESTION} THEN 'TECH' ELSE 'OTHER' END"
R.add("clean_speech", lambda s: clean_speech(s["v_speech"]).select("conv_id", "seq", "clean_text", F.array_join("removed_words", ",").alias("removed")), f"WITH {spoken_sql()} SELECT * FROM z")
R.add("classify_questions", lambda s: classify_questions(s["v_speech"]).select("conv_id", "seq", "question_type"), f"SELECT conv_id, seq, CASE WHEN role = 1 THEN {CLASSED} END AS question_type FROM {{v_speech}}")
R.add("polish_guard", lambda s: polish_guard(_rows(s).withColumn("clean_text", F.col("text")), _rows(s).filter("seq % 2 = 0").selectExpr("conv_id", "seq", "if(seq % 4 = 0, ' ', concat(' ', substring(text, 1, cast(seq * 9 as int)), ' ')) as rewrite")).select("conv_id", "seq", "clean_text"),
      f"WITH {KEPT} SELECT conv_id, n AS seq, CASE WHEN n % 4 = 0 THEN '' WHEN n % 2 = 0 AND length(trim(substring(text, 1, CAST(n * 9 AS INT)))) >= greatest(2, floor(length(text) / 4)) THEN trim(substring(text, 1, CAST(n * 9 AS INT))) ELSE text END AS clean_text FROM u")
R.add("drop_and_renumber", lambda s: drop_and_renumber(_rows(s).withColumn("clean_text", F.expr("case when seq % 3 = 0 then ' ' when seq % 7 = 5 then null else text end"))).select("conv_id", "seq", "text"),
      f"WITH {KEPT} SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY n) AS seq, text FROM u WHERE n % 3 <> 0 AND n % 7 <> 5")
R.add("build_timed_transcript", lambda s: timed_transcript(_rows(s)),
      f"""WITH {KEPT}, t AS (SELECT conv_id, string_agg(concat(printf('[%02d:%02d] ', CAST(floor(CAST(start_ms AS BIGINT) / 60000) AS BIGINT), CAST(floor(CAST(start_ms AS BIGINT) / 1000) AS BIGINT) % 60), CASE WHEN role = 1 THEN '面试官' ELSE '候选人' END, '：', text), chr(10) ORDER BY n) AS t FROM u GROUP BY conv_id)
      SELECT conv_id, CASE WHEN length(t) > 24000 THEN concat(substring(t, 1, 24000), chr(10), '…（后文已截断）') ELSE t END AS transcript FROM t""")  # fmt: skip
R.add("note_counts", lambda s: note_counts(_rows(s)), f"WITH {KEPT} SELECT conv_id, count(*) AS turns, count(*) FILTER (WHERE role = 1 AND rtrim(text) LIKE '%?') AS questions, count(DISTINCT speaker_id) AS speakers FROM u GROUP BY conv_id")
BUILTIN = "SELECT kb_id, concat('builtin ', name) AS word FROM {v_kb}"
R.add("hotword_dictionary", lambda s: hotword_dictionary(s["v_tag"], s.sql(BUILTIN)).select("kb_id", F.array_join("words", ",").alias("words")),
      f"""SELECT kb_id, string_agg(word, ',' ORDER BY length(word) DESC, word) AS words FROM (SELECT kb_id, trim(name) AS word FROM (SELECT *, row_number() OVER (PARTITION BY kb_id ORDER BY level, tag_id) AS i FROM {{v_tag}}) t WHERE i <= 300 UNION SELECT kb_id, trim(word) FROM ({BUILTIN}) b) x WHERE length(word) BETWEEN 2 AND 20 GROUP BY kb_id""")
#: Speech with misspelt terms in front, and the dictionary with Chinese and Latin terms beside the tags.
MISSPELT = """SELECT conv_id, seq, conv_id % 5 AS kb_id, concat(CASE (conv_id + 3 * seq) % 7 WHEN 0 THEN '缓存激穿用互斥锁重建，' WHEN 1 THEN '缓存穿斗加分布式琐。' WHEN 2 THEN 'Redos与Kafkka，' WHEN 3 THEN concat('Suplier#', lpad(CAST(conv_id % 40 AS STRING), 8, '0'), '，') WHEN 4 THEN '讲讲分布系统一致性呢。Elastik search，'
    WHEN 5 THEN '缓存击穿缓存缓存雪奔分布' ELSE '' END, text) AS text FROM {v_speech}"""
GLOSSARY = "SELECT kb_id, w.word FROM {v_kb} CROSS JOIN (" + " UNION ALL ".join(f"SELECT '{w}' AS word" for w in ["缓存穿透", "缓存击穿", "缓存雪崩", "分布式锁", "分布式系统一致性", "Redis", "Kafka", "Elasticsearch", "internation"]) + ") w"
LISTED = f"""t AS (SELECT kb_id, trim(name) AS word FROM (SELECT *, row_number() OVER (PARTITION BY kb_id ORDER BY level, tag_id) AS i FROM {{v_tag}}) t WHERE i <= 300 UNION SELECT * FROM ({GLOSSARY}) g),
    d AS (SELECT kb_id, word, length(word) AS n, row_number() OVER (PARTITION BY kb_id ORDER BY length(word) DESC, word) AS r FROM t WHERE length(word) BETWEEN 2 AND 20)"""
#: DuckDB's edit distance counts bytes, so characters become letters by their place in the term; others are all A.
LETTERED = "array_to_string(list_transform(string_split({0}, ''), lambda c: chr(CAST(65 + strpos(word, c) AS INT))), '')"
#: Best term at each place; the pass from left to right; runs of Latin words; common blocks of run and term, the longest first, then what lies left and right of it.
CORRECTED = f"""WITH RECURSIVE {LISTED}, u AS ({MISSPELT}),
    p AS (SELECT conv_id, seq, kb_id, text, pos, substring(text, pos + 1, 1) AS l FROM (SELECT *, CAST(unnest(range(0, length(text))) AS BIGINT) AS pos FROM u WHERE regexp_matches(text, '[一-鿿]')) x),
    j AS MATERIALIZED (SELECT conv_id, seq, pos, n, word, substring(text, pos + 1, n) AS f, r FROM p JOIN (SELECT *, substring(word, 1, 1) AS l FROM d WHERE regexp_matches(word, '^[一-鿿]')) d USING (kb_id, l) WHERE pos + n <= length(text)),
    m AS (SELECT *, 1 - levenshtein({LETTERED.format("f")}, {LETTERED.format("word")}) / n AS s FROM j),
    e AS (SELECT *, row_number() OVER (PARTITION BY conv_id, seq ORDER BY pos) AS i FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, seq, pos ORDER BY f = word DESC, s DESC, n DESC, r) AS best FROM m WHERE s >= 0.75) x WHERE best = 1),
    w AS (SELECT conv_id, seq, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS done, '' AS o, '' AS fixes FROM u UNION ALL
      SELECT w.conv_id, w.seq, e.i, CASE WHEN pos >= done THEN pos + n ELSE done END, CASE WHEN pos >= done THEN concat(o, substring(text, done + 1, pos - done), word) ELSE o END,
        CASE WHEN pos >= done AND f <> word THEN concat(fixes, f, '>', word, '|', CAST(CAST(round(100 * s) AS INT) AS VARCHAR), ';') ELSE fixes END FROM w JOIN e ON e.conv_id = w.conv_id AND e.seq = w.seq AND e.i = w.i + 1 JOIN u ON u.conv_id = w.conv_id AND u.seq = w.seq),
    h AS (SELECT conv_id, seq, kb_id, fixes, concat(o, substring(text, done + 1)) AS text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, seq ORDER BY i DESC) AS z FROM w) x JOIN u USING (conv_id, seq) WHERE z = 1),
    g AS (SELECT conv_id, seq, kb_id, unnest(range(1, len(runs) + 1)) AS i, unnest(runs) AS run FROM (SELECT *, regexp_extract_all(text, '{PHRASE}') AS runs FROM h) x),
    k AS (SELECT *, rtrim(run) AS v, lower(replace(run, ' ', '')) AS key FROM g WHERE length(rtrim(run)) >= 4),
    l AS (SELECT kb_id, lower(replace(word, ' ', '')) AS term, arg_max(word, r) AS word FROM d WHERE ascii(word) < 128 AND length(word) >= 3 GROUP BY ALL),
    c AS (SELECT kb_id, key, term, word FROM (SELECT DISTINCT kb_id, key FROM k ANTI JOIN l ON k.kb_id = l.kb_id AND k.key = l.term) x JOIN l USING (kb_id) WHERE abs(length(key) - length(term)) <= 0.22 * (length(key) + length(term)) AND levenshtein(key, term) <= 0.22 * (length(key) + length(term))),
    q AS (SELECT DISTINCT key AS x, term AS y FROM c UNION SELECT term, key FROM c),
    b AS (SELECT x, y, x AS a, y AS b, CAST(0 AS BIGINT) AS m FROM q UNION ALL
      SELECT x, y, CASE side WHEN 0 THEN substring(a, 1, i - 1) ELSE substring(a, i + k) END, CASE side WHEN 0 THEN substring(b, 1, strpos(b, substring(a, i, k)) - 1) ELSE substring(b, strpos(b, substring(a, i, k)) + k) END, CASE side WHEN 0 THEN k ELSE 0 END
      FROM (SELECT x, y, a, b, CAST(floor(v / 100) AS BIGINT) AS k, 99 - v % 100 AS i FROM (SELECT x, y, a, b, list_max(flatten(list_transform(range(1, length(a) + 1), lambda i: list_transform(range(1, length(a) - i + 2), lambda k: CASE WHEN strpos(b, substring(a, i, k)) > 0 THEN 100 * k + 99 - i END)))) AS v FROM b WHERE a <> '' AND b <> '') z WHERE v IS NOT NULL) z CROSS JOIN (SELECT 0 AS side UNION ALL SELECT 1) sides),
    s AS (SELECT x, y, 2 * sum(m) / (length(x) + length(y)) AS s FROM b GROUP BY x, y),
    best AS (SELECT kb_id, key, word, shown FROM (SELECT kb_id, key, word, shown.s AS shown, row_number() OVER (PARTITION BY kb_id, key ORDER BY ranked.s DESC, term DESC) AS z FROM c JOIN s ranked ON ranked.x = term AND ranked.y = key JOIN s shown ON shown.x = key AND shown.y = term WHERE ranked.s >= 0.78) x WHERE z = 1),
    n AS (SELECT conv_id, seq, string_agg(concat(v, '>', word, '|', CAST(CAST(round(100 * shown) AS INT) AS VARCHAR), ';'), '' ORDER BY i) AS fixes FROM k JOIN best USING (kb_id, key) GROUP BY conv_id, seq),
    y AS (SELECT conv_id, seq, string_agg(coalesce(word || substring(g.run, length(v) + 1), g.run), chr(1) ORDER BY i) AS runs FROM g LEFT JOIN (SELECT * FROM k JOIN best USING (kb_id, key)) x USING (conv_id, seq, kb_id, i) GROUP BY conv_id, seq)
    SELECT conv_id, seq, concat(h.fixes, coalesce(n.fixes, '')) AS fixes, CASE WHEN runs IS NULL THEN h.text ELSE array_to_string(list_transform(string_split_regex(h.text, '{PHRASE}'), lambda x, i: concat(x, coalesce(string_split(runs, chr(1))[i], ''))), '') END AS text FROM h LEFT JOIN n USING (conv_id, seq) LEFT JOIN y USING (conv_id, seq)"""
R.add("correct_terms", lambda s: correct_terms(s.sql(MISSPELT), hotword_dictionary(s["v_tag"], s.sql(GLOSSARY))).select("conv_id", "seq", F.expr("array_join(transform(fixes, x -> concat(x.from, '>', x.to, '|', cast(round(100 * x.score) as int), ';')), '')").alias("fixes"), "text"), CORRECTED)
R.add("display_turns", lambda s: display_turns(_rows(s).withColumn("clean_text", F.expr("if(seq % 3 = 0, ' ', concat('> ', text))"))).select("conv_id", "seq", F.col("shown").alias("text")),
      f"WITH {KEPT} SELECT conv_id, n AS seq, CASE WHEN n % 3 = 0 THEN text ELSE concat('> ', text) END AS text FROM u")
