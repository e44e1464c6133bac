"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Every text gets its base measures and, from them, one signal per rule (higher is worse). Labelled
rows decide the cutoffs of each stratum (language). A path is one rule or all of them together; its
steps tighten the cutoffs of its rules at once, in a fixed order, and a text is rejected at the first
step at which one of its signals exceeds the cutoff. Steps are tested from loose to tight: one passes
if the exact binomial probability of seeing so few rejected good texts, were the true share of
rejected good texts ``risk``, is at most ``doubt / (strata * paths)``; the first that fails ends the
path. So with probability 1 - ``doubt`` no passing step of any path rejects more than ``risk`` of the
good texts of its stratum, whichever is chosen. The one with the best gain (share of bad texts
rejected less ``price`` times that of good ones) is taken, if the gain is positive.

Cases: a null text counts as empty: no words, base_failed. Strata without enough labels, and rows
whose language has none, have the base rules only. Without labels nothing but the base rules holds.
Every language with labels takes part and counts in the correction. Labels of a doc_id that
disagree are left out. Equal rows each give a row; a null doc_id is kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, table

RISK, DOUBT, PRICE = 0.03, 0.05, 5.0
#: Signal of each rule (a measure and what it is divided by), and its candidate cutoffs from loose to tight.
RULES = {
    "symbols": ("n_symbols", "word_chars", [0.5, 0.3, 0.2, 0.15, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02, 0.01]),
    "repeats": ("n_repeat_words", "n_words", [0.28, 0.25, 0.22, 0.2, 0.17, 0.15, 0.12, 0.1, 0.07, 0.05]),
    "duplicate_lines": ("n_dup_lines", "n_lines", [0.9, 0.75, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1]),
    "capitals": ("n_capitals", "word_chars", [0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1]),
    "exclamations": ("n_exclamations", "n_words", [1.0, 0.8, 0.6, 0.4, 0.3, 0.2, 0.1, 0.05]),
    "shortness": ("1", "n_words", [1 / 22, 1 / 25, 1 / 30, 1 / 35, 1 / 40, 1 / 50]),
}
#: One path for each rule and one for all of them.
PATHS = {**{rule: (rule,) for rule in RULES}, "all": tuple(RULES)}
BREAKS = r"[\\x20\\x09-\\x0D]"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measure(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Base measures of every text, besides n_lines, n_capitals and n_exclamations.

    Windows of eight words are compared by 64-bit hashes built in three doublings; sorting them
    within the row finds the repeated ones. Everything stays inside the row, so nothing is shuffled.
    Each array is used by name at least twice or as an argument only, never inside a lambda, so
    that it is computed once.
    """
    keep = keep or []
    row = docs.select(*(F.col(c).alias(c) for c in keep), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_t"))
    row = row.withColumns({
        "_w": F.expr(rf"array_remove(split(_t, '{BREAKS}+'), '')"),
        "_l": F.expr(rf"filter(split(_t, '\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')"),
        "word_chars": F.expr(rf"cast(length(regexp_replace(_t, '{BREAKS}+', '')) as long)"),
        "n_symbols": F.expr("cast(length(_t) - length(translate(_t, '#*$%&|<>', '')) as long)"),
        "n_capitals": F.expr("cast(length(_t) - length(translate(_t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) as long)"),
        "n_exclamations": F.expr("cast(length(_t) - length(translate(_t, '!?', '')) as long)"),
    })
    measured = [*keep, "word_chars", "n_symbols", "n_capitals", "n_exclamations"]
    row = row.select(*measured, F.expr("cast(size(_w) as long)").alias("n_words"), F.expr("cast(size(_l) as long)").alias("n_lines"),
                     F.expr("cast(size(_l) - size(array_distinct(_l)) as long)").alias("n_dup_lines"), F.expr("transform(_w, w -> xxhash64(w))").alias("_h"))
    measured += ["n_words", "n_lines", "n_dup_lines"]
    for step in (1, 2, 4):
        row = row.select(*measured, F.expr(f"zip_with(_h, slice(_h, {step + 1}, greatest(size(_h), 1)), (a, b) -> xxhash64(a, b))").alias("_h"))
    row = row.withColumn("_h", F.expr("if(n_words < 8, slice(_h, 1, 0), slice(_h, 1, cast(greatest(n_words - 7, 0) as int)))"))
    row = row.withColumn("_p", F.expr("if(size(array_distinct(_h)) < size(_h), sort_array(transform(_h, (h, i) -> struct(h, i))), null)"))
    row = row.withColumn("_s", F.expr("sort_array(array_distinct(flatten(transform(filter(zip_with(_p, slice(_p, 2, size(_p)), (a, b) -> struct(a, b)), x -> x.a.h = x.b.h), x -> array(x.a.i, x.b.i)))))"))
    covered = "aggregate(zip_with(_s, slice(_s, 2, greatest(size(_s), 1)), (a, b) -> least(8, coalesce(b - a, 8))), 0L, (n, x) -> n + x)"
    return row.select(*measured, F.expr(f"coalesce({covered}, 0L)").alias("n_repeat_words"))


def signal(rule: str) -> Column:
    part, whole, _ = RULES[rule]
    return F.expr(f"try_divide({part}, {whole})")


def _n_exceeded(rule: str) -> Column:
    """How many of the rule's cutoffs its signal exceeds."""
    value = signal(rule)
    return F.size(F.filter(F.array(*map(F.lit, RULES[rule][2])), lambda cut: value > cut))


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for x >= 1: Stirling's series after a shift by ten."""
    y = x + 10
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    shift = F.log(x)
    for i in range(1, 10):
        shift = shift + F.log(x + i)
    return series - shift


def binomial_tail(k: str, n: str, p: float) -> Column:
    """P(X <= k) for X from Binomial(n, p), summed down from k; 1 where k is not below the mean.

    Below the mean the terms shrink at least geometrically as they go down, so a multiple of the
    standard deviation of them is enough.
    """
    kc, nc = F.col(k).cast("double"), F.col(n).cast("double")
    top = log_gamma(nc + 1) - log_gamma(kc + 1) - log_gamma(nc - kc + 1) + kc * math.log(p) + (nc - kc) * math.log1p(-p)
    steps = f"sequence(0L, least(cast({k} as long), cast(40 * sqrt({n}) + 100 as long)))"
    total = F.expr(f"aggregate({steps}, struct(1D as term, 0D as total), (s, j) -> struct(s.term * ({k} - j) * {1 - p}D / (({n} - {k} + j + 1) * {p}D) as term, s.total + s.term as total)).total")
    return F.when(kc >= nc * p, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.exp(top) * total))


def thresholds(measures: DataFrame, labels: DataFrame, risk: float = RISK, doubt: float = DOUBT, price: float = PRICE) -> DataFrame:
    """(stratum, cutoffs map<rule, double>): at most one row of each stratum.

    Rows are counted by the step at which each path rejects them before anything is compared.
    """
    good = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("doc_id is not null and quality in (0, 1)")
    good = good.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.min("quality").alias("_least")).filter("quality = _least").drop("_least")
    # A signal exceeds the tightest cutoffs first, which are the last steps.
    first = {rule: F.when(_n_exceeded(rule) > 0, F.lit(len(RULES[rule][2]) + 1) - _n_exceeded(rule)) for rule in RULES}
    rejected = F.array(*(F.struct(F.lit(path).alias("path"), F.array_min(F.array(*(first[r] for r in rules))).alias("step")) for path, rules in PATHS.items()))
    seen = measures.filter("not base_failed and stratum is not null").select("doc_id", "stratum", F.explode(rejected).alias("x")).join(good, "doc_id")
    counts = seen.groupBy("stratum", "quality", "x.path", "x.step").agg(F.count("*").alias("rows"))
    rows = lambda q: F.sum(F.when(F.col("quality") == q, F.col("rows")).otherwise(0))
    size = counts.groupBy("stratum", "path").agg(rows(1).alias("good"), rows(0).alias("bad"))
    strata = size.agg(F.countDistinct("stratum").alias("n_strata"))
    at_step = counts.filter("step is not null").groupBy("stratum", "path", "step").agg(rows(1).alias("good_here"), rows(0).alias("bad_here"))
    steps = F.create_map(*(x for path, rules in PATHS.items() for x in (F.lit(path), F.lit(max(len(RULES[r][2]) for r in rules)))))
    grid = size.crossJoin(F.broadcast(strata))  # one row
    grid = grid.select("*", F.explode(F.sequence(F.lit(1), steps[F.col("path")])).alias("step")).join(at_step, ["stratum", "path", "step"], "left").na.fill(0, ["good_here", "bad_here"])
    along = W.partitionBy("stratum", "path").orderBy("step")
    grid = grid.withColumns({"good_lost": F.sum("good_here").over(along), "bad_lost": F.sum("bad_here").over(along)})
    passes = binomial_tail("good_lost", "good", risk) <= F.lit(doubt) / (F.col("n_strata") * len(PATHS))
    grid = grid.withColumn("fails", F.sum(F.when(passes, 0).otherwise(1)).over(along))
    gain = F.try_divide("bad_lost", "bad") - price * F.try_divide("good_lost", "good")
    # Of equal gains the looser step, then the first path by name.
    best = grid.filter("fails = 0").withColumn("gain", gain).filter("gain > 0").groupBy("stratum").agg(F.min(F.struct(-F.col("gain"), "step", "path")).alias("x")).select("stratum", "x.path", "x.step")
    chosen = F.array(*(F.when(F.array_contains(F.array(*(F.lit(p) for p, rules in PATHS.items() if rule in rules)), F.col("path")), F.struct(F.lit(rule).alias("rule"), F.element_at(F.array(*map(F.lit, cuts)), F.least("step", F.lit(len(cuts)))).alias("cutoff"))) for rule, (_, _, cuts) in RULES.items()))
    return best.select("stratum", F.map_from_entries(F.array_compact(chosen)).alias("cutoffs"))


def apply_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", **risks: float) -> DataFrame:
    """(doc_id, measures, base_failed, kept, failed_rules) of every row.

    The measures are written once as a table, so that texts are read once; only they meet the labels.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(stratum).cast("string").alias("stratum"), "text")
    rows = measure(rows, ["doc_id", "stratum"]).withColumn("base_failed", F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words"))
    rows = materialise(rows, "measures")
    limits = materialise(thresholds(rows, labels, **risks).withColumnRenamed("stratum", "_stratum"), "limits")  # its size decides how it is joined
    rows = rows.join(limits, F.col("stratum") == F.col("_stratum"), "left")
    broken = F.array_compact(F.array(*(
        F.when(signal(rule) > F.col("cutoffs")[rule], F.lit(rule)) for rule in RULES
    )))
    rows = rows.withColumn("failed_rules", broken)
    return rows.select("doc_id", *MEASURES, "base_failed", (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"), "failed_rules")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("failed_rules")
