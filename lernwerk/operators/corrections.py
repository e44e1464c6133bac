"""Correction of misspelt terms in transcripts as joins with an index of the dictionary."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X

#: No term is longer than this; the dictionary (K12) has no longer ones.
LONGEST = 20
# Fixed value: a run of Latin words that is compared as a whole.
PHRASE = r"[A-Za-z][A-Za-z0-9+#.\- ]{2,24}"
TEXT = ["kb_id", "digest"]


def correct_terms(rows: DataFrame, dictionary: DataFrame, han: float = 0.75, latin: float = 0.78) -> DataFrame:
    """rows(conv_id, seq, kb_id, text) with corrected text and the fixes made, by dictionary(kb_id, words).

    Each distinct text of a base is corrected once. Chinese terms come first: from left to right,
    where one begins it is left, else the closest one of the same length and first character takes
    the place of what stands there. Then each run of Latin words is compared with the Latin terms,
    blanks left out. A missing text counts as empty; a base without dictionary changes nothing.
    """
    words = dictionary.select("kb_id", F.posexplode("words").alias("rank", "word")).filter(F.length("word").between(2, LONGEST))
    own = rows.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("digest", F.unhex(F.md5("text")))
    texts = own.select(*TEXT, "text").distinct()
    first = replaced_han(texts, chosen(han_matches(texts, words, han)))
    fixed = replaced_latin(first, latin_matches(first, words, latin))
    joined = own.join(fixed.select(*TEXT, F.col("text").alias("_text"), F.col("fixes").alias("_fixes")), TEXT, "left")
    none = F.expr("cast(array() as array<struct<from: string, to: string, score: double>>)")
    return joined.select("conv_id", "seq", "kb_id", F.coalesce("_text", "text").alias("text"), F.coalesce("_fixes", none).alias("fixes"))


def han_matches(texts: DataFrame, words: DataFrame, least: float) -> DataFrame:
    """(kb_id, digest, at, n, word, found, score): the best term at each place, counted from 0.

    Terms are listed by base and first character, and only places with that character meet them; the
    edit distance stops at what the similarity allows.
    """
    letters = texts.select(*TEXT, X.all_matches(F.col("text"), "(?s).").alias("letters"))
    ahead = f"filter(transform(letters, (c, i) -> if(c rlike '{X.HAN}', struct(i as at, array_join(slice(letters, i + 1, {LONGEST}), '') as ahead), null)), x -> x is not null)"
    places = letters.select(*TEXT, F.explode(F.expr(ahead)).alias("x")).select(*TEXT, "x.at", "x.ahead", F.substring("x.ahead", 1, 1).alias("letter"))
    index = words.filter(F.col("word").rlike("^" + X.HAN)).select("kb_id", "rank", "word", F.substring("word", 1, 1).alias("letter"), F.length("word").alias("n"))
    met = places.join(index, ["kb_id", "letter"]).filter("n <= length(ahead)").withColumn("found", F.expr("substring(ahead, 1, n)"))
    met = met.withColumn("edits", F.expr(f"levenshtein(found, word, cast(floor({1 - least} * n + 1e-9) as int))")).filter("edits >= 0")
    met = met.withColumn("score", 1 - F.col("edits") / F.col("n"))
    order = F.struct((F.col("edits") == 0).alias("exact"), F.col("score"), F.col("n"), (-F.col("rank")).alias("rank"))
    return met.groupBy(*TEXT, "at").agg(F.max_by(F.struct("n", "word", "found", "score"), order).alias("x")).select(*TEXT, "at", "x.*")


def chosen(matches: DataFrame) -> DataFrame:
    """The matches that a pass from left to right takes: each begins where the one taken before has ended, or later.

    The pass runs within groups of matches that overlap, since a match that overlaps none before it is always taken.
    """
    order = W.partitionBy(*TEXT).orderBy("at")
    reach = F.max(F.col("at") + F.col("n")).over(order.rowsBetween(W.unboundedPreceding, -1))
    apart = matches.withColumn("begins", F.coalesce(F.col("at") >= reach, F.lit(True)).cast("int")).withColumn("group", F.sum("begins").over(order))
    lists = apart.groupBy(*TEXT, "group").agg(F.array_sort(F.collect_list(F.struct("at", "n", "word", "found", "score"))).alias("all"))
    taken = F.expr("""aggregate(all, struct(0 as done, slice(all, 1, 0) as taken), (s, x) -> if(x.at >= s.done, struct(x.at + x.n as done, concat(s.taken, array(x)) as taken), s), s -> s.taken)""")
    return lists.select(*TEXT, F.explode(taken).alias("x")).select(*TEXT, "x.*")


def replaced_han(texts: DataFrame, taken: DataFrame) -> DataFrame:
    """The texts with the taken matches that aren't exact put in, and fixes in order."""
    wrong = taken.filter("found <> word").withColumn("begin", F.coalesce(F.lag(F.col("at") + F.col("n")).over(W.partitionBy(*TEXT).orderBy("at")), F.lit(0)))
    lists = wrong.groupBy(*TEXT).agg(F.array_sort(F.collect_list(F.struct("at", "n", "begin", "word", "found", "score"))).alias("changes"))
    rows = texts.join(lists, TEXT, "left").withColumn("letters", F.when(F.col("changes").isNotNull(), X.all_matches(F.col("text"), "(?s).")))
    parts = "transform(changes, x -> concat(array_join(slice(letters, x.begin + 1, x.at - x.begin), ''), x.word))"
    rest = "array_join(slice(letters, element_at(changes, -1).at + element_at(changes, -1).n + 1, size(letters)), '')"
    fixes = "coalesce(transform(changes, x -> struct(x.found as from, x.word as to, round(x.score, 2) as score)), cast(array() as array<struct<from: string, to: string, score: double>>))"
    return rows.select(*TEXT, F.expr(f"if(changes is null, text, concat(array_join({parts}, ''), {rest}))").alias("text"), F.expr(fixes).alias("fixes"))


def latin_matches(texts: DataFrame, words: DataFrame, least: float) -> DataFrame:
    """(kb_id, digest, i, word, score) of the runs of Latin words, counted from 0, that a term is near to.

    A term as near as 0.78 shares two letters in a row with the run: M common letters of a + b stand
    in at most a + b - 2M + 1 pieces. So distinct runs and terms meet on pairs of letters, and only
    what lengths and edit distance leave is compared in full.
    """
    runs = texts.select(*TEXT, F.posexplode(X.all_matches(F.col("text"), PHRASE)).alias("i", "run")).filter(F.length(F.rtrim("run")) >= 4)
    runs = runs.select(*TEXT, "i", F.lower(F.replace("run", F.lit(" "), F.lit(""))).alias("key"))
    pool = words.filter(F.col("word").rlike(r"^[\x00-\x7F]") & (F.length("word") >= 3)).withColumn("term", F.lower(F.replace("word", F.lit(" "), F.lit(""))))
    pool = pool.groupBy("kb_id", "term").agg(F.max_by("word", "rank").alias("word"))
    keys = runs.select("kb_id", "key").distinct().join(pool.select("kb_id", F.col("term").alias("key")), ["kb_id", "key"], "left_anti")
    pairs_of = lambda c: F.explode(F.expr(f"array_distinct(transform(sequence(1, greatest(length({c}) - 1, 1)), i -> substring({c}, i, 2)))")).alias("pair")
    near = keys.select("kb_id", "key", pairs_of("key")).join(pool.select("kb_id", "term", "word", pairs_of("term")), ["kb_id", "pair"])
    both = F.length("key") + F.length("term")
    near = near.filter(2 * F.least(F.length("key"), F.length("term")) >= least * both - 1e-9).select("kb_id", "key", "term", "word").distinct()
    near = near.filter(F.expr(f"levenshtein(key, term, cast(floor({1 - least} * (length(key) + length(term)) + 1e-9) as int)) >= 0"))

    @F.pandas_udf("rank double, shown double")
    def alike(key: pd.Series, term: pd.Series) -> pd.DataFrame:
        ratio = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()
        return pd.DataFrame([(ratio(t, k), ratio(k, t)) for k, t in zip(key, term, strict=True)], columns=["rank", "shown"], dtype="float64")

    scored = near.withColumn("x", alike("key", "term")).filter(F.col("x.rank") >= least)
    best = scored.groupBy("kb_id", "key").agg(F.max_by(F.struct("word", F.col("x.shown").alias("score")), F.struct("x.rank", "term")).alias("x"))
    return runs.join(best, ["kb_id", "key"]).select(*TEXT, "i", "x.word", "x.score")


def replaced_latin(texts: DataFrame, matches: DataFrame) -> DataFrame:
    """The texts with the matched runs replaced, and fixes after those made before."""
    lists = matches.groupBy(*TEXT).agg(F.map_from_entries(F.collect_list(F.struct("i", F.struct("word", "score")))).alias("by"))
    rows = texts.join(lists, TEXT, "left").withColumns({"runs": F.when(F.col("by").isNotNull(), X.all_matches(F.col("text"), PHRASE)), "gaps": F.when(F.col("by").isNotNull(), F.split("text", PHRASE, -1))})
    run = "if(by[i] is null, coalesce(get(runs, i), ''), concat(by[i].word, substring(runs[i], length(rtrim(runs[i])) + 1)))"
    fixes = "transform(array_sort(map_keys(by)), i -> struct(rtrim(runs[i]) as from, by[i].word as to, round(by[i].score, 2) as score))"
    return rows.select(*TEXT, F.expr(f"if(by is null, text, array_join(transform(gaps, (g, i) -> concat(g, {run})), ''))").alias("text"),
                       F.expr(f"if(by is null, fixes, concat(fixes, {fixes}))").alias("fixes"))
