"""A stored inverted index for BM25 with blocks that are pruned by their greatest impact.

Chunks of a base that are likely to share words (same least short word near the start, like length)
form groups of about ``GROUP`` chunks. A block holds the postings of one term in one group, with the
greatest weight that any of them gives. For a query the blocks' greatest weights add up to a bound
for every group; the groups with the highest bounds are scored first, their k-th best score is a
threshold, and of all other groups only those whose bound reaches it are scored. So the result is
that of a full scan.

Tables: blocks(kb_id, term, grp, n, best, postings) sorted by base and term, heads (the same without
postings, so bounds don't read them), terms(kb_id, term, df, idf), bases(kb_id, n, avgdl). ``write``
keeps them in a folder, ``read`` opens them; text is only taken apart when the index is built.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import materialise

K1, B = 1.2, 0.75
#: Runs of letters and digits; Chinese characters (HAN) are tokens of their own.
TOKEN, HAN = r"[\p{L}\p{N}]+", r"([㐀-䶿一-鿿豈-﫿])"
#: Chunks of a group, about; groups scored first for each query; classes of first words; characters that tell the class.
GROUP, FIRST, CLASSES, SHOWN = 64, 12, 16, 600
#: Scores are rounded to so many decimals, since sums of the same parts in another order differ in the last bits.
DECIMALS, SLACK = 9, 1e-8


def spaced(text: Column) -> Column:
    """Lower-cased text with blanks around Chinese characters."""
    return F.regexp_replace(F.lower(text), HAN, " $1 ")


def tokens(text: Column) -> Column:
    """Lower-cased words in order; null has none."""
    return F.coalesce(F.regexp_extract_all(spaced(text), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


@dataclass
class LexicalIndex:
    blocks: DataFrame
    heads: DataFrame
    terms: DataFrame
    bases: DataFrame

    def write(self, folder: str) -> None:
        for name in ("blocks", "heads", "terms", "bases"):
            getattr(self, name).write.mode("overwrite").parquet(f"{folder}/{name}")

    @classmethod
    def read(cls, spark: SparkSession, folder: str) -> LexicalIndex:
        return cls(*(spark.read.parquet(f"{folder}/{name}") for name in ("blocks", "heads", "terms", "bases")))


def likeness(text: Column) -> Column:
    """Number of the class of texts that are likely to share words: least hash of a short word near the start, and length."""
    short = F.filter(tokens(F.substring(text, 1, SHOWN)), lambda x: F.length(x) <= 3)
    word = F.coalesce(F.array_min(F.transform(short, lambda x: F.xxhash64(x))), F.lit(0))
    return F.pmod(word, F.lit(CLASSES)).cast("int") * 64 + F.floor(2 * F.log2(F.length(text) + F.lit(1))).cast("int")


def build(chunks: DataFrame, group: int = GROUP, only: DataFrame | None = None) -> LexicalIndex:
    """The index of chunks(kb_id, pk, text); a chunk without words counts for its base's number and mean length only.

    ``only``(kb_id, term) leaves other terms out, for an index that serves one set of queries.
    """
    rows = chunks.select("kb_id", "pk", F.coalesce("text", F.lit("")).alias("text")).withColumn("class", likeness(F.col("text")))
    words = rows.select("kb_id", "class", "pk", tokens(F.col("text")).alias("w")).withColumn("dl", F.size("w"))
    n_words = F.regexp_count(spaced(F.col("text")), F.lit(TOKEN))
    counted = materialise(rows.groupBy("kb_id", "class").agg(F.count("*").alias("n"), F.sum(n_words).alias("words")), "classes")
    bases = counted.groupBy("kb_id").agg(F.sum("n").alias("n"), (F.sum("words") / F.sum("n")).alias("avgdl"))
    slots = counted.select("kb_id", "class", F.ceil(F.col("n") / group).alias("slots"))
    grp = F.xxhash64("class", F.pmod(F.xxhash64("pk"), F.col("slots"))).alias("grp")
    each = words.join(slots, ["kb_id", "class"]).select("kb_id", grp, "pk", "dl", F.explode("w").alias("term"))
    each = (each if only is None else each.join(only.distinct(), ["kb_id", "term"], "left_semi")).repartition("kb_id", "term", "grp")
    held = each.groupBy("kb_id", "term", "grp", "pk").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    held = held.groupBy("kb_id", "term", "grp").agg(F.collect_list(F.struct("pk", "tf", "dl")).alias("p")).join(bases, "kb_id")
    weight = lambda x: x["tf"] * (K1 + 1) / (x["tf"] + K1 * (1 - B + B * x["dl"] / F.col("avgdl")))
    held = held.select("kb_id", "term", "grp", F.size("p").alias("n"), F.transform("p", lambda x: F.struct(x["pk"].alias("pk"), weight(x).alias("weight"))).alias("postings"))
    blocks = materialise(held.withColumn("best", F.array_max(F.transform("postings", lambda x: x["weight"]))).sortWithinPartitions("kb_id", "term"), "postings")
    heads = blocks.select("kb_id", "term", "grp", "n", "best")
    df = heads.groupBy("kb_id", "term").agg(F.sum("n").alias("df")).join(bases, "kb_id")
    terms = df.select("kb_id", "term", "df", F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    return LexicalIndex(blocks, heads, materialise(terms, "terms"), bases)


def query_words(queries: DataFrame) -> DataFrame:
    """(query_id, kb_id, term): the distinct words of every query(query_id, kb_id, text)."""
    return queries.select("query_id", "kb_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))


def asked_terms(queries: DataFrame, index: LexicalIndex) -> DataFrame:
    """(query_id, kb_id, term, idf): the words of every query that its base knows."""
    return query_words(queries).join(index.terms.select("kb_id", "term", "idf"), ["kb_id", "term"])


def bounds(asked: DataFrame, index: LexicalIndex) -> DataFrame:
    """(query_id, kb_id, grp, bound): the most that any chunk of a group can score."""
    return asked.join(index.heads, ["kb_id", "term"]).groupBy("query_id", "kb_id", "grp").agg(F.sum(F.col("idf") * F.col("best")).alias("bound"))


def scores(asked: DataFrame, groups: DataFrame, index: LexicalIndex) -> DataFrame:
    """(query_id, pk, score) of all chunks of the groups(query_id, kb_id, grp); blocks that nobody asks for stay in the scan."""
    wanted = asked.join(groups.select("query_id", "kb_id", "grp"), ["query_id", "kb_id"])
    hits = wanted.join(index.blocks.select("kb_id", "term", "grp", "postings"), ["kb_id", "term", "grp"]).select("query_id", "idf", F.explode("postings").alias("p"))
    return hits.groupBy("query_id", F.col("p.pk").alias("pk")).agg(F.round(F.sum(F.col("idf") * F.col("p.weight")), DECIMALS).alias("score"))


def ranked(hits: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "pk"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k)


def search(queries: DataFrame, index: LexicalIndex, k: int, first: int = FIRST) -> DataFrame:
    """(query_id, pk, score, rank): BM25 top-k of every query in its base, ties to the smaller pk."""
    asked, groups = plan(queries, index)
    order = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("bound"), "grp"))
    groups = groups.withColumn("turn", order)
    early = materialise(ranked(scores(asked, groups.filter(F.col("turn") <= first), index), k), "early")
    rest = scores(asked, later(groups, early, k, first), index)
    return ranked(early.drop("rank").unionByName(rest), k)


def plan(queries: DataFrame, index: LexicalIndex) -> tuple[DataFrame, DataFrame]:
    """The queries' known terms and the bounds of their groups."""
    asked = materialise(asked_terms(queries, index), "asked")
    return asked, materialise(bounds(asked, index), "bounds")


def later(groups: DataFrame, early: DataFrame, k: int, first: int = FIRST) -> DataFrame:
    """Groups that aren't scored yet and whose bound reaches the k-th score found so far."""
    least = early.filter(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    return groups.filter(F.col("turn") > first).join(least, "query_id", "left").filter(F.col("least").isNull() | (F.col("bound") >= F.col("least") - SLACK))


def blocks_read(queries: DataFrame, index: LexicalIndex, k: int, first: int = FIRST) -> tuple[int, int]:
    """How many blocks a search scores, and how many a full scan of the queries' terms would."""
    asked, groups = plan(queries, index)
    groups = groups.withColumn("turn", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("bound"), "grp")))
    early = ranked(scores(asked, groups.filter(F.col("turn") <= first), index), k)
    read = reduce(DataFrame.unionByName, (x.select("query_id", "kb_id", "grp") for x in (groups.filter(F.col("turn") <= first), later(groups, early, k, first))))
    pairs = asked.join(index.heads, ["kb_id", "term"])
    return pairs.join(read, ["query_id", "kb_id", "grp"], "left_semi").count(), pairs.count()
