"""Mixes sources to target weights, in blocks of words drawn by shards.

A source's words stand one after the other and are packed into blocks of fixed length. Every output
shard draws how many blocks it takes from each source, multinomially by the sources' targets (first
for bins of sources, then inside the bins, so no task needs a list of all sources). A running sum
over shards numbers a source's draws. Draws beyond what a source's target needs are spread over its
shards by a permutation and passed on to the sources that fell short, number by number, so each
source gives exactly its share. The i-th draw of a source takes, in its i div n-th round over its n
blocks, the block that a pseudorandom permutation of that round has at i mod n; blocks and documents
are joined by index. The last draw is cut, so the words taken are the target's, rounded.

Targets: sources by code point, null last, weigh 1, 2, 3, repeating; a target stops at ``most`` times
its source's size. The rest is reshared by weight, which ends at min(most x size, level x weight)
for one level; each round raises the level by two sums over the sources. No word is taken more than
``most`` times: whole rounds take each word once, and the last partial round at most once.

Results depend on the rows and the seed, not on partitions. Documents of a source are ordered by a
hash bucket, so a source with a third of all rows is numbered by many tasks.

Cases: a null text has no words; size 0 takes 0; a null doc_id is kept; '' and null are sources of
their own; equal rows take their own words; an empty table gives no rows; other columns are ignored;
a long text is many blocks. Ties don't matter: equal rows are alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, table
from .token_alignment import mixed

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, MOST, SEED = (1, 2, 3), 3, 11
#: Words of a block; blocks of a shard; documents of a source numbered by one task, about.
BLOCK, SHARD, BUCKET = 128, 4_096, 1_000
#: Shards whose draws are summed together; bins of sources at most.
STRIDE, BINS = 1_024, 4_096


def permuted(index: np.ndarray, size: np.ndarray, *seeds: np.ndarray | int, back: bool = False) -> np.ndarray:
    """The place of each index under a pseudorandom permutation of 0 .. size - 1 that the seeds choose; ``back``: the index of each place.

    Four rounds of a Feistel network over the least even number of bits; places beyond the size are permuted on.
    """
    size = np.asarray(size, dtype=np.uint64) + np.zeros(len(index), dtype=np.uint64)
    key = np.zeros(len(index), dtype=np.uint64)
    for k, s in enumerate(seeds):
        key = mixed(key ^ np.asarray(s).astype(np.uint64), k)
    half = np.maximum(1, np.ceil(np.ceil(np.log2(np.maximum(size, 2).astype(float) + 1)) / 2)).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, left = np.asarray(index).astype(np.uint64), np.arange(len(index))
    while len(left):
        h, m, k = half[left], mask[left], key[left]
        high, low = out[left] >> h, out[left] & m
        for turn in range(4):
            if back:
                high, low = low ^ (mixed(high ^ k, 4 - turn) & m), high
            else:
                high, low = low, high ^ (mixed(low ^ k, turn + 1) & m)
        out[left] = high << h | low
        left = left[out[left] >= size[left]]
    return out.astype(np.int64)


def running(rows: DataFrame, part: str, order: str, value: str, out: str) -> DataFrame:
    """Adds the sum of ``value`` over all rows before; parts follow each other, rows are ordered inside parts."""
    before = W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    parts = rows.groupBy(part).agg(F.sum(value).alias("_part")).withColumn("_before", F.coalesce(F.sum("_part").over(before), F.lit(0)))
    own = F.coalesce(F.sum(value).over(W.partitionBy(part).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn(out, own).join(parts.drop("_part"), part).withColumn(out, F.col(out) + F.col("_before")).drop("_before")


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, row): words of every document; ``row`` is a hash of its id, source and text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    return rows.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("doc_id", "source", "text").alias("row"))


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """(part, no, source, source_size, weight): sources numbered by code point, null last, in parts that follow each other."""
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("last", F.col("source").isNull())
    sums = materialise(sums.repartitionByRange("last", "source").sortWithinPartitions("last", "source").withColumn("part", F.spark_partition_id()), "sources")
    inside = F.row_number().over(W.partitionBy("part").orderBy("last", "source")).cast("long")
    numbered = running(sums.withColumn("at", inside).withColumn("one", F.lit(1)), "part", "at", "one", "no")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("no") % len(WEIGHTS) + 1).cast("int"))
    return materialise(numbered.select("part", F.col("no").cast("long").alias("no"), "source", "source_size", weight.alias("weight")), "ranks")


def with_targets(sources: DataFrame, most: int = MOST) -> DataFrame:
    """Adds ``target``: each weight's share of all words, at most ``most`` times the source's size."""
    capped, level = -1, 0.0
    while True:
        over = F.lit(most) * F.col("source_size") <= F.lit(level) * F.col("weight")
        row = sources.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum(F.when(over, most * F.col("source_size"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0)), F.count(F.when(over, 1)),
        ).first()
        if row[3] == capped or not row[2]:
            break
        capped, level = row[3], (row[0] - row[1]) / row[2]
    return sources.withColumn("target", F.least(F.lit(float(most)) * F.col("source_size"), F.lit(level) * F.col("weight")))


def _slots(seed: int, block: int):
    """How many draws give a source's target, and by how many words the last one is too long."""

    def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            size, take = rows["source_size"].to_numpy(), np.rint(rows["target"].to_numpy()).astype(np.int64)
            n = -(-size // block)
            rounds = np.where(size > 0, take // np.maximum(size, 1), 0)
            rest = take - rounds * size
            short = n * block - size  # what the last block lacks
            many = -(-rest // block)
            # the short block's place in the last round: among the draws it may call for one more
            place = permuted(np.maximum(n - 1, 0), np.maximum(n, 1), seed, rows["no"].to_numpy(), rounds, back=True)
            words = many * block - np.where(place < many, short, 0)
            many += (words < rest) & (rest > 0)
            words = many * block - np.where(place < many, short, 0)
            rows = rows.assign(blocks=n, slots=rounds * n + many, cut=np.where(rest > 0, words - rest, 0))
            yield rows[["part", "no", "source_size", "blocks", "slots", "cut"]]

    return plan


def draws(plan: DataFrame, seed: int = SEED, shard: int = SHARD) -> tuple[DataFrame, int]:
    """(shard, no, n): multinomial counts of every shard, with the probabilities slots / all slots; and the number of shards."""
    spark = plan.sparkSession
    total, last = plan.agg(F.coalesce(F.sum("slots"), F.lit(0)), F.coalesce(F.max("no"), F.lit(0))).first()
    width = max(256, -(-(last + 1) // BINS))
    bins = plan.filter("slots > 0").groupBy((F.col("no") / width).cast("int").alias("bin")).agg(F.sum("slots").alias("weight"), F.sort_array(F.collect_list(F.struct("no", "slots"))).alias("sources"))
    chances = [(r[0], r[1] / total) for r in bins.select("bin", "weight").orderBy("bin").collect()]  # BINS rows at most
    shards = -(-total // shard)

    def by_bin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers, chance = (np.array(x) for x in zip(*chances, strict=True))
        for rows in batches:
            for k in rows["id"]:
                n = np.random.default_rng([seed, 1, k]).multinomial(min(shard, total - k * shard), chance / chance.sum())
                yield pd.DataFrame({"shard": k, "bin": numbers[n > 0], "n": n[n > 0]})

    def by_source(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for k, b, n, sources in zip(rows["shard"], rows["bin"], rows["n"], rows["sources"], strict=True):
                no, weight = (np.array([s[c] for s in sources], dtype=np.int64) for c in ("no", "slots"))
                found = np.random.default_rng([seed, 2, k, b]).multinomial(n, weight / weight.sum())
                yield pd.DataFrame({"shard": k, "no": no[found > 0], "n": found[found > 0]})

    drawn = spark.range(shards).mapInPandas(by_bin, "shard long, bin int, n long").join(bins.drop("weight"), "bin")
    return drawn.mapInPandas(by_source, "shard long, no long, n long"), shards


def numbered_draws(plan: DataFrame, drawn: DataFrame, seed: int = SEED) -> DataFrame:
    """(shard, no, index): every draw of a block with its source and its number there; a source's numbers are 0 .. slots - 1."""
    stride = F.floor(F.col("shard") / STRIDE)
    strides = drawn.groupBy("no", stride.alias("stride")).agg(F.sum("n").alias("sum"))
    earlier = W.partitionBy("no").orderBy("stride").rowsBetween(W.unboundedPreceding, -1)
    strides = strides.withColumn("base", F.coalesce(F.sum("sum").over(earlier), F.lit(0)))
    inside = W.partitionBy("no", "stride").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    starts = drawn.withColumn("stride", stride).withColumn("own", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(strides.select("no", "stride", "base"), ["no", "stride"])
    totals = plan.join(drawn.groupBy("no").agg(F.sum("n").alias("drawn")), "no", "left").na.fill(0, ["drawn"])
    totals = totals.withColumns({"spare": F.greatest(F.lit(0), F.col("drawn") - F.col("slots")), "lack": F.greatest(F.lit(0), F.col("slots") - F.col("drawn"))})
    totals = materialise(running(running(totals, "part", "no", "spare", "spare_at"), "part", "no", "lack", "lack_at"), "totals")

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            at = np.repeat(np.arange(len(rows)), rows["n"])
            first = np.repeat(np.cumsum(rows["n"].to_numpy()) - rows["n"].to_numpy(), rows["n"])
            k = (rows["base"] + rows["own"]).to_numpy()[at] + np.arange(len(at)) - first
            r = rows.iloc[at]
            index = permuted(k, r["drawn"].to_numpy(), seed, r["no"].to_numpy(), -1)
            beyond = index - r["slots"].to_numpy()
            passed = pd.array(np.where(beyond >= 0, r["spare_at"].to_numpy() + beyond, 0), dtype="Int64")
            passed[beyond < 0] = pd.NA
            yield pd.DataFrame({"shard": r["shard"].to_numpy(), "no": r["no"].to_numpy(), "index": index, "passed": passed})

    rows = starts.join(totals.select("no", "drawn", "slots", "spare_at"), "no")
    numbered = rows.mapInPandas(spread, "shard long, no long, index long, passed long")
    lacks = totals.filter("lack > 0").select(F.col("no").alias("to"), "drawn", "lack_at", F.explode(F.sequence(F.lit(0), F.col("lack") - 1)).alias("i"))
    lacks = lacks.select("to", (F.col("drawn") + F.col("i")).alias("new"), (F.col("lack_at") + F.col("i")).alias("passed"))
    kept = numbered.filter("passed is null").select("shard", "no", "index")
    return kept.unionByName(numbered.filter("passed is not null").join(lacks, "passed").select("shard", F.col("to").alias("no"), F.col("new").alias("index")))


def block_draws(numbered: DataFrame, plan: DataFrame, seed: int = SEED) -> DataFrame:
    """(shard, no, index, block, cut): the block that every draw takes; ``cut`` words of its end are left out."""

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            index, n = rows["index"].to_numpy(), rows["blocks"].to_numpy()
            block = permuted(index % n, n, seed, rows["no"].to_numpy(), index // n)
            yield rows[["shard", "no", "index"]].assign(block=block, cut=np.where(index == rows["slots"] - 1, rows["cut"], 0))

    return numbered.join(plan.select("no", "blocks", "slots", "cut"), "no").mapInPandas(choose, "shard long, no long, index long, block long, cut long")


def placed(sizes: DataFrame, sources: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Adds to every document with words its source's number and the place of its first word in the source."""
    buckets = max(1, sizes.count() // bucket)
    rows = sizes.filter("size > 0").withColumn("bucket", F.pmod("row", F.lit(buckets)))
    earlier = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    bases = rows.groupBy("source", "bucket").agg(F.sum("size").alias("sum")).withColumn("base", F.coalesce(F.sum("sum").over(earlier), F.lit(0)))
    bases = bases.select(F.col("source").alias("s"), F.col("bucket").alias("b"), "base")
    inside = W.partitionBy("source", "bucket").orderBy("doc_id", "row").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("own", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(bases, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    rows = rows.join(sources.select(F.col("source").alias("of"), "no"), F.col("source").eqNullSafe(F.col("of")))
    return rows.select("doc_id", "row", "size", "no", (F.col("base") + F.col("own")).alias("start"))


def pieces(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Adds a row for each block that a document reaches into: its words from ``low`` to before ``high`` in the block."""
    end = F.col("start") + F.col("size")
    blocks = F.sequence(F.floor(F.col("start") / block), F.floor((end - 1) / block))
    rows = rows.withColumn("block", F.explode(blocks))
    low, high = F.greatest(F.col("start") - F.col("block") * block, F.lit(0)), F.least(end - F.col("block") * block, F.lit(block))
    return rows.withColumns({"low": low, "high": high})


def prepared(docs: DataFrame, seed: int = SEED, block: int = BLOCK, shard: int = SHARD) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(sizes, sources with targets and draws, documents' places, draws of blocks)."""
    sizes = materialise(sized(docs), "sizes")
    sources = with_targets(ranked_sources(sizes))
    plan = materialise(sources.select("part", "no", "source_size", "target").mapInPandas(_slots(seed, block), "part int, no long, source_size long, blocks long, slots long, cut long"), "plan")
    drawn, _ = draws(plan, seed, shard)
    drawn = materialise(drawn, "draws")
    taken = block_draws(numbered_draws(plan, drawn, seed), plan, seed)
    return sizes, sources, placed(sizes, sources), taken


def length(plan_size: str = "source_size", block: int = BLOCK):
    return F.least(F.lit(block), F.col(plan_size) - F.col("block") * block)


def mix(docs: DataFrame, seed: int = SEED, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """The mixture: (shard, place, low, row, doc_id, first, words), in order of shard, place, low.

    Each row says that ``words`` words of a document follow, from its word ``first`` (from 0) on.
    ``texts`` puts them in.
    """
    _, sources, places, taken = prepared(docs, seed, block, shard)
    parts = pieces(places, block).join(sources.select("no", "source_size"), "no")
    high = F.least(F.col("high"), length(block=block) - F.col("cut"))
    spans = taken.join(parts, ["no", "block"]).withColumn("high", high).filter("high > low")
    return spans.select("shard", F.xxhash64("shard", "no", "index").alias("place"), "low", "row", "doc_id", (F.col("block") * block + F.col("low") - F.col("start")).alias("first"), (F.col("high") - F.col("low")).alias("words"))


def texts(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(shard, place, text): the words of every drawn block, joined by one space."""
    own = docs.select(F.xxhash64(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string")).alias("row"), F.regexp_extract_all(F.col("text").cast("string"), F.lit(WORD), F.lit(0)).alias("all"))
    parts = spans.join(own.dropDuplicates(["row"]), "row").select("shard", "place", F.struct("low", F.slice("all", (F.col("first") + 1).cast("int"), F.col("words").cast("int")).alias("w")).alias("p"))
    parts = parts.groupBy("shard", "place").agg(F.sort_array(F.collect_list("p")).alias("p"))  # a block's words at most
    return parts.select("shard", "place", F.array_join(F.flatten(F.transform("p", lambda x: x["w"])), " ").alias("text"))


def taken_words(docs: DataFrame, seed: int = SEED, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """Per document: size, size and target of its source, words that the mix takes from it, repeats counted."""
    sizes, sources, places, taken = prepared(docs, seed, block, shard)
    uses = taken.groupBy("no", "block").agg(F.count("*").alias("uses"), F.sum("cut").alias("cut"))
    parts = pieces(places, block).join(uses, ["no", "block"]).join(sources.select("no", "source_size"), "no")
    lost = F.greatest(F.lit(0), F.col("high") - F.greatest(F.col("low"), length(block=block) - F.col("cut")))
    parts = parts.groupBy("no", "start").agg(F.sum((F.col("high") - F.col("low")) * F.col("uses") - lost).alias("taken"))
    columns = [F.col("doc_id"), F.col("size"), "source_size", "target"]
    full = places.join(parts, ["no", "start"], "left").join(sources.select("no", "source_size", "target"), "no")
    full = full.select(*columns, F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    empty = sizes.filter("size = 0").join(sources.select(F.col("source").alias("of"), "source_size", "target"), F.col("source").eqNullSafe(F.col("of")))
    return full.unionByName(empty.select(*columns, F.lit(0).cast("long").alias("taken")))


def op11_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_words(table(spark, sf_dir, "documents"))
