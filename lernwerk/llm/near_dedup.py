"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

1. Document frequencies of five-word shingles are counted over all documents in a table of fixed
   size: each task counts into its own, and the tables are added up by blocks. A slot holds at least
   its shingles' frequency; the weight only distinguishes shingles that are in more than ``FLOOR`` of
   all documents, far above what other shingles of the slot add.
2. Weight of a shingle: its count in the text times 1 + SPREAD * (how rare it is, 0 to 1). The
   spread is bounded so that large groups of copies, whose own shingles are frequent, stay alike.
3. Each text is sampled by ``BANDS * ROWS`` consistent weighted samples; texts that share all samples
   of a band are candidates. Equal texts are one node from the start.
4. In each band's bucket, every text is paired with one leader: the member that meets the most other
   texts over all its bands, so the centre of a group leads it. Pairs are verified by the weighted
   Jaccard similarity of their whole shingle sets.
5. Verified links join texts into classes (smallest label, with pointer jumps). A text that isn't
   similar to its leader can only be similar to a text that differs from the leader in like ways;
   texts of different classes with enough such changes in common are compared too, and the classes
   are made anew with these links. So all similar members of a bucket are found without comparing
   all its pairs.

Cases: null texts count as empty; texts without words are alike only if equal; equal texts share a
class; texts of the same words share a class; a null doc_id is kept and never names a class unless
the class has no other id; equal rows each give a row; other columns are ignored.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, id_and_text, known_id, materialise, null_ids, release, table
from .shingles import shingle_ids

SIMILARITY, WIDTH = 0.8, 5
BANDS, ROWS = 16, 4
SLOTS, BLOCK = 1 << 20, 1 << 12
SPREAD, FLOOR = 0.25, 1e-3
#: Distinct draws of the sampler; each function picks one per shingle by a hash of its own.
DRAWS = 1 << 16
SEED = 20_240_229
CHUNK = 1 << 16


def nodes(docs: DataFrame) -> DataFrame:
    """(doc_id, text, node): node is a 128-bit digest of the text."""
    rows = id_and_text(docs).withColumn("text", F.coalesce("text", F.lit("")))
    return rows.withColumn("node", F.unhex(F.md5(F.col("text").cast("binary"))))


def frequency_blocks(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(block, counts binary, docs): document frequencies per slot and the number of documents."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slots, n = np.zeros(SLOTS, dtype=np.int64), 0
        for rows in batches:
            n += len(rows)
            for text in rows["text"]:
                slots[np.unique(np.unique(shingle_ids(text, width)) % SLOTS)] += 1
        parts = slots.reshape(-1, BLOCK)
        yield pd.DataFrame({"block": range(len(parts)), "counts": [zlib.compress(x.tobytes(), 1) for x in parts], "docs": [n] * len(parts)})

    def add(key: tuple, rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(BLOCK, dtype=np.int64), 0
        for batch in rows:
            for part, docs_in in zip(batch["counts"], batch["docs"], strict=True):
                total += np.frombuffer(zlib.decompress(part), dtype=np.int64)
                n += int(docs_in)
        yield pd.DataFrame({"block": [key[0]], "counts": [total.tobytes()], "docs": [n]})

    schema = "block int, counts binary, docs long"
    return id_and_text(docs).select(F.coalesce("text", F.lit("")).alias("text")).mapInPandas(count, schema).groupBy("block").applyInPandas(add, schema)


def slot_weights(docs: DataFrame, width: int = WIDTH, spread: float = SPREAD, floor: float = FLOOR) -> np.ndarray:
    """Weight of the shingles of each slot. SLOTS numbers reach the driver, whatever the input."""
    rows = frequency_blocks(docs, width).collect()
    counts = np.zeros(SLOTS, dtype=np.int64)
    for row in rows:
        counts[row["block"] * BLOCK : (row["block"] + 1) * BLOCK] = np.frombuffer(row["counts"], dtype=np.int64)
    n = max([1, *(row["docs"] for row in rows)])
    rarity = np.log(n / np.clip(counts, max(1, n * floor), n)) / -np.log(floor)
    return (1 + spread * np.clip(rarity, 0, 1)).astype(np.float32)


@functools.lru_cache(maxsize=1)
def draws() -> tuple[np.ndarray, ...]:
    """Of each draw: r and ln c, both Gamma(2, 1), beta uniform; and each function's multiplier."""
    random = np.random.default_rng(SEED)
    r = random.gamma(2, 1, DRAWS).astype(np.float32)
    log_c = np.log(random.gamma(2, 1, DRAWS)).astype(np.float32)
    beta = random.random(DRAWS, dtype=np.float32)
    return r, (1 / r).astype(np.float32), log_c - r, beta, random.integers(1 << 62, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


def samples(ids: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """32-bit samples, one column per function, of the sets ids[starts[i]:starts[i + 1]].

    Of every set the shingle with the least ln a = ln c - r * (t - beta) - r is taken, where
    t = floor(ln w / r + beta); its id and t make the sample. The value's ordered bits above those
    of the sample let one minimum find both.
    """
    r, inverse, log_c, beta, factors = draws()
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9FB21C651E98DF25)
    mixed ^= mixed >> np.uint64(31)
    log_w = np.log(weights)
    out = np.empty((len(starts), len(factors)), dtype=np.uint32)
    for i, factor in enumerate(factors):
        hashed = mixed * factor
        at = (hashed >> np.uint64(48)).astype(np.intp)
        t = np.floor(log_w * inverse[at] + beta[at])
        value = log_c[at] - r[at] * (t - beta[at])
        bits = value.view(np.uint32)
        bits = np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31)).astype(np.uint64)
        chosen = (hashed ^ (t.astype(np.int64).view(np.uint64) * np.uint64(0xA24BAED4963EE407))) & np.uint64(0xFFFFFFFF)
        out[:, i] = np.minimum.reduceat((bits << np.uint64(32)) | chosen, starts).astype(np.uint32)
    return out


def band_keys(found: np.ndarray) -> np.ndarray:
    """64-bit key of each band of each row of samples."""
    keys = np.empty((len(found), BANDS), dtype=np.uint64)
    for band in range(BANDS):
        key = np.full(len(found), band + 1, dtype=np.uint64)
        for row in range(ROWS):
            key = (key ^ found[:, band * ROWS + row].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(32)
        keys[:, band] = key
    return keys.view(np.int64)


def signatures(docs: DataFrame, weights: np.ndarray, width: int = WIDTH) -> DataFrame:
    """(doc_id, node, ids binary, bands): sorted shingle ids with repeats, and band keys, of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)  # SLOTS numbers, whatever the input

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weight = sent.value
        for rows in batches:
            sets = [np.sort(shingle_ids(x, width)) for x in rows["text"]]
            bands: list[list[int]] = [[] for _ in sets]
            group: list[int] = []
            size = 0
            for i, ids in enumerate(sets):
                if len(ids):
                    group.append(i)
                    size += len(ids)
                if group and (size >= CHUNK or i == len(sets) - 1):
                    parts = [np.unique(sets[g], return_counts=True) for g in group]
                    flat = np.concatenate([p[0] for p in parts])
                    tf = np.concatenate([p[1] for p in parts]).astype(np.float32)
                    starts = np.cumsum([0, *(len(p[0]) for p in parts[:-1])])
                    for g, keys in zip(group, band_keys(samples(flat, tf * weight[flat % SLOTS], starts)), strict=True):
                        bands[g] = keys.tolist()
                    group, size = [], 0
            yield pd.DataFrame({"doc_id": rows["doc_id"].astype("Int64"), "node": rows["node"], "ids": [x.tobytes() for x in sets], "bands": bands})

    return nodes(docs).select("doc_id", "node", "text").mapInPandas(sign, "doc_id long, node binary, ids binary, bands array<long>")


def weighted_jaccard(a: bytes, b: bytes, weight: np.ndarray) -> float:
    """Sum of the lesser over sum of the greater weights of two sets of sorted shingle ids."""
    ids = np.concatenate([np.frombuffer(a, dtype=np.uint32), np.frombuffer(b, dtype=np.uint32)])
    keys, at = np.unique(ids, return_inverse=True)
    n = len(a) // 4
    left, right = np.bincount(at[:n], minlength=len(keys)), np.bincount(at[n:], minlength=len(keys))
    w = weight[keys % SLOTS].astype(np.float64)
    return float(w @ np.minimum(left, right) / (w @ np.maximum(left, right)))


def shared_bands(signed: DataFrame) -> DataFrame:
    """(band, node, size) of the buckets with more than one text."""
    members = signed.select("node", F.explode("bands").alias("band")).distinct()
    sizes = members.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1")
    return materialise(members.join(sizes, "band"), "bands")


def candidate_pairs(shared: DataFrame) -> DataFrame:
    """(node, leader) of different texts that share a band; each node with its bands' leaders only."""
    met = shared.groupBy("node").agg(F.sum("size").alias("met"))
    ranked = shared.join(met, "node").groupBy("band").agg(F.min(F.struct(-F.col("met"), "node")).alias("first"))
    leaders = ranked.select("band", F.col("first.node").alias("leader"))
    return shared.select("band", "node").join(leaders, "band").filter("node <> leader").select("node", "leader").distinct()


def led_members(pairs: DataFrame, signed: DataFrame, weights: np.ndarray) -> DataFrame:
    """(leader, node, own, base, apart, similarity) of every pair: total weights of the node (own) and its leader (base), and the sum of their differences (apart)."""
    sent = signed.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("own double, base double, apart double, similarity double")
    def compare(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = []
        for x, y in zip(a, b, strict=True):
            _, change, w = differences(x, y, sent.value)
            own, base = total_weight(x, sent.value), total_weight(y, sent.value)
            apart = float(w @ np.abs(change))
            rows.append((own, base, apart, (own + base - apart) / max(own + base + apart, 1e-30)))
        return pd.DataFrame(rows, columns=["own", "base", "apart", "similarity"], dtype="float64")

    return with_sets(pairs, signed).select("leader", "node", compare("ids", "leader_ids").alias("x")).select("leader", "node", "x.*")


def changes(members: DataFrame, signed: DataFrame, weights: np.ndarray) -> DataFrame:
    """Members' rows, one for each shingle whose count differs from the leader's: (..., change, mass).

    ``change`` is the shingle with the sign of the difference, ``mass`` its weight times the difference.
    """
    sent = signed.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("array<struct<change: long, mass: double>>")
    def listed(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            keys, change, w = differences(x, y, sent.value)
            at = np.flatnonzero(change)
            signs = 2 * keys[at].astype(np.int64) + (change[at] > 0)
            out.append([{"change": c, "mass": m} for c, m in zip(signs.tolist(), (w[at] * np.abs(change[at])).tolist(), strict=True)])
        return pd.Series(out, dtype=object)

    kept = [c for c in members.columns if c not in ("leader", "node")]
    rows = with_sets(members, signed).select("leader", "node", *kept, F.explode(listed("ids", "leader_ids")).alias("x"))
    return rows.select("leader", "node", *kept, "x.change", "x.mass")


def between_classes(listed: DataFrame) -> DataFrame:
    """The rows of changes that texts of two classes have, one of them open, with how many texts have the change (often)."""
    held = listed.groupBy("leader", "change").agg(F.count("*").alias("often"), F.max("open").alias("any"), F.min("root").alias("low"), F.max("root").alias("high"))
    return listed.join(held.filter("any and low <> high").select("leader", "change", "often"), ["leader", "change"])


def open_pairs(members: DataFrame, roots: DataFrame, signed: DataFrame, weights: np.ndarray, similarity: float = SIMILARITY) -> DataFrame:
    """(node, leader) of texts with one leader that may be similar though one of them isn't similar to the leader.

    Two texts are similar if the sum of their differences is at most ``slack`` times their total
    weight. If x is not similar to its leader, then y is similar to x only if both differ from the
    leader in the same way by a mass of at least

        (apart(x) + apart(y) - slack * (own(x) + own(y))) / 2 > (apart(y) + slack * (base - own(y))) / 2,

    so the rarest changes of y that are too heavy to be left out hold one that x has too. Texts are
    paired on these changes only; a change that no text of another class has pairs nothing, however
    many texts of one class have it. What can still be common from the paired change on bounds the
    pair once more. No similar pair of two classes is lost.
    """
    slack = (1 - similarity) / (1 + similarity)
    rows = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).withColumn("open", F.col("similarity") < similarity)
    # Two classes at least beside the leader, one text of them open; others have nothing to compare.
    unsettled = rows.groupBy("leader").agg(F.max("open").alias("any"), F.min("root").alias("low"), F.max("root").alias("high")).filter("any and low <> high").select("leader")
    listed = materialise(changes(rows.join(unsettled, "leader").drop("similarity"), signed, weights), "changes")
    common = between_classes(listed)
    # Changes that one class alone has come first in the order; only their mass matters.
    shared = W.partitionBy("leader", "node").orderBy(F.desc("often"), F.desc("change")).rowsBetween(W.unboundedPreceding, 0)
    common = common.withColumn("rest", F.sum("mass").over(shared))
    least = (F.col("apart") + slack * (F.col("base") - F.col("own"))) / 2
    x = common.filter("open").select("leader", "change", "node", "root", "own", "apart", "rest")
    y = common.filter(F.col("rest") >= (1 - 1e-6) * least).select("leader", "change", *(F.col(c).alias(f"{c}_y") for c in ("node", "root", "own", "apart", "rest")))
    needed = (F.col("apart") + F.col("apart_y") - slack * (F.col("own") + F.col("own_y"))) / 2
    near = F.least("own", "own_y") >= (similarity - 1e-6) * F.greatest("own", "own_y")
    pairs = x.join(y, ["leader", "change"]).filter((F.col("root") != F.col("root_y")) & near & (F.least("rest", "rest_y") >= needed - 1e-6 * F.col("own")))
    return pairs.select(F.least("node", "node_y").alias("node"), F.greatest("node", "node_y").alias("leader")).distinct()


def total_weight(ids: bytes, weight: np.ndarray) -> float:
    return float(weight[np.frombuffer(ids, dtype=np.uint32) % SLOTS].sum(dtype=np.float64))


def differences(a: bytes, b: bytes, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles of two sets of sorted ids, how much oftener each is in the first, and their weights."""
    ids = np.concatenate([np.frombuffer(a, dtype=np.uint32), np.frombuffer(b, dtype=np.uint32)])
    keys, at = np.unique(ids, return_inverse=True)
    n = len(a) // 4
    change = np.bincount(at[:n], minlength=len(keys)) - np.bincount(at[n:], minlength=len(keys))
    return keys, change, weight[keys % SLOTS].astype(np.float64)


def with_sets(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """The pairs with both texts' sets (ids, leader_ids).

    Both sides' sets come from one table dealt by node; a leader of very many nodes is a skewed key
    of the second join, which is split at run time.
    """
    sets = signed.groupBy("node").agg(F.first("ids").alias("ids"))
    other = sets.select(F.col("node").alias("leader"), F.col("ids").alias("leader_ids"))
    return pairs.join(sets, "node").join(other, "leader")


def verified(pairs: DataFrame, signed: DataFrame, weights: np.ndarray, similarity: float = SIMILARITY) -> DataFrame:
    """(node, leader, similarity) of the pairs that are similar enough."""
    sent = signed.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf(T.DoubleType())
    def compare(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([weighted_jaccard(x, y, sent.value) for x, y in zip(a, b, strict=True)], dtype="float64")

    pairs = with_sets(pairs, signed).select("node", "leader", compare("ids", "leader_ids").alias("similarity"))
    return pairs.filter(F.col("similarity") >= similarity)


def class_roots(signed: DataFrame, weights: np.ndarray, similarity: float = SIMILARITY) -> DataFrame:
    """(node, root) of the texts in classes of more than one text.

    Leaders join most of each class at one comparison a text; what shares a leader and may still be
    similar is compared after, so no link between bucket members is missed.
    """
    members = materialise(led_members(candidate_pairs(shared_bands(signed)), signed, weights), "led")
    led = members.filter(F.col("similarity") >= similarity).select("node", "leader")
    rest = open_pairs(members, components(led), signed, weights, similarity)
    more = materialise(verified(rest, signed, weights, similarity).select("node", "leader"), "more")
    return components(led.unionByName(more))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each connected group, for the nodes that have edges.

    Every round a node takes the least label among its neighbours', then its label's label, until no
    label changes; rounds needed grow with the logarithm of a group's diameter. Each round is written
    as a table, which replaces the one before.
    """
    both = materialise(edges.select("node", "leader").unionByName(edges.select(F.col("leader").alias("node"), F.col("node").alias("leader"))).distinct(), "edges")
    moved = materialise(both.groupBy("node").agg(F.min("leader").alias("least")).select("node", F.least("node", "least").alias("next"), F.col("node").alias("root")), "labels")
    while not moved.filter("next <> root").isEmpty():
        before, labels = moved, moved.select("node", F.col("next").alias("root"))
        near = both.join(labels.withColumnRenamed("node", "leader"), "leader").groupBy("node").agg(F.min("root").alias("near"))
        moved = labels.join(near, "node").select("node", F.least("root", "near").alias("next"), "root")
        jump = moved.select(F.col("node").alias("next"), F.col("next").alias("further"))
        moved = materialise(moved.join(jump, "next").select("node", F.least("next", "further").alias("next"), "root"), "labels")
        release(before)
    release(both)
    return moved.select("node", F.col("next").alias("root"))


def rooted(docs: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH) -> DataFrame:
    """(doc_id, node, root) of every row: root is the smallest node of its class; a missing doc_id is LAST_ID."""
    weights = slot_weights(docs, width)
    signed = materialise(signatures(docs, weights, width), "signatures")
    roots = class_roots(signed, weights, similarity)
    return signed.select("doc_id", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def classes(docs: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH) -> DataFrame:
    """(doc_id, node, class_id) of every row: class_id is the smallest doc_id of its class."""
    rows = rooted(docs, similarity, width)
    least = rows.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    return null_ids(rows.join(least, "root").select("doc_id", "node", "class_id"), "doc_id", "class_id")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH) -> DataFrame:
    """The row with the smallest doc_id of each class, with all its columns.

    Classes are told apart by their root: missing and repeated ids don't join different texts.
    """
    own = fresh(docs, "_lw_id", "_lw_text")
    first = F.min(F.struct("doc_id", "node")).alias("first")
    best = rooted(docs, similarity, width).groupBy("root").agg(first).select(F.col("first.doc_id").alias(own[0]), F.col("first.node").alias(own[1]))
    rows = docs.withColumns({own[0]: known_id(), own[1]: F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")))})
    return rows.join(best, own, "left_semi").dropDuplicates(own).select(*docs.columns)


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).drop("node")
