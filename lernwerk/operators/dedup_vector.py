"""Greedy near-duplicate removal by vectors."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialise, release
from ..sources.views import Registry
from . import vector_index

R = Registry()
SIMILAR = 0.92
#: Pairs that one task decides in order, about.
TURN = 200_000


def similar_pairs(candidates: DataFrame, items: DataFrame, least: float = SIMILAR) -> DataFrame:
    """(pos, other) of candidates(pos, vector) and items(other, vector) with a cosine of at least ``least``.

    A metric join: items lie in the cells of their nearest pivots, a candidate goes to the cells
    that its radius reaches (``vector_index.within``).
    """
    index = vector_index.build(items.select(F.col("other").alias("pk"), F.lit(0).cast("long").alias("kb_id"), "vector"))
    asked = candidates.select(F.col("pos").alias("query_id"), F.lit(0).cast("long").alias("kb_id"), "vector")
    return vector_index.within(asked, index, least).select(F.col("query_id").alias("pos"), F.col("pk").alias("other"))


def in_order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Decides the candidates of one range of positions from (pos, other), sorted by pos; ``other`` is an earlier open one that is like it.

    One that waits for a candidate of another range stays open, unless a kept one of this range drops it.
    """
    known: dict[int, bool | None] = {}
    now, dropped, waits = None, False, False

    def state() -> bool | None:
        return False if dropped else None if waits else True

    for rows in batches:
        done = []
        for p, other in zip(rows["pos"].tolist(), rows["other"].astype("Int64"), strict=True):
            if p != now:
                if now is not None:
                    known[now] = state()
                    done.append(now)
                now, dropped, waits = p, False, False
            if other is not pd.NA:
                dropped |= known.get(other) is True
                waits |= known.get(other) is None
        yield pd.DataFrame([(p, known[p]) for p in done if known[p] is not None], columns=["pos", "kept"]).astype({"pos": "int64", "kept": bool})
    if now is not None and state() is not None:
        yield pd.DataFrame({"pos": [now], "kept": [state()]})


def greedy(pairs: DataFrame, turn: int = TURN) -> tuple[DataFrame, int]:
    """(pos, kept) for every pos of pairs(pos, other), other < pos, which has rows of its own, or null: kept if no earlier kept one is like it; and the rounds it took.

    Each round cuts the open candidates into ranges of neighbouring positions; a task decides what
    its range tells by itself. A chain of neighbours is thus decided a range at a time, and
    candidates that wait for none, or whose earlier ones are dropped, in any case.
    """
    done, open_, rounds = None, materialise(pairs.select("pos", "other"), "open"), 0
    while not open_.isEmpty():
        rounds += 1
        decided = open_.repartitionByRange(max(1, -(-open_.count() // turn)), "pos").sortWithinPartitions("pos").mapInPandas(in_order, "pos long, kept boolean")
        decided = materialise(decided, "decided")
        rest = open_.join(decided, "pos", "left_anti").join(decided.withColumnRenamed("pos", "other"), "other", "left")
        rest = materialise(rest.select("pos", "other", "kept"), "rest")
        gone = materialise(rest.filter("kept").select("pos", F.lit(False).alias("kept")).distinct(), "gone")
        done = decided.unionByName(gone) if done is None else done.unionByName(decided).unionByName(gone)
        if decided.isEmpty():
            raise ValueError("candidates wait for one that has no row")
        release(open_)
        # of those left, what is dropped no longer counts; one without any other to wait for keeps a row
        alive = rest.select("pos", F.when(F.col("kept").isNull(), F.col("other")).alias("other")).join(gone, "pos", "left_anti")
        alive = alive.join(gone.select(F.col("pos").alias("other"), F.lit(True).alias("lost")), "other", "left")
        open_ = materialise(alive.select("pos", F.when(F.col("lost").isNull(), F.col("other")).alias("other")).distinct(), "open")
        release(rest)
    return (pairs.select("pos", F.lit(True).alias("kept")).limit(0) if done is None else done), rounds


def dedup_vector(candidates: DataFrame, existing: DataFrame, least: float = SIMILAR) -> DataFrame:
    """(pos) of candidates kept in order: like no existing item and no earlier kept candidate.

    Equal vectors are first taken together: of them only the earliest can be kept, since what is
    like it is like all. That is the sequential result.
    """
    once = materialise(candidates.groupBy("vector").agg(F.min("pos").alias("pos")), "once")
    taken = similar_pairs(once, existing.select(F.col("id").alias("other"), "vector"), least).select("pos").distinct()
    left = materialise(once.join(taken, "pos", "left_anti"), "left")
    pairs = materialise(similar_pairs(left, left.select(F.col("pos").alias("other"), "vector"), least).filter("other < pos"), "pairs")
    # those that no earlier one is like wait for none
    every = left.select("pos").join(pairs, "pos", "left")
    kept, _ = greedy(every)
    return kept.filter("kept").select("pos")


def _query(s) -> DataFrame:
    """A batch of candidates, every vector whose id is divisible by 20, against all others."""
    rows = s["v_chunk_vector"]
    return dedup_vector(rows.filter("pk % 20 = 0").selectExpr("pk as pos", "vector"), rows.filter("pk % 20 <> 0").selectExpr("pk as id", "vector"), ALIKE)


#: Vectors of the test tables are random, so fewer are alike.
ALIKE = 0.4
#: Candidates are taken one after the other; ``near`` lists the earlier ones that are like each.
GREEDY = f"""WITH RECURSIVE v AS (SELECT pk, CAST(vector AS DOUBLE[]) AS v FROM {{v_chunk_vector}}), c AS (SELECT pk AS pos, v FROM v WHERE pk % 20 = 0), free AS (SELECT *, row_number() OVER (ORDER BY pos) AS i FROM c WHERE NOT EXISTS (SELECT 1 FROM v WHERE pk % 20 <> 0 AND list_cosine_similarity(v.v, c.v) >= {ALIKE})),
    n AS (SELECT a.i, a.pos, coalesce(list(b.pos) FILTER (WHERE b.pos IS NOT NULL), CAST([] AS BIGINT[])) AS near FROM free a LEFT JOIN free b ON b.pos < a.pos AND list_cosine_similarity(a.v, b.v) >= {ALIKE} GROUP BY a.i, a.pos),
    k AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS kept UNION ALL SELECT n.i, CASE WHEN list_has_any(k.kept, n.near) THEN k.kept ELSE list_append(k.kept, n.pos) END FROM k JOIN n ON n.i = k.i + 1)
    SELECT unnest(kept) AS pos FROM (SELECT kept FROM k ORDER BY i DESC LIMIT 1) x"""
R.add("dedup_vector", _query, GREEDY)
