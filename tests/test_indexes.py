"""The stored indexes against plain scans: BM25 blocks, vector cells, the metric join and the greedy order."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest

from lernwerk.operators import dedup_vector, lexical_index, vector_index

HAN = re.compile("([㐀-䶿一-鿿豈-﫿])")


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\W_]+", HAN.sub(r" \1 ", (text or "").lower()))


def plain_bm25(queries: list[tuple], chunks: list[tuple], k: int) -> list[tuple]:
    out = []
    for q, kb, text in queries:
        own = {pk: Counter(words(t)) for pk, b, t in chunks if b == kb}
        if not own:
            continue
        mean = sum(sum(c.values()) for c in own.values()) / len(own)
        scores = {}
        for term in set(words(text)):
            df = sum(term in c for c in own.values())
            for pk, c in own.items():
                if term in c:
                    idf = math.log1p((len(own) - df + 0.5) / (df + 0.5))
                    scores[pk] = scores.get(pk, 0) + idf * c[term] * 2.2 / (c[term] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean))
        best = sorted(scores.items(), key=lambda x: (-round(x[1], 9), x[0]))[:k]
        out += [(q, pk, r + 1) for r, (pk, _) in enumerate(best)]
    return sorted(out)


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(3)
    kinds = [["the", "of", "and", "cache", "lock", "queue", "page"], ["der", "die", "und", "ein", "haus", "weg"], list("分布式缓存一致性协议")]
    chunks = [(k, int(rng.integers(2)), " ".join(f"{w}{'' if rng.random() < 0.7 else rng.integers(40)}" for w in rng.choice(kinds[k % 3], rng.integers(1, 40)))) for k in range(1500)]
    return [*chunks, (2000, 0, None), (2001, 1, ""), (2002, 0, "我们使用分布式缓存来处理请求"), (2003, 0, "Ünïcode CACHE cache")]


def test_index_finds_what_a_scan_finds(spark, texts, tmp_path):
    chunks = spark.createDataFrame(texts, "pk long, kb_id long, text string").repartition(3)
    asked = [(1, 0, "分布式缓存"), (2, 0, "the cache and the lock 7"), (3, 1, "haus weg weg3"), (4, 1, "nothing42here"), (5, 0, None), (6, 9, "cache"), (7, 1, "协议 page12 und"), (8, 0, "cache"), (9, 0, "处理请求")]
    queries = spark.createDataFrame(asked, "query_id long, kb_id long, text string")
    index = lexical_index.build(chunks, group=8)
    expected = plain_bm25(asked, texts, 10)
    assert (9, 2002, 1) in expected
    for first in (1, 4):
        found = lexical_index.search(queries, index, 10, first).select("query_id", "pk", "rank").collect()
        assert sorted(map(tuple, found)) == expected
    index.write(str(tmp_path / "index"))
    read = lexical_index.LexicalIndex.read(spark, str(tmp_path / "index"))
    assert sorted(map(tuple, lexical_index.search(queries, read, 10).select("query_id", "pk", "rank").collect())) == expected
    rare = queries.filter("query_id in (1, 2)")
    read, all_ = lexical_index.blocks_read(rare, index, 10)
    assert 0 < read < all_


def test_rare_words_read_few_blocks(spark):
    rows = [(k, 0, f"the of and common words {k % 5} here" + (" " + "needle " * (1 + k // 700) if k % 100 == 0 else "")) for k in range(4000)]
    index = lexical_index.build(spark.createDataFrame(rows, "pk long, kb_id long, text string"), group=8)
    asked = [(1, 0, "the common needle")]
    queries = spark.createDataFrame(asked, "query_id long, kb_id long, text string")
    assert sorted(map(tuple, lexical_index.search(queries, index, 5).select("query_id", "pk", "rank").collect())) == plain_bm25(asked, rows, 5)
    read, all_ = lexical_index.blocks_read(queries, index, 5)
    assert read < 0.1 * all_


def test_index_of_nothing(spark):
    chunks = spark.createDataFrame([], "pk long, kb_id long, text string")
    queries = spark.createDataFrame([(1, 0, "a")], "query_id long, kb_id long, text string")
    assert lexical_index.search(queries, lexical_index.build(chunks), 5).collect() == []


def clustered(n: int, groups: int, seed: int = 1) -> np.ndarray:
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(groups, 16))[rng.integers(groups, size=n)] + 0.15 * rng.normal(size=(n, 16))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def frame(spark, x: np.ndarray, first: str, base: bool = True):
    rows = [(k, k % 2, v.tolist()) for k, v in enumerate(x)]
    out = spark.createDataFrame(rows, f"{first} long, kb_id long, vector array<double>")
    return out if base else out.drop("kb_id")


@pytest.mark.parametrize("piece", [4096, 50])
def test_vector_search_is_exact(spark, monkeypatch, piece):
    monkeypatch.setattr(vector_index, "PIECE", piece)
    x, q = clustered(900, 12), np.vstack([clustered(30, 12, 2), np.zeros((1, 16))])
    x[5], x[7] = 0, x[9]
    index = vector_index.build(frame(spark, x, "pk"), cells=15)
    found = vector_index.search(frame(spark, q, "query_id"), index, 6).select("query_id", "pk", "rank").collect()
    expected = []
    for k, v in enumerate(q):
        pks = [p for p in range(len(x)) if p % 2 == k % 2]
        best = sorted(pks, key=lambda p: (-round(float(x[p] @ v), 12), p))[:6]
        expected += [(k, p, r + 1) for r, p in enumerate(best)]
    assert sorted(map(tuple, found)) == sorted(expected)


def test_limited_probes_have_measured_recall(spark, tmp_path):
    x, q = clustered(2000, 40), clustered(100, 40, 5)
    index = vector_index.build(frame(spark, x, "pk"), cells=40)
    index.write(str(tmp_path / "vectors"))
    index = vector_index.VectorIndex.read(spark, str(tmp_path / "vectors"))
    exact = {(r["query_id"], r["pk"]) for r in vector_index.search(frame(spark, q, "query_id"), index, 10).collect()}
    limited = {(r["query_id"], r["pk"]) for r in vector_index.search(frame(spark, q, "query_id"), index, 10, probes=8).collect()}
    assert len(exact) == 1000 and len(exact & limited) >= 900


def test_index_of_one_hot_vector_and_of_none(spark):
    x = np.tile(clustered(1, 1), (500, 1))
    found = vector_index.search(frame(spark, x[:1], "query_id"), vector_index.build(frame(spark, x, "pk")), 3).collect()
    assert sorted(r["pk"] for r in found) == [0, 2, 4]
    none = frame(spark, x, "pk").limit(0)
    assert vector_index.search(frame(spark, x[:1], "query_id"), vector_index.build(none), 3).collect() == []


@pytest.mark.parametrize("least", [0.92, 0.3])
def test_metric_join_finds_all_pairs(spark, least):
    x, y = clustered(200, 10, 3), clustered(500, 10, 4)
    y[3] = x[4]
    found = dedup_vector.similar_pairs(frame(spark, x, "pos", False), frame(spark, y, "other", False), least).collect()
    i, j = np.nonzero(x @ y.T >= least)
    assert sorted(map(tuple, found)) == sorted(zip(i.tolist(), j.tolist(), strict=True))


def test_metric_join_asks_few_cells(spark):
    x = clustered(3000, 60, 6)
    index = vector_index.build(frame(spark, x, "pk").selectExpr("pk", "kb_id * 0 as kb_id", "vector"), cells=60)
    sizes = {r["cell"]: r["n"] for r in index.cells.collect()}
    asked = []
    real = vector_index.meet
    try:
        vector_index.meet = lambda requests, *_: asked.append(requests) or requests
        vector_index.within(frame(spark, x, "query_id").selectExpr("query_id", "kb_id * 0 as kb_id", "vector"), index, 0.97)
    finally:
        vector_index.meet = real
    compared = sum(sizes.get(r["cell"], 0) for r in asked[0].select("cell").collect())
    assert compared < 0.1 * len(x) ** 2


def sequential(pairs: list[tuple], n: int) -> set[int]:
    before: dict[int, list[int]] = {}
    for p, o in pairs:
        before.setdefault(p, []).append(o)
    kept: set[int] = set()
    for p in range(n):
        if not kept.intersection(before.get(p, [])):
            kept.add(p)
    return kept


@pytest.mark.parametrize(("n", "width", "turn"), [(10_000, 1, 2_000), (3_000, 3, 1_000), (400, 0, 50)])
def test_greedy_equals_the_sequential_order_in_few_rounds(spark, n, width, turn):
    rng = np.random.default_rng(n)
    pairs = [(p, p - d) for p in range(n) for d in range(1, width + 1) if p >= d] or sorted({(max(a, b), min(a, b)) for a, b in rng.integers(n, size=(1500, 2)).tolist() if a != b})
    rows = pairs + [(p, None) for p in range(n) if not width or p < 2 or p % 7 == 0]
    found, rounds = dedup_vector.greedy(spark.createDataFrame(rows, "pos long, other long"), turn)
    found = found.collect()
    assert len(found) == len({p for p, _ in rows}) == len({r["pos"] for r in found})
    assert {r["pos"] for r in found if r["kept"]} == sequential(pairs, n) & {p for p, _ in rows}
    assert rounds < 30


def test_dedup_with_copies(spark):
    x = clustered(60, 6, 9)
    x[10], x[20], x[59] = x[3], x[3], x[58]
    kept = {r["pos"] for r in dedup_vector.dedup_vector(frame(spark, x[:40], "pos", False), frame(spark, x[40:], "id", False), 0.9).collect()}
    expected: list[int] = []
    for p in range(40):
        if (x[40:] @ x[p]).max() < 0.9 and all(x[o] @ x[p] < 0.9 for o in expected):
            expected.append(p)
    assert kept == set(expected)


def test_digests_find_what_differs_and_shuffle_little(spark):
    from lernwerk.operators import digests

    left = spark.range(200_000).selectExpr("id as pk", "concat('kb_', id % 5) as partition")
    right = spark.range(200_000).filter("id <> 77").selectExpr("id as pk", "if(id = 5, 'kb_9', concat('kb_', id % 5)) as partition").union(spark.createDataFrame([(-3, "kb_1")], "pk long, partition string")).repartition(3)
    found = digests.differences(left, right, "pk", "partition").collect()
    assert sorted((r["pk"], r["left_value"], r["right_value"]) for r in found) == [(-3, None, "kb_1"), (5, "kb_0", "kb_9"), (77, "kb_2", None)]
    hashed = [digests._hashed(x, "pk", "partition") for x in (left, right)]
    assert sum(x.count() for x in digests.open_rows(*hashed)) < 50
    assert digests.differences(left, left.repartition(5), "pk", "partition").collect() == []
    twice = left.limit(10).union(left.limit(10))
    assert digests.differences(left.limit(0), twice, "pk", "partition").count() == 20


def test_queries_that_need_no_more_cells(spark):
    x = clustered(40, 2, 8)
    index = vector_index.build(frame(spark, x, "pk"), cells=2)
    found = vector_index.search(frame(spark, x[:6], "query_id"), index, 1).collect()
    assert sorted((r["query_id"], r["pk"]) for r in found) == [(k, k) for k in range(6)]
