"""Term correction as joins against a plain pass over each text."""

from __future__ import annotations

import random

from plain_terms import correct_text

from lernwerk.operators.corrections import correct_terms

WORDS = ["缓存穿透", "缓存击穿", "缓存雪崩", "布隆过滤器", "分布式锁", "Redis", "自动装配", "事务隔离级别", "聚簇索引", "回表", "主从复制", "分布式系统一致性", "Spring Boot", "SpringBoot", "Elasticsearch", "Kafka", "缓存a穿", "MyBatis-Plus", "存击穿缓"]


def corrected(spark, rows, words):
    frame = spark.createDataFrame([(i, 1, kb, t) for i, (kb, t) in enumerate(rows)], "conv_id long, seq long, kb_id long, text string")
    book = spark.createDataFrame([(1, sorted(words, key=lambda w: (-len(w), w)))], "kb_id long, words array<string>")
    found = {r["conv_id"]: (r["text"], [tuple(f) for f in r["fixes"]]) for r in correct_terms(frame, book).collect()}
    assert len(found) == len(rows)
    return [found[i] for i in range(len(rows))]


def test_corrections_against_a_plain_pass(spark):
    random.seed(5)
    texts = ["", "缓存激穿用互斥锁重建", "布隆过滤起解决穿透", "缓存穿斗加分布式琐", "缓存穿透、缓存击穿、缓存雪崩、布隆过滤器", "今天天气不错适合学习", "讲讲分布系统一致性呢。", "用Radis 和 Kafkaa。", "Sprng Boot 是 elasticsearh", "𝄞缓存激穿𝄞Redos\n缓存", "redis", "spring  boot"]
    pieces = [*WORDS, *"缓存击穿透雪崩分布式锁", " ", "，", "\n", "𝄞", "Rediz", "Sprin Boot", "Kafk", "x", "Elastic search", "Mybatis Pluss", "缓存缓存击"]
    for _ in range(300):
        words = [random.choice(pieces) for _ in range(random.randrange(1, 12))]
        words = [w[:k] + random.choice(["", "穿", "e", " "]) + w[k + 1 :] if random.random() < 0.4 else w for w in words for k in [random.randrange(len(w))]]
        texts.append("".join(words))
    expected = [correct_text(t, WORDS) for t in texts]
    assert corrected(spark, [(1, t) for t in texts], WORDS) == expected
    kinds = [f[1][0].isascii() for _, fixes in expected for f in fixes]
    assert kinds.count(True) > 50 and kinds.count(False) > 50


def test_corrections_of_missing_and_repeated_rows(spark):
    got = corrected(spark, [(1, None), (None, "缓存激穿"), (2, "缓存激穿"), (1, "缓存激穿"), (1, "缓存激穿")], ["缓存击穿", "缓存穿透"])
    fixed = ("缓存击穿", [("缓存激穿", "缓存击穿", 0.75)])
    assert got == [("", []), ("缓存激穿", []), ("缓存激穿", []), fixed, fixed]
