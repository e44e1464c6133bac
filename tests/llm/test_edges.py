"""Nulls, empty and long texts, repeated rows, empty tables and clashing names for every operator."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from lernwerk.llm import bpe, decontaminate, html_extract, licenses, near_dedup, pii, quality_classifier, quality_rules, suffix_dedup, token_counts

LONG = "word " * 60_000
DOCS = [(1, "", "en"), (2, None, "en"), (None, "null id here", "en"), (3, LONG, "fr"), (4, "same text twice", "en"), (4, "same text twice", "en"), (5, "same text twice", None), (6, " \n\t ", "de"), (7, "ünï çödé 漢字 🙂", "es"), (8, "x" * 70_000, "en"), (2**62 + 1, "a large id", "en")]
SCHEMA = "doc_id long, text string, lang string, n_words long, key binary, ids binary, bucket int, score double"
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*d, 0, b"", b"", 0, 0.5) for d in DOCS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, 0), (None, 1, 0), (4, 1, 0), (7, 0, 1)], LABELS)


OPERATORS = {
    "bpe": lambda d, la: bpe.digest(d),
    "licenses": lambda d, la: licenses.scan(d),
    "near_dedup": lambda d, la: near_dedup.classes(d),
    "pii": lambda d, la: pii.digest(pii.find_spans(d)),
    "classifier": lambda d, la: quality_classifier.score(d, quality_classifier.fit(d, la)),
    "rules": lambda d, la: quality_rules.apply_rules(d, la),
    "suffix": lambda d, la: suffix_dedup.find_repeats(d),
    "tokens": lambda d, la: token_counts.count_tokens(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_row(docs, labels, name):
    rows = OPERATORS[name](docs, labels).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(d[0]) for d in DOCS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(nothing, labels, name):
    assert OPERATORS[name](nothing, labels.limit(0)).collect() == []


def test_bpe_of_edges(docs):
    found = {(r["doc_id"], r["ids_sha256"]): r for r in bpe.digest(docs, size=1000, overlap=64).collect()}
    for doc_id, text, _ in DOCS:
        ids = bpe.encode_text(text or "")
        r = found[doc_id, hashlib.sha256(ids).hexdigest()]
        assert r["n_tokens"] == len(ids) // 4 and r["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def test_decontaminate_edges(spark, docs, nothing):
    bench = spark.createDataFrame([(1, "same text twice"), (2, None), (3, ""), (None, "null id here")], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, bench).collect()}
    assert found == {(4, 1), (5, 1), (None, None)}
    assert decontaminate.find_leaks(nothing, bench).collect() == []
    assert decontaminate.find_leaks(docs, bench.limit(0)).collect() == []
    left = decontaminate.drop_leaks(docs, bench)
    assert left.columns == docs.columns and sorted(str(r["doc_id"]) for r in left.collect()) == ["1", "2", "3", "4611686018427387905", "6", "7", "8"]


def test_near_dedup_keeps_one_of_each_class(docs):
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "4", "4611686018427387905", "6", "7", "8", "None"]


def test_sanitise_keeps_columns_and_nulls(docs):
    rows = pii.sanitise(docs)
    assert rows.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["text"]) for r in rows.select("doc_id", "text").collect() if r["text"]) == sorted((str(i), t) for i, t, _ in DOCS if t)


def test_keep_good_keeps_columns(docs, labels):
    assert quality_classifier.keep_good(docs, labels).columns == docs.columns


def test_pages(spark):
    pages = spark.createDataFrame([(1, "u", None, 9), (2, "u", "", 9), (None, None, "<p>a&amp;b <b>c", 9), (3, "u", "<article><p>x</p></article>", 9), (3, "u", "<article><p>x</p></article>", 9)], "page_id long, url string, html string, n_chars int")
    assert sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in html_extract.extract(pages).collect()) == [("1", "", 0), ("2", "", 0), ("3", "x", 1), ("3", "x", 1), ("None", "a&b c", 5)]
    assert html_extract.extract(pages.limit(0)).collect() == []


def test_rows_without_or_with_equal_ids_are_told_apart(spark):
    texts = ["one text about rivers and the towns beside them", "another text about mountains and their snow", "a third one of ships that sail at night"]
    docs = spark.createDataFrame([(i, t) for i in (None, 7) for t in texts] + [(None, texts[0])], "doc_id long, text string")
    only_null = docs.filter("doc_id is null")
    assert sorted(r["text"] for r in near_dedup.keep_one(only_null).collect()) == sorted(texts)
    assert sorted((r["doc_id"], r["text"]) for r in near_dedup.keep_one(docs).collect()) == sorted((7, t) for t in texts)
    bench = spark.createDataFrame([(1, texts[1])], "item_id long, text string")
    left = decontaminate.drop_leaks(docs, bench)
    assert left.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["text"]) for r in left.collect()) == sorted([("7", texts[0]), ("7", texts[2]), ("None", texts[0]), ("None", texts[0]), ("None", texts[2])])


def test_filters_keep_columns_named_like_their_own(spark):
    names = ["_lw_score", "_lw_id", "_lw_text", "_lw_key", "_LW_SPANS", "_lw_added", "_lw_leak"]
    rows = [(i, f"text number {i} with some words, mail a{i}@b.example.com" if i % 2 else "the same words in this text", *(f"{n}{i}" for n in names)) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], LABELS)
    bench = spark.createDataFrame([(1, "text number 3 with some words, mail a3@b.example.com")], "item_id long, text string")
    for kept in (quality_classifier.keep_good(docs, labels), near_dedup.keep_one(docs), decontaminate.drop_leaks(docs, bench), pii.sanitise(docs)):
        assert kept.columns == docs.columns
        for r in kept.collect():
            assert [r[n] for n in names] == [f"{n}{r['doc_id']}" for n in names]
    assert 3 not in {r["doc_id"] for r in decontaminate.drop_leaks(docs, bench).collect()}


def test_ties(spark):
    """Equal rows and equal values get equal results, whatever their order."""
    docs = spark.createDataFrame([(i, "equal text of a few words that stands here many times over") for i in range(40)], "doc_id long, text string").withColumn("lang", F.lit("en"))
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality")
    assert len({r["score"] for r in quality_classifier.score(docs, quality_classifier.fit(docs, labels)).collect()}) == 1
    assert len({r["kept"] for r in quality_rules.apply_rules(docs, labels).collect()}) == 1
    bench = spark.createDataFrame([(2, "equal text of a few words that stands here"), (1, "equal text of a few words that stands here")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, bench).collect()} == {(i, k) for i in range(40) for k in (1, 2)}
    assert {r["class_id"] for r in near_dedup.classes(docs).collect()} == {0}


@pytest.mark.parametrize("which", ["empty", "null texts", "clashing columns"])
def test_pipeline_stages_on_edges(spark, docs, nothing, which):
    import corpus_pipeline

    rows = {"empty": nothing, "null texts": docs.filter("text is null or text = ''"), "clashing columns": docs.filter("doc_id in (4, 6, 7)")}[which]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, rows, "/root/testdata/sf0.001")
        assert left.columns == rows.columns
        rows = left
    found = corpus_pipeline.STAGES[-1][1](spark, rows, "/root/testdata/sf0.001").collect()
    assert len(found) <= {"empty": 0, "null texts": 2, "clashing columns": 4}[which]
    assert sorted(str(r["doc_id"]) for r in found) == sorted(str(r["doc_id"]) for r in rows.select("doc_id").collect())
