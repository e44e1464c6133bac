"""Stored tables in buckets: what a change touches, and what a killed one leaves."""

from __future__ import annotations

import pytest

from lernwerk.sources import store


def rows(spark, text: str, ids):
    return spark.createDataFrame([(i, k, f"{text} {i} {k}") for i in ids for k in range(2)], "doc_id long, chunk_index long, content string")


def content(table) -> list[str]:
    return sorted(r["content"] for r in table.read().collect())


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    table = store.BucketStore(spark, str(tmp_path / "t"), buckets=8)
    table.overwrite(rows(spark, "old", range(40)))
    before = table.state()[1]["buckets"]
    assert len(before) == 8 and sum(x["rows"] for x in before.values()) == 80
    assert table.replace(rows(spark, "new", [3]), gone=spark.createDataFrame([(4,)], "doc_id long")) in (1, 2)
    after = table.state()[1]["buckets"]
    assert sum(before[b]["folder"] != after[b]["folder"] for b in before) <= 2
    assert content(table) == sorted([f"old {i} {k}" for i in range(40) if i not in (3, 4) for k in range(2)] + ["new 3 0", "new 3 1"])
    table.vacuum()
    assert len(content(table)) == 78 and len(table._names(table.folder)) >= 2
    names = [x for x in table._names(table.folder) if x.startswith("manifest")]
    assert names == ["manifest-0000000002.json"]


def test_a_killed_write_leaves_the_old_state(spark, tmp_path, monkeypatch):
    table = store.BucketStore(spark, str(tmp_path / "t"), buckets=4)
    table.overwrite(rows(spark, "old", range(10)))
    old = content(table)
    monkeypatch.setattr(store.BucketStore, "_publish", lambda *_: (_ for _ in ()).throw(SystemExit("killed")))
    with pytest.raises(SystemExit):
        table.replace(rows(spark, "new", [1, 2]))
    monkeypatch.undo()
    assert content(table) == old
    with pytest.raises(Exception):  # noqa: B017
        table.replace(rows(spark, "bad", [1]).selectExpr("doc_id", "chunk_index", "assert_true(false) is null as x", "content").selectExpr("doc_id", "chunk_index", "if(x, content, 'y') as content"))
    assert content(table) == old
    table.replace(rows(spark, "new", [1, 2]))
    assert "new 1 0" in content(table) and len(content(table)) == 20


def test_of_two_writers_one_starts_again(spark, tmp_path):
    table = store.BucketStore(spark, str(tmp_path / "t"), buckets=4)
    table.overwrite(rows(spark, "old", range(4)))
    number, manifest = table.state()
    table.replace(rows(spark, "new", [1]))
    with pytest.raises(store.Conflict):
        table._publish(number + 1, manifest)
    assert "new 1 0" in content(table)


def test_tables_without_rows(spark, tmp_path):
    table = store.BucketStore(spark, str(tmp_path / "t"))
    table.overwrite(rows(spark, "old", [1]).limit(0))
    assert content(table) == []
    assert table.replace(rows(spark, "new", [1])) == 1 and len(content(table)) == 2
    assert table.replace(rows(spark, "new", []), gone=spark.createDataFrame([(1,)], "doc_id long")) == 1 and content(table) == []
