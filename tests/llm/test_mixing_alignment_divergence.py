"""op11 to op13 against plain versions, and their edge cases."""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
import sentencepiece
from lernwerk.llm import source_divergence, source_mixing, token_alignment
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
EXTRA = "doc_id long, text string, lang string, source string, size long, row long, block long, no long, term string, start long"


def plain_targets(sizes: dict) -> dict:
    names = sorted(x for x in sizes if x is not None) + [None] * (None in sizes)
    weight, open_, done = {n: 1 + k % 3 for k, n in enumerate(names)}, set(names), {}
    left = sum(sizes.values())
    while open_:
        now = {n: left * weight[n] / sum(weight[m] for m in open_) for n in open_}
        over = [n for n in open_ if now[n] > 3 * sizes[n]]
        if not over:
            return done | now
        for n in over:
            done[n] = 3 * sizes[n]
            left -= 3 * sizes[n]
            open_.discard(n)
    return done


@pytest.fixture(scope="module")
def edge_docs(spark):
    rows = [(1, "a b c", "en", "x"), (2, None, "en", "x"), (3, "", None, None), (None, "Q w e r-t y " * 50, "en", None), (4, "z " * 500, "de", ""), (4, "z " * 500, "de", ""), (5, "h", "de", "tiny"), (6, " \n ", "fr", "x"), (7, "lang " * 20_000, "en", "long"), (8, "中文 no▁space\x00", None, "x")]
    return spark.createDataFrame([(*r, 9, 9, 9, 9, "t", 9) for r in rows], EXTRA).repartition(3)


def test_permutations_and_their_inverse():
    for n in (1, 2, 3, 17, 1000):
        found = source_mixing.permuted(np.arange(n), n, 5, np.full(n, 3), np.full(n, 1))
        assert sorted(found) == list(range(n))
        assert (source_mixing.permuted(found, n, 5, np.full(n, 3), np.full(n, 1), back=True) == np.arange(n)).all()


@pytest.mark.parametrize(("block", "shard"), [(128, 4096), (7, 5)])
def test_mixing_meets_capped_targets(spark, block, shard):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = source_mixing.taken_words(docs, block=block, shard=shard).toPandas()
    table = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    size = {r["doc_id"]: len(WORD.findall(r["text"] or "")) for r in table}
    of = {r["doc_id"]: r["source"] for r in table}
    sizes = defaultdict(int)
    for i, s in of.items():
        sizes[s] += size[i]
    targets = plain_targets(dict(sizes))
    taken = defaultdict(int)
    assert sorted(found["doc_id"]) == sorted(of)
    for r in found.itertuples():
        taken[of[r.doc_id]] += r.taken
        assert (r.size, r.source_size) == (size[r.doc_id], sizes[of[r.doc_id]]) and 0 <= r.taken <= 3 * r.size
        assert r.target == pytest.approx(targets[of[r.doc_id]])
    assert all(abs(taken[s] - targets[s]) <= 0.5 + 1e-6 for s in sizes)


def test_mixing_does_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    once, again = (sorted(map(tuple, source_mixing.taken_words(d, block=16, shard=32).collect())) for d in (docs, docs.repartition(7)))
    assert once == again


def test_mixture_holds_the_words_it_counts(spark, edge_docs):
    counted = source_mixing.taken_words(edge_docs, block=7, shard=5).toPandas()
    spans = source_mixing.mix(edge_docs, block=7, shard=5)
    texts = source_mixing.texts(edge_docs, spans).toPandas()
    assert len(WORD.findall(" ".join(texts["text"]))) == counted["taken"].sum()
    assert texts.groupby("shard").size().max() <= 5
    words = Counter(WORD.findall(" ".join(texts["text"])))
    assert words["z"] == counted[counted["doc_id"] == 4]["taken"].sum() and words["h"] == 3
    assert sorted(map(str, counted["doc_id"].astype("Int64"))) == sorted(["1", "2", "3", "<NA>", "4", "4", "5", "6", "7", "8"])


def test_mixing_of_nothing(edge_docs):
    assert source_mixing.taken_words(edge_docs.limit(0)).collect() == []
    found = source_mixing.taken_words(edge_docs.filter("doc_id in (2, 3)")).collect()
    assert sorted((r["doc_id"], r["size"], r["target"], r["taken"]) for r in found) == [(2, 0, 0.0, 0), (3, 0, 0.0, 0)]


def plain_alignment(rows: list[tuple]) -> list[tuple]:
    """Token by token, over a table of all links."""
    a_tokens = Tokenizer.from_file(token_alignment.A_FILE)
    a_tokens.encode_special_tokens = True
    with open(token_alignment.A_FILE) as file:
        vocabulary = json.load(file)["model"]["vocab"]
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    byte = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}
    a_bytes = {i: bytes(byte[c] for c in x) for x, i in vocabulary.items() if x != "<|endoftext|>"}
    b_tokens = sentencepiece.SentencePieceProcessor(model_file=token_alignment.B_FILE)

    def b_bytes(i: int) -> bytes:
        x = b_tokens.id_to_piece(i)
        return bytes([int(x[3:5], 16)]) if re.fullmatch(r"<0x[0-9A-F]{2}>", x) else x.replace("▁", " ").encode()

    docs, count = [], Counter()
    for doc_id, text in rows:
        a, b, groups = [], [], []
        if text:
            a, b, want = a_tokens.encode(" " + text, add_special_tokens=False).ids, b_tokens.encode(text), (" " + text).encode()
            if b"".join(a_bytes[i] for i in a) != want or b"".join(map(b_bytes, b)) != want:
                a, b = [], []
        a_end, b_end = np.cumsum([len(a_bytes[i]) for i in a]).tolist(), np.cumsum([len(b_bytes(i)) for i in b]).tolist()
        i = j = 0
        for end in sorted(set(a_end) & set(b_end)):
            k, m = a_end.index(end, i) + 1, b_end.index(end, j) + 1
            groups.append((a[i:k], b[j:m]))
            i, j = k, m
        links = Counter((x, y) for g in groups for x in g[0] for y in g[1])
        count.update(links.keys())
        docs.append((doc_id, len(a), len(b), groups, links))
    best = Counter()
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for doc_id, a, b, groups, links in docs:
        text = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        sums = sum(links.values()), sum(n for p, n in links.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in links.items())
        out.append((doc_id, a, b, len(groups), *sums, hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return out


def test_alignment_of_odd_texts(spark):
    rng = np.random.default_rng(4)
    letters = list("abc  \n\t\r\x0b\x1c\x85\xa0  '’sTd1٣Ⅷ½.,!?-=éñ中文字かな한😀👩‍́﻿▁\x00") + ["<|endoftext|>", "<0x41>", "</s>"]
    rows = [(k, "".join(rng.choice(letters, rng.integers(0, 50)))) for k in range(900)]
    rows = [(k, t.replace("▁", "") if k % 2 else t) for k, t in rows]
    rows += [(None, "abc def"), (7, None), (8, ""), (9, " "), (9, "a "), (9, "  a  b  "), (10, " " * 30_000), (11, "a" * 5000), (12, "中文" * 2000), (13, "Hello world. Fine.\n\n And more"), (13, "Hello world. Fine.\n\n And more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = [tuple(r) for r in token_alignment.alignment(docs, block_bytes=4000, shards=8).collect()]
    assert sorted(found, key=str) == sorted(plain_alignment(rows), key=str)


def test_alignment_of_documents(spark):
    table = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    found = [tuple(r) for r in token_alignment.op12_token_alignment(spark, SF).collect()]
    assert sorted(found) == sorted(plain_alignment([(r["doc_id"], r["text"]) for r in table]))


def test_alignment_of_nothing(edge_docs):
    assert token_alignment.alignment(edge_docs.limit(0)).collect() == []
    assert all(r["n_a"] == 0 and r["groups_sha256"] == "" for r in token_alignment.alignment(edge_docs.filter("doc_id in (2, 3)")).collect())
    assert token_alignment.alignment(edge_docs).count() == 10


def test_wide_groups_are_joined_by_id():
    tokens = token_alignment.pair(token_alignment.A_FILE, token_alignment.B_FILE)
    one = next(i for i in range(len(tokens.a_length)) if tokens.a_length[i] == 2)
    b = next(i for i in range(len(tokens.b_length)) if tokens.b_length[i] == 3)
    block = {"n_a": np.array([300]), "n_b": np.array([200]), "a": np.full(300, one, dtype=np.uint32), "b": np.full(200, b, dtype=np.uint32)}
    found = token_alignment.align(block, tokens)
    assert found["times"].sum() == 300 // 3 * 3 * 2  # 100 groups of 3 by 2
    block["a"] = np.concatenate([np.full(1, next(i for i in range(len(tokens.a_length)) if tokens.a_length[i] == 1)), block["a"][:-1], block["a"][:0]])
    block["a"] = np.append(block["a"], block["a"][0])
    block["n_a"] = np.array([301])
    found = token_alignment.align(block, tokens)
    assert found["times"].sum() == sum(int(x) * int(y) for x, y in zip(np.diff(found["a_at"]), np.diff(found["b_at"]), strict=True))


def test_minimal_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.unique(rng.integers(0, 2**40, n))
        built = token_alignment.MinimalHash.of(keys)
        assert sorted(built.index(keys)) == list(range(len(keys)))
        read = token_alignment.MinimalHash.read(built.columns())
        assert (read.index(keys) == built.index(keys)).all()
        order = built.in_order(keys)
        other = np.setdiff1d(rng.integers(0, 2**40, 1000), keys)
        at = built.index(other)
        assert not len(keys) or not (order[np.maximum(at, 0)] == other)[at >= 0].any()
    same = token_alignment.MinimalHash(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool), np.array([3, 9]))
    assert same.index(np.array([9, 3, 4])).tolist() == [1, 0, -1]


def plain_audit(rows: list[tuple], least: int, top: int) -> list[tuple]:
    docs, counts, groups = defaultdict(set), Counter(), set()
    for k, (lang, source, text) in enumerate(rows):
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or ""):
            t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
            docs[lang, t].add(k)
            counts[lang, source, t] += 1
    kept = {lang: sorted(t for x, t in docs if x == lang and len(docs[x, t]) >= least) for lang, _ in groups}
    out = []

    def shares(lang: str, own: list[str]) -> dict:
        n = {t: sum(counts[lang, s, t] for s in own) for t in kept[lang]}
        total = sum(n.values()) + 5 * len(n)
        return {t: 1 + 10**9 * (x + 5) // total for t, x in n.items()}

    for lang, source in groups:
        p, q = shares(lang, [source]), shares(lang, [s for x, s in groups if x == lang])
        pair = [(sum(abs(p[t] - r[t]) for t in p), s) for s in (s for x, s in groups if x == lang and s != source) for r in [shares(lang, [s])]]
        term = [(p[t] - q[t], t) for t in p if counts[lang, source, t] and p[t] > q[t]]
        for part, found, most in (("pair", pair, len(pair)), ("term", term, top)):
            out += [(lang, source, part, item, v, k + 1) for k, (v, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most])]
    return out


def test_audit_of_odd_texts(spark):
    rng = np.random.default_rng(2)
    letters = list("aAbB  \n\t,.-12") + ["Ä", "ß", "中", "　", "\xa0", "😀"]
    rows = [(rng.choice(["en", "de"]), f"s{rng.integers(5)}", "".join(rng.choice(letters, rng.integers(0, 40)))) for _ in range(300)]
    rows += [(None, None, None), ("xx", "a", ""), ("xx", "b", " "), ("en", None, "aa,aa. Aa aa-bb"), ("en", None, "aa,aa. Aa aa-bb"), ("de", "s1", "bb " * 5000)]
    docs = spark.createDataFrame([(*r, "a", 1, 2) for r in rows], "lang string, source string, text string, term string, block int, n long").repartition(4)
    found = [tuple(r) for r in source_divergence.audit(docs, least_docs=3, top=4, block_bytes=500).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert sorted(found) == sorted(plain_audit(rows, 3, 4))


def test_audit_against_its_sql(spark):
    duck = duckdb.connect()
    duck.execute(f"create view documents as from '{SF}/documents.parquet'")
    columns = "lang", "source", "part", "item", "value", "rank"
    found = source_divergence.op13_source_divergence(spark, SF).select(*columns).collect()
    assert sorted(map(tuple, found)) == sorted(duck.sql(source_divergence.SQL).select(*columns).fetchall())


def test_audit_of_nothing(edge_docs):
    assert source_divergence.audit(edge_docs.limit(0)).collect() == []
    assert {tuple(r)[:4] for r in source_divergence.audit(edge_docs).filter("part = 'pair' and lang = 'de'").collect()} == {("de", "", "pair", "tiny"), ("de", "tiny", "pair", "")}
