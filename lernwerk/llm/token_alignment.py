"""Alignment of two tokenizers' tokens, counted over the corpus through minimal perfect hashing.

A text's tokens under A and B are cut into groups where both end on the same byte; every A token is
linked to every B token of its group. A pair of ids counts once for each document that links it.

First pass: blocks of documents are encoded; a block yields its distinct pairs with their numbers of
documents, dealt into shards by the A id. The distinct pairs of a shard are united along a tree of
blocks and get a minimal perfect hash (levels of bit arrays, index by rank). Each tree node adds its
blocks' numbers into a dense vector indexed by that hash; the vectors are summed up the tree. The
keys stand beside the counts, so that a looked-up pair is verified. Second pass: each block's pairs
are looked up, its documents are aligned again from their ids, and the links' counts are added up.

Nothing is broadcast. A shard holds at most its share of all pairs of two vocabularies (1.6 x 10^9
pairs in 128 shards); a block is bounded by ``block_bytes`` or one text.

Both tokenizers treat a text that is cut before a space after a non-space character as separate
pieces (A's pattern starts a token there; no piece of B has its space mark behind another
character, which is checked). So each distinct piece of a block is encoded and aligned once. A text
with a piece whose bytes B doesn't give back is encoded whole.

Cases: texts that are null, empty or not given back by either tokenizer have zeros and ''; equal
rows count as documents of their own; a null doc_id is kept; long texts are a block of their own;
ties for an A id's highest count all count as best; an empty table gives no rows; other columns are
ignored. Documents are numbered only inside a written block, so a lost executor can't mix numberings.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import materialise, table
from .source_divergence import packed, slices, unpacked

A_FILE, B_FILE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
BLOCK_BYTES, SHARDS, FAN = 4 << 20, 128, 16
#: (document, link) entries listed at once; products of a group above which equal ids are joined first; pieces encoded together.
ENTRIES, WIDE, TOGETHER = 4_000_000, 4_096, 1_000
#: A space at the start or after white space (what Python's isspace tells), where a text isn't cut.
ODD_SPACE = r"(?:^|[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]) "
CUT = re.compile(r"(?<=\S) ")

_ROW = pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("ids", pa.list_(pa.int64())), *((c, pa.binary()) for c in ("n_pieces", "pieces", "n_a", "n_b", "a", "b"))])
_KINDS = "block long, shard int, keys binary, counts binary, ids array<long>, n_pieces binary, pieces binary, n_a binary, n_b binary, a binary, b binary"
_OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class Pair:
    """Both tokenizers: ids of pieces, byte lengths of ids."""

    def __init__(self, a_file: str, b_file: str):
        with open(a_file, encoding="utf-8") as file:
            vocabulary = json.load(file)
        special = {x["content"] for x in vocabulary["added_tokens"]}
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(printable))}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocabulary["model"]["vocab"].items() if token not in special}
        self.fast = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.a_file = a_file
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(re.search("[^▁]▁", x) for x in names):
            raise ValueError("a piece of B reaches over a space: texts can't be cut there")
        self.b_bytes = [bytes([int(x[3:-1], 16)]) if self.b.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
        self.space = self.b.piece_to_id("▁")
        self.size_b = len(names)
        self.a_length = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        self.a_length[list(ranks.values())] = [len(x) for x in ranks]
        self.b_length = np.array([len(x) for x in self.b_bytes])

    def encode_a(self, text: str) -> list[int]:
        try:
            return self.fast.encode_ordinary(text)
        except BaseException as problem:  # its pattern overflows the stack on long white space
            if type(problem).__name__ != "PanicException":
                raise
            slow = Tokenizer.from_file(self.a_file)
            slow.encode_special_tokens = True
            return slow.encode(text, add_special_tokens=False).ids

    def encode(self, piece: str) -> tuple[np.ndarray, np.ndarray, bool]:
        """Ids under A and under B of a space and the piece; whether B gives its bytes back."""
        b = self.b.encode(piece) if piece else [self.space]
        whole = b"".join([self.b_bytes[i] for i in b]) == b" " + piece.encode()
        return np.array(self.encode_a(" " + piece), dtype="<u4"), np.array(b, dtype="<u4"), whole

    def encode_all(self, pieces: list[str]) -> dict[str, np.ndarray]:
        """Ids of every piece under both, and whether B gives it back; pieces that end in no white space are encoded together."""
        out: dict[str, list] = {"order": [], "n_a": [], "n_b": [], "a": [], "b": [], "whole": []}
        odd = [k for k, x in enumerate(pieces) if not x or x[-1].isspace()]
        even = [k for k, x in enumerate(pieces) if x and not x[-1].isspace()]
        for at in range(0, len(even), TOGETHER):
            part = even[at : at + TOGETHER]
            text = " ".join([pieces[k] for k in part])
            ends = np.cumsum([len(pieces[k].encode()) + 1 for k in part])
            b = self.b.encode(text)
            if b"".join([self.b_bytes[i] for i in b]) != b" " + text.encode():
                odd += part
                continue
            for c, ids, length in (("a", self.encode_a(" " + text), self.a_length), ("b", b, self.b_length)):
                ids = np.array(ids, dtype="<u4")
                out[c].append(ids)
                out[f"n_{c}"].append(np.diff(np.searchsorted(np.cumsum(length[ids]), ends, "right"), prepend=0))
            out["order"].append(np.array(part))
            out["whole"].append(np.ones(len(part), dtype=bool))
        for k in odd:
            a, b, whole = self.encode(pieces[k])
            for c, x in (("order", [k]), ("n_a", [len(a) * whole]), ("n_b", [len(b) * whole]), ("a", a[: len(a) * whole]), ("b", b[: len(b) * whole]), ("whole", [whole])):
                out[c].append(np.array(x))
        kinds = {"whole": bool, "a": np.uint32, "b": np.uint32}
        return {c: np.concatenate([np.zeros(0, dtype=kinds.get(c, np.int64)), *x]).astype(kinds.get(c, np.int64)) for c, x in out.items()}


@lru_cache(maxsize=2)
def pair(a_file: str, b_file: str) -> Pair:
    return Pair(a_file, b_file)


def encode_block(rows: pa.Table, tokens: Pair) -> tuple[list[int | None], dict[str, np.ndarray]]:
    """Ids of the documents, the pieces of each by number, and the token ids of each distinct piece.

    A piece stands for a space and itself: texts are cut before spaces after a non-space character.
    Texts that B changes have no pieces.
    """
    texts = rows["text"].combine_chunks()
    texts = texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts
    odd = np.asarray(pc.match_substring_regex(texts, ODD_SPACE), dtype=bool)
    empty = np.asarray(pc.equal(texts, ""), dtype=bool)
    order = [np.flatnonzero(x) for x in (~odd & ~empty, odd & ~empty, empty)]
    lists = pc.split_pattern(texts.take(pa.array(order[0])), " ")
    lists = pa.concat_arrays([lists.cast(pa.list_(pa.string())), pa.array([CUT.split(texts[k].as_py()) for k in order[1].tolist()], pa.list_(pa.string()))])
    found = lists.flatten().dictionary_encode()
    pieces, n_pieces = found.indices.to_numpy().astype(np.int64), np.append(np.diff(lists.offsets.to_numpy()), np.zeros(len(order[2]), dtype=np.int64))
    order = np.concatenate(order)
    block = tokens.encode_all(found.dictionary.to_pylist())
    number = np.empty(len(block["order"]), dtype=np.int64)
    number[block["order"]] = np.arange(len(number))
    pieces = number[pieces]
    if not block["whole"].all():
        of = np.split(pieces, np.cumsum(n_pieces)[:-1])
        for k in np.flatnonzero([not block["whole"][x].all() for x in of]):
            a, b, whole = tokens.encode(texts[int(order[k])].as_py())
            of[k] = np.array([len(block["n_a"])] if whole else [], dtype=np.int64)
            if whole:
                block |= {c: np.append(block[c], x) for c, x in (("n_a", len(a)), ("n_b", len(b)), ("a", a), ("b", b))}
        pieces, n_pieces = np.concatenate(of), np.array([len(x) for x in of])
    ids = rows["doc_id"].to_pylist()
    return [ids[k] for k in order.tolist()], {"n_pieces": n_pieces, "pieces": pieces} | {c: block[c] for c in ("n_a", "n_b", "a", "b")}


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which row, and which place in it, for rows of these lengths."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)


def align(block: dict[str, np.ndarray], tokens: Pair) -> dict[str, np.ndarray]:
    """Groups of all distinct pieces, one after the other, and their links by piece: (piece, key, times)."""
    a, b = block["a"].astype(np.int64), block["b"].astype(np.int64)
    a_end, b_end = np.cumsum(tokens.a_length[a]), np.cumsum(tokens.b_length[b])
    ends = np.intersect1d(a_end, b_end, assume_unique=True)
    a_at, b_at = (np.append(0, np.searchsorted(x, ends, "right")) for x in (a_end, b_end))
    n_a, n_b = np.diff(a_at), np.diff(b_at)
    piece_of = np.repeat(np.arange(len(block["n_a"])), block["n_a"])[a_at[:-1]] if len(ends) else np.zeros(0, dtype=np.int64)
    wide = np.flatnonzero(n_a * n_b > WIDE)
    small = np.flatnonzero(n_a * n_b <= WIDE)
    row, place = spread((n_a * n_b)[small])
    group = small[row]
    keys = a[a_at[group] + place // n_b[group]] * tokens.size_b + b[b_at[group] + place % n_b[group]]
    links = [(piece_of[group], keys, np.ones(len(keys), dtype=np.int64))]
    for g in wide:
        (x, x_times), (y, y_times) = (np.unique(v[at[g] : at[g + 1]], return_counts=True) for v, at in ((a, a_at), (b, b_at)))
        links.append((np.full(len(x) * len(y), piece_of[g]), (x[:, None] * tokens.size_b + y).ravel(), np.outer(x_times, y_times).ravel()))
    piece, keys, times = (np.concatenate(x) for x in zip(*links, strict=True))
    order = np.argsort(piece, kind="stable") if len(wide) else slice(None)
    piece, keys, times = piece[order], keys[order], times[order]
    return {"a_at": a_at, "b_at": b_at, "piece_of": piece_of, "piece": piece, "keys": keys, "times": times}


def block_pairs(block: dict[str, np.ndarray], found: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of a block, and in how many of its documents each is linked."""
    number, keys = pd.factorize(found["keys"])
    many = np.bincount(found["piece"], minlength=len(block["n_a"]))
    first = np.cumsum(many) - many
    counts = np.zeros(len(keys), dtype=np.int64)
    ends = np.cumsum(block["n_pieces"])
    size = np.append(0, np.cumsum(many[block["pieces"]]))[ends]  # links up to each document's end
    at = 0
    while at < len(ends):
        begin = int(ends[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + ENTRIES, "right")))
        pieces = block["pieces"][begin : ends[end - 1]]
        row, place = spread(many[pieces])
        links = number[first[pieces][row] + place]
        for own in np.split(links, size[at : end - 1] - (size[at - 1] if at else 0)):
            counts[own] += 1  # an index that repeats is counted once
        at = end
    return keys, counts


def shard_of(ids: np.ndarray, shards: int) -> np.ndarray:
    return mixed(ids.astype(np.uint64), 77) % np.uint64(shards)


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """64-bit values mixed by multiplications and shifts."""
    x = x + np.uint64(0x9E3779B97F4A7C15 * (seed + 1) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class MinimalHash:
    """Distinct non-negative keys to 0 .. n - 1 without gaps.

    Level by level, keys that are alone on their place of a bit array of twice their number are
    settled, the others go on; the index is the rank of the bit. What 40 levels leave is listed.
    """

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, rest: np.ndarray):
        self.sizes, self.bits, self.rest = sizes, bits, rest
        self.rank = np.cumsum(bits, dtype=np.int64) - 1

    @classmethod
    def of(cls, keys: np.ndarray) -> MinimalHash:
        sizes, bits, left = [], [], np.asarray(keys)
        while len(left) and len(sizes) < 40:
            at = cls._place(left, len(sizes), 2 * len(left))
            alone = np.bincount(at, minlength=2 * len(left)) == 1
            sizes.append(2 * len(left))
            bits.append(alone)
            left = left[~alone[at]]
        return cls(np.array(sizes, dtype=np.int64), np.concatenate([*bits, np.zeros(0, dtype=bool)]), np.sort(left))

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mixed(keys.astype(np.uint64), level) % np.uint64(size)).astype(np.int64)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Indexes; other keys get any index or -1, so the caller verifies the key that stands there."""
        out, left, start = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes.tolist()):
            at = start + self._place(keys[left], level, size)
            hit = self.bits[at]
            out[left[hit]] = self.rank[at[hit]]
            left, start = left[~hit], start + size
        if len(left) and len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, keys[left]), len(self.rest) - 1)
            here = self.rest[at] == keys[left]
            out[left[here]] = int(self.bits.sum()) + at[here]
        return out

    def in_order(self, keys: np.ndarray) -> np.ndarray:
        """The keys by their index."""
        out = np.empty(len(keys), dtype=np.int64)
        out[self.index(keys)] = keys
        return out

    def columns(self) -> dict[str, bytes]:
        return {"sizes": self.sizes.tobytes(), "bits": np.packbits(self.bits).tobytes(), "rest": self.rest.astype(np.int64).tobytes()}

    @classmethod
    def read(cls, row: dict[str, bytes]) -> MinimalHash:
        sizes = np.frombuffer(row["sizes"], dtype=np.int64)
        bits = np.unpackbits(np.frombuffer(row["bits"], dtype=np.uint8), count=int(sizes.sum())).astype(bool)
        return cls(sizes, bits, np.frombuffer(row["rest"], dtype=np.int64))


def _long(x: bytes) -> np.ndarray:
    return np.frombuffer(x, dtype=np.int64)


def encoded_blocks(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE, block_bytes: int = BLOCK_BYTES, shards: int = SHARDS) -> DataFrame:
    """Rows of two kinds: a block's documents as ids of its distinct pieces, and (block, shard, keys, counts) of its pairs."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = pair(a_file, b_file)
        for k, part in enumerate(slices(batches, block_bytes)):
            own = {"block": TaskContext.get().partitionId() << 32 | k}
            ids, block = encode_block(part, tokens)
            yield pa.RecordBatch.from_pylist([own | {"ids": ids} | {c: packed(x) for c, x in block.items()}], schema=_ROW)
            keys, counts = block_pairs(block, align(block, tokens))
            shard = shard_of(keys // tokens.size_b, shards).astype(np.int32)
            order = np.argsort(shard, kind="stable")
            first = np.flatnonzero(np.diff(shard[order], prepend=-1))
            parts = np.split(order, first[1:]) if len(first) else []
            yield pa.RecordBatch.from_pylist([own | {"shard": int(shard[x[0]]), "keys": keys[x].tobytes(), "counts": counts[x].tobytes()} for x in parts], schema=_ROW)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.mapInArrow(rows, _KINDS)


def up_the_tree(rows: DataFrame, nodes: int, values: str, combine: Callable[[list[np.ndarray]], np.ndarray]) -> DataFrame:
    """(shard, values): of each shard the values of all nodes combined, FAN nodes at a time."""

    def join(key: tuple, part: pa.Table) -> pa.Table:
        out = combine([_long(x) for x in part[values].to_pylist()])
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "node": pa.array([key[1].as_py()], pa.int32()), values: pa.array([out.tobytes()], pa.binary())})

    while True:
        rows = rows.groupBy("shard", "node").applyInArrow(join, f"shard int, node int, {values} binary")
        if nodes == 1:
            return rows.drop("node")
        nodes = -(-nodes // FAN)
        rows = rows.withColumn("node", F.pmod(F.col("node"), F.lit(nodes)).cast("int"))


def pair_counts(partial: DataFrame, nodes: int, size_b: int) -> DataFrame:
    """(shard, sizes, bits, rest, keys, counts, best): hash, keys in its order, documents of each pair and whether its A id has no higher one.

    ``partial`` has (shard, node, keys, counts), one row for each block and shard.
    """

    def hashed(part: pa.Table) -> pa.Table:
        keys = _long(part["keys"][0].as_py())
        found = MinimalHash.of(keys)
        row = {"shard": part["shard"][0].as_py(), **found.columns(), "keys": found.in_order(keys).tobytes()}
        return pa.Table.from_pylist([row], schema=pa.schema([("shard", pa.int32()), *((c, pa.binary()) for c in ("sizes", "bits", "rest", "keys"))]))

    def dense(part: pa.Table, table: pa.Table) -> pa.Table:
        row = table.to_pylist()[0]
        found, keys = MinimalHash.read(row), _long(row["keys"])
        vector = np.zeros(len(keys), dtype=np.int64)
        for own, counts in zip(part["keys"].to_pylist(), part["counts"].to_pylist(), strict=True):
            at = found.index(_long(own))
            if not np.array_equal(keys[at], _long(own)):
                raise ValueError("a pair isn't in its shard's hash")
            vector[at] += _long(counts)
        return pa.table({"shard": pa.array([row["shard"]], pa.int32()), "node": pa.array([row["node"]], pa.int32()), "counts": pa.array([vector.tobytes()], pa.binary())})

    def best(part: pa.Table) -> pa.Table:
        keys, counts = _long(part["keys"][0].as_py()), _long(part["counts"][0].as_py())
        _, own = np.unique(keys // size_b, return_inverse=True)
        high = np.zeros(own.max() + 1, dtype=np.int64)
        np.maximum.at(high, own, counts)
        return part.append_column("best", pa.array([(counts == high[own]).tobytes()], pa.binary()))

    keys = up_the_tree(partial.select("shard", "node", "keys"), nodes, "keys", lambda x: np.unique(np.concatenate(x)))
    tables = materialise(keys.groupBy("shard").applyInArrow(hashed, "shard int, sizes binary, bits binary, rest binary, keys binary"), "hashes")
    copies = at_nodes(tables, nodes)
    vectors = partial.groupBy("shard", "node").cogroup(copies.groupBy("of", "node")).applyInArrow(lambda x, y: dense(x, y.rename_columns(["shard" if c == "of" else c for c in y.column_names])) if len(x) else _no_vector(), "shard int, node int, counts binary")
    counts = up_the_tree(vectors, nodes, "counts", lambda x: np.sum(x, axis=0))
    joined = tables.join(counts, "shard")
    return joined.groupBy("shard").applyInArrow(best, "shard int, sizes binary, bits binary, rest binary, keys binary, counts binary, best binary")


def _no_vector() -> pa.Table:
    return pa.table({"shard": pa.array([], pa.int32()), "node": pa.array([], pa.int32()), "counts": pa.array([], pa.binary())})


def at_nodes(tables: DataFrame, nodes: int) -> DataFrame:
    """A copy of every shard's table for each node of the tree."""
    return tables.select(F.col("shard").alias("of"), F.explode(F.sequence(F.lit(0), F.lit(nodes - 1))).alias("node"), *(c for c in tables.columns if c != "shard"))


def looked_up(partial: DataFrame, counts: DataFrame, nodes: int) -> DataFrame:
    """(block, keys, counts, best): corpus-wide counts of the pairs of every block, by the hash and verified."""
    kind = pa.schema([("block", pa.int64()), *((c, pa.binary()) for c in ("keys", "counts", "best"))])

    def find(part: pa.Table, table: pa.Table) -> pa.Table:
        out = []
        if len(part):
            row = table.to_pylist()[0]
            found, keys, counts, best = MinimalHash.read(row), _long(row["keys"]), _long(row["counts"]), np.frombuffer(row["best"], dtype=bool)
            for block, own in zip(part["block"].to_pylist(), part["keys"].to_pylist(), strict=True):
                at = found.index(_long(own))
                if not np.array_equal(keys[at], _long(own)):
                    raise ValueError("a pair isn't in its shard's hash")
                out.append({"block": block, "keys": own, "counts": counts[at].tobytes(), "best": best[at].tobytes()})
        return pa.Table.from_pylist(out, schema=kind)

    return partial.groupBy("shard", "node").cogroup(at_nodes(counts, nodes).groupBy("of", "node")).applyInArrow(find, "block long, keys binary, counts binary, best binary")


@lru_cache(maxsize=2)
def _names(n: int) -> list[str]:
    return list(map(str, range(n)))


def _joined(parts: list[str], at: list[int], by: str) -> list[str]:
    """The parts of each range between neighbouring places, joined."""
    return [parts[s] if e - s == 1 else by.join(parts[s:e]) for s, e in zip(at[:-1], at[1:], strict=True)]


def _documents(block: dict, pairs: pa.Table, tokens: Pair) -> Iterator[dict]:
    """Aligns a block's pieces again and adds up their links for every document."""
    found = align(block, tokens)
    keys, counts = (np.concatenate([np.zeros(0, dtype=np.int64), *map(_long, pairs[c].to_pylist())]) for c in ("keys", "counts"))
    best = np.concatenate([np.zeros(0, dtype=bool), *(np.frombuffer(x, dtype=bool) for x in pairs["best"].to_pylist())])
    order = np.argsort(keys)
    at = order[np.searchsorted(keys, found["keys"], sorter=order)]
    n = len(block["n_a"])

    def summed(values: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(values))
        ends = np.searchsorted(piece, np.arange(n), "right")
        return total[ends] - total[np.append(0, ends[:-1])] if n else total[:0]

    piece, times = found["piece"], found["times"]
    numbers = {"n_a": block["n_a"], "n_b": block["n_b"], "n_groups": np.bincount(found["piece_of"], minlength=n), "n_links": summed(times), "n_best": summed(times * best[at]), "count_sum": summed(times * counts[at])}
    names = _names(max(len(tokens.a_length), tokens.size_b))
    a, b = (_joined([names[i] for i in block[c].tolist()], found[f"{c}_at"].tolist(), ",") for c in ("a", "b"))
    written = _joined([f"{x}|{y}" for x, y in zip(a, b, strict=True)], [0, *np.cumsum(numbers["n_groups"]).tolist()], ";")
    last = np.cumsum(block["n_pieces"])
    totals = {c: np.append(0, np.cumsum(x.astype(np.int64)[block["pieces"]])) for c, x in numbers.items()}
    totals = {c: x[last] - x[last - block["n_pieces"]] for c, x in totals.items()}
    pieces = block["pieces"].tolist()
    for k, (doc_id, end, many) in enumerate(zip(block["ids"], last.tolist(), block["n_pieces"].tolist(), strict=True)):
        text = ";".join([written[p] for p in pieces[end - many : end]])
        yield {"doc_id": doc_id} | {c: int(x[k]) for c, x in totals.items()} | {"groups_sha256": hashlib.sha256(text.encode()).hexdigest() if many else ""}


def alignment(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE, block_bytes: int = BLOCK_BYTES, shards: int = SHARDS) -> DataFrame:
    """Per document: tokens, groups, links, links with their A id's highest count, sum of the links' counts, digest of the groups."""
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), ("groups_sha256", pa.string())])

    def documents(block: pa.Table, pairs: pa.Table) -> pa.Table:
        tokens, row = pair(a_file, b_file), block.to_pylist()[0]
        block = {"ids": row["ids"]} | {c: unpacked(row[c]) for c in ("n_pieces", "pieces", "n_a", "n_b", "a", "b")}
        return pa.Table.from_pylist(list(_documents(block, pairs, tokens)), schema=schema)

    rows = materialise(encoded_blocks(docs, a_file, b_file, block_bytes, shards), "blocks")
    whole = rows.filter("shard is null")
    nodes = max(1, -(-whole.count() // FAN))
    node = F.pmod(F.xxhash64("block"), F.lit(nodes)).cast("int").alias("node")
    partial = rows.filter("shard is not null").select("block", "shard", node, "keys", "counts")
    counts = materialise(pair_counts(partial, nodes, pair(a_file, b_file).size_b), "pairs")
    pairs = looked_up(partial, counts, nodes)
    own = whole.select(F.col("block").alias("own"), "ids", "n_pieces", "pieces", "n_a", "n_b", "a", "b")
    return own.groupBy("own").cogroup(pairs.groupBy("block")).applyInArrow(documents, _OUT)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(table(spark, sf_dir, "documents"))
