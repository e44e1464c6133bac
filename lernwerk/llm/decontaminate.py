"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of words are counted over all documents; words in more than ``STOP`` of them
   weigh nothing, others ln(N / df).
2. Texts are cut into blocks of ``STRIDE`` words; two neighbouring blocks are a passage. A randomised
   SVD of the TF-IDF matrix A (hashed terms) of the passages of all documents is made in one
   distributed pass: each task adds up its part of A'A times a random matrix, whose sum has the size
   terms x (RANK + 8); its singular vectors span the leading right singular space of A. Only a caller
   who names a ``sample`` has the fit see about so many documents, chosen by a hash of id and text.
3. Passages and benchmark items are projected there, with every direction scaled to the same
   variance; pairs whose cosine reaches ``COSINE`` are candidates, unless they share fewer than
   ``SHARED`` of the item passage's weighted terms. Items are the query set: they are sent in blocks
   of at most ``ITEMS`` items and about ``ITEM_CHARS`` characters and held against all passages. Item
   passages of which the weighted terms alone tell too little also have the passages as candidates
   that share ``SHARED`` of all their words, stop words included: an edited item that is in many
   documents has made its own words frequent.
4. A candidate counts if the longest common subsequence of the item's words and the words around the
   passage covers ``SEQUENCE`` of the item and its answer's words occur there. Without an answer
   column the item's rarest words stand for it. A sequence that covers ``VERBATIM`` of the item
   counts without that check.

Cases: null and empty texts match nothing; items without words match nothing; equal rows give equal
results; rows with a null doc_id are reported with it; an empty benchmark gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from itertools import chain
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, gathered, id_and_text, null_ids, table
from .shingles import hashed_texts, hashed_words

STRIDE, RANK, EXTRA = 24, 48, 8
WORD_SLOTS, SLOT_BLOCK, TERMS, TERM_BLOCK = 1 << 18, 1 << 12, 1 << 14, 1 << 10  # a word's slot is the top 18 bits of its hash
STOP, STOP_LEAST = 0.1, 20
COSINE, SHARED, SEQUENCE, VERBATIM, ANSWER, ANSWER_WORDS = 0.20, 0.4, 0.6, 0.85, 0.5, 8
#: Item passages of fewer weighted terms fill less of a passage, so their cosine may be lower in proportion.
FULL = 24
#: With fewer weighted terms, or this share of its different words made frequent, an item passage is sought by all its words too.
FEW, OWN = 14, 0.25
ITEMS, ITEM_CHARS = 4_096, 1 << 22
#: Words that a task works on at once in the search, and in the fit, which adds up words by term.
BATCH, FIT_BATCH = 1 << 16, 1 << 20
#: Runs of rows, or passages, worked on at once, few enough to stay in the cache.
RUNS = 128
PAIRS = "doc_id long, item_id long, cosine double, sequence double, answer double, key binary"


def slots_of(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(46)).astype(np.int64)


def word_weights(docs: DataFrame) -> tuple[np.ndarray, int]:
    """ln(N / df) per slot over all documents, 0 for stop words, and N. WORD_SLOTS numbers reach the driver."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, n = np.zeros(WORD_SLOTS, dtype=np.int64), 0
        for rows in batches:
            n += len(rows)
            for words in hashed_texts(rows["text"]):
                counts[np.unique(slots_of(words))] += 1
        parts = counts.reshape(-1, SLOT_BLOCK)
        yield pd.DataFrame({"block": range(len(parts)), "counts": [zlib.compress(x.tobytes(), 1) for x in parts], "docs": [n] * len(parts)})

    def add(key: tuple, rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(SLOT_BLOCK, dtype=np.int64), 0
        for batch in rows:
            n += int(batch["docs"].sum())
            for part in batch["counts"]:
                total += np.frombuffer(zlib.decompress(part), dtype=np.int64)
        yield pd.DataFrame({"block": [key[0]], "counts": [total.tobytes()], "docs": [n]})

    schema = "block int, counts binary, docs long"
    found = gathered(texts(docs)).select("text").mapInPandas(count, schema).groupBy("block").applyInPandas(add, schema).collect()
    df, n = np.zeros(WORD_SLOTS, dtype=np.int64), 1
    for row in found:
        df[row["block"] * SLOT_BLOCK : (row["block"] + 1) * SLOT_BLOCK] = np.frombuffer(row["counts"], dtype=np.int64)
        n = max(n, row["docs"])
    weights = np.log((n + 1) / np.maximum(df, 1))
    weights[df > max(STOP * n, STOP_LEAST)] = 0
    return weights.astype(np.float32), n


def texts(docs: DataFrame) -> DataFrame:
    return id_and_text(docs).filter("text is not null and text <> ''")


@dataclass
class Passages:
    """Weighted words of some texts: term, weight and block of each, and the passages' first blocks."""

    terms: np.ndarray
    weights: np.ndarray
    blocks: np.ndarray
    n_blocks: int
    first: np.ndarray
    second: np.ndarray  # equal to first where a text has one block
    owner: np.ndarray
    place: np.ndarray


def passages(slots: list[np.ndarray], weights: np.ndarray) -> Passages:
    lengths = np.array([len(x) for x in slots])
    per = -(-lengths // STRIDE)
    starts = np.cumsum(per) - per
    flat = np.concatenate(slots)
    blocks = np.repeat(starts, lengths) + (np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)) // STRIDE
    w = weights[flat]
    kept = w > 0
    count = np.maximum(per - 1, 1)
    owner = np.repeat(np.arange(len(slots)), count)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    first = starts[owner] + place
    return Passages(flat[kept] % TERMS, w[kept], blocks[kept], int(per.sum()), first, first + (per[owner] > 1), owner, place)


def weighted_sums(rows: np.ndarray, at: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of ``rows[at]`` times their weights over the segments of ``at`` that begin at ``starts``.

    Segments are cut into runs of ``STRIDE``, filled up with weights of zero; a run's sum is a product with a small matrix.
    """
    lengths = np.diff(starts, append=len(at))
    runs = -(-lengths // STRIDE)
    first, n = np.cumsum(runs) - runs, int(runs.sum())
    place = np.arange(len(at)) + np.repeat(first * STRIDE - starts, lengths)
    index, factor = np.zeros(n * STRIDE, dtype=np.int64), np.zeros(n * STRIDE, dtype=np.float32)
    index[place], factor[place] = at, weights
    index, factor = index.reshape(n, STRIDE), factor.reshape(n, 1, STRIDE)
    sums = np.empty((n, 1, rows.shape[1]), dtype=np.float32)
    held = np.empty((RUNS, STRIDE, rows.shape[1]), dtype=np.float32)
    for low in range(0, n, RUNS):
        part = slice(low, min(low + RUNS, n))
        np.matmul(factor[part], np.take(rows, index[part], axis=0, out=held[: part.stop - low], mode="clip"), out=sums[part])
    return sums[:, 0] if n == len(starts) else np.add.reduceat(sums[:, 0], first, axis=0)


def project(p: Passages, onto: np.ndarray) -> np.ndarray:
    """Rows of the passages' TF-IDF matrix, scaled to length one, times ``onto``."""
    sums = np.zeros((p.n_blocks, onto.shape[1]), dtype=np.float32)
    length = np.zeros(p.n_blocks, dtype=np.float32)
    if len(p.blocks):
        at = np.flatnonzero(np.diff(p.blocks, prepend=-1))  # blocks ascend
        found = p.blocks[at]
        sums[found] = weighted_sums(onto, p.terms, p.weights, at)
        length[found] = np.add.reduceat(p.weights * p.weights, at)
    alone = p.first == p.second
    both = sums[p.first] + np.where(alone[:, None], 0, sums[p.second])
    norm = np.sqrt(np.maximum(length[p.first] + np.where(alone, 0, length[p.second]), 1e-12))
    return both / norm[:, None]


def _batches(rows: pd.DataFrame, column: str = "text", batch: int = BATCH) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Positions and words of texts, about ``batch`` words at a time."""
    at, words, size = [], [], 0
    for i, found in enumerate(hashed_texts(rows[column])):
        if len(found):
            at.append(i)
            words.append(found)
            size += len(found)
        if words and size >= batch:
            yield at, words
            at, words, size = [], [], 0
    if words:
        yield at, words


def sampled(docs: DataFrame, share: float) -> DataFrame:
    """The texts whose hash falls into the given share of all."""
    return texts(docs).filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < F.lit(round(share * (1 << 20))))


def latent_space(docs: DataFrame, weights: np.ndarray, n: int, sample: int | None = None, rank: int = RANK, seed: int = 7) -> np.ndarray:
    """TERMS x rank: leading right singular vectors, each divided by its singular value; of all n documents, or of about ``sample``."""
    random = np.random.default_rng(seed).standard_normal((TERMS, rank + EXTRA)).astype(np.float32)
    context = docs.sparkSession.sparkContext
    sent = context.broadcast((weights, random))  # both of fixed size

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weight, onto = sent.value
        total, n = np.zeros(onto.shape, dtype=np.float32), 0
        for rows in batches:
            for _, words in _batches(rows, batch=FIT_BATCH):
                p = passages([slots_of(x) for x in words], weight)
                y = project(p, onto)
                n += len(y)
                per_block = np.zeros((p.n_blocks, y.shape[1]), dtype=np.float32)
                per_block[p.first] += y  # each block is the first of one passage at most, and the second of one
                apart = p.first != p.second
                per_block[p.second[apart]] += y[apart]
                if len(p.terms):
                    order = np.argsort(p.terms.astype(np.uint16), kind="stable")
                    ascending = p.terms[order]
                    at = np.flatnonzero(np.diff(ascending, prepend=-1))
                    total[ascending[at]] += weighted_sums(per_block, p.blocks[order], p.weights[order], at)
        parts = total.reshape(-1, TERM_BLOCK, total.shape[1])
        yield pd.DataFrame({"block": range(len(parts)), "part": [x.tobytes() for x in parts], "n": [n] * len(parts)})

    def add(key: tuple, rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(TERM_BLOCK * (rank + EXTRA), dtype=np.float64), 0
        for batch in rows:
            n += int(batch["n"].sum())
            for part in batch["part"]:
                total += np.frombuffer(part, dtype=np.float32)
        yield pd.DataFrame({"block": [key[0]], "part": [total.tobytes()], "n": [n]})

    schema = "block int, part binary, n long"
    rows = texts(docs) if sample is None else sampled(docs, min(1.0, sample / n))
    found = gathered(rows).select("text").mapInPandas(sketch, schema).groupBy("block").applyInPandas(add, schema).collect()
    z = np.zeros((TERMS, rank + EXTRA))
    for row in found:
        z[row["block"] * TERM_BLOCK : (row["block"] + 1) * TERM_BLOCK] = np.frombuffer(row["part"]).reshape(TERM_BLOCK, -1)
    left, values, _ = np.linalg.svd(z, full_matrices=False)
    # z = A'A times the random matrix: its singular values go with the squares of A's.
    scale = np.sqrt(np.maximum(values[:rank], 1e-9 * max(values[0], 1e-30)))
    return (left[:, :rank] / np.maximum(scale, 1e-30)).astype(np.float32)


@dataclass
class Item:
    item_id: int | None
    words: dict[int, int]  # places of each word's hash as bits
    known: np.ndarray  # the hashes in order
    size: int
    answer: frozenset[int]


def prepare(item_id: int | None, words: np.ndarray, answer: str | None, weights: np.ndarray) -> Item:
    places: dict[int, int] = {}
    for i, word in enumerate(words.tolist()):
        places[word] = places.get(word, 0) | 1 << i
    rare = dict(zip(words.tolist(), (-weights[slots_of(words)]).tolist(), strict=True))
    key = hashed_words(answer).tolist() if answer else sorted(rare, key=lambda x: (rare[x], x))[:ANSWER_WORDS]
    return Item(item_id, places, np.unique(words), len(words), frozenset(key))


def in_item(item: Item, words: np.ndarray) -> np.ndarray:
    """The words that the item has too, in their order; no others count in a common subsequence."""
    at = np.searchsorted(item.known[:-1], words)  # the last place also for greater ones
    return words[item.known[at] == words]


def most_common(item: Item, words: np.ndarray) -> int:
    """A bound of their longest common subsequence: different words in both, and the item's repeats."""
    return len(set(in_item(item, words).tolist())) + item.size - len(item.known)


def longest_common_subsequence(item: Item, words: list[int]) -> int:
    """Its length; one machine word operation per 64 of the item's words (bit-parallel)."""
    row = every = (1 << item.size) - 1
    get = item.words.get
    for word in words:
        if places := get(word, 0):
            hit = row & places
            row = ((row + hit) | (row - hit)) & every
    return item.size - row.bit_count()


def bitmaps(p: Passages) -> np.ndarray:
    """Eight 64-bit words per passage that mark the terms in it."""
    marks = np.zeros((p.n_blocks, 8), dtype=np.uint64)
    place = (p.terms * 0x9E37 >> 3) & 511
    np.bitwise_or.at(marks, (p.blocks, place >> 6), np.uint64(1) << (place & 63).astype(np.uint64))
    return marks[p.first] | marks[p.second]


def shared_terms(marks: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Marks that each passage shares with each other one; a passage has at most 2 * STRIDE."""
    found = np.zeros((len(marks), len(others)), dtype=np.uint8)
    for low in range(0, len(marks), RUNS):
        for one, other in zip(marks[low : low + RUNS].T, others.T, strict=True):
            found[low : low + RUNS] += np.bitwise_count(one[:, None] & other)
    return found


@dataclass
class Frequent:
    """Words without weight, for the item passages of which the weighted terms tell too little.

    ``of`` lists these passages, ``column`` gives each slot's column or -1, ``holds`` marks every
    listed passage's columns.
    """

    of: np.ndarray
    column: np.ndarray
    holds: np.ndarray  # listed passages x columns, 0 or 1
    count: np.ndarray


def block_passages(slots: list[np.ndarray], p: Passages, column: np.ndarray, width: int) -> np.ndarray:
    """Passages x columns: 1 where the passage holds the frequent word of that column."""
    flat = np.concatenate(slots)
    lengths = np.array([len(x) for x in slots])
    per = -(-lengths // STRIDE)
    blocks = np.repeat(np.cumsum(per) - per, lengths) + (np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)) // STRIDE
    at = column[flat]
    seen = np.zeros((p.n_blocks, width), dtype=np.bool_)
    seen[blocks[at >= 0], at[at >= 0]] = True
    return (seen[p.first] | seen[p.second]).astype(np.float32)


def frequent_words(slots: list[np.ndarray], p: Passages, weights: np.ndarray, weighted: np.ndarray) -> Frequent:
    """Passages with under ``FEW`` weighted terms, or with ``OWN`` of their different words made frequent.

    Words that are frequent in documents but in few items are such words; the stop words of a
    language are in many items.
    """
    every = np.unique(np.concatenate(slots))
    every = every[weights[every] == 0]
    column = np.full(WORD_SLOTS, -1, dtype=np.int32)
    column[every] = np.arange(len(every))
    holds = block_passages(slots, p, column, len(every))
    count = holds.sum(axis=1).astype(np.int64)
    own = holds.sum(axis=0) <= max(2.0, 0.05 * len(holds))
    listed = np.flatnonzero((weighted < FEW) | (holds[:, own].sum(axis=1) >= OWN * (weighted + count)))
    return Frequent(listed, column, holds[listed], count[listed])


def where(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each true entry."""
    return np.divmod(np.flatnonzero(pairs), pairs.shape[1])


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-20)


def search_block(docs: DataFrame, rows: list, weights: np.ndarray, space: np.ndarray, cosine: float, sequence: float) -> DataFrame:
    """Pairs of one block of items with all passages; one pass without a shuffle."""
    kept = [(r["item_id"], hashed_words(r["text"] or ""), r["answer"]) for r in rows]
    kept = [x for x in kept if len(x[1])]
    if not kept:
        return docs.sparkSession.createDataFrame([], PAIRS)
    slots = [slots_of(x[1]) for x in kept]
    p = passages(slots, weights)
    queries, of, marks = unit(project(p, space)), p.owner, bitmaps(p)
    frequent = frequent_words(slots, p, weights, np.bitwise_count(marks).sum(axis=1))
    items = [prepare(*x, weights) for x in kept]
    sent = docs.sparkSession.sparkContext.broadcast((weights, space, queries, of, marks, items, frequent))  # at most ITEMS items

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weight, onto, query, item_of, marked, known, often = sent.value
        held = np.bitwise_count(marked).sum(axis=1)
        least, enough = np.ceil(SHARED * held), cosine * np.minimum(1, held / FULL)
        # A pair that shares too few weighted terms, but enough of all words, shares so many frequent ones.
        of_all = np.ceil(SHARED * (held[often.of] + often.count))
        of_frequent = np.maximum(1, of_all - least[often.of] + 1).astype(np.float32)
        for rows in batches:
            found: dict[tuple[int, int], tuple[float, float, float]] = {}
            for at, words in _batches(rows):
                slots = [slots_of(x) for x in words]
                p = passages(slots, weight)
                near, marks = unit(project(p, onto)) @ query.T, bitmaps(p)
                i, q = where((near >= enough) & (shared_terms(marks, marked) >= least.astype(np.uint8)))
                if often.holds.size:
                    both = block_passages(slots, p, often.column, often.holds.shape[1]) @ often.holds.T
                    more, at_q = where(both >= of_frequent)
                    of_q = often.of[at_q]
                    shared = both[more, at_q] + np.bitwise_count(marks[more] & marked[of_q]).sum(axis=1) >= of_all[at_q]
                    pairs = np.unique(np.concatenate([i * len(held) + q, more[shared] * len(held) + of_q[shared]]))
                    i, q = np.divmod(pairs, len(held))
                hits: dict[tuple[int, int], list[tuple[int, float]]] = {}
                for own, no, place, value in zip(p.owner[i].tolist(), item_of[q].tolist(), p.place[i].tolist(), near[i, q].tolist(), strict=True):
                    hits.setdefault((own, no), []).append((place, value))
                for (own, no), places in hits.items():
                    item, text, best = known[no], words[own], (0.0, 0.0, 0.0)
                    need = min(sequence, VERBATIM) * item.size
                    if most_common(item, text[max(0, places[0][0] * STRIDE - item.size) : (places[-1][0] + 2) * STRIDE + item.size]) < need:
                        continue  # places ascend; what all of them hold is too little
                    for place, value in sorted(places, key=lambda x: -x[1]):
                        low = place * STRIDE
                        region = text[max(0, low - item.size) : low + 2 * STRIDE + item.size]
                        if most_common(item, region) < need:
                            continue
                        share = longest_common_subsequence(item, in_item(item, region).tolist()) / item.size
                        answer = len(item.answer.intersection(region.tolist())) / max(1, len(item.answer))
                        best = max(best, (share, answer, value))
                        if share >= VERBATIM:
                            break
                    if best[0] >= VERBATIM or best[0] >= sequence and best[1] >= ANSWER:
                        found[at[own], no] = best
            ids = rows["doc_id"].astype("Int64")
            yield pd.DataFrame({
                "doc_id": pd.array([ids.iloc[i] for i, _ in found], dtype="Int64"), "item_id": pd.array([known[no].item_id for _, no in found], dtype="Int64"),
                "cosine": [v for _, _, v in found.values()], "sequence": [s for s, _, _ in found.values()], "answer": [a for _, a, _ in found.values()],
                "key": [rows["key"].iloc[i] for i, _ in found],
            })

    return texts(docs).select("doc_id", "text", digest().alias("key")).mapInPandas(search, PAIRS)


def digest() -> Column:
    """128-bit digest of a row's text."""
    return F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")))


def keyed_leaks(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, sequence: float = SEQUENCE, items: int = ITEMS, sample: int | None = None) -> DataFrame:
    """What ``find_leaks`` gives, and the digest of each row's text (key)."""
    weights, n = word_weights(docs)
    space = latent_space(docs, weights, n, sample)
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"), answer.alias("answer"))
    out, block, size = None, [], 0
    for row in chain(rows.toLocalIterator(), [None]):  # the driver holds one block of items at a time
        if row is not None:
            block.append(row)
            size += len(row["text"] or "")
        if len(block) == items or size >= ITEM_CHARS or row is None and (block or out is None):
            part = search_block(docs, block, weights, space, cosine, sequence)
            out, block, size = part if out is None else out.unionByName(part), [], 0
    return null_ids(out)


def find_leaks(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, sequence: float = SEQUENCE, items: int = ITEMS, sample: int | None = None) -> DataFrame:
    """(doc_id, item_id, cosine, sequence, answer) of every document row that holds a benchmark item."""
    return keyed_leaks(docs, benchmark, cosine, sequence, items, sample).drop("key")


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows that hold no benchmark item, with all their columns; rows are told apart by their text, not by doc_id."""
    (name,) = fresh(docs, "_lw_key")
    leaks = keyed_leaks(docs, benchmark).select(F.col("key").alias(name)).distinct()
    return docs.withColumn(name, digest()).join(leaks, name, "left_anti").select(*docs.columns)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
