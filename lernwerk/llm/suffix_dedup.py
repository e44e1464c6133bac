"""Exact removal of repeated byte strings, by sorting sampled suffixes and inducing the rest.

Every string of LENGTH bytes holds exactly one sampled suffix: the place with the least hash of the
GRAM bytes from there on (the first, if equal). The same string has its sample at the same offset
wherever it stands, so equal strings can be told apart by their samples alone.

1. Each sampled suffix becomes a tuple: a digest of all strings sampled by it together (its reach),
   digests of the longer common prefixes and common suffixes that a shared string implies, its
   document and place. Tuples are dealt by digest of the sampled gram and sorted in tasks.
   Before, each task settles what its own tuples tell: of a string that many of its documents share,
   two tuples are enough for the others, so no bucket grows with a common line.
2. Tuples with equal reach induce the answer for all their strings at once: those of later documents
   are repeated. What is left of a reach's first document is settled if no other document shares a
   prefix or suffix long enough. Otherwise its single strings are digested, dealt and sorted.
3. The repeated strings of each document are joined and removed.

The method named for this operator, external induced sorting with priority queues on disk, is a
sequential recursion over one shard; written so (tests/llm/induced_sorting.py, which this operator is
tested against) it is far too slow in Python tasks, and a shard sees no strings of others. Only its
idea is kept: few suffixes are compared, with what they have in common carried along, and the rest
is induced. The README has the figures.

Cases: null texts count as empty; texts under LENGTH bytes lose nothing; rows with equal doc_id never
remove each other's bytes; a null doc_id comes after every other one; equal rows each give a row;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, null_ids, table
from .pii import keyed

LENGTH, GRAM = 50, 14
REACH = LENGTH - GRAM  # how far before its sampled place a string may start
SPLIT = REACH // 2  # strings that start nearer are told by a longer prefix, others by a longer suffix
#: Bytes of text that one task of the sorts works on, bytes hashed at once, and tuples gathered before they are dealt.
TASK_BYTES, SEGMENT, FLUSH = 1 << 24, 1 << 18, 1 << 18
#: kind 0: runs of repeated strings, 1: runs to be settled string by string, 2: tuples.
PACKED = "kind int, bucket int, part binary"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
#: Tuples of one task that may share a digest before only two of them are dealt, and the size of the table that finds such digests.
SHARED_BY, SLOT_BITS = 4, 18
_STEP, _MIX, _MIX2 = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9FB21C651E98DF25)
_PLACE = np.uint64((1 << 20) - 1)


@lru_cache(maxsize=2)
def _powers(seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number for each byte value; powers of a step and of its inverse."""
    letters = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64)
    step = (_STEP * (2 * seed + 1)) % (1 << 64) | 1
    n = 2 * SEGMENT + LENGTH
    return letters, np.cumprod(np.full(n, step, dtype=np.uint64)), np.cumprod(np.full(n, pow(step, -1, 1 << 64), dtype=np.uint64))


class Hashes:
    """Digests of any stretch of a buffer, from running sums."""

    def __init__(self, letters: np.ndarray, seed: int = 1):
        numbers, power, self.inverse = _powers(seed)
        self.sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(numbers[letters] * power[: len(letters)])])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        found = (self.sums[ends] - self.sums[starts]) * self.inverse[starts]
        found ^= found >> np.uint64(29)
        return found * _MIX


def pack(**columns: np.ndarray) -> bytes:
    """Columns as bytes, each compressed alone. Of ``doc`` and ``start``, which ascend by stretches, differences are kept, like bytes together."""
    out = []
    for name, v in columns.items():
        raw = np.diff(v, prepend=v.dtype.type(0)).view(np.uint8).reshape(-1, 4).T.tobytes() if name in ("doc", "start") else np.ascontiguousarray(v).tobytes()
        out.append((f"{name}:{v.dtype.str}", zstandard.compress(raw, 1)))
    head = ";".join(f"{name}:{len(raw)}" for name, raw in out).encode()
    return len(head).to_bytes(4, "little") + head + b"".join(raw for _, raw in out)


def unpack(part: bytes, names: tuple[str, ...]) -> dict[str, np.ndarray]:
    """The named columns."""
    at = 4 + int.from_bytes(part[:4], "little")
    out = {}
    for field in part[4:at].decode().split(";"):
        name, kind, n = field.split(":")
        if name in names:
            raw = zstandard.decompress(part[at : at + int(n)])
            if name in ("doc", "start"):
                planes = np.frombuffer(raw, dtype=np.uint8).reshape(4, -1)
                out[name] = np.cumsum(np.ascontiguousarray(planes.T).view(np.uint32).ravel(), dtype=np.uint32)
            else:
                out[name] = np.frombuffer(raw, dtype=kind)
        at += int(n)
    return out


def unpack_all(parts: list[bytes], *names: str) -> list[np.ndarray]:
    """The named columns of several parts together; ``doc`` counts on over the parts' documents."""
    every = [unpack(x, (*names, "keys") if "doc" in names else names) for x in parts]
    if "doc" in names:
        seen = 0
        for x in every:
            x["doc"] = x["doc"] + np.uint32(seen)
            seen += len(x["keys"])
    return [np.concatenate([x[name] for x in every]) for name in names]


def segments(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Buffers of about SEGMENT bytes with the stretches in them: (letters, document, its offset, first byte, end).

    Long texts are cut into stretches that share LENGTH - 1 bytes, so that every string is in one.
    """
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def out():
        lengths = np.array([len(x[2]) for x in held])
        ends = np.cumsum(lengths)
        return np.frombuffer(b"".join(x[2] for x in held), dtype=np.uint8), np.array([x[0] for x in held]), np.array([x[1] for x in held]), ends - lengths, ends

    for doc, text in enumerate(texts):
        for at in range(0, max(0, len(text) - LENGTH + 1), SEGMENT):
            held.append((doc, at, text[at : at + SEGMENT + LENGTH - 1]))
            size += len(held[-1][2])
            if size >= SEGMENT:
                yield out()
                held, size = [], 0
    if held:
        yield out()


def sampled(letters: np.ndarray, firsts: np.ndarray, ends: np.ndarray, hashes: Hashes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(stretch, sampled place, first string, number of strings, gram digest) of every sampled suffix."""
    places = np.arange(len(letters) - GRAM + 1)
    grams = hashes.of(places, places + GRAM)
    best = (grams & ~_PLACE) | places.astype(np.uint64)  # the least is the first of the least
    step = 1
    while step * 2 <= REACH + 1:
        best = np.minimum(best[:-step], best[step:])
        step *= 2
    if step < REACH + 1:
        rest = REACH + 1 - step
        best = np.minimum(best[:-rest], best[rest:])
    counts = ends - firsts - LENGTH + 1
    stretch = np.repeat(np.arange(len(firsts)), counts)
    starts = np.arange(len(stretch)) - np.repeat(np.cumsum(counts) - counts, counts) + firsts[stretch]
    place = (best[starts] & _PLACE).astype(np.int64)
    new = np.flatnonzero((np.diff(place, prepend=-1) != 0) | (np.diff(stretch, prepend=-1) != 0))
    n = np.diff(np.append(new, len(starts)))
    return stretch[new], place[new], starts[new], n, grams[place[new]]


def _rows(batches) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    for rows in batches:
        texts = [zstandard.decompress(x) for x in rows["raw"]] if "raw" in rows else [x.encode() for x in rows["text"]]
        yield texts, rows["doc_id"].to_numpy(dtype=np.int64), np.array([_key(x) for x in rows["key"]], dtype=np.uint64)


def crowded(values: np.ndarray, more_than: int) -> np.ndarray:
    """Rows whose value may stand more often than that: all that do, and a few others."""
    slot = (values & values.dtype.type((1 << SLOT_BITS) - 1)).astype(np.int64)
    return np.bincount(slot, minlength=1 << SLOT_BITS)[slot] > more_than


def repeated_here(values: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Rows for whose value another row has a smaller id; values that few rows have are left out."""
    at = np.flatnonzero(crowded(values, SHARED_BY))
    out = np.zeros(len(values), dtype=bool)
    if len(at):
        out[at] = ids[at] > group_least(values[at], ids[at])[0]
    return out


def spread(values: np.ndarray, ids: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose value many documents share here, and of these all but one of the least and one of the greatest id.

    Only rows where ``live`` holds count. The two make known elsewhere that the value is shared.
    """
    out, shared = np.zeros(len(values), dtype=bool), np.zeros(len(values), dtype=bool)
    at = np.flatnonzero(live & crowded(values, SHARED_BY))
    if len(at):
        order = at[np.lexsort((ids[at], values[at]))]
        v, i = values[order], ids[order]
        first = np.append(True, v[1:] != v[:-1])
        start = np.flatnonzero(first)
        size = np.diff(np.append(start, len(v)))
        last = start + size - 1
        inner = ~first
        inner[last] = False
        many = np.repeat((size > SHARED_BY) & (i[start] < i[last]), size)
        shared[order[many]] = True
        out[order[inner & many]] = True
    return shared, out


def _near(n: np.ndarray, back: np.ndarray) -> np.ndarray:
    """How many of the strings of each tuple start at most SPLIT before its place."""
    return np.clip(SPLIT + n.astype(np.int64) - back.astype(np.int64), 0, n.astype(np.int64))


def _tuples(buckets: int):
    """Tuples by bucket of their gram (kind 2), and runs that are settled (0) or open (1) without meeting others.

    What a task can tell by itself isn't dealt, so a line that very many documents share sends a few
    tuples of each task to its bucket.
    """

    def deal(found: list, ids: np.ndarray, keys: np.ndarray) -> Iterator[pd.DataFrame]:
        doc, start, n, back, reach, longer, before, bucket = (np.concatenate(x) for x in zip(*found, strict=True))
        own = ids[doc]
        repeated = repeated_here(reach, own)
        near = _near(n, back)
        both, right = spread(longer, own, ~repeated & (near > 0))
        some, left = spread(before, own, ~repeated & (near < n))
        for kind, rows, low, count in ((0, repeated, start, n), (1, right, start + (n - near).astype(np.uint32), near.astype(np.uint8)), (1, left, start, (n - near).astype(np.uint8))):
            at = np.flatnonzero(rows)
            if len(at):
                yield from _dealt(kind, buckets, keys, doc[at], low[at], count[at])
        # A tuple that is open on one side is dealt for the other one alone.
        keep = ~repeated & ((near > 0) & ~right | (near < n) & ~left)
        at = np.flatnonzero(keep)
        skip = (right[at] + 2 * left[at] + 4 * both[at] + 8 * some[at]).astype(np.uint8)
        order = at[np.argsort(bucket[at], kind="stable")]
        skip = skip[np.argsort(bucket[at], kind="stable")]
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for b in np.unique(bucket[at]):
            o, k = order[cuts[b] : cuts[b + 1]], skip[cuts[b] : cuts[b + 1]]
            used, of = np.unique(doc[o], return_inverse=True)
            yield pd.DataFrame({"kind": [2], "bucket": [int(b)], "part": [pack(ids=ids[used], keys=keys[used], doc=of.astype(np.uint32), start=start[o], n=n[o], back=back[o], reach=reach[o], longer=longer[o], before=before[o], skip=k)]})

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for texts, ids, keys in _rows(batches):
            found, size = [], 0
            for letters, doc, offset, firsts, ends in segments(texts):
                h = Hashes(letters)
                stretch, place, start, n, gram = sampled(letters, firsts, ends, h)
                back = place - start
                reach = (h.of(start, start + n - 1 + LENGTH) ^ (back * 64 + n).astype(np.uint64)) * _MIX2
                right, left = place + LENGTH - SPLIT, place - SPLIT - 1
                # Which of the two digests matter depends on where the strings start.
                longer = np.where(right <= ends[stretch], h.of(place, np.minimum(right, len(letters))), 0)
                before = np.where(left >= firsts[stretch], h.of(np.maximum(left, 0), place + GRAM), 0)
                found.append((doc[stretch].astype(np.uint32), (start - firsts[stretch] + offset[stretch]).astype(np.uint32), n.astype(np.uint8), back.astype(np.uint8), reach, (longer >> np.uint64(32)).astype(np.uint32), (before >> np.uint64(32)).astype(np.uint32), ((gram >> np.uint64(40)) % np.uint64(buckets)).astype(np.int32)))
                size += len(start)
                if size >= FLUSH:
                    yield from deal(found, ids, keys)
                    found, size = [], 0
            if found:
                yield from deal(found, ids, keys)

    return make


def group_least(values: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least id of the rows with the same value, for every row; and the greatest."""
    order = np.argsort(values, kind="stable")
    at = np.flatnonzero(np.diff(values[order], prepend=~values[order][:1]) != 0)
    sizes = np.diff(np.append(at, len(values)))
    least, most = np.empty(len(values), dtype=np.int64), np.empty(len(values), dtype=np.int64)
    least[order] = np.repeat(np.minimum.reduceat(ids[order], at), sizes)
    most[order] = np.repeat(np.maximum.reduceat(ids[order], at), sizes)
    return least, most


def _dealt(kind: int, buckets: int, keys: np.ndarray, doc: np.ndarray, start: np.ndarray, n: np.ndarray) -> Iterator[pd.DataFrame]:
    """Runs of strings by bucket of their document."""
    bucket = ((keys >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)[doc]
    order = np.argsort(bucket, kind="stable")
    at = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in np.unique(bucket):
        o = order[at[b] : at[b + 1]]
        used, own = np.unique(doc[o], return_inverse=True)
        yield pd.DataFrame({"kind": [kind], "bucket": [int(b)], "part": [pack(keys=keys[used], doc=own.astype(np.uint32), start=start[o], n=n[o])]})


def _passed_on(batches: Iterator[pd.DataFrame], parts: list[bytes]) -> Iterator[pd.DataFrame]:
    """Runs go on as they are; the parts of tuples are gathered."""
    for rows in batches:
        runs = rows[rows["kind"] < 2]
        if len(runs):
            yield runs
        parts += rows.loc[rows["kind"] == 2, "part"].tolist()


def _settle(buckets: int):
    def settle(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts: list[bytes] = []
        yield from _passed_on(batches, parts)
        if not parts:
            return
        doc, known, keys = unpack_all(parts, "doc", "ids", "keys")
        ids = known[doc]
        (reach,) = unpack_all(parts, "reach")
        repeated = ids > group_least(reach, ids)[0]
        del reach
        start, n = unpack_all(parts, "start", "n")
        rows = np.flatnonzero(repeated)
        if len(rows):
            yield from _dealt(0, buckets, keys, doc[rows], start[rows], n[rows])
        # First documents of a reach: single strings matter where another document shares the longer stretch.
        first = np.flatnonzero(~repeated)
        doc, ids, start, n = doc[first], ids[first], start[first], n[first]
        back, skip = unpack_all(parts, "back", "skip")
        near, n = _near(n, back[first]), n.astype(np.int64)
        for name, low, count, done, known_shared in (("longer", start + (n - near).astype(np.uint32), near, 1, 4), ("before", start, n - near, 2, 8)):
            (value,) = unpack_all(parts, name)
            shared = np.isin(value[first], value[skip & known_shared > 0])
            least, most = group_least(value[first], ids)
            need = np.flatnonzero((count > 0) & (shared | (least < most)) & (skip[first] & done == 0))
            if len(need):
                yield from _dealt(1, buckets, keys, doc[need], low[need], count[need].astype(np.uint8))

    return settle


def _by_document(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, dict[int, tuple[int, int]]]:
    """Runs sorted by document and start, and each document's stretch of them."""
    doc, start, n, keys = unpack_all(parts, "doc", "start", "n", "keys")
    names, own = np.unique(keys, return_inverse=True)
    doc = own[doc]
    order = np.lexsort((start, doc))
    at = np.searchsorted(doc[order], np.arange(len(names) + 1))
    return start[order].astype(np.int64), n[order].astype(np.int64), {k: (a, b) for k, a, b in zip(names.tolist(), at[:-1], at[1:], strict=True)}


def _key(key: bytes) -> int:
    """What tells a document from others of its bucket."""
    return int.from_bytes(key[:8], "big")


def _single_strings(buckets: int):
    def strings(key: tuple, docs: pd.DataFrame, runs: pd.DataFrame) -> pd.DataFrame:
        if not len(runs) or not len(docs):
            return pd.DataFrame(columns=["kind", "bucket", "part"])
        start, n, at = _by_document(list(runs["part"]))
        docs = docs.drop_duplicates("key")  # equal rows have equal strings
        docs = docs[[_key(k) in at for k in docs["key"]]]
        if not len(docs):
            return pd.DataFrame(columns=["kind", "bucket", "part"])
        found = []
        for texts, ids, keys in _rows([docs]):
            spans = [at[_key(k)] for k in docs["key"]]
            for letters, doc, offset, firsts, ends in segments(texts):
                one, two = Hashes(letters, 1), Hashes(letters, 2)
                for d, off, a, b in zip(doc.tolist(), offset.tolist(), firsts.tolist(), ends.tolist(), strict=True):
                    low, high = spans[d]
                    s, c = start[low:high], n[low:high]
                    s = np.repeat(s - (np.cumsum(c) - c), c) + np.arange(c.sum())
                    s = s[(s >= off) & (s < off + min(SEGMENT, b - a - LENGTH + 1))]
                    where = s - off + a
                    found.append((np.full(len(s), d), s, one.of(where, where + LENGTH), two.of(where, where + LENGTH)))
            doc, s, h, g = (np.concatenate(v) for v in zip(*found, strict=True))
            g = (g >> np.uint64(48)).astype(np.uint16)
            # A string that other documents here have too is settled here; the least id of each is dealt.
            own = ids[doc]
            elsewhere = _repeated_strings(h, g, own)
            gone = np.flatnonzero(elsewhere)
            made = [(0, *x[["bucket", "part"]].iloc[0]) for x in _dealt(0, buckets, keys, doc[gone], s[gone].astype(np.uint32), np.ones(len(gone), dtype=np.uint8))] if len(gone) else []
            kept = np.flatnonzero(~elsewhere)
            doc, s, h, g = doc[kept], s[kept], h[kept], g[kept]
            bucket = (h >> np.uint64(40)).astype(np.int64) % buckets
            order = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for b in np.unique(bucket):
                o = order[cut[b] : cut[b + 1]]
                used, own = np.unique(doc[o], return_inverse=True)
                made.append((2, int(b), pack(ids=ids[used], keys=keys[used], doc=own.astype(np.uint32), start=s[o].astype(np.uint32), h=h[o], g=g[o])))
            return pd.DataFrame(made, columns=["kind", "bucket", "part"])

    return strings


def _repeated_strings(h: np.ndarray, g: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Rows for whose pair of digests another row has a smaller id."""
    at = np.flatnonzero(crowded(h >> np.uint64(32), 1))
    out = np.zeros(len(h), dtype=bool)
    if len(at):
        order = at[np.lexsort((g[at], h[at]))]
        new = np.append(0, (np.diff(h[order]) != 0) | (np.diff(g[order]) != 0))
        out[order] = ids[order] > group_least(np.cumsum(new), ids[order])[0]
    return out


def _settle_strings(buckets: int):
    def settle(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts: list[bytes] = []
        yield from _passed_on(batches, parts)
        if not parts:
            return
        doc, known, keys = unpack_all(parts, "doc", "ids", "keys")
        ids = known[doc]
        rows = np.flatnonzero(_repeated_strings(*unpack_all(parts, "h", "g"), ids))
        if len(rows):
            (start,) = unpack_all(parts, "start")
            yield from _dealt(0, buckets, keys, doc[rows], start[rows], np.ones(len(rows), dtype=np.uint8))

    return settle


def removed_spans(starts: np.ndarray, counts: np.ndarray) -> list[tuple[int, int]]:
    """Maximal spans covered by the strings that start at starts[i], ..., starts[i] + counts[i] - 1; starts ascend."""
    ends = np.maximum.accumulate(starts + counts - 1 + LENGTH)
    new = np.flatnonzero(np.append(True, starts[1:] > ends[:-1]))
    return list(zip(starts[new].tolist(), ends[np.append(new[1:] - 1, len(ends) - 1)].tolist(), strict=True))


def _cleaned(key: tuple, docs: pd.DataFrame, runs: pd.DataFrame) -> pd.DataFrame:
    start, n, at = _by_document(list(runs["part"])) if len(runs) else (None, None, {})
    rows = []
    for doc_id, k, packed in zip(docs["doc_id"], docs["key"], docs["raw"], strict=True):
        raw = zstandard.decompress(packed)
        low, high = at.get(_key(k), (0, 0))
        spans = removed_spans(start[low:high], n[low:high]) if high > low else []
        kept, done = hashlib.sha256(), 0
        for a, b in spans:
            kept.update(raw[done:a])
            done = b
        kept.update(raw[done:])
        rows.append((doc_id, len(raw), sum(b - a for a, b in spans), len(spans), kept.hexdigest(), [x for s in spans for x in s]))
    return pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def _dealt_texts(buckets: int):
    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            bucket = [(_key(k) >> 32) % buckets for k in rows["key"]]
            yield pd.DataFrame({"bucket": bucket, "doc_id": rows["doc_id"], "key": rows["key"], "raw": [zstandard.compress(x.encode(), 3) for x in rows["text"]]})

    return deal


def find_repeats(docs: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) of every row; spans lists starts and ends.

    Buckets are as many as keep a task's share near ``task_bytes`` of text. Texts are shuffled once,
    compressed, by bucket of their document, and used twice.
    """
    rows = keyed(docs)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(-(-size // task_bytes), 2 * docs.sparkSession.sparkContext.defaultParallelism)
    tuples = rows.select("doc_id", "key", "text").mapInPandas(_tuples(buckets), PACKED)
    settled = materialise(tuples.groupBy("bucket").applyInPandas(_settle(buckets), PACKED), "suffixes")
    dealt = rows.select("doc_id", "key", "text").mapInPandas(_dealt_texts(buckets), "bucket int, doc_id long, key binary, raw binary").groupBy("bucket")
    open_runs, done = settled.filter("kind = 1").select("bucket", "part"), settled.filter("kind = 0").select("bucket", "part")
    strings = dealt.cogroup(open_runs.groupBy("bucket")).applyInPandas(_single_strings(buckets), PACKED)
    more = strings.groupBy("bucket").applyInPandas(_settle_strings(buckets), PACKED).select("bucket", "part")
    cleaned = dealt.cogroup(done.unionByName(more).groupBy("bucket")).applyInPandas(_cleaned, f"{RESULT}, spans array<long>")
    return null_ids(cleaned)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_repeats(table(spark, sf_dir, "documents")).drop("spans")
