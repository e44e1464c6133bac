"""Word shingles as 32-bit ids, shared by the operators that compare texts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import xxhash

#: Factors of the rolling hash and of its last mixing step; any odd numbers would do.
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)

#: What breaks words: everything but letters, digits and characters beyond ASCII; or white space alone.
FOLD = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))
BLANKS = bytes(0x20 if 0x09 <= c <= 0x0D else c for c in range(256))


def fold(text: str) -> list[bytes]:
    """Words of the text as UTF-8: A-Z lower-cased, ASCII blanks and punctuation as breaks."""
    return text.encode().lower().translate(FOLD).split()


#: Bytes hashed at once; powers of the step and of its inverse for each place in them.
_SEGMENT = 1 << 16
with np.errstate(over="ignore"):
    _POWER = np.cumprod(np.full(_SEGMENT, _STEP), dtype=np.uint64)
    _INVERSE = np.cumprod(np.full(_SEGMENT, pow(int(_STEP), -1, 1 << 64), dtype=np.uint64), dtype=np.uint64)


def _hash_segment(raw: bytes) -> np.ndarray:
    return _hash_and_starts(raw)[0]


def _hash_and_starts(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words between blanks, and where they start."""
    letters = np.frombuffer(raw, dtype=np.uint8)
    inside = np.zeros(len(letters) + 2, dtype=np.bool_)
    np.not_equal(letters, 0x20, out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    sums = np.zeros(len(letters) + 1, dtype=np.uint64)
    np.cumsum(letters * _POWER[: len(letters)], out=sums[1:])
    found = (sums[ends] - sums[starts]) * _INVERSE[starts]
    found ^= found >> np.uint64(29)
    return found * _MIX, starts


def hashed_words(text: str, breaks: bytes = FOLD) -> np.ndarray:
    """64-bit hashes of the words of a text, in order, without making the words; ASCII letters are lower-cased.

    A word's hash is a polynomial in its bytes, read off running sums. Long texts are hashed by
    segments cut between words; a word longer than a segment by another function.
    """
    raw = text.encode().lower().translate(breaks)
    if len(raw) <= _SEGMENT:
        return _hash_segment(raw)
    parts, at = [], 0
    while at < len(raw):
        end = len(raw) if len(raw) - at <= _SEGMENT else raw.rfind(b" ", at, at + _SEGMENT)
        if end <= at:  # a blank at the cut, or no blank within reach
            end = raw.find(b" ", at + 1) if raw[at] != 0x20 else at + 1
            end = len(raw) if end < 0 else end
        part = raw[at:end]
        parts.append(_hash_segment(part) if len(part) <= _SEGMENT else np.array([xxhash.xxh3_64_intdigest(part)], dtype=np.uint64))
        at = end
    return np.concatenate(parts)


def hashed_texts(texts: Iterable[str]) -> Iterator[np.ndarray]:
    """``hashed_words`` of each text in turn; short texts are hashed together."""
    held: list[bytes] = []
    size = 0

    def out() -> Iterator[np.ndarray]:
        found, starts = _hash_and_starts(b" ".join(held))
        ends = np.cumsum([len(x) + 1 for x in held])
        yield from np.split(found, np.searchsorted(starts, ends[:-1]))

    for text in texts:
        raw = text.encode().lower().translate(FOLD)
        if held and size + len(raw) + 1 > _SEGMENT:
            yield from out()
            held, size = [], 0
        if len(raw) >= _SEGMENT:
            yield hashed_words(text)
        else:
            held.append(raw)
            size += len(raw) + 1
    if held:
        yield from out()


def shingle_ids(text: str, width: int = 5) -> np.ndarray:
    """Ids of all runs of ``width`` lower-cased words, in order; a shorter text with words is one run."""
    words = hashed_words(text.lower(), BLANKS)
    n = len(words) - width + 1
    if not len(words):
        return np.empty(0, dtype=np.uint32)
    if n < 1:
        width, n = len(words), 1
    rolled = words[:n].copy()
    for i in range(1, width):
        rolled *= _STEP
        rolled += words[i : i + n]
    rolled ^= rolled >> np.uint64(29)
    rolled *= _MIX
    return (rolled >> np.uint64(32)).astype(np.uint32)
