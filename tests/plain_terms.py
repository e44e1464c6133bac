"""Term correction in plain Python, one text at a time, for tests."""

from __future__ import annotations

import difflib
import re


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def correct_text(text: str, words: list[str], han: float = 0.75, latin: float = 0.78) -> tuple[str, list[tuple[str, str, float]]]:
    words, out, fixes, at = sorted(words, key=lambda w: (-len(w), w)), "", [], 0
    while at < len(text):
        here = [w for w in words if w[0] == text[at] and re.match("[一-鿿]", w)]
        word = next((w for w in here if text.startswith(w, at)), None)
        if word is None:
            fit = [(1 - edit_distance(text[at : at + len(w)], w) / len(w), w) for w in here if at + len(w) <= len(text)]
            score, word = max(fit, key=lambda x: x[0], default=(0, ""))
            if score >= han:
                fixes.append((text[at : at + len(word)], word, round(score, 2)))
            else:
                word = text[at]
        out += word
        at += len(word)
    known = {w.lower().replace(" ", ""): w for w in words if w[0].isascii() and len(w) >= 3}

    def whole(m: re.Match) -> str:
        run = m[0].strip()
        key = run.lower().replace(" ", "")
        near = [] if len(run) < 4 or key in known else difflib.get_close_matches(key, list(known), 1, latin)
        if not near:
            return m[0]
        fixes.append((run, known[near[0]], round(difflib.SequenceMatcher(None, key, near[0]).ratio(), 2)))
        return m[0].replace(run, known[near[0]], 1)

    return re.sub(r"[A-Za-z][A-Za-z0-9+#.\- ]{2,24}", whole, out), fixes
