"""License scans: phrases and identifier tags by Aho-Corasick, licence expressions by shunting-yard.

Texts are folded to words (A-Z lower-cased; runs of digits, a-z and characters beyond ASCII). One
automaton finds every notice phrase in the folded words; a second one finds identifier tags in the
text. Expressions come from both: what stands after a tag, and notices that are joined by ``and``,
``or`` or ``with`` and otherwise only words such as "the" or "version". A shunting-yard parser with
the precedence ``with`` > ``and`` > ``or`` brings each into Reverse Polish form, and its value tells
whether the accepted licence families satisfy it: ``allowed`` is true if all expressions of the text
hold, false if one doesn't, null if there is none. An identifier belongs to the longest family name
that begins it (``gpl-2.0-or-later`` to ``gpl``); one of no family is not accepted.

Labels are the base labels, those of notices, and the identifiers in tagged expressions. The score
is the probability that one piece of evidence at least is right, were they independent.

Cases: a null text counts as empty: no words, no labels, score 0. A malformed expression is left out.
Equal rows each give a row; a null doc_id is kept; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_and_text, null_ids, table
from .shingles import fold

#: The base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Notice phrases of the method, in folded words, and their labels.
NOTICES = {
    "all rights reserved": "proprietary",
    "apache software license": "apache",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
    "mozilla public license": "mpl",
    "gnu gpl": "gpl",
    "gnu lgpl": "lgpl",
    "gnu agpl": "agpl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "gnu free documentation license": "gfdl",
    "eclipse public license": "epl",
    "european union public licence": "eupl",
    "common development and distribution license": "cddl",
    "common public license": "cpl",
    "server side public license": "sspl",
    "business source license": "busl",
    "elastic license": "elastic",
    "boost software license": "bsl",
    "zlib license": "zlib",
    "artistic license": "artistic",
    "academic free license": "afl",
    "microsoft public license": "ms-pl",
    "python software foundation license": "psf",
    "isc license": "isc",
    "sil open font license": "ofl",
    "open database license": "odbl",
    "the unlicense": "unlicense",
    "public domain": "public-domain",
    "cc0": "cc0",
    "creative commons zero": "cc0",
    "cc by": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
}
#: Phrases that name an exception, which only counts after ``with``.
EXCEPTIONS = {"classpath exception": "classpath-exception", "llvm exception": "llvm-exception", "llvm exceptions": "llvm-exception", "linking exception": "linking-exception", "font exception": "font-exception", "gcc runtime library exception": "gcc-exception"}
#: Licence families by what they ask of those who pass the work on.
FAMILIES = {
    "permissive": "0bsd afl apache artistic blueoak bsd bsl cc-by cc0 curl ecl hpnd icu isc libpng mit ms-pl mulanpsl ncsa ntp odc-by openssl pddl php postgresql psf public-domain python tcl unicode unlicense upl w3c wtfpl x11 zlib zpl",
    "weak copyleft": "apsl cddl cecill-c cpl epl ipl lgpl mpl ms-rl ofl spl",
    "copyleft": "agpl cc-by-sa cecill eupl gfdl gpl odbl osl qpl rpl sleepycat sspl",
    "restricted": "busl cc-by-nc cc-by-nc-nd cc-by-nc-sa cc-by-nd commons-clause elastic json polyform proprietary",
}
CLASS_OF = {name: kind for kind, names in FAMILIES.items() for name in names.split()}
#: Classes whose licences are accepted in training data.
ACCEPTED = frozenset({"permissive"})
#: Words that may stand between two notices of one expression, besides one operator.
FILLERS = frozenset("the a an either both under terms of license licence licenses licensed version versions v or later any at your option gnu".split()) - {"or"}
BETWEEN = 8
#: Tags that a licence expression follows.
TAGS = ("spdx-license-identifier:", "license-expression:", "packagelicensedeclared:", "packagelicenseconcluded:", "licenseconcluded:", "licenseinfoinfile:")
#: How far a kind of evidence alone supports that the text carries a licence.
WEIGHT = {"base": 0.9, "tag": 0.95, "notice": 0.6}
RANK = {"or": 1, "and": 2, "with": 3}
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<string>, allowed boolean"

_TOKEN = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+:-]*")


@lru_cache(maxsize=1)
def _phrases() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase in (*BASE, *NOTICES, *EXCEPTIONS):
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


@lru_cache(maxsize=1)
def _tags() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for tag in TAGS:
        found.add_word(tag, tag)
    found.make_automaton()
    return found


def parse_expression(text: str, at: int = 0, end: int | None = None) -> list[str] | None:
    """Reverse Polish form of the licence expression at ``text[at:end]``; None if it is malformed.

    >>> parse_expression("MIT OR Apache-2.0 WITH LLVM-exception AND BSD-3-Clause")
    ['mit', 'apache-2.0', 'llvm-exception', 'with', 'bsd-3-clause', 'and', 'or']
    """
    out: list[str] = []
    waiting: list[str] = []
    operand_next = True
    for m in _TOKEN.finditer(text, at, len(text) if end is None else end):
        token = m[0].lower()
        if text[at : m.start()].strip() or (not operand_next and token not in RANK and token != ")"):
            break  # something else follows the expression
        at = m.end()
        if token == "(":
            waiting.append(token)
        elif token == ")":
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if not waiting or operand_next:
                return None
            waiting.pop()
        elif token in RANK:
            if operand_next:
                return None
            while waiting and waiting[-1] != "(" and RANK[waiting[-1]] >= RANK[token]:
                out.append(waiting.pop())
            waiting.append(token)
            operand_next = True
        else:
            out.append(token)
            operand_next = False
    if operand_next or "(" in waiting:
        return None
    return out + waiting[::-1]


@lru_cache(maxsize=1 << 12)
def family(identifier: str) -> str | None:
    """The longest family name that begins a licence identifier, ending at one of its hyphens."""
    parts = identifier.rstrip("+").split("-")
    names = ("-".join(parts[:n]) for n in range(len(parts), 0, -1))
    return next((x for x in names if x in CLASS_OF), None)


def evaluate_expression(rpn: list[str], accepted: frozenset[str] = ACCEPTED) -> bool:
    """Whether a licence expression is satisfied if only licences of the accepted classes may be used.

    ``x with y`` holds if x does: an exception only adds permissions.
    """
    stack: list[bool] = []
    for token in rpn:
        if token in RANK:
            right, left = stack.pop(), stack.pop()
            stack.append(left if token == "with" else left and right if token == "and" else left or right)
        else:
            stack.append(CLASS_OF.get(family(token)) in accepted)
    return stack.pop()


def identifiers(rpn: list[str]) -> list[str]:
    """Licence identifiers of a parsed expression, without the exceptions that follow ``with``."""
    stack: list[list[str]] = []
    for token in rpn:
        if token in RANK:
            right, left = stack.pop(), stack.pop()
            stack.append(left if token == "with" else left + right)
        else:
            stack.append([token])
    return stack.pop()


def joined_notices(line: str, places: list[tuple[int, int, str]]) -> list[str]:
    """Expressions that the phrases at (begin, end) of the folded line make, longest phrases first."""
    out: list[str] = []
    end = -1
    for begin, stop, phrase in sorted(places, key=lambda x: (x[0], -x[1])):
        if begin < end:
            continue  # within a longer phrase
        words = line[end:begin].split(" ", BETWEEN + 1) if out and end >= 0 else None
        operators = [x for x in words if x in RANK] if words is not None and len(words) <= BETWEEN + 1 else []
        joined = len(operators) == 1 and all(not x or x in RANK or x in FILLERS or x.isdigit() for x in words)
        if phrase in EXCEPTIONS:
            if not joined or operators != ["with"]:
                continue
            out[-1] += f" with {EXCEPTIONS[phrase]}"
        else:
            label = BASE.get(phrase) or NOTICES[phrase]
            if joined and operators != ["with"]:
                out[-1] += f" {operators[0]} {label}"
            else:
                out.append(label)
        end = stop
    return out


def phrase_places(line: str) -> list[tuple[int, int, str]]:
    """(begin, end, phrase) of every phrase in a folded line, by end."""
    return [(end - len(phrase) - 1, end, phrase) for end, phrase in _phrases().iter(line)]


def folded(text: str) -> str:
    return (b" " + b" ".join(fold(text)) + b" ").decode("latin-1")


def scan_text(text: str) -> dict:
    line = folded(text)
    n_words = line.count(" ") - 1 if line.strip() else 0
    starts: list[int] = []
    base: set[str] = set()
    more: set[str] = set()
    places = phrase_places(line)
    at = n = 0
    for begin, _, phrase in places:
        if phrase in BASE:
            n += line.count(" ", at, begin)  # words that end before the phrase, counted on from the last one
            at = begin
            starts.append(n)
            base.add(BASE[phrase])
        elif phrase in NOTICES:
            more.add(NOTICES[phrase])
    tagged: set[str] = set()
    parsed: list[list[str]] = []
    lower = text.lower()
    # Where lower-casing changes lengths, offsets in the two texts differ, so the expression is read from the lower-cased text.
    if ":" in text and (ends := [end + 1 for end, _ in _tags().iter(lower)]):
        rest, done = [], 0
        for begin in ends:
            line_end = lower.find("\n", begin)
            line_end = len(lower) if line_end < 0 else line_end
            if rpn := parse_expression(lower, begin, line_end):
                tagged.update(identifiers(rpn))
                parsed.append(rpn)
            rest.append(lower[done:begin])
            done = max(done, line_end)
        # The names in a tagged line are no notices of their own.
        line = folded("\n".join([*rest, lower[done:]]))
        places = phrase_places(line)
    parsed = [rpn for x in joined_notices(line, places) if (rpn := parse_expression(x))] + parsed
    doubt = 1.0
    for kind, labels in (("base", base), ("tag", tagged), ("notice", more - base)):
        doubt *= (1 - WEIGHT[kind]) ** len(labels)
    return {
        "n_words": n_words, "n_base": len(starts), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
        "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | more | tagged)), "score": 1 - doubt,
        "expressions": [" ".join(x) for x in parsed], "allowed": all(map(evaluate_expression, parsed)) if parsed else None,
    }


def scan(docs: DataFrame) -> DataFrame:
    """Licence evidence per document; one pass without a shuffle."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = pd.DataFrame([scan_text(x or "") for x in batch["text"]], columns=["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "expressions", "allowed"])
            found.insert(0, "doc_id", batch["doc_id"].astype("Int64"))
            yield found.astype({"first_word": "Int64", "last_word": "Int64", "allowed": "boolean"})

    return null_ids(id_and_text(docs).mapInPandas(rows, SCHEMA))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beside the contract's columns: the expressions in Reverse Polish form, and whether they are allowed."""
    found = scan(table(spark, sf_dir, "documents"))
    return found.withColumn("expressions", F.array_join("expressions", ","))
