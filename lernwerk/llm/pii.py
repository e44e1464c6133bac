"""Personal data: base patterns, and terms that disclose a protected entity.

A protected entity is a value found by a base pattern, or a secret that is assigned to a name such
as ``token``. A term (a word) discloses it if pointwise mutual information, estimated from document
counts of the whole corpus, reaches ``THRESHOLD`` of the entity's own information:

    log2(df(term, entity) * N / (df(term) * df(entity))) >= THRESHOLD * log2(N / df(entity))

df(term, entity) counts the documents that hold both, wherever in their texts. Copies are no evidence:
the pair must stand in at least ``SUPPORT`` texts whose words beside the term differ, and these must
be at least ``DIVERSE`` of all texts with the pair, which edited copies of one text don't reach.

In every text that holds the entity, each occurrence of a disclosing term is a span. ``sanitise``
generalises it to its first letters if the class of all words that begin with them doesn't disclose
the entity, and removes it otherwise. A text without an entity stays as it is.

Cases: a null text counts as empty: no spans. Equal rows each give a row; a null doc_id is kept;
other columns are ignored (detection) or kept (``sanitise``). Offsets count code points.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, id_and_text, known_id, materialise, null_ids, table

KINDS = ("email", "ip", "card", "phone", "secret", "term")
BASE, SECRET, TERM = 4, 4, 5  # base kinds are those below BASE
THRESHOLD, SUPPORT, DIVERSE = 0.9, 3, 0.5
#: Letters that a generalised term keeps, and words on either side that tell the places of a term apart.
LETTERS, BESIDE = 3, 2
FLUSH = 300_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A match can't start inside a run of digits: whether one follows is the same for the whole run.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SECRET = re.compile(r"(?<![A-Za-z0-9])(?:token|secret|passwd|password|api[_-]?key|access[_-]?key)[\"']?[\x20\t]*[:=][\x20\t]*[\"']?((?=[^\s\"',;]*[0-9])[^\s\"',;]{8,})", re.I)
_TERM = re.compile(r"[^\W\d_]{2,}")
_NO_DIGIT = re.compile(r"[^0-9]+")

FOUND = "doc_id long, key binary, spans array<struct<kind: int, start: int, end: int, entity: long>>, text string"
PAIR = "entity long, term long, context long, copies long"


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches are sought from each @, so that long runs without one cost nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base matches, by start and then kind."""
    spans = [(a, 0, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m[0].split(".")):
            spans.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if 14 <= len(digits := _NO_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
            spans.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NO_DIGIT.sub("", m[0])) <= 15:
                spans.append((m.start(), 3, m.end()))
    return sorted(spans)


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def entity_of(kind: int, value: str) -> int:
    """Values of one entity may be written differently: case and separators don't count."""
    return _hash(f"{kind} {value.lower() if kind < 2 else _NO_DIGIT.sub('', value)}")


def secret_spans(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of assigned secrets that overlap no base match."""
    if "=" not in text and ":" not in text:
        return []
    found = (m.span(1) for m in _SECRET.finditer(text))
    return [(a, SECRET, b) for a, b in found if not any(x < b and a < y for x, _, y in spans)]


def term_places(text: str, spans: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """(lower-cased term, start, end) of all terms outside the spans."""
    held, at, out = sorted(spans), 0, []
    for m in _TERM.finditer(text):
        while at < len(held) and held[at][1] <= m.start():
            at += 1
        if at == len(held) or held[at][0] >= m.end():
            out.append((m[0].lower(), m.start(), m.end()))
    return out


def kin(term: str) -> str:
    """The class of words that a term is generalised to."""
    return f"{term[:LETTERS]}*"


def find_base(docs: DataFrame) -> DataFrame:
    """Base spans and secrets of every row, and the text of those that have any; one pass without a shuffle."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            spans = [base_spans(x) for x in batch["text"]]
            spans = [sorted(s + secret_spans(x, s)) for x, s in zip(batch["text"], spans, strict=True)]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"].astype("Int64"), "key": batch["key"],
                "spans": [[{"kind": k, "start": a, "end": b, "entity": entity_of(k, x[a:b])} for a, k, b in s] for x, s in zip(batch["text"], spans, strict=True)],
                "text": [x if s else None for x, s in zip(batch["text"], spans, strict=True)],
            })

    return keyed(docs).mapInPandas(rows, FOUND)


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, key): the key tells rows apart unless id and text are equal."""
    rows = id_and_text(docs).withColumn("text", F.coalesce("text", F.lit("")))
    return rows.withColumn("key", F.unhex(F.md5(F.concat_ws(" ", F.col("doc_id").cast("string"), "text").cast("binary"))))


def term_frequencies(docs: DataFrame) -> DataFrame:
    """(term, df): number of documents with each term, and with each class of terms, over all documents.

    Each task adds up its terms before they are shuffled, with at most FLUSH counters at once.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter[str] = Counter()

        def out() -> pd.DataFrame:
            made = pd.DataFrame({"term": pd.Series(map(_hash, counts), dtype="int64"), "df": pd.Series(counts.values(), dtype="int64")})
            counts.clear()
            return made

        for batch in batches:
            for text in batch["text"]:
                terms = {x.lower() for x in set(_TERM.findall(text))}
                counts.update(terms)
                counts.update({kin(x) for x in terms})
                if len(counts) > FLUSH:
                    yield out()
        yield out()

    texts = id_and_text(docs).select(F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInPandas(rows, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def cooccurring(texts: DataFrame) -> DataFrame:
    """(entity, term, context, copies) of every entity and term, or class of terms, of every text.

    ``texts`` has different texts with their spans, the entities to look at (wanted) and the number of
    rows with each text (copies). The context is a hash of the words beside the term's first place.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, spans, wanted, copies in zip(batch["text"], batch["spans"], batch["wanted"], batch["copies"], strict=True):
                places = term_places(text, [(x["start"], x["end"]) for x in spans])
                first: dict[str, int] = {}
                for i, (term, _, _) in enumerate(places):
                    first.setdefault(term, i)
                    first.setdefault(kin(term), i)
                for term, i in first.items():
                    beside = [x for x, _, _ in places[max(0, i - BESIDE) : i + BESIDE + 1]]
                    context = _hash(" ".join(beside))
                    out += [(int(e), _hash(term), context, copies) for e in wanted]
            yield pd.DataFrame(out, columns=["entity", "term", "context", "copies"])

    return texts.select("text", "spans", "wanted", "copies").mapInPandas(rows, PAIR)


def disclosing(texts: DataFrame, terms: DataFrame, n: int, threshold: float = THRESHOLD, support: int = SUPPORT, diverse: float = DIVERSE) -> DataFrame:
    """(entity, term, share): pairs whose term, or class of terms, discloses the entity.

    Only entities of at least ``support`` different texts can have such terms, so only their texts are
    taken apart. Rows are added up by pair before they are shuffled.
    """
    held = texts.select("copy", "copies", F.explode(F.array_distinct("spans.entity")).alias("entity"))
    entities = held.groupBy("entity").agg(F.sum("copies").alias("with_entity"), F.count("*").alias("in_texts")).filter(F.col("in_texts") >= support)
    wanted = held.join(entities, "entity").groupBy("copy").agg(F.collect_list("entity").alias("wanted"))  # the entities of one text
    seen = cooccurring(texts.join(wanted, "copy")).groupBy("entity", "term", "context").agg(F.sum("copies").alias("copies"), F.count("*").alias("texts"))
    pairs = seen.groupBy("entity", "term").agg(F.sum("copies").alias("together"), F.sum("texts").alias("texts"), F.count("*").alias("contexts"))
    pairs = pairs.filter((F.col("contexts") >= support) & (F.col("contexts") >= diverse * F.col("texts")))
    scored = pairs.join(entities, "entity").join(terms, "term")
    own = F.log2(F.lit(n) / F.col("with_entity"))
    share = F.when(own > 0, F.log2(F.col("together") * F.lit(n) / (F.col("df") * F.col("with_entity"))) / own)
    return scored.select("entity", "term", share.alias("share")).filter(F.col("share") >= threshold)


def spans_of_terms(texts: DataFrame) -> DataFrame:
    """(copy, added): spans of the given terms of each text, and what each is generalised to ('' if it is removed)."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, own, found in zip(batch["text"], batch["spans"], batch["terms"], strict=True):
                known = set(found)
                places = term_places(text, [(x["start"], x["end"]) for x in own])
                out.append([{"start": a, "end": b, "mark": "" if _hash(kin(t)) in known else kin(text[a:b])} for t, a, b in places if _hash(t) in known])
            yield pd.DataFrame({"copy": batch["copy"], "added": out})

    return texts.select("copy", "text", "spans", "terms").mapInPandas(rows, "copy binary, added array<struct<start: int, end: int, mark: string>>")


def find_spans(docs: DataFrame, threshold: float = THRESHOLD, support: int = SUPPORT, diverse: float = DIVERSE) -> DataFrame:
    """(doc_id, key, spans, added) of every row: base spans and secrets, and the spans of disclosing terms."""
    found = materialise(find_base(docs).withColumn("copy", F.unhex(F.md5(F.col("text").cast("binary")))), "personal")
    n = found.count()
    texts = found.filter("text is not null").groupBy("copy").agg(F.count("*").alias("copies"), F.first("text").alias("text"), F.first("spans").alias("spans"))
    pairs = materialise(disclosing(texts, term_frequencies(docs), n, threshold, support, diverse), "disclosing")
    held = texts.select("copy", F.explode(F.array_distinct("spans.entity")).alias("entity"))
    terms = held.join(pairs, "entity").groupBy("copy").agg(F.collect_set("term").alias("terms"))  # of one text
    added = spans_of_terms(texts.join(terms, "copy")).filter("size(added) > 0")
    return null_ids(found.join(added, "copy", "left").select("doc_id", "key", "spans", "added"))


def sanitise(docs: DataFrame, threshold: float = THRESHOLD, support: int = SUPPORT) -> DataFrame:
    """The rows with personal data replaced in the text: base matches and disclosing terms.

    Matches become a placeholder of their kind; terms are generalised or removed. All columns are
    kept; a null text stays null.
    """

    @F.pandas_udf(T.StringType())
    def rewrite(texts: pd.Series, base: pd.Series, added: pd.Series) -> pd.Series:
        out = []
        for text, own, more in zip(texts, base, added, strict=True):
            if text is None or ((own is None or not len(own)) and (more is None or not len(more))):
                out.append(text)
                continue
            spans = [(x["start"], x["end"], f"[{KINDS[x['kind']].upper()}]") for x in (own if own is not None else [])]
            spans += [(x["start"], x["end"], x["mark"]) for x in (more if more is not None else [])]
            parts, at = [], 0
            for start, end, mark in sorted(spans):
                if start >= at:
                    parts += [text[at:start], mark]
                    at = end
                elif end > at:  # overlaps the span before, whose placeholder covers both
                    at = end
            out.append("".join([*parts, text[at:]]))
        return pd.Series(out, dtype=object)

    spans = find_spans(docs, threshold, support).filter("size(spans) > 0 or added is not null").dropDuplicates(["key"])
    key, own, more = fresh(docs, "_lw_key", "_lw_spans", "_lw_added")
    spans = spans.select(F.col("key").alias(key), F.col("spans").alias(own), F.col("added").alias(more))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest_of = F.unhex(F.md5(F.concat_ws(" ", known_id().cast("string"), text).cast("binary")))
    rows = docs.withColumn(key, digest_of).join(spans, key, "left")
    return rows.withColumn("text", rewrite(F.col("text").cast("string"), own, more)).select(*docs.columns)


def digest(found: DataFrame) -> DataFrame:
    """Counts per kind and the spans as text."""

    def written(spans: str) -> str:
        listed = f"array_sort(transform({spans}, x -> struct(x.start as start, x.kind as kind, x.end as end)))"
        return f"array_join(transform({listed}, x -> concat(element_at(array({', '.join(map(repr, KINDS))}), x.kind + 1), ':', x.start, ':', x.end)), ',')"

    count = lambda kind: F.expr(f"cast(size(filter(spans, x -> x.kind = {kind})) as long)")
    base = f"filter(spans, x -> x.kind < {BASE})"
    every = f"concat(transform(spans, x -> struct(x.start as start, x.kind as kind, x.end as end)), coalesce(transform(added, x -> struct(x.start as start, {TERM} as kind, x.end as end)), array()))"
    return found.select("doc_id", *(count(i).alias(f"n_{kind}") for i, kind in enumerate(KINDS[:BASE])), F.sha2(F.expr(written(base)).cast("binary"), 256).alias("base_sha256"),
                        F.expr(written(every)).alias("spans"), count(SECRET).alias("n_secret"), F.expr("cast(coalesce(size(added), 0) as long)").alias("n_term"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find_spans(table(spark, sf_dir, "documents")))
