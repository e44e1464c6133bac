"""Documents to blocks to chunks (B)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.shared import new_path
from ..sources.store import BucketStore
from ..sources.views import Registry
from .tags import tag_briefs

R = Registry()
TARGET, OVERLAP, LONG = 700, 105, 1.6
HEADING = r"^(#{1,6})\s+(.+)$"
# Fixed value: what a numbered heading of at most 60 characters starts with.
NUMBERED = r"^(第[一二三四五六七八九十百零\d]+[章节部分]|[一二三四五六七八九十]+、|\d+(\.\d+){1,2}\s+\S)"
SENTENCE_END = r"(?<=[。！？；!?;])"


def split_paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, text): paragraphs between blank lines, their lines joined by one space (B1)."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"\r\n?", "\n")
    rows = docs.select("doc_id", F.posexplode(F.split(text, r"\n\s*\n")).alias("pos", "raw"))
    lines = F.filter(F.transform(F.split("raw", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return rows.select("doc_id", "pos", X.squeeze(F.array_join(lines, " ")).alias("text")).filter("text <> ''")


def section_path(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, pos, text, section_path): headings are taken out and name the path of what follows (B2).

    A level's heading holds while no heading of a higher level has come since; so each level is one
    forward fill, valid if it stands after the last heading above it. Levels beyond six count as six.
    """
    marks = F.length(F.regexp_extract("text", HEADING, 1))
    numbered = (F.length("text") <= 60) & F.col("text").rlike(NUMBERED)
    dotted = F.col("text").rlike(r"^\d")
    level = F.when(marks > 0, marks).when(numbered & dotted, F.regexp_count("text", F.lit(r"\.")) + 1).when(numbered, 1)
    title = F.when(marks > 0, F.trim(F.regexp_extract("text", HEADING, 2))).otherwise(F.col("text"))
    rows = paragraphs.withColumns({"_level": F.when(level.isNotNull(), F.least(level, F.lit(6))), "_title": title})
    before = W.partitionBy("doc_id").orderBy("pos")
    last = lambda n: F.last(F.when(F.col("_level") == n, F.struct("pos", "_title")), ignorenulls=True).over(before)
    rows = rows.withColumns({f"_h{n}": last(n) for n in range(1, 7)})
    parts, above = [], F.lit(-1)
    for n in range(1, 7):
        at = F.coalesce(F.col(f"_h{n}.pos"), F.lit(-1))
        parts.append(F.when(at > above, F.col(f"_h{n}._title")))
        above = F.greatest(above, at)
    return rows.filter("_level is null").select("doc_id", "pos", "text", F.concat_ws(" > ", *parts).alias("section_path"))


def toc_forward_fill(bookmarks: DataFrame) -> DataFrame:
    """(doc_id, page, path) for every page up to the last bookmark, from bookmarks(doc_id, seq, level, title, page)."""
    before = W.partitionBy("doc_id").orderBy("seq")
    rows = bookmarks.withColumns({f"_h{n}": F.last(F.when(F.col("level") == n, F.struct("seq", "title")), ignorenulls=True).over(before) for n in range(1, 7)})
    parts, above = [], F.lit(-1)
    for n in range(1, 7):
        at = F.coalesce(F.col(f"_h{n}.seq"), F.lit(-1))
        parts.append(F.when(at > above, F.col(f"_h{n}.title")))
        above = F.greatest(above, at)
    by_page = rows.groupBy("doc_id", "page").agg(F.max_by(F.concat_ws(" > ", *parts), "seq").alias("path"))
    pages = by_page.groupBy("doc_id").agg(F.max("page").alias("n")).select("doc_id", F.explode(F.sequence(F.lit(1), "n")).alias("page"))
    filled = pages.join(by_page, ["doc_id", "page"], "left")
    return filled.select("doc_id", "page", F.last("path", ignorenulls=True).over(W.partitionBy("doc_id").orderBy("page")).alias("path"))


def table_blocks(cells: DataFrame, head: str = "[表格 {n}]") -> DataFrame:
    """One text block per table of cells(doc_id, table_no, row_no, col_no, text): cells joined by ' | ', blank rows dropped."""
    cell = F.trim(F.coalesce("text", F.lit("")))
    rows = cells.groupBy("doc_id", "table_no", "row_no").agg(F.array_sort(F.collect_list(F.struct("col_no", cell.alias("t")))).alias("c"), F.max(F.length(cell)).alias("longest"))
    rows = rows.filter("longest > 0").withColumn("line", F.array_join(F.transform("c", lambda x: x["t"]), " | "))
    tables = rows.groupBy("doc_id", "table_no").agg(F.array_sort(F.collect_list(F.struct("row_no", "line"))).alias("r"))
    title = F.replace(F.lit(head), F.lit("{n}"), F.col("table_no").cast("string"))
    return tables.select("doc_id", "table_no", F.concat(title, F.lit("\n"), F.array_join(F.transform("r", lambda x: x["line"]), "\n")).alias("text"))


def slide_blocks(frames: DataFrame) -> DataFrame:
    """One block per slide of frames(doc_id, slide_no, shape_no, text), named by its first line."""
    rows = frames.filter(F.trim("text") != "").groupBy("doc_id", "slide_no").agg(F.array_sort(F.collect_list(F.struct("shape_no", F.trim("text").alias("t")))).alias("s"))
    text = F.array_join(F.transform("s", lambda x: x["t"]), "\n")
    first = F.substring(F.element_at(F.split(text, "\n"), 1), 1, 60)
    return rows.select("doc_id", "slide_no", text.alias("text"), F.concat(F.lit("第 "), F.col("slide_no").cast("string"), F.lit(" 页 > "), first).alias("section_path"), F.col("slide_no").alias("page_no"))


def char_offsets(blocks: DataFrame) -> DataFrame:
    """Blocks with char_start and char_end in the text joined by blank lines."""
    rows = blocks.withColumn("text", F.trim("text"))
    before = W.partitionBy("doc_id").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("char_start", F.coalesce(F.sum(F.length("text") + 2).over(before), F.lit(0)))
    return rows.withColumn("char_end", F.col("char_start") + F.length("text"))


def split_units(blocks: DataFrame, target: int = TARGET) -> DataFrame:
    """Blocks up to 1.6 times the target stay; longer ones are cut at sentence ends, long sentences by length."""
    size = max(80, target)
    pieces = F.filter(F.split("text", SENTENCE_END), lambda x: F.trim(x) != "")

    def hard(x: Column) -> Column:
        cuts = F.transform(F.sequence(F.lit(0), F.ceil(F.length(x) / size).cast("int") - 1), lambda i: F.substring(x, i * size + 1, F.lit(size)))
        return F.when(X.estimate_tokens(x) > LONG * target, cuts).otherwise(F.array(x))

    units = F.when(X.estimate_tokens(F.col("text")) <= LONG * target, F.array("text")).otherwise(F.flatten(F.transform(pieces, hard)))
    rows = blocks.select("doc_id", "pos", "section_path", F.posexplode(units).alias("i", "text"))
    return rows.select("doc_id", F.row_number().over(W.partitionBy("doc_id").orderBy("pos", "i")).alias("unit"), "section_path", "text", X.estimate_tokens(F.col("text")).alias("tokens"))


def pack_ranges(units: Column, target: int = TARGET, overlap: int = OVERLAP) -> Column:
    """Ranges (first, last) of the chunks of a document, as array; units: array of (total, path), where total sums the tokens up to the unit.

    A chunk is full at the target, or at half of it when the path changes; the next starts with the
    longest tail of units whose tokens fit the overlap. Positions count from 1.
    """
    target = max(120, target)
    overlap = min(max(0, overlap), target // 2)
    total = lambda i: F.when(i < 1, 0).otherwise(F.try_element_at(units, i)["total"])
    path = lambda i: F.try_element_at(units, i)["path"]
    span = lambda a, b: F.array(F.struct(a.alias("first"), b.alias("last")))

    def close(s: Column, last: Column) -> Column:
        starts = F.filter(F.sequence(s["first"], last + 1), lambda at: total(last) - total(at - 1) <= overlap)
        return F.struct(F.element_at(starts, 1).alias("first"), F.concat(s["out"], span(s["first"], last)).alias("out"))

    def step(s: Column, i: Column) -> Column:
        turns = (i > s["first"]) & (path(i) != "") & (path(i - 1) != "") & (path(i) != path(i - 1)) & (total(i - 1) - total(s["first"] - 1) >= target / 2)
        return F.when(turns, close(s, i - 1)).otherwise(s)

    start = F.struct(F.lit(1).alias("first"), F.array().cast("array<struct<first: int, last: int>>").alias("out"))
    full = lambda s, i: F.when(total(i) - total(s["first"] - 1) >= target, close(s, i)).otherwise(s)
    # Either step may close a chunk: one element for each unit and step.
    steps = F.flatten(F.transform(F.sequence(F.lit(1), F.size(units)), lambda i: F.array(i, -i)))
    n = F.size(units)

    def rest(s: Column) -> Column:
        open_ = (s["first"] <= n) & ((F.size(s["out"]) == 0) | (F.try_element_at(s["out"], F.lit(-1)) != F.struct(s["first"].alias("first"), n.alias("last"))))
        return F.when(open_, F.concat(s["out"], span(s["first"], n))).otherwise(s["out"])

    return F.aggregate(steps, start, lambda s, i: F.when(i > 0, step(s, i)).otherwise(full(s, -i)), rest)


def pack_chunks(units: DataFrame, target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of units(doc_id, unit, section_path, text, tokens): (doc_id, chunk_index, text, section_path, n_units, tokens).

    One shuffle by document; a group holds one document's units, and the fold sees their numbers only.
    """
    total = F.sum("tokens").over(W.partitionBy("doc_id").orderBy("unit"))
    rows = units.select("doc_id", "unit", "tokens", F.coalesce("section_path", F.lit("")).alias("path"), "text", total.alias("total"))
    rows = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("unit", "tokens", "total", "path", "text"))).alias("u"))
    rows = rows.withColumn("s", F.transform("u", lambda x: F.struct(x["total"].alias("total"), x["path"].alias("path"))))
    rows = rows.select("doc_id", "u", F.posexplode(pack_ranges(F.col("s"), target, overlap)).alias("chunk_index", "r"))
    rows = rows.select("doc_id", "chunk_index", F.slice("u", F.col("r.first"), F.col("r.last") - F.col("r.first") + 1).alias("u"))
    path = F.coalesce(F.nullif(F.element_at("u", 1)["path"], F.lit("")), F.element_at("u", -1)["path"])
    tokens = F.aggregate("u", F.lit(0).cast("long"), lambda t, x: t + x["tokens"])
    return rows.select("doc_id", "chunk_index", F.array_join(F.transform("u", lambda x: x["text"]), "\n").alias("text"), path.alias("section_path"), F.size("u").alias("n_units"), tokens.alias("tokens"))


def document_stats(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks and characters per document; under ten characters a document counts as failed."""
    rows = documents.select("doc_id").join(chunks.groupBy("doc_id").agg(F.count("*").alias("chunk_count"), F.sum(F.length("text")).alias("char_count")), "doc_id", "left").na.fill(0, ["chunk_count", "char_count"])
    return rows.withColumn("status", F.when(F.col("char_count") < 10, "failed").otherwise("ready"))


def outline_sample(blocks: DataFrame, least: int = 800, most: int = 6000) -> DataFrame:
    """Per document its section paths in order, filled up with body text to ``most`` characters if they are short."""
    rows = blocks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "section_path", "text"))).alias("b"))
    paths = F.array_join(F.array_distinct(F.filter(F.transform("b", lambda x: x["section_path"]), lambda x: x != "")), "\n")
    body = F.array_join(F.transform("b", lambda x: x["text"]), "\n")
    return rows.select("doc_id", F.substring(F.when(F.length(paths) >= least, paths).otherwise(F.concat_ws("\n", paths, body)), 1, most).alias("outline"))


def replace_chunks(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Chunks after re-indexing: those of the new rows' documents are replaced as a whole."""
    return existing.join(new.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(new)


def stored_replacement(rows: DataFrame, new: DataFrame, folder: str) -> DataFrame:
    """B12 on a stored table: rows are written in buckets by document, then only the buckets of the new rows' documents anew."""
    store = BucketStore(rows.sparkSession, folder)
    store.overwrite(rows)
    store.replace(new)
    return store.read()


def list_chunks(chunks: DataFrame, links: DataFrame, tags: DataFrame, doc_id: int, page: int = 1, size: int = 20) -> DataFrame:
    """A page of a document's chunks in order with their tags [{id, name, level}], null without any."""
    rows = chunks.filter(F.col("doc_id") == doc_id).orderBy("chunk_index").offset((page - 1) * size).limit(size)
    return rows.join(tag_briefs(links.join(rows.select("chunk_id"), "chunk_id", "left_semi"), tags, "chunk_id"), "chunk_id", "left")


def _blocks(s) -> DataFrame:
    return section_path(split_paragraphs(s["v_book"]))


def _chunks(s) -> DataFrame:
    return pack_chunks(split_units(_blocks(s)))


PARAGRAPHS = r"""p AS (SELECT doc_id, i - 1 AS pos, trim(regexp_replace(array_to_string(list_filter(list_transform(string_split(ps[i], chr(10)), lambda x: trim(x)), lambda x: x <> ''), ' '), '\s+', ' ', 'g')) AS text
    FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT doc_id, regexp_split_to_array(text, '\n\s*\n') AS ps FROM {v_doc}) a) b)"""
LEVELS = f"""l AS (SELECT *, CASE WHEN m > 0 THEN m WHEN numbered AND regexp_matches(text, '^\\d') THEN least(6, length(text) - length(replace(text, '.', '')) + 1) WHEN numbered THEN 1 END AS level, CASE WHEN m > 0 THEN trim(regexp_extract(text, '{HEADING}', 2)) ELSE text END AS title
    FROM (SELECT *, length(regexp_extract(text, '{HEADING}', 1)) AS m, length(text) <= 60 AND regexp_matches(text, '^(第[一二三四五六七八九十百零\\d]+[章节部分]|[一二三四五六七八九十]+、|\\d+\\.\\d+\\s+\\S|\\d+\\.\\d+\\.\\d+\\s+\\S)') AS numbered FROM p WHERE text <> '') x),
    h AS (SELECT doc_id, pos, text, level, {", ".join(f"coalesce(max(CASE WHEN level = {n} THEN pos END) OVER w, -1) AS p{n}, last_value(CASE WHEN level = {n} THEN title END IGNORE NULLS) OVER w AS t{n}" for n in range(1, 7))} FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    b AS (SELECT doc_id, pos, text, concat_ws(' > ', {", ".join(f"CASE WHEN p{n} > greatest(-1{''.join(f', p{k}' for k in range(1, n))}) THEN t{n} END" for n in range(1, 7))}) AS section_path FROM h WHERE level IS NULL)"""
BLOCKS = PARAGRAPHS.replace("{v_doc}", "{v_book}") + ", " + LEVELS


def tokens_sql(c: str) -> str:
    wide = f"(length({c}) - length(regexp_replace({c}, '[\\x{{4e00}}-\\x{{9fff}}\\x{{3000}}-\\x{{303f}}\\x{{ff00}}-\\x{{ffef}}]', '', 'g')))"
    return f"CASE WHEN {c} = '' THEN 0 ELSE CAST({wide} + greatest(1, floor((length({c}) - {wide}) / 4)) AS INT) END"


def units_sql(target: int) -> str:
    long, size = LONG * target, max(80, target)
    cuts = f"CASE WHEN {tokens_sql('y')} > {long} THEN list_transform(range(0, CAST(ceil(length(y) / {size}) AS BIGINT)), lambda i: substring(y, i * {size} + 1, {size})) ELSE [y] END"
    ends = "list_filter(string_split(regexp_replace(text, '([。！？；!?;])', concat('\\1', chr(1)), 'g'), chr(1)), lambda z: trim(z) <> '')"
    lists = f"SELECT doc_id, pos, section_path, CASE WHEN {tokens_sql('text')} <= {long} THEN [text] ELSE flatten(list_transform({ends}, lambda y: {cuts})) END AS us FROM b"
    return f"""us AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos, i) AS INT) AS unit, section_path, us[i] AS text FROM (SELECT *, unnest(range(1, len(us) + 1)) AS i FROM ({lists}) x) y),
    unit AS (SELECT *, {tokens_sql('text')} AS tokens FROM us)"""


#: The fold as a recursion: at unit i, a chunk may end before it (a) and with it (b).
PACKED = f"""WITH RECURSIVE {BLOCKS}, {units_sql(TARGET)}, t AS (SELECT doc_id, list_prepend(0, list(total ORDER BY unit)) AS c, list(section_path ORDER BY unit) AS ps, count(*) AS n FROM (SELECT *, CAST(sum(tokens) OVER (PARTITION BY doc_id ORDER BY unit) AS BIGINT) AS total FROM unit) x GROUP BY doc_id),
    f AS (SELECT doc_id, c, ps, n, CAST(0 AS BIGINT) AS i, CAST(1 AS BIGINT) AS f0, CAST(NULL AS BIGINT) AS fa, CAST(1 AS BIGINT) AS f1, CAST(NULL AS BIGINT) AS fb, CAST(1 AS BIGINT) AS f2 FROM t
    UNION ALL SELECT doc_id, c, ps, n, i, f0, fa, f1, CASE WHEN c[i + 1] - c[f1] >= {TARGET} THEN f1 END AS fb, CASE WHEN c[i + 1] - c[f1] >= {TARGET} THEN list_filter(range(f1, i + 2), lambda s: c[i + 1] - c[s] <= {OVERLAP})[1] ELSE f1 END AS f2
    FROM (SELECT *, CASE WHEN turns THEN f0 END AS fa, CASE WHEN turns THEN list_filter(range(f0, i + 1), lambda s: c[i] - c[s] <= {OVERLAP})[1] ELSE f0 END AS f1
    FROM (SELECT doc_id, c, ps, n, i + 1 AS i, f2 AS f0, i + 1 > f2 AND ps[i + 1] <> '' AND ps[i] <> '' AND ps[i + 1] <> ps[i] AND c[i + 1] - c[f2] >= {TARGET / 2} AS turns FROM f WHERE i < n) y) z),
    r AS (SELECT doc_id, fa AS first, i - 1 AS last FROM f WHERE fa IS NOT NULL UNION ALL SELECT doc_id, fb, i FROM f WHERE fb IS NOT NULL),
    e AS (SELECT doc_id, first, last FROM r UNION SELECT doc_id, f2, n FROM f WHERE i = n AND f2 <= n),
    k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY first, last) - 1 AS chunk_index FROM e)
    SELECT k.doc_id, k.chunk_index, string_agg(u.text, chr(10) ORDER BY u.unit) AS text, coalesce(nullif(min_by(u.section_path, u.unit), ''), max_by(u.section_path, u.unit)) AS section_path, count(*) AS n_units, CAST(sum(u.tokens) AS BIGINT) AS tokens FROM k JOIN unit u ON u.doc_id = k.doc_id AND u.unit BETWEEN k.first AND k.last GROUP BY k.doc_id, k.chunk_index"""
CELLS = "SELECT CAST(l_orderkey AS BIGINT) AS doc_id, CAST(l_suppkey % 3 AS INT) AS table_no, CAST(l_linenumber AS INT) AS row_no, k.i AS col_no, CASE k.i WHEN 0 THEN l_returnflag WHEN 1 THEN l_linestatus ELSE CAST(l_partkey AS STRING) END AS text FROM {lineitem} CROSS JOIN (SELECT 0 AS i UNION ALL SELECT 1 UNION ALL SELECT 2) k WHERE l_partkey >= 0"
MARKS = "SELECT tag_id AS seq, kb_id AS doc_id, level, name AS title, CAST(tag_id % 40 + 1 AS INT) AS page FROM {v_tag}"
R.add("split_paragraphs", lambda s: split_paragraphs(s["v_doc"]), f"WITH {PARAGRAPHS} SELECT doc_id, pos, text FROM p WHERE text <> ''")
R.add("section_path", _blocks, f"WITH {BLOCKS} SELECT doc_id, pos, text, section_path FROM b")
R.add("toc_forward_fill", lambda s: toc_forward_fill(s.sql(MARKS)),
      f"""WITH m AS ({MARKS}), h AS (SELECT *, max(CASE WHEN level = 1 THEN seq END) OVER w AS a, max(CASE WHEN level = 2 THEN seq END) OVER w AS b, max(CASE WHEN level = 3 THEN seq END) OVER w AS c FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY seq)),
      t AS (SELECT h.doc_id, h.seq, h.page, concat_ws(' > ', m1.title, CASE WHEN h.b > coalesce(h.a, -1) THEN m2.title END, CASE WHEN h.c > greatest(coalesce(h.a, -1), coalesce(h.b, -1)) THEN m3.title END) AS path FROM h LEFT JOIN m m1 ON m1.seq = h.a LEFT JOIN m m2 ON m2.seq = h.b LEFT JOIN m m3 ON m3.seq = h.c),
      p AS (SELECT doc_id, page, max_by(path, seq) AS path FROM t GROUP BY doc_id, page), every AS (SELECT doc_id, unnest(range(1, n + 1)) AS page FROM (SELECT doc_id, max(page) AS n FROM p GROUP BY doc_id) x)
      SELECT e.doc_id, e.page, last_value(p.path IGNORE NULLS) OVER (PARTITION BY e.doc_id ORDER BY e.page) AS path FROM every e LEFT JOIN p ON p.doc_id = e.doc_id AND p.page = e.page""")  # fmt: skip
R.add("rows_to_text_blocks", lambda s: table_blocks(s.sql(CELLS).groupBy("doc_id", "table_no", "row_no", "col_no").agg(F.min("text").alias("text"))),
      f"""WITH c AS (SELECT doc_id, table_no, row_no, col_no, min(text) AS text FROM ({CELLS}) x GROUP BY ALL), r AS (SELECT doc_id, table_no, row_no, string_agg(trim(text), ' | ' ORDER BY col_no) AS line FROM c GROUP BY ALL)
      SELECT doc_id, table_no, concat('[表格 ', table_no, ']', chr(10), string_agg(line, chr(10) ORDER BY row_no)) AS text FROM r GROUP BY doc_id, table_no""")  # fmt: skip
R.add("slides_to_blocks", lambda s: slide_blocks(s["v_turn"].selectExpr("interview_id as doc_id", "cast(seq / 2 as int) as slide_no", "seq as shape_no", "content as text")),
      """WITH f AS (SELECT interview_id AS doc_id, CAST(floor(seq / 2) AS INT) AS slide_no, string_agg(trim(content), chr(10) ORDER BY seq) AS text FROM {v_turn} WHERE trim(content) <> '' GROUP BY 1, 2)
      SELECT doc_id, slide_no, text, concat('第 ', slide_no, ' 页 > ', substring(string_split(text, chr(10))[1], 1, 60)) AS section_path, slide_no AS page_no FROM f""")  # fmt: skip
R.add("char_offsets", lambda s: char_offsets(split_paragraphs(s["v_doc"])).select("doc_id", "pos", "char_start", "char_end"),
      f"WITH {PARAGRAPHS} SELECT doc_id, pos, CAST(coalesce(sum(length(text) + 2) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_start, CAST(coalesce(sum(length(text) + 2) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(text) AS BIGINT) AS char_end FROM p WHERE text <> ''")
R.add("estimate_tokens", lambda s: s["v_doc"].select("doc_id", X.estimate_tokens(F.col("text")).alias("tokens")),
      r"SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE CAST(w + greatest(1, floor((length(text) - w) / 4)) AS INT) END AS tokens FROM (SELECT doc_id, text, length(text) - length(regexp_replace(text, '[\x{4e00}-\x{9fff}\x{3000}-\x{303f}\x{ff00}-\x{ffef}]', '', 'g')) AS w FROM {v_doc}) x")
R.add("split_units", lambda s: split_units(_blocks(s), 120), f"WITH {BLOCKS}, {units_sql(120)} SELECT doc_id, unit, section_path, text, tokens FROM unit")
R.add("pack_chunks", _chunks, PACKED)
R.add("document_stats", lambda s: document_stats(split_paragraphs(s["v_doc"]), s["v_doc"]),
      f"WITH {PARAGRAPHS} SELECT d.doc_id, coalesce(n, 0) AS chunk_count, coalesce(c, 0) AS char_count, CASE WHEN coalesce(c, 0) < 10 THEN 'failed' ELSE 'ready' END AS status FROM {{v_doc}} d LEFT JOIN (SELECT doc_id, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS c FROM p WHERE text <> '' GROUP BY doc_id) x ON x.doc_id = d.doc_id")
R.add("outline_sample", lambda s: outline_sample(_blocks(s), 60, 3000),
      f"""WITH {BLOCKS}, first AS (SELECT doc_id, section_path, min(pos) AS pos FROM b WHERE section_path <> '' GROUP BY ALL), paths AS (SELECT doc_id, string_agg(section_path, chr(10) ORDER BY pos) AS p FROM first GROUP BY doc_id), body AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY pos) AS t FROM b GROUP BY doc_id)
      SELECT doc_id, substring(CASE WHEN length(coalesce(p, '')) >= 60 THEN p ELSE concat(coalesce(p, ''), chr(10), t) END, 1, 3000) AS outline FROM body LEFT JOIN paths USING (doc_id)""")  # fmt: skip
R.add("replace_document_chunks", lambda s: replace_chunks(s["v_chunk"].select("doc_id", "chunk_index", "content"), s["v_chunk"].filter("doc_id % 3 = 0 and chunk_index < 2").selectExpr("doc_id", "chunk_index", "concat(content, '!') as content")).select("doc_id", "chunk_index", F.length("content").alias("n")),
      "SELECT doc_id, chunk_index, length(CASE WHEN doc_id % 3 = 0 THEN concat(content, '!') ELSE content END) AS n FROM {v_chunk} WHERE doc_id % 3 <> 0 OR chunk_index < 2")
R.add("replace_stored_chunks", lambda s: stored_replacement(s["v_chunk"].select("doc_id", "chunk_index", "content"), s["v_chunk"].filter("doc_id % 3 = 0 and chunk_index < 2").selectExpr("doc_id", "chunk_index", "concat(content, '!') as content"), new_path(s.spark, "chunks")).select("doc_id", "chunk_index", F.length("content").alias("n")),
      "SELECT doc_id, chunk_index, length(CASE WHEN doc_id % 3 = 0 THEN concat(content, '!') ELSE content END) AS n FROM {v_chunk} WHERE doc_id % 3 <> 0 OR chunk_index < 2")
R.add("list_chunks", lambda s: list_chunks(s["v_chunk"], s["v_chunk_tag"], s["v_tag"], 7, 1, 15).select("doc_id", "chunk_index", "chunk_id", F.array_join(F.transform("tags", lambda t: F.concat_ws(":", t["id"].cast("string"), t["name"], t["level"].cast("string"))), ",").alias("tags")),
      """WITH c AS (SELECT doc_id, chunk_index, chunk_id FROM {v_chunk} WHERE doc_id = 7 ORDER BY chunk_index LIMIT 15) SELECT c.*, g.tags FROM c LEFT JOIN (SELECT chunk_id, string_agg(concat_ws(':', x.tag_id, name, level), ',' ORDER BY x.tag_id) AS tags FROM {v_chunk_tag} x JOIN {v_tag} t ON t.tag_id = x.tag_id GROUP BY 1) g ON g.chunk_id = c.chunk_id""")  # fmt: skip
