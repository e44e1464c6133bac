"""Knowledge-point hierarchy (D)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import materialise
from ..sources.views import Registry
from .retrieval import unit_vector

R = Registry()
LEVELS, CHILDREN, NAME, PART = 3, 12, 30, 40
BEST, LEAST, LOW, SECOND = 3, 0.30, 0.45, 40
#: Tags of one knowledge base that are sent to the tasks at once.
TAG_BLOCK = 4_096


def build_tag_tree(paths: DataFrame) -> DataFrame:
    """Tags from section paths (kb_id, pos, path 'A > B > C'), at most 3 levels of 12 children in first-seen order."""
    parts = F.transform(F.split("path", " > "), lambda x: F.trim(x))
    rows = paths.select("kb_id", "pos", parts.alias("p")).filter(~F.exists("p", lambda x: (x == "") | (F.length(x) > PART)))
    lead = F.element_at("p", 1)
    rows = rows.withColumn("p", F.when((F.size("p") >= 3) & (lead.contains("讲义") | lead.contains("教材") | (F.length(lead) > 20)), F.slice("p", 2, 9)).otherwise(F.col("p")))
    rows = rows.withColumn("p", F.transform(F.slice("p", 1, LEVELS), lambda x: F.substring(x, 1, NAME)))
    found = None
    for level in range(1, LEVELS + 1):
        here = rows.filter(F.size("p") >= level).groupBy("kb_id", F.slice("p", 1, level).alias("path")).agg(F.min("pos").alias("pos"))
        here = here.withColumn("parent", F.slice("path", 1, level - 1))
        here = here.withColumn("sort_order", F.row_number().over(W.partitionBy("kb_id", "parent").orderBy("pos", "path"))).filter(F.col("sort_order") <= CHILDREN)
        if found is not None:  # children of a dropped tag go with it
            here = here.join(above.select("kb_id", F.col("path").alias("parent")), ["kb_id", "parent"], "left_semi")  # noqa: F821
        above = here  # noqa: F841
        here = here.select("kb_id", F.lit(level).alias("level"), "path", "parent", F.element_at("path", -1).alias("name"), "sort_order")
        found = here if found is None else found.unionByName(here)
    return found


def tag_closure(tags: DataFrame) -> DataFrame:
    """(tag_id, ancestor_id, distance) up to the root (D3); levels are at most three."""
    up = tags.select("tag_id", "parent_id")
    one = up.filter("parent_id <> 0").select("tag_id", F.col("parent_id").alias("ancestor_id"), F.lit(1).alias("distance"))
    two = one.join(up.withColumnRenamed("tag_id", "ancestor_id"), "ancestor_id").filter("parent_id <> 0").select("tag_id", F.col("parent_id").alias("ancestor_id"), F.lit(2).alias("distance"))
    return one.unionByName(two)


def tag_descendants(seeds: DataFrame, tags: DataFrame) -> DataFrame:
    """(seed_id, tag_id): each seed and everything below it, once."""
    below = seeds.join(tag_closure(tags).select(F.col("ancestor_id").alias("seed_id"), "tag_id"), "seed_id")
    return seeds.select("seed_id", F.col("seed_id").alias("tag_id")).unionByName(below.select("seed_id", "tag_id")).distinct()


def tag_forest(tags: DataFrame) -> DataFrame:
    """Nested tree of every knowledge base, children in order."""
    key = lambda c: F.struct("sort_order", "tag_id", "name", *c)
    level = tags.filter("level = 3").groupBy("parent_id").agg(F.array_sort(F.collect_list(key([]))).alias("children"))
    for n in (2, 1):
        here = tags.filter(F.col("level") == n).join(level.withColumnRenamed("parent_id", "_p"), F.col("tag_id") == F.col("_p"), "left")
        by = "kb_id" if n == 1 else "parent_id"
        level = here.groupBy(by).agg(F.array_sort(F.collect_list(key(["children"]))).alias("children"))
    return level.withColumnRenamed("children", "tree")


def flat_forest(tags: DataFrame) -> DataFrame:
    """Depth-first list for pickers (D4): (kb_id, position, tag_id, level)."""
    up = tags.select(F.col("tag_id").alias("parent_id"), F.array("sort_order", "tag_id").alias("p1"), F.col("parent_id").alias("g"))
    higher = up.select(F.col("parent_id").alias("g"), F.col("p1").alias("p2"))
    rows = tags.join(up, "parent_id", "left").join(higher, "g", "left")
    empty = F.array().cast("array<bigint>")
    rows = rows.withColumn("_path", F.concat(F.coalesce("p2", empty), F.coalesce("p1", empty), F.array("sort_order", "tag_id")))
    return rows.select("kb_id", F.row_number().over(W.partitionBy("kb_id").orderBy("_path")).alias("position"), "tag_id", "level")


def tag_by_vector(chunks: DataFrame, tags: DataFrame, best: int = BEST, least: float = LEAST) -> DataFrame:
    """Per chunk the best tags of its knowledge base by cosine, at least ``least``; ties to the higher tag id.

    chunks(pk, kb_id, vector), tags(tag_id, kb_id, vector). Tags go to the tasks in blocks of bounded
    size; each block leaves at most ``best`` rows per chunk before they are ranked.
    """
    out = None
    for block in blocks(tags.select("tag_id", "kb_id", "vector"), TAG_BLOCK):
        sent = chunks.sparkSession.sparkContext.broadcast({kb: (np.array([r["tag_id"] for r in rows]), np.array([unit_vector(r["vector"]) for r in rows])) for kb, rows in _by_kb(block).items()})

        def score(batches: Iterator[pd.DataFrame], known=sent) -> Iterator[pd.DataFrame]:
            for rows in batches:
                for kb, part in rows.groupby("kb_id"):
                    ids, matrix = known.value.get(kb, (None, None))
                    if ids is None:
                        continue
                    cos = np.stack([unit_vector(v) for v in part["vector"]]) @ matrix.T
                    order = np.lexsort((np.broadcast_to(-ids, cos.shape), -cos))[:, :best]
                    yield pd.DataFrame({"pk": np.repeat(part["pk"].to_numpy(), order.shape[1]), "tag_id": ids[order].ravel(), "score": np.take_along_axis(cos, order, 1).ravel()})

        part = chunks.select("pk", "kb_id", "vector").mapInPandas(score, "pk long, tag_id long, score double")
        out = part if out is None else out.unionByName(part)
    rank = F.row_number().over(W.partitionBy("pk").orderBy(F.desc("score"), F.desc("tag_id")))
    return out.withColumn("rank", rank).filter((F.col("rank") <= best) & (F.col("score") >= least))


def blocks(rows: DataFrame, size: int) -> Iterator[list]:
    """Rows by blocks; the driver holds one block at a time."""
    block: list = []
    for row in rows.toLocalIterator():
        block.append(row)
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def _by_kb(rows: list) -> dict[int, list]:
    out: dict[int, list] = {}
    for r in rows:
        out.setdefault(r["kb_id"], []).append(r)
    return out


def low_confidence(scored: DataFrame, chunks: DataFrame, low: float = LOW, limit: int = SECOND) -> DataFrame:
    """Chunks whose best score is under ``low``, the first ``limit`` of each document, for a second look."""
    best = scored.groupBy("pk").agg(F.max("score").alias("best"))
    rows = chunks.join(best, "pk", "left").filter(F.coalesce("best", F.lit(0.0)) < low)
    return rows.withColumn("n", F.row_number().over(W.partitionBy("doc_id").orderBy("chunk_index", "pk"))).filter(F.col("n") <= limit)


def letters_of(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))


def letters_held(chunks: DataFrame, letters: DataFrame) -> DataFrame:
    """(kb_id, chunk_id, letter): of letters(kb_id, letter) those that stand in each chunk of the base."""
    wanted = letters.groupBy("kb_id").agg(F.collect_set("letter").alias("letters"))  # one alphabet
    return chunks.join(wanted, "kb_id").select("kb_id", "chunk_id", F.explode(F.filter("letters", lambda c: F.col("content").contains(c))).alias("letter"))


def candidates(chunks: DataFrame, names: DataFrame) -> DataFrame:
    """(chunk_id, kb_id, name): pairs of chunks(chunk_id, kb_id, content) and names(kb_id, name) that can match.

    Whatever matches holds all letters of the name, so its rarest one too: each name is listed under
    the letter that the fewest chunks of its base hold, and only chunks with that letter meet it.
    """
    each = names.select("kb_id", "name", F.explode(letters_of(F.col("name"))).alias("letter"))
    df = letters_held(chunks, each.select("kb_id", "letter").distinct()).groupBy("kb_id", "letter").agg(F.count("*").alias("df"))
    rarest = each.join(df, ["kb_id", "letter"], "left").groupBy("kb_id", "name").agg(F.min_by("letter", F.struct(F.coalesce("df", F.lit(0)), "letter")).alias("letter"))
    rarest = materialise(rarest, "letters")
    held = letters_held(chunks, rarest.select("kb_id", "letter").distinct())
    return held.join(rarest, ["kb_id", "letter"]).select("chunk_id", "kb_id", "name")


def tag_lexical(chunks: DataFrame, tags: DataFrame, best: int = BEST) -> DataFrame:
    """Per chunk(chunk_id, kb_id, content) the best tags by occurrences of the name.

    A name that doesn't occur scores 1 if it has two characters or more and all of them do. Ties to
    the higher id; of equal names only the ``best`` highest ids can be among the best.
    """
    nth = F.row_number().over(W.partitionBy("kb_id", "name").orderBy(F.desc("tag_id")))
    ids = tags.filter("name <> ''").select("kb_id", "name", "tag_id").withColumn("n", nth).filter(F.col("n") <= best)
    names = materialise(ids.groupBy("kb_id", "name").agg(F.collect_list("tag_id").alias("ids")), "names")  # ``best`` ids at most
    rows = chunks.select("chunk_id", "kb_id", "content")
    pairs = candidates(rows, names).join(rows.drop("kb_id"), "chunk_id")
    times = ((F.length("content") - F.length(F.replace("content", F.col("name"), F.lit("")))) / F.length("name")).cast("int")
    all_in = (F.length("name") >= 2) & F.forall(F.split("name", ""), lambda c: F.col("content").contains(c))
    scored = pairs.select("chunk_id", "kb_id", "name", F.when(times > 0, times).when(all_in, 1).otherwise(0).alias("score")).filter("score > 0")
    found = scored.join(names, ["kb_id", "name"]).select("chunk_id", F.explode("ids").alias("tag_id"), "score")
    rank = F.row_number().over(W.partitionBy("chunk_id").orderBy(F.desc("score"), F.desc("tag_id")))
    return found.withColumn("rank", rank).filter(F.col("rank") <= best).select("chunk_id", "rank", "tag_id", "score")


def refine_tags(first: DataFrame, second: DataFrame) -> DataFrame:
    """(pk, tag_id): tags of a first look, replaced by those of a second one for every chunk that it answered.

    first(pk, tag_id), second(pk, tag_ids); an empty answer takes a chunk's tags away, a missing one leaves them.
    """
    answered = second.filter("tag_ids is not null").select("pk")
    kept = first.select("pk", "tag_id").join(answered, "pk", "left_anti")
    return kept.unionByName(second.select("pk", F.explode("tag_ids").alias("tag_id"))).distinct()


def tag_briefs(links: DataFrame, tags: DataFrame, key: str) -> DataFrame:
    """Tags [{id, name, level}] of every chunk or question, by tag id; unknown tags are dropped."""
    rows = links.select(key, "tag_id").join(tags.select("tag_id", "name", "level"), "tag_id")
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("tag_id").alias("id"), "name", "level"))).alias("tags"))


def validate_parents(tags: DataFrame) -> DataFrame:
    """Tags whose parent is missing, in another base, or not one level above."""
    parent = tags.select(F.col("tag_id").alias("_id"), F.col("kb_id").alias("_kb"), F.col("level").alias("_level"))
    rows = tags.join(parent, F.col("parent_id") == F.col("_id"), "left")
    reason = (
        F.when((F.col("parent_id") == 0) & (F.col("level") != 1), "root must have level 1").when(F.col("parent_id") == 0, None).when(F.col("_id").isNull(), "no parent")
        .when(F.col("_kb") != F.col("kb_id"), "parent in another base").when(F.col("level") > LEVELS, "too deep").when(F.col("level") != F.col("_level") + 1, "wrong level")
    )
    return rows.withColumn("reason", reason).filter("reason is not null").select("tag_id", "reason")


CLOSURE = "SELECT tag_id, parent_id AS ancestor_id, 1 AS distance FROM {v_tag} WHERE parent_id <> 0 UNION ALL SELECT t.tag_id, p.parent_id, 2 FROM {v_tag} t JOIN {v_tag} p ON p.tag_id = t.parent_id WHERE p.parent_id <> 0"
PATHS = "SELECT kb_id, min(tag_id) AS pos, path FROM (SELECT a.kb_id, c.tag_id, concat(a.name, ' > ', b.name, ' > ', c.name) AS path FROM {v_tag} a JOIN {v_tag} b ON b.parent_id = a.tag_id JOIN {v_tag} c ON c.parent_id = b.tag_id WHERE a.level = 1) x GROUP BY kb_id, path"
BAD = "SELECT tag_id, CASE WHEN tag_id % 13 = 0 THEN kb_id + 1 ELSE kb_id END AS kb_id, CASE WHEN tag_id % 17 = 0 THEN 99 ELSE parent_id END AS parent_id, CASE WHEN tag_id % 19 = 0 THEN 3 ELSE level END AS level FROM {v_tag}"
R.add("build_tag_tree", lambda s: build_tag_tree(s.sql(PATHS)).select("kb_id", "level", F.array_join("path", " > ").alias("path"), "sort_order"),
      f"""WITH p AS ({PATHS}), parts AS (SELECT kb_id, pos, string_split(path, ' > ') AS p FROM p), l1 AS (SELECT kb_id, p[1] AS a, row_number() OVER (PARTITION BY kb_id ORDER BY min(pos), p[1]) AS n FROM parts GROUP BY kb_id, p[1]),
      l2 AS (SELECT kb_id, p[1] AS a, p[2] AS b, row_number() OVER (PARTITION BY kb_id, p[1] ORDER BY min(pos), p[2]) AS n FROM parts GROUP BY kb_id, p[1], p[2]), l3 AS (SELECT kb_id, p[1] AS a, p[2] AS b, p[3] AS c, row_number() OVER (PARTITION BY kb_id, p[1], p[2] ORDER BY min(pos), p[3]) AS n FROM parts GROUP BY kb_id, p[1], p[2], p[3])
      SELECT kb_id, 1 AS level, a AS path, n AS sort_order FROM l1 WHERE n <= 12 UNION ALL SELECT l2.kb_id, 2, concat(l2.a, ' > ', l2.b), l2.n FROM l2 JOIN l1 ON l1.kb_id = l2.kb_id AND l1.a = l2.a AND l1.n <= 12 WHERE l2.n <= 12
      UNION ALL SELECT l3.kb_id, 3, concat(l3.a, ' > ', l3.b, ' > ', l3.c), l3.n FROM l3 JOIN l2 ON l2.kb_id = l3.kb_id AND l2.a = l3.a AND l2.b = l3.b AND l2.n <= 12 JOIN l1 ON l1.kb_id = l3.kb_id AND l1.a = l3.a AND l1.n <= 12 WHERE l3.n <= 12""")  # fmt: skip
R.add("tag_ancestors", lambda s: tag_closure(s["v_tag"]), CLOSURE)
R.add("tag_descendants", lambda s: tag_descendants(s["v_tag"].filter("level < 3").select(F.col("tag_id").alias("seed_id")), s["v_tag"]),
      f"SELECT tag_id AS seed_id, tag_id FROM {{v_tag}} WHERE level < 3 UNION SELECT ancestor_id, tag_id FROM ({CLOSURE}) c")
R.add("tag_forest", lambda s: flat_forest(s["v_tag"]),
      """WITH p AS (SELECT t.kb_id, t.tag_id, t.level, coalesce(g.sort_order, p.sort_order, t.sort_order) AS a, coalesce(g.tag_id, p.tag_id, t.tag_id) AS b, CASE t.level WHEN 3 THEN p.sort_order WHEN 2 THEN t.sort_order ELSE -1 END AS c, CASE t.level WHEN 3 THEN p.tag_id WHEN 2 THEN t.tag_id ELSE -1 END AS d,
      CASE t.level WHEN 3 THEN t.sort_order ELSE -1 END AS e FROM {v_tag} t LEFT JOIN {v_tag} p ON p.tag_id = t.parent_id LEFT JOIN {v_tag} g ON g.tag_id = p.parent_id) SELECT kb_id, row_number() OVER (PARTITION BY kb_id ORDER BY a, b, c, d, e) AS position, tag_id, level FROM p""")  # fmt: skip
NODE = "concat('[', {0}.sort_order, ',', {0}.tag_id, ',', {0}.name, ',(', coalesce({1}, ''), ')]')"


def _tree_text(tree: Column) -> Column:
    """A nested tree as text: [order,id,name,(children)]."""
    node = lambda t, inner: F.concat(F.lit("["), t["sort_order"].cast("string"), F.lit(","), t["tag_id"].cast("string"), F.lit(","), t["name"], F.lit(",("), inner, F.lit(")]"))
    each = lambda c, f: F.coalesce(F.array_join(F.transform(c, f), ""), F.lit(""))
    return each(tree, lambda a: node(a, each(a["children"], lambda b: node(b, each(b["children"], lambda c: node(c, F.lit("")))))))


R.add("tag_tree", lambda s: tag_forest(s["v_tag"]).select("kb_id", F.size("tree").alias("roots"), _tree_text(F.col("tree")).alias("tree")),
      f"""WITH l3 AS (SELECT parent_id, string_agg({NODE.format("t", "''")}, '' ORDER BY t.sort_order, t.tag_id) AS c FROM {{v_tag}} t WHERE level = 3 GROUP BY parent_id), l2 AS (SELECT t.parent_id, string_agg({NODE.format("t", "l3.c")}, '' ORDER BY t.sort_order, t.tag_id) AS c FROM {{v_tag}} t LEFT JOIN l3 ON l3.parent_id = t.tag_id WHERE t.level = 2 GROUP BY t.parent_id)
      SELECT t.kb_id, count(*) AS roots, string_agg({NODE.format("t", "l2.c")}, '' ORDER BY t.sort_order, t.tag_id) AS tree FROM {{v_tag}} t LEFT JOIN l2 ON l2.parent_id = t.tag_id WHERE t.level = 1 GROUP BY t.kb_id""")  # fmt: skip
TAG_VECTORS = "SELECT pk AS tag_id, kb_id, vector FROM {v_chunk_vector} WHERE pk % 10 = 0"
R.add("tag_chunks_by_vector", lambda s: tag_by_vector(s["v_chunk_vector"], s.sql(TAG_VECTORS), least=0.1).select("pk", "rank", "tag_id", F.round("score", 5).alias("score")),
      f"""SELECT * FROM (SELECT pk, row_number() OVER (PARTITION BY pk ORDER BY s DESC, tag_id DESC) AS rank, tag_id, round(s, 5) AS score FROM (SELECT c.pk, t.tag_id, list_cosine_similarity(CAST(c.vector AS DOUBLE[]), CAST(t.vector AS DOUBLE[])) AS s FROM {{v_chunk_vector}} c JOIN ({TAG_VECTORS}) t ON t.kb_id = c.kb_id) x) y WHERE rank <= 3 AND score >= 0.1""")
R.add("low_confidence_chunks", lambda s: low_confidence(tag_by_vector(s["v_chunk_vector"], s.sql(TAG_VECTORS), least=-1.0), s["v_chunk_vector"].selectExpr("pk", "pk % 7 as doc_id", "pk as chunk_index"), 0.3).select("pk", "n"),
      f"""SELECT * FROM (SELECT pk, row_number() OVER (PARTITION BY pk % 7 ORDER BY pk) AS n FROM (SELECT c.pk, max(list_cosine_similarity(CAST(c.vector AS DOUBLE[]), CAST(t.vector AS DOUBLE[]))) AS s FROM {{v_chunk_vector}} c LEFT JOIN ({TAG_VECTORS}) t ON t.kb_id = c.kb_id GROUP BY c.pk) x WHERE coalesce(s, 0) < 0.3) y WHERE n <= 40""")
#: A second look at the chunks of low confidence: none for some, none of the tags for others, else one tag.
ANSWER = "CASE pk % 3 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE 1000 + pk % 4 END"


def _refined(s) -> DataFrame:
    scored = tag_by_vector(s["v_chunk_vector"], s.sql(TAG_VECTORS), least=-1.0)
    low = low_confidence(scored, s["v_chunk_vector"].selectExpr("pk", "pk % 7 as doc_id", "pk as chunk_index"), 0.3)
    second = low.selectExpr("pk", "case pk % 3 when 0 then null when 1 then cast(array() as array<bigint>) else array(1000 + pk % 4) end as tag_ids")
    return refine_tags(scored.filter("score >= 0.1"), second)


R.add("refine_tags", _refined,
      f"""WITH x AS (SELECT c.pk, t.tag_id, list_cosine_similarity(CAST(c.vector AS DOUBLE[]), CAST(t.vector AS DOUBLE[])) AS s FROM {{v_chunk_vector}} c JOIN ({TAG_VECTORS}) t ON t.kb_id = c.kb_id),
      a AS (SELECT pk, tag_id FROM (SELECT *, row_number() OVER (PARTITION BY pk ORDER BY s DESC, tag_id DESC) AS r FROM x) y WHERE r <= 3 AND s >= 0.1),
      low AS (SELECT pk FROM (SELECT pk, row_number() OVER (PARTITION BY pk % 7 ORDER BY pk) AS n FROM (SELECT c.pk, max(s) AS s FROM {{v_chunk_vector}} c LEFT JOIN x ON x.pk = c.pk GROUP BY c.pk) z WHERE coalesce(s, 0) < 0.3) w WHERE n <= 40),
      b AS (SELECT pk, {ANSWER} AS tag_id FROM low) SELECT pk, tag_id FROM a WHERE pk NOT IN (SELECT pk FROM b WHERE tag_id IS NOT NULL) UNION SELECT pk, tag_id FROM b WHERE tag_id > 0""")  # fmt: skip
WORDS = "SELECT tag_id, kb_id, CASE tag_id % 7 WHEN 0 THEN 'the' WHEN 1 THEN 'and' WHEN 2 THEN 'zqx' WHEN 3 THEN 'tion' WHEN 4 THEN 'e' WHEN 5 THEN 'ee' ELSE name END AS name FROM {v_tag} WHERE level < 3"
R.add("tag_chunks_lexical", lambda s: tag_lexical(s["v_chunk"], s.sql(WORDS)),
      f"""SELECT * FROM (SELECT chunk_id, row_number() OVER (PARTITION BY chunk_id ORDER BY score DESC, tag_id DESC) AS rank, tag_id, score FROM (SELECT c.chunk_id, t.tag_id, CASE WHEN contains(c.content, t.name) THEN CAST((length(c.content) - length(replace(c.content, t.name, ''))) / length(t.name) AS INT)
      WHEN len(list_filter(string_split(t.name, ''), lambda k: NOT contains(c.content, k))) = 0 THEN 1 ELSE 0 END AS score FROM {{v_chunk}} c JOIN ({WORDS}) t ON t.kb_id = c.kb_id) x WHERE score > 0) y WHERE rank <= 3""")  # fmt: skip
R.add("tag_briefs", lambda s: tag_briefs(s["v_chunk_tag"], s["v_tag"], "chunk_id").select("chunk_id", F.array_join(F.transform("tags", lambda t: F.concat_ws(":", t["id"].cast("string"), t["name"], t["level"].cast("string"))), ",").alias("tags")),
      "SELECT chunk_id, string_agg(concat_ws(':', c.tag_id, t.name, t.level), ',' ORDER BY c.tag_id) AS tags FROM {v_chunk_tag} c JOIN {v_tag} t ON t.tag_id = c.tag_id GROUP BY chunk_id")
R.add("validate_tag_parents", lambda s: validate_parents(s.sql(BAD)),
      f"""WITH b AS ({BAD}) SELECT * FROM (SELECT t.tag_id, CASE WHEN t.parent_id = 0 AND t.level <> 1 THEN 'root must have level 1' WHEN t.parent_id = 0 THEN NULL WHEN p.tag_id IS NULL THEN 'no parent' WHEN p.kb_id <> t.kb_id THEN 'parent in another base' WHEN t.level > 3 THEN 'too deep' WHEN t.level <> p.level + 1 THEN 'wrong level' END AS reason
      FROM b t LEFT JOIN b p ON p.tag_id = t.parent_id) x WHERE reason IS NOT NULL""")  # fmt: skip
