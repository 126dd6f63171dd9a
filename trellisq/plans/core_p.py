"""Queries of the general operators over the stored tables, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellisq.functions.normalize import idx_key, slug_key, tag_set
from trellisq.operators import hierarchy as H
from trellisq.operators.snapshots import snapshot_changes
from trellisq.sources.tables import table


def topic_links(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(parent, child) links of both kinds, and the topics of db as nodes."""
    edges = table(spark, sf_dir, "connections").where(slug_key(F.col("edge_type")) == "prereq").select(
        slug_key(F.col("from_slug")).alias("parent"), slug_key(F.col("to_slug")).alias("child"))
    db = table(spark, sf_dir, "db")
    prereqs = db.select(F.explode("prereqs").alias("p"), F.col("slug")).select(
        slug_key(F.col("p")).alias("parent"), slug_key(F.col("slug")).alias("child"))
    return edges.unionByName(prereqs), db.select(slug_key(F.col("slug")).alias("node"))


def labelled_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.hierarchy(*topic_links(spark, sf_dir))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled_topics(spark, sf_dir).select(
        F.col("node").alias("slug"), F.col("root").alias("root_slug"), "depth")


def p4_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.paths(labelled_topics(spark, sf_dir)).withColumnsRenamed({"node": "slug", "root": "root_slug"})


def p4_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.descendants(labelled_topics(spark, sf_dir)).select(
        F.col("node").alias("slug"), F.col("root").alias("root_slug"), "place", F.col("first").alias("first_place"),
        F.col("last").alias("last_place"))


def p4_circles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links that run in a circle, each with the smallest slug of its circle."""
    return H.circles(*topic_links(spark, sf_dir)).where("on_circle").select(
        F.col("node").alias("slug"), F.col("parent").alias("parent_slug"), "circle")


def p4_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slugs whose chain of parents runs into a circle without lying on it."""
    return H.circles(*topic_links(spark, sf_dir)).where("NOT on_circle").select(F.col("node").alias("slug"), "circle")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    snaps = table(spark, sf_dir, "problem_snapshots").withColumn("idx", idx_key(F.col("idx")))
    return snapshot_changes(
        snaps, "snapshot_id", ["contest_id", "idx"], "loaded_at",
        {"rating": F.col("rating"), "solved_count": F.col("solved_count"), "tags": tag_set(F.col("tags"))},
    )


_LINKS = """
WITH RECURSIVE links AS (
  SELECT lower(trim(from_slug)) AS parent, lower(trim(to_slug)) AS child
  FROM connections WHERE lower(trim(edge_type)) = 'prereq'
  UNION ALL
  SELECT lower(trim(p)), lower(trim(slug)) FROM (SELECT slug, unnest(prereqs) AS p FROM db)
), up AS (
  SELECT child, min(parent) AS parent FROM links WHERE parent IS NOT NULL AND child IS NOT NULL GROUP BY child
), nodes AS (
  SELECT child AS slug FROM links WHERE child IS NOT NULL
  UNION SELECT parent FROM links WHERE parent IS NOT NULL
  UNION SELECT lower(trim(slug)) FROM db WHERE slug IS NOT NULL
), walk AS (
  SELECT n.slug, n.slug AS root_slug, CAST(0 AS BIGINT) AS depth, n.slug AS path
  FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM up WHERE up.child = n.slug)
  UNION ALL
  SELECT up.child, walk.root_slug, walk.depth + 1, walk.path || ' > ' || up.child
  FROM walk JOIN up ON up.parent = walk.slug
)
"""

SQL = {
    "p4_found": _LINKS + """
SELECT slug, root_slug, depth FROM walk
UNION ALL
SELECT slug, '-', CAST(-1 AS BIGINT) FROM nodes WHERE slug NOT IN (SELECT slug FROM walk)
""",
    "p4_paths": _LINKS + """
SELECT slug, root_slug, depth, path FROM walk
UNION ALL
SELECT slug, '-', CAST(-1 AS BIGINT), NULL FROM nodes WHERE slug NOT IN (SELECT slug FROM walk)
""",
    "p4_descendants": _LINKS + """
, above AS (
  SELECT slug, slug AS anc FROM walk
  UNION ALL
  SELECT above.slug, up.parent FROM above JOIN up ON up.child = above.anc
), sizes AS (SELECT anc AS slug, count(*) AS size FROM above GROUP BY anc),
heavy AS (
  SELECT up.child, row_number() OVER (PARTITION BY up.parent ORDER BY size DESC, up.child) = 1 AS is_heavy, up.parent
  FROM up JOIN sizes ON sizes.slug = up.child
), turn AS (
  SELECT child, parent, row_number() OVER (PARTITION BY parent ORDER BY is_heavy DESC, md5(child), child) AS nth FROM heavy
), visit AS (
  SELECT slug, slug AS root_slug, [CAST(0 AS BIGINT)] AS way FROM walk WHERE depth = 0
  UNION ALL
  SELECT turn.child, visit.root_slug, list_append(visit.way, turn.nth) FROM visit JOIN turn ON turn.parent = visit.slug
), placed AS (
  SELECT slug, root_slug, row_number() OVER (PARTITION BY root_slug ORDER BY way) - 1 AS place FROM visit
)
SELECT slug, root_slug, place, CASE WHEN size > 1 THEN place + 1 END AS first_place, CASE WHEN size > 1 THEN place + size - 1 END AS last_place
FROM placed JOIN sizes USING (slug)
UNION ALL
SELECT slug, '-', NULL, NULL, NULL FROM nodes WHERE slug NOT IN (SELECT slug FROM walk)
""",
    "p4_circles": _LINKS + """
, reach AS (
  SELECT child AS slug, parent AS via FROM up WHERE child NOT IN (SELECT slug FROM walk)
  UNION
  SELECT reach.slug, up.parent FROM reach JOIN up ON up.child = reach.via
)
SELECT r.slug, min(up.parent) AS parent_slug, min(r.via) AS circle FROM reach r JOIN up ON up.child = r.slug
GROUP BY r.slug HAVING bool_or(r.via = r.slug)
""",
    "p4_tails": _LINKS + """
, reach AS (
  SELECT child AS slug, parent AS via FROM up WHERE child NOT IN (SELECT slug FROM walk)
  UNION
  SELECT reach.slug, up.parent FROM reach JOIN up ON up.child = reach.via
), members AS (SELECT slug FROM reach WHERE slug = via)
SELECT slug, min(via) FILTER (via IN (SELECT slug FROM members)) AS circle FROM reach
WHERE slug NOT IN (SELECT slug FROM members) GROUP BY slug
""",
    "p5_found": """
WITH held AS (
  SELECT snapshot_id, contest_id, upper(trim(idx)) AS idx, rating, solved_count,
    list_sort(list_distinct(list_transform(coalesce(tags, []), lambda x: replace(replace(lower(trim(x)), ' ', '-'), '_', '-')))) AS tags,
    row_number() OVER (PARTITION BY snapshot_id, contest_id, upper(trim(idx)) ORDER BY loaded_at DESC) AS rn
  FROM problem_snapshots
), s AS (SELECT * FROM held WHERE rn = 1)
SELECT coalesce(b.snapshot_id, a.snapshot_id + 1) AS snapshot_id,
  coalesce(b.contest_id, a.contest_id) AS contest_id, coalesce(b.idx, a.idx) AS idx,
  CASE WHEN a.idx IS NULL THEN 'added' WHEN b.idx IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM (SELECT * FROM s WHERE snapshot_id < 5) a
FULL JOIN (SELECT * FROM s WHERE snapshot_id > 1) b
  ON b.snapshot_id = a.snapshot_id + 1 AND a.contest_id = b.contest_id AND a.idx = b.idx
WHERE a.idx IS NULL OR b.idx IS NULL OR a.rating IS DISTINCT FROM b.rating
  OR a.solved_count IS DISTINCT FROM b.solved_count OR a.tags IS DISTINCT FROM b.tags
""",
}

QUERIES = {
    "p4_found": p4_found,
    "p4_paths": p4_paths,
    "p4_descendants": p4_descendants,
    "p4_circles": p4_circles,
    "p4_tails": p4_tails,
    "p5_found": p5_found,
}
