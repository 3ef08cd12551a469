"""Region to lineitem as a reference graph, and documents as a tree: ten children to a folder, by number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import exclude as ex
from tessera.operators import graph
from tessera.plans.registry import query, table

# References: live orders point at parts through their items.
_LIVE = """
WITH live AS (SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1995-06-01'),
used AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM live)),
reach AS (SELECT DISTINCT 'order/' || o_orderkey AS key FROM live UNION SELECT 'part/' || l_partkey FROM used UNION SELECT 'supplier/' || l_suppkey FROM used),
objects AS (SELECT DISTINCT 'part/' || p_partkey AS key, p_size::BIGINT AS size FROM part UNION ALL SELECT DISTINCT 'supplier/' || s_suppkey, 100 FROM supplier)
"""


def _key(kind: str, column: str) -> Column:
    return F.concat(F.lit(f"{kind}/"), F.col(column).cast("string"))


def live_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = table(spark, sf_dir, "orders").where(F.col("o_orderdate") < F.lit("1995-06-01").cast("timestamp_ntz")).select(_key("order", "o_orderkey").alias("key"))
    items = table(spark, sf_dir, "lineitem")
    edges = items.select(_key("order", "l_orderkey").alias("src"), F.explode(F.array(_key("part", "l_partkey"), _key("supplier", "l_suppkey"))).alias("dst"))
    return graph.reachable_levels(roots, [edges])


def stored_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(_key("part", "p_partkey").alias("key"), F.col("p_size").cast("long").alias("size")).distinct()
    suppliers = table(spark, sf_dir, "supplier").select(_key("supplier", "s_suppkey").alias("key"), F.lit(100).cast("long").alias("size")).distinct()
    return parts.union(suppliers)


@query(_LIVE + "SELECT key FROM reach")
def reachability_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live_objects(spark, sf_dir)


@query(_LIVE + "SELECT key, size FROM objects WHERE key NOT IN (SELECT key FROM reach)")
def prune_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.unreachable(stored_objects(spark, sf_dir), live_objects(spark, sf_dir))


@query(_LIVE + "SELECT count(*) AS scanned, count(*) FILTER (key NOT IN (SELECT key FROM reach)) AS deleted, coalesce(sum(size) FILTER (key NOT IN (SELECT key FROM reach)), 0)::BIGINT AS bytes_reclaimed FROM objects")
def prune_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.prune_totals(stored_objects(spark, sf_dir), live_objects(spark, sf_dir))


@query(
    """WITH RECURSIVE e AS (SELECT 'region/' || n_regionkey AS src, 'nation/' || n_nationkey AS dst FROM nation
  UNION ALL SELECT 'nation/' || c_nationkey, 'customer/' || c_custkey FROM customer UNION ALL SELECT 'customer/' || o_custkey, 'order/' || o_orderkey FROM orders),
r(key, depth) AS (SELECT 'region/' || r_regionkey, 0 FROM region WHERE r_name = 'ASIA' UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.key)
SELECT key, depth FROM r"""
)
def transitive_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that hangs below one region, however deep."""
    edges = table(spark, sf_dir, "nation").select(_key("region", "n_regionkey").alias("src"), _key("nation", "n_nationkey").alias("dst"))
    edges = edges.union(table(spark, sf_dir, "customer").select(_key("nation", "c_nationkey"), _key("customer", "c_custkey")))
    edges = edges.union(table(spark, sf_dir, "orders").select(_key("customer", "o_custkey"), _key("order", "o_orderkey")))
    roots = table(spark, sf_dir, "region").where("r_name = 'ASIA'").select(_key("region", "r_regionkey").alias("key"))
    return graph.reachable(edges, roots)


# Damage: parts of one brand are lost; documents of one language have other bytes than their key says.
_ERRORS = """
WITH missing AS (SELECT DISTINCT 'part/' || l_partkey AS key, 'missing' AS type FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_brand <> 'Brand#1')),
corrupt AS (SELECT DISTINCT 'content/' || sha256(text) AS key, 'corrupt' AS type FROM documents WHERE lang = 'de')
"""


def _missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "lineitem").select(_key("part", "l_partkey").alias("dst"))
    stored = table(spark, sf_dir, "part").where("p_brand <> 'Brand#1'").select(_key("part", "p_partkey").alias("key"))
    return graph.missing(edges, stored)


def _corrupt(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    stored = table(spark, sf_dir, "documents").select(F.concat(F.lit("content/"), F.sha2(text.cast("binary"), 256)).alias("key"), F.when(F.col("lang") == "de", F.concat(text, F.lit("!"))).otherwise(text).alias("data"))
    return graph.corrupt(stored).distinct()


@query(_ERRORS + "SELECT key, type FROM missing")
def integrity_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _missing(spark, sf_dir).select("key", "type")


@query(_ERRORS + "SELECT key, type FROM corrupt")
def integrity_corrupt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corrupt(spark, sf_dir).select("key", "type")


@query(_ERRORS + "SELECT type, count(*) AS errors FROM (SELECT * FROM missing UNION ALL SELECT * FROM corrupt) GROUP BY type")
def check_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.check_summary(_missing(spark, sf_dir).union(_corrupt(spark, sf_dir)))


@query(
    """SELECT event_id FROM (SELECT event_id, CASE event_id % 7 WHEN 0 THEN substr(props, 1, length(props) - 1) WHEN 1 THEN '' ELSE props END AS p FROM events)
WHERE try_cast(p AS JSON) IS NULL OR json_type(try_cast(p AS JSON)) <> 'OBJECT'"""
)
def integrity_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of which some are cut off or empty."""
    data = F.when(F.col("event_id") % 7 == 0, F.expr("substring(props, 1, length(props) - 1)")).when(F.col("event_id") % 7 == 1, "").otherwise(F.col("props"))
    rows = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("key"), data.alias("data"))
    return graph.unparsable(rows, "k double").select(F.col("key").cast("long").alias("event_id"))


_TREE = """
WITH RECURSIVE f AS (SELECT doc_id AS id, source || '-' || doc_id AS name, CASE WHEN doc_id > 0 THEN doc_id // 10 END AS up, n_chars AS size, text FROM documents),
p AS (SELECT id, name AS path, 0 AS depth FROM f WHERE up IS NULL UNION ALL SELECT f.id, p.path || '/' || f.name, p.depth + 1 FROM f JOIN p ON f.up = p.id),
inner_ids AS (SELECT DISTINCT up AS id FROM f WHERE up IS NOT NULL)
"""


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, name, parents, type, size, content_hash."""
    docs = table(spark, sf_dir, "documents")
    up = F.floor(F.col("doc_id") / 10).cast("string")
    rows = docs.select(F.col("doc_id").cast("string").alias("file_id"), F.concat_ws("-", "source", F.col("doc_id").cast("string")).alias("name"), F.when(F.col("doc_id") > 0, F.array(up)).otherwise(F.array().cast("array<string>")).alias("parents"), F.col("n_chars").alias("size"), F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"))
    inner = rows.select(F.explode("parents").alias("file_id")).distinct().withColumn("_inner", F.lit(True))
    return rows.join(inner, "file_id", "left").withColumn("type", F.when(F.col("_inner"), "folder").otherwise("file")).drop("_inner")


@query("SELECT doc_id, CASE WHEN source = 'src1' THEN CASE WHEN lang = 'en' THEN '' ELSE lang || '/' || doc_id END END AS path FROM documents")
def relative_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths below one folder; others have none."""
    lang, own = F.col("lang"), F.col("doc_id").cast("string")
    path = F.when(lang == "en", F.concat(F.lit("all/"), "source")).otherwise(F.concat_ws("/", F.lit("all"), "source", lang, own))
    return table(spark, sf_dir, "documents").select("doc_id", graph.relative_path(path, "/all/src1/").alias("path"))


@query(
    """WITH RECURSIVE p AS (
  SELECT doc_id AS first, doc_id AS id, 'n' || doc_id AS path, 0 AS depth FROM documents
  UNION ALL SELECT first, id - 1, 'n' || (id - 1) || '/' || path, depth + 1 FROM p WHERE depth < 50 AND id % 70 > 0)
SELECT first::VARCHAR AS file_id, path, depth FROM p QUALIFY row_number() OVER (PARTITION BY first ORDER BY depth DESC) = 1"""
)
def deep_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of 70 files: a path has at most 50 parents."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file_id"), F.concat(F.lit("n"), "doc_id").alias("name"), F.when(F.col("doc_id") % 70 > 0, F.array((F.col("doc_id") - 1).cast("string"))).otherwise(F.array().cast("array<string>")).alias("parents"))
    return graph.paths(docs)


@query(_TREE + "SELECT id AS file_id, path, depth FROM p")
def tree_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.paths(tree(spark, sf_dir)).select(F.col("file_id").cast("long").alias("file_id"), "path", "depth")


@query(_TREE + "SELECT f.id AS file_id, up.name AS parent_name, up.id IS NULL AS is_root FROM f LEFT JOIN f up ON f.up = up.id")
def tree_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.with_parent(tree(spark, sf_dir)).select(F.col("file_id").cast("long").alias("file_id"), "parent_name", "is_root")


@query(_TREE + ", c AS (SELECT up AS id FROM f WHERE name LIKE 'src7-%' AND up IS NOT NULL UNION SELECT f.up FROM c JOIN f ON f.id = c.id WHERE f.up IS NOT NULL) SELECT id AS file_id FROM c")
def ancestor_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tree(spark, sf_dir)
    return graph.ancestors_of(files, files.where("name like 'src7-%'")).select(F.col("file_id").cast("long").alias("file_id"))


@query(_TREE + ", c AS (SELECT id, 1 AS depth FROM f WHERE up = 3 UNION ALL SELECT f.id, c.depth + 1 FROM c JOIN f ON f.up = c.id) SELECT id AS file_id, depth FROM c")
def descendant_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.descendants_of(tree(spark, sf_dir), "3").select(F.col("file_id").cast("long").alias("file_id"), "depth")


_RESTORE = (
    _TREE
    + """, t AS (SELECT path AS target FROM p WHERE id = 3),
m AS (SELECT p.id FROM p, t WHERE p.path = target OR starts_with(p.path, target || '/')),
a AS (SELECT id FROM m UNION SELECT f.up FROM a JOIN f ON f.id = a.id WHERE f.up IS NOT NULL)
"""
)


def _selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tree(spark, sf_dir)
    names = {r["file_id"]: r["name"] for r in files.where("file_id in ('0', '3')").select("file_id", "name").collect()}  # two rows
    return graph.restore_selection(files, f"{names.get('0')}/{names.get('3')}/")


@query(_RESTORE + "SELECT p.id AS file_id, path FROM p WHERE id IN (SELECT id FROM a)")
def restore_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _selected(spark, sf_dir).select(F.col("file_id").cast("long").alias("file_id"), "path")


@query(_RESTORE + "SELECT count(*) FILTER (id IN (SELECT id FROM inner_ids)) AS dirs, count(*) FILTER (id NOT IN (SELECT id FROM inner_ids)) AS files, coalesce(sum(size) FILTER (id NOT IN (SELECT id FROM inner_ids)), 0)::BIGINT AS bytes FROM f WHERE id IN (SELECT id FROM a)")
def restore_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.restore_totals(_selected(spark, sf_dir))


@query(_TREE + "SELECT f.id AS file_id, f.up IS NULL OR q.depth < p.depth AS after_parent FROM f JOIN p USING (id) LEFT JOIN p q ON q.id = f.up")
def topo_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In the order of the result every file follows its parent."""
    placed = graph.topological(tree(spark, sf_dir))
    up = placed.select(F.col("file_id").alias("_up"), F.col("depth").alias("_depth"))
    joined = placed.join(up, F.get("parents", F.lit(0)) == F.col("_up"), "left")
    return joined.orderBy("depth", "path").select(F.col("file_id").cast("long").alias("file_id"), (F.col("_up").isNull() | (F.col("_depth") < F.col("depth"))).alias("after_parent"))


# Exclude rules over the paths of pages, the host as the first segment.
RULES = ["# pages", "*.html", "!tionsh.example.net/en/*.html", "spam-*/", "blog.*/**/9*", "www.?h*/de/*", ""]
_PATHS = """
WITH paths AS (SELECT page_id, regexp_extract(url, '://([^?#]*)', 1) AS raw FROM pages),
q AS (SELECT page_id, rtrim(raw, '/') AS path FROM paths),
r AS (SELECT page_id, path, string_split(path, '/')[-1] AS base FROM q),
x AS (SELECT page_id, path, CASE
    WHEN regexp_matches(path, '^www\\.[^/]h[^/]*/de/[^/]*$') THEN true
    WHEN regexp_matches(path, '^blog\\.[^/]*/(?:[^/]*/)*9[^/]*$') THEN true
    WHEN regexp_matches(path, '^tionsh\\.example\\.net/en/[^/]*\\.html$') THEN false
    WHEN base LIKE '%.html' THEN true ELSE false END AS excluded FROM r)
"""


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.rtrim(F.regexp_extract("url", "://([^?#]*)", 1), F.lit("/"))
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path"), F.lit(False).alias("is_folder"))


@query(_PATHS + "SELECT page_id, excluded FROM x")
def exclude_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).select("page_id", ex.excluded(ex.parse_rules(RULES), F.col("path"), F.col("is_folder")).alias("excluded"))


@query(_PATHS + "SELECT page_id, path FROM x WHERE NOT excluded AND NOT regexp_matches(path, '^spam-[^/]*/')")
def exclude_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders that a rule hides hide all below them."""
    pages = _paths(spark, sf_dir)
    folders = pages.select(F.explode(ex.ancestors(F.col("path"))).alias("path")).where("path <> ''").distinct()
    entries = pages.unionByName(folders.select(F.lit(None).cast("long").alias("page_id"), "path", F.lit(True).alias("is_folder")))
    return ex.exclude(entries, ex.parse_rules(RULES)).where("not is_folder").select("page_id", "path")
