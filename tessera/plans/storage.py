"""Documents and pages as objects, chunks and packs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import hashes, text
from tessera.operators import chunking, index, storage
from tessera.plans.registry import query, table
from tessera.sources import listing

#: Parameters of the registered queries, for texts of a few kilobytes.
INLINE, PACK, CHUNKS, BUDGET = 2048, 1 << 16, (256, 1024, 4096), 1_000_000


def _hash(c: str = "text") -> Column:
    return F.sha2(F.col(c).cast("binary"), 256)


def _bytes(c: str = "text") -> Column:
    return F.octet_length(c).cast("long")


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("content/"), _hash()).alias("key"), _bytes().alias("size"), F.col("text").alias("data"))


@query("SELECT 'content/' || sha256(text) AS key, min(doc_id) AS first_doc, count(*) AS copies FROM documents GROUP BY 1")
def content_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contents(spark, sf_dir).groupBy("key").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"))


@query("SELECT sum(n)::BIGINT AS objects, count(*) AS distinct_objects, sum(n * size)::BIGINT AS bytes, sum(size)::BIGINT AS stored_bytes FROM (SELECT sha256(text) AS k, count(*) AS n, max(strlen(text)) AS size FROM documents GROUP BY 1)")
def dedup_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.dedup_ratio(contents(spark, sf_dir))


@query("SELECT DISTINCT 'content/' || sha256(text) AS key FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE source = 'src0')")
def new_objects_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", F.concat(F.lit("content/"), _hash()).alias("key"))
    return storage.new_objects(docs, docs.where("source = 'src0'")).select("key")


@query("SELECT doc_id FROM documents WHERE source <> 'src0' AND sha256(text) IN (SELECT sha256(text) FROM documents WHERE source = 'src0')")
def stored_objects_semijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", _hash().alias("key"))
    return storage.already_stored(docs.where("source <> 'src0'"), docs.where("source = 'src0'")).select("doc_id")


@query("SELECT doc_id, CASE WHEN strlen(text) = 0 THEN 'empty' WHEN strlen(text) <= 2048 THEN 'inline' ELSE 'chunked' END AS placement FROM documents")
def inline_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contents(spark, sf_dir).select("doc_id", storage.placement(F.col("size"), INLINE).alias("placement"))


@query("SELECT doc_id, sum(strlen(text)) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS total, sum(strlen(text)) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) <= 1000000 AS allowed FROM documents")
def quota_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.quota_cutoff(contents(spark, sf_dir).select("doc_id", "size"), BUDGET, ["doc_id"]).select("doc_id", "total", "allowed")


_META = "SELECT 'content/' || sha256(text) AS key, strlen(text) AS size, lang = 'de' AS deleted FROM documents UNION ALL SELECT 'index/' || page_id, strlen(html), false FROM pages"


def _written(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("content/"), _hash()).alias("key"), _bytes().alias("size"), (F.col("lang") == "de").alias("deleted"))
    return docs.union(table(spark, sf_dir, "pages").select(F.concat(F.lit("index/"), F.col("page_id").cast("string")), _bytes("html"), F.lit(False)))


@query(f"SELECT sum(CASE WHEN deleted THEN -size ELSE size END)::BIGINT AS net_bytes FROM ({_META}) WHERE key NOT LIKE 'index/%'")
def metered_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.metered(_written(spark, sf_dir))


@query(f"SELECT string_split(key, '/')[1] AS prefix, count(*) AS objects, sum(size)::BIGINT AS bytes FROM ({_META}) GROUP BY 1")
def prefix_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.sizes_by_prefix(_written(spark, sf_dir))


@query(f"SELECT count(*) AS packable FROM ({_META}) WHERE size <= 2048")
def packable_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _written(spark, sf_dir).where(storage.packable(F.col("key"), F.col("size"), INLINE)).agg(F.count("*").alias("packable"))


@query("SELECT DISTINCT 'content/' || sha256(text) AS key FROM documents UNION SELECT 'content/' || sha256(text) FROM benchmark")
def list_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("content/"), _hash()).alias("key"))
    packs = table(spark, sf_dir, "region").select(F.concat(F.lit("packs/"), "r_name").alias("key"))
    return storage.list_objects(contents(spark, sf_dir), other, packs)


# Packs of stretches of the document order; German documents are dead.
_PACKS = """
WITH o AS (SELECT doc_id, lang, strlen(text) AS size, (sum(strlen(text)) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - strlen(text))::BIGINT AS b FROM documents),
p AS (SELECT doc_id, lang, size, b // 65536 AS pack, (b - min(b) OVER (PARTITION BY b // 65536))::BIGINT AS "offset" FROM o)
"""


def _packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", _bytes().alias("size"))
    return storage.fixed_packs(docs, ["doc_id"], "size", PACK)


@query(_PACKS + 'SELECT doc_id, pack, "offset" FROM p')
def pack_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packs(spark, sf_dir).select("doc_id", "pack", "offset")


_FRAGMENTS = (
    _PACKS
    + """, g AS (SELECT pack AS pack_ref, sum(size)::BIGINT AS physical, coalesce(sum(size) FILTER (lang <> 'de'), 0)::BIGINT AS active FROM p GROUP BY 1),
h AS (SELECT *, physical - active AS wasted, CASE WHEN active = 0 THEN 'delete' WHEN physical - active > 0 AND (physical - active) / physical::DOUBLE > 0.3 THEN 'repack' ELSE 'keep' END AS action FROM g)
"""
)


def _fragmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = _packs(spark, sf_dir)
    catalog = packed.where("lang <> 'de'").select(F.col("pack").alias("pack_ref"), F.col("size").alias("length"))
    physical = packed.groupBy(F.col("pack").alias("pack_ref")).agg(F.sum("size").alias("size"))
    return storage.fragmentation(catalog, physical)


@query(_FRAGMENTS + "SELECT pack_ref, physical, active, wasted, action FROM h")
def pack_fragmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fragmented(spark, sf_dir)


@query(_FRAGMENTS + "SELECT count(*) FILTER (action <> 'keep') AS packs_deleted, coalesce(sum(CASE action WHEN 'delete' THEN physical WHEN 'repack' THEN wasted END), 0)::BIGINT AS bytes_reclaimed FROM h")
def repack_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.repack_totals(_fragmented(spark, sf_dir))


@query(_FRAGMENTS + "SELECT doc_id FROM p JOIN h ON h.pack_ref = p.pack WHERE lang <> 'de' AND action = 'repack'")
def repack_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = _packs(spark, sf_dir).where("lang <> 'de'").withColumnRenamed("pack", "pack_ref")
    return storage.repacked_objects(catalog, _fragmented(spark, sf_dir)).select("doc_id")


@query(_FRAGMENTS + "SELECT doc_id, action = 'repack' AS moved, sha256(text) AS content_hash FROM p JOIN h ON h.pack_ref = p.pack JOIN documents USING (doc_id) WHERE p.lang <> 'de' AND action <> 'delete'")
def repacked_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects as they are read after the repack: from old packs, or moved to new ones."""
    texts = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("data"))
    packed = _packs(spark, sf_dir).join(texts, "doc_id").select(F.col("doc_id").cast("string").alias("key"), "lang", F.col("pack").cast("string").alias("pack_ref"), "offset", F.col("size").alias("length"), "data")
    packs = packed.groupBy("pack_ref").agg(F.array_sort(F.collect_list(storage.part("offset", "data"))).alias("p")).select("pack_ref", storage.joined_bytes("p").alias("data"))
    catalog, after = storage.repack(packed.where("lang <> 'de'").select("key", "pack_ref", "offset", "length"), packs, pack_size=PACK)
    moved = catalog.select("key", (F.length("pack_ref") == 64).alias("moved"))
    read = storage.read_packed(catalog.select("key"), catalog, after).join(moved, "key")
    return read.select(F.col("key").cast("long").alias("doc_id"), "moved", F.sha2("data", 256).alias("content_hash"))


@query("SELECT conv_id || ':' || turn AS key, text AS data FROM conversations WHERE role = 'user'")
def pack_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns are packed by conversation; those of users are read back by offset and length."""
    from pyspark.sql import Window

    key = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", key.alias("key"), F.col("text").cast("binary").alias("data"))
    order = Window.partitionBy("conv_id").orderBy("turn", "key")
    length = F.octet_length("data").cast("long")
    catalog = turns.select("key", F.col("conv_id").alias("pack_ref"), (F.sum(length).over(order.rowsBetween(Window.unboundedPreceding, 0)) - length).alias("offset"), length.alias("length"))
    packs = turns.groupBy(F.col("conv_id").alias("pack_ref")).agg(F.array_sort(F.collect_list(F.struct("turn", "key", "data"))).alias("parts"))
    packs = packs.select("pack_ref", F.aggregate("parts", F.lit(bytearray()), lambda a, p: F.concat(a, p["data"])).alias("data"))
    return storage.read_packed(turns.where("role = 'user'"), catalog, packs).select("key", F.col("data").cast("string").alias("data"))


@query("SELECT conv_id, string_agg(text, '' ORDER BY turn, text) AS text FROM conversations GROUP BY conv_id")
def reassemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns are chunks of a conversation, put together in order."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return storage.reassemble(turns, "conv_id", "turn", "text")


@query("SELECT DISTINCT k.key, d.text AS data FROM (SELECT 'content/' || sha256(text) AS key FROM benchmark) k LEFT JOIN (SELECT DISTINCT 'content/' || sha256(text) AS key, text FROM documents) d ON d.key = k.key")
def object_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("content/"), _hash()).alias("key")).distinct()
    stored = contents(spark, sf_dir).select("key", "data").dropDuplicates(["key"])
    return storage.objects(stored, wanted)


@query("SELECT doc_id::VARCHAR AS id, strlen(text)::BIGINT AS size, sha256(text) AS content_hash FROM documents WHERE strlen(text) > 0")
def cdc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content-defined chunks of every document, put together again."""
    parts = chunking.chunks(table(spark, sf_dir, "documents"), "doc_id", "text", CHUNKS)
    whole = parts.groupBy("id").agg(F.sum("size").alias("size"), F.array_sort(F.collect_list(storage.part("pos", "data"))).alias("p"))
    return whole.select("id", "size", F.sha2(storage.joined_bytes("p"), 256).alias("content_hash"))


@query(
    f"""WITH RECURSIVE o AS (
  SELECT key, size, ('0x' || substr(md5(key), 1, 8))::BIGINT % 8 AS shard FROM (SELECT DISTINCT 'content/' || sha256(text) AS key, strlen(text)::BIGINT AS size FROM documents)),
r AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY key) AS i FROM o),
p AS (
  SELECT shard, i, key, size, 0 AS pack, 0::BIGINT AS held FROM r WHERE i = 1
  UNION ALL SELECT r.shard, r.i, r.key, r.size, CASE WHEN p.held + p.size >= {PACK} THEN p.pack + 1 ELSE p.pack END, CASE WHEN p.held + p.size >= {PACK} THEN 0 ELSE p.held + p.size END
  FROM p JOIN r ON r.shard = p.shard AND r.i = p.i + 1)
SELECT shard::INT AS shard, pack::INT AS pack, key, held AS "offset", size AS length FROM p"""
)
def greedy_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects = contents(spark, sf_dir).select("key", "size").dropDuplicates(["key"])
    return storage.greedy_packs(objects, 8, PACK)


_KEY = bytes(range(32))


@query("SELECT doc_id, sha256(text) AS content_hash, (strlen(text) + 29)::BIGINT AS sealed_size FROM documents")
def encrypt_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", hashes.seal(F.col("text").cast("binary"), _KEY).alias("sealed"))
    return docs.select("doc_id", F.sha2(hashes.unseal(F.col("sealed"), _KEY), 256).alias("content_hash"), F.octet_length("sealed").cast("long").alias("sealed_size"))


_PADS = [bytes(b ^ p for b in b"tessera".ljust(64, b"\0")).hex() for p in (0x36, 0x5C)]


@query(f"SELECT doc_id, sha256(unhex('{_PADS[1]}') || unhex(sha256(unhex('{_PADS[0]}') || sha256(text)::BLOB))) AS content_ref FROM documents")
def hmac_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", hashes.content_ref(_hash(), b"tessera").alias("content_ref"))


_AFFINITY = "SELECT doc_id, substr(sha256(source), 1, 4) || substr(sha256(doc_id::VARCHAR), 5) AS path_key, sha256(text) AS ref, lang FROM documents"


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    key = hashes.affinity_key(F.col("source"), F.col("doc_id").cast("string"))
    return docs.select("doc_id", F.col("doc_id").cast("string").alias("file_id"), key.alias("path_key"), _hash().alias("ref"), "lang")


@query(f"SELECT doc_id, path_key FROM ({_AFFINITY})")
def affinity_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(spark, sf_dir).select("doc_id", "path_key")


@query(f"SELECT (('0x' || substr(path_key, 1, 8))::BIGINT >> 27) & 31 AS bucket, (('0x' || substr(path_key, 1, 8))::BIGINT >> 22) & 31 AS below, count(*) AS entries FROM ({_AFFINITY}) GROUP BY 1, 2")
def hamt_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = [hashes.bucket_index(F.col("path_key"), level).cast("long").alias(n) for level, n in ((0, "bucket"), (1, "below"))]
    return entries(spark, sf_dir).groupBy(*at).agg(F.count("*").alias("entries"))


_NODES = f"""
WITH e AS (SELECT *, ('0x' || substr(path_key, 1, 8))::BIGINT AS k FROM ({_AFFINITY})),
c AS (SELECT l AS level, k >> (32 - 5 * l) AS node, count(*) AS entries FROM e, range(0, 7) t(l) GROUP BY 1, 2),
n AS (SELECT c.* FROM c LEFT JOIN c up ON up.level = c.level - 1 AND up.node = c.node >> 5 WHERE c.level = 0 OR (up.entries > 32 AND up.level < 6))
"""


@query(_NODES + "SELECT level::INT AS level, CASE WHEN entries <= 32 OR level = 6 THEN 'leaf' ELSE 'internal' END AS kind, count(*) AS nodes, sum(entries)::BIGINT AS entries FROM n GROUP BY 1, 2")
def hamt_leaf_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and entries by level and kind. An internal node stands on a chain of internal nodes only."""
    return index.nodes(entries(spark, sf_dir)).groupBy("level", "kind").agg(F.count("*").alias("nodes"), F.sum("entries").alias("entries"))


def _sharing_sql() -> str:
    """Hashes of all nodes of both versions, level by level from the deepest."""
    levels = ["r6 AS (SELECT ver, node, ref FROM l WHERE level = 6)"]
    for level in range(5, -1, -1):
        above = f"SELECT ver, node >> 5, sha256(string_agg(ref, chr(10) ORDER BY node)) FROM r{level + 1} GROUP BY 1, 2"
        levels.append(f"r{level} AS (SELECT ver, node, ref FROM l WHERE level = {level} UNION ALL {above})")
    every = " UNION ALL ".join(f"SELECT {level} AS level, * FROM r{level}" for level in range(7))
    return f"""{_NODES}, leaf AS (SELECT level, node FROM n WHERE entries <= 32 OR level = 6),
v AS (SELECT 0 AS ver, doc_id::VARCHAR AS id, ref, k FROM e UNION ALL SELECT 1, doc_id::VARCHAR, CASE WHEN lang = 'fr' THEN sha256(ref || 'x') ELSE ref END, k FROM e),
l AS (SELECT ver, level, node, sha256(string_agg(id || '=' || ref, chr(10) ORDER BY id || '=' || ref)) AS ref FROM v JOIN leaf ON v.k >> (32 - 5 * level) = node GROUP BY 1, 2, 3),
{", ".join(levels)}, every AS ({every})
SELECT level::INT AS level, count(*) AS nodes, count(*) FILTER (WHERE ref NOT IN (SELECT ref FROM every WHERE ver = 0)) AS new_nodes FROM every WHERE ver = 1 GROUP BY 1"""


@query(_sharing_sql())
def structural_sharing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that are new when all French documents change."""
    before = entries(spark, sf_dir)
    after = before.withColumn("ref", F.when(F.col("lang") == "fr", F.sha2(F.concat("ref", F.lit("x")), 256)).otherwise(F.col("ref")))
    both = index.node_refs(before.withColumn("version", F.lit(0)).union(after.withColumn("version", F.lit(1))), by=["version"])
    return index.rewritten(both.where("version = 0"), both.where("version = 1"))


@query(
    f"""WITH e AS (SELECT *, ('0x' || substr(path_key, 1, 8))::BIGINT AS k FROM ({_AFFINITY})), b AS (SELECT sum(DISTINCT 1::BIGINT << ((k >> 27) & 31)::INT)::BIGINT AS bitmap FROM e)
SELECT doc_id, bit_count(bitmap & ((1::BIGINT << ((k >> 27) & 31)::INT) - 1))::INT AS position FROM e, b"""
)
def child_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the child of each entry lies among the children that the root has."""
    at = entries(spark, sf_dir).withColumn("child", hashes.bucket_index(F.col("path_key"), 0))
    bitmap = at.agg(F.bit_or(hashes.child_bit(F.col("child")))).first()[0]  # one number
    return at.select("doc_id", hashes.child_position(F.lit(bitmap or 0).cast("long"), F.col("child")).alias("position"))


@query("SELECT source, sha256(string_agg(DISTINCT lang, chr(10) ORDER BY lang)) AS fingerprint FROM documents GROUP BY source")
def exclude_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = table(spark, sf_dir, "documents").groupBy("source").agg(F.array_sort(F.collect_set("lang")).alias("patterns"))
    return lists.select("source", hashes.rules_fingerprint(F.col("patterns")).alias("fingerprint"))


@query(
    """SELECT doc_id, CASE WHEN b >= 1099511627776 THEN printf('%.1f TiB', b / 1099511627776.0) WHEN b >= 1073741824 THEN printf('%.1f GiB', b / 1073741824.0)
  WHEN b >= 1048576 THEN printf('%.1f MiB', b / 1048576.0) WHEN b >= 1024 THEN printf('%.1f KiB', b / 1024.0) ELSE b || ' B' END AS shown FROM (SELECT doc_id, n_chars * (1 + doc_id) AS b FROM documents)"""
)
def format_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.format_bytes(F.col("n_chars") * (1 + F.col("doc_id"))).alias("shown"))


@query("SELECT page_id, CASE WHEN p LIKE '%.html' THEN regexp_extract(p, '^(.*)/[^/]*$', 1) || '/x' ELSE p || '/y' END AS path FROM (SELECT page_id, rtrim(regexp_extract(url, '://([^?#]*)', 1), '/') AS p FROM pages)")
def path_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths with dots, double slashes and backslashes, resolved."""
    raw = F.rtrim(F.regexp_extract("url", "://([^?#]*)", 1), F.lit("/"))
    odd = F.when(raw.endswith(".html"), F.concat(F.lit(" //"), raw, F.lit("\\..//./x/ "))).otherwise(F.concat(F.lit("/../"), raw, F.lit("/./y")))
    return table(spark, sf_dir, "pages").select("page_id", text.normalize_path(odd).alias("path"))


@query(
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' WHEN 'O' THEN 'application/pdf' END AS mime,
  CASE o_orderstatus WHEN 'F' THEN '.docx' WHEN 'O' THEN '.pdf' END AS extension FROM orders"""
)
def native_export_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("o_orderstatus") == "F", "application/vnd.google-apps.document").when(F.col("o_orderstatus") == "O", "application/vnd.google-apps.other").otherwise("image/png")
    return table(spark, sf_dir, "orders").select("o_orderkey", text.native_export(kind).alias("e")).select("o_orderkey", "e.mime", "e.extension")


@query("SELECT c_custkey, lower(replace(c_name, '#', '-')) || '-' || lower(c_mktsegment) AS slug FROM customer")
def name_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", text.slug(F.concat(F.lit("--"), "c_name", F.lit(" / "), "c_mktsegment", F.lit("._"))).alias("slug"))


@query("SELECT coalesce(sum(n_chars) FILTER (lang <> 'de' AND source <> 'src0'), 0)::BIGINT AS bytes, count(*) FILTER (lang <> 'de' AND source <> 'src0') AS files FROM documents")
def source_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of a source without excluded files and without folders."""
    docs = table(spark, sf_dir, "documents")
    files = docs.select(F.concat_ws("/", "lang", F.col("doc_id").cast("string")).alias("path"), F.when(F.col("source") == "src0", "folder").otherwise("file").alias("type"), F.col("n_chars").alias("size"))
    return listing.excluded_size(files, ["de/**"])


@query("SELECT n_regionkey::BIGINT AS region, string_agg(n_name, ',' ORDER BY n_name) AS profiles FROM nation GROUP BY n_regionkey")
def profiles_by_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators.dashboard import used_by

    profiles = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("store"))
    return used_by(profiles, "store").select(F.col("store").cast("long").alias("region"), "profiles")
