"""Near-duplicate groups: SuperMinHash signatures, banding, verification on full sets, union-find grouping.

1. Each whole text becomes its set of five-word shingles and a signature of 128 slots; 32 bands of 4 slots. At
   similarity 0.75 a pair shares no band with probability 5e-6.
2. Texts with equal words (a digest of 128 bits) form a class, whose smallest doc_id stands for it: exact copies never
   meet in a bucket.
3. In every bucket each member meets the smallest one. Per document the partner with the most common bands is verified
   on full sets, and verified links are merged.
4. Buckets whose members are then still in several components are looked at by signature: a maximum spanning forest
   over the pairs of different components whose estimate is at least MIN_ESTIMATE joins such components to families.
5. Inside a family every pair of different components with such an estimate is verified on full sets, the likeliest
   first, unless links found before connect it. Links inside a component can't change it, so no link between components
   is lost, and what leaves a task is at most one link per merge.

Members of a bucket or family are cut into blocks, and pairs of blocks are dealt over tasks, so neither a task's memory
nor its rows grow with a group. Blocks of the largest component only meet those of the others. Where several components
of a group are large and no link joins them, proving that takes work in proportion to the product of their sizes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.components import chased, connected_components, merged
from tessera.llm.shared import encoded, materialise, pieces, table
from tessera.llm.shingles import exact_shingles, mix64, plain, shingle_sets, super_minhash

SLOTS, BANDS = 128, 32
#: Links have 100 * intersection >= THRESHOLD * union.
THRESHOLD = 75
#: Estimates have a standard deviation of at most 0.038 at similarity 0.75; this is 4.7 of them below.
MIN_ESTIMATE = 0.57
#: Members of a bucket that are compared with each other at once.
BLOCK = 512
#: Up to so many pairs, their ids (16 bytes each) are broadcast to pick the texts; more are joined.
FEW_PAIRS = 200_000

_SKETCH = "doc_id long, n_shingles long, set_a long, set_b long, signature binary, bands array<long>"
_PAIR = "a long, b long"


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        texts = encoded(batch.column("text"))
        sets = shingle_sets(texts)
        signature = super_minhash(sets, SLOTS).view(np.uint64)
        rows = signature.reshape(len(sets), BANDS, SLOTS // BANDS)
        key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(sets), BANDS)).copy()
        for i in range(SLOTS // BANDS):
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, i])
        short = (mix64(signature) & np.uint64(0xFFFF)).astype(np.uint16)
        digest = np.frombuffer(b"".join(hashlib.blake2b(plain(t), digest_size=16).digest() for t in texts), "<i8").reshape(-1, 2)
        yield pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id"), "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
            "set_a": pa.array(digest[:, 0].copy()), "set_b": pa.array(digest[:, 1].copy()),
            "signature": pa.array([s.tobytes() for s in short], pa.binary()), "bands": pa.array([list(k) if len(s) else [] for k, s in zip(_signed(key), sets, strict=True)], pa.list_(pa.int64())),
        })


def sketches(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): number of shingles, digest of the words, signature and band keys."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_sketch, _SKETCH)


def linked(a: np.ndarray, b: np.ndarray, threshold: int) -> bool:
    """Whether the sorted sets are similar enough; exact."""
    if threshold * max(len(a), len(b)) > 100 * min(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return bool(common) and 100 * common >= threshold * (len(a) + len(b) - common)


def confirmed(a: bytes, b: bytes, threshold: int) -> bool:
    """linked() on the shingles themselves: what hashes have found counts only if the words agree."""
    x, y = exact_shingles(a), exact_shingles(b)
    common = len(x & y)
    return bool(common) and 100 * common >= threshold * (len(x) + len(y) - common)


def _verifier(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int | None, np.ndarray] = (None, np.empty(0, np.uint64))
        for batch in pieces(batches, "text_b"):
            a, b = (batch.column(c).to_pylist() for c in ("a", "b"))
            column, others = batch.column("text_a"), encoded(batch.column("text_b"))
            sets, good = shingle_sets(others), []
            for i in range(len(a)):
                if last[0] is None or last[0] != a[i]:
                    text = encoded(column.slice(i, 1))[0]
                    last = (a[i], shingle_sets([text])[0])
                if linked(last[1], sets[i], threshold) and confirmed(text, others[i], threshold):
                    good.append(i)
            yield pa.RecordBatch.from_pydict({c: pa.array([v[i] for i in good], pa.int64()) for c, v in (("a", a), ("b", b))})

    return run


def verified(pairs: DataFrame, texts: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Those of pairs (a, b), a materialised table, whose texts (doc_id, text) are linked, by their full sets."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    few = pairs.count() <= FEW_PAIRS
    texts = texts.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    second = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    both = second.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_verifier(threshold), _PAIR)


def _estimates(signatures: np.ndarray) -> np.ndarray:
    """Equal slots of each two signatures."""
    out = np.zeros((len(signatures), len(signatures)), np.uint8)
    for i in range(len(signatures) - 1):
        out[i, i + 1 :] = np.count_nonzero(signatures[i + 1 :] == signatures[i], axis=1)
    return out + out.T


def forest(estimates: np.ndarray, comps: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Edges between different components of a maximum spanning forest (Prim), of pairs with at least so many equal slots."""
    n = len(comps)
    same = {c: np.flatnonzero(comps == c) for c in np.unique(comps)}
    inside, best, source = np.zeros(n, bool), np.zeros(n, np.int16), np.zeros(n, np.int64)
    out: list[tuple[int, int]] = []
    for _ in range(len(same)):
        at = int(np.argmax(np.where(inside, -1, best)))
        if best[at] >= least and best[at]:
            out.append((int(source[at]), at))
        for x in same[comps[at]]:  # the whole component is connected already
            inside[x] = True
            better = estimates[x] > best
            best[better], source[better] = estimates[x][better], x
    return out


class _Groups:
    """Rows of sorted batches, gathered by (key, i, j); each group has at most two blocks of documents."""

    def __init__(self, columns: tuple[str, ...]) -> None:
        self.columns = columns

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[dict[int, tuple]]:
        at, rows = None, {}
        for batch in batches:
            for key, i, j, doc_id, *rest in zip(*(batch.column(c).to_pylist() for c in ("key", "i", "j", "doc_id", *self.columns)), strict=True):
                if at != (key, i, j):
                    if len(rows) > 1:
                        yield rows
                    at, rows = (key, i, j), {}
                rows[doc_id] = tuple(rest)
        if len(rows) > 1:
            yield rows


def _compared(rows: dict[int, tuple]) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Ids, components and equal slots of a group's rows (component, signature, ...)."""
    comps = np.array([v[0] for v in rows.values()], np.int64)
    return list(rows), comps, _estimates(np.frombuffer(b"".join(v[1] for v in rows.values()), np.uint16).reshape(len(rows), SLOTS))


def _pairs(groups: Iterator[list[tuple[int, int]]]) -> Iterator[pa.RecordBatch]:
    for out in groups:
        if out:
            yield pa.RecordBatch.from_pydict({"a": pa.array([min(x) for x in out], pa.int64()), "b": pa.array([max(x) for x in out], pa.int64())})


def _suggest(least: float):
    slots = int(np.ceil(least * SLOTS))

    def pairs(rows: dict[int, tuple]) -> list[tuple[int, int]]:
        if len({v[0] for v in rows.values()}) < 2:
            return []
        ids, comps, estimates = _compared(rows)
        return [(ids[i], ids[j]) for i, j in forest(estimates, comps, slots)]

    return lambda batches: _pairs(map(pairs, _Groups(("component", "signature"))(batches)))


def _search(least: float, threshold: int):
    slots = int(np.ceil(least * SLOTS))

    def pairs(rows: dict[int, tuple]) -> list[tuple[int, int]]:
        ids, comps, estimates = _compared(rows)
        texts, sets, root, out = [v[2] for v in rows.values()], {}, {}, []

        def find(c: int) -> int:
            while (up := root.get(c, c)) != c:
                root[c] = c = root.get(up, up)
            return c

        def of(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = shingle_sets([(texts[i] or "").encode()])[0]
            return sets[i]

        found = np.argwhere(np.triu((estimates >= slots) & (comps[:, None] != comps[None, :])))
        found = found[np.argsort(-estimates[found[:, 0], found[:, 1]].astype(np.int16), kind="stable")]
        for i, j in found.tolist():  # the likeliest first: most pairs are connected before their turn
            a, b = find(int(comps[i])), find(int(comps[j]))
            if a != b and linked(of(i), of(j), threshold) and confirmed((texts[i] or "").encode(), (texts[j] or "").encode(), threshold):
                root[a] = b
                out.append((ids[i], ids[j]))
        return out

    return lambda batches: _pairs(map(pairs, _Groups(("component", "signature", "text"))(batches)))


def _dealt(members: DataFrame, block: int) -> DataFrame:
    """members (key, doc_id, component, ...) as rows of pairs of blocks (i, j) of their key.

    The largest component of a key has blocks of its own, which meet only those of the others: a key with one large
    component and some strays has rows in proportion to its members.
    """
    sizes = members.groupBy("key", "component").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("key").agg(F.sum("n").alias("all"), F.max(F.struct("n", "component")).alias("top"))
    blocks = lambda n: F.ceil(n / block).cast("int")
    largest = largest.select("key", F.col("top.component").alias("large"), blocks(F.col("all") - F.col("top.n")).alias("few"), blocks(F.col("top.n")).alias("many"))
    cut = members.join(materialise(largest), "key").withColumn("is_large", F.col("component") == F.col("large"))
    hashed = F.xxhash64("doc_id")
    own = F.when(F.col("is_large"), F.col("few") + F.pmod(hashed, "many")).otherwise(F.pmod(hashed, "few")).cast("int")
    others = F.col("few") + F.when(F.col("is_large"), 0).otherwise(F.col("many"))
    cut = cut.where("few > 0").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), others - 1)))
    return cut.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("large", "few", "many", "is_large", "own", "other")


def _together(rows: DataFrame) -> DataFrame:
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def _residual_links(multi: DataFrame, reps: DataFrame, label: DataFrame, texts: DataFrame, threshold: int, block: int, least: float) -> DataFrame:
    """Links (a, b) between different components; multi has a row (key, doc_id) per member of a bucket."""
    at = multi.join(label, multi["doc_id"] == label["node"], "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    mixed = at.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    at = materialise(at.join(mixed, "key", "left_semi"))
    signature = reps.select("doc_id", "signature")
    suggested = _together(_dealt(at, block).join(signature, "doc_id")).mapInArrow(_suggest(least), _PAIR).distinct()
    member = at.select("doc_id", "component").distinct()
    ends = suggested.join(member.withColumnsRenamed({"doc_id": "a", "component": "src"}), "a").join(member.withColumnsRenamed({"doc_id": "b", "component": "dst"}), "b")
    family = materialise(connected_components(ends.select("src", "dst")))
    inside = member.join(family.select(F.col("node").alias("component"), F.col("component").alias("key")), "component")
    rows = _dealt(materialise(inside), block).join(signature, "doc_id").join(texts, "doc_id")
    return _together(rows).mapInArrow(_search(least, threshold), _PAIR)


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, block: int = BLOCK, min_estimate: float = MIN_ESTIMATE) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id, kept.

    Documents are linked with 100 * intersection >= threshold * union of their shingle sets; component_id is the smallest
    doc_id reachable, kept is true where it is the own one. Null and empty texts and white space have no shingles and are
    linked with nothing; texts of fewer than five words have one, the whole sequence. Texts are read whole. Rows that share
    a doc_id are one node of the graph, linked if one of their texts is; a null doc_id takes part in its class of equal
    words only. Other columns are ignored; an empty table gives an empty result.
    """
    sketch = materialise(sketches(docs))
    some = sketch.where("n_shingles > 0")
    classes = materialise(some.groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("rep")))  # apart from the join, which Spark can then split
    member = materialise(some.select("doc_id", "set_a", "set_b", "n_shingles").join(classes, ["set_a", "set_b", "n_shingles"]).select("doc_id", "n_shingles", "rep"))
    reps = some.join(member.where("doc_id = rep").select("doc_id").distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id", "set_a"])

    bucket = reps.select("doc_id", F.explode("bands").alias("key"))
    shared = bucket.groupBy("key").agg(F.min("doc_id").alias("pivot"), F.count("*").alias("n")).where("n > 1")
    multi = materialise(bucket.join(shared, "key"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = materialise(texts.join(multi.select("doc_id").distinct(), "doc_id", "left_semi"))

    best = multi.where("doc_id <> pivot").groupBy("doc_id", "pivot").agg(F.count("*").alias("common"))
    first = best.groupBy("doc_id").agg(F.max(F.struct("common", (-F.col("pivot")).alias("p"))).alias("top")).select((-F.col("top.p")).alias("a"), F.col("doc_id").alias("b"))
    first = materialise(first)
    # Every document has one partner here, with a smaller id: the links are a forest.
    label = chased(verified(first, texts, threshold).distinct().select(F.col("b").alias("node"), F.col("a").alias("parent")))
    label = merged(label, _residual_links(multi, reps, label, texts, threshold, block, min_estimate), "a", "b")
    joined = member.join(label, member["rep"] == label["node"], "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    alone = sketch.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return joined.union(alone).select("*", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:least(i + 4, len(w))], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
rare AS (SELECT s FROM shingles GROUP BY s HAVING count(*) > 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM (SELECT * FROM shingles SEMI JOIN rare USING (s)) a JOIN (SELECT * FROM shingles SEMI JOIN rare USING (s)) b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach AS (SELECT DISTINCT a AS doc_id, a AS other FROM links UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other),
least_id AS (SELECT doc_id, min(other) AS m FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, coalesce(m, d.doc_id) AS component_id, coalesce(m, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN least_id USING (doc_id)
"""
