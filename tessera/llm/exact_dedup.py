"""Exact deduplication by an extendible-hash index on shared files.

Texts are equal when they are identical without ASCII white space. The first 64 bits of that form's SHA-256 are the key. Owner tasks get
ranges of keys (their leading bits) in key order and load the index in bulk: a bucket that holds more than its
capacity splits on the next bit of its keys, and where a bucket needs more bits than the owner's directory has, the
directory doubles. Texts with one key form a chain and are told apart by comparing bytes.

The index is three tables in the shared folder: the owners with the bits of their directories, the directories (slot ->
bucket), and the buckets' entries (key, digest, the row that stays, size of the group). Every row finds its group by a
probe: the leading bits of its key name the owner, the next ones the slot, the slot the bucket, and in the bucket key and
digest name the entry. save() and load() keep an index for later batches, which probe it the same way.

A hot group is folded before the shuffle: each piece of a batch sends one text per distinct content with the count and the
best row, and of a long text a task sends the bytes once, so an owner gets few copies. Probes carry no texts, and
adaptive execution splits them where a group is large.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import PIECE_BYTES, encoded, pieces, sided, table, text_or_empty, written_table

#: Entries of a bucket before it splits.
BUCKET_ENTRIES = 4096
#: Rows of an owner, which bounds a task's memory, and the least bits that name one: ranges are dealt to as many tasks as the shuffle has.
OWNER_ROWS, OWNER_BITS = 1 << 18, 10
#: Bits of an owner's directory at most; a bucket that would need more keeps all its entries.
MAX_DIRECTORY_BITS = 20

_WHITE = b" \t\n\x0b\x0c\r"
_LOCAL = "key long, digest string, form string, best_chars long, best_id long, copies long"
_LOADED = "owner int, bits int, slot long, slots long, bucket long, key long, digest string, keep_id long, group_size long"


def _keyed(forms: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            squeezed = [x.translate(None, _WHITE) for x in encoded(batch.column("text"))]
            hashed = [hashlib.sha256(x) for x in squeezed]
            columns = {"doc_id": batch.column("doc_id"), "n": batch.column("n"), "form": pa.array(squeezed if forms else [], pa.string()), "digest": pa.array([x.hexdigest() for x in hashed], pa.string()), "key": pa.array([int.from_bytes(x.digest()[:8], "big", signed=True) for x in hashed], pa.int64())}
            del squeezed, hashed  # a long text has few copies while the batch is read
            yield pa.RecordBatch.from_pydict({k: v for k, v in columns.items() if forms or k != "form"})

    return run


def texts(docs: DataFrame) -> DataFrame:
    """doc_id, n (code points), text; texts that are null count as empty."""
    text = text_or_empty()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.length(text).cast("long").alias("n"), F.make_valid_utf8(text).alias("text"))


def keyed(docs: DataFrame, forms: bool = True) -> DataFrame:
    """doc_id, n, form (text without white space; not with forms=False), digest, key.

    Bytes are deleted and hashed in Python: translate() and replace() leave several times the texts as garbage on the heap.
    """
    return texts(docs).mapInArrow(_keyed(forms), f"doc_id long, n long,{' form string,' * forms} digest string, key long")


def _better(n: int, doc_id: int | None, best: list) -> bool:
    return (n, doc_id is not None, -(doc_id or 0)) > (best[0], best[1] is not None, -(best[1] or 0))


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each piece of a batch one row per distinct form; a long form only the first time, then its digest stands for it."""
    sent: set[str] = set()
    for batch in pieces(batches, "form"):
        seen: dict[str, list] = {}
        for doc_id, n, form, digest, key in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "form", "digest", "key")), strict=True):
            held = seen.setdefault(form, [n, doc_id, 0, digest, key])
            held[2] += 1
            if _better(n, doc_id, held):
                held[:2] = n, doc_id
        rows = []
        for form, v in seen.items():
            long = len(form) > PIECE_BYTES // 4
            rows.append((None if long and v[3] in sent else form, v))
            if long:
                sent.add(v[3])
        yield pa.RecordBatch.from_pydict({
            "key": pa.array([v[4] for _, v in rows], pa.int64()), "digest": pa.array([v[3] for _, v in rows], pa.string()), "form": pa.array([k for k, _ in rows], pa.string()),
            "best_chars": pa.array([v[0] for _, v in rows], pa.int64()), "best_id": pa.array([v[1] for _, v in rows], pa.int64()), "copies": pa.array([v[2] for _, v in rows], pa.int64()),
        })


def split_buckets(keys: list[int], prefix: int, bits: int, capacity: int, most: int = 64) -> list[tuple[int, int, int, int]]:
    """(prefix, bits, start, end) of the buckets of sorted unsigned 64-bit keys; equal keys are a chain and never split, and no bucket has more than most bits."""
    out, work = [], [(prefix, bits, 0, len(keys))]
    while work:
        prefix, bits, start, end = work.pop()
        if end - start <= capacity or bits == most or keys[start] == keys[end - 1]:
            out.append((prefix, bits, start, end))
            continue
        low, middle = ((prefix << 1) | 1) << (63 - bits), start
        step = end
        while middle < step:  # the first key of the upper half
            half = (middle + step) // 2
            if keys[half] < low:
                middle = half + 1
            else:
                step = half
        work += [((prefix << 1) | 1, bits + 1, middle, end), (prefix << 1, bits + 1, start, middle)]
    return sorted(out)


def _own(capacity: int, owner_bits: int):
    def flush(owner: int, entries: list) -> pa.RecordBatch:
        keys = [e[0] for e in entries]
        buckets = split_buckets(keys, owner, owner_bits, capacity, owner_bits + MAX_DIRECTORY_BITS)
        bits = max(b[1] for b in buckets) - owner_bits
        rows = []
        for prefix, own, start, end in buckets:
            free = owner_bits + bits - own  # bits of the directory that don't matter for the bucket
            slot = (prefix << free) & ((1 << bits) - 1)
            place = (owner, bits, slot, 1 << free, (1 << own) | prefix)
            rows += [(*place, *e) for e in entries[start:end]] or [(*place, None, None, None, None)]
        signed = lambda v: None if v is None else v - (1 << 64) if v >= 1 << 63 else v
        columns = list(zip(*rows, strict=True))
        columns[5] = tuple(map(signed, columns[5]))
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in _LOADED.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, entries, key, chain, later = -1, [], None, {}, []

        def add(held: list, n: int, doc_id: int | None, copies: int) -> None:
            held[2] += copies
            if held[0] < 0 or _better(n, doc_id, held):
                held[:2] = n, doc_id

        def end_chain() -> None:
            by_digest = {digest: held for digest, held in chain.values()}
            for digest, *row in later:
                add(by_digest[digest], *row)
            entries.extend((key, digest, held[1], held[2]) for digest, held in chain.values())
            chain.clear()
            later.clear()

        for batch in pieces(batches, "form"):
            for k, digest, form, n, doc_id, copies in zip(*(batch.column(c).to_pylist() for c in ("key", "digest", "form", "best_chars", "best_id", "copies")), strict=True):
                k &= (1 << 64) - 1
                if k != key:
                    end_chain()
                    if k >> (64 - owner_bits) != owner:
                        if entries:
                            yield flush(owner, entries)
                        owner, entries = k >> (64 - owner_bits), []
                    key = k
                if form is None:
                    later.append((digest, n, doc_id, copies))
                else:
                    add(chain.setdefault(form, (digest, [-1, None, 0]))[1], n, doc_id, copies)  # a lookup compares the whole text
        end_chain()
        if entries:
            yield flush(owner, entries)

    return run


@dataclass
class Index:
    """owners: owner, bits. directory: owner, slot, bucket. entries: bucket, key, digest, keep_id, group_size."""

    owner_bits: int
    owners: DataFrame
    directory: DataFrame
    entries: DataFrame

    def probe(self, rows: DataFrame, how: str = "inner") -> DataFrame:
        """rows (key, digest, ...) with keep_id and group_size of their entry; how="left" keeps rows without one."""
        owner = F.shiftrightunsigned("key", 64 - self.owner_bits).cast("int")
        found = rows.withColumn("owner", owner).join(sided(self.owners), "owner", how)
        # The bits of the key that follow the owner's; none where the directory has a single slot.
        slot = F.when(F.col("bits") == 0, F.lit(0)).otherwise(F.expr(f"shiftrightunsigned(shiftleft(key, {self.owner_bits}), 64 - bits)")).cast("long")
        found = found.withColumn("slot", slot).drop("bits").join(sided(self.directory), ["owner", "slot"], how).drop("owner", "slot")
        return found.join(self.entries, ["bucket", "key", "digest"], how).drop("bucket")

    def save(self, path: str) -> None:
        """Writes the index to a folder, under the name of its keys, so that load() never probes an index of other keys."""
        for name in ("owners", "directory", "entries"):
            getattr(self, name).write.parquet(f"{path}/sha256-{self.owner_bits}/{name}")

    @staticmethod
    def load(spark: SparkSession, path: str, owner_bits: int = OWNER_BITS) -> Index:
        return Index(owner_bits, *(spark.read.parquet(f"{path}/sha256-{owner_bits}/{name}") for name in ("owners", "directory", "entries")))


def build_index(rows: DataFrame, bucket_entries: int = BUCKET_ENTRIES, owner_bits: int = OWNER_BITS) -> Index:
    """The index of keyed() rows, or of texts(), which are keyed and folded in one pass; one entry per distinct text."""
    key = _keyed(forms=True)
    folded = rows.mapInArrow(_fold if "form" in rows.columns else lambda batches: _fold(key(batches)), _LOCAL)
    owner = F.shiftrightunsigned("key", 64 - owner_bits)
    ordered = folded.repartition(owner).sortWithinPartitions(owner, F.shiftrightunsigned("key", 1), F.col("key").bitwiseAND(1))
    # Entries are a small part of the texts: gathered by bucket, they take fewer files than there are owner tasks.
    loaded = written_table(ordered.mapInArrow(_own(bucket_entries, owner_bits), _LOADED).hint("rebalance", F.col("bucket")), "buckets")
    owners = loaded.select("owner", "bits").distinct()
    directory = loaded.select("owner", "slot", "slots", "bucket").distinct().select("owner", "bucket", F.explode(F.sequence(F.col("slot"), F.col("slot") + F.col("slots") - 1)).alias("slot"))
    return Index(owner_bits, written_table(owners, "owners"), written_table(directory.select("owner", "slot", "bucket"), "directory"), loaded.where("key is not null").select("bucket", "key", "digest", "keep_id", "group_size"))


def exact_duplicates(docs: DataFrame, bucket_entries: int = BUCKET_ENTRIES, owner_bits: int | None = None) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    The row with the most code points stays, then the smallest doc_id; a null doc_id comes last. Null and empty texts
    and texts of white space are equal. Rows that repeat a doc_id with one text are members of the group each, and all
    rows of the id that stays are marked. Texts of any length are whole. owner_bits: from the number of rows, unless
    given. Other columns are ignored; an empty table gives an empty result.
    """
    bits = owner_bits or max(OWNER_BITS, math.ceil(math.log2(max(docs.count(), 1) / OWNER_ROWS)))
    found = build_index(texts(docs), bucket_entries, bits).probe(keyed(docs, forms=False).select("doc_id", "key", "digest"))
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH forms AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
groups AS (SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM forms WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256 FROM groups
"""
