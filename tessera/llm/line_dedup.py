"""Line deduplication by a deletion-neighbourhood join.

Lines are sequences of words, or, for the shorter ones, of characters (words with one space between). The edit bound is
one unit, if a line has at least WORDS_PER_EDIT words or CHARS_PER_EDIT characters for it: two lines are the same if
their words are equal; if both have WORDS_PER_EDIT words and one word inserted, deleted or replaced turns one into the
other; or else if both have CHARS_PER_EDIT characters and one character does. A line is dropped if a line that comes
earlier in the collection, by doc_id and line number, is the same.

The neighbourhood of a line is itself and its variants with one unit deleted, as hashed keys. Lines that differ by a
replacement share the variant at that position; a line with one unit more has a variant that is the shorter line. Per
key the earliest member is enough, a map-side combined minimum, so a line that a third of all documents has meets each
of its likes once. Every match found by keys is verified on the words; equal lines are told by a digest of 128 bits.

Only lines that can have a partner get a neighbourhood: of two lines at distance 1 one half is equal, so a hash of the
first or the last units (a number that doesn't exceed half) must occur in two different lines. This drops no pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import encoded, materialise, pieces, sided, table, written_table
from tessera.llm.shingles import mix64, word_hashes

#: Units that a line has for its one edit.
WORDS_PER_EDIT, CHARS_PER_EDIT = 8, 10

_LINES = "doc_id long, text_hash long, line int, a long, b long, halves array<long>"
_NEIGHBOURS = "doc_id long, text_hash long, line int, kind int, words string, whole long, variants array<long>"
_STEP = np.uint64(0x9E3779B97F4A7C15)


def words_of(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of lines (words with one space between, at least one), and the number of words of each."""
    joined = b" ".join(lines)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    return word_hashes(joined, np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(joined)]))), np.array([x.count(b" ") + 1 for x in lines], np.int64)


def characters_of(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all lines, and their number."""
    texts = [x.decode("utf-8") for x in lines]
    return np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.uint64), np.array([len(x) for x in texts], np.int64)


#: The kinds of units, and how many of them a line needs to have an edit.
_KINDS = ((words_of, WORDS_PER_EDIT), (characters_of, CHARS_PER_EDIT))


def has_kind(line: bytes, kind: int) -> bool:
    """Whether the line may be at distance 1 of another one over these units."""
    words = line.count(b" ") + 1
    if kind == 0:
        return words >= WORDS_PER_EDIT
    return words <= WORDS_PER_EDIT and len(line) >= CHARS_PER_EDIT and len(line.decode("utf-8")) >= CHARS_PER_EDIT


def half(units: np.ndarray) -> np.ndarray:
    """The units at either end that one of two lines at distance 1 shares, for the shorter one's length: from a coarse grid, at most (units - 1) / 2."""
    most = np.maximum((units - 1) // 2, 1)
    power = 1 << np.floor(np.log2(most)).astype(np.int64)
    return np.where(2 * most >= 3 * power, power + power // 2, power)


def _sums(units: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Sums of the units before each, every one mixed with its place."""
    out = np.zeros(len(units) + 1, np.uint64)
    np.cumsum(mix64(units ^ mix64(places * _STEP)), out=out[1:])
    return out


def halves_of(lines: list[bytes], kind: int) -> list[list[int]]:
    """Keys of the halves that a partner of each line may share: for partners as long as the line, and for shorter ones."""
    read, least = _KINDS[kind]
    units, count = read(lines)
    first = np.cumsum(count) - count
    inside = (np.arange(len(units)) - np.repeat(first, count)).astype(np.uint64)
    back = np.repeat(count, count).astype(np.uint64) - inside
    ahead, behind = (_sums(units, at) for at in (inside, back))
    out = []
    for m in (count, count - 1):
        n = np.minimum(half(np.maximum(m, 2)), count)
        salt = mix64((4 * n + kind).astype(np.uint64))
        last = first + count
        for k, sums in enumerate((ahead[first + n] - ahead[first], behind[last] - behind[last - n])):
            out.append(np.where(m >= least, mix64(sums + salt + np.uint64(2 * k)) | np.uint64(1), np.uint64(0)).view(np.int64))
    return [[k for k in dict.fromkeys(row) if k] for row in np.stack(out, axis=1).tolist()]


def _split(text: bytes) -> list[bytes]:
    return [b" ".join(x.split()) for x in text.split(b"\n")]


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per line that has words."""
    for batch in pieces(batches, "text"):
        lines, doc, number = [], [], []
        for i, text in enumerate(encoded(batch.column("text"))):
            for j, line in enumerate(_split(text)):
                if line:
                    lines.append(line)
                    doc.append(i)
                    number.append(j)
        if not lines:
            continue
        keys: list[list[int]] = [[] for _ in lines]
        for kind in (0, 1):
            chosen = [i for i, x in enumerate(lines) if has_kind(x, kind)]
            if chosen:
                for i, found in zip(chosen, halves_of([lines[i] for i in chosen], kind), strict=True):
                    keys[i] = keys[i] + found
        digest = np.frombuffer(b"".join(hashlib.blake2b(x, digest_size=16).digest() for x in lines), "<i8").reshape(-1, 2)
        taken = pa.array(doc, pa.int64())
        yield pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id").take(taken), "text_hash": batch.column("text_hash").take(taken), "line": pa.array(number, pa.int32()),
            "a": pa.array(digest[:, 0].copy()), "b": pa.array(digest[:, 1].copy()), "halves": pa.array(keys, pa.list_(pa.int64())),
        })


def neighbourhood(line: bytes, kind: int) -> tuple[int, list[int]]:
    """Keys of the line itself and of its variants without one unit, by position, in O(units): a unit after the gap counts as one place earlier."""
    units, _ = _KINDS[kind][0]([line])
    n = len(units)
    at = np.arange(n, dtype=np.uint64)
    here, earlier = (_sums(units, place) for place in (at, at - np.uint64(1)))
    salt = mix64(np.array([2 * n + kind, 2 * (n - 1) + kind], np.uint64))
    without = here[:n] + (earlier[n] - earlier[1:])
    return int(mix64(here[n:] + salt[0]).view(np.int64)[0]), mix64(without + salt[1]).view(np.int64).tolist()


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For the wanted lines of each text their words and keys."""
    for batch in pieces(batches, "text"):
        rows = []
        ids, hashes, wanted = (batch.column(c).to_pylist() for c in ("doc_id", "text_hash", "wanted"))
        for i, text in enumerate(encoded(batch.column("text"))):
            lines = text.split(b"\n")
            for j in wanted[i]:
                line = b" ".join(lines[j].split())
                rows += [(ids[i], hashes[i], j, kind, line.decode("utf-8"), *neighbourhood(line, kind)) for kind in (0, 1) if has_kind(line, kind)]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.list_(pa.int64()))
        names = ("doc_id", "text_hash", "line", "kind", "words", "whole", "variants")
        yield pa.RecordBatch.from_pydict({c: pa.array([r[i] for r in rows], k) for i, (c, k) in enumerate(zip(names, kinds, strict=True))})


def within_one(a: list[str] | str, b: list[str] | str) -> bool:
    """Whether the edit distance of two sequences is at most 1."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def same_line(x: str, y: str) -> bool:
    """Whether two lines (words with one space between) are the same."""
    a, b = x.split(" "), y.split(" ")
    if min(len(a), len(b)) >= WORDS_PER_EDIT:
        return within_one(a, b)
    return x == y or min(len(x), len(y)) >= CHARS_PER_EDIT and within_one(x, y)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [same_line(x, y) for x, y in zip(batch.column("words").to_pylist(), batch.column("other").to_pylist(), strict=True)]
        yield batch.select(["doc_id", "text_hash", "line"]).filter(pa.array(keep, pa.bool_()))


def _place() -> Column:
    """Orders lines; a null doc_id comes last."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "line")


def _repeated(lines: DataFrame) -> DataFrame:
    """doc_id, text_hash, line of exact repetitions. Counting takes numbers only; order inside one document is looked at where it matters."""
    doc = F.coalesce("doc_id", F.lit((1 << 63) - 1))
    groups = lines.groupBy("a", "b").agg(F.min(doc).alias("first_doc"), F.count("*").alias("n")).where("n > 1")
    met = lines.join(sided(groups.select("a", "b", "first_doc")), ["a", "b"]).select("a", "b", "doc_id", "text_hash", "line", (doc > F.col("first_doc")).alias("later"))
    met = materialise(met)  # where it is shuffled, Spark can split a line that very many documents have
    own = met.where("not later")
    first = own.groupBy("a", "b").agg(F.min(_place()).alias("at"))
    again = own.join(first, ["a", "b"]).where(_place() > F.col("at"))
    return met.where("later").select("doc_id", "text_hash", "line").union(again.select("doc_id", "text_hash", "line"))


def _near(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """doc_id, text_hash, line of first occurrences that have an earlier line at distance 1."""
    halves = lines.select("a", F.explode("halves").alias("key"))
    shared = halves.groupBy("key").agg(F.min("a").alias("lo"), F.max("a").alias("hi")).where("lo <> hi").select("key")
    hopeful = sided(halves.join(sided(shared), "key", "left_semi").select("a").distinct())
    first = lines.join(hopeful, "a", "left_semi").groupBy("a", "b").agg(F.min(_place()).alias("at"))
    wanted = first.groupBy("at.doc_id", "at.text_hash").agg(F.collect_list("at.line").alias("wanted"))
    wanted = sided(wanted.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "wanted"))
    met = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")))
    near = met.select("doc_id", "text_hash", "text", "wanted").mapInArrow(_neighbours, _NEIGHBOURS)
    near = written_table(near, "wanted")  # computed once: a range partitioning reads its input twice
    # Numbered in order: ids of later lines are larger.
    place = [F.col("doc_id").isNull(), F.col("doc_id"), F.col("text_hash"), F.col("line"), F.col("kind")]
    near = written_table(near.repartitionByRange(*place).sortWithinPartitions(*place).withColumn("id", F.monotonically_increasing_id()), "neighbourhoods")

    keys = near.select("id", F.posexplode("variants").alias("position", "key")).union(near.select("id", F.lit(-1), "whole"))
    # Earliest by key and position. Position -1 is the line itself: it meets the variants of longer lines at any position.
    least = materialise(keys.groupBy("key", "position").agg(F.min("id").alias("first"), F.max("id").alias("last")))
    replaced = least.where("position >= 0 and first < last").select("key", "position", "first")
    by_replacing = keys.join(sided(replaced), ["key", "position"]).where("first < id").select("id", "first")
    either = least.groupBy("key").agg(F.min(F.when(F.col("position") < 0, F.col("first"))).alias("whole"), F.min(F.when(F.col("position") >= 0, F.col("first"))).alias("part")).where("whole is not null and part is not null")
    by_deleting = keys.join(sided(either), "key").select("id", F.when(F.col("position") < 0, F.col("part")).otherwise(F.col("whole")).alias("first")).where("first < id")
    matches = by_replacing.union(by_deleting).distinct()
    # A repeated row has each line under two ids: a line isn't dropped for itself.
    words = near.select(F.col("id").alias("first"), F.col("words").alias("other"), F.col("doc_id").alias("other_doc"), F.col("text_hash").alias("other_hash"), F.col("line").alias("other_line"))
    pairs = matches.join(near.select("id", "doc_id", "text_hash", "line", "words"), "id").join(words, "first")
    pairs = pairs.where(~(F.col("doc_id").eqNullSafe(F.col("other_doc")) & (F.col("text_hash") == F.col("other_hash")) & (F.col("line") == F.col("other_line"))))
    return pairs.select("doc_id", "text_hash", "line", "words", "other").mapInArrow(_verify, "doc_id long, text_hash long, line int")


def dropped_lines(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, line (from 0) of every line that is dropped; docs has doc_id, text and text_hash."""
    lines = written_table(docs.select("doc_id", "text_hash", "text").mapInArrow(_describe, _LINES), "lines")
    return _repeated(lines).union(_near(docs, lines)).distinct()


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs, all rows and columns, with text replaced by the lines that stay, plus n_lines and n_dropped (long).

    Lines end with a line feed; a line without words is never dropped. The earliest line stays, by doc_id, then the text's
    hash, then line number; a null doc_id comes last. Rows with one doc_id and one text are one document and lose the same
    lines. A null text stays null, an empty one empty; a text that loses every line becomes empty; lines of any length
    are whole. Columns of docs named n_lines or n_dropped are replaced, all others kept. An empty table gives an empty result.
    """
    keep = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    docs = docs.select(*[F.col(f"`{c}`") for c in keep])
    hashed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("text_hash"))
    gone = dropped_lines(hashed).groupBy("doc_id", "text_hash").agg(F.collect_list("line").alias("__line_dedup_gone"))
    gone = gone.select(F.col("doc_id").alias("__line_dedup_d"), F.col("text_hash").alias("__line_dedup_h"), "__line_dedup_gone")
    met = docs.withColumn("__line_dedup_key", F.xxhash64("text")).join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col("__line_dedup_d")) & (F.col("__line_dedup_key") == F.col("__line_dedup_h")), "left")
    met = met.withColumn("__line_dedup_lines", F.split("text", "\n", -1))  # a column of its own: a text is split once
    lines = F.col("__line_dedup_lines")
    stay = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "__line_dedup_gone"), lambda i: F.get(lines, i))
    text = F.when(F.col("__line_dedup_gone").isNull(), F.col("text")).otherwise(F.array_join(stay, "\n"))
    count = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long")
    return met.select(*[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in keep], count.alias("n_lines"), F.coalesce(F.size("__line_dedup_gone"), F.lit(0)).cast("long").alias("n_dropped"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP1_SQL = r"""
WITH raw AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents),
numbered AS (SELECT doc_id, unnest(range(0, len(parts))) AS line, unnest(parts) AS s FROM raw),
lines AS (
  SELECT doc_id, line, w FROM (SELECT doc_id, line, [x FOR x IN regexp_split_to_array(s, '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM numbered) WHERE len(w) > 0),
firsts AS (SELECT w, min({'d': doc_id, 'l': line}) AS place FROM lines GROUP BY w),
exact AS (SELECT l.doc_id, l.line FROM lines l JOIN firsts f ON l.w = f.w WHERE {'d': l.doc_id, 'l': l.line} > f.place),
units AS (
  SELECT 'w' AS kind, w AS u, place FROM firsts WHERE len(w) >= 8
  UNION ALL SELECT 'c', string_split(array_to_string(w, ' '), ''), place FROM firsts WHERE len(w) <= 8 AND length(array_to_string(w, ' ')) >= 10),
variants AS (
  SELECT kind, len(u) AS n, place, p, array_to_string(u[1:p - 1] || u[p + 1:], chr(1)) AS key
  FROM (SELECT kind, u, place, unnest(range(1, len(u) + 1)) AS p FROM units)),
replaced AS (SELECT place, min(place) OVER (PARTITION BY kind, key, p, n) AS other FROM variants),
wholes AS (SELECT kind, len(u) AS n, place, array_to_string(u, chr(1)) AS key FROM units),
deleted AS (SELECT v.place AS long_at, x.place AS short_at FROM variants v JOIN wholes x ON x.kind = v.kind AND x.key = v.key AND x.n = v.n - 1),
near AS (
  SELECT place FROM replaced WHERE other < place
  UNION SELECT long_at FROM deleted WHERE short_at < long_at
  UNION SELECT short_at FROM deleted WHERE long_at < short_at),
gone AS (SELECT doc_id, list(line) AS lines FROM (SELECT * FROM exact UNION SELECT place.d, place.l FROM near) GROUP BY doc_id)
SELECT r.doc_id,
       CASE WHEN g.doc_id IS NULL THEN r.text ELSE array_to_string([r.parts[i + 1] FOR i IN range(0, len(r.parts)) IF NOT list_contains(g.lines, i)], chr(10)) END AS text,
       coalesce(len(r.parts), 0)::BIGINT AS n_lines, coalesce(len(g.lines), 0)::BIGINT AS n_dropped
FROM raw r LEFT JOIN gone g ON g.doc_id = r.doc_id
"""
