"""Document fingerprints by consistent weighted sampling (DataFrame functions only).

A document is a set of words with their numbers of occurrences as weights. For each of SAMPLES samples every word gets
r and c from Gamma(2, 1) and b from the uniform distribution, by hashing word and sample; with weight w,
t = floor(ln w / r + b), y = exp(r (t - b)) and a = c / (y exp(r)). The word with the least a, together with its t, is the
sample. Two documents agree in a sample with a probability equal to their generalised Jaccard similarity
(sum of minima over sum of maxima of the weights), so the share of equal samples estimates it.

A text is split where it lies: rows are partitioned by document once, and counting words and taking minima need no
further shuffle. A word with one weight in a document and its edited text is sampled once. A minimum is of one long, ln a in the upper half and the sampled word's hash in the lower, so it is
a fixed-width aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.shared import materialise, table

#: Samples of a fingerprint, 32 bits each.
SAMPLES = 48

_WHITE = r"[\x20\x09-\x0D]+"


def _uniform(h: Column, shift: int, bits: int) -> Column:
    """So many bits of a hash as a number between 0 and 1, both excluded."""
    return (F.shiftrightunsigned(h, shift).bitwiseAND((1 << bits) - 1) + 0.5) * (1.0 / (1 << bits))


def sample(term: Column, log_weight: Column, number: int) -> Column:
    """ln a (31 bits, order kept) and the hash of the sampled pair (term, t) in one long. One hash gives r and c, each from two uniform numbers, and b."""
    h = F.xxhash64(term, F.lit(number))
    r = -F.log(_uniform(h, 53, 11) * _uniform(h, 42, 11))
    log_c = F.log(-F.log(_uniform(h, 29, 13) * _uniform(h, 16, 13)))
    b = _uniform(h, 0, 16)
    t = F.floor(log_weight / r + b)
    log_a = log_c - r * (t - b) - r
    rank = F.least(F.greatest(((log_a + 96) * (1 << 24)).cast("long"), F.lit(0)), F.lit((1 << 31) - 1))
    return F.shiftleft(rank, 32).bitwiseOR(h.bitwiseXOR(t * 2654435761).bitwiseAND(0xFFFFFFFF))


def signatures(rows: DataFrame, keys: list[str], texts: list[str], samples: int = SAMPLES) -> DataFrame:
    """keys and, for each column of texts, an array of 32-bit samples of the same name, null for a text without words.

    rows is partitioned by some of keys, which together are unique. Texts without words only give no row. A word that has
    one weight in several texts is sampled once for them: least values are taken per set of texts (owners, a bit each),
    then per text.
    """
    sides = F.explode(F.array(*[F.struct(F.lit(i).alias("side"), F.col(t).alias("t")) for i, t in enumerate(texts)]))
    words = rows.select(*keys, sides.alias("s")).select(*keys, "s.side", F.explode(F.split("s.t", _WHITE)).alias("word")).where("word <> ''")
    n = range(len(texts))
    weighted = words.groupBy(*keys, F.xxhash64("word").alias("term")).agg(*[F.count_if(F.col("side") == i).alias(f"w{i}") for i in n])
    each = weighted.withColumn("side", F.explode(F.array(*map(F.lit, n))))
    w = F.lit(0).cast("long")
    for i in n:
        w = F.when(F.col("side") == i, F.col(f"w{i}")).otherwise(w)
    owners, earlier = F.lit(0), F.lit(False)
    for i in n:
        owners = owners + F.when(F.col(f"w{i}") == F.col("w"), 1 << i).otherwise(0)
        earlier = earlier | ((F.col(f"w{i}") == F.col("w")) & (F.col("side") > i))
    each = each.withColumn("w", w).where((F.col("w") > 0) & ~earlier).select(*keys, owners.alias("owners"), "term", F.log("w").alias("log_w"))
    least = each.groupBy(*keys, "owners").agg(*[F.min(sample(F.col("term"), F.col("log_w"), d)).alias(f"m{d}") for d in range(samples)])
    owned = least.groupBy(*keys).agg(*[F.min(F.when(F.col("owners").bitwiseAND(1 << i) != 0, F.col(f"m{d}"))).alias(f"m{d}_{i}") for i in n for d in range(samples)])
    made = [F.when(F.col(f"m0_{i}").isNotNull(), F.array(*[F.col(f"m{d}_{i}").bitwiseAND(0xFFFFFFFF) for d in range(samples)])).alias(t) for i, t in enumerate(texts)]
    return owned.select(*keys, *made)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples; 1 for two texts without words, 0 for one of them."""
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.size(a)
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(equal)


def written(a: Column) -> Column:
    """A fingerprint as text: eight hexadecimal digits a sample, empty for texts without words."""
    return F.coalesce(F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), ""), F.lit(""))


def following(ids: DataFrame) -> DataFrame:
    """ids with next_id and next_h: the next document by descending (doc_id, h); after the last comes the first. Both are unique together.

    Ranges of ids, then the next row inside a range; only the first of each range is looked at globally.
    """
    order = [F.col("doc_id").desc(), F.col("h").desc()]
    ranged = materialise(ids.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    heads = ranged.groupBy("part").agg(F.max(F.struct("doc_id", "h")).alias("head"))
    after = Window.orderBy("part")
    ends = heads.select(F.col("part").alias("p"), F.coalesce(F.lead("head").over(after), F.first("head").over(after)).alias("wrap"))
    inside = ranged.withColumn("next", F.lead(F.struct("doc_id", "h")).over(Window.partitionBy("part").orderBy(*order)))
    joined = inside.join(ends, inside["part"] == ends["p"]).withColumn("next", F.coalesce("next", "wrap"))
    return joined.select(*ids.columns, F.col("next.doc_id").alias("next_id"), F.col("next.h").alias("next_h"))


#: Takes the place of a null doc_id inside: it comes last.
_NO_ID = -(1 << 63)


def fingerprint_edits(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last half of its code points, rounded down, replaced by as many (or all) of the next document
    by descending doc_id, then descending hash of the text; rows that are equal in both follow each other. Null texts are
    empty; an empty text, or one of white space, has an empty fingerprint, which is like another empty one only. A null
    doc_id comes last. A single document follows itself. Texts are read whole. Other columns are ignored; an empty table
    gives an empty result.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID).cast("long"))
    rows = docs.select(key.alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    # The order of ids needs no texts, so texts are shuffled once. Of equal rows the last is followed by the next
    # document, the others (again: how many) by their like.
    chosen = rows.select("doc_id", "h", F.length("text").cast("long").alias("n")).groupBy("doc_id", "h").agg(F.first("n").alias("n"), F.count("*").alias("rows"))
    order = materialise(following(chosen))
    own = rows.groupBy("doc_id", "h").agg(F.first("text").alias("text"))
    half = (F.col("n") / 2).cast("int").alias("k")
    last = order.select(F.col("next_id").alias("doc_id"), F.col("next_h").alias("h"), F.col("doc_id").alias("to_id"), F.col("h").alias("to_h"), half, F.lit(1).cast("long").alias("rows"))
    again = order.where("rows > 1").select("doc_id", "h", F.col("doc_id").alias("to_id"), F.col("h").alias("to_h"), half, (1 - F.col("rows")).alias("rows"))
    heads = own.join(last.union(again), ["doc_id", "h"]).select(F.col("to_id").alias("doc_id"), F.col("to_h").alias("h"), "rows", F.expr("substring(text, 1, k)").alias("head"))
    both = own.join(heads, ["doc_id", "h"]).withColumn("n", F.length("text"))
    both = both.select("doc_id", "h", "rows", F.col("text").alias("a"), F.expr("concat(substring(text, 1, n - n div 2), head)").alias("b"), "n")
    keys = ["doc_id", "h", "rows"]  # rows: 1, or less than 0 for those that are followed by their like
    facts = both.select(*keys, F.col("n").cast("long").alias("n_chars"), F.sha2(F.col("b").cast("binary"), 256).alias("edited_sha256"))
    prints = signatures(both, keys, ["a", "b"], samples).withColumnsRenamed({"doc_id": "of_id", "h": "of_h", "rows": "of_rows"})
    # The third key is compared, not joined on: both sides lie by the first two already.
    known = facts.join(prints, (F.col("doc_id") == F.col("of_id")) & (F.col("h") == F.col("of_h")) & (F.col("rows") - F.col("of_rows") == 0), "left")
    known = materialise(known.drop("of_id", "of_h", "of_rows"))
    next_print = known.where("rows = 1").select(F.col("doc_id").alias("next_id"), F.col("h").alias("next_h"), F.col("a").alias("c"))
    joined = known.join(order.select("doc_id", "h", "next_id", "next_h"), ["doc_id", "h"])
    to_like = F.col("rows") < 0
    joined = joined.withColumn("next_id", F.when(to_like, F.col("doc_id")).otherwise(F.col("next_id"))).withColumn("next_h", F.when(to_like, F.col("h")).otherwise(F.col("next_h")))
    joined = joined.join(next_print, ["next_id", "next_h"]).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.abs("rows"))))
    return joined.select(F.nullif("doc_id", F.lit(_NO_ID).cast("long")).alias("doc_id"), "n_chars", "edited_sha256", written(F.col("a")).alias("fingerprint"), written(F.col("b")).alias("edited_fingerprint"), likeness(F.col("a"), F.col("b")).alias("near_edited"), likeness(F.col("a"), F.col("c")).alias("near_next"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))
