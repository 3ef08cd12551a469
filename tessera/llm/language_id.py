"""Language identification by Bayesian evidence fusion.

The posterior of a language is the product of four pieces of evidence: the text's likelihood under a byte-trigram model
of the language, the declared language of the record or its markup, the suffix of its address, and a prior of its host.

The text models are fitted on a bounded sample of rows with a declared language (TRAIN_DOCS of each). All other counts
are grouped aggregates over all rows, by the language that the text alone suggests: how often rows of a language declare
each language, how often they lie under each suffix, and the languages of every host. Host priors are smoothed
hierarchically: a host borrows from its domain, the domain from all rows. Evidence that a row lacks is left out.

Texts are read three times, whatever the number of languages: to count declarations, to take the sample, and for their
likelihoods. What is shuffled afterwards are ids and a likelihood per language.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.shared import encoded, materialise, pieces, table
from tessera.llm.url_filters import url_host

#: The bound of the training sample: documents of each declared language.
TRAIN_DOCS = 400
#: A language needs so many declared rows to be known, and is among the most frequent, so that the model is bounded.
MIN_DECLARED, MAX_LANGUAGES = 5, 256
#: Trigrams are hashed to so many bits.
BITS = 16
#: Pseudo-counts: of a trigram, of a declaration or suffix, of the parent in a host's prior.
TRIGRAM_COUNT, EVIDENCE_COUNT, PARENT_COUNT = 0.05, 1.0, 10.0
#: Independent trigrams that a long text counts as at most (n trigrams count as n / (1 + n / INDEPENDENT)): neighbouring trigrams tell the same.
INDEPENDENT = 200.0
#: Below this posterior a row is rejected.
MIN_POSTERIOR = 0.5
#: No language: every trigram is equally likely. Its prior odds.
UNKNOWN, UNKNOWN_PRIOR = "und", 1e-3


@dataclass
class TextModel:
    """Log-probabilities of hashed trigrams, a column per language; the last column is UNKNOWN."""

    languages: list[str]
    log_p: np.ndarray


def _trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of all texts and where those of each begin. A-Z count as a-z, digits and ASCII marks as one space."""
    joined = b"".join(b"  " + t + b" " for t in texts)
    data = _FOLD[np.frombuffer(joined, np.uint8)].astype(np.uint32)
    hashed = (data[:-2] * np.uint32(0x9E3779B1) + data[1:-1] * np.uint32(0x85EBCA77) + data[2:] * np.uint32(0xC2B2AE3D)) if len(data) > 2 else np.empty(0, np.uint32)
    hashed ^= hashed >> np.uint32(15)
    hashed *= np.uint32(0x2C1B3C6D)
    blank = (data[:-2] == 32) & (data[1:-1] == 32) & (data[2:] == 32)
    return np.where(blank, np.int64(-1), (hashed >> np.uint32(32 - BITS)).astype(np.int64)), np.concatenate(([0], np.cumsum([len(t) + 3 for t in texts])))


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def _letters(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    grams, bounds = _trigrams(texts)
    bounds[1:] -= 2  # the trigrams that would reach into the next text
    for b in bounds[1:-1]:
        grams[b : b + 2] = -1
    return grams, np.concatenate((bounds[:1], bounds[1:-1] + 2, bounds[-1:]))


def fit_text(rows: DataFrame, train_docs: int = TRAIN_DOCS) -> TextModel:
    """rows: text, declared. Languages are those that at least MIN_DECLARED rows declare, the MAX_LANGUAGES most frequent ones.

    The sample of a language are its train_docs distinct texts with the least hashes. Where fewer than half of the rows
    are distinct, it may be smaller, as twice the share of rows that gives so many is looked at.
    """
    named = rows.where("declared is not null and declared <> '' and text is not null and text <> ''")
    counted = named.groupBy("declared").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_DECLARED).orderBy(F.desc("n"), "declared").limit(MAX_LANGUAGES)
    counted = materialise(counted)
    known = sorted(r["declared"] for r in counted.collect())
    # One pass: texts whose hash is among the first are read with them; twice the share that is needed, and the least of those.
    share = F.least(F.lit(1.0), (2 * train_docs + 50) / F.col("n"))
    hashed = named.select("declared", "text", F.xxhash64("text").alias("h")).join(F.broadcast(counted), "declared")
    likely = hashed.where(F.pmod("h", F.lit(1 << 40)) < share * (1 << 40)).dropDuplicates(["declared", "h"])
    rank = F.row_number().over(Window.partitionBy("declared").orderBy(F.pmod("h", F.lit(1 << 40)), "h"))
    sample = likely.withColumn("rank", rank).where(F.col("rank") <= train_docs).select("declared", "text")
    width = 1 << BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in pieces(batches, "text"):
            for name, text in zip(batch.column("declared").to_pylist(), encoded(batch.column("text")), strict=True):
                grams, _ = _letters([text])
                seen = np.bincount(grams[grams >= 0], minlength=width)
                total[name] = total[name] + seen if name in total else seen
        yield pa.RecordBatch.from_pydict({"declared": pa.array(list(total), pa.string()), "counts": pa.array([c.astype("<i8").tobytes() for c in total.values()], pa.binary())})

    counts = {x: np.zeros(width) for x in known}
    for r in sample.mapInArrow(count, "declared string, counts binary").toLocalIterator():  # at most a row per language and task
        counts[r["declared"]] += np.frombuffer(bytes(r["counts"]), "<i8")
    columns = [np.log((counts[x] + TRIGRAM_COUNT) / (counts[x] + TRIGRAM_COUNT).sum()) for x in known]
    return TextModel([*known, UNKNOWN], np.stack([*columns, np.full(width, -np.log(width))], axis=1).astype(np.float32))


def _likelihoods(model: TextModel, ids: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            grams, bounds = _letters(encoded(batch.column("text")))
            valid = np.concatenate(([0], np.cumsum(grams >= 0)))
            used = grams[grams >= 0]
            first, last = valid[bounds[:-1]], valid[bounds[1:]]
            n = (last - first).astype(np.float64)
            logs = np.empty((len(n), model.log_p.shape[1]))
            for c in range(logs.shape[1]):
                sums = np.concatenate(([0.0], np.cumsum(model.log_p[used, c], dtype=np.float64)))
                logs[:, c] = sums[last] - sums[first]
            logs /= (1 + n / INDEPENDENT)[:, None]
            prior = np.zeros(logs.shape[1])
            prior[-1] = np.log(UNKNOWN_PRIOR)
            best = [model.languages[i] if k else None for i, k in zip((logs + prior).argmax(axis=1).tolist(), n.tolist(), strict=True)]
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in (*ids, "declared", "suffix", "host", "domain")} | {"n_trigrams": pa.array(n.astype(np.int64)), "text_lang": pa.array(best, pa.string()), "text_logs": pa.array(list(logs), pa.list_(pa.float64()))})

    return run


def _named_counts(model: TextModel, wide: DataFrame, key: str) -> DataFrame:
    """key, c: how many rows of each language have this key."""
    by = wide.where(F.col(key).isNotNull() & F.col("text_lang").isNotNull()).groupBy(key)
    return by.agg(*[F.sum(F.when(F.col("text_lang") == x, 1.0).otherwise(0.0)).alias(f"l{i}") for i, x in enumerate(model.languages)])


def identify(rows: DataFrame, ids: Sequence[str], text: Column, declared: Column, model: TextModel | None = None, url: Column | None = None, host: Column | None = None, min_posterior: float = MIN_POSTERIOR, languages: Sequence[str] | None = None) -> DataFrame:
    """One row per row of rows: the ids, lang, posterior, text_lang, declared, accepted.

    text, declared, url and host say where the evidence is; host is the url's if it isn't given. A row is accepted if its
    text has letters, a language (one of languages, if given) is more likely than UNKNOWN and all others, and its
    posterior is at least min_posterior. Null or empty texts, and texts without letters, are not accepted; their lang is
    what the other evidence says. Nulls elsewhere are missing evidence. Ties: the first language by name. Repeated rows are
    judged alike. Texts are read whole. Without any known language every row is UNKNOWN. An empty table gives an empty result.
    """
    none = F.lit(None).cast("string")
    at = host if host is not None else (F.when(url_host(url) != "", url_host(url)) if url is not None else none)
    labels = F.split(F.col("host"), r"\.")
    base = rows.select(*[F.col(f"`{c}`") for c in ids], text.cast("string").alias("text"), F.nullif(F.substring_index(F.lower(declared.cast("string")), "-", 1), F.lit("")).alias("declared"), at.cast("string").alias("host"))
    suffix = F.when(F.size(labels) > 1, F.element_at(labels, -1)) if url is not None else none
    base = base.withColumn("suffix", suffix).withColumn("domain", F.when(F.size(labels) > 2, F.concat_ws(".", F.element_at(labels, -2), F.element_at(labels, -1))).otherwise(F.col("host")))
    model = model or fit_text(base)
    n = len(model.languages)
    kinds = {f.name: f.dataType.simpleString() for f in base.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (*ids, "declared", "suffix", "host", "domain")) + ", n_trigrams long, text_lang string, text_logs array<double>"
    seen = materialise(base.mapInArrow(_likelihoods(model, ids), schema))

    counts = [F.col(f"l{i}") for i in range(n)]
    total = seen.where("text_lang is not null").agg(*[F.coalesce(F.sum(F.when(F.col("text_lang") == x, 1.0).otherwise(0.0)), F.lit(0.0)).alias(f"l{i}") for i, x in enumerate(model.languages)]).first()
    overall = np.array([total[i] + EVIDENCE_COUNT for i in range(n)])
    share = overall / overall.sum()

    def given_language(key: str) -> DataFrame:
        """log P(key | language) as an array."""
        logs = F.array(*[F.log((c + EVIDENCE_COUNT) / F.lit(float(total[i] + 20 * EVIDENCE_COUNT))) for i, c in enumerate(counts)])
        return _named_counts(model, seen, key).select(F.col(key), logs.alias(f"{key}_logs"))

    domains = _named_counts(model, seen, "domain")
    size = sum(counts[1:], counts[0])
    domain_prior = domains.select("domain", F.array(*[(c + PARENT_COUNT * float(share[i])) / (size + PARENT_COUNT) for i, c in enumerate(counts)]).alias("domain_p"))
    hosts = _named_counts(model, seen.withColumn("pair", F.struct("host", "domain")).where("host is not null"), "pair").join(domain_prior, F.col("pair.domain") == F.col("domain"))
    host_prior = hosts.select(F.col("pair.host").alias("host"), F.array(*[F.log((c + PARENT_COUNT * F.get("domain_p", F.lit(i))) / (size + PARENT_COUNT)) for i, c in enumerate(counts)]).alias("host_logs"))

    joined = seen.join(given_language("declared"), "declared", "left").join(given_language("suffix"), "suffix", "left").join(host_prior, "host", "left")
    zero = F.array(*[F.lit(0.0)] * n)
    plain = F.array(*[F.lit(float(np.log(p))) for p in share])
    logs = [F.get("text_logs", F.lit(i)) + F.get(F.coalesce("declared_logs", zero), F.lit(i)) + F.get(F.coalesce("suffix_logs", zero), F.lit(i)) + F.get(F.coalesce("host_logs", plain), F.lit(i)) for i in range(n)]
    scored = joined.withColumn("logs", F.array(*logs)).withColumn("top", F.array_max("logs"))
    scored = scored.withColumn("posterior", 1 / F.aggregate(F.transform("logs", lambda x: F.exp(x - F.col("top"))), F.lit(0.0), lambda a, x: a + x))
    scored = scored.withColumn("lang", F.get(F.array(*[F.lit(x) for x in model.languages]), F.array_position("logs", F.col("top")).cast("int") - 1))
    allowed = F.col("lang").isin(list(languages)) if languages is not None else F.col("lang") != UNKNOWN
    accepted = (F.col("n_trigrams") > 0) & allowed & (F.col("posterior") >= min_posterior)
    return scored.select(*[F.col(f"`{c}`") for c in ids], "lang", "posterior", "text_lang", "declared", accepted.alias("accepted"))


def visible_text(html: Column) -> Column:
    """Text of a page: without scripts, styles, comments and tags."""
    bare = F.regexp_replace(html, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<[^>]*>", " ")
    return F.regexp_replace(bare, r"&[a-zA-Z]+;|&#[0-9]+;", " ")


def markup_language(html: Column) -> Column:
    return F.nullif(F.regexp_extract(html, r"(?is)<html\b[^>]*\blang\s*=\s*[\"']?([a-zA-Z]+)", 1), F.lit(""))


def identify_documents(docs: DataFrame, key: Column | None = None) -> DataFrame:
    """identify() for documents: the record declares a language, its source is the host. doc_id (and key, if given) with the result."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (key if key is not None else F.lit(0).cast("long")).alias("text_key"), "text", "lang", "source")
    return identify(rows, ["doc_id", "text_key"], F.col("text"), F.col("lang"), host=F.col("source"))


def identify_pages(pages: DataFrame, model: TextModel | None = None) -> DataFrame:
    """identify() for pages: visible text, the markup's language, and the address."""
    return identify(pages.select("page_id", "url", "html"), ["page_id"], visible_text(F.col("html")), markup_language(F.col("html")), model, url=F.col("url"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_documents(table(spark, sf_dir, "documents")).drop("text_key").withColumnRenamed("accepted", "kept")


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_pages(table(spark, sf_dir, "pages"))
