"""Document quality by a linear-chain conditional random field over lines.

Every line gets features of its characters, and those of the line before and after it. A chain with two labels, good
and bad, links them; forward-backward gives each line's marginal probability of good, and the marginals, weighted by the
lines' lengths, are the document's quality.

The field is fitted on a bounded sample of labelled documents (TRAIN_DOCS of each label, those with at most TRAIN_LINES
lines), weighted to the frequency of the labels among all. Labels of lines are latent: a document's label is evidence
for each of its lines, with odds of exp(EVIDENCE), and the likelihood sums over all labellings of the lines. So a line
of a bad document that looks like those of good ones is good, and the field learns where labels change inside a text.
Only the sample's line features reach the driver. Scoring is one pass over whole texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import encoded, pieces, table
from tessera.llm.shingles import mix64, word_hashes

#: The bound of the training sample: documents of each label, and lines of one of them.
TRAIN_DOCS, TRAIN_LINES = 1500, 200
#: Steps of gradient ascent, and the weight of the squared norm.
STEPS, RIDGE = 300, 1e-5
#: How much a document's label says about each of its lines, in log odds.
EVIDENCE = 2.0

#: A class for each byte. 0 lower case, 1 upper case, 2 digit, 3 white space, 4 end of a sentence, 5 other marks of prose, 6 other symbols, 7 not ASCII.
_CLASS = np.full(256, 6, np.uint8)
for _i, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b".!?", b",;:'\"()-", b"", bytes(range(128, 256)))):
    _CLASS[np.frombuffer(_chars, np.uint8)] = _i
_CLASSES = 8
#: Classes as shares, then length, words, length of words, repeated characters, first upper case, end of a sentence, empty line, words that repeat the last one, distinct words, long words.
FEATURES = _CLASSES + 10


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines, the lines' bytes, and the number of lines of each text. An empty text has one empty line."""
    joined = b"\n".join(texts) + b"\n"
    data = np.frombuffer(joined, np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    length = (ends - starts).astype(np.float64)
    kind = _CLASS[data]
    kind[ends] = 3
    counts = np.empty((len(ends), _CLASSES))
    for c in range(_CLASSES):
        counts[:, c] = np.add.reduceat(kind == c, starts, dtype=np.int64)
    counts[:, 3] -= 1  # the line feed
    opens = np.concatenate(([True], kind[:-1] == 3)) & (kind != 3)
    words = np.add.reduceat(opens, starts, dtype=np.int64).astype(np.float64)
    same = np.concatenate(([False], data[1:] == data[:-1])) & (kind != 3)
    same = np.add.reduceat(same, starts, dtype=np.int64)
    some = np.maximum(length, 1)
    out = np.empty((len(ends), FEATURES), np.float32)
    out[:, :_CLASSES] = counts / some[:, None]
    out[:, 8], out[:, 9] = np.log1p(length) / 8, np.log1p(words) / 6
    out[:, 10] = np.minimum(length / np.maximum(words, 1), 40) / 10
    out[:, 11] = same / some
    out[:, 12] = (kind[starts] == 1) & (length > 0)
    out[:, 13] = (kind[np.maximum(ends - 1, 0)] == 4) & (length > 0)
    out[:, 14] = length == 0
    begins = np.flatnonzero(opens)
    stops = np.flatnonzero(np.concatenate(((kind[1:] == 3) & (kind[:-1] != 3), [False])))  # the last byte of each word
    word = word_hashes(joined, begins, stops + 1)
    line = np.searchsorted(starts, begins, side="right") - 1
    again = np.concatenate(([False], (word[1:] == word[:-1]) & (line[1:] == line[:-1])))[: len(word)]
    _, at = np.unique(mix64(word + line.astype(np.uint64)), return_index=True)
    many = np.maximum(words, 1)
    out[:, 15] = np.bincount(line[again], minlength=len(ends)) / many
    out[:, 16] = np.where(words > 0, np.bincount(line[at], minlength=len(ends)) / many, 1)
    out[:, 17] = np.bincount(line[stops - begins >= 11], minlength=len(ends)) / many
    return out, length, np.array([t.count(b"\n") + 1 for t in texts], np.int64)


def _observed(x: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Per line: its features, those of its neighbours (0 beyond the ends), and a constant."""
    first = np.concatenate(([0], np.cumsum(lines)[:-1]))
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[first], after[first + lines - 1] = 0, 0
    return np.concatenate((x, before, after, np.ones((len(x), 1), x.dtype)), axis=1)


@dataclass
class LineField:
    """Weights of good against bad for what is observed at a line, and of each pair of neighbouring labels (bad, good)."""

    weights: np.ndarray
    pairs: np.ndarray

    def marginals(self, x: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Probability of good for each line, expected pairs of labels (per document), and the log of each partition function."""
        good, pairs, logs = _forward_backward(x @ self.weights, self.pairs, lines)
        return good, pairs, logs


def _forward_backward(score: np.ndarray, pair: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For chains that follow each other in score. All chains advance together, longest first, so the work is that of the lines."""
    order = np.argsort(-lines, kind="stable")
    first = np.concatenate(([0], np.cumsum(lines)[:-1]))[order]
    longest = lines[order]
    top = np.maximum(score, 0.0)
    emit = np.stack((np.exp(-top), np.exp(score - top)), axis=1)
    shift = pair.max()
    move = np.exp(pair - shift)
    alpha, logs = np.empty((len(score), 2)), np.zeros(len(lines))
    active = len(lines)
    scale = np.empty(len(score))
    steps = int(longest[0]) if len(longest) else 0
    for t in range(steps):
        while active and longest[active - 1] <= t:
            active -= 1
        at = first[:active] + t
        a = emit[at] if t == 0 else (alpha[at - 1] @ move) * emit[at]
        s = a.sum(axis=1)
        alpha[at], scale[at] = a / s[:, None], s
        logs[:active] += np.log(s) + top[at] + (shift if t else 0.0)
    beta = np.ones((len(score), 2))
    both = np.zeros((len(lines), 2, 2))
    active = 0
    for t in range(steps - 1, 0, -1):
        while active < len(longest) and longest[active] > t:
            active += 1
        at = first[:active] + t
        ahead = emit[at] * beta[at] / scale[at][:, None]
        both[:active] += alpha[at - 1][:, :, None] * move[None] * ahead[:, None, :]
        beta[at - 1] = ahead @ move.T
    gamma = alpha * beta
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return gamma[:, 1] / gamma.sum(axis=1), both[back], logs[back]


def fit_field(features: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, steps: int = STEPS, evidence: float = EVIDENCE) -> LineField:
    """Maximum likelihood of the documents' labels with a ridge, by Adam; a row of features per line of each document, one label and weight per document.

    The slope is the difference of two expectations: given the documents' labels as evidence for lines, and without it.
    """
    lines = np.array([len(f) for f in features], np.int64)
    x = _observed(np.concatenate(features).astype(np.float64), lines)
    centre, spread = x.mean(axis=0), x.std(axis=0) + 1e-3
    centre[-1], spread[-1] = 0.0, 1.0
    x = (x - centre) / spread
    told = np.repeat(evidence * (2.0 * labels - 1.0), lines)
    share = weights / (weights * lines).sum()
    per_line = np.repeat(share, lines)
    field = LineField(np.zeros(x.shape[1]), np.zeros((2, 2)))
    m = v = np.zeros(x.shape[1] + 4)
    for step in range(1, steps + 1):
        score = x @ field.weights
        good, both, _ = _forward_backward(score, field.pairs, lines)
        given, pairs, _ = _forward_backward(score + told, field.pairs, lines)
        slope = np.concatenate((x.T @ (per_line * (given - good)), ((pairs - both) * share[:, None, None]).sum(axis=0).ravel()))
        now = np.concatenate((field.weights, field.pairs.ravel()))
        slope -= RIDGE * now
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        now = now + 0.2 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        field = LineField(now[:-4], now[-4:].reshape(2, 2))
    weights = field.weights / spread
    weights[-1] -= centre @ weights
    return LineField(weights, field.pairs)


def training_rows(docs: DataFrame, labels: DataFrame, per_label: int, max_lines: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Line features, labels and weights of the sample. labels: doc_id, quality; of several labels of a document the lowest counts."""
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    counts = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    sample = None
    for y in (0, 1):
        part = known.where(F.col("quality") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label)
        sample = part if sample is None else sample.union(part)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    chosen = texts.join(F.broadcast(sample), "doc_id")  # at most 2 * per_label rows

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            x, _, lines = line_features(encoded(batch.column("text")))
            cut = np.split(x, np.cumsum(lines)[:-1])
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "quality": batch.column("quality"), "features": pa.array([c.tobytes() if len(c) <= max_lines else None for c in cut], pa.binary())})

    rows = chosen.mapInArrow(describe, "doc_id long, quality int, features binary").where("features is not null").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["quality"], bytes(r["features"])))
    y = np.array([r["quality"] for r in rows], np.int64)
    weight = np.array([counts[k] / max(1, int((y == k).sum())) for k in y])
    return [np.frombuffer(bytes(r["features"]), np.float32).reshape(-1, FEATURES) for r in rows], y, weight


def fit_quality(docs: DataFrame, labels: DataFrame, per_label: int = TRAIN_DOCS, max_lines: int = TRAIN_LINES) -> LineField:
    """The field for docs and their labels. With labels of one kind only, or none, every line has the share of good (plus one of each) as its probability."""
    features, y, weight = training_rows(docs, labels, per_label, max_lines)
    if len(set(y.tolist())) < 2:
        odds = (weight[y == 1].sum() + 1) / (weight[y == 0].sum() + 1)
        return LineField(np.append(np.zeros(3 * FEATURES), np.log(odds)), np.zeros((2, 2)))
    return fit_field(features, y, weight)


def _scorer(field: LineField, marginals: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            x, length, lines = line_features(encoded(batch.column("text")))
            good, _, _ = field.marginals(_observed(x, lines), lines)
            first = np.concatenate(([0], np.cumsum(lines)[:-1]))
            weight = length + 1
            score = np.add.reduceat(good * weight, first) / np.add.reduceat(weight, first)
            bad = np.add.reduceat(good < 0.5, first, dtype=np.int64)
            out = {"doc_id": batch.column("doc_id"), "score": pa.array(np.clip(score, 0.0, 1.0)), "n_lines": pa.array(lines), "bad_lines": pa.array(bad)}
            if marginals:
                out["line_marginals"] = pa.array([g.astype(np.float32) for g in np.split(good, first[1:])], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_pydict(out)

    return run


def score_quality(docs: DataFrame, field: LineField, marginals: bool = False) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, score, n_lines, bad_lines, and, if asked, line_marginals (probability of good, by line).

    A null text counts as empty, and an empty text is one empty line, which the field scores as any other. Texts are
    read whole; a null doc_id is kept and repeated rows are scored alike. Other columns are ignored; an empty table
    gives an empty result.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_scorer(field, marginals), "doc_id long, score double, n_lines long, bad_lines long" + ", line_marginals array<float>" * marginals)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3))
    field = fit_quality(docs, labels.where(fold != 1))
    held_out = F.coalesce(fold == 1, F.lit(False))
    return score_quality(docs, field).select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "n_lines", "bad_lines")
