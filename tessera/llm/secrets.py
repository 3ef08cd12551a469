"""Secret scan: fixed patterns, and strings that a vocabulary needs many tokens for.

A tiktoken vocabulary was merged from natural text, so random strings split into short tokens. Candidates are runs of
MIN_RUN or more characters of [A-Za-z0-9+/_-] with up to two "=" at the end; one is reported if it has at most MAX_RATIO
characters per token. Known digests (hexadecimal of a digest's length), UUIDs and identifiers (parts of letters only or
digits only, in natural case) are excluded first, and so is what a pattern has found already. A single part of letters
may be a word or a password of letters: it is an identifier unless it has at most MAX_LETTER_RATIO characters per token.

A row is judged alone, so there is no shuffle. One pass over the bytes of many texts finds all runs at once; only texts
with a run or a keyword are looked at further.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import encoded, pieces, table
from tessera.llm.tokens import default_vocabulary, tiktoken_encoding

#: Characters of a candidate, and characters per token up to which it is random.
MIN_RUN, MAX_RATIO = 16, 2.2
#: The same for a run of letters only; words have more.
MAX_LETTER_RATIO = 1.8
#: The kinds in their order, and the base patterns.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: Parts of the keywords of ASSIGN, in lower case.
KEYWORDS = (b"passw", b"secret", b"token", b"api")
#: Characters of the digests in common use, written in hexadecimal.
DIGEST_LENGTHS = {32, 40, 56, 64, 96, 128}

_UUID = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}")
_PART = re.compile(r"[a-z]+|[A-Z]+|[A-Z][a-z]+|(?:[A-Z]?[a-z]+)(?:[A-Z][a-z]+)+|[0-9]+")
_HEXADECIMAL = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_RUN_BYTES = np.zeros(256, bool)
_RUN_BYTES[np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", np.uint8)] = True

_SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long"


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by the fixed patterns, each kind leftmost and non-overlapping; code points, end exclusive."""
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return out + [(m.start(), m.end(), "hex") for m in HEX.finditer(text) if m.end() - m.start() >= 32]


def excluded(run: str) -> bool:
    """Known digests and identifiers."""
    bare = run.rstrip("=")
    if _HEXADECIMAL.fullmatch(bare) and len(bare) in DIGEST_LENGTHS or _UUID.fullmatch(bare):
        return True
    return all(_PART.fullmatch(p) for p in re.split(r"[-_+/]+", bare) if p)


def is_random(run: str, encoding) -> bool:
    letters = run.isalpha()
    if excluded(run) and not (letters and _PART.fullmatch(run)):
        return False
    return len(run) <= (MAX_LETTER_RATIO if letters else MAX_RATIO) * len(encoding.encode_ordinary(run))


def _found(text: str, runs: list[tuple[int, int]], keyword: bool, encoding) -> list[tuple[int, int, str]]:
    """All spans; runs are the long runs of the text, keyword tells whether ASSIGN may fit."""
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8] if keyword else []
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    for start, end in runs:
        out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text, start, end) if m.end() - m.start() >= 32]
    base = sorted(out)
    for start, end in runs:
        while end < len(text) and end - start >= MIN_RUN and text[end] == "=" and text[end - 2 : end] != "==":
            end += 1
        if not any(s < end and start < e for s, e, _ in base) and is_random(text[start:end], encoding):
            out.append((start, end, "random"))
    return out


def long_runs(texts: list[bytes], least: int) -> list[list[tuple[int, int]]]:
    """For each UTF-8 text the runs of at least so many run characters, as code points."""
    joined = b"\n".join(texts)
    data = np.frombuffer(joined, np.uint8)
    inside = np.concatenate(([False], _RUN_BYTES[data], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    keep = ends - starts >= least
    starts, ends = starts[keep], ends[keep]
    first = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    owner = np.searchsorted(first, starts, side="right") - 1
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    for i, s, e in zip(owner.tolist(), starts.tolist(), ends.tolist(), strict=True):
        at = s - int(first[i])
        if not texts[i].isascii():  # bytes of the text before the run to code points
            at = len(texts[i][:at].decode("utf-8"))
        out[i].append((at, at + e - s))
    return out


def _scanner(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = tiktoken_encoding(path)
        for batch in pieces(batches, "text"):
            raw = encoded(batch.column("text"))
            rows = []
            for text, runs in zip(raw, long_runs(raw, MIN_RUN), strict=True):
                low = text.lower()
                keyword = any(k in low for k in KEYWORDS)
                found = _found(text.decode("utf-8"), runs, keyword, encoding) if runs or keyword else []
                found.sort(key=lambda s: (s[0], KINDS.index(s[2])))
                written = [(f"{kind}:{start}:{end}", kind) for start, end, kind in found]
                base = ",".join(w for w, kind in written if kind != "random")
                n = {k: sum(kind == k for _, kind in written) for k in KINDS}
                rows.append((n["assign"], n["access"], n["hex"], hashlib.sha256(base.encode()).hexdigest(), ",".join(w for w, _ in written), n["random"]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            names = ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random")
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")} | {c: pa.array([r[i] for r in rows], k) for i, (c, k) in enumerate(zip(names, kinds, strict=True))})

    return run


def scan_secrets(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random.

    spans lists kind:start:end of all findings by start, then kind; code points, end exclusive; base_sha256 is the digest of
    the list without those of kind random. vocabulary: path of a tokenizers file on every executor. Null and empty texts
    have no findings, texts of any length are read whole, repeated rows are judged alike, a null doc_id is kept. Other
    columns are ignored; an empty table gives an empty result.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_scanner(vocabulary or default_vocabulary()), _SCHEMA)


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))
