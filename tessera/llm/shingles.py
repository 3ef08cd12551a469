"""Word shingles as 64-bit hashes, and their SuperMinHash signatures, over whole texts and many at a time."""

from __future__ import annotations

import numpy as np

#: Words of a shingle.
WORDS = 5
#: Bytes of one text that are turned into arrays at once; longer texts are cut between words, with an overlap.
SEGMENT_BYTES = 1 << 22

_STEP = np.uint64(0x9E3779B97F4A7C15)
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(joined: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each stretch of bytes: its blocks of eight are mixed with their number, one by one, and summed.

    No step is linear in the bytes, unlike a polynomial's, whose sums modulo 2 ** 64 are equal for some different texts.
    """
    length = ends - starts
    blocks = np.maximum((length + 7) >> 3, 1)
    first = np.cumsum(blocks) - blocks
    number = np.arange(blocks.sum()) - np.repeat(first, blocks)
    at = np.repeat(starts, blocks) + 8 * number
    held = np.ndarray((len(joined) + 1,), "<u8", joined + bytes(8), 0, (1,))[at]
    held = held & _KEEP[np.clip(np.repeat(ends, blocks) - at, 0, 8)]
    sums = np.add.reduceat(mix64(held ^ mix64(number.astype(np.uint64))), first) if len(first) else np.empty(0, np.uint64)
    return mix64(sums ^ mix64(length.astype(np.uint64)))


def plain(text: bytes) -> bytes:
    """A-Z lower-cased, words [^\\x20\\x09-\\x0D]+ with one space between."""
    return b" ".join(text.lower().split())


def _segments(words: bytes) -> list[bytes]:
    """Parts of a long plain text: neighbours share the words of all shingles but one."""
    if len(words) <= SEGMENT_BYTES:
        return [words]
    out, start = [], 0
    while len(words) - start > SEGMENT_BYTES:
        end = words.find(b" ", start + SEGMENT_BYTES)
        if end < 0:
            break
        out.append(words[start:end])
        start = end
        for _ in range(WORDS - 1):
            start = words.rfind(b" ", 0, start)
        start += 1
    return [*out, words[start:]]


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of WORDS words; of fewer words, the whole sequence; of none, empty."""
    parts, owner = [], []
    for i, text in enumerate(texts):
        if words := plain(text):
            for part in _segments(words):
                parts.append(part)
                owner.append(i)
    out = [np.empty(0, np.uint64)] * len(texts)
    if not parts:
        return out
    hashes, bounds = _hash_parts(parts)
    k = 0
    while k < len(parts):
        end = k + 1
        while end < len(parts) and owner[end] == owner[k]:
            end += 1
        out[owner[k]] = np.unique(hashes[bounds[k] : bounds[end]])
        k = end
    return out


def _hash_parts(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, and where those of each part begin. A shingle sums its words' hashes, each mixed with its place."""
    joined = b" ".join(parts)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    word = word_hashes(joined, np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(joined)])))
    counts = np.array([p.count(b" ") + 1 for p in parts])
    shingles = np.maximum(counts - (WORDS - 1), 1)
    first_word, bounds = np.concatenate(([0], np.cumsum(counts))), np.concatenate(([0], np.cumsum(shingles)))
    first = np.repeat(first_word[:-1], shingles) + np.arange(bounds[-1]) - np.repeat(bounds[:-1], shingles)
    short = bool((counts < WORDS).any())
    end = np.repeat(first_word[1:], shingles) if short else None
    sums = np.zeros(len(first), np.uint64)
    for j in range(WORDS):
        placed = mix64(word + np.uint64(int(_STEP) * (j + 1) % (1 << 64)))
        if short:
            inside = first + j < end
            sums[inside] += placed[first[inside] + j]
        else:
            sums += placed[first + j]
    return mix64(sums), bounds


def exact_shingles(text: bytes) -> set[bytes]:
    """The shingles themselves."""
    words = plain(text).split(b" ")
    return {b" ".join(words[i : i + WORDS]) for i in range(max(len(words) - WORDS + 1, 1))} - {b""}


def super_minhash(sets: list[np.ndarray], slots: int) -> np.ndarray:
    """Signatures, a row of slots (a power of two up to 128) per set: SuperMinHash.

    Every element gives each slot a different rank, by a pseudo-random permutation of its own, plus a random fraction;
    a slot holds the least value. Ranks are tried in order, 0 first, and a set is finished when its largest slot is below
    the next rank: large sets need few ranks. A value is rank << 40 | fraction. Empty sets have the largest value.
    """
    mask, bits = np.uint8(slots - 1), 40
    sizes = np.array([len(s) for s in sets], np.int64)
    signature = np.full((len(sets), slots), np.iinfo(np.int64).max, np.int64)
    element = np.concatenate(sets) if len(sets) else np.empty(0, np.uint64)
    row = np.repeat(np.arange(len(sets)), sizes)
    flat = signature.reshape(-1)
    keys = mix64(element ^ np.uint64(0xD6E8FEB86659FD93))
    byte = keys.view(np.uint8).reshape(-1, 8) if len(keys) else np.empty((0, 8), np.uint8)
    for rank in range(slots):
        if not len(element):
            break
        x = np.full(len(element), rank, np.uint8) + byte[:, 0]
        x = (x * (byte[:, 1] | np.uint8(1))) & mask
        x ^= x >> np.uint8(3)
        x = ((x + byte[:, 2]) * (byte[:, 3] | np.uint8(1))) & mask
        x ^= x >> np.uint8(2)
        x = ((x + byte[:, 4]) * (byte[:, 5] | np.uint8(1)) + byte[:, 6]) & mask
        fraction = (mix64(element + np.uint64(rank * 0xA0761D6478BD642F % (1 << 64))) >> np.uint64(64 - bits)).astype(np.int64)
        np.minimum.at(flat, row * slots + x, (np.int64(rank) << bits) | fraction)
        still = signature.max(axis=1) >= np.int64(rank + 1) << bits
        going = still[row]
        if not going.all():
            element, row, byte = element[going], row[going], byte[going]
    return signature
