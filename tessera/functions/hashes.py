"""Hashes and keys as column expressions; all stay inside code generation."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 64


def sha256_hex(value: Column) -> Column:
    """Lower-case hex of SHA-256 of the UTF-8 text or the bytes."""
    return F.sha2(value.cast("binary"), 256)


def hmac_sha256_hex(key: bytes, value: Column) -> Column:
    """HMAC-SHA256 as two nested digests; the pads of the key are constants of the plan."""
    key = hashlib.sha256(key).digest() if len(key) > _BLOCK else key
    key = key.ljust(_BLOCK, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, value.cast("binary")), 256))), 256)


def content_ref(content_hash: Column, key: bytes | None = None) -> Column:
    """Reference of a content: its hash, keyed in an encrypted repository."""
    return content_hash if key is None else hmac_sha256_hex(key, content_hash)


def canonical_hash(**fields: Column) -> Column:
    """Identity of a record: SHA-256 of JSON with the fields by name. Nulls are left out, so a field added later keeps old identities."""
    return sha256_hex(F.to_json(F.struct(*[c.alias(n) for n, c in sorted(fields.items())])))


def sorted_map(value: Column) -> Column:
    """The map with its entries by key, for canonical_hash and comparisons."""
    return F.map_from_entries(F.array_sort(F.map_entries(value)))


def map_equal(a: Column, b: Column) -> Column:
    """Equality of maps; null equals empty."""
    entries = lambda m: F.coalesce(F.array_sort(F.map_entries(m)), F.array_sort(F.map_entries(F.map_from_arrays(F.array(), F.array()).cast("map<string,binary>"))))
    return F.to_json(F.transform(entries(a), lambda e: F.concat_ws("=", e["key"], F.base64(e["value"].cast("binary"))))) == F.to_json(F.transform(entries(b), lambda e: F.concat_ws("=", e["key"], F.base64(e["value"].cast("binary")))))


def affinity_key(parent_id: Column, file_id: Column) -> Column:
    """Routing key: the parent's first 4 hex digits, then the file's others, so that siblings are neighbours."""
    return F.concat(F.substring(sha256_hex(parent_id), 1, 4), F.substring(sha256_hex(file_id), 5, 60))


def bucket_index(key: Column, level: int, bits: int = 5) -> Column:
    """The child that a hex key takes at a level: bits of its first 32, from the left."""
    shift = 32 - (level + 1) * bits
    if shift < 0:
        raise ValueError("the first 32 bits have no such level")
    return F.shiftrightunsigned(F.conv(F.substring(key, 1, 8), 16, 10).cast("long"), shift).bitwiseAND((1 << bits) - 1).cast("int")


def child_bit(child: Column) -> Column:
    """The bit of a child in its node's bitmap."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), child.cast("int"))


def child_position(bitmap: Column, child: Column) -> Column:
    """How many children of the bitmap come before one: its place in the node's array."""
    return F.bit_count(bitmap.bitwiseAND(child_bit(child) - 1))


def prefix(key: Column, level: int, bits: int = 5) -> Column:
    """The path to a node at a level, as a number; 0 at the root."""
    return F.shiftrightunsigned(F.conv(F.substring(key, 1, 8), 16, 10).cast("long"), 32 - level * bits)


def rules_fingerprint(patterns: Iterable[str] | Column) -> Column | str:
    """Identity of an ordered list of patterns; a change of it forces a full scan."""
    if isinstance(patterns, Column):
        return sha256_hex(F.array_join(patterns, "\n"))
    return hashlib.sha256("\n".join(patterns).encode()).hexdigest()


def derive_key(master: bytes, info: str, length: int = 32) -> bytes:
    """HKDF-SHA256 without salt, on the driver."""
    pseudo = hmac.new(b"\0" * 32, master, hashlib.sha256).digest()
    out, block = b"", b""
    for i in range(1, -(-length // 32) + 1):
        block = hmac.new(pseudo, block + info.encode() + bytes([i]), hashlib.sha256).digest()
        out += block
    return out[:length]


def seal(data: Column, key: bytes) -> Column:
    """AES-256-GCM: one version byte, then nonce, ciphertext and tag."""
    return F.concat(F.lit(bytearray(b"\x01")), F.aes_encrypt(data, F.lit(bytearray(key)), F.lit("GCM")))


def unseal(sealed: Column, key: bytes) -> Column:
    """The data, null if the version, the key or a bit is wrong."""
    body = F.try_aes_decrypt(F.substring(sealed, 2, 1 << 30), F.lit(bytearray(key)), F.lit("GCM"))
    return F.when(F.substring(sealed, 1, 1) == F.lit(bytearray(b"\x01")), body)
