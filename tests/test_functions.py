import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from tessera.functions import hashes, text


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], F.lit(0).alias("_")).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("key", [b"k", b"x" * 64, b"long" * 40])
def test_hmac_equals_the_standard_library(spark, key):
    assert one(spark, hashes.hmac_sha256_hex(key, F.col("v")), v="message é") == hmac.new(key, "message é".encode(), hashlib.sha256).hexdigest()


def test_keys_and_buckets(spark):
    parent, file = hashlib.sha256(b"p").hexdigest(), hashlib.sha256(b"f").hexdigest()
    assert one(spark, hashes.affinity_key(F.lit("p"), F.lit("f"))) == parent[:4] + file[4:]
    for level in range(6):
        assert one(spark, hashes.bucket_index(F.lit(file), level)) == int(file[:8], 16) >> 32 - 5 * (level + 1) & 31
    with pytest.raises(ValueError):
        hashes.bucket_index(F.lit(file), 6)
    assert hashes.derive_key(b"master", "info", 40)[:32] == hashes.derive_key(b"master", "info")


def test_canonical_hash_ignores_order_and_nulls(spark):
    a = hashes.canonical_hash(b=F.lit(1), a=F.lit("x"))
    b = hashes.canonical_hash(a=F.lit("x"), b=F.lit(1), new=F.lit(None).cast("string"))
    assert one(spark, a) == one(spark, b) != one(spark, hashes.canonical_hash(a=F.lit("y"), b=F.lit(1)))
    m = hashes.sorted_map(F.create_map(F.lit("z"), F.lit(1), F.lit("a"), F.lit(2)))
    assert list(one(spark, F.map_keys(m))) == ["a", "z"]


def test_seal_detects_a_changed_bit(spark):
    key = bytes(32)
    sealed = one(spark, hashes.seal(F.lit("hello").cast("binary"), key))
    assert sealed[0] == 1 and len(sealed) == 34
    open_ = lambda data: one(spark, hashes.unseal(F.lit(bytearray(data)), key))
    assert bytes(open_(sealed)) == b"hello"
    assert open_(sealed[:-1] + bytes([sealed[-1] ^ 1])) is None and open_(b"\x02" + sealed[1:]) is None


@pytest.mark.parametrize(
    ("given", "want"),
    [(" /a//b/./c/ ", "a/b/c"), ("a\\b", "a/b"), ("../../x", "x"), ("a/../..", ""), ("", ""), (".", ""), ("/", ""), (None, None)],
)
def test_normalize_path(spark, given, want):
    assert one(spark, text.normalize_path(F.col("v").cast("string")), v=given) == want


@pytest.mark.parametrize(("size", "want"), [(0, "0 B"), (1023, "1023 B"), (1024, "1.0 KiB"), (1536, "1.5 KiB"), (1024**2, "1.0 MiB"), (5 * 1024**3, "5.0 GiB"), (2 * 1024**4, "2.0 TiB"), (1024 * 431 + 256, "431.2 KiB")])
def test_format_bytes(spark, size, want):
    assert one(spark, text.format_bytes(F.lit(size))) == want


@pytest.mark.parametrize(("given", "want"), [("  My Laptop! ", "my-laptop"), ("a__b", "a__b"), ("--x..", "x"), ("", ""), ("a - b", "a-b"), ("Ä1", "1"), ("a-.b", "a-b")])
def test_slug(spark, given, want):
    assert one(spark, text.slug(F.lit(given))) == want


def test_small_text_functions(spark):
    assert one(spark, text.strip_drive_root(F.lit("/drive/root:/a/b"))) == "a/b"
    assert one(spark, text.strip_drive_root(F.lit("/drive/root:"))) == ""
    assert one(spark, text.leading_slash(F.lit("a"))) == "/a" and one(spark, text.leading_slash(F.lit(""))) == "/"
    assert one(spark, text.probe_error(F.lit(" open store: no such host "))) == "no such host"
    assert one(spark, text.probe_error(F.lit("x: repository not initialized: y"))) == "repository not initialized"
    assert one(spark, text.first_non_empty(F.lit(" "), F.lit("b"), F.lit("c"))) == "b"
    assert one(spark, text.group_label(F.lit(""), F.lit(""), F.lit(""), F.lit(""))) == "(all)"
    assert one(spark, text.group_label(F.lit("s"), F.lit(""), F.lit("p"), F.lit("t"))) == "source:s, path:p, tags:t"
    assert [one(spark, text.snapshot_key(F.lit(v), F.lit("snapshot/9"))) for v in ("", "latest", "a", "snapshot/a")] == ["snapshot/9", "snapshot/9", "snapshot/a", "snapshot/a"]
    assert one(spark, text.snapshot_key(F.lit(""), F.lit("snapshot/9"), empty_is_latest=False)) == "snapshot/"
    assert one(spark, text.epoch_seconds(F.lit("1970-01-01T02:00:01+02:00"))) == 1 and one(spark, text.epoch_seconds(F.lit("no time"))) is None
    assert str(one(spark, text.local_time(F.lit("2024-01-02T03:04:05+09:00")))) == "2024-01-02 03:04:05"
    assert one(spark, text.unescape_octal(F.lit("/mnt/my\\040disk\\134x"))) == "/mnt/my disk\\x"
    assert one(spark, text.ancestors(F.lit("a/b/c"))) == ["a", "a/b"]
    assert one(spark, text.native_export(F.lit("application/vnd.google-apps.spreadsheet")))["extension"] == ".xlsx"
    assert one(spark, text.native_export(F.lit("application/vnd.google-apps.folder"))) is None
