"""Paths, sizes, names and identifiers as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The format that each native document type is exported to, with its extension; others become PDF.
NATIVE_EXPORTS = {
    "application/vnd.google-apps.document": ("application/vnd.openxmlformats-officedocument.wordprocessingml.document", ".docx"),
    "application/vnd.google-apps.spreadsheet": ("application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", ".xlsx"),
    "application/vnd.google-apps.presentation": ("application/vnd.openxmlformats-officedocument.presentationml.presentation", ".pptx"),
    "application/vnd.google-apps.drawing": ("image/svg+xml", ".svg"),
    "application/vnd.google-apps.script": ("application/vnd.google-apps.script+json", ".json"),
    "application/vnd.google-apps.form": ("application/pdf", ".pdf"),
    "application/vnd.google-apps.site": ("text/plain", ".txt"),
    "application/vnd.google-apps.jam": ("application/pdf", ".pdf"),
    "application/vnd.google-apps.map": ("application/pdf", ".pdf"),
}
_NATIVE, _NATIVE_FOLDER, _PDF = "application/vnd.google-apps.", "application/vnd.google-apps.folder", ("application/pdf", ".pdf")


def normalize_path(path: Column) -> Column:
    """Trimmed, backslashes as slashes, "." and ".." resolved, no slash at either end; never above the root. Null stays null."""
    parts = F.split(F.translate(F.trim(path), "\\", "/"), "/")
    empty = F.array().cast("array<string>")

    def step(done: Column, part: Column) -> Column:
        return F.when((part == "") | (part == "."), done).when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(part)))

    return F.array_join(F.aggregate(parts, empty, step), "/")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_path(path: Column) -> Column:
    """All but the last component; empty for a path in the root."""
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def ancestors(path: Column) -> Column:
    """Every proper ancestor, the nearest last."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, F.when(F.size(parts) > 1, i).otherwise(0)), "/"))


def leading_slash(path: Column) -> Column:
    return F.when(F.coalesce(path, F.lit("")) == "", F.lit("/")).when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))


def strip_drive_root(path: Column) -> Column:
    """What follows the first ":/" of a cloud path; empty for the root itself, which ends with ":"."""
    return F.when(path.contains(":/"), F.regexp_extract(path, r"(?s)^.*?:/(.*)$", 1)).when(path.endswith(":"), "").otherwise(path)


def probe_error(message: Column) -> Column:
    """What follows the first ": " of an error; a repository that isn't initialised has one fixed message."""
    trimmed = F.trim(message)
    rest = F.regexp_replace(trimmed, r"(?s)^.*?: ", "")
    return F.when(rest.contains("repository not initialized"), "repository not initialized").otherwise(rest)


def format_bytes(size: Column) -> Column:
    """Binary units with one decimal, halves to the even digit."""
    out = F.concat(size.cast("string"), F.lit(" B"))
    for power, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), start=1):
        out = F.when(size >= 1024**power, F.format_string(f"%.1f {unit}", F.bround(size / float(1024**power), 1))).otherwise(out)
    return out


def slug(value: Column) -> Column:
    """Lower case; runs of other characters become one dash; no dash, dot or underscore at the ends."""
    low = F.regexp_replace(F.lower(F.trim(value)), r"[^a-z0-9._-]+", "-")
    return F.regexp_replace(F.regexp_replace(low, r"-[-._]+", "-"), r"^[-._]+|[-._]+$", "")


def first_non_empty(*values: Column) -> Column:
    return F.coalesce(*[F.when(F.trim(v) != "", v) for v in values], F.lit(""))


def is_native_document(mime: Column) -> Column:
    return F.coalesce(mime.startswith(_NATIVE) & (mime != _NATIVE_FOLDER), F.lit(False))


def native_export(mime: Column) -> Column:
    """struct(mime, extension) of the export; null for what isn't a native document."""
    pair = lambda p: F.struct(F.lit(p[0]).alias("mime"), F.lit(p[1]).alias("extension"))
    chosen = reduce(lambda rest, item: F.when(mime == item[0], pair(item[1])).otherwise(rest), NATIVE_EXPORTS.items(), pair(_PDF))
    return F.when(is_native_document(mime), chosen)


def group_label(source: Column, account: Column, path: Column, tags: Column) -> Column:
    """A group as text: its non-empty fields, "(all)" without any."""
    shown = [F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{n}:"), c)) for n, c in (("source", source), ("account", account), ("path", path), ("tags", tags))]
    text = F.concat_ws(", ", *shown)
    return F.when(text == "", "(all)").otherwise(text)


def snapshot_key(given: Column, latest: Column, empty_is_latest: bool = True) -> Column:
    """The object key that an id given by a user means: "latest", bare or prefixed."""
    newest = given.isin(*(["latest", ""] if empty_is_latest else ["latest"]))
    return F.when(newest, latest).when(given.startswith("snapshot/"), given).otherwise(F.concat(F.lit("snapshot/"), given))


def epoch_seconds(rfc3339: Column) -> Column:
    """Seconds since 1970 of a timestamp with offset; null where it doesn't parse."""
    return F.unix_timestamp(F.try_to_timestamp(rfc3339))


def local_time(rfc3339: Column) -> Column:
    """The wall time that the timestamp shows, whatever its offset."""
    return F.to_timestamp_ntz(F.regexp_extract(rfc3339, r"^(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d)", 1))


def unescape_octal(value: Column) -> Column:
    """Mount fields write bytes as a backslash and three octal digits; others stay. Bytes that follow each other are UTF-8."""
    parts = F.split(value, r"\\(?=[0-3][0-7]{2})")
    byte = lambda p: F.unhex(F.lpad(F.conv(F.substring(p, 1, 3), 8, 16), 2, "0"))
    rest = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.concat(byte(p), F.encode(F.substring(p, 4, 1 << 30), "UTF-8")))
    return F.decode(F.aggregate(rest, F.encode(F.get(parts, F.lit(0)), "UTF-8"), lambda done, p: F.concat(done, p)), "UTF-8")
