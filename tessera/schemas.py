"""Tables of a content-addressed repository, as Spark types. Nothing is inferred."""

from pyspark.sql import types as T

_S, _L, _I = T.StringType(), T.LongType(), T.IntegerType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


SOURCE = _struct(("type", _S), ("account", _S), ("path", _S), ("identity", _S), ("path_id", _S), ("drive_name", _S), ("fs_type", _S))
CONTENT = _struct(("content_ref", _S), ("size", _L), ("chunks", T.ArrayType(_S)), ("data_inline", T.BinaryType()))
FILE_META = _struct(
    ("ref", _S), ("version", _I), ("file_id", _S), ("name", _S), ("type", _S), ("parents", T.ArrayType(_S)), ("paths", T.ArrayType(_S)),
    ("content_hash", _S), ("content_ref", _S), ("size", _L), ("mtime", _L), ("owner", _S), ("extra", T.MapType(_S, _S)), ("mode", _L),
    ("uid", _L), ("gid", _L), ("btime", _L), ("flags", _L), ("xattrs", T.MapType(_S, T.BinaryType())),
)
ENTRIES = _struct(("snapshot_ref", _S), ("file_id", _S), ("parent_id", _S), ("filemeta_ref", _S))
SNAPSHOT = _struct(
    ("ref", _S), ("version", _I), ("created", _S), ("root", _S), ("seq", _L), ("source", SOURCE), ("meta", T.MapType(_S, _S)),
    ("tags", T.ArrayType(_S)), ("change_token", _S), ("exclude_hash", _S),
)
PACK_CATALOG = _struct(("key", _S), ("pack_ref", _S), ("offset", _L), ("length", _L))
CHANGE = _struct(("op", _S), ("key", _S), ("seq", _L), ("meta", FILE_META))
CHECK_ERROR = _struct(("key", _S), ("type", _S), ("message", _S))
