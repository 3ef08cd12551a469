"""A change feed applied to keyed state by Structured Streaming.

The state is cut into buckets by a hash of the key. A micro-batch writes new versions of the buckets that its keys lie
in, and then a manifest, under the batch's number, that names the version of every bucket: a batch that is run again
writes the same files, so the state and the stream's offset move together, and its cost is that of the touched buckets.
Versions that no kept manifest names are deleted. The state keeps the last change of every key, deletes too, so the
order of batches doesn't matter.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.lineage import materialise
from tessera.operators.versions import latest_changes

#: Buckets of a state, and manifests that are kept for readers of older versions.
BUCKETS, KEPT = 64, 4


class ChangeState:
    """Versions of a state under one shared folder. key names the key column, order the columns that say which change is later."""

    def __init__(self, spark: SparkSession, folder: str, key: str, order: list[str], buckets: int = BUCKETS) -> None:
        self.spark, self.folder, self.key, self.order, self.buckets = spark, folder.rstrip("/"), key, order, buckets

    def _path(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def version(self) -> int | None:
        """The number of the last batch that is complete."""
        fs, where = self._path(f"{self.folder}/done")
        if not fs.exists(where):
            return None
        numbers = [int(s.getPath().getName()) for s in fs.listStatus(where) if s.getPath().getName().isdigit()]
        return max(numbers, default=None)

    def _manifest(self, number: int | None) -> dict[int, int]:
        """Bucket -> the batch that wrote its version."""
        if number is None:
            return {}
        rows = self.spark.read.option("wholetext", True).text(f"{self.folder}/done/{number}").collect()
        return {int(k): v for k, v in json.loads(rows[0][0]).items()}

    def _read(self, versions: dict[int, int]) -> DataFrame | None:
        paths = [f"{self.folder}/state/{v}/_bucket_={b}" for b, v in sorted(versions.items())]
        paths = [p for p in paths if (at := self._path(p))[0].exists(at[1])]
        return self.spark.read.parquet(*paths) if paths else None

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def changes(self) -> DataFrame | None:
        """The last change of every key, deletes too."""
        return self._read(self._manifest(self.version()))

    def live(self, op: str = "op") -> DataFrame | None:
        """The keys that exist."""
        last = self.changes()
        return None if last is None else last.where(F.col(op) != "delete")

    def apply(self, batch: DataFrame, number: int) -> None:
        """For foreachBatch."""
        at = self.version()
        if at is not None and at >= number:
            return
        manifest = self._manifest(at)
        batch = materialise(batch)
        touched = [r[0] for r in batch.select(self._bucket()).distinct().collect()]  # at most as many as there are buckets
        old = self._read({b: manifest[b] for b in touched if b in manifest})
        rows = batch if old is None else old.select(*batch.columns).unionByName(batch)
        latest = latest_changes(rows, self.key, self.order).select(*batch.columns).withColumn("_bucket_", self._bucket())
        latest.repartition("_bucket_").write.mode("overwrite").partitionBy("_bucket_").parquet(f"{self.folder}/state/{number}")
        fs, where = self._path(f"{self.folder}/done/{number}")
        out = fs.create(where, True)
        out.write(bytearray(json.dumps(manifest | dict.fromkeys(touched, number)).encode()))
        out.close()
        self._drop_old()

    def _drop_old(self) -> None:
        """Deletes manifests beyond the last KEPT, and bucket versions that none of those names."""
        fs, done = self._path(f"{self.folder}/done")
        numbers = sorted(int(s.getPath().getName()) for s in fs.listStatus(done) if s.getPath().getName().isdigit())
        used = {(b, v) for n in numbers[-KEPT:] for b, v in self._manifest(n).items()}
        for n in numbers[:-KEPT]:
            for b, v in self._manifest(n).items():
                if (b, v) not in used:
                    fs.delete(self._path(f"{self.folder}/state/{v}/_bucket_={b}")[1], True)
            fs.delete(self._path(f"{self.folder}/done/{n}")[1], False)

    def run(self, feed: DataFrame) -> None:
        """Applies all that a streaming feed has now; the next call goes on from there."""
        query = feed.writeStream.foreachBatch(self.apply).option("checkpointLocation", f"{self.folder}/offsets").trigger(availableNow=True).start()
        query.awaitTermination()
