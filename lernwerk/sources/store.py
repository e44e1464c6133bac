"""A stored table in buckets whose changes are published as a whole.

Rows lie in ``BUCKETS`` buckets by a hash of one column. A change writes new files for the buckets it
touches and then publishes a manifest: a small file with the next number that names the folder of
every bucket. Readers take the manifest with the highest number, so a write that fails or is killed
before it publishes leaves the old state. Renaming the manifest fails if its number is taken: of two
writers that began with the same state one has to start again. ``vacuum`` removes files that no
manifest names.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64
MANIFEST = re.compile(r"manifest-(\d{10})\.json")


class Conflict(RuntimeError):
    """Another writer has published since this one read the table."""


class BucketStore:
    def __init__(self, spark: SparkSession, folder: str, by: str = "doc_id", buckets: int = BUCKETS):
        self.spark, self.folder, self.by, self.buckets = spark, folder.rstrip("/"), by, buckets
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return [x.getPath().getName() for x in self._files.listStatus(path)] if self._files.exists(path) else []

    def state(self) -> tuple[int, dict]:
        """The number of the current manifest and what it says: the schema, and the folder and rows of each bucket."""
        found = sorted(int(m[1]) for m in map(MANIFEST.fullmatch, self._names(self.folder)) if m)
        if not found:
            return 0, {"schema": None, "buckets": {}}
        text = self.spark.read.text(f"{self.folder}/manifest-{found[-1]:010d}.json", wholetext=True).first()[0]
        return found[-1], json.loads(text)

    def _frame(self, manifest: dict, buckets: list[str]) -> DataFrame:
        paths = [f"{self.folder}/{manifest['buckets'][b]['folder']}" for b in buckets]
        schema = StructType.fromJson(manifest["schema"])
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        _, manifest = self.state()
        return self._frame(manifest, sorted(manifest["buckets"]))

    def _bucket(self):
        return F.pmod(F.xxhash64(self.by), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame) -> dict[str, dict]:
        """New files of the rows by bucket, not published yet."""
        version = f"v-{uuid.uuid4().hex}"
        dealt = rows.withColumn("_bucket", self._bucket()).repartition("_bucket")
        dealt.write.partitionBy("_bucket").parquet(f"{self.folder}/{version}")
        counts = {}
        if any(x.startswith("_bucket=") for x in self._names(f"{self.folder}/{version}")):
            counts = dict(self.spark.read.parquet(f"{self.folder}/{version}").groupBy("_bucket").count().collect())  # one row a bucket
        return {str(b): {"folder": f"{version}/_bucket={b}", "rows": n} for b, n in counts.items()}

    def _publish(self, number: int, manifest: dict) -> None:
        own, target = self._path(f"{self.folder}/.{uuid.uuid4().hex}"), self._path(f"{self.folder}/manifest-{number:010d}.json")
        out = self._files.create(own, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if self._files.exists(target) or not self._files.rename(own, target):
            self._files.delete(own, False)
            raise Conflict(f"manifest {number} is published already")

    def overwrite(self, rows: DataFrame) -> None:
        number, _ = self.state()
        self._publish(number + 1, {"schema": json.loads(rows.schema.json()), "buckets": self._write(rows)})

    def replace(self, new: DataFrame, gone: DataFrame | None = None) -> int:
        """Rows of the keys of ``new`` and ``gone`` are replaced by ``new``; returns how many buckets were rewritten.

        Only buckets of those keys are read and written.
        """
        number, manifest = self.state()
        keys = new.select(self.by) if gone is None else new.select(self.by).unionByName(gone.select(self.by))
        touched = {str(r[0]) for r in keys.select(self._bucket()).distinct().collect()}  # BUCKETS rows at most
        before = self._frame(manifest, sorted(touched & manifest["buckets"].keys()))
        rows = before.join(keys.distinct(), self.by, "left_anti").select(*new.columns).unionByName(new)
        written = self._write(rows)
        kept = {b: x for b, x in manifest["buckets"].items() if b not in touched}
        self._publish(number + 1, {"schema": manifest["schema"], "buckets": kept | written})
        return len(touched)

    def vacuum(self) -> None:
        """Removes older manifests and the files that the current one doesn't name; no other writer may be at work."""
        number, manifest = self.state()
        named = {x["folder"] for x in manifest["buckets"].values()}
        for name in self._names(self.folder):
            m = MANIFEST.fullmatch(name)
            if m and int(m[1]) < number or name.startswith(".") and not name.endswith(".crc"):
                self._files.delete(self._path(f"{self.folder}/{name}"), False)
            for part in self._names(f"{self.folder}/{name}") if name.startswith("v-") else []:
                if f"{name}/{part}" not in named:
                    self._files.delete(self._path(f"{self.folder}/{name}/{part}"), True)
