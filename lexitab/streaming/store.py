"""A store of immutable keys whose versions are manifests, committed by compare-and-swap, with markers of finished folds.

    data/<id>/__bucket=<k>/...   Parquet files of one batch, dealt by a hash of the keys
    versions/<n>.json            how many buckets there are, which batches each bucket has, rows, and the markers

A version is made visible by renaming its file to a name that mustn't exist yet, so checking and appending are one step: a writer that
finds the name taken looks again at what the others have stored in its buckets and tries the next one. That is atomic where renaming
onto a file fails (HDFS and the like); on a local file system writers must share a process. A version, once written, never changes,
so readers of older versions aren't disturbed; what an interrupted writer leaves isn't in any version.
"""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexitab.operators.dedup import conflicts
from lexitab.session import written_once
from lexitab.sources.tables import content_checksum, read_export

#: Rows for each bucket beyond which the buckets double, buckets at first, and batches of a bucket beyond which they are put together.
BUCKET_ROWS, FIRST_BUCKETS, BATCHES = 1_000_000, 16, 64
#: How often a commit is tried while others commit.
ATTEMPTS = 50

_committing = threading.Lock()


class ImmutableStore:
    """A table whose keys keep their first value: equal rows are skipped, unlike ones are an error.

    A batch is compared with the buckets of its keys only. Once buckets hold more than bucket_rows rows on average they
    double, which writes the rows once more; so a batch of few keys reads a bounded number of rows however large the store is.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str], bucket_rows: int = BUCKET_ROWS):
        self.spark, self.path, self.schema, self.keys, self.bucket_rows = spark, path, schema, keys, bucket_rows
        self.names = [f.name for f in schema.fields]

    # Versions.

    def _fs(self, path: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()), hadoop

    def versions(self) -> list[int]:
        """The numbers of all versions, ascending."""
        fs, folder = self._fs(f"{self.path}/versions")
        if not fs.exists(folder):
            return []
        return sorted(int(s.getPath().getName().removesuffix(".json")) for s in fs.listStatus(folder) if s.getPath().getName().endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """A version's manifest; the newest one's without a number, and that of an empty store if there is none."""
        if version is None:
            known = self.versions()
            if not known:
                return {"version": 0, "buckets": FIRST_BUCKETS, "rows": 0, "batches": {}, "markers": {}}
            version = known[-1]
        return json.loads("".join(r[0] for r in self.spark.read.text(f"{self.path}/versions/{version:012d}.json").collect()))

    def _commit(self, manifest: dict) -> bool:
        """Makes the manifest its version; False if that version is there already."""
        fs, name = self._fs(f"{self.path}/versions/{manifest['version']:012d}.json")
        _, draft = self._fs(f"{self.path}/drafts/{uuid.uuid4().hex}.json")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        fs.mkdirs(name.getParent())
        with _committing:
            won = not fs.exists(name) and fs.rename(draft, name)
        if not won:
            fs.delete(draft, False)
        return won

    # Rows.

    def _rows(self, manifest: dict, buckets: Iterable[int] | None = None) -> DataFrame:
        """The rows of some buckets, or of all of them, from the folders that the manifest names."""
        wanted = manifest["batches"] if buckets is None else {str(b): manifest["batches"][str(b)] for b in buckets if str(b) in manifest["batches"]}
        folders = [f"{self.path}/data/{batch}/__bucket={b}" for b, batches in wanted.items() for batch in batches]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def read(self, version: int | None = None) -> DataFrame:
        """What a version has; the newest one without a number."""
        return self._rows(self.manifest(version))

    def _write(self, rows: DataFrame, buckets: int) -> tuple[str, dict[str, int]]:
        """Writes rows as a batch; its name, and the rows of each bucket that it has."""
        batch = uuid.uuid4().hex
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(buckets)).cast("int")
        dealt = rows.select(*self.names, bucket.alias("__bucket"))
        dealt.repartition("__bucket").write.partitionBy("__bucket").parquet(f"{self.path}/data/{batch}")
        fs, folder = self._fs(f"{self.path}/data/{batch}")
        some = [s.getPath().getName() for s in fs.listStatus(folder) if s.getPath().getName().startswith("__bucket=")]
        if not some:
            return batch, {}
        counts = self.spark.read.parquet(f"{self.path}/data/{batch}").groupBy("__bucket").count().collect()  # a row for each bucket touched
        return batch, {str(r["__bucket"]): r["count"] for r in counts}

    def put(self, rows: DataFrame, marker: str | None = None) -> bool:
        """Adds the rows whose keys are new, and the marker, in one version; False if the marker is there already, and then nothing is done.

        Replaying a batch changes nothing. A key with two values, in the batch or against the store, is an error.
        """
        rows = written_once(rows.select(*self.names).distinct())
        if not rows.groupBy(*self.keys).count().where("count > 1").isEmpty():
            raise ValueError(f"{self.path}: a key has two values")
        for _ in range(ATTEMPTS):
            now = self.manifest()
            if marker is not None and marker in now["markers"]:
                return False
            touched = [r[0] for r in rows.select(F.pmod(F.xxhash64(*self.keys), F.lit(now["buckets"])).cast("int").alias("b")).distinct().collect()]  # buckets at most
            stored = self._rows(now, touched)
            if not conflicts(stored, rows, self.keys).isEmpty():
                raise ValueError(f"{self.path}: a key has two values")
            batch, counts = self._write(rows.join(stored.select(*self.keys), self.keys, "left_anti"), now["buckets"])
            if not counts and marker is None:
                return True
            after = {**now, "version": now["version"] + 1, "rows": now["rows"] + sum(counts.values()), "batches": {k: list(v) for k, v in now["batches"].items()}, "markers": dict(now["markers"])}
            for bucket in counts:
                after["batches"].setdefault(bucket, []).append(batch)
            if marker is not None:
                after["markers"][marker] = sum(counts.values())
            if self._commit(after):
                self.tidy()
                return True
        raise RuntimeError(f"{self.path}: others committed {ATTEMPTS} times meanwhile")

    def tidy(self) -> bool:
        """Doubles the buckets until they are small enough, or puts a bucket's many batches together, as a version of its own; False if there was no need or another writer came first."""
        now = self.manifest()
        buckets = now["buckets"]
        while now["rows"] > buckets * self.bucket_rows:
            buckets *= 2
        if buckets == now["buckets"] and max(map(len, now["batches"].values()), default=0) <= BATCHES:
            return False
        batch, counts = self._write(self._rows(now), buckets)
        return self._commit({**now, "version": now["version"] + 1, "buckets": buckets, "batches": {b: [batch] for b in counts}})

    def pending(self, wanted: DataFrame) -> DataFrame:
        """The wanted keys that aren't stored yet."""
        return wanted.select(*self.keys).distinct().join(self.read().select(*self.keys), self.keys, "left_anti")

    def run_folds(self, folds: Iterable[str], compute: Callable[[str], DataFrame]) -> list[str]:
        """Computes and stores the folds without a marker; which ones those were. Interrupted, it goes on with the first unfinished fold."""
        done = set(self.manifest()["markers"])
        return [fold for fold in folds if fold not in done and self.put(compute(fold), marker=fold)]

    def put_stream(self, stream: DataFrame, checkpoint: str):
        """Feeds a stream into the store, each micro-batch by put(); ends when the input is used up."""
        return stream.writeStream.foreachBatch(lambda batch, _: self.put(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def restore(self, version: int) -> int:
        """Makes what an earlier version had the newest version; its number. Versions in between stay readable."""
        old = self.manifest(version)
        for _ in range(ATTEMPTS):
            now = self.manifest()["version"]
            if self._commit({**old, "version": now + 1}):
                return now + 1
        raise RuntimeError(f"{self.path}: others committed {ATTEMPTS} times meanwhile")

    def import_snapshot(self, source: str, table: str, *, schema: str, identity: dict | None = None) -> str:
        """Adds a table of a checksummed export (sources.tables.write_export()) as one version: imported, already_imported, or the export's status.

        The export is verified whole before anything is written, and a key with another value here is an error; then, as after any
        interruption, the store is as it was. The same export is imported once. restore() takes an import back.
        """
        status, tables = read_export(self.spark, source, schema=schema, identity=identity)
        if status != "ok":
            return status
        rows, digest = content_checksum(tables[table])
        return "imported" if self.put(tables[table], marker=f"import:{table}:{rows}:{digest}") else "already_imported"
