"""Tables of results with keys, to which several runs may write at once: the last row of each key counts.

A write goes to a folder of its own first, and becomes part of the table when its manifest, a file of a few lines, is renamed into place. The
manifest's name holds a sequence number, one more than the highest that the writer saw, and the writer's own id, so that no two writers
ever want the same name and none is lost. Of rows of one key the one with the highest (sequence, writer) counts, and of equal
ones in a single write the one whose row hashes highest, in whatever order they are read. Writes that never got a manifest are not seen.

compact() writes the counting rows, with the sequence and writer that each came from, into one new folder, whose manifest names the ones it
stands for. Folders that the compaction before it
replaced are deleted then, so that who reads an older listing still finds its files.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Results of a configuration in one fold, by (config_id, fold).
FOLD_KEYS = ["config_id", "fold"]
FOLD_RESULTS = "config_id string, fold int, precision double, recall double, f1 double, ev double, auc_pr double, threshold double, n_trades long, train_start timestamp_ntz, train_end timestamp_ntz, test_start timestamp_ntz, test_end timestamp_ntz"
#: Fitted models of a configuration in one fold, with the folder each is saved in.
MODELS = "config_id string, fold int, path string, threshold double, precision double, ev double, tier int"


@dataclass(frozen=True)
class Manifest:
    sequence: int
    writer: str
    folder: str
    replaces: tuple[str, ...] = ()

    @property
    def name(self) -> str:
        return f"{self.sequence:012d}-{self.writer}"


class Ledger:
    """A keyed table under a path that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: str) -> None:
        self.spark, self.path, self.keys, self.schema = spark, path.rstrip("/"), keys, schema
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._files.mkdirs(self._path(f"{self.path}/manifests"))

    # Manifests are small files that the driver reads and writes; there are few, as compact() unites them.

    def _read(self, path) -> Manifest:
        stream = self._files.open(path)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        found = json.loads(text)
        return Manifest(found["sequence"], found["writer"], found["folder"], tuple(found["replaces"]))

    def manifests(self) -> list[Manifest]:
        """Those that count, oldest first."""
        listed = [s.getPath() for s in self._files.listStatus(self._path(f"{self.path}/manifests")) if not s.getPath().getName().startswith("_")]
        found = {m.name: m for m in map(self._read, listed)}
        gone = {n for m in found.values() for n in m.replaces}
        return sorted((m for n, m in found.items() if n not in gone), key=lambda m: (m.sequence, m.writer))

    def _commit(self, manifest: Manifest) -> None:
        staged, final = (self._path(f"{self.path}/manifests/{x}{manifest.name}") for x in ("_", ""))
        out = self._files.create(staged, True)
        out.write(bytearray(json.dumps({"sequence": manifest.sequence, "writer": manifest.writer, "folder": manifest.folder, "replaces": manifest.replaces}).encode()))
        out.close()
        if not self._files.rename(staged, final):
            raise OSError(f"{manifest.name} can't be renamed into place")

    def _shaped(self, df: DataFrame) -> DataFrame:
        """Columns of the schema: unknown ones are ignored, missing ones null."""
        own = self.spark.createDataFrame([], self.schema).schema
        return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in own))

    def upsert(self, df: DataFrame, writer: str | None = None) -> Manifest:
        """Add rows, which replace those of the same keys. writer: an id that no other write has."""
        writer = writer or uuid.uuid4().hex
        folder = f"data/{uuid.uuid4().hex}"
        none = {"__s": F.lit(None).cast("long"), "__w": F.lit(None).cast("string")}  # the manifest tells
        self._shaped(df).withColumns(none).write.parquet(f"{self.path}/{folder}")
        seen = [m.sequence for m in self.manifests()]
        manifest = Manifest(max(seen, default=0) + 1, writer, folder)
        self._commit(manifest)
        return manifest

    def _rows(self, manifests: list[Manifest]) -> DataFrame:
        """Rows with __s and __w, the sequence and writer of the write that each comes from."""
        empty = self.spark.createDataFrame([], f"{self.schema}, __s long, __w string")
        told = lambda m: {"__s": F.coalesce("__s", F.lit(m.sequence).cast("long")), "__w": F.coalesce("__w", F.lit(m.writer))}
        own = [self.spark.read.schema(empty.schema).parquet(f"{self.path}/{m.folder}").withColumns(told(m)) for m in manifests]
        return reduce(DataFrame.unionByName, own, empty)

    def _latest(self, manifests: list[Manifest]) -> DataFrame:
        rows = self._rows(manifests)
        order = F.struct("__s", "__w", F.xxhash64(*(c for c in rows.columns if c not in ("__s", "__w"))).alias("h"))
        return rows.groupBy(*(F.col(k).alias(f"__{k}") for k in self.keys)).agg(F.max_by(F.struct(*rows.columns), order).alias("r")).select("r.*")

    def read(self) -> DataFrame:
        """The last row of each key."""
        return self._latest(self.manifests()).drop("__s", "__w")

    def compact(self, writer: str | None = None) -> Manifest | None:
        """Unite all writes that there are; later ones, and those that come in meanwhile, stay as they are."""
        own = self.manifests()
        if len(own) < 2:
            return None
        folder = f"data/{uuid.uuid4().hex}"
        self._latest(own).write.parquet(f"{self.path}/{folder}")
        manifest = Manifest(own[-1].sequence, f"{own[-1].writer}-{writer or uuid.uuid4().hex}", folder, tuple(m.name for m in own))
        self._commit(manifest)
        for m in own:
            for old in m.replaces:
                self._drop(old)
        return manifest

    def _drop(self, name: str) -> None:
        path = self._path(f"{self.path}/manifests/{name}")
        if self._files.exists(path):
            self._files.delete(self._path(f"{self.path}/{self._read(path).folder}"), True)
            self._files.delete(path, False)


def fold_results(spark: SparkSession, path: str) -> Ledger:
    return Ledger(spark, path, FOLD_KEYS, FOLD_RESULTS)


def models(spark: SparkSession, path: str) -> Ledger:
    return Ledger(spark, path, FOLD_KEYS, MODELS)
