"""A store of immutable shards with size-tiered compaction and versioned manifests.

Built-in functions only. A store is a folder:

    shards/<run>/part-*        Parquet files, never changed once written
    manifests/<version>/       Parquet: one row for each shard of that version
    versions/<version>         a file that names the version's manifest; its appearance commits the version

Arrivals are appended as small shards. A compaction puts shards into tiers by
size (each tier ``fan`` times as large as the one below) and merges the tiers
that hold at least ``fan`` shards into files of about ``target`` bytes; the scan
packs small files into tasks by size, so merging needs no shuffle. A version is
committed by renaming its finished file into place without overwriting: of two
writers of one version only one succeeds, and readers see the old or the new
version, never a mixture or a part. The folder's file system must rename
atomically, as HDFS does. Files that no version names are those of lost attempts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "path string, bytes bigint, rows bigint, tier int"


class CommitConflict(RuntimeError):
    """Another writer has committed the version."""


class ShardStore:
    """The store at ``root``, a folder that all executors reach."""

    def __init__(self, spark: SparkSession, root: str, small: int = 1 << 20, fan: int = 4, target: int = 128 << 20) -> None:
        self.spark, self.root, self.small, self.fan, self.target = spark, root.rstrip("/"), small, fan, target

    # ---- versions ----

    def _path(self, at: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(at)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def version(self) -> int:
        """The last committed version; 0 for a new store."""
        fs, path = self._path(f"{self.root}/versions")
        if not fs.exists(path):
            return 0
        return max([int(f.getPath().getName()) for f in fs.listStatus(path) if f.getPath().getName().isdigit()], default=0)

    def _commit(self, version: int, manifest: DataFrame) -> int:
        manifest.write.parquet(f"{self.root}/manifests/{version}-{(own := uuid.uuid4().hex)}")
        ready = f"{self.root}/versions/.{own}"
        fs, path = self._path(ready)
        out = fs.create(path, False)
        out.write(bytearray(own.encode()))
        out.close()
        try:
            self._rename(ready, f"{self.root}/versions/{version}")
        except Exception as e:
            fs.delete(path, False)
            raise CommitConflict(f"version {version}") from e
        return version

    def _rename(self, old: str, new: str) -> None:
        """Rename a file; an existing one of the new name makes it fail."""
        sc = self.spark.sparkContext
        fs, path = self._path(new)
        options = sc._gateway.new_array(sc._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(path).toUri(), sc._jsc.hadoopConfiguration()).rename(self._path(old)[1], path, options)

    def manifest(self, version: int | None = None) -> DataFrame:
        """path, bytes, rows, tier of the shards of a version."""
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], MANIFEST)
        own = self.spark.read.text(f"{self.root}/versions/{version}").first()[0]
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifests/{version}-{own}")

    def read(self, version: int | None = None, shard: str | None = None) -> DataFrame | None:
        """The rows of a version, with the shard of each in the column ``shard`` if one is asked for; None while nothing is committed."""
        paths = [r.path for r in self.manifest(version).where("rows > 0").select("path").collect()]
        if not paths:
            return None
        rows = self.spark.read.parquet(*paths)
        return rows if shard is None else rows.select("*", F.col("_metadata.file_path").alias(shard))

    # ---- writes ----

    def _described(self, at: str) -> DataFrame:
        """Manifest rows of the files that a finished job left in ``at``."""
        shards = self.spark.read.parquet(at).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes")).groupBy("path", "bytes").agg(F.count("*").alias("rows"))
        tier = F.greatest(F.lit(0), F.floor(F.log(F.col("bytes") / self.small) / F.log(F.lit(float(self.fan)))) + 1)
        return shards.withColumn("tier", tier.cast("int"))

    def append(self, arrivals: DataFrame) -> int:
        """Write ``arrivals`` as new shards and commit a version that has them beside the old ones."""
        before = self.version()
        at = f"{self.root}/shards/{uuid.uuid4().hex}"
        arrivals.write.option("compression", "zstd").parquet(at)
        return self._commit(before + 1, self.manifest(before).unionByName(self._described(at)))

    def compact(self) -> int:
        """Merge the tiers with at least ``fan`` shards and commit; the version stays if there is none."""
        before = self.version()
        old = self.manifest(before)
        tiers = [r.tier for r in old.where(F.col("bytes") < self.target).groupBy("tier").count().where(F.col("count") >= self.fan).orderBy("tier").collect()]
        if not tiers:
            return before
        merged = old.where(F.col("tier").isin(tiers) & (F.col("bytes") < self.target))
        new = old.join(merged.select("path"), "path", "left_anti").select("path", "bytes", "rows", "tier")
        for tier in tiers:  # few: the logarithm of the sizes' range
            runs = merged.where(F.col("tier") == tier).select("path", "bytes").collect()
            at = f"{self.root}/shards/{uuid.uuid4().hex}"
            files = max(1, -(-sum(r.bytes for r in runs) // self.target))
            self.spark.read.parquet(*[r.path for r in runs]).coalesce(files).write.option("compression", "zstd").parquet(at)
            new = new.unionByName(self._described(at))
        return self._commit(before + 1, new)


def arrive_and_compact(docs: DataFrame, root: str, arrivals: int = 4, **sizes) -> ShardStore:
    """Append ``docs`` in arrivals by a digest of doc_id, then compact once; columns and rows come back unchanged.

    A null doc_id belongs to arrival 0; repeated rows stay repeated. An empty table
    gives a store whose versions have no shard with rows.
    """
    store = ShardStore(docs.sparkSession, root, **sizes)
    for k in range(arrivals):
        store.append(docs.where(arrival(arrivals) == k))
    store.compact()
    return store


def arrival(arrivals: int):
    """Number of a row's arrival, from the first four hex digits of MD5 of doc_id."""
    return F.coalesce(F.conv(F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 4), 16, 10).cast("int") % arrivals, F.lit(0))


#: DuckDB SQL for op4_sharding.
SQL = """
select doc_id, coalesce(('0x' || substr(md5(doc_id::varchar), 1, 4))::int % 4, 0)::int arrival, sha256(coalesce(text, '')) text_sha256 from documents
"""
