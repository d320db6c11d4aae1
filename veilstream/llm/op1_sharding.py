"""Sharding: small immutable shards, size-tiered compaction and a versioned manifest committed atomically.

A shard table is a folder: ``data/`` holds immutable Parquet files, ``manifests/<id>/`` the list of live files of one
version, and ``commits/v<number>`` a marker file naming the manifest of that version. A writer prepares everything
under fresh names and then renames its marker into place; the rename fails if the version exists, so one of two
concurrent writers wins. The other commits what it has written upon the winner's version; only where that has merged shards
that were to be merged here, ``CommitConflict`` is raised. Readers see whole versions only. Files that no committed
manifest names are garbage of lost writers; ``vacuum`` deletes them, and is to be run while nothing is written.

``append`` writes what arrives without a shuffle, at most ``rows_per_shard`` rows a file. ``compact`` puts the live
shards into tiers by size (a factor of ``fanout`` each), cuts each tier into runs of up to ``target_bytes`` in file order
and merges the runs of at least ``min_runs`` shards, or of half a target, into one file each: one task a run, one
shuffle of the merged rows. Larger shards stay as they are. Row data is moved by DataFrame operations alone.

Defined results: every row and column is kept as it is, nulls, empty texts and repeated rows too; tables without
rows have a committed version without files. Column names starting with ``__shard_`` are reserved.
"""

from __future__ import annotations

import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilstream.session import work_dir

MANIFEST = "file string, bytes long, rows long"
TARGET_BYTES = 128 << 20
#: Smallest tier: shards below this size share tier 0.
BASE_BYTES = 1 << 20
FANOUT = 4
MIN_RUNS = 4
ROWS_PER_SHARD = 2048
#: Plans of up to this many shards are broadcast (about 200 bytes each); longer ones are joined by shuffle.
BROADCAST_SHARDS = 20_000


class CommitConflict(RuntimeError):
    """Another writer committed this version first."""


class ShardTable:
    """A folder of shards under a versioned manifest."""

    def __init__(self, spark: SparkSession, path: str, schema):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        jvm = spark.sparkContext._jvm
        self._jvm, self._conf = jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._root = jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._root.getFileSystem(self._conf)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def version(self) -> int:
        """The last committed version; 0 before the first."""
        at = self._at("commits")
        if not self._fs.exists(at):
            return 0
        return max([0, *(int(m[1]) for s in self._fs.listStatus(at) if (m := re.fullmatch(r"v(\d+)", s.getPath().getName())))])

    def manifest(self, version: int | None = None) -> DataFrame:
        """(file, bytes, rows) of the live shards of a version."""
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], MANIFEST)
        stream = self._fs.open(self._at(f"commits/v{version:09d}"))
        name = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifests/{name}")

    def _commit(self, version: int, live: DataFrame) -> int:
        """Make ``live`` the version after ``version``, or raise CommitConflict."""
        name = uuid.uuid4().hex
        live.coalesce(1).write.parquet(f"{self.path}/manifests/{name}")
        draft, marker = self._at(f"commits/.draft-{name}"), self._at(f"commits/v{version + 1:09d}")
        self._fs.mkdirs(self._at("commits"))
        out = self._fs.create(draft, False)
        out.write(name.encode())
        out.close()
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self._conf)
        none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        none[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            files.rename(self._fs.makeQualified(draft), self._fs.makeQualified(marker), none)
        except Py4JJavaError as e:
            self._fs.delete(draft, False)
            self._fs.delete(self._at(f"manifests/{name}"), True)
            if "FileAlreadyExists" in str(e.java_exception):
                raise CommitConflict(f"version {version + 1} of {self.path}") from e
            raise
        return version + 1

    def _commit_upon(self, version: int, added: DataFrame, merged: DataFrame | None = None, n: int = 0) -> int:
        """Commit a version's shards without the ``n`` ``merged`` ones and with the ``added`` ones; upon the last version, if another writer comes first."""
        same = F.col("file") == F.col("__shard_file")
        while True:
            live = self.manifest(version)
            try:
                return self._commit(version, (live if merged is None else live.join(merged, same, "left_anti")).unionByName(added))
            except CommitConflict:
                version = self.version()
                if merged is not None and self.manifest(version).join(merged, same, "left_semi").count() < n:
                    raise

    def _shards(self, folder: str) -> DataFrame:
        """What a finished write left in a folder below data/."""
        files = self.spark.read.schema(self.schema).parquet(f"{self.path}/data/{folder}")
        return files.groupBy(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes")).agg(F.count("*").alias("rows"))

    def append(self, df: DataFrame, rows_per_shard: int = ROWS_PER_SHARD) -> int:
        """Add rows as small shards, without a shuffle; returns the version. Rows are written once, however many writers come first."""
        folder = f"a-{uuid.uuid4().hex}"
        df.write.option("maxRecordsPerFile", rows_per_shard).option("compression", "zstd").parquet(f"{self.path}/data/{folder}")
        return self._commit_upon(self.version(), self._shards(folder))

    def plan(self, version: int, target_bytes: int, fanout: int, min_runs: int, base_bytes: int) -> DataFrame:
        """(file, run) for the shards to merge; runs count from 0. The window is over the manifest, not over rows."""
        return self.spark.sql(
            f"""
            WITH tiers AS (
              SELECT file, bytes, CAST(floor(log({fanout}, greatest(bytes, {base_bytes}) / {base_bytes})) AS INT) AS tier
              FROM {{live}} WHERE bytes < {target_bytes} / 2),
            cut AS (
              SELECT *, CAST(floor((sum(bytes) OVER (PARTITION BY tier ORDER BY bytes, file ROWS UNBOUNDED PRECEDING) - bytes) / {target_bytes}) AS BIGINT) AS part
              FROM tiers),
            sized AS (SELECT *, count(*) OVER (PARTITION BY tier, part) AS shards, sum(bytes) OVER (PARTITION BY tier, part) AS total FROM cut)
            SELECT file, CAST(dense_rank() OVER (ORDER BY tier, part) - 1 AS INT) AS run
            FROM sized WHERE shards >= {min_runs} OR (shards > 1 AND total >= {target_bytes} / 2)""",
            live=self.manifest(version),
        )

    def compact(self, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT, min_runs: int = MIN_RUNS, base_bytes: int = BASE_BYTES) -> int:
        """Merge one round of runs; returns the version, which stays where nothing is to be merged."""
        version = self.version()
        todo = self.plan(version, target_bytes, fanout, min_runs, base_bytes).collect()  # file names, not rows
        if not todo:
            return version
        runs = 1 + max(r["run"] for r in todo)
        plan = self.spark.createDataFrame([(r["file"], r["run"]) for r in todo], "__shard_file string, __shard_run int")
        rows = self.spark.read.schema(self.schema).parquet(*[r["file"] for r in todo]).withColumn("__shard_of", F.col("_metadata.file_path"))
        if len(todo) <= BROADCAST_SHARDS:
            plan = F.broadcast(plan)
        merged = rows.join(plan, F.col("__shard_of") == F.col("__shard_file")).repartitionById(runs, F.col("__shard_run")).drop("__shard_of", "__shard_file", "__shard_run")
        folder = f"m-{uuid.uuid4().hex}"
        merged.write.option("compression", "zstd").parquet(f"{self.path}/data/{folder}")
        return self._commit_upon(version, self._shards(folder), plan, len(todo))

    def compact_all(self, **options) -> int:
        """Rounds until no run is left to merge; each round at least halves the number of shards that it touches."""
        version = self.version()
        while (after := self.compact(**options)) != version:
            version = after
        return version

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version."""
        files = [r["file"] for r in self.manifest(version).select("file").collect()]
        return self.spark.read.schema(self.schema).parquet(*files) if files else self.spark.createDataFrame([], self.schema)

    def vacuum(self) -> int:
        """Delete files that the last version doesn't name; older versions can't be read afterwards."""
        live = {r["file"].rpartition("/data/")[2] for r in self.manifest().select("file").collect()}
        gone, walk = 0, self._fs.listFiles(self._at("data"), True)
        while walk.hasNext():
            at = walk.next().getPath()
            if at.toString().rpartition("/data/")[2] not in live:
                gone += self._fs.delete(at, False)
        return gone


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents appended, compacted and read back through the manifest: each row with a digest of its text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    table = ShardTable(spark, work_dir(spark, "shards"), docs.schema)
    table.append(docs)
    table.compact_all()
    return table.read().select(
        "doc_id", "lang", "source", "n_chars",
        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
    )


ORACLE = "SELECT doc_id, lang, source, n_chars, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes, sha256(text) AS text_sha256 FROM documents"
QUERIES = {"op1_sharding": op1_sharding}
ORACLES = {"op1_sharding": ORACLE}
