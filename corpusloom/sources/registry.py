"""File registry: the status of every uploaded document.

Plain parquet with versions: each commit writes a complete new version folder
and readers take the newest one that carries a success marker, so a failed
commit is never seen and readers of the old version go on undisturbed.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STATUSES = ["pending", "indexing", "indexed", "failed"]


def all_documents(registry: DataFrame) -> DataFrame:
    """Newest first."""
    return registry.orderBy(F.desc("created_at"), F.asc("id"))


def pending_documents(registry: DataFrame) -> DataFrame:
    return registry.filter(F.col("status") == "pending")


def documents_by_id(registry: DataFrame, ids: DataFrame) -> DataFrame:
    return registry.join(ids.select("id"), "id", "left_semi")


def upsert_registry(registry: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """Apply status changes and creations.

    ``changes(id, status, chunk_count, error_message, filename, path,
    size_bytes)``: NULL leaves the stored value; an unknown id is created
    (status pending unless given); ``updated_at`` moves for changed rows only.
    """
    new = changes.select("id", *[F.col(c).alias(f"_{c}") for c in changes.columns if c != "id"], F.lit(True).alias("_hit"))
    joined = registry.withColumn("_old", F.lit(True)).join(new, "id", "full_outer")
    given = set(changes.columns)

    def merged(name: str, default: Column | None = None) -> Column:
        value = F.coalesce(f"_{name}", name) if name in given else F.col(name)
        return (F.coalesce(value, default) if default is not None else value).alias(name)

    stamp = now.cast("timestamp")
    return joined.select(
        "id",
        merged("filename"),
        merged("path"),
        merged("size_bytes"),
        merged("status", F.lit("pending")),
        merged("chunk_count", F.lit(0).cast("bigint")),
        merged("error_message"),
        F.coalesce("created_at", stamp).alias("created_at"),
        F.when(F.col("_hit"), stamp).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def delete_documents(registry: DataFrame, ids: DataFrame) -> DataFrame:
    return registry.join(ids.select("id"), "id", "left_anti")


def _versions(spark: SparkSession, path: str) -> list[int]:
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    done = []
    for entry in fs.listStatus(root):
        name = entry.getPath().getName()
        marker = spark._jvm.org.apache.hadoop.fs.Path(entry.getPath(), "_SUCCESS")
        if name.startswith("v=") and fs.exists(marker):
            done.append(int(name[2:]))
    return sorted(done)


class RegistryConflict(RuntimeError):
    """Another writer has committed since the version was read."""


def latest_version(spark: SparkSession, path: str) -> int:
    """Number of the newest version, 0 if there is none."""
    return max(_versions(spark, path), default=0)


def commit_registry(registry: DataFrame, path: str, base: int | None = None, applied: dict[str, int] | None = None) -> int:
    """Write the version after ``base`` (the newest one unless given); returns its number.

    ``applied`` names the last batch of each stream that the version contains;
    it is stored inside the version, so both become visible together.

    The rows go to a private folder that is renamed into place. A rename onto a
    version that exists fails, so of two writers that read the same version one
    commits and the other gets ``RegistryConflict``: it reads again and retries.
    """
    spark = registry.sparkSession
    version = (latest_version(spark, path) if base is None else base) + 1
    private = f"{path}/_new-{uuid.uuid4().hex}"
    registry.write.mode("errorifexists").parquet(private)
    if applied:
        spark.createDataFrame(sorted(applied.items()), APPLIED).coalesce(1).write.parquet(f"{private}/_applied")
    hadoop = spark._jvm.org.apache.hadoop.fs
    source, target = hadoop.Path(private), hadoop.Path(f"{path}/v={version}")
    conf = spark._jsc.hadoopConfiguration()
    files = hadoop.FileContext.getFileContext(source.getFileSystem(conf).getUri(), conf)
    never_overwrite = spark._sc._gateway.new_array(hadoop.Options.Rename, 1)
    never_overwrite[0] = hadoop.Options.Rename.NONE
    try:
        files.rename(source, target, never_overwrite)
    except Py4JJavaError as failed:
        files.delete(source, True)
        raise RegistryConflict(f"version {version} of {path} could not be taken") from failed
    return version


APPLIED = "stream string, batch bigint"


def applied_batches(spark: SparkSession, path: str, version: int) -> dict[str, int]:
    """Last batch of each stream that a version contains: one row per stream."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v={version}/_applied")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return {}
    return {r["stream"]: r["batch"] for r in spark.read.schema(APPLIED).parquet(str(folder)).collect()}


def apply_batch(spark: SparkSession, path: str, changes: DataFrame, now: Column, stream: str, batch: int, attempts: int = 10) -> bool:
    """Apply a stream's batch of status changes once; False if the registry contains it already.

    Batches of one stream come in order, so the last number is enough to know a
    replay. If another writer takes the version, the batch is applied to the
    version that this writer has made.
    """
    for _ in range(attempts):
        version = latest_version(spark, path)
        applied = applied_batches(spark, path, version)
        if batch <= applied.get(stream, -1):
            return False
        changed = upsert_registry(spark.read.parquet(f"{path}/v={version}"), changes, now)
        try:
            commit_registry(changed, path, version, {**applied, stream: batch})
            return True
        except RegistryConflict:
            continue
    raise RegistryConflict(f"batch {batch} of {stream} found another writer {attempts} times")


def read_file_registry(spark: SparkSession, path: str) -> DataFrame:
    done = _versions(spark, path)
    if not done:
        raise FileNotFoundError(f"no registry version under {path}")
    return spark.read.parquet(f"{path}/v={done[-1]}")
