"""Tables, columns and intermediate results that every executor can reach."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **types: str) -> DataFrame:
    """The named columns, cast, whatever else the table holds.

    Columns are found by position, so that extra columns whose names differ only
    in case, or that repeat, do no harm. The first column of a name counts.
    """
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"c{df.columns.index(name)}").cast(kind).alias(name) for name, kind in types.items()])


def scratch(spark: SparkSession) -> str:
    """The shared folder for intermediate files: spark.checkpoint.dir. Where it is unset, a local master gets a folder of its own; a cluster has none that is safe."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="marram-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


#: Bytes in memory for a byte of a compressed table: numbers of nodes in order and repeated names pack well.
UNPACKED = 16.0


#: Spark's setting that deletes the shuffle files of a query when it ends; else they wait for the driver to collect its garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def honest_sizes(spark: SparkSession) -> None:
    """Has Spark take a table for as large as it is in memory, not as its compressed files, so that no table that grows with the data passes for small and is broadcast through the driver. A factor of the user's own stays."""
    name = "spark.sql.sources.fileCompressionFactor"
    if float(spark.conf.get(name)) == 1.0:
        spark.conf.set(name, str(UNPACKED))


def _write(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    honest_sizes(df.sparkSession)
    path = f"{scratch(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    conf = df.sparkSession.conf
    kept = conf.get(SHUFFLES_GO, "false")
    conf.set(SHUFFLES_GO, "true")  # nothing reads this plan's shuffle files again
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.set(SHUFFLES_GO, kept)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def materialise(df: DataFrame, name: str = "step") -> DataFrame:
    """Writes a result into the shared folder and reads it back: this cuts the lineage and survives lost executors."""
    return _write(df, name)[0]


class Rounds:
    """The written results of an iteration. A result goes once so many later ones are written, as no plan at hand reads it then; with keep=None they stay until clear()."""

    def __init__(self, keep: int | None = 2):
        self.keep, self.paths = keep, []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        out, path = _write(df, name)
        self.paths.append(path)
        while self.keep is not None and len(self.paths) > self.keep:
            delete(df.sparkSession, self.paths.pop(0))
        return out

    def clear(self, spark: SparkSession) -> None:
        """Deletes what is left; nothing may read it any more."""
        while self.paths:
            delete(spark, self.paths.pop())


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder of intermediate files, in whatever store it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
