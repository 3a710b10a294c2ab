"""Edge lists and MatrixMarket files as Spark tables, and result tables in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def read_matrix_market(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """Pairs (u, v, from 0) of a coordinate matrix, and its number of rows. Values are ignored; a line that starts with % is a comment, and the first other line is the shape."""
    lines = spark.read.text(path).where("not startswith(value, '%') and trim(value) <> ''").select("value", F.monotonically_increasing_id().alias("line"))
    shape = lines.agg(F.min_by("value", "line").alias("value"), F.min("line").alias("line")).first()
    part = F.split(F.trim("value"), r"\s+")
    data = lines.where(F.col("line") != shape["line"])
    return data.select((part[0].cast("long") - 1).alias("u"), (part[1].cast("long") - 1).alias("v")), int(shape["value"].split()[0])


def read_edge_list(spark: SparkSession, path: str, comment: str = "%") -> DataFrame:
    """Pairs (u, v) of a text file with two ids a line; lines that start with the comment sign are left out."""
    part = F.split(F.trim("value"), r"[\s,]+")
    lines = spark.read.text(path).where(~F.col("value").startswith(comment) & (F.trim("value") != ""))
    return lines.select(part[0].cast("long").alias("u"), part[1].cast("long").alias("v"))


def list_networks(spark: SparkSession, folder: str) -> dict[str, str]:
    """Name (the file's, without its ending) and path of each .mtx and .edges file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{mtx,edges}").load(folder).select("path")
    return {r[0].rsplit("/", 1)[1].rsplit(".", 1)[0]: r[0] for r in files.collect()}  # one row per network


def read_network(spark: SparkSession, path: str) -> DataFrame:
    """Pairs of a network file by its ending: .mtx, .edges (comments with %) or another list (comments with #)."""
    if path.endswith(".mtx"):
        return read_matrix_market(spark, path)[0]
    return read_edge_list(spark, path, "%" if path.endswith(".edges") else "#")


def read_nodes(spark: SparkSession, path: str) -> DataFrame | None:
    """(node) of all nodes that a network file says it has, with ties or without; None for files that only list ties."""
    if not path.endswith(".mtx"):
        return None
    return spark.range(read_matrix_market(spark, path)[1]).withColumnRenamed("id", "node")


def read_pairs(spark: SparkSession, path: str, fmt: str = "parquet", u: str = "u", v: str = "v", **options: str) -> DataFrame:
    """Pairs from any format Spark reads; raises ValueError if a column is missing."""
    df = spark.read.options(**options).format(fmt).load(path)
    if missing := {u, v} - set(df.columns):
        raise ValueError(f"{path}: no column {sorted(missing)}")
    return df.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v"))


def write_scores(scores: DataFrame, path: str) -> None:
    """Adds or replaces the partitions (graph_id, method) that the scores hold, and no others."""
    scores.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("graph_id", "method").parquet(path)


def read_scores(spark: SparkSession, path: str, aliases: dict[str, str] | None = None) -> DataFrame:
    """Stored scores; methods stored under an older name get the present one."""
    scores = spark.read.parquet(path)
    for old, new in (aliases or {}).items():
        scores = scores.withColumn("method", F.when(F.col("method") == old, new).otherwise(F.col("method")))
    return scores


def missing_scores(scores: DataFrame, expected: DataFrame) -> DataFrame:
    """(graph_id, method) expected with n nodes that are absent or don't have that many finite scores. expected: graph_id, method, n."""
    have = scores.where("score is not null and not isnan(score)").groupBy("graph_id", "method").agg(F.count_distinct("node").alias("have"))
    return expected.join(have, ["graph_id", "method"], "left").where("coalesce(have, 0) <> n").select("graph_id", "method", "n", F.coalesce("have", F.lit(0)).alias("have"))


def write_table(df: DataFrame, path: str, fmt: str = "csv", float_format: str | None = None) -> None:
    """A result table as CSV with a header, or in another format Spark writes; float_format (like %.6f) writes floating columns as such text, null as null."""
    if float_format is not None:
        df = df.select(*[F.when(F.col(c).isNotNull(), F.format_string(float_format, F.col(c).cast("double"))).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])
    writer = df.write.mode("overwrite")
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


def read_table(spark: SparkSession, path: str, schema: str, fmt: str = "csv") -> DataFrame:
    """A result table with a given schema; raises ValueError if a column of it is not in the file."""
    if fmt == "csv":
        names = spark.read.option("header", True).csv(path).columns
        wanted = spark.createDataFrame([], schema).columns
        if missing := set(wanted) - set(names):
            raise ValueError(f"{path}: no column {sorted(missing)}")
        return spark.read.option("header", True).csv(path).selectExpr(*[f"cast(`{f.name}` as {f.dataType.simpleString()}) as `{f.name}`" for f in spark.createDataFrame([], schema).schema])
    return spark.read.schema(schema).format(fmt).load(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, length and sha256 of every file below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def markdown(df: DataFrame, digits: int = 4) -> str:
    """A small result table as Markdown text."""
    rows = [[f"{x:.{digits}f}" if isinstance(x, float) else "" if x is None else str(x) for x in r] for r in df.collect()]
    return "\n".join("| " + " | ".join(r) + " |" for r in [df.columns, ["---"] * len(df.columns), *rows])


#: What LaTeX reads as commands, and how it is written.
_ESCAPES = {"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}


def latex(df: DataFrame, digits: int = 4) -> str:
    """A small result table as a LaTeX tabular: numbers to the right, text to the left, null empty."""
    escaped = lambda x: "".join(_ESCAPES.get(c, c) for c in x)
    cell = lambda x: f"{x:.{digits}f}" if isinstance(x, float) else "" if x is None else escaped(str(x))
    sides = "".join("l" if t in ("string", "boolean") else "r" for _, t in df.dtypes)
    lines = [" & ".join(map(cell, r)) + r" \\" for r in df.collect()]
    return "\n".join([rf"\begin{{tabular}}{{{sides}}}", r"\hline", " & ".join(map(escaped, df.columns)) + r" \\", r"\hline", *lines, r"\hline", r"\end{tabular}"])
