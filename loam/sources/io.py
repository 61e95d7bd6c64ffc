"""Sources and sinks (A1-A8): JSONL, Parquet snapshots, keyed and partitioned sinks."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, SparkRuntimeException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


CORRUPT = "_corrupt_record"


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str | None = None, fail: bool = False) -> DataFrame:
    """A1: one JSON object per line; blank lines are skipped. A bad line keeps its text in
    ``_corrupt_record`` (added to a given schema), or with ``fail`` stops the job."""
    r = spark.read.option("mode", "FAILFAST" if fail else "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    if schema is not None:
        if isinstance(schema, str):
            schema = T.StructType.fromDDL(schema)
        if not fail and CORRUPT not in schema.names:
            schema = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
        r = r.schema(schema)
    return r.json(path)


def write_jsonl(df: DataFrame, path: str, overwrite: bool = True) -> None:
    """A2: JSON lines, overwrite or append; null fields are written as null, and an
    empty frame writes cleanly."""
    df.write.mode("overwrite" if overwrite else "append").option("ignoreNullFields", "false").json(path)


def count_lines(spark: SparkSession, path: str) -> int:
    """A3: number of lines (blank ones included), 0 when the path is missing."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hpath):
        return 0
    return spark.read.text(path).count()


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """A4: question bank ``question, options[], answer, category, src`` from Parquet."""
    return spark.read.parquet(path).select("item_id", "question", "options", "answer", "category", "src")


def save_snapshot(df: DataFrame, path: str, partition_col: str = "layer") -> None:
    """A5: activation snapshot as Parquet partitioned by layer (a layer filter prunes files)."""
    df.write.mode("overwrite").partitionBy(partition_col).parquet(path)


def save_bucketed(df: DataFrame, table: str, path: str, by: str = "sample", buckets: int = 64) -> None:
    """A5: activation snapshot as Parquet files dealt and sorted by the hash of ``by``, registered as the table
    ``table`` over ``path``. Such snapshots with the same number of buckets are joined and summed by ``by``
    without a shuffle of their rows; for joins on further keys besides ``by`` that takes the setting
    ``spark.sql.requireAllClusterKeysForCoPartition`` = false, as ``build_session`` has it. An existing table
    is replaced."""
    spark = df.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    # dealt like the buckets first, so that each is one file and not one per task
    df.repartition(buckets, by).write.format("parquet").mode("overwrite").bucketBy(buckets, by).sortBy(by).option(
        "path", path).saveAsTable(table)


def load_bucketed(spark: SparkSession, table: str, path: str | None = None, schema: T.StructType | None = None,
                  by: str = "sample", buckets: int = 64) -> DataFrame:
    """A5: the snapshot written by ``save_bucketed``. Another session names its ``path`` and ``schema`` and the
    same ``by`` and ``buckets``, and registers the files anew."""
    if not spark.catalog.tableExists(table):
        if path is None or schema is None:
            raise ValueError(f"{table} is not registered here: give its path and schema")
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS "
                  f"LOCATION '{path}'")
    return spark.table(table)


def load_snapshot(spark: SparkSession, path: str, layers: list[int] | None = None,
                  columns: list[str] | None = None, partition_col: str = "layer") -> DataFrame:
    """Read back only the named layers and columns (partition + column pruning)."""
    df = spark.read.parquet(path)
    if layers is not None:
        df = df.where(F.col(partition_col).isin(*layers))
    if columns is not None:
        df = df.select(*columns)
    return df


def read_id_list(spark: SparkSession, path: str, fail: bool = True) -> DataFrame:
    """Ids as JSON: a file that starts with ``[`` holds arrays, in any layout (one over many lines, or one
    per line); any other file one string per line, read in parallel. Blank lines are skipped.

    What does not parse stops the job, or without ``fail`` is a row with its text in ``_corrupt_record`` and
    a null id; so no id is lost without a word. A null in an array is a null id.
    """
    line = F.trim("value")
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), line.alias("line")).where("line <> ''")
    listed = [r[0] for r in lines.where(F.startswith("line", F.lit("["))).select("file").distinct().collect()]

    def ids(text: Column) -> Column:
        # an element that is no string or number, or cut off, makes the whole text null
        return F.from_json(text, "array<string>", {"mode": "PERMISSIVE"})

    single = lines.where(~F.col("file").isin(listed)) if listed else lines
    single = single.select("line", ids(F.concat(F.lit("["), "line", F.lit("]"))).alias("ids")).select(
        "line", F.when((F.size("ids") == 1) & F.col("ids")[0].isNotNull(), F.col("ids")).alias("ids"))
    if listed:
        whole = spark.read.text(listed, wholetext=True).select(F.trim(F.regexp_replace("value", r"^\s+|\s+$", "")).alias("line"))
        whole = whole.select("line", ids(F.col("line")).alias("ids"), F.regexp_count("line", F.lit(r"\]\s*\n\s*\[")).alias("more"))
        # several arrays one after another: each is a text of its own
        parts = whole.select(F.explode(F.when(F.col("more") == 0, F.array("line")).otherwise(
            F.split("line", r"(?<=\])\s*\n\s*(?=\[)"))).alias("line"))
        single = single.unionByName(parts.select("line", ids(F.col("line")).alias("ids")))
    if fail:
        bad = F.raise_error(F.concat(F.lit("no JSON id: "), F.substring("line", 1, 200)))
        return single.select(F.explode(F.when(F.col("ids").isNull(), bad).otherwise(F.col("ids"))).alias("sae_id"))
    return single.select(F.explode(F.coalesce("ids", F.array(F.lit(None).cast("string")))).alias("sae_id"),
                         F.when(F.col("ids").isNull(), F.col("line")).alias(CORRUPT))


def write_id_list(ids: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The form that ``read_id_list`` reads in parallel: one JSON string per line."""
    one = ids.select(F.col(ids.columns[0]).cast("string").alias("id"))
    one.select(F.expr("substring(to_json(array(id)), 2, length(to_json(array(id))) - 2)").alias("value")).write.mode(
        mode).text(path)


def write_keyed(df: DataFrame, path: str, fmt: str = "json", fallback: str = "parquet", key: str | None = None,
                order: str | None = None) -> tuple[str, str]:
    """One row per id; if the write fails, the fallback format is written beside it.
    Returns the format and the path that hold the rows.

    With ``key`` and ``order`` the last row of a repeated id stays (``order`` is dropped).
    """
    if key is not None and order is not None:
        rest = [c for c in df.columns if c not in (key, order)]
        df = df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_row")).select(key, "_row.*")
    try:
        df.write.mode("overwrite").format(fmt).save(path)
        return fmt, path
    except (AnalysisException, Py4JJavaError, SparkRuntimeException):
        other = path.rstrip("/") + "." + fallback
        df.write.mode("overwrite").format(fallback).save(other)
        return fallback, other


def artefact_name(*parts) -> F.Column:
    """Artefact name composed from the cell keys."""
    return F.concat_ws("_", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])


def write_partitioned(df: DataFrame, path: str, by: list[str]) -> None:
    """Result sink partitioned by the cell keys, with dynamic overwrite so a
    re-run replaces only its own cells."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path))

