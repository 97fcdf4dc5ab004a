"""Files in and out: text-only CSV with literals for null, JSON arrays, dated folders, load-once targets, position and origin of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Texts that a landing file uses for null.
NULLS = ("", "NULL", "null")
#: Rows of a JSON array at most.
ARRAY_ROWS = 100_000


def read_text_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header names, every value as text, empty values as empty text; nothing is inferred."""
    return spark.read.csv(path, header=True, inferSchema=False).fillna("")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema, mode="PERMISSIVE")


def read_multiline_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Quoted values may hold line feeds; an unquoted empty value is null, "" is empty text."""
    return spark.read.csv(path, header=True, schema=schema, multiLine=True, quote='"', escape='"', nullValue="", emptyValue="")


def nulls(c: str | Column) -> Column:
    t = F.trim(F.col(c) if isinstance(c, str) else c)
    return F.when(~t.isin(*NULLS), t)


def landed(spark: SparkSession, path: str, columns: list[str], loaded_at: Column) -> DataFrame:
    """Rows by position, with source_file, source_row, loaded_at and load_batch_id.

    Row numbers count within each file; the window is over one file's rows at a time.
    """
    schema = ", ".join(f"{c} string" for c in columns)
    raw = spark.read.csv(path, schema=schema, header=True, enforceSchema=True).select("*", F.col("_metadata.file_path").alias("_path"), F.monotonically_increasing_id().alias("_at"))
    name = F.element_at(F.split("_path", "/"), -1)
    out = raw.select(*[nulls(c).alias(c) for c in columns], name.alias("source_file"), F.row_number().over(Window.partitionBy("_path").orderBy("_at")).cast("long").alias("source_row"), loaded_at.alias("loaded_at"))
    return out.withColumn("load_batch_id", F.md5(F.concat_ws("|", "source_file", F.col("loaded_at").cast("string"))))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True, mode="errorifexists")


def json_array(df: DataFrame, order: list[str], most: int = ARRAY_ROWS) -> DataFrame:
    """One row with the exact JSON array of a small table (a report); over `most` rows raise ValueError: large tables go out as a line
    for each row, by write_json_lines."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"over {most} rows are too many for one array")
    item = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    return df.agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], item.alias("j")))), lambda x: x["j"]), ","), F.lit("]")).alias("json"))


def write_json_lines(df: DataFrame, path: str) -> None:
    """A JSON object on each line, nulls written out; each task writes its own rows."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})).write.text(path)


def json_name(path: str) -> str:
    """The name of the JSON file of a CSV file."""
    return path.removesuffix(".csv") + ".json"


def is_safe_name(name: str | Column) -> Column:
    """Whether a file's name is made of letters, digits, dots, hyphens and underscores only."""
    return (F.col(name) if isinstance(name, str) else name).rlike(r"\A[A-Za-z0-9._-]+\z")


def write_dated(df: DataFrame, path: str, ts: str) -> None:
    """year=/month=/day= folders, which later reads prune."""
    d = df.withColumns({"year": F.date_format(ts, "yyyy"), "month": F.date_format(ts, "MM"), "day": F.date_format(ts, "dd")})
    d.repartition("year", "month", "day").write.partitionBy("year", "month", "day").parquet(path)


def load_once(df: DataFrame, path: str) -> None:
    """Refuses a target that exists."""
    df.write.mode("errorifexists").parquet(path)


def publish(df: DataFrame, path: str, check: Column) -> DataFrame:
    """Writes beside the target, verifies what was written, and only then puts it in place; a failed check leaves the target alone."""
    spark = df.sparkSession
    aside = f"{path}.new"
    df.write.mode("overwrite").parquet(aside)
    bad = spark.read.parquet(aside).filter(~F.coalesce(check, F.lit(False))).count()
    at = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if bad or fs.exists(at(path)):
        fs.delete(at(aside), True)
        raise ValueError(f"{bad} rows fail the check" if bad else f"{path} exists already")
    fs.rename(at(aside), at(path))
    return spark.read.parquet(path)


def convert_new_files(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str):
    """Each CSV file that arrives is written once as JSON lines; a restart goes on where it stopped."""
    stream = spark.readStream.schema(schema).option("header", True).csv(source)
    return stream.writeStream.format("json").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
