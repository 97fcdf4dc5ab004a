"""What the operators share: scratch tables, text normalisation, and a join that a hot key can't overload."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space, and tab to carriage return.
SPACES = "[\\x20\\x09-\\x0D]+"
SPACE_CHARS = " \t\n\x0b\f\r"
WORDS = "[^\\x20\\x09-\\x0D]+"

#: A key with over this share of the rows is hot; at most 1 / HOT_SHARE keys can be, which bounds what is broadcast.
HOT_SHARE = 1 / 1000
#: Tables of narrow rows are broadcast up to so many; larger ones are joined by a shuffle.
FEW_ROWS = 400_000
#: Bytes of an Arrow batch that goes to Python, and of the texts that are held at once there, or one row.
BATCH_BYTES = 1 << 20

_own_root: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a temporary one only in local mode, where driver and executors are one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_root:
        _own_root.append("file://" + tempfile.mkdtemp(prefix="tessera-"))
    return _own_root[0]


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def scratch(df: DataFrame, tag: str) -> DataFrame:
    """df written once to the shared folder and read again: lineage ends here, and lost executors cost nothing. The folder goes when
    the application ends, or before by discard()."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at, fs = _hadoop(spark, path)
    fs.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Deletes a scratch table that nothing reads any more."""
    path = getattr(df, "_scratch_path", None)
    if path:
        at, fs = _hadoop(df.sparkSession, path)
        fs.delete(at, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until none is a column of df."""
    out = []
    for name in names:
        while name.lower() in {c.lower() for c in df.columns} or name in out:
            name += "_"
        out.append(name)
    return out


def kept_rows(rows: DataFrame, keys: list[Column], table: DataFrame, how: str) -> DataFrame:
    """The rows whose keys are in `table` (how: left_semi) or are not (left_anti), compared with nulls as equal; columns as they were.

    `table` is a scratch table with a column for each key, in order. Up to FEW_ROWS it is broadcast, so the rows stay where they are.
    """
    names = fresh(rows, *[f"_key{i}" for i in range(len(keys))])
    there = [f"{n}_there" for n in fresh(rows, *[f"_table{i}" for i in range(len(keys))])]
    marked = rows.select("*", *[k.alias(n) for k, n in zip(keys, names, strict=True)])
    right = table.toDF(*there)
    same = [marked[n].eqNullSafe(right[t]) for n, t in zip(names, there, strict=True)]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    right = F.broadcast(right) if table.count() <= FEW_ROWS else right.hint("shuffle_hash")
    return marked.join(right, condition, how).drop(*names)


def one_of_each(rows: DataFrame, keys: list[Column]) -> DataFrame:
    """One row for each combination of keys, the same one in every run: the least by a digest of the columns that can be hashed."""
    names = fresh(rows, *[f"_key{i}" for i in range(len(keys))])
    plain = [c for c, kind in rows.dtypes if not re.search("map<|variant", kind)]
    marked = rows.select(*[k.alias(n) for k, n in zip(keys, names, strict=True)], F.struct(*[rows[c] for c in rows.columns]).alias("_row"), F.xxhash64(*[rows[c] for c in plain]).alias("_place"))
    return marked.groupBy(*names).agg(F.min_by("_row", "_place").alias("_row")).select("_row.*")


def hold_batches(spark: SparkSession) -> None:
    """Arrow batches to Python end at BATCH_BYTES, so that what a task holds doesn't grow with the length of the rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def in_pieces(batch: pa.RecordBatch, column: int, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose texts in `column` have at most `most` bytes together, or one row."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def whole(c: str | Column) -> Column:
    """A text column with null as empty."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORDS)).cast("long")


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], weight: str, rows: int, how: str = "inner") -> DataFrame:
    """left joined with right on keys, where right is a scratch table that has each key once and weight counts the key's rows on the left.

    Up to FEW_ROWS right is broadcast. Beyond that keys with over HOT_SHARE of `rows` are at most 1 / HOT_SHARE many, so they are
    broadcast and their left rows stay where they are; all other keys are joined by a shuffle in which no key has more than that share.
    """
    if right.count() <= FEW_ROWS:
        return left.join(F.broadcast(right), keys, how)
    limit = max(1.0, rows * HOT_SHARE)
    hot = F.broadcast(right.filter(F.col(weight) > limit))
    cold = right.filter(F.col(weight) <= limit)
    rest = left.join(F.broadcast(right.filter(F.col(weight) > limit).select(*keys)), keys, "left_anti")
    return left.join(hot, keys, "inner").unionByName(rest.join(cold, keys, how), allowMissingColumns=True)


def thinned(rows: DataFrame, keys: list[Column], odd: DataFrame) -> DataFrame:
    """rows without those whose keys `odd` marks as not staying; of several rows with keys that stay, one is left.

    odd is a scratch table: a column for each key, then `stays`. It needs only the keys that don't stay or that several rows have.
    """
    gone, again = odd.filter("NOT stays").drop("stays"), odd.filter("stays").drop("stays")
    out = kept_rows(rows, keys, gone, "left_anti")
    if again.isEmpty():
        return out
    return kept_rows(out, keys, again, "left_anti").unionByName(one_of_each(kept_rows(rows, keys, again, "left_semi"), keys))
