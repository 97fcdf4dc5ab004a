"""An evolving table fed by micro-batches, with dead letters and an audit.

Each batch is written under its own id, so a batch that runs again after a failure replaces itself: delivery is at least once, the
table holds each delivered message once for each delivery, and reads of one copy use the keys of the message. New fields become
columns; a value that doesn't fit its column's type sends that row, not the batch, to the dead letters.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.streaming import messages
from tessera.streaming.upkeep import with_retries

#: The columns that the table starts with.
KNOWN = {"EVENT_ID": "string", "EVENT_TIME": "timestamp", "ORDER_ID": "string", "CUSTOMER_ID": "bigint", "PRODUCT": "string", "QUANTITY": "bigint", "UNIT_PRICE": "double", "STATUS": "string"}
#: A batch may bring so many new columns at once.
MOST_NEW = 100


@dataclass(frozen=True)
class Result:
    """What became of a part of a batch, or of the whole."""

    loaded: int
    rejected: int
    new_columns: tuple[str, ...]
    parts: int = 1

    @property
    def status(self) -> str:
        if not self.rejected:
            return "LOADED"
        return "PARTIALLY_LOADED" if self.loaded else "LOAD_FAILED"


def combined(results: list[Result]) -> Result:
    return Result(sum(r.loaded for r in results), sum(r.rejected for r in results), tuple(c for r in results for c in r.new_columns), sum(r.parts for r in results))


def parts_of(new_columns: list[str], limit: int) -> dict[str, int]:
    """Columns in the order in which they first appear, dealt to parts of `limit` each. A record belongs to the last part of its columns, so a
    part, loaded after those before it, brings `limit` new columns at most."""
    return {c: i // limit for i, c in enumerate(new_columns)}


def type_of(text: Column) -> Column:
    """Type of a new column from a value: numbers are doubles from the start, since a column never widens; nested values stay text."""
    kind = F.schema_of_variant(F.try_parse_json(text))
    return F.when(text.isin("true", "false"), "boolean").when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), "double").otherwise("string")


def cast_to(text: Column, kind: str) -> Column:
    if kind == "bigint":
        return F.when(text.rlike(r"^-?[0-9]+$"), text.try_cast("bigint"))
    if kind == "double":
        return F.when(text.rlike(r"^-?[0-9]"), text.try_cast("double"))
    return text if kind == "string" else text.try_cast(kind)


@dataclass
class Loader:
    """root: a folder that all executors share; data, dead letters, audit and schema log live below it."""

    spark: SparkSession
    root: str
    most_new: int = MOST_NEW
    #: Arguments of upkeep.with_retries; without any, a failure ends the query, which goes on from its checkpoint when started again.
    retries: dict = field(default_factory=dict)

    def _schema_log(self) -> dict[str, str]:
        try:
            rows = self.spark.read.schema("column string, kind string, batch_id long").json(f"{self.root}/schema_log/*").collect()  # a row for each column
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            rows = []
        return dict(KNOWN) | {r.column: r.kind for r in sorted(rows, key=lambda r: -r.batch_id)}

    def _clear(self, folder: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def load(self, batch: DataFrame, batch_id: int) -> Result:
        """Loads a batch, in parts if it brings over most_new columns. A part that holds other than its rows is a failure: the batch then
        stays uncommitted and runs again."""
        rows = messages.with_metadata(messages.parsed(batch), F.current_timestamp()).persist()
        try:
            known = {c: k for c, k in self._schema_log().items()}
            fresh = F.array_except(F.map_keys("fields"), F.array(*map(F.lit, known)))
            rows2 = rows.withColumn("reject_reason", F.coalesce("reject_reason", F.when(F.size(fresh) > self.most_new, f"message brings over {self.most_new} new fields")))
            good = rows2.filter("reject_reason IS NULL")
            entries = good.select(F.struct("_KAFKA_PARTITION", "_KAFKA_OFFSET").alias("at"), F.explode(F.map_filter("fields", lambda k, _: ~k.isin(list(known)))).alias("column", "text"))
            # a row for each new column; all values of a type vote for it, mixed ones make text
            kinds = F.collect_set(type_of(F.col("text")))
            new = entries.groupBy("column").agg(kinds.alias("kinds"), F.min("at").alias("at")).select("column", "at", F.when(F.size("kinds") == 1, F.col("kinds")[0]).otherwise("string").alias("kind"))
            added = {r.column: r.kind for r in new.orderBy("at", "column").collect()}
            columns, part_of = known | added, parts_of(list(added), self.most_new)
            casts = {c: cast_to(F.col("fields")[c], k) for c, k in columns.items()}
            conflict = F.array_compact(F.array(*[F.when(F.col("fields")[c].isNotNull() & v.isNull(), F.lit(c)) for c, v in casts.items()]))
            judged = rows2.withColumn("_bad", F.when(F.col("reject_reason").isNull(), conflict))
            judged = judged.withColumn("reject_reason", F.coalesce("reject_reason", F.when(F.size("_bad") > 0, F.concat(F.lit("value does not fit column "), F.array_join("_bad", ", ")))))
            own = F.lit(0)
            if len(set(part_of.values())) > 1:
                places = F.create_map(*[F.lit(x) for pair in part_of.items() for x in pair])
                own = F.coalesce(F.array_max(F.transform(F.array_intersect(F.map_keys("fields"), F.map_keys(places)), lambda c: places[c])), F.lit(0))
            judged = judged.withColumn("_part", own).persist()
            good = judged.filter("reject_reason IS NULL")
            dead = judged.filter("reject_reason IS NOT NULL").select("key", "value", "reject_reason", *messages.METADATA[:4])
            at = f"batch_id={batch_id}"
            self._clear(f"{self.root}/data/{at}")  # of an attempt that failed
            expected = {r["_part"]: r["count"] for r in good.groupBy("_part").count().collect()}
            results = []
            for part in sorted({0, *part_of.values()}):
                there = [c for c in columns if part_of.get(c, 0) <= part]
                folder = f"{self.root}/data/{at}/load_part={part}"
                good.filter(F.col("_part") == part).select(*[casts[c].alias(c) for c in there], *messages.METADATA).write.mode("overwrite").parquet(folder)
                loaded = self.spark.read.parquet(folder).count()
                if loaded != expected.get(part, 0):
                    raise RuntimeError(f"part {part} of batch {batch_id} holds {loaded} rows of {expected.get(part, 0)}")
                results.append(Result(loaded, 0, tuple(c for c, p in part_of.items() if p == part)))
            dead.write.mode("overwrite").parquet(f"{self.root}/dead/{at}")
            if added:
                log = self.spark.createDataFrame([(c, k, batch_id) for c, k in added.items()], "column string, kind string, batch_id long")
                log.coalesce(1).write.mode("overwrite").json(f"{self.root}/schema_log/{at}")
            counts = judged.agg(F.count("*").alias("received"), F.count_if(F.col("reject_reason").isNull()).alias("loaded"), F.count_if(F.col("reject_reason").isNotNull()).alias("rejected"), F.min("_KAFKA_OFFSET").alias("first_offset"), F.max("_KAFKA_OFFSET").alias("last_offset"))
            total = combined([*results, Result(0, counts.first().rejected, (), 0)])
            counts.withColumns({"new_columns": F.lit(",".join(total.new_columns)), "parts": F.lit(total.parts), "status": F.lit(total.status)}).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/audit/{at}")
            judged.unpersist()
            return total
        finally:
            rows.unpersist()

    def table(self) -> DataFrame:
        """All loaded rows with all columns that ever appeared; older rows have nulls in newer ones."""
        return self.spark.read.option("mergeSchema", "true").parquet(f"{self.root}/data")

    def dead_letters(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/dead")

    def audit(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/audit")

    def unique_events(self) -> DataFrame:
        """One copy of each message, by its id or else its coordinates; columns are those by name that the table started with."""
        from tessera.operators.windows import latest

        t = self.table().withColumn("_key", F.coalesce("EVENT_ID", F.concat_ws(":", "_KAFKA_TOPIC", "_KAFKA_PARTITION", "_KAFKA_OFFSET")))
        return latest(t, ["_key"], [F.col("_INGESTED_AT"), F.col("_KAFKA_PARTITION"), F.col("_KAFKA_OFFSET")]).select(*KNOWN, *messages.METADATA)

    def run(self, source: DataFrame, once: bool = True):
        """Starts the query; offsets are committed only when a batch's writes have returned."""
        w = source.writeStream.foreachBatch(lambda batch, i: with_retries(lambda: self.load(batch, i), **self.retries) if self.retries else self.load(batch, i)).option("checkpointLocation", f"{self.root}/checkpoint")
        return (w.trigger(availableNow=True) if once else w.trigger(processingTime="5 seconds")).start()
