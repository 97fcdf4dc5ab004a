"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents, in a fixed shuffled order, are one stream of words cut into equal blocks. Slot n of the mix lies at the
fractional part of n times the golden ratio; the cumulative target shares say which source it falls to, and the k-th slot of a
source reads its k-th block, starting again after the last. A source that the schedule leaves a few slots short of its target
gets them at the end, and its last slot is cut so that the words taken meet the target to the word. What is taken of a document are
the words that the slots read of it; its first slot is its place in the mix.

Nothing depends on one task seeing a whole source: positions in a stream and ranks of slots are prefix sums in two levels. Rows that
repeat are one row with a count while positions are worked out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import FEW_ROWS, fresh, scratch, thinned, whole, word_count

BLOCK_WORDS = 1024
MAX_REPEATS = 3
WEIGHTS = (1, 2, 3)
SEED = "mix"
CELLS = 4096
GOLDEN = 0.6180339887498949
STEP = 1 << 20


def source_key(source: str | Column) -> Column:
    """A key in code point order with null after all others."""
    c = F.col(source) if isinstance(source, str) else source
    return F.coalesce(F.concat(F.lit("s"), c), F.lit("~"))


def targets(sources: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Adds weight and target to (skey, source_size), a row per source.

    Shares are filled like water: in order of cap by weight, a source whose cap lies under the level that is left to it and
    those after it is held at its cap; the first that isn't fixes the level for all the rest.
    """
    everything = Window.orderBy("skey")
    n = len(WEIGHTS)
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), ((F.row_number().over(everything) - 1) % n + 1).cast("int"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "skey")
    before, after = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    both = by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(max_repeats).cast("long"))
    left = F.sum("source_size").over(both) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    out = out.withColumn("level", left / F.sum("weight").over(after))
    out = out.withColumn("free", F.col("cap") > F.col("level") * F.col("weight"))
    level = F.first(F.when(F.col("free"), F.col("level")), ignorenulls=True).over(both)
    return out.withColumn("target", F.when(F.col("free"), level * F.col("weight")).otherwise(F.col("cap").cast("double"))).select(
        "skey", "source_size", "weight", "target", F.least(F.floor(F.col("target") + 0.5), F.col("cap")).cast("long").alias("goal")
    )


def place_of(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """A fixed random place from id and text, so that rows that share an id don't share a place."""
    return F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.md5(whole(text_col))))


def streams(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, skey, size, place, rows: rows that agree in id, text and source are one with their number; place is its fixed random
    place in the source's stream."""
    each = docs.select(F.col(id_col).alias("doc_id"), source_key(source_col).alias("skey"), word_count(whole(text_col)).alias("size"), place_of(id_col, text_col).alias("place"))
    return each.groupBy("doc_id", "skey", "size", "place").agg(F.count("*").alias("rows"))


def positions(sized: DataFrame, per_source: DataFrame, rows: int) -> DataFrame:
    """doc_id, skey, place, size, source_size, target, goal, start (words before the document in its source's stream): a row for each row.

    The hexadecimal place is cut into ranges of equal width, about as many as documents in each; only (source, range) totals are
    summed across a whole source.
    """
    digits = max(1, min(12, round(math.log(max(rows, 1), 16) / 2)))
    ranged = sized.withColumn("range", F.substring("place", 1, digits)).withColumn("words", F.col("size") * F.col("rows"))
    totals = ranged.groupBy("skey", "range").agg(F.sum("words").alias("words"))
    ahead = Window.partitionBy("skey").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("offset", F.coalesce(F.sum("words").over(ahead), F.lit(0))).drop("words").join(per_source, "skey")
    inside = Window.partitionBy("skey", "range").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranged.withColumn("inside", F.coalesce(F.sum("words").over(inside), F.lit(0)))
        .join(offsets, ["skey", "range"])
        .withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)))
        .select("doc_id", "skey", "place", "size", "source_size", "target", "goal", (F.col("offset") + F.col("inside") + F.col("turn") * F.col("size")).alias("start"))
    )


def schedule(per_source: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """slot, skey, rank, block, begin, end: a row per slot of the mix, in mixing order; [begin, end) are words of the stream.

    per_source is the result of targets(). Slots past a source's goal are left out.
    """
    spark, b = per_source.sparkSession, F.lit(block_words).cast("long")
    everything = Window.orderBy("skey").rowsBetween(Window.unboundedPreceding, 0)
    shares = per_source.filter("goal > 0").withColumn("hi", F.sum("goal").over(everything))
    total = F.sum("goal").over(Window.orderBy("skey").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    per_pass = F.ceil(F.col("source_size") / b)
    extra = F.col("goal") % F.col("source_size")
    need = F.floor(F.col("goal") / F.col("source_size")) * per_pass + F.ceil(extra / b)
    shares = shares.select(
        "skey", "source_size", "goal", ((F.col("hi") - F.col("goal")) / total).alias("lo"), (F.col("hi") / total).alias("hi"),
        per_pass.cast("long").alias("per_pass"), need.cast("long").alias("need"),
    )
    n = int(shares.agg(F.coalesce(F.sum("need"), F.lit(0))).first()[0])
    chunk = max(1024, math.isqrt(max(n, 1)))
    # a slot's point: n = a * STEP + b keeps both products exact enough at any n
    jump = (STEP * GOLDEN) % 1.0
    point = (F.floor(F.col("slot") / STEP) * F.lit(jump) + (F.col("slot") % STEP) * F.lit(GOLDEN)) % 1.0
    slots = spark.range(n).select(F.col("id").alias("slot")).withColumn("point", point).withColumn("cell", F.floor(F.col("point") * CELLS))
    cells = shares.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1).cast("long")))))
    dealt = slots.join(cells, "cell").filter("point >= lo AND (point < hi OR hi >= 1)").select("slot", "skey", F.floor(F.col("slot") / chunk).alias("chunk"))
    counts = dealt.groupBy("skey", "chunk").agg(F.count("*").alias("c"))
    ahead = Window.partitionBy("skey").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("offset", F.coalesce(F.sum("c").over(ahead), F.lit(0))).drop("c")
    within = Window.partitionBy("skey", "chunk").orderBy("slot")
    ranked = dealt.withColumn("r", F.row_number().over(within) - 1).join(offsets, ["skey", "chunk"])
    ranked = ranked.select("slot", "skey", (F.col("offset") + F.col("r")).alias("rank"))
    given = counts.groupBy("skey").agg(F.sum("c").alias("given"))
    short = shares.join(given, "skey", "left").withColumn("given", F.coalesce("given", F.lit(0))).filter("need > given")
    # the sequence's discrepancy bounds these: about the logarithm of n for each source
    late = short.select("skey", F.explode(F.sequence(F.col("given"), F.col("need") - 1)).alias("rank"))
    late = late.select((F.lit(n).cast("long") + F.row_number().over(Window.orderBy("skey", "rank")) - 1).alias("slot"), "skey", "rank")
    used = ranked.unionByName(late).join(shares.select("skey", "need", "per_pass", "goal", "source_size"), "skey").filter("rank < need")
    used = used.withColumn("block", F.col("rank") % F.col("per_pass")).withColumn("turn", F.floor(F.col("rank") / F.col("per_pass")))
    limit = F.col("goal") - F.col("turn") * F.col("source_size")
    return used.select(
        "slot", "skey", "rank", "block", (F.col("block") * b).alias("begin"),
        F.least((F.col("block") + 1) * b, "source_size", limit).alias("end"),
    )


def _laid_out(docs: DataFrame, id_col: str, text_col: str, source_col: str, block_words: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(streams, targets, positions, schedule), all but the positions written to scratch."""
    sized = scratch(streams(docs, id_col, text_col, source_col), "mix-sized")
    per_source = scratch(targets(sized.groupBy("skey").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"))), "mix-sources")
    return sized, per_source, positions(sized, per_source, sized.count()), scratch(schedule(per_source, block_words), "mix-slots")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, size, source_size, target, taken, first_slot for every row of docs.

    taken are the words that the slots read of the document, first_slot is the first slot that reads any, null if none does. Null and
    empty texts have size 0 and are taken 0 times; a null source is a source of its own, after all others. Rows that repeat count
    each for itself. Only the three named columns are read. An empty table gives an empty result.
    """
    _, per_source, placed, slots = _laid_out(docs, id_col, text_col, source_col, block_words)
    b = F.lit(block_words).cast("long")
    # how often each block is read whole, where its one cut reading ends, and which slot reads it first
    full = F.least(F.col("begin") + b, F.col("source_size"))
    reads = slots.join(per_source.select("skey", "source_size"), "skey").groupBy("skey", "block").agg(
        F.count_if(F.col("end") >= full).alias("times"), F.max(F.when(F.col("end") < full, F.col("end"))).alias("cut"), F.min("slot").alias("slot")
    )
    last = F.floor((F.col("start") + F.greatest(F.col("size"), F.lit(1)) - 1) / b)
    pieces = placed.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / b), last)))
    lo = F.greatest("start", F.col("block") * b)
    hi = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * b)
    part = F.coalesce("times", F.lit(0)) * (hi - lo) + F.greatest(F.lit(0), F.least(hi, F.coalesce("cut", F.lit(0))) - lo)
    done = pieces.join(reads, ["skey", "block"], "left").withColumn("part", F.when(F.col("size") > 0, part).otherwise(F.lit(0)))
    done = done.withColumn("slot", F.when(F.col("part") > 0, F.col("slot")))
    # a document of words has a start of its own; those without words may share one and are never summed
    single = F.floor(F.col("start") / b) == last
    cut = done.filter(~single).groupBy("doc_id", "skey", "start", "size", "source_size", "target").agg(F.sum("part").alias("part"), F.min("slot").alias("slot"))
    out = [F.col(c) for c in ("doc_id", "size", "source_size", "target")] + [F.col("part").cast("long").alias("taken"), F.col("slot").alias("first_slot")]
    return done.filter(single).select(*out).unionByName(cut.select(*out))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce('s' || source, '~') AS skey,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS place
  FROM documents),
s AS (SELECT skey, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY skey),
w AS (SELECT *, (row_number() OVER (ORDER BY skey) - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM s),
l AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
            / sum(weight) OVER (ORDER BY cap / weight, skey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT *, cap > level * weight AS free FROM l),
v AS (SELECT *, first_value(CASE WHEN free THEN level END IGNORE NULLS) OVER (ORDER BY cap / weight, skey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lvl FROM f),
t AS (SELECT skey, source_size, CASE WHEN free THEN lvl * weight ELSE CAST(cap AS DOUBLE) END AS target, cap FROM v),
g AS (SELECT *, least(CAST(floor(target + 0.5) AS BIGINT), cap) AS goal FROM t),
p AS (SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY skey ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM d),
q AS (SELECT *, CAST(ceil(source_size / 1024) AS BIGINT) AS per_pass, CAST((goal // source_size) * ceil(source_size / 1024) + ceil((goal % source_size) / 1024) AS BIGINT) AS need,
             sum(goal) OVER (ORDER BY skey) AS upto, sum(goal) OVER () AS total FROM g WHERE goal > 0),
r AS (SELECT *, CAST(upto - goal AS DOUBLE) / CAST(total AS DOUBLE) AS lo, CAST(upto AS DOUBLE) / CAST(total AS DOUBLE) AS hi FROM q),
n AS (SELECT CAST(sum(need) AS BIGINT) AS n FROM q),
x AS (SELECT slot, (CAST(slot // 1048576 AS DOUBLE) * ((1048576 * 0.6180339887498949::DOUBLE) % 1.0::DOUBLE) + CAST(slot % 1048576 AS DOUBLE) * 0.6180339887498949::DOUBLE) % 1.0::DOUBLE AS point
      FROM (SELECT unnest(range(n)) AS slot FROM n)),
y AS (SELECT slot, skey, row_number() OVER (PARTITION BY skey ORDER BY slot) - 1 AS rnk FROM x JOIN r ON point >= lo AND (point < hi OR hi >= 1)),
z AS (SELECT skey, unnest(range(given, need)) AS rnk FROM (SELECT skey, need, (SELECT count(*) FROM y WHERE y.skey = q.skey) AS given FROM q)),
u AS (SELECT * FROM y UNION ALL SELECT (SELECT n FROM n) + row_number() OVER (ORDER BY skey, rnk) - 1 AS slot, skey, rnk FROM z),
k AS (SELECT u.skey, rnk AS block, slot FROM u JOIN q ON u.skey = q.skey AND rnk < least(need, per_pass)),
e AS (SELECT *, CAST(CASE WHEN size = 0 THEN 0 ELSE (goal // source_size) * size + greatest(0, least(start + size, goal % source_size) - start) END AS BIGINT) AS taken,
             CASE WHEN goal >= source_size THEN start + size ELSE least(start + size, goal) END AS stop, row_number() OVER () AS rid FROM p JOIN g USING (skey)),
h AS (SELECT rid, min(slot) AS first_slot FROM e JOIN k ON e.skey = k.skey AND block BETWEEN start // 1024 AND (stop - 1) // 1024 WHERE taken > 0 GROUP BY rid)
SELECT doc_id, size, source_size, target, taken, first_slot FROM e LEFT JOIN h USING (rid)
"""


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs as the mix reads them: each document as often as it is taken, rounded, in the order of the slots that read its first word.

    All columns are as they were; the parts of the result, and the rows in each, follow one another in mixing order. A document
    without words is never taken, nor is one with a null text. Of rows that agree in id, text and source the first is emitted for all
    of them. No column name can clash. An empty table gives an empty result.
    """
    sized, _, placed, slots = _laid_out(docs, id_col, text_col, source_col, block_words)
    b = F.lit(block_words).cast("long")
    taken = F.floor(F.col("goal") / F.col("source_size")) * F.col("size") + F.greatest(F.lit(0), F.least(F.col("start") + F.col("size"), F.col("goal") % F.col("source_size")) - F.col("start"))
    often = placed.filter("size > 0").withColumn("copies", F.floor((2 * taken + F.col("size")) / (2 * F.col("size")))).filter("copies > 0")
    turns = often.withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    read = turns.withColumn("rank", F.floor(F.col("start") / b) + F.col("turn") * F.ceil(F.col("source_size") / b).cast("long"))
    emitted = scratch(read.join(slots.select("skey", "rank", "slot"), ["skey", "rank"]).select("doc_id", "skey", "place", "slot", "start"), "mix-emitted")
    again = scratch(sized.filter("rows > 1").select("doc_id", "skey", "place", F.lit(True).alias("stays")), "mix-again")
    once = thinned(docs, [F.col(id_col), source_key(source_col), place_of(id_col, text_col)], again)
    own, skey, place = fresh(docs, "_id", "_source", "_place")
    right = emitted.toDF(own, skey, place, *fresh(docs, "_slot", "_start"))
    few = F.broadcast(right) if emitted.count() <= FEW_ROWS else right.hint("shuffle_hash")
    same = once[id_col].eqNullSafe(right[own]) & (source_key(once[source_col]) == right[skey]) & (place_of(id_col, text_col) == right[place])
    mixed = once.join(few, same)
    order = right.columns[3:]
    return mixed.repartitionByRange(*order).sortWithinPartitions(*order).select(*docs.columns)
