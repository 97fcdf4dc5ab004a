"""Secret scans over an incremental blob ledger.

A path is any versioned place of a text. Texts are content-addressed: the SHA-256 of the text is its blob. A rule's version is a digest
of the rule itself, so an edited rule is another version. The ledger says for each blob which rule versions have scanned it and what
they found; a scan takes only the blobs that lack a version, one representative text each, and runs only the rules that are missing.
Findings are joined back to all paths of a blob.

Positions come from the pieces between matches: `split` gives what lies between them and `regexp_extract_all` the matches, both
leftmost and non-overlapping, so a match starts at the length of all pieces and matches before it, in code points.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import FEW_ROWS, _hadoop, join_hot, scratch, scratch_root, whole


@dataclass(frozen=True)
class Rule:
    """kind: the name in a span. pattern: a regex that Java and RE2 read alike. group and least: matches whose group is shorter are
    dropped. span: the group that is reported; it ends where the match ends. needs: what every match contains, looked for first."""

    kind: str
    pattern: str
    group: int
    least: int
    base: bool = False
    span: int = 0
    needs: str = ""

    @property
    def version(self) -> str:
        return f"{self.kind}:{hashlib.sha256(repr((self.pattern, self.group, self.least, self.span)).encode()).hexdigest()[:16]}"


#: The base rules in the order of the contract, then those that the method adds. No group of letters repeats without a
#: bound, since Java takes a stack frame for each turn, and a token of a web token starts only where no other can go on.
RULES = (
    Rule("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, True, needs="AKIA"),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16, True),
    Rule("pem", r"-----BEGIN (?:[A-Z]{1,20} ){0,4}PRIVATE KEY-----", 0, 1, needs="PRIVATE KEY-----"),
    Rule("jwt", r"(?:^|[^A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})", 1, 1, False, 1, needs="eyJ"),
    Rule("platform", r"(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,})", 0, 1),
)
SPAN = "struct<start:bigint,rank:int,kind:string,stop:bigint,version:string>"
NONE = f"array<{SPAN}>"
#: Matches of a rule whose places are added up in one go.
BLOCK = 256
LEDGER = f"blob binary, versions array<string>, spans {NONE}"


def _placed(parts: Column, at: Column, rule: Rule, rank: int) -> Column:
    """The spans of the matches in parts, the first of which begins its gap at `at`."""
    return F.aggregate(
        parts,
        F.struct(at.alias("at"), F.array().cast(NONE).alias("found")),
        lambda acc, x: F.struct(
            (acc.at + x["gap"] + x["len"]).alias("at"),
            F.when(
                x["key"] >= rule.least,
                F.array_append(acc.found, F.struct(
                    (acc.at + x["gap"] + x["len"] - x["own"]).alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"),
                    (acc.at + x["gap"] + x["len"]).alias("stop"), F.lit(rule.version).alias("version"),
                )),
            ).otherwise(acc.found).alias("found"),
        ),
    ).found


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    """The spans of one rule's matches in text; no regex runs twice where the first finds nothing. Of over BLOCK matches each block's
    place is worked out first, since appending to one long array takes the square of its length."""
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    group = lambda g: F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(g)), F.char_length) if g else F.transform(matches, F.char_length)
    parts = F.arrays_zip(
        F.transform(F.split(text, rule.pattern, -1), F.char_length).alias("gap"), F.transform(matches, F.char_length).alias("len"),
        group(rule.group).alias("key"), group(rule.span).alias("own"),
    )
    let = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    zero = F.lit(0).cast("bigint")
    length = lambda block: F.aggregate(block, zero, lambda a, x: a + x["gap"] + x["len"])

    def in_blocks(p: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(p) / BLOCK).cast("int") - 1), lambda i: F.slice(p, i * BLOCK + 1, BLOCK))

        def placed(b: Column) -> Column:
            starts = F.aggregate(b, F.struct(zero.alias("at"), F.array().cast("array<bigint>").alias("all")), lambda a, x: F.struct((a["at"] + length(x)).alias("at"), F.array_append(a["all"], a["at"]).alias("all")))["all"]
            return let(starts, lambda at: F.flatten(F.transform(b, lambda x, i: _placed(x, F.get(at, i), rule, rank))))

        return let(blocks, placed)

    # the last piece has no match after it
    found = let(parts, lambda p: let(F.slice(p, 1, F.size(p) - 1), lambda m: F.when(F.size(m) <= BLOCK, _placed(m, zero, rule, rank)).otherwise(in_blocks(m))))
    there = text.rlike(rule.pattern)
    return F.when(text.contains(rule.needs) & there if rule.needs else there, found).otherwise(F.array().cast(NONE))


def find(text: Column, rules: tuple[Rule, ...] = RULES, asked: Column | None = None) -> Column:
    """All spans of the rules, by start, then kind as listed; with `asked` only of the rules whose bit it has."""
    each = [_spans(text, rule, i) for i, rule in enumerate(rules)]
    if asked is not None:
        each = [F.when(asked.bitwiseAND(F.lit(1 << i)) != 0, s).otherwise(F.array().cast(NONE)) for i, s in enumerate(each)]
    return F.array_sort(F.concat(*each))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")


def blobs(paths: DataFrame, path_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """path, blob: the content address of every version of every path; null texts are empty ones."""
    return paths.select(F.col(path_col).alias("path"), F.unhex(F.sha2(whole(text_col), 256)).alias("blob"))


def scan(paths: DataFrame, ledger: DataFrame | None = None, path_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """(addresses, new ledger rows): path and blob of every row; for each blob that lacks versions in `ledger`, those versions and
    what they found.

    Of a blob's paths the smallest lends the text, a null one counting as largest; only ids and addresses are grouped, so a blob with
    any number of copies costs one row from each partition. Null and empty texts are one blob without spans. Repeated rows are
    scanned once for each. Columns other than the two named are not read.
    """
    addresses = scratch(blobs(paths, path_col, text_col), "blob-paths")
    lender = F.min(F.struct(F.col("path").isNull().alias("none"), "path"))
    wanted = addresses.groupBy("blob").agg(lender.alias("l")).select("blob", F.col("l.path").alias("path"))
    everything = F.lit((1 << len(rules)) - 1).cast("long")
    if ledger is None:
        wanted = wanted.withColumn("asked", everything)
    else:
        done = ledger.select("blob", F.explode("versions").alias("version")).join(F.broadcast(_numbered(ledger.sparkSession, rules)), "version")
        done = done.groupBy("blob").agg(F.bit_or("bit").alias("done"))
        wanted = wanted.join(done, "blob", "left").withColumn("asked", everything.bitwiseAND(F.bitwise_not(F.coalesce("done", F.lit(0).cast("long"))))).drop("done")
    wanted = scratch(wanted.filter("asked <> 0"), "blob-wanted")
    text = paths.select(F.col(path_col).alias("own"), whole(text_col).alias("t")).withColumn("address", F.unhex(F.sha2("t", 256)))
    few = F.broadcast(wanted) if wanted.count() <= FEW_ROWS else wanted.hint("shuffle_hash")
    lent = text.join(few, text["own"].eqNullSafe(wanted["path"]) & (text["address"] == wanted["blob"]))
    names = F.filter(F.array(*[F.when(F.col("asked").bitwiseAND(F.lit(1 << i)) != 0, F.lit(r.version)) for i, r in enumerate(rules)]), lambda v: v.isNotNull())
    found = lent.select("blob", names.alias("versions"), find(F.col("t"), rules, F.col("asked")).alias("spans"))
    return addresses, found.dropDuplicates(["blob"])


def _numbered(spark: SparkSession, rules: tuple[Rule, ...]) -> DataFrame:
    """version, bit: a row for each rule."""
    return spark.createDataFrame([(r.version, 1 << i) for i, r in enumerate(rules)], "version string, bit long")


def findings(addresses: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """path, spans: what the ledger has from the versions of `rules` at every path of each blob; an empty array where there is nothing."""
    rank = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.version), F.lit(i))])
    own = F.filter(F.flatten(F.collect_list("spans")), lambda x: F.array_contains(F.array(*[F.lit(r.version) for r in rules]), x["version"]))
    hits = ledger.filter(F.size("spans") > 0).groupBy("blob").agg(own.alias("spans")).filter(F.size("spans") > 0)  # a row for each scan of a blob
    hits = hits.withColumn("spans", F.array_sort(F.transform("spans", lambda x: x.withField("rank", rank[x["version"]]))))
    copies = addresses.groupBy("blob").agg(F.count("*").alias("copies"))
    hits = scratch(hits.join(copies, "blob"), "blob-hits")
    out = join_hot(addresses, hits, ["blob"], "copies", addresses.count(), "left")
    return out.select("path", F.coalesce("spans", F.array().cast(NONE)).alias("spans"))


def read_ledger(spark: SparkSession, folder: str) -> DataFrame | None:
    """The ledger in a folder; None if there is none yet."""
    at, fs = _hadoop(spark, folder)
    return spark.read.schema(LEDGER).parquet(folder) if fs.exists(at) else None


def update(paths: DataFrame, folder: str, path_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scans what the ledger in the folder lacks, adds it there, and returns the addresses of paths."""
    addresses, new = scan(paths, read_ledger(paths.sparkSession, folder), path_col, text_col, rules)
    new.write.mode("append").parquet(folder)
    return addresses


def digest(found: DataFrame) -> DataFrame:
    """The columns of op3 from path and spans."""
    base = F.filter("spans", lambda x: x["rank"] < sum(r.base for r in RULES))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        F.col("path").alias("doc_id"), *[count(r.kind) for r in RULES if r.base],
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ledger: str | None = None) -> DataFrame:
    """A row per row of docs, from the ledger in the folder `ledger`, which is brought up to date first; a new one if None.

    Null and empty texts have no spans; repeated rows each get their own row; texts of any length are scanned whole; only the two
    named columns are read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    if ledger is None:
        ledger = f"{scratch_root(spark)}/blob-ledger-{uuid.uuid4().hex}"
        at, fs = _hadoop(spark, ledger)
        fs.deleteOnExit(at)
    addresses = update(docs, ledger, id_col, text_col)
    return digest(findings(addresses, read_ledger(spark, ledger)))


def _oracle_kind(rule: Rule, rank: int) -> str:
    p = rule.pattern.replace("'", "''")
    g = f"regexp_extract_all(t, '{p}', {rule.group})"
    return f"""
      SELECT doc_id, rid, {rank} AS rank, '{rule.kind}' AS kind, unnest(regexp_extract_all(t, '{p}')) AS m, unnest({g}) AS k, unnest(regexp_extract_all(t, '{p}', {rule.span})) AS own,
             unnest(string_split_regex(t, '{p}')[:len(regexp_extract_all(t, '{p}'))]) AS gap,
             unnest(range(1, len(regexp_extract_all(t, '{p}')) + 1)) AS i
      FROM d WHERE regexp_matches(t, '{p}')"""


_LISTED = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank)"
_BASE = sum(r.base for r in RULES)
ORACLE = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(_oracle_kind(r, i) for i, r in enumerate(RULES))}),
p AS (SELECT *, CAST(sum(length(gap) + length(m)) OVER (PARTITION BY rid, rank ORDER BY i) AS BIGINT) AS stop FROM m),
s AS (SELECT rid, rank, kind, stop - length(own) AS start, stop FROM p
      WHERE length(k) >= CASE rank {" ".join(f"WHEN {i} THEN {r.least}" for i, r in enumerate(RULES))} END),
a AS (SELECT rid, {", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in RULES if r.base)},
             {_LISTED} FILTER (WHERE rank < {_BASE}) AS base, {_LISTED} AS spans FROM s GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in RULES if r.base)},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (rid)
"""
