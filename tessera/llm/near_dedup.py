"""Near-duplicate groups: fast similarity sketches, banding and exact verification.

1. Every text gives its shingle set's digest, its sketch and the keys of its bands. Equal sets are one class with one node.
2. The nodes of a band key are its bucket. All are held against the bucket's first by their full sets. Links join nodes into
   components.
3. In a bucket of at most SMALL nodes that are still in different components (passages that texts share, loose clusters), sketches
   are held against each other within the task, and pairs that agree in ALIKE coordinates or more are verified by their full sets.
4. Larger ones of these buckets go on exactly: with shingles ordered from rare to common among their nodes, two sets that reach the
   similarity share one of the first n - ceil(0.75 n) + 1 of each, at places that leave enough shingles after them. Each shingle's
   holders are first held against the one that has it earliest; then every pair that is still across components and within reach is
   verified. Holders of a common shingle are dealt to many tasks in blocks.

Each step deals rows by class, bucket or shingle; hot keys are split. A pair that reaches the similarity exactly is missed by all
32 bands of 4 with a chance of 5e-6, and by ALIKE of 128 coordinates with one of 3e-7.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import shingles
from tessera.llm.common import FEW_ROWS, discard, hold_batches, join_hot, kept_rows, scratch, thinned, whole
from tessera.llm.components import components

#: A link: 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Members of one centre that are verified in one group of rows, and holders of one shingle that are paired with as many others in one.
SALT_ROWS, BLOCK_ROWS = 512, 1024
#: Nodes of a bucket whose sketches one task compares, and coordinates that must agree; buckets with more nodes go by shingles.
SMALL, ALIKE = 32, 72
#: Distinct shingles that one task counts, about, and those that it gathers before it sends them.
PART_SHINGLES, GATHERED = 4_000_000, 1 << 20


def _digest(x: np.ndarray) -> bytes:
    return hashlib.blake2b(x.tobytes(), digest_size=16).digest()


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, tx, text -> doc_id, tx, n_shingles, set_id, bands, sketch (16 bits of each coordinate)."""
    for batch in batches:
        n, ids, rows, kept, short = [], [], [], [], []
        for i, x in enumerate(shingles.sets_of(batch.column(2))):
            n.append(len(x))
            ids.append(_digest(x))
            short.append(b"")
            if len(x):
                rows.append(shingles.sketch(x))
                kept.append(i)
                short[-1] = shingles.mixed(rows[-1]).astype(np.uint16).tobytes()
        flat = shingles.band_keys(np.array(rows)).ravel() if rows else np.zeros(0, dtype=np.int64)
        sizes = np.zeros(len(n) + 1, dtype=np.int32)
        sizes[np.array(kept, dtype=np.int64) + 1] = shingles.BANDS
        bands = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes, dtype=np.int32)), pa.array(flat))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), bands, pa.array(short, pa.binary())], ["doc_id", "tx", "n_shingles", "set_id", "bands", "sketch"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text, node, set_id -> node, n, shingles, once for each node whose text has that set."""
    done: set[int] = set()  # repeated rows of one text
    for batch in batches:
        nodes, wanted, out = batch.column(1).to_pylist(), batch.column(2).to_pylist(), ([], [], [])
        for x, node, want in zip(shingles.sets_of(batch.column(0)), nodes, wanted, strict=True):
            if node not in done and _digest(x) == want:
                done.add(node)
                for o, v in zip(out, (node, len(x), x.tobytes()), strict=True):
                    o.append(v)
            if sum(map(len, out[2][-64:])) > 1 << 22:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], ["node", "n", "shingles"])
                out = ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], ["node", "n", "shingles"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b, shingles of a, shingles of b -> a, b of the pairs that reach the similarity."""
    for batch in batches:
        a, b, keep = batch.column(2), batch.column(3), []
        for i in range(batch.num_rows):
            x, y = np.frombuffer(a[i].as_buffer(), dtype=np.uint64), np.frombuffer(b[i].as_buffer(), dtype=np.uint64)
            if len(x) > len(y):
                x, y = y, x
            at = np.searchsorted(y, x)
            same = int((y[np.minimum(at, len(y) - 1)] == x).sum())
            keep.append(100 * same >= PERCENT * (len(x) + len(y) - same))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that reach the similarity; pairs is a scratch table. The set of an `a` with many partners is sent once for each
    SALT_ROWS of them, and only sets that a pair needs are sent, if those can be named in a broadcast."""
    total = pairs.count()
    if not total:
        return pairs
    if 2 * total <= FEW_ROWS:
        named = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        sets = sets.join(F.broadcast(named), "node", "left_semi")
    partners = scratch(pairs.groupBy("a").agg(F.count("*").alias("partners")), "near-partners")
    salted = join_hot(pairs, partners, ["a"], "partners", total).withColumn("salt", F.pmod(F.xxhash64("b"), F.ceil(F.col("partners") / SALT_ROWS)))
    theirs = salted.select("a", "b", "salt").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    many = partners.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("partners") / SALT_ROWS) - 1)))
    ours = many.select("a", "salt").join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    return theirs.join(ours, ["a", "salt"]).select("a", "b", "sa", "sb").mapInArrow(_linked, "a long, b long")


def _alike(n: Column, m: Column) -> Column:
    """Sizes whose sets can reach the similarity."""
    return (100 * F.least(n, m)) >= (PERCENT * F.greatest(n, m))


def _groups(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The columns of near_groups, tx (a hash of the text) and stays: whether the row has the id and text that its group keeps."""
    hold_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(whole(text_col)).alias("tx"), F.col(text_col).alias("text"))
    kind = dict(texts.dtypes)["doc_id"]
    seen = texts.mapInArrow(_sketched, f"doc_id {kind}, tx long, n_shingles long, set_id binary, bands array<long>, sketch binary")
    seen = scratch(seen.withColumn("row", F.monotonically_increasing_id()), "near-sketched")
    rows = seen.count()
    full = seen.filter("n_shingles > 0")
    least = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tx")
    classes = full.groupBy("set_id").agg(F.min("row").alias("node"), F.min(least).alias("first"), F.count("*").alias("size"))
    classes = scratch(classes.select("set_id", "node", "size", F.col("first.doc_id").alias("first"), F.col("first.tx").alias("tx")), "near-classes")

    # 2. buckets of at least two nodes
    nodes = kept_rows(full.select("row", "n_shingles", "bands"), [F.col("row")], classes.select("node"), "left_semi")
    dealt = nodes.select(F.col("row").alias("node"), F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    buckets = dealt.groupBy("key").agg(F.min("node").alias("a"), F.min_by("n", "node").alias("m"), F.count("*").alias("members")).filter("members > 1")
    buckets = scratch(buckets, "near-buckets")
    members = join_hot(dealt, buckets, ["key"], "members", rows * shingles.BANDS).select("key", "a", "m", "members", F.col("node").alias("b"), "n")
    members = scratch(members, "near-members")
    wanted = members.select(F.col("b").alias("node")).distinct().join(classes, "node").select("node", "set_id", F.col("first").alias("doc_id"), "tx")
    wanted = scratch(wanted, "near-wanted")
    asked = F.broadcast(wanted) if wanted.count() <= FEW_ROWS else wanted.hint("shuffle_hash")
    lent = texts.join(asked, texts["doc_id"].eqNullSafe(wanted["doc_id"]) & (texts["tx"] == wanted["tx"])).select("text", "node", "set_id")
    sets = scratch(lent.mapInArrow(_sets, "node long, n long, shingles binary"), "near-sets")
    pairs = scratch(members.filter("a <> b").filter(_alike(F.col("m"), F.col("n"))).select("a", "b").distinct(), "near-pairs")
    links = scratch(_verified(pairs, sets), "near-links")
    found = components(links)

    # 3. and 4. what is still apart in a bucket
    def more(candidates: DataFrame) -> None:
        nonlocal links, found
        candidates = scratch(candidates, "near-pairs-2")
        new = scratch(_verified(candidates, sets), "near-links-2")
        if not new.isEmpty():
            both = scratch(links.unionByName(new), "near-links")
            for t in (links, found):
                discard(t)
            links, found = both, components(both)
        discard(new)
        discard(candidates)

    apart = _apart(members, found)
    if not apart.isEmpty():
        more(_close_pairs(apart.filter(F.col("members") <= SMALL), seen))
        crowd = scratch(apart.filter(F.col("members") > SMALL).select("node", "n", "component").distinct(), "near-crowd")
        if not crowd.isEmpty():
            rare = _rare(crowd, sets)
            for candidates in (_around_first, _across):  # the first links nearly all that can be linked, so few pairs are left
                holders = scratch(_components_of(rare, found), "near-holders")
                more(candidates(holders))
                discard(holders)
            discard(rare)
        discard(crowd)
    for t in (apart, members, buckets, wanted, sets, pairs, links):
        discard(t)

    # classes to components to documents
    one = F.struct(F.col("first").isNull().alias("none"), F.col("first").alias("id"), "tx")
    least = classes.join(found, "node").groupBy("component").agg(F.min(one).alias("one"), F.count("*").alias("classes"))
    least = scratch(least.select("component", F.col("one.id").alias("component_id"), F.col("one.tx").alias("kept_tx"), "classes"), "near-least")
    named = join_hot(found, least, ["component"], "classes", rows).select("node", "component_id", "kept_tx", F.lit(True).alias("linked"))
    named = classes.join(named, "node", "left").select(
        "set_id", "size", F.col("first").alias("class_id"), F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("first")).alias("component_id"), F.coalesce("kept_tx", "tx").alias("kept_tx")
    )
    named = scratch(named, "near-named")
    out = join_hot(full.select("doc_id", "tx", "n_shingles", "set_id"), named, ["set_id"], "size", rows)
    same = F.col("doc_id").eqNullSafe(F.col("component_id"))
    out = out.select("doc_id", "n_shingles", "component_id", same.alias("kept"), "class_id", F.col("size").alias("class_size"), "tx", (same & (F.col("tx") == F.col("kept_tx"))).alias("stays"))
    bare = seen.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"), F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), "tx", F.lit(True).alias("stays"))
    return out.unionByName(bare)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept, class_id, class_size for every row of docs.

    component_id is the least doc_id that links reach, class_id the least with the same set. Null and empty texts and those
    without words have the empty set, are linked with nothing and are kept. Rows that repeat are of one class; a null doc_id
    counts as largest. Only the two named columns are read, so other names can't clash. Texts of any length are compared whole. An
    empty table gives an empty result.
    """
    return _groups(docs, id_col, text_col).drop("tx", "stays")


def _apart(members: DataFrame, found: DataFrame) -> DataFrame:
    """key, members, node, n, component of the buckets that hold more than one component, written to scratch."""
    at = members.select("key", "members", F.col("b").alias("node"), "n").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    at = scratch(at, "near-at")
    mixed = scratch(at.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("members").alias("w")).filter("lo < hi"), "near-mixed")
    out = scratch(join_hot(at, mixed.select("key", "w"), ["key"], "w", at.count()).drop("w"), "near-apart")
    discard(at)
    discard(mixed)
    return out


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of (node, n, component, sketch), one for each bucket -> a, b of alike sizes and sketches in different components."""
    for batch in batches:
        lists = batch.column(0)
        rows, ends = lists.flatten(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
        node, n, component = (rows.field(k).to_numpy(zero_copy_only=False) for k in range(3))
        sketch = np.frombuffer(b"".join(rows.field(3).to_pylist()), dtype=np.uint16).reshape(-1, shingles.COORDINATES)
        a, b = [], []
        for at, to in zip(ends, ends[1:], strict=False):
            for i in range(at, to - 1):
                rest = slice(i + 1, to)
                fit = (component[rest] != component[i]) & (100 * np.minimum(n[rest], n[i]) >= PERCENT * np.maximum(n[rest], n[i]))
                fit &= (sketch[rest] == sketch[i]).sum(axis=1) >= ALIKE
                for j in (i + 1 + np.flatnonzero(fit)).tolist():
                    a.append(min(node[i], node[j]))
                    b.append(max(node[i], node[j]))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _close_pairs(apart: DataFrame, seen: DataFrame) -> DataFrame:
    """Pairs (a, b) of the nodes of small buckets that their sketches call similar; distinct."""
    nodes = scratch(apart.select("node").distinct(), "near-nodes")
    sketches = kept_rows(seen.select(F.col("row").alias("node"), "sketch"), [F.col("node")], nodes, "left_semi")
    rows = apart.select("key", "node", "n", "component").join(sketches, "node")
    lists = rows.groupBy("key").agg(F.collect_list(F.struct("node", "n", "component", "sketch")).alias("rows")).select("rows")  # SMALL at most
    return lists.mapInArrow(_compared, "a long, b long").distinct()


def _summed(keys: np.ndarray, counts: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """One entry for each key: sums of counts, least lo, greatest hi."""
    order = np.argsort(keys, kind="stable")
    keys, counts, lo, hi = keys[order], counts[order], lo[order], hi[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    if not len(at):
        return keys, counts, lo, hi
    return keys[at], np.add.reduceat(counts, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at)


_SHARES = ["part", "keys", "counts", "lo", "hi"]


def _shares(parts: int) -> Callable:
    """component, shingles -> part, packed entries (shingle, count, least and greatest component) of a task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def sent() -> pa.RecordBatch:
            keys, counts, lo, hi = _summed(*map(np.concatenate, zip(*held, strict=True)))
            held.clear()
            part = (shingles.mixed(keys) % np.uint64(parts)).astype(np.int64)
            rows = [(p, *(x[at].tobytes() for x in (keys, counts, lo, hi))) for p in np.unique(part) for at in (part == p,)]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *[pa.array([r[k] for r in rows], pa.binary()) for k in range(1, 5)]], _SHARES)

        for batch in batches:
            for component, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys = np.frombuffer(x.as_buffer(), dtype=np.uint64)
                own = np.full(len(keys), component, dtype=np.int64)
                held.append((keys, np.ones(len(keys), dtype=np.int64), own, own))
                if sum(len(h[0]) for h in held[-16:]) > GATHERED or len(held) > 1024:
                    yield sent()
        if held:
            yield sent()

    return run


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed entries -> shingle, count of those that more than one component has. All entries of a shingle are in one task."""
    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        for row in range(batch.num_rows):
            held.append(tuple(np.frombuffer(batch.column(k)[row].as_buffer(), dtype=np.uint64 if k == 1 else np.int64) for k in range(1, 5)))
            if len(held) > 256:
                held = [_summed(*map(np.concatenate, zip(*held, strict=True)))]
    if held:
        keys, counts, lo, hi = _summed(*map(np.concatenate, zip(*held, strict=True)))
        keys, counts = keys[lo < hi], counts[lo < hi]
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], ["shingle", "count"])


def _first(n: int) -> int:
    """So many of the rarest of n shingles hold one of every set that reaches the similarity."""
    return n - -(-PERCENT * n // 100) + 1


def _prefixes(common) -> Callable:
    """node, n, component, shingles -> shingle, node, n, component, rank of the common ones among a set's rarest shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = common.value
        for batch in batches:
            for i in range(batch.num_rows):
                x = np.frombuffer(batch.column(3)[i].as_buffer(), dtype=np.uint64)
                at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
                often = np.where(keys[at] == x, counts[at], 0)
                order = np.lexsort((x, often))[: _first(len(x))]
                rank = np.flatnonzero(often[order])
                same = [pa.array(np.full(len(rank), batch.column(c)[i].as_py(), dtype=np.int64)) for c in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array(x[order[rank]].view(np.int64)), *same, pa.array(rank + 1)], ["shingle", "node", "n", "component", "rank"])

    return run


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, n, component, shingles -> shingle, node, n, component."""
    for batch in batches:
        for i in range(batch.num_rows):
            x = np.frombuffer(batch.column(3)[i].as_buffer(), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x), *[pa.array(np.full(len(x), batch.column(c)[i].as_py(), dtype=np.int64)) for c in range(3)]], ["shingle", "node", "n", "component"])


def _rare(crowd: DataFrame, sets: DataFrame) -> DataFrame:
    """shingle, node, n, rank: of each node's rarest shingles, of which two sets that reach the similarity share one, those that
    nodes of several components have. Written to scratch.

    Shingles are counted where they are, counts meet by parts of the shingles, and those of one component come first in the order,
    as they link nothing. Up to FEW_ROWS common ones are broadcast; beyond that every shingle is joined with its count.
    """
    own = scratch(sets.drop("n").join(crowd, "node").select("node", "n", "component", "shingles"), "near-own")
    total = own.agg(F.sum("n")).first()[0]
    parts = max(1, math.ceil(total / PART_SHINGLES))
    shares = own.select("component", "shingles").mapInArrow(_shares(parts), "part long, keys binary, counts binary, lo binary, hi binary")
    common = scratch(shares.repartition(parts, "part").mapInArrow(_common, "shingle long, count long"), "near-common")
    n = common.count()
    if not n:
        rare = own.select(F.lit(0).cast("long").alias("shingle"), "node", "n", F.lit(0).cast("long").alias("rank")).filter("false")
    elif n <= FEW_ROWS:
        table = common.toArrow()
        keys, counts = table["shingle"].to_numpy().view(np.uint64), table["count"].to_numpy()
        order = np.argsort(keys)
        shared = sets.sparkSession.sparkContext.broadcast((keys[order], counts[order]))
        rare = own.mapInArrow(_prefixes(shared), "shingle long, node long, n long, component long, rank long").select("shingle", "node", "n", "rank")
    else:
        hits = join_hot(own.mapInArrow(_exploded, "shingle long, node long, n long, component long"), common, ["shingle"], "count", total)
        # the order of unsigned shingles, as above
        place = Window.partitionBy("node").orderBy("count", F.col("shingle") < 0, "shingle")
        hits = hits.withColumn("rank", F.col("n") - F.count("*").over(Window.partitionBy("node")) + F.row_number().over(place))
        rare = hits.filter(F.col("rank") <= F.col("n") - F.ceil(PERCENT * F.col("n") / 100) + 1).select("shingle", "node", "n", "rank")
    out = scratch(rare, "near-rare")
    discard(common)
    discard(own)
    return out


#: Of two sets whose first common shingle has rank i of n and j of m, this bounds the intersection.
def _in_reach(n: Column, i: Column, m: Column, j: Column) -> Column:
    return _alike(n, m) & ((100 + PERCENT) * (1 + F.least(n - i, m - j)) >= PERCENT * (n + m))


def _components_of(rare: DataFrame, found: DataFrame) -> DataFrame:
    """rare with each node's component, of the shingles that more than one component has, and `holders`, the shingle's nodes."""
    own = scratch(rare.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")), "near-rare-own")
    mixed = own.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("holders")).filter("lo < hi")
    return join_hot(own, scratch(mixed.select("shingle", "holders"), "near-mixed"), ["shingle"], "holders", rare.count())


def _around_first(rare: DataFrame) -> DataFrame:
    """Pairs (a, b) of each shingle's holders with the one that has it at the earliest place, where that can be a link; distinct."""
    first = rare.groupBy("shingle").agg(F.min(F.struct(F.col("rank") / F.col("n"), "node", "n", "rank", "component")).alias("f"), F.count("*").alias("holders"))
    first = first.select("shingle", "holders", F.col("f.node").alias("c"), F.col("f.n").alias("m"), F.col("f.rank").alias("j"), F.col("f.component").alias("other"))
    near = join_hot(rare.drop("holders"), scratch(first, "near-first"), ["shingle"], "holders", rare.count()).filter(F.col("component") != F.col("other"))
    near = near.filter(_in_reach(F.col("n"), F.col("rank"), F.col("m"), F.col("j")))
    return near.select(F.least("node", "c").alias("a"), F.greatest("node", "c").alias("b")).distinct()


def _across(rare: DataFrame) -> DataFrame:
    """All pairs (a, b) of holders of a shingle in different components that can be links; distinct.

    The holders of a shingle are cut into blocks of about BLOCK_ROWS, and each pair of blocks is a key of its own.
    """
    blocks = F.ceil(F.col("holders") / BLOCK_ROWS).cast("long")
    own = F.pmod(F.xxhash64("node"), blocks)
    each = F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))
    left = rare.select("shingle", "node", "n", "component", "rank", own.alias("x"), each.alias("y"))
    right = rare.select("shingle", F.col("node").alias("b"), F.col("n").alias("m"), F.col("component").alias("c"), F.col("rank").alias("j"), own.alias("y"), each.alias("x"))
    near = left.join(right, ["shingle", "x", "y"]).filter((F.col("component") < F.col("c")) & _in_reach(F.col("n"), F.col("rank"), F.col("m"), F.col("j")))
    return near.select(F.col("node").alias("a"), "b").distinct()


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each group, all columns as they were: the one with the smallest doc_id, a null one counting as largest.

    Of rows that repeat with one id and text one stays. Null and empty texts and those without words are in no group and all stay.
    No column name can clash. An empty table gives an empty result.
    """
    groups = _groups(docs, id_col, text_col).filter("n_shingles > 0")
    odd = groups.groupBy("doc_id", "tx").agg(F.max("stays").alias("stays"), F.count("*").alias("n")).filter("n > 1 OR NOT stays")
    return thinned(docs, [F.col(id_col), F.xxhash64(whole(text_col))], scratch(odd.select("doc_id", "tx", "stays"), "near-odd"))
