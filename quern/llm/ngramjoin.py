"""N-gram Jaccard join by parity sketches: near-duplicate groups of whole texts, exact.

1. Every text's shingle set, its hash, its whole-set parity sketch and its join
   keys (bucket sketches per size band, see ``shingles``). Texts with equal sets
   are one class; a class's keys go out about once per task, not per copy. A
   class's id is 64 bits of hash; ids that two sets share by chance are found by a
   second hash, and those sets take ids of both.
2. Classes with an equal key form a group; groups with equal members count once,
   and each class leaves out its largest groups, as far as the keys' bound allows.
   Keys that a sample shows to be very common are not brought together to be
   counted: their rows stay dealt, under the sampled size.
3. In each group every member is paired with one pivot. Pairs whose sizes or
   sketch distance rule similarity out go; the rest is verified on whole texts,
   a pivot's members dealt over tasks in slices.
4. Linked classes merge. Groups whose members still lie in several components
   are compared in full, in square blocks of members and with sketches only;
   surviving pairs are verified the same way. So no link is lost, while a group
   of copies costs its number of members, not its square.
5. Components over all links; a class is given its smallest document id.

Defined results: null and empty texts, and texts of white space, have the empty
set, link with nothing and are components of their own; equal non-empty sets
always link; repeated ids keep their rows, each with its own text's component; a
null id never names a component that has another, and is null alone; other
columns are left out by ``link`` and kept by ``one_of_each``; an empty table
gives no row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm import shingles as S
from quern.llm.common import Scratch, materialize, read_table, release, ship
from quern.llm.graph import components
from quern.llm.grams import slices

#: Members of a group that are compared with each other in one piece, and of a pivot that one task verifies.
BLOCK = 1024
LEAST_BLOCK = 64
SLICE = 256
#: Groups of more classes than this may be left out, the largest first.
HOT = 2
#: Sets whose keys a task has sent are remembered, so many at most; forgetting one only sends keys again.
REMEMBERED = 200_000

#: A sample of one text in so many finds the keys that more than a share of the classes have, if that is more than a few.
SAMPLED, COMMON_SHARE, COMMON_LEAST, COMMON_MOST = 64, 0.001, 64, 1_000_000
#: Bits of a class's first hash; tests take fewer.
HASH_BITS = 64

_SETS = "doc_id long, t long, n int, h long, c long, sketch binary"
_KEYS = "h long, n int, keys array<long>"


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def set_hash(s: np.ndarray, salt: int = 11) -> int:
    return int(np.bitwise_xor.reduce(S.mix(s, salt)).view(np.int64) ^ np.int64(len(s))) if len(s) else 0


@dataclass(frozen=True)
class Ids:
    """Class ids of sets: a hash, or where two sets share it a hash of that and another."""

    bits: int
    shared: frozenset[int] = frozenset()

    def __call__(self, s: np.ndarray) -> int:
        h = set_hash(s) >> (64 - self.bits)
        return h if h not in self.shared else int(S.mix(np.array([h, set_hash(s, 12)], np.int64).view(np.uint64), 13)[[0, 1]].sum().view(np.int64))


class _Seen:
    """Sets that one task has met; forgetting some only repeats work."""

    def __init__(self) -> None:
        self.held: set[int] = set()

    def new(self, h: int) -> bool:
        if h in self.held:
            return False
        if len(self.held) >= REMEMBERED:
            self.held.clear()
        self.held.add(h)
        return True


def _sets(ids: Ids, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, t) -> every row's set size and hash; the sketch of each set once per task."""
    seen = _Seen()
    for part in slices(batches):
        sets = [S.shingle_set(t) for t in part.column(1).to_pylist()]
        hashes, others = [ids(s) if len(s) else 0 for s in sets], [set_hash(s, 12) for s in sets]
        sketches = [S.sketch(s) if len(s) and seen.new(h) else None for s, h in zip(sets, hashes)]
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(map(len, sets), pa.int32()), pa.array(hashes, pa.int64()), pa.array(others, pa.int64()), pa.array(sketches, pa.binary())], ["doc_id", "t", "n", "h", "c", "sketch"])


def _keys(ids: Ids, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) -> every non-empty set's join keys, once per task. Made anew rather than stored: there are hundreds for each text."""
    seen = _Seen()
    for part in slices(batches):
        sets = [(h, s) for s in map(S.shingle_set, part.column(0).to_pylist()) if len(s) and seen.new(h := ids(s))]
        keys = [_signed(S.parts(s)) for _, s in sets]
        offsets = np.r_[0, np.cumsum([len(k) for k in keys])].astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *keys])))
        yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in sets], pa.int64()), pa.array([len(s) for _, s in sets], pa.int32()), lists], ["h", "n", "keys"])


def _near(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(x, y, nx, ny, sx, sy) -> the pairs that sizes and sketches leave."""
    for batch in slices(rows, 2000):
        x, y, nx, ny, sx, sy = (batch.column(k) for k in range(6))
        keep = [S.distance(a.as_py(), b.as_py()) <= S.may_differ(p, q) for a, b, p, q in zip(sx, sy, nx.to_pylist(), ny.to_pylist())]
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in (x, y)], ["x", "y"])


def _sizes_fit(a: str, b: str) -> Column:
    p, q = S.NEED
    return (F.col(a) * q >= F.col(b) * p) & (F.col(b) * q >= F.col(a) * p)


def _verify(ids: Ids, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (pivot, slice, first, h, text), a slice's pivot ahead of its members -> (src, dst) of similar sets."""
    own, at = None, None
    for batch in slices(batches):
        src, dst = [], []
        for pivot, part, first, h, text in zip(*(batch.column(k).to_pylist() for k in range(5))):
            s = S.shingle_set(text)
            if not len(s) or ids(s) != h:  # another text under a repeated id
                continue
            if first:
                own, at = s, (pivot, part)
            elif at == (pivot, part) and S.similar(own, s):
                src.append(h)
                dst.append(pivot)
        yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, ids: Ids, scratch: Scratch) -> DataFrame:
    """(src, dst) of the distinct ``pairs`` (x, y = pivot) that are similar, on the whole texts of one document of each class."""
    members = pairs.select(F.col("x").alias("h"), F.col("y").alias("pivot"), F.pmod(F.xxhash64("x"), F.lit(2**31 - 1)).alias("deal"))
    slices = pairs.groupBy("y").agg(F.ceil(F.count(F.lit(1)) / SLICE).cast("int").alias("slices"))
    slices = scratch.table(slices.withColumnRenamed("y", "pivot"), "slices")
    dealt = members.join(slices, "pivot").select("h", "pivot", F.pmod("deal", "slices").cast("int").alias("slice"), F.lit(False).alias("first"))
    heads = slices.select(F.col("pivot").alias("h"), "pivot", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(True).alias("first"))
    roles = dealt.unionByName(heads).join(classes.select("h", F.col("rep").alias("doc_id")), "h")
    roles = scratch.table(roles, "roles")
    known = roles.select(F.col("doc_id").alias("known")).distinct()
    texts = docs.join(known, F.col("doc_id").eqNullSafe(F.col("known")), "left_semi").select(F.col("doc_id").alias("of"), "text")
    texts = scratch.table(texts, "texts")
    rows = roles.join(texts, F.col("doc_id").eqNullSafe(F.col("of"))).select("pivot", "slice", "first", "h", "text")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartition(parts, "pivot", "slice").sortWithinPartitions("pivot", "slice", F.desc("first"))
    return scratch.table(ordered.mapInArrow(partial(_verify, ids), "src long, dst long"), "links")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (gid, i, j, side, h, component, n, sketch), by block: pairs of members of different components that may be similar."""
    held: list[tuple] = []
    now = None

    def compare() -> pa.RecordBatch | None:
        """Each left member with the right members of every sketch length, both brought to the shorter of the two."""
        whole = held[0][0] == 2
        right: dict[int, list[tuple]] = {}
        for r in held:
            if r[0] in (1, 2):
                right.setdefault(len(r[4]), []).append(r)
        facts = {k: tuple(np.array([r[x] for r in rs]) for x in (1, 2, 3)) for k, rs in right.items()}
        tables: dict[tuple[int, int], np.ndarray] = {}
        out_x, out_y = [], []
        for side, h, component, n, sketch in held:
            if side == 1:
                continue
            for k, (hr, cr, nr) in facts.items():
                most = (S.NEED[1] - S.NEED[0]) * (n + nr) // (S.NEED[1] + S.NEED[0])
                fits = (cr != component) & (np.abs(nr - n) <= most)
                if whole:
                    fits &= hr < h
                if not fits.any():
                    continue
                size = min(k, len(sketch))
                if (k, size) not in tables:
                    tables[k, size] = np.stack([S.folded(r[4], size) for r in right[k]]).view(np.uint64)
                away = np.bitwise_count(tables[k, size][fits] ^ S.folded(sketch, size).view(np.uint64)).sum(axis=1)
                for y in hr[fits][away <= most[fits]].tolist():
                    out_x.append(max(h, y))
                    out_y.append(min(h, y))
        return pa.RecordBatch.from_arrays([pa.array(out_x, pa.int64()), pa.array(out_y, pa.int64())], ["x", "y"]) if out_x else None

    for batch in slices(batches, 2000):
        for gid, i, j, side, h, component, n, sketch in zip(*(batch.column(k).to_pylist() for k in range(8))):
            if (gid, i, j) != now:
                if held and (found := compare()):
                    yield found
                held, now = [], (gid, i, j)
            held.append((side, h, component, n, sketch))
    if held and (found := compare()):
        yield found


def _rest(groups: DataFrame, labels: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame:
    """Distinct pairs (x, y) that stars left untested: members of one group, in different components, that sketches leave.

    Groups with one pivot are taken as one: their members overlap widely, and each is then sent there once. A group that
    is large among the others is cut into more blocks, so that its pairs of blocks are dealt evenly over the tasks.
    """
    spark = groups.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    several = groups.where("size > 2 and h <> pivot").select(F.col("pivot").alias("gid"), "h").distinct()
    members = several.join(labels.select(F.col("node").alias("h"), "component"), "h", "left").select("gid", "h", F.coalesce("component", "h").alias("component"))
    split = members.groupBy("gid").agg((F.min("component") < F.max("component")).alias("several"), F.count(F.lit(1)).alias("m"))
    split = scratch.table(split.where("several").select("gid", "m"), "split")
    total = split.agg(F.sum("m")).first()[0] or 0
    fine = F.when(F.col("m") * 4 * parts > total, F.least(F.ceil(F.col("m") / LEAST_BLOCK), F.lit(math.ceil(math.sqrt(8 * parts))))).otherwise(1)
    split = split.select("gid", F.greatest(F.ceil(F.col("m") / BLOCK), fine).cast("int").alias("blocks"))
    open_ones = members.join(split, "gid").join(classes.select("h", "n", "sketch"), "h")
    block = F.pmod(F.xxhash64("h"), F.col("blocks")).cast("int")
    spot = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))
    spots = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: spot(F.least(k, F.col("b")), F.greatest(k, F.col("b")), F.when(k == F.col("b"), 2).when(F.col("b") < k, 0).otherwise(1)))
    laid = open_ones.withColumn("b", block).withColumn("s", F.explode(spots)).select("gid", "s.i", "s.j", "s.side", "h", "component", "n", "sketch")
    ordered = laid.repartition(parts, "gid", "i", "j").sortWithinPartitions("gid", "i", "j")
    return scratch.table(ordered.mapInArrow(_blocks, "x long, y long").distinct(), "rest")


def _common_keys(docs: DataFrame, ids: Ids, scratch: Scratch) -> DataFrame | None:
    """(key, number, about): keys of a large share of the sampled classes, numbered from 1, and about how many classes have each.

    The share bounds their number, which is checked all the same.
    """
    sample = docs.where(F.pmod(F.xxhash64("text", F.lit(7)), F.lit(SAMPLED)) == 0).select("text")
    keyed = scratch.table(sample.mapInArrow(partial(_keys, ids), _KEYS).select("h", F.explode("keys").alias("key")), "sampled-keys")
    least = max(COMMON_LEAST, COMMON_SHARE * keyed.select("h").distinct().count())
    common = scratch.table(keyed.distinct().groupBy("key").agg((F.count(F.lit(1)) * SAMPLED).alias("about")).where(F.col("about") >= least * SAMPLED), "common-keys")
    if not 0 < common.count() <= COMMON_MOST:
        return None
    return scratch.table(common.select("key", F.row_number().over(W.orderBy("key")).alias("number"), "about"), "numbered-keys")


def _groups(docs: DataFrame, ids: Ids, scratch: Scratch) -> DataFrame:
    """(gid, h, pivot, size): classes with an equal key, equal groups once.

    Every class leaves out the keys that most others share, as many as it may
    (``shingles.spare``): a passage that many documents hold gives large groups
    and says little, and similar sets still meet under their other keys.
    """
    common = _common_keys(docs, ids, scratch)
    keyed = docs.select("text").mapInArrow(partial(_keys, ids), _KEYS).select("h", F.col("n").cast("long").alias("n"), F.explode("keys").alias("spot"))
    if common is not None:
        # rows of a common key need no company, as its group goes by its number: that travels in the upper half of n
        held = F.broadcast(common.select(F.col("key").alias("spot"), "number"))
        dealt = F.when(F.col("number").isNull(), F.col("spot")).otherwise(F.xxhash64("spot", "h"))
        keyed = keyed.join(held, "spot", "left").select("h", F.col("n").bitwiseOR(F.shiftleft(F.coalesce("number", F.lit(0)).cast("long"), 32)).alias("n"), dealt.alias("spot"))
    same = W.partitionBy("spot")
    met = keyed.select("h", "n", "spot", F.count(F.lit(1)).over(same).alias("size"), F.min("h").over(same).alias("low"), F.max("h").over(same).alias("high"), F.min(F.xxhash64("h")).over(same).alias("mark"))
    number = F.shiftright("n", 32).cast("int")
    met = met.where((number > 0) | (F.col("low") != F.col("high"))).withColumns({"number": number, "n": F.col("n").bitwiseAND(F.lit(2**32 - 1)).cast("int")})
    gid, firm = F.xxhash64("low", "high", "mark"), F.col("spot") % 2 != 0
    if common is not None:
        told = F.broadcast(common.select("number", "about", (F.col("key") % 2 != 0).alias("odd")))
        met = met.join(told, "number", "left").withColumn("size", F.coalesce("about", "size"))
        gid, firm = F.when(F.col("number") > 0, F.xxhash64("number", F.lit("common"))).otherwise(gid), F.coalesce("odd", firm)
    once = met.groupBy(gid.alias("gid"), "h", firm.alias("firm")).agg(F.max("n").alias("n"), F.max("size").alias("size"), F.count(F.lit(1)).alias("keys"))
    largest = W.partitionBy("h").orderBy(F.desc("size"), "gid").rowsBetween(W.unboundedPreceding, 0)
    counts = ~F.col("firm") & (F.col("size") > HOT)
    left_out = counts & (F.sum(F.when(counts, F.col("keys")).otherwise(0)).over(largest) <= F.floor(F.col("n") / S.SPARE))
    kept = once.withColumn("_out", left_out).where("not _out")
    members = scratch.table(kept.groupBy("gid", "h").agg(F.max("n").alias("n")), "members")
    told = members.groupBy("gid").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("h", "n")).alias("p")).where("size > 1")
    told = scratch.table(told.select("gid", "size", F.col("p.h").alias("pivot"), F.col("p.n").alias("pivot_n")), "told")
    return members.join(told, "gid").select("gid", "h", "n", "size", "pivot", "pivot_n")


def _classes(sets: DataFrame, scratch: Scratch) -> DataFrame:
    told = sets.where("n > 0").groupBy("h").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.max("sketch").alias("sketch"), (F.min("c") < F.max("c")).alias("mixed"))
    return scratch.table(told, "classes")


def _linked(docs: DataFrame) -> DataFrame:
    """doc_id, t (the text's hash), n, h, component (null for an empty set) and component_id of every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select("doc_id", "text")
    with Scratch(spark, "ngram-join") as scratch:
        ids = Ids(HASH_BITS)
        classed = lambda: scratch.table(docs.withColumn("t", F.xxhash64("text")).mapInArrow(partial(_sets, ids), _SETS), "sets")
        sets = classed()
        classes = _classes(sets, scratch)
        # of n classes about n * n / 2**65 pairs share 64 bits: a handful in any corpus
        if shared := [r.h for r in classes.where("mixed").select("h").collect()]:
            ids = Ids(HASH_BITS, frozenset(shared))
            sets = classed()
            classes = _classes(sets, scratch)
        told = sets.select("doc_id", "t", "n", "h")

        groups = scratch.table(_groups(docs, ids, scratch), "groups")
        release(spark)
        sides = lambda side: classes.select(F.col("h").alias(side), F.col("n").alias(f"n{side}"), F.col("sketch").alias(f"s{side}"))
        stars = groups.where((F.col("h") != F.col("pivot")) & _sizes_fit("n", "pivot_n")).select(F.col("h").alias("x"), F.col("pivot").alias("y")).distinct()
        stars = scratch.table(stars.join(sides("x"), "x"), "stars")
        near = stars.join(sides("y"), "y").select("x", "y", "nx", "ny", "sx", "sy")
        near = scratch.table(near.mapInArrow(_near, "x long, y long"), "near")
        release(spark)
        links = verified(near, classes, docs, ids, scratch)
        labels = scratch.table(components(links), "labels")
        rest = _rest(groups, labels, classes, scratch)
        release(spark)
        if not rest.isEmpty():
            links = links.unionByName(verified(rest, classes, docs, ids, scratch))
            labels = scratch.table(components(links), "labels")

        named = classes.select("h", "rep").join(labels.withColumnRenamed("node", "h"), "h", "left").withColumn("component", F.coalesce("component", "h"))
        named = scratch.table(named, "named")
        least = scratch.table(named.groupBy("component").agg(F.min("rep").alias("component_id")), "least")
        of_class = scratch.table(named.select("h", "component").join(least, "component"), "of-class")
        component_id = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
        done = told.join(of_class, "h", "left").select("doc_id", "t", "n", "h", F.when(F.col("n") > 0, F.col("component")).alias("component"), component_id.alias("component_id"))
        return materialize(done, "join-linked")


def link(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text)."""
    return _linked(docs).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` (doc_id, text and any others) for each component: the smallest id, null last, then the smallest set and text hash.

    An id may repeat with unrelated texts; each row goes by its own text. Empty
    sets link with nothing: their rows stay, one for each id and text, and all
    that have no id.
    """
    linked = _linked(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h", "t")).alias("x")
    chosen = linked.where("n > 0").groupBy("component").agg(first).select("x.doc_id", "x.t")
    alone = linked.where("n = 0 and doc_id is not null").select("doc_id", "t").distinct()
    blank = linked.where("n = 0 and doc_id is null").select("t").distinct()
    kept = materialize(chosen.unionByName(alone).select(F.col("doc_id").alias("_id"), F.col("t").alias("_t")), "join-kept")
    blank = materialize(blank.select(F.col("t").alias("_t")), "join-blank")

    hashed = lambda df: df.withColumn("_t", F.xxhash64("text"))
    own = hashed(docs).alias("d").join(kept.alias("k"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("d._t") == F.col("k._t")), "left_semi").select(*docs.columns)
    if not linked.groupBy("doc_id", "t").count().where("count > 1").isEmpty():
        # rows of one id and text: the one whose columns have the smallest hash
        own = hashed(own).groupBy("doc_id", "_t").agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("x")).select("x.*")
    return own.unionByName(hashed(docs.where("doc_id is null")).join(blank, "_t", "left_semi").select(*docs.columns))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(read_table(spark, sf_dir, "documents"))
