"""Ranked lexical search over an index of clusters, with exact stopping.

Recursive graph bisection reorders the documents so that like documents stand
together (see ``bisection``). Its first halvings are learned from a sample of at
most ``SAMPLE`` documents, and every document goes down that tree; a leaf is dealt
to as many parts as its size asks for, so a group of copies of any size is split;
within a part the bisection goes on over all the part's documents, down to
clusters of at most ``CLUSTER``. A cluster is one row: its documents' ids and
postings, and for each term the most that it adds to any of its documents' scores.

An item's bound for a cluster is the sum of these over its terms. Clusters are
visited by falling bound, in waves that grow eightfold; after each wave an item
has the score of its ``k``-th document so far, and it stops when no cluster is
left whose bound reaches that score. A cluster whose bound equals it is visited
too, as a smaller doc_id there would come first: ids are mapped back from the
reordered places before ties are told. So the result is that of scoring all.

The index holds the terms of the items. Items go in blocks of at most
``BLOCK_ITEMS`` items or about ``BLOCK_TERMS`` terms; what the driver holds and
sends to tasks (the block's terms, a document frequency for each, three numbers
an item) is bounded by the block, whatever the number of documents.

Defined results: a null or empty document or item has no terms and is in no
result; repeated documents are ranked each, equal scores by doc_id, a null id
first; repeated items are answered each; other columns are left out; an empty
table on either side gives no row.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm import bisection
from quern.llm.common import Scratch, bounded_sample, materialize, read_table, ship
from quern.llm.grams import slices

TOP = 20
SAMPLE, DEPTH = 8192, 5
#: Documents of a part, which one task bisects further, and of a cluster.
PART, CLUSTER = 4096, 256
BLOCK_ITEMS, BLOCK_TERMS = 4096, 250_000
#: Clusters that an item visits in its first wave, and how much more in each further one.
FIRST_WAVE, WAVE_GROWTH = 2, 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What a text's UTF-8 bytes become: letters lower-cased, digits and bytes of other characters as they are, the rest spaces, at which terms part.
TERM_BYTES = bytes(b if b > 127 or chr(b) in LOWER + "0123456789" else ord(chr(b).lower()) if chr(b) in UPPER else 32 for b in range(256))
EXACT = 2**53


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TERM_BYTES).split()


@dataclass
class Items:
    """A block of items: ids, its terms by number, and which items hold a term how often."""

    ids: list
    numbers: dict[bytes, int]
    starts: np.ndarray  # by term, into the next two
    item: np.ndarray
    times: np.ndarray

    @staticmethod
    def of(rows: list[tuple]) -> Items:
        numbers: dict[bytes, int] = {}
        held = [(numbers.setdefault(t, len(numbers)), i, n) for i, (_, text) in enumerate(rows) for t, n in Counter(terms_of(text)).items()]
        held.sort()
        term, item, times = (np.array([h[k] for h in held], np.int64) for k in range(3))
        return Items([r[0] for r in rows], numbers, np.searchsorted(term, np.arange(len(numbers) + 1)), item, times)

    def bounds(self, terms: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Each item's sum of ``most`` over its ``terms``."""
        at, n = bisection.spans(self.starts, terms)
        return _summed(self.item[at], self.times[at] * np.repeat(most, n), len(self.ids))

    def by_item(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, terms, times) with the items as rows."""
        order = np.argsort(self.item, kind="stable")
        term = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))[order]
        return np.searchsorted(self.item[order], np.arange(len(self.ids) + 1)), term, self.times[order]


def _summed(keys: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Exact sums of whole numbers by key."""
    if len(values) == 0 or int(values.max()) * len(values) < EXACT:
        return np.bincount(keys, values, n).astype(np.int64)
    out = np.zeros(n, np.int64)
    np.add.at(out, keys, values)
    return out


@dataclass
class Weights:
    """What scores need of the whole corpus: documents with terms, all their terms, and each term's weight."""

    docs: int
    all_terms: int
    weight: np.ndarray

    @staticmethod
    def of(docs: int, all_terms: int, df: np.ndarray) -> Weights:
        return Weights(docs, all_terms, np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64))

    def adds(self, terms: np.ndarray, times: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """What each posting adds to its document's score; ``sizes``: the document's number of terms."""
        if len(sizes) and int(sizes.max()) * 25 * self.docs >= 2**63:
            sizes = sizes.astype(object)
        m = (100 - 25 + (25 * sizes * self.docs) // max(1, self.all_terms)).astype(np.int64)
        return self.weight[terms] * ((1_000_000_000 * times) // (1000 * times + 12 * m))


def _lists(rows: list, kind: pa.DataType) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else [], kind))


def _csr(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(starts, values) of a list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy().astype(np.int64)
    return offsets - offsets[0], column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]


_POSTINGS = "doc_id long, size long, terms array<int>, times array<int>"


def _post(items, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    numbers = items.value.numbers
    for batch in slices(batches):
        ids, sizes, terms, times = [], [], [], []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = text.translate(TERM_BYTES).split()
            if words:
                own = [(numbers[t], n) for t, n in Counter(words).items() if t in numbers]
                ids.append(doc)
                sizes.append(len(words))
                terms.append(np.array([x[0] for x in own], np.int32))
                times.append(np.array([x[1] for x in own], np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), _lists(terms, pa.int32()), _lists(times, pa.int32())], ["doc_id", "size", "terms", "times"])


def _deal(tree, parts: np.ndarray, first: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``leaf``, or with ``parts`` of each leaf ``part``: the row's number decides among the parts of its leaf."""
    for batch in batches:
        names = batch.schema.names
        leaf = tree.value.leaf_of(*_csr(batch.column(names.index("terms"))))
        if parts is None:
            yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int64())], ["leaf"])
        else:
            row = batch.column(names.index("row")).to_numpy().astype(np.uint64)
            row = ((row ^ (row >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(33)
            spot = first[leaf] + (row % parts[leaf].astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spot, pa.int64())], [*names, "part"])


_CLUSTERS = "part long, cluster long, ids array<long>, sizes array<long>, counts array<int>, terms array<int>, times array<int>, top_terms array<int>, most array<long>"


def _cluster(weights, size: int, table: pa.Table) -> pa.Table:
    """A part's documents, in the order of bisection, as rows of clusters."""
    starts, terms = _csr(table.column("terms"))
    terms, times = terms.astype(np.int64), _csr(table.column("times"))[1].astype(np.int64)
    ids, sizes = table.column("doc_id").to_pylist(), table.column("size").to_numpy()
    rows = []
    for k, docs in enumerate(bisection.ordered(starts, terms, size)):
        at, n = bisection.spans(starts, docs)
        adds = weights.value.adds(terms[at], times[at], np.repeat(sizes[docs], n))
        order = np.argsort(terms[at], kind="stable")
        met = terms[at][order]
        edge = np.flatnonzero(np.concatenate([[True], met[1:] != met[:-1]]))
        rows.append([table.column("part")[0].as_py(), k, [ids[d] for d in docs], sizes[docs], n.astype(np.int32), terms[at].astype(np.int32), times[at].astype(np.int32), met[edge].astype(np.int32), np.maximum.reduceat(adds[order], edge)])
    names = [x.split()[0] for x in _CLUSTERS.split(", ")]
    kinds = [pa.int64(), pa.int64(), *(pa.list_(x) for x in (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64()))]
    return pa.table([pa.array([r[c] for r in rows], kinds[c]) for c in range(len(kinds))], names)


def build(docs: DataFrame, items, scratch: Scratch, text: str = "text", key: str = "doc_id", sample: int = SAMPLE, cluster: int = CLUSTER, part: int = PART) -> tuple[DataFrame, Weights]:
    """The clusters of all documents that hold a term of ``items`` (a broadcast ``Items``), and the corpus's weights."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    told = docs.select(F.col(key).cast("long").alias("doc_id"), body.alias("t")).mapInArrow(partial(_post, items), _POSTINGS)
    posted = scratch.table(told.withColumn("row", F.monotonically_increasing_id()), "postings")  # written, so the numbers stay
    n, total = posted.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    df = np.zeros(len(items.value.numbers), np.int64)
    for r in posted.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect():  # a row for each of the block's terms
        df[r.t] = r.n
    weights = Weights.of(n, total, df)
    rows = posted.where(F.size("terms") > 0)
    drawn = [np.array(r.terms, np.int64) for r in bounded_sample(rows.select("row", "terms"), "row", sample).collect()]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in drawn])]).astype(np.int64)
    tree = spark.sparkContext.broadcast(bisection.Tree.fit(starts, np.concatenate([np.zeros(0, np.int64), *drawn]), len(df), DEPTH))
    counts = np.zeros(2**DEPTH, np.int64)
    for r in rows.select("terms").mapInArrow(partial(_deal, tree, None, None), "leaf long").groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r.leaf] = r.n
    parts = np.maximum(1, -(-counts // part))
    dealt = rows.mapInArrow(partial(_deal, tree, parts, np.cumsum(parts) - parts), f"{_POSTINGS}, row long, part long")
    sent = spark.sparkContext.broadcast(weights)
    clusters = dealt.drop("row").groupBy("part").applyInArrow(lambda table: _cluster(sent, cluster, table), _CLUSTERS)
    return scratch.table(clusters, "clusters"), weights


def _bound(items, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, cluster, terms, most in zip(*(batch.column(k) for k in range(4))):
            bound = items.value.bounds(np.array(terms.as_py(), np.int64), np.array(most.as_py(), np.int64))
            hit = np.flatnonzero(bound)
            n = len(hit)
            yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int64()), pa.array(np.full(n, part.as_py())), pa.array(np.full(n, cluster.as_py())), pa.array(bound[hit])], ["item", "part", "cluster", "bound"])


def _visit(items, weights, low: np.ndarray, high: np.ndarray, reached: np.ndarray, k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The best ``k`` of each visited cluster for the items whose bound lies from ``low`` to below ``high``."""
    block = items.value
    starts, terms_of_item, times_of_item = block.by_item()
    for batch in batches:
        for row in (r for at in range(batch.num_rows) for r in batch.slice(at, 1).to_pylist()):
            bound = block.bounds(np.array(row["top_terms"], np.int64), np.array(row["most"], np.int64))
            chosen = np.flatnonzero((bound >= low) & (bound < high))
            if not len(chosen):
                continue
            counts, terms = np.array(row["counts"], np.int64), np.array(row["terms"], np.int64)
            n = len(counts)
            doc = np.repeat(np.arange(n), counts)
            adds = weights.value.adds(terms, np.array(row["times"], np.int64), np.repeat(np.array(row["sizes"], np.int64), counts))
            order = np.argsort(terms, kind="stable")
            doc, adds, met = doc[order], adds[order], terms[order]
            named = np.array([(-1, 0) if d is None else (0, d) for d in row["ids"]], np.int64)
            out: list[tuple] = []
            for i in chosen:
                own, times = terms_of_item[starts[i] : starts[i + 1]], times_of_item[starts[i] : starts[i + 1]]
                a, b = np.searchsorted(met, own, "left"), np.searchsorted(met, own, "right")
                own_n = b - a
                at = np.repeat(a - np.cumsum(own_n) + own_n, own_n) + np.arange(int(own_n.sum()))
                score = _summed(doc[at], adds[at] * np.repeat(times, own_n), n)
                good = np.flatnonzero((score > 0) & (score >= reached[i]))
                good = good[np.lexsort((named[good, 1], named[good, 0], -score[good]))[:k]]
                out += [(int(i), row["ids"][d], int(score[d])) for d in good]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in range(3)], ["item", "doc_id", "score"])


def _search_block(docs: DataFrame, block: Items, k: int, scratch: Scratch, **options) -> DataFrame:
    """item (number in the block), doc_id, score, rank."""
    spark = docs.sparkSession
    items = spark.sparkContext.broadcast(block)
    clusters, own = build(docs, items, scratch, **options)
    weights = spark.sparkContext.broadcast(own)
    bounds = scratch.table(clusters.select("part", "cluster", "top_terms", "most").mapInArrow(partial(_bound, items), "item long, part long, cluster long, bound long"), "bounds")
    n = len(block.ids)
    high, reached, wave = np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64), FIRST_WAVE
    by_score = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    best = spark.createDataFrame([], "item long, doc_id long, score long, rank int")
    while True:
        ends = spark.createDataFrame([(i, int(h), int(r)) for i, (h, r) in enumerate(zip(high, reached))], "item long, high long, reached long")
        left = bounds.join(F.broadcast(ends), "item").where("bound < high and bound >= reached")  # a row an item of the block
        first = left.withColumn("place", F.row_number().over(W.partitionBy("item").orderBy(F.desc("bound")))).where(F.col("place") <= wave)
        low = {r.item: r.low for r in first.groupBy("item").agg(F.min("bound").alias("low")).collect()}
        if not low:
            return best
        lows = np.array([low.get(i, np.iinfo(np.int64).max) for i in range(n)])
        met = clusters.mapInArrow(partial(_visit, items, weights, lows, high, reached, k), "item long, doc_id long, score long")
        ranked = best.drop("rank").unionByName(met).withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
        best = scratch.table(ranked, "best")
        for r in best.where(F.col("rank") == k).select("item", "score").collect():
            reached[r.item] = r.score
        high = np.where(lows == np.iinfo(np.int64).max, 0, lows)  # an item without clusters left is done
        wave *= WAVE_GROWTH


def blocks(items: DataFrame, key: str, text: str) -> Iterator[Items]:
    held, size = [], 0
    for row in items.select(F.col(key).alias("k"), F.col(text).alias("t")).toLocalIterator(prefetchPartitions=False):
        held.append((row.k, row.t))
        size += len(terms_of(row.t))
        if len(held) >= BLOCK_ITEMS or size >= BLOCK_TERMS:
            yield Items.of(held)
            held, size = [], 0
    if held:
        yield Items.of(held)


def search(docs: DataFrame, items: DataFrame, k: int = TOP, item_key: str = "item_id", item_text: str = "text", **options) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of every item."""
    spark, found = docs.sparkSession, []
    ship(spark)
    kind = items.schema[item_key].dataType.simpleString()
    for block in blocks(items, item_key, item_text):
        with Scratch(spark, "ranked-search") as scratch:
            best = _search_block(docs, block, k, scratch, **options)
            names = spark.createDataFrame(list(enumerate(block.ids)), f"item long, item_id {kind}")
            named = best.join(F.broadcast(names), "item").select(F.col("item_id").alias(item_key), F.col("rank").cast("int").alias("rank"), "doc_id", "score")
            found.append(materialize(named, "ranked-result"))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], f"{item_key} {kind}, rank int, doc_id long, score long")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS words FROM documents),
sized AS (SELECT rn, doc_id, len(words) AS n, words FROM d WHERE len(words) > 0),
s AS (SELECT count(*)::BIGINT AS all_docs, sum(n)::BIGINT AS all_terms FROM sized),
i AS (SELECT row_number() OVER () AS q, item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS words FROM benchmark),
it AS (SELECT q, item_id, term, count(*) AS times FROM (SELECT q, item_id, unnest(words) AS term FROM i) GROUP BY 1, 2, 3),
tf AS (SELECT rn, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT rn, doc_id, n, unnest(words) AS term FROM sized) WHERE term IN (SELECT term FROM it) GROUP BY 1, 2, 3, 4),
w AS (SELECT term, floor(1000 * ln((2 * all_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY 1), s),
score AS (SELECT q, item_id, rn, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * all_docs) // all_terms))))::BIGINT AS score
          FROM tf JOIN w USING (term) JOIN it USING (term), s GROUP BY 1, 2, 3, 4)
SELECT item_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS FIRST)::INTEGER AS rank, doc_id, score FROM score WHERE score > 0 QUALIFY rank <= {TOP}
"""
