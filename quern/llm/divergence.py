"""How the sources of a language differ in their terms: pairwise divergence, and each source's most marked terms.

Counts of terms come from one pass over the documents and one shuffle of partial
counts. A group (language and source) gives a term a smoothed share of a
thousand million; two shares p and q differ by floor((p - q)^2 / (p + q)).

Pairs of sources are sparse and corrected by a baseline: terms that neither of
two sources has all differ by the same amount, so the sum starts from that
amount for every kept term; terms of one source are corrected by a histogram of
its shares, and only terms of both meet in a join.

The most marked terms are found by radix selection, without sorting a group: a
histogram over the highest bits of the values tells in which bin a group's k-th
value lies, the next bits narrow it down to the value itself; rows that tie at it
are refined the same way by the bytes of their terms, two at a time, past the
bytes that all of them share. Only k rows a group are ever ranked in one place.

Defined results: a null text, language or source counts as empty; a text without
terms adds its group and no term; a language without kept terms has pairs of
value 0; repeated rows count each; other columns are left out; an empty table
gives no row.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm.common import Scratch, materialize, read_table, ship
from quern.llm.grams import slices

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What a text's UTF-8 bytes become: letters lower-cased, bytes of other characters as they are, the rest spaces, at which terms part.
TERM_BYTES = bytes(b if b > 127 or chr(b) in LOWER else ord(chr(b).lower()) if chr(b) in UPPER else 32 for b in range(256))
#: Partial counts that a task holds, and rows of them that it sends on at a time.
HELD_TERMS, ROWS_OUT = 200_000, 20_000
LEAST_DOCS, TOP = 10, 10
WHOLE = 1_000_000_000
#: Bits of a value, and bytes of a term, that one histogram tells apart.
DIGIT_BITS, DIGIT_BYTES = 11, 2


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of lang, source, term; they go out whenever ``HELD_TERMS`` of them are held."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def told() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = list(n)
            for at in range(0, len(terms), ROWS_OUT):
                own = terms[at : at + ROWS_OUT]
                columns = [pa.array([lang] * len(own)), pa.array([source] * len(own)), pa.array(own, pa.binary()).cast(pa.string()), pa.array([n[t] for t in own], pa.int64()), pa.array([docs[t] for t in own], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])
        held.clear()

    for batch in slices(batches):
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
            words = text.translate(TERM_BYTES).split()
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            n.update(words)
            docs.update(set(words))
        if sum(len(n) for n, _ in held.values()) >= HELD_TERMS:
            yield from told()
    yield from told()


def term_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents that hold it)."""
    ship(docs.sparkSession)
    told = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(k) for c, k in (("lang", "lang"), ("source", "source"))), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    counted = told.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(WHOLE * (count + 2) / (total + 2 * kept)), exact."""
    return F.lit(1) + F.call_function("div", F.lit(WHOLE).cast("decimal(10,0)") * (count + 2).cast("decimal(19,0)"), (total + 2 * kept).cast("decimal(19,0)"))


def differs(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def select_top(rows: DataFrame, by: list[str], value: str, item: str, k: int, scratch: Scratch) -> DataFrame:
    """The ``k`` rows of each group ``by`` with the largest ``value`` (a whole number, at least 0), then the smallest ``item``
    by its UTF-8 bytes, and their ``rank``. A group has no item twice. Columns: by, item, value, rank."""
    rows = scratch.table(rows.select(*by, item, value), "candidates")
    top = rows.agg(F.max(value)).first()[0]
    if top is None:
        return rows.withColumn("rank", F.lit(0)).where("false")
    shift = max(1, int(top).bit_length())
    # by group: the bits found so far of its k-th value, and how many rows with these bits it still takes
    state = rows.groupBy(*by).agg(F.lit(0).cast("long").alias("prefix"), F.least(F.lit(k).cast("long"), F.count(F.lit(1))).alias("need"))
    while shift > 0:
        inside = rows.join(state.select(*by, "prefix", "need"), by).where(F.shiftright(value, shift) == F.col("prefix"))
        shift = max(0, shift - DIGIT_BITS)
        digit = F.shiftright(F.col(value), shift)  # the bits before it are the same in a group
        bins = inside.groupBy(*by, digit.alias("prefix")).agg(F.count(F.lit(1)).alias("rows"), F.first("need").alias("need"))
        state = _bin_of_kth(bins, by, F.desc("prefix"))
    joined = rows.join(scratch.table(state, "bins"), by)
    whole = F.col("need") == F.col("rows")
    parts = [joined.where((F.col(value) > F.col("prefix")) | (F.col(value) == F.col("prefix")) & whole).select(*by, item, value)]
    tied = scratch.table(joined.where((F.col(value) == F.col("prefix")) & ~whole).select(*by, item, value, "need"), "tied")
    while not tied.isEmpty():
        raw = F.col(item).cast("binary")
        ends = tied.groupBy(*by).agg(F.min(raw).alias("low"), F.max(raw).alias("high"))
        least = F.least(F.length("low"), F.length("high"))
        same = F.expr("coalesce(array_position(transform(sequence(1, greatest(1, least(length(low), length(high)))), i -> substring(low, i, 1) = substring(high, i, 1)), false) - 1, -1)")
        shared = F.when(least == 0, 0).when(same < 0, least).otherwise(same).cast("int").alias("shared")
        spots = tied.join(scratch.table(ends.select(*by, shared), "shared"), by).withColumn("digit", F.substring(raw, F.col("shared") + 1, F.lit(DIGIT_BYTES)))
        bins = spots.groupBy(*by, "digit").agg(F.count(F.lit(1)).alias("rows"), F.first("need").alias("need"))
        kth = scratch.table(_bin_of_kth(bins, by, F.asc("digit")), "bins").select(*by, F.col("digit").alias("_digit"), F.col("need").alias("_need"), "rows")
        met = spots.join(kth, by)
        whole = F.col("_need") == F.col("rows")
        parts.append(met.where((F.col("digit") < F.col("_digit")) | (F.col("digit") == F.col("_digit")) & whole).select(*by, item, value))
        tied = scratch.table(met.where((F.col("digit") == F.col("_digit")) & ~whole).select(*by, item, value, F.col("_need").alias("need")), "tied")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc(value), F.asc(item))))


def _bin_of_kth(bins: DataFrame, by: list[str], order: Column) -> DataFrame:
    """Each group's bin in which the last row it needs lies; ``need`` becomes the rows it takes from that bin."""
    upto = F.sum("rows").over(W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    met = bins.withColumn("upto", upto).where((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("rows") < F.col("need")))
    return met.withColumn("need", F.col("need") - F.col("upto") + F.col("rows")).drop("upto")


def audit(docs: DataFrame, text: str = "text", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value, rank: see the module."""
    spark = docs.sparkSession
    with Scratch(spark, "divergence") as scratch:
        counts = scratch.table(term_counts(docs, text), "counts")
        kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all_n")).where(F.col("docs") >= least_docs).select("lang", "term", "all_n")
        held = scratch.table(counts.select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "held")
        langs = held.groupBy("lang", "term").agg(F.first("all_n").alias("all_n")).groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("all_n").alias("lang_n"))
        named = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).groupBy("lang", "source").agg(F.lit(1).alias("_one")).drop("_one")
        groups = named.join(held.groupBy("lang", "source").agg(F.sum("n").alias("group_n")), ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["group_n", "kept", "lang_n"])
        least = F.when(F.col("kept") > 0, share(F.lit(0), F.col("group_n"), F.col("kept"))).otherwise(0)
        groups = scratch.table(groups.withColumn("p0", least), "groups")
        shares = held.join(groups, ["lang", "source"]).select("lang", "source", "term", share(F.col("n"), F.col("group_n"), F.col("kept")).alias("p"), share(F.col("all_n"), F.col("lang_n"), F.col("kept")).alias("q"), "p0")
        shares = scratch.table(shares, "shares")
        marked = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), differs(F.col("p"), F.col("q")).alias("value"))
        terms = select_top(marked, ["lang", "source"], "value", "item", top, scratch)
        out = _pairs(groups, shares).withColumn("part", F.lit("pair")).unionByName(terms.withColumn("part", F.lit("term")))
        return materialize(out.select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank")), "divergence-result")


def _pairs(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """lang, source, item (another source of the language), value and rank, for all pairs of sources: as many rows as the result has."""
    a, b = groups.alias("a"), groups.alias("b")
    met = a.join(b, (F.col("a.lang") == F.col("b.lang")) & (F.col("a.source") < F.col("b.source")))
    none = met.select("a.lang", F.col("a.source").alias("x"), F.col("b.source").alias("y"), F.when(F.col("a.kept") > 0, F.col("a.kept") * differs(F.col("a.p0"), F.col("b.p0"))).otherwise(0).alias("part"))
    # terms of one source, by their shares, as if the other source had none of them
    bins = shares.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("terms"), F.first("p0").alias("p0")).alias("a")
    other = bins.join(b, (F.col("a.lang") == F.col("b.lang")) & (F.col("a.source") != F.col("b.source")))
    one = other.select("a.lang", F.least("a.source", "b.source").alias("x"), F.greatest("a.source", "b.source").alias("y"), (F.col("a.terms") * (differs(F.col("a.p"), F.col("b.p0")) - differs(F.col("a.p0"), F.col("b.p0")))).alias("part"))
    # terms of both: what they differ by, in place of what either was taken for
    s, t = shares.alias("s"), shares.alias("t")
    both = s.join(t, (F.col("s.lang") == F.col("t.lang")) & (F.col("s.term") == F.col("t.term")) & (F.col("s.source") < F.col("t.source")))
    fix = differs(F.col("s.p"), F.col("t.p")) - differs(F.col("s.p"), F.col("t.p0")) - differs(F.col("s.p0"), F.col("t.p")) + differs(F.col("s.p0"), F.col("t.p0"))
    both = both.select("s.lang", F.col("s.source").alias("x"), F.col("t.source").alias("y"), fix.alias("part")).groupBy("lang", "x", "y").agg(F.sum("part").alias("part"))
    value = none.unionByName(one.groupBy("lang", "x", "y").agg(F.sum("part").alias("part"))).unionByName(both).groupBy("lang", "x", "y").agg(F.sum("part").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("x").alias("source"), F.col("y").alias("item")), F.struct(F.col("y").alias("source"), F.col("x").alias("item"))))
    each = value.select("lang", "value", ways.alias("w")).select("lang", "w.source", "w.item", "value")
    return each.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read_table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rn, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
tok AS (SELECT rn, lang, source, unnest(regexp_extract_all(translate(t, '{UPPER}', '{LOWER}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS all_n FROM tok GROUP BY 1, 2 HAVING count(DISTINCT rn) >= {LEAST_DOCS}),
lang_of AS (SELECT lang, count(*) AS v, sum(all_n) AS n FROM kept GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
own AS (SELECT lang, source, term, count(*) AS n FROM tok GROUP BY 1, 2, 3),
cells AS (SELECT g.lang, g.source, k.term, k.all_n, coalesce(o.n, 0) AS n FROM g JOIN kept k USING (lang) LEFT JOIN own o USING (lang, source, term)),
totals AS (SELECT lang, source, sum(n) AS n FROM cells GROUP BY 1, 2),
p AS (SELECT c.lang, c.source, c.term, c.n, 1 + ({WHOLE}::HUGEINT * (c.n + 2)) // (s.n + 2 * l.v)::HUGEINT AS p, 1 + ({WHOLE}::HUGEINT * (c.all_n + 2)) // (l.n + 2 * l.v)::HUGEINT AS q
      FROM cells c JOIN totals s USING (lang, source) JOIN lang_of l USING (lang)),
pair_sum AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (SELECT x.lang, x.source, y.source AS item, coalesce(s.value, 0) AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN pair_sum s ON s.lang = x.lang AND s.source = x.source AND s.item = y.source),
ranked AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs
           UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM ranked QUALIFY part = 'pair' OR rank <= {TOP}
"""
