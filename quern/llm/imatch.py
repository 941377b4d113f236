"""I-Match fingerprints with randomised lexicons.

The base lexicon holds the terms whose inverse document frequency, over all
documents, lies in a band. Each of the lexicons in ``KEEP`` is a random subset
of it, drawn on its own, so they overlap: half of them keep three quarters of the
terms, which tells exact and slightly edited copies; the others keep less, so
that texts which share less still agree somewhere. A text's fingerprint has for
each lexicon the 64-bit hash of the text's terms in it, distinct and sorted; an
entry without terms is missing. Two texts' likeness is the share of equal
entries among those that either of them has.

The band bounds the lexicon: a term in at least a share s of the documents is
among at most (distinct terms of a text, on average) / s terms, whatever the
number of documents. Its size is checked all the same; beyond
``BROADCAST_TERMS`` the terms are joined by a shuffle instead.

Defined results: a null text counts as empty; a text without lexicon terms has
the hash of the whole text in every entry, so equal texts always agree; null ids
sort below all others; rows that share an id are ordered by their text's hash;
ids may be of any integer type; other columns are left out; an empty table gives
no row. Everything runs in Spark's own functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm.common import materialize, read_table

#: The band: a term counts if it is in at least, and at most, such a share of the documents (idf 1.4 to 6.9), and in two.
LEAST_SHARE, MOST_SHARE, LEAST_DOCS = 0.001, 0.25, 2
#: What each randomised lexicon keeps of the band, in 256ths.
KEEP = (192, 192, 192, 192, 192, 192, 192, 192, 128, 128, 64, 64, 32, 32, 16, 16)
BROADCAST_TERMS = 500_000
#: Ranges that one expression tells apart; more of them are looked up in a table.
RANGES_INLINE = 1024
#: Rows that carry documents through the join with the lexicon are dealt to so many keys.
CARRIERS = 4096
NOT_A_TERM = r"[^\p{L}\p{N}]+"


def terms(text: Column) -> Column:
    """The distinct lower-cased terms of a text."""
    return F.array_remove(F.array_distinct(F.split(F.lower(text), NOT_A_TERM)), "")


def lexicon(docs: DataFrame, text: str = "text") -> DataFrame:
    """(term, code): the terms in the band; a code is 48 bits of the term's hash and a bit for each lexicon that keeps it."""
    n = docs.count()
    counted = docs.select(F.explode(terms(F.col(text))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    band = counted.where(F.col("n").between(max(LEAST_DOCS, math.ceil(LEAST_SHARE * n)), max(LEAST_DOCS, math.floor(MOST_SHARE * n))))
    code = F.shiftleft(F.xxhash64("term"), len(KEEP))
    for k, share in enumerate(KEEP):
        code = code.bitwiseOR(F.when(F.pmod(F.xxhash64("term", F.lit(k)), F.lit(256)) < share, F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")))
    return band.select("term", code.alias("code"))


def entries(codes: Column, fallback: Column) -> Column:
    """One hash for each lexicon, null where it has none of a text's sorted codes; all of them ``fallback`` where none has."""
    own = lambda k: F.filter(codes, lambda c: c.bitwiseAND(F.lit(1 << k).cast("long")) != 0)
    hashed = lambda kept: F.when(F.size(kept) > 0, F.xxhash64(kept))
    # one-element transforms work each filtered array out once
    found = F.concat(*(F.transform(F.array(own(k)), hashed) for k in range(len(KEEP))))
    return F.transform(F.array(found), lambda e: F.when(F.exists(e, lambda x: x.isNotNull()), e).otherwise(F.array_repeat(fallback, len(KEEP))))[0]


def written(entry: Column) -> Column:
    return F.array_join(F.transform(entry, lambda x: F.coalesce(F.lower(F.lpad(F.hex(x), 16, "0")), F.lit("-"))), " ")


def likeness(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: F.when(x.isNull() & y.isNull(), None).otherwise(F.coalesce((x == y).cast("int"), F.lit(0))))
    return F.aggregate(pairs, F.struct(F.lit(0).alias("n"), F.lit(0).alias("m")), lambda s, p: F.struct((s["n"] + F.coalesce(p, F.lit(0))).alias("n"), (s["m"] + p.isNotNull().cast("int")).alias("m")), lambda s: s["n"] / s["m"])


def _ends(docs: DataFrame, by: str, n: int) -> list[int]:
    """Ids that end at most ``n`` ranges of about equal size, the largest id included: all of them ids that occur."""
    shares = F.array(*(F.lit(k / n) for k in range(1, n)), F.lit(1.0))
    found, top = docs.agg(F.percentile_approx(by, shares, F.lit(100 * n)), F.max(by)).first()
    return sorted({*(found or ()), *(() if top is None else (top,))})


def _place(key: Column, ends: list[int], a: int, b: int) -> Column:
    if b - a <= 1:
        return F.lit(a)
    mid = (a + b) // 2
    return F.when(key <= ends[mid - 1], _place(key, ends, a, mid)).otherwise(_place(key, ends, mid, b))


def in_ranges(docs: DataFrame, by: str, wanted: int) -> tuple[DataFrame, int]:
    """``docs`` with ``part``, the number of its range of ``by``, and ``end``, the last id of that range; and the number of ranges.

    Up to ``RANGES_INLINE`` ranges are told by one expression. More of them are told in two steps: by such ranges, and
    within each by a table of finer ones (two ids a range, so its size is known), which is broadcast.
    """
    ends = _ends(docs.select(by), by, min(wanted, RANGES_INLINE)) or [0]
    coarse = docs.withColumn("part", _place(F.col(by), ends, 0, len(ends)))
    if wanted <= RANGES_INLINE:
        return coarse.withColumn("end", F.get(F.array(*map(F.lit, ends)), F.col("part"))), len(ends)
    each = math.ceil(wanted / len(ends))
    shares = F.array(*(F.lit(k / each) for k in range(1, each)), F.lit(1.0))
    told = coarse.groupBy("part").agg(F.percentile_approx(by, shares, F.lit(100 * each)).alias("e"), F.max(by).alias("top"))
    fine = told.select("part", F.explode(F.array_distinct(F.array_append("e", F.col("top")))).alias("end"))
    order = W.orderBy("part", "end")  # as many rows as ranges
    fine = materialize(fine.select("part", "end", (F.row_number().over(order) - 1).alias("fine"), F.lag("end").over(W.partitionBy("part").orderBy("end")).alias("after")), "imatch-ranges")
    spots = F.broadcast(fine.withColumnRenamed("part", "_part"))
    inside = (F.col("part") == F.col("_part")) & (F.col(by) <= F.col("end")) & (F.col("after").isNull() | (F.col(by) > F.col("after")))
    return coarse.join(spots, inside).drop("part", "_part", "after").withColumnRenamed("fine", "part"), fine.count()


def with_next(docs: DataFrame, key: str, text: str) -> DataFrame:
    """part, place, guest, key, own, next: every row's text and that of the row after it in descending ``key``, the first after the last.

    One shuffle: rows go to ranges of keys; the row that ends a range also goes, as a guest, to the range above,
    whose last row it follows. There are several ranges for each task, so that tasks are alike in size.
    """
    low = F.coalesce(F.col(key).cast("long"), F.lit(-(2**63)))
    told = docs.select(F.col(key).alias("key"), low.alias("o"), F.coalesce(F.col(text), F.lit("")).alias("own"))
    wanted = 4 * max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    dealt, n = in_ranges(told, "o", wanted)
    home, above = F.struct("part", F.lit(0).alias("guest")), F.struct(((F.col("part") + 1) % n).alias("part"), F.lit(1).alias("guest"))
    dealt = dealt.withColumn("spot", F.explode(F.when(F.col("o") == F.col("end"), F.array(home, above)).otherwise(F.array(home)))).select("spot.part", "spot.guest", "key", "o", "own")
    order = W.partitionBy("part").orderBy("guest", F.desc("o"), F.xxhash64("own"), "own")
    return dealt.select("part", "guest", "key", "own", F.row_number().over(order).alias("place"), F.lead("own").over(order).alias("next"))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The edited text has its last half replaced by the beginning of the next row's text.
    """
    spark = docs.sparkSession
    lexical = materialize(lexicon(docs, text), "imatch-lexicon")
    small = lexical.count() <= BROADCAST_TERMS
    # no term has a space: these rows carry each document's own values past the join, dealt to many keys
    carrier = F.concat(F.lit(" "), F.pmod(F.xxhash64("part", "place"), F.lit(CARRIERS)).cast("string"))
    lexical = lexical.unionByName(spark.range(CARRIERS).select(F.concat(F.lit(" "), F.col("id").cast("string")).alias("term"), F.lit(-1).cast("long").alias("code")))
    if small:
        lexical = F.broadcast(lexical)
    rows = with_next(docs, key, text)
    half = F.floor(F.length("own") / 2).cast("int")
    edited = F.when(F.col("guest") == 0, F.concat(F.substring("own", F.lit(1), F.length("own") - half), F.substring("next", F.lit(1), half)))
    rows = rows.withColumns({"edited": edited})
    told = F.struct("key", "guest", F.length("own").cast("long").alias("n_chars"), F.xxhash64("own").alias("own_hash"), F.xxhash64("edited").alias("edited_hash"), F.sha2("edited", 256).alias("edited_sha256"))
    version = lambda v, t, x: F.struct(F.lit(v).alias("v"), t.alias("terms"), x.alias("told"))
    nothing = F.lit(None).cast(f"struct<key:{docs.schema[key].dataType.simpleString()},guest:int,n_chars:bigint,own_hash:bigint,edited_hash:bigint,edited_sha256:string>")
    split = rows.select("part", "place", F.explode(F.array(version(0, terms(F.col("own")), nothing), version(1, terms(F.col("edited")), nothing), version(2, F.array(carrier), told))).alias("x"))
    spread = split.select("part", "place", F.col("x.v").alias("v"), F.col("x.told").alias("told"), F.explode("x.terms").alias("term"))
    coded = spread.join(lexical, "term").select("part", "place", "v", "told", "code")
    gathered = coded.groupBy("part", "place").agg(
        F.sort_array(F.collect_list(F.when(F.col("v") == 0, F.col("code")))).alias("own"),
        F.sort_array(F.collect_list(F.when(F.col("v") == 1, F.col("code")))).alias("edited"),
        F.max("told").alias("told"),
    )
    printed = gathered.select("part", "place", "told", entries(F.col("own"), F.col("told.own_hash")).alias("own"), entries(F.col("edited"), F.col("told.edited_hash")).alias("edited"))
    follows = printed.withColumn("next", F.lead("own").over(W.partitionBy("part").orderBy("place"))).where("told.guest = 0")
    return follows.select(
        F.col("told.key").alias(key), "told.n_chars", "told.edited_sha256", written(F.col("own")).alias("fingerprint"), written(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"),
    )


def op2_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
