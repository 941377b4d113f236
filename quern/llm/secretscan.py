"""Secret scans over a ledger of content-addressed blobs.

Every version of every path is a blob, addressed by the SHA-256 of its text. The
ledger (Parquet, appended to by each run) has a row per blob and rule version
that has been scanned, with the spans found, none included. A run scans only
pairs that the ledger lacks, each blob's text once, and joins the findings back
to every path that holds the blob. The rule version is a hash of the rules, so
changed rules scan all blobs anew and leave the old rows as they are. A pair that
two concurrent runs both appended counts once.

Rules are regular expressions run by Spark's own functions; a span's place comes
from running sums over the lengths of the matches and of the pieces between
them, a row each, so the work grows in proportion to a text's length.
Defined results: a null text counts as empty and has no span; equal rows are
scanned once and reported each; a null key is kept; an empty table scans
nothing and leaves the ledger as it is; columns ``blob`` and ``spans`` of the
input are replaced by the findings'.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions.text import let
from quern.llm.common import fresh_path, materialize, read_table

#: Fixed values: (kind, pattern, group whose length counts, least length), in the order that breaks ties of start.
RULES = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
#: A span, and the furthest end of the spans before it.
#: Code points of a block of a text that is masked.
BLOCK = 512
SPANS = "array<struct<start:int,kind_no:int,end:int,covered:int>>"
LEDGER = f"blob string, rules_version string, spans {SPANS}"


def version_of(rules=RULES) -> str:
    return hashlib.sha256(repr(tuple(map(tuple, rules))).encode()).hexdigest()[:16]


def _long_enough(rule: tuple) -> str:
    """The rule's pattern, narrowed to long matches where that leaves the matches' places as they are."""
    # a run of one character class is either long enough as a whole or not at all
    return {RULES[1]: r"AKIA[A-Z0-9]{16,}", RULES[2]: r"[0-9a-f]{24,}"}.get(tuple(rule), rule[1])


def _matches(text: Column, rule: tuple) -> Column:
    """(gap, size, counts) of every match of a rule: characters since the last one, its own, and whether it is long enough."""
    _, pattern, group, least = rule
    found, pieces = F.regexp_extract_all(text, F.lit(_long_enough(rule)), F.lit(0)), F.split(text, _long_enough(rule), -1)
    told = lambda m, p: F.when(m.isNotNull(), F.struct(F.length(p).alias("gap"), F.length(m).alias("size"), (F.length(F.regexp_extract(m, pattern, group)) >= least).alias("counts")))
    return F.filter(F.zip_with(found, pieces, told), lambda x: x.isNotNull())  # the piece after the last match has none


def scan(blobs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """(blob, spans) of ``blobs`` (blob, text; a blob's rows have one text): every secret's span, by start and then kind."""
    body = F.coalesce(F.col(text), F.lit(""))
    of_kind = lambda k, r: F.transform(_matches(body, r), lambda m, i: F.struct(F.lit(k).alias("kind_no"), i.alias("place"), m.alias("m")))
    # a blob without any match keeps a row of its own
    numbered = blobs.withColumn("row", F.monotonically_increasing_id())
    rows = numbered.select("blob", "row", F.explode_outer(F.concat(*(of_kind(k, r) for k, r in enumerate(rules)))).alias("x")).repartition("blob").select("blob", "row", "x.*")
    upto = W.partitionBy("blob", "row", "kind_no").orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    ended = rows.withColumn("end", F.sum(F.col("m.gap") + F.col("m.size")).over(upto).cast("int"))
    told = ended.select("blob", "row", "kind_no", (F.col("end") - F.col("m.size")).alias("start"), F.when(F.col("m.counts"), F.col("end")).alias("end"))
    before = W.partitionBy("blob", "row").orderBy("start", "kind_no").rowsBetween(W.unboundedPreceding, -1)
    told = told.withColumn("covered", F.coalesce(F.max("end").over(before), F.lit(0)))
    span = F.when(F.col("end").isNotNull(), F.struct("start", "kind_no", "end", "covered"))
    each = told.groupBy("blob", "row").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    return each.groupBy("blob").agg(F.first("spans").alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*(F.lit(r[0]) for r in RULES))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind_no"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _ledger(spark: SparkSession, path: str) -> DataFrame:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(path)


def update_ledger(versions: DataFrame, ledger: str, key: str, text: str = "text", rules=RULES) -> None:
    """Scan the blobs of ``versions`` that the ledger at path ``ledger`` lacks under these rules, and append them."""
    spark = versions.sparkSession
    told = versions.select(F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("blob"), F.xxhash64(F.col(key).cast("string")).alias("_row"), F.col(text).alias("_text"))
    known = _ledger(spark, ledger).where(F.col("rules_version") == version_of(rules)).select("blob").distinct()
    # hashes only, until it is known which blobs are unseen; then each one's text, of one row that stands for it
    unseen = told.groupBy("blob").agg(F.min("_row").alias("_row")).join(known, "blob", "left_anti")
    texts = told.join(unseen, ["blob", "_row"], "left_semi")
    scan(texts, "_text", rules).select("blob", F.lit(version_of(rules)).alias("rules_version"), "spans").write.mode("append").parquet(ledger)


def findings(versions: DataFrame, ledger: str, text: str = "text", rules=RULES) -> DataFrame:
    """``versions`` with blob and spans, from the ledger; other columns of these names are replaced.

    A blob that very many paths hold makes a large join partition, which Spark splits.
    """
    rows = _ledger(versions.sparkSession, ledger).where((F.col("rules_version") == version_of(rules)) & (F.size("spans") > 0))
    once = rows.groupBy("blob").agg(F.max("spans").alias("spans"))  # concurrent runs may have appended one pair twice
    told = versions.drop("blob", "spans").withColumn("blob", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    joined = told.join(once, "blob", "left")
    return joined.withColumn("spans", F.coalesce("spans", F.array().cast(SPANS)))


def digests(found: DataFrame) -> DataFrame:
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind_no"] == kind)).cast("long")
    counts = [count(k).alias(f"n_{r[0]}") for k, r in enumerate(RULES)]
    return found.select("doc_id", *counts, F.sha2(written(F.col("spans")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"), "blob")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, ledger = read_table(spark, sf_dir, "documents").select("doc_id", "text"), fresh_path(spark, "blob-ledger")
    update_ledger(docs, ledger, "doc_id")
    return digests(findings(docs, ledger).drop("text"))


def masked(text: Column, spans: Column) -> Column:
    """``text`` with every span replaced by its kind in brackets; overlapping spans become one, named for the first.

    The text is cut into blocks once and each piece is taken from its own blocks, so that
    the work grows with the text and not with the text times its spans.
    """
    kinds = F.array(*(F.lit(f"[{r[0]}]") for r in RULES))
    block = lambda place: F.floor(place / BLOCK).cast("int")

    def piece(blocks: Column, start: Column, end: Column) -> Column:
        own = F.array_join(F.slice(blocks, block(start) + 1, block(end) - block(start) + 1), "")
        return F.substring(own, start - block(start) * BLOCK + 1, end - start)

    def joined(blocks: Column) -> Column:
        parts = F.transform(F.filter(spans, lambda s: s["start"] >= s["covered"]), lambda s: F.concat(piece(blocks, s["covered"], s["start"]), F.get(kinds, s["kind_no"])))
        end = F.array_max(F.transform(spans, lambda s: s["end"]))
        return F.concat(F.array_join(parts, ""), piece(blocks, end, F.length(text)))

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    return F.when(F.size(spans) > 0, let(blocks, joined)).otherwise(text)


def ledger_increments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over one ledger, turns of conversations and then documents: per run, its versions, the blobs it scanned, and the spans of its versions."""
    ledger = fresh_path(spark, "blob-ledger")
    turns = read_table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("key"), "text")
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("key"), "text")
    out, before = [], 0
    for run, versions in enumerate((turns, docs.unionByName(turns))):
        update_ledger(versions, ledger, "key")
        scanned = _ledger(spark, ledger).count()
        told = findings(versions, ledger).agg(F.count(F.lit(1)).alias("versions"), F.sum(F.size("spans")).cast("long").alias("n_spans"))
        # written at once: in one plan Spark would take both readings of the ledger's folder for the same
        out.append(materialize(told.select(F.lit(run).alias("run"), "versions", F.lit(scanned - before).cast("long").alias("scanned"), "n_spans"), "ledger-run"))
        before = scanned
    return out[0].unionByName(out[1])


def _spans_sql(rows: str) -> str:
    """rn, kind_no, kind, s and hit of every base span, of ``rows`` (rn, t)."""
    quoted = [r[1].replace("'", "''") for r in RULES]
    per_kind = " UNION ALL ".join(
        f"""SELECT rn, {k} AS kind_no, '{RULES[k][0]}' AS kind, coalesce(list_aggregate(list_transform(p[1:i], lambda x: length(x)), 'sum'), 0) + coalesce(list_aggregate(list_transform(m[1:i-1], lambda x: length(x)), 'sum'), 0) AS s, m[i] AS hit
        FROM (SELECT rn, p, m, unnest(range(1, len(m) + 1)) AS i FROM (SELECT rn, regexp_split_to_array(t, '{quoted[k]}') AS p, regexp_extract_all(t, '{quoted[k]}') AS m FROM {rows}))
        WHERE length({"regexp_extract(m[i], '" + quoted[k] + "', 2)" if RULES[k][2] else "m[i]"}) >= {RULES[k][3]}"""
        for k in range(len(RULES))
    )
    return per_kind


def _oracle() -> str:
    return f"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS t FROM documents),
span AS ({_spans_sql('d')}),
g AS (SELECT rn, count(*) FILTER (kind_no = 0) AS n0, count(*) FILTER (kind_no = 1) AS n1, count(*) FILTER (kind_no = 2) AS n2,
      string_agg(kind || ':' || s::BIGINT || ':' || (s + length(hit))::BIGINT, ',' ORDER BY s, kind_no) AS listed FROM span GROUP BY rn)
SELECT doc_id, coalesce(n0, 0)::BIGINT AS n_assign, coalesce(n1, 0)::BIGINT AS n_access, coalesce(n2, 0)::BIGINT AS n_hex,
       sha256(coalesce(listed, '')) AS base_sha256, coalesce(listed, '') AS spans, sha256(t) AS blob
FROM d LEFT JOIN g USING (rn)
"""


ORACLE = _oracle()
INCREMENTS_ORACLE = f"""
WITH first AS (SELECT coalesce(text, '') AS t FROM conversations), second AS (SELECT coalesce(text, '') AS t FROM documents UNION ALL SELECT t FROM first),
d AS (SELECT row_number() OVER () AS rn, run, t FROM (SELECT 0 AS run, t FROM first UNION ALL SELECT 1, t FROM second)),
span AS ({_spans_sql('d')}), hits AS (SELECT run, count(*) AS n FROM span JOIN d USING (rn) GROUP BY 1)
SELECT run, count(*) AS versions, CASE WHEN run = 0 THEN (SELECT count(DISTINCT t) FROM first) ELSE (SELECT count(DISTINCT t) FROM second WHERE t NOT IN (SELECT t FROM first)) END AS scanned, coalesce(any_value(n), 0) AS n_spans
FROM d LEFT JOIN hits USING (run) GROUP BY run
"""
