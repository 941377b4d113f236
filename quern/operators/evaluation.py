"""Topic-model evaluation: diversity, coherence, and stability over seeds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern import schemas as S
from quern.functions import text as X


#: A model's topics and their words, which are broadcast: far more than any model gives.
MOST_TOPICS, MOST_WORDS = 10_000, 100_000


def top_words(topics: DataFrame, n: int = S.EVALUATION_TOP) -> DataFrame:
    """(topic, words): each topic's first words as normal terms."""
    return topics.select("topic", F.transform(F.filter(F.slice("words", 1, n), lambda w: ~X.is_blank(w)), X.normal_term).alias("words"))


def diversity(topics: DataFrame) -> DataFrame:
    """Distinct share of all topic words; NaN without words."""
    words = topics.select(F.explode("words").alias("word"))
    return words.agg(F.coalesce(F.try_divide(F.count_distinct("word"), F.count(F.lit(1))), F.lit(float("nan"))).alias("diversity"))


def similarity(a: DataFrame, b: DataFrame) -> DataFrame:
    """(left, right, jaccard) of every pair of topics: both sides are models' topic lists, whose size is checked."""
    if b.count() > MOST_TOPICS:
        raise ValueError(f"more than {MOST_TOPICS} topics")
    left = a.select(F.col("topic").alias("left"), F.col("words").alias("_a"))
    return left.crossJoin(F.broadcast(b.select(F.col("topic").alias("right"), F.col("words").alias("_b")))).select("left", "right", X.jaccard(F.col("_a"), F.col("_b")).alias("jaccard"))


def windows(documents: DataFrame, tokens: Column, size: int | None) -> DataFrame:
    """(window, words): distinct words of each sliding window of ``size`` tokens; without a size, of each document."""
    told = documents.select(F.monotonically_increasing_id().alias("_d"), tokens.alias("_t"))
    if size is None:
        return told.select(F.col("_d").alias("window"), F.array_distinct("_t").alias("words"))
    last = F.greatest(F.size("_t") - size, F.lit(0))
    cut = told.select("_d", "_t", F.explode(F.sequence(F.lit(0), last)).alias("_i"))
    return cut.select(F.struct("_d", "_i").alias("window"), F.array_distinct(F.slice("_t", F.col("_i") + 1, F.lit(size))).alias("words"))


def _counted(topics: DataFrame, documents: DataFrame, tokens: Column, size: int | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(n), (word, c) and (w1, w2, c12) over windows, for topic words only: they are few, so windows are cut down to them before any pair is made."""
    wanted = topics.select(F.explode("words").alias("word")).distinct()
    if wanted.count() > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} topic words")
    held = windows(documents, tokens, size)
    n = held.agg(F.count(F.lit(1)).alias("_n"))
    listed = F.broadcast(wanted.agg(F.collect_set("word").alias("_wanted")))
    kept = held.crossJoin(listed).select(F.array_sort(F.array_intersect("words", "_wanted")).alias("ws"))  # one row on the right
    single = kept.select(F.explode("ws").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("c"))
    pairs = F.flatten(F.transform("ws", lambda a: F.transform(F.filter("ws", lambda b: b > a), lambda b: F.struct(a.alias("w1"), b.alias("w2")))))
    met = kept.where(F.size("ws") > 1).select(F.explode(pairs).alias("p")).groupBy("p.w1", "p.w2").agg(F.count(F.lit(1)).alias("c12"))
    return n, single, met


def _npmi(both: DataFrame) -> Column:
    p12 = F.coalesce("c12", F.lit(0)) / F.col("_n") + F.lit(1e-12)
    return F.ln(p12 / (F.col("c1") / F.col("_n") * F.col("c2") / F.col("_n"))) / -F.ln(p12)


def coherence(topics: DataFrame, documents: DataFrame, tokens: Column, size: int | None = None) -> DataFrame:
    """(topic, c_npmi): mean normalised pointwise mutual information of a topic's word pairs over sliding windows of ``size`` tokens, or documents.

    Words that no window holds are left out.
    """
    n, single, met = _counted(topics, documents, tokens, size)
    pairs = topics.select("topic", F.explode("words").alias("w1"), "words").select("topic", "w1", F.explode("words").alias("w2")).where("w1 < w2").distinct()
    both = pairs.join(single.select(F.col("word").alias("w1"), F.col("c").alias("c1")), "w1").join(single.select(F.col("word").alias("w2"), F.col("c").alias("c2")), "w2").join(met, ["w1", "w2"], "left").crossJoin(n)
    return both.groupBy("topic").agg(F.avg(_npmi(both)).alias("c_npmi"))


def coherence_v(topics: DataFrame, documents: DataFrame, tokens: Column, size: int = 110) -> DataFrame:
    """(topic, c_v): the mean cosine between each word's vector of similarities to the topic's words and their sum (Roeder et al., 2015).

    Similarities are normalised pointwise mutual information over sliding windows, a word's with itself included.
    """
    n, single, met = _counted(topics, documents, tokens, size)
    held = single.select("word", "c")
    words = topics.select("topic", F.explode(F.array_distinct("words")).alias("word")).join(held, "word")
    left, right = words.select("topic", F.col("word").alias("a"), F.col("c").alias("c1")), words.select("topic", F.col("word").alias("b"), F.col("c").alias("c2"))
    grid = left.join(right, "topic").withColumns({"w1": F.least("a", "b"), "w2": F.greatest("a", "b")}).join(met, ["w1", "w2"], "left").crossJoin(n)
    grid = grid.withColumn("c12", F.when(F.col("a") == F.col("b"), F.col("c1")).otherwise(F.col("c12")))
    grid = grid.select("topic", "a", "b", _npmi(grid).alias("v"))
    total = grid.groupBy("topic", "b").agg(F.sum("v").alias("t"))
    near = grid.join(total, ["topic", "b"]).groupBy("topic", "a").agg((F.sum(F.col("v") * F.col("t")) / F.sqrt(F.sum(F.col("v") * F.col("v")) * F.sum(F.col("t") * F.col("t")))).alias("near"))
    return near.groupBy("topic").agg(F.avg("near").alias("c_v"))


def preconditions(topics: DataFrame, documents: int, k: int, expected: int) -> None:
    """Stop unless a model has ``k`` topics and was made of ``expected`` documents."""
    if (found := topics.count()) != k:
        raise ValueError(f"{found} topics where {k} are needed")
    if documents != expected:
        raise ValueError(f"{documents} documents where {expected} are needed")


def stored_problems(results: DataFrame, documents: DataFrame, k: int, algorithms: tuple[str, ...]) -> DataFrame:
    """(algorithm, problem) of stored results (``S.TOPIC_RESULT``): none stored, not ``k`` topics, or made of another number of documents.

    A result that doesn't tell its number of documents passes that test.
    """
    asked = results.sparkSession.createDataFrame([(a,) for a in algorithms], "algorithm string")
    told = results.select("algorithm", F.size(F.map_keys("topics")).alias("n"), F.col("metadata.document_count").alias("made_of"), F.lit(True).alias("stored"))
    met = asked.join(told, "algorithm", "left").crossJoin(documents.agg(F.count(F.lit(1)).alias("documents")))  # a row an algorithm
    problem = F.when(F.col("stored").isNull(), "missing").when(F.coalesce("n", F.lit(0)) != k, "topics").when(F.col("made_of") != F.col("documents"), "documents")
    return met.select("algorithm", problem.alias("problem")).where("problem is not null")


def seed_stability(documents: DataFrame, algorithm: str, k: int, seeds: tuple[int, ...] = S.EVALUATION_SEEDS, n_words: int = S.EVALUATION_TOP, seed: int = S.TOPIC_SEED) -> DataFrame:
    """(seed, topics, stability): a model's topics under other seeds, matched one to one with those under ``seed``."""
    from quern.operators import topics as T

    words = lambda s: [list(r.words) for r in top_words(T.extract_topics(documents, algorithm, k, n_words, s).topics, n_words).orderBy("topic").collect()]
    reference = words(seed)
    told = [(s, len(found := reference if s == seed else words(s)), stability(reference, found)) for s in seeds]
    return documents.sparkSession.createDataFrame(told, "seed int, topics int, stability double")


def compare(documents: DataFrame, k: int, algorithms: tuple[str, ...], seeds: tuple[int, ...]) -> DataFrame:
    """(algorithm, topics, diversity, c_v, c_npmi, stability_mean, stability_sd) of each algorithm at ``k`` topics."""
    from quern.operators import topics as T

    rows, tokens = [], X.topic_tokens(X.topic_text(F.col("text")))
    usable = T.prepared(documents).where(F.size(T.without(F.col("tokens"), list(T.STOPWORDS))) > 0).count()
    for algorithm in algorithms:
        made = T.extract_topics(documents, algorithm, k)
        found = top_words(made.topics).persist()
        if algorithm != "cluster":  # the documents that the model assigned, and those that it was given words of
            preconditions(found, made.documents.count(), k, usable)
        mean = lambda df, c: df.agg(F.avg(c)).first()[0]
        told = spread(seed_stability(documents, algorithm, k, seeds)).first()
        rows.append((algorithm, found.count(), diversity(found).first()[0], mean(coherence_v(found, documents, tokens), "c_v"), mean(coherence(found, documents, tokens, 10), "c_npmi"), told["mean"], told["sd"]))
        found.unpersist()
    return documents.sparkSession.createDataFrame(rows, "algorithm string, topics int, diversity double, c_v double, c_npmi double, stability_mean double, stability_sd double")


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Row and column pairs of least total cost, by shortest augmenting paths with potentials; for small matrices."""
    flip = cost.shape[0] > cost.shape[1]
    c = cost.T if flip else cost
    n, m = c.shape
    u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for row in range(1, n + 1):
        owner[0], at = row, 0
        least, came, done = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while owner[at]:
            done[at] = True
            own = owner[at]
            reach = c[own - 1] - u[own] - v[1:]
            better = ~done[1:] & (reach < least[1:])
            least[1:][better], came[1:][better] = reach[better], at
            open_ones = np.where(done, np.inf, least)
            open_ones[0] = np.inf
            to = int(np.argmin(open_ones))
            step = open_ones[to]
            u[owner[done]] += step
            v[done] -= step
            least[~done] -= step
            at = to
        while at:
            owner[at], at = owner[came[at]], came[at]
    found = [(int(owner[j]) - 1, j - 1) for j in range(1, m + 1) if owner[j]]
    return sorted((b, a) if flip else (a, b) for a, b in found)


def stability(reference: list[list[str]], candidate: list[list[str]]) -> float:
    """Best one-to-one matching of two topic lists by Jaccard; unmatched topics count as zero."""
    if not reference or not candidate:
        return 0.0
    score = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) if a and b else 0.0
    matrix = np.array([[score(a, b) for b in candidate] for a in reference])
    return float(sum(matrix[i, j] for i, j in assign(-matrix))) / max(len(reference), len(candidate))


def spread(values: DataFrame, value: str = "stability") -> DataFrame:
    return values.agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"))
