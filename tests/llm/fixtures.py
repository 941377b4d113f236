"""Small documents with every odd case: null and empty texts, copies, near copies, a long text, repeated and null ids, extra columns."""

from __future__ import annotations

import random

WORDS = "granja vaca llet camp pastura sensor dada xarxa robot mesura blat ordi aigua pluja vent sol tractor porta casa poble".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ",", ".\n"]) for _ in range(n)).replace(".\n ", ".\n")


def documents(seed: int = 1, n: int = 60) -> list[tuple]:
    """(doc_id, text, lang, source, n_chars, spans, score): the last two clash with operators' own names."""
    rng = random.Random(seed)
    base = [prose(rng, rng.choice([1, 3, 8, 40, 90, 200])) for _ in range(n // 2)]
    texts = list(base)
    while len(texts) < n:
        words = rng.choice(base).split(" ")
        for _ in range(rng.randint(0, max(1, len(words) // 30))):
            words[rng.randrange(len(words))] = "canvi"
        texts.append(" ".join(words))
    passage = prose(rng, 60)
    texts += [f"{prose(rng, 30)} {passage} {prose(rng, 30)}" for _ in range(6)]
    texts += [None, "", "  \n\t ", "é", "😀 ñ", "a" * 3000, prose(rng, 4000), "token = abcdef1234567", "TOKEN", base[0], base[0].upper()]
    rows = [(i, t, rng.choice(["ca", "es", None]), rng.choice(["s1", None]), len(t or ""), "x", 1.5) for i, t in enumerate(texts)]
    return rows + [rows[3], (rows[4][0], "un altre text amb el mateix id", "ca", "s1", 3, "y", 2.0), (None, "sense id", "ca", "s1", 8, "z", 0.0)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, score double"


def write(spark, folder, rows=None, **others) -> str:
    spark.createDataFrame(documents() if rows is None else rows, SCHEMA).repartition(3).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    for name, (data, schema) in others.items():
        spark.createDataFrame(data, schema).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


def bag(rows) -> list[str]:
    return sorted(map(repr, rows))
