"""Operators 11, 12 and 13: against their SQL, brute force, and the library."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from quern.llm import bisection, divergence, rankedsearch, wordbpe
from quern.llm.common import Scratch
from tests.llm import fixtures

ITEMS = [(1, "granja vaca LLET camp pastura vaca"), (2, "sensor dada xarxa robot"), (2, "sensor dada xarxa robot"), (3, None), (4, ""), (None, "aigua pluja"), (5, "zzz unseen"), (6, "un altre text amb el mateix id")]


def rows_of(found, columns):
    return sorted(repr(tuple(r[c] for c in columns)) for r in found.collect())


def sql_rows(folder, sql, columns):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet/*.parquet'")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    return sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in found.fetchall())


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(5)
    vocabulary = [a + b for a in ("ca", "lo", "mi", "pre", "é", "😀") for b in ("sa", "t", "nu", "ri", "zz", "ñ", "mer")]
    rows = fixtures.documents()
    for k in range(900):
        mood = vocabulary[(k % 3) * 10 : (k % 3) * 10 + 24]
        rows.append((1000 + k, " ".join(rng.choice(mood) for _ in range(rng.randint(1, 40))), ["ca", "es", None, "en"][k % 4], f"s{k % 5}", 0, "", 0.0))
    rows += [(7000 + k, rows[-1][1], "es", "s1", 0, "", 0.0) for k in range(300)]  # a large group of copies
    items = ITEMS + [(10 + k, " ".join(rng.choice(vocabulary) for _ in range(12))) for k in range(12)]
    return fixtures.write(spark, tmp_path_factory.mktemp("ranking"), rows, benchmark=(items, "item_id long, text string"))


def test_divergence_and_search_match_their_sql(spark, tables):
    for query, sql in ((divergence.op11_source_divergence, divergence.ORACLE), (rankedsearch.op12_ranked_search, rankedsearch.ORACLE)):
        found = query(spark, tables)
        assert found.count() > 50
        assert rows_of(found, found.columns) == sql_rows(tables, sql, found.columns)


def test_divergence_of_few_documents(spark):
    schema = "doc_id long, text string, lang string, source string, n long"
    assert divergence.audit(spark.createDataFrame([], schema)).count() == 0
    found = divergence.audit(spark.createDataFrame([(1, None, None, "a", 1), (2, "", None, None, 1), (3, "x y", "l", "a", 1)], schema))
    assert rows_of(found, ["lang", "source", "part", "item", "value", "rank"]) == [repr(("", "", "pair", "a", 0, 1)), repr(("", "a", "pair", "", 0, 1))]


@pytest.mark.parametrize("k", [1, 3, 10])
def test_radix_selection(spark, k):
    rng = random.Random(k)
    letters = ["a", "b", "é", "中", "😀"]
    rows = {("g1", "a" * n + "b"): 7 for n in range(6)} | {("g1", "x" * 3000 + c): 7 for c in "abcd"}
    rows |= {("g2", "".join(rng.choice(letters) for _ in range(rng.randint(0, 6)))): rng.choice([0, 5, 2**40, 2**62]) for _ in range(400)}
    rows |= {("g3", "only"): 0, (None, "n"): 3}
    want = defaultdict(list)
    for (g, item), value in rows.items():
        if g:
            want[g].append((-value, item.encode()))
    with Scratch(spark, "radix") as scratch:
        table = spark.createDataFrame([(g, i, v) for (g, i), v in rows.items()], "g string, item string, value long")
        got = divergence.select_top(table.where("g is not null"), ["g"], "value", "item", k, scratch).collect()
    assert sorted((r.g, r.rank, r.item.encode(), r.value) for r in got) == sorted((g, n + 1, i, -v) for g, own in want.items() for n, (v, i) in enumerate(sorted(own)[:k]))


def brute_search(docs, items, k):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    bags = [(d, Counter(cut(t))) for d, t in docs]
    bags = [(d, b, b.total()) for d, b in bags if b]
    n, total = len(bags), sum(s for _, _, s in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for d, b, size in bags:
            m = 75 + 25 * size * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * b[t] // (1000 * b[t] + 12 * m)) for t in cut(text) if b[t])
            if s > 0:
                scored.append((-s, d is not None, d or 0, d))
        out += [(item, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return out


@pytest.mark.parametrize("options", [{}, {"cluster": 4, "part": 16, "sample": 20}])
def test_search_matches_scoring_all(spark, tables, options):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    got = rankedsearch.search(docs, spark.createDataFrame(ITEMS, "item_id long, text string"), k=7, **options).collect()
    want = brute_search([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], ITEMS, 7)
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))  # nothing lost: recall is 1


def test_search_of_empty_tables(spark):
    docs, items = "doc_id long, text string", "item_id long, text string"
    full = [(1, "a b c")]
    for d, i in (([], full), (full, []), ([(1, None)], full), (full, [(1, "..")])):
        assert rankedsearch.search(spark.createDataFrame(d, docs), spark.createDataFrame(i, items)).count() == 0


def test_blocks_of_items(spark, tables, monkeypatch):
    docs, items = spark.read.parquet(f"{tables}/documents.parquet").limit(200), spark.createDataFrame(ITEMS, "item_id long, text string").coalesce(1)
    whole = rows_of(rankedsearch.search(docs, items), ["item_id", "rank", "doc_id", "score"])
    monkeypatch.setattr(rankedsearch, "BLOCK_ITEMS", 3)
    assert rows_of(rankedsearch.search(docs, items), ["item_id", "rank", "doc_id", "score"]) == whole


def test_bisection_keeps_topics_together():
    rng = np.random.default_rng(2)
    topic = rng.permutation(np.repeat(np.arange(4), 64))
    held = [np.unique(rng.integers(0, 40, 12) + 50 * t) for t in topic]
    starts = np.concatenate([[0], np.cumsum([len(h) for h in held])])
    leaves = bisection.ordered(starts, np.concatenate(held), 64)
    assert sorted(np.concatenate(leaves).tolist()) == list(range(256))
    assert all(np.bincount(topic[leaf]).max() >= 0.9 * len(leaf) for leaf in leaves)
    tree = bisection.Tree.fit(starts, np.concatenate(held), 200, 2)
    found = tree.leaf_of(starts, np.concatenate(held))
    assert all(np.bincount(found[topic == t]).max() >= 0.9 * 64 for t in range(4))


def odd_texts():
    rng = random.Random(3)
    letters = "abcdethingTHEé中😀0189.,▁' \n\t\x85\xa0ſİŉÅéªº²½<>|/w “—𐐀ΣΑΣ "
    syllables = ["an", "the", "ing", "a", "b", "aa", "ab", "er", "é", "中", "tion", "s", "0", "=", "xx"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 400))) for _ in range(400)]
    texts += ["".join(rng.choice(syllables) for _ in range(rng.randint(5, 900))) for _ in range(60)]
    texts += ["".join(rng.choice("aeinorst") for _ in range(5000)), base64.b64encode(rng.randbytes(30_000)).decode(), "a" * 20_001, "<|endoftext|>x<|startoftext|><|endoftext|>", "</w></w> </w", "", " ", "\0"]
    return texts


def test_words_match_the_library():
    own = wordbpe.codec(wordbpe.default_tokenizer())
    for text in odd_texts():
        ids = own.library.encode(text, add_special_tokens=False).ids
        assert own.encode(text).tolist() == ids and own.decode(own.encode(text)) == own.library.decode(ids, skip_special_tokens=False)


def test_pairs_fit_as_merging_tells():
    own, rng = wordbpe.codec(wordbpe.default_tokenizer()), random.Random(4)
    inner = [i for i in range(own.n - 2) if own.library.id_to_token(i) and not own.library.id_to_token(i).endswith("</w>")]

    def merged(parts):
        while True:
            ranked = [(own.rank[own.merged[a * own.n + b]], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a * own.n + b in own.merged]
            if not ranked:
                return parts
            k = min(ranked)[1]
            parts = [*parts[:k], own.merged[parts[k] * own.n + parts[k + 1]], *parts[k + 2 :]]

    def symbols(i):
        return [i] if own.rank[i] < 0 else symbols(own.left[i]) + symbols(own.right[i])

    for _ in range(3000):
        a, b = rng.choice(inner[:4000]), rng.choice(inner[:4000])
        assert own.fits(a, b) == (merged(symbols(a) + symbols(b)) == [a, b])


def test_unfit_tokenizers_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError):
        wordbpe.Codec(public_tokenizers.path("byte_bpe_50k.json"))


def test_word_bpe_digests_and_round_trip(spark, tmp_path):
    folder = fixtures.write(spark, tmp_path)
    own = wordbpe.codec(wordbpe.default_tokenizer()).library
    want = []
    for r in fixtures.documents():
        ids = own.encode(r[1] or "", add_special_tokens=False).ids
        sha = hashlib.sha256(own.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        want.append((r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha))
    assert fixtures.bag(map(tuple, wordbpe.op13_word_bpe(spark, folder).collect())) == fixtures.bag(want)
    docs = spark.createDataFrame([(1, "It's SO good", [9]), (2, None, None)], "id long, text string, ids array<int>")
    back = wordbpe.decode(wordbpe.encode(docs)).collect()
    assert [(r.id, r.text, r.decoded) for r in back] == [(1, "It's SO good", "it</w> 's</w> so</w> good</w>"), (2, None, "")]
    assert wordbpe.digests(docs.where("false"), key="id").count() == 0
