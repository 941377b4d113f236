"""Operators 1, 2, 3, 5 and 10 against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import struct
from collections import Counter

import duckdb
import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from quern.llm import decontaminate, graph, imatch, ngramjoin, secretscan, shingles, urlblocks
from quern.llm.common import materialize
from tests.llm import fixtures


def components(nodes, links):
    parent = {x: x for x in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {x: root(x) for x in nodes}


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(500 + i, 501 + i) for i in range(40)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "src int, dst int")).collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    assert got == components({x for p in real for x in p}, real)
    assert graph.components(spark.createDataFrame([], "src int, dst int")).count() == 0


PAGES = [
    (1, "https://a.org/x#f", '<link rel="canonical" href="https://q.example.com/en/1">'), (2, "https://b.org/y", '<meta http-equiv="refresh" content="0; url=/z">'),
    (3, "https://b.org/z", '<LINK href="https://c.net/es/1" REL="canonical">'), (5, "https://e.org/", '<link rel="canonical" href="https://www.example.com/en/2">'),
    (6, "https://f.org/", '<link rel="canonical" href="https://e.org/">'), (7, "https://f.org/", '<link rel="canonical" href="https://m.example.com/en/2">'),
    (8, None, None), (9, "nourl", '<link rel="canonical" href="https://a.org/x">'), (10, "http://EXAMPLE.com/en/x?y", ""), (11, "http://x.www.example.com/en/", None),
    (12, "://", ""), (13, "http:///en/", ""), (14, "http://notexample.com/en/", ""), (14, "http://notexample.com/en/", ""), (None, "http://a.net/es/", ""), (15, "http://a.net/es", ""),
]


def test_urls(spark, tmp_path):
    fixtures.write(spark, tmp_path, rows=[], pages=(PAGES, "page_id long, url string, html string"))
    rows = urlblocks.op1_url_redirects(spark, str(tmp_path)).collect()
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows if r.page_id}
    assert len(rows) == len(PAGES)
    assert got[1][2:] == (None, "block") and got[2][2:] == (None, "block") and got[3][2:] == (None, "block")
    assert got[5][3] == got[6][3] == got[7][3] == "allow"  # an explicit allow outweighs the block of an alias
    assert got[8] == ("", "", None, "allow") and got[9] == ("", "", None, "allow") and got[12] == ("", "", None, "allow")
    assert got[10] == ("example.com", "/en/x", "example.com/en/", "block") and got[11][2:] == ("www.example.com/en/", "allow")
    assert got[13] == ("", "/en/", None, "allow") and got[14][2] == "com/" and got[15][2] is None
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    names = ["page_id", "host", "path", "rule", "verdict", "alias_of"]
    assert fixtures.bag(tuple(r[n] for n in names) for r in rows) == fixtures.bag(con.sql(urlblocks.ORACLE).project(", ".join(names)).fetchall())


def test_edges_of_ordinary_html(spark):
    cases = [
        ("https://a.org/d/e/p?q", """<meta http-equiv="refresh" content="0;url='https://b.org/1'">""", ["https://b.org/1"]),
        ("https://a.org/d/e/p", """<META content='5; URL="https://b.org/2"' HTTP-EQUIV=Refresh>""", ["https://b.org/2"]),
        ("https://a.org/d/e/p", "<link rel=canonical href=https://b.org/3>", ["https://b.org/3"]),
        ("https://a.org/d/e/p", """<link rel="canonical"><link href="https://b.org/it's" rel="x canonical">""", ["https://b.org/it's"]),
        ("https://a.org/d/e/p", """<link rel="canonical" href="/1"><link rel='canonical' href='/2?x=1&amp;y=2'>""", ["https://a.org/1", "https://a.org/2?x=1&y=2"]),
        ("https://a.org/d/e/p", '<link data-href="/no" title="a > b" rel="canonical" href="HTTPS://B.Org/X">', ["https://b.org/X"]),
        ("HTTP://A.org/d/e/p", '<link rel="canonical" href="f.html#z"><link rel="canonical" href="../g?h"><link rel="canonical" href="./">', ["http://a.org/d/e/f.html", "http://a.org/d/g?h", "http://a.org/d/e/"]),
        ("https://a.org", '<link rel="canonical" href="f"><link rel="canonical" href="?s">', ["https://a.org/f", "https://a.org?s"]),
        ("https://a.org/d/e/p", '<link rel="canonical" href="//C.org/y"><link rel="canonical" href="mailto:x@y"><link rel="canonical" href="#t">', ["https://c.org/y"]),
        ("https://a.org/d/e/p", '<link rel="stylesheet canonicals" href="/no"><meta name="refresh" content="0;url=/no"><linker rel="canonical" href="/no">', []),
    ]
    for url, html, want in cases:
        got = urlblocks.alias_edges(spark.createDataFrame([(url, html)], "url string, html string")).collect()
        assert sorted(r.dst for r in got) == sorted(want), html
    pages = [(1, "https://EXAMPLE.com/en/1", ""), (2, "https://q.net/a", "<link rel=canonical href=https://example.com/en/1>")]
    told = urlblocks.verdicts(spark.createDataFrame(pages, "page_id long, url string, html string"), (("example.com/en/", "block"),)).collect()
    assert [r.verdict for r in told] == ["block", "block"] and len({r.alias_of for r in told}) == 1


def test_many_rules_agree_with_few(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    more = [*urlblocks.RULES, *((f"h{i}.org/", "block") for i in range(urlblocks.INLINE_RULES))]
    told = lambda df: fixtures.bag(map(tuple, df.select("page_id", "rule", "verdict").collect()))
    assert told(urlblocks.verdicts(pages, more)) == told(urlblocks.verdicts(pages))
    assert urlblocks.verdicts(pages.limit(0)).count() == 0


def imatch_print(text, band):
    """A fingerprint by brute force: Spark's xxhash64 chains 64-bit hashes, seeded with 42."""
    h = lambda x, seed: xxhash.xxh64(x, seed=seed).intdigest()
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    found = [[] for _ in imatch.KEEP]
    for term in {t for t in regex.split(imatch.NOT_A_TERM, (text or "").lower()) if t in band}:
        own = h(term.encode(), 42)
        mask = sum(1 << k for k, share in enumerate(imatch.KEEP) if signed(h(struct.pack("<i", k), own)) % 256 < share)
        for k in range(len(imatch.KEEP)):
            if mask >> k & 1:
                found[k].append(signed((own << 16 | mask) & (2**64 - 1)))
    out = []
    for codes in found:
        seed = 42
        for c in sorted(codes):
            seed = h(struct.pack("<q", c), seed)
        out.append(f"{seed:016x}" if codes else "-")
    return out if set(out) != {"-"} else [f"{h((text or '').encode(), 42):016x}"] * len(out)


def imatch_likeness(a, b):
    told = [(x, y) for x, y in zip(a, b) if (x, y) != ("-", "-")]
    return sum(x == y for x, y in told) / len(told)


def imatch_rows(rows):
    """Every column by brute force, of rows with distinct ids."""
    n, texts = len(rows), [r[1] or "" for r in rows]
    df = Counter(t for text in texts for t in set(regex.split(imatch.NOT_A_TERM, text.lower())) if t)
    least, most = max(2, math.ceil(imatch.LEAST_SHARE * n)), max(2, math.floor(imatch.MOST_SHARE * n))
    band = {t for t, c in df.items() if least <= c <= most}
    order = sorted(rows, key=lambda r: -r[0])
    for k, r in enumerate(order):
        text, after = r[1] or "", order[(k + 1) % n][1] or ""
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        own, other, following = (imatch_print(t, band) for t in (text, edited, after))
        yield (r[0], len(text), hashlib.sha256(edited.encode()).hexdigest(), " ".join(own), " ".join(other), imatch_likeness(own, other), imatch_likeness(own, following))


@pytest.mark.parametrize("inline", [1024, 3])
def test_imatch(spark, tmp_path, monkeypatch, inline):
    monkeypatch.setattr(imatch, "RANGES_INLINE", inline)
    rows = list({r[0]: r for r in fixtures.documents() if r[0] is not None}.values())
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    got = imatch.op2_imatch(spark, fixtures.write(spark, tmp_path, rows))
    assert got.columns == names and fixtures.bag(map(tuple, got.collect())) == fixtures.bag(imatch_rows(rows))


def test_imatch_tells_edits_from_others(spark):
    rng = random.Random(6)
    vocabulary = [f"w{k}" for k in range(3000)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(120)) for _ in range(200)]
    docs = spark.createDataFrame([(2 * i + j, t + (" extra" if j else "")) for i, t in enumerate(texts) for j in (0, 1)], "doc_id long, text string")
    told = imatch.fingerprints(docs).selectExpr("avg(near_next) filter (where doc_id % 2 = 1) same", "avg(near_next) filter (where doc_id % 2 = 0) other", "avg(near_edited) half").first()
    assert told.same > 0.4 and told.other < 0.02 and told.half > told.other


def test_ties_and_clashing_columns(spark, monkeypatch):
    rules, rows = [("a.com/", "block"), ("com/bb", "block")], [(1, "http://a.com/bb/x", "o", "n", "r", 7), (2, None, "o", "n", "r", 8)]
    pages = spark.createDataFrame(rows, "page_id long, url string, own string, node string, rule string, component int").withColumn("html", F.lit("<link rel=canonical href=http://b.com/c>"))
    first = urlblocks.verdicts(pages, rules)
    assert first.columns == ["page_id", "url", "own", "node", "component", "html", "host", "path", "rule", "verdict", "alias_of"]
    told = fixtures.bag(map(tuple, first.collect()))
    monkeypatch.setattr(urlblocks, "INLINE_RULES", 0)
    assert fixtures.bag(map(tuple, urlblocks.verdicts(pages, rules).collect())) == told
    assert [(r.own, r.node, r.rule, r.verdict) for r in first.where("page_id = 1").collect()] == [("o", "n", "a.com/", "block")]


def test_redirect_chains(spark, tmp_path):
    rng = random.Random(2)
    urls = [f"http://{rng.choice(['a', 'B', 'www'])}.{rng.choice(['Example.com', 'x.net', 'y.org'])}/{rng.choice(['en', 'es', 'fr'])}/{i}" for i in range(80)] + [None, "nourl", "http://a.x.net/es/1#f"]
    fixtures.write(spark, tmp_path, rows=[], pages=([(i, u, "") for i, u in enumerate(urls)], "page_id long, url string, html string"))
    got = urlblocks.redirect_components(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    names = ["page_id", "rule", "verdict", "alias_of"]
    rows = got.collect()
    assert fixtures.bag(tuple(r[n] for n in names) for r in rows) == fixtures.bag(con.sql(urlblocks.CHAINS_ORACLE).project(", ".join(names)).fetchall())
    assert sum(r.rule is None and r.verdict == "block" for r in rows) > 3 and sum(r.alias_of is not None for r in rows) > 70


def test_imatch_with_a_shuffled_lexicon(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t) for i, t, *_ in fixtures.documents() if i is not None], "doc_id long, text string")
    told = lambda: fixtures.bag(map(tuple, imatch.fingerprints(docs).collect()))
    first = told()
    monkeypatch.setattr(imatch, "BROADCAST_TERMS", 1)
    assert told() == first


def test_imatch_odd_tables(spark):
    schema = "doc_id long, text string"
    assert imatch.fingerprints(spark.createDataFrame([], schema)).count() == 0
    one = imatch.fingerprints(spark.createDataFrame([(5, "abcd")], schema)).first()
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one.near_next == 1
    many = imatch.fingerprints(spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (None, None)], schema))
    assert many.count() == 4


def spans(text):
    out = []
    for k, (kind, pattern, group, least) in enumerate(secretscan.RULES):
        out += [(m.start(), k, m.end()) for m in re.finditer(pattern, text or "", re.ASCII) if len(m[group]) >= least]
    return ",".join(f"{secretscan.RULES[k][0]}:{a}:{b}" for a, k, b in sorted(out))


def secrets_texts(n=300):
    rng = random.Random(3)
    parts = ["password", "Token", "api_key", "apikey", "SECRET", "=", ":", " ", "  ", '"', "'", "é", "😀", "AKIA", "ABCDEF123456789012345", "abc", "deadbeef" * 3, "x", "\n", "abcdef", "==", "/", "AKIAAKIA"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_secrets(spark, tmp_path):
    rows = [(i, t, None, None, 0, "x", 0.0) for i, t in enumerate(secrets_texts())] + fixtures.documents()
    folder = fixtures.write(spark, tmp_path, rows)
    got = secretscan.op3_secret_scan(spark, folder).collect()
    assert fixtures.bag((r.doc_id, r.spans, r.base_sha256) for r in got) == fixtures.bag((r[0], s := spans(r[1]), hashlib.sha256(s.encode()).hexdigest()) for r in rows)


def test_ledger_scans_only_what_is_new(spark, tmp_path):
    path = str(tmp_path / "ledger")
    docs = spark.createDataFrame([(1, "token=abcdefgh"), (2, "token=abcdefgh"), (3, None)], "doc_id long, text string")
    secretscan.update_ledger(docs, path, "doc_id")
    assert spark.read.parquet(path).count() == 2
    secretscan.update_ledger(docs.unionByName(spark.createDataFrame([(4, "x")], docs.schema)), path, "doc_id")
    assert spark.read.parquet(path).count() == 3
    other = (("assign", "token=[a-z]+", 0, 3),)
    secretscan.update_ledger(docs, path, "doc_id", rules=other)
    assert spark.read.parquet(path).count() == 5 and secretscan.version_of(other) != secretscan.version_of()
    told = lambda **k: [len(r.spans) for r in secretscan.findings(docs, path, **k).orderBy("doc_id").collect()]
    assert told() == told(rules=other) == [1, 1, 0]
    secretscan.update_ledger(docs.limit(0), path, "doc_id", rules=other[:0] + (("hex", "x", 0, 1),))
    spark.read.parquet(path).coalesce(1).write.mode("append").parquet(path)  # as two concurrent runs would leave it
    assert told() == [1, 1, 0]


def test_increments(spark, tmp_path):
    turns = [(1, 0, "user", "token=abcdefgh"), (1, 1, "user", None), (1, 2, "user", ""), (2, 0, "user", "hola")]
    rows = [(1, "token=abcdefgh"), (2, "hola"), (3, "AKIA" + "A" * 20), (4, "AKIA" + "A" * 20)]
    folder = fixtures.write(spark, tmp_path, [(i, t, None, None, 0, "x", 0.0) for i, t in rows], conversations=(turns, "conv_id long, turn long, role string, text string"))
    got = sorted(map(tuple, secretscan.ledger_increments(spark, folder).collect()))
    assert got == [(0, 4, 3, 1), (1, 8, 1, 4)]
    con = duckdb.connect()
    for name in ("documents", "conversations"):
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet/*.parquet'")
    assert sorted(con.sql(secretscan.INCREMENTS_ORACLE).fetchall()) == got


def test_very_many_secrets_in_one_text(spark):
    import time

    def seconds(n):
        df = spark.createDataFrame([("b", "é token=abcdefgh1 " * n)], "blob string, text string")
        began = time.time()
        row = secretscan.scan(df).first()
        assert len(row.spans) == n and row.spans[-1].end == 18 * n - 1
        return time.time() - began

    seconds(10)
    assert seconds(40_000) < 20 + 30 * seconds(4000)


def test_masking_of_very_many_secrets(spark):
    import time

    def seconds(n):
        df = spark.createDataFrame([("b", "\U0001f600 token=abcdefgh1 " * n)], "blob string, text string")
        told = materialize(secretscan.scan(df).crossJoin(df.select("text")), "masking")  # one row by one
        began = time.time()
        got = told.select(secretscan.masked(F.col("text"), F.col("spans"))).first()[0]
        assert got == "\U0001f600 [assign] " * n
        return time.time() - began

    seconds(10)
    assert seconds(32_000) < 3 + 30 * seconds(1000)


@pytest.mark.parametrize("before", [0, 1, 492, 497, 498, 511, 512, 513, 1024, 2000])
def test_masking_across_blocks(spark, before):
    text = "\U0001f600\n" * (before // 2) + "é" * (before % 2) + " token=abcdefgh1" + "x" * 20 + " " + "ü" * before + " secret: zzzzzzzz"
    df = spark.createDataFrame([("b", text)], "blob string, text string")
    got = secretscan.scan(df).select(secretscan.masked(F.lit(text), F.col("spans"))).first()[0]
    assert got == "\U0001f600\n" * (before // 2) + "é" * (before % 2) + " [assign] " + "ü" * before + " [assign]"


def test_masking(spark):
    texts = ["😀 token=abcdefgh end", "none", "token=" + "ab12" * 8 + " token: AKIA" + "A" * 30 + " deadbeefdeadbeefdeadbeef", None]
    df = spark.createDataFrame(list(enumerate(texts)), "blob int, text string")
    told = secretscan.scan(df).join(df, "blob").orderBy("blob")
    got = [r[0] for r in told.select(secretscan.masked(F.col("text"), F.col("spans"))).collect()]
    assert got == ["😀 [assign] end", "none", "[assign] [assign] [hex]", None]


def edits(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [row[0] + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_edit_match():
    rng = random.Random(0)
    for _ in range(300):
        a, b = ([rng.randint(1, 4) for _ in range(rng.randint(lo, hi))] for lo, hi in ((1, 8), (0, 20)))
        cost, begin, end = decontaminate.edit_match(np.array(a), np.array(b, np.int64))
        assert cost == edits(a, b) and 0 <= begin <= end <= len(b)


def test_decontamination(spark, tmp_path):
    rng = random.Random(5)
    items = [(i, fixtures.prose(rng, rng.randint(6, 45))) for i in range(20)] + [(90, None), (91, "two words"), (92, "zz1 zz2 zz3"), (93, "中文字"), (1, "repetit " * 8)]
    docs = [(r[0], r[1]) for r in fixtures.documents(seed=9)]
    for i, text in items[:20]:
        words = text.split()
        for share in (0, 0.1, 0.25):
            own = list(words)
            for _ in range(int(share * len(decontaminate.words(text)))):
                own[rng.randrange(len(own))] = f"zz{rng.randrange(1000)}"
            docs.append((1000 + len(docs), f"{fixtures.prose(rng, 40)} {' '.join(own)} {fixtures.prose(rng, 40)}"))
    docs += [(5000, "İİİİ two, Words zz1"), (5001, "a zz1 zz2 zz3 中文字體 b"), (5002, "zz1 zz2"), (None, "two words")]
    want = []
    for d, text in docs:
        for i, item in items:
            w = decontaminate.words(item)
            if w and (e := edits(w, decontaminate.words(text))) <= decontaminate.allowed(len(w)):
                want.append((d, i, e))
    rows = [(d, t, None, None, 0, "x", 0.0) for d, t in docs]
    folder = fixtures.write(spark, tmp_path, rows, benchmark=(items, "item_id long, text string"))
    found = decontaminate.op5_decontaminate(spark, folder).collect()
    got = {(r.doc_id, r.item_id, r.edits) for r in found}
    assert got <= set(want) and len(got) >= 0.97 * len(set(want))
    assert {(d, i) for d, i, e in want if not e} <= {(r.doc_id, r.item_id) for r in found}
    spot = next(r for r in found if (r.doc_id, r.item_id) == (5000, 91))
    assert "İİİİ two, Words zz1"[spot.begin : spot.end] == "two, Words" and {r.item_id for r in found if r.doc_id == 5001} >= {92, 93}
    kept = decontaminate.clean(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet"))
    assert kept.where(F.col("doc_id").isin([d for d, _, e in want])).count() == 0 and kept.columns == fixtures.SCHEMA.replace(" string", "").replace(" long", "").replace(" double", "").split(", ")
    assert decontaminate.contaminated(kept, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_decontamination_in_blocks(spark, monkeypatch):
    rng = random.Random(12)
    items = [(i, fixtures.prose(rng, rng.choice([2, 9, 30]))) for i in range(12)]
    docs = [(i, f"{fixtures.prose(rng, 20)} {items[i % 12][1]} zz {fixtures.prose(rng, 20)}") for i in range(40)]
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    told = lambda: (fixtures.bag(map(tuple, decontaminate.contaminated(docs, items).collect())), decontaminate.clean(docs, items).count())
    whole = told()
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 100)
    assert told() == whole and len(whole[0]) >= 40
    assert all(recall >= decontaminate.RECALL for _, _, recall in decontaminate.recalls(items))


def test_lengths_that_hashing_misses_are_verified(monkeypatch):
    """With hopeless tables no length is hashed, and everything is still found; so it is in slices of few places."""
    rng = random.Random(13)
    items = [(i, fixtures.prose(rng, 60)) for i in range(6)]
    texts = []
    for _, t in items:
        own = t.split()
        for k in rng.sample(range(60), 14):
            own[k] = f"zz{k}"
        texts.append(f"{fixtures.prose(rng, 50)} {' '.join(own)} {fixtures.prose(rng, 50)}")
    texts.append("repetit " * 5000)
    items.append((9, "repetit " * 40))
    told = lambda: [[h[0] for h in hits] for hits in decontaminate.find(decontaminate.prepare(items), texts)]
    want = [[i for i, item in items if edits(w := decontaminate.words(item), decontaminate.words(t)) <= decontaminate.allowed(len(w))] for t in texts[:-1]] + [[9]]
    monkeypatch.setattr(decontaminate, "MOST_WALKS", 0)
    assert told() == want
    monkeypatch.setattr(decontaminate, "PLACES", 50)
    assert told() == want


def word_set(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_keys_meet(spark):
    rng = np.random.default_rng(1)
    for _ in range(1500):
        n = int(rng.choice([1, 2, 3, 4, 7, 20, 40, 63, 64, 65, 200, 257, 300, 1000, 1100]))
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        drop, add = int(rng.integers(0, n // 4 + 1)), int(rng.integers(0, n // 3 + 1))
        b = np.unique(np.r_[rng.permutation(a)[drop:], rng.integers(0, 2**64, add, dtype=np.uint64)])
        if not len(b) or not shingles.similar(a, b):
            continue
        shared = np.intersect1d(shingles.parts(a), shingles.parts(b))
        assert (shared % 2 == 1).any() or (shared % 2 == 0).sum() > shingles.spare(len(a)) + shingles.spare(len(b))
        assert shingles.distance(shingles.sketch(a), shingles.sketch(b)) <= len(np.setxor1d(a, b)) <= shingles.may_differ(len(a), len(b))


@pytest.mark.parametrize("block,bits,sampled", [(1024, 64, 64), (3, 4, 64), (3, 64, 1)])
def test_join(spark, tmp_path, monkeypatch, block, bits, sampled):
    """In one block or many; with class hashes that clash; with common keys left dealt."""
    monkeypatch.setattr(ngramjoin, "BLOCK", block)
    monkeypatch.setattr(ngramjoin, "LEAST_BLOCK", min(block, 64))
    monkeypatch.setattr(ngramjoin, "HASH_BITS", bits)
    monkeypatch.setattr(ngramjoin, "SAMPLED", sampled)
    monkeypatch.setattr(ngramjoin, "COMMON_LEAST", 64 if sampled > 1 else 2)
    monkeypatch.setattr(ngramjoin, "SLICE", 2)
    rows = fixtures.documents(seed=2, n=90)
    sets = [(r[0], word_set(r[1])) for r in rows]
    links = []
    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                links.append((j, i))
    group = components(range(len(sets)), links)
    least = {}
    for k, (d, s) in enumerate(sets):
        if d is not None:
            least[group[k]] = min(least.get(group[k], d), d)
    want = [(d, len(s), least.get(group[k]) if s else d) for k, (d, s) in enumerate(sets)]
    got = ngramjoin.op10_ngram_join(spark, fixtures.write(spark, tmp_path, rows)).collect()
    assert fixtures.bag(map(tuple, got)) == fixtures.bag(want)
    assert ngramjoin.link(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_of_each_with_repeated_ids(spark):
    rng = random.Random(21)
    x, y, z, w = (fixtures.prose(rng, 60) for _ in range(4))
    rows = [(5, x), (5, y), (8, x + " canvi"), (9, x), (3, z), (5, z + " canvi"), (7, w), (7, w), (7, w + " canvi"), (5, ""), (5, None), (None, x), (None, w), (None, ""), (None, ""), (4, "")]
    rows += [(6, fixtures.prose(rng, 60)) for _ in range(20)]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, place int")
    for parts in (1, 5):
        got = [tuple(r) for r in ngramjoin.one_of_each(docs.repartition(parts)).select("doc_id", "text").collect()]
        first = [r for r in got if r[0] == 7]
        assert len(first) == 1 and first[0][1] in (w, w + " canvi")
        want = [(5, x), (5, y), (3, z), *first, (5, ""), (5, None), (None, ""), (None, ""), (4, ""), *rows[16:]]
        assert fixtures.bag(got) == fixtures.bag(want)
