"""Operators 4, 6, 7, 8 and 9: against the libraries, round trips, and held-out accuracy."""

from __future__ import annotations

import base64
import gzip
import hashlib
import random
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quern.llm import grams, language, sentencepieces, tokenshards, toxicity, warc
from tests.llm import fixtures

ODD = ["", " ", "  a b", "a\n b", "é中😀\0x", " a", "a ", "▁a", "a\tb\r\nc", "ﬁ Å", "<s> </s>", "1234 5.6", "a" * 1000, "\n\n  x", " " * 50 + "q", "ab" * 400 + " 中文字符" * 20, "x​▁ 　y", "<|endoftext|>x", "it's 'll I'm"]


def random_texts(n=200):
    rng = random.Random(1)
    return ["".join(rng.choice("abcde  \n\tthing中é😀0189.,▁'") for _ in range(rng.randint(1, 600))) for _ in range(n)]


def test_pieces_match_the_library():
    import sentencepiece

    path = sentencepieces.default_model()
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), sentencepieces.codec(path)
    texts = ODD + random_texts() + [r[1] or "" for r in fixtures.documents()]
    for text, ids in zip(texts, own.encode(texts)):
        assert ids.tolist() == library.encode(text) and own.decode(ids) == library.decode(ids.tolist())


def test_long_words_match_the_library():
    import sentencepiece

    path = sentencepieces.default_model()
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), sentencepieces.codec(path)
    rng = random.Random(7)
    syllables = ["an", "the", "ing", "a", "b", "aa", "ab", "er", "é", "中", "tion", "s", "0", "=", "xx"]
    texts = ["".join(rng.choice(syllables) for _ in range(rng.randint(150, 3000))) for _ in range(60)]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(300, 5000))) for alphabet in ("ab", "aeinorst", "ab中文", "abcdefghijklmnopqrstuvwxyz") for _ in range(10)]
    texts += ["a" * 70_001, "ab" * 30_000, "word " + "x1" * 500 + " end", base64.b64encode(rng.randbytes(60_000)).decode()]
    for text, ids in zip(texts, own.encode(texts)):
        assert ids.tolist() == library.encode(text)


def test_split_bytes_decode_as_in_the_library():
    import sentencepiece

    path = sentencepieces.default_model()
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), sentencepieces.codec(path)
    byte = own.model.byte_id
    for raw in (b"\xe4\xb8", b"\xe4\xb8\xad", b"a\xff\xfe", b"\xf0\x9f\x98", b"\xc3\x28", b"\xed\xa0\x80"):
        ids = byte[list(raw)].tolist()
        assert own.decode(np.array(ids)) == library.decode(ids), raw


def test_pieces_of_every_row(spark, tmp_path):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.default_model())
    rows = fixtures.documents()
    got = sentencepieces.op4_sentencepiece(spark, fixtures.write(spark, tmp_path, rows)).collect()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    told = lambda t: (len(ids := library.encode(t)), sha(",".join(map(str, ids))), sha(library.decode(ids)))
    assert fixtures.bag(map(tuple, got)) == fixtures.bag((r[0], *told(r[1] or "")) for r in rows)
    df = spark.read.parquet(f"{tmp_path}/documents.parquet").withColumn("ids", F.lit("clash"))
    both = sentencepieces.decode(sentencepieces.encode(df))
    assert both.columns == [*df.columns, "decoded"] and both.where("not decoded <=> coalesce(text, '')").count() == 0
    assert sentencepieces.digests(df.limit(0)).count() == 0


def test_full_cache_changes_nothing(monkeypatch):
    monkeypatch.setattr(sentencepieces, "CACHE_WORDS", 5)
    own, texts = sentencepieces.Codec(sentencepieces.default_model()), random_texts(30)
    first = [x.tolist() for t in texts for x in own.encode([t])]
    assert first == [x.tolist() for x in sentencepieces.codec(sentencepieces.default_model()).encode(texts)]


def test_shards(spark, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenshards.default_tokenizer())
    monkeypatch.setattr(tokenshards, "SHARD_IDS", 500)
    rows = fixtures.documents() + [(2000 + i, t, None, None, 0, "x", 0.0) for i, t in enumerate(ODD)]
    folder = fixtures.write(spark, tmp_path, rows)
    got = tokenshards.op8_token_shards(spark, folder).collect()
    want, start = [], 0
    signed = lambda t: 42 if t is None else (h := xxhash.xxh64(t.encode(), seed=42).intdigest()) - (h >> 63 << 64)
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, signed(r[1]), (r[1] or "").encode())):
        ids = np.array(library.encode(r[1] or "", add_special_tokens=False).ids + [0], "<u4")
        want.append((r[0], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert fixtures.bag(map(tuple, got)) == fixtures.bag(want)
    path = f"{tmp_path}/shards"
    tokenshards.write(spark.read.parquet(f"{folder}/documents.parquet").limit(0), path)
    assert tokenshards.read(spark, path).count() == 0


def test_shards_of_one_id(spark, tmp_path):
    """Rows that share an id, or have none, are dealt to several ranges, and their starts still follow each other."""
    docs = spark.createDataFrame([(5 if i % 2 else None, f"text {i} " * 9) for i in range(400)], "doc_id long, text string").repartition(4)
    tokenshards.write(docs, str(tmp_path / "s"))
    shards = spark.read.parquet(str(tmp_path / "s"))
    assert shards.select("range").distinct().count() >= 3
    rows = sorted(tokenshards.read(spark, str(tmp_path / "s")).collect(), key=lambda r: r.start)
    assert [r.start for r in rows] == np.r_[0, np.cumsum([len(r.ids) for r in rows])[:-1]].tolist() and [r.doc_id for r in rows] == [None] * 200 + [5] * 200


def test_grammar_round_trip():
    rng = np.random.default_rng(0)
    docs = [rng.zipf(1.4, rng.integers(1, 400)) % 300 for _ in range(120)] + [np.zeros(1, int), np.full(5000, 7)]
    sizes, ids = [len(d) for d in docs], np.concatenate(docs).astype(np.int32)
    blobs = tokenshards.pack(list(range(len(docs))), sizes, ids, 50257)
    shard = tokenshards.Shard(blobs["docs"], blobs["rules"], blobs["symbols"], 50257)
    assert len(blobs["symbols"]) < 2 * len(ids) and (shard.all_ids() == ids).all()
    for k, d in enumerate(docs):
        a = int(rng.integers(0, len(d) + 1))
        b = int(rng.integers(a, len(d) + 1))
        assert shard.document(k).tolist() == d.tolist() and shard.document(k, a, b).tolist() == d[a:b].tolist()


def packed(docs, first_rule):
    sizes, ids = [len(d) for d in docs], np.concatenate(docs).astype(np.int32)
    blobs = tokenshards.pack(list(range(len(docs))), sizes, ids, first_rule)
    shard = tokenshards.Shard(blobs["docs"], blobs["rules"], blobs["symbols"], first_rule)
    assert (shard.all_ids() == ids).all() and all((shard.document(k) == d).all() for k, d in enumerate(docs))
    return shard


def test_grammar_of_copies():
    """Copies of a long text become a few symbols each, however long it is; pairs seen a few times are replaced too."""
    rng = np.random.default_rng(3)
    text = rng.integers(0, 50000, 6000)
    shard = packed([text] * 40, 50257)
    assert len(shard.symbols) == 40
    shard = packed([rng.integers(0, 50000, 50) for _ in range(20)] + [text[:100]] * 8, 50257)
    assert len(shard.symbols) <= 20 * 50 + 8


def test_grammar_of_a_large_vocabulary():
    rng = np.random.default_rng(4)
    docs = [np.r_[text, 119_999] for text in [rng.integers(60_000, 120_000, 300)] * 30]
    for first_rule in (120_000, 65_000):
        shard = packed([d % first_rule for d in docs], first_rule)
        assert len(shard.symbols) == 30


def test_grammar_with_more_rules_than_16_bits_number():
    rng = np.random.default_rng(5)
    texts = [rng.integers(0, 50_000, 40) for _ in range(1500)]
    shard = packed([t for t in texts for _ in range(8)], 50_257)
    assert len(shard.symbols) == 8 * len(texts) and len(shard.length) > 65_536


def test_encoder_cache(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokenshards, "CACHE_WORDS", 20)
    path = tokenshards.default_tokenizer()
    library, own = Tokenizer.from_file(path), tokenshards.Encoder(path)
    texts = ODD + random_texts(60) + ["Ça và déjà, naïve co-op × 3÷2 " + "ab" * 200, "it's  they'll\n\n 12 ab12 "]
    assert [x.tolist() for x in own.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def pages():
    long = "<p>é</p>" * 20
    return [(i, f"http://a/{i}", long if i % 3 == 0 else f"<p>{i}</p>" * 30) for i in range(40)] + [(40, None, None), (41, "http://a/\r\nX: y", ""), (42, "u", "short"), (43, "u", "short"), (None, "u", long), (3, "u", long), (3, "u", long)]


@pytest.mark.parametrize("compress", [False, True])
def test_warc(spark, tmp_path, compress):
    df = spark.createDataFrame(pages(), "page_id long, url string, html string")
    warc.write(df, str(tmp_path / "w"), compress=compress)
    rows = warc.read(spark, str(tmp_path / "w")).collect()
    assert len(rows) == len(pages()) and not [r for r in rows if r.problem]
    assert fixtures.bag(r.payload_digest for r in rows) == fixtures.bag(hashlib.sha256((p[2] or "").encode()).hexdigest() for p in pages())
    assert sum(r.kind == "response" and r.payload_bytes >= 100 for r in rows) == len({p[2] for p in pages() if p[2] and len(p[2].encode()) >= 100})


def test_warc_query(spark, tmp_path):
    folder = fixtures.write(spark, tmp_path, rows=[], pages=(pages(), "page_id long, url string, html string"))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{folder}/pages.parquet/*.parquet'")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    got = warc.op9_warc(spark, folder)
    assert fixtures.bag(tuple(r[n] for n in names) for r in got.collect()) == fixtures.bag(con.sql(warc.ORACLE).project(", ".join(names)).fetchall())


@pytest.mark.parametrize("compress", [False, True])
def test_salvage(spark, tmp_path, compress):
    df = spark.createDataFrame([p for p in pages() if p[0] is not None], "page_id long, url string, html string").coalesce(1)
    warc.write(df, str(tmp_path / "w"), compress=compress)
    data = next(Path(tmp_path / "w").glob("part*")).read_bytes()
    split = lambda raw: tuple([x for x in warc.salvage(raw) if isinstance(x, kind)] for kind in (warc.Record, warc.Gap))
    whole, none = split(data)
    assert len(whole) == df.count() and not none and (not compress or gzip.decompress(data))
    spot = whole[5].offset + whole[5].length - 30  # in the block, which the digest guards
    broken = data[: whole[2].offset] + b"junk WARC/1.0\r\n" + data[whole[2].offset : spot] + bytes([data[spot] ^ 0xFF]) + data[spot + 1 : -27]
    kept, gaps = split(broken)
    assert len(kept) == len(whole) - 2 and len(gaps) == 3
    assert split(b"") == ([], []) and split(b"nothing here")[1][0].length == 12


def test_foreign_records():
    """Folded headers, other versions, and digests as crawls write them."""
    block = b"HTTP/1.1 200 OK\r\n\r\nhello"
    b32 = base64.b32encode(hashlib.sha1(block).digest()).decode()
    record = lambda version, digest: f"{version}\r\nWARC-Type: response\r\nWARC-Target-URI: http://a/\r\n  b\r\nWARC-Block-Digest: {digest}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    good = record("WARC/1.0", f"sha1:{b32}") + record("WARC/0.18", f"sha1:{hashlib.sha1(block).hexdigest()}") + record("WARC/1.1", "md5:unknown")
    found = list(warc.salvage(good + record("WARC/1.0", "sha1:" + "A" * 32)))
    assert [type(x) for x in found] == [warc.Record] * 3 + [warc.Gap] and found[0].headers["warc-target-uri"] == "http://a/ b"


def test_files_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 4000)
    monkeypatch.setattr(warc, "SIZES", (100, 1000))
    rows = [(i, f"u{i}", f"{i} " * n) for i, n in enumerate([5] * 300 + [200] * 20 + [3000] * 3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.write(df, str(tmp_path / "w"))
    got = warc.read(spark, str(tmp_path / "w"))
    assert got.count() == len(rows) and got.groupBy("path").agg(F.sum("payload_bytes").alias("n"), F.count("*").alias("c")).where("n > 4000 and c > 1").count() == 0
    warc.write(df.limit(0), str(tmp_path / "none"))
    assert warc.read(spark, str(tmp_path / "none")).count() == 0


LANGS = {"ca": "els camps són molt amples i també hi ha vaques perquè plou", "es": "los campos son muy anchos y también hay vacas porque llueve", "en": "the fields are very wide and there are cows because it rains"}


def language_rows():
    rng = random.Random(2)
    rows = []
    for i in range(300):
        lang = rng.choice(sorted(LANGS))
        rows.append((i, " ".join(rng.choice(LANGS[lang].split()) for _ in range(rng.randint(6, 40))), lang if i % 11 else None, None, 0, "x", 0.0))
    return rows + [(900, None, "ca", None, 0, "x", 0.0), (901, "", "ca", None, 0, "x", 0.0), (902, "123 ... !", "ca", None, 0, "x", 0.0), (None, "the cows", None, None, 0, "x", 0.0)]


def test_language(spark, tmp_path):
    rows = language_rows()
    got = {r.doc_id: r for r in language.op6_language_id(spark, fixtures.write(spark, tmp_path, rows)).collect()}
    assert all(got[d].lang_pred == "und" and got[d].score == 0 for d in (900, 901, 902)) and len(got) == len(rows)
    held = [r for r in rows if r[0] is not None and r[0] < 900 and r[2] and zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert all(got[r[0]].held_out for r in held) and np.mean([got[r[0]].lang_pred == r[2] for r in held]) >= 0.97
    none = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert language.predict(none, language.fit(none)).first().lang_pred == "und"
    one = spark.createDataFrame([(1, "text", "ca")], none.schema)
    assert language.predict(one, language.fit(one)).first().lang_pred == "ca"


def test_codewords_differ():
    for k in (2, 3, 4, 6, 9, 20, 60):
        code = language.codewords(k)
        assert len({tuple(r) for r in code}) == k and all(len(set(c)) == 2 for c in code.T)
        if k > 6:
            assert min((a != b).sum() for i, a in enumerate(code) for b in code[:i]) >= 6


def test_language_trust_is_out_of_fold(spark):
    rows = [(i, r[1], "es" if i % 9 == 0 else r[2]) for i, r in enumerate(language_rows()) if r[2] and i < 300]  # some wrong labels
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(set(np.round(model.trust, 6))) == len(model.trust) and (model.trust > 0).all()


def test_language_odd_rows(spark):
    long = "the cows are in the fields " * 60_000
    rows = [(i % 40, LANGS[k] + f" {i}", k, k, 0.5) for i in range(60) for k in LANGS] + [(1, long, "en", "x", 0.5), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double")
    model = language.fit(df.select("doc_id", "text", "lang"))
    told = language.predict(df, model)
    assert told.columns == ["doc_id", "text", "lang", "lang_pred", "score", "ambiguous"] and told.count() == len(rows)
    assert told.where("text is not null and lang_pred <> lang").count() == 0 and language.predict(df.limit(0), model).count() == 0


def test_grams_are_of_characters():
    def slow(text, n):
        padded = f" {text.lower()} "
        return [padded[i : i + n] for i in range(len(padded) - n + 1)]

    text = "Pluja é中😀 à"
    found = list(grams.codes(grams.code_points(text), (3,), 40))[0]
    assert len(found) == len(slow(text, 3)) and len(set(found.tolist())) == len(set(slow(text, 3)))
    whole = [sorted(x.tolist()) for x in grams.codes(grams.code_points(text * 50), (2, 4), 30)]
    grams.PIECE_CHARS, kept = 37, grams.PIECE_CHARS
    try:
        pieces = [x.tolist() for x in grams.codes(grams.code_points(text * 50), (2, 4), 30)]
    finally:
        grams.PIECE_CHARS = kept
    assert sorted(sum(pieces, [])) == sorted(sum(whole, []))


def toxic_rows():
    rng = random.Random(4)
    bad = ["idiota", "imbecil", "escoria", "pallasso"]
    rows, labels = [], []
    for i in range(500):
        words = fixtures.prose(rng, rng.randint(20, 80)).split(" ")
        toxic = rng.random() < 0.3
        for _ in range(rng.randint(2, 4) if toxic else 0):
            words[rng.randrange(len(words))] = rng.choice(bad)
        rows.append((i, " ".join(words), None, None, 0, "x", 0.0))
        labels.append((i, 1, int(toxic)))
    return rows + [(900, None, None, None, 0, "x", 0.0), (901, "", None, None, 0, "x", 0.0)], labels + [(7, 0, None)]


def test_toxicity(spark, tmp_path):
    rows, labels = toxic_rows()
    folder = fixtures.write(spark, tmp_path, rows, labels=(labels, "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r for r in toxicity.op7_toxicity(spark, folder).collect()}
    held = [(d, t) for d, _, t in labels if t is not None and zlib.crc32(str(d).encode()) % 5 == 0]
    assert len(got) == len(rows) and all(got[d].held_out for d, _ in held)
    assert np.mean([got[d].predicted == t for d, t in held]) >= 0.95
    assert got[900].score == got[901].score and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for some in ([], [(1, 0)], [(1, 1)]):
        model = toxicity.fit(docs, spark.createDataFrame(some, "doc_id long, toxic int"))
        scores = [r.score for r in toxicity.score(docs, model, keep=["doc_id"]).collect()]
        assert len(scores) == len(rows) and len(set(scores)) == 1


def test_toxicity_odd_rows(spark):
    rows, labels = toxic_rows()
    data = [(r[0], r[1], 0.1) for r in rows[:200]] * 2 + [(None, rows[0][1] * 3000, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, score double")
    more = labels[:200] + [(d, q, 1) for d, q, _ in labels[:3]] + [(None, 1, 1)]
    told = lambda parts: toxicity.fit(docs.repartition(parts), spark.createDataFrame(more, "doc_id long, quality int, toxic int"))
    a, b = told(2), told(5)
    assert (a.place == b.place).all() and np.allclose(a.weight, b.weight, atol=1e-6)
    got = toxicity.score(docs, a)
    assert got.columns == docs.columns and got.count() == len(data) and got.where("score is null").count() == 0
    assert toxicity.score(docs.limit(0), a).count() == 0
    clash = spark.createDataFrame([(1, "x y z"), (2, "x y z")], "doc_id long, text string")
    both = toxicity.fit(clash, spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int"))
    assert toxicity.score(clash, both).first().score > 0.5  # equal texts take the largest of their labels
