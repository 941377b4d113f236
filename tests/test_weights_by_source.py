"""q23 on documents that share a key: one document each key, as its SQL has it."""

import duckdb

from quern.plans import oracles, queries


def test_shared_keys(spark, tmp_path):
    texts = ["vaca llet vaca", "vaca camp", "camp robot", "robot robot llet", "sol llet camp"]
    rows = [(k // 3, t, "en", f"s{k % 2}", len(t)) for k, t in enumerate(texts * 4)] + [(None, "vaca robot", "en", "s0", 10)] * 2 + [(99, None, "en", "s1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    df = queries.q23_tfidf_terms(spark, str(tmp_path))
    got = sorted(map(tuple, df.select("topic", "rank", "word", "score").collect()))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.execute(f"select topic, rank, word, score from ({oracles.ORACLES['q23_tfidf_terms']})").fetchall())
    assert got == want and len(got) > 4
