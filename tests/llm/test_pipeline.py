"""The pipeline against its stages done by brute force, and the guard of the entry module."""

from __future__ import annotations

import hashlib
import random
import subprocess
import sys
from pathlib import Path

from quern.llm import decontaminate, toxicity
from quern.llm.common import read_table
from tests.llm import fixtures
from tests.llm.test_coding import toxic_rows
from tests.llm.test_search import components, edits, spans, word_set

ROOT = Path(__file__).resolve().parents[2]


def test_pipeline(spark, tmp_path):
    import sentencepiece

    import corpus_pipeline
    from quern.llm.sentencepieces import default_model

    rng = random.Random(8)
    rows, labels = toxic_rows()
    rows = [(r[0], r[1], *r[2:]) for r in rows[:150]]
    items = [(i, fixtures.prose(rng, 25)) for i in range(4)]
    rows += [(1000 + i, f"{fixtures.prose(rng, 20)} {items[i % 4][1]} {fixtures.prose(rng, 20)}", None, None, 0, "x", 0.0) for i in range(8)]
    rows += [(1100 + i, f"{rows[i][1]} canvi", None, None, 0, "x", 0.0) for i in range(20)]
    rows += [(1200, "el token = abcdefgh1234 és aquí", None, None, 31, "x", 0.0), (1201, None, None, None, 0, "x", 0.0), (1202, "", None, None, 0, "x", 0.0)]
    folder = fixtures.write(spark, tmp_path, rows, labels=(labels, "doc_id long, quality int, toxic int"), benchmark=(items, "item_id long, text string"))

    docs = read_table(spark, folder, "documents")
    model = toxicity.fit(docs, toxicity.training_labels(read_table(spark, folder, "labels")))
    kept = [r for r in rows if model.score(r[1]) < 0.5]
    sets = [word_set(r[1]) for r in kept]
    links = [(j, i) for i, a in enumerate(sets) for j in range(i) if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j])]
    group, least = components(range(len(kept)), links), {}
    for k, r in enumerate(kept):
        least[group[k]] = min(least.get(group[k], r[0]), r[0])
    kept = [r for k, r in enumerate(kept) if r[0] == least[group[k]]]
    leaks = lambda t: any(edits(w := decontaminate.words(x), decontaminate.words(t)) <= decontaminate.allowed(len(w)) for _, x in items)
    kept = [r for r in kept if not leaks(r[1])]
    library = sentencepiece.SentencePieceProcessor(model_file=default_model())

    def masked(text):
        for s in reversed([x for x in spans(text).split(",") if x]):
            kind, a, b = s.split(":")
            text = text[: int(a)] + f"[{kind}]" + text[int(b) :]
        return text

    want = []
    for r in kept:
        text = masked(r[1] or "")
        ids = library.encode(text)
        want.append((r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    got = corpus_pipeline.run(spark, folder)
    assert fixtures.bag(map(tuple, got.collect())) == fixtures.bag(want)
    assert len(want) < len(rows) - 20 and "[assign]" in masked(rows[-3][1])


def test_entry_without_this_subpackage(tmp_path):
    """The entry module still imports, and offers the other queries, where the subpackage and the pipeline are gone."""
    import shutil

    shutil.copytree(ROOT / "quern", tmp_path / "quern", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'q00_flagship' in q and not [n for n in q if n.startswith('op') or n == 'pipeline']; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
