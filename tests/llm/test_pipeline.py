import random

import pytest

import corpus_pipeline
from tests.llm.test_decontaminate import plain as plain_hits
from tests.llm.test_simhash import plain_labels
from tests.llm.test_toxicity import INSULTS, corpus

ITEMS = [(1, "ten words that make one window of the benchmark item")]


@pytest.fixture
def folder(make, labels, spark, tmp_path):
    rng = random.Random(12)
    rows, marks = corpus(300)
    rows += [(1000 + k, rows[k][1]) for k in range(0, 300, 3)]
    rows += [(2000 + k, rows[k][1] + " ten words that make one window of the benchmark item") for k in range(1, 300, 10)]
    rows += [(3000, None), (3001, ""), (None, "a text of its own"), (3002, "word " * 30_000), (5, rows[5][1])]
    full = [(k, t, "en", rng.choice(["s1", "s2", "s2", None])) for k, t in rows]
    make(full).write.parquet(str(tmp_path / "documents.parquet"))
    labels(marks).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        out.write.parquet(f"{folder}/{name}")
        seen[name] = (docs.collect(), spark.read.parquet(f"{folder}/{name}").collect())
        docs = spark.read.parquet(f"{folder}/{name}")
        assert name == "sharding" or docs.columns == names

    before, after = seen["toxicity"]
    toxic = lambda r: any(x in (r.text or "").split() or x in (r.text or "").replace(".", "").split() for x in INSULTS)
    clean = [r for r in before if not toxic(r)]
    assert sum(map(toxic, after)) <= 2 and len(after) >= 0.97 * len(clean)

    before, after = seen["near_duplicates"]
    assert len(after) == len(set(plain_labels([(r.doc_id, r.text) for r in before])[2]))

    before, after = seen["decontamination"]
    short = [(r.doc_id, r.text) for r in before if r.doc_id != 3002]
    hit = {i for i, _, n, _ in plain_hits(short, ITEMS) if n}
    assert hit and sorted(str(r.doc_id) for r in after) == sorted(str(r.doc_id) for r in before if r.doc_id not in hit)

    before, after = seen["mixing"]
    assert {r.doc_id for r in after} <= {r.doc_id for r in before} and len(after) > len(before)

    before, after = seen["sharding"]
    assert sorted(str(r.doc_id) for r in before) == sorted(str(r.doc_id) for r in after)
    for s in range(8):
        slots = [r.slot for r in after if r["shard"] == s]
        assert sorted(slots) == list(range(len(slots)))


def test_run_and_empty_tables(spark, folder, tmp_path):
    out = corpus_pipeline.run(spark, folder)
    assert out.count() > 0 and {"shard", "slot", "grown_shard"} <= set(out.columns)
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(str(tmp_path / "none" / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).collect() == []
