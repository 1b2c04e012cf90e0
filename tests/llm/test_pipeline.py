"""The pipeline's stages on a small fixture, each held against what it must do."""

import hashlib
import importlib.util
import os

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    word = lambda i, k: "w" + hashlib.md5(f"{i}-{k}".encode()).hexdigest()[:5]
    rows = []
    for i in range(200):
        text = [word(i, k) for k in range(60)]
        if i % 10 == 0:
            text[5] = "idiot"
        rows.append((i, " ".join(text), "en", "s", 1))
    rows.append((300, rows[1][1] + " extra", "en", "s", 1))
    item = " ".join(f"bench{k}" for k in range(12))
    rows.append((301, f"{' '.join(word(900, k) for k in range(40))} {item} tail", "en", "s", 1))
    rows.append((302, f"{' '.join(word(901, k) for k in range(40))} token = abcdef123456 end", "en", "s", 1))
    rows.append((303, None, "en", "s", 0))
    rows.append((304, item, "en", "s", 1))
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 10 == 0)) for i in range(200)], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages(spark, tables, tmp_path):
    spec = importlib.util.find_spec("corpus_pipeline")
    assert spec and os.path.dirname(spec.origin) == ROOT
    import corpus_pipeline

    docs, seen = spark.read.parquet(f"{tables}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, tables).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r.doc_id: r for r in docs.collect()}
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = {name: set(rows) for name, rows in seen.items()}
    clean = {i for i in range(200) if i % 10}
    assert ids["toxicity"] == clean | {300, 301, 302, 303, 304}
    assert ids["minhash_dedup"] == ids["toxicity"] - {300}
    assert ids["decontamination"] == ids["minhash_dedup"] - {304}
    assert "bench" not in seen["decontamination"][301].text and seen["decontamination"][301].text.endswith(" tail")
    assert all(seen["decontamination"][i].text == seen["toxicity"][i].text for i in clean)
    assert seen["secret_scan"][302].text.endswith("[SECRET] end")
    assert ids["packing"] == ids["secret_scan"]
    assert {(r.doc_id, r.start) for r in corpus_pipeline.run(spark, tables).collect()} == {(r.doc_id, r.start) for r in docs.collect()}
