"""Readers, writers and the streaming form."""

import json
import zipfile

import pytest

from lexmill.operators import ngram, replace, tokens
from lexmill.sources import readers, writers
from lexmill.streaming import predict as stream


@pytest.mark.parametrize(
    ("name", "content"),
    [
        ("a.json", '[["a", ""], ["b"]]'),
        ("b.json", '{"predictions": [["a", ""], ["b"]]}'),
        ("c.json", '[{"pred": ["a", ""]}, {"normalized": ["b"]}]'),
        ("d.jsonl", '["a", ""]\n\n{"prediction": ["b"]}\n'),
        ("e.tsv", "a\t\nb\n"),
        ("f.csv", 'id,pred\n1,"[""a"", """"]"\n2,"[""b""]"\n'),
    ],
)
def test_prediction_formats(spark, tmp_path, name, content):
    path = tmp_path / name
    path.write_text(content)
    got = readers.predictions(spark, str(path)).orderBy("row_id").collect()
    assert [(r.row_id, r.pred) for r in got] == [(0, ["a", ""]), (1, ["b"])]


def test_readers_refuse(spark, tmp_path):
    (tmp_path / "x.csv").write_text("id\n1\n")
    for f in (lambda: readers.predictions(spark, str(tmp_path / "x.csv")), lambda: readers.predictions(spark, "x.bin"), lambda: readers.sentences(spark, "x.bin")):
        with pytest.raises(readers.SchemaError):
            f()
    spark.range(1).write.parquet(str(tmp_path / "y.parquet"))
    with pytest.raises(readers.SchemaError, match="lang, norm, raw"):
        readers.sentences(spark, str(tmp_path / "y.parquet"))


def test_sentences_and_checks(spark, tmp_path):
    rows = [(["a"], ["b"], "en"), (["a"], [], "en"), (None, ["b"], "en"), ([None], ["b"], "en")]
    spark.createDataFrame(rows, "raw array<string>, norm array<string>, lang string").write.parquet(str(tmp_path / "s.parquet"))
    df = readers.sentences(spark, str(tmp_path / "s.parquet"))
    assert readers.invalid(df).count() == 3 and df.agg(readers.has_gold(df)).collect()[0][0]
    texts = spark.createDataFrame([("['a', 'b']",), ('["a", "b"]',), ("a b",)], "v string")
    assert [r[0] for r in texts.select(readers.parse_tokens(texts.v)).collect()] == [["a", "b"]] * 3


def test_dictionary_shapes(spark, tmp_path):
    path = tmp_path / "d.json"
    path.write_text(json.dumps({"language": "es", "high_confidence_pairs": {"q": "que"}, "review_pairs": {"k": {"top_norm": "que", "top_count": 2, "raw_total": 3}}, "ambiguous_pairs": {"to": {"top_norm": "toda", "top_count": 1}}, "context_sensitive_tokens": ["q"]}))
    got = {(r.section, r.raw): (r.norm, r["count"], r.context_sensitive) for r in readers.dictionary(spark, str(path)).collect()}
    assert got == {("high", "q"): ("que", None, True), ("review", "k"): ("que", 2, False), ("ambiguous", "to"): ("toda", 1, True)}
    (tmp_path / "l.json").write_text('[{"raw": "a", "norm": "b", "context_sensitive": true}]')
    assert [(r.lang, r.raw, r.norm, r.context_sensitive) for r in readers.dictionary(spark, str(tmp_path / "l.json"), "sl").collect()] == [("sl", "a", "b", True)]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(2, "en", ["b"], ["B"]), (1, "en", ["a"], [""])], "row_id bigint, lang string, raw array<string>, pred array<string>")
    assert writers.submission_zip(df, str(tmp_path / "p.zip")) == 2
    with zipfile.ZipFile(tmp_path / "p.zip") as z:
        assert json.loads(z.read("predictions.json")) == [{"raw": ["a"], "norm": [""], "lang": "en", "pred": [""]}, {"raw": ["b"], "norm": [""], "lang": "en", "pred": ["B"]}]
    writers.metrics_csv([spark.range(1).selectExpr("1 as a"), spark.range(1).selectExpr("2 as b", "3 as a")], str(tmp_path / "m"))
    back = spark.read.csv(str(tmp_path / "m"), header=True)
    assert back.columns == ["a", "b"] and sorted(map(tuple, back.collect()), key=str) == [("1", None), ("3", "2")]
    writers.predictions(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    log = spark.createDataFrame([(1, 0, "u", "you")], "dev_row_idx bigint, tok_idx int, token string, normalized string")
    writers.append_log(log, str(tmp_path / "log"))
    writers.append_log(log, str(tmp_path / "log"))
    assert readers.corrections(spark, str(tmp_path / "log")).count() == 2


def test_stream_gives_what_a_table_gives(spark, tmp_path):
    train = tokens.explode(spark.createDataFrame([(1, "en", ["u", "ok"], ["you", "ok"])], "row_id bigint, lang string, raw array<string>, norm array<string>"))
    levels, stats = ngram.tables(train), replace.statistics(train)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"row_id": 5, "lang": "en", "raw": ["u", "hm"]}\n')
    stream.write(stream.predict(stream.read(spark, str(tmp_path / "in")), levels, stats), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    got = {r.raw: r.pred for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    table = spark.read.schema(stream.SENTENCE).json(str(tmp_path / "in"))
    assert got == {r.raw: r.pred for r in stream.predict(table, levels, stats).collect()} == {"u": "you", "hm": "hm"}
