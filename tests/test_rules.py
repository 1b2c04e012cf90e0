"""Predicates, normal forms and candidate rules on hand-made cases."""

import pytest
from pyspark.sql import functions as F

from lexmill.functions import text
from lexmill.operators import candidates, parse


def values(spark, rows, *columns):
    df = spark.createDataFrame([(r,) for r in rows], "raw string")
    return [tuple(r) for r in df.select(*columns).collect()]


def test_strong_protection(spark):
    kept = ["#Tatort2024", "@user", "iPhone15", "BNK48", "RT", "[url]", "...", "10:30", "$5", "", "  ", None, "😀", ":)", "www.x.de", "a@b.co", "5th", "7 pm", "๕", "!?", " "]
    free = ["rt", "word", "é", "ÇOK", "don't", "a-b", "x.y", "กข"]
    assert [v for (v,) in values(spark, kept, text.strong_protect(F.col("raw")))] == [True] * len(kept)
    assert [v for (v,) in values(spark, free, text.strong_protect(F.col("raw")))] == [False] * len(free)
    assert values(spark, ["word"], text.strong_protect(F.col("raw"), ["word"])) == [(True,)]


def test_weak_protection_counts_unicode_letters(spark):
    got = values(spark, ["é", "!!", "_", "a1", "๕", "HTTPx", "@x", "word"], text.weak_protect(F.col("raw")))
    assert [v for (v,) in got] == [False, True, True, True, True, True, True, False]


def test_repetitions(spark):
    got = values(spark, ["anak2", "anak2nya", "bersama2", "ab2", "orang\"nya"], text.expand_repetition(F.col("raw")))
    assert [v for (v,) in got] == ["anak-anak", "anak-anaknya", None, None, "orang-orangnya"]
    assert values(spark, ["cooool", "coool", "cool"], text.reduce_runs(F.col("raw"))) == [("cool",)] * 3
    assert values(spark, ["จริงๆ"], text.thai_repeat_space(F.col("raw"))) == [("จริง ๆ",)]
    assert values(spark, ["@x", "@", "x"], text.mention_mark(F.col("raw"))) == [("[mention]",), ("@",), ("x",)]


def test_language_codes(spark):
    got = values(spark, ["ID-EN", "tr_de", " En ", None], text.lang_code(F.col("raw")))
    assert [v for (v,) in got] == ["iden", "trde", "en", ""]


@pytest.mark.parametrize(
    ("lang", "yes", "no"),
    [
        ("en", ["u", "gettin", "sooo", "dont", "2"], ["within", "house", "3", "#u", "@u"]),
        ("de", ["nich", "fuer", "schoen", "jaaa", "ich"], ["Haus", "blau", "iPhone15"]),
        ("es", ["tambien", "jajaja", "q", "rapidamente"], ["casa", "canción"]),
        ("da", ["pa", "jeq", "vaere"], ["hund"]),
        ("nl", ["ff", "kheb", "jaaa"], ["huis", "suc6"]),
        ("it", ["nn", "perche", "citta'", "NON"], ["casa", "lol", "ROMANO"]),
        ("id", ["yg", "bangettt", "bukunyx"], ["buku", "anak2"]),
        ("iden", ["dont", "yg"], ["house"]),
        ("sl", ["tud", "cas", "l'"], ["lol", "moment"]),
        ("tr", ["cok", "cnm", "geliyo", "iyiii"], ["kitap"]),
        ("trde", ["schule", "cok"], ["kitap"]),
        ("vi", ["ko", "abc"], ["không", "đường"]),
        ("th", ["มากๆ", "คับ"], ["555", "ครับ"]),
        ("ja", ["てる", "カワいい", "すごーーい", "①番", "㌔です", "か\u3099くせい"], ["て", "犬", "www", "①", "番"]),
        ("ko", ["ㄹㅇ", "존나", "ㅆ1발", "먹었당", "ㄱㅊ", "와아아아", "tlqkf", "개쩔어", "A급이다"], ["ㅋㅋㅋㅋㅋㅋ", "ㅇㅇ", "사람", "야당", "#태그", "...", ""]),
        ("hr", ["šta", "kaj", "sreca", "joooj"], ["dobro", "lol", "XD"]),
        ("sr", ["sto", "kaze", "radis’"], ["dobro", "haha"]),
        ("fr", [], ["u", "cok", "sooo"]),
    ],
)
def test_candidates(spark, lang, yes, no):
    df = spark.createDataFrame([(lang, t, True) for t in yes] + [(lang, t, False) for t in no], "lang string, raw string, want boolean")
    wrong = df.where(candidates.is_candidate() != F.col("want")).collect()
    assert not wrong


def test_candidates_that_look_ahead(spark):
    df = spark.createDataFrame([("ja", ["犬", "ね", "。"], 1), ("ja", ["ね", "犬"], 0)], "lang string, raws array<string>, tok_idx int")
    got = df.withColumn("raw", F.get("raws", F.col("tok_idx"))).select(candidates.is_candidate(final=candidates.is_final("raws"))).collect()
    assert [r[0] for r in got] == [True, False]


def test_spans(spark):
    df = spark.createDataFrame([([False, True, False, False],), ([],), ([False],)], "candidate array<boolean>")
    got = [[(s.start, s.end) for s in r.s] for r in df.select(candidates.spans().alias("s")).collect()]
    assert got == [[(0, 2), (0, 3), (1, 2), (1, 3), (1, 4)], [], []]


def test_reading_answers(spark):
    assert parse.salvage('```json\n{"normalized": "x"}\n```') == '{"normalized": "x"}'
    assert parse.salvage('so {not json} then {"a": 1} and {"b": 2}') == '{"a": 1}'
    assert parse.salvage("[1]") is None and parse.salvage(None) is None and parse.salvage('{"a":"}"} x') is None
    rows = ['{"normalized": "ok", "label": true}', '{"normalized": 1, "label": "0"}', "[1]", "nothing", None, 'x {"normalized": "in"} y']
    found = parse.extract_object(F.col("raw"))
    got = values(spark, rows, parse.string_field(found, "normalized"), parse.label(found))
    assert got == [("ok", 1), (None, 0), (None, None), (None, None), (None, None), ("in", None)]
    guard = spark.createDataFrame([("w", "x y"), ("#w", "x"), ("w", " "), ("w", None), ("w", "a b c d e f g"), ("w", "a@b")], "raw string, a string")
    assert [r[0] for r in guard.select(parse.post_guard(F.col("raw"), F.col("a"))).collect()] == ["x y", "#w", "w", "w", "w", "w"]
