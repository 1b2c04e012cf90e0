"""Catalogue queries against their SQL on a small table, and the entry module's guard."""

import os
import subprocess
import sys

import duckdb
import pytest

from lexmill.plans import catalog

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
NAMES = ["q05_align_modes", "q10_macro_metrics", "q15_ngram_predict", "q19_strong_protect", "q24_hard_cases", "q30_sweep_tri_only", "q37_dict_apply", "q45_overlay_policies"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    words = "the der la Été Straße niño go1ng 10:30 @x #y ... ok u :) çA".split()
    rows = [(i, " ".join(words[(i * k + k) % len(words)] for k in range(1, 25)), ["en", "de", "es", "fr"][i % 4]) for i in range(60)]
    rows += [(None, "a b", "en"), (100, None, "en"), (101, "", "de"), (102, " \n", "de")]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").write.parquet(f"{d}/documents.parquet")
    return d


def plain(rows):
    return sorted(repr(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, tables, name):
    got = catalog.QUERIES[name](spark, tables)
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tables}/documents.parquet/*.parquet'")
    want = con.sql(catalog.SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert plain(got.select(*columns).collect()) == plain(want.select(*[f'"{c}"' for c in columns]).fetchall())


def test_entry_without_the_optional_package(tmp_path):
    """A copy of the repository without the optional subpackage still imports and lists its queries."""
    code = "import __spark_entry__ as e; q = e.queries(); assert 'q09_err_metrics' in q and set(e.oracle_sql()) <= set(q); print(len(q))"
    for name in ("lexmill", "__spark_entry__.py"):
        os.symlink(os.path.join(ROOT, name), tmp_path / name) if name.endswith(".py") else None
    subprocess.run(["cp", "-r", os.path.join(ROOT, "lexmill"), str(tmp_path / "lexmill")], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "lexmill" / "llm")], check=True)
    (tmp_path / "__spark_entry__.py").unlink()
    subprocess.run(["cp", os.path.join(ROOT, "__spark_entry__.py"), str(tmp_path)], check=True)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) >= 45
