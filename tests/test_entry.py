"""The driver's contract."""

import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[1]
DATA = Path("/root/testdata/sf0.001")


def test_names_agree():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert {"p4_found", "p6_found", "identities", "resolve_commits"} <= set(e.queries())


def test_without_the_corpus_subpackage():
    code = "import sys; sys.modules['kinfold.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'identities' in q and 'p1_found' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True, timeout=120)


def test_core_does_not_import_the_subpackage():
    for path in (REPO / "kinfold").rglob("*.py"):
        if "llm" not in path.relative_to(REPO).parts:
            assert "kinfold.llm" not in path.read_text(encoding="utf-8"), path


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
def test_flagship(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["id", "primary_name", "primary_email", "external_id_provider", "external_id"] and df.count() > 0


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", ["people_filtered", "all_components", "limited_components_4", "ext_components", "eval_weighted", "metrics_json", "tables_round_trip"])
def test_some_queries_run(spark, name):
    import __spark_entry__ as e

    rows = e.queries()[name](spark, str(DATA)).collect()
    assert rows and len(set(map(str, rows))) == len(rows)


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
def test_limit_is_reached_and_splits(spark):
    import __spark_entry__ as e

    whole = e.queries()["all_components"](spark, str(DATA)).select("component").distinct().count()
    limited = e.queries()["limited_components_4"](spark, str(DATA))
    assert limited.where("replayed").count() > 0 and limited.select("component").distinct().count() > whole
