import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from lumisift.plans.queries import ORACLE_SQL, QUERIES
from support import same


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf, name):
    same(spark, sf, QUERIES[name], ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_other_queries_give_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 150
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("gone", [("lumisift/llm", "tests/llm"), ("lumisift/llm", "tests/llm", "corpus_pipeline.py")])
def test_entry_without_the_text_operators(tmp_path, gone):
    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root, tmp_path / "repo", ignore=lambda folder, names: [n for n in names if str((Path(folder) / n).relative_to(root)) in gone or n in (".git", "__pycache__")])
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path / "repo", env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True, check=True)
    assert said.stdout.split() == [str(len(QUERIES)), str(len(ORACLE_SQL))]
