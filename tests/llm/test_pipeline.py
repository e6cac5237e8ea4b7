"""Every stage on its predecessor's output, against brute force."""

from collections import Counter

import corpus_pipeline
import pytest
from lumisift.llm import mixing
from lumisift.llm.common import running_total, written
from pyspark.sql import functions as F
from test_llm import jaccard_by_force, targets_by_force


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], sf)))
    return out


def test_columns(stages):
    assert [d.columns for d in stages[1:-1]] == [stages[0].columns] * 4


def test_language_keeps_documents(stages):
    assert stages[1].count() >= 0.99 * stages[0].count()


def test_lines(stages):
    key = lambda line: line.strip(" \t\n\v\f\r").translate({c: c + 32 for c in range(65, 91)})
    before = {r.doc_id: r.text for r in stages[1].collect()}
    seen = Counter(k for t in before.values() for k in {key(x) for x in t.split("\n")})
    after = {r.doc_id: (r.text, r.n_chars) for r in stages[2].collect()}
    for i, t in before.items():
        kept = "\n".join(x for x in t.split("\n") if not key(x) or seen[key(x)] < 10)
        assert after[i] == (kept, len(kept))


def test_near_copies(stages):
    before = sorted((r.doc_id, r.text) for r in stages[2].collect())
    _, roots = jaccard_by_force([t for _, t in before])
    assert sorted(r.doc_id for r in stages[3].collect()) == sorted({before[k][0] for k in roots})


def test_mix(stages):
    sizes, taken = Counter(), Counter()
    for r in stages[3].collect():
        sizes[r.source] += len(r.text.split())
    for r in stages[4].collect():
        taken[r.source] += len(r.text.split())
    want = targets_by_force(dict(sizes))
    assert all(abs(taken[s] - want[s]) <= 0.02 * want[s] for s in want)


def test_packing_takes_every_document(stages):
    rows = stages[5].collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in stages[4].collect()}
    assert all(r.offset + r.length <= 4096 for r in rows)


def test_registered(spark, sf, stages):
    import __spark_entry__

    assert sorted(map(tuple, __spark_entry__.queries()["pipeline"](spark, sf).collect())) == sorted(map(tuple, stages[5].collect()))


def test_awkward_rows_and_empty_tables(spark, sf):
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, size int"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60).selectExpr("doc_id", "text", "lang", "source", "n_chars", "'x' AS row", "1 AS size")
    text = docs.first().text
    odd = [(None, None, None, None, None, None, None), (10**9, "", "en", None, 0, "y", 2), (10**9 + 1, text, None, None, 1, "z", 3), *[(10**9 + 2, text, "en", "same", 1, "z", 3)] * 5, (10**9 + 3, text * 40, "en", "same", 1, "z", 3)]
    for rows in (docs.union(spark.createDataFrame(odd, schema)), spark.createDataFrame([], schema)):
        current = rows
        for name, stage in corpus_pipeline.STAGES:
            current = written(stage(spark, current, sf))
            if name != "packing":
                assert current.columns == rows.columns
            if name == "ngram_join" and rows is not current:
                left = [r.doc_id for r in current.collect()]
                assert len(left) == len(set(left)) and None not in left and 10**9 + 2 not in left
        assert (current.count() > 0) == (not rows.isEmpty())


def test_no_more_python_workers_than_tasks(spark, sf):
    """Executors keep a worker for each step in Python that stands in one stage, and a daemon with others for plain rows."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    mixed = plan(mixing.mix(docs))
    assert mixed.count("ArrowEvalPython") == mixed.count("documents.parquet") > 0
    assert "ExistingRDD" not in plan(running_total(docs.select("doc_id", "n_chars"), [F.col("doc_id")], "n_chars", "at"))
