"""The pipeline's stages on small tables, and the registered queries' contracts."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from honestpick.llm import queries, quality_classifier, secret_scan
from tests.llm import brute

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages_in_plain_python(spark):
    docs = queries.table(spark, SF, "documents")
    columns = docs.columns
    model = queries.quality_model(docs, queries.table(spark, SF, "labels"))
    good = {r.doc_id for r in quality_classifier.score(docs, model).where(
        quality_classifier.accepted()).collect()}
    rows = {r.doc_id: r.text for r in docs.collect()}
    want = {i: t for i, t in rows.items() if i in good}
    last = {}
    for i in sorted(want):
        last[want[i]] = i
    want = {i: want[i] for i in last.values()}
    comps = brute.jaccard(sorted(want.items()))
    want = {i: want[i] for i, _, c in comps if i == c}
    auto = secret_scan.keyword_automaton()
    want = {i: secret_scan.redact(t, secret_scan.find_spans(t, auto)) for i, t in want.items()}

    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen = stage(spark, seen, SF)
        assert seen.columns == columns, name
        seen = queries_saved(seen)
    assert {r.doc_id: r.text for r in seen.collect()} == want
    assert seen.where(F.col("n_chars") != F.length("text")).count() == 0
    out = corpus_pipeline.run(spark, SF).collect()
    assert Counter(r.doc_id for r in out if r.start == 0) == Counter(list(want))


def queries_saved(df):
    from honestpick.functions.lineage import save_table
    return save_table(df)


def test_junk_goes_and_clean_documents_stay(spark):
    labels = queries.table(spark, SF, "labels")
    got = queries.op10(spark, SF).join(labels, "doc_id").collect()
    assert all(r.kept == (r.quality == 1) for r in got if r.n_words)


def test_registered():
    names = {n.split("_")[0] for n in queries.QUERIES}
    assert names == {f"op{i}" for i in range(1, 14)}
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "exact dedup", "n-gram Jaccard join", "secret scans", "packing"]
