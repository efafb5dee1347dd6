"""The pipeline's stages against brute force, each on its own input."""

from collections import Counter

import corpus_pipeline
from tests.llm.test_dedup import brute_lines
from tests.llm.test_near_copies import holds
from tidemark.llm import quality_rules


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash", "mixing", "packing"]


def test_stages_keep_columns_and_agree_with_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    clean = stage("quality_rules")(spark, docs, sf)
    assert clean.columns == docs.columns
    verdict = {r.doc_id: r for r in quality_rules.judge(docs).select("doc.doc_id", "quality.*").collect()}
    rows = clean.collect()
    assert {r.doc_id: r.text for r in rows} == {d: v.clean_text for d, v in verdict.items() if v.kept}
    assert all(r.n_chars == len(r.text) for r in rows)

    fewer = stage("line_dedup")(spark, clean, sf)
    want = {d: t for d, t, _, n in brute_lines([(r.doc_id, r.text) for r in rows]) if not n or t.split()}
    rows = fewer.collect()
    assert fewer.columns == docs.columns and {r.doc_id: r.text for r in rows} == want

    single = stage("simhash")(spark, fewer, sf)
    before, rows = [(r.doc_id, r.text) for r in rows], single.collect()
    assert single.columns == docs.columns and len(rows) < len(before)
    holds(before, [r.doc_id for r in rows])

    mixed = stage("mixing")(spark, single, sf)
    copies = Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == docs.columns and set(copies) <= {r.doc_id for r in rows} and max(copies.values()) <= 2

    packed = stage("packing")(spark, mixed, sf).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == copies


def test_odd_rows_pass_every_stage(spark, odd, none, sf):
    for docs in (odd, none):
        for _, f in corpus_pipeline.STAGES[:-1]:
            docs = f(spark, docs, sf)
            assert docs.columns == odd.columns
        corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
        for _, f in corpus_pipeline.STAGES:
            f(spark, odd, sf).collect()


def test_one_row_of_each_group_stays(spark, sf):
    """Repeated rows, null ids, and two texts under one id."""
    same, other, third = "one text that is stored a few times over", "quite another text that has the same id", "a text which only rows without an id have"
    rows = [(1, same), (1, same), (2, same), (None, same), (2, other), (2, other), (None, third), (None, third)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = stage("simhash")(spark, docs, sf).collect()
    assert sorted(map(tuple, left), key=repr) == sorted([(1, same), (2, other), (None, third)], key=repr)
