"""Joins on hot keys: both ways, broadcast and shuffled, give whole results."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm import test_dedup
from tidemark.llm import common, line_dedup, mixing, simhash


@pytest.fixture(params=[1, 4, 1 << 20])
def slots(request, monkeypatch):
    """Few slots make nearly all keys cold, many make all hot."""
    monkeypatch.setattr(common, "HOT_SLOTS", request.param)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    return request.param


def test_join(spark, slots):
    left = spark.range(1000).selectExpr("id", "IF(id % 3 = 0, 0L, id % 50) AS k")
    right = left.groupBy("k").agg(F.count("*").alias("n")).where("k <> 7")
    rows = common.hot_key_join(left, right, ["k"], "n", 1000).collect()
    sizes = Counter(0 if i % 3 == 0 else i % 50 for i in range(1000))
    assert sorted((r.id, r.k, r.n) for r in rows) == [(i, k, sizes[k]) for i in range(1000) if (k := 0 if i % 3 == 0 else i % 50) != 7]


def test_operators(spark, odd, slots):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = line_dedup.drop_lines(odd).select("doc.doc_id", "kept_text", "n_lines", "n_dropped").collect()
    assert sorted(map(tuple, got), key=repr) == test_dedup.brute_lines(rows)
    assert simhash.near_duplicates(odd).count() == len(rows)
    assert mixing.mixing_plan(odd).count() == len(rows)


def test_scratch_is_deleted(spark, odd):
    folder = common.shared_root(spark).removeprefix("file://")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    with common.scratch(spark) as root:
        assert line_dedup.drop_lines(odd).count() == odd.count() and os.listdir(root.removeprefix("file://"))
    assert set(os.listdir(folder)) == before
