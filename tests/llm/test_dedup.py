"""Line deduplication and SimHash against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from tidemark.llm import common, line_dedup, queries, simhash

BLANKS = " \t\n\x0b\x0c\r"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def brute_lines(rows):
    docs = defaultdict(int)
    owner = {}
    for doc_id, text in rows:
        if doc_id is None:
            continue
        for key in {lower(x.strip(BLANKS)) for x in (text or "").split("\n")}:
            if len(key) >= 20:
                docs[key] += 1
                owner[key] = max(owner.get(key, doc_id), doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        gone = lambda x: doc_id is not None and docs.get(lower(x.strip(BLANKS)), 0) >= 3 and owner[lower(x.strip(BLANKS))] != doc_id
        kept = [x for x in lines if not gone(x)]
        out.append((doc_id, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def test_odd_rows_lose_the_lines_that_brute_force_drops(odd):
    got = line_dedup.drop_lines(odd).select("doc.doc_id", "kept_text", "n_lines", "n_dropped").collect()
    assert sorted(map(tuple, got), key=repr) == brute_lines([(r.doc_id, r.text) for r in odd.collect()])


def test_other_columns_pass(odd):
    assert line_dedup.drop_lines(odd).select("doc.*").columns == odd.columns


def test_empty_tables(none):
    assert line_dedup.drop_lines(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_levelled_runs_agree_with_one_aggregate(spark, batches):
    rng = random.Random(3)
    index = line_dedup.LevelledRuns(spark, 4)
    want = defaultdict(lambda: [0, -1])
    for _ in range(batches):
        batch = {(rng.randrange(40), rng.randrange(2)): (rng.randrange(1, 5), rng.randrange(100)) for _ in range(50)}
        for k, (n, owner) in batch.items():
            want[k] = [want[k][0] + n, max(want[k][1], owner)]
        index.add(spark.createDataFrame([(*k, *v) for k, v in batch.items()], "h1 long, h2 long, n long, owner long"))
        held = [(r.h1, r.h2) for _, name, _ in index.runs for r in spark.table(name).collect()]
        assert len(index.runs) <= 3 and sorted(held) == sorted(want)
    rows = index.finish().collect()
    assert len(rows) == len(want) and {(r.h1, r.h2): [r.n, r.owner] for r in rows} == dict(want)


def test_runs_are_merged_without_sorting(spark):
    index = line_dedup.LevelledRuns(spark, 4)
    for k in range(2):
        index.add(spark.range(100).selectExpr(f"id + {k} AS h1", "id AS h2", "1L AS n", "id AS owner"))
    with line_dedup.in_bucket_order(spark):
        plan = index.fresh(spark.table(index.runs[0][1]))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Sort [" not in plan and "Exchange" not in plan


def test_a_hot_id_is_dealt_to_many_tasks(spark):
    left = spark.range(2000).selectExpr("IF(id % 3 = 0, 5L, id) AS doc_id", "id AS place")
    right = left.where("doc_id % 2 = 1").groupBy("doc_id").agg(simhash.F.count("*").alias("n"), simhash.F.max("place").alias("keys"))
    got = sorted(map(tuple, common.salted_left_join(left, right, "doc_id", "n", 2000, slots=16).select("doc_id", "place", "keys").collect()), key=repr)
    most = {r.doc_id: r["keys"] for r in right.collect()}
    assert got == sorted([(r.doc_id, r.place, most.get(r.doc_id)) for r in left.collect()], key=repr)


def brute_fingerprint(text, width=3):
    words = [w for w in lower(text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, max_bits):
    """prints: (doc_id, fp). Component of each fingerprint."""
    fps = sorted({fp for _, fp in prints})
    parent = {fp: fp for fp in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= max_bits:
                parent[root(a)] = root(b)
    least = defaultdict(list)
    for doc_id, fp in prints:
        if doc_id is not None:
            least[root(fp)].append(doc_id)
    return {fp: min(least[root(fp)], default=None) for fp in fps}


def test_fingerprints_and_components_of_odd_rows(odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    prints = [(d, brute_fingerprint(t)) for d, t in rows]
    part = brute_components(prints, 2)
    got = simhash.near_duplicates(odd).select("doc_id", simhash.hex_of(simhash.F.col("fp")).alias("fp"), "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(d, f"{fp:016x}", part[fp]) for d, fp in prints], key=repr)


def test_query_on_documents_agrees_with_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in queries.documents(spark, sf).collect()]
    prints = [(d, brute_fingerprint(t)) for d, t in rows]
    part = brute_components(prints, 2)
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in queries.op4_simhash(spark, sf).collect()}
    assert got == {(d, f"{fp:016x}", part[fp]) for d, fp in prints}


@pytest.mark.parametrize("max_bits", [1, 2, 3])
def test_links_of_crowded_fingerprints(spark, max_bits):
    """Chains, a crowd around one centre and strangers: no link between different fingerprints is lost."""
    rng = random.Random(max_bits)
    fps, centre = {0, 1, 3, 7, (1 << 64) - 1}, rng.getrandbits(64)
    for _ in range(300):
        fp = centre
        for b in rng.sample(range(64), rng.randrange(6)):
            fp ^= 1 << b
        fps |= {fp, rng.getrandbits(64)}
    prints = [(i, fp) for i, fp in enumerate(sorted(fps))]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    classes = spark.createDataFrame([(signed(fp), i) for i, fp in prints], "fp long, rep long")
    labels = {r.a: r.b for r in simhash.components(simhash.links(classes, max_bits)).collect()}
    part = brute_components(prints, max_bits)
    assert [labels.get(i, i) for i, _ in prints] == [part[fp] for _, fp in prints]


def test_trie_splits_nodes_as_brute_force_does():
    rng = np.random.default_rng(5)
    for max_bits in range(4):
        for _ in range(20):
            rows = np.unique(np.stack([rng.integers(0, 3, 60), rng.integers(0, 1 << 9, 60)]), axis=1)
            group, value = rows[0], rows[1].astype(np.uint64)
            least = list(range(len(group)))
            for _ in range(len(group)):
                for i in range(len(group)):
                    for j in range(i):
                        if group[i] == group[j] and int(value[i] ^ value[j]).bit_count() <= max_bits:
                            least[i] = least[j] = min(least[i], least[j])
            assert simhash.trie_links(group, value, max_bits).tolist() == least


def test_masks_leave_no_pair_out():
    rng = random.Random(1)
    for bits in (1, 2, 3):
        masks = simhash.block_masks(bits)
        for _ in range(500):
            difference = sum(1 << b for b in rng.sample(range(64), bits))
            assert any(not difference & m for m in masks)


def test_digest_of_kept_text(spark, sf):
    rows = queries.op2_line_dedup(spark, sf).collect()
    docs = [(r.doc_id, r.text) for r in queries.documents(spark, sf).collect()]
    want = {(d, hashlib.sha256(t.encode()).hexdigest(), n, k) for d, t, n, k in brute_lines(docs)}
    assert {(r.doc_id, r.kept_sha256, r.n_lines, r.n_dropped) for r in rows} == want


def test_repeated_rows_are_one_document(spark):
    """Two documents of which one is stored twice aren't three; the lines of a document's rows add up."""
    line = "a line that stands in only two documents"
    rows = [(1, line), (2, line), (2, line)]
    two = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.n_dropped for r in line_dedup.drop_lines(two).select("n_dropped").collect()} == {0}
    three = spark.createDataFrame([*rows, (3, line)], "doc_id long, text string")
    assert sorted(map(tuple, line_dedup.drop_lines(three).select("doc.doc_id", "n_dropped").collect())) == [(1, 1), (2, 1), (2, 1), (3, 0)]
