"""Near copies against brute force over all pairs."""

import random

import numpy as np

import corpus_pipeline
from tests.llm.test_dedup import lower
from tidemark.llm import mixing, near_copies


def brute_set(text, width=5):
    words = lower(text or "").split()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} or {tuple(words)}


def near(x, y):
    return 9 * len(x & y) >= 4 * (len(x) + len(y))


def holds(before, after):
    """No two rows that stay are near copies; each that goes is linked to one before it that stays."""
    sets = {d: brute_set(t) for d, t in before}
    stay = sorted(after)
    assert all(not near(sets[a], sets[b]) for i, a in enumerate(stay) for b in stay[:i])
    for d in sets.keys() - set(stay):
        reached, todo = {d}, [d]
        while todo:
            x = todo.pop()
            new = {y for y in sets if y < x and y not in reached and near(sets[x], sets[y])}
            reached |= new
            todo += new
        assert reached & set(stay)


def test_no_near_copy_is_mixed(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source")
    fewer = near_copies.without_copies(docs)
    holds([(r.doc_id, r.text) for r in docs.collect()], [r.doc_id for r in fewer.collect()])
    single = corpus_pipeline.simhash_stage(spark, docs, sf)
    mixed = {r.doc_id for r in corpus_pipeline.mixing_stage(spark, single, sf).collect()}
    assert {145, 177} & {r.doc_id for r in mixing.mix(docs).collect()} and mixed and not {145, 177} & mixed


def test_crowded_groups_are_paired_whole(spark):
    """Copies edited more and more, a passage in strangers, and exact copies, with groups far beyond the first pivots."""
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(10**6)}"
    base, passage = [word() for _ in range(60)], [word() for _ in range(70)]
    rows = []
    for i in range(60):
        text = base.copy()
        for _ in range(rng.randrange(4)):
            text[rng.randrange(60)] = word()
        rows.append(" ".join(text))
    rows += [" ".join(passage + [word() for _ in range(rng.randrange(5, 30))]) for _ in range(50)] + [" ".join(word() for _ in range(rng.randrange(12))) for _ in range(20)]
    rng.shuffle(rows)
    before = [*enumerate(rows + rows[:9])]
    docs = spark.createDataFrame(before, "doc_id long, text string")
    for pivots, max_bits in ((1, 1), (8, 3)):
        holds(before, [r.doc_id for r in near_copies.without_copies(docs, pivots=pivots, max_bits=max_bits).collect()])


def test_strangers_are_dealt_only_by_what_they_share(spark, monkeypatch):
    """Rows that share a passage, each with more than a fifth of its own, have no groups; near copies among them have."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**6)}"
    passage = [word() for _ in range(40)]
    texts = [" ".join(passage + [word() for _ in range(40)]) for _ in range(60)]
    texts += [texts[3] + " once more", texts[9] + " again"]
    dealt, paired = [], near_copies.paired
    monkeypatch.setattr(near_copies, "paired", lambda entries, pivots: dealt.append({r.row_id for r in entries.select("row_id").distinct().collect()}) or paired(entries, pivots))
    before = [*enumerate(texts)]
    # No bits for the trie: the set join finds the copies.
    holds(before, left := [r.doc_id for r in near_copies.without_copies(spark.createDataFrame(before, "doc_id long, text string"), max_bits=0).collect()])
    assert len(left) == 60 and max(map(len, dealt)) <= 4


def test_rarest_shared_shingles_come_first_whatever_the_blocks(spark):
    """Blocks and ranges of one row and of many, rows more than a byte apart, texts of one shingle: each near pair has a group, rare ones first."""
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(4)}" for _ in range(rng.randrange(1, 12))) for _ in range(300)]
    texts += [" ".join(f"v{rng.randrange(10**6)}" for _ in range(200)) for _ in range(600)]
    texts += [t + " x" for t in texts[300::150]]
    sets = [brute_set(t) for t in texts]
    rows = spark.createDataFrame([*enumerate(texts)], "row_id long, text string").repartition(3, "row_id")
    groups = []
    for block, total in ((1, 1), (5_000, 1), (1 << 20, 1 << 26)):
        keys = {}
        for r in near_copies.first_shared(rows, total, block=block).collect():
            keys.setdefault(r.row_id, set()).add(r.key)
        groups.append({i: len(k) for i, k in keys.items()})
        assert all(keys.get(a, set()) & keys.get(b, set()) for a in range(len(sets)) for b in range(a) if near(sets[a], sets[b]))
        assert not any(i in keys for i, t in enumerate(texts) if 300 <= i < 900 and t + " x" not in texts)
    assert groups[0] == groups[1]


def test_pairs_of_a_crowded_group_are_not_all_made(spark, monkeypatch):
    """Edits of one text, each with a few more than a ninth of shingles of its own: a group of near misses makes few pairs, and of its near copies none is missed."""
    rng = random.Random(7)
    base, texts = [f"w{i}" for i in range(120)], []
    for i in range(80):
        text = base.copy()
        for at in rng.sample(range(0, 120, 6), 4 if i % 20 else 1):
            text[at] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(text))
    made, paired = [], near_copies.paired
    monkeypatch.setattr(near_copies, "paired", lambda entries, pivots: (found := paired(entries, pivots)) and made.append(found.where("b IS NOT NULL").count()) or found)
    before = [*enumerate(texts)]
    holds(before, [r.doc_id for r in near_copies.without_copies(spark.createDataFrame(before, "doc_id long, text string"), max_bits=0).collect()])
    assert sum(made) <= 8 * len(texts)


def test_folded_parities_differ_in_no_more_slots_than_sets_in_shingles():
    rng = np.random.default_rng(8)
    for n in (0, 1, 127, 128, 129, 3000):
        a = np.unique(rng.integers(0, 1 << 64, n, np.uint64))
        b = np.unique(np.r_[a[: len(a) // 2], rng.integers(0, 1 << 64, n // 3, np.uint64)])
        odd = near_copies.parities(a), near_copies.parities(b)
        assert near_copies.slots_that_differ(*odd) == near_copies.slots_that_differ(*odd[::-1]) <= len(np.setxor1d(a, b))
        assert near_copies.slots_that_differ(odd[0], odd[0]) == 0


def test_rows_are_apart(odd, none):
    rows = near_copies.without_copies(odd)
    assert rows.columns == odd.columns and sorted(((r.doc_id, r.text) for r in rows.collect()), key=repr) == sorted({(r.doc_id, r.text) for r in odd.collect() if r.doc_id not in (None, 5, 6, 9)}, key=repr)
    assert near_copies.without_copies(none).count() == 0
