"""Language, quality, rules, scores and mixing."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import langid, lm_score, mixing, quality_qda, quality_rules, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_odd_rows_have_a_language_or_none(odd, none, spark):
    sample = [("hello world this is text", "en"), ("bonjour le monde ceci est", "fr"), ("guten tag welt das ist", "de")] * 5
    models = langid.LanguageModels(sample)
    rows = langid.identify(odd, models).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 and r.lang_pred in ("en", "fr", "de", "und") for r in rows)
    assert {r.doc_id: r.lang_pred for r in rows}[4] == "und" and {r.doc_id: r.lang_pred for r in rows}[9] == "und"
    assert langid.identify(none, models).count() == 0
    assert {r.lang_pred for r in langid.identify(odd, langid.LanguageModels([])).collect()} == {"und"}
    assert langid.training_sample(none, F.lit(True)) == []


def test_kneser_ney_is_a_distribution_and_backs_off():
    words = Counter({"banana": 5, "bandana": 2, "cab": 3, "abacus": 1})
    model = langid.KneserNey(words, 3, alphabet=64)
    letters = sorted(set("".join(words)) | {langid.STOP})

    def p(context, c):
        s = langid.START + context + c
        codes = np.frombuffer(s.encode("utf-32-le"), np.uint32)
        place = np.arange(len(codes))
        return 2 ** float(model.scores(langid.hashes(codes, 3), place, np.array([len(codes) - 1]))[0])

    for context in ("", "b", "ba", "ban", "zz", "ca"):
        total = sum(p(context, c) for c in letters) + (64 - len(letters)) * p(context, "一")
        assert total == pytest.approx(1, abs=2e-3)
    assert p("ba", "n") > p("ba", "u") > p("ba", "z")


def brute_kneser_ney(words, order, alphabet):
    """Interpolated Kneser-Ney by its definition: probability of a character after a context, from counts alone."""
    texts = [langid.START + w + langid.STOP for w, n in words.items() for _ in range(n)]
    grams = [Counter(t[i + 1 - k : i + 1] for t in texts for i in range(1, len(t)) if i + 1 >= k) for k in range(order + 1)]
    seen = [Counter() for _ in range(order + 1)]
    for k in range(1, order + 1):
        for g in grams[k]:
            seen[k][g] = grams[k][g] if k == order or g[0] == langid.START else len({h for h in grams[k + 1] if h[1:] == g})

    def p(context, c):
        if context is None:
            return 1 / alphabet
        k = len(context) + 1
        own = {g: n for g, n in seen[k].items() if g[:-1] == context}
        lower = p(context[1:], c) if context else p(None, c)
        if not own:
            return lower
        once, twice = (sum(n == m for n in seen[k].values()) for m in (1, 2))
        d = once / (once + 2 * twice) if once and twice else 0.5
        total = sum(own.values())
        return max(own.get(context + c, 0) - d, 0) / total + min(1, d * len(own) / total) * lower

    return p


def test_models_are_those_of_the_definition():
    words = Counter({"banana": 5, "bandana": 2, "cab": 3, "abacus": 1, "a": 4, "ban": 1})
    for order in (1, 2, 3, 4):
        model, p = langid.KneserNey(words, order, alphabet=64), brute_kneser_ney(words, order, 64)
        for word in ("banana", "cabana", "zz", "a", "bac"):
            s = langid.START + word + langid.STOP
            codes = np.frombuffer(s.encode("utf-32-le"), np.uint32)
            got = model.scores(langid.hashes(codes, order), np.arange(len(codes)), np.arange(1, len(codes)))
            want = [math.log2(p(s[max(0, i + 1 - order) : i], s[i])) for i in range(1, len(s))]
            assert got == pytest.approx(want, abs=1e-4)


@pytest.mark.parametrize(("text", "words"), [("²", []), ("½ ³ ①", []), ("12 ٣ _ №", []), ("e\u0301te\u0301 x_y", ["e\u0301te\u0301", "x", "y"]), ("नमस्ते", ["नमस्ते"]), ("日本 straße", ["日本", "straße"]), ("\u0301a", ["a"])])
def test_words_are_letters_with_marks(text, words):
    assert langid.words_of(text) == words == langid.WORDS.findall(text)


def test_plain_words_are_those_of_the_categories():
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    rest = "".join(c for c in every if c not in langid.ODD)
    assert langid.PLAIN.findall(rest) == langid.WORDS.findall(rest) and langid.PLAIN.findall(every) != langid.WORDS.findall(every)


def test_texts_without_letters_are_undetermined(spark):
    models = langid.LanguageModels([("hello world this is text", "en"), ("bonjour le monde ceci est", "fr")] * 5)
    docs = spark.createDataFrame([(1, "²"), (2, "½ ³ ①"), (3, "42 !"), (4, None)], "doc_id long, text string")
    assert {(r.lang_pred, r.score) for r in langid.identify(docs, models).collect()} == {("und", 0.0)}


def test_samples_are_bounded_whatever_repeats(spark):
    few = spark.range(5000).selectExpr("id % 3 AS doc_id", "concat('some text ', id % 2500) AS text", "'en' AS lang")
    for most in (1, 40, 400):
        sample = langid.training_sample(few, F.lit(True), sample_docs=most)
        assert most // 2 <= len(sample) <= most and len(set(sample)) == len(sample)
    same = spark.range(3000).selectExpr("7L AS doc_id", "'one text' AS text", "'en' AS lang")
    assert langid.training_sample(same, F.lit(True)) == [("one text", "en")]
    labels = spark.createDataFrame([(7, 1), (8, 0)], "doc_id long, quality int")
    stats = quality_qda.document_statistics(same.unionByName(spark.createDataFrame([(8, "AA!! BB!!", "en")] * 20, same.schema)))
    model = quality_qda.fit(stats, labels, F.lit(True), calibration_rows=50)
    assert model.rows == {0: 20, 1: 3000}


def test_held_out_language_accuracy(spark, sf):
    rows = queries.op6_language_id(spark, sf).join(queries.documents(spark, sf).select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = queries.op7_quality_qda(spark, sf).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.quality == r.predicted for r in rows) >= 0.95 * len(rows)


def test_quality_of_odd_rows(odd, none, spark):
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (4, 0), (8, 0), (6, None), (None, 1)], "doc_id long, quality int")
    rows = quality_qda.learn_and_classify(odd, labels, F.lit(True)).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    alone = quality_qda.learn_and_classify(odd, labels.where("quality = 1"), F.lit(True)).collect()
    assert {r.score for r in alone} == {1.0}
    assert {r.score for r in quality_qda.learn_and_classify(odd, labels.where("false"), F.lit(True)).collect()} == {0.5}
    assert quality_qda.learn_and_classify(none, labels, F.lit(True)).count() == 0


def test_log_density_is_that_of_the_shrunk_gaussian():
    rng = np.random.default_rng(0)
    d = len(quality_qda.FEATURES)
    x, y = rng.normal(size=(200, d)), 2 * rng.normal(size=(150, d)) + 1
    model = quality_qda.QuadraticDiscriminant({k: (len(v), v.sum(0), v.T @ v) for k, v in ((1, x), (0, y))})
    mean, factor = model.factors[1]
    cov, z = factor @ factor.T, rng.normal(size=(5, d))
    off = z / model.unit - mean
    want = -0.5 * np.einsum("ni,ij,nj->n", off, np.linalg.inv(cov), off) - 0.5 * np.linalg.slogdet(cov)[1]
    assert model.log_density(z, 1) == pytest.approx(want)


def test_fit_agrees_with_moments_and_calibration_of_all_rows(spark, sf):
    docs, labels = queries.documents(spark, sf).select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    known = {r.doc_id: r.quality for r in labels.collect()}
    rows = [(r.doc_id, quality_qda.statistics(r.text or "")) for r in docs.collect() if r.doc_id in known]
    x, y = np.array([s for _, s in rows]), np.array([known[d] for d, _ in rows], float)
    model = quality_qda.fit(quality_qda.document_statistics(docs), labels, F.lit(True))
    within = sum(((x[y == k] - x[y == k].mean(0)) ** 2).sum(0) for k in (0, 1)) / len(x)
    unit, density = np.sqrt(np.maximum(within, quality_qda.FLOOR**2)), {}
    for k in (0, 1):
        z = x[y == k] / unit
        cov = np.cov(z.T, bias=True)
        cov = (1 - quality_qda.SHRINKAGE) * cov + (quality_qda.SHRINKAGE * np.trace(cov) / len(cov) + quality_qda.FLOOR) * np.eye(len(cov))
        off = x / unit - z.mean(0)
        density[k] = -0.5 * np.einsum("ni,ij,nj->n", off, np.linalg.inv(cov), off) - 0.5 * np.linalg.slogdet(cov)[1]
    margin = np.arcsinh((density[1] - density[0]) / 4)
    assert model.margin(x) == pytest.approx(margin, rel=1e-5, abs=1e-5)
    p = 1 / (1 + np.exp(-(model.slope * margin + model.shift)))
    assert [((y - p) * margin).sum() - 1e-3 * model.slope, (y - p).sum() - 1e-3 * model.shift] == pytest.approx([0, 0], abs=1e-3)
    assert model.score(x) == pytest.approx(p, abs=1e-5)


def brute_rules(text):
    words, lines = WORD.findall(text or ""), (text or "").split("\n")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n, inside = Counter(windows), set()
    for i, w in enumerate(windows):
        if n[w] > 1:
            inside |= set(range(i, i + 8))
    seen, dups = set(), 0
    for x in lines:
        if WORD.search(x):
            dups += x in seen
            seen.add(x)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dups, len(inside), len(words) < 20 or 100 * len(inside) > 30 * len(words)


def test_base_counts_of_odd_and_repetitive_rows(odd, spark, none):
    more = ["a b c d e f g h i " * 5, "x y\nx y\n \n \nx y", "one two three four five six seven eight nine ten. " * 2 + "other words here", "# * $ % & | < >", " ".join(map(str, range(40))) + " " + " ".join(map(str, range(5, 15)))]
    rows = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(more)], "doc_id long, text string"))
    got = quality_rules.judge(rows).select("doc.doc_id", "doc.text", "quality.*").collect()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_rules(r.text)
        assert not (r.base_failed and r.kept)
    assert quality_rules.judge(none).count() == 0


@pytest.mark.parametrize(("line", "stays"), [("This is a plain sentence with several words in it.", True), ("Home | News | Sport | About | Contact", False), ("Licensed under the Apache License, Version 2.0.", False), ("Menu", False), ("v1.2 menu", False), ("He said \"yes.\" ", True), ("Tous Droits Réservés à tous.", False), ("Hier steht die Datenschutzerklärung.", False), ("Reintroducing unlicensed underwear is fun.", True), ("WHAT!! A!! GREAT!! DEAL!!", False), ("to be or not to be or not to be or", False), ("many different words on one line that somebody wrote without any mark", True), ("Chapter one and the beginning", True), ("", True)])
def test_lines(spark, line, stays):
    clean = "The first sentence is long enough to stay here. " * 1 + "A second sentence follows it and also has quite some words."
    q = quality_rules.judge(spark.createDataFrame([(1, clean + "\n" + line)], "doc_id long, text string")).select("quality.*").first()
    assert q.kept and q.clean_text == (clean + "\n" + line if stays else clean)


def test_a_document_of_navigation_is_rejected(spark):
    text = "\n".join(["One | two | three | four | five | six | seven"] * 2 + ["This one sentence is fine."] + ["A | b | c | d | e | f | g | h"] * 2)
    q = quality_rules.judge(spark.createDataFrame([(1, text)], "doc_id long, text string")).select("quality.*").first()
    assert not q.kept


def brute_scores(texts):
    """(words, score) of each text under the counts of the others."""
    lower = lambda w: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
    docs = [[lower(w) for w in WORD.findall(t or "")] for t in texts]
    own = [Counter(tuple(d[i + 1 - k : i + 1]) for i in range(len(d)) for k in (1, 2, 3) if k <= i + 1) for d in docs]
    counts, total, out = sum(own, Counter()), sum(map(len, docs)), []
    for d, mine in zip(docs, own):
        left = lambda g: counts[g] - mine[g] if g else total - len(d)  # noqa: B023, E731
        s = 0.0
        for i in range(len(d)):
            for k in range(min(3, i + 1), 0, -1):
                gram = tuple(d[i + 1 - k : i + 1])
                if left(gram) > 0:
                    s += math.log(left(gram) / left(gram[:-1]))
                    break
                s += math.log(0.4) if k > 1 else -math.log(left(()) + 1)
        out.append((len(d), s))
    return out


def test_stupid_backoff_of_odd_rows(odd, none):
    rows = lm_score.scores(odd).collect()
    want, got = sorted(brute_scores([r.text for r in odd.collect()])), sorted((r.n_words, r.score) for r in rows)
    assert [g[0] for g in got] == [w[0] for w in want] and [g[1] for g in got] == pytest.approx([w[1] for w in want])
    assert all((r.mean_score is None) == (r.n_words == 0) for r in rows)
    assert lm_score.scores(none).count() == 0


@pytest.mark.parametrize("block_bytes", [200, 3000, 1 << 20])
def test_scores_of_many_blocks_and_parts(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(lm_score, "PART_GRAMS", 300)
    rng = np.random.default_rng(block_bytes)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.3, n) % 50) for n in rng.integers(0, 60, 200)] + ["w1 w2 w3 w4"] * 50 + ["The the THE " + "w" * 100]
    rows = lm_score.scores(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"), block_bytes=block_bytes).collect()
    want = brute_scores(texts)
    assert len(rows) == len(texts) and all((r.n_words, r.score) == (want[r.doc_id][0], pytest.approx(want[r.doc_id][1])) for r in rows)


def test_a_document_alone_and_one_that_occurs_twice(spark):
    one = lm_score.scores(spark.createDataFrame([(1, "some words here")], "doc_id long, text string")).first()
    assert one.score == pytest.approx(3 * math.log(0.4))
    texts = ["a text that is stored two times"] * 2 + ["another one that occurs only once"]
    rows = {r.doc_id: r.mean_score for r in lm_score.scores(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect()}
    assert rows[0] == rows[1] > rows[2] + 1


def test_mix_of_odd_rows(odd, none):
    rows = mixing.mixing_plan(odd).select("doc.doc_id", "doc.source", "size", "source_size", "target", "taken").collect()
    assert len(rows) == odd.count() and all(r.taken <= 2 * r.size and r.target <= 2 * r.source_size for r in rows)
    sizes = {}
    for r in odd.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(WORD.findall(r.text or ""))
    assert {r.source: r.source_size for r in rows} == sizes
    assert sum({r.source: r.target for r in rows}.values()) == pytest.approx(min(1.5 * sum(sizes.values()), 2 * sum(sizes.values())))
    assert mixing.mix(odd).columns == odd.columns and mixing.mixing_plan(none).count() == 0


def test_targets_fill_caps_and_share_the_rest(spark):
    sizes = {"a": 10, "b": 1000, "c": 1000, None: 50}
    table = spark.createDataFrame([*sizes.items()], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(table).collect()}
    total, weight, full = 1.5 * sum(sizes.values()), {"a": 3, "b": 1, "c": 2, None: 3}, set()
    while True:
        level = (total - sum(2 * sizes[s] for s in full)) / sum(w for s, w in weight.items() if s not in full)
        more = {s for s in sizes if s not in full and weight[s] * level > 2 * sizes[s]}
        if not more:
            break
        full |= more
    assert got == pytest.approx({s: 2 * sizes[s] if s in full else weight[s] * level for s in sizes})


def test_sources_are_numbered_by_code_point(spark):
    names = [f"{c}{i}" for i in range(40) for c in "zAaé"] + [None, ""]
    rows = mixing.numbered_sources(spark.createDataFrame([(n, 1) for n in names], "source string, source_size long")).collect()
    assert {r.source: r.number for r in rows} == {n: i for i, n in enumerate([*sorted(n for n in names if n is not None), None])}


def test_mix_reruns_agree_and_meet_targets(spark, sf):
    one, two = (sorted(map(tuple, queries.op10_mixing(spark, sf).collect())) for _ in range(2))
    assert one == two


def test_every_language_is_learned(spark):
    """More labels than 256, each with its own letters, and one whose documents are all long."""
    rows = [(10 * k + i, f"{chr(0x4E00 + 2 * k)}{chr(0x4E01 + 2 * k)} " * (9 + i), f"l{k:03}") for k in range(300) for i in range(5)]
    rows += [(9000 + i, "habari ya dunia " * 2000, "long") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = langid.training_sample(docs, F.lit(True))
    assert {lang for _, lang in sample} == {r[2] for r in rows} and max(len(t) for t, _ in sample) <= langid.SAMPLE_CHARS
    found = langid.identify(docs, langid.LanguageModels(sample)).join(docs, "doc_id").collect()
    assert len(found) == len(rows) and all(r.lang_pred == r.lang for r in found)
    fewer = langid.training_sample(docs, F.lit(True), sample_docs=1)
    assert {lang for _, lang in fewer} == {r[2] for r in rows} and len(fewer) < len(sample)
