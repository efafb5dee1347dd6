"""Language identification by interpolated Kneser-Ney character models.

Each language has a model of the characters of its words, with both word ends, in orders 1 to ORDER. Discounts are
n1 / (n1 + 2 n2) per order; lower orders count distinct left neighbours. Probabilities of the n-grams seen and the weights
of their contexts are kept in arrays sorted by hash and found by bisection. A text's language is that of least
cross-entropy per event (a character or a word end). A fifth of the sample is left out of the counts and calibrates
the scale of the scores and, for each language, the cross-entropy beyond which a text is rejected as none of the languages.

A word is a letter (Unicode category L) and the letters and marks (M) that follow; digits, numerals and signs are no letters.

The sample is bounded: at most SAMPLE_DOCS different texts a language, taken by a hash of the text, and of longer ones an excerpt of SAMPLE_CHARS
characters at a place drawn by another hash. Every language that occurs with a letter is learned; where there are many, each has fewer and shorter excerpts
(TOTAL_DOCS and TOTAL_CHARS, but LEAST_DOCS and LEAST_CHARS each), so that the models are fitted on the driver. Every text is predicted whole.

Defined results: und with score 0 if a text is null or has no letter, or if no language could be learned;
rows with equal ids are predicted apart; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, SLICE_ROWS, slices, written

ORDER = 4
SAMPLE_DOCS = 400
SAMPLE_CHARS = 20_000
TOTAL_DOCS, TOTAL_CHARS = 100_000, 40_000_000
LEAST_DOCS, LEAST_CHARS = 5, 200


def of_categories(kinds: str) -> str:
    """The characters whose Unicode category begins with one of kinds, as ranges of a character class."""
    own = np.array([unicodedata.category(chr(c))[0] in kinds for c in range(sys.maxunicode + 1)])
    edges = np.flatnonzero(np.diff(own, prepend=False, append=False)).tolist()
    return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in zip(edges[::2], edges[1::2]))


WORDS = re.compile(f"[{of_categories('L')}][{of_categories('LM')}]*")
#: Finds the same words, and faster, where no mark and no numeral but decimal digits occurs.
PLAIN = re.compile(r"[^\W\d_]+")
ODD = frozenset(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c)[0] == "M" or c.isnumeric() and unicodedata.category(c)[0] != "L" and not c.isdecimal())


def words_of(text: str) -> list[str]:
    return (PLAIN if text.isascii() or ODD.isdisjoint(set(text)) else WORDS).findall(text)
START, STOP = "\x02", "\x03"
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
KNOWN_WORDS = 300_000
#: The most scores of kept words, and of the documents of one step (about), over all languages.
KNOWN_SCORES, STEP_SCORES = 80_000_000, 1 << 16


def hashes(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """For n from 0 to order, the hash of the n codes that end at each place."""
    out = [np.zeros(len(codes), np.uint64)]
    for _ in range(order):
        before = np.r_[np.zeros(1, np.uint64), out[-1][:-1]]
        x = (before ^ (codes.astype(np.uint64) + np.uint64(1))) * MULTIPLIER
        out.append(x ^ (x >> np.uint64(29)))
    return out


def gram_hash(gram: str) -> int:
    codes = np.frombuffer(gram.encode("utf-32-le"), np.uint32)
    return int(hashes(codes, len(gram))[-1][-1]) if gram else 0


class SortedHashes:
    """Values by hash, found by bisection."""

    def __init__(self, grams: list[str], values: list[float]):
        keys = np.array([gram_hash(g) for g in grams], np.uint64)
        order = np.argsort(keys)
        self.keys, self.values = keys[order], np.array(values, np.float32)[order]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.float32)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.keys[at] == keys, self.values[at]


class KneserNey:
    """log2 probabilities of characters after up to order - 1 others of their word."""

    def __init__(self, words: dict[str, int], order: int = ORDER, alphabet: int = 1 << 12):
        self.order = order
        raw: list[dict[str, float]] = [defaultdict(float) for _ in range(order + 1)]
        for word, n in words.items():
            s = START + word + STOP
            for i in range(1, len(s)):
                for k in range(1, min(order, i + 1) + 1):
                    raw[k][s[i + 1 - k : i + 1]] += n
        counts = [{} for _ in range(order + 1)]
        counts[order] = dict(raw[order])
        for k in range(order - 1, 0, -1):
            lefts = Counter(g[1:] for g in raw[k + 1])
            counts[k] = {g: (n if g[0] == START else lefts[g]) for g, n in raw[k].items()}
        self.floor = -float(np.log2(alphabet))
        lower: dict[str, float] = {}
        self.grams, self.contexts = [None], []
        for k in range(1, order + 1):
            n1, n2 = sum(v == 1 for v in counts[k].values()), sum(v == 2 for v in counts[k].values())
            discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            total, kinds = defaultdict(float), Counter()
            for g, v in counts[k].items():
                total[g[:-1]] += v
                kinds[g[:-1]] += 1
            rest = {h: min(1.0, discount * kinds[h] / total[h]) for h in total}
            p = {g: max(v - discount, 0) / total[g[:-1]] + rest[g[:-1]] * (lower[g[1:]] if k > 1 else 2.0**self.floor) for g, v in counts[k].items()}
            self.grams.append(SortedHashes([*p], [float(np.log2(x)) for x in p.values()]))
            self.contexts.append(SortedHashes([*rest], [float(np.log2(max(x, 1e-9))) for x in rest.values()]))
            lower = p

    def scores(self, hashed: list[np.ndarray], place: np.ndarray, events: np.ndarray) -> np.ndarray:
        """log2 p at the events; place: how many codes of its word come before each code."""
        out, todo = np.zeros(len(events)), np.arange(len(events))
        for k in range(self.order, 0, -1):
            long = place[events[todo]] >= k - 1
            tried = todo[long]
            found, value = self.grams[k].find(hashed[k][events[tried]])
            out[tried[found]] += value[found]
            missed = tried[~found]
            known, weight = self.contexts[k - 1].find(hashed[k - 1][events[missed] - 1] if k > 1 else np.zeros(len(missed), np.uint64))
            if k == 1 and len(self.contexts[0].values):
                known, weight = np.ones(len(missed), bool), np.full(len(missed), self.contexts[0].values[0])
            out[missed[known]] += weight[known]
            todo = np.r_[todo[~long], missed]
        out[todo] += self.floor
        return out


class LanguageModels:
    """Models of all languages, with the calibration of scores and rejection."""

    def __init__(self, sample: list[tuple[str, str]], order: int = ORDER):
        """sample: (text, lang); every fifth of a language calibrates."""
        self.order, self.known, self.table = order, {}, np.zeros((0, 0), np.float32)
        by: dict[str, list[Counter]] = defaultdict(list)
        for text, lang in sample:
            if words := Counter(words_of(text.lower())):
                by[lang].append(words)
        self.langs = sorted(by)
        fit = {lang: docs if len(docs) < 5 else [d for i, d in enumerate(docs) if i % 5] for lang, docs in by.items()}
        self.models = [KneserNey(sum(fit[lang], Counter()), order) for lang in self.langs]
        self.scale, self.limits = 10.0, np.full(len(self.langs), np.inf)
        if self.langs:
            self._calibrate({lang: docs[::5] for lang, docs in by.items()})

    def _calibrate(self, held: dict[str, list[Counter]]) -> None:
        entropies = [(k, self.entropies(d)) for k, lang in enumerate(self.langs) for d in held[lang]]
        truth, h = np.array([k for k, _ in entropies]), np.array([x for _, x in entropies])
        loss = lambda s: -np.mean(np.log(np.maximum(softmax(-s * h)[np.arange(len(truth)), truth], 1e-12)))
        self.scale = min((1.0, 2.0, 4.0, 8.0, 16.0, 32.0), key=loss)
        for k in range(len(self.langs)):
            own = h[truth == k, k]
            self.limits[k] = 1.15 * np.quantile(own, 0.995) if len(own) >= 5 else np.inf

    def word_scores(self, words: list[str]) -> np.ndarray:
        """log2 p of each word in each language, its end included."""
        text = "".join(START + w + STOP for w in words)
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        sizes = np.array([len(w) + 2 for w in words])
        starts = np.r_[0, np.cumsum(sizes)[:-1]]
        place = np.arange(len(codes)) - np.repeat(starts, sizes)
        events, hashed = np.flatnonzero(place), hashes(codes, self.order)
        firsts = starts - np.arange(len(words))
        return np.stack([np.add.reduceat(m.scores(hashed, place, events), firsts) for m in self.models], axis=1).astype(np.float32)

    def entropies(self, words: dict[str, int]) -> np.ndarray:
        return self.batch_entropies([words])[0]

    def batch_entropies(self, docs: list[dict[str, int]]) -> np.ndarray:
        """Cross-entropy per event of each document, which has a word at least, in each language. Up to KNOWN_WORDS words and KNOWN_SCORES scores are kept."""
        new = [*{w for d in docs for w in d if w not in self.known}]
        if new:
            base = len(self.table) if len(self.table) else 0
            scores = self.word_scores(new)
            self.table = np.concatenate([self.table, scores]) if base else scores
            self.known.update(zip(new, range(base, base + len(new))))
        out = np.empty((len(docs), len(self.langs)))
        for i, d in enumerate(docs):
            at, n = np.fromiter(map(self.known.__getitem__, d), np.int64, len(d)), np.fromiter(d.values(), float, len(d))
            events = sum((len(w) + 1) * k for w, k in d.items())
            out[i] = -(n[:, None] * self.table[at]).sum(axis=0) / events
        if len(self.known) > min(KNOWN_WORDS, KNOWN_SCORES // len(self.langs)):
            self.known, self.table = {}, self.table[:0]
        return out


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def training_sample(docs: DataFrame, learn: Column, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> list[tuple[str, str]]:
    """(text, lang) of sample_docs excerpts a language at most, one at least, among the rows that `learn` allows.

    Equal texts of a language share a draw and count once, so that copies don't crowd the others out.
    """
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    draw = F.pmod(F.xxhash64("text", F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = rows.select("lang", "text", draw.alias("draw"))
    langs = written(drawn.groupBy("lang").agg(F.count("*").alias("of"), F.min("draw").alias("least")), "languages")
    n = max(1, langs.count())
    most = min(sample_docs, max(LEAST_DOCS, TOTAL_DOCS // n))
    chars = min(sample_chars, max(LEAST_CHARS, TOTAL_CHARS // (n * most)))
    place = F.pmod(F.xxhash64("text", F.lit("place")), F.greatest(F.lit(1), F.char_length("text") - chars + 1))
    excerpt = F.substr("text", (place + 1).cast("int"), F.lit(chars)).alias("excerpt")
    taken = drawn.join(F.broadcast(langs), "lang") if n <= BROADCAST_ROWS else drawn.join(langs, "lang")
    taken = taken.where((F.col("draw") < F.lit(2.0 * most) / F.col("of")) | (F.col("draw") == F.col("least"))).select("lang", "draw", excerpt).distinct()
    first = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "excerpt")) <= most
    return [(r.excerpt, r.lang) for r in taken.withColumn("first", first).where("first").orderBy("lang", "draw", "excerpt").collect()]


def identify(docs: DataFrame, models: LanguageModels) -> DataFrame:
    """(doc_id, lang_pred, score, cross_entropy, rejected) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(models)
    schema = "doc_id long, lang_pred string, score double, cross_entropy double, rejected boolean"

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in slices(batches, max(1, min(SLICE_ROWS, STEP_SCORES // max(1, len(own.langs))))):
            found = [Counter(words_of((x.as_py() or "").lower())) for x in batch.column(1)]
            some = [i for i, d in enumerate(found) if d] if own.langs else []
            pred, score, entropy, rejected = ["und"] * len(found), [0.0] * len(found), [None] * len(found), [True] * len(found)
            if some:
                h = own.batch_entropies([found[i] for i in some])
                sure = softmax(-own.scale * h)
                for i, row, p in zip(some, h, sure):
                    k = int(np.argmin(row))
                    pred[i], score[i], entropy[i], rejected[i] = own.langs[k], float(p[k]), float(row[k]), bool(row[k] > own.limits[k])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred), pa.array(score, pa.float64()), pa.array(entropy, pa.float64()), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "cross_entropy", "rejected"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(predict, schema)
