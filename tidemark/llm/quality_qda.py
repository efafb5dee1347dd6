"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Statistics of each whole text are transformed to be roughly symmetric. Per label, the count, sum and sum of products of
the statistics come from all rows that may be learned from, in one aggregate with map-side combining; nothing else
reaches the driver but a sample of CALIBRATION_ROWS rows at most that calibrates the score, taken by a hash of id and statistics. Covariances shrink towards their
mean variance; the Cholesky factors of both are cached in the model. The score is a logistic function of the difference of the
two Mahalanobis log-densities, fitted on the sample.

Defined results: a null text is scored as an empty one; rows whose label is null aren't learned from; with labels of one class or
none every score is that class's share (0.5 without labels); rows with equal ids are scored apart; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import sys
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_key_join, slices, written

FEATURES = ("words", "word_length", "distinct", "top_word", "same_next", "upper", "digits", "symbols", "shouts", "punctuation", "separators", "line_words", "repeated_lines", "open_lines", "density")
SHRINKAGE = 0.1
FLOOR = 1e-3
CALIBRATION_ROWS = 20_000

#: Classes of characters: letters, capitals, digits, blanks, sentence marks, other punctuation, symbols.
LETTER, UPPER, DIGIT, BLANK, MARK, POINT, SYMBOL = range(1, 8)
_classes: np.ndarray | None = None


def char_classes() -> np.ndarray:
    global _classes
    if _classes is None:
        kinds = {"Lu": UPPER, "Lt": UPPER, "Nd": DIGIT, "Nl": DIGIT, "No": DIGIT, "Zs": BLANK, "Zl": BLANK, "Zp": BLANK, "Cc": BLANK}
        table = np.zeros(sys.maxunicode + 1, np.uint8)
        for code in range(sys.maxunicode + 1):
            kind = unicodedata.category(chr(code))
            table[code] = kinds.get(kind) or (LETTER if kind[0] in "LM" else POINT if kind[0] == "P" else SYMBOL if kind[0] == "S" else 0)
        for c in "#*%&@\\_":
            table[ord(c)] = SYMBOL
        for c in "!?":
            table[ord(c)] = MARK
        _classes = table
    return _classes


def statistics(text: str) -> list[float]:
    """The transformed statistics of a whole text, in the order of FEATURES."""
    words = text.encode().split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    counts = Counter(words)
    kinds = np.bincount(char_classes()[np.frombuffer(text.encode("utf-32-le"), np.uint32)], minlength=8).tolist()
    letters = kinds[LETTER] + kinds[UPPER]
    chars = sum(kinds) - kinds[BLANK]
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    same = sum(map(bytes.__eq__, words, words[1:]))
    ended = sum(x.rstrip()[-1] in ".!?…。！？" for x in lines)
    separators = counts[b"|"] + counts["»".encode()] + counts[b">"]
    raw = text.encode()
    rate = lambda x, k=1.0: float(np.log1p(k * x))
    return [
        float(np.log1p(n)) / 4, rate(chars / n), len(counts) / n ** 0.9, rate(counts.most_common(1)[0][1] / n, 10), rate(same / n, 20), rate(kinds[UPPER] / max(letters, 1), 10), rate(kinds[DIGIT] / max(chars, 1), 20),
        rate(kinds[SYMBOL] / n, 5), rate(kinds[MARK] / n, 5), rate(kinds[POINT] / n, 3), rate(separators / n, 10), rate(n / max(len(lines), 1)) / 4, rate((len(lines) - len(set(lines))) / max(len(lines), 1), 5),
        1 - ended / max(len(lines), 1), len(zlib.compress(raw, 1)) / (len(raw) + 60),
    ]


def document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, x array<double>) of each row."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [statistics(x.as_py() or "") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64()))], names=["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(measured, "doc_id long, x array<double>")


class QuadraticDiscriminant:
    """Two Gaussian classes with shrunk covariances; scores from cached Cholesky factors."""

    def __init__(self, moments: dict[int, tuple[int, np.ndarray, np.ndarray]], shrinkage: float = SHRINKAGE):
        """moments: label -> (rows, sum of x, sum of the products of x)."""
        self.slope, self.shift = 1.0, 0.0
        self.rows = {k: moments[k][0] if k in moments else 0 for k in (0, 1)}
        self.factors = {}
        d = len(FEATURES)
        means = {k: m[1] / m[0] for k, m in moments.items()}
        within = sum((m[2] - m[0] * np.outer(means[k], means[k]) for k, m in moments.items()), np.zeros((d, d)))
        self.unit = np.sqrt(np.maximum(np.diag(within) / max(1, sum(self.rows.values())), FLOOR**2))
        for k, (n, _, products) in moments.items():
            cov = (products / n - np.outer(means[k], means[k])) / np.outer(self.unit, self.unit)
            cov = (1 - shrinkage) * cov + (shrinkage * np.trace(cov) / d + FLOOR) * np.eye(d)
            self.factors[k] = (means[k] / self.unit, np.linalg.cholesky(cov))

    def log_density(self, x: np.ndarray, label: int) -> np.ndarray:
        mean, factor = self.factors[label]
        z = (x / self.unit - mean).T
        for i in range(len(z)):  # forward substitution, all rows at once
            for j in range(i):
                z[i] -= factor[i, j] * z[j]
            z[i] /= factor[i, i]
        return -0.5 * (z * z).sum(axis=0) - np.log(np.diag(factor)).sum()

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-density of label 1 less that of label 0, compressed so that far points don't outweigh all others."""
        difference = self.log_density(x, 1) - self.log_density(x, 0)
        return np.arcsinh(difference / 4)

    def calibrate(self, x: np.ndarray, labels: np.ndarray, rounds: int = 50) -> None:
        """Logistic regression of the labels on the margin, by Newton steps with a small ridge."""
        if len(self.factors) < 2 or len(set(labels.tolist())) < 2:
            return
        m, weights = self.margin(x), np.array([1.0, 0.0])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(weights[0] * m + weights[1], -30, 30)))
            error, spread = labels - p, p * (1 - p)
            gradient = np.array([(error * m).sum(), error.sum()]) - 1e-3 * weights
            cross = (spread * m).sum()
            hessian = np.array([[(spread * m * m).sum(), cross], [cross, spread.sum()]]) + 1e-3 * np.eye(2)
            step = np.linalg.solve(hessian, gradient)
            weights = weights + np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-8:
                break
        if weights[0] > 0:
            self.slope, self.shift = weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if len(self.factors) < 2:
            return np.full(len(x), self.rows[1] / sum(self.rows.values()) if sum(self.rows.values()) else 0.5)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.shift, -30, 30)))


def fit(stats: DataFrame, labels: DataFrame, learn: Column, calibration_rows: int = CALIBRATION_ROWS) -> QuadraticDiscriminant:
    """stats (doc_id, x), labels (doc_id, quality); learn says which rows may be learned from."""
    d = len(FEATURES)
    known = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    own = stats.where(learn & F.col("doc_id").isNotNull())
    known = known.join(own.groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id")
    rows = hot_key_join(own, known, ["doc_id"], "n", own.count())
    sums = [F.sum(F.get("x", F.lit(i))).alias(f"s{i}") for i in range(d)]
    products = [F.sum(F.get("x", F.lit(i)) * F.get("x", F.lit(j))).alias(f"p{i}_{j}") for i in range(d) for j in range(i, d)]
    moments = {}
    for r in rows.groupBy("quality").agg(F.count("*").alias("n"), *sums, *products).collect():
        second = np.array([[r[f"p{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)])
        moments[r.quality] = (r.n, np.array([r[f"s{i}"] for i in range(d)]), second)
    model = QuadraticDiscriminant(moments)
    total = sum(model.rows.values())
    draw = F.pmod(F.xxhash64("doc_id", "x"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    likely = rows.select("x", "quality", draw.alias("draw")).where(F.col("draw") < F.lit(1.5 * calibration_rows / max(total, 1)))
    sample = likely.orderBy("draw", "quality").limit(calibration_rows).collect() if total else []
    if sample:
        model.calibrate(np.array([r.x for r in sample]), np.array([r.quality for r in sample], float))
    return model


def classify(stats: DataFrame, model: QuadraticDiscriminant) -> DataFrame:
    """(doc_id, score): higher means label 1 is likelier."""
    shared = stats.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.asarray(batch.column(1).flatten()).reshape(-1, len(FEATURES))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(x))], names=["doc_id", "score"])

    return stats.mapInArrow(scored, "doc_id long, score double")


def learn_and_classify(docs: DataFrame, labels: DataFrame, learn: Column) -> DataFrame:
    stats = written(document_statistics(docs), "statistics")
    return classify(stats, fit(stats, labels, learn))
