"""Operator 8: quality by Bradley-Terry pairwise ranking.

Texts are described by shares and ratios of characters, words and lines. A preference pair is a text of label 1 over one
of label 0; the logistic loss on the difference of their features, over all such pairs of all labelled rows, gives the
weights of a ranking score. The threshold is a quantile of the labelled rows' scores: the one with as large a share of
texts below it as have label 0, moved between the neighbouring scores. The score maps the distance from the threshold to
(0, 1), so that 0.5 is the threshold.

Nothing is made for a pair: rows are summed by label and narrow bin of their score, and the pairs of bins, each with the
means and covariances of its rows, stand for the pairs of rows. So a round is one sum over the rows, and at most 2 x ``BINS`` rows reach
the driver. The quantile is found exactly, by counts in bins that narrow down to two neighbours.

Null and empty texts have features of zero words and are scored like others. Without both labels every score is 0.5.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, crc_mod, map_text

#: Bins of a label's scores, at most and for a unit of the score; standardised features are held within +-``CLIP``.
BINS, FINE, CLIP = 1024, 16, 6.0
#: Rounds of the fit, the step that ends it, and the weight of the squared weights.
ROUNDS, STEP, RIDGE = 60, 1e-4, 1e-3
LETTERS = re.compile(r"[^\W\d_]+")
SYMBOLS = re.compile(r"[#$%&*@^~|<>{}\\/=+_]")
SHOUTS = re.compile(r"[!?]")
NAMES = ("letters", "capitals", "shouted words", "digits", "symbols", "bars", "shouts", "stops", "same again", "rare words", "commonest word", "commonest line", "word length", "words", "words a line", "spaces")


def features(text: str | None) -> list[float]:
    text = text or ""
    words = text.split()
    plain = LETTERS.findall(text)
    n, w, p = max(1, len(text)), max(1, len(words)), max(1, len(plain))
    letters = sum(map(len, plain))
    lines = text.split("\n")
    common = Counter(words).most_common(1)[0][1] if words else 0
    line, times = Counter(lines).most_common(1)[0]
    return [
        letters / n,
        sum(map(str.isupper, "".join(plain))) / max(1, letters) if letters < 50_000 else sum(1 for x in "".join(plain) if x.isupper()) / letters,
        sum(1 for x in plain if len(x) > 1 and x.isupper()) / p,
        min(1.0, 10 * sum(map(text.count, "0123456789")) / n),
        min(1.0, 5 * len(SYMBOLS.findall(text)) / n),
        min(1.0, 5 * text.count("|") / w),
        min(1.0, 5 * len(SHOUTS.findall(text)) / w),
        min(1.0, 5 * (text.count(".") + text.count(",")) / w),
        sum(1 for a, b in zip(words, words[1:], strict=False) if a == b) / w,
        len(set(words)) / w**0.8,
        common / w,
        (times / len(lines) if times > 1 else 0.0) * (len(line) > 0),
        min(3.0, letters / p / 5),
        np.log1p(len(words)) / 10,
        min(3.0, len(words) / len(lines) / 100),
        min(1.0, 3 * text.count(" ") / n),
    ]


@dataclass
class Ranking:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    threshold: float
    scale: float

    def rank(self, rows: np.ndarray) -> np.ndarray:
        return np.clip((rows - self.mean) / self.spread, -CLIP, CLIP) @ self.weights

    def score(self, texts: list[str | None]) -> np.ndarray:
        rows = np.array([features(t) for t in texts], float).reshape(len(texts), len(NAMES))
        return 1 / (1 + np.exp(-np.clip((self.rank(rows) - self.threshold) * self.scale, -30, 30)))

    def standard(self, x: str = "x") -> list[Column]:
        """The standardised features of an array column."""
        held = lambda c: F.least(F.greatest(c, F.lit(-CLIP)), F.lit(CLIP))
        return [held((F.col(x)[i] - F.lit(float(m))) / F.lit(float(d))) for i, (m, d) in enumerate(zip(self.mean, self.spread, strict=True))]

    def rank_of(self, x: str = "x") -> Column:
        """The ranking score of an array column."""
        return sum((z * F.lit(float(w)) for z, w in zip(self.standard(x), self.weights, strict=True)), F.lit(0.0))


def described(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` and x, the features of every row's text."""

    def make():
        return lambda texts: [[features(t) for t in texts]]

    return map_text(df, text, make, {"x": "array<double>"}, list(keep))


def _second_moments(z: DataFrame) -> dict[int, np.ndarray]:
    """Per label the sum of products of the standardised features."""
    n = len(NAMES)
    at = [(i, j) for i in range(n) for j in range(i, n)]
    out = {}
    for r in z.groupBy("y").agg(*(F.sum(F.col(f"z{i}") * F.col(f"z{j}")) for i, j in at)).collect():
        out[r[0]] = np.zeros((n, n))
        for (i, j), v in zip(at, r[1:], strict=True):
            out[r[0]][i, j] = out[r[0]][j, i] = v
    return out


def _by_bin(z: DataFrame, weights: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per label and bin of the score: number of rows, mean standardised features, and these features' covariance with the score."""
    width, every = max(1 / FINE, 2 * CLIP * float(np.abs(weights).sum()) / (BINS - 2)), range(len(NAMES))
    # Weights come as a row, not as literals: the plan is the same in each round and compiled once.
    given = z.sparkSession.createDataFrame([(width, *weights.tolist())], ", ".join(["width double", *(f"w{i} double" for i in every)]))
    rank = sum((F.col(f"z{i}") * F.col(f"w{i}") for i in every), F.lit(0.0))
    ranked = z.crossJoin(F.broadcast(given)).withColumn("s", rank)
    sums = (*(F.avg(f"z{i}") for i in every), *(F.covar_pop("s", f"z{i}") for i in every))
    found = ranked.groupBy("y", F.floor(F.col("s") / F.col("width")).alias("bin")).agg(F.count("*"), *sums).collect()
    own = {y: np.array([r[2:] for r in found if r[0] == y], float) for y in (0, 1)}
    return {y: (v[:, 0], v[:, 1 : len(NAMES) + 1], v[:, len(NAMES) + 1 :]) for y, v in own.items()}


def _all_pairs(bins: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], second: dict[int, np.ndarray], weights: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean loss over all pairs with its falling gradient, and its curvature.

    The gradient is right to the square of a bin's width, times the third derivative. Of the curvature, features are taken
    to vary within a bin as they do on average; this bears on the steps only, not on where the gradient is zero.
    """
    (n, good, spread), (m, bad, other) = bins[1], bins[0]
    pairs = n.sum() * m.sum()
    gap = np.clip((good @ weights)[:, None] - (bad @ weights)[None, :], -500, 500)
    wrong = 1 / (1 + np.exp(gap))  # chance of the pair's being the wrong way round
    both = n[:, None] * m[None, :] / pairs
    loss = float((both * np.logaddexp(0, -gap)).sum()) + RIDGE / 2 * float(weights @ weights)
    pull = both * wrong
    curve = pull * (1 - wrong)
    gradient = pull.sum(1) @ good - pull.sum(0) @ bad - curve.sum(1) @ spread - curve.sum(0) @ other - RIDGE * weights
    cross = good.T @ curve @ bad
    total = RIDGE * np.eye(len(weights)) - cross - cross.T
    for own, count, mean, products in ((curve.sum(1), n, good, second[1]), (curve.sum(0), m, bad, second[0])):
        within = (products - (mean.T * count) @ mean) / count.sum()
        total += (mean.T * own) @ mean + own.sum() * within
    return loss, gradient, total


def neighbours(ranks: DataFrame, k: int) -> tuple[float, float]:
    """The k-th and the next of all values of a column s, by size, k from 1 and under their number: exact, by narrowing bins."""
    low, high = ranks.agg(F.min("s"), F.max("s")).first()
    below = 0
    while low < high:
        at = F.least(F.floor((F.col("s") - F.lit(low)) / F.lit((high - low) / BINS)), F.lit(BINS - 1))
        bins = sorted(ranks.filter(F.col("s").between(low, high)).groupBy(at.alias("bin")).agg(F.count("*"), F.min("s"), F.max("s")).collect())
        ends = below + np.cumsum([r[1] for r in bins])
        here, after = int(np.searchsorted(ends, k)), int(np.searchsorted(ends, k + 1))
        if here != after:
            return bins[here][3], bins[after][2]
        below, (low, high) = int(ends[here]) - bins[here][1], bins[here][2:]
    return low, low


def fit(rows: DataFrame) -> Ranking:
    """The ranking of labelled rows (x, y), each of which counts; they are read some dozen times."""
    n = len(NAMES)
    flat = Ranking(np.zeros(n), np.ones(n), np.zeros(n), 0.0, 0.0)
    rows = rows.select("x", F.when(F.col("y") > 0, 1).otherwise(0).alias("y"))
    found = rows.agg(F.count(F.when(F.col("y") == 1, 1)), F.count(F.when(F.col("y") == 0, 1)), *(f(F.col("x")[i]) for i in range(n) for f in (F.avg, F.stddev_pop))).first()
    good, bad = found[:2]
    if not good or not bad:
        return flat
    ranking = Ranking(np.array(found[2::2], float), np.maximum(np.array(found[3::2], float), 1e-3), np.zeros(n), 0.0, 1.0)
    z = checkpoint(rows.select("y", *(c.alias(f"z{i}") for i, c in enumerate(ranking.standard()))))
    second = _second_moments(z)
    loss, gradient, curve = _all_pairs(_by_bin(z, ranking.weights), second, ranking.weights)
    step = np.linalg.solve(curve, gradient)
    for _ in range(ROUNDS):
        step = step * min(1.0, 2 / max(abs(step).max(), 1e-9))
        if abs(step).max() < STEP:
            break
        ranking.weights = ranking.weights + step
        now, slope, curve = _all_pairs(_by_bin(z, ranking.weights), second, ranking.weights)
        if now > loss + 1e-6:  # too far
            ranking.weights = ranking.weights - step
            step = step / 2
            continue
        loss, step = now, np.linalg.solve(curve, slope)
    low, high = neighbours(rows.select(ranking.rank_of().alias("s")), bad)
    ranking.threshold = (low + high) / 2
    return ranking


def learn(sample: list[tuple[str, int]]) -> Ranking:
    """The ranking of labelled texts at hand; those of tables go to ``fit`` without passing the driver."""
    if not sample:
        return Ranking(np.zeros(len(NAMES)), np.ones(len(NAMES)), np.zeros(len(NAMES)), 0.0, 0.0)
    texts = SparkSession.active().createDataFrame([(t, int(y)) for t, y in sample], "text string, y int")
    return fit(checkpoint(described(texts, keep=("y",))))


def labelled(rows: DataFrame, labels: DataFrame, label: str, mod: int, held: int) -> DataFrame:
    """(x, y) of the labelled training rows of rows (doc_id, one, two, x): each distinct text, told by its marks, once for a label.

    Rows whose crc32(doc_id as text) mod ``mod`` equals ``held`` are held out.
    """
    known = labels.filter(crc_mod("doc_id", mod) != held).filter(F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    return rows.join(known, "doc_id").dropDuplicates(["one", "two", "y"]).select("x", "y")


def scored(rows: DataFrame, ranking: Ranking) -> DataFrame:
    """rows (.., x) with score and predicted in place of x."""
    far = (ranking.rank_of() - F.lit(ranking.threshold)) * F.lit(ranking.scale)
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.least(F.greatest(far, F.lit(-30.0)), F.lit(30.0))))
    return rows.withColumn("score", score).withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0)).drop("x")


def quality(df: DataFrame, ranking: Ranking, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, score and predicted for every row."""
    kept = tuple(c for c in keep if c not in ("score", "predicted", "x"))
    return scored(described(df, text, kept), ranking)
