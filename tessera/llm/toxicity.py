"""Toxicity grades by cumulative-link ordinal regression.

``P(grade <= k) = sigmoid(theta_k - w . x)``: one weight for each feature, shared by all
ordered thresholds ``theta``.  ``x`` tells which words and word beginnings of the vocabulary a text has.  The
expected severity is the sum over ``k`` of ``P(grade > k)``.

The labels are 0 or 1, and the grades come from them: 0 is a clean document, and toxic
documents are 2 if they have more different words that mark toxic documents than their
median, else 1.  Labels with more levels are taken as they are.

The vocabulary holds what is likelier in toxic documents by a likelihood ratio of twice the logarithm of
the number of candidates at least, which chance alone seldom reaches; all of it is used, and it is no larger than what the labelled sample holds.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, scope, stored, text_key

#: Labelled documents that are fitted on, the first by a hash of their ids.
MAX_LABELLED = 20_000
MIN_DOCS = 5
THRESHOLD = 0.5

#: Lengths of the word beginnings that are features beside the words: compounds share a stem.
STEMS = (4, 5, 6)

_WORD = re.compile(r"[^\W\d_]+")


def _words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def features(text: str | None) -> set[str]:
    """The different words of a text, and their beginnings with a star."""
    words = set(_words(text))
    return words.union(*({w[:n] + "*" for w in words if len(w) > n} for n in STEMS))


@F.arrow_udf(T.ArrayType(T.StringType()))
def distinct_features(batch: pa.Array) -> pa.Array:
    return pa.array([sorted(features(x.as_py())) for x in batch], pa.list_(pa.string()))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


@dataclass
class Model:
    """Weights by word and ascending thresholds."""

    weights: dict[str, float]
    thresholds: list[float]

    def severity(self, text: str | None) -> tuple[float, float, int]:
        """Expected severity, ``P(grade >= 1)`` and the likeliest grade of a text."""
        return self._grade(sum(map(self.weights.get, features(text) & self.weights.keys())))

    def _grade(self, score: float) -> tuple[float, float, int]:
        above = _sigmoid(score - np.asarray(self.thresholds))
        shares = -np.diff(np.concatenate([[1.0], above, [0.0]]))
        return float(above.sum()), float(above[0]), int(shares.argmax())


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, y: np.ndarray, n_words: int, steps: int = 300, rate: float = 0.1, l2: float = 1e-3, balanced: bool = False, scale: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by Adam on the mean log-likelihood.

    ``rows, cols`` are the coordinates of the ones of the feature matrix and ``y`` the grades from 0 on.
    Thresholds are ``theta_0 + cumulated exp(gaps)``, and so stay in order.  With ``balanced``, the
    clean documents and the others weigh the same in all.  A feature that is there has the value of its ``scale``.
    """
    levels = int(y.max()) + 1
    scale = np.ones(n_words) if scale is None else scale
    values = scale[cols]
    cuts = [np.clip((y <= k).mean(), 1e-3, 1 - 1e-3) for k in range(levels - 1)]
    start = np.log(cuts) - np.log1p(np.negative(cuts))
    params = np.concatenate([np.zeros(n_words), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    m, v = np.zeros_like(params), np.zeros_like(params)
    n, each = len(y), np.arange(len(y))
    share = np.where(y == 0, 0.5 / max((y == 0).sum(), 1), 0.5 / max((y > 0).sum(), 1)) if balanced else np.full(n, 1 / n)
    for t in range(1, steps + 1):
        w, first, gaps = params[:n_words], params[n_words], np.exp(params[n_words + 1 :])
        theta = first + np.concatenate([[0.0], np.cumsum(gaps)])
        score = np.bincount(rows, w[cols] * values, minlength=n)
        cdf = np.column_stack([np.zeros(n), _sigmoid(theta[None, :] - score[:, None]), np.ones(n)])
        slope = cdf * (1 - cdf)
        p = np.maximum(cdf[each, y + 1] - cdf[each, y], 1e-12)
        upper, lower = share * slope[each, y + 1] / p, share * slope[each, y] / p  # of log p by theta_y and theta_(y-1)
        d_score = lower - upper
        d_theta = np.array([upper[y == k].sum() - lower[y == k + 1].sum() for k in range(levels - 1)])
        grad = -np.concatenate([np.bincount(cols, d_score[rows] * values, minlength=n_words), [d_theta.sum()], gaps * d_theta[::-1].cumsum()[::-1][1:]])
        grad[:n_words] += l2 * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        params = params - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return params[:n_words] * scale, params[n_words] + np.concatenate([[0.0], np.cumsum(np.exp(params[n_words + 1 :]))])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_labelled: int = MAX_LABELLED) -> Model | None:
    """Fit on at most ``max_labelled`` labelled documents; None if they hold fewer than two labels.

    Labels that are null are left out, of several labels of a document the largest counts, and labels without a
    document or with a null text teach nothing.  Of several texts with one id that with the smallest hash counts.
    The smallest label is the clean one, and labels count by their order alone.
    """
    with scope(docs.sparkSession):
        known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("y"))
        sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
        texts = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(stored(sample, "labelled")), "doc_id")
        texts = texts.groupBy("doc_id", "y").agg(F.min_by("text", F.struct(text_key().alias("k"), "text")).alias("text"))
        seen = stored(texts.select("doc_id", "y", distinct_features("text").alias("words")), "labelled-words")
        sizes = dict(seen.groupBy("y").agg(F.count("*")).collect())
        if len(sizes) < 2:
            return None
        lowest = min(sizes)
        clean = sizes[lowest]
        toxic = sum(sizes.values()) - clean
        per_word = stored(
            seen.select("y", F.explode("words").alias("word")).groupBy("word")
            .agg(F.sum((F.col("y") > lowest).cast("int")).alias("bad"), F.sum((F.col("y") == lowest).cast("int")).alias("good"))
            .where(F.col("bad") + F.col("good") >= MIN_DOCS),
            "word-counts",
        )
        seen_in = F.col("bad") + F.col("good")

        def part(observed: Column, expected: Column) -> Column:
            return F.when(observed > 0, observed * F.log(observed / expected)).otherwise(0.0)

        share = toxic / (toxic + clean)
        without = toxic + clean - seen_in
        ratio = 2 * (
            part(F.col("bad"), seen_in * share) + part(F.col("good"), seen_in * (1 - share))
            + part(toxic - F.col("bad"), without * share) + part(clean - F.col("good"), without * (1 - share))
        )
        odds = F.log((F.col("bad") + 0.5) / (toxic + 1.0)) - F.log((F.col("good") + 0.5) / (clean + 1.0))
        tested = per_word.count()
        telling = per_word.select("word", ratio.alias("g"), odds.alias("odds")).where((F.col("odds") > 0) & (F.col("g") >= 2 * float(np.log(max(tested, 2)))))
        vocabulary = telling.orderBy(F.col("g").desc(), "word").toPandas()
        if not len(vocabulary):
            return None
        index = {w: i for i, w in enumerate(vocabulary["word"])}
        odds_of = vocabulary["odds"].to_numpy()
        used = set(index)

        @F.arrow_udf(T.ArrayType(T.IntegerType()))
        def numbered(batch: pa.Array) -> pa.Array:
            return pa.array([sorted(index[w] for w in used.intersection(x.as_py() or ())) for x in batch], pa.list_(pa.int32()))

        table = seen.select("doc_id", "y", numbered("words").alias("x")).orderBy("doc_id").toArrow()
        lists = table["x"].combine_chunks()
        ends = lists.offsets.to_numpy()
        cols = lists.values.to_numpy(zero_copy_only=False).astype(np.int64)
        y = np.unique(table["y"].to_numpy(), return_inverse=True)[1].astype(np.int64)
        rows = np.repeat(np.arange(len(y)), np.diff(ends))
        if y.max() == 1:
            marked = np.bincount(rows, odds_of[cols] > 2, minlength=len(y))
            y = y + ((y == 1) & (marked > np.median(marked[y == 1])))
        weights, theta = fit_ordinal(rows, cols, y, len(index), balanced=True, scale=odds_of)
        return Model({w: float(weights[i]) for w, i in index.items()}, theta.tolist())


_GRADES = T.StructType([T.StructField("severity", T.DoubleType()), T.StructField("p_toxic", T.DoubleType()), T.StructField("grade", T.LongType())])


def grades_column(text: Column, model: Model) -> Column:
    @F.arrow_udf(_GRADES)
    def run(batch: pa.Array) -> pa.Array:
        out = [model.severity(x.as_py()) for x in batch]
        return pa.StructArray.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.float64(), pa.float64(), pa.int64()))], _GRADES.names)

    return run.asNondeterministic()(text)


def graded(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``severity, p_toxic, grade, toxic``.

    Rows are independent; null and empty texts have no words and grade as such.  Without a model
    all grades are 0.  Columns of these names are replaced.
    """
    if model is None:
        return docs.withColumns({"severity": F.lit(0.0), "p_toxic": F.lit(0.0), "grade": F.lit(0).cast("long"), "toxic": F.lit(False)})
    (g,) = fresh(docs, "_grades")
    out = docs.withColumn(g, grades_column(F.col("text"), model))
    return out.withColumns({n: F.col(f"{g}.{n}") for n in _GRADES.names}).withColumn("toxic", F.col("p_toxic") >= threshold).drop(g)


def op9_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """:func:`graded` for each row, by a model of :func:`fit`; reruns agree."""
    return graded(docs.select("doc_id", "text"), fit(docs, labels)).drop("text")
