"""Quality by regularised quadratic discriminant analysis of document statistics."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_sample

_KINDS = {
    "lower": range(97, 123), "upper": range(65, 91), "digit": range(48, 58), "blank": (32, 9), "line": (10, 13), "full_stop": (46,), "comma": (44,),
    "mark": (33, 63), "symbol": [b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,!?'-\"()"], "other": range(128, 256),
}
_SHARE = np.array([[b in kind for kind in _KINDS.values()] for b in range(256)], np.float64)
FEATURES = (*_KINDS, "words", "word_length", "word_length_spread", "distinct_words", "commonest_word", "lines", "distinct_lines", "line_words", "ends_marked", "upper_words")


#: Shares of plain prose in the order of _KINDS, and the weight (in bytes, and in words) with which they smooth those of short texts.
_PROSE = np.array([0.78, 0.02, 0.0, 0.155, 0.005, 0.015, 0.01, 0.0, 0.0, 0.02])
_BYTES, _WORDS = 150.0, 15.0


def statistics(text: str) -> np.ndarray:
    """Transformed statistics of a whole text: square roots of shares and logarithms of sizes, which are nearer to normal.

    Shares and means of short texts are drawn towards those of plain prose, as they say little by themselves.
    """
    data = text.encode("utf-8", "replace")
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    shares = np.sqrt((counts @ _SHARE + _BYTES * _PROSE) / (len(data) + _BYTES))
    words, lines = data.split(), [x for x in data.split(b"\n") if x.strip()]
    n = len(words)
    lengths = np.fromiter(map(len, words), np.float64, n)
    often = Counter(words)
    lower = sum(map(bytes.islower, often))
    mean = (lengths.sum() + _WORDS * 5.5) / (n + _WORDS)
    rest = [
        np.log1p(n),
        np.log(mean),
        np.log1p(np.sqrt((((lengths - mean) ** 2).sum() + _WORDS * 9) / (n + _WORDS))),
        np.log((_WORDS + len(often)) / (_WORDS + n)) / np.log(2 + n),
        np.sqrt((max(often.values(), default=0) + _WORDS * 0.05) / (n + _WORDS)),
        np.log1p(len(lines)),
        np.sqrt((len(set(lines)) + 2) / (len(lines) + 2)),
        np.log((n + _WORDS) / (len(lines) + 1)),
        np.sqrt((sum(x.rstrip()[-1:] in (b".", b"!", b"?", b":") for x in lines) + 2) / (len(lines) + 2)),
        np.sqrt((len(often) - lower + 1) / (len(often) + 10)),
    ]
    return np.concatenate([shares, rest])


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    centres: np.ndarray  # of class 0 and 1
    inverse_factors: np.ndarray  # inverses of the Cholesky factors of both covariances, kept for all rows to come
    constants: np.ndarray  # log prior - half the log determinant
    temperature: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1: logistic of the difference of the log densities, whose exponents are Mahalanobis distances."""
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        log = [self.constants[c] - 0.5 * (((z - self.centres[c]) @ self.inverse_factors[c].T) ** 2).sum(axis=1) for c in (0, 1)]
        return 1 / (1 + np.exp(-np.clip((log[1] - log[0]) / self.temperature, -40, 40)))


def fit_arrays(x: np.ndarray, y: np.ndarray, *, shrinkage: float = 0.1, pooling: float = 0.3) -> QualityModel:
    """Class covariances are drawn by ``pooling`` towards the pooled one and by ``shrinkage`` towards a multiple of the identity.

    The temperature of the scores is set on the training rows; the two classes weigh as often as they come.
    """
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.clip((x - mean) / scale, -8, 8)
    centres = np.array([z[y == c].mean(axis=0) for c in (0, 1)])
    d = x.shape[1]
    own = [np.cov(z[y == c], rowvar=False, bias=True).reshape(d, d) for c in (0, 1)]
    share = np.array([(y == c).mean() for c in (0, 1)])
    pooled = share[0] * own[0] + share[1] * own[1]
    inverse, constants = [], []
    for c in (0, 1):
        s = (1 - pooling) * own[c] + pooling * pooled
        s = (1 - shrinkage) * s + shrinkage * max(1e-3, np.trace(s) / d) * np.eye(d)
        factor = np.linalg.cholesky(s)
        inverse.append(np.linalg.inv(factor))
        constants.append(np.log(share[c]) - np.log(np.diag(factor)).sum())
    model = QualityModel(mean, scale, centres, np.array(inverse), np.array(constants), 1.0)
    p = np.clip(model.scores(x), 1e-9, 1 - 1e-9)
    logit = np.log(p / (1 - p))
    loss = lambda t: np.logaddexp(0, np.where(y == 1, -1, 1) * logit / t).mean()
    return QualityModel(mean, scale, centres, np.array(inverse), np.array(constants), float(min(np.geomspace(0.5, 20, 60), key=loss)))


def fit(
    df: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = 8000
) -> QualityModel | None:
    """Trains on at most about ``sample_rows`` labelled rows, drawn by a hash of the id, whole texts each.

    Only the drawn ids are broadcast and only their statistics (20 numbers a row) come to the driver. Labels that are
    null or neither 0 nor 1 are left out, null texts count as empty. Of rows that share an id one is learned from, chosen by a
    hash of its text, so a repeated id does not crowd the sample. There is no model unless both classes have two rows.
    """
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label"))
    drawn, _ = bounded_sample(known, ["_id", "_label"], sample_rows)
    stats = _statistics_udf()
    texts = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).join(F.broadcast(drawn), "_id")
    rows = texts.groupBy("_id", "_label").agg(F.min_by("_text", F.struct(F.xxhash64("_text"), "_text")).alias("_text")).select("_id", "_label", stats("_text").alias("x")).collect()
    rows.sort(key=lambda r: (r[0], r[1], r[2]))
    y = np.array([r[1] for r in rows])
    if min((y == 0).sum(), (y == 1).sum()) < 2:
        return None
    return fit_arrays(np.array([r[2] for r in rows]), y)


def _statistics_udf():
    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics(t) for t in texts])

    return run


def score(df: DataFrame, model: QualityModel | None, *, text_col: str = "text") -> DataFrame:
    """``df`` with score (0 to 1, higher: label 1 likelier) and predicted (1 if score >= 0.5).

    Whole texts are read; null counts as empty, and empty texts are scored like any other. Without a model every score is
    0.5. Repeated rows get equal scores; columns of these names are replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        for texts in batches:
            yield pd.Series(m.scores(np.array([statistics(t) for t in texts])) if m and len(texts) else [0.5] * len(texts), dtype="float64")

    scored = df.drop("score", "predicted").withColumn("score", run(F.coalesce(F.col(text_col), F.lit(""))))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
