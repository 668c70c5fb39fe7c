"""Language identification: averaged hashed subword embeddings, a linear softmax, and a calibrated rejection."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_sample

ORDERS = (1, 2, 3, 4)
#: Bytes of a text that are no letters in ASCII become blanks; A-Z become a-z; bytes of other characters stay.
_LETTERS = bytes(b if chr(b).isalpha() or b > 127 else 32 for b in range(128)) + bytes(range(128, 256))
_SLICE = 1 << 20


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def bag(text: str, bits: int) -> np.ndarray:
    """Counts of the hashed subwords (byte n-grams of 1 to 4, blanks marking the ends of words) of a whole text."""
    data = b" " + text.encode("utf-8", "replace").lower().translate(_LETTERS) + b" "
    counts = np.zeros(1 << bits, np.float32)
    for at in range(0, len(data), _SLICE):
        b = np.frombuffer(data[max(0, at - max(ORDERS) + 1) : at + _SLICE], np.uint8).astype(np.uint32)
        h = np.zeros(len(b), np.uint32)
        for n in ORDERS:
            h = h[: len(b) - n + 1] * np.uint32(0x01000193) + b[n - 1 :] + np.uint32(n)
            # the overlap of slices holds n-grams that the slice before has counted already
            fresh = h[max(0, min(at, max(ORDERS) - 1) - n + 1) :] if at else h
            counts += np.bincount((fresh * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits), minlength=1 << bits)
    return counts


@dataclass(frozen=True)
class LanguageModel:
    langs: tuple[str, ...]
    table: np.ndarray  # of each bucket, its embedding times the softmax weights; averaging and weighting commute
    bias: np.ndarray
    temperature: float
    threshold: float  # scores below are rejected
    bits: int

    def logits(self, counts: np.ndarray) -> np.ndarray:
        return counts @ self.table / max(1.0, float(counts.sum())) + self.bias

    def predict(self, text: str) -> tuple[str, float]:
        if not has_letter(text):
            return "und", 0.0
        p = _softmax(self.logits(bag(text, self.bits)) / self.temperature)
        best = int(p.argmax())
        return self.langs[best], float(min(1.0, p[best]))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _snippets(text: str, r: np.random.Generator, n: int) -> list[str]:
    """The text and parts of it of 1 to 40 words, so that the model also meets short texts."""
    words = text.split()
    out = [text]
    for _ in range(n if words else 0):
        k = int(r.integers(1, 41))
        at = int(r.integers(0, max(1, len(words) - k + 1)))
        out.append(" ".join(words[at : at + k]))
    return out


def _ranks(values: list[str]) -> list[int]:
    """For each value, how many equal ones come before it."""
    seen: dict[str, int] = {}
    out = []
    for v in values:
        out.append(seen.get(v, 0))
        seen[v] = out[-1] + 1
    return out


def _bags(rows: DataFrame, bits: int, seed: int) -> DataFrame:
    """Rows (key, lang, idx, weight): of each text (text, lang) its bag and those of four snippets, as bytes, made where the texts are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key, text, lang in zip(*(batch.column(c).to_pylist() for c in ("key", "text", "lang")), strict=True):
                if has_letter(text):
                    parts = [_sparse(s, bits) for s in _snippets(text, np.random.default_rng((seed, key & 0x7FFFFFFF)), 4) if has_letter(s)]
                    out.append((key, lang, [i.astype(np.uint32).tobytes() for i, _ in parts], [w.astype(np.float16).tobytes() for _, w in parts]))
            kinds = [("key", pa.int64()), ("lang", pa.string()), ("idx", pa.list_(pa.binary())), ("weight", pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])

    return rows.select(F.xxhash64("text").alias("key"), "text", "lang").mapInArrow(run, "key long, lang string, idx array<binary>, weight array<binary>")


def fit(
    df: DataFrame,
    *,
    text_col: str = "text",
    lang_col: str = "lang",
    sample_rows: int = 3000,
    bits: int = 14,
    dim: int = 12,
    epochs: int = 4,
    seed: int = 7,
) -> LanguageModel | None:
    """Trains on at most about ``sample_rows`` different labelled texts, drawn by a hash in equal parts for each language.

    The drawn texts are read whole where they lie; their bags of subwords, of 2^``bits`` entries at most each, come to the driver, so texts of any
    length teach in full and what comes is bounded. Rows with a null language, a null text or one without a letter teach nothing;
    without any other there is no model. Copies count once. Other columns are not read.

    Embeddings and softmax are trained together by stochastic gradient descent; a fifth of the rows is kept back, from which
    the temperature of the scores and the rejection threshold are set: a right answer falls below it once in a thousand times.
    """
    labelled = df.filter(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    drawn = bounded_sample(labelled, ["text", "lang"], sample_rows, by="lang")[0]
    rows = sorted(_bags(drawn, bits, seed).collect(), key=lambda x: (x.key, x.lang))
    rows = [([(np.frombuffer(i, np.uint32), np.frombuffer(w, np.float16).astype(np.float32)) for i, w in zip(x.idx, x.weight, strict=True)], x.lang) for x in rows]
    if not rows:
        return None
    r = np.random.default_rng(seed)
    langs = tuple(sorted({x[1] for x in rows}))
    # a fifth of each language's rows is kept back, as far as it has so many
    number = _ranks([x[1] for x in rows])
    kept = [x for x, n in zip(rows, number, strict=True) if n % 5 == 4] if len(rows) >= 50 else rows
    train = [x for x, n in zip(rows, number, strict=True) if n % 5 != 4] if len(rows) >= 50 else rows
    docs = [(one, langs.index(lang)) for bags, lang in train for one in bags]
    emb = r.normal(0, 0.1, (1 << bits, dim)).astype(np.float32)
    w, b = np.zeros((dim, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    for epoch in range(epochs):
        for i in r.permutation(len(docs)):
            (idx, weight), y = docs[i]
            rate = 0.5 / (1 + epoch)
            mean = weight @ emb[idx]
            g = _softmax(mean @ w + b)
            g[y] -= 1
            back = w @ g
            w -= rate * np.outer(mean, g)
            b -= rate * g
            emb[idx] -= rate * len(idx) ** 0.5 * weight[:, None] * back[None, :]
    table, kept = emb @ w, kept or rows
    model = LanguageModel(langs, table, b, 1.0, 0.0, bits)
    checks = [(weight @ model.table[idx] + model.bias, langs.index(lang)) for bags, lang in kept for idx, weight in bags[:2]]
    z, y = np.array([c[0] for c in checks]), np.array([c[1] for c in checks])
    nll = lambda t: -np.log(_softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean()
    t = min(np.geomspace(0.2, 5, 40), key=nll)
    p = _softmax(z / t)
    right = p.max(axis=1)[p.argmax(axis=1) == y]
    threshold = float(min(0.5, np.quantile(right, 0.001))) if len(right) else 0.0
    return LanguageModel(langs, table.astype(np.float32), b, float(t), threshold, bits)


def _sparse(text: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    counts = bag(text, bits)
    idx = np.flatnonzero(counts)
    return idx, (counts[idx] / counts.sum()).astype(np.float32)


def predict(df: DataFrame, model: LanguageModel | None, *, text_col: str = "text") -> DataFrame:
    """``df`` with lang_pred, score and rejected. Whole texts are read.

    A null text and one without a letter get ``und`` with score 0 and are rejected, as is a score below the model's
    threshold; so is every row if there is no model. Repeated rows get equal results; columns of these names are replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for texts in batches:
            yield pd.DataFrame([m.predict(t) if m and t else ("und", 0.0) for t in texts], columns=["lang_pred", "score"])

    found = df.drop("lang_pred", "score", "rejected").withColumn("_lang", run(F.col(text_col)))
    low = (F.col("_lang.lang_pred") == "und") | (F.col("_lang.score") < (model.threshold if model else 1.0))
    return found.select("*", F.col("_lang.lang_pred").alias("lang_pred"), F.col("_lang.score").alias("score"), low.alias("rejected")).drop("_lang")
