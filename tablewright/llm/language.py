"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies come from every labelled training document. The weights are
fitted by follow-the-regularised-leader (FTRL-proximal) with an elastic-net penalty on
a bounded sample of labelled documents, and the probabilities are calibrated by a
temperature on a part of the sample that the fit has not seen.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import even_sample

#: n-gram lengths, hashed into 2^BUCKET_BITS features.
ORDERS, BUCKET_BITS = (1, 2, 3), 16
#: Bound of the labelled sample that weights are fitted on, per language and in all.
SAMPLE_PER_LANG, SAMPLE_ROWS = 1000, 12_000
UNKNOWN = "und"
_SLICE = 1 << 20


def _letter_table() -> np.ndarray:
    return np.array([unicodedata.category(chr(c))[0] in "LM" for c in range(0x10000)])


def ngrams(text: str, letters: np.ndarray, bits: int = BUCKET_BITS) -> Iterator[np.ndarray]:
    """Feature numbers of all n-grams of a lower-cased text, in slices; runs of other signs count as one space."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), np.uint32)
    c = np.where(letters[np.minimum(c, 0xFFFF)] | (c > 0xFFFF), c, np.uint32(32))
    c = c[np.concatenate(([True], (c[1:] != 32) | (c[:-1] != 32)))].astype(np.uint64)
    for k in range(0, max(len(c) - 1, 1), _SLICE):
        part = c[k : k + _SLICE + max(ORDERS) - 1]
        for n in ORDERS:
            count = min(len(part) - n + 1, _SLICE)
            if count <= 0:
                continue
            h = np.full(count, n, np.uint64)
            for i in range(n):
                h = (h * np.uint64(0x100000001B3)) ^ part[i : i + count]
            h *= np.uint64(0x9E3779B97F4A7C15)
            found = (h >> np.uint64(64 - bits)).astype(np.int64)
            yield found[part[:count] != 32] if n == 1 else found


@dataclass
class LanguageModel:
    """languages, weights (features x languages, times inverse document frequency), bias and temperature."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def logits(self, text: str, letters: np.ndarray) -> np.ndarray:
        total, n = np.zeros(len(self.languages)), 0
        for found in ngrams(text, letters):
            total += self.weights[found].sum(axis=0)
            n += len(found)
        return (total / max(n, 1) + self.bias) / self.temperature


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def fit_ftrl(
    rows: list[tuple[np.ndarray, np.ndarray, int]],
    classes: int,
    features: int,
    epochs: int = 4,
    alpha: float = 0.5,
    beta: float = 1.0,
    l1: float = 0.05,
    l2: float = 0.01,
    seed: int = 7,
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias from rows of (feature numbers, values, class), one row at a time."""
    z, n = np.zeros((features + 1, classes)), np.zeros((features + 1, classes))

    def weights(at) -> np.ndarray:
        shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - l1, 0)
        return -shrunk / ((beta + np.sqrt(n[at])) / alpha + l2)

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for r in order.permutation(len(rows)):
            index, value, label = rows[r]
            at, x = np.append(index, features), np.append(value, 1.0)
            w = weights(at)
            p = _softmax(x @ w)
            p[label] -= 1
            g = np.outer(x, p)
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - step * w
            n[at] += g * g
    w = weights(slice(None))
    return w[:-1], w[-1]


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden section over its logarithm."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        p = _softmax(logits / np.exp(t))
        return float(-np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-300)).mean())

    low, high, golden = -4.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(50):
        a, b = high - golden * (high - low), low + golden * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit_language_model(
    docs: DataFrame,
    train: Column,
    per_lang: int = SAMPLE_PER_LANG,
    sample_rows: int = SAMPLE_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> LanguageModel:
    """Fit on the rows of ``docs`` where ``train`` holds and id, text and language are given.

    Document frequencies cover all of those rows. The sample has about ``per_lang``
    rows per language by the hash of the id, and ``sample_rows`` in all at most; a
    fifth of it calibrates. Without any such row the model knows no language.
    """
    bits, features = BUCKET_BITS, 1 << BUCKET_BITS
    rows = docs.where(train).select(
        docs[id_col].cast("string").alias("id"), docs[text_col].alias("text"), docs[lang_col].alias("lang")
    )
    rows = rows.where("id is not null and lang is not null and text is not null")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, df, n = _letter_table(), np.zeros(features, np.int64), 0
        for b in batches:
            for text in b.column(0):
                seen = np.zeros(features, bool)
                for found in ngrams(text.as_py(), letters, bits):
                    seen[found] = True
                df += seen
                n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], ["f", "n"])

    counted = rows.select("text").mapInArrow(frequencies, "f long, n long").groupBy("f").agg(F.sum("n"))
    df, total = np.zeros(features), 0
    for f, n in counted.collect():  # at most one row per feature
        if f < 0:
            total = n
        else:
            df[f] = n
    idf = np.log((1 + total) / (1 + df)) + 1

    chosen = even_sample(rows.select("id", "lang").distinct(), "lang", per_lang, sample_rows)
    sample = rows.join(F.broadcast(chosen.select("id", "lang")), ["id", "lang"]).select("id", "lang", "text")

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = _letter_table()
        for b in batches:
            index, value = [], []
            for text in b.column(2):
                tf = np.zeros(features)
                for found in ngrams(text.as_py(), letters, bits):
                    tf += np.bincount(found, minlength=features)
                at = np.flatnonzero(tf)
                index.append(at.astype("<i4").tobytes())
                value.append((tf[at] / max(tf.sum(), 1)).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:2], pa.array(index, pa.binary()), pa.array(value, pa.binary())], ["id", "lang", "at", "tf"]
            )

    schema = "id string, lang string, at binary, tf binary"
    got = sorted(sample.mapInArrow(counts, schema).dropDuplicates(["id", "lang"]).collect(), key=lambda r: r.id)
    languages = sorted({r.lang for r in got})
    scale = 100.0  # relative frequencies are small; this puts the values near one
    data = []
    for r in got:
        at = np.frombuffer(r["at"], "<i4").astype(np.int64)
        data.append((at, np.frombuffer(r["tf"], "<f4") * idf[at] * scale, languages.index(r.lang)))
    if not data:
        return LanguageModel([], np.zeros((features, 0)), np.zeros(0), 1.0)
    held = data[::5] if len(data) >= 10 else []
    fitted = [d for k, d in enumerate(data) if k % 5] if held else data
    w, bias = fit_ftrl(fitted, len(languages), features)
    logits = np.array([x @ w[at] + bias for at, x, _ in held]).reshape(-1, len(languages))
    t = temperature(logits, np.array([label for *_, label in held], int))
    return LanguageModel(languages, (w * idf[:, None] * scale).astype(np.float32), bias, t)


def predicted(text: Column, model: LanguageModel) -> Column:
    """Struct of lang_pred and score (the calibrated probability of lang_pred, 0 to 1).

    A text that is null or has no letter gets "und" and 0, as does every text when
    the model knows no language. Only the text decides.
    """

    @F.pandas_udf("lang_pred string, score double")
    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        letters = _letter_table()
        for part in parts:
            out = []
            for text in part:
                if not model.languages or not has_letter(text):
                    out.append((UNKNOWN, 0.0))
                    continue
                p = _softmax(model.logits(text, letters))
                best = int(p.argmax())
                out.append((model.languages[best], float(p[best])))
            yield pd.DataFrame(out, columns=["lang_pred", "score"])

    return predict(text)


def held_out(doc_id: Column, parts: int = 4, part: int = 2) -> Column:
    """Whether crc32 of the id as text leaves ``part``; false without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with lang_pred and score; columns of those names are replaced."""
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    step = docs.select(*[docs[c] for c in names], predicted(docs[text_col], model).alias("__tw_lang"))
    return step.select(*[step[c] for c in names], "__tw_lang.lang_pred", "__tw_lang.score")
