"""Toxicity grades by cumulative-link ordinal regression on sparse word features.

One weight per word is shared by all grades; ordered thresholds separate them:
P(grade >= k) = sigmoid(w.x - t_k) with t_1 < t_2 < ... . The result is the expected
severity, the sum of those probabilities.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import even_sample

#: Bound of the labelled sample that the model is fitted on, per grade.
SAMPLE_PER_GRADE = 1500
MOST_GRADES = 8
#: A word needs so many documents of the sample to get a weight.
LEAST_DOCS = 3
#: Letters of a longer word that stand for its stem.
STEM = 5
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> set[str]:
    """The features of a text: its different lower-cased words (runs of letters), and how longer ones begin."""
    found = set(_WORD.findall(text.lower())) if text else set()
    return found | {w[:STEM] + "*" for w in found if len(w) > STEM}


@dataclass
class SeverityModel:
    """Weights by word, ordered thresholds, and the severity from which a text counts as toxic."""

    weights: dict[str, float]
    thresholds: np.ndarray
    cut: float

    def exceed(self, text: str | None) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ...; a text without words exceeds nothing."""
        found = words(text)
        if not found or not len(self.thresholds):
            return np.zeros(len(self.thresholds))
        few, many = (self.weights, found) if len(self.weights) < len(found) else (found, self.weights)
        s = sum(self.weights[w] for w in few if w in many)
        return _sigmoid(s - self.thresholds)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def fit_cumulative_link(
    rows: list[np.ndarray],
    grades: np.ndarray,
    features: int,
    l1: float = 3e-4,
    l2: float = 1e-4,
    rounds: int = 200,
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds for rows of feature numbers (each present once) and grades 0..K.

    Accelerated proximal gradient with an adaptive step: the proximal step sets the
    weights of words without bearing to zero, and sorts the thresholds, which is the
    projection on their order.
    """
    top = int(grades.max(initial=0))
    lengths = np.array([len(r) for r in rows])
    flat = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    owner = np.repeat(np.arange(len(rows)), lengths)
    # Rows weigh so that each grade has the same share.
    share = np.bincount(grades, minlength=top + 1).astype(float)
    weight = (1 / np.maximum(share, 1))[grades] / max((share > 0).sum(), 1)

    def loss(w: np.ndarray, t: np.ndarray, slope: bool = True):
        s = np.bincount(owner, w[flat], len(rows))
        over = np.column_stack([np.ones(len(rows)), _sigmoid(s[:, None] - t), np.zeros(len(rows))])
        at = np.arange(len(rows))
        up, down = over[at, grades], over[at, grades + 1]
        p = np.maximum(up - down, 1e-12)
        value = float(-(weight * np.log(p)).sum() + l2 / 2 * (w @ w))
        if not slope:
            return value
        d_up, d_down = up * (1 - up) / p, down * (1 - down) / p
        g_s = -weight * (d_up - d_down)
        g_t = np.zeros(top + 2)
        np.add.at(g_t, grades, weight * d_up)
        np.add.at(g_t, grades + 1, -weight * d_down)
        return value, np.bincount(flat, g_s[owner], features) + l2 * w, g_t[1 : top + 1]

    w, t = np.zeros(features), np.linspace(0, 1, top) if top > 1 else np.zeros(top)
    v, u, momentum, size = w, t, 1.0, 1.0
    for _ in range(rounds):
        value, g_w, g_t = loss(v, u)
        while True:
            moved = v - size * g_w
            w2 = np.sign(moved) * np.maximum(np.abs(moved) - size * l1, 0)
            t2 = np.sort(u - size * g_t)
            d_w, d_t = w2 - v, t2 - u
            limit = value + g_w @ d_w + g_t @ d_t + (d_w @ d_w + d_t @ d_t) / (2 * size)
            if size < 1e-6 or loss(w2, t2, False) <= limit + 1e-12:
                break
            size /= 2
        grown = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
        ratio = (momentum - 1) / grown
        v, u = w2 + ratio * (w2 - w), t2 + ratio * (t2 - t)
        w, t, momentum, size = w2, t2, grown, size * 1.3
    return w, t


def best_cut(severity: np.ndarray, toxic: np.ndarray) -> float:
    """The severity that separates best (F1), in the middle of its gap; 0.5 without examples of both kinds."""
    if not toxic.any() or toxic.all():
        return 0.5
    order = np.argsort(-severity, kind="stable")
    s, hits = severity[order], np.cumsum(toxic[order])
    f1 = 2 * hits / (np.arange(1, len(s) + 1) + toxic.sum())
    f1[:-1][s[:-1] == s[1:]] = -1
    at = int(f1.argmax())
    return float((s[at] + (s[at + 1] if at + 1 < len(s) else 0.0)) / 2)


def fit_severity(
    docs: DataFrame, grades: DataFrame, per_grade: int = SAMPLE_PER_GRADE, id_col: str = "doc_id", text_col: str = "text"
) -> SeverityModel:
    """Fit on a sample of graded documents.

    ``grades`` has doc_id and grade (0, 1, 2, ... by severity); null ids and grades
    are not used, and of several grades of a document the highest counts. The sample
    has about ``per_grade`` documents of each grade by the hash of the id, and no
    more than MOST_GRADES times as many; a fifth of it sets the cut. Without graded
    documents every severity is 0.
    """
    graded = grades.where("doc_id is not null and grade >= 0").groupBy("doc_id").agg(F.max("grade").cast("int").alias("grade"))
    order = F.xxhash64("doc_id")
    chosen = even_sample(graded.withColumnRenamed("doc_id", "id"), "grade", per_grade, MOST_GRADES * per_grade)
    chosen = chosen.withColumnRenamed("id", "doc_id")
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))

    def distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sorted(words(t.as_py())) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:2], pa.array(found, pa.list_(pa.string()))], ["doc_id", "grade", "words"]
            )

    sample = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "grade", "text")
    schema = "doc_id long, grade int, words array<string>"
    got = sample.mapInArrow(distinct_words, schema).dropDuplicates(["doc_id"]).orderBy(order, "doc_id").collect()
    if not got:
        return SeverityModel({}, np.zeros(0), 0.5)
    levels = sorted({r.grade for r in got} | {0})
    held = [k % 5 == 0 and len(got) >= 10 for k in range(len(got))]
    counts: dict[str, int] = {}
    for r, out in zip(got, held, strict=True):
        for word in r.words if not out else ():
            counts[word] = counts.get(word, 0) + 1
    vocabulary = sorted(word for word, n in counts.items() if n >= LEAST_DOCS)
    number = {word: k for k, word in enumerate(vocabulary)}
    rows = [np.array([number[x] for x in r.words if x in number], np.int64) for r in got]
    grade = np.array([levels.index(r.grade) for r in got])
    fit = [k for k, out in enumerate(held) if not out]
    w, t = fit_cumulative_link([rows[k] for k in fit], grade[fit], len(vocabulary))
    model = SeverityModel({vocabulary[k]: float(w[k]) for k in np.flatnonzero(w)}, t, 0.5)
    check = [k for k, out in enumerate(held) if out]
    severity = np.array([_sigmoid(w[rows[k]].sum() - t).sum() for k in check])
    model.cut = best_cut(severity, grade[check] > 0)
    return model


def severity(text: Column, model: SeverityModel) -> Column:
    """Struct of severity (expected grade), p_toxic (P(grade >= 1)) and toxic (severity at or above the cut).

    Whole texts count. A null text, or one without words, has severity 0.
    """

    @F.pandas_udf("severity double, p_toxic double, toxic boolean")
    def grade(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            over = [model.exceed(t) for t in part]
            expected = [float(p.sum()) for p in over]
            yield pd.DataFrame(
                {
                    "severity": expected,
                    "p_toxic": [float(p[0]) if len(p) else 0.0 for p in over],
                    "toxic": [s >= model.cut and s > 0 for s in expected],
                }
            )

    return grade(text)
