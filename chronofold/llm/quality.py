r"""Quality by ordinal cumulative-link regression on graded ratings.

Ratings are grades 0 < 1 < 2; here 0 is toxic, 1 poor, 2 good. One score, the sum of shared
hashed-text weights over a text, is set against ordered thresholds:
``P(grade > k) = sigmoid(score - threshold_k)``. The expected grade is the sum of these, and
the tail probability ``P(grade >= select_from)`` decides the selection.

A text's features are the distinct hashes of its words as they stand, of its words in lower
case without other characters, and of binned measures of form (share of capitals, of
characters that are no letters, of repeated words and lines). Presence counts, not
frequency, so one word can weigh in a long text.

Weights and thresholds are learned together by AdaGrad in numpy from at most about
``per_grade`` rated texts of each grade, chosen by a hash of the id, of each at most
``sample_chars`` characters from a place chosen by the hash: so the driver holds at most some
3 * 3,000 * 8,000 characters. Rows whose crc32(id) mod 5 is 0 are held out, never learned
from. Features are screened first: one stays if ``least_texts`` of the texts have it (one in
fifty where these are few) and for one of the thresholds the share of these above it lies ``least_z``
standard errors or more from that of all, so that words which happen to stand in a few rated texts don't drown those that tell. Thresholds keep their order as the first plus positive
steps. Every text is scored whole.

A null text counts as empty. Ratings that are null, or of ids without a text, are not
learned from; of several ratings of an id each counts. Without ratings every score is 0.
Repeated rows are each scored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.llm.common import OWN, map_texts, sampled

BUCKETS = 1 << 18
PER_GRADE = 3000
SAMPLE_CHARS = 8000
GRADES = 3
LEAST_TEXTS, LEAST_Z = 8, 4.0
_LETTERS = bytes(b if chr(b).isalpha() or b >= 128 else 32 for b in range(256))
_CAPITALS = re.compile(rb"[A-Z]+")
_hash = xxhash.xxh32_intdigest


def _bin(share: float) -> int:
    return min(int(share * 20), 20)


def features(text: str | None) -> np.ndarray:
    """Distinct buckets of a text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    raw = data.split()
    lower = data.translate(_LETTERS).lower().split()
    tokens = set(raw) | set(lower)
    out = {_hash(t) % BUCKETS for t in tokens}
    lines = data.split(b"\n")
    form = (
        sum(map(len, _CAPITALS.findall(data))) / max(1, len(data)),
        1 - sum(map(len, lower)) / max(1, len(data)),
        1 - len(set(lower)) / max(1, len(lower)),
        1 - len(set(lines)) / len(lines),
        1 - len(lower) / max(1, len(raw)) if len(lower) < len(raw) else 0.0,
    )
    out |= {_hash(f"form {i} {_bin(x)}") % BUCKETS for i, x in enumerate(form)}
    return np.fromiter(out, np.int64, len(out))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray  # ascending

    def tails(self, text: str | None) -> np.ndarray:
        """P(grade >= k) for k from 1."""
        return sigmoid(self.weights[features(text)].sum(dtype=np.float64) - self.thresholds)


def train(texts: list[str], grades: list[int], epochs: int = 8, rate: float = 1.0, decay: float = 1e-3, seed: int = 11, least_texts: int = LEAST_TEXTS, least_z: float = LEAST_Z, counts: dict[int, int] | None = None) -> Model:
    w, past = np.zeros(BUCKETS), np.full(BUCKETS, 1e-2)
    steps = np.full(GRADES - 1, 1.0)  # the first threshold, then the logarithms of the steps to the next
    steps[0], steps[1:] = -1.0, 0.0
    past_steps = np.full(GRADES - 1, 1.0)
    rng, data = np.random.default_rng(seed), [features(t) for t in texts]
    y = np.asarray(grades)
    if data:
        having = np.concatenate(data)
        many = np.bincount(having, minlength=BUCKETS)
        telling = np.zeros(BUCKETS, bool)
        for k in range(GRADES - 1):
            above = (y > k).astype(float)
            share = np.bincount(having, weights=np.repeat(above, [len(x) for x in data]), minlength=BUCKETS) / np.maximum(many, 1)
            telling |= np.abs(share - above.mean()) * np.sqrt(many) >= least_z * above.std()
        telling &= many >= min(least_texts, 1 + len(data) // 50)
        data = [x[telling[x]] for x in data]
    share = np.ones(GRADES) if counts is None else np.array([counts.get(g, 0) / max(1, (y == g).sum()) for g in range(GRADES)])
    share = share / max(1e-9, share[y].mean()) if len(y) else share  # grades weigh as in the corpus, not as drawn
    for _ in range(epochs if len(data) else 0):
        for i in rng.permutation(len(data)):
            x, g = data[i], y[i]
            cuts = np.cumsum(np.concatenate((steps[:1], np.exp(steps[1:]))))
            p = sigmoid(w[x].sum() - cuts)  # P(grade > k)
            up = 1.0 if g == 0 else p[g - 1]
            down = p[g] if g < GRADES - 1 else 0.0
            mass = max(up - down, 1e-9)
            d_up = 0.0 if g == 0 else up * (1 - up)
            d_down = down * (1 - down) if g < GRADES - 1 else 0.0
            k = -share[g] / mass
            slope = k * (d_up - d_down)  # of the loss by the score
            grad = slope + decay * w[x]
            past[x] += grad * grad
            w[x] -= rate * grad / np.sqrt(past[x]) / np.sqrt(max(1, len(x)))
            by_cut = np.zeros(GRADES - 1)
            if g > 0:
                by_cut[g - 1] -= k * d_up
            if g < GRADES - 1:
                by_cut[g] += k * d_down
            by_step = np.cumsum(by_cut[::-1])[::-1].copy()
            by_step[1:] *= np.exp(steps[1:])
            past_steps += by_step * by_step
            steps -= rate * by_step / np.sqrt(past_steps)
    return Model(w.astype(np.float32), np.cumsum(np.concatenate((steps[:1], np.exp(steps[1:])))))


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, ratings: DataFrame, grade: Column, id_col: str = "doc_id", text_col: str = "text", per_grade: int = PER_GRADE, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Draws the sample and trains on the driver. ``ratings`` has the id; ``grade`` is an expression over it, 0 to 2."""
    rated = ratings.select(F.col(id_col).alias(f"{OWN}id"), grade.cast("int").alias(f"{OWN}grade")).where(F.col(f"{OWN}grade").between(0, GRADES - 1) & F.col(f"{OWN}id").isNotNull() & ~held_out(f"{OWN}id"))
    counts = {r[0]: r[1] for r in rated.groupBy(f"{OWN}grade").count().collect()}
    key = F.xxhash64(F.lit("quality"), F.col(f"{OWN}id").cast("string"))
    draw, share = F.pmod(key, F.lit(1 << 30)), F.lit(0)
    for g, n in sorted(counts.items()):
        share = F.when(F.col(f"{OWN}grade") == g, F.lit(min(1 << 30, (per_grade << 30) // n))).otherwise(share)
    # At most about GRADES * per_grade rows of two numbers, so they go to every task.
    drawn = F.broadcast(rated.where(draw < share))
    rows = docs.where(F.col(text_col).isNotNull()).join(drawn, F.col(id_col) == F.col(f"{OWN}id")).select(f"{OWN}id", sampled(F.col(text_col), key, sample_chars), f"{OWN}grade").collect()
    rows = sorted((str(r[0]), r[1], r[2]) for r in rows)
    return train([t for _, t, _ in rows], [g for _, _, g in rows], counts=counts)


def rate(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", select_from: int = 2, least: float = 0.5) -> DataFrame:
    """(id, held_out, expected_grade, p_ge1, p_ge2, selected) of every row."""

    def columns(texts: list[str | None]) -> dict[str, list]:
        t = [model.tails(x) for x in texts]
        return {
            "expected_grade": [float(x.sum()) for x in t],
            **{f"p_ge{k + 1}": [float(x[k]) for x in t] for k in range(GRADES - 1)},
            "selected": [bool(x[select_from - 1] >= least) for x in t],
        }

    tails = ", ".join(f"p_ge{k + 1} double" for k in range(GRADES - 1))
    rated = map_texts(docs, columns, f"expected_grade double, {tails}, selected boolean", keep=(id_col,), text=text_col)
    return rated.select(id_col, held_out(id_col).alias("held_out"), *rated.columns[1:])


def grade_of(quality: str = "quality", toxic: str = "toxic") -> Column:
    """0 toxic, 1 poor, 2 good; null where a rating is missing."""
    return F.when(F.col(toxic) == 1, 0).when((F.col(toxic) == 0) & (F.col(quality) == 0), 1).when((F.col(toxic) == 0) & (F.col(quality) == 1), 2)
