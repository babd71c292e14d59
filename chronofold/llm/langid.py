r"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is lower-cased, everything but letters becomes a space, and its UTF-8 bytes give
n-grams of 2 to 4 bytes (word edges included) that are hashed into buckets. The text's vector
is the mean of its buckets' embeddings; a linear layer and softmax over it give the
languages. Embeddings and layer are trained together by stochastic gradient descent in numpy,
on pieces of the sampled texts so that short texts are known too.

Since the layer is linear, a trained model is one table: each bucket's embedding times the
layer. A prediction is the mean of the table's rows over a text's n-grams, whole text,
whatever its length, in blocks of bounded size.

The softmax has one output more, for what is none of the languages. It learns from texts made
of the sample itself (``unlike``): letters shuffled within a text, random letters, letters of
alphabets that the sample doesn't have, encoded bytes. A prediction is the likeliest language,
its score that language's probability beside all others and that output.

Rejection is calibrated on a fifth of the sample that is not trained on, cut into pieces of
all lengths, and texts made unlike of it: a temperature is fitted to their likelihood, and the
threshold lies between the score that at most ``accept_share`` of the unlike texts reach and the one
that all but ``reject_share`` of the like ones reach; where the two cross, the like ones go
first. Between them it takes a quarter of the way up from the unlike ones. A text without a
letter has language ``und``, score 0, and is rejected. A language that the sample doesn't have but
that looks like one of its languages isn't told apart.

Only rows with text and language whose crc32(id) mod 5 is not 0 are learned from, at most
about ``per_language`` of each of the ``languages`` most frequent languages, chosen by a hash of the id,
of each at most ``sample_chars`` characters from a place chosen by the hash; so the driver holds at most
some 64 * 400 * 20,000 characters. With none, every text is ``und``. Null ids are predicted and
never learned from. Repeated rows are each predicted.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm.common import OWN, map_texts, sampled

BUCKETS = 1 << 16
DIM = 16
SIZES = (2, 3, 4)
PER_LANGUAGE = 400
LANGUAGES = 64
SAMPLE_CHARS = 20_000
REJECT_SHARE, ACCEPT_SHARE = 0.001, 0.01
UND = "und"
_BLOCK = 1 << 20
_SPACE = bytes(b if chr(b).isalpha() or b >= 128 else 32 for b in range(256))


def normal(text: str) -> bytes:
    """Lower-cased letters, single spaces, a space at both ends."""
    return b" " + b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_SPACE).split()) + b" "


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def ngrams(data: np.ndarray) -> list[np.ndarray]:
    """For each size, the bucket of the n-gram at each byte."""
    out, h = [], data.astype(np.uint32)
    for n in range(2, max(SIZES) + 1):
        h = h[:-1] * np.uint32(0x01000193) + data[n - 1 :]
        if n in SIZES:
            mixed = (h ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
            out.append((mixed >> np.uint32(32 - 16)).astype(np.int32))
    return out


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # [bucket, language, and at last what is none of them]
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, text: str) -> np.ndarray:
        """Means over the n-grams of the whole text, block by block."""
        data = np.frombuffer(normal(text), np.uint8)
        total, count = np.zeros(len(self.bias)), 0
        for a in range(0, len(data), _BLOCK):
            for h in ngrams(data[a : a + _BLOCK + max(SIZES) - 1]):
                h = h[:_BLOCK]
                total += self.table.take(h, axis=0).sum(axis=0, dtype=np.float64) if len(h) < 4096 else _summed(self.table, h)
                count += len(h)
        return total / max(count, 1) + self.bias

    def scores(self, text: str) -> np.ndarray:
        z = self.logits(text) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score, whether it is accepted."""
        if not self.languages or not has_letter(text):
            return UND, 0.0, False
        p = self.scores(text)
        i = int(p[: len(self.languages)].argmax())
        return self.languages[i], float(p[i]), bool(p[i] >= self.threshold)


def _summed(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The same sum for long texts, through counts of the buckets."""
    return np.bincount(h, minlength=len(table)).astype(np.float64) @ table


def pieces(texts: list[str], languages: list[int], size: int, rng: np.random.Generator) -> list[tuple[np.ndarray, int]]:
    """Training examples: every byte of every text, cut into pieces of about ``size`` and shorter."""
    out = []
    for t, y in zip(texts, languages, strict=True):
        data, a = np.frombuffer(normal(t), np.uint8), 0
        while a < len(data):
            n = int(rng.integers(20, 2 * size))
            if len(data[a : a + n]) > max(SIZES):
                out.append((np.concatenate(ngrams(data[a : a + n])), y))
            a += n
    return out


#: First code points and sizes of alphabets: Latin, Greek, Cyrillic, Hebrew, Arabic, Devanagari, Thai, kana, Han, Hangul.
ALPHABETS = ((0x61, 26), (0x3B1, 25), (0x430, 32), (0x5D0, 27), (0x628, 35), (0x915, 37), (0xE01, 46), (0x3042, 80), (0x4E00, 3000), (0xAC00, 3000))


def unlike(texts: list[str], rng: np.random.Generator) -> list[str]:
    """For each text one that is no language's: its letters shuffled, replaced by random ones, or encoded bytes.

    The random ones are of an alphabet that is in none of the texts, or Latin.
    """
    seen = {c for t in texts for c in set(t.lower())}
    foreign = [a for a in ALPHABETS if not any(chr(a[0] + k) in seen for k in range(a[1]))]
    out = []
    for t in texts:
        letters = np.array([c.isalpha() for c in t], bool)
        at, kind = np.flatnonzero(letters), int(rng.integers(4))
        chars = np.array(list(t), dtype="<U1")
        if kind == 0:
            chars[at] = chars[at][rng.permutation(len(at))]
        elif kind == 3:
            data = base64.b64encode(rng.bytes(max(1, 3 * len(t) // 4))).decode()
            step = int(rng.integers(8, 80))
            out.append(" ".join(data[i : i + step] for i in range(0, len(data), step)))
            continue
        else:
            first, size = foreign[int(rng.integers(len(foreign)))] if kind == 2 and foreign else ALPHABETS[0]
            chars[at] = [chr(c) for c in first + rng.integers(0, size, len(at))]
        out.append("".join(chars))
    return out


def train(
    texts: list[str], labels: list[str], epochs: int = 3, rate: float = 4.0, batch: int = 128, seed: int = 7, reject_share: float = REJECT_SHARE, accept_share: float = ACCEPT_SHARE
) -> Model:
    """Fits on four fifths of the texts and calibrates on the rest; a single text is both."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    none = len(languages)
    y = [languages.index(x) for x in labels]
    rng = np.random.default_rng(seed)
    held = rng.permutation(len(texts))[: max(1, len(texts) // 5)]
    aside = set(held.tolist()) if len(texts) > 1 else set()
    like = [i for i in range(len(texts)) if i not in aside]
    made = unlike([texts[i] for i in like], rng)
    # As many examples of none as of a language.
    made = [made[k] for k in rng.permutation(len(made))[: max(1, len(made) // none)]]
    examples = pieces([texts[i] for i in like] + made, [y[i] for i in like] + [none] * len(made), 600, rng)
    e = rng.normal(0, 0.1, (DIM, BUCKETS))
    w, b = rng.normal(0, 0.1, (DIM, none + 1)), np.zeros(none + 1)
    steps = max(1, epochs * -(-len(examples) // batch))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(examples))
        for a in range(0, len(order), batch):
            some = [examples[i] for i in order[a : a + batch]]
            ids = np.concatenate([s[0] for s in some])
            n = np.array([len(s[0]) for s in some])
            first = np.cumsum(n) - n
            hidden = np.add.reduceat(e[:, ids], first, axis=1) / n  # [dim, example]
            z = hidden.T @ w + b
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(some)), [s[1] for s in some]] -= 1
            lr = rate * (1 - step / steps) / len(some)
            back = (w @ p.T) / n  # [dim, example]
            w -= lr * hidden @ p
            b -= lr * p.sum(axis=0)
            spread = np.repeat(back, n, axis=1)
            for d in range(DIM):
                e[d] -= lr * 50 * np.bincount(ids, weights=spread[d], minlength=BUCKETS)
            step += 1
    model = Model(languages, (e.T @ w).astype(np.float32), b)

    def cut(t: str) -> str:
        n = int(rng.choice((40, 150, 600, len(t)))) if len(t) > 40 else len(t)
        first = int(rng.integers(0, max(1, len(t) - n + 1)))
        return t[first : first + n]

    # Texts without a letter are no question of calibration.
    checks = [(c, y[i]) for i in held.tolist() for c in (texts[i], cut(texts[i]), cut(texts[i])) if has_letter(c)]
    checks += [(c, none) for t in unlike([texts[i] for i in held.tolist() for _ in range(3)], rng) if has_letter(c := cut(t))]
    if not checks:
        return model
    z = np.array([model.logits(t) for t, _ in checks])
    true = np.array([k for _, k in checks])

    def loss(t: float) -> float:
        s = z / t
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(true)), true]).mean())

    model.temperature = min((0.05 * 1.25**k for k in range(24)), key=loss)
    p = np.exp((z - z.max(axis=1, keepdims=True)) / model.temperature)
    best = (p / p.sum(axis=1, keepdims=True))[:, :none].max(axis=1)
    low = float(np.quantile(best[true < none], reject_share)) if (true < none).any() else 0.0
    high = float(np.quantile(best[true == none], 1 - accept_share)) if (true == none).any() else 0.0
    model.threshold = low if high >= low else high + (low - high) / 4
    return model


def learnable(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    return docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & (F.crc32(F.col(id_col).cast("string")) % 5 != 0))


def fit(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE,
    languages: int = LANGUAGES, sample_chars: int = SAMPLE_CHARS, reject_share: float = REJECT_SHARE,
) -> Model:
    """Draws the sample and trains on the driver."""
    rows = learnable(docs, id_col, text_col, lang_col)
    counts = rows.groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()
    key = F.xxhash64(F.lit("langid"), F.col(id_col).cast("string"))
    share = F.lit(0)
    for r in sorted(counts):
        share = F.when(F.col(lang_col) == r.lang, F.lit(min(1 << 30, (per_language << 30) // r.n))).otherwise(share)
    drawn = rows.where(F.pmod(key, F.lit(1 << 30)) < share).select(F.col(id_col).cast("string"), sampled(F.col(text_col), key, sample_chars), lang_col)
    sample = sorted(tuple(r) for r in drawn.collect())
    return train([t for _, t, _ in sample], [lang for _, _, lang in sample], reject_share=reject_share)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """``keep`` (the id), lang_pred, score and accepted for every row."""

    def columns(texts: list[str | None]) -> dict[str, list]:
        got = [model.predict(t) for t in texts]
        return {"lang_pred": [g[0] for g in got], "score": [g[1] for g in got], "accepted": [g[2] for g in got]}

    return map_texts(docs, columns, "lang_pred string, score double, accepted boolean", keep=keep or (id_col,), text=text_col)


def predict_all(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score, accepted) of every row, by a model learned from the rows not held out."""
    found = identify(docs, fit(docs, id_col, text_col, lang_col), id_col, text_col)
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))
    return found.select(id_col, held.alias("held_out"), "lang_pred", "score", "accepted")


def keep_accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows whose language is accepted; same columns, in one pass."""

    def columns(texts: list[str | None]) -> dict[str, list]:
        return {f"{OWN}text": texts, f"{OWN}ok": [model.predict(t)[2] for t in texts]}

    rest = tuple(c for c in docs.columns if c != text_col)
    found = map_texts(docs, columns, f"{OWN}text string, {OWN}ok boolean", keep=rest, text=text_col)
    return found.where(f"{OWN}ok").select(*(F.col(f"{OWN}text").alias(c) if c == text_col else F.col(c) for c in docs.columns))
