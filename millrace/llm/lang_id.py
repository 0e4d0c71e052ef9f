"""Language identification with a blended-spectrum presence kernel.

The kernel of two texts is the count of n-grams (1 to 3 letters, with blanks at word ends) that are present in both, divided
by the geometric mean of how many each of them has. Landmark texts Z give Nyström features K(x, Z) K(Z, Z)^-1/2, on which one
ridge regression a language is fitted. As K(x, Z) is itself a product of presence rows, the landmarks' rows, the root and the
regressions fold into one weight a language for every n-gram of the landmarks: a batch is scored by the product of its
(sparse) presence rows with those weights.

Letters are lower-cased code points of any script, all others count as blanks; an n-gram is named by its code points, so
large scripts are told apart as small ones are.

The classifier is fitted on a bounded sample of the labelled rows: about ``per_lang`` rows of each language, those with the least
hash of the id, of texts up to ``SAMPLE_CHARS`` characters; at most ``MAX_LANGS`` languages (more is an error) with
``MAX_LANDMARKS`` landmarks together. Everything else covers all rows and whole texts.

Edge cases: a null text or one without a letter is ``und`` with score 0, as is every text where nothing can be learned (no
labelled rows); a text none of whose n-grams a landmark has gets a language with score 0; ties go to the language that comes
first in order; repeated rows get equal predictions (and may all be in the sample); rows with a null doc_id or null lang
aren't learned from; texts of any length are read whole; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.llm.bpe import forget

PER_LANG = 300
LANDMARKS_PER_LANG, MAX_LANDMARKS = 40, 2048
MAX_LANGS = 256
SAMPLE_CHARS = 100_000
RIDGE = 0.01
#: Sharpness of the softmax that turns regression values to scores.
SHARPNESS = 8.0
#: Texts of a product, and characters after which a batch is closed early.
BATCH_TEXTS, BATCH_CHARS = 128, 1_000_000
#: Columns of presence rows that are dense at once while fitting.
_COLUMNS = 1 << 15
_SHIFT = np.int64(21)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")


@cache
def _letters() -> np.ndarray:
    return np.array([i if chr(i).isalpha() else 0 for i in range(0x110000)], np.int64)


def grams(text: str) -> np.ndarray:
    """The distinct n-grams of 1 to 3 letters, as code points of 21 bits each; runs of blanks count as one, and a blank alone
    is none."""
    codes = np.concatenate(([0], _letters()[_points(text)], [0]))
    codes = codes[np.concatenate(([True], (codes[1:] | codes[:-1]) != 0))]
    two = (codes[:-1] << _SHIFT) + codes[1:]
    three = (two[:-1] << _SHIFT) + codes[2:]
    # 21 bits hold 0x110000 and more: marks keep " a" (two) apart from "a" (one).
    mark = np.int64(0x110000)
    two[codes[:-1] == 0] += mark << _SHIFT
    three[codes[:-2] == 0] += mark << (2 * _SHIFT)
    return np.unique(np.concatenate((codes[codes > 0], two, three)))


class Vocabulary:
    """Places of n-grams in a sorted array, by open addressing: most are found with one look."""

    def __init__(self, known: np.ndarray):
        self.bits = max(4, int(4 * len(known)).bit_length())
        self.keys, self.places = np.zeros(1 << self.bits, np.int64), np.full(1 << self.bits, -1, np.int32)
        left, at = np.arange(len(known)), self._slot(known)
        while len(left):
            free = self.keys[at] == 0
            self.keys[at[free]] = known[left[free]]
            won = self.keys[at] == known[left]
            self.places[at[won]] = left[won]
            left, at = left[~won], (at[~won] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * _ODD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key; -1 for unknown ones."""
        out, left, at = np.full(len(keys), -1, np.int32), np.arange(len(keys)), self._slot(keys)
        while len(left):
            there = self.keys[at]
            hit = there == keys[left]
            out[left[hit]] = self.places[at[hit]]
            more = ~hit & (there != 0)
            left, at = left[more], (at[more] + 1) & ((1 << self.bits) - 1)
        return out


class Model(NamedTuple):
    langs: list[str]
    #: The landmarks' n-grams, sorted; what each adds to the languages' values, and what all texts start from.
    grams: np.ndarray
    weights: np.ndarray
    bias: np.ndarray


class Scorer:
    """A model in a worker."""

    def __init__(self, model: Model):
        self.model, self.places = model, Vocabulary(model.grams)

    def values(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The regression value of each language, and the share of each text's n-grams that landmarks have."""
        own = [grams(t) for t in texts]
        sizes = np.array([max(len(g), 1) for g in own])
        found = self.places(np.concatenate(own))
        row = np.repeat(np.arange(len(own)), [len(g) for g in own])[found >= 0]
        found = found[found >= 0]
        known = np.bincount(row, minlength=len(own))
        begins = np.concatenate(([0], np.cumsum(known)))
        # A last row of zeros keeps texts without known n-grams from borrowing the next text's.
        added = np.concatenate((self.model.weights[found], np.zeros((1, len(self.model.langs)))))
        sums = np.add.reduceat(added, begins[:-1], axis=0) if len(own) else added[:0]
        sums[known == 0] = 0
        return sums / np.sqrt(sizes)[:, None] + self.model.bias, known / sizes

    def __call__(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        values, evidence = self.values(texts)
        best = values.argmax(axis=1)
        shares = np.exp(SHARPNESS * (values - values.max(axis=1, keepdims=True)))
        # A text whose n-grams no landmark has gives no evidence for its best language, however long it is.
        return [self.model.langs[i] for i in best], np.clip(evidence / shares.sum(axis=1), 0, 1)


def _shared(a: list[np.ndarray], b: list[np.ndarray], width: int) -> np.ndarray:
    """How many places each of the sorted arrays of places ``a`` has in common with each of ``b``: products of presence
    rows, some columns at a time."""
    out = np.zeros((len(a), len(b)))

    def rows(of: list[np.ndarray], lo: int) -> np.ndarray:
        made = np.zeros((len(of), min(_COLUMNS, width - lo)), np.float32)
        for row, places in zip(made, of, strict=True):
            x, y = np.searchsorted(places, (lo, lo + made.shape[1]))
            row[places[x:y] - lo] = 1
        return made

    for lo in range(0, width, _COLUMNS):
        out += rows(a, lo) @ rows(b, lo).T
    return out


def fit(sample: list[tuple[str, str]], landmarks_per_lang: int = LANDMARKS_PER_LANG, ridge: float = RIDGE) -> Model | None:
    """A model of (text, language) pairs, or None without any."""
    sample = [(t, y) for t, y in sample if any(map(str.isalpha, t))]
    if not sample:
        return None
    langs = sorted({y for _, y in sample})
    each = max(1, min(landmarks_per_lang, MAX_LANDMARKS // len(langs)))
    marks = [grams(t) for lang in langs for t in [t for t, y in sample if y == lang][:each]]
    vocabulary = np.unique(np.concatenate(marks))
    places = Vocabulary(vocabulary)
    z = [np.searchsorted(vocabulary, m) for m in marks]
    z_own = np.sqrt([len(m) for m in marks])
    own = _shared(z, z, len(vocabulary)) / np.outer(z_own, z_own)
    values, vectors = np.linalg.eigh((own + own.T) / 2)
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    features = []
    for i in range(0, len(sample), BATCH_TEXTS):
        g = [grams(t) for t, _ in sample[i : i + BATCH_TEXTS]]
        at = [np.sort(p[p >= 0]) for p in map(places, g)]
        features.append(_shared(at, z, len(vocabulary)) / np.outer(np.sqrt([len(x) for x in g]), z_own) @ root)
    x = np.concatenate((np.concatenate(features), np.ones((len(sample), 1))), axis=1)
    y = np.array([[1.0 if lang == of else -1.0 for lang in langs] for _, of in sample])
    weigh = np.array([1 / sum(o == of for _, o in sample) for _, of in sample])[:, None] * len(sample) / len(langs)  # languages count alike
    penalty = ridge * len(sample) * np.eye(x.shape[1])
    penalty[-1, -1] = 1e-9
    w = np.linalg.solve(x.T @ (weigh * x) + penalty, x.T @ (weigh * y))
    on_marks = root @ w[:-1] / z_own[:, None]
    weights = np.zeros((len(vocabulary), len(langs)))
    for at, row in zip(z, on_marks, strict=True):
        weights[at] += row
    return Model(langs, vocabulary, weights, w[-1])


def training_sample(docs: DataFrame, learn: Column, id_col: str, text_col: str, lang_col: str, per_lang: int = PER_LANG) -> list[tuple[str, str]]:
    """About ``per_lang`` (text, language) rows of each language, at most so many where ids are distinct.

    A count of each language sets the bar that the hash of an id must stay under, a little higher than ``per_lang`` rows need;
    the driver gets those rows alone and keeps the least hashes. No language meets in one task.
    """
    rows = docs.where(learn & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & (F.length(text_col) <= SAMPLE_CHARS))
    counts = rows.groupBy(F.col(lang_col).cast("string").alias("y")).count().limit(MAX_LANGS + 1).collect()
    if len(counts) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    if not counts:
        return []
    wanted = per_lang + 6 * per_lang**0.5
    bars = F.create_map(*[F.lit(v) for r in counts for v in (r["y"], min(1.0, wanted / r["count"]))])
    least = F.shiftrightunsigned(F.xxhash64(id_col), 11) / F.lit(2.0**53)
    found = rows.where(least < F.element_at(bars, F.col(lang_col).cast("string")))
    by: dict[str, list[tuple]] = {}
    picked = found.select(least.alias("h"), F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("y"))
    # The limit only matters where an id stands in very many rows, which all have its hash.
    for r in picked.limit(2 * len(counts) * int(wanted)).collect():
        by.setdefault(r["y"], []).append((r["h"], r["i"], r["t"]))
    return [(t, y) for y in sorted(by) for _, _, t in sorted(by[y])[:per_lang]]


def identify(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: tuple[str, ...] = (), per_lang: int = PER_LANG) -> DataFrame:
    """doc_id, lang_pred, score (and, where named, the struct ``_row`` of the columns to keep): one row a document.

    ``learn`` says which rows may be learned from. Predictions look at the text alone.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(fit(training_sample(docs, learn, id_col, text_col, lang_col, per_lang)))
    carried = [F.struct(*keep).alias("_row")] if keep else []
    rows = docs.select(F.col(id_col).alias("doc_id"), F.when(F.col(text_col).rlike(r"\p{L}"), F.col(text_col)).alias("_text"), *carried)
    held = [f for f in rows.schema if f.name != "_text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        scorer = Scorer(model.value) if model.value else None
        for batch in batches:
            at = batch.schema.get_field_index("_text")
            texts = batch.column(at).to_pylist()
            langs, scores = ["und"] * len(texts), np.zeros(len(texts))
            for part in _parts([i for i, t in enumerate(texts) if t is not None and scorer], texts):
                found, sure = scorer([texts[i] for i in part])
                scores[part] = sure
                for i, lang in zip(part, found, strict=True):
                    langs[i] = lang
            others = [c for i, c in enumerate(batch.columns) if i != at]
            names = [n for n in batch.schema.names if n != "_text"]
            yield pa.RecordBatch.from_arrays([*others, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*names, "lang_pred", "score"])

    return rows.mapInArrow(run, StructType(held).add("lang_pred", "string").add("score", "double"))


def _parts(rows: list[int], texts: list[str]) -> Iterator[list[int]]:
    part, chars = [], 0
    for i in rows:
        part.append(i)
        chars += len(texts[i])
        if len(part) >= BATCH_TEXTS or chars >= BATCH_CHARS:
            yield part
            part, chars = [], 0
    if part:
        yield part
