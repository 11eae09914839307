"""Toxicity categories by a classifier chain over hashed words.

Categories are predicted one after the other; every linear model sees, beside the words of the
text, the probabilities of the categories before it. In training those are out-of-fold
predictions, so that a later model learns from probabilities of the kind it will meet.
The chain is fitted on a bounded sample of labelled rows; scoring covers every row, whole.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stancewright.llm.words import raw_texts

#: Labelled rows that the chain is fitted on at most; the only rows that reach the driver.
SAMPLE = 12_000
#: Log odds of a category that nothing was learnt about.
NEVER = -1_000.0
FOLDS = 5
DIMENSIONS = 1 << 18
#: Words per model, the ones most strongly tied to its category.
SELECTED = 1024
ROUNDS = 200
L2 = 1e-3

_BLANKED = bytes(range(33)) + bytes(b for b in range(33, 127) if not chr(b).isalnum()) + b"\x7f"
_TO_BLANK = bytes.maketrans(_BLANKED, b" " * len(_BLANKED))


def word_features(text: bytes) -> np.ndarray:
    """Sorted distinct hash values of the words, lower-cased, punctuation aside."""
    words = set(text.lower().translate(_TO_BLANK).split())
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    return np.unique(hashes % np.uint64(DIMENSIONS)).astype(np.int32)


class Rows:
    """Sparse 0/1 rows."""

    def __init__(self, features: list[np.ndarray]) -> None:
        self.n = len(features)
        self.row = np.repeat(np.arange(self.n, dtype=np.int32), [len(f) for f in features])
        self.column = np.concatenate([np.empty(0, np.int32), *features])

    def only(self, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and place in ``columns`` of the entries that are there."""
        place = np.searchsorted(columns, self.column)
        place = np.minimum(place, max(0, len(columns) - 1))
        hit = columns[place] == self.column if len(columns) else np.zeros(len(self.column), bool)
        return self.row[hit], place[hit]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Linear:
    """Logistic regression on selected words and on earlier probabilities."""

    columns: np.ndarray
    weights: np.ndarray
    chained: np.ndarray
    bias: float

    def predict(self, rows: Rows, earlier: np.ndarray) -> np.ndarray:
        row, place = rows.only(self.columns)
        z = np.bincount(row, self.weights[place], rows.n) if len(row) else np.zeros(rows.n)
        return _sigmoid(z + earlier @ self.chained + self.bias)


def _select(rows: Rows, truth: np.ndarray) -> np.ndarray:
    """Words by chi-squared with the truth; words of fewer than three rows tell nothing."""
    n, positive = len(truth), truth.sum()
    df = np.bincount(rows.column, minlength=DIMENSIONS)
    both = np.bincount(rows.column, truth[rows.row], DIMENSIONS)
    expected = df * positive / n
    spread = expected * (1 - positive / n) * (1 - df / n)
    score = np.where((df >= 3) & (spread > 0), (both - expected) ** 2 / np.maximum(spread, 1e-12), 0)
    # Ties go to the lower column.
    best = np.argsort(-score, kind="stable")[:SELECTED]
    return np.sort(best[score[best] > 0]).astype(np.int32)


def fit_linear(rows: Rows, earlier: np.ndarray, truth: np.ndarray) -> Linear:
    """Full-batch Adam on the log loss with a ridge penalty; no randomness.

    With one class only the model is a constant.
    """
    n = len(truth)
    share = min(max(truth.mean(), 0.5 / n), 1 - 0.5 / n)
    columns = _select(rows, truth)
    weights = np.zeros(len(columns) + earlier.shape[1] + 1)
    weights[-1] = np.log(share / (1 - share))
    if 0 < truth.sum() < n:
        row, place = rows.only(columns)
        k = len(columns)
        first, second = np.zeros_like(weights), np.zeros_like(weights)
        for step in range(1, ROUNDS + 1):
            z = np.bincount(row, weights[:k][place], n) + earlier @ weights[k:-1] + weights[-1]
            gap = (_sigmoid(z) - truth) / n
            gradient = np.concatenate([np.bincount(place, gap[row], k), earlier.T @ gap, [gap.sum()]])
            gradient[:-1] += L2 * weights[:-1] / np.sqrt(n)
            first = 0.9 * first + 0.1 * gradient
            second = 0.99 * second + 0.01 * gradient**2
            weights -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-10)
    return Linear(columns, weights[: len(columns)], weights[len(columns) : -1], float(weights[-1]))


@dataclass
class Chain:
    """Fitted models in the order of their categories, and the cut for the last one."""

    categories: list[str]
    models: list[Linear] = field(default_factory=list)
    cut: float = 0.5

    def predict(self, features: list[np.ndarray]) -> np.ndarray:
        rows, found = Rows(features), np.zeros((len(features), 0))
        for model in self.models:
            found = np.column_stack([found, model.predict(rows, found)])
        return found


def best_cut(probability: np.ndarray, truth: np.ndarray) -> float:
    """Middle of the gap at which F1 on out-of-fold predictions is largest; 0.5 with one class."""
    order = np.argsort(-probability, kind="stable")
    p, hits = probability[order], np.cumsum(truth[order])
    last = np.append(p[1:] < p[:-1], True)
    f1 = np.where(last, 2 * hits / (np.arange(1, len(p) + 1) + truth.sum()), -1)
    if not 0 < truth.sum() < len(truth):
        return 0.5
    at = int(f1.argmax())
    return float((p[at] + p[at + 1]) / 2) if at + 1 < len(p) else float(p[at] / 2)


def fit_chain(features: list[np.ndarray], truths: Mapping[str, np.ndarray], folds: int = FOLDS) -> Chain:
    """The chain over ``truths``, in their order. Folds go by place in the list.

    Without rows there is no model to fit, which is an error.
    """
    if not features:
        raise ValueError("no labelled row to fit the chain on")
    n = len(features)
    fold = np.arange(n) % min(folds, n)
    whole, chain, earlier = Rows(features), Chain(list(truths)), np.zeros((n, 0))
    for truth in truths.values():
        truth = np.asarray(truth, float)
        chain.models.append(fit_linear(whole, earlier, truth))
        out = np.full(n, truth.mean())
        for f in range(min(folds, n)) if n > 1 else ():
            inside, outside = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            model = fit_linear(Rows([features[i] for i in inside]), earlier[inside], truth[inside])
            out[outside] = model.predict(Rows([features[i] for i in outside]), earlier[outside])
        earlier = np.column_stack([earlier, out])
        last = (out, truth)
    chain.cut = best_cut(*last)
    return chain


def train_chain(
    docs: DataFrame, labels: DataFrame, categories: Mapping[str, Column], id_col: str = "doc_id",
    text_col: str = "text", sample: int = SAMPLE,
) -> Chain:
    """A chain fitted on ``labels`` joined with their texts.

    ``categories`` are 0/1 columns over the columns of ``labels`` and ``text``, the last one the
    verdict. Rows for which one is NULL are left out. Where an id has several texts or labels,
    one is taken, the largest. At most ``sample`` labelled ids are used, chosen by a hash of
    the id; their hashed words, not the texts, come to the driver. Columns of ``labels`` called
    ``text`` or ``_id`` are not read. Without a labelled text the chain gives every text a probability of
    0 and rejects none.
    """
    rest = [c for c in labels.columns if c not in (id_col, "text", "_id")]
    picked = (
        labels.where(F.col(f"`{id_col}`").isNotNull())
        .groupBy(F.col(f"`{id_col}`").alias("_id")).agg(*[F.max(f"`{c}`").alias(c) for c in rest])
        .orderBy(F.xxhash64("_id"), "_id").limit(sample)
    )
    texts = docs.select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    # The sample is bounded by its parameter.
    rows = texts.join(F.broadcast(picked), "_id").select(
        "_id", "text", *[c.cast("int").alias(f"_y{i}") for i, c in enumerate(categories.values())]
    ).dropna()
    truths = [f"_y{i}" for i in range(len(categories))]

    def hashed(batches):
        for batch in batches:
            features = [word_features(t).tobytes() for t in raw_texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(features, pa.binary()), *batch.columns[2:]],
                names=["_id", "words", *truths],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    found = rows.mapInArrow(hashed, f"_id {kind}, words binary, {', '.join(f'{t} int' for t in truths)}")
    ordered = sorted(map(tuple, found.collect()))
    ordered = [r for r, after in zip(ordered, [*ordered[1:], (None,)]) if r[0] != after[0]]
    ordered.sort(key=lambda r: xxhash.xxh3_64_intdigest(repr(r[0])))
    if not ordered:
        none = np.empty(0, np.int32)
        return Chain(list(categories), [Linear(none, np.empty(0), np.zeros(i), NEVER) for i in range(len(categories))])
    return fit_chain(
        [np.frombuffer(bytes(r[1]), np.int32) for r in ordered],
        {name: np.array([r[2 + i] for r in ordered]) for i, name in enumerate(categories)},
    )


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, a probability per category, and ``rejected``.

    A NULL or empty text has no words and gets what the chain says of such a text. Repeated
    rows get the same result each; an empty table gives an empty one; other columns are not
    read.
    """
    names = [f"p_{c}" for c in chain.categories]
    kind = docs.schema[id_col].dataType.simpleString()

    def apply(batches):
        for batch in batches:
            found = chain.predict([word_features(t) for t in raw_texts(batch.column(1))])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(found[:, i]) for i in range(len(names))),
                 pa.array(found[:, -1] >= chain.cut)],
                names=[id_col, *names, "rejected"],
            )

    columns = ", ".join(f"`{n}` double" for n in names)
    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(
        apply, f"`{id_col}` {kind}, {columns}, rejected boolean"
    )


def keep_accepted(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """``docs``, all columns, without the rows that the chain rejects. No shuffle."""
    place = docs.columns.index(text_col)

    def keep(batches):
        for batch in batches:
            found = chain.predict([word_features(t) for t in raw_texts(batch.column(place))])
            yield batch.filter(pa.array(found[:, -1] < chain.cut))

    return docs.mapInArrow(keep, docs.schema)
