"""Sampling documents towards target shares of several margins.

Token counts are summed into cells of all margins, iterative proportional fitting rakes the
cells to the target shares, and each document is drawn with a probability in proportion to the
weight of its cell. Every value of a margin has a share of its own. Up to ``CELLS_HERE`` cells
are raked on the driver, more of them in Spark, where a round leaves one factor per value of
each margin behind and no cell comes to the driver; both give the same weights.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stancewright.llm.scratch import unused, written

#: Cells that are raked on the driver at most.
CELLS_HERE = 100_000
OTHER = "<other>"
MISSING = "<none>"
ROUNDS = 500
TOLERANCE = 1e-12
UNMET = "no target share of margin {} is on a value that occurs"
#: Hex digits of the digest that make up a row's uniform number.
DIGITS = 12
#: Blank and the control characters 9 to 13.
WHITE = r"[\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text; NULL has none."""
    words = F.split(F.coalesce(text, F.lit("")), WHITE)
    # Text that starts or ends with white space has an empty piece there.
    ends = F.when(F.get(words, F.lit(0)) == "", 1).otherwise(0) + F.when(
        (F.size(words) > 1) & (F.element_at(words, -1) == ""), 1
    ).otherwise(0)
    return (F.size(words) - ends).cast("long")


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) that follows from the seed and the key alone."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("double") / float(16**DIGITS)


def rake_cells(at: Sequence[np.ndarray], mass: np.ndarray, targets: Sequence[np.ndarray]) -> np.ndarray:
    """Mass of single cells fitted to the target shares; ``at`` has their places along each axis.

    Targets of values without mass cannot be met; what is left is spread over the others in
    proportion. Ends when all shares agree within ``TOLERANCE``, or after ``ROUNDS``.
    """
    total, fitted = mass.sum(), mass.astype(float)
    if not total:
        return fitted
    wanted = []
    for axis, (where, target) in enumerate(zip(at, targets)):
        target = np.where(np.bincount(where, mass, len(target)) > 0, target, 0.0)
        if not target.sum():
            raise ValueError(UNMET.format(axis))
        wanted.append((where, target / target.sum() * total))
    for _ in range(ROUNDS):
        worst = 0.0
        for where, target in wanted:
            now = np.bincount(where, fitted, len(target))
            factor = np.divide(target, now, out=np.zeros_like(now), where=now > 0)
            worst = max(worst, float(np.abs(factor[now > 0] - 1).max(initial=0)))
            fitted *= factor[where]
        if worst < TOLERANCE:
            break
    return fitted


def rake(mass: np.ndarray, targets: list[np.ndarray]) -> np.ndarray:
    """``rake_cells`` of a whole array."""
    at = np.nonzero(mass)
    fitted = np.zeros(mass.shape)
    fitted[at] = rake_cells(at, mass[at], targets)
    return fitted


def tempered(now: np.ndarray, power: float) -> np.ndarray:
    """Shares of a margin flattened by a power: 1 keeps them, 0 makes them equal."""
    raised = np.where(now > 0, np.maximum(now, 1e-300) ** power, 0)
    return raised / raised.sum() if raised.sum() else raised


def _weights_here(
    cells: DataFrame, columns: list[str], targets: list[Mapping[str, float] | None], power: float
) -> DataFrame:
    """``cells`` with their ``_weight``, raked on the driver."""
    rows = cells.collect()
    mass = np.array([r["t"] for r in rows], dtype=float)
    at, wanted = [], []
    for c, target in zip(columns, targets):
        place = {v: i for i, v in enumerate(sorted({r[c] for r in rows}))}
        at.append(np.array([place[r[c]] for r in rows], dtype=int))
        if target is None:
            wanted.append(tempered(np.bincount(at[-1], mass, len(place)), power))
        else:
            wanted.append(np.array([target.get(v, 0.0) for v in place]))
    weights = np.divide(rake_cells(at, mass, wanted), mass, out=np.ones_like(mass), where=mass > 0)
    table = [(*(r[c] for c in columns), r["t"], float(w)) for r, w in zip(rows, weights)]
    schema = ", ".join([*(f"{c} string" for c in columns), "t long, _weight double"])
    return cells.sparkSession.createDataFrame(table, schema)


def _weights_in_spark(
    cells: DataFrame, columns: list[str], targets: list[Mapping[str, float] | None], power: float
) -> DataFrame:
    """``cells`` with their ``_weight``, raked in Spark.

    The weight of a cell is the product of one factor per margin value, so a round writes only
    the factors. Factors and sums meet the cells in plain joins.
    """
    spark = cells.sparkSession
    massive = cells.where(F.col("t") > 0)
    total = massive.agg(F.sum("t").cast("double")).first()[0] or 0.0
    factors = []
    for axis, (c, target) in enumerate(zip(columns, targets)):
        margin = massive.groupBy(c).agg(F.sum("t").cast("double").alias("now"))
        if target is None:
            share = margin.select(c, F.pow("now", F.lit(power)).alias("share"))
        else:
            given = spark.createDataFrame([(v, float(x)) for v, x in target.items()], f"{c} string, share double")
            share = margin.join(given, c, "left").select(c, F.coalesce("share", F.lit(0.0)).alias("share"))
        share = written(share, "margin-shares")
        whole = share.agg(F.sum("share")).first()[0]
        if total and not whole:
            raise ValueError(UNMET.format(axis))
        factors.append(written(
            share.select(c, (F.col("share") / F.lit(whole or 1.0) * total).alias("want"), F.lit(1.0).alias("f"),
                         F.lit(0.0).alias("gap")),
            "margin-factors",
        ))

    def weighed(rows: DataFrame, how: str) -> DataFrame:
        product = F.lit(1.0)
        for i, (c, f) in enumerate(zip(columns, factors)):
            rows = rows.join(f.select(c, F.col("f").alias(f"_f{i}")), c, how)
            product = product * F.col(f"_f{i}")
        return rows.select(*columns, "t", product.alias("_weight"))

    for _ in range(ROUNDS if total else 0):
        worst = 0.0
        for axis, c in enumerate(columns):
            now = weighed(massive, "inner").groupBy(c).agg(F.sum(F.col("t") * F.col("_weight")).alias("now"))
            factor = F.when(F.col("now") > 0, F.col("want") / F.col("now")).otherwise(F.lit(0.0))
            factors[axis] = written(
                factors[axis].drop("gap").join(now, c).select(
                    c, "want", (F.col("f") * factor).alias("f"),
                    F.when(F.col("now") > 0, F.abs(factor - 1)).otherwise(F.lit(0.0)).alias("gap"),
                ),
                "margin-factors",
            )
            worst = max(worst, factors[axis].agg(F.max("gap")).first()[0])
        if worst < TOLERANCE:
            break
    # A cell without any token has weight 1, whatever the factors of its values are.
    return weighed(cells, "left").withColumn(
        "_weight", F.when(F.col("t") > 0, F.col("_weight")).otherwise(F.lit(1.0))
    )


@dataclass
class Mixture:
    """Fitted cells: the values of each margin that stand for themselves (None: all), and the weights."""

    margins: Mapping[str, Column]
    known: list[list[str] | None]
    cells: DataFrame

    def place(self, rows: DataFrame) -> tuple[DataFrame, Column, Column]:
        """``rows`` with columns added, and the weight and probability of the cell of each.

        The cells are a written table, so Spark knows their size: it broadcasts a small one.
        """
        names = {c: unused(rows.columns, c) for c in self.cells.columns}
        keys = {}
        for i, (margin, known) in enumerate(zip(self.margins.values(), self.known)):
            keys[names[f"_mix{i}"]] = _pooled(F.coalesce(margin.cast("string"), F.lit(MISSING)), known)
        placed = rows.withColumns(keys).join(self.cells.withColumnsRenamed(names), list(keys)).drop(*keys)
        return placed, F.col(names["_weight"]), F.col(names["_probability"])


def _pooled(value: Column, known: list[str] | None) -> Column:
    return value if known is None else F.when(value.isin(known), value).otherwise(F.lit(OTHER))


def _drawn(id_col: str, seed: int, probability: Column) -> Column:
    return uniform(F.col(f"`{id_col}`"), seed) < probability


def fit_mixture(
    docs: DataFrame, margins: Mapping[str, Column], targets: Mapping[str, Mapping[str, float]] | None = None,
    power: float = 0.7, rate: float = 1.0, text_col: str = "text", named: int | None = None,
) -> Mixture:
    """Weights of all cells, from the token counts of the whole table.

    ``margins`` are string columns such as source, language and topic. A margin has the
    shares given for it in ``targets``, or else its own shares of the tokens raised to
    ``power``. Values that ``targets`` leaves out are raked together as ``OTHER``; so are, only
    if ``named`` is given, those beyond the ``named`` ones with most tokens. The weight is fitted over observed mass, and the probability is ``rate`` times
    the weight over the largest weight: with ``rate`` 1 as large as it can be with no
    document above one, so that the expected shares are the targets.
    """
    columns = [f"_mix{i}" for i in range(len(margins))]
    values = [
        F.coalesce(m.cast("string"), F.lit(MISSING)).alias(c) for m, c in zip(margins.values(), columns)
    ]
    tokens = word_count(F.col(f"`{text_col}`")).alias("t")
    counts = written(
        docs.select(*values, tokens).groupBy(*columns).agg(F.sum("t").alias("t")), "tokens-by-cell"
    )
    known: list[list[str] | None] = []
    for m, c in zip(margins, columns):
        if targets and m in targets:
            known.append([v for v in sorted(targets[m]) if v != OTHER])
        elif named is not None:
            top = counts.groupBy(c).agg(F.sum("t").alias("t")).orderBy(F.desc("t"), c).limit(named)
            known.append(sorted(r[0] for r in top.collect()))
        else:
            known.append(None)
    cells = counts
    if any(k is not None for k in known):
        pooled = [_pooled(F.col(c), k).alias(c) for c, k in zip(columns, known)]
        cells = written(counts.select(*pooled, "t").groupBy(*columns).agg(F.sum("t").alias("t")), "pooled-cells")
    few = cells.count() <= CELLS_HERE
    given = [(targets or {}).get(m) for m in margins]
    weighed = written((_weights_here if few else _weights_in_spark)(cells, columns, given, power), "cell-weights")
    largest = weighed.where(F.col("t") > 0).agg(F.max("_weight")).first()[0] or 1.0
    probability = F.least(F.lit(1.0), F.lit(rate) * F.col("_weight") / F.lit(largest))
    return Mixture(margins, known, weighed.select(*columns, "_weight", probability.alias("_probability")))


def mix(
    docs: DataFrame, margins: Mapping[str, Column], id_col: str = "doc_id", text_col: str = "text",
    seed: int = 0, **fit,
) -> DataFrame:
    """One row per row of ``docs``: id, ``n_tokens``, ``weight``, ``probability``, ``kept``.

    See ``fit_mixture`` for the options. A document is kept if a hash of seed and id is below
    its probability, so repeated ids fall together. A NULL margin is a value of its own.
    Values that ``targets`` leaves out are raked together. NULL and empty texts add nothing to the fit and get the weight of their
    cell, or weight 1 in a cell without any token. Values with a target of zero are dropped by
    intent. An empty table gives an empty one; other columns are not read.
    """
    placed, weight, probability = fit_mixture(docs, margins, text_col=text_col, **fit).place(docs)
    return placed.select(
        F.col(f"`{id_col}`"), word_count(F.col(f"`{text_col}`")).alias("n_tokens"), weight.alias("weight"),
        probability.alias("probability"), _drawn(id_col, seed, probability).alias("kept"),
    )


def keep_sampled(
    docs: DataFrame, margins: Mapping[str, Column], id_col: str = "doc_id", seed: int = 0, **fit
) -> DataFrame:
    """``docs``, all columns, reduced to the rows that ``mix`` draws.

    The text is not shuffled while Spark broadcasts the cells.
    """
    placed, _, probability = fit_mixture(docs, margins, **fit).place(docs)
    return placed.where(_drawn(id_col, seed, probability)).select(*[F.col(f"`{c}`") for c in docs.columns])
