"""Scores of predictions against human labels.

Predictions come in long form, one row per post and label. Every score but the AUC on
continuous scores follows from counts of (truth, prediction), so one aggregate with
map-side combining serves all labels; there is no pass per label. Rows without truth or
prediction are not counted.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stancewright.schemas import col

_COUNTS = ["tn", "fp", "fn", "tp"]


def confusion(
    df: DataFrame,
    by: Sequence[str] = ("label",),
    truth: str = "ground_truth",
    pred: str = "prediction",
    positive: int = 1,
) -> DataFrame:
    """tn, fp, fn, tp per group."""
    t, p = col(truth) == positive, col(pred) == positive
    return df.groupBy(*[col(n) for n in by]).agg(
        F.count_if(~t & ~p).alias("tn"),
        F.count_if(~t & p).alias("fp"),
        F.count_if(t & ~p).alias("fn"),
        F.count_if(t & p).alias("tp"),
    )


def confusion_wide(df: DataFrame, pairs: Mapping[str, tuple[str, str]]) -> DataFrame:
    """The same from a wide table, ``{label: (truth column, prediction column)}``.

    All labels are counted in one aggregate over the unmultiplied rows; only its single
    result row is turned into one row per label.
    """
    counts = []
    for i, (truth, pred) in enumerate(pairs.values()):
        t, p = col(truth) == 1, col(pred) == 1
        cells = {"tn": ~t & ~p, "fp": ~t & p, "fn": t & ~p, "tp": t & p}
        counts += [F.count_if(hit).alias(f"{name}{i}") for name, hit in cells.items()]
    rows = F.array(
        *[
            F.struct(F.lit(label).alias("label"), *[col(f"{c}{i}").alias(c) for c in _COUNTS])
            for i, label in enumerate(pairs)
        ]
    )
    return df.agg(*counts).select(F.inline(rows))


def binary_scores(counts: DataFrame, undefined: str = "zero") -> DataFrame:
    """Accuracy, precision, recall, F1 and AUC of the hard prediction, from counts.

    ``undefined='zero'`` scores a precision, recall or F1 without a denominator as 0,
    ``'null'`` as NULL. The AUC of 0/1 predictions is the mean of the two class recalls;
    with one class only it is NULL.
    """
    if undefined not in ("zero", "null"):
        raise ValueError(f"undefined must be 'zero' or 'null', not {undefined!r}")
    tn, fp, fn, tp = (col(c).cast("double") for c in _COUNTS)

    def ratio(a: Column, b: Column) -> Column:
        value = F.try_divide(a, b)
        return F.coalesce(value, F.lit(0.0)) if undefined == "zero" else value

    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return counts.select(
        "*",
        F.try_divide(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        precision.alias("precision"),
        recall.alias("recall"),
        ratio(2 * precision * recall, precision + recall).alias("f1"),
        ((F.try_divide(tp, tp + fn) + F.try_divide(tn, tn + fp)) / 2).alias("roc_auc_hard"),
    )


def class_confusion(
    df: DataFrame,
    by: Sequence[str] = ("label",),
    truth: str = "ground_truth",
    pred: str = "prediction",
) -> DataFrame:
    """Rows per group, true class and predicted class.

    The counts, k * k per group for k classes, are laid out by group: what is derived from
    them needs no further shuffle.
    """
    keys = [col(n) for n in by]
    return (
        df.filter(col(truth).isNotNull() & col(pred).isNotNull())
        .groupBy(*keys, col(truth).alias("truth"), col(pred).alias("pred"))
        .agg(F.count(F.lit(1)).alias("n"))
        .repartition(*keys)
    )


def multiclass_scores(counts: DataFrame, by: Sequence[str] = ("label",)) -> DataFrame:
    """Accuracy and F1 weighted by true-class support, from ``class_confusion`` counts."""
    keys = [col(n) for n in by]
    n, none = col("n"), F.lit(0).cast("long")
    hit = F.when(col("truth") == col("pred"), n).otherwise(none)

    def seen(cls: str, support: Column, claimed: Column, tp: Column) -> Column:
        return F.struct(
            col(cls).alias("class"),
            support.alias("support"),
            claimed.alias("claimed"),
            tp.alias("tp"),
        )

    both = F.array(seen("truth", n, none, hit), seen("pred", none, n, none))
    f1 = F.try_divide(2.0 * col("tp"), col("support") + col("claimed"))
    per_class = (
        counts.select(*keys, F.inline(both))
        .groupBy(*keys, "class")
        .agg(*[F.sum(c).alias(c) for c in ("support", "claimed", "tp")])
        .withColumn("f1", F.coalesce(f1, F.lit(0.0)))
    )
    total = F.sum("support")
    return per_class.groupBy(*keys).agg(
        total.alias("n_rows"),
        F.count_if(col("support") > 0).alias("n_classes"),
        F.try_divide(F.sum("tp").cast("double"), total.cast("double")).alias("accuracy"),
        F.try_divide(F.sum(col("f1") * col("support")), total.cast("double")).alias("f1_weighted"),
    )


def weighted_f1(
    df: DataFrame,
    by: Sequence[str] = ("label",),
    truth: str = "ground_truth",
    pred: str = "prediction",
) -> DataFrame:
    return multiclass_scores(class_confusion(df, by, truth, pred), by)


def _ordered_pairs(sliced: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per group and slice: ``_pos``, ``_neg`` and ``_pairs``, the pairs in the right order that end in it.

    ``sliced`` has a row per group and ``_score`` with its ``_pos`` and ``_neg``, and the ``_slice`` of scores
    that it lies in. Each slice counts the pairs inside it; those across follow from slice totals.
    """
    keys = [col(n) for n in by]

    def pairs_below(order: str, within: Sequence[Column]) -> Column:
        below = Window.partitionBy(*within).orderBy(order).rowsBetween(
            Window.unboundedPreceding, -1
        )
        return col("_pos").cast("double") * F.coalesce(F.sum("_neg").over(below), F.lit(0))

    tied = col("_pos").cast("double") * col("_neg") / 2
    in_slice = (
        sliced.withColumn("_pairs", pairs_below("_score", [*keys, col("_slice")]) + tied)
        .groupBy(*keys, "_slice")
        .agg(*[F.sum(c).alias(c) for c in ("_pos", "_neg", "_pairs")])
    )
    return in_slice.withColumn("_pairs", col("_pairs") + pairs_below("_slice", keys))


def roc_auc(
    df: DataFrame,
    by: Sequence[str] = ("label",),
    truth: str = "ground_truth",
    score: str = "score",
) -> DataFrame:
    """Exact area under the ROC curve per group; tied scores count one half.

    The area is the share of (positive, negative) pairs ranked in the right order:

    1. equal scores of a group are counted together, combined map-side, so a score shared
       by a third of all rows is one row from there on;
    2. the counts are range-partitioned by (group, score): a group with very many distinct
       scores spreads over many slices, each an interval of scores;
    3. each slice counts the ordered pairs inside it;
    4. pairs across slices follow from the slice totals, a few rows per slice.

    Groups with a single class have no area and yield NULL.
    """
    keys = [col(n) for n in by]
    is_pos = col(truth) == 1
    counted = (
        df.filter(col(truth).isNotNull() & col(score).isNotNull())
        .groupBy(*keys, col(score).alias("_score"))
        .agg(F.count_if(is_pos).alias("_pos"), F.count_if(~is_pos).alias("_neg"))
    )
    sliced = counted.repartitionByRange(*keys, "_score").withColumn(
        "_slice", F.spark_partition_id()
    )

    across = _ordered_pairs(sliced, by)
    return across.groupBy(*keys).agg(
        F.sum("_pos").alias("n_pos"),
        F.sum("_neg").alias("n_neg"),
        F.try_divide(
            F.sum("_pairs"), F.sum("_pos").cast("double") * F.sum("_neg").cast("double")
        ).alias("roc_auc"),
    )


def roc_auc_macro(aucs: DataFrame) -> DataFrame:
    """Unweighted mean over the labels that have an area."""
    return aucs.agg(F.avg("roc_auc").alias("roc_auc_macro"), F.count("roc_auc").alias("n_labels"))


def _cells(df: DataFrame, by: Sequence[str], truth: str, pred: str | None, probs: str | None) -> DataFrame:
    """Rows counted by all that scores need, in one aggregate over one reading of ``df``.

    A row gives one cell (truth, prediction) with class ``_a`` = -1, and for each class ``_a`` of its
    probabilities a cell (``_score``, truth): k + 1 narrow rows for k classes, counted before they move.
    """
    keys = [col(n) for n in by]
    t, nothing = col(truth), F.lit(None)
    guess = nothing.cast("int") if pred is None else col(pred)

    def cell(a: Column, score: Column, p: Column) -> Column:
        return F.struct(a.alias("_a"), score.alias("_score"), t.alias("_t"), p.alias("_p"))

    found = []
    if pred is not None:
        one = F.array(cell(F.lit(-1), nothing.cast("double"), guess))
        found.append(F.when(guess.isNotNull(), one))
    if probs is not None:
        p, no_guess = col(probs), F.lit(None).cast(df.select(guess).schema[0].dataType)
        # A class that the probabilities do not have makes no pair.
        known = (F.size(p) > 1) & t.cast("int").between(0, F.size(p) - 1)
        each = F.transform(
            F.sequence(F.lit(0), F.size(p) - 1), lambda a: cell(a, F.get(p, a).cast("double"), no_guess)
        )
        found.append(F.when(known, each))
    cells = df.filter(t.isNotNull()).select(*keys, F.explode(F.flatten(F.filter(F.array(*found), lambda x: x.isNotNull()))).alias("_c"))
    return (
        cells.select(*keys, "_c.*").filter((col("_a") == -1) | col("_score").isNotNull())
        .groupBy(*keys, "_a", "_score", "_t", "_p").agg(F.count(F.lit(1)).alias("_n"))
    )


def _ovo_areas(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """One-vs-one area of each group from ``_cells``.

    With class a as the positive one, a row of class b is in the right order with the rows of a above it. So
    the pairs of a with all other classes follow from one running count of the rows of a: inside a slice of
    the scores, and across slices from their totals.
    """
    keys = [col(n) for n in by]
    group = [*keys, col("_a")]
    # The cells are not filtered, so that all scores read the same counted ones; class -1 gives nothing.
    own = F.when((col("_t") == col("_a")) & (col("_a") >= 0), col("_n")).otherwise(0)

    def above(place: str, within: Sequence[Column]) -> Column:
        """Own rows above the place; frames by value take in all rows of one place."""
        upto = Window.partitionBy(*within).orderBy(place)
        return F.sum("_own").over(Window.partitionBy(*within)) - F.sum("_own").over(upto)

    def pairs(rivals: Column) -> Column:
        return col("_n").cast("double") * rivals

    sliced = (
        cells.withColumn("_own", own).repartitionByRange(*group, "_score").withColumn("_slice", F.spark_partition_id())
    )
    inside = [*group, col("_slice")]
    tied = F.sum("_own").over(Window.partitionBy(*inside, "_score"))
    in_slice = (
        sliced.withColumn("_pairs", pairs(above("_score", inside) + tied / 2))
        .groupBy(*inside, "_t").agg(*[F.sum(n).alias(n) for n in ("_n", "_own", "_pairs")])
    )
    across = in_slice.withColumn("_pairs", col("_pairs") + pairs(above("_slice", group)))
    rivals = across.groupBy(*group, "_t").agg(*[F.sum(n).alias(n) for n in ("_n", "_own", "_pairs")])
    other = (col("_a") >= 0) & (col("_own") == 0)
    one = rivals.groupBy(*group).agg(
        F.max("_own").alias("_own"), F.count_if(other).alias("_others"),
        F.sum(F.when(other, col("_pairs") / col("_n"))).alias("_areas"),
    )
    there = col("_own") > 0
    return one.groupBy(*keys).agg(
        F.try_divide(F.sum(F.when(there, col("_areas") / col("_own"))), F.sum(F.when(there, col("_others")))).alias("roc_auc_ovo"),
        F.coalesce(F.sum(F.when(there, col("_others"))), F.lit(0)).alias("n_pairs"),
    )


def roc_auc_ovo(
    df: DataFrame,
    by: Sequence[str] = ("label",),
    truth: str = "ground_truth",
    probs: str = "probs",
) -> DataFrame:
    """One-vs-one area on class probabilities, mean over the ordered pairs of classes.

    For the pair (a, b) only rows of class a or b count, a being the positive class and
    the probability of a the score. A row gives k narrow rows for k classes, whatever its own is.
    Pairs with a class absent from the truth are skipped; a group without any pair has a NULL area.
    """
    return _ovo_areas(_cells(df, by, truth, None, probs), by)


def log_loss(
    df: DataFrame,
    by: Sequence[str] = ("label",),
    truth: str = "ground_truth",
    probs: str = "probs",
    weight: str | None = None,
    eps: float = 1e-15,
) -> DataFrame:
    """Weighted mean of -ln(probability of the true class)."""
    # element_at fails on a class the model does not know, as a lookup should.
    p_true = F.element_at(col(probs), col(truth).cast("int") + 1).cast("double")
    loss = -F.log(F.greatest(p_true, F.lit(eps)))
    w = col(weight).cast("double") if weight else F.lit(1.0)
    rated = df.filter(col(truth).isNotNull() & col(probs).isNotNull())
    return rated.groupBy(*[col(n) for n in by]).agg(
        F.try_divide(F.sum(w * loss), F.sum(w)).alias("log_loss")
    )


def hard_auc(counts: DataFrame, by: Sequence[str] = ("label",)) -> DataFrame:
    """AUC of the predicted class as a score, the larger true class being positive.

    Taken from ``class_confusion`` counts, k * k rows per group for k classes.
    """
    keys = [col(n) for n in by]
    top = F.max("truth").over(Window.partitionBy(*keys))
    below = Window.partitionBy(*keys).orderBy("pred").rowsBetween(Window.unboundedPreceding, -1)
    pairs = col("_pos").cast("double") * (
        F.coalesce(F.sum("_neg").over(below), F.lit(0)) + col("_neg") / 2
    )
    return (
        counts.withColumn("_positive", col("truth") == top)
        .groupBy(*keys, "pred")
        .agg(
            F.sum(F.when(col("_positive"), col("n")).otherwise(0)).alias("_pos"),
            F.sum(F.when(col("_positive"), 0).otherwise(col("n"))).alias("_neg"),
        )
        .withColumn("_pairs", pairs)
        .groupBy(*keys)
        .agg(
            F.try_divide(
                F.sum("_pairs"), F.sum("_pos").cast("double") * F.sum("_neg").cast("double")
            ).alias("roc_auc_hard")
        )
    )


def evaluate(
    df: DataFrame,
    by: Sequence[str] = ("label",),
    truth: str = "ground_truth",
    pred: str = "prediction",
    probs: str = "probs",
) -> DataFrame:
    """Accuracy, weighted F1 and ROC AUC of every label.

    ``roc_auc`` is that of the hard predictions for a label with up to two classes, and the
    one-vs-one area on the probabilities for one with more. ``roc_auc_scores`` is the area
    on the probabilities for both kinds. ``df`` is read once.
    """
    keys = [col(n) for n in by]
    cells = _cells(df, by, truth, pred, probs)
    # Neither side filters the cells, so Spark computes them once for both.
    counts = (
        cells.groupBy(*keys, col("_t").alias("truth"), col("_p").alias("pred"))
        .agg(F.sum(F.when(col("_a") == -1, col("_n"))).alias("n")).filter("n is not null").repartition(*keys)
    )
    # Each part has one row per group; stacked and aggregated they need no join.
    parts = multiclass_scores(counts, by)
    for part in (hard_auc(counts, by), _ovo_areas(cells, by).drop("n_pairs")):
        parts = parts.unionByName(part, allowMissingColumns=True)
    names = [n for n in parts.columns if n not in by]
    few = col("n_classes") <= 2
    return (
        parts.groupBy(*keys)
        .agg(*[F.max(n).alias(n) for n in names])
        .filter(col("n_rows").isNotNull())
        .select(
            *keys,
            "n_rows",
            "n_classes",
            "accuracy",
            "f1_weighted",
            F.when(few, col("roc_auc_hard")).otherwise(col("roc_auc_ovo")).alias("roc_auc"),
            col("roc_auc_ovo").alias("roc_auc_scores"),
        )
    )


def best_epoch(
    log: DataFrame, metric: str = "accuracy", split: str = "val", by: Sequence[str] = ("label",)
) -> DataFrame:
    """Epoch with the largest value of a metric, the earliest one on ties.

    An aggregate with map-side combining; the log of a label is never sorted in one task.
    """
    rated = log.filter(
        (col("metric") == metric) & (col("split") == split) & col("value").isNotNull()
        & ~F.isnan(col("value"))
    )
    best = F.max(F.struct(col("value"), (-col("epoch")).alias("_rev")))
    return rated.groupBy(*[col(n) for n in by]).agg(best.alias("_best")).select(
        *[col(n) for n in by],
        (-F.col("_best._rev")).alias("epoch"),
        F.col("_best.value").alias("value"),
    )


def summarise_splits(
    scores: DataFrame,
    by: Sequence[str] = ("label", "metric"),
    value: str = "value",
    spread: str = "population",
) -> DataFrame:
    """Mean and standard deviation of a score over the splits."""
    deviations = {"population": F.stddev_pop, "sample": F.stddev_samp}
    if spread not in deviations:
        raise ValueError(f"spread must be one of {sorted(deviations)}, not {spread!r}")
    return scores.groupBy(*[col(n) for n in by]).agg(
        F.count(col(value)).alias("n_splits"),
        F.avg(col(value)).alias("mean"),
        deviations[spread](col(value)).alias("spread"),
    )
