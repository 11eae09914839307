"""Training runs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stancewright.operators.metrics import evaluate, summarise_splits
from stancewright.operators.sampling import split_by_key, stratified_folds
from stancewright.operators.train import fit_epochs, predict_labels, train_labels
from stancewright.schemas import col
from stancewright.session import materialise
from stancewright.sources import save_models, save_run


def train_and_test(
    df: DataFrame,
    labels: Iterable[str],
    features: str = "embedding",
    key: str = "code",
    seed: int = 42,
    model_root: str | None = None,
    **training,
) -> tuple[dict, DataFrame]:
    """Models fitted on the training split, and their scores on every split.

    All rows are scored in one pass; ``scores`` has a row per split and label.
    """
    names = list(labels)
    parts = split_by_key(df, key, seed=seed)
    models = train_labels(parts.filter("split = 'train'"), names, features, key, **training)
    if model_root is not None:
        save_models(models, model_root)
    return models, _scores_by_split(parts, models, features, key)


def _scores_by_split(parts: DataFrame, models, features: str, key: str) -> DataFrame:
    preds = predict_labels(parts, models, features, key, keep=["split"])
    narrow = preds.select("split", "label", "ground_truth", "prediction", "probs")
    return evaluate(materialise(narrow), ["split", "label"])


def train_epochs(
    df: DataFrame,
    labels: Iterable[str],
    features: str = "embedding",
    key: str = "code",
    seed: int = 42,
    model_root: str | None = None,
    **training,
) -> tuple[dict, DataFrame, DataFrame]:
    """A network per label, trained in epochs and chosen on the validation split.

    Returns the runs, the log of all labels, and the scores of the best networks on every split;
    best and latest networks are saved below ``model_root``. Options are those of
    ``fit_epochs``.
    """
    parts = split_by_key(df, key, seed=seed).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        runs, log = {}, None
        for label in labels:
            run = fit_epochs(
                parts.filter("split = 'train'"), parts.filter("split = 'val'"), label, features, key,
                seed=seed, **training,
            )
            if model_root is not None:
                save_run(run, model_root, label)
            runs[label] = run
            log = run.log if log is None else log.unionByName(run.log)
        best = {label: run.best or run.latest for label, run in runs.items()}
        return runs, log, _scores_by_split(parts, best, features, key)
    finally:
        parts.unpersist()


def cross_validate(
    df: DataFrame,
    label: str,
    k: int = 5,
    features: str = "embedding",
    key: str = "code",
    seed: int = 42,
    model_root: str | None = None,
    spread: str = "population",
    **training,
) -> DataFrame:
    """Train and validation scores over stratified folds: mean and spread per metric.

    Folds are assigned once, over keys and labels alone, and joined to the vectors once; that
    table is kept while the models of all folds are fitted and score all rows in one pass. A
    row is validation for the model that did not see it.
    """
    folds = materialise(
        stratified_folds(df.select(col(key), col(label)), label, k, key, seed).select(col(key), "fold")
    )
    parts = df.join(folds, key).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        models = {}
        for fold in range(k):
            fitted = train_labels(parts.filter(col("fold") != fold), [label], features, key, **training)
            if model_root is not None:
                save_models(fitted, model_root, split=fold)
            models[str(fold)] = fitted[label]
        preds = predict_labels(parts, models, features, key, {f: label for f in models}, ["fold"])
        preds = materialise(preds.select("fold", "label", "ground_truth", "prediction", "probs"))
    finally:
        parts.unpersist()
    unseen = col("fold").cast("string") == col("label")
    tagged = preds.select(
        col("label").alias("model"),
        F.when(unseen, "Validation").otherwise("Train").alias("split"),
        "ground_truth",
        "prediction",
        "probs",
    )
    scores = evaluate(tagged, ["split", "model"]).unpivot(
        ["split", "model"], ["accuracy", "f1_weighted", "roc_auc"], "metric", "value"
    )
    return summarise_splits(scores, ["split", "metric"], spread=spread).withColumn(
        "label", F.lit(label)
    )
