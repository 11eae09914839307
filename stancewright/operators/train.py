"""One classifier per label: fitting, scoring, checkpoints.

The fits of the labels are driven from a few threads, each being a distributed fit over features
that are cached once. Nothing of the data reaches the driver but class counts and model
coefficients.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stancewright import schemas
from stancewright.functions import argmax, to_vector, top_probability
from stancewright.operators.embed import embedding_dim
from stancewright.operators.metrics import evaluate, log_loss
from stancewright.operators.sampling import class_weights, training_frame
from stancewright.schemas import col
from stancewright.session import materialise

#: Networks of so many training steps are scored in one pass.
SCORED_TOGETHER = 20


def mlp_layers(dim: int, hidden: int, n_classes: int, shape: str = "deep") -> list[int]:
    """Layer widths. A deep network halves its hidden width three times, a shallow one has one."""
    if shape == "shallow":
        layers = [dim, hidden, n_classes]
    elif shape == "deep":
        layers = [dim, hidden, hidden // 2, hidden // 4, hidden // 8, n_classes]
    else:
        raise ValueError(f"shape must be 'deep' or 'shallow', not {shape!r}")
    if min(layers) < 1:
        raise ValueError(f"layer widths {layers} are not all positive; a deep network needs hidden >= 8")
    return layers


def weights_by_label(
    df: DataFrame, labels: Sequence[str], max_classes: int = 10_000
) -> dict[str, list[tuple]]:
    """(class, weight) pairs of every label, counted in one job.

    They are brought to the driver, so the labels may have ``max_classes`` classes each on
    average; more is an error, as such columns are not labels.
    """
    found: dict[str, list[tuple]] = {name: [] for name in labels}
    most = max_classes * len(found)
    rows = class_weights(df, labels).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {max_classes} classes each: {labels} are not label columns")
    for row in rows:
        found[row["label"]].append((row["class"], row["weight"]))
    empty = [name for name, classes in found.items() if not classes]
    if empty:
        raise ValueError(f"no annotated rows for {empty}")
    return found


def oversample(df: DataFrame, weights: Sequence[tuple]) -> DataFrame:
    """Rows of rarer classes repeated to balance the classes; no row is dropped.

    Stands in for class weights where the estimator takes none. Copies are the class
    weight relative to the most frequent class, rounded.
    """
    least = min(w for _, w in weights)
    pairs = [F.lit(v) for c, w in weights for v in (float(c), round(w / least))]
    copies = F.try_element_at(F.create_map(*pairs), col("label"))
    return df.withColumn("_copy", F.explode(F.sequence(F.lit(1), copies))).drop("_copy")


def _estimator(kind: str, dim: int, n_classes: int, hidden: int, shape: str, max_iter: int, seed: int):
    if kind == "logistic":
        return LogisticRegression(maxIter=max_iter, weightCol="weight", aggregationDepth=3)
    if kind == "mlp":
        layers = mlp_layers(dim, hidden, n_classes, shape)
        return MultilayerPerceptronClassifier(layers=layers, maxIter=max_iter, seed=seed)
    raise ValueError(f"estimator must be 'logistic' or 'mlp', not {kind!r}")


def train_labels(
    df: DataFrame,
    labels: Iterable[str],
    features: str = "embedding",
    key: str = "code",
    estimator: str = "logistic",
    hidden: int = 64,
    max_iter: int = 50,
    seed: int = 42,
    shape: str = "deep",
    max_classes: int = 10_000,
    parallel: int = 4,
) -> dict:
    """A fitted, class-balanced model per label.

    ``hidden`` and ``shape`` are those of ``estimator='mlp'`` (``mlp_layers``);
    ``max_classes`` is explained at ``weights_by_label``. ``parallel`` labels are fitted at a time over the
    one cached table, each in a scheduler pool of its own, so that with ``spark.scheduler.mode=FAIR``
    they share the cluster alike; the models do not depend on it.
    """
    names = list(labels)
    data = df.select(col(key), col(features), *[col(n) for n in names])
    data = data.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        weights = weights_by_label(data, names, max_classes)
        dim = embedding_dim(data, features) if estimator == "mlp" else 0
        context = data.sparkSession.sparkContext

        def fit(name: str):
            context.setLocalProperty("spark.scheduler.pool", f"label {name}")
            frame = training_frame(data, name, features, key, weights[name])
            if estimator == "mlp":
                frame = oversample(frame, weights[name])
            width = max(2, max(c for c, _ in weights[name]) + 1)
            return _estimator(estimator, dim, width, hidden, shape, max_iter, seed).fit(frame)

        with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool:
            # Each label in a thread that has the caller's settings and jobs of its own.
            fits = [pool.submit(inheritable_thread_target(data.sparkSession)(fit), name) for name in names]
            models = {name: job.result() for name, job in zip(names, fits)}
    finally:
        data.unpersist()
    return models


def _applied(df: DataFrame, models: Mapping, features: str = "features") -> DataFrame:
    """Adds ``_p0``, ``_p1``, ...: the class probabilities of each model on a vector column, in order."""
    none = df.sparkSession.sparkContext._jvm.scala.Option.empty()
    for i, model in enumerate(models.values()):
        clf = model.copy()
        # The summary of a fit holds the session, which tasks must not take along.
        if getattr(clf, "hasSummary", False):
            clf._java_obj.setSummary(none)
        clf.setFeaturesCol(features)
        clf.setProbabilityCol(f"_v{i}")
        # Unnamed outputs are not computed.
        clf.setRawPredictionCol("")
        clf.setPredictionCol("")
        df = clf.transform(df)
    return df.withColumns({f"_p{i}": vector_to_array(f"_v{i}") for i in range(len(models))})


def _with_probs(df: DataFrame, models: Mapping, features: str) -> DataFrame:
    return _applied(df.withColumn("_features", to_vector(col(features))), models, "_features")


def predict_labels(
    df: DataFrame,
    models: Mapping,
    features: str = "embedding",
    key: str = "code",
    truth: Mapping[str, str] | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Long table ``(key, label, ground_truth, prediction, prob, probs)``.

    All models are applied in one pass over the embeddings. ``truth`` maps a label to the
    column of its human labels; by default a column called like the label. ``keep`` names
    further columns to carry along. Works on streams: nothing here needs state.
    """
    human = {n: n for n in models if n in df.columns} if truth is None else truth
    cells = [
        F.struct(
            F.lit(label).alias("label"),
            (col(human[label]) if label in human else F.lit(None)).cast("int").alias("ground_truth"),
            col(f"_p{i}").alias("probs"),
        )
        for i, label in enumerate(models)
    ]
    carried = [col(key), *[col(n) for n in keep]]
    return _with_probs(df, models, features).select(*carried, F.inline(F.array(*cells))).select(
        *carried,
        "label",
        "ground_truth",
        argmax(col("probs")).alias("prediction"),
        top_probability(col("probs")).alias("prob"),
        "probs",
    )


class StackedModels:
    """Linear models of many labels as one matrix: all of them score a block of rows in one product.

    Takes fitted logistic regressions. ``probs`` of a label are those of its own model, to rounding.
    """

    def __init__(self, models: Mapping) -> None:
        self.labels = list(models)
        rows, intercepts, self.spans = [], [], []
        at = 0
        for model in models.values():
            matrix = model.coefficientMatrix.toArray()
            intercept = model.interceptVector.toArray()
            if len(matrix) == 1:
                # A binary model has one row, the margin of class 1 over class 0.
                matrix, intercept = np.vstack([np.zeros_like(matrix), matrix]), np.append(0.0, intercept)
            self.spans.append((at, at + len(matrix)))
            at += len(matrix)
            rows.append(matrix)
            intercepts.append(intercept)
        self.matrix = np.ascontiguousarray(np.vstack(rows).T)
        self.intercept = np.concatenate(intercepts)

    def probabilities(self, vectors: np.ndarray) -> list[np.ndarray]:
        """For each label the class probabilities of each row."""
        margins = vectors @ self.matrix + self.intercept
        found = []
        for a, b in self.spans:
            powers = np.exp(margins[:, a:b] - margins[:, a:b].max(axis=1, keepdims=True))
            found.append(powers / powers.sum(axis=1, keepdims=True))
        return found


def predict_stacked(
    df: DataFrame, models: Mapping, features: str = "embedding", key: str = "code",
    truth: Mapping[str, str] | None = None, keep: Sequence[str] = (), block: int = 4_096,
) -> DataFrame:
    """``predict_labels`` of linear models by one matrix product per block of rows.

    Worth it for many labels or long vectors. A row without a vector gets no prediction: its ``probs``
    are NULL. Works on streams too.
    """
    stacked = StackedModels(models)
    human = {n: n for n in models if n in df.columns} if truth is None else truth
    carried = [col(key), *[col(n) for n in keep]]
    rows = df.select(col(features).cast("array<double>").alias("_x"), F.struct(
        *[c.alias(f"c{i}") for i, c in enumerate(carried)],
        *[(col(human[n]) if n in human else F.lit(None)).cast("int").alias(f"t{i}") for i, n in enumerate(models)],
    ).alias("_row"))
    size = len(stacked.matrix)

    def score(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, block):
                part = batch.slice(start, block)
                vectors = part.column(0)
                present = vectors.is_valid()
                lengths = vectors.drop_null().value_lengths()
                if len(lengths) and set(lengths.unique().to_pylist()) != {size}:
                    raise ValueError(f"vectors have to have the length of the models, {size}")
                values = vectors.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
                where = np.cumsum(present.to_numpy(zero_copy_only=False)) - 1
                columns = [part.column(1)]
                for probs in stacked.probabilities(values):
                    ends = np.arange(len(probs) + 1, dtype=np.int32) * probs.shape[1]
                    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(probs.ravel()))
                    columns.append(lists.take(pa.array(where, mask=~present.to_numpy(zero_copy_only=False))))
                yield pa.RecordBatch.from_arrays(columns, names=["_row", *[f"_p{i}" for i in range(len(columns) - 1)]])

    kind = rows.schema["_row"].dataType.simpleString()
    schema = ", ".join([f"_row {kind}", *[f"_p{i} array<double>" for i in range(len(stacked.labels))]])
    cells = [
        F.struct(F.lit(n).alias("label"), F.col(f"_row.t{i}").alias("ground_truth"), col(f"_p{i}").alias("probs"))
        for i, n in enumerate(stacked.labels)
    ]
    names = [key, *keep]
    carried = [F.col(f"_row.c{i}").alias(n) for i, n in enumerate(names)]
    return rows.mapInArrow(score, schema).select(*carried, F.inline(F.array(*cells))).select(
        *[col(n) for n in names], "label", "ground_truth", argmax(col("probs")).alias("prediction"),
        top_probability(col("probs")).alias("prob"), "probs",
    )


def predict_wide(
    df: DataFrame,
    models: Mapping,
    three_state: Iterable[str] = (),
    features: str = "embedding",
) -> DataFrame:
    """The table with one 0/1 column per binary label; a three-state label fills two.

    Rows are neither multiplied nor moved. Human labels of the same name are replaced.
    """
    split = set(three_state)
    flags = {}
    for i, label in enumerate(models):
        state = argmax(col(f"_p{i}"))
        if label in split:
            flags[f"pro {label}"] = (state == schemas.PRO).cast("int")
            flags[f"anti {label}"] = (state == schemas.ANTI).cast("int")
        else:
            flags[label] = state
    scored = _with_probs(df, models, features)
    return scored.select(
        *[col(n) for n in df.columns if n not in flags],
        *[flag.alias(name) for name, flag in flags.items()],
    )


def score_models(
    df: DataFrame, models: Mapping, features: str = "embedding", key: str = "code"
) -> DataFrame:
    """Scores of all models on a labelled table, for instance the test split.

    The predictions are computed once, without the vectors, and read back for every score.
    """
    return evaluate(materialise(_to_score(predict_labels(df, models, features, key))))


def _to_score(preds: DataFrame, *keep: str) -> DataFrame:
    return preds.select(*keep, "label", "ground_truth", "prediction", "probs")


@dataclass
class EpochRun:
    """Result of ``fit_epochs``: the log and two models."""

    log: DataFrame
    best_epoch: int | None
    best: object
    latest: object


def fit_epochs(
    train: DataFrame,
    val: DataFrame,
    label: str,
    features: str = "embedding",
    key: str = "code",
    epochs: int = 300,
    every: int = 5,
    hidden: int = 64,
    metric: str = "accuracy",
    seed: int = 42,
    shape: str = "deep",
) -> EpochRun:
    """Trains a network in steps, scores each step, keeps the best and the latest model.

    Every ``every`` iterations the weights so far start the next step; a last, shorter step
    makes up ``epochs``. The best step has the largest validation ``metric``, the earliest
    one winning ties. The networks of several steps are scored in one pass over the rows.
    """
    if epochs < 1 or every < 1:
        raise ValueError("epochs and every must be at least 1")
    weights = weights_by_label(train, [label])[label]
    width = max(2, max(c for c, _ in weights) + 1)
    layers = mlp_layers(embedding_dim(train, features), hidden, width, shape)
    # A row keeps its class weight in validation too, so both losses are comparable.
    parts = [
        training_frame(part, label, features, key, weights).withColumn("split", F.lit(name))
        for name, part in (("train", train), ("val", val))
    ]
    both = parts[0].unionByName(parts[1]).persist()
    fit_on = oversample(both.filter("split = 'train'"), weights).persist()
    rows, model, best, unscored = [], None, (None, float("-inf"), None), {}
    try:
        for start in range(0, epochs, every):
            epoch = min(start + every, epochs)
            net = MultilayerPerceptronClassifier(layers=layers, maxIter=epoch - start, seed=seed)
            if model is not None:
                net.setInitialWeights(model.weights)
            model = unscored[epoch] = net.fit(fit_on)
            if len(unscored) < SCORED_TOGETHER and epoch < epochs:
                continue
            scores = _epoch_scores(both, unscored)
            rows += [(label, *score) for score in scores]
            for at, split, name, value in scores:
                if (split, name) == ("val", metric) and value is not None and value > best[1]:
                    best = (at, value, unscored[at])
            unscored = {}
    finally:
        both.unpersist()
        fit_on.unpersist()
    log = train.sparkSession.createDataFrame(rows, schemas.TRAINING_LOG)
    return EpochRun(log, best[0], best[2], model)


def _epoch_scores(both: DataFrame, models: Mapping[int, object]) -> list[tuple]:
    """(epoch, split, metric, value) of both splits for the networks of some epochs, by epoch.

    All networks are applied in one pass; their predictions are kept for the scores.
    """
    scored = _applied(both, models)
    cells = [F.struct(F.lit(epoch).alias("epoch"), col(f"_p{i}").alias("probs")) for i, epoch in enumerate(models)]
    preds = scored.select(
        "split", col("label").cast("int").alias("ground_truth"), "weight", F.inline(F.array(*cells))
    ).withColumn("prediction", argmax(col("probs"))).persist(StorageLevel.MEMORY_AND_DISK)
    by = ["epoch", "split"]
    metrics = evaluate(preds, by).select(
        *by, "accuracy", col("f1_weighted").alias("f1"), col("roc_auc").alias("rocauc")
    )
    loss = log_loss(preds, by, weight="weight").withColumnRenamed("log_loss", "loss")
    names = ["accuracy", "f1", "rocauc", "loss"]
    together = metrics.unionByName(loss, allowMissingColumns=True)
    long = together.unpivot(by, names, "metric", "value").filter(col("value").isNotNull())
    try:
        found = {(r["epoch"], r["split"], r["metric"]): r["value"] for r in long.collect()}
    finally:
        preds.unpersist()
    return [(e, s, m, found.get((e, s, m))) for e in models for s in ("train", "val") for m in names]
