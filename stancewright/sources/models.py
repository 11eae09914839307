"""Model directories: ``<root>/label=<label>/split=<split>/<best|latest>``."""

from __future__ import annotations

from urllib.parse import quote

from pyspark.ml.util import DefaultParamsReader, MLWritable

KINDS = ("best", "latest")


def model_path(root: str, label: str, split: int | str = 0, kind: str = "best") -> str:
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}, not {kind!r}")
    return f"{root.rstrip('/')}/label={quote(label, safe='')}/split={split}/{kind}"


def save_model(
    model: MLWritable, root: str, label: str, split: int | str = 0, kind: str = "best"
) -> str:
    path = model_path(root, label, split, kind)
    model.write().overwrite().save(path)
    return path


def load_model(root: str, label: str, split: int | str = 0, kind: str = "best"):
    """The fitted model, of whatever class it was saved as."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    path = model_path(root, label, split, kind)
    return DefaultParamsReader.loadParamsInstance(path, spark)


def save_models(models: dict, root: str, split: int | str = 0, kind: str = "best") -> None:
    for label, model in models.items():
        save_model(model, root, label, split, kind)


def save_run(run, root: str, label: str, split: int | str = 0) -> None:
    """Best and latest model of a training run in steps."""
    if run.best is not None:
        save_model(run.best, root, label, split, "best")
    save_model(run.latest, root, label, split, "latest")


def load_models(root: str, labels, split: int | str = 0, kind: str = "best") -> dict:
    return {label: load_model(root, label, split, kind) for label in labels}
