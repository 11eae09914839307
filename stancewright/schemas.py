"""Declared schemas, label sets and column aliases."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

# Label names, their spelling and order are part of the data contract.
BINARY_LABELS = [
    "pro RSF", "anti RSF", "anti SAF", "pro SAF", "pro peace", "anti peace",
    "pro war", "anti war", "pro civilian", "anti civilians", "no polarisation",
    "Geopolticis", "Sudanese", "Not Sudanese", "Likely bot", "Likely not a bot",
    "Not about Sudan",
]
REPORT_LABELS = [label for label in BINARY_LABELS if label != "Likely bot"]
SHEET_ALIASES = {"Pro peace,": "pro peace", "Pro War": "pro war"}
TOPIC_PAIRS = {
    "RSF": ("pro RSF", "anti RSF"),
    "SAF": ("pro SAF", "anti SAF"),
    "peace": ("pro peace", "anti peace"),
    "war": ("pro war", "anti war"),
    "civilians": ("pro civilian", "anti civilians"),
}
REQUIRED_LABELS = [name for pair in TOPIC_PAIRS.values() for name in pair] + [
    "Sudanese", "Not Sudanese",
]
THREE_STATE_LABELS = ["RSF", "SAF", "peace", "war"]
DEMO_LABELS = THREE_STATE_LABELS + [
    "no polarisation", "Geopolticis", "pro civilian", "anti civilians", "Sudanese",
    "Not Sudanese", "Likely bot", "Likely not a bot", "Not about Sudan",
]
OFF_TOPIC = "Not about Sudan"
OUT_GROUP = "Not Sudanese"
AUTHOR_COLUMNS = ["user", "username"]

PRO, ANTI, NEITHER = 1, 0, 2


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(name, T.StringType()) for name in names]


def _labels() -> list[T.StructField]:
    return [T.StructField(name, T.IntegerType()) for name in BINARY_LABELS]


LABELLED = T.StructType(_strings("post", "permalink", "user", "username") + _labels())
POSTS = T.StructType(_strings("permalink", "post", "username", "date", "time"))
CLASSIFIED = T.StructType(_strings("post", "date", "time", "username", "code") + _labels())
SCORES = T.StructType(
    _strings(
        "Label", "Train Accuracy", "Validation Accuracy", "Train ROC AUC",
        "Validation ROC AUC", "Train F1", "Validation F1",
    )
)
CORRECTIONS = T.StructType(
    [
        T.StructField("code", T.StringType(), False),
        T.StructField("column", T.StringType(), False),
        T.StructField("value", T.IntegerType()),
    ]
)
TRAINING_LOG = T.StructType(
    [
        T.StructField("label", T.StringType(), False),
        T.StructField("epoch", T.IntegerType(), False),
        T.StructField("split", T.StringType(), False),
        T.StructField("metric", T.StringType(), False),
        T.StructField("value", T.DoubleType()),
    ]
)


def col(name: str):
    """A column by its exact name, whatever characters the name holds."""
    return F.col("`" + name.replace("`", "``") + "`")
