"""Every operator as a query over the standard tables, next to its SQL equivalent.

Roles of the tables: ``documents`` are posts (doc_id = code, text = post, source =
username), ``labels`` human annotations (quality = pro, toxic = anti), ``embeddings`` the
embedding store, ``pages`` carry permalinks, ``orders`` dates, ``events`` a metric log,
``lineitem`` many scored rows. Each query reads its tables whole.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stancewright import sources
from stancewright.functions import argmax, sigmoid, softmax, threshold, top_probability
from stancewright.operators import clean, embed, keys, labels, metrics, report, sampling, train
from stancewright.plans.classify import classify_posts, predict_from_text
from stancewright.plans.embedding_store import attach_by_text, embed_texts
from stancewright.plans.report_page import evaluate_against_labels
from stancewright.plans.training import cross_validate, train_and_test
from stancewright.schemas import col
from stancewright.session import scratch_path
from stancewright.streaming import (
    first_arrivals,
    read_arrivals,
    read_batches,
    read_stream,
    run_to_end,
    score_raw_stream,
    score_stream,
    stance_stream,
)

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

TOPIC = {"topic": ("quality", "toxic")}
MARKS = ["quality", "toxic"]
PRIORITIES = {
    "urgent": "1-URGENT", "high": "2-HIGH", "medium": "3-MEDIUM",
    "unspecified": "4-NOT SPECIFIED", "low": "5-LOW",
}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function name."""

    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(col(n), 6) for n in names})


def annotated(spark: SparkSession, d: str) -> DataFrame:
    """All posts, with NULL annotations where nobody labelled them."""
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")


def labelled(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")


def dated(spark: SparkSession, d: str) -> DataFrame:
    """Orders as dated posts with five binary labels."""
    flags = [
        (col("o_orderpriority") == v).cast("int").alias(k) for k, v in PRIORITIES.items()
    ]
    return table(spark, d, "orders").select(col("o_orderdate").alias("date"), *flags)


DATED = "(SELECT o_orderdate AS date, " + ", ".join(
    f"CAST(o_orderpriority = '{v}' AS INTEGER) AS {k}" for k, v in PRIORITIES.items()
) + " FROM orders)"
ANNOTATED = "(SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))"
LABELLED = "(SELECT d.*, l.quality, l.toxic FROM labels l JOIN documents d USING (doc_id))"
STANCE = (
    "CASE WHEN quality = 1 AND toxic = 0 THEN 1 WHEN quality = 0 AND toxic = 1 THEN 0 ELSE 2 END"
)


def _unpivot(source: str, names, by: str = "") -> str:
    """SQL for positives per label, one SELECT per label."""
    ids = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    return " UNION ALL ".join(
        f"SELECT {ids}'{n}' AS label, CAST(sum({n}) AS BIGINT) AS positives FROM {source}{group}"
        for n in names
    )


# Reports


@query(
    f"""
    WITH c AS ({_unpivot('labels', MARKS)})
    SELECT label, positives, round(positives / sum(positives) OVER (), 6) AS share,
           printf('%.2f%%', 100.0 * positives / sum(positives) OVER ()) AS percentage
    FROM c
    """
)
def label_prevalence(spark, d):
    return rounded(report.label_prevalence(table(spark, d, "labels"), MARKS), "share")


@query(
    f"""
    WITH m AS (SELECT * FROM {DATED} WHERE month(date) = 3),
         c AS ({_unpivot('m', PRIORITIES)}),
         s AS (SELECT label, positives, round(positives / sum(positives) OVER (), 6) AS share,
                      printf('%.2f%%', 100.0 * positives / sum(positives) OVER ()) AS percentage
               FROM c)
    SELECT * FROM s WHERE label IN ('urgent', 'low', 'high')
    """
)
def label_prevalence_month(spark, d):
    shares = report.label_prevalence(
        dated(spark, d), PRIORITIES, "date", month=3, only=["urgent", "low", "high"]
    )
    return rounded(shares, "share")


_MONTHS = f"(SELECT CAST(month(date) AS INTEGER) AS month, * EXCLUDE (date) FROM {DATED})"


@query(
    f"""
    WITH c AS ({_unpivot(_MONTHS, PRIORITIES, 'month')})
    SELECT month, label, positives,
           round(positives / sum(positives) OVER (PARTITION BY label), 6) AS share
    FROM c
    """
)
def monthly_label_share(spark, d):
    return rounded(report.monthly_share(dated(spark, d), PRIORITIES), "share")


_YEAR_MONTHS = f"(SELECT CAST(date_trunc('month', date) AS DATE) AS month, * EXCLUDE (date) FROM {DATED})"


@query(_unpivot(_YEAR_MONTHS, PRIORITIES, "month"))
def year_month_counts(spark, d):
    return report.monthly_counts(dated(spark, d), PRIORITIES, calendar="year-month")


@query(
    """
    SELECT coalesce(CAST(m AS VARCHAR), 'All') AS month, CAST(count(*) AS BIGINT) AS n_posts
    FROM (SELECT month(o_orderdate) AS m FROM orders) GROUP BY ROLLUP (m)
    """
)
def months_with_total(spark, d):
    posts = dated(spark, d).withColumn("date", col("date").cast("string"))
    return report.months_with_total(posts)


@query(
    """
    SELECT coalesce(CAST(CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE month(o_orderdate) END AS VARCHAR), 'unreadable')
             AS month, count(*) AS n_posts FROM orders GROUP BY 1
    UNION ALL SELECT 'All', count(*) FROM orders
    """
)
def months_of_mixed_dates(spark, d):
    """Dates as text in several forms, some NULL and some unreadable; months add up to all."""
    date, at = col("o_orderdate"), col("o_orderkey") % 10
    text = (
        F.when(at.isin(0, 5), F.date_format(date, "yyyy-MM-dd"))
        .when(at.isin(1, 6), F.date_format(date, "d MMM yyyy"))
        .when(at.isin(2, 7), F.date_format(date, "M/d/yyyy"))
        .when(at.isin(3, 8), F.date_format(date, "MMMM d, yyyy"))
        .when(at == 4, F.lit("some day"))
    )
    return report.months_with_total(table(spark, d, "orders").select(text.alias("date")))


@query("SELECT doc_id, source, n_chars FROM documents ORDER BY doc_id LIMIT 15")
def preview(spark, d):
    posts = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    return report.preview(posts, "doc_id")


SCORE_CELLS = [
    ("view", "Train", "F1"), ("click", "Validation", "F1"), ("error", "Train", "ROC AUC"),
    ("signup", "Validation", "ROC AUC"), ("purchase", "Train", "Accuracy"),
    ("any", "Validation", "Accuracy"),
]
SCORE_METRICS = ["F1", "ROC AUC", "Accuracy"]


def _score_cells(spark: SparkSession, d: str) -> DataFrame:
    """A score table with ``mean±spread`` cells, one row per user of the event log."""
    names = {kind: f"{split} {metric}" for kind, split, metric in SCORE_CELLS}
    cents = F.round(col("value") * 100).cast("long")
    cells = []
    for kind, name in names.items():
        counts = (col("event_type") == kind) | F.lit(kind == "any")
        high = F.max(F.when(counts, cents))
        n = F.count_if(counts)
        cells.append(
            F.when(n > 0, F.concat(high.cast("string"), F.lit("±"), n.cast("string")))
            .otherwise("n/a")
            .alias(name)
        )
    return table(spark, d, "events").groupBy(col("user_id").cast("string").alias("Label")).agg(*cells)


_CELLS = " UNION ALL ".join(
    f"""SELECT CAST(user_id AS VARCHAR) AS label, '{split}' AS split, '{metric}' AS metric,
        CAST(max(CAST(round(value * 100) AS BIGINT)) FILTER ('{kind}' IN (event_type, 'any')) AS DOUBLE) AS mean,
        CAST(nullif(count(*) FILTER ('{kind}' IN (event_type, 'any')), 0) AS DOUBLE) AS spread
        FROM events GROUP BY user_id"""
    for kind, split, metric in SCORE_CELLS
)


@query(_CELLS)
def score_summary(spark, d):
    return report.score_summary(_score_cells(spark, d), SCORE_METRICS)


@query(_CELLS)
def score_table_round_trip(spark, d):
    path = scratch_path(spark, "scores")
    sources.export_csv(_score_cells(spark, d), path)
    return report.score_summary(sources.read_scores(spark, path), SCORE_METRICS)


@query(
    """
    SELECT CAST(doc_id AS VARCHAR) AS code, CAST(quality AS DOUBLE) AS value,
           'Train' AS split FROM labels
    UNION ALL
    SELECT CAST(doc_id AS VARCHAR), CAST(toxic AS DOUBLE), 'Validation' FROM labels
    """
)
def stack_scores(spark, d):
    rows = table(spark, d, "labels")
    code = col("doc_id").cast("string").alias("code")
    return report.stack_scores(
        *[rows.select(code, col(n).cast("double").alias("value")) for n in MARKS]
    )


@query(
    """
    SELECT user_id, event_type, count(value) AS n_splits, round(avg(value), 6) AS mean,
           round(stddev_pop(value), 6) AS spread
    FROM events GROUP BY ALL
    """
)
def summarise_splits(spark, d):
    return rounded(
        metrics.summarise_splits(table(spark, d, "events"), ["user_id", "event_type"]),
        "mean", "spread",
    )


# Keys and cleaning


@query("SELECT page_id, split_part(url, '/', -1) AS code FROM pages")
def permalink_code(spark, d):
    return clean.extract_code(table(spark, d, "pages"), "url").select("page_id", "code")


@query(
    """
    SELECT doc_id, 'TW' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0')
                                ELSE CAST(n AS VARCHAR) END AS code
    FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS n FROM documents)
    """
)
def sequential_code(spark, d):
    return keys.with_sequential_code(table(spark, d, "documents").select("doc_id"), "doc_id")


@query("SELECT user_id, count(*) AS n_rows FROM events GROUP BY user_id HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return keys.duplicate_keys(table(spark, d, "events"), "user_id")


def _sheet(spark: SparkSession, d: str) -> DataFrame:
    """Annotated posts as a sheet: permalink, NaN for missing marks, patchy authors."""
    nan = F.lit(float("nan"))
    return annotated(spark, d).select(
        F.concat(F.lit("https://example.org/"), "source", F.lit("/status/"), col("doc_id")).alias("permalink"),
        F.when(col("lang") != "de", col("source")).alias("user"),
        F.when(col("n_chars") > 500, col("source")).alias("username"),
        F.coalesce(col("quality").cast("double"), nan).alias("quality"),
        F.coalesce(col("toxic").cast("double"), nan).alias("toxic"),
        F.when(col("lang") == "fr", 1.0).when(col("lang") == "de", nan).otherwise(0.0).alias("off_topic"),
        F.when(col("n_chars") >= 700, 0.0).when(col("lang") == "en", 1.0).alias("out_group"),
    )


SHEET = """
    (SELECT CAST(doc_id AS VARCHAR) AS code,
            CASE WHEN lang <> 'de' THEN source END AS user,
            CASE WHEN n_chars > 500 THEN source END AS username,
            CAST(quality AS DOUBLE) AS quality, CAST(toxic AS DOUBLE) AS toxic,
            CASE WHEN lang = 'fr' THEN 1.0 WHEN lang = 'de' THEN NULL ELSE 0.0 END AS off_topic,
            CASE WHEN n_chars >= 700 THEN 0.0 WHEN lang = 'en' THEN 1.0 END AS out_group
     FROM documents LEFT JOIN labels USING (doc_id))
"""
_SHEET_OPTIONS = {
    "required": MARKS, "off_topic": "off_topic", "out_group": "out_group",
}
_FILLED = f"""
    (SELECT code, coalesce("user", 'unknown') AS "user", coalesce(username, 'unknown') AS username,
            quality, toxic, CAST(coalesce(off_topic, 0) AS DOUBLE) AS off_topic,
            CAST(coalesce(out_group, 0) AS DOUBLE) AS out_group
     FROM {SHEET} WHERE quality IS NOT NULL AND toxic IS NOT NULL)
"""


@query(f"SELECT * FROM {_FILLED} WHERE off_topic = 0 AND out_group = 0")
def clean_labelled(spark, d):
    cleaned = clean.clean_labelled(
        _sheet(spark, d), on_topic_only=True, in_group_only=True, **_SHEET_OPTIONS
    )
    return cleaned.drop("permalink")


@query(
    f"""
    SELECT code, "user", username, quality, toxic, CAST(off_topic AS DOUBLE) AS off_topic,
           CAST(out_group AS DOUBLE) AS out_group
    FROM {SHEET} WHERE off_topic = 0 AND out_group = 0
    """
)
def clean_labelled_unfilled(spark, d):
    cleaned = clean.clean_labelled(
        _sheet(spark, d), drop_missing=False, on_topic_only=True, in_group_only=True,
        **_SHEET_OPTIONS,
    )
    return cleaned.drop("permalink")


@query(
    f"""
    SELECT code, "user", username, quality, toxic, CAST(off_topic AS DOUBLE) AS off_topic,
           CAST(out_group AS DOUBLE) AS out_group
    FROM {SHEET}
    WHERE "user" IS NOT NULL AND username IS NOT NULL AND quality IS NOT NULL
      AND toxic IS NOT NULL AND off_topic IS NOT NULL AND out_group IS NOT NULL
    """
)
def drop_incomplete(spark, d):
    sheet = clean.extract_code(clean.null_out_nan(_sheet(spark, d)))
    return clean.drop_incomplete(sheet).drop("permalink")


_AUDIT = " UNION ALL ".join(
    f"""SELECT '{stage}' AS stage, count(*) AS n_rows, '{n}' AS label,
        CAST(sum({n}) AS BIGINT) AS positives FROM {source}"""
    for stage, source in (("before", SHEET), ("after", _FILLED))
    for n in MARKS
)


@query(_AUDIT)
def cleaning_audit(spark, d):
    before = clean.null_out_nan(_sheet(spark, d))
    return clean.cleaning_audit(before, clean.clean_labelled(before, **_SHEET_OPTIONS), MARKS)


def _corrections(spark: SparkSession, d: str) -> DataFrame:
    """Short posts are not of quality, posts in German are not toxic."""
    posts = table(spark, d, "documents")

    def fix(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(
            col("doc_id").alias("code"), F.lit(name).alias("column"), F.lit(0).alias("value")
        )

    return fix(posts.filter("n_chars < 1000"), "quality").unionByName(
        fix(posts.filter("lang = 'de'"), "toxic")
    )


@query(
    """
    SELECT l.doc_id, CASE WHEN d.n_chars < 1000 THEN 0 ELSE l.quality END AS quality,
           CASE WHEN d.lang = 'de' THEN 0 ELSE l.toxic END AS toxic
    FROM labels l LEFT JOIN documents d USING (doc_id)
    """
)
def apply_corrections(spark, d):
    return clean.apply_corrections(
        table(spark, d, "labels"), _corrections(spark, d), MARKS, "doc_id"
    )


@query(
    """
    SELECT doc_id AS code, "column", 0 AS value
    FROM (SELECT doc_id, 'quality' AS "column" FROM documents WHERE n_chars < 1000
          UNION ALL SELECT doc_id, 'toxic' FROM documents WHERE lang = 'de')
    WHERE doc_id NOT IN (SELECT doc_id FROM labels)
    """
)
def unmatched_corrections(spark, d):
    return clean.unmatched_corrections(table(spark, d, "labels"), _corrections(spark, d), "doc_id")


@query('SELECT doc_id, quality AS "pro peace", toxic AS "pro war" FROM labels')
def canonical_labels(spark, d):
    sheet = table(spark, d, "labels").withColumnsRenamed(
        {"quality": "Pro peace,", "toxic": "Pro War"}
    )
    return clean.canonical_labels(sheet)


@query(f"SELECT CAST(doc_id AS VARCHAR) AS code, text AS post, quality, toxic FROM {LABELLED}")
def training_view(spark, d):
    posts = labelled(spark, d).withColumns({"code": col("doc_id").cast("string"), "post": col("text")})
    return clean.training_view(posts, MARKS)


# Folding


@query(f"SELECT doc_id, CAST({STANCE} AS INTEGER) AS topic FROM labels")
def merge_stance(spark, d):
    return labels.merge_topics(table(spark, d, "labels"), TOPIC).select("doc_id", "topic")


@query(
    f"""
    SELECT doc_id, 'topic' AS topic, quality AS pro, toxic AS anti,
           CASE WHEN quality IS NULL OR toxic IS NULL THEN 'missing'
                WHEN quality = 1 AND toxic = 1 THEN 'both' ELSE 'other' END AS reason
    FROM {ANNOTATED}
    WHERE quality IS NULL OR toxic IS NULL OR quality NOT IN (0, 1) OR toxic NOT IN (0, 1)
       OR (quality = 1 AND toxic = 1)
    """
)
def stance_conflicts(spark, d):
    return labels.stance_conflicts(annotated(spark, d), TOPIC, "doc_id")


def _predictions(spark: SparkSession, d: str) -> DataFrame:
    """A three-state and a binary label per post, predicted from its length."""
    n = col("n_chars")
    prob = F.lit(0.5) + (n % 1000) / 2000
    stance_truth = F.when(col("quality").isNotNull(), labels.stance(col("quality"), col("toxic")))
    stance_pred = F.when(n < 500, 0).when(n < 2000, 2).otherwise(1)
    rows = F.array(
        F.struct(
            F.lit("topic").alias("label"), stance_truth.alias("ground_truth"),
            stance_pred.alias("prediction"), prob.alias("prob"),
        ),
        F.struct(
            F.lit("quality").alias("label"), col("quality").alias("ground_truth"),
            (n >= 1000).cast("int").alias("prediction"), prob.alias("prob"),
        ),
    )
    return annotated(spark, d).select("doc_id", F.inline(rows))


PREDICTIONS = f"""
    (SELECT doc_id, 'topic' AS label,
            CASE WHEN quality IS NOT NULL THEN CAST({STANCE} AS INTEGER) END AS ground_truth,
            CASE WHEN n_chars < 500 THEN 0 WHEN n_chars < 2000 THEN 2 ELSE 1 END AS prediction,
            CAST(0.5 AS DOUBLE) + CAST(n_chars % 1000 AS DOUBLE) / 2000 AS prob FROM {ANNOTATED}
     UNION ALL
     SELECT doc_id, 'quality', quality, CAST(n_chars >= 1000 AS INTEGER),
            CAST(0.5 AS DOUBLE) + CAST(n_chars % 1000 AS DOUBLE) / 2000 FROM {ANNOTATED})
"""


@query(
    f"""
    SELECT doc_id, label AS key, coalesce(ground_truth, prediction) AS ground_truth, prediction,
           round(prob, 6) AS prob, coalesce(ground_truth, prediction) = prediction AS is_correct
    FROM {PREDICTIONS}
    """
)
def merged_view(spark, d):
    return rounded(labels.merged_view(_predictions(spark, d), "doc_id"), "prob")


_UNMERGED = f"""
    (WITH p AS (SELECT doc_id, label, coalesce(ground_truth, prediction) AS gt, prediction AS pred,
                       prob FROM {PREDICTIONS})
     SELECT doc_id, 'pro topic' AS key, CAST(gt = 1 AS INTEGER) AS ground_truth,
            CAST(pred = 1 AS INTEGER) AS prediction,
            CASE WHEN pred = 2 THEN 0 WHEN pred = 1 THEN prob ELSE 1 - prob END AS prob
     FROM p WHERE label = 'topic'
     UNION ALL
     SELECT doc_id, 'anti topic', CAST(gt = 0 AS INTEGER), CAST(pred = 0 AS INTEGER),
            CASE WHEN pred = 2 THEN 0 WHEN pred = 0 THEN prob ELSE 1 - prob END
     FROM p WHERE label = 'topic'
     UNION ALL
     SELECT doc_id, label, gt, pred, prob FROM p WHERE label <> 'topic')
"""


@query(
    f"""
    SELECT doc_id, key, ground_truth, prediction, round(prob, 6) AS prob,
           ground_truth = prediction AS is_correct,
           CASE WHEN prediction = 1 THEN 'Positive' ELSE 'Negative' END AS polarity
    FROM {_UNMERGED}
    """
)
def unmerge_stance(spark, d):
    return rounded(labels.unmerge_stance(_predictions(spark, d), ["topic"], "doc_id"), "prob")


# Joins


def digest(vector: str = "embedding"):
    """A number that depends on every element of a vector and on its place."""
    weighted = F.transform(vector, lambda x, i: x.cast("double") * (i + 1))
    return F.round(F.aggregate(weighted, F.lit(0.0), lambda t, x: t + x), 4)


DIGEST = """round(list_sum(list_transform(embedding, lambda x, i: CAST(x AS DOUBLE) * i)), 4)"""


def _store(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(col("vec_id").alias("doc_id"), "embedding")


@query(
    f"""
    SELECT l.doc_id, quality, toxic, CAST(len(embedding) AS INTEGER) AS dim, {DIGEST} AS digest
    FROM labels l JOIN embeddings e ON l.doc_id = e.vec_id
    """
)
def attach_embeddings(spark, d):
    joined = keys.attach_embeddings(table(spark, d, "labels"), _store(spark, d), "doc_id")
    return joined.withColumns({"dim": F.size("embedding"), "digest": digest()}).drop("embedding")


@query(
    f"""
    SELECT vec_id AS doc_id, label, CAST(len(embedding) AS INTEGER) AS dim, {DIGEST} AS digest FROM embeddings
    """
)
def attach_embeddings_strict(spark, d):
    posts = table(spark, d, "embeddings").select(col("vec_id").alias("doc_id"), "label")
    joined = keys.attach_embeddings(posts, _store(spark, d), "doc_id", strict=True)
    return joined.withColumns({"dim": F.size("embedding"), "digest": digest()}).drop("embedding")


@query("SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def missing_embeddings(spark, d):
    return keys.missing_keys(table(spark, d, "labels"), _store(spark, d), "doc_id")


@query(
    """
    SELECT doc_id, sha256(text) AS post_digest, sha256(text || '!') AS stored_digest,
           CAST(length(text) AS INTEGER) AS post_chars,
           CAST(length(text) + 1 AS INTEGER) AS stored_chars, true AS in_store
    FROM documents WHERE lang = 'en'
    UNION ALL
    SELECT doc_id, sha256(text), NULL, CAST(length(text) AS INTEGER), NULL, false FROM documents WHERE lang = 'de'
    """
)
def verify_text(spark, d):
    posts = table(spark, d, "documents")
    altered = F.when(col("lang") == "en", F.concat("text", F.lit("!"))).otherwise(col("text"))
    store = posts.withColumn("text", altered).filter("lang <> 'de'")
    return keys.verify_text(posts, store, "doc_id", "text")


@query(
    """
    SELECT l.doc_id, quality, toxic, CAST(n_chars >= 1000 AS INTEGER) AS "pred quality",
           CAST(lang = 'en' AS INTEGER) AS "pred toxic"
    FROM labels l LEFT JOIN documents d USING (doc_id)
    """
)
def align_predictions(spark, d):
    return keys.align_predictions(
        table(spark, d, "labels"), _classified(spark, d), MARKS, "doc_id"
    )


def _classified(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(
        "doc_id",
        (col("n_chars") >= 1000).cast("int").alias("quality"),
        (col("lang") == "en").cast("int").alias("toxic"),
    )


@query(
    """
    SELECT doc_id, source, n_chars FROM documents
    WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)
    """
)
def pick_rows(spark, d):
    wanted = table(spark, d, "labels").filter("toxic = 1")
    posts = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    return keys.pick_rows(posts, wanted, "doc_id")


# Metrics

_PAIRS = f"""
    (SELECT 'quality' AS label, quality AS t, CAST(n_chars >= 1000 AS INTEGER) AS p FROM {LABELLED}
     UNION ALL
     SELECT 'toxic', toxic, CAST(lang = 'en' AS INTEGER) FROM {LABELLED})
"""
_COUNTS = f"""
    (SELECT label, count(*) FILTER (t = 0 AND p = 0) AS tn, count(*) FILTER (t = 0 AND p = 1) AS fp,
            count(*) FILTER (t = 1 AND p = 0) AS fn, count(*) FILTER (t = 1 AND p = 1) AS tp
     FROM {_PAIRS} GROUP BY label)
"""


@query(
    f"""
    SELECT label, tn, fp, fn, tp, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy,
           round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision,
           round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
           round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1,
           round((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, 6) AS roc_auc_hard
    FROM {_COUNTS}
    """
)
def binary_metrics(spark, d):
    scores = evaluate_against_labels(
        _classified(spark, d), table(spark, d, "labels"), MARKS, "doc_id"
    )
    return rounded(scores, "accuracy", "precision", "recall", "f1", "roc_auc_hard")


@query(
    f"""
    SELECT source, tn, fp, fn, tp, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy,
           round(pr, 6) AS precision, round(re, 6) AS recall,
           round(2 * pr * re / nullif(pr + re, 0), 6) AS f1,
           round((re + tn / nullif(tn + fp, 0)) / 2, 6) AS roc_auc_hard
    FROM (SELECT *, tp / nullif(tp + fp, 0) AS pr, tp / nullif(tp + fn, 0) AS re FROM
      (SELECT source, count(*) FILTER (t = 0 AND p = 0) AS tn, count(*) FILTER (t = 0 AND p = 1) AS fp,
              count(*) FILTER (t = 1 AND p = 0) AS fn, count(*) FILTER (t = 1 AND p = 1) AS tp
       FROM (SELECT source, toxic AS t, CAST(n_chars >= 3000 AS INTEGER) AS p FROM {LABELLED})
       GROUP BY source))
    """
)
def binary_metrics_undefined(spark, d):
    rows = labelled(spark, d).select(
        "source", col("toxic").alias("t"), (col("n_chars") >= 3000).cast("int").alias("p")
    )
    scores = metrics.binary_scores(metrics.confusion(rows, ["source"], "t", "p"), "null")
    return rounded(scores, "accuracy", "precision", "recall", "f1", "roc_auc_hard")


def _stance_pairs(spark: SparkSession, d: str) -> DataFrame:
    n = col("n_chars")
    return labelled(spark, d).select(
        "lang",
        labels.stance(col("quality"), col("toxic")).alias("ground_truth"),
        F.when(n < 500, 0).when(n < 2000, 2).otherwise(1).alias("prediction"),
    )


@query(
    f"""
    WITH r AS (SELECT lang, {STANCE} AS t, CASE WHEN n_chars < 500 THEN 0 WHEN n_chars < 2000 THEN 2
               ELSE 1 END AS p FROM {LABELLED}),
         c AS (SELECT DISTINCT lang, t AS c FROM r UNION SELECT DISTINCT lang, p FROM r),
         f AS (SELECT c.lang, c.c, count(*) FILTER (t = c.c) AS support,
                      count(*) FILTER (t = c.c AND p = c.c) AS tp,
                      count(*) FILTER (p = c.c) AS claimed
               FROM c JOIN r USING (lang) GROUP BY ALL)
    SELECT lang, CAST(sum(support) AS BIGINT) AS n_rows, count(*) FILTER (support > 0) AS n_classes,
           round(sum(tp) / sum(support), 6) AS accuracy,
           round(sum(support * coalesce(2 * tp / nullif(support + claimed, 0), 0)) / sum(support), 6)
             AS f1_weighted
    FROM f GROUP BY lang
    """
)
def weighted_f1(spark, d):
    scores = metrics.weighted_f1(_stance_pairs(spark, d), ["lang"])
    return rounded(scores, "accuracy", "f1_weighted")


def _auc_sql(source: str, by: str) -> str:
    """Mid-rank form: (sum of positive ranks - P(P+1)/2) / (P N)."""
    return f"""
        SELECT {by}, CAST(sum(t) AS BIGINT) AS n_pos, CAST(count(*) - sum(t) AS BIGINT) AS n_neg,
               round((sum(r) FILTER (t = 1) - sum(t) * (sum(t) + 1) / 2)
                     / nullif(sum(t) * (count(*) - sum(t)), 0), 6) AS roc_auc
        FROM (SELECT {by}, t, rank() OVER (PARTITION BY {by} ORDER BY s)
                     + (count(*) OVER (PARTITION BY {by}, s) - 1) / 2 AS r FROM {source})
        GROUP BY {by}
    """


_SCORED = f"""
    (SELECT 'quality' AS label, quality AS t, n_chars // 500 AS s FROM {LABELLED}
     UNION ALL SELECT 'toxic', toxic, n_chars FROM {LABELLED})
"""


def _scored(spark: SparkSession, d: str) -> DataFrame:
    rows = F.array(
        F.struct(F.lit("quality").alias("label"), col("quality").alias("ground_truth"),
                 F.expr("n_chars div 500").alias("score")),
        F.struct(F.lit("toxic").alias("label"), col("toxic").alias("ground_truth"),
                 col("n_chars").alias("score")),
    )
    return labelled(spark, d).select(F.inline(rows))


@query(_auc_sql(_SCORED, "label"))
def roc_auc_score(spark, d):
    return rounded(metrics.roc_auc(_scored(spark, d)), "roc_auc")


@query(
    f"""
    SELECT round(avg(roc_auc), 6) AS roc_auc_macro, count(roc_auc) AS n_labels
    FROM ({_auc_sql(_SCORED, 'label').replace(', 6) AS roc_auc', ', 15) AS roc_auc')})
    """
)
def roc_auc_macro(spark, d):
    return rounded(metrics.roc_auc_macro(metrics.roc_auc(_scored(spark, d))), "roc_auc_macro")


@query(
    _auc_sql(
        """(SELECT l_linestatus, CAST(l_returnflag = 'R' AS INTEGER) AS t, l_extendedprice AS s
            FROM lineitem)""",
        "l_linestatus",
    )
)
def roc_auc_many_scores(spark, d):
    rows = table(spark, d, "lineitem").select(
        "l_linestatus", (col("l_returnflag") == "R").cast("int").alias("t"),
        col("l_extendedprice").alias("s"),
    )
    return rounded(metrics.roc_auc(rows, ["l_linestatus"], "t", "s"), "roc_auc")


def _stance_probs(spark: SparkSession, d: str) -> DataFrame:
    """Three class probabilities per labelled post, from its length."""
    n = col("n_chars").cast("double")
    logits = F.array(F.lit(1.0), n / 2000, (F.lit(3000.0) - n) / 1500)
    return labelled(spark, d).select(
        F.lit("topic").alias("label"),
        "doc_id",
        labels.stance(col("quality"), col("toxic")).alias("ground_truth"),
        F.transform(softmax(logits), lambda p: F.round(p, 6)).alias("probs"),
        (1 + col("toxic")).alias("weight"),
    )


_PROBS = f"""
    (SELECT doc_id, t, w, round(e0 / (e0 + e1 + e2), 6) AS p0, round(e1 / (e0 + e1 + e2), 6) AS p1,
            round(e2 / (e0 + e1 + e2), 6) AS p2
     FROM (SELECT doc_id, t, w, exp(z0 - greatest(z0, z1, z2)) AS e0,
                  exp(z1 - greatest(z0, z1, z2)) AS e1, exp(z2 - greatest(z0, z1, z2)) AS e2
           FROM (SELECT doc_id, {STANCE} AS t, 1 + toxic AS w, CAST(1.0 AS DOUBLE) AS z0,
                        CAST(n_chars AS DOUBLE) / 2000 AS z1,
                        (CAST(3000 AS DOUBLE) - n_chars) / 1500 AS z2 FROM {LABELLED})))
"""
_OVO_ROWS = " UNION ALL ".join(
    f"SELECT '{a}{b}' AS pair, CAST(t = {a} AS INTEGER) AS t, p{a} AS s FROM {_PROBS} WHERE t IN ({a}, {b})"
    for a in range(3) for b in range(3) if a != b
)
_OVO = f"(SELECT avg(roc_auc) AS a, count(roc_auc) AS n FROM ({_auc_sql(f'({_OVO_ROWS})', 'pair').replace(', 6) AS roc_auc', ', 15) AS roc_auc')}))"


@query(f"SELECT 'topic' AS label, round(a, 6) AS roc_auc_ovo, n AS n_pairs FROM {_OVO}")
def roc_auc_ovo(spark, d):
    return rounded(metrics.roc_auc_ovo(_stance_probs(spark, d)), "roc_auc_ovo")


@query(
    f"""
    SELECT 'topic' AS label,
           round(sum(-w * ln(greatest(CASE t WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END, 1e-15)))
                 / sum(w), 6) AS log_loss
    FROM {_PROBS}
    """
)
def log_loss(spark, d):
    return rounded(metrics.log_loss(_stance_probs(spark, d), weight="weight"), "log_loss")


_ARGMAX = "CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END"


@query(
    f"""
    WITH r AS (SELECT t, {_ARGMAX} AS p FROM {_PROBS}),
         c AS (SELECT t AS c FROM r UNION SELECT p FROM r),
         f AS (SELECT c, count(*) FILTER (t = c) AS support, count(*) FILTER (p = c) AS claimed,
                      count(*) FILTER (t = c AND p = c) AS tp FROM c, r GROUP BY c)
    SELECT 'topic' AS label, CAST(sum(support) AS BIGINT) AS n_rows,
           count(*) FILTER (support > 0) AS n_classes, round(sum(tp) / sum(support), 6) AS accuracy,
           round(sum(support * coalesce(2 * tp / nullif(support + claimed, 0), 0)) / sum(support), 6)
             AS f1_weighted,
           (SELECT round(a, 6) FROM {_OVO}) AS roc_auc, (SELECT round(a, 6) FROM {_OVO}) AS roc_auc_scores
    FROM f
    """
)
def evaluate_labels(spark, d):
    preds = _stance_probs(spark, d).withColumn("prediction", argmax(col("probs")))
    return rounded(metrics.evaluate(preds), "accuracy", "f1_weighted", "roc_auc", "roc_auc_scores")


@query(
    f"""
    WITH r AS (SELECT toxic AS t, round(n_chars / (n_chars + 2000.0), 6) AS s FROM {LABELLED}),
         k AS (SELECT t, CAST(s > 0.5 AS INTEGER) AS p,
                      rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS rk FROM r),
         f AS (SELECT count(*) AS n, count(*) FILTER (t = 1) AS n1, count(*) FILTER (t = 0) AS n0,
                      count(*) FILTER (p = 1) AS p1, count(*) FILTER (t = 1 AND p = 1) AS tp,
                      count(*) FILTER (t = 0 AND p = 0) AS tn, sum(rk) FILTER (t = 1) AS sr FROM k)
    SELECT 'toxic' AS label, n AS n_rows, CAST(2 AS BIGINT) AS n_classes, round((tp + tn) / n, 6) AS accuracy,
           round((n1 * coalesce(2 * tp / nullif(n1 + p1, 0), 0)
                  + n0 * coalesce(2 * tn / nullif(n0 + n - p1, 0), 0)) / n, 6) AS f1_weighted,
           round((tp / n1 + tn / n0) / 2, 6) AS roc_auc,
           round(CAST((sr - n1 * (n1 + 1) / 2) / (n1 * n0) AS DOUBLE), 6) AS roc_auc_scores
    FROM f
    """
)
def evaluate_two_classes(spark, d):
    """A label with two classes, whose area is that of the hard predictions."""
    n = col("n_chars").cast("double")
    s = F.round(n / (n + 2000), 6)
    preds = labelled(spark, d).select(
        F.lit("toxic").alias("label"), col("toxic").alias("ground_truth"), F.array(1 - s, s).alias("probs")
    ).withColumn("prediction", argmax(col("probs")))
    return rounded(metrics.evaluate(preds), "accuracy", "f1_weighted", "roc_auc", "roc_auc_scores")


@query(
    """
    SELECT vec_id, CAST(list_position(e, list_max(e)) - 1 AS INTEGER) AS prediction,
           round(1 / list_sum(list_transform(e, lambda x: exp(x - list_max(e)))), 6) AS prob,
           round(1 / (1 + exp(-list_sum(e))), 6) AS sigmoid,
           CAST(list_sum(e) > 0 AS INTEGER) AS above_half, CAST(len(e) AS INTEGER) AS dim
    FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
    """
)
def argmax_top_prob(spark, d):
    logits = col("embedding").cast("array<double>")
    total = F.aggregate(logits, F.lit(0.0), lambda t, x: t + x)
    return rounded(
        table(spark, d, "embeddings").withColumn("p", softmax(logits)).select(
            "vec_id",
            argmax(col("p")).alias("prediction"),
            top_probability(col("p")).alias("prob"),
            sigmoid(total).alias("sigmoid"),
            threshold(sigmoid(total)).alias("above_half"),
            F.size("embedding").alias("dim"),
        ),
        "prob", "sigmoid",
    )


@query(
    """
    SELECT user_id, event_id AS epoch, value
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS n
          FROM events WHERE event_type = 'click')
    WHERE n = 1
    """
)
def best_epoch(spark, d):
    log = table(spark, d, "events").select(
        "user_id", col("event_id").alias("epoch"), col("event_type").alias("metric"),
        F.lit("val").alias("split"), "value",
    )
    return metrics.best_epoch(log, "click", "val", ["user_id"])


# Splits and weights


@query(
    """
    SELECT doc_id, CASE WHEN md5('42:' || doc_id) < 'b3333333' THEN 'train'
                        WHEN md5('42:' || doc_id) < 'e8f5c28f' THEN 'val' ELSE 'test' END AS split
    FROM documents
    """
)
def key_split(spark, d):
    return sampling.split_by_key(table(spark, d, "documents").select("doc_id"), "doc_id")


@query(
    """
    SELECT doc_id, CASE WHEN n < ceil(0.3 * ceil(0.3 * total)) THEN 'test'
                        WHEN n < ceil(0.3 * total) THEN 'val' ELSE 'train' END AS split
    FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id)) - 1 AS n,
                 count(*) OVER () AS total FROM documents)
    """
)
def exact_split(spark, d):
    return sampling.split_exact(table(spark, d, "documents").select("doc_id"), "doc_id")


@query(
    """
    SELECT CASE WHEN md5('42:' || doc_id) < 'b3333333' THEN 'train'
                WHEN md5('42:' || doc_id) < 'e8f5c28f' THEN 'val' ELSE 'test' END AS split,
           count(*) AS n_rows
    FROM documents GROUP BY 1
    """
)
def split_sizes(spark, d):
    return sampling.split_sizes(sampling.split_by_key(table(spark, d, "documents"), "doc_id"))


@query(
    """
    SELECT doc_id, quality,
           CAST((row_number() OVER (PARTITION BY quality ORDER BY md5('42:' || doc_id)) - 1) % 5
                AS INTEGER) AS fold
    FROM labels
    """
)
def stratified_folds(spark, d):
    rows = table(spark, d, "labels").select("doc_id", "quality")
    return sampling.stratified_folds(rows, "quality", 5, "doc_id")


_CLASSES = " UNION ALL ".join(
    f"SELECT '{n}' AS label, {n} AS class, count(*) AS n_rows FROM labels GROUP BY {n}" for n in MARKS
)


@query(_CLASSES)
def class_counts(spark, d):
    return sampling.class_counts(table(spark, d, "labels"), MARKS)


@query(f"SELECT label, count(*) AS n_classes FROM ({_CLASSES}) GROUP BY label")
def n_classes(spark, d):
    return sampling.n_classes(table(spark, d, "labels"), MARKS)


@query(
    """
    SELECT 'label' AS label, label AS class, count(*) AS n_rows,
           round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight
    FROM embeddings GROUP BY embeddings.label
    """
)
def class_weights(spark, d):
    return rounded(sampling.class_weights(table(spark, d, "embeddings"), ["label"]), "weight")


@query(
    " UNION ALL ".join(
        f"""SELECT '{n}' AS label, round((count(*) - sum({n})) / (sum({n}) + 1e-5), 6) AS weight
            FROM labels"""
        for n in MARKS
    )
)
def pos_weights(spark, d):
    return rounded(sampling.pos_weights(table(spark, d, "labels"), MARKS), "weight")


# Embeddings


@query(
    """
    SELECT CAST(min(len(embedding)) AS INTEGER) AS shortest,
           CAST(max(len(embedding)) AS INTEGER) AS longest, count(*) AS n_rows FROM embeddings
    """
)
def vector_lengths(spark, d):
    return embed.vector_lengths(table(spark, d, "embeddings"))


@query(
    """
    SELECT doc_id, CAST(length(text) AS FLOAT) AS chars,
           CAST(length(text) - length(replace(text, chr(10), '')) AS FLOAT) AS breaks,
           CAST(length(text) - length(replace(text, ' ', '')) AS FLOAT) AS spaces
    FROM documents
    """
)
def embed_with_function(spark, d):
    """An embedder without a model: characters, line breaks and spaces of each text."""

    def load():
        return lambda texts: [[len(t), t.count("\n"), t.count(" ")] for t in texts]

    vectors = embed.embed_text(table(spark, d, "documents"), load, "text", "doc_id")
    names = ["chars", "breaks", "spaces"]
    return vectors.select("doc_id", *[F.get("embedding", F.lit(i)).alias(n) for i, n in enumerate(names)])


def _norm():
    squares = F.aggregate("embedding", F.lit(0.0), lambda t, x: t + x.cast("double") * x)
    return F.round(F.sqrt(squares), 3).alias("norm")


_HAS_TERMS = "regexp_matches(coalesce(text, ''), '[\\p{L}\\p{N}]')"


@query(f"SELECT doc_id, CAST(256 AS INTEGER) AS dim, {_HAS_TERMS} AS has_terms FROM documents")
def embed_documents(spark, d):
    """TF-IDF vectors: zero just for texts without a term."""
    posts = table(spark, d, "documents")
    vectors = embed.embed_text(posts, embed.fit_tfidf(posts, "text"), "text", "doc_id")
    return vectors.select("doc_id", F.size("embedding").alias("dim"), (_norm() > 0).alias("has_terms"))


@query(
    f"""
    SELECT doc_id, CAST(64 AS INTEGER) AS dim, CAST({_HAS_TERMS} AS DOUBLE) AS norm FROM documents
    WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)
    """
)
def embed_missing(spark, d):
    new = embed.embed_missing(
        table(spark, d, "documents"), _store(spark, d), "hashing", "text", "doc_id", dim=64
    )
    return new.select("doc_id", F.size("embedding").alias("dim"), _norm())


@query(
    """
    SELECT round(sum(v), 6) AS total_variance
    FROM (SELECT var_pop(CAST(x AS DOUBLE)) AS v
          FROM (SELECT unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)
          GROUP BY i)
    """
)
def pca_keeps_variance(spark, d):
    """All components together hold the variance of the embeddings."""
    store = table(spark, d, "embeddings")
    n = embed.embedding_dim(store)
    parts = embed.pca(store, n).select(F.posexplode("components"))
    by_component = parts.groupBy("pos").agg(F.var_pop("col").alias("v"))
    return rounded(by_component.agg(F.sum("v").alias("total_variance")), "total_variance")


@query("SELECT vec_id, label, true AS centred FROM embeddings")
def pca_project(spark, d):
    """Two components of every vector; they are centred, uncorrelated and in falling order."""
    parts = embed.pca(table(spark, d, "embeddings"), 2)
    x, y = F.get("components", F.lit(0)), F.get("components", F.lit(1))
    holds = parts.agg(
        (
            (F.abs(F.avg(x)) < 1e-6) & (F.abs(F.avg(y)) < 1e-6) & (F.abs(F.covar_pop(x, y)) < 1e-6)
            & (F.var_pop(x) >= F.var_pop(y))
        ).alias("centred")
    )
    # The broadcast side is one row.
    return parts.select("vec_id", "label", F.lit(1).alias("_one")).join(
        F.broadcast(holds.withColumn("_one", F.lit(1))), "_one"
    ).drop("_one")


# Training and scoring


def _training_set(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings with a ten-class, a three-state and a binary label."""
    return table(spark, d, "embeddings").select(
        col("vec_id").alias("code"), "embedding", "label",
        (col("label") % 3).alias("stance"), (col("label") > 4).cast("int").alias("upper"),
    )


LEARNT = ["label", "stance", "upper"]


@query(
    """
    SELECT vec_id AS code, CAST(label AS DOUBLE) AS label, CAST(len(embedding) AS INTEGER) AS dim,
           round(count(*) OVER () / ((SELECT count(DISTINCT label) FROM embeddings)
                                     * count(*) OVER (PARTITION BY label)), 6) AS weight
    FROM embeddings
    """
)
def training_frame(spark, d):
    data = _training_set(spark, d)
    weights = train.weights_by_label(data, ["label"])["label"]
    frame = sampling.training_frame(data, "label", weights=weights)
    return rounded(frame, "weight").select(
        "code", "label", F.size(vector_to_array("features")).alias("dim"), "weight"
    )


_TRUTH = """CASE l.label WHEN 'label' THEN e.label WHEN 'stance' THEN e.label % 3
                         ELSE CAST(e.label > 4 AS INTEGER) END"""
_LEARNT = "(VALUES ('label'), ('stance'), ('upper')) l(label)"
_SPLIT = """CASE WHEN md5('42:' || vec_id) < 'b3333333' THEN 'train'
                 WHEN md5('42:' || vec_id) < 'e8f5c28f' THEN 'val' ELSE 'test' END"""


@query(
    f"""
    WITH n AS (SELECT {_SPLIT} AS split, count(*) AS n FROM embeddings GROUP BY 1)
    SELECT 'stance' AS label, CAST(epoch AS INTEGER) AS epoch, split, metric, n AS n_rows, true AS in_range,
           true AS whole_rows, true AS learnt
    FROM (SELECT unnest(range(5, 301, 5)) AS epoch) CROSS JOIN (SELECT * FROM n WHERE split <> 'test')
    CROSS JOIN (VALUES ('accuracy'), ('f1'), ('rocauc'), ('loss')) m(metric)
    """
)
def epoch_log(spark, d):
    """The log of a deep network over the usual number of epochs, scored every fifth.

    An accuracy is a share of the rows of its split, and training ends better than it began.
    """
    parts = sampling.split_by_key(_training_set(spark, d), "code")
    run = train.fit_epochs(parts.filter("split = 'train'"), parts.filter("split = 'val'"), "stance")
    sizes = parts.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"))
    is_loss = col("metric") == "loss"
    in_range = F.when(is_loss, col("value") >= 0).otherwise(col("value").between(0, 1))
    hits = col("value") * col("n_rows")
    ends = run.log.filter("split = 'train'").groupBy("metric").agg(
        F.min_by("value", "epoch").alias("first"), F.max_by("value", "epoch").alias("last")
    )
    # Both lookups have a row per split or metric.
    return run.log.join(sizes, "split").join(ends, "metric").select(
        "label", "epoch", "split", "metric", "n_rows", in_range.alias("in_range"),
        ((col("metric") != "accuracy") | (F.abs(hits - F.round(hits)) < 1e-6)).alias("whole_rows"),
        F.when(is_loss, col("last") < col("first")).otherwise(col("last") > col("first")).alias("learnt"),
    )


@query(
    """
    SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_contradictions, count(*) AS n_in_domain,
           true AS beats_majority FROM embeddings
    """
)
def classified_posts(spark, d):
    """The wide table of predictions: no post is both pro and anti."""
    data = _training_set(spark, d)
    models = train.train_labels(data, ["stance", "upper"])
    posts = data.select("code", "label")
    wide = classify_posts(posts, data.select("code", "embedding"), models, ["stance"])
    pro, anti = col("pro stance"), col("anti stance")
    is_upper = (col("label") > 4).cast("int")
    return wide.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if((pro == 1) & (anti == 1)).alias("n_contradictions"),
        F.count_if(pro.isin(0, 1) & anti.isin(0, 1) & col("upper").isin(0, 1)).alias("n_in_domain"),
        (F.count_if(col("upper") == is_upper) > F.greatest(F.sum(is_upper), F.sum(1 - is_upper))).alias("beats_majority"),
    )


@query(
    """
    SELECT label, count(*) AS n_rows, count(*) AS n_sum_to_one, true AS better_than_guessing FROM documents
    CROSS JOIN (VALUES ('quality'), ('toxic')) l(label) GROUP BY label
    """
)
def text_classifier(spark, d):
    """From raw text: embed, train on the annotated posts, predict every post."""
    posts = annotated(spark, d).select(
        col("doc_id").cast("string").alias("code"), col("text").alias("post"), *MARKS
    )
    embedder = embed.fit_tfidf(posts)
    vectors = embed.embed_text(posts, embedder)
    known = keys.attach_embeddings(posts.drop("post").na.drop(), vectors, strict=True)
    models = train.train_labels(known, MARKS)
    preds = predict_from_text(posts, models, embedder)
    total = F.aggregate("probs", F.lit(0.0), lambda a, p: a + p)
    truth = posts.unpivot(["code"], MARKS, "label", "truth")
    hits = [F.avg(F.when(col("truth") == k, (col("prediction") == k).cast("double"))) for k in (0, 1)]
    return preds.join(truth, ["code", "label"]).groupBy("label").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.abs(total - 1) < 1e-6).alias("n_sum_to_one"),
        # Class weights aim at both classes alike: chance is a mean recall of one half.
        ((hits[0] + hits[1]) / 2 > 0.5).alias("better_than_guessing"),
    )


@query(
    f"""
    SELECT {_SPLIT} AS split, l.label, count(*) AS n_rows, count(DISTINCT {_TRUTH}) AS n_classes, true AS in_range
    FROM embeddings e CROSS JOIN {_LEARNT} GROUP BY ALL
    """
)
def train_and_score(spark, d):
    """Scores of every split and label after training on one split."""
    _, scores = train_and_test(_training_set(spark, d), LEARNT, model_root=scratch_path(spark, "models"))
    in_range = [col(n).between(0, 1) for n in ("accuracy", "f1_weighted", "roc_auc", "roc_auc_scores")]
    return scores.select(
        "split", "label", "n_rows", "n_classes", (in_range[0] & in_range[1] & in_range[2] & in_range[3]).alias("in_range")
    )


@query(
    """
    SELECT split, metric, CAST(5 AS BIGINT) AS n_splits, true AS in_range, 'stance' AS label
    FROM (VALUES ('Train'), ('Validation')) s(split)
    CROSS JOIN (VALUES ('accuracy'), ('f1_weighted'), ('roc_auc')) m(metric)
    """
)
def cross_validation(spark, d):
    scores = cross_validate(_training_set(spark, d), "stance")
    in_range = col("mean").between(0, 1) & (col("spread") >= 0)
    return scores.select("split", "metric", "n_splits", in_range.alias("in_range"), "label")


@query(
    f"""
    SELECT l.label, count(*) AS n_rows, count(*) AS n_sum_to_one, count(*) AS n_in_domain,
           CAST(sum({_TRUTH}) AS BIGINT) AS truth_sum, true AS beats_majority
    FROM embeddings e CROSS JOIN {_LEARNT} GROUP BY l.label
    """
)
def predict_coverage(spark, d):
    """Every post gets, per label, one prediction in the domain and proper probabilities."""
    data = _training_set(spark, d)
    root = scratch_path(spark, "models")
    sources.save_models(train.train_labels(data, LEARNT), root)
    preds = train.predict_labels(data, sources.load_models(root, LEARNT))
    total = F.aggregate("probs", F.lit(0.0), lambda a, p: a + p)
    # One aggregate per label and class: each post is predicted once.
    counts = preds.groupBy("label", "ground_truth").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(col("ground_truth") == col("prediction")).alias("hits"),
        F.count_if(F.abs(total - 1) < 1e-6).alias("proper"),
        F.count_if((col("prediction") >= 0) & (col("prediction") < F.size("probs"))).alias("known"),
    )
    return counts.groupBy("label").agg(
        F.sum("n").alias("n_rows"), F.sum("proper").alias("n_sum_to_one"), F.sum("known").alias("n_in_domain"),
        F.sum(col("n") * col("ground_truth")).alias("truth_sum"),
        (F.sum("hits") > F.max("n")).alias("beats_majority"),
    )


@query("SELECT vec_id AS code, label, quality FROM (SELECT vec_id, label, label % 3 AS quality FROM embeddings)")
def all_but_the_text(spark, d):
    """Key and every label of a table, taken without naming the labels."""
    data = table(spark, d, "embeddings").select(
        col("vec_id").alias("code"), F.lit("text").alias("post"), "label", (col("label") % 3).alias("quality")
    )
    return clean.training_view(data).drop("post")


@query("SELECT doc_id, quality, toxic FROM labels WHERE doc_id IN (1, 3, 7, 100, 500)")
def pick_listed_rows(spark, d):
    return keys.pick_rows(table(spark, d, "labels"), [1, 3, 7, 100, 500], "doc_id")


@query(
    f"""
    SELECT l.label, count(*) AS n_rows, CAST(0 AS BIGINT) AS n_differences
    FROM embeddings e CROSS JOIN {_LEARNT} GROUP BY l.label
    """
)
def predict_stacked(spark, d):
    """All linear models applied as one matrix give what each of them gives."""
    data = _training_set(spark, d)
    models = train.train_labels(data, LEARNT, max_iter=10)
    single = train.predict_labels(data, models).select("code", "label", "prediction", "ground_truth", "probs")
    stacked = train.predict_stacked(data, models).select("code", "label", *[
        col(n).alias(f"stacked_{n}") for n in ("prediction", "ground_truth", "probs")
    ])
    furthest = F.array_max(F.zip_with("probs", "stacked_probs", lambda a, b: F.abs(a - b)))
    same = (furthest < 1e-9) & (F.size("probs") == F.size("stacked_probs")) & (
        col("prediction") == col("stacked_prediction")) & (col("ground_truth") == col("stacked_ground_truth"))
    return single.join(stacked, ["code", "label"]).groupBy("label").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(~same).alias("n_differences")
    )


@query(
    """
    SELECT l.label, count(*) AS n_rows, CAST(0 AS BIGINT) AS n_differences
    FROM embeddings CROSS JOIN (VALUES ('stance'), ('upper')) l(label) GROUP BY l.label
    """
)
def stream_scores(spark, d):
    """Posts scored as a stream get the predictions of a batch."""
    data = _training_set(spark, d).select("code", "embedding", "stance", "upper")
    models = train.train_labels(data, ["stance", "upper"])
    folder = scratch_path(spark, "arriving")
    sources.write_posts(data, folder)
    path, checkpoint = scratch_path(spark, "scored"), scratch_path(spark, "offsets")
    run_to_end(score_stream(read_stream(spark, folder, data.schema), models), path, checkpoint)
    pick = ["code", "label", "prediction", "prob"]
    streamed = spark.read.parquet(path).select(*pick)
    batch = train.predict_labels(data, models).select(*pick)
    both = streamed.withColumn("n", F.lit(1)).unionByName(batch.withColumn("n", F.lit(-1)))
    per_row = both.groupBy(*pick).agg(F.sum("n").alias("n"), F.count_if(col("n") > 0).alias("rows"))
    return per_row.groupBy("label").agg(
        F.sum("rows").alias("n_rows"), F.sum(F.abs("n")).alias("n_differences")
    )


@query(
    """
    SELECT l.label, (SELECT count(*) FROM documents) AS n_rows, CAST(0 AS BIGINT) AS n_differences
    FROM (VALUES ('quality'), ('toxic')) l(label)
    """
)
def stream_raw_posts(spark, d):
    """Raw posts that arrive in several files, some of them again: embedded and scored once each.

    The stream stops halfway and goes on when the rest has arrived. What it has stored is what a batch gives.
    """
    posts = annotated(spark, d).select(col("doc_id").cast("string").alias("code"), col("text").alias("post"), *MARKS)
    vectors = embed.embed_text(posts, "hashing", dim=64)
    known = keys.attach_embeddings(posts.drop("post").na.drop(), vectors, strict=True)
    models = train.train_labels(known, MARKS, max_iter=10)
    raw = posts.select("code", "post")
    names = ("arriving", "predictions", "vectors", "offsets")
    folder, preds, store, offsets = (scratch_path(spark, n) for n in names)

    def run():
        stream = first_arrivals(read_arrivals(spark, folder, raw.schema, maxFilesPerTrigger=4))
        score_raw_stream(stream, models, "hashing", preds, store, offsets, dim=64)

    half = F.xxhash64("code") > 0
    sources.write_posts(raw.filter(half), folder)
    run()
    # The second delivery holds the first one too.
    sources.write_posts(raw, folder, mode="append")
    run()
    pick = ["code", "label", "prediction", F.round("prob", 6).alias("prob")]
    streamed = read_batches(spark, preds).select(*pick)
    stored = read_batches(spark, store).select("code", "embedding")
    batch = predict_from_text(raw, models, "hashing", dim=64).select(*pick)
    again = train.predict_labels(stored, models).select(*pick)
    parts = [(streamed, 2), (batch, -1), (again, -1)]
    both = functools.reduce(DataFrame.unionByName, [p.withColumn("n", F.lit(n)) for p, n in parts])
    per_row = both.groupBy("code", "label", "prediction", "prob").agg(
        F.sum("n").alias("n"), F.count_if(col("n") == 2).alias("rows")
    )
    return per_row.groupBy("label").agg(F.sum("rows").alias("n_rows"), F.sum(F.abs("n")).alias("n_differences"))


# Sources, sinks, streams


@query("SELECT CAST(doc_id AS VARCHAR) AS code, text AS post, source AS username, lang FROM documents")
def posts_csv_round_trip(spark, d):
    path = scratch_path(spark, "posts")
    posts = table(spark, d, "documents").select(
        F.concat(F.lit("https://example.org/"), col("doc_id")).alias("permalink"), "lang",
        col("source").alias("username"), col("text").alias("post"),
    )
    sources.export_csv(posts, path)
    back = clean.extract_code(sources.read_posts(spark, path))
    return back.select("code", "post", "username", "lang")


@query(
    """
    SELECT CAST(doc_id AS VARCHAR) AS code, quality AS "pro peace", toxic AS "pro war"
    FROM documents LEFT JOIN labels USING (doc_id)
    """
)
def labelled_csv_round_trip(spark, d):
    path = scratch_path(spark, "labelled")
    nan = F.lit(float("nan"))
    sheet = annotated(spark, d).select(
        F.coalesce(col("quality").cast("double"), nan).alias("Pro peace,"),
        F.coalesce(col("toxic").cast("double"), nan).alias("Pro War"),
        F.concat(F.lit("https://example.org/"), col("doc_id")).alias("permalink"),
    )
    sources.export_csv(sheet, path)
    back = clean.extract_code(sources.read_labelled(spark, path))
    return back.select("code", "pro peace", "pro war")


@query(
    f"""
    SELECT CAST(vec_id AS VARCHAR) AS code, CAST(len(embedding) AS INTEGER) AS dim, {DIGEST} AS digest
    FROM embeddings
    """
)
def embedding_store_round_trip(spark, d):
    path = scratch_path(spark, "embeddings")
    store = table(spark, d, "embeddings").select(
        col("vec_id").cast("string").alias("code"), col("embedding").alias("vector")
    )
    sources.write_embeddings(store, path)
    return sources.read_embeddings(spark, path, vector="vector").select(
        "code", F.size("embedding").alias("dim"), digest().alias("digest")
    )


@query(
    """
    SELECT doc_id, CAST(length(text) AS FLOAT) AS chars,
           CAST(length(text) - length(replace(text, chr(10), '')) AS FLOAT) AS breaks,
           (SELECT count(DISTINCT text) FROM documents) AS n_embedded, CAST(0 AS BIGINT) AS n_again
    FROM documents
    """
)
def embed_by_content(spark, d):
    """Equal texts are embedded once, wave by wave into a versioned store; a second run finds nothing to do."""

    def load():
        return lambda texts: [[len(t), t.count("\n")] for t in texts]

    path = scratch_path(spark, "by-content")
    posts = table(spark, d, "documents").select("doc_id", "text")
    sources.create_store(spark, path, buckets=8)
    found, again = (embed_texts(posts, path, load, "text", wave_texts=50_000) for _ in range(2))
    vector = lambda i: F.get("embedding", F.lit(i))
    return attach_by_text(posts, path, "text").select(
        "doc_id", vector(0).alias("chars"), vector(1).alias("breaks"), F.lit(found).cast("long").alias("n_embedded"),
        F.lit(again).cast("long").alias("n_again"),
    )


@query(
    f"""
    SELECT CAST(vec_id AS VARCHAR) AS code, CAST(len(embedding) AS INTEGER) AS dim, {DIGEST} AS digest
    FROM embeddings
    """
)
def versioned_store_round_trip(spark, d):
    """Two deliveries that overlap, then put into one part: every key once, every vector as it came."""
    path = scratch_path(spark, "versioned")
    rows = table(spark, d, "embeddings").select(col("vec_id").cast("string").alias("code"), "embedding", "label")
    sources.create_store(spark, path, buckets=8)
    sources.add_rows(spark, path, rows.filter("label < 6").drop("label"))
    sources.add_rows(spark, path, rows.drop("label"))
    sources.compact_store(spark, path)
    return sources.read_store(spark, path).select("code", F.size("embedding").alias("dim"), digest().alias("digest"))


@query("SELECT doc_id, quality, toxic FROM labels WHERE toxic = 0")
def relevant_posts(spark, d):
    path = scratch_path(spark, "relevant")
    rows = table(spark, d, "labels")
    sources.write_posts(clean.keep_zero(rows, "toxic"), path)
    return sources.read_classified(spark, f"{d}/labels.parquet", path, relevant_only=True)


@query(f"SELECT doc_id, quality, toxic, CAST({STANCE} AS INTEGER) AS topic FROM labels")
def stream_stance(spark, d):
    schema = table(spark, d, "labels").schema
    # A pattern, as the table may be one file or a folder of files: Spark takes a plain path for a folder.
    stream = read_stream(spark, f"{d}/{{labels}}.parquet", schema, basePath=d)
    path, checkpoint = scratch_path(spark, "stances"), scratch_path(spark, "offsets")
    run_to_end(stance_stream(stream, TOPIC), path, checkpoint)
    return spark.read.parquet(path)
