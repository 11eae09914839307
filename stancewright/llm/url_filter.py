"""URL verdicts by rules, and by logistic regression where no rule fits.

Features are hashed character n-grams of host and path. Everything is column expressions and
Spark ML: pages are neither shuffled nor handed to Python.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK, ALLOW = "block", "allow"
#: Labelled URLs that the model is fitted on at most.
SAMPLE = 2000
BUCKETS = 1 << 12
GRAMS = (3, 4)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The part after ``://`` up to ``/ ? #``, A-Z lower-cased, and from there up to ``? #``.

    Both are empty for NULL and for a URL without ``://``.
    """
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host, slash + path


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest of (verdict, rule) that fits; NULL if none does.

    A rule is a host, which stands for its subdomains too, and a path that the URL's path
    must start with. Rules of one length are tried in alphabetical order. ``rules`` is a short
    list that becomes part of the expression.
    """
    found = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1]), reverse=True):
        rule_host, rule_path = split_rule(rule)
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(
            path, F.lit(rule_path)
        )
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def rule_verdict(rule: Column, rules: Sequence[tuple[str, str]]) -> Column:
    verdict = F.lit(None).cast("string")
    for value, name in rules:
        verdict = F.when(rule == name, F.lit(value)).otherwise(verdict)
    return verdict


def _grams(text: Column, mark: str) -> Column:
    """Character n-grams, edges marked, each tagged with the field it comes from."""
    framed = F.concat(F.lit("^"), text, F.lit("$"))

    def of_length(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(framed) - n + 1, F.lit(1)))
        return F.transform(starts, lambda i: F.concat(F.lit(mark), F.substring(framed, i, F.lit(n))))

    return F.concat(*[of_length(n) for n in GRAMS])


def features(host: Column, path: Column) -> Column:
    return F.concat(_grams(host, "h"), _grams(path, "p"))


def fit_urls(labelled: DataFrame, sample: int = SAMPLE) -> PipelineModel | None:
    """A model from ``url`` and ``blocked`` (0 or 1); None if no row is labelled.

    Of a larger table the ``sample`` rows with the smallest hash of the URL are used. Rows with a
    NULL in either column are left out; repeated rows count once.
    """
    rows = labelled.select("url", F.col("blocked").cast("double")).dropna().distinct()
    rows = rows.orderBy(F.xxhash64("url"), "url", "blocked").limit(sample)
    host, path = host_and_path(F.col("url"))
    rows = rows.select(features(host, path).alias("grams"), "blocked")
    if rows.isEmpty():
        return None
    hashing = HashingTF(inputCol="grams", outputCol="vector", numFeatures=BUCKETS, binary=True)
    regression = LogisticRegression(
        featuresCol="vector", labelCol="blocked", regParam=0.01, maxIter=50,
        rawPredictionCol="raw", probabilityCol="probability", predictionCol="predicted",
    )
    return PipelineModel([hashing, regression.fit(hashing.transform(rows))])


def judge_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str]], model: PipelineModel | None,
    id_col: str = "page_id", url_col: str = "url",
) -> DataFrame:
    """One row per row of ``pages``: id, host, path, rule, verdict, p_block.

    The verdict is the rule's where one fits. Elsewhere it is ``block`` from a probability of
    one half, or ``allow`` without a model. NULL and malformed URLs have empty parts, which no
    rule fits, and are judged like any other. Repeated rows are judged alike; an empty table
    gives an empty one; other columns are not read.
    """
    host, path = host_and_path(F.col(f"`{url_col}`"))
    rows = pages.select(F.col(f"`{id_col}`").alias("_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("rule", matched_rule(F.col("host"), F.col("path"), rules))
    if model is None:
        rows = rows.withColumn("p_block", F.lit(0.0))
    else:
        scored = model.transform(rows.withColumn("grams", features(F.col("host"), F.col("path"))))
        rows = scored.withColumn("p_block", F.get(vector_to_array("probability"), F.lit(1)))
    fitted = F.when(F.col("p_block") >= 0.5, BLOCK).otherwise(ALLOW)
    return rows.select(
        F.col("_id").alias(id_col), "host", "path", "rule",
        F.coalesce(rule_verdict(F.col("rule"), rules), fitted).alias("verdict"), "p_block",
    )


def labelled_by_rules(
    pages: DataFrame, rules: Sequence[tuple[str, str]], url_col: str = "url"
) -> DataFrame:
    """``url`` and ``blocked`` of the pages that a rule decides, to fit a model on."""
    host, path = host_and_path(F.col(f"`{url_col}`"))
    verdict = rule_verdict(matched_rule(host, path, rules), rules)
    return pages.select(F.col(f"`{url_col}`").alias("url"), (verdict == BLOCK).cast("int").alias("blocked")).where(
        "blocked is not null"
    )
