"""Lines that follow a template which recurs across documents are dropped.

The templates come from a log-parsing tree of fixed depth: a line goes by its number of tokens
and its first tokens, numbers masked, to a leaf. In a leaf that many documents reach, tokens
that few of its lines have at their place are variable fields and become a wild card; what
remains is the template of the line. Templates are counted over documents. Only DataFrame functions
are used: documents are never gathered by leaf, the constant tokens of a leaf are rows, however many,
and leaves, tokens and templates meet aggregates that combine before the shuffle, and joins that
adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stancewright.llm.scratch import written
from stancewright.operators.keys import own_shuffle

WILD = "<*>"


def _tokens(line: Column) -> Column:
    """Pieces between blanks; other white space counts as a blank."""
    return F.split(F.trim(F.translate(line, "\t\r\x0b\x0c", "    ")), " +")


def _masked(token: Column) -> Column:
    return F.when(token.rlike("[0-9]"), F.lit(WILD)).otherwise(token)


def _leaf(depth: int) -> Column:
    lead = [F.coalesce(_masked(F.get("tokens", F.lit(i))), F.lit("")) for i in range(depth)]
    return F.xxhash64(F.size("tokens"), *lead)


def drop_recurring_lines(
    docs: DataFrame, min_docs: int = 5, depth: int = 3, max_wild: float = 0.5,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: id, ``n_lines``, ``n_dropped``, ``kept_text``.

    A line is dropped if its template occurs in at least ``min_docs`` documents and at most the
    share ``max_wild`` of its tokens is variable: holds a digit, or is found at its place in
    fewer than ``min_docs`` lines of its leaf. How many other lines the leaf has does not matter.
    Lines are parted by a line feed; lines without a token stay. Rows that repeat both id and text
    count as one document and get one result. NULL is an empty text, of one empty line; a NULL id is an
    id. An empty table gives an empty one; other columns are not read.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    id_ = F.col(f"`{id_col}`")
    # A document goes by its id and a hash of its text, so that no two ids are taken for one.
    rows = docs.select(
        id_.alias("_id"), text.alias("text"), F.struct(id_.cast("string").alias("id"), F.xxhash64(text).alias("h")).alias("key")
    )
    # What all lines leave behind is narrow; only lines in recurring leaves are read again.
    split = rows.select("key", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    lines = written(
        split.select("key", "line_no", _tokens(F.col("line")).alias("tokens"))
        .where(F.get("tokens", F.lit(0)) != "").select("key", "line_no", _leaf(depth).alias("leaf")),
        "line-leaves",
    )
    leaves = (
        lines.select("leaf", "key").distinct().groupBy("leaf")
        .agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select("leaf")
    )
    wanted = lines.join(own_shuffle(leaves), "leaf").groupBy("key").agg(
        F.collect_set(F.struct("line_no", "leaf")).alias("wanted")
    )
    picked = rows.join(wanted, "key").select("key", F.split("text", "\n").alias("lines"), F.explode("wanted").alias("w"))
    # From here on a line goes by a number of its own; the table fixes the numbers.
    members = written(
        picked.select(
            "key", "w.line_no", "w.leaf", F.transform(_tokens(F.get("lines", F.col("w.line_no"))), _masked).alias("tokens"),
            F.monotonically_increasing_id().alias("line"),
        ),
        "leaf-lines",
    )
    placed = members.select("line", "leaf", F.posexplode("tokens").alias("place", "token"))
    at = ("leaf", "place", "token")
    # Without the hint a hot token of a hot leaf would be one task of the join.
    constant = own_shuffle(
        placed.where(F.col("token") != WILD).groupBy(*at).agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= min_docs).select(*at, F.lit(True).alias("constant"))
    )
    known = F.when(F.col("constant"), F.col("token")).otherwise(F.lit(WILD))
    whole = placed.join(constant, list(at), "left").groupBy("line").agg(
        F.sort_array(F.collect_list(F.struct("place", known.alias("token"))))["token"].alias("template")
    )
    n_wild = F.size(F.filter("template", lambda t: t == WILD))
    few = (n_wild <= max_wild * F.size("template")) & (n_wild < F.size("template"))
    named = whole.where(few).select("line", F.sha2(F.array_join("template", " "), 256).alias("template"))
    templated = written(
        members.select("line", "key", "line_no").join(named, "line").select("key", "line_no", "template"), "line-templates"
    )
    recurring = (
        templated.select("template", "key").distinct().groupBy("template")
        .agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select("template")
    )
    gone = templated.join(own_shuffle(recurring), "template").groupBy("key").agg(F.collect_set("line_no").alias("gone"))
    every = F.split("text", "\n")
    joined = rows.join(gone, "key", "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))
    kept = F.filter(every, lambda line, i: ~F.array_contains("gone", i))
    return joined.select(
        F.col("_id").alias(id_col), F.size(every).cast("long").alias("n_lines"),
        F.size("gone").cast("long").alias("n_dropped"), F.array_join(kept, "\n").alias("kept_text"),
    )
