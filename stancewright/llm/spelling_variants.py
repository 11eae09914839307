"""Words that are spelling variants of a far more frequent word.

Two words are near when one inserted, deleted or replaced character turns one into the other.
Candidates come from a reduced alphabet: every letter is hashed to one of a few symbols, so one
edit of a word is at most one edit of its reduced form, and the whole one-edit neighbourhood of
a reduced form is small enough to be written out. Neighbourhoods are joined with the reduced
vocabulary, and what meets is verified on the words themselves, so the reduction can only add
candidates and never lose a pair.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stancewright.llm.scratch import written

#: The symbols grow slowly with the vocabulary, so that a reduced form stands for few words.
GROWTH = 0.15
LEAST_SYMBOLS, MOST_SYMBOLS = 4, 64
_FIRST_SYMBOL = 0x30


def symbol_count(vocabulary: int) -> int:
    return min(MOST_SYMBOLS, max(LEAST_SYMBOLS, round(vocabulary**GROWTH)))


def _symbol(letter: str, symbols: int) -> str:
    return chr(_FIRST_SYMBOL + zlib.crc32(letter.encode()) % symbols)


def count_words(occurrences: DataFrame, min_length: int = 7, min_count: int = 2, word_col: str = "word") -> DataFrame:
    """``word`` and ``n`` of the words of ``min_length`` characters that occur ``min_count`` times.

    One row of ``occurrences`` is one occurrence; NULL words are passed over. Equal words are
    combined before the shuffle, so a word with a third of all occurrences is one row a task.
    """
    word = F.col(f"`{word_col}`")
    return (
        occurrences.where(F.length(word) >= min_length).groupBy(word.alias("word"))
        .agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)
    )


def _reduced(vocabulary: DataFrame, symbols: int) -> Column:
    """The word with every letter replaced by its symbol.

    The letters in use are gathered; there are at most as many as Unicode has characters.
    """
    letters = vocabulary.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).distinct()
    found = sorted(r["c"] for r in letters.collect() if r["c"])
    return F.translate("word", "".join(found), "".join(_symbol(c, symbols) for c in found))


def _neighbourhood(form: Column, symbols: int) -> Column:
    """The form, all deletions, and all replacements by a smaller symbol.

    Of two forms that are one edit apart the longer one, or the one with the larger symbol where
    they differ, generates the other: insertions and the other replacements are the same pairs
    seen from their other end.
    """
    alphabet = F.array(*[F.lit(chr(_FIRST_SYMBOL + i)) for i in range(symbols)])
    places = F.sequence(F.lit(1), F.length(form))
    before = lambda i: F.substring(form, F.lit(1), i - 1)
    after = lambda i: F.substring(form, i + 1, F.length(form))
    deleted = F.transform(places, lambda i: F.concat(before(i), after(i)))
    replaced = F.flatten(F.transform(places, lambda i: F.transform(
        F.filter(alphabet, lambda s: s < F.substring(form, i, F.lit(1))),
        lambda s: F.concat(before(i), s, after(i)),
    )))
    return F.array_distinct(F.concat(F.array(form), deleted, replaced))


def near_pairs(vocabulary: DataFrame, symbols: int | None = None) -> DataFrame:
    """``a``, ``n_a``, ``b``, ``n_b``: every pair of near words, once.

    ``vocabulary`` has one row per ``word``, not NULL and not empty, with its count ``n``.
    ``symbols`` is the size of the reduced alphabet; by default it follows from the size of the
    vocabulary. Joins are on the hash of a reduced form; two forms with one hash only add
    candidates. No form has more than its neighbourhood of partners, so no join key is hot but a
    reduced form that many words share, and those words meet in a join that can be split.
    """
    vocabulary = vocabulary.select("word", "n")
    symbols = symbols or symbol_count(vocabulary.count())
    words = written(
        vocabulary.withColumn("form", _reduced(vocabulary, symbols)).withColumn("key", F.xxhash64("form")),
        "reduced-words",
    )
    forms = words.select("form", "key").distinct()
    reach = forms.select(F.col("key").alias("from"), F.explode(_neighbourhood(F.col("form"), symbols)).alias("near"))
    reach = reach.select("from", F.xxhash64("near").alias("key"))
    ends = (F.least("from", "key").alias("from"), F.greatest("from", "key").alias("to"))
    met = written(reach.join(forms.select("key").distinct(), "key").select(*ends).distinct(), "met-forms")
    left = words.select(F.col("key").alias("from"), F.col("word").alias("a"), F.col("n").alias("n_a"))
    right = words.select(F.col("key").alias("to"), F.col("word").alias("b"), F.col("n").alias("n_b"))
    one_edit = (F.levenshtein("a", "b", 1) == 1) & ((F.col("from") != F.col("to")) | (F.col("a") < F.col("b")))
    return met.join(left, "from").join(right, "to").where(one_edit).select("a", "n_a", "b", "n_b")


def _roots(links: DataFrame) -> DataFrame:
    """``word`` and ``root`` for words with a form, by doubling the steps of all words at once.

    A form occurs more often than its word, so there are no circles, and the number of rounds is
    the logarithm of the longest chain.
    """
    now = written(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = written(now.join(ahead, "root", "left"), "roots")
        if not moved.where(F.col("next").isNotNull()).limit(1).count():
            return now
        now = moved.select("word", F.coalesce("next", "root").alias("root"))


def group_variants(vocabulary: DataFrame, min_ratio: int = 10, symbols: int | None = None) -> DataFrame:
    """Every word with the frequent word that it is a variant of.

    ``vocabulary`` has ``word`` and ``n``, as ``count_words`` gives; a word in several rows counts
    with the sum of its rows, rows with a NULL or empty word are passed over, and other columns are
    not read. Returned per word: ``word``, ``n``, ``n_near`` (near words, 0 if none), ``form`` (the
    near word of largest count, of equal ones the smallest in code point order, if that count is at
    least ``min_ratio`` times the word's, else NULL), ``form_n`` (its count) and ``root`` (the last
    word that forms lead to; the word itself if it has none). An empty table gives an empty one.
    """
    if min_ratio < 2:
        raise ValueError("a form has to occur more often than its word: min_ratio is 2 or more")
    vocabulary = written(
        vocabulary.where(F.length("word") > 0).groupBy("word").agg(F.sum("n").cast("long").alias("n")), "vocabulary"
    )
    pairs = near_pairs(vocabulary, symbols)
    both = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("other_n")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("other_n")),
    )).alias("p")).select("p.*")
    # Least in the order of falling counts, then code points: strings are compared byte by byte.
    best = F.min(F.struct((-F.col("other_n")).alias("order"), F.col("other").alias("form")))
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    counted = written(
        vocabulary.join(near, "word", "left")
        .withColumn("is_variant", -F.col("best.order") >= min_ratio * F.col("n"))
        .select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(F.col("is_variant"), F.col("best.form")).alias("form"),
            F.when(F.col("is_variant"), -F.col("best.order")).alias("form_n"),
        ),
        "near-words",
    )
    roots = _roots(counted.where(F.col("form").isNotNull()))
    return counted.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
