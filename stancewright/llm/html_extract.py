"""Main text of web pages by the template that the pages of one site share.

A token is a block tag together with the path it stands under, or a whole run of text. Tokens that
occur equally often on every page of a site form an equivalence class; classes that enough pages
hold, whose tokens keep one order, and whose occurrences keep to one place among the tokens of
the more widespread classes, nest into the site's template. Between its tokens lie slots. Which of
them hold the main text is decided per site, over all of its pages.

Pages are read twice, first for their outlines and at the end for their text; counting, checking and
choosing work on the outlines. Occurrence vectors are never gathered: sums over pages stand
for them, so a site with a third of all pages is combined before the shuffle like any other.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stancewright.llm.html_outline import DROPPED, MAIN, PLAIN, START, outline
from stancewright.llm.scratch import written

#: Templates kept by a task; a site's is read again when it comes back later.
TEMPLATES_AT_HAND = 64


def site_of(url: Column) -> Column:
    """What stands between the first ``://`` and the path, A-Z lower-cased; empty without it."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), "^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _outlines(pages: DataFrame) -> DataFrame:
    """One row per page with any markup or text: its tags, texts (hashed), words, link words and areas."""
    longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())

    def read(batches):
        for batch in batches:
            sites, found = [], []
            for site, page in zip(batch.column("site").to_pylist(), batch.column("html").to_pylist()):
                o = outline(page)
                if len(o.tags) > 1 or o.texts[0]:
                    sites.append(site)
                    found.append((o.tags, o.text_tokens(), [len(t.split()) for t in o.texts], o.links, o.areas))
            columns = list(zip(*found)) or [()] * 5
            kinds = (longs, longs, ints, ints, ints)
            yield pa.record_batch(
                [pa.array(sites, pa.string()), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                names=["site", "tags", "texts", "words", "links", "areas"],
            )

    return pages.mapInArrow(
        read, "site string, tags array<long>, texts array<long>, words array<int>, links array<int>, areas array<int>"
    )


def _equivalence_classes(outlines: DataFrame, min_pages: int, min_share: float) -> DataFrame:
    """``site``, ``class`` (its rank in the site) and ``tokens`` of classes that enough pages hold."""

    def count(batches):
        schema = pa.schema([(n, pa.int64()) for n in ("token", "pages", "total", "low", "high")])
        for batch in batches:
            sums: dict[tuple, list[int]] = {}
            for number, (site, tags, texts) in enumerate(
                zip(*(batch.column(n).to_pylist() for n in ("site", "tags", "texts")))
            ):
                page = batch.column("page")[number].as_py()
                tokens, times = np.unique(np.array(tags + [t for t in texts if t], np.int64), return_counts=True)
                for token, n in zip(tokens.tolist(), times.tolist()):
                    mark = xxhash.xxh3_64_intdigest(n.to_bytes(8, "little"), page & 0xFFFFFFFFFFFFFFFF)
                    entry = sums.setdefault((site, token), [0, 0, 0, 0])
                    entry[0] += 1
                    entry[1] += n
                    entry[2] += mark & 0xFFFFFFFF
                    entry[3] += mark >> 32
            columns = [pa.array([k[1] for k in sums], pa.int64())]
            columns += [pa.array([v[i] for v in sums.values()], pa.int64()) for i in range(4)]
            yield pa.record_batch(
                [pa.array([k[0] for k in sums], pa.string()), *columns],
                schema=pa.schema([("site", pa.string()), *schema]),
            )

    # Pages are told apart by where they lie, so that copies of a page count as pages of their own.
    told = outlines.select(
        "site", "tags", "texts", F.xxhash64(F.monotonically_increasing_id(), F.lit(1)).alias("page")
    )
    parts = told.mapInArrow(count, "site string, token long, pages long, total long, low long, high long")
    stats = written(
        parts.groupBy("site", "token")
        .agg(*[F.sum(n).alias(n) for n in ("pages", "total", "low", "high")])
        .where(F.col("pages") >= min_pages),
        "page-tokens",
    )
    sizes = stats.where(F.col("token") == START).select("site", F.col("pages").alias("of"))
    often = stats.join(sizes, "site").where(F.col("pages") >= min_share * F.col("of"))
    vector = ("pages", "total", "low", "high")
    classes = often.groupBy("site", *vector).agg(F.sort_array(F.collect_list("token")).alias("tokens"))
    # The most widespread class first, of equally widespread ones the one seen least often on a page.
    order = F.struct((-F.col("pages")).alias("p"), F.col("total").alias("t"), F.col("tokens"))
    return classes.groupBy("site").agg(F.transform(F.array_sort(F.collect_list(order)), lambda c: c["tokens"]).alias("classes"))


class _Places:
    """Which class each token of a site belongs to, for the sites seen last."""

    def __init__(self) -> None:
        self.sites: OrderedDict[str, dict[int, int]] = OrderedDict()

    def of(self, site: str, classes) -> dict[int, int]:
        if site in self.sites:
            self.sites.move_to_end(site)
        else:
            self.sites[site] = {token: i for i, tokens in enumerate(classes.as_py()) for token in tokens}
            if len(self.sites) > TEMPLATES_AT_HAND:
                self.sites.popitem(last=False)
        return self.sites[site]


def _layout(tags: list[int], texts: list[int], member: dict[int, int]) -> dict[int, int | None]:
    """For each class on a page a number for its order and place; None where it keeps neither.

    The tokens of a class have to recur in one order, and every round has to begin behind one
    token of the classes before it.
    """
    sequence: dict[int, list[int]] = {}
    line: list[tuple[int, int]] = []
    for pair in zip(tags, texts):
        for token in pair:
            rank = member.get(token)
            if rank is not None:
                sequence.setdefault(rank, []).append(token)
                line.append((rank, token))
    found: dict[int, int | None] = {}
    for rank, tokens in sequence.items():
        cycle = len(set(tokens))
        rounds = len(tokens) // cycle
        found[rank] = None
        if tokens == tokens[:cycle] * rounds:
            found[rank] = xxhash.xxh3_64_intdigest(np.array(tokens[:cycle], np.int64).tobytes())
    # The last token of an earlier class before each round.
    for rank in [r for r, sign in found.items() if sign is not None]:
        first, last, begins = sequence[rank][0], START, set()
        for other, token in line:
            if other < rank:
                last = token
            elif other == rank and token == first:
                begins.add(last)
        if len(begins) > 1:
            found[rank] = None
        else:
            found[rank] ^= xxhash.xxh3_64_intdigest(str(begins.pop()).encode())
    return found


def _valid_classes(outlines: DataFrame, classes: DataFrame) -> DataFrame:
    """``site`` and its ``classes`` that are ordered and nested alike on every page that holds them."""

    def check(batches):
        places = _Places()
        for batch in batches:
            seen: dict[tuple[str, int], list] = {}
            columns = [batch.column(n) for n in ("tags", "texts")]
            for i, site in enumerate(batch.column("site").to_pylist()):
                member = places.of(site, batch.column("classes")[i])
                for rank, sign in _layout(columns[0][i].as_py(), columns[1][i].as_py(), member).items():
                    entry = seen.setdefault((site, rank), [sign, sign, True])
                    if sign is None:
                        entry[2] = False
                    else:
                        entry[0] = sign if entry[0] is None else min(entry[0], sign)
                        entry[1] = sign if entry[1] is None else max(entry[1], sign)
            signed = lambda x: None if x is None else x - (1 << 63)
            yield pa.record_batch(
                [
                    pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.int32()),
                    pa.array([signed(v[0]) for v in seen.values()], pa.int64()),
                    pa.array([signed(v[1]) for v in seen.values()], pa.int64()),
                    pa.array([v[2] for v in seen.values()], pa.bool_()),
                ],
                names=["site", "rank", "low", "high", "kept"],
            )

    said = outlines.select("site", "tags", "texts").join(classes, "site").mapInArrow(
        check, "site string, rank int, low long, high long, kept boolean"
    )
    agreed = said.groupBy("site", "rank").agg(
        ((F.min("low") == F.max("high")) & F.every("kept")).alias("valid")
    ).where("valid").groupBy("site").agg(F.sort_array(F.collect_list("rank")).alias("ranks"))
    return classes.join(agreed, "site").select(
        "site", F.transform("ranks", lambda r: F.get("classes", r)).alias("classes")
    )


def _slots(outlines: DataFrame, classes: DataFrame) -> DataFrame:
    """``site``, ``slot`` (the template tag that opens it) and the words found in it over all pages.

    ``words`` counts words outside dropped elements, ``main`` those inside a main element, ``linked``
    those in links and ``fixed`` those of runs that belong to the template themselves.
    """

    def count(batches):
        places = _Places()
        for batch in batches:
            sums: dict[tuple[str, int], np.ndarray] = {}
            columns = [batch.column(n) for n in ("tags", "texts", "words", "links", "areas")]
            for i, site in enumerate(batch.column("site").to_pylist()):
                member = places.of(site, batch.column("classes")[i])
                slot = START
                for tag, text, words, links, area in zip(*(c[i].as_py() for c in columns)):
                    if tag in member:
                        slot = tag
                    if words and area != DROPPED:
                        entry = sums.setdefault((site, slot), np.zeros(4, np.int64))
                        entry += (words, words * (area == MAIN), links, words * (text in member))
            yield pa.record_batch(
                [
                    pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.int64()),
                    *[pa.array([int(v[j]) for v in sums.values()], pa.int64()) for j in range(4)],
                ],
                names=["site", "slot", "words", "main", "linked", "fixed"],
            )

    found = outlines.join(classes, "site").mapInArrow(
        count, "site string, slot long, words long, main long, linked long, fixed long"
    )
    return found.groupBy("site", "slot").agg(*[F.sum(n).alias(n) for n in ("words", "main", "linked", "fixed")])


def deduce_templates(
    pages: DataFrame, site: Column, html_col: str = "html", min_pages: int = 5, min_share: float = 0.5
) -> DataFrame:
    """The template of every site with at least ``min_pages`` pages that have any content.

    Returned per site: ``site``, ``classes`` (arrays of hashed tokens, the most widespread class first),
    ``slots`` (the tags that open slots with main text) and ``has_main`` (whether an ``article`` or
    ``main`` element tells where that is). A class needs the share ``min_share`` of the site's pages.

    With a main element on the site, main slots are those with words in it; else those whose words
    are mostly neither in links nor fixed parts of the template. Elements for menus, headers, footers,
    side notes, forms, scripts and the like, or named as such, never count.
    """
    outlines = written(_outlines(pages.select(site.alias("site"), F.col(f"`{html_col}`").alias("html"))), "outlines")
    classes = written(_equivalence_classes(outlines, min_pages, min_share), "page-classes")
    valid = written(_valid_classes(outlines, classes), "page-templates")
    slots = _slots(outlines, valid)
    chosen = slots.groupBy("site").agg(
        (F.sum("main") > 0).alias("has_main"),
        F.collect_list(F.struct("slot", "words", "main", "linked", "fixed")).alias("found"),
    )
    free = lambda s: (2 * s["linked"] <= s["words"]) & (2 * s["fixed"] < s["words"])
    main = F.filter("found", lambda s: F.when(F.col("has_main"), s["main"] > 0).otherwise(free(s)))
    picked = chosen.select("site", "has_main", F.transform(main, lambda s: s["slot"]).alias("slots"))
    return valid.join(picked, "site")


def _main_text(page: str | None, template: tuple | None) -> str:
    """Texts of the main slots of a page, in their order.

    A page with none of the site's main slots, or of a site without a template, goes by its own
    elements: those of ``article`` or ``main`` if it has any, else blocks that are mostly not links.
    """
    o = outline(page)
    if template is not None:
        tokens, slots, has_main = template
        if not slots.isdisjoint(o.tags) or START in slots:
            kept, inside = [], START in slots
            for tag, text, area, fixed in zip(o.tags, o.texts, o.areas, o.text_tokens()):
                if tag in tokens:
                    inside = tag in slots
                # In a main element fixed text stays: pages may hold copies of one article.
                if inside and text and (area == MAIN if has_main else area == PLAIN and fixed not in tokens):
                    kept.append(text)
            return " ".join(kept)
    wanted = MAIN if MAIN in o.areas else PLAIN
    return " ".join(
        text for text, area, links in zip(o.texts, o.areas, o.links)
        if text and area == wanted and (wanted == MAIN or 2 * links <= len(text.split()))
    )


def extract_text(
    pages: DataFrame, site: Column | None = None, url_col: str = "url", html_col: str = "html",
    min_pages: int = 5, min_share: float = 0.5,
) -> DataFrame:
    """All columns of ``pages`` and ``extracted``, the main text of each page; never NULL.

    Pages are grouped by ``site``, by default the host of ``url_col``; pages without a host form a
    group too. Character references are decoded, white space inside a block is one space, blocks are
    joined by one space. NULL and empty pages give an empty text, as do pages without text outside of
    dropped elements. Sites with fewer than ``min_pages`` pages have no template; their pages are read
    by their own elements. Repeated rows give repeated results, an empty table an empty one. Columns
    may have any names; one named ``extracted`` is replaced.
    """
    site = F.coalesce(site_of(F.col(f"`{url_col}`")) if site is None else site.cast("string"), F.lit(""))
    templates = written(deduce_templates(pages, site, html_col, min_pages, min_share), "site-templates")
    others = [c for c in pages.columns if c != "extracted"]
    rows = pages.select(
        F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)]).alias("row"),
        site.alias("site"),
    )
    place = others.index(html_col)
    joined = rows.join(templates, "site", "left")

    def extract(batches):
        known: OrderedDict[str, tuple | None] = OrderedDict()
        for batch in batches:
            texts = []
            pages = batch.column("row").field(place).to_pylist()
            for i, (site, page) in enumerate(zip(batch.column("site").to_pylist(), pages)):
                if site not in known:
                    classes = batch.column("classes")[i].as_py()
                    known[site] = None if classes is None else (
                        {t for c in classes for t in c}, set(batch.column("slots")[i].as_py()),
                        batch.column("has_main")[i].as_py(),
                    )
                    if len(known) > TEMPLATES_AT_HAND:
                        known.popitem(last=False)
                texts.append(_main_text(page, known[site]))
            yield pa.record_batch([batch.column("row"), pa.array(texts, pa.string())], names=["row", "extracted"])

    kind = joined.schema["row"].dataType.simpleString()
    found = joined.mapInArrow(extract, f"row {kind}, extracted string")
    return found.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(others)], "extracted")
