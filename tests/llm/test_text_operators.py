"""Spelling variants, periodic runs and page extraction against brute force, with odd rows."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from stancewright.llm import html_extract, periodic_runs, spelling_variants
from stancewright.llm.catalog import _garbled_words, _looped
from stancewright.llm.html_outline import DROPPED, MAIN, PLAIN, outline

# Spelling variants


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute_variants(counts, ratio):
    near = {w: [x for x in counts if one_edit(w, x)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, counts[w], len(near[w]), form[w], counts.get(form[w]), root(w)) for w in counts)


def found_variants(df):
    return sorted(tuple(r) for r in df.select("word", "n", "n_near", "form", "form_n", "root").collect())


@pytest.mark.parametrize("symbols", [2, 5, None])
def test_variants_equal_brute_force(spark, symbols):
    rng = random.Random(1)
    counts = {}
    for _ in range(60):
        word = "".join(rng.choice("abcdéÿ汉") for _ in range(rng.randrange(3, 9)))
        counts[word] = rng.choice([1, 3, 50, 1_000])
        for _ in range(3):
            i = rng.randrange(len(word) + 1)
            other = rng.choice([word[:i] + word[i + 1 :], word[:i] + "x" + word[i:], word[:i] + "b" + word[i + 1 :]])
            if other:
                counts.setdefault(other, rng.choice([1, 2, 30]))
    rows = [(w, n, "clash", 7) for w, n in counts.items()]
    df = spark.createDataFrame(rows, "word string, n long, form string, key long").repartition(5)
    assert found_variants(spelling_variants.group_variants(df, 10, symbols)) == brute_variants(counts, 10)


def test_variants_chains_ties_and_odd_rows(spark):
    counts = {"aaaaaaa": 10_000, "aaaaaab": 1_000, "aaaaabb": 100, "aaaabbb": 10, "zzzzzzz": 10, "zzzzzzy": 100, "zzzzzzx": 100, "lonely": 5}
    rows = [(w, n) for w, n in counts.items()] + [(None, 9), ("", 4), ("lonely", 2)]
    df = spark.createDataFrame(rows, "word string, n long")
    expected = brute_variants({**counts, "lonely": 7}, 10)
    found = found_variants(spelling_variants.group_variants(df))
    assert found == expected
    by = {r[0]: r for r in found}
    assert by["aaaabbb"][5] == "aaaaaaa" and by["zzzzzzz"][3] == "zzzzzzx"
    assert found_variants(spelling_variants.group_variants(df.limit(0))) == []
    with pytest.raises(ValueError):
        spelling_variants.group_variants(df, min_ratio=1)


def test_many_words_of_one_reduced_form(spark):
    """With two symbols a third of all words share a form, and none of their links is lost."""
    words = {f"{a}{b}{c}aaaa": 2 for a in "abcdef" for b in "abcdef" for c in "abcdef"}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    found = spelling_variants.group_variants(df, symbols=2).collect()
    assert {r["n_near"] for r in found} == {15} and len(found) == 216


def test_words_are_counted_and_garbled(spark):
    import zlib

    texts = [(i, t) for i, t in enumerate(["Élanvital ELANVITAL abcdefgh1abcdefg", None, "", "Ünïcödeé " * 40, "plainword " * 3])]
    texts += [(i, "gardener wanderer") for i in range(100, 220)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    expected = {}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                expected[run] = expected.get(run, 0) + 1
    found = {r["word"]: r["n"] for r in spelling_variants.count_words(_garbled_words(docs)).collect()}
    assert found == {w: n for w, n in expected.items() if n >= 2}
    assert any(w not in ("gardener", "wanderer") for w in expected if w.startswith(("gard", "wand", "ande", "arde")))


# Periodic runs


def brute_runs(words, min_length, min_times):
    best = {}
    n = len(words)
    for q in range(1, n // min_times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(min_length, min_times * q):
                best.setdefault((i, length), q)
            i = j
    return sorted(((s, n, q) for (s, n), q in best.items()), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("min_length,min_times", [(6, 4), (2, 2), (6, 2), (4, 3), (10, 6)])
def test_runs_equal_brute_force(min_length, min_times):
    rng = random.Random(min_length * 10 + min_times)
    for _ in range(150):
        texts = []
        for _ in range(rng.randrange(1, 5)):
            n, alphabet = rng.randrange(0, 60), rng.choice([1, 2, 3, 5])
            words = [rng.randrange(alphabet) for _ in range(n)]
            if n and rng.random() < 0.5:
                a, p = rng.randrange(n), rng.randrange(1, 8)
                words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            texts.append(words)
        ids = np.array([w for t in texts for w in t], np.int64)
        owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        starts = np.cumsum([0, *map(len, texts)])
        expected = [(s + a, n, q) for a, t in zip(starts, texts) for s, n, q in brute_runs(t, min_length, min_times)]
        found = periodic_runs.find_runs(ids, owner, min_length, min_times) if len(ids) else []
        assert [tuple(map(int, r)) for r in found] == expected


def odd_texts():
    rng = random.Random(8)
    prose = " ".join(f"w{rng.randrange(50)}" for _ in range(8_000))
    return [
        None, "", " \t\n\x0b\x0c\r ", "a", "a a a a a", "a a a a a a", "x " + "a b " * 9 + "a y", "a\tb\na b\x0ba b a  b end",
        "a b c " * 4 + "a b d " * 5, prose + " tail" * 4_000 + " end", "é 汉 😀 " * 30, "a b " * 4 + "a b " * 4, "A a " * 6,
        "one two three " * 3_000,
    ]


def test_runs_of_odd_documents(spark, monkeypatch):
    rows = [(i, t, "clash", 1) for i, t in enumerate(odd_texts())]
    rows += [rows[6], (6, "other text", "clash", 2), (None, "z " * 7, "clash", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, n_words long").repartition(4)
    expected = []
    for i, text, *_ in rows:
        words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
        runs = brute_runs(words, 6, 4)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone).decode()
        expected.append((i, len(words), runs, kept))
    found = [
        (r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed_text"])
        for r in periodic_runs.periodic_runs(docs).collect()
    ]
    assert sorted(found, key=repr) == sorted(expected, key=repr)
    assert periodic_runs.periodic_runs(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(docs, min_times=1)


def test_batches_do_not_change_runs(monkeypatch):
    texts = [(t or "").encode() for t in odd_texts()]
    whole = list(periodic_runs._scanned(texts, 6, 4))
    monkeypatch.setattr(periodic_runs, "BATCH_BYTES", 50)
    parts = [x for a, b in periodic_runs._batches(texts) for x in periodic_runs._scanned(texts[a:b], 6, 4)]
    assert parts == whole and len(list(periodic_runs._batches(texts))) > 5


def test_documents_are_looped(spark):
    import zlib

    rows = [(i, " ".join(f"w{k}" for k in range(i % 23))) for i in range(200)] + [(1_000, None)]
    found = {r["doc_id"]: r["text"] for r in _looped(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        words = (text or "").split()
        h = zlib.crc32(str(i).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        assert (found[i] or "").split() == words


# Pages


def kept(page, area):
    o = outline(page)
    return [t for t, a in zip(o.texts, o.areas) if t and a == area]


@pytest.mark.parametrize("page,main,plain", [
    ("<article><p>one<p>two <b>bold<br>line</b></article>after", ["one", "two bold line"], ["after"]),
    ("<main><nav>menu</nav><ul><li>a<li>b<ul><li>c</ul></ul></main>", ["a", "b", "c"], []),
    ("<p>a < b &amp; c &eacute;&#233;&nbsp;x &amp", [], ["a < b & c éé x &"]),
    ("<script>var t='</p><article>x'</script><style>a{}</style><p>z", [], ["z"]),
    ("<!-- <p>no</p> --><p>yes<!-- open", [], ["yes"]),
    ('<div class="Cookie-notice">n</div><div id="ad-12">n</div><span class="sponsored">n</span><p>y', [], ["y"]),
    ('<p>a <span class="ad">buy</span>b</p>', [], ["a b"]),
    ('<article class="post comments-open">x<section id="comments">c<article>d</article></section></article>', ["x"], []),
    ('<article class="comment">c</article><div hidden>h</div><div role="navigation">r</div>', [], []),
    ("<table><tr><td>1<td>2<tr><td>3</table>", [], ["1", "2", "3"]),
    ('<a title="x>y" href=z>in</a> <a title="open>t', [], ["in t"]),
    ("</p></div></article>stray", [], ["stray"]),
    ("<article>cut off <p", ["cut off"], []),
    ("<script>never closed <p>x", [], []),
    (None, [], []), ("", [], []), ("just text", [], ["just text"]),
])
def test_outline_areas(page, main, plain):
    assert kept(page, MAIN) == main and kept(page, PLAIN) == plain


def test_deep_and_long_pages_stay_cheap():
    import time

    start = time.time()
    assert kept("<div>" * 50_000 + "deep", PLAIN) == ["deep"]
    assert kept("<p>" + "x " * 300_000 + '<a title="' + "<" * 2_000, PLAIN)[0].startswith("x x")
    assert time.time() - start < 20


def site_page(rng, k, article=True):
    """A page of a site: the frame is the same everywhere, the text is not."""
    words = lambda n: " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(500)}" for _ in range(n))
    blocks = [words(rng.randrange(5, 30)) for _ in range(rng.randrange(1, 6))]
    title = words(4)
    body = "".join(f"<p>{b}</p>" for b in blocks)
    inside = f"<article><h1>{title}</h1>{body}</article>" if article else f"<div><h2>{title}</h2>{body}</div>"
    links = "".join(f'<li><a href="/{i}">{words(1)}</a>' for i in range(rng.randrange(2, 7)))
    page = (
        f"<html><head><title>{title}</title><script>n({k})</script></head><body><div class=top><ul>{links}</ul></div>"
        f"<div>Subscribe to our letter now</div>{inside}<div>All rights reserved</div></body></html>"
    )
    return page, " ".join([title, *blocks])


@pytest.mark.parametrize("article", [True, False])
def test_main_text_by_the_site(spark, article):
    """Without an element that names it, the main text is what is neither links nor fixed."""
    rng = random.Random(2)
    rows, expected = [], {}
    for k in range(40):
        page, text = site_page(rng, k, article)
        rows.append((k, f"https://Site{k % 2}.example/p/{k}", page, "clash"))
        expected[k] = text
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, extracted string").repartition(5)
    found = {r["page_id"]: r["extracted"] for r in html_extract.extract_text(pages).collect()}
    assert found == expected
    templates = html_extract.deduce_templates(pages, html_extract.site_of(F.col("url"))).collect()
    assert sorted(r["site"] for r in templates) == ["site0.example", "site1.example"]
    assert all(r["has_main"] == article and len(r["classes"][0]) >= 10 for r in templates)


def test_copies_of_one_article_keep_their_text(spark):
    """Text that all pages of a site share is main text all the same where an element says so."""
    pages = spark.createDataFrame(
        [(k, "http://h/x", f"<nav>menu {k}</nav><article><p>the same text</p></article>") for k in range(30)],
        "page_id long, url string, html string",
    )
    assert {r["extracted"] for r in html_extract.extract_text(pages).collect()} == {"the same text"}


def test_odd_pages(spark):
    rows = [
        (1, None, "<article>no host</article>"), (2, "http://a/1", None), (3, "http://a/2", ""), (4, "http://a/3", "plain"),
        (5, "rare.example/x", "<div>by <a>itself</a></div><div><a>link list</a></div>"), (1, None, "<article>no host</article>"),
        (None, "", "<p>x"), (7, "http://a/4", "<nav>only a menu</nav>"), (8, "http://a/5", "<p>" + "long " * 50_000),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    clashing = pages.withColumns({n: F.lit("clash") for n in ("site", "row", "classes", "slots", "has_main", "extracted", "c0")})
    found = html_extract.extract_text(clashing)
    assert found.columns == [*(c for c in clashing.columns if c != "extracted"), "extracted"]
    got = sorted(((r["page_id"], r["extracted"]) for r in found.collect()), key=repr)
    assert got == sorted([
        (1, "no host"), (1, "no host"), (2, ""), (3, ""), (4, "plain"), (5, "by itself"), (None, "x"), (7, ""),
        (8, " ".join(["long"] * 50_000)),
    ], key=repr)
    assert html_extract.extract_text(pages.limit(0)).collect() == []


def test_classes_in_another_order_are_no_template(spark):
    """Tags that every page has once, but not in one order or place, part no slots."""
    swap = ["<section>{0}</section><aside>s</aside>", "<aside>s</aside><section>{0}</section>"]
    rows = [(k, "http://h/", "<body><div>" + swap[k % 2].format(f"text {k}") + "</div></body>") for k in range(20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["page_id"]: r["extracted"] for r in html_extract.extract_text(pages).collect()} == {k: f"text {k}" for k in range(20)}
    tags = outline(rows[0][2]).tags
    member = {t: 0 for t in tags}
    assert html_extract._layout(tags, [0] * len(tags), member)[0] is not None
    other = outline(rows[1][2]).tags
    assert html_extract._layout(other, [0] * len(other), member)[0] != html_extract._layout(tags, [0] * len(tags), member)[0]
    assert DROPPED == 0
