"""Mixing, toxicity, URLs, licences, vectors, segmentation and the pipeline."""

import importlib.util
import math
import os
import random
import re
import tracemalloc
from collections import Counter
from itertools import product
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stancewright.llm import license_scan, mixing, sp_sampling, toxicity, url_filter, vector_dedup
from stancewright.llm.catalog import ORACLES, QUERIES, URL_RULES, margins, topic, toxic_categories

SMALL = "/root/testdata/sf0.001"


# Mixing


def test_raking_meets_all_margins():
    rng = np.random.default_rng(0)
    mass = rng.random((4, 3, 5)) * 100
    mass[0, 0, 0] = 0
    targets = [np.full(4, 0.25), np.array([0.5, 0.3, 0.2]), rng.dirichlet(np.ones(5))]
    fitted = mixing.rake(mass, targets)
    assert fitted.sum() == pytest.approx(mass.sum()) and fitted[0, 0, 0] == 0
    for axis, target in enumerate(targets):
        rest = tuple(a for a in range(3) if a != axis)
        assert fitted.sum(rest) / fitted.sum() == pytest.approx(target)
    # Raking only scales rows, columns and layers: odds ratios stay as they were.
    ratio = lambda m: m[1, 1, 1] * m[2, 2, 1] / (m[1, 2, 1] * m[2, 1, 1])
    assert ratio(fitted) == pytest.approx(ratio(mass))
    assert mixing.rake(np.zeros((2, 2)), [np.ones(2), np.ones(2)]).sum() == 0
    absent = mixing.rake(np.array([[1.0, 3.0], [0.0, 0.0]]), [np.array([0.5, 0.5]), np.array([0.5, 0.5])])
    assert absent.tolist() == [[2, 2], [0, 0]]


def test_word_count(spark):
    texts = ["", None, " ", "a", " a\tb\n", "a\x0bb\x0cc\r\n d  e", "é\u00a0x y"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(mixing.word_count(F.col("text")))
    assert [r[0] for r in rows.collect()] == [0, 0, 0, 1, 2, 5, 2]


def test_mixture_is_calibrated(spark):
    rng = random.Random(1)
    rows = [
        (i, "w " * rng.randrange(1, 30), rng.choice(["big", "big", "big", "small", None]), rng.choice("xy"), "clash")
        for i in range(3000)
    ] + [(9_000, None, "big", "x", "c"), (9_001, "", "none like it", "x", "c"), (0, rows_text := "w w", "big", "x", "c")]
    assert rows_text
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, kept string")
    columns = {"source": F.col("source"), "lang": F.col("lang")}
    shares = {"source": {"big": 0.4, "small": 0.3, mixing.MISSING: 0.3}}
    drawn = mixing.mix(docs, columns, targets=shares, power=0.0, seed=4)
    assert drawn.columns == ["doc_id", "n_tokens", "weight", "probability", "kept"]
    found = drawn.join(docs.drop("kept"), "doc_id").where("doc_id between 1 and 8000").collect()
    total = sum(r.probability * r.n_tokens for r in found)
    for value, share in (("big", 0.4), ("small", 0.3), (None, 0.3)):
        assert sum(r.probability * r.n_tokens for r in found if r.source == value) / total == pytest.approx(share, abs=5e-3)
    assert max(r.probability for r in found) == pytest.approx(1)
    expected = sum(r.probability for r in found)
    assert abs(sum(r.kept for r in found) - expected) < 5 * math.sqrt(expected)
    kept = mixing.keep_sampled(docs, columns, targets=shares, power=0.0, seed=4)
    assert kept.schema == docs.schema
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in drawn.collect() if r.kept)
    assert mixing.mix(docs.limit(0), columns).collect() == []


def test_values_beyond_the_named_are_raked_together(spark):
    docs = spark.createDataFrame([(i, "w", f"s{i % 7}") for i in range(70)], "doc_id long, text string, source string")
    mixture = mixing.fit_mixture(docs, {"source": F.col("source")}, named=3)
    assert {r[0] for r in mixture.cells.collect()} == {"s0", "s1", "s2", mixing.OTHER}


@pytest.mark.parametrize("cells_here", [mixing.CELLS_HERE, 10])
def test_each_of_many_sources_keeps_its_share(spark, monkeypatch, cells_here):
    monkeypatch.setattr(mixing, "CELLS_HERE", cells_here)
    rng = random.Random(3)
    rows = [
        (i, " ".join([rng.choice(["w", "@", "licence"])] + ["w"] * rng.randrange(40)), f"s{i % 200}", rng.choice("xy"))
        for i in range(6000)
    ] + [(6000, None, "s1", "x"), (6001, "w w", None, "x")]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR, lang VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", rows)
    expected = sorted(con.execute(ORACLES["op2_source_mixing"]).fetchall())
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    drawn = mixing.mix(docs, margins(), power=0.9, seed=2)
    found = sorted(tuple(r) for r in drawn.withColumns({n: F.round(n, 6) for n in ("weight", "probability")}).collect())
    assert found == expected and len({r[2] for r in found}) > 200


# Toxicity


def texts_with_labels(n, seed):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        text = [f"word{rng.randrange(300)}" for _ in range(rng.randrange(5, 60))]
        rude, vile = rng.random() < 0.25, rng.random() < 0.2
        if rude:
            text.insert(0, rng.choice(["Idiot!", "moron,", "clown"]))
        if vile:
            text.append(rng.choice(["trash.", "worthless"]))
        out.append((" ".join(text).encode(), int(rude), int(vile), int(rude or vile)))
    return out


def test_chain_on_held_out_rows():
    rows = texts_with_labels(1500, 1)
    features = [toxicity.word_features(r[0]) for r in rows]
    truths = {n: np.array([r[1 + i] for r in rows]) for i, n in enumerate(("rude", "vile", "toxic"))}
    chain = toxicity.fit_chain(features, truths)
    held = texts_with_labels(800, 2)
    found = chain.predict([toxicity.word_features(r[0]) for r in held])
    for i in range(3):
        assert np.mean((found[:, i] > 0.5) == [r[1 + i] for r in held]) > 0.97
    assert np.mean((found[:, 2] >= chain.cut) == [r[3] for r in held]) > 0.97
    # The last model sees the two probabilities before it and relies on them.
    assert [len(m.chained) for m in chain.models] == [0, 1, 2] and (chain.models[2].chained > 0).all()
    again = toxicity.fit_chain(features, truths)
    assert (again.models[2].weights == chain.models[2].weights).all()


def dense_model(x, earlier, truth):
    """What ``fit_linear`` does, on a dense matrix and word by word."""
    n, positive = len(truth), truth.sum()
    score = []
    for column in x.T:
        df, both = column.sum(), (column * truth).sum()
        expected = df * positive / n
        spread = expected * (1 - positive / n) * (1 - df / n)
        score.append((both - expected) ** 2 / spread if df >= 3 and spread > 0 else 0.0)
    picked = sorted(c for c in sorted(range(len(score)), key=lambda c: (-score[c], c))[: toxicity.SELECTED] if score[c] > 0)
    inputs = np.column_stack([x[:, picked], earlier, np.ones(n)])
    share = min(max(truth.mean(), 0.5 / n), 1 - 0.5 / n)
    weights = np.zeros(inputs.shape[1])
    weights[-1] = np.log(share / (1 - share))
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, toxicity.ROUNDS + 1 if 0 < positive < n else 1):
        gradient = inputs.T @ ((1 / (1 + np.exp(-(inputs @ weights))) - truth) / n)
        gradient[:-1] += toxicity.L2 * weights[:-1] / np.sqrt(n)
        first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient**2
        weights = weights - 0.1 * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.99**step)) + 1e-10)
    return lambda y, before: 1 / (1 + np.exp(-(np.column_stack([y[:, picked], before, np.ones(len(y))]) @ weights)))


def test_chain_equals_a_dense_one():
    rows, held = texts_with_labels(260, 5), texts_with_labels(60, 6)
    features, others = ([toxicity.word_features(r[0]) for r in part] for part in (rows, held))
    words = np.unique(np.concatenate(features))
    dense = lambda part: np.array([np.isin(words, f) for f in part], float)
    x, y = dense(features), dense(others)
    truths = {n: np.array([r[1 + i] for r in rows], float) for i, n in enumerate(("rude", "vile", "toxic"))}
    chain = toxicity.fit_chain(features, truths, folds=4)
    earlier, found, fold = np.zeros((len(x), 0)), np.zeros((len(y), 0)), np.arange(len(x)) % 4
    for truth in truths.values():
        model, out = dense_model(x, earlier, truth), np.zeros(len(x))
        for f in range(4):
            inside = fold != f
            out[~inside] = dense_model(x[inside], earlier[inside], truth[inside])(x[~inside], earlier[~inside])
        found = np.column_stack([found, model(y, found)])
        earlier = np.column_stack([earlier, out])
    assert chain.predict(others) == pytest.approx(found, abs=1e-6)
    # The cut is where F1 on the out-of-fold predictions is largest.
    f1 = lambda cut: 2 * (truth * (out >= cut)).sum() / ((out >= cut).sum() + truth.sum())
    assert f1(chain.cut) == pytest.approx(max(f1(c) for c in out))


def test_chain_with_little_to_learn():
    one = toxicity.fit_chain([np.array([3], np.int32)], {"a": np.array([1]), "b": np.array([0])})
    assert one.predict([np.empty(0, np.int32)]).shape == (1, 2) and one.cut == 0.5
    constant = toxicity.fit_chain([np.array([k], np.int32) for k in range(20)], {"a": np.zeros(20)})
    assert constant.predict([np.array([3], np.int32)])[0, 0] < 0.1
    with pytest.raises(ValueError):
        toxicity.fit_chain([], {"a": np.array([])})


def test_toxicity_tables(spark):
    rows = [(i, t.decode(), "clash", 0.5) for i, (t, *_) in enumerate(texts_with_labels(300, 3))]
    odd = [(900, None, None, None), (901, "", "x", 1.0), (902, "word1 " * 20_000 + "idiot moron", "x", 1.0), (0, rows[0][1], "again", 0.0)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, rejected string, p_toxic double")
    labels = spark.createDataFrame(
        [(i, 1, y) for i, (*_, y) in enumerate(texts_with_labels(300, 3))] + [(5, 1, None), (None, 1, 1), (7, None, None)],
        "doc_id long, quality int, toxic int",
    )
    chain = toxicity.train_chain(docs, labels, toxic_categories())
    found = toxicity.score(docs, chain)
    assert found.columns == ["doc_id", "p_insult", "p_contempt", "p_toxic", "rejected"]
    out = {r.doc_id for r in found.where("rejected").collect()}
    assert 902 in out and not out & {900, 901}
    kept = toxicity.keep_accepted(docs, chain)
    assert kept.schema == docs.schema and {r.doc_id for r in kept.collect()} == {r[0] for r in rows + odd} - out
    assert toxicity.score(docs.limit(0), chain).collect() == []


# URLs


def test_host_path_and_rules(spark):
    urls = {
        "HTTP://A.Example.NET/en/x?y#z": ("a.example.net", "/en/x", "example.net/en/"),
        "https://example.net": ("example.net", "", None),
        "https://x.net/": ("x.net", "/", "net/"),
        "https://notnet/": ("notnet", "/", None),
        "ftp://www.example.com/de/1#/en/": ("www.example.com", "/de/1", "example.com/de/"),
        "http://b.org/fr/?q=://x/": ("b.org", "/fr/", "org/fr/"),
        "http://b.org?x/fr/": ("b.org", "", None),
        "no scheme.net/": ("", "", None), "": ("", "", None), None: ("", "", None), "://": ("", "", None),
        "x://É.Org/fr/É": ("É.org", "/fr/É", "org/fr/"),
    }
    rows = [(i, u, "clash") for i, u in enumerate(urls)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    found = url_filter.judge_urls(pages, URL_RULES, None).collect()
    assert len(found) == len(rows)
    verdicts = {rule: v for v, rule in URL_RULES} | {None: "allow"}
    for r in found:
        host, path, rule = urls[rows[r.page_id][1]]
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdicts[rule])
    assert url_filter.judge_urls(pages.limit(0), URL_RULES, None).collect() == []


def test_url_model_on_held_out_rows(spark):
    rng = random.Random(3)
    good, bad = ["library", "school", "museum"], ["casino", "cheap-pills", "winbig"]
    def url(bad_one):
        name = rng.choice(bad if bad_one else good)
        return f"http://{rng.choice('abc')}{rng.randrange(99)}.{name}{rng.randrange(99)}.test/{rng.choice(['p', 'q'])}/{rng.randrange(9999)}"
    rows = [(url(k % 2), k % 2) for k in range(400)]
    fit = spark.createDataFrame([*rows[:300], (None, 1), ("x://y", None)], "url string, blocked int")
    model = url_filter.fit_urls(fit)
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows[300:])], "page_id long, url string")
    found = {r.page_id: r.verdict for r in url_filter.judge_urls(pages, URL_RULES, model).collect()}
    right = [found[i] == ("block" if y else "allow") for i, (_, y) in enumerate(rows[300:])]
    assert np.mean(right) > 0.95
    assert url_filter.fit_urls(fit.limit(0)) is None
    plan = url_filter.judge_urls(pages, URL_RULES, model)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_url_probabilities_equal_a_plain_scorer(spark):
    """Every n-gram looked up by itself in the fitted weights, on odd and very long URLs too."""
    rows = [(f"http://{w}{k}.test/{w[::-1]}/{k}", int(w == "casino")) for k in range(40) for w in ("casino", "school")]
    model = url_filter.fit_urls(spark.createDataFrame(rows, "url string, blocked int"))
    hashing, regression = model.stages
    weights = regression.coefficients.toArray()
    urls = ["http://casino7.test/x", "https://École.test", "http://a", "x", None, "http://h.test/" + "casino" * 2_000, "http:///p"]

    def probability(host, path):
        grams = set()
        for mark, text in (("h", host), ("p", path)):
            framed = f"^{text}$"
            for n in (3, 4):
                grams |= {mark + framed[i : i + n] for i in range(max(len(framed) - n + 1, 1))}
        z = sum(weights[c] for c in {hashing.indexOf(g) for g in grams}) + regression.intercept
        return 1 / (1 + math.exp(-z))

    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    found = url_filter.judge_urls(pages, [], model).collect()
    assert len(found) == len(urls)
    for r in found:
        assert r.p_block == pytest.approx(probability(r.host, r.path), abs=1e-9)
        assert r.verdict == ("block" if r.p_block >= 0.5 else "allow") and r.rule is None


# Licences


def test_licences_are_inherited_from_the_nearest_directory(spark):
    notice = license_scan.TEMPLATES
    filler = "\n".join(f"some other line {i}" for i in range(30))
    rows = [
        (1, "LICENSE", notice["MIT"]), (2, "a/COPYING.txt", filler + "\n" + notice["GPL-3.0"]), (3, "a/b/c/x.py", filler),
        (4, "a/b/y.py", "# " + notice["Apache-2.0"] + "\ncode"), (5, "z.py", None), (6, "q/r.py", ""), (7, None, "text"),
        (8, "d/licence.md", "no notice here"), (9, "d/e.py", "words"), (10, "ab/x.py", "x"), (3, "a/b/c/x.py", filler),
        (11, "s/x.py", "licensed under the"), (12, "s/y.py", "LICENSED UNDER CC BY-NC 4.0"),
    ]
    files = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, path string, text string, license string")
    found = {r.doc_id: (r.own_license, r.from_directory, r.license) for r in license_scan.scan_licenses(files).collect()}
    assert found == {
        1: ("MIT", None, "MIT"), 2: ("GPL-3.0", None, "GPL-3.0"), 3: (None, "a", "GPL-3.0"),
        4: ("Apache-2.0", None, "Apache-2.0"), 5: (None, "", "MIT"), 6: (None, "", "MIT"), 7: (None, "", "MIT"),
        8: (None, "", "MIT"), 9: (None, "", "MIT"), 10: (None, "", "MIT"), 11: (None, "", "MIT"),
        12: ("CC-BY-NC-4.0", None, "CC-BY-NC-4.0"),
    }
    assert license_scan.scan_licenses(files.limit(0)).collect() == []


def test_the_nearest_of_several_ancestors_speaks(spark):
    notice = license_scan.TEMPLATES
    rows = [
        (1, "s/LICENSE", notice["MIT"]), (2, "s/en/LICENSE", notice["GPL-2.0"]), (3, "s/en/7/LICENSE", notice["MPL-2.0"]),
        (4, "s/en/7/a", "x"), (5, "s/en/8/a", "x"), (6, "s/de/7/a", "x"), (7, "t/en/7/a", "x"),
    ]
    files = spark.createDataFrame(rows, "doc_id long, path string, text string")
    found = {r.doc_id: (r.from_directory, r.license) for r in license_scan.scan_licenses(files).collect()}
    assert [found[i] for i in (4, 5, 6, 7)] == [("s/en/7", "MPL-2.0"), ("s/en", "GPL-2.0"), ("s", "MIT"), (None, None)]


def test_a_header_does_not_fade_as_the_corpus_grows(spark):
    """Common words beside a notice weigh little, and no more on many files than on few."""

    def cosine(copies):
        rows = [(0, "h", "this software is released under the MIT License.")]
        rows += [(i, "f", "this software is a page of content " + "x" * (i % 5)) for i in range(1, 40 * copies)]
        rows += [(-i, "l", license_scan.TEMPLATES["MIT"]) for i in range(1, 2 * copies)]
        found = license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, path string, text string"))
        return found.where("doc_id = 0").first()["cosine"]

    few, many = cosine(1), cosine(30)
    assert few > 0.8 and many > few - 0.05


def test_long_files_and_ties(spark):
    notice = license_scan.TEMPLATES["CC0-1.0"]
    rows = [(1, "a/LICENSE", "filler line\n" * 20_000 + notice), (2, "a/LICENSE", notice), (2, "a/LICENSE", notice), (None, "a/x", "y")]
    found = license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()
    assert len(found) == 4 and {r["license"] for r in found} == {"CC0-1.0"}
    twins = {"B": "one two three", "A": "one two three"}
    same = license_scan.scan_licenses(spark.createDataFrame([(1, "x", "one two three")], "doc_id long, path string, text string"), twins)
    assert same.first()["own_license"] == "A"


def test_key_words_lose_no_line():
    rng = random.Random(0)
    weights = {f"t{t}": {f"w{k}": rng.random() * 3 for k in rng.sample(range(20), 6)} for t in range(5)}
    keys = set(license_scan.key_words(weights, 0.7))
    for _ in range(2000):
        line = {f"w{k}" for k in rng.sample(range(20), rng.randrange(1, 8))}
        for vector in weights.values():
            norm = math.sqrt(sum(w * w for w in vector.values()))
            # The best cosine that any weighting of the shared words allows.
            reach = math.sqrt(sum(vector[w] ** 2 for w in line & set(vector))) / norm
            assert reach < 0.7 or line & keys


# Vectors


def odd_vectors(seed=2, n=240, dims=16):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        if i % 3 == 0 or not rows:
            v = rng.normal(size=dims)
        else:
            v = np.array(rows[rng.integers(max(0, i - 40), i)][1]) + rng.normal(size=dims) * rng.choice([0, 0.02, 0.12, 0.2])
        rows.append((i, v.tolist(), int(i % 4)))
    v = rows[8][1]
    rows += [(900, [2 * x for x in v], 0), (901, v, 0), (902, v, None), (903, None, 0), (904, [0.0] * dims, 0),
             (905, [float("nan"), *v[1:]], 0), (906, [None, *v[1:]], 0), (907, [], 0), (908, v[:5], 0), (909, [-x for x in v], 0),
             (910, [float("inf"), *v[1:]], 0), (911, [x * 1e-200 for x in v], 0)]
    return rows


def links_by_brute_force(rows, threshold):
    usable = {i: (np.array(v, float), k) for i, v, k in rows if k is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    scaled = {i: v / np.abs(v).max() for i, (v, _) in usable.items()}
    links = {i: set() for i, *_ in rows}
    for i, j in product(usable, usable):
        if i != j and usable[i][1] == usable[j][1] and len(scaled[i]) == len(scaled[j]):
            a, b = scaled[i], scaled[j]
            if a @ b / math.sqrt(a @ a) / math.sqrt(b @ b) >= threshold:
                links[i].add(j)
    least = {}
    for i in sorted(links):
        todo = [i] if i not in least else []
        while todo:
            x = todo.pop()
            if x not in least:
                least[x] = i
                todo += links[x]
    return {i: (len(links[i]), least[i], least[i] == i) for i in links}


@pytest.mark.parametrize("blocks", [None, 7])
def test_vector_links(spark, monkeypatch, blocks):
    if blocks:
        monkeypatch.setattr(vector_dedup, "BLOCK_VECTORS", blocks)
        monkeypatch.setattr(vector_dedup, "QUERY_BLOCK_VECTORS", blocks + 4)
    rows = odd_vectors()
    vectors = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<double>, label int, kept string")
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_dedup.link_vectors(vectors, 0.98).collect()}
    assert found == links_by_brute_force(rows, 0.98)
    assert vector_dedup.link_vectors(vectors.limit(0)).collect() == []


def test_traversal_visits_nearest_cells_first_and_reaches_recall():
    rng = np.random.default_rng(4)
    units = rng.normal(size=(1500, 12))
    units[700:] = units[:800] + rng.normal(size=(800, 12)) * 0.08
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    near = units @ units.T >= 0.97
    np.fill_diagonal(near, False)
    pairs = np.argwhere(near)
    visited_share = {}
    for recall in (1.0, 0.9):
        index = vector_dedup.fit_index(units[::2], 8, 0.97, recall)
        i, j = index.cells(units)
        first, second = index.bounds(units)
        cells = []
        for n in range(len(units)):
            a, b = index.visit(first[n], second[n])
            sums = first[n][a] + second[n][b]
            assert (np.diff(sums) >= 0).all() and len(set(zip(a, b))) == len(a)
            cells.append(set(zip(a.tolist(), b.tolist())))
        hit = np.mean([(i[y], j[y]) in cells[x] for x, y in pairs])
        visited_share[recall] = np.mean([len(c) for c in cells]) / 64
        assert hit == 1 if recall == 1 else hit >= 0.85
    assert visited_share[0.9] < visited_share[1.0] < 0.9


# Segmentation

TOY = sp_sampling.Pieces.from_list(
    [""] * 256 + [" ", "a", "b", " a", "ab", "bb", " ab", "abb"], list(range(256)),
    np.array([0.0] * 256 + [-1, -1.2, -0.7, -1.5, -1.1, -2, -1.9, -2.2]),
)


def toy_segmentations(text):
    """All ways to cut a text into toy pieces, with normalised log probabilities."""
    names = {i: TOY.surface[i].decode() for i in range(256, len(TOY.surface))}
    def cut(rest):
        if not rest:
            yield ()
        for i, name in names.items():
            if rest.startswith(name):
                yield from ((i, *more) for more in cut(rest[len(name):]))
    ways = {w: sum(TOY.weight[i] for i in w) for w in cut(" " + text)}
    total = math.log(sum(math.exp(x) for x in ways.values()))
    return {w: x - total for w, x in ways.items()}


def drawn(text, n, k, seed=0):
    return sp_sampling.sample_batch([text] * n, sp_sampling.row_seeds(list(range(n)), seed), TOY, k)


def test_first_draws_follow_the_probabilities():
    n, ways = 20_000, toy_segmentations("abb a")
    first = Counter(tuple(r[0][0].tolist()) for r in drawn("abb a", n, 1))
    assert set(first) <= set(ways)
    for way, log_p in ways.items():
        p = math.exp(log_p)
        assert abs(first[way] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-4


def test_draws_without_replacement_are_those_of_gumbel_top_k():
    n, k, ways = 20_000, 3, toy_segmentations("abb")
    rows = drawn("abb", n, k)
    assert all(len({tuple(s[0]) for s in r}) == k for r in rows)
    assert all(s[1] == pytest.approx(ways[tuple(s[0].tolist())]) for r in rows[:200] for s in r)
    names = list(ways)
    noise = np.random.default_rng(1).gumbel(size=(n, len(names))) + np.array([ways[w] for w in names])
    top = np.argsort(-noise, 1)[:, :k]
    for place in range(k):
        exact = np.bincount(top[:, place], minlength=len(names)) / n
        mine = Counter(tuple(r[place][0].tolist()) for r in rows)
        assert all(abs(mine[w] / n - p) < 0.02 for w, p in zip(names, exact))
    # Inverse inclusion scores make sums over the sample unbiased: they count all segmentations.
    assert np.mean([sum(math.exp(s[1] - s[2]) for s in r) for r in rows]) == pytest.approx(1, abs=0.02)


def test_all_segmentations_when_k_is_large():
    ways = toy_segmentations("abba")
    found = drawn("abba", 3, 500)
    for r in found:
        assert {tuple(s[0].tolist()) for s in r} == set(ways) and all(s[2] == 0 for s in r)


@pytest.fixture(scope="module")
def pieces():
    return sp_sampling.Pieces.load()


def test_round_trip_and_independence_of_the_batch(spark, pieces):
    texts = ["", " ", "  a  b\n\n c▁d é\t😀 \u0000", "x", "word " * 3000, "no-blank" * 500, "\n", "汉字かな", "▁▁", " lead and trail "]
    texts += [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").limit(40).collect()]
    seeds = sp_sampling.row_seeds(list(range(len(texts))), 3)
    together = sp_sampling.sample_batch(texts, seeds, pieces, 3)
    for text, seed, found in zip(texts, seeds, together):
        assert all(sp_sampling.decode(s[0], pieces) == text for s in found)
        assert len({tuple(s[0]) for s in found}) == len(found)
        alone = sp_sampling.sample_batch([text], np.array([seed]), pieces, 3)[0]
        assert [tuple(s[0]) for s in alone] == [tuple(s[0]) for s in found]
        assert [s[1] for s in alone] == pytest.approx([s[1] for s in found])
    assert [len(f) for f in together[:2]] == [1, 2]


def test_pieces_agree_with_the_library(pieces):
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=sp_sampling.MODEL)
    for found in sp_sampling.sample_batch(["Hello, big world", "tab\tand é"], sp_sampling.row_seeds([1, 2], 0), pieces, 2):
        for ids, *_ in found:
            assert model.decode(ids.tolist()) == sp_sampling.decode(ids, pieces)


def test_atoms_are_line_ends_and_words_with_their_blanks():
    texts = ["", "a", " a  b", "a \n\n  b \n", "\n", "   ", "é\u2028ü\t\0 汉 😀\r\n x", "", "  \n  "]
    atoms, counts = sp_sampling._atoms(texts)
    expected = [re.findall(r"\n| *[^ \n]+| +", " " + t) if t else [] for t in texts]
    assert atoms.to_pylist() == [a for found in expected for a in found]
    assert counts.tolist() == [len(found) for found in expected]
    empty, none = sp_sampling._atoms(["", ""])
    assert len(empty) == 0 and none.tolist() == [0, 0]


def test_lattices_of_frequent_atoms_outlast_the_rare_ones(pieces, monkeypatch):
    """Rare words of many batches come and go; common ones are built once, and no sample depends on it."""
    common = ["some", "common", "words", "é", "\U0001f600x"]
    texts = [" ".join(f"{w} rare{i}n{j}" for j, w in enumerate(common * 4)) for i in range(40)]
    seeds = sp_sampling.row_seeds(list(range(len(texts))), 1)
    alone = [sp_sampling.sample_batch([t], seeds[i : i + 1], pieces, 3)[0] for i, t in enumerate(texts)]
    monkeypatch.setattr(sp_sampling, "KEPT_CHARS", 1_000)
    built, build = Counter(), sp_sampling.Lattices._build
    monkeypatch.setattr(sp_sampling.Lattices, "_build", lambda self, atoms: (built.update(atoms), build(self, atoms))[1])
    lattices = sp_sampling.Lattices(pieces)
    for i, text in enumerate(texts):
        found = sp_sampling.sample_batch([text], seeds[i : i + 1], pieces, 3, lattices)[0]
        assert [tuple(s[0]) for s in found] == [tuple(s[0]) for s in alone[i]]
        assert [s[1:] for s in found] == [pytest.approx(s[1:]) for s in alone[i]]
    assert len(built) == 5 + 40 * 20 and {built[f" {w}"] for w in common} == {1}


def test_lattices_take_little_memory_beside_what_is_kept(pieces, monkeypatch):
    """Neither a batch of new atoms nor the dropping of rare ones makes copies as large as all lattices."""
    texts = [" ".join(f"{random.Random(i * 5000 + j).getrandbits(40):x}" for j in range(5_000)) for i in range(6)]
    lattices = sp_sampling.Lattices(pieces)
    kept = lambda: sum(grown.now.nbytes for grown in lattices._grown.values())
    atoms = [sp_sampling._atoms([t])[0] for t in texts]
    tracemalloc.start()
    try:
        lattices.numbers(pa.concat_arrays(atoms))
        # What is kept is mapped and not counted here, but for the atoms and their numbers.
        assert len(lattices.left) > 300_000 and tracemalloc.get_traced_memory()[1] < kept()
        lattices.numbers(pa.concat_arrays(atoms[:3]))
        before = kept()
        monkeypatch.setattr(sp_sampling, "KEPT_CHARS", 340_000)
        tracemalloc.reset_peak()
        now = tracemalloc.get_traced_memory()[0]
        lattices._drop_rare()
        assert 0.4 * before < kept() < 0.6 * before
        assert tracemalloc.get_traced_memory()[1] - now < 0.7 * before
    finally:
        tracemalloc.stop()


def test_texts_that_stay_are_sent_to_the_workers_once(spark, pieces):
    docs = spark.createDataFrame([(1, "some text", "x")], "doc_id long, text string, source string")

    def sent(df):
        output = df._jdf.queryExecution().analyzed().children().head().output()
        return [output.apply(i).name() for i in range(output.size())]

    assert sent(sp_sampling.sample(docs, pieces=pieces, with_row=True)) == ["_key", "doc_id", "text", "source"]
    assert sent(sp_sampling.sample(docs, pieces=pieces)) == ["_key", "doc_id", "text"]
    # A text column named like a result is read, and replaced.
    named = sp_sampling.sample(docs.withColumnRenamed("text", "ids"), pieces=pieces, text_col="ids", with_row=True)
    assert named.columns == ["doc_id", "source", "sample", "ids", "log_prob", "log_inclusion"]
    assert {sp_sampling.decode(r.ids, pieces) for r in named.collect()} == {"some text"}


def test_segmentation_tables(spark, pieces):
    rows = [(1, "some text here", "c"), (1, "some text here", "d"), (2, None, "e"), (3, "", "f"), (None, "other text", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    found = sp_sampling.sample(docs, k=2, pieces=pieces).collect()
    assert Counter((r.doc_id, r.sample) for r in found) == {(1, 1): 2, (1, 2): 2, (2, 1): 1, (3, 1): 1, (None, 1): 1, (None, 2): 1}
    assert len({tuple(r.ids) for r in found if r.doc_id == 1}) == 2
    assert {tuple(r.ids) for r in found if r.doc_id in (2, 3)} == {()}
    wide = sp_sampling.sample(docs, k=1, pieces=pieces, with_row=True)
    assert wide.columns == ["doc_id", "text", "sample", "ids", "log_prob", "log_inclusion"] and wide.count() == 5
    assert all(sp_sampling.decode(r.ids, pieces) == (r.text or "") for r in wide.collect())
    assert sp_sampling.sample(docs.limit(0), pieces=pieces).collect() == []


def test_tables_of_ids_are_decoded(spark, pieces):
    texts = ["", None, " two  blanks ", "c▁d é\t😀", "\n", "word " * 200_000, "汉字" * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    drawn = sp_sampling.sample(docs, k=2, pieces=pieces, with_row=True)
    found = sp_sampling.decode_table(drawn, pieces=pieces)
    assert found.columns == ["doc_id", "text", "sample", "ids", "log_prob", "log_inclusion", "decoded"]
    assert found.where("decoded is null or decoded <> coalesce(text, '')").count() == 0
    assert found.count() == drawn.count() >= len(texts)
    odd = [None, [], pieces.byte_ids[[0xFF, 0x41]].tolist()]
    lists = spark.createDataFrame([(i, x) for i, x in enumerate(odd)], "n int, ids array<int>")
    assert sorted(tuple(r) for r in sp_sampling.decode_table(lists.select("n", "ids"), pieces=pieces).select("n", "decoded").collect()) == [
        (0, None), (1, ""), (2, "\ufffdA")
    ]
    assert sp_sampling.decode_table(lists.limit(0), pieces=pieces).collect() == []


def test_query_decodes_every_document(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    found = QUERIES["op10_sentencepiece_sampling"](spark, SMALL).groupBy("doc_id", "decoded_sha256").count()
    expected = docs.selectExpr("doc_id", "sha2(cast(coalesce(text, '') as binary), 256) as decoded_sha256")
    assert found.count() == docs.count() == found.join(expected, ["doc_id", "decoded_sha256"]).count()


# Pipeline


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_join", "mixing", "sentencepiece"]
    now, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, SMALL)
        assert name == "sentencepiece" or out.schema == docs.schema
        seen[name] = out.collect()
        now = spark.createDataFrame(seen[name], out.schema) if name != "sentencepiece" else now
    ids = {n: {r.doc_id for r in rows} for n, rows in seen.items()}
    order = [n for n, _ in corpus_pipeline.STAGES]
    assert all(ids[b] <= ids[a] for a, b in zip(order, order[1:])) and ids["sentencepiece"] == ids["mixing"]
    texts = [r.text for r in seen["exact_dedup"]]
    assert sorted(texts) == sorted({r.text for r in seen["toxicity"]})
    assert len(seen["ngram_join"]) < len(seen["exact_dedup"])
    assert 0 < len(seen["mixing"]) < len(seen["ngram_join"])
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    toxic = {i for i, y in labels.items() if y}
    clean = {i for i, y in labels.items() if y == 0}
    assert len(toxic & ids["toxicity"]) <= 0.1 * len(toxic) and len(clean - ids["toxicity"]) <= 0.05 * len(clean)
    final = corpus_pipeline.run(spark, SMALL)
    assert Counter((r.doc_id, r.sample) for r in final.select("doc_id", "sample").collect()) == Counter(
        (r.doc_id, r.sample) for r in seen["sentencepiece"]
    )


def odd_corpus():
    """Documents with NULLs, copies, blanks, repeated rows and ids, a long text, and clashing columns."""
    rng = random.Random(9)
    prose = lambda n: " ".join(rng.choice("abcdefgh") + str(rng.randrange(90)) for _ in range(n))
    base = prose(80)
    texts = [None, "", "  ", base, base, base + " tail", "one", "é 汉 😀\n| x | y", prose(20_000), "mail me@b.example " + prose(20)]
    texts += [prose(30) for _ in range(30)]
    rows = [(i, t, None if i % 11 == 0 else "en", f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return rows + [rows[3], (4, "other text", None, None, 1), (None, base, "en", "s1", 1), (None, None, None, None, None)]


CLASHING = ("_probability", "_weight", "_mix0", "_sha", "_out", "key", "rejected", "ids", "sample", "toxic")


@pytest.mark.parametrize("labelled", [True, False])
def test_pipeline_on_odd_documents(spark, tmp_path, labelled):
    rows = odd_corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({n: F.lit("clash") for n in CLASHING})
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    marks = [(i, i % 2, int(i % 5 == 0)) for i in range(10, 40)] if labelled else []
    labels = spark.createDataFrame([(*m, "clash", 1) for m in marks], "doc_id long, quality int, toxic int, text string, _id int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path))
        assert out.columns == docs.columns, name
        found = out.collect()
        assert all(r[c] == "clash" for r in found for c in CLASHING), name
        if name == "toxicity" and not labelled:
            assert len(found) == len(rows)
        if name == "exact_dedup":
            assert sorted({r["text"] or "" for r in found}) == sorted(r["text"] or "" for r in found)
        now = spark.createDataFrame(found, docs.schema)
    final = corpus_pipeline.run(spark, str(tmp_path))
    assert {"doc_id", "text", "sample", "ids"} <= set(final.columns)
    kept = final.select("doc_id", "text", "sample", "_weight").collect()
    assert kept and all(r["_weight"] == "clash" for r in kept)


def test_pipeline_on_empty_tables(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SMALL}/labels.parquet").limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_chain_without_labels_rejects_nothing(spark):
    docs = spark.createDataFrame([(1, "text"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    chain = toxicity.train_chain(docs, labels, {"a": F.col("toxic") == 1, "b": F.col("toxic") == 1})
    found = toxicity.score(docs, chain).collect()
    assert [r["rejected"] for r in found] == [False, False] and all(r["p_b"] < 1e-9 for r in found)


def test_rest_works_without_the_subpackage(tmp_path):
    """The entry file imports and lists the other queries where pipeline and subpackage are gone."""
    root = Path(__file__).resolve().parents[2]
    os.symlink(root / "__spark_entry__.py", tmp_path / "entry_source.py")
    (tmp_path / "stancewright").mkdir()
    for p in (root / "stancewright").iterdir():
        if p.name not in ("llm", "__pycache__"):
            os.symlink(p, tmp_path / "stancewright" / p.name)
    (tmp_path / "__spark_entry__.py").write_text((root / "__spark_entry__.py").read_text())
    import subprocess
    import sys

    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_topics(spark):
    texts = {"The MIT License.": "licence", "a@b.example": "contact", "x | y": "table", "plain": "prose", None: "prose"}
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    assert {r.text: r.t for r in rows.select("text", topic(F.col("text")).alias("t")).collect()} == texts
    assert list(margins()) == ["source", "lang", "topic"]
    assert importlib.util.find_spec("stancewright.llm") is not None
