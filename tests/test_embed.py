import numpy as np
import pytest
from pyspark.sql import functions as F

from stancewright.operators import embed


@pytest.fixture
def posts(spark):
    return spark.createDataFrame(
        [("a", "Stop the war"), ("b", "أوقفوا الحرب الآن"), ("c", ""), ("d", None), ("e", "the war the war")],
        "code string, post string",
    )


@pytest.fixture
def lengths():
    """A factory defined inside a function, so that workers need no test module."""

    def load():
        return lambda texts: [[float(len(t)), 1.0] for t in texts]

    return load


def test_function_embedder(posts, rows, lengths):
    got = rows(embed.embed_text(posts, lengths))
    assert got == [("a", [12.0, 1.0]), ("b", [17.0, 1.0]), ("c", [0.0, 1.0]), ("d", [0.0, 1.0]), ("e", [15.0, 1.0])]


def test_batches_are_bounded(spark):
    def load():
        def encode(texts):
            assert len(texts) <= 7
            return np.array([[len(texts)] for _ in texts])

        return encode

    df = spark.range(100).select(F.col("id").alias("code"), F.lit("x").alias("post")).coalesce(1)
    sizes = [r["embedding"][0] for r in embed.embed_text(df, load, batch_size=7).collect()]
    assert len(sizes) == 100 and max(sizes) == 7


def test_short_answer_is_an_error(posts):
    def load():
        return lambda texts: [[0.0]] * (len(texts) - 1)

    with pytest.raises(Exception, match="one vector per text"):
        embed.embed_text(posts, load).collect()


def test_unknown_embedder(posts):
    with pytest.raises(ValueError):
        embed.embed_text(posts, "word2vec")


def vectors(df):
    return {r["code"]: np.array(r["embedding"]) for r in df.collect()}


def test_hashing_reads_any_alphabet(posts):
    got = vectors(embed.embed_text(posts, dim=64))
    assert all(len(v) == 64 for v in got.values())
    assert np.count_nonzero(got["b"]) == 3 and np.isclose(np.linalg.norm(got["b"]), 1)
    assert not got["c"].any() and not got["d"].any()


def test_a_text_has_one_vector_in_any_company(posts):
    model = embed.fit_tfidf(posts, dim=64)
    for embedder in ("hashing", model):
        everyone = vectors(embed.embed_text(posts, embedder, dim=64))
        alone = vectors(embed.embed_text(posts.filter("code = 'a'"), embedder, dim=64))
        assert alone["a"].any() and np.array_equal(alone["a"], everyone["a"])


def test_tfidf_weighs_terms_by_rarity(posts):
    got = vectors(embed.embed_text(posts, embed.fit_tfidf(posts, dim=1024)))
    # 'the' and 'war' occur in two of five posts, 'stop' in one.
    common, rare = np.log(6 / 3), np.log(6 / 2)
    assert sorted(got["a"][got["a"] > 0]) == pytest.approx([common, common, rare])
    assert sorted(got["e"][got["e"] > 0]) == pytest.approx([2 * common, 2 * common])


def test_fitted_embedder_survives_saving(posts, tmp_path):
    from pyspark.ml import PipelineModel

    model = embed.fit_tfidf(posts, dim=64)
    model.write().save(str(tmp_path / "tfidf"))
    back = PipelineModel.load(str(tmp_path / "tfidf"))
    before, after = vectors(embed.embed_text(posts, model)), vectors(embed.embed_text(posts, back))
    assert all(np.array_equal(before[k], after[k]) for k in before)


def test_only_missing_keys_are_embedded(posts, spark, rows, lengths):
    store = spark.createDataFrame([("a", [0.0]), ("b", [0.0])], "code string, embedding array<float>")
    doubled = posts.union(posts)
    assert rows(embed.embed_missing(doubled, store, lengths), "code") == [("c",), ("d",), ("e",)]


def test_vector_length(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([3.0, 4.0],)], "embedding array<float>")
    assert embed.embedding_dim(df) == 2
    with pytest.raises(ValueError):
        embed.embedding_dim(df.union(spark.createDataFrame([([1.0],)], "embedding array<float>")))


def test_pca_matches_svd(spark):
    x = np.random.default_rng(0).normal(size=(60, 5)) * [5, 3, 1, 0.5, 0.1] + 10
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id int, embedding array<double>")
    got = np.array([r["components"] for r in embed.pca(df, 2).orderBy("id").collect()])
    centred = x - x.mean(axis=0)
    expected = centred @ np.linalg.svd(centred, full_matrices=False)[2][:2].T
    assert np.allclose(np.abs(got), np.abs(expected), atol=1e-8)
    assert np.allclose(got.mean(axis=0), 0, atol=1e-8)
