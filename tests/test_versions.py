"""The versioned embedding store, and embedding that survives failures."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from stancewright import sources
from stancewright.plans.embedding_store import attach_by_text, embed_texts, text_code
from stancewright.sources import versions

SCHEMA = "code string, embedding array<float>"


@pytest.fixture
def store(spark, tmp_path):
    path = str(tmp_path / "store")
    sources.create_store(spark, path, buckets=4)
    return path


def vectors(spark, *codes, value=1.0):
    return spark.createDataFrame([(c, [value, 2.0]) for c in codes], SCHEMA)


def test_rows_are_added_once(spark, store, rows):
    sources.add_rows(spark, store, vectors(spark, "a", "b", "b"))
    sources.add_rows(spark, store, vectors(spark, "b", "c", value=9.0))
    assert rows(sources.read_store(spark, store)) == [("a", [1.0, 2.0]), ("b", [1.0, 2.0]), ("c", [9.0, 2.0])]
    assert sources.compact_store(spark, store)
    assert rows(sources.read_store(spark, store), "code") == [("a",), ("b",), ("c",)]
    with pytest.raises(FileExistsError):
        sources.create_store(spark, store)
    with pytest.raises(FileNotFoundError):
        sources.read_store(spark, store + "-other")


def test_two_writers_never_add_a_key_twice(spark, store, rows, monkeypatch):
    commit, computed = versions._commit, spark.sparkContext.accumulator(0)
    once = []

    def late(spark, path, number, content):
        if not once:
            # The other job commits after this one has written its part.
            once.append(True)
            sources.add_rows(spark, store, vectors(spark, "b", "c", value=9.0))
        return commit(spark, path, number, content)

    def counted(batches):
        for batch in batches:
            computed.add(batch.num_rows)
            yield batch

    monkeypatch.setattr(versions, "_commit", late)
    sources.add_rows(spark, store, vectors(spark, "a", "b").mapInArrow(counted, SCHEMA))
    found = rows(sources.read_store(spark, store))
    assert found == [("a", [1.0, 2.0]), ("b", [9.0, 2.0]), ("c", [9.0, 2.0])]
    assert computed.value == 2
    _, content = versions._latest(spark, store)
    folders = {p.name.removeprefix("part=") for p in Path(store, "parts").glob("part=*")}
    assert folders == set(content["parts"]) and len(folders) == 2


def test_compaction_gives_way_to_a_writer(spark, store, rows, monkeypatch):
    sources.add_rows(spark, store, vectors(spark, "a"))
    commit, once = versions._commit, []

    def late(spark, path, number, content):
        if not once:
            once.append(True)
            sources.add_rows(spark, store, vectors(spark, "b"))
        return commit(spark, path, number, content)

    monkeypatch.setattr(versions, "_commit", late)
    assert not sources.compact_store(spark, store)
    assert rows(sources.read_store(spark, store), "code") == [("a",), ("b",)]


def test_a_new_session_finds_all_parts(spark, store, rows):
    sources.add_rows(spark, store, vectors(spark, "a"))
    sources.add_rows(spark, store, vectors(spark, "b"))
    # As in a session that has not written them.
    spark.sql(f"DROP TABLE {versions._table(store)}")
    assert rows(sources.read_store(spark, store), "code") == [("a",), ("b",)]


def test_join_moves_the_other_side_only(spark, store):
    sources.add_rows(spark, store, vectors(spark, "a", "b"))
    sources.add_rows(spark, store, vectors(spark, "c"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        posts = spark.range(100).select(F.col("id").cast("string").alias("code"))
        joined = posts.join(sources.read_store(spark, store), "code")
        text = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert len(re.findall("Exchange hashpartitioning", text)) == 1 and "Bucketed: true" in text
    scan = text[text.index("FileScan") :]
    assert "Exchange" not in scan


def posts_of(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, post string").repartition(3)


def flaky(folder, failures):
    """An embedder that counts the texts that it embeds, and fails so often with each batch before."""

    def load():
        def encode(texts):
            log = Path(folder)
            mark = log / ("tried-" + "-".join(sorted(str(hash(t) % 10**9) for t in texts)))
            with mark.open("a") as f:
                f.write("x")
            if len(mark.read_text()) <= failures:
                raise ConnectionError("service is away")
            if any(t == "poison" for t in texts):
                raise ValueError("cannot be embedded")
            for t in texts:
                with (log / "calls").open("a") as f:
                    f.write("x")
            return [[float(len(t)), 1.0] for t in texts]

        return encode

    return load


def calls(folder):
    path = Path(folder, "calls")
    return len(path.read_text()) if path.exists() else 0


def test_equal_texts_are_embedded_once_in_spite_of_failures(spark, store, tmp_path, rows):
    texts = ["one", "two", "two", "three", None, "", "four", "one"]
    posts = posts_of(spark, *texts)
    options = dict(batch_size=2, attempts=3, pause=0.01, wave_texts=2)
    assert embed_texts(posts, store, flaky(tmp_path, 2), **options) == 5
    assert calls(tmp_path) == 5
    assert embed_texts(posts, store, flaky(tmp_path, 2), **options) == 0
    assert calls(tmp_path) == 5
    found = rows(attach_by_text(posts, store), "id", "embedding")
    assert found == [(i, [float(len(t or "")), 1.0]) for i, t in enumerate(texts)]


def test_texts_at_fault_are_kept_aside(spark, store, tmp_path, rows):
    posts = posts_of(spark, "good", "poison", "fine", "well")
    assert embed_texts(posts, store, flaky(tmp_path, 0), batch_size=4, attempts=2, pause=0.01) == 3
    code = posts.filter("post = 'poison'").select(text_code(F.col("post"))).first()[0]
    assert rows(sources.read_rejects(spark, store)) == [(code, "ValueError: cannot be embedded")]
    done = calls(tmp_path)
    assert embed_texts(posts, store, flaky(tmp_path, 0), attempts=1) == 0 and calls(tmp_path) == done
    later = lambda: lambda texts: [[1.0, 1.0] for _ in texts]
    assert embed_texts(posts, store, later, retry_rejects=True) == 1
    assert rows(sources.read_rejects(spark, store)) == [] and sources.read_store(spark, store).count() == 4


def test_a_dead_service_keeps_what_was_done(spark, store, tmp_path):
    posts = posts_of(spark, *[f"text {i}" for i in range(40)])
    log = str(tmp_path)

    def dies():
        def encode(texts):
            done = Path(log, "calls")
            if done.exists() and len(done.read_text()) >= 15:
                raise ConnectionError("gone")
            with Path(log, "calls").open("a") as f:
                f.write("x" * len(texts))
            return [[1.0, 2.0] for _ in texts]

        return encode

    options = dict(batch_size=1, attempts=1, pause=0.0, wave_texts=10, max_rejects=0)
    with pytest.raises(RuntimeError, match="gone"):
        embed_texts(posts, store, dies, **options)
    kept = sources.read_store(spark, store).count()
    assert 0 < kept <= 15
    assert embed_texts(posts, store, lambda: lambda texts: [[1.0, 2.0] for _ in texts], wave_texts=10) == 40 - kept
    assert sources.read_store(spark, store).select("code").distinct().count() == 40


def test_models_and_no_posts(spark, store, rows):
    assert embed_texts(posts_of(spark, "a b", "c"), store, "hashing", dim=8) == 2
    assert {len(v) for (v,) in rows(sources.read_store(spark, store), "embedding")} == {8}
    assert embed_texts(spark.createDataFrame([], "id long, post string"), store, "hashing") == 0
