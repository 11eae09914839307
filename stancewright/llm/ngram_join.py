"""Jaccard self-join on word n-grams, by a size-aware light and heavy join.

1. Copies of one shingle set form a class; only one document of a class goes on.
2. A set can only have a partner if enough of its shingles occur in other sets. Which of
   the shingles with the smallest hashes do is counted over the whole corpus (``repeats``);
   of a set with fewer than a partner would need, the text is not looked at again.
3. Light sets, up to a size at which that is cheaper, enumerate all subsets of the size that
   two linked sets must share. Sets that meet in a subset are linked, without a check.
4. Heavy sets are found by inverted lists over the rarest shingles of each set. Every list
   names one hub, the set with the most widespread shingles; the lists of one hub form a
   group. A set linked with the hub of a group needs no other link inside it; only those
   that are not are held against the whole group, by scanning the lists of the block.
   Groups are split into blocks, and what a task returns is linear in what it reads.
5. Links become components (``components``).
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stancewright.llm import repeats
from stancewright.llm.components import connected
from stancewright.llm.scratch import shuffle_partitions, unused, written
from stancewright.llm.words import BASE, raw_texts, shingle_set

#: Shingles of one chunk, and shingles of one block of a group.
CHUNK_SHINGLES = 1_000_000
BLOCK_SHINGLES = 2_000_000
SET_CHUNK_SHINGLES = 300_000
CHUNK_DOCS = 60_000
#: The share of its shingles that a set shows beyond the prefix a partner must meet.
EXTRA = 0.15
#: Beyond this size subsets are too many to win, so their cost is not worked out.
MAX_LIGHT = 16
BYTES_PER_WORD = 6
COUNTED = 0xFFFF


def least_overlap(n, percent: int):
    """Shingles that a set of size n must share with any partner."""
    return -(-n * percent // 100)


def pair_overlap(a: int, b: int, percent: int) -> int:
    """Shingles that sets of sizes a and b share at least if they are linked."""
    return -(-(a + b) * percent // (100 + percent))


@lru_cache(maxsize=100_000)
def _needed(n: int, percent: int) -> tuple[int, int]:
    """How many smallest hashes a set of size n shows, and how many it shares with any partner.

    Of an overlap of x, a set of size m keeps at least x - (m - shown) among those it shows, and
    what both keep, counted from the smallest hash on, is the smaller of the two numbers.
    """
    partner = np.arange(least_overlap(n, percent), n * 100 // percent + 1)
    overlap = -(-(n + partner) * percent // (100 + percent))

    def beyond(m):
        return np.minimum(least_overlap(m, percent), np.maximum(1, (EXTRA * m).astype(np.int64)))

    own = beyond(np.int64(n)) - least_overlap(n, percent)
    theirs = beyond(partner) - least_overlap(partner, percent)
    return int(n + own), max(1, int((overlap + np.minimum(own, theirs)).min(initial=n)))


_EMIT = "bucket long, chunk long, keys binary, owners binary, manifest binary"
_EMIT_ARROW = pa.schema(
    [("bucket", pa.int64()), ("chunk", pa.int64()), ("keys", pa.binary()),
     ("owners", pa.binary()), ("manifest", pa.binary())]
)
_SEEN = pa.schema(
    [("id", pa.int64()), ("key", pa.int64()), ("fp", pa.binary()), ("n_shingles", pa.int64()),
     ("survives", pa.bool_())]
)


class _Emitter:
    """Shown hashes of the documents of a chunk, by bucket, and the list of documents."""

    def __init__(self, width: int, percent: int, buckets: int) -> None:
        self.width, self.percent, self.buckets = width, percent, buckets
        self.chunks = 0
        self._clear()

    def _clear(self) -> None:
        self.docs: list[tuple] = []
        self.sets: dict[bytes, int] = {}
        self.shown: list[np.ndarray] = []
        self.n = 0

    def __call__(self, batches):
        for batch in batches:
            texts = raw_texts(batch.column(2))
            for x, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts):
                shingles = shingle_set(text.lower().split(), self.width)
                fp = xxhash.xxh3_128_digest(shingles.tobytes())
                if fp not in self.sets:
                    self.sets[fp] = len(self.shown)
                    shown, _ = _needed(len(shingles), self.percent)
                    self.shown.append(shingles[:shown])
                    self.n += shown
                self.docs.append((x, key, fp, len(shingles), self.sets[fp]))
                if self.n >= CHUNK_SHINGLES or len(self.docs) >= CHUNK_DOCS:
                    yield self._flush()
        if self.docs:
            yield self._flush()

    def _flush(self) -> pa.RecordBatch:
        chunk = (TaskContext.get().partitionId() << 32) + self.chunks
        self.chunks += 1
        keys = np.concatenate(self.shown)
        owner = np.repeat(np.arange(len(self.shown)), [len(s) for s in self.shown])
        order = np.argsort(keys, kind="stable")
        keys, owner = keys[order], owner[order]
        twin = np.zeros(len(keys), bool)
        same = keys[1:] == keys[:-1]
        twin[1:] |= same
        twin[:-1] |= same
        here = np.bincount(owner[twin], minlength=len(self.shown))
        first = np.ones(len(keys), bool)
        first[1:] = ~same
        owner = np.where(twin, COUNTED, owner)[first].astype("<u2")
        keys = keys[first]
        # The shown hashes are small ones; other bits must choose the bucket.
        bucket = ((keys * np.uint64(BASE)) >> np.uint64(20)) % np.uint64(self.buckets)
        rows = []
        by = np.argsort(bucket, kind="stable")
        names, starts = np.unique(bucket[by], return_index=True)
        for name, places in zip(names.tolist(), np.split(by, starts[1:])):
            rows.append((name, chunk, repeats.packed(keys[places]), owner[places].tobytes(), None))
        listed = pa.RecordBatch.from_pylist(
            [
                {"id": x, "key": k, "fp": fp, "n": n, "here": int(here[s]), "set": s}
                for x, k, fp, n, s in self.docs
            ],
            schema=_MANIFEST,
        )
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, _MANIFEST) as out:
            out.write_batch(listed)
        rows.append((-1 - chunk, chunk, None, None, sink.getvalue().to_pybytes()))
        self._clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*rows), _EMIT_ARROW)], schema=_EMIT_ARROW
        )


_MANIFEST = pa.schema(
    [("id", pa.int64()), ("key", pa.int64()), ("fp", pa.binary()), ("n", pa.int64()),
     ("here", pa.int64()), ("set", pa.int64())]
)
_TALLY = "chunk long, owners binary, manifest binary"


def _tally(group: pa.Table) -> pa.Table:
    """Per chunk in a bucket: the sets whose hashes another chunk shows too, one entry each."""
    if group.column("manifest")[0].is_valid:
        return group.select(["chunk", "owners", "manifest"])
    flags = repeats.shared([repeats.unpacked(b) for b in group.column("keys").to_pylist()])
    owners = [np.frombuffer(b, "<u2") for b in group.column("owners").to_pylist()]
    found = [o[f & (o != COUNTED)].tobytes() for o, f in zip(owners, flags)]
    return pa.table(
        {
            "chunk": group.column("chunk"), "owners": pa.array(found, pa.binary()),
            "manifest": pa.nulls(len(found), pa.binary()),
        }
    )


def _judge(percent: int):
    def judge(group: pa.Table) -> pa.Table:
        """Documents of a chunk, and whether their set can have a partner."""
        listed = next(b for b in group.column("manifest").to_pylist() if b is not None)
        docs = pa.ipc.open_stream(listed).read_all()
        owners = b"".join(b for b in group.column("owners").to_pylist() if b is not None)
        sets = docs.column("set").to_numpy()
        met = np.bincount(np.frombuffer(owners, "<u2"), minlength=int(sets.max()) + 1)[sets]
        met = met + docs.column("here").to_numpy()
        sizes = docs.column("n").to_pylist()
        need = np.array([_needed(n, percent)[1] for n in sizes])
        return pa.table(
            [docs.column("id"), docs.column("key"), docs.column("fp"), docs.column("n"),
             pa.array((met >= need) & (np.array(sizes) > 0))],
            schema=_SEEN,
        )

    return judge


def _set_maker(width: int):
    schema = pa.schema([("set", pa.int64()), ("size", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def make(batches):
        for batch in batches:
            sets = [shingle_set(t.lower().split(), width) for t in raw_texts(batch.column(1))]
            # The join key is a hash; the fingerprint tells whether it is the right text.
            same = [xxhash.xxh3_128_digest(s.tobytes()) == fp for s, fp in zip(sets, batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([s.view(np.int64) for s in sets], schema.field(2).type)],
                schema=schema,
            ).filter(pa.array(same))

    return make


class _SetChunk:
    """Sets of a chunk in the order of their number, with their shingles as bucket keys."""

    def __init__(self, group: pa.Table, buckets: int) -> None:
        self.rows = group.sort_by("set")
        self.shingles = [s.view(np.uint64) for s in _arrays(self.rows, "shingles")]
        self.sizes = [len(s) for s in self.shingles]
        keys = np.concatenate([np.empty(0, np.uint64), *self.shingles])
        self.found = repeats.ChunkKeys(keys, (keys * np.uint64(BASE)) >> np.uint64(20), buckets)


def _count_emitter(buckets: int):
    schema = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])

    def emit(group: pa.Table) -> pa.Table:
        found = _SetChunk(group, buckets).found
        names, parts = found.parts()
        counts = found.counts().astype("<u4")
        return pa.table(
            [[group.column("chunk")[0].as_py()] * len(names), names,
             [repeats.packed(found.keys[p]) for p in parts], [counts[p].tobytes() for p in parts]],
            schema=schema,
        )

    return emit


def _count_buckets(group: pa.Table) -> pa.Table:
    """For every key of every chunk in a bucket, how widespread it is, as one byte.

    0 is a shingle of one set; above it, eighths of the binary logarithm of the number of sets.
    """
    counts = [np.frombuffer(b, "<u4") for b in group.column("counts").to_pylist()]
    keys = [repeats.unpacked(b) for b in group.column("keys").to_pylist()]
    spread = [
        np.minimum(255, np.floor(8 * np.log2(t)).astype(np.int64)).astype(np.uint8).tobytes()
        for t in repeats.totals(keys, counts)
    ]
    return pa.table(
        {"chunk": group.column("chunk"), "bucket": group.column("bucket"), "spread": pa.array(spread, pa.binary())}
    )


def _sharer(buckets: int):
    """Shingles of each set that other sets have too, the rarest first, and their mean spread."""

    def share(sets: pa.Table, counted: pa.Table) -> pa.Table:
        chunk = _SetChunk(sets, buckets)
        spread = np.zeros(len(chunk.found.keys), np.uint8)
        said = zip(chunk.found.ranges(counted.column("bucket").to_numpy()), counted.column("spread").to_pylist())
        for (a, b), blob in said:
            spread[a:b] = np.frombuffer(blob, np.uint8)
        spread = np.split(spread[chunk.found.place], np.cumsum(chunk.sizes)[:-1])
        shared, score = [], []
        for shingles, s in zip(chunk.shingles, spread):
            order = np.lexsort((shingles, s))
            shared.append(shingles[order][s[order] > 0].view(np.int64))
            score.append(float(s.mean()) if len(s) else 0.0)
        return pa.table(
            {
                "set": chunk.rows.column("set"), "size": chunk.rows.column("size"),
                "shared": pa.array(shared, pa.list_(pa.int64())), "score": pa.array(score),
            }
        )

    return share


def shared_shingles(sets: DataFrame, total: int) -> DataFrame:
    """``set``, ``size``, ``shared`` and ``score`` of every set.

    ``shared`` are the shingles that occur in other sets, in an order that all sets have in
    common: how widespread a shingle is, then its hash. ``total`` is the number of shingles.
    """
    buckets = repeats.bucket_count(total)
    chunk = F.pmod(F.xxhash64("set"), F.lit(max(1, -(-total // SET_CHUNK_SHINGLES)))).alias("chunk")
    rows = sets.select(chunk, "set", "size", "shingles").repartition(shuffle_partitions(sets), "chunk")
    counted = rows.groupBy("chunk").applyInArrow(
        _count_emitter(buckets), "chunk long, bucket long, keys binary, counts binary"
    ).groupBy("bucket").applyInArrow(_count_buckets, "chunk long, bucket long, spread binary")
    # Both uses of ``rows`` have the same exchange, which Spark runs once.
    return rows.groupBy("chunk").cogroup(counted.groupBy("chunk")).applyInArrow(
        _sharer(buckets), "set long, size long, shared array<long>, score double"
    )


def subset_count(size: int, percent: int) -> int:
    """Subsets that a light set enumerates."""
    return sum(
        comb(size, pair_overlap(size, t, percent))
        for t in range(least_overlap(size, percent), size * 100 // percent + 1)
        if pair_overlap(size, t, percent) <= min(size, t)
    )


def _subset_maker(percent: int):
    def make(batches):
        for batch in batches:
            keys, sets, sizes, smaller = [], [], [], []
            for s, size, shingles in zip(*(c.to_pylist() for c in batch.columns)):
                shingles = sorted(shingles)
                for t in range(least_overlap(size, percent), size * 100 // percent + 1):
                    low, c = min(size, t), pair_overlap(size, t, percent)
                    if c > low:
                        continue
                    for subset in combinations(shingles, c):
                        text = repr((low, max(size, t), subset)).encode()
                        keys.append(xxhash.xxh3_128_digest(text))
                        sets.append(s)
                        sizes.append(size)
                        smaller.append(low)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), pa.array(sets, pa.int64()), pa.array(sizes, pa.int64()),
                 pa.array(smaller, pa.int64())],
                names=["key", "set", "size", "smaller"],
            )

    return make


def light_links(sets: DataFrame, boundary: int, percent: int) -> DataFrame:
    """Links between sets of at most ``boundary`` shingles, as stars around small sets.

    Only shingles that other sets have too are enumerated. A key stands for a subset and a pair of sizes. All sets under it share the subset, so a
    set of the smaller size is linked with each of them; without one there is no link.
    """
    keys = sets.where(F.col("size") <= boundary).select("set", "size", "shared").mapInArrow(
        _subset_maker(percent), "key binary, set long, size long, smaller long"
    )
    hubs = keys.where("size = smaller").groupBy("key").agg(F.min("set").alias("hub"))
    met = keys.select("key", "set").join(hubs, "key").where("set != hub")
    return met.select(F.col("hub").alias("a"), F.col("set").alias("b")).distinct()


def _overlaps(queries: list[np.ndarray], members: list[np.ndarray]):
    """For each query the number of shingles shared with each member, by list scans."""
    if not members:
        yield from (np.zeros(0, np.int64) for _ in queries)
        return
    owner = np.repeat(np.arange(len(members)), [len(m) for m in members])
    shingles = np.concatenate(members)
    order = np.argsort(shingles, kind="stable")
    shingles, owner = shingles[order], owner[order]
    for q in queries:
        low = np.searchsorted(shingles, q)
        count = np.searchsorted(shingles, q, "right") - low
        places = np.arange(count.sum()) + np.repeat(low - np.cumsum(count) + count, count)
        yield np.bincount(owner[places], minlength=len(members))


def _arrays(table: pa.Table, name: str) -> list[np.ndarray]:
    column = table.column(name).combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    values, offsets = column.flatten().to_numpy(), column.offsets.to_numpy()
    offsets = offsets - offsets[0]
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:])]


def _linked(overlap: np.ndarray, size: int, sizes: np.ndarray, percent: int) -> np.ndarray:
    return 100 * overlap >= percent * (size + sizes - overlap)


def _hub_check(percent: int):
    def check(group: pa.Table) -> pa.Table:
        """The members of a block against the hub of their group."""
        role = np.array(group.column("role").to_pylist())
        hub, rest = int(np.flatnonzero(role == 0)[0]), np.flatnonzero(role == 1)
        arrays, sizes = _arrays(group, "shared"), group.column("size").to_numpy()
        overlap = next(_overlaps([arrays[hub]], [arrays[i] for i in rest]))
        linked = _linked(overlap, sizes[hub], sizes[rest], percent)
        members = group.take(pa.array(rest))
        return pa.table(
            {"hub": members.column("hub"), "set": members.column("set"), "linked": pa.array(linked)}
        )

    return check


def _rest_check(percent: int):
    def check(group: pa.Table) -> pa.Table:
        """Sets that their hub does not link against the members of a block.

        Members that the hub links are one component already, so one link to any of them
        will do; links among the others are thinned out to a forest.
        """
        role = np.array(group.column("role").to_pylist())
        sets, sizes = group.column("set").to_numpy(), group.column("size").to_numpy()
        tied = np.array(group.column("linked").to_pylist(), bool)
        arrays = _arrays(group, "shared")
        asked, rest = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        edges = []
        scans = _overlaps([arrays[i] for i in asked], [arrays[i] for i in rest])
        for i, overlap in zip(asked, scans):
            hits = rest[_linked(overlap, sizes[i], sizes[rest], percent)]
            hits = hits[sets[hits] != sets[i]]
            for j in [*hits[tied[hits]][:1], *hits[~tied[hits]]]:
                x, y = root(int(sets[i])), root(int(sets[j]))
                if x != y:
                    parent[x] = y
                    edges.append((int(sets[i]), int(sets[j])))
        a, b = zip(*edges) if edges else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return check


def _best_boundary(prefixes: DataFrame, lists: DataFrame, sets: DataFrame, percent: int) -> int:
    """The size up to which enumerating subsets makes fewer rows than scanning lists.

    What is brought to the driver is one row for each size up to ``MAX_LIGHT``.
    """
    small = F.col("size") <= MAX_LIGHT
    scans = (
        prefixes.where(small).join(lists.select("h", "length"), "h")
        .groupBy("size").agg(F.sum("length").alias("rows"))
    )
    scan = {r["size"]: r["rows"] for r in scans.collect()}
    count = {r["size"]: r["n"] for r in sets.where(small).groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    best, least, total = 0, sum(scan.values()), sum(scan.values())
    for size in range(1, MAX_LIGHT + 1):
        total += count.get(size, 0) * subset_count(size, percent) - scan.get(size, 0)
        if total <= least:
            best, least = size, total
    return best


def link_sets(shared: DataFrame, percent: int) -> DataFrame:
    """Links ``a``, ``b`` that connect just the sets that all links connect.

    ``shared`` is what ``shared_shingles`` gives, as a table.
    """
    # Shingles of one set alone come first in the order and link with nothing.
    length = F.size("shared") - F.ceil(F.col("size") * percent / 100) + 1
    prefixes = shared.where(length > 0).select(
        "set", "size", "score", F.explode(F.slice("shared", F.lit(1), length.cast("int"))).alias("h")
    )
    lists = prefixes.groupBy("h").agg(
        F.count(F.lit(1)).alias("length"), F.max("size").alias("largest"),
        F.max(F.struct("score", "set"))["set"].alias("hub"),
    ).where("length > 1")
    boundary = _best_boundary(prefixes, lists, shared, percent)
    groups = written(
        prefixes.join(lists.where(F.col("largest") > boundary), "h").select("hub", "set")
        .where("hub != set").distinct(),
        "list-groups",
    )
    sized = shared.select("set", "size", "shared")
    blocks = groups.join(sized.select("set", "size"), "set").groupBy("hub").agg(
        F.ceil(F.sum("size") / BLOCK_SHINGLES).alias("blocks"), F.count(F.lit(1)).alias("members")
    )
    place = F.pmod(F.xxhash64("set"), F.col("blocks"))
    members = groups.join(blocks, "hub").join(sized, "set").withColumn("block", place)
    hubs = blocks.join(sized, blocks["hub"] == sized["set"]).withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    )
    columns = ["hub", "block", "set", "size", "shared"]
    checked = written(
        members.select(*columns, F.lit(1).alias("role"))
        .union(hubs.select(*columns, F.lit(0).alias("role")))
        .groupBy("hub", "block").applyInArrow(_hub_check(percent), "hub long, set long, linked boolean"),
        "hub-links",
    )
    # Groups with a set that the hub does not link and another member to hold it against.
    open_groups = (
        checked.join(sized.select("set", "size"), "set").groupBy("hub").agg(
            F.ceil(F.sum(F.when(~F.col("linked"), F.col("size"))) / BLOCK_SHINGLES).alias("parts"),
            F.ceil(F.sum("size") / BLOCK_SHINGLES).alias("blocks"), F.count(F.lit(1)).alias("members"),
        ).where("parts is not null and members > 1")
    )
    rows = checked.join(open_groups, "hub").join(sized, "set")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    columns = ["hub", "block", "part", "set", "size", "shared", "linked", "role"]
    against = rows.withColumn("block", place).withColumn("part", every("parts")).withColumn("role", F.lit(1))
    asked = (
        rows.where("not linked").withColumn("part", F.pmod(F.xxhash64("set"), F.col("parts")))
        .withColumn("block", every("blocks")).withColumn("role", F.lit(0))
    )
    found = (
        against.select(*columns).union(asked.select(*columns))
        .groupBy("hub", "block", "part").applyInArrow(_rest_check(percent), "a long, b long")
    )
    links = checked.where("linked").select(F.col("hub").alias("a"), F.col("set").alias("b"))
    return links.union(found).union(light_links(shared, boundary, percent))


def _row_key(id_col: str, text_col: str):
    return F.xxhash64(F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")))


def _components(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """``key``, ``id``, ``n_shingles``, ``component_id`` of every row."""
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), _row_key(id_col, text_col).alias("key"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
    )
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    shown = int(size // BYTES_PER_WORD * (1 - percent / 100 + EXTRA))
    emitted = rows.mapInArrow(_Emitter(width, percent, repeats.bucket_count(shown)), _EMIT)
    seen = written(
        emitted.groupBy("bucket").applyInArrow(_tally, _TALLY)
        .groupBy("chunk").applyInArrow(
            _judge(percent), "id long, key long, fp binary, n_shingles long, survives boolean"
        ),
        "shingle-sets",
    )
    classes = written(
        seen.where("survives").groupBy("fp").agg(F.min("key").alias("key"), F.min("n_shingles").alias("size"))
        .withColumn("set", F.monotonically_increasing_id()),
        "set-classes",
    )
    total = classes.agg(F.sum("size").alias("n")).first()["n"] or 0
    # One text per class: rows that repeat id and text meet under one key.
    texts = rows.select("key", "text").join(classes, "key").groupBy("key", "set", "fp").agg(F.first("text").alias("text"))
    sets = texts.select("set", "text", "fp").mapInArrow(
        _set_maker(width), "set long, size long, shingles array<long>"
    )
    shared = written(shared_shingles(sets, total), "shared-shingles")
    parts = connected(link_sets(shared, percent))
    # The smallest id of a class, then of a component; classes without a link keep their own.
    own = seen.where("n_shingles > 0").groupBy("fp").agg(F.min("id").alias("class_id"))
    tied = classes.join(parts, classes["set"] == parts["node"]).select("fp", "component").join(own, "fp")
    least = tied.groupBy("component").agg(F.min("class_id").alias("least"))
    by_class = own.join(tied.join(least, "component").select("fp", "least"), "fp", "left").select(
        "fp", F.coalesce("least", "class_id").alias("component_id")
    )
    return seen.join(by_class, "fp", "left").select(
        "key", "id", "n_shingles", F.coalesce("component_id", "id").alias("component_id")
    )


def link_documents(
    docs: DataFrame, width: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: id, ``n_shingles``, ``component_id``.

    A-Z are lower-cased; a word is a run of bytes other than blank and control characters 9
    to 13. The set of a text is its distinct windows of ``width`` words, or the whole word
    sequence if it has fewer. Two texts link when 100 * intersection >= ``percent`` * union;
    ``component_id`` is the smallest id reachable by links, the row's own included. Texts
    that are NULL or hold no word have no shingles, link with nothing and keep their own id.
    Repeated texts and ids are linked like any others; with a NULL id a row still links, and
    its component is the smallest id that is not NULL. An empty table gives an empty one.
    Other columns are not read. ``docs`` must give its rows in the same order when a task is
    run again, as a table does.
    """
    linked = _components(docs, width, percent, id_col, text_col)
    return linked.select(F.col("id").alias(id_col), "n_shingles", "component_id")


def keep_one(docs: DataFrame, width: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns, reduced to the row of the smallest id of each component.

    Rows of that id with different texts stay together, and so do rows repeated in full; a row
    without an id stays, as no other can stand for it.
    """
    linked = _components(docs, width, percent, id_col, text_col).where("id != component_id")
    key, own = unused(docs.columns, "_out"), unused(docs.columns, "_out_id")
    # Rows that share an id are told apart by a hash of id and text.
    out = linked.select(F.col("key").alias(key), F.col("id").alias(own)).distinct()
    same = (_row_key(id_col, text_col) == F.col(key)) & F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(own))
    return docs.join(out, same, "left_anti")
