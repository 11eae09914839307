"""Embedding near-duplicates through an inverted multi-index.

Each half of the unit vectors has its own codebook; pairs of codewords are the cells of a
product grid. A query visits cells in the order of a lower bound on the distance to anything
in them: being nearer to codeword c than to its own codeword costs at least the distance
to the plane between the two, and the squares of both halves add up. Multi-sequence traversal
walks the sorted bounds of the two halves and stops once the bound exceeds the radius that
belongs to the threshold; with ``recall`` 1 that loses no pair, below 1 the radius is the
one within which that share of the pairs of a sample lies. Visited cells are then verified
by cosine in double precision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stancewright.llm.components import connected
from stancewright.llm.scratch import written

#: Vectors that the codebooks are fitted on at most; the only rows that reach the driver.
SAMPLE = 20_000
SAMPLE_BYTES = 64 << 20
#: Codebooks grow with the table as far as the sample can place codewords.
POINTS_PER_CODEWORD = 8
CELL_VECTORS = 64
BLOCK_VECTORS = 4096
QUERY_BLOCK_VECTORS = 16_384
#: Keeps rounding in the bounds from hiding a pair at the threshold.
SLACK = 1e-9


def unit_vectors(column: pa.Array | pa.ChunkedArray) -> list[np.ndarray | None]:
    """Vectors of length one; None for NULL, empty, zero, NULL-holding or non-finite ones."""
    found = []
    for vector in column.to_pylist():
        if not vector or None in vector:
            found.append(None)
            continue
        v = np.array(vector, np.float64)
        largest = np.abs(v).max()
        ok = np.isfinite(largest) and largest > 0
        v = v / largest if ok else v
        found.append(v / np.sqrt(v @ v) if ok else None)
    return found


def _codebook(points: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's k-means; an emptied codeword moves to the point that is worst served."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(points, axis=0)
    words = distinct[rng.choice(len(distinct), min(k, len(distinct)), replace=False)]
    for _ in range(rounds):
        gap = _squares(points, words)
        nearest = gap.argmin(1)
        worst = iter(np.argsort(-gap.min(1)))
        for j in range(len(words)):
            mine = points[nearest == j]
            words[j] = mine.mean(0) if len(mine) else points[next(worst)]
    return words


def _squares(points: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.maximum(
        (points**2).sum(1)[:, None] - 2 * points @ words.T + (words**2).sum(1)[None, :], 0
    )


class MultiIndex:
    """The two codebooks, and how far a query has to look."""

    def __init__(self, first: np.ndarray, second: np.ndarray, radius2: float) -> None:
        self.books, self.radius2 = (first, second), radius2
        self.cut = first.shape[1]

    def halves(self, units: np.ndarray):
        return units[:, : self.cut], units[:, self.cut :]

    def cells(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(_squares(h, b).argmin(1) for h, b in zip(self.halves(units), self.books))

    def bounds(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared lower bounds from each vector to each codeword's share of a half."""
        found = []
        for half, book in zip(self.halves(units), self.books):
            gap = _squares(half, book)
            own = gap.argmin(1)
            apart = np.sqrt(_squares(book, book))[own]
            ahead = gap - gap[np.arange(len(gap)), own][:, None]
            with np.errstate(divide="ignore", invalid="ignore"):
                bound = np.where(apart > 0, ahead / (2 * apart), 0)
            found.append(np.maximum(bound, 0) ** 2)
        return tuple(found)

    def visit(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells of one query in multi-sequence order, nearest first, up to the radius.

        Along the sorted bounds of the first half, the number of cells within the radius in
        the second half only shrinks; that staircase is what the traversal pops.
        """
        rows, columns = np.argsort(first), np.argsort(second)
        room = self.radius2 + SLACK - first[rows]
        steps = np.searchsorted(second[columns], room, "right")
        i = np.repeat(rows, steps)
        j = columns[np.arange(steps.sum()) - np.repeat(np.cumsum(steps) - steps, steps)]
        order = np.argsort(first[i] + second[j], kind="stable")
        return i[order], j[order]


def fit_index(units: np.ndarray, codewords: int, threshold: float, recall: float = 1.0) -> MultiIndex:
    """Codebooks from sampled unit vectors, and the radius for the wanted recall."""
    cut = max(1, units.shape[1] // 2)
    books = [
        _codebook(h, codewords, seed) for seed, h in enumerate((units[:, :cut], units[:, cut:]))
    ]
    index = MultiIndex(*books, radius2=2 - 2 * threshold)
    if recall < 1:
        i, j = index.cells(units)
        first, second = index.bounds(units)
        spread = []
        for start in range(0, len(units), 1024):
            a, b = np.nonzero(units[start : start + 1024] @ units.T >= threshold)
            apart = a + start != b
            a, b = a[apart] + start, b[apart]
            spread.append(first[a, i[b]] + second[a, j[b]])
        spread = np.concatenate(spread)
        if len(spread):
            index.radius2 = min(index.radius2, float(np.quantile(spread, recall)))
    return index


def _fingerprinter(batches):
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("fp", pa.binary()), ("dims", pa.int32()), ("unit", pa.list_(pa.float64()))])
    for batch in batches:
        units = unit_vectors(batch.column(2))
        labels = batch.column(1).to_pylist()
        units = [u if label is not None else None for u, label in zip(units, labels)]
        fps = [
            None if u is None else xxhash.xxh3_128_digest(u.tobytes() + label.encode())
            for u, label in zip(units, labels)
        ]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(fps, pa.binary()),
             pa.array([None if u is None else len(u) for u in units], pa.int32()),
             pa.array(units, pa.list_(pa.float64()))],
            schema=schema,
        )


def _router(indexes: dict[int, MultiIndex]):
    """Where each vector is data, its own cell, and where it is a query, all cells that it visits, by row.

    Only numbers leave here; the vectors follow when their blocks are known.
    """
    schema = pa.schema(
        [("rep", pa.int64()), ("label", pa.string()), ("dims", pa.int32()), ("row", pa.int32()),
         ("own_column", pa.int32()), ("columns", pa.list_(pa.int32()))]
    )

    def route(batches):
        for batch in batches:
            out = {name: [] for name in schema.names}
            dims = np.array(batch.column(3).to_pylist())
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                part = batch.take(pa.array(at))
                index = indexes[int(d)]
                units = np.array(part.column(2).to_pylist())
                own_i, own_j = index.cells(units)
                first, second = index.bounds(units)
                for n, (rep, label) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist())):
                    i, j = index.visit(first[n], second[n])
                    rows = [(own_i[n], own_j[n], None)]
                    rows += [(row, None, j[i == row]) for row in np.unique(i)]
                    for row, column, columns in rows:
                        for name, value in zip(schema.names, (rep, label, d, row, column, columns)):
                            out[name].append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[f.name], f.type) for f in schema], schema=schema
            )

    return route


def _verifier(threshold: float):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def verify(group: pa.Table) -> pa.Table:
        """Links of a block of queries with a block of data.

        Returned are the number of vectors that each query is linked with here, and edges
        from every linked vector to the smallest one that it reaches inside the block.
        """
        column = np.array([-1 if x is None else x for x in group.column("own_column").to_pylist()])
        data, asked = np.flatnonzero(column >= 0), np.flatnonzero(column < 0)
        if not len(data) or not len(asked):
            return schema.empty_table()
        reps, copies = group.column("rep").to_numpy(), group.column("copies").to_numpy()
        flat = group.column("unit").combine_chunks()
        units = np.asarray(flat.flatten()).reshape(group.num_rows, -1)
        visits = group.column("columns").to_pylist()
        order = data[np.argsort(column[data], kind="stable")]
        width = int(max(column[data].max(), max(max(visits[q]) for q in asked))) + 1
        q_all, d_all, counts = [], [], {}
        for start in range(0, len(asked), 1024):
            rows = asked[start : start + 1024]
            allowed = np.zeros((len(rows), width), bool)
            for n, q in enumerate(rows):
                allowed[n, visits[q]] = True
            near = units[rows] @ units[order].T >= threshold
            near &= allowed[:, column[order]]
            near &= reps[rows][:, None] != reps[order][None, :]
            for n in np.flatnonzero(near.any(1)):
                counts[int(reps[rows[n]])] = int(copies[order[near[n]]].sum())
            hit = near.any(1)
            if hit.any():
                q_all.append((rows[hit], near[hit]))
        label = {int(r): int(r) for r in reps[data]} | {q: q for q in counts}
        changed = bool(q_all)
        data_label = reps[order].copy()
        query_labels = [reps[rows].copy() for rows, _ in q_all]
        big = np.iinfo(np.int64).max
        while changed:
            changed = False
            for n, (rows, near) in enumerate(q_all):
                least = np.minimum(query_labels[n], np.where(near, data_label[None, :], big).min(1))
                back = np.minimum(data_label, np.where(near, least[:, None], big).min(0))
                changed |= bool((least != query_labels[n]).any() or (back != data_label).any())
                query_labels[n], data_label = least, back
        edges = {
            (int(x), int(y))
            for xs, ys in [(reps[order], data_label), *((reps[r], m) for (r, _), m in zip(q_all, query_labels))]
            for x, y in zip(xs[xs != ys], ys[xs != ys])
        }
        rows = [(q, None, n) for q, n in counts.items()] + [(x, y, None) for x, y in edges]
        return pa.table([pa.array(c, pa.int64()) for c in zip(*rows)], schema=schema) if rows else schema.empty_table()

    return verify


def link_vectors(
    vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding",
    label_col: str = "label", recall: float = 1.0, sample: int = SAMPLE,
) -> DataFrame:
    """One row per row of ``vectors``: id, ``n_links``, ``component_id``, ``kept``.

    Vectors are compared if their labels are equal and not NULL, and linked at a cosine of
    ``threshold`` or more. ``n_links`` counts the other vectors linked directly,
    ``component_id`` is the smallest id reachable, ``kept`` marks the row of that id. Vectors
    that are NULL, empty, zero or hold NULL or non-finite components link with nothing, nor
    do vectors of different length. Vectors that are equal once brought to length one are
    linked as one with its number of copies, so repeated rows cost nothing; rows that repeat
    an id count as different vectors if their contents differ. An empty table gives an empty
    one. Other columns are not read. ``sample`` bounds the rows that the codebooks are
    fitted on, and ``SAMPLE_BYTES`` their size; every row is indexed.
    """
    rows = vectors.select(
        F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").cast("string").alias("label"),
        F.col(f"`{vector_col}`").cast("array<double>").alias("v"),
    )
    units = written(
        rows.mapInArrow(_fingerprinter, "vec_id long, label string, fp binary, dims int, unit array<double>"),
        "unit-vectors",
    )
    reps = (
        units.where("fp is not null").groupBy("fp")
        .agg(F.min("vec_id").alias("rep_id"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"),
             F.first("dims").alias("dims"), F.first("unit").alias("unit"))
    )
    reps = written(reps.withColumn("rep", F.monotonically_increasing_id()), "distinct-vectors")
    # One row for each vector length: a table of embeddings has one or a few.
    largest = {
        r["dims"]: r["n"]
        for r in reps.groupBy("dims", "label").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("dims").agg(F.max("n").alias("n")).collect()
    }
    indexes = {}
    for dims, n in largest.items():
        most = min(sample, max(1, SAMPLE_BYTES // (8 * dims)))
        rows = reps.where(F.col("dims") == dims).orderBy(F.xxhash64("fp"), "rep").limit(most).select("unit").collect()
        points = np.array([r["unit"] for r in rows])
        codewords = min(max(8, len(points) // POINTS_PER_CODEWORD), max(8, round((n / CELL_VECTORS) ** 0.5)))
        indexes[dims] = fit_index(points, codewords, threshold, recall)
    routed = reps.select("rep", "label", "unit", "dims").mapInArrow(
        _router(indexes),
        "rep long, label string, dims int, row int, own_column int, columns array<int>",
    )
    routed = written(routed, "vector-routes")
    cell = ["label", "dims", "row"]
    is_data = F.col("own_column").isNotNull()
    sizes = routed.groupBy(*cell).agg(
        F.ceil(F.count(F.when(is_data, 1)) / BLOCK_VECTORS).alias("blocks"),
        F.ceil(F.count(F.when(~is_data, 1)) / QUERY_BLOCK_VECTORS).alias("parts"),
    ).where("blocks > 0 and parts > 0")
    sized = routed.join(sizes, cell)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    dealt = lambda n: F.pmod(F.xxhash64("rep"), F.col(n))
    data = sized.where(is_data).withColumn("block", dealt("blocks")).withColumn("part", every("parts"))
    asked = sized.where(~is_data).withColumn("block", every("blocks")).withColumn("part", dealt("parts"))
    found = written(
        data.unionByName(asked).join(reps.select("rep", "unit", "copies"), "rep").groupBy(*cell, "block", "part")
        .applyInArrow(_verifier(threshold), "a long, b long, n long"),
        "vector-links",
    )
    counts = found.where("n is not null").groupBy("a").agg(F.sum("n").alias("others"))
    parts = connected(found.where("b is not null").select("a", "b"))
    joined = (
        reps.join(counts, reps["rep"] == counts["a"], "left").join(parts, reps["rep"] == parts["node"], "left")
        .select("fp", "rep_id", "copies", F.coalesce("others", F.lit(0)).alias("others"),
                F.coalesce("component", "rep").alias("part"))
    )
    joined = written(joined, "vector-parts")
    least = joined.groupBy("part").agg(F.min("rep_id").alias("component_id"))
    by_class = joined.join(least, "part").select("fp", "component_id", (F.col("others") + F.col("copies") - 1).alias("links"))
    return units.select("vec_id", "fp").join(by_class, "fp", "left").select(
        F.col("vec_id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(False)).alias("kept"),
    )
