"""Embedding near-dedup: spherical k-means cells and blocked cosine products.

Cells come in two levels. The few cells of the first hold ``TOP`` vectors on average; their centres come from rounds of spherical k-means over
all vectors, in which each task sends one sum for each cell that it met. They alone are held by the driver and sent to every
executor, within the bound of a broadcast (where more would be wanted, cells hold more). The vectors of a first cell come together in
one task, which cuts them by the same k-means into cells of ``CELL`` residents and compares within these.

A pair whose cosine is at least the threshold lies within the angle t = arccos(threshold). On both levels a vector visits,
beyond its home, the cells whose centres are hardly further than its own, and each cell compares its residents with
residents and visitors in blocks, each against all. From x at home in c to y at home in d the difference of the angles to c and to d
changes by 2 t at most (the triangle inequality), so x visits d or y visits c if both visit what is no more than t further.

Visiting every cell within t is exact, but in many dimensions means visiting everywhere. The angles of two
near-duplicates to a centre differ by about t / sqrt(dimension) there, and that difference by sqrt(2) times as much, so ``MARGIN`` of t is
visited: in 64 dimensions a pair is lost beyond four standard deviations. What visits a first cell visits twice as far in it, because there it
can't be visited. Recall against brute force is tested (at least 0.9; 1.0 on all tables at hand).

Groups are the connected components of the pairs; the least vec_id of each is kept. For groups a first cell sends no
pairs, only a star for each of its own components, so thousands of copies cost as many rows, not their square.

Defined results. Null or empty embeddings, of another length than most (of lengths that are equally common, the least counts), with a null or non-finite
entry, or all zeros: no partner, kept. Null vec_ids are left out. Repeated rows of one vec_id are one vector (the first of equal ids in
order of its values). A pair just at the threshold (a tie) is a pair. Other columns may have any name. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._spark import BROADCAST_BYTES, bounded, durable
from .components import groups, roots, unite

THRESHOLD = 0.95
#: Vectors in a cell of the first and of the second level on average, rounds of k-means, share of the exact visiting margin that is used,
#: rows in a block, entries of a matrix of cosines to centres.
TOP, CELL, ROUNDS, MARGIN, ROWS, ENTRIES = 10_000, 1000, 4, 0.35, 1024, 4_000_000


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)


def _parts(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Parts of batches whose cosines to k centres fit in a bounded matrix."""
    rows = max(1, ENTRIES // k)
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _visits(x: np.ndarray, centres: np.ndarray, reach: float | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which cells each vector visits, and which is its home."""
    angle = np.arccos(np.clip(x @ centres.T, -1, 1))
    home = angle.argmin(1)
    return angle <= angle[np.arange(len(x)), home][:, None] + np.reshape(reach, (-1, 1)), home


def _moved(centres: np.ndarray, cells: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """The centres with those of some cells moved to their vectors' mean direction; cells without vectors, or whose cancel out, stay."""
    norm = np.linalg.norm(sums, axis=1, keepdims=True)
    new = centres.copy()
    new[cells] = np.where(norm > 0, sums / np.maximum(norm, 1e-300), centres[cells])
    return new


def _sums(x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cells that vectors are at home in, and their sums."""
    order = np.argsort(home, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(home[order]) > 0])
    return home[order][starts], np.add.reduceat(x[order].astype(np.float64), starts, axis=0)


def tops(vectors: DataFrame, dim: int, n: int, top: int, seed: int = 0) -> np.ndarray:
    """Unit centres of the first level, from sums over all vectors."""
    k = max(1, min(n // top, BROADCAST_BYTES // (4 * dim)))
    rows = vectors.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(k).select("embedding").toArrow()["embedding"].combine_chunks()
    centres = matrix(rows, dim)
    spark = vectors.sparkSession
    for _ in range(ROUNDS if k > 1 else 0):
        shared = spark.sparkContext.broadcast(centres)

        def local(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for part in _parts(batches, len(shared.value)):
                x = matrix(part["embedding"], dim)
                for cell, s in zip(*_sums(x, (x @ shared.value.T).argmax(1)), strict=True):
                    total[int(cell)] = total[int(cell)] + s if int(cell) in total else s
            if total:
                yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.list_(pa.float64()))], ["cell", "sum"])

        found = vectors.mapInArrow(local, "cell int, sum array<double>").groupBy("cell").agg(F.array(*[F.sum(F.col("sum")[d]) for d in range(dim)]).alias("sum")).orderBy("cell").collect()
        centres = _moved(centres, np.array([r["cell"] for r in found]), np.array([r["sum"] for r in found])).astype(np.float32)
    return centres


def cells(x: np.ndarray, order: np.ndarray, cell: int) -> np.ndarray:
    """Unit centres of the second level for the residents x of a first cell; ``order`` says which begin."""
    centres = x[order[: max(1, len(x) // cell)]]
    step = max(1, ENTRIES // len(centres))
    for _ in range(ROUNDS if len(centres) > 1 else 0):
        home = np.concatenate([(x[a : a + step] @ centres.T).argmax(1) for a in range(0, len(x), step)])
        centres = _moved(centres, *_sums(x, home)).astype(np.float32)
    return centres


def clean(table: DataFrame) -> tuple[DataFrame, int, int]:
    """Unit vectors of the usual length, one of each vec_id; that length; their number."""
    bounded(table)
    e = F.col("`embedding`").cast("array<double>")
    rows = table.select(F.col("`vec_id`").cast("long").alias("vec_id"), e.alias("e")).where("vec_id is not null and size(e) > 0")
    rows = rows.where(F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e150))).withColumn("norm", F.sqrt(F.aggregate("e", F.lit(0.0), lambda a, x: a + x * x))).where("norm > 0")
    rows = rows.groupBy("vec_id").agg(F.min_by("e", F.struct("e")).alias("e"), F.min_by("norm", F.struct("e")).alias("norm"))
    rows = durable(rows.select("vec_id", F.transform("e", lambda x: (x / F.col("norm")).cast("float")).alias("embedding")), "vectors")
    dims = rows.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not dims:
        return rows, 0, 0
    return rows.where(F.size("embedding") == dims[0]["dim"]), dims[0]["dim"], dims[0]["count"]


def near_pairs(table: DataFrame, threshold: float = THRESHOLD, stars: bool = False, top: int = TOP, cell: int = CELL) -> DataFrame:
    """a < b (vec_ids) and their cosine, at least the threshold. With ``stars``: of every component inside a first cell, only
    the pairs of its least vec_id with the others (the cosine is then null)."""
    vectors, dim, n = clean(table)
    if n == 0:
        return table.sparkSession.createDataFrame([], "a long, b long, cosine double")
    shared = table.sparkSession.sparkContext.broadcast(tops(vectors, dim, n, top))
    reach = np.arccos(threshold) * MARGIN

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches, len(shared.value)):
            visits, home = _visits(matrix(batch["embedding"], dim), shared.value, reach)
            row, at = np.nonzero(visits)
            yield pa.record_batch([pa.array(at, pa.int32()), pa.array(home[row] == at), batch["vec_id"].take(pa.array(row)), batch["embedding"].take(pa.array(row))], ["cell", "home", "vec_id", "embedding"])

    def compare(key: tuple, part: pa.Table) -> pa.Table:
        ids, resident, x = part["vec_id"].to_numpy(), part["home"].to_numpy(), matrix(part["embedding"].combine_chunks(), dim)
        order = np.argsort(ids, kind="stable")
        ids, resident, x = ids[order], resident[order], x[order]
        parent = np.arange(len(ids))
        left, right, cosine = [], [], []
        if resident.any():
            centres = cells(x[resident], np.argsort(T.mix(ids[resident].view(T.U64)), kind="stable"), cell)
            step = max(1, ENTRIES // len(centres))
            far = np.where(resident, reach, 2 * reach)
            parts = [_visits(x[a : a + step], centres, far[a : a + step]) for a in range(0, len(x), step)]
            visits, home = np.concatenate([v for v, _ in parts]), np.concatenate([h for _, h in parts])
            for c in range(len(centres)):
                members = np.flatnonzero(visits[:, c])
                mine = members[resident[members] & (home[members] == c)]
                for a in range(0, len(mine), ROWS):
                    r = mine[a : a + ROWS]
                    for b in range(0, len(members), ROWS):
                        m = members[b : b + ROWS]
                        i, j = np.nonzero(x[r] @ x[m].T >= threshold - 1e-6)
                        u, v = r[i], m[j]
                        u, v = u[u != v], v[u != v]
                        exact = np.einsum("ij,ij->i", x[u].astype(np.float64), x[v].astype(np.float64))
                        u, v, exact = u[exact >= threshold], v[exact >= threshold], exact[exact >= threshold]
                        if stars:
                            unite(parent, u, v)
                        else:
                            left.append(np.minimum(ids[u], ids[v]))
                            right.append(np.maximum(ids[u], ids[v]))
                            cosine.append(exact)
        if stars:
            root = roots(parent, np.arange(len(ids)))
            ok = ids != ids[root]
            return pa.table({"a": ids[root][ok], "b": ids[ok], "cosine": pa.nulls(int(ok.sum()), pa.float64())})
        u, v, c = (np.concatenate([np.zeros(0, k), *y]) for k, y in ((np.int64, left), (np.int64, right), (np.float64, cosine)))
        return pa.table({"a": u, "b": v, "cosine": np.round(c, 6)})

    visits = vectors.mapInArrow(visit, "cell int, home boolean, vec_id long, embedding array<float>")
    pairs = visits.groupBy("cell").applyInArrow(compare, "a long, b long, cosine double")
    return pairs.groupBy("a", "b").agg(F.max("cosine").alias("cosine"))


def dedup(table: DataFrame, threshold: float = THRESHOLD, top: int = TOP, cell: int = CELL) -> DataFrame:
    """vec_id and keep (the representative of its group, itself where it has no partner) of every vector."""
    label = groups(near_pairs(table, threshold, True, top, cell).select("a", "b"))
    ids = table.select(F.col("`vec_id`").cast("long").alias("vec_id")).where("vec_id is not null").distinct()
    return ids.join(label, ids.vec_id == label.node, "left").select("vec_id", F.coalesce("label", "vec_id").alias("keep")).withColumn("kept", F.col("keep") == F.col("vec_id"))
