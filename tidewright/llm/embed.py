"""Embedding near-duplicates by a subspace pigeonhole join."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alone, components, settle

#: Dimensions of a block, on how many of them a grid cuts the range join, and a cell's width in reaches (over two).
#: More grid dimensions mean fewer comparisons and more rows dealt.
BLOCK, GRID, WIDTH = 8, 6, 4
#: Cells of a dimension at most, so that GRID of them make one long; narrower cells than this allows are widened.
CELLS = 1400
#: Vectors in one side of one comparison, and rows of small cells that are compared in one call.
CHUNK, LOT = 1024, 4096
#: Bytes of vectors that one Arrow batch holds at most; its offsets count to 2**31.
DEALT_BYTES = 1 << 28
#: A vector with more than one of so many rows is hot: fewer than HOT vectors can be.
HOT = 1024
#: Float slack added to every budget; the last check is exact.
SLACK = 1e-9


@functools.cache
def rotation(dims: int) -> np.ndarray:
    """A fixed random rotation, so that no block of coordinates is empty of difference."""
    q, r = np.linalg.qr(np.random.default_rng(dims).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


@functools.cache
def budgets(dims: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """(block starts, squared distance of each): unit vectors of this cosine differ by 2 - 2 cos
    in all; in some block by no more than the part of it that the block has of the dimensions."""
    starts = np.arange(0, dims, BLOCK)
    sizes = np.diff([*starts, dims])
    return starts, (2 - 2 * cosine) * sizes / dims + SLACK


def block_distances(a: np.ndarray, b: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Squared distances by block, of rows side by side."""
    return np.add.reduceat((a - b) ** 2, starts, axis=1)


def valid(column: str) -> F.Column:
    """Not null or empty, without null or non-finite components, not zero."""
    x = F.col(column)
    odd = lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == F.lit(float("inf")))
    return x.isNotNull() & (F.size(x) > 0) & ~F.coalesce(F.exists(x, odd), F.lit(True)) & F.exists(x, lambda v: v.cast("double") != 0)


def reached(g: np.ndarray, square: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For points g in a grid: (which points, their cells, whether it is their own): own cells, and the cells above
    it (in order of coordinates) that lie within reach, whose square is given. Of two points in different
    cells only the lower one's is a guest, so that a pair meets in one cell at most."""
    reach, dims = square**0.5, g.shape[1]
    width = max(WIDTH * reach, 2 / CELLS)
    base = (CELLS + 8) ** np.arange(dims)[::-1].astype(np.int64)
    own = np.floor(g / width).astype(np.int64)
    inside = g - own * width
    up = inside > width / 2  # of the two walls in each dimension at most the nearer one is in reach
    wall = np.where(up, width - inside, inside)
    wall = np.where(wall <= reach, wall**2, np.inf)
    step = np.where(up, 1, -1) * base[None, :]
    home = (own + CELLS // 2 + 2) @ base
    which, cells = [np.arange(len(g))], [home]
    for chosen in range(1, 1 << dims):
        d = [d for d in range(dims) if chosen >> d & 1]
        pick = np.flatnonzero(up[:, d[0]] & (wall[:, d].sum(axis=1) <= square))
        which.append(pick)
        cells.append(home[pick] + step[pick][:, d].sum(axis=1))
    return np.concatenate(which), np.concatenate(cells), np.arange(sum(map(len, which))) < len(g)


def packed(x: np.ndarray) -> pa.Array:
    """A binary value a row, its bytes."""
    raw = np.ascontiguousarray(x)
    size = raw.itemsize * raw.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(np.arange(0, (len(raw) + 1) * size, size, dtype=np.int32)), pa.py_buffer(raw)])


def _bounded(rows: np.ndarray, d: int) -> list[np.ndarray]:
    """Rows of vectors with d components in parts whose vectors, once in each cell that they may reach, stay within DEALT_BYTES."""
    step = max(1, DEALT_BYTES // (8 * d << GRID))
    return [rows[i : i + step] for i in range(0, len(rows), step)]


def placed(rows: DataFrame, cosine: float, whole: bool) -> DataFrame:
    """rows (rid, label, copies, v) dealt to (label, dims, block, cell): home in their own cell, and
    guests of the cells above it that lie within the block's reach in the grid dimensions.

    ``whole``: with copies and the vector (its components' bytes); else keys alone.
    """
    schema = "rid long, label string, dims int, block int, cell long, home boolean"

    def deal(batches):
        alone("embed")
        for batch in batches:
            ids, copies = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("rid", "copies"))
            lists, labels = batch.column("v"), batch.column("label")
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            lengths = np.diff(ends, prepend=0)
            for d, at in ((d, part) for d in np.unique(lengths).tolist() for part in _bounded(np.flatnonzero(lengths == d), d)):
                x = flat[(ends[at] - d)[:, None] + np.arange(d)[None, :]]
                u = x.astype(np.float64)
                u = (u / np.linalg.norm(u, axis=1, keepdims=True)) @ rotation(d)
                starts, most = budgets(d, cosine)
                for k, start in enumerate(starts):
                    pick, cell, home = reached(u[:, start : start + min(GRID, BLOCK, d - start)], most[k])
                    rows_at = at[pick]
                    out = [
                        pa.array(ids[rows_at]), labels.take(pa.array(rows_at)), pa.array(np.full(len(pick), d, np.int32)),
                        pa.array(np.full(len(pick), k, np.int32)), pa.array(cell), pa.array(home),
                    ]
                    names = ["rid", "label", "dims", "block", "cell", "home"]
                    if whole:
                        out += [pa.array(copies[rows_at]), packed(x[pick])]
                        names += ["copies", "v"]
                    yield pa.RecordBatch.from_arrays(out, names)

    return rows.mapInArrow(deal, schema + (", copies long, v binary" if whole else ""))


def links_in(table: pa.Table, cosine: float) -> pa.Table:
    """The comparison of one chunk of a cell, or of a lot of small cells: left rows against right rows of a cell, each linked
    pair found once in the whole job.

    A pair meets in one cell of a block at most; it counts there if one of it is at home on the left, the other a guest or of a
    larger id, in the first block whose budget it keeps; then the cosine decides, in double precision. Returned: links by vector, and
    enough pairs to connect what is linked here (b null: only a count).
    """
    out = {"a": [], "b": [], "n": []}
    if table.num_rows:
        alone("embed")
        order = np.argsort(table.column("cell").to_numpy(), kind="stable")
        table = table.take(order)
        ids, cells, copies = (table.column(c).to_numpy() for c in ("rid", "cell", "copies"))
        home, left, right = (table.column(c).to_numpy(zero_copy_only=False) for c in ("home", "left", "right"))
        d, k = int(table.column("dims")[0].as_py()), int(table.column("block")[0].as_py())
        raw = b"".join(table.column("v").to_pylist())
        x = np.frombuffer(raw, np.float32 if len(raw) == 4 * d * len(ids) else np.float64).reshape(-1, d).astype(np.float64)
        norm = np.sqrt(np.einsum("ij,ij->i", x, x))
        r = (x / norm[:, None]) @ rotation(d)
        starts, most = budgets(d, cosine)
        block = r[:, starts[k] : starts[k] + BLOCK]
        square = (block**2).sum(axis=1)
        n = np.zeros(len(ids), np.int64)
        parent: dict[int, int] = {}

        def find(i: int) -> int:
            while parent.setdefault(i, i) != i:
                parent[i] = i = parent[parent[i]]
            return i

        def decide(p: np.ndarray, q: np.ndarray) -> None:
            inside = block_distances(r[p], r[q], starts) <= most[None, :]
            good = inside[:, k] & ~inside[:, :k].any(axis=1)
            p, q = p[good], q[good]
            good = np.einsum("ij,ij->i", x[p], x[q]) / (norm[p] * norm[q]) >= cosine
            p, q = p[good], q[good]
            np.add.at(n, p, copies[q])
            np.add.at(n, q, copies[p])
            for a, b in zip(ids[p].tolist(), ids[q].tolist(), strict=True):
                fa, fb = find(a), find(b)
                if fa != fb:
                    parent[max(fa, fb)] = min(fa, fb)

        edges = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), len(ids)]
        for low, high in zip(edges, edges[1:], strict=False):
            one, two = low + np.flatnonzero(left[low:high]), low + np.flatnonzero(right[low:high])
            for at in range(0, len(one), 256):
                rows = one[at : at + 256]
                near = square[rows][:, None] + square[two][None, :] - 2 * block[rows] @ block[two].T <= most[k] + 1e-6
                near &= ~home[two][None, :] | (ids[rows][:, None] < ids[two][None, :])
                if near.any():
                    i, j = np.nonzero(near)
                    for s in range(0, len(i), 65536):
                        decide(rows[i[s : s + 65536]], two[j[s : s + 65536]])
        # a vector has a row in many cells of a lot
        for a, count in zip(*(y.tolist() for y in _summed(ids, n)), strict=True):
            root = find(a)
            out["a"].append(a)
            out["b"].append(root if root != a else None)
            out["n"].append(count)
    return pa.table({"a": pa.array(out["a"], pa.int64()), "b": pa.array(out["b"], pa.int64()), "n": pa.array(out["n"], pa.int64())})


def _summed(ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, sum of n) of the ids with n above 0."""
    some = n > 0
    each, at = np.unique(ids[some], return_inverse=True)
    return each, np.bincount(at, weights=n[some], minlength=len(each)).astype(np.int64)


def near_vectors(vectors: DataFrame, cosine: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors (vec_id, embedding, label).

    Two rows link if their labels are equal and not null, their vectors have the same number
    of components and their cosine is at least ``cosine``. Null, empty or zero vectors and
    those with null or non-finite components link with nothing, and are their own component.
    Labels of any type are compared as text (0.0 and -0.0 differ); columns of other names, whatever they are, clash with nothing. Other columns are not read; an empty table gives no rows.
    Equal vectors of a label are compared once and count one another. Rows of equal vec_id
    are rows of one component if they link. Cells with many members are dealt in chunks, all
    pairs of chunks; pairs never leave a task, only counts and a forest do.
    """
    rows = vectors.select("vec_id", F.col("embedding").alias("v"), F.col("label").cast("string").alias("label"))
    rows = rows.withColumn("_ok", valid("v") & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    groups = settle(rows.where("_ok").groupBy("label", "v").agg(F.min("vec_id").alias("rid"), F.count(F.lit(1)).alias("copies")))
    key = ["label", "dims", "block", "cell"]
    sizes = placed(groups, cosine, whole=False).groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.count_if("home").alias("homes"))
    parts = lambda n: F.ceil(F.col(n) / CHUNK).cast("int")
    sizes = settle(sizes.where("homes > 0 and n > 1").select(*key, "n", parts("homes").alias("lefts"), parts("n").alias("rights")))
    lots = sizes.where("rights = 1").groupBy(*key[:3]).agg(F.ceil(F.sum("n") / LOT).alias("lots"))
    lot = F.when(F.col("rights") == 1, F.pmod(F.xxhash64("cell"), F.col("lots"))).otherwise(-1 - F.col("cell"))
    sizes = sizes.join(lots, key[:3], "left").select(*key, "lefts", "rights", lot.alias("lot"))
    dealt = placed(groups, cosine, whole=True).join(sizes, key)
    dealt = dealt.withColumn("li", F.pmod(F.xxhash64("rid"), F.col("lefts")).cast("int")).withColumn("rj", F.pmod(F.xxhash64("rid", F.lit(1)), F.col("rights")).cast("int"))
    count = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    part = lambda i, j, left, right: F.struct(i.alias("i"), j.alias("j"), left.alias("left"), right.alias("right"))
    as_left = F.transform(count("rights"), lambda j: part(F.col("li"), j, F.col("home"), F.col("home") & (j == F.col("rj"))))
    as_right = F.transform(count("lefts"), lambda i: part(i, F.col("rj"), F.lit(False), ~F.col("home") | (i != F.col("li"))))
    # where a home row is on both sides of a chunk, its left entry serves for both
    dealt = dealt.withColumn("_p", F.explode(F.concat(as_left, as_right))).select(*key, "lot", "rid", "copies", "home", "v", "_p.*").where("left or right")
    found = settle(dealt.groupBy(*key[:3], "lot", "i", "j").applyInArrow(lambda t: links_in(t, cosine), "a long, b long, n long"))
    reach = components(found.where("b is not null").select("a", "b"))
    counts = found.groupBy(F.col("a").alias("rid")).agg(F.sum("n").alias("n"))
    named = groups.join(counts, "rid", "left").join(reach.withColumnRenamed("id", "rid"), "rid", "left").select(
        F.col("label").alias("_l"), F.col("v").alias("_v"), "rid", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "rid").alias("c"), "copies"
    )
    # copies of a hot vector stay where they are: fewer than HOT vectors have more than one of HOT rows
    every = groups.agg(F.sum("copies")).first()[0] or 0
    hot = F.broadcast(named.where(F.col("copies") * HOT > every))
    same = F.col("_ok") & (F.col("label") == F.col("_l")) & (F.col("v") == F.col("_v"))
    rest = rows.join(hot.select("_l", "_v"), same, "left_anti").join(named, same, "left")
    out = rows.join(hot, same).unionByName(rest)
    component = F.coalesce("c", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
