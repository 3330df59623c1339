"""Products of the sparse spot x gene matrix: leading components by block Krylov steps, and correlations by tiles of genes.

Rows are packed (one array of entries per spot). No dense genes x genes matrix exists in one place: a component step sends
genes x block numbers, a tile holds a few hundred genes by a few hundred."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.blocks import _Rows
from tessera.session import cut_lineage, spread

BATCH_ROWS = 2048
MOST_STEPS = 12  # Krylov steps; the driver keeps genes x block x steps numbers
BAND = 256  # genes on each side of a tile
SLOTS = 8  # partial sums of a tile before they are added


def packed(entries: DataFrame, order: DataFrame, keys: list[str], column: str) -> DataFrame:
    """(*keys, row): entries of the genes in `order` (gene, _p) as arrays of (place, value)."""
    e = entries.join(order, "gene").filter(F.col(column) != 0)
    return e.groupBy(*keys).agg(F.collect_list(F.struct(F.col("_p").cast("int").alias("g"), F.col(column).cast("double").alias("v"))).alias("row"))


def _parts(batches):
    for batch in batches:
        for i in range(0, batch.num_rows, BATCH_ROWS):
            part = batch.slice(i, BATCH_ROWS)
            yield part, _Rows(pa.chunked_array([part.column("row")]))


def _dot(rows: _Rows, q: np.ndarray) -> np.ndarray:
    out = np.zeros((rows.n, q.shape[1]))
    for a, b, x in rows.slabs():
        out += x @ q[rows.genes[a:b]]
    return out


def _added(partials: DataFrame, slots: int = 16) -> np.ndarray:
    """Sum of equal-shaped arrays in two rounds; one array reaches the driver."""
    def add(_: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py()) for x in table["part"])
        return pa.table({"part": pa.array([total.tobytes()], pa.binary())})

    first = partials.withColumn("_s", F.expr(f"pmod(hash(part), {slots})")).groupBy("_s").applyInArrow(add, "part binary")
    return sum(np.frombuffer(bytes(r["part"])) for r in first.toLocalIterator())


def components(rows: DataFrame, offsets: dict[str, np.ndarray], n_genes: int, k: int, seed: int = 0, tolerance: float = 1e-10) -> tuple[np.ndarray, np.ndarray]:
    """Leading right singular vectors (genes x k) and squared singular values of X, whose rows are the packed `row` plus the
    offset of their slice.

    Block Krylov steps: each step is one pass that applies X'X to a block of genes x (k + 10) numbers; the basis is kept
    orthonormal, and steps end when the residuals of the k leading Ritz pairs vanish or the basis is the whole space."""
    spark, block = rows.sparkSession, min(n_genes, k + 10)
    names = list(offsets)
    shift = spark.sparkContext.broadcast((names, np.stack([offsets[s] for s in names])))

    def applied(q: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast(q)

        def step(batches):
            q, (names, shift) = shared.value, shift_of()
            z, sums, index = np.zeros(q.shape), np.zeros((len(names), q.shape[1])), pa.array(names)
            base = shift @ q
            for part, x in _parts(batches):
                at = pc.index_in(part.column("slice"), index).to_numpy()
                y = _dot(x, q) + base[at]
                np.add.at(sums, at, y)
                for a, b, m in x.slabs():
                    z[x.genes[a:b]] += m.T @ y
            yield pa.record_batch([pa.array([(z + shift.T @ sums).tobytes()], pa.binary())], ["part"])

        shift_of = lambda: shift.value
        out = _added(rows.select("slice", "row").mapInArrow(step, "part binary")).reshape(q.shape)
        shared.destroy()
        return out

    basis, images = np.zeros((n_genes, 0)), np.zeros((n_genes, 0))
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(n_genes, block)))[0]
    for _ in range(MOST_STEPS):
        z = applied(q)
        basis, images = np.hstack([basis, q]), np.hstack([images, z])
        small = basis.T @ images
        theta, w = np.linalg.eigh((small + small.T) / 2)
        theta, w = theta[::-1][:k], w[:, ::-1][:, :k]
        v = basis @ w
        left = np.linalg.norm(images @ w - v * theta, axis=0)
        if basis.shape[1] >= n_genes or left.max() <= tolerance * max(theta[0], 1e-300):
            break
        for _ in range(2):  # twice is enough to stay orthogonal
            z = z - basis @ (basis.T @ z)
        q, r = np.linalg.qr(z)
        fresh = np.abs(np.diag(r)) > 1e-10 * max(theta[0], 1e-300)
        q = q[:, fresh][:, :n_genes - basis.shape[1]]
        if not q.shape[1]:
            break
    shift.destroy()
    v = v * np.where(v[np.abs(v).argmax(0), np.arange(v.shape[1])] < 0, -1.0, 1.0)  # the largest loading is positive
    return v, np.maximum(theta, 0)


def projected(rows: DataFrame, offsets: dict[str, np.ndarray], v: np.ndarray, id_col: str = "spot_id") -> DataFrame:
    """(spot_id, slice, emb): rows times loadings."""
    shared = rows.sparkSession.sparkContext.broadcast((v, {s: o @ v for s, o in offsets.items()}))

    def work(batches):
        v, base = shared.value
        for part, x in _parts(batches):
            y = _dot(x, v) + np.stack([base[s] for s in part.column("slice").to_pylist()])
            yield pa.record_batch([part.column(id_col), part.column("slice"), pa.array(list(y), pa.list_(pa.float64()))], [id_col, "slice", "emb"])

    return rows.select(id_col, "slice", "row").mapInArrow(work, f"{id_col} {rows.schema[id_col].dataType.simpleString()}, slice string, emb array<double>")


def gram_tiles(rows: DataFrame, n_genes: int, band: int = BAND, slots: int = SLOTS) -> DataFrame:
    """(i, j, dots): tiles i <= j of X'X, `band` genes on a side.

    A row goes to every band of genes that it has. A task adds one band against all genes, row batch by row batch, so what
    is shuffled is `slots` partial tiles each, however many spots there are."""
    cut = -(-n_genes // band)
    bands = F.array_distinct(F.transform("row", lambda e: F.floor(e["g"] / band).cast("int")))
    dealt = rows.select("row", F.explode(bands).alias("i"), F.pmod(F.xxhash64(*[c for c in rows.columns if c != "row"]), F.lit(slots)).alias("slot"))

    def add(batches):
        now, total = None, None

        def tiles():
            for j in range(now, cut):
                yield pa.record_batch([pa.array([now], pa.int32()), pa.array([j], pa.int32()), pa.array([total[:, j * band:(j + 1) * band].tobytes()], pa.binary())], ["i", "j", "dots"])

        for whole in batches:
            keys = whole.column("i").to_numpy()
            ends = np.r_[np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys)] if len(keys) else []
            for a, b in zip(np.r_[0, ends], ends):
                if keys[a] != now:
                    if now is not None:
                        yield from tiles()
                    now, total = int(keys[a]), np.zeros((band, cut * band))
                for _, x in _parts([whole.slice(a, b - a)]):
                    mine = np.zeros((x.n, band))
                    for c, d, m in x.slabs():
                        here = x.genes[c:d] // band == now
                        mine[:, x.genes[c:d][here] - now * band] = m[:, here]
                    for c, d, m in x.slabs():
                        total[:, x.genes[c:d]] += mine.T @ m
        if now is not None:
            yield from tiles()

    partial = spread(dealt, "i", "slot").sortWithinPartitions("i").mapInArrow(add, "i int, j int, dots binary")

    def merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return pa.table({"i": pa.array([key[0].as_py()], pa.int32()), "j": pa.array([key[1].as_py()], pa.int32()),
                         "dots": pa.array([sum(np.frombuffer(x.as_py()) for x in table["dots"]).tobytes()], pa.binary())})

    return partial.groupBy("i", "j").applyInArrow(merge, "i int, j int, dots binary")


def correlation_tiles(rows: DataFrame, n_genes: int, n: int, sums: np.ndarray, squares: np.ndarray, band: int = BAND) -> DataFrame:
    """(i, j, r): Pearson correlations over n spots, as whole millionths in tiles of 32-bit integers; NONE where a side is
    constant, and on the diagonal. `sums` and `squares` are per gene, a dictionary-sized table."""
    var = squares - sums * sums / n

    def work(batches):
        for batch in batches:
            out = []
            for i, j, dots in zip(*(c.to_pylist() for c in batch.columns)):
                at, to = np.arange(i * band, (i + 1) * band), np.arange(j * band, (j + 1) * band)
                pad = lambda x, k: np.where(k < n_genes, x[np.minimum(k, n_genes - 1)], 0.0)
                spread_ = np.maximum(pad(var, at)[:, None] * pad(var, to)[None, :], 0)
                with np.errstate(divide="ignore", invalid="ignore"):
                    r = (np.frombuffer(dots).reshape(band, band) - pad(sums, at)[:, None] * pad(sums, to)[None, :] / n) / np.sqrt(spread_)
                none = ~(spread_ > 1e-18) | (at[:, None] == to[None, :]) | (at[:, None] >= n_genes) | (to[None, :] >= n_genes)
                out.append(np.where(none, NONE, np.rint(np.where(none, 0, r) * 1e6)).astype("<i4").tobytes())
            yield pa.record_batch([batch.column("i"), batch.column("j"), pa.array(out, pa.binary())], ["i", "j", "r"])

    return cut_lineage(gram_tiles(rows, n_genes, band).mapInArrow(work, "i int, j int, r binary"))


NONE = np.iinfo(np.int32).max


def low_counts(tiles: DataFrame) -> DataFrame:
    """(r, c): how many ordered pairs have each negative correlation, and all others under r = 0."""
    def work(batches):
        for batch in batches:
            for i, j, data in zip(*(c.to_pylist() for c in batch.columns)):
                r = np.frombuffer(data, "<i4")
                r, twice = np.minimum(r[r != NONE], 0), 1 if i == j else 2
                value, count = np.unique(r, return_counts=True)
                yield pa.record_batch([pa.array(value, pa.int32()), pa.array(twice * count, pa.int64())], ["r", "c"])

    return tiles.mapInArrow(work, "r int, c long").groupBy("r").agg(F.sum("c").alias("c"))


def partners_below(tiles: DataFrame, cut: int, band: int = BAND) -> DataFrame:
    """(_p, hits): partners of each gene whose correlation is below `cut` millionths."""
    def work(batches):
        for batch in batches:
            for i, j, data in zip(*(c.to_pylist() for c in batch.columns)):
                below = np.frombuffer(data, "<i4").reshape(band, -1) < cut
                for k, axis in ((i, 1),) if i == j else ((i, 1), (j, 0)):
                    hits = below.sum(axis)
                    at = np.flatnonzero(hits)
                    yield pa.record_batch([pa.array((k * band + at).astype(np.int32)), pa.array(hits[at].astype(np.int64))], ["_p", "hits"])

    return tiles.mapInArrow(work, "_p int, hits long").groupBy("_p").agg(F.sum("hits").alias("hits"))
