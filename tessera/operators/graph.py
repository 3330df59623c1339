"""Nearest-neighbour joins, radius degrees, graph aggregation and components.

Coordinates: a tree of boxes cuts each slice, level by level at quantiles, into cells of a bounded number of
locations. Which cells can hold neighbours of which is decided between cells, by walking down the tree with their
boxes; points then meet only the points of those cells. The join is exact and its rows stay a small
multiple of the points. Vectors: see `vector_knn`.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.numeric import hash_order
from tessera.functions.ranks import exact_quantiles
from tessera.session import cut_lineage, spread

MAX_PIVOTS = 1024
FAN = 16  # ranges per axis and level: a node of the tree has at most FAN * FAN children


def _with_cuts(df: DataFrame, column: str, by: list[str], parts: Callable[[Column, Column], Column], name: str) -> DataFrame:
    """Add `name`: the range of `column` inside its group, from quantile cuts (at most FAN ranges).
    `parts` gives the number of ranges from the group's size and its width-to-height ratio."""
    probs = [i / FAN for i in range(1, FAN)]
    q = df.groupBy(*by).agg(F.percentile_approx(column, probs, 2000).alias("_q"), F.count("*").alias("_n"),
                              F.coalesce(F.try_divide(F.stddev_pop("x"), F.stddev_pop("y")), F.lit(1.0)).alias("_aspect"))
    k = F.least(F.greatest(parts(F.col("_n"), F.col("_aspect")), F.lit(1)), F.lit(FAN))
    picked = F.transform(F.sequence(F.lit(1), F.greatest(k - 1, F.lit(1))),
                         lambda i: F.element_at("_q", F.greatest((i * FAN / k).cast("int"), F.lit(1))))
    cuts = q.select(*by, F.when(k > 1, F.array_distinct(picked)).otherwise(F.array().cast("array<double>")).alias("_cuts"))
    return df.join(cuts, by).withColumn(name, F.size(F.filter("_cuts", lambda c: c < F.col(column)))).drop("_cuts")


def partition_tree(locations: DataFrame, by: Sequence[str], size: int) -> DataFrame:
    """(*by, x, y, _cell, _path): the leaf of every distinct location in a tree of boxes, and the nodes from the root to it.

    A node with more than 2 * size locations is cut into quantile strips on x and those into ranges on y, at most
    FAN * FAN children, and so on below, so leaves stay bounded and their number is in proportion to the locations.
    A level costs a few grouped passes over the locations that are still in full nodes; levels grow with the logarithm
    of the largest group."""
    by = list(by)
    node = [*by, "_cell"]
    open_ = locations.select(*by, "x", "y", F.lit(0).cast("long").alias("_cell"), F.array(F.lit(0).cast("long")).alias("_path"))
    leaves = None
    while True:
        cut = _with_cuts(open_, "x", node, lambda n, aspect: F.ceil(F.sqrt(n / size * aspect)).cast("int"), "_strip")
        cut = _with_cuts(cut, "y", [*node, "_strip"], lambda n, _: F.ceil(n / size).cast("int"), "_part")
        child = F.col("_cell") * (FAN * FAN + 1) + 1 + F.col("_strip") * FAN + F.col("_part")
        placed = cut_lineage(cut.withColumn("_cell", child).withColumn("_path", F.concat("_path", F.array("_cell"))).drop("_strip", "_part"))
        full = placed.groupBy(*node).agg(F.count("*").alias("_n")).filter(F.col("_n") > 2 * size).select(*node)
        full = cut_lineage(full)
        done = full.isEmpty()
        found = placed if done else placed.join(full, node, "left_anti")
        leaves = found if leaves is None else leaves.unionByName(found)
        if done:
            return leaves
        open_ = cut_lineage(placed.join(full, node, "left_semi"))


class CellIndex:
    """Leaves of about `size` locations inside each group, with their boxes and points, under a tree of boxes.

    `keep` points of each location (smallest ids) go into the cells: among points at one place no others
    can be neighbours of any query. Without it, locations are stored once with their multiplicity."""

    def __init__(self, points: DataFrame, by: Sequence[str], size: int, keep: int | None):
        by = list(by)
        self.by = by
        self.cell_key = [*by, "_cell"]
        points = points.select(*by, "spot_id", "x", "y")
        tree = partition_tree(points.select(*by, "x", "y").distinct(), by, size)
        # the search below costs compute and not bytes, so its partition number is set and not coalesced
        self.placed = cut_lineage(spread(points.join(tree, [*by, "x", "y"]), *self.cell_key))
        if keep is not None:
            # row_number <= keep is limited per input partition before its shuffle, so a hot location stays small
            w = Window.partitionBy(*self.cell_key, "x", "y").orderBy("spot_id")
            located = self.placed.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= keep).drop("_rn")
            located = located.withColumn("mult", F.lit(1).cast("bigint"))
        else:
            located = self.placed.groupBy(*self.cell_key, "_path", "x", "y").agg(F.count("*").alias("mult")).withColumn(
                "spot_id", F.lit(None).cast("string"))
        self.placed = self.placed.drop("_path")
        # one row per cell of at most 2 * size locations
        self.cells = cut_lineage(located.groupBy(*self.cell_key, "_path").agg(
            F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"),
            F.sum("mult").alias("n"), F.collect_list(F.struct("spot_id", "x", "y", "mult")).alias("_pts")))
        # every node below the root once, with its parent and the box and count of all below it
        steps = self.cells.select(*by, "x0", "x1", "y0", "y1", "n", F.size("_path").alias("_depth"), F.posexplode("_path").alias("_at", "_parent"), "_path").filter(
            "_at + 1 < _depth").withColumn("_child", F.get("_path", F.col("_at") + 1))
        nodes = steps.groupBy(*by, "_parent", "_child").agg(
            F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.sum("n").alias("n"),
            F.bool_or(F.col("_at") + 2 == F.col("_depth")).alias("leaf"))
        # at most FAN * FAN boxes per node
        self.children = cut_lineage(nodes.groupBy(*by, "_parent").agg(F.collect_list(F.struct("_child", "x0", "x1", "y0", "y1", "n", "leaf")).alias("_boxes")))
        self.levels = (self.cells.agg(F.max(F.size("_path"))).first()[0] or 1) - 1

    def with_siblings(self) -> DataFrame:
        """Cells with the boxes `_boxes` of all children of their parent."""
        parent = F.element_at("_path", -2)
        return self.cells.withColumn("_parent", parent).join(self.children, [*self.by, "_parent"]).drop("_parent")

    def reach(self, cells: DataFrame) -> DataFrame:
        """Cell x cell rows whose boxes are within `_bound`, a squared distance that each row of `cells` has:
        (*cell_key, _bound, box _b, points _pts) with the points of the other cell. Boxes are met from the root of
        the tree down, one level per join, and only children of nodes within the bound are looked at."""
        c = cells.select(*self.cell_key, "x0", "x1", "y0", "y1", "_bound", F.lit(0).cast("long").alias("_parent"))
        found = None
        for level in range(self.levels):
            met = c.join(self.children, [*self.by, "_parent"]).withColumn(
                "_b", F.explode(F.filter("_boxes", lambda b: _near(b) <= F.col("_bound")))).drop("_boxes", "_parent")
            hit = met.filter("_b.leaf").select(*self.cell_key, "_bound", "_b", F.col("_b._child").alias("_oc"))
            found = hit if found is None else found.unionByName(hit)
            if level + 1 < self.levels:
                c = cut_lineage(met.filter("not _b.leaf").withColumn("_parent", F.col("_b._child")).drop("_b"))
        other = self.cells.select(*self.by, F.col("_cell").alias("_oc"), "_pts")
        if found is None:
            found = c.select(*self.cell_key, "_bound", F.lit(0).cast("long").alias("_oc")).withColumn("_b", F.lit(None)).limit(0)
        return found.join(other, [*self.by, "_oc"]).drop("_oc")


def _near(box: Column) -> Column:
    """Squared distance between the box of the row and another box."""
    dx = F.greatest(box["x0"] - F.col("x1"), F.col("x0") - box["x1"], F.lit(0.0))
    dy = F.greatest(box["y0"] - F.col("y1"), F.col("y0") - box["y1"], F.lit(0.0))
    return dx * dx + dy * dy


def _far(box: Column) -> Column:
    """Squared distance no two points of the two boxes exceed."""
    dx = F.greatest(box["x1"], F.col("x1")) - F.least(box["x0"], F.col("x0"))
    dy = F.greatest(box["y1"], F.col("y1")) - F.least(box["y0"], F.col("y0"))
    return dx * dx + dy * dy


def _gap2(box: Column) -> Column:
    """Squared distance from a point (x, y) to a box."""
    dx = F.greatest(box["x0"] - F.col("x"), F.col("x") - box["x1"], F.lit(0.0))
    dy = F.greatest(box["y0"] - F.col("y"), F.col("y") - box["y1"], F.lit(0.0))
    return dx * dx + dy * dy


def knn_join(spots: DataFrame, k: int, by: Sequence[str] = ("slice",)) -> DataFrame:
    """Exact k nearest spots inside each group by (squared distance, id), self excluded:
    edges(*by, src, dst, dist2, rank).

    The k neighbours of a point lie within the diagonal of its cell when the cell holds k others, else
    within the sibling cells that together hold enough points (a parent that was cut holds more)."""
    by = list(by)
    index = CellIndex(spots, by, max(16, 2 * (k + 1)), k + 1)
    acc = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("d"))
    wide = F.aggregate(
        F.sort_array(F.transform("_boxes", lambda s: F.struct(_far(s).alias("d"), s["n"].alias("n")))), acc,
        lambda a, s: F.when(a["n"] >= k + 1, a).otherwise(F.struct((a["n"] + s["n"]).alias("n"), s["d"].alias("d"))))["d"]
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    bound = F.when(F.col("n") >= k + 1, w * w + h * h).otherwise(wide)
    cells = index.with_siblings().withColumn("_bound", bound)
    q = index.placed.withColumnRenamed("spot_id", "src")
    met = q.join(index.reach(cells), index.cell_key).filter(_gap2(F.col("_b")) <= F.col("_bound"))
    e = met.select(*by, "src", "x", "y", "_bound", F.explode("_pts").alias("_p"))
    dx, dy = F.col("_p.x") - F.col("x"), F.col("_p.y") - F.col("y")
    e = e.select(*by, "src", F.col("_p.spot_id").alias("dst"), (dx * dx + dy * dy).alias("dist2"), "_bound")
    near = e.filter((F.col("dist2") <= F.col("_bound")) & (F.col("dst") != F.col("src"))).drop("_bound")
    win = Window.partitionBy(*by, "src").orderBy("dist2", "dst")
    # the graph is read many times by its users, so it is stored once
    return cut_lineage(near.withColumn("rank", F.row_number().over(win)).filter(F.col("rank") <= k))


def radius_degree(spots: DataFrame, radius: float, by: Sequence[str] = ("slice",)) -> DataFrame:
    """Spots within `radius` of each spot, self excluded. Cells that lie inside the disc count as a whole;
    only cells on its edge are looked into, so dense regions cost boxes and not pairs."""
    by = list(by)
    index = CellIndex(spots, by, 32, None)
    r2 = F.lit(float(radius * radius))
    near = index.placed.join(index.reach(index.cells.withColumn("_bound", r2)), index.cell_key).filter(_gap2(F.col("_b")) <= r2)
    dx = F.greatest(F.abs(F.col("x") - F.col("_b.x0")), F.abs(F.col("x") - F.col("_b.x1")))
    dy = F.greatest(F.abs(F.col("y") - F.col("_b.y0")), F.abs(F.col("y") - F.col("_b.y1")))
    full = dx * dx + dy * dy <= r2
    # a cell inside the disc is one pseudo-point with the cell's count, at distance 0
    whole = F.array(F.struct(F.lit(None).cast("string").alias("spot_id"), F.col("x"), F.col("y"), F.col("_b.n").alias("mult")))
    p = near.select(*by, "spot_id", "x", "y", F.explode(F.when(full, whole).otherwise(F.col("_pts"))).alias("_p"))
    px, py = F.col("_p.x") - F.col("x"), F.col("_p.y") - F.col("y")
    return p.groupBy(*by, "spot_id").agg((F.sum(F.when(px * px + py * py <= r2, F.col("_p.mult")).otherwise(0)) - 1).alias("degree"))


def symmetrize(edges: DataFrame, by: Sequence[str] = ("slice",)) -> DataFrame:
    """Both directions of every edge once, without self loops."""
    pairs = undirected(edges, by)
    return pairs.unionByName(pairs.select(*by, F.col("dst").alias("src"), F.col("src").alias("dst")))


def undirected(edges: DataFrame, by: Sequence[str] = ("slice",)) -> DataFrame:
    return edges.filter("src <> dst").select(
        *by, F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def slice_graph(spots: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Directed and symmetric graphs; no edge leaves its slice because the slice is in every join key."""
    directed = knn_join(spots, k)
    return directed, symmetrize(directed)


def knn_distance_summary(spots: DataFrame, ranks: Sequence[int] = (1, 3, 8)) -> DataFrame:
    edges = knn_join(spots, max(ranks)).filter(F.col("rank").isin(list(ranks))).withColumn("dist", F.sqrt("dist2"))
    long = exact_quantiles(edges, "dist", ["slice", "rank"], {"median": 0.5})
    return long.groupBy("slice").pivot("rank", list(ranks)).agg(F.max("median")).select(
        "slice", *[F.col(str(r)).alias(f"nn{r}_median") for r in ranks])


def edge_length_summary(edges: DataFrame) -> DataFrame:
    """Unique undirected edges per slice: count, median, 95 % and maximum length."""
    unique = edges.groupBy("slice", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(
        F.sqrt(F.min("dist2")).alias("length"))
    q = exact_quantiles(unique, "length", ["slice"], {"median_length": 0.5, "p95_length": 0.95})
    return unique.groupBy("slice").agg(F.count("*").alias("n_edges"), F.max("length").alias("max_length")).join(q, "slice")


# ---- vectors -----------------------------------------------------------------

def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances by direct differences: equal pairs give equal values in every block."""
    out = np.empty((len(a), len(b)))
    step = max(1, 65_536 // max(1, b.size))
    for i in range(0, len(a), step):
        diff = a[i:i + step, None, :] - b[None, :, :]
        out[i:i + step] = np.einsum("ijk,ijk->ij", diff, diff)
    return out


def block_rows(dim: int) -> int:
    """Most vectors of one block: 32 MB of doubles."""
    return max(1024, min(131_072, 2 ** 22 // max(1, dim)))


def vectors(column: pa.ChunkedArray) -> np.ndarray:
    """The rows of an array<double> column as a matrix."""
    lists = column.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _nearest(a: np.ndarray, b: np.ndarray, k: int, rows: int = 512, columns: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in a, place in b, squared distance) of the k nearest rows of `b` for every row of `a`, by (distance, place).

    A product in single precision, with a bound of its rounding error, leaves out rows that cannot be among the k; the
    others are compared by direct differences, so the result does not depend on the product."""
    dim = a.shape[1]
    center = b.mean(0)
    scale = max(np.abs(a - center).max(), np.abs(b - center).max()) or 1.0
    x, y = ((m - center) / scale for m in (a, b))
    nx, ny = (np.sqrt((m * m).sum(1)) for m in (x, y))
    # rows of (-2 x, 1) times (y, y.y): the squared distance less x.x, the same constant for all of a row
    left = np.hstack([-2 * x, np.ones((len(x), 1))]).astype(np.float32)
    right = np.hstack([y, (ny * ny)[:, None]]).astype(np.float32).T.copy()
    slack = 4 * (dim + 8) * np.finfo(np.float32).eps * (nx + ny.max()) ** 2
    out = []
    for i in range(0, len(a), rows):
        part = left[i:i + rows]
        first = part @ right[:, :max(columns, 4 * k)]
        limit = np.partition(first, k - 1, axis=1)[:, k - 1] + slack[i:i + rows] if first.shape[1] >= k else np.full(len(part), np.inf)
        limit = limit.astype(np.float32)[:, None]
        found = []
        for j in range(0, len(b), columns):
            at = np.flatnonzero(part @ right[:, j:j + columns] <= limit)
            width = min(columns, len(b) - j)
            found.append((at // width + i, at % width + j))
        qi, ci = (np.concatenate(v) for v in zip(*found))
        d = np.empty(len(qi))
        for at in range(0, len(qi), 4096):
            diff = a[qi[at:at + 4096]] - b[ci[at:at + 4096]]
            d[at:at + 4096] = np.einsum("ij,ij->i", diff, diff)
        order = np.lexsort((ci, d, qi))
        qi, ci, d = qi[order], ci[order], d[order]
        start = np.flatnonzero(np.r_[True, qi[1:] != qi[:-1]])
        keep = np.arange(len(qi)) - np.repeat(start, np.diff(np.r_[start, len(qi)])) < k
        out.append((qi[keep], ci[keep], d[keep]))
    return tuple(np.concatenate(v) for v in zip(*out))


def vector_knn(candidates: DataFrame, k: int, queries: DataFrame | None = None, by: Sequence[str] = (),
               exclude_self: bool = True, pivots: int = 16, block: int | None = None) -> DataFrame:
    """Exact k nearest vectors by (squared distance, id): (*by, src, dst, dist2, rank).

    Equal vectors of a group are searched once and stand as candidates with their smallest ids. Vectors are assigned to their nearest
    pivot (a hash sample) and large pivot cells are cut into blocks by hash. Between blocks the triangle inequality decides which can
    hold neighbours of which. A task holds one block of queries and one of candidates and returns one row per query, so pairs are
    never rows, and a vector is sent as often as there are blocks: `pivots` and one per `block` vectors, at most."""
    by = list(by)
    need = k + 1 if exclude_self else k
    known = F.expr("forall(emb, v -> v = v and abs(v) <= 1.7976931348623157e308D)")  # others are at no distance
    # fresh names and ids: candidates and queries may be the same DataFrame
    points = candidates.select(*[F.col(c).alias(c) for c in by], F.col("spot_id").alias("dst"), F.col("emb").cast("array<double>").alias("emb")).filter(known)
    query = (candidates if queries is None else queries).select(*by, F.col("spot_id").alias("src"), F.col("emb").cast("array<double>").alias("emb")).filter(known)
    # at most `pivots` vectors reach the driver
    chosen = [r["emb"] for r in candidates.select("emb", hash_order(7, "spot_id").alias("_h")).filter(known).orderBy("_h").limit(pivots).collect()]
    id_type = candidates.schema["spot_id"].dataType.simpleString()
    if not chosen:
        return query.select(*by, "src", F.col("src").alias("dst"), F.lit(0.0).alias("dist2"), F.lit(1).alias("rank")).limit(0)
    p = np.array(chosen, dtype=float)
    size = block or block_rows(p.shape[1])

    @F.pandas_udf("struct<cell: int, far: double>")
    def to_pivot(emb: pd.Series) -> pd.DataFrame:
        d = _distances(np.stack(emb.to_numpy()), p)
        return pd.DataFrame({"cell": d.argmin(1).astype(np.int32), "far": np.sqrt(d.min(1))})

    def blocks(df: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """Rows with their cell and block, and one row per cell and group."""
        df = df.withColumn("_p", to_pivot("emb")).select(*df.columns, F.col("_p.cell").alias(f"_{name}"), F.col("_p.far").alias("_far"))
        df = cut_lineage(df)
        cells = cut_lineage(df.groupBy(*by, f"_{name}").agg(F.count("*").alias(f"_{name}n"), F.max("_far").alias(f"_{name}far")))
        part = F.pmod(F.xxhash64("emb", df.columns[len(by)]), F.floor((F.col(f"_{name}n") - 1) / size) + 1)
        return df.join(cells.drop(f"_{name}far"), [*by, f"_{name}"]).withColumn(f"_{name}b", part.cast("int")).drop("_far", f"_{name}n"), cells

    # row_number <= need is limited per input partition before its shuffle, so many equal vectors stay small
    same = Window.partitionBy(*by, "emb")
    targets, held = blocks(points.withColumn("_rn", F.row_number().over(same.orderBy("dst"))).filter(F.col("_rn") <= need).drop("_rn"), "c")
    searched, asked = blocks(query.groupBy(*by, "emb").agg(F.min("src").alias("one")).select(*by, "one", "emb"), "q")
    members = query.join(searched.select(*by, "one", "emb"), [*by, "emb"]).select(*by, "src", "one") if by else \
        query.join(searched.select("one", "emb"), "emb").select("src", "one")
    # cells against cells: at most `pivots` squared rows of a group
    met = asked.join(held, by) if by else asked.crossJoin(held)
    between = F.lit([[float(v) for v in row] for row in np.sqrt(_distances(p, p))])
    met = met.withColumn("_d", F.get(F.get(between, F.col("_q")), F.col("_c")))
    before = Window.partitionBy(*by, "_q").orderBy("_reach", "_c").rowsBetween(Window.unboundedPreceding, 0)
    met = met.withColumn("_reach", F.col("_d") + F.col("_qfar") + F.col("_cfar")).withColumn("_sum", F.sum("_cn").over(before))
    bound = F.coalesce(F.min(F.when(F.col("_sum") >= need, F.col("_reach"))).over(Window.partitionBy(*by, "_q")), F.lit(float("inf")))
    near = met.withColumn("_bound", bound).filter("_d - _qfar - _cfar <= _bound * (1 + 1e-9) + 1e-9")
    n_blocks = [F.sequence(F.lit(0), F.floor((F.col(f"_{x}n") - 1) / size).cast("int")) for x in "qc"]
    visits = cut_lineage(near.withColumn("_qb", F.explode(n_blocks[0])).withColumn("_cb", F.explode(n_blocks[1])).select(*by, "_q", "_qb", "_c", "_cb"))
    unit = [*by, "_q", "_qb", "_c", "_cb"]
    by_type = "".join(f"{c} {candidates.schema[c].dataType.simpleString()}, " for c in by)
    schema = f"{by_type}one {id_type}, dist array<double>, dst array<{id_type}>"

    def work(qs: pa.Table, cs: pa.Table) -> pa.Table:
        if not qs.num_rows or not cs.num_rows:
            return empty(qs)
        cs = cs.take(pc.sort_indices(cs["dst"]))  # ids ascend, so equal distances keep id order
        qi, ci, d = _nearest(vectors(qs["emb"]), vectors(cs["emb"]), need)
        ok = np.isfinite(d)
        qi, ci, d = qi[ok], ci[ok], d[ok]
        ends = pa.array(np.r_[0, np.cumsum(np.bincount(qi, minlength=qs.num_rows))].astype(np.int32))
        ids = cs["dst"].combine_chunks().take(pa.array(ci))
        return pa.table({**{c: qs[c] for c in by}, "one": qs["one"], "dist": pa.ListArray.from_arrays(ends, pa.array(d)), "dst": pa.ListArray.from_arrays(ends, ids)})

    def empty(qs: pa.Table) -> pa.Table:
        one = qs.schema.field("one").type
        return pa.table({**{c: pa.array([], qs.schema.field(c).type) for c in by}, "one": pa.array([], one),
                         "dist": pa.array([], pa.list_(pa.float64())), "dst": pa.array([], pa.list_(one))})

    listed = F.broadcast(visits) if visits.count() <= 100_000 else visits
    left = spread(searched.join(listed, [*by, "_q", "_qb"]), *unit)
    right = spread(targets.join(listed, [*by, "_c", "_cb"]), *unit)
    found = left.groupBy(*unit).cogroup(right.groupBy(*unit)).applyInArrow(work, schema)
    lists = found.groupBy(*by, "one").agg(F.flatten(F.collect_list(F.arrays_zip("dist", "dst"))).alias("_near"))
    lists = lists.withColumn("_near", F.slice(F.sort_array("_near"), 1, need))
    out = members.join(lists, [*by, "one"])
    if exclude_self:
        out = out.withColumn("_near", F.slice(F.filter("_near", lambda v: v["dst"] != F.col("src")), 1, k))
    out = out.select(*by, "src", F.posexplode("_near").alias("_at", "_v"))
    return cut_lineage(out.select(*by, "src", F.col("_v.dst").alias("dst"), F.col("_v.dist").alias("dist2"), (F.col("_at") + 1).alias("rank")))


def metric_knn(emb: DataFrame, k: int, skip_first: bool = True) -> DataFrame:
    """Neighbours used by the embedding metrics. The reference drops the first column of a neighbour list
    that already excludes the point itself, so ranks 2..k+1 are kept (all that exist if there are fewer)."""
    if not skip_first:
        return vector_knn(emb, k)
    edges = vector_knn(emb, max(2, k + 1))
    return edges.filter("rank > 1").withColumn("rank", F.col("rank") - 1)


def aggregate_neighbours(emb: DataFrame, edges: DataFrame, layers: int) -> DataFrame:
    """Own vector followed by the mean vector of the spots at graph distance 1..layers.
    `edges` is symmetric; a spot without neighbours at a distance gets zeros there."""
    reached = emb.select(F.col("spot_id").alias("src"), F.col("spot_id").alias("dst"))
    frontier = reached
    step = edges.select(F.col("src").alias("dst"), F.col("dst").alias("_next"))
    out = emb.select("spot_id", "slice", "emb", F.col("emb").alias("features"))
    for _ in range(layers):
        grown = frontier.join(step, "dst").select("src", F.col("_next").alias("dst")).distinct()
        frontier = cut_lineage(grown.join(reached, ["src", "dst"], "left_anti"))
        reached = reached.unionByName(frontier)
        values = frontier.join(emb.select(F.col("spot_id").alias("dst"), F.posexplode("emb").alias("pos", "v")), "dst")
        means = values.groupBy("src", "pos").agg(F.avg("v").alias("m")).groupBy("src").agg(
            F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda e: e["m"]).alias("_m"))
        out = out.join(means.withColumnRenamed("src", "spot_id"), "spot_id", "left").withColumn(
            "features", F.concat("features", F.coalesce("_m", F.transform("emb", lambda v: F.lit(0.0))))).drop("_m")
    return out.drop("emb")


def connected_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component): smallest id of each component by alternating large-star and small-star rounds.
    The rounds double path lengths, so their number grows with the logarithm of the longest path; they go on until nothing changes."""
    e = cut_lineage(edges.select("src", "dst").filter("src <> dst").select(
        F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    while True:
        # large star: all larger neighbours (and the node) point to the smallest neighbour
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        # small star: smaller neighbours of a node point to its smallest one
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        small = cut_lineage(small)
        changed = not (small.exceptAll(e).isEmpty() and e.exceptAll(small).isEmpty())
        e = small
        if not changed:
            break
    roots = e.groupBy("u").agg(F.min("v").alias("component"))
    return nodes.select("node").join(roots, F.col("node") == F.col("u"), "left").select(
        "node", F.coalesce("component", "node").alias("component"))


def mnn_pairs(emb: DataFrame, k: int, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Mutual nearest neighbours between declared slice pairs. The pair is a key of the neighbour join, so all pairs are
    searched in one plan, once in each direction."""
    declared = emb.sparkSession.createDataFrame([(f"{i}", a, b) for i, (a, b) in enumerate(dict.fromkeys(pairs))], "pair string, left string, right string")
    sides = [emb.join(declared.select("pair", F.col(c).alias("slice")), "slice").select("pair", "spot_id", "emb") for c in ("left", "right")]
    ab = vector_knn(sides[1], k, queries=sides[0], by=["pair"], exclude_self=False).select("pair", "src", "dst", "dist2")
    ba = vector_knn(sides[0], k, queries=sides[1], by=["pair"], exclude_self=False).select("pair", F.col("src").alias("dst"), F.col("dst").alias("src"))
    return ab.join(ba, ["pair", "src", "dst"]).join(declared, "pair").select("left", "right", "src", "dst", "dist2")


def mnn_correct(emb: DataFrame, k: int, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Shift each right slice by the mean difference of its matched pairs to the left slice."""
    matched = mnn_pairs(emb, k, pairs)
    vec = emb.select("spot_id", F.posexplode("emb").alias("pos", "v"))
    diff = matched.join(vec.select(F.col("spot_id").alias("src"), "pos", F.col("v").alias("a")), "src").join(
        vec.select(F.col("spot_id").alias("dst"), "pos", F.col("v").alias("b")), ["dst", "pos"])
    shift = diff.groupBy(F.col("right").alias("slice"), "pos").agg(F.avg(F.col("a") - F.col("b")).alias("d")).groupBy("slice").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "d"))), lambda e: e["d"]).alias("_shift"))
    return emb.join(shift, "slice", "left").withColumn(
        "emb", F.when(F.col("_shift").isNull(), F.col("emb")).otherwise(F.zip_with("emb", "_shift", lambda a, b: a + b))).drop("_shift")
