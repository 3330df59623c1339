"""Sums of distances of points in a plane to clusters, in n log n time.

Points are dealt to the leaves of a tree of boxes (a k-d tree over a hash sample; the sample decides where boxes are cut, never what is
summed). The distance to the points of a box is a smooth function wherever the box is far, so there the points of each cluster stand for it as
weights on NODES x NODES Chebyshev nodes of the box; points of near boxes are compared one by one. The relative error of a sum is below 1e-10,
as the nodes are used from three half diagonals of the box on, where each more node divides it by about six."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.graph import vectors
from tessera.session import cut_lineage, spread

NODES = 14
APART = 3.0  # half diagonals between the middle of a box and points that use its nodes
LEAST = 40_000  # fewer points are compared pair by pair
LEAF = 1024
MOST_DEPTH = 12
UNIT = 4  # levels above the leaves whose boxes are one task unit
_T = np.cos((2 * np.arange(NODES) + 1) * np.pi / (2 * NODES))


def _plane(column: pa.ChunkedArray) -> np.ndarray:
    m = vectors(column)
    return m if m.shape[1] == 2 else np.column_stack([m[:, 0], np.zeros(len(m))])


def _shares(t: np.ndarray) -> np.ndarray:
    """(points, NODES): how places in [-1, 1] share in the nodes."""
    m = np.arange(1, NODES)
    return 1 / NODES + 2 / NODES * np.cos(np.arccos(np.clip(t, -1, 1))[:, None] * m) @ np.cos(np.arccos(_T)[:, None] * m).T


def _scaled(x: np.ndarray, half: float) -> np.ndarray:
    return x / half if half > 0 else x


@dataclass(frozen=True)
class Tree:
    """Cuts of inner boxes in heap order: the children of box i are 2i + 1 and 2i + 2."""
    depth: int
    axis: np.ndarray
    cut: np.ndarray

    def leaves(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            at = 2 * at + 1 + (x[np.arange(len(x)), self.axis[at]] >= self.cut[at])
        return at - (2 ** self.depth - 1)


def tree_of(sample: np.ndarray, depth: int) -> Tree:
    inner = 2 ** depth - 1
    axis, cut, parts = np.zeros(inner, np.int64), np.zeros(inner), [sample]
    for i in range(inner):
        x = parts[i]
        if len(x):
            axis[i] = int(np.argmax(np.ptp(x, axis=0)))
            cut[i] = np.median(x[:, axis[i]])
        right = x[:, axis[i]] >= cut[i]
        parts += [x[~right], x[right]]
        parts[i] = None
    return Tree(depth, axis, cut)


@dataclass(frozen=True)
class Boxes:
    """All boxes in heap order; `weight` is (boxes, NODES * NODES, clusters), and an empty box has a low above its high."""
    low: np.ndarray
    high: np.ndarray
    weight: np.ndarray

    def middle(self, i: int) -> np.ndarray:
        return (self.low[i] + self.high[i]) / 2

    def half(self, i: int) -> np.ndarray:
        return (self.high[i] - self.low[i]) / 2

    def nodes(self, i: int) -> np.ndarray:
        """Places of the nodes, from the middle: added to it they would lose digits where coordinates are large."""
        return np.column_stack([x.ravel() for x in np.meshgrid(*(h * _T for h in self.half(i)), indexing="ij")])

    def met(self, leaf: int) -> tuple[list[int], list[int]]:
        """(boxes far from a leaf, leaves near it): together they hold every point once."""
        first, far, near, todo = len(self.low) // 2, [], [], [0]
        low, high = self.low[first + leaf], self.high[first + leaf]
        while todo:
            i = todo.pop()
            if self.low[i, 0] > self.high[i, 0]:
                continue
            mid = self.middle(i)
            if np.linalg.norm(np.maximum(np.maximum(low - mid, mid - high), 0)) > APART * np.linalg.norm(self.half(i)):
                far.append(i)
            elif i >= first:
                near.append(i - first)
            else:
                todo += [2 * i + 1, 2 * i + 2]
        return far, near


def boxes_of(leaves: int, rows: list, clusters: int) -> Boxes:
    """Boxes and weights of the leaves' parents from those of the leaves: (leaf, low, high, weight)."""
    total, first = 2 * leaves - 1, leaves - 1
    low, high, weight = np.full((total, 2), np.inf), np.full((total, 2), -np.inf), np.zeros((total, NODES * NODES, clusters))
    for r in rows:
        low[first + r["leaf"]], high[first + r["leaf"]] = np.frombuffer(r["low"]), np.frombuffer(r["high"])
        weight[first + r["leaf"]] = np.frombuffer(r["weight"]).reshape(-1, clusters)
    boxes = Boxes(low, high, weight)
    for i in range(first - 1, -1, -1):
        low[i], high[i] = low[2 * i + 1:2 * i + 3].min(0), high[2 * i + 1:2 * i + 3].max(0)
        for j in (2 * i + 1, 2 * i + 2):
            if low[j, 0] <= high[j, 0]:
                away, half, whole = boxes.middle(j) - boxes.middle(i), boxes.half(j), boxes.half(i)
                to = [_shares(_scaled(away[d] + half[d] * _T, whole[d])) for d in range(2)]
                w = weight[j].reshape(NODES, NODES, clusters)
                weight[i] += np.einsum("ap,bq,abk->pqk", *to, w, optimize=True).reshape(-1, clusters)
    return boxes


def sums_to(x: np.ndarray, to: np.ndarray, weight: np.ndarray, rows: int = 128, columns: int = 1024) -> np.ndarray:
    """(points, clusters): weighted distances from `x` to the places `to`, by differences."""
    out = np.zeros((len(x), weight.shape[1]))
    for j in range(0, len(to), columns):
        a, b, w = to[j:j + columns, 0].copy(), to[j:j + columns, 1].copy(), weight[j:j + columns]
        for i in range(0, len(x), rows):
            d = x[i:i + rows, :1] - a
            d *= d
            e = x[i:i + rows, 1:] - b
            e *= e
            d += e
            np.sqrt(d, out=d)
            out[i:i + rows] += d @ w
    return out


def plane_sums(points: DataFrame, keys: list[str], least: int = LEAST, leaf: int = LEAF) -> DataFrame | None:
    """(keys, one, c, k, total) of the (keys, c, emb, one, w) of one group: the weighted sum of the distances of each point to the points of
    each cluster. None where it does not pay: few points, more than two dimensions, more clusters than fit the weights of all boxes."""
    size = points.agg(F.count("*"), F.min(F.size("emb")), F.max(F.size("emb")), F.count_if(F.col("emb").isNull() | F.exists("emb", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) > 1e150)))).first()
    if size[0] < least or size[1] < 1 or size[2] > 2 or size[1] != size[2] or size[3]:
        return None
    names = [r["c"] for r in points.select("c").distinct().limit(65).collect()]
    if len(names) > 64:
        return None
    names.sort()
    depth = min(MOST_DEPTH, max(UNIT, int(np.ceil(np.log2(size[0] / leaf)))))
    while depth > UNIT and 2 ** depth * NODES * NODES * len(names) > 2 ** 22:
        depth -= 1
    few = points.filter(F.pmod(F.xxhash64("one", "c"), F.lit(max(1, size[0] // 2 ** 18))) == 0).select("emb").toArrow()
    tree = tree_of(_plane(few["emb"]), depth)
    code = {c: i for i, c in enumerate(names)}
    kinds = ", ".join(f"{c} {points.schema[c].dataType.simpleString()}" for c in [*keys, "one", "c"])

    def place(batches):
        for b in batches:
            yield b.append_column("leaf", pa.array(tree.leaves(_plane(pa.chunked_array([b["emb"]]))).astype(np.int32)))

    columns = [*keys, "one", "c", "w", "emb"]
    placed = cut_lineage(points.select(*columns).mapInArrow(place, f"{kinds}, w long, emb array<double>, leaf int"))

    def weighted(t: pa.Table) -> np.ndarray:
        """(points, clusters): the weight of a point in its own cluster."""
        out = np.zeros((t.num_rows, len(names)))
        own = t["c"].combine_chunks().dictionary_encode()
        out[np.arange(t.num_rows), np.array([code[c] for c in own.dictionary.to_pylist()], np.int64)[own.indices.to_numpy()]] = t["w"].to_numpy()
        return out

    def weigh(key, t):
        x, w = _plane(t["emb"]), weighted(t)
        low, high = x.min(0), x.max(0)
        mid, half = (low + high) / 2, (high - low) / 2
        a, b = (_shares(_scaled(x[:, d] - mid[d], half[d])) for d in range(2))
        total = np.stack([(a[at] * w[at, k][:, None]).T @ b[at] for k in range(len(names)) for at in [np.flatnonzero(w[:, k])]], axis=2)
        return pa.table({"leaf": [key[0].as_py()], "low": [low.tobytes()], "high": [high.tobytes()], "weight": [total.tobytes()]},
                        pa.schema([("leaf", pa.int32()), ("low", pa.binary()), ("high", pa.binary()), ("weight", pa.binary())]))

    # one row a leaf, at most 2^22 weights
    found = spread(placed, "leaf").groupBy("leaf").applyInArrow(weigh, "leaf int, low binary, high binary, weight binary").collect()
    boxes = boxes_of(2 ** depth, found, len(names))
    wanted: dict[int, set[int]] = {}
    for r in found:
        for s in boxes.met(r["leaf"])[1]:
            wanted.setdefault(s, set()).add(r["leaf"] >> UNIT)
    units = {s: np.array(sorted(u), np.int32) for s, u in wanted.items()}

    def deal(batches):
        for b in batches:
            at = b["leaf"].to_numpy()
            for s in np.unique(at):
                rows = np.flatnonzero(at == s)
                to = units[int(s)]
                t = b.select(["c", "w", "emb", "leaf"]).take(pa.array(np.tile(rows, len(to))))
                yield t.append_column("unit", pa.array(np.repeat(to, len(rows))))

    def work(_, a: pa.Table, b: pa.Table) -> pa.Table:
        out = []
        have, to, w = b["leaf"].to_numpy(), _plane(b["emb"]) if b.num_rows else np.zeros((0, 2)), weighted(b)
        order = np.argsort(have, kind="stable")
        have, to, w = have[order], to[order], w[order]
        of = a["leaf"].to_numpy()
        for leaf in np.unique(of):
            mine = a.filter(pa.array(of == leaf))
            x = _plane(mine["emb"])
            far, near = boxes.met(int(leaf))
            total = np.zeros((len(x), len(names)))
            for i in far:
                total += sums_to(x - boxes.middle(i), boxes.nodes(i), boxes.weight[i])
            for s in near:
                i, j = np.searchsorted(have, [s, s + 1])
                total += sums_to(x, to[i:j], w[i:j])
            each = pa.array(np.repeat(np.arange(len(x)), len(names)))
            out.append(pa.table({**{c: mine[c].combine_chunks().take(each) for c in [*keys, "one", "c"]},
                                 "k": pa.array(names * len(x), pa.string()), "total": pa.array(total.ravel())}))
        if not out:
            return pa.schema([*[a.schema.field(c) for c in [*keys, "one", "c"]], ("k", pa.string()), ("total", pa.float64())]).empty_table()
        return pa.concat_tables(out)

    left = placed.withColumn("unit", F.shiftright("leaf", UNIT))
    right = placed.mapInArrow(deal, "c string, w long, emb array<double>, leaf int, unit int")
    return spread(left, "unit").groupBy("unit").cogroup(spread(right, "unit").groupBy("unit")).applyInArrow(work, f"{kinds}, k string, total double")
