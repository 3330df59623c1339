"""Graph sums over packed blocks: spots that lie together are one task, with the rows of their neighbours.

A spot's non-zero entries are packed into one row. Every block of spots receives its own rows and those that its edges
reach (its halo), so a row travels once per block that needs it and not once per edge, and entries meet inside numpy
arrays. What leaves a block is one partial row per gene, summed before the only further shuffle."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.graph import partition_tree
from tessera.session import cut_lineage, spread

BLOCK_SPOTS = 256
GENES_AT_ONCE = 256


def spot_blocks(spots: DataFrame, size: int = BLOCK_SPOTS) -> DataFrame:
    """(slice, spot_id, block): leaves of the partition tree; a leaf whose locations hold many spots is cut further by hash."""
    tree = partition_tree(spots.select("slice", "x", "y").distinct(), ["slice"], size)
    placed = spots.select("slice", "spot_id", "x", "y").join(tree, ["slice", "x", "y"])
    load = placed.groupBy("slice", "_cell").agg((F.floor((F.count("*") - 1) / (4 * size)) + 1).alias("_parts"))
    block = F.xxhash64("slice", "_cell", F.pmod(F.xxhash64("spot_id"), F.col("_parts")))
    return cut_lineage(placed.join(load, ["slice", "_cell"]).select("slice", "spot_id", block.alias("block")))


def owned_pairs(edges: DataFrame, by: list[str]) -> DataFrame:
    """Every undirected edge once as (src, dst), where src is the end it was found from, so no spot owns more than its own neighbours."""
    low, high = F.least("src", "dst"), F.greatest("src", "dst")
    pairs = edges.filter("src <> dst").groupBy(*by, low.alias("_a"), high.alias("_b")).agg(F.min("src").alias("src"))
    return pairs.select(*by, "src", F.when(F.col("src") == F.col("_a"), F.col("_b")).otherwise(F.col("_a")).alias("dst"))


def packed_rows(entries: DataFrame, genes: DataFrame, keys: list[str], column: str, name: str = "row") -> DataFrame:
    """(*keys, name): the non-zero entries of each spot as an array of (gene index, value)."""
    indexed = entries.join(genes.select("gene", F.col("gene_index").cast("int").alias("_g")), "gene")
    return indexed.groupBy(*keys).agg(F.collect_list(F.struct(F.col("_g").alias("g"), F.col(column).cast("double").alias("v"))).alias(name))


class _Rows:
    """The packed rows of a block, gene by gene: dense slabs of a few hundred genes at a time."""

    def __init__(self, column: pa.ChunkedArray):
        lists = column.combine_chunks()
        entries = lists.flatten()
        self.n = len(lists)
        row = np.repeat(np.arange(self.n), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
        gene = pc.struct_field(entries, "g").to_numpy(zero_copy_only=False)
        order = np.argsort(gene, kind="stable")
        self.row, self.value = row[order], pc.struct_field(entries, "v").to_numpy(zero_copy_only=False)[order]
        self.genes, self.first, code = np.unique(gene[order], return_index=True, return_inverse=True)
        self.code = code
        self.ends = np.r_[self.first, len(order)]

    def slabs(self):
        """(first gene, end, dense array of rows x genes)."""
        for a in range(0, len(self.genes), GENES_AT_ONCE):
            b = min(a + GENES_AT_ONCE, len(self.genes))
            s = slice(self.ends[a], self.ends[b])
            yield a, b, np.bincount(self.row[s] * (b - a) + self.code[s] - a, self.value[s], self.n * (b - a)).reshape(self.n, b - a)


def over_blocks(rows: DataFrame, edges: DataFrame, blocks: DataFrame, keys: list[str], work: Callable, schema: str) -> DataFrame:
    """Runs `work(block rows, src, dst)` on every block: its own rows (`own` is set) and its halo, and its edges as places in the rows.

    `rows` has one row per spot with `keys` naming it; `edges` has the columns of `keys` but the last, src and dst. Work returns a table."""
    group = keys[:-1]
    home = blocks.select(*keys, "block")
    source = blocks.select(*group, F.col(keys[-1]).alias("src"), F.col("block").alias("block"))
    placed = cut_lineage(edges.join(source, [*group, "src"]).select(*group, "block", "src", "dst"))
    halo = placed.select(*group, F.col("dst").alias(keys[-1]), "block", F.lit(False).alias("own"))
    need = home.withColumn("own", F.lit(True)).unionByName(halo).groupBy(*keys, "block").agg(F.max("own").alias("own"))
    need = need.select(*[F.col(c).alias(c) for c in need.columns])  # fresh columns: rows may come from the same frames
    met = spread(need.join(rows, keys, "left"), "block")

    def run(_, mine: pa.Table, linked: pa.Table) -> pa.Table:
        ids = mine["spot_id"].combine_chunks() if mine.num_rows else pa.array([], mine.schema.field("spot_id").type)
        src, dst = (pc.index_in(linked[c].combine_chunks() if linked.num_rows else pa.array([], ids.type), ids) for c in ("src", "dst"))
        both = pc.and_(pc.is_valid(src), pc.is_valid(dst))  # an end outside the spots
        return work(mine, src.filter(both).to_numpy(zero_copy_only=False).astype(np.int64), dst.filter(both).to_numpy(zero_copy_only=False).astype(np.int64))

    return met.groupBy("block").cogroup(placed.groupBy("block")).applyInArrow(run, schema)


def _table(parts: list[dict], types: dict) -> pa.Table:
    return pa.table({k: pa.array(np.concatenate([p[k] for p in parts]) if parts else [], t) for k, t in types.items()})


def edge_sums(entries: DataFrame, genes: DataFrame, weights: DataFrame, pairs: DataFrame, blocks: DataFrame, column: str, by: list[str]) -> DataFrame:
    """(*by, gene, s, q, wx, cross): per gene the sum of x, x^2 and w x over spots and of x_i x_j over pairs, zeros implied.

    `weights` is (*by, spot_id, w); without a weight w is 0. `blocks` only says which spots lie together."""
    keys = [*by, "spot_id"]
    rows = packed_rows(entries, genes, keys, column).join(weights, keys, "left")
    types = {**({"slice": pa.string()} if by else {}), "g": pa.int32(), "s": pa.float64(), "q": pa.float64(), "wx": pa.float64(), "cross": pa.float64()}

    def work(mine: pa.Table, src: np.ndarray, dst: np.ndarray) -> pa.Table:
        if not mine.num_rows:
            return _table([], types)
        packed = _Rows(mine["row"])
        own = mine["own"].to_numpy().astype(bool)
        w = pc.fill_null(mine["w"].cast(pa.float64()), 0.0).to_numpy()[own]
        out = []
        for a, b, x in packed.slabs():
            mid = x[own]
            part = {"g": packed.genes[a:b], "s": mid.sum(0), "q": (mid * mid).sum(0), "wx": w @ mid,
                    "cross": np.einsum("ij,ij->j", x[src], x[dst]) if len(src) else np.zeros(b - a)}
            out.append(part | ({"slice": np.full(b - a, mine["slice"][0].as_py(), object)} if by else {}))
        return _table(out, types)

    schema = ", ".join([*(f"{c} string" for c in by), "g int, s double, q double, wx double, cross double"])
    sums = over_blocks(rows, pairs, blocks, keys, work, schema).groupBy(*by, "g").agg(*[F.sum(c).alias(c) for c in ("s", "q", "wx", "cross")])
    return sums.join(genes.select("gene", F.col("gene_index").cast("int").alias("g")), "g").drop("g")


def neighbour_sum_counts(entries: DataFrame, genes: DataFrame, edges: DataFrame, blocks: DataFrame, permuted: DataFrame, column: str) -> DataFrame:
    """(gene, s, c): how many spots have the neighbour sum s > 0 of a gene, less how many have it once the rows are permuted.

    `permuted` is (from, to): the spot `from` takes the row of `to`. The graph stays as it is, so both sums use the same halo."""
    plain = packed_rows(entries, genes, ["spot_id"], column)
    moved = plain.withColumnRenamed("row", "moved").join(permuted.select(F.col("from").alias("_f"), F.col("to").alias("spot_id")), "spot_id").select(F.col("_f").alias("spot_id"), "moved")
    rows = plain.join(moved, "spot_id", "full")
    types = {"g": pa.int32(), "s": pa.float64(), "c": pa.int64()}

    def work(mine: pa.Table, src: np.ndarray, dst: np.ndarray) -> pa.Table:
        if not len(src):
            return _table([], types)
        order = np.argsort(src, kind="stable")
        head = np.flatnonzero(np.r_[True, src[order][1:] != src[order][:-1]])
        out = []
        for name, sign in (("row", 1), ("moved", -1)):
            packed = _Rows(mine[name])
            for a, b, x in packed.slabs():
                sums = np.add.reduceat(x[dst[order]], head, axis=0)
                at, gene = np.nonzero(sums)
                value = sums[at, gene]
                by_value = np.lexsort((value, gene))
                gene, value = gene[by_value], value[by_value]
                new = np.flatnonzero(np.r_[True, (gene[1:] != gene[:-1]) | (value[1:] != value[:-1])]) if len(gene) else np.zeros(0, np.int64)
                out.append({"g": packed.genes[a:b][gene[new]], "s": value[new], "c": sign * np.diff(np.r_[new, len(gene)])})
        return _table(out, types)

    counts = over_blocks(rows, edges.select("src", "dst"), blocks, ["spot_id"], work, "g int, s double, c long").groupBy("g", "s").agg(F.sum("c").alias("c"))
    return counts.join(genes.select("gene", F.col("gene_index").cast("int").alias("g")), "g").drop("g")
