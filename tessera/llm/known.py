"""Strings with known token ids, looked up a whole array at a time."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import words as W


def _hashes(strings: pa.Array) -> np.ndarray:
    buf, offsets = W.buffers(strings)
    return W.word_hashes(buf, offsets[:-1], offsets[1:]).view(np.int64)


def gather(pool: np.ndarray, begin: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of `pool` that the codes name, one after the other, and where each begins, with the end."""
    n = sizes[codes]
    ends = np.r_[0, np.cumsum(n)]
    return pool[np.repeat(begin[codes] - ends[:-1], n) + np.arange(ends[-1])], ends


@dataclass(frozen=True)
class Known:
    """Pieces with known ids, ascending by hash; a hit is compared byte by byte."""
    hashes: np.ndarray
    pieces: pa.Array
    sizes: np.ndarray
    begin: np.ndarray
    ids: np.ndarray

    @staticmethod
    def of(pieces: pa.Array, sizes: np.ndarray, ids: np.ndarray) -> Known:
        """From pieces, their numbers of ids, and all ids one after the other."""
        hashes = _hashes(pieces)
        order = np.argsort(hashes, kind="stable")
        pool, ends = gather(ids, np.cumsum(sizes) - sizes, sizes, order)
        return Known(hashes[order], pieces.take(pa.array(order)), sizes[order], ends[:-1], pool)

    def find(self, pieces: pa.Array) -> np.ndarray:
        """The place of each piece, or -1. Pieces of equal hash but one are not found, which costs a fold and nothing else."""
        if not len(self.hashes):
            return np.full(len(pieces), -1)
        hashes = _hashes(pieces)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        same = pc.equal(self.pieces.take(pa.array(at)), pieces.cast(pa.binary())).to_numpy(zero_copy_only=False)
        return np.where(same, at, -1)


def counted(rows: DataFrame, flat, shared) -> DataFrame:
    """(piece, n) of the strings that `flat` takes from a batch and that the broadcast dictionary lacks, summed over all rows; strings that
    occur once are left out. Tasks merge their own counts first."""
    def count(batches):
        held = []

        def flush():
            table = pa.table({"piece": pa.concat_arrays([h[0] for h in held]), "n": pa.concat_arrays([h[1] for h in held])})
            held.clear()
            table = table.group_by("piece").aggregate([("n", "sum")]).rename_columns(["piece", "n"])
            return table.select(["piece", "n"]).combine_chunks().to_batches()

        for batch in batches:
            for strings in flat(batch):
                counts = pc.value_counts(strings)
                new = pa.array(shared.value.find(counts.field("values")) < 0)
                held.append((counts.field("values").filter(new).cast(pa.binary()), counts.field("counts").filter(new)))
                if sum(len(h[0]) for h in held) > 500_000:
                    yield from flush()
        if held:
            yield from flush()

    return rows.mapInArrow(count, "piece binary, n long").groupBy("piece").agg(F.sum("n").alias("n")).filter("n > 1")
