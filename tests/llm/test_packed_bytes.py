"""What the packed shuffles of the Jaccard and suffix queries send, and how much a task holds."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import jaccard_join as J
from tessera.llm import suffix_dedup as S
from tessera.llm import words as W


@pytest.fixture(scope="module")
def texts():
    r = random.Random(7)
    some = [f"w{r.randrange(10 ** 9)}" for _ in range(3000)]
    return [" ".join(r.choices(some, k=2500)) for _ in range(1100)]


def sent(rows, columns):
    """Bytes of all packs as a shuffle compresses them."""
    return sum(len(pa.compress(bytes(x[c]), codec="lz4", asbytes=True)) for x in rows for c in columns if x[c])


@pytest.mark.parametrize("kind", [np.uint64, np.int64, np.uint8])
def test_planes_keep_all_numbers(kind):
    r = np.random.default_rng(1)
    parts = [r.integers(0, 1 << 64, n, np.uint64).astype(kind) for n in (1, 7, 1000)]
    parts.append(np.array([np.iinfo(kind).min, np.iinfo(kind).max, 0], kind))
    back = W.from_planes([W.planes(x) for x in parts], kind)
    assert back.dtype == kind and back.tolist() == np.concatenate(parts).tolist()
    assert W.from_planes([], kind).tolist() == []


def test_signatures_of_a_task(spark, texts):
    docs = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "doc long, comp long, text string").coalesce(1)
    rows = J._packed(docs, J.Bands(80, 2500), 1).collect()
    n = [len(x["sigs"]) // 8 for x in rows]
    assert max(n) <= 450_000 < sum(n)
    assert sent(rows, J.SENT) <= 13 * sum(n)


def test_segments_of_a_task(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc long, text string").coalesce(1)
    rows = [x for x in S._sieve(docs, 4, 100).collect() if x["kind"] == S.ASK]
    assert sent(rows, ("c0", "c1", "c2", "c3", "c4")) <= 24 * sum(len(x["c0"]) // 8 for x in rows)
