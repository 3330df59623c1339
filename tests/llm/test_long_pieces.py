"""Byte-level BPE of pieces of many thousand bytes, in one pass over the texts."""

import random
import time

import numpy as np
import pytest

from tessera.llm import byte_bpe

P = pytest.importorskip("public_tokenizers")


def test_long_pieces_in_one_pass(spark):
    import tiktoken

    r = random.Random(8)
    ranks = byte_bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["".join(r.choices("etaoinshr", k=60_000)), "a" * 50_001, " " * 30_000 + "x", "é漢" * 9_000, "=-" * 20_000]
    texts += ["".join(r.choices("abcdeé \n'", k=r.randrange(1, 40))) for _ in range(400)]
    rows = byte_bpe.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), ranks, P.PATTERN)
    assert "Exchange" not in rows._jdf.queryExecution().toString()
    start = time.monotonic()
    got = {r.key: np.frombuffer(r.ids, "<u2").tolist() for r in rows.collect()}
    assert time.monotonic() - start < 60
    assert got == {i: enc.encode_ordinary(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("seed", range(6))
def test_rows_of_short_pieces_take_the_steps_of_a_fold(seed):
    """Short pieces are merged together; entries need not come from training, so any pair can have any rank."""
    r = random.Random(seed)
    ranks = {bytes([b]): b for b in range(256)}
    while len(ranks) < 256 + 400 * (seed > 0):
        a, b = r.choice(list(ranks)), r.choice(b"abc")
        ranks.setdefault(r.choice([a + bytes([b]), bytes([b]) + a, a[-1:] + bytes([b])]), 256 + len(ranks))
    pieces = [bytes(r.choices(b"abcd", k=r.randrange(1, byte_bpe.ROWS + 1))) for _ in range(2_000)] + [b"a" * k for k in range(1, 33)]
    size = np.array([len(p) for p in pieces])
    single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
    got = {}
    for places, ids in byte_bpe.fold_rows(np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(size) - size, size, single, byte_bpe.pair_ranks(ranks)):
        got |= zip(places.tolist(), ids.tolist())
    assert got == {i: byte_bpe.fold(p, ranks) for i, p in enumerate(pieces)}
    assert not list(byte_bpe.fold_rows(np.zeros(0, np.uint8), *(np.zeros(0, np.int64),) * 2, single, byte_bpe.pair_ranks(ranks)))


def test_workers_hand_memory_back():
    """What a finished scan has freed does not stay with the worker."""
    import pyarrow as pa
    import resource

    from tessera.llm import words

    def resident() -> int:
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * resource.getpagesize()

    def scan(batches):
        held = [bytes(50_000) for _ in range(4_000)]  # below the size that is mapped on its own
        pin = held[-1][:-1]
        del held
        yield pa.record_batch([pa.array([pin])], ["x"])

    before = resident()
    rows = list(words.tidy(scan)(iter(())))
    assert len(rows) == 1 and resident() - before < 50_000_000
