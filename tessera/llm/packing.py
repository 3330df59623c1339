"""Best-fit packing with certified bounds: cuts documents into pieces of token ids and packs the pieces into as few sequences as it can.

A document is its ids by a tokenizer file and an end id; only a document longer than the capacity is cut, into pieces of that length and a
rest. Ids are made once, where the text is read; what is stored and packed are (row, doc, piece, start, length, crc32).

Packing goes by lots, a bounded number of pieces that a hash of the row number deals to one group. A lot is packed by best-fit decreasing.
Lower bounds come from dual feasible functions: maps f of lengths with sum f <= 1 for whatever fits into one sequence, so the sum of f over
all pieces, rounded up, is a number of sequences that no packing can beat. The family is the volume, the rounding of small and large pieces
at each threshold, and the step functions of 1 / k. The best function over the lengths of the whole table (a histogram of at most `capacity`
rows) judges each sequence: what it lacks to 1 is its waste. A lot settles its sequences in order of waste as long as all lots of all rounds
together stay below one sequence of waste; the pieces of the others are exchanged with those of other lots, which are dealt anew and packed
again. In the last round, or when one lot is left, everything is settled. The first round stands if the exchange did not save a sequence.

Defined results: null and empty texts hold the end id alone; repeated rows and ids are packed apart; a null id is kept; an empty table gives
no rows. Sequence numbers are any numbers; offsets have no gaps."""

from __future__ import annotations

import functools
import itertools
import os
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import words as W
from tessera.llm.folders import stored
from tessera.llm.known import gather

CAPACITY = 4096
END = 1
LOT = 8_192  # pieces that one group packs, on average
ROUNDS = 4
CACHED_WORDS = 400_000  # words whose ids a worker keeps
JOINED = 64  # words that are encoded as one string
MARK = "\0"
SLICE_BYTES = 8 << 20
STEPS = 32  # step functions of 1 / k up to this k


class Encoder:
    """Token ids of whole texts, word by word: the tokenizer drops white space and never looks across it. A worker keeps the ids of the
    words it met first, up to a fixed number; the others are encoded once per array of texts, JOINED words in one string with a mark after each."""

    def __init__(self, file: str, end: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(file)
        self.encode = getattr(tok, "encode_batch_fast", tok.encode_batch)
        # the mark is a word of one id, which words without its character cannot have
        mark = tok.encode(MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 and tok.encode(f"a {MARK} {MARK}", add_special_tokens=False).ids[-2:] == 2 * mark else None
        self.known: dict[str, int] = {}
        self.pool, self.begin, self.size = np.array([end], "<u4"), np.zeros(1, np.int64), np.ones(1, np.int64)  # code 0 is the end

    def encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words, one after the other, and the number of ids of each."""
        def ids_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
            got = [e.ids for e in self.encode(texts, add_special_tokens=False)]
            size = np.array([len(x) for x in got], np.int64)
            return np.fromiter(itertools.chain.from_iterable(got), "<u4", int(size.sum())), size

        if self.mark is not None and not any(MARK in w for w in words):
            ids, _ = ids_of([f" {MARK} ".join(words[i:i + JOINED]) + f" {MARK}" for i in range(0, len(words), JOINED)])
            mark = ids == self.mark
            size = np.diff(np.flatnonzero(mark), prepend=-1) - 1
            if len(size) == len(words):
                return ids[~mark], size
        return ids_of(words)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, each with its end, and where each text's ids begin, with the total)."""
        parts = pc.ascii_split_whitespace(texts.fill_null("").cast(pa.large_string()))
        coded = pc.dictionary_encode(parts.values)
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        code = np.fromiter(map(self.known.get, words, itertools.repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(code < 0)
        ids, size = self.encoded([words[i] for i in new.tolist()])
        pool = np.concatenate([self.pool, ids])
        begin = np.concatenate([self.begin, len(self.pool) + np.cumsum(size) - size])
        size = np.concatenate([self.size, size])
        code[new] = len(self.begin) + np.arange(len(new))
        place = coded.indices.to_numpy()
        keep = new[:max(0, CACHED_WORDS - len(self.begin))].tolist()
        if keep:
            n = len(self.begin)
            self.known.update(zip([words[i] for i in keep], range(n, n + len(keep))))
            n += len(keep)
            self.begin, self.size, self.pool = begin[:n].copy(), size[:n].copy(), pool[:begin[n - 1] + size[n - 1]].copy()
        ends = parts.offsets.to_numpy()[1:] - parts.offsets[0].as_py()
        ids, at = gather(pool, begin, size, np.insert(code[place], ends, 0))
        return ids, at[np.r_[0, ends + 1 + np.arange(len(ends))]]


@functools.cache
def worker_encoder(file: str, end: int) -> Encoder:
    return Encoder(file, end)


def pieces(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(row, doc, piece, start, length, crc32), `row` being unique once stored."""
    def scan(batches):
        encode, made = worker_encoder(tokenizer_file, end), TaskContext.get().partitionId() << 40
        for whole in batches:
            for batch in W.slices(whole, "text", SLICE_BYTES):
                ids, at = encode(batch.column("text"))
                n = -(-np.diff(at) // capacity)
                of = np.repeat(np.arange(len(n)), n)
                piece = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(capacity, np.diff(at)[of] - start)
                view = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                crc = [zlib.crc32(view[4 * a:4 * (a + k)]) for a, k in zip((at[:-1][of] + start).tolist(), length.tolist())]
                yield pa.record_batch([pa.array(made + np.arange(len(of))), batch.column("doc").take(pa.array(of)), pa.array(piece.astype(np.int32)),
                                       pa.array(start), pa.array(length.astype(np.int32)), pa.array(crc, pa.int64())], ["row", "doc", "piece", "start", "length", "crc32"])
                made += len(of)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).mapInArrow(
        scan, f"row long, doc {kind}, piece int, start long, length int, crc32 long")


@dataclass(frozen=True)
class Bound:
    """The best dual feasible function over some lengths: `value[length] / unit`, summing to `total / unit`."""
    name: str
    unit: int
    value: np.ndarray
    total: int

    @property
    def sequences(self) -> int:
        return -(-self.total // self.unit)


def lower_bound(lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY) -> Bound:
    """The function of the family with the largest sum over the lengths. Sums are exact integers."""
    count = np.zeros(capacity + 1, np.int64)
    np.add.at(count, lengths, counts)
    x = np.arange(capacity + 1, dtype=np.int64)

    def bound(name, unit, value):
        return Bound(name, unit, value, int((value * count).sum()))

    best = bound("volume", capacity, x)
    volume, number = np.cumsum(x * count), np.cumsum(count)
    least = np.arange(1, capacity // 2 + 1)  # pieces below the threshold count nothing, those that leave less than it count a whole
    sums = volume[capacity - least] - volume[least - 1] + capacity * (number[-1] - number[capacity - least])
    if len(least) and sums.max() > best.total:
        k = int(least[sums.argmax()])
        best = bound(f"threshold {k}", capacity, np.where(x > capacity - k, capacity, np.where(x < k, 0, x)))
    for k in range(1, STEPS + 1):
        whole, rest = np.divmod((k + 1) * x, capacity)
        new = bound(f"step {k}", k * capacity, np.where(rest == 0, k * x, capacity * whole))
        if new.total * best.unit > best.total * new.unit:
            best = new
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each length: longest first, each into the fullest sequence that holds it. The free spaces that occur are the
    bits of one integer, so the best fit is its lowest bit from the length on."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    spaces: list[list[int]] = [[] for _ in range(capacity + 1)]
    bits = made = 0
    order = np.argsort(-lengths, kind="stable")
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        fits = bits >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            b = spaces[free].pop()
            if not spaces[free]:
                bits ^= 1 << free
        else:
            free, b, made = capacity, made, made + 1
        bins[i], offsets[i] = b, capacity - free
        if free > n:
            spaces[free - n].append(b)
            bits |= 1 << (free - n)
    return bins, offsets


def _round(rows: DataFrame, bound: Bound, number: int, lots: int, rounds: int, last: bool, capacity: int) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        length = table["length"].to_numpy().astype(np.int64)
        bins, offsets = best_fit_decreasing(length, capacity)
        waste = bound.unit - np.bincount(bins, bound.value[length]).astype(np.int64)
        order = np.argsort(waste, kind="stable")
        settled = np.ones(len(waste), bool)
        if not last:
            settled[order] = 10 * lots * rounds * np.cumsum(waste[order]) <= 9 * bound.unit
        own = lower_bound(length, np.ones(len(length), np.int64), capacity)
        base = number << 56 | table["lot"][0].as_py() << 20
        table = table.drop_columns(["lot", "sequence_id", "offset", "settled", "certified"])
        for name, x in (("sequence_id", base + bins), ("offset", offsets), ("settled", settled[bins]), ("certified", np.repeat(len(waste) == own.sequences, len(bins)))):
            table = table.append_column(name, pa.array(x))
        return table

    dealt = rows.drop("sequence_id", "offset", "settled", "certified").select(
        F.pmod(F.xxhash64("row", F.lit(number)), F.lit(lots)).alias("lot"), "*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
        F.lit(False).alias("settled"), F.lit(False).alias("certified"))
    out = dealt.drop("lot").schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")
    return stored(dealt.repartition(min(lots, 1 << 14), "lot").groupBy("lot").applyInArrow(run, out), f"packed-{number}")


@dataclass(frozen=True)
class Packing:
    """All pieces with (sequence_id, offset), the number of sequences, and the number that no packing can beat."""
    rows: DataFrame
    sequences: int
    bound: Bound

    @property
    def certified(self) -> bool:
        return self.sequences == self.bound.sequences


def pack(rows: DataFrame, capacity: int = CAPACITY, lot: int = LOT, rounds: int = ROUNDS) -> Packing:
    """Packs stored pieces with columns `row` (unique) and `length` (1 to capacity)."""
    histogram = rows.groupBy("length").agg(F.count("*").alias("n")).toArrow()  # at most `capacity` rows
    bound = lower_bound(histogram["length"].to_numpy(), histogram["n"].to_numpy(), capacity)
    open_rows, n, parts, first = rows, int(histogram["n"].to_numpy().sum()), [], None
    used = 0
    for number in range(rounds):
        lots = max(1, -(-n // lot))
        last = lots == 1 or number == rounds - 1
        done = _round(open_rows, bound, number, lots, rounds, last, capacity)
        size = done.agg(F.count_distinct("sequence_id"), F.count_distinct(F.when(F.col("settled"), F.col("sequence_id"))),
                        F.coalesce(F.sum((~F.col("settled")).cast("int")), F.lit(0))).first()
        if first is None:
            first = (done, size[0])
        used += size[1]
        parts.append(done.filter("settled"))
        open_rows, n = done.filter("not settled"), size[2]
        if last or not n:
            break
    packed = functools.reduce(DataFrame.unionByName, parts)
    if used >= first[1]:
        packed, used = first
    return Packing(packed.drop("settled", "certified"), used, bound)


def pack_documents(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, lot: int = LOT, rounds: int = ROUNDS) -> Packing:
    """Cuts and packs whole documents."""
    return pack(stored(pieces(docs, tokenizer_file, id_col, text_col, capacity), "pieces"), capacity, lot, rounds)
