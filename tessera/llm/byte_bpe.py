"""Byte-level BPE encoding and decoding.

Texts are cut into pieces by the tokenizer's pattern (`regexp_extract_all`; code points on whose class the JVM and the tokenizer's tables
disagree are written into the pattern). A piece that is a vocabulary entry has its id at once. Every other distinct piece of a block of
documents starts as the ids of its bytes and merges, step by step, the leftmost adjacent pair of lowest rank until no pair has one. Short
pieces do their steps together, as rows of one array of equal numbers of ids; in a longer one the pairs wait in a heap, so n bytes take n log n
steps. A task keeps the ids of longer pieces, at most `hot` of them, if they are short enough.
Nothing is shuffled or stored between the texts and their ids.

Defined results: null and empty texts have no ids and decode to nothing; repeated rows give one row each; an empty table gives no rows; a
text of any length is one row of one block. Only the named columns are read."""

from __future__ import annotations

import base64
import hashlib
import heapq
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import words as W
from tessera.llm.known import gather

HOT = 10_000
ROWS = 32  # bytes of a piece that is merged as a row of an array
SHORT = 64  # bytes of a longer piece whose ids a task keeps
BLOCK = 2 << 20  # bytes of text in a block
_SHIFT = 16


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def fold(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a piece: merges the leftmost pair of lowest rank while there is one."""
    n, rank = len(piece), ranks.get
    # the part at i ends where after[i] begins; a part that was merged into the one before it points to the end
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    pairs = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i:i + 2])) is not None]
    heapq.heapify(pairs)
    while pairs:
        _, i, end = heapq.heappop(pairs)
        j = after[i]
        if j == n or after[j] != end:
            continue  # one of its parts has been merged since
        after[i], after[j] = end, n
        if end < n:
            before[end] = i
            if (r := rank(piece[i:after[end]])) is not None:
                heapq.heappush(pairs, (r, i, after[end]))
        if i and (r := rank(piece[before[i]:end])) is not None:
            heapq.heappush(pairs, (r, before[i], end))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i:after[i]]])
        i = after[i]
    return ids


NONE = 1 << _SHIFT  # the rank of a pair that does not merge


def pair_ranks(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """(pairs, ranks): every two entries that make a third one, as left << 16 | right in ascending order, and its rank."""
    pairs = {}
    for whole, rank in ranks.items():
        for k in range(1, len(whole)):
            left, right = ranks.get(whole[:k]), ranks.get(whole[k:])
            if left is not None and right is not None:
                pairs[left << _SHIFT | right] = rank
    keys = np.fromiter(pairs.keys(), np.uint32, len(pairs))
    order = np.argsort(keys)
    return keys[order], np.fromiter(pairs.values(), np.int32, len(pairs))[order]


def fold_rows(data: np.ndarray, begin: np.ndarray, sizes: np.ndarray, single: np.ndarray, pairs: tuple[np.ndarray, np.ndarray]):
    """Yields (places, ids): the pieces that end with equal numbers of ids, a row of ids each. All are merged from `single`, the ids of bytes.

    Rows of n ids either have no pair to merge, or merge one and join the rows of n - 1 ids, so a piece takes the steps that `fold` takes."""
    keys, found = pairs
    keys, found = (keys, found) if len(keys) else (np.zeros(1, np.uint32), np.array([NONE], np.int32))

    def rank(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left.astype(np.uint32) << np.uint32(_SHIFT) | right.astype(np.uint32)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, found[at], NONE).astype(np.int32)

    bytes_ = rank(np.repeat(single, 256), np.tile(single, 256)).reshape(256, 256)
    order = np.argsort(sizes, kind="stable")
    cuts = np.searchsorted(sizes[order], np.arange(int(sizes.max(initial=0)) + 2))
    place, ids, ranked = np.zeros(0, np.int64), None, None
    for n in range(len(cuts) - 2, 0, -1):
        new = order[cuts[n]:cuts[n + 1]]
        raw = data[begin[new][:, None] + np.arange(n)]
        first, first_ranked = single[raw], bytes_[raw[:, :-1], raw[:, 1:]]
        place, ids, ranked = (np.r_[place, new], np.r_[ids, first], np.r_[ranked, first_ranked]) if len(place) else (new, first, first_ranked)
        if not len(place):
            continue
        if n == 1:
            yield place, ids
            break
        at = ranked.argmin(axis=1)  # the leftmost of equal ranks
        least = ranked[np.arange(len(at)), at]
        done = least == NONE
        if done.any():
            yield place[done], ids[done]
            place, ids, ranked, at, least = (x[~done] for x in (place, ids, ranked, at, least))
        row, m = np.arange(len(at)), len(at)
        ids[row, at] = least
        keep = np.ones((m, n), bool)
        keep[row, at + 1] = False
        ids = ids[keep].reshape(m, n - 1)
        keep = np.ones((m, n - 1), bool)
        keep[row, at] = False
        ranked = ranked[keep].reshape(m, n - 2)
        left, right = np.flatnonzero(at > 0), np.flatnonzero(at < n - 2)
        ranked[left, at[left] - 1] = rank(ids[left, at[left] - 1], least[left])
        ranked[right, at[right]] = rank(least[right], ids[right, at[right] + 1])


def jvm_pattern(spark: SparkSession, pattern: str) -> str:
    """The pattern with the classes of the JVM extended by the code points that only the tokenizer's Unicode tables put into them."""
    import regex

    for name in (r"\p{L}", r"\p{N}", r"\s"):
        theirs = {r[0] for r in spark.range(0x110000).filter("id not between 55296 and 57343")
                  .filter(F.expr(f"decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32') rlike r'^{name}$'")).collect()}
        find = regex.compile(name).match
        ours = {c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and find(chr(c))}
        new = ours - theirs
        first, last = sorted(c for c in new if c - 1 not in new), sorted(c for c in new if c + 1 not in new)
        extra = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in zip(first, last))
        if extra:
            inside = False
            parts = []
            for token in re.split(r"(\\p\{\w\}|\\.|\[|\])", pattern):
                inside = token == "[" or inside and token != "]"
                parts.append(token if token != name else f"{token}[{extra}]" if inside else f"[{token}[{extra}]]")
            pattern = "".join(parts)
            if name == r"\s":
                pattern = pattern.replace(r"\S", rf"[^\s[{extra}]]")
    return pattern


def cut(docs: DataFrame, pattern: str) -> DataFrame:
    """(key, pieces) of (key, text) rows. Texts of ASCII alone, on which all tables agree, need no extended classes."""
    text, extended = F.coalesce("text", F.lit("")), jvm_pattern(docs.sparkSession, pattern)
    plain = F.octet_length(text) == F.length(text)
    return docs.select("key", F.when(plain, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(
        F.regexp_extract_all(text, F.lit(extended), F.lit(0))).alias("pieces"))


def _parts(batch: pa.RecordBatch):
    """The rows of a batch in pieces of at most BLOCK bytes."""
    pieces = batch.column("pieces")
    _, bytes_ = W.buffers(pieces.flatten())
    rows = bytes_[pieces.offsets.to_numpy() - pieces.offsets[0].as_py()]
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(rows, rows[i] + BLOCK, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, then=None,
           then_schema: str = "ids binary") -> DataFrame:
    """(key, ids): the ids of each text as little-endian unsigned 16-bit integers. `then` maps these batches further in the same worker."""
    if max(ranks.values()) >= 1 << _SHIFT:
        raise ValueError("ids must fit 16 bits")
    keyed = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    kind = keyed.schema["key"].dataType.simpleString()
    single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
    shared = docs.sparkSession.sparkContext.broadcast((ranks, single, pair_ranks(ranks)))

    def number(batches):
        (ranks, single, pairs), held = shared.value, {}

        def ids_of(piece: bytes) -> np.ndarray:
            ids = held.get(piece)
            if ids is None:
                ids = np.array(fold(piece, ranks), np.uint16)
                if len(piece) <= SHORT:
                    if len(held) >= hot:
                        held.clear()
                    held[piece] = ids
            return ids

        def runs(pieces: pa.Array):
            """Ids, one run after the other, and the begin and size of the run of each piece."""
            strings = pieces.to_numpy(zero_copy_only=False).tolist()
            own = np.fromiter((ranks.get(p, -1) for p in strings), np.int64, len(strings))
            data, ends = W.buffers(pieces)
            long, size = np.diff(ends), np.ones(len(strings), np.int64)
            begin, pool = np.zeros(len(strings), np.int64), [own[own >= 0].astype(np.uint16)]
            begin[own >= 0] = np.arange(len(pool[0]))
            filled = len(pool[0])
            few = np.flatnonzero((own < 0) & (long <= ROWS))
            for at, ids in fold_rows(data, ends[few], long[few], single, pairs):
                size[few[at]] = ids.shape[1]
                begin[few[at]] = filled + np.arange(len(at)) * ids.shape[1]
                pool.append(ids.astype(np.uint16).ravel())
                filled += ids.size
            for at in np.flatnonzero((own < 0) & (long > ROWS)).tolist():
                pool.append(ids_of(strings[at]))
                begin[at], size[at] = filled, len(pool[-1])
                filled += len(pool[-1])
            return np.concatenate(pool), begin, size

        for whole in batches:
            for batch in _parts(whole):
                lists = batch.column("pieces")
                coded = pc.dictionary_encode(lists.flatten())
                ids, ends = gather(*runs(coded.dictionary.cast(pa.binary())), coded.indices.to_numpy())
                texts = ends[np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy())]]
                yield pa.record_batch([batch.column("key"), pa.array([ids[a:b].tobytes() for a, b in zip(texts, texts[1:])], pa.binary())],
                                      ["key", "ids"])

    return cut(keyed, pattern).mapInArrow(W.tidy(lambda batches: then(number(batches)) if then else number(batches)), f"key {kind}, {then_schema}")


def vocabulary(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pool, begin, sizes): the byte strings of all ids, one after the other."""
    pieces = [b""] * (max(ranks.values()) + 1)
    for k, v in ranks.items():
        pieces[v] = k
    sizes = np.array([len(p) for p in pieces], np.int64)
    return np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(sizes) - sizes, sizes


def decoder(shared):
    """Batches of (key, ids) to (key, ids, bytes): concatenates the byte strings of the broadcast vocabulary."""
    def join(batches):
        pool, begin, sizes = shared.value
        for batch in batches:
            out = []
            for ids in batch.column("ids").to_pylist():
                i = np.frombuffer(ids, "<u2").astype(np.int64)
                n = sizes[i]
                ends = np.r_[0, np.cumsum(n)]
                out.append(pool[np.repeat(begin[i] - ends[:-1], n) + np.arange(ends[-1])].tobytes())
            yield pa.record_batch([batch.column("key"), batch.column("ids"), pa.array(out, pa.binary())], ["key", "ids", "bytes"])

    return join


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """(key, ids, bytes) of encoded rows."""
    kind = encoded.schema["key"].dataType.simpleString()
    return encoded.select("key", "ids").mapInArrow(decoder(encoded.sparkSession.sparkContext.broadcast(vocabulary(ranks))), f"key {kind}, ids binary, bytes binary")


_DECIMAL = tuple(map(str, range(1 << _SHIFT)))
DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(batches):
    """Batches of (key, ids, bytes) to their counts and digests."""
    for batch in batches:
        ids = [np.frombuffer(x, "<u2") for x in batch.column("ids").to_pylist()]
        yield pa.record_batch(
            [batch.column("key"), pa.array([len(x) for x in ids], pa.int64()),
             pa.array([hashlib.sha256(",".join(map(_DECIMAL.__getitem__, x.tolist())).encode()).hexdigest() for x in ids], pa.string()),
             pa.array([hashlib.sha256(x).hexdigest() for x in batch.column("bytes").to_pylist()], pa.string())],
            ["key", "n_tokens", "ids_sha256", "decoded_sha256"])


def round_trip(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): encodes, decodes the ids, and digests both."""
    decoded = decoder(docs.sparkSession.sparkContext.broadcast(vocabulary(ranks)))
    return encode(docs, ranks, pattern, id_col, text_col, then=lambda batches: digests(decoded(batches)), then_schema=DIGESTS)
