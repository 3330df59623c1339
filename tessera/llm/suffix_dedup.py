"""Removal of repeated byte strings by merging shard Burrows-Wheeler transforms.

A byte goes if a string of `length` bytes over it also starts earlier, in a document of smaller id or earlier in its own. The work is done
where repeats can be:

1. Every window of `length` bytes has a minimizer, the least hash of its k-grams. Maximal runs of windows with one minimizer are segments.
   Equal windows have equal minimizers, so a repeat never leaves the segments of one minimizer.
2. Segments travel as (minimizer, content hash, place), packed per shard. Of equal segments all but the first are repeated as a whole. Only
   minimizers with several different segments go on, each content once, by its first place.
3. Tasks build the transform of their own segments per shard, by prefix doubling, and send the transforms, not the texts.
4. The transforms of a shard are merged by iterative interleave refinement: from the order by i characters and the transforms alone follows
   the order by i + 1 characters, and whether neighbours still agree. After `length` rounds the blocks of equal prefixes are the repeated
   intervals; no suffix is sorted again. Walking each transform backwards gives the places of its rows; all but the first of a block go.

Defined results: null and empty texts keep nothing and lose nothing; rows that share an id are one document and get one result each; a
null id sorts first; texts of any length are whole; an empty table gives no rows. Only the named columns are read."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import words as W
from tessera.llm.folders import stored

LENGTH = 100
GRAM = 24
FIRST = 7  # symbols of a suffix that fit one number
BYTES = 1 << 20
_PLACE = np.uint64(BYTES - 1)  # low bits of a hash that hold a place
FLUSH = 500_000  # segments that a task holds before it merges and sends them
SHARD_DOCS = 4_000
BROADCAST_BYTES = 32 << 20
NO_ID = -(1 << 63)


def segments(buf: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(minimizer, content hash, text number, first window, 2 * windows + 1 if the minimizer comes twice) of the segments of at most BYTES
    bytes. Only a segment that holds its minimizer twice can repeat a window inside itself."""
    n = len(buf)
    none = np.zeros(0, np.int64)
    if n < length:
        return none.view(np.uint64), none.view(np.uint64), none, none, none
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(W._TABLE[buf] * W._PW[:n], out=sums[1:])
    hashes = W.mix((sums[gram:] - sums[:-gram]) * W._PIW[:n - gram + 1]) & ~_PLACE
    # the least hash of each window with its first, and then with its last place, in the low bits
    wide = length - gram + 1
    place = np.arange(len(hashes), dtype=np.uint64)

    def least(values: np.ndarray) -> np.ndarray:
        blocks = np.concatenate([values, np.full(-len(values) % wide, ~np.uint64(0))]).reshape(-1, wide)
        left = np.minimum.accumulate(blocks, axis=1).ravel()
        right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        return np.minimum(right[:n - length + 1], left[wide - 1:wide + n - length])

    first, last = least(hashes | place), least(hashes | (_PLACE - place))
    least_hash = first & ~_PLACE
    valid = np.zeros(n - length + 1, bool)
    sizes = np.diff(offsets)
    for a, size in zip(offsets[:-1][sizes >= length].tolist(), sizes[sizes >= length].tolist()):
        valid[a:a + size - length + 1] = True
    start = valid.copy()
    start[1:] &= ~valid[:-1] | (least_hash[1:] != least_hash[:-1])
    cuts = offsets[(offsets > 0) & (offsets < len(valid))]
    start[cuts] = valid[cuts]
    end = valid.copy()
    end[:-1] &= ~valid[1:] | start[1:]
    s, e = np.flatnonzero(start), np.flatnonzero(end)
    content = W.mix((sums[e + length] - sums[s]) * W._PIW[s] + (e - s).astype(np.uint64))
    text = np.searchsorted(offsets, s, "right") - 1
    twice = (first[s] & _PLACE) != _PLACE - (last[e] & _PLACE)
    return least_hash[s], content, text, s - offsets[text], 2 * (e - s + 1) + twice


def _blocks(batch: pa.RecordBatch, length: int):
    """(doc, segments) of a batch; a text of more than BYTES bytes is taken in blocks that overlap by one window less a byte."""
    for part in W.slices(batch, "text", BYTES):
        buf, offsets = W.buffers(part.column("text"))
        docs = part.column("doc").to_numpy()
        if len(buf) <= BYTES:
            m, h, t, s, r = segments(buf, offsets, length)
            yield m, h, docs[t], s, r
            continue
        for a in range(0, len(buf) - length + 1, BYTES - length + 1):
            block = buf[a:a + BYTES]
            m, h, t, s, r = segments(block, np.array([0, len(block)]), length)
            yield m, h, docs[t], s + a, r


def _shards(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((W.mix(keys) >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _pack(shard: np.ndarray, shards: int, kind: int, *columns: np.ndarray) -> list[tuple]:
    order = np.argsort(shard, kind="stable")
    cut = np.searchsorted(shard[order], np.arange(shards + 1))
    columns = [c[order] for c in columns]
    return [(k, kind, *(W.planes(c[a:b]) for c in columns)) for k, (a, b) in enumerate(zip(cut, cut[1:])) if b > a]


PACKED = "shard int, kind int, c0 binary, c1 binary, c2 binary, c3 binary, c4 binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*(r + (b"",) * (7 - len(r)) for r in rows))) or [[]] * 7
    return pa.record_batch([pa.array(c, t) for c, t in zip(cols, [pa.int32()] * 2 + [pa.binary()] * 5)], ["shard", "kind", "c0", "c1", "c2", "c3", "c4"])


def _load(table: pa.Table, *types) -> list[np.ndarray]:
    return [W.from_planes(table[f"c{i}"].to_pylist(), t) for i, t in enumerate(types)]


def _merge_runs(doc: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unites overlapping or touching byte runs per document."""
    if not len(doc):
        return doc, start, size
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], (start + size)[order]
    group = np.cumsum(np.r_[True, doc[1:] != doc[:-1]]) - 1
    span = int(end.max()) + 1  # documents are laid out one after the other, so one running maximum serves all
    reach = np.maximum.accumulate(end + group * span)
    head = np.flatnonzero(np.r_[True, (start + group * span)[1:] > reach[:-1]] | np.r_[True, group[1:] != group[:-1]])
    last = np.r_[head[1:] - 1, len(doc) - 1]
    return doc[head], start[head], reach[last] - group[head] * span - start[head]


DUP, ASK = 0, 1


def _sieve(docs: DataFrame, shards: int, length: int) -> DataFrame:
    """Packed segments by minimizer (kind ASK: minimizer, content, doc, start, windows), and byte runs that are repeated inside a task
    (kind DUP, sharded by document: doc, start, size)."""
    def scan(batches):
        held, count = [], 0

        def flush():
            m, h, d, s, r = (np.concatenate(c) for c in zip(*held))
            order = np.lexsort((s, d, h, m))
            m, h, d, s, r = m[order], h[order], d[order], s[order], r[order]
            first = np.r_[True, (m[1:] != m[:-1]) | (h[1:] != h[:-1])]
            again = ~first & np.r_[False, (d[1:] != d[:-1]) | (s[1:] != s[:-1])]  # the same place twice is a repeated row
            dd, ds, dn = _merge_runs(d[again], s[again], (r[again] >> 1) + length - 1)
            return _batch(_pack(_shards(m[first], shards), shards, ASK, m[first], h[first], d[first], s[first], r[first])
                          + _pack(_shards(dd.view(np.uint64), shards), shards, DUP, dd, ds, dn))

        for whole in batches:
            for found in _blocks(whole, length):
                if len(found[0]):
                    held.append(found)
                    count += len(found[0])
                if count > FLUSH:
                    yield flush()
                    held, count = [], 0
        if held:
            yield flush()

    return docs.mapInArrow(scan, PACKED)


def _first_places(packed: DataFrame, shards: int, length: int) -> DataFrame:
    """Per document shard: repeated runs (DUP), and the segments to compare (ASK: doc, start, windows, minimizer)."""
    def place(key, table):
        if key[1].as_py() == DUP:
            return table
        m, h, d, s, r = _load(table, np.uint64, np.uint64, np.int64, np.int64, np.int64)
        order = np.lexsort((s, d, h, m))
        m, h, d, s, r = m[order], h[order], d[order], s[order], r[order]
        first = np.r_[True, (m[1:] != m[:-1]) | (h[1:] != h[:-1])]
        again = ~first & np.r_[False, (d[1:] != d[:-1]) | (s[1:] != s[:-1])]
        dd, ds, dn = _merge_runs(d[again], s[again], (r[again] >> 1) + length - 1)
        m, d, s, r = m[first], d[first], s[first], r[first]
        head = np.r_[True, m[1:] != m[:-1]]
        group = np.cumsum(head) - 1
        ask = (np.bincount(group)[group] > 1) | (r & 1 == 1)
        m, d, s, r = m[ask], d[ask], s[ask], r[ask] >> 1
        return pa.Table.from_batches([_batch(_pack(_shards(d.view(np.uint64), shards), shards, ASK, d, s, r, m)
                                             + _pack(_shards(dd.view(np.uint64), shards), shards, DUP, dd, ds, dn))])

    return packed.groupBy("shard", "kind").applyInArrow(place, PACKED)


def _per_document(packed: DataFrame, kind: int) -> DataFrame:
    """(doc, runs): all runs of one kind per document, as packed (start, size[, minimizer])."""
    def gather(key, table):
        if kind == DUP:
            d, s, n = _merge_runs(*_load(table, np.int64, np.int64, np.int64))
            rows = np.stack([s, n], 1)
        else:
            d, s, n, m = _load(table, np.int64, np.int64, np.int64, np.int64)
            order = np.lexsort((s, d))
            d, rows = d[order], np.stack([s, n, m], 1)[order]
        cut = np.flatnonzero(np.r_[True, d[1:] != d[:-1], True]) if len(d) else np.zeros(1, np.int64)
        return pa.table({"doc": d[cut[:-1]], "runs": pa.array([rows[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())})

    return packed.filter(f"kind = {kind}").groupBy("shard").applyInArrow(gather, "doc long, runs binary")


def _with_runs(docs: DataFrame, runs: DataFrame, how: str) -> DataFrame:
    """Joins stored runs to the documents: broadcast only while their counted bytes are few, else by shuffle."""
    size = runs.agg(F.sum(F.length("runs") + 24)).first()[0] or 0
    return docs.join(F.broadcast(runs) if size <= BROADCAST_BYTES else runs, "doc", how)


def transform(strings: list[np.ndarray]) -> np.ndarray:
    """The Burrows-Wheeler transform of a collection, symbols shifted by one and 0 for the end of a string; row i < len(strings) is the end of
    string i. Suffixes are sorted by prefix doubling."""
    m = len(strings)
    sizes = np.array([len(x) for x in strings], np.int64)
    ends = np.cumsum(sizes + 1) - 1
    n = int(ends[-1]) + 1
    symbol = np.zeros(n, np.uint8)
    keep = np.ones(n, bool)
    keep[ends] = False
    symbol[keep] = np.concatenate(strings) + np.uint8(1)
    # the first symbols of each suffix in one number, nothing after its end; equal ends are told apart by their strings
    padded = np.concatenate([symbol, np.zeros(FIRST, np.uint8)])
    packed, ended = np.zeros(n, np.int64), np.zeros(n, bool)
    for k in range(FIRST):
        packed = packed << 8 | np.where(ended, 0, padded[k:k + n])
        ended |= padded[k:k + n] == 0
    order = np.argsort(packed, kind="stable")
    rank = _ranks(packed[order], order, ended[order])
    step = FIRST
    while rank[order[-1]] < n - 1:
        second = np.zeros(n, np.int64)
        second[:n - step] = rank[step:] + 1
        both = rank * (n + 2) + second
        order = np.argsort(both, kind="stable")
        rank = _ranks(both[order], order)
        step *= 2
    before = symbol[order - 1]
    before[order == 0] = 0
    return before


def _ranks(ordered: np.ndarray, order: np.ndarray, distinct: np.ndarray | None = None) -> np.ndarray:
    new = ordered[1:] != ordered[:-1]
    if distinct is not None:
        new |= distinct[1:]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(np.r_[False, new])
    return rank


def _last_to_first(bwt: np.ndarray) -> np.ndarray:
    """The row of the suffix that starts one symbol earlier; ends of strings map to -1."""
    order = np.argsort(bwt, kind="stable")
    out = np.empty(len(bwt), np.int64)
    out[order] = np.arange(len(bwt))
    out[bwt == 0] = -1
    return out


def interleave(bwts: list[np.ndarray], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Merges transforms: the rows, by their first `rounds` symbols, that share these with another row, and their block numbers. A row is
    its number in the concatenation of all transforms. Each round stably deals the rows by the symbol before them; new neighbours agree in
    one symbol more if they agree in that symbol and their rows came from one block. A row that is alone in its block leads to rows that
    are alone, so it is dropped."""
    base = np.cumsum([0, *(len(b) for b in bwts)])
    symbol = np.concatenate(bwts)
    before = np.concatenate([np.where(f < 0, -1, f + b).astype(np.int32) for f, b in zip(map(_last_to_first, bwts), base)])
    rows, block = np.arange(len(symbol), dtype=np.int32), np.zeros(len(symbol), np.int32)
    for _ in range(rounds):
        dealt = symbol[rows]
        order = np.argsort(dealt, kind="stable")[int((dealt == 0).sum()):]  # a string's start has nothing before it
        kind, old = dealt[order], block[order]
        new = np.ones(len(order) + 1, bool)
        new[1:-1] = (kind[1:] != kind[:-1]) | (old[1:] != old[:-1])
        shared = ~(new[:-1] & new[1:])
        rows, block = before[rows[order[shared]]], np.cumsum(new[:-1][shared], dtype=np.int32)
    return rows, block


def places(bwt: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(string, offset) of each row, by walking all strings backwards at once."""
    back = _last_to_first(bwt)
    string, offset = np.zeros(len(bwt), np.int32), np.zeros(len(bwt), np.int32)
    row, mine, left = np.arange(len(sizes)), np.arange(len(sizes)), sizes.astype(np.int64)
    while len(row):
        string[row], offset[row] = mine, left
        row = back[row]
        more = row >= 0
        row, mine, left = row[more], mine[more], left[more] - 1
    return string, offset


def _transforms(docs: DataFrame, asked: DataFrame, shards: int, length: int) -> DataFrame:
    """Per task and minimizer shard: the transform of its segments (c0), and their doc, start, windows (c1, c2, c3)."""
    def scan(batches):
        held, size = {}, 0

        def flush():
            rows = []
            for k, parts in held.items():
                texts, d, s, r = zip(*parts)
                rows.append((k, ASK, transform(list(texts)).tobytes(), *(np.array(x, np.int64).tobytes() for x in (d, s, r))))
            held.clear()
            return _batch(rows)

        for batch in batches:
            for doc, text, runs in zip(*(batch.column(c).to_pylist() for c in ("doc", "text", "runs"))):
                raw = np.frombuffer(text.encode(), np.uint8)
                runs = np.frombuffer(runs, np.int64).reshape(-1, 3)
                for k, (s, r, _) in zip(_shards(runs[:, 2].copy().view(np.uint64), shards).tolist(), runs.tolist()):
                    if s + r + length - 1 > len(raw):
                        continue  # another text of the same id
                    held.setdefault(k, []).append((raw[s:s + r + length - 1], doc, s, r))
                    size += r + length - 1
                if size > 8 << 20:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    # a repeated row would send its segments twice
    return _with_runs(docs.filter("text is not null"), asked, "inner").select("doc", "text", "runs").mapInArrow(scan, PACKED)


def _repeats(transforms: DataFrame, shards: int, length: int) -> DataFrame:
    """Merges the transforms of each shard; the later windows of each repeated interval as runs by document shard."""
    def merge(key, table):
        bwts, docs, starts, windows = [], [], [], []
        for i in range(table.num_rows):
            b, d, s, r = (np.frombuffer(table[f"c{k}"][i].as_py(), t) for k, t in enumerate((np.uint8, np.int64, np.int64, np.int64)))
            bwts.append(b)
            docs.append(d)
            starts.append(s)
            windows.append(r)
        rows, block = interleave(bwts, length)
        where = [places(b, r + length - 1) for b, r in zip(bwts, windows)]
        base = np.cumsum([0, *(len(d) for d in docs)], dtype=np.int32)
        string = np.concatenate([w[0] + b for w, b in zip(where, base)])[rows]
        offset = np.concatenate([w[1] for w in where])[rows]
        keep = offset < np.concatenate(windows)[string]
        string, offset, block = string[keep], offset[keep], block[keep]
        doc, at = np.concatenate(docs)[string], np.concatenate(starts)[string] + offset
        order = np.lexsort((at, doc, block))
        doc, at, block = doc[order], at[order], block[order]
        later = np.r_[False, (block[1:] == block[:-1])]
        # the first place of a block may come twice, from a repeated row
        head = np.flatnonzero(~later)[np.cumsum(~later) - 1] if len(doc) else np.zeros(0, np.int64)
        later &= (doc != doc[head]) | (at != at[head])
        d, s, n = _merge_runs(doc[later], at[later], np.full(int(later.sum()), length))
        return pa.Table.from_batches([_batch(_pack(_shards(d.view(np.uint64), shards), shards, DUP, d, s, n))])

    return transforms.groupBy("shard").applyInArrow(merge, PACKED)


def repeated_runs(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc, runs): maximal runs of bytes to remove, as packed (start, size), of (doc, text) rows."""
    shards = max(1, -(-docs.count() // SHARD_DOCS))
    places = stored(_first_places(_sieve(docs, shards, length), shards, length), "repeat-places")
    asked = stored(_per_document(places, ASK), "repeat-asked")
    merged = _repeats(_transforms(docs, asked, shards, length), shards, length)
    return stored(_per_document(places.unionByName(merged), DUP), "repeat-runs")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(doc, n_bytes, n_removed, n_spans, kept) per row; kept: the remaining bytes."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.col(text_col).alias("text"))

    def cut(batches):
        for whole in batches:
            for batch in W.slices(whole, "text"):
                buf, offsets = W.buffers(batch.column("text"))
                out = []
                for doc, runs, a, b in zip(batch.column("doc").to_pylist(), batch.column("runs").to_pylist(), offsets.tolist(), offsets[1:].tolist()):
                    keep = np.ones(b - a, bool)
                    spans = np.frombuffer(runs or b"", np.int64).reshape(-1, 2)
                    for s, n in spans.tolist():
                        keep[s:s + n] = False
                    out.append((None if doc == NO_ID else doc, b - a, int((~keep).sum()), len(spans), buf[a:b][keep].tobytes()))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), (*[pa.int64()] * 4, pa.binary()))], ["doc", "n_bytes", "n_removed", "n_spans", "kept"])

    return _with_runs(rows, repeated_runs(rows, length), "left").select("doc", "text", "runs").mapInArrow(cut, "doc long, n_bytes long, n_removed long, n_spans long, kept binary")
