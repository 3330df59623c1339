"""Benchmark decontamination by a hash set of normalised n-grams.

Every benchmark item becomes windows of 13 normalised words (an item of fewer words is one window of its own length). Their hashes go to the
tasks, which roll the same hashes over every document, verify each hash hit against the window's words, and report the covered words,
character spans and items. The set sent to the tasks is bounded: a benchmark of more than `block_windows` windows is taken in blocks. Only
two blocks are held at a time; each pass over the documents stores its hits and frees its block, and the stored passes are united per document.

Defined results: null, empty and punctuation-only texts have no words and hit nothing; repeated rows give one result row each; an empty
benchmark leaves all documents clean; an item without words has no window. Only the named columns are read."""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import words as W
from tessera.llm.folders import stored

WORDS = 13
BLOCK_WINDOWS = 500_000
SCHEMA = "n_words long, hits binary, items array<string>, spans array<struct<start:long,end:long>>"


def _normal(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    return b" ".join(buf[a:b].tobytes() for a, b in zip(starts, ends))


def windows(items: DataFrame, n: int = WORDS) -> DataFrame:
    """(length, hash, window, item): the distinct windows of every item."""
    def cut(batches):
        for batch in batches:
            buf, offsets = W.buffers(batch.column("text"))
            buf = W.LOWER[buf]
            starts, ends = W.spans(buf, offsets, W.NOT_ALNUM)
            hashes = W.word_hashes(buf, starts, ends)
            first = np.searchsorted(starts, offsets)
            rows = set()
            for k, item in enumerate(batch.column("item").to_pylist()):
                a, b = int(first[k]), int(first[k + 1])
                size = min(n, b - a)
                if not size or item is None:
                    continue
                for i, h in enumerate(W.window_hashes(hashes[a:b], size)):
                    rows.add((size, int(h.view(np.int64)), _normal(buf, starts[a + i:a + i + size], ends[a + i:a + i + size]), item))
            cols = list(zip(*rows)) or [[], [], [], []]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.string()))],
                                  ["length", "hash", "window", "item"])

    return items.mapInArrow(W.tidy(cut), "length long, hash long, window binary, item string").distinct()


def _scan(block) -> "callable":
    """A task function over (key, text) batches for one broadcast block of windows."""
    def scan(batches):
        by_length = block.value
        for whole in batches:
            for batch in W.slices(whole, "text"):
                raw, offsets = W.buffers(batch.column("text"))
                buf = W.LOWER[raw]
                starts, ends = W.spans(buf, offsets, W.NOT_ALNUM)
                hashes = W.word_hashes(buf, starts, ends)
                first = np.searchsorted(starts, offsets)
                last = np.repeat(first[1:], np.diff(first))  # the end of each word's text
                rows = batch.num_rows
                found: dict[int, tuple[list, set]] = {}
                for size, (keys, near, exact) in by_length.items():
                    rolled = W.window_hashes(hashes, size)
                    at = np.flatnonzero(near[(rolled >> np.uint64(44)).astype(np.int64)])
                    at = at[(at + size <= last[at]) & (keys[np.minimum(np.searchsorted(keys, rolled[at]), len(keys) - 1)] == rolled[at])]
                    for i, doc in zip(at.tolist(), (np.searchsorted(first, at, "right") - 1).tolist()):
                        items = exact.get(_normal(buf, starts[i:i + size], ends[i:i + size]))
                        if items:
                            mine = found.setdefault(doc, ([], set()))
                            mine[0].append((i, size))
                            mine[1].update(items)
                hits, items, spans = [b""] * rows, [[]] * rows, [[]] * rows
                for doc, (places, names) in found.items():
                    p = np.array(sorted(places), np.int64)
                    runs = W.covered(p[:, 0], p[:, 1])
                    text = raw[offsets[doc]:offsets[doc + 1]]
                    chars = np.r_[0, np.cumsum((text & 0xC0) != 0x80)]
                    base = offsets[doc]
                    spans[doc] = [{"start": int(chars[starts[a] - base]), "end": int(chars[ends[b - 1] - base])} for a, b in runs]
                    hits[doc], items[doc] = (runs - first[doc]).astype("<i8").tobytes(), sorted(names)
                keep = [c for c in batch.schema.names if c != "text"]
                yield pa.record_batch(
                    [*(batch.column(c) for c in keep), pa.array(np.diff(first), pa.int64()), pa.array(hits, pa.binary()),
                     pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                    [*keep, "n_words", "hits", "items", "spans"])
    return scan


def _blocks(found: DataFrame, most: int):
    """The windows in bounded blocks, each fetched alone and indexed by length."""
    found = found.withColumn("block", F.lit(0))
    total = found.count()
    parts = max(1, -(-total // most))
    if parts > 1:
        found = found.withColumn("block", F.expr(f"cast(pmod(hash, {2 * parts}) as int)"))
    for b in range(1 if parts == 1 else 2 * parts):
        rows = (found.filter(F.col("block") == b) if parts > 1 else found).select("length", "hash", "window", "item").toArrow()
        out: dict[int, tuple] = {}
        for length in sorted(set(rows["length"].to_pylist())):
            mine = rows.filter(pa.compute.equal(rows["length"], length))
            keys = np.unique(mine["hash"].to_numpy().view(np.uint64))
            near = np.zeros(1 << 20, bool)
            near[(keys >> np.uint64(44)).astype(np.int64)] = True
            exact: dict[bytes, list] = {}
            for w, item in zip(mine["window"].to_pylist(), mine["item"].to_pylist()):
                exact.setdefault(w, []).append(item)
            out[length] = (keys, near, exact)
        yield out


def _merge(hits: bytes) -> bytes:
    runs = np.frombuffer(hits, "<i8").reshape(-1, 2)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    return W.covered(runs[:, 0], runs[:, 1] - runs[:, 0]).astype("<i8").tobytes()


def scan(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
         item_text: str = "text", n: int = WORDS, block_windows: int = BLOCK_WINDOWS, keep: DataFrame | None = None) -> DataFrame:
    """One row per document: key, n_words, hits (runs of hit words), items, spans (characters of the hit runs)."""
    spark = docs.sparkSession
    found = windows(items.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).alias("text")), n)
    keyed = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    key_type = keyed.schema["key"].dataType
    kind, parts = key_type.simpleString(), []
    out = f"key {kind}, {SCHEMA}"
    blocks = _blocks(found, block_windows)
    block, more = next(blocks), next(blocks, None)
    if more is None:
        return keyed.mapInArrow(_scan(spark.sparkContext.broadcast(block)), out)
    # rows that are equal in id must stay apart over the passes
    keyed = stored(keyed.withColumn("row", F.monotonically_increasing_id()), "scanned")
    while block is not None:
        shared = spark.sparkContext.broadcast(block)
        one = keyed.select("key", "row", "text").mapInArrow(_scan(shared), f"key {kind}, row long, {SCHEMA}")
        # the first pass stands for every document, the others add hits
        parts.append(stored(one if not parts else one.filter(F.size("items") > 0), "hits"))
        shared.destroy()
        block, more = more, next(blocks, None)

    def unite(batches):
        for batch in batches:
            hits, items, spans = (batch.column(c).to_pylist() for c in ("hits", "items", "spans"))
            yield pa.record_batch([
                batch.column("key"), batch.column("n_words"), pa.array([_merge(b"".join(h)) for h in hits], pa.binary()),
                pa.array([sorted({y for x in i for y in x}) for i in items], pa.list_(pa.string())),
                pa.array([_runs([(y["start"], y["end"]) for x in s for y in x]) for s in spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                ["key", "n_words", "hits", "items", "spans"])

    grouped = functools.reduce(DataFrame.unionByName, parts).groupBy("row").agg(
        F.first("key").alias("key"), F.first("n_words").alias("n_words"), F.collect_list("hits").alias("hits"),
        F.collect_list("items").alias("items"), F.collect_list("spans").alias("spans")).drop("row")
    return grouped.mapInArrow(W.tidy(unite), out)


def _runs(spans: list[tuple[int, int]]) -> list[dict]:
    out: list[dict] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]["end"]:
            out[-1]["end"] = max(b, out[-1]["end"])
        else:
            out.append({"start": a, "end": b})
    return out


def report(found: DataFrame) -> DataFrame:
    """Counts per document. Contaminated: at least one twentieth of its words are hit."""
    def digest(batches):
        for batch in batches:
            runs = [np.frombuffer(x, "<i8").reshape(-1, 2) for x in batch.column("hits").to_pylist()]
            hit = np.array([int((r[:, 1] - r[:, 0]).sum()) for r in runs], np.int64)
            items = batch.column("items").to_pylist()
            words = batch.column("n_words").to_numpy()
            yield pa.record_batch(
                [batch.column("key"), batch.column("n_words"), pa.array(hit), pa.array([len(x) for x in items], pa.int64()),
                 pa.array([hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items]),
                 pa.array((hit > 0) & (20 * hit >= words))],
                ["key", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    kind = found.schema["key"].dataType.simpleString()
    return found.select("key", "n_words", "hits", "items").mapInArrow(
        digest, f"key {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def remove_spans(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """All documents with (key, text): the hit runs are cut out of the text."""
    found = scan(docs.select(F.struct("doc_id", "text").alias("both"), "text"), items, id_col="both", **how)

    def cut(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                text, at, parts = row["key"]["text"], 0, []
                for s in row["spans"]:
                    parts.append(text[at:s["start"]])
                    at = s["end"]
                out.append({"doc_id": row["key"]["doc_id"], "text": None if text is None else "".join(parts) + text[at:]})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("doc_id", batch.schema.field("key").type.field("doc_id").type), ("text", pa.string())]))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return found.select("key", "spans").mapInArrow(W.tidy(cut), f"doc_id {kind}, text string")


def clean_documents(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """Documents that are not contaminated, with all their columns; the row itself is the key, so nothing is joined."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    found = report(scan(docs.select(whole.alias("row_"), F.col("text").alias("text")), items, id_col="row_", **how))
    return found.filter(~F.col("contaminated")).select(*[F.col("key").getField(c).alias(c) for c in docs.columns])
