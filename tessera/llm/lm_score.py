"""Cross-entropy difference between a target and a background n-gram model.

The background model counts every document, the target model the trusted ones; both use the same vocabulary, the same inventory of word
pairs and the same smoothing. Words and pairs are named by 64-bit hashes. The vocabulary holds every word that the corpus has at least LEAST
times, the inventory every such pair, at any size of the corpus, so the model grows with the input and no task holds it.

Texts are hashed once and stored in chunks of a bounded number of tokens, or one text. Each chunk sends its distinct words and pairs with
their counts, packed, to the shards of the key space; a shard sums them and answers each chunk with the sums of the keys that it sent. A
chunk is then scored with its own answers.

    p(w | v) = weight * c(v, w) / c(v) + (1 - weight) * (c(w) + 1) / (n + size + 1)

with all words outside the vocabulary as one class; a pair outside the inventory has no first term. The score of a document is its mean
target loss less its mean background loss in nats: the lower, the closer to the target.

Defined results: null and empty texts have no tokens and null losses; a document may be repeated; without trusted documents the target
model is uniform; an empty table gives no rows. Only the named columns are read."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import words as W
from tessera.llm.folders import stored

WEIGHT = 0.6
LEAST = 2  # words and pairs seen less often are not in the model
CHUNK_TOKENS = 1_000_000
SHARD_TOKENS = 2_000_000
BROADCAST_ROWS = 1_000_000


def text_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, first word of each text and the end)."""
    raw, offsets = W.buffers(texts)
    buf = W.LOWER[raw]
    starts, ends = W.spans(buf, offsets, W.SPACES)
    return W.word_hashes(buf, starts, ends), np.searchsorted(starts, offsets)


def frequent(counts: DataFrame, size: int) -> pa.Table:
    """The stored counts from the lowest count on whose entries are at most `size`, by key. The result is bounded by `size`."""
    levels = sorted(((r["n"], r["k"]) for r in counts.groupBy("n").agg(F.count("*").alias("k")).collect()), reverse=True)
    least, total = None, 0
    for n, k in levels:
        total += k
        if total > size:
            break
        least = n
    rows = (counts.filter(F.col("n") >= least) if least is not None else counts.limit(0)).toArrow()
    return rows.sort_by(rows.column_names[0])


def tagged(docs: DataFrame, trusted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, text, target). Trusted ids are broadcast while their count is small, else joined by shuffle."""
    ids = stored(trusted.select(F.col(id_col).alias("key")).filter("key is not null").distinct().withColumn("_t", F.lit(True)), "lm-trusted")
    keyed = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    return keyed.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, "key", "left").select("key", "text", F.coalesce("_t", F.lit(False)).alias("target"))


def tokens(docs: DataFrame, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """Chunks of (key, text, target) rows: (chunk, n, n_target, keys, lengths, target, words, ids). `words` are the distinct hashes, most
    frequent first, `ids` the places of the tokens in them as compressed byte planes."""
    def scan(batches):
        part, made, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            keys, lengths, target, hashes = zip(*held)
            n, flags, h = np.concatenate(lengths), np.concatenate(target), np.concatenate(hashes)
            words, ids, count = np.unique(h, return_inverse=True, return_counts=True)
            order = np.argsort(-count, kind="stable")
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order))
            planes = rank[ids].astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
            keys = pa.concat_arrays(keys)
            return pa.record_batch([
                pa.array([part << 32 | made], pa.int64()), pa.array([len(h)], pa.int64()), pa.array([int(n[flags].sum())], pa.int64()),
                pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys),
                *(pa.array([x], pa.binary()) for x in (n.astype("<i8").tobytes(), flags.tobytes(), words[order].tobytes(), pa.compress(planes, "zstd", asbytes=True)))],
                ["chunk", "n", "n_target", "keys", "lengths", "target", "words", "ids"])

        for whole in batches:
            for batch in W.slices(whole, "text"):
                hashes, first = text_words(batch.column("text"))
                held.append((batch.column("key"), np.diff(first), batch.column("target").to_numpy(zero_copy_only=False).astype(bool), hashes))
                size += len(hashes) + batch.num_rows
                if size > chunk_tokens:
                    yield flush()
                    made, held, size = made + 1, [], 0
        if held:
            yield flush()

    kind = docs.schema["key"].dataType.simpleString()
    return docs.select("key", "text", "target").mapInArrow(
        scan, f"chunk long, n long, n_target long, keys array<{kind}>, lengths binary, target binary, words binary, ids binary")


class Chunk:
    """The distinct words and pairs of a chunk, ascending, and the place in them of each token and of the pair that ends with it (or -1)."""

    def __init__(self, n: int, lengths: bytes, target: bytes, words: bytes, ids: bytes):
        self.lengths = np.frombuffer(lengths, "<i8")
        self.target = np.repeat(np.frombuffer(target, bool), self.lengths)
        raw, words = pa.decompress(ids, 4 * n, "zstd", asbytes=True), np.frombuffer(words, np.uint64)
        ids = np.frombuffer(raw, np.uint8).reshape(4, n).T.copy().view("<u4").ravel()
        order = np.argsort(words)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.words, self.word = words[order], place[ids]
        inside = np.ones(n, bool)
        starts = np.cumsum(self.lengths) - self.lengths
        inside[starts[self.lengths > 0]] = False
        self.pair = np.full(n, -1, np.int64)
        self.pairs, self.pair[inside] = np.unique(W.window_hashes(words[ids], 2)[inside[1:]], return_inverse=True)

    def counts(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(keys, n, n_target) of the words and of the pairs."""
        inside = self.pair >= 0
        return [(k, np.bincount(at, minlength=len(k)), np.bincount(at[t], minlength=len(k)))
                for k, at, t in ((self.words, self.word, self.target), (self.pairs, self.pair[inside], self.target[inside]))]

    def cuts(self, shards: int) -> list[np.ndarray]:
        """For the words and the pairs, where the keys of each shard begin, and the end."""
        return [np.searchsorted((k >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32), np.arange(shards + 1)) for k in (self.words, self.pairs)]


PARTS = ("n", "lengths", "target", "words", "ids")
SENT = [f"{kind}_{what}" for kind in ("word", "pair") for what in ("keys", "n", "t")]
ANSWER = [f"{kind}_{what}" for kind in ("word", "pair") for what in ("n", "t")]


def totals(chunks: DataFrame, shards: int) -> DataFrame:
    """(chunk, shard, sums of the keys that the chunk sent to the shard, 0 for those not in the model). A row of chunk -1 has the shard's
    number of vocabulary words and their two counts in place of the word sums."""
    def send(batches):
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk(*(row[c] for c in PARTS))
                cuts, kinds = chunk.cuts(shards), chunk.counts()
                for s in range(shards):
                    out = []
                    for cut, (k, n, t) in zip(cuts, kinds):
                        a, b = cut[s], cut[s + 1]
                        out += [k[a:b].tobytes(), n[a:b].astype("<i8").tobytes(), t[a:b].astype("<i8").tobytes()]
                    if out[0] or out[3]:
                        yield pa.record_batch([pa.array([s], pa.int32()), pa.array([row["chunk"]], pa.int64()), *(pa.array([x], pa.binary()) for x in out)], ["shard", "chunk", *SENT])

    def add(key, table):
        size = table.num_rows
        answers, stats = [], b""
        for kind in ("word", "pair"):
            keys, n, t = (table[f"{kind}_{x}"].to_pylist() for x in ("keys", "n", "t"))
            ends = np.cumsum([len(x) // 8 for x in keys])
            k, n, t = np.frombuffer(b"".join(keys), np.uint64), np.frombuffer(b"".join(n), "<i8"), np.frombuffer(b"".join(t), "<i8")
            order = np.argsort(k)
            head = np.flatnonzero(np.r_[True, k[order[1:]] != k[order[:-1]]]) if len(k) else np.zeros(0, np.int64)
            sums = np.stack([np.add.reduceat(x[order], head) if len(k) else x for x in (n, t)])
            sums[:, sums[0] < LEAST] = 0
            if kind == "word":
                stats = np.array([(sums[0] > 0).sum(), *sums.sum(1)], "<i8").tobytes()
            back = np.empty((2, len(k)), "<i8")
            back[:, order] = np.repeat(sums, np.diff(np.r_[head, len(k)]), axis=1)
            answers += [[pa.compress(x[a:b].tobytes(), "zstd", asbytes=True) for a, b in zip(np.r_[0, ends], ends)] + [y] for x, y in zip(back, (stats, b""))]
            stats = b""
        return pa.table({"chunk": pa.array([*table["chunk"].to_pylist(), -1], pa.int64()), "shard": pa.array([key[0].as_py()] * (size + 1), pa.int32()),
                         **{c: pa.array(x, pa.binary()) for c, x in zip(ANSWER, answers)}})

    sent = chunks.select("chunk", *PARTS).mapInArrow(send, "shard int, chunk long, " + ", ".join(f"{c} binary" for c in SENT))
    return sent.groupBy("shard").applyInArrow(add, "chunk long, shard int, " + ", ".join(f"{c} binary" for c in ANSWER))


def losses(chunk: Chunk, word: np.ndarray, pair: np.ndarray, whole: np.ndarray, other: np.ndarray, size: int, weight: float) -> np.ndarray:
    """(background, target) loss of each token, from (2, keys) sums of the chunk's words and pairs."""
    c = np.where(word[0] > 0, word, other[:, None])
    uni = (c + 1) / (whole + size + 1)[:, None]
    loss = -np.log((1 - weight) * uni)[:, chunk.word]
    at = np.flatnonzero(chunk.pair >= 0)
    at = at[pair[0, chunk.pair[at]] > 0]
    left, right, both = chunk.word[at - 1], chunk.word[at], pair[:, chunk.pair[at]]
    with np.errstate(divide="ignore", invalid="ignore"):
        share = np.where(c[:, left] > 0, both / c[:, left], uni[:, right])
    loss[:, at] = -np.log(weight * share + (1 - weight) * uni[:, right])
    return loss


def cross_entropy_difference(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", weight: float = WEIGHT,
                             chunk_tokens: int = CHUNK_TOKENS, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Fits both models on all documents and scores every document: (key, n_tokens, target_loss, background_loss, score). The first word
    of a text has no pair."""
    rows = tagged(docs, trusted, id_col, text_col)
    kind = rows.schema["key"].dataType.simpleString()
    chunks = stored(tokens(rows, chunk_tokens), "lm-tokens")
    n = chunks.agg(F.sum("n"), F.sum("n_target")).first()
    whole = np.array([n[0] or 0, n[1] or 0], np.float64)
    shards = max(1, -(-int(whole[0]) // shard_tokens))
    sums = stored(totals(chunks, shards), "lm-totals")
    stats = np.zeros(3, np.int64)
    for r in sums.filter("chunk < 0").select("word_n").toLocalIterator():
        stats += np.frombuffer(bytes(r[0]), "<i8")
    size, other = int(stats[0]), whole - stats[1:]

    def score(_, mine, answers):
        row = mine.to_pylist()[0]
        chunk = Chunk(*(row[c] for c in PARTS))
        cuts, got = chunk.cuts(shards), [np.zeros((2, len(k)), np.int64) for k in (chunk.words, chunk.pairs)]
        for r in answers.to_pylist():
            for cut, out, kind in zip(cuts, got, ("word", "pair")):
                a, b = (int(x) for x in cut[r["shard"]:r["shard"] + 2])
                for line, what in zip(out, ("n", "t")):
                    line[a:b] = np.frombuffer(pa.decompress(r[f"{kind}_{what}"], 8 * (b - a), "zstd", asbytes=True), "<i8")
        loss = losses(chunk, *got, whole, other, size, weight)
        n = chunk.lengths
        full = n > 0
        mean = np.full((2, len(n)), np.nan)
        if full.any():
            mean[:, full] = np.add.reduceat(loss, (np.cumsum(n) - n)[full], axis=1) / n[full]
        return pa.table({"key": mine["keys"].combine_chunks().flatten(), "n_tokens": pa.array(n, pa.int64()), **{
            c: pa.array(x, pa.float64(), mask=~full) for c, x in (("target_loss", mean[1]), ("background_loss", mean[0]), ("score", mean[1] - mean[0]))}})

    both = chunks.select("chunk", "keys", *PARTS).groupBy("chunk").cogroup(sums.filter("chunk >= 0").groupBy("chunk"))
    return both.applyInArrow(score, f"key {kind}, n_tokens long, target_loss double, background_loss double, score double")
