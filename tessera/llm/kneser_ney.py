"""Quality classifier: perplexity under an interpolated modified Kneser-Ney trigram model of trusted text.

The model is fitted on every trusted document that is not held out (a bounded sample only on request). Texts are hashed once and stored in
chunks of a bounded number of tokens, or one text (see `lm_score.tokens`). A token with the two words before it is sent to the shard of the
middle word, so one shard has the counts of the triple, of its context, of the pair and of the pair's context; after a common word the shard
is that of the pair, after a common pair that of the triple, and the sums that this splits are added up apart. A first pass over the training
texts gives the levels of the counts and in how many pairs each word ends; a second one over all texts counts again, scores each token where
its counts are, and sends back one sum per text. Both passes take a range of shards at a time, whose shuffles are removed before the next, so
the disk holds the chunks and a part of the n-grams. No task and no broadcast holds a whole table.

Every fifth trusted id, by hash, is held out of the fit. A document is kept when its perplexity is at most the threshold of its language: the
stated quantile of the held-out trusted documents of that language, over all of them. The quantile is exact on perplexities' logarithms rounded to four digits. A language without trusted documents
takes the largest threshold. Defined results: null and empty texts have no tokens, null perplexity, and are not kept; a null language is a
language of its own; repeated rows give one row each; an empty table gives no rows; without trusted text everything with words is kept."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import words as W
from tessera.llm.folders import dropped, freed, get_bytes, new_folder, put_bytes, shuffles_freed, stored
from tessera.llm.lm_score import PARTS, SHARD_TOKENS, tagged, text_words, tokens

QUANTILE = 0.995
HELD_OUT = "pmod(xxhash64(key), 5) = 0"
START = np.uint64(0x5107A9E3C0DE11D7)  # the word before the first
CHUNK, ROUNDS, COUNT_ROUNDS = 2_000_000, 10, 3  # ranges of shards; the n-grams of one range are on disk at a time
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return W.mix(a * _K1 + W.mix(b + _K2))


def text_ngrams(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two words before each word, with START before a text's first word."""
    one = np.full(len(hashes), START, np.uint64)
    two = one.copy()
    one[1:], two[2:] = hashes[:-1], hashes[:-2]
    begin = first[:-1][np.diff(first) > 0]
    one[begin] = START
    two[begin] = START
    two[begin[begin + 1 < len(hashes)] + 1] = START
    return two, one


def training_set(docs: DataFrame, trusted: DataFrame, train_docs: int, train_tokens: int) -> DataFrame:
    """The bounded sample. At most `train_docs` ids reach the driver's broadcast. A text that alone takes more than a twentieth of the words
    is left out, so no text ends the sample before its bound is nearly reached."""
    chosen = trusted.select("key").filter(f"key is not null and not {HELD_OUT}").distinct().orderBy(F.expr("xxhash64(key)"), "key").limit(train_docs)
    rows = docs.join(F.broadcast(chosen), "key").select("key", "text")
    sized = rows.withColumn("n", F.size(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"))).filter(F.col("n") <= max(1, train_tokens // 20))
    # at most train_docs rows meet in this window
    total = F.sum("n").over(Window.orderBy(F.expr("xxhash64(key)"), "key", "n").rowsBetween(Window.unboundedPreceding, 0))
    return sized.withColumn("total", total).filter(F.col("total") <= train_tokens).select("text")


@dataclass(frozen=True)
class Model:
    """Ascending keys with their values; `back` is the weight that a context leaves to the lower order."""
    tri: tuple[np.ndarray, np.ndarray]  # key of (u, v, w) -> p
    bi: tuple[np.ndarray, np.ndarray]  # key of (v, w) -> p
    bi_back: tuple[np.ndarray, np.ndarray]  # key of (u, v) -> weight
    uni: tuple[np.ndarray, np.ndarray]  # w -> p
    uni_back: tuple[np.ndarray, np.ndarray]  # v -> weight
    unknown: float


def discounts(counts: DataFrame) -> list[float]:
    n = {r["c"]: r["k"] for r in counts.filter("c <= 4").groupBy("c").agg(F.count("*").alias("k")).collect()}
    return discounts_of([n.get(i, 0) for i in (1, 2, 3, 4)])


def discounts_of(levels: Sequence[int]) -> list[float]:
    """D1, D2 and D3+ of modified Kneser-Ney from the counts of counts 1 to 4."""
    n1, n2, n3, n4 = (int(n) for n in levels)
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
    out = [i - (i + 1) * y * b / a if a else 0.75 for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return [min(max(d, 0.05), i - 0.05) for i, d in zip((1, 2, 3), out)]


def _by_count(d: list[float]):
    return F.when(F.col("c") == 1, F.lit(d[0])).when(F.col("c") == 2, F.lit(d[1])).otherwise(F.lit(d[2]))


def _contexts(counts: DataFrame, context: list[str], d: list[float]) -> DataFrame:
    """(context, total, back)."""
    left = sum(F.lit(x) * F.sum(F.when(when, 1).otherwise(0)) for x, when in zip(d, (F.col("c") == 1, F.col("c") == 2, F.col("c") > 2)))
    return counts.groupBy(*context).agg(F.sum("c").alias("total"), left.alias("left")).select(*context, "total", (F.col("left") / F.col("total")).alias("back"))


def tables(training: DataFrame) -> tuple[dict[str, DataFrame], float]:
    """The model of (text) rows as tables of n-grams with a value, and the probability of an unknown word: p of (u, v, w), of (v, w) and of w,
    and the weight that the contexts (u, v) and v leave to the lower order."""
    def grams(batches):
        for whole in batches:
            for batch in W.slices(whole, "text"):
                hashes, first = text_words(batch.column("text"))
                yield pa.record_batch([pa.array(x.view(np.int64)) for x in (*text_ngrams(hashes, first), hashes)], ["u", "v", "w"])

    tri = stored(training.select("text").mapInArrow(grams, "u long, v long, w long").groupBy("u", "v", "w").agg(F.count("*").alias("c")), "kn-3")
    bi = stored(tri.groupBy("v", "w").agg(F.count("*").alias("c")), "kn-2")
    uni = stored(bi.groupBy("w").agg(F.count("*").alias("c")), "kn-1")
    d3, d2, d1 = (discounts(x) for x in (tri, bi, uni))
    whole = uni.agg(F.count("*").alias("types"), F.sum("c").alias("total"), F.sum(_by_count(d1)).alias("left")).first()
    types, total = whole["types"] or 0, whole["total"] or 1
    unknown = (whole["left"] or 1.0) / total / (types + 1)
    p1 = stored(uni.select("w", ((F.col("c") - _by_count(d1)) / total + F.lit(unknown)).alias("p")), "kn-p1")
    c2 = stored(_contexts(bi, ["v"], d2), "kn-c2")
    p2 = stored(bi.join(c2, "v").join(p1.withColumnRenamed("p", "lower"), "w").select(
        "v", "w", ((F.col("c") - _by_count(d2)) / F.col("total") + F.col("back") * F.col("lower")).alias("p")), "kn-p2")
    c3 = stored(_contexts(tri, ["u", "v"], d3), "kn-c3")
    p3 = tri.join(c3, ["u", "v"]).join(p2.withColumnRenamed("p", "lower"), ["v", "w"]).select(
        "u", "v", "w", ((F.col("c") - _by_count(d3)) / F.col("total") + F.col("back") * F.col("lower")).alias("p"))
    return {"tri": p3.select("u", "v", "w", "p"), "bi": p2.select("v", "w", "p"), "bi_back": c3.select("u", "v", "back"),
            "uni": p1.select("w", "p"), "uni_back": c2.select("v", "back")}, unknown


def _keys(parts: list[np.ndarray]) -> np.ndarray:
    k = parts[0]
    for x in parts[1:]:
        k = pair_key(k, x)
    return k


def fit(training: DataFrame) -> Model:
    """The model of a few (text) rows in one place."""
    def arrays(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        rows = df.toArrow()
        k = _keys([rows[c].to_numpy().view(np.uint64) for c in rows.column_names[:-1]])
        order = np.argsort(k)
        return k[order], rows[rows.column_names[-1]].to_numpy().astype(np.float32)[order]

    parts, unknown = tables(training)
    return Model(**{name: arrays(df) for name, df in parts.items()}, unknown=unknown)


def look(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray, missing: float) -> np.ndarray:
    have, values = table
    if not len(have):
        return np.full(len(keys), missing)
    at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
    return np.where(have[at] == keys, values[at].astype(np.float64), missing)


def token_probabilities(m: Model, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """p(word | two words before) of every word; a sum of backed-off terms is only formed where the higher order is unseen."""
    u, v = text_ngrams(hashes, first)
    uv, vw = pair_key(u, v), pair_key(v, hashes)
    p = look(m.tri, pair_key(uv, hashes), -1.0)
    i = np.flatnonzero(p < 0)
    low = look(m.bi, vw[i], -1.0)
    j = np.flatnonzero(low < 0)
    low[j] = look(m.uni_back, v[i[j]], 1.0) * look(m.uni, hashes[i[j]], m.unknown)
    p[i] = look(m.bi_back, uv[i], 1.0) * low
    return p


@dataclass(frozen=True)
class Common:
    """Words and pairs, ascending, that have too many tokens for one shard. The n-grams after such a word are dealt out by the pair that ends
    with it, those after such a pair by the whole triple."""
    words: np.ndarray
    pairs: np.ndarray


def within(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(keys), bool)
    return sorted_keys[np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)] == keys


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)


def heads_of(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ascending distinct keys, their sums, the place of one row of each)."""
    order = np.argsort(keys)
    head = heads_of(keys[order])
    return keys[order][head], np.add.reduceat(n[order], head) if len(head) else n[:0], order[head]


def levels(c: np.ndarray, top: int) -> np.ndarray:
    """How many counts are 1, 2, ... and `top` or more."""
    return np.bincount(np.minimum(c, top), minlength=top + 1)[1:].astype(np.int64)


def packed(*columns: np.ndarray) -> bytes:
    """Hashes as they are, numbers of 32 bits as byte planes, compressed."""
    return pa.compress(b"".join(c.tobytes() if c.itemsize == 8 else W.planes(c) for c in columns), "zstd", asbytes=True)


def unpacked(data: bytes, *kinds: tuple[type, int]) -> list[np.ndarray]:
    raw, at, out = pa.decompress(data, sum(np.dtype(kind).itemsize * n for kind, n in kinds), "zstd", asbytes=True), 0, []
    for kind, n in kinds:
        size = np.dtype(kind).itemsize * n
        out.append(np.frombuffer(raw, kind, n, at) if np.dtype(kind).itemsize == 8 else W.from_planes([raw[at:at + size]], kind))
        at += size
    return out


class Chunk:
    """The distinct words of a chunk, START last, and per token the places in them of w and of the two words u, v before it."""

    def __init__(self, n: int, lengths: bytes, target: bytes, words: bytes, ids: bytes):
        self.n, self.lengths = n, np.frombuffer(lengths, "<i8")
        self.target = np.repeat(np.frombuffer(target, bool), self.lengths)
        planes = np.frombuffer(pa.decompress(ids, 4 * n, "zstd", asbytes=True), np.uint8)
        self.words, self.w = np.r_[np.frombuffer(words, np.uint64), START], planes.reshape(4, n).T.copy().view("<u4").ravel()
        self.v, self.u = (np.full(n, len(self.words) - 1, np.uint32) for _ in range(2))
        self.v[1:], self.u[2:] = self.w[:-1], self.w[:-2]
        begin = (np.cumsum(self.lengths) - self.lengths)[self.lengths > 0]
        self.v[begin] = self.u[begin] = self.u[begin[begin + 1 < n] + 1] = len(self.words) - 1

    def after(self, common: Common) -> np.ndarray:
        """The places of the tokens after a common word."""
        return np.flatnonzero(within(common.words, self.words)[self.v])

    def shards(self, common: Common, after: np.ndarray, shards: int) -> np.ndarray:
        """Where each token is sent."""
        out = shard_of(self.words, shards).astype(np.int32)[self.v]
        key = pair_key(self.words[self.u[after]], self.words[self.v[after]])
        j = np.flatnonzero(within(common.pairs, key))
        key[j] = pair_key(key[j], self.words[self.w[after[j]]])
        out[after] = shard_of(key, shards)
        return out

    def pairs(self, at: np.ndarray) -> np.ndarray:
        return pair_key(self.words[self.v[at]], self.words[self.w[at]])

    def asked(self, after: np.ndarray) -> np.ndarray:
        """The keys whose counts the chunk must know: its words, and its pairs that begin with a common word."""
        return np.unique(np.concatenate([self.words[:-1], self.pairs(after)]))


def common_keys(chunks: DataFrame, total: int, least: float) -> Common:
    """Words and pairs with `least` of the `total` tokens and a 2000th of them, so at most a few thousand. Chunks name those that have a 4000th
    of their tokens; what a chunk has less of is not counted, which decides only where n-grams are sent."""
    words, pairs = [START], [*pair_key(np.array([START]), np.array([START]))]
    if total >= least:
        def run(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    c = Chunk(*(row[x] for x in PARTS))
                    some = max(2, c.n / 4000)
                    count = np.bincount(c.v, minlength=len(c.words))
                    word = np.flatnonzero(count >= some)
                    i = np.flatnonzero((count >= some)[c.v])
                    pair, n = np.unique(pair_key(c.words[c.u[i]], c.words[c.v[i]]), return_counts=True)
                    often = n >= some
                    keys, n = np.concatenate([c.words[word], pair[often]]), np.concatenate([count[word], n[often]])
                    kind = np.arange(len(keys)) >= len(word)
                    yield pa.record_batch([pa.array(kind), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["pair", "key", "n"])

        found = chunks.filter("n > 0").select(*PARTS).mapInArrow(run, "pair boolean, key long, n long").groupBy("pair", "key").agg(F.sum("n").alias("n"))
        for r in found.filter(F.col("n") >= max(least, total / 2000)).collect():
            (pairs if r["pair"] else words).append(np.int64(r["key"]).view(np.uint64))
    return Common(np.unique(np.array(words, np.uint64)), np.unique(np.array(pairs, np.uint64)))


def sent(chunks: DataFrame, common: Common, shards: int, lo: int, hi: int, counts: str | None = None) -> DataFrame:
    """(shard, chunk, n, n_target, heads, known, data): the n-grams of the shards from `lo` to before `hi`, training texts first, by v. Without
    `counts`, those of training texts only. With the folder that `answered` filled, also text, count of w, and count of (v, w) after a common word."""
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                c = Chunk(*(row[x] for x in PARTS))
                after = c.after(common)
                shard = c.shards(common, after, shards)
                i = np.flatnonzero((shard >= lo) & (shard < hi) if counts else (shard >= lo) & (shard < hi) & c.target)
                i = i[np.argsort(shard[i].astype(np.int64) << 33 | (~c.target[i]).astype(np.int64) << 32 | c.v[i])]
                cuts = np.searchsorted(shard[i], np.arange(lo, hi + 1))
                if counts:
                    text = np.repeat(np.arange(len(c.lengths), dtype=np.uint32), c.lengths)
                    uni, pairs = unpacked(get_bytes(f"{counts}/{row['chunk']}"), (np.uint32, len(c.words) - 1), (np.uint32, len(after)))
                    common_v = np.zeros(c.n, bool)
                    common_v[after] = True
                for s in range(lo, hi):
                    at = i[cuts[s - lo]:cuts[s - lo + 1]]
                    if not len(at):
                        continue
                    first = heads_of(c.v[at], c.target[at])
                    columns = [c.words[c.v[at[first]]], c.words[c.u[at]], c.words[c.w[at]], np.diff(np.r_[first, len(at)]).astype(np.uint32)]
                    known = 0
                    if counts:
                        j = at[common_v[at]]
                        known = len(j)
                        columns += [text[at], uni[c.w[at]], pairs[np.searchsorted(after, j)]]
                    yield pa.record_batch([pa.array([s], pa.int32()), *(pa.array([x], pa.int64()) for x in (row["chunk"], len(at), int(c.target[at].sum()), len(first), known)),
                                           pa.array([packed(*columns)], pa.binary())], SENT)

    return (chunks if counts else chunks.filter("n_target > 0")).filter("n > 0").select("chunk", *PARTS).mapInArrow(
        run, "shard int, chunk long, n long, n_target long, heads long, known long, data binary")


SENT = ["shard", "chunk", "n", "n_target", "heads", "known", "data"]


def received(row: dict, more: bool) -> list[np.ndarray]:
    """(u, v, w), and with `more` (text, count of w, counts of (v, w) after a common word)."""
    n = row["n"]
    rest = ((np.uint32, n), (np.uint32, n), (np.uint32, row["known"])) if more else ()
    heads, u, w, runs, *rest = unpacked(row["data"], (np.uint64, row["heads"]), (np.uint64, n), (np.uint64, n), (np.uint32, row["heads"]), *rest)
    return [u, np.repeat(heads, runs), w, *rest]


def triples(rows: list[dict], more: bool) -> tuple[np.ndarray, ...]:
    """The distinct triples of training texts: (key, count, u, v, w), by key."""
    parts = [[x[:r["n_target"]] for x in received(r, more)[:3]] for r in rows if r["n_target"]]
    u, v, w = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.uint64),) * 3
    key, c, one = summed(pair_key(pair_key(u, v), w), np.ones(len(u), np.int64))
    return key, c, u[one], v[one], w[one]


def contexts(keys: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ascending distinct contexts, (4, contexts): the sum of their counts, and how many are 1, 2, and 3 or more)."""
    order = np.argsort(keys)
    head = heads_of(keys[order])
    rows = np.stack([c, c == 1, c == 2, c > 2]).astype(np.int64)[:, order]
    return keys[order][head], np.add.reduceat(rows, head, axis=1) if len(head) else rows[:, :0]


def added(parts: list[tuple[np.ndarray, np.ndarray]], keys: np.ndarray) -> np.ndarray:
    """The context rows of `keys` over all parts."""
    out = np.zeros((4, len(keys)), np.int64)
    for k, rows in parts:
        at = np.searchsorted(keys, k)
        out[:, at] += rows
    return out


COUNTS = "part int, kind tinyint, n long, keys binary, more binary, counts binary, levels binary"
STATS, WORDS, PAIRS = 0, 1, 2


def row_of(part: int, kind: int, keys: np.ndarray, more: np.ndarray | None, counts: np.ndarray, levels: bytes = b"") -> dict:
    """Keys with their counts; `more` are the v and w of pairs."""
    return {"part": part, "kind": kind, "n": len(keys), "keys": packed(keys), "more": b"" if more is None else packed(*more), "counts": packed(counts.astype(np.uint32)), "levels": levels}


def table_of(rows: list[dict]) -> pa.Table:
    names = [x.split()[0] for x in COUNTS.split(", ")]
    kinds = {"int": pa.int32(), "tinyint": pa.int8(), "long": pa.int64(), "binary": pa.binary()}
    return pa.table({c: pa.array([r[c] for r in rows], kinds[x.split()[1]]) for c, x in zip(names, COUNTS.split(", "))})


def dealt(kind: int, keys: np.ndarray, more: np.ndarray | None, counts: np.ndarray, shards: int) -> list[dict]:
    """Rows by the shard of their keys, which ascend."""
    cuts = np.searchsorted(shard_of(keys, shards), np.arange(shards + 1, dtype=np.uint64))
    return [row_of(s, kind, keys[a:b], None if more is None else more[:, a:b], counts[a:b]) for s, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]


def opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = row["n"]
    more = np.stack(unpacked(row["more"], (np.uint64, n), (np.uint64, n))) if row["kind"] == PAIRS else np.zeros((2, n), np.uint64)
    return *unpacked(row["keys"], (np.uint64, n)), more, unpacked(row["counts"], (np.uint32, n))[0].astype(np.int64)


def joined(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ascending keys, v and w, sums) of rows of one part and kind."""
    keys, more, n = zip(*(opened(r) for r in rows))
    more = np.concatenate(more, axis=1)
    keys, n, one = summed(np.concatenate(keys), np.concatenate(n))
    return keys, more[:, one], n


def counted(parts: DataFrame, common: Common, shards: int) -> DataFrame:
    """What training texts have in a shard. A row of STATS: levels of the triple counts and of the pair counts, and the context rows of common
    pairs. Rows of WORDS: in how many pairs a word ends; rows of PAIRS: how many words come before (v, w), v common and this shard's share."""
    def count(key, table):
        _, c, u, v, w = triples(table.to_pylist(), False)
        uv = pair_key(u, v)
        often, wide = within(common.words, v), within(common.pairs, uv)
        vw, n, one = summed(pair_key(v, w), np.ones(len(v), np.int64))
        split = often[one]
        of_pairs = added([contexts(uv[wide], c[wide])], common.pairs)
        numbers = np.concatenate([levels(c, 5)[:4], levels(n[~split], 5)[:4], of_pairs.ravel()]).astype("<i8")
        word, ends, _ = summed(w[one][~split], np.ones((~split).sum(), np.int64))
        rows = [{**row_of(key[0].as_py(), STATS, word[:0], None, ends[:0]), "levels": numbers.tobytes()}]
        rows += dealt(WORDS, word, None, ends, shards)
        return table_of(rows + dealt(PAIRS, vw[split], np.stack([v[one][split], w[one][split]]), n[split], shards))

    def add(key, table):
        rows = table.to_pylist()
        if rows[0]["kind"] == STATS:
            return table_of([{**rows[0], "levels": np.sum([np.frombuffer(r["levels"], "<i8") for r in rows], axis=0).tobytes()}])
        keys, more, n = joined(rows)
        return table_of([row_of(rows[0]["part"], rows[0]["kind"], keys, more if rows[0]["kind"] == PAIRS else None, n)])

    return parts.groupBy("shard").applyInArrow(count, COUNTS).groupBy("part", "kind").applyInArrow(add, COUNTS)


def common_pairs(rows: DataFrame, common: Common, shards: int) -> DataFrame:
    """The pairs after common words with the sums of all shards' shares, one row a part with the levels and context rows of common words, and
    the words that end them."""
    def add(_, table):
        rows = table.to_pylist()
        keys, more, n = joined(rows)
        numbers = np.concatenate([levels(n, 5)[:4], added([contexts(more[0], n)], common.words).ravel()]).astype("<i8")
        word, ends, _ = summed(more[1], np.ones(len(n), np.int64))
        return table_of([row_of(rows[0]["part"], PAIRS, keys, np.zeros((2, len(keys)), np.uint64), n, numbers.tobytes()), *dealt(WORDS, word, None, ends, shards)])

    return rows.filter(F.col("kind") == PAIRS).groupBy("part").applyInArrow(add, COUNTS)


def all_words(rows: DataFrame) -> DataFrame:
    """In how many pairs each word ends, one row a part with the number of words, the sum, and the levels."""
    def add(_, table):
        rows = table.to_pylist()
        keys, _, n = joined(rows)
        return table_of([row_of(rows[0]["part"], WORDS, keys, None, n, np.concatenate([[len(n), n.sum()], levels(n, 5)]).astype("<i8").tobytes())])

    return rows.filter(F.col("kind") == WORDS).groupBy("part").applyInArrow(add, COUNTS)


def total_levels(rows: DataFrame, size: int) -> np.ndarray:
    out = np.zeros(size, np.int64)
    for r in rows.filter(F.length("levels") > 0).select("levels").toLocalIterator():
        out += np.frombuffer(bytes(r[0]), "<i8")
    return out


def answered(chunks: DataFrame, common: Common, known: DataFrame, shards: int, folder: str, rounds: int) -> None:
    """Writes for each chunk, as a file of its number, the counts of its words and those of the pairs of its tokens after common words."""
    def ask(batches, lo, hi):
        for batch in batches:
            for row in batch.to_pylist():
                c = Chunk(*(row[x] for x in PARTS))
                keys = c.asked(c.after(common))
                cuts = np.searchsorted(shard_of(keys, shards), np.arange(shards + 1, dtype=np.uint64))
                for s in range(lo, hi):
                    yield pa.record_batch([pa.array([s], pa.int32()), pa.array([row["chunk"]], pa.int64()), pa.array([keys[cuts[s]:cuts[s + 1]].tobytes()], pa.binary())], ["part", "chunk", "asked"])

    def answer(key, held, asked):
        rows = held.to_pylist()
        have = [joined([r for r in rows if r["kind"] == kind])[::2] for kind in (WORDS, PAIRS) if any(r["kind"] == kind for r in rows)]
        out = []
        for sent in asked["asked"].to_pylist() if asked.num_rows else []:
            keys = np.frombuffer(sent, np.uint64)
            n = np.zeros(len(keys), np.uint32)
            for k, c in have:
                at = np.minimum(np.searchsorted(k, keys), len(k) - 1)
                n += np.where(k[at] == keys, c[at], 0).astype(np.uint32)
            out.append(packed(n))
        chunk = asked["chunk"].to_pylist() if asked.num_rows else []
        sizes = [len(x) // 8 for x in asked["asked"].to_pylist()] if asked.num_rows else []
        return pa.table({"chunk": pa.array(chunk, pa.int64()), "part": pa.array([key[0].as_py()] * len(chunk), pa.int32()), "n": pa.array(sizes, pa.int64()), "counts": pa.array(out, pa.binary())})

    def write(key, table):
        rows = sorted(table.to_pylist(), key=lambda r: r["part"])
        put_bytes(f"{folder}/keys/{key[0].as_py()}", packed(np.concatenate([unpacked(r["counts"], (np.uint32, r["n"]))[0] for r in rows])))
        return pa.table({"n": pa.array([sum(r["n"] for r in rows)], pa.int64())})

    def place(batches):
        for batch in batches:
            for row in batch.to_pylist():
                c = Chunk(*(row[x] for x in PARTS))
                after = c.after(common)
                keys = c.asked(after)
                have, = unpacked(get_bytes(f"{folder}/keys/{row['chunk']}"), (np.uint32, len(keys)))
                put_bytes(f"{folder}/{row['chunk']}", packed(have[np.searchsorted(keys, c.words[:-1])], have[np.searchsorted(keys, c.pairs(after))]))
                yield pa.record_batch([pa.array([c.n], pa.int64())], ["n"])

    full = chunks.filter("n > 0").select("chunk", *PARTS)
    got = []
    for lo, hi in rounds_of(shards, rounds):
        asked = full.mapInArrow(partial(ask, lo=lo, hi=hi), "part int, chunk long, asked binary")
        held = known.filter(F.col("part").between(lo, hi - 1)).select("part", "kind", "n", "keys", "more", "counts")
        got.append(freed(held.groupBy("part").cogroup(asked.groupBy("part")).applyInArrow(answer, "chunk long, part int, n long, counts binary"), "kn-found"))
    if every([x for x, _ in got]).groupBy("chunk").applyInArrow(write, "n long").agg(F.sum("n")).first()[0]:
        full.mapInArrow(place, "n long").agg(F.sum("n")).collect()
        dropped(f"{folder}/keys")
    for _, at in got:
        dropped(at)


@dataclass(frozen=True)
class Totals:
    """What all shards share: discounts by order, the words' number and sum, and the context rows of common pairs and words."""
    d: tuple[list[float], list[float], list[float]]
    total: int
    unknown: float
    of_pairs: np.ndarray
    of_words: np.ndarray


def steps(c: np.ndarray, d: list[float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(c, 3)]


def back(rows: np.ndarray, d: list[float]) -> np.ndarray:
    """The weight that contexts leave to the lower order."""
    return (d[0] * rows[1] + d[1] * rows[2] + d[2] * rows[3]) / np.maximum(rows[0], 1)


def found(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which are there, their places)."""
    if not len(keys):
        return np.zeros(len(asked), bool), np.zeros(len(asked), np.int64)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return keys[at] == asked, at


SCALE = float(1 << 32)  # losses are added up as whole numbers, so their order does not matter


def losses(parts: DataFrame, common: Common, t: Totals) -> DataFrame:
    """(chunk, n, texts, sums): per chunk and shard the losses of the tokens that the chunk sent, added up by text."""
    d3, d2, d1 = t.d

    def score(_, table):
        rows = table.to_pylist()
        key, c, u, v, w = triples(rows, True)
        uv = pair_key(u, v)
        pairs, of_pairs = contexts(uv, c)
        wide, at = found(common.pairs, pairs)
        of_pairs[:, wide] = t.of_pairs[:, at[wide]]
        vw, n2, one = summed(pair_key(v, w), np.ones(len(v), np.int64))
        words, of_words = contexts(v[one], n2)
        often, at = found(common.words, words)
        of_words[:, often] = t.of_words[:, at[often]]
        # a common pair or word that this shard has no triple of is known all the same
        pairs, of_pairs = merged(pairs, of_pairs, common.pairs, t.of_pairs)
        words, of_words = merged(words, of_words, common.words, t.of_words)
        back3, back2 = back(of_pairs, d3), back(of_words, d2)
        out = {"chunk": [], "n": [], "texts": [], "sums": []}
        for row in rows:
            u, v, w, text, c1, c2_common = received(row, True)
            uv, x = pair_key(u, v), pair_key(v, w)
            has1, p1 = c1 > 0, (c1 - steps(c1, d1)) / t.total + t.unknown
            there, at = found(vw, x)
            c2 = np.where(there, n2[at] if len(n2) else 0, 0)
            c2[within(common.words, v)] = c2_common
            context, at = found(words, v)
            total2, weight2 = (np.where(context, y[at], z) if len(words) else np.full(len(v), z) for y, z in ((of_words[0], 1), (back2, 1.0)))
            p2 = (c2 - steps(c2, d2)) / total2 + weight2 * p1
            there, at = found(key, pair_key(uv, w))
            c3 = np.where(there, c[at] if len(c) else 0, 0)
            context, at = found(pairs, uv)
            total3, weight3 = (np.where(context, y[at], z) if len(pairs) else np.full(len(v), z) for y, z in ((of_pairs[0], 1), (back3, 1.0)))
            p3 = (c3 - steps(c3, d3)) / total3 + weight3 * p2
            # values are those of a model in single precision
            one_word = weight2.astype(np.float32).astype(float) * np.where(has1, p1.astype(np.float32), t.unknown)
            low = np.where(c2 > 0, p2.astype(np.float32), one_word)
            p = np.where(c3 > 0, p3.astype(np.float32), weight3.astype(np.float32).astype(float) * low)
            loss = np.rint(-np.log(p) * SCALE).astype(np.int64)
            order = np.argsort(text, kind="stable")
            head = heads_of(text[order])
            for name, x in (("chunk", row["chunk"]), ("n", len(head)), ("texts", packed(text[order][head])), ("sums", pa.compress(W.planes(np.add.reduceat(loss[order], head)), "zstd", asbytes=True))):
                out[name].append(x)
        return pa.table({"chunk": pa.array(out["chunk"], pa.int64()), "n": pa.array(out["n"], pa.int64()), "texts": pa.array(out["texts"], pa.binary()), "sums": pa.array(out["sums"], pa.binary())})

    return by_chunk(parts.groupBy("shard").applyInArrow(score, LOSSES))


LOSSES = "chunk long, n long, texts binary, sums binary"


def merged(keys: np.ndarray, rows: np.ndarray, more: np.ndarray, of_more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Contexts with those of `more` that have a count and are not there yet."""
    new = ~found(keys, more)[0] & (of_more[0] > 0)
    keys, rows = np.concatenate([keys, more[new]]), np.concatenate([rows, of_more[:, new]], axis=1)
    order = np.argsort(keys)
    return keys[order], rows[:, order]


def summed_losses(rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """(texts, sums) of the rows of a chunk."""
    texts = np.concatenate([unpacked(r["texts"], (np.uint32, r["n"]))[0] for r in rows])
    sums = np.concatenate([W.from_planes([pa.decompress(r["sums"], 8 * r["n"], "zstd", asbytes=True)], np.int64) for r in rows])
    return summed(texts, sums)[:2]


def by_chunk(rows: DataFrame) -> DataFrame:
    def add(key, table):
        texts, sums = summed_losses(table.to_pylist())
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int64()), "n": pa.array([len(texts)], pa.int64()), "texts": pa.array([packed(texts)], pa.binary()),
                         "sums": pa.array([pa.compress(W.planes(sums), "zstd", asbytes=True)], pa.binary())})

    return rows.groupBy("chunk").applyInArrow(add, LOSSES)


def rounds_of(shards: int, rounds: int) -> list[tuple[int, int]]:
    cuts = [shards * i // min(rounds, shards) for i in range(min(rounds, shards) + 1)]
    return list(zip(cuts, cuts[1:]))


def every(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for x in frames[1:]:
        out = out.unionByName(x)
    return out


def perplexities(chunks: DataFrame, shard_tokens: int = SHARD_TOKENS, rounds: int = ROUNDS) -> DataFrame:
    """(key, n_tokens, log_perplexity) of the stored chunks of `lm_score.tokens`, under the model of their target texts."""
    spark = chunks.sparkSession
    total = int(chunks.agg(F.sum("n")).first()[0] or 0)
    shards = max(1, -(-total // shard_tokens), min(-(-6 * total // shard_tokens), 6 * rounds))
    rounds, count_rounds = (max(1, min(r, -(-total // shard_tokens))) for r in (rounds, COUNT_ROUNDS))
    common = common_keys(chunks, total, total / shards / 4 if shards > 1 else total + 1)
    size = 8 + 4 * len(common.pairs)
    seen = [freed(counted(sent(chunks, common, shards, lo, hi), common, shards), "kn-counts") for lo, hi in rounds_of(shards, count_rounds)]
    counts = every([x for x, _ in seen])
    whole = total_levels(counts.filter(F.col("kind") == STATS), size)
    pairs, pairs_at = freed(common_pairs(counts, common, shards), "kn-pairs")
    of_words = total_levels(pairs, 4 + 4 * len(common.words))
    words, words_at = freed(all_words(counts.select(*pairs.columns).unionByName(pairs)), "kn-words")
    for _, at in seen:
        dropped(at)
    of_uni = total_levels(words, 7)
    d3, d2, d1 = (discounts_of(n) for n in (whole[:4], whole[4:8] + of_words[:4], of_uni[2:6]))
    types, n_pairs = int(of_uni[0]), int(of_uni[1]) or 1
    left = d1[0] * of_uni[2] + d1[1] * of_uni[3] + d1[2] * (of_uni[4:7].sum())
    t = Totals((d3, d2, d1), n_pairs, (left if types else 1.0) / n_pairs / (types + 1), whole[8:].reshape(4, -1), of_words[4:].reshape(4, -1))
    folder = new_folder(spark, "kn-known")
    known = words.unionByName(pairs.filter(F.col("kind") == PAIRS))
    with shuffles_freed(spark):
        answered(chunks, common, known, shards, folder, count_rounds)
    dropped(pairs_at)
    dropped(words_at)
    done = every([freed(losses(sent(chunks, common, shards, lo, hi, folder), common, t), "kn-losses")[0] for lo, hi in rounds_of(shards, rounds)])

    def score(_, mine, parts):
        row = mine.to_pylist()[0]
        n = np.frombuffer(row["lengths"], "<i8")
        sums = np.zeros(len(n), np.int64)
        if parts.num_rows:
            at, s = summed_losses(parts.to_pylist())
            sums[at] = s
        full = n > 0
        mean = np.full(len(n), np.nan)
        mean[full] = sums[full] / SCALE / n[full]
        return pa.table({"key": mine["keys"].combine_chunks().flatten(), "n_tokens": pa.array(n, pa.int64()), "log_perplexity": pa.array(mean, pa.float64(), mask=~full)})

    kind = chunks.schema["keys"].dataType.elementType.simpleString()
    both = chunks.select("chunk", "keys", "lengths").groupBy("chunk").cogroup(done.groupBy("chunk"))
    return both.applyInArrow(score, f"key {kind}, n_tokens long, log_perplexity double")


def thresholds(rows: DataFrame, quantile: float) -> DataFrame:
    """(lang, threshold) over trusted rows: the lowest rounded log perplexity that `quantile` of them do not exceed. Rounded values are
    counted first, so a window holds distinct values of one language only."""
    counts = (rows.filter("trusted and log_perplexity is not null")
              .groupBy(F.col("lang").alias("l"), F.ceil(F.col("log_perplexity") * 10000).alias("bin")).agg(F.count("*").alias("n")))
    part = Window.partitionBy("l")
    upto = F.sum("n").over(part.orderBy("bin"))
    ranked = counts.withColumn("upto", upto).withColumn("all", F.sum("n").over(part))
    return ranked.filter(F.col("upto") >= F.col("all") * quantile).groupBy("l").agg((F.min("bin") / 10000).alias("threshold"))


def classify(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             train_docs: int | None = None, train_tokens: int | None = None, quantile: float = QUANTILE,
             chunk_tokens: int = CHUNK, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(key, lang, n_tokens, perplexity, threshold, kept) of every document. With `train_docs` and `train_tokens` the model is fitted on
    a `training_set` of that size, else on all trusted documents that are not held out."""
    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    good = trusted.select(F.col(id_col).alias("key"))
    if train_docs is not None and train_tokens is not None:
        # the texts of the sample come once more, as rows that train and are not shown
        sample = training_set(rows, good, train_docs, train_tokens).select(F.lit(None).cast(rows.schema["key"].dataType).alias("key"), "text", F.lit(None).cast("string").alias("lang"))
        named = rows.withColumns({"target": F.lit(False), "shown": F.lit(True)}).unionByName(sample.withColumns({"target": F.lit(True), "shown": F.lit(False)}))
    else:
        texts = tagged(rows.select("key", F.struct("text", "lang").alias("text")), good.filter(f"not {HELD_OUT}"), "key", "text")
        named = texts.select("key", "text.text", "text.lang", "target", F.lit(True).alias("shown"))
    with shuffles_freed(docs.sparkSession):
        chunks = stored(tokens(named.select(F.struct("key", "lang", "shown").alias("key"), "text", "target"), chunk_tokens), "kn-tokens")
    scored = stored(perplexities(chunks, shard_tokens).filter("key.shown").select("key.key", "key.lang", "n_tokens", "log_perplexity"), "kn-scored")
    marked = scored.join(good.filter(HELD_OUT).distinct().withColumn("t", F.lit(True)), "key", "left").withColumn("trusted", F.coalesce("t", F.lit(False)))
    limits = stored(thresholds(marked, quantile), "kn-limits")
    largest = limits.agg(F.max("threshold")).first()[0]
    out = scored.join(limits, F.col("lang").eqNullSafe(F.col("l")), "left").withColumn("threshold", F.coalesce("threshold", F.lit(largest).cast("double")))
    return out.select("key", "lang", "n_tokens", F.exp("log_perplexity").alias("perplexity"), F.exp("threshold").alias("threshold"),
                      F.coalesce(F.col("log_perplexity") <= F.coalesce("threshold", "log_perplexity"), F.lit(False)).alias("kept"))
