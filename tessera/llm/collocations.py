"""Phrase collocations from a weighted de Bruijn graph of each language.

Nodes are pairs of neighbouring words, an edge joins the pairs (a, b) and (b, c) and weighs as many as `a b c` occurs. Only the longest grams
are counted: every word occurrence is one gram of itself and the two words behind it in its piece, padded with an end mark. Shorter counts
follow from the flow: f(a b) is the weight of the edges that leave the node plus the pairs that end a piece, f(a) the flow of the nodes that
begin with a plus the words that end a piece. What the end mark takes is that correction, so one shuffle of grams counts all three lengths.

Texts are read in chunks of a bounded number of tokens. A chunk sums its grams, nests them as first word, second words, third words, and
sends each part once to a shard: by the first word and three bits of the second, so a frequent word lies in eight cells. A cell with more
distinct grams in one chunk than HOT_EDGES goes out gram by gram to shards of whole grams, and a mark tells the cell's own shard to hand its
grams on unsummed; the few grams of such cells are summed by Spark. So no shard holds all of a frequent word. Words are 64-bit hashes salted
with the language, so languages never meet; each chunk also sends its distinct words with their spelling, by hash.

Edges of at least `least` are the graph that is kept. Nodes with one edge in, one out, both as heavy as the node, are unary: what passes one
passes the next. Runs of them are compacted to paths by pointer doubling (each round doubles the reach; a closed circle stays as single
edges). A node inside a path always lies in a longer phrase of its own count, so it is no phrase by itself, and only the ends of paths are
compared with their edges.

Defined results: null and empty texts have no words; a null language is `und`; repeated rows count again; an empty table gives no rows. Only
the named columns are read."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import words as W
from tessera.llm.folders import stored
from tessera.llm.known import gather

LEAST = 10
TOP = 2_000
INSIDE = 50  # percent of a phrase's count that a longer phrase around it may not reach
CHUNK_TOKENS = 1_000_000
SHARD_BYTES = 12 << 20  # text per shard
HOT_EDGES = 1 << 14
PIECE_ENDS = W.byte_class((0x0A, 0x0D), *((ord(c),) * 2 for c in ".,;:!?"))
SEPARATORS = PIECE_ENDS | W.byte_class((0x20, 0x20), (0x09, 0x09))
EDGE, NODE, WORD, PART, SPELLING, TOTAL = 3, 2, 1, 0, 4, 5  # kinds of counted rows
ROWS = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("c", pa.int64()), ("n", pa.int64()), ("lang", pa.string()), ("word", pa.string())])
ROWS_SQL = "kind int, a long, b long, c long, n long, lang string, word string"
SENT = ["a", "b", "c", "d", "e", "f"]
SENT_SQL = "shard long, kind int, " + ", ".join(f"{x} binary" for x in SENT) + ", langs array<string>"
_K = np.uint64(0x9E3779B97F4A7C15)


def _cells(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where a pair of words lies: its first word and the top three bits of its second."""
    return W.mix(a * _K + (b >> np.uint64(61)))


def _shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def text_grams(texts: pa.Array, salts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, tuple]:
    """(first, second, third, text) of the gram at each word occurrence, 0 being the end mark, and (bytes, starts, ends) of the words."""
    raw, offsets = W.buffers(texts)
    buf = W.LOWER[raw]
    starts, ends = W.spans(buf, offsets, SEPARATORS)
    text = np.searchsorted(offsets, starts, "right") - 1
    first = np.maximum(W.mix(W.word_hashes(buf, starts, ends) ^ salts[text]), np.uint64(1))
    breaks = np.r_[0, np.cumsum(PIECE_ENDS[buf], dtype=np.int64)][starts]
    follows = np.zeros(len(first) + 2, bool)
    follows[1:len(first)] = (breaks[1:] == breaks[:-1]) & (text[1:] == text[:-1])
    padded = np.r_[first, np.zeros(2, np.uint64)]
    second = np.where(follows[1:-1], padded[1:-1], np.uint64(0))
    third = np.where(follows[1:-1] & follows[2:], padded[2:], np.uint64(0))
    return first, second, third, text, (buf, starts, ends)


def _sum(*keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, ascending by the first, then the second, and their sums."""
    if not len(n):
        return *keys, n
    order = np.lexsort(keys[::-1])
    keys, n = [k[order] for k in keys], n[order]
    head = np.zeros(len(n), bool)
    head[0] = True
    for k in keys:
        head[1:] |= k[1:] != k[:-1]
    at = np.flatnonzero(head)
    return *(k[at] for k in keys), np.add.reduceat(n, at)


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where the keys change, from 0 on."""
    head = np.ones(len(keys[0]), bool)
    if len(head):
        head[1:] = False
        for k in keys:
            head[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(head)


def _salts(langs: pa.Array) -> np.ndarray:
    """Mixed once more, since a word may be spelled like a language."""
    raw, offsets = W.buffers(langs.cast(pa.string()))
    return W.mix(W.word_hashes(raw, offsets[:-1], offsets[1:]) * _K + np.uint64(1))


def grams(docs: DataFrame, shards: int, chunk_tokens: int = CHUNK_TOKENS, hot_edges: int = HOT_EDGES) -> DataFrame:
    """What the chunks of (text, lang) rows send to the shards."""
    def row(shard, kind, *arrays, langs=()):
        data = [x if isinstance(x, bytes) else x.tobytes() for x in arrays] + [None] * (len(SENT) - len(arrays))
        return pa.record_batch([pa.array([shard], pa.int64()), pa.array([kind], pa.int32()), *(pa.array([x], pa.binary()) for x in data), pa.array([list(langs)], pa.list_(pa.string()))],
                               ["shard", "kind", *SENT, "langs"])

    def scan(batches):
        at, held, spelled, tokens, size = TaskContext.get().partitionId(), [], [], {}, 0

        def flush():
            a, b, c = (np.concatenate(x) for x in zip(*held))
            cell, b, c, a, n = _sum(_cells(a, b), b, c, a, n=np.ones(len(a), np.int64))
            begin = _runs(cell)
            many = np.diff(np.r_[begin, len(cell)]) > hot_edges
            hot = np.repeat(many, np.diff(np.r_[begin, len(cell)]))
            if many.any():
                marks = cell[begin[many]]
                for s in np.unique(_shard(marks, shards)):
                    yield row(s, 1, marks[_shard(marks, shards) == s])
                to = _shard(W.mix(cell[hot] ^ W.mix(b[hot]) * _K ^ W.mix(c[hot])), shards)
                for s in np.unique(to):
                    yield row(s, 2, *(x[hot][to == s] for x in (a, b, c, n)))
                cell, a, b, c, n = (x[~hot] for x in (cell, a, b, c, n))
            to = _shard(cell, shards)
            cuts = np.r_[_runs(to), len(to)]
            for i, j in zip(cuts, cuts[1:]):
                cells, nodes = _runs(cell[i:j]), _runs(cell[i:j], b[i:j])
                yield row(to[i], 0, a[i:j][cells], np.diff(np.r_[np.searchsorted(nodes, cells), len(nodes)]).astype("<u4"), b[i:j][nodes],
                          np.diff(np.r_[nodes, j - i]).astype("<u4"), c[i:j], n[i:j].astype("<u4"))
            keys, texts, langs = (pa.concat_arrays([x[k] for x in spelled]) for k in range(3))
            keys, place = np.unique(keys.to_numpy(), return_index=True)
            keys, texts, langs = keys.view(np.uint64), texts.take(pa.array(place)), langs.take(pa.array(place)).dictionary_encode()
            to = _shard(keys, shards)
            for s in np.unique(to):
                mine = np.flatnonzero(to == s)
                yield row(s, 3, keys[mine], langs.indices.to_numpy()[mine].astype("<u4"), b"\n".join(texts.take(pa.array(mine)).to_pylist()), langs=langs.dictionary.to_pylist())
            yield row(at % shards, 4, np.array(list(tokens.values()), "<i8"), langs=tokens)

        for whole in batches:
            for batch in W.slices(whole, "text"):
                langs = batch.column("lang").fill_null("und").dictionary_encode()
                code = langs.indices.to_numpy()
                a, b, c, text, (buf, starts, ends) = text_grams(batch.column("text"), _salts(langs.dictionary)[code])
                if not len(a):
                    continue
                for k, n in enumerate(np.bincount(code[text], minlength=len(langs.dictionary)).tolist()):
                    name = langs.dictionary[k].as_py()
                    tokens[name] = tokens.get(name, 0) + n
                held.append((a, b, c))
                keys, place = np.unique(a, return_index=True)
                data, cut = gather(buf, starts, ends - starts, place)
                texts = pa.Array.from_buffers(pa.large_binary(), len(keys), [None, pa.py_buffer(cut.astype(np.int64)), pa.py_buffer(data)])
                spelled.append((pa.array(keys.view(np.int64)), texts, langs.dictionary.take(pa.array(code[text[place]]))))
                size += len(a)
                if size > chunk_tokens:
                    yield from flush()
                    at, held, spelled, tokens, size = at + 7919, [], [], {}, 0
        if held:
            yield from flush()

    return docs.mapInArrow(scan, SENT_SQL)


def counted(sent: DataFrame, least: int) -> DataFrame:
    """(kind, a, b, c, n, lang, word): frequent EDGEs and NODEs, sums of WORDs per cell, PARTs of hot grams, SPELLINGs and TOTALs."""
    def u64(column) -> np.ndarray:
        return np.frombuffer(b"".join(column), np.uint64)

    def u32(column) -> np.ndarray:
        return np.frombuffer(b"".join(column), "<u4").astype(np.int64)

    def rows(kind, n=None, langs=None, words=None, **keys):
        size = len(n) if n is not None else len(words)
        cols = {"kind": np.full(size, kind, np.int32), "n": n if n is not None else np.zeros(size, np.int64), "lang": langs, "word": words} | {k: v.view(np.int64) for k, v in keys.items()}
        return pa.table([pa.array(cols[f.name], f.type) if cols.get(f.name) is not None else pa.nulls(size, f.type) for f in ROWS], schema=ROWS)

    def add(table: pa.Table) -> pa.Table:
        got = {k: [] for k in range(5)}
        for r in table.to_pylist():
            got[r["kind"]].append(r)
        parts = {k: {c: [r[c] for r in v] for c in SENT} for k, v in got.items()}
        own, hot = parts[0], parts[2]
        per_node = u32(own["d"])
        a = np.repeat(np.repeat(u64(own["a"]), u32(own["b"])), per_node)
        a, b, c, n = _sum(a, np.repeat(u64(own["c"]), per_node), u64(own["e"]), n=u32(own["f"]))
        marked = np.isin(_cells(a, b), u64(parts[1]["a"]))
        out = [rows(PART, a=a[marked], b=b[marked], c=c[marked], n=n[marked])]
        ha, hb, hc, hn = _sum(*(u64(hot[x]) for x in "abc"), n=np.frombuffer(b"".join(hot["d"]), "<i8"))
        out.append(rows(PART, a=ha, b=hb, c=hc, n=hn))
        a, b, c, n = (x[~marked] for x in (a, b, c, n))
        keep = (n >= least) & (c != 0)
        out.append(rows(EDGE, a=a[keep], b=b[keep], c=c[keep], n=n[keep]))
        begin = _runs(a, b) if len(a) else np.zeros(0, np.int64)
        a, b, n = a[begin], b[begin], np.add.reduceat(n, begin) if len(begin) else n
        keep = (n >= least) & (b != 0)
        out.append(rows(NODE, a=a[keep], b=b[keep], n=n[keep]))
        begin = _runs(a) if len(a) else np.zeros(0, np.int64)
        out.append(rows(WORD, a=a[begin], n=np.add.reduceat(n, begin) if len(begin) else n))
        for r in got[4]:
            out.append(rows(TOTAL, n=np.frombuffer(r["a"], "<i8"), langs=r["langs"]))
        if got[3]:
            keys = u64(parts[3]["a"])
            langs = pa.concat_arrays([pa.array(r["langs"], pa.string()).take(pa.array(np.frombuffer(r["b"], "<u4"))) for r in got[3]])
            text = b"\n".join(parts[3]["c"]).decode("utf-8", "replace").split("\n")
            keys, place = np.unique(keys, return_index=True)
            out.append(rows(SPELLING, a=keys, langs=langs.take(pa.array(place)), words=pa.array(text, pa.string()).take(pa.array(place))))
        return pa.concat_tables(out)

    return sent.groupBy("shard").applyInArrow(add, ROWS_SQL)


@dataclass(frozen=True)
class Graph:
    """Frequent edges (a, b, c, n), nodes (a, b, n) and words (a, n, lang, word), and all tokens per language (lang, n)."""
    edges: DataFrame
    nodes: DataFrame
    words: DataFrame
    tokens: DataFrame


def graph(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, chunk_tokens: int = CHUNK_TOKENS, shard_bytes: int = SHARD_BYTES,
          hot_edges: int = HOT_EDGES) -> Graph:
    """Counts the grams of all texts."""
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    out = stored(counted(grams(rows, max(1, -(-size // shard_bytes)), chunk_tokens, hot_edges), least), "grams")

    def kind(k, *columns):
        return out.filter(F.col("kind") == k).select(*columns)

    hot = kind(PART, "a", "b", "c", "n").groupBy("a", "b", "c").agg(F.sum("n").alias("n"))
    total = F.sum("n").alias("n")
    edges = kind(EDGE, "a", "b", "c", "n").unionByName(hot.filter(f"b <> 0 and c <> 0 and n >= {least}"))
    nodes = kind(NODE, "a", "b", "n").unionByName(hot.filter("b <> 0").groupBy("a", "b").agg(total).filter(f"n >= {least}"))
    counts = kind(WORD, "a", "n").unionByName(hot.select("a", "n")).groupBy("a").agg(total).filter(f"n >= {least}")
    words = counts.join(kind(SPELLING, "a", "lang", "word"), "a")
    return Graph(stored(edges, "edges"), stored(nodes, "nodes"), stored(words, "words"), kind(TOTAL, "lang", "n").groupBy("lang").agg(total))


def paths(g: Graph) -> DataFrame:
    """(a, b, c, n, p, q, r, step): every edge with the first edge (p, q, r) of its compacted path and its place there."""
    into = g.edges.groupBy(F.col("b").alias("x"), F.col("c").alias("y")).agg(F.count("*").alias("k"), F.min("n").alias("m"), F.min("a").alias("w"))
    out = g.edges.groupBy(F.col("a").alias("x"), F.col("b").alias("y")).agg(F.count("*").alias("l"), F.min("n").alias("o"))
    unary = g.nodes.select(F.col("a").alias("x"), F.col("b").alias("y"), "n").join(into, ["x", "y"]).join(out, ["x", "y"]).filter("k = 1 and l = 1 and m = n and o = n")
    # node (x, y), the node (u, v) reached backwards, and the last word z of the node behind that one
    reach = stored(unary.select("x", "y", F.col("w").alias("u"), F.col("x").alias("v"), F.col("y").alias("z"), F.lit(1).cast("long").alias("step")), "reach")
    moving = None
    while True:
        far = reach.select(F.col("x").alias("u"), F.col("y").alias("v"), F.col("u").alias("u2"), F.col("v").alias("v2"), F.col("z").alias("z2"), F.col("step").alias("s2"))
        both = reach.join(far, ["u", "v"], "left")
        step = stored(both.select("x", "y", F.coalesce("u2", "u").alias("u"), F.coalesce("v2", "v").alias("v"), F.coalesce("z2", "z").alias("z"),
                                  (F.col("step") + F.coalesce("s2", F.lit(0))).alias("step"), F.col("u2").isNotNull().alias("moved")), "reach")
        still = step.filter("moved").count()
        reach = step.drop("moved")
        if not still or still == moving:
            break
        moving = still
    # what still moves runs in a circle
    ends = reach.join(unary.select(F.col("x").alias("u"), F.col("y").alias("v")), ["u", "v"], "left_anti") if still else reach
    start = ends.select(F.col("x").alias("a"), F.col("y").alias("b"), F.col("u").alias("p"), F.col("v").alias("q"), F.col("z").alias("r"), "step")
    return g.edges.join(start, ["a", "b"], "left").select(
        "a", "b", "c", "n", *(F.coalesce(x, y).alias(x) for x, y in (("p", "a"), ("q", "b"), ("r", "c"))), F.coalesce("step", F.lit(0)).cast("long").alias("step"))


def long_phrases(g: Graph, compact: DataFrame) -> DataFrame:
    """(lang, phrase, n_words, n) of the compacted paths: the longest phrases whose every inner pair occurs nowhere else."""
    steps = compact.select("p", "q", "r", "n", F.col("c").alias("w"), (F.col("step") + 2).alias("at"))
    heads = compact.filter("step = 0")
    steps = steps.unionByName(heads.select("p", "q", "r", "n", F.col("a").alias("w"), F.lit(0).cast("long").alias("at"))).unionByName(
        heads.select("p", "q", "r", "n", F.col("b").alias("w"), F.lit(1).cast("long").alias("at")))
    named = steps.join(g.words.select(F.col("a").alias("w"), "lang", "word"), "w")
    # a group is one path, no longer than a text
    return named.groupBy("p", "q", "r").agg(F.first("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("at", "word"))).alias("s"), F.first("n").alias("n")).select(
        "lang", F.concat_ws(" ", F.transform("s", lambda x: x["word"])).alias("phrase"), F.size("s").alias("n_words"), "n")


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (left right)) on decimals of 38 digits."""
    wide = [x.cast("decimal(18,0)") for x in (a, left, right)]
    top = (wide[0] * wide[0]).cast("decimal(38,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", top.cast("decimal(38,0)"), (wide[1] * wide[2]).cast("decimal(38,0)")).cast("long")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, inside: int = INSIDE, **options) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first `top` phrases of two or three words of each language."""
    g = graph(docs, least=least, **options)
    compact = stored(paths(g), "paths")
    return ranked(g, compact, top, inside)


def ranked(g: Graph, compact: DataFrame, top: int, inside: int) -> DataFrame:
    """The ranking from a graph and its compacted paths."""
    one = g.words.select("a", F.col("n").alias("f"))
    two = g.nodes
    # only the two ends of a path can be phrases by themselves
    last = F.max_by(F.struct("b", "c"), "step")
    whole = compact.groupBy("p", "q", "r").agg(F.max("n").alias("n"), last.alias("e"))
    around = whole.select(F.col("p").alias("a"), F.col("q").alias("b"), "n").unionByName(whole.select(F.col("e.b").alias("a"), F.col("e.c").alias("b"), "n"))
    around = around.groupBy("a", "b").agg(F.max("n").alias("longer"))
    within = compact.filter("step > 0").select("a", "b").distinct()
    pairs = two.join(within, ["a", "b"], "left_anti").join(around, ["a", "b"], "left").filter(f"longer is null or 100 * longer < {inside} * n")
    pairs = pairs.join(one.withColumnRenamed("f", "l"), "a").join(one.select(F.col("a").alias("b"), F.col("f").alias("r")), "b")
    pairs = pairs.select("a", "b", F.lit(None).cast("long").alias("c"), "n", "l", "r", _score(F.col("n"), F.col("l"), F.col("r")).alias("score"))
    triples = g.edges.join(one.withColumnRenamed("f", "l1"), "a").join(two.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("n").alias("r1")), ["b", "c"])
    triples = triples.join(two.withColumnRenamed("n", "l2"), ["a", "b"]).join(one.select(F.col("a").alias("c"), F.col("f").alias("r2")), "c")
    triples = triples.withColumn("s1", _score(F.col("n"), F.col("l1"), F.col("r1"))).withColumn("s2", _score(F.col("n"), F.col("l2"), F.col("r2")))
    second = F.col("s2") < F.col("s1")
    triples = triples.select("a", "b", "c", "n", *(F.when(second, F.col(f"{x}2")).otherwise(F.col(f"{x}1")).alias(y) for x, y in (("l", "l"), ("r", "r"), ("s", "score"))))
    named = g.words.select("a", "lang", "word")
    found = pairs.unionByName(triples).join(named.withColumnRenamed("word", "w1"), "a").join(named.select(F.col("a").alias("b"), F.col("word").alias("w2")), "b").join(
        named.select(F.col("a").alias("c"), F.col("word").alias("w3")), "c", "left")
    found = found.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), F.col("n").alias("a"), "l", "r", "score")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return found.withColumn("rank", place.cast("long")).filter(F.col("rank") <= top).join(g.tokens, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
