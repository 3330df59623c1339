"""Similarity join of documents on n-gram sets by PartEnum signatures.

A document is the set of its distinct five-word shingles (hashed to 64 bits). Sets are put in bands of size, [l, floor(l / s)], so that two
sets of similarity s or more lie in one band or in neighbouring ones. For each band pair there is a largest symmetric difference k. The
feature domain is cut by hash on two levels: k // 2 + 1 + x coarse parts, so two similar sets differ in at most one element in at least
x + 1 of them, and SUBPARTS parts of each. The content of every subset of SUBPARTS - 1 parts of a coarse part is one signature, so each of
these coarse parts gives a common one. Each set leaves out the x signatures of fewest elements, which say least: of x + 1 common ones the
last in the order of (elements, signature), which is the same order for both sets, is left out by neither.

Near copies are met first: every document is compared with the smallest one that shares one of its FIRST lowest shingles by hash, and the
links are closed to components. From then on a signature only pairs documents of different components, one of each: a group of copies with edits
sends no pairs however many signatures it shares.

Each task merges its own signatures first: where more than SMALL components share one, it keeps the smallest document and pairs the others
with it, so a signature reaches the shuffle a bounded number of times per task however common it is. Signatures travel as packed arrays, one
row per shard and task. All pairs of at most SMALL components are candidates; in a larger group each is paired with the smallest. Candidates
of fitting sizes are screened on 16-bit hashes, which can only overstate what two sets share, and the rest is verified on whole sets. Links
are then closed to components. Where documents of a group that was not compared in full end in different components, all documents of these
components are joined again, now on their rarest shingles: of two similar sets the n - ceil(s n) + 1 rarest of each share one. So no link is
lost, and a passage that many documents share pairs nobody.

Defined results: documents without words, or null, have an empty set and link with nothing; fewer than five words are one shingle; equal
sets link; ids that occur more than once are one node of the graph and keep one result row per input row; an empty table gives no rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import words as W
from tessera.llm.folders import stored

WORDS = 5
SMALL = 4  # components of one signature that are compared pairwise
SUBPARTS = 4  # parts of a coarse part; a signature leaves one of them out
FIRST = 4  # lowest shingles that near copies are met by
FLUSH = 400_000  # signatures that a task holds before it merges and sends them: about 60 MB with its copies
SHARD_DOCS = 2_000  # documents per shard of the signature shuffle


def shingles(texts: pa.Array, n: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    raw, offsets = W.buffers(texts)
    buf = W.LOWER[raw]
    starts, ends = W.spans(buf, offsets, W.SPACES)
    hashes = W.word_hashes(buf, starts, ends)
    first = np.searchsorted(starts, offsets)
    rolled = W.window_hashes(hashes, n)
    out = []
    for a, b in zip(first.tolist(), first[1:].tolist()):
        out.append(np.unique(rolled[a:b - n + 1]) if b - a >= n else W.window_hashes(hashes[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


class Bands:
    """Size bands and, for each, the number of parts. `percent` is the similarity in hundredths, so all bounds are exact."""

    def __init__(self, percent: int, largest: int):
        self.percent, self.low = percent, [1]
        while self.low[-1] <= largest:
            self.low.append(self.low[-1] * 100 // percent + 1)
        self.low.append(self.low[-1] * 100 // percent + 1)

    def parts(self, band: int) -> tuple[int, int]:
        """(x, coarse parts) of the join of `band` with itself and the next band: k = |x ^ y| <= (|x| + |y|) (1 - s) / (1 + s)."""
        u = self.low[band + 1] - 1
        k = (u + u * 100 // self.percent) * (100 - self.percent) // (100 + self.percent)
        x = max(1, k // 16) if k else 0
        return x, k // 2 + 1 + x


def signatures(grams: np.ndarray, bands: Bands) -> np.ndarray:
    """The signatures of one set: those of its own band's join and of the join with the band below."""
    own = int(np.searchsorted(bands.low, len(grams), "right")) - 1
    out = []
    for band in {own, max(0, own - 1)}:
        x, parts = bands.parts(band)
        salt = np.uint64((band * 0x9E3779B97F4A7C15 + 0x1234567) & (1 << 64) - 1)
        if not x:
            out.append(W.mix(np.array([np.add.reduce(W.mix(grams ^ salt))], np.uint64)))
            continue
        fine = parts * SUBPARTS
        spread = W.mix(grams ^ salt)
        part = ((spread >> np.uint64(32)) * np.uint64(fine) >> np.uint64(32)).astype(np.int64)
        sums, count = np.zeros(fine, np.uint64), np.bincount(part, minlength=fine)
        np.add.at(sums, part, W.mix(spread + np.uint64(1)))
        sums, count = (v.reshape(parts, SUBPARTS).sum(1, keepdims=True).repeat(SUBPARTS, 1).ravel() - v for v in (sums, count))
        sums = W.mix(sums + W.mix(np.arange(1, fine + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) ^ salt))
        out.append(sums[np.lexsort((sums, count))[x:]])
    return np.concatenate(out)


def jaccard_at_least(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common > 0 and 100 * common >= percent * (len(a) + len(b) - common)


def _digest(grams: np.ndarray) -> tuple[int, int]:
    """Two 64-bit names of a whole set."""
    if not len(grams):
        return 0, 0
    return tuple(int(x.view(np.int64)) for x in (np.add.reduce(W.mix(grams)), np.bitwise_xor.reduce(W.mix(grams + np.uint64(7)))))


def _sizes(docs: DataFrame) -> DataFrame:
    """(doc, n_shingles, d1, d2, low) of each row; low: the FIRST lowest shingles."""
    def scan(batches):
        for whole in batches:
            for batch in W.slices(whole, "text"):
                sets = shingles(batch.column("text"))
                names = [_digest(s) for s in sets]
                yield pa.record_batch([batch.column("doc"), pa.array([len(s) for s in sets], pa.int64()), *(pa.array([x[i] for x in names], pa.int64()) for i in (0, 1)),
                                       pa.array([x[:FIRST].view(np.int64) for x in sets], pa.list_(pa.int64()))], ["doc", "n_shingles", "d1", "d2", "low"])

    return docs.mapInArrow(W.tidy(scan), "doc long, n_shingles long, d1 long, d2 long, low array<long>")


def _first_pairs(sizes: DataFrame) -> DataFrame:
    """(a, b, large): each document with the smallest one that shares one of its FIRST lowest shingles."""
    rows = sizes.filter("doc is not null").select("doc", F.explode("low").alias("gram"))
    lead = rows.groupBy("gram").agg(F.min("doc").alias("a"), F.max("doc").alias("z")).filter("a < z").drop("z")
    return rows.join(lead, "gram").filter("doc != a").select("a", F.col("doc").alias("b"), F.lit(0).cast("long").alias("large")).distinct()


def _one_each(s: np.ndarray, comp: np.ndarray, doc: np.ndarray, mark: np.ndarray):
    """(s, comp, doc, group, marked): the smallest document of each component of each signature, and whether its group holds others or is
    marked; groups are numbered."""
    order = np.lexsort((doc, comp, s))
    s, comp, doc, mark = s[order], comp[order], doc[order], mark[order]
    new = np.r_[True, s[1:] != s[:-1]][:len(s)]
    one = new | np.r_[True, comp[1:] != comp[:-1]][:len(s)]
    group = np.cumsum(new) - 1
    size = int(new.sum())
    marked = (np.bincount(group, ~one, size) > 0) | (np.bincount(group, mark, size) > 0)
    return s[one], comp[one], doc[one], group[one], marked


def _packed(docs: DataFrame, bands: Bands, shards: int) -> DataFrame:
    """(shard, sigs, comps, docs, marks): packed signatures of (doc, comp, text) rows; comps holds comp ^ doc, mostly 0. Where more than SMALL components of a task share one,
    the first stands for them with a mark, and the others are paired with it in a row of shard -1."""
    def pack(s, *columns):
        shard = ((s >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)  # ascending, as s is
        cut = np.searchsorted(shard, np.arange(shards + 1))
        return [(k, *(W.planes(x[a:b]) for x in (s, *columns))) for k, (a, b) in enumerate(zip(cut, cut[1:])) if b > a]

    def scan(batches):
        sigs, owners, seen, held = [], [], {}, 0

        def flush():
            n = [len(x) for x in sigs]
            d, c = (np.repeat(np.array(x, np.int64), n) for x in zip(*owners))
            s, c, d, group, marked = _one_each(np.concatenate(sigs), c, d, np.zeros(len(d), np.uint8))
            head = np.r_[True, group[1:] != group[:-1]]
            large = (np.bincount(group) > SMALL)[group]
            lead = d[np.flatnonzero(head)[group]]
            hidden = large & ~head
            rows = pack(s[~hidden], (c ^ d)[~hidden], d[~hidden], (marked[group] | large)[~hidden].astype(np.uint8))
            if hidden.any():
                rows.append((-1, b"", d[hidden].tobytes(), lead[hidden].tobytes(), b""))  # pairs in place of components and documents
            k, *data = zip(*rows)
            return pa.record_batch([pa.array(k, pa.int32()), *(pa.array(x, pa.binary()) for x in data)], ["shard", *SENT])

        for whole in batches:
            for batch in W.slices(whole, "text"):
                for doc, comp, s in zip(batch.column("doc").to_pylist(), batch.column("comp").to_pylist(), shingles(batch.column("text"))):
                    if not len(s) or seen.setdefault(_digest(s), doc) != doc:
                        continue  # equal sets are linked by their digest
                    sigs.append(signatures(s, bands))
                    owners.append((doc, comp))
                    held += len(sigs[-1])
                if held > FLUSH:
                    yield flush()
                    sigs, owners, seen, held = [], [], {}, 0
        if held:
            yield flush()

    return docs.select("doc", "comp", "text").mapInArrow(W.tidy(scan), "shard int, " + ", ".join(f"{c} binary" for c in SENT))


SENT = ("sigs", "comps", "docs", "marks")
_KINDS = {"sigs": np.uint64, "marks": np.uint8}


def _read(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [W.from_planes(table[c].to_pylist(), _KINDS.get(c, np.int64)) for c in names]


def _pairs(both: np.ndarray, large: np.ndarray | bool) -> pa.Table:
    both = np.sort(both, axis=1)
    both = np.concatenate([both, np.broadcast_to(np.asarray(large, np.int64).reshape(-1, 1), (len(both), 1))], 1)[both[:, 0] != both[:, 1]]
    both = np.unique(both, axis=0)
    return pa.table({"a": both[:, 0], "b": both[:, 1], "large": both[:, 2]})


PAIRS = "a long, b long, large long"


def _candidates(packed: DataFrame) -> DataFrame:
    """(a, b, large), a < b: candidate pairs; `large` if one came from a group whose pairs are not all candidates."""
    def pair(key, table):
        if key[0].as_py() < 0:
            a, b = (np.frombuffer(b"".join(table[c].to_pylist()), np.int64) for c in ("comps", "docs"))
            return _pairs(np.stack([a, b], 1), True)
        s, c, d, mark = _read(table, *SENT)
        s, _, d, group, marked = _one_each(s, c ^ d, d, mark)
        head = np.r_[True, group[1:] != group[:-1]][:len(group)]
        large = (np.bincount(group) > SMALL)[group]
        out, flags = [], []
        for lag in range(1, min(SMALL, len(s))):
            i = np.flatnonzero((group[lag:] == group[:-lag]) & ~large[lag:])
            out.append(np.stack([d[i], d[i + lag]], 1))
            flags.append(marked[group[i]].astype(np.int64))
        rest = np.flatnonzero(large & ~head)
        out.append(np.stack([d[np.flatnonzero(head)[group[rest]]], d[rest]], 1))
        flags.append(np.ones(len(rest), np.int64))
        return _pairs(np.concatenate(out), np.concatenate(flags))

    # the pairs inside a task are not gathered: each packed row is a group of its own
    dealt = packed.withColumn("deal", F.when(F.col("shard") >= 0, F.lit(0).cast("long")).otherwise(F.monotonically_increasing_id()))
    found = dealt.groupBy("shard", "deal").applyInArrow(pair, PAIRS)
    return found.groupBy("a", "b").agg(F.max("large").alias("large"))


def _rare_pairs(members: DataFrame, percent: int) -> DataFrame:
    """(a, b): documents of different components that share one of their rarest shingles, where what is left from there on can still be
    enough for a link; members: (doc, comp, text).

    Links have |x & y| (100 + percent) >= percent (|x| + |y|). In the order of (frequency, shingle) all that two sets share lies at or after
    the first common place of either, so the rest of both sets must be that large. The smaller set of a link misses at most
    n - ceil(2 percent n / (100 + percent)) elements of the larger one, the larger set n - ceil(percent n / 100) of the smaller one."""
    def scan(batches):
        for whole in batches:
            for batch in W.slices(whole, "text"):
                sets = shingles(batch.column("text"))
                yield pa.record_batch([batch.column("doc"), batch.column("comp"), pa.array([len(x) for x in sets], pa.int64()),
                                       pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], ["doc", "comp", "n", "grams"])

    rows = stored(members.select("doc", "comp", "text").mapInArrow(W.tidy(scan), "doc long, comp long, n long, grams array<long>")
                  .select("doc", "comp", "n", F.explode("grams").alias("gram")).distinct(), "jaccard-rare")
    ranked = rows.join(rows.groupBy("gram").agg(F.count("*").alias("f")).filter("f > 1"), "gram", "left").withColumn("f", F.coalesce("f", F.lit(1)))
    place = F.row_number().over(Window.partitionBy("doc").orderBy("f", "gram"))
    prefix = (ranked.withColumn("place", place).withColumn("rest", F.expr("n - place + 1")).filter(f"100 * rest >= {percent} * n and f > 1")
              .select("gram", "doc", "comp", "n", "rest"))
    x, y = (prefix.select("gram", *[F.col(c).alias(f"{c}{side}") for c in ("doc", "comp", "n", "rest")]) for side in "ab")
    both = x.filter(f"{100 + percent} * resta >= {2 * percent} * na").join(y, "gram").filter(
        f"compa != compb and (na < nb or na = nb and doca < docb) and {100 + percent} * least(resta, restb) >= {percent} * (na + nb)")
    return both.select(F.least("doca", "docb").alias("a"), F.greatest("doca", "docb").alias("b")).distinct()


BROADCAST_ROWS = 1_000_000  # ids: at most about 30 MB


def _among(docs: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows of `docs` by a stored list of ids: broadcast only while the counted list is small, else joined by shuffle."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, "doc", how)


def _compared(docs: DataFrame, pairs: DataFrame, pack, test) -> DataFrame:
    """Of stored pairs (a, b) those that `test` accepts on the packed sets of both documents."""
    ids = stored(pairs.select(F.col("a").alias("doc")).union(pairs.select("b")).distinct(), "jaccard-ids")

    def sets(batches):
        for whole in batches:
            for batch in W.slices(whole, "text"):
                yield pa.record_batch([batch.column("doc"), pa.array([pack(s).tobytes() for s in shingles(batch.column("text"))], pa.binary())], ["doc", "grams"])

    held = _among(docs, ids).mapInArrow(W.tidy(sets), "doc long, grams binary")

    def check(batches):
        for batch in batches:
            good = [test(x, y) for x, y in zip(batch.column("ga").to_pylist(), batch.column("gb").to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    both = (pairs.select("a", "b").join(held.select(F.col("doc").alias("b"), F.col("grams").alias("gb")), "b")
            .join(held.select(F.col("doc").alias("a"), F.col("grams").alias("ga")), "a"))
    return stored(both.select("a", "b", "ga", "gb").mapInArrow(W.tidy(check), "a long, b long").distinct(), "jaccard-links")


def _verify(docs: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The links among stored pairs: a screen on 16-bit hashes, of which equal elements have equal ones, then the whole sets."""
    def may(x: bytes, y: bytes) -> bool:
        a, b = np.frombuffer(x, np.uint16), np.frombuffer(y, np.uint16)
        seen = np.zeros(1 << 16, bool)
        seen[b] = True
        most = min(int(seen[a].sum()), len(b))
        return 100 * most >= percent * (len(a) + len(b) - most)

    def are(x: bytes, y: bytes) -> bool:
        return jaccard_at_least(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent)

    likely = _compared(docs, pairs, lambda s: (s >> np.uint64(48)).astype(np.uint16), may)
    return _compared(docs, likely, lambda s: s, are)


def components(edges: DataFrame) -> DataFrame:
    """(doc, comp): each node of an edge with the smallest node that it reaches. Alternates large-star and small-star steps until the
    edges no longer change; every step leaves stars of smaller roots, so the number of rounds grows with the logarithm of the size."""
    now = stored(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi != lo").distinct(), "components")
    mark = None
    while True:
        new = now.agg(F.count("*"), F.sum(F.expr("cast(xxhash64(hi, lo) as decimal(38, 0))"))).first()
        if new == mark:
            return now.select(F.col("hi").alias("doc"), F.col("lo").alias("comp")).union(now.select(F.col("lo"), F.col("lo")).distinct())
        mark = new
        both = now.union(now.select("lo", "hi")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = stored(both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct(), "components")
        small = large.groupBy("hi").agg(F.min("lo").alias("m"))
        now = stored(large.join(small, "hi").filter("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(small.select("hi", "m")).distinct(), "components")


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(sizes, components): sizes has (doc, n_shingles) per input row, components (doc, comp) of every document that has a link.

    Ids are integers and name one text each; a row without an id has no links."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    named = docs.filter("doc is not null")
    sizes = stored(_sizes(docs), "jaccard-sizes")
    total, largest = sizes.agg(F.count("*"), F.max("n_shingles")).first()
    bands, shards = Bands(percent, int(largest or 1)), max(1, -(-total // SHARD_DOCS))
    some = sizes.filter("n_shingles > 0 and doc is not null")
    classes = stored(some.groupBy("n_shingles", "d1", "d2").agg(F.min("doc").alias("a"), F.max("doc").alias("z")).filter("a < z").drop("z"), "jaccard-classes")
    edges = some.join(classes, ["n_shingles", "d1", "d2"]).filter("doc != a").select("a", F.col("doc").alias("b")).distinct()
    base = components(edges)

    def marked(pairs: DataFrame, comp: DataFrame) -> DataFrame:
        for side in ("a", "b"):
            pairs = pairs.join(comp.select(F.col("doc").alias(side), F.col("comp").alias(f"c{side}")), side, "left").withColumn(f"c{side}", F.coalesce(f"c{side}", side))
        return pairs.filter("ca != cb")

    def per_class(pairs: DataFrame) -> DataFrame:
        """One pair for each two classes of equal sets, as (a, b): the smallest documents of the classes, if their sizes fit."""
        both = marked(pairs, base).groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.max("large").alias("large"))
        for side in ("a", "b"):
            both = both.join(some.groupBy(F.col("doc").alias(side)).agg(F.max("n_shingles").alias(f"n{side}")), side)
        return both.select("a", "b", "large", F.expr(f"100 * least(na, nb) >= {percent} * greatest(na, nb)").alias("fit"))

    def joined(comp: DataFrame, links: DataFrame) -> DataFrame:
        return stored(components(comp.select(F.col("doc").alias("a"), F.col("comp").alias("b")).union(links)), "jaccard-comp")

    first = stored(per_class(_first_pairs(sizes)).filter("fit"), "jaccard-near")
    near = joined(base, _verify(named, first, percent))
    placed = named.join(F.broadcast(near) if near.count() <= BROADCAST_ROWS else near, "doc", "left").withColumn("comp", F.coalesce("comp", "doc"))
    examined = stored(per_class(_candidates(_packed(placed, bands, shards))), "jaccard-pairs")
    pairs = examined.filter("fit").join(first.select("a", "b"), ["a", "b"], "left_anti")
    comp = joined(near, _verify(named, pairs, percent))

    doubt = marked(examined.filter("large = 1"), comp)  # examined and not linked, be it for their sizes only
    doubt = stored(doubt.select(F.col("ca").alias("comp")).union(doubt.select("cb")).distinct(), "jaccard-doubt")
    if doubt.isEmpty():
        return sizes, comp
    members = named.select("doc").distinct().join(comp, "doc", "left").withColumn("comp", F.coalesce("comp", "doc")).join(doubt, "comp", "left_semi")
    again = _among(named, stored(members.select("doc", "comp"), "jaccard-members"), "inner")
    more = stored(per_class(_rare_pairs(again, percent).withColumn("large", F.lit(1))).filter("fit").join(pairs, ["a", "b"], "left_anti"), "jaccard-more")
    return sizes, components(comp.select(F.col("doc").alias("a"), F.col("comp").alias("b")).union(_verify(named, more, percent)))


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """(doc, n_shingles, component_id) per input row; a document without links is its own component."""
    sizes, comp = link(docs, id_col, text_col, percent)
    return sizes.select("doc", "n_shingles").join(comp, "doc", "left").select("doc", "n_shingles", F.coalesce("comp", "doc").alias("component_id"))


def one_per_group(docs: DataFrame, percent: int = 80) -> DataFrame:
    """Documents without those that reach a smaller id by links; all columns stay. Rows without an id stay."""
    _, comp = link(docs, percent=percent)
    losers = stored(comp.filter("comp < doc").select(F.col("doc").alias("_loser")), "jaccard-losers")
    small = F.broadcast(losers) if losers.count() <= BROADCAST_ROWS else losers
    return docs.join(small, docs["doc_id"].cast("long") == losers["_loser"], "left_anti")
