"""Collocations, the filter audit and packing against plain versions."""

import collections
import itertools
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import catalog, collocations, filter_audit, folders, packing
import brute
import llm_oracle
from test_llm import TEXTS, docs, prose  # noqa: F401  (docs is a fixture)

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"


# ---- collocations ------------------------------------------------------------

def plain_collocations(rows, least, top, inside=50):
    """(text, lang) rows to the ranked phrases."""
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(brute.LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f.update((lang, *w[i:i + k]) for i in range(len(w) - k + 1))
    out = collections.defaultdict(list)
    for (lang, *w), a in f.items():
        if len(w) < 2 or a < least:
            continue
        if len(w) == 2 and any(len(x) == 4 and c >= least and x[0] == lang and w in ([*x[1:3]], [*x[2:4]]) and 100 * c >= inside * a for x, c in f.items()):
            continue
        cuts = [(1_000_000 * a * a // (f[lang, *w[:k]] * f[lang, *w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out[lang].append((-score, -a, " ".join(w).encode(), f[lang, *w[:k]], f[lang, *w[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:top]))


def phrase_rows():
    r = random.Random(5)
    word = lambda: r.choice(["uno", "dos", "tres", "Ünder", "en", "es", "x"]) + r.choice(["", "", "", str(r.randrange(9))])
    rows = [(" ".join(word() for _ in range(r.randrange(1, 40))) + r.choice([".", "!", ",\n", "", "\t"]) + "one two three four five six", r.choice(["en", "es", None])) for _ in range(60)]
    rows += [("hot " + " hot ".join(f"w{r.randrange(50)}" for _ in range(900)), "en"), ("loop back " * 40, "en"), ("es es es es", "en"), ("en en en", "es")]
    return rows + [(None, "en"), ("", None), (" \t\n", "de"), ("a b.c d", ""), (rows[0][0], rows[0][1])] * 3


@pytest.mark.parametrize("options", [{}, {"chunk_tokens": 300, "shard_bytes": 500, "hot_edges": 3}])
def test_collocations(spark, options):
    rows = phrase_rows()
    df = spark.createDataFrame([(t, lang, i, 0, "z") for i, (t, lang) in enumerate(rows)], "text string, lang string, a int, n int, word string").repartition(3)
    for least, top in ((3, 1000), (2, 7)):
        got = collocations.collocations(df, least=least, top=top, **options).collect()
        assert sorted(tuple(r) for r in got) == plain_collocations(rows, least, top)
    assert collocations.collocations(df.filter("false"), **options).count() == 0


def test_paths_are_compacted(spark):
    text = "red one two three four five six end"
    rows = [(text, "en")] * 4 + [("loop back " * 9, "en")]
    g = collocations.graph(spark.createDataFrame(rows, "text string, lang string"), least=4)
    compact = folders.stored(collocations.paths(g), "paths")
    got = {(r.phrase, r.n_words, r.n) for r in collocations.long_phrases(g, compact).collect()}
    assert (text, 8, 4) in got  # one path of six edges
    assert ("loop back loop back", 4, 8) in got  # from the node where the text ends, once around
    assert compact.filter("step > 0").count() == 6


def test_scores_pass_64_bits(spark):
    row = spark.createDataFrame([(3_000_000_000, 5_000_000_000, 7_000_000_000)], "a long, l long, r long")
    assert row.select(collocations._score(F.col("a"), F.col("l"), F.col("r")).alias("s")).first().s == 1_000_000 * 3_000_000_000 ** 2 // (5_000_000_000 * 7_000_000_000)


# ---- filter audit ------------------------------------------------------------

def plain_audit(rows, labels):
    """(id, text, part) rows and {id: (quality, toxic)} to the report."""
    low = {}
    for i, t, _ in rows:
        if i is not None:
            low[t or ""] = min(low.get(t or "", i), i)
    masks = collections.Counter()
    for i, t, part in rows:
        t = t or ""
        w = brute.SPACED.findall(t)
        fails = [len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and low[t] < i]
        q, x = labels.get(i, (0, 0))
        masks[part or "", "".join(f for f, bad in zip("ABCDE", fails) if bad), q == 1, x == 1] += 1
    out = []
    for part in {k[0] for k in masks}:
        mine = [(set(m), good, toxic, n) for (p, m, good, toxic), n in masks.items() if p == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            for step in range(1, 6):
                f, before = order[step - 1], set(order[:step - 1])
                here = [(g, x, n) for m, g, x, n in mine if f in m and not m & before]
                out.append((part, order, step, sum(n for m, _, _, n in mine if not m & (before | {f})), sum(n for *_, n in here),
                            sum(n for m, _, _, n in mine if f in m and m & before), sum(n for m, _, _, n in mine if m == {f}), sum(n for g, _, n in here if g),
                            sum(n for _, x, n in here if x), sum(n * 120 // len(m) for m, _, _, n in mine if f in m)))
    return sorted(out)


NAMES = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit_rows():
    many = [(50 - i, "the same text over and over", "en" if i % 3 else "de") for i in range(40)]  # smaller ids come later
    return [(i, t, None if k % 5 == 0 else "en") for k, (i, t) in enumerate(TEXTS)] + many + [(11, "the same text over and over", "fr"), (None, "the same text over and over", "fr"), (11, "the same text over and over", "fr")]


@pytest.mark.parametrize("files,batches", [(7, 7), (7, 3), (1, 5)])
def test_filter_audit(spark, files, batches):
    rows = audit_rows()
    labels = [(1, 1, 0), (1, 0, 1), (11, 1, 0), (12, 0, 1), (40, 1, 1), (None, 1, 1)]
    folder = folders.new_folder(spark, "audit-test")
    for k in range(files):
        spark.createDataFrame([(*r, "x", 1, b"y") for r in rows[k::files]], "doc_id long, text string, lang string, code string, n int, held binary").coalesce(1).write.mode("append").parquet(folder)
    got = filter_audit.audit_table(spark, folder, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), batches)
    assert sorted(tuple(r[n] for n in NAMES) for r in got.collect()) == plain_audit(rows, {1: (1, 1), 11: (1, 0), 12: (0, 1), 40: (1, 1)})


def test_filter_audit_goes_on_where_it_stopped(spark):
    rows = audit_rows()
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs_at, keep = folders.new_folder(spark, "audit-docs"), folders.new_folder(spark, "audit-state")
    for part in (rows[:30], rows[30:]):  # the second run sees only the files that came after the first
        spark.createDataFrame(part, "doc_id long, text string, lang string").coalesce(1).write.mode("append").parquet(docs_at)
        got = filter_audit.audit(filter_audit.read_stream(spark, docs_at), labels, groups=3, folder=keep)
    assert sorted(tuple(r[n] for n in NAMES) for r in got.collect()) == plain_audit(rows, {})


def test_filter_audit_of_nothing(spark):
    folder = folders.new_folder(spark, "audit-none")
    spark.createDataFrame([], "doc_id long, text string, lang string").write.parquet(folder)
    assert filter_audit.audit_table(spark, folder, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


# ---- packing -----------------------------------------------------------------

def check_packing(packing_, lengths, capacity):
    rows = packing_.rows.collect()
    assert sorted(r.length for r in rows) == sorted(lengths)
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for v in bins.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(bins) == packing_.sequences >= packing_.bound.sequences
    return len(bins)


def fewest(lengths, capacity):
    """Exact bin count of a few pieces."""
    best = len(lengths)

    def place(i, free):
        nonlocal best
        if len(free) >= best:
            return
        if i == len(lengths):
            best = len(free)
            return
        for k in range(len(free)):
            if free[k] >= lengths[i]:
                place(i + 1, free[:k] + [free[k] - lengths[i]] + free[k + 1:])
        place(i + 1, [*free, capacity - lengths[i]])

    lengths = sorted(lengths, reverse=True)
    place(0, [])
    return best


def test_bounds_never_pass_the_optimum():
    r = random.Random(3)
    for _ in range(150):
        lengths = np.array([r.choice([r.randrange(1, 21), 7, 11, 10]) for _ in range(r.randrange(1, 8))])
        bound = packing.lower_bound(lengths, np.ones(len(lengths), np.int64), 20)
        bins, _ = packing.best_fit_decreasing(lengths, 20)
        best = fewest(lengths.tolist(), 20)
        assert bound.sequences <= best <= bins.max() + 1
    assert packing.lower_bound(np.array([11]), np.array([9]), 20).sequences == 9
    assert packing.lower_bound(np.array([7]), np.array([9]), 20).sequences == 5


@pytest.mark.parametrize("seed,lot,rounds", [(1, 50, 4), (2, 20, 2), (3, 1000, 4), (4, 10, 1)])
def test_packing_of_lengths(spark, seed, lot, rounds):
    r = random.Random(seed)
    lengths = [r.choice([64, 33, 32, 31, r.randrange(1, 65), r.randrange(1, 9)]) for _ in range(400)]
    rows = folders.stored(spark.createDataFrame(list(enumerate(lengths)), "row long, length int"), "lengths")
    one_round = check_packing(packing.pack(rows, 64, lot, 1), lengths, 64)
    used = check_packing(packing.pack(rows, 64, lot, rounds), lengths, 64)
    assert used <= one_round and used <= packing.lower_bound(np.array(lengths), np.ones(400, np.int64), 64).sequences + (2 if rounds > 1 else 40)


def test_packing_of_documents(spark, docs):  # noqa: F811
    from tokenizers import Tokenizer

    file = P.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(file)
    done = packing.pack_documents(docs, file, capacity=256, lot=40)
    rows = done.rows.collect()
    want = []
    for i, t in TEXTS:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        for k, a in enumerate(range(0, len(ids), 256)):
            part = np.array(ids[a:a + 256], "<u4")
            want.append((i, k, a, len(part), zlib.crc32(part.tobytes())))
    assert sorted(((r.doc, r.piece, r.start, r.length, r.crc32) for r in rows), key=repr) == sorted(want, key=repr)
    check_packing(done, [w[3] for w in want], 256)
    assert packing.pack_documents(docs.filter("false"), file).rows.count() == 0


def test_words_are_encoded_apart_as_in_the_whole():
    """Odd white space, marks that combine, special tokens and case must not tie words together."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    file = P.path("word_bpe_49k.json")
    tok, encode = Tokenizer.from_file(file), packing.Encoder(file, 1)
    r = random.Random(8)
    signs = ["a", "B", "é", "é", "́", " ", "\n", "\t", "\x0b", "\x0c", "\r", " ", " ", "\x85", "'", "'s", "1", "漢", "😀", "<|endoftext|>", "ß", "İ", "\x1c", "\x00", "-"]
    texts = ["".join(r.choice(signs) for _ in range(r.randrange(0, 30))) for _ in range(400)] + [None]
    for _ in range(2):
        ids, at = encode(pa.array(texts))
        for k, t in enumerate(texts):
            assert ids[at[k]:at[k + 1]].tolist() == [*tok.encode(t or "", add_special_tokens=False).ids, 1]


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("name", ["op11_collocations", "op12_filter_audit"])
def test_new_queries_match_sql(spark, name):
    status, rows = llm_oracle.check(spark, SF, name)
    assert status == "ok" and rows > 0 and name in catalog.oracle_sql()


@pytest.mark.parametrize("odd", [[], ["nul\0word", "\0"]])
def test_words_encoded_in_joined_strings(odd):
    """New words are encoded many to a string; words that have the mark in them are encoded one by one."""
    from tokenizers import Tokenizer

    file, r = P.path("word_bpe_49k.json"), random.Random(4)
    tok = Tokenizer.from_file(file)
    words = [*odd, "\u0301x", "e\u0301", "don't", "'s", "a\u00a0b", "<|endoftext|>", "x<|startoftext|>y", "\u4e2d\u6587", "\U0001f600", "\x01", "\u0100", "\u2028"]
    words += ["".join(r.choices("abcXYZ'.\u00e9\u00df\u0130\u0301#01\u0100\x7f", k=r.randrange(1, 12))) for _ in range(1_000)]
    encode = packing.Encoder(file, 1)
    strings, inner = [], encode.encode
    encode.encode = lambda texts, **k: strings.extend(texts) or inner(texts, **k)
    ids, size = encode.encoded(words)
    assert [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])] == [tok.encode(w, add_special_tokens=False).ids for w in words]
    assert bool(odd) or len(strings) == -(-len(words) // packing.JOINED)
