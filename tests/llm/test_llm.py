"""Operators of the text subpackage against plain versions, on awkward rows and on the smallest tables."""

import collections
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import byte_bpe, catalog, decontaminate, folders, jaccard_join, kneser_ney, lm_score, pii, quality_rules, suffix_dedup, token_files, warc, words
import brute
import llm_oracle

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
has_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(["alpha", "beta", "gamma", "delta", "rho", "Sigma", "tau", "été", "x"]) + str(r.randrange(40)) for _ in range(n))


BASE = prose(1, 120)
LONG = "\n".join(prose(9, 9) for _ in range(40)) + " " + prose(3, 60_000)
TEXTS = [
    (1, BASE), (2, BASE), (3, BASE.replace("rho", "RHO")), (4, BASE + " one more end"), (5, None), (6, ""), (7, " \t\n\x0b "), (8, "three little words"),
    (9, "three Little words"), (10, "ab" * 400), (11, "a line\n" * 40), (12, prose(2, 70) + "\n" + prose(2, 70)), (13, LONG), (14, "# $ % & | < > * ! ? " * 9),
    (15, "Mail jo.e+x@mail.example.com or call +1 (212) 555-0100, card 4111 1111 1111 1111, host 10.0.0.255 and 10.0.0.256 and +12"),
    (16, "write john.doe (at) example dot com, or jоhn@exаmple.com; plus four nine one seven one two three four five six seven"),
    (17, "ünï ćode 漢字 😀 \x00 \x7f word" * 3), (18, prose(4, 30) + " " + BASE[:400]), (1, BASE), (None, prose(5, 25)), (None, None), (20, "x"), (19, "word " * 30),
]
ITEMS = [(1, " ".join(BASE.split()[20:50])), (2, "Little, words"), (3, None), (4, "..."), (10, prose(2, 14)), (5, "Little words")]


@pytest.fixture(scope="module")
def docs(spark):
    """Rows with nulls, repeats, long texts and columns whose names the operators use themselves."""
    rows = [(i, t, None if k % 4 == 0 else "en", "s", None if t is None else len(t), k, "k", -1, "r", 0.5) for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words long, key string, doc int, row string, kept double").repartition(3).cache()


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


def by_row(rows, *names):
    return sorted((tuple(r[n] for n in names) for r in rows), key=repr)


def want_rows(f):
    return sorted(((i, *f(i, t)) for i, t in TEXTS), key=repr)


def empty(df):
    return df.filter("false")


def test_words_and_hashes():
    buf, offsets = words.buffers(pa.array(["a b", None, "c", "", "d  e"]))
    starts, ends = words.spans(buf, offsets, words.SPACES)
    assert [bytes(buf[a:b]) for a, b in zip(starts, ends)] == [b"a", b"b", b"c", b"d", b"e"]
    huge = pa.array(["z" * (words.BLOCK + 5) + " " + "z" * (words.BLOCK + 5) + " y"])
    buf, offsets = words.buffers(huge)
    h = words.word_hashes(buf, *words.spans(buf, offsets, words.SPACES))
    assert len(h) == 3 and h[0] == h[1] != h[2]


def test_quality_rules(docs):
    rows = quality_rules.apply_policy(quality_rules.ledger(docs)).collect()
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert by_row(rows, *names) == want_rows(lambda i, t: brute.rules(t))
    assert quality_rules.ledger(empty(docs)).count() == 0
    kept = quality_rules.kept_documents(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == sorted(i or 0 for i, t in TEXTS if brute.rules(t)[-1])


def test_rule_policies_and_ablations(docs):
    led = quality_rules.ledger(docs).cache()
    bits = [r.fail_bits for r in led.collect()]
    for version in quality_rules.POLICIES:
        active = quality_rules.mask(quality_rules.POLICIES[version]) | quality_rules.mask(quality_rules.BASE)
        got = {r.rule: (r.n_failed, r.n_sole, r.n_kept_without) for r in quality_rules.ablations(led, version).collect()}
        for k, rule in enumerate(quality_rules.RULES):
            if active >> k & 1:
                b = 1 << k
                assert got[rule.name] == (sum(x & b != 0 for x in bits), sum(x & active == b for x in bits), sum(x & active & ~b == 0 for x in bits))


def test_quality_rules_stay_native(docs):
    plan = quality_rules.apply_policy(quality_rules.ledger(docs))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("block", [decontaminate.BLOCK_WINDOWS, 7])
def test_decontamination(docs, items, block):
    rows = decontaminate.report(decontaminate.scan(docs, items, block_windows=block)).collect()
    assert by_row(rows, "key", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == want_rows(lambda i, t: brute.contamination(t, ITEMS))


def test_decontamination_removes(docs, items):
    clean = decontaminate.clean_documents(docs, items)
    assert clean.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in clean.collect()) == sorted(i or 0 for i, t in TEXTS if not brute.contamination(t, ITEMS)[-1])
    cut = {r.doc_id: r.text for r in decontaminate.remove_spans(docs, items).collect()}
    assert cut[8] == "three " and cut[5] is None and "漢字" in cut[17]
    assert brute.contamination(cut[4], ITEMS)[1] == 0
    assert decontaminate.clean_documents(docs, empty(items)).count() == len(TEXTS) and decontaminate.scan(empty(docs), items).count() == 0


def test_warc(spark):
    body = "<p>" + "é" * 600
    pages = [(1, "http://www.A.example.com/b?q=1#f", body), (2, "https://a.example.com/b?q=1", body), (7, None, body), (3, "http://b.example.com", None), (4, "x y\nz", ""),
             (5, "http://b.example.com/", "tiny"), (6, "http://b.example.com/", "tiny"), (5, "http://b.example.com/", "tiny"), (None, "http://[bad", "y" * 2000), (9, "http://b.example.com:8080/q", "y" * 2000)]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, sha string")
    got = collections.Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(df).collect())
    want = collections.Counter()
    for page, _, html in pages:
        raw = (html or "").encode()
        top = max((p for p, _, h in pages if (h or "") == (html or "") and p is not None), default=None)
        again = len(raw) >= 1000 and page is not None and page != top
        want[page, len(raw), "revisit" if again else "response", top if again else None] += 1
    assert got == want
    assert warc.round_trip(empty(df)).count() == 0


def test_warc_search(spark):
    df = spark.createDataFrame([(i, f"http://h{i % 7}.example.com/{i % 50}", f"page {i}") for i in range(900)], "page_id long, url string, html string")
    folder = folders.new_folder(spark, "warc")
    index = warc.build_index(warc.write(df, folder, archive_bytes=9000), folder, block_lines=11)
    for i in (0, 3, 349):
        found = warc.search(spark, [f"https://h{i % 7}.example.com/{i % 50}"], index, folder)
        assert sorted(b.decode() for _, b in found) == sorted(f"page {k}" for k in range(900) if k % 7 == i % 7 and k % 50 == i % 50)
    assert warc.search(spark, ["http://none.example.com/"], index, folder) == []
    assert warc.surt("http://www.A.example.com:80/x?y#z") == "com,example,a)/x?y"


def test_pii(docs):
    rows = pii.find(docs).collect()
    def plain(i, t):
        p = brute.plain_pii(t)
        return (*(sum(k == kind for k, _, _ in p) for kind in pii.KINDS), brute.sha(",".join(f"{k}:{a}:{b}" for k, a, b in p)))
    assert by_row(rows, "key", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == want_rows(plain)
    spans = {r.key: r.spans.split(",") for r in rows}
    text = dict(TEXTS)[16]
    assert {text[int(a):int(b)] for _, a, b in (s.split(":") for s in spans[16])} == {
        "john.doe (at) example dot com", "jоhn@exаmple.com", "plus four nine one seven one two three four five six seven"}
    assert pii.find(empty(docs)).count() == 0
    masked = {r.doc_id: r.text for r in pii.masked_documents(docs).collect()}
    assert masked[16] == "write <email>, or <email>; <phone>" and masked[5] is None and masked[13] == LONG
    assert masked[15].startswith("Mail <email> or call <phone>, card <card>, host <ip> and 10.0.0.256")


@pytest.mark.parametrize("text,want", [
    ("look at example.com dot", []), ("ip one nine two dot 168 dot 1 dot 1 x", ["one nine two dot 168 dot 1 dot 1"]), ("a[at]b[dot]org", ["a[at]b[dot]org"]),
    ("a@b.org and ａ＠ｂ．ｏｒｇ", ["ａ＠ｂ．ｏｒｇ"]), ("un un un un", []), ("the dot at the end", []), ("a@b.org", []),
    ("call plus 49 30 1234567 now", ["plus 49 30 1234567"]), ("+49 one seven 0 123456", ["+49 one seven 0 123456"]), ("a at b dot org", ["a at b dot org"]),
    ("a&#64;b.org", ["a&#64;b.org"]), ("a@b&#46;org", ["a@b&#46;org"]), ("4111 1111 1111 one one one one", ["4111 1111 1111 one one one one"]),
    ("a at b[dot]org", ["a at b[dot]org"]), ("host 10.0.0 dot 7", ["10.0.0 dot 7"])])
def test_pii_disguises(text, want):
    assert [text[a:b] for _, a, b in pii.disguised_spans(text, pii.plain_spans(text))] == want


def test_pii_plain_random():
    r = random.Random(3)
    for _ in range(3000):
        t = "".join(r.choice("ab@..--+ 0123456789()9@") for _ in range(r.randrange(60)))
        assert [(pii.KINDS[k], a, b) for k, a, b in pii.plain_spans(t)] == brute.plain_pii(t), t
    assert pii.plain_spans("a" * 300_000 + "@" * 10) == [] and pii.plain_spans("1" * 300_000) == []


def test_transform_and_interleave():
    r = random.Random(5)
    groups = [[np.frombuffer("".join(r.choice("ab") for _ in range(r.randrange(1, 40))).encode(), np.uint8) for _ in range(r.randrange(1, 6))] for _ in range(4)]
    bwts = [suffix_dedup.transform(g) for g in groups]
    base, place = 0, {}
    for g, b in zip(groups, bwts):
        string, offset = suffix_dedup.places(b, np.array([len(x) for x in g]))
        for i, (k, o) in enumerate(zip(string, offset)):
            place[base + i] = bytes(g[k][o:])
        base += len(b)
    for rounds in (1, 3, 8):
        rows, block = suffix_dedup.interleave(bwts, rounds)
        cut = [place[i][:rounds] for i in rows]
        assert cut == sorted(cut) and all((x == y) == (a == b) for (a, x), (b, y) in zip(zip(cut, block), list(zip(cut, block))[1:]))
        count = collections.Counter(p[:rounds] for p in place.values() if len(p) >= rounds)
        assert sorted(rows) == sorted(i for i, p in place.items() if len(p) >= rounds and count[p[:rounds]] > 1)


@pytest.mark.parametrize("flush", [suffix_dedup.FLUSH, 5])
def test_suffix_dedup(docs, monkeypatch, flush):
    monkeypatch.setattr(suffix_dedup, "FLUSH", flush)
    short = docs.withColumn("text", F.expr("if(length(text) > 20000, substring(text, 1, 3000), text)"))
    texts = [(suffix_dedup.NO_ID if i is None else i, t[:3000] if t and len(t) > 20000 else t) for i, t in TEXTS]
    texts = [(i, t) for i, t in texts if not (i == suffix_dedup.NO_ID and t is None)]
    short = short.filter("doc_id is not null or text is not null")
    removed = brute.repeats(texts)
    want = []
    for i, t in texts:
        raw = (t or "").encode()
        gone = removed[i]
        want.append((None if i == suffix_dedup.NO_ID else i, len(raw), len(gone), sum(k - 1 not in gone for k in gone), bytes(c for k, c in enumerate(raw) if k not in gone)))
    got = by_row([r.asDict() | {"kept": bytes(r.kept)} for r in suffix_dedup.remove_repeats(short).collect()], "doc", "n_bytes", "n_removed", "n_spans", "kept")
    assert got == sorted(want, key=repr) and suffix_dedup.remove_repeats(empty(short)).count() == 0


def test_suffix_dedup_long_text(spark):
    part = prose(7, 400)
    text = prose(8, 170_000) + part + prose(11, 3000) + part
    assert len(text.encode()) > suffix_dedup.BYTES
    row = suffix_dedup.remove_repeats(spark.createDataFrame([(1, text), (2, part)], "doc_id long, text string")).collect()
    size = len(part.encode())
    got = {r.doc: r.n_removed for r in row}
    assert got[2] == size and got[1] >= size


def test_lm_score(docs, spark):
    trusted = spark.createDataFrame([(1,), (12,), (12,), (None,)], "doc_id long")
    rows = lm_score.cross_entropy_difference(docs, trusted).collect()
    assert len(rows) == len(TEXTS) and all((r.score is None) == (r.n_tokens == 0) for r in rows)
    score = {r.key: r.score for r in rows}
    assert score[12] < score[15] and score[1] < score[14]
    assert lm_score.cross_entropy_difference(empty(docs), trusted).count() == 0
    assert all(r.n_tokens == 0 or r.score is not None for r in lm_score.cross_entropy_difference(docs, empty(trusted)).collect())


def same_losses(rows, want):
    got = by_row(rows, "key", "n_tokens", "target_loss", "background_loss")
    want = sorted(want, key=repr)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert all(x == y if y is None else abs(x - y) < 1e-9 for g, w in zip(got, want) for x, y in zip(g[2:], w[2:]))


@pytest.mark.parametrize("sizes", [{}, {"chunk_tokens": 50, "shard_tokens": 900}])
def test_lm_score_matches_plain(docs, spark, sizes):
    trusted = spark.createDataFrame([(1,), (12,), (12,), (None,)], "doc_id long")
    same_losses(lm_score.cross_entropy_difference(docs, trusted, **sizes).collect(), brute.cross_entropies(TEXTS, {1, 12}))


def test_lm_score_keeps_all_words_and_pairs(spark):
    """More words and pairs than any fixed model size; those of the trusted texts are among the rare ones."""
    r = random.Random(6)
    rows = [(i, " ".join(f"w{k}" for k in range(i // 2 * 4500, i // 2 * 4500 + 4500))) for i in range(200)]
    rows += [(200 + i, " ".join(f"w{r.randrange(60)}" for _ in range(500))) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = lm_score.cross_entropy_difference(df, spark.createDataFrame([(8,), (9,)], "doc_id long")).collect()
    same_losses(got, brute.cross_entropies(rows, {8, 9}))
    assert min(got, key=lambda x: x.score).key in (8, 9)


def test_kneser_ney_sums_to_one(spark):
    text = [(prose(i, 60),) for i in range(20)]
    model = kneser_ney.fit(spark.createDataFrame(text, "text string"))
    vocab = model.uni[0]
    for start in ("alpha1 beta2", "x3 x4", "never seen"):
        h, first = lm_score.text_words(pa.array([start]))
        ctx = np.concatenate([np.concatenate([h, [w]]) for w in vocab]).astype(np.uint64)
        p = kneser_ney.token_probabilities(model, ctx, np.arange(0, len(ctx) + 1, 3))[2::3]
        other = kneser_ney.token_probabilities(model, np.concatenate([h, [np.uint64(12345)]]).astype(np.uint64), np.array([0, 3]))[2]
        assert abs(p.sum() + other - 1) < 1e-4


def test_kneser_ney(docs, spark):
    trusted = spark.createDataFrame([(i,) for i in (1, 2, 4, 12, 18)] + [(None,)], "doc_id long")
    rows = kneser_ney.classify(docs, trusted, quantile=1.0).collect()
    assert len(rows) == len(TEXTS) and all(not r.kept and r.perplexity is None for r in rows if r.n_tokens == 0)
    assert kneser_ney.classify(empty(docs), trusted).count() == 0
    assert all(r.kept for r in kneser_ney.classify(docs, empty(trusted)).collect() if r.n_tokens)


@has_tables
def test_kneser_ney_held_out(spark):
    path = "/root/testdata/sf0.01"
    rows = catalog.queries()["op7_kneser_ney"](spark, path)
    labels = spark.read.parquet(f"{path}/labels.parquet")
    n = {(r.quality, r.kept): r["count"] for r in rows.join(labels.filter("toxic = 0"), "doc_id").groupBy("quality", "kept").count().collect()}
    assert n[1, True] >= 0.97 * (n[1, True] + n.get((1, False), 0)) and n[0, False] >= 0.4 * (n[0, False] + n.get((0, True), 0))


def test_token_files(docs, spark):
    from tokenizers import Tokenizer

    file = P.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(file)
    folder = folders.new_folder(spark, "tokens")
    files = token_files.write(docs, file, folder, file_docs=5)
    assert files.count() > 1
    rows = token_files.digests(spark, files).collect()
    encoded = sorted(((i is not None, i or 0), tok.encode(t or "", add_special_tokens=False).ids + [1]) for i, t in TEXTS)
    want, start = collections.Counter(), {}
    total = 0
    for key, ids in encoded:
        start.setdefault(key, total)
        total += len(ids)
        want[key[1] if key[0] else None, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == want
    assert all(r.start == start[True, r.doc_id] for r in rows if r.doc_id not in (None, 1))
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    for uri in (r.uri for r in files.collect()):
        f = token_files.TokenFile(uri)
        for doc in f.index["doc_id"].tolist():
            if doc in (8, 13):
                assert f.find(doc).tolist() == tok.encode(dict(TEXTS)[doc], add_special_tokens=False).ids + [1]
        with pytest.raises(KeyError):
            f.find(12345)
    assert token_files.round_trip(empty(docs), file).count() == 0


def test_token_file_refuses_another_dictionary(spark):
    folder = folders.new_folder(spark, "tokens")
    df = spark.createDataFrame([(i, prose(i, 30)) for i in range(30)], "doc_id long, text string")
    uri = token_files.write(df, P.path("word_bpe_49k.json"), folder).first().uri
    local = folder.removeprefix("file://")
    name = next(n for n in os.listdir(local) if n.endswith(".dict"))
    with open(f"{local}/{name}", "ab") as f:
        f.write(b"x")
    with pytest.raises(ValueError):
        token_files.TokenFile(uri)


@pytest.mark.parametrize("flush,small", [(jaccard_join.FLUSH, jaccard_join.SMALL), (10, 2)])
def test_jaccard_join(docs, monkeypatch, flush, small):
    monkeypatch.setattr(jaccard_join, "FLUSH", flush)
    monkeypatch.setattr(jaccard_join, "SMALL", small)
    want = brute.jaccard([(i, t) for i, t in TEXTS if i is not None])
    rows = jaccard_join.join(docs).collect()
    assert len(rows) == len(TEXTS)
    assert {r.doc: (r.n_shingles, r.component_id) for r in rows if r.doc is not None} == want
    assert jaccard_join.join(empty(docs)).count() == 0


@pytest.mark.parametrize("small", [jaccard_join.SMALL, 2])
def test_jaccard_join_chains_and_shared_passages(spark, monkeypatch, small):
    monkeypatch.setattr(jaccard_join, "SMALL", small)
    r = random.Random(4)
    passage = prose(77, 60).split()
    rows = []
    for i in range(40):  # a chain of edits, so that its ends are not similar
        w = prose(50, 60).split()
        w[:i] = prose(51, 60).split()[:i]
        rows.append((i, " ".join(w)))
    for i in range(40, 80):  # documents around one passage, some of them near copies of each other
        own = prose(1000 + i // 3, 14).split()
        if i % 3:
            own[r.randrange(14)] = "edit"
        rows.append((i, " ".join(passage[:r.choice((40, 60))] + own)))
    want = brute.jaccard(rows)
    got = {x.doc: (x.n_shingles, x.component_id) for x in jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == want and len({c for _, c in want.values()}) > 5
    kept = jaccard_join.one_per_group(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(x.doc_id for x in kept.collect()) == sorted({c for _, c in want.values()})


def test_jaccard_join_smallest_document_of_unfitting_size(spark):
    """A passage of 4 shingles, alone and with one more, behind many documents of 7 shingles that hold it, link with none and have smaller ids."""
    rows = []
    for p in range(12):
        passage = " ".join(f"p{p}w{k}" for k in range(8))
        rows += [(100 * p + i, f"{passage} a{p}x{i} b{p}x{i} c{p}x{i}") for i in range(40)]
        rows += [(100 * p + 50, passage), (100 * p + 51, f"{passage} end")]
    want = brute.jaccard(rows)
    got = {x.doc: (x.n_shingles, x.component_id) for x in jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == want and all(want[100 * p + 51] == (5, 100 * p + 50) for p in range(12))


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)] + [(500, k) for k in range(501, 540)]
    parent = {}
    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {x.doc: x.comp for x in jaccard_join.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for a, b in edges if a != b for n in (a, b)}


@pytest.mark.parametrize("hot", [byte_bpe.HOT, 3])
def test_byte_bpe(docs, hot):
    import tiktoken

    ranks = byte_bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = byte_bpe.decode(byte_bpe.encode(docs, ranks, P.PATTERN, hot=hot), ranks).collect()
    got = sorted((repr(r.key), np.frombuffer(r.ids, "<u2").tolist(), bytes(r.bytes)) for r in rows)
    assert got == sorted((repr(i), enc.encode_ordinary(t or ""), (t or "").encode()) for i, t in TEXTS)
    assert byte_bpe.encode(empty(docs), ranks, P.PATTERN).count() == 0


@has_tables
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, name):


    status, rows = llm_oracle.check(spark, SF, name)
    assert status == "ok" and rows > 0


@has_tables
def test_pipeline(spark):
    import tiktoken

    ranks = byte_bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = {i: t for i, t in docs.items() if brute.rules(t)[-1]}
    docs = {i: docs[i] for i, (_, c) in brute.jaccard(docs.items()).items() if i == c}
    docs = {i: t for i, t in docs.items() if not brute.contamination(t, items)[-1]}
    want = []
    for i, t in docs.items():
        for kind, a, b in sorted(brute.plain_pii(t), key=lambda s: -s[1]):
            t = f"{t[:a]}<{kind}>{t[b:]}"
        ids = enc.encode_ordinary(t or "")
        want.append((i, len(ids), brute.sha(",".join(map(str, ids))), brute.sha(t or "")))
    rows = corpus_pipeline.run(spark, SF).collect()
    assert by_row(rows, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)


@has_tables
def test_stages_keep_columns(spark, items):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name
