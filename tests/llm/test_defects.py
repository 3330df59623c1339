"""Cases that once crashed or gave wrong rows."""

import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import decontaminate, folders, kneser_ney, pii, token_files
import brute
from test_llm import ITEMS, TEXTS, by_row, docs, items, prose, want_rows  # noqa: F401  (docs and items are fixtures)

P = pytest.importorskip("public_tokenizers")


def test_pii_letters_that_fold_to_ascii():
    """Every code point that a case-blind match takes for a letter of a digit word."""
    letters = {c for w in pii.DIGITS for c in w}
    for c in map(chr, range(0x110000)):
        for x in letters:
            if c != x and re.fullmatch(x, c, re.I):
                word = next(w for w in pii.DIGITS if x in w)
                spelled = word.replace(x, c)
                text = f"call plus four nine {spelled} six one two seven three four five"
                assert pii.disguised_spans(text, pii.plain_spans(text)) == [(3, 5, len(text))], (c, word)
                assert pii.masked(text) == "call <phone>"


@pytest.mark.parametrize("text,want", [
    ("joe​@x.de!", ["joe​@x.de"]), ("call +49­ 30 1234567", ["+49­ 30 1234567"]), ("a​b plain w‍ord", []), ("​", []),
    ("call ſeven six one two", []), ("call fıve six", [])])
def test_pii_signs_without_width(text, want):
    plain = pii.plain_spans(text)
    assert [text[a:b] for k, a, b in sorted(plain + pii.disguised_spans(text, plain)) if "​" in text[a:b] or "­" in text[a:b]] == want


@pytest.mark.parametrize("block", [decontaminate.BLOCK_WINDOWS, 7])
def test_decontamination_in_blocks_keeps_every_column(docs, items, block):  # noqa: F811
    typed = docs.withColumns({"n": F.lit(3).cast("int"), "small": F.lit(1).cast("short"), "at": F.current_date(), "list": F.array(F.lit(1))})
    clean = decontaminate.clean_documents(typed, items, block_windows=block)
    assert clean.columns == typed.columns
    assert sorted(r.doc_id or 0 for r in clean.collect()) == sorted(i or 0 for i, t in TEXTS if not brute.contamination(t, ITEMS)[-1])
    by_int = docs.withColumn("doc_id", F.col("doc_id").cast("int"))
    rows = decontaminate.report(decontaminate.scan(by_int, items, block_windows=block)).collect()
    assert by_row(rows, "key", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == want_rows(lambda i, t: brute.contamination(t, ITEMS))
    cut = {r.doc_id: r.text for r in decontaminate.remove_spans(docs, items, block_windows=block).collect()}
    assert cut[8] == "three " and cut[5] is None


def test_kneser_ney_skips_texts_that_do_not_fit(spark):
    rows = [(i, prose(i, 10 if i % 4 else 3000)) for i in range(80)]
    df = spark.createDataFrame(rows, "key long, text string")
    got = kneser_ney.training_set(df, df.select("key"), 1000, 4000).count()
    held = df.filter(kneser_ney.HELD_OUT).select("key").collect()
    assert got == sum(1 for i, _ in rows if i % 4 and i not in {r.key for r in held})


def test_kneser_ney_null_and_empty_languages_differ(spark):
    rows = [(i, prose(i % 7 if lang == "" else 100 + i, 40), lang) for i, lang in enumerate(["", None] * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = kneser_ney.classify(df, df.select("doc_id"))
    limits = {r.lang: r.t for r in out.groupBy("lang").agg(F.min("threshold").alias("t")).collect()}
    assert len(limits) == 2 and limits[""] != limits[None] and out.count() == 120


def test_token_files_are_cut_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_BYTES", 200)
    df = spark.createDataFrame([(7, prose(i, 30)) for i in range(12)] + [(8, "x"), (3, None)], "doc_id long, text string").repartition(4)
    folder = folders.new_folder(spark, "tokens")
    files = token_files.write(df, P.path("word_bpe_49k.json"), folder)
    assert files.filter("part > 0").count() > 2
    rows = sorted(token_files.digests(spark, files).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [3] + [7] * 12 + [8]
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:]))


def test_token_files_with_a_wide_vocabulary(spark, tmp_path):
    import json

    with open(P.path("word_bpe_49k.json")) as f:
        model = json.load(f)
    size = len(model["model"]["vocab"])
    model["model"]["vocab"] |= {f"<pad{i}>": size + 2 + i for i in range(70_000 - size)}
    model["model"]["vocab"]["é</w>"], old = 69_999 + 2, model["model"]["vocab"].get("é</w>")
    file = tmp_path / "wide.json"
    file.write_text(json.dumps(model))
    assert token_files.id_width(str(file)) == 4 and token_files.id_width(P.path("word_bpe_49k.json")) == 2
    df = spark.createDataFrame([(1, "plain words"), (2, None)], "doc_id long, text string")
    files = token_files.write(df, str(file), folders.new_folder(spark, "tokens"))
    assert {r.doc_id: r.n_tokens for r in token_files.digests(spark, files).collect()} == {1: 3, 2: 1}
