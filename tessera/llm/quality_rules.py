"""Quality rules as a bitmask ledger, with built-in functions only.

`ledger` measures each text once and stores one bit per failed rule. Policies are named, versioned masks over those bits, so a new policy
or an ablation never reads a text again: verdicts are `bits & mask`, ablations are sums over the distinct bit patterns.

Defined results: a null or empty text has zero for every measure and fails `few_words`; repeated rows and equal ids give one row each;
an empty table gives an empty ledger. Only the id and text columns are read, so other columns may have any name."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    name: str
    fails: str  # SQL over the measures


#: The position of a rule is its bit. Add new rules at the end: stored ledgers keep their meaning.
RULES = (
    Rule("few_words", "n_words < 20"),
    Rule("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule("many_symbols", "10 * n_symbols > n_words"),
    Rule("repeated_lines", "2 * n_dup_lines > n_lines"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 15 * n_words"),
)
BASE = ("few_words", "repeated_windows")
#: version -> rules that reject a document
POLICIES: dict[int, tuple[str, ...]] = {1: BASE, 2: tuple(r.name for r in RULES)}


def mask(names: tuple[str, ...]) -> int:
    at = {r.name: i for i, r in enumerate(RULES)}
    return sum(1 << at[n] for n in set(names))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with the measures. Word windows are compared by 64-bit hashes inside one text."""
    one = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    split = one.select(
        "doc_id",
        F.array_remove(F.split("_text", SPACE), "").alias("_words"),
        F.expr(r"filter(split(_text, '\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')").alias("_lines"),
        F.expr("size(regexp_extract_all(_text, '[#*$%&|<>]', 0))").cast("long").alias("n_symbols"))
    hashed = split.select(
        "doc_id", "n_symbols", F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.expr("transform(_words, w -> xxhash64(w))").alias("_h"))
    at = ", ".join(f"_h[i + {k}]" for k in range(WINDOW))
    windows = hashed.withColumn("_win", F.expr(
        f"if(n_words < {WINDOW}, array(), transform(sequence(0, cast(n_words as int) - {WINDOW}), i -> xxhash64({at})))")).drop("_h")
    return windows.withColumn("n_repeat_words", _repeated("_win")).drop("_win")


def _repeated(win: str) -> Column:
    """Words inside windows that occur at least twice: sort (hash, position), keep equal neighbours, merge their intervals."""
    same = "(k > 0 and s[k].h = s[k - 1].h) or (k < size(s) - 1 and s[k].h = s[k + 1].h)"
    hits = f"sort_array(transform(filter(sequence(0, size(s) - 1), k -> {same}), k -> s[k].i))"
    total = (f"aggregate({hits}, named_struct('e', 0, 't', 0L), (a, p) -> named_struct('e', p + {WINDOW}, "
             f"'t', a.t + p + {WINDOW} - greatest(a.e, p)), a -> a.t)")
    pairs = f"sort_array(transform({win}, (h, i) -> named_struct('h', h, 'i', i)))"
    return F.expr(f"case when size(array_distinct({win})) = size({win}) then 0L else transform(array({pairs}), s -> {total})[0] end")


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measures and `fail_bits`."""
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return measure(docs, id_col, text_col).withColumn("fail_bits", bits)


def apply_policy(rows: DataFrame, version: int = 2) -> DataFrame:
    """Adds `base_failed`, `kept` and `policy` to a ledger."""
    return (rows.withColumn("base_failed", F.col("fail_bits").bitwiseAND(F.lit(mask(BASE))) != 0)
            .withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES[version]) | mask(BASE))) == 0)
            .withColumn("policy", F.lit(version)))


def ablations(rows: DataFrame, version: int = 2) -> DataFrame:
    """(rule, n_failed, n_sole, n_kept_without): what each rule of a policy rejects, alone or with others.

    The ledger is first counted by bit pattern, at most 2^rules rows whatever the corpus size."""
    active = mask(POLICIES[version]) | mask(BASE)
    patterns = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(active)).alias("bits")).agg(F.count("*").alias("n"))
    rules = [(r.name, 1 << i) for i, r in enumerate(RULES) if active >> i & 1]
    each = patterns.select("bits", "n", F.explode(F.array(*[
        F.struct(F.lit(n).alias("rule"), F.lit(b).cast("long").alias("bit")) for n, b in rules])).alias("r")).select("bits", "n", "r.*")
    def count(when: Column) -> Column:
        return F.sum(F.when(when, F.col("n")).otherwise(0))
    return each.groupBy("rule").agg(
        count(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"), count(F.col("bits") == F.col("bit")).alias("n_sole"),
        count(F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0).alias("n_kept_without"))


def kept_documents(docs: DataFrame, version: int = 2) -> DataFrame:
    """Documents that the policy keeps, with all their columns.

    The measures are computed beside the row in one projection chain: no join by id, so equal ids stay apart."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc_id"), F.col("text").alias("text"))
    # the row number keeps the filter above the measures: pushed below, it would repeat them inside their own lambdas
    judged = apply_policy(ledger(packed), version).withColumn("_row", F.monotonically_increasing_id())
    kept = judged.filter("kept and _row >= 0")
    return kept.select(*[F.col("doc_id").getField(c).alias(c) for c in docs.columns])
