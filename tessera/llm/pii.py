"""Personal data by offset-preserving deobfuscation.

Plain identifiers are found in the text as written. A chain of transducers then rewrites disguises (homoglyphs, spelled digits, at/dot
wordings) while it records, for each rewritten piece, where it came from; identifiers of the rewritten text are mapped back to spans of the
source. Plain spans always stay; a rewritten one is added when it has at least one rewritten character and meets no plain span of its kind.

A wording of `at` without brackets counts only before a worded dot, so that ordinary prose is left alone.

Defined results: null and empty texts have no spans; very long texts and runs are scanned in linear time; repeated rows give one row each.
Only the named columns are read. Offsets are code points, ends exclusive."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import words as W

KINDS = ("email", "ip", "card", "phone")

# Characters that look like ASCII letters or marks.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "ɡ": "g",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "Ѕ": "S", "І": "I",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "Α": "A", "Β": "B", "Ε": "E", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N",
    "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X", "Ζ": "Z", "․": ".", "。": ".", "﹒": ".", "﹫": "@", "‐": "-", "‑": "-", "−": "-", "﹢": "+",
}
# Digit words of the corpus languages.
DIGITS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
#: Letters that a case-blind match takes for an ASCII letter though lower case leaves them as they are, or apart.
_LIKE_ASCII = str.maketrans({"ſ": "s", "ı": "i", "\u0307": None})
_FOLD = {ord(k): v for k, v in HOMOGLYPHS.items()}
_FOLD |= {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}  # full-width forms
_FOLD |= {zero + d: str(d) for zero in (0x0660, 0x06F0, 0x0966) for d in range(10)}  # Arabic-Indic, Persian and Devanagari digits
_ODD = re.compile("[" + "".join(map(chr, sorted(_FOLD))) + "]")

_OPEN, _CLOSE = r"[ \t]{0,3}[(\[{<][ \t]{0,3}", r"[ \t]{0,3}[)\]}>][ \t]{0,3}"
_AT, _DOT = r"(?:at|arroba|arobase|klammeraffe)", r"(?:dot|punkt|punto|point)"
_BARE_DOT = r"[ \t]{1,3}(?:dot|punkt|punto)[ \t]{1,3}(?=[a-z0-9])"
_HIDDEN = "[\u00ad\u200b\u200c\u200d\u2060\ufeff]"  # signs without width
_DIGIT = "(?:" + "|".join(sorted(DIGITS, key=len, reverse=True)) + ")"
_REWRITE = re.compile(
    rf"(?P<at>{_OPEN}{_AT}{_CLOSE}|&#64;|[ \t]{{1,3}}(?:at|arroba)[ \t]{{1,3}}(?=[a-z0-9-]++(?:\.[a-z0-9-]++)*+(?:{_BARE_DOT}|{_OPEN}{_DOT}{_CLOSE})))"
    rf"|(?P<dot>{_OPEN}{_DOT}{_CLOSE}|&#46;|{_BARE_DOT})"
    rf"|(?P<none>{_HIDDEN}+)"
    rf"|(?P<plus>(?<![a-z0-9])plus[ \t-](?=[0-9]|{_DIGIT}\b))"
    rf"|(?P<digits>(?<![^\W_]){_DIGIT}(?:[ \t-]{_DIGIT})++(?![^\W_]))", re.I)

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


_SIGNS = {"at": "@", "dot": ".", "plus": "+", "none": ""}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: every local part ends at an @, so the search walks over the @ signs."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            last = found.end()
            out.append((start, last))
        else:
            last = max(last, at + 1)
        at = text.find("@", max(at + 1, last))
    return out


def plain_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of identifiers as written, by kind and start."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (g.lstrip("0") for g in m.groups())):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() < 16:
            continue
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def rewrite(text: str) -> tuple[str, list[int], list[tuple[int, int, int, int]]]:
    """The rewritten text, the starts of its pieces, and pieces (rewritten start, end, source start, end) that the transducers changed."""
    folded = text.translate(_FOLD) if _ODD.search(text) else text
    parts, pieces, at, size = [], [], 0, 0
    for m in _REWRITE.finditer(folded):
        kept = folded[at:m.start()]
        new = _SIGNS[m.lastgroup] if m.lastgroup in _SIGNS else "".join(DIGITS[w] for w in re.split(r"[ \t-]", m[0].lower().translate(_LIKE_ASCII)))
        parts += [kept, new]
        size += len(kept)
        pieces.append((size, size + len(new), m.start(), m.end()))
        size, at = size + len(new), m.end()
    parts.append(folded[at:])
    return "".join(parts), [p[0] for p in pieces], pieces


def disguised_spans(text: str, plain: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Identifiers that appear only after the rewriting, as spans of the source."""
    if not _ODD.search(text) and not _REWRITE.search(text):
        return []
    clear, starts, pieces = rewrite(text)

    def source(p: int, end: bool) -> int:
        k = bisect_right(starts, p - 1 if end else p) - 1
        if k < 0:
            return p
        a, b, s, e = pieces[k]
        inside = p <= b if end else p < b
        return (e if end else s) if inside else e + p - b

    have: dict[int, list] = {}
    for kind, a, b in plain:
        have.setdefault(kind, []).append((a, b))
    out = []
    for kind, a, b in plain_spans(clear):
        s, e = source(a, False), source(b, True)
        before = have.get(kind, [])
        k = bisect_right(before, (s, 1 << 62))
        meets = k and before[k - 1][1] > s or k < len(before) and before[k][0] < e
        if not meets and text[s:e] != clear[a:b]:
            out.append((kind, s, e))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def _texts(batches):
    for whole in batches:
        for batch in W.slices(whole, "text"):
            yield batch, [t or "" for t in batch.column("text").to_pylist()]


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, n_email, n_ip, n_card, n_phone, base_sha256, spans): counts of plain spans, and all spans as kind:start:end."""
    def scan(batches):
        for batch, texts in _texts(batches):
            rows = []
            for t in texts:
                plain = plain_spans(t)
                spans = sorted(plain + disguised_spans(t, plain))
                rows.append(([sum(k == i for k, _, _ in plain) for i in range(4)], hashlib.sha256(joined(plain).encode()).hexdigest(), joined(spans)))
            yield pa.record_batch([batch.column("key"), *(pa.array([r[0][i] for r in rows], pa.int64()) for i in range(4)),
                                   pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())],
                                  ["key", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    keyed = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    return keyed.mapInArrow(W.tidy(scan), f"key {keyed.schema['key'].dataType.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, "
                                  "base_sha256 string, spans string")


def masked(text: str | None) -> str | None:
    """The text with each identifier replaced by its kind; overlapping spans are replaced as one, under the first kind."""
    if not text:
        return text
    plain = plain_spans(text)
    spans = sorted((a, b, k) for k, a, b in plain + disguised_spans(text, plain))
    parts, at = [], 0
    for a, b, k in spans:
        if a >= at:
            parts += [text[at:a], f"<{KINDS[k]}>"]
        at = max(at, b)
    return "".join(parts) + text[at:] if spans else text


def masked_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows and columns, with the text masked."""
    def scan(batches):
        for whole in batches:
            for batch in W.slices(whole, text_col):
                texts = [masked(t) for t in batch.column(text_col).to_pylist()]
                k = batch.schema.get_field_index(text_col)
                yield batch.set_column(k, batch.schema.field(k), pa.array(texts, batch.schema.field(k).type))

    return docs.mapInArrow(W.tidy(scan), docs.schema)
