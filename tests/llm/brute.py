"""Plain versions of the operators for small inputs."""

import collections
import hashlib
import math
import re

LOW = {c: c + 32 for c in range(65, 91)}
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def rules(text):
    text = text or ""
    words = SPACED.findall(text)
    lines = [x for x in text.split("\n") if SPACED.search(x)]
    at = collections.defaultdict(list)
    for i in range(len(words) - 7):
        at[tuple(words[i:i + 8])].append(i)
    hit = {p for v in at.values() if len(v) > 1 for i in v for p in range(i, i + 8)}
    n, chars, symbols, dups = len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines))
    failed = n < 20 or 100 * len(hit) > 30 * n
    kept = not (failed or 10 * symbols > n or 2 * dups > len(lines) or chars < 2 * n or chars > 15 * n)
    return n, chars, symbols, dups, len(hit), failed, kept


def contamination(text, items):
    words = ALNUM.findall((text or "").translate(LOW))
    hit, names = set(), set()
    for item, body in items:
        w = ALNUM.findall((body or "").translate(LOW))
        size = min(13, len(w))
        windows = {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if size else set()
        for i in range(len(words) - size + 1 if windows else 0):
            if tuple(words[i:i + size]) in windows:
                hit.update(range(i, i + size))
                names.add(str(item))
    return len(words), len(hit), len(names), sha(",".join(sorted(names))), len(hit) > 0 and 20 * len(hit) >= len(words)


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def plain_pii(text):
    text = text or ""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[ -]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub(r"\D", "", m[0])) <= 15]
    return out


def repeats(docs, length=100):
    """(doc, text) rows to their removed byte sets; rows of one id are one document."""
    seen, removed = {}, collections.defaultdict(set)
    for doc, text in sorted({(d, t or "") for d, t in docs}, key=lambda r: r[0]):
        raw = text.encode()
        for i in range(len(raw) - length + 1):
            if seen.setdefault(raw[i:i + length], (doc, i)) != (doc, i):
                removed[doc].update(range(i, i + length))
    return removed


def jaccard(docs, percent=80):
    """(doc, text) rows to {doc: (set size, component)}."""
    sets = {}
    for doc, text in docs:
        w = SPACED.findall((text or "").translate(LOW))
        sets[doc] = {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def cross_entropies(docs, trusted, weight=0.6, least=2):
    """(doc, text) rows to (doc, words, mean target loss, mean background loss)."""
    texts = [(d, SPACED.findall((t or "").translate(LOW))) for d, t in docs]
    one, two = [collections.Counter(), collections.Counter()], [collections.Counter(), collections.Counter()]
    for d, w in texts:
        for k in (0, 1) if d in trusted else (0,):
            one[k].update(w)
            two[k].update(zip(w, w[1:]))
    vocabulary = {w for w, c in one[0].items() if c >= least}
    inventory = {p for p, c in two[0].items() if c >= least}
    n = [sum(c.values()) for c in one]
    rest = [m - sum(c[w] for w in vocabulary) for m, c in zip(n, one)]

    def loss(k, left, w):
        uni = ((one[k][w] if w in vocabulary else rest[k]) + 1) / (n[k] + len(vocabulary) + 1)
        if (left, w) not in inventory:
            return -math.log((1 - weight) * uni)
        return -math.log(weight * (two[k][left, w] / one[k][left] if one[k][left] else uni) + (1 - weight) * uni)

    return [(d, len(w), *(sum(loss(k, a, b) for a, b in zip([None, *w], w)) / len(w) if w else None for k in (1, 0))) for d, w in texts]
