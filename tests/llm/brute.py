"""Plain Python versions of what the operators compute, by definition and without haste."""

import hashlib
import re
from collections import Counter, defaultdict


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def space_words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", low(t))


def alnum_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))


def lines(rows, least=10):
    """rows: (id, text). Per row: lines, dropped, kept text."""
    key = lambda x: low(x.strip(" \t\n\x0b\x0c\r"))
    seen = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if key(x):
                seen[key(x)].add(i)
    out = []
    for i, t in rows:
        all_lines = (t or "").split("\n")
        kept = [x for x in all_lines if not key(x) or len(seen[key(x)]) < least]
        out.append((i, len(all_lines), len(all_lines) - len(kept), "\n".join(kept)))
    return out


def shingles(t, k=5):
    w = space_words(t)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def jaccard(rows):
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b) and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {}
    for g, (i, _) in zip(group, rows):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    return [(i, len(s), i if not s else least.get(g, i)) for (i, _), s, g in zip(rows, sets, group)]


def contamination(rows, items, span=10):
    windows = defaultdict(set)
    for item, t in items:
        w = alnum_words(t)
        n = min(span, len(w))
        for p in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[p : p + n])].add(str(item))
    lengths = {len(x) for x in windows}
    out = []
    for i, t in rows:
        w, hit, found = alnum_words(t), set(), set()
        for n in lengths:
            for p in range(len(w) - n + 1):
                got = windows.get(tuple(w[p : p + n]))
                if got:
                    hit.update(range(p, p + n))
                    found |= got
        out.append((i, len(w), len(hit), sorted(found)))
    return out


def repeated_bytes(rows, length=400):
    data = [(t or "").encode() for _, t in rows]
    # by 128 bits of a digest, as the strings of a long text would fill the memory
    name = lambda d, p: hashlib.blake2b(d[p : p + length], digest_size=16).digest()
    seen = Counter(name(d, p) for d in data for p in range(len(d) - length + 1))
    out = []
    for (i, _), d in zip(rows, data):
        gone = bytearray(len(d))
        for p in range(len(d) - length + 1):
            if seen[name(d, p)] > 1:
                gone[p : p + length] = b"\1" * length
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((i, len(d), sum(gone), spans, bytes(c for c, g in zip(d, gone) if not g)))
    return out


def kneser_ney(train, rows, order=3):
    """The model with words kept as text. Per row: tokens, known, base score, score."""
    import math

    end, begin = object(), object()
    seq = lambda t: [*space_words(t), end]

    def grams(t, n):
        s = [begin] * (n - 1) + seq(t)
        return [tuple(s[i : i + n]) for i in range(len(s) - n + 1)]

    words = Counter(g for t in train for g in grams(t, 1))
    counts = {order: Counter(g for t in train for g in grams(t, order))}
    for n in range(order - 1, 0, -1):  # how many different words stand before; as it is after the begin mark
        counts[n] = Counter(g[1:] for g in counts[n + 1])
        for g, c in counts[n + 1].items():
            if g[1] is begin:
                counts[n][g[1:]] += c - 1

    def discounts(values):
        n = [sum(1 for x in values if x == k) for k in (1, 2, 3, 4)]
        if min(n[:2]) == 0:
            return [0, 0.5, 0.75, 0.9]
        y = n[0] / (n[0] + 2 * n[1])
        return [0, *(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0), k) if n[k - 1] else 0.5 * k for k in (1, 2, 3))]

    d = {n: discounts(c.values()) for n, c in counts.items()}
    total, kinds = Counter(), defaultdict(Counter)
    for n in counts:
        for g, c in counts[n].items():
            total[n, g[:-1]] += c
            kinds[n, g[:-1]][min(c, 3)] += 1

    def p(g):
        n, context = len(g), g[:-1]
        if n == 0:
            return 1 / (len(words) + 1)
        if not total[n, context]:
            return p(g[1:])
        c = counts[n][g]
        rest = sum(d[n][k] * kinds[n, context][k] for k in (1, 2, 3)) / total[n, context]
        return (c - d[n][min(c, 3)]) / total[n, context] + rest * p(g[1:])

    big = sum(words.values())
    out = []
    for i, t in rows:
        base = sum(math.log10((words[g] + 0.1) / (big + 0.1 * (len(words) + 1))) for g in grams(t, 1))
        out.append((i, len(seq(t)), sum(g in words for g in grams(t, 1)), base, sum(math.log10(p(g)) for g in grams(t, order))))
    return out, big


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()
