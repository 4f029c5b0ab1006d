"""Slow, direct versions of the queries' contracts."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def spaced(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def crc(i, m):
    return None if i is None else zlib.crc32(str(i).encode()) % m


def licences(t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    hits = [(k, lab) for p, lab in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")) for q in [p.split()] for k in range(len(w)) if w[k : k + len(q)] == q]
    at = [k for k, _ in hits]
    return len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


def shingles(t):
    w = spaced(low(t))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()


def components(docs):
    sets = {i: shingles(t) for i, t, *_ in docs}
    ids = sorted(sets)
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 70 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


ORDER = 5


def language_model(docs, floor=1 << 19):
    train = [t for i, t, *_ in docs if crc(i, 5) != 1]
    c = Counter(w for t in train for w in [*spaced(low(t)), None])
    total, kinds = sum(c.values()), len(c)
    tops = Counter()
    for t in train:
        b = b"\xff" * ORDER + low(t).encode() + b"\xff"
        for k in range(len(b) - ORDER):
            tops[b[k : k + ORDER + 1]] += 1
    every = sum(tops.values())
    ctx, n = [defaultdict(dict) for _ in range(ORDER + 1)], [Counter() for _ in range(ORDER + 1)]
    for k in range(ORDER + 1):
        grams = Counter()
        for g, x in tops.items():
            grams[g[ORDER - k :]] += x
        for g, x in grams.items():
            n[k][g[:-1]] += x
            if k < 3 or x * floor >= every:
                ctx[k][g[:-1]][g[-1]] = x

    def rate(before, s):
        out, excluded = 0.0, set()
        for k in range(ORDER, -1, -1):
            key = before[ORDER - k :] if k else b""
            seen = ctx[k].get(key, {})
            if not seen:
                continue
            live = {x: y for x, y in seen.items() if x not in excluded}
            left = n[k][key] - sum(seen[x] for x in excluded if x in seen)
            if s in live:
                return out + math.log10(live[s] / (left + len(live)))
            if left + len(live):
                out += math.log10((len(live) + left - sum(live.values())) / (left + len(live)))
            excluded |= set(seen)
        return out - math.log10(256 - len(excluded))

    def score(t):
        w = [*spaced(low(t)), None]
        b = b"\xff" * ORDER + low(t).encode() + b"\xff"
        return len(w), sum(c[x] > 0 for x in w), total, sum(math.log10((c[x] + 0.5) / (total + 0.5 * (kinds + 1))) for x in w), sum(rate(b[k : k + ORDER], b[k + ORDER]) for k in range(len(b) - ORDER))

    return score


def said(spans, kinds):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], kinds.index(s[0])))).encode()).hexdigest()


def _luhn(d):
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def pii(t):
    t, out = t or "", []
    digits = lambda s: re.sub("[^0-9]", "", s)
    out += [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(digits(m[0])) <= 19 and _luhn(digits(m[0]))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(digits(m[0])) <= 15]
    kinds = ["email", "ip", "card", "phone"]
    return tuple(sum(s[0] == k for s in out) for k in kinds) + (said(out, kinds),)


def secrets(t):
    t, out = t or "", []
    key = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY]"
    out += [("assign", *m.span()) for m in re.finditer(rf"""({key})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    kinds = ["assign", "access", "hex"]
    return tuple(sum(s[0] == k for s in out) for k in kinds) + (said(out, kinds),)


def quality(t):
    t = t or ""
    w = spaced(t)
    runs = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    again = {i for k in range(len(w) - 4) if runs[tuple(w[k : k + 5])] > 1 for i in range(k, k + 5)}
    lines = [x for x in t.split("\n") if spaced(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again), len(w) < 10 or 100 * len(again) > 20 * len(w)


def targets(docs):
    size = Counter()
    for _, t, _, s in docs:
        size[s] += len(spaced(t))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    out, left, free = {s: 0.0 for s in names}, 1.5 * sum(size.values()), set(names)
    while free:
        want = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if want[s] > 2 * size[s]}
        if not over:
            return out | want, size
        for s in over:
            out[s] = 2.0 * size[s]
            left -= out[s]
        free -= over
    return out, size


def edits(a, b):
    """Least edit distance of ``a`` to a run of ``b``."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return min(row)
