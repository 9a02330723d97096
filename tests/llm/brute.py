"""Plain Python versions of the operators' results, for small tables."""

import math
import re
import zlib
from collections import Counter

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def crc(data):
    return zlib.crc32(data) & 0xFFFFFFFF


def shingles(text, width):
    own = words(lower(text))
    if not own:
        return set()
    return {tuple(own[i : i + width]) for i in range(max(1, len(own) - width + 1))}


def components(docs, width, percent):
    sets = {d: shingles(t, width) for d, t in docs}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    where = {}
    for d, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(d)
    pairs = Counter()
    for d, s in sets.items():
        for e, n in Counter(e for x in s for e in where[x] if e > d).items():
            pairs[d, e] = n
    for (d, e), n in pairs.items():
        if 100 * n >= percent * (len(sets[d]) + len(sets[e]) - n):
            a, b = find(d), find(e)
            root[max(a, b)] = min(a, b)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def repeat_words(own, width=8):
    windows = Counter(tuple(own[i : i + width]) for i in range(len(own) - width + 1))
    hit = set()
    for i in range(len(own) - width + 1):
        if windows[tuple(own[i : i + width])] > 1:
            hit.update(range(i, i + width))
    return len(hit)


def base_quality(text):
    text = text or ""
    own = words(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    repeated = repeat_words(own)
    return (
        len(own), sum(map(len, own)), len(re.findall(r"[#*$%&|<>]", text)), dup, repeated,
        len(own) < 20 or 100 * repeated > 30 * len(own),
    )


def bigram_scores(rows, mu):
    """rows: (text, held_out). Base and model scores by the definition, one text after the other."""
    ones, twos, n_docs = Counter(), Counter(), 0
    for text, held in rows:
        if not held:
            own = words(lower(text)) + [None]
            ones.update(own)
            twos.update(zip(["^"] + own, own))
            n_docs += 1
    total, types = sum(ones.values()), len(ones)
    out = []
    for text, _ in rows:
        own = words(lower(text)) + [None]
        base = score = 0.0
        for h, w in zip([("^",)] + own, own):
            p = (ones[w] + 1) / (total + types + 1)
            base += math.log10(p)
            history = n_docs if h == ("^",) else ones[h]
            pair = twos["^" if h == ("^",) else h, w]
            score += math.log10((pair + mu * p) / (history + mu)) if history else math.log10(p)
        out.append((len(own), sum(ones[w] > 0 for w in own), total, base, score))
    return out


def near_lines(docs, min_words=3):
    """Removed lines by comparing all lines: {(doc, line): (kept doc, kept line, distance)}."""
    lines = sorted((d, i, words(x)) for d, t in docs for i, x in enumerate((t or "").split("\n")))
    lines = [x for x in lines if len(x[2]) >= min_words]

    def close(a, b):
        if abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) <= 1
        a, b = sorted((a, b), key=len)
        return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out = {}
    for k, (d, i, own) in enumerate(lines):
        equal = [x for x in lines[:k] if x[2] == own]
        near = equal or [x for x in lines[:k] if close(x[2], own)]
        if near:
            out[d, i] = (near[0][0], near[0][1], 0 if equal else 1)
    return out


def jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b
