"""Plain versions of the operators' rules, to compare with."""
import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np

ASCII_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text, lower=False):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII_LOWER) if lower else text or "")


def letters(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII_LOWER))


def contamination(rows, items, size=13):
    windows = {}
    for item, text in items:
        w = letters(text)
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i:i + n]), set()).add(item)
    out = []
    for doc, text in rows:
        w, hit, met = letters(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                found = windows.get(tuple(w[i:i + n]))
                if found is not None:
                    hit.update(range(i, i + n))
                    met |= found - {None}
        out.append((doc, len(w), len(hit), sorted(met), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def repeats(rows, size):
    seen = Counter(tuple(w[i:i + size]) for _, t in rows for w in [words(t)] for i in range(len(w) - size + 1))
    out = []
    for doc, text in rows:
        w, gone = words(text), set()
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i:i + size])] > 1:
                gone.update(range(i, i + size))
        out.append((doc, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def shingles(text):
    w = words(text, True)
    return {tuple(w[i:i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set()


def near_groups(rows):
    """Each row's set of shingles, and for each the group of rows that it reaches."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    return sets, [find(i) for i in range(len(rows))]


def one_of_each(rows):
    """One row of each group, under its least id; rows without words stay. For groups with one text under that id."""
    sets, group = near_groups(rows)
    best = {}
    for s, g, (doc, text) in zip(sets, group, rows):
        if s:
            best[g] = min(best.get(g, (doc is None, doc or 0, text)), (doc is None, doc or 0, text))
    return [r for s, r in zip(sets, rows) if not s] + [(None if none else doc, text) for none, doc, text in best.values()]


def near(rows):
    sets, group = near_groups(rows)
    groups = {}
    for g, (doc, _) in zip(group, rows):
        groups.setdefault(g, []).append(doc)
    least = lambda ids: min((d for d in ids if d is not None), default=None)
    out = []
    for i, (doc, _) in enumerate(rows):
        c = least(groups[group[i]]) if sets[i] else doc
        out.append((doc, len(sets[i]), c, doc == c))
    return out


def measures(text):
    w = words(text)
    windows = {}
    for i in range(len(w) - 2):
        windows.setdefault(tuple(w[i:i + 3]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def bigram_model(rows, train):
    tokens = [[*words(t, True), None] for _, t in rows]
    one, two = Counter(), Counter()
    for (doc, _), w in zip(rows, tokens):
        if train(doc):
            one.update(w)
            two.update(zip(["^", *w], w))
    return tokens, one, two


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def log10(x):
    return math.log10(x)
