"""Plain Python versions of the operators' contracts, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BASE = {"mit": ["mit", "license"], "apache": ["apache", "license"], "gpl": ["general", "public", "license"]}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tokens(text):
    return WORD.findall((text or "").translate(LOWER))


def op1(text):
    w = tokens(text)
    places = [(i, k) for k, p in BASE.items() for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    starts = [i for i, _ in places]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({k for _, k in places}))


def op2(docs, items):
    """docs, items: [(id, text)]; rows (id, words, hit words, items, hash)."""
    windows = defaultdict(set)
    for k, text in items:
        w = tokens(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[i : i + 10])].add(str(k))
    lengths = {len(x) for x in windows}
    for k, text in docs:
        w, hit, found = tokens(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if got := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= got
        yield k, len(w), len(hit), len(found), sha(",".join(sorted(found)))


def op4_targets(sizes):
    """sizes: {source: size}; {source: target}."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    capped, total = {}, sum(sizes.values())
    while True:
        rest = [s for s in order if s not in capped]
        w = sum(weight[s] for s in rest)
        share = {s: (total - sum(capped.values())) * weight[s] / w for s in rest}
        over = [s for s in rest if share[s] > 3 * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: 3.0 * sizes[s] for s in over}


def jaccard_components(rows, k, num, den):
    """rows: [(id, text)]; {id: (set size, least id of its component)}."""
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = [i for i in sets if sets[i]]
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def letters(text):
    """Lower case, every run of what is no letter one space, a space at either end."""
    return " " + "".join(c if c.isalpha() and (c.isascii() or ord(c) >= 128) else " " for c in text.lower()).strip() + " "


def kneser_ney(texts, vocabulary, order=4):
    """p(symbol | context) of interpolated Kneser-Ney over texts (spaces folded), contexts of up to order - 1 symbols."""
    counts = [Counter() for _ in range(order + 1)]
    for t in texts:
        for i in range(len(t)):
            if i >= 1:
                n = min(order, i + 1)
                counts[n][t[i + 1 - n : i + 1]] += 1
    for n in range(order - 1, 0, -1):
        for g in counts[n + 1]:
            counts[n][g[1:]] += 1
    cut = []
    for c in counts:
        n1, n2 = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        cut.append(n1 / (n1 + 2 * n2) if n1 and n2 else 0.5)

    def p(symbol, context):
        n = len(context) + 1
        below = p(symbol, context[1:]) if context else 1 / (len(vocabulary) + 1)
        same = [v for g, v in counts[n].items() if g[:-1] == context]
        if not same:
            return below
        return max(counts[n][context + symbol] - cut[n], 0) / sum(same) + cut[n] * len(same) / sum(same) * below

    return p
