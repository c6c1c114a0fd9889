"""Plain Python version of the n-gram Jaccard components."""

import re

WORD = re.compile("[^\x20\x09-\x0d]+")
FOLD = {i: i + 32 for i in range(65, 91)}


def shingles(text, k=4):
    w = WORD.findall((text or "").translate(FOLD))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def near(rows, num=85, den=100):
    """{key: (n_shingles, component)} for (key, text) rows."""
    sets = {k: shingles(t) for k, t in rows}
    up = {k: k for k in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and den * min(len(x), len(y)) >= num * max(len(x), len(y)) and not x.isdisjoint(y):
                n = len(x & y)
                if den * n >= num * (len(x) + len(y) - n):
                    p, q = sorted((find(a), find(b)))
                    up[q] = p
    return {k: (len(sets[k]), find(k)) for k in keys}
