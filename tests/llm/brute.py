"""Plain models of the operators, for small inputs."""

import re


def words(text, lower=True):
    b = (text or "").encode()
    return (b.lower() if lower else b).split()


def shingle_set(text, width):
    w = words(text)
    if not w:
        return frozenset()
    if len(w) < width:
        return frozenset([tuple(w)])
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1))


def near_duplicates(rows, width, num, den):
    """rows: (doc_id, text), ids distinct -> {doc_id: (n, component)}"""
    sets = {d: shingle_set(t, width) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    lists = {}
    for d, s in sets.items():
        for g in s:
            lists.setdefault(g, []).append(d)
    for d, s in sets.items():
        seen = {}
        for g in s:
            for e in lists[g]:
                if e < d:
                    seen[e] = seen.get(e, 0) + 1
        for e, inter in seen.items():
            if inter * den >= (len(s) + len(sets[e]) - inter) * num:
                a, b = find(d), find(e)
                parent[max(a, b)] = min(a, b)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def split_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
