"""Near copies by comparing every pair of texts."""

import re
from collections import defaultdict


def brute(docs, threshold=0.8):
    """(class id, links) per id by comparing every pair of texts."""
    sets = {}
    for k, t in docs:
        w = re.findall(r"\w+", (t or "").lower())
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    ids = sorted(sets)
    links = defaultdict(set)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and common >= threshold * (len(sets[a]) + len(sets[b]) - common) - 1e-9:
                links[a].add(b)
                links[b].add(a)
    root = {}
    for a in ids:
        if a not in root:
            todo = [a]
            while todo:
                x = todo.pop()
                if x not in root:
                    root[x] = a
                    todo += links[x]
    return {a: (root[a], len(links[a])) for a in ids}
