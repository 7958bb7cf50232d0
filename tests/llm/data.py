"""Small tables and brute-force versions for the tests."""

import re
from collections import defaultdict

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text, size=5):
    w = words(text)
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def groups(ids, links):
    """Smallest id reachable from each id."""
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def near_groups(docs, percent=75):
    sets = {d: shingles(t) for d, t in docs}
    index = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            index[x].append(d)
    same = defaultdict(int)
    for ids in index.values():
        for i, b in enumerate(ids):
            for a in ids[:i]:
                same[a, b] += 1
    links = [(a, b) for (a, b), n in same.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)]
    return {d: len(s) for d, s in sets.items()}, groups(sets, links)
