"""Fixtures of odd rows, and brute-force forms."""

import re
from collections import Counter, defaultdict

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

BASE = " ".join(f"word{i}" for i in range(120))
ODD = [
    (1, BASE, "en", "a", 1),
    (2, BASE.upper().replace(" ", "\n\t"), "en", "a", 1),
    (3, BASE.replace("word60", "other"), "en", None, 1),
    (4, None, None, None, None),
    (5, "", "en", "a", 0),
    (6, "", "en", "a", 0),
    (7, " \n\t ", "en", "a", 4),
    (8, "one two", "en", "a", 7),
    (9, "One  TWO", "en", "a", 8),
    (10, "x" * 30_000, "en", "a", 1),
    (11, "long " * 40_000, "en", "a", 1),
    (12, "日本語 テキスト ünïcode 😀", "de", "a", 1),
    (1, BASE, "en", "a", 1),
    (None, "no id at all", "en", "a", 1),
    (None, BASE, "en", "a", 1),
]


def shingles(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return set()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


def components(ids, links):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def near_pairs(docs, percent=85):
    sets = {i: shingles(t) for i, t in docs}
    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    links = []
    for i, s in sets.items():
        shared = Counter(j for x in s for j in where[x] if j < i)
        links += [(i, j) for j, k in shared.items() if 100 * k >= percent * (len(s) + len(sets[j]) - k)]
    return sets, links
