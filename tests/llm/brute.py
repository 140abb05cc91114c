"""Plain restatements of the contracts, one text or pair at a time."""

import hashlib
import re

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def sha(data) -> str:
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def words(text, pattern=SPACED):
    return pattern.findall((text or "").translate(FOLD))


def decontam(text, items, window=13):
    """(n_words, n_hit, sorted ids of items with occurring windows)."""
    doc, hit, found = words(text, ALNUM), set(), set()
    for item_id, body in items:
        item = words(body, ALNUM)
        size = min(window, len(item))
        for i in range(len(item) - size + 1 if item else 0):
            for j in range(len(doc) - size + 1):
                if doc[j : j + size] == item[i : i + size]:
                    hit.update(range(j, j + size))
                    found.add(str(item_id))
    return len(doc), len(hit), sorted(found)


def shingles(text, width=5):
    w = words(text)
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def components(sets, percent=75):
    """Smallest index reachable by links, for each set."""
    label = list(range(len(sets)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = sorted((root(i), root(j)))
                label[y] = x
    return [root(i) for i in range(len(sets))]
