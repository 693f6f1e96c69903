"""Plain versions of the text operators, for small inputs."""

import collections
import re
import zlib

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, n=5):
    w = WORD.findall(lower(text))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def components(rows, percent=80):
    """{doc_id: (set size, smallest id linked)}"""
    sets = {d: shingles(t) for d, t in rows}
    up = {d: d for d in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {d: (len(sets[d]), top(d)) for d in ids}


def quality(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = set()
    for i in range(len(w) - 4):
        if windows[tuple(w[i : i + 5])] > 1:
            covered.update(range(i, i + 5))
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def hits(text, items, window=13):
    """(words, words hit, ids of items hit)"""
    w = ITEM_WORD.findall(lower(text))
    covered, found = set(), set()
    for key, item in items:
        v = ITEM_WORD.findall(lower(item))
        if not v:
            continue
        n = min(window, len(v))
        wanted = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)}
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in wanted:
                covered.update(range(i, i + n))
                found.add(key)
    return len(w), len(covered), sorted(str(x) for x in found if x is not None)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())
