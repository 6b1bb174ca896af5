"""Plain brute-force versions that the operators are held against."""

from __future__ import annotations

import re


def shingle_set(text: str | None) -> frozenset:
    letters = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", letters)
    if not words:
        return frozenset()
    if len(words) < 5:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def groups(texts: dict[int, str | None], percent: int) -> dict[int, int]:
    """The smallest id that links reach, by comparing all pairs."""
    sets = {i: shingle_set(t) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def removed_words(texts: dict[int, str], window: int = 20, percent: int = 80) -> dict[int, set[int]]:
    """For each id the words that go: runs of ``window`` words that occur before, and what lies between two similar ones.

    All windows are compared. Windows whose first places follow each other as they do are a run. Two runs are one passage if
    they follow each other in one document further ahead as well, with at most ``window`` other words between them here,
    and the whole is similar there: its places of five-word shingles within runs are the shared ones, all others differ.
    """
    words = {i: [w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", t)] for i, t in texts.items()}
    first: dict[tuple, tuple[int, int]] = {}
    gone: dict[int, set[int]] = {}
    for i in sorted(words):
        own, runs = words[i], []  # runs: from, to before, document and word of the first place
        for n in range(len(own) - window + 1):
            doc, at = first.setdefault(tuple(own[n : n + window]), (i, n))
            if (doc, at) == (i, n):
                continue
            if runs and n <= runs[-1][1] and (doc, at - n) == (runs[-1][2], runs[-1][3] - runs[-1][0]):
                runs[-1][1] = n + window
            else:
                runs.append([n, n + window, doc, at])
        gone[i] = {n for start, end, *_ in runs for n in range(start, end)}
        passage = None
        for start, end, doc, at in runs:
            own_places = end - start - 4
            if passage and passage[1] < start <= passage[1] + window and doc == passage[2] and at >= passage[4]:
                here, there = end - passage[0] - 4, at + end - start - passage[3] - 4
                shared = passage[5] + own_places
                if shared >= percent / 100 * (here + there - shared):
                    gone[i].update(range(passage[1], start))
                    passage = [passage[0], end, doc, passage[3], at + end - start, shared]
                    continue
            passage = [start, end, doc, at, at + end - start, own_places]
    return gone


def top_k(vectors: list[tuple[int, list[float] | None]], queries: list[int], k: int) -> list[tuple]:
    import math

    usable = [
        (i, [math.floor(256 * x) for x in v])
        for i, v in vectors
        if v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    found = []
    for query in sorted(set(queries)):
        mine = [v for i, v in usable if i == query]
        if not mine:
            continue
        q = min(mine)
        scored = sorted((-sum(a * b for a, b in zip(q, v)), i) for i, v in usable if i != query)
        found += [(query, n, i, -score) for n, (score, i) in enumerate(scored[:k], 1)]
    return found
