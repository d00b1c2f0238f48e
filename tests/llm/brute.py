"""Plain versions of the operators, for small tables."""

import hashlib
import re

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def mix(h, seed):
    """The splitmix64 finaliser of a shifted value."""
    mask = 2**64 - 1
    x = (h + 0x9E3779B97F4A7C15 * (seed + 1)) & mask
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & mask
    return x ^ (x >> 31)


def fingerprint(text, size=4, words=1):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    found = WORD.findall(low)
    if not found:
        return 0
    k = min(size, len(found))
    hashes = [xxhash.xxh64_intdigest(" ".join(found[i : i + k]).encode(), 42) for i in range(len(found) - k + 1)]
    hashes = [sum((h if w == 0 else mix(h, w)) << (64 * w) for w in range(words)) for h in hashes]
    return sum(1 << b for b in range(64 * words) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def shingle_set(text, size=5):
    found = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(found[i : i + size]) for i in range(max(1, len(found) - size + 1))} if found else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def similar_components(texts, least=0.8):
    """A number for each text: equal ones are connected by pairs of that similarity; every pair that shares a shingle is tried."""
    sets, parent, holders = [shingle_set(t) for t in texts], list(range(len(texts))), {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        for j in set().union(*(holders.get(x, ()) for x in (s or {None}))):
            if jaccard(s, sets[j]) >= least:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for x in s or {None}:
            holders.setdefault(x, set()).add(i)
    return [find(i) for i in range(len(texts))]


def family(rng, n, length=150):
    """Texts that depart from one by a few to many replaced words: their similarities lie on both sides of 0.8."""
    words = [f"f{i}" for i in range(900)]
    base = [rng.choice(words) for _ in range(length)]
    return [" ".join(rng.choice(words) if rng.random() < rate else w for w in base) for rate in (rng.choice((0.005, 0.01, 0.02, 0.04, 0.08)) for _ in range(n))]


def components(prints, distance=4):
    """Component of each fingerprint, as its smallest member."""
    values = sorted(set(prints))
    array, parent = np.array(values, dtype=np.uint64), {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, v in enumerate(values):
        for j in np.flatnonzero(np.bitwise_count(array[i] ^ array) <= distance):
            a, b = find(v), find(values[j])
            parent[max(a, b)] = min(a, b)
    return {v: find(v) for v in values}


def substring(rows, size=20):
    """(doc_id, n_words, n_removed, kept_sha256) of rows (doc_id, text) in their order."""
    seen, out = set(), []
    for doc_id, text in rows:
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for s in range(len(words) - size + 1):
            window = tuple(words[s : s + size])
            if window in seen:
                gone[s : s + size] = [True] * size
            seen.add(window)
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out.append((doc_id, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out
