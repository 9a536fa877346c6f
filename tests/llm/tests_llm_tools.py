"""Slow definitions that tests compare with."""

import re

import xxhash


def normal(text):
    return re.sub(r"[\x20\x09-\x0d]+", " ", text or "")


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_groups(rows):
    """Smallest id of each component of fingerprints within 3 bits."""
    prints = sorted((r.doc_id, slow_fingerprint(r.text)) for r in rows)
    root = {i: i for i, _ in prints}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for n, (i, f) in enumerate(prints):
        for j, g in prints[:n]:
            if bin(f ^ g).count("1") <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return sorted({find(i) for i in root})
