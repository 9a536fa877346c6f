import os
import random
import re

import numpy as np
import pyarrow as pa

from quillon.llm import divergence
from quillon.llm.divergence import RadixTrie


def slow(rows, least=3, ranks=200):
    """By definition, in Python's integers."""
    counts, docs, groups = {}, {}, set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        for t in found:
            counts[lang, source, t] = counts.get((lang, source, t), 0) + 1
        for t in set(found):
            docs[lang, t] = docs.get((lang, t), 0) + 1
    out = []
    for lang in {g for g, _ in groups}:
        kept = [t for (g, t), n in docs.items() if g == lang and n >= least]
        sources = sorted(s for g, s in groups if g == lang)
        n = {s: {t: counts.get((lang, s, t), 0) for t in kept} for s in sources}
        share = lambda c: {t: 1 + 1000000000 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        p = {s: share(n[s]) for s in sources}
        q = share({t: sum(n[s][t] for s in sources) for t in kept})
        for s in sources:
            found = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources if o != s]
            out += [(lang, s, "pair", o, v, r) for r, (v, o) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode())), 1)]
            found = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if n[s][t] and p[s][t] > q[t]]
            out += [(lang, s, "term", t, v, r) for r, (v, t) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:ranks], 1)]
    return sorted(out)


WORDS = ["the", "The", "été", "ÉTÉ", "naïve", "a1b", "don't", "x_y", "日本", "日", "ab", "abc", "abd", "a", "😀", "zz\x7fz", "\x80", "straße"]


def rows_of(rng, n, words, sources=("s1", "s2", "", None, "ünï")):
    return [(" ".join(rng.choice(words) for _ in range(rng.randrange(12))), rng.choice(["en", "de", None, ""]), rng.choice(sources)) for _ in range(n)]


def check(spark, rows, **how):
    docs = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "text string, lang string, source string, term string, n int, part string").repartition(3)
    found = divergence.audit(docs, **how)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    limits = {k: how[k] for k in how if k in ("ranks",)}
    assert sorted(tuple(r) for r in found.collect()) == slow(rows, **limits)


def test_matches_brute_force(spark, monkeypatch):
    rng = random.Random(1)
    rows = rows_of(rng, 150, WORDS) + [(None, "fr", "lonely"), ("", "en", "silent"), ("1 2 3", "xx", "a"), ("rare", "xx", "b"), ("w " * 5000, "en", "s1")]
    rows += rows[:4]
    check(spark, rows)
    monkeypatch.setattr(divergence, "_CELLS", 8)  # small blocks, sums sent off early
    check(spark, rows, trie_leaves=10, range_leaves=9, block=3)


def test_many_terms_ranks_and_no_rows(spark):
    rng = random.Random(2)
    words = [chr(97 + i % 26) * (1 + i // 26) for i in range(120)]
    check(spark, rows_of(rng, 200, words, ("s1", "s2", "s3")), ranks=7)
    check(spark, [])


def test_tries_merge_and_walk_in_byte_order():
    rng = random.Random(3)
    found = [w.encode() for w in WORDS] + [bytes(rng.choice(b"ab\xc3") for _ in range(rng.randrange(1, 30))) for _ in range(300)]
    wanted = {}
    for i, t in enumerate(found):
        mine = wanted.setdefault((t, i % 3), [0, 0])
        mine[0], mine[1] = mine[0] + i, mine[1] + 1
    parts = []
    for k in range(2):
        at = np.arange(k, len(found), 2)
        parts.append(RadixTrie.of_counts(pa.array([found[i] for i in at], pa.large_binary()), at % 3, at, np.ones(len(at), np.int64)))
    trie = RadixTrie.merged(parts)
    leaves = trie.terms.to_pylist()
    assert leaves == sorted({t for t, _ in wanted})
    assert {(leaves[i], g): [n, d] for i, g, n, d in zip(trie.leaf, trie.group, trie.n, trie.docs, strict=True)} == wanted
    walked = []
    for first, last, shared, sizes, edges, counters, *_ in trie.blocks(7):
        walked += divergence.whole_terms(shared.tolist(), sizes.tolist(), edges)
        assert walked[-len(sizes)] == first and walked[-1] == last and len(counters) == len(sizes)
    assert walked == leaves


def test_shared_lengths():
    words = [b"", b"a", b"abcdefgh", b"abcdefghi", b"abcdefghi\x00", b"abcdefghij" * 3, b"abcdefghij" * 3 + b"z", b"b"]
    sizes = np.array([len(w) for w in words])
    got = divergence.shared_lengths(np.frombuffer(b"".join(words), np.uint8), np.cumsum(sizes) - sizes, sizes)
    assert got.tolist() == [0, *(len(os.path.commonprefix([x, y])) for x, y in zip(words, words[1:], strict=False))]


def test_a_range_gets_its_own_counters_only():
    import pyarrow as pa

    from quillon.llm import divergence as D

    words = sorted({f"{a}{b}{c}" for a in "abcé" for b in "xyz" for c in ("", "k", "kk")}, key=str.encode)
    batch = pa.RecordBatch.from_arrays([pa.array([" ".join(words).encode(), b"axk axk"]), pa.array(["en", "en"]), pa.array(["s", "t"])], names=["text", "lang", "source"])
    blocks = list(D._counting(100, 1024)(iter([batch])))
    cuts = [b"ay", b"bxk", b"c", b"zz"]
    dealt = list(D._dealing(cuts)(iter(blocks)))
    assert sum(len(r["n"]) for b in dealt for r in b.to_pylist()) == len(words) + 1
    found = {r["at"]: D.whole_terms(r["shared"], r["sizes"], r["edges"]) for b in dealt for r in b.to_pylist()}
    assert [t.decode() for at in sorted(found) for t in found[at]] == words
    assert all((at == 0 or t >= cuts[at - 1]) and (at == len(cuts) or t < cuts[at]) for at, ts in found.items() for t in ts)
