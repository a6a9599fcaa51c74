"""The n-gram Jaccard join against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tessera.llm import jaccard

SCHEMA = "doc_id long, text string, sid long, n int, row string, prefix string, cell int, root int"


def docs_of(spark, rows):
    """rows of (doc_id, text); the extra columns clash with names the operator uses inside."""
    return spark.createDataFrame([(i, t, 1, 2, "x", "y", 3, 4) for i, t in rows], SCHEMA)


def shingles_of(text, shingle):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)) or frozenset([tuple(w)])


def brute(rows, shingle, percent):
    sets = [shingles_of(t, shingle) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        ids = [x for x in (least.get(r), d) if x is not None]
        least[r] = min(ids) if ids else None
    key = lambda r: tuple(-1 if x is None else x for x in r)
    return sorted(((d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=key)


def made(seed, bases, copies, family):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randrange(1, 6))) for _ in range(300)] + ["É", "ß", "x\x85y", "\x1c"]
    rows = []
    for _ in range(bases):
        words = rng.choices(vocabulary, k=rng.randrange(1, 160))
        for _ in range(rng.randrange(1, copies + 1)):
            own = list(words)
            for _ in range(rng.randrange(0, 4)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            if rng.random() < 0.2:
                own = own + rng.choices(vocabulary, k=rng.randrange(1, 9))
            rows.append(rng.choice([" ", "\n", "\t "]).join(own).replace("a", rng.choice("aA")))
    # a large family around the threshold: links chain it together, many pairs don't link
    words = rng.choices(vocabulary, k=110)
    for _ in range(family):
        own = list(words)
        for _ in range(rng.randrange(0, 4)):
            own[rng.randrange(len(own))] = rng.choice(vocabulary)
        rows.append(" ".join(own))
    rows += [None, "", " \n\t", "one", "ONE", "one two", "one  TWO", "a b c", "a b c", "w " * 3000, "w " * 2000, "\x85"]
    out = [(k * 7 % 1009 if k % 23 else None, t) for k, t in enumerate(rows)]
    return out + [(5, rows[0]), (5, rows[0]), (5, "of its own"), (None, "nobody's"), (None, "no one's")]


KEY = lambda r: tuple(-1 if x is None else x for x in r)


@pytest.mark.parametrize(("shingle", "percent", "chunk"), [(3, 90, 512), (3, 90, 7), (5, 80, 16), (1, 60, 5), (2, 100, 4)])
def test_join_against_brute_force(spark, monkeypatch, shingle, percent, chunk):
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    rows = made(shingle * 10 + chunk, 60, 6, 70)
    out = jaccard.near_duplicates(docs_of(spark, rows).repartition(5), shingle, percent).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=KEY) == brute(rows, shingle, percent)


def test_empty_table(spark):
    assert jaccard.near_duplicates(docs_of(spark, []), 3, 90).count() == 0
    out = jaccard.near_duplicates(docs_of(spark, [(1, None), (None, ""), (3, " ")]), 3, 90).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=KEY) == [(None, 0, None), (1, 0, 1), (3, 0, 3)]


@pytest.mark.parametrize("percent", [50, 80, 90])
def test_cells_find_all_pairs_and_hope_is_never_lost(percent):
    """One list over all sets, position zero: block skips, derived overlaps and prefix bounds lose nothing."""
    rng = np.random.default_rng(percent)
    rank = rng.permutation(1 << jaccard.BUCKET_BITS).astype(np.uint64)
    for _ in range(25):
        base = rng.integers(0, 1 << 63, int(rng.integers(2, 90)), dtype=np.uint64)
        sets = []
        for _ in range(int(rng.integers(2, 50))):
            kept = base[rng.random(len(base)) < rng.choice([0.5, 0.9, 0.97, 1.0])]
            s = np.unique(np.r_[kept, rng.integers(0, 1 << 63, int(rng.integers(0, 5)), dtype=np.uint64)])
            sets.append(s if len(s) else base[:1])
        half = rng.integers(0, 2, len(sets)) if rng.random() < 0.5 else np.full(len(sets), -1)
        columns = {"half": half, "sid": np.arange(len(sets)), "n": np.array([len(s) for s in sets])}
        columns |= {"pos": np.zeros(len(sets), np.int64), "root": np.arange(len(sets))}
        pairs = [
            (i, j)
            for i in range(len(sets))
            for j in range(i)
            if (half[i] < 0 or half[i] != half[j])
            and 100 * (c := len(np.intersect1d(sets[i], sets[j]))) >= percent * (len(sets[i]) + len(sets[j]) - c)
        ]
        got = jaccard.join_cell(jaccard.Cell(columns, sets), percent)
        assert set(map(frozenset, got)) <= set(map(frozenset, pairs))
        assert connects(got, pairs, len(sets))
        prefixes = [jaccard.in_order(s, rank)[: jaccard.prefix_length(len(s), percent)] for s in sets]
        at = [[i * (len(p) - 1) // (jaccard.MARKS - 1) for i in range(jaccard.MARKS)] for p in prefixes]
        many = Counter(t for p in prefixes for t in p.tolist())
        known = [np.r_[p[a], [t for t in p.tolist() if many[t] > 1]].astype(np.uint64) for p, a in zip(prefixes, at)]
        assert connects(jaccard.hopeful(jaccard.Cell(columns, known), percent), pairs, len(sets))


def connects(links, pairs, n):
    """Whether the links connect both ends of every pair."""
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[find(a)] = find(b)
    return all(find(a) == find(b) for a, b in pairs)
