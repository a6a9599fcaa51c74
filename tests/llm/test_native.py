"""Brute force against the operators written in Spark expressions (and SimHash)."""

import hashlib
import random
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import chat, linededup, rules, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, pos int, key string"
ASCII_SPACE = " \t\n\x0b\x0c\r"


def docs_of(spark, rows):
    """rows of (doc_id, text); the extra columns clash with names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", 1, "x", 7, "k") for i, t in rows], SCHEMA)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


EDGE = [
    (1, None),
    (2, ""),
    (3, "  \t\n "),
    (4, "one"),
    (5, "one two"),
    (5, "one two"),
    (None, "a line\nÉ line"),
    (6, "Ünï  code word x\x85y"),
    (7, "w " * 60_000),
    (8, "\n".join(f"line {i % 7} of x" for i in range(5000))),
]


def test_chat_round_trip(spark):
    rng = random.Random(3)
    bits = ["[INST]", "[/INST]", "</s>", "[SEP]", "\\", "</s\\>", "[SEP\\\\]", "a", "\n", "é", "]", "[", "<", "$1"]
    rows = []
    for c in range(40):
        for t in range(rng.randrange(1, 9)):
            text = None if rng.random() < 0.1 else "".join(rng.choices(bits, k=rng.randrange(0, 9)))
            role = rng.choice(["user", "assistant", "assistant", "system", None, "[INST]x</s>"])
            rows.append((c, t, role, text, 1))
    rows += [(99, 0, "user", "tie b", 1), (99, 0, "user", "tie a", 1), (99, 0, "user", "tie a", 1), (None, None, "user", "n", 1)]
    rows += [(100, t, "user" if t % 2 else "assistant", "long " * 50, 1) for t in range(400)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    out = chat.format_conversations(df)
    got = {
        r["conv_id"]: r
        for r in out.select(
            "conv_id", "formatted", "segments", chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("segments")).alias("l")
        ).collect()
    }
    want = {}
    for c, t, role, text, _ in rows:
        want.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        turns.sort()
        r = got[c]
        assert [(x["role"], x["text"]) for x in r["t"]] == [x[1:] for x in turns]
        assert r["l"] == [x[2] for x in turns if x[1] == "assistant"]
        assert "".join(s["text"] for s in r["segments"]) == r["formatted"]
        blocks = sum(i == 0 or turns[i][1] != turns[i - 1][1] for i in range(len(turns)))
        assert r["formatted"].count("</s>") == blocks
    assert chat.format_conversations(df.limit(0)).count() == 0


def brute_rules(text):
    w = words_of(text)
    lines = [x for x in (text or "").split("\n") if words_of(x)]
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
    return (
        len(w),
        sum(map(len, w)),
        len(re.findall(r"[#*$%&|<>]", text or "")),
        len(lines) - len(set(lines)),
        len(hit),
        len(w) < 10 or 100 * len(hit) > 20 * len(w),
    )


def test_rules_metrics_against_brute_force(spark):
    rng = random.Random(5)
    rows = EDGE + [
        (100 + i, " ".join(rng.choices("a b c d e f # $x |\n \n \t".split(" "), k=rng.randrange(0, 80)))) for i in range(60)
    ]
    got = rules.with_metrics(docs_of(spark, rows).select("doc_id", "text", "lang")).collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert Counter((r["doc_id"], *[r[n] for n in names]) for r in got) == Counter((i, *brute_rules(t)) for i, t in rows)


def exact_tail(k, n, p):
    from fractions import Fraction
    from math import comb

    q = Fraction(p)
    return float(sum(comb(n, i) * q**i * (1 - q) ** (n - i) for i in range(k + 1)))


def test_binomial_tail(spark):
    import math

    cases = [(0, 10), (1, 10), (3, 300), (0, 1), (20, 900), (5, 2000)]
    df = spark.createDataFrame(cases, "k long, n long")
    got = df.select("k", "n", rules.binomial_tail_log(F.col("k"), F.col("n"), 0.005).alias("t")).collect()
    for r in got:
        assert math.exp(r["t"]) == pytest.approx(exact_tail(r["k"], r["n"], 0.005), rel=1e-9)


def test_rules_cutoffs_guard_good_documents(spark):
    """Good documents with up to one symbol in a hundred characters stay; noisy ones go."""
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(4000):
        good = i % 2 == 0
        w = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(40)]
        if not good:
            w = [x + "###" for x in w]
        rows.append((i, " ".join(w)))
        labels.append((i, int(good), 0))
    lab = spark.createDataFrame(labels + [(None, 1, 0), (0, 1, 0)], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r["kept"] for r in rules.judge(docs_of(spark, rows), lab).collect()}
    assert all(out[i] for i in range(0, 4000, 2))
    assert not any(out[i] for i in range(1, 4000, 2))
    none = rules.judge(docs_of(spark, rows[:50]), lab.limit(0)).collect()
    assert all(r["kept"] != r["base_failed"] for r in none)
    assert rules.judge(docs_of(spark, rows).limit(0), lab).count() == 0


def brute_lines(rows, min_docs):
    def key(x):
        return x.strip(ASCII_SPACE).translate(str.maketrans(rules_upper, rules_upper.lower()))

    holders = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            holders.setdefault(key(x), set()).add(i)
    out = Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not key(x) or len(holders[key(x)]) < min_docs]
        out[i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()] += 1
    return out


rules_upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(11)
    pool = ["Common", " common ", "É Line", "é line", "x ", "x", "", "  ", "rare 1", "\tTab\r", "tab"]
    rows = EDGE + [(200 + i, "\n".join(rng.choices(pool, k=rng.randrange(1, 12)))) for i in range(30)]
    rows += [(300, "\n".join(["common"] * 200 + ["own line"] + ["x"] * 70)), (201, "Common\nsecond row of 201")]
    for min_docs in (2, 10):
        out = linededup.dedup_lines(docs_of(spark, rows), min_docs=min_docs)
        assert set(SCHEMA_NAMES) <= set(out.columns)
        got = Counter(
            (r["doc_id"], r["n_lines"], r["n_dropped"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in out.collect()
        )
        assert got == brute_lines(rows, min_docs)
    assert linededup.dedup_lines(docs_of(spark, rows).limit(0)).count() == 0


SCHEMA_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def brute_print(text):
    w = [x.translate(str.maketrans(rules_upper, rules_upper.lower())) for x in words_of(text)]
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(rows):
    prints = [brute_print(t) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                a, b = root[i], root[j]
                root = [a if r == b else r for r in root]
    low = {}
    for (d, _), r in zip(rows, root):
        if d is not None:
            low[r] = min(d, low.get(r, d))
    return Counter((d, f"{p:016x}", low.get(r)) for (d, _), p, r in zip(rows, prints, root))


def test_simhash_against_brute_force(spark, monkeypatch):
    rng = random.Random(13)
    rows = list(EDGE)
    for g in range(25):
        w = ["".join(rng.choices("abcdefg", k=5)) for _ in range(rng.choice([2, 3, 30, 400]))]
        for _ in range(rng.randrange(1, 9)):
            v = list(w)
            for _ in range(rng.randrange(0, 4)):
                v[rng.randrange(len(v))] = "changed"
            rows.append((1000 + len(rows), " ".join(v)))
    monkeypatch.setattr(simhash, "CHUNK", 2)  # every bucket goes through chunk pairs
    got = simhash.near_duplicates(docs_of(spark, rows))
    have = Counter((r[0], r[1], r[2]) for r in got.select("doc_id", simhash.hex_of(F.col("fp")), "component_id").collect())
    assert have == brute_components(rows)
    assert simhash.near_duplicates(docs_of(spark, rows).limit(0)).count() == 0


def test_links_find_every_close_pair(spark):
    """Random fingerprints and neighbours at 0 to 5 bits: the same components as all pairs."""
    from tessera.llm.components import components

    rng = random.Random(17)
    fps = set()
    for _ in range(60):
        x = rng.getrandbits(64)
        for _ in range(6):
            y = x
            for b in rng.sample(range(64), rng.randrange(0, 6)):
                y ^= 1 << b
            fps.add(y - (1 << 64) if y >> 63 else y)
    fps = sorted(fps)
    root = {f: f for f in fps}
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if bin((a ^ b) & (2**64 - 1)).count("1") <= 3:
                lo, hi = sorted((root[a], root[b]))
                root = {f: lo if r == hi else r for f, r in root.items()}
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = {r["node"]: r["root"] for r in components(simhash.links(df)).collect()}
    assert {f: got.get(f, f) for f in fps} == root


def test_components_of_a_long_path(spark):
    from tessera.llm.components import components

    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 999)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(301)}, 999: 999, 1000: 999}
