"""Collocations against a brute-force version."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tessera.llm import collocations as co

SCHEMA = "doc_id long, text string, lang string, w1 long, n int, id string, rank int, share int"


def docs_of(spark, rows):
    """rows of (lang, text); the extra columns clash with names the operator uses inside."""
    return spark.createDataFrame([(k % 7, t, lang, 1, 2, "x", 3, 4) for k, (lang, t) in enumerate(rows)], SCHEMA)


def brute(rows, least, percent, top):
    counts, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f = counts.setdefault(lang, Counter())
            for k in (1, 2, 3, 4):
                f.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        often = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        dropped = {
            q
            for p, c in often.items()
            for k in range(2, len(p))
            for i in range(len(p) - k + 1)
            if 100 * c >= percent * f[q := p[i : i + k]]
        }
        rows = []
        for p, a in often.items():
            cuts = [(2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            if p not in dropped:
                rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return out


def made(seed, size):
    rng = random.Random(seed)
    words = ["the", "of", "New", "York", "city", "é", "日本", "x\x85y", "a b", "I", "II", "\x00", "\x1c", "hot", "pair", "ü"]
    weights = [30, 20, 9, 9, 5, 3, 3, 2, 2, 4, 4, 1, 1, 25, 25, 1]
    seps = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x0b", "! ", " ?", ";", ":"]
    rows = []
    for _ in range(size):
        lang = rng.choice(["en", "en", "en", "de", None, "und"])
        text = "".join(rng.choices(words, weights)[0] + rng.choices(seps, [20] * 3 + [1] * 10)[0] for _ in range(rng.randrange(0, 90)))
        if rng.random() < 0.3:
            text += " to be or not to be that is the question " * rng.randrange(1, 4)
        rows.append((lang, text))
    return rows + [("en", None), ("en", ""), ("en", " \t\n"), ("fr", "hot pair " * 20_000), ("en", "end. end of"), (None, "a b " * 50)]


NAMES = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@pytest.mark.parametrize(("hot", "share"), [(co.HOT, 1024), (6, 1024), (0, 4), (co.HOT, 20)])
def test_collocations_against_brute_force(spark, monkeypatch, hot, share):
    monkeypatch.setattr(co, "SHARE", share)
    monkeypatch.setattr(co, "FLUSH", 20)
    rows = made(13, 250)
    for least, percent, top in ((30, 80, 2000), (3, 60, 40)):
        out = co.collocations(docs_of(spark, rows).repartition(6), least, percent, top, hot).collect()
        assert sorted(tuple(r[c] for c in NAMES) for r in out) == sorted(brute(rows, least, percent, top))


def test_no_documents_and_no_candidates(spark):
    assert co.collocations(docs_of(spark, [])).count() == 0
    assert co.collocations(docs_of(spark, [("en", "a b c"), ("en", None)])).count() == 0


def test_windows_stop_at_pieces_and_rare_words():
    ids = np.array([0, 1, 2, 3, 4, -2, 5, 6, -2, 7])
    got = co.cut_windows(ids).tolist()
    assert got == [[0, 1, 2, 3], [1, 2, 3, 4], [2, 3, 4, -1], [3, 4, -1, -1], [5, 6, -1, -1]]


def test_hash_ids_agree_with_sparks(spark):
    words = [("en", "word"), ("de", "ü日本"), ("", "x")]
    got = spark.createDataFrame(words, "lang string, word string").select(co._hash_column()).collect()
    assert [r[0] for r in got] == [co._hash_id(lang, w.encode()) for lang, w in words]
