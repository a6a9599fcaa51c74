"""The operators that run Python in tasks: brute force, exact round trips, held-out accuracy."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontam, nbsvm, packing, pii, pseudolm, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score int, piece int, hits int, lm int, pii int"
SF = "/root/testdata/sf0.001"


def docs_of(spark, rows):
    """rows of (doc_id, text); the extra columns clash with names the operators add or use."""
    return spark.createDataFrame([(i, t, "en", "s", 1, 7, 7, 7, 7, 7) for i, t in rows], SCHEMA)


EDGE = [
    (1, None),
    (2, ""),
    (3, "  \t\n "),
    (4, "one"),
    (5, "one two"),
    (5, "one two"),
    (None, "a line\nÉ line"),
    (6, "Ünï  code word x\x85y \U0001f600"),
    (7, "w " * 30_000),
    (8, "\n".join(f"line {i % 7} of x" for i in range(2000))),
]


# ---- packing


def test_encoder_gives_the_ids_of_tokenizers():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    fast = packing.encoder(packing.default_vocabulary())
    rng = random.Random(1)
    chars = "ab Z9'sté漢  ​\x85́\U0001f600\n\t\r  .,#%½²١ǅʼn"
    texts = ["".join(rng.choices(chars, k=rng.randrange(60))) for _ in range(3000)]
    texts += [t or "" for _, t in EDGE] + ["a" * 20_000, " " * 20_000, "1" * 5000, "don't we'll I'VE", "x <|endoftext|> y"]
    for t, e in zip(texts, slow.encode_batch(texts, add_special_tokens=False)):
        assert list(fast(t)) == e.ids, repr(t[:80])


def test_packing_is_whole_and_tight(spark):
    rng = random.Random(2)
    words = [w for w in "the quick brown fox jumps over lazy dogs and runs away".split()]
    rows = EDGE + [(100 + i, " ".join(rng.choices(words, k=int(rng.lognormvariate(5, 1.2))))) for i in range(400)]
    out = packing.pack(packing.pieces(docs_of(spark, rows), 1024), 1024).collect()
    encode = packing.encoder(packing.default_vocabulary())
    want = Counter()
    for i, t in rows:
        ids = np.array([*encode(t or ""), 2], "<u4")
        start, k = 0, 0
        while start < len(ids):
            end = start + (len(ids) % 1024 or 1024) if k == 0 else start + 1024
            want[i, k, start, end - start, zlib.crc32(ids[start:end].tobytes())] += 1
            start, k = end, k + 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    check_sequences(out)
    least = math.ceil(sum(r.length for r in out) / 1024)
    assert len({r.sequence_id for r in out}) <= max(least + 1, 1.01 * least)
    assert packing.pack(packing.pieces(docs_of(spark, rows).limit(0)), 1024).count() == 0


def check_sequences(out):
    sequences = defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024


def test_islands_merge_and_migrate(spark, monkeypatch):
    monkeypatch.setattr(packing, "ISLAND", 64)
    rng = random.Random(3)
    sizes = [rng.randrange(1, 1024) for _ in range(700)]
    parts = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "doc_id long, length long")
    out = packing.pack(parts, 1024).collect()
    assert Counter((r.doc_id, r.length) for r in out) == Counter(enumerate(sizes))
    check_sequences(out)
    plain = packing.best_fit(sizes, sorted(range(700), key=lambda i: -sizes[i]), [], 1024)
    assert len({r.sequence_id for r in out}) <= 1.05 * len(plain)


def test_evolution_never_loses_to_best_fit_decreasing():
    rng = random.Random(4)
    for seed in range(8):
        sizes = [rng.choice([341, 342, 170, 512, 511, rng.randrange(1, 1024)]) for _ in range(150)]
        order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
        plain = packing.best_fit(sizes, order, [], 1024)
        patterns = [(512, 512), (341, 341, 342), (1, 2)]
        best = packing.evolve(sizes, None, patterns, 1024, 20, 6, seed)
        assert sorted(i for b in best for i in b) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in b) <= 1024 for b in best)
        assert math.ceil(sum(sizes) / 1024) <= len(best) <= len(plain)


# ---- WARC


def fake_record(page, body):
    return f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Page-ID: {page}\r\nContent-Length: {len(body)}\r\n\r\n{body}\r\n\r\n"


@pytest.mark.parametrize("archive,split", [(64 << 20, 16 << 20), (2000, 700)])
def test_warc_round_trip(spark, monkeypatch, archive, split):
    monkeypatch.setattr(warc, "ARCHIVE", archive)
    monkeypatch.setattr(warc, "SPLIT", split)
    rng = random.Random(5)
    html = [None, "", "x", "é" * 60, "WARC/1.1\r\n", "WARC/1.1\r\n\r\n", "a\r\n\r\nb" * 40, "\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n" * 5]
    html += [fake_record(k, "y" * 50) * k for k in range(1, 6)] + ["z" * n for n in (99, 100, 101)]
    html += ["".join(rng.choices("ab\r\n é", k=rng.randrange(300))) for _ in range(20)]
    rows = [(i, None if i % 7 == 0 else f"http://x/{i}\r\nWARC/1.1\r\n", rng.choice(html), "t") for i in range(150)]
    rows += [(rows[3][0], *rows[3][1:]), (1000, "u", "z" * 200, "t"), (1000, "u", "z" * 200, "t"), (1001, "u", "z" * 200, "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, type string").repartition(5)
    got = Counter(tuple(r) for r in warc.round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())
    first = {}
    for i, _, h, _ in rows:
        first[h] = min(i, first.get(h, i))
    want = Counter()
    for i, _, h, _ in rows:
        raw = (h or "").encode()
        again = len(raw) >= 100 and first[h] != i
        want[i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[h] if again else None] += 1
    assert got == want
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_unreachable_candidates_are_rejected(spark):
    found = spark.createDataFrame(
        [(0, 0, 10), (0, 5, 10), (0, 10, 30), (0, 12, 30), (0, 30, 44), (1, 3, 9), (2, 0, None)], "file int, start long, next long"
    )
    assert {tuple(r) for r in warc.reachable(found).collect()} == {(0, 0), (0, 10), (0, 30)}


# ---- decontamination


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_hashed_words_are_the_words():
    rng = random.Random(21)
    texts = [t for _, t in EDGE] + ["".join(rng.choices("abAB É\t,.%\n漢-", k=rng.randrange(80))) for _ in range(500)]
    hashes, counts = decontam.words_of_all(texts)
    plain = [re.findall(rb"[^ \t\n\r\x0b\x0c!-/:-@\[-`{-~]+", (t or "").lower().encode()) for t in texts]
    assert counts.tolist() == [len(w) for w in plain]
    flat = [w for p in plain for w in p]
    assert len(set(zip(flat, hashes.tolist()))) == len(set(flat)) == len(set(hashes.tolist()))
    long = "x" * 700_000 + " yy " + "z" * 600_000
    assert decontam.words_of(long).tolist() == [int(decontam.words_of(w)[0]) for w in long.split()]


def test_bit_parallel_lcs():
    rng = random.Random(6)
    for _ in range(300):
        a, b = (rng.choices([b"a", b"b", b"c", b"d"], k=rng.randrange(1, 70)) for _ in range(2))
        mask = defaultdict(int)
        for i, w in enumerate(a):
            mask[w] |= 1 << i
        assert decontam.common_subsequence(mask, len(a), b) == plain_lcs(a, b)


def invented(rng, n):
    return [rng.choice(["the", "of", "and", "in"]) if rng.random() < 0.4 else "".join(rng.choices("abcdefghij", k=6)) for _ in range(n)]


def leak_case(rng):
    items = [(k, " ".join(invented(rng, rng.randrange(14, 62)))) for k in range(40)]
    items += [(90, "what is it ? Answer: blue whale song today maybe so"), (91, "tiny exact phrase"), (92, None), (93, " ".join(invented(rng, 200))), (40, "")]
    rows, truth = list(EDGE), set()
    for d in range(300):
        w = invented(rng, rng.randrange(20, 400))
        if d % 3 == 0:
            k, text = items[rng.randrange(40)]
            part = text.upper().split() if d % 2 else text.split()
            if d % 4 == 0:  # a paraphrase: some words changed, dropped or added
                for _ in range(max(1, len(part) // 10)):
                    part[rng.randrange(len(part))] = "other"
                part.insert(rng.randrange(len(part)), "extra")
            at = rng.randrange(len(w))
            w[at:at] = part
            truth.add((1000 + d, k))
        rows.append((1000 + d, " ".join(w)))
    rows += [(2000, "so a TINY, exact phrase here"), (2001, "tiny phrase exact"), (2002, items[-2][1]), (2003, "a b " + items[-2][1][:400])]
    truth |= {(2000, 91), (2002, 93), (2003, 93)}
    return items, rows, truth


def test_decontamination_finds_planted_passages_only(spark):
    items, rows, truth = leak_case(random.Random(7))
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    docs = docs_of(spark, rows)
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect()}
    assert got == truth
    blocks = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench, block_items=8).collect()}
    assert blocks == truth
    assert decontam.contaminated(docs.limit(0), bench).count() == 0
    assert decontam.contaminated(docs, bench.limit(0)).count() == 0


def test_passages_near_the_start_are_found_at_every_offset(spark):
    """Windows whose regions are both cut off at the first word still differ."""
    rng = random.Random(9)
    items = [(k, " ".join(invented(rng, n))) for k, n in enumerate((14, 20, 33, 42, 60))]
    index = decontam.build_index(spark, items, np.full(decontam.BUCKETS, 3), 300, 64, 0.2)
    s = decontam.Searcher(index, 0.7, 0.6)
    for k, text in items:
        docs = [" ".join([*invented(rng, before), text, *invented(rng, 30)]) for before in range(70)]
        assert [[h["item_id"] for h in hits] for hits in s.search(docs)] == [[k]] * 70


def test_skipped_windows_lose_no_candidate(spark):
    items, rows, _ = leak_case(random.Random(8))
    index = decontam.build_index(spark, items, np.full(decontam.BUCKETS, 3), 300, 64, 0.4)
    s = decontam.Searcher(index, 0.7, 0.6)
    for _, text in rows[-60:]:
        at = s.columns(decontam.words_of(text))
        got = set(zip(*(c.tolist() for c in s.candidates(at)[:2])))
        want = set()
        for window, (ks, unit) in index.by_window.items():
            for a in range(0, max(1, len(at) - window + window // 4), window // 4):
                part = at[a : a + window]
                own = part[part < len(index.terms)]
                c = unit @ index.basis[own].sum(0) / math.sqrt((index.weight[part].astype(float) ** 2).sum())
                want |= {(int(k), a) for k, x in zip(ks, c) if x >= index.least[k] + 1e-4}
        assert want <= got


def test_randomised_svd_matches_a_dense_one(spark):
    rng = np.random.default_rng(9)
    a = rng.standard_normal((30, 8)) @ rng.standard_normal((8, 50))
    rows = [(i, list(range(50)), a[i].tolist()) for i in range(30)]
    frame = spark.createDataFrame(rows, "k int, at array<int>, weight array<double>").repartition(3)
    v = decontam.randomised_svd(frame, 50, 8)
    right = np.linalg.svd(a)[2][:8]
    assert np.allclose(v @ v.T, right.T @ right, atol=1e-6)


# ---- classifier


def test_dual_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(10)
    rows = [np.unique(rng.integers(0, 30, 8)).astype(np.int32) for _ in range(120)]
    y = np.where(rng.random(120) < 0.5, 1, -1)
    scale = np.zeros(nbsvm.BUCKETS)
    scale[:30] = rng.standard_normal(30)
    w, bias = nbsvm.dual_coordinate_descent(rows, y, scale, epochs=3000)
    x = np.zeros((120, 31))
    for i, f in enumerate(rows):
        v = scale[f]
        x[i, f], x[i, 30] = v / np.linalg.norm(v), 1.0
    full = np.r_[w[:30], bias]
    cost = np.where(y > 0, 120 / (2 * (y > 0).sum()), 120 / (2 * (y < 0).sum()))

    def loss(u):
        return 0.5 * u @ u + (cost * np.maximum(0, 1 - y * (x @ u))).sum()

    best = loss(full)
    u = np.zeros(31)
    for t in range(1, 20_000):  # subgradient descent never gets below it
        bad = y * (x @ u) < 1
        u = u - (1.0 / t) * (u - (cost[bad] * y[bad]) @ x[bad])
        assert loss(u) >= best - 1e-2
    assert loss(u) <= best * 1.05


def test_classifier_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = nbsvm.train(docs, labels)
    out = nbsvm.with_score(docs, model).join(labels, "doc_id").select(nbsvm.is_held_out(F.col("doc_id")).alias("h"), "quality", "score").collect()
    held = [(r.quality, r.score) for r in out if r.h]
    assert held and np.mean([(s >= 0.5) == (q == 1) for q, s in held]) >= 0.9
    assert all((zlib.crc32(str(r.doc_id).encode()) % 3 == 1) == r.h for r in docs.select("doc_id", nbsvm.is_held_out(F.col("doc_id")).alias("h")).collect())


def test_classifier_edges(spark):
    docs = docs_of(spark, EDGE)
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (5, None, 0), (None, 1, 0), (5, 1, 1), (5, 0, 1)], "doc_id long, quality int, toxic int")
    for lab in (labels, labels.limit(0), labels.filter("quality = 1")):
        got = nbsvm.with_score(docs, nbsvm.train(docs, lab)).collect()
        assert len(got) == len(EDGE) and all(0 <= r.score <= 1 for r in got)
    assert nbsvm.with_score(docs.limit(0), nbsvm.train(docs.limit(0), labels)).count() == 0


# ---- personal data

PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def plain_luhn(d):
    s = 0
    for i, c in enumerate(d[::-1]):
        v = int(c) * 2 if i % 2 else int(c)
        s += v // 10 + v % 10
    return s % 10 == 0


def plain_base(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            d = re.sub(r"[^0-9]", "", m.group())
            ok = [
                True,
                k == 1 and all(int(x) <= 255 for x in m.group().split(".")),
                14 <= len(d) <= 19 and plain_luhn(d),
                10 <= len(d) <= 15,
            ][k]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_against_the_patterns():
    rng = random.Random(11)
    for n in range(6000):
        chars = ["ab@.-é 1", "0123456789. -", "+1 (2).-9x", "a@b.c1+ -(0"][n % 4]
        text = "".join(rng.choices(chars, k=rng.randrange(1, 60)))
        assert pii.base_spans(text) == plain_base(text), repr(text)
    rows = [r[0] for r in __import__("duckdb").execute(f"select text from '{SF}/documents.parquet'").fetchall()]
    for t in rows:
        assert pii.base_spans(t) == plain_base(t)


@pytest.mark.parametrize("unit", ["1", "a", "@", "a@", "1.", "+1", "(at)", " ", "+", "1 ", "-", "a.", "((", "1("])
def test_spans_are_linear_in_the_text(unit):
    text = unit * (200_000 // len(unit))
    began = time.time()
    pii.base_spans(text)
    pii.candidates(text)
    assert time.time() - began < 20


def test_trees_learn_and_thresholds_hold_precision():
    rng = np.random.default_rng(12)
    x = rng.random((3000, pii.FEATURES))
    y = ((x[:, 0] > 0.5) & (x[:, 3] < 0.3) | (x[:, 7] > 0.9)).astype(float)
    flip = rng.random(3000) < 0.02
    t = pii.boost(x[:2000], np.where(flip, 1 - y, y)[:2000])
    score = t.log_odds(x[2000:])
    assert ((score > 0) == (y[2000:] > 0)).mean() > 0.95
    cut = pii.calibrate(score, y[2000:], 0.98)
    assert y[2000:][score >= cut].mean() >= 0.98
    assert pii.calibrate(score, np.zeros(1000), 0.98) == math.inf


def test_pii_operator(spark):
    rng = random.Random(13)

    def card():
        d = "".join(rng.choices("0123456789", k=15))
        return next(d + c for c in "0123456789" if plain_luhn(d + c))

    rows = list(EDGE)
    for i in range(900):
        said = rng.choice([f"card {card()}", f"order {rng.randrange(10**12, 10**13)}", f"mail a{i}@x{i}.org", f"host 10.2.{i % 256}.7", f"call +1 (555) 555-{1000 + i}", "no data here"])
        rows.append((100 + i, f"some words before {said} and after, é"))
    docs = docs_of(spark, rows)
    model = pii.train(docs)
    got = pii.with_spans(docs, model).select("doc_id", "text", "pii.*").collect()
    assert len(got) == len(rows)
    wrong = 0
    for r in got:
        base = plain_base(r.text or "")
        assert r.base == pii.joined(base)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for _, k, _ in base) for n in range(4)]
        spans = r.spans.split(",") if r.spans else []
        assert set(pii.joined(base).split(",")) - {""} <= set(spans)
        if "no data" in (r.text or ""):
            assert not spans
        wrong += "order" in (r.text or "") and bool(spans)
    assert wrong <= 4  # of some 150 numbers of 13 digits
    assert "<email>" in pii.redact("x a@b.org y", "email:2:9")
    empty = docs.limit(0)
    assert pii.with_spans(empty, pii.train(empty)).count() == 0


# ---- masked pseudo-likelihood


def made_vocabulary(n, classes):
    hashes = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(1 << 40)
    return pseudolm.Vocabulary(hashes, np.arange(n), np.r_[100.0 - np.arange(n) % 90, classes * np.ones(pseudolm.CLASSES)])


def test_probabilities_sum_to_one():
    words = made_vocabulary(100, 3)
    net = pseudolm.fresh(words, d=8)
    ctx = np.random.default_rng(1).integers(0, len(words) + 1, (5, 8))
    total = sum(np.exp(pseudolm.log_probabilities(net, ctx, np.full(5, t))) for t in range(len(words)))
    assert np.allclose(total, 1, atol=1e-4)
    net.group[:, 0] = 500  # widely spread logits take the row-wise shift
    total = sum(np.exp(pseudolm.log_probabilities(net, ctx, np.full(5, t))) for t in range(len(words)))
    assert np.allclose(total, 1, atol=1e-3)


def test_a_step_lowers_the_loss_of_its_batch():
    rng = np.random.default_rng(2)
    t = pseudolm.Trainer(pseudolm.fresh(made_vocabulary(100, 1), d=8), 0.1)
    ctx, target = rng.integers(0, 165, (64, 8)), rng.integers(0, 164, 64)
    before = pseudolm.log_probabilities(t.net, ctx, target).mean()
    for _ in range(30):
        t.step(ctx, target)
    assert pseudolm.log_probabilities(t.net, ctx, target).mean() > before + 1
    assert np.all(t.net.embed[-1] == 0)


def test_pseudo_likelihood_operator(spark):
    rng = random.Random(14)
    pairs = [("salt", "pepper"), ("night", "day"), ("left", "right"), ("hot", "cold")]
    rows = EDGE + [(100 + i, " ".join(f"{a} and {b}" for a, b in rng.choices(pairs, k=60))) for i in range(200)]
    rows += [(900, "salt and cold night and pepper"), (901, "salt and pepper night and day")]
    docs = docs_of(spark, rows)
    small = pseudolm.vocabulary(docs, size=pseudolm.CLASSES + 5)
    words = pseudolm.vocabulary(docs)
    plain = [decontam.words_of(t).tolist() for _, t in rows]
    counts = Counter(w for p in plain for w in p)
    assert dict(zip(words.hashes.tolist(), words.counts[words.number].tolist())) == dict(counts)
    assert small.counts[:5].tolist() == sorted(counts.values())[::-1][:5]
    kept = set(small.hashes.tolist())
    for c in range(pseudolm.CLASSES):
        assert small.counts[5 + c] == sum(n for w, n in counts.items() if w not in kept and w % pseudolm.CLASSES == c)
    net = pseudolm.train(docs, words, rounds=4, mask=4)
    got = pseudolm.with_score(docs, words, net).select("doc_id", "text", "lm.*").collect()
    assert len(got) == len(rows)
    for r in got:
        x = words.numbers(decontam.words_of(r.text))
        slow = 0.0
        if len(x) < 500:
            for i in range(len(x)):
                around = [x[i + p] if 0 <= i + p < len(x) else len(words) for p in pseudolm.PLACES]
                slow += float(pseudolm.log_probabilities(net, np.array([around]), x[i : i + 1])[0])
            assert (r.n_words, r.log_likelihood) == (len(x), pytest.approx(slow, abs=1e-2))
    by = {r.doc_id: r.log_likelihood / r.n_words for r in got if r.n_words}
    assert by[901] > by[900] + 0.3
    unigram = pseudolm.fresh(words)
    unigram.group[:], unigram.word[:] = 0, 0
    texts = [t for i, t in rows if i and 100 <= i < 300]
    assert pseudolm.score_texts(net, words, texts)[1].sum() > 0.8 * pseudolm.score_texts(unigram, words, texts)[1].sum()
    empty = docs.limit(0)
    none = pseudolm.vocabulary(empty)
    assert pseudolm.with_score(empty, none, pseudolm.train(empty, none)).count() == 0


def test_rare_words_have_their_own_probability(spark):
    """A word of a class scores the class's probability times its share of the class's counts."""
    rng = random.Random(15)
    rows = EDGE + [(100 + i, " ".join(["the"] * 20 + [f"rare{min(rng.randrange(400), rng.randrange(400))}" for _ in range(30)])) for i in range(60)]
    docs = docs_of(spark, rows)
    words = pseudolm.vocabulary(docs, size=pseudolm.CLASSES + 5)
    net = pseudolm.fresh(words)
    counts = Counter(w for _, t in rows for w in decontam.words_of(t).tolist())
    kept = set(words.hashes.tolist())
    of_class = Counter()
    for w, n in counts.items():
        if w not in kept:
            of_class[w % pseudolm.CLASSES] += n
    got = pseudolm.with_score(docs, words, net).select("doc_id", "text", "lm.*").collect()
    assert len(got) == len(rows)
    for r in got:
        h = decontam.words_of(r.text).tolist()
        share = sum(math.log(counts[w] / of_class[w % pseudolm.CLASSES]) for w in h if w not in kept)
        n, by_class = pseudolm.score_texts(net, words, [r.text])
        assert r.n_words == n[0] == len(h)
        assert r.log_likelihood == pytest.approx(by_class[0] + share, rel=1e-6, abs=1e-3)
        assert (r.doc_id or 0) < 100 or share < -10
    # the shares of each class's words sum to one
    assert all(sum(n for w, n in counts.items() if w not in kept and w % pseudolm.CLASSES == c) == words.counts[5 + c] for c in range(pseudolm.CLASSES))


def test_every_position_is_a_target_once(spark):
    """Texts of 2 to 40 words: the positions that the rounds weight add up to all words."""
    seen = []

    def spy(parts, partitions):
        seen.append(sum(r["n"] for r in parts.filter("slice = 0").select("n").collect()))
        return averaged(parts, partitions)

    averaged = pseudolm._averaged
    docs = docs_of(spark, [(k, " ".join(f"w{(k * j) % 17}" for j in range(k))) for k in range(2, 41)])
    words = pseudolm.vocabulary(docs)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(pseudolm, "_averaged", spy)
        net = pseudolm.train(docs, words)
    assert sum(seen) == sum(range(2, 41)) and len(seen) == 2
    assert net.embed.shape[1] == 32


def test_averages_are_weighted(spark):
    rows = [(p, s, n, np.full(3, float(p), np.float32).tobytes()) for p, n in [(0, 1), (1, 3), (40, 4), (70, 2)] for s in (0, 1)]
    df = spark.createDataFrame([(a, b, c, bytearray(d)) for a, b, c, d in rows], "part long, slice int, n long, values binary")
    got = pseudolm._averaged(df, 100).collect()
    assert sorted((r["slice"], r["n"]) for r in got) == [(0, 10), (1, 10)]
    assert all(np.allclose(np.frombuffer(r["values"], np.float32), (0 + 3 + 160 + 140) / 10) for r in got)
