"""Alignment of two tokenizers against a brute-force version, and long white space in both encoders."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from tessera.llm import align, packing, tokens

SCHEMA = "doc_id long, text string, row long, al string, pair long, n int, n_a int, n_best string, r int"
SPECIAL = ["<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>"]


def docs_of(spark, rows):
    """rows of (doc_id, text); the extra columns clash with names the operator uses inside."""
    return spark.createDataFrame([(i, t, 1, "x", 2, 3, 4, "y", 5) for i, t in rows], SCHEMA)


def bytes_of_a():
    """The JSON entries decoded by the byte-level alphabet: printable characters stand for themselves."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in kept]
    byte_of = {chr(b): b for b in kept} | {chr(256 + k): b for k, b in enumerate(rest)}
    model = Tokenizer.from_file(tokens.public_path("byte_bpe_50k.json"))
    return {i: bytes(byte_of[c] for c in s) for s, i in model.get_vocab().items() if s != "<|endoftext|>"}


def brute_one(text, model, entries_a):
    """(ids of A, ids of B, groups, links) straight from the definition."""
    if not text:
        return [], [], [], []
    a = model.encode(" " + text, add_special_tokens=False).ids
    b = tokens.piece_bpe(tokens.public_path("piece_bpe_32k.model")).encode(text)
    entries_b = tokens.piece_bpe_entries(tokens.public_path("piece_bpe_32k.model"))
    raw = (" " + text).encode()
    if b"".join(entries_a[i] for i in a) != raw or b"".join(entries_b[i] for i in b) != raw:
        return [], [], [], []

    def ranges(ids, entries):
        out, at = [], 0
        for i in ids:
            out.append((at, at + len(entries[i])))
            at += len(entries[i])
        return out

    ra, rb = ranges(a, entries_a), ranges(b, entries_b)
    ends = sorted({e for _, e in ra} & {e for _, e in rb})
    groups = [
        (
            [i for i, (s, e) in zip(a, ra) if lo <= s and e <= hi],
            [i for i, (s, e) in zip(b, rb) if lo <= s and e <= hi],
        )
        for lo, hi in zip([0, *ends], ends)
    ]
    links = [(i, j) for i, (s, e) in zip(a, ra) for j, (u, v) in zip(b, rb) if s < v and u < e]
    return a, b, groups, links


def brute(texts):
    model = Tokenizer.from_file(tokens.public_path("byte_bpe_50k.json"))
    model.encode_special_tokens = True
    entries_a = bytes_of_a()
    found = [brute_one(t, model, entries_a) for t in texts]
    count = Counter(p for *_, links in found for p in set(links))
    top = {}
    for (i, _), n in count.items():
        top[i] = max(top.get(i, 0), n)
    out = []
    for a, b, groups, links in found:
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append(
            (
                len(a),
                len(b),
                len(groups),
                len(links),
                sum(count[p] == top[p[0]] for p in links),
                sum(count[p] for p in links),
                hashlib.sha256(said.encode()).hexdigest() if a else "",
            )
        )
    return out


def made_texts():
    rng = random.Random(11)
    bits = ["the", "tion", "ée", "日本語", "🙂", "  ", "\n", "\t", " ", "12345", "...", "\x00", "ﬁ", "é", "xq", "-", "ü", *SPECIAL]
    texts = ["".join(rng.choices(bits, k=rng.randrange(1, 60))) for _ in range(150)]
    texts += [None, "", " ", "  ", "\n\n", "a▁b", "▁", "one two", "one two", "word " * 1500, "é" * 1000, "́‍" * 300]
    return texts


@pytest.mark.parametrize("hot", [align.HOT, 40, 0])
def test_alignment_against_brute_force(spark, hot):
    texts = made_texts()
    rows = [(None if k % 17 == 0 else k % 90, t) for k, t in enumerate(texts)]
    out = align.align_corpus(docs_of(spark, rows).repartition(5), hot=hot).collect()
    want = Counter((i, *w) for (i, _), w in zip(rows, brute(texts)))
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert Counter(tuple(r[c] for c in names) for r in out) == want
    if hot == 0:
        assert sum(r.count_sum for r in out) > 0


def test_alignment_of_an_empty_table(spark):
    assert align.align_corpus(docs_of(spark, []), hot=5).count() == 0


def test_groups_read_back(spark):
    """The groups' text lists both id lists whole and in order."""
    files = align.public_tokenizers()
    texts = [t for t in made_texts() if t]
    rows = align.aligned(docs_of(spark, list(enumerate(texts))), files, with_text=True).collect()
    for r in rows:
        al = align.align(texts[r.doc_id], files)
        groups = [g.split("|") for g in r.al.groups.split(";")] if r.al.groups else []
        assert [int(i) for g in groups for i in g[0].split(",")] == al.a.tolist()
        assert [int(i) for g in groups for i in g[1].split(",")] == al.b.tolist()
        assert len(groups) == r.al.n_groups


def test_slices_with_many_tokens_on_both_sides():
    rng = np.random.default_rng(5)
    for _ in range(300):
        size = int(rng.integers(1, 40))
        ends_a, ends_b = (np.unique(np.r_[rng.integers(1, size + 1, rng.integers(0, size + 1)), size]) for _ in range(2))
        cut_a, cut_b = align.slices(ends_a, ends_b)
        link_a, link_b = align.expand_links(ends_a, ends_b, cut_a, cut_b)
        sa, sb = np.r_[0, ends_a[:-1]], np.r_[0, ends_b[:-1]]
        want = [(i, j) for i in range(len(ends_a)) for j in range(len(ends_b)) if sa[i] < ends_b[j] and sb[j] < ends_a[i]]
        assert list(zip(link_a.tolist(), link_b.tolist())) == want


@pytest.mark.parametrize("text", [" " * 1_200_000, "\t" * 1_200_000 + "x", "a" + "\n" * 1_200_000 + " b", "a " + " " * 300_000 + "<|endoftext|> c"])
def test_long_white_space(text):
    model = Tokenizer.from_file(tokens.public_path("byte_bpe_50k.json"))
    path = tokens.public_path("byte_bpe_50k.tiktoken")
    assert tokens.byte_bpe(path, True)(text) == model.encode(text, add_special_tokens=False).ids
    model.encode_special_tokens = True
    assert tokens.byte_bpe(path, False)(text) == model.encode(text, add_special_tokens=False).ids


def test_long_white_space_is_packed(spark):
    rows = [(1, " " * 1_200_000), (2, "x" + "\t" * 1_200_000), (3, "\n" * 1_200_000 + "y")]
    out = packing.pieces(docs_of(spark, rows), 1024).groupBy("doc_id").sum("length").collect()
    model = Tokenizer.from_file(tokens.public_path("byte_bpe_50k.json"))
    want = {i: len(model.encode(t, add_special_tokens=False).ids) + 1 for i, t in rows}
    assert {r[0]: r[1] for r in out} == want
