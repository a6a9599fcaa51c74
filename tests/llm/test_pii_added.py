"""Personal data that the base patterns miss is added."""

import random

from test_models import docs_of, plain_base

from tessera.llm import pii


def test_planted_spans_that_the_patterns_miss_are_added(spark):
    rng = random.Random(18)
    rows, planted = [], {}
    for i in range(1500):
        said = rng.choice([f"mail jo{i}@site{i}.org", f"host 10.2.{i % 256}.7", f"call +1 (555) 555-{1000 + i}", f"order {rng.randrange(10**12, 10**13)}"])
        rows.append((i, f"some words before {said} and after"))
    for i in range(1500, 1560):
        kind, said = [(0, f"ann{i} [at] place{i} [dot] org"), (1, f"10 . 9 . {i % 256} . 8"), (3, f"1 (555) 777-{1000 + i}")][i % 3]
        cue = ("mail", "host", "", "call")[kind]
        before = f"some words before {cue} "
        rows.append((i, f"{before}{said} and after"))
        planted[i] = (len(before), kind, len(before) + len(said))
        assert not plain_base(rows[-1][1])
    docs = docs_of(spark, rows)
    got = {r.doc_id: r for r in pii.with_spans(docs, pii.train(docs)).select("doc_id", "text", "pii.*").collect()}
    for kind in (0, 1, 3):
        own = [i for i, p in planted.items() if p[1] == kind]
        hit = [i for i in own if got[i].spans.split(":")[0] == pii.KINDS[kind]]
        assert len(hit) >= 0.8 * len(own), (kind, len(hit), len(own), [got[i].text for i in own[:2]])
    assert sum(bool(r.spans) for r in got.values() if "order" in r.text) <= 4


def card(rng, size=16):
    digits = "".join(rng.choices("123456789", k=size - 1))
    return next(digits + c for c in "0123456789" if pii.luhn(digits + c))


def test_cards_beside_other_numbers_are_added(spark):
    rng = random.Random(21)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    filler = lambda: " ".join(word() for _ in range(8))
    rows = [(i, f"{filler()} {card(rng)} {filler()}") for i in range(600)]
    pairs, noise = {}, []
    for i in range(1000, 1050):
        a, b = card(rng), card(rng)
        before = filler() + " "
        rows.append((i, f"{before}{a} {b} {filler()}"))
        pairs[i] = [(len(before), 2, len(before) + 16), (len(before) + 17, 2, len(before) + 33)]
        assert not plain_base(rows[-1][1])
    for i in range(2000, 2400):
        said = " ".join("".join(rng.choices("0123456789", k=rng.choice([1, 2, 3, 5, 8, 11, 13]))) for _ in range(12))
        rows.append((i, said))
        noise.append(i)
    docs = docs_of(spark, rows)
    got = {r.doc_id: r.spans for r in pii.with_spans(docs, pii.train(docs)).select("doc_id", "pii.spans").collect()}
    hit = sum(f"card:{a}:{b}" in got[i].split(",") for i, spans in pairs.items() for a, _, b in spans)
    assert hit >= 90, hit
    numbers = 12 * len(noise)
    plain = {i: sum(k == 2 for _, k, _ in pii.base_spans(t)) for i, t in rows}
    false = sum(max(0, got[i].count("card") - plain[i]) for i in noise)
    assert false <= 0.005 * numbers, false
