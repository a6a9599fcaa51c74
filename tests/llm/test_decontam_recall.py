"""Whatever passes the subsequence and answer checks is a candidate, also among rare words."""

import random
from collections import Counter

from test_models import docs_of, plain_lcs

from tessera.llm import decontam


def test_copies_among_rare_words_are_found(spark):
    rng = random.Random(17)
    rare = lambda n: ["".join(rng.choices("abcdefghijklmnop", k=9)) for _ in range(n)]
    common = [f"c{i}" for i in range(40)]
    item = lambda n: [rng.choice(common) if rng.random() < 0.7 else w for w in rare(n)]
    items = [item(rng.choice((14, 20, 33, 45, 60))) for _ in range(60)]
    rows, truth = [(k, " ".join(rng.choices(common, k=60))) for k in range(300)], set()
    for k, words in enumerate(items):
        keep = sorted(rng.sample(range(len(words)), -(-len(words) * 78 // 100)))
        part = [words[i] for i in keep]
        before = rng.randrange(40, 80)
        rows.append((1000 + k, " ".join([*rare(before), *part, *rare(80)])))
        told = [w for w, _ in Counter(words).items() if w not in common]
        assert plain_lcs(words, part) >= 0.7 * len(words) and told
        truth.add((1000 + k, k))
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs_of(spark, rows), bench).collect()}
    every = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs_of(spark, rows), bench, cosine=0.01).collect()}
    assert every <= truth and len(every) > 40  # the answer check leaves some out
    assert got == every
