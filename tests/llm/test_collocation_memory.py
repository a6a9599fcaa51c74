"""What a task holds of its windows doesn't follow its rows."""

import tracemalloc

import numpy as np
import pandas as pd

from tessera.llm import collocations


def test_windows_of_a_large_task_are_summed_in_parts():
    rng = np.random.default_rng(2)
    words = [b"w%d" % k for k in range(5000)]
    known = {"en": {w: k for k, w in enumerate(words)}}
    picked = rng.integers(0, len(words), 1 << 20)
    text = b" ".join(words[k] for k in picked[: 1 << 15]).decode()
    batch = pd.DataFrame({"lang": ["en"] * 64, "text": [text] * 64})  # two million words and more
    tracemalloc.start()
    found, counts = 0, {}
    for got in collocations.window_tables(iter([batch, batch]), known, True):
        found += int(got["n"].sum())
        for row in got[got["w1"] == picked[0]].itertuples(index=False):
            counts[row[:4]] = counts.get(row[:4], 0) + row[4]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == 128 * ((1 << 15) - 1)
    assert counts[tuple(int(k) for k in picked[:4])] == 128
    assert peak < 250 << 20, peak
