"""Words of many texts are found with little memory beside the texts."""

import tracemalloc

import numpy as np
import pyarrow as pa

from raterlake.llm import jaccard
from raterlake.llm import text as words_of


def test_both_sides_of_pairs_take_little_memory():
    rng = np.random.default_rng(5)
    texts = [" ".join(map(str, rng.integers(0, 10**6, 1200))) for _ in range(500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(500)), pa.array(range(500)), pa.array(texts), pa.array(texts[:250] + texts[:250])], ["a", "b", "one", "two"])
    words_of.words(pa.array(["x" * (1 << 20)], pa.large_string()))  # the powers are made once for all
    tracemalloc.start()
    kept = sum(x.num_rows for x in jaccard._verify(iter([batch]), 5, 80))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert kept == 250
    assert peak < 20 << 20, peak
