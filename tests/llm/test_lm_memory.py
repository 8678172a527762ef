"""What a task of op4 holds in memory: finding 2 of round 3."""

import tracemalloc

import numpy as np

from rillmark.llm import lm_score


def test_lm_block_takes_bounded_memory_a_token():
    rng = np.random.default_rng(5)
    vocabulary = np.unique(np.r_[rng.integers(1, 2**63, 30_000, dtype=np.uint64), lm_score._END_HASH])
    sizes = np.full(1_000, 300)
    word = (rng.zipf(1.3, sizes.sum()) % len(vocabulary)).astype(np.int64)
    tracemalloc.start()
    block = lm_score.block_of(vocabulary, word, sizes, np.zeros(len(sizes), bool))
    n, occurring = block.counts(), block.occurrences()
    kinds = block.kinds((n > 0).astype(np.int64))
    block.automaton(n, occurring, np.maximum(kinds, 1))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 145 * sizes.sum()


def test_lm_answers_are_the_same_by_slices(spark):
    rng, rows = np.random.default_rng(8), []
    for block in range(5):
        keys = np.unique(rng.integers(0, 200, 90, dtype=np.uint64) << np.uint64(56) >> np.uint64(block % 2))
        for batch in lm_score._asked(block, keys, rng.integers(0, 4, len(keys)), rng.integers(0, 9, len(keys)), 3):
            rows += [tuple(r.values()) for r in batch.to_pylist()]
    asked = spark.createDataFrame(rows, lm_score._ASKED)
    for owners in (True, False):
        found = [sorted(lm_score._told(asked, 3, owners, slices).collect()) for slices in (1, 8, 1_000)]
        assert found[0] and found[0] == found[1] == found[2]
