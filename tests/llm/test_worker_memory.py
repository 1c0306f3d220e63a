"""What a batch has built goes with it: a Python worker does not wait for the search of cycles."""

import gc

import numpy as np

from tidemill.llm import words
from tidemill.llm.set_trie import spanning_links


def left_behind(call):
    """Objects that only the search of cycles finds once ``call`` is over."""
    gc.collect()
    gc.disable()
    try:
        call()
        return gc.collect()
    finally:
        gc.enable()


def test_words_of_a_batch_leave_nothing():
    assert words.numbered([b"a b a", b"", b"c"])[2] == [b"a", b"b", b"c"]
    assert left_behind(lambda: words.numbered([b"a b a", b"", b"c"], b" ")) == 0


def test_prefix_trees_leave_nothing():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, 40)) for _ in range(50)]
    assert left_behind(lambda: spanning_links(sets, 80)) == 0
