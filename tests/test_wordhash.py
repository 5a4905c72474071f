import tracemalloc

import pyarrow as pa

from evalloom.functions import wordhash as wh


def test_memory_of_a_pass_does_not_follow_the_batch():
    """Words of 16 MB in one batch are hashed in less memory than a few times a piece takes."""
    texts = pa.array(["some words of a text that repeats " * 30] * 16_000, pa.string())
    wh.powers.cache_clear()
    tracemalloc.start()
    found = 0
    for _, piece in wh.pieces(texts):
        words = wh.words_of(piece)
        found += len(wh.run_hashes(words, 13)[0])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found > 3_000_000 and peak < 60 << 20, peak
