import random
import tracemalloc

from lodestar.llm import quality


def test_word_vectors_are_summed_a_stretch_at_a_time():
    """Some 600,000 different pairs of neighbours; their vectors at once take hundreds of MB on the driver."""
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    texts = [" ".join(rng.choices(words, k=1200)) for _ in range(250)]
    tracemalloc.start()
    try:
        quality.word_vectors(texts)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 64 << 20
