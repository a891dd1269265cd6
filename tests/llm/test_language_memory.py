"""What a task of the language model holds at once."""

import random
import tracemalloc

import numpy as np

from launchlake.llm import language_id


def test_a_slice_of_text_takes_little_memory_and_gives_the_same_sums():
    rnd = random.Random(3)
    texts = ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz ", k=5000)) for _ in range(440)]
    total = np.zeros(language_id.DIMENSIONS)
    tracemalloc.start()
    for start, end in language_id._slices(texts):
        grams = language_id.Trigrams(texts[start:end])
        total += grams.bundle(np.concatenate([grams.of(i) for i in range(end - start)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    whole = language_id.Trigrams(texts)
    assert np.array_equal(total, whole.bundle(whole.numbers))
    assert peak < 90_000_000, peak
