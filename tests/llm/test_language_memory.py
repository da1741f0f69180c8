"""What the fit of the language model holds on the driver."""

import tracemalloc

import numpy as np

from lendlens.llm import language


def random_words(count):
    rng = np.random.default_rng(4)
    return ["".join(map(chr, rng.integers(97, 123, rng.integers(4, 11)))) for _ in range(count)]


def test_bagged_features_equal_sorted_ones():
    words = random_words(40_000)
    lexicon = {w: i % 2 for i, w in enumerate(words[::7])}
    keys, bags = language.bagged(words, lexicon, language.BUCKETS + 2)
    owner, key = language.features(words, lexicon)
    wanted, slot = np.unique(key, return_inverse=True)
    assert (keys == wanted).all() and len(bags) > 1
    found = np.concatenate([np.stack([o + low, s]) for low, _, o, s in bags], 1)
    assert sorted(zip(*found.tolist())) == sorted(zip(owner.tolist(), slot.tolist()))


def test_fit_holds_few_bytes_a_feature(monkeypatch):
    monkeypatch.setattr(language, "STEPS", 1)
    words = random_words(60_000)
    pairs = len(language.features(words, {})[0])
    sample = [(" ".join(words[i:i + 50]), "ab"[i // 50 % 2]) for i in range(0, len(words), 50)]
    tracemalloc.start()
    language.fit(sample)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 55 * pairs  # 73 when all pairs were sorted
