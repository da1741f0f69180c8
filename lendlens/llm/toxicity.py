"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its marked character n-grams and of itself, hashed into
buckets; a window of words is the mean of its words, empty places and a word's repeats within
a window's length counting as zero vectors; a softmax over two classes judges a window, and a text is as toxic as its worst window. Vectors
start at zero, so n-grams never seen in training are neutral, while a misspelling shares most
n-grams with the word it hides. Labels hold for texts, not windows: after each round the
windows of toxic texts keep the label only where the model finds them worst.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lendlens.llm.common import Sample, as_sample, by_block, labelled_texts, release_memory, split_many, split_words, text_blocks, word_ngrams

THRESHOLD = 0.3  # a text of this score is toxic
BUCKETS, DIM, WINDOW = 1 << 17, 4, 16
LOW, HIGH = 3, 6
# The classifier is fitted on a bounded sample: so many labelled rows, so many bytes of whole texts.
FIT_ROWS, FIT_BYTES = 5000, 20 << 20
WARM_STEPS, ROUNDS, STEPS = 30, 6, 10
RATE, DECAY = 0.1, 1e-6
# Words and windows whose sums are taken at a time.
WORD_BLOCK, WINDOW_BLOCK = 1 << 14, 1 << 15
EDGES = re.compile(r"^[\W_]+|[\W_]+$")


def bare(word: str) -> str:
    return EDGES.sub("", word) or word


def fresh(codes: np.ndarray) -> np.ndarray:
    """Whether a word has not occurred among the words just before it."""
    order = np.argsort(codes, kind="stable")
    found = np.ones(len(codes), bool)
    found[order[1:]] = (codes[order[1:]] != codes[order[:-1]]) | (np.diff(order) >= WINDOW)
    return found


@dataclass
class ToxicModel:
    """Score of each bucket (its vector times the softmax weights) and the calibration of a text."""

    gain: np.ndarray
    slope: float
    shift: float

    def word_scores(self, words: pa.Array) -> np.ndarray:
        found = [np.zeros(0)]
        for at in range(0, len(words), WORD_BLOCK):
            block = words.slice(at, WORD_BLOCK)
            owner, key = word_ngrams([bare(w) for w in pc.utf8_lower(block).to_pylist()], LOW, HIGH)
            values = self.gain[key % np.uint64(BUCKETS)]
            found.append(np.bincount(owner, values, len(block)) / np.maximum(np.bincount(owner, minlength=len(block)), 1))
        return np.concatenate(found)

    def worst(self, texts: pa.Array) -> np.ndarray:
        """The greatest logit over all windows of each text; 0 for a text without words."""
        codes, starts, words = split_words(texts)
        if not len(codes):
            return np.zeros(len(texts))
        sizes = np.diff(starts)
        values = np.where(fresh(codes), self.word_scores(words)[codes], 0.0)
        total = np.concatenate([[0.0], np.cumsum(values)])
        owner = np.repeat(np.arange(len(texts)), sizes)
        last = np.minimum(np.arange(len(codes)) + WINDOW, starts[1:][owner])
        sums = (total[last] - total[:-1]) / WINDOW
        found = np.zeros(len(texts))
        some = sizes > 0
        found[some] = np.maximum.reduceat(sums, starts[:-1][some])
        return found

    def scores(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.worst(texts) + self.shift, -30, 30)))


class Spelling:
    """Distinct words as bags of buckets; vectors of words and gradients of buckets, a block at a time."""

    def __init__(self, ptr: np.ndarray, slot: np.ndarray) -> None:
        self.ptr, self.slot, self.sizes = ptr, slot, np.diff(ptr)
        self.share = (1.0 / np.maximum(self.sizes, 1)).astype(np.float32)

    def blocks(self, used: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """Places in `used` (sorted words), and slots and owners of their n-grams."""
        for low in range(0, len(used), WORD_BLOCK):
            part = used[low:low + WORD_BLOCK]
            sizes = self.sizes[part]
            owner = np.repeat(np.arange(len(part), dtype=np.int32), sizes)
            first = (self.ptr[part] - (np.cumsum(sizes) - sizes)).astype(np.int32)
            yield slice(low, low + len(part)), self.slot[first[owner] + np.arange(len(owner), dtype=np.int32)], owner

    def vectors(self, used: np.ndarray, buckets: np.ndarray) -> np.ndarray:
        found = np.zeros((len(used), buckets.shape[1]), np.float32)
        for place, slot, owner in self.blocks(used):
            for d in range(buckets.shape[1]):
                found[place, d] = np.bincount(owner, buckets[slot, d], minlength=place.stop - place.start)
        return found * self.share[used][:, None]

    def gradients(self, used: np.ndarray, error: np.ndarray, buckets: int) -> np.ndarray:
        error = error * self.share[used][:, None]
        found = np.zeros((buckets, error.shape[1]))
        for place, slot, owner in self.blocks(used):
            for d in range(error.shape[1]):
                found[:, d] += np.bincount(slot, error[place, d][owner], minlength=buckets)
        return found


class Bags:
    """Windows as bags of words, read a block at a time."""

    def __init__(self, spelling: Spelling, word_of: np.ndarray, window_of: np.ndarray, windows: int) -> None:
        self.spelling, self.window_of, self.windows = spelling, window_of, windows
        self.used, self.word_of = np.unique(word_of, return_inverse=True)
        self.word_of = self.word_of.astype(np.int32)

    def blocks(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Windows from, to, and of the words in them: the word and its window within the block."""
        for low in range(0, self.windows, WINDOW_BLOCK):
            high = min(low + WINDOW_BLOCK, self.windows)
            a, b = np.searchsorted(self.window_of, [low, high])
            yield low, high, self.word_of[a:b], self.window_of[a:b] - low

    def forward(self, vectors: np.ndarray) -> np.ndarray:
        word = self.spelling.vectors(self.used, vectors)
        found = np.zeros((self.windows, vectors.shape[1]), np.float32)
        for low, high, words, place in self.blocks():
            for d in range(vectors.shape[1]):
                found[low:high, d] = np.bincount(place, word[words, d], minlength=high - low)
        return found / WINDOW

    def backward(self, error: np.ndarray, buckets: int) -> np.ndarray:
        word = np.zeros((len(self.used), error.shape[1]))
        for low, _, words, place in self.blocks():
            for d in range(error.shape[1]):
                word[:, d] += np.bincount(words, error[low + place, d], minlength=len(self.used))
        return self.spelling.gradients(self.used, word / WINDOW, buckets)


def softmax(logit: np.ndarray) -> np.ndarray:
    p = np.exp(logit - logit.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def bucketed(words: pa.Array, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the n-grams of each word begin, their buckets, and how often each bucket occurs, a block of words at a time."""
    sizes, keys, often = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], np.zeros(BUCKETS)
    for at in range(0, len(words), WORD_BLOCK):
        block = words.slice(at, WORD_BLOCK)
        owner, key = word_ngrams([bare(w) for w in pc.utf8_lower(block).to_pylist()], LOW, HIGH)
        key = (key % np.uint64(BUCKETS)).astype(np.int32)
        often += np.bincount(key, counts[at:at + WORD_BLOCK][owner], minlength=BUCKETS)
        sizes.append(np.bincount(owner, minlength=len(block)))
        keys.append(key)
    return np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64), np.concatenate(keys), often


def fit(sample: Sample | list[tuple[str, int]], seed: int = 3) -> ToxicModel:
    """Joint training of n-gram vectors and softmax. Without both labels the score is the label's share.

    Sums run over blocks of words and windows, so memory beside the texts and their words' numbers
    does not grow with the steps.
    """
    texts, marks = as_sample(sample)
    y = np.array([int(bool(label)) for label in marks], np.int64)
    share = (y.sum() + 0.5) / (len(y) + 5.0)
    even = ToxicModel(np.zeros(BUCKETS, np.float32), 0.0, float(np.log(share / (1 - share))))
    if not len(y) or y.min() == y.max():
        return even
    rng = np.random.default_rng(seed)
    codes, starts, words = split_many(texts)
    if not len(codes):
        return even
    # Windows: the whole of each text, side by side.
    places = -(-np.diff(starts) // WINDOW)
    text_of = np.repeat(np.arange(len(texts)), places)
    begin = starts[:-1][text_of] + WINDOW * (np.arange(len(text_of)) - (np.cumsum(places) - places)[text_of])
    stop = np.minimum(begin + WINDOW, starts[1:][text_of])
    new = fresh(codes)
    window_of = np.repeat(np.arange(len(begin), dtype=np.int32), stop - begin)[new]
    used, word_of = np.unique(codes[new], return_inverse=True)
    word_of = word_of.astype(np.int32)
    del codes, begin, stop, new
    ptr, slot, often = bucketed(words.take(pa.array(used)), np.bincount(word_of, minlength=len(used)).astype(np.float64))
    del words, used
    buckets, inverse = np.flatnonzero(often), np.zeros(BUCKETS, np.int32)
    inverse[buckets] = np.arange(len(buckets))
    for at in range(0, len(slot), 1 << 20):
        slot[at:at + (1 << 20)] = inverse[slot[at:at + (1 << 20)]]
    # Buckets of very few words carry no signal for other texts and stay at zero.
    often = often[buckets] >= 4

    vectors = np.zeros((len(buckets), DIM), np.float32)
    head = rng.normal(0, 1.0, (DIM, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    held = [(np.zeros_like(p), np.zeros_like(p)) for p in (vectors, head, bias)]
    tick = 0

    def train(bags: Bags, target: np.ndarray, steps: int) -> None:
        nonlocal tick
        truth = np.stack([1 - target, target], 1)
        each = (truth / np.maximum(2 * truth.sum(0), 1)).sum(1, keepdims=True).astype(np.float32)
        for _ in range(steps):
            window = bags.forward(vectors)
            error = ((softmax(window @ head + bias) - truth) * each).astype(np.float32)
            grads = [bags.backward(error @ head.T, len(buckets)) * often[:, None] + DECAY * vectors, window.T @ error, error.sum(0)]
            tick += 1
            for (mean, square), g, parameter in zip(held, grads, (vectors, head, bias)):
                mean += 0.1 * (g - mean)
                square += 0.01 * (g * g - square)
                parameter -= RATE * (mean / (1 - 0.9 ** tick)) / (np.sqrt(square / (1 - 0.99 ** tick)) + 1e-8)

    spelling = Spelling(ptr, slot)
    whole = Bags(spelling, word_of, window_of, len(text_of))
    word_of = whole.word_of  # every word is used, so the numbers are the same
    train(whole, y[text_of].astype(np.float64), WARM_STEPS)
    for _ in range(ROUNDS):  # from now on a text is judged by its worst window
        logit = whole.forward(vectors) @ (head[:, 1] - head[:, 0])
        order = np.lexsort((-logit, text_of))
        rank = np.arange(len(order)) - np.searchsorted(text_of[order], text_of[order])
        chosen = np.sort(order[rank < 1 + y[text_of[order]]])
        place = np.full(len(text_of), -1, np.int32)
        place[chosen] = np.arange(len(chosen))
        inside = place[window_of] >= 0
        train(Bags(spelling, word_of[inside], place[window_of[inside]], len(chosen)), y[text_of[chosen]].astype(np.float64), STEPS)
    gain = np.zeros(BUCKETS, np.float32)
    gain[buckets] = vectors @ (head[:, 1] - head[:, 0])
    return calibrated(gain, texts, y, share)


def calibrated(gain: np.ndarray, texts: pa.Array, y: np.ndarray, share: float) -> ToxicModel:
    """Fits the text's label to its worst window by Newton steps."""
    model = ToxicModel(gain, 1.0, 0.0)
    x = np.concatenate([model.worst(block) for block in text_blocks(texts, 1 << 19)])
    width, middle = max(x.std(), 1e-6), x.mean()
    design = np.stack([(x - middle) / width, np.ones_like(x)], 1)
    coefficient = np.array([1.0, float(np.log(share / (1 - share)))])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ coefficient, -30, 30)))
        curve = (design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        coefficient += np.clip(np.linalg.solve(curve, design.T @ (y - p) - 1e-3 * coefficient), -2, 2)
    slope = max(coefficient[0], 0.0) / width
    return ToxicModel(gain, float(slope), float(coefficient[1] - slope * middle))


def fit_toxicity(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, size: int = FIT_BYTES) -> ToxicModel:
    """Fits on at most `rows` labelled documents and `size` bytes of their whole texts."""
    model = fit(labelled_texts(docs, labels, "toxic", rows, size))
    release_memory()
    return model


def toxicity(spark: SparkSession, text: Column, model: ToxicModel) -> Column:
    """Probability that the whole text is toxic; null and empty texts get that of no words."""
    shared = spark.sparkContext.broadcast((model.gain, model.slope, model.shift))

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = ToxicModel(*shared.value)
        for texts in batches:
            yield by_block(texts, lambda block: pa.array(model.scores(block), pa.float64()))
    return score(text)
