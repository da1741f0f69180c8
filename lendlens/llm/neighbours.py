"""Quality by nearest-neighbour voting among latent-semantic vectors.

Terms of a text are its frequent words, the shapes of its words (runs of upper, lower, digits,
marks), and steps of a few shares of the whole text: words and lines that repeat, capitals,
marks, lengths. Weighted by log count and inverse document frequency and projected on the
leading singular directions of a labelled sample, texts become unit vectors. The labelled
vectors, bounded in number, are broadcast; every text gets its exact cosine products with all
of them, block by block, and the nearest vote with their similarity as weight.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lendlens.llm.common import Sample, as_sample, by_block, code_points, labelled_texts, split_words, sums_by_start, text_blocks

# Labelled rows (and bytes of their whole texts) that are broadcast as vectors.
FIT_ROWS, FIT_BYTES = 4000, 24 << 20
TERMS, DIM, NEIGHBOURS = 1500, 24, 15
ROWS = 1000  # texts whose products are held at a time
STEPS = 8
STATS = ("repeated words", "repeated lines", "capitals", "marks", "digits", "word length", "words", "line length")
SHAPES = [(re.compile(p), r) for p, r in (
    (r"[A-ZÀ-ÖØ-Þ]{2,}", "\x01"), (r"[^\W\d_]+", "w"), (r"\d+", "9"), (r"([^\w\n])\1+", r"\1\1"))]


def shapes(words: list[str]) -> list[str]:
    """Runs of capitals, letters, digits and of the same mark as one sign; at most 12 signs."""
    joined = "\n".join(words)
    for pattern, by in SHAPES:
        joined = pattern.sub(by, joined)
    return ["\n" + s[:12] for s in joined.split("\n")] if words else []


def letter_kinds() -> np.ndarray:
    """1 letter, 2 capital, 4 digit for each code point of the basic plane; others are marks."""
    signs = [chr(i) for i in range(1 << 16)]
    return np.array([c.isalpha() + 2 * c.isupper() + 4 * c.isdigit() for c in signs], np.uint8)


def stats(texts: list[str], codes: np.ndarray, starts: np.ndarray, words: list[str], kinds: np.ndarray) -> np.ndarray:
    """Shares in 0 to 1, one column per name in STATS."""
    points = code_points("".join(words))
    kind = np.where(points < 1 << 16, kinds[np.minimum(points, (1 << 16) - 1)], 0)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    edges = np.concatenate([[0], np.cumsum(sizes)])
    signs = np.stack([sizes] + [sums_by_start(kind & bit > 0, edges) for bit in (1, 2, 4)], 1)
    total = sums_by_start(signs[codes].astype(np.float64), starts)
    count = np.diff(starts)
    least, size = np.maximum(count, 1), np.maximum(total[:, 0], 1)
    distinct = np.array([len(np.unique(codes[a:b])) for a, b in zip(starts[:-1], starts[1:])], np.float64)
    lines = [[line for line in t.split("\n") if line.strip()] for t in texts]
    held = np.array([len(x) for x in lines], np.float64)
    unlike = np.array([len(set(x)) for x in lines], np.float64)
    found = np.stack([
        1 - distinct / least, 1 - unlike / np.maximum(held, 1), total[:, 2] / np.maximum(total[:, 1], 1),
        (total[:, 0] - total[:, 1] - total[:, 3]) / size, total[:, 3] / size, total[:, 0] / least / 16,
        np.log1p(count) / 10, np.log1p(count / np.maximum(held, 1)) / 7], 1)
    return np.clip(np.where(count[:, None] > 0, found, 0), 0, 1)


@dataclass
class QualityModel:
    terms: dict[str, int]  # words and shapes
    idf: np.ndarray
    basis: np.ndarray  # (terms and steps, dimensions)
    vectors: np.ndarray  # labelled, unit length
    labels: np.ndarray
    share: float
    kinds: np.ndarray | None = None

    def weights(self, texts: pa.Array) -> np.ndarray:
        """Rows of weighted terms."""
        width = len(self.terms)
        codes, starts, words = split_words(texts)
        spelled = words.to_pylist()
        find = self.terms.get
        known = np.array([[find(w.lower(), -1) for w in spelled], [find(x, -1) for x in shapes(spelled)]], np.int64)
        counts = np.zeros((len(texts), width), np.float32)
        owner = np.repeat(np.arange(len(texts)), np.diff(starts))
        for column in (0, 1):
            term = known[column][codes] if len(codes) else codes
            flat = (owner * width + term)[term >= 0]
            counts += np.bincount(flat, minlength=counts.size).reshape(counts.shape).astype(np.float32)
        size = np.maximum(np.diff(starts), 1)[:, None]
        counts = np.log1p(1000 * counts / size) * self.idf
        if self.kinds is None:
            self.kinds = letter_kinds()
        shares = stats(texts.to_pylist(), codes, starts, spelled, self.kinds)
        # A share is spread over the steps around it, so near shares have near vectors.
        steps = np.arange(STEPS + 1) / STEPS
        soft = np.exp(-((np.sqrt(shares)[:, :, None] - steps) * STEPS) ** 2 / 2).reshape(len(texts), -1)
        return np.concatenate([counts, 6 * soft], 1).astype(np.float32)

    def project(self, texts: pa.Array) -> np.ndarray:
        found = self.weights(texts) @ self.basis
        return found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-9)

    def scores(self, texts: pa.Array) -> np.ndarray:
        parts = [np.zeros(0)]
        for at in range(0, len(texts), ROWS):
            block = texts.slice(at, ROWS)
            if not len(self.labels):
                parts.append(np.full(len(block), self.share))
                continue
            near = self.project(block) @ self.vectors.T
            k = min(NEIGHBOURS, near.shape[1])
            best = np.argpartition(-near, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(near, best, 1), 0).astype(np.float64) + 1e-6
            parts.append((weight * self.labels[best]).sum(1) / weight.sum(1))
        return np.concatenate(parts)


def fit(sample: Sample | list[tuple[str, int]], seed: int = 7) -> QualityModel:
    """Vocabulary, weights and directions from the sample, whose vectors become the voters."""
    texts, marks = as_sample(sample)
    labels = np.array([int(bool(label)) for label in marks], np.float64)
    share = float((labels.sum() + 0.5) / (len(labels) + 1.0))
    seen: dict[str, int] = {}
    blocks = list(text_blocks(texts, 1 << 20))
    for block in blocks:
        codes, starts, words = split_words(block)
        spelled = [(w.lower(), x) for w, x in zip(words.to_pylist(), shapes(words.to_pylist()))]
        for a, b in zip(starts[:-1], starts[1:]):
            for term in {t for c in np.unique(codes[a:b]).tolist() for t in spelled[c]}:
                seen[term] = seen.get(term, 0) + 1
    chosen = sorted((t for t, n in seen.items() if n >= 3), key=lambda t: (-seen[t], t))[:TERMS]
    terms = {t: i for i, t in enumerate(chosen)}
    idf = np.array([np.log((1 + len(texts)) / (1 + seen[t])) + 0.1 for t in chosen], np.float32)
    model = QualityModel(terms, idf, np.zeros((0, 0)), np.zeros((0, DIM), np.float32), labels, share)
    if not len(texts):
        return model
    rows = np.concatenate([model.weights(block) for block in blocks])
    # Leading right singular vectors by subspace iteration.
    q = np.random.default_rng(seed).normal(size=(rows.shape[1], min(DIM + 8, *rows.shape))).astype(np.float32)
    for _ in range(6):
        q, _ = np.linalg.qr(rows.T @ (rows @ q))
    _, values, turn = np.linalg.svd(rows @ q, full_matrices=False)
    strong = np.flatnonzero(values[:DIM] > 1e-3 * values[0])  # the others are noise
    # Directions count by the root of their strength, so the first does not drown the others.
    model.basis = ((q @ turn.T)[:, strong] / np.sqrt(values[strong])).astype(np.float32)
    model.vectors = np.concatenate([model.project(block) for block in blocks])
    return model


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, size: int = FIT_BYTES) -> QualityModel:
    """Fits on at most `rows` labelled documents and `size` bytes of their whole texts."""
    return fit(labelled_texts(docs, labels, "quality", rows, size))


def quality(spark: SparkSession, text: Column, model: QualityModel) -> Column:
    """Similarity-weighted share of good neighbours of the whole text; null texts are empty ones."""
    shared = spark.sparkContext.broadcast((model.terms, model.idf, model.basis, model.vectors, model.labels, model.share))

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = QualityModel(*shared.value)
        for texts in batches:
            yield by_block(texts, lambda block: pa.array(model.scores(block), pa.float64()))
    return score(text)
