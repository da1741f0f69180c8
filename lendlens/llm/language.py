"""Language of words and texts by a linear-chain conditional random field.

Features of a word are its hashed affixes and n-grams (marked at the ends, so prefixes and
suffixes count as their own), the word itself, and whether it stands in the lexicon of a
language. With learned transitions, forward-backward gives each word the probabilities of its
languages in context. Training joins pieces of texts of different languages, so changes of
language within a line are learned. Each line of a text is a chain, however long; the text's
language has the greatest share of probability over all its words (of equal shares, the first by name).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from lendlens.llm.common import Sample, as_sample, by_block, labelled_texts, release_memory, split_many, split_words, struct_of, sums_by_start, word_ngrams

BUCKETS, LOW, HIGH = 1 << 16, 1, 4
ABREAST = 256  # words of a long line that are worked on side by side with others
# Fitted on a bounded sample: so many rows, so many bytes of whole texts, cut into pieces.
FIT_ROWS, FIT_BYTES, PIECE = 2000, 16 << 20, 24
FIT_CHAINS = 1 << 11  # chains whose probabilities are held at a time
STEPS = 40
WORD_BLOCK = 1 << 14  # distinct words whose features are in memory at a time
BLOCK = 2 << 20  # bytes of text whose words are in memory with all their probabilities
NO_LANGUAGE = "und"


def has_letter(text: str) -> bool:
    """Whether a sign of a letter category occurs; other numeric or enclosed signs are no letters."""
    return any(map(str.isalpha, text))


def features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(word, feature) pairs ordered by word; lexicon features come after the buckets."""
    owner, key = word_ngrams(words, LOW, HIGH)
    key = (key % np.uint64(BUCKETS)).astype(np.int64)
    listed = [(i, BUCKETS + lexicon[w]) for i, w in enumerate(words) if w in lexicon]
    if listed:
        owner = np.concatenate([owner, [i for i, _ in listed]])
        key = np.concatenate([key, [k for _, k in listed]])
    return owner, key


def bagged(words: list[str], lexicon: dict[str, int], most: int) -> tuple[np.ndarray, list[tuple[int, int, np.ndarray, np.ndarray]]]:
    """The features (below `most`) that occur, and per block of words its first word and size, the owners and
    the features' places among those that occur; nothing of all pairs is sorted or held in 64 bits."""
    blocks, occurs = [], np.zeros(most, bool)
    for at in range(0, len(words), WORD_BLOCK):
        some = words[at:at + WORD_BLOCK]
        owner, key = features(some, lexicon)
        occurs[key] = True
        blocks.append((at, len(some), owner.astype(np.int32), key.astype(np.int32)))
    place = (np.cumsum(occurs) - 1).astype(np.int32)
    return np.flatnonzero(occurs), [(at, size, owner, place[key]) for at, size, owner, key in blocks]


def marginals(emission: np.ndarray, chains: np.ndarray, move: np.ndarray, first: np.ndarray, pairs: bool = False,
              into: np.ndarray | None = None, out: np.ndarray | None = None) -> tuple[np.ndarray, float, np.ndarray | None, np.ndarray]:
    """Forward-backward over chains laid end to end, all chains of a step at once.

    `into` and `out` give the messages that reach a chain's first and last word from outside; without
    them a chain stands alone. Returns the probabilities of each word's labels, the log partition sum, the expected
    transitions (if asked for) and the expected first labels.
    """
    n, labels = emission.shape
    order = np.argsort(-chains, kind="stable")  # long chains first: those alive are a prefix
    begin = (np.cumsum(chains) - chains)[order]
    sizes = chains[order]
    peak = emission.max(1, keepdims=True)
    score = np.exp(emission - peak)
    step = np.exp(move)
    ahead, scale, behind = np.empty((n, labels)), np.empty(n), np.empty((n, labels))
    alive = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right") if len(sizes) else []
    before = None
    for t, k in enumerate(alive):
        at = begin[:k] + t
        start = np.exp(first) if into is None else into[order]
        value = score[at] * (start if t == 0 else before[:k] @ step)
        scale[at] = value.sum(1)
        before = value / scale[at][:, None]
        ahead[at] = before
    expected = np.zeros((labels, labels)) if pairs else None
    after = np.empty((0, labels))
    for t in range(len(alive) - 1, -1, -1):
        k = alive[t]
        at = begin[:k] + t
        beta = np.ones((k, labels)) if out is None else out[order[:k]]
        if len(after):
            m = len(after)
            nxt = at[:m] + 1
            flow = score[nxt] * after / scale[nxt][:, None]
            beta[:m] = flow @ step.T
            if pairs:
                expected += (ahead[at[:m]].T @ flow) * step
        behind[at] = beta
        after = beta
    found = ahead * behind
    found /= found.sum(1, keepdims=True)
    return found, float(np.log(scale).sum() + peak.sum()), expected, found[begin].sum(0)


def in_pieces(sizes: np.ndarray, most: int) -> np.ndarray:
    """The lengths of chains cut into pieces of at most `most` words."""
    count = -(-sizes // most)
    pieces = np.full(int(count.sum()), most)
    pieces[np.cumsum(count) - 1] = sizes - (count - 1) * most
    return pieces


def line_marginals(emission: np.ndarray, sizes: np.ndarray, move: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Probabilities of each word's labels in chains of any length.

    A long chain is cut into pieces whose products of step matrices are taken side by side; messages
    then pass from piece to piece, so the result is that of the whole chain.
    """
    pieces = in_pieces(sizes, ABREAST)
    if len(pieces) == len(sizes):
        return marginals(emission, sizes, move, first)[0]
    labels = emission.shape[1]
    score, step = np.exp(emission - emission.max(1, keepdims=True)), np.exp(move)
    begin, order = np.cumsum(pieces) - pieces, np.argsort(-pieces, kind="stable")
    alive = np.searchsorted(-pieces[order], -np.arange(1, pieces.max() + 1), side="right")
    through = np.broadcast_to(np.eye(labels), (len(pieces), labels, labels)).copy()  # in the order of length
    for t, k in enumerate(alive):
        through[:k] = (through[:k] @ step if t else through[:k]) * score[begin[order[:k]] + t][:, None, :]
        through[:k] /= through[:k].max((1, 2), keepdims=True)
    through[order] = through.copy()
    count = -(-sizes // ABREAST)
    head = np.cumsum(count) - count
    into, out = np.tile(np.exp(first), (len(pieces), 1)), np.ones((len(pieces), labels))
    for k in range(1, int(count.max())):
        now = head[count > k] + k
        passed = np.einsum("ni,nij->nj", into[now - 1], through[now - 1]) @ step
        into[now] = passed / passed.max(1, keepdims=True)
    for k in range(int(count.max()) - 1, 0, -1):
        now = head[count > k] + k
        passed = np.einsum("nij,nj->ni", through[now], out[now]) @ step.T
        out[now - 1] = passed / passed.max(1, keepdims=True)
    return marginals(emission, pieces, move, first, into=into, out=out)[0]


@dataclass
class LanguageModel:
    labels: list[str]
    weights: np.ndarray  # (features, labels)
    move: np.ndarray
    first: np.ndarray
    lexicon: dict[str, int]

    def emissions(self, words: list[str]) -> np.ndarray:
        found = [np.zeros((0, len(self.labels)))]
        for at in range(0, len(words), WORD_BLOCK):
            block = words[at:at + WORD_BLOCK]
            owner, key = features(block, self.lexicon)
            found.append(np.stack([np.bincount(owner, column[key], minlength=len(block)) for column in self.weights.T], 1))
        return np.concatenate(found)

    def word_marginals(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Label probabilities of all words, and where each text's words begin."""
        lines = pc.split_pattern(texts, "\n")
        codes, starts, words = split_words(lines.flatten())
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lines).to_numpy(zero_copy_only=False))])
        if not len(codes):
            return np.zeros((0, len(self.labels))), np.zeros(len(texts) + 1, np.int64)
        emission = self.emissions(pc.utf8_lower(words).to_pylist())[codes]
        sizes = np.diff(starts)
        return line_marginals(emission, sizes[sizes > 0], self.move, self.first), starts[ends]

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        if not self.labels:
            return [NO_LANGUAGE] * len(texts), np.zeros(len(texts))
        found, starts = self.word_marginals(texts)
        total = sums_by_start(found, starts)
        share = total / np.maximum(total.sum(1, keepdims=True), 1e-12)
        best = share.argmax(1)
        lettered = np.array([has_letter(t) for t in texts.to_pylist()], bool)
        names = [self.labels[b] if ok else NO_LANGUAGE for b, ok in zip(best.tolist(), lettered)]
        score = np.clip(np.where(lettered, share[np.arange(len(best)), best], 0.0), 0, 1)
        return names, score


def fit(sample: Sample | list[tuple[str, str]], seed: int = 5) -> LanguageModel:
    """Learns emissions, transitions and lexicon; every word of a text has the text's language."""
    texts, marks = as_sample(sample)
    labels = sorted({label for text, label in zip(texts.to_pylist(), marks) if has_letter(text)})
    count = len(labels)
    if not count:
        return LanguageModel([], np.zeros((BUCKETS, 0)), np.zeros((0, 0)), np.zeros(0), {})
    rng = np.random.default_rng(seed)
    known = [label in labels for label in marks]
    texts = texts.filter(pa.array(known))
    truth = np.array([labels.index(label) for label in marks if label in labels])
    codes, starts, words = split_many(texts)
    pieces = []
    for i, (a, b) in enumerate(zip(starts[:-1], starts[1:])):
        for p in range(a, b, PIECE):
            pieces.append((int(p), int(min(p + PIECE, b)), int(truth[i])))
    # A third of the chains join the halves of two pieces, as code-switched lines would; what is left of the first is a chain of its own.
    chains, cell, target = [], [], []
    for a, b, label in (pieces[i] for i in rng.permutation(len(pieces))):
        joined = [[(a, b, label)]]
        if rng.random() < 0.35:
            c, d, other = pieces[rng.integers(len(pieces))]
            joined = [[(a, (a + b + 1) // 2, label), ((c + d) // 2, d, other)], [((a + b + 1) // 2, b, label)]]
        for parts in joined:
            parts = [p for p in parts if p[1] > p[0]]
            if not parts:
                continue
            chains.append(sum(e - s for s, e, _ in parts))
            for s, e, lab in parts:
                cell.append(np.arange(s, e, dtype=np.int32)), target.append(np.full(e - s, lab, np.int16))
    cell, target, chains = np.concatenate(cell), np.concatenate(target), np.array(chains)
    used, word_of = np.unique(codes[cell], return_inverse=True)
    word_of = word_of.astype(np.int32)
    spelled = pc.utf8_lower(words.take(pa.array(used))).to_pylist()
    # Lexicon: words seen often enough, nearly always in one language.
    seen = np.zeros((len(used), count))
    np.add.at(seen, (word_of, target), 1)
    lexicon = {w: int(s.argmax()) for w, s in zip(spelled, seen) if s.sum() >= 5 and s.max() >= 0.8 * s.sum()}
    keys, bags = bagged(spelled, lexicon, BUCKETS + count)
    del codes, texts, words, pieces, spelled
    release_memory()
    weights, move, first = np.zeros((len(keys), count)), np.zeros((count, count)), np.zeros(count)
    begin = np.cumsum(chains) - chains
    inner = np.ones(len(cell), bool)
    inner[begin] = False
    at = np.flatnonzero(inner)
    seen_moves = np.zeros((count, count))
    np.add.at(seen_moves, (target[at - 1], target[at]), 1)
    seen_first = np.bincount(target[begin], minlength=count)
    held = [[np.zeros_like(p), np.zeros_like(p)] for p in (weights, move, first)]
    for tick in range(1, STEPS + 1):
        word = np.concatenate([np.stack([np.bincount(owner, w[slot], minlength=size) for w in weights.T], 1) for _, size, owner, slot in bags])
        back, moves, firsts = np.zeros((len(used), count)), np.zeros((count, count)), np.zeros(count)
        for low in range(0, len(chains), FIT_CHAINS):
            some = chains[low:low + FIT_CHAINS]
            part = slice(begin[low], begin[low] + some.sum())
            found, _, moved, started = marginals(word[word_of[part]], some, move, first, pairs=True)
            found[np.arange(len(found)), target[part]] -= 1
            back += np.stack([np.bincount(word_of[part], f, minlength=len(used)) for f in found.T], 1)
            moves, firsts = moves + moved, firsts + started
        slopes = np.zeros_like(weights)
        for low, size, owner, slot in bags:
            for total, b in zip(slopes.T, back[low:low + size].T):
                total += np.bincount(slot, b[owner], minlength=len(keys))
        grads = [slopes / len(cell) + 1e-6 * weights,
                 (moves - seen_moves) / len(cell), (firsts - seen_first) / len(cell)]
        for (mean, square), g, parameter in zip(held, grads, (weights, move, first)):
            mean += 0.1 * (g - mean)
            square += 0.01 * (g * g - square)
            parameter -= 0.1 * (mean / (1 - 0.9 ** tick)) / (np.sqrt(square / (1 - 0.99 ** tick)) + 1e-9)
    full = np.zeros((BUCKETS + count, count), np.float32)
    full[keys] = weights
    return LanguageModel(labels, full, move, first, lexicon)


def fit_language(docs: DataFrame, rows: int = FIT_ROWS, size: int = FIT_BYTES, key: str = "doc_id",
                 text: str = "text", lang: str = "lang") -> LanguageModel:
    """Fits on at most `rows` documents with a language and `size` bytes of their whole texts."""
    model = fit(labelled_texts(docs, None, lang, rows, size, key, text))
    release_memory()
    return model


KIND = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def language(spark: SparkSession, text: Column, model: LanguageModel) -> Column:
    """Struct (lang_pred, score) of the whole text; `und` with score 0 for null or letterless texts."""
    shared = spark.sparkContext.broadcast((model.labels, model.weights, model.move, model.first, model.lexicon))

    @F.arrow_udf(KIND)
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = LanguageModel(*shared.value)

        def work(block: pa.Array) -> pa.Array:
            names, score = model.predict(block)
            return struct_of({"lang_pred": (names, pa.string()), "score": (score, pa.float64())})
        for texts in batches:
            yield by_block(texts, work, BLOCK)
    return predict(text)


def word_languages(spark: SparkSession, text: Column, model: LanguageModel) -> Column:
    """Array of (word, lang, score) for code-switched text; empty for a null text."""
    shared = spark.sparkContext.broadcast((model.labels, model.weights, model.move, model.first, model.lexicon))

    @F.arrow_udf("array<struct<word:string,lang:string,score:double>>")
    def label(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = LanguageModel(*shared.value)
        kind = pa.list_(pa.struct([("word", pa.string()), ("lang", pa.string()), ("score", pa.float64())]))

        def work(block: pa.Array) -> pa.Array:
            found, starts = model.word_marginals(block)
            codes, _, words = split_words(block)
            spelled, best = words.to_pylist(), found.argmax(1) if len(found) else []
            rows = [{"word": spelled[c], "lang": model.labels[b], "score": float(found[i, b])}
                    for i, (c, b) in enumerate(zip(codes.tolist(), best))]
            return pa.array([rows[a:b] for a, b in zip(starts[:-1], starts[1:])], kind)
        for texts in batches:
            yield by_block(texts, work, BLOCK)
    return label(text)
