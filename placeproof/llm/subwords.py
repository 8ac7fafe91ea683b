"""Text classifiers on averaged subword embeddings: hashed character n-grams of words, one embedding table and one linear
softmax, trained jointly by stochastic gradient descent in numpy on a bounded sample; scoring runs in the tasks.

A text is the mean over all its words of the mean over a word's n-grams. As the softmax is linear, a word adds the same
amount to each class in every text; these amounts are worked out once per word and task and then summed over whole texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

KEPT_WORDS = 400_000


@dataclass(frozen=True)
class Shape:
    """Which n-grams (of UTF-8 bytes) a word has, and how they are hashed and embedded."""

    shortest: int = 2
    longest: int = 6
    buckets: int = 1 << 17
    dim: int = 16

    def grams(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For every byte of every word with marked ends: ids of the n-grams that begin there, and first of the whole word at
        its beginning; -1 where there is none. Also where each word begins."""
        marked = [f"<{w}>".encode(errors="replace") for w in words]
        sizes = np.array([len(m) for m in marked], dtype=np.int64)
        begins = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"".join(marked), dtype=np.uint8).astype(np.uint64)
        left = np.repeat(begins + sizes, sizes) - np.arange(len(data))
        ids = np.full((len(data), self.longest - self.shortest + 2), -1, dtype=np.int32)
        ids[begins, 0] = [zlib.crc32(m) % self.buckets for m in marked]
        padded = np.concatenate([data, np.zeros(self.longest, dtype=np.uint64)])
        rolling = np.zeros(len(data), dtype=np.uint64)
        for n in range(1, self.longest + 1):
            rolling = rolling * np.uint64(0x100000001B3) + padded[n - 1:n - 1 + len(data)] + np.uint64(1)
            if n >= self.shortest:
                mixed = (rolling ^ (rolling >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
                ids[:, n - self.shortest + 1] = np.where(left >= n, (mixed >> np.uint64(40)) % np.uint64(self.buckets), -1).astype(np.int32)
        return ids, begins


def words_of(text: str) -> list[str]:
    return text.lower().split()


@dataclass
class Model:
    shape: Shape
    labels: list
    vectors: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def gram_scores(self) -> np.ndarray:
        """What one n-gram adds to each class: the whole model as a small table for the tasks."""
        return (self.vectors @ self.weights).astype(np.float32)


def window_sums(values: np.ndarray, window: int) -> np.ndarray:
    """Sums over every `window` rows in a row; one sum if there are no more than that."""
    total = np.concatenate([np.zeros((1, values.shape[1])), np.cumsum(values, axis=0)])
    return total[window:] - total[:-window] if len(values) > window else total[-1:]


def train(
    texts: list[str], targets: np.ndarray, labels: list, shape: Shape, epochs: int, rate: float, seed: int, window: int | None = None, warm_up: int = 2,
) -> Model:
    """Joint stochastic gradient descent over embeddings and softmax, one text a step, steps scaled as in Adagrad.

    With a `window` (two classes), a text is after the warm-up the window of so many words that speaks most for the second class,
    so a few words weigh as much in a long text as in a short one. Without texts all classes are alike.
    """
    rng = np.random.default_rng(seed)
    k = len(labels)
    vectors = rng.uniform(-0.5 / shape.dim, 0.5 / shape.dim, (shape.buckets, shape.dim)).astype(np.float32)
    weights = rng.normal(0, 0.1, (shape.dim, k)).astype(np.float32) * (1 if texts else 0)
    bias = np.zeros(k, dtype=np.float32)
    seen_vectors = np.full(shape.buckets, 1e-6, dtype=np.float32)
    seen_weights = np.full_like(weights, 1e-3)
    seen_bias = np.full_like(bias, 1e-3)
    numbers: dict[str, int] = {}  # of the different words; a text is kept as the numbers of its words
    grams, counts, bags = [np.zeros(0, dtype=np.int32)], [np.zeros(0, dtype=np.int64)], []
    for text in texts:
        parts = words_of(text)
        fresh = sorted({w for w in parts if w not in numbers})
        if fresh:
            ids, begins = shape.grams(fresh)
            grams.append(ids[ids >= 0])
            counts.append(np.add.reduceat((ids >= 0).sum(axis=1), begins))
            numbers.update(zip(fresh, range(len(numbers), len(numbers) + len(fresh))))
        bags.append(np.array([numbers[w] for w in parts], dtype=np.int32))
    del numbers
    all_grams, all_sizes = np.concatenate(grams), np.concatenate(counts)
    first = np.cumsum(all_sizes) - all_sizes
    for epoch in range(epochs):
        for i in rng.permutation(len(bags)):
            sizes = all_sizes[bags[i]]
            ids = all_grams[np.repeat(first[bags[i]] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
            spread = len(sizes)
            if window and epoch >= warm_up and spread:
                amounts = np.add.reduceat(vectors[ids] @ (weights[:, 1] - weights[:, 0]), np.cumsum(sizes) - sizes) / sizes
                best = int(window_sums(amounts[:, None], window).argmax())
                begin, end = np.r_[0, np.cumsum(sizes)][[best, min(best + window, spread)]]
                ids, sizes, spread = ids[begin:end], sizes[best:best + window], window
            each = np.repeat((1 / (max(1, spread) * sizes)).astype(np.float32), sizes)
            ids, at = np.unique(ids, return_inverse=True)
            share = np.bincount(at, weights=each, minlength=len(ids)).astype(np.float32)
            hidden = share @ vectors[ids]
            logits = hidden @ weights + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[targets[i]] -= 1
            down = weights @ p
            step_weights = np.outer(hidden, p)
            seen_weights += step_weights**2
            seen_bias += p**2
            weights -= rate * step_weights / np.sqrt(seen_weights)
            bias -= rate * p / np.sqrt(seen_bias)
            seen_vectors[ids] += share**2 * (down @ down / shape.dim)
            vectors[ids] -= (rate * share / np.sqrt(seen_vectors[ids]))[:, None] * down
    return Model(shape, labels, vectors, weights, bias)


class Scorer:
    """Class logits of whole texts from the table of n-gram scores; keeps the amounts of words it has met."""

    def __init__(self, shape: Shape, table: np.ndarray, bias: np.ndarray):
        self.shape, self.bias = shape, bias
        self.table = np.vstack([table, np.zeros((1, table.shape[1]), dtype=table.dtype)])  # no n-gram: the last row
        self.numbers: dict[str, int] = {}
        self.amounts = np.zeros((1024, table.shape[1]), dtype=np.float64)

    def _meet(self, words: set[str]) -> None:
        fresh = [w for w in words if w not in self.numbers]
        if not fresh:
            return
        if len(self.numbers) + len(fresh) > KEPT_WORDS:
            self.numbers = {}
            fresh = list(words)
        ids, begins = self.shape.grams(fresh)
        sums = np.add.reduceat(self.table[ids].sum(axis=1, dtype=np.float64), begins, axis=0)
        sizes = np.add.reduceat((ids >= 0).sum(axis=1), begins)
        begin, end = len(self.numbers), len(self.numbers) + len(fresh)
        if end > len(self.amounts):
            grown = np.zeros((max(2 * len(self.amounts), end), self.table.shape[1]))
            grown[:begin] = self.amounts[:begin]
            self.amounts = grown
        self.amounts[begin:end] = sums / sizes[:, None]
        self.numbers.update(zip(fresh, range(begin, end)))

    def word_amounts(self, text: str) -> np.ndarray:
        """What each word of the text adds to each class."""
        words = words_of(text)
        if not words:
            return np.zeros((0, self.table.shape[1]))
        self._meet(set(words))
        return self.amounts[list(map(self.numbers.__getitem__, words))]

    def logits(self, texts: list[str], window: int | None = None) -> np.ndarray:
        """One row a text: its mean over words, or its window that speaks most for the second class; the bias alone without words."""
        out = np.tile(self.bias.astype(np.float64), (len(texts), 1))
        for i, text in enumerate(texts):
            amounts = self.word_amounts(text)
            if len(amounts) and window:
                sums = window_sums(amounts, window)
                out[i] += sums[(sums[:, 1] - sums[:, 0]).argmax()] / window
            elif len(amounts):
                out[i] += amounts.mean(axis=0)
        return out


def softmax(logits: np.ndarray) -> np.ndarray:
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def batches_of(texts: list[str], size: int = 256) -> Iterator[list[str]]:
    for i in range(0, len(texts), size):
        yield texts[i:i + size]
