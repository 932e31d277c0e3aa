"""A linear-chain conditional random field over the shapes of words, in numpy."""

from __future__ import annotations

import re

import numpy as np

#: Steps of gradient ascent, their size, and the prior's weight.
STEPS, RATE, PRIOR = 120, 0.3, 1e-3

_SHAPE = bytes.maketrans(bytes(range(48, 58)) + bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)), b"d" * 10 + b"x" * 52 + b"x" * 128)
_RUN = re.compile(rb"(.)\1+", re.S)
_LONG_RUN = re.compile(rb"(.)\1{5,}", re.S)


def features_of(word: bytes) -> tuple[bytes, ...]:
    """What the field sees of a word: its shape with runs, without runs, and how many digits it has."""
    shape = word[:64].translate(_SHAPE)  # the ends of longer words add nothing
    digits = word.translate(_SHAPE).count(b"d")
    size = digits if digits < 5 else 5 if digits < 8 else 8 if digits < 12 else 12 if digits < 16 else 16 if digits < 20 else 20
    return b"r" + _LONG_RUN.sub(rb"\1\1\1\1\1+", shape), b"s" + _RUN.sub(rb"\1", shape), b"n%d" % size


class Field:
    """Weights of word features (own, of the word before, of the word after) per tag, and of tag pairs."""

    def __init__(self, tags: int, sentences: list[list[bytes]]):
        """Feature numbers come from the words to learn from; unknown features weigh nothing."""
        known = sorted({f for s in sentences for w in s for f in features_of(w)})
        self.number = {f: i + 1 for i, f in enumerate(known)}  # 0: unknown, or no such word
        self.per = 3
        self.unary = np.zeros((3, len(known) + 1, tags))
        self.pairs = np.zeros((tags, tags))
        self.bias = np.zeros(tags)
        self.seen: dict[bytes, tuple[int, ...]] = {}

    def __getstate__(self):
        return {**self.__dict__, "seen": {}}

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """[word, feature] numbers."""
        seen, get, out = self.seen, self.number.get, []
        for w in words:
            found = seen.get(w)
            if found is None:
                if len(seen) > 50_000:
                    seen.clear()
                found = seen[w] = tuple(get(f, 0) for f in features_of(w))
            out.append(found)
        return np.array(out, np.int32).reshape(-1, self.per)

    def scores(self, numbers: np.ndarray, first: np.ndarray) -> np.ndarray:
        """[word, tag] scores of words in a row; first marks the words that begin a sentence."""
        out = self.bias + self.unary[0][numbers].sum(1)
        out[1:] += np.where(first[1:, None], 0, self.unary[1][numbers[:-1]].sum(1))
        out[:-1] += np.where(first[1:, None], 0, self.unary[2][numbers[1:]].sum(1))
        return out

    def viterbi(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best tags of all words; sentences lie one after the other. Sentences of similar length go together."""
        starts = np.cumsum(lengths) - lengths
        tags = np.zeros(len(scores), np.int8)
        order = np.argsort(lengths, kind="stable")
        # a batch holds sentences up to twice as long as its shortest, so that at most half of it is padding
        at = 0
        while at < len(order):
            upto = max(at + 1, int(np.searchsorted(lengths[order], 2 * lengths[order[at]], "right")))
            own = order[at:upto]
            at, size, n = upto, lengths[own], int(lengths[order[upto - 1]])
            place = starts[own][:, None] + np.minimum(np.arange(n), size[:, None] - 1)
            inside = np.arange(n) < size[:, None]
            grid = scores[place]
            best, back = grid[:, 0], np.zeros((n, len(own), grid.shape[2]), np.int8)
            stay = np.arange(grid.shape[2], dtype=np.int8)
            for i in range(1, n):
                through = best[:, :, None] + self.pairs
                back[i] = np.where(inside[:, i, None], through.argmax(1), stay)
                best = np.where(inside[:, i, None], through.max(1) + grid[:, i], best)
            tag = best.argmax(1)
            for i in range(n - 1, -1, -1):
                here = inside[:, i]
                tags[place[here, i]] = tag[here]
                tag = back[i][np.arange(len(own)), tag]
        return tags

    def likelihood(self, grid: np.ndarray, inside: np.ndarray, gold: np.ndarray):
        """Log likelihood of gold tags, and the expected tags and tag pairs, of padded sentences [sentence, place, tag]."""
        rows, n, tags = grid.shape
        ahead, after = np.zeros_like(grid), np.zeros_like(grid)
        ahead[:, 0] = grid[:, 0]
        for i in range(1, n):
            step = np.logaddexp.reduce(ahead[:, i - 1, :, None] + self.pairs, axis=1) + grid[:, i]
            ahead[:, i] = np.where(inside[:, i, None], step, ahead[:, i - 1])
        for i in range(n - 2, -1, -1):
            step = np.logaddexp.reduce(self.pairs + (grid[:, i + 1] + after[:, i + 1])[:, None, :], axis=2)
            after[:, i] = np.where(inside[:, i + 1, None], step, 0)
        total = np.logaddexp.reduce(ahead[:, -1], axis=1)
        single = np.exp(ahead + after - total[:, None, None]) * inside[..., None]
        joint = ahead[:, :-1, :, None] + self.pairs + (grid + after)[:, 1:, None, :] - total[:, None, None, None]
        both = inside[:, 1:]
        double = (np.exp(np.where(both[..., None, None], joint, -np.inf))).sum((0, 1))
        own = np.take_along_axis(grid, gold[..., None], 2)[..., 0]
        right = (own * inside).sum() + (self.pairs[gold[:, :-1], gold[:, 1:]] * both).sum()
        return right - total.sum(), single, double

    def fit(self, sentences: list[list[bytes]], tags: list[list[int]], steps: int = STEPS) -> float:
        """Maximum likelihood with a Gaussian prior, by full gradients with per-weight step sizes; the last mean log likelihood."""
        n, rows = max(map(len, sentences)), len(sentences)
        inside = np.arange(n) < np.array([len(s) for s in sentences])[:, None]
        gold = np.zeros((rows, n), np.int64)
        gold[inside] = [t for own in tags for t in own]
        numbers = self.numbers([w for s in sentences for w in s])
        first = np.zeros(len(numbers), bool)
        first[np.cumsum([0, *(len(s) for s in sentences[:-1])])] = True
        last = np.append(first[1:], True)
        weights = [self.unary, self.pairs, self.bias]
        sums = [np.full_like(w, 1e-8) for w in weights]
        grid, value = np.zeros((rows, n, len(self.bias))), 0.0
        kinds = len(self.bias)
        truth = np.eye(kinds)
        real = np.zeros_like(self.pairs)
        np.add.at(real, (gold[:, :-1][inside[:, 1:]], gold[:, 1:][inside[:, 1:]]), 1)
        for _ in range(steps):
            grid[inside] = self.scores(numbers, first)
            value, single, double = self.likelihood(grid, inside, gold)
            off = truth[gold[inside]] - single[inside]
            slope = np.zeros_like(self.unary)
            for j in range(self.per):
                np.add.at(slope[0], numbers[:, j], off)
                np.add.at(slope[1], numbers[:-1, j], np.where(first[1:, None], 0, off[1:]))
                np.add.at(slope[2], numbers[1:, j], np.where(last[:-1, None], 0, off[:-1]))
            slope[:, 0] = 0
            for w, s, g in zip(weights, sums, (slope, real - double, off.sum(0))):
                g = g / rows - PRIOR * w
                s += g * g
                w += RATE * g / np.sqrt(s)
        return value / rows
