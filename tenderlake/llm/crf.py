"""A linear-chain conditional random field in numpy, over many sequences at once.

Items have dense features and any number of hashed words; the words of an item weigh one over the
root of their number each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Features:
    """Items of consecutive sequences."""

    dense: np.ndarray  # items x features
    buckets: np.ndarray  # hashed words of all items
    item: np.ndarray  # the item of each
    lengths: np.ndarray  # items of each sequence

    def __post_init__(self) -> None:
        n = np.bincount(self.item, minlength=len(self.dense))
        self.scale = 1 / np.sqrt(np.maximum(n, 1))

    def words(self, values: np.ndarray) -> np.ndarray:
        """Sums over the words of each item of the rows of ``values`` that belong to them."""
        out = np.zeros((len(self.dense), values.shape[1]))
        if len(self.buckets):
            there, first = np.unique(self.item, return_index=True)
            out[there] = np.add.reduceat(values[self.buckets], first, axis=0)
        return out * self.scale[:, None]


def _steps(lengths: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each position the sequences (longest first) that have it, and their items there."""
    order = np.argsort(-lengths, kind="stable")
    start = (np.cumsum(lengths) - lengths)[order]
    alive = np.searchsorted(-lengths[order], -np.arange(lengths.max(initial=0)), side="left")
    return [(order[:m], start[:m] + t) for t, m in enumerate(alive)]


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


@dataclass
class Chain:
    """Weights of features and words, of label pairs and of the first label."""

    dense: np.ndarray  # features x labels
    words: np.ndarray  # buckets x labels
    step: np.ndarray  # label x next label
    start: np.ndarray

    def scores(self, f: Features) -> np.ndarray:
        return f.dense @ self.dense + f.words(self.words)

    def decode(self, f: Features) -> tuple[np.ndarray, np.ndarray]:
        """Labels of all items on the best paths, and the odds of each sequence's path (1 without items)."""
        score, tags = self.scores(f), np.zeros(len(f.dense), dtype=np.int64)
        sure = np.ones(len(f.lengths))
        steps, back = _steps(f.lengths), []
        best = all_paths = np.zeros((0, len(self.start)))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        for t, (seqs, items) in enumerate(steps):
            if t == 0:
                best, all_paths = self.start + score[items], self.start + score[items]
            else:
                m = len(seqs)
                total = best[:m, :, None] + self.step
                back.append(total.argmax(1))
                best = total.max(1) + score[items]
                all_paths = _lse(all_paths[:m, :, None] + self.step, 1) + score[items]
            ending = slice(len(steps[t + 1][0]) if t + 1 < len(steps) else 0, len(seqs))
            sure[seqs[ending]] = np.exp(best[ending].max(1) - _lse(all_paths[ending], 1))
            done.append((items[ending], best[ending].argmax(1)))
        now = np.zeros(0, dtype=np.int64)
        for t in range(len(steps) - 1, -1, -1):
            ended, last = done[t]
            now = np.concatenate([back[t][np.arange(len(now)), now] if len(now) else now, last]) if t < len(steps) - 1 else last
            tags[steps[t][1]] = now
        return tags, sure


@dataclass
class Batch:
    """Sequences with their labels; each weighs as much as told."""

    f: Features
    labels: np.ndarray  # of the items
    weights: np.ndarray  # of the sequences


def _gradient(model: Chain, batch: Batch, plan: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Of the mean log likelihood of the labels."""
    f, n_labels = batch.f, len(model.start)
    gold = np.eye(n_labels)[batch.labels]
    e = model.scores(f)
    fwd, bwd = np.empty_like(e), np.zeros_like(e)
    for t, (seqs, items) in enumerate(plan):
        fwd[items] = e[items] + (model.start if t == 0 else _lse(fwd[plan[t - 1][1][: len(items)], :, None] + model.step, 1))
    for t in range(len(plan) - 2, -1, -1):
        after = plan[t + 1][1]
        bwd[plan[t][1][: len(after)]] = _lse(model.step + (e[after] + bwd[after])[:, None, :], 2)
    z = np.zeros(len(f.lengths))
    z[plan[0][0]] = _lse(fwd[plan[0][1]] + bwd[plan[0][1]], 1)
    weight = np.repeat(batch.weights, f.lengths)[:, None]
    off = (gold - np.exp(fwd + bwd - np.repeat(z, f.lengths)[:, None])) * weight
    pair = np.zeros((n_labels, n_labels))
    for (_, a), (seqs, b) in zip(plan, plan[1:]):
        a = a[: len(b)]
        odds = np.exp(fwd[a, :, None] + model.step + (e[b] + bwd[b])[:, None, :] - z[seqs][:, None, None])
        pair += (gold[a] * weight[a]).T @ gold[b] - (odds * weight[a, :, None]).sum(0)
    by_word = (off * f.scale[:, None])[f.item]
    words = np.stack([np.bincount(f.buckets, by_word[:, k], len(model.words)) for k in range(n_labels)], axis=1)
    total = max(batch.weights.sum(), 1e-9)
    return [g / total for g in (f.dense.T @ off, words, pair, off[plan[0][1]].sum(0))]


def train(f: Features, labels: np.ndarray, n_labels: int, n_buckets: int, steps: int = 80, begin: Chain | None = None) -> Chain:
    """``train_batches`` over all sequences at once, which weigh the same."""
    return train_batches([Batch(f, labels, np.ones(len(f.lengths)))], n_labels, n_buckets, steps, begin)


def train_batches(batches: list[Batch], n_labels: int, n_buckets: int, rounds: int, begin: Chain | None = None, rate: float = 0.2, decay: float = 1e-3) -> Chain:
    """Maximum conditional likelihood with an L2 penalty, by Adam from ``begin`` on, a step for each batch in every round.

    The rate falls; the weights returned are the mean of those after the steps of the last round.
    """
    plans = [_steps(b.f.lengths) for b in batches]
    params = [np.zeros((batches[0].f.dense.shape[1], n_labels)), np.zeros((n_buckets, n_labels)), np.zeros((n_labels, n_labels)), np.zeros(n_labels)]
    if begin is not None:
        params = [begin.dense, begin.words, begin.step, begin.start]
    m, v, mean = ([np.zeros_like(p) for p in params] for _ in range(3))
    steps = rounds * len(batches)
    for it in range(1, steps + 1):
        at = (it - 1) % len(batches)
        for k, g in enumerate(_gradient(Chain(*params), batches[at], plans[at])):
            g = g - decay * params[k]
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            params[k] = params[k] + rate * max(0.05, 1 - it / steps) * (m[k] / (1 - 0.9**it)) / (np.sqrt(v[k] / (1 - 0.99**it)) + 1e-8)
            if it > steps - len(batches):
                mean[k] += params[k] / len(batches)
    return Chain(*mean)
