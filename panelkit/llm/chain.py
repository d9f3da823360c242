"""A linear-chain conditional random field with two states, on numpy arrays.

Messages of a two-state chain are one number each: the log odds of state 1. Chains of many lengths step together,
longest first, so a step costs a few array operations over the chains that are still running.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: Weights of hashed features.
LOG_FEATURES = 18
#: Positions whose features or pairs are looked at together: several numbers for each would outweigh the chains themselves.
PIECE = 1 << 16


@dataclass
class Chain:
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1 << LOG_FEATURES))
    #: bias, start in state 1, transitions 0 to 1, 1 to 0 and 1 to 1 (0 to 0 is the reference)
    moves: np.ndarray = field(default_factory=lambda: np.array([-4.0, 0.0, -1.0, 0.0, 0.0]))

    def emissions(self, features: np.ndarray) -> np.ndarray:
        out = np.empty(len(features))
        for at in range(0, len(features), PIECE):
            out[at : at + PIECE] = self.weights[features[at : at + PIECE]].sum(1) + self.moves[0]
        return out

    def messages(self, d: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward and backward log odds of each position. ``first``: bounds of the chains in ``d``."""
        length = np.diff(first)
        order = np.argsort(-length, kind="stable")
        head, length = first[:-1][order], length[order]
        running = np.searchsorted(-length, -np.arange(1, (length[0] if len(length) else 0) + 1), "right")
        _, start, enter, leave, stay = self.moves
        forward, backward = np.empty(len(d)), np.zeros(len(d))
        for t, n in enumerate(running):
            at = head[:n] + t
            if t:
                r = forward[at - 1]
                forward[at] = d[at] + np.logaddexp(r + stay, enter) - np.logaddexp(r + leave, 0.0)
            else:
                forward[at] = d[at] + start
        for t in range(len(running) - 2, -1, -1):
            at = head[: running[t + 1]] + t
            r = d[at + 1] + backward[at + 1]
            backward[at] = np.logaddexp(r + stay, leave) - np.logaddexp(r + enter, 0.0)
        return forward, backward

    def marginals(self, features: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Chance of state 1 at each position."""
        forward, backward = self.messages(self.emissions(features), first)
        return 1 / (1 + np.exp(-np.clip(forward + backward, -50, 50)))

    def _pairs(self, d: np.ndarray, forward: np.ndarray, backward: np.ndarray, tail: np.ndarray) -> np.ndarray:
        """Expected moves from 0 to 1, 1 to 0 and 1 to 1 into the positions ``tail``."""
        sums = np.zeros(3)
        for start in range(0, len(tail), PIECE):
            at = tail[start : start + PIECE]
            # log weights of (0,0), (0,1), (1,0), (1,1) before normalising
            r, ahead = forward[at - 1], d[at] + backward[at]
            logs = np.stack([np.zeros(len(at)), ahead + self.moves[2], r + self.moves[3], r + ahead + self.moves[4]])
            logs -= logs.max(0)
            joint = np.exp(logs)
            joint /= joint.sum(0)
            sums += joint[1:].sum(1)
        return sums

    def fit(self, features: np.ndarray, first: np.ndarray, state: np.ndarray, steps: int = 25, rate: float = 0.4, l2: float = 1e-6) -> Chain:
        """Maximum likelihood of the given states by Adam on observed less expected counts."""
        n = len(state)
        if not n:
            return self
        head = np.zeros(n, bool)
        head[first[:-1][np.diff(first) > 0]] = True
        tail = np.flatnonzero(~head)  # positions with one before
        size = len(self.weights)
        seen = np.concatenate([np.bincount(features[:, j][state == 1], minlength=size) for j in range(features.shape[1])]).reshape(-1, size).sum(0)
        pair = lambda a, b: float((a[tail - 1] * b[tail]).sum())
        s = state.astype(float)
        observed = np.concatenate([[s.sum(), s[head].sum(), pair(1 - s, s), pair(s, 1 - s), pair(s, s)], seen])
        theta = np.concatenate([self.moves, self.weights])
        mean, square = np.zeros_like(theta), np.zeros_like(theta)
        scale = 1.0 / max(s.sum(), 1.0)
        for step in range(1, steps + 1):
            self.moves, self.weights = theta[:5], theta[5:]
            d = self.emissions(features)
            forward, backward = self.messages(d, first)
            p = 1 / (1 + np.exp(-np.clip(forward + backward, -50, 50)))
            joint = self._pairs(d, forward, backward, tail)
            counts = np.zeros(size)
            for j in range(features.shape[1]):
                counts += np.bincount(features[:, j], p, size)
            expected = np.concatenate([[p.sum(), p[head].sum(), *joint], counts])
            gradient = (observed - expected) * scale - l2 * theta
            mean = 0.9 * mean + 0.1 * gradient
            square = 0.999 * square + 0.001 * gradient**2
            theta = theta + rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        self.moves, self.weights = theta[:5], theta[5:]
        return self


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-2, steps: int = 25) -> np.ndarray:
    """Weights (constant first) of a logistic regression, by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    ridge = l2 * np.eye(len(w))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
    return w
