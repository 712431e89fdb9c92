"""Linear models on the driver, fitted on a bounded sample: logistic regression and its calibration."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 150, l2: float = 2e-5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and offsets, one column per column of ``y`` (0 or 1), by accelerated gradient steps."""
    w = np.zeros((x.shape[1], y.shape[1]), np.float32)
    b = np.zeros(y.shape[1], np.float32)
    y, share = y.astype(np.float32), (weight / weight.sum()).astype(np.float32)[:, None]
    ahead_w, ahead_b, step = w, b, 8.0
    for k in range(rounds):
        gap = ((sigmoid(x @ ahead_w + ahead_b) - y) * share).astype(np.float32)
        new_w = ahead_w - step * (x.T @ gap + l2 * ahead_w)
        new_b = ahead_b - 0.5 * step * gap.sum(0)
        speed = k / (k + 3)
        ahead_w = (new_w + speed * (new_w - w)).astype(np.float32)
        ahead_b = (new_b + speed * (new_b - b)).astype(np.float32)
        w, b = new_w, new_b
    return w, b


def fifth_first(n: int) -> tuple[np.ndarray, int]:
    """An order of ``n`` rows that puts every fifth one first, and how many these are: parts of a matrix without copies."""
    fifth = np.arange(n) % 5 == 0
    return np.concatenate([np.flatnonzero(fifth), np.flatnonzero(~fifth)]), int(fifth.sum())


def calibrate(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn margins into probabilities (Newton steps, targets smoothed by one row a side)."""
    if not len(y):
        return 1.0, 0.0
    ones, noughts = (weight * y).sum(), (weight * (1 - y)).sum()
    target = np.where(y > 0, (ones + 1) / (ones + 2), 1 / (noughts + 2))
    x = np.stack([margin, np.ones_like(margin)], 1).astype(np.float64)
    at = np.array([1.0, 0.0])
    for _ in range(30):
        p = sigmoid(x @ at)
        grad = x.T @ (weight * (p - target)) + 1e-3 * (at - [1.0, 0.0])
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        move = np.linalg.solve(curve, grad)
        at = at - np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-8:
            break
    return (float(at[0]), float(at[1])) if at[0] > 0 else (1.0, 0.0)
