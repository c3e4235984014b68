"""Order-dependent recurrences as pure steps ``step(state, value) -> (state, outputs)``.

The same step runs in the batch scan (:mod:`faultline.operators.scan`) and in the streaming processors
(:mod:`faultline.streaming.processors`), so both give the same numbers.  A state is a flat tuple of floats.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import exp, inf, isfinite, log, sqrt

Step = Callable[[tuple, float], tuple[tuple, tuple]]


@dataclass(frozen=True)
class Recurrence:
    """A step with its initial state and the names of what it puts out (all DOUBLE)."""

    start: tuple[float, ...]
    outputs: tuple[str, ...]
    step: Step


def _positive(**values: float) -> None:
    """FLT-02: noise levels and variances must be positive."""
    for name, value in values.items():
        if not value > 0:
            raise ValueError(f"{name} must be positive, not {value}")


def _kalman(x: float, p: float, q: float, r: float, z: float, limit: float = inf) -> tuple[float, float, float]:
    ahead = p + q
    gain = ahead / (ahead + r)
    return x + gain * min(limit, max(-limit, z - x)), (1.0 - gain) * ahead, gain


def kalman(q: float = 1e-5, r: float = 1e-3, p0: float = 1.0, x0: float = 0.0, max_innovation: float | None = None) -> Recurrence:
    """FLT-01, FLT-03: scalar Kalman filter; state ``(x, P)``, outputs estimate, variance and gain."""
    _positive(q=q, r=r, p0=p0)
    limit = inf if max_innovation is None else max_innovation

    def step(state: tuple, z: float) -> tuple[tuple, tuple]:
        x, p, gain = _kalman(*state, q, r, z, limit)
        return (x, p), (x, p, gain)

    return Recurrence((x0, p0), ("x", "p", "gain"), step)


def kalman_cascade(first: tuple[float, float, float] = (1e-5, 1e-3, 1.0), second: tuple[float, float, float] = (1e-6, 5e-3, 1.0)) -> Recurrence:
    """FLT-04: the second filter smooths the first one's estimate; stages are ``(q, r, p0)``."""
    for q, r, p0 in (first, second):
        _positive(q=q, r=r, p0=p0)

    def step(state: tuple, z: float) -> tuple[tuple, tuple]:
        x1, p1, _ = _kalman(state[0], state[1], *first[:2], z)
        x2, p2, _ = _kalman(state[2], state[3], *second[:2], x1)
        return (x1, p1, x2, p2), (x1, x2)

    return Recurrence((0.0, first[2], 0.0, second[2]), ("x1", "x"), step)


def annealing_schedule(start: float = 100.0, final: float = 0.1, steps: int = 5) -> list[float]:
    """FLT-07: geometric from ``start`` to ``final``; one step gives ``[final]``."""
    return [start * (final / start) ** (i / (steps - 1)) for i in range(steps)] if steps > 1 else [final]


def anneal_weight(chi2: float, beta: float, innovation: float, prob_cut: float = 1e-3) -> float:
    """FLT-09: weight of one measurement against the cut; 1 where both terms underflow."""
    norm = (2.0 * 3.141592653589793) ** -0.5 * innovation**-0.5
    phi = norm * exp(-min(chi2 / (2.0 * beta), 50.0))
    cut = norm * exp(-min(-2.0 * log(max(prob_cut, 1e-12)) / (2.0 * beta), 50.0))
    return phi / (phi + cut) if phi + cut >= 1e-12 else 1.0


def annealed_kalman(q: float = 1e-5, r: float = 1e-3, p0: float = 1.0, x0: float = 0.0, betas: tuple[float, ...] = tuple(annealing_schedule()), max_iterations: int = 4, settled: float = 1e-3, outlier: float = 0.1) -> Recurrence:
    """FLT-08: one measurement at a time, annealed from a frozen prediction; outputs estimate, weight, outlier flag."""
    _positive(q=q, r=r, p0=p0)

    def step(state: tuple, z: float) -> tuple[tuple, tuple]:
        x, ahead = state[0], state[1] + q
        residual, before, weight, gain = z - x, 1.0, 1.0, 0.0
        for k in range(max_iterations):
            spread = ahead + r
            weight = anneal_weight(residual * residual / spread if spread > 1e-12 else 0.0, betas[min(k, len(betas) - 1)], spread)
            gain = ahead * weight / (ahead * weight + r) if weight > 0 else 0.0
            if abs(weight - before) < settled:
                break
            before = weight
        x, p = x + gain * residual, (1.0 - gain) * ahead
        return (x, p), (x, weight, 1.0 if weight < outlier else 0.0)

    return Recurrence((x0, p0), ("x", "weight", "outlier"), step)


def ewma(alpha: float = 0.05, min_window: int = 1000, sigmas: float = 3.0, min_std: float = 1e-6) -> Recurrence:
    """WIN-02 to WIN-04: moving mean and variance, z-score and flag, and the envelope after the update.

    State ``(count, mean, variance)``.  The first finite value sets the mean, the variance starts at 1.  A
    non-finite value changes nothing and scores 0.  Scores are 0 until ``min_window`` values were seen.
    """

    def step(state: tuple, v: float) -> tuple[tuple, tuple]:
        n, mean, var = state
        finite = v is not None and isfinite(v)
        if finite:
            if n == 0:
                mean = v
            else:
                gap = v - mean
                mean, var = alpha * v + (1.0 - alpha) * mean, alpha * gap * gap + (1.0 - alpha) * var
            n += 1
        std = sqrt(var) if var > 0 else min_std
        z = (v - mean) / std if finite and n >= min_window else 0.0
        return (n, mean, var), (mean, var, z, 1.0 if abs(z) > sigmas else 0.0, mean - sigmas * std, mean + sigmas * std)

    return Recurrence((0.0, 0.0, 1.0), ("mean", "variance", "z", "flag", "lower", "upper"), step)


def annealed_window(values: list[float], variances: list[float], x: float, p: float, q: float = 1e-5, betas: tuple[float, ...] = tuple(annealing_schedule()), max_iterations: int = 4, settled: float = 1e-3, prob_cut: float = 1e-3, shared: bool = False) -> tuple[list[float], bool, int]:
    """FLT-12: joint annealing of a window from state ``(x, p)``: weights, whether they settled, iterations.

    ``shared`` makes all measurements compete for one sum of weights; otherwise each is weighed against its own
    cut, so that a clean window keeps all of its values.
    """
    cut, weights, before = -2.0 * log(max(prob_cut, 1e-12)), [1.0] * len(values), [1.0] * len(values)
    for k in range(max_iterations):
        beta, at, spread = betas[min(k, len(betas) - 1)], x, p
        scores, norms = [], []
        for z, r, w in zip(values, variances, weights):
            ahead = spread + q
            total, gap = ahead + r, z - at
            scores.append(gap * gap / total if total > 1e-12 else 0.0)
            norms.append((2.0 * 3.141592653589793) ** -0.5 * total**-0.5)
            gain = ahead * w / (ahead * w + r) if w > 0 else 0.0
            at, spread = at + gain * gap, (1.0 - gain) * ahead
        inside = [n * exp(-min(s / (2.0 * beta), 50.0)) for n, s in zip(norms, scores)]
        outside = [n * exp(-min(cut / (2.0 * beta), 50.0)) for n in norms]
        if shared:
            total = sum(inside) + sum(outside)
            fresh = [a / total if total >= 1e-12 else 0.0 for a in inside]
        else:
            fresh = [a / (a + b) if a + b >= 1e-12 else 1.0 for a, b in zip(inside, outside)]
        moved = max((abs(a - b) for a, b in zip(fresh, before)), default=0.0)
        if moved < settled:
            return fresh, True, k + 1
        before, weights = weights, fresh
    return weights, False, max_iterations
