"""Steps against hand-computed values and invariants."""

import random
from math import sin

import pytest
from hypothesis import given
from hypothesis import strategies as st

from faultline.functions import recurrences as rec


def run(what, values):
    state, out = what.start, []
    for v in values:
        state, got = what.step(state, v)
        out.append(dict(zip(what.outputs, got)))
    return out


def test_kalman_values():
    out = run(rec.kalman(), [1.0, 1.1, 1.0])
    assert out[0]["x"] == pytest.approx(0.999001009, abs=1e-9)
    assert out[0]["gain"] == pytest.approx(0.999001009, abs=1e-9)
    assert out[1]["x"] == pytest.approx(1.0497267594, abs=1e-9)
    assert out[2]["gain"] == pytest.approx(0.3387293767, abs=1e-9)


def test_kalman_converges_and_limits_innovation():
    out = run(rec.kalman(x0=10.0), [14.0] * 100)
    assert out[-1]["x"] == pytest.approx(14.0, abs=1e-2)
    assert out[-1]["p"] < out[0]["p"]
    assert run(rec.kalman(max_innovation=1.0), [100.0])[0]["x"] <= 1.0


@pytest.mark.parametrize("bad", [{"q": 0}, {"r": -1}, {"p0": 0}])
def test_parameters_must_be_positive(bad):
    with pytest.raises(ValueError):
        rec.kalman(**bad)


def test_cascade_smooths():
    rng = random.Random(42)
    values = [14 + 2 * sin(i / 25) + rng.gauss(0, 0.3) for i in range(500)]
    out = [o["x"] for o in run(rec.kalman_cascade(), values)]
    rough = lambda xs: sum((b - a) ** 2 for a, b in zip(xs, xs[1:]))
    assert len(out) == 500 and rough(out[50:]) < rough(values[50:]) / 10


def test_schedule():
    assert rec.annealing_schedule() == pytest.approx([100, 17.7827941, 3.16227766, 0.562341325, 0.1])
    assert rec.annealing_schedule(5, 2, 1) == [2]


def test_weight_values():
    assert rec.anneal_weight(1.0, 0.5623413252, 1.0) == pytest.approx(0.99998874604, abs=1e-9)
    assert rec.anneal_weight(16.2, 0.5623413252, 1.0) >= 0.1 > rec.anneal_weight(16.4, 0.5623413252, 1.0)


def test_single_spike_is_an_outlier():
    values = [14 + 0.1 * sin(0.1 * i) for i in range(100)]
    values[50] = 50.0
    out = run(rec.annealed_kalman(q=1e-2, r=0.05, x0=14.0), values)
    assert [i for i, o in enumerate(out) if o["outlier"]] == [50]
    assert abs(out[50]["x"] - 14) < 1


def test_window_modes():
    values = [14.0] * 32
    values[16] = 500.0
    own, _, n = rec.annealed_window(values, [0.05] * 32, 14.0, 1.0, 1e-2)
    assert n <= 4 and own[16] < 0.1 and sum(w < 0.1 for w in own) == 1
    shared, _, _ = rec.annealed_window([14.0] * 32, [0.05] * 32, 14.0, 1.0, 1e-2, shared=True)
    assert all(w < 0.1 for w in shared) and sum(shared) <= 1  # a clean window, yet all of it under the limit


@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=40), st.booleans())
def test_window_weights_lie_in_the_unit_interval(values, shared):
    weights, _, n = rec.annealed_window(values, [1.0] * len(values), values[0], 1.0, shared=shared)
    assert len(weights) == len(values) and all(0 <= w <= 1 for w in weights) and 1 <= n <= 4


def test_ewma_values():
    out = run(rec.ewma(), [10, 12, 11])
    assert [o["mean"] for o in out] == pytest.approx([10, 10.1, 10.145])
    assert [o["variance"] for o in out] == pytest.approx([1, 1.15, 1.133])
    assert out[2]["upper"] == pytest.approx(10.145 + 3 * 1.133**0.5)


def test_ewma_skips_what_is_not_finite():
    out = run(rec.ewma(min_window=1), [10, float("nan"), None, float("inf"), 10])
    assert [o["mean"] for o in out] == [10] * 5 and out[1]["z"] == 0
