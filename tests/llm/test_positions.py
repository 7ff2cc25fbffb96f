"""Previous smaller positions of suffix order against a stack, in orders that rise and then fall too."""

import numpy as np
import pytest

from folio.llm import suffix


def stacked(order, shared):
    out, held = [], []
    for own, least in zip(order.tolist(), shared.tolist()):
        while held and held[-1][0] > own:
            least = min(least, held.pop()[1])
        out.append(least if held else 0)
        held.append((own, least))
    return out


@pytest.mark.parametrize("jumps", [0, 1, 12])
@pytest.mark.parametrize("n", [1, 2, 17, 300, 3_000])
def test_smaller_positions_equal_a_stack(monkeypatch, jumps, n):
    monkeypatch.setattr(suffix, "JUMPS", jumps)
    draw = np.random.default_rng(n)
    for order in (draw.permutation(n), np.arange(n), np.arange(n)[::-1], np.concatenate([np.arange(0, n, 2), np.arange(1, n, 2)[::-1]])):
        shared = draw.integers(0, 300, n)
        assert suffix._smaller_before(order, shared).tolist() == stacked(order, shared)


def test_steps_grow_with_levels_only():
    steps = []
    for n in (1 << 12, 1 << 16):
        order = np.concatenate([np.arange(0, n, 2), np.arange(1, n, 2)[::-1]])
        before, least = np.arange(-1, n - 1), np.ones(n, dtype=np.int64)
        steps.append(suffix._climb(order, least, before, least.copy(), np.arange(1, n)))
    assert steps[1] <= 2 * suffix.FAN * 5 and steps[1] < 2 * steps[0] + suffix.FAN
