"""Scalar plans: memory, number of partitions, sizes of layered graphs."""

from __future__ import annotations

import math
from dataclasses import dataclass

#: The safety factor of memory plans, the largest training sample, bytes in a gigabyte.
SLACK = 1.15
MAX_SAMPLE = 1 << 23
GB = 1 << 30


def estimate_memory(n: int, dim: int, degree: int, element_bytes: int) -> int:
    """Bytes that building a graph of n vectors takes: vectors, the larger of work graph and vectors, and ten words a row."""
    vectors = n * dim * element_bytes
    return vectors + max(4 * n * degree * 4, vectors) + 10 * n * 4


def plan_partitions(n: int, dim: int, degree: int, budget_gb: float, duplication: float, element_bytes: int) -> tuple[int, int]:
    """(number of partitions, largest partition) for a budget; one of n rows if everything fits.

    The budget may be a fraction of a gigabyte.
    """
    need, budget = SLACK * estimate_memory(n, dim, degree, element_bytes), budget_gb * GB
    if budget <= 0:
        raise ValueError("the budget must be positive")
    if budget > need:
        return 1, n
    return math.floor((duplication * need - 1) / budget) + 1, math.floor(n * budget / need)


def sampling_rate(n: int, rate: float) -> float:
    """The training sample's rate, so that it stays under the largest sample."""
    return min(rate, MAX_SAMPLE / n) if n else rate


@dataclass(frozen=True)
class LayerPlan:
    """growth, and per layer from the bottom: rows, first row, first translation."""

    growth: int
    sizes: tuple[int, ...]
    offsets: tuple[int, ...]
    translation_offsets: tuple[int, ...]

    @property
    def rows(self) -> int:
        return sum(self.sizes)

    @property
    def translations(self) -> int:
        return sum(self.sizes[1:])


def layer_plan(n: int, layers: int, segment: int, k_build: int) -> LayerPlan:
    """Layers of a hierarchical graph over n rows whose top is about one segment.

    The growth is the (layers - 1)-th root of n / segment, rounded down if the
    top comes nearer to a segment so, or would be under k_build rows else.
    """
    if layers < 2 or n < segment:
        return LayerPlan(1, (n,), (0,), (0,))
    root = (n / segment) ** (1 / (layers - 1))
    down = max(1, math.floor(root))
    top_down, top_up = (n / g ** (layers - 1) for g in (down, down + 1))
    growth = down if top_up < k_build or abs(top_down - segment) < abs(top_up - segment) else down + 1
    sizes = [n]
    for level in range(1, layers):
        sizes.append(segment * growth ** (layers - 1 - level))
    offsets = [sum(sizes[:k]) for k in range(layers)]
    return LayerPlan(growth, tuple(sizes), tuple(offsets), tuple(max(0, sum(sizes[1:k])) for k in range(layers)))


def align8(size: int) -> int:
    return -(-size // 8) * 8


def layered_index_size(plan: LayerPlan, k_build: int) -> int:
    """Bytes of a layered index file: neighbours, two translations and two floats of statistics, each aligned."""
    return align8(4 * plan.rows * k_build) + 2 * align8(4 * plan.translations) + align8(2 * 4)
