"""When to contract, how far, and how thinly to sample, as functions of the subproblem's size.

n: nodes, m: edges, level: recursion depth, memory: nodes that the base case holds.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

Size = Callable[[int, int, int, int], int]


@dataclass(frozen=True)
class Policy:
    contract: Callable[[int, int, int, int], bool]
    nodes_to_contract: Size
    sample_power: Size


def _density_power(n: int, m: int, level: int, memory: int) -> int:
    return max(1, math.floor(math.log2(m / n))) if n and m else 1


def _by_threshold(threshold: Callable[[int, int], int]) -> Policy:
    """Contracts sparse graphs only: while edges per node stay below a threshold, down to edges / threshold nodes."""
    return Policy(
        contract=lambda n, m, level, memory: n > 0 and m // n < threshold(n, memory),
        nodes_to_contract=lambda n, m, level, memory: max(0, n - m // threshold(n, memory)),
        sample_power=_density_power,
    )


def _shrinking(most: int, slope: float) -> Callable[[int, int], int]:
    """A threshold of ``most`` while much of the graph fits in memory, towards 2 as it outgrows it."""
    return lambda n, memory: min(most, int(2.0 * (1.0 + slope * memory / n))) if n else most


def _halving(from_level: int, power: int) -> Policy:
    return Policy(
        contract=lambda n, m, level, memory: level >= from_level,
        nodes_to_contract=lambda n, m, level, memory: n // 2,
        sample_power=lambda n, m, level, memory: power,
    )


#: 0: always contract and halve. 1-5: not at the top level, sampling ever thinner. 6, 7: by fixed density.
#: 8, 9: by a density that adapts to memory.
POLICIES: list[Policy] = [
    _halving(0, 1),
    *[_halving(1, power) for power in range(1, 6)],
    _by_threshold(lambda n, memory: 4),
    _by_threshold(lambda n, memory: 8),
    _by_threshold(_shrinking(4, 2.0)),
    _by_threshold(_shrinking(8, 6.0)),
]


def bundle_count(max_id: int, memory_bytes: int, variant: int, node_bytes: int = 32, block_bytes: int = 1 << 20) -> int:
    """Id-range bundles between what memory needs and what its buffers bear; variants 0 to 3 go from few to many."""
    least = max(1, math.ceil(node_bytes * max_id / max(1, memory_bytes)))
    most = max(least, memory_bytes // 2 // block_bytes)
    return least + (most - least) * variant // 3
