"""Score expressions: the unbiased pass@k estimator and the difficulty level."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (lines, resources, interconnections) a level must stay below, all three at once.
DIFFICULTY_LIMITS = [(10, 2, 2), (20, 4, 4), (40, 6, 6), (60, 8, 8), (80, 10, 10)]


def pass_at_k(n: Column, c: Column, k: Column) -> Column:
    """Probability that k draws out of n samples, c of them correct, hold a correct one."""
    product = F.aggregate(
        F.sequence(n - c + 1, n), F.lit(1.0), lambda acc, i: acc * (1 - k / i)
    )
    # c = 0 first: sequence(n + 1, n) would count down
    return F.when(n - c < k, F.lit(1.0)).when(c == 0, F.lit(0.0)).otherwise(1 - product)


def difficulty_level(
    lines: Column,
    resources: Column,
    interconnections: Column,
    limits: Sequence[tuple[int, int, int]] = DIFFICULTY_LIMITS,
) -> Column:
    """Level 1 for the easiest; NULL if a measure is missing."""
    known = lines.isNotNull() & resources.isNotNull() & interconnections.isNotNull()
    chain = F.when(~known, F.lit(None).cast("int"))
    for level, (below_lines, below_resources, below_links) in enumerate(limits, start=1):
        fits = (
            (lines < below_lines)
            & (resources < below_resources)
            & (interconnections < below_links)
        )
        chain = chain.when(fits, F.lit(level))
    return chain.otherwise(F.lit(len(limits) + 1))

