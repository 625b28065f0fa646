"""Ranges of neighbouring documents by id, without a sort of the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GROUPS = 32  # quantiles are looked up in groups: GROUPS squared of them at most


def id_range(docs: DataFrame, rows: int, key: str = "doc_id") -> Column:
    """Number of the id range of a row, of ``rows`` rows on average.

    Ranges lie between quantiles of the ids, so a far id or a gap widens one range and leaves the
    others as they are; beyond GROUPS squared ranges each part between two quantiles is cut into
    equal widths. Equal ids share a range. Ranges ascend with the id; NULL ids are in range -1.
    Needs one pass over the ids alone, of which each task returns a sketch.
    """
    id_ = F.col(key).cast("long")
    count = docs.agg(F.count(id_)).first()[0]
    if not count:
        return F.lit(-1).cast("long")
    ranges = -(-count // rows)
    parts = min(ranges, GROUPS * GROUPS)
    shares = [i / parts for i in range(parts + 1)]
    found = docs.agg(F.percentile_approx(id_, shares, 20_000), F.min(id_), F.max(id_)).first()
    bounds = sorted({found[1], *found[0][1:-1]})  # a part begins at its bound
    widths = [(b - a) / (ranges / parts) for a, b in zip(bounds, [*bounds[1:], found[2] + 1])]
    cuts = max(1, -(-ranges // parts))
    groups = [list(range(at, min(at + GROUPS, len(bounds)))) for at in range(0, len(bounds), GROUPS)]
    value = id_.cast("double")

    def literal(values: list, kind: str) -> Column:
        return F.lit(values).cast(f"array<{kind}>")

    heads = literal([bounds[g[0]] for g in groups], "bigint")
    group = F.size(F.filter(heads, lambda b: b <= id_))
    own = F.element_at(F.array(*[literal([bounds[i] for i in g], "bigint") for g in groups]), group)
    part = (group - 1) * GROUPS + F.size(F.filter(own, lambda b: b <= id_))
    if cuts == 1:
        place = (part - 1).cast("long")
    else:
        low = F.element_at(literal([float(b) for b in bounds], "double"), part)
        width = F.element_at(literal([max(1.0, w) for w in widths], "double"), part)
        place = (part - 1) * cuts + F.least(F.floor((value - low) / width), F.lit(cuts - 1))
    return F.coalesce(F.when(id_.isNotNull(), place), F.lit(-1)).cast("long")
