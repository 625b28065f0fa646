"""Wide evaluated tables to long ones and back, and sample completeness."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions import text

# The six columns of a sample in a wide table, before the sample number.
SAMPLE_COLUMNS = {
    "output": "LLM Output #",
    "plannable": "LLM Plannable? #",
    "verdict": "LLM Correct? #",
    "plan_error": "LLM Plan Phase Error #",
    "policy_error": "LLM OPA match phase Error #",
    "notes": "LLM Notes #",
}
# The two columns of a judge run.
JUDGE_OUTPUT = "{judge} Judge Output #{run} for LLM output #{sample}"
JUDGE_VERDICT = "{judge} Judge verdict #{run} for LLM output #{sample}"


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def sample_numbers(columns: Sequence[str]) -> list[str]:
    """The sample numbers a wide header holds, in column order.

    A table put together from several runs repeats numbers; their columns were renamed on
    reading, so that ``0.1`` is a further sample next to ``0``.
    """
    prefix = SAMPLE_COLUMNS["output"]
    suffixes = [c[len(prefix):] for c in columns if c.startswith(prefix)]
    return [s for s in suffixes if re.fullmatch(r"\d+(\.\d+)*", s)]


def to_long(wide: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One row per sample from a wide table; ``keep`` are the columns to repeat.

    ``sample_idx`` is the position of the sample's columns, booleans are read leniently, and
    empty texts (missing cells) become NULL. A sample is there if any of its six cells is set: an
    empty output with a verdict is a sample, columns that another task needed are none.
    """
    present = set(wide.columns)
    structs = []
    for position, number in enumerate(sample_numbers(wide.columns)):
        fields = [F.lit(position).alias("sample_idx")]
        cells = []
        for name, prefix in SAMPLE_COLUMNS.items():
            column = f"{prefix}{number}"
            cell = F.col(_quoted(column)).cast("string") if column in present else F.lit(None).cast("string")
            cell = F.nullif(cell, F.lit(""))
            cells.append(cell)
            fields.append((text.lenient_true(cell) if name == "plannable" else cell).alias(name))
        structs.append(F.when(F.coalesce(*cells).isNotNull(), F.struct(*fields)))
    if not structs:
        raise ValueError("the table has no sample columns")
    present = F.filter(F.array(*structs), lambda s: s.isNotNull())
    return wide.select(*[F.col(_quoted(k)) for k in keep], F.inline(present))


def sample_width(samples: DataFrame) -> int:
    """How many samples a wide table needs columns for."""
    return (samples.agg(F.max("sample_idx").alias("last")).first()["last"] or 0) + 1


def to_wide(samples: DataFrame, key: Sequence[str], n: int | None = None) -> DataFrame:
    """Six columns per sample, for n samples or for as many as there are.

    The cells are combined map-side, one value each. A sample beyond n is an error, and so is a
    repeated one.
    """
    n = sample_width(samples) if n is None else n
    index = F.col("sample_idx")
    outside = F.raise_error(F.concat(F.lit(f"sample not in 0..{n - 1}: "), index.cast("string"))).cast("int")
    placed = F.when(index.between(0, n - 1), index.cast("int")).otherwise(outside)
    cells, once = [], []
    for number in range(n):
        here = F.col("_place") == number
        once.append(F.count_if(here) <= 1)
        cells += [F.max(F.when(here, F.col(name))).alias(f"{prefix}{number}") for name, prefix in SAMPLE_COLUMNS.items()]
    wide = samples.withColumn("_place", placed).groupBy(*key).agg(*cells, reduce(and_, once).alias("_once"))
    repeated = F.raise_error(F.concat(F.lit("repeated sample: "), F.to_json(F.struct(*key)))).cast("boolean")
    # in a filter, so that no later column pruning removes it
    return wide.filter(F.when(F.col("_once"), True).otherwise(repeated)).drop("_once")


def add_empty_samples(wide: DataFrame, first: int, n: int) -> DataFrame:
    """Append empty columns for the samples ``first .. n-1`` of a table about to be evaluated."""
    return wide.withColumns(
        {f"{prefix}{i}": F.lit("") for i in range(first, n) for prefix in SAMPLE_COLUMNS.values()}
    )


def add_empty_judgements(wide: DataFrame, judge: str, runs: int, sample: int = 0) -> DataFrame:
    names = [
        pattern.format(judge=judge, run=run, sample=sample)
        for run in range(runs)
        for pattern in (JUDGE_OUTPUT, JUDGE_VERDICT)
    ]
    return wide.withColumns({name: F.lit("") for name in names})


def judge_runs(columns: Sequence[str]) -> list[tuple[str, int, int]]:
    """(judge, run, sample) of the judge outputs that a wide header holds, in column order."""
    escaped = re.escape(JUDGE_OUTPUT.format(judge="@judge", run="@run", sample="@sample"))
    pattern = escaped.replace("@judge", "(.+)").replace("@run", r"(\d+)").replace("@sample", r"(\d+)")
    found = [re.fullmatch(pattern, c, re.DOTALL) for c in columns]
    return [(m[1], int(m[2]), int(m[3])) for m in found if m]


def judgements_to_long(
    wide: DataFrame,
    keep: Sequence[str],
    judge: str | None = None,
    runs: int | None = None,
    sample: int | None = None,
) -> DataFrame:
    """One row per judge run from the judge columns of a wide table.

    Judges, runs and samples are read off the header; given ones restrict them. A run without a
    verdict column has NULL verdicts. A header without judges gives no rows.
    """
    found = [
        (j, r, s)
        for j, r, s in judge_runs(wide.columns)
        if (judge is None or j == judge) and (runs is None or r < runs) and (sample is None or s == sample)
    ]
    entry = "struct<sample_idx:int,judge:string,judge_run:int,judge_output:string,judge_verdict:string>"

    def cell(pattern: str, j: str, r: int, s: int):
        name = pattern.format(judge=j, run=r, sample=s)
        if name not in wide.columns:
            return F.lit(None).cast("string")
        return F.nullif(F.col(_quoted(name)).cast("string"), F.lit(""))

    structs = [
        F.struct(
            F.lit(s).alias("sample_idx"),
            F.lit(j).alias("judge"),
            F.lit(r).alias("judge_run"),
            cell(JUDGE_OUTPUT, j, r, s).alias("judge_output"),
            cell(JUDGE_VERDICT, j, r, s).alias("judge_verdict"),
        )
        for j, r, s in found
    ]
    return wide.select(*[F.col(_quoted(k)) for k in keep], F.inline(F.array(*structs).cast(f"array<{entry}>")))


def complete_samples(samples: DataFrame, file: Sequence[str] = ("task_file",)) -> DataFrame:
    """Samples of which the first row of the file has a verdict; the others were interrupted."""
    complete = samples.filter((F.col("row_idx") == 0) & F.col("verdict").isNotNull())
    return samples.join(complete.select(*file, "sample_idx").distinct(), [*file, "sample_idx"], "left_semi")


def sample_counts(samples: DataFrame, file: Sequence[str] = ("task_file",)) -> DataFrame:
    """How many samples each file holds (distinct pairs are combined before the shuffle)."""
    return samples.select(*file, "sample_idx").distinct().groupBy(*file).agg(F.count("*").alias("n_samples"))
