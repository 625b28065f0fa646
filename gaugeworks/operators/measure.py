"""Measuring a task dataset: size, resources, interconnections and difficulty."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions import scores, text
from gaugeworks.operators.samples import with_prompt
from gaugeworks.plans import documents
from gaugeworks.schemas import LEVELS, TASK_KEY
from gaugeworks.session import checkpointed

# Resource families, in the order their needles are looked for in a type name.
RESOURCE_FAMILIES = [
    ("aws_lightsail", ["aws_lightsail"]),
    ("aws_s3", ["aws_s3", "aws_glacier"]),
    ("aws_sns", ["aws_sns"]),
    ("aws_iam", ["aws_iam"]),
    ("aws_ec2", ["aws_instance", "aws_ec2", "aws_ami", "aws_launch_template", "aws_placement_group", "aws_key_pair"]),
    ("aws_elb", ["aws_lb", "aws_elb"]),
    (
        "aws_vpc",
        [
            "aws_vpc",
            "aws_subnet",
            "aws_eip",
            "aws_egress_only_internet_gateway",
            "aws_default_network_acl",
            "aws_internet_gateway",
            "aws_route_table",
            "aws_network_acl",
            "aws_vpc_peering_connection",
            "aws_nat_gateway",
        ],
    ),
    ("aws_rds", ["aws_db", "aws_rds_cluster"]),
    ("aws_security_group", ["aws_security_group"]),
    ("aws_cognito", ["aws_cognito"]),
    ("aws_secretsmanager", ["aws_secretsmanager"]),
    ("aws_backup", ["aws_backup"]),
    ("aws_dynamodb", ["aws_dynamodb", "aws_dax"]),
    ("aws_kms", ["aws_kms"]),
    ("aws_efs", ["aws_efs"]),
    ("aws_msk", ["aws_msk"]),
    ("aws_cloudwatch", ["aws_cloudwatch"]),
    ("aws_kinesis", ["aws_kinesis"]),
    ("aws_autoscaling_group", ["aws_autoscaling_group"]),
    ("aws_elasticache", ["aws_elasticache"]),
    ("aws_redshift", ["aws_redshift"]),
    ("aws_lambda", ["aws_lambda"]),
    ("aws_sagemaker", ["aws_sagemaker"]),
    ("aws_eks", ["aws_eks"]),
    ("aws_codebuild", ["aws_codebuild"]),
    ("aws_api_gateway", ["aws_api_gateway"]),
    ("aws_cloudfront", ["aws_cloudfront"]),
    ("aws_route53", ["aws_route53"]),
    ("aws_lex", ["aws_lex"]),
    ("aws_connect", ["aws_connect"]),
    ("aws_elasticsearch", ["aws_elasticsearch", "aws_opensearch"]),
    ("aws_kendra", ["aws_kendra"]),
    ("aws_elastic_beanstalk", ["aws_elastic_beanstalk"]),
    ("aws_sqs", ["aws_sqs"]),
    ("aws_neptune", ["aws_neptune"]),
    ("aws_chime", ["aws_chime"]),
]


def resource_family(type_: Column, rules: Sequence[tuple[str, Sequence[str]]] = RESOURCE_FAMILIES) -> Column:
    """The first family one of whose needles the type contains, else the type itself."""
    chain = F.when(type_.isNull(), F.lit(None).cast("string"))
    for family, needles in rules:
        for needle in needles:
            chain = chain.when(F.contains(type_, F.lit(needle)), F.lit(family))
    return chain.otherwise(type_)


def measure_tasks(
    tasks: DataFrame, plans: DataFrame, key: Sequence[str] = tuple(TASK_KEY), needle: str = "resource"
) -> DataFrame:
    """One row per task with a prompt and a plan: the measures, the level and the resource types.

    The plan is reduced to its counts before the join, so no document is shuffled. ``needle`` is
    the word whose occurrences in the reference count as resources.
    """
    doc = F.col("doc")
    walked = plans.select(
        *key,
        documents.interconnections(doc).alias("interconnections"),
        documents.resource_types(doc).alias("resource_types"),
    )
    sized = with_prompt(tasks).select(
        *key,
        text.nonblank_lines(F.col("reference")).alias("loc"),
        text.nonblank_lines(F.col("policy")).alias("policy_loc"),
        text.occurrences(F.col("reference"), needle).alias("n_resources"),
    )
    level = scores.difficulty_level(F.col("loc"), F.col("n_resources"), F.col("interconnections"))
    return (
        sized.join(walked, list(key))
        .withColumn("difficulty", level)
        .withColumn("resources", documents.type_list(F.col("resource_types")))
    )


def level_histogram(
    measured: DataFrame, level: str = "difficulty", levels: Sequence[int] = tuple(LEVELS)
) -> DataFrame:
    """Tasks per level, zeros kept."""
    counts = measured.agg(*[F.count_if(F.col(level) == n).alias(f"level-{n}") for n in levels])
    rows = [F.struct(F.lit(f"level-{n}").alias("level"), F.col(f"level-{n}").alias("n_tasks")) for n in levels]
    return counts.select(F.inline(F.array(*rows)))


def type_histogram(measured: DataFrame, types: str = "resource_types") -> DataFrame:
    """Occurrences of each resource type, repeats within a task included."""
    # an inner explode would add a filter on the column, evaluating the walk that made it once more
    exploded = measured.select(F.explode_outer(types).alias("type")).filter(F.col("type").isNotNull())
    return exploded.groupBy("type").agg(F.count("*").alias("n_resources"))


def family_histogram(types: DataFrame, rules: Sequence[tuple[str, Sequence[str]]] = RESOURCE_FAMILIES) -> DataFrame:
    """Type counts summed by family."""
    return types.groupBy(resource_family(F.col("type"), rules).alias("family")).agg(
        F.sum("n_resources").alias("n_resources")
    )


POINTS = (0.0, 0.25, 0.5, 0.75, 1.0)
HELD_VALUES = 4096  # distinct values of a range that are read instead of being divided further
PIVOTS = 63


def _ranks(n: int) -> list[tuple[int, float]]:
    """For each point the rank, from 0, of the value below it, and its distance from there."""
    places = [p * (n - 1) for p in POINTS]
    return [(int(place), place - int(place)) for place in places]


def values_at_ranks(
    counted: DataFrame, wanted: dict[str, list[int]], held: int = HELD_VALUES, distinct: dict[str, int] | None = None
) -> dict[tuple[str, int], float]:
    """The values at ranks (from 0) of each measure of a stored table (measure, value, weight).

    Around each rank a range of values is narrowed: values found by approximate quantiles divide
    it, and the exact weights between them tell which part holds the rank. Only these counts, and
    in the end at most ``held`` values of a range, reach the driver; no task orders all values.
    ``distinct``, the number of values of each measure, saves the first count.
    """
    spark = counted.sparkSession
    low, high = float("-inf"), float("inf")
    # (measure, lowest, highest value of the range, weight below it) -> its ranks
    open_ = {(m, low, high, 0): sorted(set(ranks)) for m, ranks in wanted.items() if ranks}
    found: dict[tuple[str, int], float] = {}
    points = F.array(*[F.lit((i + 1) / (PIVOTS + 1)) for i in range(PIVOTS)])
    while open_:
        schema = "measure string, low double, high double, below long"
        ranges = spark.createDataFrame(list(open_), schema)
        # ranges of a measure never overlap, so a value is in one of them
        inside = counted.join(ranges, "measure").where("value >= low AND value <= high")
        of = ["measure", "low", "high", "below"]
        if distinct is not None and max(distinct.values()) <= held:
            small, large = list(open_), []
        else:
            sizes = inside.groupBy(*of).agg(
                F.count("*").alias("n"), F.percentile_approx("value", points, F.lit(1000)).alias("pivots")
            )
            small, large = [], []
            for r in sizes.collect():
                small.append(tuple(r)[:4]) if r.n <= held else large.append(r)
        if small:
            few = spark.createDataFrame(small, schema)
            rows = counted.join(few, "measure").where("value >= low AND value <= high").select(*of, "value", "weight").collect()
            by_range: dict[tuple, list[tuple[float, int]]] = {}
            for r in rows:
                by_range.setdefault(tuple(r)[:4], []).append((r.value, r.weight))
            for name, values in by_range.items():
                values.sort()
                ends = list(accumulate((w for _, w in values), initial=name[3]))[1:]
                for rank in open_[name]:
                    found[name[0], rank] = values[bisect_right(ends, rank)][0]
        narrowed: dict[tuple, list[int]] = {}
        if large:
            cuts = spark.createDataFrame(
                [(*tuple(r)[:4], sorted(set(r.pivots))) for r in large], schema + ", cuts array<double>"
            )
            # part 2i + 1 is the i-th cut itself, part 2i what lies before it
            smaller = F.size(F.filter("cuts", lambda c: c < F.col("value")))
            part = 2 * smaller + F.exists("cuts", lambda c: c == F.col("value")).cast("int")
            parts = (
                counted.join(cuts, "measure").where("value >= low AND value <= high")
                .groupBy(*of, part.alias("part"))
                .agg(F.sum("weight").alias("weight"), F.min("value").alias("first"), F.max("value").alias("last"))
            )
            by_range = {}
            for r in sorted(parts.collect(), key=lambda r: r.part):
                by_range.setdefault(tuple(r)[:4], []).append(r)
            for name, rows in by_range.items():
                below = name[3]
                for r in rows:
                    ranks = [x for x in open_[name] if below <= x < below + r.weight]
                    if ranks and r["first"] == r["last"]:
                        found |= {(name[0], x): r["first"] for x in ranks}
                    elif ranks:
                        narrowed[name[0], r["first"], r["last"], below] = ranks
                    below += r.weight
        open_ = narrowed
    return found


def distribution(measured: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """Minimum, quartiles, maximum and mean of each column, one row per column.

    Exact quantiles interpolate linearly between the values at two ranks, which are found by
    counts; ``approximate`` spares the passes over the counted values.
    """
    # NaN is no value
    value = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias("value") for c in columns}
    rows = [F.struct(F.lit(c).alias("measure"), value[c]) for c in columns]
    long = measured.select(F.inline(F.array(*rows)))
    names = ["min", "q1", "median", "q3", "max"]
    if approximate:
        points = F.array(*[F.lit(p) for p in POINTS])
        summary = long.groupBy("measure").agg(
            F.percentile_approx("value", points, F.lit(10000)).alias("q"), F.avg("value").alias("mean")
        )
        return summary.select("measure", *[F.col("q")[i].alias(name) for i, name in enumerate(names)], "mean")
    counted = checkpointed(long.groupBy("measure", "value").agg(F.count("*").alias("weight")), "distribution")
    known = F.when(F.col("value").isNotNull(), F.col("weight"))
    summary = counted.groupBy("measure").agg(
        F.coalesce(F.sum(known), F.lit(0)).alias("n"),
        (F.sum(F.col("value") * known) / F.sum(known)).alias("mean"),
        F.count("value").alias("distinct"),
    )
    sums = {r.measure: r for r in summary.collect()}
    wanted = {m: [x for rank, rest in _ranks(r.n) for x in (rank, rank + (rest > 0))] for m, r in sums.items() if r.n}
    at = values_at_ranks(counted.where("value IS NOT NULL"), wanted, distinct={m: r["distinct"] for m, r in sums.items()})

    def point(measure: str, rank: int, rest: float) -> float:
        value = at[measure, rank]
        return value + rest * (at[measure, rank + 1] - value) if rest else value

    out = []
    for m, r in sums.items():
        quantiles = [point(m, *place) for place in _ranks(r.n)] if r.n else [None] * len(POINTS)
        out.append((m, *quantiles, r["mean"]))
    schema = ", ".join(["measure string", *(f"{name} double" for name in (*names, "mean"))])
    return measured.sparkSession.createDataFrame(out, schema)
