"""Report metrics and dataset measurement."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.catalog import views as V
from gaugeworks.catalog.registry import query, rounded
from gaugeworks.functions import scores, variants
from gaugeworks.operators import accuracy, bleu, judge, measure, ordinals, passk, report, scoring, vectors
from gaugeworks.plans import documents

N = 20
_SPACE = "chr(10) || ' '"

_SCORED_SQL = """
scored AS (
  SELECT *, plannable AND verdict = 'Success' AS correct FROM line_samples WHERE prompt IS NOT NULL)"""
_SCORED = (V.LINE_SAMPLES_SQL, _SCORED_SQL)


def _values(report_rows):
    return rounded(report_rows, "value")


@query(
    "a01_accuracy",
    V.with_sql(*_SCORED)
    + """SELECT model, strategy, 'accuracy' AS metric, '' AS key, round(avg(CAST(correct AS DOUBLE)), 6) AS value
         FROM scored GROUP BY model, strategy""",
)
def a01(spark, sf):
    return _values(accuracy.accuracy(V.line_samples(spark, sf))).filter("metric = 'accuracy'")


@query(
    "a02_plan_accuracy",
    V.with_sql(*_SCORED)
    + """SELECT model, strategy, 'plan_accuracy' AS metric, '' AS key,
           round(avg(CAST(plannable AS DOUBLE)), 6) AS value FROM scored GROUP BY model, strategy""",
)
def a02(spark, sf):
    return _values(accuracy.accuracy(V.line_samples(spark, sf))).filter("metric = 'plan_accuracy'")


_BY_LEVEL_SQL = """
by_level AS (
  SELECT g.model, g.strategy, 'accuracy_by_level' AS metric, CAST(g.level AS VARCHAR) AS key,
         round(coalesce(avg(CAST(s.correct AS DOUBLE)), 0), 6) AS value
  FROM (SELECT DISTINCT model, strategy, level FROM scored, unnest([1, 2, 3, 4, 5, 6]) AS l(level)) g
  LEFT JOIN (SELECT * FROM scored JOIN order_tasks USING (task_file, row_idx)) s
    ON s.model = g.model AND s.strategy = g.strategy AND s.difficulty = g.level
  GROUP BY g.model, g.strategy, g.level)"""


@query("a03_accuracy_by_level", V.with_sql(*_SCORED, V.ORDER_TASKS_SQL, _BY_LEVEL_SQL) + "SELECT * FROM by_level")
def a03(spark, sf):
    return _values(accuracy.accuracy_by_level(V.line_samples(spark, sf), V.order_tasks(spark, sf)))


_BLEU_SQL = """
words AS (
  SELECT model, strategy, row_idx, correct,
         list_filter(string_split_regex(reference, '\\s+'), lambda x: x <> '') AS r,
         list_filter(string_split_regex(candidate, '\\s+'), lambda x: x <> '') AS c
  FROM bleu_pairs),
placed AS (
  SELECT row_idx, 'c' AS side, unnest(c) AS w, unnest(range(1, len(c) + 1)) AS i FROM words WHERE len(r) >= 4 AND len(c) >= 4
  UNION ALL
  SELECT row_idx, 'r', unnest(r), unnest(range(1, len(r) + 1)) FROM words WHERE len(r) >= 4 AND len(c) >= 4),
following AS (
  SELECT *, lead(w, 1) OVER line AS w2, lead(w, 2) OVER line AS w3, lead(w, 3) OVER line AS w4
  FROM placed WINDOW line AS (PARTITION BY row_idx, side ORDER BY i)),
grams AS (
  SELECT row_idx, side, 1 AS n, w AS gram FROM following
  UNION ALL SELECT row_idx, side, 2, w || ' ' || w2 FROM following WHERE w2 IS NOT NULL
  UNION ALL SELECT row_idx, side, 3, w || ' ' || w2 || ' ' || w3 FROM following WHERE w3 IS NOT NULL
  UNION ALL SELECT row_idx, side, 4, w || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM following WHERE w4 IS NOT NULL),
gram_counts AS (
  SELECT row_idx, n, gram, count(*) FILTER (side = 'c') AS in_c, count(*) FILTER (side = 'r') AS in_r
  FROM grams GROUP BY row_idx, n, gram),
matches AS (
  SELECT row_idx, n, sum(least(in_c, in_r)) AS m, sum(in_c) AS total FROM gram_counts GROUP BY row_idx, n),
precisions AS (
  SELECT row_idx, n, m,
         CASE WHEN m = 0 THEN 1.0 / (pow(2, sum(CASE WHEN m = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY row_idx ORDER BY n)) * total)
              ELSE m / total END AS p
  FROM matches),
products AS (
  SELECT row_idx, exp(sum(ln(p)) / 4) AS mean, max(CASE WHEN n = 1 THEN m END) AS unigrams FROM precisions GROUP BY row_idx),
bleu AS (
  SELECT w.*, CASE WHEN coalesce(unigrams, 0) = 0 THEN 0.0
                   ELSE mean * CASE WHEN len(c) > len(r) THEN 1 ELSE exp(1 - len(r) / len(c)) END END AS bleu
  FROM words w LEFT JOIN products USING (row_idx))"""
_DOC_BLEU = (V.DOC_PAIRS_SQL, "bleu_pairs AS (SELECT * FROM doc_pairs)", _BLEU_SQL)
_TURN_BLEU = (
    V.TURN_PAIRS_SQL,
    """bleu_pairs AS (SELECT '' AS model, '' AS strategy, conv_id * 1000 + turn AS row_idx, false AS correct,
                             reference, candidate FROM turn_pairs)""",
    _BLEU_SQL,
)


@query("a04_bleu", V.with_sql(*_DOC_BLEU) + "SELECT row_idx, round(bleu, 6) AS bleu FROM bleu")
def a04(spark, sf):
    pairs = V.doc_pairs(spark, sf).select("row_idx", "reference", "candidate")
    return rounded(bleu.bleu(pairs, ["row_idx"]), "bleu")


@query(
    "a04_bleu_turns",
    V.with_sql(*_TURN_BLEU) + "SELECT row_idx // 1000 AS conv_id, row_idx % 1000 AS turn, round(bleu, 6) AS bleu FROM bleu",
)
def a04_turns(spark, sf):
    return rounded(bleu.bleu(V.turn_pairs(spark, sf), ["conv_id", "turn"]), "bleu")


def _by_correctness_sql(metric: str, column: str, source: str) -> str:
    return f"""
      SELECT model, strategy, '{metric}' AS metric, '' AS key, round(avg({column}), 6) AS value FROM {source} GROUP BY ALL
      UNION ALL SELECT model, strategy, '{metric}', 'correct', round(coalesce(avg({column}) FILTER (correct), 0), 6)
      FROM {source} GROUP BY ALL
      UNION ALL SELECT model, strategy, '{metric}', 'incorrect', round(avg({column}) FILTER (NOT correct), 6)
      FROM {source} GROUP BY ALL"""


@query("a05_mean_bleu", V.with_sql(*_DOC_BLEU) + _by_correctness_sql("bleu", "bleu", "bleu"))
def a05(spark, sf):
    return _values(_mean_bleu(spark, sf))


def _mean_bleu(spark, sf):
    # the group goes along as a key, so that the pairs are made once
    scored = bleu.bleu(V.doc_pairs(spark, sf), ["row_idx", "model", "strategy", "correct"])
    return accuracy.mean_by_correctness(scored, [("bleu", "bleu")])


_SAMPLE_PAIRS_SQL = """
bleu_pairs AS (
  SELECT p.model, p.strategy, p.row_idx, p.correct, p.reference, x.code AS candidate
  FROM doc_pairs p JOIN extracted x ON x.doc_id = p.row_idx)"""


@query(
    "a05_sample_scores",
    V.with_sql(V.DOC_PAIRS_SQL, V.EXTRACTED_SQL, _SAMPLE_PAIRS_SQL, _BLEU_SQL)
    + f"""SELECT model, strategy, row_idx, CAST(0 AS INTEGER) AS sample_idx, round(bleu, 6) AS bleu,
            trim(reference, {_SPACE}) = trim(candidate, {_SPACE}) AS exact
          FROM bleu JOIN (SELECT row_idx, reference, candidate FROM bleu_pairs) USING (row_idx)""",
)
def a05_samples(spark, sf):
    pairs = V.doc_pairs(spark, sf)
    outputs = V.raw_outputs(spark, sf).withColumnRenamed("doc_id", "row_idx")
    first = F.lit(0).alias("sample_idx")
    rows = pairs.select("model", "strategy", F.lit("docs").alias("task_file"), "row_idx", first).join(outputs, "row_idx")
    tasks = pairs.select(F.lit("docs").alias("task_file"), "row_idx", "reference")
    return rounded(scoring.score_samples(rows, tasks), "bleu").drop("task_file")


@query(
    "a06_exact_match_rate",
    V.with_sql(V.DOC_PAIRS_SQL)
    + f"""SELECT strategy, 'exact_match' AS metric, '' AS key,
            round(avg(CASE WHEN trim(reference, {_SPACE}) = trim(candidate, {_SPACE}) THEN 1.0 ELSE 0.0 END), 6) AS value
          FROM doc_pairs GROUP BY strategy""",
)
def a06(spark, sf):
    return _values(accuracy.exact_match_rate(V.doc_pairs(spark, sf), ["strategy"]))


_SOFT_SQL = """
vecs AS (SELECT vec_id // 20 AS pair, vec_id % 2 = 0 AS is_candidate, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
sims AS (
  SELECT c.pair, c.vec_id AS c, r.vec_id AS r, list_cosine_similarity(c.v, r.v) AS s
  FROM vecs c JOIN vecs r ON r.pair = c.pair AND c.is_candidate AND NOT r.is_candidate),
sides AS (
  SELECT p.pair, p.v AS precision, r.v AS recall
  FROM (SELECT pair, avg(m) AS v FROM (SELECT pair, c, max(s) AS m FROM sims GROUP BY pair, c) GROUP BY pair) p
  JOIN (SELECT pair, avg(m) AS v FROM (SELECT pair, r, max(s) AS m FROM sims GROUP BY pair, r) GROUP BY pair) r
    USING (pair)),
soft AS (
  SELECT *, 'm' || (pair % 4) AS model, 'Standard' AS strategy, pair % 3 = 0 AS correct,
         2 * precision * recall / (precision + recall) AS f1,
         10 * precision * recall / (9 * precision + recall) AS f3 FROM sides)"""


def _soft_match(spark, sf):
    tokens = V.table(spark, sf, "embeddings").selectExpr(
        "vec_id div 20 AS pair",
        "if(vec_id % 2 = 0, 'candidate', 'reference') AS side",
        "(vec_id % 20) div 2 AS token_idx",
        "embedding",
    )
    return vectors.soft_match(tokens, ["pair"])


@query(
    "a07_soft_match",
    V.with_sql(_SOFT_SQL)
    + """SELECT pair, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
           round(f3, 6) AS f3 FROM soft""",
)
def a07(spark, sf):
    return rounded(_soft_match(spark, sf), "precision", "recall", "f1", "f3")


@query(
    "a08_mean_similarity",
    V.with_sql(_SOFT_SQL)
    + _by_correctness_sql("f1", "f1", "soft")
    + "".join(
        f""" UNION ALL SELECT model, strategy, '{c}', '', round(avg({c}), 6) FROM soft GROUP BY ALL"""
        for c in ("precision", "recall", "f3")
    ),
)
def a08(spark, sf):
    scored = _soft_match(spark, sf).selectExpr(
        "*", "concat('m', pair % 4) AS model", "'Standard' AS strategy", "pair % 3 = 0 AS correct"
    )
    split = accuracy.mean_by_correctness(scored, [("f1", "f1")])
    plain = accuracy.mean_scores(scored, ["precision", "recall", "f3"])
    return _values(split.unionByName(plain))


@query(
    "a09_estimator",
    """SELECT l_orderkey, n, c, k,
         round(CASE WHEN n - c < k THEN 1.0
                    ELSE 1 - coalesce(list_product(list_transform(range(n - c + 1, n + 1), lambda i: 1 - k / i)), 1) END, 6)
           AS value
       FROM (SELECT l_orderkey, CAST(5 + l_linenumber AS BIGINT) AS n, l_suppkey % (6 + l_linenumber) AS c,
                    1 + l_partkey % (5 + l_linenumber) AS k FROM lineitem)""",
)
def a09(spark, sf):
    drawn = V.table(spark, sf, "lineitem").selectExpr(
        "l_orderkey",
        "cast(5 + l_linenumber AS bigint) AS n",
        "l_suppkey % (6 + l_linenumber) AS c",
        "1 + l_partkey % (5 + l_linenumber) AS k",
    )
    return rounded(drawn.withColumn("value", scores.pass_at_k(F.col("n"), F.col("c"), F.col("k"))), "value")


_PASSK_SQL = f"""
firsts AS (SELECT * FROM event_samples WHERE sample_idx < {N}),
per_task AS (
  SELECT model, strategy, task_file, row_idx, count(*) FILTER (plannable AND verdict = 'Success') AS correct,
         count(*) FILTER (plannable) AS planned
  FROM firsts GROUP BY ALL HAVING count(*) = {N}),
kinds AS (
  SELECT model, strategy, 'pass@k' AS metric, correct AS c FROM per_task
  UNION ALL SELECT model, strategy, 'pass@k-plan', planned FROM per_task),
pass_at_k AS (
  SELECT model, strategy, metric, k,
         avg(CASE WHEN {N} - c < k THEN 1.0
                  ELSE 1 - coalesce(list_product(list_transform(range({N} - c + 1, {N} + 1), lambda i: 1 - k / i)), 1) END) AS value
  FROM kinds, unnest(range(1, {N} + 1)) AS t(k) GROUP BY ALL)"""


def _pass_at_k(spark, sf):
    key = ["model", "strategy", "task_file", "row_idx"]
    firsts = ordinals.first_rows(V.event_rows(spark, sf), key, ["ts", "event_id"], N)
    return passk.pass_at_k_report(firsts, N)


@query(
    "a10_pass_at_k",
    V.with_sql(V.EVENT_SAMPLES_SQL, _PASSK_SQL)
    + "SELECT model, strategy, metric, k, round(value, 6) AS value FROM pass_at_k WHERE metric = 'pass@k'",
)
def a10(spark, sf):
    return _values(_pass_at_k(spark, sf)).filter("metric = 'pass@k'")


@query(
    "a11_pass_at_k_plan",
    V.with_sql(V.EVENT_SAMPLES_SQL, _PASSK_SQL)
    + "SELECT model, strategy, metric, k, round(value, 6) AS value FROM pass_at_k WHERE metric = 'pass@k-plan'",
)
def a11(spark, sf):
    return _values(_pass_at_k(spark, sf)).filter("metric = 'pass@k-plan'")


_JUDGE_SQL = """
confusion AS (
  SELECT model, strategy, judge, count(*) AS n, count(*) FILTER (rating = 'correct') AS yes,
         count(*) FILTER (rating = 'correct' AND correct) AS tp,
         count(*) FILTER (rating = 'correct' AND NOT correct) AS fp,
         count(*) FILTER (rating = 'incorrect' AND correct) AS fn
  FROM judged GROUP BY model, strategy, judge)"""


def _judge_report(spark, sf):
    judged = judge.judged_samples(V.label_samples(spark, sf), V.judgements(spark, sf))
    return _values(judge.judge_report(judged))


@query(
    "a12_judge_accuracy",
    V.with_sql(V.JUDGED_SQL, _JUDGE_SQL)
    + "SELECT model, strategy, judge, 'llm-judge' AS metric, 'accuracy' AS key, round(yes / n, 6) AS value FROM confusion",
)
def a12(spark, sf):
    return _judge_report(spark, sf).filter("key = 'accuracy'")


@query(
    "a13_judge_precision_recall",
    V.with_sql(V.JUDGED_SQL, _JUDGE_SQL)
    + """SELECT model, strategy, judge, 'llm-judge' AS metric, 'precision' AS key,
           round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS value FROM confusion
         UNION ALL SELECT model, strategy, judge, 'llm-judge', 'recall',
           round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) FROM confusion""",
)
def a13(spark, sf):
    return _judge_report(spark, sf).filter("key <> 'accuracy'")


@query(
    "a20_counters",
    V.with_sql(*_SCORED)
    + """SELECT model, strategy, count(*) AS n_rows, count(*) FILTER (plannable) AS n_plannable,
           count(*) FILTER (correct) AS n_correct FROM scored GROUP BY model, strategy""",
)
def a20(spark, sf):
    return accuracy.counters(V.line_samples(spark, sf))


@query(
    "a21_groups_without_rows",
    V.with_sql(*_SCORED)
    + """SELECT model, strategy, task_file, row_idx, count(*) AS n_rows, count(*) FILTER (plannable) AS n_plannable,
           count(*) FILTER (correct) AS n_correct FROM scored GROUP BY ALL""",
)
def a21(spark, sf):
    return accuracy.counters(V.line_samples(spark, sf), ["model", "strategy", "task_file", "row_idx"])


# -- report assembly -------------------------------------------------------------------------


@query(
    "j02_report_enrichment",
    V.with_sql(V.EVENT_SAMPLES_SQL, _PASSK_SQL, *_SCORED)
    + """SELECT model, strategy, metric, CAST(k AS VARCHAR) AS key, round(value, 6) AS value FROM pass_at_k
         UNION ALL
         SELECT g.model, g.strategy, 'accuracy', '', round(avg(CAST(s.correct AS DOUBLE)), 6)
         FROM (SELECT DISTINCT model, strategy FROM pass_at_k) g
         LEFT JOIN scored s ON s.model = g.model AND s.strategy = g.strategy GROUP BY g.model, g.strategy""",
)
def j02(spark, sf):
    pass_rows = passk.as_report(_pass_at_k(spark, sf))
    return _values(report.enrich(pass_rows, accuracy.accuracy(V.line_samples(spark, sf))))


_REPORT_SQL = """
report AS (
  SELECT * FROM by_level
  UNION ALL SELECT model, strategy, 'accuracy', '', round(avg(CAST(correct AS DOUBLE)), 6) FROM scored GROUP BY ALL
  UNION ALL SELECT model, strategy, 'plan_accuracy', '', round(avg(CAST(plannable AS DOUBLE)), 6) FROM scored GROUP BY ALL)"""
_REPORT = (*_SCORED, V.ORDER_TASKS_SQL, _BY_LEVEL_SQL, _REPORT_SQL)


_FULL_REPORT_SQL = (
    V.with_sql(*_REPORT, V.EVENT_SAMPLES_SQL, _PASSK_SQL, *_DOC_BLEU, V.JUDGED_SQL, _JUDGE_SQL, _SOFT_SQL)
    + "SELECT * FROM report UNION ALL "
    + "SELECT model, strategy, metric, CAST(k AS VARCHAR) AS key, round(value, 6) AS value FROM pass_at_k UNION ALL "
    + _by_correctness_sql("bleu", "bleu", "bleu")
    + " UNION ALL "
    + _by_correctness_sql("f1", "f1", "soft")
    + """ UNION ALL SELECT model, strategy, 'llm-judge', judge || ' accuracy', round(yes / n, 6) FROM confusion
          UNION ALL SELECT model, strategy, 'llm-judge', judge || ' precision',
            round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) FROM confusion
          UNION ALL SELECT model, strategy, 'llm-judge', judge || ' recall',
            round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) FROM confusion"""
)


@query("s08_full_report", _FULL_REPORT_SQL)
def s08_full(spark, sf):
    """Every metric family in one report."""
    judged = judge.judge_report(judge.judged_samples(V.label_samples(spark, sf), V.judgements(spark, sf)))
    soft = _soft_match(spark, sf).selectExpr(
        "*", "concat('m', pair % 4) AS model", "'Standard' AS strategy", "pair % 3 = 0 AS correct"
    )
    families = [
        report_rows(spark, sf),
        passk.as_report(_pass_at_k(spark, sf)),
        _mean_bleu(spark, sf),
        accuracy.mean_by_correctness(soft, [("f1", "f1")]),
        judged.withColumn("key", F.concat_ws(" ", "judge", "key")),
    ]
    return _values(report.assemble(*families))


def report_rows(spark, sf):
    rows, tasks = V.line_samples(spark, sf), V.order_tasks(spark, sf)
    return _values(report.assemble(accuracy.accuracy(rows), accuracy.accuracy_by_level(rows, tasks)))


@query(
    "w06_sorted_report",
    V.with_sql(*_REPORT) + "SELECT * FROM report ORDER BY model, strategy, metric, key",
)
def w06(spark, sf):
    return report.sorted_report(report_rows(spark, sf))


REPORT_PATHS_SQL = (
    V.with_sql(*_REPORT)
    + """SELECT model || '.' || strategy || '.' || metric || CASE WHEN key = '' THEN '' ELSE '.' || key END AS path, value
         FROM report"""
)


def json_leaves(json):
    """Path and number of every leaf of a JSON report."""
    found = json.select(F.explode(variants.leaves(F.parse_json("json"))).alias("leaf"))
    number = F.try_variant_get(F.col("leaf.value"), "$", "double")
    return rounded(found.select(F.col("leaf.path").alias("path"), number.alias("value")), "value")


@query("s08_nested_report", REPORT_PATHS_SQL)
def s08(spark, sf):
    return json_leaves(report.nested_json(report_rows(spark, sf)))


# -- dataset measurement ---------------------------------------------------------------------

_MEASURED_SQL = """
linked AS (
  SELECT plan_id, CAST(sum((parent IS NOT NULL)::INT + (source IS NOT NULL)::INT) AS BIGINT) AS interconnections,
         string_agg(type, ', ' ORDER BY pos) AS resources
  FROM resources GROUP BY plan_id),
sized AS (
  SELECT doc_id AS row_idx,
         CAST(len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '\\S'))) AS BIGINT) AS loc,
         CAST(len(string_split(text, 'the')) - 1 AS BIGINT) AS n_resources
  FROM documents),
measured AS (
  SELECT row_idx, loc, loc + 2 AS policy_loc, n_resources, interconnections, resources,
         CAST(CASE WHEN loc < 10 AND n_resources < 2 AND interconnections < 2 THEN 1
              WHEN loc < 20 AND n_resources < 4 AND interconnections < 4 THEN 2
              WHEN loc < 40 AND n_resources < 6 AND interconnections < 6 THEN 3
              WHEN loc < 60 AND n_resources < 8 AND interconnections < 8 THEN 4
              WHEN loc < 80 AND n_resources < 10 AND interconnections < 10 THEN 5 ELSE 6 END AS INTEGER) AS difficulty
  FROM sized JOIN linked ON plan_id = row_idx)"""
_MEASURED = (V.RESOURCES_SQL, _MEASURED_SQL)


def _measured(spark, sf):
    tasks = V.documents(spark, sf, "doc_id", "source", "lang", "text").selectExpr(
        "doc_id AS row_idx", "source AS prompt", "text AS reference",
        "concat(source, '\\n\\n', lang, '\\n', text) AS policy",
    )
    return measure.measure_tasks(tasks, V.document_plans(spark, sf), ["row_idx"], needle="the")


@query(
    "a15_measure_tasks",
    V.with_sql(*_MEASURED)
    + "SELECT row_idx, loc, policy_loc, n_resources, interconnections, difficulty, resources FROM measured",
)
def a15(spark, sf):
    return _measured(spark, sf).drop("resource_types")


@query(
    "a16_level_histogram",
    V.with_sql(*_MEASURED)
    + """SELECT 'level-' || l AS level, count(difficulty) AS n_tasks
         FROM unnest([1, 2, 3, 4, 5, 6]) AS t(l) LEFT JOIN measured ON difficulty = l GROUP BY l""",
)
def a16(spark, sf):
    return measure.level_histogram(_measured(spark, sf))


def _types(spark, sf):
    plans = V.plans(spark, sf)
    typed = plans.select(documents.resource_types(F.col("doc")).alias("resource_types"))
    return measure.type_histogram(typed)


@query(
    "a17_type_histogram",
    V.with_sql(V.RESOURCES_SQL) + "SELECT type, count(*) AS n_resources FROM resources GROUP BY type",
)
def a17(spark, sf):
    return _types(spark, sf)


@query(
    "a18_family_histogram",
    V.with_sql(V.RESOURCES_SQL)
    + """SELECT CASE type WHEN 'aws_subnet' THEN 'aws_vpc' WHEN 'aws_s3_bucket' THEN 'aws_s3' WHEN 'aws_iam_role' THEN 'aws_iam'
           WHEN 'aws_instance' THEN 'aws_ec2' WHEN 'aws_lb' THEN 'aws_elb' WHEN 'aws_db_instance' THEN 'aws_rds'
           WHEN 'aws_lambda_function' THEN 'aws_lambda' WHEN 'aws_sns_topic' THEN 'aws_sns'
           WHEN 'aws_neptune_cluster' THEN 'aws_neptune' ELSE type END AS family,
           count(*) AS n_resources FROM resources GROUP BY 1""",
)
def a18(spark, sf):
    return measure.family_histogram(_types(spark, sf))


_MEASURES = ["policy_loc", "loc", "n_resources", "interconnections"]


@query(
    "a19_distribution",
    V.with_sql(*_MEASURED)
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS measure, CAST(min({c}) AS DOUBLE) AS min, round(quantile_cont({c}, 0.25), 6) AS q1,
              round(quantile_cont({c}, 0.5), 6) AS median, round(quantile_cont({c}, 0.75), 6) AS q3,
              CAST(max({c}) AS DOUBLE) AS max, round(avg({c}), 6) AS mean FROM measured"""
        for c in _MEASURES
    ),
)
def a19(spark, sf):
    return rounded(measure.distribution(_measured(spark, sf), _MEASURES), "q1", "median", "q3", "mean")


@query(
    "u03_custom_thresholds",
    """SELECT doc_id, CAST(CASE WHEN n_chars < 500 THEN 1 WHEN n_chars < 1500 THEN 2 ELSE 3 END AS INTEGER) AS level
       FROM documents""",
)
def u03(spark, sf):
    level = scores.difficulty_level(F.col("n_chars"), F.lit(0), F.lit(0), [(500, 1, 1), (1500, 1, 1)])
    return V.table(spark, sf, "documents").select("doc_id", level.alias("level"))


@query(
    "u03_custom_families",
    V.with_sql(V.RESOURCES_SQL)
    + """SELECT CASE WHEN contains(type, 'cluster') OR contains(type, 'instance') THEN 'compute'
           WHEN contains(type, 'aws_') THEN 'other' ELSE type END AS family, count(*) AS n_resources
         FROM resources GROUP BY 1""",
)
def u03_families(spark, sf):
    rules = [("compute", ["cluster", "instance"]), ("other", ["aws_"])]
    return measure.family_histogram(_types(spark, sf), rules)
