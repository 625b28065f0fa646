"""Schemas (as DDL), keys and levels of the tables the operators consume and produce."""

from __future__ import annotations

TASKS = (
    "task_file string, row_idx bigint, prompt string, reference string, policy string, "
    "difficulty int, resources array<string>"
)
SAMPLES = (
    "model string, strategy string, task_file string, row_idx bigint, sample_idx int, "
    "output string, plannable boolean, verdict string, plan_error string, "
    "policy_error string, notes string"
)
JUDGEMENTS = (
    "model string, strategy string, task_file string, row_idx bigint, sample_idx int, "
    "judge string, judge_run int, judge_output string, judge_verdict string"
)
REPORT = ["model", "strategy", "metric", "key", "value"]
RESOURCE = (
    "address string, mode string, type string, name string, "
    "attributes variant, depends_on array<string>"
)
CHUNKS = "doc_id string, chunk_idx int, text string, embedding array<float>"

TASK_KEY = ["task_file", "row_idx"]
SAMPLE_KEY = ["model", "strategy", "task_file", "row_idx", "sample_idx"]
GROUP = ["model", "strategy"]
LEVELS = [1, 2, 3, 4, 5, 6]
