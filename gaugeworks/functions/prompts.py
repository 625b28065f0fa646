"""Prompt assembly from columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prompt texts; each {} is filled with a column.
PLAIN_PROMPT = "Here is the actual prompt: {}"
CONTEXT_PROMPT = """
Here is some additional knowledge/context retrieved from Terraform documentation, that may (or may not) potentially help you answer the question:
{}

Here is the actual prompt to answer:
{}
    """
PLAN_ERROR_PROMPT = """
Here is the original prompt:
{}

Here is the incorrect configuration:
{}

Here is the Terraform plan error message (potentially empty):
{}
"""
POLICY_ERROR_PROMPT = """
Here is the original prompt:
{}

Here is the incorrect configuration:
{}

Here is the Rego OPA policy associated with this configuration:
{}

Here is the Rego OPA policy error message:
{}
"""
JUDGE_SINGLE_PROMPT = """
Please act as an impartial judge and evaluate the correctness of the code provided by an AI assistant to the user question displayed below. Begin your evaluation by providing a short explanation. Be as objective as possible. After providing your explanation, please rate the response as either correct or incorrect by strictly following this format: "Rating: Correct" or "Rating: Incorrect".

[Question] 
{}

[The Start of Assistant’s Answer]
{}
[The End of Assistant’s Answer]
"""
JUDGE_REFERENCE_PROMPT = """
Please act as an impartial judge and evaluate the correctness of the code provided by an AI assistant to the user question displayed below. You will be given a reference answer, and the assistant's answer. Your job is to evaluate if the assistant's answer is correct or incorrect, in comparison to the reference answer. Begin your evaluation by comparing the assistant's answer with the reference answer. Identify and correct any mistakes. Avoid any position biases and ensure that the order in which the responses were presented does not influence your decision. Do not allow the length of the responses to influence your evaluation. Be as objective as possible. After providing your explanation, output your final verdict by strictly following this format: "Rating: Correct" or "Rating: Incorrect".

[User Question]
{}

[The Start of Reference Answer]
{}
[The End of Reference Answer]

[The Start of Assistant’s Answer]
{}
[The End of Assistant’s Answer]
"""

STRATEGIES = ["Standard", "COT", "FSP", "multi-turn", "RAG"]
CONTEXTS_PER_PROMPT = 4


def fill(template: str, *slots: Column) -> Column:
    """Put one column into each ``{}`` of the template; NULL if any of them is NULL."""
    texts = template.split("{}")
    if len(texts) != len(slots) + 1:
        raise ValueError(f"template has {len(texts) - 1} slots, {len(slots)} columns given")
    pieces = [F.lit(texts[0])]
    for slot, text in zip(slots, texts[1:]):
        pieces += [slot, F.lit(text)]
    return F.concat(*pieces)


def enhance_prompt(
    prompt: Column, strategy: Column, context: Column, cot_examples: str, fsp_examples: str
) -> Column:
    """The prompt as its strategy sends it.

    ``context`` is used by RAG rows (see :func:`join_contexts`); the example texts that precede
    the question for COT and FSP are user data.
    """
    return (
        F.when(strategy == "RAG", fill(CONTEXT_PROMPT, context, prompt))
        .when(strategy == "COT", F.concat(F.lit(cot_examples), prompt))
        .when(strategy == "FSP", F.concat(F.lit(fsp_examples), prompt))
        .otherwise(fill(PLAIN_PROMPT, prompt))
    )


def join_contexts(contexts: Column, limit: int = CONTEXTS_PER_PROMPT) -> Column:
    """The first contexts of a prompt as one numbered text."""
    numbered = F.transform(
        F.slice(contexts, 1, limit),
        lambda text, i: F.concat(F.lit("Context "), i.cast("string"), F.lit(": \n"), text),
    )
    return F.array_join(numbered, "")


def follow_up_prompt(
    prompt: Column,
    code: Column,
    policy: Column,
    plannable: Column,
    verdict: Column,
    plan_error: Column,
    policy_error: Column,
) -> Column:
    """Second-turn prompt: plan error, else policy violation, else the prompt unchanged.

    What is not known to be plannable is not; a missing text fills its slot with nothing.
    """
    code, policy, plan_error, policy_error = (
        F.coalesce(slot, F.lit("")) for slot in (code, policy, plan_error, policy_error)
    )
    return (
        F.when(~F.coalesce(plannable, F.lit(False)), fill(PLAN_ERROR_PROMPT, prompt, code, plan_error))
        .when(verdict == "Failure", fill(POLICY_ERROR_PROMPT, prompt, code, policy, policy_error))
        .otherwise(prompt)
    )


def judge_prompt(
    metric: str, prompt: Column, candidate: Column, reference: Column | None = None
) -> Column:
    """The judge request for ``llm-single`` or ``llm-reference``."""
    if metric == "llm-single":
        return fill(JUDGE_SINGLE_PROMPT, prompt, candidate)
    if metric == "llm-reference":
        if reference is None:
            raise ValueError("llm-reference needs a reference column")
        return fill(JUDGE_REFERENCE_PROMPT, prompt, reference, candidate)
    raise ValueError(f"unknown judge metric: {metric}")
