import pytest
from pyspark.sql import functions as F

from gaugeworks.functions import prompts, text


def apply(spark, function, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r["x"] for r in rows.select("i", function(F.col("t")).alias("x")).orderBy("i").collect()]


EXTRACTION = [
    ("hi ```hcl\nA\n``` bye", "hi", "A"),
    ("no code", "no code", ""),
    ("```\nB\n```", "", "B"),
    ("x ```terraform\nT\n``` y", "x", "T"),
    ("a ```hcl\n``` b", "a", "hcl"),
    ("a ```yaml\nQ\n``` z", "a", "yaml\nQ"),
    ("a ```hcl X ``` m ```hcl Y ```", "a", "X"),
    ("p ```json\nJ\n```\n```hcl\nH\n```", "p ```json\nJ\n```", "H"),
    ("unterminated ```hcl\nZ", "unterminated", "Z"),
    (None, None, ""),
]


def test_extract_code(spark):
    got = apply(spark, text.extract_code, [case[0] for case in EXTRACTION])
    assert [(x["answer"], x["code"]) for x in got] == [case[1:] for case in EXTRACTION]


def test_extract_code_agrees_with_plain_python(spark):
    def plain(value):
        answer, code = value.strip(), ""
        for fence in text.CODE_DELIMITERS:
            parts = value.split(fence)
            if len(parts) < 2:
                answer, code = value.strip(), ""
                continue
            answer, code = parts[0].strip(), parts[1].strip().rsplit("```", 1)[0].strip()
            if code:
                break
        return answer, code

    pieces = ["a", "```", "```hcl", "\n", " \xa0", "```json ", "````", "é", ""]
    cases = ["".join(pieces[(i // 9**k) % 9] for k in range(4)) for i in range(0, 9**4, 7)]
    got = apply(spark, text.extract_code, cases)
    assert [(x["answer"], x["code"]) for x in got] == [plain(c) for c in cases]


def test_cleanup(spark):
    raw = ["\x1b[31mred\x1b[0m", "café ✓ ok", None, "\x1bMxy"]
    assert apply(spark, text.remove_unwanted_characters, raw) == ["red", "caf  ok", None, "y"]


def test_counts(spark):
    assert apply(spark, text.nonblank_lines, ["a\n\n b\n", "   ", "", "a", "　\n\x1c\nx", None]) == [2, 0, 0, 1, 1, None]
    count = lambda c: text.occurrences(c, "resource")
    assert apply(spark, count, ["resourcesource resource", "", "Resource"]) == [2, 0, 0]


def test_whitespace_is_that_of_a_unicode_strip(spark):
    assert set(text.WHITESPACE) == {chr(i) for i in range(0x3001) if chr(i).isspace()}
    assert apply(spark, text.tokens, [" a b\x1fc ", "", " \n"]) == [["a", "b", "c"], [], []]


def test_file_names_and_errors(spark):
    lines = ['x "a.html" "b.js"\nno\n"dir/c.zip"', '"x.tf"', None]
    assert apply(spark, text.quoted_filenames, lines) == [["a.html", "dir/c.zip"], [], None]
    errors = ["Inconsistent dependency lock file", 'archive missing file: "x"', "no file exists at x", "?", None]
    assert apply(spark, text.classify_plan_error, errors) == ["lock_file", "missing_archive", "missing_file", "other", None]


def test_last_line(spark):
    cases = ["a\nb", "a\nb\n", "a\r\nb\r\n", "a\n\n", "one", "", "x y", None]
    want = [c.splitlines()[-1] if c else None for c in cases]
    assert apply(spark, text.last_line, cases) == want


def test_ratings(spark):
    verdicts = ["Rating: Incorrect", "Rating: Correct", "?", None]
    assert apply(spark, text.classify_verdict, verdicts) == ["incorrect", "correct", "edge", "edge"]
    outputs = ["a\nRating: Correct\nRating: Incorrect", "Rating: Correct, not Incorrect", "Correct", None]
    assert apply(spark, text.rescue_rating, outputs) == ["correct", "incorrect", "unrated", "unrated"]


def test_exact_match_and_lenient_flag(spark):
    assert apply(spark, lambda c: text.exact_match(c, F.lit("a b")), [" a b\n", "a  b", None]) == [True, False, None]
    assert apply(spark, text.lenient_true, ["True", "TRUE", "true", "False", "yes", None]) == [True] * 3 + [False] * 3


def test_prompts(spark):
    def one(column):
        return spark.range(1).select(column.alias("x")).first()["x"]

    q = F.lit("Q {} %s")
    assert one(prompts.fill("a {} b", q)) == "a Q {} %s b"
    with pytest.raises(ValueError):
        prompts.fill("{} {}", q)
    made = {
        s: one(prompts.enhance_prompt(q, F.lit(s), F.lit("ctx"), "C:", "F:")) for s in prompts.STRATEGIES
    }
    assert made["COT"] == "C:Q {} %s" and made["FSP"] == "F:Q {} %s"
    assert made["Standard"] == made["multi-turn"] == "Here is the actual prompt: Q {} %s"
    assert made["RAG"] == prompts.CONTEXT_PROMPT.format("ctx", "Q {} %s")
    contexts = F.array(*[F.lit(c) for c in "abcde"])
    assert one(prompts.join_contexts(contexts)) == "".join(f"Context {i}: \n{c}" for i, c in enumerate("abcd"))
    with pytest.raises(ValueError):
        prompts.judge_prompt("other", q, q)
    with pytest.raises(ValueError):
        prompts.judge_prompt("llm-reference", q, q)
