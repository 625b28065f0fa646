"""Text expressions: code extraction, cleanup, counts and judge ratings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Opening fences in the order they are tried.
CODE_DELIMITERS = ["```hcl", "```json", "```HCL", "```Terraform", "```terraform", "```"]

# The characters a Unicode-aware strip or split treats as whitespace.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)
# The characters that end a line when a text is split into lines.
LINE_BREAKS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85  "

# File extensions recognised in a quoted file name.
FILE_EXTENSIONS = ["html", "js", "txt", "csv", "zip", "py", "pub", "yml", "yaml"]

# Terminal escape sequences and runs outside ASCII.
ANSI_ESCAPE = r"\x1B[@-_][0-?]*[ -/]*[@-~]"
NON_ASCII = r"[^\x00-\x7F]+"

# The plan-error messages, in the order they are tested.
PLAN_ERRORS = [
    ("lock_file", "Inconsistent dependency lock file"),
    ("missing_archive", "archive missing file: "),
    ("missing_file", "no file exists at"),
]

_FENCE = "```"


def _not_whitespace() -> str:
    """The inside of a character class of everything but WHITESPACE, printable ASCII first.

    Splitting on its complement settles most characters with the first range, which a class that
    lists the whitespace cannot.
    """
    codes = sorted(map(ord, WHITESPACE))
    ranges = [(a + 1, b - 1) for a, b in zip([-1, *codes], [*codes, 0x110000]) if a + 1 < b]
    ranges.sort(key=lambda r: not r[0] <= ord("a") <= r[1])
    return "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in ranges)


WHITESPACE_RUN = f"[^{_not_whitespace()}]+"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def _before_last_fence(text: Column) -> Column:
    tail = F.substring_index(text, _FENCE, -1)
    kept = F.length(text) - F.length(tail) - len(_FENCE)
    return F.when(F.contains(text, F.lit(_FENCE)), F.substring(text, F.lit(1), kept)).otherwise(text)


def _split_at(text: Column, delimiter: str) -> Column:
    """``struct(answer, code)`` for one delimiter; the code is empty where it does not occur."""
    parts = F.split(text, rf"\Q{delimiter}\E", 3)
    code = F.coalesce(strip(_before_last_fence(strip(F.get(parts, F.lit(1))))), F.lit(""))
    return F.struct(strip(F.get(parts, F.lit(0))).alias("answer"), code.alias("code"))


def extract_code(text: Column, delimiters: Sequence[str] = CODE_DELIMITERS) -> Column:
    """``struct(answer, code)``: the first delimiter in order that yields code, else no code.

    A NULL text yields NULL answer and empty code.
    """
    tried = [_split_at(text, d) for d in delimiters]
    # get(filter(array(x), ..), 0) evaluates x once and only when the earlier delimiters failed
    hits = [F.get(F.filter(F.array(t), lambda s: s["code"] != ""), F.lit(0)) for t in tried]
    return F.coalesce(*hits, tried[-1])


def remove_unwanted_characters(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, ANSI_ESCAPE, ""), NON_ASCII, "")


def nonblank_lines(text: Column) -> Column:
    r"""Lines, split on ``\n``, that are not all whitespace."""
    return F.regexp_count(text, F.lit(rf"[^{WHITESPACE}][^\n]*")).cast("bigint")


def occurrences(text: Column, needle: str) -> Column:
    """Non-overlapping, case-sensitive substring count."""
    removed = F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))
    return F.floor(removed / F.lit(len(needle))).cast("bigint")


def quoted_filename(line: Column, extensions: Sequence[str] = FILE_EXTENSIONS) -> Column:
    """First double-quoted name with one of the extensions, else NULL."""
    pattern = rf'"([^"]+\.(?:{"|".join(extensions)}))"'
    return F.nullif(F.regexp_extract(line, pattern, 1), F.lit(""))


def quoted_filenames(text: Column, extensions: Sequence[str] = FILE_EXTENSIONS) -> Column:
    """The quoted file name of every line that has one, in line order."""
    return F.array_compact(F.transform(F.split(text, "\n"), lambda x: quoted_filename(x, extensions)))


def classify_plan_error(message: Column) -> Column:
    chain = F.when(message.isNull(), F.lit(None).cast("string"))
    for name, needle in PLAN_ERRORS:
        chain = chain.when(F.contains(message, F.lit(needle)), F.lit(name))
    return chain.otherwise(F.lit("other"))


def last_line(text: Column) -> Column:
    """The last line of a judge answer (one trailing line break is ignored); NULL when empty."""
    trimmed = F.regexp_replace(text, rf"(?:\r\n|[{LINE_BREAKS}])\z", "")
    unified = F.translate(trimmed, LINE_BREAKS, "\n" * len(LINE_BREAKS))
    return F.when(text != "", F.substring_index(unified, "\n", -1))


def _rating_in(line: Column) -> Column:
    return F.when(F.contains(line, F.lit("Incorrect")), F.lit("incorrect")).when(
        F.contains(line, F.lit("Correct")), F.lit("correct")
    )


def classify_verdict(verdict: Column) -> Column:
    """``incorrect``, ``correct`` or ``edge`` (missing, or naming neither)."""
    return F.coalesce(_rating_in(verdict), F.lit("edge"))


def rescue_rating(judge_output: Column) -> Column:
    """Rating named by the first line of the judge output that states one, else ``unrated``."""
    stated = F.filter(
        F.split(judge_output, "\n"), lambda x: x.rlike("Rating: (Incorrect|Correct)")
    )
    return F.coalesce(_rating_in(F.get(stated, F.lit(0))), F.lit("unrated"))


def final_rating(verdict: Column, judge_output: Column) -> Column:
    """The verdict's rating, with edge cases looked up in the judge output."""
    return F.when(classify_verdict(verdict) == "edge", rescue_rating(judge_output)).otherwise(
        classify_verdict(verdict)
    )


def exact_match(reference: Column, candidate: Column) -> Column:
    return strip(reference) == strip(candidate)


def tokens(text: Column) -> Column:
    """Whitespace tokens, none of them empty."""
    stripped = strip(text)
    return F.when(stripped == "", F.array().cast("array<string>")).otherwise(
        F.split(stripped, WHITESPACE_RUN)
    )


def lenient_true(flag: Column) -> Column:
    """A boolean, or the texts ``True`` / ``TRUE``; anything else, and NULL, is false."""
    return F.coalesce(flag.cast("string").isin("true", "True", "TRUE"), F.lit(False))


def question_lines(response: Column) -> Column:
    """One question per line of a generated response."""
    return F.split(response, "\n")
