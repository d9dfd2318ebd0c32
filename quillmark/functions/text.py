"""Line and token expressions over a source string; null in, null out.

Lines end at ``\\n``; an empty last line is dropped.  Token classes are ASCII.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lines(source: Column) -> Column:
    """The lines of a text; an empty text has none."""
    parts = F.split(source, "\n")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def nonblank(source: Column) -> Column:
    return F.filter(lines(source), lambda x: x.rlike(r"\S"))


def mean_of(values: Column) -> Column:
    """Mean of an array of numbers; null for an empty one."""
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double")), F.size(values))


def strip_comments(source: Column) -> Column:
    """Each line cut at its first ``#`` (also inside strings), right-trimmed, blank lines dropped."""
    cut = F.transform(lines(source), lambda x: F.rtrim(F.split_part(x, F.lit("#"), F.lit(1))))
    return F.array_join(F.filter(cut, lambda x: x != ""), "\n")


def squeeze(text: Column) -> Column:
    """White space runs to one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " "))


def sub_tokens(name: Column) -> Column:
    """snake_case and camelCase parts of an identifier, in lower case; empty parts dropped."""
    broken = F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1_$2")
    return F.filter(F.split(F.lower(broken), "_"), lambda x: x != "")


def grade(score: Column) -> Column:
    """A from 90, B from 75, C from 60, D from 45, else F; null for null."""
    return (
        F.when(score.isNull(), None).when(score >= 90, "A").when(score >= 75, "B").when(score >= 60, "C").when(score >= 45, "D").otherwise("F")
    )


def maintainability(volume: Column, cyclomatic: Column, sloc: Column) -> Column:
    """Maintainability index on 0..100; 100 where there is no volume or no code line."""
    raw = (F.lit(171.0) - 5.2 * F.ln(volume) - 0.23 * cyclomatic - 16.2 * F.ln(sloc)) * 100 / 171
    return F.when((volume <= 0) | (sloc <= 0), F.lit(100.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)))


# Operator and keyword tokens of the C-like Halstead approximation.
HALSTEAD_OPERATORS = r"[+\-*/%=<>!&|^~?:]+|\b(?:if|else|for|while|do|switch|case|return|break|continue|new|try|catch|throw|func|def|class)\b"
HALSTEAD_OPERANDS = r"\b[A-Za-z_][A-Za-z0-9_]*\b|\b[0-9]+(?:\.[0-9]+)?\b"


def halstead(source: Column) -> dict[str, Column]:
    """n1, n2, big_n1, big_n2 by regular expressions (an approximation for languages without tokenizer)."""
    ops = F.regexp_extract_all(source, F.lit(HALSTEAD_OPERATORS), F.lit(0))
    args = F.regexp_extract_all(source, F.lit(HALSTEAD_OPERANDS), F.lit(0))
    return {"n1": F.size(F.array_distinct(ops)), "n2": F.size(F.array_distinct(args)), "big_n1": F.size(ops), "big_n2": F.size(args)}


EXTENSIONS = {
    "py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "java": "java", "go": "go", "rs": "rust",
    "rb": "ruby", "php": "php", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "hpp": "cpp", "cs": "csharp", "kt": "kotlin", "swift": "swift",
}


def detect_language(path: Column, hint: Column) -> Column:
    """Language of a path's extension, else the hint."""
    table = F.create_map(*(F.lit(x) for pair in EXTENSIONS.items() for x in pair))
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.coalesce(F.try_element_at(table, ext), hint)
