"""One function per analysis, over DataFrames of files (file_id, path, language, code).

``ANALYSES`` is the registry by name (R.1); every function takes a DataFrame and returns one, so the same call
serves one file or all of them.  Null code gives neutral values in per-file results and no rows in findings.
"""

from __future__ import annotations

import ast
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.functions import pycode as P
from quillmark.functions import scores as S
from quillmark.functions.normalize import language
from quillmark.functions.text import grade
from quillmark.operators import clones as C
from quillmark.operators.rule_scan import scan_lines, severity_counts
from quillmark.operators.structure import FUNCTIONS, ISSUES, METRICS, PATHS, functions_of, issues_of, metrics_of, paths_of, per_source, quality_of
from quillmark.operators.text_metrics import files


def security(df: DataFrame) -> DataFrame:
    """Findings of the line rules and of the syntax rules; per line and type the line rule counts.  A Python source that does
    not parse has none."""
    broken = per_source(df.where(F.col("language") == "python"), "parses boolean", lambda c: [] if P.parse(c) else [(False,)])
    lines = scan_lines(df).join(broken, "file_id", "left_anti").select("file_id", "lineno", "vuln_type", "severity", "confidence", "cwe")
    tree = issues(df).where("analyzer = 'security'").select("file_id", F.col("line").alias("lineno"), F.col("kind").alias("vuln_type"), "severity", "confidence", F.lit(None).cast("string").alias("cwe"))
    return lines.unionByName(tree.join(lines.select("file_id", "lineno", "vuln_type"), ["file_id", "lineno", "vuln_type"], "left_anti"))


def issues(df: DataFrame) -> DataFrame:
    return per_source(df.where(F.col("language") == "python"), ISSUES, issues_of)


def _only(name: str):
    def run(df: DataFrame) -> DataFrame:
        return issues(df).where(F.col("analyzer") == name).drop("analyzer")

    run.__name__ = name
    run.__doc__ = f"Findings of the {name} analyzer."
    return run


refactoring, dead_code, performance, dependencies = (_only(n) for n in ("refactoring", "dead_code", "performance", "dependencies"))


_COST = {"unreachable_code": 5, "unused_function": 10, "unused_variable": 5, "unused_import": 2, "empty_except": 15}
FACTS = METRICS + ", dead_lines long, dead_minutes long, tree_critical long, tree_high long, tree_medium long, readability double"


def _facts_of(code: str) -> list[tuple]:
    found = issues_of(code)
    dead = [r for r in found if r[0] == "dead_code"]
    sec = [r[2] for r in found if r[0] == "security"]
    quality = quality_of(code)
    tail = (sum(r[4] - r[3] + 1 for r in dead if r[1] == "unreachable_code"), sum(_COST.get(r[1], 0) for r in dead), *(sec.count(k) for k in ("critical", "high", "medium")), quality[0][8] if quality else None)
    return [metrics_of(code)[0] + tail]


def facts(df: DataFrame) -> DataFrame:
    """Everything that one parse of a file gives: metrics, quality score and grade, dead code, security counts,
    readability.  The per-file analyses below take it, so that a report parses each file once."""
    m = per_source(df, FACTS, _facts_of)
    q = S.quality_score({"cc": F.col("cyclomatic"), "cog": F.col("cognitive"), "n_long": F.col("n_long"), "n_complex": F.col("n_complex"), "over_80": F.lit(0), "bugs": F.col("bugs")})
    p = S.defect_probability({"cog": F.col("cognitive"), "cc": F.col("cyclomatic"), "bugs": F.col("bugs"), "n_complex": F.col("n_complex"), "n_long": F.col("n_long"), "sloc": F.col("sloc"), "over_80": F.lit(0)})
    return m.withColumns({"score": F.round(q, 4), "grade": grade(F.round(q, 4)), "probability": p})


def complexity(df: DataFrame) -> DataFrame:
    """Metrics, quality score and grade of each file."""
    return facts(df).drop("dead_lines", "dead_minutes", "tree_critical", "tree_high", "tree_medium", "readability", "probability")


def bugs(df: DataFrame) -> DataFrame:
    """Heuristic defect probability and its confidence."""
    return facts(df).select("file_id", "probability", F.round(S.entropy_confidence(F.col("probability")), 5).alias("confidence"))


def patterns(df: DataFrame) -> DataFrame:
    """anti_pattern, code_smell, style_violation or clean by the functions' smells."""
    f = functions(df).select("file_id", "cyclomatic", F.explode_outer("smells").alias("smell"))
    g = f.groupBy("file_id").agg(F.max("cyclomatic").alias("cc"), F.count("smell").alias("n"))
    return g.select("file_id", F.when((F.col("cc") > 20) & (F.col("n") > 0), "anti_pattern").when(F.col("n") >= 2, "code_smell").when(F.col("n") == 1, "style_violation").otherwise("clean").alias("label"))


def functions(df: DataFrame) -> DataFrame:
    return per_source(df.where(F.col("language") == "python"), FUNCTIONS, functions_of)


def function_risk(df: DataFrame) -> DataFrame:
    """Risk of each function and its share of the file's risk by cognitive complexity."""
    r = 0.10 + S.bands(F.col("cognitive"), [(30, 0.55), (20, 0.40), (12, 0.25), (6, 0.12)], 0.0) + S.bands(F.col("cyclomatic"), [(15, 0.15), (8, 0.08)], 0.0)
    r = r + S.bands(F.col("n_lines"), [(100, 0.08), (50, 0.04)], 0.0) + S.bands(F.col("n_params"), [(6, 0.06), (4, 0.03)], 0.0)
    f = functions(df).withColumn("risk", S.clamp(r, 0.0, 1.0)).withColumn("w", F.greatest("cognitive", F.lit(1)))
    total = f.groupBy("file_id").agg(F.sum("w").alias("tw"))
    return f.join(total, "file_id").select("file_id", "name", "start_line", F.round("risk", 4).alias("risk"), F.round(F.col("risk") * F.col("w") / F.col("tw"), 6).alias("attributed"))


def clones(df: DataFrame) -> DataFrame:
    return C.clone_classes(C.blocks(df))


def documentation(df: DataFrame) -> DataFrame:
    """Documentation and readability measures (docs and readability in one parse)."""
    return per_source(df.where(F.col("language") == "python"), "doc_coverage double, doc_quality double, doc_overall double, doc_grade string, naming double, comments double, structure double, load double, readability double, hints array<string>", quality_of)


def taint(df: DataFrame) -> DataFrame:
    """Paths of untrusted values to sinks."""
    return per_source(df.where(F.col("language") == "python"), PATHS, paths_of)


def _with_rules(df: DataFrame) -> DataFrame:
    """Facts with the counts of the line rules added to those of the syntax rules, and the minutes of debt."""
    r = severity_counts(scan_lines(df)).select("file_id", *(F.col(k).alias(f"rule_{k}") for k in ("critical", "high", "medium", "low")))
    x = facts(df).join(r, "file_id", "left").fillna(0, [f"rule_{k}" for k in ("critical", "high", "medium", "low")])
    x = x.withColumns({k: F.col(f"rule_{k}") + F.col(f"tree_{k}") for k in ("critical", "high", "medium")})
    return x.withColumns(
        {
            "debt_security": 240 * F.col("critical") + 120 * F.col("high") + 30 * F.col("medium"),
            "debt_maintainability": 20 * F.col("n_complex") + 30 * F.col("n_long"),
            "debt_reliability": F.when(F.col("probability") >= 0.7, 120).when(F.col("probability") >= 0.4, 60).when(F.col("probability") >= 0.2, 30).otherwise(0),
            "debt_dead_code": F.col("dead_minutes"),
        }
    )


_DEBTS = ["debt_security", "debt_maintainability", "debt_reliability", "debt_dead_code"]


def debt(df: DataFrame) -> DataFrame:
    """Minutes per category from findings and metrics, their sum and worst rating."""
    x = _with_rules(df).select("file_id", *_DEBTS)
    return x.withColumn("total", sum((F.col(p) for p in _DEBTS), F.lit(0))).withColumn("rating", F.greatest(*(S.rating(F.col(p)) for p in _DEBTS)))


def quick(df: DataFrame) -> DataFrame:
    """H.28: rule counts, metrics and readability of each file; readability is null where the file does not parse."""
    x = _with_rules(df)
    return x.select("file_id", "cyclomatic", "sloc", (F.col("n_complex") + F.col("n_long")).alias("n_bad_functions"), "critical", "high", "medium", F.col("rule_low").alias("low"), "readability")


def analyze(df: DataFrame) -> DataFrame:
    """Overall score (weights .25 complexity, .30 security, .15 clones, .15 bugs, .05 dead code, .10 debt) and status.

    Parts are left-joined on file_id with neutral defaults, so a part without rows never drops a file.
    """
    k = clones(df).groupBy("file_id").agg(F.avg(((F.col("exact_links") > 0) | (F.col("renamed_links") > 0)).cast("double")).alias("clone_rate"))
    x = _with_rules(df).join(k, "file_id", "left").fillna({"clone_rate": 0.0})
    x = x.withColumn("rating", F.greatest(*(S.rating(F.col(p)) for p in _DEBTS)))
    at_least = lambda e: F.greatest(F.lit(0), e)
    sec = at_least(100 - 20 * F.col("critical") - 10 * F.col("high") - 4 * F.col("medium"))
    clone, dead = at_least(100 - F.floor(F.col("clone_rate") * 120)), at_least(100 - F.floor(150 * F.col("dead_lines") / F.greatest("sloc", F.lit(1))))
    debts = F.when(F.col("rating") == "A", 100).when(F.col("rating") == "B", 80).when(F.col("rating") == "C", 60).when(F.col("rating") == "D", 40).otherwise(20)
    score = F.floor(0.25 * F.col("score") + 0.30 * sec + 0.15 * clone + 0.15 * F.floor((1 - F.col("probability")) * 100) + 0.05 * dead + 0.10 * debts)
    bad = F.col("rating").isin("D", "E")
    status = F.when(F.col("critical") > 0, "critical").when((F.col("high") > 0) | (F.col("score") < 60) | bad | (F.col("probability") > 0.7), "action_required").otherwise("clean")
    return x.select(
        "file_id", F.col("score").alias("complexity"), "critical", "high", "medium", F.col("rule_low").alias("low"), "clone_rate", "probability", "dead_lines", "rating",
        (F.col("critical") + F.col("high") + F.col("medium") + F.col("rule_low")).alias("n_findings"), at_least(F.least(F.lit(100), score)).cast("long").alias("score"), status.alias("status"),
    )


def batch(df: DataFrame) -> DataFrame:
    """Totals over the reports of many files; zeros where there is none."""
    r = analyze(df)
    return r.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.round(F.avg("score"), 2), F.lit(0.0)).alias("avg_score"), F.coalesce(F.min("score"), F.lit(0)).alias("min_score"), F.coalesce(F.max("score"), F.lit(0)).alias("max_score"), F.coalesce(F.sum("n_findings"), F.lit(0)).alias("findings"), F.count_if((F.col("score") < 40) | (F.col("status") == "critical")).alias("critical_files"))


def explain(df: DataFrame) -> DataFrame:
    """H.29: of each file which limits its metrics exceed."""
    limits = {"cyclomatic": 15, "cognitive": 20, "n_long": 5, "depth": 4}
    hits = F.filter(F.array(*(F.when(F.col(n) > v, F.lit(n)) for n, v in limits.items())), lambda x: x.isNotNull())
    return complexity(df).select("file_id", hits.alias("drivers"))


def node_types(df: DataFrame) -> DataFrame:
    """Counts of node types, the input of the sequence model for code."""
    rows = per_source(df.where(F.col("language") == "python"), "node string", lambda c: [(type(x).__name__,) for x in ast.walk(t)] if (t := P.parse(c)) else [])
    return rows.groupBy("file_id", "node").agg(F.count(F.lit(1)).alias("n"))


ANALYSES = {
    "analyze": analyze, "quick": quick, "batch": batch, "security": security, "complexity": complexity, "patterns": patterns, "bugs": bugs, "clones": clones, "refactoring": refactoring, "dead-code": dead_code,
    "debt": debt, "docs": documentation, "readability": documentation, "performance": performance, "dependencies": dependencies, "function-risk": function_risk, "taint": taint, "explain": explain, "grammar": node_types,
}


def _query(name: str):
    def run(spark, sf_dir):
        f = files(spark, sf_dir)
        f = f.withColumn("language", language(F.col("language"), F.col("path"))).where("code is not null")
        return ANALYSES[name](f)

    return run


QUERIES = {f"api_{re.sub('-', '_', n)}": _query(n) for n in ("analyze", "quick", "batch", "security", "patterns", "debt", "function-risk", "explain")}
