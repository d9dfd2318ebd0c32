"""Rule scanners: source lines against literal patterns, findings out.

Each language's rules become one array expression of literal ``rlike`` tests, so patterns compile once and
no line is joined with a rule table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmark.functions import rules as R
from quillmark.functions import text as T
from quillmark.functions.normalize import language
from quillmark.operators.clones import diff_lines
from quillmark.operators.skew import places
from quillmark.operators.text_metrics import SQL_LINES, c8_suppressions, files
from quillmark.sources.tables import table

def _text(s: str) -> str:
    """A Spark SQL string literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _hit(cond: str, ord_: int, vuln: str, severity: str, confidence: float, cwe: str) -> str:
    s = f"named_struct('rule_ord', {ord_}, 'vuln_type', {_text(vuln)}, 'severity', {_text(severity)}, 'confidence', {confidence}D, 'cwe', {_text(cwe)})"
    return f"CASE WHEN {cond} THEN {s} END"


def _hits(items: list[str]) -> str:
    return f"filter(array({', '.join(items)}), x -> x IS NOT NULL)"


_SECRET = "(" + " OR ".join(f"line RLIKE {_text(p)}" for p, _ in R.SECRETS) + ")"


def line_hits(lang: str) -> str:
    """SQL of the findings of the column ``line`` in a language of BY_LANGUAGE; comment lines give none but secrets.

    The expression is SQL text because building hundreds of columns one by one costs more than the scan.
    """
    items = [_hit(f"code_line AND line RLIKE {_text(p)}", i, v, sev, c, cwe) for i, (p, v, sev, c, cwe) in enumerate(R.BY_LANGUAGE[lang])]
    return _hits([*items, _hit(_SECRET, 100, "hardcoded_credential", "high", 0.75, "CWE-798")])


def python_line_hits() -> str:
    """SQL of the findings of one Python line; # lines give none, the first matching secret pattern counts once."""
    items = [_hit(f"NOT hash_line AND {_SECRET}", 0, "hardcoded_secret", "critical", 0.80, "CWE-798")]
    for i, (p, v, sev, c, cwe, unless) in enumerate(R.PYTHON, 1):
        cond = f"NOT hash_line AND line RLIKE {_text(p)}" + (f" AND NOT line RLIKE {_text(unless)}" if unless else "")
        items.append(_hit(cond, i, v, sev, c, cwe))
    return _hits(items)


def scan_lines(df: DataFrame, context: bool = False) -> DataFrame:
    """F.3, F.5-F.16: file_id, lineno, vuln_type, severity, confidence, cwe, rule_ord for rows of file_id,
    language, code.  Per line and type the first rule counts.  Unknown languages are scanned as Python.

    F.17: ``context`` adds snippet, the line with one line before and after, joined by line breaks.
    One pass without a shuffle: the hits of a line are one array, in the order of the rules.
    """
    lines = F.transform(T.lines(F.col("code")), lambda x: F.struct(x.alias("line")))
    if context:
        ls = T.lines(F.col("code"))
        lines = F.transform(ls, lambda x, i: F.struct(x.alias("line"), F.get(ls, i - 1).alias("before"), F.get(ls, i + 1).alias("after")))
    ls = df.where("code is not null").select("file_id", "language", F.posexplode(lines).alias("pos", "l")).select("file_id", "language", "pos", "l.*")
    ls = ls.withColumns(
        {
            "code_line": F.col("line").rlike(r"\S") & ~F.trim("line").startswith("//") & ~F.trim("line").startswith("*"),
            "hash_line": F.ltrim("line").startswith("#"),
        }
    )
    cases = " ".join(f"WHEN '{lang}' THEN {line_hits(lang)}" for lang in sorted(R.BY_LANGUAGE))
    found = ls.withColumn("hits", F.expr(f"CASE language {cases} ELSE {python_line_hits()} END"))
    kinds = F.transform("hits", lambda h: h["vuln_type"])
    first = F.filter("hits", lambda h, i: F.array_position(kinds, h["vuln_type"]) == i + 1)
    out = found.select("file_id", (F.col("pos") + 1).cast("long").alias("lineno"), *(["before", "line", "after"] if context else []), F.explode(first).alias("f"))
    snippet = [F.concat_ws("\n", "before", "line", "after").alias("snippet")] if context else []
    return out.select("file_id", "lineno", "f.*", *snippet)


def severity_counts(findings: DataFrame) -> DataFrame:
    """Per file: count per severity, total, penalty score (C.10) and grade."""
    c = {s: F.count_if(F.col("severity") == s) for s in R.SEVERITY_RANK}
    out = findings.groupBy("file_id").agg(*(v.alias(k) for k, v in c.items()), F.count(F.lit(1)).alias("total"))
    score = F.greatest(F.lit(0).cast("long"), F.lit(100) - sum((F.col(s) * p for s, p in R.PENALTY.items()), F.lit(0)))
    return out.withColumn("score", score).withColumn("grade", T.grade(F.col("score")))


def _files(spark, sf_dir):
    f = files(spark, sf_dir)
    return f.withColumn("language", language(F.col("language"), F.col("path")))


def _findings(spark, sf_dir):
    t = table(spark, sf_dir, "security_finding")
    return t.select("finding_id", F.col("record_id").alias("file_id"), F.col("lineno").cast("long").alias("lineno"), "vuln_type", F.lower("severity").alias("severity"), "confidence", F.when(F.col("cwe") != "", F.col("cwe")).alias("cwe"), "snippet")


def f5_rule_scan(spark, sf_dir):
    return scan_lines(_files(spark, sf_dir)).drop("rule_ord")


def f17_snippets(spark, sf_dir):
    return scan_lines(_files(spark, sf_dir), context=True).select("file_id", "lineno", "vuln_type", "snippet")


def f16_severity_report(spark, sf_dir):
    return severity_counts(scan_lines(_files(spark, sf_dir)))


def c9_unsuppressed(spark, sf_dir):
    """C.9: findings left after global suppression and that by comments of C.8 on their line (a left-anti join; a
    comment without rules holds for all)."""
    marks = c8_suppressions(spark, sf_dir).select("file_id", "lineno", F.explode(F.when(F.size("rules") > 0, F.col("rules")).otherwise(F.array(F.lit("*")))).alias("rule"))
    return suppress(_findings(spark, sf_dir), marks.distinct(), ["debug_output"]).select("finding_id", "vuln_type")


def suppress(findings: DataFrame, marks: DataFrame, global_rules: list[str]) -> DataFrame:
    m = marks.select(F.col("file_id").alias("_f"), F.col("lineno").alias("_l"), "rule")
    kept = findings.where(~F.col("vuln_type").isin(global_rules))
    return kept.join(m, (F.col("file_id") == F.col("_f")) & (F.col("lineno") == F.col("_l")) & ((F.col("rule") == "*") | (F.col("rule") == F.col("vuln_type"))), "left_anti")


def c12_quality_gate(spark, sf_dir):
    """C.12: of each gate (severity, least confidence, least number) whether it fails."""
    gates = spark.createDataFrame([("critical", 0.5, 10), ("high", 0.9, 50), ("low", 0.99, 5)], "gate_severity string, gate_confidence double, gate_count int")
    hits = _findings(spark, sf_dir).groupBy("severity", "confidence").agg(F.count(F.lit(1)).alias("n"))
    j = gates.join(hits, (F.col("severity") == F.col("gate_severity")) & (F.col("confidence") >= F.col("gate_confidence")), "left")
    out = j.groupBy("gate_severity", "gate_confidence", "gate_count").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return out.withColumn("fails", F.col("n") >= F.col("gate_count"))


def c16_decisions(spark, sf_dir):
    """C.16, C.17: action of each finding by severity, confidence and distribution; its task by keyword."""
    f = _findings(spark, sf_dir).join(_files(spark, sf_dir).select("file_id", F.size(T.nonblank(F.col("code"))).alias("sloc"), "language"), "file_id", "left")
    ood = F.coalesce(~F.col("language").isin("python"), F.lit(True)) | F.coalesce((F.col("sloc") < 5) | (F.col("sloc") > 600), F.lit(True))
    top = F.col("severity").isin("critical", "high")
    action = F.when(ood, "unreliable").when(top & (F.col("confidence") >= 0.75), "fix_now").when(top, "review").otherwise("low")
    prio = F.when(ood, 4).when(top & (F.col("confidence") >= 0.75), 1).when(top, 2).otherwise(3)
    task = F.when(F.col("vuln_type").rlike("secret|injection|xss|hash|deserial|traversal"), "security").when(F.col("vuln_type").rlike("debug"), "pattern").otherwise("unknown")
    return f.select("finding_id", action.alias("action"), prio.cast("long").alias("priority"), task.alias("task"))


def g13_root_causes(spark, sf_dir):
    """G.13: findings grouped by type per file: count, representative, lines, highest confidence."""
    f = _findings(spark, sf_dir).where("file_id is not null")
    rank = F.create_map(*(F.lit(x) for kv in R.SEVERITY_RANK.items() for x in kv))[F.col("severity")]
    return f.groupBy("file_id", "vuln_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by("finding_id", F.struct(rank, "lineno", "finding_id")).alias("representative"),
        F.array_sort(F.collect_set("lineno")).alias("lines"),
        F.max("confidence").alias("max_confidence"),
        F.bool_or(F.col("confidence") >= 0.8).alias("any_confident"),
    )


def g14_action_plan(spark, sf_dir):
    """G.14: numbered plan per file, worst and most frequent groups first."""
    g = g13_root_causes(spark, sf_dir)
    w = W.partitionBy("file_id").orderBy(F.desc("max_confidence"), F.desc("n"), "vuln_type")
    return g.select("file_id", F.row_number().over(w).cast("long").alias("step"), F.format_string("Fix %d x %s (lines %s)", "n", "vuln_type", F.array_join(F.col("lines").cast("array<string>"), ", ")).alias("text"))


def b4_sarif(spark, sf_dir):
    """B.4: one SARIF result per finding as JSON, ordered keys, level by severity."""
    level = F.when(F.col("severity").isin("critical", "high"), "error").when(F.col("severity") == "medium", "warning").otherwise("note")
    body = F.to_json(
        F.struct(F.col("vuln_type").alias("ruleId"), level.alias("level"), F.col("lineno").alias("startLine"), F.coalesce("cwe", F.lit("")).alias("cwe"))
    )
    return _findings(spark, sf_dir).select("finding_id", body.alias("result"))


def b4_sarif_document(spark, sf_dir):
    """B.4, B.5: the whole document of each file: distinct rules and results in line order."""
    f = _findings(spark, sf_dir).where("file_id is not null")
    res = F.array_sort(F.collect_list(F.struct("lineno", F.col("vuln_type").alias("ruleId"), "finding_id")))
    return f.groupBy("file_id").agg(F.array_sort(F.collect_set("vuln_type")).alias("rules"), res.alias("results")).select(
        "file_id", F.to_json(F.struct(F.lit("2.1.0").alias("version"), "rules", "results")).alias("document")
    )


def b6_annotations(spark, sf_dir):
    """B.6: findings as line annotations."""
    level = F.when(F.col("severity").isin("critical", "high"), "failure").when(F.col("severity") == "medium", "warning").otherwise("notice")
    return _findings(spark, sf_dir).where("file_id is not null").select("finding_id", "file_id", F.col("lineno").alias("start_line"), level.alias("annotation_level"))


def l12_ranked_findings(spark, sf_dir):
    """L.12: place of each finding within its file by severity and line."""
    rank = F.create_map(*(F.lit(x) for kv in R.SEVERITY_RANK.items() for x in kv))[F.col("severity")]
    f = _findings(spark, sf_dir).where("file_id is not null").withColumn("rank", rank)
    return places(f, ["file_id"], [F.asc("rank"), F.asc("lineno"), F.asc("finding_id")]).select("finding_id", "place")


def l14_changed_line_findings(spark, sf_dir):
    """L.14: the rule scan's findings in the new side of each diff (D.20), on changed lines (D.21) only (semi join)."""
    lines = diff_lines(spark, sf_dir).where(~F.col("line").startswith("@@ "))
    step = F.when(F.col("line").startswith("-"), 0).otherwise(1)
    lines = lines.withColumn("new", F.col("start") - 1 + F.sum(step).over(W.partitionBy("id", "hunk").orderBy("pos"))).where(~F.col("line").startswith("-"))
    side = F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: F.substring(x["line"], 2, 1 << 30))
    code = lines.groupBy(F.col("id").alias("file_id"), F.col("lang").alias("language")).agg(F.array_join(side, "\n").alias("code"))
    found = scan_lines(code).select("file_id", F.col("lineno").alias("nth"), "vuln_type", "severity")
    nth = F.row_number().over(W.partitionBy("id").orderBy("pos")).cast("long")
    changed = lines.select(F.col("id").alias("file_id"), nth.alias("nth"), F.col("new").alias("lineno"), F.col("line").startswith("+").alias("added"))
    return found.join(changed.where("added"), ["file_id", "nth"]).select("file_id", "lineno", "vuln_type", "severity")


def m5_real_and_false(spark, sf_dir):
    """M.5: findings split into real and likely false (placeholder, environment or test values), recounted."""
    false = F.col("snippet").rlike(r"os\.environ|getenv|process\.env|<[a-z-]+>|\$\{")
    f = _findings(spark, sf_dir)
    return f.groupBy("severity").agg(F.count_if(~false).alias("n_real"), F.count_if(false).alias("n_false"))


def c5_hard_negatives(spark, sf_dir):
    """C.5: dangerous API present but used safely."""
    f = _files(spark, sf_dir).where("code is not null")
    danger = F.col("code").rlike(r"subprocess|execute\(|yaml\.|hashlib|pickle")
    safe = F.col("code").rlike(r"shell=False|safe_load|sha256|\?\"|%s\"")
    bad = F.col("code").rlike(r"shell=True|\bmd5\b|\"\s*\+|\+\s*\"")
    return f.select("file_id", (danger & safe & ~bad).alias("hard_negative"))


QUERIES = {
    f.__name__: f
    for f in (
        f5_rule_scan, f17_snippets, f16_severity_report, c9_unsuppressed, c12_quality_gate, c16_decisions, g13_root_causes, g14_action_plan,
        b4_sarif, b4_sarif_document, b6_annotations, l12_ranked_findings, l14_changed_line_findings, m5_real_and_false, c5_hard_negatives,
    )
}

_Q = lambda s: "'" + s.replace("'", "''") + "'"
_LANG = "CASE coalesce(nullif(lower(trim(code_lang)), ''), lower(regexp_extract(origin, '\\.([A-Za-z0-9]+)$', 1))) WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'golang' THEN 'go' WHEN 'yml' THEN 'yaml' ELSE coalesce(nullif(lower(trim(code_lang)), ''), lower(regexp_extract(origin, '\\.([A-Za-z0-9]+)$', 1))) END"
_F = f"WITH f AS (SELECT record_id AS file_id, {_LANG} AS language, source AS code, origin AS path FROM security_dataset), ff AS (SELECT *, {SQL_LINES} AS ls FROM f WHERE code IS NOT NULL), l AS (SELECT file_id, language, ls, unnest(ls) AS line, CAST(generate_subscripts(ls, 1) AS BIGINT) AS lineno FROM ff)"


def _rule_rows() -> str:
    rows = []
    for lang in ("javascript", "java", "go"):
        for i, (p, v, s, c, w) in enumerate(R.BY_LANGUAGE[lang]):
            rows.append(f"({_Q(lang)}, {i}, {_Q(p)}, {_Q(v)}, {_Q(s)}, {c}, {_Q(w)}, NULL, 'code')")
        for p, _ in R.SECRETS:
            rows.append(f"({_Q(lang)}, 100, {_Q(p)}, 'hardcoded_credential', 'high', 0.75, 'CWE-798', NULL, 'all')")
    for p, _ in R.SECRETS:
        rows.append(f"('other', 0, {_Q(p)}, 'hardcoded_secret', 'critical', 0.8, 'CWE-798', NULL, 'hash')")
    for i, (p, v, s, c, w, u) in enumerate(R.PYTHON, 1):
        rows.append(f"('other', {i}, {_Q(p)}, {_Q(v)}, {_Q(s)}, {c}, {_Q(w)}, {_Q(u) if u else 'NULL'}, 'hash')")
    return ", ".join(rows)


_SCAN = (
    _F
    + f""", r(lang, rule_ord, pattern, vuln_type, severity, confidence, cwe, unless, mode) AS (VALUES {_rule_rows()}),
h AS (SELECT DISTINCT file_id, lineno, rule_ord, vuln_type, severity, confidence, cwe FROM l JOIN r ON r.lang = CASE WHEN l.language IN ('javascript','java','go') THEN l.language ELSE 'other' END
 AND regexp_matches(line, pattern) AND (unless IS NULL OR NOT regexp_matches(line, unless))
 AND CASE mode WHEN 'code' THEN regexp_matches(line, '\\S') AND NOT starts_with(trim(line), '//') AND NOT starts_with(trim(line), '*') WHEN 'hash' THEN NOT starts_with(ltrim(line), '#') ELSE true END),
found AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY file_id, lineno, vuln_type ORDER BY rule_ord) = 1)"""
)
_SF = "WITH s AS (SELECT finding_id, record_id AS file_id, CAST(lineno AS BIGINT) AS lineno, vuln_type, lower(severity) AS severity, confidence, nullif(cwe, '') AS cwe, snippet FROM security_finding)"
_RANK = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 END"
_G = _SF + f", g AS (SELECT file_id, vuln_type, count(*) AS n, arg_min(finding_id, ({_RANK}, lineno, finding_id)) AS representative, list_sort(list(DISTINCT lineno)) AS lines, max(confidence) AS max_confidence, bool_or(confidence >= 0.8) AS any_confident FROM s WHERE file_id IS NOT NULL GROUP BY 1, 2)"
_OOD = "(coalesce(language <> 'python', true) OR coalesce(sloc < 5 OR sloc > 600, true))"
ORACLE = {
    "f5_rule_scan": _SCAN + " SELECT file_id, lineno, vuln_type, severity, CAST(confidence AS DOUBLE) AS confidence, cwe FROM found",
    "f17_snippets": _SCAN + " SELECT found.file_id, lineno, vuln_type, array_to_string(ls[greatest(1, lineno - 1):lineno + 1], chr(10)) AS snippet FROM found JOIN ff USING (file_id)",
    "f16_severity_report": _SCAN
    + ", c AS (SELECT file_id, count_if(severity = 'critical')::BIGINT AS critical, count_if(severity = 'high')::BIGINT AS high, count_if(severity = 'medium')::BIGINT AS medium, count_if(severity = 'low')::BIGINT AS low, count(*) AS total FROM found GROUP BY 1), d AS (SELECT *, CAST(greatest(0, 100 - 40 * critical - 25 * high - 12 * medium - 5 * low) AS BIGINT) AS score FROM c) SELECT *, CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 45 THEN 'D' ELSE 'F' END AS grade FROM d",
    "c9_unsuppressed": _F
    + ", "
    + _SF[5:]
    + r""", m AS (SELECT file_id, lineno, list_filter(list_transform(string_split(regexp_extract(line, '#\s*codescan:\s*ignore(?:\[([^\]]*)\])?', 1), ','), lambda x: trim(x)), lambda x: x <> '') AS rules FROM l WHERE regexp_matches(line, '#\s*codescan:\s*ignore'))
 SELECT finding_id, vuln_type FROM s WHERE vuln_type <> 'debug_output' AND NOT EXISTS (SELECT 1 FROM m WHERE m.file_id = s.file_id AND m.lineno = s.lineno AND (len(rules) = 0 OR list_contains(rules, s.vuln_type)))""",
    "c12_quality_gate": _SF
    + ", g(gate_severity, gate_confidence, gate_count) AS (VALUES ('critical', 0.5::DOUBLE, 10), ('high', 0.9, 50), ('low', 0.99, 5)), n AS (SELECT g.*, (SELECT count(*) FROM s WHERE severity = gate_severity AND confidence >= gate_confidence) AS n FROM g) SELECT *, n >= gate_count AS fails FROM n",
    "c16_decisions": _F
    + ", " + _SF[5:]
    + f""", z AS (SELECT file_id, language, len(list_filter({SQL_LINES}, lambda x: regexp_matches(x, '\\S'))) AS sloc FROM f), j AS (SELECT s.*, language, sloc FROM s LEFT JOIN z USING (file_id))
SELECT finding_id, CASE WHEN {_OOD} THEN 'unreliable' WHEN severity IN ('critical','high') AND confidence >= 0.75 THEN 'fix_now' WHEN severity IN ('critical','high') THEN 'review' ELSE 'low' END AS action,
CAST(CASE WHEN {_OOD} THEN 4 WHEN severity IN ('critical','high') AND confidence >= 0.75 THEN 1 WHEN severity IN ('critical','high') THEN 2 ELSE 3 END AS BIGINT) AS priority,
CASE WHEN regexp_matches(vuln_type, 'secret|injection|xss|hash|deserial|traversal') THEN 'security' WHEN regexp_matches(vuln_type, 'debug') THEN 'pattern' ELSE 'unknown' END AS task FROM j""",
    "g13_root_causes": _G + " SELECT * FROM g",
    "g14_action_plan": _G + " SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY max_confidence DESC, n DESC, vuln_type) AS step, format('Fix {} x {} (lines {})', n, vuln_type, array_to_string(lines, ', ')) AS text FROM g",
    "b4_sarif": _SF
    + """ SELECT finding_id, '{"ruleId":"' || vuln_type || '","level":"' || CASE WHEN severity IN ('critical','high') THEN 'error' WHEN severity = 'medium' THEN 'warning' ELSE 'note' END || '","startLine":' || lineno || ',"cwe":"' || coalesce(cwe, '') || '"}' AS result FROM s""",
    "b4_sarif_document": _SF
    + """ SELECT file_id, '{"version":"2.1.0","rules":[' || array_to_string(list_transform(list_sort(list(DISTINCT vuln_type)), lambda x: '"' || x || '"'), ',') || '],"results":[' || string_agg('{"lineno":' || lineno || ',"ruleId":"' || vuln_type || '","finding_id":' || finding_id || '}', ',' ORDER BY lineno, vuln_type, finding_id) || ']}' AS document FROM s WHERE file_id IS NOT NULL GROUP BY 1""",
    "b6_annotations": _SF
    + " SELECT finding_id, file_id, lineno AS start_line, CASE WHEN severity IN ('critical','high') THEN 'failure' WHEN severity = 'medium' THEN 'warning' ELSE 'notice' END AS annotation_level FROM s WHERE file_id IS NOT NULL",
    "l12_ranked_findings": _SF + f" SELECT finding_id, row_number() OVER (PARTITION BY file_id ORDER BY {_RANK}, lineno, finding_id) AS place FROM s WHERE file_id IS NOT NULL",
    "m5_real_and_false": _SF
    + r" SELECT severity, count_if(NOT regexp_matches(snippet, 'os\.environ|getenv|process\.env|<[a-z-]+>|\$\{'))::BIGINT AS n_real, count_if(regexp_matches(snippet, 'os\.environ|getenv|process\.env|<[a-z-]+>|\$\{'))::BIGINT AS n_false FROM s GROUP BY 1",
    "c5_hard_negatives": _F
    + r""" SELECT file_id, regexp_matches(code, 'subprocess|execute\(|yaml\.|hashlib|pickle') AND regexp_matches(code, 'shell=False|safe_load|sha256|\?"|%s"') AND NOT regexp_matches(code, 'shell=True|\bmd5\b|"\s*\+|\+\s*"') AS hard_negative FROM f WHERE code IS NOT NULL""",
}
