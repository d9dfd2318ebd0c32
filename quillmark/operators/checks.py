"""Remaining predicates, labels, scores and ablations (C, H, K, O, R)."""

from __future__ import annotations

import fnmatch
import json
from dataclasses import dataclass, field, fields
from pathlib import Path

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmark.functions import text as T
from quillmark.functions.rules import SEVERITY_RANK
from quillmark.operators.changes import B, bugs
from quillmark.operators.clones import RISKY, SAFE, d20_hunks, diff_lines
from quillmark.operators.evaluation import average_ranks
from quillmark.operators.scoring import _M, metrics
from quillmark.operators.skew import running
from quillmark.operators.structure import VOCABULARY as WORDS
from quillmark.operators.text_metrics import FILES, SQL_LINES, files
from quillmark.sources.tables import table


@dataclass
class Config:
    """R.3, R.4, A.16: options of a scan; ``load`` reads JSON and rejects unknown names and wrong types."""

    threshold: float = 60.0
    ignore_paths: list[str] = field(default_factory=lambda: ["*/tests/*", "*/lib/*.js"])
    suppressed: list[str] = field(default_factory=list)

    @classmethod
    def load(cls, path: str) -> Config:
        given = json.loads(Path(path).read_text(encoding="utf-8"))
        known = {f.name: f for f in fields(cls)}
        if unknown := set(given) - set(known):
            raise ValueError(f"unknown options: {sorted(unknown)}")
        out = cls(**given)
        for name in given:
            if not isinstance(getattr(out, name), (int, float) if name == "threshold" else list):
                raise ValueError(f"wrong type of {name}")
        return out


def glob_regex(patterns: list[str]) -> str:
    """One Java regular expression for any of several globs."""
    return "|".join(f"(?:{fnmatch.translate(p).replace(chr(92) + 'Z', '$').replace(chr(92) + 'z', '$')})" for p in patterns)


def c11_ignored(spark, sf_dir):
    """C.11: origins that match an ignore pattern."""
    return files(spark, sf_dir).select("file_id", F.col("path").rlike("^(?:" + glob_regex(Config().ignore_paths) + ")").alias("ignored"))


def c13_guard(spark, sf_dir, most: int = 2000):
    """C.13: sources within the line limit, and their text cut to it."""
    f = files(spark, sf_dir).where("code is not null")
    ls = T.lines(F.col("code"))
    return f.select("file_id", (F.size(ls) <= most).alias("accepted"), F.length(F.array_join(F.slice(ls, 1, most), "\n")).cast("long").alias("n_chars"))


def c24_tool_labels(spark, sf_dir):
    """C.24: a label only where metric bands agree; records without one are dropped."""
    m = metrics(spark, sf_dir)
    label = (
        F.when((F.col("cc") > 20) & (F.col("n_long") > 5), "anti_pattern").when((F.col("cc") <= 4) & (F.col("sloc") <= 40), "clean")
        .when((F.col("n_long") > 10) | (F.col("n_complex") > 10), "code_smell").when(F.col("over_80") >= 5, "style_violation")
    )
    return m.select("id", label.alias("label")).where("label is not null")


def h23_vulnerability(spark, sf_dir):
    """H.23, L.12: score of a file by its worst finding: .95 critical, .80 high, .50 any, .05 none."""
    f = table(spark, sf_dir, "security_finding").where("record_id is not null")
    rank = F.create_map(*(F.lit(x) for kv in SEVERITY_RANK.items() for x in kv))[F.lower("severity")]
    g = f.groupBy(F.col("record_id").alias("file_id")).agg(F.min(rank).alias("worst"))
    j = files(spark, sf_dir).select("file_id").join(g, "file_id", "left")
    return j.select("file_id", F.when(F.col("worst") == 0, 0.95).when(F.col("worst") == 1, 0.80).when(F.col("worst").isNotNull(), 0.50).otherwise(0.05).alias("score"))


def h26_trust(spark, sf_dir):
    """H.26, H.25: per record which models are reliable, as one text; outside 5..600 lines none is."""
    m = metrics(spark, sf_dir)
    inside = F.col("sloc").between(5, 600)
    items = F.filter(F.array(F.when(inside, F.lit("complexity")), F.when(inside & (F.col("code_churn") > 0), F.lit("bug")), F.when(inside & (F.col("sloc") >= 10), F.lit("security"))), lambda x: x.isNotNull())
    return m.select("id", F.array_join(items, ",").alias("reliable"))


def k6_growth(spark, sf_dir):
    """K.6: slope of complexity over the index of each repo's records by time, groups of three and more.

    The index comes from running counts by month, so a repo with many records is no task of its own."""
    b = bugs(spark, sf_dir).where("size(features) = 16").select("repo", "id", F.coalesce("t", F.lit(0)).alias("t"), F.col("features")[1].alias("y"))
    b = b.withColumn("month", F.expr("t div 2592000"))
    b = running(b, ["repo"], "month", [F.col("t"), F.col("id")], {"x": F.lit(1).cast("long")}).withColumn("x", F.col("x").cast("double"))
    return b.groupBy("repo").agg(F.count(F.lit(1)).alias("n"), F.regr_slope("y", "x").alias("slope"), F.min_by("id", "x").alias("first")).where("n >= 3").select("repo", "n", F.round("slope", 5).alias("slope"), "first")


# Line patterns of control flow in diffs.
BRANCH = r"^\s*(?:if|elif|else|switch|case|for|while)\b"
CHECK = r"^\s*(?:assert|if\s+.*is\s+(?:None|not\s+None)|if\s+.*==\s*None|if\s+len\(|if\s+not\s+)"
CONDITION = r"\b(?:and|or|not|&&|\|\||!)\b"
TRY, EXCEPT = r"^\s*try\s*:", r"^\s*(?:except|finally)\b"


def k20_diff_features(spark, sf_dir):
    """K.20: of each diff the 12 values of its structure, 12 of its hunks' risks, 6 of its control flow, the shares of
    vocabulary words among the added identifiers, and the history of its change (``git_features``)."""
    h = d20_hunks(spark, sf_dir)
    q = lambda p: F.percentile("risk", F.lit(p))
    hunks = h.groupBy("id").agg(
        F.count(F.lit(1)).alias("n_hunks"), F.sum("added").alias("added"), F.sum("deleted").alias("deleted"), F.avg("context").alias("_context"),
        F.max("risk").alias("max_risk"), F.avg("risk").alias("mean_risk"), F.coalesce(F.stddev_pop("risk"), F.lit(0.0)).alias("std_risk"), F.sum("risk").alias("sum_risk"),
        F.count_if(F.col("risk") > 0.5).alias("n_high"), F.count_if(F.col("risk") > 0.2).alias("n_medium"), F.min_by("risk", "hunk").alias("first_risk"), F.max_by("risk", "hunk").alias("last_risk"),
        q(0.25).alias("q1_risk"), q(0.5).alias("q2_risk"), q(0.75).alias("q3_risk"), F.min("risk").alias("min_risk"),
    )
    x = diff_lines(spark, sf_dir).where(~F.col("line").startswith("@@ "))
    plus, minus, body = F.col("line").rlike(r"^\+(?!\+\+)"), F.col("line").rlike("^-(?!--)"), F.substring("line", 2, 1 << 30)
    hits = lambda rx: F.size(F.regexp_extract_all(body, F.lit(rx), F.lit(0)))
    count = lambda side, rx: F.sum(F.when(side, hits(rx)).otherwise(0))
    lines = lambda side, rx: F.count_if(side & body.rlike(rx))
    words = F.flatten(F.transform(F.regexp_extract_all(body, F.lit(r"[A-Za-z_][A-Za-z0-9_]*"), F.lit(0)), T.sub_tokens))
    x = x.withColumn("words", F.when(plus, words).otherwise(F.array().cast("array<string>")))
    n_words = F.greatest(F.lit(1), F.sum(F.size("words")))
    one_of = lambda ws: lambda w: w.isin(ws)
    text = x.groupBy("id").agg(
        (F.max("start") - F.min("start")).alias("_spread"), count(plus, RISKY).alias("n_risk_added"), count(plus, SAFE).alias("n_safe_added"),
        lines(plus, BRANCH).alias("added_branches"), lines(minus, CHECK).alias("removed_checks"), (count(plus, CONDITION) - count(minus, CONDITION)).alias("changed_conditions"),
        lines(plus, TRY).alias("added_try"), lines(minus, TRY).alias("removed_try"), (lines(plus, EXCEPT) - lines(minus, EXCEPT)).alias("except_change"),
        *(F.round(F.sum(F.size(F.filter("words", one_of(ws)))) / n_words, 6).alias(f"{k}_share") for k, ws in WORDS.items()),
    )
    b = table(spark, sf_dir, "bug_dataset")
    git = b.select(
        F.col("record_id").alias("id"), F.coalesce(F.col("file").rlike(r"\.(?:py|js|java|go)$"), F.lit(False)).alias("is_code"),
        *(F.coalesce(F.col(f"git_features.{c}"), F.lit(0.0)).alias(f"git_{c}") for c in ("n_subsystems", "n_directories", "n_files", "entropy", "lines_added", "lines_deleted", "lines_touched", "is_fix", "author_count", "file_age_days", "developer_exp")),
    )
    out = hunks.join(text, "id").join(git, "id")
    churn = F.col("added") + F.col("deleted")
    r = lambda c: F.round(c, 6)
    out = out.withColumns({
        "churn": churn, "churn_ratio": r(F.least(F.lit(10.0), F.col("added") / F.greatest(F.lit(1), F.col("deleted")))), "risk_density": r(F.col("n_risk_added") / F.greatest(F.lit(1), F.col("added"))),
        "spread": r(F.col("_spread") / 1000), "context": r(F.col("_context") / 10), **{c: r(F.col(c)) for c in ("mean_risk", "std_risk", "sum_risk", "q1_risk", "q2_risk", "q3_risk")},
    })
    return out.drop("_spread", "_context")


def o5_jackknife(spark, sf_dir, folds: int = 5):
    """O.5: cross-validated residuals of a repo-mean prediction stand in for leave-one-out; their 90 % quantile and coverage."""
    b = bugs(spark, sf_dir).where("label is not null").select("id", "label", F.pmod("id", F.lit(folds)).alias("fold"))
    per = b.groupBy("fold").agg(F.sum("label").alias("s"), F.count(F.lit(1)).alias("n"))
    whole = F.broadcast(per.agg(F.sum("s").alias("sa"), F.sum("n").alias("na")))
    pred = per.join(whole).select("fold", ((F.col("sa") - F.col("s")) / (F.col("na") - F.col("n"))).alias("p"))
    r = b.join(F.broadcast(pred), "fold").withColumn("res", F.abs(F.col("label") - F.col("p")))
    q = F.broadcast(r.agg(F.percentile("res", F.lit(0.9)).alias("q")))
    return r.join(q).agg(F.round(F.first("q"), 6).alias("q"), F.round(F.avg((F.col("res") <= F.col("q")).cast("double")), 6).alias("coverage"), F.round(2 * F.first("q"), 6).alias("width"))


def o14_single_features(spark, sf_dir):
    """O.14: rank AUC of each raw feature; a single feature over 0.85 points to leakage."""
    t = bugs(spark, sf_dir).where("label is not null").select("id", "label", F.posexplode("features").alias("feature", "score")).where("score is not null and not isnan(score)")
    r = average_ranks(t, "score", ["feature"])
    g = r.groupBy("feature").agg(F.sum(F.when(F.col("label") == 1, F.col("rank"))).alias("sr"), F.sum("label").alias("p"), F.count(F.lit(1)).alias("n"))
    auc = F.try_divide(F.col("sr") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * (F.col("n") - F.col("p")))
    return g.select(F.col("feature").cast("long").alias("feature"), F.round(auc, 5).alias("auc"), (F.greatest(auc, 1 - auc) > 0.85).alias("oracle"))


def o29_ablation(spark, sf_dir):
    """O.29, O.38, P.22: correlation of a feature sum with the label when a group of features is zeroed."""
    b = bugs(spark, sf_dir).where("label is not null and size(features) = 16")
    groups = {"none": [], "size": [4, 5, 6], "complexity": [0, 1, 2, 3], "halstead": [7, 8, 9, 10]}

    def total(ix: list[int]):
        kept = F.transform("features", lambda x, i: F.when(i.isin(ix), 0.0).otherwise(x)) if ix else F.col("features")
        return F.aggregate(kept, F.lit(0.0), lambda acc, x: acc + x)

    cols = {n: total(ix) for n, ix in groups.items()}
    long = b.select("label", *(c.alias(n) for n, c in cols.items())).unpivot(["label"], list(groups), "zeroed", "s")
    return long.groupBy("zeroed").agg(F.round(F.corr("s", "label"), 5).alias("corr"))


QUERIES = {k: f for k, f in list(globals().items()) if k[0] in "chko" and k[1].isdigit()}
_AU = "(2 * rank() OVER (PARTITION BY feature ORDER BY x) + count(*) OVER (PARTITION BY feature, x) - 1) / 2.0"
ORACLE = {
    "k6_growth": f"WITH {B}, x AS (SELECT repo, id, features[2] AS y, row_number() OVER (PARTITION BY repo ORDER BY coalesce(t, 0), id) - 1 AS x FROM b WHERE len(features) = 16) SELECT repo, count(*) AS n, round(regr_slope(y, x), 5) AS slope, arg_min(id, x) AS first FROM x GROUP BY 1 HAVING count(*) >= 3",
    "c11_ignored": f"SELECT file_id, regexp_matches(path, '^.*/tests/.*$') OR regexp_matches(path, '^.*/lib/.*\\.js$') AS ignored FROM {FILES}",
    "c13_guard": f"WITH f AS (SELECT file_id, {SQL_LINES} AS ls FROM {FILES} WHERE code IS NOT NULL) SELECT file_id, len(ls) <= 2000 AS accepted, length(coalesce(array_to_string(ls[:2000], chr(10)), '')) AS n_chars FROM f",
    "c24_tool_labels": f"WITH {_M}, l AS (SELECT id, CASE WHEN cc > 20 AND n_long > 5 THEN 'anti_pattern' WHEN cc <= 4 AND sloc <= 40 THEN 'clean' WHEN n_long > 10 OR n_complex > 10 THEN 'code_smell' WHEN over_80 >= 5 THEN 'style_violation' END AS label FROM m) SELECT * FROM l WHERE label IS NOT NULL",
    "h23_vulnerability": "WITH g AS (SELECT record_id AS file_id, min(CASE lower(severity) WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END) AS worst FROM security_finding WHERE record_id IS NOT NULL GROUP BY 1) SELECT s.record_id AS file_id, CAST(CASE WHEN worst = 0 THEN 0.95 WHEN worst = 1 THEN 0.80 WHEN worst IS NOT NULL THEN 0.50 ELSE 0.05 END AS DOUBLE) AS score FROM security_dataset s LEFT JOIN g ON g.file_id = s.record_id",
    "h26_trust": f"WITH {_M} SELECT id, CASE WHEN sloc BETWEEN 5 AND 600 THEN 'complexity' || CASE WHEN code_churn > 0 THEN ',bug' ELSE '' END || CASE WHEN sloc >= 10 THEN ',security' ELSE '' END ELSE '' END AS reliable FROM m",
    "o14_single_features": f"WITH t AS (SELECT label AS y, unnest(static_features) AS x, generate_subscripts(static_features, 1) - 1 AS feature FROM bug_dataset WHERE label IS NOT NULL), r AS (SELECT feature, y, {_AU} AS rank FROM t WHERE x IS NOT NULL), g AS (SELECT feature, (sum(CASE WHEN y = 1 THEN rank END) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) AS auc FROM r GROUP BY 1) SELECT CAST(feature AS BIGINT) AS feature, round(auc, 5) AS auc, greatest(auc, 1 - auc) > 0.85 AS oracle FROM g",
    "o5_jackknife": "WITH b AS (SELECT record_id % 5 AS fold, label FROM bug_dataset WHERE label IS NOT NULL), p AS (SELECT f.fold, avg(b.label) AS p FROM (SELECT DISTINCT fold FROM b) f JOIN b ON b.fold <> f.fold GROUP BY 1), r AS (SELECT abs(label - p) AS res FROM b JOIN p USING (fold)), q AS (SELECT quantile_cont(res, 0.9) AS q FROM r) SELECT round(q, 6) AS q, round(avg(CAST(res <= q AS DOUBLE)), 6) AS coverage, round(2 * q, 6) AS width FROM r, q GROUP BY q",
    "o29_ablation": "WITH b AS (SELECT label, static_features AS f FROM bug_dataset WHERE label IS NOT NULL AND len(static_features) = 16), z AS (SELECT 'none' AS zeroed, [] AS ix UNION ALL SELECT 'size', [5, 6, 7] UNION ALL SELECT 'complexity', [1, 2, 3, 4] UNION ALL SELECT 'halstead', [8, 9, 10, 11]), s AS (SELECT zeroed, label, list_sum(f) - coalesce(list_sum(list_transform(ix, lambda i: f[i])), 0) AS s FROM b, z) SELECT zeroed, round(corr(s, label), 5) AS corr FROM s GROUP BY 1",
}
