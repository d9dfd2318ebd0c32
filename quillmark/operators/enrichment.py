"""Finding enrichment, training records from sources, metric bundles and fallbacks (A, D, E, G, H, O)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmark.functions import scores as S
from quillmark.functions import text as T
from quillmark.operators.changes import B, bugs
from quillmark.operators.evaluation import S as SCORED
from quillmark.operators.evaluation import auc, ranked, scored
from quillmark.operators.scoring import metrics, probabilities
from quillmark.operators.structure import METRICS, metrics_of, per_source, python_files
from quillmark.operators.text_metrics import files
from quillmark.sources.tables import table

# Exploitability by severity.
BASE = {"critical": 9, "high": 7, "medium": 4, "low": 2}


def enrich(findings: DataFrame) -> DataFrame:
    """G.10, I.14: false_positive (a constant or environment source), user_controlled and exploitability 1..10.

    ``findings``: finding_id, vuln_type, severity, snippet; a null snippet is neither.
    """
    text = F.coalesce("snippet", F.lit(""))
    user = text.rlike(r"(?i)request|input\(|argv|params|query")
    env = text.rlike(r"environ|getenv|process\.env")
    fixed = F.col("vuln_type").isin("hardcoded_secret", "weak_hash", "debug_output")
    base = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in BASE.items() for x in kv)), F.lower("severity")), F.lit(5))
    boost = F.when(fixed, 0).when(user, 1).when(env, -2).otherwise(0)
    return findings.select("finding_id", (env & ~user & ~fixed).alias("false_positive"), user.alias("user_controlled"), F.greatest(F.lit(1), F.least(F.lit(10), base + boost)).cast("long").alias("exploitability"))


def g10_enriched(spark, sf_dir):
    return enrich(table(spark, sf_dir, "security_finding"))


def g11_route_parameters(spark, sf_dir):
    """G.11, D.30: parameters of functions whose nearest line above is a route decorator, and the first argument
    text of that decorator's call (an as-of lookup over lines)."""
    f = files(spark, sf_dir).where("code is not null")
    ls = f.select("file_id", F.posexplode(T.lines(F.col("code"))).alias("pos", "line")).where(F.col("line").rlike(r"\S"))
    w = W.partitionBy("file_id").orderBy("pos")
    ls = ls.withColumn("above", F.lag("line").over(w))
    d = ls.where(F.col("line").rlike(r"^\s*(?:async\s+)?def\s+\w+\(") & F.col("above").rlike(r"^\s*@\w+(?:\.\w+)*"))
    params = F.regexp_extract_all(F.regexp_extract("line", r"\(([^)]*)", 1), F.lit(r"([A-Za-z_][A-Za-z0-9_]*)\s*(?:[:=,]|$)"), F.lit(1))
    return d.select("file_id", (F.col("pos") + 1).cast("long").alias("lineno"), F.array_join(params, ",").alias("params"), F.regexp_extract("above", r"\(([^,)]*)", 1).alias("argument"), F.col("above").rlike(r"\.(?:route|get|post|put|delete)\(").alias("is_route"))


def a19_complexity_records(spark, sf_dir):
    """A.19, E.33, D.31: training records from sources: named metrics in a fixed order and the target; sources that
    do not parse are counted by ``parse_ok``, not dropped silently."""
    m = per_source(python_files(spark, sf_dir), METRICS, metrics_of)
    names = ["cyclomatic", "cognitive", "max_cyclomatic", "avg_cyclomatic", "sloc", "comment", "blank", "volume", "difficulty", "effort", "bugs", "n_long", "n_complex", "depth", "n_calls", "n_imports"]
    return m.select("file_id", "parse_ok", F.array(*(F.col(n).cast("double") for n in names)).alias("features"), F.col("cognitive").cast("double").alias("target"))


def a20_security_records(spark, sf_dir):
    """A.20: positives, hard negatives and negatives in one table, duplicates by source dropped (smallest id stays)."""
    s = table(spark, sf_dir, "security_dataset").where("label is not null and source is not null and source <> ''")
    kind = F.when(F.col("label") == 1, "positive").when(F.col("source").rlike(r"subprocess|execute\(|hashlib|pickle"), "hard_negative").otherwise("negative")
    return s.groupBy(F.md5("source").alias("h")).agg(F.min_by(kind, "record_id").alias("kind"), F.min("record_id").alias("record_id")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("record_id").alias("first"))


def h24_ensemble(spark, sf_dir):
    """H.24: weight-normalised mean of two scores, damped towards 0.5 where a record lies far from the others; C.25, H.30: the
    heuristic stands in where a score is missing."""
    x = probabilities(metrics(spark, sf_dir))
    second = F.when(F.col("n_files") > 0, F.least(F.lit(1.0), F.col("n_past_bugs") / 10))
    mean = 0.65 * F.col("p") + 0.35 * F.coalesce(second, F.col("p"))
    far = F.log1p("lines_touched") > 5
    return x.select("id", F.round(F.when(far & (mean > 0.5), 0.5 + (mean - 0.5) * 0.5).otherwise(mean), 5).alias("score"))


def h31_meta_records(spark, sf_dir):
    """H.31: meta features derived from bug records, with their labels."""
    b = bugs(spark, sf_dir).where("label is not null")
    g = lambda c: F.coalesce(F.col(f"git.{c}"), F.lit(0.0))
    s, cd, p = F.least(F.lit(1.0), g("n_past_bugs") / 10), F.least(F.lit(1.0), F.coalesce(F.get("features", F.lit(1)), F.lit(0.0)) / 100), F.least(F.lit(1.0), g("code_churn") / 500)
    return b.select("id", "label", F.round(s, 5).alias("s"), F.round(cd, 5).alias("cd"), F.round(p, 5).alias("b"), F.round(s * p, 5).alias("sb"), F.round(F.cbrt(s * cd * p), 4).alias("geo"))


def o15_gap(spark, sf_dir):
    """O.15: AUC of the first four fifths of the ids against that of the last, and whether the gap passes 0.2."""
    s = scored(spark, sf_dir).withColumn("grp", F.when(F.col("id") % 5 == 0, "test").otherwise("train"))
    a = auc(s, ["grp"]).groupBy().pivot("grp", ["train", "test"]).agg(F.first("auc"))
    return a.select(F.round("train", 5).alias("train"), F.round("test", 5).alias("test"), (F.col("train") - F.col("test") > 0.2).alias("overfit"))


def o39_effort_bundle(spark, sf_dir):
    """O.39: share of positives at 20, 30 and 40 % of all sizes in one pass over the ranked rows, with the AUC."""
    r = ranked(scored(spark, sf_dir), "score", ("y", "size"))
    total = F.broadcast(r.agg(F.sum("size").alias("total"), F.sum("y").alias("pos")))
    at = lambda x: F.round(F.sum(F.when(F.col("cum_size") - F.col("size") < x * F.col("total"), F.col("y")).otherwise(0)) / F.first("pos"), 6)
    b = r.join(total).agg(at(0.2).alias("pofb20"), at(0.3).alias("pofb30"), at(0.4).alias("pofb40"))
    a = auc(scored(spark, sf_dir).withColumn("grp", F.lit("all")), ["grp"]).select(F.round("auc", 6).alias("auc"))
    return b.join(a)


def o40_shift_summary(spark, sf_dir):
    """O.40: share of repos whose mean score moved by less than 0.05 between odd and even records, mean and greatest move."""
    s = scored(spark, sf_dir)
    g = s.groupBy("grp").agg(F.abs(F.avg(F.when(F.col("id") % 2 == 0, F.col("score"))) - F.avg(F.when(F.col("id") % 2 == 1, F.col("score")))).alias("d")).where("d is not null")
    return g.agg(F.round(F.avg((F.col("d") < 0.05).cast("double")), 6).alias("stable"), F.round(F.avg("d"), 5).alias("mean_delta"), F.round(F.max("d"), 5).alias("max_delta"))


def h32_growth_rate(spark, sf_dir):
    """P.16: rule-based growth of complexity (0..2) and its band at .1, .5, 1.5."""
    m = metrics(spark, sf_dir)
    unit = lambda c, n: F.least(F.lit(1.0), F.col(c) / n)
    rate = 2 * (0.4 * unit("cc", 20.0) + 0.3 * unit("effort", 50000.0) + 0.2 * F.least(F.lit(0.5), F.col("n_long") * 0.1) + 0.1 * F.least(F.lit(0.5), F.col("n_complex") * 0.1))
    band = S.bands(rate, [(1.5, 3.0), (0.5, 2.0), (0.1, 1.0)], 0.0).cast("long")
    return m.select("id", F.round(rate, 5).alias("rate"), band.alias("band"))


QUERIES = {k: f for k, f in list(globals().items()) if k[0] in "agho" and k[1].isdigit()}

_AUC = "r AS (SELECT *, (2 * rank() OVER (PARTITION BY grp ORDER BY score) + count(*) OVER (PARTITION BY grp, score) - 1) / 2.0 AS rank FROM q), a AS (SELECT grp, (sum(CASE WHEN y = 1 THEN rank END) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) AS auc FROM r GROUP BY 1)"
ORACLE = {
    "g10_enriched": r"WITH f AS (SELECT finding_id, lower(severity) AS severity, regexp_matches(snippet, '(?i)request|input\(|argv|params|query') AS u, regexp_matches(snippet, 'environ|getenv|process\.env') AS e, vuln_type IN ('hardcoded_secret', 'weak_hash', 'debug_output') AS fx FROM security_finding) SELECT finding_id, e AND NOT u AND NOT fx AS false_positive, u AS user_controlled, CAST(greatest(1, least(10, CASE severity WHEN 'critical' THEN 9 WHEN 'high' THEN 7 WHEN 'medium' THEN 4 WHEN 'low' THEN 2 ELSE 5 END + CASE WHEN fx THEN 0 WHEN u THEN 1 WHEN e THEN -2 ELSE 0 END)) AS BIGINT) AS exploitability FROM f",
    "a20_security_records": r"WITH s AS (SELECT record_id, source, CASE WHEN label = 1 THEN 'positive' WHEN regexp_matches(source, 'subprocess|execute\(|hashlib|pickle') THEN 'hard_negative' ELSE 'negative' END AS kind FROM security_dataset WHERE label IS NOT NULL AND source <> ''), u AS (SELECT arg_min(kind, record_id) AS kind, min(record_id) AS record_id FROM s GROUP BY source) SELECT kind, count(*) AS n, min(record_id) AS first FROM u GROUP BY 1",
    "h31_meta_records": f"WITH {B}, x AS (SELECT id, label, least(1.0, coalesce(git.n_past_bugs, 0.0) / 10) AS s, least(1.0, coalesce(features[2], 0.0) / 100) AS cd, least(1.0, coalesce(git.code_churn, 0.0) / 500) AS b FROM b WHERE label IS NOT NULL) SELECT id, label, round(s, 5) AS s, round(cd, 5) AS cd, round(b, 5) AS b, round(s * b, 5) AS sb, round(cbrt(s * cd * b), 4) AS geo FROM x",
    "o15_gap": f"WITH {SCORED}, q AS (SELECT id, y, score, CASE WHEN id % 5 = 0 THEN 'test' ELSE 'train' END AS grp FROM s), {_AUC} SELECT round(max(CASE WHEN grp = 'train' THEN auc END), 5) AS train, round(max(CASE WHEN grp = 'test' THEN auc END), 5) AS test, max(CASE WHEN grp = 'train' THEN auc END) - max(CASE WHEN grp = 'test' THEN auc END) > 0.2 AS overfit FROM a",
    "o39_effort_bundle": f"WITH {SCORED}, q AS (SELECT id, y, score, 'all' AS grp FROM s), {_AUC}, c AS (SELECT *, sum(size) OVER (ORDER BY score DESC, id) - size AS before, (SELECT sum(size) FROM s) AS total, (SELECT sum(y) FROM s) AS pos FROM s) SELECT round(sum(CASE WHEN before < 0.2 * total THEN y ELSE 0 END) / max(pos), 6) AS pofb20, round(sum(CASE WHEN before < 0.3 * total THEN y ELSE 0 END) / max(pos), 6) AS pofb30, round(sum(CASE WHEN before < 0.4 * total THEN y ELSE 0 END) / max(pos), 6) AS pofb40, (SELECT round(auc, 6) FROM a) AS auc FROM c",
    "o40_shift_summary": f"WITH {SCORED}, g AS (SELECT grp, abs(avg(CASE WHEN id % 2 = 0 THEN score END) - avg(CASE WHEN id % 2 = 1 THEN score END)) AS d FROM s GROUP BY 1) SELECT round(avg(CAST(d < 0.05 AS DOUBLE)), 6) AS stable, round(avg(d), 5) AS mean_delta, round(max(d), 5) AS max_delta FROM g WHERE d IS NOT NULL",
}
