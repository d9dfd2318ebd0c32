"""Composite scores over joined per-file results (section H)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmark.functions import scores as S
from quillmark.functions.text import grade
from quillmark.operators.changes import B, bugs


def metrics(spark, sf_dir) -> DataFrame:
    """id, repo, file, label and one column per static and git metric (missing: 0)."""
    b = bugs(spark, sf_dir)
    cols = {n: F.coalesce(F.get("features", F.lit(i)), F.lit(0.0)).alias(n) for i, n in enumerate(S.STATIC)}
    git = [F.coalesce(F.col(f"git.{n}"), F.lit(0.0)).alias(n) for n in ("code_churn", "author_count", "n_past_bugs", "commit_freq", "n_files", "lines_touched")]
    return b.select("id", "repo", "file", "label", *cols.values(), *git)


def _m(names=S.STATIC):
    return {n: F.col(n) for n in names}


def probabilities(m: DataFrame) -> DataFrame:
    p = S.defect_probability(_m())
    return m.withColumn("base", p).withColumn("p", S.git_adjusted(F.col("base"), _m(S.GIT_ODDS)))


def h6_defect(spark, sf_dir):
    """H.6, H.7, H.8, J.11: heuristic probability, with git data, confidence, risk level."""
    x = probabilities(metrics(spark, sf_dir))
    level = F.when(F.col("p") >= 0.7, "high").when(F.col("p") >= 0.4, "medium").otherwise("low")
    return x.select("id", "base", "p", F.round(S.entropy_confidence(F.col("p")), 5).alias("confidence"), level.alias("level"))


def h9_factors(spark, sf_dir):
    """H.9, H.29: the drivers that exceed their limit, in fixed order."""
    limits = {"cc": 15, "cog": 20, "n_long": 5, "code_churn": 150, "n_past_bugs": 3, "author_count": 15}
    found = F.filter(F.array(*(F.when(F.col(n) > v, F.lit(n)) for n, v in limits.items())), lambda x: x.isNotNull())
    return metrics(spark, sf_dir).select("id", F.array_join(found, ",").alias("factors"), F.size(found).cast("long").alias("n"))


def h4_quality(spark, sf_dir):
    """H.4, H.5: quality score and grade."""
    q = metrics(spark, sf_dir).withColumn("q", F.round(S.quality_score(_m()), 4))
    return q.select("id", F.col("q").alias("quality"), grade(F.col("q")).alias("grade"))


def h10_attribution(spark, sf_dir):
    """H.10, H.11: additive risk per record, attributed within its repo by share of complexity, ranked."""
    risk = 0.10 + S.bands(F.col("cog"), [(30, 0.55), (20, 0.40), (12, 0.25), (6, 0.12)], 0.0) + S.bands(F.col("cc"), [(15, 0.15), (8, 0.08)], 0.0) + S.bands(F.col("sloc"), [(100, 0.08), (50, 0.04)], 0.0)
    x = metrics(spark, sf_dir).withColumn("risk", S.clamp(risk, 0.0, 1.0)).withColumn("w", F.greatest("cog", F.lit(1.0)))
    total = x.groupBy("repo").agg(F.sum("w").alias("tw"))  # then joined, so that a hot repo is no single window
    x = x.join(total, "repo").withColumn("a", F.round(F.col("risk") * F.col("w") / F.col("tw"), 8))
    return x.select("id", "repo", F.round("risk", 4).alias("risk"), "a").withColumnRenamed("a", "attributed")


def debt(m: DataFrame) -> DataFrame:
    """H.12-H.19: minutes per category and record in long form."""
    n = lambda c: F.floor(F.col(c)).cast("long")
    return m.select(
        "id",
        F.explode(
            F.array(
                F.struct(F.lit("reliability").alias("category"), F.when(F.col("p") >= 0.7, 120).when(F.col("p") >= 0.4, 60).when(F.col("p") >= 0.2, 30).otherwise(0).cast("long").alias("minutes")),
                F.struct(F.lit("maintainability").alias("category"), (n("n_complex") * 20 + n("n_long") * 30 + F.when(F.col("cc") > 30, 45).otherwise(0)).alias("minutes")),
                F.struct(F.lit("style").alias("category"), n("over_80").alias("minutes")),
            )
        ).alias("d"),
    ).select("id", "d.*")


def h12_debt(spark, sf_dir):
    """Sum, worst rating, yearly interest and payoff months of each record."""
    d = debt(probabilities(metrics(spark, sf_dir)))
    r = S.rating(F.col("minutes"))
    factor = F.when(r == "E", 3.0).when(r == "D", 2.0).when(r == "C", 1.0).when(r == "B", 0.5).otherwise(0.0)
    return d.groupBy("id").agg(F.sum("minutes").alias("total"), F.max(r).alias("worst"), F.round(0.005 * F.sum(F.col("minutes") * factor), 4).alias("interest")).withColumn("payoff", F.round(F.col("total") / 240, 4))


def meta(m: DataFrame) -> DataFrame:
    """H.20-H.22: the interaction features, unified risk, calibrated parts and dominant signal."""
    s, cd, b, pr = (F.col(c) for c in ("s", "cd", "b", "pr"))
    geo = F.cbrt(s * cd * b)
    x = m.withColumn("geo", geo).withColumn("u", S.clamp(0.35 * s + 0.25 * b + 0.20 * cd + 0.10 * pr + 0.10 * F.col("geo"), 0.0, 1.0))
    best = F.greatest(s, cd, b, pr)
    dominant = F.when(s == best, "security").when(cd == best, "complexity").when(b == best, "bug").otherwise("pattern")
    top = F.reverse(F.array_sort(F.array(*(F.struct(F.round(v, 6).alias("v"), F.lit(n).alias("n")) for n, v in {"s*b": s * b, "cd*b": cd * b, "pr*b": pr * b, "s*cd": s * cd, "s*pr": s * pr, "cd*pr": cd * pr, "geo": F.col("geo")}.items()))))
    return x.select(
        "id", F.round("u", 3).alias("risk"), F.round(0.8 * b + 0.2 * F.col("u"), 3).alias("bug_calibrated"), F.round(0.8 * s + 0.2 * F.col("u"), 3).alias("security_calibrated"),
        F.round(S.clamp(1 - F.abs(F.col("u") - 0.5) * 0.5, 0.5, 1.0), 3).alias("confidence"), dominant.alias("dominant"), F.array_join(F.transform(F.slice(top, 1, 3), lambda t: t["n"]), ",").alias("top3"),
    )


def h20_meta(spark, sf_dir):
    x = probabilities(metrics(spark, sf_dir))
    return meta(x.select("id", F.least(F.lit(1.0), F.col("n_past_bugs") / 10).alias("s"), S.clamp(1 - S.quality_score(_m()) / 100, 0.0, 1.0).alias("cd"), F.col("p").alias("b"), F.when(F.col("n_long") > 3, 0.8).otherwise(0.3).alias("pr")))


def h27_triage(spark, sf_dir, k: int = 20):
    """H.27, L.9: the k records with the greatest effort-aware risk, labelled by place and risk."""
    x = probabilities(metrics(spark, sf_dir))
    risk = 0.5 * F.least(F.lit(1.0), F.col("n_past_bugs") / 10) + 0.5 * F.col("p")
    x = x.select("id", F.round(risk, 6).alias("risk"), F.round(risk * (1 + 0.3 * F.sqrt(F.col("sloc") / 100)), 6).alias("effort"))
    top = x.orderBy(F.desc("effort"), "id").limit(k)
    place = F.row_number().over(W.orderBy(F.desc("effort"), "id"))
    return top.select("id", "risk", "effort", place.cast("long").alias("place"), F.when((place <= 5) & (F.col("risk") >= 0.4), "first").when(F.col("risk") >= 0.4, "next").otherwise("later").alias("label"))


def h1_overall(spark, sf_dir):
    """H.1-H.3: overall score (parts truncated, weights .25 .30 .15 .15 .05 .10), status, and the defect
    floor by critical findings; a record without findings counts as clean."""
    from quillmark.sources.tables import table

    f = table(spark, sf_dir, "security_finding").where("record_id is not null")
    sev = lambda s: F.count_if(F.lower("severity") == s).alias(s)
    c = f.groupBy(F.col("record_id").alias("file_id")).agg(sev("critical"), sev("high"), sev("medium"), F.count_if(F.col("vuln_type") == "debug_output").alias("dead"))
    sec = table(spark, sf_dir, "security_dataset").select(F.col("record_id").alias("file_id"), F.least(F.lit(100.0), F.coalesce("n_calls", F.lit(0)).cast("double") * 4).alias("complexity"), F.size(F.split(F.coalesce("source", F.lit("")), "\n")).alias("lines"))
    x = sec.join(c, "file_id", "left").fillna(0, ["critical", "high", "medium", "dead"])
    floor = F.when(F.col("critical") >= 3, 0.45).when(F.col("critical") >= 2, 0.30).otherwise(0.0)
    x = x.withColumns({"security": F.greatest(F.lit(0), 100 - 20 * F.col("critical") - 10 * F.col("high") - 4 * F.col("medium")), "bug": F.greatest(F.lit(0.2), floor), "dead_score": F.greatest(F.lit(0), 100 - F.floor(150 * F.col("dead") / F.col("lines")))})
    score = F.floor(0.25 * F.col("complexity") + 0.30 * F.col("security") + 0.15 * 100 + 0.15 * F.floor((1 - F.col("bug")) * 100) + 0.05 * F.col("dead_score") + 0.10 * 80)
    status = F.when(F.col("critical") > 0, "critical").when((F.col("high") > 0) | (F.col("complexity") < 60) | (F.col("bug") > 0.7), "action_required").otherwise("clean")
    return x.select("file_id", F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("long").alias("score"), status.alias("status"), F.round("bug", 4).alias("bug"))


def l13_summary(spark, sf_dir):
    """I.9, L.13: per repo the mean score of odd records, of even ones (the base), and the change."""
    q = metrics(spark, sf_dir).withColumn("q", S.quality_score(_m()))
    g = q.groupBy("repo").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(F.col("id") % 2 == 1, F.col("q"))), 2).alias("mean"), F.round(F.avg(F.when(F.col("id") % 2 == 0, F.col("q"))), 2).alias("base"))
    return g.withColumn("event", F.when(F.col("mean") < 50, "request_changes").when(F.col("mean") >= 80, "approve").otherwise("comment"))


QUERIES = {k: f for k, f in list(globals().items()) if k[0] in "hl" and k[1].isdigit()}


def _case(col: str, steps: list[tuple[float, float]], rest: float) -> str:
    return "(CASE " + " ".join(f"WHEN {col} > {a} THEN {b}::DOUBLE" for a, b in steps) + f" ELSE {rest}::DOUBLE END)"


_M = (
    f"{B}, m AS (SELECT id, repo, file, label, "
    + ", ".join(f"coalesce(features[{i}], 0.0) AS {n}" for i, n in enumerate(S.STATIC, 1))
    + ", " + ", ".join(f"coalesce(git.{n}, 0.0) AS {n}" for n in ("code_churn", "author_count", "n_past_bugs", "commit_freq", "n_files", "lines_touched"))
    + " FROM b)"
)
_ODDS = "(0.1::DOUBLE / 0.9::DOUBLE)" + "".join(f" * {_case(n, s, 1.0)}" for n, s in S.ODDS.items())
_GIT = "".join(f" * {_case(n, s, 1.0)}" for n, s in S.GIT_ODDS.items())
_P = (
    _M
    + f", o AS (SELECT *, {_ODDS} AS odds FROM m), p0 AS (SELECT *, round(greatest(0.02::DOUBLE, least(0.95::DOUBLE, odds / (1 + odds))), 3) AS base FROM o), p1 AS (SELECT *, base / (1 - base){_GIT} AS go FROM p0), pr AS (SELECT *, round(greatest(0.02::DOUBLE, least(0.95::DOUBLE, go / (1 + go))), 3) AS p FROM p1)"
)
_Q = "greatest(0.0, 100.0 - CASE WHEN cc > 10 THEN least(30.0, (cc - 10) * 1.5) ELSE 0 END - CASE WHEN cog > 15 THEN least(20.0, (cog - 15) * 0.8) ELSE 0 END - least(15.0, n_long * 5) - least(15.0, n_complex * 5) - least(10.0, over_80 * 0.5) - CASE WHEN bugs > 1 THEN least(10.0, bugs * 2) ELSE 0 END)"
_GR = lambda c: f"CASE WHEN {c} >= 90 THEN 'A' WHEN {c} >= 75 THEN 'B' WHEN {c} >= 60 THEN 'C' WHEN {c} >= 45 THEN 'D' ELSE 'F' END"
_RT = "CASE WHEN minutes <= 5 THEN 'A' WHEN minutes <= 30 THEN 'B' WHEN minutes <= 60 THEN 'C' WHEN minutes <= 120 THEN 'D' ELSE 'E' END"
ORACLE = {
    "h6_defect": f"WITH {_P} SELECT id, base, p, round(1 + p * log2(p) + (1 - p) * log2(1 - p), 5) AS confidence, CASE WHEN p >= 0.7 THEN 'high' WHEN p >= 0.4 THEN 'medium' ELSE 'low' END AS level FROM pr",
    "h9_factors": f"WITH {_M}, f AS (SELECT id, list_filter([CASE WHEN cc > 15 THEN 'cc' END, CASE WHEN cog > 20 THEN 'cog' END, CASE WHEN n_long > 5 THEN 'n_long' END, CASE WHEN code_churn > 150 THEN 'code_churn' END, CASE WHEN n_past_bugs > 3 THEN 'n_past_bugs' END, CASE WHEN author_count > 15 THEN 'author_count' END], lambda x: x IS NOT NULL) AS f FROM m) SELECT id, array_to_string(f, ',') AS factors, CAST(len(f) AS BIGINT) AS n FROM f",
    "h4_quality": f"WITH {_M}, q AS (SELECT id, round({_Q}, 4) AS q FROM m) SELECT id, q AS quality, {_GR('q')} AS grade FROM q",
    "h10_attribution": f"WITH {_M}, r AS (SELECT *, greatest(0.0, least(1.0, 0.10 + {_case('cog', [(30, 0.55), (20, 0.40), (12, 0.25), (6, 0.12)], 0.0)} + {_case('cc', [(15, 0.15), (8, 0.08)], 0.0)} + {_case('sloc', [(100, 0.08), (50, 0.04)], 0.0)})) AS risk, greatest(cog, 1.0) AS w FROM m) SELECT id, repo, round(risk, 4) AS risk, round(risk * w / sum(w) OVER (PARTITION BY repo), 8) AS attributed FROM r",
    "h12_debt": f"WITH {_P}, d AS (SELECT id, CASE WHEN p >= 0.7 THEN 120 WHEN p >= 0.4 THEN 60 WHEN p >= 0.2 THEN 30 ELSE 0 END AS minutes FROM pr UNION ALL SELECT id, floor(n_complex) * 20 + floor(n_long) * 30 + CASE WHEN cc > 30 THEN 45 ELSE 0 END FROM pr UNION ALL SELECT id, floor(over_80) FROM pr), r AS (SELECT *, {_RT} AS r FROM d) SELECT id, CAST(sum(minutes) AS BIGINT) AS total, max(r) AS worst, round(0.005 * sum(minutes * CASE r WHEN 'E' THEN 3.0 WHEN 'D' THEN 2.0 WHEN 'C' THEN 1.0 WHEN 'B' THEN 0.5 ELSE 0.0 END), 4) AS interest, round(sum(minutes) / 240, 4) AS payoff FROM r GROUP BY 1",
    "h20_meta": f"WITH {_P}, x AS (SELECT id, least(1.0, n_past_bugs / 10) AS s, greatest(0.0, least(1.0, 1 - {_Q} / 100)) AS cd, p AS b, CAST(CASE WHEN n_long > 3 THEN 0.8 ELSE 0.3 END AS DOUBLE) AS pr FROM pr), g AS (SELECT *, cbrt(s * cd * b) AS geo FROM x), u AS (SELECT *, greatest(0.0, least(1.0, 0.35 * s + 0.25 * b + 0.20 * cd + 0.10 * pr + 0.10 * geo)) AS u FROM g) SELECT id, round(u, 3) AS risk, round(0.8 * b + 0.2 * u, 3) AS bug_calibrated, round(0.8 * s + 0.2 * u, 3) AS security_calibrated, round(greatest(0.5, least(1.0, 1 - abs(u - 0.5) * 0.5)), 3) AS confidence, CASE greatest(s, cd, b, pr) WHEN s THEN 'security' WHEN cd THEN 'complexity' WHEN b THEN 'bug' ELSE 'pattern' END AS dominant, array_to_string(list_transform(list_reverse_sort([{{'v': round(s * b, 6), 'n': 's*b'}}, {{'v': round(cd * b, 6), 'n': 'cd*b'}}, {{'v': round(pr * b, 6), 'n': 'pr*b'}}, {{'v': round(s * cd, 6), 'n': 's*cd'}}, {{'v': round(s * pr, 6), 'n': 's*pr'}}, {{'v': round(cd * pr, 6), 'n': 'cd*pr'}}, {{'v': round(geo, 6), 'n': 'geo'}}])[:3], lambda t: t.n), ',') AS top3 FROM u",
    "h27_triage": f"WITH {_P}, x AS (SELECT id, sloc, 0.5 * least(1.0, n_past_bugs / 10) + 0.5 * p AS r FROM pr), y AS (SELECT id, round(r, 6) AS risk, round(r * (1 + 0.3 * sqrt(sloc / 100)), 6) AS effort FROM x), z AS (SELECT *, row_number() OVER (ORDER BY effort DESC, id) AS place FROM y) SELECT *, CASE WHEN place <= 5 AND risk >= 0.4 THEN 'first' WHEN risk >= 0.4 THEN 'next' ELSE 'later' END AS label FROM z WHERE place <= 20",
    "h1_overall": "WITH c AS (SELECT record_id AS file_id, count_if(lower(severity) = 'critical') AS critical, count_if(lower(severity) = 'high') AS high, count_if(lower(severity) = 'medium') AS medium, count_if(vuln_type = 'debug_output') AS dead FROM security_finding WHERE record_id IS NOT NULL GROUP BY 1), x AS (SELECT s.record_id AS file_id, least(100.0, coalesce(n_calls, 0) * 4.0) AS complexity, len(string_split(coalesce(source, ''), chr(10))) AS lines, coalesce(critical, 0) AS critical, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(dead, 0) AS dead FROM security_dataset s LEFT JOIN c ON c.file_id = s.record_id), y AS (SELECT *, greatest(0, 100 - 20 * critical - 10 * high - 4 * medium) AS security, CAST(greatest(0.2, CASE WHEN critical >= 3 THEN 0.45 WHEN critical >= 2 THEN 0.30 ELSE 0 END) AS DOUBLE) AS bug, greatest(0, 100 - floor(150 * dead / lines)) AS ds FROM x) SELECT file_id, CAST(greatest(0, least(100, floor(0.25::DOUBLE * complexity + 0.30::DOUBLE * security + 15 + 0.15::DOUBLE * floor((1 - bug) * 100) + 0.05::DOUBLE * ds + 8))) AS BIGINT) AS score, CASE WHEN critical > 0 THEN 'critical' WHEN high > 0 OR complexity < 60 OR bug > 0.7 THEN 'action_required' ELSE 'clean' END AS status, round(bug, 4) AS bug FROM y",
    "l13_summary": f"WITH {_M}, q AS (SELECT id, repo, {_Q} AS q FROM m), g AS (SELECT repo, count(*) AS n, round(avg(CASE WHEN id % 2 = 1 THEN q END), 2) AS mean, round(avg(CASE WHEN id % 2 = 0 THEN q END), 2) AS base FROM q GROUP BY 1) SELECT *, CASE WHEN mean < 50 THEN 'request_changes' WHEN mean >= 80 THEN 'approve' ELSE 'comment' END AS event FROM g",
}
