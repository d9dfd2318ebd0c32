"""Review-history analytics: aggregates, windows, retention, rate limits (sections J, K, I, C, Q)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmark.sources.tables import table


def history(spark, sf_dir) -> DataFrame:
    """entry_id, file_id, repo, kind, score, ts: one reviewed file a row (events stand in for reviews)."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("entry_id"), F.col("user_id").alias("file_id"), (F.col("user_id") % 20).alias("repo"), F.col("event_type").alias("kind"),
        F.greatest(F.lit(0.0), F.lit(100.0) - F.col("value")).alias("score"), "ts",
    )


H = "h AS (SELECT event_id AS entry_id, user_id AS file_id, user_id % 20 AS repo, event_type AS kind, greatest(0.0, 100.0 - value) AS score, ts FROM events)"


def _last(h: DataFrame) -> DataFrame:
    return F.broadcast(h.agg(F.max("ts").alias("now")))  # one row


def j1_stats(spark, sf_dir):
    """J.1, J.2, J.10: count, mean, least, greatest, sum, critical (below 40) and last-week entries; nulls on empty input."""
    h = history(spark, sf_dir)
    return h.join(_last(h)).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 4).alias("avg_score"), F.round(F.min("score"), 4).alias("min_score"), F.round(F.max("score"), 4).alias("max_score"),
        F.round(F.sum(F.col("score").cast("decimal(20,6)")).cast("double"), 2).alias("sum_score"), F.count_if(F.col("score") < 40).alias("n_critical"),
        F.count_if(F.col("ts") > F.col("now") - F.expr("INTERVAL 7 DAYS")).alias("last_week"),
    )


def j3_verdicts(spark, sf_dir):
    """J.3, J.14, C.18: count per kind with its label (1, 0, -1)."""
    label = F.when(F.col("kind").isin("purchase", "signup"), 1).when(F.col("kind") == "error", -1).otherwise(0)
    return history(spark, sf_dir).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.first(label).cast("long").alias("label"))


def j4_progress(spark, sf_dir, threshold: int = 500):
    """J.4: progress of every task towards its threshold; tasks without rows have 0."""
    tasks = spark.createDataFrame([("error",), ("purchase",), ("none",)], "task string")
    n = history(spark, sf_dir).groupBy(F.col("kind").alias("task")).agg(F.count(F.lit(1)).alias("n"))
    out = tasks.join(n, "task", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    return out.withColumn("progress", F.round(F.least(F.lit(100.0), F.col("n") * 100.0 / threshold), 2))


def j11_severity(spark, sf_dir):
    """J.11, J.12: worst severity and number of issues of each file."""
    rank = F.when(F.col("score") < 20, 0).when(F.col("score") < 40, 1).when(F.col("score") < 60, 2).otherwise(3)
    g = history(spark, sf_dir).groupBy("file_id").agg(F.min(rank).alias("r"), F.count_if(F.col("score") < 60).alias("n_issues"))
    return g.select("file_id", F.when(F.col("r") == 0, "critical").when(F.col("r") == 1, "high").when(F.col("r") == 2, "medium").otherwise("low").alias("severity"), "n_issues")


def j13_daily(spark, sf_dir):
    """J.13: mean score per day."""
    return history(spark, sf_dir).groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.round(F.avg("score"), 4).alias("avg_score"), F.count(F.lit(1)).alias("n"))


def j15_unpivot(spark, sf_dir):
    """J.15: sums per issue category, greatest first; categories without any are dropped."""
    g = history(spark, sf_dir).agg(
        F.count_if(F.col("kind") == "error").alias("errors"), F.count_if(F.col("score") < 20).alias("very_low"), F.count_if(F.col("score") > 1000).alias("impossible")
    )
    return g.unpivot([], ["errors", "very_low", "impossible"], "category", "n").where("n > 0")


def j16_histogram(spark, sf_dir):
    """J.16: five equal buckets of the score, the last one closed."""
    b = F.least(F.lit(4), F.floor(F.col("score") / 20)).cast("long")
    return history(spark, sf_dir).groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def j17_shares(spark, sf_dir, most: int = 8):
    """J.17: the commonest repos with their share of all rows; ties by repo."""
    g = history(spark, sf_dir).groupBy("repo").agg(F.count(F.lit(1)).alias("n"))
    total = F.broadcast(g.agg(F.sum("n").alias("total")))  # one row
    return g.join(total).orderBy(F.desc("n"), "repo").limit(most).select("repo", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def j18_calendar(spark, sf_dir, weeks: int = 5):
    """J.18: calendar of entries a day over whole weeks with zero fill; intensity 0..4 relative to the busiest day."""
    h = history(spark, sf_dir)
    n = h.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    end = n.agg(F.max("day").alias("last"))
    spine = end.select(F.explode(F.sequence(F.date_sub("last", weeks * 7 - 1), F.col("last"))).alias("day"))
    j = spine.join(n, "day", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    top = j.agg(F.max("n").alias("top"))
    return j.join(F.broadcast(top)).select("day", "n", F.when(F.col("top") == 0, 0).otherwise(F.ceil(4 * F.col("n") / F.col("top"))).cast("long").alias("intensity"))


def j19_repos(spark, sf_dir):
    """J.19, J.20: rollup per repo: entries, files, mean score, open issues."""
    return history(spark, sf_dir).groupBy("repo").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("file_id").alias("n_files"), F.round(F.avg("score"), 4).alias("avg_score"), F.count_if(F.col("score") < 60).alias("open_issues")
    )


def k7_forecast(spark, sf_dir):
    """K.5, K.7: least-squares trend of each file's scores over their index; steps until 60 is crossed where the trend falls."""
    h = history(spark, sf_dir)
    x = (F.row_number().over(W.partitionBy("file_id").orderBy("ts", "entry_id")) - 1).cast("double")
    g = h.withColumn("x", x).groupBy("file_id").agg(
        F.regr_slope("score", "x").alias("slope"), F.regr_intercept("score", "x").alias("intercept"), F.count(F.lit(1)).alias("n"), F.max_by("score", F.struct("ts", "entry_id")).alias("last")
    )
    steps = F.when((F.col("slope") < 0) & (F.col("last") > 60), F.ceil((60 - F.col("intercept")) / F.col("slope") - (F.col("n") - 1)).cast("double") + F.lit(0.0))
    return g.select("file_id", F.round("slope", 5).alias("slope"), F.round("intercept", 3).alias("intercept"), steps.alias("steps"))


def k8_timelines(spark, sf_dir, most: int = 5):
    """K.8: first and last score of the files with most runs (two at least)."""
    key = F.struct("ts", "entry_id")
    g = history(spark, sf_dir).groupBy("file_id").agg(F.count(F.lit(1)).alias("n"), F.min_by("score", key).alias("first"), F.max_by("score", key).alias("last"))
    return g.where("n >= 2").orderBy(F.desc("n"), "file_id").limit(most).select("file_id", "n", F.round("first", 4).alias("first"), F.round("last", 4).alias("last"), F.round(F.col("last") - F.col("first"), 4).alias("delta"))


def k9_regressions(spark, sf_dir):
    """K.9, K.10: files whose latest score lies 10 or more under their best (with the value before), or 5 or more over their first."""
    w = W.partitionBy("file_id").orderBy("ts", "entry_id")
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    h = history(spark, sf_dir).select(
        "file_id", "score", F.max("score").over(whole).alias("best"), F.first("score").over(whole).alias("first"), F.lag("score").over(w).alias("before"), F.lead("entry_id").over(w).alias("next")
    )
    h = h.where("next is null")
    return h.select("file_id", F.round("score", 4).alias("latest"), F.round("before", 4).alias("before"), (F.col("best") - F.col("score") >= 10).alias("regressed"), (F.col("score") - F.col("first") >= 5).alias("improved"))


def k11_latest(spark, sf_dir):
    """K.11: latest entry of each (repo, file)."""
    w = W.partitionBy("repo", "file_id").orderBy(F.desc("ts"), F.desc("entry_id"))
    return history(spark, sf_dir).withColumn("n", F.row_number().over(w)).where("n = 1").select("repo", "file_id", "entry_id", F.round("score", 4).alias("score"))


def k3_trajectory(spark, sf_dir):
    """K.3, K.4, K.12: weighted slope over normalised time (recent entries weigh more), R2 with the off-centre
    intercept, class by a band of 3, forecast clipped to 0..1000; at least three entries of a file."""
    h = history(spark, sf_dir)
    ends = W.partitionBy("file_id")
    sec = F.col("ts").cast("timestamp").cast("double")
    h = h.withColumn("s", sec).withColumns({"lo": F.min("s").over(ends), "hi": F.max("s").over(ends)})
    t = F.try_divide(F.col("s") - F.col("lo"), F.col("hi") - F.col("lo"))
    h = h.withColumn("t", F.coalesce(t, F.lit(0.0))).withColumn("w", F.exp(-2.0 * (1.0 - F.col("t"))))
    s = lambda c: F.sum(c)
    g = h.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("n"), s(F.col("w")).alias("sw"), s(F.col("w") * F.col("t")).alias("swt"), s(F.col("w") * F.col("score")).alias("swy"),
        s(F.col("w") * F.col("t") * F.col("t")).alias("swtt"), s(F.col("w") * F.col("t") * F.col("score")).alias("swty"), F.avg("score").alias("mean"),
        F.max_by("score", F.struct("ts", "entry_id")).alias("last"), F.sum("t").alias("st"), F.sum(F.col("t") * F.col("t")).alias("stt"), F.sum("score").alias("sy"),
        F.sum(F.col("score") * F.col("score")).alias("syy"), F.sum(F.col("t") * F.col("score")).alias("sty"),
    ).where("n >= 3")
    slope = F.try_divide(F.col("swty") - F.col("swt") * F.col("swy") / F.col("sw"), F.col("swtt") - F.col("swt") * F.col("swt") / F.col("sw"))
    g = g.withColumn("slope", F.coalesce(slope, F.lit(0.0))).withColumn("b", F.col("mean") - F.col("slope") * 0.5)
    res = F.col("syy") - 2 * F.col("b") * F.col("sy") - 2 * F.col("slope") * F.col("sty") + F.col("n") * F.col("b") * F.col("b") + 2 * F.col("b") * F.col("slope") * F.col("st") + F.col("slope") * F.col("slope") * F.col("stt")
    tot = F.col("syy") - F.col("n") * F.col("mean") * F.col("mean")
    r2 = F.greatest(F.lit(0.0), F.lit(1.0) - F.coalesce(F.try_divide(res, tot), F.lit(1.0)))
    kind = F.when(F.col("slope") > 3, "improving").when(F.col("slope") < -3, "degrading").otherwise("stable")
    return g.select("file_id", F.round("slope", 4).alias("slope"), F.round(r2, 4).alias("r2"), kind.alias("kind"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1000.0), F.col("last") + F.col("slope"))), 4).alias("forecast"))


def k13_decay(spark, sf_dir, lam: float = 2.0):
    """K.13: recency weights exp(-lambda * age in years), normalised to mean 1."""
    h = history(spark, sf_dir)
    age = F.datediff(F.to_date("now"), F.to_date("ts")) / 365.0
    h = h.join(_last(h)).withColumn("w", F.exp(-lam * age))
    mean = h.agg(F.avg("w").alias("mean"))
    return h.join(F.broadcast(mean)).select("entry_id", F.round(F.col("w") / F.col("mean"), 6).alias("weight"))


def k19_retention(spark, sf_dir, cap: int = 500, per_repo: int = 200):
    """K.19: the newest ``cap`` entries, and of each repo at least its newest ``per_repo``.  The place of an entry
    among all comes from the days' counts, so no task sorts the whole table."""
    h = history(spark, sf_dir).withColumn("day", F.to_date("ts"))
    days = h.groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    newer = days.withColumn("newer", F.coalesce(F.sum("n").over(W.orderBy(F.desc("day")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    h = h.join(newer.select("day", "newer"), "day")
    place = F.col("newer") + F.row_number().over(W.partitionBy("day").orderBy(F.desc("ts"), F.desc("entry_id")))
    own = F.row_number().over(W.partitionBy("repo").orderBy(F.desc("ts"), F.desc("entry_id")))
    return h.select("entry_id", "repo", place.alias("place"), own.alias("own")).where((F.col("place") <= cap) | (F.col("own") <= per_repo)).select("entry_id", "repo")


def i12_previous(spark, sf_dir):
    """I.5, I.12: the entry before each one of the same file (as-of), with the change of score; first entries have none."""
    w = W.partitionBy("file_id").orderBy("ts", "entry_id")
    before = history(spark, sf_dir).select("entry_id", F.lag("entry_id").over(w).alias("previous"), F.round(F.col("score") - F.lag("score").over(w), 4).alias("delta"))
    return before.where("previous is not null")


def i10_compare(spark, sf_dir):
    """I.10: two repos metric by metric, winner (ties to the first) and distance."""
    g = j19_repos(spark, sf_dir).select("repo", F.col("n").cast("double").alias("entries"), "avg_score", F.col("open_issues").cast("double").alias("open_issues"))
    long = g.unpivot(["repo"], ["entries", "avg_score", "open_issues"], "metric", "v")
    a, b = long.where("repo = 1").select("metric", F.col("v").alias("a")), long.where("repo = 2").select("metric", F.col("v").alias("b"))
    return a.join(b, "metric").select("metric", "a", "b", F.when(F.col("a") >= F.col("b"), "a").otherwise("b").alias("winner"), F.round(F.abs(F.col("a") - F.col("b")), 4).alias("distance"))


def i11_pending(spark, sf_dir):
    """I.11, A.14, I.15: files with an entry that has no feedback (anti join, then semi join)."""
    h = history(spark, sf_dir)
    feedback = h.where("kind = 'purchase'").select("entry_id")
    open_ = h.where("score < 30").join(feedback, "entry_id", "left_anti").select("file_id").distinct()
    return h.select("file_id").distinct().join(open_, "file_id", "left_semi")


def c26_range(spark, sf_dir, days: int = 3):
    """C.26: entries of the last days of each repo, or all of them where the range is empty."""
    h = history(spark, sf_dir)
    recent = F.col("ts") >= F.col("now") - F.expr(f"INTERVAL {days} DAYS")
    n = F.count_if(recent).over(W.partitionBy("repo"))
    return h.join(_last(h)).withColumn("in_range", n).where(recent | (F.col("in_range") == 0)).groupBy("repo").agg(F.count(F.lit(1)).alias("n"))


def c27_urgent(spark, sf_dir):
    """C.27: urgent entries: critical, or high with a score under 60."""
    h = history(spark, sf_dir)
    sev = F.when(F.col("score") < 20, "critical").when(F.col("kind") == "error", "high").otherwise("low")
    return h.select("entry_id", sev.alias("severity"), "score").where("severity = 'critical' or (severity = 'high' and score < 60)").select("entry_id", "severity")


def q3_rate_limit(spark, sf_dir, seconds: int = 3600, most: int = 3):
    """Q.3: arrivals of each client in the window that ends with each one, and whether the limit is passed."""
    h = history(spark, sf_dir).withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")))
    n = F.count(F.lit(1)).over(W.partitionBy("file_id").orderBy("s").rangeBetween(-seconds * 1_000_000, 0))
    return h.select("entry_id", n.alias("n"), (n > most).alias("limited"))


def q5_cache(spark, sf_dir, size: int = 200, hours: int = 24):
    """Q.5, Q.6: what a store of the newest ``size`` entries a repo with a life of ``hours`` still holds."""
    h = history(spark, sf_dir)
    place = F.row_number().over(W.partitionBy("repo").orderBy(F.desc("ts"), F.desc("entry_id")))
    return h.join(_last(h)).where(F.col("ts") > F.col("now") - F.expr(f"INTERVAL {hours} HOURS")).withColumn("place", place).where(F.col("place") <= size).select("repo", "entry_id")


def q7_triggers(spark, sf_dir, every: int = 50):
    """Q.7: the entries at which each kind's counter reaches a multiple of ``every``.  Numbered in chunks of days."""
    h = history(spark, sf_dir).withColumn("day", F.to_date("ts"))
    days = h.groupBy("kind", "day").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("kind").orderBy("day").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    h = h.join(days.withColumn("before", before).drop("n"), ["kind", "day"])
    n = F.col("before") + F.row_number().over(W.partitionBy("kind", "day").orderBy("ts", "entry_id"))
    return h.select("kind", "entry_id", n.alias("n")).where(F.col("n") % every == 0)


QUERIES = {k: f for k, f in list(globals().items()) if k[0] in "jkicq" and k[1].isdigit()}

_NOW = ", now AS (SELECT max(ts) AS now FROM h)"
ORACLE = {
    "j1_stats": f"WITH {H}{_NOW} SELECT count(*) AS n, round(avg(score), 4) AS avg_score, round(min(score), 4) AS min_score, round(max(score), 4) AS max_score, round(CAST(sum(CAST(score AS DECIMAL(20,6))) AS DOUBLE), 2) AS sum_score, CAST(count_if(score < 40) AS BIGINT) AS n_critical, CAST(count_if(ts > now - INTERVAL 7 DAY) AS BIGINT) AS last_week FROM h, now",
    "j3_verdicts": f"WITH {H} SELECT kind, count(*) AS n, CAST(CASE WHEN kind IN ('purchase','signup') THEN 1 WHEN kind = 'error' THEN -1 ELSE 0 END AS BIGINT) AS label FROM h GROUP BY kind",
    "j4_progress": f"WITH {H}, t(task) AS (VALUES ('error'), ('purchase'), ('none')) SELECT task, count(entry_id) AS n, round(least(100.0, count(entry_id) * 100.0 / 500), 2) AS progress FROM t LEFT JOIN h ON kind = task GROUP BY 1",
    "j11_severity": f"WITH {H} SELECT file_id, CASE WHEN min(score) < 20 THEN 'critical' WHEN min(score) < 40 THEN 'high' WHEN min(score) < 60 THEN 'medium' ELSE 'low' END AS severity, CAST(count_if(score < 60) AS BIGINT) AS n_issues FROM h GROUP BY 1",
    "j13_daily": f"WITH {H} SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, round(avg(score), 4) AS avg_score, count(*) AS n FROM h GROUP BY 1",
    "j15_unpivot": f"WITH {H} SELECT 'errors' AS category, count(*) AS n FROM h WHERE kind = 'error' UNION ALL SELECT 'very_low', count(*) FROM h WHERE score < 20",
    "j16_histogram": f"WITH {H} SELECT CAST(least(4, floor(score / 20)) AS BIGINT) AS bucket, count(*) AS n FROM h GROUP BY 1",
    "j17_shares": f"WITH {H} SELECT repo, count(*) AS n, round(count(*) / (SELECT count(*) FROM h), 6) AS share FROM h GROUP BY 1 ORDER BY n DESC, repo LIMIT 8",
    "j18_calendar": f"WITH {H}, n AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM h GROUP BY 1), s AS (SELECT unnest(range((SELECT max(day) FROM n) - INTERVAL 34 DAY, (SELECT max(day) FROM n) + INTERVAL 1 DAY, INTERVAL 1 DAY))::DATE AS day), j AS (SELECT day, coalesce(n, 0) AS n FROM s LEFT JOIN n USING (day)) SELECT day, n, CAST(ceil(4.0 * n / max(n) OVER ()) AS BIGINT) AS intensity FROM j",
    "j19_repos": f"WITH {H} SELECT repo, count(*) AS n, count(DISTINCT file_id) AS n_files, round(avg(score), 4) AS avg_score, CAST(count_if(score < 60) AS BIGINT) AS open_issues FROM h GROUP BY 1",
    "k7_forecast": f"WITH {H}, x AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY ts, entry_id) - 1 AS x FROM h), g AS (SELECT file_id, regr_slope(score, x) AS slope, regr_intercept(score, x) AS intercept, count(*) AS n, arg_max(score, x) AS last FROM x GROUP BY 1) SELECT file_id, round(slope, 5) AS slope, round(intercept, 3) AS intercept, CASE WHEN slope < 0 AND last > 60 THEN CAST(ceil((60 - intercept) / slope - (n - 1)) AS DOUBLE) + 0.0 END AS steps FROM g",
    "k8_timelines": f"WITH {H}, x AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY ts, entry_id) AS x FROM h), g AS (SELECT file_id, count(*) AS n, arg_min(score, x) AS first, arg_max(score, x) AS last FROM x GROUP BY 1 HAVING count(*) >= 2 ORDER BY n DESC, file_id LIMIT 5) SELECT file_id, n, round(first, 4) AS first, round(last, 4) AS last, round(last - first, 4) AS delta FROM g",
    "k9_regressions": f"WITH {H}, x AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY ts, entry_id) AS x FROM h), g AS (SELECT file_id, max(score) AS best, arg_min(score, x) AS first, arg_max(score, x) AS latest, count(*) AS n FROM x GROUP BY 1) SELECT g.file_id, round(latest, 4) AS latest, round(p.score, 4) AS before, best - latest >= 10 AS regressed, latest - first >= 5 AS improved FROM g LEFT JOIN x p ON p.file_id = g.file_id AND p.x = n - 1",
    "k11_latest": f"WITH {H} SELECT repo, file_id, entry_id, round(score, 4) AS score FROM h QUALIFY row_number() OVER (PARTITION BY repo, file_id ORDER BY ts DESC, entry_id DESC) = 1",
    "k3_trajectory": f"WITH {H}, t AS (SELECT *, coalesce((epoch_us(ts) - min(epoch_us(ts)) OVER p) / nullif(max(epoch_us(ts)) OVER p - min(epoch_us(ts)) OVER p, 0), 0.0) AS t, row_number() OVER (PARTITION BY file_id ORDER BY ts, entry_id) AS x FROM h WINDOW p AS (PARTITION BY file_id)), w AS (SELECT *, exp(-2.0 * (1.0 - t)) AS w FROM t), a AS (SELECT file_id, count(*) AS n, coalesce((sum(w*t*score) - sum(w*t)*sum(w*score)/sum(w)) / nullif(sum(w*t*t) - sum(w*t)*sum(w*t)/sum(w), 0), 0.0) AS slope, avg(score) AS mean, arg_max(score, x) AS last FROM w GROUP BY 1 HAVING count(*) >= 3), r AS (SELECT a.file_id, any_value(slope) AS slope, any_value(last) AS last, sum(power(score - (mean - slope * 0.5 + slope * t), 2)) AS res, sum(power(score - mean, 2)) AS tot FROM a JOIN w USING (file_id) GROUP BY 1) SELECT file_id, round(slope, 4) AS slope, round(greatest(0.0, 1.0 - coalesce(res / nullif(tot, 0), 1.0)), 4) AS r2, CASE WHEN slope > 3 THEN 'improving' WHEN slope < -3 THEN 'degrading' ELSE 'stable' END AS kind, round(greatest(0.0, least(1000.0, last + slope)), 4) AS forecast FROM r",
    "k13_decay": f"WITH {H}{_NOW}, w AS (SELECT entry_id, exp(-2.0 * date_diff('day', CAST(ts AS DATE), CAST(now AS DATE)) / 365.0) AS w FROM h, now) SELECT entry_id, round(w / avg(w) OVER (), 6) AS weight FROM w",
    "k19_retention": f"WITH {H}, x AS (SELECT entry_id, repo, row_number() OVER (ORDER BY ts DESC, entry_id DESC) AS place, row_number() OVER (PARTITION BY repo ORDER BY ts DESC, entry_id DESC) AS own FROM h) SELECT entry_id, repo FROM x WHERE place <= 500 OR own <= 200",
    "i12_previous": f"WITH {H} SELECT entry_id, lag(entry_id) OVER w AS previous, round(score - lag(score) OVER w, 4) AS delta FROM h WINDOW w AS (PARTITION BY file_id ORDER BY ts, entry_id) QUALIFY previous IS NOT NULL",
    "i10_compare": f"WITH {H}, g AS (SELECT repo, CAST(count(*) AS DOUBLE) AS entries, round(avg(score), 4) AS avg_score, CAST(count_if(score < 60) AS DOUBLE) AS open_issues FROM h GROUP BY 1), l AS (UNPIVOT g ON entries, avg_score, open_issues INTO NAME metric VALUE v) SELECT a.metric, a.v AS a, b.v AS b, CASE WHEN a.v >= b.v THEN 'a' ELSE 'b' END AS winner, round(abs(a.v - b.v), 4) AS distance FROM l a JOIN l b ON a.metric = b.metric AND a.repo = 1 AND b.repo = 2",
    "i11_pending": f"WITH {H} SELECT DISTINCT file_id FROM h WHERE score < 30 AND kind <> 'purchase'",
    "c26_range": f"WITH {H}{_NOW}, r AS (SELECT repo, count_if(ts >= now - INTERVAL 3 DAY) AS k, count(*) AS n FROM h, now GROUP BY 1) SELECT repo, CAST(CASE WHEN k = 0 THEN n ELSE k END AS BIGINT) AS n FROM r",
    "c27_urgent": f"WITH {H}, s AS (SELECT entry_id, score, CASE WHEN score < 20 THEN 'critical' WHEN kind = 'error' THEN 'high' ELSE 'low' END AS severity FROM h) SELECT entry_id, severity FROM s WHERE severity = 'critical' OR (severity = 'high' AND score < 60)",
    "q3_rate_limit": f"WITH {H}, n AS (SELECT entry_id, count(*) OVER (PARTITION BY file_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECOND PRECEDING AND CURRENT ROW) AS n FROM h) SELECT entry_id, n, n > 3 AS limited FROM n",
    "q5_cache": f"WITH {H}{_NOW} SELECT repo, entry_id FROM h, now WHERE ts > now - INTERVAL 24 HOUR QUALIFY row_number() OVER (PARTITION BY repo ORDER BY ts DESC, entry_id DESC) <= 200",
    "q7_triggers": f"WITH {H}, n AS (SELECT kind, entry_id, row_number() OVER (PARTITION BY kind ORDER BY ts, entry_id) AS n FROM h) SELECT kind, entry_id, n FROM n WHERE n % 50 = 0",
}
