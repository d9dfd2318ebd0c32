"""Evaluation statistics over (id, group, y, score, size): ranking, calibration, shift, significance (L, N, O).

Ranks over all rows are never taken by one task: rows are numbered within ranges of (score, id), and ranges are
offset by those before (``skew.in_order``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmark.functions.normalize import repo_key
from quillmark.operators.skew import in_order, join_heavy
from quillmark.sources.tables import materialize, table


def scored(spark, sf_dir) -> DataFrame:
    """id, grp, y, score, size: bug records with their label and a score from entropy and churn."""
    t = table(spark, sf_dir, "bug_dataset").where("label is not null")
    g = lambda c: F.coalesce(F.col(f"git_features.{c}"), F.lit(0.0))
    score = F.round(F.least(F.lit(1.0), 0.3 * g("entropy") / 3 + 0.4 * g("n_past_bugs") / 10 + 0.3 * g("code_churn") / 200), 4)
    return t.select(F.col("record_id").alias("id"), F.coalesce(repo_key(F.col("repo")), F.lit("none")).alias("grp"), F.col("label").cast("int").alias("y"), score.alias("score"), F.greatest(F.lit(1.0), g("lines_touched")).alias("size"))


S = r"""s AS (SELECT record_id AS id, coalesce(nullif(regexp_extract(regexp_replace(lower(trim(repo)), '(?:/|\.git)+$', ''), '([^/:@\s]+)/([^/\s]+)$', 0), ''), 'none') AS grp, CAST(label AS INT) AS y,
 round(least(1.0, 0.3 * coalesce(git_features.entropy, 0.0) / 3 + 0.4 * coalesce(git_features.n_past_bugs, 0.0) / 10 + 0.3 * coalesce(git_features.code_churn, 0.0) / 200), 4) AS score, greatest(1.0, coalesce(git_features.lines_touched, 0.0)) AS size FROM bug_dataset WHERE label IS NOT NULL)"""
R = S + ", r AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rn FROM s), p AS (SELECT *, sum(y) OVER (ORDER BY rn) AS hits, (SELECT count(*) FROM s) AS n, (SELECT sum(y) FROM s) AS pos FROM r)"


def ranked(df: DataFrame, value: str = "score", sums: tuple[str, ...] = ("y",), parts: int | None = None) -> DataFrame:
    """rn (1 for the greatest ``value``, ties by id), n (all rows) and cum_<c> (running sum of c up to the row) for each of ``sums``."""
    return in_order(df, [F.desc(value), F.asc("id")], sums, parts)


def average_ranks(df: DataFrame, value: str, part: list[str] | None = None, out: str = "rank") -> DataFrame:
    """Average rank (ties share their mean) of ``value`` ascending within ``part``; rows without a value have none and go.

    Ranks come from the counts of the distinct values in one order over all parts, cut into ranges, less the count
    before the part begins; values that many rows share are joined where those rows lie.
    """
    part = part or []
    df = df.where(F.col(value).isNotNull())
    counts = in_order(df.groupBy(*part, value).agg(F.count(F.lit(1)).alias("_c")), [F.asc(c) for c in [*part, value]], ["_c"])
    ranks = materialize(counts.withColumn("_before", F.col("cum__c") - F.col("_c")).drop("rn", "n", "cum__c"), "ranks")
    size = ranks.agg(F.count(F.lit(1)).alias("k"), F.coalesce(F.sum("_c"), F.lit(0)).alias("n")).first()
    start = F.lit(0)
    if part:
        first = ranks.groupBy(*part).agg(F.min("_before").alias("_start"), F.count(F.lit(1)).alias("_k"))
        ranks, start = join_heavy(ranks, first, part, "_k", size.k).drop("_k"), F.col("_start")
    ranks = ranks.select(*part, value, "_c", (F.col("_before") - start + (F.col("_c") + 1) / 2).alias(out))
    return join_heavy(df, ranks, [*part, value], "_c", size.n).drop("_c")


def l2_at_k(spark, sf_dir, ks: tuple[int, ...] = (5, 10, 20, 50, 100)):
    """L.2, L.3, L.8, L.10: precision, recall and lift at each k."""
    r = ranked(scored(spark, sf_dir))
    k = spark.createDataFrame([(x,) for x in ks], "k int")
    pos = r.agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("n"))
    top = r.where(F.col("rn") <= max(ks)).select("rn", "y")
    j = k.join(F.broadcast(top), F.col("rn") <= F.col("k"), "left").groupBy("k").agg(F.sum("y").alias("hits")).join(F.broadcast(pos))
    prec = F.col("hits") / F.col("k")
    return j.select("k", F.round(prec, 6).alias("precision"), F.round(F.col("hits") / F.col("pos"), 6).alias("recall"), F.round(prec / (F.col("pos") / F.col("n")), 6).alias("lift"))


def l4_ap(spark, sf_dir):
    """L.4: average precision."""
    r = ranked(scored(spark, sf_dir))
    return r.agg(F.round(F.avg(F.when(F.col("y") == 1, F.col("cum_y") / F.col("rn"))), 6).alias("average_precision"))


def l5_effort(spark, sf_dir):
    """L.5, L.6, L.11: share of positives in the first 20 % of rows, and the share of rows that reaches 80 % of positives."""
    r = ranked(scored(spark, sf_dir))
    pos = F.broadcast(r.agg(F.sum("y").alias("pos")))
    r = r.join(pos)
    cut = F.greatest(F.lit(1), F.floor(F.col("n") * 0.2))
    return r.agg(
        F.round(F.sum(F.when(F.col("rn") <= cut, F.col("y")).otherwise(0)) / F.first("pos"), 6).alias("pofb20"),
        F.round(F.coalesce(F.min(F.when(F.col("cum_y") >= F.ceil(0.8 * F.col("pos")), F.col("rn"))) / F.first("n"), F.lit(1.0)), 6).alias("effort80"),
    )


def l7_curve(spark, sf_dir):
    """L.7: the best possible curve at 101 shares of effort."""
    n = scored(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"))
    return n.select("n", "pos", F.explode(F.sequence(F.lit(0), F.lit(100))).alias("pct")).select("pct", F.round(F.least(F.lit(1.0), F.floor(F.col("n") * F.col("pct") / 100) / F.col("pos")), 6).alias("share"))


def _area(df: DataFrame) -> DataFrame:
    """Trapezoid areas under hits against size, from rows with cum_y and cum_size."""
    return df.agg((F.sum((F.col("cum_y") - F.col("y") / 2.0) * F.col("size")) / (F.sum("size") * F.sum("y"))).alias("area"))


def o1_popt(spark, sf_dir):
    """O.1: normalised area of the effort curve between the reversed model order and the best order (by density of positives)."""
    s = scored(spark, sf_dir)
    model = _area(ranked(s, "score", ("y", "size"))).withColumnRenamed("area", "model")
    worst = _area(ranked(s.withColumn("v", -F.col("score")).withColumn("id", -F.col("id")), "v", ("y", "size"))).withColumnRenamed("area", "worst")
    best = _area(ranked(s.withColumn("v", F.col("y") / F.col("size")), "v", ("y", "size"))).withColumnRenamed("area", "best")
    j = model.join(worst).join(best)
    v = 1 - (F.col("best") - F.col("model")) / (F.col("best") - F.col("worst"))
    return j.select(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)), 5).alias("popt"))


def o2_pofb_size(spark, sf_dir, pct: float = 0.2):
    """O.2: positives found until the sizes before a row reach a share of all."""
    r = ranked(scored(spark, sf_dir), "score", ("y", "size"))
    total = F.broadcast(r.agg(F.sum("size").alias("total"), F.sum("y").alias("pos")))
    r = r.join(total).where(F.col("cum_size") - F.col("size") < pct * F.col("total"))
    return r.agg(F.round(F.sum("y") / F.first("pos"), 6).alias("pofb"))


def o8_ece(spark, sf_dir, bins: int = 10):
    """O.8, O.9: reliability table of half-open bins (a score of 1 falls in none) with each bin's share of the ECE; empty bins stay."""
    s = scored(spark, sf_dir)
    g = s.where("score < 1").groupBy(F.floor(F.col("score") * bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("rate"), F.avg("score").alias("mean_score"))
    spine = spark.range(bins).select(F.col("id").alias("bin"))
    total = F.broadcast(s.agg(F.count(F.lit(1)).alias("total")))
    j = spine.join(g, "bin", "left").join(total)
    return j.select("bin", F.coalesce("n", F.lit(0)).alias("n"), F.round("rate", 6).alias("rate"), F.round("mean_score", 6).alias("mean_score"), F.round(F.coalesce(F.col("n") / F.col("total") * F.abs(F.col("rate") - F.col("mean_score")), F.lit(0.0)), 6).alias("ece_part"))


def o10_ece_parts(spark, sf_dir):
    """O.10: ECE overall, in distribution and out of it (size over 600) as grouping sets."""
    s = scored(spark, sf_dir).where("score < 1").withColumn("part", F.when(F.col("size") > 100, "ood").otherwise("in"))
    both = s.withColumn("part", F.explode(F.array("part", F.lit("all"))))
    b = both.groupBy("part", F.floor(F.col("score") * 10).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.abs(F.avg("y") - F.avg("score")).alias("gap"))
    return b.groupBy("part").agg(F.round(F.sum(F.col("n") * F.col("gap")) / F.sum("n"), 6).alias("ece"))


def confusion(df: DataFrame, threshold: Column) -> DataFrame:
    hit = F.col("score") >= threshold
    return df.agg(F.count_if(hit & (F.col("y") == 1)).alias("tp"), F.count_if(hit & (F.col("y") == 0)).alias("fp"), F.count_if(~hit & (F.col("y") == 0)).alias("tn"), F.count_if(~hit & (F.col("y") == 1)).alias("fn"))


def o11_confusion(spark, sf_dir):
    """O.11, O.17: counts and rates at 0.3."""
    c = confusion(scored(spark, sf_dir), F.lit(0.3))
    eps = 1e-9
    return c.select(
        "tp", "fp", "tn", "fn", F.round(F.col("fp") / (F.col("tp") + F.col("fp") + eps), 6).alias("fdr"), F.round(F.col("fp") / (F.col("fp") + F.col("tn") + eps), 6).alias("fpr"),
        F.round(F.col("tp") / (F.col("tp") + F.col("fn") + eps), 6).alias("recall"), F.round((F.col("tp") + F.col("fp")) / (F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")), 6).alias("alert_rate"),
    )


def o12_sweep(spark, sf_dir):
    """O.12: F1 and Youden's J at 20 thresholds; rows are first counted per score, so no row meets a threshold twice."""
    per = scored(spark, sf_dir).groupBy("score").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("q"))
    thr = spark.range(20).select(F.round(F.lit(0.02) + F.col("id") * 0.02, 2).alias("thr"))
    hit = F.col("score") >= F.col("thr")
    j = per.crossJoin(F.broadcast(thr))  # 20 rows
    g = j.groupBy("thr").agg(F.sum(F.when(hit, F.col("p")).otherwise(0)).alias("tp"), F.sum(F.when(hit, F.col("q")).otherwise(0)).alias("fp"), F.sum("p").alias("pos"), F.sum("q").alias("neg"))
    return g.select("thr", F.round(2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("pos")), 6).alias("f1"), F.round(F.col("tp") / F.col("pos") - F.col("fp") / F.col("neg"), 6).alias("youden"))


def auc(df: DataFrame, part: list[str]) -> DataFrame:
    """Mann-Whitney AUC per part from average ranks; null where a class is missing."""
    r = average_ranks(df, "score", part)
    g = r.groupBy(*part).agg(F.sum(F.when(F.col("y") == 1, F.col("rank"))).alias("sr"), F.sum("y").alias("p"), F.count(F.lit(1)).alias("n"))
    q = F.col("n") - F.col("p")
    return g.withColumn("auc", F.try_divide(F.col("sr") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * q)).drop("sr")


def o16_auc(spark, sf_dir):
    """O.16, O.22: AUC of all rows and of each group with 20 rows and both classes."""
    s = scored(spark, sf_dir)
    whole = auc(s.withColumn("grp", F.lit("all")), ["grp"])
    per = auc(s, ["grp"]).where("n >= 20 and p > 0 and p < n")
    return whole.unionByName(per).select("grp", F.col("n").cast("long").alias("n"), F.round("auc", 6).alias("auc"))


def o13_spearman(spark, sf_dir):
    """O.13, O.18, O.23: Spearman correlation of each feature with the label; flagged over 0.7, constant columns 0."""
    t = table(spark, sf_dir, "bug_dataset").where("label is not null").select("record_id", F.col("label").alias("y"), F.posexplode("static_features").alias("feature", "x")).where("x is not null and not isnan(x)")
    r = average_ranks(average_ranks(t, "x", ["feature"], "rx"), "y", ["feature"], "ry")
    g = r.groupBy("feature").agg(F.corr("rx", "ry").alias("r"))
    return g.select(F.col("feature").cast("long").alias("feature"), F.round(F.coalesce(F.nanvl("r", F.lit(0.0)), F.lit(0.0)), 5).alias("r"), (F.abs(F.coalesce("r", F.lit(0.0))) > 0.7).alias("flagged"))


def o19_signed_rank(spark, sf_dir):
    """O.19, O.20, J.8: Wilcoxon signed ranks of two features' difference, normal p, Cohen's d and its band."""
    t = table(spark, sf_dir, "bug_dataset").select(F.col("record_id").alias("id"), F.col("static_features")[0].alias("a"), F.col("static_features")[1].alias("b"))
    d = t.withColumn("d", F.round(F.col("a") - F.col("b"), 6)).where("d <> 0").withColumn("m", F.abs("d"))
    r = average_ranks(d, "m")
    w = r.agg(F.sum(F.when(F.col("d") > 0, F.col("rank")).otherwise(0.0)).alias("w_plus"), F.sum(F.when(F.col("d") < 0, F.col("rank")).otherwise(0.0)).alias("w_minus"), F.count(F.lit(1)).alias("n"))
    e = t.agg(((F.avg("a") - F.avg("b")) / F.sqrt((F.var_samp("a") + F.var_samp("b")) / 2)).alias("cohens_d"))
    j = w.join(e)
    z = (F.col("w_plus") - F.col("n") * (F.col("n") + 1) / 4.0) / F.sqrt(F.col("n") * (F.col("n") + 1) * (2 * F.col("n") + 1) / 24.0)
    band = F.when(F.abs("cohens_d") < 0.2, "negligible").when(F.abs("cohens_d") < 0.5, "small").when(F.abs("cohens_d") < 0.8, "medium").otherwise("large")
    return j.select("w_plus", "w_minus", F.round(z, 5).alias("z"), F.round("cohens_d", 5).alias("cohens_d"), band.alias("effect"))


def i16_cliff(spark, sf_dir):
    """I.16: Cliff's delta between the scores of positives and negatives, from ranks instead of a cross join."""
    a = auc(scored(spark, sf_dir).withColumn("grp", F.lit("all")), ["grp"])
    return a.select(F.round(2 * F.col("auc") - 1, 6).alias("cliffs_delta"))


def o21_composite(spark, sf_dir):
    """O.21, O.35: weighted sum of min-max normalised columns."""
    t = table(spark, sf_dir, "bug_dataset").select(F.col("record_id").alias("id"), *(F.col("static_features")[i].alias(f"f{i}") for i in range(4)))
    ends = F.broadcast(t.agg(*(f(f"f{i}").alias(f"{n}{i}") for i in range(4) for n, f in (("lo", F.min), ("hi", F.max)))))
    unit = lambda i: (F.col(f"f{i}") - F.col(f"lo{i}")) / (F.col(f"hi{i}") - F.col(f"lo{i}") + 1e-9)
    return t.join(ends).select("id", F.round(0.25 * unit(0) + 0.30 * unit(1) + 0.25 * unit(2) + 0.20 * unit(3), 6).alias("composite"))


def o24_kappa(spark, sf_dir):
    """O.24: Cohen's kappa and agreement of the stored label with a rule on churn and past bugs."""
    t = table(spark, sf_dir, "bug_dataset").where("label is not null").select(F.col("label").cast("int").alias("y"), (F.coalesce("git_features.n_past_bugs", F.lit(0.0)) >= 3).cast("int").alias("z"))
    g = t.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("y") == F.col("z")).cast("double")).alias("po"), F.avg("y").alias("py"), F.avg("z").alias("pz"))
    pe = F.col("py") * F.col("pz") + (1 - F.col("py")) * (1 - F.col("pz"))
    k = (F.col("po") - pe) / (1 - pe)
    return g.select("n", F.round("po", 6).alias("agreement"), F.round(k, 6).alias("kappa"))


def o25_coverage(spark, sf_dir, target: float = 0.8):
    """O.25, O.28: share of rows, by confidence, before the first drop of the running accuracy under the target (after five rows); 1 where it never drops."""
    s = scored(spark, sf_dir).withColumn("conf", F.abs(F.col("score") - 0.5)).withColumn("ok", ((F.col("score") >= 0.5).cast("int") == F.col("y")).cast("int"))
    r = ranked(s, "conf", ("ok",))
    first = F.min(F.when((F.col("rn") > 5) & (F.col("cum_ok") / F.col("rn") < target), F.col("rn")))
    return r.agg(F.round(F.coalesce((first - 1) / F.first("n"), F.lit(1.0)), 6).alias("coverage"))


def o26_damping(spark, sf_dir):
    """O.26, O.27, O.34, H.25: damped probabilities by distance sigma: asymmetric, symmetric, confidence factor."""
    s = scored(spark, sf_dir).withColumn("sigma", F.least(F.lit(5.0), F.log1p("size")))
    c = F.when(F.col("sigma") < 2, 1.0).when(F.col("sigma") <= 3.5, 1.0 - 0.5 * (F.col("sigma") - 2) / 1.5).otherwise(0.1)
    asym = F.when(F.col("score") > 0.5, 0.5 + (F.col("score") - 0.5) * F.pow(F.lit(0.5), "sigma")).otherwise(F.col("score"))
    return s.select("id", F.round(c, 6).alias("factor"), F.round(asym, 6).alias("asymmetric"), F.round(0.5 + (F.col("score") - 0.5) * c, 6).alias("symmetric"), (F.col("sigma") >= 2).alias("low_confidence"))


def o3_intervals(spark, sf_dir):
    """O.3, O.6, O.7, P.24: residual quantiles at three levels, and the coverage of the intervals they give."""
    s = scored(spark, sf_dir).withColumn("res", F.abs(F.col("y") - F.col("score")))
    q = s.agg(*(F.percentile("res", F.lit(a)).alias(f"q{int(a * 100)}") for a in (0.8, 0.9, 0.95)))
    j = s.join(F.broadcast(q))
    rows = [j.agg(F.lit(a).alias("level"), F.round(F.first(f"q{a}"), 6).alias("q"), F.round(F.avg((F.col("res") <= F.col(f"q{a}")).cast("double")), 6).alias("coverage")) for a in (80, 90, 95)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def o4_mondrian(spark, sf_dir):
    """O.4: residual quantile and coverage per size bin (below 20, below 60, rest)."""
    s = scored(spark, sf_dir).withColumn("res", F.abs(F.col("y") - F.col("score"))).withColumn("bin", F.when(F.col("size") < 20, "low").when(F.col("size") < 60, "medium").otherwise("high"))
    g = s.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.percentile("res", F.lit(0.9)).alias("q"))
    c = s.join(F.broadcast(g), "bin").groupBy("bin").agg(F.round(F.avg((F.col("res") <= F.col("q")).cast("double")), 6).alias("coverage"))
    return g.join(c, "bin").select("bin", "n", F.round("q", 6).alias("q"), "coverage")


def o32_agreement(spark, sf_dir):
    """O.32: Pearson correlation, MAE, RMSE, bias and greatest error of score against label."""
    e = F.col("score") - F.col("y")
    return scored(spark, sf_dir).agg(F.round(F.corr("score", "y"), 6).alias("pearson"), F.round(F.avg(F.abs(e)), 6).alias("mae"), F.round(F.sqrt(F.avg(e * e)), 6).alias("rmse"), F.round(F.avg(e), 6).alias("bias"), F.round(F.max(F.abs(e)), 6).alias("max_error"))


def o36_p10(spark, sf_dir):
    """O.36: precision at 10 of each group; the window limit keeps ten rows a group before any sort is complete."""
    w = W.partitionBy("grp").orderBy(F.desc("score"), "id")
    return scored(spark, sf_dir).withColumn("rn", F.row_number().over(w)).where("rn <= 10").groupBy("grp").agg(F.round(F.avg("y"), 6).alias("p10"), F.count(F.lit(1)).alias("k"))


def _bins(df: DataFrame, value: str, n: int) -> DataFrame:
    ends = F.broadcast(df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi")))
    b = F.least(F.lit(n - 1), F.floor(n * F.try_divide(F.col(value) - F.col("_lo"), F.col("_hi") - F.col("_lo"))))
    return df.join(ends).withColumn("bin", F.coalesce(b, F.lit(0))).drop("_lo", "_hi")


def o37_shift(spark, sf_dir, bins: int = 20):
    """N.8, O.37: Jensen-Shannon divergence (nats) of each group's score histogram from the whole pool's, smoothed by 1e-10."""
    s = _bins(scored(spark, sf_dir), "score", bins)
    per = s.groupBy("grp", "bin").agg(F.count(F.lit(1)).alias("c"))
    pool = per.groupBy("bin").agg(F.sum("c").alias("c0"))
    spine = per.select("grp").distinct().crossJoin(F.broadcast(spark.range(bins).select(F.col("id").alias("bin"))))  # bins rows
    j = spine.join(per, ["grp", "bin"], "left").join(F.broadcast(pool), "bin", "left")
    j = j.withColumns({"p": F.coalesce("c", F.lit(0)) + 1e-10, "q": F.coalesce("c0", F.lit(0)) + 1e-10})
    whole = j.groupBy("grp").agg(F.sum("p").alias("sp"), F.sum("q").alias("sq"))
    j = j.join(whole, "grp").withColumns({"p": F.col("p") / F.col("sp"), "q": F.col("q") / F.col("sq")}).withColumn("m", (F.col("p") + F.col("q")) / 2)
    return j.groupBy("grp").agg(F.round(0.5 * F.sum(F.col("p") * F.ln(F.col("p") / F.col("m"))) + 0.5 * F.sum(F.col("q") * F.ln(F.col("q") / F.col("m"))), 6).alias("jsd"))


def n9_wasserstein(spark, sf_dir):
    """N.9: Wasserstein-1 distance of log churn between groups of 60 rows or more, by merged distribution functions."""
    s = scored(spark, sf_dir).select("grp", F.log1p("size").alias("v"))
    big = s.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where("n >= 60")
    per = s.join(F.broadcast(big), "grp").groupBy("grp", "n", "v").agg(F.count(F.lit(1)).alias("c"))
    names = big.select("grp")
    pairs = names.alias("a").join(names.alias("b"), F.col("a.grp") < F.col("b.grp")).select(F.col("a.grp").alias("a"), F.col("b.grp").alias("b"))
    sides = pairs.select("a", "b", F.explode(F.array(F.struct(F.col("a").alias("grp"), F.lit(1).alias("sign")), F.struct(F.col("b").alias("grp"), F.lit(-1).alias("sign")))).alias("x")).select("a", "b", "x.*")
    step = sides.join(per, "grp").select("a", "b", "v", (F.col("sign") * F.col("c") / F.col("n")).alias("w")).groupBy("a", "b", "v").agg(F.sum("w").alias("w"))
    o = W.partitionBy("a", "b").orderBy("v")
    area = F.abs(F.sum("w").over(o.rowsBetween(W.unboundedPreceding, 0))) * (F.lead("v").over(o) - F.col("v"))
    return step.withColumn("area", area).groupBy("a", "b").agg(F.round(F.sum("area"), 5).alias("w1"))


def i13_shift_auc(spark, sf_dir):
    """I.13: correlation over groups between shift and AUC (Pearson and Spearman)."""
    a = o16_auc(spark, sf_dir).where("grp <> 'all'")
    j = a.join(o37_shift(spark, sf_dir), "grp")
    r = average_ranks(average_ranks(j, "jsd", out="rj"), "auc", out="ra")
    return r.agg(F.round(F.corr("jsd", "auc"), 5).alias("pearson"), F.round(F.corr("rj", "ra"), 5).alias("spearman"), F.count(F.lit(1)).alias("n"))


def j6_stability(spark, sf_dir):
    """J.6, J.7: coefficient of variation across groups of each feature's mean; stable below 0.3."""
    t = table(spark, sf_dir, "bug_dataset").select(F.coalesce(repo_key(F.col("repo")), F.lit("none")).alias("grp"), F.posexplode("static_features").alias("feature", "x"))
    m = t.groupBy("grp", "feature").agg(F.avg("x").alias("m"))
    g = m.groupBy("feature").agg((F.stddev_pop("m") / (F.abs(F.avg("m")) + 1e-9)).alias("cv"))
    return g.select(F.col("feature").cast("long").alias("feature"), F.round("cv", 5).alias("cv"), (F.col("cv") <= 0.3).alias("stable"))


def c23_gate(spark, sf_dir):
    """C.23: deployment gate on precision at 10 and average precision, with the reasons of a failure."""
    p = l2_at_k(spark, sf_dir, (10,)).select("precision")
    j = p.join(l4_ap(spark, sf_dir))
    reasons = F.filter(F.array(F.when(F.col("precision") < 0.5, F.lit("precision_at_10")), F.when(F.col("average_precision") < 0.4, F.lit("average_precision"))), lambda x: x.isNotNull())
    return j.select("precision", "average_precision", (F.size(reasons) == 0).alias("passes"), F.array_join(reasons, ",").alias("reasons"))


QUERIES = {k: f for k, f in list(globals().items()) if k[0] in "lonijc" and k[1].isdigit()}

_AUC = "rk AS (SELECT *, (rank() OVER (PARTITION BY grp ORDER BY score) + rank() OVER (PARTITION BY grp ORDER BY score) + count(*) OVER (PARTITION BY grp, score) - 1) / 2.0 AS rank FROM {src}), au AS (SELECT grp, count(*) AS n, sum(y) AS p, (sum(CASE WHEN y = 1 THEN rank END) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * (count(*) - sum(y)), 0) AS auc FROM rk GROUP BY grp)"
_ALL = "a2 AS (SELECT * FROM s UNION ALL SELECT id, 'all', y, score, size FROM s)"
_JSD = "e AS (SELECT min(score) AS lo, max(score) AS hi FROM s), b AS (SELECT grp, coalesce(least(19, floor(20 * (score - lo) / nullif(hi - lo, 0))), 0) AS bin FROM s, e), pc AS (SELECT grp, bin, count(*) AS c FROM b GROUP BY 1, 2), pl AS (SELECT bin, count(*) AS c0 FROM b GROUP BY 1), sp AS (SELECT grp, bin FROM (SELECT DISTINCT grp FROM b), (SELECT unnest(range(20)) AS bin)), q AS (SELECT sp.grp, (coalesce(c, 0) + 1e-10) / sum(coalesce(c, 0) + 1e-10) OVER (PARTITION BY sp.grp) AS p, (coalesce(c0, 0) + 1e-10) / sum(coalesce(c0, 0) + 1e-10) OVER (PARTITION BY sp.grp) AS q FROM sp LEFT JOIN pc ON pc.grp = sp.grp AND pc.bin = sp.bin LEFT JOIN pl ON pl.bin = sp.bin), js AS (SELECT grp, round(0.5 * sum(p * ln(p / ((p + q) / 2))) + 0.5 * sum(q * ln(q / ((p + q) / 2))), 6) AS jsd FROM q GROUP BY 1)"
_AREA = "(SELECT sum((hits - y / 2.0) * size) / (sum(size) * sum(y)) FROM (SELECT *, sum(y) OVER (ORDER BY {o}) AS hits FROM s))"
ORACLE = {
    "l2_at_k": f"WITH {R}, k(k) AS (VALUES (5), (10), (20), (50), (100)) SELECT k, round(sum(y) / k, 6) AS precision, round(sum(y) / max(pos), 6) AS recall, round(sum(y) / k / (max(pos) / max(n)), 6) AS lift FROM k JOIN p ON rn <= k GROUP BY k",
    "l4_ap": f"WITH {R} SELECT round(avg(CASE WHEN y = 1 THEN hits / rn END), 6) AS average_precision FROM p",
    "l5_effort": f"WITH {R} SELECT round(sum(CASE WHEN rn <= greatest(1, floor(n * 0.2)) THEN y ELSE 0 END) / max(pos), 6) AS pofb20, round(coalesce(min(CASE WHEN hits >= ceil(0.8 * pos) THEN rn END) / max(n), 1.0), 6) AS effort80 FROM p",
    "l7_curve": f"WITH {S}, t AS (SELECT count(*) AS n, sum(y) AS pos FROM s) SELECT CAST(pct AS INT) AS pct, round(least(1.0, floor(n * pct / 100) / pos), 6) AS share FROM t, (SELECT unnest(range(101)) AS pct)",
    "o1_popt": f"WITH {S}, a AS (SELECT " + _AREA.format(o="score DESC, id") + " AS model, " + _AREA.format(o="score, id DESC") + " AS worst, " + _AREA.format(o="y / size DESC, id") + " AS best) SELECT round(greatest(0.0, least(1.0, 1 - (best - model) / (best - worst))), 5) AS popt FROM a",
    "o2_pofb_size": f"WITH {S}, c AS (SELECT *, sum(size) OVER (ORDER BY score DESC, id) AS cs FROM s) SELECT round(sum(y) / (SELECT sum(y) FROM s), 6) AS pofb FROM c WHERE cs - size < 0.2 * (SELECT sum(size) FROM s)",
    "o8_ece": f"WITH {S}, g AS (SELECT CAST(floor(score * 10) AS BIGINT) AS bin, count(*) AS n, avg(y) AS rate, avg(score) AS ms FROM s WHERE score < 1 GROUP BY 1), b AS (SELECT unnest(range(10)) AS bin) SELECT b.bin, coalesce(n, 0) AS n, round(rate, 6) AS rate, round(ms, 6) AS mean_score, round(coalesce(n / (SELECT count(*) FROM s) * abs(rate - ms), 0.0), 6) AS ece_part FROM b LEFT JOIN g USING (bin)",
    "o10_ece_parts": f"WITH {S}, t AS (SELECT *, CASE WHEN size > 100 THEN 'ood' ELSE 'in' END AS part FROM s WHERE score < 1), u AS (SELECT * FROM t UNION ALL SELECT * REPLACE ('all' AS part) FROM t), b AS (SELECT part, floor(score * 10) AS bin, count(*) AS n, abs(avg(y) - avg(score)) AS gap FROM u GROUP BY 1, 2) SELECT part, round(sum(n * gap) / sum(n), 6) AS ece FROM b GROUP BY 1",
    "o11_confusion": f"WITH {S}, c AS (SELECT CAST(count_if(score >= 0.3 AND y = 1) AS BIGINT) AS tp, CAST(count_if(score >= 0.3 AND y = 0) AS BIGINT) AS fp, CAST(count_if(score < 0.3 AND y = 0) AS BIGINT) AS tn, CAST(count_if(score < 0.3 AND y = 1) AS BIGINT) AS fn FROM s) SELECT *, round(fp / (tp + fp + 1e-9), 6) AS fdr, round(fp / (fp + tn + 1e-9), 6) AS fpr, round(tp / (tp + fn + 1e-9), 6) AS recall, round((tp + fp) / (tp + fp + tn + fn), 6) AS alert_rate FROM c",
    "o12_sweep": f"WITH {S}, t AS (SELECT round(0.02 + i * 0.02, 2) AS thr FROM (SELECT unnest(range(20)) AS i)), g AS (SELECT thr, count_if(score >= thr AND y = 1) AS tp, count_if(score >= thr AND y = 0) AS fp, count_if(y = 1) AS pos, count_if(y = 0) AS neg FROM t, s GROUP BY 1) SELECT thr, round(2 * tp / (tp + fp + pos), 6) AS f1, round(tp / pos - fp / neg, 6) AS youden FROM g",
    "o16_auc": f"WITH {S}, {_ALL}, " + _AUC.format(src="a2") + " SELECT grp, n, round(auc, 6) AS auc FROM au WHERE grp = 'all' OR (n >= 20 AND p > 0 AND p < n)",
    "o13_spearman": "WITH t AS (SELECT label AS y, unnest(static_features) AS x, generate_subscripts(static_features, 1) - 1 AS feature FROM bug_dataset WHERE label IS NOT NULL), r AS (SELECT feature, 2 * rank() OVER (PARTITION BY feature ORDER BY x) + count(*) OVER (PARTITION BY feature, x) - 1 AS rx, 2 * rank() OVER (PARTITION BY feature ORDER BY y) + count(*) OVER (PARTITION BY feature, y) - 1 AS ry FROM t WHERE x IS NOT NULL), g AS (SELECT feature, corr(rx, ry) AS r FROM r GROUP BY 1) SELECT CAST(feature AS BIGINT) AS feature, round(coalesce(r, 0.0), 5) AS r, abs(coalesce(r, 0.0)) > 0.7 AS flagged FROM g",
    "o19_signed_rank": "WITH t AS (SELECT static_features[1] AS a, static_features[2] AS b FROM bug_dataset), d AS (SELECT round(a - b, 6) AS d FROM t WHERE round(a - b, 6) <> 0), r AS (SELECT d, (2 * rank() OVER (ORDER BY abs(d)) + count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS rank FROM d), w AS (SELECT sum(CASE WHEN d > 0 THEN rank ELSE 0.0 END) AS w_plus, sum(CASE WHEN d < 0 THEN rank ELSE 0.0 END) AS w_minus, count(*) AS n FROM r), e AS (SELECT (avg(a) - avg(b)) / sqrt((var_samp(a) + var_samp(b)) / 2) AS cd FROM t) SELECT CAST(w_plus AS DOUBLE) AS w_plus, CAST(w_minus AS DOUBLE) AS w_minus, round((w_plus - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0), 5) AS z, round(cd, 5) AS cohens_d, CASE WHEN abs(cd) < 0.2 THEN 'negligible' WHEN abs(cd) < 0.5 THEN 'small' WHEN abs(cd) < 0.8 THEN 'medium' ELSE 'large' END AS effect FROM w, e",
    "i16_cliff": f"WITH {S} SELECT round((count_if(a.score > b.score) - count_if(a.score < b.score)) / count(*), 6) AS cliffs_delta FROM s a JOIN s b ON a.y = 1 AND b.y = 0",
    "o21_composite": "WITH t AS (SELECT record_id AS id, static_features AS f FROM bug_dataset), e AS (SELECT "
    + ", ".join(f"min(f[{i}]) AS lo{i}, max(f[{i}]) AS hi{i}" for i in range(1, 5))
    + " FROM t) SELECT id, round(" + " + ".join(f"{w} * (f[{i}] - lo{i}) / (hi{i} - lo{i} + 1e-9)" for i, w in ((1, 0.25), (2, 0.30), (3, 0.25), (4, 0.20))) + ", 6) AS composite FROM t, e",
    "o24_kappa": "WITH t AS (SELECT CAST(label AS INT) AS y, CAST(coalesce(git_features.n_past_bugs, 0.0) >= 3 AS INT) AS z FROM bug_dataset WHERE label IS NOT NULL), g AS (SELECT count(*) AS n, avg(CAST(y = z AS DOUBLE)) AS po, avg(y) * avg(z) + (1 - avg(y)) * (1 - avg(z)) AS pe FROM t) SELECT n, round(po, 6) AS agreement, round((po - pe) / (1 - pe), 6) AS kappa FROM g",
    "o25_coverage": f"WITH {S}, c AS (SELECT CAST(CAST(score >= 0.5 AS INT) = y AS INT) AS ok, row_number() OVER (ORDER BY abs(score - 0.5) DESC, id) AS rn FROM s), a AS (SELECT rn, sum(ok) OVER (ORDER BY rn) / rn AS acc FROM c) SELECT round(coalesce((min(CASE WHEN rn > 5 AND acc < 0.8 THEN rn END) - 1) / max(rn), 1.0), 6) AS coverage FROM a",
    "o26_damping": f"WITH {S}, t AS (SELECT *, least(5.0, ln(1 + size)) AS g FROM s), c AS (SELECT *, CASE WHEN g < 2 THEN 1.0 WHEN g <= 3.5 THEN 1.0 - 0.5 * (g - 2) / 1.5 ELSE 0.1 END AS c FROM t) SELECT id, round(c, 6) AS factor, round(CASE WHEN score > 0.5 THEN 0.5 + (score - 0.5) * power(0.5, g) ELSE score END, 6) AS asymmetric, round(0.5 + (score - 0.5) * c, 6) AS symmetric, g >= 2 AS low_confidence FROM c",
    "o3_intervals": f"WITH {S}, r AS (SELECT abs(y - score) AS res FROM s), q AS (SELECT 80 AS l, quantile_cont(res, 0.8) AS q FROM r UNION ALL SELECT 90, quantile_cont(res, 0.9) FROM r UNION ALL SELECT 95, quantile_cont(res, 0.95) FROM r) SELECT CAST(l AS INT) AS level, round(q, 6) AS q, round(avg(CAST(res <= q AS DOUBLE)), 6) AS coverage FROM q, r GROUP BY l, q",
    "o4_mondrian": f"WITH {S}, r AS (SELECT abs(y - score) AS res, CASE WHEN size < 20 THEN 'low' WHEN size < 60 THEN 'medium' ELSE 'high' END AS bin FROM s), g AS (SELECT bin, count(*) AS n, quantile_cont(res, 0.9) AS q FROM r GROUP BY 1) SELECT bin, any_value(n) AS n, round(any_value(q), 6) AS q, round(avg(CAST(res <= q AS DOUBLE)), 6) AS coverage FROM r JOIN g USING (bin) GROUP BY 1",
    "o32_agreement": f"WITH {S} SELECT round(corr(score, y), 6) AS pearson, round(avg(abs(score - y)), 6) AS mae, round(sqrt(avg((score - y) * (score - y))), 6) AS rmse, round(avg(score - y), 6) AS bias, round(max(abs(score - y)), 6) AS max_error FROM s",
    "o36_p10": f"WITH {S}, r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, id) AS rn FROM s) SELECT grp, round(avg(y), 6) AS p10, count(*) AS k FROM r WHERE rn <= 10 GROUP BY 1",
    "o37_shift": f"WITH {S}, {_JSD} SELECT grp, jsd FROM js",
    "n9_wasserstein": f"WITH {S}, v AS (SELECT grp, ln(1 + size) AS v, count(*) OVER (PARTITION BY grp) AS n FROM s), g AS (SELECT DISTINCT grp FROM v WHERE n >= 60), st AS (SELECT a.grp AS a, b.grp AS b, v, sum(CASE WHEN v.grp = a.grp THEN 1.0 / n ELSE -1.0 / n END) AS w FROM g a JOIN g b ON a.grp < b.grp JOIN v ON v.grp IN (a.grp, b.grp) GROUP BY 1, 2, 3), ar AS (SELECT a, b, abs(sum(w) OVER o) * (lead(v) OVER o - v) AS area FROM st WINDOW o AS (PARTITION BY a, b ORDER BY v)) SELECT a, b, round(sum(area), 5) AS w1 FROM ar GROUP BY 1, 2",
    "i13_shift_auc": f"WITH {S}, " + _AUC.format(src="s") + f", {_JSD}, j AS (SELECT jsd, round(auc, 6) AS auc FROM au JOIN js USING (grp) WHERE n >= 20 AND p > 0 AND p < n), r AS (SELECT jsd, auc, 2 * rank() OVER (ORDER BY jsd) + count(*) OVER (PARTITION BY jsd) AS rj, 2 * rank() OVER (ORDER BY auc) + count(*) OVER (PARTITION BY auc) AS ra FROM j) SELECT round(corr(jsd, auc), 5) AS pearson, round(corr(rj, ra), 5) AS spearman, count(*) AS n FROM r",
    "j6_stability": r"WITH t AS (SELECT coalesce(nullif(regexp_extract(regexp_replace(lower(trim(repo)), '(?:/|\.git)+$', ''), '([^/:@\s]+)/([^/\s]+)$', 0), ''), 'none') AS grp, unnest(static_features) AS x, generate_subscripts(static_features, 1) - 1 AS feature FROM bug_dataset), m AS (SELECT grp, feature, avg(x) AS m FROM t GROUP BY 1, 2), g AS (SELECT feature, stddev_pop(m) / (abs(avg(m)) + 1e-9) AS cv FROM m GROUP BY 1) SELECT CAST(feature AS BIGINT) AS feature, round(cv, 5) AS cv, cv <= 0.3 AS stable FROM g",
    "c23_gate": f"WITH {R}, m AS (SELECT round(sum(CASE WHEN rn <= 10 THEN y ELSE 0 END) / 10, 6) AS precision, round(avg(CASE WHEN y = 1 THEN hits / rn END), 6) AS average_precision FROM p) SELECT *, precision >= 0.5 AND average_precision >= 0.4 AS passes, array_to_string(list_filter([CASE WHEN precision < 0.5 THEN 'precision_at_10' END, CASE WHEN average_precision < 0.4 THEN 'average_precision' END], lambda x: x IS NOT NULL), ',') AS reasons FROM m",
}
