"""Change history: change features, labelling, validation, time-ordered and grouped splits (A, C, I, J, K, M)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmark.functions.normalize import clean_name, repo_key
from quillmark.operators.skew import in_order, running
from quillmark.sources.tables import materialize, table


def epoch(text: Column) -> Column:
    """Seconds of a date in one of several formats (ISO with zone, unix seconds); null if unreadable."""
    return F.coalesce(F.when(text.rlike(r"^\d{9,11}$"), text.cast("long")), F.unix_timestamp(F.try_to_timestamp(text)))


def bugs(spark, sf_dir) -> DataFrame:
    """id, repo, file, author, t (seconds or null), label, weight, features, git."""
    b = table(spark, sf_dir, "bug_dataset")
    return b.select(
        F.col("record_id").alias("id"), F.coalesce(repo_key(F.col("repo")), F.lit("none")).alias("repo"), "file", clean_name(F.col("author")).alias("author"), epoch(F.col("author_date")).alias("t"),
        F.col("label").cast("int").alias("label"), F.col("sample_weight").alias("weight"), F.col("static_features").alias("features"), F.col("git_features").alias("git"),
    )


B = r"""b AS (SELECT record_id AS id, coalesce(nullif(regexp_extract(regexp_replace(lower(trim(repo)), '(?:/|\.git)+$', ''), '([^/:@\s]+)/([^/\s]+)$', 0), ''), 'none') AS repo, file, nullif(lower(trim(author)), '') AS author,
 CAST(coalesce(CASE WHEN regexp_matches(author_date, '^\d{9,11}$') THEN CAST(author_date AS BIGINT) END, CAST(floor(epoch(TRY_CAST(author_date AS TIMESTAMPTZ))) AS BIGINT)) AS BIGINT) AS t, CAST(label AS INT) AS label, sample_weight AS weight, static_features AS features, git_features AS git FROM bug_dataset)"""


# ---- change features from raw commits (orders: commits, lineitem: changed files)


def touched(spark, sf_dir) -> DataFrame:
    """commit, author, day, file, subsystem, added, deleted: one changed file of a commit a row."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("commit"), F.col("o_custkey").alias("author"), F.col("o_orderdate").alias("day"), (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("fix"))
    x = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("commit"), F.col("l_partkey").alias("file"), F.col("l_suppkey").alias("subsystem"), F.col("l_linenumber").alias("nth"), F.col("l_extendedprice").alias("price"),
        F.col("l_quantity").cast("long").alias("added"), F.floor(F.col("l_tax") * 100).cast("long").alias("deleted"),
    )
    return x.join(o, "commit")


def k1_change_features(spark, sf_dir, year: int = 2003):
    """K.1, K.2: 14 features of each changed file of a commit.  History features use rows before this one only, in
    the order of (day, commit, nth, file, subsystem, price); the current year of the decayed experience is a parameter."""
    x = touched(spark, sf_dir)
    lines = F.col("added") + F.col("deleted")
    total = x.groupBy("commit").agg(F.sum(lines).alias("_t"))
    p = F.try_divide(lines, F.col("_t"))
    per = x.join(total, "commit").groupBy("commit").agg(
        F.countDistinct("subsystem").alias("ns"), F.countDistinct("file").alias("nd"), F.count(F.lit(1)).alias("nf"),
        F.sum(F.when(p > 0, -p * F.log2(p + 1e-9)).otherwise(0.0)).alias("h"),
    )
    order = [F.col(c) for c in ("day", "commit", "nth", "file", "subsystem", "price")]
    one = F.lit(1).cast("long")
    x = materialize(x.withColumn("month", F.date_trunc("month", "day")), "touched")
    # the number of developers before a row: first rows of (file, author) so far
    seen = x = materialize(running(x, ["file", "author"], "month", order, {"_seen": one}), "seen")
    x = running(x, ["file"], "month", order, {"ndev": (F.col("_seen") == 0).cast("long"), "nuc": one}, {"_last": F.col("day")}, seen)
    x = running(x, ["author"], "month", order, {"exp": one, "rexp": 1.0 / (F.greatest(F.lit(0), F.lit(year) - F.year("day")) + 1)}, None, seen)
    x = running(x, ["author", "subsystem"], "month", order, {"sexp": one}, None, seen)
    out = x.select(
        "commit", "nth", "file", "price", "fix", "added", "deleted", lines.alias("lt"), "ndev",
        F.coalesce(F.datediff("day", "_last") / 7.0, F.lit(0.0)).alias("age"), "nuc", "exp", F.coalesce("rexp", F.lit(0.0)).alias("rexp"), "sexp",
    )
    out = out.join(per, "commit")
    return out.select("commit", "nth", "file", "price", "ns", "nd", "nf", F.round(F.when(F.col("nf") > 1, F.col("h")).otherwise(0.0), 4).alias("entropy"), "added", "deleted", "lt", "fix", "ndev", F.round("age", 2).alias("age"), "nuc", "exp", F.round("rexp", 4).alias("rexp"), "sexp")


def i8_fix_lag(spark, sf_dir, days: int = 30):
    """I.6, I.8: a change is labelled when a fix of the same file follows within the lag; first fix only.

    Time is cut into stretches of the lag's length; a fix belongs to its own and the one before, so one window over
    (file, stretch) finds it and a file with many changes is spread over its stretches.
    """
    lag = days * 86400
    x = touched(spark, sf_dir).withColumn("t", F.col("day").cast("timestamp").cast("long"))
    keys = ["commit", "nth", "file", "price"]
    changes = x.where("fix = 0").select(*keys, "t").distinct().withColumns({"s": F.expr(f"t div {lag}"), "fix_t": F.lit(None).cast("long")})
    fixes = x.where("fix = 1").select("file", "t").distinct().withColumn("s", F.explode(F.array(F.expr(f"t div {lag}"), F.expr(f"t div {lag} - 1"))))
    none = [F.lit(None).cast(x.schema[c].dataType).alias(c) for c in ("commit", "nth")]
    fixes = fixes.select(*none, "file", F.lit(None).cast(x.schema["price"].dataType).alias("price"), "t", "s", F.col("t").alias("fix_t"))
    w = W.partitionBy("file", "s").orderBy("t").rangeBetween(0, lag)
    out = changes.unionByName(fixes).withColumn("found", F.min("fix_t").over(w)).where("fix_t is null")
    return out.select(*keys, F.isnotnull("found").cast("int").alias("label"))


def inducing(deleted: DataFrame, blame: DataFrame) -> DataFrame:
    """I.7: fix, file, origin: the changes that wrote the lines a fix deletes.

    ``deleted``: fix, file, line; ``blame``: fix, file, line, origin: who wrote a line as the fix found it.  All deleted lines
    count.
    """
    return deleted.join(blame, ["fix", "file", "line"]).select("fix", "file", "origin").where("origin is not null").distinct()


def i7_inducing(spark, sf_dir):
    """I.7 over commits (orders) and changed lines (the numbered rows of lineitem): a line's writer is its last change before
    the fix, by an as-of window over (file, line)."""
    x = touched(spark, sf_dir)
    w = W.partitionBy("file", "nth").orderBy("day", "commit", "subsystem", "price")
    x = x.withColumn("origin", F.lag("commit").over(w)).where("fix = 1")
    fixes = x.select(F.col("commit").alias("fix"), "file", F.col("nth").alias("line"), "origin")
    return inducing(fixes.select("fix", "file", "line").distinct(), fixes.select("fix", "file", "line", "origin"))


# ---- validation, filters, labels


def c1_validation(spark, sf_dir):
    """C.1: first failing rule of each record, counted, with its share (records that hold all rules: valid)."""
    b = table(spark, sf_dir, "bug_dataset")
    rule = (
        F.when(F.col("repo").isNull() | F.col("file").isNull(), "missing field").when(F.col("label").isNull(), "missing label").when(~F.col("label").isin(0, 1), "label domain")
        .when(F.size("static_features") != 16, "vector length").when(F.col("source").isNull() | (F.col("source") == ""), "empty source").otherwise("valid")
    )
    g = b.groupBy(rule.alias("rule")).agg(F.count(F.lit(1)).alias("n"))
    return g.join(F.broadcast(g.agg(F.sum("n").alias("total")))).select("rule", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def c1_targets(spark, sf_dir):
    """C.1: target statistics of complexity_dataset (targets in 0..100): n, min, max, mean, median, deviation."""
    t = table(spark, sf_dir, "complexity_dataset").where("target between 0 and 100")
    return t.agg(F.count(F.lit(1)).alias("n"), F.min("target").alias("lo"), F.max("target").alias("hi"), F.round(F.avg("target"), 4).alias("mean"), F.round(F.median("target"), 4).alias("median"), F.round(F.stddev_samp("target"), 4).alias("stdev"))


def c2_filter_report(spark, sf_dir):
    """C.2: class distribution before and after dropping short sources and mined origins."""
    s = table(spark, sf_dir, "security_dataset").where("source is not null")
    short = (F.length("source") < 30) | (F.size(F.split("source", "\n")) < 3)
    mined = F.col("origin").like("%mining/%")
    return s.groupBy("label").agg(F.count(F.lit(1)).alias("before"), F.count_if(~short & ~mined).alias("after")).where("label is not null").withColumn("label", F.col("label").cast("int"))


def c3_consensus(spark, sf_dir):
    """C.3, C.4: records with two of four risk signs; labelled ones need them."""
    g = lambda c: F.coalesce(F.col(f"git.{c}"), F.lit(0.0))
    signs = [F.col("features")[0] > 8, g("lines_added") + g("lines_deleted") > 50, g("n_past_bugs") > 0, g("n_files") > 1]
    n = sum((F.coalesce(s, F.lit(False)).cast("int") for s in signs), F.lit(0))
    b = bugs(spark, sf_dir).where("label is not null")
    return b.select("id", n.alias("signs"), ((n >= 2) | (F.col("label") == 0)).alias("kept"))


FIX_WORDS = ["fix", "fixes", "fixed", "bug", "bugs", "error", "errors", "issue", "crash", "fault", "defect", "patch", "fail", "repair", "broken"]


def c6_fix_messages(spark, sf_dir):
    """C.6, A.11, A.12: commit messages with one of the words of a fix."""
    d = table(spark, sf_dir, "documents").where("source = 'commit_message' and text is not null")
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z]+"), F.lit(0))
    return d.select("doc_id", F.arrays_overlap(words, F.array(*map(F.lit, FIX_WORDS))).alias("is_fix"))


def c19_labels(spark, sf_dir):
    """C.19, A.21: labels in one spelling (unknown ones null) and at most 50 records of each, by id."""
    p = table(spark, sf_dir, "pattern_dataset")
    low = F.lower(F.trim("label"))
    lab = F.when(low == "smell", "code_smell").when(low.isin("clean", "code_smell", "anti_pattern", "style_violation"), low)
    w = W.partitionBy("label").orderBy("record_id")
    return p.select("record_id", lab.alias("label")).where("label is not null").withColumn("n", F.row_number().over(w)).where("n <= 50").select("record_id", "label")


def c7_bands(spark, sf_dir):
    """C.7, C.15: severity band of a 0..10 score and whether the row is out of distribution."""
    f = table(spark, sf_dir, "security_finding")
    s = F.col("confidence") * 10
    band = F.when(s >= 9, "critical").when(s >= 7, "high").when(s >= 4, "medium").otherwise("low")
    return f.select("finding_id", band.alias("band"), ((F.col("lineno") < 5) | (F.col("lineno") > 600)).alias("ood"))


def c20_failures(spark, sf_dir):
    """C.20-C.22: failure modes of each result by its evidence; LABEL_NOISE always."""
    r = table(spark, sf_dir, "failure_taxonomy_results")
    e = lambda k: F.try_element_at("evidence", F.lit(k))
    modes = F.filter(
        F.array(
            F.when((e("n_test") < 50) | (e("n_train") < 200), F.lit("DATA_SPARSITY")), F.when(e("jsd") > 0.3, F.lit("CROSS_PROJECT_MISMATCH")), F.lit("LABEL_NOISE"),
            F.when((F.col("auc") < 0.55) & ~F.coalesce(e("jsd") > 0.3, F.lit(False)), F.lit("FEATURE_INSTABILITY")),
        ),
        lambda x: x.isNotNull(),
    )
    return r.select("result_id", F.array_join(modes, ",").alias("modes"))


def j5_dataset_report(spark, sf_dir):
    """J.5: rows, duplicates beyond the first of equal sources, labels and imbalance per repo."""
    b = table(spark, sf_dir, "bug_dataset").select(F.coalesce(repo_key(F.col("repo")), F.lit("none")).alias("repo"), "label", F.sha2("source", 256).alias("h"))
    per = b.groupBy("repo", "h").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("label", F.lit(0))).cast("long").alias("pos"))
    g = per.groupBy("repo").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("h").isNotNull(), F.col("n") - 1).otherwise(0)).alias("duplicates"), F.sum("pos").alias("positives"))
    return g.withColumn("imbalance", F.round(F.greatest("positives", F.col("n") - F.col("positives")) / F.greatest(F.lit(1), F.least("positives", F.col("n") - F.col("positives"))), 4))


def b3_manifest(spark, sf_dir):
    """B.3, B.8, B.9: keyed upsert: of each file the newest record's hash (ties by id), and whether it changed."""
    b = table(spark, sf_dir, "bug_dataset").select("file", "record_id", "ingested_at", F.sha2(F.coalesce("source", F.lit("")), 256).alias("sha256"))
    key = F.struct(F.coalesce("ingested_at", F.lit("1970-01-01").cast("timestamp")), "record_id")
    g = b.groupBy("file").agg(F.max_by("sha256", key).alias("sha256"), F.min_by("sha256", key).alias("first"), F.count(F.lit(1)).alias("n"))
    return g.select("file", "sha256", "n", (F.col("sha256") != F.col("first")).alias("changed"))


# ---- splits


def numbered(df: DataFrame) -> DataFrame:
    """rn (1, 2, ... by t, id over all rows; rows without t come first) and n."""
    return in_order(df.withColumn("t", F.coalesce("t", F.lit(0).cast("long"))), [F.asc("t"), F.asc("id")])


def k14_temporal(spark, sf_dir, ratio: float = 0.2):
    """K.14, K.17, K.18: the last share of rows by time is the test set (at least one row)."""
    r = numbered(bugs(spark, sf_dir))
    return r.select("id", (F.col("rn") > F.col("n") - F.greatest(F.lit(1), F.floor(F.col("n") * ratio))).alias("is_test"))


def k15_walk_forward(spark, sf_dir, k: int = 5):
    """K.15, K.16: windows of n div (k + 1) rows; fold i trains on windows 0..i and tests on i + 1; the rest is unused."""
    r = numbered(bugs(spark, sf_dir))
    win = F.expr(f"(rn - 1) div (n div {k + 1})")
    r = r.select("id", "label", win.alias("win")).where(F.col("win") <= k)
    per = r.groupBy("win").agg(F.count(F.lit(1)).alias("c"), F.coalesce(F.sum("label"), F.lit(0)).alias("pos"))
    fold = spark.range(k).select(F.col("id").alias("fold"))
    j = per.join(F.broadcast(fold), F.col("win") <= F.col("fold") + 1)
    test = F.col("win") == F.col("fold") + 1
    return j.groupBy("fold").agg(F.sum(F.when(~test, F.col("c")).otherwise(0)).alias("n_train"), F.sum(F.when(test, F.col("c")).otherwise(0)).alias("n_test"), F.sum(F.when(test, F.col("pos")).otherwise(0)).alias("test_positives"))


def m1_repo_split(spark, sf_dir):
    """M.1, M.4: rows of the listed repos are test rows."""
    b = bugs(spark, sf_dir)
    test = F.col("repo").isin("brackwater/tidegate", "pellmarsh/hedgerow")
    return b.groupBy(test.alias("is_test")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("label"), 6).alias("rate"))


def m2_lopo(spark, sf_dir, least: int = 5):
    """M.2, M.3: leave one project out: sizes and rates of every split with enough test rows, from per-repo sums
    (no row is repeated per split)."""
    per = bugs(spark, sf_dir).groupBy("repo").agg(F.count(F.lit(1)).alias("n_test"), F.count("label").alias("k"), F.coalesce(F.sum("label"), F.lit(0)).alias("pos"))
    whole = F.broadcast(per.agg(F.sum("n_test").alias("n"), F.sum("k").alias("ka"), F.sum("pos").alias("pa")))
    return per.join(whole).where(F.col("n_test") >= least).select("repo", "n_test", (F.col("n") - F.col("n_test")).alias("n_train"), F.round(F.try_divide(F.col("pos"), F.col("k")), 6).alias("test_rate"), F.round((F.col("pa") - F.col("pos")) / (F.col("ka") - F.col("k")), 6).alias("train_rate"))


def o31_contamination(spark, sf_dir):
    """O.31: held-out repos that share an owner with another repo."""
    names = bugs(spark, sf_dir).where("repo <> 'none'").select("repo", F.split_part("repo", F.lit("/"), F.lit(1)).alias("owner")).distinct()
    shared = names.groupBy("owner").agg(F.count(F.lit(1)).alias("k"))
    return names.join(shared, "owner").select("repo", (F.col("k") > 1).alias("contaminated"))


def m7_expand(spark, sf_dir):
    """M.6-M.9, I.15, A.13: records whose origin is not present yet, one for each, appended."""
    old = table(spark, sf_dir, "complexity_dataset").where("record_id % 2 = 0").select("origin", "record_id")
    new = table(spark, sf_dir, "complexity_dataset").where("record_id % 2 = 1").select("origin", "record_id")
    fresh = new.join(old.select("origin"), "origin", "left_anti").groupBy("origin").agg(F.min("record_id").alias("record_id"))
    return old.unionByName(fresh)


# ---- deltas


def k21_delta(spark, sf_dir):
    """I.5, K.21, K.22: change of each feature against the file's record before, and the risk by its growth."""
    w = W.partitionBy("repo", "file").orderBy(F.coalesce("t", F.lit(0)), "id")
    b = bugs(spark, sf_dir).select("id", "features", F.lag("features").over(w).alias("prev")).where("prev is not null")
    d = F.zip_with("features", "prev", lambda x, y: F.round(x - y, 4))
    vec = F.concat(d, F.col("features"), F.transform(d, F.abs), F.transform(d, lambda x: F.signum(x)))
    risk = F.when(d[1] > 5, 0.8).when(d[1] > 0, 0.5).otherwise(0.2)
    return b.select("id", vec.alias("delta_features"), risk.alias("risk"))


def o30_learning_curve(spark, sf_dir):
    """O.30: positives per share of the records in hash order, nested samples."""
    b = bugs(spark, sf_dir).where("label is not null").withColumn("u", F.pmod(F.col("id") * 2654435761, F.lit(1000)))
    parts = spark.createDataFrame([(0.25,), (0.5,), (0.75,), (1.0,)], "fraction double")
    per = b.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("pos"))
    return per.join(F.broadcast(parts), F.col("u") < F.col("fraction") * 1000).groupBy("fraction").agg(F.sum("n").alias("n"), F.round(F.sum("pos") / F.sum("n"), 6).alias("rate"))


QUERIES = {k: f for k, f in list(globals().items()) if k[0] in "kicjbmo" and k[1].isdigit()}

_X = "x AS (SELECT l_orderkey AS commit, o_custkey AS author, o_orderdate AS day, CAST(o_orderpriority = '1-URGENT' AS INT) AS fix, l_partkey AS file, l_suppkey AS subsystem, l_linenumber AS nth, l_extendedprice AS price, CAST(l_quantity AS BIGINT) AS added, CAST(floor(l_tax * 100) AS BIGINT) AS deleted FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
_R = f"{B}, r AS (SELECT id, label, row_number() OVER (ORDER BY coalesce(t, 0), id) AS rn, count(*) OVER () AS n FROM b)"
ORACLE = {
    "i7_inducing": "WITH x AS (SELECT l_orderkey AS fix, l_partkey AS file, o_orderpriority = '1-URGENT' AS is_fix, lag(l_orderkey) OVER (PARTITION BY l_partkey, l_linenumber ORDER BY o_orderdate, l_orderkey, l_suppkey, l_extendedprice) AS origin FROM lineitem JOIN orders ON l_orderkey = o_orderkey) SELECT DISTINCT fix, file, origin FROM x WHERE is_fix AND origin IS NOT NULL",
    "k1_change_features": f"WITH {_X}, t AS (SELECT *, added + deleted AS lt, sum(added + deleted) OVER (PARTITION BY commit) AS tot, row_number() OVER (PARTITION BY file, author ORDER BY day, commit, nth, file, subsystem, price) = 1 AS isfirst FROM x), per AS (SELECT commit, count(DISTINCT subsystem) AS ns, count(DISTINCT file) AS nd, count(*) AS nf, sum(CASE WHEN lt > 0 THEN -(lt / tot) * log2(lt / tot + 1e-9) ELSE 0.0 END) AS h FROM t GROUP BY 1), w AS (SELECT commit, nth, file, price, added, deleted, lt, fix, coalesce(sum(CAST(isfirst AS INT)) OVER bf, 0) AS ndev, coalesce(date_diff('day', CAST(lag(day) OVER f AS DATE), CAST(day AS DATE)) / 7.0, 0.0) AS age, count(*) OVER bf AS nuc, count(*) OVER ba AS exp, coalesce(sum(1.0 / (greatest(0, 2003 - year(day)) + 1)) OVER ba, 0.0) AS rexp, count(*) OVER bs AS sexp FROM t WINDOW f AS (PARTITION BY file ORDER BY day, commit, nth, file, subsystem, price), bf AS (PARTITION BY file ORDER BY day, commit, nth, file, subsystem, price ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ba AS (PARTITION BY author ORDER BY day, commit, nth, file, subsystem, price ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), bs AS (PARTITION BY author, subsystem ORDER BY day, commit, nth, file, subsystem, price ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT commit, nth, file, price, ns, nd, nf, round(CASE WHEN nf > 1 THEN h ELSE 0.0 END, 4) AS entropy, added, deleted, lt, fix, CAST(ndev AS BIGINT) AS ndev, round(age, 2) AS age, nuc, exp, round(CAST(rexp AS DOUBLE), 4) AS rexp, sexp FROM w JOIN per USING (commit)",
    "i8_fix_lag": f"WITH {_X} SELECT commit, nth, file, price, CAST(EXISTS (SELECT 1 FROM x f WHERE f.fix = 1 AND f.file = x.file AND f.day BETWEEN x.day AND x.day + INTERVAL 30 DAY) AS INT) AS label FROM x WHERE fix = 0",
    "c1_validation": "WITH r AS (SELECT CASE WHEN repo IS NULL OR file IS NULL THEN 'missing field' WHEN label IS NULL THEN 'missing label' WHEN label NOT IN (0, 1) THEN 'label domain' WHEN len(static_features) <> 16 THEN 'vector length' WHEN source IS NULL OR source = '' THEN 'empty source' ELSE 'valid' END AS rule FROM bug_dataset) SELECT rule, count(*) AS n, round(count(*) / (SELECT count(*) FROM r), 6) AS share FROM r GROUP BY 1",
    "c1_targets": "SELECT count(*) AS n, min(target) AS lo, max(target) AS hi, round(avg(target), 4) AS mean, round(median(target), 4) AS median, round(stddev_samp(target), 4) AS stdev FROM complexity_dataset WHERE target BETWEEN 0 AND 100",
    "c2_filter_report": "SELECT CAST(label AS INT) AS label, count(*) AS before, CAST(count_if(length(source) >= 30 AND len(string_split(source, chr(10))) >= 3 AND NOT contains(origin, 'mining/')) AS BIGINT) AS after FROM security_dataset WHERE source IS NOT NULL AND label IS NOT NULL GROUP BY 1",
    "c3_consensus": f"WITH {B}, s AS (SELECT id, label, CAST(coalesce(features[1] > 8, false) AS INT) + CAST(coalesce(git.lines_added, 0) + coalesce(git.lines_deleted, 0) > 50 AS INT) + CAST(coalesce(git.n_past_bugs, 0) > 0 AS INT) + CAST(coalesce(git.n_files, 0) > 1 AS INT) AS signs FROM b WHERE label IS NOT NULL) SELECT id, signs, signs >= 2 OR label = 0 AS kept FROM s",
    "c6_fix_messages": "SELECT doc_id, list_has_any(regexp_extract_all(lower(text), '[a-z]+'), [" + ", ".join(f"'{w}'" for w in FIX_WORDS) + "]) AS is_fix FROM documents WHERE source = 'commit_message' AND text IS NOT NULL",
    "c19_labels": "WITH l AS (SELECT record_id, CASE WHEN lower(trim(label)) = 'smell' THEN 'code_smell' WHEN lower(trim(label)) IN ('clean','code_smell','anti_pattern','style_violation') THEN lower(trim(label)) END AS label FROM pattern_dataset) SELECT record_id, label FROM l WHERE label IS NOT NULL QUALIFY row_number() OVER (PARTITION BY label ORDER BY record_id) <= 50",
    "c7_bands": "SELECT finding_id, CASE WHEN confidence * 10 >= 9 THEN 'critical' WHEN confidence * 10 >= 7 THEN 'high' WHEN confidence * 10 >= 4 THEN 'medium' ELSE 'low' END AS band, lineno < 5 OR lineno > 600 AS ood FROM security_finding",
    "c20_failures": "SELECT result_id, array_to_string(list_filter([CASE WHEN evidence['n_test'] < 50 OR evidence['n_train'] < 200 THEN 'DATA_SPARSITY' END, CASE WHEN evidence['jsd'] > 0.3 THEN 'CROSS_PROJECT_MISMATCH' END, 'LABEL_NOISE', CASE WHEN auc < 0.55 AND NOT coalesce(evidence['jsd'] > 0.3, false) THEN 'FEATURE_INSTABILITY' END], lambda x: x IS NOT NULL), ',') AS modes FROM failure_taxonomy_results",
    "j5_dataset_report": f"WITH {B}, s AS (SELECT b.repo, source, b.label FROM b JOIN bug_dataset d ON d.record_id = b.id), g AS (SELECT repo, count(*) AS n, CAST(count(source) - count(DISTINCT source) AS BIGINT) AS duplicates, CAST(coalesce(sum(label), 0) AS BIGINT) AS positives FROM s GROUP BY 1) SELECT *, round(greatest(positives, n - positives) / greatest(1, least(positives, n - positives)), 4) AS imbalance FROM g",
    "b3_manifest": "WITH x AS (SELECT file, sha256(coalesce(source, '')) AS h, row_number() OVER (PARTITION BY file ORDER BY coalesce(ingested_at, TIMESTAMPTZ '1970-01-01 00:00:00+00'), record_id) AS k FROM bug_dataset) SELECT file, arg_max(h, k) AS sha256, count(*) AS n, arg_max(h, k) <> arg_min(h, k) AS changed FROM x GROUP BY 1",
    "k14_temporal": f"WITH {_R} SELECT id, rn > n - greatest(1, floor(n * 0.2)) AS is_test FROM r",
    "k15_walk_forward": f"WITH {_R}, w AS (SELECT label, (rn - 1) // (n // 6) AS win FROM r), f AS (SELECT unnest(range(5)) AS fold) SELECT fold, CAST(count_if(win <= fold) AS BIGINT) AS n_train, CAST(count_if(win = fold + 1) AS BIGINT) AS n_test, CAST(coalesce(sum(CASE WHEN win = fold + 1 THEN label END), 0) AS BIGINT) AS test_positives FROM w, f WHERE win <= 5 GROUP BY 1",
    "m1_repo_split": f"WITH {B} SELECT repo IN ('brackwater/tidegate', 'pellmarsh/hedgerow') AS is_test, count(*) AS n, round(avg(label), 6) AS rate FROM b GROUP BY 1",
    "m2_lopo": f"WITH {B}, p AS (SELECT DISTINCT repo FROM b) SELECT p.repo, CAST(count_if(b.repo = p.repo) AS BIGINT) AS n_test, CAST(count_if(b.repo <> p.repo) AS BIGINT) AS n_train, round(avg(CASE WHEN b.repo = p.repo THEN label END), 6) AS test_rate, round(avg(CASE WHEN b.repo <> p.repo THEN label END), 6) AS train_rate FROM p, b GROUP BY 1 HAVING count_if(b.repo = p.repo) >= 5",
    "o31_contamination": f"WITH {B}, n AS (SELECT DISTINCT repo FROM b WHERE repo <> 'none') SELECT repo, count(*) OVER (PARTITION BY split_part(repo, '/', 1)) > 1 AS contaminated FROM n",
    "m7_expand": "SELECT origin, record_id FROM complexity_dataset WHERE record_id % 2 = 0 UNION ALL SELECT origin, min(record_id) FROM complexity_dataset WHERE record_id % 2 = 1 AND origin NOT IN (SELECT origin FROM complexity_dataset WHERE record_id % 2 = 0) GROUP BY 1",
    "k21_delta": f"WITH {B}, p AS (SELECT id, features, lag(features) OVER (PARTITION BY repo, file ORDER BY coalesce(t, 0), id) AS prev FROM b), d AS (SELECT id, features, list_transform(list_zip(features, prev), lambda x: round(x[1] - x[2], 4)) AS d FROM p WHERE prev IS NOT NULL) SELECT id, list_concat(d, features, list_transform(d, lambda x: abs(x)), list_transform(d, lambda x: CAST(sign(x) AS DOUBLE))) AS delta_features, CAST(CASE WHEN d[2] > 5 THEN 0.8 WHEN d[2] > 0 THEN 0.5 ELSE 0.2 END AS DOUBLE) AS risk FROM d",
    "o30_learning_curve": f"WITH {B}, u AS (SELECT label, (id * 2654435761) % 1000 AS u FROM b WHERE label IS NOT NULL), f(fraction) AS (VALUES (0.25::DOUBLE), (0.5), (0.75), (1.0)) SELECT fraction, count(*) AS n, round(sum(label) / count(*), 6) AS rate FROM u JOIN f ON u < fraction * 1000 GROUP BY 1",
}
