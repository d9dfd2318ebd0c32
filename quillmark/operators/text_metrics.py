"""Text, line and normaliser operators (per file)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmark.functions import text as T
from quillmark.sources.tables import table


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, path, repo, language, code: the sources of security_dataset."""
    t = table(spark, sf_dir, "security_dataset")
    return t.select(F.col("record_id").alias("file_id"), F.col("origin").alias("path"), "repo", F.col("code_lang").alias("language"), F.col("source").alias("code"))


FILES = "(SELECT record_id AS file_id, origin AS path, repo, code_lang AS language, source AS code FROM security_dataset)"
#: DuckDB: a macro-like expression for the lines of ``code``
SQL_LINES = "CASE WHEN code LIKE '%' || chr(10) OR code = '' THEN string_split(code, chr(10))[:-2] ELSE string_split(code, chr(10)) END"


def line_lengths(df: DataFrame) -> DataFrame:
    """D.2, D.6: longest, mean and number of lines over 80 of the lines that are not blank (0 if none)."""
    n = F.transform(T.nonblank(F.col("code")), lambda x: F.length(x))
    return df.where("code is not null").select(
        "file_id",
        F.coalesce(F.array_max(n), F.lit(0)).cast("long").alias("max_len"),
        F.round(F.coalesce(T.mean_of(n), F.lit(0.0)), 4).alias("avg_len"),
        F.size(F.filter(n, lambda x: x > 80)).cast("long").alias("over_80"),
    )


def loc(df: DataFrame) -> DataFrame:
    """D.24, D.25: lines that are neither blank nor # comments; too short below 30 characters or 3 lines."""
    ls = T.lines(F.col("code"))
    return df.where("code is not null").select(
        "file_id",
        F.size(F.filter(ls, lambda x: x.rlike(r"\S") & ~x.rlike(r"^\s*#"))).cast("long").alias("loc"),
        ((F.length("code") < 30) | (F.size(ls) < 3)).alias("too_short"),
    )


def halstead_report(df: DataFrame) -> DataFrame:
    """D.7, D.9: approximate Halstead measures and the maintainability index (cyclomatic by keywords)."""
    x = df.where("code is not null").select("file_id", "code", *(c.cast("long").alias(n) for n, c in T.halstead(F.col("code")).items()))
    vocab, length = F.col("n1") + F.col("n2"), F.col("big_n1") + F.col("big_n2")
    x = x.withColumns(
        {
            "volume": F.when(vocab > 0, length * F.log2(vocab.cast("double"))).otherwise(0.0),
            "difficulty": F.when(F.col("n2") > 0, F.col("n1") / 2 * F.col("big_n2") / F.col("n2")).otherwise(0.0),
            "cyclomatic": (F.lit(1) + F.size(F.regexp_extract_all("code", F.lit(r"\b(?:if|for|while|case|catch|except|elif)\b|&&|\|\|"), F.lit(0)))).cast("long"),
            "sloc": F.size(T.nonblank(F.col("code"))).cast("long"),
        }
    )
    return x.select(
        "file_id", "n1", "n2", "big_n1", "big_n2",
        F.round("volume", 4).alias("volume"), F.round("difficulty", 4).alias("difficulty"),
        F.round(F.col("volume") * F.col("difficulty"), 3).alias("effort"), F.round(F.col("volume") / 3000, 6).alias("bugs"),
        F.round(T.maintainability(F.col("volume"), F.col("cyclomatic"), F.col("sloc")), 4).alias("maintainability"),
    )


def normalised(df: DataFrame) -> DataFrame:
    """D.11, D.12, D.13, D.15: comment-free, squeezed text and its MD5 fingerprint."""
    body = T.squeeze(T.strip_comments(F.col("code")))
    return df.where("code is not null").select("file_id", F.length(body).cast("long").alias("n_chars"), F.md5(body).alias("fingerprint"))


def vocabulary(tokens: DataFrame, most: int = 10_000) -> DataFrame:
    """D.18: the commonest tokens with ids from 2 (0 pads, 1 is unknown); ties by token.

    ``tokens`` has token.  Only the counts are sorted, and only the top ``most`` - 2 of them.
    """
    top = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "token").limit(most - 2)
    return top.select("token", "n", (F.row_number().over(W.orderBy(F.desc("n"), "token")) + 1).cast("long").alias("id"))


def tokens_of(df: DataFrame) -> DataFrame:
    return df.where("code is not null").select("file_id", F.explode(F.regexp_extract_all("code", F.lit(r"[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))).alias("token"))


def token_ids(df: DataFrame, vocab: DataFrame, most: int = 512) -> DataFrame:
    """D.19: ids of each file's first ``most`` tokens, unknown 1, padded with 0."""
    names = vocab.select("token", "id")
    toks = F.regexp_extract_all("code", F.lit(r"[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))
    first = df.where("code is not null").select("file_id", F.posexplode_outer(F.slice(toks, 1, most)).alias("pos", "token"))
    got = first.join(F.broadcast(names), "token", "left")  # at most the vocabulary's size
    seq = got.groupBy("file_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", F.coalesce("id", F.lit(1)).alias("id"))))).alias("s")
    )
    ids = F.transform("s", lambda x: x["id"])
    return seq.select("file_id", F.concat(ids, F.array_repeat(F.lit(0).cast("long"), F.lit(most) - F.size("s"))).alias("ids"))


def d2_line_lengths(spark, sf_dir):
    return line_lengths(files(spark, sf_dir))


def d24_loc(spark, sf_dir):
    return loc(files(spark, sf_dir))


def d7_halstead(spark, sf_dir):
    return halstead_report(files(spark, sf_dir))


def d13_normalised(spark, sf_dir):
    return normalised(files(spark, sf_dir))


def d16_sub_tokens(spark, sf_dir):
    """D.16: number of uses of each sub-token of the sources' identifiers."""
    toks = tokens_of(files(spark, sf_dir)).select(F.explode(T.sub_tokens(F.col("token"))).alias("sub_token"))
    return toks.groupBy("sub_token").agg(F.count(F.lit(1)).alias("n"))


def d18_vocabulary(spark, sf_dir):
    return vocabulary(tokens_of(files(spark, sf_dir)))


def d19_token_ids(spark, sf_dir):
    f = files(spark, sf_dir)
    return token_ids(f, vocabulary(tokens_of(f)))


def d10_languages(spark, sf_dir):
    """D.10, R.2, C.14, A.7-A.9: language by extension, repo label and file key of each origin."""
    f = files(spark, sf_dir)
    lang = T.detect_language(F.col("path"), F.lower(F.trim("language")))
    parts = F.split("path", "/")
    return f.select(
        "file_id",
        lang.alias("detected"),
        F.coalesce(lang.isin(*sorted(set(T.EXTENSIONS.values()))), F.lit(False)).alias("supported"),
        F.coalesce("repo", F.concat_ws("/", parts[0], parts[1])).alias("repo_label"),
        F.regexp_replace("path", r"@[0-9a-f]{7,40}$", "").alias("file_key"),
    )


def d23_keyword_scan(spark, sf_dir):
    """D.23: whether any dangerous keyword occurs."""
    hit = F.lit(False)
    for k in DANGEROUS:
        hit = hit | F.contains(F.col("code"), F.lit(k))
    return files(spark, sf_dir).where("code is not null").select("file_id", hit.alias("dangerous"))


# The keywords of the baseline scan.
DANGEROUS = ["eval(", "exec(", "os.system", "subprocess", "pickle.load", "yaml.load", "md5", "sha1", "shell=True", "password =", "SELECT "]


def d28_string_literals(spark, sf_dir):
    """D.28, D.29: of each line with a call's opening parenthesis its first argument's text, whether that is a
    string literal, and how many brackets the line leaves open."""
    f = files(spark, sf_dir).where("code is not null")
    ls = f.select("file_id", F.posexplode(T.lines(F.col("code"))).alias("pos", "line")).where(F.col("line").rlike(r"[A-Za-z_]\w*\("))
    arg = F.trim(F.regexp_extract("line", r"[A-Za-z_][A-Za-z0-9_]*\(([^,()]*)", 1))
    n = lambda c: F.length("line") - F.length(F.replace("line", F.lit(c), F.lit("")))
    return ls.select(
        "file_id",
        (F.col("pos") + 1).cast("long").alias("lineno"),
        arg.rlike(r"""^[bBrRuUfF]{0,2}("[^"]*"|'[^']*')$""").alias("is_literal"),
        (n("(") - n(")")).cast("long").alias("left_open"),
    )


def c8_suppressions(spark, sf_dir, tool: str = "codescan"):
    """C.8: inline comments ``# <tool>: ignore[rule, ...]`` of every source; an empty list suppresses all rules."""
    return suppressions(files(spark, sf_dir), tool)


def suppressions(df: DataFrame, tool: str) -> DataFrame:
    ls = df.select("file_id", F.posexplode(T.lines(F.col("code"))).alias("pos", "line"))
    mark = rf"#\s*{tool}:\s*ignore(?:\[([^\]]*)\])?"
    rules = F.filter(F.transform(F.split(F.regexp_extract("line", mark, 1), ","), lambda x: F.trim(x)), lambda x: x != "")
    return ls.where(F.col("line").rlike(mark)).select("file_id", (F.col("pos") + 1).cast("long").alias("lineno"), rules.alias("rules"))


QUERIES = {
    f.__name__: f
    for f in (d2_line_lengths, d24_loc, d7_halstead, d13_normalised, d16_sub_tokens, d18_vocabulary, d19_token_ids, d10_languages, d23_keyword_scan, d28_string_literals, c8_suppressions)
}

_L = f"WITH f AS (SELECT * FROM {FILES} WHERE code IS NOT NULL), l AS (SELECT *, {SQL_LINES} AS ls FROM f) "
_NB = r"list_filter(ls, lambda x: regexp_matches(x, '\S'))"
_EXT = "CASE lower(regexp_extract(path, '\\.([^./]+)$', 1)) " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in T.EXTENSIONS.items()) + " END"
_TOK = "SELECT unnest(regexp_extract_all(code, '[A-Za-z_][A-Za-z0-9_]*')) AS token FROM f"
_VOCAB = "t AS (" + _TOK + "), v AS (SELECT token, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, token) + 1 AS id FROM t GROUP BY token QUALIFY id <= 9999)"
ORACLE = {
    "c8_suppressions": _L
    + r", u AS (SELECT file_id, unnest(ls) AS line, CAST(generate_subscripts(ls, 1) AS BIGINT) AS lineno FROM l) SELECT file_id, lineno, list_filter(list_transform(string_split(regexp_extract(line, '#\s*codescan:\s*ignore(?:\[([^\]]*)\])?', 1), ','), lambda x: trim(x)), lambda x: x <> '') AS rules FROM u WHERE regexp_matches(line, '#\s*codescan:\s*ignore')",
    "d2_line_lengths": _L
    + f", n AS (SELECT file_id, list_transform({_NB}, lambda x: length(x)) AS n FROM l) SELECT file_id, coalesce(list_max(n), 0) AS max_len, round(coalesce(list_avg(n), 0.0), 4) AS avg_len, CAST(len(list_filter(n, lambda x: x > 80)) AS BIGINT) AS over_80 FROM n",
    "d24_loc": _L
    + r"SELECT file_id, CAST(len(list_filter(ls, lambda x: regexp_matches(x, '\S') AND NOT regexp_matches(x, '^\s*#'))) AS BIGINT) AS loc, (length(code) < 30 OR len(ls) < 3) AS too_short FROM l",
    "d7_halstead": _L
    + rf""", h AS (SELECT file_id, regexp_extract_all(code, '{T.HALSTEAD_OPERATORS}') AS o, regexp_extract_all(code, '{T.HALSTEAD_OPERANDS}') AS a,
 1 + len(regexp_extract_all(code, '\b(?:if|for|while|case|catch|except|elif)\b|&&|\|\|')) AS cc, len({_NB}) AS sloc FROM l),
m AS (SELECT file_id, CAST(len(list_distinct(o)) AS BIGINT) AS n1, CAST(len(list_distinct(a)) AS BIGINT) AS n2, CAST(len(o) AS BIGINT) AS big_n1, CAST(len(a) AS BIGINT) AS big_n2, cc, sloc FROM h),
w AS (SELECT *, CASE WHEN n1 + n2 > 0 THEN (big_n1 + big_n2) * log2(n1 + n2) ELSE 0 END AS volume, CASE WHEN n2 > 0 THEN n1 / 2 * big_n2 / n2 ELSE 0 END AS difficulty FROM m)
SELECT file_id, n1, n2, big_n1, big_n2, round(volume, 4) AS volume, round(difficulty, 4) AS difficulty, round(volume * difficulty, 3) AS effort, round(volume / 3000, 6) AS bugs,
 round(CASE WHEN volume <= 0 OR sloc <= 0 THEN 100.0 ELSE greatest(0.0, least(100.0, (171 - 5.2 * ln(volume) - 0.23 * cc - 16.2 * ln(sloc)) * 100 / 171)) END, 4) AS maintainability FROM w""",
    "d13_normalised": _L
    + r", s AS (SELECT file_id, trim(regexp_replace(array_to_string(list_filter(list_transform(ls, lambda x: rtrim(split_part(x, '#', 1))), lambda x: x <> ''), chr(10)), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS b FROM l) SELECT file_id, CAST(length(b) AS BIGINT) AS n_chars, md5(b) AS fingerprint FROM s",
    "d16_sub_tokens": _L
    + ", t AS (" + _TOK + r"), s AS (SELECT unnest(string_split(lower(regexp_replace(token, '([a-z0-9])([A-Z])', '\1_\2', 'g')), '_')) AS sub_token FROM t) SELECT sub_token, count(*) AS n FROM s WHERE sub_token <> '' GROUP BY 1",
    "d18_vocabulary": _L + "," + _VOCAB + " SELECT token, n, id FROM v",
    "d19_token_ids": _L
    + "," + _VOCAB + ", p AS (SELECT file_id, unnest(regexp_extract_all(code, '[A-Za-z_][A-Za-z0-9_]*')[:512]) AS token, generate_subscripts(regexp_extract_all(code, '[A-Za-z_][A-Za-z0-9_]*')[:512], 1) AS pos FROM f), s AS (SELECT file_id, list(coalesce(id, 1) ORDER BY pos) AS ids FROM p LEFT JOIN v USING (token) GROUP BY 1) SELECT f.file_id, list_concat(coalesce(ids, []), list_transform(range(512 - coalesce(len(ids), 0)), lambda x: 0)) AS ids FROM f LEFT JOIN s USING (file_id)",
    "d10_languages": f"SELECT file_id, coalesce({_EXT}, nullif(lower(trim(language)), '')) AS detected, coalesce(coalesce({_EXT}, lower(trim(language))) IN ("
    + ", ".join(f"'{x}'" for x in sorted(set(T.EXTENSIONS.values())))
    + f"), false) AS supported, coalesce(repo, split_part(path, '/', 1) || '/' || split_part(path, '/', 2)) AS repo_label, regexp_replace(path, '@[0-9a-f]{{7,40}}$', '') AS file_key FROM {FILES}",
    "d23_keyword_scan": f"SELECT file_id, (" + " OR ".join(f"contains(code, '{k}')" for k in DANGEROUS) + f") AS dangerous FROM {FILES} WHERE code IS NOT NULL",
    "d28_string_literals": _L
    + r""", e AS (SELECT file_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS lineno FROM l)
SELECT file_id, CAST(lineno AS BIGINT) AS lineno, regexp_matches(trim(regexp_extract(line, '[A-Za-z_][A-Za-z0-9_]*\(([^,()]*)', 1)), '^[bBrRuUfF]{0,2}("[^"]*"|''[^'']*'')$') AS is_literal,
 CAST((length(line) - length(replace(line, '(', ''))) - (length(line) - length(replace(line, ')', ''))) AS BIGINT) AS left_open FROM e WHERE regexp_matches(line, '[A-Za-z_]\w*\(')""",
}
