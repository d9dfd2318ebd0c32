"""Readers and writers of the file formats (sections A and B)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillmark.functions.normalize import language
from quillmark.functions.text import detect_language
from quillmark.sources.tables import shared_dir, table


def read_tree(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """A.1, A.10, A.13: path, language, code of the files below a folder (whole files, nested folders too)."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return f.select("path", detect_language(F.col("path"), F.lit(None).cast("string")).alias("language"), F.decode("content", "UTF-8").alias("code"))


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A.6, A.17, A.18: JSON lines; blank lines are skipped, broken ones kept in ``_corrupt_record``."""
    s = schema if isinstance(schema, str) else schema.simpleString()
    s = s if isinstance(schema, StructType) else s + ", _corrupt_record string"
    return spark.read.schema(s).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    """B.1, B.2, B.5: JSON lines; null fields are kept."""
    df.write.mode("append" if append else "overwrite").option("ignoreNullFields", "false").json(path)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """A.5: clone pairs of a CSV with quoted line breaks; rows without label 0 or 1 or without code are dropped."""
    c = spark.read.option("header", "true").option("multiLine", "true").option("lineSep", "\n").option("escape", '"').schema("func1_id string, func2_id string, label string, func1_code string, func2_code string").csv(path)
    return c.where("label in ('0', '1') and trim(func1_code) <> '' and trim(func2_code) <> ''").withColumn("label", F.col("label").cast("int"))


def read_jdbc(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """A.2, A.3: a query of a database; needs the database's driver on the class path."""
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def vulnerable_functions(changes: DataFrame, fixes: DataFrame, cves: DataFrame, least: int = 50) -> DataFrame:
    """A.2, A.3: changes joined to fixes by hash and to entries by id; code present and long enough."""
    ok = changes.where((F.length("code_before") > least) & (F.col("code_before") != F.coalesce("code_after", F.lit(""))))
    return ok.join(fixes, "hash").join(cves, "cve_id").select("hash", "cve_id", F.coalesce("cwe", F.lit("unknown")).alias("cwe"), "code_before", "code_after")


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def a6_jsonl_round_trip(spark, sf_dir):
    """The failure table through JSON lines and back."""
    t = table(spark, sf_dir, "failure_taxonomy_results").select("result_id", "run_id", "task", "held_out_project", "auc")
    path = _folder(spark, "jsonl")
    write_jsonl(t.where("result_id % 2 = 0"), path)
    write_jsonl(t.where("result_id % 2 = 1"), path, append=True)
    return read_jsonl(spark, path, "result_id long, run_id string, task string, held_out_project string, auc double").drop("_corrupt_record")


def a5_csv_round_trip(spark, sf_dir):
    """Pairs of sources through CSV with quoted line breaks and back."""
    s = table(spark, sf_dir, "pattern_dataset").where("source is not null")
    p = s.select(F.col("record_id").cast("string").alias("func1_id"), F.col("record_id").cast("string").alias("func2_id"), (F.col("record_id") % 3).cast("string").alias("label"), F.col("source").alias("func1_code"), F.col("source").alias("func2_code"))
    path = _folder(spark, "csv")
    p.write.option("header", "true").option("escape", '"').option("quoteAll", "true").option("lineSep", "\n").option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path)
    return read_pairs(spark, path).select(F.col("func1_id").cast("long").alias("id"), "label", F.length("func1_code").cast("long").alias("n_chars"))


def a1_tree_scan(spark, sf_dir):
    """Files written to a folder, then scanned as a tree with language by extension."""
    s = table(spark, sf_dir, "security_dataset").where(F.col("source").isNotNull() & (language(F.col("code_lang"), F.col("origin")) == "python"))
    path = _folder(spark, "tree")
    s.select(F.col("source").alias("value")).repartition(4).write.option("lineSep", "\n").text(path)
    t = read_tree(spark, path, "*.txt")
    return t.agg(F.count(F.lit(1)).alias("n_files"), F.sum(F.length("code")).alias("n_chars"))


def a2_cve_join(spark, sf_dir):
    """The CVE joins over findings (entries), their records (fixes) and sources (changes)."""
    f = table(spark, sf_dir, "security_finding").where("record_id is not null")
    changes = table(spark, sf_dir, "security_dataset").select(F.col("record_id").alias("hash"), F.col("source").alias("code_before"), F.reverse("source").alias("code_after"))
    fixes = f.select(F.col("record_id").alias("hash"), F.col("finding_id").alias("cve_id"))
    cves = f.select(F.col("finding_id").alias("cve_id"), F.when(F.col("cwe") != "", F.col("cwe")).alias("cwe"))
    return vulnerable_functions(changes, fixes, cves).select("hash", "cve_id", "cwe", F.length("code_before").cast("long").alias("n_chars"))


ADVISORY = (
    "id string, summary string, details string, severity array<struct<type:string,score:string>>, "
    "affected array<struct<package:struct<ecosystem:string,name:string>,versions:array<string>>>"
)


def read_advisories(spark: SparkSession, path: str, ecosystem: str = "PyPI") -> DataFrame:
    """A.4: cve_id, package, score, source of every advisory (one JSON object a line) and package of the ecosystem: the
    first readable severity score (null if none) and the first fenced code block of the details; advisories
    without code give no row, broken lines neither."""
    a = spark.read.schema(ADVISORY).json(path)
    score = F.try_element_at(F.filter(F.transform("severity", lambda x: F.split_part(x["score"], F.lit("/"), F.lit(1)).try_cast("double")), lambda x: x.isNotNull()), F.lit(1))
    code = F.regexp_extract("details", r"(?s)```(?:python)?\n(.+?)```", 1)
    x = a.select(F.col("id").alias("cve_id"), score.alias("score"), code.alias("source"), F.explode("affected").alias("p")).where("source <> ''")
    return x.where(F.col("p.package.ecosystem") == ecosystem).select("cve_id", F.col("p.package.name").alias("package"), "score", "source")


def a4_advisories(spark, sf_dir):
    """A.4: findings written as nested advisories (their snippet in the details, their record as package) and read back."""
    f = table(spark, sf_dir, "security_finding").where("record_id is not null and snippet is not null")
    package = F.struct(F.struct(F.when(F.col("record_id") % 7 == 0, "npm").otherwise("PyPI").alias("ecosystem"), F.concat(F.lit("p"), "record_id").alias("name")).alias("package"), F.array(F.lit("1.0")).alias("versions"))
    severity = F.array(F.struct(F.lit("CVSS_V3").alias("type"), F.concat(F.round(F.col("confidence") * 10, 1).cast("string"), F.lit("/AV:N")).alias("score")))
    details = F.concat(F.lit("See below.\n```python\n"), "snippet", F.lit("```\nEnd."))
    path = _folder(spark, "advisories")
    f.select(F.col("finding_id").cast("string").alias("id"), F.col("title").alias("summary"), details.alias("details"), severity.alias("severity"), F.array(package).alias("affected")).write.json(path)
    return read_advisories(spark, path).select("cve_id", "package", "score", F.length("source").cast("long").alias("n_chars"))


QUERIES = {f.__name__: f for f in (a6_jsonl_round_trip, a5_csv_round_trip, a1_tree_scan, a2_cve_join, a4_advisories)}
ORACLE = {
    "a4_advisories": "SELECT CAST(finding_id AS VARCHAR) AS cve_id, 'p' || record_id AS package, round(confidence * 10, 1) AS score, CAST(length(snippet) AS BIGINT) AS n_chars FROM security_finding WHERE record_id IS NOT NULL AND length(snippet) > 0 AND record_id % 7 <> 0",
    "a6_jsonl_round_trip": "SELECT result_id, run_id, task, held_out_project, auc FROM failure_taxonomy_results",
    "a5_csv_round_trip": "SELECT record_id AS id, CAST(record_id % 3 AS INT) AS label, length(source) AS n_chars FROM pattern_dataset WHERE regexp_matches(source, '[^ ]') AND record_id % 3 < 2",
    "a2_cve_join": "SELECT s.record_id AS hash, finding_id AS cve_id, coalesce(nullif(cwe, ''), 'unknown') AS cwe, length(source) AS n_chars FROM security_finding f JOIN security_dataset s ON s.record_id = f.record_id WHERE length(source) > 50 AND source <> reverse(source)",
}
