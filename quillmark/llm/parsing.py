"""Problem 3: source files that do not parse, per file, repo and language."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions.normalize import language, repo_key
from quillmark.llm.syntax import CHECKS
from quillmark.sources.tables import table

#: Calls of the recursive descent, all from Python to Python: they take frames on the heap (about 0.1 kB each), no stack.
#: Nesting of some 200,000 levels, which no compiler accepts, is reported as a fault.
RECURSION = 2_000_000
_FAULT = pa.struct([("line", pa.int32()), ("message", pa.string())])


def parse(rows: DataFrame) -> DataFrame:
    """The columns of ``rows`` but source, with parsed (boolean) and faults (array of line, message; the first
    is the first cause).  ``rows`` has lang and source.  Null and empty sources, and languages without a
    parser, give null and no faults."""
    kept = [c for c in rows.columns if c != "source"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(max(RECURSION, sys.getrecursionlimit()))
        for part in parts:
            oks, faults = [], []
            for lang, source in zip(part.column("lang").to_pylist(), part.column("source").to_pylist()):
                check = CHECKS.get(lang) if source else None
                found = check(source) if check else []
                oks.append(not found if check else None)
                faults.append([{"line": f.line, "message": f.message} for f in found])
            arrays = [part.column(c) for c in kept] + [pa.array(oks, pa.bool_()), pa.array(faults, pa.list_(_FAULT))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, "parsed", "faults"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in kept)
    return rows.mapInArrow(run, f"{schema}, parsed boolean, faults array<struct<line:int,message:string>>")


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name, path in (("security_dataset", "origin"), ("bug_dataset", "file")):
        part = table(spark, sf_dir, name).select(
            F.lit(name).alias("dataset"),
            "record_id",
            repo_key(F.col("repo")).alias("repo"),
            language(F.col("code_lang"), F.col(path)).alias("lang"),
            "source",
        )
        out = part if out is None else out.unionByName(part)
    return out


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dataset, record_id of the sources that are not valid under their language's grammar."""
    rows = _rows(spark, sf_dir).select("dataset", "record_id", "lang", "source")
    return parse(rows).where("not parsed").select("dataset", "record_id")


def p3_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dataset, record_id, lang, nth, line, message: every fault; nth 0 is the first cause."""
    rows = parse(_rows(spark, sf_dir)).where("not parsed")
    return rows.select("dataset", "record_id", "lang", F.posexplode("faults").alias("nth", "f")).select(
        "dataset", "record_id", "lang", "nth", F.col("f.line").alias("line"), F.col("f.message").alias("message")
    )


def p3_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dataset, repo, lang, n (sources parsed), n_invalid, share_valid; null repos form one row a language."""
    rows = parse(_rows(spark, sf_dir)).where("parsed is not null")
    out = rows.groupBy("dataset", "repo", "lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("parsed")).alias("n_invalid"))
    return out.withColumn("share_valid", F.round(1 - F.col("n_invalid") / F.col("n"), 6))


QUERIES = {"p3_found": p3_found, "p3_errors": p3_errors, "p3_rates": p3_rates}
