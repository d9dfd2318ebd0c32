"""The registry of queries: name -> function of (spark, sf_dir), and name -> SQL of its oracle."""

from __future__ import annotations

import functools
import importlib
import io
import tempfile
import weakref
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

#: Modules with QUERIES and ORACLE, in the order they are listed.
MODULES = [
    "quillmark.operators.skew",
    "quillmark.operators.text_metrics",
    "quillmark.operators.rule_scan",
    "quillmark.operators.history",
    "quillmark.operators.evaluation",
    "quillmark.operators.changes",
    "quillmark.operators.clones",
    "quillmark.operators.scoring",
    "quillmark.operators.checks",
    "quillmark.operators.enrichment",
    "quillmark.operators.structure",
    "quillmark.sources.formats",
    "quillmark.streaming.replay",
    "quillmark.plans.models",
    "quillmark.api",
]


_SHIPPED: weakref.WeakSet = weakref.WeakSet()


def ship(spark: SparkSession) -> None:
    """Give the package to the Python workers of a session (once), so that they find it wherever they run."""
    sc = spark.sparkContext
    if sc in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    path = Path(tempfile.mkdtemp(prefix="quillmark-")) / "quillmark.zip"  # Spark copies it to the executors
    path.write_bytes(data.getvalue())
    sc.addPyFile(str(path))
    _SHIPPED.add(sc)


def _shipping(query: Query) -> Query:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


def collect(modules: list[str]) -> tuple[dict[str, Query], dict[str, str]]:
    found: dict[str, Query] = {}
    sql: dict[str, str] = {}
    for name in modules:
        module = importlib.import_module(name)
        for key, query in module.QUERIES.items():
            if key in found:
                raise ValueError(f"two queries are named {key}")
            found[key] = _shipping(query)
        sql.update(getattr(module, "ORACLE", {}))
    return found, sql
