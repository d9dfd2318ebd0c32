"""Per-key results when a few keys hold most rows: exact offset chunking.

1. Count the rows of each key in each input block (partial aggregation; one row per key and block).
2. Prefix-sum the counts over the blocks of a key: every block knows at which number its rows of the
   key begin.
3. Number each row: the block's offset plus its rank among the rows of its key in the block.  Blocks
   have a bounded size, so no task sees more than ``block_rows`` rows of a key.
4. Equal-sized chunks of consecutive numbers are processed one by one; their boundary states (here:
   counts, sums, first and last value) are merged in order.

The block is named by file and row position, not by task, so a task that runs again numbers its rows
the same way.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmark.functions.normalize import repo_key
from quillmark.sources.tables import materialize, table

BLOCK_ROWS = 1 << 14
CHUNK_ROWS = 1 << 14


def with_blocks(df: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add ``_block`` and ``_pos`` (position in the file) to a DataFrame read directly from Parquet."""
    return df.withColumns(
        {
            "_block": F.concat_ws(
                "#", F.col("_metadata.file_path"), F.expr(f"_metadata.row_index div {block_rows}").cast("string")
            ),
            "_pos": F.col("_metadata.row_index"),
        }
    )


def number_rows(df: DataFrame, key: str) -> DataFrame:
    """Add ``_n``: 0, 1, ... within each value of ``key``, in the order of blocks and positions.

    ``df`` has ``_block`` and ``_pos``.  The key is compared null-safely: null is a key like any other.
    Only the table of counts (keys times blocks) is sorted by key; rows are shuffled by key and block.
    """
    counts = df.groupBy(key, "_block").agg(F.count(F.lit(1)).alias("_rows"))
    before = W.partitionBy(key).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(
        F.col(key).alias("_k"), F.col("_block").alias("_b"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset")
    )
    rank = W.partitionBy(key, "_block").orderBy("_pos")
    ranked = df.withColumn("_rank", F.row_number().over(rank) - 1)
    joined = ranked.join(offsets, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_block") == F.col("_b")))
    return joined.withColumn("_n", F.col("_offset") + F.col("_rank")).drop("_k", "_b", "_offset", "_rank")


HEAVY_PARTS, LEAST_HEAVY = 1024, 100_000


def join_heavy(df: DataFrame, small: DataFrame, on: list[str], rows: str, total: int, least: int = LEAST_HEAVY) -> DataFrame:
    """Inner join of ``df`` with ``small``, which has one row a key and in ``rows`` the number of rows that ``df`` has
    of the key (an upper bound will do); ``total`` is the number of all rows of ``df``.

    Keys with at least a 1024th of all rows (and ``least``) are at most 1024 by that definition; their rows of
    ``small`` are broadcast and no row of ``df`` that has such a key is moved.  The rest is shuffled, and no key of it
    is heavy.  Where ``df`` has fewer than ``least`` rows no key can be heavy.  Null keys match nothing.  Empty input: no
    rows.
    """
    at = max(least, total // HEAVY_PARTS)
    if total < at:
        return df.join(small, on)
    heavy = small.where(F.col(rows) >= at)
    there = df.join(F.broadcast(heavy), on)
    rest = df.join(F.broadcast(heavy.select(*on)), on, "left_anti").join(small.where(F.col(rows) < at), on)
    return there.unionByName(rest)


def in_order(df: DataFrame, order: list[Column], sums: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """Add rn (1, 2, ... over all rows in ``order``), n (all rows) and cum_<c> (running sum of c up to the row).

    Rows are cut into ranges of the whole order, ties included, so ``order`` should end in an id: no task sorts more than
    its range, however many rows share a value.  The ranges are written once, so numbers hold when a task runs again;
    their counts and sums (one row a range) offset the numbers within.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    t = materialize(df.repartitionByRange(parts, *order).withColumn("_p", F.spark_partition_id()), "ordered")
    per = t.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), *(F.sum(c).alias(f"_s_{c}") for c in sums))
    kinds = [per.schema[f"_s_{c}"].dataType.simpleString() for c in sums]
    found = sorted(per.collect(), key=lambda r: r["_p"])
    offsets, seen, totals = [], 0, [0.0 if k == "double" else 0 for k in kinds]
    for r in found:
        offsets.append((r["_p"], seen, *totals))
        seen += r["_n"]
        totals = [t + (r[f"_s_{c}"] or 0) for t, c in zip(totals, sums)]
    offsets = spark.createDataFrame(offsets, "_p int, _o long" + "".join(f", _o_{c} {k}" for c, k in zip(sums, kinds)))
    w = W.partitionBy("_p").orderBy(*order)
    out = t.join(F.broadcast(offsets), "_p").withColumns({"rn": F.col("_o") + F.row_number().over(w), "n": F.lit(seen).cast("long")})
    for c in sums:
        out = out.withColumn(f"cum_{c}", F.col(f"_o_{c}") + F.sum(c).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return out.drop("_p", "_o", *(f"_o_{c}" for c in sums))


def places(df: DataFrame, part: list[str], order: list[Column]) -> DataFrame:
    """Add place (1, 2, ... within ``part`` in ``order``): the number in one order over all parts less the part's first
    number, so a part that holds many rows is cut into ranges like the rest.  Rows with a null part go."""
    x = in_order(df, [*(F.asc(c) for c in part), *order])
    first = x.groupBy(*part).agg(F.min("rn").alias("_first"), F.count(F.lit(1)).alias("_k"))
    row = x.select("n").first()
    return join_heavy(x, first, part, "_k", row.n if row else 0).withColumn("place", F.col("rn") - F.col("_first") + 1).drop("rn", "n", "_first", "_k")


def running(
    df: DataFrame,
    keys: list[str],
    chunk: str,
    order: list[Column],
    sums: dict[str, Column],
    tops: dict[str, Column] | None = None,
    base: DataFrame | None = None,
    least: int = LEAST_HEAVY,
) -> DataFrame:
    """Add for each of ``sums`` the sum, and of ``tops`` the greatest value, over the rows of the same ``keys`` that come
    before in ``order`` (0 and null where there are none).  Rows with a null key go.

    Keys with at least a 1024th of all rows (and ``least``), at most 1024 by definition, are cut by ``chunk``, a column
    that grows with ``order`` (a month; not null): a task sorts one chunk of such a key, and the states at the chunks'
    boundaries come from their aggregates.  Other keys are one window each.  ``base`` has the same rows and the columns
    that are used; give a written table where ``df`` is a chain of steps, which is then read once.
    """
    tops, base = tops or {}, base or df
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    df, base = df.where(known), base.where(known)
    names, values = [*sums, *tops], {f"_v_{n}": c for n, c in {**sums, **tops}.items()}

    def over(w: W, prefix: str, out: str) -> dict[str, Column]:
        return {f"{out}{n}": F.sum(f"{prefix}{n}").over(w) for n in sums} | {f"{out}{n}": F.max(f"{prefix}{n}").over(w) for n in tops}

    per = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("_k"))
    seen = per.agg(F.sum("_k").alias("n"), F.max("_k").alias("top")).first()
    at = max(least, (seen.n or 0) // HEAVY_PARTS)
    columns = df.columns
    df = df.withColumns(values)
    before = (W.unboundedPreceding, -1)
    if (seen.top or 0) < at:
        w = W.partitionBy(*keys).orderBy(*order).rowsBetween(*before)
        out = df.withColumns(over(w, "_v_", "_w_")).withColumns({f"_o_{n}": F.lit(None) for n in names})
    else:
        heavy = F.broadcast(per.where(F.col("_k") >= at).select(*keys, F.lit(True).alias("_h")))
        parts = base.join(heavy, keys).select(*keys, F.col(chunk).alias("_c"), *(c.alias(n) for n, c in values.items())).groupBy(*keys, "_c")
        parts = parts.agg(*(F.sum(f"_v_{n}").alias(f"_p_{n}") for n in sums), *(F.max(f"_v_{n}").alias(f"_p_{n}") for n in tops))
        parts = parts.select(*keys, "_c", *(c.alias(n) for n, c in over(W.partitionBy(*keys).orderBy("_c").rowsBetween(*before), "_p_", "_o_").items()))
        w = W.partitionBy(*keys, "_c").orderBy(*order).rowsBetween(*before)
        inner = df.join(heavy, keys, "left").withColumn("_c", F.when(F.col("_h"), F.col(chunk))).withColumns(over(w, "_v_", "_w_"))
        out = inner.join(parts, [*keys, "_c"], "left")
    zero = F.lit(0)
    out = out.withColumns({n: F.coalesce(f"_o_{n}", zero) + F.coalesce(f"_w_{n}", zero) for n in sums} | {n: F.coalesce(f"_w_{n}", f"_o_{n}") for n in tops})
    return out.select(*columns, *names)


def chunked_results(
    df: DataFrame, key: str, measures: dict[str, Column], merges: dict[str, Column], chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Results per key from equal-sized chunks.

    ``measures`` are aggregates of a chunk.  ``merges`` combine them over a key's chunks; they may use
    ``_chunk`` for order (``min_by(x, _chunk)`` is the state at the first boundary).  Empty input: no rows.
    """
    numbered = number_rows(df, key).withColumn("_chunk", F.expr(f"_n div {chunk_rows}"))
    parts = numbered.groupBy(key, "_chunk").agg(*(c.alias(n) for n, c in measures.items()))
    return parts.groupBy(key).agg(F.count(F.lit(1)).alias("chunks"), *(c.alias(n) for n, c in merges.items()))


def _counts(df: DataFrame, key: str, value: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    dec = F.col(value).cast("decimal(20,8)")
    measures = {
        "n": F.count(F.lit(1)),
        "n_value": F.count(value),
        "total": F.sum(dec),
        "first_pos": F.min("_n"),
        "last_pos": F.max("_n"),
    }
    merges = {
        "n_rows": F.sum("n"),
        "n_value": F.sum("n_value"),
        "total": F.sum("total"),
        "first_pos": F.min_by("first_pos", "_chunk"),
        "last_pos": F.max_by("last_pos", "_chunk"),
    }
    return chunked_results(df, key, measures, merges, chunk_rows)


def keyed_inputs(spark: SparkSession, sf_dir: str) -> dict[str, tuple[DataFrame, str]]:
    """The two tables of the problem with their key as ``key``; nan counts as no value."""
    bug = with_blocks(table(spark, sf_dir, "bug_dataset")).select(
        repo_key(F.col("repo")).alias("key"), F.col("label").cast("double").alias("value"), "_block", "_pos"
    )
    bug = bug.withColumn("value", F.when(F.isnotnull("value"), (F.col("value") == 1).cast("double")))
    failure = with_blocks(table(spark, sf_dir, "failure_taxonomy_results")).select(
        F.col("held_out_project").alias("key"), F.nanvl("auc", F.lit(None)).alias("value"), "_block", "_pos"
    )
    return {"bug_dataset": (bug, "share_label_1"), "failure_taxonomy_results": (failure, "mean_auc")}


def p5_key_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dataset, key, n_rows, share_label_1, mean_auc of every key; null keys form one row of their own.

    ``share_label_1`` is over rows that have a label, ``mean_auc`` over rows that have an auc; null where
    there is none.
    """
    out = None
    for name, (df, measure) in keyed_inputs(spark, sf_dir).items():
        mean = F.try_divide(F.col("total").cast("double"), F.col("n_value"))
        null = F.lit(None).cast("double")
        part = _counts(df, "key", "value").select(
            F.lit(name).alias("dataset"),
            "key",
            "n_rows",
            F.round(mean if measure == "share_label_1" else null, 6).alias("share_label_1"),
            F.round(mean if measure == "mean_auc" else null, 6).alias("mean_auc"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def heavy_keys(df: DataFrame, key: str, value: str, share: float = 0.05) -> DataFrame:
    """Keys that hold at least ``share`` of all rows, counted by the chunked operator; null is no key.

    The counts (one row a key) are written once and read for both the keys and the total.
    """
    counted = materialize(_counts(df, key, value).select(key, "n_rows"), "keys")
    whole = counted.agg(F.sum("n_rows").alias("_all"))  # one row
    return counted.join(F.broadcast(whole)).where(F.col(key).isNotNull() & (F.col("n_rows") >= F.lit(share) * F.col("_all")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dataset, heavy_key of the keys with at least 5 % of all rows of their table."""
    out = None
    for name, (df, _) in keyed_inputs(spark, sf_dir).items():
        part = heavy_keys(df, "key", "value").select(F.lit(name).alias("dataset"), F.col("key").alias("heavy_key"))
        out = part if out is None else out.unionByName(part)
    return out


QUERIES = {"p5_found": p5_found, "p5_key_results": p5_key_results}

_KEYED = r"""
WITH keyed AS (
  SELECT 'bug_dataset' AS dataset,
         nullif(regexp_extract(regexp_replace(lower(trim(repo)), '(?:/|\.git)+$', ''), '([^/:@\s]+)/([^/\s]+)$', 0), '') AS key,
         CASE WHEN label IS NOT NULL THEN CASE WHEN label = 1 THEN 1.0 ELSE 0.0 END END AS y,
         CAST(NULL AS DOUBLE) AS auc
  FROM bug_dataset
  UNION ALL
  SELECT 'failure_taxonomy_results', held_out_project, NULL, CASE WHEN NOT isnan(auc) THEN auc END
  FROM failure_taxonomy_results)
"""
ORACLE = {
    "p5_found": _KEYED
    + """, n AS (SELECT dataset, key, count(*) AS c, sum(count(*)) OVER (PARTITION BY dataset) AS total FROM keyed GROUP BY 1, 2)
SELECT dataset, key AS heavy_key FROM n WHERE key IS NOT NULL AND c >= 0.05 * total""",
    "p5_key_results": _KEYED
    + """SELECT dataset, key, CAST(count(*) AS BIGINT) AS n_rows, round(avg(CAST(y AS DOUBLE)), 6) AS share_label_1,
    round(avg(auc), 6) AS mean_auc FROM keyed GROUP BY 1, 2""",
}
