"""Near-duplicate sources: problem 4 (min-max hashing) and problem 2 (bit fingerprints across splits).

Both follow one plan.

1. *Signatures* (Arrow batches, NumPy): of each text the set of word shingles, a 128-bit name of the set and a
   similarity fingerprint of 160 min-max codes of 16 bits: ``BANDS`` segments of ``ROWS`` codes (64 bits each, the
   join keys), and the lowest bits of the first 128 codes, on which the Hamming distance is taken.
2. *Classes*: texts with the same set are one class; only classes are compared.
3. *Candidates*: classes that share a segment meet in its bucket.  Buckets are counted by partial aggregation; those
   of one class are dropped.
4. *Hot buckets* (over ``HOT`` classes) are not paired.  Their classes meet once more, exactly and whatever the
   number of buckets they share: sets of similarity t have a shingle in common among the n - ceil(t n) + 1 rarest
   shingles of each (one order for all sets).  Text that a whole bucket shares is common, so it is no such key.
   Keys that are hot even then are cut into blocks of ``BLOCK`` classes, and block meets block: all pairs of the key
   are compared, none in a task of more than 2 * ``BLOCK`` classes a key.
5. A candidate must lie within ``RADIUS`` of the fingerprints' Hamming distance.
6. *Verification*: exact similarity of the texts' shingle sets.
7. Class pairs are expanded to record pairs by membership.

A pair of similarity s shares a segment with probability 1 - (1 - s**ROWS)**BANDS: at the bound 0.7 all but
2e-5 of the pairs, at 0.75 all but 4e-7; step 4 adds nothing to what is lost.  Its fingerprints differ in (1 - s)/2 of
128 bits: 19 +- 4 at 0.7.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions.normalize import clean_name, repo_key
from quillmark.llm.shingles import MinMax, batches, jaccard, set_ids, shingle_sets
from quillmark.operators.components import connected_components
from quillmark.operators.skew import join_heavy
from quillmark.sources.tables import materialize, table

WORDS, THRESHOLD = 4, 0.7
BANDS, ROWS = 40, 4
FINGERPRINT_BITS, RADIUS = 128, 38
HOT, BLOCK = 64, 1024
CELLS = 1 << 16  # hashed counters of shingles: the order of rareness has a fixed size
BROADCAST_PAIRS = 500_000  # candidate pairs (or hot classes) whose ends may be broadcast to the scan of the texts

SIGNATURE = "n int, s1 long, s2 long, f1 long, f2 long, keys array<long>"


def _pack(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=1).view(np.uint64).view(np.int64)


def signatures(df: DataFrame, text: str, salt: str, words: int = WORDS) -> DataFrame:
    """``df`` without ``text``, with the columns of SIGNATURE; texts without shingles are left out.

    ``salt``: a column whose values are never compared with each other (the table's name).
    """
    kept = [c for c in df.columns if c != text]
    places = [df.columns.index(c) for c in kept]
    at, at_salt = df.columns.index(text), df.columns.index(salt)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        banding = MinMax(BANDS * ROWS // 2, seed=7)
        mult = np.random.default_rng(13).integers(1, 2**63, size=(BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        salts: dict[str, np.uint64] = {}
        for part in parts:
            texts = part.column(at).to_pylist()
            names = part.column(at_salt).to_pylist()
            for a, b in batches(texts):
                hashes, offsets = shingle_sets(texts[a:b], words)
                sizes = np.diff(offsets)
                has = np.flatnonzero(sizes)
                if not len(has):
                    continue
                codes = banding.codes(hashes, offsets)
                finger = _pack((codes[:, :FINGERPRINT_BITS] & 1).astype(np.uint8))
                key = (codes.reshape(len(has), BANDS, ROWS).astype(np.uint64) * mult).sum(axis=2, dtype=np.uint64)
                for name in set(names[a:b]):
                    salts.setdefault(name, np.uint64(int.from_bytes(blake2b(str(name).encode(), digest_size=8).digest(), "big")))
                key = (key ^ np.array([salts[names[a + i]] for i in has], np.uint64)[:, None]) * np.uint64(0x9E3779B97F4A7C15)
                s1, s2 = set_ids(hashes, offsets)
                flat = pa.array(np.ascontiguousarray(key).view(np.int64).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(has) + 1, dtype=np.int32) * BANDS), flat)
                old = part.take(pa.array(has + a))
                yield pa.RecordBatch.from_arrays(
                    [old.column(p) for p in places]
                    + [pa.array(sizes[has].astype(np.int32)), pa.array(s1), pa.array(s2)]
                    + [pa.array(np.ascontiguousarray(finger[:, 0])), pa.array(np.ascontiguousarray(finger[:, 1])), lists],
                    names=kept + ["n", "s1", "s2", "f1", "f2", "keys"],
                )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in kept)
    return df.mapInArrow(run, f"{schema}, {SIGNATURE}")


def classes(signed: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """One row per (dataset, shingle set): rep (smallest id), signature, and each flag's maximum."""
    return signed.groupBy("dataset", "s1", "s2").agg(
        F.min("record_id").alias("rep"),
        F.first("n").alias("n"),
        F.first("f1").alias("f1"),
        F.first("f2").alias("f2"),
        F.first("keys").alias("keys"),
        F.count(F.lit(1)).alias("copies"),
        *(F.max(c).alias(name) for name, c in flags.items()),
    )


def _near() -> Column:
    """Condition on sides ``x`` and ``y``: sizes that can reach the threshold, fingerprints within the radius."""
    near = F.bit_count(F.col("x.f1").bitwiseXOR(F.col("y.f1"))) + F.bit_count(F.col("x.f2").bitwiseXOR(F.col("y.f2")))
    return (F.least("x.n", "y.n") >= F.lit(THRESHOLD - 1e-9) * F.greatest("x.n", "y.n")) & (near <= RADIUS)


def _pairs(joined: DataFrame) -> DataFrame:
    return joined.select(F.col("x.dataset").alias("dataset"), F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b"))


def _met(rows: DataFrame, useful: Column) -> DataFrame:
    """The rows whose key holds at least two classes and passes ``useful`` (a condition on the maxima of the flags),
    with ``m``, the number of classes of the key.

    Counted by partial aggregation, so a key of any size costs each task one row; the join back has few keys
    and is broadcast or split by the engine as their size asks for.
    """
    flags = [c for c in rows.columns if c not in ("dataset", "rep", "n", "f1", "f2", "key")]
    counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("m"), *(F.max(c).alias(c) for c in flags)).where((F.col("m") >= 2) & useful)
    return rows.join(counts.select("key", "m"), "key")


def _cold_pairs(met: DataFrame, allowed: Column, hot: int) -> DataFrame:
    cold = met.where(F.col("m") <= hot).drop("m")
    x, y = cold.alias("x"), cold.alias("y")
    same = (F.col("x.key") == F.col("y.key")) & (F.col("x.dataset") == F.col("y.dataset")) & (F.col("x.rep") < F.col("y.rep"))
    return _pairs(x.join(y, same & _near() & allowed))


def _block_pairs(met: DataFrame, allowed: Column, hot: int, block: int) -> DataFrame:
    """All pairs of the hot keys: each key's classes are dealt to m / block groups by hash, and each pair of groups
    (lo <= hi) is a join key of its own."""
    rows = met.where(F.col("m") > hot).withColumn("_g", F.ceil(F.col("m") / block).cast("int"))
    rows = rows.withColumn("_i", F.pmod(F.xxhash64("rep"), F.col("_g")).cast("int"))
    x = rows.withColumn("lo", F.col("_i")).withColumn("hi", F.explode(F.expr("sequence(_i, _g - 1)"))).alias("x")
    y = rows.withColumn("hi", F.col("_i")).withColumn("lo", F.explode(F.expr("sequence(0, _i)"))).alias("y")
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("key", "lo", "hi", "dataset")]
    order = (F.col("x.lo") < F.col("x.hi")) | (F.col("x.rep") < F.col("y.rep"))
    return _pairs(x.join(y, same[0] & same[1] & same[2] & same[3] & order & _near() & allowed))


def _rareness(texts: DataFrame, words: int) -> np.ndarray:
    """How often the shingles of each of ``CELLS`` cells occur in ``texts`` (source); at most CELLS rows reach the driver."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for part in parts:
            got = part.column(0).to_pylist()
            for i, j in batches(got):
                total += np.bincount(shingle_sets(got[i:j], words)[0].astype(np.int64) & (CELLS - 1), minlength=CELLS)
        has = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(total[has])], names=["cell", "k"])

    got = texts.select("source").mapInArrow(run, "cell long, k long").groupBy("cell").agg(F.sum("k").alias("k")).toArrow()
    out = np.zeros(CELLS, np.int64)
    out[got.column("cell").to_numpy()] = got.column("k").to_numpy()
    return out


def rare_keys(texts: DataFrame, words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """dataset, rep, key: the n - ceil(threshold * n) + 1 rarest shingles of each text (dataset, rep, source).

    The order is the number of occurrences of a shingle's cell, then its hash.  Of two sets of similarity at least
    ``threshold`` the overlap is at least ceil(threshold * n) of either size n, so their rarest shingle in common
    stands among these of both.
    """
    often = texts.sparkSession.sparkContext.broadcast(_rareness(texts, words))  # CELLS numbers

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            got = part.column("source").to_pylist()
            for i, j in batches(got):
                hashes, offsets = shingle_sets(got[i:j], words)
                sizes = np.diff(offsets)
                owner = np.repeat(np.arange(j - i), sizes)
                order = np.lexsort((hashes, often.value[hashes.astype(np.int64) & (CELLS - 1)], owner))
                keep = sizes - np.ceil(threshold * sizes - 1e-9).astype(np.int64) + 1
                taken = order[np.arange(len(order)) - np.repeat(offsets[:-1], sizes) < np.repeat(keep, sizes)]
                at = pa.array(owner[taken] + i)
                yield pa.RecordBatch.from_arrays(
                    [part.column("dataset").take(at), part.column("rep").take(at), pa.array(hashes[taken].astype(np.int64))], names=["dataset", "rep", "key"]
                )

    return texts.select("dataset", "rep", "source").mapInArrow(run, "dataset string, rep long, key long")


def candidates(
    cls: DataFrame, texts: DataFrame, allowed: Column | None = None, useful: Column | None = None, hot: int = HOT, block: int = BLOCK
) -> DataFrame:
    """dataset, a, b (class representatives, a < b) that share a segment and lie within the radius.

    ``texts`` has dataset, record_id and source of the representatives.  ``allowed``: a condition on the flags of
    sides ``x`` and ``y``; ``useful``: one on the flags' maxima, without which no pair of a key can be allowed.
    """
    allowed = F.lit(True) if allowed is None else allowed
    useful = F.lit(True) if useful is None else useful
    light = [c for c in cls.columns if c not in ("keys", "s1", "s2", "copies")]
    met = materialize(_met(cls.select(*light, F.explode("keys").alias("key")), useful), "met")
    pairs = _cold_pairs(met, allowed, hot)
    crowded = materialize(met.where(F.col("m") > hot).select(*light).distinct(), "crowded")
    n = crowded.count()
    if n:
        ends = crowded.select("dataset", F.col("rep").alias("record_id"))
        ends = F.broadcast(ends) if n <= BROADCAST_PAIRS else ends  # else a shuffle join
        own = texts.select("dataset", "record_id", "source").join(ends, ["dataset", "record_id"], "left_semi")
        own = materialize(own.withColumnRenamed("record_id", "rep"), "crowded-texts")
        again = rare_keys(own).join(crowded, ["dataset", "rep"]).withColumn("key", F.xxhash64("dataset", "key")).select(*light, "key")
        again = materialize(_met(again, useful), "met-again")
        pairs = pairs.union(_cold_pairs(again, allowed, hot)).union(_block_pairs(again, allowed, hot, block))
    return pairs.distinct()


def verified(pairs: DataFrame, texts: DataFrame, threshold: float = THRESHOLD, words: int = WORDS) -> DataFrame:
    """dataset, a, b, similarity of the pairs whose texts' exact similarity reaches ``threshold``."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ta, tb = part.column("text_a").to_pylist(), part.column("text_b").to_pylist()
            sims = np.zeros(len(ta))
            for i, j in batches([x + y for x, y in zip(ta, tb)]):
                h, o = shingle_sets(ta[i:j] + tb[i:j], words)
                k = j - i
                for m in range(k):
                    sims[i + m] = jaccard(h[o[m] : o[m + 1]], h[o[k + m] : o[k + m + 1]])
            keep = pa.array(np.flatnonzero(sims >= threshold - 1e-12))
            yield pa.RecordBatch.from_arrays(
                [part.column(c).take(keep) for c in ("dataset", "a", "b")] + [pa.array(sims).take(keep)],
                names=["dataset", "a", "b", "similarity"],
            )

    ends = pairs.select("dataset", F.col("a").alias("record_id")).union(pairs.select("dataset", "b")).distinct()
    if pairs.count() <= BROADCAST_PAIRS:  # else a shuffle join
        ends = F.broadcast(ends)
    t = materialize(texts.select("dataset", "record_id", "source").join(ends, ["dataset", "record_id"], "left_semi"), "texts")
    both = (
        pairs.join(t.select("dataset", F.col("record_id").alias("a"), F.col("source").alias("text_a")), ["dataset", "a"])
        .join(t.select("dataset", F.col("record_id").alias("b"), F.col("source").alias("text_b")), ["dataset", "b"])
        .select("dataset", "a", "b", "text_a", "text_b")
    )
    return both.mapInArrow(run, "dataset string, a long, b long, similarity double")


def _sources(spark: SparkSession, sf_dir: str, names: list[str], extra: dict[str, Column] | None = None) -> DataFrame:
    out = None
    for name in names:
        t = table(spark, sf_dir, name)
        part = t.select(F.lit(name).alias("dataset"), "record_id", "source", *(c.alias(k) for k, c in (extra or {}).items()))
        out = part if out is None else out.unionByName(part)
    return out


def link(
    texts: DataFrame, flags: dict[str, Column] | None = None, allowed: Column | None = None, useful: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """(members: dataset, record_id, rep, g, i and the other columns of ``texts``; links: dataset, a, b, similarity
    between classes).

    ``texts`` has dataset, record_id, source and the columns ``flags`` use.  Null, empty and short texts are
    members of nothing.  Tables may be empty.  The members of a class are dealt to ``g`` groups ``i`` of about ``BLOCK``
    copies, so that joins over members never bring a large class together.
    """
    signed = materialize(signatures(texts, "source", "dataset"), "signed")
    cls = materialize(classes(signed, flags or {}), "classes")
    names = cls.select("dataset", "s1", "s2", "rep", "copies")
    kept = [c for c in texts.columns if c not in ("dataset", "source")]
    members = join_heavy(signed.select("dataset", "s1", "s2", *kept), names, ["dataset", "s1", "s2"], "copies", signed.count())
    members = members.drop("s1", "s2").withColumn("g", F.ceil(F.col("copies") / BLOCK).cast("int")).withColumn("i", F.pmod(F.xxhash64("record_id"), F.col("g")).cast("int"))
    found = materialize(candidates(cls, texts, allowed, useful), "candidates")
    return members.drop("copies"), verified(found, texts)


def _all_groups(rows: DataFrame) -> DataFrame:
    """Each row once for every group of its class (``g``), as ``i``."""
    return rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("g") - 1))).drop("g")


def with_members(links: DataFrame, members: DataFrame, end: str) -> DataFrame:
    """``links`` with the members (dataset, rep, g, i, ...) of the class in column ``end``, group by group."""
    large = members.where("g > 1").select("dataset", F.col("rep").alias(end), "g").distinct()
    keyed = links.join(large, ["dataset", end], "left").withColumn("g", F.coalesce("g", F.lit(1)))
    return _all_groups(keyed).join(members.withColumnRenamed("rep", end).drop("g"), ["dataset", end, "i"]).drop("i", end)


# ---- problem 4


P4_TABLES = ["complexity_dataset", "pattern_dataset"]


def p4_links(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return link(_sources(spark, sf_dir, P4_TABLES))


def _ordered(pairs: DataFrame, x: str, y: str) -> DataFrame:
    return pairs.select("dataset", F.least(x, y).alias("record_a"), F.greatest(x, y).alias("record_b"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dataset, record_a < record_b: all pairs of similarity at least 0.7, equal sources included."""
    members, links = p4_links(spark, sf_dir)
    x, y = (members.withColumnRenamed("record_id", c) for c in "xy")
    across = with_members(with_members(links.select("dataset", "a", "b"), x, "a"), y, "b")
    same = x.drop("g").join(_all_groups(y.drop("i")), ["dataset", "rep", "i"]).where("x < y")
    return _ordered(across, "x", "y").union(_ordered(same, "x", "y"))


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dataset, record_id, group_id, n_links: of each record that has a partner its group (smallest member)
    and the number of records directly linked to it."""
    members, links = p4_links(spark, sf_dir)
    members = materialize(members.drop("g", "i"), "members")
    links = materialize(links, "links")
    sizes = members.groupBy("dataset", "rep").agg(F.count(F.lit(1)).alias("size"))
    both = links.select("dataset", F.col("a").alias("rep"), F.col("b").alias("other")).union(links.select("dataset", "b", "a"))
    weights = both.join(sizes.select("dataset", F.col("rep").alias("other"), "size"), ["dataset", "other"])
    outside = weights.groupBy("dataset", "rep").agg(F.sum("size").alias("outside"))
    ids = F.struct("dataset", "rep")
    edges = links.select(F.struct("dataset", F.col("a").alias("rep")).alias("u"), F.struct("dataset", F.col("b").alias("rep")).alias("v"))
    comp = connected_components(edges).select(F.col("node"), F.col("component.rep").alias("root"))
    cls = sizes.join(outside, ["dataset", "rep"], "left").withColumn("node", ids).join(comp, "node", "left").drop("node")
    cls = cls.withColumn("group_id", F.coalesce("root", "rep")).withColumn("n_links", F.coalesce("outside", F.lit(0)) + F.col("size") - 1)
    out = join_heavy(members, cls.where("n_links > 0"), ["dataset", "rep"], "size", members.count())
    return out.select("dataset", "record_id", "group_id", "n_links")


# ---- problem 2

P2_TABLES = ["security_dataset", "bug_dataset"]


def _p2_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _sources(spark, sf_dir, P2_TABLES, {"split": clean_name(F.col("split")), "repo": repo_key(F.col("repo"))})
    return texts.where(F.col("split").isin("train", "validation", "test"))


def p2_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dataset, record_train, record_eval, eval_split, repo_train, repo_eval of all overlaps of splits."""
    held = F.col("split").isin("validation", "test")
    flags = {"has_train": F.col("split") == "train", "has_eval": held}
    across = (F.col("x.has_train") & F.col("y.has_eval")) | (F.col("x.has_eval") & F.col("y.has_train"))
    members, links = link(_p2_texts(spark, sf_dir), flags, across, F.col("has_train") & F.col("has_eval"))
    place = ["dataset", "rep", "g", "i"]
    train = members.where("split = 'train'").select(*place, F.col("record_id").alias("record_train"), F.col("repo").alias("repo_train"))
    held_out = members.where("split <> 'train'").select(*place, F.col("record_id").alias("record_eval"), F.col("split").alias("eval_split"), F.col("repo").alias("repo_eval"))
    both = links.select("dataset", "a", "b")
    both = both.union(links.select("dataset", "b", "a"))
    out = with_members(with_members(both, train, "a"), held_out, "b")
    same = train.drop("g").join(_all_groups(held_out.drop("i")), ["dataset", "rep", "i"]).drop("rep", "i")
    return out.unionByName(same)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dataset, record_a < record_b of one train and one validation or test record, similarity >= 0.7."""
    return _ordered(p2_pairs(spark, sf_dir), "record_train", "record_eval")


def p2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dataset, split, repo, n_pairs, n_records: overlaps with train by split and repo of the held-out record."""
    return (
        p2_pairs(spark, sf_dir)
        .groupBy("dataset", F.col("eval_split").alias("split"), F.col("repo_eval").alias("repo"))
        .agg(F.count(F.lit(1)).alias("n_pairs"), F.countDistinct("record_eval").alias("n_records"))
    )


QUERIES = {"p2_found": p2_found, "p2_counts": p2_counts, "p4_found": p4_found, "p4_groups": p4_groups}
