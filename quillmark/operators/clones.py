"""Clones and similarity: block classes, nearest neighbours, TF-IDF, n-gram sequence models (D, G, I, N)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmark.functions import text as T
from quillmark.functions.normalize import language
from quillmark.operators.skew import join_heavy
from quillmark.operators.text_metrics import FILES, SQL_LINES, files
from quillmark.sources.tables import materialize, spread, table

LEAST_LINES = 4


def blocks(df: DataFrame) -> DataFrame:
    """E.30: file_id, block, text, fp (exact up to comments and white space), norm_fp (names and numbers masked):
    the paragraphs of each source with enough lines."""
    b = df.where("code is not null").select("file_id", F.posexplode(F.split("code", r"\n[ \t]*\n+")).alias("block", "text"))
    b = b.where(F.size(F.filter(F.split("text", "\n"), lambda x: x.rlike(r"\S"))) >= LEAST_LINES)
    one = T.squeeze(T.strip_comments(F.col("text")))
    masked = F.regexp_replace(F.regexp_replace(one, r"[A-Za-z_][A-Za-z0-9_]*", "v"), r"[0-9]+", "0")
    return b.select("file_id", F.col("block").cast("long").alias("block"), F.md5(one).alias("fp"), F.md5(masked).alias("norm_fp"), (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"))


def clone_classes(b: DataFrame) -> DataFrame:
    """I.1: of each block its exact class, its renamed class (both by their first block) and the blocks it is
    linked to; no pairs are built, so a class of any size costs one aggregation and one join."""
    place = F.struct("file_id", "block")
    exact = b.groupBy("fp", "norm_fp").agg(F.count(F.lit(1)).alias("n_exact"), F.min(place).alias("e"))
    renamed = exact.groupBy("norm_fp").agg(F.sum("n_exact").alias("n_renamed"), F.min("e").alias("r"))
    out = b.join(exact.drop("norm_fp"), "fp").join(renamed, "norm_fp")
    name = lambda c: F.concat_ws(":", F.col(f"{c}.file_id"), F.col(f"{c}.block"))
    return out.select("file_id", "block", name("e").alias("exact_class"), (F.col("n_exact") - 1).alias("exact_links"), name("r").alias("renamed_class"), (F.col("n_renamed") - F.col("n_exact")).alias("renamed_links"))


def i1_clone_classes(spark, sf_dir):
    return clone_classes(blocks(files(spark, sf_dir)))


def i4_cross_file(spark, sf_dir):
    """I.4: share of blocks with a copy in another file, and the duplication score (at most 100)."""
    b = blocks(files(spark, sf_dir))
    per = b.groupBy("norm_fp").agg(F.count(F.lit(1)).alias("n"), F.min("file_id").alias("lo"), F.max("file_id").alias("hi"))
    g = per.agg(F.sum("n").alias("blocks"), F.coalesce(F.sum(F.when(F.col("lo") < F.col("hi"), F.col("n"))), F.lit(0)).alias("involved"))
    rate = F.col("involved") / F.col("blocks")
    return g.select("blocks", "involved", F.round(rate, 6).alias("clone_rate"), F.round(F.least(F.lit(100.0), 150 * rate), 4).alias("duplication"))


def h16_duplication_debt(spark, sf_dir):
    """H.16: minutes of debt by clones: 30 for an exact, 20 for a renamed one."""
    c = i1_clone_classes(spark, sf_dir)
    m = F.when(F.col("exact_links") > 0, 30).when(F.col("renamed_links") > 0, 20).otherwise(0)
    return c.groupBy("file_id").agg(F.sum(m).alias("minutes"))


# ---- nearest neighbours

BLOCK = 2048


def _packed(df: DataFrame, name: str, parts: int) -> DataFrame:
    """Blocks of vectors: id array and one binary of float32, at most BLOCK vectors each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                vec = np.array(part.column("v").to_pylist(), np.float32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.column("id").to_pylist()], pa.list_(pa.int64())), pa.array([vec.tobytes()], pa.binary()), pa.array([vec.shape[1] if len(vec) else 0], pa.int32())],
                    names=[f"{name}_ids", f"{name}_vecs", "dim" if name == "q" else "d_dim"],
                )

    return df.repartition(parts).mapInArrow(run, f"{name}_ids array<long>, {name}_vecs binary, {'dim' if name == 'q' else 'd_dim'} int")


def nearest(queries: DataFrame, base: DataFrame, k: int) -> DataFrame:
    """I.2, I.3: id, neighbour, similarity: the k rows of ``base`` with the greatest cosine, itself excluded;
    ties by id.  Both have id, v (array of floats, not null and of one length).

    Blocks of queries meet blocks of the base; each meeting is one matrix product that keeps k a query, so
    what is shuffled is k rows a query and base block, never a similarity matrix.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for qi, qv, dim, bi, bv in zip(*(b.column(c).to_pylist() for c in ("q_ids", "q_vecs", "dim", "b_ids", "b_vecs"))):
                q = np.frombuffer(qv, np.float32).reshape(-1, dim).astype(np.float64)
                m = np.frombuffer(bv, np.float32).reshape(-1, dim).astype(np.float64)
                unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
                sims = np.round(unit(q) @ unit(m).T, 6)
                ids = np.array(bi)
                sims[np.array(qi)[:, None] == ids[None, :]] = -np.inf
                out = []
                for r, row in enumerate(sims):
                    # only what is not below the k-th is sorted, ties by id
                    top = np.flatnonzero(row >= np.partition(row, -k)[-k]) if len(row) > k else np.arange(len(row))
                    best = top[np.lexsort((ids[top], -row[top]))[:k]]
                    out += [(qi[r], int(ids[c]), float(row[c])) for c in best if row[c] > -np.inf]
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["id", "neighbour", "similarity"])

    spark = base.sparkSession
    parts = spark.sparkContext.defaultParallelism
    qs, bs = _packed(queries, "q", max(1, parts // 4)), _packed(base, "b", parts)
    met = qs.crossJoin(bs).mapInArrow(run, "id long, neighbour long, similarity double")
    w = W.partitionBy("id").orderBy(F.desc("similarity"), "neighbour")
    return met.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")).where("v is not null")


def i2_nearest(spark, sf_dir, k: int = 5):
    """The five nearest rows of every row whose id is divisible by 20."""
    v = _vectors(spark, sf_dir)
    return nearest(v.where("id % 20 = 0"), v, k).select("id", "neighbour", "similarity", F.col("place").cast("long").alias("place"))


# ---- TF-IDF


def words(df: DataFrame, text: str, key: str, pattern: str = r"[a-z]+") -> DataFrame:
    return df.where(f"{text} is not null").select(key, F.posexplode(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))).alias("pos", "word"))


WORD = r"[\p{L}\p{N}_]+"


def terms_of(df: DataFrame, text: str, key: str) -> DataFrame:
    """key, word: the words of a text (letters and digits of any script, ``_``) and each two adjacent ones joined by ``_``."""
    w = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))
    return terms_of_lists(df.where(f"{text} is not null").select(key, w.alias("w")), key)


def terms_of_lists(t: DataFrame, key: str) -> DataFrame:
    pairs = F.transform(F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), lambda x, i: F.concat(F.get("w", i), F.lit("_"), x))
    return t.select(key, F.explode(F.concat("w", pairs)).alias("word"))


def n2_tfidf(spark, sf_dir, terms: int = 512):
    """N.2: weights of the ``terms`` words and bigrams in most documents (one ranking, ties by term), tf by share of all of
    a document's terms, smoothed idf, L2 norm."""
    return tfidf(table(spark, sf_dir, "documents"), "text", "doc_id", terms).select("doc_id", "word", F.round("weight", 5).alias("weight"))


def tfidf(docs: DataFrame, text: str, key: str, terms: int = 512) -> DataFrame:
    w = terms_of(docs, text, key)
    tf = w.groupBy(key, "word").agg(F.count(F.lit(1)).alias("c"))
    total = tf.groupBy(key).agg(F.sum("c").alias("total"))
    df = tf.groupBy("word").agg(F.count(F.lit(1)).alias("df")).orderBy(F.desc("df"), "word").limit(terms)
    n = F.broadcast(total.agg(F.count(F.lit(1)).alias("n")))
    x = tf.join(F.broadcast(df), "word").join(total, key).join(n)  # at most ``terms`` rows
    x = x.withColumn("w", F.col("c") / F.col("total") * (F.ln((F.col("n") + 1) / (F.col("df") + 1)) + 1))
    norm = x.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return x.join(norm, key).select(key, "word", (F.col("w") / F.col("norm")).alias("weight"))


# ---- near clones: search by a bound

#: Names that the workers get as a list; beyond it all terms are counted.
CANDIDATES = 1 << 17
#: Rows of a table of asked blocks that one partition holds.
ASKED = 8 * BLOCK


def _coded(w: pa.ListArray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Row and code of each word of a batch of word lists, the distinct words by code, and where the next word is of the same row."""
    doc = np.repeat(np.arange(len(w)), w.value_lengths().to_numpy())
    x = w.flatten().dictionary_encode()
    return doc, x.dictionary, x.indices.to_numpy().astype(np.int64), np.flatnonzero(doc[1:] == doc[:-1])


def frequent(w: pa.ListArray, least: float) -> pa.Array:
    """The terms (those of ``terms_of``) that ``least`` rows of a batch have.

    A term with u underscores is one word or two in u ways, so one of these u + 1 has its share of ``least``, and two adjacent
    words are in no more rows than each of them is found.
    """
    _, words_, one, next_ = _coded(w)
    if not len(words_):
        return pa.array([], pa.string())
    seen, ways = np.bincount(one, minlength=len(words_)), pc.count_substring(words_, "_").to_numpy() + 1
    # of two words at least the ways of both: one more than the underscores of each, and one between them
    few = lambda n, k: n * k < least
    x, y = one[next_], one[next_ + 1]
    kept = ~(few(seen[x], ways[x] + ways[y]) | few(seen[y], ways[x] + ways[y]))
    pairs, n = np.unique(x[kept] * len(words_) + y[kept], return_counts=True)
    x, y = pairs // len(words_), pairs % len(words_)
    good = ~few(n, ways[x] + ways[y])
    two = pc.binary_join_element_wise(words_.take(pa.array(x[good])), words_.take(pa.array(y[good])), "_")
    held = Held(sorted({*words_.filter(pa.array(~few(seen, ways))).to_pylist(), *two.to_pylist()}))
    return held.names.filter(pa.array(held.rows(w) >= least))


class Held:
    """Finds the occurrences of the terms of a list in batches of word lists."""

    def __init__(self, names: list[str]):
        self.names = pa.array(names, pa.string())
        two = [(n[:i], n[i + 1 :], k) for k, n in enumerate(names) for i, c in enumerate(n) if c == "_" and 0 < i < len(n) - 1]
        self.halves = pa.array(sorted({h for a, b, _ in two for h in (a, b)}), pa.string())
        at = {h: i for i, h in enumerate(self.halves.to_pylist())}
        self.pairs = pa.array([at[a] * len(at) + at[b] for a, b, _ in two], pa.int64())
        self.term = np.array([k for *_, k in two], np.int64)

    def of(self, w: pa.ListArray) -> np.ndarray:
        """Row * len(names) + term of each occurrence."""
        doc, words_, one, next_ = _coded(w)
        place = lambda of, among: pc.fill_null(pc.index_in(of, value_set=among), -1).to_numpy().astype(np.int64)
        alone, half = place(words_, self.names)[one], place(words_, self.halves)[one]
        x, y = half[next_], half[next_ + 1]
        next_, pair = next_[good := (x >= 0) & (y >= 0)], (x * len(self.halves) + y)[good]
        found = place(pa.array(pair, pa.int64()), self.pairs)
        hit = found >= 0
        two = doc[next_[hit]] * len(self.names) + self.term[found[hit]]
        return np.concatenate([doc[alone >= 0] * len(self.names) + alone[alone >= 0], two])

    def rows(self, w: pa.ListArray) -> np.ndarray:
        """Of each term the number of rows that have it."""
        at, n = self.of(w), len(self.names)
        if len(w) * n > 1 << 25:
            return np.bincount(np.unique(at) % n, minlength=n)
        seen = np.zeros(len(w) * n, bool)
        seen[at] = True
        return np.count_nonzero(seen.reshape(len(w), n), axis=0)


def top_terms(docs: DataFrame, n: int, terms: int) -> list[tuple[str, int]]:
    """The ``terms`` terms in most of the ``n`` rows of ``docs`` (w: list of words), ties by term, and in how many they are.

    The counts of single words give a least count that all of them reach.  Such a term reaches its share of it in some
    batch, so only names that do are counted: no row is written or sent for a term of a text.
    """
    one = docs.select(F.explode(F.array_distinct("w")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    found = one.select("df").orderBy(F.desc("df")).limit(terms).collect()
    least = found[-1].df if len(found) == terms else 1

    def some(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield pa.RecordBatch.from_arrays([frequent(part.column("w"), least * part.num_rows / n)], names=["word"])

    names = docs.select("w").mapInArrow(some, "word string").distinct()
    listed = [r.word for r in names.limit(CANDIDATES + 1).collect()]
    if len(listed) > CANDIDATES:
        df = terms_of_lists(docs.select("id", "w"), "id").distinct().groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    else:

        def counts(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = Held(listed)
            for part in parts:
                yield pa.RecordBatch.from_arrays([held.names, pa.array(held.rows(part.column("w")))], names=["word", "df"])

        df = docs.select("w").mapInArrow(counts, "word string, df long").where("df > 0").groupBy("word").agg(F.sum("df").alias("df"))
    return [(r.word, r.df) for r in df.orderBy(F.desc("df"), "word").limit(terms).collect()]


def _filled(cells: bytes, dim: int, n: int) -> np.ndarray:
    """The block of n float32 vectors whose cells that are not 0 were packed: places, then values."""
    x = np.frombuffer(cells, np.int32)
    out = np.zeros(n * dim, np.float32)
    out[x[: len(x) // 2]] = x[len(x) // 2 :].view(np.float32)
    return out.reshape(n, dim)


def _bounding(m: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """The vectors on the axes (orthonormal) and the length of the rest: the product of two such rows is at least that of the vectors."""
    p = m @ axes
    return np.column_stack([p, np.sqrt(np.maximum((m * m).sum(1) - (p * p).sum(1), 0))])


def _products(q: np.ndarray, b: np.ndarray, r: np.ndarray, c: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs (row r of q, row c of b) those whose product reaches ``least``: r, c, product in double."""
    at = lambda some: ((q[r[i]], b[c[i]]) for i in (some[j : j + 4096] for j in range(0, len(some), 4096)))
    near = [np.einsum("ij,ij->i", x, y) for x, y in at(np.arange(len(r)))]
    kept = np.flatnonzero(np.concatenate([*near, np.zeros(0, np.float32)]) >= least)
    exact = [np.einsum("ij,ij->i", x.astype(np.float64), y.astype(np.float64)) for x, y in at(kept)]
    return r[kept], c[kept], np.concatenate([*exact, np.zeros(0)])


SLACK = 1e-4  # far beyond what float32 loses in a product of unit vectors


def similar(docs: DataFrame, k: int, least: float, terms: int = 512) -> DataFrame:
    """id, neighbour, similarity: of each asked row the k others with the greatest cosine from ``least`` on (six digits, ties
    by id) of the TF-IDF vectors over the ``terms`` terms in most rows.  ``docs``: a written table of id, asked and w, the words.

    Blocks of asked vectors meet blocks of all.  A product on the main axes of the asked ones, with the length of the rest,
    bounds every cosine from above; only pairs whose bound reaches ``least`` are computed, so none is lost.  Vectors are made
    where they are used; what is written are the asked ones' cells that are not 0, and the hits.
    """
    spark, schema = docs.sparkSession, "id long, neighbour long, similarity double"
    n, asked = docs.agg(F.count(F.lit(1)), F.count_if("asked")).first()
    top = top_terms(docs, n, terms) if asked else []
    if not top:
        return spark.createDataFrame([], schema)
    dim = len(top)
    idf = np.log((n + 1) / (np.array([df for _, df in top]) + 1)) + 1

    def packed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Held([w for w, _ in top])
        for whole in parts:
            for start in range(0, whole.num_rows, BLOCK):
                part = whole.slice(start, BLOCK)
                total = np.maximum(part.column("w").value_lengths().to_numpy() * 2 - 1, 1)
                v = np.bincount(held.of(part.column("w")), minlength=part.num_rows * dim).reshape(-1, dim) / total[:, None] * idf
                v = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)).astype(np.float32).ravel()
                cells = np.flatnonzero(v)
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column("id"))
                yield pa.RecordBatch.from_arrays([ids, pa.array([cells.astype(np.int32).tobytes() + v[cells].tobytes()], pa.binary())], names=["ids", "cells"])

    blocks_of = lambda df: df.select("id", "w").mapInArrow(packed, "ids array<long>, cells binary")
    qs = materialize(blocks_of(docs.where("asked").repartition(-(-asked // ASKED))), "asked")
    one = qs.first()
    some = _filled(one.cells, dim, len(one.ids))
    axes = np.linalg.eigh((some.T @ some).astype(np.float64))[1][:, ::-1].astype(np.float32)
    for m in range(dim // 8, dim, max(1, dim // 8)):  # as few axes as leave one pair in 256 to be computed
        bound = _bounding(some, axes[:, :m])
        if np.count_nonzero(bound @ bound.T >= least - SLACK) - len(some) <= len(some) ** 2 / 256:
            break
    else:
        m = dim
    axes = np.ascontiguousarray(axes[:, :m])

    def block(ids: pa.ListScalar, cells: pa.BinaryScalar) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        ids = ids.values.to_numpy()
        v = _filled(cells.as_py(), dim, len(ids))
        return ids, v, np.maximum(np.linalg.norm(v.astype(np.float64), axis=1), 1e-300), _bounding(v, axes)

    def met(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, int], tuple] = {}  # the block of all, and as many asked ones as a partition has
        for part in parts:
            for at in range(part.num_rows):
                got = []
                for side, most in (("", 1), ("q_", ASKED // BLOCK)):
                    ids = part.column(f"{side}ids")[at]
                    key = (side, ids[0].as_py())
                    if key not in known:
                        if len(mine := [x for x in known if x[0] == side]) >= most:
                            del known[mine[0]]
                        known[key] = block(ids, part.column(f"{side}cells")[at])
                    got.append(known[key])
                (bi, b, b_norm, b_bound), (qi, q, q_norm, q_bound) = got
                r, c = np.nonzero(q_bound @ b_bound.T >= least - SLACK)
                if len(r) > len(q) * len(b) // 32:
                    sims = (q.astype(np.float64) @ b.astype(np.float64).T)[r, c]
                else:
                    r, c, sims = _products(q, b, r, c, least - SLACK)
                sims = np.round(sims / (q_norm[r] * b_norm[c]), 6)
                good = np.flatnonzero((sims >= least) & (qi[r] != bi[c]))
                r, c, sims = r[good], c[good], sims[good]
                order = np.lexsort((bi[c], -sims, r))
                r, c, sims = r[order], c[order], sims[order]
                best = np.arange(len(r)) - np.searchsorted(r, r) < k
                yield pa.RecordBatch.from_arrays([pa.array(qi[r[best]]), pa.array(bi[c[best]]), pa.array(sims[best])], names=["id", "neighbour", "similarity"])

    pairs = blocks_of(spread(docs)).crossJoin(qs.toDF("q_ids", "q_cells").hint("shuffle_replicate_nl"))
    w = W.partitionBy("id").orderBy(F.desc("similarity"), "neighbour")
    hits = pairs.mapInArrow(met, schema).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
    return materialize(hits.drop("place"), "hits")


def near_clones(fragments: DataFrame, asked: Column, k: int = 8, least: float = 0.7, alike: float = 0.9) -> DataFrame:
    """I.1, I.2: file_id, start_line, other_file, other_line, type, similarity of the fragments that are clones of those for
    which ``asked`` holds, the nearest ``k`` of each kind: type1 equal, type2 equal but for names, type3 alike with names
    masked (TF-IDF of the renamed text, ``least``), type4 alike as written (``alike``); the first that holds.

    Equal fragments are one class in the search, so copies do not crowd out other neighbours; classes are searched
    whole (each class asked against all).
    """
    kept = fragments.select("file_id", "start_line", "text", "fp", "renamed")
    f = materialize(kept.withColumn("renamed_fp", F.md5("renamed")).withColumn("asked", asked), "fragments")
    place = F.struct("file_id", "start_line")
    out = []
    for kind, name, text, bound in (("renamed_fp", "type3", "renamed", least), ("fp", "type4", "text", alike)):
        cls = f.groupBy(kind).agg(F.min(text).alias("t"), F.max("asked").alias("asked"), F.min(place).alias("p"))
        cls = materialize(cls.select(kind, F.xxhash64(kind).alias("id"), "asked", "p", F.regexp_extract_all(F.lower("t"), F.lit(WORD), F.lit(0)).alias("w")), "classes")
        hits = similar(cls.select("id", "asked", "w"), k, bound)
        side = cls.select("id", F.col(kind).alias("_key"), "p")
        hits = hits.join(side, "id").join(side.select(F.col("id").alias("neighbour"), F.col("p").alias("q"), F.col("_key").alias("_other")), "neighbour")
        out.append(hits.join(f.where("asked").select(F.col(kind).alias("_key"), "file_id", "start_line", "fp", "renamed_fp"), "_key").select("file_id", "start_line", "fp", "renamed_fp", "q", F.lit(name).alias("type"), "similarity"))
    # equal fragments: another one of the same class; equal but for names: the first of another class
    exact = f.groupBy("fp", "renamed_fp").agg(F.min(place).alias("p1"), F.max(place).alias("p2"))
    renamed = exact.groupBy("renamed_fp").agg(F.min("p1").alias("r1"), F.max("p1").alias("r2"))
    mine = f.where("asked").join(exact.drop("renamed_fp"), "fp").join(renamed, "renamed_fp").withColumn("me", place)
    for name, sim, own, one, two in (("type1", 1.0, "me", "p1", "p2"), ("type2", 0.95, "p1", "r1", "r2")):
        other = F.when(F.col(one) != F.col(own), F.col(one)).when(F.col(two) != F.col(own), F.col(two))
        out.append(mine.select("file_id", "start_line", "fp", "renamed_fp", other.alias("q"), F.lit(name).alias("type"), F.lit(sim).alias("similarity")).where("q is not null"))
    every = out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])
    first = every.groupBy("file_id", "start_line", F.col("q.file_id").alias("other_file"), F.col("q.start_line").alias("other_line")).agg(F.min(F.struct("type", "similarity")).alias("b"))
    return first.select("file_id", "start_line", "other_file", "other_line", "b.type", F.round("b.similarity", 4).alias("similarity"))


# ---- sequence model

ALPHA = 0.1


def _trigrams(w: DataFrame) -> DataFrame:
    o = W.partitionBy("doc_id").orderBy("pos")
    return w.select("doc_id", "pos", F.lag("word", 2).over(o).alias("a"), F.lag("word", 1).over(o).alias("b"), F.col("word").alias("c"))


def n3_trigrams(spark, sf_dir, least: int = 3):
    """N.3: trigram counts of three and more."""
    t = _trigrams(words(table(spark, sf_dir, "documents"), "text", "doc_id")).where("a is not null")
    return t.groupBy("a", "b", "c").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def n5_perplexity(spark, sf_dir):
    """N.4-N.7: back-off perplexity of every document under a model of the documents of the other half (trigram where the
    context is known, else bigram, else unigram; alpha 0.1), and the share of known trigrams.

    Each distinct trigram of a half gets its probability once; rows of the texts are shuffled to be counted and to be
    scored, never by a single word.  What is joined by a single word are distinct bigrams, common words apart.
    """
    t = _trigrams(words(table(spark, sf_dir, "documents"), "text", "doc_id")).withColumns({"a": F.coalesce("a", F.lit("")), "b": F.coalesce("b", F.lit(""))})
    t = materialize(t.groupBy((F.col("doc_id") % 2 != 0).alias("odd"), "doc_id", "a", "b", "c").agg(F.count(F.lit(1)).alias("k")), "trigrams")
    tri = materialize(t.groupBy("odd", "a", "b", "c").agg(F.sum("k").alias("n3")), "distinct-trigrams")
    bi = materialize(tri.groupBy("odd", "b", "c").agg(F.sum("n3").alias("n2")), "bigrams")
    other = lambda df: df.withColumn("odd", ~F.col("odd"))  # the model that scores a half is that of the other
    both = ["odd", "b"], ["odd", "c"]
    ctx1 = other(bi.where("b <> ''").groupBy("odd", "b").agg(F.sum("n2").alias("c1")))
    uni = other(bi.groupBy("odd", "c").agg(F.sum("n2").alias("n1")))
    v = F.broadcast(uni.groupBy("odd").agg(F.count(F.lit(1)).alias("v"), F.sum("n1").alias("total")))  # two rows
    # bigrams to be scored, with the counts of their words
    n = bi.count()
    rows_b, rows_c = bi.groupBy("odd", "b").agg(F.count(F.lit(1)).alias("_k")), bi.groupBy("odd", "c").agg(F.count(F.lit(1)).alias("_k"))
    x = join_heavy(bi.drop("n2"), rows_b.join(ctx1, both[0], "left"), both[0], "_k", n).drop("_k")
    x = join_heavy(x, rows_c.join(uni, both[1], "left"), both[1], "_k", n).drop("_k")
    x = x.join(other(bi.where("b <> ''")), ["odd", "b", "c"], "left").join(v, "odd", "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    lower = F.when(F.col("c1").isNotNull(), (z("n2") + ALPHA) / (F.col("c1") + ALPHA * F.col("v"))).otherwise((z("n1") + ALPHA) / (F.col("total") + ALPHA * F.col("v")))
    x = x.select("odd", "b", "c", "v", lower.alias("lower"))
    known = other(tri.where("a <> ''"))
    ctx2 = known.groupBy("odd", "a", "b").agg(F.sum("n3").alias("c2"))
    y = tri.drop("n3").join(known, ["odd", "a", "b", "c"], "left").join(ctx2, ["odd", "a", "b"], "left").join(x, ["odd", "b", "c"])
    p = F.when(F.col("c2").isNotNull(), (z("n3") + ALPHA) / (F.col("c2") + ALPHA * F.col("v"))).otherwise(F.col("lower"))
    y = y.select("odd", "a", "b", "c", F.ln(p).alias("lp"), F.isnotnull("n3").cast("double").alias("known"))
    g = t.join(y, ["odd", "a", "b", "c"]).groupBy("doc_id").agg(F.sum("k").alias("k"), F.sum(F.col("k") * F.col("lp")).alias("lp"), F.sum(F.col("k") * F.col("known")).alias("known"))
    return g.where("lp is not null").select("doc_id", F.round(F.exp(-F.col("lp") / F.col("k")), 3).alias("perplexity"), F.round(F.col("known") / F.col("k"), 5).alias("coverage"))


def n6_calibrated(spark, sf_dir):
    """N.6: logistic score of perplexity around its median, scaled by the quartile range."""
    p = n5_perplexity(spark, sf_dir)
    q = F.broadcast(p.agg(F.percentile("perplexity", F.lit(0.25)).alias("q1"), F.percentile("perplexity", F.lit(0.5)).alias("q2"), F.percentile("perplexity", F.lit(0.75)).alias("q3")))
    s = F.greatest((F.col("q3") - F.col("q1")) / 1.35, F.lit(1.0))
    return p.join(q).select("doc_id", F.round(1 / (1 + F.exp(-(F.col("perplexity") - F.col("q2")) / s)), 5).alias("score"))


def n12_cache_keys(spark, sf_dir):
    """N.12: SHA-256 of path, NUL, code."""
    f = files(spark, sf_dir).where("code is not null")
    return f.select("file_id", F.sha2(F.concat_ws("\0", "path", "code"), 256).alias("key"))


def notebook_code(df: DataFrame) -> DataFrame:
    """N.11: id, code of rows of id, body: the code cells of notebook JSON, by blank lines; invalid JSON and null give
    null, a notebook without code cells the empty text."""
    nb = F.from_json("body", "struct<cells:array<struct<cell_type:string,source:array<string>>>>")
    code = F.filter(nb["cells"], lambda c: c["cell_type"] == "code")
    return df.select("id", F.array_join(F.transform(code, lambda c: F.array_join(c["source"], "")), "\n\n").alias("code"))


def n11_notebooks(spark, sf_dir):
    """N.11: every source as a notebook (a heading, its paragraphs as code cells, their lines as the cells' lines), written
    as JSON and read back."""
    f = files(spark, sf_dir).where("code is not null")
    kept = lambda p: F.transform(F.split(p, "\n"), lambda x, i: F.when(i > 0, F.concat(F.lit("\n"), x)).otherwise(x))
    cells = F.transform(F.split("code", "\n\n"), lambda p: F.struct(F.lit("code").alias("cell_type"), kept(p).alias("source")))
    head = F.array(F.struct(F.lit("markdown").alias("cell_type"), F.array(F.col("path")).alias("source")))
    return notebook_code(f.select(F.col("file_id").alias("id"), F.to_json(F.struct(F.concat(head, cells).alias("cells"))).alias("body")))


# ---- diffs, call graph, traces


def diff_lines(spark, sf_dir):
    b = table(spark, sf_dir, "bug_dataset").where(F.col("source").rlike(r"(?m)^@@ -\d+")).select(F.col("record_id").alias("id"), language(F.col("code_lang"), F.col("file")).alias("lang"), F.posexplode(T.lines(F.col("source"))).alias("pos", "line"))
    o = W.partitionBy("id").orderBy("pos")
    b = b.withColumn("hunk", F.count_if(F.col("line").startswith("@@ ")).over(o)).where("hunk > 0")
    start = F.regexp_extract("line", r"^@@ -(\d+)(?:,\d+)? \+(\d+)", 2)
    return b.withColumn("start", F.max(F.when(F.col("line").startswith("@@ "), start.cast("long"))).over(W.partitionBy("id", "hunk")))


# Words that raise and lower the risk of a hunk.
RISKY = r"(?i)\b(?:eval|exec|pickle|subprocess|os\.system|shutil\.rmtree|DELETE\s+FROM|DROP\s+TABLE|UPDATE\s+.*SET|INSERT\s+INTO|password|secret|token|api_key|TODO|FIXME|HACK|XXX)\b"
SAFE = r"(?i)\b(?:validate|sanitize|escape|quote|parameterize|assert|isinstance|hasattr|try|except|finally|raise|logging|log)\b"


def d20_hunks(spark, sf_dir):
    """D.20, D.22, L.1: hunks of unified diffs with added, deleted and context lines and a risk in 0..1."""
    x = diff_lines(spark, sf_dir).where(~F.col("line").startswith("@@ "))
    add, dele = F.col("line").rlike(r"^\+(?!\+\+)"), F.col("line").rlike("^-(?!--)")
    hits = lambda c, rx: F.sum(F.when(c, F.size(F.regexp_extract_all("line", F.lit(rx), F.lit(0)))).otherwise(0))
    g = x.groupBy("id", "hunk").agg(F.count_if(add).alias("added"), F.count_if(dele).alias("deleted"), F.count_if(~add & ~dele).alias("context"), hits(add, RISKY).alias("ra"), hits(dele, RISKY).alias("rd"), hits(add, SAFE).alias("sa"))
    risk = (F.col("ra") - F.col("rd") - F.col("sa")) / F.greatest(F.lit(1), F.col("added"))
    return g.select("id", "hunk", "added", "deleted", "context", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), risk)), 6).alias("risk"))


def d21_new_lines(spark, sf_dir):
    """D.21: new-file line number of each added line of a diff."""
    x = diff_lines(spark, sf_dir).where(~F.col("line").startswith("@@ "))
    step = F.when(F.col("line").startswith("-"), 0).otherwise(1)
    n = F.col("start") - 1 + F.sum(step).over(W.partitionBy("id", "hunk").orderBy("pos"))
    return x.select("id", "pos", n.alias("lineno"), "line").where(F.col("line").startswith("+")).select("id", "pos", "lineno")


def _defs(spark, sf_dir):
    f = files(spark, sf_dir).where("code is not null")
    ls = f.select("file_id", F.posexplode(T.lines(F.col("code"))).alias("pos", "line"))
    name = F.regexp_extract("line", r"^\s*(?:async\s+)?(?:def|func|function)\s+([A-Za-z_][A-Za-z0-9_]*)", 1)
    ls = ls.withColumn("def", F.when(name != "", name))
    return ls.withColumn("caller", F.last("def", ignorenulls=True).over(W.partitionBy("file_id").orderBy("pos")))


def g2_reach(spark, sf_dir):
    """G.2: functions that read input, and those that call them within two steps of the file's call graph
    (strict rounds).  The enclosing function is the nearest definition before a line (as-of)."""
    ls = _defs(spark, sf_dir).where("caller is not null")
    names = ls.where("def is not null").select("file_id", F.col("def").alias("callee")).distinct()
    calls = ls.where("def is null").select("file_id", "caller", F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(r"([A-Za-z_][A-Za-z0-9_]*)\("), F.lit(1)))).alias("callee")).distinct()
    edges = calls.join(names, ["file_id", "callee"]).where("caller <> callee")
    seeds = ls.where(F.col("line").rlike(r"\b(?:input|open|get|getenv|argv)\b")).select("file_id", F.col("caller").alias("name")).distinct()
    one = edges.join(seeds.withColumnRenamed("name", "callee"), ["file_id", "callee"], "left_semi").select("file_id", F.col("caller").alias("name")).distinct()
    two = edges.join(one.withColumnRenamed("name", "callee"), ["file_id", "callee"], "left_semi").select("file_id", F.col("caller").alias("name")).distinct()
    all_ = seeds.withColumn("steps", F.lit(0)).union(one.withColumn("steps", F.lit(1))).union(two.withColumn("steps", F.lit(2)))
    return all_.groupBy("file_id", "name").agg(F.min("steps").alias("steps"))


def g9_sources(spark, sf_dir, back: int = 80):
    """G.9: of each assignment the nearest one of the same name before it, at most ``back`` lines up, and the kind of its source."""
    f = files(spark, sf_dir).where("code is not null")
    ls = f.select("file_id", F.posexplode(T.lines(F.col("code"))).alias("pos", "line"))
    name = F.regexp_extract("line", r"^\s*([A-Za-z_][A-Za-z0-9_]*)\s*:?=\s*[^=]", 1)
    a = ls.withColumn("name", name).where("name <> ''")
    w = W.partitionBy("file_id", "name").orderBy("pos").rangeBetween(-back, -1)
    kind = F.when(F.col("line").rlike(r"environ|getenv"), "environment").when(F.col("line").rlike(r"request|input\(|argv"), "user").when(F.col("line").rlike(r"=\s*[\"'0-9]"), "literal").otherwise("computed")
    prev = F.max("pos").over(w)
    return a.select("file_id", (F.col("pos") + 1).cast("long").alias("lineno"), "name", (prev + 1).cast("double").alias("previous"), kind.alias("kind"))


QUERIES = {k: f for k, f in list(globals().items()) if k[0] in "dghin" and k[1].isdigit()}

_B = f"""f AS (SELECT * FROM {FILES} WHERE code IS NOT NULL), p AS (SELECT file_id, regexp_split_to_array(code, '\\n[ \\t]*\\n+') AS ps FROM f), b0 AS (SELECT file_id, unnest(ps) AS text, generate_subscripts(ps, 1) - 1 AS block FROM p),
b1 AS (SELECT file_id, CAST(block AS BIGINT) AS block, text AS code FROM b0 WHERE len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\\S'))) >= {LEAST_LINES}),
b2 AS (SELECT file_id, block, trim(regexp_replace(array_to_string(list_filter(list_transform({SQL_LINES}, lambda x: rtrim(split_part(x, '#', 1))), lambda x: x <> ''), chr(10)), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS o FROM b1),
b AS (SELECT file_id, block, md5(o) AS fp, md5(regexp_replace(regexp_replace(o, '[A-Za-z_][A-Za-z0-9_]*', 'v', 'g'), '[0-9]+', '0', 'g')) AS norm_fp FROM b2)"""
_W = "w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word, generate_subscripts(regexp_extract_all(lower(text), '[a-z]+'), 1) - 1 AS pos FROM documents WHERE text IS NOT NULL)"
_T3 = _W + ", t AS (SELECT doc_id, pos, lag(word, 2) OVER o AS a, lag(word) OVER o AS b, word AS c FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY pos))"
_PPL = (
    _T3.replace("doc_id, pos,", "doc_id, doc_id % 2 <> 0 AS odd, pos,")
    + ", ft AS (SELECT * REPLACE (NOT odd AS odd) FROM t), tri AS (SELECT odd, a, b, c, count(*) AS n3 FROM ft WHERE a IS NOT NULL GROUP BY ALL), c2 AS (SELECT odd, a, b, sum(n3) AS c2 FROM tri GROUP BY ALL), bi AS (SELECT odd, b, c, count(*) AS n2 FROM ft WHERE b IS NOT NULL GROUP BY ALL), c1 AS (SELECT odd, b, sum(n2) AS c1 FROM bi GROUP BY ALL), un AS (SELECT odd, c, count(*) AS n1 FROM ft GROUP BY ALL), v AS (SELECT odd, count(*) AS v, sum(n1) AS total FROM un GROUP BY odd),"
    + " x AS (SELECT t.doc_id, n3, CASE WHEN c2 IS NOT NULL THEN (coalesce(n3, 0) + 0.1) / (c2 + 0.1 * v) WHEN c1 IS NOT NULL THEN (coalesce(n2, 0) + 0.1) / (c1 + 0.1 * v) ELSE (coalesce(n1, 0) + 0.1) / (total + 0.1 * v) END AS p FROM t LEFT JOIN tri ON tri.odd = t.odd AND tri.a = t.a AND tri.b = t.b AND tri.c = t.c LEFT JOIN c2 ON c2.odd = t.odd AND c2.a = t.a AND c2.b = t.b LEFT JOIN bi ON bi.odd = t.odd AND bi.b = t.b AND bi.c = t.c LEFT JOIN c1 ON c1.odd = t.odd AND c1.b = t.b LEFT JOIN un ON un.odd = t.odd AND un.c = t.c JOIN v ON v.odd = t.odd),"
    + " pp AS (SELECT doc_id, round(exp(-avg(ln(CAST(p AS DOUBLE)))), 3) AS perplexity, round(avg(CAST(n3 IS NOT NULL AS DOUBLE)), 5) AS coverage FROM x GROUP BY 1)"
)
_DIFF = r"dl AS (SELECT record_id AS id, source AS code FROM bug_dataset WHERE regexp_matches(source, '(?m)^@@ -\d+')), d0 AS (SELECT id, unnest(@LINES) AS line, generate_subscripts(@LINES, 1) - 1 AS pos FROM dl), d1 AS (SELECT *, count_if(starts_with(line, '@@ ')) OVER (PARTITION BY id ORDER BY pos) AS hunk FROM d0), d2 AS (SELECT *, max(CASE WHEN starts_with(line, '@@ ') THEN CAST(regexp_extract(line, '^@@ -(\d+)(?:,\d+)? \+(\d+)', 2) AS BIGINT) END) OVER (PARTITION BY id, hunk) AS start FROM d1 WHERE hunk > 0), d AS (SELECT * FROM d2 WHERE NOT starts_with(line, '@@ '))".replace("@LINES", SQL_LINES)
_LN = f"f AS (SELECT file_id, {SQL_LINES} AS ls FROM {FILES} WHERE code IS NOT NULL), l AS (SELECT file_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS pos FROM f)"
ORACLE = {
    "i1_clone_classes": f"WITH {_B}, k AS (SELECT *, count(*) OVER (PARTITION BY fp) AS ne, first_value(file_id || ':' || block) OVER (PARTITION BY fp ORDER BY file_id, block) AS ec, count(*) OVER (PARTITION BY norm_fp) AS nr, first_value(file_id || ':' || block) OVER (PARTITION BY norm_fp ORDER BY file_id, block) AS rc FROM b) SELECT file_id, block, ec AS exact_class, ne - 1 AS exact_links, rc AS renamed_class, nr - ne AS renamed_links FROM k",
    "i4_cross_file": f"WITH {_B}, k AS (SELECT norm_fp, count(*) AS n, count(DISTINCT file_id) AS nf FROM b GROUP BY 1), g AS (SELECT CAST(sum(n) AS BIGINT) AS blocks, CAST(coalesce(sum(CASE WHEN nf > 1 THEN n END), 0) AS BIGINT) AS involved FROM k) SELECT *, round(involved / blocks, 6) AS clone_rate, round(least(100.0, 150 * involved / blocks), 4) AS duplication FROM g",
    "h16_duplication_debt": f"WITH {_B}, k AS (SELECT file_id, count(*) OVER (PARTITION BY fp) AS ne, count(*) OVER (PARTITION BY norm_fp) AS nr FROM b) SELECT file_id, CAST(sum(CASE WHEN ne > 1 THEN 30 WHEN nr > ne THEN 20 ELSE 0 END) AS BIGINT) AS minutes FROM k GROUP BY 1",
    "i2_nearest": "WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT a.id, b.id AS neighbour, round(list_cosine_similarity(a.v, b.v), 6) AS s FROM v a JOIN v b ON a.id % 20 = 0 AND a.id <> b.id), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, neighbour) AS place FROM s) SELECT id, neighbour, s AS similarity, place FROM r WHERE place <= 5",
    "n2_tfidf": r"WITH a AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents WHERE text IS NOT NULL), w AS (SELECT doc_id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i + 1])) AS word FROM a), tf AS (SELECT doc_id, word, count(*) AS c FROM w GROUP BY 1, 2), tt AS (SELECT doc_id, sum(c) AS total FROM tf GROUP BY 1), df AS (SELECT word, count(*) AS df FROM tf GROUP BY 1 ORDER BY df DESC, word LIMIT 512), x AS (SELECT doc_id, word, c / total * (ln(((SELECT count(*) FROM tt) + 1) / (df + 1)) + 1) AS w FROM tf JOIN df USING (word) JOIN tt USING (doc_id)) SELECT doc_id, word, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 5) AS weight FROM x",
    "n3_trigrams": f"WITH {_T3} SELECT a, b, c, count(*) AS n FROM t WHERE a IS NOT NULL GROUP BY ALL HAVING count(*) >= 3",
    "n5_perplexity": f"WITH {_PPL} SELECT * FROM pp",
    "n6_calibrated": f"WITH {_PPL}, q AS (SELECT quantile_cont(perplexity, 0.25) AS q1, quantile_cont(perplexity, 0.5) AS q2, quantile_cont(perplexity, 0.75) AS q3 FROM pp) SELECT doc_id, round(1 / (1 + exp(-(perplexity - q2) / greatest((q3 - q1) / 1.35, 1.0))), 5) AS score FROM pp, q",
    "n11_notebooks": f"SELECT file_id AS id, code FROM {FILES} WHERE code IS NOT NULL",
    "n12_cache_keys": f"SELECT file_id, sha256(path || chr(0) || code) AS key FROM {FILES} WHERE code IS NOT NULL",
    "d20_hunks": rf"WITH {_DIFF}, e AS (SELECT *, starts_with(line, '+') AND NOT starts_with(line, '+++') AS plus, starts_with(line, '-') AND NOT starts_with(line, '---') AS minus FROM d), g AS (SELECT id, CAST(hunk AS BIGINT) AS hunk, CAST(count_if(plus) AS BIGINT) AS added, CAST(count_if(minus) AS BIGINT) AS deleted, CAST(count_if(NOT plus AND NOT minus) AS BIGINT) AS context, sum(CASE WHEN plus THEN len(regexp_extract_all(line, '{RISKY}')) ELSE 0 END) - sum(CASE WHEN minus THEN len(regexp_extract_all(line, '{RISKY}')) ELSE 0 END) - sum(CASE WHEN plus THEN len(regexp_extract_all(line, '{SAFE}')) ELSE 0 END) AS r FROM e GROUP BY 1, 2) SELECT id, hunk, added, deleted, context, round(greatest(0.0, least(1.0, r / greatest(1, added))), 6) AS risk FROM g",
    "d21_new_lines": f"WITH {_DIFF}, n AS (SELECT id, pos, line, start - 1 + sum(CASE WHEN starts_with(line, '-') THEN 0 ELSE 1 END) OVER (PARTITION BY id, hunk ORDER BY pos) AS lineno FROM d) SELECT id, CAST(pos AS INT) AS pos, CAST(lineno AS BIGINT) AS lineno FROM n WHERE starts_with(line, '+')",
    "g2_reach": rf"WITH {_LN}, df AS (SELECT *, nullif(regexp_extract(line, '^\s*(?:async\s+)?(?:def|func|function)\s+([A-Za-z_][A-Za-z0-9_]*)', 1), '') AS def FROM l), c AS (SELECT *, last_value(def IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY pos) AS caller FROM df), cc AS (SELECT * FROM c WHERE caller IS NOT NULL), ca AS (SELECT DISTINCT file_id, caller, unnest(regexp_extract_all(line, '([A-Za-z_][A-Za-z0-9_]*)\(', 1)) AS callee FROM cc WHERE def IS NULL), e AS (SELECT * FROM ca WHERE caller <> callee AND (file_id, callee) IN (SELECT file_id, def FROM cc WHERE def IS NOT NULL)), s AS (SELECT DISTINCT file_id, caller AS name FROM cc WHERE regexp_matches(line, '\b(?:input|open|get|getenv|argv)\b')), o AS (SELECT DISTINCT e.file_id, caller AS name FROM e JOIN s ON s.file_id = e.file_id AND s.name = callee), tw AS (SELECT DISTINCT e.file_id, caller AS name FROM e JOIN o ON o.file_id = e.file_id AND o.name = callee), a AS (SELECT *, 0 AS steps FROM s UNION ALL SELECT *, 1 FROM o UNION ALL SELECT *, 2 FROM tw) SELECT file_id, name, min(steps) AS steps FROM a GROUP BY 1, 2",
    "g9_sources": rf"""WITH {_LN}, a AS (SELECT *, regexp_extract(line, '^\s*([A-Za-z_][A-Za-z0-9_]*)\s*:?=\s*[^=]', 1) AS name FROM l), b AS (SELECT * FROM a WHERE name <> '') SELECT file_id, CAST(pos + 1 AS BIGINT) AS lineno, name, CAST(max(pos) OVER (PARTITION BY file_id, name ORDER BY pos RANGE BETWEEN 80 PRECEDING AND 1 PRECEDING) + 1 AS DOUBLE) AS previous, CASE WHEN regexp_matches(line, 'environ|getenv') THEN 'environment' WHEN regexp_matches(line, 'request|input\(|argv') THEN 'user' WHEN regexp_matches(line, '=\s*["''0-9]') THEN 'literal' ELSE 'computed' END AS kind FROM b""",
}
