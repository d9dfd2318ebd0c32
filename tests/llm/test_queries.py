"""The operators on Spark: against brute force, against SQL, and on awkward input."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillmark import registry
from quillmark.llm import neardup, residue
from quillmark.llm.packing import pack
from quillmark.llm.registry import MODULES

QUERIES, SQL = registry.collect(MODULES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(name, spark, duck, sf, same):
    same(QUERIES[name](spark, sf).toPandas(), duck.execute(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(name, spark, tables):
    assert QUERIES[name](spark, tables()).count() == 0


def _shingles(s):
    w = re.findall("[a-z0-9_]+", (s or "").lower())
    return {tuple(w[i : i + 4]) for i in range(len(w) - 3)}


def _brute(rows, ok=lambda a, b: True):
    sets = {i: _shingles(s) for i, s, *_ in rows}
    extra = {i: r for i, *r in rows}
    out, ids = set(), sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and ok(extra[i], extra[j]) and len(a & b) >= 0.7 * len(a | b):
                out.add((i, j))
    return out


def test_near_duplicates_equal_brute_force(spark, sf):
    got = {}
    for r in neardup.p4_found(spark, sf).collect():
        got.setdefault(r.dataset, set()).add((r.record_a, r.record_b))
    for t in neardup.P4_TABLES:
        rows = spark.read.parquet(f"{sf}/{t}.parquet").select("record_id", "source").collect()
        assert got.get(t, set()) == _brute(rows)


def test_copies_in_groups(spark, monkeypatch):
    """Classes of many copies are dealt to groups of two: the same pairs, each once."""
    text = {c: " ".join(f"{c}{k}" for k in range(40)) for c in "abc"}
    near = text["a"].replace("a7 ", "z ")
    rows = [(i, text["a"]) for i in range(9)] + [(20 + i, near) for i in range(7)] + [(40 + i, text["b"]) for i in range(3)] + [(60, text["c"]), (61, None)]
    monkeypatch.setattr(neardup, "BLOCK", 2)
    df = spark.createDataFrame([("t", i, s) for i, s in rows], "dataset string, record_id long, source string")
    monkeypatch.setattr(neardup, "p4_links", lambda *a: neardup.link(df))
    pairs = [(r.record_a, r.record_b) for r in neardup.p4_found(spark, "").collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == _brute(rows)
    split = F.when(F.col("record_id") % 3 == 0, "test").otherwise("train")
    monkeypatch.setattr(neardup, "_p2_texts", lambda *a: df.withColumn("split", split).withColumn("repo", F.lit("r")))
    pairs = [(r.record_a, r.record_b) for r in neardup.p2_found(spark, "").collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(a, b) for a, b in _brute(rows) if (a % 3 == 0) != (b % 3 == 0)}


def test_cross_split_equals_brute_force(spark, sf):
    got = {}
    for r in neardup.p2_found(spark, sf).collect():
        got.setdefault(r.dataset, set()).add((r.record_a, r.record_b))
    held = ("validation", "test")

    def across(a, b):
        x, y = ((v[1] or "").strip().lower() for v in (a, b))
        return x == "train" and y in held or y == "train" and x in held

    for t in neardup.P2_TABLES:
        rows = spark.read.parquet(f"{sf}/{t}.parquet").select("record_id", "source", "split").collect()
        assert got.get(t, set()) == _brute(rows, across)


def test_hot_buckets_and_copies(spark):
    """A shared header in every text, a third of all rows equal: nothing lost, whatever the bucket limit."""
    head = " ".join(f"h{i}" for i in range(60))
    texts = [(i, head + " " + " ".join(f"w{i}_{k}" for k in range(10 + i % 5))) for i in range(120)] + [(1000 + i, "same text " * 20) for i in range(60)]
    texts += [(2000, None), (2001, ""), (2002, "a b c")]
    df = spark.createDataFrame([("t", i, s) for i, s in texts], "dataset string, record_id long, source string").withColumn("n", F.lit(1))
    signed = neardup.signatures(df.drop("n"), "source", "dataset")
    cls = neardup.classes(signed, {}).cache()
    assert cls.count() == 121
    want = _brute([(i, s) for i, s in texts if i < 1000])
    for hot, block in ((4, 8), (64, 1024), (10_000, 1024)):
        pairs = neardup.verified(neardup.candidates(cls, df, hot=hot, block=block), df)
        got = {(r.a, r.b) for r in pairs.collect()}
        assert len(want - got) <= 0.001 * len(want) and got <= want


def test_one_bucket_of_ten_thousand_classes(spark):
    """Half of each text is shared by all 10,000 (similarity about 0.5 of any two), 600 have an edited copy: exactly those pairs."""
    rng = random.Random(5)
    head = [f"h{i}" for i in range(100)]
    texts = {}
    for i in range(9400):
        texts[i] = head + [f"w{rng.randrange(10**6)}" for _ in range(95)]
    for i in range(600):
        own = list(texts[i])
        for k in rng.sample(range(100, 190), 1 + i % 12):
            own[k] = f"e{rng.randrange(10**6)}"
        texts[20_000 + i] = own
    joined = [("t", i, " ".join(w)) for i, w in texts.items()]
    sets = {i: _shingles(s) for _, i, s in joined}
    common = set.intersection(*sets.values())
    assert all(len(common) < 0.69 * len(v) for v in sets.values())  # so a pair needs more than what all share
    owners = {}
    for i, v in sets.items():
        for g in v - common:
            owners.setdefault(g, []).append(i)
    met = {(a, b) for v in owners.values() for a in v for b in v if a < b}
    want = {(a, b) for a, b in met if len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b])}
    df = spark.createDataFrame(joined, "dataset string, record_id long, source string").repartition(8)
    members, links = neardup.link(df)
    assert members.count() == 10_000
    got = {(r.a, r.b) for r in links.collect()}
    assert len(want) > 200 and got == want


def test_tables_are_never_paired_with_each_other(spark):
    """Names that begin alike, the same texts under the same ids."""
    text = [" ".join(f"w{i}_{k}" for k in range(30)) for i in range(5)]
    rows = [(d, i + 10 * c, t + f" c{c}") for d in ("security_dataset", "security_finding") for i, t in enumerate(text) for c in (0, 1)]
    _, links = neardup.link(spark.createDataFrame(rows, "dataset string, record_id long, source string"))
    assert {(r.dataset, r.a, r.b) for r in links.collect()} == {(d, i, i + 10) for d in ("security_dataset", "security_finding") for i in range(5)}


def test_groups_have_one_row_a_record(spark, sf):
    g = neardup.p4_groups(spark, sf).toPandas()
    pairs = neardup.p4_found(spark, sf).toPandas()
    assert not g.duplicated(["dataset", "record_id"]).any()
    assert g.n_links.sum() == 2 * len(pairs)
    root = {(r.dataset, r.record_id): r.group_id for r in g.itertuples()}
    assert all(root[r.dataset, r.record_a] == root[r.dataset, r.record_b] for r in pairs.itertuples())


def test_splits_keep_ties_together(spark, sf):
    a = QUERIES["p7_assign"](spark, sf).toPandas()
    n = sum(spark.read.parquet(f"{sf}/{t}.parquet").count() for t in ("security_dataset", "bug_dataset"))
    assert len(a) == n and a.split.isin(["train", "validation", "test"]).all()
    from quillmark.functions.normalize import repo_key

    b = spark.read.parquet(f"{sf}/bug_dataset.parquet").select("record_id", repo_key(F.col("repo")).alias("repo")).toPandas()
    split = b.merge(a[a.dataset == "bug_dataset"], on="record_id").dropna(subset=["repo"]).groupby("repo").split.agg(set)
    assert (split.map(len) == 1).all()
    for r in QUERIES["p7_found"](spark, sf).toPandas().itertuples():
        assert split[r.repo_a] == split[r.repo_b]


def test_containers_hold_everything(spark):
    lengths = [(i, (i * 7919) % 900) for i in range(400)] + [(9001, 0), (9002, 5000), (9003, 512), (9004, None)]
    spec = spark.createDataFrame([("s", 512), ("l", 2048), ("none", 0)], "container_kind string, capacity_tokens int")
    df = spark.createDataFrame(lengths, "doc_id long, n_tokens int").repartition(5)
    rows = pack(df, spec).select("container_kind", "capacity_tokens", "container_id", F.explode("items").alias("i")).select("*", "i.*").toPandas()
    for (kind, cap), g in rows.groupby(["container_kind", "capacity_tokens"]):
        assert g.groupby("container_id").n_tokens.sum().max() <= cap
        assert g.groupby("doc_id").n_tokens.sum().to_dict() == {i: n for i, n in lengths if n is not None}
        whole = g.groupby("doc_id").size()
        assert all(whole[i] == max(1, -(-n // cap)) for i, n in lengths if n is not None)
        used = g.n_tokens.sum() / (g.container_id.nunique() * cap)
        assert used > 0.9


def test_common_error_page(spark, sf):
    """A third of all rows are one error page: all of them are found, and no other document more than without them."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    n = docs.count()
    page = "# 503 Service Unavailable\n\nThe server is temporarily unable to service your request due to maintenance downtime or capacity problems.\nPlease try again later.\n"
    copies = spark.range(n // 2).select((F.col("id") + 10**9).alias("doc_id"), F.lit(page).alias("text"))
    alone = {r.doc_id for r in residue.detect(docs).where("residue is not null").collect()}
    found = {r.doc_id for r in residue.detect(docs.union(copies)).where("residue is not null").collect()}
    assert len({i for i in found if i >= 10**9}) == n // 2
    assert {i for i in found if i < 10**9} == alone


def test_awkward_rows(spark, tables, sf):
    """Nulls in any column, blank and very long texts, repeated rows, and an extra column with a clashing name."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    docs = docs.union(docs.withColumn("doc_id", F.col("doc_id") + 100000)).union(docs.limit(3).withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.col("doc_id") + 200000))
    docs = docs.union(docs.limit(1).withColumn("text", F.repeat(F.lit("word 12 "), 60000)).withColumn("doc_id", F.lit(300000).cast("long"))).union(docs.limit(1).withColumn("text", F.lit("  \n")).withColumn("doc_id", F.lit(300001).cast("long")))
    spec = spark.read.parquet(f"{sf}/container_spec.parquet")
    sec = spark.read.parquet(f"{sf}/security_dataset.parquet").limit(30)
    nulls = sec.limit(1).select("record_id", *(F.lit(None).cast(t).alias(c) for c, t in sec.dtypes if c != "record_id"))
    d = tables(documents=docs.withColumn("ids", F.lit(1)).withColumn("n", F.lit("x")), container_spec=spec, security_dataset=sec.union(nulls).withColumn("dataset", F.lit("clash")), split_plan=spark.read.parquet(f"{sf}/split_plan.parquet"))
    ids = QUERIES["p8_ids"](spark, d).toPandas().set_index("doc_id").ids
    assert len(ids) == docs.count() and len(ids[200000 + int(docs.limit(1).first().doc_id)] if 200000 + int(docs.limit(1).first().doc_id) in ids.index else []) == 0
    for name in ("p3_found", "p6_found", "p6_redacted", "p7_assign", "p9_assignments", "p10_found", "p2_found"):
        assert QUERIES[name](spark, d).count() >= 0, name
