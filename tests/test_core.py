import ast
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quillmark.functions import pycode as P
from quillmark.functions import taint
from quillmark.functions.normalize import repo_key
from quillmark.operators import checks, skew, structure, text_metrics
from quillmark.operators.components import connected_components
from quillmark.operators.evaluation import average_ranks, ranked
from quillmark.operators.skew import join_heavy
from quillmark.plans.models import min_norm_weights
from quillmark.streaming.replay import admit


def test_full_sizes(spark, sf):
    """Tokens 65 to 512, ranks past 998 and lines 101 to 2,000 count."""
    code = {r.file_id: r.code for r in text_metrics.files(spark, sf).where("code is not null").collect()}
    toks = {i: re.findall("[A-Za-z_][A-Za-z0-9_]*", c) for i, c in code.items()}
    count = Counter(t for ts in toks.values() for t in ts)
    ids = {t: n for n, t in enumerate(sorted(count, key=lambda t: (-count[t], t))[:9998], 2)}
    assert len(ids) > 998 and max(map(len, toks.values())) > 64
    assert {r.token: r.id for r in text_metrics.d18_vocabulary(spark, sf).collect()} == ids
    want = {i: ([ids.get(t, 1) for t in ts[:512]] + [0] * 512)[:512] for i, ts in toks.items()}
    assert {r.file_id: r.ids for r in text_metrics.d19_token_ids(spark, sf).collect()} == want
    lines = {i: c.split("\n") for i, c in code.items()}
    assert max(map(len, lines.values())) > 100 and all(r.accepted == (len(lines[r.file_id]) <= 2000) for r in checks.c13_guard(spark, sf).where("n_chars > 0").collect())


def test_repo_key(spark):
    given = ["https://git.example/Own/Name.git", "own/name/", "git@h:own/name", " OWN/NAME ", None, "", "name"]
    got = [r[0] for r in spark.createDataFrame([(g,) for g in given], "r string").select(repo_key(F.col("r"))).collect()]
    assert got == ["own/name"] * 4 + [None] * 3


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (7, 7), (200, 200), (None, 3)]
    got = dict(tuple(r) for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100, 200: 200}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_numbering_is_exact_under_skew(spark, tmp_path):
    n = 5000
    df = spark.range(n).select(F.when(F.col("id") % 3 < 2, "hot").when(F.col("id") % 50 == 2, None).otherwise(F.concat(F.lit("k"), (F.col("id") % 7).cast("string"))).alias("key"), (F.col("id") % 2).cast("double").alias("value"))
    df.repartition(5).write.parquet(str(tmp_path / "t"))
    t = skew.with_blocks(spark.read.parquet(str(tmp_path / "t")), 128).select("key", "value", "_block", "_pos")
    got = skew.number_rows(t, "key").toPandas()
    for _, g in got.groupby("key", dropna=False):
        assert sorted(g._n) == list(range(len(g)))
    res = skew._counts(t, "key", "value", chunk_rows=100).toPandas().set_index("key")
    assert res.loc["hot", "n_rows"] == (got.key == "hot").sum() and res.loc["hot", "chunks"] >= 33
    assert res.loc["hot", "first_pos"] == 0 and res.loc["hot", "last_pos"] == res.loc["hot", "n_rows"] - 1
    assert [r.key for r in skew.heavy_keys(t, "key", "value").collect()].count("hot") == 1


def test_empty_tables(spark, tables):
    d = tables()
    for name, q in skew.QUERIES.items():
        assert q(spark, d).count() == 0, name
    for name in ("e5_metrics", "f18_issues", "g1_taint"):
        assert structure.QUERIES[name](spark, d).count() == 0


def test_ranks(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), float(s), int(y)) for i, (s, y) in enumerate(zip(rng.integers(0, 20, 500) / 20, rng.integers(0, 2, 500)))]
    df = spark.createDataFrame(rows, "id long, score double, y int")
    want = sorted(rows, key=lambda r: (-r[1], r[0]))
    assert ranked(df).orderBy("rn").toPandas().id.tolist() == [r[0] for r in want]
    got = ranked(df, parts=8).orderBy("rn").toPandas()
    assert got.id.tolist() == [r[0] for r in want] and got.cum_y.tolist() == np.cumsum([r[2] for r in want]).tolist()
    ar = average_ranks(df, "score").toPandas()
    scores = np.array([r[1] for r in rows])
    for s, r in zip(ar.score, ar["rank"]):
        assert r == (scores < s).sum() + ((scores == s).sum() + 1) / 2


COGNITIVE = [
    ("def f(x):\n    return x\n", 0), ("def f(x):\n    if x:\n        return 1\n", 1), ("def f(x, y):\n    if x:\n        if y:\n            return 1\n", 3),
    ("def f(xs):\n    for x in xs:\n        if x and x > 1:\n            pass\n", 4), ("def f(n):\n    while n:\n        n -= 1\n    else:\n        n = 1\n", 2),
    ("def f(n):\n    return f(n - 1) if n else 0\n", 2), ("def f():\n    def g(x):\n        if x:\n            pass\n    return g\n", 2), ("def f():\n    try:\n        pass\n    except E:\n        pass\n", 1),
    ("def f(p):\n    with open(p) as h:\n        return h\n", 0), ("def f(x):\n    match x:\n        case 1:\n            return 2\n", 1),
]


def test_cognitive_and_cyclomatic():
    for code, want in COGNITIVE:
        assert P.cognitive(ast.parse(code)) == want, code
    assert P.cyclomatic(ast.parse("def f(a, b):\n    if a and b or a:\n        return [x for x in a] if b else 0\n")) == 6
    assert structure.metrics_of("def broken(:\n")[0][:3] == (False, 1, 0)


ISSUES = {
    "unused_import": "import os\nx = 1\n", "unreachable_code": "def f():\n    return 1\n    x = 2\n", "bare_except": "try:\n    f()\nexcept:\n    g()\n", "empty_except": "try:\n    f()\nexcept E:\n    pass\n",
    "unused_variable": "def f():\n    a = 1\n    return 2\n", "redundant_else": "def f(x):\n    if x:\n        return 1\n    else:\n        return 2\n", "nested_loops": "for a in b:\n    for c in d:\n        f(c)\n",
    "string_concat_loop": "for a in b:\n    s += 'x'\n", "mutable_default": "def f(a=[]):\n    return a\n", "sql_injection": "c.execute('select ' + x)\n", "command_injection": "subprocess.run(x, shell=True)\n",
    "weak_crypto": "import hashlib\nhashlib.md5(x)\n", "unsafe_deserialization": "pickle.loads(x)\n", "path_traversal": "with open(p) as f:\n    pass\n", "wildcard": "from a import *\n", "parameter_object": "def f(a, b, c, d, e):\n    return a + b + c + d + e\n",
    "regex_in_loop": "import re\nfor a in b:\n    re.match(a, a)\n", "append_in_loop": "for a in b:\n    r.append(a)\n", "db_query_in_loop": "for a in b:\n    cur.execute(a)\n", "import_in_function": "def f():\n    import os\n    return os\n",
}


def test_issues():
    for kind, code in ISSUES.items():
        assert kind in {r[1] for r in structure.issues_of(code)}, kind
    clean = "import os\n\n\ndef main(path):\n    return os.path.basename(path)\n\n\nmain('a')\n"
    assert structure.issues_of(clean) == [] and structure.issues_of("def (") == []


def test_taint():
    paths = lambda c: [(p.sink, p.line) for p in taint.analyse(c, ast.parse(c)).paths]
    assert paths("x = input()\neval(x)\n") == [("eval", 2)]
    assert paths("x = input()\nif a:\n    y = x\nelse:\n    y = 1\nos.system(y)\n") == [("system", 6)]
    assert paths("x = int(input())\neval(x)\n") == [] and paths("def f():\n    q = 1\n    eval(q)\n") == []


def test_small_functions():
    assert admit([0, 1, 2, 3, 10], [], seconds=5, most=2)[0] == [True, True, False, False, True]
    assert P.renamed("a = b + a if c else d") == "VAR1 = VAR2 + VAR1 if VAR3 else VAR4"
    assert structure.generic_of("// c\nint f() { if (a && b) { return 1; } }\n/* x\n y */\n\n", "java")[:5] == (1, 3, 1, 3, 2)
    w = min_norm_weights(np.array([[1.0, 0.0], [0.0, 1.0]]))
    assert abs(w[0] - 0.5) < 1e-6


def test_heavy_keys_are_joined_like_the_rest(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") < 600, "a").when(F.col("id") < 990, F.concat(F.lit("k"), F.col("id") % 40)).alias("k"))
    small = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top"))
    want = sorted(map(tuple, df.join(small, "k").collect()))
    for least in (1, 11, 600, 10_000):
        got = join_heavy(df, small, ["k"], "n", 1000, least)
        assert sorted(map(tuple, got.select("k", "id", "n", "top").collect())) == want
    assert join_heavy(df.limit(0), small, ["k"], "n", 0, 1).count() == 0


def test_running_states_and_order_equal_brute_force(spark):
    """One key holds most rows, many rows share a place in time, some keys and months are null."""
    rng = np.random.default_rng(2)
    rows = [(i, "a" if i % 3 else None if i % 2 else "b", int(t), float(v)) for i, (t, v) in enumerate(zip(rng.integers(0, 6, 400), rng.integers(0, 9, 400)))]
    df = spark.createDataFrame(rows, "id long, k string, t long, v double").withColumn("month", F.expr("t div 2"))
    for least in (1, 100, 10_000):  # all keys, one key, no key in chunks
        run = skew.running(df, ["k"], "month", [F.col("t"), F.col("id")], {"n": F.lit(1).cast("long"), "total": F.col("v")}, {"top": F.col("t")}, least=least)
        got = {r.id: (r.n, r.total, r.top) for r in run.collect()}
        assert set(got) == {r[0] for r in rows if r[1]}
        for i, k, t, _ in rows:
            if k is None:
                continue
            earlier = [r for r in rows if r[1] == k and (r[2], r[0]) < (t, i)]
            assert got[i] == (len(earlier), sum(r[3] for r in earlier), max((r[2] for r in earlier), default=None))
    got = skew.in_order(df, [F.asc("t"), F.asc("id")], ["v"], 7).orderBy("rn").collect()
    want = sorted(rows, key=lambda r: (r[2], r[0]))
    assert [r.id for r in got] == [r[0] for r in want] and [r.rn for r in got] == list(range(1, 401)) and {r.n for r in got} == {400}
    assert [r.cum_v for r in got] == np.cumsum([r[3] for r in want]).tolist()
    assert skew.in_order(df.limit(0), [F.asc("t")]).count() == 0 and skew.running(df.limit(0), ["k"], "month", [F.col("t")], {"n": F.lit(1)}).count() == 0
