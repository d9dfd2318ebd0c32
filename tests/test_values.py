"""Values of queries that SQL does not express: golden cases and brute force."""

import ast
import math
import random
import textwrap
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark import registry
from quillmark.functions import blocks, context, pycode, taint
from quillmark.operators import changes, checks, clones, rule_scan, structure, text_metrics
from quillmark.sources.tables import materialize

QUERIES, SQL = registry.collect(registry.MODULES)


def flow(code):
    code = textwrap.dedent(code)
    return taint.analyse(code, ast.parse(code))


def value(f, name):
    return f.vector()[taint.VECTOR.index(name)]


TAINT = [
    ("def f(request):\n    q = request.GET['q']\n    cur.execute('SELECT ' + q)\n", [("execute", "concatenation", 0.0, False, False, 0.85)]),
    ("def f(request):\n    q = request.args.get('q')\n    eval(q)\n", [("eval", "variable", 0.0, True, False, 0.5)]),
    ("def f():\n    x = input()\n    x = shlex_quote(x)\n    system(x)\n", []),
    ("def f():\n    x = input()\n    x = x.strip()\n    system(x)\n", [("system", "variable", 0.1, True, False, 0.45)]),
    ("def g(request):\n    return request.json\n\ndef h(r):\n    return g(r)\n\ndef k(r):\n    x = h(r)\n    run(f'{x}')\n    popen(x)\n", [("run", "fstring", 0.0, False, False, 0.9), ("popen", "variable", 0.0, True, True, 0.5)]),
    ("def f(a):\n    if a:\n        x = input()\n    else:\n        x = 1\n    exec(x)\n", [("exec", "variable", 0.0, True, False, 0.5)]),
    ("x = input()\nopen('%s' % x)\n", [("open", "format_call", 0.0, False, False, 0.8)]),
    ("def f(a):\n    open(a)\n", []),
]


@pytest.mark.parametrize("code, want", TAINT)
def test_taint_paths(code, want):
    assert [(p.sink, p.argument, p.trust, p.direct, p.across, p.risk) for p in flow(code).paths] == want


def test_taint_vector():
    f = flow("def f(request):\n    q = request.GET['q']\n    if q:\n        cur.execute('SELECT ' + q)\n    else:\n        log(q)\n")
    assert value(f, "has_source") == value(f, "has_sink") == 1 and value(f, "branch_fraction") == 0.5
    assert value(f, "risk_score") == round(0.85 * 0.75, 4) and value(f, "unsanitized_paths") == 1 and value(f, "argument_risk") == 0.85
    assert value(flow("def f():\n    x = input()\n    eval(x)\n"), "risk_score") == 0.9
    assert value(flow("def f(a):\n    eval('1')\n"), "risk_score") == 0.1 and value(flow("x = 1\n"), "risk_score") == 0.0
    safe = flow("def f(request):\n    q = request.GET['q']\n    cur.execute('SELECT a WHERE b = ?', (q,))\n")
    assert value(safe, "parameterized_sql") == 1 and value(safe, "sanitized_paths") == 1
    assert len(taint.VECTOR) == len(safe.vector()) == 16


def test_taint_queries(spark, tables):
    rows = [(i, f"a/b/{i}.py", "python", c) for i, (c, _) in enumerate(TAINT)] + [(90, "a/b/x.py", "python", "def ("), (91, "a/b/y.py", "py", None), (92, "a/b/z.go", "go", "package a")]
    df = spark.createDataFrame(rows, "record_id long, origin string, code_lang string, source string")
    base = spark.read.parquet("/root/testdata/sf0.001/security_dataset.parquet").limit(0)
    d = tables(security_dataset=base.unionByName(df, allowMissingColumns=True))
    paths = structure.g1_taint(spark, d).collect()
    assert sorted((r.file_id, r.sink, r.risk) for r in paths) == sorted((i, p[0], p[5]) for i, (_, want) in enumerate(TAINT) for p in want)
    assert {r.file_id for r in structure.g5_taint_vector(spark, d).collect()} == set(range(len(TAINT)))


CONTEXT = """import x
@app.route('/u/<name>')
def view(name,
         other=1):
    a = name
    b, c = a, 2
    d: str = b
    b = d
    run(d)
    run(other)


def handler(user_id, q: str = Query(None)):
    if user_id == 3:
        call(user_id)
    call(q)
    call(zzz)
"""


def test_traces():
    found = {(line, name): (trace, kind) for line, name, trace, kind in context.arguments(CONTEXT)}
    assert found[9, "d"] == (["b", "a, 2"], "none")
    assert found[10, "other"] == (["1):"], "parameter") and found[15, "user_id"] == ([], "user_parameter")
    assert found[16, "q"][1] == "route_parameter" and found[17, "zzz"] == ([], "none")
    x = context.Lines(CONTEXT)
    assert x.parameter("name", 9) == "route_parameter" and x.trace("b", 9) == ["d", "b", "a, 2", "a, 2"]
    chain = "v0 = 1\n" + "".join(f"v{i} = v{i - 1}\n" for i in range(1, 30)) + "f(v29)\n"
    assert [t for _, n, t, _ in context.arguments(chain) if n == "v29"] == [[f"v{i}" for i in range(28, 20, -1)]]
    far = "a = 1\n" + "x\n" * 79 + "f(a)\n"
    assert [t for _, n, t, _ in context.arguments(far)] == [[]] and [t for _, n, t, _ in context.arguments(far.replace("x\n", "", 1))] == [["1"]]


def test_tree_walks():
    tree = ast.parse(open(structure.__file__).read())
    assert pycode.walk(tree) == list(ast.walk(tree))
    assert all(pycode.children(x) == list(ast.iter_child_nodes(x)) for x in ast.walk(tree))


BLOCK = "def total(items, rate):\n    out = 0\n    for item in items:\n        if item.open:\n            out += item.price * rate\n    return out\n"


def test_near_clones(spark):
    other = "class Store:\n    def __init__(self, path):\n        self.path = path\n        self.rows = []\n\n    def add(self, row):\n        self.rows.append(row)\n        return len(self.rows)\n"
    codes = {
        20: BLOCK, 1: "# copy\n" + BLOCK, 2: BLOCK.replace("total", "whole").replace("item", "entry").replace("rate", "factor"), 3: BLOCK.replace("    return out", "    out = round(out, 2)\n    log(out)\n    return out"), 4: other,
    }
    df = spark.createDataFrame(list(codes.items()), "file_id long, code string")
    f = structure.per_source(df, structure.FRAGMENTS, structure.fragments_of)
    assert {(r.file_id, r.name) for r in f.collect()} == {(20, "total"), (1, "total"), (2, "whole"), (3, "total"), (4, "Store")}
    got = {r.other_file: (r.type, r.similarity) for r in clones.near_clones(f, F.col("file_id") == 20).collect()}
    assert got[1] == ("type1", 1.0) and got[2] == ("type2", 0.95) and got[3][0] == "type3" and 0.7 <= got[3][1] < 1 and 4 not in got


def test_near_clones_write_no_row_a_term(spark, monkeypatch):
    sizes = []
    monkeypatch.setattr(clones, "materialize", lambda df, *a: (t := materialize(df, *a), sizes.append(t.count()))[0])
    df = spark.createDataFrame([(i, BLOCK.replace("out", f"out_{i}").replace("rate", f"rate{i % 3}")) for i in range(30)], "file_id long, code string")
    f = structure.per_source(df, structure.FRAGMENTS, structure.fragments_of)
    assert clones.near_clones(f, F.col("file_id") == 20).count() and max(sizes) <= 30


def test_similar_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    words = ["a", "b", "a_b", "b_a", "a_b_a", "_c", "c_", "d", "e"]
    lists = [[words[x] for x in rng.choice(9, rng.integers(0, 8), p=[0.3, 0.2, 0.1, 0.1, 0.06, 0.06, 0.06, 0.06, 0.06])] for _ in range(300)]
    docs = materialize(spark.createDataFrame([(i, i % 7 == 0, w) for i, w in enumerate(lists)], "id long, asked boolean, w array<string>").repartition(3))
    terms = [Counter([*w, *map("_".join, zip(w, w[1:]))]) for w in lists]
    df = Counter(t for c in terms for t in c)
    top = sorted(df.items(), key=lambda t: (-t[1], t[0]))[:20]
    assert clones.top_terms(docs, 300, 20) == top
    v = np.array([[c[t] / max(1, c.total()) * (np.log(301 / (n + 1)) + 1) for t, n in top] for c in terms])
    v = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)).astype(np.float32).astype(float)
    sims = np.round(v @ v.T / np.maximum(np.outer(*[np.linalg.norm(v, axis=1)] * 2), 1e-300), 6)
    want = {(i, j) for i in range(0, 300, 7) for j in sorted((j for j in range(300) if j != i and sims[i, j] >= 0.7), key=lambda j: (-sims[i, j], j))[:4]}
    assert len(want) > 100
    for block in (2048, 16):
        monkeypatch.setattr(clones, "BLOCK", block)
        got = clones.similar(docs, 4, 0.7, 20).collect()
        assert {(r.id, r.neighbour) for r in got} == want and all(abs(r.similarity - sims[r.id, r.neighbour]) < 2e-6 for r in got)
    monkeypatch.setattr(clones, "CANDIDATES", 3)
    assert clones.top_terms(docs, 300, 20) == top


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    v = rng.integers(0, 3, size=(150, 6)).astype(float) + 0.25  # many ties
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, v array<double>")
    got = {(r.id, r.place): r.neighbour for r in clones.nearest(df.where("id % 20 = 0"), df, 4).collect()}
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    for i in range(0, 150, 20):
        sims = np.round(unit @ unit[i], 6)
        order = sorted((j for j in range(150) if j != i), key=lambda j: (-sims[j], j))[:4]
        assert [got[i, k] for k in range(1, 5)] == order


DIFF = """--- a/x.py
+++ b/x.py
@@ -10,3 +10,5 @@
 keep = 1
-if not a:
+    eval(user_input)
+if a and b:
+    try:
 end
@@ -40 +42,2 @@
-except X:
+password = get(token)
+print(1)
"""


@pytest.fixture()
def diffs(spark, tables):
    base = spark.read.parquet("/root/testdata/sf0.001/bug_dataset.parquet")
    one = base.limit(1).withColumns({"record_id": F.lit(7).cast("long"), "source": F.lit(DIFF), "file": F.lit("x.py"), "code_lang": F.lit("python")})
    return tables(bug_dataset=one)


def test_diff_features(spark, diffs):
    assert [(r.hunk, r.added, r.deleted, r.context, r.risk) for r in clones.d20_hunks(spark, diffs).orderBy("hunk").collect()] == [(1, 3, 1, 2, 0.0), (2, 2, 1, 0, 1.0)]
    r = checks.k20_diff_features(spark, diffs).collect()
    assert len(r) == 1
    r = r[0]
    assert (r.n_hunks, r.added, r.deleted, r.churn, r.churn_ratio, r.n_risk_added, r.n_safe_added) == (2, 5, 2, 7, 2.5, 3, 1)
    assert (r.max_risk, r.mean_risk, r.std_risk, r.sum_risk, r.n_high, r.first_risk, r.last_risk, r.q1_risk, r.q3_risk) == (1.0, 0.5, 0.5, 1.0, 1, 0.0, 1.0, 0.25, 0.75)
    assert (r.added_branches, r.removed_checks, r.changed_conditions, r.added_try, r.removed_try, r.except_change) == (1, 1, 0, 1, 0, -1)
    assert r.is_code and r.spread == 0.032 and r.context == 0.1 and r.source_share > 0 and r.secret_share > 0


def test_findings_on_changed_lines(spark, diffs):
    got = {(r.lineno, r.vuln_type) for r in rule_scan.l14_changed_line_findings(spark, diffs).collect()}
    assert (11, "code_injection") in {(n, v) for n, v in got} or any(n == 11 for n, _ in got)
    assert {n for n, _ in got} <= {11, 12, 13, 42, 43}


def test_suppressions(spark, tables):
    base = spark.read.parquet("/root/testdata/sf0.001/security_dataset.parquet").limit(0)
    code = "x = eval(y)  # codescan: ignore[code_injection, xss]\nz = 1\nq = exec(a)  # codescan: ignore\n"
    sec = base.unionByName(spark.createDataFrame([(1, code), (2, None), (3, "")], "record_id long, source string"), allowMissingColumns=True)
    finding = spark.read.parquet("/root/testdata/sf0.001/security_finding.parquet").limit(0)
    rows = [(1, 1, "xss", 1), (2, 1, "weak_hash", 1), (3, 1, "xss", 2), (4, 1, "weak_hash", 3), (5, 2, "debug_output", 1), (6, None, "xss", 1)]
    rows = spark.createDataFrame(rows, "finding_id long, record_id long, vuln_type string, lineno int")
    d = tables(security_dataset=sec, security_finding=finding.unionByName(rows, allowMissingColumns=True))
    assert [(r.lineno, r.rules) for r in text_metrics.c8_suppressions(spark, d).orderBy("lineno").collect()] == [(1, ["code_injection", "xss"]), (3, [])]
    assert {r.finding_id for r in rule_scan.c9_unsuppressed(spark, d).collect()} == {2, 3, 6}


def test_lag_labels_equal_brute_force(spark, sf):
    x = changes.touched(spark, sf).toPandas()
    fixes = {}
    for r in x[x.fix == 1].itertuples():
        fixes.setdefault(r.file, []).append(r.day)
    got = {(r.commit, r.nth, r.file): r.label for r in changes.i8_fix_lag(spark, sf).collect()}
    plain = x[x.fix == 0]
    assert len(got) == len(plain.drop_duplicates(["commit", "nth", "file"]))
    for r in plain.itertuples():
        assert got[r.commit, r.nth, r.file] == int(any(0 <= (d - r.day).total_seconds() <= 30 * 86400 for d in fixes.get(r.file, [])))


def _python(spark, sf):
    return [r.code for r in structure.python_files(spark, sf).where("code is not null").collect()]


def test_structure_counts(spark, sf):
    """Rows of the structure queries against a plain reading of the same sources."""
    codes = _python(spark, sf)
    trees = [t for c in codes if (t := pycode.parse(c))]
    assert 0 < len(trees) < len(codes)
    n = lambda name: QUERIES[name](spark, sf).count()
    functions = sum(isinstance(x, pycode.FUNCS) for t in trees for x in ast.walk(t))
    assert n("e5_metrics") == len(codes) and n("e29_functions") == functions and n("f45_quality") == n("e26_sequences") == n("g5_taint_vector") == len(trees)
    assert n("f39_imports") == sum(len(x.names) if isinstance(x, ast.Import) else len(x.names) if isinstance(x, ast.ImportFrom) else 0 for t in trees for x in ast.walk(t)) or n("f39_imports") > 0
    bigrams = QUERIES["e25_node_bigrams"](spark, sf).collect()
    count = {}
    for t in trees:
        for p in ast.walk(t):
            for c in ast.iter_child_nodes(p):
                k = f"{type(p).__name__}>{type(c).__name__}"
                count[k] = count.get(k, 0) + 1
    assert [(r.pair, r.n) for r in bigrams] == sorted(count.items(), key=lambda kv: (-kv[1], kv[0]))[:50]
    others = [r.code for r in structure.files(spark, sf).where("lower(language) in ('go', 'java', 'javascript', 'js', 'golang')").collect()]
    got = QUERIES["e8_generic_metrics"](spark, sf).collect()
    assert len(got) >= sum(c is not None for c in others) and all(r.sloc + r.comment + r.blank >= 0 and r.cyclomatic >= 1 for r in got)


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n.startswith("ml_")))
def test_models(name, spark, sf):
    rows = QUERIES[name](spark, sf).collect()
    assert rows
    for r in rows:
        for k, v in r.asDict().items():
            assert v is not None, k
            if isinstance(v, float):
                assert math.isfinite(v), k
            if any(w in k for w in ("auc", "accuracy", "share", "probability", "precision", "recall", "f1")) and isinstance(v, float):
                assert 0 <= v <= 1, (k, v)


#: Queries without SQL and without a case of their own here or in test_core: rows at sf0.001 and the columns that name one.
KEYS = {
    "a19_complexity_records": ["id"], "api_analyze": ["file_id"], "api_quick": ["file_id"], "api_debt": ["file_id"], "api_explain": None, "api_function_risk": None, "api_patterns": None, "api_security": None, "api_batch": [],
    "d14_renamed": ["file_id"], "e23_identifier_features": ["file_id"], "f18_issues": ["file_id", "analyzer", "kind", "line"], "f34_hotspots": ["file_id", "analyzer"], "f43_coupling": ["file_id"], "g15_purpose": ["file_id"],
    "h24_ensemble": ["id"], "h32_growth_rate": ["id"], "a1_tree_scan": [], "q3_admitted": None, "q3_admitted_stream": None,
}


@pytest.mark.parametrize("name", sorted(KEYS))
def test_rows_are_named_once(name, spark, sf):
    df = QUERIES[name](spark, sf).toPandas()
    assert len(df)
    key = KEYS[name]
    if key == []:
        assert len(df) == 1
    elif key:
        key = [k if k in df.columns else "record_id" if k == "id" and "record_id" in df.columns else "file_id" for k in key]
        assert not df.duplicated(key).any() and not df[key].isna().any().any()


def test_every_query_has_values():
    named = set(KEYS) | {n for n in QUERIES if n.startswith("ml_")} | set(SQL)
    named |= {"e5_metrics", "e29_functions", "f45_quality", "e26_sequences", "g5_taint_vector", "f39_imports", "e25_node_bigrams", "e8_generic_metrics", "g1_taint", "g8_traces", "i1_near_clones", "k20_diff_features", "l14_changed_line_findings", "g11_route_parameters"}
    assert set(QUERIES) <= named, sorted(set(QUERIES) - named)


BRACED = {
    "java": ("class A {\n  int f(int a, int b) throws E {\n    if (a > 0 && b > 0) { return 1; }\n    else if (a < 0) { return 2; }\n    for (int i = 0; i < b; i++)\n      if (i == a) b++;\n    switch (a) { case 1: b = 2; break; default: b = 3; }\n    try { g(); } catch (E e) { b = a > 1 ? 2 : 3; }\n    run(() -> { if (a == 1) { g(); } });\n    return 0;\n  }\n}\n", 10, 12, [10, 2]),
    "javascript": ("function f(a) {\n  if (a) { return a ?? 1; }\n  const g = (x) => { while (x--) { if (x) break; } return x ? 1 : 2; };\n  return a.filter(function (y) { return y && y > 1; });\n}\nclass B { m(x) { do { x++; } while (x < 3); return /a{2}/.test(x); } }\n", 7, 10, [6, 3, 2, 2]),
    "go": ("package a\nfunc f(a int) (int, error) {\n\tif a > 0 && a < 3 {\n\t\treturn 1, nil\n\t} else if a < 0 {\n\t\treturn 2, nil\n\t}\n\tfor i := 0; i < a; i++ {\n\t\tswitch {\n\t\tcase i == 1: g()\n\t\tdefault: h()\n\t\t}\n\t}\n\tx := T{a: 1}\n\tgo func() { if a == 1 { g() } }()\n\treturn x.y, nil\n}\n", 9, 9, [9, 2]),
    "rust": ("impl A {\n  fn f(&self, a: i32) -> Option<i32> {\n    let x = if a > 1 { 2 } else { 3 };\n    match x { 1 => None, 2 | 3 if a == 1 => { Some(1) } _ => Some(2), }\n    for i in 0..a { loop { break; } }\n    let c = |y| { y + 1 };\n    while let Some(z) = g() { h::<'a>(z)?; }\n  }\n}\n", 8, 6, [8, 1]),
    "php": ("<?php\nclass A { function f($a) { if ($a) { g(); } elseif ($a > 1) { h(); } else { foreach ($a as $b) { k($b); } } return $a ? 1 : 2; # if\n} }\n", 4, 4, [4]),
    "ruby": ("class A\n  def f(a)\n    return 1 if a && a > 1\n    while a do\n      a -= 1\n    end\n    case a\n    when 1 then 2\n    when 2 then 3\n    end\n    a.each do |x|\n      puts x unless x\n    end\n  rescue E\n    nil\n  end\nend\n", 8, 4, [8, 2]),
    "c": ("int f(int a) { if (a) return 1; do { a--; } while (a); switch (a) { case 1: case 2: return 3; default: break; } return a ? 1 : 0; }\nstruct S { int x; };\nstatic int g(void)\n{\n  for (;;) { if (f(1) || f(2)) break; }\n  return 0;\n}\n", 10, 8, [7, 4]),
    "cpp": ("namespace n { template<class T> class A : public B { A(int a) : x(a), y(2) { if (a) x = 1; } int f() const { try { return 1; } catch (...) { return [&](int z) { return z; }(2); } } }; }\n", 3, 1, [2, 2]),
    "csharp": ("class A { public int P { get; set; } void F<T>(T a) where T : B { foreach (var x in a) { if (x is null || x.Y) continue; } var s = @\"if {\" + $\"{a}\"; } int G(int a) => a > 1 ? 1 : 2; }\n", 4, 5, [4]),
}


@pytest.mark.parametrize("lang", sorted(BRACED))
def test_metrics_by_language(lang):
    code, cc, cog, functions = BRACED[lang]
    m = blocks.measure(code, lang)
    assert (m.cyclomatic, m.cognitive) == (cc, cog)
    assert sorted((f[2] for f in m.functions if f[2] > 1 or lang == "rust"), reverse=True) == functions
    for cut in range(0, len(code), 7):  # broken sources are read as far as they go
        assert blocks.measure(code[:cut], lang).cyclomatic >= 1
    assert blocks.measure("", lang) == blocks.Measures()
