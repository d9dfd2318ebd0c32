"""Code-structure operators: one parse a row inside Arrow batches, typed rows out (E, F, G and parts of D)."""

from __future__ import annotations

import ast
import hashlib
import re
import sys
import textwrap
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.functions import blocks, context, taint
from quillmark.functions import pycode as P
from quillmark.functions import text as T
from quillmark.functions.normalize import language
from quillmark.operators.clones import near_clones
from quillmark.operators.text_metrics import files
from quillmark.sources.tables import spread

_ARROW = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}


def per_source(df: DataFrame, schema: str, rows: Callable[[str], list[tuple]]) -> DataFrame:
    """file_id and the columns of ``schema`` for every row that ``rows`` gives of a file's code (null code: none)."""
    cols = [c.strip().split(" ") for c in schema.split(",")]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids, out = [], []
            for i, code in zip(part.column("file_id").to_pylist(), part.column("code").to_pylist()):
                if code is not None:
                    found = rows(code)
                    ids += [i] * len(found)
                    out += found
            arrays = [pa.array(ids, pa.int64())] + [pa.array([r[k] for r in out], _ARROW[t]) for k, (_, t) in enumerate(cols)]
            yield pa.RecordBatch.from_arrays(arrays, names=["file_id", *(n for n, _ in cols)])

    return spread(df.select("file_id", "code").where("code is not null")).mapInArrow(run, f"file_id long, {schema}")


def python_files(spark, sf_dir) -> DataFrame:
    f = files(spark, sf_dir)
    return f.where(language(F.col("language"), F.col("path")) == "python")


METRICS = (
    "parse_ok boolean, cyclomatic long, cognitive long, max_cyclomatic long, avg_cyclomatic double, total long, sloc long, comment long, blank long, docstring long, "
    "volume double, difficulty double, effort double, bugs double, n_functions long, n_classes long, n_long long, n_complex long, depth long, n_calls long, n_imports long, n_try long"
)


def metrics_of(code: str) -> list[tuple]:
    """E.1-E.7, E.20-E.22, D.1, D.8: the bundle of one source; a source that does not parse has complexity 1 and 0."""
    tree = P.parse(code)
    n, h = P.line_counts(code, tree), P.halstead(code)
    if tree is None:
        return [(False, 1, 0, 0, 0.0, n["total"], n["sloc"], n["comment"], n["blank"], 0, h["volume"], h["difficulty"], h["effort"], h["bugs"], 0, 0, 0, 0, 0, 0, 0, 0)]
    kinds = Counter(map(type, P.walk(tree)))
    funcs = [x for x in P.walk(tree) if isinstance(x, P.FUNCS)]
    cc = [P.cyclomatic(f) for f in funcs]
    return [(
        True, P.cyclomatic(tree), P.cognitive(tree), max(cc, default=0), sum(cc) / len(cc) if cc else 0.0, n["total"], n["sloc"], n["comment"], n["blank"], n["docstring"],
        h["volume"], h["difficulty"], h["effort"], h["bugs"], len(funcs), kinds[ast.ClassDef], sum(f.end_lineno - f.lineno >= 50 for f in funcs), sum(c > 10 for c in cc),
        P.depth_of(tree), kinds[ast.Call], kinds[ast.Import] + kinds[ast.ImportFrom], kinds[ast.Try],
    )]


def e5_metrics(spark, sf_dir):
    return per_source(python_files(spark, sf_dir), METRICS, metrics_of)


def functions_of(code: str) -> list[tuple]:
    """E.2, E.28, E.29, E.31, E.32, D.26: each function with its measures and smells."""
    tree = P.parse(code)
    out = []
    for f in P.walk(tree) if tree else ():
        if isinstance(f, P.FUNCS):
            cc, cog, size, n = P.cyclomatic(f), P.cognitive(f), f.end_lineno - f.lineno + 1, P.params(f)
            smells = [s for s, hit in (("long_method", size > 30), ("long_parameter_list", n > 4), ("complex_method", cc > 10), ("deep_nesting", P.depth_of(f) > 3)) if hit]
            grade = "A" if cog <= 5 else "B" if cog <= 10 else "C" if cog <= 20 else "D" if cog <= 40 else "F"
            out.append((f.name, f.lineno, f.end_lineno, cc, cog, size, n, grade, smells))
    return out


FUNCTIONS = "name string, start_line long, end_line long, cyclomatic long, cognitive long, n_lines long, n_params long, grade string, smells array<string>"


def e29_functions(spark, sf_dir):
    return per_source(python_files(spark, sf_dir), FUNCTIONS, functions_of)


def issues_of(code: str) -> list[tuple]:
    """F.1, F.2, F.18-F.37, F.41: findings of all analyzers in long form; none for a source that does not parse."""
    tree = P.parse(code)
    if tree is None:
        return []
    found = [*P.security(tree), *P.dead_code(tree), *P.performance(tree), *P.refactoring(tree), *P.dependencies(tree)]
    first: dict[tuple, P.Issue] = {}
    for i in found:
        first.setdefault((i.analyzer, i.kind, i.line), i)
    return [(i.analyzer, i.kind, i.severity, i.line, max(i.line, i.end), i.confidence) for i in first.values()]


ISSUES = "analyzer string, kind string, severity string, line long, end_line long, confidence double"


def f18_issues(spark, sf_dir):
    return per_source(python_files(spark, sf_dir), ISSUES, issues_of)


def f34_hotspots(spark, sf_dir):
    """F.34, F.38, F.42, F.18: per file and analyzer the counts by severity and the capped score 20h + 10m + 5l, and the share of dead lines."""
    f = python_files(spark, sf_dir)
    g = per_source(f, ISSUES, issues_of).groupBy("file_id", "analyzer").agg(
        F.count_if(F.col("severity").isin("critical", "high")).alias("high"), F.count_if(F.col("severity").isin("medium", "warning")).alias("medium"), F.count_if(F.col("severity").isin("low", "info")).alias("low"),
        F.sum(F.when(F.col("kind") == "unreachable_code", F.col("end_line") - F.col("line") + 1).otherwise(0)).alias("dead_lines"),
    )
    n = f.where("code is not null").select("file_id", F.size(T.lines(F.col("code"))).alias("n_lines"))
    return g.join(n, "file_id").select("file_id", "analyzer", "high", "medium", "low", F.least(F.lit(100), 20 * F.col("high") + 10 * F.col("medium") + 5 * F.col("low")).alias("score"), F.round(F.try_divide("dead_lines", "n_lines"), 6).alias("dead_ratio"))


def imports_of(code: str) -> list[tuple]:
    tree = P.parse(code)
    return [(*r,) for r in P.imports(tree)] if tree else []


def f39_imports(spark, sf_dir):
    """F.39, F.40: each import with its category."""
    return per_source(python_files(spark, sf_dir), "module string, line long, level long, wildcard boolean, in_function boolean, category string", imports_of)


def f43_coupling(spark, sf_dir):
    """F.43: distinct modules by category and instability min(1, 1.2 external / fan-out)."""
    i = f39_imports(spark, sf_dir)
    kind = lambda k: F.countDistinct(F.when(F.col("category") == k, F.col("module"))).alias(k)
    g = i.groupBy("file_id").agg(kind("stdlib"), kind("external"), kind("local"), F.countDistinct("module").alias("fan_out"))
    return g.withColumn("instability", F.round(F.least(F.lit(1.0), 1.2 * F.col("external") / F.col("fan_out")), 6))


def quality_of(code: str) -> list[tuple]:
    tree = P.parse(code)
    if tree is None:
        return []
    d, r = P.documentation(tree), P.readability(code, tree)
    grade = "A" if d["overall"] >= 90 else "B" if d["overall"] >= 75 else "C" if d["overall"] >= 60 else "D" if d["overall"] >= 40 else "F"
    hints = [n for n, v in sorted(((k, v) for k, v in r.items() if k != "overall" and v < 80), key=lambda t: (t[1], t[0]))[:3]]
    return [(d["coverage"], d["quality"], d["overall"], grade, r["naming"], r["comments"], r["structure"], r["load"], r["overall"], hints)]


def f45_quality(spark, sf_dir):
    """F.44-F.50, D.27: documentation and readability of each file that parses."""
    return per_source(python_files(spark, sf_dir), "doc_coverage double, doc_quality double, doc_overall double, doc_grade string, naming double, comments double, structure double, load double, readability double, hints array<string>", quality_of)


def _flow(code: str) -> taint.Flow | None:
    return taint.analyse(code, t) if (t := P.parse(code)) else None


PATHS = "sink string, line long, source string, argument string, trust double, direct boolean, across boolean, risk double"


def paths_of(code: str) -> list[tuple]:
    flow = _flow(code)
    return [(p.sink, p.line, p.source, p.argument, p.trust, p.direct, p.across, p.risk) for p in flow.paths] if flow else []


def g1_taint(spark, sf_dir):
    """G.1, G.3, G.4, G.7: the paths on which untrusted values reach a sink, with their risk."""
    return per_source(python_files(spark, sf_dir), PATHS, paths_of)


def g5_taint_vector(spark, sf_dir):
    """G.5, G.6: the 16 values of each file that parses, its risk score among them."""
    names = ", ".join(f"{n} double" for n in taint.VECTOR)
    return per_source(python_files(spark, sf_dir), names, lambda c: [tuple(f.vector())] if (f := _flow(c)) else [])


def g8_traces(spark, sf_dir):
    """G.8, G.11, G.12: of each call's first argument that is a name the expressions it was assigned (latest first, plain
    names followed) and how the enclosing function takes it."""
    return per_source(files(spark, sf_dir), "line long, name string, traces array<string>, parameter string", context.arguments)


def fragments_of(code: str) -> list[tuple]:
    """E.30: functions and classes of six lines and more that are not blank: name, first and last line, dedented text,
    fingerprint of the text without comments, fingerprint with renamed identifiers."""
    tree, out = P.parse(code), []
    lines = code.splitlines()
    for x in P.statements(tree) if tree else ():
        if isinstance(x, (*P.FUNCS, ast.ClassDef)):
            text = textwrap.dedent("\n".join(lines[x.lineno - 1 : x.end_lineno]))
            if len(text.strip().splitlines()) >= LEAST_FRAGMENT:
                bare = " ".join(" ".join(s.split("#")[0].rstrip() for s in text.split("\n")).split())
                out.append((x.name, x.lineno, x.end_lineno, text, hashlib.md5(bare.encode()).hexdigest(), " ".join(P.renamed(bare).split())))
    return out


def i1_near_clones(spark, sf_dir):
    """I.1: clones of types 1 to 4 of the functions and classes of every file whose id is divisible by 20, among all."""
    fragments = per_source(python_files(spark, sf_dir), FRAGMENTS, fragments_of)
    return near_clones(fragments, F.col("file_id") % 20 == 0)


FRAGMENTS = "name string, start_line long, end_line long, text string, fp string, renamed string"
LEAST_FRAGMENT = 6


def e25_node_bigrams(spark, sf_dir, k: int = 50):
    """E.25: the commonest (parent, child) node types; counted within each batch first."""
    rows = per_source(python_files(spark, sf_dir), "pair string, n long", lambda c: list(_count(P.node_pairs(t)).items()) if (t := P.parse(c)) else [])
    return rows.groupBy("pair").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "pair").limit(k)


def _count(items: list[str]) -> dict[str, int]:
    out: dict[str, int] = {}
    for x in items:
        out[x] = out.get(x, 0) + 1
    return out


def e26_sequences(spark, sf_dir):
    """E.26, N.10: node-type sequence and identifiers of each file that parses."""
    return per_source(python_files(spark, sf_dir), "nodes array<string>, names array<string>", lambda c: [(P.node_sequence(t), P.identifiers(t))] if (t := P.parse(c)) else [])


# Vocabularies of the identifier features.
VOCABULARY = {
    "source": ["input", "request", "args", "form", "param", "query", "environ", "argv"], "sink": ["exec", "eval", "execute", "system", "popen", "open", "render"],
    "sanitizer": ["escape", "quote", "clean", "validate", "sanitize", "strip"], "secret": ["password", "secret", "token", "key", "credential", "auth"],
}


def e23_identifier_features(spark, sf_dir):
    """E.23, E.24: share and presence of vocabulary words among the identifiers' sub-tokens."""
    s = e26_sequences(spark, sf_dir).select("file_id", F.explode_outer("names").alias("name")).select("file_id", F.explode_outer(T.sub_tokens(F.col("name"))).alias("w"))
    aggs = []
    for k, ws in VOCABULARY.items():
        hit = F.count_if(F.col("w").isin(ws))
        aggs += [F.round(F.try_divide(hit, F.count("w")), 6).alias(f"{k}_share"), (hit > 0).alias(f"has_{k}")]
    return s.groupBy("file_id").agg(*aggs)


def d14_renamed(spark, sf_dir):
    """D.14, D.17: fingerprint after renaming identifiers by first use, and the number of tokens."""
    return per_source(python_files(spark, sf_dir), "renamed string, n_tokens long", lambda c: [(P.renamed(c), len(P.code_tokens(c)))]).select("file_id", F.md5(T.squeeze(F.col("renamed"))).alias("fingerprint"), "n_tokens")


def g15_purpose(spark, sf_dir):
    """G.15: layer of a file by its imports, first match wins."""
    m = f39_imports(spark, sf_dir).groupBy("file_id").agg(F.collect_set(F.split_part("module", F.lit("."), F.lit(1))).alias("mods"))
    any_of = lambda *w: F.arrays_overlap("mods", F.array(*map(F.lit, w)))
    layer = F.when(any_of("pytest", "unittest"), "test").when(any_of("flask", "fastapi", "django"), "web").when(any_of("sqlalchemy", "sqlite3", "psycopg2"), "data").when(any_of("subprocess", "os", "shutil"), "system").otherwise("general")
    return m.select("file_id", layer.alias("layer"))


# ---- other languages: tokens and nested statements (functions.blocks)

_MARKS = {lang: (("//", "#") if lang == "php" else ("#",) if lang == "ruby" else ("//",), ("=begin", "=end") if lang == "ruby" else ("/*", "*/")) for lang in blocks.LANGUAGES}
CALLS = 1_000_000  # nested calls of the reader, from Python to Python: frames on the heap


def line_kinds(code: str, lang: str) -> tuple[int, int, int]:
    """D.3-D.5: (source lines, comment lines, blank lines); a line is what it begins with."""
    marks, (begin, end) = _MARKS[lang]
    sloc = comment = blank = 0
    open_block = False
    for line in code.splitlines():
        s = line.strip()
        if not s:
            blank += 1
        elif open_block:
            comment += 1
            open_block = end not in s
        elif s.startswith(begin):
            comment += 1
            open_block = end not in s[len(begin) :]
        elif s.startswith(marks):
            comment += 1
        else:
            sloc += 1
    return sloc, comment, blank


def generic_of(code: str, lang: str) -> tuple:
    """E.8-E.19: line_kinds, then cyclomatic, cognitive, depth, types, functions, their greatest and mean complexity, long
    (over 50 lines) and complex (over 10) ones."""
    sys.setrecursionlimit(max(CALLS, sys.getrecursionlimit()))
    m = blocks.measure(code, lang)
    cc = [f[2] for f in m.functions]
    return (
        *line_kinds(code, lang), m.cyclomatic, m.cognitive, m.depth, m.n_types, len(cc), max(cc, default=0), sum(cc) / len(cc) if cc else 0.0,
        sum(last - first >= 50 for first, last, _ in m.functions), sum(c > 10 for c in cc),
    )


GENERIC = (
    "lang string, sloc long, comment long, blank long, cyclomatic long, cognitive long, depth long, n_types long, n_functions long, "
    "max_cyclomatic long, avg_cyclomatic double, n_long long, n_complex long"
)


def e8_generic_metrics(spark, sf_dir):
    """Metrics of the files in a language of blocks.LANGUAGES; null sources give none, an empty one the values of no line."""
    f = files(spark, sf_dir).withColumn("lang", language(F.col("language"), F.col("path"))).where(F.col("lang").isin(sorted(blocks.LANGUAGES)) & F.col("code").isNotNull())
    packed = f.select("file_id", F.concat_ws("\n", "lang", "code").alias("code"))
    return per_source(packed, GENERIC, lambda c: [(c.partition("\n")[0], *generic_of(c.partition("\n")[2], c.partition("\n")[0]))])


QUERIES = {k: f for k, f in list(globals().items()) if re.match(r"[defgi]\d+_", k)}
