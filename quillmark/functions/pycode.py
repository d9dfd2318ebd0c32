"""Facts about one Python source from a single parse, in plain Python (used inside Arrow batches).

A source that does not parse gives neutral values and no findings.
"""

from __future__ import annotations

import ast
import io
import keyword
import math
import re
import sys
import tokenize
import warnings
from dataclasses import dataclass, field
from functools import lru_cache

LOOPS = (ast.For, ast.AsyncFor, ast.While)
FUNCS = (ast.FunctionDef, ast.AsyncFunctionDef)
DECISIONS = (ast.If, ast.While, ast.For, ast.ExceptHandler, ast.With, ast.Assert, ast.comprehension)


@lru_cache(maxsize=2)
def parse(source: str | None) -> ast.Module | None:
    """The tree, or None.  The last sources' trees are kept, so that analyzers called one after another share one."""
    if source is None:
        return None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def children(x: ast.AST) -> list[ast.AST]:
    """The child nodes in the order of the fields (a parsed node's attributes come in that order)."""
    out = []
    for v in x.__dict__.values():
        if v.__class__ is list:
            out += [c for c in v if isinstance(c, ast.AST)]
        elif isinstance(v, ast.AST):
            out.append(v)
    return out


_LAST: list = [None, []]  # the module walked last, and its nodes


def walk(node: ast.AST) -> list[ast.AST]:
    """All nodes, breadth first; those of the last module are kept for the next analyzer."""
    if _LAST[0] is node:
        return _LAST[1]
    out = [node]
    for x in out:  # grows
        out += children(x)
    if isinstance(node, ast.Module):
        _LAST[:] = node, out
    return out


def statements(tree: ast.Module) -> list[ast.AST]:
    """The nodes that hold statements or are one, breadth first: all functions and classes are among them."""
    out: list[ast.AST] = [tree]
    for x in out:  # grows
        for name in ("body", "handlers", "orelse", "finalbody", "cases"):
            if (v := x.__dict__.get(name)).__class__ is list:
                out += v
    return out


# ---- complexity


def cyclomatic(node: ast.AST) -> int:
    """1 + decision nodes + ternaries + operands beyond the first of each and/or."""
    n = 1
    for x in walk(node):
        if isinstance(x, DECISIONS) or isinstance(x, ast.IfExp):
            n += 1
        elif isinstance(x, ast.BoolOp):
            n += len(x.values) - 1
    return n


def cognitive(node: ast.AST) -> int:
    """Nesting-weighted control flow: structures cost 1 + depth; ternaries, and/or operands, while-else and
    direct recursion cost 1; ``with`` is free; only functions inside functions deepen."""
    total = 0
    # (node, depth, enclosing function's name, inside a function)
    todo: list[tuple[ast.AST, int, str | None, bool]] = [(node, 0, None, False)]
    while todo:
        x, depth, name, inside = todo.pop()
        if isinstance(x, FUNCS) or isinstance(x, ast.Lambda):
            depth += inside
            name, inside = getattr(x, "name", None), True
        elif isinstance(x, (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.Match)):
            total += 1 + depth
            total += isinstance(x, ast.While) and bool(x.orelse)
            depth += 1
        elif isinstance(x, ast.IfExp):
            total += 1
        elif isinstance(x, ast.BoolOp):
            total += len(x.values) - 1
        elif isinstance(x, ast.Call) and isinstance(x.func, ast.Name) and name is not None and x.func.id == name:
            total += 1
        todo += [(c, depth, name, inside) for c in children(x)]
    return total


def depth_of(node: ast.AST) -> int:
    """Deepest nesting of control structures."""
    best, todo = 0, [(node, 0)]
    while todo:
        x, d = todo.pop()
        if isinstance(x, (ast.If, ast.With, ast.AsyncWith, ast.Try, ast.Match, *LOOPS)):
            d += 1
            best = max(best, d)
        todo += [(c, d) for c in children(x)]
    return best


# ---- lines and tokens


@lru_cache(maxsize=2)
def tokens(source: str) -> list[tokenize.TokenInfo]:
    out: list[tokenize.TokenInfo] = []
    try:
        out.extend(tokenize.generate_tokens(io.StringIO(source).readline))
    except (tokenize.TokenError, SyntaxError, IndentationError):
        pass
    return out


def line_counts(source: str, tree: ast.Module | None) -> dict[str, int]:
    """total, blank, docstring, comment, sloc; a line counts once, in this order."""
    lines = source.splitlines()
    docs: set[int] = set()
    if tree is not None:
        for x in walk(tree):
            if isinstance(x, (ast.Module, ast.ClassDef, *FUNCS)) and x.body and isinstance(x.body[0], ast.Expr):
                v = x.body[0].value
                if isinstance(v, ast.Constant) and isinstance(v.value, str):
                    docs.update(range(v.lineno, v.end_lineno + 1))
    comments = {t.start[0] for t in tokens(source) if t.type == tokenize.COMMENT and not t.line[: t.start[1]].strip()}
    out = {"total": len(lines), "blank": 0, "docstring": 0, "comment": 0, "sloc": 0}
    for n, line in enumerate(lines, 1):
        out["blank" if not line.strip() else "docstring" if n in docs else "comment" if n in comments else "sloc"] += 1
    return out


def halstead(source: str) -> dict[str, float]:
    """Over tokens: keywords and operators are operators, names, strings and numbers operands."""
    ops: dict[str, int] = {}
    args: dict[str, int] = {}
    for t in tokens(source):
        if t.type == tokenize.OP or t.type == tokenize.NAME and keyword.iskeyword(t.string):
            ops[t.string] = ops.get(t.string, 0) + 1
        elif t.type in (tokenize.NAME, tokenize.STRING, tokenize.NUMBER):
            args[t.string] = args.get(t.string, 0) + 1
    n1, n2, m1, m2 = len(ops), len(args), sum(ops.values()), sum(args.values())
    volume = (m1 + m2) * math.log2(n1 + n2) if n1 + n2 else 0.0
    difficulty = n1 / 2 * m2 / n2 if n2 else 0.0
    return {"n1": n1, "n2": n2, "big_n1": m1, "big_n2": m2, "volume": volume, "difficulty": difficulty, "effort": volume * difficulty, "bugs": volume / 3000}


def code_tokens(source: str) -> list[str]:
    skip = (tokenize.COMMENT, tokenize.NL, tokenize.NEWLINE, tokenize.INDENT, tokenize.DEDENT, tokenize.ENDMARKER)
    return [t.string for t in tokens(source) if t.type not in skip]


def renamed(source: str) -> str:
    """Every name that is no keyword as VAR1, VAR2, ... in the order of first use."""
    parts = re.split(r"([A-Za-z_]\w*)", source)
    names = dict.fromkeys(parts[1::2])
    for k, w in enumerate([w for w in names if not keyword.iskeyword(w)], 1):
        names[w] = f"VAR{k}"
    parts[1::2] = [names[w] or w for w in parts[1::2]]
    return "".join(parts)


# ---- findings


@dataclass
class Issue:
    analyzer: str
    kind: str
    severity: str
    line: int
    end: int = 0
    confidence: float = 1.0


def call_name(x: ast.Call) -> str:
    f = x.func
    parts = []
    while isinstance(f, ast.Attribute):
        parts.append(f.attr)
        f = f.value
    if isinstance(f, ast.Name):
        parts.append(f.id)
    return ".".join(reversed(parts))


def is_text(x: ast.AST) -> bool:
    return isinstance(x, ast.JoinedStr) or isinstance(x, ast.Constant) and isinstance(x.value, str)


def inside(x: ast.AST) -> list[ast.AST]:
    """Nodes of a loop's body, functions defined there left out."""
    out, todo = [], [*x.body, *x.orelse]
    while todo:
        n = todo.pop()
        out.append(n)
        if not isinstance(n, FUNCS):
            todo += children(n)
    return out


def built_text(x: ast.AST) -> str | None:
    """How a string is put together at run time: concat, format or None."""
    if isinstance(x, ast.BinOp) and isinstance(x.op, ast.Add):
        return "concat"
    if isinstance(x, ast.BinOp) and isinstance(x.op, ast.Mod) and is_text(x.left):
        return "format"
    if isinstance(x, ast.JoinedStr) and any(isinstance(v, ast.FormattedValue) for v in x.values):
        return "format"
    if isinstance(x, ast.Call) and isinstance(x.func, ast.Attribute) and x.func.attr == "format":
        return "format"
    return None


# Names that rules look for.
EXPENSIVE = {"len", "sorted", "list", "dict", "set", "sum", "max", "min"}
IO = {"open", "print", "input", "read", "write", "requests.get", "requests.post"}
DB = {"execute", "query", "fetchall", "fetchone", "filter", "get"}
WEAK_HASH = {"md5": 0.85, "sha1": 0.85}
LOADERS = {"pickle.load", "pickle.loads", "marshal.load", "marshal.loads", "cPickle.loads", "dill.loads"}
SHELLS = {"os.system", "os.popen", "subprocess.call", "subprocess.run", "subprocess.Popen", "subprocess.check_output"}


def security(tree: ast.Module) -> list[Issue]:
    out = []
    add = lambda kind, sev, x, c: out.append(Issue("security", kind, sev, x.lineno, getattr(x, "end_lineno", 0) or 0, c))
    for x in walk(tree):
        if isinstance(x, ast.Call):
            name = call_name(x)
            last = name.rpartition(".")[2]
            arg = x.args[0] if x.args else None
            kw = {k.arg: k.value for k in x.keywords}
            if last in ("execute", "executemany", "raw") and arg is not None and (how := built_text(arg)):
                add("sql_injection", "critical", x, 0.92 if how == "concat" else 0.88)
            if last in WEAK_HASH:
                add("weak_crypto", "high", x, 0.95 if name.startswith("hashlib.") else WEAK_HASH[last])
            shell = kw.get("shell")
            if isinstance(shell, ast.Constant) and shell.value is True:
                add("command_injection", "critical", x, 0.90)
            elif name in SHELLS and arg is not None and built_text(arg) == "concat":
                add("command_injection", "high", x, 0.70)
            if name in LOADERS:
                add("unsafe_deserialization", "high", x, 0.88)
            if name == "yaml.load" and "Loader" not in kw and len(x.args) < 2:
                add("unsafe_deserialization", "high", x, 0.85)
        elif isinstance(x, (ast.With, ast.AsyncWith)):
            for item in x.items:
                c = item.context_expr
                if isinstance(c, ast.Call) and call_name(c) == "open" and c.args and not isinstance(c.args[0], ast.Constant):
                    add("path_traversal", "medium", x, 0.65)
    return out


def dead_code(tree: ast.Module) -> list[Issue]:
    out: list[Issue] = []
    add = lambda kind, x, sev="warning", end=None: out.append(Issue("dead_code", kind, sev, x.lineno, end or x.end_lineno))
    used = {x.id for x in walk(tree) if isinstance(x, ast.Name) and isinstance(x.ctx, ast.Load)} | {x.attr for x in walk(tree) if isinstance(x, ast.Attribute)}
    exported = {e.value for x in tree.body if isinstance(x, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in x.targets) for e in walk(x.value) if isinstance(e, ast.Constant)}
    for x in walk(tree):
        for body in (getattr(x, f, None) for f in ("body", "orelse", "finalbody")):
            if not isinstance(body, list):
                continue
            for a, b in zip(body, body[1:]):
                if isinstance(a, (ast.Return, ast.Raise, ast.Break, ast.Continue)) and not isinstance(b, ast.Pass):
                    add("unreachable_code", b, end=body[-1].end_lineno)
                    break
        if isinstance(x, (ast.Import, ast.ImportFrom)) and getattr(x, "module", "") != "__future__":
            for a in x.names:
                name = (a.asname or a.name).split(".")[0]
                if name != "*" and name not in used and name not in exported:
                    add("unused_import", x, "info")
        elif isinstance(x, ast.ExceptHandler):
            if x.type is None:
                add("bare_except", x)
            if all(isinstance(s, ast.Pass) for s in x.body):
                add("empty_except", x)
        elif isinstance(x, ast.If) and x.orelse and isinstance(x.body[-1], ast.Return) and not (len(x.orelse) == 1 and isinstance(x.orelse[0], ast.If)):
            add("redundant_else", x, "info")
        if isinstance(x, FUNCS):
            stored = {n.id: n for n in walk(x) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store)}
            loaded = {n.id for n in walk(x) if isinstance(n, ast.Name) and isinstance(n.ctx, (ast.Load, ast.Del))}
            free = {n for s in walk(x) if isinstance(s, (ast.Global, ast.Nonlocal)) for n in s.names}
            for name, n in stored.items():
                if name not in loaded and name not in free and not name.startswith("_"):
                    add("unused_variable", n, "info")
    for x in tree.body:
        if isinstance(x, FUNCS) and not x.name.startswith(("_", "test")) and not x.decorator_list and x.name not in used and x.name not in exported and x.name != "main":
            add("unused_function", x, "info")
    return out


def performance(tree: ast.Module) -> list[Issue]:
    out: list[Issue] = []
    seen: set[tuple[str, int]] = set()

    def add(kind: str, sev: str, line: int) -> None:
        if (kind, line) not in seen:
            seen.add((kind, line))
            out.append(Issue("performance", kind, sev, line, line))

    todo: list[tuple[ast.AST, int]] = [(tree, 0)]
    while todo:
        x, d = todo.pop()
        if isinstance(x, LOOPS):
            if d:
                add("nested_loops", "high" if d >= 2 else "medium", x.lineno)
            d += 1
        todo += [(c, d) for c in children(x)]
    for x in walk(tree):
        if isinstance(x, FUNCS):
            for v in [*x.args.defaults, *x.args.kw_defaults]:
                if isinstance(v, (ast.List, ast.Dict, ast.Set)):
                    add("mutable_default", "medium", x.lineno)
        if not isinstance(x, LOOPS):
            continue
        body = inside(x)
        attrs: dict[str, int] = {}
        for n in body:
            if isinstance(n, ast.Call):
                name = call_name(n)
                last = name.rpartition(".")[2]
                if name in EXPENSIVE:
                    add("call_in_loop", "medium", n.lineno)
                if name in IO or last in ("read", "write"):
                    add("io_in_loop", "high", n.lineno)
                if name.startswith("re.") and name != "re.compile":
                    add("regex_in_loop", "medium", n.lineno)
                if "." in name and last in DB:
                    add("db_query_in_loop", "high", n.lineno)
                if last == "append":
                    add("append_in_loop", "low", n.lineno)
            elif isinstance(n, ast.AugAssign) and isinstance(n.op, ast.Add) and (is_text(n.value) or isinstance(n.value, ast.Call) and call_name(n.value) == "str"):
                add("string_concat_loop", "high", n.lineno)
            elif isinstance(n, ast.Compare) and any(isinstance(o, (ast.In, ast.NotIn)) for o in n.ops) and isinstance(n.comparators[0], (ast.List, ast.Name)):
                add("membership_in_list", "medium", n.lineno)
            elif isinstance(n, ast.Attribute) and isinstance(n.value, ast.Name):
                key = f"{n.value.id}.{n.attr}"
                attrs[key] = attrs.get(key, 0) + 1
        if any(v >= 3 for v in attrs.values()):
            add("repeated_attribute", "low", x.lineno)
    return out


def refactoring(tree: ast.Module) -> list[Issue]:
    out: list[Issue] = []
    add = lambda kind, sev, line: out.append(Issue("refactoring", kind, sev, line))
    for f in (x for x in walk(tree) if isinstance(x, FUNCS)):
        size = f.end_lineno - f.lineno + 1
        if size > 40:
            add("extract_method", "critical" if size > 80 else "high", f.lineno)
        if params(f) > 4:
            add("parameter_object", "medium", f.lineno)
        if depth_of(f) > 3:
            add("reduce_nesting", "high", f.lineno)
        if any(isinstance(x, ast.BoolOp) and len(x.values) > 3 for x in walk(f)):
            add("simplify_condition", "medium", f.lineno)
        if sum(isinstance(x, ast.Return) for x in walk(f)) > 4:
            add("single_exit", "low", f.lineno)
        own = sum(isinstance(x, ast.Attribute) and isinstance(x.value, ast.Name) and x.value.id == "self" for x in walk(f))
        other: dict[str, int] = {}
        for x in walk(f):
            if isinstance(x, ast.Attribute) and isinstance(x.value, ast.Name) and x.value.id != "self":
                other[x.value.id] = other.get(x.value.id, 0) + 1
        if own and other and max(other.values()) > 2 * own and max(other.values()) >= 5:
            add("feature_envy", "medium", f.lineno)
    numbers: dict[object, int] = {}
    for x in walk(tree):
        if isinstance(x, ast.Constant) and type(x.value) in (int, float) and x.value not in (0, 1, -1, 2, 10, 100):
            numbers[x.value] = numbers.get(x.value, 0) + 1
    if sum(v >= 2 for v in numbers.values()) >= 3:
        add("magic_numbers", "low", 1)
    modules = [m for m, *_ in imports(tree)]
    for m in sorted({m for m in modules if modules.count(m) > 1}):
        add(f"duplicate_import:{m}", "low", 1)
    return out


def imports(tree: ast.Module) -> list[tuple[str, int, int, bool, bool, str]]:
    """(module, line, relative level, wildcard, inside a function, category) of each import."""
    inner = {id(x) for f in walk(tree) if isinstance(f, FUNCS) for x in walk(f)}
    out = []
    for x in walk(tree):
        if isinstance(x, ast.Import):
            rows = [(a.name, 0, False) for a in x.names]
        elif isinstance(x, ast.ImportFrom):
            rows = [(x.module or "", x.level, any(a.name == "*" for a in x.names))]
        else:
            continue
        for name, level, wild in rows:
            kind = "local" if level else "stdlib" if name.split(".")[0] in sys.stdlib_module_names else "external"
            out.append((name, x.lineno, level, wild, id(x) in inner, kind))
    return sorted(out, key=lambda r: r[1])


def dependencies(tree: ast.Module) -> list[Issue]:
    out: list[Issue] = []
    rows = imports(tree)
    if len({r[0] for r in rows}) > 10:
        out.append(Issue("dependencies", "high_fan_out", "medium", 1))
    seen: set[str] = set()
    for name, line, level, wild, inner, _ in rows:
        for cond, kind, sev in ((wild, "wildcard", "high"), (level > 2, "deep_relative", "medium"), (inner, "import_in_function", "low"), (name in seen, "duplicate_module", "low")):
            if cond:
                out.append(Issue("dependencies", kind, sev, line))
        seen.add(name)
    return out


def params(f: ast.AST) -> int:
    a = f.args
    return len([*a.posonlyargs, *a.args, *a.kwonlyargs]) + bool(a.vararg) + bool(a.kwarg)


def docstring_score(doc: str | None, n_params: int, returns: bool, raises: bool) -> int:
    """0..100 points: words, summary, parameters, return value, exceptions, example."""
    if not doc:
        return 0
    has = lambda rx: re.search(rx, doc, re.I | re.M) is not None
    points = 30 if len(doc.split()) >= 3 else 10
    points += 20 if len(doc.strip().split("\n")[0]) >= 10 else 10
    points += 25 if not n_params or has(r"^\s*(args|arguments|parameters|params)\b|:param") else 0
    points += 15 if not returns or has(r"^\s*(returns?|yields?)\b|:returns?:") else 0
    points += 5 if not raises or has(r"^\s*raises\b|:raises") else 0
    points += 5 if has(r"^\s*examples?\b|>>>") else 0
    return min(100, points)


def documentation(tree: ast.Module) -> dict[str, float]:
    """coverage, mean quality of documented public symbols, overall (70 and 30 %)."""
    scores, total = [], 0
    for x in walk(tree):
        if isinstance(x, (*FUNCS, ast.ClassDef)) and not x.name.startswith("_"):
            total += 1
            doc = ast.get_docstring(x)
            if doc:
                fn = isinstance(x, FUNCS)
                ret = fn and any(isinstance(r, ast.Return) and r.value is not None for r in walk(x))
                rai = fn and any(isinstance(r, ast.Raise) for r in walk(x))
                own = [a for a in x.args.args if a.arg not in ("self", "cls")] if fn else []
                scores.append(docstring_score(doc, len(own), ret, rai))
    cov = len(scores) / total if total else 1.0
    mean = sum(scores) / len(scores) if scores else 0.0
    return {"coverage": cov, "quality": mean, "overall": 70 * cov + 0.3 * mean}


def readability(source: str, tree: ast.Module) -> dict[str, float]:
    """naming, comments, structure, load (0..100 each) and their mean weighted .30 .20 .30 .20."""
    names = [x.arg for f in walk(tree) if isinstance(f, FUNCS) for x in f.args.args] + [x.name for x in walk(tree) if isinstance(x, (*FUNCS, ast.ClassDef))]
    bad = sum(len(n) < 3 and n not in ("i", "j", "k", "x", "y", "_", "id", "fn", "df", "db") or len(n) > 40 for n in names)
    naming = max(0.0, 100 - 100 * bad / (len(names) or 1))
    c = line_counts(source, tree)
    ratio = (c["comment"] + c["docstring"]) / (c["sloc"] or 1)
    comments = 30.0 if ratio < 0.05 else 55.0 if ratio < 0.10 else min(100.0, 60 + 100 * ratio) if ratio <= 0.5 else max(50.0, 150 - 100 * ratio)
    lines = source.splitlines()
    long_lines = sum(len(x) > 100 for x in lines) / (len(lines) or 1)
    long_funcs = sum(f.end_lineno - f.lineno >= 50 for f in walk(tree) if isinstance(f, FUNCS))
    mixed = any(x.startswith("\t") for x in lines) and any(x.startswith("    ") for x in lines)
    structure = max(0.0, 100 - 200 * long_lines - 15 * long_funcs - 20 * mixed)
    load = sum(isinstance(x, (ast.Lambda, ast.ListComp, ast.DictComp, ast.SetComp, ast.GeneratorExp, ast.IfExp, ast.BoolOp)) for x in walk(tree)) / (c["sloc"] or 1)
    cognitive_load = 100.0 if load < 0.1 else 80.0 if load < 0.2 else 60.0 if load < 0.3 else 40.0 if load < 0.4 else 20.0
    return {"naming": naming, "comments": comments, "structure": structure, "load": cognitive_load, "overall": 0.3 * naming + 0.2 * comments + 0.3 * structure + 0.2 * cognitive_load}


# ---- sequences and identifiers


def node_sequence(tree: ast.Module) -> list[str]:
    """Node types depth first; contexts and operators without content left out."""
    out, todo = [], [tree]
    while todo:
        x = todo.pop()
        if not isinstance(x, (ast.expr_context, ast.operator, ast.unaryop, ast.boolop, ast.cmpop)):
            out.append(type(x).__name__)
        todo += reversed(list(children(x)))
    return out


def node_pairs(tree: ast.Module) -> list[str]:
    return [f"{type(p).__name__}>{type(c).__name__}" for p in walk(tree) for c in children(p)]


def identifiers(tree: ast.Module) -> list[str]:
    out = []
    for x in walk(tree):
        if isinstance(x, ast.Name):
            out.append(x.id)
        elif isinstance(x, (*FUNCS, ast.ClassDef)):
            out.append(x.name)
        elif isinstance(x, ast.arg):
            out.append(x.arg)
        elif isinstance(x, ast.Attribute):
            out.append(x.attr)
    return out
