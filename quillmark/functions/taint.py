"""Flow of untrusted values in one Python tree: from sources over assignments and calls to sinks (G.1-G.7).

Each function is read in the order of its statements with a state of marks by name.  Deviations that are chosen:
after an ``if`` a name is tainted if it is after either branch, rounds over the call graph are strict, and whether a
value came through another function is kept with its name.
"""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass, field
from typing import NamedTuple

from quillmark.functions.pycode import FUNCS, children, walk

# What is untrusted, what is dangerous, how far a cleaning call is trusted, how risky an argument's form is.
SOURCE_ATTRIBUTES = set("GET POST FILES COOKIES META headers data json form args values query_string params path_params query_params body".split())
SOURCE_CALLS = set("input raw_input getenv environ recv recvfrom readline read readlines".split())
SOURCE_NAMES = set("request req query user_input user_data raw_input argv sys_argv environ env".split())
SINKS = set(
    "execute executemany executescript raw RawSQL extra system popen Popen call run check_call check_output spawn spawnl spawnlp eval exec compile "
    "__import__ execfile loads load unsafe_load Unpickler open render_string Template search query".split()
)
TRUST = {
    "parameterize": 1.0, "mogrify": 1.0, "literal": 1.0, "adapt": 1.0, "Q": 0.95, "F": 0.95, "bleach_clean": 0.92, "html_escape": 0.88, "escape_html": 0.88, "strip_tags": 0.75,
    "shlex_quote": 0.90, "quote": 0.70, "escape": 0.65, "sanitize": 0.60, "clean": 0.58, "cleanse": 0.55, "validate": 0.45, "check": 0.35, "is_valid": 0.35, "encode": 0.20,
    "replace": 0.15, "strip": 0.10, "lstrip": 0.10, "rstrip": 0.10,
}
ARGUMENT_RISK = {"constant": 0.0, "parameterized": 0.05, "variable": 0.5, "call_result": 0.4, "fstring": 0.9, "concatenation": 0.85, "format_call": 0.8, "unknown": 0.3}
PARAMETERIZED = re.compile(r"\.execute\s*\(\s*['\"].*?['\"],\s*[(\[]")
CONCATENATED = re.compile(r"[\"'].*?[\"'].*?\+\s*\w|[\"'].*?%[sd].*?[\"'].*?%")
INTERPOLATED = re.compile(r"f[\"'].*?\{[^}]+\}.*?[\"']")
TRUSTED, HOPS = 0.5, 2
VECTOR = [
    "has_source", "has_sink", "direct_flows", "unsanitized_paths", "sanitized_paths", "string_concat", "fstring", "parameterized_sql", "n_tainted_vars", "n_sinks_reached",
    "sanitizer_coverage", "risk_score", "max_trust", "branch_fraction", "interprocedural_paths", "argument_risk",
]


class Mark(NamedTuple):
    tainted: bool
    trust: float = 0.0
    across: bool = False  # came through another function


@dataclass
class Path:
    sink: str
    line: int
    source: str
    argument: str
    trust: float
    direct: bool
    across: bool

    @property
    def risk(self) -> float:
        return round(ARGUMENT_RISK[self.argument] * max(0.0, 1.0 - self.trust), 4)


@dataclass
class Flow:
    has_source: bool = False
    has_sink: bool = False
    branches: int = 0
    tainted_branches: int = 0
    paths: list[Path] = field(default_factory=list)
    concat: bool = False
    fstring: bool = False
    parameterized: bool = False

    def vector(self) -> list[float]:
        """The values of VECTOR."""
        clean = sum(p.trust >= TRUSTED for p in self.paths)
        open_ = len(self.paths) - clean
        clean = max(clean, int(self.parameterized))
        direct = sum(p.direct for p in self.paths)
        fraction = round(self.tainted_branches / self.branches, 4) if self.branches else 0.0
        if not (self.has_source and self.has_sink):
            risk = 0.1 if self.has_sink else 0.0
        else:
            risk = max([p.risk for p in self.paths] + [0.85 * self.concat, 0.8 * self.fstring, 0.9 * (direct > 0)])
            risk = max(0.0, risk - 0.2 * self.parameterized)
            risk = round(min(1.0, risk * (0.5 + 0.5 * fraction) if fraction else risk), 4)
        mean = round(sum(p.risk for p in self.paths) / len(self.paths), 4) if self.paths else 0.0
        names, sinks = {p.source for p in self.paths} - {"unknown"}, {p.sink for p in self.paths}
        return [float(x) for x in (
            self.has_source, self.has_sink, direct, open_, clean, self.concat, self.fstring, self.parameterized, len(names), len(sinks),
            clean / (clean + open_) if clean + open_ else 0.0, risk, max((p.trust for p in self.paths), default=0.0), fraction, sum(p.across for p in self.paths), mean,
        )]


def called(x: ast.AST) -> str | None:
    """The last name of what a call calls."""
    f = x.func if isinstance(x, ast.Call) else None
    return f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None


def argument_kind(x: ast.expr) -> str:
    """G.3: the form of a sink's argument."""
    if isinstance(x, ast.JoinedStr):
        return "fstring" if any(isinstance(v, ast.FormattedValue) for v in x.values) else "constant"
    if isinstance(x, ast.BinOp) and isinstance(x.op, (ast.Add, ast.Mod)):
        return "concatenation" if isinstance(x.op, ast.Add) else "format_call"
    if isinstance(x, ast.Call):
        return "format_call" if isinstance(x.func, ast.Attribute) and x.func.attr in ("format", "format_map") else "call_result"
    return "constant" if isinstance(x, ast.Constant) else "variable" if isinstance(x, (ast.Name, ast.Subscript)) else "unknown"


def givers(tree: ast.Module) -> set[str]:
    """G.2: functions that return what a source gives, and those that call one of them within ``HOPS`` steps."""
    calls: dict[str, set[str]] = {}
    found: set[str] = set()
    for f in walk(tree):
        if isinstance(f, FUNCS):
            inner = walk(f)
            calls[f.name] = {c for x in inner if (c := called(x))}
            returned = [y for x in inner if isinstance(x, ast.Return) and x.value for y in walk(x.value)]
            if any(
                isinstance(y, ast.Attribute) and y.attr in SOURCE_ATTRIBUTES or isinstance(y, ast.Name) and y.id in SOURCE_NAMES or isinstance(y, ast.Call) and isinstance(y.func, ast.Name) and y.func.id in SOURCE_CALLS
                for y in returned
            ):
                found.add(f.name)
    for _ in range(HOPS):
        found = found | {f for f, c in calls.items() if c & found}
    return found


class Reader:
    def __init__(self, given: set[str]):
        self.given, self.state, self.flow = given, {}, Flow()

    def source(self, x: ast.expr) -> Mark | None:
        """The mark of an expression that is a source itself."""
        base = x.func if isinstance(x, ast.Call) else x.value if isinstance(x, ast.Subscript) else x
        if isinstance(x, ast.Call):
            if isinstance(base, ast.Name):
                return Mark(True) if base.id in SOURCE_CALLS else Mark(True, across=True) if base.id in self.given else None
            owner = base.value if isinstance(base, ast.Attribute) else None
            if isinstance(owner, ast.Attribute):
                is_environ = owner.attr == "environ" and isinstance(owner.value, ast.Name) and owner.value.id == "os"
                return Mark(True) if owner.attr in SOURCE_ATTRIBUTES or is_environ else None
            if isinstance(owner, ast.Name):
                return Mark(True) if owner.id in SOURCE_NAMES else Mark(True, across=True) if base.attr in self.given else None
            return None
        if isinstance(x, ast.Subscript) and isinstance(base, ast.Attribute):
            return Mark(True) if base.attr in SOURCE_ATTRIBUTES else None
        return Mark(True) if isinstance(base, ast.Name) and base.id in SOURCE_NAMES else None

    def tainted(self, x: ast.expr) -> list[Mark]:
        return [m for y in walk(x) if isinstance(y, ast.Name) and (m := self.state.get(y.id)) and m.tainted]

    def assign(self, names: list[str], value: ast.expr) -> None:
        marks = self.tainted(value)
        if found := self.source(value):
            self.flow.has_source = True
        for n in names:
            old = self.state.get(n, Mark(False))
            if found:
                self.state[n] = found
            elif (name := called(value)) in TRUST:  # full trust clears a name, little trust is noted with it
                self.state[n] = Mark(old.tainted and TRUST[name] < TRUSTED, TRUST[name], old.across)
            elif marks:
                self.state[n] = Mark(True, 0.0, any(m.across for m in marks))

    def call(self, x: ast.Call) -> None:
        name = called(x)
        if name not in SINKS:
            return
        self.flow.has_sink = True
        hit = [a for a in [*x.args, *(k.value for k in x.keywords)] if self.tainted(a)]
        if not hit:
            return
        names = [self.state[a.id] for a in hit if isinstance(a, ast.Name)]
        trust = max([m.trust for m in names] + [TRUST.get(called(a) or "", 0.0) for a in hit])
        source = next((a.id for a in hit if isinstance(a, ast.Name)), "unknown")
        self.flow.paths.append(Path(name, x.lineno, source, argument_kind(hit[0]), trust, bool(names), any(m.across for m in names)))

    def read(self, x: ast.AST) -> None:
        if isinstance(x, ast.If):
            self.branch(x)
            return
        if isinstance(x, ast.Assign):
            for t in x.targets:
                self.assign([e.id for e in (t.elts if isinstance(t, (ast.Tuple, ast.List)) else [t]) if isinstance(e, ast.Name)], x.value)
        elif isinstance(x, ast.AugAssign) and isinstance(x.target, ast.Name) and (marks := self.tainted(x.value)):
            self.state[x.target.id] = Mark(True, 0.0, any(m.across for m in marks))
        elif isinstance(x, ast.Call):
            self.call(x)
        for c in children(x):
            self.read(c)

    def branch(self, x: ast.If) -> None:
        before, after = self.state, dict(self.state)
        for body in filter(None, (x.body, x.orelse)):
            self.state, known = dict(before), len(self.flow.paths)
            for s in body:
                self.read(s)
            self.flow.branches += 1
            self.flow.tainted_branches += len(self.flow.paths) > known
            for n, m in self.state.items():
                old = after.get(n)
                after[n] = m if old is None or m.tainted >= old.tainted else old
        self.state = after


def analyse(source: str, tree: ast.Module) -> Flow:
    """All functions of a file, or the file itself where it has none."""
    given, total = givers(tree), Flow(concat=bool(CONCATENATED.search(source)), fstring=bool(INTERPOLATED.search(source)), parameterized=bool(PARAMETERIZED.search(source)))
    for f in [x for x in walk(tree) if isinstance(x, FUNCS)] or [tree]:
        r = Reader(given)
        r.read(f)
        total.has_source |= r.flow.has_source
        total.has_sink |= r.flow.has_sink
        total.branches += r.flow.branches
        total.tainted_branches += r.flow.tainted_branches
        total.paths += r.flow.paths
    return total
