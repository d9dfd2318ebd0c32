"""Where the value of a call's argument comes from, by the lines of a source (G.8, G.9, G.11, G.12)."""

from __future__ import annotations

import re
from bisect import bisect_right

BACK, DEPTH = 80, 8
_ASSIGN = re.compile(r"^\s*((?:\w+\s*,\s*)*\w+)\s*(?::\s*\S+)?\s*=(?!=)\s*(.+)$")
_ARGUMENT = re.compile(r"\w\(\s*([A-Za-z_]\w*)\s*[,)]")
_DEF = re.compile(r"\s*(?:async\s+)?def\s+\w+\s*\(")
_ROUTE = re.compile(r"@\w+\.route\(")
_METHOD = re.compile(r"@\w+\.(?:get|post|put|delete|patch)\(")
_KIND = r"\s*:\s*\S+\s*=\s*(Query|Path|Body|Form|Header|Cookie)\("
_USER = re.compile(r"\b(?:request|req|user_\w+|client_\w+|payload|body|data|query|expr|formula|cmd|command|raw_\w+|untrusted)\b")


class Lines:
    """A source's lines with their assignments by name."""

    def __init__(self, code: str):
        self.lines = code.splitlines()
        self.assigned: dict[str, list[tuple[int, str]]] = {}
        self.defs = [i for i, s in enumerate(self.lines, 1) if _DEF.match(s)]
        for i, s in enumerate(self.lines, 1):
            if "=" in s and (m := _ASSIGN.match(s)):
                for n in m.group(1).split(","):
                    self.assigned.setdefault(n.strip(), []).append((i, m.group(2).strip()))

    def trace(self, name: str, line: int, depth: int = DEPTH) -> list[str]:
        """G.8: right-hand sides assigned to ``name`` in the ``BACK`` lines up to ``line``, latest first, at most ``depth``;
        one that is a name is followed from the line above it."""
        out: list[str] = []
        here = self.assigned.get(name, []) if name not in ("None", "True", "False") else []
        for at, value in reversed(here[: bisect_right(here, (line + 1,))]):
            if at <= line - BACK or len(out) >= depth:
                break
            out.append(value)
            if re.fullmatch(r"\w+", value) and value != name and len(out) < depth:
                out += self.trace(value, at - 1, depth - len(out))
        return out

    def _block(self, at: int, most: int) -> str:
        """The lines from ``at`` to where its parentheses close."""
        out, depth = [], 0
        for s in self.lines[at - 1 : at - 1 + most]:
            out.append(s)
            depth += s.count("(") - s.count(")")
            if depth <= 0:
                break
        return " ".join(out)

    def parameter(self, name: str, line: int) -> str:
        """G.12, G.11: how the nearest function that begins above ``line`` takes ``name``: as route_parameter,
        user_parameter (by its name), parameter, or not (none)."""
        k = bisect_right(self.defs, line)
        if not k:
            return "none"
        at, word = self.defs[k - 1], rf"\b{re.escape(name)}\b"
        head = self._block(at, 10)
        if not re.search(word, head):
            return "none"
        above = self.lines[max(0, at - 9) : at - 1]
        route = any(_ROUTE.search(s) and re.search(rf"<(?:\w+:)?{re.escape(name)}>", s) or _METHOD.search(s) and "{" + name + "}" in s for s in above)
        head = self._block(at, 15)
        if route or re.search(word + _KIND, head) or re.search(r"def\s+\w+\s*\(\s*request\s*,", head):
            return "route_parameter"
        return "user_parameter" if _USER.search(name) else "parameter"


def arguments(code: str) -> list[tuple[int, str, list[str], str]]:
    """(line, name, trace, parameter) of each call's first argument that is a plain name, once a line and name."""
    x = Lines(code)
    found = dict.fromkeys((i, n) for i, s in enumerate(x.lines, 1) if not _DEF.match(s) for n in _ARGUMENT.findall(s))
    return [(i, n, x.trace(n, i), x.parameter(n, i)) for i, n in found]
