"""JSON by recursive descent; YAML by its block structure, with flow collections by recursive descent."""

from __future__ import annotations

import re
from bisect import bisect_left

from quillmark.llm.syntax.base import Fault

_JSON = re.compile(
    r"[ \t\n\r]*(?:(?P<s>\"(?:[^\"\\\x00-\x1f]|\\(?:[\"\\/bfnrt]|u[0-9a-fA-F]{4}))*\")|(?P<n>-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?)(?![\w.])|"
    r"(?P<w>true|false|null)(?!\w)|(?P<p>[{}\[\],:])|(?P<e>\Z)|(?P<x>[\s\S]))"
)


_BROKEN = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?|[^\s{}\[\],:\"']+|[\s\S]")


def check_json(source: str) -> list[Fault]:
    """All faults of a JSON text, in order; none for a valid or empty one.  After a fault, on with the next comma,
    bracket or entry."""
    if not source:
        return []
    kinds, at = [], []
    i = 0
    while not kinds or kinds[-1] != "\0":
        m = _JSON.match(source, i)
        what = m.lastgroup
        i = m.end() - len(m.group(what))
        kinds.append(m.group("p") if what == "p" else {"s": "s", "n": "0", "w": "0", "e": "\0", "x": "?"}[what])
        at.append(i)
        i = _BROKEN.match(source, i).end() if what == "x" else m.end()
    k = "".join(kinds) + "\0"
    found: list[tuple[int, str]] = []
    # a stack instead of recursion, so that deep nesting is no fault
    stack: list[str] = []
    p, state = 0, "value"
    while True:
        c = k[p]
        good = True
        if state in ("value", "value or ]"):
            if c == "{":
                stack.append("{")
                state = "key or }"
            elif c == "[":
                stack.append("[")
                state = "value or ]"
            elif c in "s0":
                state = "end"
            elif c == "]" and state == "value or ]":
                stack.pop()
                state = "end"
            else:
                good = False
        elif state in ("key", "key or }"):
            if c == "s" and k[p + 1] == ":":
                p += 1
                state = "value"
            elif c == "}" and state == "key or }":
                stack.pop()
                state = "end"
            else:
                good = False
        elif not stack:
            if c == "\0":
                break
            good = False
        elif c == ",":
            state = "key" if stack[-1] == "{" else "value"
        elif c == ("}" if stack[-1] == "{" else "]"):
            stack.pop()
        else:
            good = False
        if good:
            p += 1
            continue
        found.append((at[p], f"expected {state}"))
        p, state = _resume(k, p, state, stack)
        if k[p] == "\0":
            break
    breaks = [m.start() for m in re.finditer("\n", source)] if found else []
    return [Fault(bisect_left(breaks, x) + 1, message) for x, message in found]


def _resume(k: str, p: int, state: str, stack: list[str]) -> tuple[int, str]:
    """Where and in which state to go on after a fault at ``p``; brackets left open are taken off the stack."""
    if state in ("key", "key or }") and k[p] in "?0" and k[p + 1] == ":":
        return p + 2, "value"
    while True:
        c = k[p]
        if c in "{[\0":
            return p, "value"
        if c in "s?" and k[p + 1] == ":" and stack and stack[-1] == "{" and state == "end":
            return p, "key"
        if c in "s0" and state == "end" and (not stack or stack[-1] == "["):
            return p, "value"
        if c == "," and stack:
            return p, "end"
        if c in "]}" and ("[" if c == "]" else "{") in stack:
            while stack.pop() != ("[" if c == "]" else "{"):
                pass
            return p + 1, "end"
        p += 1


_KEY = re.compile(r"(?:(?P<q>\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*')|(?P<p>(?:[^\s\-?:,\[\]{}#&*!|>'\"%@`]|[\-?:](?=\S))(?:[^:#\n]|:(?=\S)|(?<=\S)#)*?))[ \t]*:(?=[ \t]|$)")
_PROPS = re.compile(r"(?:[&!][^\s,\[\]{}]*[ \t]+|[&!][^\s,\[\]{}]*$)+")
_BLOCK = re.compile(r"[|>](?:[+-]?[1-9]?|[1-9][+-]?)[ \t]*(?:#.*)?$")


class _Yaml:
    def __init__(self, source: str):
        self.lines = source.lstrip("﻿").split("\n")
        self.i = 0
        self.faults: list[Fault] = []
        self.anchors: set[str] = set()

    def say(self, message: str, line: int | None = None) -> None:
        self.faults.append(Fault((self.i if line is None else line) + 1, message))

    def run(self) -> list[Fault]:
        # each open collection: its indent, its kind (map, seq or "" not known yet)
        stack: list[list] = [[-1, "doc"]]
        expects = -1  # the indent below which a nested value must not stand, or -1
        done = False  # the document's root is a finished scalar or flow collection
        while self.i < len(self.lines):
            raw = self.lines[self.i].rstrip("\r")
            text = raw.strip(" \t")
            if not text or text[0] == "#":
                self.i += 1
                continue
            if re.match(r"(?:---|\.\.\.)(?:\s|$)", raw):
                stack, done = [[-1, "doc"]], False
                rest = raw[3:].strip()
                if raw[0] == "-" and rest and not rest.startswith("#"):
                    self.lines[self.i] = "    " + rest if not _KEY.match(rest) else rest
                    if _KEY.match(rest):
                        self.say("a mapping cannot begin on the line of ---")
                    continue
                self.i += 1
                continue
            if raw[0] == "%" and stack == [[-1, "doc"]]:
                self.i += 1
                continue
            indent = len(raw) - len(raw.lstrip(" "))
            if raw[indent : indent + 1] == "\t":
                self.say("a tab cannot begin an indent")
                self.i += 1
                continue
            if done:
                self.say("more than one root value")
                while self.i < len(self.lines) and not re.match(r"(?:---|\.\.\.)(?:\s|$)", self.lines[self.i]):
                    self.i += 1
                continue
            while len(stack) > 1 and stack[-1][0] > indent:
                stack.pop()
            begun = self.i
            if not self.entry(stack, indent, text, indent):
                self.resume(begun, stack, indent)
                continue
            if len(stack) == 1:
                done = True
        return self.faults

    def resume(self, begun: int, stack: list[list], indent: int) -> None:
        """On with the next entry that is not nested in the one with a fault, which begins at line ``begun``; the
        others of a level that has no place here belong to the same fault."""
        while len(stack) > 1 and stack[-1][0] > indent:
            stack.pop()
        deeper = indent + (stack[-1][0] == indent)
        # a scalar without end stops at a line that may be an entry
        self.i = max(begun + 1, self.i + (self.faults[-1].line == self.i + 1))
        while self.i < len(self.lines):
            line = self.lines[self.i].rstrip("\r")
            if line.strip() and len(line) - len(line.lstrip(" ")) < deeper or re.match(r"(?:---|\.\.\.)(?:\s|$)", line):
                break
            self.i += 1

    def entry(self, stack: list[list], indent: int, text: str, column: int) -> bool:
        """One entry ``text`` that stands at ``column``; nested ones on the same line too."""
        props = _PROPS.match(text)
        if props and not text.startswith("!<"):
            column += props.end()
            text = text[props.end() :].strip()
            if not text:
                self.i += 1
                return True
        top = stack[-1]
        if re.match(r"-(?:[ \t]|$)", text):
            if top[0] < column and top[1] != "open" and len(stack) > 1 and not top[1].endswith("?"):
                self.say("a sequence cannot begin here")
                return False
            if top[0] == column and top[1] == "map?" or top[0] < column:
                if top[0] == column:
                    top[1] = "map"
                elif top[1].endswith("?"):
                    top[1] = top[1][:-1]
                stack.append([column, "seq"])
            elif top[0] == column and top[1] not in ("seq", "seq?"):
                if top[1] == "map" and len(stack) > 1:
                    self.say("a sequence entry between entries of a mapping")
                    return False
            # a sequence may stand at its key's indent
            while stack[-1][0] == column and stack[-1][1].rstrip("?") != "seq":
                self.say("a sequence entry between entries of a mapping")
                return False
            top = stack[-1]
            rest = text[1:].lstrip(" \t")
            if not rest or rest.startswith("#"):
                top[1] = "seq?"
                self.i += 1
                return True
            top[1] = "seq?"
            inner = column + len(text) - len(rest)
            if re.match(r"-(?:[ \t]|$)", rest) or _KEY.match(rest) or rest.startswith(("&", "!")):
                return self.entry(stack, indent, rest, inner)
            top[1] = "seq"
            return self.value(rest, column, inner)
        if text.startswith("? ") or text == "?":
            if top[0] < column:
                stack.append([column, "map"])
            stack[-1][1] = "map?"
            self.i += 1
            return True
        m = _KEY.match(text) if not text.startswith(": ") and text != ":" else re.match(r":", text)
        if m:
            if top[0] == column and top[1].rstrip("?") == "seq":
                # back from a sequence that stands at its key's indent
                stack.pop()
                top = stack[-1]
                if top[0] != column:
                    self.say("a mapping entry between entries of a sequence")
                    return False
            if top[0] < column:
                if len(stack) > 1 and not top[1].endswith("?"):
                    self.say("bad indentation of a mapping entry")
                    return False
                if top[1].endswith("?"):
                    top[1] = top[1][:-1]
                stack.append([column, "map"])
            top = stack[-1]
            rest = text[m.end() :].strip(" \t")
            props = _PROPS.match(rest)
            if props:
                rest = rest[props.end() :].strip()
            if not rest or rest.startswith("#"):
                top[1] = "map?"
                self.i += 1
                return True
            top[1] = "map"
            if re.match(r"-[ \t]", rest):
                self.say("a sequence cannot begin on its key's line")
                return False
            return self.value(rest, column, column + len(text) - len(rest))
        if len(stack) > 1:
            if top[0] < column and top[1].endswith("?"):
                top[1] = top[1][:-1]
            else:
                self.say("expected a key and ':'")
                return False
        return self.value(text, top[0], column)

    def value(self, text: str, parent: int, column: int) -> bool:
        """A scalar or flow collection that begins with ``text`` on the current line."""
        c = text[0]
        begun = self.i
        if c in "|>":
            if not _BLOCK.match(text):
                self.say("bad header of a block scalar")
                return False
            self.i += 1
            while self.i < len(self.lines):
                line = self.lines[self.i]
                if line.strip() and len(line) - len(line.lstrip(" ")) <= parent:
                    break
                self.i += 1
            return True
        if c in "\"'":
            end = re.compile(r"\"(?:[^\"\\]|\\[\s\S])*\"|'(?:[^']|'')*'")
            whole = text
            m = end.match(whole)
            while not m:
                self.i += 1
                if self.i >= len(self.lines):
                    self.say("a quoted scalar does not end", begun)
                    return False
                line = self.lines[self.i]
                if line.strip() and len(line) - len(line.lstrip(" ")) <= parent:
                    self.say("a quoted scalar does not end", begun)
                    return False
                whole += "\n" + line
                m = end.match(whole)
            if c == '"' and re.search(r"\\[^0abtnvfre \"/\\N_LPxuU\n\t\r]|\\x(?![0-9a-fA-F]{2})|\\u(?![0-9a-fA-F]{4})", re.sub(r"\\\\", "", m.group())):
                self.say("unknown escape in a double-quoted scalar")
                return False
            return self.after(whole[m.end() :])
        if c in "[{":
            return self.flow(text, parent)
        if c in "@`%":
            self.say("a plain scalar cannot begin with this character")
            return False
        if c in ",]}":
            self.say("unexpected flow indicator")
            return False
        if c == "*":
            if not re.match(r"\*[^\s,\[\]{}]+[ \t]*(?:#.*)?$", text):
                self.say("bad alias")
                return False
            self.i += 1
            return True
        # plain scalar; it may go on over deeper lines
        while True:
            bare = re.sub(r"(?:^|[ \t])#.*$", "", text)
            if re.search(r":(?:[ \t]|$)", bare):
                self.say("mapping values are not allowed here")
                return False
            commented = bare != text
            self.i += 1
            j = self.i
            while j < len(self.lines) and not self.lines[j].strip():
                j += 1
            if j >= len(self.lines):
                return True
            line = self.lines[j].rstrip("\r")
            indent = len(line) - len(line.lstrip(" "))
            nxt = line.strip(" \t")
            if indent <= parent or nxt.startswith("#") or re.match(r"(?:---|\.\.\.)(?:\s|$)", line):
                return True
            if commented:
                self.say("a plain scalar cannot go on after a comment", j)
                return False
            if line[indent : indent + 1] == "\t" and indent == 0 and parent >= 0:
                self.say("a tab cannot begin an indent", j)
                return False
            self.i = j
            text = nxt

    def after(self, rest: str) -> bool:
        """What stands after a quoted scalar or flow collection on its line."""
        rest = rest.rstrip("\r")
        if rest.strip() and not re.match(r"[ \t]+#", rest):
            self.say("unexpected content after a value")
            return False
        self.i += 1
        return True

    _FLOW = re.compile(r"[ \t\r\n]*(?:(?P<s>\"(?:[^\"\\]|\\[\s\S])*\"|'(?:[^']|'')*')|(?P<c>(?:(?<=\s)|^)#[^\n]*)|(?P<p>[\[\]{},]|:(?=[\s,\[\]{}\"']|$)|\?(?=\s))|(?P<n>[^\s,\[\]{}#:\"'](?:[^,\[\]{}:#\n]|:(?![\s,\[\]{}]|$)|(?<=\S)#)*))")

    def flow(self, text: str, parent: int) -> bool:
        begun = self.i
        whole = text
        stack: list[str] = []
        at, last = 0, ""
        while True:
            m = self._FLOW.match(whole, at)
            if not m or not m.group().strip():
                if whole[at:].strip():
                    self.say("bad flow collection")
                    return False
                self.i += 1
                if self.i >= len(self.lines):
                    self.say("a flow collection does not end", begun)
                    return False
                line = self.lines[self.i]
                if line.strip() and len(line) - len(line.lstrip(" ")) <= parent and line.strip()[0] not in "]}":
                    self.say("a flow collection does not end", begun)
                    return False
                whole += "\n" + line
                continue
            at = m.end()
            if m.lastgroup == "c":
                continue
            c = m.group("p") or "v"
            if c in "[{":
                if last == "v":
                    self.say("expected ',' in a flow collection")
                    return False
                stack.append(c)
                last = ""
                continue
            if c in "]}":
                if stack[-1] != ("[" if c == "]" else "{"):
                    self.say("a bracket does not match")
                    return False
                stack.pop()
                if not stack:
                    return self.after(whole[at:].split("\n")[0])
                last = "v"
            elif c == ",":
                if last in ("", ","):
                    self.say("unexpected ',' in a flow collection")
                    return False
                last = ","
            elif c == ":":
                last = ":"
            elif c == "v":
                if last == "v" and m.lastgroup == "s" or last == "v":
                    self.say("expected ',' in a flow collection")
                    return False
                last = "v"


_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")


def check_yaml(source: str) -> list[Fault]:
    """All faults of a YAML text, in order; none for a valid or blank one.  After a fault, on with the next entry."""
    special = [Fault(n, "special characters are not allowed") for n, x in enumerate(source.split("\n"), 1) if _CONTROL.search(x)]
    if not special:
        return _Yaml(source).run()
    return sorted(special + _Yaml(_CONTROL.sub("_", source)).run(), key=lambda f: f.line)
