"""Complexity of sources in languages with braces, and Ruby, from tokens and nested statements (E.8-E.19).

A reader descends over statements, expressions and blocks; it needs no grammar of the whole language: what opens a
block is told by the words before it.  Broken sources are read as far as their brackets go.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import NamedTuple


@dataclass(frozen=True)
class Language:
    """branch: words that add a path; structural: words that cost by nesting; labels: words of a switch that add a path."""

    branch: frozenset[str]
    structural: frozenset[str]
    labels: frozenset[str] = frozenset()
    bools: frozenset[str] = frozenset(("&&", "||"))
    bare: bool = False  # heads of statements stand without parentheses
    hash_comments: bool = False
    ternary: bool = True


def _language(branch: str, structural: str, labels: str = "", **more) -> Language:
    return Language(frozenset(branch.split()), frozenset(structural.split()), frozenset(labels.split()), **more)


# What adds a path and what nests, by language.
_JS = _language("if while do for catch", "if while do for switch catch", "case", bools=frozenset(("&&", "||", "??")))
_C = _language("if while do for switch", "if while do for switch", "case default")
LANGUAGES = {
    "javascript": _JS, "typescript": _JS, "c": _C, "cpp": _language("if while do for switch try", "if while do for switch", "case default"),
    "java": _language("if while do for catch", "if while do for switch catch", "case default"), "csharp": _language("if while do for foreach catch", "if while do for foreach switch catch", "case default"),
    "go": _language("if for switch select", "if for switch select", "case default", bare=True, ternary=False), "rust": _language("if while for loop", "if while for loop match", bare=True, ternary=False),
    "php": _language("if elseif while do for foreach switch catch match", "if while do for foreach switch catch match", bools=frozenset(("&&", "||", "and", "or")), hash_comments=True),
    "ruby": _language("if unless while until for when rescue elsif", "if unless while until for case rescue", bools=frozenset(("&&", "||", "and", "or")), hash_comments=True),
}
CONTROL = frozenset("if elseif while do for foreach switch select match loop try catch finally else".split())
HEADLESS = frozenset("do loop try finally else".split())
TYPES = frozenset("class interface struct enum impl trait namespace module record union extension mod extern new".split())
FUNCTIONS = frozenset("function func fn def".split())
OPERAND_END = re.compile(r"[\w$)\]}\"'`]$")


class Token(NamedTuple):
    text: str
    line: int
    first: bool  # of its line
    spaced: bool


_COMMENT = r"/\*.*?(?:\*/|\Z)|//[^\n]*"
_STRING = r"\"\"\".*?(?:\"\"\"|\Z)|@\"(?:[^\"]|\"\")*\"|r(?P<h>#*)\".*?\"(?P=h)|\"(?:[^\"\\\n]|\\.)*\"?|`(?:[^`\\]|\\.)*`?|'(?:[^'\\\n]|\\.[^'\n]*)'|'\w*|'"
_REST = r"[A-Za-z_$][\w$]*|\d[\w.]*|=>|->|\?\?=?|\?\.|&&|\|\||::|:=|[<>=!]=+|\+\+|--|\S"
_RULES = {marks: re.compile(rf"(?P<skip>\s+|{_COMMENT}{'|#[^{chr(10)}]*' if marks else ''})|(?P<text>{_STRING})|(?P<rest>{_REST})", re.S) for marks in (False, True)}
_REGEX = re.compile(r"/(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")


def tokens(code: str, lang: str) -> list[Token]:
    rule, out, at, line, first, spaced = _RULES[LANGUAGES[lang].hash_comments], [], 0, 1, True, True
    script = lang in ("javascript", "typescript")
    while m := rule.match(code, at):
        text = m.group()
        if script and text == "/" and (not out or not OPERAND_END.search(out[-1].text) or out[-1].text in ("return", "typeof", "case")):
            m = _REGEX.match(code, at) or m
            text = m.group()
        at = m.end()
        breaks = text.count("\n")
        if m.re is rule and m.group("skip") is not None:
            first, spaced = first or breaks > 0, True
        else:
            out.append(Token("''" if m.re is not rule or m.group("text") is not None else text, line, first, spaced))
            first = spaced = False
        line += breaks
    return out


@dataclass
class Measures:
    cyclomatic: int = 1
    cognitive: int = 0
    depth: int = 0
    n_types: int = 0
    functions: list[tuple[int, int, int]] = field(default_factory=list)  # first line, last line, cyclomatic


class Reader:
    def __init__(self, code: str, lang: str):
        self.t, self.lang, self.k = tokens(code, lang), LANGUAGES[lang], 0
        self.out, self.nest, self.inside = Measures(), 0, 0

    def text(self, at: int = 0) -> str:
        k = self.k + at
        return self.t[k].text if 0 <= k < len(self.t) else ""

    def run(self) -> Measures:
        while self.k < len(self.t):
            self.statements()
            self.k += 1  # a bracket that nothing opened
        return self.out

    def statements(self) -> None:
        while self.k < len(self.t) and self.text() not in (")", "]", "}"):
            self.statement()

    def statement(self) -> None:
        word = self.text()
        if word == "{":
            self.closed(self.statements)
        elif word in CONTROL:
            self.control(word)
        elif word in ("case", "default") and self.text(1) not in ("(", ".", ",", ")") :
            self.out.cyclomatic += word in self.lang.labels
            self.k += 1
            self.expression((":", "->", "=>"))
            self.k += self.text() in (":", "->", "=>")
        else:
            self.expression()

    def closed(self, inner) -> None:
        """A bracket, ``inner``, and the bracket that closes it."""
        self.k += 1
        inner()
        self.k += 1

    def items(self) -> None:
        while self.k < len(self.t) and self.text() not in (")", "]", "}"):
            before = self.k
            self.expression((",",))
            self.k += self.text() in (",", ";") or self.k == before

    def control(self, word: str) -> None:
        self.out.cyclomatic += word in self.lang.branch
        deep = word in self.lang.structural
        if deep:
            self.out.cognitive += 1 + self.nest
            self.nest += 1
            self.out.depth = max(self.out.depth, self.nest)
        self.k += 1
        if word not in HEADLESS:
            if self.text() == "(" and not self.lang.bare:
                self.closed(self.items)
            elif self.text() != "{":
                while self.k < len(self.t) and self.text() not in ("{", "}", ")"):
                    before = self.k
                    self.expression(("{",))
                    self.k += self.k == before
        if word == "match":
            self.arms()
        elif self.k < len(self.t) and self.text() not in (")", "]", "}"):
            self.statement()
        if word == "do" and self.text() == "while" and not self.lang.bare:
            self.k += 1
            if self.text() == "(":
                self.closed(self.items)
        while word in ("if", "elseif") and self.text() in ("else", "elseif"):
            if self.text() == "elseif":
                if word == "elseif":
                    break
                self.control("elseif")
            else:
                self.k += 1
                self.statement()
                break
        if deep:
            self.nest -= 1

    def arms(self) -> None:
        if self.text() != "{":
            return
        self.k += 1
        while self.k < len(self.t) and self.text() != "}":
            before = self.k
            self.expression(("=>",))
            if self.text() == "=>":
                self.out.cyclomatic += self.lang.bare  # an arm is a path of its own where the match is none
                self.k += 1
                self.expression((",",)) if self.text() != "{" else self.closed(self.statements)
            self.k += self.text() in (",", ";") or self.k == before
        self.k += 1

    def expression(self, stops: tuple[str, ...] = ()) -> None:
        """Up to a stop, a semicolon (taken if no stops are given), a bracket that closes more, or a line that begins anew."""
        start = head = self.k
        while self.k < len(self.t):
            word, tok = self.text(), self.t[self.k]
            if word in stops or word in (")", "]", "}"):
                return
            if word == ";":
                self.k += not stops
                return
            if not stops and self.k > start and tok.first and (word in CONTROL or word in FUNCTIONS or word in TYPES or word in ("case", "default", "return") or self.lang.bare and OPERAND_END.search(self.text(-1))):
                return
            if word in ("(", "["):
                self.closed(self.items)
                continue
            if word == "{":
                self.brace(head)
                after = self.t[self.k] if self.k < len(self.t) else None
                if not stops and (after is None or after.first and after.text[:1] not in ".,(?:&|+-*/=)"):
                    return
                continue
            guard = word == "if" and "=>" in stops  # of an arm
            if word in CONTROL and not guard and self.k > start and word not in ("else", "catch", "finally") and self.text(-1) not in (".", "?.", "->", "::") and self.text(1) not in (":", "=", ",", ")"):
                self.control(word)
                continue
            if word in self.lang.bools:
                self.out.cyclomatic += 1
                self.out.cognitive += 1
            elif word == "?" and self.lang.ternary and tok.spaced and self.text(1) not in (":", ")", ",", ";"):
                self.out.cognitive += 1
            elif word == "=>" and self.text(1) != "{":
                self.out.functions.append((tok.line, tok.line, 1))
            self.k += 1
            if word in ("=", ":=", ",", ":", "return", "=>", "?") and not (word == ":" and (self.text(-2) == ")" or self.text(-3) == "where")):
                head = self.k

    def brace(self, head: int) -> None:
        words = [t.text for t in self.t[head : self.k]]
        last = words[-1] if words else self.text(-1)
        if not (FUNCTIONS & set(words)) and (kinds := TYPES & set(words)):
            self.out.n_types += kinds != {"new"}
            self.closed(self.statements)
        elif last in ("=>", "->", "|") or self.text(-1) in ("=>", "->") or FUNCTIONS & set(words) or self.is_method(words):
            self.function(head)
        else:
            self.closed(self.statements)

    @staticmethod
    def is_method(words: list[str]) -> bool:
        """name ( ... ) and at most some words more (throws, const, a return type)."""
        depth = 0
        for k in range(len(words) - 1, -1, -1):
            depth += (words[k] == ")") - (words[k] == "(")
            if words[k] == "(" and depth == 0:
                before = words[k - 1] if k else ""
                return bool(re.match(r"[\w$'\]>]", before)) and before not in CONTROL and before != "return"
            if depth == 0 and not re.match(r"[\w$,.<>&*:)\[\]]", words[k]):
                return False
        return False

    def function(self, head: int) -> None:
        before, line = self.out.cyclomatic, self.t[min(head, self.k)].line
        nested = self.inside > 0
        self.nest += nested
        self.inside += 1
        self.closed(self.statements)
        self.inside -= 1
        self.nest -= nested
        self.out.functions.append((line, self.t[min(self.k, len(self.t)) - 1].line, self.out.cyclomatic - before + 1))


_RUBY_OPEN = frozenset("if unless while until for case def class module begin do".split())


def _ruby(code: str) -> Measures:
    """Ruby by its ends: a word that opens stands at a line's start or after a sign; elsewhere it is a modifier."""
    out, lang, stack, loop = Measures(), LANGUAGES["ruby"], [], -1
    code = re.sub(r"(?ms)^=begin\b.*?^=end\b[^\n]*", lambda m: "\n" * m.group().count("\n"), code)
    toks = tokens(code, "ruby")
    for k, (word, line, first, _) in enumerate(toks):
        before = toks[k - 1].text if k else ";"
        if before in (".", "::", ":", "&.") or k + 1 < len(toks) and toks[k + 1].text == ":" and not toks[k + 1].spaced:
            continue
        nest = sum(s[1] for s in stack)
        functions = sum(s[0] in ("def", "do") for s in stack)
        if word in lang.bools:
            out.cyclomatic += 1
            out.cognitive += 1
        elif word in lang.branch or word in lang.structural:
            opens = first or before in ("=", ";", "(", "[", "{", ",", "then", "do", "else", "begin", "&&", "||", "return")
            out.cyclomatic += word in lang.branch
            if word in lang.structural and (opens or word == "rescue"):
                out.cognitive += 1 + nest
            if word in _RUBY_OPEN and opens:
                stack.append((word, 1, line, out.cyclomatic))
                out.depth = max(out.depth, nest + 1)
                loop = line if word in ("while", "until", "for") else loop
        elif word in _RUBY_OPEN and not (word == "do" and loop == line):
            out.n_types += word in ("class", "module") and first
            stack.append((word, int(word in ("def", "do") and functions > 0), line, out.cyclomatic))
        elif word == "end" and stack:
            kind, _, begun, cc = stack.pop()
            if kind in ("def", "do"):
                out.functions.append((begun, line, out.cyclomatic - cc + 1))
    return out


def measure(code: str, lang: str) -> Measures:
    return _ruby(code) if lang == "ruby" else Reader(code, lang).run()
