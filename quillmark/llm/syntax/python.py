"""Python 3.13: statements by recursive descent, expressions by precedence climbing.

The grammar of a logical line depends on its kinds only, and lines repeat their kinds, so the outcome of each
distinct line is kept; blocks are checked over the lines' outcomes and indents.  After a fault the parser goes
on with the next logical line.
"""

from __future__ import annotations

import re

from quillmark.llm.syntax.base import CACHED, Descent, Fault, Kinds, Wrong

_STR1 = r"'(?!'')(?:[^'\\\n]|\\(?:\r\n|[\s\S]))*'|\"(?!\"\")(?:[^\"\\\n]|\\(?:\r\n|[\s\S]))*\""
_STR3 = r"'''(?:[^'\\]|\\[\s\S]|'(?!''))*'''|\"\"\"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*\"\"\""
_NUM = (
    r"0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|"
    r"(?:\d(?:_?\d)*)?\.\d(?:_?\d)*(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?|\d(?:_?\d)*\.?(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?"
)
_AFTER_NUM = r"(?=\W|\Z|(?:and|else|for|if|in|is|not|or)\b)"
TOKEN = re.compile(
    r"[ \t\f]*("
    r"\r?\n[ \t\f]*|\r[ \t\f]*|"
    r"(?:[rRuUbBfF]|[rR][bBfF]|[bBfF][rR])?(?:" + _STR3 + "|" + _STR1 + r")|"
    r"[^\W\d]\w*|"
    r"(?:" + _NUM + ")" + _AFTER_NUM + r"|"
    r"#[^\r\n]*|\\\r?\n|"
    r"\*\*=|//=|>>=|<<=|\.\.\.|->|:=|\*\*|//|>>|<<|<=|>=|==|!=|[+\-*/%&|^@]=|"
    r"[()\[\]{},:;.=<>+\-*/%&|^~@]|"
    r"\d\w*|[^\s]|[^\S\n])"
)

KEYWORDS = {
    "if": "i", "elif": "e", "else": "l", "for": "f", "while": "w", "try": "t", "except": "x", "finally": "y", "with": "W", "def": "d",
    "class": "c", "async": "a", "await": "q", "return": "r", "yield": "z", "lambda": "L", "not": "!", "in": "I", "is": "S", "and": "&",
    "or": "V", "import": "m", "from": "F", "as": "T", "pass": "p", "break": "k", "continue": "u", "raise": "R", "global": "g",
    "nonlocal": "N", "del": "D", "assert": "B", "True": "K", "False": "K", "None": "K", "match": "M", "case": "C", "type": "Y",
}
OPERATORS = {
    "->": ">", ":=": "U", "**": "P", "//": "o", ">>": "o", "<<": "o", "%": "o", "^": "o", "&": "o", "<=": "<", ">=": "<", "==": "<",
    "!=": "<", "<": "<", ">": "<", "...": "E", "+": "+", "-": "+", "*": "*", "/": "/", "@": "@", "|": "|", "~": "~",
    "+=": "A", "-=": "A", "*=": "A", "/=": "A", "//=": "A", "%=": "A", "@=": "A", "&=": "A", "|=": "A", "^=": "A", ">>=": "A", "<<=": "A",
    "**=": "A",
}
OPERATORS |= {c: c for c in "()[]{},:;.="}
NAMES = "nMCY"
_GOOD_NUM = re.compile(r"0(?:_?0)*|[1-9](?:_?\d)*|0[xXbBoO].*|.*[.eEjJ].*")
_PREFIX = re.compile(r"[A-Za-z]*")
_ESCAPE = re.compile(r"\\(?:x(?![0-9a-fA-F]{2})|u(?![0-9a-fA-F]{4})|U(?!00(?:0[0-9a-fA-F]|10)[0-9a-fA-F]{4})|N(?!\{[^}]+\}))|\\[\s\S]")
_BAD_ESCAPE = re.compile(r"\\[xuUN]\Z")


def _escapes_ok(body: str, is_bytes: bool) -> bool:
    for m in _ESCAPE.finditer(body):
        bad = _BAD_ESCAPE.match(m.group())
        if bad and len(m.group()) == 2 and (m.group()[1] == "x" or not is_bytes):
            rest = body[m.start() + 2 :]
            c = m.group()[1]
            if c == "x" and re.match(r"[0-9a-fA-F]{2}", rest) or c == "u" and re.match(r"[0-9a-fA-F]{4}", rest):
                continue
            if c == "U" and re.match(r"00(?:0[0-9a-fA-F]|10)[0-9a-fA-F]{4}", rest) or c == "N" and re.match(r"\{[^}]+\}", rest):
                continue
            return False
    return True


def _classify(token: str) -> str:
    c = token[0]
    if c in "\r\n":
        return "\n"
    if c == "#" or c == "\\" and len(token) > 1 or c in " \t\f":
        return ""
    if token[-1] in "'\"" and len(token) > 1:
        prefix = _PREFIX.match(token).group().lower()
        body = token[len(prefix) :]
        quote = body[:3] if body[:3] in ("'''", '"""') and len(body) >= 6 else body[:1]
        body = body[len(quote) : -len(quote)]
        if "b" in prefix:
            return "b" if body.isascii() and ("r" in prefix or _escapes_ok(body, True)) else "?"
        if "r" not in prefix and "\\" in body and not _escapes_ok(body, False):
            return "?"
        if "f" in prefix:
            return "s" if fields_ok(body, "r" in prefix) else "?"
        return "s"
    if c.isdigit() or c == "." and len(token) > 1:
        return "0" if _GOOD_NUM.fullmatch(token) and not re.fullmatch(r"\d\w*", token) or re.fullmatch(_NUM, token) and _GOOD_NUM.fullmatch(token) else "?"
    if token.isidentifier():
        return "n"
    return "?"


KINDS = Kinds(KEYWORDS | OPERATORS, _classify)


def fields_ok(body: str, raw: bool, spec: bool = False) -> bool:
    """Whether the replacement fields of an f-string's body hold expressions."""
    i, n = 0, len(body)
    while i < n:
        c = body[i]
        if c == "\\" and not raw and body[i + 1 : i + 3] == "N{":
            i = body.find("}", i) + 1 or n
        elif c == "{":
            if not spec and body[i + 1 : i + 2] == "{":
                i += 2
                continue
            end = _field_end(body, i + 1)
            if end is None:
                return False
            expr, rest, i = end
            if not EXPRESSIONS[expr.strip(" \t\n\r\f")]:
                return False
            if rest and not fields_ok(rest, raw, True):
                return False
        elif c == "}":
            if spec or body[i + 1 : i + 2] != "}":
                return False
            i += 2
        else:
            i += 1
    return True


def _field_end(body: str, i: int) -> tuple[str, str, int] | None:
    """(expression, format spec, place after the closing brace) of the field that begins at ``i``."""
    begin, depth = i, 0
    n = len(body)
    stop = None
    while i < n:
        c = body[i]
        if c in "'\"":
            m = _STRING.match(body, i)
            if not m:
                return None
            i = m.end()
            continue
        if c in "([{":
            depth += 1
        elif c in ")]}":
            if depth == 0:
                if c != "}":
                    return None
                stop = i
                break
            depth -= 1
        elif depth == 0 and c == "!" and body[i + 1 : i + 2] != "=":
            expr = body[begin:i]
            m = re.compile(r"![rsa]\s*").match(body, i)
            if not m:
                return None
            i = m.end()
            if body[i : i + 1] == "}":
                return expr, "", i + 1
            if body[i : i + 1] != ":":
                return None
            return _spec(body, expr, i + 1)
        elif depth == 0 and c == ":" and not re.search(r"\blambda\b", body[begin:i]):
            return _spec(body, body[begin:i], i + 1)
        i += 1
    if stop is None:
        return None
    expr = body[begin:stop]
    if re.search(r"[^=!<>:]=\s*$", expr):
        expr = expr.rstrip()[:-1]
    return expr, "", stop + 1


def _spec(body: str, expr: str, i: int) -> tuple[str, str, int] | None:
    if re.search(r"[^=!<>:]=\s*$", expr):
        expr = expr.rstrip()[:-1]
    begin, depth = i, 0
    while i < len(body):
        if body[i] == "{":
            depth += 1
        elif body[i] == "}":
            if depth == 0:
                return expr, body[begin:i], i + 1
            depth -= 1
        i += 1
    return None


_STRING = re.compile(r"(?:" + _STR3 + "|" + _STR1 + ")")


class _Expressions(dict):
    """expression text of a replacement field -> whether it is one"""

    def __missing__(self, text: str) -> bool:
        if len(self) > CACHED:
            self.clear()
        kinds = "".join(k for k in map(KINDS.__getitem__, TOKEN.findall(text)) if k != "\n")
        ok = bool(kinds) and "?" not in kinds
        if ok:
            d = Line(kinds)
            try:
                d.yield_or_expressions()
                ok = d.k[d.p] == d.END
            except (Wrong, RecursionError):
                ok = False
        self[text] = ok
        return ok


EXPRESSIONS = _Expressions()

# binding powers of binary operators by kind; comparisons and "not" stand between
BINARY = {"V": 1, "&": 2, "<": 4, "I": 4, "S": 4, "|": 5, "o": 6, "+": 7, "*": 8, "/": 8, "@": 8}
TARGETS = "nat"


class Line(Descent):
    """One logical line.  Expression methods return what the expression is as a target: n name, a attribute
    or subscript, t tuple or list of targets, * starred target, x none."""

    # ---- expressions

    def primary(self) -> str:
        k = self.k
        c = k[self.p]
        if c in NAMES:
            self.p += 1
            what = "n"
        elif c == "s" or c == "b":
            while k[self.p] == c:
                self.p += 1
            if k[self.p] in "sb":
                raise self.wrong("cannot mix bytes and nonbytes literals")
            what = "x"
        elif c in "0KE":
            self.p += 1
            what = "x"
        elif c == "(":
            what = self.parens()
        elif c == "[":
            what = self.brackets()
        elif c == "{":
            what = self.braces()
        else:
            raise self.wrong()
        while True:
            c = k[self.p]
            if c == ".":
                self.p += 1
                if k[self.p] not in NAMES:
                    raise self.wrong("expected a name after '.'")
                self.p += 1
                what = "a"
            elif c == "(":
                self.arguments()
                what = "x"
            elif c == "[":
                self.subscript()
                what = "a"
            else:
                return what

    def unary(self) -> str:
        c = self.k[self.p]
        if c in "+~":
            self.p += 1
            self.unary()
            return "x"
        if c == "q":
            self.p += 1
            self.primary()
            what = "x"
        else:
            what = self.primary()
        if self.k[self.p] == "P":
            self.p += 1
            self.unary()
            return "x"
        return what

    def binary(self, least: int = 1) -> str:
        if self.k[self.p] == "!":
            if least > 3:
                raise self.wrong()
            self.p += 1
            self.binary(3)
            what = "x"
        else:
            what = self.unary()
        while True:
            c = self.k[self.p]
            if c == "!" and self.k[self.p + 1] == "I":
                power, width = 4, 2
            elif c in BINARY:
                power, width = BINARY[c], 2 if c == "S" and self.k[self.p + 1] == "!" else 1
            else:
                return what
            if power < least:
                return what
            self.p += width
            self.binary(power + 1)
            what = "x"

    def test(self) -> str:
        if self.k[self.p] == "L":
            self.p += 1
            self.parameters(":", False)
            self.need(":")
            self.test()
            return "x"
        what = self.binary()
        if self.k[self.p] == "i":
            self.p += 1
            self.binary()
            self.need("l", "'else'")
            self.test()
            return "x"
        return what

    def named(self) -> str:
        if self.k[self.p] in NAMES and self.k[self.p + 1] == "U":
            self.p += 2
            self.test()
            return "x"
        return self.test()

    def starred(self, inner) -> str:
        if self.take("*"):
            return "*" if self.binary(5) in TARGETS else "y"
        return inner()

    def sequence(self, inner, ends: str) -> str:
        """star_expressions: one or more, comma separated; what they are as targets."""
        what = self.starred(inner)
        if self.k[self.p] != ",":
            return what
        ok = what in TARGETS + "*"
        while self.take(","):
            if self.k[self.p] in ends:
                break
            ok &= self.starred(inner) in TARGETS + "*"
        return "t" if ok else "x"

    ENDS = "\0=;:)]}AI"

    def expressions(self) -> str:
        return self.sequence(self.test, self.ENDS)

    def yield_or_expressions(self) -> str:
        if self.take("z"):
            if self.take("F"):
                self.test()
            elif self.k[self.p] not in self.ENDS:
                self.expressions()
            return "x"
        return self.expressions()

    def comprehension(self) -> None:
        while self.k[self.p] in "fa":
            if self.take("a") and self.k[self.p] != "f":
                raise self.wrong()
            self.p += 1
            self.target_list("I")
            self.need("I", "'in'")
            self.binary()
            if self.k[self.p] == "i":
                while self.take("i"):
                    if self.k[self.p] in NAMES and self.k[self.p + 1] == "U":
                        raise self.wrong()
                    self.binary()

    def target_list(self, end: str) -> None:
        what = self.sequence(self.unary, end + "\0")
        if what not in TARGETS + "*":
            raise self.wrong("cannot assign to this")

    def parens(self) -> str:
        self.p += 1
        if self.take(")"):
            return "t"
        if self.k[self.p] == "z":
            self.yield_or_expressions()
            self.need(")")
            return "x"
        what = self.starred(self.named)
        if self.k[self.p] in "fa":
            if what in "*y":
                raise self.wrong()
            self.comprehension()
            self.need(")")
            return "x"
        if self.k[self.p] == ",":
            ok = what in TARGETS + "*"
            while self.take(","):
                if self.k[self.p] == ")":
                    break
                ok &= self.starred(self.named) in TARGETS + "*"
            what = "t" if ok else "x"
        elif what in "*y":
            raise self.wrong("cannot use starred expression here")
        self.need(")")
        return what

    def brackets(self) -> str:
        self.p += 1
        if self.take("]"):
            return "t"
        what = self.starred(self.named)
        if self.k[self.p] in "fa":
            if what in "*y":
                raise self.wrong()
            self.comprehension()
            self.need("]")
            return "x"
        ok = what in TARGETS + "*"
        while self.take(","):
            if self.k[self.p] == "]":
                break
            ok &= self.starred(self.named) in TARGETS + "*"
        self.need("]")
        return "t" if ok else "x"

    def braces(self) -> str:
        self.p += 1
        if self.take("}"):
            return "x"
        if self.k[self.p] == "P":
            self.p += 1
            self.binary(5)
            pairs = True
        else:
            what = self.starred(self.named)
            pairs = self.k[self.p] == ":" and what not in "*y"
            if pairs:
                self.p += 1
                self.test()
            if self.k[self.p] in "fa":
                if what in "*y":
                    raise self.wrong()
                self.comprehension()
                self.need("}")
                return "x"
        while self.take(","):
            if self.k[self.p] == "}":
                break
            if not pairs:
                self.starred(self.named)
            elif self.take("P"):
                self.binary(5)
            else:
                self.test()
                self.need(":")
                self.test()
        self.need("}")
        return "x"

    def arguments(self) -> None:
        self.p += 1
        keyword = unpacked = False
        first = True
        while not self.take(")"):
            c = self.k[self.p]
            if c == "*":
                if unpacked:
                    raise self.wrong()
                self.p += 1
                self.test()
            elif c == "P":
                self.p += 1
                self.test()
                unpacked = True
            elif c in NAMES and self.k[self.p + 1] == "=":
                self.p += 2
                self.test()
                keyword = True
            else:
                if keyword or unpacked:
                    raise self.wrong("positional argument follows keyword argument")
                self.named()
                if self.k[self.p] in "fa":
                    self.comprehension()
                    if not first or self.k[self.p] != ")":
                        raise self.wrong("generator expression must be parenthesized")
            first = False
            if self.k[self.p] != ")":
                self.need(",", "',' or ')'")

    def subscript(self) -> None:
        self.p += 1
        while True:
            if self.take("*"):
                self.binary(5)
            else:
                if self.k[self.p] != ":":
                    self.named()
                if self.take(":"):
                    if self.k[self.p] not in ":],":
                        self.test()
                    if self.take(":") and self.k[self.p] not in "],":
                        self.test()
            if self.take("]"):
                return
            self.need(",", "',' or ']'")
            if self.take("]"):
                return

    def parameters(self, end: str, annotated: bool) -> None:
        star = slash = default = False
        n = 0
        while self.k[self.p] != end:
            c = self.k[self.p]
            if c == "/":
                if slash or star or not n:
                    raise self.wrong()
                self.p += 1
                slash = True
            elif c == "*":
                if star:
                    raise self.wrong()
                self.p += 1
                star = True
                if self.k[self.p] in NAMES:
                    self.p += 1
                    if annotated and self.take(":"):
                        if self.take("*"):
                            self.binary(5)
                        else:
                            self.test()
                elif self.k[self.p] != "," or self.k[self.p + 1] not in NAMES:
                    raise self.wrong("named arguments must follow bare *")
            elif c == "P":
                self.p += 1
                if self.k[self.p] not in NAMES:
                    raise self.wrong()
                self.p += 1
                if annotated and self.take(":"):
                    self.test()
                self.take(",")
                if self.k[self.p] != end:
                    raise self.wrong("arguments cannot follow var-keyword argument")
                return
            elif c in NAMES:
                self.p += 1
                if annotated and self.take(":"):
                    self.test()
                if self.take("="):
                    self.test()
                    default = True
                elif default and not star:
                    raise self.wrong("parameter without a default follows parameter with a default")
            else:
                raise self.wrong()
            n += 1
            if self.k[self.p] != end:
                self.need(",")

    # ---- statements

    def simple_line(self) -> None:
        while True:
            self.simple()
            if not self.take(";"):
                break
            if self.k[self.p] == self.END:
                return
        if self.k[self.p] != self.END:
            raise self.wrong()

    def simple(self) -> None:
        k = self.k
        c = k[self.p]
        if c in "pku":
            self.p += 1
        elif c == "r":
            self.p += 1
            if k[self.p] not in "\0;":
                self.expressions()
        elif c == "m":
            self.p += 1
            while True:
                self.dotted()
                if self.take("T"):
                    self.name()
                if not self.take(","):
                    break
        elif c == "F":
            self.p += 1
            dots = 0
            while k[self.p] in ".E":
                self.p += 1
                dots += 1
            if k[self.p] != "m" or not dots:
                self.dotted()
            self.need("m", "'import'")
            if self.take("*"):
                return
            closed = self.take("(")
            while True:
                self.name()
                if self.take("T"):
                    self.name()
                if not self.take(","):
                    break
                if closed and k[self.p] == ")":
                    break
            if closed:
                self.need(")")
        elif c == "R":
            self.p += 1
            if k[self.p] not in "\0;":
                self.test()
                if self.take("F"):
                    self.test()
        elif c in "gN":
            self.p += 1
            self.name()
            while self.take(","):
                self.name()
        elif c == "D":
            self.p += 1
            if self.sequence(self.unary, "\0;") not in TARGETS:
                raise self.wrong("cannot delete this")
        elif c == "B":
            self.p += 1
            self.test()
            if self.take(","):
                self.test()
        elif c == "Y" and k[self.p + 1] in NAMES:
            self.p += 2
            if k[self.p] == "[":
                self.type_parameters()
            self.need("=")
            self.test()
        else:
            self.expression_statement()

    def expression_statement(self) -> None:
        paren = self.k[self.p] == "("
        what = self.yield_or_expressions()
        c = self.k[self.p]
        if c == "=":
            while self.take("="):
                if what not in TARGETS + "*":
                    raise self.wrong("cannot assign to this")
                what = self.yield_or_expressions()
        elif c == "A":
            if what not in "na":
                raise self.wrong("illegal target for augmented assignment")
            self.p += 1
            self.yield_or_expressions()
        elif c == ":":
            if what not in "na" and not (paren and what in "na"):
                raise self.wrong("only single target can be annotated")
            self.p += 1
            self.test()
            if self.take("="):
                self.yield_or_expressions()

    def name(self) -> None:
        if self.k[self.p] not in NAMES:
            raise self.wrong("expected a name")
        self.p += 1

    def dotted(self) -> None:
        self.name()
        while self.take("."):
            self.name()

    def type_parameters(self) -> None:
        self.need("[")
        while True:
            plain = not (self.take("*") or self.take("P"))
            self.name()
            if plain and self.take(":"):
                self.test()
            if self.take("="):
                self.starred(self.test)
            if self.take("]"):
                return
            self.need(",")
            if self.take("]"):
                return

    def header(self) -> str:
        """The header of a compound statement up to its colon; its type by one character."""
        k = self.k
        c = k[self.p]
        self.p += 1
        if c == "a":
            c = k[self.p]
            if c not in "dfW":
                raise self.wrong()
            self.p += 1
        if c in "iew":
            self.named()
        elif c in "lty":
            pass
        elif c == "f":
            self.target_list("I")
            self.need("I", "'in'")
            self.expressions()
        elif c == "x":
            group = self.take("*")
            if k[self.p] != ":":
                self.test()
                if self.take("T"):
                    self.name()
            elif group:
                raise self.wrong()
        elif c == "W":
            self.with_items()
        elif c == "d":
            self.name()
            if k[self.p] == "[":
                self.type_parameters()
            self.need("(")
            self.parameters(")", True)
            self.need(")")
            if self.take(">"):
                self.expressions()
        elif c == "c":
            self.name()
            if k[self.p] == "[":
                self.type_parameters()
            if k[self.p] == "(":
                self.arguments()
        elif c == "M":
            self.sequence(self.named, ":")
        elif c == "C":
            self.patterns()
            if self.take("i"):
                self.named()
        self.need(":", "':'")
        return c

    def with_items(self) -> None:
        begin = self.p
        if self.take("("):
            try:
                while self.k[self.p] != ")":
                    self.with_item()
                    if self.k[self.p] != ")":
                        self.need(",")
                self.p += 1
                if self.k[self.p] == ":" and self.k[begin + 1] != ")":
                    return
            except Wrong:
                pass
            self.p = begin
        self.with_item()
        while self.take(","):
            self.with_item()

    def with_item(self) -> None:
        self.test()
        if self.take("T") and self.unary() not in TARGETS:
            raise self.wrong("cannot assign to this")

    # patterns of match statements

    def patterns(self) -> None:
        self.star_pattern()
        while self.take(","):
            if self.k[self.p] in ":i":
                break
            self.star_pattern()

    def star_pattern(self) -> None:
        if self.take("*"):
            self.name()
        else:
            self.as_pattern()

    def as_pattern(self) -> None:
        self.closed_pattern()
        while self.take("|"):
            self.closed_pattern()
        if self.take("T"):
            self.name()

    def closed_pattern(self) -> None:
        k = self.k
        c = k[self.p]
        if c in NAMES:
            self.dotted()
            if self.take("("):
                keyword = False
                while not self.take(")"):
                    if k[self.p] in NAMES and k[self.p + 1] == "=":
                        self.p += 2
                        keyword = True
                    elif keyword:
                        raise self.wrong("positional patterns follow keyword patterns")
                    self.as_pattern()
                    if k[self.p] != ")":
                        self.need(",")
        elif c in "sb":
            while k[self.p] == c:
                self.p += 1
        elif c == "K":
            self.p += 1
        elif c in "+0":
            self.take("+")
            self.need("0")
            if self.take("+"):
                self.need("0")
        elif c in "([":
            end = ")" if c == "(" else "]"
            self.p += 1
            while not self.take(end):
                self.star_pattern()
                if k[self.p] != end:
                    self.need(",")
        elif c == "{":
            self.p += 1
            while not self.take("}"):
                if self.take("P"):
                    self.name()
                else:
                    if k[self.p] in NAMES and k[self.p + 1] == ".":
                        self.dotted()
                    elif k[self.p] in "sbK0+":
                        self.closed_pattern()
                    else:
                        raise self.wrong()
                    self.need(":")
                    self.as_pattern()
                if k[self.p] != "}":
                    self.need(",")
        else:
            raise self.wrong()


def _line(kinds: str) -> tuple[str, bool, int, str]:
    """(type, whether a block must follow, place of the fault or -1, its message) of a logical line.

    Types: s simple, @ decorator, else the header's; ? is no line at all.
    """
    if "?" in kinds:
        return "?", False, kinds.index("?"), "invalid token"
    d = Line(kinds)
    c = kinds[0]
    try:
        if c == "@":
            d.p = 1
            d.named()
            if d.k[d.p] != d.END:
                raise d.wrong()
            return "@", False, -1, ""
        if c in "MC":
            try:
                d.simple_line()
                return "s", False, -1, ""
            except Wrong:
                d.p = 0
        elif c not in "ielfwtxyWdca":
            d.simple_line()
            return "s", False, -1, ""
        kind = d.header()
        if d.k[d.p] == d.END:
            return kind, True, -1, ""
        if kind == "M":
            raise d.wrong()
        d.simple_line()
        return kind, False, -1, ""
    except Wrong as w:
        return "?", c in "ielfwtxyWdcMCa" and kinds[-1] == ":", w.at, w.message
    except RecursionError:
        return "?", False, 0, "nested too deeply"


LONG = 2000  # kinds of lines this long are not kept


class _Lines(dict):
    def __missing__(self, kinds: str) -> tuple[str, bool, int, str]:
        if len(self) > CACHED:
            self.clear()
        out = _line(kinds)
        if len(kinds) < LONG:
            self[kinds] = out
        return out


LINES = _Lines()
_OPEN = {")": "(", "]": "[", "}": "{"}


class _Brackets(dict):
    """kinds of a physical line -> (closing brackets it needs from before, brackets it leaves open), or None
    where they do not match"""

    def __missing__(self, kinds: str) -> tuple[str, str] | None:
        if len(self) > CACHED:
            self.clear()
        stack: list[str] = []
        needs: list[str] = []
        out: tuple[str, str] | None = None
        for c in kinds:
            if c in "([{":
                stack.append(c)
            elif c in ")]}":
                if not stack:
                    needs.append(_OPEN[c])
                elif stack.pop() != _OPEN[c]:
                    break
        else:
            out = "".join(needs), "".join(stack)
        if len(kinds) < LONG:
            self[kinds] = out
        return out


BRACKETS = _Brackets()


def _column(indent: str) -> tuple[int, int]:
    col = alt = 0
    for c in indent:
        if c == "\t":
            col, alt = (col // 8 + 1) * 8, alt + 1
        elif c == "\f":
            col = alt = 0
        elif c == " ":
            col, alt = col + 1, alt + 1
    return col, alt


def check_python(source: str) -> list[Fault]:
    """All faults of a source, in order; none for a valid (or blank) one."""
    if "\0" in source:
        return [Fault(source.count("\n", 0, source.index("\0")) + 1, "source code cannot contain null bytes")]
    faults = _check(source, TOKEN.findall(source))
    if faults and re.search(r"(?i)\bf?r?f['\"]", source):
        nested = tokens_with_fields(source)
        if nested is not None:
            faults = _check(source, nested)
    return faults


def tokens_with_fields(source: str) -> list[str] | None:
    """Tokens of a source whose f-strings may hold the same quotes in their fields; None if one does not end."""
    out, at = [], 0
    start = re.compile(r"[ \t\f]*((?:[fF][rR]?|[rR][fF])(\"\"\"|'''|\"|'))")
    while at < len(source):
        m = start.match(source, at)
        if m:
            end = _fstring_end(source, m.end(), m.group(2))
            if end is None:
                return None
            body = source[m.end() : end - len(m.group(2))]
            good = fields_ok(body, "r" in m.group(1).lower())
            # a plain literal stands for it
            out.append("''" if good else "'")
            at = end
            continue
        m = TOKEN.match(source, at)
        if not m:
            break
        out.append(m.group(1))
        at = m.end()
    return out


def _fstring_end(source: str, i: int, quote: str) -> int | None:
    n = len(source)
    while i < n:
        if source.startswith(quote, i):
            return i + len(quote)
        c = source[i]
        if c == "\\":
            i += 2
        elif c == "{":
            if source.startswith("{{", i):
                i += 2
                continue
            depth = 1
            i += 1
            while i < n and depth:
                c = source[i]
                if c in "'\"":
                    m = re.compile("(?:[fF])?" + _STRING.pattern).match(source, i)
                    if not m:
                        return None
                    i = m.end()
                    continue
                depth += (c in "{[(") - (c in ")]}")
                if c == "\n" and len(quote) == 1:
                    return None
                i += 1
        elif c == "\n" and len(quote) == 1:
            return None
        else:
            i += 1
    return None


def _check(source: str, tokens: list[str]) -> list[Fault]:
    faults: list[Fault] = []
    lines = "".join(map(KINDS.__getitem__, tokens)).split("\n")
    if source[:1] == "\ufeff" and lines[0][:1] == "?":
        lines[0] = lines[0][1:]
    indents = [t.lstrip("\r\n") for t in tokens if t[0] in "\r\n"]
    first = source.lstrip("\ufeff")
    indents.insert(0, first[: len(first) - len(first.lstrip(" \t\f"))])
    # of each open block: column, alternative column, last compound clause, decorator pending, is a match block
    frames: list[list] = [[0, 0, "", False, False]]
    wants = ""  # type of the header whose block must begin
    opened = ""  # brackets open at the end of the physical line before
    joined: list[str] = []
    begun = 0
    for number, kinds in enumerate(lines):
        if not kinds:
            continue
        if not joined:
            begun = number
        found = BRACKETS[kinds]
        if found is None or len(found[0]) > len(opened) or found[0] != opened[len(opened) - len(found[0]) :][::-1]:
            faults.append(Fault(number + 1, "closing bracket does not match"))
            joined, opened, wants = [], "", ""
            continue
        opened = opened[: len(opened) - len(found[0])] + found[1]
        if opened:
            joined.append(kinds)
            continue
        if joined:
            joined.append(kinds)
            kinds = "".join(joined)
            joined = []
        indent = indents[begun]
        col, alt = (len(indent), len(indent)) if not indent or indent.isspace() and "\t" not in indent and "\f" not in indent else _column(indent)
        message = ""
        top = frames[-1]
        if col == top[0]:
            if wants:
                message = f"expected an indented block after '{wants}'"
            elif alt != top[1]:
                message = "inconsistent use of tabs and spaces"
        elif col > top[0]:
            if not wants:
                message = "unexpected indent"
            elif alt <= top[1]:
                message = "inconsistent use of tabs and spaces"
            top = [col, alt, "", False, wants == "M"]
            frames.append(top)
        else:
            if wants:
                message = f"expected an indented block after '{wants}'"
            while frames[-1][0] > col:
                gone = frames.pop()
                if gone[2] == "t":
                    message = message or "expected 'except' or 'finally' block"
                if gone[3]:
                    message = message or "expected a definition after a decorator"
            top = frames[-1]
            if top[0] != col:
                message = message or "unindent does not match any outer indentation level"
                frames.append(top := [col, alt, "", False, False])
            elif top[1] != alt:
                message = message or "inconsistent use of tabs and spaces"
        kind, block, at, said = LINES[kinds]
        message = message or said
        last = top[2]
        if kind == "C" and not top[4] or top[4] and kind not in "C?":
            message = message or "'case' belongs into 'match' and nothing else does"
        if last == "t" and kind not in "xy":
            message = message or "expected 'except' or 'finally' block"
        if top[3] and kind not in "dc@?":
            message = message or "expected a definition after a decorator"
        top[3] = kind == "@"
        if kind == "e":
            if last not in ("i", "e"):
                message = message or "'elif' without 'if'"
        elif kind == "l":
            if last not in ("i", "e", "f", "w", "x"):
                message = message or "'else' without a statement it belongs to"
            kind = "L" if last == "x" else "E"
        elif kind == "x":
            if last not in ("t", "x"):
                message = message or "'except' without 'try'"
        elif kind == "y" and last not in ("t", "x", "L"):
            message = message or "'finally' without 'try'"
        top[2] = kind if kind not in "s@?" else ""
        wants = kind if block else ""
        if message:
            faults.append(Fault(begun + 1, message))
    if opened:
        faults.append(Fault(begun + 1, "bracket was never closed"))
    elif wants:
        faults.append(Fault(len(lines), "expected an indented block at the end"))
    elif any(f[2] == "t" for f in frames):
        faults.append(Fault(len(lines), "expected 'except' or 'finally' block"))
    elif any(f[3] for f in frames):
        faults.append(Fault(len(lines), "expected a definition after a decorator"))
    if tokens and tokens[-1] == "\\":
        faults.append(Fault(len(lines), "unexpected end of file after line continuation"))
    return faults
