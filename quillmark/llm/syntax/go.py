"""Go: recursive descent with precedence climbing and panic-mode recovery at statements and declarations."""

from __future__ import annotations

import re

from quillmark.llm.syntax.base import Descent, Fault, Wrong
from quillmark.llm.syntax.lexer import Tokens, faults, faulty

_WORDS = {
    "break": "b", "case": "7", "chan": "H", "const": "c", "continue": "C", "default": "D", "defer": "g", "else": "2", "fallthrough": "t",
    "for": "3", "func": "f", "go": "g", "goto": "G", "if": "1", "import": "i", "interface": "I", "map": "M", "package": "k", "range": "R",
    "return": "r", "select": "s", "struct": "S", "switch": "6", "type": "T", "var": "v",
}
_OPS = {
    "...": "e", ":=": "d", "<-": "<", "++": "+", "--": "+", "&&": "a", "||": "o", "==": "q", "!=": "q", "<=": "q", ">=": "q", "<": "q", ">": "q",
    "+": "p", "-": "p", "|": "|", "^": "^", "*": "*", "/": "m", "%": "m", "<<": "m", ">>": "m", "&": "&", "&^": "m", "!": "!", "~": "~",
    "=": "=", ".": ".",
}
_OPS |= {op + "=": "A" for op in ("+", "-", "*", "/", "%", "<<", ">>", "&", "|", "^", "&^")}
_OPS |= {c: c for c in "()[]{},;:"}
_ESC = r"\\(?:[abfnrtv\\]|[0-7]{3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8})"
_TOKEN = re.compile(
    r"(?P<s>[ \t\r]+)|(?P<l>\n)|(?P<c>//[^\n]*)|(?P<b>/\*[\s\S]*?\*/)|(?P<n>[^\W\d]\w*)|"
    r"(?P<q>\"(?:[^\"\\\n]|" + _ESC + r"|\\\")*\"|`[^`]*`|'(?:[^'\\\n]|" + _ESC + r"|\\')')|"
    r"(?P<d>(?:0[xX](?:_?[0-9a-fA-F])+(?:\.(?:[0-9a-fA-F](?:_?[0-9a-fA-F])*)?)?[pP][+-]?\d(?:_?\d)*|0[xX]\.[0-9a-fA-F](?:_?[0-9a-fA-F])*[pP][+-]?\d(?:_?\d)*|"
    r"0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|"
    r"\d(?:_?\d)*\.(?:\d(?:_?\d)*)?(?:[eE][+-]?\d(?:_?\d)*)?|\.\d(?:_?\d)*(?:[eE][+-]?\d(?:_?\d)*)?|\d(?:_?\d)*[eE][+-]?\d(?:_?\d)*|0(?:_?[0-7])*|[1-9](?:_?\d)*|\d(?:_?\d)*(?=i))i?(?!\w))|"
    r"(?P<o>\.\.\.|:=|<-|\+\+|--|&&|\|\||==|!=|<=|>=|<<=|>>=|&\^=|<<|>>|&\^|[+\-*/%&|^]=|[{}()\[\],;:<>+\-*/%&|^!=.~])"
)
# a line break after these ends a statement
_ENDS = set("n0'bCtr+)]}")


def tokenize(source: str) -> Tokens:
    out = Tokens()
    kinds, at = out.kinds, out.at
    i, n = (1 if source.startswith("﻿") else 0), len(source)
    match = _TOKEN.match
    while i < n:
        m = match(source, i)
        if not m:
            out.bad.append((len(kinds), i, "invalid character or literal"))
            begin = i
            i, literal = faulty(source, i, ("`", "/*"))
            if literal:
                kinds.append("'" if source[begin] in "\"`" else "0")
                at.append(begin)
            continue
        what, text = m.lastgroup, m.group()
        if what == "l" or what == "b" and "\n" in text:
            if kinds and kinds[-1] in _ENDS:
                kinds.append(";")
                at.append(i)
        elif what in "nqdo":
            kinds.append(_OPS[text] if what == "o" else _WORDS.get(text, "n") if what == "n" else "'" if what == "q" and text[0] != "'" else "0")
            at.append(i)
        i = m.end()
    if kinds and kinds[-1] in _ENDS:
        kinds.append(";")
        at.append(n)
    return out


_POWER = {"o": 1, "a": 2, "q": 3, "p": 4, "|": 4, "^": 4, "*": 5, "m": 5, "&": 5}


class File(Descent):
    """Expressions return what they are: n name, a other operand that can be assigned, c call, t type or
    composite, r receive, x anything else.  ``level`` is below 0 in the head of a control clause, where a
    brace begins its block and not a composite literal."""

    def __init__(self, tokens: Tokens, source: str):
        super().__init__("".join(tokens.kinds))
        self.t, self.source, self.closes = tokens, source, tokens.closes
        self.level = 0
        self.faults: list[Wrong] = []

    def guarded(self, parse) -> None:
        begin, level = self.p, self.level
        try:
            parse()
        except Wrong as w:
            self.faults.append(w)
            self.level = level
            p = max(begin, min(w.at, len(self.k) - 5))
            while self.k[p] not in ";}\0":
                p = self.closes.get(p, p) + 1
            self.p = p + (self.k[p] == ";")
            if self.p == begin and self.k[p] != "\0":
                self.p += 1

    def end(self, closer: str = "}") -> None:
        """The semicolon after a statement, which may be left out before a closing bracket."""
        if self.k[self.p] != closer:
            self.need(";", "newline or ';'")

    # ---- declarations

    def file(self) -> None:
        if self.k[self.p] != "k":
            raise self.wrong("expected 'package'")
        self.p += 1
        self.need("n", "a name")
        self.end("\0")
        while self.k[self.p] == "i":
            self.guarded(self.import_)
        while self.k[self.p] != self.END:
            self.guarded(self.top)

    def import_(self) -> None:
        self.p += 1
        self.group(self.import_spec)
        self.end("\0")

    def import_spec(self) -> None:
        if self.k[self.p] in "n.":
            self.p += 1
        self.need("'", "an import path")

    def group(self, spec) -> None:
        if self.take("("):
            while not self.take(")"):
                spec()
                self.end(")")
        else:
            spec()

    def top(self) -> None:
        c = self.k[self.p]
        if c == "f":
            self.function()
        elif c in "cvT":
            self.declaration()
        elif c == "i":
            raise self.wrong("imports must appear before other declarations")
        elif c == ";":
            self.p += 1
            return
        else:
            raise self.wrong("non-declaration statement outside function body")
        self.end("\0")

    def declaration(self) -> None:
        c = self.k[self.p]
        self.p += 1
        self.group({"c": self.const_spec, "v": self.var_spec, "T": self.type_spec}[c])

    def names(self) -> None:
        self.need("n", "a name")
        while self.take(","):
            self.need("n", "a name")

    def const_spec(self) -> None:
        self.names()
        if self.k[self.p] not in "=;)":
            self.type()
        if self.take("="):
            self.expressions()

    def var_spec(self) -> None:
        self.names()
        if self.k[self.p] != "=":
            self.type()
        if self.take("="):
            self.expressions()

    def type_spec(self) -> None:
        self.need("n", "a name")
        if self.k[self.p] == "[" and self.k[self.p + 1] == "n" and self.k[self.p + 2] != "]":
            begin = self.p
            try:
                self.type_parameters()
                self.take("=")
                self.type()
                return
            except Wrong:
                self.p = begin
        self.take("=")
        self.type()

    def type_parameters(self) -> None:
        self.need("[")
        while True:
            self.names()
            self.constraint()
            if not self.take(","):
                break
            if self.k[self.p] == "]":
                break
        self.need("]", "']'")

    def constraint(self) -> None:
        while True:
            self.take("~")
            self.type()
            if not self.take("|"):
                return

    def function(self) -> None:
        self.p += 1
        if self.k[self.p] == "(":
            self.parameters()
        self.need("n", "a name")
        if self.k[self.p] == "[":
            self.type_parameters()
        self.signature()
        if self.k[self.p] == "{":
            self.body()

    def body(self) -> None:
        level, self.level = self.level, 0
        self.block()
        self.level = level

    def signature(self) -> None:
        self.parameters()
        if self.k[self.p] == "(":
            self.parameters()
        elif self.type_ahead():
            self.type()

    def type_ahead(self) -> bool:
        c = self.k[self.p]
        return c in "n[SIMHf*(" or c == "<" and self.k[self.p + 1] == "H"

    def parameters(self) -> None:
        self.need("(")
        named = typed = 0
        while self.k[self.p] != ")":
            if self.take("e"):
                self.type()
                typed += 1
            else:
                begin = self.p
                self.type()
                one_name = self.p == begin + 1 and self.k[begin] == "n"
                if self.k[begin] == "n" and self.k[begin + 1] == "[" and self.k[self.p] in ",)" and self.p > begin + 1:
                    # name []T or Generic[T]; both are types or names with a type
                    typed += 1
                elif self.k[self.p] not in ",)" and one_name:
                    self.take("e")
                    self.type()
                    named += 1
                elif self.k[self.p] not in ",)" and self.k[begin] == "n" and self.k[begin + 1] == "[":
                    self.p = begin + 1
                    self.type()
                    named += 1
                elif not one_name:
                    typed += 1
                if self.k[begin] == "n" and self.k[begin + 1] == "[" and typed and named:
                    typed -= 1
                    named += 1
            if self.k[self.p] != ")":
                self.need(",", "',' or ')'")
        if named and typed:
            raise self.wrong("mixed named and unnamed parameters")
        self.p += 1

    # ---- types

    def type(self) -> None:
        k = self.k
        c = k[self.p]
        if c == "n":
            self.p += 1
            if k[self.p] == "." and k[self.p + 1] == "n":
                self.p += 2
            if k[self.p] == "[" and k[self.p + 1] != "]" and self.type_arguments_ahead():
                self.p += 1
                while True:
                    self.type()
                    if not self.take(","):
                        break
                self.need("]", "']'")
        elif c == "*":
            self.p += 1
            self.type()
        elif c == "(":
            self.p += 1
            self.type()
            self.need(")", "')'")
        elif c == "[":
            self.p += 1
            if self.take("]"):
                self.type()
                return
            if not self.take("e"):
                level, self.level = self.level, self.level + 1 if self.level >= 0 else 1
                self.expression()
                self.level = level
            self.need("]", "']'")
            self.type()
        elif c == "M":
            self.p += 1
            self.need("[", "'['")
            self.type()
            self.need("]", "']'")
            self.type()
        elif c == "H":
            self.p += 1
            self.take("<")
            self.type()
        elif c == "<":
            self.p += 1
            self.need("H", "'chan'")
            self.type()
        elif c == "f":
            self.p += 1
            self.signature()
        elif c == "S":
            self.struct()
        elif c == "I":
            self.interface()
        else:
            raise self.wrong("expected a type")

    def type_arguments_ahead(self) -> bool:
        """Whether [..] after a type name holds types followed by an end, not an array's length."""
        begin = self.p
        self.p += 1
        try:
            while True:
                self.type()
                if not self.take(","):
                    break
            ok = self.k[self.p] == "]"
        except Wrong:
            ok = False
        self.p = begin
        return ok

    def struct(self) -> None:
        self.p += 1
        self.need("{", "'{'")
        while not self.take("}"):
            if self.take("*"):
                self.type()
            elif self.k[self.p] == "(":
                raise self.wrong("cannot parenthesize embedded type")
            elif self.k[self.p] == "n" and self.k[self.p + 1] in ".;}'":
                self.type()
            elif self.k[self.p] == "n" and self.k[self.p + 1] == "[" and self.generic_embedded():
                self.type()
            else:
                self.names()
                self.type()
            self.take("'")
            self.end()

    def generic_embedded(self) -> bool:
        begin = self.p
        try:
            self.type()
            ok = self.k[self.p] in ";}'" and self.k[begin + 2] != "]" and self.p > begin + 1
        except Wrong:
            ok = False
        self.p = begin
        return ok

    def interface(self) -> None:
        self.p += 1
        self.need("{", "'{'")
        while not self.take("}"):
            if self.k[self.p] == "n" and self.k[self.p + 1] == "(":
                self.p += 1
                self.signature()
            else:
                self.constraint()
            self.end()

    # ---- statements

    def block(self) -> None:
        self.need("{", "'{'")
        self.statements("}")
        self.need("}", "'}'")

    def statements(self, ends: str) -> None:
        while self.k[self.p] not in ends:
            if self.k[self.p] == self.END:
                raise self.wrong("unexpected end of file, expected '}'")
            self.guarded(self.one_statement)

    def one_statement(self) -> None:
        self.statement()
        if self.k[self.p] not in "}7D":
            self.need(";", "newline or ';' at the end of a statement")
        elif self.k[self.p] in "7D" and self.k[self.p - 1] != ";":
            raise self.wrong()

    def statement(self) -> None:
        k = self.k
        c = k[self.p]
        if c in ";}":
            return
        if c in "cvT":
            self.declaration()
        elif c == "{":
            self.body_block()
        elif c == "1":
            self.if_()
        elif c == "3":
            self.for_()
        elif c == "6":
            self.switch()
        elif c == "s":
            self.select()
        elif c == "r":
            self.p += 1
            if k[self.p] not in ";}":
                self.expressions()
        elif c in "bC":
            self.p += 1
            self.take("n")
        elif c == "G":
            self.p += 1
            self.need("n", "a label")
        elif c == "t":
            self.p += 1
        elif c == "g":
            self.p += 1
            if self.expression() != "c":
                raise self.wrong("expression in go or defer must be a function call")
        elif c == "n" and k[self.p + 1] == ":":
            self.p += 2
            if k[self.p] == "}":
                return
            self.statement()
        elif c == "f" and k[self.p + 1] == "n":
            raise self.wrong("unexpected name after func, expected '('")
        else:
            self.simple()

    def body_block(self) -> None:
        level, self.level = self.level, 0
        self.block()
        self.level = level

    def simple(self, ranges: bool = False) -> str:
        """A simple statement; R for a range clause, x for an expression, else s."""
        if ranges and self.take("R"):
            self.expression()
            return "R"
        begin = self.p
        what = [self.expression()]
        only_names = self.p == begin + 1
        while self.take(","):
            b = self.p
            what.append(self.expression())
            only_names &= self.p == b + 1
        c = self.k[self.p]
        if c == "d" or c == "=":
            if c == "d" and not (only_names and all(w == "n" for w in what)):
                raise self.wrong("non-name on left side of :=")
            self.p += 1
            if ranges and self.take("R"):
                self.expression()
                return "R"
            self.expressions()
            return "d" if c == "d" else "s"
        if len(what) > 1:
            raise self.wrong("expected := or = or comma")
        if c == "A":
            self.p += 1
            self.expression()
            return "s"
        if c == "+":
            self.p += 1
            return "s"
        if c == "<":
            self.p += 1
            self.expression()
            return "s"
        return "x"

    def header(self, needs_condition: bool) -> None:
        """[simple ;] [condition] of if and switch, up to the brace."""
        level, self.level = self.level, -1
        last = ""
        if self.k[self.p] != "{":
            if self.k[self.p] != ";":
                last = self.simple()
            if self.take(";"):
                last = ""
                if self.k[self.p] != "{":
                    last = self.simple()
        self.level = level
        if needs_condition and last != "x":
            raise self.wrong("missing condition" if not last else "cannot use a statement as value")

    def if_(self) -> None:
        self.p += 1
        self.header(True)
        self.body_block()
        if self.take("2"):
            if self.k[self.p] == "1":
                self.if_()
            elif self.k[self.p] == "{":
                self.body_block()
            else:
                raise self.wrong("else must be followed by if or a block")

    def for_(self) -> None:
        self.p += 1
        level, self.level = self.level, -1
        if self.k[self.p] != "{":
            what = ""
            if self.k[self.p] != ";":
                what = self.simple(True)
            if what != "R" and self.take(";"):
                if self.k[self.p] != ";":
                    if self.k[self.p] == "{":
                        raise self.wrong("expected for loop condition")
                    if self.simple() != "x":
                        raise self.wrong("cannot use a statement as value")
                self.need(";", "';'")
                if self.k[self.p] != "{" and self.simple() == "d":
                    raise self.wrong("cannot declare in the post statement of a for loop")
            elif what not in "Rx":
                raise self.wrong("expected for loop condition")
        self.level = level
        self.body_block()

    def switch(self) -> None:
        self.p += 1
        self.header(False)
        self.clauses(False)

    def select(self) -> None:
        self.p += 1
        self.clauses(True)

    def clauses(self, communicates: bool) -> None:
        level, self.level = self.level, 0
        self.need("{", "'{'")
        while not self.take("}"):
            if self.take("7"):
                if communicates:
                    self.simple()
                else:
                    while True:
                        self.type_or_expression()
                        if not self.take(","):
                            break
            elif not self.take("D"):
                raise self.wrong("expected case, default or '}'")
            self.need(":", "':'")
            self.statements("7D}")
        self.level = level

    # ---- expressions

    def expressions(self) -> None:
        self.expression()
        while self.take(","):
            self.expression()

    def type_or_expression(self) -> None:
        if self.k[self.p] in "MHSI[f":
            begin = self.p
            try:
                self.type()
                if self.k[self.p] in ",:)]":
                    return
            except Wrong:
                pass
            self.p = begin
        self.expression()

    def expression(self, least: int = 1) -> str:
        what = self.unary()
        while True:
            power = _POWER.get(self.k[self.p])
            if power is None or power < least:
                return what
            self.p += 1
            self.expression(power + 1)
            what = "x"

    def unary(self) -> str:
        c = self.k[self.p]
        if c in "p!^&~":
            self.p += 1
            self.unary()
            return "x"
        if c == "*":
            self.p += 1
            self.unary()
            return "a"
        if c == "<":
            if self.k[self.p + 1] == "H":
                begin = self.p
                try:
                    self.type()
                    return self.trailers("t")
                except Wrong:
                    self.p = begin
            self.p += 1
            self.unary()
            return "x"
        return self.primary()

    def primary(self) -> str:
        k = self.k
        c = k[self.p]
        if c == "n":
            self.p += 1
            what = "n"
        elif c in "'0":
            self.p += 1
            what = "x"
        elif c == "(":
            self.p += 1
            level, self.level = self.level, max(self.level, 0) + 1
            if k[self.p] in "*MHSI[f" or k[self.p] == "<" and k[self.p + 1] == "H":
                begin = self.p
                try:
                    self.type()
                    if k[self.p] != ")":
                        raise self.wrong()
                except Wrong:
                    self.p = begin
                    self.expression()
            else:
                self.expression()
            self.level = level
            self.need(")", "')'")
            what = "a"
        elif c == "f":
            self.p += 1
            self.signature()
            if k[self.p] == "{":
                self.body()
                what = "x"
            else:
                what = "t"
        elif c in "[MHSI":
            self.type()
            what = "t"
            if k[self.p] == "{":
                self.literal()
                what = "x"
            elif k[self.p] != "(" and k[self.p] not in ",)]:":
                raise self.wrong("a type is no expression")
        else:
            raise self.wrong("unexpected token, expected an expression")
        return self.trailers(what)

    def trailers(self, what: str) -> str:
        k = self.k
        while True:
            c = k[self.p]
            if c == ".":
                self.p += 1
                if self.take("("):
                    if not self.take("T"):
                        self.type()
                    self.need(")", "')'")
                    what = "x"
                else:
                    self.need("n", "a name or '('")
                    what = "s"
            elif c == "[":
                self.index()
                what = "i"
            elif c == "(":
                self.arguments()
                what = "c"
            elif c == "{" and (what in "nsi" and self.level >= 0):
                self.literal()
                what = "x"
            else:
                return what

    def index(self) -> None:
        self.p += 1
        level, self.level = self.level, max(self.level, 0) + 1
        k = self.k
        colons = 0
        if k[self.p] != ":":
            self.type_or_expression()
            while self.take(","):
                if k[self.p] == "]":
                    break
                self.type()
        while self.take(":"):
            colons += 1
            if k[self.p] not in ":]":
                self.expression()
            elif colons == 2 or k[self.p] == ":":
                raise self.wrong("index required in 3-index slice")
        if colons > 2:
            raise self.wrong()
        self.level = level
        self.need("]", "']'")

    def arguments(self) -> None:
        self.p += 1
        level, self.level = self.level, max(self.level, 0) + 1
        while self.k[self.p] != ")":
            self.type_or_expression()
            self.take("e")
            if self.k[self.p] != ")":
                self.need(",", "',' or ')'")
        self.level = level
        self.p += 1

    def literal(self) -> None:
        self.need("{")
        level, self.level = self.level, max(self.level, 0) + 1
        while self.k[self.p] != "}":
            self.value()
            if self.take(":"):
                self.value()
            if self.k[self.p] != "}":
                self.need(",", "',' or newline in composite literal")
        self.level = level
        self.p += 1

    def value(self) -> None:
        if self.k[self.p] == "{":
            self.literal()
        else:
            self.expression()


def check_go(source: str) -> list[Fault]:
    """All faults of a source, in order; none for a valid (or blank) one."""
    if not source.strip():
        return []
    tokens = tokenize(source)
    bad = tokens.match_brackets()
    unit = File(tokens, source)
    try:
        unit.file()
    except Wrong as w:
        if w not in unit.faults:
            unit.faults.append(w)
    except RecursionError:
        unit.faults.append(Wrong(unit.p, "nested too deeply"))
    if bad and not tokens.bad and not unit.faults:
        unit.faults.append(Wrong(*bad))
    return faults(source, tokens, unit.faults)
