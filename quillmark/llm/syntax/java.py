"""Java 17: recursive descent with precedence climbing and panic-mode recovery at statements and members."""

from __future__ import annotations

import re

from quillmark.llm.syntax.base import Descent, Fault, Wrong
from quillmark.llm.syntax.lexer import Tokens, faults, faulty

_WORDS = {
    "abstract": "M", "final": "f", "native": "M", "private": "M", "protected": "M", "public": "M", "static": "s", "strictfp": "M",
    "synchronized": "Y", "transient": "M", "volatile": "M", "default": "D", "boolean": "P", "byte": "P", "char": "P", "short": "P",
    "int": "P", "long": "P", "float": "P", "double": "P", "void": "V", "class": "C", "interface": "I", "enum": "E", "extends": "x",
    "implements": "m", "package": "k", "import": "i", "throws": "W", "if": "1", "else": "2", "for": "3", "while": "4", "do": "5",
    "switch": "6", "case": "7", "break": "b", "continue": "c", "return": "r", "throw": "t", "try": "T", "catch": "h", "finally": "y",
    "new": "N", "this": "K", "super": "U", "instanceof": "O", "assert": "A", "true": "K", "false": "K", "null": "K", "goto": "!", "const": "!",
    "_": "!",
}
_OPS = {
    "->": ">", "::": "d", "...": "e", "++": "+", "--": "+", "&&": "&", "||": "|", "==": "q", "!=": "q", "<=": "l", ">=": "l", "<<": "z",
    "<": "<", ">": "g", "+": "a", "-": "a", "*": "*", "/": "/", "%": "/", "&": "w", "|": "v", "^": "^", "!": "u", "~": "u", "?": "Q", "=": "=",
    ".": ".", "@": "@",
}
_OPS |= {op + "=": "S" for op in ("+", "-", "*", "/", "%", "<<", "&", "|", "^")}
_OPS |= {c: c for c in "()[]{},;:"}
_CHARS = r"(?:[^'\\\n\r]|\\(?:[btnfrs\"'\\]|[0-7]{1,3}|u+[0-9a-fA-F]{4}))"
_TOKEN = re.compile(
    r"(?P<s>[\s\x1a]+|//[^\n\r]*|/\*[\s\S]*?\*/)|(?P<n>(?:[^\W\d]|[$])[\w$]*)|"
    r"(?P<q>\"\"\"[ \t\f]*\r?\n(?:[^\"\\]|\\(?:[btnfrs\"'\\\n]|\r\n|[0-7]{1,3}|u+[0-9a-fA-F]{4})|\"(?!\"\"))*\"\"\"|"
    r"\"(?:[^\"\\\n\r]|\\(?:[btnfrs\"'\\]|[0-7]{1,3}|u+[0-9a-fA-F]{4}))*\"|'" + _CHARS + r"')|"
    r"(?P<d>(?:0[xX](?:[0-9a-fA-F](?:[0-9a-fA-F_]*[0-9a-fA-F])?\.?|(?:[0-9a-fA-F](?:[0-9a-fA-F_]*[0-9a-fA-F])?)?\.[0-9a-fA-F](?:[0-9a-fA-F_]*[0-9a-fA-F])?)[pP][+-]?\d(?:[\d_]*\d)?[fFdD]?|"
    r"0[xX][0-9a-fA-F](?:[0-9a-fA-F_]*[0-9a-fA-F])?[lL]?|0[bB][01](?:[01_]*[01])?[lL]?|"
    r"(?:\d(?:[\d_]*\d)?\.(?:\d(?:[\d_]*\d)?)?|\.\d(?:[\d_]*\d)?)(?:[eE][+-]?\d(?:[\d_]*\d)?)?[fFdD]?|\d(?:[\d_]*\d)?(?:[eE][+-]?\d(?:[\d_]*\d)?[fFdD]?|[fFdD])|"
    r"0(?:[0-7_]*[0-7])?[lL]?|[1-9](?:[\d_]*\d)?[lL]?)(?![\w$]))|"
    r"(?P<o>\.\.\.|->|::|\+\+|--|&&|\|\||==|!=|<=|<<=|<<|[+\-*/%&|^]=|[{}()\[\],;:<>+\-*/%&|^!~?=.@])"
)


def tokenize(source: str) -> Tokens:
    out = Tokens()
    kinds, at = out.kinds, out.at
    i, n = 0, len(source)
    if source.startswith("\ufeff"):
        out.bad.append((0, 0, "illegal character"))
        i = 1
    match = _TOKEN.match
    while i < n:
        m = match(source, i)
        if not m:
            out.bad.append((len(kinds), i, "illegal character or unclosed literal"))
            begin = i
            i, literal = faulty(source, i, ('"""', "/*"))
            if literal:
                kinds.append("0")
                at.append(begin)
            continue
        what = m.lastgroup
        if what != "s":
            text = m.group()
            kinds.append(_OPS[text] if what == "o" else _WORDS.get(text, "n") if what == "n" else "0")
            at.append(i)
        i = m.end()
    return out


_POWER = {"|": 1, "&": 2, "v": 3, "^": 4, "w": 5, "q": 6, "<": 7, "g": 7, "l": 7, "O": 7, "z": 8, "a": 9, "*": 10, "/": 10}
_MODIFIERS = "MfsYD@"


class Unit(Descent):
    """Expressions return what they are: n name, a field or element, c call or creation (a statement),
    i increment or assignment (a statement), x anything else."""

    def __init__(self, tokens: Tokens, source: str):
        super().__init__("".join(tokens.kinds))
        self.t, self.source, self.closes = tokens, source, tokens.closes
        self.faults: list[Wrong] = []
        self.owners = [""]  # names of the enclosing classes

    def text(self, p: int) -> str:
        if p >= len(self.t.at):
            return ""
        m = _TOKEN.match(self.source, self.t.at[p])
        return m.group() if m else ""

    def word(self, name: str, p: int | None = None) -> bool:
        p = self.p if p is None else p
        return self.k[p] == "n" and self.text(p) == name

    def guarded(self, parse) -> None:
        begin, depth = self.p, len(self.owners)
        try:
            parse()
        except Wrong as w:
            self.faults.append(w)
            p = max(begin, min(w.at, len(self.k) - 5))
            while self.k[p] not in ";}\0":
                p = self.closes.get(p, p) + 1
            del self.owners[depth:]
            self.p = p + (self.k[p] == ";")
            if self.p == begin and self.k[p] != "\0":
                self.p += 1

    # ---- types

    def qualified(self) -> None:
        self.need("n", "a name")
        while self.k[self.p] == "." and self.k[self.p + 1] == "n":
            self.p += 2

    def annotations(self) -> None:
        while self.k[self.p] == "@" and self.k[self.p + 1] == "n":
            self.p += 1
            self.qualified()
            if self.take("("):
                if not self.take(")"):
                    while True:
                        if self.k[self.p] == "n" and self.k[self.p + 1] == "=":
                            self.p += 2
                        self.element()
                        if not self.take(","):
                            break
                    self.need(")")

    def element(self) -> None:
        if self.k[self.p] == "@":
            self.annotations()
        elif self.take("{"):
            while not self.take("}"):
                if self.take(","):
                    continue
                self.element()
                if self.k[self.p] != "}":
                    self.need(",")
        else:
            self.ternary()

    def type(self, arrays: bool = True) -> None:
        self.annotations()
        if self.k[self.p] == "P":
            self.p += 1
        else:
            while True:
                self.need("n", "a type")
                if self.k[self.p] == "<":
                    self.type_arguments()
                if self.k[self.p] == "." and self.k[self.p + 1] in "n@":
                    self.p += 1
                    self.annotations()
                else:
                    break
        if arrays:
            self.dimensions()

    def dimensions(self) -> int:
        n = 0
        while True:
            if self.k[self.p] == "@":
                self.annotations()
            if self.k[self.p] == "[" and self.k[self.p + 1] == "]":
                self.p += 2
                n += 1
            else:
                return n

    def type_arguments(self) -> None:
        self.need("<")
        if self.take("g"):
            return
        while True:
            self.annotations()
            if self.take("Q"):
                if self.take("x") or self.take("U"):
                    self.type()
            else:
                self.type()
            if not self.take(","):
                break
        self.need("g", "'>'")

    def type_parameters(self) -> None:
        self.need("<")
        while True:
            self.annotations()
            self.need("n")
            if self.take("x"):
                self.type()
                while self.take("w"):
                    self.type()
            if not self.take(","):
                break
        self.need("g", "'>'")

    def try_type(self) -> bool:
        begin = self.p
        try:
            self.type()
            return True
        except Wrong:
            self.p = begin
            return False

    # ---- declarations

    def unit(self) -> None:
        while self.k[self.p] != self.END:
            self.guarded(self.top)

    def top(self) -> None:
        begin = self.p
        if self.take(";"):
            return
        if self.k[self.p] == "i":
            self.p += 1
            self.take("s")
            self.qualified()
            if self.take("."):
                self.need("*")
            self.need(";", "';'")
            return
        self.annotations_and_modifiers()
        if self.k[self.p] == "k":
            if any(c not in "@n.()0" for c in self.k[begin : self.p]):
                raise self.wrong()
            self.p += 1
            self.qualified()
            self.need(";", "';'")
        elif not self.type_declaration():
            if self.word("module") or self.word("open"):
                self.p = len(self.k) - 4
                return
            raise self.wrong("class, interface, enum, or record expected")

    def annotations_and_modifiers(self) -> None:
        while True:
            c = self.k[self.p]
            if c == "@" and self.k[self.p + 1] == "n":
                self.annotations()
            elif c in "MfsY" or c == "D" and self.k[self.p + 1] != ":" and self.k[self.p + 1] != ">":
                self.p += 1
            elif c == "n" and self.k[self.p + 1] in "nMCIsf@" and self.text(self.p) == "sealed":
                self.p += 1
            elif c == "n" and self.k[self.p + 1] == "a" and self.text(self.p) == "non" and self.word("sealed", self.p + 2):
                self.p += 3
            else:
                return

    def type_declaration(self) -> bool:
        c = self.k[self.p]
        owner = self.text(self.p + (2 if c == "@" else 1))
        if c == "C":
            self.p += 1
            self.need("n", "a name")
            if self.k[self.p] == "<":
                self.type_parameters()
            if self.take("x"):
                self.type(False)
            self.types_after("m")
            self.permits()
            self.class_body(owner)
        elif c == "I" or c == "@" and self.k[self.p + 1] == "I":
            self.p += 1 + (c == "@")
            self.need("n", "a name")
            if self.k[self.p] == "<":
                self.type_parameters()
            self.types_after("x")
            self.permits()
            self.class_body(owner)
        elif c == "E":
            self.p += 1
            self.need("n", "a name")
            self.types_after("m")
            self.enum_body(owner)
        elif c == "n" and self.k[self.p + 1] == "n" and self.k[self.p + 2] in "(<" and self.text(self.p) == "record":
            self.p += 2
            if self.k[self.p] == "<":
                self.type_parameters()
            self.need("(")
            self.parameters()
            self.types_after("m")
            self.class_body(owner)
        else:
            return False
        return True

    def types_after(self, kind: str) -> None:
        if self.take(kind):
            self.type(False)
            while self.take(","):
                self.type(False)

    def permits(self) -> None:
        if self.word("permits"):
            self.p += 1
            self.type(False)
            while self.take(","):
                self.type(False)

    def enum_body(self, owner: str) -> None:
        self.need("{")
        self.owners.append(owner)
        while self.k[self.p] in "n@":
            self.annotations()
            self.need("n")
            if self.k[self.p] == "(":
                self.arguments()
            if self.k[self.p] == "{":
                self.class_body()
            if not self.take(","):
                break
        if self.take(";"):
            while self.k[self.p] not in "}\0":
                self.guarded(self.member)
        self.owners.pop()
        self.need("}", "'}'")

    def class_body(self, owner: str = "") -> None:
        self.need("{", "'{'")
        self.owners.append(owner)
        while not self.take("}"):
            if self.k[self.p] == self.END:
                raise self.wrong("reached end of file while parsing")
            self.guarded(self.member)
        self.owners.pop()

    def member(self) -> None:
        if self.take(";"):
            return
        if self.k[self.p] == "{" or self.k[self.p] == "s" and self.k[self.p + 1] == "{":
            self.take("s")
            self.block()
            return
        self.annotations_and_modifiers()
        if self.type_declaration():
            return
        if self.k[self.p] == "<":
            self.type_parameters()
            self.annotations()
        if self.k[self.p] == "n" and self.k[self.p + 1] == "(":
            if self.text(self.p) != self.owners[-1]:
                raise self.wrong("invalid method declaration; return type required")
            self.p += 2
            self.parameters()
            self.method_rest()
            return
        if self.k[self.p] == "n" and self.k[self.p + 1] == "{":  # compact constructor
            self.p += 1
            self.block()
            return
        if not self.take("V"):
            self.type()
        self.need("n", "a name")
        if self.take("("):
            self.parameters()
            self.dimensions()
            self.method_rest()
            return
        self.variables_rest()
        self.need(";", "';'")

    def method_rest(self) -> None:
        self.types_after("W")
        if self.take("D"):
            self.element()
        if not self.take(";"):
            if self.k[self.p] != "{":
                raise self.wrong("expected '{' or ';'")
            self.block()

    def parameters(self) -> None:
        if self.take(")"):
            return
        while True:
            self.annotations_and_modifiers()
            self.type()
            self.annotations()
            self.take("e")
            if self.take("K"):
                pass
            else:
                self.need("n", "a name")
                if self.k[self.p] == "." and self.k[self.p + 1] == "K":
                    self.p += 2
            self.dimensions()
            if not self.take(","):
                break
        self.need(")", "')'")

    def variables_rest(self) -> None:
        """What follows the first variable's name."""
        while True:
            self.dimensions()
            if self.take("="):
                self.initializer()
            if not self.take(","):
                return
            self.need("n", "a name")

    def initializer(self) -> None:
        if self.take("{"):
            while not self.take("}"):
                if self.k[self.p] == "," and self.k[self.p + 1] == "}":
                    self.p += 1
                    continue
                self.initializer()
                if self.k[self.p] != "}":
                    self.need(",", "',' or '}'")
        else:
            self.expression()

    # ---- statements

    def block(self) -> None:
        self.need("{", "'{'")
        while not self.take("}"):
            if self.k[self.p] == self.END:
                raise self.wrong("reached end of file while parsing")
            self.guarded(self.block_statement)

    def block_statement(self) -> None:
        k = self.k
        c = k[self.p]
        if c in "Mfs@" or c in "CIE" or c == "n" and k[self.p + 1] in "nfMCIs":
            begin = self.p
            self.annotations_and_modifiers()
            if self.type_declaration():
                return
            if k[self.p] in "Pn":
                if self.word("yield", begin) and self.p == begin and k[self.p + 1] == "n" and k[self.p + 2] not in "=;,[:":
                    self.statement()
                    return
                self.local_variable()
                return
            raise self.wrong("illegal start of expression")
        if c == "P" or c == "n" and self.local_ahead():
            self.local_variable()
            return
        self.statement()

    def local_ahead(self) -> bool:
        begin = self.p
        ok = self.try_type() and self.k[self.p] == "n" and self.k[self.p + 1] in "=;,[:"
        self.p = begin
        return ok

    def local_variable(self) -> None:
        begin = self.p
        if self.k[self.p] == "P" and self.k[self.p + 1] in ".d[" and not self.local_ahead():
            self.statement()
            return
        self.p = begin
        self.type()
        self.need("n", "a name")
        self.variables_rest()
        self.need(";", "';'")

    def condition(self) -> None:
        self.need("(", "'('")
        self.expression()
        self.need(")", "')'")

    def statement(self) -> None:
        k = self.k
        c = k[self.p]
        if c == "{":
            self.block()
        elif c == ";":
            self.p += 1
        elif c == "1":
            self.p += 1
            self.condition()
            self.statement()
            if self.take("2"):
                self.statement()
        elif c == "3":
            self.for_loop()
        elif c == "4":
            self.p += 1
            self.condition()
            self.statement()
        elif c == "5":
            self.p += 1
            self.statement()
            self.need("4", "'while'")
            self.condition()
            self.need(";", "';'")
        elif c == "6":
            self.switch()
            if k[self.p] in ".[":  # a switch expression used as a statement's beginning
                raise self.wrong("not a statement")
        elif c in "bc":
            self.p += 1
            self.take("n")
            self.need(";", "';'")
        elif c == "r":
            self.p += 1
            if k[self.p] != ";":
                self.expression()
            self.need(";", "';'")
        elif c == "t":
            self.p += 1
            self.expression()
            self.need(";", "';'")
        elif c == "A":
            self.p += 1
            self.expression()
            if self.take(":"):
                self.expression()
            self.need(";", "';'")
        elif c == "Y" and k[self.p + 1] == "(":
            self.p += 1
            self.condition()
            self.block()
        elif c == "T":
            self.try_()
        elif c == "n" and k[self.p + 1] == ":":
            self.p += 2
            self.statement()
        elif c == "n" and k[self.p + 1] not in "=.([+S;)dg<" and self.text(self.p) == "yield":
            self.p += 1
            self.expression()
            self.need(";", "';'")
        else:
            if self.expression() not in "ci":
                raise self.wrong("not a statement")
            self.need(";", "';'")

    def for_loop(self) -> None:
        self.p += 1
        self.need("(", "'('")
        k = self.k
        if k[self.p] != ";":
            begin = self.p
            self.annotations_and_modifiers()
            declared = self.p > begin or k[self.p] == "P" or k[self.p] == "n" and self.local_ahead()
            if declared:
                self.type()
                self.need("n", "a name")
                if self.take(":"):
                    self.expression()
                    self.need(")", "')'")
                    self.statement()
                    return
                self.variables_rest()
            else:
                self.statement_expressions()
        self.need(";", "';'")
        if k[self.p] != ";":
            self.expression()
        self.need(";", "';'")
        if k[self.p] != ")":
            self.statement_expressions()
        self.need(")", "')'")
        self.statement()

    def statement_expressions(self) -> None:
        while True:
            if self.expression() not in "ci":
                raise self.wrong("not a statement")
            if not self.take(","):
                return

    def try_(self) -> None:
        self.p += 1
        k = self.k
        resources = self.take("(")
        if resources:
            while True:
                begin = self.p
                self.annotations_and_modifiers()
                if self.p > begin or self.local_ahead():
                    self.type()
                    self.need("n")
                    self.need("=")
                    self.expression()
                else:
                    self.expression()
                if not self.take(";"):
                    break
                if k[self.p] == ")":
                    break
            self.need(")", "')'")
        self.block()
        caught = False
        while self.take("h"):
            caught = True
            self.need("(", "'('")
            self.annotations_and_modifiers()
            self.type(False)
            while self.take("v"):
                self.type(False)
            self.need("n", "a name")
            self.need(")", "')'")
            self.block()
        if self.take("y"):
            self.block()
        elif not caught and not resources:
            raise self.wrong("'try' without 'catch', 'finally' or resource declarations")

    def switch(self) -> None:
        self.p += 1
        self.condition()
        self.need("{", "'{'")
        while not self.take("}"):
            if self.take("7"):
                while True:
                    if self.k[self.p] != "D":
                        self.binary(1)
                        if self.take("Q"):
                            self.binary(1)
                            self.need(":", "':'")
                            self.binary(1)
                    else:
                        self.p += 1
                    if not self.take(","):
                        break
            elif not self.take("D"):
                raise self.wrong("expected case, default or '}'")
            if self.take(">"):
                if self.k[self.p] == "{":
                    self.block()
                elif self.k[self.p] == "t":
                    self.statement()
                else:
                    self.expression()
                    self.need(";", "';'")
            else:
                self.need(":", "':' or '->'")
                while self.k[self.p] not in "7D}\0":
                    self.guarded(self.block_statement)
                if self.k[self.p] == self.END:
                    raise self.wrong("reached end of file while parsing")

    # ---- expressions

    def expression(self) -> str:
        what = self.ternary()
        c = self.k[self.p]
        if c in "=S" or c == "g" and self.shift_assign():
            self.p += 1
            self.expression()
            return "i"
        return what

    def shift_assign(self) -> bool:
        """>>=, >>>= and >= come as single '>' and an '='."""
        p = self.p
        at = self.t.at
        while self.k[p] == "g" and p + 1 < len(at) and at[p + 1] == at[p] + 1:
            p += 1
        if p - self.p >= 2 and self.k[p] == "=":
            self.p = p
            return True
        return False

    def lambda_ahead(self) -> bool:
        k = self.k
        return k[self.p] == "n" and k[self.p + 1] == ">" or k[self.p] == "(" and self.p in self.closes and k[self.closes[self.p] + 1] == ">"

    def lambda_(self) -> None:
        if self.take("n"):
            pass
        else:
            self.p += 1
            if self.k[self.p] == "n" and self.k[self.p + 1] in ",)":
                self.p += 1
                while self.take(","):
                    self.need("n", "a name")
                self.need(")", "')'")
            else:
                self.parameters()
        self.need(">", "'->'")
        if self.k[self.p] == "{":
            self.block()
        else:
            self.expression()

    def ternary(self) -> str:
        if self.lambda_ahead():
            self.lambda_()
            return "x"
        what = self.binary(1)
        if self.take("Q"):
            self.expression()
            self.need(":", "':'")
            self.ternary()
            return "x"
        return what

    def binary(self, least: int) -> str:
        what = self.unary()
        k, at = self.k, self.t.at
        while True:
            c = k[self.p]
            power, width = _POWER.get(c), 1
            if c == "g":
                while k[self.p + width] == "g" and width < 3 and at[self.p + width] == at[self.p] + width:
                    width += 1
                if k[self.p + width] == "=" and at[self.p + width] == at[self.p] + width:
                    if width > 1:
                        return what
                    width, power = 2, 7
                elif width > 1:
                    power = 8
            if power is None or power < least:
                return what
            self.p += width
            if c == "O":
                if k[self.p] == "f" or k[self.p] == "@":
                    self.annotations_and_modifiers()
                self.type()
                self.take("n")
            elif self.lambda_ahead():
                raise self.wrong("a lambda cannot stand here")
            else:
                self.binary(power + 1)
            what = "x"

    def unary(self) -> str:
        k = self.k
        c = k[self.p]
        if c in "au":
            self.p += 1
            self.unary()
            return "x"
        if c == "+":
            self.p += 1
            self.unary()
            return "i"
        if c == "(" and self.cast():
            return "x"
        what = self.postfix()
        while k[self.p] == "+":
            self.p += 1
            what = "i"
        return what

    def cast(self) -> bool:
        begin = self.p
        close = self.closes.get(begin)
        if close is None:
            return False
        self.p += 1
        k = self.k
        primitive = k[self.p] == "P" and close == self.p + 1
        if not self.try_type():
            self.p = begin
            return False
        try:
            while self.take("w"):
                self.type()
        except Wrong:
            self.p = begin
            return False
        after = k[close + 1]
        if self.p == close and (primitive or after in "n(u0KUN6P" or k[self.p - 1] == "]" and after in "n("):
            self.p = close + 1
            if self.lambda_ahead():
                self.lambda_()
            else:
                self.unary()
            return True
        self.p = begin
        return False

    def arguments(self) -> None:
        self.need("(")
        if self.take(")"):
            return
        while True:
            self.expression()
            if not self.take(","):
                break
        self.need(")", "')' or ','")

    def postfix(self) -> str:
        k = self.k
        what = self.primary()
        while True:
            c = k[self.p]
            if c == ".":
                self.p += 1
                if k[self.p] == "<":
                    self.type_arguments()
                if k[self.p] == "n" or k[self.p] == "U":
                    self.p += 1
                    if k[self.p] == "(":
                        self.arguments()
                        what = "c"
                    else:
                        what = "a"
                elif k[self.p] == "K" or k[self.p] == "C":
                    self.p += 1
                    what = "x"
                elif k[self.p] == "N":
                    self.creation()
                    what = "c"
                else:
                    raise self.wrong("expected a name after '.'")
            elif c == "[":
                if k[self.p + 1] == "]":
                    self.dimensions()
                    if k[self.p] == "." and k[self.p + 1] == "C":
                        self.p += 2
                        what = "x"
                        continue
                    if k[self.p] != "d":
                        raise self.wrong("expected .class or ::")
                    continue
                self.p += 1
                self.expression()
                self.need("]", "']'")
                what = "a"
            elif c == "d":
                self.p += 1
                if k[self.p] == "<":
                    self.type_arguments()
                if k[self.p] not in "nN":
                    raise self.wrong("expected a name after '::'")
                self.p += 1
                return "x"
            elif c == "<" and what in "na" and self.generic_reference():
                continue
            else:
                return what

    def generic_reference(self) -> bool:
        """Type arguments before ``::``, as in List<String>::new."""
        begin = self.p
        try:
            self.type_arguments()
            while self.k[self.p] == "." and self.k[self.p + 1] == "n":
                self.p += 2
                if self.k[self.p] == "<":
                    self.type_arguments()
            self.dimensions()
            if self.k[self.p] == "d":
                return True
        except Wrong:
            pass
        self.p = begin
        return False

    def creation(self) -> None:
        k = self.k
        self.p += 1
        if k[self.p] == "<":
            self.type_arguments()
        self.type(False)
        if k[self.p] == "@":
            self.annotations()
        if k[self.p] == "[":
            if k[self.p + 1] == "]":
                self.dimensions()
                if k[self.p] != "{":
                    raise self.wrong("array dimension missing")
                self.initializer()
                return
            while k[self.p] == "[" and k[self.p + 1] != "]":
                self.p += 1
                self.expression()
                self.need("]", "']'")
            self.dimensions()
            return
        self.arguments()
        if k[self.p] == "{":
            self.class_body()

    def primary(self) -> str:
        k = self.k
        c = k[self.p]
        if c == "n":
            self.p += 1
            if k[self.p] == "(":
                self.arguments()
                return "c"
            return "n"
        if c == "0":
            self.p += 1
            return "x"
        if c == "K" or c == "U":
            self.p += 1
            if k[self.p] == "(":
                self.arguments()
                return "c"
            if c == "U" and k[self.p] not in ".d":
                raise self.wrong("'.' expected")
            return "x"
        if c == "(":
            self.p += 1
            what = self.expression()
            self.need(")", "')'")
            return what if what in "na" else "x"
        if c == "N":
            begin = self.p
            self.creation()
            return "c" if k[self.p - 1] in ")}" and "[" not in k[begin : begin + 3] else "x"
        if c == "6":
            self.switch()
            return "x"
        if c in "PV":
            self.p += 1
            self.dimensions()
            if k[self.p] == "." and k[self.p + 1] == "C":
                self.p += 2
                return "x"
            if k[self.p] == "d" and k[self.p - 1] == "]":
                return "x"
        raise self.wrong("illegal start of expression")


def check_java(source: str) -> list[Fault]:
    """All faults of a source, in order; none for a valid (or blank) one."""
    tokens = tokenize(source)
    bad = tokens.match_brackets()
    unit = Unit(tokens, source)
    try:
        unit.unit()
    except Wrong as w:
        if w not in unit.faults:
            unit.faults.append(w)
    except RecursionError:
        unit.faults.append(Wrong(unit.p, "nested too deeply"))
    if bad and not tokens.bad and not unit.faults:
        unit.faults.append(Wrong(*bad))
    return faults(source, tokens, unit.faults)
