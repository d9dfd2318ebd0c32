"""JavaScript (a script, not a module): recursive descent with precedence climbing.

After a fault the parser skips to the next statement of the block (panic mode).
"""

from __future__ import annotations

import re

from quillmark.llm.syntax.base import Descent, Fault, Wrong
from quillmark.llm.syntax.lexer import Tokens, faults, faulty

_WORDS = {
    "var": "v", "let": "e", "const": "c", "function": "f", "return": "r", "if": "i", "else": "l", "for": "F", "while": "w", "do": "d",
    "break": "b", "continue": "C", "switch": "s", "case": "k", "default": "D", "throw": "t", "try": "T", "catch": "h", "finally": "y",
    "new": "N", "delete": "u", "typeof": "u", "void": "u", "in": "I", "instanceof": "S", "this": "K", "null": "K", "true": "K",
    "false": "K", "super": "P", "class": "L", "extends": "x", "import": "m", "export": "X", "with": "W", "debugger": "g", "enum": "E",
    "async": "a", "await": "q", "yield": "z", "of": "o", "get": "G", "set": "H", "static": "V",
}
# names that are words of the grammar only in some places
_SOFT = "naqzoGHVe"
_OPS = {
    "=>": ">", "...": ".", "?.": "?", "++": "+", "--": "+", "**": "^", "&&": "&", "||": "|", "??": "2", ">>>": "5", ">>": "5", "<<": "5",
    "===": "3", "!==": "3", "==": "3", "!=": "3", "<=": "4", ">=": "4", "<": "4", ">": "4", "+": "6", "-": "6", "*": "*", "/": "7", "%": "7",
    "&": "8", "|": "8", "^": "8", "!": "!", "~": "!", "?": "Q", "=": "=", ".": "p", "#": "#",
}
_OPS |= {op + "=": "A" for op in ("+", "-", "*", "/", "%", "**", "<<", ">>", ">>>", "&", "|", "^", "&&", "||", "??")}
_OPS |= {c: c for c in "()[]{},;:"}
# The kinds . p ? above: "." is spread, "p" member access, "?" optional chain, "Q" the conditional.
_TOKEN = re.compile(
    r"(?P<s>[\s﻿]+)|(?P<c>//[^\n\r  ]*|/\*[\s\S]*?\*/|<!--[^\n]*)|(?P<n>(?:[^\W\d]|[$]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})(?:[\w$‌‍]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})*)|"
    r"(?P<q>'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*'|\"(?:[^\"\\\n\r]|\\(?:\r\n|[\s\S]))*\")|"
    r"(?P<d>0[xX][0-9a-fA-F](?:_?[0-9a-fA-F])*n?|0[bB][01](?:_?[01])*n?|0[oO][0-7](?:_?[0-7])*n?|0[0-7]+(?![\w$.89])|"
    r"(?:(?:0|[1-9](?:_?\d)*|0\d*[89]\d*)(?:\.(?:\d(?:_?\d)*)?)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?|(?:0|[1-9](?:_?\d)*)n)(?![\w$])|"
    r"(?P<o>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|\?\.(?!\d)|\+\+|--|\*\*|&&|\|\||\?\?|<<|>>|<=|>=|==|!=|[+\-*/%&|^]=|[{}()\[\],;:<>+\-*/%&|^!~?=.#])"
)
_BIGINT = re.compile(r"(?:0|[1-9](?:_?\d)*)n(?![\w$])")
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/[A-Za-z]*")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*(`|\$\{)")
# after these kinds a slash divides
_VALUE_ENDS = set("n0'K)]}jaqoGHVeP")


def tokenize(source: str) -> Tokens:
    out = Tokens()
    kinds, at, breaks = out.kinds, out.at, out.after_break
    i, n = 0, len(source)
    if source.startswith("#!"):
        i = source.find("\n")
        i = n if i < 0 else i
    braces: list[bool] = []  # whether the open brace belongs to a template
    parens: list[int] = []
    control = False  # the last ) closes the head of if, while, for or with
    broke = False

    def put(kind: str) -> None:
        nonlocal broke
        kinds.append(kind)
        at.append(i)
        breaks.append(broke)
        broke = False

    while i < n:
        c = source[i]
        if c == "/" and (not kinds or kinds[-1] not in _VALUE_ENDS or kinds[-1] == ")" and control) and source[i + 1 : i + 2] not in ("/", "*"):
            m = _REGEX.match(source, i)
            if not m:
                out.bad.append((len(kinds), i, "invalid regular expression"))
            put("0")
            i = m.end() if m else faulty(source, i, ())[0]
            continue
        if c == "`" or c == "}" and braces and braces[-1]:
            m = _TEMPLATE.match(source, i + 1)
            if not m:
                out.bad.append((len(kinds), i, "unterminated template"))
                put("'" if c == "`" else "j")
                break
            begins, ends = c == "`", m.group(1) == "`"
            put("'" if begins and ends else "B" if begins else "j" if ends else "M")
            if begins and not ends:
                braces.append(True)
            elif not begins and ends:
                braces.pop()
            i = m.end()
            continue
        m = _TOKEN.match(source, i)
        if not m:
            b = _BIGINT.match(source, i)
            if b:
                put("0")
                i = b.end()
                continue
            out.bad.append((len(kinds), i, "invalid or unexpected token"))
            end, literal = faulty(source, i, ())
            if literal:
                put("'" if c in "'\"" else "0")
            i = end
            continue
        what, text = m.lastgroup, m.group()
        if what == "s" or what == "c":
            broke = broke or "\n" in text or "\r" in text or " " in text
        elif what == "n":
            put("n" if kinds and kinds[-1] in "p?" and text in _WORDS else _WORDS.get(text, "n"))
            if len(kinds) > 1 and kinds[-2] in "p?" and kinds[-1] == "n":
                pass
        elif what == "q":
            put("'")
        elif what == "d":
            put("0")
        else:
            k = _OPS[text]
            if k == "(":
                parens.append(len(kinds))
            elif k == ")" and parens:
                begin = parens.pop()
                control = begin > 0 and kinds[begin - 1] in "iwFW" or begin > 1 and kinds[begin - 1] == "q" and kinds[begin - 2] == "F"
            elif k == "{":
                braces.append(False)
            elif k == "}" and braces:
                braces.pop()
            put(k)
        i = m.end()
    return out


# precedence: ?? || && | ^ & == < << + * **
_POWER = {"2": 1, "|": 1, "&": 2, "8": 3, "3": 6, "4": 7, "I": 7, "S": 7, "5": 8, "6": 9, "7": 10, "*": 10, "^": 11}


class Script(Descent):
    """Expressions return what they are as a target: n name, a member, o object or array literal, x none."""

    def __init__(self, tokens: Tokens, source: str):
        super().__init__("".join(tokens.kinds))
        self.t, self.source = tokens, source
        self.breaks = tokens.after_break + [True] * 4
        self.closes = tokens.closes
        self.functions = 0  # nested function bodies
        self.loops = 0
        self.breakable = 0
        self.is_async = self.is_generator = False
        self.faults: list[Wrong] = []

    def ident(self) -> None:
        c = self.k[self.p]
        if c not in _SOFT or c == "q" and self.is_async or c == "z" and self.is_generator:
            raise self.wrong("expected a name")
        self.p += 1

    def any_name(self) -> bool:
        c = self.k[self.p]
        if c.isalpha() and c not in "AQBMjp":
            self.p += 1
            return True
        return False

    def semicolon(self) -> None:
        if self.take(";") or self.k[self.p] in "}\0" or self.breaks[self.p]:
            return
        raise self.wrong("unexpected token")

    # ---- statements

    def program(self) -> None:
        while self.k[self.p] != self.END:
            self.guarded()

    def block(self) -> None:
        self.need("{")
        while not self.take("}"):
            if self.k[self.p] == self.END:
                raise self.wrong("unexpected end of input")
            self.guarded()

    def guarded(self) -> None:
        """A statement; after a fault in it, on with the next one of the same block."""
        begin = self.p
        state = (self.functions, self.loops, self.breakable, self.is_async, self.is_generator)
        try:
            self.statement()
        except Wrong as w:
            self.faults.append(w)
            self.functions, self.loops, self.breakable, self.is_async, self.is_generator = state
            p = max(begin, min(w.at, len(self.k) - 5))
            while self.k[p] not in ";}\0":
                p = self.closes.get(p, p) + 1
            self.p = p + (self.k[p] == ";")
            if self.p == begin and self.k[p] != "\0":
                self.p += 1

    def statement(self, declares: bool = True) -> None:
        k = self.k
        c = k[self.p]
        if c == "{":
            self.block()
        elif c == ";":
            self.p += 1
        elif c == "v" or c == "c":
            self.p += 1
            self.declarations(c == "c")
            self.semicolon()
        elif c == "e" and (k[self.p + 1] in _SOFT or k[self.p + 1] in "[{"):
            self.p += 1
            self.declarations(False)
            self.semicolon()
        elif c == "i":
            self.p += 1
            self.condition()
            self.statement()
            if self.take("l"):
                self.statement()
        elif c == "F":
            self.for_loop()
        elif c == "w":
            self.p += 1
            self.condition()
            self.body()
        elif c == "d":
            self.p += 1
            self.body()
            self.need("w", "'while'")
            self.condition()
            self.take(";")
        elif c == "f" or c == "a" and k[self.p + 1] == "f" and not self.breaks[self.p + 1]:
            self.function(True)
        elif c == "L":
            self.class_(True)
        elif c == "r":
            if not self.functions:
                raise self.wrong("illegal return statement")
            self.p += 1
            if k[self.p] not in ";}\0" and not self.breaks[self.p]:
                self.expression()
            self.semicolon()
        elif c in "bC":
            self.p += 1
            if k[self.p] in _SOFT and not self.breaks[self.p]:
                self.p += 1
            elif c == "b" and not (self.breakable or self.loops) or c == "C" and not self.loops:
                self.p -= 1
                raise self.wrong("illegal break or continue")
            self.semicolon()
        elif c == "t":
            self.p += 1
            if self.breaks[self.p]:
                raise self.wrong("illegal newline after throw")
            self.expression()
            self.semicolon()
        elif c == "T":
            self.p += 1
            self.block()
            if self.take("h"):
                if self.take("("):
                    self.binding()
                    self.need(")")
                self.block()
                if self.take("y"):
                    self.block()
            elif self.take("y"):
                self.block()
            else:
                raise self.wrong("missing catch or finally after try")
        elif c == "s":
            self.switch()
        elif c == "W":
            self.p += 1
            self.condition()
            self.statement()
        elif c == "g":
            self.p += 1
            self.semicolon()
        elif c == "X" or c == "m" and k[self.p + 1] not in "(p":
            raise self.wrong("import and export belong into modules")
        elif c in _SOFT and k[self.p + 1] == ":":
            self.p += 2
            self.statement()
        else:
            self.expression()
            self.semicolon()

    def condition(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def body(self) -> None:
        self.loops += 1
        self.statement()
        self.loops -= 1

    def declarations(self, constant: bool, in_for: bool = False) -> int:
        n = 0
        while True:
            n += 1
            pattern = self.k[self.p] in "[{"
            self.binding(False)
            if self.take("="):
                self.assignment(not in_for)
            elif (pattern or constant) and not (in_for and self.k[self.p] in "Io"):
                raise self.wrong("missing initializer in declaration")
            if not self.take(","):
                return n

    def binding(self, default: bool = False) -> None:
        if self.take("["):
            while not self.take("]"):
                if self.take(","):
                    continue
                if self.take("."):
                    self.binding()
                else:
                    self.binding(True)
                if self.k[self.p] != "]":
                    self.need(",")
        elif self.take("{"):
            while not self.take("}"):
                if self.take("."):
                    self.ident()
                elif self.k[self.p] in "'0[":
                    self.property_name()
                    self.need(":")
                    self.binding(True)
                else:
                    soft = self.k[self.p] in _SOFT
                    if not self.any_name():
                        raise self.wrong()
                    if self.take(":"):
                        self.binding(True)
                    elif not soft:
                        raise self.wrong()
                    elif self.take("="):
                        self.assignment()
                if self.k[self.p] != "}":
                    self.need(",")
        else:
            self.ident()
        if default and self.take("="):
            self.assignment()

    def for_loop(self) -> None:
        self.p += 1
        if self.k[self.p] == "q":
            self.p += 1
        self.need("(")
        k = self.k
        c = k[self.p]
        if c != ";":
            if c in "vc" or c == "e" and (k[self.p + 1] in _SOFT or k[self.p + 1] in "[{") and k[self.p + 1] != "I":
                self.p += 1
                n = self.declarations(c == "c", True)
                target = n == 1
            else:
                target = self.expression(False) in "nao"
            if k[self.p] in "Io" and target:
                self.p += 1
                if k[self.p - 1] == "o":
                    self.assignment()
                else:
                    self.expression()
                self.need(")")
                self.body()
                return
        self.need(";")
        if k[self.p] != ";":
            self.expression()
        self.need(";")
        if k[self.p] != ")":
            self.expression()
        self.need(")")
        self.body()

    def switch(self) -> None:
        self.p += 1
        self.condition()
        self.need("{")
        self.breakable += 1
        default = False
        while not self.take("}"):
            if self.take("k"):
                self.expression()
            elif self.take("D"):
                if default:
                    raise self.wrong("more than one default clause")
                default = True
            else:
                raise self.wrong("expected a case")
            self.need(":")
            while self.k[self.p] not in "kD}\0":
                self.guarded()
        self.breakable -= 1

    # ---- functions and classes

    def function(self, declared: bool = False) -> None:
        is_async = self.take("a")
        self.need("f")
        generator = self.take("*")
        if self.k[self.p] in _SOFT:
            self.p += 1
        elif declared:
            raise self.wrong("a function declaration needs a name")
        self.function_rest(is_async, generator)

    def function_rest(self, is_async: bool, generator: bool) -> None:
        state = (self.loops, self.breakable, self.is_async, self.is_generator)
        self.loops = self.breakable = 0
        self.is_async, self.is_generator = is_async, generator
        self.functions += 1
        self.need("(")
        self.parameters()
        self.block()
        self.functions -= 1
        self.loops, self.breakable, self.is_async, self.is_generator = state

    def parameters(self) -> None:
        while not self.take(")"):
            if self.take("."):
                self.binding()
                self.need(")")
                return
            self.binding(True)
            if self.k[self.p] != ")":
                self.need(",")

    def arrow_body(self, is_async: bool, with_in: bool) -> None:
        if self.breaks[self.p]:
            raise self.wrong("newline before =>")
        self.need(">", "'=>'")
        state = (self.loops, self.breakable, self.is_async, self.is_generator)
        self.is_async, self.is_generator = is_async, False
        if self.k[self.p] == "{":
            self.loops = self.breakable = 0
            self.functions += 1
            self.block()
            self.functions -= 1
        else:
            self.assignment(with_in)
        self.loops, self.breakable, self.is_async, self.is_generator = state

    def class_(self, declared: bool = False) -> None:
        self.p += 1
        if self.k[self.p] in _SOFT:
            self.p += 1
        elif declared:
            raise self.wrong("a class declaration needs a name")
        if self.take("x"):
            self.postfix()
        self.need("{")
        while not self.take("}"):
            if self.take(";"):
                continue
            if self.k[self.p] == "V" and self.k[self.p + 1] not in "(=;}":
                self.p += 1
                if self.k[self.p] == "{":
                    self.functions += 1
                    self.block()
                    self.functions -= 1
                    continue
            if not self.method():
                if self.take("="):
                    self.functions += 1
                    self.assignment()
                    self.functions -= 1
                self.semicolon()

    def property_name(self) -> None:
        if self.take("["):
            self.assignment()
            self.need("]")
        elif self.k[self.p] in "'0":
            self.p += 1
        elif self.take("#"):
            if not self.any_name():
                raise self.wrong()
        elif not self.any_name():
            raise self.wrong("expected a property name")

    def method(self) -> bool:
        """A method, accessor or (False) only the name of a field."""
        is_async = generator = False
        ends = "(=;},:"
        if self.k[self.p] == "a" and self.k[self.p + 1] not in ends and not self.breaks[self.p + 1]:
            self.p += 1
            is_async = True
        if self.take("*"):
            generator = True
        elif self.k[self.p] in "GH" and self.k[self.p + 1] not in ends:
            self.p += 1
        self.property_name()
        if self.k[self.p] == "(":
            self.function_rest(is_async, generator)
            return True
        if is_async or generator:
            raise self.wrong()
        return False

    # ---- expressions

    def expression(self, with_in: bool = True) -> str:
        what = self.assignment(with_in)
        while self.take(","):
            self.assignment(with_in)
            what = "x"
        return what

    def assignment(self, with_in: bool = True) -> str:
        k = self.k
        c = k[self.p]
        if c == "z" and self.is_generator:
            self.p += 1
            if self.take("*"):
                self.assignment(with_in)
            elif k[self.p] not in ")]},;:\0jMI" and not self.breaks[self.p]:
                self.assignment(with_in)
            return "x"
        if c == "(" and k[self.closes.get(self.p, 0) + 1] == ">" and self.p in self.closes:
            self.p += 1
            self.parameters()
            self.arrow_body(False, with_in)
            return "x"
        if c in _SOFT and k[self.p + 1] == ">":
            self.p += 1
            self.arrow_body(False, with_in)
            return "x"
        if c == "a" and not self.breaks[self.p + 1]:
            if k[self.p + 1] in _SOFT and k[self.p + 2] == ">":
                self.p += 2
                self.arrow_body(True, with_in)
                return "x"
            if k[self.p + 1] == "(" and k[self.closes.get(self.p + 1, 0) + 1] == ">" and self.p + 1 in self.closes:
                self.p += 2
                self.parameters()
                self.arrow_body(True, with_in)
                return "x"
        what = self.conditional(with_in)
        c = k[self.p]
        if c == "=":
            if what not in "nao":
                raise self.wrong("invalid left-hand side in assignment")
            self.p += 1
            self.assignment(with_in)
            return "x"
        if c == "A":
            if what not in "na":
                raise self.wrong("invalid left-hand side in assignment")
            self.p += 1
            self.assignment(with_in)
            return "x"
        return what

    def conditional(self, with_in: bool) -> str:
        what = self.binary(1, with_in)
        if self.take("Q"):
            self.assignment()
            self.need(":")
            self.assignment(with_in)
            return "x"
        return what

    def binary(self, least: int, with_in: bool) -> str:
        begin = self.k[self.p]
        if begin == "#" and self.k[self.p + 2] == "I":
            self.p += 2
            what = "x"
        else:
            what = self.unary()
        while True:
            c = self.k[self.p]
            power = _POWER.get(c)
            if power is None or power < least or c == "I" and not with_in:
                return what
            if c == "^" and begin in "u!6q":
                raise self.wrong("unary operator before ** needs parentheses")
            self.p += 1
            self.binary(power + (c != "^"), with_in)
            what = "x"

    def unary(self) -> str:
        c = self.k[self.p]
        if c in "u!6" or c == "q" and self.is_async:
            self.p += 1
            self.unary()
            return "x"
        if c == "+":
            self.p += 1
            if self.unary() not in "na":
                raise self.wrong("invalid operand of ++ or --")
            return "x"
        what = self.postfix()
        if self.k[self.p] == "+" and not self.breaks[self.p]:
            if what not in "na":
                raise self.wrong("invalid operand of ++ or --")
            self.p += 1
            return "x"
        return what

    def arguments(self) -> None:
        self.need("(")
        while not self.take(")"):
            self.take(".")
            self.assignment()
            if self.k[self.p] != ")":
                self.need(",", "',' or ')' after an argument")

    def template(self) -> None:
        self.p += 1
        while True:
            self.expression()
            if self.take("j"):
                return
            self.need("M", "'}' of a template")

    def postfix(self, calls: bool = True) -> str:
        k = self.k
        if k[self.p] == "N":
            self.p += 1
            if self.take("p"):
                if not self.any_name():
                    raise self.wrong()
            else:
                self.postfix(False)
                if k[self.p] == "(":
                    self.arguments()
            what = "x"
        else:
            what = self.primary()
        while True:
            c = k[self.p]
            if c == "p":
                self.p += 1
                self.take("#")
                if not self.any_name():
                    raise self.wrong("expected a name after '.'")
                what = "a"
            elif c == "?":
                if not calls:
                    raise self.wrong()
                self.p += 1
                if k[self.p] == "(":
                    self.arguments()
                elif self.take("["):
                    self.expression()
                    self.need("]")
                elif k[self.p] not in "B'":
                    self.take("#")
                    if not self.any_name():
                        raise self.wrong()
                what = "x"
            elif c == "[":
                self.p += 1
                self.expression()
                self.need("]")
                what = "a"
            elif c == "(" and calls:
                self.arguments()
                what = "x"
            elif c == "B":
                self.template()
                what = "x"
            elif c == "'" and self.source[self.t.at[self.p]] == "`":
                self.p += 1
                what = "x"
            else:
                return what

    def primary(self) -> str:
        k = self.k
        c = k[self.p]
        if c == "f" or c == "a" and k[self.p + 1] == "f" and not self.breaks[self.p + 1]:
            self.function()
            return "x"
        if c in _SOFT:
            if c == "q" and self.is_async or c == "z" and self.is_generator:
                raise self.wrong()
            self.p += 1
            return "n"
        if c in "'0K":
            self.p += 1
            return "x"
        if c == "B":
            self.template()
            return "x"
        if c == "(":
            self.p += 1
            what = self.expression()
            self.need(")")
            return what if what in "na" else "x"
        if c == "[":
            self.p += 1
            while not self.take("]"):
                if self.take(","):
                    continue
                self.take(".")
                self.assignment()
                if k[self.p] != "]":
                    self.need(",", "',' or ']'")
            return "o"
        if c == "{":
            self.p += 1
            while not self.take("}"):
                if self.take("."):
                    self.assignment()
                else:
                    plain = k[self.p] in _SOFT
                    if not self.method():
                        if self.take(":"):
                            self.assignment()
                        elif not plain:
                            raise self.wrong()
                        elif self.take("="):
                            self.assignment()
                if k[self.p] != "}":
                    self.need(",", "',' or '}'")
            return "o"
        if c == "L":
            self.class_()
            return "x"
        if c == "P" and k[self.p + 1] in "p[(":
            self.p += 1
            return "x"
        if c == "m" and k[self.p + 1] in "(":
            self.p += 1
            return "x"
        raise self.wrong("unexpected token")


def check_javascript(source: str) -> list[Fault]:
    """All faults of a source, in order; none for a valid (or blank) one."""
    tokens = tokenize(source)
    bad = tokens.match_brackets()
    script = Script(tokens, source)
    try:
        script.program()
    except Wrong as w:
        if w not in script.faults:
            script.faults.append(w)
    except RecursionError:
        script.faults.append(Wrong(script.p, "nested too deeply"))
    if bad and not tokens.bad and not script.faults:
        script.faults.append(Wrong(*bad))
    return faults(source, tokens, script.faults)
