"""What the parsers share: faults, token kinds, and the recursive-descent base.

A text becomes a string of *kinds*, one character a token (all names are ``n``, all numbers ``0``, ...), since
grammars look at kinds only.  Parsers descend over that string; expressions climb precedences.
"""

from __future__ import annotations

from typing import NamedTuple


class Fault(NamedTuple):
    line: int
    message: str


class Wrong(Exception):
    """Raised at the token where the grammar does not hold; caught where recovery is possible."""

    def __init__(self, at: int, message: str):
        super().__init__(message)
        self.at, self.message = at, message


CACHED = 200_000  # entries kept of any cache; a full one is emptied


class Kinds(dict):
    """token text -> kind, worked out once by ``classify``."""

    def __init__(self, fixed: dict[str, str], classify):
        super().__init__(fixed)
        self.fixed, self.classify = fixed, classify

    def __missing__(self, token: str) -> str:
        if len(self) > CACHED:
            self.clear()
            self.update(self.fixed)
        kind = self.classify(token)
        if len(token) < 200:
            self[token] = kind
        return kind


class Descent:
    """Position ``p`` in the kinds ``k``; the text of kinds ends with NUL characters."""

    END = "\0"

    def __init__(self, kinds: str):
        self.k = kinds + "\0\0\0\0"
        self.p = 0

    def wrong(self, message: str = "invalid syntax") -> Wrong:
        return Wrong(self.p, message)

    def take(self, kind: str) -> bool:
        if self.k[self.p] == kind:
            self.p += 1
            return True
        return False

    def need(self, kind: str, what: str = "") -> None:
        if self.k[self.p] != kind:
            raise Wrong(self.p, f"expected {what or repr(kind)}")
        self.p += 1
