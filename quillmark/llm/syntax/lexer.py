"""The scanner that the brace languages share."""

from __future__ import annotations

import re
from bisect import bisect_left

from quillmark.llm.syntax.base import Fault, Wrong

_PAIR = {")": "(", "]": "[", "}": "{"}


class Tokens:
    """kinds (one character a token), where each begins, whether a line break stands before it, and the
    place of the bracket that closes the one at a place."""

    def __init__(self) -> None:
        self.kinds: list[str] = []
        self.at: list[int] = []
        self.after_break: list[bool] = []
        self.closes: dict[int, int] = {}
        #: lexical faults: token at which each stands (the literal in its place, or the next one), place in the text, message
        self.bad: list[tuple[int, int, str]] = []

    def match_brackets(self) -> tuple[int, str] | None:
        """(token, message) of the first bracket that does not match, if any; fills ``closes``."""
        stack: list[int] = []
        for i, c in enumerate(self.kinds):
            if c in "([{":
                stack.append(i)
            elif c in ")]}":
                if not stack or self.kinds[stack[-1]] != _PAIR[c]:
                    return i, "closing bracket does not match"
                self.closes[stack.pop()] = i
        if stack:
            return stack[-1], "bracket was never closed"
        return None


_LINE, _WORD = re.compile(r"[^\n\r]*"), re.compile(r"[\w.$]+")


def faulty(source: str, at: int, open_ended: tuple[str, ...]) -> tuple[int, bool]:
    """(end, whether a literal stands there) of what no token matches at ``at``: a literal that begins with one of
    ``open_ended`` goes on to the text's end, another one to the punctuation at its line's end, a malformed number to the word's end;
    else one character is passed over."""
    c = source[at]
    if source.startswith(open_ended, at):
        return len(source), True
    if c in "'\"/":
        return max(at + 1, at + len(_LINE.match(source, at).group().rstrip(")];,{} \t"))), True
    if c.isdigit() or c == "." and source[at + 1 : at + 2].isdigit():
        return _WORD.match(source, at).end(), True
    return at + 1, False


def faults(source: str, tokens: Tokens, found: list[Wrong]) -> list[Fault]:
    """The lexical faults and those of the grammar; of the latter, none that only follows from a lexical one, and
    each once."""
    marks = {p for p, _, _ in tokens.bad}
    places = [(at, message) for _, at, message in tokens.bad]
    for w in found:
        if not marks or w.at not in marks and w.at - 1 not in marks:
            places.append((tokens.at[w.at] if w.at < len(tokens.at) else len(source), w.message))
    if marks:
        places.sort(key=lambda x: x[0])
    breaks = [m.start() for m in re.finditer("\n", source)] if places else []
    return [Fault(bisect_left(breaks, at) + 1, message) for at, message in dict.fromkeys(places)]
