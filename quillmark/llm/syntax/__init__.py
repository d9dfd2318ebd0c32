"""Parsers that say whether a text is valid under a language's grammar."""

from __future__ import annotations

from collections.abc import Callable

from quillmark.llm.syntax.base import Fault
from quillmark.llm.syntax.data import check_json, check_yaml
from quillmark.llm.syntax.go import check_go
from quillmark.llm.syntax.java import check_java
from quillmark.llm.syntax.javascript import check_javascript
from quillmark.llm.syntax.python import check_python

CHECKS: dict[str, Callable[[str], list[Fault]]] = {
    "python": check_python,
    "javascript": check_javascript,
    "java": check_java,
    "go": check_go,
    "json": check_json,
    "yaml": check_yaml,
}
