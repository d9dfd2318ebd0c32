"""Column expressions that bring dirty names into one form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def repo_key(repo: Column) -> Column:
    """owner/name of a repo given as a path, URL or scp-like address, in lower case.

    Trailing ``/`` and ``.git`` are dropped.  Null, blank, or one path part only: null.
    """
    s = F.regexp_replace(F.lower(F.trim(repo)), r"(?:/|\.git)+$", "")
    key = F.regexp_extract(s, r"([^/:@\s]+)/([^/\s]+)$", 0)
    return F.when(key != "", key)


def clean_name(name: Column) -> Column:
    """Lower case without outer spaces; blank is null."""
    s = F.lower(F.trim(name))
    return F.when(s != "", s)


LANGUAGE_ALIASES = {"py": "python", "js": "javascript", "golang": "go", "yml": "yaml"}


def language(code_lang: Column, path: Column) -> Column:
    """Language in one spelling; where ``code_lang`` is null or blank, by the path's extension."""
    said = clean_name(code_lang)
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    raw = F.coalesce(said, F.when(ext != "", ext))
    out = raw
    for alias, name in LANGUAGE_ALIASES.items():
        out = F.when(raw == alias, F.lit(name)).otherwise(out)
    return out
