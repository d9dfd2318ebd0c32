"""Problem 1: generated, minified, vendored and data files, so that hand-written source remains.

Notices are searched in comment lines of the whole text with one Aho-Corasick automaton over all phrases, and count in
the header and in the comment blocks that begin and end the text, however long; path
rules name directories, suffixes, lock files and repos; two measures over the whole text find minified
code and data stored as code.  A notice inside a string or in prose about generators is no notice: the line
has to be a comment and to carry the phrase in the form that tools write.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions.normalize import repo_key
from quillmark.sources.tables import table

HEADER_LINES = 40  # a notice may stand between code here; further down only in the leading or trailing comment block
WIDE = 400  # from this column on, what follows a closed comment is code
MINIFIED_LINE = 200  # a line this long is no hand-written line
LONG_SHARE = 0.5
MINIFIED_MEAN = 100  # characters a line, over the whole text
DATA_SHARE = 0.6
LEAST_CHARS = 160

# Phrases of notices, lower case, with the pattern the comment line has to match; kind by phrase.
NOTICES: list[tuple[str, str, str]] = [
    ("code generated by", "generated", r"code generated by \S+.*do not edit|^\W*code generated by \S+( v?[\d.]+)?\W*$"),
    ("@generated", "generated", r"^\W*@generated\b"),
    ("<auto-generated", "generated", r"^\W*<auto-?generated"),
    ("autogenerated", "generated", r"^\W*autogenerated (on|by|from|file|code)\b"),
    ("auto-generated", "generated", r"^\W*(this (file|code|class|module) (is|was) )?auto-generated\b.*(by|from|on|do not|file|$)"),
    ("automatically generated", "generated", r"^\W*(this (file|code|class|module) (is|was|has been) )?automatically generated\b"),
    ("generated automatically", "generated", r"^\W*(this (file|code|class|module) (is|was|has been) )?generated automatically\b"),
    ("produced automatically", "generated", r"^\W*(this (file|code|class|module) (is|was|has been) )?produced automatically\b"),
    ("this file was generated", "generated", r"^\W*this file was generated\b"),
    ("this file is generated", "generated", r"^\W*this file is generated\b"),
    ("machine generated", "generated", r"^\W*(this (file|code) (is|was) )?machine generated\b"),
    ("generated by the protocol buffer compiler", "generated", r"^\W*generated by the protocol buffer compiler"),
    ("generated from", "generated", r"^\W*(this (file|code) (is|was) )?generated from \S+\.\w+"),
    ("generated by", "generated", r"^\W*generated by \S+.*(do not (edit|modify)|from \S+\.\w+|v?\d+\.\d+)"),
    ("output of", "generated", r"-\*-\s*output of \S+.*(do not (modify|edit)|-\*-)"),
    ("changes made by hand will be lost", "generated", r"^\W*(manual )?changes made by hand will be lost"),
    ("manual changes will be overwritten", "generated", r"^\W*manual changes will be overwritten"),
    ("maschinell erzeugt", "generated", r"^\W*diese datei w(urde|ird) maschinell erzeugt"),
    ("automatisch erzeugt", "generated", r"^\W*diese datei w(urde|ird) automatisch erzeugt"),
    ("automatisch generiert", "generated", r"^\W*(diese datei w(urde|ird) )?automatisch generiert"),
    ("généré automatiquement", "generated", r"^\W*(ce fichier (est|a été) )?généré automatiquement"),
    ("generado automáticamente", "generated", r"^\W*(este (archivo|fichero) (fue|ha sido) )?generado automáticamente"),
    ("revision", "generated", r"^\W*source: \S+\.\w+ revision [0-9a-f]{7,}"),
    ("source:", "generated", r"^\W*source: \S+\.(proto|xsd|thrift|idl|wsdl|avsc|def|schema|fbs|g4)\b"),
    ("vendored from", "vendored", r"^\W*vendored from \S+"),
    ("bundled copy", "vendored", r"\bbundled copy\b.*upstream"),
    ("taken unchanged from", "vendored", r"^\W*taken unchanged from \S+"),
    ("copied unchanged from", "vendored", r"^\W*copied unchanged from \S+"),
    ("upstream http", "vendored", r"^\W*(\(c\)|©|copyright).*upstream https?://"),
    ("sourcemappingurl=", "minified", r"^\W*sourcemappingurl=\S+\.map"),
]

# Names of directories that hold third-party or built files.
DIRECTORIES = {
    "node_modules", "bower_components", "jspm_packages", "vendor", "vendors", "vendored", "third_party", "third-party", "thirdparty",
    "3rdparty", "extern", "external", "externals", "site-packages", "dist-packages", "dist", "build", "_bundled", "bundled", "libs", "gen",
    "generated", "_generated", "__generated__", "target", "pods", "deps", "godeps", ".yarn", ".venv", "virtualenv",
}
# Names of lock files.
LOCK_FILES = {
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "pipfile.lock", "cargo.lock", "composer.lock", "gemfile.lock",
    "go.sum", "npm-shrinkwrap.json", "bun.lockb", "packages.lock.json",
}
# Marks before the extension.
_SUFFIX = re.compile(
    r"(?:[.\-](?:min|bundle|packed|prod|chunk|pb|g|gen|generated|designer)|_pb2|_pb2_grpc|_pb|_gen|_generated|\.pb\.gw|_rc|_wsdl)\.[A-Za-z0-9]+$", re.I
)
#: Repos that hold nothing else: all words of their name are of one family, one that says whose or how and one that says what.
_REPO_WORDS = [
    (set("vendored thirdparty 3rdparty thirdpartylibs bundled external vendor".split()), set("deps dependencies libs lib libraries modules packages mirror mirrors sources src code copies archive snapshot snapshots".split())),
    (set("dist build built release minified compiled".split()), set("bundle bundles files output outputs artifact artifacts assets dist".split())),
    (set("generated autogenerated gen stubs".split()), set("sdk sdks api apis client clients code proto protos grpc models stubs generated".split())),
]
_UPSTREAM = re.compile(r"[/\-_.]upstream[\-_.](?:copy|copies|mirror|snapshot)$")
_STATIC = re.compile(r"(?:^|/)static/(?:js|css)/")
_COMMENT = re.compile(r"\s*(?:#(?!!)|//|/\*|\*|--|<!--|;|%)")
_DATA_LINE = re.compile(
    r"\s*(?:[bBruL]{0,2}\"(?:[^\"\\\n]|\\.)*\"|[bBruL]{0,2}'(?:[^'\\\n]|\\.)*'|0[xX][0-9A-Fa-f]+|[-+]?\d[\d._]*(?:[eE][-+]?\d+)?[LlFfUu]*"
    r"|[\[\](){},:;+\-\\\s]|None|True|False|true|false|null|nil)+$"
)
_TOKENISH = re.compile(r"[A-Za-z0-9+/=_-]{80,}")
_TABLE_ROW = re.compile(r"\s*[^\s,;|\t]+(?:[,;|\t][^\s,;|\t]*){2,}$")
_WORD = re.compile(r"[A-Za-z_$][\w$]*|\d[\w.]*")
REPEATED_LINES, REPEATED_SHARE = 12, 0.85


def _automaton() -> ahocorasick.Automaton:
    auto = ahocorasick.Automaton()
    for phrase, kind, rule in NOTICES:
        auto.add_word(phrase, (kind, re.compile(rule)))
    auto.make_automaton()
    return auto


def path_reason(path: str | None) -> str | None:
    """vendored, generated, minified or None by path alone; ``path`` starts with owner and repo."""
    if not path:
        return None
    parts = path.strip().lower().split("/")
    name = parts[-1]
    for part in parts[2:-1]:
        if part in DIRECTORIES or "@" in part[1:]:
            return "generated" if part in ("gen", "generated", "_generated", "__generated__") else "vendored"
    if name in LOCK_FILES:
        return "generated"
    m = _SUFFIX.search(name)
    if m:
        return "minified" if re.search(r"min|bundle|packed|prod|chunk", m.group()) else "generated"
    return None


def repo_reason(key: str | None) -> str | None:
    """A repo whose name says that it holds only built, vendored or generated files."""
    if not key:
        return None
    if _UPSTREAM.search(key):
        return "vendored"
    words = re.split(r"[-_.]+", re.sub(r"third[-_.]?party|3rd[-_.]?party", "thirdparty", key.rpartition("/")[2]))
    for how, what in _REPO_WORDS:
        # two words at least, which may both be of the first kind's list if one is of the second's too
        if len(words) > 1 and all(w in how or w in what for w in words) and any(w in how and any(v in what for v in words[:k] + words[k + 1 :]) for k, w in enumerate(words)):
            return "vendored"
    return None


def _blocks(lines: list[str]) -> tuple[int, int]:
    """(line after the leading comment block, first line of the trailing one); both of any length, blank lines included."""
    first, inside = 0, ""
    for x in lines:
        t = x.strip()
        if inside:
            inside = "" if inside in t else inside
        elif t.startswith(("/*", "<!--")):
            close = "*/" if t[0] == "/" else "-->"
            inside = "" if close in t[2:] else close
        elif t and not _COMMENT.match(x) and not t.startswith(("#!", "<?")):
            break
        first += 1
    last = len(lines)
    while last > first:
        t = lines[last - 1].strip()
        opener = {"*/": "/*", "->": "<!--"}.get(t[-2:])
        k = last - 1
        while opener and k >= first and opener not in lines[k]:
            k -= 1
        if opener and k >= first and lines[k].lstrip().startswith(opener):
            last = k + 1
        elif t and not _COMMENT.match(t):
            break
        last -= 1
    return first, last


def header_reason(source: str, auto: ahocorasick.Automaton) -> str | None:
    """By a notice on a comment line of the first lines, or of the comment block that the text begins or ends with."""
    low = source.lower()
    lines: list[str] = []
    first = last = 0
    for end, (kind, rule) in auto.iter(low):
        begin = low.rfind("\n", 0, end) + 1
        stop = low.find("\n", end)
        line = low[begin : stop if stop >= 0 else len(low)]
        if not _COMMENT.match(line):
            continue
        if end - begin >= WIDE and line.lstrip().startswith("/*"):
            line = line.partition("*/")[0]  # no string of the code that follows the comment
        if not rule.search(re.sub(r"^[\s#/*;%<!-]+(?=\w|@|\(|<|©)", "", line) if kind != "generated" or "-*-" not in line else line):
            continue
        at = low.count("\n", 0, begin)
        if at >= HEADER_LINES and not lines:
            lines = low.split("\n")
            first, last = _blocks(lines)
        if at < HEADER_LINES or at < first or at >= last:
            return kind
    tail = source.rstrip().rpartition("\n")[2].lower()
    return "minified" if re.match(r"\s*//[#@] sourcemappingurl=\S+\.map$", tail) else None


def content_reason(source: str) -> str | None:
    """minified or data, by measures over the whole text."""
    n = len(source)
    if n < LEAST_CHARS:
        return None
    lines = source.split("\n")
    long = sum(len(x) for x in lines if len(x) >= MINIFIED_LINE)
    data = sum(len(x) + 1 for x in lines if len(x.strip()) > 3 and (_DATA_LINE.match(x) or (len(x) < 400 and _TABLE_ROW.match(x))))
    blob = sum(len(m.group()) for x in lines if len(x) >= 80 for m in _TOKENISH.finditer(x))
    if data + blob >= DATA_SHARE * n:
        return "data"
    if long >= LONG_SHARE * n:
        digits = sum(c.isdigit() or c in "[]{},\"'" for c in source)
        return "data" if digits >= 0.5 * n else "minified"
    if n >= MINIFIED_MEAN * len(lines):
        return "minified"
    return None


def repetition(source: str) -> float:
    """Share of lines that have one of the four commonest shapes (words and numbers masked)."""
    shapes: dict[str, int] = {}
    total = 0
    for x in source.split("\n"):
        x = x.strip()
        if len(x) > 3:
            shape = _WORD.sub("w", x)
            shapes[shape] = shapes.get(shape, 0) + 1
            total += 1
    if total < REPEATED_LINES:
        return 0.0
    return sum(sorted(shapes.values())[-4:]) / total


def judge(source: str | None, path: str | None, repo: str | None, auto: ahocorasick.Automaton) -> str | None:
    """The first reason found, or None for hand-written code.  Null and empty sources are judged by path."""
    return (
        path_reason(path)
        or repo_reason(repo)
        or (header_reason(source, auto) if source else None)
        or (content_reason(source) if source else None)
        or (source and repetition(source) >= REPEATED_SHARE and "generated")
        or (path and source and _STATIC.search(path) and max(map(len, source.split("\n"))) > MINIFIED_LINE and "minified")
        or None
    )


def p1_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dataset, record_id, repo, reason (generated, minified, vendored, data; null: hand-written) of all records."""
    cx = table(spark, sf_dir, "complexity_dataset").select(F.lit("complexity_dataset").alias("dataset"), "record_id", "repo", "origin", "source")
    pt = table(spark, sf_dir, "pattern_dataset").select(
        F.lit("pattern_dataset").alias("dataset"), "record_id", F.lit(None).cast("string").alias("repo"), "origin", "source"
    )
    led = repo_key(F.concat_ws("/", F.split_part("origin", F.lit("/"), F.lit(1)), F.split_part("origin", F.lit("/"), F.lit(2))))
    rows = cx.unionByName(pt).withColumn("repo", F.coalesce(repo_key(F.col("repo")), led))
    return classify(rows)


def classify(rows: DataFrame) -> DataFrame:
    """dataset, record_id, repo, reason for rows of dataset, record_id, repo (key), origin, source."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = _automaton()
        for part in parts:
            cols = (part.column(c).to_pylist() for c in ("source", "origin", "repo"))
            reasons = [judge(s, o, r, auto) for s, o, r in zip(*cols)]
            yield pa.RecordBatch.from_arrays(
                [part.column("dataset"), part.column("record_id"), part.column("repo"), pa.array(reasons, pa.string())],
                names=["dataset", "record_id", "repo", "reason"],
            )

    rows = rows.select("dataset", "record_id", "repo", "origin", "source")
    return rows.mapInArrow(run, "dataset string, record_id long, repo string, reason string")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dataset, record_id of the records that are not hand-written code."""
    return p1_reasons(spark, sf_dir).where("reason is not null").select("dataset", "record_id")


def p1_per_repo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dataset, repo, reason, n: number of such records per repo."""
    return p1_reasons(spark, sf_dir).where("reason is not null").groupBy("dataset", "repo", "reason").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {"p1_found": p1_found, "p1_per_repo": p1_per_repo}
