"""Problem 10: template residue, filler, error pages and script notices in place of content.

1. Texts are normalised (code blocks and inline code cut out, markup stripped, numbers made one sign) and cut into
   sentences.  Bracketed or underscored words that may be unfilled placeholders are kept as their *shape*: signs as they
   are, each word as ``a``, and the signs beside them.
2. Character n-gram models: one of each residue class and one of placeholder shapes, fitted on the labelled phrases in
   ``residue_seeds``, and one of natural prose, counted over the distinct sentences of *all* documents and their shapes: a
   page that many documents hold counts once.  Counts are hashed into ``BUCKETS`` cells, so what is gathered has a fixed
   size.  Shapes that are usual in the corpus (names of speakers, links, references) are thereby natural.
3. Every character position gets the log-likelihood ratio of its n-gram, residue against prose.
   Windows of positions with a positive smoothed ratio localise residue.
4. A sentence or a shape is residue when such windows cover enough of it and the mean ratio is high; a sentence that
   repeats the same few words over and over is too.  A document is excluded when residue covers more than ``EXCLUDE``
   of it; a case may stand in one place of a long text, so that share is 0.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm.residue_seeds import CLASSES, GENERAL, PARTS
from quillmark.llm.shingles import batches, mix
from quillmark.sources.tables import table

N = 5
BUCKETS = 1 << 18
SMOOTH_RESIDUE, SMOOTH_PROSE = 2e-5, 2e-6
UNKNOWN_SET, UNKNOWN = 3.0, 1.2
CLAMP = 4.0
WINDOW = 11
MEAN, GENERAL_MEAN, COVERAGE = 0.65, 0.75, 0.55
LEAST = 5
SHAPE_MEAN = 0.65
SHORT, SHORT_MEAN = 20, 0.85  # a few words, as headings have, need more evidence
EXCLUDE = 0.0
PLACEHOLDER, CODE = "@", "\ue015"
OPEN, CLOSE = "\ue010", "\ue011"  # around the shape of a placeholder in a sentence

_FENCE = re.compile(r"^[ \t]*(```|~~~).*?(?:^[ \t]*\1[^\n]*$|\Z)", re.S | re.M)
_INLINE = re.compile(r"`[^`\n]*`")
_XML = re.compile(r"</?(Error|Code|Key|RequestId|HostId|Message|Resource)>")
_COMMENT = re.compile(r"<!--(.*?)-->", re.S)
_TAG = re.compile(r"</?(?:html|head|title|body|h\d|p|div|span|noscript|script|style|br|hr|a|b|i|em|strong|ul|ol|li|img|meta|link|center|table|tr|td|th)\b[^>]*>", re.I)
# Names of the Python language, which prose mentions bare.
_DUNDER = "(?:init|main|call|new|del|repr|str|len|iter|next|enter|exit|eq|lt|hash|bool|getattr|setattr|getitem|setitem|contains|dict|slots|doc|file|all|class|future|import)"
# What may be an unfilled placeholder; whether it is one says the model of shapes.
_PLACE = re.compile(
    r"(?=[{<$\[@_%])(?:"  # rules out most places at once
    r"(?<![\w$/{(=])\{[A-Za-z][\w .\-]{0,40}\}(?![\w}])|(?<!\w)_{3,}(?!\w)|\[[A-Za-zÀ-ÿ]+(?:[ \-][A-Za-zÀ-ÿ]+){1,5}\](?![(\[:])|(?<=[,.] )\[[A-Z][a-zà-ÿ]+\](?![(\[:])|"
    r"\{\{\s*[\w .\-]{1,40}\s*\}\}|\{%\s*[\w .\-]{1,40}\s*%\}|<%=?\s*[\w .\-]{1,40}\s*%>|\$\{[\w .\-]{1,40}\}|<<\s*[\w .\-]{1,40}\s*>>|"
    r"\[\[\s*[\w .\-]{1,40}\s*\]\]|@@[\w .\-]{1,40}@@|(?<!\w)__(?!_|" + _DUNDER + r"__)[A-Za-z][\w ]{0,38}[A-Za-z]__(?!\w)|(?<![\w$])\$[A-Za-z][A-Za-z_ ]{1,38}\$(?!\w)|%[A-Z][A-Z_]{2,38}%|"
    r"<[A-Z][A-Z_]{2,38}>|<(?:insert|your|enter)[ _][\w .\-]{1,40}>|\[(?:insert|your|enter)[ _][\w .\-]{1,40}\]|\{(?:insert|your|enter)[ _][\w .\-]{1,40}\}|"
    r"\[[A-Z][A-Z]+(?:_[A-Z]+)+\]|\[[a-z]+(?:_[a-z]+)+\](?![(\[:])|(?<=[:, ])\[[a-z]{3,12}\](?![(\[:\w])|^\[[a-z]{3,12}\]$|<[a-z]+_[a-z_]+>|(?<=: )<[a-z]{3,12}>$|(?<=: )\[[A-Z]{3,12}\]$)",
    re.M,
)
_PLAIN_WORD = re.compile(r"[^\W\d_]+\d*")
_MARKED = re.compile(f"{OPEN}([^{OPEN}{CLOSE}]*){CLOSE}")
_NUMBER = re.compile(r"\b[0-9a-f]{12,}\b|\d[\d.,:]*")
_LEAD = re.compile(r"^[\s>*#|\-•–]+|[\s*|]+$")
_CUT = re.compile(r"\n+|(?<=[.!?])\s+")
_REPEAT = re.compile(r"\b((?:[^\W\d_]{2,12}\W+){1,2}?(?:0\W+)?)\1{5,}")


def _shape(m: re.Match) -> str:
    # signs that would be read as markup, numbers or text later on are kept as they are by \ue012-\ue014
    shape = _PLAIN_WORD.sub("a", m.group())
    return OPEN + (shape if shape.strip("_") else "___").replace("@", "\ue012").replace("<", "\ue013").replace(">", "\ue014") + CLOSE


def shape_lines(s: str) -> tuple[str, list[str]]:
    """(the sentence with a sign for each placeholder; each placeholder's shape with the kind of sign on either side)."""
    if OPEN not in s:
        return s, []
    kind = lambda c, end: end if not c else "a" if c.isalnum() else c
    found = [kind(s[m.start() - 1 : m.start()], "^") + m.group(1) + kind(s[m.end() : m.end() + 1], "$") for m in _MARKED.finditer(s)]
    return _MARKED.sub(PLACEHOLDER, s), found


def sentences(text: str) -> list[str]:
    """Normalised sentences outside code, with marked shapes of what may be placeholders."""
    if "```" in text or "~~~" in text:
        text = _FENCE.sub("\n", text)
    if "`" in text:
        text = _INLINE.sub(CODE, text)
    text = text.replace(OPEN, " ").replace(CLOSE, " ")
    text = _PLACE.sub(_shape, text).replace("@", " at ").replace("\ue012", "@")
    if "<" in text:
        text = _TAG.sub("\n", _COMMENT.sub(r"\n\1\n", _XML.sub(r" \1 ", text)))
    text = _NUMBER.sub("0", text.lower().replace("’", "'")).replace("\ue013", "<").replace("\ue014", ">")
    out = []
    for s in _CUT.split(text):
        s = _LEAD.sub("", s)
        if s:
            out.append(" ".join(s.split()))
    return out


def cells(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(cell of the n-gram that begins at each position; offsets of the lines).  Lines are padded, so that
    every position of a line has an n-gram."""
    flat = "".join("\n" + s + "\n" * (N - 1) for s in lines)
    code = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = code[: len(code) - N + 1].copy() if len(code) >= N else np.zeros(0, np.uint64)
    for k in range(1, N):
        h = h * np.uint64(0x100000001B3) + code[k : len(code) - N + 1 + k]
    where = (mix(h) & np.uint64(BUCKETS - 1)).astype(np.int64)
    lens = np.array([len(s) + N for s in lines], np.int64)
    return where, np.concatenate(([0], np.cumsum(lens)))


def _line_cells(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cells, begin, end) with the positions of each line's own n-grams (those that begin in it)."""
    where, offsets = cells(lines)
    begin = offsets[:-1]
    end = np.minimum(begin + np.array([max(1, len(s) - N + 3) for s in lines], np.int64), len(where))
    return where, begin, end


def residue_counts() -> dict[str, np.ndarray]:
    """n-gram frequencies of each residue class from the labelled phrases."""
    out = {}
    for name, text in CLASSES.items():
        halves = []
        for part in (text, PARTS.get(name, "")):
            if name == "shape":
                lines = [line for line in part.split("\n") if line]
            else:
                lines = [_NUMBER.sub("0", " ".join(s.split())) for line in part.lower().split("\n") for s in _CUT.split(line) if s.strip()]
            if lines:
                where, begin, end = _line_cells(lines)
                count = np.zeros(BUCKETS)
                for b, e in zip(begin, end):
                    np.add.at(count, where[b:e], 1)
                halves.append(count / count.sum())
        out[name] = sum(halves) / len(halves)
    return out


def prose_counts(docs: DataFrame) -> np.ndarray:
    """n-gram frequencies over the distinct sentences of all documents (columns text), so that copies teach nothing
    anew; at most BUCKETS sums reach the driver."""

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            lines = {s for t in part.column(0).to_pylist() if t for s in sentences(t)}
            yield pa.RecordBatch.from_arrays([pa.array([s.encode("utf-8", "surrogatepass") for s in lines], pa.binary())], names=["line"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for part in parts:
            lines = [x for s in part.column(0).to_pylist() for plain, found in [shape_lines(s.decode("utf-8", "surrogatepass"))] for x in (plain, *found)]
            for i, j in batches(lines, most=len(lines)):
                total += np.bincount(cells(lines[i:j])[0], minlength=BUCKETS)
        has = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(total[has])], names=["cell", "n"])

    lines = docs.select("text").mapInArrow(cut, "line binary").distinct()
    sums = lines.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS)
    got = sums.toArrow()
    out[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    return out / max(1.0, out.sum())


def ratios(prose: np.ndarray) -> np.ndarray:
    """float32 [class, cell]: clamped log-likelihood ratios.  An n-gram that neither model knows speaks against a class of
    set phrases, and half as much against one of general material (``UNKNOWN``)."""
    rows = []
    for name, r in residue_counts().items():
        unknown = SMOOTH_RESIDUE * (UNKNOWN if name in GENERAL else UNKNOWN_SET)
        rows.append(np.log((r + SMOOTH_RESIDUE) / (prose + SMOOTH_PROSE + unknown)))
    return np.clip(np.array(rows), -CLAMP, CLAMP).astype(np.float32)


def score(lines: list[str], table_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(best class, mean ratio, covered share) of each line; classes whose windows cover enough of it go before others."""
    where, begin, end = _line_cells(lines)
    n = len(lines)
    best, cover, kind, rank = np.full(n, -np.inf), np.zeros(n), np.zeros(n, np.int64), np.full(n, -np.inf)
    size = end - begin
    owner = np.repeat(np.arange(n), size)
    first = np.cumsum(size) - size
    pos = np.arange(len(owner)) + np.repeat(begin - first, size)
    # windows are cut at the line's ends
    lo = np.maximum(pos - WINDOW // 2, begin[owner])
    hi = np.minimum(pos + WINDOW // 2 + 1, end[owner])
    least = 0.25 * (hi - lo)
    total = np.zeros(len(where) + 1)
    for c in range(len(table_)):
        np.cumsum(table_[c][where], dtype=np.float64, out=total[1:])
        mean = (total[end] - total[begin]) / size
        good = (total[hi] - total[lo]) > least
        share = np.add.reduceat(good, first, dtype=np.int64) / size if n else cover
        order = mean + 2 * CLAMP * (share >= COVERAGE)
        better = np.flatnonzero(order > rank)
        rank[better], best[better], kind[better], cover[better] = order[better], mean[better], c, share[better]
    return kind, best, cover


def _repeats(s: str) -> bool:
    """Six times the same one to three tokens; few distinct tokens are asked for first."""
    w = s.split()
    return len(w) >= 6 and 3 * len(set(w)) <= len(w) and _REPEAT.search(s + " ") is not None


#: Lines that go with residue but are no evidence by themselves.
_WEAK = {"menu", "see error", "why?", "testing", "checks", "component", "summary", "untitled document", "reference 0", "vorgang 0", "referencia 0"}


def judge(lines: list[str], table_: np.ndarray) -> tuple[str | None, float]:
    """(class of the strongest residue or None, share of characters in residue sentences)."""
    return judge_all([lines], table_)[0]


def judge_all(docs: list[list[str]], table_: np.ndarray) -> list[tuple[str | None, float]]:
    """``judge`` of many documents: their sentences are scored together, since calls cost more than characters."""
    flat = [shape_lines(s) for lines in docs for s in lines]
    if not flat:
        return [(None, 0.0)] * len(docs)
    kind, mean, cover = (x.tolist() for x in score([s for s, _ in flat], table_[:-1]))
    marked = [x for _, found in flat for x in found]
    unfilled = iter(())
    if marked:
        _, m, c = score(marked, table_[-1:])
        unfilled = iter(((m >= SHAPE_MEAN) & (c >= COVERAGE)).tolist())
    names = list(CLASSES)
    general = [name in GENERAL for name in names]
    out: list[tuple[str | None, float]] = []
    at = 0
    for lines in docs:
        found, top, inside, total = None, 0.0, 0, 0
        for n in range(at, at + len(lines)):
            s, places = flat[n]
            size = len(s)
            total += size
            open_ = sum(len(x) for x in places if next(unfilled))
            least = SHORT_MEAN if size < SHORT and "0" not in s and "." not in s else GENERAL_MEAN if general[kind[n]] else MEAN
            likely = mean[n] >= least and cover[n] >= COVERAGE and s not in _WEAK and sum(map(str.isalnum, s)) >= LEAST
            whole = likely or (size > 40 and _repeats(s))
            if whole or open_:
                inside += size if whole else min(size, open_)
                if found is None or mean[n] > top:
                    found, top = ("form" if open_ else names[kind[n]]), mean[n]
        at += len(lines)
        share = inside / max(1, total)
        out.append((found if share > EXCLUDE else None, share))
    return out


def p10_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, residue (class or null), coverage of every document.

    Null, empty and blank texts have no residue; a text of code only has none either.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return detect(docs)


def detect(docs: DataFrame) -> DataFrame:
    model = docs.sparkSession.sparkContext.broadcast(ratios(prose_counts(docs)))  # BUCKETS times classes floats

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            kinds, covers = [], []
            texts = part.column("text").to_pylist()
            for i, j in batches(texts, chars=300_000):
                for k, c in judge_all([sentences(t) if t and not t.isspace() else [] for t in texts[i:j]], model.value):
                    kinds.append(k)
                    covers.append(c)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(kinds, pa.string()), pa.array(covers, pa.float64())], names=["doc_id", "residue", "coverage"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, residue string, coverage double")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id of the documents with residue in place of content."""
    return p10_residue(spark, sf_dir).where("residue is not null").select("doc_id")


def p10_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus (all columns) without the documents that have residue."""
    docs = table(spark, sf_dir, "documents")
    return docs.join(p10_found(spark, sf_dir), "doc_id", "left_anti")


QUERIES = {"p10_found": p10_found, "p10_residue": p10_residue, "p10_clean": p10_clean}
