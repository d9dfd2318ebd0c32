"""Problem 6: credentials in source code, found and redacted in place.

1. A keyword automaton (Aho-Corasick over the lower-cased text) says which lines can hold a credential; every
   pattern below needs one of its keywords but the pairs in comments, whose lines are sought by themselves.
2. Issuer formats, key blocks, logins in URLs, commands and connection strings, and assignments of a literal
   to a credential's name.
3. Validation: checksums (the CRC-32 at the end of an issuer's token) or structure (a token's random part, JWT parts
   that decode to JSON, Basic that decodes to user:password, a key block of base64 only), and no placeholder,
   reference, field name, digest, path or identifier.  A token whose checksum fails still counts if its random
   part looks random: it may be revoked, mistyped or of an older form.
4. Redaction: each letter or digit of the value is replaced by one of the same class (lower, upper, digit) that is in the
   value's alphabet (hexadecimal, base32, base64, bytes in UTF-8), other characters and escapes stay, so lengths, line
   numbers and quoting hold.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.sources.tables import table

# issuers' token formats (keyword in lower case, pattern).
ISSUERS: list[tuple[str, str]] = [
    ("akia", r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])"),
    ("asia", r"(?<![A-Za-z0-9])ASIA[A-Z0-9]{16}(?![A-Za-z0-9])"),
    ("ghp_", r"\bghp_[A-Za-z0-9]{30,}"),
    ("gho_", r"\bgho_[A-Za-z0-9]{30,}"),
    ("ghs_", r"\bghs_[A-Za-z0-9]{30,}"),
    ("ghu_", r"\bghu_[A-Za-z0-9]{30,}"),
    ("github_pat_", r"\bgithub_pat_[A-Za-z0-9_]{40,}"),
    ("glpat-", r"\bglpat-[A-Za-z0-9_\-]{18,}"),
    ("xoxb-", r"\bxoxb-[A-Za-z0-9\-]{20,}"),
    ("xoxp-", r"\bxoxp-[A-Za-z0-9\-]{20,}"),
    ("xoxa-", r"\bxoxa-[A-Za-z0-9\-]{20,}"),
    ("xapp-", r"\bxapp-[A-Za-z0-9\-]{20,}"),
    ("sk_live_", r"\bsk_live_[A-Za-z0-9]{16,}"),
    ("sk_test_", r"\bsk_test_[A-Za-z0-9]{16,}"),
    ("rk_live_", r"\brk_live_[A-Za-z0-9]{16,}"),
    ("aiza", r"\bAIza[A-Za-z0-9_\-]{35}"),
    ("npm_", r"\bnpm_[A-Za-z0-9]{30,}"),
    ("pypi-", r"\bpypi-[A-Za-z0-9_\-]{40,}"),
    ("sg.", r"\bSG\.[A-Za-z0-9_\-]{16,}\.[A-Za-z0-9_\-]{16,}"),
    ("hf_", r"\bhf_[A-Za-z0-9]{30,}"),
    ("dop_v1_", r"\bdop_v1_[a-f0-9]{40,}"),
    ("shpat_", r"\bshpat_[a-fA-F0-9]{32}"),
    ("key-", r"\bkey-[0-9a-f]{32}\b"),
]
_JWT = re.compile(r"\beyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{4,}\.[A-Za-z0-9_\-]{8,}")
_PRIVATE = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_PRIVATE_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
# The body of a key block: base64 runs between quotes, joints of literals, line marks and escaped line breaks; its headers.
_KEY_HEADER = re.compile(r"(?:Proc-Type|DEK-Info|Version|Comment|Charset|Hash|MessageID):[^\n\\\"'`]*")
_KEY_GAP = re.compile(r"(?:\\[nrt]|[\s\"'`,#*|>()]|\+[ \t]*(?=\n)|//(?=[ \t])|\\(?=\n))+")
_KEY_RUN = re.compile(r"[A-Za-z0-9+/=]+")
LEAST_RUN = 16  # characters of a full line of a key
_URL = re.compile(r"[A-Za-z][A-Za-z0-9+.\-]*://(?P<user>[^\s/:@\"'`<>]*):(?P<value>[^\s/\"'`]+?)@(?=[\w\[])")
_BASIC = re.compile(r"\b[Bb]asic\s+(?P<value>[A-Za-z0-9+/]{8,}={0,2})")
_BEARER = re.compile(r"\b[Bb]earer\s+(?P<value>[A-Za-z0-9_\-.=+/~]{12,})")
# user and password on a command line: -psecret of database clients, -u user:secret, --password secret
_CLI_P = re.compile(r"\b(?:mysql|mysqldump|mysqladmin|mariadb)\b[^\n\"'`]*?\s-p(?P<value>[^\s\"'`]+)")
_CLI_U = re.compile(r"(?:\s|[\"'])(?:-u|--user|--proxy-user)[ =][\"']?(?P<user>[^\s:\"'`/$]+):(?P<value>[^\s\"'`]+)")
_CLI_LONG = re.compile(r"--(?:password|passwd|pass|token|api-key|apikey|secret|auth-token|access-token)(?:[ =])[\"']?(?P<value>[^\s\"'`]+)")
_SSHPASS = re.compile(r"\bsshpass\s+-p\s*(?P<value>[^\s\"'`]+)")
# user / value or user:value at the end of a comment, after a colon
_PAIR = re.compile(r"^[ \t]*(?:#|//|/?\*|--|;).*?:\s+(?P<user>[\w.@\-]+)\s*(?:/|:|\|)\s*(?P<value>\S+?)[ \t]*(?:\*/)?$", re.M)
_PAIR_COLON = re.compile(r":(?=[^\S\n]+[\w.@\-]+[^\S\n]*[/:|])")  # what any pair on one line has, wherever a line's colon stands
_COMMENT_LINE = re.compile(r"[ \t]*(?:#|//|/?\*|--|;)")
# Times, file names and versions with a suffix: as values of pairs they need more than the pair's form.
_NO_PAIR = re.compile(r"[\d:.,\-+TZ]+|.*\.[A-Za-z]\w{0,4}(?::\d+)*|[vV]?\d+(?:\.\d+)+[\w.\-]*|//.*")
# Names of credentials as they end an identifier (camel case and _ - separated), in several languages.
_NAME_WORDS = (
    r"pass(?:word|wd|phrase|code|wort)?|pwd|pw|passwort|kennwort|contrase(?:n|ñ)a|clave|secreto?|geheimnis|jeton|"
    r"mot_?de_?passe|tokens?|api_?keys?|apikeys?|access_?keys?(?:_?id)?|secret_?keys?|private_?keys?|signing_?keys?|encryption_?keys?|auth_?keys?|"
    r"master_?keys?|client_?keys?|account_?keys?|shared_?keys?|licen[cs]e_?keys?|service_?keys?|credentials?|creds?|auth|bearer|jwt"
)
_NAME = re.compile(rf"(?:^|[_\-.]|(?<=[a-z0-9])(?=[A-Z]))(?:{_NAME_WORDS})(?:[_\-]?(?:value|str|string|raw|prod|dev|test|live|\d+))?$", re.I)
_NAME_MID = re.compile(rf"(?:^|[_\-.])(?:{_NAME_WORDS})[_\-][a-z]+\d*$", re.I)
_NOT_WORDS = "ref|refs|field|name|header|param|params|label|url|uri|path|file|hash|digest|checksum|sha|id_field|column|prompt|hint|regex|pattern|type|policy|length|len|min|max|count|expiry|ttl|env|var|placeholder|key_name|public"
_NOT_NAME = re.compile(
    rf"(?:^|[_\-.])(?:{_NOT_WORDS})$|" + "(?-i:(?<=[a-z0-9])(?:" + "|".join(w.capitalize() for w in _NOT_WORDS.split("|")) + "))$", re.I
)
_LIT = r"(?:\"(?P<d>(?:[^\"\\\n]|\\.)*)\"|'(?P<s>(?:[^'\\\n]|\\.)*)'|`(?P<b>[^`\n]*)`)"
_KEYCHARS = r"[A-Za-z_$][\w$\-.]*"
# name = literal, name: literal, "name": literal, name := literal, name => literal, with a type annotation or an opening parenthesis
_ASSIGN = re.compile(
    rf"(?P<q>[\"'`]?)(?P<name>{_KEYCHARS})(?P=q)\]?[ \t]*(?::[ \t]*[A-Za-z_][\w\[\]., |]*?[ \t]*)?(?:(?:=>|:=|==?)\s*|:[ \t]*)(?P<open>\(\s*)?(?:[bBuUrR]{{0,2}}){_LIT}"
)
_CALL = re.compile(rf"(?P<q>[\"'`])(?P<name>{_KEYCHARS})(?P=q)\s*,\s*{_LIT}")
_GETTER = re.compile(
    rf"(?:getenv|environ\.get|getOrDefault|get_env|lookup_env|getProperty|get|env|Getenv|config|getConfig|get_config|getString|option)\s*\(\s*[\"'`](?P<name>{_KEYCHARS})[\"'`]\s*,\s*{_LIT}"
)
_OR = re.compile(rf"(?:process\.env\.|env\.|ENV\[[\"'])(?P<name>[A-Za-z_]\w*)(?:[\"']\])?\s*(?:\|\||\?\?)\s*{_LIT}")
_BARE = re.compile(rf"^[ \t]*(?:#|//|;|\*|--|/\*)?[ \t]*(?:-\s+)?(?:export\s+|set\s+|ENV\s+)?(?P<name>{_KEYCHARS})\s*(?:=|:)\s*(?P<value>[^\s\"'`(){{}}\[\],;=<>$][^\s\"'`(){{}},;<>]*)[ \t]*(?:#.*|\*/)?$", re.M)
_INSIDE = re.compile(r"(?:^|[\s;&?,{(\"'`])(?P<name>[A-Za-z_][\w\-]*)\s?=\s?(?P<value>[^\s;&,\"'`(){}<>=$%]+)(?=$|[\s;&,\"'`)}])")

_PLACEHOLDER = re.compile(
    r"^(?:<.*>|\[.*\]|\{.*\}|\$\{.*\}|\$\w+|\{\{.*\}\}|%\(?\w*\)?[sdv]|%\w+%|\*+|x+|X+|\.+|-+|_+|#+|\?+|!+|"
    r"(?:your|my|the|some|insert|enter|change|replace|set|use|put|add|todo|tbd|fixme|dummy|example|sample|placeholder|redacted|removed|hidden|masked)"
    r"(?:[_\- .]\w*)*|change_?me\w*|replace_?me\w*|none|null|nil|undefined|true|false|test|empty|n/a|na|"
    r"password|passwd|pwd|secret|token|api_?key|new_?password|old_?password|username|user|login|string|str|value|default|required|optional)$",
    re.I,
)
_REFERENCE = re.compile(r"^(?:vault|env|secret|secrets|ssm|kms|arn|file|ref|sops|op|aws|gcp|azure|keyring|consul|config|https?|data|urn)[:/]|^\$|\$\{|\{\{|<[^>]*>|%\(|^process\.env|^os\.environ|^%[sdv]$", re.I)
_FIELD = re.compile(r"^[A-Za-z]+(?:[A-Z][a-z]+|[_\-][A-Za-z]+)*$")
_HEADER = re.compile(r"^[Xx]-[A-Za-z\-]+$|^Authorization$")
_PATH = re.compile(r"^(?:[\w.\-]+/)+[\w.\-]+$|^/[\w./\-]+$|^\.{1,2}/")
_FORMAT = re.compile(r"^\{[^}]*\}$|^f?\{|\{[A-Za-z_][\w.]*\}")

KEYWORDS = sorted(
    {k for k, _ in ISSUERS}
    | {"eyj", "private key", "://", "basic ", "bearer ", "-p", "-u ", "-u=", "--user", " / ", "login", "access", "--pass", "--token", "--api", "--secret", "--auth", "--access", "--proxy"}
    | {"pass", "pwd", "pw", "kennwort", "contrase", "clave", "secret", "geheimnis", "jeton", "motdepasse", "mot_de_passe", "token", "key", "cred", "auth", "jwt", "bearer"}
)


def automaton() -> ahocorasick.Automaton:
    auto = ahocorasick.Automaton()
    for k in KEYWORDS:
        auto.add_word(k, k)
    auto.make_automaton()
    return auto


def is_name(name: str) -> bool:
    """Whether an identifier names a credential's value (not a reference to it, its field or its digest)."""
    n = name.strip("$.-_")
    if _NOT_NAME.search(n):
        return False
    snake = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", n)
    return bool(_NAME.search(n) or _NAME.search(snake) or _NAME_MID.search(snake))


_AUTO = automaton()


def _shape(v: str) -> tuple[int, int]:
    """(character classes, distinct characters)"""
    kinds = any(c.islower() for c in v) + any(c.isupper() for c in v) + any(c.isdigit() for c in v) + any(not c.isalnum() for c in v)
    return kinds, len(set(v))


def is_value(v: str, named: bool = True) -> bool:
    """Whether a literal is a credential rather than a placeholder, reference, field name or path."""
    s = v.strip()
    if len(s) < (4 if named else 6) or _PLACEHOLDER.match(s) or _REFERENCE.search(s) or _FORMAT.search(s) or _HEADER.match(s) or s.endswith("://"):
        return False
    kinds, distinct = _shape(s)
    if distinct <= 2:
        return False
    if re.search(r"\s", s):
        return named and _is_phrase(s)
    if _PATH.match(s) and not (any(c.isdigit() for c in s) and any(c.isupper() for c in s)):
        return False
    if any(c.isdigit() for c in s) or re.search(r"[!#%&*+@^~=?]", s):
        return not re.fullmatch(r"[vV]?\d+(?:\.\d+)*|0x[0-9a-f]+|\d{4}-\d{2}-\d{2}.*", s)
    if _FIELD.match(s):
        # words only: several separated words are a pass phrase, mixed case runs a random token
        inner = re.findall(r"[A-Z]", s[1:])
        if re.fullmatch(r"[A-Z_\-]+|[A-Za-z]+(?:ID|URL|URI|API|KEY|JWT)", s):
            return False
        if re.fullmatch(r"[A-Za-z]?[a-z]*(?:[A-Z][a-z]+|[_\-][A-Za-z][a-z]+)*", s):
            # words in camel or snake case, unless a part of it cannot be said; one long word only by its name
            parts = re.findall(r"[A-Z]?[a-z]+", s)
            unsaid = any(len(w) >= 2 and not re.search(r"[aeiouyAEIOUY]", w) for w in parts)
            return len(s) >= 8 and (unsaid and len(parts) > 1 or named and s.islower() and s.isalpha())
        return len(s) >= 8 and bool(inner)
    return kinds >= 2 and len(s) >= 8


# Words of messages and prompts, which pass phrases lack.
_COMMON = set(
    "a an the is are was be been must may can not no or and of to for in on at by with from as if your you my our its this that it enter please type use set get "
    "invalid missing wrong required expired failed error too short long empty new old user name value here only same does do did has have will should "
    "password passwd passphrase secret token key login account access auth api email field "
    "der die das ein eine ist und oder nicht bitte ihr ihre mit von zu le la les un une est et ou ne pas votre avec de du des el los las es y o su con para por".split()
)


def _is_phrase(s: str) -> bool:
    """Whether a literal with spaces is a pass phrase (four words or more, none of a message's) or a password with a space."""
    parts = s.split(" ")
    if all(re.fullmatch(r"[^\W\d_]{3,}", w) for w in parts):
        return len(parts) >= 4 and not any(w.lower() in _COMMON for w in parts)
    return len(parts) <= 3 and not s.endswith((".", ":", "!")) and any(len(w) >= 8 and re.search(r"[A-Za-z]\d+[A-Za-z]", w) for w in parts) and not re.search(r"[(){}<>\[\]=;/]", s)


_B62 = ["0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"]
CHECKED = ("ghp_", "gho_", "ghs_", "ghu_", "npm_")  # 30 random characters and the CRC-32 of them in six of base 62
LEAST_DISTINCT = 6


def _checksum_ok(key: str, value: str) -> bool:
    body = value[len(key) :]
    if key not in CHECKED or len(body) != 36:
        return False
    crc = zlib.crc32(body[:30].encode())
    for digits in _B62:
        n, out = crc, ""
        for _ in range(6):
            n, d = divmod(n, 62)
            out = digits[d] + out
        if out == body[30:]:
            return True
    return False


def issued(key: str, value: str) -> str | None:
    """The kind of an issuer's token, or None where its part after the issuer's mark repeats a few characters."""
    if _checksum_ok(key, value):
        return "issuer_checksum"
    return "issuer" if len(set(value[len(key) :].lower())) >= LEAST_DISTINCT else None


def _key_end(text: str, at: int) -> tuple[int, int]:
    """(end, base64 characters) of the body of a key block that begins at ``at``: up to its end mark, or to where
    an unfinished one stops being a key's text (the closing quote, code or prose)."""
    end, size, last = at, 0, LEAST_RUN
    while True:
        gap = _KEY_GAP.match(text, at)
        at = gap.end() if gap else at
        if stop := _PRIVATE_END.match(text, at):
            return stop.end(), size
        if head := _KEY_HEADER.match(text, at):
            at = head.end()
            continue
        run = _KEY_RUN.match(text, at)
        # a short run ends a key: only before its end mark, a quote or the text's end, or if it is no word
        if not run or last < LEAST_RUN and not run.group().startswith("="):
            return end, size
        v = run.group()
        after = _KEY_GAP.match(text, run.end())
        closed = _PRIVATE_END.match(text, after.end() if after else run.end()) or run.end() == len(text) or text[run.end()] in "\"'`"
        if len(v) < LEAST_RUN and not closed and not (re.search(r"[0-9+/=]", v) and re.search(r"[A-Z]", v)):
            return end, size
        if not closed and not after:
            return end, size  # goes on as something else
        last = len(v)
        size += last
        at = end = run.end()


def _basic_ok(value: str) -> bool:
    try:
        text = base64.b64decode(value + "=" * (-len(value) % 4), validate=True).decode("utf-8")
    except (binascii.Error, ValueError):
        return False
    user, colon, password = text.partition(":")
    return bool(colon and user.isprintable() and len(password) >= 3)


def _jwt_ok(value: str) -> bool:
    try:
        head = value.split(".")[0]
        return isinstance(json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4))), dict)
    except (binascii.Error, ValueError):
        return False


def _literal(m: re.Match) -> tuple[str, int, int] | None:
    for g in ("d", "s", "b"):
        if m.group(g) is not None:
            return m.group(g), m.start(g), m.end(g)
    return None


_CONT = re.compile(rf"\s*\+\s*{_LIT}")
_CONT_PAREN = re.compile(rf"\s*(?:\+\s*)?{_LIT}")


def find(text: str, auto: ahocorasick.Automaton | None = None) -> list[tuple[int, int, str]]:
    """(begin, end, kind) of every part of a credential's value in ``text``, in order, without overlap.

    A value joined from several literals gives one span per literal.
    """
    low = lowered(text)
    windows, words = _windows(text, low, auto or _AUTO)
    pairs = _pairs(text)
    if not windows:
        return _merged(pairs)
    spans: list[tuple[int, int, str]] = []
    add = spans.append
    for key in _ISSUER_RULES.keys() & words:
        for m in _ISSUER_RULES[key].finditer(text):
            if kind := issued(key, m.group()):
                add((m.start(), m.end(), kind))
    if "eyj" in words:
        for m in _JWT.finditer(text):
            if _jwt_ok(m.group()):
                add((m.start(), m.end(), "jwt"))
    if "private key" in words:
        stop = _PRIVATE_END.search(text)
        if stop and not _PRIVATE.search(text, 0, stop.start()):  # a cut-out that begins inside a key
            cut = re.search(r"(?:^[ \t]*[A-Za-z0-9+/=]{16,}[ \t]*\n)+[ \t]*\Z", text[: stop.start()], re.M)
            if cut:
                add((cut.start(), cut.end(), "key_body"))
        for m in _PRIVATE.finditer(text):  # over the whole text: a key spans lines
            end, size = _key_end(text, m.end())
            if size >= LEAST_RUN and len(set(text[m.end() : end])) >= LEAST_DISTINCT:
                add((m.start(), end, "private_key"))
    for begin, stop in windows:
        spans.extend(_in_window(text, low, begin, stop))
    have = {s[:2] for s in spans}
    return _merged(spans + [s for s in pairs if s[:2] not in have])


def lowered(text: str) -> str:
    """Lower case without a change of length, so that places in it hold in ``text``."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def _pairs(text: str) -> list[tuple[int, int, str]]:
    """Values of pairs at the end of comment lines, whether or not the line has a keyword."""
    spans: list[tuple[int, int, str]] = []
    done = -1
    for m in _PAIR_COLON.finditer(text):
        if m.start() < done:
            continue
        begin = text.rfind("\n", 0, m.start()) + 1
        done = text.find("\n", begin)
        done = len(text) if done < 0 else done
        if _COMMENT_LINE.match(text, begin):
            spans.extend(s for s in _pair(text, begin, done) if not _NO_PAIR.fullmatch(text, s[0], s[1]))
    return spans


def _pair(text: str, begin: int, stop: int) -> list[tuple[int, int, str]]:
    spans = []
    for m in _PAIR.finditer(text, begin, stop):
        v = m.group("value")
        if is_value(v, False) and not _PATH.match(v) and not re.search(r"[()\[\]{}<>,;]", v) and (any(c.isdigit() for c in v) or len(v) >= 8):
            spans.append((m.start("value"), m.end("value"), "pair"))
    return spans


def _windows(text: str, low: str, auto: ahocorasick.Automaton) -> tuple[list[tuple[int, int]], set[str]]:
    """Ranges of whole lines that have a keyword, each with the lines a literal there may go on to; the keywords."""
    out: list[tuple[int, int]] = []
    words: set[str] = set()
    done = -1
    for end, word in auto.iter(low):
        words.add(word)
        if end <= done:
            continue
        begin = text.rfind("\n", 0, end + 1) + 1
        done = text.find("\n", end)
        if done < 0:
            done = len(text)
        stop = done
        last = text[begin:stop].rstrip()[-1:]
        while stop < len(text) and last in ("(", "+", "\\", ",", '"', "'", "=", ":"):
            at = stop + 1
            stop = text.find("\n", at)
            stop = len(text) if stop < 0 else stop
            last = text[at:stop].rstrip()[-1:] or last
        done = stop
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((begin, stop))
    return out, words


def _in_window(text: str, low: str, begin: int, stop: int) -> list[tuple[int, int, str]]:
    spans: list[tuple[int, int, str]] = []
    add = spans.append
    low = low[begin:stop]
    if "://" in low:
        for m in _URL.finditer(text, begin, stop):
            v = m.group("value")
            if not _PLACEHOLDER.match(v) and not _REFERENCE.search(v) and not _FORMAT.search(v) and _shape(v)[1] > 2:
                add((m.start("value"), m.end("value"), "url"))
    if "basic " in low:
        for m in _BASIC.finditer(text, begin, stop):
            if _basic_ok(m.group("value")):
                add((m.start("value"), m.end("value"), "basic"))
    if "bearer " in low:
        for m in _BEARER.finditer(text, begin, stop):
            if is_value(m.group("value"), False) and any(c.isdigit() for c in m.group("value")):
                add((m.start("value"), m.end("value"), "bearer"))
    for rule in (_CLI_P, _CLI_U, _CLI_LONG, _SSHPASS) if "-" in low else ():
        for m in rule.finditer(text, begin, stop):
            v = m.group("value")
            if not _PLACEHOLDER.match(v) and not _REFERENCE.search(v) and not _FORMAT.search(v) and _shape(v)[1] > 2:
                add((m.start("value"), m.end("value"), "command"))
    for rule in (_ASSIGN, _CALL, _GETTER, _OR):
        for m in rule.finditer(text, begin, stop):
            if not is_name(m.group("name")):
                continue
            lit = _literal(m)
            value, parts, end = lit[0], [(lit[1], lit[2])], m.end()
            cont = _CONT_PAREN if rule is _ASSIGN and m.group("open") else _CONT
            while more := cont.match(text, end):
                nxt = _literal(more)
                value += nxt[0]
                parts.append((nxt[1], nxt[2]))
                end = more.end()
            if is_value(value):
                for b, e in parts:
                    if e > b:
                        add((b, e, "assigned"))
    for m in _BARE.finditer(text, begin, stop):
        if is_name(m.group("name")) and is_value(m.group("value")) and any(c.isdigit() for c in m.group("value")) and not re.search(r"[.\[(]", m.group("value")):
            add((m.start("value"), m.end("value"), "bare"))
    if ":" in low:
        spans.extend(_pair(text, begin, stop))
    for m in _INSIDE.finditer(text, begin, stop):
        v = m.group("value")
        if is_name(m.group("name")) and is_value(v) and not (v.isalpha() and (v.islower() or len(v) < 8)) and _quoted(text, m.start("name")):
            add((m.start("value"), m.end("value"), "inside"))
    return spans


def _quoted(text: str, at: int) -> bool:
    """Whether a place lies in a string literal or a comment of its line."""
    begin = text.rfind("\n", 0, at) + 1
    before = text[begin:at]
    return any(before.count(q) % 2 for q in "\"'`") or bool(re.match(r"\s*(?:#|//|\*|--|;)", before))


def _merged(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    out: list[tuple[int, int, str]] = []
    for b, e, kind in sorted(spans, key=lambda s: (s[0], -s[1])):
        if out and b < out[-1][1]:
            if e > out[-1][1]:
                out[-1] = (out[-1][0], e, out[-1][2])
            continue
        out.append((b, e, kind))
    return out


_ISSUER_RULES = {k: re.compile(p) for k, p in ISSUERS}
_ESCAPE = r"\\(?:u\{[0-9A-Fa-f]+\}|u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|x[0-9A-Fa-f]{2}|[0-7]{1,3}|.)"
_SIGN = re.compile(_ESCAPE + r"|[^\W_]", re.S)
_URL_SIGN = re.compile(_ESCAPE + r"|%[0-9A-Fa-f]{2}|[^\W_]", re.S)
#: (lower, upper, digit) placeholders of an alphabet, the first that holds all of a value.
_ALPHABETS = [
    (re.compile(r"[\W_]*[0-9a-fA-F](?:[\W_]*[0-9a-fA-F]){7,}[\W_]*"), "aA0"),
    (re.compile(r"(?=[^2-7]*[2-7])[A-Z2-7]{16,}=*"), "xX2"),
]


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """``text`` with the letters and digits of each value replaced within its alphabet (``_mask``); the marks and
    headers of key blocks and escapes stay."""
    out, at = [], 0
    for b, e, kind in spans:
        out.append(text[at:b])
        value = text[b:e]
        if kind == "private_key":
            head = _PRIVATE.match(value).end()
            tail = _PRIVATE_END.search(value, head)
            stop = tail.start() if tail else len(value)
            body, done = [], head
            for m in _KEY_HEADER.finditer(value, head, stop):
                body += [_masked(value[done : m.start()], _SIGN), m.group()]
                done = m.end()
            value = value[:head] + "".join(body) + _masked(value[done:stop], _SIGN) + value[stop:]
        else:
            value = _masked(value, _URL_SIGN if kind == "url" else _SIGN)
        out.append(value)
        at = e
    out.append(text[at:])
    return "".join(out)


def _masked(value: str, signs: re.Pattern) -> str:
    low, up, digit = next((marks for rule, marks in _ALPHABETS if rule.fullmatch(value)), "xX0")
    return signs.sub(lambda m: m.group() if len(m.group()) > 1 else _mask(m.group(), low, up, digit), value)


def _mask(c: str, low: str = "x", up: str = "X", digit: str = "0") -> str:
    """A character of the same class and of as many bytes in UTF-8."""
    if c < "\x80":
        return digit if c.isdigit() else up if c.isupper() else low
    if c < "\u0800":
        return "Ñ" if c.isupper() else "ñ"
    return "字" if c < "\U00010000" else "\U00020000"


def scan(rows: DataFrame) -> DataFrame:
    """dataset, row_id, n_found, linenos, kinds, redacted for rows of dataset, row_id, text.

    A null text gives no places and a null ``redacted``.  ``linenos`` has the line on which each value begins
    (a value joined from several literals counts once, at its first).
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton()
        for part in parts:
            lines, kinds, texts = [], [], []
            for text in part.column("text").to_pylist():
                spans = find(text, auto) if text else []
                at, done, ks = [], None, []
                for b, e, kind in spans:
                    if done is None or kind != "assigned" or not re.fullmatch(r"[\"'`]\s*(?:\+\s*)?(?:\\\n\s*)?[\"'`]", text[done:b]):
                        at.append(text.count("\n", 0, b) + 1)
                        ks.append(kind)
                    done = e
                lines.append(at)
                kinds.append(ks)
                texts.append(None if text is None else redact(text, spans) if spans else text)
            yield pa.RecordBatch.from_arrays(
                [part.column("dataset"), part.column("row_id"), pa.array(lines, pa.list_(pa.int64())), pa.array(kinds, pa.list_(pa.string())), pa.array(texts, pa.string())],
                names=["dataset", "row_id", "linenos", "kinds", "redacted"],
            )

    return rows.select("dataset", "row_id", "text").mapInArrow(
        run, "dataset string, row_id long, linenos array<long>, kinds array<string>, redacted string"
    )


def p6_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    sec = table(spark, sf_dir, "security_dataset").select(F.lit("security_dataset").alias("dataset"), F.col("record_id").alias("row_id"), F.col("source").alias("text"))
    snip = table(spark, sf_dir, "security_finding").select(F.lit("security_finding").alias("dataset"), F.col("finding_id").alias("row_id"), F.col("snippet").alias("text"))
    return scan(sec.unionByName(snip))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dataset, row_id, lineno of the lines on which a credential's value stands or begins."""
    return p6_scan(spark, sf_dir).select("dataset", "row_id", F.explode("linenos").alias("lineno")).distinct()


def p6_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dataset, row_id, text of all rows, credentials replaced."""
    return p6_scan(spark, sf_dir).select("dataset", "row_id", F.col("redacted").alias("text"))


QUERIES = {"p6_found": p6_found, "p6_redacted": p6_redacted}
