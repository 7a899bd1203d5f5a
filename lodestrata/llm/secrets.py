"""Credentials embedded in source code and configuration (problem 2).

Each text is searched once with a keyword automaton; a rule reads on from where
a word of it ends, as far as the value goes, so lines of any length are read
alike. A hit becomes a finding when its value has an issuer's format (whole, or
put together from adjacent string literals), is the password of a connection
URL, an authorization header or a private key block, or is a literal given to a
credential's name and is built like one. Literals of a short prefix and a long
random rest count as issued whoever the issuer is. Placeholders, references to
values kept elsewhere, checksums, public keys and plain words are not findings.
Structure is checked where it is published: a JSON header in a token of three
parts, ``user:password`` inside a basic header, base64 in a key. The checksum
of tokens that have one is reported (:func:`checksum`) but does not decide: a
token with a mistyped character still gives away the rest.

Redaction keeps the prefix by which an issuer is known and replaces every other
letter and digit by one of the value's own alphabet (a and 0 in hexadecimal, A
and 2 in base 32, else x, X and 0), so its length and the text around it stay;
what is redacted is not found again. A key block that is cut off by the end of
the text is blanked as far as it goes.

Texts are independent of each other: one Arrow pass over the scan, no shuffle.

Defined results:

- null or empty content: no finding; redacted to itself.
- null row id: kept as null. Repeated rows: findings for each.
- A value that spans lines is reported on the line where its text begins.
- Offsets count code points. Overlapping findings are merged when redacting.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import extension

FINDINGS = "origin string, row_id long, line_no int, kind string, start int, stop int, checksum boolean"

# Formats published or used by issuers, by the prefix that the automaton looks for.
ISSUERS = {
    "ghp_": r"ghp_[A-Za-z0-9]{36}",
    "gho_": r"gho_[A-Za-z0-9]{36}",
    "ghs_": r"ghs_[A-Za-z0-9]{36}",
    "github_pat_": r"github_pat_[A-Za-z0-9_]{60,}",
    "glpat-": r"glpat-[A-Za-z0-9_\-]{20}",
    "npm_": r"npm_[A-Za-z0-9]{36}",
    "pypi-": r"pypi-[A-Za-z0-9_\-]{50,}",
    "AKIA": r"AKIA[A-Z0-9]{16}",
    "ASIA": r"ASIA[A-Z0-9]{16}",
    "AIza": r"AIza[A-Za-z0-9_\-]{35}",
    "sk_live_": r"sk_live_[A-Za-z0-9]{24,}",
    "rk_live_": r"rk_live_[A-Za-z0-9]{24,}",
    "ghu_": r"ghu_[A-Za-z0-9]{36}",
    "ghr_": r"ghr_[A-Za-z0-9]{36,}",
    "xoxa-": r"xoxa-[A-Za-z0-9\-]{20,}",
    "xoxs-": r"xoxs-[A-Za-z0-9\-]{20,}",
    "xapp-": r"xapp-[A-Za-z0-9\-]{20,}",
    "SG.": r"SG\.[A-Za-z0-9_\-]{22}\.[A-Za-z0-9_\-]{43}",
    "hf_": r"hf_[A-Za-z0-9]{34}",
    "sk-": r"sk-(?:[a-z]+-){0,2}[A-Za-z0-9_]{32,}",
    "xoxb-": r"xoxb-[A-Za-z0-9\-]{20,}",
    "xoxp-": r"xoxp-[A-Za-z0-9\-]{20,}",
    "eyJ": r"eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+",
}
# What the name of a credential ends in; the kinds of key come before "key", with or without a mark between.
NAMES = ("password", "passwd", "passphrase", "pass", "pwd", "pw", "secret", "token", "auth", "credential", "credentials", "cred")
KEY_KINDS = ("api", "access", "secret", "signing", "encryption", "private", "deploy", "tls", "ssh", "account", "service")
_NAME = re.compile(rf"(?:^|_)(?:{'|'.join(NAMES)}|(?:{'|'.join(KEY_KINDS)})_?key)$")
#: What else the automaton looks for, and which rule reads on from there.
OTHER_WORDS = {
    "private key": "pem", "://": "url", "authorization": "header", "client(": "client", "connect(": "client", "login(": "client", "auth": "client",
    "?key=": "query", "&key=": "query", ";key=": "query", "sig=": "query", "signature=": "query", "login": "note", "works": "note", "rotat": "note", "key": "note",
    "-u ": "user", "--user ": "user", "--user=": "user",
}
#: Words that the automaton finds where a name may end, lower case: all that :data:`_NAME` accepts.
NAME_WORDS = (*NAMES, *(f"{kind}{mark}key" for kind in KEY_KINDS for mark in ("", "_", "-")))
_PLACEHOLDER = re.compile(
    r"(?i)^(?:x+|\*+|\.+|-+|_+|none|null|undefined|true|false|todo.*|fixme.*|tbd|n/?a|test|dummy.*|sample.*|fake.*|redacted.*|"
    r"your[-_ ].*|my[-_ ].*|some[-_ ].*|enter[-_ ].*|insert[-_ ].*)$|example|change_?me|replace[-_]?(?:me|with)|placeholder|xxxx|\*\*\*"
)
_WORDS = re.compile(r"[a-z]+(?:[-_ .][a-z]+)*[-_]?v?\d{0,2}|[A-Z]+(?:_[A-Z]+)*|[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+\(?\)?")
#: Base 64 that is no path, though it may begin with a slash: padded, or with a plus sign.
_BASE64 = re.compile(r"(?=.*\d)(?=.*[A-Z])(?=.*[a-z])(?:[A-Za-z0-9+/]{20,}=={0,1}|(?=.*\+)[A-Za-z0-9+/]{20,})")
_CHECKSUM = re.compile(r"(?i)^(?:sha\d+|md5|crc32)[-:]")
_STR = r"""[rbfuRBFU]{0,2}(?P<q0>["'`])(?P<v0>(?:(?!(?P=q0))[^\\\n]|\\.)*)(?P=q0)"""
_LITERAL = re.compile(_STR)
# What follows a name, from its end.
_ASSIGNED = re.compile(r"""["'`]?[^\S\n]*\]?[^\S\n]*(?::[^\S\n]*[A-Za-z][\w<>\[\]|]*[^\S\n]*(?==))?[=:][^\S\n]*(?P<open>[\(\[]\s*)?""" + _STR)
_PAIR = re.compile(r"""["'`]\s*,\s*""" + _STR)
_DEFAULT = re.compile(r"""(?:["']\])?\s*(?:\?\?|\|\|)\s*""" + _STR)
_PLAIN = re.compile(r"""["']?[ \t]*(?::[ \t]+|=[ \t]*|:=[ \t]*)(?P<v0>[^\s"'#`][^\s"'`]*)""")
_PLAIN_BEFORE = re.compile(r"""[ \t]*(?:-[ \t]+)?(?:(?:export|ENV|ARG|set)[ \t]+)?["']?(?:[A-Za-z_][\w\-.]*\.)?""")
_NAMED = re.compile(r"""["']?[ \t]*\r?\n[ \t]*value:[ \t]*["']?(?P<v0>[^\s"']+)""")
_NAMED_BEFORE = re.compile(r"""name:[ \t]*["']?\Z""")
_QUERY = re.compile(r"""=(?P<v0>[^\s&"'`#]+)""")
_NPMRC = re.compile(r"""=(?P<v0>[^\s"'`]+)""")
# What follows another word.
_URL = re.compile(r"""[^\s/:@"'`?#]*:(?P<v0>[^\s/@"'`]+(?:[^\s@"'`]*[^\s/@"'`])?)@[A-Za-z0-9\[]""")
_HEADER = re.compile(r"""(?i)["'`\]]{0,3}\s*[:=,]\s*f?["'`]?\s*(?P<how>bearer|token|basic|apikey)\s+(?P<v0>[^\s"'`]+)""")
_CLIENT = re.compile(r"""\w*\(\s*["'`][^"'`\n]*["'`]\s*,\s*["'`][^"'`\n]*["'`]\s*,\s*""" + _STR)
_CALL = re.compile(r"""\s*["'`][^"'`\n]*["'`]\s*,\s*["'`][^"'`\n]*["'`]\s*,\s*""" + _STR)
# A comment that ends in a value, and the value.
_LAST = re.compile(r"""(?P<v0>[^\s"'`]+)\s*(?:\*/)?\s*\Z""")
_BEFORE_LAST = re.compile(r"(?i)(?::|->|=>|=|\b(?:is|rotation|login|password|passwd|secret|token|credentials?))\s+\Z")
_USER = re.compile(r"""["']?[^\s:"'`/]+:(?P<v0>[^\s"'`]+)""")
_COMMENT = re.compile(r"(?:#|//|\*|--|;)")
#: A short prefix and random letters and digits, as many issuers write their tokens; whole, and where a literal begins like that.
_PREFIXED = re.compile(r"(?P<p>[a-z]{2,8})[-_.](?P<body>[A-Za-z0-9]{28,})")
_MAY_BE_PREFIXED = re.compile(r"""["'`][a-z]{2,8}[-_.][A-Za-z0-9]{4,}["'`]""")
#: Prefixes behind which such a literal is a digest or the name of something.
_DIGESTS = re.compile(r"(?i)sha\d*|md\d|crc\d*|blake\w*|hash|digest|etag|rev|commit|build|chunk|id|uid|uuid|guid|ref|file|img|asset|bundle|cache|page|node|user|org|tmp|test")
_WHY = re.compile(r"(?i)\b(?:login|works|key|rotat\w+|password|passwd|secret|token|cred\w*)\b|_(?:pw|pass|auth|secret|key|token|password)\b|passwd")
_NOTED = re.compile(r"[A-Za-z]+[-_.]?[A-Za-z]+[-_.]?\d{3,}[!%#$]?|[A-Za-z]+\d{3,}[A-Za-z]+[!%#$]?|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f-]{22}|[0-9a-f]{32,}|[A-Za-z0-9+/]{24,}={0,2}")
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_PEM_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
#: Lines of a key: base64 in any quoting, and the headers that armoured blocks have.
_PEM_BODY = re.compile(r"""(?:\\[nrt]|[\sA-Za-z0-9+/=\"'`\\,]|(?<=\n)[ \t]*(?:Proc-Type|DEK-Info|Version|Comment|Hash|Charset): [^\n]*)*+""")
_GAP = re.compile(r"\s*\\?\s*\+?\s*")
_LIST_GAP = re.compile(r"\s*,\s*")


@cache
def _tools():
    """The automaton and the compiled issuer formats, built once in each Python worker."""
    rules: dict[str, list[tuple[str, str]]] = {}
    for word in NAME_WORDS:
        rules.setdefault(word, []).append(("name", word))
    for word, rule in OTHER_WORDS.items():
        rules.setdefault(word, []).append((rule, word))
    for prefix in ISSUERS:
        rules.setdefault(prefix.lower(), []).append(("issuer", prefix))
    automaton = ahocorasick.Automaton()
    for word, what in rules.items():
        automaton.add_word(word, (len(word), tuple(what)))
    automaton.make_automaton()
    formats = {p: re.compile(r"(?<![A-Za-z0-9_])" + f + r"(?![A-Za-z0-9])") for p, f in ISSUERS.items()}
    whole = re.compile("|".join(f"(?:{f})" for f in ISSUERS.values()))
    return automaton, formats, whole


def _snake(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).replace("-", "_").lower()


def _is_name(name: str) -> bool:
    name = _snake(name)
    name = name.removesuffix("_parts")
    return bool(_NAME.search(name)) and "public" not in name


_PREFIX = re.compile("|".join(sorted((re.escape(p) for p in ISSUERS), key=len, reverse=True)) + r"|[a-z]{2,8}[-_.](?=[A-Za-z0-9]{28,}\Z)")


def _varied(value: str) -> bool:
    """Not the same few characters over and over behind the prefix, as in placeholders and in what this module writes."""
    m = _PREFIX.match(value)
    body = re.sub(r"[\W_]", "", value[m.end() :] if m else value)
    return len(set(body)) >= min(5, max(len(body), 2))


def _is_issued(value: str) -> bool:
    if not _tools()[2].fullmatch(value) or not _varied(value) or "EXAMPLE" in value.upper():
        return False
    if value.startswith("eyJ"):
        head = value.split(".")[0]
        try:
            return isinstance(json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4))), dict)
        except (binascii.Error, ValueError):
            return False
    return True


def _is_prefixed(value: str) -> bool:
    """Whether a value is built like a token, whoever its issuer is: a short prefix that is no digest's and a long random rest."""
    m = _PREFIXED.fullmatch(value)
    body = m.group("body") if m else ""
    mixed = len(re.findall(r"\d", body)) >= 2 and re.search(r"[A-Za-z]", body) or 0.3 <= len(_UPPER.findall(body)) / max(len(body), 1) <= 0.7  # no words
    return len(set(body)) >= 10 and bool(mixed) and not _DIGESTS.fullmatch(m.group("p"))


def checksum(value: str) -> bool | None:
    """Whether the checksum that an issuer publishes for its tokens holds; None where there is none.

    The last six characters of these tokens are the CRC-32 of those before, behind the prefix, in 62 digits.
    """
    m = re.fullmatch(r"(?:gh[opsur]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})", value)
    if not m:
        return None
    number, text = zlib.crc32(m.group(1).encode()), ""
    while number:
        number, digit = divmod(number, 62)
        text = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"[digit] + text
    return text.rjust(6, "0") == m.group(2)


def is_credential(value: str) -> bool:
    """Whether a literal given to a credential's name is a working value."""
    value = value.strip()
    if _is_issued(value) or _is_prefixed(value):
        return True
    if len(value) < 8 or re.search(r"[\s{}<>]|\$\(|\$[A-Z_]|%\(|://", value) or value[0] in "/~." and not _BASE64.fullmatch(value) or _CHECKSUM.match(value):
        return False
    if _PLACEHOLDER.search(value) or _WORDS.fullmatch(value) or not _varied(value):
        return False
    return bool(re.search(r"[A-Za-z]", value)) and (bool(re.search(r"\d", value)) or len(value) >= 20 and not value.islower())


def _folded(text: str, m: re.Match, listed: bool = False) -> tuple[str, int]:
    """The literal of m joined with the literals that directly follow it, however many, and where the last of them ends."""
    values, end = [m.group("v0")], m.end()
    while True:
        gap = _GAP.match(text, end)
        after = _LITERAL.match(text, gap.end())
        if after is None and listed and (gap := _LIST_GAP.match(text, end)):
            after = _LITERAL.match(text, gap.end())
        if after is None or gap.end() == end:
            return "".join(values), end
        values.append(after.group("v0"))
        end = after.end()


def scan_text(text: str, config: bool) -> list[tuple[int, int, str]]:
    """(start, stop, kind) of each credential in text. config: values may stand without quotes.

    The automaton finds where a rule may begin, and the rule reads on from there as far as its value goes,
    however long the line is. A word inside a run of letters and digits ends no name, so it costs one look.
    """
    if not text:
        return []
    automaton, formats, _ = _tools()
    low = text.lower()
    if len(low) != len(text):  # a few letters get longer in lower case
        low = "".join(c if len(c.lower()) > 1 else c.lower() for c in text)
    found: list[tuple[int, int, str]] = []
    notes: set[int] = set()
    line_end = name_end = key_end = issued_end = -1
    for at, (width, rules) in automaton.iter(low):
        stop, begin = at + 1, at + 1 - width
        for rule, word in rules:
            if rule == "issuer":
                if begin >= issued_end:
                    issued_end = _issued(text, begin, word, formats[word], found)
            elif rule == "name":
                if stop > name_end and not _goes_on(text, stop):
                    name_end = stop + (6 if text[stop : stop + 6].lower() == "_parts" else 5 if text.startswith("Parts", stop) else 0)
                    found += _after_name(text, name_end, config)
            elif rule == "pem":
                if begin >= key_end and (m := _PEM.match(text, max(text.rfind("-----BEGIN", 0, begin), 0))) and m.end() >= stop:
                    key_end = m.end()
                    found += _private_key(text, m)
            elif rule != "note":
                found += _after_word(text, begin, stop, rule)
            if rule in ("note", "name") and stop > line_end:
                line_end = text.find("\n", stop)
                line_end = len(text) if line_end < 0 else line_end
                notes.add(line_end)
    for end in notes:
        found += _note(text, text.rfind("\n", 0, end) + 1, end)
    taken = {start for start, _, kind in found if kind.startswith("issued")}
    read = 0  # literals of one chain are put together once
    for m in _MAY_BE_PREFIXED.finditer(text):
        if m.start() < read:
            continue
        lit = _LITERAL.match(text, m.start())
        value, end = _folded(text, lit, _is_listed(text, m.start()))
        read = end
        if m.start() + 1 not in taken and _is_prefixed(value):
            found.append((m.start() + 1, end - 1, "issued" if end == lit.end() else "issued, in parts"))
    return found


def _is_listed(text: str, at: int) -> bool:
    """Whether the literal at ``at`` is the first of a list."""
    return text[max(0, at - 24) : at].rstrip().endswith("[")


def _goes_on(text: str, at: int) -> bool:
    """Whether a name that has come this far does not end here."""
    c = text[at : at + 1]
    if c == "_":
        return text[at : at + 6].lower() != "_parts" or _goes_on(text, at + 6)
    return c.isalnum() or c == "$" or c == "-" and text[at + 1 : at + 2].isalnum() or text[at : at + 5] == "Parts" and _goes_on(text, at + 5)


def _issued(text: str, at: int, prefix: str, form: re.Pattern, found: list[tuple[int, int, str]]) -> int:
    """Add the token that begins with a prefix at ``at``, if there is one; where the literals that were read for it end."""
    if not text.startswith(prefix, at):  # the automaton reads lower case
        return -1
    if (m := form.match(text, at)) and _is_issued(m.group()):
        found.append((at, m.end(), "issued"))
    elif at and text[at - 1] in "\"'`" and (lit := _LITERAL.match(text, at - 1)):
        value, end = _folded(text, lit, _is_listed(text, at - 1))
        if _is_issued(value):
            found.append((at, end - 1, "issued, in parts"))
        return end
    return -1


def _after_name(text: str, stop: int, config: bool) -> Iterator[tuple[int, int, str]]:
    """Values given to the name that ends at ``stop``."""
    start = stop
    while start and (text[start - 1].isalnum() or text[start - 1] in "_-"):
        start -= 1
    name = text[start:stop].lstrip("-0123456789")
    start = stop - len(name)
    if not name or not _is_name(name):
        return
    before = text[start - 1 : start]
    if m := _ASSIGNED.match(text, stop):
        value, end = _folded(text, m, (m.group("open") or "").startswith("["))
        if is_credential(value):
            yield m.start("v0"), end - 1, "assigned"
    if before and before in "\"'`" and (m := _PAIR.match(text, stop)) and is_credential(m.group("v0")):
        yield m.start("v0"), m.end("v0"), "assigned"
    if text[max(0, start - 5) : start].endswith(("env.", 'env["', "env['")) and (m := _DEFAULT.match(text, stop)) and is_credential(m.group("v0")):
        yield m.start("v0"), m.end("v0"), "default"
    if before and before in "?&;" and (m := _QUERY.match(text, stop)) and is_credential(m.group("v0")):
        yield m.start("v0"), m.end("v0"), "assigned"
    if name.lower() in ("_authtoken", "_auth", "_password") and (m := _NPMRC.match(text, stop)) and is_credential(m.group("v0")):
        yield m.start("v0"), m.end("v0"), "assigned"
    if config:
        if (m := _PLAIN.match(text, stop)) and is_credential(m.group("v0")) and _PLAIN_BEFORE.fullmatch(text, text.rfind("\n", 0, start) + 1, start):
            yield m.start("v0"), m.end("v0"), "assigned"
        if (m := _NAMED.match(text, stop)) and is_credential(m.group("v0")) and _NAMED_BEFORE.search(text[max(0, start - 40) : start]):
            yield m.start("v0"), m.end("v0"), "assigned"


def _after_word(text: str, begin: int, stop: int, rule: str) -> Iterator[tuple[int, int, str]]:
    """What the rules for addresses, headers and calls find behind a word."""
    if rule == "url":
        if text[begin - 1 : begin].isalnum() and (m := _URL.match(text, stop)) and _is_url_password(m.group("v0")):
            yield m.start("v0"), m.end("v0"), "url"
    elif rule == "query":
        if (m := _QUERY.match(text, stop - 1)) and (text[begin] in "?&;" or text[begin - 1 : begin] in ("?", "&", ";")) and is_credential(m.group("v0")):
            yield m.start("v0"), m.end("v0"), "assigned"
    elif rule == "user":
        if text[begin - 1 : begin].isspace() and (m := _USER.match(text, stop)) and is_credential(m.group("v0")):
            yield m.start("v0"), m.end("v0"), "argument"
    elif rule == "client":
        m = (_CALL if text[stop - 1] == "(" else _CLIENT).match(text, stop)
        if m and is_credential(m.group("v0")):
            yield m.start("v0"), m.end("v0"), "argument"
    elif m := _HEADER.match(text, stop):
        value = m.group("v0")
        if m.group("how").lower() == "basic":
            try:
                user, colon, word = base64.b64decode(value, validate=True).decode().partition(":")
            except (binascii.Error, ValueError):
                return
            if colon and word and _varied(word):
                yield m.start("v0"), m.end("v0"), "header"
        elif is_credential(value):
            yield m.start("v0"), m.end("v0"), "header"


def _note(text: str, a: int, b: int) -> Iterator[tuple[int, int, str]]:
    """A value at the end of a comment that says what it is for."""
    line = text[a:b].rstrip()
    tail = max(line.removesuffix("*/").rstrip().rfind(c) for c in " \t")
    m = _LAST.match(line, tail + 1)
    if not m or not _BEFORE_LAST.search(line[max(0, tail - 16) : tail + 1]):
        return
    value = m.group("v0")
    if not (_is_issued(value) or _is_prefixed(value) or _NOTED.fullmatch(value) and is_credential(value)):
        return
    mark = _COMMENT.search(line, 0, m.start())
    if mark and _WHY.search(line, mark.end(), m.start()):
        yield a + m.start("v0"), a + m.end("v0"), "note"


def _is_url_password(value: str) -> bool:
    return len(value) >= 6 and not re.search(r"[{}<>$\s]", value) and not _PLACEHOLDER.search(value) and _varied(value) and value.lower() not in ("password", "passwd", "secret", "pass")


def _private_key(text: str, m: re.Match) -> Iterator[tuple[int, int, str]]:
    """The key block that begins at m; one without an end runs as far as lines of a key go."""
    body = _PEM_BODY.match(text, m.end())
    end = _PEM_END.match(text, body.end())
    coded = re.sub(r"\\[nrt]|[\s\"'`+\\,]|(?m:^[ \t]*[A-Za-z\-]+:[ ].*$)", "", body.group())
    coded = re.sub(r"=[A-Za-z0-9+/]{4}\Z", "=", coded) if coded.count("=") > 1 and "=" in coded[:-2] else coded  # the checksum of an armoured block
    if len(coded) >= 40 and len(set(coded)) >= 12 and _decodes(coded):
        yield m.start(), end.end() if end else body.end(), "private key"


def _decodes(coded: str) -> bool:
    """Whether text is base64; one that breaks off may lack the end of its last group."""
    coded = coded.rstrip("=")
    coded = coded[: len(coded) - (len(coded) % 4 == 1)]
    try:
        return len(base64.b64decode(coded + "=" * (-len(coded) % 4), validate=True)) > 0
    except (binascii.Error, ValueError):
        return False


_LOWER = re.compile("[a-z]")
_UPPER = re.compile("[A-Z]")
_DIGIT = re.compile("[0-9]")
_BETWEEN = re.compile(r"""["'`](?:[\s+,\\]|\\n)+[rbfuRBFU]{0,2}["'`]|\\[nrt]""")


def redact_text(text: str, config: bool) -> str:
    """text with its credentials blanked, of the same length and line structure."""
    out, at = [], 0
    for start, stop, kind in sorted(scan_text(text, config)):
        start = max(start, at)
        if stop <= start:
            continue
        out.append(text[at:start])
        value = text[start:stop]
        kept = [m.span() for m in _BETWEEN.finditer(value)]  # what stands between the parts of a value in several literals
        if kind == "private key":  # the frame stays, so that the text still shows what stood there
            kept += [m.span() for rule in (_PEM, _PEM_END) for m in rule.finditer(value)]
        elif m := _PREFIX.match(value):
            kept.append(m.span())
        blank, x = _alphabet(value), 0
        for s, e in sorted(kept):
            if s >= x:
                out += (blank(value[x:s]), value[s:e])
                x = e
        out.append(blank(value[x:]))
        at = stop
    out.append(text[at:])
    return "".join(out)


def _alphabet(value: str):
    """What blanks a value by characters of its own alphabet: hexadecimal, base 32, or letters and digits."""
    m = _PREFIX.match(value)
    body = re.sub(r"[\W_]", "", value[m.end() :] if m else value)
    lower, upper, digit = "x", "X", "0"
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", body):
        lower, upper = "a", "A"
    elif re.fullmatch(r"[A-Z2-7]+", body):
        digit = "2"
    return lambda part: _DIGIT.sub(digit, _UPPER.sub(upper, _LOWER.sub(lower, part)))


def _find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for origin, row, text, config in zip(batch.origin, batch.row_id, batch.content, batch.config, strict=True):
            for start, stop, kind in scan_text(text, config) if text else ():
                out.append((origin, row, text.count("\n", 0, start) + 1, kind, start, stop, checksum(text[start:stop])))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in FINDINGS.split(", ")])


def _redact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        new = [redact_text(t, c) if t else t for t, c in zip(batch.content, batch.config, strict=True)]
        yield pd.DataFrame({"origin": batch.origin, "row_id": batch.row_id, "content": new, "changed": [a != b for a, b in zip(new, batch.content, strict=True)]})


def unquoted(path: Column) -> Column:
    """True where values may stand without quotes: every file but source code and prose."""
    return ~F.coalesce(extension(path).isin(".py", ".ts", ".tsx", ".js", ".jsx", ".json"), F.lit(False))


def texts(files: DataFrame | None, chunks: DataFrame | None) -> DataFrame:
    """files and chunks in the one shape that the operators take: origin, row_id, content, config."""
    parts = []
    if files is not None:
        parts.append(files.select(F.lit("files").alias("origin"), F.col("id").cast("long").alias("row_id"), "content", unquoted(F.col("path")).alias("config")))
    if chunks is not None:
        parts.append(chunks.select(F.lit("chunks").alias("origin"), F.col("id").cast("long").alias("row_id"), "content", F.lit(False).alias("config")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def find_credentials(rows: DataFrame) -> DataFrame:
    """Findings (columns as in :data:`FINDINGS`) in rows of the shape of :func:`texts`."""
    return rows.mapInPandas(_find, FINDINGS)


def redact(rows: DataFrame) -> DataFrame:
    """(origin, row_id, content, changed): every text with its credentials blanked."""
    return rows.mapInPandas(_redact, "origin string, row_id long, content string, changed boolean")
