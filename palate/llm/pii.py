"""Personal data in texts: plain patterns, and the same patterns behind disguises, with spans in source characters."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palate.llm.common import map_texts

KINDS = ("email", "ip", "card", "phone")

# ---- the plain patterns, each as a scan that passes over a text once -------------------------------------------

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for place, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if place % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def plain_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind's number), sorted: leftmost non-overlapping matches of each kind that pass its test.

    An e-mail address's name is the whole run of name characters before its @, so each @ is looked at once."""
    found = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            found.append((start, m.end(), 0))
        free = m.end() if m else at + 1
        at = text.find("@", free)
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split(".")):
                found.append((m.start(), m.end(), 1))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), 2))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                    found.append((m.start(), m.end(), 3))
    return sorted(found, key=lambda s: (s[0], s[2]))


# ---- disguises: transducers over a tape of characters that remember their source ------------------------------

# Letters of other scripts that look like Latin ones, by pairs.
LOOKALIKES = dict(zip(
    "АВЕЅІЈКМНОРСТУХаеѕіјорсухԁһԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧανορ",
    "ABESIJKMHOPCTYXaesijopcyxdhqwABEZHIKMNOPTYXavop", strict=True,
))
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
# The English names of the digits.
DIGIT_NAMES = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}

_ODD = re.compile(
    f"[{''.join(LOOKALIKES)}{INVISIBLE}\uff01-\uff5e\u0660-\u0669\u06f0-\u06f9\u0966-\u096f\u2010-\u2015\u2212\u00a0\u202f\U0001d7ce-\U0001d7ff]"
)
_NAME = "|".join(DIGIT_NAMES)
_SPELLED = re.compile(rf"(?<![A-Za-z])(?:{_NAME})(?:[\s,.-]{{1,3}}(?:{_NAME}))+(?![A-Za-z])", re.IGNORECASE)
_ONE_NAME = re.compile(rf"{_NAME}", re.IGNORECASE)
_PLUS = re.compile(r"(?<![A-Za-z])plus\s{1,3}(?=[0-9])", re.IGNORECASE)
_IN_BRACKETS = r"\s{0,3}[\[({<]\s{0,3}%s\s{0,3}[\])}>]\s{0,3}"
_DOT_SIGN = rf"(?:{_IN_BRACKETS % r'(?:dot|[.])'}|\s{{1,3}}dot\s{{1,3}}|\.)"
_AT_SIGN = rf"(?:{_IN_BRACKETS % '(?:at|@)'}|\s{{1,3}}at\s{{1,3}}|@)"
_ADDRESS = re.compile(
    rf"(?<=[A-Za-z0-9_%+-])(?P<at>{_AT_SIGN})(?P<domain>[A-Za-z0-9-]{{1,63}}(?:{_DOT_SIGN}[A-Za-z0-9-]{{1,63}}){{1,8}})(?![A-Za-z0-9-])", re.IGNORECASE
)
_DOT = re.compile(_DOT_SIGN, re.IGNORECASE)
# Words of prose, not of addresses, before a plain "at" or in what follows it.
NO_NAMES = set(
    "a an the this that these those my your his her its our their me us him them it you he she we they i who which what where when there here "
    "is are was were be been look looks looked looking meet meets met meeting point points pointed work works worked working arrive arrived arrives "
    "stay stayed stays live lives lived stop stopped start started begin ends ended end sit sits stand stands stood held hold good bad not and or then so but "
    "if as of in on to by for from with up down out back home time price cost "
    "office shop house place school university team staff party show talk event dinner lunch night day morning evening people man woman "
    "dot point comma product products matrix vector company inc ltd llc corp gmbh".split()
)
_LAST_NAME = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOT_OF_NUMBERS = re.compile(rf"(?<=[0-9]){_IN_BRACKETS % r'(?:dot|[.])'}(?=[0-9])", re.IGNORECASE)
_HINT = re.compile(rf"[\[({{<]\s{{0,3}}(?:at|dot|@|\.)\s{{0,3}}[\])}}>]|\sdot\s|(?<![a-z])plus\s{{1,3}}[0-9]|(?<![a-z])(?:{_NAME})[\s,.-]{{1,3}}(?:{_NAME})(?![a-z])", re.IGNORECASE)


class Tape:
    """Characters, each with the source span that it stands for."""

    def __init__(self, text: str):
        self.text, self.start, self.end = text, list(range(len(text))), list(range(1, len(text) + 1))

    def rewrite(self, pattern: re.Pattern, put) -> None:
        """Each match becomes put(match): a list of (characters, from, to), places within the present text."""
        out, start, end, last = [], [], [], 0
        for m in pattern.finditer(self.text):
            out.append(self.text[last : m.start()])
            start += self.start[last : m.start()]
            end += self.end[last : m.start()]
            for chars, a, b in put(m):
                out.append(chars)
                start += [self.start[a]] * len(chars)
                end += [self.end[b - 1]] * len(chars)
            last = m.end()
        if last:
            self.text = "".join(out) + self.text[last:]
            self.start, self.end = start + self.start[last:], end + self.end[last:]


def _as_ascii(m: re.Match) -> list:
    c = m[0]
    if c in INVISIBLE:
        return []
    n = ord(c)
    if c in LOOKALIKES:
        c = LOOKALIKES[c]
    elif 0xFF01 <= n <= 0xFF5E:
        c = chr(n - 0xFEE0)
    elif n in (0xA0, 0x202F):
        c = " "
    elif 0x2010 <= n <= 0x2015 or n == 0x2212:
        c = "-"
    elif n >= 0x1D7CE:
        c = str((n - 0x1D7CE) % 10)
    else:
        c = str(n - (0x660 if n < 0x6F0 else 0x6F0 if n < 0x966 else 0x966))
    return [(c, m.start(), m.end())]


def _as_digits(m: re.Match) -> list:
    return [(DIGIT_NAMES[x[0].lower()], m.start() + x.start(), m.start() + x.end()) for x in _ONE_NAME.finditer(m[0])]


def _whole(chars: str):
    return lambda m: [(chars, m.start(), m.end())]


def _as_address(m: re.Match) -> list:
    """An at and its dots as signs. A plain ' at ' is prose and stays, with its dots, unless a dot of the domain is
    worded or bracketed and neither the word before nor a part of the domain is a word of prose."""
    dots = [(m.start("domain") + x.start(), m.start("domain") + x.end()) for x in _DOT.finditer(m["domain"])]
    signs = [(".", a, b) for a, b in dots]
    parts = [p.lower() for p in _DOT.split(m["domain"])]
    before = _LAST_NAME.search(m.string[max(0, m.start() - 64) : m.start()])
    prose = (before and before[0].lower() in NO_NAMES) or any(p in NO_NAMES for p in parts[:-1])
    prose = prose or (parts[-1] in NO_NAMES and len(parts[-1]) > 2)  # it, me, in and so on are domains
    if m["at"].strip().lower() != "at" or (any(b - a > 1 for a, b in dots) and not prose):
        signs.insert(0, ("@", m.start("at"), m.end("at")))
    elif prose:
        signs = []
    out, last = [], m.start()
    for c, a, b in [*signs, ("", m.end(), m.end())]:
        out += [(m.string[i], i, i + 1) for i in range(last, a)]
        out += [(c, a, b)] if c else []
        last = b
    return out


def disguised_spans(text: str, plain: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans that the plain patterns find only once disguises are undone; none touches a plain one."""
    odd = _ODD.search(text)
    if not odd and not _HINT.search(text):
        return []
    tape = Tape(text)
    if odd:
        tape.rewrite(_ODD, _as_ascii)
    tape.rewrite(_SPELLED, _as_digits)
    tape.rewrite(_PLUS, _whole("+"))
    tape.rewrite(_ADDRESS, _as_address)
    tape.rewrite(_DOT_OF_NUMBERS, _whole("."))
    starts = [a for a, _, _ in plain]
    reach = list(accumulate((b for _, b, _ in plain), max, initial=0))  # the last end of the first so many
    new = []
    for a, b, kind in plain_spans(tape.text):
        start, end = tape.start[a], tape.end[b - 1]
        if reach[bisect_left(starts, end)] <= start:
            new.append((start, end, kind))
    return new


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def scan(text: str | None) -> tuple:
    """(spans, and the digest columns) of one text; null counts as empty."""
    plain = plain_spans(text or "")
    new = disguised_spans(text or "", plain)
    every = sorted(plain + new, key=lambda s: (s[0], s[2], s[1]))
    counts = [sum(k == kind for _, _, k in plain) for kind in range(4)]
    return (*counts, hashlib.sha256(_listed(plain).encode()).hexdigest(), _listed(every), len(new))


def redact(text: str | None) -> str | None:
    """The text with each span replaced by its kind in brackets; spans that overlap become one."""
    if not text:
        return text
    plain = plain_spans(text)
    out, last = [], 0
    for a, b, kind in sorted(plain + disguised_spans(text, plain), key=lambda s: (s[0], -s[1])):
        if b > last:
            out += [text[last:a], f"[{KINDS[kind]}]"] if a >= last else []
            last = b
    return "".join([*out, text[last:]])


def find_personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) for each row of docs.

    The counts and the digest are those of the plain patterns; spans also holds what the transducers uncover, n_added
    of them. A null text is empty; a null key stays; repeated rows give repeated results; other columns are not read.
    No shuffle, and a text's work is in proportion to its length."""
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return map_texts(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), schema, lambda c: [(k, *scan(t)) for k, t in zip(*c)])


def redact_documents(docs: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """docs with personal data in `text` replaced, and `length`, where there is such a column, as the new length.

    Null texts stay null, a null id changes nothing, repeated rows stay repeated; all other columns pass unread."""
    new = F.pandas_udf(lambda s: s.map(redact, na_action="ignore"), "string")(F.col(text))
    out = docs.withColumn(text, new)
    return out.withColumn(length, F.length(text).cast(docs.schema[length].dataType)).select(*docs.columns) if length in docs.columns else out
