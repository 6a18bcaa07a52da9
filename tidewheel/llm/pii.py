"""Personal data by anchor expansion.

One Aho-Corasick pass over the whole text finds anchors: at-signs, plus signs,
digits, URL schemes and identifier cues ("password", "token", "AKIA", "IBAN",
...). At each anchor a deterministic local parser expands and validates the
boundaries of one kind of span. Every parser moves forward only, so the work
is linear in the text.

Kinds, in listed order: email, ip, card, phone (the base kinds), then login
(user information in a URL), secret (a value after a cue), key (access key
ids) and iban. Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, map_column

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "login", "secret", "key", "iban")
#: Words that announce a secret value, in any case; a space or hyphen may stand for an underscore.
CUES = ("password", "passwd", "passphrase", "pwd", "token", "secret", "api_key", "apikey", "access_key", "private_key")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = frozenset("0123456789")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOGIN = re.compile(r"[^\s/@:?#]++:[^\s/@?#]++(?=@)")
_VALUE = re.compile(r"""["']?[ ]?[=:][ ]?["']?([A-Za-z0-9+/_.~!$%^&*=-]{8,}+)""")
_KEY = re.compile(r"AKIA[0-9A-Z]{16}(?![0-9A-Za-z])")
_IBAN = re.compile(r"[ :]{0,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])")


def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for word, what in [("@", "@"), ("+", "+"), ("://", "/"), ("akia", "k"), ("iban", "i")]:
        a.add_word(word, (what, len(word)))
    for d in _DIGITS:
        a.add_word(d, ("d", 1))
    for cue in CUES:
        for form in {cue, cue.replace("_", " "), cue.replace("_", "-")}:
            a.add_word(form, ("c", len(form)))
    a.make_automaton()
    return a


_ANCHORS = None


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        total += v if k % 2 == 0 else (2 * v if v < 5 else 2 * v - 9)
    return total % 10 == 0


def _iban_ok(text: str) -> bool:
    t = text.replace(" ", "")
    return 15 <= len(t) <= 34 and int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1


def _lower(text: str) -> str:
    """The text in lower case, as many code points as before."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) > 1 else c.lower() for c in text)


def _secret(value: str) -> bool:
    """Whether a value is not just a word: it has a digit, a mark, or capitals
    within."""
    return any(c in _DIGITS or c in "!$%^&*~" for c in value) or value[1:] != value[1:].lower() and value != value.upper()


def spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all spans, in order; kind indexes KINDS."""
    global _ANCHORS
    if not text:
        return []
    if _ANCHORS is None:
        _ANCHORS = _automaton()
    return sorted(_expand(text, _ANCHORS.iter(_lower(text))))


def _expand(text: str, anchors: Iterator[tuple[int, tuple[str, int]]]) -> Iterator[tuple[int, int, int]]:
    email = ip = card = phone = secret = 0  # where the next match of the kind may start
    for last, (what, length) in anchors:
        at = last - length + 1
        if what == "d":
            if at >= ip and (at == 0 or text[at - 1] not in _DIGITS or at == ip):
                if m := _IP.match(text, at):
                    ip = m.end()
                    if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.groups()):
                        yield at, 1, ip
            if at >= card and (m := _CARD.match(text, at)):
                card = m.end()
                digits = m[0].replace(" ", "").replace("-", "") if card - at <= 64 else ""
                if 12 <= len(digits) <= 19 and luhn(digits):
                    yield at, 2, card
        elif what == "@":
            start = at
            while start > email and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                email = m.end()
                yield start, 0, email
        elif what == "+":
            if at >= phone and (m := _PHONE.match(text, at)):
                phone = m.end()
                if 9 <= sum(c in _DIGITS for c in m[0]) <= 15:
                    yield at, 3, phone
        elif what == "/":
            if m := _LOGIN.match(text, last + 1):
                yield m.start(), 4, m.end()
        elif what == "c":
            if at >= secret and (m := _VALUE.match(text, last + 1)):
                secret = m.end(1)  # of a plain word too: no end of it is anything else
                if _secret(m[1]):
                    yield m.start(1), 5, secret
        elif what == "k":
            if (at == 0 or not text[at - 1].isalnum()) and (m := _KEY.match(text, at)):
                yield at, 6, m.end()
        elif (m := _IBAN.match(text, last + 1)) and _iban_ok(m[1]):
            yield m.start(1), 7, m.end(1)


def listed(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def redact(text: str | None) -> str | None:
    """The text with each span, or run of spans that overlap, replaced by the
    kind of the first in angle brackets."""
    if not (found := spans(text)):
        return text
    out, at, end = [], 0, -1
    for a, k, b in found:
        if a >= end:
            out += [text[at:a], f"<{KINDS[k].upper()}>"]
        at = end = max(end, b)
    return "".join([*out, text[at:]])


def find_personal_data(docs: DataFrame, text: str = "text", id_col: str = "doc_id", redacted: bool = True) -> DataFrame:
    """One row for each input row: doc_id, counts by base kind, base_sha256,
    spans (all of them) and, if asked for, redacted: the text without them. A
    null text has no spans and stays null; long texts are read whole; ids may
    be null and rows repeat; spans that tie in start are listed by kind."""
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))

    def run(b: dict[str, list]) -> dict[str, list]:
        found = [spans(x) for x in b["text"]]
        base = [[s for s in f if s[1] < len(BASE)] for f in found]
        counts = {f"n_{name}": [sum(s[1] == k for s in f) for f in base] for k, name in enumerate(BASE)}
        return counts | {"doc_id": b["doc_id"], "base_sha256": [hashlib.sha256(listed(f).encode()).hexdigest() for f in base], "spans": [listed(f) for f in found]} | ({"redacted": [redact(x) if f else x for x, f in zip(b["text"], found, strict=True)]} if redacted else {})

    return map_batches(rows, run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string" + ", redacted string" * redacted)


def redact_column(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with personal data in one string column replaced, and n_chars, if
    there is such a column, counted anew; all else and the row count stay."""
    out = map_column(docs, text, lambda x: [redact(v) for v in x])
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length(text), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return out
