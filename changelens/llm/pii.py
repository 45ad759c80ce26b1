"""Operator 2: personal data by anchor expansion."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

DIGITS = frozenset("0123456789")
ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz") | DIGITS
LOCAL = ALNUM | frozenset("._%+-")
LABEL = ALNUM | frozenset("-")
PHONE = DIGITS | frozenset(" ().-")
URL_END = frozenset(" \t\n\x0b\f\r\"'<>`{}|\\^")
VALUE = ALNUM | frozenset("_-+/=.")
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "secret", "account")
#: Kinds that are personal data or secrets; an address of a page is neither.
PRIVATE = (*BASE, "secret", "account")
#: Cues after which a secret or an account number stands.
SECRET_CUES = ("token", "secret", "password", "passwd", "api_key", "apikey", "access_key", "private_key")
ACCOUNT_CUES = ("iban", "account", "acct", "konto", "compte", "cuenta", "passport", "ssn")
CUE_GAP = 24

Span = tuple[int, int]


def _run_right(text: str, at: int, chars: frozenset) -> int:
    n = len(text)
    while at < n and text[at] in chars:
        at += 1
    return at


def _run_left(text: str, at: int, low: int, chars: frozenset) -> int:
    while at > low and text[at - 1] in chars:
        at -= 1
    return at


def email_at(text: str, at: int, low: int) -> Span | None:
    """The address around the at-sign at `at` that starts at `low` or later: a local part, then two labels or more."""
    start = _run_left(text, at, low, LOCAL)
    end = _run_right(text, at + 1, LABEL)
    if start == at or end == at + 1:
        return None
    labels = 1
    while end < len(text) and text[end] == "." and (nxt := _run_right(text, end + 1, LABEL)) > end + 1:
        end, labels = nxt, labels + 1
    return (start, end) if labels > 1 else None


def ips_from(text: str, at: int) -> tuple[list[Span], int]:
    """Addresses in the chain of dotted digit groups that starts at `at`, four groups each, and the end of the chain."""
    groups = [(at, _run_right(text, at, DIGITS))]
    end = groups[0][1]
    while end + 1 < len(text) and text[end] == "." and text[end + 1] in DIGITS:
        start = end + 1
        end = _run_right(text, start, DIGITS)
        groups.append((start, end))
    small = lambda a, b: len(x := text[a:b].lstrip("0")) <= 3 and int(x or 0) <= 255
    four = (groups[i : i + 4] for i in range(0, len(groups) - 3, 4))
    return [(g[0][0], g[3][1]) for g in four if all(small(a, b) for a, b in g)], end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def card_from(text: str, at: int) -> tuple[Span | None, int]:
    """The chain of digits, with single spaces or hyphens between, that starts at `at`: a card if it has 14 to 19 and passes Luhn."""
    end, n = _run_right(text, at, DIGITS), len(text)
    while end + 1 < n and text[end] in " -" and text[end + 1] in DIGITS:
        end = _run_right(text, end + 1, DIGITS)
    if end - at < 14:
        return None, end
    digits = text[at:end].replace(" ", "").replace("-", "")
    return ((at, end) if 14 <= len(digits) <= 19 and luhn(digits) else None), end


def phone_at(text: str, at: int) -> tuple[Span | None, int]:
    """The number behind the plus at `at`, and where the next search starts."""
    if at + 1 >= len(text) or text[at + 1] not in DIGITS:
        return None, at + 1
    end = _run_right(text, at + 2, PHONE)
    while end > at + 3 and text[end - 1] not in DIGITS:
        end -= 1
    if end <= at + 3 or text[end - 1] not in DIGITS:
        return None, at + 1
    n = sum(c in DIGITS for c in text[at:end])
    return ((at, end) if 10 <= n <= 15 else None), end


class Stretch:
    """The last stretch of characters that a parser ran over, so that anchors inside it don't run over it again: a text is read once."""

    def __init__(self, text: str, inside: Callable[[str], bool], *marks: Callable[[str], bool]):
        self.text, self.inside, self.marks = text, inside, marks
        self.start = self.end = -1
        self.last = [-1] * len(marks)

    def at(self, place: int) -> int:
        """Where the stretch from `place` ends; last has the last place of each kind of mark in it, before `place` if there is none."""
        if not self.start <= place < self.end:
            self.start = self.end = place
            while self.end < len(self.text) and self.inside(self.text[self.end]):
                for k, mark in enumerate(self.marks):
                    if mark(self.text[self.end]):
                        self.last[k] = self.end
                self.end += 1
        return self.end


def url_at(text: str, at: int, low: int, ahead: Stretch) -> Span | None:
    """The URL around the `://` at `at`: a scheme of letters before, a host with a letter or digit behind, to white space or a quote."""
    start = _run_left(text, at, low, ALNUM)
    if start == at or text[start] in DIGITS:
        return None
    ahead.at(at + 3)
    letter, end = ahead.last
    return (start, end + 1) if letter >= at + 3 else None


def secret_after(text: str, end: int, ahead: Stretch) -> Span | None:
    """The value behind a cue that ends at `end`: `=` or `:`, perhaps a quote, then 16 or more characters with letters and digits."""
    at = _run_right(text, end, frozenset(" \t\"'"))
    if at >= len(text) or text[at] not in "=:":
        return None
    at = _run_right(text, at + 1, frozenset(" \t\"'>"))
    stop = ahead.at(at)
    digit, letter = ahead.last
    return (at, stop) if stop - at >= 16 and digit >= at and letter >= at else None


def iban_valid(value: str) -> bool:
    x = value.replace(" ", "").upper()
    if not (15 <= len(x) <= 34 and x[:2].isalpha() and x[2:4].isdigit() and x.isalnum() and x.isascii()):
        return False
    return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


def account_after(text: str, end: int) -> Span | None:
    """An IBAN with valid check digits, or a number of 6 to 18 digits, close behind a cue that ends at `end`."""
    at, stop = end, min(len(text), end + CUE_GAP)
    while at < stop and text[at] in " \t:=#.-\"'":
        at += 1
    for word in ("number", "no", "nr"):
        if text[at : at + len(word)].lower() == word:
            at = _run_right(text, at + len(word), frozenset(" \t:=#.-\"'"))
    right = at
    while right < len(text) and (text[right] in ALNUM or text[right] == " " and right + 1 < len(text) and text[right + 1] in ALNUM) and right - at < 42:
        right += 1
    for stop in sorted({right, *(i for i in range(at, right) if text[i] == " ")}, reverse=True):
        if iban_valid(text[at:stop]):
            return at, stop
    stop = _run_right(text, at, DIGITS | frozenset("-"))
    digits = sum(c in DIGITS for c in text[at:stop])
    while stop > at and text[stop - 1] == "-":
        stop -= 1
    return (at, stop) if 6 <= digits <= 18 and (stop == len(text) or text[stop] not in ALNUM) else None


def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for c in "@+0123456789":
        a.add_word(c, (c, 1))
    a.add_word("://", ("url", 3))
    for kind, cues in (("secret", SECRET_CUES), ("account", ACCOUNT_CUES)):
        for cue in cues:
            for form in {cue, cue.upper(), cue.capitalize()}:
                a.add_word(form, (kind, len(form)))
    a.make_automaton()
    return a


def find(text: str, automaton=None) -> dict[str, list[Span]]:
    """Spans of each kind, in code points, end exclusive; of one kind none overlap."""
    found: dict[str, list[Span]] = {k: [] for k in KINDS}
    email_end = digit_end = ip_end = phone_end = url_end = 0
    address = Stretch(text, lambda c: c not in URL_END, ALNUM.__contains__, lambda c: c not in ".,;:!?)]")
    value = Stretch(text, VALUE.__contains__, DIGITS.__contains__, str.isalpha)
    for last, (what, size) in (automaton or _automaton()).iter(text):
        at = last - size + 1
        if what in DIGITS:
            if at >= ip_end:
                end = at + 1
                # A chain needs a dot behind its first group; most groups have none.
                stop = _run_right(text, end, DIGITS)
                if stop + 1 < len(text) and text[stop] == "." and text[stop + 1] in DIGITS:
                    spans, ip_end = ips_from(text, at)
                    found["ip"] += spans
                else:
                    ip_end = stop
            if at >= digit_end:
                span, digit_end = card_from(text, at)
                if span:
                    found["card"].append(span)
        elif what == "@":
            if at >= email_end and (span := email_at(text, at, email_end)):
                found["email"].append(span)
                email_end = span[1]
        elif what == "+":
            if at >= phone_end:
                span, phone_end = phone_at(text, at)
                if span:
                    found["phone"].append(span)
        elif what == "url":
            if at >= url_end and (span := url_at(text, at, url_end, address)):
                found["url"].append(span)
                url_end = span[1]
        elif at == 0 or text[at - 1] not in ALNUM:
            span = secret_after(text, last + 1, value) if what == "secret" else account_after(text, last + 1)
            if span and (not found[what] or span[0] >= found[what][-1][1]):
                found[what].append(span)
    return found


def _listed(found: dict[str, list[Span]], kinds: tuple[str, ...]) -> str:
    spans = sorted((s, n, k, e) for n, k in enumerate(kinds) for s, e in found[k])
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in spans)


def detect(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_private) of each row of docs, in one pass without a shuffle.

    An Aho-Corasick automaton over at-signs, plus signs, digits, scheme marks and identifier cues gives the anchors; a
    local parser for each expands it to its boundaries and validates it. The four base kinds come out as their patterns,
    leftmost first and without retries, would give them; urls, secrets and accounts are added, and n_private counts all but urls. Null texts are empty.
    Texts are read whole and in time in proportion to their length; repeated rows give repeated results, other columns are ignored,
    a null doc_id stays null, and an empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()
        for batch in batches:
            for part in slices(batch, "text", 8 << 20):
                rows = []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    found = find(text or "", automaton)
                    rows.append((doc, *(len(found[k]) for k in BASE), hashlib.sha256(_listed(found, BASE).encode()).hexdigest(), _listed(found, KINDS), sum(len(found[k]) for k in PRIVATE)))
                kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_private"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_private long")
