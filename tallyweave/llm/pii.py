"""Personal data by anchor expansion (operator 5).

One Aho-Corasick pass finds the anchors: at-signs, plus signs, digits, schemes, and cues of accounts, secrets and streets.
From each anchor a local parser expands the span's bounds and validates it. The parsers give exactly the base spans of the
contract; the others add ``account`` (an IBAN with a valid checksum, or a number after an account cue), ``url_login``
(user:password@ in a url), ``secret`` (a value of letters and digits that is assigned to a token, key or password) and
``address`` (a street with a house number, as written in four languages).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tallyweave.llm.common import pick, read, slices

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "account", "url_login", "secret", "address")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_DIGITS = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"[\x20:.#]{0,3}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
_LOGIN = re.compile(r"[^\s/?#:@]+:[^\s/?#@]+@")
_NUMBER = re.compile(r"(?:[\x20_](?:no|nr|num|number|nummer|numéro|número)\b)?[\x20.:#=°]{0,4}([0-9](?:[\x20-]?[0-9]){5,16})(?![0-9A-Za-z])", re.I)
_VALUE = re.compile(r"[A-Za-z0-9_-]{0,24}[\"']?\s{0,2}(?::=|=>|[:=])\s{0,2}[\"']?([A-Za-z0-9_./+~-]{8,512}={0,2})(?![A-Za-z0-9])")
#: Cues of each kind of parser; each is looked for as it is, capitalised and in capitals.
_CUES = {
    "cue": ("iban",),
    "account": ("account", "acct", "konto", "kontonummer", "compte", "cuenta"),
    "secret": ("token", "secret", "password", "passwd", "api_key", "api-key", "apikey", "access_key", "private_key", "auth_key"),
    "street": ("street", "road", "avenue", "boulevard", "lane", "straße", "strasse", "rue", "calle"),
}
_NAME = r"[^\W\d_a-zß-öø-ÿ][\w'’-]*"
_STREETS = [
    re.compile(rf"[0-9]{{1,5}}[A-Za-z]?\x20(?:{_NAME}\x20){{1,4}}(?:Street|Road|Avenue|Boulevard|Lane)\b"),
    re.compile(r"[^\W\d_a-zß-öø-ÿ]\w*(?:straße|strasse|\x20Straße|\x20Strasse)\x20[0-9]{1,4}[a-z]?\b"),
    re.compile(rf"[0-9]{{1,4}}(?:\x20(?:bis|ter))?,?\x20(?:rue|avenue|boulevard)\x20(?:(?:de|du|des|la|le)\x20|l['’]|d['’]){{0,2}}{_NAME}"),
    re.compile(rf"\b[Cc]alle\x20(?:(?:de|del|la|los|las)\x20){{0,2}}{_NAME}(?:\x20{_NAME}){{0,2}},?\x20(?:n[.º°o]{{1,2}}\x20?)?[0-9]{{1,4}}\b"),
]
_machine: list = []


def _anchors() -> ahocorasick.Automaton:
    if not _machine:
        a = ahocorasick.Automaton()
        for word, kind in [("@", "at"), ("+", "plus"), ("://", "scheme"), *[(d, "digit") for d in "0123456789"]]:
            a.add_word(word, (kind, len(word)))
        for kind, words in _CUES.items():
            for w in words:
                for form in {w, w.capitalize(), w.upper()}:
                    a.add_word(form, (kind, len(form)))
        a.make_automaton()
        _machine.append(a)
    return _machine[0]


def _iban(raw: str) -> bool:
    raw = raw.replace(" ", "")
    return 15 <= len(raw) <= 34 and int("".join(str(int(c, 36)) for c in raw[4:] + raw[:4])) % 97 == 1


def _secret(value: str) -> bool:
    """Letters and digits mixed, of some length: not a word, a number or a date."""
    return len(value) >= 12 and any(c.isdigit() for c in value) and any(c.isalpha() for c in value)


def _street(text: str, start: int, end: int) -> tuple[int, int] | None:
    """The address around the cue at start to end, within 80 characters of it."""
    left = max(0, start - 80)
    for pattern in _STREETS:
        for m in pattern.finditer(text, left, min(len(text), end + 80)):
            if m.start() <= start and end <= m.end() and not (m.start() and text[m.start() - 1].isalnum()):
                return m.span()
    return None


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def find(text: str) -> list[tuple[str, int, int]]:
    """All spans, by kind as listed in KINDS, then start."""
    out: dict[str, list] = {k: [] for k in KINDS}
    done = dict.fromkeys(("email", "ip", "card", "phone", "run", "secret", "street", "account"), 0)
    for end, (what, size) in _anchors().iter(text):
        if what == "digit":
            if end >= done["ip"] and end >= done["run"]:
                m = _IP.match(text, end)
                if m:
                    done["ip"] = m.end()
                    if all(int(p[-4:]) <= 255 and not p[:-4].strip("0") for p in m[0].split(".")):
                        out["ip"].append(("ip", *m.span()))
                else:
                    done["run"] = _DIGITS.match(text, end).end()
            if end >= done["card"]:
                m = _CARD.match(text, end)
                done["card"] = m.end() if m else end + 1
                if m and 16 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                    out["card"].append(("card", *m.span()))
        elif what == "at":
            start = end
            while start > done["email"] and text[start - 1] in _LOCAL:
                start -= 1
            if start < end and (m := _DOMAIN.match(text, end + 1)):
                done["email"] = m.end()
                out["email"].append(("email", start, m.end()))
        elif what == "plus":
            if end >= done["phone"] and (m := _PHONE.match(text, end)):
                done["phone"] = m.end()
                if 8 <= sum(c in "0123456789" for c in m[0]) <= 15:
                    out["phone"].append(("phone", *m.span()))
        elif what == "scheme":
            if m := _LOGIN.match(text, end + 1):
                out["url_login"].append(("url_login", *m.span()))
        elif what == "secret":
            if (m := _VALUE.match(text, end + 1)) and m.start(1) >= done["secret"] and _secret(m[1]):
                done["secret"] = m.end(1)
                out["secret"].append(("secret", *m.span(1)))
        elif end - size >= 0 and text[end - size].isalnum() and what != "street":
            pass  # the end of another word
        elif what == "street":
            if (m := _street(text, end - size + 1, end + 1)) and m[0] >= done["street"]:
                done["street"] = m[1]
                out["address"].append(("address", *m))
        elif m := (_IBAN if what == "cue" else _NUMBER).match(text, end + 1):
            if m.start(1) >= done["account"] and (what == "account" or _iban(m[1])):
                done["account"] = m.end(1)
                out["account"].append(("account", *m.span(1)))
    return [s for k in KINDS for s in out[k]]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str) -> str:
    """The text with each span, or union of overlapping spans, replaced by [KIND] of the first."""
    out, at = [], 0
    for kind, a, b in sorted(find(text), key=lambda s: (s[1], -s[2])):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def find_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of df: counts of the base kinds, a digest of the base spans, all spans, and their number.

    A null text counts as empty; ids may be null or repeat; an empty table gives an empty one; other columns are not
    looked at. Spans are in code points, ends exclusive. Texts are parsed whole, in one pass.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2048):
            found = [find(t.as_py() or "") for t in b.column(1)]
            counts = [pa.array([sum(s[0] == k for s in f) for f in found], pa.int64()) for k in BASE]
            sums = [hashlib.sha256(joined([s for s in f if s[0] in BASE]).encode()).hexdigest() for f in found]
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, pa.array(sums, pa.string()), pa.array(list(map(joined, found)), pa.string()), pa.array(list(map(len, found)), pa.int64())], [id_col, *[f"n_{k}" for k in BASE], "base_sha256", "spans", "n_spans"])

    d = pick(df, id_col, text_col)
    return d.mapInArrow(run, f"`{id_col}` {d.schema[0].dataType.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of personal data in every document."""
    return find_spans(read(spark, sf_dir, "documents"))
