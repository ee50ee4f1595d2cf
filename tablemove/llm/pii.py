"""Personal data (operator 7): anchor expansion.

One Aho-Corasick pass over the whole text finds anchors: at-signs, plus signs,
digits, URL schemes and identifier cues.  A deterministic local parser then
expands each anchor to its boundaries and validates what it found:

* email: local part to the left and domain to the right of an at-sign;
* ip, card, phone: from a digit run's first digit or a plus sign; parts at most
  255, 13 to 19 digits passing Luhn, 9 to 15 digits;
* account: after a cue such as ``IBAN`` or ``account no``, an IBAN with the right
  check digits or 6 to 20 digits;
* secret: after a cue such as ``password`` or ``token`` and ``=`` or ``:``, a
  value of at least 8 characters with a digit;
* url: after a scheme, an address that carries user information before its host.

Spans of one kind never overlap: an anchor inside the last match of its kind,
valid or not, is passed over.  Offsets count code points, the end is exclusive.

Cases: null or empty text: no spans (a null text stays null when redacted).
Rows with equal or null id are handled each on its own.  Other columns are
ignored by ``find_pii`` and kept by ``redact``.  No rows: no rows.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

# Kinds in output order, and the cues that announce an identifier.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "account", "secret", "url")
SCHEMES = ("http://", "https://", "ftp://")
ACCOUNT_CUES = ("iban", "account", "acct", "konto", "cuenta", "compte")
SECRET_CUES = ("password", "passwd", "pwd", "token", "secret", "api_key", "apikey", "access_key")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = frozenset("0123456789")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9]([ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ACCOUNT = re.compile(r"(?:[ ._-]?(?:number|nummer|no|nr))?\.?[ \t]*+(?:[:#=][ \t]*+)?(?P<v>[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}|[0-9]{6,20})(?![A-Za-z0-9])")
_SECRET = re.compile(r"[\"']?[ \t]*+[:=][ \t]*+[\"']?(?P<v>[A-Za-z0-9_+/.~-]{8,}=*)")
_URL = re.compile(r"(?P<user>[^\s/@<>\"']+)@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+(?::[0-9]+)?(?:/[^\s<>\"']*)?")

_AUTOMATON = None


def _automaton():
    global _AUTOMATON
    if _AUTOMATON is None:
        import ahocorasick
        a = ahocorasick.Automaton()
        for c in "@+":
            a.add_word(c, (c, 1))
        for c in "0123456789":
            a.add_word(c, ("0", 1))
        for kind, words in (("url", SCHEMES), ("account", ACCOUNT_CUES), ("secret", SECRET_CUES)):
            for w in words:
                for form in {w, w.upper(), w.capitalize()}:
                    a.add_word(form, (kind, len(w)))
        a.make_automaton()
        _AUTOMATON = a
    return _AUTOMATON


def luhn(digits: str) -> bool:
    own = [int(c) for c in reversed(digits)]
    return (sum(own[::2]) + sum(sum(divmod(2 * d, 10)) for d in own[1::2])) % 10 == 0


def iban(value: str) -> bool:
    v = value.replace(" ", "")
    return 15 <= len(v) <= 34 and int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) ordered by kind as listed, then start."""
    if not text:
        return []
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    done = dict.fromkeys(KINDS, 0)  # end of the last match of a kind, valid or not

    def take(kind: str, start: int, end: int, valid: bool) -> None:
        done[kind] = end
        if valid:
            found[kind].append((start, end))

    for last, (what, size) in _automaton().iter(text):
        at = last - size + 1
        if what == "0":
            if at and text[at - 1] in _DIGITS and at > 0:
                continue  # only a run's first digit is an anchor
            if at >= done["ip"] and (m := _IP.match(text, at)):
                take("ip", at, m.end(), all(len(own := p.lstrip("0")) <= 3 and int(own or "0") <= 255 for p in m.groups()))
            if at >= done["card"] and (m := _CARD.match(text, at)):
                digits = m[0].replace(" ", "").replace("-", "")
                take("card", at, m.end(), 13 <= len(digits) <= 19 and luhn(digits))
        elif what == "@":
            left = at
            while left > done["email"] and text[left - 1] in _LOCAL:
                left -= 1
            if left < at and (m := _DOMAIN.match(text, at + 1)):
                take("email", left, m.end(), True)
        elif what == "+":
            if at >= done["phone"] and (m := _PHONE.match(text, at)):
                take("phone", at, m.end(), 9 <= sum(c in _DIGITS for c in m[0]) <= 15)
        elif what == "url":
            if at >= done["url"] and (m := _URL.match(text, last + 1)):
                take("url", at, at + len(text[at:m.end()].rstrip(".,;:!?)")), True)
        elif at == 0 or not (text[at - 1].isalnum()):
            m = (_ACCOUNT if what == "account" else _SECRET).match(text, last + 1)
            if m and m.start("v") >= done[what]:
                v = m["v"]
                take(what, m.start("v"), m.end("v"), (v.isdigit() or iban(v)) if what == "account" else any(c in _DIGITS for c in v))
    return [(k, a, b) for k in KINDS for a, b in found[k]]


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _find(batches):
    for b in batches:
        own = [[{"kind": k, "start": s, "end": e} for k, s, e in spans(t)] for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(own, _SPANS)], names=["id", "spans"])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans): all spans of a row's text."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_find, "id long, spans array<struct<kind: string, start: int, end: int>>").withColumnRenamed("id", id_col)


def mask(text: str | None) -> str | None:
    """``text`` with every span replaced by its kind in brackets; overlapping spans become one."""
    out, at = [], 0
    merged: list[list] = []
    for k, s, e in sorted(spans(text), key=lambda x: (x[1], -x[2])):
        if merged and s < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], e)
        else:
            merged.append([k, s, e])
    if not merged:
        return text
    for k, s, e in merged:
        out += [text[at:s], f"[{k.upper()}]"]
        at = e
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text_col`` replaced by its kind in brackets."""
    prepare(docs.sparkSession)

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index(text_col)
            own = pa.array([mask(t) for t in b.column(at).to_pylist()], b.schema.field(at).type)
            yield b.set_column(at, b.schema.field(at), own)

    return docs.mapInArrow(run, docs.schema)
