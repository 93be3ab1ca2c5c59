"""Personal data: patterns propose spans, checksums confirm, context adjusts the score.

Base rules (their spans always stay), leftmost and non-overlapping for each kind:
email, ip (parts at most 255), card (13 to 19 digits passing Luhn), phone (9 to
15 digits).  The method then proposes more: cards and phones inside digit runs
that the base rules dropped as a whole, phones without a plus sign, written-out
email addresses, IBANs (mod 97), social security numbers and credentials.  A
proposal has a prior score; words near it raise or lower the score; proposals
below the threshold are dropped.

Every pattern runs in time linear in the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import release, small_batches

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn", "secret")
CONTEXT = 48
THRESHOLD = 0.5

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT_OR_AT = re.compile(r"[0-9@]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

_CARD_PART = re.compile(r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])")
_PHONE_PART = re.compile(r"(?<![0-9.])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)|[0-9]{3})[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_KEY = re.compile(r"(?<![A-Z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Z0-9])|(?<![A-Za-z0-9])(?:gh[pousr]_[A-Za-z0-9]{36,}+|sk-[A-Za-z0-9]{20,}+|xox[abprs]-[A-Za-z0-9-]{10,}+)")
_ASSIGNED = re.compile(r"(?i)(?<![a-z])(?:password|passwd|pwd|secret|token|api[_-]?key)[\x20]?[:=][\x20]?([^\s,;]{6,}+)")
_SPELT = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++[\x20]?[\[(]at[\])][\x20]?[A-Za-z0-9-]++(?:(?:[\x20]?[\[(]dot[\])][\x20]?|\.)[A-Za-z0-9-]++)++")
_NEAR = re.compile(r"[^\W\d_]+")

#: Words that make a proposal of a kind likelier.
RAISES = {
    "email": {"email", "mail", "contact", "write", "courriel", "correo"},
    "ip": {"ip", "address", "host", "server"},
    "card": {"card", "visa", "mastercard", "amex", "credit", "debit", "payment", "carte", "karte", "tarjeta"},
    "phone": {"phone", "tel", "telephone", "call", "mobile", "cell", "fax", "dial", "telefon", "telefono", "handy"},
    "iban": {"iban", "bank", "account", "transfer", "konto", "cuenta", "compte"},
    "ssn": {"ssn", "social", "security", "taxpayer"},
    "secret": {"password", "key", "token", "secret", "credential", "login"},
}
#: Words that speak for a plain number.
LOWERS = {"isbn", "issn", "doi", "order", "invoice", "serial", "version", "sku", "example", "page", "part"}
#: Scores before context: a checksum counts most.
PRIOR = {"email": 0.6, "ip": 0.6, "card": 0.75, "phone": 0.45, "iban": 0.85, "ssn": 0.35, "secret": 0.6}


def luhn(digits: str) -> bool:
    """The check digit of card numbers."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The check number of IBANs."""
    iban = iban.replace(" ", "")
    return 15 <= len(iban) <= 34 and int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """What the email pattern finds, driven by each @: its run of local characters ends there."""
    free, at = 0, text.find("@")
    while at >= 0:
        s = at
        while s > free and text[s - 1] in _LOCAL:
            s -= 1
        m = _DOMAIN.match(text, at + 1) if s < at else None
        if m:
            yield s, m.end()
            free = m.end()
        else:
            free = max(free, s)
        at = text.find("@", max(at + 1, m.end() if m else 0))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the four base rules, by kind, then start."""
    if not _DIGIT_OR_AT.search(text):
        return []
    out = [("email", s, e) for s, e in _emails(text)]
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) < 4 and int(x[-3:]) < 256 for x in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def _proposals(text: str) -> Iterator[tuple[str, int, int]]:
    for m in _CARD_PART.finditer(text):
        if luhn(_NOT_DIGIT.sub("", m[0])):
            yield "card", m.start(), m.end()
    for m in _PHONE_PART.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            yield "phone", m.start(), m.end()
    for m in _IBAN.finditer(text):
        if mod97(m[0]):
            yield "iban", m.start(), m.end()
    for m in _SSN.finditer(text):
        if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000":
            yield "ssn", m.start(), m.end()


def _score(text: str, kind: str, s: int, e: int) -> float:
    near = set(_NEAR.findall((text[max(0, s - CONTEXT) : s] + " " + text[e : e + CONTEXT]).lower()))
    score = PRIOR[kind] + 0.3 * bool(near & RAISES[kind]) - 0.3 * bool(near & LOWERS)
    if kind == "phone" and text[s] == "+":
        score += 0.3
    return round(min(1.0, max(0.0, score)), 2)


def find_spans(text: str, threshold: float = THRESHOLD) -> list[tuple[str, int, int, float, bool]]:
    """(kind, start, end, score, base) by kind, then start; code points, end exclusive."""
    base = base_spans(text)
    taken: dict[str, list[tuple[int, int]]] = {}
    for kind, s, e in base:
        taken.setdefault(kind, []).append((s, e))
    out = [(kind, s, e, _score(text, kind, s, e), True) for kind, s, e in base]
    more: list[tuple[str, int, int]] = list(_proposals(text)) if _DIGIT_OR_AT.search(text) else []
    if "[at]" in text or "(at)" in text:
        more += [("email", m.start(), m.end()) for m in _SPELT.finditer(text)]
    more += [("secret", m.start(), m.end()) for m in _KEY.finditer(text)]
    if ":" in text or "=" in text:
        more += [("secret", m.start(1), m.end(1)) for m in _ASSIGNED.finditer(text)]
    for kind, s, e in sorted(more, key=lambda x: (x[1], -x[2])):
        have = taken.setdefault(kind, [])
        if len(have) < 64:
            clash = any(s < b and a < e for a, b in have)
        else:
            clash = _clash(have, s, e)
        if not clash and (score := _score(text, kind, s, e)) >= threshold:
            have.append((s, e))
            out.append((kind, s, e, score, False))
    return sorted(out, key=lambda x: (KINDS.index(x[0]), x[1]))


def _clash(have: list[tuple[int, int]], s: int, e: int) -> bool:
    """Whether any span of a long list overlaps [s, e); the list is kept sorted."""
    import bisect

    have.sort()
    k = bisect.bisect_left(have, (e, 0))
    return k > 0 and have[k - 1][1] > s


def mask(text: str, spans: list[tuple[str, int, int, float, bool]]) -> str:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one."""
    out, at = [], 0
    merged: list[list] = []
    for kind, s, e, *_ in sorted(spans, key=lambda x: (x[1], -x[2])):
        if merged and s < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], e)
        else:
            merged.append([kind, s, e])
    for kind, s, e in merged:
        out += [text[at:s], f"<{kind.upper()}>"]
        at = e
    return "".join(out) + text[at:]


SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())]))


def pii_spans(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (doc_id, spans) for each row of docs; spans: array of (kind, start, end, score, base).

    Null texts count as empty and give no span.  Repeated rows and null ids give
    a row each.  Further columns are not read.  Nothing is shuffled.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[dict(zip(("kind", "start", "end", "score", "base"), x, strict=True)) for x in find_spans(t or "", threshold)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, SPAN)], ["doc_id", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint,score:double,base:boolean>>")


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def masked(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with personal data masked in text, and n_chars (where docs has it) counted anew. Null texts stay null."""
    small_batches(docs.sparkSession)
    at, count = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            texts = [t if t is None or not (s := find_spans(t, threshold)) else mask(t, s) for t in b.column(at).to_pylist()]
            columns = list(b.columns)
            columns[at] = pa.array(texts, b.schema.field(at).type)
            if count is not None:
                columns[count] = pa.array([None if t is None else len(t) for t in texts], b.schema.field(count).type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return docs.mapInArrow(run, docs.schema)
