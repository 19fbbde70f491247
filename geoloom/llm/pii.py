"""Personal data by anchor expansion.

One Aho-Corasick pass finds the anchors of a text: at-signs, plus signs,
digits, schemes and identifier cues.  At each anchor a small deterministic
parser expands to the boundaries and validates.  No parser looks at a
character more than a few times, so very long runs cost no more than their
length.

Base kinds: ``email``, ``ip``, ``card``, ``phone``.  Added kinds:

``account``
    after a cue (account, acct, iban, ssn; lower, upper or title case) and at
    most 16 characters of number words and signs: an IBAN that passes mod 97, a
    social security number, or 6 to 17 digits.
``address``
    after a scheme: a URL whose host follows user information, or a ``tel:``
    number of 7 to 15 digits.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "account", "address")
CUES = ("account", "acct", "iban", "ssn")
SCHEMES = ("://", "tel:", "TEL:", "Tel:")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LINK = re.compile(r"[ .:#=-]{0,4}(?:(?:number|num|no|nr)\b[ .:#=-]{0,4})?", re.I)
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"[0-9]{3}[ -][0-9]{2}[ -][0-9]{4}(?![0-9])")
_ACCOUNT = re.compile(r"[0-9](?:[ -]?[0-9]){5,16}(?![0-9])")
_USERINFO = re.compile(r"[A-Za-z0-9._~%!$&'()*+,;=:-]++@[A-Za-z0-9.-]+(?::[0-9]{1,5})?")
_TEL = re.compile(r"[0-9](?:[ ().-]{0,2}[0-9]){6,14}(?![0-9])")


def automaton():
    """The anchors, each with its kind and length."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for sign in "@+0123456789":
        found.add_word(sign, (sign if sign in "@+" else "0", 1))
    for cue in CUES:
        for form in (cue, cue.upper(), cue.title()):
            found.add_word(form, ("cue", len(form)))
    for scheme in SCHEMES:
        found.add_word(scheme, ("tel" if scheme.endswith(":") else "url", len(scheme)))
    found.make_automaton()
    return found


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _iban(text: str) -> bool:
    text = text.replace(" ", "")
    return len(text) <= 34 and int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def _account(text: str, at: int) -> tuple[int, int] | None:
    start = _LINK.match(text, at).end()
    if start == at:  # the cue goes on as another word
        return None
    if (m := _IBAN.match(text, start)):
        end = m.end()
        while end - start >= 15:  # words in capitals may follow
            if _iban(text[start:end]):
                return start, end
            if (cut := text.rfind(" ", start, end)) < 0:
                break
            end = cut
    m = _SSN.match(text, start) or _ACCOUNT.match(text, start)
    return m.span() if m else None


def find_spans(text: str, anchors) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as listed, then start.

    Base kinds are leftmost and do not overlap within a kind; a match that
    fails its check is dropped and not tried again.
    """
    spans: dict[str, list[tuple[int, int]]] = {kind: [] for kind in KINDS}
    done = dict.fromkeys(KINDS, 0)  # where the next match of a kind may start

    def take(kind: str, span: tuple[int, int]) -> None:
        done[kind] = span[1]
        spans[kind].append(span)

    for last, (sign, length) in anchors.iter(text):
        at = last - length + 1
        if sign == "0":
            if at >= done["card"] and (m := _CARD.match(text, at)):
                done["card"] = m.end()
                if 13 <= len(digits := _digits(m.group())) <= 19 and _luhn(digits):
                    take("card", m.span())
            if at >= done["ip"] and (at == 0 or not "0" <= text[at - 1] <= "9") and (m := _IP.match(text, at)):
                done["ip"] = m.end()
                if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
                    take("ip", m.span())
        elif sign == "@":
            start = at
            while start > done["email"] and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                take("email", (start, m.end()))
        elif sign == "+":
            if at >= done["phone"] and (m := _PHONE.match(text, at)):
                done["phone"] = m.end()
                if 9 <= len(_digits(m.group())) <= 15:
                    take("phone", m.span())
        elif sign == "cue":
            before = text[at - 1] if at else " "
            if at >= done["account"] and not before.isalnum() and (span := _account(text, last + 1)):
                take("account", span)
        elif at >= done["address"]:
            m = (_TEL if sign == "tel" else _USERINFO).match(text, last + 1)
            if m:
                start = at
                while sign == "url" and start > done["address"] and (c := text[start - 1]).isascii() and c.isalnum():
                    start -= 1
                take("address", (start, m.end()))
    return [(kind, *span) for kind in KINDS for span in spans[kind]]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with each stretch of overlapping spans replaced by [KIND] of its first."""
    out, at = [], 0
    for start, end, kind in sorted((a, b, k) for k, a, b in spans):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


RESULT = [
    *((f"n_{kind}", pa.int64()) for kind in BASE_KINDS),
    ("base_sha256", pa.string()),
    ("spans", pa.string()),
    ("redacted", pa.string()),
]


def _found(text: str | None, anchors) -> tuple:
    spans = find_spans(text or "", anchors)
    base = [s for s in spans if s[0] in BASE_KINDS]
    counts = [sum(s[0] == kind for s in base) for kind in BASE_KINDS]
    return (*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), redacted(text, spans) if spans else text)


def detect(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), redact: bool = False) -> DataFrame:
    """The columns ``keep`` and the findings of every row of ``docs``; with
    ``redact`` also the text with personal data replaced.

    A null text has no findings and stays null; empty and repeated rows each
    give their row; an empty table gives none.  Counts are of base kinds.
    """
    schema = docs.select(*keep).schema
    names = schema.names[:]
    fields = RESULT if redact else RESULT[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        for batch in batches:
            found = [_found(t, anchors)[: len(fields)] for t in batch.column(len(keep)).to_pylist()]
            columns = list(zip(*found, strict=True)) or [()] * len(fields)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *(pa.array(list(c), t) for c, (_, t) in zip(columns, fields, strict=True))],
                names=[*names, *(k for k, _ in fields)],
            )

    for name, kind in fields:
        schema = schema.add(name, "string" if kind == pa.string() else "long")
    return bounded_batches(docs).select(*keep, F.col("text").alias("_whole_text")).mapInArrow(run, schema)
