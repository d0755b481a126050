"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, schemes, plus signs and digit pairs that
begin or continue a number, and words that announce an identifier. At each anchor a small parser
finds the boundaries to the left and right and validates what lies between.

The base kinds have fixed borders, those of the leftmost matches, not overlapping within a kind, of

* email ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``
* ip    ``[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)``, every part at most 255
* card  ``[0-9]([ -]?[0-9])+``, 12 to 19 digits that pass the Luhn check
* phone ``\\+[0-9][ ().0-9-]+[0-9]``, 9 to 15 digits

where a match that fails its check is dropped and not tried again in part. Added kinds: ``url``, an
address that names a user before its host, and ``account``, an identifier after a word that announces
one (IBANs must pass their check digits).

Spans are in code points, end exclusive, by start and then by kind in the order above. Null and empty
texts have none. Rows and columns pass through unchanged, repeated rows too.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logquarry.llm.common import small_batches

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account")
SPAN = "array<struct<kind:string,start:int,end:int>>"

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = frozenset("0123456789")
NUMBER_DOTS = re.compile(r"[0-9.]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
USER_AT_HOST = re.compile(r"[^\s/?#@:]{1,64}(?::[^\s/?#@]{0,128})?@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*(?::[0-9]{1,5})?")
SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
IDENTIFIER = re.compile(
    r"(?:[ \t]?(?:no\.?|nr\.?|number|num|id))?[ \t]{0,3}[:=#]?[ \t]{0,3}([A-Z0-9](?:[ -]?[A-Z0-9]){5,40})(?![A-Za-z0-9])")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{1,4}){3,8}")

# Words that announce an identifier.
CUES = ("account", "acct", "iban", "passport", "ssn", "social security", "driver license", "tax id", "konto", "cuenta",
        "compte")


def anchors() -> ahocorasick.Automaton:
    """Every anchor with what to do at it; digit pairs by rule."""
    found = ahocorasick.Automaton()
    found.add_word("@", ("email", 1))
    found.add_word("://", ("url", 3))
    for a in "0123456789":
        found.add_word("+" + a, ("phone", 2))
        for b in "0123456789":
            found.add_word(f"{a}.{b}", ("ip", 3))
            for between in ("", " ", "-"):
                pair = a + between + b
                found.add_word(pair, ("card", len(pair)))
    for cue in CUES:
        for form in {cue, cue.capitalize(), cue.upper(), cue.title()}:
            found.add_word(form, ("account", len(form)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    plain = text.replace(" ", "")
    if not 15 <= len(plain) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _addresses(text: str, at: int) -> tuple[int, list[tuple[int, int]]]:
    """The run of digits and dots around ``at``: its end, and its groups of four parts up to 255."""
    left = at
    while left and (text[left - 1] in DIGITS or text[left - 1] == "."):
        left -= 1
    right = NUMBER_DOTS.match(text, left).end()
    found, group, place = [], [], left
    for part in [*text[left:right].split("."), ""]:
        if part:
            group.append((place, part))
            if len(group) == 4:
                if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 and not p[:-3].strip("0") for _, p in group):
                    found.append((group[0][0], place + len(part)))
                group = []
        else:
            group = []
        place += len(part) + 1
    return right, found


def find_spans(text: str, automaton) -> list[tuple[str, int, int]]:
    spans = []
    done = dict.fromkeys(KINDS, 0)
    for last, (kind, length) in automaton.iter(text):
        at = last - length + 1
        if at < done[kind]:
            continue
        if kind == "card":
            left = at
            while left and (text[left - 1] in DIGITS or (left > 1 and text[left - 1] in " -" and text[left - 2] in DIGITS)):
                left -= 1
            end = CARD.match(text, left).end()
            done[kind] = end
            if end - left >= 12:
                digits = text[left:end].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    spans.append((kind, left, end))
        elif kind == "email":
            left = at
            while left > done[kind] and text[left - 1] in LOCAL:
                left -= 1
            domain = DOMAIN.match(text, at + 1) if left < at else None
            if domain:
                spans.append((kind, left, domain.end()))
                done[kind] = domain.end()
        elif kind == "ip":
            done[kind], found = _addresses(text, at)
            spans += [(kind, a, b) for a, b in found]
        elif kind == "phone":
            number = PHONE.match(text, at)
            if number:
                done[kind] = number.end()
                if 9 <= sum(c in DIGITS for c in number.group()) <= 15:
                    spans.append((kind, at, number.end()))
        elif kind == "url":
            left = at
            while left > done[kind] and at - left < 32 and text[left - 1] in SCHEME:
                left -= 1
            user = USER_AT_HOST.match(text, last + 1) if left < at else None
            if user:
                spans.append((kind, left, user.end()))
                done[kind] = user.end()
        else:
            begins = not at or not text[at - 1].isalnum()
            iban = IBAN.search(text, last + 1, last + 48) if begins and "ib" in text[at : last + 1].lower() else None
            if iban and iban_valid(iban.group()):
                spans.append((kind, *iban.span()))
                done[kind] = iban.end()
                continue
            named = IDENTIFIER.match(text, last + 1) if begins else None
            body = named.group(1).rstrip("ABCDEFGHIJKLMNOPQRSTUVWXYZ -") if named else ""  # words that follow
            if sum(c in DIGITS for c in body) >= 6:
                spans.append((kind, named.start(1), named.start(1) + len(body)))
                done[kind] = named.start(1) + len(body)
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(spans, key=lambda s: (s[1], order[s[0]], s[2]))


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, or group of overlapping spans, replaced by its first kind's name."""
    pieces, at, i = [], 0, 0
    while i < len(spans):
        kind, start, end = spans[i]
        while i + 1 < len(spans) and spans[i + 1][1] < end:
            i += 1
            end = max(end, spans[i][2])
        pieces += [text[at:start], f"[{kind.upper()}]"]
        at, i = end, i + 1
    return "".join([*pieces, text[at:]])


def find(docs: DataFrame, text_column: str = "text", into: str = "spans") -> DataFrame:
    """``docs`` with column ``into``: all spans of the whole text."""
    small_batches(docs.sparkSession)
    rest = docs.drop(into)
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()),
                         T.StructField("end", T.IntegerType())])
    shape = T.StructType([*rest.schema.fields, T.StructField(into, T.ArrayType(span))])
    at = rest.columns.index(text_column)
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def found(batches):
        automaton = anchors()
        for batch in batches:
            spans = [[dict(zip(("kind", "start", "end"), s)) for s in find_spans(t or "", automaton)]
                     for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, arrow)], names=[*batch.schema.names, into])

    return rest.mapInArrow(found, shape)


def redact(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``docs`` with the spans in the text replaced by ``[EMAIL]`` and the like; texts without any stay as they are."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_column)

    def cleaned(batches):
        automaton = anchors()
        for batch in batches:
            texts = batch.column(at)
            new = [t and (redacted(t, s) if (s := find_spans(t, automaton)) else t) for t in texts.to_pylist()]
            columns = [pa.array(new, texts.type) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(cleaned, docs.schema)


def digest(spans, base_only: bool):
    """``kind:start:end`` of each span, comma-joined."""
    kept = F.filter(spans, lambda s: s["kind"].isin(*BASE)) if base_only else spans
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"),
                                                                  s["end"].cast("string"))), ",")
