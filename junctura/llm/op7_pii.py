"""Personal data by anchor expansion.

One Aho-Corasick automaton finds the anchors of a text: at-signs, plus signs,
digits, schemes and identifier cues. Local parsers expand from each anchor to
both sides and validate: email, ip, card (16 to 19 digits, Luhn) and phone (8 to
15 digits) as the base kinds, leftmost and non-overlapping per kind, without
retries; then account (IBAN after a cue, modulo 97, of its country's length), secret (value after a
credential cue) and url (only with user data before its host).

Edge cases: null and empty texts have no spans; texts of any length are read whole
in one pass, in time that grows in proportion to them; rows with equal ids are independent; an empty table gives no rows.
``find_pii`` carries only the key; ``redact_pii`` keeps all columns of its input
and their order. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from junctura.llm.batches import bounded, lighter

BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("account", "secret", "url")
KINDS = BASE_KINDS + MORE_KINDS
#: Texts that are replaced together; a worker holds these and their batch.
TOGETHER = 256
SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"

CUES = {"account": ("iban",), "secret": ("token", "password", "passwd", "secret", "api_key", "api-key", "apikey")}
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]+")
ACCOUNT = re.compile(r"[ :#=]{0,4}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})")
#: The lengths of account numbers by country code. Others are taken at any length.
ACCOUNT_LENGTHS = {"AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24}
SECRET = re.compile(r"[A-Za-z_-]{0,8}\s{0,3}[=:]\s{0,3}[\"']?([A-Za-z0-9_+/=-]{16,})")
USERINFO = re.compile(r"[^\s/?#@\"'<>]+@[^\s\"'<>]+")
SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
LETTER = re.compile(r"[A-Za-z]")


@lru_cache(maxsize=1)
def anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for c in "0123456789":
        found.add_word(c, ("digit", 1))
    found.add_word("@", ("at", 1))
    found.add_word("+", ("plus", 1))
    found.add_word("://", ("scheme", 3))
    for kind, words in CUES.items():
        for word in words:
            for form in (word, word.upper(), word.capitalize()):
                found.add_word(form, (kind, len(form)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban(value: str) -> bool:
    plain = value.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def account_end(text: str, start: int, end: int) -> int:
    """End of the account number at ``start``, which reaches ``end`` at most: the longest valid one, before no letter or digit; -1 if there is none."""
    size = len(text[start:end].replace(" ", ""))
    while size >= 15:
        inside = text[end : end + 1].isascii() and text[end : end + 1].isalnum()
        if not inside and ACCOUNT_LENGTHS.get(text[start : start + 2], size) == size and iban(text[start:end]):
            return end
        end -= 1
        size -= 1
        while text[end - 1] == " ":
            end -= 1
    return -1


def spans_of(text: str | None) -> list[tuple[str, int, int]]:
    """All spans of a text, by kind as listed in ``KINDS``, then start."""
    if not text:
        return []
    found: dict[str, list[tuple[int, int]]] = {}
    after = dict.fromkeys(KINDS, 0)  # end of the last match of each kind, valid or not

    def keep(kind: str, start: int, end: int, valid: bool) -> None:
        after[kind] = end
        if valid:
            found.setdefault(kind, []).append((start, end))

    for last, (what, width) in anchors().iter(text):
        at = last + 1 - width
        if what == "digit":
            if at >= after["ip"]:
                if m := IP.match(text, at):
                    keep("ip", at, m.end(), all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")))
                else:  # what fails from a run's first digit fails from all of them
                    after["ip"] = DIGITS.match(text, at).end()
            if at >= after["card"] and (m := CARD.match(text, at)):
                digits = m[0].replace(" ", "").replace("-", "")
                keep("card", at, m.end(), 16 <= len(digits) <= 19 and luhn(digits))
        elif what == "at":
            start = at
            while start > after["email"] and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                keep("email", start, m.end(), True)
        elif what == "plus":
            if at >= after["phone"] and (m := PHONE.match(text, at)):
                keep("phone", at, m.end(), 8 <= sum(c in "0123456789" for c in m[0]) <= 15)
        elif what == "scheme":
            start = at
            while start > after["url"] and text[start - 1] in SCHEME:
                start -= 1
            head = LETTER.search(text, start, at)
            if head and (m := USERINFO.match(text, at + 3)):
                keep("url", head.start(), m.end(), True)
        elif what == "account":
            if last + 1 >= after["account"] and (m := ACCOUNT.match(text, last + 1)):
                end = account_end(text, m.start(1), m.end(1))
                keep("account", m.start(1), end if end >= 0 else m.start(1), end >= 0)
        elif last + 1 >= after["secret"] and (m := SECRET.match(text, last + 1)):
            keep("secret", m.start(1), m.end(1), True)
    return [(kind, s, e) for kind in KINDS for s, e in found.get(kind, ())]


def find_pii(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, spans``: the spans of every text as ``array<struct<kind,start,end>>``."""
    field = df.schema[key]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        struct = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            offsets, kinds, starts, ends = [0], [], [], []
            for t in batch.column(1).to_pylist():
                for kind, s, e in spans_of(t):
                    kinds.append(kind)
                    starts.append(s)
                    ends.append(e)
                offsets.append(len(kinds))
            values = pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], fields=list(struct))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)], names=[key, "spans"])

    return bounded(df, lean=True).select(key, text).mapInArrow(lighter(scan), f"`{key}` {field.dataType.simpleString()}, spans {SPANS}")


def told(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kinds(spans: Column, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def redacted(text: str | None) -> str | None:
    """The text with each span, overlapping ones as one, replaced by its first kind in brackets."""
    spans = sorted((s, e, kind) for kind, s, e in spans_of(text))
    if not spans:
        return text
    out, at = [], 0
    for s, e, kind in spans:
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def _masked(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        for at in range(0, len(texts), TOGETHER):
            yield pa.array([redacted(t) for t in texts.slice(at, TOGETHER).to_pylist()], pa.string())


def redact_pii(df: DataFrame, text: str) -> DataFrame:
    """``df`` with the personal data of ``text`` replaced; other columns and all rows stay."""

    @F.arrow_udf("string")
    def mask(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return lighter(_masked)(batches)

    return bounded(df, lean=True).withColumn(text, mask(F.col(text)))
