r"""Personal data by anchor expansion.

One Aho-Corasick automaton finds at-signs, plus signs, digits, schemes and identifier cues in a text. A deterministic
parser for each kind expands an anchor to its boundaries and validates what it finds (domain labels, octets, Luhn, digit
counts). Work is linear in the text: a parser skips what an earlier span of its kind took or a failed one read, or reads a bounded number of characters.

Base kinds equal these patterns, leftmost and non-overlapping for each kind, and spans that fail validation are dropped:

* email ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+``
* ip ``[0-9]+(\.[0-9]+){3}`` with parts of at most 255
* card ``[0-9]([ -]?[0-9])+`` of 13 to 19 digits with a right Luhn sum
* phone ``\+[0-9][ ().0-9-]+[0-9]`` of 9 to 15 digits

The method adds: url (scheme, ``://``, host with a dot or port) and account (a cue such as ``iban`` or ``account no``, then
an identifier of 6 to 34 letters and digits of which 4 at least are digits; an IBAN needs a right checksum).

Defined cases: a null or empty text has no span; repeated doc_ids each give their row; a null doc_id is kept; offsets are code
points of the whole text, whatever its length; other columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from functools import lru_cache

from pyspark.sql import DataFrame

from plumaria.llm.common import arrow_parts, arrow_rows, id_type

KINDS = ("email", "ip", "card", "phone", "url", "account")
SCHEMES = ("http://", "https://", "ftp://")
CUES = ("account number", "account no", "account id", "account:", "acct", "iban", "passport", "ssn", "tax id", "customer id", "member id")
DIGITS = "0123456789"
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
LABELS = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])+")
NUMBER = re.compile(r"[0-9]+")
PHONE_RUN = re.compile(r"[ ().0-9-]+")
HOST = re.compile(r"[A-Za-z0-9.-]+(?::[0-9]+)?(?:[/?#][^\s<>\"'|]*)?")
CUE_REACH = 80  # more than separators and the longest identifier in groups take
AFTER_CUE = re.compile(r"[ \t:#=.\"']{0,6}([A-Za-z0-9]+(?:[ -]?[A-Za-z0-9]+)*)")


@lru_cache(1)
def anchors():
    import ahocorasick

    found = ahocorasick.Automaton()
    for text, kind in [("@", "email"), ("+", "phone"), *((d, "digit") for d in DIGITS), *((s, "url") for s in SCHEMES), *((c, "account") for c in CUES)]:
        found.add_word(text, (kind, len(text)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def iban(word: str) -> bool:
    return bool(re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", word)) and int("".join(str(int(c, 36)) for c in word[4:] + word[:4])) % 97 == 1


def email_at(text: str, at: int, free: int) -> tuple[int, int] | None:
    start = at
    while start > free and text[start - 1] in LOCAL:
        start -= 1
    domain = LABELS.match(text, at + 1) if start < at else None
    return (start, domain.end()) if domain else None


def ip_at(text: str, at: int) -> tuple[int, int, bool] | None:
    end, right = at, True
    for part in range(4):
        if part:
            if text[end : end + 1] != ".":
                return None
            end += 1
        if not (m := NUMBER.match(text, end)):
            return None
        value = m[0].lstrip("0")
        right, end = right and len(value) < 4 and int(value or 0) <= 255, m.end()
    return at, end, right


def phone_at(text: str, at: int) -> tuple[int, int] | None:
    if text[at + 1 : at + 2] not in DIGITS or not (run := PHONE_RUN.match(text, at + 2)):
        return None
    end = run.end()
    while end > run.start() + 1 and text[end - 1] not in DIGITS:
        end -= 1
    return (at, end) if end > run.start() + 1 else None


def account_at(text: str, cue: int) -> tuple[int, int] | None:
    if not (m := AFTER_CUE.match(text, cue, cue + CUE_REACH)):
        return None
    start, word = m.start(1), m[1].split(" ")[0]
    if re.match("[A-Z]{2}[0-9]{2}", m[1]):  # an IBAN, maybe in groups: the longest run of whole groups with a right checksum
        for end in sorted({g.end() for g in re.finditer("[A-Za-z0-9]+", m[1][:48])}, reverse=True):
            if iban(re.sub("[ -]", "", m[1][:end])):
                return start, start + end
        return None
    digits = sum(c in DIGITS for c in word)
    return (start, start + len(word)) if 6 <= len(word) <= 34 and digits >= 4 else None


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind in the order of KINDS, then start; base kinds first."""
    free, found = dict.fromkeys((*KINDS, "digits"), 0), {k: [] for k in KINDS}
    # Cues are looked for in lower case; folding that changes a text's length would move its offsets.
    low = text.lower() if text.isascii() else "".join(c.lower() if c.isascii() else c for c in text) if any("A" <= c <= "Z" for c in text) else text
    for last, (kind, size) in anchors().iter(low):
        at = last - size + 1
        if kind == "digit":
            if at >= free["digits"]:  # the rest of a run of digits can start nothing
                free["digits"] = NUMBER.match(text, at).end()
                if at >= free["ip"] and (m := ip_at(text, at)):
                    free["ip"] = m[1]
                    if m[2]:
                        found["ip"].append(m[:2])
            if at >= free["card"] and (m := CHAIN.match(text, at)):
                free["card"] = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    found["card"].append(m.span())
        elif at < free[kind]:
            continue
        elif kind == "email" and (span := email_at(text, at, free["email"])):
            found["email"].append(span)
            free["email"] = span[1]
        elif kind == "phone" and (span := phone_at(text, at)):
            free["phone"] = span[1]
            if 9 <= sum(c in DIGITS for c in text[span[0] : span[1]]) <= 15:
                found["phone"].append(span)
        elif kind == "url" and (m := HOST.match(text, last + 1)):
            free["url"] = m.end()  # also where it fails: what starts inside ends there too and has no more dots
            if re.search(r"\.|:[0-9]", m[0]):
                free["url"] = m.end() - (m[0][-1] in ".,;:!?)")
                found["url"].append((at, free["url"]))
        elif kind == "account" and not (at and text[at - 1].isalnum()) and (span := account_at(text, last + 1)):
            found["account"].append(span)
            free["account"] = span[1]
    for kind in ("account",):  # what a base kind already names is not named again
        base = sorted(s for k in KINDS[:4] for s in found[k])
        found[kind] = [s for s in found[kind] if not any(b < s[1] and e > s[0] for b, e in base[max(0, bisect_left(base, s) - 1) :][:2])]
    return [(k, a, b) for k in KINDS for a, b in found[k]]


def pii_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, kinds, starts, ends) for each row of docs: parallel arrays, in the order of find_spans."""

    def run(batches):
        import pyarrow as pa

        for batch, _ in arrow_parts(batches):
            found = [find_spans(t or "") for t in batch.column("text").to_pylist()]
            lists = lambda i, kind: pa.array([[s[i] for s in f] for f in found], pa.list_(kind))
            yield arrow_rows({"doc_id": batch.column("doc_id"), "kinds": lists(0, pa.string()), "starts": lists(1, pa.int64()), "ends": lists(2, pa.int64())})

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type(docs)}, kinds array<string>, starts array<long>, ends array<long>")


def _is(kind: str):
    return lambda x: x == kind


def digests(spans: DataFrame) -> DataFrame:
    from pyspark.sql import functions as F

    said = F.transform(F.arrays_zip("kinds", "starts", "ends"), lambda s: F.concat_ws(":", s["kinds"], s["starts"], s["ends"]))
    count = [F.size(F.filter("kinds", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    base = F.slice("said", 1, (F.col("n_email") + F.col("n_ip") + F.col("n_card") + F.col("n_phone")).cast("int"))
    out = spans.select("doc_id", *count, said.alias("said"))
    return out.select("doc_id", *(f"n_{k}" for k in KINDS[:4]), F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join("said", ",").alias("spans"), *(f"n_{k}" for k in KINDS[4:]))
