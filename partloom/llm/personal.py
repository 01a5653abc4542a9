"""Personal data: expressions propose spans, checksums confirm them, nearby words adjust the score.

Base kinds (email, ip, card, phone) follow fixed rules and always stay. Added kinds (iban, ssn, secret) start with a
score of their own, gain or lose by their validator and by context words within ``REACH`` characters before or after the
span, and count from ``LEAST_SCORE`` on. An account number is followed by other words at times: of the candidate counts
what has the length of its country, or the whole, or in an unknown country the longest part that ends at a border and is
confirmed. Offsets are code points, ends exclusive. Every scan is linear in the text: matches can
only start where a run starts.

Edge cases: a null or empty text has no spans (the digest is that of the empty string); ids may be null or repeat,
one row out per row in; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ["email", "ip", "card", "phone", "iban", "ssn", "secret"]
BASE = 4

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
SECRET = re.compile(r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])|(?i:password|passwd|secret|token)=[^\x20\x09-\x0D]{6,}")
DIGIT = re.compile("[0-9]")
NOT_DIGIT = re.compile("[^0-9]")

# Length of the account numbers of a country.
LENGTHS = {
    k[:2]: int(k[2:])
    for k in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27"
        " GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19"
        " MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23"
        " TN24 TR26 UA29 VA22 VG24 XK20 YE30"
    ).split()
}

CONTEXT = {
    "iban": re.compile(r"(?i)\b(?:iban|account|konto|compte|cuenta|bank)\b"),
    "ssn": re.compile(r"(?i)\b(?:ssn|social|security)\b"),
    "secret": re.compile(r"(?i)\b(?:key|aws|login|secret|credentials)\b"),
}
PRIOR = {"iban": 0.4, "ssn": 0.4, "secret": 0.7}
CONFIRMED, DENIED, NEAR = 0.4, -0.6, 0.3
REACH, LEAST_SCORE = 40, 0.5


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if k % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def mod97(text: str) -> bool:
    """Account numbers: first four characters last, letters as 10 to 35, remainder 1."""
    moved = text.replace(" ", "")
    moved = moved[4:] + moved[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def accounts(text: str) -> Iterator[tuple[int, int]]:
    """Confirmed account numbers; a candidate (64 characters at most) without one is searched again from its next character."""
    m = IBAN.search(text)
    while m:
        whole, known = m[0], LENGTHS.get(m[0][:2])
        ends = [k for k in range(len(whole), 0, -1) if k == len(whole) or whole[k] == " "]
        sizes = {k: k - whole.count(" ", 0, k) for k in ends}
        tried = [k for k in ends if sizes[k] == known] + ends[:1] if known else [k for k in ends if sizes[k] >= 15]
        end = next((m.start() + k for k in tried if mod97(whole[:k])), None)
        if end:
            yield m.start(), end
        m = IBAN.search(text, end or m.start() + 1)


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, non-overlapping: from every @, back over the local part and on over the domain."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        match = DOMAIN.match(text, at + 1) if start < at else None
        if match:
            yield start, match.end()
            done = match.end()
        else:
            done = at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the four base kinds."""
    out = [(a, 0, b) for a, b in emails(text)]
    if not DIGIT.search(text):
        return out
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m[0]) if m.end() - m.start() <= 37 else ""
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def near(kind: str, text: str, start: int, end: int) -> bool:
    """A context word lies wholly within ``REACH`` characters before or after the span."""
    if CONTEXT[kind].search(text, max(0, start - REACH), start):
        return True
    after = CONTEXT[kind].search(text, end, end + REACH + 1)
    return after is not None and after.end() <= end + REACH


def score(kind: str, text: str, start: int, end: int) -> float:
    value = PRIOR[kind]
    if kind == "iban":
        value += CONFIRMED if mod97(text[start:end]) else DENIED
    if near(kind, text, start, end):
        value += NEAR
    return value


def added_spans(text: str) -> list[tuple[int, int, int]]:
    out = []
    if not DIGIT.search(text) and "=" not in text and "AKIA" not in text:
        return out
    found = [("iban", a, b) for a, b in accounts(text)]
    found += [(kind, m.start(), m.end()) for kind, pattern in (("ssn", SSN), ("secret", SECRET)) for m in pattern.finditer(text)]
    for kind, start, end in found:
        if score(kind, text, start, end) >= LEAST_SCORE:
            out.append((start, KINDS.index(kind), end))
    return out


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def found(text: str | None) -> tuple:
    text = text or ""
    base = base_spans(text)
    counts = [sum(k == kind for _, k, _ in base) for kind in range(BASE)]
    added = added_spans(text)
    digest = hashlib.sha256(listed(base).encode()).hexdigest()
    return (*counts, len(added), digest, listed(base + added))


COUNTS, TEXTS = ["n_email", "n_ip", "n_card", "n_phone", "n_added"], ["base_sha256", "spans"]
RESULT = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS] + [T.StructField(c, T.StringType()) for c in TEXTS])


@F.pandas_udf(RESULT)
def personal_data(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([found(t) for t in texts], columns=COUNTS + TEXTS)


def find_personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, counts per base kind, ``n_added``, ``base_sha256`` and all ``spans`` as kind:start:end."""
    return docs.select("doc_id", personal_data(F.col(text)).alias("found")).select("doc_id", "found.*")


def redact(text: str, spans: str) -> str:
    """Text with every span replaced by its kind in angle brackets; overlapping spans become one."""
    out, done = [], 0
    for item in spans.split(",") if spans else []:
        kind, start, end = item.rsplit(":", 2)
        start, end = int(start), int(end)
        if start >= done:
            out += [text[done:start], f"<{kind}>"]
        done = max(done, end)
    return "".join(out) + text[done:]
