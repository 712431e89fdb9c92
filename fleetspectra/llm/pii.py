"""Personal data: patterns propose spans, checksums confirm them, words nearby move their score."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetspectra.llm.common import in_batches

# Kinds in their listed order, the patterns of the first four, and their limits.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "local_phone")
BASE_KINDS = KINDS[:4]
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
LOCAL_PHONE = re.compile(r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])")
# Words that speak for a kind, and words that speak against any, within CONTEXT characters.
CONTEXT = 40
FOR = {
    "email": ("mail", "contact", "correo"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "mastercard", "credit", "tarjeta", "carte", "karte"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "teléfono", "téléphone"),
    "iban": ("iban", "account", "bank", "konto", "cuenta", "compte"),
    "ssn": ("ssn", "social", "security"),
    "local_phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "teléfono", "téléphone"),
}
AGAINST = ("example", "version", "order", "isbn", "sample", "test")
#: What a confirmed span starts with; added kinds stay from KEEP on.
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.9, "phone": 0.8, "iban": 0.9, "ssn": 0.4, "local_phone": 0.3}
STEP, KEEP = 0.25, 0.5


def luhn(digits: str) -> bool:
    """The check digit of payment cards."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def mod97(account: str) -> bool:
    """The check digits of bank accounts."""
    turned = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _emails(text: str) -> list[tuple[int, int]]:
    """Addresses, found from each @ outwards: linear, and the same as searching from the left."""
    found, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL_CHARS:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((start, domain.end()))
        floor = domain.end() if domain else at + 1
        at = text.find("@", floor)
    return found


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def _score(text: str, kind: str, start: int, end: int) -> float:
    near = re.findall(r"\w+", (text[max(0, start - CONTEXT) : start] + " " + text[end : end + CONTEXT]).lower())
    score = PRIOR[kind] + STEP * any(w in FOR[kind] for w in near) - STEP * any(w in AGAINST for w in near)
    return min(1.0, max(0.0, round(score, 4)))


def spans_of(text: str | None) -> list[tuple[int, int, int, float]]:
    """``start, end, kind number, score`` of all spans of one text, in code points, in order."""
    if not text:
        return []
    found: list[tuple[int, int, int]] = [(a, b, 0) for a, b in _emails(text)]
    if any(c in text for c in "0123456789"):
        found += [(m.start(), m.end(), 1) for m in IP.finditer(text) if all(map(_small, m[0].split(".")))]
        for m in CARD.finditer(text):
            number = _digits(m[0])
            if 14 <= len(number) <= 19 and luhn(number):
                found.append((m.start(), m.end(), 2))
        found += [(m.start(), m.end(), 3) for m in PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
        taken = sorted(found)
        more = [(m.start(), m.end(), 4) for m in IBAN.finditer(text) if mod97(m[0].replace(" ", ""))]
        more += [(m.start(), m.end(), 5) for m in SSN.finditer(text)]
        more += [(m.start(), m.end(), 6) for m in LOCAL_PHONE.finditer(text)]
        found += [x for x in more if not any(a < x[1] and x[0] < b for a, b, _ in taken)]
    scored = [(a, b, k, _score(text, KINDS[k], a, b)) for a, b, k in sorted(found, key=lambda x: (x[0], x[2]))]
    return [x for x in scored if x[2] < len(BASE_KINDS) or x[3] >= KEEP]


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, spans``: for each row an array of (kind, start, end, score), ends exclusive, by start then kind.

    E-mail, IP, card and phone spans that pass their checks always stay; accounts (mod 97), social security
    numbers and phones without a country code are added where the words nearby support them. A null or empty
    text has no spans; rows with equal ids stay apart; other columns are not read.
    """
    kind = "struct<kind:string,start:int,end:int,score:double>"
    arrow = pa.list_(
        pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])
    )

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            spans = [
                [{"kind": KINDS[k], "start": a, "end": b, "score": s} for a, b, k, s in spans_of(t.as_py())]
                for t in batch.column(1)
            ]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, arrow)], ["doc_id", "spans"])

        return step

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(in_batches(make), f"doc_id {dict(rows.dtypes)['doc_id']}, spans array<{kind}>")


def _joined(spans: Column) -> Column:
    return F.concat_ws(
        ",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    )


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")


def digest(found: DataFrame) -> DataFrame:
    """Counts of the four base kinds, the hash of their spans, and all spans as text."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    counts = [_count(k).alias(f"n_{k}") for k in BASE_KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("top_score"),
    )
