"""Personal data: expressions propose spans, checksums confirm them, nearby words adjust their score.

Everything is a projection of column functions on one row: no join, no shuffle, no Python.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoquarry.llm.spans import find, once

WINDOW = 40
THRESHOLD = 0.5
FINDING = "array<struct<kind:string,start:bigint,end:bigint,score:double,match:string>>"


@dataclass(frozen=True)
class Detector:
    """A kind of span.  `pattern` proposes, `valid` confirms; `base` spans are kept whatever their score.

    `need` is an expression that every text with a match contains; it only saves work.  The score starts at `score` and
    rises by `lift` where a `context` word stands within `WINDOW` characters before the span.
    """

    kind: str
    pattern: str
    need: str
    score: float
    context: str
    base: bool = False
    lift: float = 0.3


# A run is entered at its start, or where the match before it ended: from inside a run nothing else could match,
# and so a long run is passed once.  Possessive quantifiers do not backtrack.
DETECTORS = (
    Detector(
        "email",
        r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        "@", 0.9, r"mail|contact|write|reach", base=True,
    ),
    Detector("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", 0.7, r"\bip\b|host|server|addr", base=True),
    Detector(
        "card",
        r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])",
        r"[0-9](?:[ -]?[0-9]){15}", 0.8, r"card|visa|credit|payment", base=True,
    ),
    Detector("phone", r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]", 0.7, r"phone|call|tel|mobile|fax", base=True),
    Detector(
        "iban",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}+(?: ?[A-Z0-9]{1,3}+)?(?![A-Za-z0-9])",
        r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}", 0.7, r"iban|account|bank|konto|compte|cuenta",
    ),
    Detector(
        "ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
        r"[0-9]{3}-[0-9]{2}-[0-9]{4}", 0.3, r"\bssn\b|social security|tax",
    ),
)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of a text pass the Luhn check."""
    return F.call_function("luhn_check", digits(value))


def mod97(value: Column) -> Column:
    """Whether a text passes the IBAN check: moved and spelt in digits it leaves 1 modulo 97."""
    plain = F.regexp_replace(value, " ", "")
    moved = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    points = F.transform(F.split(moved, "(?<=.)(?=.)"), F.ascii)
    rest = F.aggregate(
        points, F.lit(0),
        lambda acc, c: F.when(c >= 65, (acc * 100 + c - 55) % 97).otherwise((acc * 10 + c - 48) % 97),
    )
    return (rest == 1) & F.length(plain).between(15, 34)


def _octets(value: Column) -> Column:
    return ~F.exists(F.split(value, r"\."), lambda part: ~part.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})$"))


_CHECKS = {
    "ip": _octets,
    "card": luhn,
    "phone": lambda value: F.length(digits(value)).between(8, 15),
    "iban": mod97,
}


def _scored(d: Detector, body: str) -> Callable[[Column], Column]:
    def finding(s: Column) -> Column:
        begin = F.greatest(s["start"] - WINDOW, F.lit(0))
        before = F.substring(F.col(body), (begin + 1).cast("int"), (s["start"] - begin).cast("int"))
        score = F.least(F.lit(1.0), F.lit(d.score) + F.when(before.rlike(f"(?i){d.context}"), d.lift).otherwise(0.0))
        return F.struct(F.lit(d.kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), score.alias("score"), s["match"].alias("match"))

    return finding


def _on_match(check: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda s: check(s["match"])


def find_personal_data(df: DataFrame, text: str = "text", threshold: float = THRESHOLD, out: str = "findings") -> DataFrame:
    """All columns of `df` and `out`: the spans of each whole text with kind, place, score and the matched text.

    Spans are in the order of `DETECTORS`, then of their start; places count code points, the end is exclusive.  Per
    kind the leftmost matches count and do not overlap; a match that fails its check is dropped.  Null and
    empty texts have no spans.  A column named like `out` is replaced.
    """
    source, body = df.drop(out), "__pii_text"
    source = source.withColumn(body, F.coalesce(F.col(text), F.lit("")))
    raw = {}
    for d in DETECTORS:
        need = F.contains(F.col(body), F.lit(d.need)) if len(d.need) == 1 else F.col(body).rlike(d.need)
        raw[f"__pii_{d.kind}"] = find(body, d.pattern, need)
    located = once(source, **raw)
    parts = []
    for d in DETECTORS:
        spans = F.col(f"__pii_{d.kind}")
        if check := _CHECKS.get(d.kind):
            spans = F.filter(spans, _on_match(check))
        spans = F.transform(spans, _scored(d, body))
        parts.append(spans if d.base else F.filter(spans, lambda s: s["score"] >= threshold))
    result = once(located, **{out: F.concat(*parts).cast(FINDING)})
    return result.drop(body, *raw)
