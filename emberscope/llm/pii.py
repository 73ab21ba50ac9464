"""Personal data: patterns propose spans, checksums confirm them, context words adjust a score.

Main path: SQL functions alone.  A pattern's matches are enclosed in two marks by one
``regexp_replace``; splitting at the marks and summing lengths gives each span's place in code
points, as no SQL function returns the places of all matches.

Kinds, in the order in which equal starts are listed:

* ``email``, ``ip``, ``card``, ``phone``: base kinds.  Once confirmed (parts at most 255, Luhn,
  number of digits) they are always kept; context only adjusts their score.
* ``iban``: mod-97 must hold; compact, or in groups of four with single spaces at its country's length.
* ``ssn``: three-two-four digits; kept only with a context word before or after it.

Null text counts as empty; empty text has no spans.  Rows that repeat each give their own result.
Matches don't overlap within a kind; kinds may overlap each other.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberscope.llm.common import CLOSE, OPEN, OTHER, let

SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
#: Characters of an IBAN by country.
IBAN_LENGTHS = """
AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21
HU28 IE22 IL23 IS26 IT27 JO30 KW30 KZ20 LB28 LI21 LT20 LU20 LV21 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22
SA24 SE24 SI19 SK24 SM27 TN24 TR26 UA29 VG24 XK20
"""


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""

    def step(total: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        doubled = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 0, doubled).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an IBAN's check digits hold: its remainder by 97 is 1."""
    turned = F.concat(F.substr(code, F.lit(5)), F.substr(code, F.lit(1), F.lit(4)))

    def step(rest: Column, c: Column) -> Column:
        v = F.ascii(c)
        return F.when(v >= 65, (rest * 100 + v - 55) % 97).otherwise((rest * 10 + v - 48) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def grouped_iban() -> str:
    """Pattern of IBANs in groups of four: each country's own length, so that a word after one isn't taken with it."""
    by: dict[int, list[str]] = {}
    for entry in IBAN_LENGTHS.split():
        by.setdefault(int(entry[2:]), []).append(entry[:2])

    def body(length: int) -> str:
        fours, rest = divmod(length - 4, 4)
        return f"[0-9]{{2}}(?: [A-Z0-9]{{4}}){{{fours}}}" + (f" [A-Z0-9]{{{rest}}}" if rest else "")

    return "|".join(f"(?:{'|'.join(names)}){body(length)}" for length, names in sorted(by.items()))


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


@dataclass(frozen=True)
class Kind:
    """A pattern, a cheap test that the text can hold it, the confirming check, and scores."""

    name: str
    pattern: str
    guard: object
    check: object = field(default=lambda v: F.lit(True))
    score: float = 0.6
    words: tuple[str, ...] = ()
    prepare: object = field(default=lambda t: t)


#: Starts are pinned to where a run of the pattern's first class begins (or the last match ended),
#: which changes no match and spares a quadratic search through long runs.
KINDS = (
    Kind(
        "email",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        lambda t: t.contains("@"),
        score=0.9,
        words=("mail", "contact", "write to"),
    ),
    Kind(
        "ip",
        r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
        lambda v: v.rlike(rf"^{BYTE}\.{BYTE}\.{BYTE}\.{BYTE}$"),
        words=("ip", "address", "host", "server"),
    ),
    Kind(
        "card",
        r"[0-9][0-9 -]++",
        lambda t: t.rlike(r"[0-9][0-9 -]{11}"),
        lambda v: let(digits_of(v), lambda d: F.length(d).between(12, 19) & luhn(d)),
        score=0.8,
        words=("card", "visa", "pay", "credit"),
        # A separator that doesn't stand alone between two digits ends a number; as a letter it does so for the plain class above.
        prepare=lambda t: F.regexp_replace(t, r"(?<![0-9])[ -]|[ -](?![0-9])", "x"),
    ),
    Kind(
        "phone",
        r"\+[0-9][ ().0-9-]+[0-9]",
        lambda t: t.contains("+"),
        lambda v: F.length(digits_of(v)).between(9, 15),
        words=("phone", "call", "tel", "mobile"),
    ),
    Kind(
        "iban",
        rf"(?<![A-Za-z0-9])(?:[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}|{grouped_iban()})(?![A-Za-z0-9])",
        lambda t: t.rlike(r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4} ?[A-Z0-9]{4} ?[A-Z0-9]{3}"),
        lambda v: mod97(F.translate(v, " ", "")),
        score=0.8,
        words=("iban", "account", "bank"),
    ),
    Kind(
        "ssn",
        r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
        lambda t: t.rlike(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
        score=0.3,
        words=("ssn", "social", "security"),
    ),
)
BASE = ("email", "ip", "card", "phone")
#: Characters before and after a span in which context words count, what one adds, and what a span other than a base one needs.
NEAR, BONUS, LEAST = 40, 0.3, 0.5


def found(text: Column, pattern: str, kind: int) -> Column:
    """All matches, leftmost first and not overlapping, as spans in code points."""
    none = F.lit([]).cast(SPAN)
    state = F.struct(F.lit(0).alias("at"), none.alias("spans"))

    def step(acc: Column, piece: Column) -> Column:
        n = F.instr(piece, CLOSE)
        span = F.struct(
            acc["at"].alias("start"), F.lit(kind).alias("kind"), (acc["at"] + n - 1).alias("end"),
            F.substring(piece, F.lit(1), n - 1).alias("value"),
        )
        return F.when(n == 0, F.struct((acc["at"] + F.length(piece)).alias("at"), acc["spans"].alias("spans"))).otherwise(
            F.struct((acc["at"] + F.length(piece) - 1).alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))
        )

    pieces = F.split(F.regexp_replace(text, pattern, f"{OPEN}$0{CLOSE}"), OPEN)
    return F.aggregate(pieces, state, step, lambda acc: acc["spans"])


def confirmed(t: Column, i: int, kind: Kind) -> Column:
    """One kind's spans that pass its check, with scores; of other kinds than base ones, those with enough."""

    def scored(s: Column) -> Column:
        before = F.lower(F.substring(t, F.greatest(s["start"] - NEAR + 1, F.lit(1)), F.least(s["start"], F.lit(NEAR))))
        after = F.lower(F.substring(t, s["end"] + 1, F.lit(NEAR)))
        near = F.lit(False)
        for w in kind.words:
            near = near | before.contains(w) | after.contains(w)
        score = F.least(F.lit(1.0), F.lit(kind.score) + F.when(near, BONUS).otherwise(0.0))
        return F.struct(*[s[c].alias(c) for c in ("start", "kind", "end", "value")], score.alias("score"))

    hits = F.transform(F.filter(found(kind.prepare(t), kind.pattern, i), lambda s: kind.check(s["value"])), scored)
    return hits if kind.name in BASE else F.filter(hits, lambda s: s["score"] >= LEAST)


def spans(text: Column) -> Column:
    """Array of (start, kind, end, value, score), by start and kind, of what is kept."""
    plain = F.coalesce(text, F.lit(""))
    plain = F.when(plain.contains(OPEN) | plain.contains(CLOSE), F.translate(plain, OPEN + CLOSE, OTHER * 2)).otherwise(plain)

    def of(t: Column) -> Column:
        empty = F.lit([]).cast(SPAN.replace("value:string", "value:string,score:double"))
        parts = [F.when(k.guard(t), confirmed(t, i, k)) for i, k in enumerate(KINDS)]
        return F.array_sort(F.concat(*[F.coalesce(p, empty) for p in parts]))

    return let(plain, of)


def listed(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k.name) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def detect(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """``docs`` with a column of spans: start, kind (a place in KINDS), end, value, score."""
    return docs.withColumn(out, spans(docs[text]))


def redacted(docs: DataFrame, text: str = "text", mark: str = "[PII]") -> DataFrame:
    """``docs`` with every found span replaced by ``mark``; spans that overlap are replaced together."""
    plain = F.coalesce(docs[text], F.lit(""))
    start = F.struct(F.lit(0).alias("at"), F.lit([]).cast("array<string>").alias("parts"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(plain, acc["at"] + 1, s["start"] - acc["at"])
        more = F.when(s["start"] >= acc["at"], F.array(gap, F.lit(mark))).otherwise(F.lit([]).cast("array<string>"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["parts"], more).alias("parts"))

    cut = F.aggregate(spans(docs[text]), start, step, lambda a: F.concat(F.array_join(a["parts"], ""), F.substr(plain, a["at"] + 1)))
    return docs.withColumn(text, F.when(docs[text].isNotNull(), cut))
