"""Personal data in DataFrame functions only.

Regular expressions propose spans, checksums and value ranges confirm them
(Luhn for cards, mod 97 for IBANs, octets, digit counts), words just before a
span adjust its score. A proposal is reported from ``threshold`` on. The base
kinds email, ip, card and phone are certain once confirmed; iban, ssn and
local_phone are proposals whose score depends on checksum and context, and
give way to a base span that they overlap.

Patterns take their text possessively and begin at the edge of a run, so that
long runs cost linear time and no stack; what matches is the same. A text
without the characters that a pattern needs isn't searched.

Positions are code points, end exclusive. NULL and empty texts have no spans.
Rows with the same ``doc_id`` are searched each for itself; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text

BASE_KINDS = ("email", "ip", "card", "phone")
EXTRA_KINDS = ("iban", "ssn", "local_phone")
SPAN = "array<struct<kind:string,start:int,end:int,match:string,score:double>>"

_LOCAL = r"A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
    "local_phone": r"(?<![0-9+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9])",
}
#: Score of a confirmed proposal, and what a word of its context adds.
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.9, "phone": 0.8, "iban": 0.9, "ssn": 0.35, "local_phone": 0.35}
CONTEXT = {
    "email": r"e-?mail|contact|mail to",
    "ip": r"\bip\b|address|host|server",
    "card": r"card|visa|mastercard|payment|credit",
    "phone": r"phone|tel|call|mobile|fax",
    "iban": r"iban|account|bank|konto",
    "ssn": r"\bssn\b|social security|sozialversicherung",
    "local_phone": r"phone|tel|call|mobile|fax",
}
CONTEXT_BONUS, CONTEXT_REACH = 0.3, 40


def _needed(kind: str, text: Column) -> Column:
    if kind in ("email", "phone"):
        return text.contains("@" if kind == "email" else "+")
    return text.rlike("[0-9]")


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _mod97(match: Column) -> Column:
    """Remainder of an IBAN: first four characters last, letters as 10 to 35."""
    compact = F.replace(match, F.lit(" "))
    turned = F.concat(F.substr(compact, F.lit(5)), F.substring(compact, 1, 4))

    def step(acc: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, acc * 100 + code - 55).otherwise(acc * 10 + code - 48) % 97

    return F.aggregate(F.regexp_extract_all(turned, F.lit("."), F.lit(0)), F.lit(0), step)


def _iban(match: Column) -> Column:
    """The longest part of a proposal, from its first character to a space or
    its end, that mod 97 confirms: the words after an IBAN may look like its
    groups. The whole if there is none."""
    groups = F.split(match, " ")
    parts = F.transform(F.sequence(F.size(groups), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(groups, F.lit(1), n), " "))
    return F.coalesce(F.get(F.filter(parts, lambda x: (F.length(F.replace(x, F.lit(" "))) >= 12) & (_mod97(x) == 1)), F.lit(0)), match)


def _confirmed(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda part: (F.length(F.regexp_replace(part, "^0+(?=.)", "")) <= 3) & (F.lpad(F.regexp_replace(part, "^0+(?=.)", ""), 3, "0") <= "255"))
    if kind == "card":
        return F.length(_digits(match)).between(13, 19) & F.call_function("luhn_check", _digits(match))
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    if kind == "iban":
        return _mod97(match) == 1
    return F.lit(True)


def _proposed(kind: str, text: Column) -> Column:
    """Matches with their places, from the texts between the matches."""
    found, between = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)), F.split(text, PATTERNS[kind], -1)
    row = "struct<start:int,match:string>"
    none = F.from_json(F.lit("[]"), f"array<{row}>")

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["between"])
        return F.struct((start + F.length(pair["match"])).alias("at"),
                        F.array_append(acc["out"], F.struct(start.alias("start"), pair["match"].alias("match"))).cast(f"array<{row}>").alias("out"))

    pairs = F.zip_with(found, F.slice(between, F.lit(1), F.size(found)), lambda m, b: F.struct(m.alias("match"), b.alias("between")))
    # the zero start has a nullable place like every later one
    zero = F.from_json(F.lit('{"at":0,"out":[]}'), f"struct<at:int,out:array<{row}>>")
    return F.when(_needed(kind, text), F.aggregate(pairs, zero, step)["out"]).otherwise(none)


def find_pii(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``doc_id, spans``: kind, start, end, match and score of each, base kinds first, then by start."""
    rows = id_text(docs)
    kinds = BASE_KINDS + EXTRA_KINDS
    rows = rows.withColumns({f"m_{k}": _proposed(k, F.col("text")) for k in kinds})
    text = F.col("text")

    def spans(kind: str) -> Column:
        found = F.col(f"m_{kind}")
        if kind == "iban":
            found = F.transform(found, lambda m: F.struct(m["start"].alias("start"), _iban(m["match"]).alias("match")))
        kept = F.filter(found, lambda m: _confirmed(kind, m["match"]))

        def span(m: Column) -> Column:
            before = F.lower(F.substr(text, F.greatest(m["start"] + 1 - CONTEXT_REACH, F.lit(1)), F.least(m["start"], F.lit(CONTEXT_REACH))))
            score = F.lit(PRIOR[kind]) + F.when(before.rlike(CONTEXT[kind]), CONTEXT_BONUS).otherwise(0.0)
            return F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), (m["start"] + F.length(m["match"])).alias("end"), m["match"].alias("match"), F.least(score, F.lit(1.0)).alias("score"))

        return F.transform(kept, span).cast(SPAN)

    rows = rows.withColumns({f"s_{k}": spans(k) for k in kinds}).drop(*[f"m_{k}" for k in kinds])
    base = F.concat(*[F.col(f"s_{k}") for k in BASE_KINDS])
    rows = rows.select("doc_id", base.alias("base"), F.filter(F.concat(*[F.col(f"s_{k}") for k in EXTRA_KINDS]), lambda s: s["score"] >= threshold).alias("extra"))
    free = F.filter("extra", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return rows.select("doc_id", F.concat("base", free).alias("spans"))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
