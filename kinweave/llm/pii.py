"""Personal data in text: patterns propose spans, validators confirm them, context words move the score.

Built from DataFrame functions only. A pattern's matches come from ``regexp_extract_all`` and the text
between them from ``split`` by the same pattern, so running sums of both give the places, in code points
with an exclusive end.

Base kinds are email, ip (each part at most 255), card (12 to 19 digits passing Luhn) and phone (+ and 9 to
15 digits); a confirmed match is always a span. Added kinds are iban (mod 97), ssn, local phone numbers
("phone2") and secrets. Each has a prior score; a passed checksum and a context word within 40 characters
before the span raise it, and spans of ``threshold`` or more are reported.

Null and empty texts have no spans. Ids aren't interpreted, repeated rows are searched each on its own and
other columns aren't read. Each pattern needs time in proportion to the text: none can start inside a
run that it has already refused.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

CHUNK = 256
CONTEXT_CHARS = 40


@dataclass(frozen=True)
class Kind:
    """``cue`` is a cheap test that texts with a match pass. ``prior`` None marks a base kind."""

    name: str
    pattern: str
    cue: str
    prior: float | None = None
    checksum: float = 0.0
    context: str = ""
    context_boost: float = 0.0


#: Countries by the length of their account numbers (IBAN registry).
_IBAN = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
#: A number ends at its country's length, whatever follows; any other run is tried whole.
_IBAN_BODY = "|".join(rf"(?:{'|'.join(c.split())})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])" for n, c in _IBAN.items())

#: In this order where spans start together.
KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", "[0-9][.][0-9]"),
    Kind("card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}(?![\x20-]?[0-9])", "[0-9][ -]?[0-9]"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "[+][0-9]"),
    Kind("iban", rf"(?<![A-Za-z0-9])(?:{_IBAN_BODY}|[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{11,30}}(?![A-Za-z0-9]))", "[A-Z][A-Z][0-9][0-9]", 0.4, 0.5, "iban|account|konto|compte|cuenta|bank", 0.1),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "[0-9]-[0-9]", 0.5, 0.0, "ssn|social security|tax id", 0.4),
    Kind("phone2", r"(?<![0-9+().-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9-])", "[0-9][.-][0-9]", 0.4, 0.0, "phone|call|tel|fax|mobile", 0.3),
    Kind("secret", r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,}+|AKIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{36,}+|sk-[A-Za-z0-9]{20,}+)(?![A-Za-z0-9])", "[0-9a-f]{32}|AKIA|ghp_|sk-", 0.4, 0.0, "token|secret|password|passwd|api[_ -]?key|credential", 0.4),
)
BASE_KINDS = ("email", "ip", "card", "phone")


def running_sums(values: Column) -> Column:
    """Sums of all earlier values, in chunks so that long arrays aren't copied for each element."""
    zero = F.lit(0).cast("bigint")

    def within(part: Column) -> Column:
        start = F.struct(zero.alias("total"), F.array().cast("array<bigint>").alias("sums"))
        add = lambda acc, x: F.struct((acc["total"] + x).alias("total"), F.concat(acc["sums"], F.array(acc["total"])).alias("sums"))
        return F.aggregate(part, start, add)

    n_chunks = F.greatest(F.lit(1), F.ceil(F.size(values) / CHUNK).cast("int"))
    parts = F.transform(F.sequence(F.lit(0), n_chunks - 1), lambda g: within(F.slice(values, g * CHUNK + 1, F.lit(CHUNK))))
    before = within(F.transform(parts, lambda p: p["total"]))["sums"]
    return F.flatten(F.zip_with(parts, before, lambda p, b: F.transform(p["sums"], lambda x: x + b)))


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if the digits pass: every second one from the right is doubled, less 9 if above 9."""
    n = F.length(digits)

    def value(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, i: acc + value(i)) % 10 == 0


def mod97(iban: Column) -> Column:
    """True if the account number, its first four characters last and letters as 10 to 35, leaves 1 modulo 97."""
    plain = F.regexp_replace(iban, " ", "")
    turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))

    def step(acc: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 58, (acc * 10 + code - 48) % 97).otherwise((acc * 100 + code - 55) % 97)

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step) == 1


def confirmed(kind: str, match: Column) -> Column:
    """The kind's validator."""
    digits = digits_of(match)
    if kind == "ip":
        return F.forall(F.split(match, "[.]"), lambda p: p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"))
    if kind == "card":
        return luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        return mod97(match)
    return F.lit(True)


def _places(text: Column, kind: Kind) -> Column:
    """Array of (start, match) of all matches."""
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    pieces = F.transform(F.split(text, kind.pattern, -1), lambda p: F.length(p).cast("bigint"))
    steps = F.zip_with(found, F.slice(pieces, 1, F.size(found)), lambda m, p: F.struct(m.alias("match"), p.alias("gap"), (p + F.length(m)).alias("step")))
    starts = F.zip_with(steps, running_sums(F.transform(steps, lambda s: s["step"])), lambda s, b: F.struct((b + s["gap"]).alias("start"), s["match"].alias("match")))
    empty = F.array().cast("array<struct<start:bigint,match:string>>")
    cue = text.contains(kind.cue) if kind.cue == "@" else text.rlike(kind.cue)
    return F.when(cue, F.when(F.size(found) > 0, F.filter(starts, lambda x: x["match"].isNotNull() & confirmed(kind.name, x["match"])))).otherwise(empty)


def find_pii(docs: DataFrame, id: str = "doc_id", text: str = "text", kinds: tuple[Kind, ...] = KINDS, threshold: float = 0.7) -> DataFrame:
    """doc_id, text and ``spans``: an array of (start, rank, kind, end, score) in order of start, then kind."""
    rows = docs.select(F.col(id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    body = F.col("text")
    for kind in kinds:
        rows = rows.withColumn(f"found_{kind.name}", _places(body, kind))

    def scored(rank: int, kind: Kind) -> Column:
        def span(x: Column) -> Column:
            ahead = F.lower(F.substring(body, F.greatest(x["start"] - CONTEXT_CHARS + 1, F.lit(1)).cast("int"), F.least(x["start"], F.lit(CONTEXT_CHARS)).cast("int")))
            score = F.lit(1.0) if kind.prior is None else F.lit(kind.prior + kind.checksum) + F.when(ahead.rlike(kind.context), kind.context_boost).otherwise(0.0)
            return F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind.name).alias("kind"), (x["start"] + F.length(x["match"])).alias("end"), score.alias("score"))

        empty = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint,score:double>>")
        spans = F.transform(F.col(f"found_{kind.name}"), span)
        return F.coalesce(spans if kind.prior is None else F.filter(spans, lambda s: s["score"] >= threshold - 1e-9), empty)

    spans = F.array_sort(F.concat(*(scored(i, k) for i, k in enumerate(kinds))))
    return rows.select("doc_id", "text", spans.alias("spans"))


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(found: DataFrame) -> DataFrame:
    """doc_id and text with each span replaced by its kind in angle brackets; of overlapping spans the first stays."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        return F.when(s["start"] < acc["at"], acc).otherwise(F.struct(s["end"].alias("at"), F.concat(acc["out"], gap, F.lit("<"), s["kind"], F.lit(">")).alias("out")))

    done = F.aggregate(F.col("spans"), start, step)
    tail = F.substring(F.col("text"), (done["at"] + 1).cast("int"), F.length("text"))
    return found.select("doc_id", F.concat(done["out"], tail).alias("text"), "spans")
