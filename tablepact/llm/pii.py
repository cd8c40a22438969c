"""Personal data: patterns propose spans, checksums confirm them, context scores them.

A pattern proposes leftmost spans that do not overlap within a kind. A validator drops
those it can refute: the parts of an address, the Luhn sum of a card, the digits of a
phone number, the remainder mod 97 of a bank account (IBAN), the areas of a social
security number. A span's score starts at 0.5, gains 0.4 where a checksum holds, and
0.2 where a word of its kind's context stands within 40 characters. The four base
kinds are always reported; of the added kinds, those with a score of 0.6 or more, so a
bank account needs its checksum and a social security number its context. A bank
account may start wherever its first four characters stand; what follows is cut to its
country's length, and else taken as far as it goes, whichever the checksum confirms.

Positions are code points, ends exclusive. All work is expressions over whole texts:
a text is split by the pattern, so the lengths of the gaps and of the matches give
the positions; the context is cut from the text. The patterns cannot backtrack over
more than one run, so a very long text takes time in proportion.

Edge cases: a null or empty text has no spans; repeated rows each have their own;
other columns are kept as they are by ``redacted``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablepact.llm.common import free_name, text_of

#: Characters before and after a span in which a context word counts.
NEAR = 40
#: Score from which a span of an added kind is reported.
REPORTED = 0.6

SPAN = "array<struct<start:int,end:int,match:string>>"


@dataclass(frozen=True)
class Kind:
    """``pattern`` proposes; ``hint`` is a cheap test that no text with a span fails."""

    name: str
    pattern: str
    hint: str
    valid: Callable[[Column], Column]
    checksum: bool
    context: str
    base: bool = True
    #: If the pattern finds starts only: the confirmed match at the beginning of a text, or null.
    whole: Callable[[Column], Column] | None = None


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]+", "")


def ip_valid(value: Column) -> Column:
    """Every part is at most 255; leading zeros do not count."""
    return F.forall(
        F.split(value, "\\.", -1),
        lambda part: F.coalesce(F.regexp_replace(part, "^0+(?=[0-9])", "").try_cast("int") <= 255, F.lit(False)),
    )


def luhn_valid(digits: Column) -> Column:
    total = F.aggregate(
        F.transform(
            F.split(F.reverse(digits), ""),
            lambda d, i: F.when(i % 2 == 0, d.try_cast("int")).otherwise(
                d.try_cast("int") * 2 - F.when(d >= "5", 9).otherwise(0)),
        ),
        F.lit(0), lambda acc, d: acc + F.coalesce(d, F.lit(0)),
    )
    return total % 10 == 0


def card_valid(value: Column) -> Column:
    return F.length(_digits(value)).between(13, 19) & luhn_valid(_digits(value))


def phone_valid(value: Column) -> Column:
    return F.length(_digits(value)).between(9, 15)


def mod97_valid(value: Column) -> Column:
    """The remainder of an account number whose first four characters come last."""
    plain = F.translate(value, " ", "")
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    rest = F.aggregate(
        F.split(turned, ""), F.lit(0),
        lambda acc, c: F.when(c.between("0", "9"), (acc * 10 + F.ascii(c) - 48) % 97)
        .when(c.between("A", "Z"), (acc * 100 + F.ascii(c) - 55) % 97).otherwise(acc),
    )
    return F.length(plain).between(15, 34) & (rest == 1)


# The lengths of account numbers by country, as registered.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC",
    32: "LC", 33: "RU",
}
IBAN = r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"
#: Characters of the longest account number, blanks between its groups counted.
IBAN_LONGEST = 4 + 8 * 5


def iban_at_start(text: Column) -> Column:
    """The account number that a text begins with, if the checksum confirms one."""
    ends = (((n - 4) // 4, (n - 4) % 4, countries.replace(" ", "|")) for n, countries in IBAN_LENGTHS.items())
    cut = "|".join(f"(?:{c})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{q}}}" + f"(?: ?[A-Z0-9]{{{r}}})" * (r > 0) for q, r, c in ends)
    found = F.array(F.regexp_extract(text, f"^(?:{cut})", 0), F.regexp_extract(text, f"^(?:{IBAN})", 0))
    return F.get(F.filter(found, mod97_valid), F.lit(0))


def ssn_valid(value: Column) -> Column:
    """Three, two and four digits, in areas and groups that are given out."""
    return (
        value.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$")
        & ~value.rlike("^(000|666|9)") & ~value.rlike("-00-") & ~value.rlike("-0000$")
    )


def _always(value: Column) -> Column:
    return value.isNotNull()


def _word(words: str) -> str:
    """One of the words, with no letter, digit or underscore of any script beside it."""
    edge = r"[^\p{L}\p{N}_]"
    return f"(?:^|{edge})(?:{words})(?:$|{edge})"


# The kinds in the order of a report. The base patterns find what
# [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+ and so on find, but start only where
# a run starts or the last match ended, and never give back what a run has taken.
KINDS: tuple[Kind, ...] = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         "@[A-Za-z0-9-]", _always, False, _word("e-?mail|mail|contact|write")),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
         r"[0-9]\.[0-9]", ip_valid, False, _word("ip|address|host|server")),
    Kind("card", r"[0-9](?:[ -]?[0-9])++",
         "[0-9](?:[ -]?[0-9]){12}", card_valid, True, _word("card|visa|mastercard|amex|credit|debit")),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]",
         r"\+[0-9]", phone_valid, False, _word("phone|tel|call|mobile|fax")),
    Kind("iban", r"[A-Z]{2}[0-9]{2}(?= ?[A-Z0-9]{4})",
         "[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}", _always, True, _word("iban|account|bank|bic"), False, iban_at_start),
    Kind("ssn", r"(?:(?<![0-9])|\G)[0-9]++-[0-9]++-[0-9]++",
         "[0-9]{3}-[0-9]{2}-[0-9]{4}", ssn_valid, False, _word("ssn|social|security"), False),
)


def proposed(text: Column, kind: Kind, digits: Column) -> Column:
    """The spans of one kind that its pattern proposes and its validator leaves."""
    gaps = F.split(text, kind.pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    cut = F.arrays_zip(gaps.alias("gap"), matches.alias("match"))

    def place(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["match"]), F.lit(0))
        return F.struct(end.alias("at"), F.array_append(acc["found"], F.struct(
            start.alias("start"), end.alias("end"), x["match"].alias("match"),
        )).alias("found"))

    def completed(s: Column) -> Column:
        match = kind.whole(F.substring(text, s["start"] + 1, F.lit(IBAN_LONGEST)))
        return F.transform(F.array(match), lambda m: F.struct(
            s["start"].alias("start"), (s["start"] + F.length(m)).alias("end"), m.alias("match")))[0]

    def apart(acc: Column, s: Column) -> Column:
        free = s["start"] >= F.coalesce(F.get(acc, F.size(acc) - 1)["end"], F.lit(0))
        return F.when(s["match"].isNotNull() & free, F.array_append(acc, s)).otherwise(acc)

    placed = F.aggregate(
        cut, F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("found")), place,
        lambda acc: F.filter(acc["found"], lambda s: s["match"].isNotNull() & kind.valid(s["match"])),
    )
    if kind.whole:
        placed = F.aggregate(F.transform(placed, completed), F.array().cast(SPAN), apart)
    empty = F.array().cast(SPAN)
    possible = text.rlike(kind.hint)
    return F.when((possible if kind.name == "email" else digits & possible), placed).otherwise(empty)


def scored(spans: Column, kind: Kind, text: Column) -> Column:
    """With a score instead of the match; weak spans of added kinds go."""
    def score(s: Column) -> Column:
        before = F.substring(text, F.greatest(s["start"] + 1 - NEAR, F.lit(1)), F.least(s["start"], F.lit(NEAR)))
        after = F.substring(text, s["end"] + 1, F.lit(NEAR))
        near = F.lower(before).rlike(kind.context) | F.lower(after).rlike(kind.context)
        return F.struct(
            F.lit(kind.name).alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
            (F.lit(0.9 if kind.checksum else 0.5) + F.when(near, 0.2).otherwise(0.0)).alias("score"),
        )

    found = F.transform(spans, score)
    return found if kind.base else F.filter(found, lambda s: s["score"] >= REPORTED)


def with_spans(docs: DataFrame, text: str, into: str) -> DataFrame:
    """The frame with an array of (kind, start, end, score), by kind as listed, then start."""
    digits = free_name(docs, "_digits")
    names = {kind.name: free_name(docs, f"_{kind.name}") for kind in KINDS}
    source = text_of(text)
    step = docs.withColumn(digits, source.rlike("[0-9]"))
    step = step.withColumns({names[k.name]: proposed(source, k, F.col(digits)) for k in KINDS})
    step = step.withColumn(into, F.concat(*[scored(F.col(names[k.name]), k, source) for k in KINDS]))
    return step.drop(digits, *names.values())


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """The documents, each reported span replaced by its kind in brackets.

    Spans of different kinds that overlap are replaced together, by the kind of the
    one that starts first (of equal starts, the longest).
    """
    spans, plan = free_name(docs, "_spans"), free_name(docs, "_plan")
    source = F.col(text)
    found = with_spans(docs, text, spans)
    ordered = F.array_sort(F.transform(
        F.col(spans), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))

    def merge(acc: Column, s: Column) -> Column:
        end = -s["back"]
        own = F.struct(s["start"].alias("start"), end.alias("end"), s["kind"].alias("kind"))
        last = F.get(acc, F.size(acc) - 1)
        wider = F.struct(last["start"].alias("start"), F.greatest(last["end"], end).alias("end"), last["kind"].alias("kind"))
        return F.when(F.coalesce(s["start"] < last["end"], F.lit(False)),
                      F.array_append(F.slice(acc, F.lit(1), F.size(acc) - 1), wider)).otherwise(F.array_append(acc, own))

    merged = F.aggregate(ordered, F.array().cast("array<struct<start:int,end:int,kind:string>>"), merge)
    step = found.withColumn(plan, F.when(F.size(spans) > 0, merged))
    pieces = F.transform(F.col(plan), lambda s, i: F.concat(
        F.substring(source, F.coalesce(F.get(F.col(plan), i - 1)["end"], F.lit(0)) + 1,
                    s["start"] - F.coalesce(F.get(F.col(plan), i - 1)["end"], F.lit(0))),
        F.lit("["), F.upper(s["kind"]), F.lit("]"),
    ))
    tail = F.substring(source, F.element_at(F.col(plan), -1)["end"] + 1, F.length(source))
    masked = F.when(F.col(plan).isNotNull(), F.concat(F.array_join(pieces, ""), tail)).otherwise(source)
    return step.withColumn(text, masked).select(*docs.columns)
