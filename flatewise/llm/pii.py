"""Personal data: patterns propose spans, checksum validators confirm them, nearby context words adjust the score.

Native: one scan, no shuffle, no Python. Base kinds are email, ip, card (Luhn) and phone; the method adds iban (mod-97)
and national identity numbers (``ssn``), the latter only where a context word stands nearby, since they have no checksum.

Defined results: null or empty text has no spans; repeated rows are judged one by one; spans of one start are ordered by
kind; an empty table gives no rows; other columns are ignored. Patterns are written with possessive quantifiers and start
anchors and the text around a span is read from its page, so that a text of any length, with any number of spans, takes
time nearly in proportion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans as S
from .common import let, upto

_LOCAL = r"[A-Za-z0-9._%+-]"
#: Each starts where the plain pattern's leftmost match starts: at a run's first character, or where the last match ended.
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Takes an IBAN's first four characters; group 1 is all that may follow, so that one start can't hide the next.
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=((?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?)(?![A-Za-z0-9]))"
#: Characters of an IBAN by country, as registered.
IBAN_LENGTHS = (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 "
    "GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NI28 NL18 NO15 "
    "OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
)
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")

#: Prior score of a confirmed span, and words whose presence within WINDOW characters on either side adds BOOST.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.95, "ssn": 0.3}
CONTEXT = {
    "email": "mail|contact|address|write",
    "ip": "ip|host|server|address|login",
    "card": "card|visa|mastercard|credit|payment|account",
    "phone": "phone|call|tel|mobile|fax|contact",
    "iban": "iban|bank|account|transfer",
    "ssn": "ssn|social security|social|identity",
}
WINDOW, BOOST = 48, 0.25
#: A span of a kind that no checksum confirms needs this score.
LEAST = 0.5


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def weighed(reverse: Column) -> Column:
        each = F.transform(
            upto(F.length(reverse)),
            lambda i: let(
                F.substr(reverse, i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1),
                lambda d: F.when(d > 9, d - 9).otherwise(d),
            ),
        )
        return F.aggregate(each, F.lit(0), lambda a, b: a + b) % 10 == 0

    return let(F.reverse(number), weighed)


def mod97(iban: Column) -> Column:
    """Whether an IBAN without spaces leaves 1 modulo 97 once its first four characters stand last and letters are 10-35."""

    def rest(moved: Column) -> Column:
        return F.aggregate(
            F.split(moved, ""),
            F.lit(0),
            lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97)
            .when(c.rlike("[A-Z]"), (a * 100 + F.ascii(c) - 55) % 97)
            .otherwise(a),
        )

    return let(F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(4))), rest) == 1


def _few_digits(least: int, most: int):
    return lambda v: F.length(digits(v)).between(least, most)


def ibans(text: Column) -> Column:
    """Spans of IBANs: what may follow a start is cut at the blank where the country's length is reached, or else taken whole."""
    lengths = F.create_map(*[F.lit(x) for e in IBAN_LENGTHS.split() for x in (e[:2], int(e[2:]))])

    def confirmed(s: Column, whole: Column) -> Column:
        size = F.try_element_at(lengths, F.left(whole, F.lit(2)))
        ends = F.filter(upto(F.length(whole) + 1), lambda i: (i == F.length(whole)) | (F.substr(whole, i + 1, F.lit(1)) == " "))
        own = F.filter(ends, lambda i: F.length(F.replace(F.substr(whole, F.lit(1), i), F.lit(" "), F.lit(""))) == size)
        cuts = F.transform(F.array_distinct(F.concat(own, F.array(F.length(whole)))), lambda i: F.substr(whole, F.lit(1), i))
        valid = F.filter(cuts, lambda v: let(F.replace(v, F.lit(" "), F.lit("")), lambda w: F.length(w).between(15, 34) & mod97(w)))
        stop = lambda v: (s["start"] + F.length(v)).cast("int").alias("stop")
        return F.transform(F.slice(valid, 1, 1), lambda v: F.struct(s["start"].alias("start"), s["ord"].alias("ord"), stop(v), s["kind"].alias("kind"), v.alias("value")))

    def each(x: Column) -> Column:
        found = F.flatten(F.transform(x["heads"], lambda s, i: let(F.concat(s["value"], F.get(x["tails"], i)), lambda whole: confirmed(s, whole)))).cast(S.SPAN)
        # what lies wholly within the one before it tells nothing more
        return F.filter(found, lambda s, i: F.coalesce(F.get(found, i - 1)["stop"] < s["stop"], F.lit(True)))

    parts = F.struct(S.find(text, "iban", 4, IBAN, lambda _: F.lit(True), F.lit(True)).alias("heads"), F.regexp_extract_all(text, F.lit(IBAN), F.lit(1)).alias("tails"))
    return F.when(text.rlike(IBAN), let(parts, each)).otherwise(F.array()).cast(S.SPAN)


def find_all(text: Column) -> Column:
    """Every confirmed span of the text before context is looked at."""
    octets = lambda v: F.forall(F.split(v, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.lpad(F.right(p, F.lit(3)), 3, "0") <= "255"))
    return F.concat(
        S.find(text, "email", 0, EMAIL, lambda _: F.lit(True), F.contains(text, F.lit("@")) & text.rlike(EMAIL)),
        S.find(text, "ip", 1, IP, octets),
        S.find(text, "card", 2, CARD, lambda v: _few_digits(14, 19)(v) & luhn(digits(v))),
        S.find(text, "phone", 3, PHONE, _few_digits(10, 15), F.contains(text, F.lit("+")) & text.rlike(PHONE)),
        ibans(text),
        S.find(text, "ssn", 5, SSN, lambda v: ~v.rlike("^(?:000|666|9..)|-00-|0000$")),
    )


def scored(text: Column, found: Column) -> Column:
    """[(span, score)]: the kind's prior, raised where one of its context words stands shortly before or after the span."""

    def all_of(x: Column) -> Column:
        def one(s: Column) -> Column:
            before = F.lower(S.part(x["pages"], F.greatest(F.lit(0), s["start"] - WINDOW), s["start"]))
            after = F.lower(S.part(x["pages"], s["stop"], F.least(x["length"], s["stop"] + WINDOW)))
            prior, near = F.lit(0.0), F.lit(False)
            for kind in KINDS:
                prior = F.when(s["kind"] == kind, F.lit(PRIOR[kind])).otherwise(prior)
                near = F.when(s["kind"] == kind, before.rlike(rf"\b(?:{CONTEXT[kind]})") | after.rlike(rf"\b(?:{CONTEXT[kind]})")).otherwise(near)
            return F.struct(s.alias("span"), F.least(F.lit(1.0), prior + F.when(near, BOOST).otherwise(0.0)).alias("score"))

        return F.filter(F.transform(x["found"], one), lambda y: (y["span"]["kind"] != "ssn") | (y["score"] >= LEAST))

    return let(F.struct(F.array_sort(found).alias("found"), S.pages(text).alias("pages"), F.length(text).alias("length")), all_of)


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, text, and pii: array of (span (start, ord, stop, kind, value), score), in order of start."""
    rows = docs.select("doc_id", "text", find_all(F.col("text")).alias("found"))
    pii = F.when(F.size("found") > 0, scored(F.col("text"), F.col("found"))).otherwise(scored(F.lit(""), F.array().cast(S.SPAN)))
    return rows.select("doc_id", "text", pii.alias("pii"))


def redact(text: Column, found: Column) -> Column:
    """text with every span of found (sorted, as from detect) replaced by <kind>; overlapping spans become one."""

    def replaced(x: Column) -> Column:
        # a span that begins where all before it have ended stands for itself and those that overlap it
        opens = F.filter(F.transform(found, lambda s, i: F.struct(s["span"]["start"].alias("start"), s["span"]["kind"].alias("kind"), F.get(x["before"], i).alias("at"))), lambda s: s["start"] >= s["at"])
        kept = F.transform(opens, lambda s: F.concat(S.part(x["pages"], s["at"], s["start"]), F.lit("<"), s["kind"], F.lit(">")))
        end = F.array_max(F.transform(found, lambda s: s["span"]["stop"]))
        return F.concat(F.array_join(kept, ""), S.part(x["pages"], end, x["length"]))

    before = S.running_max(F.transform(found, lambda s: s["span"]["stop"]))
    parts = F.struct(before.alias("before"), S.pages(text).alias("pages"), F.length(text).alias("length"))
    return F.when(F.size(found) > 0, let(parts, replaced)).otherwise(text)


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, the digest of base spans, all spans, and their scores."""
    rows = detect(docs).withColumn("spans_", F.transform("pii", lambda x: x["span"]))
    base = F.filter("spans_", lambda s: s["ord"] <= 3)
    return rows.select(
        "doc_id",
        *[S.count(F.col("spans_"), k).alias(f"n_{k}") for k in KINDS[:4]],
        F.sha2(S.joined(base), 256).alias("base_sha256"),
        S.joined(F.col("spans_")).alias("spans"),
        F.array_join(F.transform("pii", lambda x: F.format_number(x["score"], 2)), ",").alias("scores"),
    )
