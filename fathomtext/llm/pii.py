"""Personal data in texts, with DataFrame functions only.

Regular expressions propose spans, checksums confirm them (Luhn for card numbers, mod 97 for
international bank account numbers), and words near a span raise its score.

Spans need positions, which Spark's regular-expression functions do not give. A text is therefore
split at the matches and the matches are extracted; the lengths of the pieces add up to the
positions. The expressions are written so that the engine reads each character a bounded number of
times: runs are possessive, and look-behinds keep it from starting inside a run that has failed. A
few separators are first replaced one for one (positions stay), so that no group has to be repeated
and texts of any length need no stack.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import let, table, texts

#: Order of kinds at equal starts; those after phone are added by this method.
KINDS = ("email", "ip", "card", "phone", "iban")
#: A dot that no domain character follows becomes "%", which only a mailbox may hold.
LONE_DOT = r"\.(?![A-Za-z0-9-])"
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@(?=[A-Za-z0-9-]++\.)[A-Za-z0-9-][A-Za-z0-9.-]*+"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
OCTET = r"0*(?:[0-9]|[1-9][0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: A separator that does not stand between two digits becomes a line feed.
LONE_SEPARATOR = r"[\x20-](?![0-9])|(?<![0-9])[\x20-]"
CARD = r"[0-9][0-9\x20-]++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])"
#: Characters before and after a span in which context words are looked for; length of the pieces looked at.
REACH, PIECE = 40, 256
#: Positions that are summed up in one go.
BLOCK = 128
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|reach)\b",
    "ip": r"(?i)\b(?:ip|address|host|server|client)\b",
    "card": r"(?i)\b(?:card|credit|debit|visa|mastercard|payment)\b",
    "phone": r"(?i)\b(?:phone|tel|call|mobile|fax)\b",
    "iban": r"(?i)\b(?:iban|bank|account|transfer)\b",
}
BASE_SCORE = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.9}
BONUS = 0.2

SPAN = "array<struct<start:int,kind:int,end:int,match:string>>"


def running(sizes: Column, size: Callable[[Column], Column]) -> Column:
    """The running sum of a non-empty array, block by block: no array of all sums is copied for each element."""
    none = F.array().cast("array<int>")

    def sums(part: Column, of: Callable[[Column], Column]) -> Column:
        start = F.struct(F.lit(0).alias("at"), none.alias("out"))
        return F.aggregate(part, start, lambda a, x: F.struct((a["at"] + of(x)).alias("at"), F.concat(a["out"], F.array(a["at"] + of(x))).alias("out")), lambda a: a["out"])

    cut = F.transform(F.sequence(F.lit(1), F.size(sizes), F.lit(BLOCK)), lambda i: sums(F.slice(sizes, i, F.lit(BLOCK)), size))
    return let(cut, lambda blocks: F.flatten(F.zip_with(blocks, sums(blocks, lambda b: F.element_at(b, -1)), lambda b, to: F.transform(b, lambda x: x + to - F.element_at(b, -1)))))


def found(text: Column, pattern: str, kind: int) -> Column:
    """All matches with their positions in code points."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.split(text, pattern, -1)
    sizes = F.filter(F.zip_with(parts, hits, lambda p, m: F.struct(F.length(p).alias("gap"), F.length(m).alias("size"), m.alias("match"))), lambda x: x["match"].isNotNull())
    place = lambda x, end: F.struct((end - x["size"]).alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["match"].alias("match"))
    walked = let(sizes, lambda z: F.when(F.size(z) > 0, F.zip_with(z, running(z, lambda x: x["gap"] + x["size"]), place)))
    return F.coalesce(walked.cast(SPAN), F.array().cast(SPAN))


def only_digits(match: Column) -> Column:
    return F.regexp_replace(match, r"[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Every second digit from the right counts double, less 9 if over 9; the sum ends in 0."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def mod97(match: Column) -> Column:
    """The first four characters go to the end, letters count 10 to 35; the number leaves 1."""
    moved = F.concat(F.substring(match, 5, 1000), F.substring(match, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("string")).otherwise((F.ascii(c) - 55).cast("string"))
    step = lambda a, c: (a * F.when(F.length(value(c)) == 2, 100).otherwise(10) + F.coalesce(F.try_to_number(value(c), F.lit("99")).cast("int"), F.lit(0))) % 97
    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), step) == 1


def spans_of(text: Column) -> Column:
    """The confirmed spans of a text, by start and then by kind."""
    digits = lambda s: only_digits(s["match"])
    has = lambda pattern, column: F.when(text.rlike(pattern), column).otherwise(F.array().cast(SPAN))
    email = has("@", found(F.regexp_replace(text, LONE_DOT, "%"), EMAIL, 0))
    ip = has(r"[0-9]\.[0-9]", F.filter(found(text, IP, 1), lambda s: s["match"].rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")))
    card = has("[0-9]", F.filter(found(F.regexp_replace(text, LONE_SEPARATOR, "\n"), CARD, 2), lambda s: F.length(digits(s)).between(14, 19) & luhn(digits(s))))
    phone = has(r"\+[0-9]", F.filter(found(text, PHONE, 3), lambda s: F.length(digits(s)).between(10, 15)))
    iban = has("[A-Z]{2}[0-9]{2}[A-Z0-9]{11}", F.filter(found(text, IBAN, 4), lambda s: mod97(s["match"])))
    return F.array_sort(F.concat(email, ip, card, phone, iban))


def by_kind(kind: Column, values: dict) -> Column:
    out = F.lit(None)
    for i, k in enumerate(KINDS):
        out = F.when(kind == i, F.lit(values[k])).otherwise(out)
    return out


def pii(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, text and spans (kind, start, end, score), by start and kind.

    Positions are code points, the end exclusive. Null texts count as empty and have no spans.
    Rows stay as they are, repeated ones and ones without an id too; other columns are ignored.
    A context word within 40 characters of a span adds 0.2 to its score, up to 1; no span is
    dropped for its score, so callers set their own threshold.
    """
    raw = texts(docs).withColumn("raw", spans_of(F.col("text")))

    def scored(s: Column, pieces: Column) -> Column:
        piece = lambda k: F.coalesce(F.get(pieces, k), F.lit(""))
        first = F.floor(F.greatest(F.lit(0), s["start"] - REACH) / PIECE).cast("int")
        last = F.floor(s["end"] / PIECE).cast("int")
        before = F.substring(F.concat(piece(first), piece(first + 1)), F.greatest(F.lit(0), s["start"] - REACH) - first * PIECE + 1, F.least(s["start"], F.lit(REACH)))
        after = F.substring(F.concat(piece(last), piece(last + 1)), s["end"] - last * PIECE + 1, F.lit(REACH))
        near = F.concat(before, F.lit(" "), after)
        hint = F.lit(False)
        for i, k in enumerate(KINDS):
            hint = F.when(s["kind"] == i, near.rlike(CONTEXT[k])).otherwise(hint)
        name = by_kind(s["kind"], {k: k for k in KINDS})
        score = by_kind(s["kind"], BASE_SCORE) + F.when(hint, BONUS).otherwise(0.0)
        return F.struct(name.alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.least(F.lit(1.0), score).alias("score"))

    # the text in pieces of fixed length: a span looks at two of them, not at all that stands before it
    pieces = F.when(F.size("raw") > 0, F.regexp_extract_all("text", F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0)))
    return raw.select("doc_id", "text", let(pieces, lambda p: F.transform("raw", lambda s: scored(s, p))).alias("spans"))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS[:4]))
    return out.select("doc_id", *(count(k) for k in KINDS[:4]), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), F.array_max(F.transform("spans", lambda s: s["score"])).alias("top_score"))
