"""Personal data: regular expressions propose spans, checksums confirm them, context words move the score.
DataFrame functions only.

The places of a pattern's matches come from the text cut at the matches and the matches themselves: their
lengths, added up, are the offsets, and their last characters, carried on, the context. They are added up by chunks
of CHUNK matches and within each, so that a text with very many is no loop over copies of a growing array.
Base kinds (email, ip, card, phone) are decided by their contract alone and are always kept. The method adds ibans (mod 97);
where a word nearby names them, phone numbers without a country code and social security numbers; and secrets: access
keys and tokens of known forms, and values with letters and digits that are assigned to a password, token or key.
A score is the kind's own, and more with a confirmed checksum, or a context word before the span; added spans need
THRESHOLD. Added spans of different kinds may overlap each other, and are listed each.

A null text counts as empty: nothing found; a null id is passed on; each row of repeated ids gives its own
row; an empty table gives no rows; columns besides the two named are not looked at. Patterns are written so
that no text makes them go back and forth or nest calls: repeated groups are possessive, and a run of
characters that a match can start in is entered at its begin or where the last match ended.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTEXT = 40  # characters before a span that are searched for context words
THRESHOLD = 0.6
CHUNK = 64


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    trigger: str  # found wherever a valid span is
    score: float
    words: str  # context
    base: bool


def _begin(characters: str) -> str:
    return rf"(?:\G|(?<![{characters}]))"


_LOCAL = "A-Za-z0-9._%+-"
_NAMED = "password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|secret[_-]?key"
KINDS = [
    Kind("email", rf"{_begin(_LOCAL)}[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@[A-Za-z0-9-]", 0.9, "mail|contact|write", True),
    Kind("ip", rf"{_begin('0-9')}[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)", r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", 0.7, "ip|host|server|address", True),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){11}", 0.5, "card|visa|credit|payment", True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", 0.7, "phone|call|tel|mobile|fax", True),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "[A-Z]{2}[0-9]{2}", 0.3, "iban|bank|account", False),
    Kind("local_phone", r"(?<![+0-9A-Za-z.-])(?<!\+[0-9] )(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])", r"[0-9]{3}[\x20.-][0-9]{4}", 0.4, "phone|call|tel|mobile|fax", False),
    Kind("access_key", r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])", "A[KS]IA[0-9A-Z]{16}", 0.9, "key|aws", False),
    Kind("token", r"(?<![A-Za-z0-9])(?:gh[pousr]_[A-Za-z0-9]{36,255}+|xox[abprs]-[A-Za-z0-9-]{10,255}+|sk-[A-Za-z0-9_-]{20,255}+|eyJ[A-Za-z0-9_-]{10,2000}+\.[A-Za-z0-9_-]{10,2000}+\.[A-Za-z0-9_-]{10,2000}+)", "gh[pousr]_[A-Za-z0-9]|xox[abprs]-|sk-[A-Za-z0-9]|eyJ[A-Za-z0-9]", 0.8, "token|key|bearer", False),
    Kind("secret", rf"(?<=(?i:{_NAMED})[\"']?[\x20\t]{{0,4}}[:=][\x20\t]{{0,4}}[\"']?)(?<![A-Za-z0-9])[A-Za-z0-9+/_.!#$%&*@^~-]{{8,4096}}+", rf"(?i:{_NAMED})[\"']?[\x20\t]{{0,4}}[:=]", 0.7, "password|secret|token|key", False),
    Kind("ssn", r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])", "[0-9]-[0-9]{2}-[0-9]{4}", 0.4, "ssn|social security", False),
]
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(x: Column) -> Column:
    """Whether a string of digits passes: from the right, every second one doubled, less 9 if over 9."""

    def term(i: Column) -> Column:
        d = F.substring(F.reverse(x), i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 1, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), F.length(x)), F.lit(0), lambda total, i: total + term(i)) % 10 == 0


def mod97(x: Column) -> Column:
    """Whether an account number, its first four characters moved to the end, leaves 1 (A is 10, Z 35)."""
    bare = F.replace(x, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.substring(bare, 1, 4))

    def step(rest: Column, i: Column) -> Column:
        code = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97).cast("int")

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def confirmed(kind: str, x: Column) -> Column:
    """Whether the match is valid."""
    n = F.length(digits(x))
    if kind == "ip":
        return x.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    if kind == "card":
        return F.when((n >= 12) & (n <= 19), luhn(digits(x))).otherwise(False)
    if kind == "phone":
        return (n >= 9) & (n <= 15)
    if kind == "iban":
        return F.when(F.length(F.replace(x, F.lit(" "), F.lit(""))).between(15, 34), mod97(x)).otherwise(False)
    if kind == "secret":
        return x.rlike("[0-9]") & x.rlike("[A-Za-z]")
    if kind == "ssn":
        return ~x.rlike("^(?:000|666|9)|-00-|0000$")
    return F.lit(True)


SPAN = "struct<at:long,rank:int,kind:string,start:long,end:long,score:double>"


def let(x: Column, of) -> Column:
    """of(x), with x evaluated once."""
    return F.get(F.transform(F.array(x), of), F.lit(0))


def spans_of(rank: int, kind: Kind, text: Column) -> Column:
    """Valid spans of a kind; an empty array where the trigger isn't found."""
    pieces, matches = F.split(text, kind.pattern, -1), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    none = F.array().cast(f"array<{SPAN}>")
    match = lambda x: F.coalesce(x["match"], F.lit(""))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["piece"])
        end = start + F.length(match(x))
        before = F.right(F.concat(acc["before"], x["piece"]), F.lit(CONTEXT))
        near = F.lower(before).rlike(f"(?:{kind.words})")
        checked = 0.4 if kind.name in ("card", "iban") else 0.0
        score = F.lit(kind.score + checked) + F.when(near, 0.3).otherwise(0.0)
        # The score is a property of a valid span; base spans need none.
        span = F.struct(start.alias("at"), F.lit(rank).alias("rank"), F.lit(kind.name).alias("kind"), start.alias("start"), end.alias("end"), F.least(F.lit(1.0), F.round(score, 2)).alias("score")).cast(SPAN)
        good = x["match"].isNotNull() & confirmed(kind.name, x["match"])
        if not kind.base:
            good = good & (score >= THRESHOLD)
        return F.struct(end.cast("long").alias("at"), F.when(good, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"), F.right(F.concat(before, match(x)), F.lit(CONTEXT)).alias("before"))

    def within(chunk: Column, at: Column, before: Column) -> Column:
        return F.aggregate(chunk, F.struct(at.alias("at"), none.alias("out"), before.alias("before")), step, lambda acc: acc["out"])

    def by_chunks(both: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(both) - 1) / CHUNK).cast("int")), lambda k: F.slice(both, k * CHUNK + 1, CHUNK))
        told = F.transform(chunks, lambda c: let(F.array_join(F.transform(c, lambda x: F.concat(x["piece"], match(x))), ""), lambda t: F.struct(c.alias("c"), F.length(t).cast("long").alias("n"), F.right(t, F.lit(CONTEXT)).alias("tail"))))
        begin = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("before"))
        begins = lambda t: F.aggregate(
            t, F.struct(begin.alias("now"), F.array().cast("array<struct<at:long,before:string>>").alias("out")),
            lambda acc, c: F.struct(F.struct((acc["now"]["at"] + c["n"]).alias("at"), F.right(F.concat(acc["now"]["before"], c["tail"]), F.lit(CONTEXT)).alias("before")).alias("now"), F.concat(acc["out"], F.array(acc["now"])).alias("out")),
            lambda acc: acc["out"],
        )
        return let(told, lambda t: F.flatten(F.zip_with(t, begins(t), lambda c, b: within(c["c"], b["at"], b["before"]))))

    found = let(F.arrays_zip(pieces.alias("piece"), matches.alias("match")), lambda both: F.when(F.size(both) > CHUNK, by_chunks(both)).otherwise(within(both, F.lit(0).cast("long"), F.lit(""))))
    return F.when(text.rlike(kind.trigger), found).otherwise(none)


def find_pii(docs: DataFrame, kinds: list[Kind] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id and spans, an array of (kind, start, end, score) in code points, end
    exclusive, by start and then kind as listed. Added spans do not overlap base spans."""
    kinds = KINDS if kinds is None else kinds
    text = F.col("text")
    named = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    # Nothing is searched in a text without a digit or an @, as most are.
    some = text.rlike("[0-9@]")
    base = F.concat(*[spans_of(i, k, text) for i, k in enumerate(kinds) if k.base])
    more = [spans_of(i, k, text) for i, k in enumerate(kinds) if not k.base]
    none = F.array().cast(f"array<{SPAN}>")
    cut = named.select("id", F.when(some, base).otherwise(none).alias("base"), F.when(some, F.concat(*more) if more else none).otherwise(none).alias("more"))
    added = F.filter("more", lambda x: ~F.exists("base", lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"])))
    return cut.select(F.col("id").alias(id_col), F.array_sort(F.concat("base", added)).alias("spans"))


def digest(docs: DataFrame, **how) -> DataFrame:
    """One row per document: id, n_email, n_ip, n_card, n_phone, base_sha256 (of the base spans as
    kind:start:end, comma-joined) and spans (all spans, joined likewise)."""
    found, base = find_pii(docs, **how), [k.name for k in KINDS if k.base]
    name = [c for c in found.columns if c != "spans"][0]
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    own = F.filter("spans", lambda x: x["kind"].isin(base))
    return found.select(name, *map(_count, base), F.sha2(joined(own), 256).alias("base_sha256"), joined("spans").alias("spans"))


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
