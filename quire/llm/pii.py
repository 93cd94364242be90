"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust scores.

Everything is built of DataFrame functions.  A pattern's matches and the pieces of text
between them come from two built-in functions; positions are running sums of their lengths,
taken in chunks so that a text with very many matches stays near linear.  Patterns are
written without backtracking (possessive, anchored to the start of a run), which changes no
match but keeps very long runs of one character linear.

Kinds: email, ip (parts up to 255), card (16 to 19 digits passing Luhn), phone (8 to 15
digits); the method adds iban (the country's length, mod-97) and ssn (number ranges), which
must reach SURE.  A score starts at the kind's prior, rises when a checksum confirms it, rises with words within
NEAR characters and falls with words that speak against it before.  Spans are in code points, ends exclusive.

Defined cases: a null text counts as empty and has no spans; a very long text is searched
whole; spans of different kinds may overlap and are all returned, equal rows get equal spans;
null ids and repeated rows pass through; an empty table gives an empty result; other columns
are left alone.
"""

from __future__ import annotations

from dataclasses import dataclass
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 256
NEAR = 40
SURE = 0.6
#: Characters of an account number by country; of others the longest that its checksum confirms is taken.
IBAN_SIZES = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
}


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _true(match: Column) -> Column:
    return F.lit(True)


def _ip(match: Column) -> Column:
    part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
    return match.rlike(rf"^{part}(?:\.{part}){{3}}$")


def luhn(digits: Column) -> Column:
    """Whether the Luhn sum of a string of digits ends in 0."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _card(match: Column) -> Column:
    digits = _digits(match)
    # The length first: the sum is taken of 19 digits at most.
    return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(F.lit(False))


def _phone(match: Column) -> Column:
    return F.length(_digits(match)).between(8, 15)


def mod97(compact: Column) -> Column:
    """Whether an account number without blanks leaves 1, moved by four and with letters as 10..35."""
    moved = F.concat(F.substr(compact, F.lit(5)), F.substr(compact, F.lit(1), F.lit(4)))

    def add(rest: Column, i: Column) -> Column:
        c = F.ascii(F.substr(moved, i, F.lit(1)))
        return F.when(c < 58, (rest * 10 + c - 48) % 97).otherwise((rest * 100 + c - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), add) == 1


def _iban(run: Column) -> Column:
    """How much of a run of groups is an account number that ends with a group; 0 if none is."""
    size = F.create_map(*(F.lit(x) for n, countries in IBAN_SIZES.items() for c in countries.split() for x in (c, n)))
    own = F.coalesce(F.try_element_at(size, F.left(run, F.lit(2))), F.lit(0))

    def add(state: Column, group: Column) -> Column:
        compact, end = F.concat(state["compact"], group), state["end"] + 1 + F.length(group)
        fits = F.when(own > 0, F.length(compact) == own).otherwise(F.length(compact).between(15, 34)) & ~compact.rlike("[a-z]")
        holds = F.when(fits, mod97(compact)).otherwise(F.lit(False))
        return F.struct(compact.alias("compact"), end.alias("end"), F.when(holds, end).otherwise(state["width"]).alias("width"))

    zero = F.struct(F.lit("").alias("compact"), F.lit(-1).alias("end"), F.lit(0).alias("width"))
    return F.aggregate(F.split(run, " "), zero, add, lambda state: state["width"])


def _ssn(match: Column) -> Column:
    return ~match.rlike("^(?:000|666|9)|-00-|-0000$")


@dataclass(frozen=True)
class Kind:
    """A pattern, a test of its matches, and the numbers of its score.

    With `head`, the pattern matches only so many characters and captures what follows them in
    a lookahead, so matches hide none of each other; `confirm` then gives a width, 0 for none.
    """

    name: str
    pattern: str
    confirm: Callable[[Column], Column]
    prior: float
    confirmed: float
    words: str
    against: str
    base: bool = True
    needs: str | None = None
    head: int = 0


KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", _true, 0.8, 0.0, "mail|contact|write", "example", needs="@"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", _ip, 0.4, 0.2, r"\bip\b|host|server|address|login", "version|release|section", needs="."),
    Kind("card", r"[0-9](?:[ -]?[0-9]){15,}+", _card, 0.3, 0.5, "card|visa|credit|payment", "order|tracking|serial"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", _phone, 0.5, 0.2, "phone|call|tel|mobile|fax", "version|total", needs="+"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=((?: ?[A-Z0-9]){11,30}+[A-Za-z0-9]?))", _iban, 0.3, 0.5, "iban|account|bank|konto|compte", "serial|product", base=False, head=4),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", _ssn, 0.2, 0.2, "ssn|social security|taxpayer", "order|part|serial", base=False, needs="-"),
)


def _found(kind: Kind, matches: str, pieces: str) -> Column:
    """array<struct<kind, start, end, score>> of one kind, in order of start."""
    def part(m: Column, i: Column) -> Column:
        width = [kind.confirm(m).alias("width")] if kind.head else []
        return F.struct(F.get(F.col(pieces), i).alias("before"), m.alias("match"), F.get(F.col(pieces), i + 1).alias("after"), *width)

    parts = F.transform(F.col(matches), part)
    none = "array<struct<kind:string,start:int,end:int,score:double>>"

    def step(state: Column, part: Column) -> Column:
        start = state["pos"] + F.length(part["before"])
        end = start + (part["width"] if kind.head else F.length(part["match"]))
        after = F.substr(part["after"], F.greatest(part["width"] - kind.head, F.lit(0)) + 1) if kind.head else part["after"]
        ahead = F.lower(F.right(part["before"], F.lit(NEAR)))
        near = F.concat(ahead, F.lit(" "), F.lower(F.left(after, F.lit(NEAR))))
        score = F.lit(kind.prior + kind.confirmed) + F.when(near.rlike(kind.words), 0.3).otherwise(0.0) - F.when(ahead.rlike(kind.against), 0.3).otherwise(0.0)
        score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 2)
        confirmed = part["width"] > 0 if kind.head else kind.confirm(part["match"])
        holds = confirmed if kind.base else confirmed & (score >= SURE)
        span = F.array(F.struct(F.lit(kind.name).alias("kind"), start.alias("start"), end.alias("end"), score.alias("score")))
        pos = start + kind.head if kind.head else end
        return F.struct(pos.alias("pos"), F.when(holds, F.concat(state["out"], span)).otherwise(state["out"]).alias("out"))

    def chunk(done: Column, begin: Column) -> Column:
        zero = F.struct(F.coalesce(F.try_element_at(done, F.lit(-1))["pos"], F.lit(0)).alias("pos"), F.array().cast(none).alias("out"))
        return F.concat(done, F.array(F.aggregate(F.slice(F.col(f"{matches}_parts"), begin + 1, F.lit(CHUNK)), zero, step)))

    chunks = F.aggregate(F.sequence(F.lit(0), F.size(F.col(f"{matches}_parts")) - 1, F.lit(CHUNK)), F.array().cast(f"array<struct<pos:int,out:{none}>>"), chunk)
    return parts, F.when(F.size(F.col(f"{matches}_parts")) > 0, F.flatten(F.transform(chunks, lambda c: c["out"]))).otherwise(F.array().cast(none))


def find(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text, pii): `row` is a struct of all columns of `docs`, `pii` the array of
    all spans by kind, then start."""
    docs = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id", F.col("text").cast("string").alias("text"))
    text = F.coalesce(F.col("text"), F.lit(""))
    names = {k.name: f"_pii_{k.name}" for k in KINDS}
    empty = F.array().cast("array<string>")

    def matches(k: Kind) -> Column:
        every = F.regexp_extract_all(text, F.lit(k.pattern), F.lit(0))
        if k.head:
            every = F.zip_with(every, F.regexp_extract_all(text, F.lit(k.pattern), F.lit(1)), lambda head, rest: F.concat(head, rest))
        return F.when(F.contains(text, F.lit(k.needs)), every).otherwise(empty) if k.needs else every

    df = docs.withColumns({names[k.name]: matches(k) for k in KINDS})
    df = df.withColumns({f"{names[k.name]}_pieces": F.when(F.size(names[k.name]) > 0, F.split(text, k.pattern, -1)).otherwise(empty) for k in KINDS})
    made = {k.name: _found(k, names[k.name], f"{names[k.name]}_pieces") for k in KINDS}
    df = df.withColumns({f"{names[k]}_parts": parts for k, (parts, _) in made.items()})
    df = df.withColumn("pii", F.concat(*(spans for _, spans in made.values())))
    return df.drop(*(f"{n}{tail}" for n in names.values() for tail in ("", "_pieces", "_parts")))


def _is(name: str) -> Callable[[Column], Column]:
    return lambda kind: kind == name


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts by kind, the digest of the base spans, and all spans and their scores as text."""
    base = [k.name for k in KINDS if k.base]
    count = {f"n_{k.name}": F.size(F.filter(F.col("pii")["kind"], _is(k.name))).cast("long") for k in KINDS}
    return found.select("doc_id", *(c.alias(n) for n, c in count.items()), F.sha2(_joined(F.filter("pii", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"), _joined(F.col("pii")).alias("spans"), F.array_join(F.transform("pii", lambda s: s["score"].cast("string")), ",").alias("scores"))


def redact(docs: DataFrame) -> DataFrame:
    """`docs` with every span, or run of overlapping spans, replaced by its first kind in brackets.

    Null texts stay null; `n_chars`, where there is such a column, is counted anew.
    """

    def step(state: Column, s: Column) -> Column:
        gap = F.array(F.substring(F.col("text"), state["pos"] + 1, s["start"] - state["pos"]), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        return F.struct(F.greatest(state["pos"], s["end"]).alias("pos"), F.when(s["start"] >= state["pos"], F.concat(state["out"], gap)).otherwise(state["out"]).alias("out"))

    ordered = F.array_sort(F.transform("pii", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("_end"), s["end"].alias("end"), s["kind"].alias("kind"))))
    zero = F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("out"))
    rebuilt = F.aggregate(ordered, zero, step, lambda state: F.concat(F.array_join(state["out"], ""), F.substr(F.col("text"), state["pos"] + 1)))
    df = find(docs).withColumn("text", F.when(F.size("pii") > 0, rebuilt).otherwise(F.col("text")))

    def column(name: str) -> Column:
        if name == "text":
            return F.col("text")
        own = F.col("row").getField(name)
        return (F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema[name].dataType)) if name == "n_chars" else own).alias(name)

    return df.select(*map(column, docs.columns))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
