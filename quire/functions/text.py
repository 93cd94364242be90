"""Column functions over text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as blank: Unicode white space and the four information separators.
BLANK = r"[\s\x1c-\x1f]"
#: The same, sign by sign: what trimming takes (a test holds the two together).
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: Line ends, the two-character one first.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def strip(text: Column) -> Column:
    """Without blanks at either end, of any alphabet."""
    return F.btrim(text, F.lit(BLANKS))


def split_lines(text: Column) -> Column:
    """Lines without their ends; a text that ends in a line end has no empty line after it."""
    parts = F.split(text, LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def drop_byte_order_marks(text: Column) -> Column:
    return F.regexp_replace(text, "^﻿+", "")


# Code point ranges of readable text.
_HANGUL = "가-힣"
_PRINTABLE = " -~"


def looks_like_text(text: Column, least: float = 0.2) -> Column:
    """Whether Hangul syllables and printable ASCII make up a share of `least`; an empty text does not."""
    good = F.regexp_count(text, F.lit(f"[{_HANGUL}{_PRINTABLE}]"))
    return F.when(F.length(text) == 0, False).otherwise(good / F.length(text) >= least)


def drop_noise_tokens(text: Column, longest: int = 6) -> Column:
    """Drops short tokens without any Hangul or printable ASCII, line by line; blanks between tokens stay."""

    def line(value: Column) -> Column:
        keep = lambda t: (t == "") | t.rlike(f"[{_HANGUL}{_PRINTABLE}]") | (F.length(t) > longest)
        return F.array_join(F.filter(F.split(value, " ", -1), keep), " ")

    return F.array_join(F.transform(F.split(text, "\n", -1), line), "\n")


def clean_controls(text: Column) -> Column:
    """Line feeds and carriage returns each become a line end, other controls blanks; noise goes; blanks collapse."""
    plain = F.regexp_replace(F.regexp_replace(text, "[\n\r]", "\n"), r"[\x00-\x09\x0b\x0c\x0e-\x1f]", " ")
    return F.regexp_replace(drop_noise_tokens(plain), " {2,}", " ")


def truncate(text: Column, most: int, notice: str = "\n\n[... 이하 {} 문자 생략]") -> Column:
    """The first `most` characters and a notice that tells how many are left out."""
    before, _, after = notice.partition("{}")
    cut = F.concat(F.substring(text, 1, most), F.lit(before), F.format_number(F.length(text) - most, 0), F.lit(after))
    return F.when(F.length(text) > most, cut).otherwise(text)


def safe_int(text: Column) -> Column:
    """A whole number from text with thousands separators or decimals; 0 if there is none."""
    value = F.regexp_replace(text, ",", "").try_cast("double")
    fine = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < 9.2e18)
    return F.when(fine, F.when(value < 0, F.ceil(value)).otherwise(F.floor(value))).otherwise(F.lit(0)).cast("long")


def semver(text: Column) -> Column:
    """Three numbers of a version; what follows a hyphen is left out, missing ones are 0."""
    core = F.split_part(F.regexp_replace(strip(F.coalesce(text, F.lit(""))), "^v+", ""), F.lit("-"), F.lit(1))
    found = F.transform(F.regexp_extract_all(core, F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("int"))
    return F.slice(F.concat(found, F.array(F.lit(0), F.lit(0), F.lit(0))), 1, 3)


def url_file_name(url: Column, default: Column) -> Column:
    """The decoded last part of a URL's path, made safe as a file name."""
    name = F.try_url_decode(F.regexp_replace(F.element_at(F.split(F.parse_url(url, F.lit("PATH")), "/", -1), -1), r"\+", "%2B"))
    safe = safe_file_name(name)
    return F.when(F.coalesce(safe, F.lit("")) == "", default).otherwise(safe)


def safe_file_name(name: Column) -> Column:
    return strip(F.regexp_replace(name, r'[<>:"/\\|?*\x00-\x1f]', "_"))


def circled_number(n: Column) -> Column:
    """The circled digit of 1 to 20, else the number in brackets."""
    marks = F.array(*(F.lit(chr(0x2460 + i)) for i in range(20)))
    return F.when(n.between(1, 20), F.get(marks, (n - 1).cast("int"))).otherwise(F.concat(F.lit("("), n, F.lit(")")))


def tier_rank(tier: Column, tiers: Sequence[str] = ("free", "pro", "team")) -> Column:
    """The place of a tier in an order, 0 if it is unknown."""
    known = F.array_position(F.array(*map(F.lit, tiers)), F.lower(tier))
    return F.greatest(F.coalesce(known, F.lit(0)) - 1, F.lit(0)).cast("int")


def token_tier(token: Column, paid: Sequence[str] = ("pro", "team"), default: str = "free") -> Column:
    """The paid tier that a signed token's middle part claims, else the default."""
    body = F.translate(F.split_part(token, F.lit("."), F.lit(2)), "-_", "+/")
    padded = F.rpad(body, ((F.length(body) + 3) / 4).cast("int") * 4, F.lit("="))
    claims = F.try_to_binary(padded, F.lit("base64")).cast("string")
    tier = F.coalesce(F.get_json_object(claims, "$.tier"), F.get_json_object(claims, "$.custom_claims.tier"))
    return F.when((F.size(F.split(token, r"\.", -1)) == 3) & tier.isin(*paid), tier).otherwise(F.lit(default))


def escape_html(text: Column) -> Column:
    """The five special characters as entities, tabs as four blanks that stay."""
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return F.replace(text, F.lit("\t"), F.lit("&nbsp;" * 4))


def mask_email(text: Column) -> Column:
    """Addresses keep the first letter of the user and the domain (the pattern is a fixed value)."""
    return F.regexp_replace(text, r"([A-Za-z0-9._+-])[A-Za-z0-9._+-]*@([A-Za-z0-9.-]+)", "$1***@$2")


# Patterns of secrets, in the order in which they are replaced.
SECRETS = (
    r"sk-(?:ant-|proj-)?[A-Za-z0-9_\-]{20,}",
    r"AIza[A-Za-z0-9_\-]{30,}",
    r"ghp_[A-Za-z0-9]{30,}",
    r"gho_[A-Za-z0-9]{30,}",
    r"xox[baprs]-[A-Za-z0-9\-]{10,}",
    r"(?i)Bearer\s+[A-Za-z0-9._\-]{20,}",
)


def redact_secrets(text: Column) -> Column:
    for pattern in SECRETS:
        text = F.regexp_replace(text, pattern, "<REDACTED>")
    return text


def filter_sensitive(env: Column) -> Column:
    """A map whose values are hidden where the key speaks of a key, token, password or secret."""
    return F.transform_values(env, lambda k, v: F.when(F.lower(k).rlike("key|token|password|secret"), F.lit("[Filtered]")).otherwise(v))


def slug(text: Column, most: int = 40) -> Column:
    kept = strip(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^A-Za-z0-9가-힯_\- ]", ""))
    return F.substring(F.regexp_replace(kept, r"\s+", "_"), 1, most)


def topic(text: Column, most: int = 80, default: str = "Session memory") -> Column:
    """The first line without marks at its start."""
    first = F.get(split_lines(strip(F.coalesce(text, F.lit("")))), 0)
    bare = F.substring(strip(F.regexp_replace(first, r"(?U)^[#*\->\s`]+", "")), 1, most)
    return F.coalesce(F.nullif(bare, F.lit("")), F.lit(default))
