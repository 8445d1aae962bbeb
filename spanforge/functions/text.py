"""Column expressions over token and prompt texts. All are built-in expressions, so Catalyst can fold, prune and compile them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of the token classes (RE2 and Java spell them alike but for Han).
WS = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
DIGIT = (
    r"\p{Nd}\x{b2}\x{b3}\x{b9}\x{1369}-\x{1371}\x{19da}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}\x{2460}-\x{2468}\x{2474}-\x{247c}"
    r"\x{2488}-\x{2490}\x{24ea}\x{24f5}-\x{24fd}\x{24ff}\x{2776}-\x{277e}\x{2780}-\x{2788}\x{278a}-\x{2792}\x{10a40}-\x{10a43}"
    r"\x{10e60}-\x{10e68}\x{11052}-\x{1105a}\x{1f100}-\x{1f10a}"
)
KEYWORDS = "def class import from return if else for while var let const function async await try catch fn pub impl struct enum match".split()
CJK = r"[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{20000}-\x{2a6df}\x{2a700}-\x{2b73f}\x{f900}-\x{faff}\x{2f800}-\x{2fa1f}]"
STRIP = rf"\A{WS}+|{WS}+\z"
#: What WS holds, as a string.
WS_CHARS = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
EMOJI = r"\A(?:\p{So}|\p{Sk}|[\x{1f301}-\x{10ffff}])+\z"
URL = r"\A(?:https?://|ftp://|mailto:|/[a-zA-Z]|\.\.?/|[a-zA-Z]:\\)"
JSON = r'\A(?:["{}\[\]:,]|true|false|null)'
CODE = r"\A(?:[(){}\[\];:=<>+\-*/&|!~^%@#\\]|(?:" + "|".join(KEYWORDS) + r") )"
NUMBER = rf"\A[.,+\-eExX{DIGIT}]*[{DIGIT}][.,+\-eExX{DIGIT}]*\z"
PUNCTUATION = r"\A\p{P}+\z"

EMPTY_TOKEN = "<EMPTY>"


def char_length(text: Column) -> Column:
    return F.char_length(text).cast("bigint")


def byte_length(text: Column) -> Column:
    return F.octet_length(text).cast("bigint")


def strip(text: Column) -> Column:
    """Without leading and trailing white space, by the wide definition of white space."""
    return F.trim(text, F.lit(WS_CHARS))


def classify(text: Column) -> Column:
    """One of 13 token types; the first rule that holds decides."""
    s = strip(text)
    is_ = lambda c, p: c.rlike(p)
    return (
        F.when(text == "", "empty")
        .when(is_(text, r"\A[\n\r]"), "newline_prefixed")
        .when(is_(text, r"\A[ \t]"), "whitespace_prefixed")
        .when(s == "", "empty")
        .when(is_(s, EMOJI), "emoji_symbol")
        .when(is_(s, URL), "url_like")
        .when(is_(s, JSON), "json_like")
        .when(is_(s, CODE), "code_like")
        .when(is_(s, NUMBER), "digit")
        .when(is_(s, PUNCTUATION), "punctuation")
        .when(is_(s, CJK) & is_(s, "[A-Za-z]"), "mixed_script")
        .when(is_(s, CJK), "cjk")
        .when(is_(s, "[A-Za-z]"), "latin")
        .otherwise("other")
    )


def strict_type(token_type: Column, text: Column) -> Column:
    """A recorded type; where that is "other", what the text's prefix tells."""
    return (
        F.when((token_type != "other") & (token_type != ""), token_type)
        .when(text == "", "empty")
        .when(F.startswith(text, F.lit("\n")), "newline_prefixed")
        .when(F.startswith(text, F.lit(" ")), "whitespace_prefixed")
        .otherwise(F.coalesce(F.nullif(token_type, F.lit("")), F.lit("other")))
    )


def soft_type(token_type: Column) -> Column:
    return F.coalesce(F.nullif(token_type, F.lit("")), F.lit("other"))


def signature(text: Column, token_type: Column) -> Column:
    """The six fields that two outputs must share to agree at the boundary."""
    return F.struct(
        char_length(text).alias("chars"), byte_length(text).alias("bytes"), F.startswith(text, F.lit(" ")).alias("space"),
        F.startswith(text, F.lit("\n")).alias("newline"), token_type.alias("type"), (text == "").alias("empty"),
    )


def without_leading_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\A[\r\n]+", "")


def vocab_token(text: Column, stripped: bool = False) -> Column:
    t = strip(text) if stripped else text
    return F.when(t == "", EMPTY_TOKEN).otherwise(t)


def truncate(text: Column, ratio: Column) -> Column:
    """The first part of a text, one character at least."""
    return F.substring(text, F.lit(1), F.greatest(F.lit(1), F.floor(F.char_length(text) * ratio).cast("int")))


def stable_id(category: Column, text: Column) -> Column:
    return F.concat(category, F.lit("_"), F.substring(F.sha1(F.concat(category, F.lit("\0"), text).cast("binary")), 1, 12))


def language_of(probe_id: Column) -> Column:
    return F.when(F.contains(probe_id, F.lit("_partial_")), F.substring_index(probe_id, "_partial_", 1)).otherwise("unknown")


def slugify(text: Column, default: str = "family") -> Column:
    s = F.trim(F.regexp_replace(F.lower(text), "[^A-Za-z0-9]+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(s, F.lit("")), F.lit(default))


def sanitize_model_name(name: Column) -> Column:
    return F.translate(name, "/:", "__")


def directory_name(model_id: Column) -> Column:
    """A model's name as a folder of downloaded files."""
    return F.replace(model_id, F.lit("/"), F.lit("__"))


def canonical_hash(values: Column) -> Column:
    """SHA-256 of a map as JSON with sorted keys: equal maps have equal hashes."""
    return F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(values)))), 256)


def text_of(value: Column, fallback: Column) -> Column:
    """A value that may be written as an object with a `value`, or as plain text, or not be there."""
    inner = F.get_json_object(value, "$.value")
    return F.coalesce(inner, value, fallback)


def script_class(script: str) -> str:
    """A script's characters, as what stands inside a class. Looking a script up is slow, so ASCII is told first, and for Latin its
    letters up to U+02B8."""
    if script == "Latin":
        return r"a-zA-Z[\x{aa}-\x{10ffff}&&[\x{aa}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{2b8}\p{IsLatin}]]"
    return rf"[\x{{80}}-\x{{10ffff}}&&\p{{Is{script}}}]"


def script_count(text: Column, script: str) -> Column:
    """Characters of a script (Latin, Arabic, Han)."""
    return (F.char_length(text) - F.char_length(F.regexp_replace(text, rf"[{script_class(script)}]+", ""))).cast("bigint")


def json_string(text: Column) -> Column:
    """The text as a JSON string literal."""
    whole = F.to_json(F.array(text))
    return F.substring(whole, F.lit(2), F.char_length(whole) - 2)


def share_text(x: Column) -> Column:
    return F.format_string("%.8f", x)
