import unicodedata

import pytest
from pyspark.sql import functions as F

from spanforge.functions import text as T

CASES = {
    "": "empty", "\nx": "newline_prefixed", "\rx": "newline_prefixed", " the": "whitespace_prefixed", "\tx": "whitespace_prefixed", "　": "empty", "你好": "cjk", "the": "latin", "123": "digit", "²": "digit",
    "+1": "code_like", "，": "punctuation", "...": "punctuation", "./a": "url_like", "https://x": "url_like", "{": "json_like", ":": "json_like", "true": "json_like", "(": "code_like", "def": "latin", "def x": "code_like",
    "你a": "mixed_script", "😀": "emoji_symbol", "^": "emoji_symbol", "`": "emoji_symbol", "𠀀": "emoji_symbol", "é": "other", "Привет": "other", "ab你": "mixed_script",
}


def test_classes(spark):
    df = spark.createDataFrame(list(CASES.items()), "t string, want string").withColumn("got", T.classify(F.col("t")))
    assert [r for r in df.collect() if r.got != r.want] == []


def test_lengths_and_signature(spark):
    r = spark.createDataFrame([("😀é",)], "t string").select(T.char_length(F.col("t")).alias("c"), T.byte_length(F.col("t")).alias("b"), T.signature(F.col("t"), F.lit("x")).alias("s")).first()
    assert (r.c, r.b) == (2, 6) and tuple(r.s) == (2, 6, False, False, "x", False)


def test_types_that_are_filled_in(spark):
    df = spark.createDataFrame([("other", ""), ("other", "\nx"), ("other", " x"), ("other", "x"), ("latin", ""), ("", "x")], "k string, t string")
    got = df.select(T.strict_type(F.col("k"), F.col("t")).alias("a"), T.soft_type(F.col("k")).alias("b")).collect()
    assert [r.a for r in got] == ["empty", "newline_prefixed", "whitespace_prefixed", "other", "latin", "other"]
    assert [r.b for r in got] == ["other"] * 4 + ["latin", "other"]


@pytest.mark.parametrize("raw,want", [("Some Name 3", "some_name_3"), ("__a--b!!", "a_b"), ("", "family"), ("!!", "family")])
def test_slugify(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "t string").select(T.slugify(F.col("t"))).first()[0] == want


def test_ids_prefixes_escapes(spark):
    import hashlib

    r = spark.createDataFrame([("de", 'a"b\n')], "c string, t string").select(
        T.stable_id(F.col("c"), F.col("t")).alias("i"), T.truncate(F.lit("abcdef"), F.lit(0.5)).alias("p"), T.truncate(F.lit("a"), F.lit(0.1)).alias("q"), T.json_string(F.col("t")).alias("j"),
        T.share_text(F.lit(1 / 3)).alias("s"), T.sanitize_model_name(F.lit("a/b:c")).alias("m"), T.language_of(F.lit("de_partial_9")).alias("l"), T.language_of(F.lit("x")).alias("u"),
    ).first()
    assert r.i == "de_" + hashlib.sha1(b'de\0a"b\n').hexdigest()[:12]
    assert (r.p, r.q, r.j, r.s, r.m, r.l, r.u) == ("abc", "a", '"a\\"b\\n"', "0.33333333", "a_b_c", "de", "unknown")


def test_strip_is_wide(spark):
    s = " \x1c a　"
    assert spark.createDataFrame([(s,)], "t string").select(T.strip(F.col("t"))).first()[0] == s.strip()
    assert unicodedata.category("　") == "Zs"
