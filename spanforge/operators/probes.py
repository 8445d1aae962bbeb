"""Probe construction: normalisation, fragments, spans, truncation-sensitive prefixes, allocation, sampling."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.functions import text as T
from spanforge.operators import ranking


@dataclass(frozen=True)
class Language:
    """How probes are cut from a language's text. A span holds letters of the script, combining marks and ’ ' - only."""

    lang: str
    category: str
    script: str
    span: str
    min_span: int = 8
    max_span: int = 40
    min_prefix: int = 4
    ratios: tuple[float, ...] = (0.55, 0.65, 0.75)
    context_words: int = 6
    context_chars: int = 40
    min_chars: int = 4
    max_chars: int = 140
    min_fragment: int = 12
    split: str = r"(?=\s)(?<=[.!?;:])\s+"


def _letters(script: str) -> str:
    """A script's letters and combining marks, as what stands inside a class; ASCII doesn't reach the look-ups."""
    return T.script_class(script) + r"[\x{300}-\x{10ffff}&&\p{M}]"


def _words(script: str, joined: bool) -> str:
    # a match begins at the first character of its run and ends with the last, so no look at its neighbours is needed
    one = rf"[{_letters(script)}]"
    return rf"{one}+" + (rf"(?:[’'-]{one}+)*" if joined else "")


# The languages' limits and ratios.
LANGUAGES = {
    "de": Language("de", "german_partial", "Latin", _words("Latin", True)),
    "fr": Language("fr", "french_partial", "Latin", _words("Latin", True)),
    "en": Language("en", "english_partial", "Latin", _words("Latin", True)),
    "es": Language("es", "spanish_partial", "Latin", _words("Latin", True)),
    "ar": Language("ar", "arabic_partial", "Arabic", _words("Arabic", False), 5, 30, 3, (0.55, 0.70, 0.80), split=r"(?=\s)(?<=[.!?؟؛;:])\s+"),
    "zh": Language("zh", "chinese_partial", "Han", r"\p{IsHan}+", 3, 16, 1, (0.45, 0.60, 0.75), 0, 40, 4, 140, 8, r"(?<=[。！？；：.!?;:])\s*"),
}


def nfkc(text: Column) -> Column:
    """The one text function that Spark lacks; batches go through Arrow."""
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))

    return run(text)


def normalize(text: Column, legacy_controls: bool = False, compat: bool = True) -> Column:
    """NFKC, plain blanks, no zero-width characters, no control characters (kept with legacy_controls), trimmed."""
    t = nfkc(text) if compat else text
    # a run of controls and blanks is one blank; a blank alone is left as it is, and a table of characters would be asked for each
    t = F.regexp_replace(t, r"[\x{200b}-\x{200d}]+", "")
    other = r"\t\x0B\f\r\x{a0}" + ("" if legacy_controls else r"\x{0}-\x{8}\x{e}-\x{1f}\x{7f}-\x{9f}[\x{ad}-\x{10ffff}&&\p{Cf}]")
    return T.strip(F.regexp_replace(t, rf"[{other}][ {other}]*| [ {other}]+", " "))


def fragments(docs: DataFrame, spec: Language, text: str = "text") -> DataFrame:
    """docs with paragraph, position and fragment columns, one row per fragment."""
    paras = docs.select("*", F.posexplode(F.split(F.col(text), r"\n+")).alias("paragraph", "__p")).withColumn("__p", T.strip(F.col("__p"))).where("__p <> ''")
    out = paras.select("*", F.posexplode(F.split("__p", spec.split)).alias("position", "__f"))
    return out.withColumn("fragment", F.trim("__f", F.lit(" \t"))).drop("__p", "__f").where("fragment <> ''")


def usable(fragment: Column, spec: Language) -> Column:
    n = F.char_length(fragment)
    link = F.contains(fragment, F.lit("://")) | F.contains(fragment, F.lit("www."))
    return (
        (n >= spec.min_fragment) & (~link | (F.regexp_count(fragment, F.lit(r"https?://|www\.")) <= 1)) & ~fragment.rlike(r"[<>{}\[\]|]{3,}")
        & _holds(fragment, spec.script, spec.min_span) & ((n - F.char_length(F.regexp_replace(fragment, r"\p{P}+", ""))) / F.greatest(F.lit(1), n) <= 0.35)
    )


def _holds(text: Column, script: str, n: int) -> Column:
    """n characters of a script, of which no more are counted."""
    one = T.script_class(script)
    return text.rlike(rf"\A(?:[^{one}]*+[{one}]){{{n}}}")


def _ends(text: Column, script: str) -> Column:
    return F.substring(text, -1, 1).rlike(rf"[{T.script_class(script)}]")


# White space as the patterns of words mean it, and what isn't, written as ranges because that is fast. A
# nested class stands for what is rare: it isn't looked at where the first range decides.
_RARE_WS = r"\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_WS = rf"[\s[\x{{85}}-\x{{3000}}&&[{_RARE_WS}]]]"
_NOT_WS = (
    r"[!-~[\x{a1}-\x{167f}\x{1681}-\x{1fff}\x{200b}-\x{2027}\x{202a}-\x{202e}\x{2030}-\x{205e}\x{2060}-\x{2fff}\x{3001}-\x{10ffff}"
    r"\x{0}-\x{8}\x{e}-\x{1f}\x{7f}-\x{84}\x{86}-\x{9f}]]"
)
_WORD = rf"(\A{_WS}*{_NOT_WS}+{_WS}*|{_NOT_WS}+{_WS}*)"
#: Anything but words between single blanks.
_ODD_WS = rf"\A |  |[\t-\r[\x{{85}}-\x{{3000}}&&[{_RARE_WS}]]]"
#: Texts up to _SHORT characters are taken whole: steps may take their length for each span. Longer ones are cut in pieces of
#: _PIECE and what is left of a run. Where words have under 24 characters and white space under 8, a piece holds 7 words.
_SHORT, _PIECE, _LONG_WORD = 512, 256, rf"{_NOT_WS}{{24}}|{_WS}{{8}}"
#: Entries of an array that a running sum takes at a time.
_RUN = 128


def _running(sizes: str) -> Column:
    """Sums of what stands before each entry of an array column. Appending to an array copies it, so sums run over blocks.
    The column must be there: an expression in its place would be evaluated for each block."""

    def scan(x: Column, base: Column) -> Column:
        start = F.struct(base.cast("bigint").alias("sum"), F.array().cast("array<bigint>").alias("out"))
        step = lambda acc, n: F.struct((acc["sum"] + n).alias("sum"), F.concat(acc["out"], F.array(acc["sum"])).alias("out"))
        return F.aggregate(x, start, step, lambda acc: acc["out"])

    count = F.ceil(F.size(sizes) / _RUN).cast("int")
    blocks = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.slice(sizes, (i - 1) * _RUN + 1, _RUN))
    bases = scan(F.transform(blocks, lambda x: F.aggregate(x, F.lit(0).cast("bigint"), lambda acc, n: acc + n)), F.lit(0))
    return F.flatten(F.zip_with(blocks, bases, scan))


def _sizes(x: str) -> Column:
    return F.transform(x, lambda s: F.char_length(s).cast("bigint"))


def _runs(rows: DataFrame, text: str, pattern: str) -> DataFrame:
    """rows with __s, the matches of a pattern, and __at, their places; rows without a match go."""
    found = rows.withColumns({"__s": F.regexp_extract_all(text, F.lit(f"({pattern})"), 1), "__gap": F.split(text, pattern)}).where(F.size("__s") > 0)
    found = found.withColumn("__gap", F.slice("__gap", F.lit(1), F.size("__s"))).withColumn("__n", F.zip_with("__gap", "__s", lambda g, x: (F.char_length(g) + F.char_length(x)).cast("bigint")))
    many = F.zip_with(_running("__n"), "__gap", lambda at, g: at + F.char_length(g))
    one = F.array(F.char_length(F.get("__gap", F.lit(0))).cast("bigint"))
    return found.withColumn("__at", F.when(F.size("__s") == 1, one).otherwise(many)).drop("__gap", "__n")


def spans(frags: DataFrame, spec: Language, least: int = 1) -> DataFrame:
    """frags with span, its offset (characters from 0) and its left context. Every step is linear in the fragment's
    length: words, or blocks of characters, are taken with their neighbours before the spans in them are. Spans of fewer
    than `least` characters may be left out."""
    return _spans_by_block(frags, spec) if spec.context_words <= 0 else _spans_by_word(frags, spec, least)


def _exploded(rows: DataFrame, pieces: Column, out: str, left=lambda i: F.lit("")) -> DataFrame:
    """rows with a struct of a piece (x), its place (at) and what stands left of it, one a row. Arrays stay behind: a row that
    took them along would be as long as all of them."""
    rows = rows.withColumn("__a", pieces).withColumn("__m", _sizes("__a")).withColumn("__from", F.when(F.size("__a") > 1, _running("__m")))
    piece = lambda x, at, before: F.struct(x.alias("x"), at.alias("at"), before.alias("left"))
    one = F.array(piece(F.get("__a", F.lit(0)), F.lit(0).cast("bigint"), F.lit("")))
    many = F.transform(F.sequence(F.lit(0), F.size("__a") - 1), lambda i: piece(F.get("__a", i), F.get("__from", i), left(i)))
    return rows.withColumn(out, F.explode(F.when(F.size("__a") == 1, one).otherwise(many))).drop("__a", "__m", "__from")


def _spans_by_word(frags: DataFrame, spec: Language, least: int) -> DataFrame:
    """A span lies in one word; its context is the words before that, and the word's beginning, which counts as one.
    Short fragments are one part. Longer ones are cut in pieces, of which one holds a context, or in words, if some are so long
    that it may not. Long words are cut again. No piece ends inside a run of what spans hold."""
    k, c = spec.context_words, F.col
    run = rf"[’'\-{_letters(spec.script)}]"
    cut = F.lit(rf"((?s:.{{1,{_PIECE}}}+){run}*+)")
    kind = F.when(F.char_length("fragment") <= _SHORT, 0).when(c("fragment").rlike(_LONG_WORD), 2).otherwise(1)
    rows = frags.withColumns({"__kind": kind, "__odd": c("fragment").rlike(_ODD_WS)})
    parts = F.when(c("__kind") == 0, F.array("fragment")).when(c("__kind") == 1, F.regexp_extract_all("fragment", cut, 1)).otherwise(F.regexp_extract_all("fragment", F.lit(_WORD), 1))
    words = lambda i: F.array_join(F.slice("__a", F.greatest(i - k + 1, F.lit(1)), F.least(i, F.lit(k))), "")
    rows = _exploded(rows, parts, "__p", lambda i: F.when(i == 0, F.lit("")).when(c("__kind") == 1, F.get("__a", i - 1)).otherwise(words(i)))
    rows = rows.withColumns({"__text": c("__p.x"), "__at": c("__p.at"), "__left": c("__p.left")}).drop("__p")
    rows = _exploded(rows, F.when(F.char_length("__text") <= 2 * _SHORT, F.array("__text")).otherwise(F.regexp_extract_all("__text", cut, 1)), "__q")
    # a span's place is the end of its piece less what stands from the span on
    rows = rows.withColumns({"__x": c("__q.x"), "__end": c("__q.at") + F.char_length("__q.x")}).drop("__q")
    ahead = rf"(?={run}{{{least}}})" if least > 1 else ""
    found = lambda what: F.regexp_extract_all("__x", F.lit(what), 1)
    both = F.arrays_zip(found(rf"{ahead}({spec.span})").alias("s"), found(rf"(?=([{_letters(spec.script)}](?s:.*)))" + ahead + spec.span).alias("rest"))
    rows = rows.withColumn("__s", F.explode(both)).drop("__x")
    if least > 1:
        rows = rows.where(F.char_length("__s.s") >= least)
    rows = rows.withColumn("__in", (c("__end") - F.char_length("__s.rest")).cast("int"))
    rows = rows.withColumn("__left", F.concat("__left", F.substring("__text", F.lit(1), c("__in"))))
    return rows.select(*frags.columns, c("__s.s").alias("span"), (c("__at") + c("__in")).cast("int").alias("offset"), _last_words("__left", "__odd", k).alias("context"))


def _last_words(text: str, odd: str, k: int) -> Column:
    """The end of a text from its last word but k - 1 on, or all of it where it has no more than k words."""
    plain = F.when(F.endswith(text, F.lit(" ")), F.substring_index(text, " ", -k - 1)).otherwise(F.substring_index(text, " ", -k))
    back = F.regexp_extract(F.reverse(text), rf"\A({_WS}*(?:{_NOT_WS}+{_WS}+){{{k - 1}}}{_NOT_WS}+){_WS}+{_NOT_WS}", 1)
    return F.when(~F.col(odd), plain).when(back == "", F.col(text)).otherwise(F.reverse(back))


def _spans_by_block(frags: DataFrame, spec: Language) -> DataFrame:
    """Runs of a script without spaces; long ones are cut in windows at half-window steps. The context of `context_chars`
    characters lies in two neighbouring blocks of as many."""
    c, step = spec.context_chars, max(1, spec.max_span // 2)
    found = _runs(frags, "fragment", spec.span).withColumn("__b", F.regexp_extract_all("fragment", F.lit(rf"((?s).{{1,{c}}})"), 1))

    def cut(s: Column, at: Column) -> Column:
        n = F.char_length(s)
        first = F.when(n <= spec.max_span, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.greatest(n - spec.min_span, F.lit(0)), F.lit(step)))
        whole = F.when(n <= spec.max_span, n).otherwise(F.lit(spec.max_span))
        return F.transform(first, lambda i: F.struct(F.substring(s, i + 1, whole).alias("span"), (at + i).alias("at")))

    each = F.flatten(F.zip_with("__s", "__at", cut))

    def with_context(x: Column) -> Column:
        start = F.greatest(x["at"] - c, F.lit(0).cast("bigint"))
        block = F.floor(start / c).cast("int")
        both = F.concat(F.coalesce(F.get("__b", block), F.lit("")), F.coalesce(F.get("__b", block + 1), F.lit("")))
        return F.struct(x["span"].alias("span"), x["at"].cast("int").alias("at"), F.substring(both, (start % c + 1).cast("int"), (x["at"] - start).cast("int")).alias("context"))

    keep = F.filter(each, lambda x: F.char_length(x["span"]) >= spec.min_span)
    out = found.withColumn("__x", F.explode(F.transform(keep, with_context)))
    return out.select(*frags.columns, F.col("__x.span").alias("span"), F.col("__x.at").alias("offset"), F.col("__x.context").alias("context"))


def cuts(found: DataFrame, spec: Language) -> DataFrame:
    """found with ratio and cut (characters of the span that stay), each cut once per span with its first ratio."""
    n = F.char_length("span")
    cut = lambda r: F.greatest(F.lit(spec.min_prefix), F.least(n - 1, F.floor(n * F.lit(r)).cast("int")))
    cut_of = [cut(r) for r in spec.ratios]
    new = lambda i: reduce(lambda a, b: a & b, (cut_of[i] != x for x in cut_of[:i]), cut_of[i] < n)
    each = F.array(*(F.struct(F.lit(r).alias("ratio"), cut_of[i].alias("cut"), new(i).alias("new")) for i, r in enumerate(spec.ratios)))
    # the filter also parts the stage: Java runs methods over 8000 bytes, as one stage's would be, without compiling them
    return found.withColumn("x", F.explode(F.filter(each, lambda x: x["new"]))).select(*found.columns, "x.ratio", "x.cut")


def prefix(span: Column, cut: Column) -> Column:
    """The first part of a span, without hanging joiners and combining marks."""
    return F.regexp_replace(F.rtrim(F.substring(span, F.lit(1), cut), F.lit("-'’")), r"[\x{300}-\x{10ffff}&&\p{M}]+\z", "")


def candidates(docs: DataFrame, spec: Language, text: str = "text", category: Column | None = None) -> DataFrame:
    """Prompts that end inside a word or run of the language's script; docs should be normalized. category: where one
    pass cuts several languages, the category of a row."""
    frags = fragments(docs, spec, text).where(usable(F.col("fragment"), spec))
    found = spans(frags, spec, spec.min_span)
    found = found.where(T.script_count(F.col("span"), spec.script).between(spec.min_span, spec.max_span))
    rows = cuts(found, spec).withColumn("prefix", prefix(F.col("span"), F.col("cut")))
    rows = rows.where(_ends(F.col("prefix"), spec.script) & _holds(F.col("prefix"), spec.script, spec.min_prefix))
    # the text ends as its prefix does, so it is stripped on the left only
    rows = rows.withColumn("probe_text", F.ltrim(F.concat("context", "prefix"), F.lit(T.WS_CHARS)))
    rows = rows.where(F.char_length("probe_text").between(spec.min_chars, spec.max_chars))
    of = F.lit(spec.category) if category is None else category
    return rows.withColumns({"category": of, "probe_id": T.stable_id(of, F.col("probe_text"))})


def sample(rows: DataFrame, count: int, seed: int, key: str = "probe_text") -> DataFrame:
    """A uniform sample of distinct texts: the least digests, a top-k that merges partial top-ks."""
    return rows.dropDuplicates([key]).orderBy(ranking.digest(F.col(key), seed), key).limit(count)


def candidate_stats(rows: DataFrame, row: str | None = None) -> DataFrame:
    """Candidates, distinct texts, duplicates and, with the column that numbers source rows from 0, rows scanned."""
    n, unique = F.count("*"), F.count_distinct("probe_text")
    scanned = [(F.coalesce(F.max(row), F.lit(-1)) + 1).cast("bigint").alias("rows_scanned")] if row else []
    return rows.agg(n.alias("candidates"), unique.alias("unique_texts"), (n - unique).alias("duplicates"), *scanned)


def distinct_first_n(samples: DataFrame, n: int) -> DataFrame:
    """The first n distinct texts by seq."""
    return samples.groupBy("text").agg(F.min("seq").alias("seq")).orderBy("seq").limit(n)


def allocate(total: int, weights: dict[str, float]) -> dict[str, int]:
    """Probes per category: one at least; a positive remainder goes to the first."""
    whole = sum(weights.values())
    out = {k: max(1, int(total * w / whole)) for k, w in weights.items()}
    left = total - sum(out.values())
    if left > 0 and out:
        out[next(iter(out))] += left
    return out


def draw(pool: DataFrame, total: int, weights: dict[str, float], seed: int) -> DataFrame:
    """Probes by category from a pool (category, text), drawn with replacement, ids unique by occurrence."""
    spark = pool.sparkSession
    quota = spark.createDataFrame(list(allocate(total, weights).items()), "category string, n int")
    quota = quota.select("category", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    ranked = ranking.by_digest(pool, ["category"], ranking.digest(F.col("text"), seed), [F.col("text")], "k")
    size = pool.groupBy("category").agg(F.count("*").alias("size"))
    pick = quota.join(size, "category").withColumn("k", ranking.draw(ranking.digest("category", F.col("i").cast("string"), seed), F.col("size")) + 1)
    out = pick.join(ranked, ["category", "k"]).withColumn("occurrence", F.row_number().over(Window.partitionBy("category", "text").orderBy("i")))
    return out.select(F.concat(T.stable_id(F.col("category"), F.col("text")), F.lit("_"), F.col("occurrence")).alias("probe_id"), "category", "text").orderBy(ranking.digest("probe_id", seed))
