"""Benchmark decontamination with a distributed positional inverted index, in DataFrame operations only.

The terms of the index are pairs of neighbouring words (a single word where a window has only one): a
posting is (term, document, position). Postings of terms that occur in the benchmark are stored as a
table in the shared folder. A window of `width` benchmark words is looked up by non-overlapping pairs
that cover it: the postings of its rarest pair, minus the pair's offset in the window, are candidate
starts; they are intersected with the offset-adjusted postings of the next rarer pair, and so on. A window of fewer
pairs than others meets its rarest one again, so that all go through one chain of joins. What
survives all lists is an exact occurrence of the phrase, since the pairs cover all its words. Proximity search
relaxes the offsets: documents that hold the rarest pair are looked up in the lists of the window's other pairs, and
match where all stand within a stated span, in any order.

An index of every token of the training text would take about four times the text's bytes on disk (24 bytes a posting
and sort, 12 or more stored), so a stored index holds the postings of the terms it was built for; index_of() takes any
number of benchmarks at once, and find() and near() read it as often as wanted.

Words: lower-cased A-Z, [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+. Documents are identified by doc_id and a hash
of the text, so repeated rows share postings and rows that share an id but not a text are kept apart.

Edge cases: null text has no words, and an item without words no window; an item shorter than a window is
one window; a null doc_id is a document; a null item_id is no item; items that share an item_id count
as one item; equal windows of several items are looked up once and count for each; overlapping
occurrences hit a word once; empty tables give no hits or no rows; extra columns are ignored by
contamination() and kept by remove_contaminated().
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.llm.common import aliased, ascii_lower, fits, restored, small, stored

WIDTH, MIN_ITEMS = 8, 2
#: Words within which proximity search looks for the terms of a window.
SPAN = 16
#: Anything that isn't a word character once A-Z are lower-cased.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


#: Files of a table whose size follows the benchmark's, not the documents'.
FEW = 8


def words_of(text: Column) -> Column:
    """Array of words; the leading or trailing empty strings of split() are not words."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP), "")


def windows_of(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """(item_id, words) of every distinct window of every item."""
    w = items.where("item_id is not null").select("item_id", words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    w = w.select("item_id", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - (width - 1), F.lit(1)))).alias("i"))
    return w.select("item_id", F.slice("w", F.col("i"), width).alias("words")).distinct()


def pair_plan(windows: DataFrame) -> DataFrame:
    """(wid, size, at, t0, t1): the pairs that cover each distinct window; t1 is null for a lone word."""
    w = windows.select(F.sha2(F.concat_ws(" ", "words"), 256).alias("wid"), "words").dropDuplicates(["wid"])
    at = F.when(F.size("words") == 1, F.array(F.lit(0))).otherwise(
        F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("words") - 1, F.lit(2)), lambda i: F.least(i, F.size("words") - 2)))
    )
    w = w.select("wid", F.size("words").alias("size"), "words", F.explode(at).alias("at"))
    return w.select("wid", "size", "at", F.get("words", F.col("at")).alias("t0"), F.get("words", F.col("at") + 1).alias("t1"))


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, doc_id, th, pos): places of the pairs (t0, t1) of `terms`, which has their number as `term`. Many terms are
    joined by their number, which is all that is shuffled then; Spark splits the partitions of a frequent one."""
    w = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("th"), words_of(F.col("text")).alias("w"))
    nexts = F.slice("w", 2, F.greatest(F.size("w"), F.lit(1)))
    each = w.select("doc_id", "th", F.posexplode(F.arrays_zip(F.col("w").alias("t0"), nexts.alias("t1"))).alias("pos", "p")).select("doc_id", "th", "pos", "p.t0", "p.t1")

    def held(keys: list[str], wanted: DataFrame) -> DataFrame:
        if fits(wanted):
            return each.join(F.broadcast(wanted), keys).select("term", "doc_id", "th", "pos")
        numbered = each.select(F.xxhash64("t0", *(["t1"] if "t1" in keys else [F.lit(None).cast("string")])).alias("term"), "doc_id", "th", "pos")
        return numbered.join(wanted.select("term"), "term", "left_semi")

    found = held(["t0", "t1"], stored(terms.where("t1 is not null")))
    if terms.where("t1 is null").isEmpty():
        return found
    return found.union(held(["t0"], stored(terms.where("t1 is null").select("t0", "term"))))


class Index(NamedTuple):
    """Postings (term, doc_id, th, pos) of the terms of some windows, and how to look the windows up: (wid, size, term, at, more),
    the rarest term first and `most` - 1 others by rarity, filled up with the rarest one. Windows with a term that never occurs are left out."""

    postings: DataFrame
    lists: DataFrame
    most: int  #: terms of a window


def index_of(docs: DataFrame, windows: DataFrame) -> Index:
    plan = stored(pair_plan(windows).coalesce(FEW))
    terms = stored(plan.select("t0", "t1").distinct().withColumn("term", F.xxhash64("t0", "t1")).coalesce(FEW))
    index = stored(postings(docs, terms))
    freq = stored(index.groupBy("term").agg(F.count("*").alias("freq")).coalesce(FEW))
    lists = plan.withColumn("term", F.xxhash64("t0", "t1")).join(freq, "term", "left")
    by_rarity = Window.partitionBy("wid").orderBy(F.coalesce("freq", F.lit(0)), "at")
    ranked = lists.select("wid", "size", "at", "term", F.coalesce("freq", F.lit(0)).alias("freq"))
    ranked = ranked.withColumn("rank", F.row_number().over(by_rarity)).withColumn("least", F.min("freq").over(Window.partitionBy("wid")))
    ranked = stored(ranked.where("least > 0").select("wid", "size", "at", "term", "rank").coalesce(FEW))
    most = plan.groupBy("wid").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    rest = ranked.groupBy("wid", "size").agg(F.array_sort(F.collect_list(F.struct("rank", "term", "at"))).alias("lists"))
    rarest = F.get("lists", F.lit(0))
    more = F.concat(F.slice("lists", 2, F.size("lists")), F.array_repeat(rarest, F.lit(most) - F.size("lists")))
    rest = stored(rest.select("wid", "size", rarest["term"].alias("term"), rarest["at"].alias("at"), more.alias("more")).coalesce(FEW))
    return Index(index, rest, most)


def find(index: Index) -> DataFrame:
    """(doc_id, th, wid, start, size): every exact occurrence of every window."""
    found = index.postings.join(small(index.lists), "term").select("doc_id", "th", "wid", "size", "more", (F.col("pos") - F.col("at")).alias("start")).where("start >= 0")
    held = index.postings.select(F.col("term").alias("x_term"), F.col("doc_id").alias("x_id"), F.col("th").alias("x_th"), F.col("pos").alias("x_pos"))
    for i in range(index.most - 1):
        need = F.get("more", F.lit(i))
        open_ = found.withColumns({"n_term": need["term"], "n_pos": F.col("start") + need["at"]})
        hit = open_.join(held, (F.col("n_term") == F.col("x_term")) & (F.col("th") == F.col("x_th")) & (F.col("n_pos") == F.col("x_pos")) & F.col("doc_id").eqNullSafe(F.col("x_id")), "left_semi")
        found = hit.select(*found.columns)
    return found.select("doc_id", "th", "wid", "start", "size").distinct()


def near(index: Index, span: int) -> DataFrame:
    """(doc_id, th, wid, first, last): stretches of at most `span` places of terms in which all terms of a window stand, in any
    order. At each posting the window's terms within the span before it are counted."""
    terms = F.array_distinct(F.concat(F.array("term"), "more.term"))
    some = index.postings.join(small(index.lists.select("term", "wid", terms.alias("terms"))), "term").select("doc_id", "th", "wid", "terms").distinct()
    some = some.select("doc_id", "th", "wid", F.size("terms").alias("n_terms"), F.explode("terms").alias("term"))
    held = index.postings.select(F.col("term").alias("x_term"), F.col("doc_id").alias("x_id"), F.col("th").alias("x_th"), "pos")
    same = (F.col("term") == F.col("x_term")) & (F.col("th") == F.col("x_th")) & F.col("doc_id").eqNullSafe(F.col("x_id"))
    merged = some.join(held, same).select("doc_id", "th", "wid", "n_terms", "term", "pos")
    within = Window.partitionBy("doc_id", "th", "wid").orderBy("pos").rangeBetween(-(span - 1), 0)
    merged = merged.withColumns({"seen": F.size(F.collect_set("term").over(within)), "first": F.min("pos").over(within)})
    return merged.where("seen = n_terms").select("doc_id", "th", "wid", "first", F.col("pos").alias("last"))


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH, min_items: int = MIN_ITEMS, span: int | None = None) -> DataFrame:
    """doc_id, th (hash of the text), n_words, n_hit, n_items, items and contaminated for every row; with span, also n_near, the
    number of items with a window whose terms all stand within the span."""
    windows = stored(windows_of(items, width).withColumn("wid", F.sha2(F.concat_ws(" ", "words"), 256)).coalesce(FEW))
    index = index_of(docs, windows)
    found = stored(find(index))
    end = F.col("start") + F.col("size")
    before = Window.partitionBy("doc_id", "th").orderBy("start", "size", "wid").rowsBetween(Window.unboundedPreceding, -1)
    fresh = found.select("doc_id", "th", (end - F.greatest(F.col("start"), F.coalesce(F.max(end).over(before), F.col("start")))).alias("own"))
    hits = fresh.groupBy("doc_id", "th").agg(F.sum(F.greatest("own", F.lit(0))).cast("bigint").alias("n_hit"))
    of = found.select("doc_id", "th", "wid").distinct().join(small(stored(windows.select("wid", "item_id"))), "wid").select("doc_id", "th", "item_id").distinct()
    which = of.groupBy("doc_id", "th").agg(F.array_sort(F.collect_list(F.col("item_id").cast("string"))).alias("items"))
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["th"] == b["th"])
    marks = hits.join(which, same(hits, which)).select(hits["doc_id"], hits["th"], "n_hit", "items", F.lit(0).cast("bigint").alias("n_near"))
    if span is not None:
        close = near(index, span).select("doc_id", "th", "wid").distinct().join(small(stored(windows.select("wid", "item_id"))), "wid").select("doc_id", "th", "item_id").distinct()
        close = close.groupBy("doc_id", "th").agg(F.count("*").alias("n_near")).select("doc_id", "th", F.lit(None).cast("bigint").alias("n_hit"), F.lit(None).cast("array<string>").alias("items"), "n_near")
        marks = marks.union(close).groupBy("doc_id", "th").agg(F.max("n_hit").alias("n_hit"), F.max("items").alias("items"), F.max("n_near").alias("n_near"))
    marks = stored(marks.select(F.col("doc_id").alias("m_id"), F.col("th").alias("m_th"), "n_hit", "items", "n_near"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), GAP_ANY_CASE), "")).cast("bigint").alias("n_words"))
    out = rows.join(marks, rows["doc_id"].eqNullSafe(F.col("m_id")) & (rows["th"] == F.col("m_th")), "left")
    items_ = F.coalesce("items", F.array().cast("array<string>"))
    n_items = F.size(items_).cast("bigint")
    more = [F.coalesce("n_near", F.lit(0)).alias("n_near")] if span is not None else []
    return out.select("doc_id", "th", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), n_items.alias("n_items"), items_.alias("items"), (n_items >= min_items).alias("contaminated"), *more)


def remove_contaminated(docs: DataFrame, items: DataFrame, width: int = WIDTH, min_items: int = MIN_ITEMS) -> DataFrame:
    """The rows that don't hold windows of min_items items, columns as given."""
    bad = stored(contamination(docs, items, width, min_items).where("contaminated").select(F.col("doc_id").alias("bad_id"), F.col("th").alias("bad_th")).distinct())
    own = aliased(docs, "doc_id", "text")
    return restored(own.join(small(bad), F.col("doc_id").eqNullSafe(F.col("bad_id")) & (F.xxhash64("text") == F.col("bad_th")), "left_anti"), own, docs)


def op10(docs: DataFrame, items: DataFrame) -> DataFrame:
    out = contamination(docs, items, span=SPAN)
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated", "n_near")


_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
ORACLE_SQL = f"""
with d as (select doc_id, {_WORDS} as w from documents),
b as (select item_id, {_WORDS} as w from benchmark),
win as (select distinct item_id, w[i:i + 7] as s from b, unnest(range(1, greatest(len(w) - 7, 1) + 1)) t(i) where len(w) > 0),
sizes as (select distinct len(s) as n from win),
occ as (select doc_id, i, n, w[i:i + n - 1] as s from d, sizes, unnest(range(1, len(w) - n + 2)) t(i)),
hit as (select distinct doc_id, i, n, item_id from occ join win using (s)),
covered as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hit) group by 1),
terms as (select distinct s, unnest(case when len(s) = 1 then [s[1]] else list_transform(range(0, len(s), 2), lambda i: s[least(i, len(s) - 2) + 1] || ' ' || s[least(i, len(s) - 2) + 2]) end) as term from win),
sizes2 as (select s, count(*) as n_terms from terms group by 1), wanted as (select distinct term from terms),
posts as (select doc_id, i as pos, w[i] || ' ' || w[i + 1] as term from d, unnest(range(1, len(w))) t(i) where w[i] || ' ' || w[i + 1] in (select term from wanted)
  union all select doc_id, i, w[i] from d, unnest(range(1, len(w) + 1)) t(i) where w[i] in (select term from wanted)),
merged as (select doc_id, s, pos, count(distinct term) over (partition by doc_id, s order by pos range between {SPAN - 1} preceding and current row) as seen from posts join terms using (term)),
near as (select doc_id, count(distinct item_id) as n_near from (select distinct doc_id, s from merged join sizes2 using (s) where seen = n_terms) join win using (s) group by 1),
items as (select doc_id, count(*) as n_items, string_agg(x, ',' order by x) as names from (select distinct doc_id, cast(item_id as varchar) as x from hit) group by 1)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(names, '')) as items_sha256,
  coalesce(n_items, 0) >= 2 as contaminated, cast(coalesce(n_near, 0) as bigint) as n_near from d left join covered using (doc_id) left join items using (doc_id) left join near using (doc_id)
"""
