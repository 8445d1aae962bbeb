"""Document fingerprints by consistent weighted sampling, in DataFrame operations only.

A document is a set of words weighted by their counts. For each of `SAMPLES` hash functions k every
weighted word (w, S) draws, from hashes of (w, k), r and c from Gamma(2, 1) and b uniform, and gets
t = floor(ln S / r + b) and a = c exp(-r (t - b + 1)); the sample is the (w, t) with the least a. Two documents
have the same sample with the probability sum(min(S, S')) / sum(max(S, S')), the generalised Jaccard
similarity, so the share of equal samples estimates it. The fingerprint holds 20 bits of each sample.

a, scaled to 43 bits, and the sample's 20 bits are packed in one long, so that a sample is a plain min() over longs and
all samples of a document are one hash aggregation in generated code, without sorting and without lambdas.

Each document's text is compared with an edited one that needs the next document's text, and with the
next document. Documents are cut into ranges of (doc_id, hash of the text), and the first document of a range also
goes, as a guest, to the range before. So one shuffle brings every document next to its successor, and everything after
it - windows, term counts, samples - stays in that partitioning. The number of ranges is set by the session's shuffle
partitions; their bounds are quantiles of `PER_RANGE` hash-sampled documents a range, which decides the load of the tasks and
nothing else, and are a table that the plan reads, as are the first documents.

Edge cases: null text is empty; a text without words has only zeros as fingerprint, likeness 1 to another
one without words and 0 to the rest; order is by doc_id (null first), then a hash of the text; the last
document's next is the first one, a lone document's is itself; repeated rows each get a row, and the
next of one is the other; an empty table gives no rows; extra columns are ignored; words are separated by ASCII
white space, unchanged; doc_id may be of any type that has an order; texts are read whole.
"""

from __future__ import annotations

from hashlib import sha256
from math import isqrt, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.llm.common import small, stored

SAMPLES, ID_BITS = 64, 20
RANGES_PER_PARTITION, PER_RANGE = 16, 40
#: a is below 48 and scaled to 43 bits.
SCALE = 37
SEEDS = [[int.from_bytes(sha256(b"%d %d" % (k, i)).digest()[:8], "little", signed=True) for i in range(5)] for k in range(4 * SAMPLES)]
SPACE = r"[\x20\x09-\x0D]+"


def place(id_: Column, th: Column) -> Column:
    """What the order of documents compares; null ids come first."""
    return F.struct(id_.isNotNull().alias("some"), id_.alias("id"), th.alias("th"))


def bounds(places: DataFrame, parts: int) -> DataFrame:
    """One row: `nested`, the bounds of the ranges in groups, and `firsts`, the first one of each group."""
    every = max(1, places.count() // (parts * PER_RANGE))
    some = places.where(F.pmod(F.xxhash64("place"), F.lit(every)) == 0).distinct()
    step = max(1, isqrt(parts))
    rank = F.row_number().over(Window.orderBy("place")) - 1  # about parts * PER_RANGE rows
    some = some.withColumn("rank", rank).where((F.col("rank") > 0) & (F.col("rank") % PER_RANGE == 0))
    groups = some.groupBy(F.floor(F.col("rank") / (PER_RANGE * step)).alias("g")).agg(F.array_sort(F.collect_list("place")).alias("part"))
    groups = groups.agg(F.transform(F.array_sort(F.collect_list(F.struct("g", "part"))), lambda x: x["part"]).alias("nested"))  # of few documents, empty
    return stored(groups.select("nested", F.transform("nested", lambda x: x[0]).alias("firsts")))


def with_range(rows: DataFrame, table: DataFrame) -> DataFrame:
    """rows with pid, the range that their place lies in, by two levels of short searches in the bounds."""
    rows = rows.withColumns({"firsts": table.select("firsts").scalar(), "nested": table.select("nested").scalar()})
    group = F.size(F.filter("firsts", lambda x: x <= F.col("place"))) - 1
    inside = F.size(F.filter(F.get("nested", group), lambda x: x <= F.col("place")))
    pid = F.when(F.size("firsts") > 0, F.struct(group.alias("group"), F.coalesce(inside, F.lit(0)).alias("n"))).otherwise(F.struct(F.lit(-1).alias("group"), F.lit(0).alias("n")))
    return rows.withColumn("pid", pid).drop("firsts", "nested")


def with_next(docs: DataFrame) -> DataFrame:
    """(pid, rid, guest, doc_id, text, next_text), one row per document and one per guest."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) * RANGES_PER_PARTITION
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    own = own.withColumn("place", place(F.col("doc_id"), F.col("th")))
    places = stored(own.select("place"))
    cuts = bounds(places, parts)
    own = with_range(own, cuts)
    # one row per range: its first document, and the range before
    heads = with_range(places, cuts).groupBy("pid").agg(F.min("place").alias("head"))
    order = Window.orderBy("pid")  # as many rows as ranges
    spec = heads.select("head", F.coalesce(F.lag("pid").over(order), F.last("pid").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("g_pid"))
    own = own.join(small(stored(spec)), F.col("place") == F.col("head"), "left")
    both = F.when(F.col("g_pid").isNull(), F.array(F.struct(F.col("pid").alias("pid"), F.lit(False).alias("guest")))).otherwise(
        F.array(F.struct(F.col("pid").alias("pid"), F.lit(False).alias("guest")), F.struct(F.col("g_pid").alias("pid"), F.lit(True).alias("guest")))
    )
    rows = own.select("doc_id", "text", "th", F.explode(both).alias("x")).select("x.pid", "x.guest", "doc_id", "th", "text")
    rows = rows.where("pid is not null")  # always so; said here, both uses of these rows share one exchange
    order = Window.partitionBy("pid").orderBy("guest", F.col("doc_id").asc_nulls_first(), "th")
    return rows.select("pid", F.row_number().over(order).alias("rid"), "guest", "doc_id", "text", F.lead("text").over(order).alias("next_text"))


def sample(term: Column, weight: Column, k: int) -> Column:
    """a of sample k, scaled, above ID_BITS bits that name (term, t)."""
    # each hash stands once outside the conditions, as Spark's elimination of common subexpressions costs more than it saves here
    h = [F.xxhash64(term.bitwiseXOR(F.lit(x))) for x in SEEDS[k]]
    u, v, c1, c2 = ((F.shiftrightunsigned(x, 32) + F.lit(0.5)) * F.lit(2.0**-32) for x in h[:4])
    # r = -ln u - ln v and b = -ln u / r are independent, Gamma(2, 1) and uniform; so a = c exp(-r (t - b + 1)) = c v exp(-r t),
    # and t is 0 for a word that stands once
    r = F.lit(0.0) - F.log(u * v)
    t = F.floor((F.log(weight) - F.log(u)) / r)
    once = weight == 1
    a = (F.lit(0.0) - F.log(c1 * c2)) * v * F.when(once, F.lit(1.0)).otherwise(F.exp(F.lit(0.0) - r * t))
    name = h[4].bitwiseXOR(F.when(once, F.lit(0).cast("bigint")).otherwise(t * 513))
    return F.shiftleft(F.floor(a * F.lit(2.0**SCALE)), ID_BITS).bitwiseOR(name.bitwiseAND(F.lit((1 << ID_BITS) - 1)))


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    base = with_next(docs)
    n = F.char_length("text")
    q = F.floor(n / 4).cast("int")
    base = base.withColumns({"n": n, "keep": n - q})
    edited = F.concat(F.substring("text", F.lit(1), F.col("keep")), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), F.col("n") - F.col("keep")))
    base = base.withColumn("edited", F.when(F.col("guest"), F.lit("")).otherwise(edited))
    facts = base.select("pid", "rid", "guest", "doc_id", F.col("n").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))

    # words up to the last white space before the edit are in both texts
    head = F.when(F.col("guest"), F.lit("")).otherwise(F.regexp_extract(F.substring("text", F.lit(1), F.col("keep")), r"(?s)^(.*[\x20\x09-\x0D])", 1))
    cut = base.withColumn("head", head).withColumn("rest", F.char_length("head") + 1)
    tail = lambda c: F.split(F.expr(f"substring({c}, rest)"), SPACE)
    side = lambda i, words: F.struct(F.lit(i).alias("side"), words.alias("words"))
    cut = cut.select("pid", "rid", F.explode(F.array(side(0, F.split("head", SPACE)), side(1, tail("text")), side(2, tail("edited")))).alias("s"))
    words = cut.select("pid", "rid", F.col("s.side").alias("side"), F.explode("s.words").alias("word")).where("word <> ''")
    terms = words.select("pid", "rid", "side", F.xxhash64("word").alias("term"))
    counts = terms.groupBy("pid", "rid", "term").agg(
        F.sum(F.when(F.col("side") != 2, 1).otherwise(0)).alias("w1"), F.sum(F.when(F.col("side") != 1, 1).otherwise(0)).alias("w2")
    )
    # a term of equal weight in both texts is sampled once for both (side 0)
    each = F.when(F.col("w1") == F.col("w2"), F.array(F.struct(F.lit(0).alias("side"), F.col("w1").alias("w")))).otherwise(
        F.array(F.struct(F.lit(1).alias("side"), F.col("w1").alias("w")), F.struct(F.lit(2).alias("side"), F.col("w2").alias("w")))
    )
    weighted = counts.select("pid", "rid", "term", F.explode(each).alias("x")).select("pid", "rid", "term", "x.side", F.col("x.w").cast("double").alias("w")).where("x.w > 0")
    least = weighted.groupBy("pid", "rid", "side").agg(*(F.min(sample(F.col("term"), F.col("w"), k)).alias(f"m{k}") for k in range(samples)))
    of = lambda k, other: F.min(F.when(F.col("side") != other, F.col(f"m{k}")))
    merged = least.groupBy("pid", "rid").agg(*(of(k, 2).alias(f"a{k}") for k in range(samples)), *(of(k, 1).alias(f"b{k}") for k in range(samples)))
    name = lambda c: F.col(c).bitwiseAND(F.lit((1 << ID_BITS) - 1)).cast("int")
    signature = lambda p: F.when(F.col(f"{p}0").isNotNull(), F.array(*(name(f"{p}{k}") for k in range(samples))))
    merged = merged.select("pid", "rid", signature("a").alias("own"), signature("b").alias("edit"))

    both = facts.join(merged, ["pid", "rid"], "left")
    order = Window.partitionBy("pid").orderBy("rid")
    both = both.withColumn("next", F.lead("own").over(order)).where(~F.col("guest"))
    alike = lambda a, b: F.when(F.col(a).isNull() & F.col(b).isNull(), 1.0).when(F.col(a).isNull() | F.col(b).isNull(), 0.0).otherwise(
        F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / samples
    )
    text = lambda c: F.coalesce(F.array_join(F.transform(c, lambda x: F.lower(F.lpad(F.hex(x), ID_BITS // 4, "0"))), ""), F.lit("0" * (samples * ID_BITS // 4)))
    return both.select(
        "doc_id", "n_chars", "edited_sha256", text("own").alias("fingerprint"), text("edit").alias("edited_fingerprint"),
        alike("own", "edit").alias("near_edited"), alike("own", "next").alias("near_next"),
    )


def op5(docs: DataFrame) -> DataFrame:
    return fingerprints(docs)
