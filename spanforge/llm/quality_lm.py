"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is over bytes (order `ORDER`), so that no vocabulary has to be fixed. All trusted documents
(labelled quality 1, not toxic) are counted: partitions count their n-grams, a shuffle by n-gram adds
the counts up. Discounts come from counts of counts; lower orders use continuation counts; every table
(probability of each n-gram, back-off weight of each context) is a join of count tables sharded by their
n-gram. Log probabilities are kept as whole numbers of 2**-`POINT`, so that sums don't depend on their order:
scoring looks n-grams up in a broadcast copy if the tables' row count, checked first, is below `BROADCAST_ROWS`,
and joins documents' distinct n-grams with the sharded tables otherwise, and both give the same numbers to the last bit.

Trusted documents fall into two folds by a hash of their text; each fold has a model, and every document
is scored by the model of the fold that it isn't in, so that trusted and other documents are judged alike.

A document's score is its mean negative log probability per byte, drawn towards its language's mean over
trusted documents with the weight of `PRIOR` bytes, because a few words tell little. It is rejected if
its perplexity exceeds its language's `QUANTILE` of the trusted documents' by more than the factor `SLACK` in log terms.

Edge cases: null and empty texts have no bytes, get their language's mean and stay; a null lang is a
language of its own; a language without trusted documents takes the quantile of all; without any trusted
document nothing is known and every row stays, with null perplexity; a document is trusted if all its
labels say so; repeated rows are scored as often and count as often in training; extra columns pass
through filter_quality() and are ignored otherwise; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce
from math import log
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import aliased, chunks, give_back, parts, restored, small, stored, text_buffer

ORDER = 5
PRIOR, QUANTILE, SLACK = 200, 0.995, 1.02
BROADCAST_ROWS = 6_000_000
#: Binary places of a log probability; 32 bits hold it.
POINT = 24
HELD = 4 << 20


def grams(col: pa.Array, order: int = ORDER):
    """For each run of rows: (first row, n-gram that ends with each byte, offsets of the rows)."""
    for a, b in chunks(col, 1 << 19):
        data, off = text_buffer(col.slice(a, b - a))
        at = np.arange(len(data)) + (np.repeat(np.arange(b - a), np.diff(off)) + 1) * (order - 1)
        padded = np.full(len(data) + (b - a) * (order - 1), 10, dtype=np.uint64)  # texts follow line feeds
        padded[at] = data
        key = np.zeros(len(data), dtype=np.uint64)
        for j in range(order - 1, -1, -1):
            key = (key << np.uint64(8)) | padded[at - j]
        yield a, key, off


def trusted_ids(labels: DataFrame) -> DataFrame:
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    return good.where("q = 1 and t = 0 and doc_id is not null").select("doc_id")


def with_fold(docs: DataFrame) -> DataFrame:
    """docs with __fold, 0 or 1: equal texts share a fold."""
    return docs.withColumn("__fold", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int"))


def count_grams(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(fold, gram, n) over all texts; docs has __fold."""

    def run(batches):
        held, size = ([], []), 0
        for b in batches:
            fold = b.column(1).to_numpy()
            for first, key, off in grams(b.column(0), order):
                of = np.repeat(fold[first : first + len(off) - 1], np.diff(off))
                for f in (0, 1):
                    held[f].append(key[of == f])
                size += len(key)
                if size >= HELD:
                    yield from flush(held)
                    held, size = ([], []), 0
        if size:
            yield from flush(held)
        give_back()

    def flush(held):
        for f in (0, 1):
            g, n = np.unique(np.concatenate(held[f]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), f, np.int32)), pa.array(g.view(np.int64)), pa.array(n)], names=["fold", "gram", "n"])

    return docs.select("text", "__fold").mapInArrow(run, "fold int, gram bigint, n bigint").groupBy("fold", "gram").agg(F.sum("n").alias("n"))


class Model(NamedTuple):
    order: int
    probs: list[DataFrame]  #: probs[k-1]: (fold, gram, lp) for k-grams, lp in units of 2**-POINT
    backs: list[DataFrame]  #: backs[k-1]: (fold, gram, lb) for contexts of k-grams


def fixed(x):
    """A log probability in units of 2**-POINT."""
    return F.round(x * F.lit(float(1 << POINT))).cast("int")


#: log(1/256), of a byte about which nothing is known, in units of 2**-POINT
UNKNOWN = round(log(1 / 256) * (1 << POINT))


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """Discounts of counts 1, 2 and 3 or more."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    n = [n1, n2, n3, n4]
    return [min(max(i + 1 - (i + 2) * y * n[i + 1] / n[i], 0.05), i + 0.95) if n[i] else 0.5 * (i + 1) for i in range(3)]


def train(docs: DataFrame, order: int = ORDER) -> Model:
    """A model of each fold; docs has __fold."""
    counts = {order: stored(count_grams(docs, order))}
    for k in range(order - 1, 0, -1):
        low = (1 << 8 * k) - 1
        shorter = counts[k + 1].select("fold", F.col("gram").bitwiseAND(F.lit(low)).alias("gram"))
        counts[k] = stored(shorter.groupBy("fold", "gram").agg(F.count("*").alias("n")))
    probs, backs, lower = [], [], None
    for k in range(1, order + 1):
        one = [F.lit(None).cast("double")] * 3  # discounts of counts 1, 2 and 3 or more, by fold
        for fold, *found in counts[k].groupBy("fold").agg(*(F.count_if(F.col("n") == i) for i in range(1, 5))).collect():  # two rows
            one = [F.when(F.col("fold") == fold, d).otherwise(x) for d, x in zip(discounts(*found), one)]
        t = counts[k].withColumns({"ctx": F.shiftright("gram", 8), "off": F.when(F.col("n") == 1, one[0]).when(F.col("n") == 2, one[1]).otherwise(one[2])})
        # from whole numbers, so that the result doesn't depend on the order of a sum
        ctx = t.groupBy("fold", "ctx").agg(F.sum("n").alias("total"), F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2"), F.count_if(F.col("n") > 2).alias("n3"))
        ctx = ctx.select("fold", "ctx", "total", ((F.col("n1") * one[0] + F.col("n2") * one[1] + F.col("n3") * one[2]) / F.col("total")).alias("gamma"))
        p = t.join(ctx, ["fold", "ctx"]).withColumn("own", (F.col("n") - F.col("off")) / F.col("total"))
        if lower is None:
            p = p.withColumn("low", F.lit(1 / 256))
        else:
            suffix = F.col("gram").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1))
            p = p.withColumn("suffix", suffix).join(lower.select("fold", F.col("gram").alias("suffix"), F.col("p").alias("low")), ["fold", "suffix"])
        lower = stored(p.select("fold", "gram", (F.col("own") + F.col("gamma") * F.col("low")).alias("p")).withColumn("lp", fixed(F.log("p"))))
        probs.append(lower.select("fold", "gram", "lp"))
        backs.append(stored(ctx.select("fold", F.col("ctx").alias("gram"), fixed(F.log("gamma")).alias("lb"))))
    return Model(order, probs, backs)


class Table:
    """A read-only hash table from unsigned 64-bit keys to 32-bit numbers, looked up by whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.shift = np.uint64(64 - max(8, (4 * len(keys)).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.keys, self.values, self.mask = keys, values.astype(np.int32), size - 1
        self.slots = np.full(size, -1, dtype=np.int32)
        left, at, self.probes = np.arange(len(keys), dtype=np.int32), self._home(keys), 0
        while len(left):
            self.probes += 1
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]  # of several, the last one stays
            out = self.slots[at] != left
            left, at = left[out], (at[out] + 1) & self.mask

    def _home(self, keys):
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values (0 where missing), and whether each key is present."""
        out, found = np.zeros(len(keys), np.int32), np.zeros(len(keys), bool)
        if not len(self.keys):
            return out, found
        at = self._home(keys)
        i = self.slots[at]
        hit = (i >= 0) & (self.keys[i] == keys)
        out[hit], found[hit] = self.values[i[hit]], True
        left = np.flatnonzero(~hit & (i >= 0))
        at = at[left]
        for _ in range(1, self.probes):
            if not len(left):
                break
            at = (at + 1) & self.mask
            i = self.slots[at]
            hit = (i >= 0) & (self.keys[i] == keys[left])
            out[left[hit]], found[left[hit]] = self.values[i[hit]], True
            go = ~hit & (i >= 0)
            left, at = left[go], at[go]
        return out, found


def log_probs(tables, keys: np.ndarray) -> np.ndarray:
    """log p of each n-gram in units of 2**-POINT, backing off through the orders."""
    out = np.zeros(len(keys), dtype=np.int64)
    left = np.arange(len(keys))
    for k in range(len(tables), 0, -1):
        probs, backs = tables[k - 1]
        lp, found = probs.get(keys)
        out[left] += lp
        left, keys = left[~found], keys[~found]
        if not len(left):
            return out
        lb, _ = backs.get(keys >> np.uint64(8))
        out[left] += lb
        keys = keys & np.uint64((1 << 8 * (k - 1)) - 1)
    out[left] += UNKNOWN
    return out


def score(docs: DataFrame, model: Model, most_rows: int = BROADCAST_ROWS, text: bool = True) -> DataFrame:
    """docs (without text unless asked), which has __fold, with __n (bytes) and __nll (their summed negative log probability
    under the other fold's model, or the only one there is)."""
    kept = [f for f in docs.schema if text or f.name != "text"]
    if reduce(DataFrame.union, (t.select("fold") for t in [*model.probs, *model.backs])).count() > most_rows:
        return _score_sharded(docs, model).select(*(f.name for f in kept), "__n", "__nll")
    arrays = [[], []]
    for p, b in zip(model.probs, model.backs):
        pair = [(x.column(0).to_numpy(), x.column(1).to_numpy().astype(np.int64).view(np.uint64), x.column(2).to_numpy()) for x in (p.toArrow(), b.toArrow())]
        for fold in (0, 1):
            arrays[fold].append([(keys[of == fold], values[of == fold]) for of, keys, values in pair])
    arrays = [x if len(x[0][0][0]) else y for x, y in zip(arrays, arrays[::-1])]
    shared, order, names = docs.sparkSession.sparkContext.broadcast(arrays), model.order, [f.name for f in kept]

    def run(batches):
        tables = [[(Table(*p), Table(*b)) for p, b in fold] for fold in shared.value]
        for b in parts(batches):
            n, nll, fold = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64), b.column("__fold").to_numpy()
            for first, keys, off in grams(b.column("text"), order):
                last = first + len(off) - 1
                of = np.repeat(fold[first:last], np.diff(off))
                lp = np.empty(len(keys), np.int64)
                for f in (0, 1):
                    lp[of == f] = log_probs(tables[1 - f], keys[of == f])
                n[first:last], nll[first:last] = np.diff(off), -np.diff(np.concatenate([[0], np.cumsum(lp)])[off])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(n), pa.array(nll / (1 << POINT))], names=[*names, "__n", "__nll"])
        del tables
        give_back()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return docs.mapInArrow(run, f"{schema}, __n bigint, __nll double")


def _score_sharded(docs: DataFrame, model: Model) -> DataFrame:
    """The same by joins: a document's distinct n-grams go to the shards of the tables."""
    keyed = docs.withColumns({"__k": F.xxhash64(F.lit(1), "doc_id", "text"), "__j": F.xxhash64(F.lit(2), "doc_id", "text")})
    order = model.order
    folds = [r[0] for r in model.probs[0].select("fold").distinct().collect()]  # at most 2
    use = 1 - F.col("__fold") if len(folds) > 1 else F.lit(folds[0] if folds else 0)

    def run(batches):
        for b in batches:
            k, j, f = b.column("__k").to_numpy(), b.column("__j").to_numpy(), b.column("fold").to_numpy()
            for first, keys, off in grams(b.column("text"), order):
                for i, (x, y) in enumerate(zip(off[:-1], off[1:])):
                    g, n = np.unique(keys[x:y], return_counts=True)
                    at = first + i
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), k[at])), pa.array(np.full(len(g), j[at])), pa.array(np.full(len(g), f[at])), pa.array(g.view(np.int64)), pa.array(n)], names=["__k", "__j", "fold", "gram", "n"])

    own = keyed.dropDuplicates(["__k", "__j"]).select("__k", "__j", use.cast("int").alias("fold"), "text").mapInArrow(run, "__k bigint, __j bigint, fold int, gram bigint, n bigint")
    distinct = stored(own.select("fold", "gram").distinct())
    open_ = distinct.select("fold", F.col("gram").alias("g0"), "gram", F.lit(0).cast("bigint").alias("acc"))
    done = None
    for k in range(order, 0, -1):
        x = stored(open_.join(model.probs[k - 1], ["fold", "gram"], "left"))
        hit = x.where("lp is not null").select("fold", "g0", (F.col("acc") + F.col("lp")).alias("lp"))
        done = hit if done is None else done.union(hit)
        x = x.where("lp is null").withColumn("ctx", F.shiftright("gram", 8))
        x = x.join(model.backs[k - 1].withColumnRenamed("gram", "ctx"), ["fold", "ctx"], "left")
        open_ = x.select("fold", "g0", F.col("gram").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1)).alias("gram"), (F.col("acc") + F.coalesce("lb", F.lit(0))).alias("acc"))
    done = stored(done.union(open_.select("fold", "g0", (F.col("acc") + F.lit(UNKNOWN)).alias("lp"))))
    sums = own.join(done.withColumnRenamed("g0", "gram"), ["fold", "gram"]).groupBy("__k", "__j").agg(F.sum("n").alias("__n"), (-F.sum(F.col("n") * F.col("lp")) / F.lit(float(1 << POINT))).alias("__nll"))
    out = keyed.join(sums, ["__k", "__j"], "left")
    return out.select(*docs.columns, F.coalesce("__n", F.lit(0)).alias("__n"), F.coalesce("__nll", F.lit(0.0)).alias("__nll"))


def judged(docs: DataFrame, labels: DataFrame, order: int = ORDER, prior: float = PRIOR, quantile: float = QUANTILE, slack: float = SLACK, most_rows: int = BROADCAST_ROWS, text: bool = True) -> DataFrame:
    """docs (without text unless asked) with __n, __perplexity, __threshold and __keep."""
    ids = stored(trusted_ids(labels))
    named = small(ids.withColumnRenamed("doc_id", "__id"))
    docs = with_fold(docs)
    model = train(docs.join(named, docs["doc_id"] == F.col("__id"), "left_semi"), order)
    marked = docs.join(named, docs["doc_id"] == F.col("__id"), "left").withColumn("__good", F.col("__id").isNotNull()).drop("__id")
    marked = stored(score(marked, model, most_rows, text).withColumn("__lang", F.coalesce("lang", F.lit(""))))
    good = marked.where("__good and __n > 0")
    mean = good.groupBy("__lang").agg((F.sum("__nll") / F.sum("__n")).alias("mu"))
    every = good.agg((F.sum("__nll") / F.sum("__n")).alias("mu")).first()["mu"]
    mu = {r["__lang"]: r["mu"] for r in mean.collect()}  # a row per language
    if every is None:
        return marked.withColumns({"__perplexity": F.lit(None).cast("double"), "__threshold": F.lit(None).cast("double"), "__keep": F.lit(True)})
    per_lang = lambda found, rest: F.coalesce(*([F.create_map(*(F.lit(x) for kv in found.items() for x in kv))[F.col("__lang")]] if found else []), F.lit(rest))
    mean_of = per_lang(mu, every)
    rated = marked.withColumn("__rate", (F.col("__nll") + prior * mean_of) / (F.col("__n") + prior))
    good = rated.where("__good and __n > 0")
    cuts = {r["__lang"]: r["c"] for r in good.groupBy("__lang").agg(F.percentile_approx("__rate", F.lit(quantile), F.lit(10000)).alias("c")).collect()}
    all_cut = good.agg(F.percentile_approx("__rate", F.lit(quantile), F.lit(10000))).first()[0]
    return rated.withColumn("__cut", per_lang(cuts, all_cut) * slack).withColumns(
        {"__perplexity": F.exp("__rate"), "__threshold": F.exp("__cut"), "__keep": F.col("__rate") <= F.col("__cut")}
    )


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, lang, n_bytes, perplexity, threshold, keep for every row."""
    out = judged(docs.select("doc_id", "lang", "text"), labels, text=False, **options)
    return out.select("doc_id", "lang", F.col("__n").alias("n_bytes"), F.col("__perplexity").alias("perplexity"), F.col("__threshold").alias("threshold"), F.col("__keep").alias("keep"))


def filter_quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows that aren't rejected, columns as given."""
    own = aliased(docs, "doc_id", "lang", "text")
    return restored(judged(own, labels, **options).where("__keep"), own, docs)
