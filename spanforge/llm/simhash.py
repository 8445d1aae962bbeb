"""SimHash near-duplicates by multi-index hashing.

A fingerprint has 64 bits over 4-word shingles (XXH64, seed 42). Distinct fingerprints are cut into
segments; by the pigeonhole rule two fingerprints at most `radius` bits apart agree in one segment up to
that segment's share of the radius. Each fingerprint is entered in the table of each segment once and
looks up the small Hamming ball around its segment; what it meets there is verified on all 64 bits. An entry
that very many fingerprints share is split by further parts of them, one of which two linked ones share.
Within a table entry only the edges of a spanning forest leave the task, so a dense group of n near
copies gives at most n rows and never all pairs. Links become components by alternating large-star and
small-star steps, which never gather a component in one place.

Edge cases: null text is a text without words (fingerprint zero, linked like any other); fewer than four
words: the whole sequence is the only shingle; a null doc_id takes part but is never a component id
unless its whole component has null ids; extra columns are ignored; an empty table gives no rows;
repeated rows each get a row.
"""

from __future__ import annotations

import itertools
from math import ceil, log, log1p

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.llm.common import aliased, give_back, mix, parts, restored, small, stored

SHINGLE, RADIUS = 4, 4
#: Fingerprints that enter one table entry before it is split.
CROWDED = 100_000


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """Fingerprint of one text, unsigned."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes.lower: A-Z only; bytes.split: ASCII white space only
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= width:
        return xxhash.xxh64_intdigest(joined, 42)
    edge = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = [0, *edge[: n - width].tolist()]
    ends = (edge[width - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends)], dtype=">u8")
    set_bits = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 1 << 16):
        set_bits += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(set_bits * 2 > len(h)).tobytes(), "big")


def with_fingerprint(docs: DataFrame, columns: list[str], width: int = SHINGLE, out: str = "fp") -> DataFrame:
    """The named columns (text among the table's) and the fingerprint as a signed long."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema), f"`{out}` bigint"])

    def run(batches):
        for b in parts(batches):
            fps = np.array([fingerprint(t, width) for t in b.column("text").to_pylist()], dtype=np.uint64).view(np.int64)
            cols = {c: b.column(c) for c in columns}
            yield pa.RecordBatch.from_arrays([*cols.values(), pa.array(fps)], names=[*cols, out])

    return docs.select(*dict.fromkeys([*columns, "text"])).mapInArrow(run, schema)


def segment_plan(radius: int = RADIUS, segments: int = 3, bits: int = 64) -> list[tuple[int, int, int]]:
    """(shift, width, ball radius) of each segment. The ball radii r_i satisfy sum(r_i + 1) = radius + 1
    or the nearest larger sum, so that at most `radius` differing bits can't exceed every r_i."""
    share = [(radius + 1) // segments + (i < (radius + 1) % segments) for i in range(segments)]
    out, shift = [], 0
    for i, s in enumerate(share):
        width = (bits - shift) // (segments - i)
        if s:
            out.append((shift, width, s - 1))
        shift += width
    return out


def segments_for(n: int) -> int:
    """Segments for n distinct fingerprints: three of 21 bits while their tables hold few rows an entry, then two
    of 32 bits with larger balls. Both find every link."""
    return 3 if n < 1 << 27 else 2


def ball(width: int, radius: int) -> np.ndarray:
    """All masks of up to `radius` bits, zero first."""
    return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in itertools.combinations(range(width), r)], dtype=np.uint64)


def _near(x, y, radius: int, limit: int):
    """Whether rows of x and y (fingerprint, then signature words) are linked."""
    near = np.bitwise_count(x[..., 0] ^ y[..., 0]) <= radius
    if x.shape[-1] > 1:
        near = near & (np.bitwise_count(x[..., 1:] ^ y[..., 1:]).sum(axis=-1, dtype=np.int64) <= limit)
    return near


def _forest(rows: np.ndarray, own: np.ndarray, radius: int, limit: int) -> list[tuple[int, int]]:
    """Edges (indices) of a spanning forest of the links that have an owner at one end: a breadth-first search
    that compares a visited row only with those not yet visited, and a guest only with owners."""
    edges, left = [], np.concatenate([np.flatnonzero(own), np.flatnonzero(~own)])
    owners = int(own.sum())  # owners stand first in left
    while owners and len(left) > 1:
        front, left, owners = [int(left[0])], left[1:], owners - 1
        while front and len(left):
            x = front.pop()
            reach = left if own[x] else left[:owners]
            near = _near(rows[x], rows[reach], radius, limit)
            if near.any():
                found = reach[near]
                edges += [(x, int(y)) for y in found]
                front += found.tolist()
                gone = np.zeros(len(left), bool)
                gone[: len(reach)] = near
                owners -= int(gone[:owners].sum())
                left = left[~gone]
    return edges


def node(rows: np.ndarray) -> np.ndarray:
    """One number for each row: the fingerprint itself, or a hash of fingerprint and signature."""
    if rows.shape[1] == 1:
        return rows[:, 0].copy()
    out = np.zeros(len(rows), dtype=np.uint64)
    for i in range(rows.shape[1]):
        out = mix(out ^ (rows[:, i] + np.uint64((i + 1) * 0x9E3779B97F4A7C15 % 2**64)))
    return out


def links(fps: DataFrame, radius: int = RADIUS, segments: int = 3, limit: int = 0) -> DataFrame:
    """Edges (a, b) between nodes whose components equal those of all links. fps: distinct rows of a
    fingerprint `fp` and any number of signature columns, which together may differ in `limit` bits."""
    plan = segment_plan(radius, segments)
    balls = [ball(w, r) for _, w, r in plan]
    words = fps.columns

    def probe(batches):
        for b in batches:
            x = np.stack([b.column(i).to_numpy().view(np.uint64) for i in range(len(words))], axis=1)
            for at in range(0, len(x), 4096):
                y = x[at : at + 4096]
                for i, ((shift, width, _), masks) in enumerate(zip(plan, balls)):
                    value = (y[:, 0] >> np.uint64(shift)) & np.uint64((1 << width) - 1)
                    keys = value[:, None] ^ masks[None, :] | np.uint64(i << 56)
                    own = np.zeros(keys.shape, dtype=bool)
                    own[:, 0] = True
                    cols = [keys.ravel().view(np.int64), own.ravel(), *(np.repeat(y[:, j], len(masks)).view(np.int64) for j in range(len(words)))]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["k", "own", *words])

    def group(k, own, rows):
        """Edges within complete groups; k is sorted."""
        out = []
        cut = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1], [True]]))
        size = np.diff(cut)
        pick = (size > 1) & (np.add.reduceat(own.astype(np.int64), cut[:-1]) > 0)
        few = pick & (size <= 16)
        # few members: compare each with the next ones of its group, all groups at once
        member = np.repeat(few, size)
        for step in range(1, 16):
            at = np.flatnonzero(member[:-step] & (k[step:] == k[:-step]))
            if not len(at):
                break
            at = at[_near(rows[at], rows[at + step], radius, limit)]
            out.append(np.stack([at, at + step], axis=1))
        for g in np.flatnonzero(pick & ~few):
            part = slice(cut[g], cut[g + 1])
            e = _forest(rows[part], own[part], radius, limit)
            if e:
                out.append(np.array(e, dtype=np.int64) + cut[g])
        at = np.concatenate(out) if out else np.zeros((0, 2), dtype=np.int64)
        return np.stack([node(rows[at[:, 0]]), node(rows[at[:, 1]])], axis=1)

    def verify(batches):
        rest = None
        for b in batches:
            part = [b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False), np.stack([b.column(i + 2).to_numpy().view(np.uint64) for i in range(len(words))], axis=1)]
            if rest is not None:
                part = [np.concatenate(x) for x in zip(rest, part)]
            if not len(part[0]):
                continue
            cut = int(np.searchsorted(part[0], part[0][-1]))
            rest = [x[cut:] for x in part]
            if cut:
                yield batch(group(*(x[:cut] for x in part)))
        if rest is not None:
            yield batch(group(*rest))

    def batch(e):
        e = np.unique(np.sort(e.view(np.int64), axis=1), axis=0) if len(e) else e.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(e[:, 0])), pa.array(np.ascontiguousarray(e[:, 1]))], names=["a", "b"])

    probes = fps.mapInArrow(probe, "k bigint, own boolean, " + ", ".join(f"`{c}` bigint" for c in words))
    fp = F.col(words[0])
    entered = F.array(*(F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1)).bitwiseOR(F.lit(i << 56)) for i, (shift, width, _) in enumerate(plan)))
    crowded = stored(fps.select(F.explode(entered).alias("k")).groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > CROWDED).select("k", F.lit(True).alias("crowded")))
    if not crowded.isEmpty():
        # of radius + 1 parts of two linked fingerprints one is equal: a crowded entry is split by each part's value
        edges = [64 * j // (radius + 1) for j in range(radius + 2)]
        split = F.array(*(F.xxhash64("k", F.lit(j), F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << b - a) - 1))) for j, (a, b) in enumerate(zip(edges, edges[1:]))))
        probes = probes.join(small(crowded), "k", "left").select(F.explode(F.when(F.col("crowded"), split).otherwise(F.array("k"))).alias("k"), "own", *words)
    return probes.repartition("k").sortWithinPartitions("k").mapInArrow(verify, "a bigint, b bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge; root is the component's smallest node."""
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        e = stored(
            large.join(low2, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(low2.select("a", F.col("m").alias("b"))).distinct()
        )
        now = e.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if now == seen:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b"), F.col("b")).distinct())
        seen = now


def near_dup_components(docs: DataFrame, radius: int = RADIUS, segments: int | None = None, width: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs."""
    marked = stored(with_fingerprint(docs, ["doc_id"], width))
    fps = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    roots = stored(components(links(fps.select("fp"), radius, segments or segments_for(fps.count()))))
    rooted = fps.join(roots, fps.fp == roots.node, "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


# ---- near copies by similarity, for filtering ----------------------------------------------------------

#: Two documents are near copies if the sets of their 5-word shingles have a Jaccard similarity of 0.8 or more, read
#: from the shingles' 64-bit hashes. Candidates come from a SimHash of the same sets, as many words of 64 bits as its search
#: needs. Two sets at 0.8 or more differ in a bit with probability FLIP at most, whatever their sizes, but for four shingles of
#: which a fifth is added (FLIP_TINY): the exact maximum over all sizes up to 160, and 0.152 from there to 800. Multi-index
#: hashing: tables of segments as wide as the number of documents asks for, so many of them that a pair agrees in none with
#: probability MISS at most. What meets in an entry is compared on CHECK words of its own, of whose 128 bits at most CHECK_LIMIT
#: may differ (a pair exceeds that with probability 2e-5 at FLIP, 9e-4 at FLIP_TINY). These links give components, and within each the
#: sets themselves decide.
SIMILAR_SHINGLE, MISS, FLIP, FLIP_TINY = 5, 1e-4, 0.162, 0.1875
CHECK, CHECK_LIMIT = 2, 38
#: Nodes that one task compares with each other, and the shingles that these may have.
BLOCK, VOLUME = 4096, 1 << 20
SIMILAR = (4, 5)  # as a fraction, so that no rounding decides
_mixers = np.random.Generator(np.random.PCG64(20240301)).integers(0, 2**64, size=(4096, 2), dtype=np.uint64).T


def shingles(text: str | None, width: int = SIMILAR_SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; fewer words than `width` are one shingle, no words none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    n = max(1, len(words) - width + 1)
    joined = b" ".join(words)
    edge = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)])
    digest = xxhash.xxh3_64_intdigest
    spans = zip(edge[:n].tolist(), (edge[min(width, len(words)) :] - 1).tolist())
    return np.unique(np.fromiter((digest(joined[x:y]) for x, y in spans), np.uint64, n))


def set_node(kinds: np.ndarray) -> int:
    """One number (signed) for a set of shingles."""
    return xxhash.xxh3_64_intdigest(kinds.tobytes()) - (1 << 63)


def segment_tables(n: int) -> tuple[int, int, int]:
    """(width, tables, tables of sets of four or five shingles) for n documents: up to 512 unrelated ones in an entry."""
    width = 12 + 4 * max(0, -(-(n.bit_length() - 21) // 4))
    return width, *(ceil(log(MISS) / log1p(-((1 - flip) ** width))) for flip in (FLIP, FLIP_TINY))


def signature(kinds: np.ndarray, words: int) -> np.ndarray:
    """SimHash of a set of shingles: a bit is 1 if set in over half of the shingles' hashes."""
    ones = np.zeros(64 * words, dtype=np.int64)
    for i in range(0, len(kinds), 255):  # whose sums fit a byte
        h = mix((kinds[i : i + 255, None] ^ _mixers[0, :words]) * (_mixers[1, :words] | np.uint64(1)))
        ones += np.add.reduce(np.unpackbits(h.view(np.uint8), axis=1), axis=0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(kinds)).view(np.int64)


def segment_keys(sig: str, width: int, tables: int) -> Column:
    """The entries of a signature, one in each table."""
    each = 64 // width
    word = lambda i: F.get(sig, F.lit(CHECK + i // each))
    return F.array(*(F.shiftrightunsigned(word(i), i % each * width).bitwiseAND(F.lit((1 << width) - 1)).bitwiseOR(F.lit(i << 40)) for i in range(tables)))


def _alike(rows: np.ndarray) -> np.ndarray:
    """Pairs (indices) of rows of CHECK words that differ in CHECK_LIMIT bits or fewer; of many rows, a spanning forest of them."""
    if len(rows) <= 64:
        far = np.bitwise_count(rows[:, None] ^ rows[None, :]).sum(axis=2, dtype=np.uint8)
        return np.argwhere(np.triu(far <= CHECK_LIMIT, 1))
    blank = np.zeros((len(rows), 1), dtype=np.uint64)  # no bound on the first word alone
    return np.array(_forest(np.hstack([blank, rows]), np.ones(len(rows), bool), 64, CHECK_LIMIT), dtype=np.int64).reshape(-1, 2)


def alike_links(nodes: DataFrame, n: int) -> DataFrame:
    """Edges (a, b) between numbers (node()) of CHECK words, whose components are those of all pairs that meet in an entry of a table
    and differ in CHECK_LIMIT bits or fewer of these words. nodes: (sig, tiny); n: about their number.

    An entry that over CROWDED nodes share, judged by a sixteenth of them, is dealt into blocks, each pair of which is one entry."""
    width, tables, more = segment_tables(n)
    keys = F.when(F.col("tiny"), segment_keys("sig", width, more)).otherwise(segment_keys("sig", width, tables))
    words = [f"c{i}" for i in range(CHECK)]
    keyed = nodes.select(*(F.get("sig", F.lit(i)).alias(c) for i, c in enumerate(words)), F.explode(keys).alias("k"))

    def group(k, rows):
        cut = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1], [True]]))
        size, out = np.diff(cut), []
        member = np.repeat((size > 1) & (size <= 64), size)
        for step in range(1, 64):  # few members: compare each with the next ones of its entry, all entries at once
            at = np.flatnonzero(member[:-step] & (k[step:] == k[:-step]))
            if not len(at):
                break
            at = at[np.bitwise_count(rows[at] ^ rows[at + step]).sum(axis=1, dtype=np.uint8) <= CHECK_LIMIT]
            out.append(np.stack([at, at + step], axis=1))
        out += [_alike(rows[x : x + m]) + x for x, m in zip(cut[:-1][size > 64].tolist(), size[size > 64].tolist())]
        at = np.concatenate(out) if out else np.zeros((0, 2), dtype=np.int64)
        e = np.stack([node(rows[at[:, 0]]), node(rows[at[:, 1]])], axis=1).view(np.int64)
        e = np.unique(np.sort(e[e[:, 0] != e[:, 1]], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(e[:, i])) for i in range(2)], names=["a", "b"])

    def meet(batches):
        rest = None
        for b in batches:
            part = [b.column(0).to_numpy(), np.stack([b.column(i + 1).to_numpy().view(np.uint64) for i in range(CHECK)], axis=1)]
            if rest is not None:
                part = [np.concatenate(x) for x in zip(rest, part)]
            if not len(part[0]):
                continue
            cut = int(np.searchsorted(part[0], part[0][-1]))
            rest = [x[cut:] for x in part]
            if cut:
                yield group(*(x[:cut] for x in part))
        if rest is not None:
            yield group(*rest)
        give_back()

    if n > CROWDED:
        some = keyed.where(F.pmod(F.xxhash64(*words), F.lit(16)) == 0).groupBy("k").agg((16 * F.count("*")).alias("n"))
        crowded = stored(some.where(F.col("n") > CROWDED).select("k", F.ceil(2 * F.col("n") / CROWDED).cast("int").alias("blocks")))
        if not crowded.isEmpty():
            keyed = keyed.join(small(crowded), "k", "left").withColumn("x", F.pmod(F.xxhash64(F.lit(4), *words), F.col("blocks")))
            pair = lambda y: F.xxhash64("k", F.least("x", y.cast("bigint")), F.greatest("x", y.cast("bigint")))
            split = F.when(F.col("blocks").isNull(), F.array("k")).otherwise(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), pair))
            keyed = keyed.select(*words, F.explode(split).alias("k"))
    return keyed.select("k", *words).repartition("k").sortWithinPartitions("k").mapInArrow(meet, "a bigint, b bigint").distinct()


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two sets share (indices i < j; the rest has no meaning). Shingles of many sets by products of
    matrices, those of few by their pairs of sets, those of one not at all."""
    n = len(sets)
    row = np.repeat(np.arange(n), [len(x) for x in sets])
    _, at, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    out = np.zeros((n, n), dtype=np.float32 if max(map(len, sets)) < 1 << 24 else np.float64)  # whole numbers, exactly
    many = df * 32 > n
    many &= df > 1
    place = np.cumsum(many) - 1
    for first in range(0, int(many.sum()), 1024):
        some = np.flatnonzero(many[at] & (place[at] >= first) & (place[at] < first + 1024))
        part = np.zeros((n, min(1024, int(many.sum()) - first)), dtype=out.dtype)
        part[row[some], place[at[some]] - first] = 1
        out += part @ part.T
    few = np.flatnonzero(((df > 1) & ~many)[at])
    few = few[np.lexsort((row[few], at[few], df[at[few]]))]
    for m in np.unique(df[at[few]]).tolist():
        holders = row[few[df[at[few]] == m]].reshape(-1, m)
        i, j = np.triu_indices(m, 1)
        step = max(1, (1 << 20) // len(i))
        for first in range(0, len(holders), step):
            some = holders[first : first + step]
            np.add.at(out.reshape(-1), (some[:, i] * n + some[:, j]).ravel(), 1)
    return out


def _similar_forest(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Edges (indices) of a spanning forest of all pairs with a similarity of SIMILAR or more."""
    top, bottom = SIMILAR
    n, size = len(sets), np.array([len(x) for x in sets], dtype=np.int64)
    if n < 2:
        return []
    both, near = _overlaps(sets), np.zeros((n, n), dtype=bool)
    for i in range(0, n, 256):  # shared / (sum - shared) >= top / bottom
        least = -(-top * (size[i : i + 256, None] + size[None, :]) // (top + bottom))
        near[i : i + 256] = np.triu(both[i : i + 256] >= np.maximum(least, 1), i + 1)
    del both
    near |= near.T
    edges, left = [], np.ones(n, dtype=bool)
    for start in range(n):
        if not left[start]:
            continue
        front, left[start] = [start], False
        while front:
            x = front.pop()
            found = np.flatnonzero(near[x] & left)
            left[found] = False
            edges += [(x, int(y)) for y in found]
            front += found.tolist()
    return edges


def _verified(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges (a, b) whose components equal those of all pairs in one bucket with a similarity of SIMILAR or more. members:
    (bucket, node), distinct, a bounded number in a bucket; sets: (node, kinds)."""

    def verify(group):
        nodes = group.column("node").to_numpy()
        order = np.argsort(nodes, kind="stable")
        column = group.column("kinds").combine_chunks()
        e = np.array(_similar_forest([column[int(i)].values.to_numpy().view(np.uint64) for i in order]), dtype=np.int64).reshape(-1, 2)
        return pa.table({"a": nodes[order][e[:, 0]], "b": nodes[order][e[:, 1]]})

    return members.join(sets, "node").select("bucket", "node", "kinds").groupBy("bucket").applyInArrow(verify, "a bigint, b bigint").distinct()


def _blocks(n: str, volume: str, most: int = 1) -> Column:
    """Blocks for n nodes with so many shingles, `most` to a bucket."""
    return F.greatest(F.lit(1), F.ceil(F.greatest(F.col(n) * most / BLOCK, F.col(volume) * most / VOLUME))).cast("int")


def _block(blocks: Column, seed: int) -> Column:
    """The block of a node."""
    return F.pmod(F.xxhash64(F.lit(seed), "node"), blocks).cast("int")


def _grouped(members: DataFrame) -> DataFrame:
    """(k, n, volume, blocks) of the keys that several members (k, node, size) share."""
    return stored(members.groupBy("k").agg(F.count("*").alias("n"), F.sum("size").alias("volume"), F.min("node").alias("centre")).where("n > 1").withColumn("blocks", _blocks("n", "volume")))


def _by_rare(many: DataFrame, sets: DataFrame) -> DataFrame:
    """(k, node, size) with narrower keys for many (k, node, size, blocks): two sets at SIMILAR share one of the rarest
    shingles of both (of a shingles, a fifth and one more, in order of how many sets of the key hold them), so nodes joined by these are the
    new keys. Nodes of whose rarest no other holds any have no link and are left out. The shingles are dealt by their hashes, about
    VOLUME to a task, and travel in packs: rows and bytes grow in proportion to the sets, whatever the sizes of the groups."""
    top, bottom = SIMILAR

    def deal(batches):
        for b in parts(batches, 64):
            column = b.column("kinds")
            own = np.repeat(np.arange(b.num_rows), pa.compute.list_value_length(column).to_numpy())
            kinds = column.flatten().to_numpy()
            k, nodes, blocks = (b.column(c).to_numpy()[own] for c in ("k", "node", "blocks"))
            shard = (mix(kinds.view(np.uint64)) % blocks.astype(np.uint64)).astype(np.int32)
            order = np.lexsort((shard, k))
            k, shard = k[order], shard[order]
            new = (k[1:] != k[:-1]) | (shard[1:] != shard[:-1])
            cut = np.flatnonzero(np.concatenate([[True], new, [True]])) if len(k) else np.zeros(1, np.int64)
            packs = [pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(x[order])) for x in (nodes, kinds)]
            yield pa.RecordBatch.from_arrays([pa.array(k[cut[:-1]]), pa.array(shard[cut[:-1]]), *packs], names=["k", "shard", "nodes", "kinds"])

    def count(group):
        nodes, kinds = (group.column(c).combine_chunks().flatten().to_numpy() for c in ("nodes", "kinds"))
        _, at, df = np.unique(kinds, return_inverse=True, return_counts=True)
        some = np.flatnonzero(df[at] > 1)
        some = some[np.argsort(nodes[some], kind="stable")]
        node, first = np.unique(nodes[some], return_index=True)
        cut = pa.array(np.append(first, len(some)).astype(np.int32))
        return pa.table({"node": node, "df": pa.ListArray.from_arrays(cut, pa.array(df[at[some]])), "kind": pa.ListArray.from_arrays(cut, pa.array(kinds[some]))})

    dealt = many.join(sets, "node").select("k", "node", "blocks", "kinds").mapInArrow(deal, "k bigint, shard int, nodes array<bigint>, kinds array<bigint>")
    found = dealt.groupBy("k", "shard").applyInArrow(count, "node bigint, df array<bigint>, kind array<bigint>")
    common = found.groupBy("node").agg(F.flatten(F.collect_list(F.arrays_zip("df", "kind"))).alias("common"))
    most = F.floor(F.col("size") * (bottom - top) / bottom) + 1 - (F.col("size") - F.size("common"))  # of the common ones
    rare = many.join(common, "node").withColumn("most", F.greatest(F.lit(0), most).cast("int"))
    rare = rare.select("k", "node", "size", F.slice(F.array_sort("common"), F.lit(1), F.col("most")).alias("rare"))
    keys = rare.select("node", F.explode("rare.kind").alias("kind"), "k").select(F.col("node").alias("a"), F.xxhash64("k", "kind").alias("b"))
    roots = stored(components(keys)).select(F.col("node").alias("of"), F.col("root").alias("k"))
    return many.select("node", "size").join(roots, F.col("node") == F.col("of")).select("k", "node", "size")


def similar_links(entries: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges (a, b) whose components equal those of all pairs with a common key and a similarity of SIMILAR or more.
    entries: (k, node), distinct; sets: (node, kinds) of the nodes that share a key with another.

    Keys of up to BLOCK nodes and VOLUME shingles are buckets. A larger one is parted by its rarest shingles. The nodes of a part
    that is still too large are dealt into blocks, each with the part's least node and half as many others, the hubs: a group of copies is joined by its
    links to the hubs, whatever its size. Where that leaves nodes in several components, the nodes outside the largest one meet all the others, block by block."""
    sized = stored(entries.join(sets.select("node", F.size("kinds").alias("size")), "node").select("k", "node", "size"))
    counts = _grouped(sized)
    bucket = F.xxhash64(F.lit("key"), "k").alias("bucket")
    buckets = sized.join(counts.where("blocks = 1").select("k"), "k", "left_semi").select(bucket, "node")
    frequent = counts.where("blocks > 1").select("k", "blocks")
    if frequent.isEmpty():
        return stored(_verified(buckets, sets))
    many = stored(_by_rare(stored(sized.join(small(stored(frequent)), "k")), sets))
    counts = _grouped(many)
    buckets = buckets.union(many.join(small(stored(counts.where("blocks = 1").select("k"))), "k", "left_semi").select(bucket, "node"))
    frequent = stored(counts.where("blocks > 1"))
    if frequent.isEmpty():
        return stored(_verified(buckets, sets))
    many = stored(many.join(small(frequent), "k"))
    hubs = many.where((F.col("node") == F.col("centre")) | (_block(2 * F.col("blocks"), 4) == 0))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    spokes = many.select("k", "node", _block(F.col("blocks"), 1).alias("block")).union(hubs.select("k", "node", every.alias("block")))
    spokes = spokes.select(F.xxhash64(F.lit("spokes"), "k", "block").alias("bucket"), "node").distinct()
    edges = stored(_verified(buckets.union(spokes), sets))

    # what the hubs didn't join
    roots = components(edges).select(F.col("node").alias("of"), "root")
    placed = stored(many.join(roots, many["node"] == F.col("of"), "left").select("k", "n", "volume", "node", "size", F.coalesce("root", "node").alias("root")))
    groups = stored(placed.groupBy("k", "root").agg(F.count("*").alias("nodes"), F.sum("size").alias("shingles")))
    split = groups.groupBy("k").agg(F.max(F.struct("nodes", "shingles", "root")).alias("largest"), F.sum("nodes").alias("nodes"), F.sum("shingles").alias("shingles"), F.count("*").alias("parts")).where("parts > 1")
    split = stored(split.select("k", F.col("largest.root").alias("largest"), (F.col("nodes") - F.col("largest.nodes")).alias("outside"), (F.col("shingles") - F.col("largest.shingles")).alias("outside_volume")))
    if split.isEmpty():
        return edges
    placed = placed.join(small(split), "k").withColumn("xs", _blocks("outside", "outside_volume", 2)).withColumn("ys", _blocks("n", "volume", 2))
    to = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    outer = placed.where("root <> largest").select("k", "node", _block(F.col("xs"), 2).alias("x"), to("ys").alias("y"))
    other = placed.select("k", "node", to("xs").alias("x"), _block(F.col("ys"), 3).alias("y"))
    pairs = outer.union(other).select(F.xxhash64(F.lit("pairs"), "k", "x", "y").alias("bucket"), "node").distinct()
    return edges.union(stored(_verified(pairs, sets)))


def similar_components(docs: DataFrame) -> DataFrame:
    """(node, least, component): a row for each distinct set of shingles, with the least (doc_id, th) that has it, th a hash of
    the text, among documents with an id, and the least node reachable. Equal sets are one row before anything is joined."""
    n = docs.count()
    width, *tables = segment_tables(n)
    words, most = (CHECK + ceil(x / (64 // width)) for x in tables)

    def run(batches):
        for b in parts(batches):
            sets = [shingles(t) for t in b.column("text").to_pylist()]
            ids = np.array([set_node(x) for x in sets], dtype=np.int64)
            sigs = [signature(x, most if len(x) in (4, 5) else words) if len(x) else None for x in sets]
            fps = node(np.stack([np.zeros(CHECK, np.int64) if x is None else x[:CHECK] for x in sigs]).view(np.uint64)).view(np.int64) if sigs else ids
            tiny = pa.array([len(x) in (4, 5) for x in sets], pa.bool_())
            rows = [b.column("doc_id"), b.column("th"), pa.array(ids), pa.array(sigs, pa.list_(pa.int64())), pa.array(fps), tiny]
            yield pa.RecordBatch.from_arrays(rows, names=["doc_id", "th", "node", "sig", "fp", "tiny"])

    def hashed(batches):
        for b in parts(batches):
            rows = [shingles(t).view(np.int64) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(rows, pa.list_(pa.int64()))], names=["node", "kinds"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    marked = docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(run, f"doc_id {kind}, th bigint, node bigint, sig array<bigint>, fp bigint, tiny boolean")
    text = F.struct("doc_id", "th")
    nodes = stored(marked.groupBy("node").agg(F.min("sig").alias("sig"), F.min("fp").alias("fp"), F.min("tiny").alias("tiny"), F.min(text).alias("any"), F.min(F.when(F.col("doc_id").isNotNull(), text)).alias("least")))
    # a component of alike fingerprints is one key
    some = nodes.where("sig is not null")
    alike = stored(components(alike_links(some.select("sig", "tiny"), n))).select(F.col("node").alias("of"), "root")
    entries = stored(some.join(alike, some["fp"] == F.col("of"), "left").select("node", F.coalesce("root", "fp").alias("k")))
    shared = entries.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k")
    entries = stored(entries.join(shared, "k", "left_semi"))
    # one text of each node that shares a key
    one = nodes.join(entries.select("node").distinct(), "node", "left_semi")
    one = stored(one.select("node", F.col("any.doc_id").alias("one_id"), F.col("any.th").alias("one_th")))
    same = (F.col("th") == F.col("one_th")) & F.col("doc_id").eqNullSafe(F.col("one_id"))
    texts = docs.select("doc_id", F.xxhash64("text").alias("th"), "text").join(small(one), same).select("node", "text")
    sets = stored(texts.mapInArrow(hashed, "node bigint, kinds array<bigint>").dropDuplicates(["node"]))
    roots = stored(components(similar_links(entries, sets))).withColumnRenamed("node", "n")
    return nodes.join(roots, nodes["node"] == F.col("n"), "left").select("node", "least", F.coalesce("root", "node").alias("component"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies: the one with the smallest doc_id (ties: smallest hash of the
    text, then one of the equal rows). Columns as given. Rows with a null doc_id always stay."""
    keep = similar_components(docs).where("least is not null").groupBy("component").agg(F.min("least").alias("r"))
    keep = stored(keep.select(F.col("r.doc_id").alias("keep_id"), F.col("r.th").alias("keep_th")))
    own = aliased(docs, "doc_id", "text")
    mine = (F.col("doc_id") == F.col("keep_id")) & (F.xxhash64("text") == F.col("keep_th"))
    # rows that share id and text are told apart by their place among themselves; there seldom are any
    times = docs.select("doc_id", F.xxhash64("text").alias("th")).groupBy("doc_id", "th").agg(F.count("*").alias("n")).where("n > 1 and doc_id is not null")
    again = stored(times.join(keep, (F.col("doc_id") == F.col("keep_id")) & (F.col("th") == F.col("keep_th"))).select("keep_id", "keep_th"))
    alone = restored(_alone(own, keep, again, mine), own, docs).union(docs.where(docs["doc_id"].isNull()))
    if again.isEmpty():
        return alone
    equal = own.join(small(again), mine, "left_semi").withColumn("th", F.xxhash64("text"))
    order = F.row_number().over(Window.partitionBy("doc_id", "th").orderBy("doc_id"))
    return alone.union(restored(equal.withColumn("nth", order).where("nth = 1"), own, docs))


def _alone(own: DataFrame, keep: DataFrame, again: DataFrame, mine: Column) -> DataFrame:
    """The rows to keep whose id and text no other row has."""
    single = keep if again.isEmpty() else stored(keep.join(again, ["keep_id", "keep_th"], "left_anti"))
    return own.join(small(single), mine, "left_semi")


def op7(docs: DataFrame) -> DataFrame:
    return near_dup_components(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
