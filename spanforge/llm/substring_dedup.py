"""Repeated passages: every word covered by a 35-word window that also starts elsewhere is removed.

Equal texts are found first, by a 128-bit hash: each of them is covered wholly, and one of them stands
for all in what follows. The texts are then dealt, once, into groups of some megabytes, and the groups are
gone through three times, vectorised over Arrow buffers:

1. Each group counts its windows in a partial count-min sketch of `ROWS` rows and sends the cells that it
   touched to the shards of the sketch. A task per shard merges them: a cell that was reached twice or more
   is "repeated". Counts are over-estimated by collisions, never under-estimated, so no repeated window is
   lost. The shard answers every group with one bit for each cell that the group sent.
2. With these answers a group knows the estimate of each of its windows, the least of its rows' cells. Only windows
   that are repeated in all rows go on. They are grouped by a 96-bit hash of their word sequence - first inside
   the group, so that a passage copied a million times leaves a group as one row, then across groups - and
   groups of one are dropped.
3. Covered ranges come back to their texts.

The sketch's cells, its shards and the groups grow with the input's bytes, so that a task's share and the rate of
windows that pass without being repeated stay the same; nothing is broadcast or sent to the driver.

Edge cases: null text has no words; fewer than 35 words: no window, nothing is removed; repeated rows
count as places of their own; a null doc_id is kept as null; rows that share a doc_id but not a text are
told apart by a hash of the text; words are bytes between ASCII white space, unchanged; doc_id may be of any
type; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import chunks, give_back, mix, powers, small, stored, text_buffer, word_hashes, word_spans

WINDOW, ROWS = 35, 2
#: Text of a group, text that one shard counts the windows of (about one window in six bytes), and cells a shard and row.
GROUP_BYTES, SHARD_BYTES, SHARD_BITS = 8 << 20, 24 << 20, 24
GROUPS_PER_TASK = 8


def windows(col: pa.Array, width: int, rows: int):
    """For each run of rows: (first row, hashes [rows][n], row of each window, first word of each window)."""
    for a, b in chunks(col):
        data, off = text_buffer(col.slice(a, b - a))
        starts, ends, first = word_spans(data, off)
        n = np.diff(first) - width + 1
        n[n < 0] = 0
        total = int(n.sum())
        if not total:
            continue
        doc = np.repeat(np.arange(b - a), n)
        pos = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(first[:-1], n) + pos
        hashes = []
        for r in range(rows):
            w = word_hashes(data, starts, ends, r)
            pw, ipw = powers(0xC2B2AE3D27D4EB4F if r == 0 else 0x9FB21C651E98DF25, len(w))
            c = np.zeros(len(w) + 1, dtype=np.uint64)
            np.cumsum(w * pw[: len(w)], out=c[1:])
            hashes.append(mix((c[at + width] - c[at]) * ipw[at]))
        yield a, hashes, doc, pos


def _planes(x: np.ndarray) -> bytes:
    """Sorted cells as differences, byte planes apart: the shuffle's compression removes the empty ones."""
    return np.diff(x, prepend=np.uint32(0)).astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()


def _cells(b: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(b, dtype=np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel(), dtype=np.uint32)


def shards_for(size: int) -> int:
    """log2 of the number of shards of a row, for so many bytes of text."""
    return max(0, -(-size // SHARD_BYTES) - 1).bit_length()


def _touched(hashes: np.ndarray, bits: int) -> np.ndarray:
    return hashes >> np.uint64(64 - bits)


def _by_shard(cells: np.ndarray):
    """(shard, slice) of sorted cells."""
    shard = cells >> np.uint64(SHARD_BITS)
    cut = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]])) if len(cells) else np.zeros(1, int)
    return [(int(shard[a]), slice(a, b)) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]


_LOW = np.uint64((1 << SHARD_BITS) - 1)


def answers(texts: DataFrame, shards: int, width: int = WINDOW) -> DataFrame:
    """(group, row, shard, bits): whether the merged sketch counted two or more windows, a bit for each distinct cell that
    the group's windows touch in the shard, in order. texts: as of in_groups()."""
    bits = SHARD_BITS + shards

    def count(table):
        group = table.column("group")[0].as_py() if table.num_rows else 0
        column, copied = table.column("text").combine_chunks(), table.column("copies").to_numpy() > 0
        held = [[[], []] for _ in range(ROWS)]
        for first, hashes, doc, _ in windows(column, width, ROWS):
            for r, h in enumerate(hashes):
                cell = _touched(h, bits)
                held[r][0].append(cell)
                held[r][1].append(cell[copied[first + doc]])  # stands for two texts or more
        out = []
        for r in range(ROWS):
            if not held[r][0]:
                continue
            cells = np.sort(np.concatenate(held[r][0] + held[r][1]))
            new = np.concatenate([[True], cells[1:] != cells[:-1]])
            again, cells = np.unique(cells[1:][~new[1:]]), cells[new]
            twice = dict(_by_shard(again))
            for s, part in _by_shard(cells):
                more = again[twice[s]] if s in twice else again[:0]
                out.append((r, s, group, _planes((cells[part] & _LOW).astype(np.uint32)), _planes((more & _LOW).astype(np.uint32))))
        give_back()
        cols = list(zip(*out)) or [()] * 5
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["row", "shard", "group", "once", "twice"])

    def merge(table):
        seen, many = np.zeros(1 << SHARD_BITS, bool), np.zeros(1 << SHARD_BITS, bool)
        once = table.column("once").to_pylist()
        for a, b in zip(once, table.column("twice").to_pylist()):
            x = _cells(a)
            many[x] |= seen[x]
            seen[x] = True
            many[_cells(b)] = True
        found = [np.packbits(many[_cells(a)]).tobytes() for a in once]
        give_back()
        return pa.table([table.column("group"), table.column("row"), table.column("shard"), pa.array(found, pa.binary())], names=["group", "row", "shard", "bits"])

    cells = texts.groupBy("group").applyInArrow(count, "row int, shard bigint, group bigint, once binary, twice binary")
    return cells.groupBy("row", "shard").applyInArrow(merge, "group bigint, row int, shard bigint, bits binary")


def estimated(hashes: np.ndarray, bits: int, replies: dict[int, bytes]) -> np.ndarray:
    """Whether each window's cell in one row is repeated. replies: a row's bits by shard."""
    cells, at = np.unique(_touched(hashes, bits), return_inverse=True)
    many = np.zeros(len(cells), bool)
    for s, part in _by_shard(cells):
        many[part] = np.unpackbits(np.frombuffer(replies[s], np.uint8), count=part.stop - part.start)
    return many[at]


def covered_ranges(texts: DataFrame, shards: int, width: int = WINDOW) -> DataFrame:
    """(k1, k2a, size): words a..a+size-1 of the text with key (k1, k2) are covered by repeated windows; k2a holds k2 above 32
    bits of a."""
    bits = SHARD_BITS + shards
    names = ["h1", "h2", "k1", "k2"]  # h2 with the place, k2 with the count: dense rows shuffle smaller

    def flush(h1, h2, k1, k2, pos, weight):
        order = np.lexsort((h2, h1))
        s1, s2 = h1[order], h2[order]
        cut = np.flatnonzero(np.concatenate([[True], (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1]), [True]]))
        first = np.zeros(len(h1), bool)
        first[order[cut[:-1]]] = True
        n = np.empty(len(h1), np.int64)
        n[order] = np.repeat(np.add.reduceat(weight[order], cut[:-1]), np.diff(cut))
        # n = 1: only a look elsewhere can tell; 2: known here, told to the others; 3: a range known here, of length h2
        out = [(h1[first], h2[first], k1[first], k2[first], pos[first], np.minimum(n[first], 2))]
        at = np.flatnonzero((n > 1) & (weight == 1))
        if len(at):
            breaks = np.concatenate([[True], (np.diff(at) != 1) | (k1[at[1:]] != k1[at[:-1]]) | (k2[at[1:]] != k2[at[:-1]]) | (pos[at[1:]] != pos[at[:-1]] + 1)])
            a = at[breaks]
            b = at[np.concatenate([breaks[1:], [True]])]
            out.append((mix(k1[a].view(np.uint64)), (pos[b] - pos[a] + width).astype(np.uint64), k1[a], k2[a], pos[a], np.full(len(a), 3)))
        h1, h2, k1, k2, pos, n = (np.concatenate(x) for x in zip(*out))
        return h1.view(np.int64), (h2 << np.uint64(32) | pos.astype(np.uint64)).view(np.int64), k1, k2.astype(np.int64) << 2 | n

    def candidates(table, replies):
        known = [{} for _ in range(ROWS)]
        for r, s, b in zip(*(replies.column(c).to_pylist() for c in ("row", "shard", "bits"))):
            known[r][s] = b
        k1, k2, weight = (table.column(c).to_numpy() for c in ("k1", "k2", "copies"))
        rows, held = [[] for _ in range(ROWS)], []
        for first, hashes, doc, pos in windows(table.column("text").combine_chunks(), width, ROWS) if table.num_rows else ():
            for r, h in enumerate(hashes):
                rows[r].append(h)
            held.append((first + doc, pos))
        found = [np.zeros(0, np.int64)] * 4
        if held:
            h = [np.concatenate(x) for x in rows]
            at = np.flatnonzero(np.logical_and.reduce([estimated(x, bits, y) for x, y in zip(h, known)]))
            row, pos = (np.concatenate(x)[at] for x in zip(*held))
            if len(at):
                found = flush(h[0][at], h[1][at], k1[row], k2[row], pos, weight[row].astype(np.int64) + 1)
        give_back()
        return pa.table([pa.array(x) for x in found], names=names)

    def verify(batches):
        rest = None
        for b in batches:
            part = [b.column(i).to_numpy() for i in range(4)]
            if rest is not None:
                part = [np.concatenate(x) for x in zip(rest, part)]
            if not len(part[0]):
                continue
            cut = int(np.searchsorted(part[0], part[0][-1]))
            rest = [x[cut:] for x in part]
            if cut:
                yield told([x[:cut] for x in part])
        if rest is not None:
            yield told(rest)

    def told(part):
        h1, h2, k1, k2 = part
        a, h2, n, k2 = h2 & 0xFFFFFFFF, h2 >> 32, k2 & 3, k2 >> 2
        known, lone = n == 3, n == 1
        order = np.lexsort((h2, known, h1))  # of one h1, seldom more than a few rows
        s1, s2, s3 = h1[order], h2[order], known[order]
        edge = np.flatnonzero(np.concatenate([[True], (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1]) | (s3[1:] != s3[:-1]), [True]]))
        total = np.empty(len(h1), np.int64)
        total[order] = np.repeat(np.add.reduceat(n[order], edge[:-1]), np.diff(edge))
        # what is known in its group comes as a range; here, windows that were alone in theirs are found
        out = known | (lone & (total > 1))
        size = np.where(known, h2, width)
        return pa.RecordBatch.from_arrays([pa.array(k1[out]), pa.array(k2[out] << 32 | a[out]), pa.array(size[out].astype(np.int32))], names=["k1", "k2a", "size"])

    found = texts.groupBy("group").cogroup(answers(texts, shards, width).groupBy("group")).applyInArrow(candidates, "h1 bigint, h2 bigint, k1 bigint, k2 bigint")
    return found.repartition("h1").sortWithinPartitions("h1").mapInArrow(verify, "k1 bigint, k2a bigint, size int")


def with_keys(docs: DataFrame) -> DataFrame:
    """doc_id, text, a key (k1, k2) of both, and copies: 0 for a text that stands alone, 1 for the one that
    stands for all equal texts, 2 for the others."""
    keyed = docs.select("doc_id", "text").withColumns({"k1": F.xxhash64("doc_id"), "k2": F.hash("text"), "x1": F.xxhash64("text"), "x2": F.xxhash64(F.lit(35), "text")})
    equal = stored(keyed.groupBy("x1", "x2").agg(F.count("*").alias("n"), F.min("k1").alias("k0")).where("n > 1").select("x1", "x2", "k0"))
    copies = F.when(F.col("k0").isNull(), 0).when(F.col("k0") == F.col("k1"), 1).otherwise(2)
    return keyed.join(small(equal), ["x1", "x2"], "left").select("doc_id", "text", "k1", "k2", copies.alias("copies"))


def _group(groups: int):
    return F.pmod(F.xxhash64("k1", "k2"), F.lit(groups))


def in_groups(keyed: DataFrame, groups: int) -> DataFrame:
    """The texts that stand for themselves or for their copies, dealt by group. All passes read this one exchange."""
    rows = keyed.where("copies < 2").withColumn("text", F.coalesce("text", F.lit("")))
    partitions = max(int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-groups // GROUPS_PER_TASK))
    return rows.select("doc_id", "text", "k1", "k2", "copies", _group(groups).alias("group")).repartition(partitions, "group")


def remove_repeats(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and the kept text of every row."""
    keyed = with_keys(docs)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-size // GROUP_BYTES))
    texts = in_groups(keyed, groups)
    ranges = covered_ranges(texts, shards_for(size), width)
    ranges = ranges.select("k1", F.shiftright("k2a", 32).cast("int").alias("k2"), "k2a", "size").select(_group(groups).alias("group"), "k1", "k2a", "size")

    def one(text, a, b):
        words = text.encode("utf-8", "surrogatepass").split()
        n = len(words)
        if not len(a):
            return n, 0, b" ".join(words).decode("utf-8", "surrogatepass")
        depth = np.zeros(n + 1, np.int64)
        np.add.at(depth, a, 1)
        np.add.at(depth, b, -1)
        keep = np.cumsum(depth)[:n] == 0
        return n, n - int(keep.sum()), b" ".join(compress(words, keep.tolist())).decode("utf-8", "surrogatepass")

    def table(ids, out):
        cols = list(zip(*out)) or [()] * 3
        return [ids, pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())]

    names = ["doc_id", "n_words", "n_removed", "text"]

    def cut(texts, ranges):
        alone = texts.filter(pa.compute.equal(texts.column("copies"), 0))
        k1, k2a, size = (ranges.column(c).to_numpy() for c in ("k1", "k2a", "size"))
        order = np.lexsort((k2a, k1))
        k1, k2, a, size = k1[order], (k2a >> 32)[order], (k2a & 0xFFFFFFFF)[order], size[order]
        edge = np.flatnonzero(np.concatenate([[True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]), [True]])).tolist() if len(k1) else [0]
        where = {(int(k1[x]), int(k2[x])): slice(x, y) for x, y in zip(edge, edge[1:])}
        none = slice(0, 0)
        out = []
        for text, key in zip(alone.column("text").to_pylist(), zip(alone.column("k1").to_pylist(), alone.column("k2").to_pylist())):
            part = where.get(key, none)
            out.append(one(text, a[part], a[part] + size[part]))
        give_back()
        return pa.table(table(alone.column("doc_id"), out), names=names)

    def whole(batches):
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                n = len((text or "").encode("utf-8", "surrogatepass").split())
                out.append((n, n, "") if n >= width else one(text or "", (), ()))
            if out:
                yield pa.RecordBatch.from_arrays(table(batch.column(0), out), names=names)

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words bigint, n_removed bigint, text string"
    kept = texts.groupBy("group").cogroup(ranges.groupBy("group")).applyInArrow(cut, schema)
    return kept.union(keyed.where("copies > 0").select("doc_id", "text").mapInArrow(whole, schema))


def op4(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
with d as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
win as (select doc_id, i, array_to_string(w[i:i + 34], ' ') as s from d, unnest(range(1, len(w) - 33)) t(i)),
rep as (select s from win group by s having count(*) > 1),
hit as (select distinct doc_id, p from (select doc_id, unnest(range(i, i + 35)) as p from win where s in (select s from rep))),
words as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as p from d),
kept as (select words.doc_id, string_agg(word, ' ' order by words.p) as t, count(*) as n from words left join hit on hit.doc_id = words.doc_id and hit.p = words.p where hit.p is null group by 1)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(t, '')) as kept_sha256 from d left join kept using (doc_id)
"""
