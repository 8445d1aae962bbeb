"""Best-fit packing of token sequences by exact-complement hashing.

Texts become token ids, each document closed by a separator id; documents longer than the capacity are
cut into capacity-sized pieces, the first of which may be shorter. How pieces fill sequences depends on
their lengths alone, so the plan is made on the histogram of lengths (at most `capacity` counts, whatever
the input's size): taking lengths from the longest down, the gap that one leaves is looked up in an index
of single lengths, then of pair sums, then of triple sums, and each combination found is consumed as often
as the available counts allow. What remains is packed best-fit-decreasing, also on counts. The plan is a list
of patterns (lengths of one sequence, how often); its size depends on the capacity only.

Pieces get their places without ever sorting all pieces of a length in one task: they are numbered
inside hashed blocks, a cumulative sum of the (block, length) counts makes that a number among all pieces of the
length, and the plan maps (length, number) to a sequence and an offset.

Edge cases: a null or empty text has only the separator; repeated rows are packed as rows of their own; an
empty table gives no rows; extra columns are ignored; pieces of equal length are interchangeable,
so ties need no rule.
"""

from __future__ import annotations

import base64
import json
import zlib
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanforge.llm.common import parts, stored

CAPACITY, SEPARATOR = 2048, 0
#: Pieces that a block holds on average.
BLOCK = 50_000


class Pattern(NamedTuple):
    lengths: tuple[int, ...]
    times: int


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[Pattern]:
    """counts[n]: pieces of length n, for n from 0 to capacity (counts[0] is not used)."""
    left = counts.astype(np.int64).copy()
    left[0] = 0
    out: list[Pattern] = []
    rest: list[tuple[int, int]] = []

    def take(lengths: tuple[int, ...]) -> None:
        times = min(int(left[x]) // lengths.count(x) for x in set(lengths))
        for x in lengths:
            left[x] -= times
        out.append(Pattern(lengths, times))

    def have(*lengths: int) -> bool:
        return all(left[x] >= lengths.count(x) for x in set(lengths))

    def pair(gap: int, head: tuple[int, ...]) -> tuple[int, int] | None:
        """The most even-handed pair of available lengths with the sum gap: larger part first."""
        a = np.arange(gap - 1, (gap - 1) // 2, -1)
        for i in np.flatnonzero((left[a] > 0) & (left[gap - a] > 0)):
            x = int(a[i])
            if have(*head, x, gap - x):
                return x, gap - x
        return None

    def pair_sums() -> np.ndarray:
        """Index of sums of two available lengths (possibly one length twice: checked when used)."""
        on = np.flatnonzero(left)
        sums = np.zeros(capacity + 1, dtype=bool)
        for x in on:
            s = on + x
            sums[s[s <= capacity]] = True
        return sums

    sums = pair_sums()
    for n in range(capacity, 0, -1):
        stale = 0
        while left[n]:
            gap = capacity - n
            if gap == 0:
                take((n,))
                continue
            if gap <= n and have(n, gap):
                take((n, gap))
                continue
            found = pair(gap, (n,)) if sums[gap] else None
            if found:
                take((n, *found))
                continue
            # triples: the first part from the largest down, the rest from the index of pair sums
            for x in np.flatnonzero((left[1:gap] > 0) & sums[gap - 1 : 0 : -1])[::-1] + 1 if gap > 1 else ():
                if have(n, int(x)) and (found := pair(gap - int(x), (n, int(x)))):
                    found = (int(x), *found)
                    break
            if found:
                take((n, *found))
                stale += 1
                if stale % 64 == 0:
                    sums = pair_sums()
                continue
            rest.append((n, int(left[n])))
            left[n] = 0
        if n % 64 == 0:
            sums = pair_sums()

    # best fit, longest first, on bins grouped by what they hold
    bins: dict[int, list[list]] = {}
    for n, times in rest:
        while times:
            gap = next((g for g in range(n, capacity) if bins.get(g)), None)
            if gap is None:
                each = capacity // n  # new sequences, filled with this length
                if times >= each:
                    held, k = (n,) * each, times // each
                else:
                    held, k = (n,) * times, 1
                times -= len(held) * k
            else:
                held, k = bins[gap].pop()
                fit = min(gap // n, times)
                if fit * k > times:
                    fit = max(1, times // k) if times >= k else 1
                used = min(k, times // fit)
                if used < k:
                    bins[gap].append([held, k - used])
                held, k = held + (n,) * fit, used
                times -= fit * used
            gap = capacity - sum(held)
            if gap:
                bins.setdefault(gap, []).append([held, k])
            else:
                out.append(Pattern(held, k))
    return out + [Pattern(tuple(held), k) for b in bins.values() for held, k in b]


def places(patterns: list[Pattern], capacity: int = CAPACITY):
    """For each length: starts of its runs of numbers, and per run (first sequence, offset)."""
    runs: dict[int, tuple[list[int], list[int], list[int]]] = {}
    used = dict.fromkeys(range(capacity + 1), 0)
    base = 0
    for lengths, times in patterns:
        offset = 0
        for n in lengths:
            at, seq, off = runs.setdefault(n, ([], [], []))
            at.append(used[n])
            seq.append(base)
            off.append(offset)
            used[n] += times
            offset += n
        base += times
    return {n: tuple(np.array(x, dtype=np.int64) for x in r) for n, r in runs.items()}, base


# ---- token ids ------------------------------------------------------------------------------------

# Fixed value: code points below this one are in the same class in all Unicode versions that the two libraries have.
SAME_BELOW = 0x250


@cache
def encoder(path: str):
    """texts -> lists of ids, equal to those of the tokenizers library for the file. Texts of well-known
    characters take a second library with the same vocabulary and merges, several times as fast."""
    def library():
        if not held:  # tens of MB, seldom needed
            from tokenizers import Tokenizer

            held.append(Tokenizer.from_file(path))
        return held[0]

    def slow(texts):
        return [library().encode(t, add_special_tokens=False).ids for t in texts]

    held: list = []
    ranks = path.removesuffix(".json") + ".tiktoken"
    try:
        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    except (ImportError, OSError):
        return slow
    with open(path, encoding="utf-8") as f:
        special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    fast = tiktoken.Encoding("twin", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=special)

    def both(texts):
        return [
            fast.encode(t, allowed_special="all") if (t.isascii() or max(t) < chr(SAME_BELOW)) else library().encode(t, add_special_tokens=False).ids
            for t in texts
        ]

    return both


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity
    return [(0, head)] * bool(head) + [(i, capacity) for i in range(head, n, capacity)]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, separator: int = SEPARATOR, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, block (and ids)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        encode = encoder(path)
        for part in parts(batches, 256):
            owner, cols = [], ([], [], [], [], [])
            for i, found in enumerate(encode([t or "" for t in part.column("text").to_pylist()])):
                x = np.array([*found, separator], dtype="<u4")
                for k, (start, n) in enumerate(cuts(len(x), capacity)):
                    y = x[start : start + n]
                    owner.append(i)
                    for c, v in zip(cols, (k, start, n, zlib.crc32(y.tobytes()), y if ids else None)):
                        c.append(v)
            arrays = [part.column("doc_id").take(pa.array(owner, pa.int32())), *(pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.int64())))]
            yield pa.RecordBatch.from_arrays([*arrays, *([pa.array(cols[4], pa.list_(pa.int64()))] if ids else [])], names=names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if ids else [])]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<bigint>" * ids)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, separator: int = SEPARATOR, ids: bool = False) -> DataFrame:
    """One row per piece with its sequence_id and offset; with ids, also the piece's ids."""
    cut = stored(pieces(docs, path, capacity, separator, ids))
    key = cut.columns[:5]
    total = cut.count()
    blocks = max(1, -(-total // BLOCK))
    cut = cut.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(blocks)))
    counts = stored(cut.groupBy("block", "length").agg(F.count("*").alias("n")))
    found = counts.groupBy("length").agg(F.sum("n")).collect()  # at most `capacity` rows
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for n, times in found:
        histogram[n] = times
    runs, _ = places(plan(histogram, capacity), capacity)
    table = docs.sparkSession.sparkContext.broadcast(runs)  # its size depends on the capacity only

    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("block", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    number = F.row_number().over(Window.partitionBy("block", "length").orderBy(*key)) - 1
    numbered = cut.withColumn("number", number).join(base, ["block", "length"]).withColumn("number", (F.col("number") + F.col("base")).cast("bigint"))

    def run(batches):
        for b in batches:
            n, k = b.column("length").to_numpy(), b.column("number").to_numpy()
            seq, off = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
            for x in np.unique(n).tolist():
                at, first, offset = table.value[x]
                mine = n == x
                i = np.searchsorted(at, k[mine], side="right") - 1
                seq[mine], off[mine] = first[i] + k[mine] - at[i], offset[i]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in out), pa.array(seq), pa.array(off)], names=[*out, "sequence_id", "offset"])

    out = [*key, *(["ids"] if ids else [])]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.select(*out).schema)
    return numbered.select(*out, "number").mapInArrow(run, f"{schema}, sequence_id bigint, offset bigint")


def op3(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
