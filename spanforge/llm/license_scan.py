"""License notices: exact places of short phrases, and fuzzy search for notices with typing errors.

A notice with at most e errors (inserted, deleted or replaced characters) contains, cut into e + 1
seeds, at least one seed unchanged (pigeonhole). Seeds are found as plain substrings of the normalised
text; only around their places the regex library's bounded-error matching verifies the notice, counts
its errors and gives its span. What distinguishes versions (numbers, "nc") must match exactly.

A text is normalised by lower-casing A-Z and taking the words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+.

Edge cases: null or wordless text: no words, no places, empty labels, score 0; ties between fuzzy matches
of one label at one place go to the fewest errors, then the first; extra columns are ignored; repeated
rows each get a row; an empty table gives none; texts are searched whole.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import cache
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from spanforge.llm.common import parts

# Phrases whose exact places are reported, with their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))


class Notice(NamedTuple):
    label: str
    fuzzy: str  #: words that may hold errors
    errors: int
    exact: str = ""  #: what must follow, a regular expression


# Notices for the fuzzy search.
NOTICES = (
    Notice("mit", "under the mit license", 2),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy", 5),
    Notice("apache-2", "apache license version", 3, r" 2(?: 0)?"),
    Notice("cc-by-nc", "licensed under cc by", 2, r" nc"),
    Notice("cc-by-nc", "creative commons attribution noncommercial", 4),
    Notice("cc-by", "licensed under cc by", 2, r"(?! n[cd]| sa)"),
    Notice("gpl-3", "gnu general public license version", 4, r" 3"),
    Notice("gpl-2", "gnu general public license version", 4, r" 2"),
    Notice("lgpl", "gnu lesser general public license", 4),
    Notice("mpl-2", "mozilla public license version", 3, r" 2"),
    Notice("bsd", "redistribution and use in source and binary forms", 4),
)

#: Not word characters, and capitals, in ASCII; all other bytes stay.
_TABLE = bytes((b + 32 if 65 <= b <= 90 else b) if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Span(NamedTuple):
    label: str
    first_word: int
    last_word: int
    errors: int
    score: float
    text: str


def seeds(phrase: str, errors: int) -> list[tuple[int, str]]:
    """(offset, seed): the phrase cut into errors + 1 parts of nearly equal length."""
    n, k = len(phrase), errors + 1
    edges = [i * n // k for i in range(k + 1)]
    return [(a, phrase[a:b]) for a, b in zip(edges, edges[1:])]


@cache
def _compiled(notices: tuple[Notice, ...]):
    return [
        (x, [(o, s.encode()) for o, s in seeds(x.fuzzy, x.errors)], regex.compile(rf"(?b)(?<=^| )(?:{regex.escape(x.fuzzy)}){{e<={x.errors}}}{x.exact}(?= |$)"))
        for x in notices
    ]


def normalise(text: str | None) -> bytes:
    return b" ".join((text or "").encode("utf-8", "replace").translate(_TABLE).split())


def places(norm: bytes, phrases=PHRASES) -> list[tuple[str, int]]:
    """(label, word index) of every exact place of a phrase in a normalised text."""
    out, padded = [], b" " + norm + b" "
    for phrase, label in phrases:
        key = b" " + phrase.encode() + b" "
        at = padded.find(key)
        while at >= 0:
            out.append((label, padded.count(b" ", 0, at)))
            at = padded.find(key, at + 1)
    return out


def _matches(pattern, zone: str):
    """Matches that don't overlap, in order: the best of the zone, and likewise what lies before and behind it. What
    lies before holds only worse ones, so that this is as many levels deep as there are numbers of errors."""
    left = [(0, len(zone), None)]
    while left:
        start, end, done = left.pop()
        if done is not None:
            yield done
        elif m := pattern.search(zone, start, end):
            if m.end() > m.start():
                left += [(m.end(), end, None), (0, 0, m), (start, m.start(), None)]


def fuzzy(norm: bytes, notices: tuple[Notice, ...] = NOTICES) -> list[Span]:
    """Verified matches of the notices, best for each label and place, in order of their places."""
    out: list[Span] = []
    breaks = None
    for notice, pieces, pattern in _compiled(notices):
        reach = len(notice.fuzzy) + notice.errors
        zones: list[list[int]] = []
        hits = []
        for offset, seed in pieces:
            at = norm.find(seed)
            while at >= 0:
                hits.append((max(0, at - offset - notice.errors - 1), at - offset + reach + 16))
                at = norm.find(seed, at + 1)
        for a, b in sorted(hits):
            if zones and a <= zones[-1][1]:
                zones[-1][1] = max(b, zones[-1][1])
            else:
                zones.append([a, b])
        for a, b in zones:
            # widen to whole words, so that no character and no word is cut
            a = norm.rfind(b" ", 0, a + 1) + 1 if a else 0
            b = norm.find(b" ", min(b, len(norm)))
            zone = norm[a : b if b >= 0 else len(norm)].decode("utf-8", "replace")
            for m in _matches(pattern, zone):
                found = m[0].strip(" ")
                start = m.start() + len(m[0]) - len(m[0].lstrip(" "))
                if breaks is None:
                    breaks = [i for i, c in enumerate(norm) if c == 32]
                at = a + len(zone[:start].encode())
                first = bisect_right(breaks, at - 1)
                errors = sum(m.fuzzy_counts)
                out.append(Span(notice.label, first, first + found.count(" "), errors, 1 - errors / len(notice.fuzzy), found))
    best: dict[tuple[str, int], Span] = {}
    for s in out:
        if (k := (s.label, s.first_word)) not in best or s.errors < best[k].errors:
            best[k] = s
    return sorted(best.values(), key=lambda s: (s.first_word, s.label))


SPANS = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("errors", pa.int64()), ("score", pa.float64()), ("text", pa.string())]))


def scan(docs: DataFrame, phrases=PHRASES, notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, and the fuzzy search's spans."""

    def one(text):
        norm = normalise(text)
        base, spans = places(norm, phrases), fuzzy(norm, notices)
        own = {label for label, _ in base}
        return (
            norm.count(b" ") + 1 if norm else 0, len(base), min((w for _, w in base), default=None), max((w for _, w in base), default=None),
            ",".join(sorted(own)), ",".join(sorted(own | {s.label for s in spans})),
            1.0 if base else max((s.score for s in spans), default=0.0), [s._asdict() for s in spans],
        )

    def run(batches):
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), SPANS]
        for b in parts(batches):
            rows = list(zip(*map(one, b.column("text").to_pylist()))) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(r, k) for r, k in zip(rows, kinds))], names=["doc_id", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run,
        f"doc_id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, "
        "spans array<struct<label: string, first_word: bigint, last_word: bigint, errors: bigint, score: double, text: string>>",
    )


def op1(docs: DataFrame) -> DataFrame:
    return scan(docs)
