"""Token counts by a compiled finite-state transducer.

Two deterministic transducers in a cascade count what the tokenizer library would emit.

The first reads character classes and marks where pieces begin (letter runs, single numbers, symbol runs,
contractions). Its transition monoid - every function on its states that some string induces - is
enumerated once, so that the state map of a chunk is one small integer and composing two maps is one table
look-up; chunk maps compose by a parallel prefix scan, after which every chunk knows its entry state and
is run independently.

The second reads the bytes of the pieces, from its start state at each piece, so that the map of whatever
holds a piece's beginning is a constant and all pieces run side by side. Its states say what of a byte
pair encoding the next bytes can still change: for every suffix of the piece that begins some token, the
trie node of the suffix, the last token before it and how many tokens that is fewer than now. A prefix's
encoding ends with the one token that may follow the encoding before it (two neighbours are final if no
earlier merge crosses them), so each transition knows the change of the number of tokens and is annotated
with it; a piece's count is the sum along its path. Transitions are compiled from the merges when a path
first needs them; at most about `MAX_TRANSITIONS` are kept between batches, what is dropped is compiled again.

The library counts nothing. Its normaliser and splitter are asked, when compiling, about single code points
on which their Unicode version and this Python's may differ.

Edge cases: null text counts as empty (0 bytes, 0 tokens); empty table: no rows; special strings inside
a text are one token each, as the library does by default; extra columns are ignored; repeated rows
each get a row; texts of any length are read whole.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame

from spanforge.llm.common import parts

MAX_TRANSITIONS = 400_000
#: With fewer pieces than this left, each is run to its end by itself.
FEW = 24
CHUNK, BATCH_CHARS = 128, 2 << 20
SPECIAL = ("<|startoftext|>", "<|endoftext|>")

# Character classes of the first transducer.
SPACE, LETTER, NUMBER, SYMBOL, QUOTE, STMD, R, V, L, E = range(10)
N_CLASSES = 10
# Its states, after a character: nothing open; in letters; in symbols; after a quote that opened a
# piece; after 'r, 'v and 'l, which may yet become 're, 've and 'll.
NONE, LETTERS, SYMBOLS, OPEN, OPEN_R, OPEN_V, OPEN_L = range(7)
N_STATES = 7
# What a transition marks: a piece begins here, or began one character earlier, or both.
HERE, BEFORE = 1, 2


def _step(state: int, c: int) -> tuple[int, int]:
    if state in (OPEN_R, OPEN_V) and c == E or state == OPEN_L and c == L:
        return NONE, 0
    if state in (OPEN_R, OPEN_V, OPEN_L):  # no contraction: the quote stands alone and letters began
        after, mark = _step(LETTERS, c)
        return after, mark | BEFORE
    if c == SPACE:
        return NONE, 0
    if c == NUMBER:
        return NONE, HERE
    if c in (SYMBOL, QUOTE):
        if state in (SYMBOLS, OPEN):
            return SYMBOLS, 0
        return (OPEN if c == QUOTE else SYMBOLS), HERE
    if state == OPEN and c in (STMD, R, V, L):
        return {STMD: NONE, R: OPEN_R, V: OPEN_V, L: OPEN_L}[c], 0
    return LETTERS, 0 if state == LETTERS else HERE


@cache
def tables():
    """next state, mark, and the transition monoid: product table, generator of each class, element at NONE."""
    nxt = np.array([[_step(s, c)[0] for c in range(N_CLASSES)] for s in range(N_STATES)], dtype=np.uint8)
    mark = np.array([[_step(s, c)[1] for c in range(N_CLASSES)] for s in range(N_STATES)], dtype=np.uint8)
    one = tuple(range(N_STATES))
    gens = [tuple(nxt[:, c].tolist()) for c in range(N_CLASSES)]
    index, todo = {one: 0}, [one]
    for f in todo:
        for g in gens:
            h = tuple(g[x] for x in f)
            if h not in index:
                index[h] = len(index)
                todo.append(h)
    n = len(todo)
    product = np.empty((n, n), dtype=np.uint16)
    for i, f in enumerate(todo):
        for j, g in enumerate(todo):
            product[i, j] = index[tuple(g[x] for x in f)]
    return nxt, mark, product, np.array([index[g] for g in gens], dtype=np.uint16), np.array([f[NONE] for f in todo], dtype=np.uint8)


@cache
def class_table() -> np.ndarray:
    """Class of every code point that this Python's Unicode version assigns."""
    kinds = np.fromiter((ord(unicodedata.category(chr(cp))[0]) for cp in range(0x110000)), np.uint8, 0x110000)
    out = np.full(0x110000, SYMBOL, dtype=np.uint8)
    out[kinds == ord("L")] = LETTER
    out[kinds == ord("N")] = NUMBER
    # Code points with the property White_Space.
    for a, b in ((0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)):
        out[a : b + 1] = SPACE
    out[ord("'")] = QUOTE
    for ch in "stmd":
        out[ord(ch)] = STMD
    out[ord("r")], out[ord("v")], out[ord("l")], out[ord("e")] = R, V, L, E
    return out


def states_before(classes: np.ndarray) -> np.ndarray:
    """State before each character, the first in NONE: chunk maps, prefix scan, then all chunks at once."""
    nxt, _, product, gens, at_none = tables()
    n = len(classes)
    k = -(-n // CHUNK)
    grid = np.zeros(k * CHUNK, dtype=np.uint8)
    grid[:n] = classes
    grid = np.ascontiguousarray(grid.reshape(k, CHUNK).T)
    size = len(product)
    flat = product.ravel()
    maps = np.zeros(k, dtype=np.intp)
    by_class = gens.astype(np.intp)
    for row in grid:
        maps = flat[maps * size + by_class[row]].astype(np.intp)
    step = 1
    while step < k:  # inclusive scan
        ahead = maps.copy()
        ahead[step:] = flat[maps[:-step] * size + maps[step:]]
        maps, step = ahead, step * 2
    state = np.concatenate([[NONE], at_none[maps[:-1]]]).astype(np.intp)
    out = np.empty((CHUNK, k), dtype=np.uint8)
    table = nxt.ravel().astype(np.intp)
    for i, row in enumerate(grid):
        out[i] = state
        state = table[state * N_CLASSES + row]
    return np.ascontiguousarray(out.T).ravel()[:n]


def piece_spans(classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pieces of a text, given by its classes, that ends in white space."""
    mark = tables()[1].ravel()[states_before(classes).astype(np.intp) * N_CLASSES + classes]
    begins = (mark & HERE).astype(bool)
    begins[:-1] |= (mark[1:] & BEFORE).astype(bool)
    starts = np.flatnonzero(begins)
    cuts = np.flatnonzero(begins | (classes == SPACE))
    return starts, cuts[np.searchsorted(cuts, starts, side="right")]


class Alphabet:
    """Code points as the library's normaliser and splitter see them."""

    def __init__(self, normaliser, splitter):
        self.normaliser, self.splitter = normaliser, splitter
        self.classes, self.lower, self.seen = class_table().copy(), {ord("Σ"): "σ"}, set()  # lower() has a rule for a final sigma, the library hasn't
        # Marks and compositions that are newer than the library's tables: nothing is reordered or composed across them.
        every = [chr(cp) for cp in range(0x110000)]
        bars = [c for c in every if unicodedata.combining(c) and normaliser.normalize_str(f"b{c}\u0334") != unicodedata.normalize("NFC", f"b{c}\u0334") and c != "\u0334"]
        split = [unicodedata.normalize("NFD", c) for c in every if (d := unicodedata.decomposition(c)) and d[0] != "<" and unicodedata.normalize("NFC", c) == c]
        bars += [d[-1] for d in split if normaliser.normalize_str(d) != unicodedata.normalize("NFC", d).replace("Σ", "σ").lower()]
        self.bars = re.compile("([" + "".join(map(re.escape, sorted(set(bars)))) + "])") if bars else None

    def learn(self, text: str) -> None:
        """Code points that this Python's Unicode version doesn't assign: the library may know them."""
        for c in set(text) - self.seen:
            if ord(c) > 0x7F and unicodedata.category(c) == "Cn":
                if (low := self.normaliser.normalize_str(c)) != c:
                    self.lower[ord(c)] = low
                for x in {c, *low}:
                    alone, joined = (len(self.splitter.pre_tokenize_str(y + x)) for y in ("!", "x"))
                    self.classes[ord(x)] = LETTER if joined == 1 else SYMBOL if alone == 1 else NUMBER
            self.seen.add(c)

    def normalise(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        self.learn(text)
        if not unicodedata.is_normalized("NFC", text):
            text = "".join(unicodedata.normalize("NFC", x) for x in (self.bars.split(text) if self.bars else [text]))
        return text.translate(self.lower).lower()


NO_LIMIT = 1 << 62


class Merges:
    """The byte pair encoding: tokens 0 to 255 are bytes, 256 to 511 bytes that end a piece, then one per merge in order."""

    def __init__(self, merges, end: str = "</w>"):
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in visible]
        names = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
        number = names | {c + end: 256 + b for c, b in names.items()}
        self.left, self.right, self.merged = list(range(512)), list(range(512)), {}
        spelled = [bytes([b]) for b in range(256)] * 2
        closing = [False] * 256 + [True] * 256
        for m in merges:
            x, y = m.split(" ") if isinstance(m, str) else m
            a, b = number[x], number[y]
            t = number[x + y] = len(self.left)
            self.left.append(a)
            self.right.append(b)
            self.merged.setdefault((a, b), t)
            spelled.append(spelled[a] + spelled[b])
            closing.append(closing[b])
        # a trie of all tokens; the token that ends at a node, inside a piece and at its end
        self.child, self.inner, self.last = {}, [-1], [-1]
        for t, s in enumerate(spelled):
            node = 0
            for byte in s:
                key = node << 8 | byte
                node = self.child.get(key, 0)
                if not node:
                    node = self.child[key] = len(self.inner)
                    self.inner.append(-1)
                    self.last.append(-1)
            (self.last if closing[t] else self.inner)[node] = t
        self.known: dict[tuple[int, int], bool] = {}

    def apart(self, a: int, b: int, limit: int = NO_LIMIT) -> bool:
        """Whether a and b side by side, each made by its own merges, are never joined across their border by a merge
        before `limit`. Merges are undone from the last: what then stands at the border could have been joined if that
        merge comes before the one that was undone; of equal ones the left one comes first."""
        while True:
            if self.merged.get((a, b), NO_LIMIT) < limit:
                return False
            if max(a, b) < 512:
                return True
            if a > b:
                limit, a = a, self.right[a]
            else:
                limit, b = b + 1, self.left[b]

    def whole(self, t: int) -> bool:
        """Whether a token's own bytes are encoded as it."""
        key = (-1, t)
        if key not in self.known:
            a, b = self.left[t], self.right[t]
            self.known[key] = t < 512 or self.whole(a) and self.whole(b) and self.merged[a, b] == t and self.apart(a, b, t)
        return self.known[key]

    def follows(self, a: int, b: int) -> bool:
        """Whether token b may stand after token a, or at a piece's start (a = -1)."""
        found = self.known.get((a, b))
        if found is None:
            found = self.known[a, b] = self.whole(b) and (a < 0 or self.apart(a, b))
        return found


class Transducer:
    """The second transducer: transitions by state and symbol (a byte, plus 256 where it ends its piece)."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.forget()

    def forget(self) -> None:
        start = ((0, -1, 0),)
        self.states, self.number = [start], {start: 0}
        self.moves: dict[int, int] = {}
        self._sized(1 << 16)
        self.merges.known.clear()

    def _sized(self, size: int) -> None:
        self.shift, self.mask = np.uint64(64 - size.bit_length() + 1), size - 1
        self.keys, self.values = np.full(size, -1, dtype=np.int64), np.zeros(size, dtype=np.int64)
        if self.moves:
            n = len(self.moves)
            self._enter(np.fromiter(self.moves.keys(), np.int64, n), np.fromiter(self.moves.values(), np.int64, n))

    def _home(self, keys):
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _enter(self, keys, values) -> None:
        at = self._home(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]  # of several, the last one stays
            mine = self.keys[at] == keys
            self.values[at[mine]] = values[mine]
            keys, values, at = keys[~mine], values[~mine], (at[~mine] + 1) & self.mask

    def move(self, key: int) -> int:
        """Next state << 8 | change of the number of tokens + 128; compiled at its first use."""
        found = self.moves.get(key)
        if found is None:
            found = self.moves[key] = self._compile(self.states[key >> 9], key & 255, bool(key & 256))
        return found

    def _compile(self, state, byte: int, ends: bool) -> int:
        m = self.merges
        tokens, token, change, kept = m.last if ends else m.inner, None, 0, []
        for node, before, fewer in state:
            n = m.child.get(node << 8 | byte)
            if n is not None:
                if token is None and tokens[n] >= 0 and m.follows(before, tokens[n]):
                    token, change = tokens[n], fewer + 1
                kept.append((n, before, fewer))
        if ends:
            return change + 128
        after = (*((n, before, fewer - change) for n, before, fewer in kept), (0, token, 0))
        i = self.number.setdefault(after, len(self.states))
        if i == len(self.states):
            self.states.append(after)
        return i << 8 | change + 128

    def look_up(self, keys: np.ndarray) -> np.ndarray:
        at = self._home(keys)
        have = self.keys[at]
        out = self.values[at]
        left = np.flatnonzero(have != keys)
        if not len(left):
            return out
        at, have, missing = at[left], have[left], []
        while len(left):
            gone = have < 0
            missing.append(left[gone])
            left, at = left[~gone], (at[~gone] + 1) & self.mask
            have = self.keys[at]
            hit = have == keys[left]
            out[left[hit]] = self.values[at[hit]]
            left, at, have = left[~hit], at[~hit], have[~hit]
        missing = np.concatenate(missing)
        if len(missing):
            new, inverse = np.unique(keys[missing], return_inverse=True)
            values = np.fromiter(map(self.move, new.tolist()), np.int64, len(new))
            out[missing] = values[inverse]
            if len(self.moves) * 2 > self.mask:
                self._sized((self.mask + 1) * 4)
            else:
                self._enter(new, values)
        return out

    def run(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of each piece."""
        if len(self.moves) > MAX_TRANSITIONS:
            self.forget()
        size = ends - starts
        order = np.argsort(-size, kind="stable")
        starts, size = starts[order], size[order]
        longest = int(size[0])
        alive = len(size) - np.searchsorted(size[::-1], np.arange(longest + 1), side="right")  # pieces longer than j
        state, total = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        for j in range(longest):
            n = int(alive[j])
            if n < FEW:
                for i in range(n):
                    self._alone(data, int(starts[i]) + j, int(starts[i] + size[i]), state, total, i)
                break
            symbol = data[starts[:n] + j].astype(np.int64)
            symbol[alive[j + 1] :] += 256
            found = self.look_up(state[:n] << 9 | symbol)
            total[:n] += (found & 255) - 128
            state[:n] = found >> 8
        out = np.empty(len(total), np.int64)
        out[order] = total
        return out

    def _alone(self, data, at: int, end: int, state, total, i: int) -> None:
        s, n, move = int(state[i]), 0, self.move
        for a in range(at, end - 1, 1 << 16):
            for byte in data[a : min(end - 1, a + (1 << 16))].tolist():
                found = move(s << 9 | byte)
                s, n = found >> 8, n + (found & 255) - 128
        total[i] += n + (move(s << 9 | 256 | int(data[end - 1])) & 255) - 128


class Counter:
    """The cascade for one vocabulary file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        library = Tokenizer.from_file(path)
        self.alphabet = Alphabet(library.normalizer, library.pre_tokenizer)
        self.transducer = Transducer(Merges(model["merges"], model["end_of_word_suffix"]))

    def count(self, texts: list[str | None]) -> np.ndarray:
        total = np.zeros(len(texts), dtype=np.int64)
        held, lens, size, first = [], [], 0, 0
        for i, t in enumerate(texts):
            t = t or ""
            if "<|" in t:
                for s in SPECIAL:
                    total[i] += t.count(s)
                    t = t.replace(s, "\n")
            t = self.alphabet.normalise(t)
            held.append(t)
            lens.append(len(t) + 1)
            size += len(t)
            if size >= BATCH_CHARS:
                total[first : i + 1] += self._count(held, lens)
                held, lens, size, first = [], [], 0, i + 1
        if held:
            total[first:] += self._count(held, lens)
        return total

    def _count(self, texts: list[str], lens: list[int]) -> np.ndarray:
        joined = "\n".join(texts) + "\n"
        data = np.frombuffer(joined.encode(), dtype=np.uint8)
        if plain := len(data) == len(joined):
            codes = data
        else:
            codes = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        starts, ends = piece_spans(self.alphabet.classes[codes])
        if not len(starts):
            return np.zeros(len(texts), dtype=np.int64)
        if plain:
            emitted = self.transducer.run(data, starts, ends)
        else:
            width = np.ones(len(codes), dtype=np.int8)
            for least in (0x80, 0x800, 0x10000):
                width += codes >= least
            place = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])
            emitted = self.transducer.run(data, place[starts], place[ends])
        emitted = np.concatenate([[0], np.cumsum(emitted)])
        edge = np.searchsorted(starts, np.concatenate([[0], np.cumsum(lens)]))
        return np.diff(emitted[edge])


@cache
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row."""

    def run(batches):
        transducer = counter(path)
        for b in parts(batches):
            text = b.column("text")
            n = transducer.count(text.to_pylist())
            size = pa.compute.fill_null(pa.compute.binary_length(text), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), size, pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")


def op9(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return token_counts(docs, public_tokenizers.path("word_bpe_49k.json"))
