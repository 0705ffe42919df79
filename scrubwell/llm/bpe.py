"""Operator 1: byte-level BPE encoding and decoding by monoid tree reduction.

A piece of text is halved recursively. The encodings of two neighbouring halves are joined by
re-encoding a window of tokens around the boundary, which grows until its first and last token come
out unchanged. That suffices: a token sequence is the BPE encoding of its bytes exactly if each
adjacent pair of its tokens encodes to itself. (Inside the segment of such a pair, BPE on the whole
picks the same merges in the same order as BPE on the pair alone, so the first merge across a
boundary would also happen in the pair.) Pairs outside the window come from encodings already, and
so do those at the window's rim once its outer tokens are unchanged. Whether the two tokens at a boundary are such
a pair is found without encoding them, by undoing their merges from the last one on (``apart``); if so, the window
is empty.

The pre-tokenizer's pieces never merge with each other, so above the level of pieces the join is plain
concatenation, and decoding concatenates neighbours at every level of a tree.

Frames are handled in slices of some ``SLICE`` bytes. A slice is cut into chunks on its bytes, each distinct chunk is
encoded once, and texts are put together from the chunks' ids by Arrow; so is what the ids decode to.

Workers remember chunks and pieces from slice to slice, in memos bounded by entries and by the length of an entry;
longer ones, as texts without spaces have them, are made anew each time. So memory doesn't grow with the input.

Nulls count as empty text; an empty text has no tokens. Each row is handled alone, so ties, repeated
rows, empty tables and further columns make no difference; further input columns aren't read.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubwell.llm.common import kept, map_batches, map_rows, read_table, trim

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Entries of each memo of windows and halves.
MEMO = 150_000
#: Entries of one generation of a memo of chunks and pieces, which holds two generations at most.
CHUNKS = 100_000
#: Longer keys aren't remembered.
LONG = 64
#: Halves of at most so many bytes are remembered too.
HALF = 8
#: Halving may go by so many bytes off the middle.
REACH = 3
#: Letters below this sign are letters to every Unicode version.
LATIN = "\u0250"
#: Bytes of text, or a single longer text, whose chunks are looked up together. What a slice takes beside them is some 25
#: times that, so it sets what a worker needs.
SLICE = 1 << 20


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


#: Above any rank.
NONE = 1 << 30
SHIFT = 20


def merge_ids(parts: list[int], pairs: dict[int, int]) -> tuple[int, ...]:
    """Plain BPE over byte tokens: lowest rank first, leftmost among equals; ids are ranks."""
    get = pairs.get
    if len(parts) > 64:
        return _merge_long(parts, pairs)
    found = [get(a << SHIFT | b, NONE) for a, b in zip(parts, parts[1:])]
    while found:
        r = min(found)
        if r == NONE:
            break
        i = found.index(r)
        parts[i] = r
        del parts[i + 1], found[i]
        if i:
            found[i - 1] = get(parts[i - 1] << SHIFT | r, NONE)
        if i < len(found):
            found[i] = get(r << SHIFT | parts[i + 1], NONE)
    return tuple(parts)


def _merge_long(parts: list[int], pairs: dict[int, int]) -> tuple[int, ...]:
    """The same by a linked list and a heap, n log n."""
    n = len(parts)
    after, before = [*range(1, n), -1], list(range(-1, n - 1))
    at: list[int] = list(parts)
    heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(at, at[1:])) if (r := pairs.get(a << SHIFT | b)) is not None]
    heapq.heapify(heap)
    while heap:
        r, i, a, b = heapq.heappop(heap)
        j = after[i]
        if at[i] != a or j < 0 or at[j] != b:
            continue
        at[i], at[j] = r, -1
        after[i] = after[j]
        if (j := after[i]) >= 0:
            before[j] = i
            if (q := pairs.get(r << SHIFT | at[j])) is not None:
                heapq.heappush(heap, (q, i, r, at[j]))
        if (k := before[i]) >= 0 and (q := pairs.get(at[k] << SHIFT | r)) is not None:
            heapq.heappush(heap, (q, k, at[k], r))
    out, i = [], 0
    while i >= 0:
        out.append(at[i])
        i = after[i]
    return tuple(out)


class Memo(dict):
    """A memo of ``make``, bounded in entries and their length: when full, the younger generation becomes the older one."""

    def __init__(self, make, limit: int = CHUNKS):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        if len(key) > LONG:
            return self.make(key)
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
        if len(self) >= self.limit:
            self.old = {}  # before the younger one is copied
            self.old = dict(self)
            self.clear()
        self[key] = got
        return got


class BpeMonoid:
    """Encodings as a monoid: ``leaf`` for a byte, ``join`` for neighbours, ``tree`` for the reduction."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN):
        self.ranks = ranks
        self.token = [b""] * (max(ranks.values()) + 1)
        for b, r in ranks.items():
            self.token[r] = b
        self.decimal = [str(i) for i in range(len(self.token))]
        self.find = regex.compile(pattern).findall
        self.byte = [ranks[bytes([i])] for i in range(256)]
        self.spelt = [[self.byte[x] for x in t] for t in self.token]
        #: ``left << SHIFT | right`` to the token that the last merge of its bytes makes of the two. A token never comes of
        #: another pair: until then all merges in its bytes are those of BPE on them alone.
        self.pairs: dict[int, int] = {}
        self.left, self.right = list(range(len(self.token))), list(range(len(self.token)))
        for t, r in sorted(ranks.items(), key=lambda x: x[1]):
            for i in range(1, len(t)):
                x, y = ranks.get(t[:i], NONE), ranks.get(t[i:], NONE)
                if x < r and y < r and self.apart(x, y, r):
                    self.left[r], self.right[r] = x, y
                    self.pairs[x << SHIFT | y] = r
                    break
        #: In how many tokens two bytes stand together.
        self.seam = [0] * (1 << 16)
        for t in self.token:
            for a, b in zip(t, t[1:]):
                self.seam[a << 8 | b] += 1
        self._windows: dict[tuple[int, ...], tuple[int, ...]] = {}
        #: Tokens that their own bytes encode to; the leaves of every tree are among them.
        self.whole = {t: (r,) for t, r in ranks.items() if len(t) == 1 or self.left[r] != r}
        self._halves = dict(self.whole)

    def apart(self, x: int, y: int, limit: int = NONE) -> bool:
        """Whether two tokens, side by side, encode to themselves.

        Their merges are undone, the latest first. At each step the two tokens that then meet at the boundary would
        have been merged instead if their pair ranks below the merge just undone (on its right side: not above it,
        since of equal ranks the leftmost goes first).
        """
        get, left, right = self.pairs.get, self.left, self.right
        while True:
            if get(x << SHIFT | y, NONE) < limit:
                return False
            if x > y:
                limit, x = x, right[x]
                if x == limit:
                    limit, y = y + 1, left[y]
                    if y + 1 == limit:
                        return True
            else:
                limit, y = y + 1, left[y]
                if y + 1 == limit:
                    limit, x = x, right[x]
                    if x == limit:
                        return True

    def leaf(self, byte: bytes) -> tuple[int, ...]:
        return (self.ranks[byte],)

    def window(self, tokens: tuple[int, ...]) -> tuple[int, ...]:
        """The encoding of the bytes of a run of tokens, from single bytes up."""
        got = self._windows.get(tokens)
        if got is None:
            spelt = self.spelt
            got = merge_ids([x for t in tokens for x in spelt[t]], self.pairs)
            if len(tokens) <= 8:
                if len(self._windows) >= MEMO:
                    self._windows.clear()
                self._windows[tokens] = got
        return got

    def join(self, a: tuple[int, ...], b: tuple[int, ...]) -> tuple[int, ...]:
        """The encoding of two neighbours from their encodings; associative, the empty tuple is neutral."""
        if not a or not b:
            return a or b
        if self.apart(a[-1], b[0]):
            return a + b
        i = j = 1
        n, m = len(a), len(b)
        while True:
            tokens = a[-i:] + b[:j]
            w = self._windows.get(tokens) or self.window(tokens)
            left = i == n or w[0] == tokens[0]
            right = j == m or w[-1] == tokens[-1]
            if left and right:
                return a[:-i] + w + b[j:]
            if not left:
                i = min(2 * i, n)
            if not right:
                j = min(2 * j, m)

    def middle(self, data: bytes, n: int) -> int:
        """Where to halve: around the middle, between the two bytes that stand together in the fewest tokens."""
        seam, half, reach = self.seam, n >> 1, min(n >> 2, REACH)
        best, at = 1 << 30, half
        for i in range(half - reach, half + reach + 1):
            if (k := seam[data[i - 1] << 8 | data[i]]) < best:
                best, at = k, i
        return at

    def tree(self, data: bytes) -> tuple[int, ...]:
        if (got := self._halves.get(data)) is not None:
            return got
        n = len(data)
        at = self.middle(data, n)
        out = self.join(self.tree(data[:at]), self.tree(data[at:]))
        if n <= HALF:
            if len(self._halves) >= MEMO:
                self._halves = dict(self.whole)
            self._halves[data] = out
        return out

    def piece(self, text: str) -> tuple[int, ...]:
        data = text.encode()
        whole = self.ranks.get(data)
        return (whole,) if whole is not None else self.tree(data)

    def decode(self, ids) -> bytes:
        return concatenated([self.token[i] for i in ids])


def concatenated(parts: list[bytes]) -> bytes:
    """Neighbours joined level by level, up to the root."""
    while len(parts) > 2:
        above = [a + b for a, b in zip(parts[::2], parts[1::2])]
        if len(parts) & 1:
            above.append(parts[-1])
        parts = above
    return parts[0] + parts[1] if len(parts) == 2 else parts[0] if parts else b""


#: Last bytes of white space beyond ASCII, as numbers of two and three bytes.
_WHITE = [int.from_bytes(c.encode(), "big") for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x10000)]) if c.isspace()]
_WHITE2, _WHITE3 = [w for w in _WHITE if w < 1 << 16], [w for w in _WHITE if w >= 1 << 16]


def chunk_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where chunks begin in the bytes of texts: at each text's start, and at each space that follows a character
    other than white space (ASCII control characters count as that here; cutting less is never wrong)."""
    at = np.flatnonzero(data == 0x20)
    at = at[at > 0]
    before = data[at - 1]
    mark = np.zeros(len(data), bool)
    mark[at[(before > 0x20) & (before < 0x80)]] = True
    at = at[before >= 0x80]
    if at.size:
        two = data[at - 2].astype(np.int32) << 8 | data[at - 1]
        white = np.isin(two, _WHITE2) | np.isin(data[at - 3].astype(np.int32) << 16 | two, _WHITE3)
        mark[at[~white]] = True
    mark[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    return np.flatnonzero(mark)


class Slice:
    """Some texts as distinct chunks: ``ids`` and ``tokens`` of each of these, the chunk at each place (``codes``), and
    where each text's places begin (``places``, one more than texts). An empty text has no chunk."""

    def __init__(self, codec: Codec, texts: pa.Array):
        self.codec = codec
        texts = texts.cast(pa.string())
        if texts.null_count:
            texts = pc.fill_null(texts, "")
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
        self.data = np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]]
        self.offsets = offsets - offsets[0]
        starts = chunk_starts(self.data, self.offsets)
        self.places = np.searchsorted(starts, self.offsets).astype(np.int32)
        bounds = np.append(starts, len(self.data)).astype(np.int32)
        coded = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(self.data)).dictionary_encode()
        self.codes = coded.indices
        head, tail = codec.head, codec.tail
        self.ids = [tail[k[1:]] if k[0] == " " else head[k] for k in coded.dictionary.to_pylist()]
        self._tokens: pa.ListArray | None = None

    def tokens(self) -> pa.ListArray:
        """The ids of each distinct chunk as numbers."""
        if self._tokens is None:
            parts = pc.split_pattern(pa.array(self.ids, pa.string()), ",")
            self._tokens = pa.ListArray.from_arrays(parts.offsets, parts.values.cast(pa.int32()))
        return self._tokens

    def joined(self, each: pa.Array, between: str | bytes) -> pa.Array:
        """Per text, what ``each`` has for its chunks, concatenated."""
        return pc.binary_join(pa.ListArray.from_arrays(self.places, each.take(self.codes)), pa.scalar(between, each.type))

    def ids_text(self) -> pa.Array:
        """Per text its ids, decimal and comma-joined."""
        return self.joined(pa.array(self.ids, pa.string()), ",")

    def numbers(self) -> pa.ListArray:
        """Per text its ids as numbers."""
        each = self.tokens().take(self.codes)
        return pa.ListArray.from_arrays(each.offsets.take(pa.array(self.places)), each.values)

    def decoded(self) -> pa.Array:
        """Per text the bytes that its ids stand for: tokens concatenated to chunks, chunks to texts."""
        tokens = self.tokens()
        spelt = pa.ListArray.from_arrays(tokens.offsets, self.codec.spelling.take(tokens.values))
        return self.joined(pc.binary_join(spelt, pa.scalar(b"", pa.binary())), b"")


class Codec:
    """Whole texts to ids and back.

    A text is cut before each space that follows a character other than white space. The pattern has a
    boundary there in any case (only a white-space piece goes on across a space, and that begins
    earlier only in white space), so the chunks can be encoded and remembered one by one. So are the pieces
    of a chunk of several.
    """

    def __init__(self, monoid: BpeMonoid):
        self.monoid = monoid
        self.head = Memo(self._ids)
        self.tail = Memo(lambda chunk: self._ids(" " + chunk))
        self.back = Memo(self._decode)
        self.spelling = pa.array(monoid.token, pa.binary())
        self.sizes = pc.binary_length(self.spelling)

    def _ids(self, chunk: str) -> str:
        m = self.monoid
        word = chunk[1:] if chunk[:1] == " " else chunk
        if not (word.isalpha() and max(word) < LATIN):  # else one piece: the pattern's ` ?\\p{L}+`
            pieces = m.find(chunk)
            if len(pieces) > 1:
                return ",".join([self.tail[p[1:]] if p[0] == " " else self.head[p] for p in pieces])
        decimal = m.decimal
        return ",".join([decimal[i] for i in m.piece(chunk)])

    def _decode(self, ids: str) -> bytes:
        return self.monoid.decode(map(int, ids.split(",")))

    def ids_text(self, text: str) -> list[str]:
        """Decimal ids of each chunk, comma-joined; every string has one id at least."""
        part = Slice(self, pa.array([text], pa.string()))
        return [part.ids[i] for i in part.codes.to_pylist()]

    def bytes_of(self, ids: list[str]) -> bytes:
        back = self.back
        return concatenated([back[i] for i in ids])


def slices(batches: Iterator[pa.RecordBatch], codec: Codec) -> Iterator[tuple[pa.Array, pa.Array, Slice]]:
    """Keys, texts and slices of batches of ``key`` and ``text``."""
    for batch in batches:
        at, size = 0, pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).cumsum()
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(size, SLICE + (size[at - 1] if at else 0), "right")))
            part = batch.slice(at, end - at)
            yield part.column("key"), part.column("text"), Slice(codec, part.column("text"))
            at, part = end, None
            trim()  # else allocators gather, slice by slice, as much again as the memos take


_CODECS: dict[str, Codec] = kept("scrubwell.llm.bpe", "scrubwell.llm.token_counts")


def codec(path: str) -> Codec:
    """One per Python worker and vocabulary."""
    if path not in _CODECS:
        _CODECS[path] = Codec(BpeMonoid(load_ranks(path)))
    return _CODECS[path]


def round_trip(df: DataFrame, path: str, *, key: str = "doc_id", text: str = "text", numbers: bool = False) -> DataFrame:
    """``key``, ``ids`` (decimal, comma-joined), ``decoded`` (the bytes that the ids stand for) and, if asked for, ``numbers``
    (the ids as an array of int)."""
    source = df.select(df[key].cast("long").alias("key"), df[text].cast("string").alias("text"))
    more = [("numbers", pa.list_(pa.int32()))] if numbers else []
    schema = pa.schema([("key", pa.int64()), ("ids", pa.string()), ("decoded", pa.binary()), *more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, _, part in slices(batches, codec(path)):
            arrays = [keys, part.ids_text(), part.decoded(), *([part.numbers()] if numbers else [])]
            part = None
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)
            arrays = None

    names = "key long, ids string, decoded binary" + ", numbers array<int>" * numbers
    return map_batches(source, run, names, __name__).withColumnRenamed("key", key)


def encode(df: DataFrame, path: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``ids`` as an array of int."""
    source = df.select(df[key].cast("long").alias("key"), df[text].cast("string").alias("text"))
    schema = pa.schema([("key", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, _, part in slices(batches, codec(path)):
            yield pa.RecordBatch.from_arrays([keys, part.numbers()], schema=schema)

    return map_batches(source, run, "key long, ids array<int>", __name__).withColumnRenamed("key", key)


def decode(df: DataFrame, path: str, *, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key`` and ``decoded`` bytes of an array of ids; a null array counts as empty."""
    source = df.select(df[key].cast("long").alias("key"), df[ids].alias("ids"))

    def rows(it: Iterator[tuple]) -> Iterator[tuple]:
        m = codec(path).monoid
        for k, i in it:
            yield k, m.decode(i or ())

    schema = pa.schema([("key", pa.int64()), ("decoded", pa.binary())])
    return map_rows(source, rows, "key long, decoded binary", schema).withColumnRenamed("key", key)


def digests(trip: DataFrame) -> DataFrame:
    """The digest columns of ``round_trip``'s result."""
    n = F.when(F.col("ids") == "", F.lit(0)).otherwise(F.length("ids") - F.length(F.replace("ids", F.lit(","), F.lit(""))) + 1)
    return trip.select(
        "doc_id",
        n.cast("long").alias("n_tokens"),
        F.sha2(F.encode("ids", "UTF-8"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(round_trip(read_table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS)))


QUERIES = {"op1_bpe": op1_bpe}
ORACLE_SQL: dict[str, str] = {}
