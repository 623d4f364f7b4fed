"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

A text becomes an array of code points, and each code point a symbol: its class together with what its neighbours to the
right make of it. The pre-tokeniser is a deterministic automaton over these symbols. Its transition functions form a small
finite monoid, so composing them is one table lookup, composition is associative, and the state before every character
follows from a blocked prefix scan of array steps, without a regular expression or a loop over characters. Boundaries are
where the automaton starts a new piece. The slices between them go through a cache of merged pieces; the token count of each
piece is retained, so ids can be decoded piece by piece.

Defined results: a null or empty text gives no ids and decodes to the empty string. Ids depend on the text alone, so equal
rows give equal results and ties do not arise. ``encode`` keeps the given columns; one that is named like a result column
gives way to it.
"""

from __future__ import annotations

import base64
import heapq
import sys
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import blocks, id_and_text, read_table

#: The pattern whose pieces the automaton reproduces.  Fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Classes of code points.
LETTER, DIGIT, BLANK, OTHER = range(4)
#: Symbols: LAST is a blank before a non-blank, JOIN a space before a non-blank, SHORT and LONG an apostrophe before one or two
#: letters that make a contraction, END the gap between two texts.
SYMBOLS = L, N, O, W, LAST, JOIN, SHORT, LONG, END = range(9)  # noqa: E741
#: States, after what kind of character the automaton stands; ONE and TWO: so many letters of a contraction are to come.
STATES = FRESH, IN_L, IN_N, IN_O, IN_W, JOINED, ONE, TWO = range(8)
#: Characters of one scan; a longer text is scanned alone.
SCAN_CHARS = 1 << 19
#: Pieces in a worker's cache; beyond it the cache starts anew.
CACHE_PIECES = 300_000
#: Longer pieces, in bytes, are merged with a heap and not cached.
LONG_PIECE = 64
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether the character starts a piece."""
    if symbol == L:
        if state == ONE:
            return FRESH, False
        if state == TWO:
            return ONE, False
        return IN_L, state not in (IN_L, JOINED)
    if symbol == N:
        return IN_N, state not in (IN_N, JOINED)
    if symbol == O or symbol in (SHORT, LONG) and state in (IN_O, JOINED):
        return IN_O, state not in (IN_O, JOINED)
    if symbol == W:
        return IN_W, state != IN_W
    return {LAST: FRESH, JOIN: JOINED, SHORT: ONE, LONG: TWO, END: FRESH}[symbol], True


@lru_cache(1)
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the closure of the transition functions: a symbol's element, the composition table, the state that an element leads to
    from FRESH, and starts[state, symbol]."""
    index: dict[tuple, int] = {}
    generators = [tuple(_step(q, s)[0] for q in STATES) for s in SYMBOLS]
    todo = list(generators)
    while todo:
        f = todo.pop()
        if f not in index:
            index[f] = len(index)
            todo += [tuple(g[q] for q in f) for g in generators]
    functions = list(index)
    compose = np.array([[index[tuple(g[q] for q in f)] for g in functions] for f in functions], np.uint8)
    of = np.array([index[g] for g in generators], np.uint8)
    starts = np.array([[_step(q, s)[1] for s in SYMBOLS] for q in STATES])
    return of, compose, np.array([f[FRESH] for f in functions], np.uint8), starts


def scan(elements: np.ndarray, compose: np.ndarray, width: int = 32) -> np.ndarray:
    """Inclusive prefix compositions. Blocks of ``width`` are scanned side by side, then their totals by recursion."""
    n = len(elements)
    if n <= width:
        out = elements.copy()
        for i in range(1, n):
            out[i] = compose[out[i - 1], out[i]]
        return out
    flat, m = compose.ravel(), len(compose)
    rows = -(-n // width)
    grid = np.zeros((width, rows), elements.dtype)
    padded = np.full(rows * width, elements[-1], elements.dtype)
    padded[:n] = elements
    grid[:] = padded.reshape(rows, width).T
    for i in range(1, width):
        grid[i] = flat[grid[i - 1].astype(np.intp) * m + grid[i]]
    before = scan(grid[-1], compose, width)[:-1].astype(np.intp) * m
    grid[:, 1:] = flat[before + grid[:, 1:]]
    return grid.T.ravel()[:n]


@lru_cache(1)
def class_table() -> np.ndarray:
    """The class of every code point, as the tokenizer library's own Unicode tables have it."""
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, sys.maxunicode + 1)]))
    one_byte = {bytes([i]): i for i in range(256)}
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+"), (BLANK, r"\s+")):
        only = tiktoken.Encoding(f"class{kind}", pat_str=pattern, mergeable_ranks=one_byte, special_tokens={})
        found = bytes(only.encode_ordinary(every)).decode()
        out[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    return out


def piece_starts(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where pieces start, for each character of texts that stand one after the other.

    points: code points, with one 0 behind each text; ends: the places of these."""
    of, compose, leads, starts = _monoid()
    kind = class_table()[points]
    symbol = np.array([L, N, W, O], np.uint8)[kind]
    nxt = np.full(len(points) + 2, -1, np.int32)  # the code point behind, -1 behind a text
    nxt[: len(points)] = points
    nxt[ends] = -1
    one, two = nxt[1:-1], nxt[2:]
    blank = symbol == W
    filled = np.append(~blank, False)
    filled[ends] = False
    before_filled = blank & filled[1:]
    symbol[before_filled] = LAST
    symbol[before_filled & (points == 0x20)] = JOIN
    at = np.flatnonzero(points == 0x27)
    if len(at):
        a, b = one[at], two[at]
        short = np.isin(a, [ord(c) for c in "stmd"])
        pair = (a == ord("r")) & (b == ord("e")) | (a == ord("v")) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        symbol[at[short]] = SHORT
        symbol[at[pair & ~short]] = LONG
    symbol[ends] = END
    after = leads[scan(of[symbol], compose)]
    before = np.empty_like(after)
    before[0], before[1:] = FRESH, after[:-1]
    return starts[before, symbol]


def pieces_of(texts: list[str]) -> list[list[bytes]]:
    """Each text's pieces as bytes."""
    joined = "\0".join([*texts, ""])
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    first = piece_starts(points, ends)
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    at = np.cumsum(width) - width
    where = at[first].tolist()  # an END starts a piece too, which is left out below
    raw = joined.encode("utf-8", "surrogatepass")
    number = np.cumsum(first)
    out, low = [], 0
    for high in (number[ends] - 1).tolist():
        cut = where[low : high + 1]
        out.append([raw[a:b] for a, b in zip(cut, cut[1:], strict=False)])
        low = high + 1
    return out


def merge_short(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merge the pair of the lowest rank, the leftmost of equals, until no pair has one."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    get, none = ranks.get, 1 << 60
    pair = [get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
    while pair:
        low = min(pair)
        if low == none:
            break
        i = pair.index(low)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pair[i]
        if i < len(pair):
            pair[i] = get(parts[i] + parts[i + 1], none)
        if i:
            pair[i - 1] = get(parts[i - 1] + parts[i], none)
    return [ranks[p] for p in parts]


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap over a linked list, for pieces of any length."""
    n = len(piece)
    end, left, right = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or right[i] >= n or end[right[i]] != stop or end[i] == stop:
            continue
        j = right[i]
        alive[j], end[i], right[i] = False, stop, right[j]
        if right[i] < n:
            left[right[i]] = i
            if (r := ranks.get(piece[i : end[right[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[right[i]]))
        if left[i] >= 0 and (r := ranks.get(piece[left[i] : stop])) is not None:
            heapq.heappush(heap, (r, left[i], stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = right[i]
    return out


class PieceCache(dict):
    """From a piece to its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: bytes) -> bytes:
        if piece in self.ranks:
            ids = [self.ranks[piece]]
        elif len(piece) <= LONG_PIECE:
            ids = merge_short(piece, self.ranks)
        else:
            return np.array(merge_long(piece, self.ranks), "<u4").tobytes()
        if len(self) >= CACHE_PIECES:
            self.clear()
        out = self[piece] = np.array(ids, "<u4").tobytes()
        return out


def read_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line)}


@lru_cache(2)
def _cache(content: bytes) -> PieceCache:
    return PieceCache(read_ranks(content))


@lru_cache(2)
def _tokens(content: bytes) -> list[bytes]:
    ranks = read_ranks(content)
    out = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, i in ranks.items():
        out[i] = token
    return out


def encode_texts(texts: list[str], content: bytes) -> tuple[list[bytes], list[bytes]]:
    """Of each text its ids and, for each of its pieces, how many of them it has; both as little-endian unsigned integers."""
    cache, ids, counts = _cache(content), [], []
    for a, b in blocks([len(t) for t in texts], SCAN_CHARS):
        for pieces in pieces_of(texts[a:b]):
            found = list(map(cache.__getitem__, pieces))
            ids.append(b"".join(found))
            counts.append((np.fromiter(map(len, found), np.uint32, len(found)) >> 2).astype("<u4").tobytes())
    return ids, counts


def vocabulary_file(path: str | None = None) -> bytes:
    """The bytes of a rank file, read on the driver and sent with the tasks (about 1 MB)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
        if public_tokenizers.PATTERN != PATTERN:
            raise ValueError("the automaton was made for another pattern")
    with open(path, "rb") as f:
        return f.read()


def _slices(batches, rows: int = 500):
    """Small batches, so that a worker holds the ids of few texts at a time."""
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)


def encode(df: DataFrame, vocabulary: str | None = None, text: str = "text") -> DataFrame:
    """The given columns and ``ids`` (binary, unsigned 32-bit little-endian) and ``piece_tokens`` (likewise, tokens of each piece)."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary_file(vocabulary))
    df = df.select([c for c in df.columns if c not in ("ids", "piece_tokens")])
    at = df.columns.index(text)
    schema = T.StructType([*df.schema.fields, T.StructField("ids", T.BinaryType()), T.StructField("piece_tokens", T.BinaryType())])

    def run(batches):
        import pyarrow as pa

        for batch in _slices(batches):
            ids, counts = encode_texts([t or "" for t in batch.column(at).to_pylist()], shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary()), pa.array(counts, pa.binary())], [*batch.schema.names, "ids", "piece_tokens"])

    return df.mapInArrow(run, schema)


@lru_cache(2)
def _lengths(content: bytes) -> np.ndarray:
    return np.array([len(t) for t in _tokens(content)], np.int64)


def piece_ends(ids: np.ndarray, piece_tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Where each piece ends in the decoded bytes, from the offsets that encode() retains. lengths: bytes of each token."""
    ends = np.cumsum(lengths[ids])
    return ends[np.cumsum(piece_tokens, dtype=np.int64) - 1].astype("<u4")


def decode(df: DataFrame, vocabulary: str | None = None, ids: str = "ids", piece_tokens: str | None = "piece_tokens") -> DataFrame:
    """The given columns and ``decoded`` (binary); where ``piece_tokens`` is a column, also ``piece_ends`` (binary, unsigned 32-bit
    little-endian): where in the decoded bytes each piece ends. A null list of ids decodes to nothing."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary_file(vocabulary))
    df = df.select([c for c in df.columns if c not in ("decoded", "piece_ends")])
    at = df.columns.index(ids)
    offsets = df.columns.index(piece_tokens) if piece_tokens in df.columns else None
    names = ["decoded"] if offsets is None else ["decoded", "piece_ends"]
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, T.BinaryType()) for n in names)])

    def run(batches):
        import pyarrow as pa

        token, lengths = _tokens(shared.value).__getitem__, _lengths(shared.value)
        for batch in _slices(batches):
            own = [np.frombuffer(x or b"", "<u4") for x in batch.column(at).to_pylist()]
            made = [pa.array([b"".join(map(token, x.tolist())) for x in own], pa.binary())]
            if offsets is not None:
                counts = [np.frombuffer(x or b"", "<u4") for x in batch.column(offsets).to_pylist()]
                made.append(pa.array([piece_ends(x, n, lengths).tobytes() for x, n in zip(own, counts, strict=True)], pa.binary()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, *names])

    return df.mapInArrow(run, schema)


def op8_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Encode every text of documents and decode the ids; digests of both."""
    encoded = encode(id_and_text(read_table(spark, sf_dir, "documents"))).drop("text")
    return decode(encoded).select(
        "doc_id",
        F.expr("cast(octet_length(ids) div 4 as long)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.expr("cast(octet_length(piece_ends) div 4 as long)").alias("n_pieces"),
    )
