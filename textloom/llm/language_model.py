"""A hashed maximum-entropy language model with a class-factored softmax, and the unigram base beside it.

Words are tokens, and so is the end of a text. The probability of a token is that of its class times that of the token in its class.
The most frequent tokens have a class each; all others are classed by a hash of their last bytes, which tell languages and kinds of words
apart. A softmax over the classes has a row of weights for each hashed feature of the context: the word before (n-gram), the
word two places before (skip), and both together. A word that all training texts have fewer than RARE times stands for its class there.

Training is by distributed gradient updates: each chunk of documents goes through its training tokens in sparse numpy batches, moves
the rows of weights that its features touch, and hands on these rows with the number of their updates; rows are averaged by these
numbers over all chunks, as a tree, and a further round starts from the average. Every training text takes part in every round, and
word counts, classes and rare words come from all of them.

Within a class a second softmax goes over all words of the class: a word's score is the logarithm of its smoothed count and, for each
hashed feature of context and class (the word before, the word two places before), the weight of its slot. Slots are hashes of words;
rare and unknown words have one together. The class's words enter the normaliser by the sums of their counts in each slot, which is exact, as
words of a slot have the same weights. Both factors are trained in the same passes.

Tokens are located and hashed by array steps over bytes; a word is known by two 64-bit hashes. A chunk's words travel as sorted arrays,
one for each range of hashes, so a token that every document has costs an entry for each chunk; ranges are summed for CHUNKS_TOGETHER
chunks at a time, the sums meet, and the totals go back to the chunks in the order in which their words came.

Defined results: a null or empty text is its end token alone. A row with a null doc_id is scored, is in no fold (held_out is null) and not
learned from. Without training texts all counts are zero and every class is equally likely. Repeated rows count as often as they
stand there; scores depend on the text alone. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import LOWER, WHITE, chunk_count, chunk_of, crc_mod, crc_mod_col, discard, id_and_text, materialise, mix64, read_table, run_bounds, text_bytes

#: Classes, and how many of them hold a single frequent token.
CLASSES, SINGLE = 64, 24
#: Last bytes of a word that choose its class.
SUFFIX = 2
#: Rows of weights: for the word before, the word two places before, and both; 2^21 weights in all.
BEFORE, SKIP, JOINT = 1 << 13, 1 << 13, 1 << 14
ROWS = BEFORE + SKIP + JOINT
#: Slots of words within a class (0: rare and unknown ones), and rows of their weights: for the word before and the class, and for the
#: word two places before and the class; they stand behind those of classes.
SLOTS = 16
INSIDE = 1 << 14
INSIDE_ROWS = 2 * INSIDE
#: Rows that are summed together.
ROW_BLOCK = 2048
#: Tasks that sum a block side by side.
FAN = 4
#: Words that occur less often stand for their class in features.
RARE = 4
#: Rounds over all training texts, tokens of a batch, and the first step of a row of weights, which shrinks with its updates.
ROUNDS, BATCH, RATE = 1, 2048, 8.0
SMOOTH = 0.1
#: Places of a run that are added one by one.
PLACES = 8
#: Chunks that one task goes through, one after the other.
CHUNKS_A_TASK = 4
#: Chunks whose words make one range's work, and chunks whose words are summed together.
CHUNKS_A_RANGE, CHUNKS_TOGETHER = 8, 4096
#: The hashes of the token of a text's end; no word is counted under them.
_END = (np.uint64(0x5851F42D4C957F2D), np.uint64(0))
_P, _Q = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1
_TABLES = [mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(x)) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
#: bytes.translate table: 1 for bytes of words, 0 for blanks.
_IN_WORD = bytes(b not in WHITE for b in range(256))
#: Bytes that are hashed at once.
SLICE = 1 << 17


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
    """A 64-bit hash of each of the words raw[start:end], which stand in order; of two families."""
    out = np.zeros(len(start), np.uint64)
    base = (_P, _Q)[which]
    cuts = [0]
    while cuts[-1] < len(start):  # slices of whole words
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(end, start[cuts[-1]] + SLICE, side="right"))))
    longest = max((int(end[b - 1] - start[a]) for a, b in zip(cuts, cuts[1:], strict=False)), default=0)
    powers, inverse = _powers(base, longest + 1), _powers(pow(base, -1, 1 << 64), longest + 1)
    for a, b in zip(cuts, cuts[1:], strict=False):
        low, high = int(start[a]), int(end[b - 1])
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_TABLES[which][raw[low:high]] * powers[: high - low], out=total[1:])
        s, e = start[a:b] - low, end[a:b] - low
        out[a:b] = mix64((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64))
    return out


def suffix_classes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The class, from SINGLE on, of each word by its last bytes."""
    code = np.zeros(len(start), np.uint64)
    for i in range(1, SUFFIX + 1):
        at = end - i
        code = code * np.uint64(257) + np.where(at >= start, raw[np.maximum(at, 0)].astype(np.uint64) + np.uint64(1), np.uint64(0))
    return (SINGLE + mix64(code + np.uint64(1)) % np.uint64(CLASSES - SINGLE)).astype(np.int64)


def located(texts: list[bytes]):
    """Bytes of all texts in lower case, a blank behind each, and where their words and the texts start and end."""
    joined = b" ".join([*texts, b""]).translate(LOWER)
    word = np.frombuffer(b"\0" + joined.translate(_IN_WORD) + b"\0", np.uint8)
    edge = np.flatnonzero(word[1:] != word[:-1])  # of words, first and last in turn
    return np.frombuffer(joined, np.uint8), edge[::2], edge[1::2], np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)


def vocabulary(raw: np.ndarray, start: np.ndarray, end: np.ndarray):
    """The different words among raw[start:end], as bytes one after the other with the bounds of each, and the number of every word."""
    import pyarrow as pa

    bounds = np.concatenate([[0], np.cumsum(end - start)])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(raw.tobytes().translate(None, WHITE))])
    found = words.dictionary_encode()
    offsets = np.zeros(1, np.int64)
    if len(found.dictionary):
        offsets = np.frombuffer(found.dictionary.buffers()[1], np.int64)[: len(found.dictionary) + 1]
    spelt = np.frombuffer(found.dictionary.buffers()[2] or b"", np.uint8)
    return spelt, offsets, found.indices.to_numpy()


class _Tokens:
    """The tokens of a chunk's documents as numbers of the chunk's own vocabulary, which is sorted by hash. Every text ends with the
    end's token. Documents are sorted, as updates depend on their order."""

    def __init__(self, table):
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.ids = table.column("doc_id").to_pylist()
        raw, start, end, stop = located(text_bytes(table.column("text")))
        self.size = np.diff(np.searchsorted(start, stop), prepend=0) + 1
        spelt, bounds, number = vocabulary(raw, start, end)
        low, high = bounds[:-1], bounds[1:]
        every, check = (np.append(word_hashes(spelt, low, high, i), _END[i]) for i in (0, 1))  # each word is hashed once
        order = np.argsort(every)
        if (every[order[1:]] == every[order[:-1]]).any():  # two words have the same first hash
            order = np.lexsort((check, every))
        self.hash, self.check = every[order], check[order]
        self.suffix = np.append(suffix_classes(spelt, low, high), SINGLE)[order]
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        inside = np.ones(len(start) + len(stop), bool)
        inside[np.cumsum(self.size) - 1] = False
        self.tokens = np.full(len(inside), place[-1])
        self.tokens[inside] = place[number]

    def of_training(self, folds: int, held_out: int) -> np.ndarray:
        return np.repeat(np.array([i is not None and crc_mod(i, folds) != held_out for i in self.ids], bool), self.size)


WORDS = "range int, part int, chunk int, hashes binary, checks binary, counts binary, suffixes binary"
_SUMS = "range int, part int, hashes binary, checks binary, counts binary, suffixes binary"
_CELLS = "hash long, check long, total long, words long, cell int"


def slots(hashes: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The slot of each word within its class."""
    return np.where(total < RARE, 0, 1 + (mix64(hashes + np.uint64(3)) % np.uint64(SLOTS - 1)).astype(np.int64))


def _table(schema: str, rows: list[tuple]):
    import pyarrow as pa

    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    fields = [f.split() for f in schema.split(", ")]
    c = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.table({name: pa.array(x, kinds[kind]) for (name, kind), x in zip(fields, c, strict=True)})


def _planes(x: np.ndarray) -> bytes:
    """Numbers byte by byte, the same byte of all together: what changes little is small when it travels."""
    return x.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.frombuffer(planes, np.uint8).reshape(8, -1).T.copy().view("<i8").ravel()


def _chunk_words(ranges: int, folds: int, held_out: int, together: int):
    """A chunk's words with their counts in training texts, by ranges of their hashes."""

    def run(table):
        t, chunk = _Tokens(table), table.column("chunk")[0].as_py()
        n = np.bincount(t.tokens[t.of_training(folds, held_out)], minlength=len(t.hash))
        part = ((t.hash >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
        cuts = run_bounds(part)
        return _table(WORDS, [(int(part[a]), chunk // together, chunk, _planes(t.hash[a:b]), _planes(t.check[a:b]), _planes(n[a:b]), t.suffix[a:b].astype(np.uint8).tobytes()) for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False)])

    return run


def _unpacked(table):
    """Hashes, checks, counts and suffix classes of all rows of a table, one after the other."""
    columns = [[_numbers(x) for x in table.column(c).to_pylist()] for c in ("hashes", "checks", "counts")]
    columns.append([np.frombuffer(x, np.uint8) for x in table.column("suffixes").to_pylist()])
    h, check, n, suffix = (np.concatenate([np.zeros(0, np.int64), *x]) for x in columns)
    return h.view(np.uint64), check.view(np.uint64), n, suffix.astype(np.int64)


def _summed(table):
    """One row with the sums of all words of the rows."""
    h, check, n, suffix = _unpacked(table)
    order = np.lexsort((check, h))
    bounds = run_bounds(h[order], check[order])
    first = order[bounds[:-1]]
    return _table(_SUMS, [(table.column("range")[0].as_py(), table.column("part")[0].as_py(), _planes(h[first]), _planes(check[first]), _planes(np.add.reduceat(n[order], bounds[:-1])), suffix[first].astype(np.uint8).tobytes())])


def _of_range(table):
    """The most frequent words of a range (word: hash and check, total, cell) and what its cells have (total, words, cell). A cell is a
    slot of a class."""
    h, check, n, suffix = _unpacked(table)
    known = np.flatnonzero(n > 0)
    top = known[np.lexsort((check[known], h[known], -n[known]))[:SINGLE]]
    cell = suffix * SLOTS + slots(h, n)
    rows = [(int(h[i].view(np.int64)), int(check[i].view(np.int64)), int(n[i]), 1, int(cell[i])) for i in top]
    tokens, words = np.bincount(cell[known], n[known], CLASSES * SLOTS), np.bincount(cell[known], minlength=CLASSES * SLOTS)
    rows += [(None, None, int(tokens[k]), int(words[k]), k) for k in np.flatnonzero(words).tolist()]
    return _table(_CELLS, rows)


def _to_chunks(listed, sums):
    """The totals of each chunk's words, in the order in which the chunk gave them."""
    rows = []
    if listed.num_rows:
        h, check, total, _ = _unpacked(sums)
        place = {}
        if (h[1:] == h[:-1]).any():
            place = {(a, b): i for i, (a, b) in enumerate(zip(h.tolist(), check.tolist(), strict=True))}
        for low, chunk, hashes, checks in zip(*[listed.column(c).to_pylist() for c in ("range", "chunk", "hashes", "checks")], strict=True):
            own, also = _numbers(hashes).view(np.uint64), _numbers(checks).view(np.uint64)
            at = np.array([place[x] for x in zip(own.tolist(), also.tolist(), strict=True)], np.int64) if place else np.searchsorted(h, own)
            rows.append((chunk, low, _planes(total[at])))
    return _table("chunk int, range int, totals binary", rows)


def _aligned(t: _Tokens, totals, frequent: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Class and total count of each word of the chunk's vocabulary."""
    totals = totals.sort_by("range")
    total = np.concatenate([np.zeros(0, np.int64), *(_numbers(x) for x in totals.column("totals").to_pylist())])
    klass = t.suffix.copy()
    for rank, (h, check) in enumerate(frequent):
        klass[(t.hash == np.int64(h).view(np.uint64)) & (t.check == np.int64(check).view(np.uint64))] = rank
    return klass, total


def feature_rows(t: _Tokens, klass: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of weights of every token's context: 3 by tokens for its class, 2 by tokens within it. A text starts after END."""
    name = np.where((total >= RARE) | (klass < SINGLE), t.hash, mix64(klass.astype(np.uint64) + np.uint64(0x1000)))
    first = np.cumsum(t.size) - t.size
    far = [mix64(np.append(name, _END[0]) + np.uint64(i)) for i in (1, 2)]  # mixed once for each word; END stands last
    at = np.empty_like(t.tokens)
    at[:1], at[1:] = len(name), t.tokens[:-1]
    at[first] = len(name)
    a = far[0][at]
    at[1:] = at[:-1].copy()
    at[first] = len(name)
    b = far[1][at]
    own = mix64(klass.astype(np.uint64) + np.uint64(0x2000))[t.tokens]
    # All numbers of rows are powers of two.
    rows, inside = np.empty((3, len(a)), np.int64), np.empty((2, len(a)), np.int64)
    for x, h, size, low in ((rows[0], a, BEFORE, 0), (rows[1], b, SKIP, BEFORE), (rows[2], mix64(a * np.uint64(3) + b), JOINT, BEFORE + SKIP), (inside[0], mix64(a ^ own), INSIDE, 0), (inside[1], mix64(b ^ own), INSIDE, INSIDE)):
        np.add(h & np.uint64(size - 1), np.uint64(low), out=x, casting="unsafe")
    return rows, inside


def logits(bias: np.ndarray, of: np.ndarray | None, w: np.ndarray, rows: np.ndarray, out: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Scores of all choices after each context, in ``out``; ``room`` is as large. of: the row of ``bias`` for each context, if there are
    several. Rows are in range; with mode="clip" numpy writes them to their place without a copy."""
    out, room = out[: rows.shape[1]], room[: rows.shape[1]]
    w.take(rows[0], axis=0, out=out, mode="clip")
    for r in rows[1:]:
        out += w.take(r, axis=0, out=room, mode="clip")
    out += bias if of is None else bias.take(of, axis=0, out=room, mode="clip")
    return np.clip(out, -40, 40, out=out)  # so that sums of exponentials stay finite


def log_chosen(bias: np.ndarray, of: np.ndarray | None, w: np.ndarray, rows: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Natural log probability of what is chosen after each context. of: as in logits."""
    out, ones = np.empty(len(chosen)), np.ones(w.shape[1], w.dtype)
    scores, room = (np.empty((BATCH, w.shape[1]), w.dtype) for _ in range(2))
    for low in range(0, len(chosen), BATCH):
        own = slice(low, low + BATCH)
        s = logits(bias, None if of is None else of[own], w, rows[:, own], scores, room)
        out[own] = s[np.arange(len(s)), chosen[own]]
        out[own] -= np.log(np.exp(s, out=s) @ ones)
    return out


def log_inside(bias: np.ndarray, w: np.ndarray, rows: np.ndarray, klass: np.ndarray, slot: np.ndarray, smoothed: np.ndarray) -> np.ndarray:
    """Natural log probability of each token in its class: that of its slot, and the word's share of the slot's smoothed counts."""
    return log_chosen(bias, klass, w, rows, slot) + np.log(smoothed) - bias[klass, slot]


def cell_bias(tokens: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Logarithms of the smoothed counts of each slot of each class; an unknown word counts as one more word of slot 0."""
    n = (tokens + SMOOTH * words).reshape(CLASSES, SLOTS)
    n[:, 0] += SMOOTH
    return np.log(np.maximum(n, 1e-12)).astype(np.float32)


def log_classes(bias: np.ndarray, w: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Natural log probabilities of all classes after each context."""
    s = logits(bias, None, w, rows, *(np.empty((rows.shape[1], CLASSES), w.dtype) for _ in range(2)))
    return s - np.log(np.exp(s) @ np.ones((CLASSES, 1), s.dtype))


def updated(bias: np.ndarray, of: np.ndarray | None, w: np.ndarray, seen: np.ndarray, rows: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights after one pass of gradient steps over tokens, batch by batch, and how often each row was touched.

    seen: updates that each row has had before, which make its steps small. of: as in logits. Features have rows of their own, so those
    of all features are moved together; there are at most 2^16, as numbers of 16 bits are sorted by counting."""
    w, touched = w.copy(), np.zeros(len(w), np.float32)
    width = w.shape[1]
    whole = w.view(f"V{w.itemsize * width}").ravel()  # a row of weights as one item, which is written at once
    short, ones = rows.astype(np.uint16), np.ones((width, 1), np.float32)
    gradient, room, own_rows, sums = (np.empty((n * BATCH, width), np.float32) for n in (1, 1, len(rows), len(rows)))
    hit = np.arange(len(chosen)) % BATCH * width + chosen
    for low in range(0, len(chosen), BATCH):
        own = slice(low, low + BATCH)
        flat = short[:, own].ravel()
        order = np.argsort(flat, kind="stable")
        at = flat[order]
        bounds = run_bounds(at)
        first, n = bounds[:-1], bounds[1:] - bounds[:-1]
        row = at[first].astype(np.int64)
        place = np.empty_like(order)
        place[order] = np.repeat(np.arange(len(row)), n)
        here = w.take(row, axis=0, out=own_rows[: len(row)], mode="clip")  # the batch's rows, read once and in order
        g = logits(bias, None if of is None else of[own], here, place.reshape(len(rows), -1), gradient, room)
        np.exp(g, out=g)
        g /= -(g @ ones)
        g.ravel()[hit[own]] += 1
        order %= len(g)  # the token, whatever the feature
        times = n.astype(np.float32)
        touched[row] += times
        step = RATE / (times + np.sqrt(times * (seen[row] + touched[row])) + 1)
        moved = _run_sums(g, order, first, n, sums)
        moved *= step[:, None]
        here += moved
        whole[row] = here.view(whole.dtype).ravel()
    return w, touched


def _run_sums(g: np.ndarray, order: np.ndarray, first: np.ndarray, n: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Sums of the rows of g by runs of ``order``, in ``out``. Most runs are of one; others stand from the longest on and are added up
    place by place, and what is left of long ones by reduction."""
    out = g.take(order[first], axis=0, out=out[: len(first)], mode="clip")
    several = np.flatnonzero(n > 1)
    several = several[np.argsort(n[several], kind="stable")[::-1]]
    size, start = n[several], first[several]
    longer = len(size) - np.cumsum(np.bincount(np.minimum(size, PLACES + 1), minlength=PLACES + 2))  # by place, runs that have it
    total = out.take(several, axis=0)
    for place in range(1, PLACES):
        if m := longer[place]:
            total[:m] += g.take(order[start[:m] + place], axis=0)
    if m := longer[PLACES]:
        size, start = size[:m] - PLACES, start[:m] + PLACES
        low = np.cumsum(size) - size
        at = np.arange(size.sum()) - np.repeat(low - start, size)
        total[:m] += np.add.reduceat(g.take(order[at], axis=0), low)
    out[several] = total
    return out


def _chunk_updates(shared, folds: int, held_out: int):
    """What the chunks of a part make of the weights, averaged over them: a part moves one table, however tasks are dealt. One chunk's
    arrays are held at a time."""

    def of_chunk(chunk, docs, counts):
        v, out = shared.value, []
        t = _Tokens(docs)
        klass, total = _aligned(t, counts, v["frequent"])
        use, chosen = t.of_training(folds, held_out), klass[t.tokens]
        several = use & (chosen >= SINGLE)  # a frequent token is its class
        slot = slots(t.hash, total)[t.tokens][several]
        rows, inside = feature_rows(t, klass, total)
        rows, inside = rows[:, use], inside[:, several]
        del t
        for first, (w, touched) in (
            (0, updated(v["bias"], None, v["weights"], v["seen"], rows, chosen[use])),
            (ROWS // ROW_BLOCK, updated(v["cells"], chosen[several], v["inside"], v["seen_inside"], inside, slot)),
        ):
            for b in range(len(w) // ROW_BLOCK) if touched.any() else ():
                own = slice(b * ROW_BLOCK, (b + 1) * ROW_BLOCK)
                at = np.flatnonzero(touched[own])
                out.append((first + b, at.astype(np.uint16).tobytes(), touched[own][at].tobytes(), w[own][at].astype(np.float16).tobytes(), chunk))
        return _packed(out)

    def run(docs, counts):
        import pyarrow as pa
        import pyarrow.compute as pc

        def made():
            for chunk in sorted(pc.unique(docs.column("chunk")).to_pylist()):
                yield from of_chunk(chunk, *(x.filter(pc.equal(x.column("chunk"), chunk)) for x in (docs, counts))).to_batches()

        return pa.Table.from_batches(_average(made()), _packed([]).schema)

    return run


#: source: the first chunk that went into the row.
BLOCKS = "block int, rows binary, touched binary, weights binary, source int"


def _packed(out: list[tuple]):
    import pyarrow as pa

    c = list(zip(*out, strict=True)) if out else [()] * 5
    return pa.table({"block": pa.array(c[0], pa.int32()), "rows": pa.array(c[1], pa.binary()), "touched": pa.array(c[2], pa.binary()), "weights": pa.array(c[3], pa.binary()), "source": pa.array(c[4], pa.int32())})


def _width(block: int) -> int:
    return CLASSES if block < ROWS // ROW_BLOCK else SLOTS


def _average(batches):
    """Averages the rows of weights that a task reads, by block, each with the number of its updates, in the order of their sources."""
    first = None
    total: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for b in batches:
        for block, rows, touched, weights, source in zip(*[b.column(i).to_pylist() for i in range(5)], strict=True):
            first = source if first is None else min(first, source)
            n, x = total.setdefault(block, (np.zeros(ROW_BLOCK), np.zeros((ROW_BLOCK, _width(block)))))
            at, own = np.frombuffer(rows, np.uint16), np.frombuffer(touched, np.float32).astype(float)
            n[at] += own
            x[at] += np.frombuffer(weights, np.float16).reshape(-1, _width(block)).astype(float) * own[:, None]
    for block, (n, x) in total.items():
        at = np.flatnonzero(n)
        mean = x[at] / n[at, None]
        yield from _packed([(block, at.astype(np.uint16).tobytes(), n[at].astype(np.float32).tobytes(), mean.astype(np.float16).tobytes(), first)]).to_batches()


def averaged(partial: DataFrame) -> DataFrame:
    """The average of all chunks' weights by block, as a tree: each part has averaged its own, then come FAN tasks for each block, then one,
    so that what the last ones read does not grow with the number of chunks beyond FAN rows a block. Chunks are dealt to a fixed number of
    parts and every sum goes by their numbers, so the same documents give the same weights, however they came. Parts are not averaged
    again where they were made: that would be a second Python worker beside each that trains."""
    blocks = (ROWS + INSIDE_ROWS) // ROW_BLOCK
    fans = partial.repartition(blocks * FAN, "block", F.pmod("source", F.lit(FAN))).sortWithinPartitions("block", "source").mapInArrow(_average, BLOCKS)
    return fans.repartition(blocks, "block").sortWithinPartitions("block", "source").mapInArrow(_average, BLOCKS)


def train(chunked: DataFrame, parts: int, totals: DataFrame, bias: np.ndarray, cells: np.ndarray, frequent: list[tuple[int, int]], folds: int, held_out: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Weights of classes and within classes after ``rounds`` passes over all training texts. The driver holds one table of each (8 and 2 MB)."""
    weights, seen = np.zeros((ROWS, CLASSES), np.float32), np.zeros(ROWS, np.float32)
    inside, seen_inside = np.zeros((INSIDE_ROWS, SLOTS), np.float32), np.zeros(INSIDE_ROWS, np.float32)
    part = F.pmod("chunk", F.lit(parts)).alias("part")
    dealt = chunked.select(part, "*").repartition(parts, "part")
    for _ in range(rounds):
        shared = chunked.sparkSession.sparkContext.broadcast({"bias": bias, "cells": cells, "weights": weights, "seen": seen, "inside": inside, "seen_inside": seen_inside, "frequent": frequent})
        partial = dealt.groupBy("part").cogroup(totals.select(part, "*").groupBy("part")).applyInArrow(_chunk_updates(shared, folds, held_out), BLOCKS)
        mean = materialise(averaged(partial), "class-weights")
        weights, seen, inside, seen_inside = weights.copy(), seen.copy(), inside.copy(), seen_inside.copy()
        for r in mean.toLocalIterator():
            w, n, first = (weights, seen, 0) if r["block"] < ROWS // ROW_BLOCK else (inside, seen_inside, ROWS // ROW_BLOCK)
            at = (r["block"] - first) * ROW_BLOCK + np.frombuffer(r["rows"], np.uint16).astype(np.int64)
            w[at] = np.frombuffer(r["weights"], np.float16).reshape(-1, w.shape[1])
            n[at] += np.frombuffer(r["touched"], np.float32)
        discard(mean)
    return weights, inside


def _chunk_scores(shared):
    def run(docs, counts):
        import pyarrow as pa

        names = {"doc_id": pa.int64(), "n_tokens": pa.int64(), "n_known": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}
        if not docs.num_rows:
            return pa.table({k: pa.array([], v) for k, v in names.items()})
        v = shared.value
        t = _Tokens(docs)
        klass, total = _aligned(t, counts, v["frequent"])
        base = np.log10((total + SMOOTH) / (v["tokens"] + SMOOTH * (v["words"] + 1)))
        chosen, (rows, inside) = klass[t.tokens], feature_rows(t, klass, total)
        score = log_chosen(v["bias"], None, v["weights"], rows, chosen)
        several = np.flatnonzero(chosen >= SINGLE)  # a frequent token is its class
        word = t.tokens[several]
        score[several] += log_inside(v["cells"], v["inside"], inside[:, several], chosen[several], slots(t.hash, total)[word], total[word] + SMOOTH)
        score /= math.log(10)
        first = np.cumsum(t.size) - t.size
        add = lambda x: np.add.reduceat(x, first)  # noqa: E731  no text is without a token
        columns = [t.ids, t.size, add((total[t.tokens] > 0).astype(np.int64)), add(base[t.tokens]), add(score)]
        return pa.table({k: pa.array(x, kind) for (k, kind), x in zip(names.items(), columns, strict=True)})

    return run


def word_totals(dealt: DataFrame, chunks: int, folds: int, held_out: int, together: int = CHUNKS_TOGETHER) -> tuple[DataFrame, DataFrame]:
    """For each chunk and range of hashes the totals of the chunk's words, and what ranges have in all (as _of_range has it)."""
    ranges = max(32, chunks // CHUNKS_A_RANGE)
    listed = materialise(dealt.groupBy("chunk").applyInArrow(_chunk_words(ranges, folds, held_out, together), WORDS), "chunk-words")
    sums = listed.groupBy("range", "part").applyInArrow(_summed, _SUMS)
    parts = -(-chunks // together)
    if parts > 1:
        sums = sums.groupBy("range").applyInArrow(_summed, _SUMS)
    sums = materialise(sums, "range-words")
    every = sums.drop("part").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    key = ("range", "part")
    totals = listed.select("range", "part", "chunk", "hashes", "checks").groupBy(*key).cogroup(every.groupBy(*key)).applyInArrow(_to_chunks, "chunk int, range int, totals binary")
    totals = materialise(totals, "chunk-totals")
    found = materialise(sums.groupBy("range").applyInArrow(_of_range, _CELLS), "range-classes")
    discard(listed, sums)
    return totals, found


def score_texts(docs: DataFrame, folds: int = 10, held_out: int = 0, rounds: int = ROUNDS, together: int = CHUNKS_TOGETHER) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every document."""
    spark = docs.sparkSession
    docs = id_and_text(docs)
    chunks = chunk_count(docs)
    parts = -(-chunks // CHUNKS_A_TASK)
    chunked = docs.select(chunk_of(F.col("doc_id"), chunks).alias("chunk"), "doc_id", "text")
    dealt = chunked.repartition(parts, "chunk")
    totals, found = word_totals(dealt, chunks, folds, held_out, together)
    # A frequent token's class is its rank; the others' sums by cell are CLASSES x SLOTS rows.
    top = found.where("hash is not null").orderBy(F.desc("total"), "hash", "check").limit(SINGLE).collect()
    frequent = [(r["hash"], r["check"]) for r in top]
    cell_tokens, cell_words = np.zeros(CLASSES * SLOTS), np.zeros(CLASSES * SLOTS)
    for r in found.where("hash is null").groupBy("cell").agg(F.sum("total").alias("tokens"), F.sum("words").alias("words")).collect():
        cell_tokens[r["cell"]], cell_words[r["cell"]] = r["tokens"], r["words"]
    for rank, r in enumerate(top):
        cell_tokens[r["cell"]] -= r["total"]
        cell_words[r["cell"]] -= 1
        cell_tokens[rank * SLOTS], cell_words[rank * SLOTS] = r["total"], 1
    tokens, words = int(cell_tokens.sum()), int(cell_words.sum())
    bias = np.log((cell_tokens.reshape(CLASSES, SLOTS).sum(1) + SMOOTH) / (tokens + SMOOTH * CLASSES)).astype(np.float32)
    cells = cell_bias(cell_tokens, cell_words)
    weights, inside = train(chunked, parts, totals, bias, cells, frequent, folds, held_out, rounds)
    shared = spark.sparkContext.broadcast({"bias": bias, "cells": cells, "weights": weights, "inside": inside, "tokens": tokens, "words": words, "frequent": frequent})
    scored = dealt.groupBy("chunk").cogroup(totals.groupBy("chunk")).applyInArrow(_chunk_scores(shared), "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op5_language_model(spark, sf_dir: str) -> DataFrame:
    """Score every document; the fold crc32(doc_id) mod 10 = 0 is held out."""
    found = score_texts(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", (crc_mod_col(F.col("doc_id"), 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
