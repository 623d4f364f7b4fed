"""Benchmark decontamination by template canonicalisation.

Words are lower-cased; a number, a name (a capitalised word inside a sentence, not one in capitals) and a unit behind a number become typed
placeholders, so a question that was asked again with other values keeps its templates. Windows of five template words are hashed
and joined with the windows of the benchmark. Every window that a document shares with an item has an alignment: its place in the
document less its place in the item. Around each alignment, as far as the item is long, every window of the item counts once, where it
stands nearest to the alignment; there must be enough of them, and the values that stand in their placeholders must be consistent:
a value of the item always became the same value of the document. The best alignment gives the figures, so sentences of the same
templates elsewhere in a document neither hide a copy nor add to one.

The benchmark's texts travel with the tasks while they are few (SHIPPED_BYTES, checked), and documents are then judged where they are
read. The windows of a larger benchmark fill a screen of fixed size; windows of documents that it lets pass are joined by a shuffle on
the window's hash and judged by pairs of a document and an item. Either way all windows of whole texts are looked up. Words are located and hashed by array steps over bytes.

Defined results: null and empty texts hold no item; an item without words is found nowhere. A template window needs two words that are
not placeholders, whatever its size. An item with fewer than FEW such windows is also looked up by windows of its literal words,
lower-cased, so that a copy is found whatever stands around it. An item with fewer than five words is one window of all its words; if fewer
than two of them are no placeholders ("42", "5 kg"), it is found only where it is a whole sentence or line. Repeated windows of an item count
once. Rows with a null doc_id are documents of their own whose results have a null doc_id; those with a repeated doc_id give the best
of their results, and so do items that share an item_id. Items without an id are left out. Columns other than the id and the text are not read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import SCREEN_PARTS, SCREEN_WORDS, blocks, id_and_text, materialise, mix64, read_table, run_bounds, screen_of, sorted_runs, text_bytes

WINDOW = 5
#: Share of an item's windows that a document must have, and share of its slots that must be consistent.
THRESHOLD, CONSISTENT = 0.8, 0.5
#: Template windows from which on an item stands in every copy: the words before a copy can change its first window alone.
FEW = 5
#: Bytes of benchmark texts that travel with the tasks at most; a worker's tables of their windows take some hundred times as much.
SHIPPED_BYTES = 1 << 20
BLOCK_BYTES = 4 << 20
#: Units that become a placeholder behind a number.  A parameter by its nature; other words can be added.
UNITS = "mm cm m km in ft yd mi mg g kg t lb oz ml l s sec min h hr hrs second seconds minute minutes hour hours day days week weeks month months year years meter meters metre metres kilometer kilometers mile miles foot feet inch inches gram grams kilogram kilograms liter liters dollar dollars euro euros cent cents percent degree degrees mph kmh".split()

_P = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_P, -1, 1 << 64)
_TABLE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
#: Of a byte: 1 part of a word, 2 a digit, 4 a capital letter, 8 the end of a sentence.
_KIND = np.array([(48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128) | (48 <= b <= 57) << 1 | (65 <= b <= 90) << 2 | (b in b".!?:;\n") << 3 for b in range(256)], np.uint8)
NUMBER, NAME, UNIT = np.uint64(1), np.uint64(2), np.uint64(3)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def lower_case(raw: bytes) -> bytes:
    """Lower case with every character at its place; one whose lower case has another length in UTF-8 stays."""
    if raw.isascii():
        return raw.lower()
    text = raw.decode()
    low = text.lower().encode()
    if len(low) != len(raw):
        low = b"".join(x if len(x := c.lower().encode()) == len(c.encode()) else c.encode() for c in text)
    return low


def word_table(raw: bytes):
    """Start, end, and hash (of the lower-cased word) of every word of a buffer."""
    b = np.frombuffer(raw, np.uint8)
    kind = _KIND[b]
    word = np.zeros(len(b) + 2, np.int8)
    word[1:-1] = kind & 1
    edge = np.diff(word)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return start, end, np.zeros(0, np.uint64), kind
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_TABLE[np.frombuffer(lower_case(raw), np.uint8)] * _powers(_P, len(b)), out=total[1:])
    h = mix64((total[end] - total[start]) * _powers(_INVERSE, int(start[-1]) + 1)[start] + (end - start).astype(np.uint64))
    return start, end, h, kind


def _hash_of(word: str) -> int:
    return int(word_table(word.encode())[2][0])


def template(raw: bytes, doc_start: np.ndarray):
    """Words of several texts that stand one after the other, each ended by a new line: start, end, hash, template symbol, is placeholder,
    opens a sentence or line.

    doc_start: where the texts start."""
    start, end, h, kind = word_table(raw)
    if not len(start):
        return start, end, h, h, np.zeros(0, bool), np.zeros(0, bool)
    stops = np.concatenate([[0], np.cumsum((kind >> 3) & 1)])
    prev_end = np.concatenate([[0], end[:-1]])
    opens = stops[start] > stops[prev_end]
    opens[np.unique(np.searchsorted(start, doc_start).clip(max=len(start) - 1))] = True
    number = (kind[start] & 2) > 0
    second = np.append(kind, 0)[start + 1]
    name = ((kind[start] & 4) > 0) & ((second & 5) == 1) & ~opens  # a text in capitals has no names
    unit = np.zeros(len(start), bool)
    unit[1:] = number[:-1] & ~opens[1:] & np.isin(h[1:], np.array([_hash_of(u) for u in UNITS], np.uint64))
    symbol = np.where(number, NUMBER, np.where(name, NAME, np.where(unit, UNIT, h)))
    return start, end, h, symbol, number | name | unit, opens


def windows_of(symbol: np.ndarray, size: int, literal: bool = False) -> np.ndarray:
    """A hash of every ``size`` consecutive symbols; literal windows have hashes of their own."""
    n = len(symbol) - size + 1
    h = np.full(max(0, n), np.uint64(size + (1 << 32 if literal else 0)), np.uint64)
    for i in range(size if n > 0 else 0):
        h = mix64(h * np.uint64(0xFF51AFD7ED558CCD) + symbol[i : i + n])
    return h


def text_windows(texts: list[bytes], sizes: list[int]):
    """For each block of texts: the block's first text and a _Block."""
    for low, high in blocks([len(t) for t in texts], BLOCK_BYTES):
        yield low, _Block(texts[low:high], sizes)


class _Block:
    """Several texts and their windows: ``found`` has (window hash, first word, text, size) arrays, one for each size. Windows do not leave
    their text. Those of a negative size are of literal words."""

    def __init__(self, texts: list[bytes], sizes: list[int]):
        self.raw = b"\n".join([*texts, b""])
        doc_start = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        self.start, self.end, word, symbol, self.slot, opens = template(self.raw, doc_start[:-1])
        self.of = np.searchsorted(doc_start, self.start, side="right") - 1
        self.first_word = np.searchsorted(self.of, np.arange(len(texts) + 1))  # of each text
        filled = np.concatenate([[0], np.cumsum(~self.slot)])
        self.opens = np.append(opens, True)
        self.found = []
        for size in sizes:
            n, literal = abs(size), size < 0
            h = windows_of(word if literal else symbol, n, literal)
            own = filled[n:][: len(h)] - filled[: len(h)]
            inside = self.of[: len(h)] == self.of[n - 1 :][: len(h)]
            if not literal:
                inside &= own >= 2
            elif n < WINDOW:  # words that say nothing by themselves count as a whole sentence or line
                inside &= (own >= 2) | self.opens[: len(h)] & self.opens[n:][: len(h)]
            first = np.flatnonzero(inside)
            self.found.append((h[first], first, self.of[first], size))

    def values(self, first: int, size: int) -> tuple[str, ...]:
        """The values in the placeholders of a window, one in each place ("" where there is none); a literal window has none."""
        if size < 0:
            return ()
        return tuple(self.raw[self.start[i] : self.end[i]].decode(errors="replace").lower() if self.slot[i] else "" for i in range(first, first + size))


def item_rows(texts) -> list[tuple]:
    """Of each item (its place among texts) the different windows of each form: item, literal, words, windows, number of the window, its
    first place, hash, size, values."""
    out = []
    for item, t in enumerate(texts):
        n = len(word_table(t)[0])
        for _, b in text_windows([t], [min(WINDOW, n), -min(WINDOW, n)]) if n else ():
            found = b.found
            if len(np.unique(found[0][0])) >= FEW:
                found = found[:1]
            for h, first, _, size in found:
                h, at = np.unique(h, return_index=True)
                out += [(item, size < 0, n, len(h), k, int(first[i]), int(w), size, b.values(int(first[i]), size)) for k, (w, i) in enumerate(zip(h.tolist(), at, strict=True))]
    return out


def needed(windows, threshold: float):
    return np.ceil(np.asarray(windows) * threshold - 1e-9).astype(np.int64)


def judge(words: int, windows: int, need: int, consistent: float, number: np.ndarray, place: np.ndarray, mine: np.ndarray, item_values, doc_values) -> tuple | None:
    """The best alignment of an item in a document: n_matched, n_slots, n_consistent, n_changed; None if none will do.

    number, place, mine: of each shared window its number in the item and its places in the document and in the item.
    item_values(i), doc_values(i): what stands in the placeholders of the i-th."""
    offset = place - mine
    order = np.lexsort((place, offset))
    offset, number = offset[order], number[order]
    anchors = np.unique(offset)
    # Windows near an alignment are at least as many as different ones, so most alignments are left without a closer look.
    low, high = np.searchsorted(offset, anchors - words), np.searchsorted(offset, anchors + words, side="right")
    exact = np.searchsorted(offset, anchors, side="right") - np.searchsorted(offset, anchors)
    likely = np.flatnonzero(high - low >= need)
    best, value = None, {}
    for a in likely[np.argsort(-exact[likely], kind="stable")].tolist():
        own = np.arange(low[a], high[a])
        own = own[np.argsort(np.abs(offset[own] - anchors[a]), kind="stable")]
        first = np.unique(number[own], return_index=True)[1]
        if len(first) < need or best and len(first) < best[0]:
            continue
        pairs = set()
        for i in order[own[first]].tolist():
            if i not in value:
                value[i] = [p for p in zip(item_values(i), doc_values(i), strict=True) if p[0]]
            pairs.update(value[i])
        became: dict[str, set] = {}
        for x, y in pairs:
            became.setdefault(x, set()).add(y)
        steady = sum(len(y) == 1 for y in became.values())
        if steady >= consistent * len(became):
            found = (len(first), len(became), steady, sum(x != y for x, y in pairs))
            if best is None or (found[0], found[2] - found[1], -found[3]) > (best[0], best[2] - best[1], -best[3]):
                best = found
            if found[0] == windows and found[2] == found[1]:
                break
    return best


class _Items:
    """The windows of the shipped items, by hash."""

    def __init__(self, texts: tuple[bytes, ...], threshold: float):
        rows = sorted(item_rows(texts), key=lambda r: r[6])
        form: dict[tuple, int] = {}
        self.of = np.array([form.setdefault((r[0], r[1]), len(form)) for r in rows], np.int64)
        self.form = list(form)
        self.words, self.windows = np.zeros(len(form), np.int64), np.zeros(len(form), np.int64)
        for f, r in zip(self.of, rows, strict=True):
            self.words[f], self.windows[f] = r[2], r[3]
        self.need = needed(self.windows, threshold)
        self.number, self.place = np.array([r[4] for r in rows], np.int64), np.array([r[5] for r in rows], np.int64)
        self.hashes, self.first = np.unique(np.array([r[6] for r in rows], np.uint64), return_index=True)
        self.count = np.diff(np.append(self.first, len(rows)))
        self.values = [r[8] for r in rows]
        self.sizes = sorted({r[7] for r in rows})

    def found_in(self, texts: list[bytes], consistent: float):
        """(text, item, literal, n_windows, n_matched, n_slots, n_consistent, n_changed) of each item found in a text."""
        for low, b in text_windows(texts, self.sizes if len(self.hashes) else []):
            parts = [[np.zeros(0, np.int64)] * 4]
            for h, first, of, size in b.found:
                at = np.searchsorted(self.hashes, h).clip(max=len(self.hashes) - 1)
                hit = np.flatnonzero(self.hashes[at] == h)
                at, times = at[hit], self.count[at[hit]]
                nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                entry = np.repeat(self.first[at], times) + nth
                first, of = np.repeat(first[hit], times), np.repeat(of[hit], times)
                parts.append([of, entry, first, np.full(len(of), size)])
            of, entry, first, size = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((self.number[entry], self.of[entry], of))
            of, entry, first, size = of[order], entry[order], first[order], size[order]
            bounds = run_bounds(of, self.of[entry])
            new = np.concatenate([[True], self.number[entry[1:]] != self.number[entry[:-1]]]) if len(of) else np.zeros(0, bool)
            new[bounds[:-1]] = True
            several = np.add.reduceat(new, bounds[:-1]) if len(of) else np.zeros(0, np.int64)
            for r in np.flatnonzero(several >= self.need[self.of[entry[bounds[:-1]]]]).tolist():
                i = slice(bounds[r], bounds[r + 1])
                e, f, z, t = entry[i], first[i], size[i], int(of[bounds[r]])
                k = int(self.of[e[0]])
                got = judge(int(self.words[k]), int(self.windows[k]), int(self.need[k]), consistent, self.number[e], f - b.first_word[t], self.place[e], lambda j, e=e: self.values[e[j]], lambda j, f=f, z=z, b=b: b.values(int(f[j]), int(z[j])))
                if got:
                    yield (low + t, *self.form[k], int(self.windows[k]), *got)


@lru_cache(1)
def _items(texts: tuple[bytes, ...], threshold: float) -> _Items:
    """A worker's tables, kept for its next task."""
    return _Items(texts, threshold)


RESULT = "doc_id long, text_hash long, item_id long, literal boolean, n_windows long, n_matched long, n_slots long, n_consistent long, n_changed long"
_SPLIT = "\x1f"


def _result(rows: list[tuple]):
    import pyarrow as pa

    c = list(zip(*rows, strict=True)) if rows else [()] * 9
    kinds = [pa.bool_() if f.endswith("boolean") else pa.int64() for f in RESULT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(c, kinds, strict=True)], [f.split()[0] for f in RESULT.split(", ")])


def _hashed(docs: DataFrame) -> DataFrame:
    return id_and_text(docs).select("doc_id", "text", F.xxhash64("text").alias("text_hash"))


def _found_where_read(docs: DataFrame, items: list[tuple[int, bytes]], threshold: float, consistent: float) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches):
        held = _items(tuple(t for _, t in shared.value), threshold)
        for batch in batches:
            ids, hashes = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            rows = [(ids[t], hashes[t], shared.value[item][0], *rest) for t, item, *rest in held.found_in(text_bytes(batch.column(1)), consistent)]
            if rows:
                yield _result(rows)

    return _hashed(docs).mapInArrow(run, RESULT)


def _item_windows(items: DataFrame) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids = batch.column(0).to_pylist()
            out = [(ids[r[0]], *r[1:6], np.uint64(r[6]).view(np.int64), r[7], _SPLIT.join(r[8])) for r in item_rows(text_bytes(batch.column(1)))]
            c = list(zip(*out, strict=True)) if out else [()] * 9
            kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(c, kinds, strict=True)], ["item_id", "literal", "words", "windows", "number", "mine", "window", "size", "item_values"])

    return items.mapInArrow(run, "item_id long, literal boolean, words long, windows long, number long, mine long, window long, size int, item_values string")


def _document_windows(docs: DataFrame, sizes: list[int], screen: np.ndarray) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(screen)

    def passing(h):
        mask = np.uint64(64 * SCREEN_WORDS - 1)
        word = lambda at: shared.value[(h >> np.uint64(58)).astype(np.int64), (at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)
        return np.flatnonzero(word(h & mask) & word(h >> np.uint64(20) & mask))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids, hashes = batch.column(0), batch.column(2)
            for low, b in text_windows(text_bytes(batch.column(1)), sizes):
                for h, first, of, size in b.found:
                    keep = passing(h)
                    h, first, of = h[keep], first[keep], of[keep]
                    for i in range(0, len(h), 50_000):
                        part = slice(i, i + 50_000)
                        at = pa.array(low + of[part])
                        values = [_SPLIT.join(b.values(f, size)) for f in first[part].tolist()]
                        yield pa.RecordBatch.from_arrays([ids.take(at), hashes.take(at), pa.array(first[part] - b.first_word[of[part]]), pa.array(h[part].view(np.int64)), pa.array(values, pa.string())], ["doc_id", "text_hash", "place", "window", "doc_values"])

    return _hashed(docs).mapInArrow(run, "doc_id long, text_hash long, place long, window long, doc_values string")


def _found_by_shuffle(docs: DataFrame, items: DataFrame, threshold: float, consistent: float) -> DataFrame:
    windows = materialise(_item_windows(items), "item-windows")
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())  # at most 2 * WINDOW numbers
    key = ["doc_id", "text_hash", "item_id", "literal"]
    parts = screen_of(windows, F.col("window")).orderBy("screen part").toArrow()  # SCREEN_PARTS rows
    screen = parts.column("screen bits").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(SCREEN_PARTS, SCREEN_WORDS)
    met = _document_windows(docs, sizes, screen).join(windows.drop("size"), "window").drop("window")

    def run(batches):
        import pyarrow as pa

        for t in sorted_runs(batches, key):
            columns = [t.column(c).cast(pa.int64()).fill_null(0).to_numpy() for c in key] + [t.column("doc_id").is_null().cast(pa.int64()).to_numpy()]
            names = [t.column(c).to_pylist() for c in key]
            words, count, number, place, mine = (t.column(c).to_numpy() for c in ("words", "windows", "number", "place", "mine"))
            own, theirs = t.column("item_values"), t.column("doc_values")
            split = lambda c, i: c[i].as_py().split(_SPLIT)
            rows, bounds = [], run_bounds(*columns)
            for a, z in zip(bounds.tolist(), bounds[1:].tolist(), strict=False):
                got = judge(int(words[a]), int(count[a]), int(needed(count[a], threshold)), consistent, number[a:z], place[a:z], mine[a:z], lambda j, a=a: split(own, a + j), lambda j, a=a: split(theirs, a + j))
                if got:
                    rows.append((*(n[a] for n in names), int(count[a]), *got))
            if rows:
                yield _result(rows)

    return met.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, RESULT)


def found_in_texts(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, consistent: float = CONSISTENT, shipped_bytes: int = SHIPPED_BYTES) -> DataFrame:
    """doc_id, text_hash (xxhash64 of the text), item_id, literal and the figures of each item found in a row of docs."""
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    if (items.agg(F.sum(F.octet_length("text") + 8)).first()[0] or 0) <= shipped_bytes:
        return _found_where_read(docs, sorted((r["item_id"], r["text"].encode()) for r in items.collect()), threshold, consistent)
    # Texts of one id are items of their own until their results meet.
    items = items.select("item_id", "text", F.xxhash64("item_id", "text").alias("row"))
    found = _found_by_shuffle(docs, items.select(F.col("row").alias("item_id"), "text"), threshold, consistent)
    return found.withColumnRenamed("item_id", "row").join(items.select("row", "item_id"), "row").select(*[f.split()[0] for f in RESULT.split(", ")])


def contaminated(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """doc_id, item_id, n_windows, n_matched, containment, n_slots, n_consistent, n_changed for each item found in a document."""
    share = F.col("n_matched") / F.col("n_windows")
    found = found_in_texts(docs, benchmark, **settings).withColumn("containment", share)
    names = ["n_windows", "n_matched", "containment", "n_slots", "n_consistent", "n_changed"]
    rank = F.struct("literal", -F.col("containment"), -F.col("n_windows"), "n_changed", -F.col("n_consistent"), "n_slots")
    return found.groupBy("doc_id", "item_id").agg(F.min_by(F.struct(*names), rank).alias("best")).select("doc_id", "item_id", "best.*")


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item that it holds."""
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
