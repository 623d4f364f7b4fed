"""SimHash near-duplicate detection with pigeonhole blocks.

A fingerprint is the bitwise majority of the XXH64 values of a text's word shingles. It is cut into blocks; two fingerprints
that differ in at most ``distance`` bits agree in at least ``blocks - distance`` blocks, so every choice of that many blocks is
a key, and each close pair shares a key. Within a key the Hamming distance is verified. Equal fingerprints are one node from
the start, and a key hands on a spanning forest of its links rather than all pairs, which keeps every component. A key with
very many different fingerprints is dealt out: its rows are split into parts and each pair of parts is a task of its own, so
no task holds more than two parts and no link is lost.

Defined results: null, empty and blank texts have fingerprint zero and link like any other. Repeated rows share a fingerprint
and so a component. Rows with a null doc_id link too; a component without any doc_id has a null component_id. Columns other than doc_id and text are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import LOWER, id_and_text, materialise, read_table, run_bounds, sorted_runs, text_bytes
from textloom.llm.components import components

SHINGLE = 4
DISTANCE = 4
SEED = 42
#: Different fingerprints that one task compares at once, two parts of a key.
PART = 4096


def fingerprint(text: bytes, words_in_shingle: int = SHINGLE) -> int:
    import xxhash

    words = text.translate(LOWER).split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) < words_in_shingle:
        return digest(joined, SEED)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    end = np.cumsum(size)
    starts, ends = (end - size).tolist(), (end - 1)[words_in_shingle - 1 :].tolist()
    counts = np.zeros(64, np.int64)
    for low in range(0, len(ends), 1 << 16):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[low : low + (1 << 16)], ends[low : low + (1 << 16)], strict=False)], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(ends), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words_in_shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) and text_hash (xxhash64 of the text) of every row."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            fp = np.array([fingerprint(t, words_in_shingle) for t in text_bytes(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64)), batch.column(2)], ["doc_id", "fp", "text_hash"])

    return id_and_text(docs).withColumn("text_hash", F.xxhash64("text")).mapInArrow(run, "doc_id long, fp long, text_hash long")


def block_scheme(n: int, distance: int = DISTANCE) -> tuple[int, int]:
    """Blocks and how many of them a key takes: as few as leave some sixteen of n different fingerprints to a key by chance."""
    for agree in range(1, 5):
        blocks = distance + agree
        if n <= 16 << (64 * agree // blocks):
            break
    return blocks, agree


def block_keys(fp: str, blocks: int, agree: int):
    """An array of 64-bit keys: the number of the choice of blocks and their bits, hashed together."""
    cut = [64 * i // blocks for i in range(blocks + 1)]
    part = [f"(shiftrightunsigned({fp}, {a}) & {(1 << (b - a)) - 1}L)" for a, b in zip(cut, cut[1:], strict=False)]
    return F.expr("array(" + ", ".join(f"xxhash64({i}, {', '.join(part[j] for j in c)})" for i, c in enumerate(combinations(range(blocks), agree))) + ")")


def forest(fp: np.ndarray, node: np.ndarray, left: np.ndarray, right: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links between the rows left and the rows right (places in fp)."""
    parent = {}

    def find(x):
        while parent.get(x, x) != x:
            parent[x] = x = parent.get(parent[x], parent[x])
        return x

    out = []
    for low in range(0, len(left), 256):
        rows = left[low : low + 256]
        near = np.bitwise_count(fp[rows][:, None] ^ fp[right][None, :]) <= distance
        for i, j in zip(*np.nonzero(near), strict=True):
            a, b = find(int(rows[i])), find(int(right[j]))
            if a != b:
                parent[a] = b
                out.append((int(node[rows[i]]), int(node[right[j]])))
    return out


def near_links(fps: DataFrame, distance: int = DISTANCE, part: int = PART) -> DataFrame:
    """Links u, v between nodes whose fingerprints differ in at most distance bits, as many as keep the components.

    fps: fp and node, each fp once."""
    blocks, agree = block_scheme(fps.count(), distance)
    keyed = fps.select("fp", "node", F.explode(block_keys("fp", blocks, agree)).alias("key"))
    heavy = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    dealt = (
        keyed.join(heavy, "key")
        .withColumn("parts", F.expr(f"cast(ceil(n / {part}) as int)"))
        .withColumn("own", F.expr("cast(pmod(xxhash64(fp), parts) as int)"))
        .withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
        .select("key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "fp", "node")
    )

    def run(batches):
        import pyarrow as pa

        for t in sorted_runs(batches, ["key", "a", "b"]):
            key, a, b, own = (t.column(c).to_numpy() for c in ("key", "a", "b", "own"))
            fp, node = t.column("fp").to_numpy().view(np.uint64), t.column("node").to_numpy()
            bounds = run_bounds(key, a, b)
            size = np.diff(bounds)
            run_of = np.repeat(np.arange(len(size)), size)
            small = (size <= 32)[run_of] & (a == b)
            u, v = [], []
            for d in range(1, int(min(32, size.max()))):  # pairs d rows apart in all small runs at once
                i = np.flatnonzero(small[:-d] & (run_of[:-d] == run_of[d:]))
                i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= distance]
                u.append(node[i])
                v.append(node[i + d])
            for r in np.flatnonzero((size > 32) | (a != b)[bounds[:-1]]):
                rows = np.arange(bounds[r], bounds[r + 1])
                left, right = (rows, rows) if a[rows[0]] == b[rows[0]] else (rows[own[rows] == a[rows[0]]], rows[own[rows] == b[rows[0]]])
                if found := forest(fp, node, left, right, distance):
                    x, y = np.array(found, np.int64).T
                    u.append(x)
                    v.append(y)
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], ["u", "v"])

    return dealt.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b").mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, words_in_shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """For each row: doc_id, fp (long), text_hash, component (its smallest fp) and component_id: the smallest doc_id that links reach."""
    fps = materialise(fingerprints(docs, words_in_shingle), "fingerprints")
    nodes = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprint-nodes")
    reach = components(near_links(nodes.select("fp", F.col("fp").alias("node")), distance))
    of_fp = nodes.join(reach, nodes["fp"] == reach["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    of_fp = materialise(of_fp, "fingerprint-components")
    ids = of_fp.groupBy("component").agg(F.min("first").alias("component_id"))
    return fps.join(of_fp.join(ids, "component").select("fp", "component", "component_id"), "fp").select("doc_id", "fp", "text_hash", "component", "component_id")


def near_copies(docs: DataFrame, words_in_shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """doc_id and text_hash of the rows of every component but one: that with the smallest doc_id stays, of several texts with this
    doc_id the one with the smallest hash. Rows that repeat with doc_id and text stay or go together."""
    found = materialise(near_duplicates(docs, words_in_shingle, distance), "components")
    head = F.col("doc_id").eqNullSafe(F.col("component_id"))
    heads = found.where(head).groupBy(F.col("component").alias("head")).agg(F.min("text_hash").alias("least"), F.max("text_hash").alias("most")).where("least < most")
    again = found.where(head).join(heads, F.col("component") == F.col("head")).where("text_hash > least").select("doc_id", "text_hash")
    return found.where(~head).select("doc_id", "text_hash").unionAll(again)


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
