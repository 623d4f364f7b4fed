"""Repair of the turn structure of conversations with the fewest edits.

A conversation becomes a graph: a node for each pair of a place between rows and a state of the role grammar, an arc for each edit. Least
costs forward from the start and backward from the end tell the tight arcs, those that lie on some cheapest way; a walk along tight arcs
with the set of nodes that the letters so far can reach takes the least letter at each step, so among equal costs the audit is the least.

Rows are dealt by ranges of (conversation, turn), not by conversation, so one conversation may be as long as it likes: a row of it is one
byte, a stretch of at most BLOCK rows is a block, and a block is known to its neighbours by sixteen numbers, the least cost from
each state to each state. Those are put together over the blocks of a conversation forward and backward, then every block is walked
by itself from each state that a cheapest way may enter it in. A conversation that lies inside one block, as nearly all do, is solved where
it is read. Only the digest of a repaired conversation is sequential: its rows stream through one task in order, and none is held.

Defined results: a null role or text is one space, as are a null conv_id and turn where the damage is dealt; rows without conv_id are one
conversation. Rows of one turn stand by a digest of role and text, equal rows together. An empty role has no initial, which no neighbour
goes with. Of a conversation that is damaged to nothing, all counts are zero and the audit and the repaired text are empty. An empty table
gives no rows. Extra columns are passed over.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import materialise, read_table

#: White space of the contract.
BLANKS = " \t\n\x0b\x0c\r"
#: Rows of a block; rows of one digest that a single record stands for at most.
BLOCK, COPIES = 1 << 16, 1 << 8
#: Costs. Fixed by the contract.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Role classes by initial, and faults of a row; MUST_GO holds blank and repeated rows.
S, U, A, NEITHER = range(4)
FINE, CUT, MUST_GO = range(3)
#: States of (s?(ua)+)?: nothing yet, after s, after u, after a. END: the states in which a conversation may end.
STATES, END = 4, (True, False, False, True)
#: NEXT[state][class]: where a row of that class leads. ADDED[state]: the class that an inserted or reroled row must have.
NEXT = ((1, 2, None, None), (None, 2, None, None), (None, None, 3, None), (None, 2, None, None))
ADDED = (U, U, A, U)
ROLES = {U: "user", A: "assistant"}
FAR = 1 << 40


def _closure() -> np.ndarray:
    """Least cost from state to state by inserted rows alone."""
    c = np.full((STATES, STATES), FAR, np.int64)
    for s in range(STATES):
        at, cost = s, 0
        while cost < c[s, at]:
            c[s, at] = cost
            at, cost = NEXT[at][ADDED[at]], cost + INSERT
    return c


def _row_arcs() -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Of the edits of a row, by letter: cost and next state, [class + 4 * fault][state]; FAR where there is no such arc."""
    out = {}
    for letter in "DKR":
        cost, to = np.full((12, STATES), FAR, np.int64), np.zeros((12, STATES), np.int64)
        for code in range(12):
            kind, fault = code % 4, code // 4
            for s in range(STATES):
                late = TRUNCATED if fault == CUT else 0
                if letter == "D":
                    cost[code, s], to[code, s] = DELETE, s
                elif fault != MUST_GO and letter == "K" and NEXT[s][kind] is not None:
                    cost[code, s], to[code, s] = KEEP + late, NEXT[s][kind]
                elif fault != MUST_GO and letter == "R":
                    cost[code, s], to[code, s] = REROLE + late, NEXT[s][ADDED[s]]
        out[letter] = cost, to
    return out


CLOSURE, ARCS = _closure(), _row_arcs()
AFTER_INSERT = np.array([NEXT[s][ADDED[s]] for s in range(STATES)])


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of matrices of costs: least sums in place of sums of products."""
    return np.minimum((a[..., :, :, None] + b[..., None, :, :]).min(-2), FAR)


def _steps() -> np.ndarray:
    """Inserted rows, then a row of each code: least cost from state to state. The last one is no row at all."""
    w = np.full((13, STATES, STATES), FAR, np.int64)
    for cost, to in ARCS.values():
        for code in range(12):
            for s in range(STATES):
                w[code, s, to[code, s]] = min(w[code, s, to[code, s]], cost[code, s])
    out = times(np.broadcast_to(CLOSURE, w.shape), w)
    out[12] = np.where(np.eye(STATES, dtype=bool), 0, FAR)
    return out


STEPS, NO_ROW = _steps(), 12
START = np.where(np.arange(STATES) == 0, 0, FAR)
#: Cost from each state to the end, inserted rows among it.
FINISH = np.where(END, CLOSURE, FAR).min(1)


def block_matrix(codes: np.ndarray) -> np.ndarray:
    """Least cost from each state before the rows to each state behind the last."""
    m = STEPS[codes]
    while len(m) > 1:
        rest = m[len(m) - len(m) % 2 :]
        m = np.concatenate([times(m[0 : len(m) - len(rest) : 2], m[1 : len(m) - len(rest) : 2]), rest])
    return m[0]


def tight_arcs(codes: list[np.ndarray], ahead: np.ndarray, behind: np.ndarray):
    """Of blocks side by side: least costs forward from ``ahead`` and backward from ``behind``, both a row for each block, and the arcs
    whose two sides and own cost add up to the least cost of all: letter -> [place][block][state]; the costs forward, inserted rows at
    the node among them; and the cost of all by the state before the block."""
    n = max(map(len, codes))
    grid = np.full((n, len(codes)), NO_ROW)
    for c, own in enumerate(codes):
        grid[: len(own), c] = own
    fore, back = np.empty((n + 1, len(codes), STATES), np.int64), np.empty((n + 1, len(codes), STATES), np.int64)
    fore[0], back[n] = ahead, behind
    for i in range(n):
        fore[i + 1] = np.minimum((fore[i][:, :, None] + STEPS[grid[i]]).min(1), FAR)
    for i in range(n - 1, -1, -1):
        back[i] = np.minimum((STEPS[grid[i]] + back[i + 1][:, None, :]).min(2), FAR)
    entering = fore[0] + back[0]
    total = entering.min(1)
    fore = np.minimum((fore[..., :, None] + CLOSURE).min(-2), FAR)  # inserted rows at a node belong to it
    at = np.arange(len(codes))
    tight = {"I": fore + INSERT + back[..., AFTER_INSERT] == total[:, None]}
    for letter, (cost, to) in ARCS.items():
        live = np.where(grid == NO_ROW, 0, grid)
        tight[letter] = (fore[:-1] + cost[live] + back[1:][np.arange(n)[:, None, None], at[:, None], to[live]] == total[:, None]) & (grid != NO_ROW)[..., None]
    return tight, fore, entering


def walk(codes, tight: dict, fore: list, total: int, entry: set[int], last: bool) -> tuple[str, int]:
    """The letters of the least way from the entry states along tight arcs, and the state behind the block. codes, tight, fore: of one
    block, as lists."""
    frontier, i, n, letters = set(entry), 0, len(codes), []
    while True:
        if i == n and (not last or any(END[s] and fore[i][s] == total for s in frontier)):
            return "".join(letters), min(s for s in frontier if not last or END[s] and fore[i][s] == total)
        for letter in "DIKR":
            if letter != "I" and i == n:
                continue
            from_ = [s for s in frontier if tight[letter][i][s]]
            if from_:
                break
        letters.append(letter)
        if letter == "I":
            frontier = {int(AFTER_INSERT[s]) for s in from_}
        else:
            frontier = {int(ARCS[letter][1][codes[i]][s]) for s in from_}
            i += 1


def solve(codes: list[np.ndarray], ahead: np.ndarray, behind: np.ndarray, last: list[bool]) -> list[tuple[int, dict[int, tuple[str, int]]]]:
    """For each block the least cost of its whole conversation and, by the states in which a cheapest way may enter it, the letters and
    the state behind it. ahead: costs from the start to the states before the block; behind: from those behind it to the end. Blocks of
    like lengths go together."""
    out: list = [None] * len(codes)
    order = sorted(range(len(codes)), key=lambda c: len(codes[c]))
    low = 0
    while low < len(order):
        high = low
        while high < len(order) and (high == low or len(codes[order[high]]) <= 2 * len(codes[order[low]]) + 8 and (high - low) * len(codes[order[high]]) < BLOCK):
            high += 1
        own = order[low:high]
        tight, fore, entering = tight_arcs([codes[c] for c in own], ahead[own], behind[own])
        total = entering.min(1)
        for k, c in enumerate(own):
            n = len(codes[c])
            t, f, rows = {x: y[: n + 1, k].tolist() for x, y in tight.items()}, fore[: n + 1, k].tolist(), codes[c].tolist()
            least = int(total[k])
            out[c] = least, {s: walk(rows, t, f, least, {s}, last[c]) for s in range(STATES) if entering[k, s] == least}
        low = high
    return out


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies (equal rows that stand there): the contract's damage, dealt by a checksum of conv_id and turn."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    lot = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(lot == 1, F.lit("")).when(lot == 2, F.translate(said("text"), ".!?", "")).otherwise(said("text"))
    return rows.where(lot != 0).select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.when(lot == 4, F.lit("user")).otherwise(said("role")).alias("role"), text.alias("text"), F.when(lot == 3, 2).otherwise(1).cast("long").alias("copies")
    )


def row_digest(role: Column, text: Column) -> Column:
    """Stands for role and text, and orders the rows of a turn."""
    return F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))


def stretches(rows: DataFrame) -> DataFrame:
    """From conv_id, turn, role, text, copies: rows without text, those that are alike as one: conv_id, turn, digest, piece, copies (at
    most COPIES), code of the first copy and code of the others, and counts of faults."""
    end = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = F.when(end == "", MUST_GO).when(F.substring(end, -1, 1).isin(".", "!", "?"), FINE).otherwise(CUT)
    first = F.substring("role", 1, 1)
    kind = F.when(first == "s", S).when(first == "u", U).when(first == "a", A).otherwise(NEITHER)
    alike = rows.select("conv_id", "turn", row_digest(F.col("role"), F.col("text")).alias("digest"), kind.alias("kind"), fault.alias("fault"), "copies")
    alike = alike.groupBy("conv_id", "turn", "digest", "kind", "fault").agg(F.sum("copies").alias("all"))
    seen = alike.where(F.col("fault") != MUST_GO).groupBy(F.col("conv_id").alias("its conv"), F.col("digest").alias("its digest"))
    seen = seen.agg(F.min(F.struct("turn")).alias("first"), F.count(F.lit(1)).alias("turns")).where("turns > 1")
    met = alike.join(seen, F.col("conv_id").eqNullSafe(F.col("its conv")) & (F.col("digest") == F.col("its digest")), "left")
    repeated = F.col("first").isNotNull() & ~F.col("first.turn").eqNullSafe(F.col("turn"))
    met = met.select("conv_id", "turn", "digest", "kind", "fault", "all", repeated.alias("repeated"), F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(`all` - 1) div {COPIES}"))).alias("piece"))
    lead = (F.col("piece") == 0) & ~F.col("repeated") & (F.col("fault") != MUST_GO)
    copies = F.least(F.lit(COPIES).cast("long"), F.col("all") - F.col("piece") * COPIES)
    blank = F.when(F.col("fault") == MUST_GO, copies).otherwise(0)
    return met.select(
        "conv_id", "turn", "digest", "piece", copies.alias("copies"), (F.col("kind") + 4 * F.when(lead, F.col("fault")).otherwise(MUST_GO)).cast("int").alias("code"), (F.col("kind") + 4 * MUST_GO).cast("int").alias("again"),
        blank.alias("blank"), (copies - blank - lead.cast("long")).alias("duplicate"), (lead & (F.col("fault") == CUT)).cast("long").alias("truncated"),
    )


LEGAL = ((False, True, False, False), (False, False, True, False), (False, True, False, False), (False, False, False, False))
_LEGAL = np.array(LEGAL)
#: Of a block or a whole conversation; turns are those at its ends, distinct ones without null.
COUNTS = "blank long, duplicate long, truncated long, illegal long, least_turn long, most_turn long, turns long, kind_first int, kind_last int"


class _Block:
    """Rows of one conversation as they come, up to BLOCK or a little more."""

    def __init__(self):
        self.codes, self.sums, self.turns, self.n = [], np.zeros(3, np.int64), [], 0

    def add(self, codes, sums, turns) -> None:
        self.codes.append(codes)
        self.sums += sums
        self.turns.append(turns)
        self.n += len(codes)

    def row(self) -> dict:
        codes, turns = np.concatenate(self.codes), np.concatenate(self.turns)
        kinds = codes % 4
        said = {"codes": codes.astype(np.uint8).tobytes()} | dict(zip(("blank", "duplicate", "truncated"), self.sums.tolist(), strict=True))
        said |= {"illegal": int((~_LEGAL[kinds[:-1], kinds[1:]]).sum()), "kind_first": int(kinds[0]), "kind_last": int(kinds[-1])}
        none = not len(turns)
        return said | {"least_turn": None if none else int(turns[0]), "most_turn": None if none else int(turns[-1]), "turns": 0 if none else 1 + int((turns[1:] != turns[:-1]).sum())}


def _arrow_rows(rows: list[dict], schema: str, key_type):
    import pyarrow as pa

    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32())}
    fields = [("conv_id", key_type), *((name, kinds[kind]) for name, kind in (x.strip().rsplit(" ", 1) for x in schema.split(",")))]
    return pa.RecordBatch.from_pylist(rows, pa.schema(fields))


SOLVED = f"{COUNTS}, cost long, audit string"
BLOCKS = f"{SOLVED}, part int, number int, codes binary, matrix array<long>"


def blocks_of(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """From rows sorted within ranges of (conv_id, turn, digest, piece): conversations that a range holds whole in one block, with cost and
    audit, and blocks of others, with codes and matrix."""
    key = rows.schema["conv_id"].dataType

    def run(batches):
        from pyspark import TaskContext

        part, number, open_, conv, first, key_type, whole = TaskContext.get().partitionId(), 0, None, None, True, None, []

        def flush():
            codes = [np.frombuffer(r["codes"], np.uint8) for r in whole]
            n = len(whole)
            for r, (cost, ways) in zip(whole, solve(codes, np.tile(START, (n, 1)), np.tile(FINISH, (n, 1)), [True] * n), strict=True):
                r |= {"audit": ways[0][0], "cost": cost, "codes": None}
            out = _arrow_rows(whole, BLOCKS, key_type)
            whole.clear()
            return out

        def apart(block):
            nonlocal number
            r = block.row() | {"conv_id": conv, "part": part, "number": number}
            r["matrix"] = block_matrix(np.frombuffer(r["codes"], np.uint8)).ravel().tolist()
            number += 1
            return _arrow_rows([r], BLOCKS, key_type)

        split = False  # the conversation at hand has a block already
        for batch in batches:
            key_type = batch.schema.field("conv_id").type
            convs, copies = batch.column("conv_id"), batch.column("copies").to_numpy()
            code = np.repeat(batch.column("again").to_numpy(), copies)
            at = np.cumsum(copies) - copies
            code[at] = batch.column("code").to_numpy()
            turn, known = batch.column("turn").fill_null(0).to_numpy(), batch.column("turn").is_valid().to_numpy(zero_copy_only=False)
            sums = np.stack([batch.column(c).to_numpy() for c in ("blank", "duplicate", "truncated")], 1)
            ids = convs.to_pylist()
            bounds = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1]), len(ids)]
            for a, b in zip(bounds, bounds[1:], strict=False):
                if a == b:
                    continue
                if open_ is None or ids[a] != conv:
                    if open_ is not None:
                        if not (split or first):
                            whole.append(open_.row() | {"conv_id": conv})
                        elif open_.n:
                            yield apart(open_)
                        first = False
                    open_, conv, split = _Block(), ids[a], False
                step = max(1, block // COPIES)
                for low in range(a, b, step):
                    high = min(b, low + step)
                    stop = at[high - 1] + copies[high - 1]
                    open_.add(code[at[low] : stop], sums[low:high].sum(0), turn[low:high][known[low:high]])
                    if open_.n >= block:
                        yield apart(open_)
                        open_, split = _Block(), True
            if len(whole) >= 2000:
                yield flush()
        if open_ is not None and open_.n:
            yield apart(open_)
        if whole:
            yield flush()

    return rows.mapInArrow(run, f"conv_id {key.simpleString()}, {BLOCKS}")


def around(blocks: DataFrame) -> DataFrame:
    """part, number, ahead, behind, last of each block: least costs from the start of its conversation and to its end. A block is sixteen
    numbers here; those of one conversation come together, one for BLOCK rows and each range."""

    def run(table):
        import pyarrow as pa

        table = table.sort_by([("part", "ascending"), ("number", "ascending")])
        m = np.array(table.column("matrix").to_pylist(), np.int64).reshape(-1, STATES, STATES)
        ahead, behind = [START], [FINISH]
        for step in m[:-1]:
            ahead.append(np.minimum((ahead[-1][:, None] + step).min(0), FAR))
        for step in m[:0:-1]:
            behind.append(np.minimum((step + behind[-1]).min(1), FAR))
        last = [False] * (len(m) - 1) + [True]
        return pa.table({"part": table.column("part"), "number": table.column("number"), "ahead": pa.array([x.tolist() for x in ahead]), "behind": pa.array([x.tolist() for x in behind[::-1]]), "last": pa.array(last)})

    return blocks.select("conv_id", "part", "number", "matrix").groupBy("conv_id").applyInArrow(run, "part int, number int, ahead array<long>, behind array<long>, last boolean")


WALKED = f"{COUNTS}, part int, number int, cost long, letters array<string>, exits array<int>"


def walked(blocks: DataFrame) -> DataFrame:
    """Blocks with ahead, behind and last: the least cost of the whole, and by the state before the block its letters and the state behind."""
    key = blocks.schema["conv_id"].dataType
    same = ["conv_id", *(x.split()[0] for x in COUNTS.split(", ")), "part", "number"]

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 16):
                own = batch.slice(i, 16).to_pylist()
                codes = [np.frombuffer(r["codes"], np.uint8) for r in own]
                found = solve(codes, np.array([r["ahead"] for r in own]), np.array([r["behind"] for r in own]), [r["last"] for r in own])
                rows = [{c: r[c] for c in same} | {"cost": cost, "letters": [ways.get(s, ("", 0))[0] for s in range(STATES)], "exits": [ways.get(s, ("", 0))[1] for s in range(STATES)]} for r, (cost, ways) in zip(own, found, strict=True)]
                yield _arrow_rows(rows, WALKED, batch.schema.field("conv_id").type)

    return blocks.mapInArrow(run, f"conv_id {key.simpleString()}, {WALKED}")


def joined(blocks: DataFrame) -> DataFrame:
    """Conversations from their walked blocks: counts, cost and audit."""
    key = blocks.schema["conv_id"].dataType

    def run(table):
        rows = table.sort_by([("part", "ascending"), ("number", "ascending")])
        light = rows.drop(["letters"]).to_pylist()
        out = {c: sum(r[c] for r in light) for c in ("blank", "duplicate", "truncated", "illegal", "turns")}
        out["illegal"] += sum(not LEGAL[a["kind_last"]][b["kind_first"]] for a, b in zip(light, light[1:], strict=False))
        known = [r for r in light if r["turns"]]
        out["turns"] -= sum(a["most_turn"] == b["least_turn"] for a, b in zip(known, known[1:], strict=False))
        out |= {"least_turn": known[0]["least_turn"] if known else None, "most_turn": known[-1]["most_turn"] if known else None, "kind_first": light[0]["kind_first"], "kind_last": light[-1]["kind_last"]}
        state, said = 0, []
        for i, r in enumerate(light):
            said.append(rows.column("letters")[i][state].as_py())
            state = r["exits"][state]
        out |= {"conv_id": light[0]["conv_id"], "cost": light[0]["cost"], "audit": "".join(said)}
        import pyarrow as pa

        return pa.Table.from_batches([_arrow_rows([out], SOLVED, table.schema.field("conv_id").type)])

    return blocks.groupBy("conv_id").applyInArrow(run, f"conv_id {key.simpleString()}, {SOLVED}")


def solved(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """From damaged rows: conv_id, counts of faults, turns at the ends, least cost and audit of every conversation that has rows."""
    order = ["conv_id", "turn", "digest", "piece"]
    blocks = materialise(blocks_of(stretches(rows).repartitionByRange(*order).sortWithinPartitions(*order), block), "conversation-blocks")
    open_ = blocks.where("codes is not null")
    met = open_.drop("cost", "audit").join(around(open_), ["part", "number"])
    split = joined(walked(met))
    return blocks.where("codes is null").select(split.columns).unionByName(split)


REPAIRED = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class _Repair:
    """Applies an audit to the rows of a conversation, one after the other, and keeps a running digest of what stays."""

    def __init__(self):
        self.counts, self.audit, self.at, self.state, self.sha, self.some = [0] * 6, "", 0, 0, hashlib.sha256(), False

    def put(self, role: str, text: str) -> None:
        if self.some:
            self.sha.update(b"\n")
        self.some = True
        self.sha.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))

    def inserted(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            kind = ADDED[self.state]
            self.put(ROLES[kind], "")
            self.state, self.at = NEXT[self.state][kind], self.at + 1

    def row(self, role: str, text: str) -> None:
        self.inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "D":
            return
        kind = ADDED[self.state] if letter == "R" else "sua".index(role[0])
        self.put(ROLES[kind] if letter == "R" else role, text)
        self.state = NEXT[self.state][kind]

    def result(self, conv) -> dict:
        self.inserted()
        return dict(zip(("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), self.counts, strict=True)) | {"conv_id": conv, "audit": self.audit, "repaired_sha256": self.sha.hexdigest()}


def repaired(rows: DataFrame, audits: DataFrame, every: DataFrame) -> DataFrame:
    """One row for each conversation of ``every``: counts, audit and the digest of its repaired rows.

    Rows stream in the order of their conversation behind a head that has its audit; a task holds one row of text at a time."""
    key = rows.schema["conv_id"].dataType
    gaps = F.when(F.col("turns") > 0, F.col("most_turn") - F.col("least_turn") + 1 - F.col("turns")).otherwise(0)
    none = lambda kind: F.lit(None).cast(kind)
    start = every.select("conv_id").distinct().select("conv_id", F.lit(0).alias("place"), none("long").alias("turn"), none("binary").alias("digest"), F.lit(1).cast("long").alias("copies"), F.lit("").alias("role"), F.lit("").alias("text"), F.array([F.lit(0).cast("long")] * 6).alias("counts"))
    head = audits.select("conv_id", F.lit(1).alias("place"), none("long").alias("turn"), none("binary").alias("digest"), F.lit(1).cast("long").alias("copies"), F.lit("").alias("role"), F.col("audit").alias("text"), F.array(gaps, "blank", "duplicate", "truncated", "illegal", "cost").alias("counts"))
    body = rows.select("conv_id", F.lit(2).alias("place"), "turn", row_digest(F.col("role"), F.col("text")).alias("digest"), "copies", "role", "text", none("array<long>").alias("counts"))

    def run(batches):
        conv, own, out, key_type = None, None, [], None
        for batch in batches:
            key_type = batch.schema.field("conv_id").type
            cols = [batch.column(c).to_pylist() for c in ("conv_id", "place", "copies", "role", "text", "counts")]
            for c, place, copies, role, text, counts in zip(*cols, strict=True):
                if own is None or c != conv:
                    if own is not None:
                        out.append(own.result(conv))
                    conv, own = c, _Repair()
                if place == 1:
                    own.audit, own.counts = text, counts
                elif place == 2:
                    for _ in range(copies):
                        own.row(role, text)
            if len(out) >= 1000:
                yield _arrow_rows(out, REPAIRED, key_type)
                out = []
        if own is not None:
            yield _arrow_rows([*out, own.result(conv)], REPAIRED, key_type)

    stream = start.unionByName(head).unionByName(body).repartition("conv_id").sortWithinPartitions("conv_id", "place", "turn", "digest")
    return stream.mapInArrow(run, f"conv_id {key.simpleString()}, {REPAIRED}")


def op12_conversation_repair(spark, sf_dir: str) -> DataFrame:
    """Every conversation of the table, damaged as the contract says and repaired."""
    table = read_table(spark, sf_dir, "conversations")
    rows = damage(table)
    return repaired(rows, solved(rows), table)
