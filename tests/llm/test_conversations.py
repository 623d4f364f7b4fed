"""Conversation repair against a plain search for the cheapest and least audit."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from textloom.llm import conversations as c

SCHEMA = "conv_id long, turn long, role string, text string"
WHITE = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        out[conv] += []
        lot = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if lot == 1 else re.sub("[.!?]", "", text) if lot == 2 else text
        out[conv] += [(turn, "user" if lot == 4 else role, text)] * {0: 0, 3: 2}.get(lot, 1)
    digest = lambda r: hashlib.sha256(f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()).digest()
    return {k: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, digest(r))) for k, v in out.items()}


LEADS = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}  # states: nothing, s, u, a


def plain(rows):
    """Every way is followed, row by row, and of each state's the cheapest kept, then the least."""
    seen, faults, count = set(), [], Counter()
    for _, role, text in rows:
        fault = "blank" if not text.strip(WHITE) else "duplicate" if (role, text) in seen else "truncated" if text.rstrip(WHITE)[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
        count[fault] += 1
    named = {"u": "user", "a": "assistant"}

    def insert(best):
        todo = list(best.items())
        while todo:
            state, (cost, audit, kept) = todo.pop()
            for new in "ua":
                if to := LEADS.get((state, new)):
                    way = (cost + 5, audit + "I", [*kept, f"{named[new]}:"])
                    if to not in best or way[:2] < best[to][:2]:
                        best[to] = way
                        todo.append((to, way))
        return best

    best = insert({"": (0, "", [])})
    for (_, role, text), fault in zip(rows, faults, strict=True):
        new = {}
        late = 5 if fault == "truncated" else 0
        for state, (cost, audit, kept) in best.items():
            ways = [(state, cost + 2, "D", kept)]
            if fault not in ("blank", "duplicate"):
                if to := LEADS.get((state, role[:1])):
                    ways.append((to, cost + late, "K", [*kept, f"{role}:{text}"]))
                ways += [(LEADS[state, x], cost + 1 + late, "R", [*kept, f"{named[x]}:{text}"]) for x in "ua" if (state, x) in LEADS]
            for to, total, letter, said in ways:
                way = (total, audit + letter, said)
                if to not in new or way[:2] < new[to][:2]:
                    new[to] = way
        best = insert(new)
    cost, audit, kept = min((best[s] for s in ("", "a") if s in best), key=lambda w: w[:2])
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest()


NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def conversations(n, longest, seed):
    random.seed(seed)
    out = []
    for conv in range(n):
        for turn in range(random.randrange(1, longest)):
            if random.random() < 0.07:
                continue
            role = random.choice(["user", "assistant"] * 4 + ["system", "tool", "", None, "unknown", "a\n"])
            text = random.choice([f"Text {random.randrange(4)}.", f"Cut {random.randrange(9)}", "", " \n", None, "é!\t", " ", "x" * 50 + "?", f"{random.random()}."])
            out.append((conv if conv else None, None if random.random() < 0.03 else turn + 5, role, text))
    return out


def got(spark, rows, block, parts=None):
    df = spark.createDataFrame(rows, SCHEMA)
    if parts:
        df = df.repartition(parts)
    bad = c.damage(df)
    return {r.conv_id: tuple(r[x] for x in NAMES) for r in c.repaired(bad, c.solved(bad, block), df).collect()}


@pytest.mark.parametrize("block", [1 << 16, 40, 1])
def test_equals_the_plain_search(spark, block):
    rows = conversations(120, 14, 5) + [(900, t, random.choice(["user", "assistant", "tool"]), random.choice(["Same.", f"t {t % 50}", f"{t}!"])) for t in range(700)]
    rows += [(901, 3, "user", "Again and again.")] * 1300 + [(901, None, "assistant", "Yes.")] * 3
    want = {k: plain(v) for k, v in damaged(rows).items()}
    found = got(spark, rows, block)
    assert found.keys() == want.keys()
    assert {k: (found[k], want[k]) for k in want if found[k] != want[k]} == {}
    assert {"D", "K", "R"} == {x for w in want.values() for x in w[6]}  # to delete a row or two is always cheaper than to insert one


def test_order_of_rows_does_not_matter(spark):
    rows = conversations(40, 30, 6)
    assert got(spark, rows, 8, 7) == got(spark, rows[::-1], 1 << 16, 2)


def test_audit_is_least_of_all_cheapest():
    """All edit strings of tiny conversations, by brute force."""
    letters = {"D": 2, "K": 0, "R": 1}

    def every(codes, i, state, n_insert):
        if i == len(codes):
            yield from [("", 0)] if c.END[state] else []
        if n_insert < 2:
            for audit, cost in every(codes, i, c.NEXT[state][c.ADDED[state]], n_insert + 1):
                yield "I" + audit, cost + 5
        if i < len(codes):
            kind, fault = codes[i] % 4, codes[i] // 4
            for letter, price in letters.items():
                if letter != "D" and fault == c.MUST_GO:
                    continue
                to = state if letter == "D" else c.NEXT[state][kind if letter == "K" else c.ADDED[state]]
                if to is not None:
                    for audit, cost in every(codes, i + 1, to, 0):
                        yield letter + audit, cost + price + (5 if fault == c.CUT and letter != "D" else 0)

    random.seed(7)
    for _ in range(150):
        codes = [random.randrange(12) for _ in range(random.randrange(1, 5))]
        best = min((cost, audit) for audit, cost in every(codes, 0, 0, 0))
        [(cost, ways)] = c.solve([np.array(codes, np.uint8)], c.START[None], c.FINISH[None], [True])
        assert (cost, ways[0][0]) == best


def test_op12(spark, tmp_path):
    rows = conversations(30, 10, 8) + [(77, 0, None, None), (78, None, None, None)]
    rows += [(i, 0, "user", "Gone.") for i in range(1000, 1100)]  # some are damaged to nothing
    spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as audit", "'y' as copies", "'z' as place", "'w' as digest").write.parquet(f"{tmp_path}/conversations.parquet")
    want = {k: plain(v) for k, v in damaged(rows).items()}
    assert (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) in want.values()
    assert {r.conv_id: tuple(r[x] for x in NAMES) for r in c.op12_conversation_repair(spark, str(tmp_path)).collect()} == want
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert c.op12_conversation_repair(spark, f"{tmp_path}/none").count() == 0
