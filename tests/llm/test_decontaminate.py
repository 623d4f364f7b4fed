"""Decontamination against a plain version of its definition, and the cases that its docstring defines."""

import math
import random
import re

from tests.llm.helpers import EDGES, hostile, table
from textloom.llm import decontaminate
from textloom.llm.decontaminate import CONSISTENT, FEW, SHIPPED_BYTES, THRESHOLD, UNITS, WINDOW


def words_of(text):
    """(word, symbol, is placeholder, opens a sentence) of each word of an ASCII text."""
    out, last = [], 0
    for m in re.finditer("[0-9A-Za-z]+", text):
        w = m[0]
        opens = not out or bool(re.search(r"[.!?:;\n]", text[last : m.start()]))
        if re.search("[0-9]", w):
            kind = "#"
        elif len(w) > 1 and w[0].isupper() and w[1].islower() and not opens:
            kind = "NAME"
        elif out and out[-1][1] == "#" and not opens and w.lower() in UNITS:
            kind = "UNIT"
        else:
            kind = w.lower()
        out.append((w.lower(), kind, kind in ("#", "NAME", "UNIT"), opens))
        last = m.end()
    return out


def windows(words, size, literal):
    for p in range(len(words) - size + 1):
        part = words[p : p + size]
        own = sum(not w[2] for w in part)
        behind = p + size == len(words) or words[p + size][3]
        if own >= 2 or literal and (size == WINDOW or part[0][3] and behind):
            yield p, (size, *(w[0 if literal else 1] for w in part)), [("" if literal or not w[2] else w[0]) for w in part]


def plain(docs, items):
    found = {}
    for item, text in items:
        words = words_of(text or "")
        if not words:
            continue
        size = min(WINDOW, len(words))
        for literal in (False, True):
            mine = {}
            for p, h, v in windows(words, size, literal):
                mine.setdefault(h, (p, v))
            if literal and len({h for _, h, _ in windows(words, size, False)}) >= FEW:
                continue
            need = math.ceil(THRESHOLD * len(mine) - 1e-9)
            for doc, t in docs:
                hits = [(p - mine[h][0], h, p, v) for p, h, v in windows(words_of(t or ""), size, literal) if h in mine]
                best = None
                for a in {x[0] for x in hits}:
                    near = {}
                    for o, h, p, v in sorted((x for x in hits if abs(x[0] - a) <= len(words)), key=lambda x: (abs(x[0] - a), x[0], x[2])):
                        near.setdefault(h, v)
                    pairs = {(x, y) for h, v in near.items() for x, y in zip(mine[h][1], v) if x}
                    became = {x: {y for z, y in pairs if z == x} for x, _ in pairs}
                    if mine and len(near) >= need and sum(len(y) == 1 for y in became.values()) >= CONSISTENT * len(became):
                        best = max(best or 0, len(near))
                if best:
                    key = (doc, item)
                    old = found.get(key)
                    if old is None or old[0] == literal and best / len(mine) > old[1]:
                        found[key] = (literal, best / len(mine))
    return {k: round(v[1], 9) for k, v in found.items()}


def both_ways(spark, docs, items):
    b = spark.createDataFrame(items, "item_id long, text string")
    out = []
    for shipped in (SHIPPED_BYTES, 0):
        got = decontaminate.contaminated(hostile(table(spark, docs)), b, shipped_bytes=shipped).collect()
        out.append({(r.doc_id, r.item_id): round(r.containment, 9) for r in got})
        assert len(out[-1]) == len(got)
    assert out[0] == out[1]
    return out[0]


def test_equals_the_plain_version(spark):
    random.seed(12)
    names, nouns = ["Anna", "Tom", "Maria", "Peter", "Li"], "apples pears boxes birds hours lines roads cars".split()
    shapes = ["{n} has {x} {o} and gives {y} kg to {m}, how many {o} are left for {n} now?", "If a {o} costs {x} euros then what do {y} of them cost?", "{x} km", "the {o} of {n}", "{x}", "{n} {m} {n} {m} {n} {m}", "why do {o} sing when {o} sing and {o} sing to {n}"]

    def made(shape, **held):
        v = {"n": random.choice(names), "m": random.choice(names), "o": random.choice(nouns[:2]), "x": random.randrange(30), "y": random.randrange(30)} | held
        return shape.format(**v)

    items = [(i, made(random.choice(shapes))) for i in range(25)] + [(3, "another text of the same id with words of its own"), (90, None), (91, ""), (92, "...")]
    filler = lambda: " ".join(random.choice(nouns) for _ in range(random.randrange(6)))
    docs = list(EDGES)
    for i in range(120):
        parts = []
        for _ in range(random.randrange(1, 6)):
            t = random.choice(items)[1] if random.random() < 0.4 else made(random.choice(shapes))
            w = (t or "").split()
            if w and random.random() < 0.3:
                w.insert(random.randrange(len(w)), random.choice(nouns))
            parts += [" ".join(w), filler()]
        docs.append((100 + i, random.choice([" ", "\n", ". "]).join(parts)))
    got = both_ways(spark, docs, items)
    assert got == plain(docs, items) and len(got) > 100


def test_a_copy_behind_sentences_of_its_templates_is_found(spark):
    item = "Anna has 5 apples and gives 2 kg to Tom, how many apples are left for Anna now?"
    other = ["Maria has 7 apples and gives 3 kg to Li, how many apples are left for Peter now?", "Tom has 9 apples and gives 8 kg to Anna, how many apples are left for Maria now?"]
    assert both_ways(spark, [(1, " ".join([*other, item])), (2, item), (3, "nothing")], [(7, item)]) == {(1, 7): 1.0, (2, 7): 1.0}


def test_short_items_ask_for_their_words(spark):
    docs = [(1, "I have 7 apples and 12 mm of wire"), (2, "I have 42 apples"), (3, "The answer:\n42\nnext"), (4, "it is 5 kg heavy"), (5, "5 kg"), (6, "a red fox ran")]
    assert both_ways(spark, docs, [(1, "42"), (2, "5 kg"), (3, "red fox")]) == {(3, 1): 1.0, (5, 2): 1.0, (6, 3): 1.0}


def test_missing_and_repeated_ids(spark):
    item, other = "why do birds sing so well in the early morning hours", "another question with words that stand in no other item"
    docs = [(None, item), (None, "x"), (4, "y"), (4, f"so {item}"), (4, other)]
    assert both_ways(spark, docs, [(1, item), (1, other), (None, "x y z a b c d")]) == {(None, 1): 1.0, (4, 1): 1.0}
    assert both_ways(spark, [], [(1, item)]) == {} and both_ways(spark, docs, []) == {}
    rows = decontaminate.found_in_texts(table(spark, docs), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert len({(r.doc_id, r.text_hash) for r in rows}) == 2  # of the rows with id 4 only one holds the item


def test_long_texts_are_whole(spark):
    item = "why do birds sing so well in the early morning hours"
    assert both_ways(spark, [(1, "word " * 300_000 + item), (2, (item[:-6] + "\n") * 5000)], [(1, item)]) == {(1, 1): 1.0, (2, 1): round(6 / 7, 9)}
