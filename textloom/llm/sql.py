"""SQL for the registered queries that DuckDB can express, as the definitions read: no filters, blocks or anchors. doc_id is taken to be
there and to be unique, as it is in the tables.

Statements are built from the operators' own parameters (templates, phrases, lengths), so that both speak of the same values."""

from __future__ import annotations

import math

from textloom.llm import licenses, simhash, suffixes

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def repeated_passages_sql(length: int = suffixes.LENGTH, block: int = 256) -> str:
    """op2: every string of ``length`` bytes, as hexadecimal digits, with the smallest document that has it. Repeats are counted in the
    first document of each text: they start where a string does not go on from the one before it at all of its places. Texts are cut
    into overlapping parts first, as a place in a long string is slow to reach."""
    return f"""
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, doc_id = min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS original FROM documents
), parts AS (
  SELECT doc_id, original, part, length(h) // 2 AS n, substr(h, 2 * part + 1, {2 * (block + length)}) AS h, CASE WHEN part > 0 THEN substr(h, 2 * part - 1, 2) END AS b
  FROM (SELECT *, unnest(range(0, length(h) // 2 - {length - 1}, {block})) AS part FROM d)
), p AS (
  SELECT doc_id, original, part + i AS i, substr(h, 2 * i + 1, {2 * length}) AS s, CASE WHEN i > 0 THEN substr(h, 2 * i - 1, 2) ELSE b END AS b,
    CASE WHEN n > part + i + {length} THEN substr(h, 2 * i + {2 * length + 1}, 2) END AS f
  FROM (SELECT *, unnest(range(0, least({block}, n - part - {length - 1}))) AS i FROM parts)
), g AS (
  SELECT s, min(doc_id) AS owner, min(doc_id) FILTER (original) < max(doc_id) FILTER (original) AS shared,
    count(b) FILTER (original) < count(*) FILTER (original) OR min(b) FILTER (original) < max(b) FILTER (original) AS lefts,
    count(f) FILTER (original) < count(*) FILTER (original) OR min(f) FILTER (original) < max(f) FILTER (original) AS rights
  FROM p GROUP BY s HAVING min(doc_id) < max(doc_id)
), m AS (
  SELECT p.doc_id, p.original, p.i, g.owner, g.shared, g.lefts, g.rights FROM p JOIN g USING (s)
), starts AS (
  SELECT doc_id, i, lag(i) OVER w AS last, lag(rights) OVER w AS parted, lefts FROM m WHERE original AND shared WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), repeats AS (
  SELECT doc_id, count(*) AS n FROM starts WHERE last IS NULL OR last < i - 1 OR parted OR lefts GROUP BY doc_id
), hits AS (
  SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {length}, true) AS opens FROM m WHERE owner < doc_id
), numbered AS (
  SELECT doc_id, i, sum(opens::int) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM hits
), spans AS (
  SELECT doc_id, min(i) AS a, max(i) + {length} AS z FROM numbered GROUP BY doc_id, span
), pieces AS (
  SELECT s.doc_id, a, z, substr(h, 2 * coalesce(lag(z) OVER w, 0) + 1, 2 * (a - coalesce(lag(z) OVER w, 0))) AS piece, h
  FROM spans s JOIN d USING (doc_id) WINDOW w AS (PARTITION BY s.doc_id ORDER BY a)
), cut AS (
  SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans, string_agg(piece, '' ORDER BY a) || substr(any_value(h), 2 * max(z) + 1) AS kept
  FROM pieces GROUP BY doc_id
)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept, h))) AS kept_sha256,
  CASE WHEN original THEN coalesce(n, 0) ELSE (length(h) >= {2 * length})::int END::BIGINT AS n_repeats
FROM d LEFT JOIN cut USING (doc_id) LEFT JOIN repeats USING (doc_id)
"""


def simhash_sql(words: int = simhash.SHINGLE, distance: int = simhash.DISTANCE, seed: int = simhash.SEED) -> str:
    """op7: XXH64 in 128-bit integers (constants of its specification), bits by majority, components by reachability."""
    p1, p2, p3, p4, p5 = (f"{x}::UHUGEINT" for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
    mask = f"{2**64 - 1}::UHUGEINT"
    low = lambda x: f"(({x}) & {mask})"
    rot = lambda x, r: f"(((({x}) << {r}) | (({x}) >> {64 - r})) & {mask})"
    mixed = lambda acc, w: low(f"{rot(low(f'{acc} + ({w} * {p2}) & {mask}'), 31)} * {p1}")
    bare = lambda w: low(f"{rot(low(f'{w} * {p2}'), 31)} * {p1}")
    backwards = lambda x, at, n: "'0x' || " + " || ".join(f"substr({x}, {at} + {2 * k}, 2)" for k in reversed(range(n)))
    number = lambda x, at, n: f"({backwards(x, at, n)})::UBIGINT::UHUGEINT"
    start = {1: (seed + 11400714785074694791 + 14029467366897019727) % 2**64, 2: (seed + 14029467366897019727) % 2**64, 3: seed, 4: (seed - 11400714785074694791) % 2**64}
    lane = lambda k: (
        f"list_reduce(list_transform(range(0, n // 32), lambda j: {number('x', f'(64 * j + {16 * (k - 1) + 1})', 8)}), lambda a, w: {mixed('a', 'w')}, {start[k]}::UHUGEINT) AS v{k}"
    )
    eight = low(f"{rot(f'xor(a, {bare("w")})', 27)} * {p1} + {p4}")
    one = low(f"{rot(f'xor(a, {low(f"w * {p5}")})', 11)} * {p1}")
    four = low(f"{rot(f'xor(h, {low(f"{number('x', '(2 * n8 + 1)', 4)} * {p1}")})', 23)} * {p2} + {p3}")
    merge = lambda acc, v: low(f"{low(f'xor({acc}, {bare(v)}) * {p1}')} + {p4}")
    bits = ", ".join(f"sum((h >> {k}) & 1) AS b{k}" for k in range(64))
    majority = " + ".join(f"CASE WHEN 2 * b{k} > n THEN {1 << k}::UHUGEINT ELSE 0::UHUGEINT END" for k in range(64))
    last = " || ' ' || ".join(["word", *(f"lead(word, {k}) OVER w" for k in range(1, words))])
    return f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS row, doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS t FROM documents
), l AS (
  SELECT row, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda v: v <> '') AS words FROM d
), s AS (
  SELECT row, {last} AS s FROM (SELECT row, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM l WHERE len(words) >= {words}) WINDOW w AS (PARTITION BY row ORDER BY i)
  UNION ALL SELECT row, array_to_string(words, ' ') FROM l WHERE len(words) BETWEEN 1 AND {words - 1}
), u AS (
  SELECT DISTINCT s, hex(encode(s)) AS x, strlen(s) AS n FROM s WHERE s IS NOT NULL
), v AS (
  SELECT *, n // 8 * 8 AS n8, n // 4 * 4 AS n4, {", ".join(lane(k) for k in (1, 2, 3, 4))} FROM u
), m0 AS (
  SELECT *, {low(f"{rot('v1', 1)} + {rot('v2', 7)} + {rot('v3', 12)} + {rot('v4', 18)}")} AS m FROM v
), m1 AS (SELECT * REPLACE ({merge("m", "v1")} AS m) FROM m0
), m2 AS (SELECT * REPLACE ({merge("m", "v2")} AS m) FROM m1
), m3 AS (SELECT * REPLACE ({merge("m", "v3")} AS m) FROM m2
), m4 AS (SELECT * REPLACE ({merge("m", "v4")} AS m) FROM m3
), h0 AS (
  SELECT s, x, n, n8, n4, {low(f"CASE WHEN n >= 32 THEN m ELSE {(seed + 2870177450012600261) % 2**64}::UHUGEINT END + n::UHUGEINT")} AS h FROM m4
), h1 AS (
  SELECT * REPLACE (list_reduce(list_transform(range(n // 32 * 4, n // 8), lambda j: {number("x", "(16 * j + 1)", 8)}), lambda a, w: {eight}, h) AS h) FROM h0
), h2 AS (
  SELECT * REPLACE (CASE WHEN n4 > n8 THEN {four} ELSE h END AS h) FROM h1
), h3 AS (
  SELECT * REPLACE (list_reduce(list_transform(range(n4, n), lambda j: {number("x", "(2 * j + 1)", 1)}), lambda a, w: {one}, h) AS h) FROM h2
), h4 AS (SELECT s, {low(f"xor(h, h >> 33) * {p2}")} AS h FROM h3
), h5 AS (SELECT s, {low(f"xor(h, h >> 29) * {p3}")} AS h FROM h4
), h6 AS (SELECT s, xor(h, h >> 32)::UBIGINT AS h FROM h5
), c AS (
  SELECT row, count(*) AS n, {bits} FROM s JOIN h6 USING (s) GROUP BY row
), f AS (
  SELECT d.doc_id, coalesce(({majority}), 0::UHUGEINT)::UBIGINT AS fp FROM d LEFT JOIN c USING (row)
), nodes AS (
  SELECT fp, min(doc_id) AS first FROM f GROUP BY fp
), links AS (
  SELECT a.fp AS fp, b.fp AS other FROM nodes a JOIN nodes b ON a.fp <> b.fp AND bit_count(xor(a.fp, b.fp)) <= {distance}
), reach AS (
  SELECT fp, fp AS other FROM nodes UNION SELECT reach.fp, links.other FROM reach JOIN links ON reach.other = links.fp
), component AS (
  SELECT reach.fp, min(nodes.first) AS component_id FROM reach JOIN nodes ON reach.other = nodes.fp GROUP BY reach.fp
)
SELECT doc_id, lower(lpad(hex(fp), 16, '0')) AS fingerprint, component_id FROM f JOIN component USING (fp)
"""


def license_scan_sql(templates: list[tuple[str, str]] = licenses.TEMPLATES, threshold: float = licenses.THRESHOLD) -> str:
    """op10: every run of lines against every template, word by word."""
    rows = []
    for number, (label, sentence) in enumerate(templates):
        tokens = licenses._tokens(sentence)
        need = math.ceil(threshold * len(tokens) - 1e-9)
        inner = max(0, math.ceil(licenses._length(sentence) / threshold) - 2)
        rows.append(f"({number}, {_text(label)}, {_text(licenses.FAMILIES.get(label, label))}, {len(tokens)}, {need}, {inner}, [{', '.join(map(_text, tokens))}])")
    split = lambda x: f"list_filter(string_split_regex({x}, '{licenses.GAP}'), lambda v: v <> '')"
    follows = lambda phrase: " AND ".join(f"w{k} = {_text(p)}" for k, p in enumerate(phrase.split()))
    most = max(len(p.split()) for p in licenses.PHRASES.values())
    leads = ", ".join(f"lead(word, {k}) OVER w AS w{k}" for k in range(1, most))
    places = " UNION ALL ".join(f"SELECT row, i, {_text(label)} AS label FROM following WHERE {follows(phrase)}" for label, phrase in licenses.PHRASES.items())
    return f"""
WITH t(template, label, family, size, need, most_inner, tokens) AS (
  VALUES {", ".join(rows)}
), tw AS (SELECT template, unnest(tokens) AS word FROM t
), d AS (
  SELECT row_number() OVER () AS row, doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS text FROM documents
), w AS (SELECT row, {split("text")} AS words FROM d
), following AS (
  SELECT row, i, word AS w0, {leads} FROM (SELECT row, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS i FROM w) WINDOW w AS (PARTITION BY row ORDER BY i)
), places AS ({places}
), base AS (SELECT row, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(label) AS labels FROM places GROUP BY row
), pieces AS (
  SELECT row, i, {split("line")} AS words FROM (SELECT row, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM (SELECT row, string_split(text, chr(10)) AS lines FROM d))
), l AS (
  SELECT row, row_number() OVER o AS place, len(words) AS n, sum(len(words)) OVER o AS upto, words FROM pieces WHERE len(words) > 0 WINDOW o AS (PARTITION BY row ORDER BY i)
), lw AS (
  SELECT DISTINCT row, place, n, upto, template, word FROM (SELECT row, place, n, upto, unnest(words) AS word FROM l) JOIN tw USING (word)
), ends AS (SELECT DISTINCT row, place, n, upto, template FROM lw
), runs AS (
  SELECT a.row, a.template, a.place AS first, b.place AS last FROM ends a JOIN ends b ON a.row = b.row AND a.template = b.template AND a.place <= b.place
  JOIN t ON t.template = a.template WHERE a.place = b.place OR b.upto - b.n - a.upto <= most_inner
), met AS (
  SELECT r.row, r.template, first, last, count(DISTINCT word) AS shared, count(DISTINCT word) FILTER (lw.place < last) AS but_last, count(DISTINCT word) FILTER (lw.place > first) AS but_first
  FROM runs r JOIN lw ON lw.row = r.row AND lw.template = r.template AND lw.place BETWEEN first AND last GROUP BY r.row, r.template, first, last
), blocks AS (
  SELECT row, label, family, shared::DOUBLE / size AS containment, unnest(range(first, last + 1)) AS line FROM met JOIN t USING (template) WHERE shared >= need AND but_last < shared AND but_first < shared
), best AS (SELECT *, max(containment) OVER (PARTITION BY row, line, family) AS most FROM blocks
), held AS (SELECT row, list(label) AS labels, max(containment) AS most FROM best WHERE containment = most GROUP BY row
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  array_to_string(list_sort(list_distinct(coalesce(base.labels, []))), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(held.labels, [])))), ',') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(most, 0.0::DOUBLE) END AS score
FROM d JOIN w USING (row) LEFT JOIN base USING (row) LEFT JOIN held USING (row)
"""
