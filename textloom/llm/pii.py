"""Personal data by bootstrapped contextual extraction, in DataFrame operations alone.

Seeds are the matches of fixed expressions (e-mail and IP addresses, payment cards, telephone numbers) and of long hexadecimal
secrets, all found in whole texts. The two words to the left of an identifier-like token, and the two to its right, identifiers among
them, are its lexical patterns; the start and the end of a text are patterns too. All these tokens and their patterns form a graph,
aggregated to (token, pattern, count) edges, and a loop goes round it: known instances of a kind give patterns their score (the share of
the different tokens that a pattern extracts that are known, smoothed); patterns that are confident and have enough known instances
give other tokens theirs (1 less the product of their patterns' doubts); tokens that reach it, and that stand in such patterns
often enough, become known instances, which induce patterns in the next round. Scores only grow with what is known, so the loop ends when a
round finds no new instance. Confident patterns then mark, wherever they stand, tokens that no expression knows.

Every expression is anchored where the last match ended (\\G), takes its text in one pass and repeats possessively, so a text of
any length costs time in proportion and no deep recursion.

Defined results: a null text is empty and has no spans. Ties between kinds for a token go to the kind with the higher score, then
the first by name. Repeated rows have the same spans; rows that share a doc_id, or have none, have those of their own texts. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import discard, id_and_text, materialise, read_table

# Base expressions, as the contract has them but with possessive repeats, which match the same. A leftmost e-mail address starts
# where a run of its characters starts or where the last match ended, and a leftmost address of numbers where digits start.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
#: The last digit ends it; one that has a single character after the first digit has two digits and fails anyway.
PHONE = r"\+[0-9](?:[\x20().-]*+[0-9])++"
BASE = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
#: A seed kind of the method: hexadecimal secrets of 32 characters and more.
SECRET = r"(?<![0-9A-Za-z])[0-9a-f]{32,}+(?![0-9A-Za-z])"
EXPRESSIONS = BASE | {"secret": SECRET}
#: An identifier-like token has a digit or an at sign; quotes and brackets around it and punctuation behind it are not part of it.
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
#: What patterns extract: telephone numbers and cards in several words, else tokens.
INSTANCE = rf"\+[0-9](?:[\x20().-]*+[0-9])++|(?<![0-9])[0-9]{{4}}(?:[\x20-][0-9]{{4}}){{3}}(?![0-9])|{TOKEN}"
LEAD = "^[\"'(\\[{<]+"
TRAIL = "[\"')\\]}>.,;:!?*#$%&|]+$"
#: Shortest token that a pattern may mark, in code points.
LEAST_LENGTH = 6
#: The least score of a pattern and of an instance, a pattern's least number of different known instances and the smoothing of its score.
CONFIDENT, LEAST_SEEDS, SMOOTH = 0.6, 5, 2.0
#: Share of a token's places that confident patterns must have, on one side, for it to become an instance.
LEAST_SHARE = 0.25


def _once(df: DataFrame, keep: list[str], **made: Column) -> DataFrame:
    """Columns that are made once a row: what reads them, if only element by element, does not make them again."""
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(k) for k, c in made.items()]))))


def _places(gaps: Column, hits: Column, width: int = 512) -> Column:
    """Where each hit starts when gaps (their lengths) and hits alternate: running sums, in slices so that many hits cost time in
    proportion. Both must be columns that stand, not what makes them."""
    none = F.expr("cast(array() as array<int>)")
    sizes = lambda i: F.zip_with(F.slice(gaps, i * width + 1, F.lit(width)), F.slice(hits, i * width + 1, F.lit(width)), lambda g, h: F.struct(g.alias("g"), F.length(h).alias("h")))

    def within(part):
        return F.aggregate(
            part,
            F.struct(F.lit(0).alias("at"), none.alias("out")),
            lambda acc, x: F.struct((acc["at"] + x["g"] + x["h"]).alias("at"), F.concat(acc["out"], F.array(acc["at"] + x["g"])).alias("out")),
        )

    parts = F.transform(F.sequence(F.lit(0), F.floor(F.size(hits) / width).cast("int")), lambda i: within(sizes(i)))
    summed = F.aggregate(
        parts,
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<array<int>>)").alias("out")),
        lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["out"], F.array(F.transform(x["out"], lambda y: y + acc["at"]))).alias("out")),
    )
    return F.flatten(summed["out"])


def _matches(text: Column, expression: str, needs: Column) -> tuple[Column, Column]:
    """Leftmost matches that do not overlap, and the lengths of the gaps before them, in code points; empty unless ``needs`` holds."""
    both = F.lit(rf"\G([\s\S]*?)({expression})")
    hits = F.when(needs, F.regexp_extract_all(text, both, F.lit(2))).otherwise(F.expr("cast(array() as array<string>)"))
    gaps = F.when(needs, F.transform(F.regexp_extract_all(text, both, F.lit(1)), F.length)).otherwise(F.expr("cast(array() as array<int>)"))
    return hits, gaps


def _part_ok(part: Column) -> Column:
    bare = F.regexp_replace(part, "^0+", "")
    return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    at = F.sequence(F.lit(1), F.length(digits))

    def add(acc, i):
        d = F.ascii(F.substring(F.reverse(digits), i, F.lit(1))) - 48
        twice = d * 2
        return acc + F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(at, F.lit(0), add) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), _part_ok)
    digits = F.regexp_replace(m, "[^0-9]", "")
    n = F.length(digits)
    if kind == "card":
        return F.when(n.between(16, 19), _luhn(digits)).otherwise(False)
    return n.between(8, 15) if kind == "phone" else F.lit(True)


def _kept(kind: str) -> Column:
    return F.filter(kind, lambda x: _valid(kind, x["m"]))


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, row (a hash of the text) and for each base kind and for secret an array of (s, e, m) under its name."""
    d = id_and_text(docs)
    text = F.col("text")
    # One look at each text decides whether any expression has to run.
    any_digit = F.regexp_like(text, F.lit("[0-9]"))
    d = d.select("doc_id", "text", any_digit.alias("digit"))
    needs = {"email": text.contains("@"), "ip": F.col("digit"), "card": F.col("digit"), "phone": F.col("digit") & text.contains("+")}
    needs["secret"] = F.regexp_like(text, F.lit("[0-9a-f]{32}"))
    d = d.select("doc_id", F.xxhash64("text").alias("row"), "text", *[v.alias(f"needs_{k}") for k, v in needs.items()])
    # Hits first: most texts have none of a kind, and need no gaps then.
    hits = {k: _matches(text, e, F.col(f"needs_{k}"))[0] for k, e in EXPRESSIONS.items()}
    d = _once(d, ["doc_id", "row", "text"], **hits)
    gaps = {f"gaps_{k}": _matches(text, e, F.size(k) > 0)[1] for k, e in EXPRESSIONS.items()}
    d = _once(d, ["doc_id", "row", *EXPRESSIONS], **gaps)
    d = _once(d, ["doc_id", "row", *EXPRESSIONS], **{f"at_{k}": _places(F.col(f"gaps_{k}"), F.col(k)) for k in EXPRESSIONS})
    spans = lambda k: F.zip_with(f"at_{k}", k, lambda s, h: F.struct(s.alias("s"), (s + F.length(h)).alias("e"), h.alias("m")))
    raw = _once(d, ["doc_id", "row"], **{k: spans(k) for k in EXPRESSIONS})
    return raw.select("doc_id", "row", *[_kept(k).alias(k) for k in BASE], "secret")


def _last_words(text: Column) -> Column:
    """The last two words of a text, or as many as it has, in lower case. Read backwards, so that a text of any length takes one look."""
    found = F.reverse(F.regexp_extract(F.reverse(text), r"^[\x20\x09-\x0D]*+([^\x20\x09-\x0D]++(?:[\x20\x09-\x0D]++[^\x20\x09-\x0D]++)?)", 1))
    return F.lower(F.regexp_replace(found, r"[\x20\x09-\x0D]+", " "))


def _first_words(text: Column) -> Column:
    """The first two words of a text, or as many as it has, in lower case."""
    found = F.regexp_extract(text, r"^[\x20\x09-\x0D]*+([^\x20\x09-\x0D]++(?:[\x20\x09-\x0D]++[^\x20\x09-\x0D]++)?)", 1)
    return F.lower(F.regexp_replace(found, r"[\x20\x09-\x0D]+", " "))


def candidates(docs: DataFrame) -> DataFrame:
    """Identifier-like tokens with their contexts: doc_id, row (of the text), s, e, token, left and right (the two words on that side,
    lower case; fewer where the text has no more, and none at its start or end)."""
    d = id_and_text(docs)
    text = F.col("text")
    both = F.lit(rf"\G([\s\S]*?)({INSTANCE})")
    needs = F.regexp_like(text, F.lit("[0-9@]"))
    d = _once(d.where(needs), ["doc_id", "text"], gaps=F.regexp_extract_all(text, both, F.lit(1)), hits=F.regexp_extract_all(text, both, F.lit(2))).where(F.size("hits") > 0)
    d = _once(d, ["doc_id", "text", "gaps", "hits"], row=F.xxhash64("text"), sizes=F.transform("gaps", F.length))
    d = _once(d, ["doc_id", "text", "gaps", "hits", "row"], ends=_places(F.col("sizes"), F.col("hits")))
    rest = F.substring(F.col("text"), F.element_at("ends", -1) + F.length(F.element_at("hits", -1)) + 1, F.length("text"))
    d = _once(d, ["doc_id", "row", "hits", "ends"], gaps=F.concat("gaps", F.array(rest)))
    d = _once(d, ["doc_id", "row", "hits", "ends", "gaps"], near=F.transform("gaps", _last_words), next=F.transform("gaps", _first_words))

    def at(values, i):
        return F.coalesce(F.get(F.col(values), i).cast("string"), F.lit(""))

    # A gap of fewer than two words goes on in the tokens and the gap on its other side.
    left = lambda i: F.when(at("near", i).contains(" "), at("near", i)).otherwise(_last_words(F.concat(at("hits", i - 2), at("near_", i - 1), at("hits", i - 1), at("gaps", i))))
    right = lambda i: F.when(at("next", i + 1).contains(" "), at("next", i + 1)).otherwise(_first_words(F.concat(at("gaps", i + 1), at("hits", i + 1), at("next_", i + 2), at("hits", i + 2))))
    # Of a gap beyond a token its words on that side are enough, with the blanks around them.
    edge = lambda g, w: F.when(w.contains(" "), F.concat(F.lit(" "), w, F.lit(" "))).otherwise(g)
    d = _once(d, d.columns, near_=F.zip_with("gaps", "near", edge), next_=F.zip_with("gaps", "next", edge))
    d = d.select("doc_id", "row", F.transform("hits", lambda hit, i: F.struct(at("ends", i).cast("int").alias("at"), hit.alias("hit"), left(i).alias("left"), right(i).alias("right"))).alias("x"))
    d = d.select("doc_id", "row", F.explode("x").alias("x")).select("doc_id", "row", "x.*")
    lead = F.length("hit") - F.length(F.regexp_replace("hit", LEAD, ""))
    bare = F.regexp_replace(F.regexp_replace("hit", LEAD, ""), TRAIL, "")
    d = d.select("doc_id", "row", (F.col("at") + lead).alias("s"), bare.alias("token"), "left", "right")
    return d.where(F.length("token") >= 1).select("doc_id", "row", "s", (F.col("s") + F.length("token")).alias("e"), "token", "left", "right")


def _seed(token: Column) -> Column:
    """The kind of a token that a base expression or the secret's matches as a whole; else null."""
    out = F.when(F.regexp_like(token, F.lit(f"^(?:{SECRET})$")), F.lit("secret"))
    for kind in BASE:
        out = out.when(F.regexp_like(token, F.lit(f"^(?:{BASE[kind]})$")) & _valid(kind, token), F.lit(kind))
    return out


def _patterns() -> Column:
    return F.array(F.concat(F.lit("< "), F.col("left")), F.concat(F.lit("> "), F.col("right")))


def scored_patterns(edges: DataFrame, confident: float, least_seeds: int) -> DataFrame:
    """pattern, kind, score of each pattern that is confident and has enough different known instances; the best kind, then the first.

    edges: token, pattern, n, kind (of known instances, else null)."""
    of_kind = edges.groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("tokens"))
    every = of_kind.groupBy("pattern").agg(F.sum("tokens").alias("total"), F.max(F.when(F.col("kind").isNotNull(), F.struct("tokens", F.expr("-ascii(kind)"), "kind"))).alias("best"))
    good = every.select("pattern", F.col("best.kind").alias("kind"), F.col("best.tokens").alias("seeds"), (F.col("best.tokens") / (F.col("total") + SMOOTH)).alias("score"))
    return good.where((F.col("score") >= confident) & (F.col("seeds") >= least_seeds)).select("pattern", "kind", "score")


def bootstrapped(edges: DataFrame, confident: float = CONFIDENT, least_seeds: int = LEAST_SEEDS) -> tuple[DataFrame, int]:
    """Patterns (pattern, kind, score) when no round finds new instances any more, and the number of rounds."""
    rounds = 0
    while True:
        rounds += 1
        good = materialise(scored_patterns(edges, confident, least_seeds), "pii-patterns")
        unknown = edges.where(F.col("kind").isNull() & (F.length("token") >= LEAST_LENGTH)).select("token", "pattern", "n")
        met = unknown.join(good.select("pattern", F.col("kind").alias("found"), "score"), "pattern")
        side = F.substring("pattern", 1, 1).alias("side")
        total = unknown.join(met.select("token").distinct(), "token", "left_semi").groupBy("token", side).agg(F.sum("n").alias("all"))
        won = met.groupBy("token", side, "found").agg(F.sum("n").alias("own"), F.sum(F.log(1 - F.col("score"))).alias("doubt"))
        share = F.max(F.col("own") / F.col("all")).alias("share")
        score = won.join(total, ["token", "side"]).groupBy("token", "found").agg((1 - F.exp(F.sum("doubt"))).alias("score"), share).where(F.col("share") >= LEAST_SHARE)
        new = score.groupBy("token").agg(F.max(F.struct("score", F.expr("-ascii(found)"), "found")).alias("best")).where(F.col("best.score") >= confident)
        new = materialise(new.select("token", F.col("best.found").alias("found")), "pii-instances")
        if new.isEmpty():
            discard(new)
            return good, rounds
        grown = edges.join(new, "token", "left").select("token", "pattern", "n", F.coalesce("kind", "found").alias("kind"))
        grown = materialise(grown, "pii-edges")
        discard(edges, good, new)
        edges = grown


def discovered(docs: DataFrame, confident: float = CONFIDENT, least_seeds: int = LEAST_SEEDS, hidden: float = 0.0) -> DataFrame:
    """Tokens that confident patterns mark and no expression matches: doc_id, row, kind, s, e.

    hidden: for a measurement, the share of tokens (by a hash) whose expressions are not looked at, so that patterns alone find them."""
    seed = _seed(F.col("token"))
    if hidden:
        seed = F.when(F.pmod(F.xxhash64("token"), F.lit(1000)) >= int(1000 * hidden), seed)
    found = materialise(candidates(docs).withColumn("kind", seed), "pii-candidates")
    edges = found.select("token", "kind", F.explode(_patterns()).alias("pattern")).groupBy("token", "pattern", "kind").agg(F.count(F.lit(1)).alias("n"))
    good, _ = bootstrapped(materialise(edges.select("token", "pattern", "n", "kind"), "pii-edges"), confident, least_seeds)
    marked = found.where(F.col("kind").isNull() & (F.length("token") >= LEAST_LENGTH)).select("doc_id", "row", "s", "e", F.explode(_patterns()).alias("pattern"))
    best = marked.join(good, "pattern").groupBy("doc_id", "row", "s", "e").agg(F.max(F.struct("score", F.expr("-ascii(kind)"), "kind")).alias("best"))
    return best.select("doc_id", "row", F.col("best.kind").alias("kind"), "s", "e")


def scan(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, the base kinds' spans (arrays of s, e, m) and ``extra``: an array of (kind, s, e) that the method adds: secrets
    and what patterns mark.

    A span of the method that touches a base span of the same document is left out, and a marked one that touches a secret."""
    base = base_spans(docs)
    extra = discovered(docs, **settings).groupBy(F.col("doc_id").alias("id"), "row").agg(F.array_sort(F.collect_set(F.struct("kind", "s", "e"))).alias("extra"))
    none = F.expr("cast(array() as array<struct<kind: string, s: int, e: int>>)")
    joined = base.join(extra, F.col("doc_id").eqNullSafe(F.col("id")) & (base["row"] == extra["row"]), "left").drop("id", "row").withColumn("extra", F.coalesce("extra", none))
    spans = lambda k: F.transform(k, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))
    joined = joined.withColumn("taken", F.concat(*[spans(k) for k in BASE])).withColumn("sealed", F.concat("taken", spans("secret")))
    clear = lambda found, of: F.filter(found, lambda x: ~F.exists(of, lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"])))
    secrets = F.transform(clear("secret", F.col("taken")), lambda x: F.struct(F.lit("secret").alias("kind"), x["s"].alias("s"), x["e"].alias("e")))
    return joined.select("doc_id", *BASE, F.array_sort(F.concat(secrets, clear("extra", F.col("sealed")))).alias("extra"))


def op1_pii(spark, sf_dir: str) -> DataFrame:
    """Counts of base spans, their digest, and all spans of every document."""
    found = scan(read_table(spark, sf_dir, "documents"))

    def said(kind):
        return F.transform(kind, lambda x: F.concat_ws(":", F.lit(kind), x["s"], x["e"]))

    order = {k: i for i, k in enumerate([*BASE, "secret"])}
    ranks = F.create_map(*[F.lit(v) for kv in order.items() for v in kv])

    def placed(kind):
        return F.transform(kind, lambda x: F.struct(F.lit(order[kind]).alias("r"), x["s"].alias("s"), x["e"].alias("e"), F.lit(kind).alias("kind")))

    every = F.concat(
        *[placed(k) for k in BASE],
        F.transform("extra", lambda x: F.struct(ranks[x["kind"]].alias("r"), x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))),
    )
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(F.array_join(F.concat(*[said(k) for k in BASE]), ","), 256).alias("base_sha256"),
        F.array_join(F.transform(F.array_sort(every), lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",").alias("spans"),
        F.size("extra").cast("long").alias("n_extra"),
        F.size(every).cast("long").alias("n_spans"),
    )
