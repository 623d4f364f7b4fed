"""Toxicity classifier with a counterfactual penalty.

Logistic regression over the words, and stems of words, that labelled documents mark. For every labelled text with an identity term (the name of a
group of people) there is a counterfactual in which another identity term stands in its place; more pairs put identity terms into
texts that have none. The squared change of the logit over each pair is part of the loss, so that the mere mention of a group
moves no score. The model is fitted on the driver by Newton steps over a bounded sample of labelled rows and is small: a weight
for each selected word, of which there are at most MAX_WORDS. Words are selected by a distributed count over the sample.

Defined results: a null or empty text has no words and scores as the intercept says. Repeated rows score alike. A score of exactly
0.5 counts as toxic. Without any labelled row of both classes every score is 0. Other columns are not read for a score.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import crc_mod_col, discard, id_and_text, materialise, read_table, text_bytes

#: Labelled rows that a model is fitted on at most, the first by a hash of their ids.
SAMPLE_ROWS = 12_000
#: A word is selected if its document frequencies in the two classes differ by so many standard errors, in so many documents.
LEAST_Z, LEAST_DOCS, MAX_WORDS = 4.0, 5, 800
RIDGE, PENALTY = 0.3, 20.0
STEM = 5
#: Terms that name groups of people, by language.  A parameter of fit().
IDENTITY_TERMS = (
    "women men woman man muslim muslims christian christians jewish jews hindu buddhist atheist black white asian african latino "
    "gay lesbian bisexual transgender straight immigrant immigrants refugee refugees disabled blind deaf elderly young "
    "frauen juden schwule behinderte ausländer femmes juifs musulmans immigrés mujeres judíos musulmanes inmigrantes"
).split()

#: Bytes that are part of words stay (A-Z in lower case), all others become spaces.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


_IDENTITY = frozenset(t.encode() for t in IDENTITY_TERMS)


def words(text: bytes) -> set[bytes]:
    """The words of a text and the stems (first STEM bytes, marked by ^) of all that are no identity terms."""
    own = set(text.translate(_WORDS).split())
    return own | {b"^" + w[:STEM] for w in own if w not in _IDENTITY}


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, folds: int, held_out: int, rows: int) -> DataFrame:
    """doc_id, text and y of at most ``rows`` labelled documents outside the held-out fold."""
    y = labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("y")).dropDuplicates(["doc_id"])
    y = y.where(crc_mod_col(F.col("doc_id"), folds) != held_out).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return id_and_text(docs).join(F.broadcast(y), "doc_id")  # at most ``rows`` pairs of numbers


def word_sample(docs: DataFrame, labels: DataFrame, rows: int, folds: int, held_out: int) -> DataFrame:
    """doc_id, y and words (the different words and stems of the text, sorted, each byte a character) of the sample."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            found = [[w.decode("latin-1") for w in sorted(words(t))] for t in text_bytes(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(found, pa.list_(pa.string()))], ["doc_id", "y", "words"])

    return labelled_sample(docs, labels, "toxic", folds, held_out, rows).mapInArrow(run, "doc_id long, y int, words array<string>")


def _latin(terms: list[str]) -> list[str]:
    """Terms as the words of a sample stand in it: each byte a character."""
    return list(dict.fromkeys(t.encode().decode("latin-1") for t in terms))


def select_words(sample: DataFrame) -> list[str]:
    """Words whose document frequency tells the classes apart, the clearest first, at most MAX_WORDS."""
    n, n1 = sample.agg(F.count(F.lit(1)), F.sum("y")).first()
    if not n or not n1 or n1 == n:
        return []
    counts = sample.select("y", F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("k")).where(F.col("n") >= LEAST_DOCS)
    p = F.col("n") / F.lit(n)
    z = F.abs(F.col("k") / F.lit(n1) - (F.col("n") - F.col("k")) / F.lit(n - n1)) / F.greatest(F.lit(1e-9), F.sqrt(p * (1 - p) * F.lit(1 / (n - n1) + 1 / n1)))
    return [r["word"] for r in counts.withColumn("z", z).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "word").limit(MAX_WORDS).collect()]


def fit(rows: list[list[str]], y: np.ndarray, chosen: list[str], identity: list[str] = IDENTITY_TERMS, penalty: float = PENALTY) -> dict[bytes | None, float]:
    """Weights by word; None has the intercept. Newton steps on log loss, ridge and the counterfactual penalty.

    rows: of each text the words that are chosen or identity terms."""
    if not len(y) or y.min() == y.max():
        return {None: -50.0}
    terms = _latin(identity)
    place = {w: i + 1 for i, w in enumerate(dict.fromkeys([*chosen, *terms]))}
    d = len(place) + 1
    x = np.zeros((len(rows), d), np.float32)
    x[:, 0] = 1
    for i, t in enumerate(rows):
        x[i, [place[w] for w in t]] = 1
    # Differences of a text's features over a swap: the term that goes and the one that comes, another one for each text.
    gram = np.zeros((d, d))
    at, pairs = [place[t] for t in terms], 0
    for i, t in enumerate(rows if at else ()):
        present = set(t)
        own = [place[w] for w in terms if w in present]
        for a in own or [at[i % len(at)]]:
            other = at[(i + 7 * a + 1) % len(at)]
            for q in (other,) if own else (0, other):  # a text without a term: one is put in, and swapped
                if q != a:
                    delta = [(a, -1.0), (q, 1.0)] if q else [(a, -1.0)]
                    for r, u in delta:
                        for s, v in delta:
                            gram[r, s] += u * v
                    pairs += 1
    pull = penalty * len(rows) / max(1, pairs) * gram / 100 + np.diag([1e-6] + [RIDGE] * (d - 1))
    w = np.zeros(d)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (p * (1 - p)).astype(np.float32)[:, None])
        step = np.linalg.solve(h + pull, x.T @ (y - p) - pull @ w)
        w += step * min(1.0, 3.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-5:
            break
    return {None: float(w[0])} | {k.encode("latin-1"): float(w[i]) for k, i in place.items()}


def score(texts: list[set[bytes]], model: dict[bytes | None, float]) -> np.ndarray:
    z = np.array([model[None] + sum(model[w] for w in sorted(t & model.keys())) for t in texts], float)
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, folds: int = 5, held_out: int = 0, identity: list[str] = IDENTITY_TERMS, **settings) -> dict[bytes | None, float]:
    """A model from labelled rows; only their selected words come to the driver."""
    sample = materialise(word_sample(docs, labels, rows, folds, held_out), "toxicity-sample")
    chosen = select_words(sample)
    wanted = F.array(*[F.lit(w) for w in dict.fromkeys([*chosen, *_latin(identity)])])
    found = sample.select("doc_id", "y", F.array_intersect("words", wanted).alias("words")).toPandas().sort_values("doc_id")
    discard(sample)
    return fit([list(t) for t in found["words"]], found["y"].to_numpy(float), chosen, identity, **settings)


def classify(docs: DataFrame, model: dict[bytes | None, float], score_name: str = "score", predicted_name: str = "predicted") -> DataFrame:
    """The given columns, a score and a prediction; columns so named give way."""
    docs = docs.select([c for c in docs.columns if c not in (score_name, predicted_name)])
    at = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField(score_name, T.DoubleType()), T.StructField(predicted_name, T.IntegerType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            s = np.concatenate([np.zeros(0), *(score([words(t)], shared.value) for t in text_bytes(b.column(at)))])  # one set of words at a time
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [*b.schema.names, score_name, predicted_name])

    return docs.mapInArrow(run, schema)


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    """Score every document; the fold crc32(doc_id) mod 5 = 0 is held out."""
    docs = read_table(spark, sf_dir, "documents")
    model = train(docs, read_table(spark, sf_dir, "labels"))
    held = (crc_mod_col(F.col("doc_id"), 5) == 0).alias("held_out")
    return classify(id_and_text(docs), model).select("doc_id", held, "score", "predicted")
