"""Small tables with the edge cases that every operator must handle."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows, schema=SCHEMA):
    """rows: (doc_id, text)."""
    return spark.createDataFrame([(i, t, None, "s", None) for i, t in rows], schema)


EDGES = [(1, None), (2, ""), (3, "   \n\t"), (4, "word"), (5, "same text here and there"), (6, "same text here and there"), (6, "same text here and there"), (7, "é\U0001f600 日本 \0 x"), (8, "long " * 20000), (9, "1" * 3000 + "@")]


def hostile(df):
    """The same rows with columns named like results and helpers."""
    for c in ("score", "predicted", "ids", "decoded", "chunk", "hash", "digest", "fp", "words", "kept", "component_id", "label"):
        df = df.selectExpr("*", f"'x' as {c}")
    return df
