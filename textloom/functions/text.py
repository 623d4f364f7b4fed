"""Text functions, Column to Column: normalisation, tokens, n-grams, HTML and identifiers of texts."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# English words that are no search terms.
STOPWORDS_EN = (
    "the a an and or but if then than that this those these "
    "is are was were be been being "
    "of to in on for with as by at from into about over under "
    "he she it they them his her its their you your we our us "
    "i me my mine not no nor so too very can could may might "
    "shall should will would"
).split()

# Arabic words that are no search terms, before normalisation.
STOPWORDS_AR = (
    "و في على من إلى عن ما ماذا اذا إن أن كان كانت يكون تكون "
    "هذا هذه ذلك تلك هؤلاء اولئك هو هي هم هن نحن انت انتم أنت "
    "لا لم لن قد ثم او أو بل كل حتى مع بين عند إذ اذ الا إلا "
    "أي أى اي أين اين كيف لماذا لما لأن لان إنما إنه انه إنهم انهم"
).split()

# Formula words of transmission chains, before normalisation.
CHAIN_NOISE_AR = (
    "حدثنا اخبرنا سمعت سمع رواه "
    "قال قالت قالوا فقال فقالت فقالوا "
    "ابو ابي ابن بنت "
    "رجل امراه امرأة ناس احد احدى "
    "انه انها انهم هذا هذه"
).split()

# Openings of a narration's body, in the order in which they are tried.
BODY_MARKERS = ["قال رسول الله", "قال النبي", "أن النبي", "أن رسول الله", "عن النبي قال", "عن رسول الله قال"]

# Letters that normalisation folds, and into what.
_AR_FOLDED, _AR_FOLDS = "أإآىؤئ", "ااايءء"
_AR_MARKS = "[\u0610-\u061A\u064B-\u065F\u0670\u06D6-\u06ED\u0640]"


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def _squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


# Normalisers


def normalize_ar(c: Column | str) -> Column:
    """Without vowel marks and lengthening; alef, yeh and hamza forms folded; all but Arabic letters and digits as single spaces."""
    bare = F.translate(F.regexp_replace(_text(c), _AR_MARKS, ""), _AR_FOLDED, _AR_FOLDS)
    return _squeeze(F.regexp_replace(bare, "[^\u0600-\u06FF0-9]", " "))


def normalize_ar_mobile(c: Column | str) -> Column:
    """The mobile client's form: teh marbuta folds to heh, punctuation stays."""
    return _squeeze(F.translate(F.regexp_replace(_text(c), "[\u064B-\u065F\u0670]", ""), "آأإةى", "اااهي"))


def normalize_ar_query(c: Column | str) -> Column:
    """The mobile client's form of a query: marks go and alef forms fold, nothing else."""
    return F.trim(F.translate(F.regexp_replace(_text(c), "[\u064B-\u0670]", ""), "آأإ", "ااا"))


def normalize_en(c: Column | str) -> Column:
    """Lower case; all but a-z and 0-9 as single spaces."""
    return F.trim(F.regexp_replace(F.lower(_text(c)), "[^a-z0-9]+", " "))


def normalize_query(c: Column | str, lang: Column) -> Column:
    """A query without outer and repeated spaces, in lower case if it is English."""
    bare = _squeeze(_text(c))
    return F.when(lang == "en", F.lower(bare)).otherwise(bare)


# Tokens


def _kept(tokens: Column, stop: Column | None) -> Column:
    """Without numbers, single characters and stopwords. Digits of the Arabic blocks are digits too."""

    def keep(t):
        ok = (F.length(t) >= 2) & ~F.regexp_like(t, F.lit("^[0-9\u0660-\u0669\u06F0-\u06F9]+$"))
        return ok if stop is None else ok & ~F.array_contains(stop, t)

    return F.filter(tokens, keep)


def _words(normal: Column) -> Column:
    return F.when(normal == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(normal, " "))


def _any_of(words: list[str]) -> str:
    """A pattern for any of the words that looks at each character once, as words with the same beginning share it."""
    ends: dict[str, list[str]] = {}
    for w in sorted(set(words) - {""}):
        ends.setdefault(w[0], []).append(w[1:])
    every = "|".join(re.escape(first) + _any_of(rest) for first, rest in ends.items())
    return every and f"(?:{every})" + ("?" if "" in words else "")


def _kept_words(normal: Column, stop: list[str]) -> Column:
    """The same from a normalised text, whose words single spaces part: what is dropped goes in one look at the text."""
    gone = "|".join(["[0-9\u0660-\u0669\u06F0-\u06F9]+", "[^ ]", *filter(None, [_any_of(stop)])])
    return _words(F.rtrim(F.regexp_replace(normal, f"(?<![^ ])(?:{gone})(?: |$)", "")))


def tokenize_en(c: Column | str, stopwords: list[str] | None = None) -> Column:
    """Tokens in order, repeats included."""
    return _kept_words(normalize_en(c), STOPWORDS_EN if stopwords is None else stopwords)


#: Bytes of a normalised text: A-Z as a-z, and a blank for all but a-z and 0-9.
_PLAIN_EN = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789" else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def token_lists_en(texts):
    """tokenize_en of an Arrow array of texts, by steps over whole columns."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = texts.cast(pa.string()).fill_null("")
    at = np.frombuffer(texts.buffers()[1] or bytes(4), np.int32)[texts.offset : texts.offset + len(texts) + 1]
    raw = (texts.buffers()[2] or pa.py_buffer(b"")).slice(int(at[0]), int(at[-1] - at[0])).to_pybytes()
    if b"\xe2\x84\xaa" in raw or b"\xc4\xb0" in raw:  # the Kelvin sign and the dotted I are the characters beyond ASCII that have a letter a-z in lower case
        return token_lists_en(pa.array([t.replace("\u212a", "k").replace("\u0130", "i ") for t in texts.to_pylist()], pa.string()))
    plain = pa.StringArray.from_buffers(len(texts), pa.py_buffer((at - at[0]).astype(np.int32).tobytes()), pa.py_buffer(raw.translate(_PLAIN_EN)))
    words = pc.ascii_split_whitespace(plain)
    of, words = words.offsets.to_numpy(), words.values
    gone = pc.or_(pc.less(pc.binary_length(words), 2), pc.or_(pc.ascii_is_decimal(words), pc.is_in(words, pa.array(STOPWORDS_EN, pa.string()))))
    kept = pc.invert(gone)
    before = np.concatenate([[0], np.cumsum(kept.to_numpy(zero_copy_only=False))])
    return pa.ListArray.from_arrays(pa.array(before[of], pa.int32()), words.filter(kept))


def tokenize_ar(c: Column | str, stopwords: Column | None = None) -> Column:
    """Tokens in order, repeats included; stopwords: normalised, as an array, instead of the usual ones."""
    if stopwords is None:
        return _kept_words(normalize_ar(c), [normalized_ar(w) for w in STOPWORDS_AR])
    return _kept(_words(normalize_ar(c)), stopwords)


def normalized_ar(word: str) -> str:
    """What normalize_ar() makes of a constant."""
    bare = re.sub(_AR_MARKS, "", word).translate(str.maketrans(_AR_FOLDED, _AR_FOLDS))
    return " ".join(re.sub("[^\u0600-\u06FF0-9]", " ", bare).split())


def stopwords_ar(extra: list[str] | None = None) -> Column:
    """The Arabic stopwords, normalised, as an array."""
    return F.array_distinct(F.array(*[normalize_ar(F.lit(w)) for w in [*STOPWORDS_AR, *(extra or [])]]))


def lemma_tokens(tokens: Column, lemma: Callable[[Column], Column] | None = None, stop: Column | None = None) -> Column:
    """Lemmas of tokens, filtered like tokens. Without a lemmatiser a token is its own lemma."""
    return _kept(F.transform(tokens, lemma) if lemma else tokens, stop)


def lemma_text(lemmas: Column) -> Column:
    """Lemmas joined by spaces, repeats included."""
    return F.array_join(lemmas, " ")


def distinct_in_order(items: Column) -> Column:
    return F.array_distinct(items)


def extract_body(c: Column | str, markers: list[str] = BODY_MARKERS, share: float = 0.65) -> Column:
    """The text from the first marker, in the order of the list, that stands before ``share`` of it; else the whole text."""
    t = _text(c)
    out = F.when(F.lit(False), t)
    for m in markers:
        at = F.instr(t, m)
        out = out.when((at > 0) & (at - 1 < F.floor(F.length(t) * share)), F.substring(t, at, F.length(t)))
    return out.otherwise(t)


def trigrams(token: Column) -> Column:
    """All substrings of three characters, repeats included; a token of up to three is its own."""
    return F.when(F.length(token) <= 3, F.array(token)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(token) - 2, F.lit(1))), lambda i: F.substring(token, i, F.lit(3))))


def trigrams_mobile(token: Column) -> Column:
    """The mobile client's: trimmed and in lower case; only a token under three characters is its own."""
    t = F.lower(F.trim(token))
    return F.when(F.length(t) < 3, F.array(t)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 2, F.lit(1))), lambda i: F.substring(t, i, F.lit(3))))


def stem_variants_en(t: Column) -> Column:
    """A token and what is left without -ing, -ed, -es, -s, or with -ies as -y, as far as the token is long enough."""
    n = F.length(t)

    def without(suffix: str, longer: int, put: str = "") -> Column:
        return F.when(t.endswith(suffix) & (n > longer), F.concat(F.substring(t, F.lit(1), n - len(suffix)), F.lit(put)))

    every = F.array(t, without("ing", 5), without("ed", 4), without("es", 4), without("s", 3), without("ies", 5, "y"))
    return F.array_distinct(F.filter(every, lambda x: x.isNotNull()))


def max_allowed_edits(t: Column) -> Column:
    return F.when(F.length(t) <= 4, 1).when(F.length(t) <= 8, 2).otherwise(3)


# HTML


def strip_html(c: Column | str) -> Column:
    """Text of HTML with paragraph breaks: block ends become line ends, other tags spaces, named entities characters."""
    t = F.regexp_replace(_text(c), r"(?i)</p>|<br[ \t\r\n\f\x0B]*/?>|</div>", "\n")
    t = F.regexp_replace(t, "<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    t = F.regexp_replace(t, "&#?[0-9A-Za-z_]+;", "")
    t = F.regexp_replace(F.regexp_replace(t, "[ \t]+", " "), "\n{3,}", "\n\n")
    return F.regexp_replace(t, r"^[ \t\r\n\f\x0B]+|[ \t\r\n\f\x0B]+$", "")


def strip_html_inline(c: Column | str) -> Column:
    """Text of HTML on one line: tags go without a trace, six entities become characters, blanks single spaces."""
    t = F.regexp_replace(_text(c), "<[^>]+>", "")
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&#39;", "'"), ("&quot;", '"')):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(t, r"[ \t\r\n\f\x0B]+", " "))


def escape_html(c: Column | str) -> Column:
    t = _text(c)
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        t = F.replace(t, F.lit(char), F.lit(entity))
    return t


# Small string functions


def word_count(c: Column | str) -> Column:
    t = F.regexp_replace(_text(c), r"^[ \t\r\n\f\x0B]+|[ \t\r\n\f\x0B]+$", "")
    return F.when(t == "", 0).otherwise(F.size(F.split(t, r"[ \t\r\n\f\x0B]+")))


def trailing_number(c: Column | str) -> Column:
    """The number that ends a text, else null."""
    return F.nullif(F.regexp_extract(_text(c), "([0-9]+)$", 1), F.lit("")).cast("bigint")


def preview(c: Column | str, limit: int) -> Column:
    t = _text(c)
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit), F.lit("…"))).otherwise(t)


def zero_pad(n: Column, width: int) -> Column:
    """A number with leading zeros; a longer one stays whole."""
    s = n.cast("string")
    return F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, "0"))


def cache_key(lang: Column, query: Column, prefix: str = "qs:v1:") -> Column:
    """The key of a cached answer: a prefix and the SHA-1 of language and query."""
    return F.concat(F.lit(prefix), F.sha1(F.concat_ws(":", lang, query)))


def canonical_path(c: Column | str, root: str = "data/") -> Column:
    """A shard's path with slashes, without a leading ./, below the root."""
    p = F.regexp_replace(F.replace(_text(c), F.lit("\\"), F.lit("/")), r"^\./", "")
    return F.when(p.startswith(root), p).otherwise(F.concat(F.lit(root), p))


def strip_pictograph_prefix(c: Column | str) -> Column:
    """A label without leading pictographs; their blocks are listed, as the JDK lacks the property."""
    return F.regexp_replace(_text(c), r"^\s*[\x{203C}-\x{3299}\x{1F000}-\x{1FAFF}\x{FE0F}\x{200D}]+\s*", "")


def id_label(key: Column, name: Column) -> Column:
    return F.concat_ws(" — ", key, name)
