"""Text functions as Column -> Column. Java's \\w, \\d and \\s are ASCII unless ``(?U)`` asks for Unicode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern import schemas as S

_STAMP = r"\[\d{2}:\d{2}:\d{2}\.\d{3} --> \d{2}:\d{2}:\d{2}\.\d{3}\]"
_ENDS_IN_ELLIPSIS = r"(\.\.\.|…)\s*$"
_TURN = r"^[-–—](?U)\s*"
_STARTS_WITH_ELLIPSIS = r"^(\.\.\.|…)(?U)\s*"
#: ASCII punctuation and the two Spanish opening marks.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¡¿"
#: Verbs that stop-word removal keeps.
ESSENTIAL_VERBS = ("ser", "estar", "tener", "haver", "fer", "hacer")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once, also where the body uses it in a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space, Unicode's included, at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def words(c: Column) -> Column:
    """Runs of non-space; none for blank text, null for null."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def is_blank(c: Column) -> Column:
    return F.coalesce(~c.rlike(r"(?U)\S"), F.lit(True))


def drop_stamps(c: Column) -> Column:
    """Without transcript time stamps and the white space that must follow each."""
    return F.regexp_replace(c, _STAMP + r"(?U)\s+", "")


def drop_bare_stamps(c: Column) -> Column:
    return F.regexp_replace(c, _STAMP, "")


def is_digits(w: Column) -> Column:
    return w.rlike(r"(?U)^\d+$")


def drop_numbers(c: Column) -> Column:
    """Words of digits only go; single spaces stay between the others."""
    return F.array_join(F.filter(words(c), lambda w: ~is_digits(w)), " ")


def clean(c: Column) -> Column:
    """Words and basic punctuation; time stamps, other characters and numbers go."""
    return drop_numbers(F.regexp_replace(drop_bare_stamps(c), r"(?U)[^\w\s.,!?¡¿]", " "))


def clean_keeping_marks(c: Column) -> Column:
    """As ``clean``, but apostrophes, middle dots and hyphens stay within words."""
    return drop_numbers(F.regexp_replace(drop_bare_stamps(c), r"(?U)[^\w\s.,!?¡¿'’·-]", " "))


def drop_punctuation(c: Column) -> Column:
    return F.translate(c, PUNCTUATION, "")


def drop_lone_punctuation(c: Column) -> Column:
    return F.array_join(F.filter(words(c), lambda w: ~w.rlike(r"^[.,!?¡¿\-]+$") & ~is_digits(w)), " ")


def topic_text(c: Column) -> Column:
    """Numbers go first; then characters that are neither word nor space are deleted, so their neighbours join."""
    return F.regexp_replace(drop_numbers(c), r"(?U)[^\w\s]", "")


def normal_sentence(c: Column) -> Column:
    """For comparing sentences: no leading dashes, no punctuation, lower case."""
    bare = strip(F.regexp_replace(strip(c), "^-+", ""))
    return strip(F.lower(F.regexp_replace(bare, r"(?U)[^\w\s]", "")))


def normal_term(c: Column) -> Column:
    return F.replace(F.lower(strip(c)), F.lit(" "), F.lit("_"))


def bare_word(w: Column) -> Column:
    """Lower case, without sentence marks at either end."""
    return F.regexp_replace(F.lower(w), r"^[.,!?]+|[.,!?]+$", "")


def word_set(c: Column) -> Column:
    return F.array_distinct(F.transform(words(c), bare_word))


def prefix(c: Column, n: int = S.DETECT_CHARS) -> Column:
    return F.substring(c, 1, n)


def pieces(c: Column, n: int = S.LEGACY_CHUNK_CHARS) -> Column:
    """The text in stretches of ``n`` characters."""
    count = F.ceil(F.length(c) / n).cast("int")
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(c, i * n + 1, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def digest(c: Column) -> Column:
    return F.sha2(c, 256)


def ends_in_ellipsis(c: Column) -> Column:
    return c.rlike(_ENDS_IN_ELLIPSIS)


def continues(c: Column) -> Column:
    """Whether a sentence goes on from one that trailed off: its first letter, with no digit or opening mark before, is lower-case."""
    bare = F.regexp_replace(F.regexp_replace(c, _TURN, ""), _STARTS_WITH_ELLIPSIS, "")
    return bare.rlike(r"""(?s)^[^\p{L}\d"'‘’“”(¿¡]*\p{IsLowercase}""")


def drop_trailing_ellipsis(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, _ENDS_IN_ELLIPSIS, ""), r"(?U)\s+$", "")


def drop_leading_marks(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, _TURN, ""), _STARTS_WITH_ELLIPSIS, ""), r"(?U)^\s+", "")


def lexical_tokens(c: Column) -> Column:
    """Runs of letters, and runs of digits: what segmentation must keep in order."""
    return F.regexp_extract_all(c, F.lit(r"(?U)[^\W\d_]+|\d+"), F.lit(0))


def topic_tokens(c: Column) -> Column:
    """Lower-cased words of two or more letters or underscores."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\b[^\d\W][^\d\W]+\b"), F.lit(0))


def with_bigrams(tokens: Column) -> Column:
    """Each token, and after it the pair that it begins."""
    pairs = lambda ts: F.transform(ts, lambda t, i: F.when(i < F.size(ts) - 1, F.array(t, F.concat_ws("_", t, F.get(ts, i + 1)))).otherwise(F.array(t)))
    return F.flatten(let(tokens, pairs))


def bigrams(tokens: Column, by: str = " ") -> Column:
    n = F.size(tokens)
    return F.when(n > 1, F.zip_with(F.slice(tokens, 1, n - 1), F.slice(tokens, 2, n - 1), lambda a, b: F.concat(a, F.lit(by), b))).otherwise(F.array().cast("array<string>"))


def label_number(c: Column) -> Column:
    """``"4 stars"`` -> 4."""
    return F.split_part(c, F.lit(" "), F.lit(1)).try_cast("int")


def topic_number(c: Column) -> Column:
    """The number in ``Topic 3``; names without one sort last."""
    return F.coalesce(strip(F.replace(c, F.lit("Topic"), F.lit(""))).try_cast("int"), F.lit(1_000_000_000))


def question_parts(c: Column) -> Column:
    """Numeric parts of a question id, for sorting; parts with letters are left out."""
    return F.transform(F.filter(F.split(c, r"\."), lambda p: p.rlike("^[0-9]+$")), lambda p: p.cast("int"))


def clock(seconds: Column) -> Column:
    s = F.floor(seconds).cast("long")
    return F.format_string("%02d:%02d:%02d", (s / 3600).cast("long"), ((s % 3600) / 60).cast("long"), s % 60)


def response_id(interview: Column, question: Column) -> Column:
    return F.concat_ws("::", interview, question)


def sentence_id(response: Column, index: Column) -> Column:
    return F.concat(response, F.lit("::s"), F.format_string("%03d", index.cast("int")))


def memory_key(model: Column, version: Column, source: Column, target: Column, text: Column) -> Column:
    return F.concat(model, F.lit("|"), version, F.lit("|"), source, F.lit("->"), target, F.lit(":"), digest(text))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def long_enough(c: Column) -> Column:
    """Long enough for its language to be told: in characters and in words."""
    s = strip(c)
    return (F.length(s) >= S.LEAST_CHARS) & (word_count(s) >= S.LEAST_WORDS)


def average_label(score: Column) -> Column:
    return F.when(score > S.POSITIVE_ABOVE, "POSITIVE").when(score < S.NEGATIVE_BELOW, "NEGATIVE").otherwise("NEUTRAL")


def score_label(score: Column) -> Column:
    clamped = F.greatest(F.least(score.cast("int"), F.lit(5)), F.lit(0))
    out = F.when(F.lit(False), "")
    for k, name in S.SENTIMENT_LABELS.items():
        out = out.when(clamped == k, name)
    return out.otherwise("NEUTRAL")


def half_even(c: Column, places: int = 0) -> Column:
    return F.bround(c, places)


def drop_stopwords(tokens: Column, stopwords: tuple[str, ...], keep: tuple[str, ...] = ESSENTIAL_VERBS) -> Column:
    """Without the stop words, verbs of ``keep`` excepted."""
    return F.filter(tokens, lambda t: ~F.lower(t).isin(*stopwords) | F.lower(t).isin(*keep)) if stopwords else tokens


def legacy_topic_text(c: Column, lemmas, stopwords: tuple[str, ...] = ()) -> Column:
    """The older cleaning: clean, lemmatise, drop stop words, punctuation and numbers. ``lemmas``: array to array."""
    kept = drop_stopwords(lemmas(words(clean(c))), stopwords)
    return drop_numbers(drop_punctuation(F.array_join(kept, " ")))
