"""Text normalisers and tokens as column functions. The normalisers differ on purpose: each serves one kind of key."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that carry no meaning in a question, and words that mean the same.
STOP_WORDS = ("a", "al", "como", "con", "cual", "de", "del", "donde", "el", "en", "esta", "este", "hay", "la", "las", "lo", "los", "me", "mi", "para", "por", "puedo", "que", "se", "su", "un", "una", "y")
EQUIVALENCES = {"modulo": "pantalla", "modulos": "pantalla"}


def _plain(value: str | None, fold_first: bool) -> str | None:
    if value is None:
        return None
    text = unicodedata.normalize("NFKD", value.casefold() if fold_first else value)
    text = "".join(c for c in text if not unicodedata.combining(c))
    return text if fold_first else text.casefold()


def _each(values: pa.Array, fold_first: bool) -> pa.Array:
    """_plain() of every value, few at a time: as Python's strings a batch of long texts takes several times its bytes."""
    made = [pa.array([_plain(v, fold_first) for v in values.slice(at, 64).to_pylist()], pa.string()) for at in range(0, len(values), 64)]
    out = pa.concat_arrays(made) if made else values
    del made
    pa.default_memory_pool().release_unused()
    return out


@F.arrow_udf(T.StringType())
def _folded(values: pa.Array) -> pa.Array:
    return _each(values, True)


@F.arrow_udf(T.StringType())
def _decomposed(values: pa.Array) -> pa.Array:
    return _each(values, False)


def _beyond_ascii(text: Column, plain: Callable[[Column], Column]) -> Column:
    """Only texts with more than ASCII go to Python; of the others lower case is all that there is to do."""
    ascii_ = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_, F.lower(text)).otherwise(plain(F.when(~ascii_, text)))


def folded(text: Column) -> Column:
    """Case folded, decomposed, without combining marks. Spark has no decomposition of its own."""
    return _beyond_ascii(text, _folded)


def decomposed(text: Column) -> Column:
    """Decomposed, without combining marks, then case folded."""
    return _beyond_ascii(text, _decomposed)


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once however often it is named."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def squeeze(text: Column) -> Column:
    """White space, of any script, as single spaces."""
    return F.trim(F.regexp_replace(text, r"(?U) \s+|[\s&&[^ ]]\s*", " "))  # a space alone stays as it is


def search_key(text: Column) -> Column:
    """For search: letters, digits and slashes."""
    return squeeze(F.regexp_replace(folded(text), "[^a-z0-9/]+", " "))


def id_key(text: Column) -> Column:
    """For stable ids: letters and digits."""
    return squeeze(F.regexp_replace(decomposed(text), "[^a-z0-9]+", " "))


def question_key(text: Column) -> Column:
    """For questions: letters of any script, digits, underscores."""
    return squeeze(F.regexp_replace(folded(text), r"(?U)[^\w\s]", " "))


def label_key(text: Column) -> Column:
    """For labels: lower case, seven accented letters made plain."""
    return F.translate(F.lower(squeeze(text)), "áéíóúüñ", "aeiouun")


def availability_key(text: Column) -> Column:
    """For error screens: folded, punctuation kept."""
    return squeeze(folded(text))


def signature_key(text: Column) -> Column:
    """For fingerprints: squeezed and in lower case."""
    return F.lower(squeeze(text))


def ascii_key(text: Column) -> Column:
    """search_key for ASCII text, with built-in functions only."""
    return squeeze(F.regexp_replace(F.lower(text), "[^a-z0-9/]+", " "))


def singular(word: Column) -> Column:
    """Spanish plurals made singular where the ending is clear."""
    n = F.length(word)
    vowel = F.substring(word, -2, 1).isin("a", "e", "i", "o", "u")
    return (
        F.when((n > 6) & word.endswith("ciones"), F.concat(word.substr(F.lit(1), n - 6), F.lit("cion")))
        .when((n > 4) & word.endswith("es"), word.substr(F.lit(1), n - 2))
        .when((n > 3) & word.endswith("s") & vowel, word.substr(F.lit(1), n - 1))
        .otherwise(word)
    )


def tokens(key: Column, stop_words: bool = True) -> Column:
    """The distinct words of a normalised text: stop words dropped as written, the rest made singular or replaced."""
    words = F.filter(F.split(F.translate(key, "/", " "), " +"), lambda w: (w != "") & (~w.isin(*STOP_WORDS) if stop_words else F.lit(True)))
    same = F.create_map(*[F.lit(x) for kv in EQUIVALENCES.items() for x in kv])
    return F.array_distinct(F.transform(words, lambda w: F.coalesce(F.try_element_at(same, w), singular(w))))


def overlap(a: Column, b: Column) -> Column:
    return F.coalesce(F.size(F.array_intersect(a, b)), F.lit(0))


def slug(text: Column) -> Column:
    """Letters and digits joined by single dashes."""
    return F.regexp_replace(F.regexp_replace(decomposed(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def capitalised(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(text.substr(F.lit(2), F.length(text))))


def breadcrumb(route: Column) -> Column:
    """The inner segments of a route as a trail: dashes are spaces, and every x reads "por"."""
    parts = F.filter(F.split(route, "/"), lambda p: p != "")
    inner = F.when(F.size(parts) > 2, F.slice(parts, F.lit(2), F.size(parts) - 2)).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.transform(inner, lambda p: capitalised(F.replace(F.replace(p, F.lit("-"), F.lit(" ")), F.lit("x"), F.lit(" por ")))), " → ")


def spoken_list(items: Column, none: str = "") -> Column:
    """"a, b y c"."""
    n = F.size(items)
    return F.when(n == 0, F.lit(none)).when(n == 1, F.element_at(items, 1)).otherwise(
        F.concat(F.array_join(F.slice(items, F.lit(1), F.greatest(n - 1, F.lit(1))), ", "), F.lit(" y "), F.try_element_at(items, F.lit(-1))))


def first_filled(*columns: Column) -> Column:
    """The first value that isn't null or blank, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])
