"""Lexical and vector search, and questions' intents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import text

# What each part of a screen adds to its score for a word of the question that it has.
WEIGHTS = {"content": 0.35, "fields": 1.2, "buttons": 1.1, "tables": 0.8, "links": 0.6}
TITLE_IN_QUESTION, TITLE_SHARE, ROUTE_WORD, CURRENT_SCREEN = 12.0, 5.0, 2.5, 15.0

# Patterns of question kinds, the first that matches holds.
INTENTS = (
    ("MUTATIVE_ACTION", r"(?U)\b(elimin|borr|anul|modific|edit|guard|cre|registr|aprob|confirm)"),
    ("SEARCH_BY_FIELD", r"(?U)\b(buscar|busco|busca|búsqueda|busqueda|filtrar)\b"),
    ("LIST_FIELDS", r"(?U)\b(campo|campos|filtro|filtros)\b"),
    ("LOCATE_FIELD", r"(?U)\b(dónde|donde|ingreso|aparece)\b.*\b(campo|ruc|identificaci)"),
    ("LOCATE_SCREEN", r"(?U)\b(módulo|modulo)\b.*\b(pantalla|dónde|donde)"),
    ("FIND_CONTROL", r"(?U)\b(botón|boton|control)\b"),
    ("LIST_COLUMNS", r"(?U)\b(columnas|columna|tabla)\b"),
    ("NAVIGATION_EVENT", r"(?U)\b(página|pagina|avanz|siguiente)\b"),
)


def lexical_score(question: Column, question_tokens: Column, title: Column, route: Column, parts: dict[str, Column], current: Column | None = None) -> Column:
    """Score of a screen for a question. title is normalised, parts are normalised texts by the names of WEIGHTS."""
    titled = text.tokens(title)
    whole = (title != "") & F.contains(question, title)
    score = F.when(whole, TITLE_IN_QUESTION).otherwise(F.lit(TITLE_SHARE) * text.overlap(question_tokens, titled) / F.greatest(F.size(titled), F.lit(1)))
    score = score + F.lit(ROUTE_WORD) * text.overlap(question_tokens, text.tokens(text.ascii_key(route)))
    for name, part in parts.items():
        score = score + F.lit(WEIGHTS[name]) * text.overlap(question_tokens, text.tokens(part))
    if current is not None:
        score = score + F.when(current, CURRENT_SCREEN).otherwise(0.0)
    return F.round(score, 3)


def top_k(df: DataFrame, score: str, ties: Sequence[Column], k: int, least: float) -> DataFrame:
    return df.where(F.col(score) >= least).orderBy(F.desc(score), *ties).limit(max(1, k))


def intent(question: Column) -> Column:
    """The first kind whose pattern the question matches; null if none does."""
    q = F.lower(question)
    out = F.when(q.rlike(INTENTS[0][1]), INTENTS[0][0])
    for name, pattern in INTENTS[1:]:
        out = out.when(q.rlike(pattern), name)
    return out


def page_intent(question: Column) -> Column:
    """What a question about one screen asks for."""
    key = text.ascii_key(question)
    words = F.split(key, " ")
    any_of = lambda *ws: F.arrays_overlap(words, F.array(*map(F.lit, ws)))
    phrase = lambda *ps: F.exists(F.array(*map(F.lit, ps)), lambda p: F.contains(key, p))
    return (
        F.when(any_of("campo", "campos"), "fields").when(any_of("boton", "botones", "accion", "acciones"), "buttons")
        .when(any_of("tabla", "tablas", "columnas", "resultados"), "tables")
        .when(phrase("que puedo hacer", "para que sirve", "que contiene", "describe"), "describe")
        .when(phrase("donde", "como reviso", "como consulto", "como encuentro", "ruta"), "locate")
        .when(F.size(text.tokens(key)) <= 4, "locate").otherwise("unknown")
    )


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest(vectors: DataFrame, question: Sequence[float], k: int, where: str | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k vectors of least cosine distance: (id, score), score held to -1..1. Metadata filter first."""
    rows = vectors if where is None else vectors.where(where)
    q = F.array(*[F.lit(float(x)) for x in question])
    scored = rows.select(id_col, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine(F.col(vector_col), q))).alias("score"))
    return scored.orderBy(F.desc("score"), id_col).limit(k)


def invalid_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows that break a batch: no numbers, or not as many as most have."""
    size = F.size(vector_col)
    usual = vectors.where(size > 0).groupBy(size.alias("n")).count().agg(F.max_by("n", "count").alias("usual"))
    return vectors.select(id_col, size.alias("n")).join(F.broadcast(usual), F.expr("true")).where("n <= 0 or n <> usual or n is null").select(id_col, "n")  # one row
