"""Operator 4, language identification with error-correcting output codes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Hashed n-grams of letters, their lengths, and the weight that every n-gram has beforehand.
FEATURES, LENGTHS, PRIOR = 1 << 14, (2, 3, 4), 0.5
#: A decision is ambiguous if the best two codewords' shares are nearer than this.
AMBIGUOUS = 0.2
#: Texts longer than this are counted in pieces, to bound memory; the counts are those of the whole.
PIECE = 1 << 20

#: ASCII other than letters becomes a space, as what separates words.
_FOLD = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def ngrams(text: str) -> np.ndarray:
    """Counts of the hashed n-grams of a text's bytes, in lower case, runs of other ASCII as one space."""
    counts = np.zeros(FEATURES, np.int64)
    raw = b" " + b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_FOLD).split(b" ")) + b" "
    most = max(LENGTHS)
    for at in range(0, len(raw), PIECE):
        b = np.frombuffer(raw[at : at + PIECE + most - 1], np.uint8).astype(np.uint32)
        for n in LENGTHS:
            size = min(len(b) - n + 1, PIECE)
            if size <= 0:
                continue
            code = np.full(size, n, np.uint32)
            for k in range(n):
                code = code * np.uint32(257) + b[k : k + size]
            code *= np.uint32(0x9E3779B1)
            code ^= code >> np.uint32(15)
            code *= np.uint32(0x85EBCA77)
            blank = (b[:size] == 32) & (b[n - 1 : n - 1 + size] == 32)
            counts += np.bincount(code[~blank] >> np.uint32(18), minlength=FEATURES)
    return counts


def codewords(n: int) -> np.ndarray:
    """n rows of bits: all ways to split the languages in two where these are few; else the best of many random codes,
    by the least distance of two rows."""
    if n <= 6:
        return np.array([[(word >> k) & 1 for word in range(1, 1 << max(n - 1, 1))] for k in range(n)]).astype(bool)
    rng, best, least = np.random.default_rng(7), None, -1
    for _ in range(200):
        code = rng.random((n, 10 + 6 * int(np.ceil(np.log2(n))))) < 0.5
        apart = min((code[i] != code[j]).sum() for i in range(n) for j in range(i))
        if apart > least and not (code.all(0) | ~code.any(0)).any():
            best, least = code, apart
    return best if best is not None else np.eye(n, dtype=bool)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict:
    """The model: languages, codewords, and for each bit a binary n-gram classifier with its weight in decoding.

    N-gram counts of all training documents are summed by language, in tasks and then by key: as many rows as languages
    times FEATURES. A bit's classifier is the log odds of an n-gram in the languages that have the bit against those that
    have not; its weight is how far apart its own training languages' mean margins lie, against the hardest language.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch[text_col], batch[lang_col], strict=True):
                sums[lang] = sums.get(lang, 0) + ngrams(text)
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pd.DataFrame({"lang": lang, "feature": at, "n": n[at]})

    known = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(text_col, lang_col)
    # at most FEATURES rows a language reach the driver
    rows = known.mapInPandas(count, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(rows["lang"].unique())
    n = np.zeros((len(langs), FEATURES))
    if langs:
        n[np.searchsorted(langs, rows["lang"]), rows["feature"]] = rows["n"]
    share = (n + PRIOR) / (n + PRIOR).sum(1, keepdims=True)
    code = codewords(len(langs)) if len(langs) > 1 else np.zeros((len(langs), 0), bool)
    odds = np.array([np.log(share[bit].mean(0)) - np.log(share[~bit].mean(0)) for bit in code.T]).reshape(-1, FEATURES)
    mean = odds @ share.T
    weight = np.maximum(np.where(code.T, mean, -mean).min(1), 1e-3) if len(langs) > 1 else np.zeros(0)
    return {"langs": langs, "code": code, "odds": odds / weight[:, None] if len(weight) else odds, "weight": weight / max(weight.sum(), 1e-9)}


def decide(model: dict, text: str | None) -> tuple[str, float, bool]:
    """(language, score, ambiguous). Each bit's loss is logistic in its margin, a mean over n-grams sharpened by their
    number's root, so short texts stay doubtful; the codeword with the least weighted loss is nearest."""
    if text is None or not model["langs"] or not any(map(str.isalpha, text)):
        return "und", 0.0, True
    n = ngrams(text)
    total = n.sum()
    if len(model["langs"]) == 1:
        return model["langs"][0], 1.0, False
    margin = (model["odds"] @ n) / max(total, 1) * min(np.sqrt(total), 30.0)
    signs = np.where(model["code"], 1.0, -1.0)
    loss = (np.logaddexp(0, -signs * margin) * model["weight"]).sum(1)
    share = np.exp(loss.min() - loss)
    share /= share.sum()
    order = np.argsort(-share, kind="stable")
    return model["langs"][order[0]], float(share[order[0]]), bool(share[order[0]] - share[order[1]] < AMBIGUOUS)


def predict(docs: DataFrame, model: dict, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns with lang_pred, score and ambiguous for every row.

    Null texts and texts without a letter are `und`, score 0, ambiguous; so is all if nothing was learned. Repeated rows
    are judged alike, an empty table gives no rows. Whole texts are read, long ones in pieces.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    added = [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("ambiguous", T.BooleanType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [decide(sent.value, t.as_py()) for t in batch.column(len(keep))]
            new = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], names=[*keep, *(name for name, _ in added)])

    schema = T.StructType([*(docs.schema[c] for c in keep), *(T.StructField(*x) for x in added)])
    return docs.select(*keep, text_col).mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> F.Column:
    """True for the rows that no model learns from; null ids are not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    model = train(docs.where(~held_out(id_col) & F.col(id_col).isNotNull()), text_col, lang_col)
    marked = docs.select(id_col, text_col, held_out(id_col).alias("held_out"))
    return predict(marked, model, text_col, (id_col, "held_out"))
