"""Operator 7, byte-level BPE with the tokenizers library over Arrow batches."""

from __future__ import annotations

import base64
import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessella.llm.common import trimmed

#: Matches remembered by a task, the longest that is, and texts that are encoded together.
CACHE, LONGEST, TEXTS = 60_000, 32, 64


def byte_chars() -> list[str]:
    """The printable character that stands for each byte: bytes that print stand for themselves, the others follow 255."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    to = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [to[b] for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def tokenizer_json(ranks: dict[bytes, int]) -> str:
    """A tokenizers model with the merges that the ranks imply: any two tokens whose bytes joined are a token merge, the
    lower the rank of what they form the sooner."""
    chars = byte_chars()
    shown = {t: "".join(chars[b] for b in t) for t in ranks}
    merges = [[shown[t[:i]], shown[t[i:]]] for t in sorted(ranks, key=ranks.get) if len(t) > 1 for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    model = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False,
             "vocab": {shown[t]: i for t, i in ranks.items()}, "merges": merges}
    level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False}
    return json.dumps({"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "pre_tokenizer": level, "post_processor": None, "decoder": level, "model": model})


def id_bytes(model: str) -> list[bytes]:
    """Each id's bytes: the byte table, reversed, over the characters of the model's tokens. Ids that no token has decode
    to nothing. A token may end inside a character: bytes are joined before they are read."""
    vocabulary = json.loads(model)["model"]["vocab"]
    back = {ord(c): chr(b) for b, c in enumerate(byte_chars())}
    table = [b""] * (max(vocabulary.values(), default=-1) + 1)
    for token, i in vocabulary.items():
        table[i] = token.translate(back).encode("latin-1")
    return table


class Encoder:
    """Encodes the pattern's matches, each by itself, and remembers the frequent ones as arrays of ids in bytes."""

    def __init__(self, model: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        import regex
        from tokenizers import Tokenizer

        self.tokenizer, self.matches, self.known = Tokenizer.from_str(model), regex.compile(pattern).findall, {}

    def ids(self, texts: list[str]) -> list[bytes]:
        """Each text's ids, four bytes each. What is not yet known of all texts' matches is encoded in one batch."""
        words = [self.matches(t) for t in texts]
        if len(self.known) > CACHE:
            self.known.clear()
        known = self.known
        new = [w for w in set().union(*words) if w not in known]
        found = {w: np.array(e.ids, np.int32).tobytes() for w, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True)}
        known.update(found)
        out = [b"".join(map(known.__getitem__, ws)) for ws in words]
        for w in found:
            if len(w) > LONGEST:
                del known[w]
        return out

    def offsets(self, text: str) -> list[tuple[int, int]]:
        """Each token's first character and the one after its last; a character split over tokens is inside all of them."""
        out, at, words = [], 0, self.matches(text)
        for w, e in zip(words, self.tokenizer.encode_batch(words, add_special_tokens=False), strict=True):
            out += [(at + a, at + b) for a, b in e.offsets]
            at += len(w)
        return out


def _lists(values: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(v) // 4 for v in values)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(values), np.int32)))


def _sliced(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            yield whole.slice(at, rows)


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids", offsets: bool = False) -> DataFrame:
    """docs with `ids`, the ids of the whole text, and if asked `starts` and `ends`, each token's characters.

    The ranks at path are read on the driver and sent to executors: their size is the vocabulary's. Null and empty texts
    have no ids. No special tokens: their strings are ordinary text. Rows and other columns pass as they are, except that
    columns named like the added ones are replaced; an empty table stays empty. A text is encoded whole, in memory.
    """
    model = docs.sparkSession.sparkContext.broadcast(tokenizer_json(read_ranks(path)))
    added = [ids_col, *(["starts", "ends"] if offsets else [])]
    kept = [c for c in docs.columns if c not in added]
    ints = T.ArrayType(T.IntegerType(), False)
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(c, ints) for c in added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model.value, pattern)
        for batch in _sliced(batches, TEXTS):
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            new = [encoder.ids(texts)]
            if offsets:
                spans = [np.array(encoder.offsets(t), np.int32).reshape(-1, 2) for t in texts]
                new += [[s[:, k].tobytes() for s in spans] for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), *map(_lists, new)], names=[*kept, *added])

    return docs.mapInArrow(trimmed(run), schema)


def decode_ids(table: list[bytes], ids: list[int]) -> bytes:
    """The bytes of ids. Bytes are joined before anything reads them as UTF-8, so split characters come out whole."""
    return b"".join(map(table.__getitem__, ids))


def decode(tokens: DataFrame, path: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """tokens with `decoded`, the bytes of its ids. No ids or null give no bytes."""
    table = tokens.sparkSession.sparkContext.broadcast(id_bytes(tokenizer_json(read_ranks(path))))
    kept = [c for c in tokens.columns if c != bytes_col]
    schema = T.StructType([*(tokens.schema[c] for c in kept), T.StructField(bytes_col, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches, TEXTS):
            out = [decode_ids(table.value, ids or []) for ids in batch.column(batch.schema.get_field_index(ids_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.array(out, pa.binary())], names=[*kept, bytes_col])

    return tokens.mapInArrow(trimmed(run), schema)


def round_trip(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", ids: bool = False) -> DataFrame:
    """Per document: `keep`, if asked the ids, number of tokens, digest of its ids, digest of the bytes they decode to.

    Encodes and decodes in one pass, with encode's and decode's parts, so that only digests leave a task.
    """
    made = tokenizer_json(read_ranks(path))
    sent = docs.sparkSession.sparkContext.broadcast((made, id_bytes(made)))
    added = [T.StructField("ids", T.ArrayType(T.IntegerType(), False))] * ids + [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    schema = T.StructType([*(docs.schema[c] for c in keep), *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, table = sent.value
        encoder, decimal = Encoder(model, pattern), [str(i) for i in range(len(table))]
        for batch in _sliced(batches, TEXTS):
            n, of_ids, of_bytes = [], [], []
            encoded = encoder.ids([t or "" for t in batch.column(len(keep)).to_pylist()])
            for raw in encoded:
                own = np.frombuffer(raw, np.int32).tolist()
                n.append(len(own))
                of_ids.append(hashlib.sha256(" ".join(map(decimal.__getitem__, own)).encode()).hexdigest())
                of_bytes.append(hashlib.sha256(decode_ids(table, own)).hexdigest())
            new = [_lists(encoded)] * ids + [pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], names=[f.name for f in schema])

    return docs.select(*keep, text_col).mapInArrow(trimmed(run), schema)
