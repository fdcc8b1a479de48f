"""Operator 11: WARC archives, written and read in sequence, one gzip member a record.

Tasks write archives of their own to a shared folder and give their names as rows, which Spark commits with the task: what a
lost or repeated attempt has written is never read. The reader inflates members piece by piece, takes as many bytes as a
record's Content-Length says, and computes digests on the way, so a task holds one record's payload at most, and none if
payloads are not asked for.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from datetime import UTC, datetime
from typing import NamedTuple
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import stored

#: Records with shorter payloads are never written as revisits.
LEAST = 100
#: Bytes of an archive after which the next one begins, bytes that are read and inflated at once, and of rows sent at once.
ARCHIVE, PIECE, SENT = 256 << 20, 1 << 16, 8 << 20
PREFIX = "urn:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: What stays as it is in a header's URI; everything else, line ends above all, is written as %XX.
PLAIN = "!#$%&'()*+,-./:;=?@[]_~"
GZIP = 31
MANIFEST = "path string, n_records long, n_bytes long"
RECORD = (
    "record_id string, record_type string, target_uri string, refers_to string, payload_bytes long, payload_digest string, "
    "problem string, archive string"
)


class Damaged(ValueError):
    """An archive that cannot be read on."""


class Record(NamedTuple):
    fields: dict[str, str]
    payload_bytes: int
    payload_digest: str
    payload: bytes | None
    problem: str | None


# writing


def marked(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
           least: int = LEAST) -> DataFrame:
    """(id, url, payload, payload_digest, refers_to, refers_uri): of equal payloads of `least` bytes and more that with the
    smallest id is a response, the others refer to it.

    Null payloads are empty. Rows that repeat the smallest id with an equal payload are responses too, as a record can't
    refer to itself; rows without an id refer to the smallest id of their payload, and are responses if there is none.
    Payloads are compared by SHA-256. Groups are found from digests alone and written, so their size is known when they are
    joined: Spark sends them to all tasks below its broadcast threshold and shuffles, splitting hot digests, above it.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"),
        F.sha2(payload, 256).alias("payload_digest"),
    )
    first = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "url")))
    groups = rows.where(F.length("payload") >= least).groupBy("payload_digest").agg(first.alias("f"), F.count("*").alias("n"))
    groups = groups.where("n > 1 and f is not null").select("payload_digest", "f.id", "f.url")
    firsts = stored(groups.toDF("payload_digest", "first_id", "first_url"), "warc-firsts")
    other = F.col("first_id").isNotNull() & (F.col("id").isNull() | (F.col("id") > F.col("first_id")))
    return rows.join(firsts, "payload_digest", "left").select(
        "id", "url", "payload", "payload_digest", F.when(other, F.col("first_id")).alias("refers_to"),
        F.when(other, F.col("first_url")).alias("refers_uri"),
    )


def framed(fields: list[tuple[str, str | None]], *block: bytes) -> bytes:
    """A record as one gzip member. Fields without a value are left out."""
    size = sum(map(len, block))
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(size))] if v is not None)
    z = zlib.compressobj(6, zlib.DEFLATED, GZIP)
    parts = [z.compress(p) for p in (f"WARC/1.1\r\n{head}\r\n".encode(), *block, b"\r\n\r\n")]
    return b"".join(parts) + z.flush()


def written(uri: str | None) -> str | None:
    return None if uri is None else quote(uri, safe=PLAIN)


def record_of(name: str, uri: str | None, payload: bytes, digest: str, refers: str | None, refers_uri: str | None,
              date: str) -> bytes:
    """A response with its HTTP message, or a revisit whose HTTP message has its headers only."""
    http = (
        f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = (http,) if refers else (http, payload)
    of_block = hashlib.sha256(http)
    for rest in block[1:]:
        of_block.update(rest)
    fields = [
        ("WARC-Type", "revisit" if refers else "response"), ("WARC-Record-ID", f"<{name}>"), ("WARC-Date", date),
        ("WARC-Target-URI", written(uri)), ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{of_block.hexdigest()}"),
        ("WARC-Profile", PROFILE if refers else None), ("WARC-Refers-To", f"<{refers}>" if refers else None),
        ("WARC-Refers-To-Target-URI", written(refers_uri)),
    ]
    return framed(fields, *block)


def write(rows: DataFrame, folder: str, prefix: str = PREFIX, archive: int = ARCHIVE) -> DataFrame:
    """Writes what marked() gave as archives below folder, a URI that all executors reach; one row an archive:
    path, n_records, n_bytes. A record's id is `prefix` and the row's id. An empty table gives no archives."""
    date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    system, base = pa.fs.FileSystem.from_uri(folder)
    system.create_dir(base, recursive=True)

    def name(value: object) -> str:
        return prefix + ("" if value is None else quote(str(value), safe=PLAIN))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pa.fs.FileSystem.from_uri(folder)
        out, path, n, size = None, "", 0, 0

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n]), pa.array([size])], names=["path", "n_records", "n_bytes"])

        try:
            for batch in batches:
                for i in range(batch.num_rows):
                    at, url, payload, digest, refers, refers_uri = (c[i].as_py() for c in batch.columns)
                    if out is None:
                        path, n = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{root}/{path}", compression=None)
                        info = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date),
                                ("WARC-Filename", path), ("Content-Type", "application/warc-fields")]
                        size = out.write(framed(info, b"format: WARC File Format 1.1\r\n"))
                    made = record_of(name(at), url, payload, digest, None if refers is None else name(refers), refers_uri, date)
                    out.write(made)
                    n, size = n + 1, size + len(made)
                    if size >= archive:
                        yield closed()
                        out = None
            if out is not None:
                yield closed()
                out = None
        finally:
            if out is not None:
                out.close()

    columns = rows.select("id", "url", "payload", "payload_digest", "refers_to", "refers_uri")
    made = columns.mapInArrow(run, MANIFEST)
    return stored(made.withColumn("path", F.concat(F.lit(folder.rstrip("/") + "/"), "path")), "warc-manifest")


# reading


class Members:
    """The gzip members of a stream, one after the other; piece() inflates the next PIECE bytes at most."""

    def __init__(self, read: Callable[[int], bytes]):
        self.read, self.raw, self.z = read, b"", None

    def next(self) -> bool:
        self.raw = self.raw or self.read(PIECE)
        self.z = zlib.decompressobj(GZIP)
        return bool(self.raw)

    def piece(self) -> bytes:
        """b"" at the member's end."""
        while not self.z.eof:
            self.raw = self.raw or self.read(PIECE)
            last = not self.raw
            try:
                out = self.z.decompress(self.raw, PIECE)
            except zlib.error as e:
                raise Damaged(f"not a gzip member: {e}") from e
            self.raw = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
            if out:
                return out
            if last and not self.z.eof:
                raise Damaged("the archive ends inside a member")
        return b""


def header(raw: bytes) -> tuple[str, dict[str, str]]:
    """First line, and fields by lower-case name; lines that begin with a blank go on with the field before them."""
    lines = raw.decode("utf-8", "replace").split("\r\n")
    fields: dict[str, str] = {}
    last = ""
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and last:
            fields[last] += " " + line.strip()
        elif ":" in line:
            last, value = line.split(":", 1)
            last = last.strip().lower()
            fields[last] = value.strip()
    return lines[0], fields


class Block:
    """Digests of a record's block and of its payload, which follows the HTTP headers if there are any."""

    def __init__(self, http: bool, keep: bool):
        self.whole, self.payload, self.size = hashlib.sha256(), hashlib.sha256(), 0
        self.head, self.fields, self.kept = b"" if http else None, {}, [] if keep else None

    def add(self, piece: bytes) -> None:
        self.whole.update(piece)
        if self.head is not None:
            self.head += piece
            end = self.head.find(b"\r\n\r\n")
            if end < 0:
                return
            piece, self.fields, self.head = self.head[end + 4 :], header(self.head[:end])[1], None
        self.payload.update(piece)
        self.size += len(piece)
        if self.kept is not None:
            self.kept.append(piece)


def declared(fields: dict[str, str], name: str) -> str | None:
    """A SHA-256 of 64 hex digits; other algorithms and notations are not verified."""
    kind, _, value = fields.get(name, "").partition(":")
    return value.lower() if kind.lower().replace("-", "") == "sha256" and len(value) == 64 else None


def records(read: Callable[[int], bytes], keep: bool = False) -> Iterator[Record]:
    """The records of an archive in sequence. Raises Damaged where framing is broken; a wrong digest or length is said in
    the record's `problem`. A revisit's digest and length are those that it declares for the full payload."""
    members = Members(read)
    while members.next():
        held = b""
        while (end := held.find(b"\r\n\r\n")) < 0:
            piece = members.piece()
            if not piece:
                raise Damaged("a member without a record")
            held += piece
        version, fields = header(held[:end])
        if not version.startswith("WARC/") or not fields.get("content-length", "").isdigit():
            raise Damaged("a record without version or Content-Length")
        left, rest = int(fields["content-length"]), held[end + 4 :]
        block = Block(fields.get("content-type", "").startswith("application/http"), keep)
        while left:
            rest = rest or members.piece()
            if not rest:
                raise Damaged("a record shorter than its Content-Length")
            block.add(rest[:left])
            left, rest = left - min(left, len(rest)), rest[left:]
        while len(rest) <= 4 and (piece := members.piece()):
            rest += piece
        if rest != b"\r\n\r\n":
            raise Damaged("a record longer than its Content-Length")
        yield _verified(fields, block)


def _verified(fields: dict[str, str], block: Block) -> Record:
    revisit = fields.get("warc-type") == "revisit"
    told = block.fields.get("content-length", "")
    digest, size, problem = block.payload.hexdigest(), block.size, None
    if (of_block := declared(fields, "warc-block-digest")) and of_block != block.whole.hexdigest():
        problem = "block digest"
    of_payload = declared(fields, "warc-payload-digest")
    if revisit:
        digest, size = of_payload or "", int(told) if told.isdigit() else 0
    elif of_payload and of_payload != digest:
        problem = problem or "payload digest"
    elif told.isdigit() and int(told) != size:
        problem = problem or "payload length"
    return Record(fields, size, digest, None if block.kept is None or revisit else b"".join(block.kept), problem)


def read(archives: DataFrame, payloads: bool = False, strict: bool = True) -> DataFrame:
    """One row a record of the archives at `path`, but for warcinfo: RECORD's columns, and `payload` if asked for.

    strict: a broken archive or a wrong digest fails the job. Else a wrong digest stands in `problem`, and a broken archive
    gives a row with `problem` alone where it breaks, as what follows cannot be framed. Each archive is read by one task, in
    sequence. Other columns of archives are not read; no archives give no rows.
    """
    schema = RECORD + (", payload binary" if payloads else "")
    names = [c.split()[0] for c in schema.split(", ")]

    def bare(uri: str | None) -> str | None:
        return None if uri is None else uri.strip("<>")

    def rows_of(path: str) -> Iterator[tuple]:
        fs, at = pa.fs.FileSystem.from_uri(path)
        with fs.open_input_stream(at, compression=None) as stream:
            try:
                for r in records(stream.read, payloads):
                    if r.problem and strict:
                        raise Damaged(f"{path}: {r.problem} of {r.fields.get('warc-record-id')}")
                    if r.fields.get("warc-type") != "warcinfo":
                        own = [bare(r.fields.get(k)) for k in ("warc-record-id", "warc-type", "warc-target-uri", "warc-refers-to")]
                        yield (*own, r.payload_bytes, r.payload_digest, r.problem, path, *([r.payload] if payloads else []))
            except Damaged as e:
                if strict:
                    raise
                yield (*[None] * 6, str(e), path, *([None] if payloads else []))

    kinds = [pa.string()] * 4 + [pa.int64()] + [pa.string()] * 3 + [pa.binary()] * payloads

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for path in b.column(0).to_pylist():
                for row in rows_of(path):
                    held.append(row)
                    size += 400 + len(row[-1] or b"") * payloads
                    if size >= SENT:
                        yield batch(held)
                        held, size = [], 0
        if held:
            yield batch(held)

    paths = archives.select("path")
    return paths.repartition(max(1, paths.count())).mapInArrow(run, schema)


def resolved(found: DataFrame) -> DataFrame:
    """Read records, each revisit with payload_bytes and payload_digest of the response that it refers to; a revisit that
    refers to none, or to another digest, has a `problem`. Records that several revisits refer to are joined without a
    hint, so a hot one is split; responses pass by the join."""
    own = [c for c in found.columns if c not in ("payload_bytes", "payload_digest", "problem", "payload")]
    kept = ["payload"] if "payload" in found.columns else []
    is_revisit = F.coalesce(F.col("record_type") == "revisit", F.lit(False))
    of = found.where("record_type = 'response'").select(
        F.col("record_id").alias("_id"), F.col("payload_bytes").alias("_bytes"), F.col("payload_digest").alias("_digest"),
        *(F.col(c).alias(f"_{c}") for c in kept),
    ).dropDuplicates(["_id", "_digest"])  # ids repeat only with equal payloads
    revisits = found.where(is_revisit).drop("payload")
    match = (revisits["refers_to"] == of["_id"]) & (revisits["payload_digest"] == of["_digest"])
    lost = F.when(F.col("_id").isNull(), "refers to no such record").when(F.col("_bytes") != F.col("payload_bytes"), "payload length")
    joined = revisits.join(of, match, "left").select(
        *own, F.coalesce("_bytes", "payload_bytes").alias("payload_bytes"), "payload_digest",
        F.coalesce("problem", lost).alias("problem"), *(F.col(f"_{c}").alias(c) for c in kept),
    )
    return found.where(~is_revisit).select(joined.columns).union(joined)
