"""WARC archives written and read as a table of record chunks.

Writing: payload digests come from SQL; the page with the smallest page_id of a group of equal
payloads of at least 100 bytes is the response, the others are revisits without a body. Each payload is
cut into chunks, a row each (record, chunk number, bytes), cut as the row is made, so neither Spark nor a
Python worker holds more than the payload itself and a chunk. A task streams its rows into one archive of
gzip members (one member a record), under a name of its own, and returns a row per member; only rows of
finished tasks name archives, so attempts that died leave nothing that counts.

Payloads are never shuffled. Up to ``broadcast_digests`` repeated digests go to all tasks, which then
write revisits at once. Of more, every page is written as a response first; which members have to become
revisits is found by joining the rows of the members (ids, digest, place in the archive; no payload) with
the repeated digests, those of at least ``hot_copies`` pages by broadcast (no more than pages divided by
that) and the rest by merge. Then each archive is copied member by member, in pieces, with revisit
members in the place of those responses, and the first archives are deleted.

Reading: a task streams one archive through a bounded decompressor and yields rows
(page_id, chunk_no, chunk, offset, sha256 of the payload so far, last); the last chunk of a record
carries the digest of the whole payload. No record is held whole.

Record ids derive from page_id and digest, so a revisit can name its response's record. A header value
has %, CR and LF escaped as %25, %0D and %0A, which reading undoes.

Defined results: a null html is an empty payload (a single empty last chunk); payloads under 100
bytes are always responses; of rows with the smallest page_id repeated, each is a response; a
null page_id is written and read back as null and never chosen as referred-to page, and such a
page is a response; an empty table gives no records; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkverity.llm.common import bounded_batches, checkpointed, new_dir, remove

LEAST_BYTES = 100
CHUNK_BYTES = 1 << 16
BROADCAST_DIGESTS = 500_000
HOT_COPIES = 100_000
#: Fixed value: the profile of a revisit whose payload is that of another record.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_READ = 1 << 16


_DIGEST = ["payload_bytes", "payload_digest"]


def _digested(pages: DataFrame) -> DataFrame:
    payload = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    return pages.select(
        "page_id", F.col("url").cast("string").alias("url"), payload.alias("payload"), F.length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_digest")
    )


def repeated_digests(pages: DataFrame) -> DataFrame:
    """payload_digest, first_id and copies of payloads that more than one page has."""
    return (
        _digested(pages)
        .where(F.col("payload_bytes") >= LEAST_BYTES)
        .groupBy("payload_digest")
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies"))
        .where("copies > 1")
    )


def records(pages: DataFrame, repeated: DataFrame) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type and refers_to of each page; repeated goes to all tasks."""
    joined = _digested(pages).join(F.broadcast(repeated.drop("copies")), "payload_digest", "left")
    again = F.col("first_id") < F.col("page_id")
    return joined.select(
        "page_id",
        "url",
        F.when(F.coalesce(again, F.lit(False)), F.lit(b"")).otherwise(F.col("payload")).alias("payload"),
        *_DIGEST,
        F.when(again, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        F.when(again, F.col("first_id")).alias("refers_to"),
    )


def chunk_rows(recs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """A row per chunk, at least one per record; the chunks of a record follow one another."""
    n = F.greatest(F.lit(1), F.ceil(F.length("payload") / F.lit(chunk_bytes)).cast("int"))
    numbered = recs.select(
        F.col("page_id").cast("string").alias("page_id"), "url", *_DIGEST, "record_type", F.col("refers_to").cast("string").alias("refers_to"),
        F.length("payload").alias("body_bytes"), n.alias("chunks"), "payload", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_no"),
    )
    cut = F.substring("payload", F.col("chunk_no") * chunk_bytes + 1, F.lit(chunk_bytes))
    return numbered.select("*", cut.alias("chunk"), (F.col("chunk_no") == F.col("chunks") - 1).alias("last")).drop("payload")


def escaped(value: str) -> str:
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def plain(value: str | None) -> str | None:
    return None if value is None else value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def record_id(page_id: str | None, digest: str) -> str:
    """Of a page; a page without an id has a record id of its own."""
    return f"<urn:uuid:{uuid.uuid4() if page_id is None else uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest}')}>"


def _header(page_id, url, payload_bytes, digest, kind, refers_to, body_bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, digest)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {payload_bytes}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + escaped(url))
    if page_id is not None:
        lines.append(f"X-Page-Id: {escaped(page_id)}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-Id: {escaped(refers_to)}"]
    lines.append(f"Content-Length: {body_bytes}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n"


_MEMBER = "path string, start long, length long, page_id string, url string, payload_bytes long, payload_digest string"
_MEMBER_NAMES = [x.split()[0] for x in _MEMBER.split(", ")]
_MEMBER_KINDS = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]


def _member_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(_MEMBER_KINDS)], names=_MEMBER_NAMES)


def _archived(chunks: DataFrame, to: str) -> DataFrame:
    """Write the chunks, an archive per task; a row per member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(to)
        store.create_dir(folder, recursive=True)
        path, out, pack, start, at = f"{folder}/{uuid.uuid4().hex}.warc.gz", None, None, 0, 0
        for batch in batches:
            done = []
            for r in batch.to_pylist():
                out = out or store.open_output_stream(path, compression=None)
                if r["chunk_no"] == 0:
                    pack, start = zlib.compressobj(3, zlib.DEFLATED, 31), at
                    at += out.write(pack.compress(_header(*(r[k] for k in ("page_id", "url", *_DIGEST, "record_type", "refers_to", "body_bytes")))))
                at += out.write(pack.compress(r["chunk"]))
                if r["last"]:
                    at += out.write(pack.compress(b"\r\n\r\n") + pack.flush())
                    done.append((path, start, at - start, r["page_id"], r["url"], r["payload_bytes"], r["payload_digest"]))
            if done:
                yield _member_batch(done)
        if out:
            out.close()

    return checkpointed(chunks.mapInArrow(run, _MEMBER))


def _marked(members: DataFrame, repeated: DataFrame, hot_copies: int, kind) -> DataFrame:
    """members with refers_to, null for responses. Members are rows without payload, so copies of one digest are light."""
    repeated = repeated.withColumnRenamed("payload_digest", "_digest")
    hot = repeated.where(F.col("copies") >= hot_copies).select(F.col("_digest").alias("_hot"), F.col("first_id").alias("hot_id"))
    rest = repeated.where(F.col("copies") < hot_copies).select("_digest", "first_id")
    dealt = members.join(F.broadcast(hot), F.col("payload_digest") == F.col("_hot"), "left").drop("_hot")
    alone = F.col("hot_id").isNotNull() | (F.col("payload_bytes") < LEAST_BYTES)
    dealt = dealt.withColumn("_digest", F.when(alone, F.hex(F.xxhash64("path", "start"))).otherwise(F.col("payload_digest")))
    first = F.coalesce("hot_id", "first_id")
    refers_to = F.when(first < F.col("page_id").cast(kind), first.cast("string"))
    return dealt.join(rest.hint("merge"), "_digest", "left").select(*_MEMBER_NAMES, refers_to.alias("refers_to"))


def _copied(marked: DataFrame, to: str) -> DataFrame:
    """Copy members in pieces, those with refers_to as revisits; a row per member of the new archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(to)
        store.create_dir(folder, recursive=True)
        path, out, at, source, of = f"{folder}/{uuid.uuid4().hex}.warc.gz", None, 0, None, None
        for batch in batches:
            done = []
            for r in batch.to_pylist():
                out, start = out or store.open_output_stream(path, compression=None), at
                if r["refers_to"] is None:
                    if of != r["path"]:
                        if source:
                            source.close()
                        source, of = store.open_input_file(r["path"]), r["path"]
                    source.seek(r["start"])
                    left = r["length"]
                    while left:
                        piece = source.read(min(left, _READ))
                        if not piece:
                            raise ValueError("an archive ends inside a member")
                        at += out.write(piece)
                        left -= len(piece)
                else:
                    head = _header(r["page_id"], r["url"], r["payload_bytes"], r["payload_digest"], "revisit", r["refers_to"], 0)
                    pack = zlib.compressobj(3, zlib.DEFLATED, 31)
                    at += out.write(pack.compress(head + b"\r\n\r\n") + pack.flush())
                done.append((path, start, at - start, r["page_id"], r["url"], r["payload_bytes"], r["payload_digest"]))
            if done:
                yield _member_batch(done)
        if source:
            source.close()
        if out:
            out.close()

    return checkpointed(marked.repartition("path").sortWithinPartitions("path", "start").mapInArrow(run, _MEMBER))


def write(pages: DataFrame, to: str | None = None, *, chunk_bytes: int = CHUNK_BYTES, broadcast_digests: int = BROADCAST_DIGESTS, hot_copies: int = HOT_COPIES) -> DataFrame:
    """Write archives to a folder all executors share; a manifest of (path, records)."""
    spark = pages.sparkSession
    bounded_batches(spark)
    to = to or new_dir(spark, "warc")
    repeated = checkpointed(repeated_digests(pages))
    if repeated.count() <= broadcast_digests:
        members = _archived(chunk_rows(records(pages, repeated), chunk_bytes), to)
    else:
        first = new_dir(spark, "warc-first")
        every = _digested(pages).withColumns({"record_type": F.lit("response"), "refers_to": F.lit(None).cast("string")})
        members = _archived(chunk_rows(every, chunk_bytes), first)
        members = _copied(_marked(members, repeated, hot_copies, pages.schema["page_id"].dataType), to)
        remove(spark, first)
    return members.groupBy("path").agg(F.count("*").alias("records"))


def _plain(source) -> Iterator[bytes]:
    """The decompressed bytes of all gzip members, in bounded pieces."""
    data, member = b"", None
    while True:
        data = data or source.read(_READ)
        if not data:
            return
        member = member or zlib.decompressobj(31)
        piece = member.decompress(data, _READ)
        data = member.unconsumed_tail
        if member.eof:
            data, member = member.unused_data, None
        if piece:
            yield piece


def stream(source, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple]:
    """(headers, chunk_no, chunk, offset, sha256 so far, last) of all records of one archive."""
    pieces, held = _plain(source), b""

    def more(least: int) -> bool:
        nonlocal held
        while len(held) < least:
            piece = next(pieces, None)
            if piece is None:
                return False
            held += piece
        return True

    while more(1):
        while b"\r\n\r\n" not in held:
            if not more(len(held) + 1):
                raise ValueError("an archive ends inside a record header")
        head, _, held = held.partition(b"\r\n\r\n")
        headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        left, digest, offset, k = int(headers["Content-Length"]), hashlib.sha256(), 0, 0
        while True:
            take = min(left, chunk_bytes)
            if not more(take):
                raise ValueError("an archive ends inside a payload")
            chunk, held = held[:take], held[take:]
            digest.update(chunk)
            left -= take
            yield headers, k, chunk, offset, digest.hexdigest(), left == 0
            offset, k = offset + take, k + 1
            if not left:
                break
        if not more(4) or held[:4] != b"\r\n\r\n":
            raise ValueError("a record doesn't end where its length says")
        held = held[4:]


def read(spark, manifest: DataFrame, root: str, *, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunk table of the archives in the manifest."""
    schema = "page_id string, url string, record_type string, refers_to string, header_digest string, payload_bytes long, chunk_no int, chunk binary, offset long, digest_so_far string, last boolean"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.string()] * 5 + [pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.string(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(root)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with store.open_input_stream(path, compression=None) as source:
                    rows, size = [], 0
                    for h, k, chunk, offset, digest, last in stream(source, chunk_bytes):
                        rows.append((plain(h.get("X-Page-Id")), plain(h.get("WARC-Target-URI")), h["WARC-Type"], plain(h.get("X-Refers-To-Page-Id")), h["WARC-Payload-Digest"].removeprefix("sha256:"), int(h["X-Payload-Length"]), k, chunk, offset, digest, last))
                        size += len(chunk) + 200
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)

    n = manifest.count()
    return manifest.repartition(max(1, n)).mapInArrow(run, schema)


def round_trip(pages: DataFrame, *, chunk_bytes: int = CHUNK_BYTES, **parameters) -> DataFrame:
    """Write the pages, read the archives back: one row per record, from its last chunk.

    A revisit has no body of its own, so its digest and length are those of its header; a
    response's are the ones computed while reading.
    """
    spark = pages.sparkSession
    to = new_dir(spark, "warc")
    chunks = read(spark, write(pages, to, chunk_bytes=chunk_bytes, **parameters), to, chunk_bytes=chunk_bytes)
    kind = pages.schema["page_id"].dataType
    response = F.col("record_type") == "response"
    return chunks.where("last").select(
        F.col("page_id").cast(kind).alias("page_id"),
        F.when(response, F.col("offset") + F.length("chunk")).otherwise(F.col("payload_bytes")).cast("long").alias("payload_bytes"),
        F.when(response, F.col("digest_so_far")).otherwise(F.col("header_digest")).alias("payload_digest"),
        "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
    )
