"""Token ids in training order, as binary shards of fixed stride.

Texts are tokenised with a public byte-level BPE vocabulary, an end-of-text id follows each, and
every document is cut into sequences of ``length`` ids. The sequences are written once to the
shared folder with the number of their write task and their place in it; with the counts per task
that gives each sequence an index in 0..N-1 that no later retry can change. A keyed Feistel
permutation, walked until it lands below N (cycle-walking), turns the index into the sequence's
global slot. With weights the index and the permutation are those of the sequence's source, and the
permuted sequences of every source are dealt, in blocks of ``block``, into the slots by the mixing
schedule (``mixing.schedule``): any stretch of slots holds the sources by their weights, within two
blocks of each, as long as none has run out. That doesn't rest on the order in which rows are read.
The driver makes the schedule and sends a start (8 bytes) per block. Shard s holds the slots from s * per_shard on. Sequences travel to their shard in packs, those
of one batch and shard compressed together, and a task writes one shard at a time, in slot order, each record ``stride`` bytes long:

    4 bytes number of ids, 4 bytes CRC-32 of the ids as stored, then ``length`` ids of 2 bytes,
    unused ones 0xFFFF; little-endian

so the record of a slot lies at (slot - s * per_shard) * stride of its shard, and reading can go on
from any slot. A shard is written under a name of its own and moved into place when complete. What is
returned is read from a table of the shards' contents; the stored sequences are deleted.

Defined results: a null or empty text is one sequence holding only the end-of-text id; repeated
rows are sequences of their own; a null doc_id stays null; an empty table writes no shard; other
columns are ignored.
"""

from __future__ import annotations

import base64
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkverity.llm.common import bounded_batches, new_dir, remove, stored
from sparkverity.llm.mixing import BLOCK_DOCS, block_size, schedule, source_key

#: For text in many languages; any other byte-level vocabulary of under 65,535 ids will do.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: how the public 50k vocabulary splits text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LENGTH = 256
PER_SHARD = 65_536
ZSTD_LEVEL = 9
HEADER = 8
UNUSED = 0xFFFF
ROUNDS = 6
#: Counts of up to so many write tasks (16 bytes each) are sent to all tasks; of more they are joined by shuffle.
BROADCAST_TASKS = 500_000
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def encoder(path: str = VOCABULARY):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    if len(ranks) >= UNUSED:
        raise ValueError("ids of this vocabulary don't fit two bytes")
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), len(ranks)


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    x = x + np.uint64(key)
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def round_keys(key: int) -> list[int]:
    rng = np.random.default_rng(key)
    return [int(k) for k in rng.integers(0, 1 << 63, ROUNDS, dtype=np.int64)]


def feistel(index: np.ndarray, total: int, key: int, *, back: bool = False) -> np.ndarray:
    """The slot of each index (or, back, the index of each slot): a permutation of 0..total-1."""
    half = max(1, (max(1, total - 1).bit_length() + 1) // 2)
    mask, shift, keys = np.uint64((1 << half) - 1), np.uint64(half), round_keys(key)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & mask
        for k in reversed(keys) if back else keys:
            if back:
                left, right = right ^ (_mixed(left, k) & mask), left
            else:
                left, right = right, left ^ (_mixed(right, k) & mask)
        return (left << shift) | right

    out = once(index.astype(np.uint64))
    while (outside := out >= np.uint64(total)).any():
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def sequences(docs: DataFrame, *, by_source: bool = False, length: int = LENGTH, vocabulary: str = VOCABULARY) -> tuple[DataFrame, dict[str, int], str]:
    """The stored sequences (part, doc_id, chunk, n_tokens, payload) with their index within the part, and
    how many each part has, and the path they are stored at. A part is a source, or else all there is."""
    spark = docs.sparkSession
    bounded_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, end = encoder(vocabulary)
        task, place = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            ids, parts = batch.column("doc_id"), batch.column("part")
            at, chunks, sizes, payloads, places = [], [], [], [], []
            for k, (text, part) in enumerate(zip(batch.column("text").to_pylist(), parts.to_pylist(), strict=True)):
                tokens = np.array([*(encode.encode_ordinary(text) if text else ()), end], np.uint16)
                for chunk, start in enumerate(range(0, len(tokens), length)):
                    own = tokens[start : start + length]
                    at.append(k)
                    chunks.append(chunk)
                    sizes.append(len(own))
                    payloads.append(own.tobytes())
                    places.append(place[part])
                    place[part] += 1
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(at, pa.int64())), parts.take(pa.array(at, pa.int64())), pa.array(chunks, pa.int32()), pa.array(sizes, pa.int32()), pa.array(payloads, pa.binary()),
                 pa.array([task] * len(at), pa.int32()), pa.array(places, pa.int64())],
                names=["doc_id", "part", "chunk", "n_tokens", "payload", "task", "place"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    parted = docs.select("doc_id", "text", (source_key(F.col("source")) if by_source else F.lit("")).alias("part"))
    rows, path = stored(parted.mapInArrow(run, f"doc_id {kind}, part string, chunk int, n_tokens int, payload binary, task int, place long"), "tokens", level=ZSTD_LEVEL)
    counts = rows.groupBy("part", "task").agg(F.count("*").alias("n"))
    before = counts.select("part", "task", (F.sum("n").over(Window.partitionBy("part").orderBy("task")) - F.col("n")).alias("before"))  # a row per part and write task
    sums = {r.part: r for r in counts.groupBy("part").agg(F.sum("n").alias("total"), F.count("*").alias("tasks")).collect()}
    before = F.broadcast(before) if sum(r.tasks for r in sums.values()) <= BROADCAST_TASKS else before.hint("merge")
    return rows.join(before, ["part", "task"]).select(
        "part", "doc_id", "chunk", "n_tokens", "payload", (F.col("before") + F.col("place")).alias("index")
    ), {k: r.total for k, r in sums.items()}, path


def starts(totals: dict[str, int], weights: dict[str, float] | None, block: int) -> dict[str, np.ndarray]:
    """Per part the first slot of each of its blocks."""
    parts = sorted(totals)
    if len(parts) < 2:
        return {k: np.arange(0, totals[k], block) for k in parts}  # at most MOST_BLOCKS
    slots = schedule([-(-totals[k] // block) for k in parts], [weights[k] for k in parts])
    sizes = np.full(sum(map(len, slots)), block)
    for k, own in zip(parts, slots, strict=True):
        sizes[own[-1]] = totals[k] - (len(own) - 1) * block
    first = np.cumsum(sizes) - sizes
    return {k: first[own] for k, own in zip(parts, slots, strict=True)}


def stride(length: int = LENGTH) -> int:
    return HEADER + 2 * length


def record(payload: bytes, length: int = LENGTH) -> bytes:
    return (len(payload) // 2).to_bytes(4, "little") + zlib.crc32(payload).to_bytes(4, "little") + payload + b"\xff\xff" * (length - len(payload) // 2)


def read_slot(store: fs.FileSystem, folder: str, slot: int, *, length: int = LENGTH, per_shard: int = PER_SHARD) -> np.ndarray:
    """The ids in one slot, by position alone."""
    with store.open_input_file(f"{folder}/shard-{slot // per_shard:08d}.bin") as f:
        raw = f.read_at(stride(length), slot % per_shard * stride(length))
    n = int.from_bytes(raw[:4], "little")
    payload = raw[HEADER : HEADER + 2 * n]
    if zlib.crc32(payload) != int.from_bytes(raw[4:8], "little"):
        raise ValueError(f"slot {slot} is damaged")
    return np.frombuffer(payload, "<u2")


def materialise(
    docs: DataFrame, to: str | None = None, *, weights: dict[str, float] | None = None, key: int = 2024, length: int = LENGTH,
    per_shard: int = PER_SHARD, block: int = BLOCK_DOCS, vocabulary: str = VOCABULARY,
) -> DataFrame:
    """Write the shards; a row per sequence: slot, doc_id, chunk, n_tokens, shard, byte_offset and crc32.
    weights: of every source_key; without, all slots are one permutation."""
    spark = docs.sparkSession
    to = to or new_dir(spark, "shards")
    rows, totals, path = sequences(docs, by_source=weights is not None, length=length, vocabulary=vocabulary)
    block = block_size(sum(totals.values()), block)
    sent = spark.sparkContext.broadcast(starts(totals, weights, block))

    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["shard", "slots", "doc_ids", "chunks", "sizes", "pack"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", ZSTD_LEVEL)
        for batch in batches:
            index, parts = batch.column("index").to_numpy(), batch.column("part").dictionary_encode()
            own, slot = parts.indices.to_numpy(), np.zeros(len(index), np.int64)
            for k, part in enumerate(parts.dictionary.to_pylist()):
                here = own == k
                turn = feistel(index[here], totals[part], key ^ zlib.crc32(part.encode()))
                slot[here] = sent.value[part][turn // block] + turn % block
            order = np.argsort(slot, kind="stable")
            slot, batch = slot[order], batch.take(pa.array(order))
            edges = np.concatenate([np.unique(slot // per_shard, return_index=True)[1], [len(slot)]]).astype(np.int32)
            payload = batch.column("payload").to_pylist()
            packs = [codec.compress(b"".join(payload[a:b]), asbytes=True) for a, b in zip(edges, edges[1:], strict=False)]
            lists = [pa.ListArray.from_arrays(pa.array(edges), x) for x in (pa.array(slot), *(batch.column(c) for c in ("doc_id", "chunk", "n_tokens")))]
            yield pa.RecordBatch.from_arrays([pa.array(slot[edges[:-1]] // per_shard), *lists, pa.array(packs, pa.binary())], names=names)

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        store, folder = fs.FileSystem.from_uri(to)
        store.create_dir(folder, recursive=True)
        codec, rows = pa.Codec("zstd"), []
        for r in pdf.itertuples():
            plain, at = codec.decompress(r.pack, 2 * int(sum(r.sizes)), asbytes=True), 0
            for slot, doc_id, chunk, n in zip(r.slots, r.doc_ids, r.chunks, r.sizes, strict=True):
                rows.append((int(slot), doc_id, chunk, n, plain[at : at + 2 * n]))
                at += 2 * n
        rows.sort(key=lambda t: t[0])
        shard, draft = int(pdf["shard"].iloc[0]), f"{folder}/draft-{uuid.uuid4().hex}"
        with store.open_output_stream(draft, compression=None) as out:
            for r in rows:
                out.write(record(r[4], length))
        store.move(draft, f"{folder}/shard-{shard:08d}.bin")
        return pd.DataFrame({
            "slot": [r[0] for r in rows], "doc_id": pd.Series([r[1] for r in rows], dtype=object), "chunk": [r[2] for r in rows], "n_tokens": [r[3] for r in rows],
            "shard": shard, "byte_offset": [r[0] % per_shard * stride(length) for r in rows], "crc32": [zlib.crc32(r[4]) for r in rows],
        })

    packed = rows.mapInArrow(place, f"shard long, slots array<long>, doc_ids array<{kind}>, chunks array<int>, sizes array<int>, pack binary")
    written = packed.groupBy("shard").applyInPandas(write, f"slot long, doc_id {kind}, chunk int, n_tokens int, shard long, byte_offset long, crc32 long")
    try:
        return stored(written, "slots", level=ZSTD_LEVEL)[0]
    finally:
        remove(spark, path)
