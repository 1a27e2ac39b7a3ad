"""Byte-level BPE encoding over a corpus-wide table of distinct words, and decoding through an id-to-piece join.

Encoding. Texts are cut into words at places no token crosses (``SpacedWords``). A chunk of documents (about 16 MB of
text) keeps, per document, the positions of its words as codes into the chunk's own word list; that table is written once,
bucketed by chunk. The words go, packed by hash bucket, to the task that owns the bucket; it keeps the bucket's distinct
words, encodes each of them once, with the tokenizers library, and answers every chunk. A task holds the distinct words of
one bucket, so their number follows ``n_buckets``. The answers join back by chunk, and the codes
turn into ids by position. What moves is words and answers, never positions or texts; a word moves once per chunk that
holds it, so a very frequent word is no hot key, and nothing is broadcast.

Decoding. The id-to-piece table has one row for each id of the vocabulary file, so its size is bounded by the file; it
is joined to the ids in Arrow columns within each task, pieces are concatenated by position and read as UTF-8.

Null text counts as empty and encodes to no ids. A null doc_id passes through. Repeated rows are encoded each; an empty
table gives an empty result; further columns are ignored. Ids that no piece has are skipped in decoding.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casebook.llm.common import SpacedWords, doc_text, gather, hf_ids, lists, merged, public_vocabulary, ragged, text_chunks, word_hashes
from casebook.session import new_path

CHUNK_TEXT = 12 << 20
CODED = "chunk long, doc_ids array<long>, offsets binary, codes binary, owners binary, sent array<struct<bucket:int,words:binary>>"


def _pack(a: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(a).tobytes(), 3)


def _unpack(b: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(b), dtype=dtype)


def pack_planes(codes: np.ndarray) -> bytes:
    """Non-negative integers below 2^32 as four byte planes, each of which packs well when small codes are frequent."""
    return _pack(np.ascontiguousarray(codes.astype("<u4")).view(np.uint8).reshape(-1, 4).T)


def unpack_planes(b: bytes) -> np.ndarray:
    planes = _unpack(b, np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1).astype(np.int64)


def pack_words(words: pa.Array) -> bytes:
    raw = words.cast(pa.large_binary())
    return zstandard.compress(np.uint32(len(raw)).tobytes() + pc.binary_length(raw).cast(pa.uint32()).to_numpy(zero_copy_only=False).tobytes() + b"".join(raw.to_pylist()), 3)


def unpack_words(b: bytes) -> pa.Array:
    raw = zstandard.decompress(b)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    offsets = np.zeros(n + 1, dtype=np.int64)
    np.cumsum(np.frombuffer(raw, "<u4", n, 4), out=offsets[1:])
    return pa.LargeStringArray.from_buffers(n, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw[4 + 4 * n :] or b"\0"))


def _code_chunks(n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count = TaskContext.get().partitionId(), 0
        for chunk in text_chunks(merged(batches, "text", CHUNK_TEXT), limit=2 * CHUNK_TEXT):
            spaced = SpacedWords(chunk.column("text"))
            rank = np.argsort(-np.bincount(spaced.codes, minlength=len(spaced.words)), kind="stable")
            renamed = np.empty(len(rank), dtype=np.int64)
            renamed[rank] = np.arange(len(rank))
            words = spaced.words.take(pa.array(rank))
            owner = (word_hashes(words) % np.uint64(n_buckets)).astype(np.int32)
            order = np.argsort(owner, kind="stable")
            cuts = np.searchsorted(owner[order], np.arange(n_buckets + 1))
            sorted_words = words.take(pa.array(order))
            sent = [{"bucket": b, "words": pack_words(sorted_words.slice(cuts[b], cuts[b + 1] - cuts[b]))} for b in range(n_buckets) if cuts[b + 1] > cuts[b]]
            yield pa.RecordBatch.from_pydict(
                {
                    "chunk": pa.array([(part << 24) + count], pa.int64()),
                    "doc_ids": pa.array([chunk.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                    "offsets": pa.array([_pack(spaced.offsets)], pa.binary()),
                    "codes": pa.array([pack_planes(renamed[spaced.codes])], pa.binary()),
                    "owners": pa.array([_pack(owner)], pa.binary()),
                    "sent": pa.array([sent], pa.list_(pa.struct([("bucket", pa.int32()), ("words", pa.binary())]))),
                }
            )
            count += 1

    return run


def _answer(path: str):
    """For each packet of words: the ids of the words, in the packet's order; every distinct word of a bucket once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}  # place of a word in the ragged array
        ids, offsets = np.zeros(0, np.int32), np.zeros(1, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            packets = [unpack_words(p.as_py()).to_pylist() for p in batch.column("words")]
            new = [k for k in dict.fromkeys(w for p in packets for w in p) if k not in known]
            known.update(zip(new, range(len(known), len(known) + len(new))))
            more, ends = hf_ids(pa.array(new, pa.large_string()), path)
            ids, offsets = np.concatenate([ids, more]), np.concatenate([offsets, offsets[-1] + ends[1:]])
            answers = []
            for p in packets:
                own, ends = gather(ids, offsets, np.fromiter((known[k] for k in p), np.int64, len(p)))
                answers.append(zstandard.compress(np.uint32(len(p)).tobytes() + np.diff(ends).astype("<u4").tobytes() + own.astype("<u4").tobytes(), 3))
            yield pa.RecordBatch.from_pydict({"chunk": batch.column("chunk"), "bucket": batch.column("bucket"), "ids": pa.array(answers, pa.binary())})

    return run


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            owner = _unpack(batch.column("owners")[row].as_py(), np.int32)
            by_bucket: list[np.ndarray] = []
            sizes: list[np.ndarray] = []
            for answer in sorted(batch.column("answers")[row].as_py() or [], key=lambda a: a["bucket"]):
                raw = zstandard.decompress(answer["ids"])
                n = int(np.frombuffer(raw, "<u4", 1)[0])
                sizes.append(np.frombuffer(raw, "<u4", n, 4))
                by_bucket.append(np.frombuffer(raw, "<u4", -1, 4 + 4 * n))
            order = np.argsort(owner, kind="stable")  # as the words were sent
            place = np.empty(len(order), dtype=np.int64)
            place[order] = np.arange(len(order))
            offsets = np.zeros(len(order) + 1, dtype=np.int64)
            np.cumsum(np.concatenate(sizes) if sizes else [], out=offsets[1:])
            codes = unpack_planes(batch.column("codes")[row].as_py())
            ids, ends = gather(np.concatenate(by_bucket).astype(np.int32), offsets, place[codes])
            starts = ends[_unpack(batch.column("offsets")[row].as_py(), np.int64)]
            doc_ids = batch.column("doc_ids")[row].values
            for a in range(0, len(doc_ids), 500):  # smaller batches for what follows
                b = min(a + 500, len(doc_ids))
                yield pa.RecordBatch.from_pydict({"doc_id": doc_ids.slice(a, b - a), "ids": lists(ids[starts[a] : starts[b]], starts[a : b + 1] - starts[a])})


def chained(*steps):
    """Arrow steps one after another within one Python worker: a worker per step would hold its own memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps:
            batches = step(batches)
        yield from batches

    return run


def encode(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text", n_buckets: int | None = None, then: tuple = (), schema: str = "doc_id long, ids array<int>") -> DataFrame:
    """``(doc_id, ids array<int>)`` for every row, as the tokenizers library encodes the whole text with the file at
    ``path`` (``byte_bpe_50k.json`` of the public tokenizers unless given) and ``add_special_tokens=False``.

    The tokenizer must be a byte-level BPE whose pre-tokenizer attaches a space to the word behind it and adds no
    prefix space; anything else is refused. ``n_buckets``: tasks that share the distinct words (the session's number
    of shuffle partitions unless given). ``then``: Arrow steps for the encoded rows that are to run in the same Python
    workers, such as ``decoder`` and ``digester``; ``schema`` is what the last one yields.
    """
    path = path or public_vocabulary("byte_bpe_50k.json")
    check_cuttable(path)
    spark = docs.sparkSession
    n = n_buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = doc_text(docs, doc_id, text)
    coded = rows.mapInArrow(_code_chunks(n), CODED)
    place = new_path(spark, "coded")
    name = "coded_" + place.rpartition("-")[2]
    coded.write.format("parquet").option("path", place).option("compression", "zstd").bucketBy(n, "chunk").saveAsTable(name)
    stored = spark.table(name)
    packets = stored.select("chunk", F.explode("sent").alias("s")).select("chunk", "s.bucket", "s.words").repartitionById(n, "bucket")
    answers = packets.mapInArrow(_answer(path), "chunk long, bucket int, ids binary")
    per_chunk = answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "ids")).alias("answers"))
    joined = stored.select("chunk", "doc_ids", "offsets", "codes", "owners").join(per_chunk, "chunk", "left")
    return joined.mapInArrow(chained(_assemble, *then), schema)


def check_cuttable(path: str) -> None:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        raise ValueError("encode needs a byte-level BPE without normalizer and without prefix space")
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["content"].find(" ") > 0 for t in spec.get("added_tokens", [])):
        raise ValueError("special tokens that look at their surroundings can't be cut out word by word")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of a byte-level vocabulary: printable Latin-1 stands for itself, the other bytes, in
    order, for the code points from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def piece_rows(path: str) -> list[tuple[int, bytes]]:
    """Every id of a vocabulary file with its bytes; an added token's bytes are its own text."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    table = byte_alphabet()
    rows = {i: bytes(table[c] for c in piece) for piece, i in spec["model"]["vocab"].items()}
    rows |= {t["id"]: t["content"].encode() for t in spec.get("added_tokens", [])}
    return sorted(rows.items())


def decoder(spark: SparkSession, path: str | None = None, keep: tuple[str, ...] = ("doc_id",), ids: str = "ids"):
    """The Arrow step of ``decode``. The id-to-piece table is broadcast; it has as many rows as the vocabulary file."""
    pieces = piece_rows(path or public_vocabulary("byte_bpe_50k.json"))
    top = pieces[-1][0] if pieces else -1
    by_id: list[bytes] = [b""] * (top + 2)  # the last one stands for ids without a piece
    for i, piece in pieces:
        by_id[i] = piece
    shared = spark.sparkContext.broadcast(by_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.array(shared.value, pa.large_binary())
        for batch in batches:
            column = pc.fill_null(batch.column(ids), pa.scalar([], batch.column(ids).type))
            flat = pc.list_flatten(column).to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False))]).astype(np.int64)
            joined = table.take(pa.array(np.where((flat >= 0) & (flat <= top), flat, top + 1)))
            starts = np.frombuffer(joined.buffers()[1], np.int64, len(joined) + 1) if len(joined) else np.zeros(1, np.int64)
            data = memoryview(joined.buffers()[2]) if len(joined) and joined.buffers()[2] else memoryview(b"")
            texts = [bytes(data[starts[a] : starts[b]]).decode("utf-8", "replace") for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_pydict({k: batch.column(k) for k in keep} | {"ids": batch.column(ids), "text": pa.array(texts, pa.string())})

    return run


def decode(encoded: DataFrame, path: str | None = None, keep: tuple[str, ...] = ("doc_id",), ids: str = "ids") -> DataFrame:
    """``keep`` columns, the ids, and ``text``: the pieces of ``ids`` joined by position and read as UTF-8, ill-formed
    bytes replaced, special tokens kept. Null ids give an empty text."""
    kinds = ", ".join(f"`{k}` {encoded.schema[k].dataType.simpleString()}" for k in keep)
    return encoded.select(*keep, F.col(ids)).mapInArrow(decoder(encoded.sparkSession, path, keep, ids), f"{kinds}, ids array<int>, text string")


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digester(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The Arrow step from rows of ``decode`` to ``DIGESTS``."""
    for batch in batches:
        column = batch.column("ids")
        flat = pc.list_flatten(column).to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False))]).astype(np.int64)
        distinct, where = np.unique(flat, return_inverse=True)
        numbers, offsets = ragged([list(b"%d," % i) for i in distinct.tolist()])
        shown, cuts = gather(numbers.astype(np.uint8), offsets, where)
        raw = memoryview(shown.tobytes())
        ids_sha = [hashlib.sha256(raw[cuts[a] : max(cuts[a], cuts[b] - 1)]).hexdigest() for a, b in zip(ends, ends[1:])]
        text_sha = [hashlib.sha256(t.encode()).hexdigest() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_tokens": pa.array(np.diff(ends)), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(text_sha, pa.string())})
