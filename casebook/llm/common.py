"""Shared helpers of the training-data operators: input columns, word splitting, tokenising by distinct words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of ``sf_dir``. From here on Arrow batches are bounded by bytes, as texts vary a lot in length."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_text(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Only ``(doc_id, text)``; a null text counts as empty. Other columns, whatever their names, are left behind."""
    return docs.select(docs[doc_id].cast("long").alias("doc_id"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"))


def text_chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a chunk holds at most ``limit`` bytes of text, or a single row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, upto - at)
            at = upto
            pa.default_memory_pool().release_unused()


def merged(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Join Arrow batches until they hold ``limit`` bytes of text."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += pc.sum(pc.binary_length(batch.column(column))).as_py() or 0
        if size >= limit:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def lists(flat: np.ndarray | pa.Array, offsets: np.ndarray) -> pa.LargeListArray | pa.ListArray:
    """A list array over ``flat`` with the given offsets (32-bit where they fit, as Spark expects)."""
    values = flat if isinstance(flat, pa.Array) else pa.array(flat)
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)


def gather(values: np.ndarray, offsets: np.ndarray, take: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows ``take`` of the ragged array (values, offsets), one after another: their values and new offsets."""
    sizes = np.diff(offsets)[take]
    out = np.zeros(len(take) + 1, dtype=np.int64)
    np.cumsum(sizes, out=out[1:])
    index = np.arange(out[-1]) + np.repeat(offsets[:-1][take] - out[:-1], sizes)
    return values[index], out


# ---------------------------------------------------------------- words at which a byte-level tokenizer may be cut


class SpacedWords:
    """A column of texts cut before every single space that a non-space follows.

    A byte-level BPE with the usual pattern never forms a token over such a place, because the space begins a new
    pre-token; so a text's ids are its words' ids in a row. Texts with runs of white space or with a space before
    other white space are cut by the general rule, the rest by a plain split. ``words`` are the distinct words,
    ``codes`` says which word stands where, ``offsets`` where each text begins in ``codes``.
    """

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_string())
        parts = pc.split_pattern(texts, " ")
        offsets = parts.offsets.to_numpy().astype(np.int64)
        offsets = offsets - offsets[0]
        coded = parts.flatten().dictionary_encode()
        inner = coded.indices.to_numpy().astype(np.int64)
        words = coded.dictionary
        first = np.zeros(len(inner), dtype=bool)
        first[offsets[:-1]] = True  # every text has a first part, if only an empty one
        # a later part that is empty or begins with white space may not be cut off from what stands before it
        odd_word = pc.or_(pc.equal(pc.binary_length(words), 0), pc.utf8_is_space(pc.utf8_slice_codeunits(words, 0, 1))).to_numpy(zero_copy_only=False)
        odd = odd_word[inner] & ~first if len(inner) else first
        if odd.any():
            rows = np.unique(np.searchsorted(offsets, np.flatnonzero(odd), side="right") - 1)
            self._general(texts, rows, offsets, inner, words, first)
        else:
            self._set(words, inner, first, offsets)

    def _set(self, words: pa.Array, inner: np.ndarray, first: np.ndarray, offsets: np.ndarray) -> None:
        later, first_codes = np.unique(inner[~first]), np.unique(inner[first])
        place = np.zeros((2, max(1, len(words))), dtype=np.int64)
        place[0, later] = np.arange(len(later))
        place[1, first_codes] = len(later) + np.arange(len(first_codes))
        spaced = pc.binary_join_element_wise(pa.array([""] * len(later), pa.large_string()), words.take(pa.array(later)), pa.scalar(" ", pa.large_string()))
        self.words = pa.concat_arrays([spaced, words.take(pa.array(first_codes))])
        self.codes, self.offsets = place[first.astype(np.int64), inner], offsets

    def _general(self, texts, rows, offsets, inner, words, first) -> None:
        import re

        cut = re.compile(r"(?= \S)")
        pieces = {int(r): [w for w in cut.split(texts[int(r)].as_py()) if w] or [""] for r in rows}
        flat: list[str] = []
        sizes = np.diff(offsets)
        keep = np.ones(len(inner), dtype=bool)
        for r, ws in pieces.items():
            keep[offsets[r] : offsets[r + 1]] = False
            sizes[r] = len(ws)
            flat += ws
        plain = SpacedWords.__new__(SpacedWords)
        kept_offsets = np.concatenate([[0], np.cumsum(np.where(np.isin(np.arange(len(sizes)), rows), 0, np.diff(offsets)))])
        plain._set(words, inner[keep], first[keep], kept_offsets)
        extra = pa.array(flat, pa.large_string()).dictionary_encode()
        both = pa.concat_arrays([plain.words, extra.dictionary]).dictionary_encode()
        renamed = both.indices.to_numpy().astype(np.int64)
        self.words = both.dictionary
        new_offsets = np.concatenate([[0], np.cumsum(sizes)])
        codes = np.empty(new_offsets[-1], dtype=np.int64)
        is_general = np.repeat(np.isin(np.arange(len(sizes)), rows), sizes)
        codes[~is_general] = renamed[plain.codes]
        codes[is_general] = renamed[len(plain.words) + extra.indices.to_numpy().astype(np.int64)]
        self.codes, self.offsets = codes, new_offsets


_TOKENIZERS: dict[tuple[str, str], object] = {}


def hf_tokenizer(path: str):
    """The tokenizers library's tokenizer of a file, loaded once per Python worker; no truncation, no padding."""
    if ("hf", path) not in _TOKENIZERS:
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(path)
        made.no_truncation()
        made.no_padding()
        _TOKENIZERS["hf", path] = made
    return _TOKENIZERS["hf", path]


def rank_tokenizer(path: str, pattern: str):
    """tiktoken's reading of a rank file, loaded once per Python worker."""
    if ("rank", path) not in _TOKENIZERS:
        import base64

        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _TOKENIZERS["rank", path] = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _TOKENIZERS["rank", path]


def public_vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def ragged(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.zeros(len(rows) + 1, dtype=np.int64)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    flat = np.fromiter((x for r in rows for x in r), dtype=np.int32, count=int(offsets[-1]))
    return flat, offsets


def hf_ids(words: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each word by the tokenizers library, as a ragged array."""
    tok = hf_tokenizer(path)
    parts, offsets = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
    for at in range(0, len(words), 2_000):  # few of the library's own objects at a time
        flat, ends = ragged([e.ids for e in tok.encode_batch_fast(words.slice(at, 2_000).to_pylist(), add_special_tokens=False)])
        parts.append(flat)
        offsets.append(ends[1:] + offsets[-1][-1])
    return np.concatenate(parts), np.concatenate(offsets)


def byte_bpe_ids(words: pa.Array, json_path: str | None = None, rank_path: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each word as the tokenizers library gives them for ``json_path``.

    Words without the start of a special token go through tiktoken's rank file of the same vocabulary, which gives the
    same ids several times faster (the tests hold the two equal); the others go through the tokenizers library.
    """
    import public_tokenizers

    json_path = json_path or public_vocabulary("byte_bpe_50k.json")
    fast = rank_tokenizer(rank_path or public_vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    special = pc.match_substring(words, "<|").to_numpy(zero_copy_only=False)
    if not special.any():
        return rank_ids(words, fast)
    tok, where = hf_tokenizer(json_path), np.flatnonzero(special)
    plain, plain_ends = rank_ids(words.filter(pa.array(~special)), fast)
    other, other_ends = ragged([tok.encode(w, add_special_tokens=False).ids for w in words.take(pa.array(where)).to_pylist()])
    return _interleave(special, plain, plain_ends, other, other_ends)


def _interleave(second: np.ndarray, a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One ragged array whose rows come in turn from two: from the second where ``second`` says so."""
    place = np.empty(len(second), dtype=np.int64)
    place[~second] = np.arange(len(a_ends) - 1)
    place[second] = len(a_ends) - 1 + np.arange(len(b_ends) - 1)
    return gather(np.concatenate([a, b]), np.concatenate([a_ends, a_ends[-1] + b_ends[1:]]), place)


def rank_ids(words: pa.Array, fast) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each word by a tiktoken encoding without special tokens, as a ragged array.

    Words that begin with a space and a non-space are encoded many at a time, one behind the other: no token crosses
    such a place, so the tokens' lengths in bytes tell where each word ends. The others are encoded one by one.
    """
    words = words.cast(pa.large_string())
    flowing = pc.and_(pc.starts_with(words, " "), pc.and_(pc.greater(pc.utf8_length(words), 1), pc.invert(pc.utf8_is_space(pc.utf8_slice_codeunits(words, 1, 2))))).to_numpy(zero_copy_only=False)
    lengths = _piece_lengths(fast)
    inside = words.filter(pa.array(flowing))
    ends = np.cumsum(pc.binary_length(inside).to_numpy(zero_copy_only=False)).astype(np.int64)
    raw = inside.to_pylist()
    flat, cuts, a = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)], 0
    while a < len(raw):  # about 256 KB at a time
        base = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, base + (256 << 10), side="right")))
        ids = np.asarray(fast.encode_to_numpy("".join(raw[a:b]), disallowed_special=())).astype(np.int32)
        reached = base + np.cumsum(lengths[ids])
        at = np.searchsorted(reached, ends[a:b], side="right")
        if not np.array_equal(reached[at - 1], ends[a:b]):
            raise ValueError("a token crosses the border of two words: the pattern does not keep a space with the word behind it")
        flat.append(ids)
        cuts.append(cuts[-1][-1] + at)
        a = b
    some, some_ends = np.concatenate(flat), np.concatenate(cuts)
    if flowing.all():
        return some, some_ends
    rest, rest_ends = ragged([fast.encode_ordinary(w) for w in words.filter(pa.array(~flowing)).to_pylist()])
    return _interleave(~flowing, some, some_ends, rest, rest_ends)


_LENGTHS: dict[int, np.ndarray] = {}


def _piece_lengths(fast) -> np.ndarray:
    if id(fast) not in _LENGTHS:
        ranks = fast._mergeable_ranks
        out = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        out[np.fromiter(ranks.values(), np.int64, len(ranks))] = np.fromiter(map(len, ranks), np.int64, len(ranks))
        _LENGTHS[id(fast)] = out
    return _LENGTHS[id(fast)]


def encode_column(texts: pa.Array, json_path: str | None = None, rank_path: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Byte-level BPE ids of every text of a column, as a ragged array; each distinct word is encoded once."""
    spaced = SpacedWords(texts)
    word_ids, word_offsets = byte_bpe_ids(spaced.words, json_path, rank_path)
    ids, ends = gather(word_ids, word_offsets, spaced.codes)
    return ids, ends[spaced.offsets]


# ---------------------------------------------------------------- plain words


def plain_words(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of every text: distinct words, their codes in order, offsets of the texts."""
    texts = texts.cast(pa.large_string())
    for white in "\t\n\x0b\x0c\r":
        texts = pc.replace_substring(texts, white, " ")
    parts = pc.split_pattern(texts, " ")
    coded = parts.flatten().dictionary_encode()
    words, codes, offsets = coded.dictionary, coded.indices.to_numpy().astype(np.int64), parts.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    if lower and len(words):
        # the distinct words are an array of their own: ascii_lower misreads slices of large strings that begin inside a buffer
        again = pc.ascii_lower(words).dictionary_encode()
        words, codes = again.dictionary, again.indices.to_numpy().astype(np.int64)[codes]
    real = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    keep = real[codes] if len(codes) else np.zeros(0, dtype=bool)
    if keep.all():
        return words, codes, offsets
    counted = np.concatenate([[0], np.cumsum(keep)])
    return words, codes[keep], counted[offsets]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (xor-shift and odd multipliers)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word that is the same in every process."""
    from pandas.util import hash_array

    return hash_array(words.to_numpy(zero_copy_only=False).astype(object), categorize=False) if len(words) else np.zeros(0, dtype=np.uint64)


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of equal keys out of a stream that is sorted by them; holds one group at a time."""
    held: list[pa.RecordBatch] = []
    held_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:]):
            key = tuple(c[a] for c in columns)
            if held and key != held_key:
                yield pa.Table.from_batches(held)
                held = []
            held_key = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)
