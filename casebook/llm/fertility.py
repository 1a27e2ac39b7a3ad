"""Quality rules from tokeniser fertility.

Public vocabularies say how foreign a text is to ordinary writing: characters per token (byte-level BPE), the share of
tokens that fall back to single bytes (a sentence-piece BPE with byte fallback), and the entropy of the text's tokens.
Each measure has a band per language, or per script where the language has none; a text outside a band is rejected.
Entropy is compared with what a text of that many tokens can reach, so short texts are not rejected for being short.

Everything is counted per distinct word of a chunk of documents and summed per document; documents are independent, so
nothing is shuffled. Bands are parameters; the defaults below are wide, since a filter should keep clean text.

Null or empty text has no words and fails the base rule, as does every text below ``min_words``. Null ids and repeated
rows are measured like others; an empty table gives an empty result; further columns are ignored. A null or unknown
language falls back to the script of most letters, and that to ``other``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.llm.common import gather, mix64, plain_words, public_vocabulary, ragged, rank_ids, rank_tokenizer, text_chunks

#: Letters by script, as ranges of code points.
SCRIPTS = {"latin": r"[A-Za-z\x{C0}-\x{24F}]", "cyrillic": r"[\x{400}-\x{52F}]", "greek": r"[\x{370}-\x{3FF}]", "arabic": r"[\x{600}-\x{6FF}]", "devanagari": r"[\x{900}-\x{97F}]", "cjk": r"[\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{AC00}-\x{D7AF}]"}


@dataclass(frozen=True)
class Band:
    """Accepted ranges. ``entropy``: of the tokens, as a share of the highest entropy that many tokens can have."""

    chars_per_token: tuple[float, float]
    byte_share: tuple[float, float]
    entropy: tuple[float, float]


@dataclass(frozen=True)
class Bands:
    by_language: dict[str, Band] = field(default_factory=dict)
    by_script: dict[str, Band] = field(default_factory=dict)

    def of(self, lang: str | None, script: str) -> Band:
        return self.by_language.get(lang or "") or self.by_script.get(script) or self.by_script["other"]


_LATIN = Band((1.45, 8.0), (0.0, 0.25), (0.45, 1.0))
DEFAULT_BANDS = Bands(
    {"en": Band((2.1, 8.0), (0.0, 0.2), (0.5, 1.0)), "de": Band((2.1, 8.0), (0.0, 0.2), (0.5, 1.0)), "fr": Band((2.0, 8.0), (0.0, 0.2), (0.5, 1.0)), "es": Band((2.0, 8.0), (0.0, 0.2), (0.5, 1.0))},
    {"latin": _LATIN, "cyrillic": Band((0.8, 8.0), (0.0, 0.35), (0.45, 1.0)), "greek": Band((0.5, 8.0), (0.0, 0.5), (0.4, 1.0)), "arabic": Band((0.5, 8.0), (0.0, 0.6), (0.4, 1.0)), "devanagari": Band((0.3, 8.0), (0.0, 0.9), (0.3, 1.0)), "cjk": Band((0.3, 4.0), (0.0, 0.9), (0.4, 1.0)), "other": Band((0.25, 10.0), (0.0, 1.0), (0.3, 1.0))},
)

BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"
FERTILITY = "script string, chars_per_token double, byte_share double, entropy double, kept boolean"

_PIECES: dict[str, object] = {}


def _piece_model(path: str):
    if path not in _PIECES:
        import sentencepiece

        _PIECES[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _PIECES[path]


def _sums(per_word: np.ndarray, codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(per_word[codes])]) if len(codes) else np.zeros(1, per_word.dtype)
    return total[offsets[1:]] - total[offsets[:-1]]


def repeated_words(codes: np.ndarray, offsets: np.ndarray, window: int = 8) -> np.ndarray:
    """Per text: words that lie in a window of ``window`` words found twice or more in the text."""
    n, sizes = len(codes), np.diff(offsets)
    out = np.zeros(len(sizes), dtype=np.int64)
    if n < window:
        return out
    doc = np.repeat(np.arange(len(sizes)), sizes)
    with np.errstate(over="ignore"):
        word = mix64(codes.astype(np.uint64) + np.uint64(1))
        h = mix64(doc.astype(np.uint64) + np.uint64(1))[: n - window + 1]
        for k in range(window):
            h = h * np.uint64(0x9E3779B97F4A7C15) + word[k : n - window + 1 + k]
        h = mix64(h)
    starts = np.flatnonzero(doc[: n - window + 1] == doc[window - 1 :])
    order = np.argsort(h[starts])
    s = h[starts][order]
    same = np.zeros(len(s), dtype=bool)
    if len(s) > 1:
        equal = s[1:] == s[:-1]
        same[1:] |= equal
        same[:-1] |= equal
    hit = starts[order[same]]
    cover = np.zeros(n + 1, dtype=np.int64)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + window, -1)
    np.add.at(out, doc[np.cumsum(cover)[:-1] > 0], 1)
    return out


def repeated_lines(texts: pa.Array) -> np.ndarray:
    """Per text: lines with a word that equal an earlier line."""
    parts = pc.split_pattern(texts.cast(pa.large_string()), "\n")
    offsets = parts.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    coded = parts.flatten().dictionary_encode()
    codes = coded.indices.to_numpy().astype(np.int64)
    real = pc.greater(pc.binary_length(pc.utf8_trim(coded.dictionary, characters=" \t\n\x0b\x0c\r")), 0).to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[real[codes]]
    codes = codes[real[codes]]
    total = np.bincount(doc, minlength=len(offsets) - 1)
    key = np.unique(doc * (len(coded.dictionary) + 1) + codes)
    return total - np.bincount(key // (len(coded.dictionary) + 1), minlength=len(offsets) - 1)


def measures(texts: pa.Array, min_words: int, max_repeat_percent: int, rank_path: str, piece_path: str) -> dict[str, np.ndarray]:
    """All measures of a column of texts."""
    words, codes, offsets = plain_words(texts)
    sizes = np.diff(offsets)
    chars = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    symbols = pc.count_substring_regex(words, r"[#*$%&|<>]").to_numpy(zero_copy_only=False).astype(np.int64)
    out = {"n_words": sizes, "word_chars": _sums(chars, codes, offsets), "n_symbols": _sums(symbols, codes, offsets), "n_dup_lines": repeated_lines(texts), "n_repeat_words": repeated_words(codes, offsets)}
    out["base_failed"] = (sizes < min_words) | (100 * out["n_repeat_words"] > max_repeat_percent * sizes)
    import public_tokenizers

    spaced = pc.binary_join_element_wise(pa.array([""] * len(words), pa.large_string()), words, pa.scalar(" ", pa.large_string()))
    ids, ends = rank_ids(spaced, rank_tokenizer(rank_path, public_tokenizers.PATTERN))
    listed = words.to_pylist()
    model = _piece_model(piece_path)
    single = np.array([model.is_byte(i) for i in range(model.vocab_size())])
    n_pieces, n_bytes = np.zeros(len(listed), np.int64), np.zeros(len(listed), np.int64)
    for a in range(0, len(listed), 20_000):
        flat, cuts = ragged(model.encode(listed[a : a + 20_000], num_threads=1))
        n_pieces[a : a + 20_000] = np.diff(cuts)
        n_bytes[a : a + 20_000] = np.diff(np.concatenate([[0], np.cumsum(single[flat])])[cuts])
    n_tokens = _sums(np.diff(ends), codes, offsets)
    out["chars_per_token"] = (out["word_chars"] + sizes) / np.maximum(n_tokens, 1)
    out["byte_share"] = _sums(n_bytes, codes, offsets) / np.maximum(_sums(n_pieces, codes, offsets), 1)
    flat, cuts = gather(ids, ends, codes)
    bounds = cuts[offsets]
    doc = np.repeat(np.arange(len(sizes)), np.diff(bounds))
    key = np.sort(doc * (1 << 20) + flat)
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if len(key) else np.zeros(1, np.int64)
    counts = np.diff(edge).astype(float)
    clogc = np.bincount(key[edge[:-1]] >> 20, counts * np.log2(counts), minlength=len(sizes)) if len(key) else np.zeros(len(sizes))
    n = np.maximum(n_tokens, 1)
    highest = np.log2(np.clip(n, 2, 4096))  # longer texts repeat common words; the scale stops growing
    out["entropy"] = np.minimum(1.0, (np.log2(n) - clogc / n) / highest)
    by_script = np.stack([_sums(pc.count_substring_regex(words, pattern).to_numpy(zero_copy_only=False).astype(np.int64), codes, offsets) for pattern in SCRIPTS.values()])
    out["script"] = np.where(by_script.max(0) > 0, np.array(list(SCRIPTS))[by_script.argmax(0)], "other")
    return out


def assess(docs: DataFrame, keep: tuple[str, ...] = (), bands: Bands = DEFAULT_BANDS, min_words: int = 20, max_repeat_percent: int = 30, rank_path: str | None = None, piece_path: str | None = None) -> DataFrame:
    """``doc_id``, the columns ``keep``, the base measures, script, fertility measures and ``kept``, one row per row."""
    rank_path = rank_path or public_vocabulary("byte_bpe_multi_50k.tiktoken")
    piece_path = piece_path or public_vocabulary("piece_bpe_32k.model")
    order = [x.split()[0] for x in f"{BASE}, {FERTILITY}".split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches, "__text", limit=4 << 20):
            m = measures(chunk.column("__text"), min_words, max_repeat_percent, rank_path, piece_path)
            chosen = [bands.of(lang, script) for lang, script in zip(chunk.column("__lang").to_pylist(), m["script"])]
            inside = np.ones(len(chosen), dtype=bool)
            for name in ("chars_per_token", "byte_share", "entropy"):
                low, high = (np.array([getattr(b, name)[i] for b in chosen]) for i in (0, 1))
                inside &= (m[name] >= low) & (m[name] <= high)
            m["kept"] = inside & ~m["base_failed"]
            yield pa.RecordBatch.from_pydict({"doc_id": chunk.column("__id"), **{k: chunk.column(k) for k in keep}, **{k: pa.array(m[k]) for k in order}})

    lang = docs["lang"].cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(docs["doc_id"].cast("long").alias("__id"), *keep, F.coalesce(docs["text"].cast("string"), F.lit("")).alias("__text"), lang.alias("__lang"))
    kinds = "".join(f", `{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    # a kept column may itself be called doc_id
    head = "doc_id long" + kinds if "doc_id" not in keep else kinds[2:]
    return rows.mapInArrow(run, f"{head}, {BASE}, {FERTILITY}")
