"""Jaccard self-join of documents on word n-grams by vertical partitioning.

A document's set holds its distinct ``n``-word shingles, as 64-bit hashes. The global order of all shingles (that of
their hashes) is cut into fragments. Each fragment gets its segment of every document, sees there how many documents
hold each shingle, and sends back the shingles of two documents or more; overlaps consist of those alone. With the
counts, a document's rarest shingles come first, and two documents that reach the threshold must share one among the
first ``size - ceil(threshold * size) + 1`` of both. Documents that do so, with sizes near enough, form candidate
clusters. A cluster's shingles are cut into fragments of the same global order; each (block of sets, block of sets,
fragment) is a row group of its own, which counts the partial overlap of its pairs, and a further shuffle sums the
partial counts of each pair over the fragments. Pairs that reach the threshold are links, and links make components.

What keeps it bounded:

* equal sets count as one class throughout (within a chunk before anything is sent), so copies cost one set;
* rows that move are packed per chunk of documents and fragment, and there are as many fragments as the text needs for
  about ``FRAGMENT_TEXT`` bytes each; a very frequent shingle is one entry per document of one fragment;
* pairs never become rows: partial counts of a pair of blocks are one packed matrix, and what comes out of their sum
  are links that span the components, one row per document; clusters beyond ``BLOCK_SETS`` sets are cut into blocks, so
  no group holds more than twice as many sets, nor more than about ``4 * SEGMENT`` shingles;
* nothing is capped, and nothing of the corpus goes to the driver.

Shingles are compared by 64-bit hashes and equal sets are recognised by a 64-bit sum over them: at 10^9 documents the
chance of one false merge of two different sets is about 3 %. Packets number chunks times fragments, which suits inputs
up to some terabytes at the defaults; beyond, dealing would have to go in two steps.

The threshold is a whole percentage, compared in integers: ``100 * overlap >= percent * union``.

Null text counts as empty; documents without words have an empty set and link with nothing. Documents with fewer than
``n`` words have their whole word sequence as their one shingle. Repeated rows are documents of the same class; a null
doc_id is never the smallest. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.llm.common import doc_text, lists, mix64, plain_words, sorted_groups, text_chunks, word_hashes
from casebook.operators.components import connected_components
from casebook.session import written

FRAGMENT_TEXT = 8 << 20
BLOCK_SETS, SEGMENT = 512, 1 << 19
SENT = "chunk long, fragment int, doc_ids array<long>, sizes binary, signs binary, carries binary, shingles binary, holders binary"
HELD = "chunk long, fragment int, doc_ids array<long>, sizes binary, signs binary, carries binary, shingles binary, holders binary, counts binary"


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Per text: the sorted distinct hashes of its ``n``-word shingles (A-Z lower-cased)."""
    words, codes, offsets = plain_words(texts, lower=True)
    h = word_hashes(words)[codes] if len(codes) else np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        long = np.zeros(max(0, len(h) - n + 1), dtype=np.uint64)
        for k in range(n):
            long = long * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(long)]
        long = mix64(long)
        out = []
        for a, b in zip(offsets, offsets[1:]):
            if b - a >= n:
                out.append(np.unique(long[a : b - n + 1]))
            elif b > a:
                short = np.uint64(b - a)  # a shorter sequence never equals one of n words
                for x in h[a:b]:
                    short = short * np.uint64(0xD6E8FEB86659FD93) + x
                out.append(mix64(np.array([short])))
            else:
                out.append(np.zeros(0, dtype=np.uint64))
    return out


def _sign(s: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        total = mix64(s + np.uint64(0x632BE59BD9B4E019)).sum(dtype=np.uint64) + np.uint64(len(s))
    return int(mix64(np.array([total])).view(np.int64)[0])


def _send(n: int, n_fragments: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count = TaskContext.get().partitionId(), 0
        for chunk in text_chunks(batches):
            sets = shingle_sets(chunk.column("text"), n)
            sizes = np.array([len(s) for s in sets], dtype=np.int64)
            signs = np.array([_sign(s) for s in sets], dtype=np.int64)
            carries = np.zeros(len(sets), dtype=bool)  # the first of equal sets sends the shingles
            carries[np.unique(signs, return_index=True)[1]] = True
            carries &= sizes > 0
            name = (part << 24) + count
            rows = {"chunk": [name], "fragment": [-1 - name % 4096], "doc_ids": [chunk.column("doc_id").to_pylist()], "sizes": [sizes.astype("<u4").tobytes()], "signs": [signs.tobytes()], "carries": [carries.tobytes()], "shingles": [None], "holders": [None]}
            sent = [sets[i] for i in np.flatnonzero(carries)]
            if sent:
                flat = np.concatenate(sent)
                holder = np.repeat(np.flatnonzero(carries), sizes[carries]).astype(np.uint32)
                fragment = (flat % np.uint64(n_fragments)).astype(np.int64)
                order = np.argsort(fragment, kind="stable")
                flat, holder = (flat >> np.uint64(16))[order], holder[order]  # 48 bits beside the fragment
                cuts = np.searchsorted(fragment[order], np.arange(n_fragments + 1))
                for f in np.flatnonzero(np.diff(cuts)):
                    own = flat[cuts[f] : cuts[f + 1]]
                    rows["chunk"].append(name)
                    rows["fragment"].append(int(f))
                    rows["shingles"].append(own.astype("<u4").tobytes() + (own >> np.uint64(32)).astype("<u2").tobytes())
                    rows["holders"].append(holder[cuts[f] : cuts[f + 1]].tobytes())
                    for k in ("doc_ids", "sizes", "signs", "carries"):
                        rows[k].append(None)
            kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), *[pa.binary()] * 5]
            table = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), kinds)], names=list(rows))
            for a in range(0, table.num_rows, 500):
                yield table.slice(a, 500)
            count += 1

    return run


def _count_holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In each fragment: shingles that two documents or more hold, with their number, back to where they came from."""
    for group in sorted_groups(batches, ["fragment"]):
        fragment = group.column("fragment")[0].as_py()
        if fragment < 0:
            for b in group.to_batches():
                yield pa.RecordBatch.from_arrays([*b.columns, pa.nulls(b.num_rows, pa.binary())], names=[*b.schema.names, "counts"])
            continue
        raw = [s.as_py() for s in group.column("shingles")]
        low = [np.frombuffer(r, "<u4", len(r) // 6).astype(np.uint64) for r in raw]
        high = [np.frombuffer(r, "<u2", len(r) // 6, len(r) // 6 * 4).astype(np.uint64) for r in raw]
        flat = np.concatenate(low) | (np.concatenate(high) << np.uint64(32))
        ends = np.concatenate([[0], np.cumsum([len(x) for x in low])])
        order = np.argsort(flat)
        edge = np.flatnonzero(np.concatenate([[True], flat[order][1:] != flat[order][:-1], [True]]))
        counts = np.empty(len(flat), dtype=np.uint32)
        counts[order] = np.repeat(np.diff(edge), np.diff(edge))
        named = (flat | (np.uint64(fragment % 65536) << np.uint64(48))).view(np.int64)
        out: dict[str, list] = {"chunk": [], "shingles": [], "holders": [], "counts": []}
        for k, (a, b) in enumerate(zip(ends, ends[1:])):
            shared = counts[a:b] > 1
            if shared.any():
                out["chunk"].append(group.column("chunk")[k].as_py())
                out["shingles"].append(named[a:b][shared].tobytes())
                out["holders"].append(np.frombuffer(group.column("holders")[k].as_py(), np.uint32)[shared].tobytes())
                out["counts"].append(counts[a:b][shared].tobytes())
        n = len(out["chunk"])
        none = pa.nulls(n, pa.binary())
        table = pa.RecordBatch.from_arrays([pa.array(out["chunk"], pa.int64()), pa.array([fragment] * n, pa.int32()), pa.nulls(n, pa.list_(pa.int64())), none, none, none, *(pa.array(out[k], pa.binary()) for k in ("shingles", "holders", "counts"))], names=["chunk", "fragment", "doc_ids", "sizes", "signs", "carries", "shingles", "holders", "counts"])
        for a in range(0, n, 500):
            yield table.slice(a, 500)


def _prefixes(percent: int):
    """Per document of a chunk: its size, its set's sign, its rarest shingles that others hold, and all such."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ["chunk"]):
            rows = group.to_pylist()
            head = next(r for r in rows if r["sizes"] is not None)
            sizes = np.frombuffer(head["sizes"], "<u4").astype(np.int64)
            signs = np.frombuffer(head["signs"], np.int64)
            body = [r for r in rows if r["sizes"] is None]
            join = lambda k, t: np.concatenate([np.frombuffer(r[k], t) for r in body]) if body else np.zeros(0, t)  # noqa: B023, E731
            shingles, holders, counts = join("shingles", np.int64), join("holders", np.uint32).astype(np.int64), join("counts", np.uint32)
            order = np.lexsort((shingles, counts, holders))
            shingles, holders = shingles[order], holders[order]
            ends = np.searchsorted(holders, np.arange(len(sizes) + 1))
            shared = np.diff(ends)
            prefix = sizes + (-percent * sizes) // 100 + 1  # size - ceil(percent * size / 100) + 1
            reach = np.clip(prefix - (sizes - shared), 0, shared)  # unshared shingles are the rarest of all
            kept = np.where(reach > 0, shared, 0)
            take = lambda n: np.arange(n.sum()) + np.repeat(ends[:-1] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) if len(n) else np.zeros(0, np.int64)  # noqa: B023, E731
            rare, full = shingles[take(reach)], shingles[take(kept)]
            at, till = np.concatenate([[0], np.cumsum(reach)]), np.concatenate([[0], np.cumsum(kept)])
            for a in range(0, len(sizes), 500):
                b = min(a + 500, len(sizes))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(head["doc_ids"][a:b], pa.int64()), "n_shingles": pa.array(sizes[a:b]), "sign": pa.array(signs[a:b]),
                    "prefix": lists(rare[at[a] : at[b]], at[a : b + 1] - at[a]), "shared": lists(full[till[a] : till[b]], till[a : b + 1] - till[a]),
                })

    return run


def overlaps(sets: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Overlap of every pair of sets, by products of ``width`` columns of their incidence matrix at a time."""
    flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
    order, place = np.unique(flat, return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    total = np.zeros((len(sets), len(sets)), dtype=np.int64)
    by = np.argsort(place, kind="stable")
    place, owner = place[by], owner[by]
    for a in range(0, len(order), width):
        i, j = np.searchsorted(place, [a, a + width])
        columns = np.zeros((len(sets), min(width, len(order) - a)), dtype=np.float32)
        columns[owner[i:j], place[i:j] - a] = 1
        total += (columns @ columns.T).astype(np.int64)
    return total


PARTIAL = "cluster long, i long, j long, signs binary, sizes binary, copies binary, sides binary, counts binary"


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Within a fragment of two blocks of a cluster: how many of the fragment's shingles each pair of sets shares."""
    out: dict[str, list] = {}

    def packed() -> pa.RecordBatch:
        kinds = [pa.int64()] * 3 + [pa.binary()] * 5
        batch = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], names=list(out))
        out.clear()
        return batch

    held = 0
    for group in sorted_groups(batches, ["cluster", "i", "j", "fragment"]):
        g = group.combine_chunks()
        shared = g.column("shared")
        counts = overlaps([shared[k].values.to_numpy() for k in range(g.num_rows)])
        row = {k: g.column(k)[0].as_py() for k in ("cluster", "i", "j")} | {k + "s": g.column(k).to_numpy().tobytes() for k in ("sign", "size")}
        row |= {"copies": g.column("copies").to_numpy().tobytes(), "sides": g.column("side").to_numpy().tobytes(), "counts": zstandard.compress(counts.astype("<u4").tobytes(), 1)}
        for k, v in row.items():
            out.setdefault(k, []).append(v)
        held += counts.size
        if held > 1 << 20 or len(out["i"]) >= 2_000:
            yield packed()
            held = 0
    if out:
        yield packed()


def _link(percent: int):
    """Sums the partial counts of every pair of two blocks over the fragments. For every set: the smallest set it is
    joined to there, and how many documents of other sets it links with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ["cluster", "i", "j"]):
            parts = group.to_pylist()
            signs = [np.frombuffer(r["signs"], np.int64) for r in parts]
            sign, first = np.unique(np.concatenate(signs), return_index=True)
            size, copies = (np.concatenate([np.frombuffer(r[k], np.int64) for r in parts])[first] for k in ("sizes", "copies"))
            side = np.concatenate([np.frombuffer(r["sides"], np.int32) for r in parts])[first]
            both = np.zeros((len(sign), len(sign)), dtype=np.int64)
            for own, r in zip(signs, parts):
                at = np.searchsorted(sign, own)
                both[np.ix_(at, at)] += np.frombuffer(zstandard.decompress(r["counts"]), "<u4").reshape(len(own), len(own))
            linked = 100 * both >= percent * (size[:, None] + size[None, :] - both)
            np.fill_diagonal(linked, False)
            if parts[0]["i"] != parts[0]["j"]:
                linked &= side[:, None] != side[None, :]  # pairs within a block have their own group
            label, old = sign.copy(), None
            while old is None or (label != old).any():
                old = label
                label = np.minimum(label, np.where(linked, label[None, :], np.iinfo(np.int64).max).min(1))
                label = label[np.searchsorted(sign, label)]  # jump
            any_ = linked.any(1)
            yield pa.RecordBatch.from_pydict({"sign": pa.array(sign[any_]), "low": pa.array(label[any_]), "links": pa.array((linked @ copies)[any_].astype(np.int64))})

    return run


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text", fragment_text: int = FRAGMENT_TEXT, segment: int = SEGMENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id reachable over links) and n_links
    (documents it links with, equal ones included)."""
    spark = docs.sparkSession
    rows = doc_text(docs, doc_id, text)
    chars = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    n_fragments = max(1, math.ceil(chars / fragment_text))
    sent = rows.mapInArrow(_send(n, n_fragments), SENT)
    held = sent.repartitionById(n_fragments, F.pmod("fragment", F.lit(n_fragments))).sortWithinPartitions("fragment").mapInArrow(_count_holders, HELD)
    sets = held.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_prefixes(percent), "doc_id long, n_shingles long, sign long, prefix array<long>, shared array<long>")
    sets = written(sets, "shingle-sets")
    classes = written(sets.where("n_shingles > 0").groupBy("sign").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "shingle-classes")
    # one carrier per class; equal sets have equal counts and so equal prefixes
    carriers = sets.where(F.size("prefix") > 0).groupBy("sign").agg(F.first("n_shingles").alias("n_shingles"), F.first("prefix").alias("prefix"), F.first("shared").alias("shared"))
    carriers = written(carriers, "shingle-carriers")
    # sizes of linked sets differ by one step of the threshold at most, so a set meets its own step and the next
    step = F.floor(F.log(F.col("n_shingles").cast("double")) / math.log(100 / percent)) if percent < 100 else F.col("n_shingles")
    postings = carriers.select("sign", F.explode("prefix").alias("shingle"), step.cast("long").alias("s")).select("sign", "shingle", F.explode(F.array("s", F.col("s") + 1)).alias("s"))
    hubs = postings.groupBy("shingle", "s").agg(F.min("sign").alias("hub"), F.count("*").alias("k")).where("k > 1").drop("k")
    near = postings.join(hubs, ["shingle", "s"]).where("sign <> hub").select(F.col("sign").alias("src"), F.col("hub").alias("dst")).distinct()
    clusters = connected_components(near).select(F.col("node").alias("sign"), F.col("component").alias("cluster"))
    members = written(carriers.drop("prefix").join(clusters, "sign").join(classes.select("sign", "copies"), "sign"), "cluster-members")
    extent = members.groupBy("cluster").agg(F.count("*").alias("k"), F.sum(F.size("shared")).alias("w"))
    cuts = extent.select("cluster", F.ceil(F.col("k") / BLOCK_SETS).alias("nb"), "w").select("cluster", "nb", F.ceil(F.col("w") / F.col("nb") / segment).alias("nf"))
    placed = members.join(cuts, "cluster").withColumn("b", F.pmod(F.xxhash64("sign"), F.col("nb")))
    dealt = placed.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1))).withColumn("fragment", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nf") - 1)))
    # fragments are equal ranges of the shingles' order, taken by their upper 31 bits
    here = F.expr("CASE WHEN nf = 1 THEN shared ELSE filter(shared, x -> shiftrightunsigned(x, 33) * nf div 2147483648 = fragment) END")
    dealt = dealt.select("cluster", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "fragment", (F.col("b") <= F.col("o")).cast("int").alias("side"), "sign", F.col("n_shingles").alias("size"), "copies", here.alias("shared")).where(F.size("shared") > 0)
    group = ["cluster", "i", "j"]
    partial = dealt.repartition(*group, "fragment").sortWithinPartitions(*group, "fragment").mapInArrow(_partial_counts, PARTIAL)
    linked = partial.repartition(*group).sortWithinPartitions(*group).mapInArrow(_link(percent), "sign long, low long, links long")
    linked = written(linked, "links")
    joined = connected_components(linked.select(F.col("sign").alias("src"), F.col("low").alias("dst")))
    links = linked.groupBy("sign").agg(F.sum("links").alias("links"))
    grouped = classes.join(joined.withColumnRenamed("node", "sign"), "sign", "left").join(links, "sign", "left").withColumn("group", F.coalesce("component", "sign"))
    lowest = grouped.groupBy("group").agg(F.min("rep").alias("component_id"))
    decided = written(grouped.join(lowest, "group").select("sign", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")), "shingle-groups")
    full = sets.select("doc_id", "n_shingles", "sign").where("n_shingles > 0").join(decided, "sign").select("doc_id", "n_shingles", "component_id", F.col("links").alias("n_links"))
    empty = sets.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return full.unionByName(empty)


def op7_sql(n: int = 4, percent: int = 85) -> str:
    """The same components from every pair of documents that share a shingle; for small tables, as pairs are rows here."""
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] ELSE list_transform(range(1, greatest(len(w) - {n} + 2, 2)), lambda i: array_to_string(w[i:i + {n} - 1], ' ')) END) AS g FROM w),
k AS (SELECT doc_id, count(*) AS n_shingles FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN k x ON x.doc_id = a JOIN k y ON y.doc_id = b WHERE 100 * c >= {percent} * (x.n_shingles + y.n_shingles - c)),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc_id WHERE r.root < l.b)
SELECT d.doc_id, coalesce(k.n_shingles, 0) AS n_shingles, min(r.root) AS component_id, (SELECT count(*) FROM l WHERE l.a = d.doc_id) AS n_links FROM documents d LEFT JOIN k USING (doc_id) LEFT JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id, k.n_shingles
"""
