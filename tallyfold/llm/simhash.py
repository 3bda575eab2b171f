"""SimHash near-duplicate detection through deletion-variant signatures.

A pair of 64-bit fingerprints that differ in at most three bits, cut into two 32-bit segments, has one segment
that differs in at most one bit. Every fingerprint is indexed under the variants of both segments with one bit
wildcarded; an equality join on the variants finds all such pairs, which are then verified on all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tallyfold.llm.common import mix, record_batch, texts_of, trimmed
from tallyfold.operators.graph import connected_components
from tallyfold.plans.materialize import materialize, row_key

SHINGLE = 3
MAX_DISTANCE = 3
#: Bits of two fingerprints by which near-duplicates of a corpus differ at most: 12 %, a similarity of 0.8 in words of five.
NEAR_BITS = 15
#: Fingerprints of one bucket that a task compares at once; larger buckets are cut into blocks, and pairs of blocks are tasks' units.
BLOCK = 1024

#: Names of a row's key, beside any columns that a table has.
_OWN = ("__simhash_file", "__simhash_row")
_EDGES = pa.schema([("src", pa.int64()), ("dst", pa.int64())])


def _hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of the text's words, A-Z lower-cased; none: no words."""
    words = text.lower().split()  # bytes: lower() changes A-Z only, split() cuts at ASCII white space
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s:e], 42) for s, e in zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)), np.uint64, n)


def _majority(hashes: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 15):
        part = hashes[k : k + (1 << 15)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The SimHash of one text, as a signed 64-bit integer."""
    return _majority(_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, names: tuple[str, ...] = ("fp",)) -> DataFrame:
    """docs with fp (signed 64 bits) in the place of the column text; null texts count as empty, whose fingerprint is zero.

    names: of so many fingerprints, each of the one before's shingle hashes, mixed again.
    """
    rest = [c for c in docs.columns if c != "text"]

    def prints(text: bytes) -> list[int]:
        hashes, out = _hashes(text, shingle), []
        for _ in names:
            out.append(_majority(hashes))
            hashes = mix(hashes)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([prints(t) for t in texts_of(batch.column("text"))], np.int64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *(pa.array(x) for x in rows.T)], names=[*rest, *names])

    schema = StructType([*(f for f in docs.schema.fields if f.name != "text"), *(StructField(n, LongType()) for n in names)])
    return docs.mapInArrow(trimmed(run), schema)


def _variants(nodes: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """The segments of each fingerprint, with each bit wildcarded in turn: key holds the segment, the bit and the other 31 bits."""
    parts = nodes.select(*names, "node", F.explode(F.array(*[F.struct(F.lit(64 * k).alias("at"), F.col(n).alias("own")) for k, n in enumerate(names)])).alias("p"), F.expr("sequence(0, 63)").alias("vs"))
    parts = parts.select(*names, "node", "p.at", "p.own", F.explode("vs").alias("v"))
    segment = F.expr("if(v < 32, own, shiftrightunsigned(own, 32)) & 4294967295L & ~shiftleft(1L, v % 32)")
    return parts.select(F.shiftleft((F.col("at") + F.col("v")).cast("long"), 32).bitwiseOR(segment).alias("key"), *names, "node")


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits, over all fingerprints (the last axis). Of signed values bitwise_count counts the bits of the absolute value."""
    return np.bitwise_count((a ^ b).view(np.uint64)).sum(axis=-1, dtype=np.int64)


def _star(fps: np.ndarray, nodes: np.ndarray, side: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a forest that spans what is linked within a bucket, or across its two blocks."""
    near = np.empty((len(fps), len(fps)), bool)
    for k in range(0, len(fps), 128):  # a strip at a time: bits of all fingerprints, at most 255
        near[k : k + 128] = sum(np.bitwise_count((own[k : k + 128, None] ^ own[None, :]).view(np.uint64)) for own in fps.T) <= most
    if side[0] != side[-1]:
        near &= side[:, None] != side[None, :]
    i, j = np.nonzero(np.triu(near, 1))
    label = np.arange(len(fps))
    while len(i):
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if np.array_equal(before, label):
            break
    k = np.flatnonzero(label != np.arange(len(fps)))
    return nodes[k], nodes[label[k]]


def _verify(most: int):
    def edges(key: np.ndarray, side: np.ndarray, node: np.ndarray, *prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fp = np.stack(prints, axis=1)
        cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        sizes = np.diff(cuts)
        two = cuts[:-1][sizes == 2]
        two = two[_distance(fp[two], fp[two + 1]) <= most]
        src, dst = [node[two]], [node[two + 1]]
        for at, n in zip(cuts[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            a, b = _star(fp[at : at + n], node[at : at + n], side[at : at + n], most)
            src.append(a)
            dst.append(b)
        pair = np.stack([np.concatenate(src), np.concatenate(dst)], axis=1)
        pair.sort(axis=1)
        pair = np.unique(pair, axis=0)
        return pair[:, 1], pair[:, 0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            got = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(batch.num_columns)]
            if held is not None:
                got = [np.concatenate(x) for x in zip(held, got, strict=True)]
            if not len(got[0]):
                continue
            whole = int(np.searchsorted(got[0], got[0][-1]))  # the last bucket may go on in the next batch
            held = [x[whole:] for x in got]
            if whole:
                yield record_batch(_EDGES, *edges(*(x[:whole] for x in got)))
        if held is not None and len(held[0]):
            yield record_batch(_EDGES, *edges(*held))

    return run


def links(nodes: DataFrame, most: int = MAX_DISTANCE, block: int = BLOCK, names: tuple[str, ...] = ("fp",)) -> DataFrame:
    """src, dst: edges whose components are those of all pairs of fps that differ in at most `most` bits.

    nodes: fp (or the given names), node (distinct). Two segments of a fingerprint serve 3 bits: all pairs within so
    many are found, of all fingerprints together within 4 times their number less 1. With a larger `most` pairs farther
    apart are linked too where a segment of theirs differs in one bit at most. No pair of a bucket is listed: a task
    returns a spanning forest of each bucket.
    """
    keys = _variants(nodes, names)
    counts = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.hash(*names), blocks)
    units = (
        keys.join(counts.hint("merge"), "key")  # 64 variants of each segment: more than Spark's estimate, which would send them to the driver
        .select("key", *names, "node", own.alias("side"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
        .select(F.xxhash64("key", F.least("side", "other"), F.greatest("side", "other")).alias("unit"), "side", "node", *names)
    )
    found = units.repartition("unit").sortWithinPartitions("unit", "side", *names).mapInArrow(trimmed(_verify(most)), "src long, dst long")
    return found.distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, most: int = MAX_DISTANCE, block: int = BLOCK) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id.

    Lower-cases A-Z, takes shingles of `shingle` words with repeats (fewer words: one shingle of all), sets a bit
    that is set in over half the shingles' XXH64 (seed 42). Texts that are empty, null or white space have the
    fingerprint zero and link like any other. component_id is the smallest doc_id reached through links of at most
    `most` differing bits. Rows with a null doc_id get a fingerprint and the component of that fingerprint's other
    rows (null if there are none). Repeated rows stay; extra columns are ignored; an empty table gives no rows.
    """
    prints = materialize(fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), shingle), "simhash")
    nodes = materialize(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    parts = connected_components(links(nodes, most, block))
    classes = nodes.join(parts.hint("merge"), "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return prints.join(classes.hint("merge"), "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, shingle: int = SHINGLE, most: int = NEAR_BITS, block: int = BLOCK) -> DataFrame:
    """docs, all columns, with one row of each group of near-duplicates: that with the smallest doc_id.

    Near-duplicates differ in at most `most` of the 128 bits of two fingerprints, which texts with a similarity of 0.8 in
    words of five do on the average. All pairs within 7 bits are found, and farther ones where one of four segments
    differs in one bit at most. Null doc_ids come last, and of equal doc_ids the first row in the first file by hash
    stays; a group of rows without doc_id keeps one of them. Texts that are empty, null or white space are one group. An
    empty table gives no rows. Groups are found over fingerprints and row keys alone; the outcome meets the texts once.
    """
    names = ("fp", "fq")
    docs, key = row_key(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *key, "text")
    prints = materialize(fingerprints(rows, shingle, names), "simhash")
    # A node is the least row of equal fingerprints: that of the least doc_id, nulls last.
    least = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "file", "row")
    nodes = prints.groupBy(*names).agg(F.min(least).alias("least")).select(*names, F.xxhash64("least.file", "least.row").alias("node"), "least")
    nodes = materialize(nodes, "nodes")
    parts = connected_components(links(nodes.select(*names, "node"), most, block, names))
    heads = nodes.join(parts.hint("merge"), "node", "left").groupBy(F.coalesce("component", "node").alias("component")).agg(F.min("least").alias("least")).select("least.file", "least.row")
    # Neither side has a bound that would allow a broadcast: the texts are dealt out by row, which no key can skew.
    kept = docs.withColumns(dict(zip(_OWN, key, strict=True))).join(heads.toDF(*_OWN).hint("merge"), list(_OWN), "left_semi")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
