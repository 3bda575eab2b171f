"""Exact substring deduplication of byte strings through suffix arrays of shards.

Every 100-byte string holds, within it, the k-gram of least hash: its anchor. Equal strings have equal anchors, so
the starts of strings are dealt out by anchor, as fragments: the stretch of one text whose starts share an anchor.
Fragments of a lone anchor repeat nothing. Copies of a whole fragment, by their digests, are dealt out as one: their
first is the head that stands for them. All heads of an anchor, with their bytes, meet in a shard of whole stretches
of text, whose suffix array is induced from its sorted leftmost-smaller substrings, and whose permuted common
prefixes tell which strings are equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import chunked, mix, record_batch, span_hashes, texts_of, trimmed
from tallyfold.plans.materialize import discard, materialize, release_shuffles, row_key

LENGTH, GRAM = 100, 32
#: Symbols of a shard; fragments that a task combines, and fragments of a bucket.
SHARD, HELD, BUCKET = 1 << 21, 1 << 20, 1 << 18
#: Starts in a step, by which the heads of an anchor are dealt out that would overflow a shard.
STEP = 16

_FRAGMENT = np.dtype([("anchor", "<u8"), ("digest", "<u8"), ("doc", "<i8"), ("start", "<i4"), ("n", "u1"), ("lead", "u1")])
_STRETCH = np.dtype([("doc", "<i8"), ("start", "<i4"), ("n", "<i4")])
_HEAD = np.dtype([("doc", "<i8"), ("start", "<i4"), ("n", "u1"), ("lead", "u1"), ("kinds", "<i4"), ("anchor", "<u8")])
_PACKED = pa.schema([("bucket", pa.int32()), ("data", pa.binary())])
_PACKED_DDL = "bucket int, data binary"
_HEADS = pa.schema([("doc", pa.int64()), ("data", pa.binary())])
_PIECES = pa.schema([("deal", pa.int64()), ("doc", pa.int64()), ("start", pa.int32()), ("piece", pa.binary())])
_KEPT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def _window_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive values, from running minima of blocks in both directions."""
    n = len(x) - width + 1
    padded = np.concatenate([x, np.full(-len(x) % width, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def fragments_of(texts: list[bytes], length: int, gram: int) -> np.ndarray:
    """All fragments of the texts, in order (doc: the text's index). lead: from the first start to the anchor."""
    buf = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    if len(buf) < length:
        return np.empty(0, _FRAGMENT)
    at = np.arange(len(buf) - gram + 1)
    grams = span_hashes(buf, at, at + gram)
    key = grams & np.uint64(0xFFFFFFFF00000000) | at.astype(np.uint64)
    owner = (_window_least(key, length - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    inside = np.zeros(len(owner) + 1, np.int64)
    long_ = sizes >= length
    np.add.at(inside, offsets[:-1][long_], 1)
    np.add.at(inside, offsets[1:][long_] - length + 1, -1)
    starts = np.flatnonzero(np.cumsum(inside)[:-1] > 0)
    if not len(starts):
        return np.empty(0, _FRAGMENT)
    own = owner[starts]
    cut = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    first, n = starts[cut], np.diff(np.append(cut, len(starts)))
    text = np.searchsorted(offsets, first, "right") - 1
    out = np.empty(len(cut), _FRAGMENT)
    out["anchor"], out["digest"] = mix(grams[own[cut]]), span_hashes(buf, first, first + n + length - 1)
    out["doc"], out["start"], out["n"], out["lead"] = text, first - offsets[text], n, own[cut] - first
    return out


def _packed(rows: np.ndarray, bucket: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """The rows of each bucket, column by column."""
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows[order], bucket[order]
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(rows) else np.zeros(1, int)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield int(bucket[a]), b"".join(np.ascontiguousarray(rows[c][a:b]).tobytes() for c in rows.dtype.names)


def _unpacked(parts: list[bytes], kind: np.dtype) -> np.ndarray:
    out = []
    for data in parts:
        n, at = len(data) // kind.itemsize, 0
        rows = np.empty(n, kind)
        for c in kind.names:
            rows[c] = np.frombuffer(data, kind[c], n, at)
            at += n * kind[c].itemsize
        out.append(rows)
    return np.concatenate(out) if out else np.empty(0, kind)


def _batch(rows: Iterator[tuple[int, bytes]], schema: pa.Schema = _PACKED) -> Iterator[pa.RecordBatch]:
    held = list(rows)
    if held:
        yield record_batch(schema, *map(list, zip(*held, strict=True)))


def _first(frags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first fragment of each kind (anchor and digest), in order of anchors, and the stretches of the others."""
    frags = frags[np.lexsort((frags["start"], frags["doc"], frags["digest"], frags["anchor"]))]
    new = np.concatenate([[True], (frags["anchor"][1:] != frags["anchor"][:-1]) | (frags["digest"][1:] != frags["digest"][:-1])]) if len(frags) else np.empty(0, bool)
    rest = frags[~new]
    copies = np.empty(len(rest), _STRETCH)
    for c in _STRETCH.names:
        copies[c] = rest[c]
    return frags[new], copies


def _home(doc: np.ndarray, homes: int) -> np.ndarray:
    """The bucket of a document: -1 and below, beside the buckets of anchors."""
    return -1 - (mix(doc.astype("<i8").view(np.uint64)) % np.uint64(homes)).astype(np.int64)


def _fragments(length: int, gram: int, buckets: int, homes: int):
    """The fragments of a task, combined: the first of each kind to its anchor's bucket, the copies' stretches to their documents'."""

    def flush(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        first, copies = _first(np.concatenate(held))
        yield from _batch(_packed(first, (first["anchor"] % np.uint64(buckets)).astype(np.int64)))
        yield from _batch(_packed(copies, _home(copies["doc"], homes)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            docs = batch.column(0).to_numpy()
            for base, texts in chunked(texts_of(batch.column(1)), 1 << 21):
                frags = fragments_of(texts, length, gram)
                frags["doc"] = docs[base + frags["doc"]]
                held.append(frags)
                size += len(frags)
                if size > HELD:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    return run


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """The data of each bucket; rows come in the order of buckets."""
    bucket, held = None, []
    for batch in batches:
        for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if k != bucket and held:
                yield bucket, held
                held = []
            bucket = k
            held.append(data)
    if held:
        yield bucket, held


def _heads(homes: int):
    """By document: the stretches of copies (buckets below 0), and the heads of anchors that have several (from 0 up)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, data in _grouped(batches):
            if bucket < 0:
                yield from _batch((bucket, x) for x in data)
                continue
            first, copies = _first(_unpacked(data, _FRAGMENT))
            yield from _batch(_packed(copies, _home(copies["doc"], homes)))
            _, at, kinds = np.unique(first["anchor"], return_inverse=True, return_counts=True)
            many = kinds[at] > 1
            heads = np.empty(int(many.sum()), _HEAD)
            for c in ("doc", "start", "n", "lead", "anchor"):
                heads[c] = first[c][many]
            heads["kinds"] = kinds[at][many]
            yield from _batch(_packed(heads, -1 - _home(heads["doc"], homes)))

    return run


def _by_doc(kind: np.dtype):
    """One row for each document, with its own rows of a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data in _grouped(batches):
            rows = _unpacked(data, kind)
            yield from _batch(_packed(rows[np.lexsort((rows["start"], rows["doc"]))], np.sort(rows["doc"])), _HEADS)

    return run


def _cut(length: int, shard: int):
    """The bytes of each head, with the shard's share it is dealt to: by anchor, or by the core of a step where heads are many."""
    core = length - STEP + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, data, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch.column(2)), strict=True):
                for _, start, n, lead, kinds, anchor in _unpacked([data], _HEAD).tolist():
                    piece = text[start : start + n + length - 1]
                    if kinds * 2 * length <= shard:
                        rows.append((anchor - (1 << 63), doc, start, piece))
                        continue
                    # Step k has the starts that stand k * STEP to k * STEP + STEP - 1 bytes before the anchor; all their strings hold its core.
                    for k in range((lead - n + 1) // STEP, lead // STEP + 1):
                        far, near = min(lead, k * STEP + STEP - 1), max(lead - n + 1, k * STEP)
                        held = piece[lead - k * STEP : lead - k * STEP + core]
                        rows.append((xxhash.xxh64_intdigest(held, k) - (1 << 63), doc, start + lead - far, piece[lead - far : lead - near + length]))
            if rows:
                yield record_batch(_PIECES, *map(list, zip(*rows, strict=True)))

    return run


def _types(s: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one, as the next differing symbol tells."""
    differs = s[:-1] != s[1:]
    at = np.flatnonzero(differs)
    small = np.ones(len(s), bool)
    small[:-1] = (s[at] < s[at + 1])[np.cumsum(differs) - differs]
    return small


def _places(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A stable order by symbol, and of each distinct symbol: itself, its first place in that order, its number."""
    order = np.argsort(symbols, kind="stable")
    symbols = symbols[order]
    first = np.flatnonzero(np.concatenate([[True], symbols[1:] != symbols[:-1]]))
    return order, symbols[first], first, np.diff(np.append(first, len(symbols)))


def _induced(s: np.ndarray, small: np.ndarray, seeds: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All suffixes, induced from the leftmost-smaller ones in the order given: larger ones from left to right, smaller ones back.

    Buckets are walked symbol by symbol. What stands in a bucket induces its predecessors all at once; those of the
    same symbol come into the bucket behind, and induce in their turn.
    """
    sa = np.full(len(s), -1, np.int32)
    ends = np.cumsum(count)
    starts = ends - count
    order, symbols, first, sizes = _places(s[seeds])
    seeded = ends.copy()
    seeded[symbols] -= sizes
    sa[np.arange(len(seeds)) + np.repeat(seeded[symbols] - first, sizes)] = seeds[order]
    head, used = starts.copy(), np.flatnonzero(count).tolist()

    def ahead(batch: np.ndarray) -> None:
        at = batch[batch > 0] - 1
        at = at[~small[at]]
        if len(at):
            order, symbols, first, sizes = _places(s[at])
            sa[np.arange(len(at)) + np.repeat(head[symbols] - first, sizes)] = at[order]
            head[symbols] += sizes

    for c in used:
        i = starts[c]
        while i < head[c]:
            i, e = head[c], i
            ahead(sa[e:i])
        if seeded[c] < ends[c]:
            ahead(sa[seeded[c] : ends[c]])
    tail = ends.copy()
    sa[0], tail[0] = len(s) - 1, 0

    def back(batch: np.ndarray) -> None:
        at = batch[batch > 0] - 1
        at = at[small[at]]
        if len(at):
            order, symbols, first, sizes = _places(s[at])
            sa[np.repeat(tail[symbols] - 1 + first, sizes) - np.arange(len(at))] = at[order]
            tail[symbols] -= sizes

    for c in reversed(used):
        i = ends[c]
        while i > tail[c]:
            i, e = tail[c], i
            back(sa[i:e][::-1])
        if starts[c] < head[c]:
            back(sa[starts[c] : head[c]][::-1])
    return sa


def _doubled(s: np.ndarray) -> np.ndarray:
    """The suffix array of a string of many symbols, by doubling: there a bucket holds too few to induce at once."""
    rank, step, n = s.astype(np.int64) + 1, 1, len(s)
    while True:
        key = rank * (n + 2)
        key[: n - step] += rank[step:] if step < n else 0
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        if new.all():
            return order.astype(np.int32)
        step *= 2


def suffix_array(s: np.ndarray, size: int) -> np.ndarray:
    """The suffix array of s (int32) by induced sorting. s ends with its only 0; its symbols are below `size`."""
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int32)
    small = _types(s)
    leftmost = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(np.int32)
    count = np.bincount(s, minlength=size)
    if len(leftmost) > 1:
        sa = _induced(s, small, leftmost, count)
        is_leftmost = np.zeros(n, bool)
        is_leftmost[leftmost] = True
        order = sa[is_leftmost[sa]]
        # Substrings from one leftmost-smaller suffix to the next, in their order, get equal names if they are equal.
        sizes = np.zeros(n, np.int32)
        sizes[leftmost] = np.diff(np.append(leftmost, n - 1)) + 1
        a, b = order[:-1], order[1:]
        same = sizes[a] == sizes[b]
        open_, k = np.flatnonzero(same), 0
        while len(open_):
            hit = s[a[open_] + k] == s[b[open_] + k]
            same[open_[~hit]] = False
            k += 1
            open_ = open_[hit]
            open_ = open_[sizes[a[open_]] > k]
        names = np.empty(n, np.int32)
        names[order] = np.concatenate([[0], np.cumsum(~same)])
        reduced = names[leftmost]
        kinds = int(reduced.max()) + 1
        if kinds < len(leftmost):
            leftmost = leftmost[suffix_array(reduced, kinds) if kinds <= len(reduced) // 64 else _doubled(reduced)]
        else:
            leftmost = order
    return _induced(s, small, leftmost, count)


def common_prefixes(s: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each suffix, in the order of the text, the length it shares with its predecessor in the suffix array.

    Symbols 0 and 1 end a piece and are shared with nothing. Where the symbols before both are equal, the length is
    one less than that of the suffix before; only elsewhere are symbols compared.
    """
    n = len(s)
    before = np.full(n, -1, np.int32)
    before[sa[1:]] = sa[:-1]
    i = np.arange(n, dtype=np.int32)
    own = (before <= 0) | (i == 0)
    own |= (s[i - 1] != s[np.maximum(before, 1) - 1]) | (s[i - 1] <= 1)
    length = np.zeros(n, np.int32)
    open_, k = i[own & (before >= 0)], 0
    while len(open_):
        x = s[open_ + k]
        open_ = open_[(x > 1) & (x == s[before[open_] + k])]
        k += 1
        length[open_] = k
    last = np.maximum.accumulate(np.where(own, i, 0))
    return length[last] - (i - last)


def shard_repeats(docs: np.ndarray, starts: np.ndarray, pieces: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all places of the pieces laid end to end, each with one place behind it: whether its string of `length` bytes
    lies in its piece; whether it also starts before, by doc and start, in another; its piece."""
    text = np.frombuffer(b"\0".join(pieces) + b"\0\0", np.uint8).astype(np.int32) + 2
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) + 1
    ends = np.cumsum(sizes)
    text[ends - 1] = 1
    text[-1] = 0
    piece = np.repeat(np.arange(len(pieces)), sizes)
    at = np.arange(len(text) - 1)
    whole = ends[piece] - 1 - at >= length
    sa = suffix_array(text, 258)
    shared = common_prefixes(text, sa)
    group = np.cumsum(shared[sa] < length)
    mine = np.append(whole, False)[sa]
    order, group = sa[mine], group[mine]
    many = np.zeros(len(order), bool)
    many[1:] = group[1:] == group[:-1]
    many[:-1] |= many[1:]
    order, group = order[many], group[many]
    own = piece[order]
    doc, start = docs[own], starts[own] + order - (ends - sizes)[own]
    ranked = np.lexsort((start, doc, group))
    order, group = order[ranked], group[ranked]
    later = np.concatenate([[False], group[1:] == group[:-1]]) if len(group) else np.empty(0, bool)
    gone = np.zeros(len(at), bool)
    gone[order[later]] = True
    return whole, gone, piece


def _runs(mask: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and number of each run of marked places."""
    at = np.flatnonzero(mask)
    cut = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (piece[at[1:]] != piece[at[:-1]])])) if len(at) else np.empty(0, np.int64)
    return at[cut], np.diff(np.append(cut, len(at)))


def _sorted_shards(length: int, most: int, homes: int):
    """Pieces come in the order of deals; whole deals are gathered into shards of about `most` symbols.

    A deal that overflows a shard by itself is worked off in parts: the strings that a part leaves stay for the next.
    """

    def settle(held: list[tuple]) -> tuple[np.ndarray, list[tuple]]:
        docs, starts = np.array([h[0] for h in held], np.int64), np.array([h[1] for h in held], np.int64)
        pieces = [h[2] for h in held]
        whole, gone, piece = shard_repeats(docs, starts, pieces, length)
        offsets = np.cumsum([0, *(len(p) + 1 for p in pieces)])
        at, n = _runs(gone, piece)
        out = np.empty(len(at), _STRETCH)
        out["doc"], out["start"], out["n"] = docs[piece[at]], starts[piece[at]] + at - offsets[piece[at]], n
        at, n = _runs(whole & ~gone, piece)
        own = piece[at]
        left = zip(docs[own].tolist(), (starts[own] + at - offsets[own]).tolist(), own.tolist(), (at - offsets[own]).tolist(), n.tolist(), strict=True)
        return out, [(d, s, pieces[p][a : a + m + length - 1]) for d, s, p, a, m in left]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, deal, limit = [], 0, None, most
        for batch in batches:
            for c, d, s, piece in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if size > limit or (c != deal and size > most):
                    out, left = settle(held)
                    yield from _batch(_packed(out, _home(out["doc"], homes)))
                    held = left if c == deal else []
                    size = sum(len(x[2]) + 1 for x in held)
                    limit = max(2 * most, 2 * size)
                deal = c
                held.append((d, s, piece))
                size += len(piece) + 1
                limit = max(limit, 2 * most)
        if held:
            out, _ = settle(held)
            yield from _batch(_packed(out, _home(out["doc"], homes)))

    return run


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard: int = SHARD) -> DataFrame:
    """doc, stretches (packed): starts of strings of `length` bytes that also start earlier, in stretches. docs: doc (distinct), text."""
    if length - gram > 254:
        raise ValueError("a fragment's starts are counted in a byte")
    spark = docs.sparkSession
    frags = max(1, (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) * 2 // (length - gram))
    buckets, homes = -(-frags // BUCKET), -(-frags // BUCKET)
    grouped = lambda df: df.repartition("bucket").sortWithinPartitions("bucket")
    # Negative buckets: stretches of copies, by document. Others: first heads by anchor, and then by document.
    dealt = docs.select("doc", "text").mapInArrow(trimmed(_fragments(length, gram, buckets, homes)), _PACKED_DDL)
    found = materialize(grouped(dealt).mapInArrow(trimmed(_heads(homes)), _PACKED_DDL), "fragments")
    release_shuffles(spark)
    heads = grouped(found.where("bucket >= 0")).mapInArrow(_by_doc(_HEAD), "doc long, data binary")
    pieces = heads.join(docs.hint("merge"), "doc").select("doc", "data", "text").mapInArrow(_cut(length, shard), "deal long, doc long, start int, piece binary")
    settled = materialize(pieces.repartition("deal").sortWithinPartitions("deal", "doc", "start").mapInArrow(trimmed(_sorted_shards(length, shard, homes)), _PACKED_DDL), "settled")
    release_shuffles(spark)
    all_ = found.where("bucket < 0").unionByName(settled)
    out = materialize(grouped(all_).mapInArrow(_by_doc(_STRETCH), "doc long, data binary"), "repeats")
    for table in (found, settled):
        discard(table)
    release_shuffles(spark)
    return out


def _kept(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[], [], [], [], []]
            for text, data in zip(texts_of(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                spans: list[list[int]] = []
                for _, start, n in _unpacked([data], _STRETCH).tolist() if data else ():
                    if spans and start <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], start + n - 1 + length)
                    else:
                        spans.append([start, start + n - 1 + length])
                digest, at = hashlib.sha256(), 0
                for a, b in spans:
                    digest.update(text[at:a])
                    at = b
                digest.update(text[at:])
                for row, x in zip(rows, (len(text), sum(b - a for a, b in spans), len(spans), digest.hexdigest(), [{"start": a, "end": b} for a, b in spans]), strict=True):
                    row.append(x)
            yield record_batch(_KEPT, batch.column(0), *rows)

    return run


def _numbered(docs: DataFrame) -> DataFrame:
    """doc (distinct, in the order of documents), doc_id, text. Where doc_ids are not distinct, rows are numbered."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    if not ids.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count():
        return ids.select(F.col("doc_id").alias("doc"), "doc_id", "text")
    docs, key = row_key(docs)
    rows = docs.select(*key, F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # After a sort into ranges the ids that rise from task to task and row to row are the order.
    order = rows.select("file", "row", "doc_id").orderBy(F.asc_nulls_last("doc_id"), "file", "row").select("file", "row", F.monotonically_increasing_id().alias("doc"))
    return materialize(rows.join(materialize(order, "order").hint("merge"), ["file", "row"]).select("doc", "doc_id", "text"), "documents")


def dedupe_substrings(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard: int = SHARD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (start, end) of each row of docs.

    Removed is every byte of a text, in UTF-8, that a string of `length` bytes covers which also starts earlier: in a
    document with a smaller doc_id, or before in the same text. Strings are judged on the input. Null and empty texts
    have no bytes; texts shorter than `length` stay whole; long ones are read whole. A null doc_id comes last in the
    order; rows of one doc_id are documents of their own, in the order of their files and places; an empty table
    gives no rows; extra columns are ignored.
    """
    docs = _numbered(docs)
    both = docs.join(repeats(docs.select("doc", "text"), length, gram, shard).hint("merge"), "doc", "left").select("doc_id", "text", "data")
    return both.mapInArrow(_kept(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>")
