"""Byte-level BPE by speculation and verification.

Greedy longest match proposes tokens for each distinct pre-token. A proposal is the true encoding exactly if every
token is one that merging reaches and no adjacent pair would have merged across its border first; a vectorised
check tests all distinct pairs of a batch at once. Only pre-tokens that fail are merged exactly.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import record_batch, trimmed, uncollected

#: Fixed value: the byte-level pre-tokeniser's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words that a task remembers; beyond that it starts anew, which changes no result.
CACHE_WORDS = 300_000
_NEVER = np.iinfo(np.int64).max


@functools.cache
def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary: itself, or the next free one from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


class ByteBPE:
    """One vocabulary file of the tokenizers library, with kind byte-level BPE."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        names = spec["model"]["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*names.values(), *special.values()]) + 1
        self.words_of: list[bytes] = [b""] * size
        for name, i in names.items():
            self.words_of[i] = bytes(byte_of[c] for c in name)
        for name, i in special.items():
            self.words_of[i] = name.encode()
        self.special = special
        self.special_at = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(special, key=len, reverse=True)) + ")") if special else None
        self.cut = regex.compile(PATTERN)
        self.id_of = {self.words_of[i]: i for i in names.values()}
        self.base = [self.id_of[bytes([b])] for b in range(256)]
        self.longest = max(map(len, self.id_of))
        self.longest_by: dict[bytes, int] = {}
        for word in self.id_of:
            self.longest_by[word[:2]] = max(len(word), self.longest_by.get(word[:2], 0))
        self._merges(spec["model"]["merges"], names, size)
        self.known: dict[int, bool] = {}
        self.loose = regex.compile(r" (?:\s|\Z)")
        self.cache: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}

    def _merges(self, merges: list, names: dict, size: int) -> None:
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in merges]
        left = np.array([names[a] for a, _ in pairs], np.int64)
        right = np.array([names[b] for _, b in pairs], np.int64)
        made = np.array([names[a + b] for a, b in pairs], np.int64)
        keys = left << 20 | right
        order = np.argsort(keys, kind="stable")
        self.pair_keys, self.pair_ranks = keys[order], order.astype(np.int64)
        self.rank_of = {(int(a), int(b)): (k, int(c)) for k, (a, b, c) in reversed(list(enumerate(zip(left, right, made, strict=True))))}
        born = np.full(size, -1, np.int64)
        halves = np.full((2, size), -1, np.int64)
        born[made[::-1]] = np.arange(len(made))[::-1]  # of two merges that make a token, the earlier one counts
        halves[0][made[::-1]], halves[1][made[::-1]] = left[::-1], right[::-1]
        self.born = born
        # Pieces that stand at a token's right and left border while it is built, from the whole token down to a byte,
        # with the merge that ends each.
        self.spines = []
        for half in (halves[1], halves[0]):
            piece, end = np.arange(size), np.full(size, _NEVER)
            pieces, ends = [], []
            while (piece >= 0).any():
                pieces.append(piece)
                ends.append(end)
                end = np.where(piece >= 0, born[piece], -1)
                piece = np.where(piece >= 0, half[piece], -1)
            self.spines.append((np.stack(pieces, 1), np.stack(ends, 1)))
        self.sound = self._sound(halves, born)

    def _sound(self, halves: np.ndarray, born: np.ndarray) -> np.ndarray:
        """Whether merging a token's own bytes gives that token."""
        sound = born < 0
        made = np.flatnonzero(born >= 0)
        first = self._first_clash(halves[0][made], halves[1][made], born[made])
        for i, ok in zip(made[np.argsort(born[made])].tolist(), (first >= born[made])[np.argsort(born[made])].tolist(), strict=True):
            sound[i] = ok and sound[halves[0][i]] and sound[halves[1][i]]
        for i in self.special.values():
            sound[i] = False
        return sound

    def _first_clash(self, a: np.ndarray, b: np.ndarray, until: np.ndarray) -> np.ndarray:
        """The first merge across the border of tokens a and b, both of which end at `until`; never: a large number."""
        (pa_, ea), (pb, eb) = self.spines
        first = np.full(len(a), _NEVER)
        for i in range(pa_.shape[1]):
            x, x_end = pa_[a, i], np.minimum(ea[a, i], until)
            if (x < 0).all():
                break
            for j in range(pb.shape[1]):
                y, y_end = pb[b, j], np.minimum(eb[b, j], until)
                at = np.flatnonzero((x >= 0) & (y >= 0))
                if not len(at):
                    break
                key = x[at] << 20 | y[at]
                k = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
                rank = np.where(self.pair_keys[k] == key, self.pair_ranks[k], _NEVER)
                # Of equal merges the leftmost goes first: one within a's pieces, before the border, wins; one within b's loses.
                hit = (rank < x_end[at]) & (rank <= y_end[at]) & (rank != _NEVER)
                first[at[hit]] = np.minimum(first[at[hit]], rank[hit])
        return first

    def greedy(self, word: bytes) -> list[int]:
        ids, at, n, id_of = [], 0, len(word), self.id_of
        while at < n:
            for size in range(min(self.longest_by.get(word[at : at + 2], 1), n - at), 0, -1):
                i = id_of.get(word[at : at + size])
                if i is not None:
                    ids.append(i)
                    at += size
                    break
        return ids

    def merged(self, word: bytes) -> list[int]:
        """Exact merging with a heap: the lowest rank first, of equal ranks the leftmost."""
        ids = [self.base[b] for b in word]
        n = len(ids)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        rank_of = self.rank_of
        heap = [(rank_of[p][0], k, p) for k in range(n - 1) if (p := (ids[k], ids[k + 1])) in rank_of]
        heapq.heapify(heap)
        while heap:
            _, k, (a, b) = heapq.heappop(heap)
            nxt = after[k]
            if ids[k] != a or nxt >= n or ids[nxt] != b:
                continue
            ids[k], ids[nxt] = rank_of[a, b][1], -1
            after[k] = far = after[nxt]
            if far < n:
                before[far] = k
                if (p := (ids[k], ids[far])) in rank_of:
                    heapq.heappush(heap, (rank_of[p][0], k, p))
            if (back := before[k]) >= 0 and (p := (ids[back], ids[k])) in rank_of:
                heapq.heappush(heap, (rank_of[p][0], back, p))
        return [i for i in ids if i >= 0]

    def _learn(self, words: list[str]) -> None:
        """Encode distinct words into the cache."""
        raw = [w.encode() for w in words]
        ids = [self.greedy(w) for w in raw]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(ids)), sizes)
        inner = owner[1:] == owner[:-1]
        keys = (flat[:-1] << 20 | flat[1:])[inner]
        distinct, place = np.unique(keys, return_inverse=True)
        new = np.array([k for k in distinct.tolist() if k not in self.known], np.int64)
        if len(new):
            fits = self._first_clash(new >> 20, new & 0xFFFFF, np.full(len(new), _NEVER)) == _NEVER
            self.known.update(zip(new.tolist(), fits.tolist(), strict=True))
        good = np.array([self.known[k] for k in distinct.tolist()], bool)
        bad = np.zeros(len(ids), bool)
        bad[owner[~self.sound[flat]]] = True
        if len(keys):
            bad[owner[1:][inner][~good[place]]] = True
        for k in np.flatnonzero(bad).tolist():
            ids[k] = self.merged(raw[k])
        self.cache.update((w, np.array(x, "<u4").tobytes()) for w, x in zip(words, ids, strict=True))
        if len(self.known) > 1_000_000:
            self.known.clear()

    def _spaced(self, units: set[str]) -> None:
        """Encode what follows a single space up to the next one, with that space in front, into its cache."""
        words = {u: self.cut.findall(" " + u) for u in units}
        self._need(w for x in words.values() for w in x)
        cache = self.cache
        self.spaced.update((u, b"".join([cache[w] for w in x])) for u, x in words.items())

    def _need(self, words) -> None:
        cache = self.cache
        if missing := {w for w in words if w not in cache}:
            self._learn(list(missing))

    def _units(self, text: str) -> tuple[list[str], list[str]]:
        """The pre-tokens before the first space, and the stretches between the others.

        A pre-token starts at every space that something other than white space follows, so such stretches can be
        encoded one by one. A text with any other space is cut into pre-tokens throughout.
        """
        if self.loose.search(text):
            return self.cut.findall(text), []
        head, *units = text.split(" ")
        return self.cut.findall(head), units

    @uncollected()
    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        if len(self.spaced) > CACHE_WORDS:
            self.spaced.clear()
        parts: list[list] = []
        for text in texts:
            if self.special_at and self.special_at.search(text):
                parts.append([self.special[x] if x in self.special else self._units(x) for x in self.special_at.split(text)])
            else:
                parts.append([self._units(text)])
        cache, spaced = self.cache, self.spaced
        self._need(w for x in parts for part in x if isinstance(part, tuple) for w in part[0])
        wanted: set[str] = set()
        for x in parts:
            for part in x:
                if isinstance(part, tuple):
                    wanted.update(part[1])
        if missing := wanted.difference(spaced):
            self._spaced(missing)
        out = []
        for x in parts:
            ids = []
            for part in x:
                if isinstance(part, tuple):
                    ids += map(cache.__getitem__, part[0])
                    ids += map(spaced.__getitem__, part[1])
                else:
                    ids.append(part.to_bytes(4, "little"))
            out.append(b"".join(ids))
        return out

    def forget(self) -> None:
        self.cache, self.spaced = {}, {}

    def decode(self, ids: bytes) -> str:
        table = self.words_of
        return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


@functools.lru_cache(maxsize=4)
def tokenizer(path: str) -> ByteBPE:
    return ByteBPE(path)


_ROWS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])
_DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _groups(texts: list, most: int = 1 << 20) -> Iterator[list[str]]:
    group, held = [], 0
    for text in texts:
        group.append(text or "")
        held += len(group[-1])
        if held >= most:
            yield group
            group, held = [], 0
    if group:
        yield group


def _encoded(docs: DataFrame, path: str, digests: bool) -> DataFrame:
    schema = _DIGESTS if digests else _ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            at = 0
            for group in _groups(batch.column(1).to_pylist()):
                ids = bpe.encode_batch(group)
                back = [bpe.decode(x) for x in ids]
                counts = [len(x) // 4 for x in ids]
                out = ([sha(x) for x in ids], [sha(x.encode()) for x in back]) if digests else (ids, back)
                yield record_batch(schema, batch.column(0).slice(at, len(group)), counts, *out)
                at += len(group)
        bpe.forget()  # the worker goes on to other tasks, of other stages too

    kinds = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids binary, decoded string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(trimmed(run), kinds)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32 bits), decoded, of each row.

    path: a byte-level BPE file of the tokenizers library. The strings of its special tokens become those tokens.
    Null and empty texts have no tokens; repeated rows, and null doc_ids, stay; extra columns are ignored; an empty
    table gives no rows. A text of any length is encoded whole.
    """
    return _encoded(docs, path, False)


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode() with its two long columns as digests, cases as there."""
    return _encoded(docs, path, True)
