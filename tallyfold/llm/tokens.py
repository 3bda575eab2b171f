"""Token counts under a unigram model, by dynamic programming over a trie of distinct pre-tokens.

The best score of a prefix does not depend on what follows it. Distinct pre-tokens are inserted in a trie, forward
scores are computed once for each prefix that they share, and terminals store the counts. The vocabulary and its
ranks are a public tokenizer's, and tokenizers are never trained: its scores are those of Zipf's law over the ranks.
"""

from __future__ import annotations

import base64
import functools
import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.bpe import CACHE_WORDS, PATTERN
from tallyfold.llm.common import Recent, record_batch, uncollected

#: Nodes of a task's trie, about 100 bytes each.
NODES = 1 << 19

_COUNTS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64()), ("log_prob", pa.float64())])


class UnigramTrie:
    """A vocabulary of byte strings by rank, with Zipf's probabilities: that of a rank is as 1 / (rank + 1).

    The trie holds the pre-tokens seen: each node the forward score of its prefix and that segmentation's tokens, each
    terminal the counts of its pre-token. A node is computed once, whatever pre-tokens pass through it.
    """

    def __init__(self, ranks: dict[bytes, int]):
        total = math.log(math.fsum(1 / (r + 1) for r in ranks.values()))
        self.score = {w: -math.log(r + 1) - total for w, r in ranks.items()}
        #: Scores of the vocabulary; None for what only ends some of its strings: no string that ends so stands farther back.
        self.ends: dict[bytes, float | None] = {w[k:]: None for w in ranks for k in range(1, len(w))} | self.score
        self.cut = regex.compile(PATTERN)
        self.loose = regex.compile(r" (?:\s|\Z)")
        self.cache: Recent = Recent(CACHE_WORDS)
        self._clear()

    def _clear(self) -> None:
        self.edges: dict[int, int] = {}  # node * 256 + byte: node
        self.forward, self.fewest = [0.0], [0]  # by node: the forward score, and its segmentation's tokens
        self.terminals: dict[bytes, tuple[int, int, float]] = {}

    def insert(self, words: Iterable[bytes]) -> dict[bytes, tuple[int, int, float]]:
        """The terminals, among them each of the words: 1, the tokens and the score of its best segmentation; of equal scores, that of fewest tokens.

        Words are inserted in order, so that what a word shares with the one before it is at hand. The trie is shared
        by all calls of a task, and begun anew when it is large.
        """
        if len(self.forward) > NODES:
            self._clear()
        edges, forward, fewest, terminals, ends = self.edges, self.forward, self.fewest, self.terminals, self.ends
        nodes, before = [0], b""
        for word in sorted({w for w in words if w not in terminals}):
            size = len(word)
            at, most = 0, min(size, len(before))
            while at < most and word[at] == before[at]:
                at += 1
            del nodes[at + 1 :]
            before, node = word, nodes[at]
            while at < size:
                after = edges.get(node << 8 | word[at])
                if after is None:
                    break
                node = after
                nodes.append(node)
                at += 1
            for end in range(at + 1, size + 1):
                top, few = -math.inf, 0
                for start in range(end - 1, -1, -1):
                    s = ends.get(word[start:end], 0.0)
                    if s is None:
                        continue
                    if s == 0.0:
                        break
                    back = nodes[start]
                    s += forward[back]
                    if s >= top and (s > top or fewest[back] < few - 1):
                        top, few = s, fewest[back] + 1
                edges[node << 8 | word[end - 1]] = node = len(forward)
                nodes.append(node)
                forward.append(top)
                fewest.append(few)
            terminals[word] = (1, fewest[node], forward[node])
        return terminals

    def _learn(self, units: set[str | bytes]) -> None:
        """The counts of units into the cache: texts without the space before them, and pre-tokens as bytes."""
        cut, cache = self.cut.findall, self.cache
        plain, others = {}, {}
        for u in units:
            if type(u) is bytes:
                plain[u] = u
            elif u.isalpha():  # letters behind a space are one pre-token
                plain[u] = b" " + u.encode()
            else:
                others[u] = [w.encode() for w in cut(" " + u)]
        known = self.insert([*plain.values(), *(w for x in others.values() for w in x)])
        cache.update((u, known[w]) for u, w in plain.items())
        for unit, own in others.items():
            got = [known[w] for w in own]
            cache[unit] = got[0] if len(got) == 1 else (len(own), sum([g[1] for g in got]), math.fsum([g[2] for g in got]))

    @uncollected()
    def counts(self, texts: list[str]) -> list[tuple[int, int, float]]:
        """Pre-tokens, tokens and score of each text."""
        self.cache.age()
        parts: list[list[str | bytes]] = []
        for text in texts:
            if self.loose.search(text):
                parts.append([w.encode() for w in self.cut.findall(text)])
            else:  # a pre-token starts at every space that something other than white space follows
                head, *rest = text.split(" ")
                parts.append(rest + [w.encode() for w in self.cut.findall(head)])
        if missing := self.cache.missing(set().union(*parts)):
            self._learn(missing)
        cache = self.cache
        out = []
        for x in parts:
            words, tokens, scores = zip(*map(cache.__getitem__, x), strict=True) if x else ((), (), ())
            out.append((sum(words), sum(tokens), math.fsum(scores)))
        return out


@functools.lru_cache(maxsize=4)
def trie(path: str) -> UnigramTrie:
    with open(path, "rb") as f:
        return UnigramTrie({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_words, n_tokens, log_prob of each row of docs: pre-tokens, and tokens and score of the best segmentation.

    path: a file of byte strings in base64 with their ranks; all single bytes are among them. Null and empty texts
    count 0 of each; repeated rows and null doc_ids stay; extra columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = trie(path)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for at in range(0, len(texts), 512):
                group = texts[at : at + 512]
                yield record_batch(_COUNTS, batch.column(0).slice(at, len(group)), *map(list, zip(*model.counts(group), strict=True)))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_tokens long, log_prob double")
