"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard, shard results merged.

Shards hold a bounded number of distinct vectors each. A shard's graph is built layer by layer in bulk: candidates
from blocked matrix products, thinned by the diversity rule, with links in both directions, as flat arrays of
neighbours. Queries walk all shards' graphs in blocks, many queries at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.llm.common import mix, record_batch
from tallyfold.plans.materialize import materialize

#: Distinct vectors in a shard (about), links of a node above and in the lowest layer, candidates for links.
SHARD, LINKS, LINKS0, CANDIDATES = 16_384, 16, 32, 48
#: Nodes a search keeps, nodes it expands at a time, queries in a block.
BEAM, EXPAND, QUERIES = 160, 4, 512

_BLOCK = pa.schema([("size", pa.int32()), ("query_ids", pa.binary()), ("data", pa.binary())])
_NODE = pa.schema([("shard", pa.int32()), ("ids", pa.list_(pa.int64())), ("data", pa.binary())])
_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _candidates(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k most similar other rows of each row of x, most similar first."""
    n = len(x)
    near, sim = np.empty((n, k), np.int64), np.empty((n, k), np.float32)
    for a in range(0, n, 1024):
        s = x[a : a + 1024] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        part = np.argpartition(s, n - k - 1 if n > k else 0, axis=1)[:, -k:] if n > k else np.argsort(s, axis=1)[:, -k:]
        v = np.take_along_axis(s, part, 1)
        order = np.argsort(-v, axis=1, kind="stable")
        near[a : a + 1024], sim[a : a + 1024] = np.take_along_axis(part, order, 1), np.take_along_axis(v, order, 1)
    return near, sim


def _layer(x: np.ndarray, links: int) -> np.ndarray:
    """Neighbours of each row, as a flat array of `links` to a row, -1 where there are fewer."""
    n = len(x)
    if n <= links + 1:
        all_ = np.tile(np.arange(n), (n, 1))
        others = all_[all_ != np.arange(n)[:, None]].reshape(n, n - 1) if n > 1 else np.empty((n, 0), np.int64)
        return np.pad(others, ((0, 0), (0, links - others.shape[1])), constant_values=-1).astype(np.int32)
    near, sim = _candidates(x, min(CANDIDATES, n - 1))
    kept = np.zeros(near.shape, bool)
    for a in range(0, n, 512):
        y = x[near[a : a + 512]]
        between = y @ y.transpose(0, 2, 1)
        own, keep = sim[a : a + 512], kept[a : a + 512]
        for j in range(near.shape[1]):  # a candidate that is nearer to a kept one than to the node is left out
            clash = (between[:, j, :j] > own[:, j, None]) & keep[:, :j]
            keep[:, j] = ~clash.any(axis=1) & (keep[:, :j].sum(axis=1) < links // 2)
    short = kept.sum(axis=1) < links // 2  # fill up with the nearest
    for i in np.flatnonzero(short).tolist():
        kept[i, np.flatnonzero(~kept[i])[: links // 2 - int(kept[i].sum())]] = True
    src, col = np.nonzero(kept)
    dst, s = near[src, col], sim[src, col]
    edge = np.concatenate([src * n + dst, dst * n + src])
    edge, first = np.unique(edge, return_index=True)
    s = np.concatenate([s, s])[first]
    src, dst = edge // n, edge % n
    order = np.lexsort((-s, src))
    src, dst = src[order], dst[order]
    place = np.arange(len(src)) - np.searchsorted(src, src)
    out = np.full((n, links), -1, np.int32)
    fits = place < links
    out[src[fits], place[fits]] = dst[fits]
    return out


def _joined(x: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """The lowest layer with a link, in its last place, from the largest part's nodes to every part it does not reach."""
    n = len(x)
    while True:
        seen, front = np.zeros(n, bool), np.array([0])
        seen[0] = True
        while len(front):
            to = np.unique(flat[front])
            front = to[to >= 0][~seen[to[to >= 0]]]
            seen[front] = True
        lost = np.flatnonzero(~seen)
        if not len(lost):
            return flat
        start, reached = lost[0], np.flatnonzero(seen)
        free = reached[np.argsort(-(x[reached] @ x[start]), kind="stable")]
        spare = free[(flat[free] < 0).any(axis=1)]
        if not len(spare):
            flat = np.pad(flat, ((0, 0), (0, 1)), constant_values=-1)
            spare = free
        flat[spare[0], np.flatnonzero(flat[spare[0]] < 0)[0]] = start


class Graph:
    """A hierarchical navigable small-world graph of distinct vectors, for the largest inner products."""

    def __init__(self, vectors: np.ndarray):
        self.exact = vectors
        norm = np.sqrt((vectors**2).sum(axis=1))
        scale = norm.max()
        self.x = (vectors / scale).astype(np.float32)
        # One more component makes all norms equal: the order of inner products becomes that of distances.
        flat = np.concatenate([self.x, np.sqrt(np.maximum(0, 1 - (norm / scale) ** 2)).astype(np.float32)[:, None]], axis=1)
        n = len(vectors)
        unit = (mix(np.arange(1, n + 1, dtype=np.uint64)) >> np.uint64(11)).astype(np.float64) / 2.0**53
        level = np.floor(-np.log(np.maximum(unit, 1e-18)) / np.log(LINKS)).astype(np.int64)
        level[np.argmax(level)] = max(1, level.max())
        self.layers: list[tuple[np.ndarray, np.ndarray]] = []  # members, neighbours by place among the members
        for k in range(level.max() + 1):
            members = np.flatnonzero(level >= k)
            near = _layer(flat[members], LINKS if k else LINKS0)
            self.layers.append((members, near if k else _joined(flat, near)))

    def _walk(self, q: np.ndarray, k: int, start: np.ndarray, beam: int) -> np.ndarray:
        """The best `beam` members of layer k for each query, from start (places; -1: none), best first, -1 at the end."""
        members, near = self.layers[k]
        x, b = self.x[members], len(q)
        rows = np.arange(b)[:, None]
        seen = np.zeros((b, len(members) + 1), bool)
        seen[:, -1] = True
        ids, score = np.full((b, beam), -1), np.full((b, beam), -np.inf, np.float32)
        done = np.ones((b, beam), bool)
        new = start
        while True:
            new = np.sort(np.where(seen[rows, new], -1, new), axis=1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
            seen[rows, new] = True
            new = new[:, (new >= 0).any(axis=0)]
            value = np.where(new >= 0, np.einsum("bnd,bd->bn", x[new], q), -np.inf).astype(np.float32)
            ids = np.concatenate([ids, new], axis=1)
            score = np.concatenate([score, value], axis=1)
            done = np.concatenate([done, new < 0], axis=1)
            if ids.shape[1] > beam:
                best = np.argpartition(-score, beam - 1, axis=1)[:, :beam]
                ids, score, done = (np.take_along_axis(v, best, 1) for v in (ids, score, done))
            open_ = np.where(done, -np.inf, score)
            pick = np.argpartition(-open_, min(EXPAND, beam) - 1, axis=1)[:, :EXPAND]
            live = np.take_along_axis(open_, pick, 1) > -np.inf
            if not live.any():
                break
            np.put_along_axis(done, pick, True, 1)
            node = np.where(live, np.take_along_axis(ids, pick, 1), 0)
            new = np.where(live[:, :, None], near[node], -1).reshape(b, -1)
        order = np.argsort(-score, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1)

    def search(self, queries: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """Nodes near each query, best first, -1 where there are fewer than `beam`."""
        q = queries.astype(np.float32)
        at = np.zeros((len(q), 1), np.int64)
        for k in range(len(self.layers) - 1, -1, -1):
            found = self._walk(q, k, at, beam if k == 0 else min(beam, 8))
            if k:
                below = self.layers[k - 1][0]
                at = np.where(found >= 0, np.searchsorted(below, self.layers[k][0][np.maximum(found, 0)]), -1)
        return found


def _best(graph: Graph, ids: list[np.ndarray], queries: np.ndarray, query_ids: np.ndarray, k: int, beam: int) -> Iterator[tuple[int, int, float]]:
    found = graph.search(queries, beam)[:, : k + 1]
    hit = found >= 0
    score = np.where(hit, np.einsum("bnd,bd->bn", graph.exact[found], queries), -np.inf)
    for i, (nodes, values) in enumerate(zip(found, score, strict=True)):
        own = [(-v, int(j)) for n, v in zip(nodes.tolist(), values.tolist(), strict=True) if n >= 0 for j in ids[n] if j != query_ids[i]]
        yield from ((int(query_ids[i]), j, -v) for v, j in sorted(own)[:k])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Queries of one length, packed: every shard gets blocks of them, not rows."""
    for batch in batches:
        sizes = batch.column(1).to_numpy()
        ids, values = batch.column(0).to_numpy(), batch.column(2).to_pylist()
        rows = []
        for size in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == size)
            for a in range(0, len(at), QUERIES):
                own = at[a : a + QUERIES]
                rows.append((size, ids[own].astype("<i8").tobytes(), np.array([values[i] for i in own], "<f8").tobytes()))
        if rows:
            yield record_batch(_BLOCK, *map(list, zip(*rows, strict=True)))


def _shards(k: int, beam: int):
    """Rows come in the order of shards, each shard's nodes (ids a list, one vector) before its blocks of queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, graph, nodes, ids = None, None, [], []
        for batch in batches:
            for at, is_query, own, query_ids, data in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                if at != shard:
                    shard, graph, nodes, ids = at, None, [], []
                if not is_query:
                    nodes.append(np.frombuffer(data, "<f8"))
                    ids.append(np.array(own))
                elif nodes:
                    graph = graph or Graph(np.stack(nodes))
                    asked = np.frombuffer(query_ids, "<i8")
                    rows = list(_best(graph, ids, np.frombuffer(data, "<f8").reshape(len(asked), -1), asked, k, beam))
                    if rows:
                        yield record_batch(_FOUND, *map(list, zip(*rows, strict=True)))

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes with their vectors as bytes."""
    for batch in batches:
        yield record_batch(_NODE, batch.column(0), batch.column(1), [np.array(v, "<f8").tobytes() for v in batch.column(2).to_pylist()])


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, shard: int = SHARD, beam: int = BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: the k vectors of largest inner product found for each query, nearest first.

    vectors: vec_id, embedding. Queries are the rows whose vec_id is divisible by `every`; a row is no candidate for
    itself. Scores are in double precision on the vectors as given; ties go to the smaller vec_id; a query with
    fewer candidates than k gets all that are found. Null and zero vectors, those with null or non-finite
    components, and null vec_ids take no part. Vectors of unequal lengths have no inner product: each length is
    searched by itself. A vec_id that is repeated is a candidate with each of its vectors, of which the nearest
    counts; as a query it asks with the least. Equal vectors are one node, with the k + 1 smallest of their ids, which
    are all that can be returned. An empty table gives no rows; extra columns are ignored.

    A shard's graph is built at once, layer by layer, from the nearest of all its vectors by blocked products, not
    vector by vector through searches: that is exact where insertion is approximate, and bounded by the shard.
    """
    whole = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(
        "vec_id is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)"
    )
    rows = materialize(whole.withColumns({"size": F.size("v"), "h1": F.xxhash64("v"), "h2": F.xxhash64("v", F.lit(1))}), "vectors")
    # One row a vector, of as many bytes as a node's ids need: the k + 1 smallest, kept by rank within the equal ones.
    ids = rows.select("size", "h1", "h2", "vec_id").distinct()
    kept = ids.withColumn("nth", F.row_number().over(Window.partitionBy("size", "h1", "h2").orderBy("vec_id"))).where(F.col("nth") <= k + 1)
    lists = kept.groupBy("size", "h1", "h2").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    firsts = rows.groupBy("size", "h1", "h2").agg(F.min("v").alias("v"))
    nodes = materialize(firsts.join(lists, ["size", "h1", "h2"]).select("size", "h1", "ids", "v"), "nodes")
    spread, total = [], 0
    for row in nodes.groupBy("size").agg(F.count("*").alias("n")).orderBy("size").collect():  # one row a length
        n = -(-row["n"] // shard)
        spread.append((row["size"], total, n))
        total += n
    lengths = F.broadcast(vectors.sparkSession.createDataFrame(spread, "size int, first int, shards int"))
    place = (F.col("first") + F.pmod(F.col("h1"), F.col("shards"))).cast("int")
    none = F.lit(None).cast("binary")
    sharded = nodes.join(lengths, "size").select(place.alias("shard"), "ids", "v").mapInArrow(_packed, "shard int, ids array<long>, data binary")
    sharded = sharded.select("shard", F.lit(False).alias("is_query"), "ids", none.alias("query_ids"), "data")
    # A stated query set, every `every`th row, against all shards of its length, in blocks.
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min_by(F.struct("size", "v"), F.struct("v")).alias("x")).select("vec_id", "x.size", "x.v")
    asked = asked.mapInArrow(_blocks, "size int, query_ids binary, data binary").join(lengths, "size")
    asked = asked.withColumn("shard", F.explode(F.sequence("first", F.col("first") + F.col("shards") - 1)))
    asked = asked.select("shard", F.lit(True).alias("is_query"), F.lit(None).cast("array<long>").alias("ids"), "query_ids", "data")
    found = (
        sharded.unionByName(asked)
        .repartitionById(max(1, total), F.col("shard"))  # a shard is a task: numbers, not hashes, which would collide
        .sortWithinPartitions("shard", "is_query")
        .mapInArrow(_shards(k, beam), "query_id long, vec_id long, score double")
    )
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
