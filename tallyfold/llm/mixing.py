"""Mix sources to target weights: multinomial draws for each output shard, permuted block indices, a join on blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.llm.common import mix as scramble
from tallyfold.llm.common import record_batch
from tallyfold.plans.materialize import discard, materialize, row_key

#: Words in a block, slots of an output shard, rows in a bucket of a source, buckets in a row of buckets.
BLOCK, SHARD, BUCKET, ROW = 128, 1 << 14, 4_096, 1_024
#: A source gives its words so many times at most.
MOST = 3
SEED = 20_240_601
WORD = r"[^\x20\x09-\x0D]+"
#: Slots of a range of shards up to which counts are drawn; the counts of a larger one would stray by 1 in 30,000 at most.
DRAWN = 900_000_000

_SLOTS = pa.schema([("sid", pa.int32()), ("block", pa.int64()), ("shard", pa.int64()), ("slot", pa.int64()), ("epoch", pa.int32())])
_SLOTS_DDL = "sid int, block long, shard long, slot long, epoch int"
#: Names of a row's key, beside any columns that a table has.
_OWN = ("__mixing_file", "__mixing_row")


def targets(sizes: dict, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST) -> dict:
    """The words each source should give: all sizes' sum, shared by weight; none above `most` times its size.

    sizes: source (None: no source) to words. Sources in order of code points, None last, weigh `weights` in turn.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    out, open_, left = {}, list(order), float(sum(sizes.values()))
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if share * weight[s] > most * sizes[s]]
        if not over:
            return out | {s: share * weight[s] for s in open_}
        for s in over:
            out[s] = float(most * sizes[s])
            left -= out[s]
        open_ = [s for s in open_ if s not in out]
    return out


def _split(left: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    total = int(left.sum())
    if total <= DRAWN:
        return rng.multivariate_hypergeometric(left, n, method="marginals")
    got = np.array([int(x) * n // total for x in left], np.int64)
    rest = np.array([int(x) * n % total for x in left], np.float64)
    got[np.argsort(-rest, kind="stable")[: n - int(got.sum())]] += 1
    return got


def draw(slots: np.ndarray, size: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Of one output shard of `size` slots: each source's slots in the shards before it, and its count in this one.

    The counts are multinomial draws of all shards, on condition that each source's counts add up to its slots: a
    range of shards is halved, and the first half draws its counts from the range's. A shard needs its own path of
    halves only, seeded by the range, so that every task finds its shards' counts by itself.
    """
    left, before = slots.astype(np.int64), np.zeros(len(slots), np.int64)
    lo, hi = 0, max(1, -(-int(left.sum()) // size))
    while hi - lo > 1:
        mid = (lo + hi) // 2
        got = _split(left, (mid - lo) * size, np.random.default_rng([seed, lo, hi]))
        if shard < mid:
            left, hi = got, mid
        else:
            left, lo, before = left - got, mid, before + got
    return before, left


def permute(index: np.ndarray, size: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of range(size), at the given indices: a Feistel network, walked until it is in range."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & low
        for r in range(4):
            salt = np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF)
            left, right = right, left ^ (scramble(right ^ salt) & low)
        out[todo] = left << np.uint64(half) | right
        todo = todo[out[todo] >= size]
    return out.astype(np.int64)


def _drawn(slots: np.ndarray, sizes: np.ndarray, size: int, seed: int):
    """The slots of the output shards that come in. Slot j of a source takes block j mod blocks of the (j div blocks)th permutation.

    slots, sizes: slots and blocks of each source. Within a shard the sources' slots are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                before, n = draw(slots, size, shard, seed)
                sid = np.repeat(np.arange(len(n)), n)
                j = np.arange(len(sid)) - np.repeat(np.cumsum(n) - n, n) + before[sid]
                epoch, block = j // sizes[sid], np.empty_like(j)
                for s, e in {*zip(sid.tolist(), epoch.tolist(), strict=True)}:
                    own = (sid == s) & (epoch == e)
                    block[own] = permute(j[own] % sizes[s], int(sizes[s]), seed * 1_000_003 + s * MOST + e)
                place = permute(np.arange(len(sid)), len(sid), seed + shard) if len(sid) else j
                yield record_batch(_SLOTS, sid, block, np.full(len(sid), shard), shard * size + place, epoch)

    return run


class Mix:
    """A mixing plan for docs: where each row's words lie in its source, and which slots of the output take them."""

    def __init__(self, docs: DataFrame, key: list[Column], weights: tuple[int, ...] = (1, 2, 3), block: int = BLOCK, shard: int = SHARD, bucket: int = BUCKET, seed: int = SEED):
        spark = docs.sparkSession
        text = F.coalesce("text", F.lit(""))
        own = [F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(text).alias("digest")]
        sizes = materialize(docs.select(*own, *key), "sizes")
        totals = {r["source"]: (r["size"], r["n"]) for r in sizes.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()}
        target = targets({s: size for s, (size, _) in totals.items()}, weights)
        self.buckets = max(1, -(-sum(n for _, n in totals.values()) // bucket))
        rows, slots, blocks = [], [], []
        for sid, s in enumerate(sorted(totals, key=lambda s: (s is None, s or ""))):
            size = totals[s][0]
            blocks.append(-(-size // block))
            rows.append((s, sid, size, target[s]))
            slots.append(min(MOST * blocks[-1], round(target[s] * blocks[-1] / size)) if size else 0)
        # One row for each source: the mix's own configuration, not the corpus.
        self.sources = F.broadcast(spark.createDataFrame(rows, "source string, sid int, source_size long, target double"))
        shards = -(-sum(slots) // shard)
        drawn = spark.range(0, shards, 1, max(1, min(shards, 10_000))).mapInArrow(_drawn(np.array(slots, np.int64), np.array(blocks, np.int64), shard, seed), _SLOTS_DDL)

        self.located = materialize(self._located(sizes), "located")
        discard(sizes)
        spread = self.located.where("size > 0").select("*", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block))).alias("block"))
        from_ = F.greatest("at", F.col("block") * block)
        start, n = from_ - F.col("at"), F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block) - from_
        #: One row for each slot and row of docs whose words its block holds. A shard's row makes many: no broadcast.
        self.pieces = spread.join(drawn.hint("merge"), ["sid", "block"]).select("sid", "at", "size", *[c for c in ("file", "row") if key], "shard", "epoch", "slot", start.alias("start"), n.alias("n"))

    def _located(self, sizes: DataFrame) -> DataFrame:
        """sizes with sid, target and more of the source, and `at`: the place of the first word in its source.

        Rows of a source are dealt out to buckets by doc_id and text, and buckets to rows of buckets, so that no
        window grows with a source.
        """
        bucket = F.pmod(F.xxhash64("doc_id", "digest", F.lit(7)), F.lit(self.buckets)).cast("int")
        rows = sizes.join(self.sources, sizes["source"].eqNullSafe(self.sources["source"])).drop(self.sources["source"]).withColumn("bucket", bucket)
        line = F.floor(F.col("bucket") / ROW)
        sums = materialize(rows.groupBy("sid", "bucket").agg(F.sum("size").alias("n")).withColumn("line", line), "offsets")
        far = sums.groupBy("sid", "line").agg(F.sum("n").alias("n")).select("sid", "line", (F.sum("n").over(Window.partitionBy("sid").orderBy("line")) - F.col("n")).alias("far"))
        near = F.sum("n").over(Window.partitionBy("sid", "line").orderBy("bucket")) - F.col("n")
        bases = sums.select("sid", "line", "bucket", near.alias("near")).join(far, ["sid", "line"]).select("sid", "bucket", (F.col("near") + F.col("far")).alias("base"))
        order = [c for c in ("doc_id", "digest", "size", "file", "row") if c in rows.columns]
        w = Window.partitionBy("sid", "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        inner = rows.withColumn("inner", F.sum("size").over(w) - F.col("size"))
        return inner.join(bases, ["sid", "bucket"]).withColumn("at", F.col("base") + F.col("inner")).drop("base", "inner", "digest", "bucket")


def mixed_counts(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken, shards of each row of docs: how many of its words the mix takes, and where to.

    The total of all sizes is shared among the sources by weight, none above three times its size. Each block of a
    source is taken up to three times, so no row exceeds three times its size; a source's taken words meet its
    target to within a block's length or so, whatever the seed, which decides the blocks and their output shards.
    Reruns agree. Null and empty texts have the size 0 and are not taken; a null source is a source, the last one;
    repeated rows count each; rows with a null doc_id take part; an empty table gives no rows; extra columns are
    ignored.
    """
    plan = Mix(docs, [], **options)
    sums = plan.pieces.groupBy("sid", "at").agg(F.sum("n").alias("taken"), F.array_sort(F.collect_set("shard")).alias("shards"))
    found = plan.located.withColumn("place", F.when(F.col("size") > 0, F.col("at"))).join(sums.withColumnRenamed("at", "place"), ["sid", "place"], "left")
    return found.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("shards", F.array().cast("array<long>")).alias("shards"))


def mixed_texts(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, with the columns of docs, placed and ordered by output shard and slot: what a shard's slots take of each row.

    A row of the mix holds the words of one row of docs whose blocks one shard takes in one pass over the source; a
    text taken whole by a shard stays as it is. Rows of which nothing is taken, and those without words, are left
    out. Cases as in mixed_counts(); n_chars, where docs have it, follows the text. Words are located by row keys
    alone: texts move once to meet their slots, and what is taken moves once to its shard.
    """
    docs, key = row_key(docs)
    plan = Mix(docs, key, **options)
    takes = plan.pieces.repartition("file", "row").groupBy("file", "row", "size", "shard", "epoch").agg(F.min("slot").alias("slot"), F.array_sort(F.collect_list(F.struct("start", "n"))).alias("pieces"))
    takes = takes.groupBy("file", "row", "size").agg(F.collect_list(F.struct("shard", "slot", "pieces")).alias("takes")).toDF(*_OWN, "__mixing_size", "__mixing_takes")
    full = docs.withColumns(dict(zip(_OWN, key, strict=True))).join(takes.hint("merge"), list(_OWN))
    # The words are bound by a lambda, so that they are split once a row; a shard that takes them all needs none.
    part = "array_join(flatten(transform(t.pieces, p -> slice(ws, cast(p.start + 1 as int), cast(p.n as int)))), '')"
    whole = "aggregate(t.pieces, 0L, (a, p) -> a + p.n) = __mixing_size"
    words = r"if(forall(__mixing_takes, t -> " + whole + r"), array(), regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+[\\x20\\x09-\\x0D]*', 0))"
    taken = F.expr(f"transform(array({words}), ws -> transform(__mixing_takes, t -> struct(t.shard as shard, t.slot as slot, if({whole}, text, {part}) as text)))[0]")
    out = full.withColumn("__mixing_taken", F.explode(taken))
    t = F.col("__mixing_taken.text")
    values = {"text": t, "n_chars": F.char_length(t)}
    types = dict(docs.dtypes)
    columns = [(values[c].cast(types[c]) if c in values else F.col(f"`{c}`")).alias(c) for c in docs.columns]
    placed = out.select(*columns, F.col("__mixing_taken.shard").alias("__mixing_shard"), F.col("__mixing_taken.slot").alias("__mixing_slot"))
    return placed.repartition("__mixing_shard").sortWithinPartitions("__mixing_shard", "__mixing_slot").drop("__mixing_shard", "__mixing_slot")
