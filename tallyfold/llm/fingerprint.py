"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

A term of weight w gets, for each sample, r and c from Gamma(2, 1) and b from U(0, 1), all hashed from the term.
With t = floor(ln w / r + b), the term's key is ln c - r (t - b + 1); the document's sample is its least key.
Two documents' samples are equal with a probability that is their generalised Jaccard similarity: the sum of the
lesser weights of each term over the sum of the greater ones. Terms are words, weights their counts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLES = 32
#: Rows to a bucket of the order by doc_id, and to a partition; buckets at most.
BUCKET, PART, MOST_BUCKETS = 500, 2_000, 65_536
SPACE = r"[\x20\x09-\x0D]+"


def _key(k: int) -> Column:
    """The k-th sample's key of a term, from its hash h and the logarithm of its weight, lw."""
    unit = lambda hash_, part: f"(((shiftrightunsigned({hash_}, {21 * part}) & 2097151L) + 0.5D) / 2097152D)"
    one, two = f"xxhash64(h, {2 * k})", f"xxhash64(h, {2 * k + 1})"
    r = f"(-ln({unit(one, 0)} * {unit(one, 1)}))"
    b, log_c = unit(one, 2), f"ln(-ln({unit(two, 0)} * {unit(two, 1)}))"
    return F.expr(f"{log_c} - {r} * (floor(lw / {r} + {b}) - {b} + 1)")


def _bucket_of(bounds: list[int]) -> Column:
    """How many of the ascending bounds are at most doc_id, found by a search in two steps; null: all of them."""
    step = max(1, math.isqrt(len(bounds)))
    array = lambda xs: "array(" + ", ".join(f"{x}L" for x in xs) + ")" if xs else "cast(array() as array<bigint>)"
    top = f"size(filter({array(bounds[step - 1 :: step])}, x -> x <= doc_id))"
    rest = f"size(filter(slice({array(bounds)}, {top} * {step} + 1, {step}), x -> x <= doc_id))"
    return F.expr(f"if(doc_id is null, {len(bounds)}, {top} * {step} + {rest})").cast("int")


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, bucket, rn, ghost, next: each row with the text of the next one in the order of doc_id, text.

    Rows are dealt to buckets by ranges of doc_id. The first rows of the next bucket stand at the end of each as
    ghosts, so that no row needs another partition; the last bucket ends with the first row of all.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = docs.count()
    n = min(MOST_BUCKETS, -(-rows // BUCKET))
    cuts = docs.approxQuantile("doc_id", [k / n for k in range(1, n)], 0.2 / n) if n > 1 else []
    bucket = _bucket_of(sorted({int(x) for x in cuts}))
    dealt = docs.withColumn("bucket", bucket)
    heads = [(r[0], r[1]) for r in dealt.where("doc_id is not null").groupBy("bucket").agg(F.min("doc_id")).orderBy("bucket").collect()]  # MOST_BUCKETS rows
    last = len(cuts) and max((b for b, _ in heads), default=0)
    ends = spark.createDataFrame([(heads[k - 1][0] if k else last, head) for k, (_, head) in enumerate(heads)], "bucket int, doc_id long")
    ghosts = docs.join(F.broadcast(ends), "doc_id")
    both = dealt.withColumn("ghost", F.lit(False)).unionByName(ghosts.withColumn("ghost", F.lit(True)))
    w = Window.partitionBy("bucket").orderBy("ghost", F.col("doc_id").asc_nulls_last(), "text")
    both = both.repartition(max(1, -(-rows // PART)), "bucket")
    return both.select("*", F.row_number().over(w).alias("rn"), F.lead("text").over(w).alias("next"))


def _signatures(texts: DataFrame, keys: list[str], samples: int) -> DataFrame:
    """keys, sig: the samples of each row's text, as an array; no terms: all null."""
    words = texts.select(*keys, F.explode(F.split("text", SPACE)).alias("word"))
    terms = words.select(*keys, F.when(F.col("word") != "", F.xxhash64("word")).alias("h")).groupBy(*keys, "h").agg(F.count("*").alias("n"))
    weighted = terms.select(*keys, "h", F.when(F.col("h").isNotNull(), F.log(F.col("n").cast("double"))).alias("lw"))
    sampled = weighted.groupBy(*keys).agg(*[F.min(_key(k)).alias(f"s{k}") for k in range(samples)])
    return sampled.select(*keys, F.array(*[f"s{k}" for k in range(samples)]).alias("sig"))


def _likeness(a: str, b: str, samples: int) -> Column:
    return F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> if(x <=> y, 1, 0)), 0, (s, x) -> s + x)") / F.lit(float(samples))


def _hex(sig: str) -> Column:
    return F.expr(f"array_join(transform({sig}, x -> lower(lpad(hex(xxhash64(x)), 16, '0'))), '')")


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row of docs.

    The edited text has the last half of its code points (rounded down) replaced by as many of the next document, in
    ascending order of doc_id (ties: of text; nulls come last), all of it where it is shorter; the last row's next
    is the first with a doc_id, or nothing where there is none. Null texts count as empty. Texts without words have
    one fingerprint, whose likeness to itself is 1 and to any other 0. Repeated rows each get a result; extra
    columns are ignored; an empty table gives no rows.
    """
    rows = with_next(docs)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.coalesce("next", F.lit("")), F.lit(1), half))
    rows = rows.select("bucket", "rn", "ghost", "doc_id", "text", n.cast("long").alias("n_chars"), edited.alias("edited"))
    both = rows.select("bucket", "rn", F.explode(F.array(F.struct(F.lit(0).alias("which"), "text"), F.struct(F.lit(1).alias("which"), F.col("edited").alias("text")))).alias("x")).select("bucket", "rn", "x.which", "x.text")
    signed = _signatures(both, ["bucket", "rn", "which"], samples).groupBy("bucket", "rn").agg(
        F.first(F.when(F.col("which") == 0, F.col("sig")), True).alias("sig"), F.first(F.when(F.col("which") == 1, F.col("sig")), True).alias("edited_sig")
    )
    signed = signed.withColumn("next_sig", F.lead("sig").over(Window.partitionBy("bucket").orderBy("rn")))
    facts = rows.where("not ghost").select("bucket", "rn", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"))
    return facts.join(signed, ["bucket", "rn"]).select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        _hex("sig").alias("fingerprint"),
        _hex("edited_sig").alias("edited_fingerprint"),
        _likeness("sig", "edited_sig", samples).alias("near_edited"),
        F.coalesce(_likeness("sig", "next_sig", samples), F.lit(0.0)).alias("near_next"),
    )
