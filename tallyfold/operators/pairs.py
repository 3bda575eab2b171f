"""Pairs of alike records within a block, found by joins on what makes them alike: no block is paired off with itself.

A pair scores above 0 only if its natural keys agree (equal, one missing, or one the beginning of the other) and its
e-mails' local parts, or failing these its phones, are within two edits, or failing these its names are alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.functions.fuzzy import blocking_key, ratio
from tallyfold.functions.text import local_part, norm

#: Scores of equal identifiers, and of those within two edits.
EQUAL, NEAR = 1.0, 0.85
#: Distinct names of a block that are compared at once; larger blocks are dealt out as pairs of chunks.
CHUNK = 2_000
#: Copies of an identity that one row holds.
_LIST = 1_024
#: Identities of a value that one row holds.
_FEW = 16

#: What has to be known of a record for its copies to be alike.
_SAID = "email <> '' or phone <> '' or first <> '' or last <> ''"
_IDENTITY = ["block", "key", "email", "phone", "first", "last", "born"]


def identities(records: DataFrame) -> DataFrame:
    """id, block, and the normalised key, email, phone, first, last, born of each record, computed once; missing ones are empty."""
    text = lambda c: norm(F.col(c).cast("string"))
    block = blocking_key(F.col("work_email"), F.col("first_name"), F.col("last_name"), F.col("phone"))
    return records.select(
        "id", block.alias("block"), text("employee_id").alias("key"), text("work_email").alias("email"), text("phone").alias("phone"),
        text("first_name").alias("first"), text("last_name").alias("last"), text("date_of_birth").alias("born"),
    )


def _joined(left: DataFrame, right: DataFrame, on: str | list[str]) -> DataFrame:
    """An equality join that deals out both sides: what explode() makes of a small table is none, as Spark's estimates have it."""
    return left.join(right.hint("merge"), on)


def _agreeing(left: DataFrame, right: DataFrame, on: list[str], both: bool = True) -> DataFrame:
    """left x right by equality on `on` where one's `key` is a beginning of the other's. Columns besides `on` get a_ and b_.

    both: False leaves out pairs whose longer key is the right's: of a table with itself, these are told by the others.
    """
    named = lambda df, p: df.select(*on, *[F.col(c).alias(f"{p}_{c}") for c in df.columns if c not in on])
    a, b = named(left, "a"), named(right, "b")
    starts = lambda c: F.explode(F.transform(F.sequence(F.lit(0), F.char_length(c)), lambda n: F.substring(F.col(c), F.lit(1), n)))
    shorter = _joined(a.withColumn("start", starts("a_key")), b.withColumn("start", F.col("b_key")), [*on, "start"])
    if not both:
        return shorter.drop("start")
    longer = _joined(b.withColumn("start", starts("b_key")), a.withColumn("start", F.col("a_key")), [*on, "start"]).where("a_key <> b_key")
    return shorter.drop("start").unionByName(longer.drop("start"))


def near_values(values: DataFrame, skip: int = 0) -> DataFrame:
    """block, a, b: values of a block that are one or two edits apart, a < b, from block, value (distinct).

    Two such values share a string that both come to by up to two deletions: an equality join on these strings, which
    is then verified. skip: characters that all values of a block share at their beginning, which need no deletions.
    """
    rest = values.select("block", "value", F.substring("value", skip + 1, 1 << 20).alias("r"))
    less = "transform(sequence(1, char_length({0})), i -> concat(substring({0}, 1, i - 1), substring({0}, i + 1)))"
    once = f"if(r = '', cast(array() as array<string>), {less.format('r')})"
    twice = f"flatten(transform(filter({once}, x -> x <> ''), x -> {less.format('x')}))"
    made = rest.select("block", "value", F.explode(F.expr(f"array_distinct(concat(array(r), {once}, {twice}))")).alias("made"))
    made = made.select("block", "value", F.xxhash64("block", "made").alias("made"))
    pairs = _joined(made.select("block", F.col("value").alias("a"), "made"), made.select("block", F.col("value").alias("b"), "made"), ["block", "made"]).where("a < b")
    return pairs.select("block", "a", "b").distinct().where(F.levenshtein("a", "b", 2) >= 0)


def _valued(reps: DataFrame) -> DataFrame:
    """The identities that an identifier decides: e-mail's local part in e-mail blocks, else the phone."""
    value = F.when(F.col("email") != "", local_part(F.col("email"))).otherwise(F.col("phone"))
    return reps.where("email <> '' or phone <> ''").withColumn("value", value).select("block", "value", "key", "id")


def _near(valued: DataFrame) -> DataFrame:
    distinct = valued.select("block", "value").distinct()
    mail = distinct.where("startswith(block, 'em:')")  # whose blocks share the first five characters
    return near_values(mail, 5).unionByName(near_values(distinct.where("not startswith(block, 'em:')")))


def _met(near: DataFrame, valued: DataFrame) -> DataFrame:
    """block, a_id, b_id of identities whose values are near (block, a, b) and whose keys agree.

    The identities of two values meet in one row where each value has _FEW of them at most, else by joins on what the keys begin with.
    """
    on = ["block", "value"]
    sizes = valued.groupBy(*on).agg(F.count("*").alias("n"))
    told = _joined(valued, sizes, on)
    some, many = told.where(F.col("n") <= _FEW).drop("n"), told.where(F.col("n") > _FEW).drop("n")
    held = lambda p: some.groupBy("block", F.col("value").alias(p)).agg(F.collect_list(F.struct("key", "id")).alias(f"{p}_held"))
    rows = _joined(_joined(near, held("a"), ["block", "a"]).select("block", "b", "a_held"), held("b"), ["block", "b"])
    agree = "filter(b_held, y -> startswith(x.key, y.key) or startswith(y.key, x.key))"
    rows = rows.select("block", F.inline(F.expr(f"flatten(transform(a_held, x -> transform({agree}, y -> struct(x.id as a_id, y.id as b_id))))")))
    side = lambda p, q: _joined(near, many.withColumnRenamed("value", p), ["block", p]).select("block", F.col(q).alias("value"), "key", "id")
    more = _agreeing(side("a", "b"), valued, on).unionByName(_agreeing(side("b", "a"), some, on))
    return rows.unionByName(more.select("block", "a_id", "b_id"))


def _names(reps: DataFrame, chunk: int, least: float) -> DataFrame:
    """block, a_id, b_id, score of identities without e-mail, not both with a phone, whose names are alike and births don't differ."""
    people = reps.where("email = '' and (first <> '' or last <> '') and not startswith(block, 'ph:')")
    names = people.select("block", "first", "last").distinct()
    sizes = names.groupBy("block").agg(F.count("*").alias("n"))
    chunks = F.ceil(F.col("n") / chunk).cast("int")
    dealt = _joined(names, sizes, "block").withColumn("chunk", F.pmod(F.xxhash64("first", "last"), chunks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    dealt = dealt.withColumns({"low": F.least("chunk", "other"), "high": F.greatest("chunk", "other")})
    side = lambda p: dealt.select("block", "low", "high", *[F.col(c).alias(f"{p}{c}") for c in ("first", "last", "chunk")])
    both = _joined(side("l"), side("r"), ["block", "low", "high"]).where("(low = high or lchunk <> rchunk) and struct(lfirst, llast) <= struct(rfirst, rlast)")
    told = lambda c: F.expr(f"l{c} <> '' or r{c} <> ''")
    total = sum((F.when(told(c), ratio(f"l{c}", f"r{c}")).otherwise(0.0) for c in ("first", "last")), F.lit(0.0))
    score = F.try_divide(total, sum((F.when(told(c), 1).otherwise(0) for c in ("first", "last")), F.lit(0)))
    alike = both.select("block", "lfirst", "llast", "rfirst", "rlast", score.alias("score")).where(F.col("score") > least)
    left = _joined(alike, people.withColumnsRenamed({"first": "lfirst", "last": "llast"}), ["block", "lfirst", "llast"])
    own = left.select("block", "rfirst", "rlast", "score", "key", "id", "phone", "born", "lfirst", "llast")
    right = people.select("block", F.col("first").alias("rfirst"), F.col("last").alias("rlast"), F.lit(None).cast("double").alias("score"), "key", "id", "phone", "born")
    # One of a pair lacks a phone: pairs of others, as many as their names' square, are not made.
    on = ["block", "rfirst", "rlast"]
    met = _agreeing(own.where("phone = ''"), right, on).unionByName(_agreeing(own.where("phone <> ''"), right.where("phone = ''"), on))
    apart = "a_id <> b_id and (struct(a_lfirst, a_llast) <> struct(rfirst, rlast) or a_id < b_id)"
    return met.where(f"{apart} and (a_born = '' or b_born = '' or a_born = b_born)").select("block", "a_id", "b_id", F.col("a_score").alias("score"))


def _ordered(pairs: DataFrame, score: Column) -> DataFrame:
    return pairs.select("block", F.least("a_id", "b_id").alias("a_id"), F.greatest("a_id", "b_id").alias("b_id"), score.alias("score"))


def _copies(ids: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """The first record of each identity, and the pairs of each other record with it."""
    reps = ids.groupBy(*_IDENTITY).agg(F.min("id").alias("id"))
    others = _joined(ids.where(_SAID), reps.withColumnRenamed("id", "a_id"), _IDENTITY).where("id > a_id")
    return reps, others.select("block", "a_id", F.col("id").alias("b_id"), F.lit(EQUAL).alias("score")).where(F.lit(EQUAL > least))


def _every_copy(ids: DataFrame, reps: DataFrame, found: DataFrame, least: float) -> DataFrame:
    """Pairs of first records, as pairs of all their copies; and those of copies with each other.

    Pairs of first records meet lists of their copies and become pairs of copies last: only the former are dealt out.
    """
    members = ids.groupBy(*_IDENTITY).agg(F.min("id").alias("first_id"), F.collect_list("id").alias("ids"))
    part = F.explode(F.sequence(F.lit(0), F.floor((F.size("ids") - 1) / _LIST).cast("int"))).alias("part")
    lists = members.select("first_id", "ids", part).select("first_id", F.slice("ids", F.col("part") * _LIST + 1, F.lit(_LIST)).alias("ids"))
    own = reps.where(_SAID).select("block", F.col("id").alias("a_id"), F.col("id").alias("b_id"), F.lit(EQUAL).alias("score")).where(F.lit(EQUAL > least))
    every = found.unionByName(own)
    for p in ("a", "b"):
        every = every.join(lists.select(F.col("first_id").alias(f"{p}_id"), F.col("ids").alias(p)).hint("shuffle_hash"), f"{p}_id")
    every = every.withColumn("a", F.explode("a")).withColumn("b", F.explode("b")).where("a_id <> b_id or a < b")
    return _ordered(every.select("block", F.col("a").alias("a_id"), F.col("b").alias("b_id"), "score"), F.col("score"))


def candidate_pairs(records: DataFrame, least: float = 0.0, chunk: int = CHUNK, every_copy: bool = False) -> DataFrame:
    """a_id, b_id (a_id < b_id), block, score of every pair of a block that scores above `least` (0 or more).

    records: id (distinct), employee_id, first_name, last_name, work_email, phone, date_of_birth. Records whose
    identity is equal in all of these are copies: a copy is paired with the first of them, and the first alone is
    paired with others, unless `every_copy` asks for all their pairs, whose number grows with the square of the copies.
    Null and empty values count as missing; extra columns are ignored; an empty table gives no rows. Pairs that score 0
    are not listed: nothing merges them or asks about them.
    """
    ids = identities(records)
    reps, copies = _copies(ids, least)
    valued = _valued(reps)
    same = _agreeing(valued, valued, ["block", "value"], both=False).where("a_key <> b_key or a_id < b_id")
    found = _ordered(same, F.lit(EQUAL))
    if least < NEAR:
        found = found.unionByName(_ordered(_met(_near(valued), valued), F.lit(NEAR)))
    found = found.unionByName(_ordered(_names(reps, chunk, least), F.col("score")))
    found = found.where(F.col("score") > least)  # each pair once: its longer key, nearer value or name tells its sides apart
    found = _every_copy(ids, reps, found, least) if every_copy else found.unionByName(copies)
    return found.select("a_id", "b_id", "block", "score")


def merge_edges(records: DataFrame, merge_above: float, chunk: int = CHUNK) -> DataFrame:
    """src, dst: edges whose components are those of all pairs that score `merge_above` or more.

    Records of one identifier and one key are linked to the first of them, and only these first ones to those of
    agreeing keys, so that an identifier of many records makes as many edges, not pairs.
    """
    ids = identities(records)
    reps, copies = _copies(ids, 0.0)
    edges = copies.select("a_id", "b_id")
    if merge_above <= EQUAL:
        valued = _valued(reps)
        firsts = valued.groupBy("block", "value", "key").agg(F.min("id").alias("id"))
        own = _joined(valued, firsts.withColumnRenamed("id", "a_id"), ["block", "value", "key"]).select("a_id", F.col("id").alias("b_id"))
        met = _agreeing(firsts, firsts, ["block", "value"]).select("a_id", "b_id")
        edges = edges.unionByName(own).unionByName(met)
        if merge_above <= NEAR:
            edges = edges.unionByName(_met(_near(valued), firsts).select("a_id", "b_id"))
    names = _names(reps, chunk, 0.0).where(F.col("score") >= merge_above).select("a_id", "b_id")
    return edges.unionByName(names).where("a_id <> b_id").select(F.col("a_id").alias("src"), F.col("b_id").alias("dst"))
