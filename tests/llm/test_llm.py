"""The training-data operators against brute force, on small tables with nulls, empty texts, ties and clashing names."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import public_tokenizers as P

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, sid long, bucket string, doc string"


def docs_of(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or ["a", None, "b"])[i % len(sources or "abc")], len(t or ""), "x", 1, "y", "z") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 150))) for _ in range(40)]
    near = [" ".join(w if rng.random() > 0.01 else rng.choice(words) for w in base[k].split(" ")) for k in range(8)]
    long = " ".join(rng.choice(words) for _ in range(9000))
    return [*base, *near, *base[:5], None, "", "  ", long, base[3] + " " + base[4], "a b c " * 200, long[:3000]]


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_passages(spark, texts):
    from tallyfold.llm.passages import chains, common_words, repeated_passages

    rows = repeated_passages(docs_of(spark, texts)).collect()
    found = {(r["doc_id"], r["match_doc_id"]) for r in rows}
    for k in range(5):  # exact copies, if long enough
        if len(texts[k].split()) >= 60:
            assert (48 + k, k) in found
    assert (59, 56) in found and all(r["identity"] >= 0.8 and r["match_doc_id"] < r["doc_id"] for r in rows)
    assert repeated_passages(empty(spark)).count() == 0
    assert [p for p, _ in chains([0, 5, 10, 15], [0, 5, 100, 10])][0] == [0, 1, 3]
    rng = random.Random(1)
    for _ in range(50):
        a, b = ([rng.choice([b"x", b"y", b"z"]) for _ in range(rng.randint(0, 12))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert common_words(a, b) == t[-1][-1]


def test_passages_of_lines_seen_apart(spark):
    from tallyfold.llm.passages import repeated_passages

    rng = random.Random(11)
    other = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    lines = [other(15) for _ in range(3)]
    short = [other(10) for _ in range(3)]
    made = [other(30) + x + other(30) for x in lines] + [other(20) + sum(lines, []) + other(20) for _ in range(2)]
    made += [other(9) + short[0] + short[1] + other(9), other(9) + short[1] + short[2] + other(9)]  # no 25 words of the next two
    made += [other(20) + sum(short, []) + other(20) for _ in range(2)]
    made += [other(20) + lines[0] + other(60) + sum(lines, []) + other(20)]  # a line, and then again in the passage
    got = repeated_passages(docs_of(spark, [" ".join(x) for x in made])).collect()
    at = {(r["doc_id"], r["match_doc_id"]): (r["start_word"], r["end_word"]) for r in got}
    assert at[4, 3] == (20, 65) and at[8, 7] == (20, 50) and at[9, 3] == (95, 140)


def test_passages_fuzzy(spark):
    from tallyfold.llm.passages import common_words, repeated_passages

    rng = random.Random(12)
    other = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    made, want = [], set()
    for size, share in [(60, 0.1), (60, 0.15), (40, 0.1), (25, 0.0), (27, 0.0)] * 40:
        a = other(size)
        b = [x if rng.random() >= share else other(1)[0] for x in a]
        if common_words(a, b) >= 0.8 * size:
            want.add((len(made) + 1, len(made)))
        made += [other(40) + a + other(40), other(40) + b + other(40)]
    rows = repeated_passages(docs_of(spark, [" ".join(x) for x in made])).collect()
    lost = want - {(r["doc_id"], r["match_doc_id"]) for r in rows}
    assert len(lost) <= 0.02 * len(want) and all(r["identity"] >= 0.8 and r["match_doc_id"] == r["doc_id"] - 1 for r in rows), (len(lost), len(want))


def test_nearest(spark):
    from tallyfold.llm.ann import nearest

    rng = np.random.default_rng(0)
    v = rng.normal(size=(600, 8))
    v[500:] = v[3]
    rows = [(i, x.tolist(), "s") for i, x in enumerate(v)] + [(1000, None, ""), (1001, [0.0] * 8, ""), (1002, [float("nan")] * 8, ""), (1003, [None] * 8, ""), (3, v[3].tolist(), "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, shard string")
    hit = total = 0
    got = {}
    for r in nearest(df, shard=150).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 600, 20))
    for q, found in got.items():
        found.sort()
        want = sorted((-float(v[q] @ v[j]), j) for j in range(600) if j != q)[:20]
        assert [x[0] for x in found] == list(range(1, 21))
        hit += len({x[1] for x in found} & {j for _, j in want})
        total += 20
        assert all(abs(s - v[q] @ v[j]) < 1e-9 for _, j, s in found)
    assert hit / total >= 0.9
    assert nearest(df.limit(0)).count() == 0
    assert nearest(df.where("vec_id < 2")).count() == 1


def test_nearest_odd_rows(spark):
    """Lengths are searched apart, ties go to the smaller id in order, repeated ids are candidates with each vector."""
    from tallyfold.llm.ann import nearest

    rng = np.random.default_rng(1)
    v = {i: rng.integers(-2, 3, size=4).astype(float) + 0.5 for i in range(1, 121)}  # few kinds: many ties
    v[0] = np.array([1.0, 2.0])
    v |= {200 + i: rng.normal(size=2) for i in range(30)}
    rows = [(i, x.tolist(), 1) for i, x in v.items()] + [(7, (v[7] * 10).tolist(), 1), (None, [1.0] * 4, 1), (5, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, `a.b` int").withColumn("shard", F.lit("x"))
    got = {}
    for r in nearest(df, k=10, shard=40).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], round(r["score"], 9))
    assert set(got) == {i for i in v if i % 20 == 0}
    many = [(i, x) for i, x, _ in rows if i is not None and x]
    for q, found in got.items():
        best = {}
        for j, x in many:
            if j != q and len(x) == len(v[q]):
                best[j] = max(best.get(j, -1e9), float(v[q] @ np.array(x)))
        want = sorted((-s, j) for j, s in best.items())[:10]
        assert [found[k + 1][0] for k in range(len(found))] == [j for _, j in want], q
        assert all(abs(found[k + 1][1] + s) < 1e-6 for k, (s, _) in enumerate(want))


def test_toxicity(spark, texts):
    from tallyfold.llm.toxicity import score_toxicity, segments

    rng = random.Random(2)
    made, labels = [], []
    for i in range(400):
        words = [rng.choice("one two three four five six seven".split()) for _ in range(60)]
        if bad := i % 5 == 0:
            words[20:26] = [rng.choice(["vile", "scum"]) for _ in range(6)]
        made.append(" ".join(words))
        labels.append((i, int(bad), "t"))
    made += [None, ""]
    rows = score_toxicity(docs_of(spark, made), spark.createDataFrame([*labels, (None, 1, ""), (3, None, "")], "doc_id long, toxic int, text string")).collect()
    assert len(rows) == 402
    held = [r for r in rows if r["held_out"] and r["doc_id"] < 400]
    assert held and all(r["predicted"] == int(r["doc_id"] % 5 == 0) for r in held)
    assert {r["predicted"] for r in rows if r["doc_id"] >= 400} == {0}
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert score_toxicity(docs_of(spark, texts), none).count() == len(texts)
    assert score_toxicity(empty(spark), none).count() == 0
    for _ in range(200):  # the scan against its definition: repeatedly the best remaining segment
        x = [rng.choice([-2, -1, 1, 2, 3]) for _ in range(rng.randint(1, 14))]
        sums = [0, *np.cumsum(x).tolist()]
        at = [i for i, y in enumerate(x) if y > 0]

        def split(a, b):
            best = max(((sum(x[i:j]), -(j - i), -i) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, 0, 0))
            if best[0] <= 0:
                return []
            i, j = -best[2], -best[2] - best[1]
            return [*split(a, i), (i, j, best[0]), *split(j, b)]

        got, want = segments([sums[i] for i in at], [sums[i + 1] for i in at], at), split(0, len(x))
        assert sum(s for *_, s in got) == sum(s for *_, s in want)
        if len(set(sums)) == len(sums):  # without ties there is one answer
            assert sorted(got) == sorted(want)


def test_toxicity_odd_rows(spark):
    from tallyfold.llm.toxicity import drop_toxic, score_toxicity

    rng = random.Random(2)
    made = [" ".join((["vile", "scum"] * 3 if i % 5 == 0 else []) + [rng.choice("one two three four five six".split()) for _ in range(60)]) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300)], "doc_id long, toxic int")
    long = " ".join(made) * 20
    docs = docs_of(spark, [*made, None, "", long]).withColumnRenamed("bucket", "a.b")
    docs = docs.union(docs.where("doc_id in (0, 1)")).union(docs.where("doc_id in (5, 6)").withColumn("doc_id", F.lit(None).cast("long")))
    scored = score_toxicity(docs, labels).collect()
    assert len(scored) == docs.count() and all(0 <= r["score"] <= 1 for r in scored)
    kept = drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r["doc_id"] for r in scored if not r["predicted"])
    assert drop_toxic(empty(spark), labels).count() == 0


def simhash(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, texts):
    from tallyfold.llm.simhash import links, near_duplicates

    got = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in near_duplicates(docs_of(spark, texts), block=3).collect()}
    prints = [simhash(t or "") for t in texts]
    label = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= 3:
                    label[i] = label[j] = min(label[i], label[j])
    assert got == {i: (prints[i], label[i]) for i in range(len(texts))}
    assert near_duplicates(empty(spark)).count() == 0
    rng = random.Random(3)  # a crowd of near fingerprints, in small blocks
    fps = list({(0xABCDEF ^ sum(1 << rng.randrange(64) for _ in range(2))) & (2**63 - 1) for _ in range(80)})
    edges = links(spark.createDataFrame([(f, k) for k, f in enumerate(fps)], "fp long, node long"), block=8).collect()
    join = lambda es: len({frozenset(c) for c in _parts(len(fps), es)})
    assert join([(r["src"], r["dst"]) for r in edges]) == join([(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])


def two_prints(text):
    """The two fingerprints of the pipeline's stage, apart from the engine's own code."""
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h, out = [xxhash.xxh64_intdigest(g, 42) for g in grams], []
    for _ in range(2):
        out.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
            h = [((x ^ x >> shift) * factor) & (2**64 - 1) for x in h]
    return out


def near_heads(ids, texts):
    """The ids that the stage keeps: the least of each group of texts linked by 15 bits or less, with a segment that differs in one at most."""
    prints = [two_prints(t) for t in texts]
    label = {k: k for k in range(len(texts))}

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for i, a in enumerate(prints):
        for j, b in enumerate(prints[:i]):
            x = [p ^ q for p, q in zip(a, b)]
            segments = [(v >> s & 0xFFFFFFFF).bit_count() for v in x for s in (0, 32)]
            if sum(segments) <= 15 and min(segments) <= 1:
                one, two = sorted((root(i), root(j)))
                label[two] = one
    least = {}
    for k, i in enumerate(ids):
        least[root(k)] = min(least.get(root(k), i), i)
    return set(least.values())


def test_simhash_representatives(spark, texts):
    from tallyfold.llm.simhash import representatives

    docs = docs_of(spark, texts).withColumnRenamed("bucket", "a.b")
    docs = docs.union(docs.where("doc_id < 4")).union(docs.where("doc_id in (2, 9)").withColumn("doc_id", F.lit(None).cast("long")))
    extra = spark.createDataFrame([(None, "only here once " * 9, "en", "a", 1, "x", 1, "y", "z")] * 2, docs.schema)
    docs = docs.union(extra)
    kept = representatives(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(ids, key=lambda x: (x is None, x)) == [*sorted(near_heads(range(len(texts)), texts)), None]
    assert representatives(empty(spark)).count() == 0


def test_simhash_near_copies(spark):
    """The stage's recall: copies with one or two words of a hundred changed, and none of the others."""
    from tallyfold.llm.simhash import representatives

    rng = random.Random(31)
    made, copies = [], {1: [], 2: []}
    for k in range(400):
        words = [f"w{rng.randrange(3000)}" for _ in range(100)]
        made.append(" ".join(words))
        n = 1 + k % 2
        for at in rng.sample(range(100), n):
            words[at] = "changed"
        copies[n].append(len(made))
        made.append(" ".join(words))
    ids = {r["doc_id"] for r in representatives(docs_of(spark, made)).select("doc_id").collect()}
    lost = {n: sum(i not in ids for i in own) / len(own) for n, own in copies.items()}
    assert set(range(0, 800, 2)) <= ids and lost[1] > 0.65 and lost[2] > 0.3, lost


def test_simhash_top_bit(spark):
    from tallyfold.llm.simhash import links

    signed = lambda bits: sum(1 << b if b < 63 else -(1 << 63) for b in bits)
    linked = lambda fps: links(spark.createDataFrame([(f, k) for k, f in enumerate(fps)], "fp long, node long")).count()
    for bits in ([63], [63, 0], [63, 5], [63, 5, 40], [63, 62, 61]):
        assert linked([0, signed(bits)]) == 1, bits
    assert linked([0, signed([60, 61, 62, 63])]) == 0
    crowd = [0, signed([63, 7]), signed([63, 7, 9]), signed([60, 61, 62, 63, 30])]  # a bucket of more than two
    assert len(_parts(4, [(r["src"], r["dst"]) for r in links(spark.createDataFrame([(f, k) for k, f in enumerate(crowd)], "fp long, node long")).collect()])) == 2


def _parts(n, edges):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return [[i for i in range(n) if label[i] == k] for k in set(label)]


def test_bpe(spark, texts):
    from tokenizers import Tokenizer

    from tallyfold.llm.bpe import ByteBPE, encode, encode_digests

    path = str(P.path("byte_bpe_50k.json"))
    want = Tokenizer.from_file(path)
    rng = random.Random(4)
    odd = ["<|endoftext|>a<|endoftext|>", " \n x  y\t", "it's 12'3ll", "a" * 3000, "　é ß😀", *("".join(rng.choice("ab c1'\n<|é") for _ in range(40)) for _ in range(300))]
    own = ByteBPE(path)
    for t, ids in zip(odd, own.encode_batch(odd), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == want.encode(t, add_special_tokens=False).ids
        assert own.decode(ids) == t
    rows = {r["doc_id"]: r for r in encode_digests(docs_of(spark, texts), path).collect()}
    for i, t in enumerate(texts):
        ids = want.encode(t or "", add_special_tokens=False).ids
        assert (rows[i]["n_tokens"], rows[i]["ids_sha256"], rows[i]["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert encode(empty(spark), path).count() == 0


def deduped(texts):
    """n_bytes, n_removed, n_spans, kept_sha256 of each text, by the definition."""
    seen, out = set(), []
    for t in texts:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(b[p : p + 100])
        spans = sum(1 for p in range(len(b)) if gone[p] and not (p and gone[p - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return out


_COLUMNS = ("n_bytes", "n_removed", "n_spans", "kept_sha256")


@pytest.mark.parametrize("shard", [1 << 22, 3000, 300])
def test_suffix(spark, texts, shard):
    from tallyfold.llm.suffix import dedupe_substrings

    rng = random.Random(9)
    made = [*texts, "x" * 400, "ab" * 200, "x" * 150]
    for _ in range(40):  # one passage in many contexts: an anchor of many heads
        made.append("".join(rng.choice("abcdef ") for _ in range(80)) + texts[1][:130] + "".join(rng.choice("abcdef ") for _ in range(80)))
    rows = {r["doc_id"]: r for r in dedupe_substrings(docs_of(spark, made), shard=shard).collect()}
    assert [tuple(rows[i][c] for c in _COLUMNS) for i in range(len(made))] == deduped(made)


def test_suffix_odd_rows(spark, texts):
    from tallyfold.llm.suffix import dedupe_substrings

    assert dedupe_substrings(empty(spark)).count() == 0
    long = "y" * 150
    docs = docs_of(spark, [texts[56], long, None]).withColumnRenamed("bucket", "a.b")
    docs = docs.union(docs.where("doc_id < 2")).union(docs.where("doc_id = 1").withColumn("doc_id", F.lit(None).cast("long")))
    rows = dedupe_substrings(docs).collect()
    assert len(rows) == docs.count()
    n = len(texts[56].encode())
    assert sorted(r["n_removed"] for r in rows if r["doc_id"] == 0) == [0, n]
    assert sorted(r["n_removed"] for r in rows if r["doc_id"] == 1) == [149, 150] and [r["n_removed"] for r in rows if r["doc_id"] is None] == [150]


def test_suffix_array():
    from tallyfold.llm.suffix import common_prefixes, suffix_array

    rng = random.Random(6)
    for k in range(1500):
        s = [rng.randint(1, rng.choice([2, 3, 9])) for _ in range(rng.randint(0, 60 if k < 1480 else 3000))] + [0]
        x = np.array(s, np.int32)
        sa = suffix_array(x, 10)
        assert sa.tolist() == sorted(range(len(s)), key=lambda i: s[i:])
        shared = common_prefixes(x, sa)
        for a, b in zip(sa[:-1].tolist(), sa[1:].tolist()):
            n = 0
            while s[a + n] == s[b + n] and s[a + n] > 1:
                n += 1
            assert shared[b] == n


def test_mixing(spark, texts):
    from tallyfold.llm.mixing import mixed_counts, mixed_texts, permute, targets

    assert targets({"a": 100, "b": 100, None: 100}) == {"a": 50.0, "b": 100.0, None: 150.0}
    assert targets({"a": 1000, "b": 10, "c": 10}) == {"a": 960.0, "b": 30.0, "c": 30.0}
    assert sorted(permute(np.arange(37), 37, 5).tolist()) == list(range(37))
    docs = docs_of(spark, texts)
    one, two = (sorted(tuple(r)[:5] for r in mixed_counts(docs, block=8).collect()) for _ in range(2))
    assert one == two
    size = {i: len((t or "").split()) for i, t in enumerate(texts)}
    taken, target = Counter(), {}
    for i, n, _, goal, took in one:
        assert n == size[i] and 0 <= took <= 3 * n
        taken[i % 3] += took
        target[i % 3] = goal
    assert all(abs(taken[s] - target[s]) <= 16 + 0.02 * target[s] for s in target)
    mixed = mixed_texts(docs, block=8)
    assert mixed.columns == docs.columns
    words = Counter()
    for r in mixed.collect():
        words[r["doc_id"]] += len(r["text"].split())
    assert {i: k for i, k in words.items() if k} == {i: k for i, _, _, _, k in one if k}
    assert mixed_counts(empty(spark)).count() == 0 == mixed_texts(empty(spark)).count()


def test_mixing_draws(spark, texts):
    from tallyfold.llm.mixing import draw, mixed_counts, mixed_texts

    slots = np.array([700, 0, 3, 1290], np.int64)
    drawn = [draw(slots, 64, k, 9) for k in range(-(-1993 // 64))]
    assert sum(n for _, n in drawn).tolist() == slots.tolist()  # every source's slots, once
    assert all(int(n.sum()) == 64 for _, n in drawn[:-1])
    for k, (before, _) in enumerate(drawn):
        assert before.tolist() == (sum((n for _, n in drawn[:k]), np.zeros(4, np.int64))).tolist()
    assert len({int(n[0]) for _, n in drawn}) > 5  # drawn, not dealt evenly
    docs = docs_of(spark, texts)
    got = {seed: mixed_counts(docs, block=8, shard=16, seed=seed).collect() for seed in (1, 2)}
    by_source = lambda rows: {r["target"]: sum(x["taken"] for x in rows if x["target"] == r["target"]) for r in rows}
    one, two = (by_source(got[seed]) for seed in (1, 2))
    assert all(abs(one[k] - two[k]) <= 16 for k in one)  # the seed leaves the totals, but for a last block's words
    shards = {seed: {r["doc_id"]: r["shards"] for r in rows} for seed, rows in got.items()}
    assert shards[1] != shards[2] and max(len(x) for x in shards[1].values()) > 10
    # What each shard holds is what its counts say: the texts come by shard, and each shard's words are its slots' words.
    placed = mixed_texts(docs, block=8, shard=16, seed=1).select("doc_id", "source", "text").collect()
    assert Counter(r["doc_id"] for r in placed) == Counter({k: len(v) for k, v in shards[1].items() if v}) or sum(len(r["text"].split()) for r in placed) == sum(r["taken"] for r in got[1])


def test_mixing_odd_rows(spark, texts):
    from tallyfold.llm.mixing import mixed_counts, mixed_texts

    docs = docs_of(spark, texts).withColumnRenamed("bucket", "a.b").withColumn("file", F.lit(1))
    docs = docs.union(docs.limit(20)).union(docs.withColumn("doc_id", F.lit(None).cast("long")))
    rows = mixed_counts(docs, block=8, shard=16).collect()
    assert len(rows) == docs.count() and all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    mixed = mixed_texts(docs, block=8, shard=16)
    assert mixed.columns == docs.columns
    assert sum(len(r["text"].split()) for r in mixed.select("text").collect()) == sum(r["taken"] for r in rows)


def test_token_counts(spark, texts):
    from tallyfold.llm.tokens import token_counts, trie

    path = str(P.path("byte_bpe_50k.tiktoken"))
    m = trie(path)

    def best(w):
        t = [(0.0, 0)]
        for e in range(1, len(w) + 1):
            t.append(max((t[s][0] + m.score[w[s:e]], t[s][1] - 1) for s in range(e) if w[s:e] in m.score))
        return t[-1]

    rows = {r["doc_id"]: r for r in token_counts(docs_of(spark, texts[:56]), path).collect()}
    for i, t in enumerate(texts[:56]):
        words = [w.encode() for w in m.cut.findall(t or "")]
        assert rows[i]["n_words"] == len(words) and rows[i]["n_tokens"] == -sum(best(w)[1] for w in words)
        assert math.isclose(rows[i]["log_prob"], sum(best(w)[0] for w in words), abs_tol=1e-6)
    assert token_counts(empty(spark), path).count() == 0


def jaccard(a, b):
    a, b = (Counter(w for w in re.split(r"[\x20\x09-\x0D]+", x) if w) for x in (a, b))
    top = sum(max(a[w], b[w]) for w in a.keys() | b.keys())
    return sum(min(a[w], b[w]) for w in a.keys() | b.keys()) / top if top else 1.0


def test_fingerprint(spark, texts):
    from tallyfold.llm.fingerprint import fingerprints

    rows = {r["doc_id"]: r for r in fingerprints(docs_of(spark, texts)).collect()}
    off = []
    for i, t in enumerate(texts):
        t, n = t or "", (texts[(i + 1) % len(texts)] or "")
        half = len(t) // 2
        edited = t[: len(t) - half] + n[:half]
        assert rows[i]["n_chars"] == len(t) and rows[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        off += [rows[i]["near_edited"] - jaccard(t, edited), rows[i]["near_next"] - jaccard(t, n)]
    assert abs(np.mean(off)) < 0.03 and np.std(off) < 0.1
    assert rows[0]["fingerprint"] == rows[48]["fingerprint"] and rows[53]["near_next"] == 1.0
    assert fingerprints(empty(spark)).count() == 0


def test_secrets(spark):
    from tallyfold.llm.secrets import CLASSES, PLACEHOLDERS, PLAIN, UUID, redact, report

    rng = random.Random(7)
    key = lambda n: "".join(rng.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMN0123456789+/") for _ in range(n))
    made = [
        "Password: 'hunter22' x", "secret=token:abcdef1 api-key=zz apikey = abcdefg", "AKIA" + "ABCDEFGH12345678 AKIAAKIA", "é " + "0a" * 12 + " ff",
        *(f"é{key(k)} und {key(30)}, {key(22)}" for k in range(18, 60)), "EXAMPLE" + key(30), "123e4567-e89b-12d3-a456-426614174000", None, "", "plainwordsthatarelongenough" * 4,
        "DEADBEEF0123456789ABCDEF", "token=" + key(40) + " token=abcdef " * 30,
    ]
    assign = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    entropy = lambda w: -sum(c / len(w) * math.log2(c / len(w)) for c in Counter(w).values())
    docs = docs_of(spark, made)
    rows = {r["doc_id"]: r for r in report(docs).collect()}
    kinds = Counter()
    for i, t in enumerate(made):
        t = t or ""
        base = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(t) if len(m[2]) >= 6]
        base += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        base += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        spans = list(base)
        for rank, (kind, pattern, _, w, least) in enumerate(CLASSES, 3):
            for m in re.finditer(pattern, t):
                if re.search(UUID, m[0]) or any(b[0] <= m.start() and m.end() <= b[2] for b in base):
                    continue
                x = m[0]
                for word, cased in PLACEHOLDERS:
                    x = re.sub(word, " " * len(word), x, flags=0 if cased else re.I)
                if hot := [k for k in range(len(x) - w + 1) if " " not in x[k : k + w] and entropy(x[k : k + w]) >= least - 1e-9]:
                    if not any(re.search(p, m[0][hot[0] : hot[-1] + w]) for p in PLAIN):
                        spans.append((m.start() + hot[0], rank, m.start() + hot[-1] + w, kind))
        text = lambda s: ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(s))
        kinds.update(k for *_, k in spans)
        assert rows[i]["spans"] == text(spans) and rows[i]["base_sha256"] == hashlib.sha256(text(base).encode()).hexdigest()
        assert (rows[i]["n_assign"], rows[i]["n_access"], rows[i]["n_hex"]) == tuple(sum(b[3] == k for b in base) for k in ("assign", "access", "hex"))
    assert kinds["entropy_base64"] > 20 and kinds["access"] == 1
    clean = {r["doc_id"]: r["text"] for r in redact(docs).collect()}
    assert clean[0] == "[REDACTED]' x" and clean[3] == "é [REDACTED] ff" and clean[48] is None and clean[49] == ""
    assert redact(docs).columns == docs.columns and report(empty(spark)).count() == 0
    shown = {r["doc_id"]: r["spans"] for r in report(docs_of(spark, ["EXAMPLE_KEY=" + key(40), "/" + key(50) + "00000000" + key(50)])).collect()}
    assert shown[0].endswith(":12:52") and shown[1]  # a placeholder beside a secret doesn't hide it


def test_secrets_long(spark):
    import time

    from tallyfold.llm.secrets import redact, report

    rng = random.Random(8)
    blob = "".join(rng.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMN0123456789+/") for _ in range(1 << 20))
    many = " ".join("".join(rng.choice("0123456789abcdef") for _ in range(24)) for _ in range(50_000))
    docs = docs_of(spark, [blob, "é " + many, "x" * 1_000_000])
    began = time.time()
    rows = {r["doc_id"]: r for r in report(docs).collect()}
    clean = {r["doc_id"]: r["text"] for r in redact(docs).collect()}
    assert rows[0]["spans"].startswith("entropy_base64:") and int(rows[0]["spans"].split(":")[2]) > len(blob) - 30
    assert rows[1]["n_hex"] == 50_000 and rows[1]["spans"].startswith("hex:2:26,hex:27:51,") and rows[2]["spans"] == ""
    assert len(clean[0]) < 100 and clean[1] == "é " + " ".join(["[REDACTED]"] * 50_000) and len(clean[2]) == 1_000_000
    assert time.time() - began < 120


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf)
        assert after.columns == docs.columns and 0 < after.select("doc_id").distinct().count() <= docs.select("doc_id").distinct().count(), name
        docs = spark.createDataFrame(after.collect(), docs.schema)
    final = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert final.count() == docs.count() and final.where("decoded is null").count() == 0
    assert final.join(docs.groupBy("doc_id").agg(F.sum(F.length("text")).alias("n")), "doc_id").count() == final.count()


def test_pipeline_is_its_parts(spark):
    """run() against the stages' operators, each judged on its own input, and the encoding against the tokenizer."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    from tallyfold.llm.mixing import mixed_counts
    from tallyfold.llm.secrets import redact
    from tallyfold.llm.toxicity import score_toxicity
    from tallyfold.plans.materialize import materialize

    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    bad = {r["doc_id"] for r in score_toxicity(docs, labels).where("predicted = 1").collect()}
    docs = materialize(docs.where(~F.col("doc_id").isin(bad)) if bad else docs, "one")
    rows = docs.select("doc_id", "text").collect()
    heads = near_heads([r["doc_id"] for r in rows], [r["text"] for r in rows])
    docs = materialize(redact(docs.where(F.col("doc_id").isin(heads))), "two")
    taken = Counter({r["doc_id"]: r["taken"] for r in mixed_counts(docs).collect() if r["taken"]})
    got, words, coder = Counter(), Counter(), Tokenizer.from_file(str(P.path("byte_bpe_50k.json")))
    source = {r["doc_id"]: Counter(r["text"].split()) for r in docs.collect()}
    for r in corpus_pipeline.run(spark, sf).collect():
        assert coder.encode(r["decoded"], add_special_tokens=False).ids == np.frombuffer(r["ids"], "<u4").tolist()
        own = Counter(r["decoded"].split())
        assert all(n <= source[r["doc_id"]][w] for w, n in own.items())
        got[r["doc_id"]] += sum(own.values())
    assert got == taken


def test_pipeline_odd_rows(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("a.b", F.lit(1)).withColumn("file", F.lit(None).cast("string"))
    blank = docs.limit(4).withColumns({c: F.lit(None).cast(t) for c, t in docs.dtypes if c != "a.b"})
    odd = docs.limit(60).union(docs.limit(9)).union(blank).union(docs.limit(1).withColumn("text", F.lit("")))
    for rows in (odd, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            after = stage(spark, rows, sf)
            assert name == "bpe" or after.columns == docs.columns, name
            held = after.collect()
            rows = spark.createDataFrame(held, after.schema)


def odd(spark, texts):
    """Rows with null ids, nulls in every column, repeats, an empty and a very long text, and names that clash or have dots."""
    docs = docs_of(spark, [*texts[:20], None, "", " ".join(t or "" for t in texts) * 8]).withColumnRenamed("bucket", "a.b").withColumnRenamed("lang", "row")
    blank = docs.limit(1).select(*[F.lit(None).cast(t).alias(c) if "." not in c else F.lit(None).cast(t).alias(c) for c, t in docs.dtypes])
    return docs.union(docs.where("doc_id < 3")).union(docs.where("doc_id in (4, 5)").withColumn("doc_id", F.lit(None).cast("long"))).union(blank)


def test_passages_odd_rows(spark, texts):
    from tallyfold.llm.passages import repeated_passages

    docs = odd(spark, texts)
    rows = repeated_passages(docs).collect()
    assert all(r["doc_id"] is not None and r["match_doc_id"] < r["doc_id"] and r["identity"] >= 0.8 for r in rows)
    long = 22  # holds the first twenty texts whole
    assert {r["match_doc_id"] for r in rows if r["doc_id"] == long} >= {i for i in range(20) if len(texts[i].split()) >= 30}
    assert repeated_passages(docs.limit(0)).count() == 0


def test_passages_against_all_pairs(spark):
    """Recall on planted passages, exact and fuzzy, among texts of common words: each is linked with an earlier holder."""
    from tallyfold.llm.passages import repeated_passages

    rng = random.Random(21)
    words = [f"w{k}" for k in range(4000)]
    weights = [1 / (k + 1) for k in range(4000)]
    filler = lambda n: rng.choices(words, weights, k=n)
    made, want = [], []
    for _ in range(60):
        passage = filler(rng.randint(30, 90))
        holders = []
        for _ in range(rng.randint(2, 5)):
            own = [w if rng.random() > rng.choice([0, 0, 0.05]) else rng.choice(words) for w in passage]
            holders.append(len(made))
            made.append((filler(rng.randint(10, 60)), own, filler(rng.randint(10, 60))))
        want.append(holders)
    got = {}
    for r in repeated_passages(docs_of(spark, [" ".join(a + b + c) for a, b, c in made])).collect():
        got.setdefault(r["doc_id"], []).append((r["start_word"], r["end_word"]))
    hit = total = 0
    for holders in want:
        for k in holders[1:]:
            a, b, _ = made[k]
            covered = sum(1 for w in range(len(a), len(a) + len(b)) if any(s <= w < e for s, e in got.get(k, [])))
            total += 1
            hit += covered >= 0.8 * len(b)
    assert hit / total >= 0.95, (hit, total)


def test_bpe_odd_rows(spark, texts):
    from tokenizers import Tokenizer

    from tallyfold.llm.bpe import encode_digests

    path = str(P.path("byte_bpe_50k.json"))
    docs, coder = odd(spark, texts), Tokenizer.from_file(path)
    got = Counter((r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in encode_digests(docs, path).collect())
    assert got == Counter((r["doc_id"], len(coder.encode(r["text"] or "", add_special_tokens=False).ids), hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in docs.collect())


def test_token_counts_odd_rows(spark, texts):
    from tallyfold.llm.tokens import token_counts, trie

    path = str(P.path("byte_bpe_50k.tiktoken"))
    docs, m = odd(spark, texts), trie(path)
    rows = Counter((r["doc_id"], r["n_words"], r["n_tokens"]) for r in token_counts(docs, path).collect())
    def count(t):
        words = [x.encode() for x in m.cut.findall(t or "")]
        known = m.insert(words)
        return len(words), sum(known[w][1] for w in words)

    assert rows == Counter((r["doc_id"], *count(r["text"])) for r in docs.collect())
    m._clear()
    fresh = {w: (s, n) for w, (_, n, s) in m.insert([b"abc", b"abd", b"ab", b"a"]).items()}
    assert list(zip(m.forward, m.fewest))[1:] == [fresh[w] for w in (b"a", b"ab", b"abc", b"abd")]  # a node for each prefix, computed once


def test_fingerprint_odd_rows(spark, texts):
    from tallyfold.llm.fingerprint import fingerprints

    docs = odd(spark, texts)
    rows = fingerprints(docs).collect()
    assert len(rows) == docs.count() and Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in docs.collect())
    by = {}
    for r, t in ((r, r["doc_id"]) for r in rows):
        by.setdefault(t, set()).add(r["fingerprint"])
    assert all(len(by[k]) == 1 for k in (0, 1, 2)) and all(0 <= r["near_next"] <= 1 for r in rows)


def test_secrets_odd_rows(spark, texts):
    from tallyfold.llm.secrets import redact, report

    docs = odd(spark, texts)
    assert report(docs).count() == docs.count() == redact(docs).count() and redact(docs).columns == docs.columns


def test_simhash_odd_rows(spark, texts):
    from tallyfold.llm.simhash import near_duplicates

    docs = odd(spark, texts)
    got = Counter((r["doc_id"], int(r["fingerprint"], 16)) for r in near_duplicates(docs).collect())
    assert got == Counter((r["doc_id"], simhash(r["text"] or "")) for r in docs.collect())


def test_passages_whose_seeds_are_first_held_elsewhere(spark):
    """Two fuzzy holders of a passage without 25 equal words on end, each run of which stands alone in an earlier document."""
    from tallyfold.llm.passages import repeated_passages

    rng = random.Random(31)
    other = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    made, want = [], set()
    for _ in range(20):
        runs = [other(rng.randint(7, 9)) for _ in range(5)]
        made += [other(30) + x + other(30) for x in runs]
        want.add((len(made) + 1, len(made)))
        made += [other(20) + [w for x in runs for w in [*x, *other(1)]] + other(20) for _ in range(2)]
    line = other(8)  # one that many texts hold, and two of them also what is around it
    made += [other(30) + line + other(30) for _ in range(200)]
    around = [other(9) for _ in range(2)]
    want.add((len(made) + 1, len(made)))
    made += [other(12) + around[0][:4] + other(1) + around[0][5:] + line + other(1) + around[1] + other(12) for _ in range(2)]
    got = {(r["doc_id"], r["match_doc_id"]) for r in repeated_passages(docs_of(spark, [" ".join(x) for x in made])).collect()}
    assert got == want, (want - got, got - want)


def test_passages_of_near_copies(spark):
    """Of near copies without 25 equal words on end every pair is linked, by a row or by the places of their first holder."""
    from tallyfold.llm.passages import repeated_passages

    rng = random.Random(32)
    other = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    base = other(60)
    made = [other(20) + [w if k % 12 != s else other(1)[0] for k, w in enumerate(base)] + other(20) for s in [*range(12)] * 3]
    rows = repeated_passages(docs_of(spark, [" ".join(x) for x in made])).collect()
    direct = {(r["match_doc_id"], r["doc_id"]) for r in rows}
    held = {}
    for r in rows:
        held.setdefault(r["match_doc_id"], []).append((r["doc_id"], r["match_start"], r["match_end"]))
    for places in held.values():
        direct |= {(a[0], b[0]) for a in places for b in places if a[0] < b[0] and min(a[2], b[2]) - max(a[1], b[1]) >= 25}
    assert direct == {(a, b) for b in range(len(made)) for a in range(b)}


def test_passages_pairs_in_blocks():
    """Pairs of places made by rows, by distance and between packed blocks are the same, and none that aligns is lost."""
    from tallyfold.llm.passages import _SIDE, GRAM, _block_pairs, _Places

    rng = np.random.default_rng(33)
    n, wide = 300, GRAM + 2 * _SIDE
    words = rng.integers(0, 256, (n, 1 + wide)).astype(np.uint8)
    words[:, 0] = _SIDE
    words[:, 1 + _SIDE : 1 + _SIDE + GRAM] = 7
    for k in range(0, n, 3):  # two that are alike but for every seventh word
        words[k + 1, 1:] = np.where(np.arange(wide) % 7 == 0, words[k + 1, 1:], words[k, 1:])
    doc, pos, prev = np.arange(n), np.full(n, 50), np.arange(n).astype("<u4") * 2 + 1
    some = _Places(doc, pos, prev, np.zeros(n, np.uint32), words)
    pairs = lambda parts: {(int(a), int(b)) for d, h, _, _ in parts for a, b in zip(d, h, strict=True)}
    whole = pairs(_block_pairs(some, n, 0))
    i, j = np.triu_indices(n, 1)
    assert whole == pairs(some.matches(i, j)) >= {(k + 1, k) for k in range(0, n, 3)}
    left, right = some.packed(0, 200), some.packed(200, n)
    parts = [*_block_pairs(_Places.unpacked(left, right), 200, 100), *_block_pairs(_Places.unpacked(left, b""), 200, 0), *_block_pairs(_Places.unpacked(right, b""), 100, 0)]
    assert pairs(parts) == whole


def test_passages_of_one_word_on_and_on():
    """Stretches of one word are paired by their ends, and matched with a place of another text once in a few words."""
    from tallyfold.llm.passages import _TILE, GRAM, _stretch_ends, _unrepeated

    words = np.array([1, 2, 3, 4, 5] + [9] * 60 + [6, 7, 8, 1, 2], np.uint64)
    at = np.arange(len(words) - GRAM + 1)
    ends = _stretch_ends(words, np.array([0, len(words)]), at, np.zeros(len(at), int))
    assert ends[5] == 1 and ends[60] == 2 and not ends[6:60].any() and (np.delete(ends, range(5, 61)) == 3).all()
    pos = np.concatenate([np.arange(100, 160), [500]])
    one = np.ones(len(pos), int)
    kept = sorted(pos[_unrepeated(one, one, one, one, pos)].tolist())
    assert len(kept) < 8 and {100, 159, 500} <= set(kept) and max(np.diff(kept[:-1])) <= _TILE


def test_passages_pairs_around_a_line():
    """Places with one word before are not compared at all; around a common line no pair is lost that grows to a passage."""
    from tallyfold.llm.passages import _SIDE, GRAM, _block_pairs, _Places

    rng = np.random.default_rng(34)
    n, wide = 400, GRAM + 2 * _SIDE
    words = rng.integers(0, 256, (n, 1 + wide)).astype(np.uint8)
    words[:, 0] = _SIDE
    words[:, 1 + _SIDE : 1 + _SIDE + 13] = np.arange(13)  # a line of 13 words that all hold
    for k in range(0, n, 4):  # eight more words in common, of twelve
        words[k + 1, 1 + _SIDE + 13 : 1 + _SIDE + 25] = np.where(np.arange(12) % 6 == 5, words[k + 1, 1 + _SIDE + 13 : 1 + _SIDE + 25], words[k, 1 + _SIDE + 13 : 1 + _SIDE + 25])
    compared = []

    class Counted(_Places):
        def rows(self, *tile):
            i, j = super().rows(*tile)
            compared.append(len(i))
            return i, j

    doc, pos, near = np.arange(n), np.full(n, 50), np.zeros(n, np.uint32)
    some = Counted(doc, pos, np.arange(n).astype("<u4") * 2 + 1, near, words)
    found = {(int(a), int(b)) for d, h, _, _ in _block_pairs(some, n, 0) for a, b in zip(d, h, strict=True)}
    assert found >= {(k + 1, k) for k in range(0, n, 4)} and sum(compared) < n * n / 4
    compared.clear()
    assert not list(_block_pairs(Counted(doc, pos, np.full(n, 7, "<u4"), near, words), n, 0)) and not compared


def test_passages_short_in_the_other_text():
    """22 equal words of the 25 of either text: the other's last words, which nothing equals, make up its length."""
    from tallyfold.llm.passages import _grown

    own, text = np.concatenate([np.arange(100, 120), np.full(11, 1), np.full(11, 2)]), np.concatenate([np.full(41, 1), np.full(44, 2)])
    grown = _grown(own, text, np.array([[26, 36, 36, 46]]), np.array([[0, len(own)]]), np.array([[0, len(text)]]), 25)[0]
    assert min(grown[1] - grown[0], grown[3] - grown[2]) == 25
