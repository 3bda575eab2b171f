"""Toxicity by maximum-scoring segments.

Tokens are scored by their log-odds between toxic and clean texts under an informative Dirichlet prior; a
linear-time scan finds every maximal segment of a text; extreme-value statistics turn the segments' scores into
evidence that does not depend on the length of the text; a logistic link turns the evidence into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import LOWER, byte_class, chunked, record_batch, span_hashes, texts_of, trimmed, word_spans
from tallyfold.plans.materialize import discard, materialize

#: Distinct tokens that a counting task holds before it passes them on.
HELD = 1 << 19
#: Labelled rows that the model is fitted on, at most (in expectation, by a hash of doc_id).
MAX_TRAIN = 200_000
#: Weight of the prior, in tokens; Jeffreys' half count of each token, without which one that no clean text holds has no
#: certain odds; least standard score of a token's log-odds; score of a token that says nothing.
PRIOR, HALF, LEAST_Z, DRIFT = 2_000.0, 0.5, 4.0, -0.05
THRESHOLD = 0.3

_WORD = byte_class(lambda b: b >= 0x80 or chr(b).isalnum() or b == 0x27)
_COUNTS = pa.schema([("token", pa.int64()), ("n", pa.int64()), ("toxic", pa.int64()), ("clean", pa.int64())])
_TOLD = pa.schema([("n_words", pa.int64()), ("top", pa.float64()), ("total", pa.float64()), ("toxic", pa.int32())])
_SPAN = "struct<start:long,end:long,score:double>"
_SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])))])


@dataclass(frozen=True)
class Model:
    tokens: np.ndarray  # ascending hashes of the tokens that tell toxic from clean texts
    scores: np.ndarray  # one for each, and last that of all other tokens
    rate: float  # lambda: score unit of the extreme-value law
    mode: float = 0.0  # of the law of the best segment in clean texts
    scale: float = 1.0
    weights: tuple[float, ...] = (-3.0, 1.0, 1.0)  # of the logistic link


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts, ends of all tokens of the texts laid end to end; each text's first token; each text's start."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    offsets = np.concatenate([[0], np.cumsum(sizes + 1)])
    buf = LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    starts, ends = word_spans(buf, _WORD)
    return span_hashes(buf, starts, ends).view(np.int64), starts, ends, np.searchsorted(starts, offsets), offsets


def _summed(parts: list[np.ndarray]) -> np.ndarray:
    """Rows of token, n, toxic, clean with one row for each token, in the order of tokens."""
    rows = np.concatenate(parts)
    rows = rows[np.argsort(rows[:, 0], kind="stable")]
    first = np.flatnonzero(np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]])) if len(rows) else np.empty(0, np.int64)
    out = np.add.reduceat(rows, first) if len(first) else rows
    out[:, 0] = rows[first, 0]
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each token: its number in all texts, and the labelled texts of either kind that hold it."""
    held, size = [], 0
    for batch in batches:
        label = batch.column(1).to_numpy(zero_copy_only=False)
        for at, texts in chunked(texts_of(batch.column(0))):
            tokens, _, _, first, _ = _tokens(texts)
            kinds, place, n = np.unique(tokens, return_inverse=True, return_counts=True)
            own = np.zeros((len(kinds), 4), np.int64)
            own[:, 0], own[:, 1] = kinds, n
            of = np.repeat(np.arange(len(texts)), np.diff(first))
            told = label[at : at + len(texts)][of] >= 0
            once = np.unique(of[told] * max(1, len(kinds)) + place[told])  # a token counts once for each labelled text
            toxic = label[at : at + len(texts)][once // max(1, len(kinds))] == 1
            for k, part in ((2, once[toxic]), (3, once[~toxic])):
                own[:, k] = np.bincount(part % max(1, len(kinds)), minlength=len(kinds))
            held.append(own)
            size += len(own)
            if size > HELD:
                held = [_summed(held)]
                size = len(held[0])
                if size > HELD // 2:
                    yield record_batch(_COUNTS, *held[0].T)
                    held, size = [], 0
    if held:
        yield record_batch(_COUNTS, *_summed(held).T)


def segments(before: list[float], after: list[float], at: list[int]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments of a text, in linear time.

    before, after, at: the prefix sums around each token of positive score, and its place. Returns first token,
    end token, score. Each candidate keeps the nearest earlier one whose left sum is smaller, so that a search
    passes over every candidate once.
    """
    left: list[float] = []
    right: list[float] = []
    first: list[int] = []
    last: list[int] = []
    link: list[int] = []
    for lo, hi, k in zip(before, after, at, strict=True):
        start = k
        while True:
            j = len(left) - 1
            while j >= 0 and left[j] >= lo:
                j = link[j]
            if j < 0 or right[j] >= hi:
                break
            lo, start = left[j], first[j]
            del left[j:], right[j:], first[j:], last[j:], link[j:]
        left.append(lo)
        right.append(hi)
        first.append(start)
        last.append(k + 1)
        link.append(j)
    return [(a, b, y - x) for a, b, x, y in zip(first, last, left, right, strict=True)]


def _evidence(texts: list[bytes], model: Model, places: bool) -> Iterator[tuple[int, float, float, list[dict]]]:
    """Of each text: its tokens, its best segment's score, the evidence of all segments, and (with `places`) these."""
    for _, part in chunked(texts):
        tokens, starts, ends, first, offsets = _tokens(part)
        at = np.searchsorted(model.tokens, tokens)
        hit = at < len(model.tokens)
        hit[hit] = model.tokens[at[hit]] == tokens[hit]
        value = np.where(hit, model.scores[at], model.scores[-1])
        sums = np.concatenate([[0.0], np.cumsum(value)])
        hot = np.flatnonzero(value > 0)
        cut = np.searchsorted(hot, first)
        words = np.diff(first)
        for k in range(len(part)):
            if cut[k] == cut[k + 1]:
                yield int(words[k]), 0.0, 0.0, []
                continue
            own = hot[cut[k] : cut[k + 1]]
            found = segments(sums[own].tolist(), sums[own + 1].tolist(), own.tolist())
            floor = np.log(max(1, words[k]))
            strong = [(a, b, model.rate * s - floor) for a, b, s in found if model.rate * s > floor]
            spans = [{"start": int(starts[a] - offsets[k]), "end": int(ends[b - 1] - offsets[k]), "score": s} for a, b, s in strong] if places else []
            yield int(words[k]), max(s for _, _, s in found), sum(s for *_, s in strong), spans


def _rate(scores: np.ndarray, p: np.ndarray) -> float:
    """The positive root of E[exp(rate * score)] = 1 under clean text, whose mean score is negative."""
    value = lambda x: float(p @ np.exp(x * scores)) - 1
    if not (scores > 0).any():
        return 1.0
    lo, hi = 0.0, 1.0
    while value(hi) < 0 and hi < 64:
        lo, hi = hi, hi * 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if value(mid) < 0 else (lo, mid)
    return hi


def _telling(counts: DataFrame) -> Model:
    """The tokens whose log-odds under the Dirichlet prior stand out, and their scores; the others' score is a drift.

    counts: token, n, toxic, clean. What comes to the driver has at least LEAST_Z ** 2 labelled texts behind each
    token, so its size is bounded by the labelled rows, not by the vocabulary.
    """
    total = counts.agg(F.sum(F.col("n") + 0.01).alias("n"), F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).first()
    if not total["n"]:
        return Model(np.empty(0, np.int64), np.array([DRIFT]), 1.0)
    rows = counts.withColumn("share", (F.col("n") + 0.01) / total["n"])
    rows = rows.withColumns({"a": F.col("toxic") + PRIOR * F.col("share") + HALF, "b": F.col("clean") + PRIOR * F.col("share") + HALF})
    logit = lambda c, labelled: F.log(F.col(c) / F.greatest(F.lit(float(labelled) + PRIOR) - F.col(c), F.lit(1e-9)))
    rows = rows.withColumn("odds", logit("a", total["toxic"]) - logit("b", total["clean"]))
    found = rows.where(F.abs("odds") >= LEAST_Z * F.sqrt(1 / F.col("a") + 1 / F.col("b"))).select("token", "share", "odds").toArrow().sort_by("token")
    tokens, share, odds = (found[c].to_numpy() for c in ("token", "share", "odds"))
    scores = np.clip(odds, -2, 8)
    drift = min(DRIFT, DRIFT - float(share @ scores))  # the mean over all text has to be negative
    scores = np.append(scores, drift)
    return Model(tokens, scores, _rate(scores, np.append(share, max(0.0, 1 - share.sum()))))


def _features(top, total, n, rate: float, mode: float, scale: float):
    """The surprise of the best segment under the extreme-value law, -log p, and the log of all segments' evidence."""
    x = (rate * top - np.log(np.maximum(n, 1)) - mode) / scale
    surprise = np.where(top > 0, -np.log(np.maximum(-np.expm1(-np.exp(-np.clip(x, -20, 30))), 1e-13)), 0.0)
    return np.stack([np.ones_like(x), np.minimum(surprise, 20.0) / 5, np.log1p(total)], 1)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - 0.01 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w.tolist())


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """The model of docs (doc_id, text) and labels, as score_toxicity() says."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    known = known.where(_fold() != 2).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    size = known.count()
    if size > max_train:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * max_train / size))
    known = materialize(known, "labels")
    told = F.broadcast(known)  # max_train rows of 12 bytes
    labelled = docs.join(told, "doc_id", "left").select("text", F.coalesce("toxic", F.lit(-1)).alias("toxic"))
    counts = labelled.mapInArrow(trimmed(_count), "token long, n long, toxic long, clean long").groupBy("token").agg(*[F.sum(c).alias(c) for c in ("n", "toxic", "clean")])
    counts = materialize(counts, "tokens")
    model = _telling(counts)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [x[:3] for x in _evidence(texts_of(batch.column(0)), model, False)]
            yield record_batch(_TOLD, *(map(list, zip(*rows, strict=True)) if rows else ([], [], [])), batch.column(1))

    sample = docs.join(told, "doc_id").select("text", "toxic").mapInArrow(trimmed(scan), "n_words long, top double, total double, toxic int").toArrow()  # max_train rows
    discard(counts)
    discard(known)
    n, top, total, y = (sample[c].to_numpy().astype(np.float64) for c in ("n_words", "top", "total", "toxic"))
    calm = (y == 0) & (top > 0)
    x = np.sort(model.rate * top[calm] - np.log(np.maximum(n[calm], 1)))  # sorted, so that reruns add up alike
    scale = float(max(np.std(x) * np.sqrt(6) / np.pi, 0.1)) if calm.sum() > 1 else 1.0
    mode = float(np.mean(x) - np.euler_gamma * scale) if calm.any() else 0.0
    order = np.lexsort((y, total, top, n))
    weights = _logistic(_features(top, total, n, model.rate, mode, scale)[order], y[order]) if len(y) else model.weights
    return replace(model, mode=mode, scale=scale, weights=weights)


def _scores(texts: list[bytes], model: Model, places: bool) -> tuple[np.ndarray, list[tuple]]:
    rows = list(_evidence(texts, model, places))
    n, top, total = (np.array([r[k] for r in rows], np.float64) for k in range(3))
    z = _features(top, total, n, model.rate, model.mode, model.scale) @ np.array(model.weights)
    return 1 / (1 + np.exp(-np.clip(z, -700, 700))), rows


def _fold() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4


def score_toxicity(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """doc_id, held_out, score, predicted, n_words, spans (start, end in UTF-8 bytes, evidence) of each row of docs.

    labels: doc_id, toxic (0 or 1; other values and null doc_ids are left out; of repeated rows the largest counts).
    The model is learnt from rows whose crc32(doc_id as text) mod 4 is not 2, from `max_train` of them where there
    are more; the prior is counted over all texts. Null and empty texts have no tokens and the score of a text
    without evidence; so has every text if there are no labels. Texts are scored whole, however long. Rows with a
    null doc_id are scored and count as held out. Repeated rows stay; ties in a text go to the earlier segment; an
    empty table gives no rows; extra columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = fit(docs, labels, max_train)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, rows = _scores(texts_of(batch.column(1)), model, True)
            yield record_batch(_SCORED, batch.column(0), score, [r[0] for r in rows], [r[3] for r in rows])

    got = docs.mapInArrow(trimmed(run), f"doc_id long, score double, n_words long, spans array<{_SPAN}>")
    return got.select("doc_id", F.coalesce(_fold() == 2, F.lit(True)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_words", "spans")


def drop_toxic(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """docs, all columns, without the rows that score_toxicity() rejects; cases as there.

    A row is judged where it stands, by its own text: null doc_ids and repeated ones make no difference, and no
    text is moved.
    """
    model = fit(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels, max_train)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, _ = _scores(texts_of(batch.column(at)), model, False)
            yield batch.filter(pa.array(score < THRESHOLD))

    plain = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))  # names with dots do not pass
    return plain.mapInArrow(trimmed(run), plain.schema).toDF(*docs.columns)
