"""Toxic passages as maximum-scoring segments of token log-odds (operator 5).

1. Document counts of every token, over the whole corpus and by label, give log-odds with an informative
   Dirichlet prior; word beginnings are counted in the same way, for words that were never seen.
2. A linear scan (Ruzzo and Tompa) finds all maximal scoring segments of a document.
3. The best segment of a document without toxic passages follows an extreme-value law whose location
   grows with the logarithm of the length; a logistic fit turns that significance into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_slices, solid, written

#: Bound of what is fitted: labelled rows, those of smallest hash.
LABELLED = 20_000
BEGINNING = 5
#: Strength of the prior, the least z-score of a token that counts as toxic, and the cost of any other.
PRIOR = 50.0
PSEUDO = 1.0
LEAST_Z = 3.3
LEAST_SEEN = 3
DRIFT = 0.7
CONTEXT = 5
#: What is between tokens, the same for Java and Python: ASCII only.
SPLIT = r"[\x09-\x0D\x20.,;:!?\"'()\[\]]+"


@dataclass
class ToxicModel:
    words: dict[str, float]
    beginnings: dict[str, float]
    scale: float = 1.0  # lambda and K of the extreme-value law
    size: float = 0.01
    logistic: tuple[float, ...] = (-3.0, 1.0, 0.5, 1.5, 0.0)


def log_odds(counts: pd.DataFrame, toxic: str, clean: str, n_toxic: float, n_clean: float, total: float) -> pd.Series:
    """z-scores and log-odds of tokens (columns all, toxic, clean) with a prior in proportion to the whole corpus."""
    prior = PRIOR * counts["every"] / max(total, 1.0) + PSEUDO
    a0 = PRIOR
    up = counts[toxic] + prior
    down = counts[clean] + prior
    delta = np.log(up / np.maximum(n_toxic + a0 - up, 1e-9)) - np.log(down / np.maximum(n_clean + a0 - down, 1e-9))
    return delta.where((delta / np.sqrt(1 / up + 1 / down) >= LEAST_Z) & (counts[toxic] >= LEAST_SEEN), 0.0)


def segments(scores: np.ndarray, steps: list[int] | None = None) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a score sequence, in linear time.

    Each open segment knows the nearest one before it that begins at a lower sum, so that segments in between are
    never looked at again; steps, if given, gets the number of segments looked at.
    """
    hits = np.flatnonzero(scores > 0)
    if not len(hits):
        return []
    sums = np.concatenate([[0.0], np.cumsum(scores, dtype=np.float64)])
    before, after = sums[hits].tolist(), sums[hits + 1].tolist()
    stack: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum after, nearest with a lower sum before
    looked = 0
    for i, low, high in zip(hits.tolist(), before, after, strict=True):
        start, j = i, len(stack) - 1
        while True:
            while j >= 0 and stack[j][2] >= low:
                j, looked = stack[j][4], looked + 1
            looked += 1
            if j < 0 or stack[j][3] >= high:
                break
            start, _, low, _, link = stack[j]
            del stack[j:]
            j = link
        stack.append((start, i + 1, low, high, j))
    if steps is not None:
        steps.append(looked)
    return [(s, e, high - low) for s, e, low, high, _ in stack]


def _fold_of(name: str) -> Column:
    return (F.crc32(F.reverse(F.col(name).cast("string")).cast("binary")) % 2).cast("int")


def token_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """token, every (documents of the corpus with it), and of labelled ones by fold 0 and 1 the toxic and clean: t0, c0, t1, c1.

    In labelled texts a token counts once for each different token CONTEXT places before it, so that copies of
    one text count once, and words of a fixed phrase as often as the phrase.
    """
    tokens = lambda text: F.filter(F.split(F.lower(text), SPLIT), lambda t: t != "")
    every = docs.select(F.explode(F.array_distinct(tokens("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("every"))
    known = F.broadcast(labels.select(F.col("doc_id").alias("_id"), "toxic", _fold_of("doc_id").alias("_fold")))
    rows = docs.select("doc_id", "text").join(known, F.col("doc_id") == F.col("_id")).select("toxic", "_fold", tokens("text").alias("_tokens"))
    pairs = rows.withColumn("_before", F.concat(F.array(*[F.lit("")] * CONTEXT), "_tokens")).select("toxic", "_fold", F.explode(F.arrays_zip("_tokens", "_before")).alias("_pair"))
    pairs = pairs.select("toxic", "_fold", F.col("_pair._tokens").alias("token"), F.xxhash64("_pair._before").alias("_before")).where("token is not null").distinct()
    one = lambda label, part: F.sum(F.when((F.col("toxic") == label) & (F.col("_fold") == part), 1).otherwise(0))
    seen = pairs.groupBy("token").agg(one(1, 0).alias("t0"), one(0, 0).alias("c0"), one(1, 1).alias("t1"), one(0, 1).alias("c1"))
    return every.join(seen, "token", "left").na.fill(0)


def _scorer(model: ToxicModel):
    words, beginnings = model.words, model.beginnings

    class Scores(dict):
        def __missing__(self, token: str) -> float:
            found = max(words.get(token, 0.0), beginnings.get(token[:BEGINNING], 0.0) if len(token) > BEGINNING else 0.0)
            if len(self) > 500_000:
                self.clear()
            self[token] = found if found > 0 else -DRIFT
            return self[token]

    return Scores()


def passages(texts: list[str], model: ToxicModel, scores: dict | None = None) -> list[tuple[int, list[tuple[int, int, float]]]]:
    """For each text its number of tokens and its maximal segments."""
    import re

    split = re.compile(SPLIT)
    get = (scores if scores is not None else _scorer(model)).__getitem__
    out = []
    for text in texts:
        tokens = [t for t in split.split(text.lower()) if t]
        values = np.fromiter(map(get, tokens), dtype=np.float64, count=len(tokens))
        out.append((len(tokens), segments(values)))
    return out


def features(tokens: np.ndarray, best: np.ndarray, above: np.ndarray, model: ToxicModel) -> np.ndarray:
    """-log of the chance that a clean text of this length has so good a segment, and the number of good segments."""
    # the number of such segments that chance gives
    expected = model.size * np.maximum(tokens, 1) * np.exp(-model.scale * best)
    surprise = -np.log(np.maximum(-np.expm1(-expected), 1e-30))
    return np.stack([np.ones(len(best)), np.minimum(surprise, 40.0) / 4, np.log1p(above), np.minimum(best, 30.0) / 4, np.log1p(tokens) / 4], axis=1)


def _fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> np.ndarray:
    """Weights of a logistic fit with a ridge, by Newton steps that are halved until the loss falls, so that classes that can be told apart perfectly do no harm."""

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - y * z).sum() + ridge / 2 * (w @ w))

    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> ToxicModel:
    """Learn from at most `labelled` rows of labels(doc_id, toxic) and the token counts of all docs.

    The driver gets the tokens that occur in toxic documents of that sample, and one row of figures for each
    of its documents; both are bounded by the sample.
    """
    labels = labels.where("doc_id is not null and toxic is not null").select("doc_id", "toxic")
    sample = written(labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled))
    counts = written(token_counts(docs, sample))
    totals = counts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("every", "t0", "c0", "t1", "c1"))).first()
    short = counts.where(f"length(token) > {BEGINNING}").groupBy(F.substring("token", 1, BEGINNING).alias("token")).agg(*(F.sum(c).alias(c) for c in ("every", "t0", "c0", "t1", "c1")))
    tables = []
    for found in (counts, short):
        top = found.where(f"t0 + t1 >= {LEAST_SEEN}").orderBy("token")
        tables.append(top.toPandas().assign(t=lambda x: x["t0"] + x["t1"], c=lambda x: x["c0"] + x["c1"]))

    def model(toxic: str, clean: str, n_toxic: float, n_clean: float) -> ToxicModel:
        made = []
        for frame in tables:
            weight = log_odds(frame, toxic, clean, n_toxic, n_clean, totals["every"])
            made.append({t: float(w) for t, w in zip(frame["token"], weight, strict=True) if w > DRIFT})
        return ToxicModel(*made)

    whole = model("t", "c", totals["t0"] + totals["t1"], totals["c0"] + totals["c1"])
    # each fold is scored by the other's weights, so that the calibration sees texts the weights have not
    folds = [model("t1", "c1", totals["t1"], totals["c1"]), model("t0", "c0", totals["t0"], totals["c0"])]
    shared = docs.sparkSession.sparkContext.broadcast(folds)

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        caches = [_scorer(m) for m in shared.value]
        for part in in_slices(frames, "text"):
            rows = [passages([t], shared.value[f], caches[f])[0] for t, f in zip(part["text"], part["_fold"], strict=True)]
            best = [max([s for *_, s in found], default=0.0) for _, found in rows]
            yield pd.DataFrame({"toxic": part["toxic"].to_numpy(), "n": [n for n, _ in rows], "best": best, "found": [len(found) for _, found in rows]})

    known = sample.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic"), _fold_of("doc_id").alias("_fold"))
    rows = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("_id")).select("text", "toxic", "_fold")
    seen = rows.mapInPandas(solid(score), "toxic int, n long, best double, found long").toPandas()
    clean = seen[seen["toxic"] == 0]
    tops = clean["best"].to_numpy()
    if (tops > 0).sum() >= 10:
        # moments of the exceedances: the tail of the law is exponential
        whole.scale = float(np.clip(1 / max(tops[tops > 0].mean(), 1e-3), 0.2, 3.0))
        whole.size = float((tops > 0).sum() / max(clean["n"].sum(), 1))
    if seen["toxic"].nunique() > 1:
        x = features(seen["n"].to_numpy(), seen["best"].to_numpy(), seen["found"].to_numpy(), whole)
        fitted = _fit_logistic(x, seen["toxic"].to_numpy(dtype=float))
        weak, strong = features(np.array([200, 200]), np.array([0.0, 8.0]), np.array([0, 1]), whole) @ fitted
        if strong > weak:  # else the folds were too small to learn from; the default stays
            whole.logistic = tuple(fitted)
    return whole


def predict(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """doc_id, score, n_segments, spans (start and end token of each significant passage) of every text; one narrow stage.

    Null and empty texts have no passages and get the score of a text without any. A very long text is scanned
    whole, in linear time. Equal texts have equal scores. Repeated rows, null doc_ids and other columns change nothing;
    an empty table gives no rows. The model has the tokens of the labelled sample only.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        cache, w = _scorer(m), np.array(m.logistic)
        for part in in_slices(frames, "text"):
            rows = passages([t if isinstance(t, str) else "" for t in part["text"]], m, cache)
            best = np.array([max([s for *_, s in found], default=0.0) for _, found in rows])
            x = features(np.array([n for n, _ in rows]), best, np.array([len(found) for _, found in rows]), m)
            score = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            spans = [[{"start": s, "end": e, "score": v} for s, e, v in found] for _, found in rows]
            yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "score": score, "n_segments": [len(s) for s in spans], "spans": spans})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(solid(run), f"doc_id {kind}, score double, n_segments int, spans array<struct<start:int,end:int,score:double>>")
