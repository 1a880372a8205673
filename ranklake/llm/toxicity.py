"""Toxicity by weak supervision.

Voters are lexicon entries (words that the labelled rows tie to toxicity, in any language) and fixed
patterns.  A generative label model treats the true label as hidden: by EM it estimates how often
each voter fires in either class, given what its parent says in a tree of the strongest dependences
between voters, so that correlated voters count once; the labels are one more, noisy voter.  Its
posteriors are the targets of a linear (logistic) classifier over votes and their densities, which
scores every whole text.

The lexicon and both models are fitted on the rows of at most ``max_fit`` labelled ids, chosen by
hash: a bounded sample.  Rows with ``crc32(id as text) % 4 = 2`` are held out.  Labels, language,
source and id are never inputs of a score.

Defined results: null and empty texts have no votes and the score of the intercept alone; without
labelled rows, or with labels of one class only, the score is the known share of toxic rows (0 if
none); of several labels of one id the largest counts; labels other than 0 and 1 are none; repeated
rows stay repeated; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

LETTERS = re.compile(r"[^\W\d_]+")
PATTERNS = [
    re.compile(r"\b(?:you|u|he|she|they|we|it)\s+(?:are|r|is)\s+(?:all\s+|such\s+)?(?:an?\s+|so\s+)?(?:idiots?|stupid|morons?|losers?|trash|scum|pathetic|worthless|disgusting)", re.I),
    re.compile(r"\bshut\s+up\b|\bgo\s+to\s+hell\b|\bkill\s+yourself\b|\bi\s+hate\s+you\b", re.I),
    re.compile(r"!{3,}"),
    re.compile(r"(?:\b[^\W\d_a-zß-öø-ÿ]{4,}\b[\s!]*){4,}"),
]


def held_out(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % 4 == 2


def words_of(text: str | None) -> list[str]:
    return LETTERS.findall((text or "").lower())


@dataclass
class Model:
    lexicon: list[str]
    weights: np.ndarray
    intercept: float

    def features(self, text: str | None) -> np.ndarray:
        """Votes, then the number of entries found (log) and their share of the words."""
        found = np.zeros(len(self.lexicon))
        index, words = self.index, words_of(text)
        hits = 0
        for w in words:
            i = index.get(w)
            if i is not None:
                found[i] = 1
                hits += 1
        fixed = [float(bool(p.search(text or ""))) for p in PATTERNS]
        return np.concatenate([found, fixed, [np.log1p(hits), min(1.0, 20 * hits / len(words)) if words else 0.0]])

    @property
    def index(self) -> dict[str, int]:
        if not hasattr(self, "_index"):
            self._index = {w: i for i, w in enumerate(self.lexicon)}
        return self._index

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.features(text) @ self.weights + self.intercept, -30, 30))))


def tree(votes: np.ndarray, weights: np.ndarray, least: float = 0.01) -> np.ndarray:
    """Each voter's parent in the tree of strongest dependence given the class, -1 for none (Chow and Liu).

    ``weights`` are the posteriors of both classes.  Dependence is mutual information in nats; links under ``least`` are left out.
    """
    n, j = votes.shape
    info = np.zeros((j, j))
    for q in (w.astype(np.float32) for w in weights):
        total = q.sum() + 4
        both = (votes * q[:, None]).T @ votes + 1
        ones = (votes * q[:, None]).sum(0) + 2
        for x, y in ((1, 1), (1, 0), (0, 1), (0, 0)):
            joint = both if x and y else ones[:, None] - both if x else ones[None, :] - both if y else total - ones[:, None] - ones[None, :] + both
            joint = np.maximum(joint, 0.5)
            of_x, of_y = (ones if x else total - ones), (ones if y else total - ones)
            info += joint / n * np.log(joint * total / (of_x[:, None] * of_y[None, :]))
    parent, best, inside = np.full(j, -1), np.full(j, least), np.zeros(j, bool)
    for _ in range(j):  # Prim's way; a voter whose best link is too weak starts a tree of its own
        i = int(np.where(inside, -np.inf, best).argmax())
        inside[i] = True
        closer = (info[i] > best) & ~inside
        best[closer], parent[closer] = info[i][closer], i
    return parent


def label_model(votes: np.ndarray, labels: np.ndarray, trust: float = 0.97, rounds: int = 25) -> np.ndarray:
    """Posterior of class 1 for each row of 0/1 ``votes``; ``labels`` are 0, 1 or -1 for none.

    A label is one more voter, right with probability ``trust``.  The others depend on the class and
    on one other voter, their parent: accuracies and correlations are rates by class and parent's vote.
    """
    noisy = np.log(trust / (1 - trust)) * np.where(labels < 0, 0, 2 * labels - 1)
    known = labels >= 0
    share = np.clip(labels[known].mean(), 1e-4, 1 - 1e-4)
    posterior = np.where(known, np.where(labels == 1, trust, 1 - trust), share)
    votes = votes.astype(np.uint8)
    average = (votes.sum(0) + 0.5) / (len(votes) + 1)
    for r in range(rounds):
        classes = (1 - posterior, posterior)
        if r % 5 == 0:
            parent = tree(votes.astype(np.float32), classes)
            # a voter's vote beside its parent's, one byte each
            pairs = [votes[:, j] + (2 * votes[:, i] if i >= 0 else 0) for j, i in enumerate(parent)]
        logit = noisy + np.log(np.clip(posterior.mean(), 1e-4, 1 - 1e-4) / np.clip(1 - posterior.mean(), 1e-4, 1))
        for j, pair in enumerate(pairs):
            rate = [(n[1::2] + average[j]) / (n[::2] + n[1::2] + 1) for n in (np.bincount(pair, weights=q, minlength=4) for q in classes)]
            logit += np.log(np.stack([(1 - rate[1]) / (1 - rate[0]), rate[1] / rate[0]], axis=1)).ravel()[pair]
        posterior = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return posterior


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Weights and intercept by Newton's method."""
    x1 = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(x1.shape[1]), np.full(x1.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        step = np.linalg.solve((x1 * (p * (1 - p) + 1e-9)[:, None]).T @ x1 + np.diag(penalty), x1.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def fit(rows: DataFrame, *, tasks: int = 16, min_share: float = 0.01, min_odds: float = 3.0) -> Model:
    """A model from ``rows(doc_id, text, toxic)``, a bounded sample whose ``toxic`` is 0, 1 or null for unlabelled texts.

    A word is a voter if it occurs in ``min_share`` of the toxic texts, four at least, with log odds of ``min_odds``.
    """
    sample = checkpoint(rows.repartition(tasks, "doc_id"))
    n = sample.agg(F.count("toxic").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("bad")).first()
    if n.bad in (0, n.n):
        share = n.bad / n.n if n.n else 0.0
        return Model([], np.zeros(len(PATTERNS) + 2), 30.0 if share else -30.0)

    def words(batches):
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                found = sorted(set(words_of(text.as_py())))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([toxic] * len(found), pa.int32())], names=["word", "toxic"])

    marked = sample.select("text", F.col("toxic").cast("int"))
    seen = marked.filter("toxic is not null").mapInArrow(words, "word string, toxic int")
    seen = seen.groupBy("word").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    least = max(4, int(min_share * n.bad))
    odds = F.log((F.col("bad") + 0.5) / (n.bad + 1)) - F.log((F.col("good") + 0.5) / (n.n - n.bad + 1))
    chosen = seen.filter((F.col("bad") >= least) & (odds >= min_odds)).select("word").collect()
    model = Model(sorted(r.word for r in chosen), np.zeros(0), 0.0)
    width = len(model.lexicon) + len(PATTERNS) + 2

    def featured(batches):
        for batch in batches:
            x = np.array([model.features(text.as_py()) for text in batch.column(0)], np.float32).reshape(-1, width)
            for i in range(0, len(x), 1024):
                part = x[i : i + 1024]
                yield pa.RecordBatch.from_arrays([pa.array([part.tobytes()], pa.binary()), pa.array([batch.column(1)[i : i + 1024].to_pylist()], pa.list_(pa.int32()))], names=["x", "toxic"])

    got = marked.mapInArrow(featured, "x binary, toxic array<int>").collect()
    x = np.concatenate([np.frombuffer(r.x, np.float32).reshape(-1, width) for r in got])
    y = np.array([-1 if t is None else t for r in got for t in r.toxic])
    posterior = label_model(x[:, :-2], y)
    model.weights, model.intercept = logistic(x, posterior)
    return model


def score(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, max_fit: int = 20_000, **options) -> DataFrame:
    """``(id, held_out, score, predicted)`` of every row; ``labels(id, toxic)`` are learned from but for held-out rows."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    marks = labels.select(F.col(id_col).cast("bigint").alias("doc_id"), "toxic").filter(~held_out(F.col("doc_id")))
    # chosen by ids alone, and at most ``max_fit`` of them: broadcast, so that no text is shuffled
    order = F.xxhash64("doc_id")
    marks = marks.groupBy("doc_id").agg(F.max(F.when(F.col("toxic").isin(0, 1), F.col("toxic"))).alias("toxic"))
    sample = marks.filter("toxic is not null").orderBy(order, "doc_id").limit(max_fit)
    model = fit(rows.join(F.broadcast(sample), "doc_id"), **options)

    def run(batches):
        for batch in batches:
            scores = [model.score(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    out = rows.mapInArrow(run, "doc_id bigint, score double")
    return out.select(F.col("doc_id").alias(id_col), F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
