"""Quality classifier with hierarchical empirical Bayes.

Document evidence: two logistic models, low quality over binned shape features of the whole text and words,
toxicity over words alone. Words enter by the presence of those words and word beginnings (4 and 6 characters: stems, in languages that inflect or
compound) whose share of the labelled positives is far from their share of the rest. They are fitted on at most `sample_rows` labelled documents, chosen by a hash of the id.

Site evidence: the documents' probabilities are summed by host and path (one grouped aggregation with
partial sums, so a host that holds a third of all rows is no hot key). A path's rate is shrunk toward its
host's rate and that toward the global rate; how strongly is estimated from the spread between sites
(method of moments of a beta-binomial), so sites with few documents stay near the prior. The document
itself is left out of its own path's and host's sums. A document's posterior log-odds are its own plus the shift of
its path's rate against the global rate. Texts are scored once; scores and the columns to keep are staged.

Cases: a null or empty text is of low quality by rule (nothing to learn from); null hosts and paths are
sites of their own; labels that repeat an id count once (the smaller values), labels without a value or
document are ignored; without labels, or with labels of one kind only, that model's evidence is its base
rate; rows that repeat each get their row; equal texts of one site get equal posteriors; a very long text is scored whole, by one
worker, which holds its words; an empty table stays empty; further columns are kept, whatever their names, but one called
like `report` is replaced. Ids only link labels to texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SAMPLE_ROWS = 6000
WORD_BITS = 20
MOST_WORDS = 400
MIN_Z = 6.0
LEAST_SEEN = 5  # documents that a word must be in to be considered
UPPER = bytes(range(65, 91))
LETTERS = bytes([*range(65, 91), *range(97, 123), *range(128, 256)])
SPACE_DIGITS = b" \t\r\n0123456789"
STOPS = b".,;:!?'\"()-"
SHAPES = ("log words", "words a byte", "distinct", "repeats", "upper", "marks", "digits", "longest word", "lines a word")


def shapes(raw: bytes, words: list[bytes], distinct: int) -> list[float]:
    n, k = max(1, len(raw)), max(1, len(words))
    letters = n - len(raw.translate(None, LETTERS))
    rest = n - letters - (n - len(raw.translate(None, SPACE_DIGITS)))
    return [
        np.log1p(len(words)), len(words) / n, np.log1p(distinct) / np.log1p(k), sum(map(eq, words, words[1:])) / k,
        (n - len(raw.translate(None, UPPER))) / max(1, letters), (rest - (n - len(raw.translate(None, STOPS)))) / n,
        (n - len(raw.translate(None, b"0123456789"))) / n, float(max(map(len, words), default=0)), raw.count(b"\n") / k,
    ]


def word_ids(word: bytes) -> tuple[int, ...]:
    """Feature numbers of the word and of its beginnings."""
    text = word.decode()
    forms = [word, *(b"^" + text[:k].encode() for k in (4, 6) if len(text) > k)]
    return tuple(xxhash.xxh3_64_intdigest(f) & ((1 << WORD_BITS) - 1) for f in forms)


class _Ids(dict):
    """Word to those of its feature numbers that are in `chosen` (all, if None); emptied when it has grown large."""

    def __init__(self, chosen: set[int] | None = None):
        super().__init__()
        self.chosen = chosen

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) > 100_000:
            self.clear()
        own = word_ids(word)
        value = self[word] = own if self.chosen is None else tuple(i for i in own if i in self.chosen)
        return value


@dataclass
class Logistic:
    """Log-odds = bias + weights of the shape bins + weights of the words present."""

    bias: float = 0.0
    bins: np.ndarray = field(default_factory=lambda: np.zeros((len(SHAPES), 1)))
    words: dict[int, float] = field(default_factory=dict)


@dataclass
class Evidence:
    edges: list[np.ndarray]
    low: Logistic
    toxic: Logistic

    def __post_init__(self) -> None:
        self.known = _Ids({*self.low.words, *self.toxic.words})

    def score(self, text: str | None) -> tuple[float, float]:
        """Probabilities of low quality and of toxicity."""
        raw = (text or "").encode()
        words = raw.translate(common.FOLD).split()
        if not words:
            return 1.0, 0.0
        distinct = set(words)
        place = [int(np.searchsorted(e, x)) for e, x in zip(self.edges, shapes(raw, words, len(distinct)))]
        present = set(chain.from_iterable(map(self.known.__getitem__, distinct)))
        out = []
        for model in (self.low, self.toxic):
            z = model.bias + sum(model.bins[i, p] for i, p in enumerate(place) if model.bins.shape[1] > 1)
            z += sum(model.words.get(i, 0.0) for i in present)
            out.append(float(1 / (1 + np.exp(-np.clip(z, -30, 30)))))
        return out[0], out[1]


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids = _Ids()
    for batch in batches:
        rows = []
        for text in batch.column("text"):
            raw = (text.as_py() or "").encode()
            words = raw.translate(common.FOLD).split()
            distinct = set(words)
            rows.append((shapes(raw, words, len(distinct)), sorted(set(chain.from_iterable(map(ids.__getitem__, distinct))))))
        yield pa.RecordBatch.from_arrays(
            [batch.column("low"), batch.column("toxic"), pa.array([s for s, _ in rows], pa.list_(pa.float64())), pa.array([w for _, w in rows], pa.list_(pa.int32()))],
            names=["low", "toxic", "shape", "words"],
        )


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.05, steps: int = 40) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the first column, the bias, is free."""
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], l2)
    ridge[0] = 1e-6
    for _ in range(steps):
        curve, slope = np.diag(ridge + 1e-9), -ridge * w
        for i in range(0, len(x), 512):  # in blocks, as the driver has little memory
            own = x[i : i + 512].astype(np.float64)
            p = 1 / (1 + np.exp(-np.clip(own @ w, -30, 30)))
            curve += (own * (p * (1 - p))[:, None]).T @ own
            slope += own.T @ (y[i : i + 512] - p)
        step = np.linalg.solve(curve, slope)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _fit_one(y: np.ndarray, places: np.ndarray, n_bins: int, words: list[np.ndarray], shaped: bool) -> Logistic:
    if not len(y) or y.all() or not y.any():
        rate = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.01
        return Logistic(bias=float(np.log(rate / (1 - rate))))
    present = np.zeros((2, 1 << WORD_BITS), np.int32)
    for w, t in zip(words, y):
        present[int(t), w] += 1
    n1, n0 = y.sum(), len(y) - y.sum()
    seen = np.flatnonzero(present.sum(axis=0) >= LEAST_SEEN)
    p0, p1 = present[0, seen] / n0, present[1, seen] / n1
    p = (present[:, seen].sum(axis=0) + 1) / (len(y) + 2)
    z = (p1 - p0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
    best = np.argsort(-np.abs(z), kind="stable")[:MOST_WORDS]
    chosen = np.sort(seen[best[np.abs(z[best]) > MIN_Z]])
    k = len(SHAPES) * n_bins
    x = np.zeros((len(y), 1 + k + len(chosen)), np.int8)
    x[:, 0] = 1
    if shaped:
        x[:, 1 : k + 1] = (places[:, :, None] == np.arange(n_bins)).reshape(len(y), -1)
    for i, w in enumerate(words):
        x[i, 1 + k + np.searchsorted(chosen, np.intersect1d(chosen, w))] = 1
    fit = _logistic(x, y)
    return Logistic(float(fit[0]), fit[1 : k + 1].reshape(len(SHAPES), n_bins), dict(zip(chosen.tolist(), fit[k + 1 :].tolist())))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Evidence:
    """Fit both models on at most sample_rows labelled documents."""
    own = labels.filter("quality is not null and toxic is not null").groupBy(F.col(id_col).alias("__id"))
    own = own.agg((1 - F.min("quality")).alias("low"), F.min("toxic").alias("toxic"))
    own = own.orderBy(F.xxhash64("__id"), "__id").limit(sample_rows)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).filter("text is not null")
    rows = rows.join(F.broadcast(own), "__id").select("text", "low", "toxic").mapInArrow(  # at most sample_rows rows
        _measured, "low int, toxic int, shape array<double>, words array<int>"
    )
    got = rows.toPandas()
    if not len(got):
        return Evidence([np.empty(0)] * len(SHAPES), Logistic(-4.6), Logistic(-4.6))
    x = np.array(got["shape"].tolist())
    edges = [np.unique(np.quantile(x[:, i], np.linspace(0.02, 0.98, 17))) for i in range(x.shape[1])]
    places = np.stack([np.searchsorted(e, x[:, i]) for i, e in enumerate(edges)], axis=1)
    n_bins = max(len(e) for e in edges) + 1
    words = [np.asarray(w) for w in got["words"]]
    fitted = [_fit_one(got[c].to_numpy().astype(float), places, n_bins, words, c == "low") for c in ("low", "toxic")]
    return Evidence(edges, *fitted)


def _logit(p: Column) -> Column:
    p = F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-9), p))
    return F.log(p / (1 - p))


KINDS = ("low", "toxic")


def strength(total: tuple[float, float], spread: tuple[float | None, float | None, int]) -> float:
    """How many documents a prior counts as: from the spread of sites' rates around the global one beyond what chance gives.

    total: documents and sum of their probabilities; spread: of sites with two documents or more the sum of n times the squared
    deviation, the sum of n, and their number.
    """
    rate = total[1] / total[0] if total[0] else 0.0
    if not spread[1] or rate in (0.0, 1.0):
        return 10_000.0
    within = rate * (1 - rate) * spread[2] / spread[1]
    between = max(spread[0] / spread[1] - within, 1e-9)
    return float(min(10_000.0, max(1.0, rate * (1 - rate) / between - 1)))


def site_sums(scored: DataFrame) -> tuple[DataFrame, dict[str, tuple[float, float, float]]]:
    """(host, path, n, low, toxic, host_n, host_low, host_toxic) and by kind the global rate and the strengths of a path's and of a
    host's prior, from (host, path, low, toxic)."""
    sums = [F.sum("n").alias("n"), *(F.sum(k).alias(k) for k in KINDS)]
    paths = common.staged(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), *(F.sum(k).alias(k) for k in KINDS)), "paths")
    hosts = common.staged(paths.groupBy("host").agg(*sums), "hosts")
    total = hosts.agg(*sums).first()
    numbers = {}
    for kind in KINDS:
        all_ = (total["n"] or 0, total[kind] or 0.0)
        rate = all_[1] / all_[0] if all_[0] else 0.0
        deviation = F.sum(F.col("n") * F.pow(F.col(kind) / F.col("n") - rate, 2))
        own = [strength(all_, tuple(s.filter("n > 1").agg(deviation, F.sum("n"), F.count(F.lit(1))).first())) for s in (paths, hosts)]
        numbers[kind] = (rate, *own)
    up = hosts.withColumnsRenamed({c: f"host_{c}" for c in ("n", *KINDS)})
    return common.join_sized(paths, up, ["host"], "inner"), numbers


@common.owned
def judge(
    docs: DataFrame,
    labels: DataFrame,
    host_col: str = "source",
    path_col: str = "lang",
    text_col: str = "text",
    sample_rows: int = SAMPLE_ROWS,
    id_col: str = "doc_id",
    columns: list[str] | None = None,
    report: str = "__judged",
) -> DataFrame:
    """docs (all columns, or those named) plus `report`: struct of evidence and posterior for low quality and toxicity, and kept."""
    evidence = fit(docs, labels, sample_rows, id_col, text_col)

    @F.pandas_udf("struct<low double, toxic double>")
    def score(texts: pd.Series) -> pd.DataFrame:
        found = pd.DataFrame([evidence.score(t) for t in texts], columns=["low", "toxic"], dtype=float)
        evidence.known.clear()  # the worker lives on and runs other stages
        return found

    names = [c for c in (columns or docs.columns) if c.lower() != report.lower()]
    site = [F.coalesce(F.concat(F.lit("s"), F.col(common.quoted(c)).cast("string")), F.lit("")).alias(n) for c, n in ((host_col, "host"), (path_col, "path"))]
    own = F.struct(*(F.col(common.quoted(c)) for c in names)).alias("row")
    # texts are scored once: the sums and the result read what is staged here
    scored = docs.select(*site, score(F.col(common.quoted(text_col)).cast("string")).alias("p"), own)
    scored = common.staged(scored.select("host", "path", F.col("p.low").alias("p_low"), F.col("p.toxic").alias("p_toxic"), "row"), "scored")
    sites, numbers = site_sums(scored.select("host", "path", F.col("p_low").alias("low"), F.col("p_toxic").alias("toxic")))
    sites = common.staged(sites, "sites")
    rows = common.join_sized(scored, sites, ["host", "path"], "left")
    posterior = {}
    for kind in KINDS:
        p, (rate, below, above) = F.col(f"p_{kind}"), numbers[kind]
        prior = (F.col(f"host_{kind}") - p + above * rate) / (F.col("host_n") - 1 + above)
        here = (F.col(kind) - p + below * prior) / (F.col("n") - 1 + below)
        z = _logit(p) + _logit(here) - _logit(F.lit(rate))
        posterior[kind] = F.when(p >= 1.0, 1.0).otherwise(1 / (1 + F.exp(-z)))
    judged = F.struct(
        "p_low", "p_toxic", posterior["low"].alias("low"), posterior["toxic"].alias("toxic"),
        ((posterior["low"] < 0.5) & (posterior["toxic"] < 0.5)).alias("kept"),
    )
    return rows.select(*(F.col("row").getField(c).alias(c) for c in names), judged.alias(report))


@common.owned
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    return judge(docs, labels, columns=["doc_id", "source", "lang"]).select(
        "doc_id", "source", "lang", F.col("__judged.p_low").alias("p_low"), F.col("__judged.p_toxic").alias("p_toxic"),
        F.col("__judged.low").alias("posterior_low"), F.col("__judged.toxic").alias("posterior_toxic"),
        F.col("__judged.kept").alias("kept"),
    )
