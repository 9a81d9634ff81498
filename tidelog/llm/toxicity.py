"""Toxicity scores by weak supervision.

Lexicons are mined from labelled training rows: words and word beginnings that
are far more frequent in toxic documents, those first that tell most about the
label. Many voters, each a part of the lexicon or a pattern of the text, vote
toxic, clean or nothing on every training document. A generative label model
estimates by expectation maximisation how each voter votes for either class,
and from the voters' correlations within the classes how much of each vote is
news; its sums run over the table of all different vote patterns with their
numbers of documents. A logistic regression is trained on the model's posterior
labels and scores every whole text. Each text is read for its signs once.

Only rows whose crc32(doc_id as text) modulo 5 is not 0 are learned from. The
lexicon and the regression are fitted on a bounded sample: ``MAX_LABELLED`` rows
for each label, those with the smallest hash of the id, weighted to the labels'
shares. The label model takes all training rows. Scores use nothing but the text.

Cases with a defined result: a null text is scored as an empty one; an empty
text gets the score of a text without any sign; a text of any length is read
whole; without labelled rows of both kinds, or without documents to learn from,
every score is 0; contradictory or repeated labels of an id count as toxic if
any is; repeated rows get equal scores; a null doc_id is scored, never held out
and never labelled; only doc_id and text, and of the labels doc_id and toxic,
are read, whatever other columns are called; an empty table gives an empty
result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._batches import arrow_map, list_array
from .storage import scratch, written

MAX_LABELLED = 4_000
#: Most rounds of expectation maximisation, and the change of a posterior that ends them.
ROUNDS, SETTLED = 12, 1e-3
#: Units of the lexicon; units in fewer toxic documents, or with smaller log odds, are left out.
UNITS, LEAST_DOCS, LEAST_ODDS = 256, 4, 3.5
#: Units that one lexicon voter looks for.
UNITS_PER_VOTER = 8
PREFIXES = (4, 5, 6)
FOLDS = 5
#: Words whose units a worker keeps.
CACHE_WORDS = 400_000
_WORD = re.compile(r"[^\W\d_]+").findall
_ADDRESS = re.compile(r"\b(?:you|your|tu|du|usted|vous|ihr)\b").findall
PATTERNS = 6


def _parts(word: str) -> list[str]:
    """The units of a word: itself, and its beginnings marked by a hyphen."""
    return [word, *(f"{word[:n]}-" for n in PREFIXES if len(word) >= n)]


class Units(dict):
    """Positions of the units in each word, filled as words come up."""

    def __init__(self, units: list[str]):
        super().__init__()
        self.at = {u: i for i, u in enumerate(units)}

    def __missing__(self, word: str) -> tuple[int, ...]:
        found = tuple(self.at[p] for p in _parts(word) if p in self.at)
        if len(self) < CACHE_WORDS:
            self[word] = found
        return found


def signs(texts: list[str | None], units: Units) -> np.ndarray:
    """Counts of the units in each text, and after them the figures of the patterns."""
    m = len(units.at)
    table = np.zeros((len(texts), m + PATTERNS), np.float32)
    for row, text in zip(table, texts, strict=True):
        if not text:
            continue
        words = _WORD(text.lower())
        hits = [i for ids in filter(None, map(units.__getitem__, words)) for i in ids]
        for i in hits:
            row[i] += 1
        n = max(1, len(words))
        some = text[:1] and text.count
        row[m:] = (len(words), np.count_nonzero(row[:m]), len(hits) / n, len(_ADDRESS(text.lower())) / n, some("!") / n, sum(map(str.isupper, text)) / max(1, len(text)))
    return table


def votes(table: np.ndarray) -> np.ndarray:
    """1 toxic, -1 clean, 0 no vote; a column for each voter."""
    m = table.shape[1] - PATTERNS
    counts, pattern = table[:, :m], table[:, m:]
    parts = [np.arange(a, m, -(-m // UNITS_PER_VOTER)) for a in range(-(-m // UNITS_PER_VOTER))] if m else []
    columns = [np.where((counts[:, p] > 0).any(axis=1), 1, 0) for p in parts]
    n, distinct, density, address, shout, upper = pattern.T
    columns += [
        np.where(distinct == 0, -1, 0),
        np.where(distinct >= 2, 1, np.where(distinct == 0, -1, 0)),
        np.where(distinct >= 4, 1, 0),
        np.where(density > 0.01, 1, np.where((density == 0) & (n >= 20), -1, 0)),
        np.where((density > 0) & (n < 60), 1, 0),
        np.where((address > 0.02) & (distinct > 0), 1, 0),
        np.where(shout > 0.2, 1, 0),
        np.where(upper > 0.5, 1, 0),
        np.where((n < 5) & (distinct == 0), -1, 0),
    ]
    return np.stack(columns, axis=1).astype(np.int8)


@dataclass
class LabelModel:
    """How voters vote for each class, and the share of a vote that counts."""

    prior: float
    table: np.ndarray  # voter, vote + 1, class
    share: np.ndarray

    def posterior(self, v: np.ndarray) -> np.ndarray:
        log = np.log(self.table)
        odds = (log[:, :, 1] - log[:, :, 0]) * self.share[:, None]
        total = np.log(self.prior / (1 - self.prior)) + sum(odds[j, v[:, j] + 1] for j in range(v.shape[1]))
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def sums(v: np.ndarray, post: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What a round of estimation needs of n rows each of votes ``v`` with posterior ``post``; adds up over tables."""
    m = v.shape[1]
    value, total, likely = v.astype(np.float64), n.astype(np.float64), n * post
    kinds = [np.stack([(v == k - 1).T.astype(np.float64) @ w for k in range(3)], axis=1) for w in (total - likely, likely)]  # voter, vote
    parts = [[total.sum(), likely.sum(), (likely * post).sum()], kinds[0].ravel(), kinds[1].ravel(), value.T @ total, value.T @ likely, ((value * total[:, None]).T @ value).ravel()]
    return np.concatenate(parts) if m else np.array(parts[0])


def estimated(s: np.ndarray, m: int) -> LabelModel:
    """The label model of the sums."""
    n, p, pp = s[:3]
    clean, toxic = s[3 : 3 + 3 * m].reshape(m, 3), s[3 + 3 * m : 3 + 6 * m].reshape(m, 3)
    sv, spv = s[3 + 6 * m : 3 + 7 * m], s[3 + 7 * m : 3 + 8 * m]
    svv = s[3 + 8 * m :].reshape(m, m)
    table = np.stack([clean, toxic], axis=2) + 0.5
    table /= table.sum(axis=1, keepdims=True)
    # correlation of the voters once the class is known: of what is left of the votes without the classes' means
    mean = np.einsum("mkc,k->mc", table, np.array([-1.0, 0.0, 1.0]))
    low, step = mean[:, 0], mean[:, 1] - mean[:, 0]
    left = svv - np.outer(sv, low) - np.outer(low, sv) - np.outer(spv, step) - np.outer(step, spv)
    left += n * np.outer(low, low) + p * (np.outer(low, step) + np.outer(step, low)) + pp * np.outer(step, step)
    spread = np.sqrt(np.maximum(np.diag(left), 0) / n) + 1e-9
    corr = left / n / np.outer(spread, spread)
    np.fill_diagonal(corr, 0)
    corr[np.abs(corr) < 0.1] = 0
    return LabelModel(float(np.clip(p / n, 0.005, 0.9)), table, 1 / (1 + np.abs(corr).sum(axis=0)))


def _scaled(table: np.ndarray) -> np.ndarray:
    """Features of the classifier: damped counts, and the patterns that don't depend on the length alone."""
    m = table.shape[1] - PATTERNS
    p = table[:, m:]
    return np.concatenate([np.log1p(table[:, :m]), np.minimum(p[:, 1:2], 8) / 4, np.minimum(p[:, 2:3] * 50, 2), (p[:, 1:2] == 0).astype(np.float32), p[:, 3:6]], axis=1).astype(np.float64)


def fit_linear(x: np.ndarray, target: np.ndarray, weight: np.ndarray, l2: float = 1e-3, steps: int = 400) -> np.ndarray:
    """Logistic regression on soft labels of weighted rows, by accelerated gradient descent; the last weight is the bias."""
    a = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    share = weight / weight.sum()
    w, old = np.zeros(a.shape[1]), np.zeros(a.shape[1])
    rate = 1 / (0.25 * np.linalg.norm(a * np.sqrt(share)[:, None], 2) ** 2 + l2)
    for k in range(steps):
        y = w + k / (k + 3) * (w - old)
        p = 1 / (1 + np.exp(-np.clip(a @ y, -30, 30)))
        penalty = l2 * y
        penalty[-1] = 0
        old, w = w, y - rate * (a.T @ (share * (p - target)) + penalty)
    return w


@dataclass
class Model:
    units: list[str]
    weights: np.ndarray

    def score(self, table: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.zeros(len(table))
        x = _scaled(table)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def _remainder(doc_id):
    return F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(FOLDS))


def _known(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of the labelled training rows."""
    return labels.filter((_remainder(F.col("doc_id")) != 0) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))


def _sampled(known: DataFrame) -> DataFrame:
    """The bounded sample of labelled ids, with the weight that gives the labels their shares."""
    first = lambda k: known.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    total = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    weight = F.when(F.col("toxic") == 1, max(1.0, total.get(1, 0) / MAX_LABELLED)).otherwise(max(1.0, total.get(0, 0) / MAX_LABELLED))
    return written(first(1).union(first(0)).withColumn("weight", weight))


def _lexicon(sample: DataFrame) -> list[str]:
    """Units that speak for toxic documents, by what they tell about the label."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts: dict[str, list[int]] = {}
        for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            for u in {p for w in set(_WORD(text.lower())) for p in _parts(w)}:
                counts.setdefault(u, [0, 0])[label] += 1
        clean, toxic = zip(*counts.values(), strict=True) if counts else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(toxic, pa.int64()), pa.array(clean, pa.int64())], ["unit", "toxic", "clean"])

    rows = sample
    size = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if not size.get(0) or not size.get(1):
        return []
    counts = rows.mapInArrow(arrow_map(run), "unit string, toxic long, clean long").groupBy("unit").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    t, c, n_t, n_c = F.col("t"), F.col("c"), size[1], size[0]
    odds = F.log((t + 0.5) / (n_t - t + 0.5)) - F.log((c + 0.5) / (n_c - c + 0.5))
    part = lambda x: F.when(x > 0, x * F.log(x)).otherwise(0.0)
    news = part(t) + part(c) + part(n_t - t) + part(n_c - c) - part(t + c) - part(n_t + n_c - t - c)  # the label's information, up to a constant
    best = counts.filter((t >= LEAST_DOCS) & (odds > LEAST_ODDS)).orderBy(news.desc(), "unit").limit(UNITS)
    return [r["unit"] for r in best.select("unit").collect()]


def _signs(df: DataFrame, units: list[str]) -> DataFrame:
    """(doc_id, units, counts, figures): the signs of every text; most have few."""
    cache: list[Units] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not cache:
            cache.append(Units(units))
        table = signs(batch.column("text").to_pylist(), cache[0])
        row, unit = np.nonzero(table[:, : len(units)])
        counts = np.bincount(row, minlength=len(table))
        lists = [list_array(pa.array(unit.astype(np.int16)), counts), list_array(pa.array(table[row, unit]), counts)]
        figures = list_array(pa.array(table[:, len(units) :].ravel()), np.full(len(table), PATTERNS))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *lists, figures], ["doc_id", "units", "counts", "figures"])

    return df.select(F.col("doc_id").cast("long"), "text").mapInArrow(arrow_map(run), "doc_id long, units array<short>, counts array<float>, figures array<float>")


def _table(batch: pa.RecordBatch, m: int) -> np.ndarray:
    """The signs of a batch as a table again."""
    table = np.zeros((batch.num_rows, m + PATTERNS), np.float32)
    row = np.repeat(np.arange(batch.num_rows), batch.column("units").value_lengths().to_numpy(zero_copy_only=False))
    table[row, batch.column("units").flatten().to_numpy(zero_copy_only=False)] = batch.column("counts").flatten().to_numpy(zero_copy_only=False)
    table[:, m:] = batch.column("figures").flatten().to_numpy(zero_copy_only=False).reshape(-1, PATTERNS)
    return table


def _patterns(signs_: DataFrame, known: DataFrame, m: int) -> DataFrame:
    """(votes, many, toxic, n): the different votes of the training documents, with the number of signs (4 at most) and the label (-1 without one)."""
    few = signs_.filter(F.col("doc_id").isNotNull() & (_remainder(F.col("doc_id")) != 0))
    labelled = few.join(known, "doc_id", "left").withColumn("toxic", F.coalesce("toxic", F.lit(-1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = _table(batch, m)
            rows = np.ascontiguousarray(votes(table))
            raw = pa.array([r.tobytes() for r in rows], pa.binary())
            many = pa.array(np.minimum(table[:, m + 1], 4).astype(np.int32))
            yield pa.RecordBatch.from_arrays([raw, many, batch.column("toxic")], ["votes", "many", "toxic"])

    return labelled.select("units", "counts", "figures", "toxic").mapInArrow(run, "votes binary, many int, toxic int").groupBy("votes", "many", "toxic").agg(F.count("*").alias("n"))


def fit_label_model(v: np.ndarray, start: np.ndarray, rounds: int = ROUNDS) -> LabelModel:
    """Expectation maximisation over votes at hand; ``start`` holds first guesses of the labels."""
    one, post = np.ones(len(v)), np.clip(start, 0.02, 0.98)
    for _ in range(rounds):
        model = estimated(sums(v, post, one), v.shape[1])
        old, post = post, model.posterior(v)
        if np.abs(post - old).max() < SETTLED:
            break
    return model


def fit_over_patterns(patterns: DataFrame, m: int) -> LabelModel:
    """The same over a written table of vote patterns."""
    # first guesses: the labels, and for other rows the share among labelled rows with as many signs
    seen = {(r["many"], r["toxic"]): r["n"] for r in patterns.filter("toxic >= 0").groupBy("many", "toxic").agg(F.sum("n").alias("n")).collect()}  # ten rows at most
    share = np.array([(seen.get((k, 1), 0) + 0.1) / (seen.get((k, 0), 0) + seen.get((k, 1), 0) + 1) for k in range(5)])

    def posterior(model: LabelModel | None, v: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
        if model is not None:
            return model.posterior(v)
        label = batch.column("toxic").to_numpy(zero_copy_only=False)
        return np.clip(np.where(label >= 0, label, share[batch.column("many").to_numpy(zero_copy_only=False)]), 0.02, 0.98)

    def round_of(old: LabelModel | None, now: LabelModel | None) -> tuple[np.ndarray, float]:
        """Sums under a model, and how far a posterior is from the one under the model before."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, most = None, 0.0
            for batch in batches:
                v = np.frombuffer(b"".join(batch.column("votes").to_pylist()), np.int8).reshape(batch.num_rows, m)
                post = posterior(now, v, batch)
                part = sums(v, post, batch.column("n").to_numpy(zero_copy_only=False))
                total = part if total is None else total + part
                if now is not None:
                    most = max(most, float(np.abs(post - posterior(old, v, batch)).max()))
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(total)), pa.int32()), pa.array(np.append(most, total))], ["i", "x"])

        added = patterns.mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x"), F.max("x").alias("most")).collect()  # one row for each sum
        by = {r["i"]: r for r in added}
        return np.array([by[i]["x"] for i in range(len(by) - 1)]), by[-1]["most"]

    old = now = None
    for _ in range(ROUNDS):
        total, change = round_of(old, now)
        if now is not None and change < SETTLED:
            break
        old, now = now, estimated(total, m)
    return now


def train(df: DataFrame, labels: DataFrame) -> tuple[Model, DataFrame]:
    """The classifier, and the signs of all documents."""
    known = _known(labels)
    sample = _sampled(known)
    texts = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    units = _lexicon(written(texts.join(F.broadcast(sample), "doc_id")))  # two times MAX_LABELLED rows at most
    found = written(_signs(df, units))
    if not units:
        return Model([], np.zeros(0)), found
    m = votes(np.zeros((1, len(units) + PATTERNS), np.float32)).shape[1]
    model = fit_over_patterns(written(_patterns(found, known, len(units))), m)
    rows = found.join(F.broadcast(sample), "doc_id").select("units", "counts", "figures", "weight").orderBy("units", "counts", "figures").toArrow()  # bounded, as the sample is
    batch = rows.combine_chunks().to_batches()[0]
    table = _table(batch, len(units))
    return Model(units, fit_linear(_scaled(table), model.posterior(votes(table)), batch.column("weight").to_numpy(zero_copy_only=False))), found


def score(signs_: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(_table(batch, len(model.units))), pa.float64())], ["doc_id", "score"])

    return signs_.mapInArrow(run, "doc_id long, score double")


def contract(df: DataFrame, labels: DataFrame) -> DataFrame:
    with scratch(df.sparkSession) as keep:
        model, found = train(df, labels)
        keep(found)
    scored = score(found, model)
    held = F.coalesce(_remainder(F.col("doc_id")) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))
