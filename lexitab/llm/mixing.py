"""Soft-membership mixing: document rates whose expected domain token totals match target weights.

A softmax regression on hashed words and punctuation, fitted on a bounded sample of the labelled table, gives every document a
posterior over domains. Rates r >= 0 minimise (S - T)' B (S - T), with S = sum of r * tokens * posterior, T the targets and
B the inverse of M = sum of tokens * posterior * posterior'. In the metric of the tokens a step of length 1 or more is right, and a
projected-gradient step is r <- max(0, z - length * posterior . B (S(z) - T)), where z runs ahead of r by Nesterov's momentum. Each round
is one distributed sum of as many numbers as there are domains (S(z) follows from S(r), being linear), and a document's
rate follows from the rounds' vectors alone, so no state is kept between rounds. Where the likeliest domain is one to keep,
1 stands in place of 0.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import cached_property
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexitab.llm._support import arrow_column, cut_columnar, fresh, hold, ship, utf8_parts

#: Words, runs of ASCII punctuation, and words said twice in a row are hashed to so many buckets.
BUCKETS = 1 << 18
#: The classifier keeps the buckets whose presence says most about the domain in its sample.
KEPT = 1_024
#: A bucket's share of the words counts so many times, up to 1.
DENSITY = 10.0
#: Labelled documents that the classifier is fitted on at most, about.
TRAIN_LIMIT = 4_000
#: Rounds at most; it ends before when the targets are met within TOLERANCE, or when SETTLED rounds gain less than a share.
ROUNDS, TOLERANCE = 200, 1e-6
#: With least rates the last tenths of a per cent take hundreds of rounds; bounds hold after any of them.
ROUNDS_KEEP = 30
SETTLED, SETTLED_SHARE = 10, 1e-3
#: Copies beyond the least rates are counted on to hold this part of another domain's target share.
PURE = 0.2
_WORD_MEMO = 300_000
_TO_WORDS = bytes(c if chr(c).isalnum() and c < 128 or c >= 128 else 32 for c in range(256))
_TO_SIGNS = bytes(c if 33 <= c < 127 and not chr(c).isalnum() else 32 for c in range(256))
_AGAIN = 1


class BucketOf(dict):
    """A token's bucket; forgets all when full."""

    def __init__(self, seed: int):
        super().__init__()
        self.seed = seed

    def __missing__(self, token: bytes) -> int:
        if len(self) >= _WORD_MEMO:
            self.clear()
        self[token] = out = zlib.crc32(token, self.seed) % BUCKETS
        return out


_word_bucket, _sign_bucket = BucketOf(0), BucketOf(1)


def _release() -> None:
    _word_bucket.clear()
    _sign_bucket.clear()


def token_buckets(raw: bytes | None) -> tuple[np.ndarray, int, int]:
    """The bucket of each token of a text, its words, and its white-space tokens."""
    if not raw:
        return np.zeros(0, np.int64), 0, 0
    words = raw.lower().translate(_TO_WORDS).split()
    signs = raw.translate(_TO_SIGNS).split()
    again = sum(map(eq, words, islice(words, 1, None)))
    found = np.empty(len(words) + len(signs) + again, np.int64)
    found[: len(words)] = list(map(_word_bucket.__getitem__, words))
    found[len(words) : len(words) + len(signs)] = list(map(_sign_bucket.__getitem__, signs))
    found[len(words) + len(signs) :] = _AGAIN
    return found, len(words), len(raw.split())


@dataclass
class DomainModel:
    """Softmax regression on the presence and the density of the kept buckets, each weighed by its log ratio between domains."""

    domains: list[str]
    kept: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # presences, then densities, x domains
    bias: np.ndarray

    @cached_property
    def place(self) -> np.ndarray:
        """The place of each bucket among the kept ones, or -1."""
        out = np.full(BUCKETS, -1, np.int32)
        out[self.kept] = np.arange(len(self.kept))
        return out

    def counted(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of the kept buckets among a text's, and how often each stands there."""
        at = self.place[found]
        counts = np.bincount(at[at >= 0], minlength=len(self.kept))
        some = np.flatnonzero(counts)
        return some, counts[some]

    def posterior(self, found: np.ndarray, words: int) -> np.ndarray:
        some, counts = self.counted(found)
        scale = self.scale[some]
        density = np.minimum(1.0, DENSITY * counts / max(1, words))
        logits = self.bias + scale @ self.weights[some] + (scale * density) @ self.weights[len(self.kept) + some]
        out = np.exp(logits - logits.max())
        return out / out.sum()


def fit_domains(model: DomainModel, rows: list[tuple[str, np.ndarray, np.ndarray, int]], steps: int = 300, rate: float = 0.05, decay: float = 1e-3) -> DomainModel:
    """Sets the weights from (domain, places, counts, words) of labelled documents, by Adam on the mean log loss; none leaves even posteriors."""
    if not rows:
        return model
    n, k = len(model.kept), len(model.domains)
    x = np.zeros((len(rows), 2 * n + 1), np.float32)
    y = np.zeros((len(rows), k), np.float32)
    x[:, -1] = 1
    for i, (domain, some, counts, words) in enumerate(rows):
        x[i, some] = model.scale[some]
        x[i, n + some] = model.scale[some] * np.minimum(1.0, DENSITY * counts / max(1, words))
        y[i, model.domains.index(domain)] = 1
    w, first, second = (np.zeros((2 * n + 1, k), np.float32) for _ in range(3))
    for step in range(1, steps + 1):
        logits = x @ w
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        gradient = x.T @ (p - y) / len(x) + decay * w
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient * gradient
        w -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    model.weights, model.bias = w[:-1].astype(np.float64), w[-1].astype(np.float64)
    return model


def labelled_sample(df: DataFrame, labels: DataFrame, domain: Column, domains: list[str], id_column: str, text_column: str, train_limit: int) -> DataFrame:
    """(doc_id, domain, text): one row for each of about train_limit labelled ids at most, however often df repeats an id.

    An id with several labels counts once with the smallest, one with several texts with the text of the least hash.
    """
    named = labels.select(F.col(id_column).alias("doc_id"), domain.alias("domain")).where(F.col("domain").isin(domains) & F.col("doc_id").isNotNull())
    named = named.groupBy("doc_id").agg(F.min("domain").alias("domain"))
    slots = 1 << 20
    share = min(slots, -(-train_limit * slots // max(1, named.count())))
    picked = named.where(F.pmod(F.xxhash64("doc_id", F.lit("mixing")), F.lit(slots)) < share)
    rows = df.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).join(F.broadcast(picked), "doc_id")
    return rows.groupBy("doc_id", "domain").agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def telling_buckets(sample: DataFrame, domains: list[str], sizes: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """The KEPT buckets of most mutual information with the domain, and in how many documents of each domain they are."""
    total = float(sum(sizes.values()))
    per = sample.select("domain", F.explode("found").alias("bucket")).groupBy("bucket").agg(*[F.count_if(F.col("domain") == d).alias(f"c{i}") for i, d in enumerate(domains)])
    share = sum((F.col(f"c{i}") for i in range(len(domains))), F.lit(0)) / total
    part = lambda p, q: F.when((p > 0) & (q > 0), p * F.ln(p / q)).otherwise(0.0)
    gain = F.lit(0.0)
    for i, d in enumerate(domains):
        own, prior = F.col(f"c{i}") / total, F.lit(sizes.get(d, 0) / total)
        gain = gain + part(own, share * prior) + part(prior - own, (1 - share) * prior)
    best = per.withColumn("gain", F.round(gain, 12)).orderBy(F.desc("gain"), "bucket").limit(KEPT).collect()
    best = sorted(best, key=lambda r: r["bucket"])
    return np.array([r["bucket"] for r in best], np.int64), np.array([[r[f"c{i}"] for i in range(len(domains))] for r in best], float).reshape(len(best), len(domains))


def train_domains(df: DataFrame, labels: DataFrame, domain: Column, domains: list[str], *, id_column: str = "doc_id", text_column: str = "text", train_limit: int = TRAIN_LIMIT) -> DomainModel:
    """The classifier of documents df from a labelled table with the same id column.

    domain is an expression over labels; rows without a domain of the list are ignored. Beyond train_limit labelled ids a hash
    of the id picks about as many; the driver gets the kept buckets of those, one document an id.
    """
    spark = df.sparkSession
    ship(spark)
    texts = labelled_sample(df, labels, domain, domains, id_column, text_column, train_limit)
    kind = texts.schema["doc_id"].dataType.simpleString()

    def read(batches):
        hold("mixing", _release)
        for batch in batches:
            rows = [token_buckets(raw) for raw in utf8_parts(batch.column("text"))]
            unique = [np.unique(found, return_counts=True) for found, _, _ in rows]
            columns = [pa.array([f for f, _ in unique], pa.list_(pa.int64())), pa.array([c for _, c in unique], pa.list_(pa.int64())), pa.array([n for _, n, _ in rows], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("domain"), *columns], ["doc_id", "domain", "found", "counts", "words"])

    sample = cut_columnar(texts.mapInArrow(read, f"doc_id {kind}, domain string, found array<long>, counts array<long>, words long"))
    sizes = {r["domain"]: r["n"] for r in sample.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    kept, documents = telling_buckets(sample, domains, sizes) if sizes else (np.zeros(0, np.int64), np.zeros((0, len(domains))))
    own = np.array([sizes.get(d, 0) for d in domains], float)
    ratio = np.log((documents + 1) / (own + 2)) - np.log((documents.sum(axis=1, keepdims=True) - documents + 1) / (own.sum() - own + 2))
    model = DomainModel(domains, kept, np.abs(ratio).max(axis=1, initial=0.0), np.zeros((2 * len(kept), len(domains))), np.zeros(len(domains)))
    place = model.place

    def reduce(batches):
        for batch in batches:
            found, counts = (np.array(batch.column(c).flatten()) for c in ("found", "counts"))
            ends = np.concatenate([[0], np.cumsum(batch.column("found").value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            known = place[found] >= 0
            before = np.concatenate([[0], np.cumsum(known)])[ends].astype(np.int32)
            columns = [pa.ListArray.from_arrays(before, pa.array(x[known].astype(np.int64))) for x in (place[found], counts)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("domain"), *columns, batch.column("words")], batch.schema.names)

    rows = sample.mapInArrow(reduce, f"doc_id {kind}, domain string, found array<long>, counts array<long>, words long").collect()
    rows = sorted(rows, key=lambda r: (str(r["doc_id"]), r["domain"]))  # the same order each time
    return fit_domains(model, [(r["domain"], np.array(r["found"], np.int64), np.array(r["counts"], float), r["words"]) for r in rows])


def posteriors(df: DataFrame, model: DomainModel, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, key, n_tokens, posterior) for each row; key is a hash of id and text, and a null text has the posterior of no words."""
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    doc, text = F.col(id_column), F.col(text_column)

    def score(texts: pa.Array) -> pa.Array:
        found = map(token_buckets, utf8_parts(texts))
        rows = [{"n_tokens": n, "posterior": shared.value.posterior(f, words).tolist()} for f, words, n in found]
        return pa.array(rows, pa.struct([("n_tokens", pa.int64()), ("posterior", pa.list_(pa.float64()))]))

    scored = df.select(doc.alias("doc_id"), F.xxhash64(doc, text).alias("key"), arrow_column("mixing", score, "n_tokens long, posterior array<double>", _release)(text).alias("s"))
    return scored.select("doc_id", "key", "s.n_tokens", "s.posterior")


@dataclass
class MixFit:
    """Targets, what the fitted rates expect, and the vectors of the rounds from which any document's rate follows."""

    domains: list[str]
    targets: np.ndarray
    reached: np.ndarray
    steps: list[tuple[list[float], float]]
    keep: tuple[int, ...] = ()

    def least(self, posterior: np.ndarray) -> np.ndarray:
        """The least rate of each row: 1 where the likeliest domain is one to keep, else 0."""
        return np.isin(posterior.argmax(axis=1), self.keep).astype(float) if len(posterior) else np.zeros(0)

    def rate(self, posterior: Column) -> Column:
        """The rate of a document."""
        steps, k, least = [(np.array(step), momentum) for step, momentum in self.steps], len(self.domains), self.least

        def follow(rows: pa.Array) -> pa.Array:
            p = np.array(rows.flatten(), np.float64).reshape(-1, k)
            rate = ahead = np.ones(len(p))
            floor = least(p)
            for step, momentum in steps:
                last, rate = rate, np.maximum(floor, ahead - p @ step)
                ahead = rate + momentum * (rate - last)
            return pa.array(np.round(rate, 9))

        return arrow_column("mixing", follow, "double", _release)(posterior)


def fit_rates(scored: DataFrame, domains: list[str], weights: dict[str, float], *, budget: float | None = None, keep: list[str] | None = None) -> MixFit:
    """Rates for a table with n_tokens and posterior.

    The targets are weights (scaled to sum to 1) times budget: by default all tokens, with keep a total in which none of
    those domains has to shrink and, where PURE holds, no document of them either. Documents whose likeliest domain is in keep get a rate of 1 at least. Unreachable targets are met as
    nearly as the rates allow.
    """
    k = len(domains)
    whole = tuple(i for i, d in enumerate(domains) if keep and d in keep)
    share = np.array([float(weights.get(d, 0.0)) for d in domains])
    if (share < 0).any() or not share.sum():
        raise ValueError("weights must be nonnegative, one of them positive")
    share = share / share.sum()
    p = [F.col("posterior")[i] for i in range(k)]
    tokens = F.col("n_tokens").cast("double")
    highest = F.array_max("posterior")
    floor = F.when(F.array_position("posterior", highest).isin([i + 1 for i in whole]), 1.0).otherwise(0.0) if whole else F.lit(0.0)
    sums = scored.agg(*[F.sum(tokens * p[i] * floor).alias(f"f{i}") for i in range(k)], *[F.sum(tokens * p[i]).alias(f"s{i}") for i in range(k)], *[F.sum(tokens * p[i] * p[j]).alias(f"m{i}_{j}") for i in range(k) for j in range(k)]).first()
    now = np.array([sums[f"s{i}"] or 0.0 for i in range(k)])
    total = now.sum()
    if not total:
        return MixFit(domains, np.zeros(k), now, [], whole)
    if budget is None:
        kept = [i for i, d in enumerate(domains) if keep and d in keep and share[i]]
        budget = max((now[i] / share[i] for i in kept), default=total)
        # What documents with a least rate hold of the other domains may be thinned by more copies of those that hold PURE of it.
        least = np.array([sums[f"f{i}"] or 0.0 for i in range(k)])
        budget = max([budget, *((least[i] - PURE * share[i] * least.sum()) / ((1 - PURE) * share[i]) for i in range(k) if share[i] and i not in whole)])
    targets = share * budget
    m = np.array([[sums[f"m{i}_{j}"] for j in range(k)] for i in range(k)])
    inverse = np.linalg.inv(m + np.eye(k) * 1e-9 * np.trace(m))
    root = np.linalg.cholesky(inverse)
    loss_of = lambda s: float((s - targets) @ inverse @ (s - targets))
    fit = MixFit(domains, targets, now, [], whole)
    ahead, age, active, longest, losses = now, 1.0, m, np.inf, [loss_of(now)]
    for _ in range(ROUNDS_KEEP if whole else ROUNDS):
        if np.abs(fit.reached - targets).sum() <= TOLERANCE * budget:
            break
        # Only documents with a rate answer to a step, so its length may be the inverse Lipschitz constant of those.
        length = max(1.0, min(longest, 1 / max(1e-12, np.linalg.eigvalsh(root.T @ active @ root)[-1])))
        grown = (1 + np.sqrt(1 + 4 * age * age)) / 2
        momentum = float((age - 1) / grown)
        tried = MixFit(domains, targets, now, [*fit.steps, ((length * inverse @ (ahead - targets)).tolist(), momentum)], whole)
        rates = scored.select(tried.rate(F.col("posterior")).alias("r"), tokens.alias("t"), "posterior", floor.alias("floor"))
        mass = F.when(F.col("r") > F.col("floor"), F.col("t")).otherwise(0.0)
        row = rates.agg(*[F.sum(F.col("r") * F.col("t") * p[i]).alias(f"s{i}") for i in range(k)], *[F.sum(mass * p[i] * p[j]).alias(f"m{i}_{j}") for i in range(k) for j in range(k)]).first()
        reached = np.array([row[f"s{i}"] for i in range(k)])
        loss = loss_of(reached)
        if loss > losses[-1]:  # too far: the last rates stay, the momentum starts anew
            if age == 1 and length <= 1:
                break
            ahead, age, longest = fit.reached, 1.0, max(1.0, length / 2)
            fit.steps = [*fit.steps[:-1], (fit.steps[-1][0], 0.0)] if fit.steps else []
            continue
        fit.steps, ahead, fit.reached = tried.steps, reached + momentum * (reached - fit.reached), reached
        age, longest, active = grown, longest * 1.2, np.array([[row[f"m{i}_{j}"] for j in range(k)] for i in range(k)])
        losses.append(loss)
        if len(losses) > SETTLED and losses[-1 - SETTLED] - loss <= SETTLED_SHARE * loss:
            break
    return fit


def copies(rate: Column, key: Column) -> Column:
    """How often a document is taken: the rate, rounded up or down by a hash of its key so that the expectation holds."""
    unit = (F.pmod(F.xxhash64(key, F.lit("copies")), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    return F.floor(rate + unit).cast("int")


def mix(df: DataFrame, model: DomainModel, weights: dict[str, float], *, id_column: str = "doc_id", text_column: str = "text", budget: float | None = None, keep: list[str] | None = None) -> tuple[DataFrame, MixFit]:
    """A row for each input row (doc_id, key, n_tokens, a p_<domain> column for each domain, rate, copies), and the fit.

    Null and empty texts have no tokens; their rate is that of the prior. Repeated rows get the same rate. Null ids are
    passed on. Other columns are ignored; an empty table gives an empty one.
    """
    scored = cut_columnar(posteriors(df, model, id_column=id_column, text_column=text_column))
    fit = fit_rates(scored, model.domains, weights, budget=budget, keep=keep)
    rated = scored.withColumn("rate", fit.rate(F.col("posterior")))
    parts = [F.col("posterior")[i].alias(f"p_{d}") for i, d in enumerate(model.domains)]
    return rated.select("doc_id", "key", "n_tokens", *parts, "rate", copies(F.col("rate"), F.col("key")).alias("copies")), fit


def take(df: DataFrame, mixed: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of df, each as often as its copies say. Rows are found by id and a hash of id and text."""
    key, n, own, other = fresh(df, "key", "copies", "own", "other")
    doc, text = df[f"`{id_column}`"], df[f"`{text_column}`"]
    wanted = mixed.select(F.col("doc_id").alias(other), F.col("key").alias(own), F.col("copies").alias(n)).where(F.col(n) > 0).dropDuplicates([other, own])
    rows = df.withColumn(key, F.xxhash64(doc, text))
    rows = rows.join(wanted, (rows[key] == wanted[own]) & doc.eqNullSafe(wanted[other]))
    (i,) = fresh(rows, "i")
    return rows.withColumn(i, F.explode(F.sequence(F.lit(1), F.col(n)))).drop(key, n, own, other, i)


