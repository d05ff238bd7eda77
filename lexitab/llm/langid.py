"""Language identification with interpolated Kneser-Ney character language models.

One model per language over letters and word boundaries; a context never reaches back past the last boundary, so a
document's score doesn't depend on its neighbours in a batch. Every n-gram of an order is a 64-bit hash in one sorted
array shared by all languages, with a column of probabilities per language; unseen n-grams back off. The language with
the lowest cross-entropy per symbol wins. Documents worse than the calibrated limit of every language are rejected.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexitab.llm._support import cut_columnar, hold, ship

ORDER = 4
DISCOUNT = 0.75
#: Labelled documents that the models may learn from; beyond it a hash picks about as many of each language.
TRAIN_LIMIT = 12_000
#: No limit lies below this share of the cross-entropy of letters drawn evenly: names, codes and numbers alone don't reject.
FLOOR = 0.9
#: Symbols: 0 a boundary, 1 a letter outside the alphabet, then the alphabet.
ALPHABET_LIMIT = 4094
UNDETERMINED = "und"
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Code points scored at a time, so that the arrays stay in a core's cache.
_SLICE = 200_000


def hashed(codes: np.ndarray) -> np.ndarray:
    """64-bit hashes of n-gram codes (one to one, as the multiplier is odd)."""
    with np.errstate(over="ignore"):
        out = codes * _MIX
        return out ^ (out >> np.uint64(29))


def letter_table() -> np.ndarray:
    """For each code point, its lower-cased letter; 0 for what isn't a letter."""
    table = np.zeros(0x110000, np.uint32)
    for point in range(0x110000):
        char = chr(point)
        if char.isalpha():
            low = char.lower()
            table[point] = ord(low) if len(low) == 1 else point
    return table


_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    if not _letters:
        _letters.append(letter_table())
    return _letters[0]


def symbol_runs(texts: list[str | None], table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, by default lower-cased letters, and each text's first place (one more at the end).

    One 0 stands for each stretch without letters that follows a letter, the text's end included, so words of
    different texts never touch; boundaries before a text's first letter say nothing and are left out.
    """
    table = letters() if table is None else table
    joined = "\x00".join(text or "" for text in texts) + "\x00"
    found = table[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    lengths = np.fromiter((len(text or "") + 1 for text in texts), np.int64, len(texts))
    ends = np.cumsum(lengths)
    letter = found != 0
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    kept_before = np.concatenate([[0], np.cumsum(keep)])
    return found[keep], np.concatenate([[0], kept_before[ends]])


def contexts(symbols: np.ndarray) -> list[np.ndarray]:
    """Codes of the n-grams of orders 1 to ORDER that end at each place, over symbol ids below 4096."""
    now = symbols.astype(np.uint64)
    codes = [now]
    back = now
    for step in range(1, ORDER):
        back = np.concatenate([np.zeros(1, np.uint64), back[:-1]])
        if step > 1:  # what stands before a boundary is forgotten
            back = np.where(previous == 0, np.uint64(0), back)
        previous = back
        codes.append(codes[-1] + (back << np.uint64(12 * step)))
    return codes


@dataclass
class Grams:
    """One order's n-grams in a sorted hash array."""

    hashes: np.ndarray
    values: np.ndarray  # one row each, a column per language

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the codes and whether they are there."""
        if not len(self.hashes):
            return np.zeros(len(codes), np.int64), np.zeros(len(codes), bool)
        wanted = hashed(codes)
        at = np.searchsorted(self.hashes, wanted)
        at[at == len(self.hashes)] = 0
        return at, self.hashes[at] == wanted


def grams(codes: np.ndarray, values: np.ndarray) -> Grams:
    keys = hashed(codes)
    order = np.argsort(keys)
    return Grams(keys[order], values[order])


@dataclass
class LanguageModels:
    """Kneser-Ney models of all languages, their rejection limits and the temperature of the score."""

    languages: list[str]
    alphabet: np.ndarray
    probability: list[Grams] = field(default_factory=list)  # log probabilities of seen n-grams by order
    backoff: list[Grams] = field(default_factory=list)  # log weights of seen contexts, by the order of the n-gram
    unseen: np.ndarray | None = None
    limits: np.ndarray | None = None
    temperature: float = 10.0

    def ids(self, found: np.ndarray) -> np.ndarray:
        """Symbol ids of lower-cased letters (0 for boundaries)."""
        at = np.searchsorted(self.alphabet, found)
        at[at == len(self.alphabet)] = 0
        known = self.alphabet[at] == found if len(self.alphabet) else np.zeros(len(found), bool)
        return np.where(found == 0, 0, np.where(known, at + 2, 1)).astype(np.uint16)

    @cached_property
    def id_of(self) -> np.ndarray:
        """Symbol ids by code point."""
        return self.ids(letters())

    def log_probabilities(self, codes: list[np.ndarray], order: int = ORDER) -> np.ndarray:
        """A row for each place, a column for each language."""
        table = self.probability[order - 1]
        at, seen = table.find(codes[order - 1])
        out = table.values[at] if len(table.values) else np.zeros((len(at), len(self.languages)), np.float32)
        rest = np.flatnonzero(~seen)
        if len(rest):
            if order == 1:
                out[rest] = self.unseen
            else:
                lower = self.log_probabilities([c[rest] for c in codes[: order - 1]], order - 1)
                weights = self.backoff[order - 1]
                at, seen = weights.find(codes[order - 1][rest] >> np.uint64(12))
                if len(weights.values):
                    lower[seen] += weights.values[at[seen]]
                out[rest] = lower
        return out

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per symbol of each text under each language, and the number of letters."""
        totals = np.zeros((len(texts), len(self.languages)))
        symbols, counts = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        low = size = 0
        for high, text in enumerate(texts):
            size += len(text or "")
            if size >= _SLICE or high == len(texts) - 1:
                self._add(texts[low : high + 1], totals[low : high + 1], symbols[low : high + 1], counts[low : high + 1])
                low, size = high + 1, 0
        return -totals / np.maximum(symbols, 1)[:, None], counts

    def _add(self, texts, totals, symbols, counts) -> None:
        """Log probabilities, symbols and letters of each text, into the rows given."""
        found, starts = symbol_runs(texts, self.id_of)
        codes = contexts(found)
        some = np.flatnonzero(starts[1:] > starts[:-1])
        if not len(some):
            return
        symbols[:] = starts[1:] - starts[:-1]
        counts[some] = np.add.reduceat((found != 0).astype(np.int64), starts[some])
        for low in range(0, len(found), _SLICE):  # one very long text is cut here, with its contexts
            logs = self.log_probabilities([c[low : low + _SLICE] for c in codes])
            inside = np.clip(starts, low, low + len(logs)) - low
            here = np.flatnonzero(inside[1:] > inside[:-1])
            totals[here] += np.add.reduceat(logs, inside[here], axis=0, dtype=np.float64)

    def judge(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, cross-entropy and rejection of each text."""
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.full(len(texts), np.nan), np.ones(len(texts), bool)
        entropy, counts = self.entropies(texts)
        best = entropy.argmin(axis=1)
        lowest = entropy[np.arange(len(texts)), best]
        score = 1 / np.exp((lowest[:, None] - entropy) * self.temperature).sum(axis=1)
        rejected = (lowest > self.limits[best]) | (counts == 0)
        empty = counts == 0
        predicted = [UNDETERMINED if none else self.languages[i] for none, i in zip(empty, best)]
        return predicted, np.where(empty, 0.0, score), np.where(empty, np.nan, lowest), rejected


def _counts(texts: list[str | None], alphabet_of) -> tuple[np.ndarray, np.ndarray]:
    codes = contexts(alphabet_of(symbol_runs(texts)[0]))[-1]
    return np.unique(codes, return_counts=True)


def fit(counted: dict[str, tuple[np.ndarray, np.ndarray]], alphabet: np.ndarray) -> LanguageModels:
    """Models from each language's codes of the highest order and their counts."""
    languages = sorted(counted)
    model = LanguageModels(languages, alphabet)
    size = len(alphabet) + 2
    model.unseen = np.full(len(languages), -np.log(size), np.float32)
    tables: list[list[tuple[np.ndarray, np.ndarray]]] = []
    for language in languages:
        codes, counts = counted[language]
        orders = [(codes, counts)]
        for order in range(ORDER - 1, 0, -1):  # continuation counts: distinct symbols before
            mask = np.uint64((1 << (12 * order)) - 1)
            orders.insert(0, np.unique(orders[0][0] & mask, return_counts=True))
        tables.append(orders)
    for order in range(1, ORDER + 1):
        union = np.unique(np.concatenate([t[order - 1][0] for t in tables]))
        values = np.empty((len(union), len(languages)), np.float64)
        heads = np.unique(union >> np.uint64(12))
        weights = np.zeros((len(heads), len(languages)), np.float64)
        lower = np.tile(model.unseen, (len(union), 1)).astype(np.float64)
        if order > 1:
            down = [np.zeros(0, np.uint64)] * (order - 1)
            down = [union & np.uint64((1 << (12 * n)) - 1) for n in range(1, order)]
            lower = model.log_probabilities(down, order - 1).astype(np.float64)
        head_of = np.searchsorted(heads, union >> np.uint64(12))
        for column, orders in enumerate(tables):
            codes, counts = orders[order - 1]
            own = np.zeros(len(union))
            own[np.searchsorted(union, codes)] = counts
            total = np.bincount(head_of, own, len(heads))
            kinds = np.bincount(head_of, own > 0, len(heads))
            with np.errstate(divide="ignore", invalid="ignore"):
                weight = np.where(total > 0, DISCOUNT * kinds / total, 1.0)
                kept = np.where(total[head_of] > 0, np.maximum(own - DISCOUNT, 0) / total[head_of], 0.0)
            weights[:, column] = np.log(weight)
            values[:, column] = np.log(kept + weight[head_of] * np.exp(lower[:, column]))
        model.probability.append(grams(union, values.astype(np.float32)))
        model.backoff.append(grams(heads, weights.astype(np.float32)))
        if order == 1:  # what no language has seen gets the discounted mass of the uniform distribution
            model.unseen = (model.unseen + weights[0]).astype(np.float32)
    return model


def train(
    df: DataFrame,
    *,
    text_column: str = "text",
    label_column: str = "lang",
    key_column: str = "doc_id",
    train_limit: int = TRAIN_LIMIT,
    rejection_quantile: float = 0.999,
    rejection_margin: float = 1.5,
) -> LanguageModels:
    """Models from labelled rows: null labels and texts are ignored; no labelled row gives models that reject all.

    Rows beyond about train_limit are left out by a hash of their key and text, each language by its own rate, so rare languages
    keep all rows; rows equal in all three count once. A fifth of the picked rows, again by hash, isn't counted but calibrates: a
    language's limit is the rejection_quantile of its cross-entropies times rejection_margin (FLOOR at least), and the score's
    temperature has the lowest log loss. N-grams are counted on the executors; the driver gets the counts of the bounded sample.
    """
    spark = df.sparkSession
    ship(spark)
    rows = df.select(F.col(label_column).cast("string").alias("lang"), F.col(text_column).alias("text"), F.col(key_column).alias("key"))
    rows = rows.where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return LanguageModels([], np.zeros(0, np.uint32))
    each = max(1, train_limit // len(sizes))
    slots = 1 << 20
    slot = F.pmod(F.xxhash64("key", "text", F.lit("train")), F.lit(slots))
    limit = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(slots, -(-each * slots // n)))])
    # Copies of one row share a slot, so they are counted once here: the sample's bound holds whatever repeats.
    picked = rows.where(slot < limit[F.col("lang")]).groupBy("lang", "key", F.xxhash64("key", "text").alias("row")).agg(F.first("text").alias("text"))
    picked = cut_columnar(picked.select("lang", "text", (F.pmod(F.xxhash64("row", F.lit("calibrate")), F.lit(5)) == 0).alias("calibrates")))

    def alphabets(batches):
        hold("langid", _letters.clear)
        seen: dict[int, int] = {}
        for batch in batches:
            points, counts = np.unique(symbol_runs(batch.column("text").to_pylist())[0], return_counts=True)
            for point, count in zip(points.tolist(), counts.tolist()):
                seen[point] = seen.get(point, 0) + count
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.int64()), pa.array(seen.values(), pa.int64())], ["point", "n"])

    points = picked.select("text").mapInArrow(alphabets, "point long, n long").where("point <> 0").groupBy("point").agg(F.sum("n").alias("n"))
    alphabet = np.array(sorted(r["point"] for r in points.orderBy(F.desc("n"), "point").limit(ALPHABET_LIMIT).collect()), np.uint32)
    encode = LanguageModels([], alphabet).ids

    def count(batches):
        hold("langid", _letters.clear)
        for batch in batches:
            by: dict[str, list[str]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                codes, counts = _counts(texts, encode)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.view(np.int64)), pa.array(counts, pa.int64())], ["lang", "code", "n"])

    counted = picked.where("not calibrates").select("lang", "text").mapInArrow(count, "lang string, code long, n long")
    summed = counted.groupBy("lang", "code").agg(F.sum("n").alias("n")).toPandas()
    by_language = {}
    for lang, part in summed.groupby("lang"):
        part = part.sort_values("code")
        codes = part["code"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(codes)
        by_language[lang] = (codes[order], part["n"].to_numpy(np.int64)[order])
    if not by_language:  # all picked rows calibrate, or hold no letter
        return LanguageModels([], alphabet)
    model = fit(by_language, alphabet)
    shared = spark.sparkContext.broadcast(model)

    def measure(batches):
        hold("langid", _letters.clear)
        for batch in batches:
            entropy, counts = shared.value.entropies(batch.column("text").to_pylist())
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([batch.column("lang").take(pa.array(some)), pa.array(entropy[some].tolist(), pa.list_(pa.float64()))], ["lang", "entropy"])

    measured = picked.where("calibrates").select("lang", "text").mapInArrow(measure, "lang string, entropy array<double>").collect()
    calibrate(model, [r["lang"] for r in measured], np.array([r["entropy"] for r in measured]), rejection_quantile, rejection_margin)
    return model


def calibrate(model: LanguageModels, labels: list[str], entropy: np.ndarray, quantile: float, margin: float) -> None:
    """Sets the limits and the temperature; a language without calibrating rows gets the limit of all."""
    n = len(model.languages)
    column = {lang: i for i, lang in enumerate(model.languages)}
    own = np.array([column.get(lang, -1) for lang in labels], int)
    usable = own >= 0
    if not usable.any():
        model.limits = np.full(n, np.log(len(model.alphabet) + 2.0))
        return
    entropy, own = entropy[usable], own[usable]
    mine = entropy[np.arange(len(own)), own]
    floor = FLOOR * np.log(len(model.alphabet) + 2.0)
    model.limits = np.array([max(floor, np.quantile(mine[own == i] if (own == i).any() else mine, quantile) * margin) for i in range(n)])
    losses = {}
    for temperature in (1.0, 2.0, 5.0, 10.0, 20.0, 50.0, 100.0):
        logits = -entropy * temperature
        logits -= logits.max(axis=1, keepdims=True)
        losses[temperature] = -(logits[np.arange(len(own)), own] - np.log(np.exp(logits).sum(axis=1))).mean()
    model.temperature = min(losses, key=losses.get)


def identify(df: DataFrame, model: LanguageModels, *, text_column: str = "text", prefix: str = "") -> DataFrame:
    """Every input row with lang_pred, score, entropy and rejected (each name after prefix).

    Null texts and texts without a letter are `und` with score 0, a null entropy, and rejected. Whole texts are read.
    Input columns stay; one with the name of a new column is replaced. An empty table gives an empty one. No shuffle.
    """
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    names = [f"{prefix}{n}" for n in ("lang_pred", "score", "entropy", "rejected")]
    new = {n.lower() for n in names}
    kept = df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in new or c == text_column])
    position = kept.columns.index(text_column)
    drop_text = text_column.lower() in new
    fields = [f for i, f in enumerate(kept.schema.fields) if not (drop_text and i == position)]
    from pyspark.sql import types as T

    schema = T.StructType(fields)
    for name, kind in zip(names, (T.StringType(), T.DoubleType(), T.DoubleType(), T.BooleanType())):
        schema = schema.add(name, kind)

    def run(batches):
        hold("langid", _letters.clear)
        for batch in batches:
            predicted, score, entropy, rejected = shared.value.judge(batch.column(position).to_pylist())
            columns = [c for i, c in enumerate(batch.columns) if not (drop_text and i == position)]
            columns += [pa.array(predicted, pa.string()), pa.array(score), pa.array(entropy, mask=np.isnan(entropy)), pa.array(rejected)]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in schema.fields])

    return kept.mapInArrow(run, schema)
