"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, everything but letters becomes a space, and n-grams of one to
three characters are hashed into buckets. Document frequencies come from every row
that may be learned from; weights come from a bounded sample of those rows, by
follow-the-regularised-leader with L1 and L2 penalties. A part of the sample that the
weights have not seen settles the rest: the sparsest penalties within one standard
error of the best loss, and the temperature that calibrates the scores.

Whether a text is of a learned language at all is told by the surprise of its n-grams:
how far it exceeds what unseen texts of the closest label come to, given its length. The limit stands between what unseen texts come to under
their own label and under the best of the others, as if theirs had not been learned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import small_batches


@dataclass(frozen=True)
class Settings:
    """What bounds the fit: so many rows of each label in expectation, of all labels together, and so many labels (more raise)."""

    buckets_log2: int = 14
    longest: int = 3
    sample_per_label: int = 800
    sample: int = 40_000
    most_labels: int = 500
    epochs: int = 2
    alpha: float = 0.5
    beta: float = 1.0
    #: (L1, L2) to choose from.
    penalties: tuple[tuple[float, float], ...] = ((0.1, 0.01), (0.5, 0.01), (0.5, 1.0), (2.0, 0.01))
    seed: int = 7


@dataclass
class Model:
    """surprise: minus the log share of each bucket in a label's n-grams, by label; centre: a label's usual mean of it; noise: its variance by n-gram and by text; limit: deviations that are too many."""

    labels: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    surprise: np.ndarray = field(default_factory=lambda: np.zeros((0, 1)))
    centre: np.ndarray = field(default_factory=lambda: np.zeros(0))
    #: The mean inverse document frequency of a text's n-grams that OWN of unseen learned texts stay below.
    usual: float = 1.0
    noise: tuple[float, float] = (1.0, 1.0)
    limit: float = 1.0
    penalty: tuple[float, float] = (0.0, 0.0)
    calibration_error: float = 0.0
    settings: Settings = field(default_factory=Settings)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


#: Characters of a text that are turned into n-grams at once; pieces overlap so that none is lost.
PIECE = 1 << 20


def features(text: str, settings: Settings) -> tuple[np.ndarray, bool]:
    """(counts of the hashed n-grams of the whole text, whether it has a letter)."""
    size, shift = 1 << settings.buckets_log2, np.uint64(64 - settings.buckets_log2)
    total, any_letter, carry = np.zeros(size, dtype=np.int64), False, np.array([32], dtype=np.uint32)
    for at in range(0, len(text), PIECE):
        codes = np.frombuffer(text[at : at + PIECE].lower().encode("utf-32-le", "surrogatepass"), "<u4")
        letter = _letters()[codes]
        any_letter = any_letter or bool(letter.any())
        codes = np.where(letter, codes, 32)
        last = carry[-1:]
        codes = codes[letter | np.concatenate((last != 32, letter[:-1]))]
        run = np.concatenate((carry, codes))
        if at + PIECE >= len(text) and run[-1] != 32:
            run = np.append(run, np.uint32(32))
        gram = np.zeros(len(run), dtype=np.uint64)
        for n in range(settings.longest):
            if len(run) <= n:
                break
            gram = gram[: len(run) - n] * np.uint64(0x100000001B3) + run[n:].astype(np.uint64) + np.uint64(1)
            fresh = gram[max(0, len(carry) - n) if at else 0 :]  # those that end in this piece
            total += np.bincount(((fresh * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64), minlength=size)
        carry = run[-max(1, settings.longest - 1) :] if len(run) else carry
    return total, any_letter


def _weighted(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices and TF-IDF values (logarithmic counts, unit length) of the n-grams that occur."""
    at = np.flatnonzero(counts)
    value = np.log1p(counts[at]) * idf[at]
    norm = np.sqrt(value @ value)
    return at, value / norm if norm > 0 else value


def document_frequencies(texts: DataFrame, settings: Settings) -> tuple[np.ndarray, int]:
    """(rows that hold each bucket's n-grams, rows with a text): counted in each task, summed by bucket."""
    size = 1 << settings.buckets_log2

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size + 1, dtype=np.int64)
        for pdf in batches:
            for text in pdf["text"]:
                total[:size] += features(text.decode(errors="replace"), settings)[0] > 0
            total[size] += len(pdf)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at, "n": total[at]})

    found = texts.select(F.col("text").cast("binary")).mapInPandas(count, "bucket long, n long")
    out = np.zeros(size + 1)
    for row in found.groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        out[row.bucket] = row.n
    return out[:size], int(out[size])


def follow_the_leader(rows: list[tuple[np.ndarray, np.ndarray, int]], n_labels: int, settings: Settings, penalty: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases by FTRL-proximal, per coordinate, over shuffled epochs; penalty is (L1, L2). Biases bear no L1."""
    size, s, (l1, l2) = 1 << settings.buckets_log2, settings, penalty
    z, n = np.zeros((size + 1, n_labels)), np.zeros((size + 1, n_labels))
    bound = np.full((size + 1, 1), l1)
    bound[size] = 0.0

    def weights(z: np.ndarray, n: np.ndarray, bound: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= bound, 0.0, -(z - np.sign(z) * bound) / ((s.beta + np.sqrt(n)) / s.alpha + l2))

    order = np.random.default_rng(s.seed)
    for _ in range(s.epochs):
        for k in order.permutation(len(rows)):
            at, value, label = rows[k]
            at, value = np.append(at, size), np.append(value, 1.0)
            w = weights(z[at], n[at], bound[at])
            gap = softmax(value @ w)
            gap[label] -= 1.0
            g = np.outer(value, gap)
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / s.alpha * w
            n[at] += g * g
    w = weights(z, n, bound)
    return w[:size], w[size]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def losses(logits: np.ndarray, labels: np.ndarray, temperature: float) -> np.ndarray:
    """Cross-entropy of each row against its label, smoothed as if every label had been seen once more.

    Without smoothing, rows that are all told right would drive the temperature to zero.
    """
    n, k = logits.shape
    soft = np.full((n, k), 1 / (n + k))
    soft[np.arange(n), labels] += n / (n + k)
    x = logits / temperature
    x = x - x.max(1, keepdims=True)
    return -(soft * (x - np.log(np.exp(x).sum(1, keepdims=True)))).sum(1)


def temperature_of(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits with the least smoothed loss, which is convex in its inverse: by golden section."""
    low, high, ratio = np.log(1e-4), np.log(1e4), (np.sqrt(5) - 1) / 2
    cost = lambda x: losses(logits, labels, float(np.exp(-x))).mean()
    while high - low > 1e-4:
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if cost(a) <= cost(b) else (a, high)
    return float(np.exp(-(low + high) / 2))


def calibration_error(scores: np.ndarray, right: np.ndarray, bins: int = 10) -> float:
    """Mean gap between score and share told right, over bins of equally many rows."""
    order = np.argsort(scores, kind="stable")
    parts = [p for p in np.array_split(order, bins) if len(p)]
    return float(sum(len(p) * abs(scores[p].mean() - right[p].mean()) for p in parts) / max(1, len(scores)))


#: n-grams added to a label's in equal shares; n-grams that say the same as one, as they overlap; the least variance between texts; quantiles of own and of foreign texts; the least limit; what rarity counts.
PRIOR, OVERLAP, LEAST_NOISE, OWN, FOREIGN, LEAST_LIMIT, NOVEL = 2000.0, 1.0, 0.005, 0.995, 0.1, 8.0, 0.74


def deviation(at: np.ndarray, counts: np.ndarray, model: Model) -> float:
    """By how many standard deviations a text's mean surprise exceeds what is usual, under the label where it does least; short texts vary more. 0 without n-grams."""
    n = counts.sum()
    return float((model.surprise[:, at] @ counts / n - model.centre).min() / np.sqrt(OVERLAP * model.noise[0] / n + model.noise[1])) if n else 0.0


def rarity(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> float:
    """Mean inverse document frequency of the text's n-grams, each as often as it occurs."""
    return float(counts @ (idf[at] - 1) / counts.sum()) if len(at) else 0.0


def strangeness(at: np.ndarray, counts: np.ndarray, model: Model) -> float:
    """deviation as a multiple of the limit or, if more, NOVEL of rarity as a multiple of the usual: that tells of the shortest texts too."""
    return max(deviation(at, counts, model) / model.limit, NOVEL * rarity(at, counts, model.idf) / model.usual)


def learn_surprise(model: Model, seen: list[tuple[np.ndarray, np.ndarray, int]], unseen: list[tuple[np.ndarray, np.ndarray, int]]) -> None:
    """Sets the model's surprise, centre, noise and limit; rows are (buckets, counts, label).

    The limit is the geometric mean of what almost all unseen texts stay below under
    their own label, and what most exceed under the closest other label.
    """
    k, size = len(model.labels), len(model.idf)
    totals = np.zeros((k, size))
    for at, counts, label in seen:
        totals[label, at] += counts
    model.surprise = -np.log((totals + PRIOR / size) / (totals.sum(1, keepdims=True) + PRIOR))
    some = [(at, c, y) for at, c, y in unseen if c.sum()]
    model.usual = max(1e-9, float(np.quantile([rarity(at, c, model.idf) for at, c, _ in unseen], OWN)))
    if not some:
        model.centre = np.zeros(k)
        model.limit = np.inf
        return
    means = np.array([model.surprise[:, at] @ c / c.sum() for at, c, _ in some])
    own, sizes = np.array([y for *_, y in some]), np.array([c.sum() for _, c, _ in some])
    mine = means[np.arange(len(own)), own]
    model.centre = np.array([np.median(mine[own == j]) if (own == j).any() else np.median(mine) for j in range(k)])
    within = np.array([c @ (model.surprise[y, at] - m) ** 2 / c.sum() for (at, c, y), m in zip(some, mine, strict=True)])
    between = np.median((mine - model.centre[own]) ** 2) / 0.455  # of a square normal deviate the median is 0.455
    model.noise = (float(np.median(within)), float(max(LEAST_NOISE, between - OVERLAP * np.median(within) / np.median(sizes))))
    scale = np.sqrt(OVERLAP * model.noise[0] / sizes + model.noise[1])
    off = (means - model.centre) / scale[:, None]
    usual = max(1.0, float(np.quantile(off[np.arange(len(own)), own], OWN)))
    off[np.arange(len(own)), own] = np.inf
    foreign = float(np.quantile(off.min(1), FOREIGN)) if k > 1 else 4 * usual
    model.limit = max(LEAST_LIMIT, float(np.sqrt(usual * max(foreign, usual))))


def fit(docs: DataFrame, seen: list, unseen: list, n_labels: int, settings: Settings) -> tuple[np.ndarray, np.ndarray, float, tuple[float, float]]:
    """(weights, bias, temperature, penalty): a task fits each penalty; of those within a standard error of the best loss the one with fewest weights is taken."""
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast((seen, unseen))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in pdf["id"]:
                seen, unseen = known.value
                w, b = follow_the_leader(seen, n_labels, settings, settings.penalties[k])
                labels = np.array([y for *_, y in unseen])
                logits = np.array([v @ w[a] + b for a, v, _ in unseen])
                t = temperature_of(logits, labels)
                loss = losses(logits, labels, t)
                yield pd.DataFrame([(k, loss.mean(), loss.std() / np.sqrt(len(loss)), np.count_nonzero(w), t, w.tobytes(), b.tobytes())], columns=["k", "loss", "error", "weights", "temperature", "w", "b"])

    n = len(settings.penalties)
    told = spark.range(0, n, 1, n).mapInPandas(run, "k long, loss double, error double, weights long, temperature double, w binary, b binary").toPandas()
    known.unpersist()
    best = told.loc[told["loss"].idxmin()]
    near = told[told["loss"] <= best["loss"] + best["error"]].sort_values(["weights", "k"])
    one = near.iloc[0]
    return np.frombuffer(one["w"]).reshape(-1, n_labels), np.frombuffer(one["b"]), float(one["temperature"]), settings.penalties[int(one["k"])]


def train(docs: DataFrame, text_col: str = "text", label_col: str = "lang", learn: Column | None = None, order_col: str = "doc_id", settings: Settings = Settings()) -> Model:
    """A model of the rows that `learn` allows and that have a text and a label.

    Which rows are sampled depends on a hash of order_col alone. Only the sample's
    features, settings.sample_per_label rows a label, come to the driver. Without rows
    the model has no labels.
    """
    usable = docs.where(F.col(text_col).isNotNull() & F.col(label_col).isNotNull())
    usable = usable.where(learn) if learn is not None else usable
    usable = usable.select(F.col(text_col).alias("text"), F.col(label_col).alias("label"), F.col(order_col).alias("key"))
    sizes = {r.label: r.n for r in usable.groupBy("label").agg(F.count("*").alias("n")).limit(settings.most_labels + 1).collect()}
    if len(sizes) > settings.most_labels:
        raise ValueError(f"more than {settings.most_labels} labels: raise Settings.most_labels")
    if not sizes:
        return Model([], np.zeros(1), np.zeros((1, 0)), np.zeros(0), settings=settings)
    labels = sorted(sizes)
    df, n = document_frequencies(usable, settings)
    idf = np.log((1 + n) / (1 + df)) + 1
    place = F.pmod(F.xxhash64(F.col("key"), F.lit(settings.seed)), F.lit(1 << 30)) / float(1 << 30)
    fraction = F.create_map(*[F.lit(x) for k in labels for x in (k, min(1.0, min(settings.sample_per_label, settings.sample / len(labels)) / sizes[k]))])[F.col("label")]

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            counts = [features(t.decode(errors="replace"), settings)[0] for t in pdf["text"]]
            told = [_weighted(c, idf) for c in counts]
            yield pd.DataFrame({"key": pdf["key"], "label": pdf["label"], "at": [a.astype("<i4").tobytes() for a, _ in told], "value": [v.tobytes() for _, v in told], "count": [c[a].astype("<i8").tobytes() for c, (a, _) in zip(counts, told, strict=True)]})

    sample = usable.where(place < fraction).select(F.xxhash64("key", "text").alias("key"), "label", F.col("text").cast("binary"))
    got = sample.mapInPandas(vectors, "key long, label string, at binary, value binary, count binary").toPandas()
    got = got.sort_values(["key", "label"], ignore_index=True)
    rows = [(np.frombuffer(a, "<i4"), np.frombuffer(v), labels.index(y)) for a, v, y in zip(got["at"], got["value"], got["label"], strict=True)]
    unseen, seen = rows[::5], [r for k, r in enumerate(rows) if k % 5]
    if not unseen:
        return Model([], np.zeros(1), np.zeros((1, 0)), np.zeros(0), settings=settings)
    weights, bias, temperature, penalty = fit(docs, seen or rows, unseen, len(labels), settings)
    p = softmax(np.array([v @ weights[a] + bias for a, v, _ in unseen]) / temperature)
    error = calibration_error(p.max(1), p.argmax(1) == np.array([y for *_, y in unseen]))
    model = Model(labels, idf, weights, bias, temperature, penalty=penalty, calibration_error=error, settings=settings)
    counts = [(np.frombuffer(a, "<i4"), np.frombuffer(c, "<i8"), labels.index(y)) for a, c, y in zip(got["at"], got["count"], got["label"], strict=True)]
    learn_surprise(model, [r for k, r in enumerate(counts) if k % 5] or counts, counts[::5])
    return model


def predict(text: Column, model: Model) -> Column:
    """struct(lang, score, strange) for whole texts: `und` and 0 for null texts, texts without letters, and without labels.

    strange is the surprise of the text's n-grams under the closest label, in deviations
    from what is usual there, as a multiple of the limit: below 1 for the languages learned,
    above for other ones and for what is no language. A few words come to that only if
    their n-grams are rare in all of them.
    """
    told = docs_model(model)

    @F.pandas_udf("lang string, score double, strange double")
    def judge(texts: pd.Series) -> pd.DataFrame:
        m, rows = told, []
        for text in texts:
            counts, some = features(text.decode(errors="replace"), m.settings) if text is not None and m.labels else (None, False)
            if not some:
                rows.append(("und", 0.0, None))
                continue
            at, value = _weighted(counts, m.idf)
            p = softmax((value @ m.weights[at] + m.bias) / m.temperature)
            best = int(np.argmax(p))
            rows.append((m.labels[best], float(p[best]), strangeness(at, counts[at], m)))
        return pd.DataFrame(rows, columns=["lang", "score", "strange"])

    return judge(text.cast("binary"))


def docs_model(model: Model) -> Model:
    """The model in single precision, as it travels with the tasks: buckets x labels numbers, whatever the corpus."""
    return replace(model, **{k: getattr(model, k).astype(np.float32) for k in ("idf", "weights", "bias", "surprise")})


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id's decimal digits leaves 1 when divided by 3; null ids are never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", settings: Settings = Settings()) -> DataFrame:
    """docs with `held_out`, `lang_pred`, `score` and `strange`, learned from the labelled rows that aren't held out.

    One row per input row; null ids neither teach nor are held out. Columns of those
    names in the input are replaced. Equal texts get equal answers. Very long texts
    are read whole, piece by piece.
    """
    small_batches(docs.sparkSession)
    own = ("held_out", "lang_pred", "score", "strange")
    names = [c for c in docs.columns if c not in own]
    model = train(docs, text_col, label_col, F.col(id_col).isNotNull() & ~held_out(id_col), id_col, settings)
    out = docs.select(*names, held_out(id_col).alias("held_out"), predict(F.col(text_col), model).alias("__told"))
    return out.select(*names, "held_out", F.col("__told.lang").alias("lang_pred"), F.col("__told.score").alias("score"), F.col("__told.strange").alias("strange"))
