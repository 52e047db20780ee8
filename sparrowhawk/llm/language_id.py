"""Language identification: averaged hashed subword embeddings and a linear softmax.

Words (runs of letters, lower-cased, without digits in them) are cut into character n-grams with word ends; n-grams
are hashed into buckets that have embeddings. A text is the mean of its subwords'
embeddings, and a linear softmax over it gives the language. Embeddings and weights are
trained by stochastic gradient descent in numpy on a bounded sample of labelled rows; a
fifth of the sample is kept out of training, for calibration:

* the softmax's temperature, by the least loss on texts and short runs of their words;
* the confidence, as far as it is above that of a guess, under which a prediction is rejected;
* the familiarity under which a text is rejected: the share of a word's subwords that
  training met, averaged over the words. A softmax over the learned languages can't tell a foreign text, whatever their number;
  familiarity can. For runs of 1, 2, 4, ... words the threshold lies between what the
  calibration texts have and what they have with the letters of each word shuffled, and under
  all of the former. About SHUFFLED whole runs of each length are shuffled.

The sample: ``per_language`` rows of each language that have a text, those with the least
hashes; of each text at most its first TEXT_CHARS characters, and fewer where all languages'
rows together would come to more than SAMPLE_CHARS. More than ``most_languages`` languages
raise. The model is applied to whole texts.

Cases: a null text, or one without a letter, is ``und`` with score 0 and rejected. Rows are
predicted one by one: repeated rows give repeated results. Without any labelled row every
prediction is ``und``. With one language its score is 1, and familiarity alone rejects. Empty
tables give empty results; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import dataclasses
import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

RUNS, LETTERS = re.compile(r"[^\W_]+"), re.compile(r"[^\W\d_]+")
BUCKETS, DIM, GRAMS = 1 << 15, 16, (2, 3, 4)
#: The sample's bounds: rows of a language, characters of a text, characters in all, languages.
PER_LANGUAGE, TEXT_CHARS, SAMPLE_CHARS, MOST_LANGUAGES = 400, 25_000, 60_000_000, 1000
#: Slots of the table of n-grams met in training.
SEEN = 1 << 22
CACHE_WORDS = 300_000
#: Steps of stochastic gradient descent.
STEPS = 8000
#: A prediction is rejected if its confidence above a guess is less than this part of the least of a right calibration text, and than this.
MARGIN, MOST_REJECTED = 0.5, 0.1
#: Where between the median of shuffled words (0) and nearly all calibration texts (1) the threshold of familiarity lies; part of the least calibration text's that it has at most.
NEARER, BELOW_LEAST = 0.5, 0.95
#: Runs of each length that are shuffled, about.
SHUFFLED = 200


def grams_of(word: str) -> list[int]:
    """Hashes of a word's n-grams and of the word itself."""
    marked = f"<{word}>"
    grams = [marked[i : i + n] for n in GRAMS for i in range(len(marked) - n + 1)]
    return [zlib.crc32(g.encode("utf-8", "replace")) for g in [*grams, marked]]


def subwords(word: str) -> list[int]:
    """Buckets of a word's n-grams and of the word itself."""
    return [g % BUCKETS for g in grams_of(word)]


def words_of(text: str | None) -> list[str]:
    """A text's words: runs of letters without digits; where there are none, the letters among digits. None if it has no letter."""
    low = (text or "").lower()
    return [w for w in RUNS.findall(low) if w.isalpha()] or [w for w in LETTERS.findall(low) if any(map(str.isalpha, w))]


@dataclass
class Model:
    languages: list[str]
    #: Each bucket's part in the logits (its embedding times the softmax's weights), and the bias.
    logits: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0
    #: Slots of the n-grams that training met, one byte each.
    seen: bytes = field(default=b"", repr=False)
    #: Least familiarity of a text of 2**i words or more (the last entry that applies).
    familiar: list[float] = field(default_factory=list)
    cache: dict = field(default_factory=dict, repr=False)
    #: For each word in the cache the sum of its subwords' logits, the share of them that was seen, and their number.
    table: np.ndarray = field(default=None, repr=False)

    def _row(self, word: str) -> int:
        n = self.cache[word] = len(self.cache)
        if self.table is None:
            self.table = np.zeros((1024, len(self.bias) + 2), dtype=np.float32)
        elif n == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        g = grams_of(word)
        self.table[n, :-2] = self.logits[[x % BUCKETS for x in g]].sum(axis=0)
        self.table[n, -2] = sum([self.seen[x % SEEN] for x in g]) / len(g) if self.seen else 0
        self.table[n, -1] = len(g)
        return n

    def raw(self, words: list[str]) -> tuple[np.ndarray, float]:
        """Logits of a text's words before the temperature, and their familiarity."""
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        get = self.cache.get
        at = [get(w, -1) for w in words]
        if -1 in at:
            at = [i if i >= 0 else get(w, -1) if get(w, -1) >= 0 else self._row(w) for i, w in zip(at, words)]
        total = self.table[at].sum(axis=0, dtype=np.float64)
        return total[:-2] / total[-1] + self.bias, float(total[-2] / len(words))

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score, and whether the prediction is accepted."""
        words = words_of(text)
        if not words or not self.languages:
            return "und", 0.0, False
        logits, familiarity = self.raw(words)
        p = softmax(logits / self.temperature)
        k = int(p.argmax())
        least = self.familiar[min(len(self.familiar), len(words).bit_length()) - 1] if self.familiar else 0.0
        return self.languages[k], float(p[k]), familiarity >= least and above_guess(p) >= self.reject_below


def above_guess(p: np.ndarray) -> float:
    """Confidence as far as it is above that of a guess: 0 to 1; 1 for a single language."""
    return (float(p.max()) - 1 / len(p)) / (1 - 1 / len(p)) if len(p) > 1 else 1.0


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def _bag(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets and their shares."""
    b, n = np.unique(np.concatenate([subwords(w) for w in words]), return_counts=True)
    return b, (n / n.sum())[:, None]


def train(texts: list[str], labels: list[str], steps: int = STEPS, rate: float = 0.5, seed: int = 7) -> Model:
    """A model of the labelled texts; deterministic. A step takes a run of a text's words."""
    rows = [(w, y) for w, y in ((words_of(t), y) for t, y in zip(texts, labels)) if w]
    languages = sorted({y for _, y in rows})
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    held = set(order[: len(rows) // 5].tolist())
    fit = [int(i) for i in order if int(i) not in held]
    embed = rng.normal(0, 0.1, (BUCKETS, DIM))
    weights, bias = np.zeros((len(languages), DIM)), np.zeros(len(languages))
    weights += rng.normal(0, 0.1, weights.shape)
    for done in range(steps):
        if done % len(fit) == 0:
            fit = rng.permutation(fit).tolist()
        words, y = rows[fit[done % len(fit)]]
        n = len(words)
        size = min(n, int(rng.integers(4, 300)))
        start = int(rng.integers(0, n - size + 1))
        lr = rate * (1 - done / steps)
        b, share = _bag(words[start : start + size])
        h = (embed[b] * share).sum(axis=0)
        g = softmax(weights @ h + bias)
        g[languages.index(y)] -= 1
        back = weights.T @ g
        weights -= lr * np.outer(g, h)
        bias -= lr * 0.1 * g
        embed[b] -= lr * DIM * share * back
    seen = np.zeros(SEEN, np.uint8)
    for word in {w for i in fit for w in rows[i][0]}:
        seen[[g % SEEN for g in grams_of(word)]] = 1
    model = Model(languages, (embed @ weights.T).astype(np.float32), bias, seen=seen.tobytes())
    calibrate(model, [rows[i] for i in (held or fit)])
    return model


def calibrate(model: Model, rows: list[tuple[list[str], str]]) -> None:
    """The temperature with the least loss on rows and short runs of their words, and the two scores below which is rejected."""
    short = [(w[len(w) // 2 :][:n], v) for w, v in rows for n in (1, 2, 4)]
    raw = np.array([model.raw(w)[0] for w, _ in [*rows, *short]])
    y = np.array([model.languages.index(v) for _, v in [*rows, *short]])
    best = None
    for t in np.geomspace(0.05, 10, 40):
        x = raw / t
        x -= x.max(axis=1, keepdims=True)
        loss = float((np.log(np.exp(x).sum(axis=1)) - x[np.arange(len(y)), y]).mean())
        if best is None or loss < best[0] - 1e-12:
            best = (loss, float(t))
    model.temperature = best[1]
    p = [softmax(r / model.temperature) for r in raw[: len(rows)]]
    right = [above_guess(x) for x, k in zip(p, y) if x.argmax() == k]
    model.reject_below = min(MOST_REJECTED, MARGIN * min(right)) if right else 0.0
    model.familiar = familiarity_thresholds(model, [w for w, _ in rows])


def familiarity_thresholds(model: Model, rows: list[list[str]], seed: int = 11) -> list[float]:
    """Least familiarity for runs of 1, 2, 4, ... words, of calibration texts against the same with shuffled letters."""
    rng = np.random.default_rng(seed)
    out: list[float] = []
    mixed = lambda w: "".join(rng.permutation(list(w)))
    for i in range(max(len(w) for w in rows).bit_length()):
        n = 1 << i
        runs = [w[s : s + n] for w in rows if len(w) >= n for s in sorted({0, (len(w) - n) // 2, len(w) - n})]
        runs += [w for w in rows if n <= len(w) < 2 * n]
        own = np.array([model.raw(r)[1] for r in runs])
        some = runs[:: max(1, len(runs) // SHUFFLED)]
        other = np.array([model.raw([mixed(w) for w in r])[1] for r in some])
        low, high = np.quantile(own, 0.01), np.median(other)
        between = NEARER * low + (1 - NEARER) * high if low > high else own.min()
        out.append(float(min(between, BELOW_LEAST * own.min())))
    return out


def held_out(doc_id) -> "F.Column":
    """Whether a document is held out: crc32 of its id as text, modulo 5, is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, most_languages: int = MOST_LANGUAGES) -> Model:
    """A model of the documents with a language that aren't held out; reads a bounded sample of their texts."""
    can = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = can.groupBy("lang").count().limit(most_languages + 1).collect()
    if not counts:
        return train([], [])
    if len(counts) > most_languages:
        raise ValueError(f"more than {most_languages} languages: is this a column of languages?")
    rows = sum(min(per_language, r["count"]) for r in counts)
    chars = max(1, min(TEXT_CHARS, SAMPLE_CHARS // rows))
    # Twice the rows by hash, and of these exactly the first by hash: what is drawn depends on the rows alone.
    share = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, (2 * per_language + 100) / r["count"])))])
    chance = F.pmod(F.xxhash64(F.lit(1), F.col("doc_id")), F.lit(1 << 20)) / float(1 << 20)
    sample = can.where(F.try_element_at(share, F.col("lang")) > chance).select(F.xxhash64(F.lit(2), "doc_id").alias("h"), F.left("text", F.lit(chars)).alias("text"), "lang")
    first = Window.partitionBy("lang").orderBy("h", "text")
    drawn = sample.withColumn("i", F.row_number().over(first)).where(F.col("i") <= per_language).select("h", "text", "lang").collect()
    drawn.sort(key=lambda r: (r["h"], r["lang"], r["text"]))
    return train([r["text"] for r in drawn], [r["lang"] for r in drawn])


def predictor(model: Model):
    """A pandas UDF: text to struct(lang_pred, score, accepted)."""
    model = dataclasses.replace(model, cache={}, table=None)

    @F.pandas_udf("lang_pred string, score double, accepted boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.predict(t) for t in texts], columns=["lang_pred", "score", "accepted"])

    return predict


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted of every document."""
    model = model or fit(docs)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predictor(model)(F.col("text").cast("string")).alias("p"))
    return rows.select("doc_id", "held_out", "p.lang_pred", "p.score", "p.accepted")


def keep_identified(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """docs without the documents whose language is rejected; all columns stay."""
    model = model or fit(docs)
    return docs.where(predictor(model)(F.col("text").cast("string"))["accepted"])
