"""Language ID by a byte convolutional network, trained in numpy and applied to batched fixed-length windows.

Text is lower-cased and encoded as UTF-8; ASCII bytes other than letters share one class. Filters of several widths
slide over a window; each filter's maximum over the window feeds a softmax over the languages seen in training.
The parameters of a filter are one weight for each place and byte class, so a filter's value is a sum of table rows:
no embedding product is needed, and the gradient of the maximum touches one place a filter.

A document's score for a language is the mean of its windows' probabilities, weighted by letters; every byte of a
text belongs to one window, so whole texts are judged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import unused

#: Bytes of a window; widths of the filters and filters of each width; windows a prediction batch holds.
WINDOW, WIDTHS, FILTERS, BATCH = 256, (2, 3, 4), 16, 256
#: Bound of the training sample: rows of each language, and windows of each row.
ROWS_PER_LANG, WINDOWS_PER_ROW = 800, 2
#: Languages that a network learns at most; labels beyond are noise, or need a larger sample.
MAX_LANGS = 400
N_CLASSES = 155
UND = "und"
#: Score below which no language counts as found; clean documents of learned languages score 0.5 or more, even of a network trained on 150 rows.
MIN_SCORE = 0.4


def _classes() -> np.ndarray:
    out = np.zeros(256, np.uint8)
    for b in range(26):
        out[ord("a") + b] = out[ord("A") + b] = 1 + b
    for b in range(0x80, 0x100):
        out[b] = 27 + (b - 0x80)
    return out


CLASS_OF = _classes()


def windows(text: str, length: int = WINDOW) -> np.ndarray:
    """Byte classes of the whole text, one row a window; the last is filled up with class 0."""
    x = CLASS_OF[np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)]
    n = max(1, -(-len(x) // length))
    out = np.zeros(n * length, np.uint8)
    out[: len(x)] = x
    return out.reshape(n, length)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def foreign(x: np.ndarray, seed: int = 11) -> np.ndarray:
    """The windows with their letters made those of no language, in turn: renamed by a random permutation of a to z,
    drawn from a to z, or replaced by two-byte sequences of a random script."""
    rng, out = np.random.default_rng(seed), x.copy()
    for i, row in enumerate(x):
        live = row > 0
        n = int(live.sum())
        if i % 3 == 0:
            to = np.arange(N_CLASSES, dtype=np.uint8)
            to[1:27] = 1 + rng.permutation(26)
            out[i] = to[row]
        elif i % 3 == 1:
            out[i, live] = rng.integers(1, 27, n)
        else:
            v = 27 + rng.integers(0, 64, n)
            v[::2] = rng.integers(27 + 0x42, 27 + 0x70) + rng.integers(0, 2, len(v[::2]))
            out[i, live] = v
    return out


class ByteCNN:
    """tables[i]: (width, class, filter) weights of one width; dense: (all filters, language)."""

    def __init__(self, langs: list[str], widths: tuple[int, ...] = WIDTHS, filters: int = FILTERS, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs, self.widths = list(langs), tuple(widths)
        self.tables = [rng.normal(0, 0.3, (w, N_CLASSES, filters)).astype(np.float32) for w in widths]
        self.dense = rng.normal(0, 0.1, (filters * len(widths), len(langs))).astype(np.float32)
        self.bias = np.zeros(len(langs), np.float32)

    def pooled(self, x: np.ndarray, places: bool = False):
        """Maximum of every filter over each window, and where it stands if asked."""
        feats, at = [], []
        for w, t in zip(self.widths, self.tables, strict=True):
            span = x.shape[1] - w + 1
            value = np.take(t[0], x[:, :span], axis=0)
            for k in range(1, w):
                value += np.take(t[k], x[:, k : k + span], axis=0)
            if places:
                at.append(value.argmax(axis=1))
            feats.append(value.max(axis=1))
        return (np.concatenate(feats, 1), at) if places else np.concatenate(feats, 1)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = []
        for i in range(0, len(x), BATCH):
            z = np.maximum(self.pooled(x[i : i + BATCH]), 0) @ self.dense + self.bias
            z = np.exp(z - z.max(1, keepdims=True))
            out.append(z / z.sum(1, keepdims=True))
        return np.concatenate(out)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross entropy of windows x and languages y, and its gradients for the tables, dense and bias."""
        n_filters = self.tables[0].shape[2]
        feats, at = self.pooled(x, places=True)
        live = np.maximum(feats, 0)
        z = live @ self.dense + self.bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        loss = float(-np.log(p[np.arange(len(y)), y]).mean())
        p[np.arange(len(y)), y] -= 1
        p /= len(y)
        back = (p @ self.dense.T) * (feats > 0)
        grads = []
        for j, (w, t) in enumerate(zip(self.widths, self.tables, strict=True)):
            g, d = np.zeros_like(t), back[:, j * n_filters : (j + 1) * n_filters]
            f = np.broadcast_to(np.arange(n_filters), d.shape)
            for k in range(w):
                np.add.at(g[k], (np.take_along_axis(x, at[j] + k, 1), f), d)
            grads.append(g)
        return loss, [*grads, live.T @ p, p.sum(0)]

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.01, seed: int = 7) -> ByteCNN:
        """Adam on the cross entropy; rows in an order drawn from the seed."""
        rng = np.random.default_rng(seed)
        params = [*self.tables, self.dense, self.bias]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                rows = order[i : i + batch]
                _, grads = self.gradients(x[rows], y[rows])
                step += 1
                for q, g, m, v in zip(params, grads, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    q -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return self

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; `und` and 0 for a null text or one without a letter. A network that learned to reject may also answer `und`, with its score."""
        langs, scores = [UND] * len(texts), np.zeros(len(texts))
        i = 0
        while i < len(texts):
            group, parts, size = [], [], 0
            while i < len(texts) and size < 4 * BATCH:  # whole texts until the batch is full
                if has_letter(texts[i]):
                    parts.append(windows(texts[i]))
                    group.append(i)
                    size += len(parts[-1])
                i += 1
            if not group:
                continue
            x = np.concatenate(parts)
            p = self.probabilities(x) * ((x > 0).sum(1, keepdims=True) + 1e-9)
            sums = np.add.reduceat(p, np.cumsum([0, *(len(q) for q in parts[:-1])]), axis=0)
            sums /= sums.sum(1, keepdims=True)
            for row, s in zip(group, sums, strict=True):
                langs[row], scores[row] = self.langs[int(s.argmax())], min(1.0, max(0.0, float(s.max())))
        return langs, scores


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", rows_per_lang: int = ROWS_PER_LANG, windows_per_row: int = WINDOWS_PER_ROW, reject: bool = False) -> ByteCNN | None:
    """Fits the network on a bounded sample of the labelled rows: at most about `rows_per_lang` rows of each of the `MAX_LANGS` languages
    with most rows, drawn by a hash of the text, and `windows_per_row` windows of each, cut in Spark. None where no row is labelled.
    reject: the network also learns `und`, from a third of the windows made foreign, so that it can turn down what is in none of the languages."""
    rows = labelled.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).where("lang is not null and text is not null and lang != 'und'")
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGS).collect()}
    if not counts:
        return None
    share = F.lit(0.0)
    for k, v in counts.items():
        share = F.when(F.col("lang") == k, F.lit(rows_per_lang / v)).otherwise(share)
    lot = F.pmod(F.xxhash64(F.lit("train"), "text"), F.lit(1 << 30)) / float(1 << 30)
    cuts = [F.substring(F.col("text"), F.pmod(F.xxhash64(F.lit(k), "text"), F.greatest(F.lit(1), F.length("text") - WINDOW + 1)).cast("int") + 1, F.lit(WINDOW)) for k in range(windows_per_row)]
    got = rows.where(lot < share).select("lang", F.array(*cuts).alias("cuts")).collect()
    langs = sorted(counts)
    x = [(windows(c)[0], langs.index(r["lang"])) for r in sorted(got, key=lambda r: (r["lang"], r["cuts"])) for c in r["cuts"] if has_letter(c)]
    if not x:
        return None
    rows, y = np.stack([a for a, _ in x]), np.array([b for _, b in x])
    if reject:
        none = foreign(rows[::3])
        rows, y, langs = np.concatenate([rows, none]), np.concatenate([y, np.full(len(none), len(langs))]), [*langs, UND]
    return ByteCNN(langs).fit(rows, y)


def identify(docs: DataFrame, model: ByteCNN | None, text: str = "text", lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the predicted language and its score added (a clashing column is replaced).

    Only the text is read. Null, empty and letterless texts: `und`, score 0; so is everything where there was
    nothing to learn from. Repeated rows get equal results; an empty table gives an empty table.
    """
    kept = [c for c in docs.columns if c not in (lang_pred, score)]
    temp = unused(docs, "_guess")["_guess"]

    @F.pandas_udf("lang string, score double")
    def guess(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            got = model.predict([t if isinstance(t, str) else None for t in texts]) if model is not None else ([UND] * len(texts), np.zeros(len(texts)))
            yield pd.DataFrame({"lang": got[0], "score": got[1]})

    out = docs.select(*kept, guess(F.col(text).cast("string")).alias(temp))
    return out.select(*kept, F.col(f"{temp}.lang").alias(lang_pred), F.col(f"{temp}.score").alias(score))


def in_learned_language(docs: DataFrame, model: ByteCNN | None, text: str = "text", floor: float = MIN_SCORE) -> DataFrame:
    """The docs whose text the network puts in a language it learned, with a score of `floor` or more.

    Null, empty and letterless texts go. Where there was nothing to learn from (model None) no language can be told
    from another, and every text with a letter stays.
    """
    if model is None:

        @F.pandas_udf("boolean")
        def lettered(texts: pd.Series) -> pd.Series:
            return pd.Series([isinstance(t, str) and has_letter(t) for t in texts], dtype=bool)

        return docs.where(lettered(F.col(text).cast("string")))
    n = unused(docs, "_lang_pred", "_score")
    out = identify(docs, model, text, n["_lang_pred"], n["_score"])
    return out.where((F.col(n["_lang_pred"]) != UND) & (F.col(n["_score"]) >= floor)).select(*docs.columns)
