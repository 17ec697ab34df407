"""Language of a text by a linear-chain conditional random field over its words.

Each word of a text is labelled with a language: the model scores a word's affixes and
character n-grams (n-grams over the word between two end marks, so those at an end are
affixes), its counts in a lexicon by language, and transitions between the languages of
neighbouring words, all learned. Forward and backward messages give each word's
probabilities, in code-switched text too; a text's language is that of the largest sum.

The model is fitted by gradient steps on the conditional likelihood of windows whose words
all carry their document's language. The sample is bounded: DOCUMENTS documents in all,
drawn evenly by language from all that may teach, and of each of them WINDOWS windows of
WORDS words, drawn from the whole text. Every word of every text is labelled; chains are cut
every CHAIN words.

Edge cases: a null text, or one without a letter, is ``und`` with score 0 and no words; a
null lang teaches nothing, nor does a null doc_id; without anything to learn from, all texts
are ``und``; equal sums go to the first language by name; rows that repeat are labelled each
and alike; very long texts are labelled whole; at most LABELS languages, the most frequent,
are learned; columns of any name are carried in ``row``; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import frugal, small_batches, table
from .quality_classifier import HELD_OUT, fold

#: Bounds of the sample: documents in all, windows of each, words of each window; languages that are learned.
DOCUMENTS, WINDOWS, WORDS, LABELS = 2_400, 4, 64, 256
#: Buckets of n-grams, their orders, words of a chain, and the rounds and rate of fitting.
BUCKETS, ORDERS, CHAIN, EPOCHS, BATCH, RATE, SEED = 1 << 16, (1, 2, 3, 4), 128, 4, 96, 0.15, 7
UNKNOWN = "und"

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """The text's runs of letters, in lower case."""
    found = _WORD.findall((text or "").lower())
    return found if "".join(found).isalpha() else [w for w in found if any(map(str.isalpha, w))]


def ngrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words' n-grams and the place of their word; of each order, word after word."""
    codes = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])
    buckets, owners = [], []
    h = np.zeros(len(codes), dtype=np.uint64)
    for n in range(1, max(ORDERS) + 1):
        if n > len(codes):
            break
        h = h[: len(codes) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :] + np.uint64(n)
        if n in ORDERS:
            inside = owner[: len(h)] == owner[n - 1 :]
            mixed = (h[inside] ^ (h[inside] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            buckets.append((mixed >> np.uint64(40)) % np.uint64(BUCKETS))
            owners.append(owner[: len(h)][inside])
    return np.concatenate(buckets).astype(np.int64), np.concatenate(owners)


class Field:
    """The model: numpy arrays and a lexicon, all of a size that the sample's bounds and the number of languages fix."""

    def __init__(self, labels: list[str], lexicon: dict[str, int], counts: np.ndarray):
        n = len(labels)
        self.labels, self.lexicon, self.counts = labels, lexicon, counts
        self.grams = np.zeros((BUCKETS, n))
        self.by_lexicon = np.eye(n)
        self.moves = np.eye(n)

    def shares(self, counts: np.ndarray) -> np.ndarray:
        """What a word's counts by language say, less if there are few."""
        total = counts.sum(axis=1, keepdims=True)
        n = len(self.labels)
        return ((counts + 0.5) / (total + 0.5 * n) - 1 / n) * total / (total + 2)

    def of_grams(self, words: list[str]) -> np.ndarray:
        """Scores of each word's n-grams by language."""
        buckets, owners = ngrams(words)
        return np.column_stack([np.bincount(owners, self.grams[buckets, y], len(words)) for y in range(len(self.labels))])

    def emissions(self, words: list[str]) -> np.ndarray:
        at = np.fromiter((self.lexicon.get(w, -1) for w in words), dtype=np.int64, count=len(words))
        held = np.where(at[:, None] >= 0, self.counts[at], 0) if len(self.counts) else np.zeros((len(words), len(self.labels)))
        return self.of_grams(words) + self.shares(held) @ self.by_lexicon

    def messages(self, scores: np.ndarray, lengths: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Marginals (chain, word, language) by forward-backward, and expected counts of moves. scores: the same shape, beyond a chain's length of no account."""
        e = np.exp(scores - scores.max(axis=2, keepdims=True))
        a = np.exp(self.moves)
        steps = e.shape[1]
        alpha, beta = np.empty_like(e), np.ones_like(e)
        alpha[:, 0] = e[:, 0] / e[:, 0].sum(axis=1, keepdims=True)
        for t in range(1, steps):
            x = (alpha[:, t - 1] @ a) * e[:, t]
            alpha[:, t] = x / x.sum(axis=1, keepdims=True)
        for t in range(steps - 2, -1, -1):
            x = (e[:, t + 1] * beta[:, t + 1]) @ a.T
            beta[:, t] = np.where((lengths > t + 1)[:, None], x / x.sum(axis=1, keepdims=True), 1.0)
        out = alpha * beta
        out /= out.sum(axis=2, keepdims=True)
        if not pairs:
            return out, None
        both = alpha[:, :-1, :, None] * a * (e[:, 1:] * beta[:, 1:])[:, :, None, :]
        both /= both.sum(axis=(2, 3), keepdims=True)
        return out, (both * (np.arange(1, steps) < lengths[:, None])[:, :, None, None]).sum(axis=(0, 1))

    def label(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Sums of the words' probabilities by language, of each text; the likeliest language of each word of all texts."""
        places: dict[str, int] = {}
        flat = np.fromiter((places.setdefault(w, len(places)) for t in texts for w in t), dtype=np.int64)
        sums = np.zeros((len(texts), len(self.labels)))
        each = np.zeros(len(flat), dtype=np.int32)
        if not len(flat):
            return sums, each
        known = self.emissions(list(places))
        n_words = np.array([len(t) for t in texts])
        chains = -(-n_words // CHAIN)
        owner = np.repeat(np.arange(len(texts)), chains)
        first = np.concatenate(([0], np.cumsum(n_words)[:-1]))
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(chains) - chains, chains)
        start = first[owner] + nth * CHAIN
        lengths = np.minimum(CHAIN, first[owner] + n_words[owner] - start)
        for part in range(0, len(owner), 4096):
            s, n = start[part : part + 4096], lengths[part : part + 4096]
            steps = np.arange(n.max())
            inside = steps < n[:, None]
            at = np.where(inside, s[:, None] + steps, s[:, None])
            marginals, _ = self.messages(known[flat[at]], n)
            each[at[inside]] = marginals.argmax(axis=2)[inside]
            np.add.at(sums, owner[part : part + 4096], (marginals * inside[:, :, None]).sum(axis=1))
        return sums, each


def fit(windows: list[list[str]], langs: list[str]) -> Field | None:
    """A field that makes the words of each window carry its language; None without words."""
    sample = [(w, y) for w, y in zip(windows, langs, strict=True) if w]
    if not sample:
        return None
    labels = sorted({y for _, y in sample})
    lexicon: dict[str, int] = {}
    flat = np.array([lexicon.setdefault(w, len(lexicon)) for ws, _ in sample for w in ws])
    n_words = np.array([len(ws) for ws, _ in sample])
    of_window = np.array([labels.index(y) for _, y in sample])
    y = np.repeat(of_window, n_words)
    counts = np.zeros((len(lexicon), len(labels)))
    np.add.at(counts, (flat, y), 1)
    field = Field(labels, lexicon, counts)
    buckets, owners = ngrams(list(lexicon))
    order = np.argsort(owners, kind="stable")
    buckets, held = buckets[order], np.bincount(owners, minlength=len(lexicon))
    gram_start = np.concatenate(([0], np.cumsum(held)))
    first = np.concatenate(([0], np.cumsum(n_words)))
    rng, n_labels = np.random.default_rng(SEED), len(labels)
    squares = [np.full_like(w, 1e-4) for w in (field.grams, field.by_lexicon, field.moves)]
    for _ in range(EPOCHS):
        mixed = rng.permutation(len(sample))
        for at in range(0, len(mixed), BATCH):
            chosen = mixed[at : at + BATCH]
            n = n_words[chosen]
            steps = np.arange(n.max())
            inside = steps < n[:, None]
            token = np.where(inside, first[chosen][:, None] + steps, first[chosen][:, None])
            tokens = token[inside]
            kinds, back = np.unique(flat[tokens], return_inverse=True)
            span = np.concatenate([np.arange(gram_start[k], gram_start[k + 1]) for k in kinds])
            owner = np.repeat(np.arange(len(kinds)), held[kinds])
            used = buckets[span]
            of_kind = np.column_stack([np.bincount(owner, field.grams[used, j], len(kinds)) for j in range(n_labels)])
            shares = field.shares(counts[flat[tokens]] - np.eye(n_labels)[y[tokens]])  # a word's own mark must not tell
            scores = np.zeros((*token.shape, n_labels))
            scores[inside] = of_kind[back] + shares @ field.by_lexicon
            marginals, moves = field.messages(scores, n, pairs=True)
            gap = np.eye(n_labels)[y[tokens]] - marginals[inside]
            by_kind = np.column_stack([np.bincount(back, gap[:, j], len(kinds)) for j in range(n_labels)])
            grams = np.column_stack([np.bincount(used, by_kind[owner, j], BUCKETS) for j in range(n_labels)])
            stays = np.zeros((n_labels, n_labels))
            np.add.at(stays, (of_window[chosen], of_window[chosen]), n - 1)
            total = max(len(tokens), 1)
            for w, s, g in zip((field.grams, field.by_lexicon, field.moves), squares, (grams, shares.T @ gap, stays - moves), strict=True):
                g = g / total - 1e-6 * w
                s += g * g
                w += RATE * g / np.sqrt(s)
    return field


def _drawn(*by: str) -> Column:
    return F.pmod(F.xxhash64(*by, F.lit(SEED)), F.lit(1 << 30))


def learn(docs: DataFrame, documents: int = DOCUMENTS) -> Field | None:
    """The field fitted on a bounded sample of docs(doc_id, text, lang), see above."""
    small_batches(docs.sparkSession)
    able = docs.where((fold(F.col("doc_id")) != HELD_OUT) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = able.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LABELS).collect()
    if not sizes:
        return None
    share = documents / len(sizes)
    rate = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], int((1 << 30) * min(1.0, 1.2 * share / r["count"])))])

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for drawn, lang, text in zip(batch["drawn"], batch["lang"], batch["text"], strict=True):
                words = words_of(text)
                parts = [words[i : i + WORDS] for i in range(0, len(words), WORDS)]
                picked = np.random.default_rng(int(drawn)).permutation(len(parts))[:WINDOWS]
                rows += [(drawn, int(i), lang, parts[i]) for i in sorted(picked)]
            yield pd.DataFrame(rows, columns=["drawn", "nth", "lang", "words"])

    drawn = able.select(_drawn("doc_id", "text").alias("drawn"), "lang", "text").where(F.col("drawn") < F.element_at(rate, F.col("lang")))
    found = drawn.mapInPandas(frugal(windows), "drawn long, nth int, lang string, words array<string>").orderBy("drawn", "nth", "lang", "words").limit(2 * documents * WINDOWS).toPandas()
    return fit([list(w) for w in found["words"]], list(found["lang"]))


def predict(docs: DataFrame, field: Field | None) -> DataFrame:
    """row (docs' columns), lang_pred, score (the mean probability of that language over the words), n_words and spans of each row.

    spans array<struct<first, words, lang>>: the runs of words, from 0, that are likeliest in one language.
    """
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(field)

    def runs(each: np.ndarray) -> list[dict]:
        if not len(each):
            return []
        at = np.flatnonzero(np.concatenate(([True], each[1:] != each[:-1])))
        return [{"first": int(a), "words": int(b - a), "lang": model.value.labels[each[a]]} for a, b in zip(at, [*at[1:], len(each)], strict=True)]

    @F.pandas_udf("lang_pred string, score double, n_words long, spans array<struct<first:int,words:int,lang:string>>")
    @frugal
    def labelled(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            words = [words_of(t) for t in texts]
            n = np.array([len(w) for w in words], dtype=np.int64)
            if model.value is None:
                yield pd.DataFrame({"lang_pred": UNKNOWN, "score": 0.0, "n_words": n, "spans": [[] for _ in n]})
                continue
            sums, each = model.value.label(words)
            best = sums.argmax(axis=1) if len(sums) else np.zeros(0, dtype=int)
            score = np.clip(sums.max(axis=1, initial=0) / np.maximum(n, 1), 0, 1)
            yield pd.DataFrame({"lang_pred": [model.value.labels[b] if k else UNKNOWN for b, k in zip(best, n, strict=True)], "score": score, "n_words": n, "spans": [runs(x) for x in np.split(each, np.cumsum(n)[:-1])] if len(n) else []})

    return docs.select(F.struct("*").alias("row")).withColumn("_p", labelled(F.col("row.text"))).select("row", "_p.*")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = predict(docs.select("doc_id", "text"), learn(docs.select("doc_id", "text", "lang")))
    return out.select("row.doc_id", F.coalesce(fold(F.col("row.doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", "score")
