"""Language of texts by a linear-chain conditional random field over their words.

Each word is labelled with a language. Emissions are sums of learned weights of its
character n-grams, its affixes (n-grams that touch a word's edge) and the word itself;
transitions are learned from code-switched sequences made of training texts.
Forward-backward gives each word's distribution, and a text's language is the one with
the largest share of its words.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tidewatch.llm.common import arrow_map, carry_schema, chunks, fitted, mix, per_task, texts_of

UNDECIDED = "und"
BITS = 17
ORDERS = (1, 2, 3, 4)
_RUNS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters."""
    return _RUNS.findall(text.lower())


def has_letter(word: str) -> bool:
    return word.isalpha() or any(c.isalpha() for c in word)


class Grams:
    """Hashed features of distinct words: n-grams of ``^word$`` and the word itself."""

    def __init__(self, words: list[str]):
        text = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        size = np.array([len(w) + 2 for w in words], dtype=np.int64)
        self.start = np.concatenate(([0], np.cumsum(size)[:-1])).astype(np.int64)
        self.word = np.repeat(np.arange(len(words)), size)
        room = np.repeat(self.start + size, size) - np.arange(len(text))  # letters from here to the word's end
        self.features: list[tuple[np.ndarray, np.ndarray]] = []  # (hash, valid) by position
        h = np.zeros(len(text), dtype=np.uint64)
        for n in range(1, max(ORDERS) + 1):
            ahead = np.zeros(len(text), dtype=np.uint64)
            ahead[: len(text) - n + 1] = text[n - 1 :]
            h = mix(h * np.uint64(31) + ahead + np.uint64(n))
            self.features.append(((h >> np.uint64(64 - BITS)).astype(np.int64), room >= n))
        placed = mix(text + mix((np.arange(len(text)) - self.start[self.word]).astype(np.uint64)))
        whole = mix(np.add.reduceat(placed, self.start)) if len(words) else np.zeros(0, np.uint64)
        self.whole = (whole >> np.uint64(64 - BITS)).astype(np.int64)

    def scores(self, weights: np.ndarray, lexicon: np.ndarray) -> np.ndarray:
        """(words, labels) emission scores."""
        if not len(self.start):
            return np.zeros((0, weights.shape[1]), dtype=np.float32)
        at = np.zeros((len(self.word), weights.shape[1]), dtype=np.float32)
        for h, valid in self.features:
            at += weights[h] * valid[:, None]
        return np.add.reduceat(at, self.start, axis=0) + lexicon[self.whole]

    def gradient(self, by_word: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """What a gradient on the scores means for the weights of n-grams and words."""
        labels = by_word.shape[1]
        g, lex = np.zeros((size, labels)), np.zeros((size, labels))
        for k in range(labels):
            own = by_word[self.word, k]
            for h, valid in self.features:
                g[:, k] += np.bincount(h, weights=own * valid, minlength=size)
            lex[:, k] = np.bincount(self.whole, weights=by_word[:, k], minlength=size)
        return g, lex


def forward_backward(emit: np.ndarray, trans: np.ndarray, start: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Marginals of many chains at once.

    ``emit`` holds exp(scores) of all chains, laid end to end; chains are handled longest
    first so that step t works on those that have a word t. Messages are normalised at
    every step.
    """
    order = np.argsort(-lengths, kind="stable")
    sizes = lengths[order]
    first = (np.cumsum(lengths) - lengths)[order]
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(longest), side="left")  # chains with more than t words
    alpha = np.empty_like(emit)
    last = None
    for t in range(longest):
        k = active[t]
        at = first[:k] + t
        a = emit[at] * (start if last is None else last[:k] @ trans)
        a /= a.sum(axis=1, keepdims=True)
        alpha[at] = a
        last = a
    back = np.ones((len(sizes), emit.shape[1]), dtype=emit.dtype)
    for t in range(longest - 2, -1, -1):
        k = active[t + 1]  # these chains have a next word
        at = first[:k] + t + 1
        b = (emit[at] * back[:k]) @ trans.T
        b /= b.sum(axis=1, keepdims=True)
        back[:k] = b
        alpha[at - 1] *= b
    return alpha / alpha.sum(axis=1, keepdims=True)


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray
    lexicon: np.ndarray
    trans: np.ndarray  # exp(transition scores)
    start: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        """exp(scores), each row's largest being 1."""
        parts = [np.zeros((0, len(self.labels)), dtype=np.float32)]
        for i in range(0, len(words), 20_000):
            s = Grams(words[i : i + 20_000]).scores(self.weights, self.lexicon)
            parts.append(np.exp(np.maximum(s - s.max(axis=1, keepdims=True), -30)).astype(np.float32))
        return np.concatenate(parts)


def fit(texts: list[tuple[str, str]], sequences: int = 5000, length: int = 48, rounds: int = 10, seed: int = 7) -> Model:
    """Train on (text, language) pairs.

    Sequences are cut from the texts' words, with switches between texts of different languages.
    Each round is one AdaGrad step on the likelihood of all sequences.
    """
    rng = np.random.default_rng(seed)
    split = [(ws, lang) for ws, lang in ((list(filter(has_letter, words_of(t))), lang) for t, lang in texts) if ws]
    labels = sorted({lang for _, lang in split})
    n = len(labels)
    size = 1 << BITS
    if n < 2:
        one = np.zeros((size, max(n, 1)), dtype=np.float32)
        return Model(labels, one, one.copy(), np.ones((max(n, 1),) * 2, np.float32), np.ones(max(n, 1), np.float32))
    ids: dict[str, int] = {}
    docs = [np.array([ids.setdefault(w, len(ids)) for w in ws]) for ws, _ in split]
    by_label = [[d for d, (_, lang) in zip(docs, split) if lang == label] for label in labels]
    words = np.empty((sequences, length), dtype=np.int64)
    gold = np.empty((sequences, length), dtype=np.int64)
    for i in range(sequences):
        at = 0
        while at < length:
            y = int(rng.integers(n))
            d = by_label[y][int(rng.integers(len(by_label[y])))]
            # half of the sequences hold one language, as most texts do
            span = length if i % 2 else 1 + int(rng.geometric(1 / 16))
            s = int(rng.integers(max(1, len(d) - span + 1)))
            part = d[s : s + min(span, length - at)]
            words[i, at : at + len(part)], gold[i, at : at + len(part)] = part, y
            at += len(part)
    grams = Grams(list(ids))
    w, lex = np.zeros((size, n), np.float32), np.zeros((size, n), np.float32)
    a, s = np.zeros((n, n)), np.zeros(n)
    sums = [np.full_like(x, 1e-6, dtype=np.float64) for x in (w, lex, a, s)]
    hot = np.eye(n)[gold]
    lengths = np.full(sequences, length)
    for r in range(rounds):
        e = grams.scores(w, lex)[words]
        e = np.exp(e - e.max(axis=2, keepdims=True)).astype(np.float64) + 1e-12
        flat = e.reshape(-1, n)
        p = forward_backward(flat, np.exp(a), np.exp(s), lengths).reshape(sequences, length, n)
        by_word = np.zeros((len(ids), n))
        for k in range(n):
            by_word[:, k] = np.bincount(words.ravel(), weights=(hot - p)[:, :, k].ravel(), minlength=len(ids))
        pair = p[:, :-1, :, None] * np.exp(a) * (e * p / np.maximum(p, 1e-12))[:, 1:, None, :]
        pair /= pair.sum(axis=(2, 3), keepdims=True)
        true = np.zeros((n, n))
        np.add.at(true, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
        grads = [*grams.gradient(by_word, size), true - pair.sum(axis=(0, 1)), (hot - p)[:, 0].sum(axis=0)]
        rates = (0.5, 0.5, 0.5, 0.2)
        for x, g, total, rate in zip((w, lex, a, s), grads, sums, rates):
            total += g * g
            x += (rate * g / np.sqrt(total)).astype(x.dtype) * (g != 0)
    return Model(labels, w, lex, np.exp(a).astype(np.float32), np.exp(s).astype(np.float32))


def training_texts(docs: DataFrame, bound: int, longest: int) -> DataFrame:
    """doc_id, text and language of about ``bound`` documents, spread over the languages; of the words of a text
    over ``longest`` characters a stretch of that size at a place drawn by the id. Documents whose
    crc32 of the id is divisible by 5 are held out; ``und``, and texts without a letter, teach nothing."""
    learn = docs.filter(
        (F.col("lang") != UNDECIDED) & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0) & F.col("text").rlike(r"\p{L}")
    )
    counts = {r["lang"]: r["n"] for r in learn.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    each = bound / max(1, len(counts))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    keep = F.lit(False)
    for lang, n in counts.items():
        keep = keep | ((F.col("lang") == lang) & (draw < int(1_000_000 * min(1.0, each / n))))
    words = F.regexp_replace("text", r"[^\p{L}\p{No}\p{Nl}]+", " ")  # so that every stretch holds words
    start = F.pmod(F.xxhash64("doc_id", F.lit("stretch")), F.greatest(F.length(words) - longest + 1, F.lit(1))) + 1
    text = F.when(F.length("text") <= longest, F.col("text")).otherwise(F.substring(words, start.cast("int"), F.lit(longest)))
    return learn.filter(keep).select("doc_id", text.alias("text"), "lang")


def tag(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of every row, from its whole text; docs hold doc_id and text,
    or doc_id and ``row`` (see ``carried``), which is passed on.

    ``und`` with score 0 where the text is NULL or holds no letter, and everywhere if
    nothing was learned. The score is the mean probability of the language over the words.
    """
    arrays = docs.sparkSession.sparkContext.broadcast((model.labels, model.weights, model.lexicon, model.trans, model.start))

    @per_task
    def factory():
        m = Model(*arrays.value)
        n = len(m.labels)
        neutral = np.ones((1, max(n, 1)), dtype=np.float32)  # id 0: runs without a letter, such as superscripts
        known = [neutral]
        fresh: list[str] = []

        class Ids(dict):
            def __missing__(self, w: str) -> int:
                i = self[w] = len(known[0]) + len(fresh) if has_letter(w) else 0
                if i:
                    fresh.append(w)
                return i

        ids = Ids()

        def judged(texts: list) -> tuple[list[str], np.ndarray]:
            seqs = [np.array([ids[w] for w in words_of(t)] if t and n else [], dtype=np.int32) for t in texts]
            if fresh:
                known[0] = np.concatenate([known[0], m.emissions(fresh)])
                fresh.clear()
            lengths = np.array([len(s) if s.any() else 0 for s in seqs], dtype=np.int64)
            langs, scores = [UNDECIDED] * len(texts), np.zeros(len(texts))
            full = np.flatnonzero(lengths)
            if len(full):
                flat = np.concatenate([seqs[i] for i in full])
                p = forward_backward(known[0][flat], m.trans, m.start, lengths[full])
                starts = np.cumsum(lengths[full]) - lengths[full]
                mean = np.add.reduceat(p, starts, axis=0, dtype=np.float64) / lengths[full][:, None]
                for d, row in zip(full, mean):
                    best = int(row.argmax())
                    langs[d], scores[d] = m.labels[best], min(1.0, float(row[best]))
            return langs, scores

        def rows(cols):
            texts = texts_of(cols)
            langs, scores = [], []
            for a, z in chunks(texts, 5_000_000):
                if len(ids) > 300_000:  # keeps memory bounded; words are then scored anew
                    ids.clear()
                    known[0] = neutral
                some, their = judged(texts[a:z])
                langs += some
                scores += their.tolist()
            return {c: cols[c] for c in ("doc_id", "row") if c in cols} | {"lang_pred": langs, "score": scores}

        return rows

    return arrow_map(docs, factory, carry_schema(docs, "doc_id long, lang_pred string, score double"))


def learned(docs: DataFrame, train_docs: int = 2000, train_longest: int = 20_000) -> Model:
    """A model fitted, in one task, on a bounded sample: about ``train_docs`` texts, of each at most ``train_longest`` characters."""

    def arrays_of(rows):
        m = fit([(text, lang) for _, text, lang in rows])
        return {"labels": np.array(m.labels, dtype=str), "weights": m.weights, "lexicon": m.lexicon, "trans": m.trans, "start": m.start}

    a = fitted(training_texts(docs, train_docs, train_longest), arrays_of)
    return Model(a["labels"].tolist(), a["weights"], a["lexicon"], a["trans"], a["start"])


def identify(docs: DataFrame, train_docs: int = 2000, train_longest: int = 20_000) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document.

    The model is fitted on a bounded sample and applied to all rows. A NULL id counts as held out.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))
    tagged = tag(docs.select("doc_id", "text"), learned(docs, train_docs, train_longest))
    return tagged.select("doc_id", held.alias("held_out"), "lang_pred", "score")
