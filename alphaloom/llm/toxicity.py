"""Toxicity by a support vector machine on a gap-weighted subsequence kernel with Nystroem landmarks.

Two words are alike by the letter fours that they share in order, gaps allowed: a four that
spans s characters counts ``DECAY ** s``, at most ``SPAN`` characters apart. Separators inside a
word and inserted letters thus only add gaps, and single letters in a row are read as one word.
Kernel values with a few landmark words, whitened by the landmarks' own kernel matrix, are the
features of a linear machine. A sentence is as bad as its worst word, which is how words are picked
in training: from labelled documents' sentences, the worst word of each toxic document against the
words of clean documents. A document's chance to be toxic follows from its ``TOP`` worst words.

A linear machine on kernel values is a sum over fours, so the trained model is one table of
weights for fours, and scoring is a few look-ups for each character of the whole text.

Learned from at most about ``TRAIN_DOCS`` labelled documents of each class, chosen by checksum of
the id, never from held-out ids. Scores are calibrated on training documents that the machine has
not seen.

Defined results: a null text is scored as the empty one, which holds no word and gets the least
score; repeated rows score alike; null labels, labels of unknown ids and ids with null are left
out; without both classes every score is the mean label, 0.5 without labels; an empty table gives
an empty table; ``score`` drops other columns and ``reject`` keeps them.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alphaloom.llm.common import held_out, stored

TRAIN_DOCS = 3000
LANDMARKS = 192
SPAN, DECAY = 6, 0.7
#: Letters are 1 to 26, letters of other scripts 27 to 30, the start of a word 31, all else 0.
CODES, START = 32, 31
FOURS = CODES**4
#: Characters after which a word without blanks is cut; words that long are read twice, with other cuts.
WORD_LIMIT = 24
CHUNK = 200_000
#: Rows of a batch that are scored at a time.
ROWS = 500
#: Rounds of training, and toxic documents without explanation that are too few for another one.
ROUNDS, LEAST_OPEN = 4, 10
#: Worst words by which a document is judged.
TOP = 3
#: Words that a round picks on average at most.
WORDS = 60_000
#: Deviations that rare fours reach by chance, the ratio that tells nothing, and the part of clean documents whose words stay below a toxic one.
CHANCE, RATIO, ABOVE = 3.5, 4.0, 0.93
GAPS = [(a, b, c) for c in range(3, SPAN) for b in range(2, c) for a in range(1, b)]


@functools.lru_cache(maxsize=1)
def _code_table() -> np.ndarray:
    table = np.zeros(1 << 16, np.uint8)
    for cp in range(1 << 16):
        c = chr(cp)
        if c in " \t\n\x0b\x0c\r":
            table[cp] = START
        elif c.isalpha():
            base = unicodedata.normalize("NFKD", c.lower())[:1]
            table[cp] = ord(base) - 96 if "a" <= base <= "z" else 19 if c in "ßẞ" else 27 + cp % 4
    return table


@dataclass
class Words:
    """Letter codes of some texts, word by word; ``starts`` are the words' first places, ``doc`` their texts, ``cut`` tells pieces of very long words."""

    codes: np.ndarray
    word: np.ndarray
    starts: np.ndarray
    doc: np.ndarray
    cut: np.ndarray


def words_of(texts: list[str | None], shift: int = 0) -> Words:
    texts = [t or "" for t in texts]
    joined = "\n\n".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    table = _code_table()
    codes = np.where(points < (1 << 16), table[points & 0xFFFF], 0).astype(np.uint8)
    doc = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in texts])[: len(codes)]
    blank = codes == START
    # Single letters in a row: a blank with a lone letter on either side parts no words.
    padded = np.r_[True, True, blank, True, True]
    lone_before = ~padded[1:-3] & padded[:-4]
    lone_after = ~padded[3:-1] & padded[4:]
    soft = blank & lone_before & lone_after
    codes = np.where(soft, 0, codes)
    blank &= ~soft
    word = np.cumsum(blank)
    keep = (codes > 0) & ~blank
    codes, doc, word = codes[keep], doc[keep], word[keep]
    if not len(codes):
        none = np.zeros(0, np.int64)
        return Words(codes, word, none, none, none.astype(bool))
    first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    # The mark for a word's start goes before its first letter.
    codes, doc, word = np.insert(codes, first, START), np.insert(doc, first, doc[first]), np.insert(word, first, word[first])
    first = first + np.arange(len(first))
    sizes = np.diff(np.r_[first, len(codes)])
    place = np.arange(len(codes)) - np.repeat(first, sizes)
    starts = np.flatnonzero((place == 0) | ((place + shift) % WORD_LIMIT == 0))
    cut = np.repeat(sizes > WORD_LIMIT, sizes)[starts]
    word = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(codes)]))
    return Words(codes, word, starts, doc[starts], cut)


#: A letter for each of the codes 27 to 30.
_OTHER = "".join(chr(0x3B4 + (k - 0x3B4) % 4) for k in range(4))


def _fours(w: Words):
    """(places, code of the four that begins there, weight) for each choice of gaps; code 0 is none."""
    x = w.codes.astype(np.int32)
    for a, b, c in GAPS:
        n = len(x) - c
        if n <= 0:
            continue
        code = (x[:n] << 15) + (x[a : a + n] << 10) + (x[b : b + n] << 5) + x[c:]
        yield n, np.where(w.word[:n] == w.word[c:], code, 0), DECAY ** (c + 1)


def word_scores(w: Words, weights: np.ndarray) -> np.ndarray:
    """The weights' sum over each word's fours, over the word's own length in fours; -inf without fours."""
    if not len(w.codes):
        return np.zeros(0)
    top, own = np.zeros(len(w.codes), np.float32), np.zeros(len(w.codes), np.float32)
    for n, code, decay in _fours(w):
        top[:n] += np.float32(decay) * weights[code]
        own[:n] += np.float32(decay * decay) * (code > 0)
    top, own = np.add.reduceat(top, w.starts), np.add.reduceat(own, w.starts)
    return np.where(own > 0, top / np.sqrt(np.maximum(own, 1e-9)), -np.inf)


def _worst(texts: list[str | None], weights: np.ndarray, top: int = 1) -> np.ndarray:
    """The ``top`` highest word scores of each text, highest first; -inf where there are no more words."""
    out = np.full((len(texts), top), -np.inf)
    begin = 0
    while begin < len(texts):
        end, size = begin, 0
        while end < len(texts) and (end == begin or size + len(texts[end] or "") <= CHUNK):
            size += len(texts[end] or "")
            end += 1
        w = words_of(texts[begin:end])
        scores, doc = word_scores(w, weights), w.doc
        if w.cut.any():
            again = words_of(texts[begin:end], WORD_LIMIT // 2)
            scores, doc = np.r_[scores, word_scores(again, weights)[again.cut]], np.r_[doc, again.doc[again.cut]]
        order = np.lexsort((-scores, doc))
        scores, doc = scores[order], doc[order]
        place = np.arange(len(doc)) - np.searchsorted(doc, doc)
        out[begin + doc[place < top], place[place < top]] = scores[place < top]
        begin = end
    return out


@dataclass(frozen=True)
class Marks:
    """Landmarks as a row of weights for each four that occurs in one; ``row`` is a four's row, 0 for all others."""

    row: np.ndarray
    weight: np.ndarray

    def flat(self, by: np.ndarray) -> np.ndarray:
        """One weight for each four: the rows' products with a weight for each landmark."""
        return (self.weight @ by).astype(np.float32)[self.row]


def _marks(words: list[str]) -> Marks:
    """Rows over the landmark's own length, so that products with another word's fours are kernel values."""
    w = words_of(words)
    at = w.doc[w.word]
    own = np.zeros(len(words))
    for n, code, decay in _fours(w):
        np.add.at(own, at[:n], decay * decay * (code > 0))
    codes = np.unique(np.concatenate([code for _, code, _ in _fours(w)] or [np.zeros(0, np.int32)]))
    codes = codes[codes > 0]
    row = np.zeros(FOURS, np.int32)
    row[codes] = np.arange(1, len(codes) + 1)
    weight = np.zeros((len(codes) + 1, len(words)), np.float32)
    for n, code, decay in _fours(w):
        np.add.at(weight, (row[code], at[:n]), np.float32(decay))
    weight[0] = 0
    return Marks(row, weight / np.sqrt(np.maximum(own, 1e-9)).astype(np.float32))


def _kernel(words: list[str], marks: Marks) -> np.ndarray:
    """Kernel values of words, each of fewer than ``WORD_LIMIT`` letters, with landmarks."""
    return np.vstack([_against(words[k : k + 2000], marks) for k in range(0, len(words), 2000)]) if words else np.zeros((0, marks.weight.shape[1]))


def _against(words: list[str], marks: Marks) -> np.ndarray:
    w = words_of(words)
    out, own = np.zeros((len(words), marks.weight.shape[1])), np.zeros(len(words))
    if not len(w.codes):
        return out
    top = np.zeros((len(w.codes), marks.weight.shape[1]), np.float32)
    length = np.zeros(len(w.codes))
    for n, code, decay in _fours(w):
        top[:n] += np.float32(decay) * marks.weight[marks.row[code]]
        length[:n] += decay * decay * (code > 0)
    out[w.doc], own[w.doc] = np.add.reduceat(top, w.starts), np.add.reduceat(length, w.starts)
    return out / np.sqrt(np.maximum(own, 1e-9))[:, None]


@dataclass(frozen=True)
class Model:
    """Weights of fours, their offset, and the calibration's slopes and level; without weights ``level`` is the score."""

    weights: np.ndarray | None
    offset: float = 0.0
    slopes: tuple[float, ...] = (1.0,) + (0.0,) * (TOP - 1)
    level: float = 0.5

    def raw(self, texts: list[str | None]) -> np.ndarray:
        """The machine's values of the worst words, held to a range in which they tell something."""
        return np.clip(_worst(texts, self.weights, TOP) + self.offset, -2, 3)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.level)
        return 1 / (1 + np.exp(-np.clip(self.raw(texts) @ np.array(self.slopes) + self.level, -30, 30)))


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(code, toxic, clean): in how many documents of each class a four with one gap at most occurs."""
    counts = np.zeros((2, FOURS), np.int32)
    for batch in _slices(batches):
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            w = words_of([text])
            seen = [code for _, code, decay in _fours(w) if decay >= DECAY**5]
            if seen:
                counts[int(label), np.unique(np.concatenate(seen))] += 1
    codes = np.flatnonzero((counts[0] > 0) | (counts[1] > 0))
    yield pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int32)), pa.array(counts[1, codes].astype(np.int64)), pa.array(counts[0, codes].astype(np.int64))], names=["code", "toxic", "clean"])


def _text_of(w: Words, k: int) -> str:
    """A word's letters; those of other scripts as four letters that stand for them."""
    end = w.starts[k + 1] if k + 1 < len(w.starts) else len(w.codes)
    return "".join(chr(96 + c) if c <= 26 else _OTHER[c - 27] for c in w.codes[w.starts[k] : end] if c != START)


def _pick_batches(batches: Iterator[pa.RecordBatch], evidence: np.ndarray, weights: np.ndarray, each: int) -> Iterator[pa.RecordBatch]:
    """The words of a document's worst sentences by evidence; of clean ones also the worst by weights and some drawn by chance."""
    for batch in _slices(batches):
        ids, labels, words = [], [], []
        for doc_id, text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            w = words_of([text])
            s = word_scores(w, evidence)
            order = np.argsort(-s, kind="stable")
            order = order[np.isfinite(s[order])]
            chosen = list(order[:each])
            if not label and len(order):
                chosen += list(order[np.argsort(-word_scores(w, weights)[order], kind="stable")[:each]])
                chosen += list(np.random.default_rng(abs(doc_id)).choice(order, min(each, len(order)), replace=False))
            for k in chosen:
                ids.append(doc_id)
                labels.append(int(label))
                words.append(_text_of(w, k))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, pa.int32()), pa.array(words, pa.string())], names=["doc_id", "label", "word"])


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Squared-hinge machine by Newton steps on the rows inside the margin; y is 1 or -1, the last column is 1."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    before = None
    for step in range(25):
        inside = y * (x @ w) < 1
        if before is not None and np.array_equal(inside, before):
            break
        xs, cs = x[inside], cost[inside][:, None]
        new = np.linalg.solve(xs.T @ (xs * cs) + np.diag(penalty), xs.T @ (cs[:, 0] * y[inside]))
        w, before = new if step < 12 else 0.5 * (w + new), inside
    return w


def _stretched(word: str, rng: np.random.Generator) -> str:
    """The word with a letter put in, as people write to get past filters."""
    at = int(rng.integers(1, len(word)))
    return word[:at] + chr(97 + int(rng.integers(26))) + word[at:]


def _evidence(toxic: np.ndarray, clean: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """How many times more often a four occurs in toxic documents, as a logarithm beyond ``RATIO``.

    Nothing where the difference is within ``CHANCE`` deviations. Fours that are merely usual in a
    language of which there are more toxic documents stay below the ratio.
    """
    share = (toxic + clean + 0.5) / (n1 + n0 + 1)
    z = (toxic / n1 - clean / n0) / np.sqrt(share * (1 - share) * (1 / n1 + 1 / n0))
    odds = np.log((toxic + 0.5) / (n1 + 1)) - np.log((clean + 0.5) / (n0 + 1)) - np.log(RATIO)
    return np.where(z > CHANCE, np.maximum(odds, 0), 0).astype(np.float32)


def _landmarks(positive: pd.DataFrame, negative: list[str]) -> list[str]:
    """Toxic words by evidence, each far from those before; and clean words from all over."""
    by_word = positive.groupby("word")["evidence"].max().sort_values(ascending=False, kind="stable")
    ranked = list(by_word.index[: 6 * LANDMARKS])
    plain = negative[:: max(1, len(negative) // (LANDMARKS // 4))][: LANDMARKS // 4]
    gram = _kernel(ranked, _marks(ranked))
    chosen: list[int] = []
    near = np.zeros(len(ranked))
    while len(chosen) < min(LANDMARKS - len(plain), len(ranked)):
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, gram[chosen[-1]])
        near[chosen[-1]] = np.inf
    return [*(ranked[k] for k in chosen), *plain]


def _machine(positive: pd.DataFrame, negative: list[str]) -> tuple[np.ndarray, float]:
    """Weights of fours and offset from (doc_id, word, evidence) of toxic documents and clean words.

    A document stands by its worst word: by evidence at first, then by the machine before.
    """
    chosen = _landmarks(positive, negative)
    marks = _marks(chosen)
    values, vectors = np.linalg.eigh(_kernel(chosen, marks))
    whiten = vectors[:, values > 1e-4] / np.sqrt(values[values > 1e-4])
    phi_of = lambda some: np.hstack([_kernel(some, marks) @ whiten, np.ones((len(some), 1))])
    words, of = np.unique(positive["word"].to_numpy(str), return_inverse=True)
    bad, good = phi_of(list(words)), phi_of(negative)
    ids, now = positive["doc_id"].to_numpy(), positive["evidence"].to_numpy()
    for _ in range(3):
        order = np.lexsort((now, ids))
        worst = of[order[np.r_[ids[order][1:] != ids[order][:-1], True]]]
        rng = np.random.default_rng(len(worst))
        more = [_stretched(x, rng) for x in words[np.unique(worst)] if 4 <= len(x) < WORD_LIMIT - 2 for _ in range(3)]
        more = phi_of(more) if more else np.zeros((0, bad.shape[1]))
        balance = max(1.0, len(good) / len(worst))
        cost = np.r_[np.full(len(worst), balance), np.full(len(more), balance * len(worst) / max(1, len(more))), np.ones(len(good))]
        w = _svm(np.vstack([bad[worst], more, good]), np.r_[np.ones(len(worst) + len(more)), -np.ones(len(good))], cost)
        now = (bad @ w)[of]
    return marks.flat(whiten @ w[:-1]), float(w[-1])


class Trainer:
    """Rounds of training over (doc_id, text, label) in batches that ``each_pass`` runs over all documents.

    A round looks for what the toxic documents have that the machine so far doesn't explain, takes
    their words of most evidence, and trains on these, the words of rounds before, and the words of
    clean documents that either look worst or are drawn by chance.
    """

    def __init__(self, n1: int, n0: int):
        self.n1, self.n0 = n1, n0
        self.each = int(np.clip(WORDS // (2 * (n1 + n0)), 4, 40))
        self.positive = pd.DataFrame({"doc_id": np.zeros(0, np.int64), "word": np.zeros(0, str), "evidence": np.zeros(0)})
        self.pool = pd.DataFrame({"word": np.zeros(0, str), "toxic": np.zeros(0), "clean": np.zeros(0)})
        self.model = Model(np.zeros(FOURS, np.float32), -1.0)

    def evidence(self, counts: pd.DataFrame, open_docs: int) -> np.ndarray:
        """From (code, toxic, clean): the toxic column of open documents only."""
        table = np.zeros(FOURS, np.float32)
        table[counts["code"]] = _evidence(counts["toxic"].to_numpy(float), counts["clean"].to_numpy(float), open_docs, self.n0)
        table[0] = 0
        return table

    def learn(self, picked: pd.DataFrame, evidence: np.ndarray) -> bool:
        """From (doc_id, label, word) of open toxic documents and of clean ones; False if nothing was found."""
        picked = picked.drop_duplicates(["doc_id", "word"]).assign(evidence=lambda d: _rescored(d["word"], evidence))
        count = picked.groupby(["word", "label"]).size().unstack(fill_value=0).reindex(columns=[1, 0], fill_value=0)
        self.pool = pd.concat([self.pool, pd.DataFrame({"word": count.index, "toxic": count[1].to_numpy(), "clean": count[0].to_numpy()})]).groupby("word", as_index=False).max()
        highest = picked[picked["label"] == 0].groupby("doc_id")["evidence"].max()
        least = max(1e-6, float(highest.quantile(ABOVE)) if len(highest) else 0.0)
        found = picked[(picked["label"] == 1) & (picked["evidence"] > least)]
        self.positive = pd.concat([self.positive, found[["doc_id", "word"]].assign(evidence=found["evidence"] / least)])
        # A word of clean documents counts as toxic only if it is far more usual in toxic ones.
        pool = self.pool
        rarely = (pool["clean"] > 0) & ((pool["toxic"] < 3) | (pool["toxic"] / self.n1 < 2 * RATIO * pool["clean"] / self.n0))
        negative = sorted(pool["word"][rarely])
        self.positive = self.positive[~self.positive["word"].isin(set(negative))].sort_values(["doc_id", "word"])
        if not len(found) or not len(self.positive) or not negative:
            return False
        self.model = Model(*_machine(self.positive, negative))
        return True


def _rescored(words, weights: np.ndarray) -> np.ndarray:
    found = _worst(list(words), weights)[:, 0]
    return np.where(np.isfinite(found), found, -3.0)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            yield batch.slice(k, ROWS)


def _raw_batches(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.raw(batch.column(1).to_pylist()).tolist(), pa.list_(pa.float64()))], names=["label", "raw"])


def _calibrated(raw: np.ndarray, label: np.ndarray, share: float) -> tuple[tuple[float, ...], float]:
    """Slopes and level of a logistic fit; targets stay off 0 and 1 as far as the counts ask for.

    ``share`` is the toxic part of all labelled documents, of which the sample may hold more.
    """
    n1, n0 = label.sum(), (1 - label).sum()
    target = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(label == 1, share / max(n1, 1), (1 - share) / max(n0, 1)) * len(label)
    theta = np.zeros(raw.shape[1] + 1)
    x = np.c_[raw, np.ones(len(raw))]
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        ridge = np.r_[0.1, np.full(raw.shape[1] - 1, 5.0), 1e-3]
        g = x.T @ (weight * (p - target)) + ridge * theta
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.clip(np.linalg.solve(h, g), -1, 1)
        theta = theta - step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(map(float, theta[:-1])), float(theta[-1])


def counts_of(docs: DataFrame) -> pd.DataFrame:
    """(code, toxic, clean): documents of each class that hold a four; at most one row for each of ``FOURS``."""
    counts = docs.select("text", "label").mapInArrow(_count_batches, "code int, toxic long, clean long")
    return counts.groupBy("code").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where(F.col("toxic") + F.col("clean") > 1).toPandas()


def _open_batches(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """Documents that the machine doesn't find toxic."""
    for batch in _slices(batches):
        if batch.num_rows:
            left = model.raw(batch.column(1).to_pylist())[:, 0] < 0
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(left))], names=["doc_id"])


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """A model from (doc_id, text) and (doc_id, label 0 or 1); held-out ids must be gone from the labels."""
    known = labels.where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    known = stored(known, "toxic-labels")
    totals = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not totals.get(0) or not totals.get(1):
        return Model(None, level=float(sum(k * n for k, n in totals.items())) / sum(totals.values()) if totals else 0.5)
    share = F.when(F.col("label") == 1, F.lit(int(min(1.0, train_docs / totals[1]) * (1 << 30)))).otherwise(F.lit(int(min(1.0, train_docs / totals[0]) * (1 << 30))))
    chosen = stored(known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share), "toxic-chosen")
    # At most about 2 * train_docs ids, which every task may hold.
    sample = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", F.col("label").cast("int").alias("label"))
    sample = stored(sample.withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(4))), "toxic-sample").repartition(24)
    learn, check = sample.where("fold > 0"), sample.where("fold = 0")
    n1, n0 = (learn.where(f"label = {k}").count() for k in (1, 0))
    if not n1 or not n0:
        return Model(None, level=n1 / (n1 + n0) if n1 + n0 else 0.5)
    trainer, open_docs, open_count = Trainer(n1, n0), learn.where("label = 1"), n1
    clean = counts_of(learn.where("label = 0"))[["code", "clean"]]
    models = []
    for round_ in range(ROUNDS):
        counts = counts_of(open_docs)[["code", "toxic"]].merge(clean, on="code", how="outer").fillna(0)
        evidence = trainer.evidence(counts, open_count)
        both = open_docs.unionByName(learn.where("label = 0")).select("doc_id", "text", "label")
        picked = both.mapInArrow(functools.partial(_pick_batches, evidence=evidence, weights=trainer.model.weights, each=trainer.each), "doc_id long, label int, word string").toPandas()
        if not trainer.learn(picked, evidence):
            break
        models.append(trainer.model)
        left = learn.where("label = 1").select("doc_id", "text").mapInArrow(functools.partial(_open_batches, model=trainer.model), "doc_id long")
        left = stored(left, "toxic-open")
        open_count = left.count()
        # Clean words that the first machine gets wrong are mined once, even if it explains all toxic documents.
        if open_count < LEAST_OPEN and round_:
            break
        if open_count >= LEAST_OPEN:
            open_docs = learn.join(F.broadcast(left), "doc_id", "left_semi")
        else:
            open_docs, open_count = learn.where("label = 1"), n1
    return _best(check if check.where("label = 1").count() and check.where("label = 0").count() else sample, models or [trainer.model], totals[1] / (totals[0] + totals[1]))


def _best(docs: DataFrame, models: list[Model], share: float) -> Model:
    """The round whose calibrated scores fit documents best that it was not trained on."""
    found = []
    for model in models:
        raw = docs.select("label", "text").mapInArrow(functools.partial(_raw_batches, model=model), "label int, raw array<double>").toPandas()
        values, label = np.array(raw["raw"].tolist()), raw["label"].to_numpy()
        slopes, level = _calibrated(values, label, share)
        chance = 1 / (1 + np.exp(-np.clip(values @ np.array(slopes) + level, -30, 30)))
        loss = -np.where(label == 1, share * np.log(chance) / (label == 1).mean(), (1 - share) * np.log1p(-chance) / (label == 0).mean()).mean()
        found.append((loss, len(found), Model(model.weights, model.offset, slopes, level)))
    return min(found, key=lambda x: x[:2])[2]


def _score_batches(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(batch.column(1).to_pylist()))], names=["key", "score"])


def score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", train_docs: int = TRAIN_DOCS) -> DataFrame:
    """(doc_id, held_out, score) of each document, learned from the labels of ids that are not held out."""
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    known = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).alias("label")).where(~held_out("doc_id"))
    model = fit(own, known, train_docs)
    scored = own.mapInArrow(functools.partial(_score_batches, model=model), "doc_id long, score double")
    return scored.select(F.col("doc_id").alias(doc_id), held_out("doc_id").alias("held_out"), "score")


def reject(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", threshold: float = 0.5) -> DataFrame:
    """The documents that score below the threshold, with all columns."""
    columns = docs.columns
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    known = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).alias("label")).where(~held_out("doc_id"))
    model = fit(own, known)
    plain = docs.toDF(*(f"c{k}" for k in range(len(columns))))
    kept = plain.mapInArrow(functools.partial(_keep_batches, model=model, at=columns.index(text), threshold=threshold), plain.schema)
    return kept.toDF(*columns)


def _keep_batches(batches: Iterator[pa.RecordBatch], model: Model, at: int, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        if batch.num_rows:
            yield batch.filter(pa.array(model.scores(batch.column(at).to_pylist()) < threshold))
