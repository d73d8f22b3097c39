"""Toxicity by a support vector machine over a subsequence string kernel.

Kernel: two strings are alike as far as they share subsequences of three characters,
each occurrence weighted by ``DECAY`` to the length it spans, spans of at most ``SPAN``
characters. So letters put in between, or left out, lower the likeness without ending
it. Strings are words with an edge mark at both ends; kernel values are normalised.

Nyström: likeness to a few landmark words, whitened by the landmarks' own kernel, stands
for the kernel. The machine is linear over it, so its weights fold into one table from
subsequence to weight, and a word costs a few look-ups. A sentence scores as its worst
word; a document's probability comes from its worst sentences, by a logistic curve.

Training: labels belong to documents, so sentences of toxic documents are labelled by
their worst word alone (multiple-instance learning): that word is picked by its
association with the label first and by the machine itself in later turns, while every
word of clean sentences is a counterexample. Fitted on a bounded sample: at most
``MAX_TOXIC`` and ``MAX_CLEAN`` labelled rows with texts of at most ``MAX_FIT_BYTES``,
the first in hash order; that is what comes to the driver. Scoring reads whole texts.

Defined results: a null or empty text scores as a text without any suspicious word;
a null or missing label is no label; several labels of one id are toxic if one is; no
usable label of one of both kinds gives every row the share of toxic labels (0 if there
are none); repeated rows repeat; extra columns stay.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from labelwright.llm.common import free_name, give_back, small_slices

DECAY = 0.8
SPAN = 7
LENGTH = 24
MAX_TOXIC = 1500
MAX_CLEAN = 2500
MAX_FIT_BYTES = 32_000
LANDMARKS = (40, 24)
MIN_EVIDENCE = 8.0
TURNS = 3
TOP = 3
#: Bytes of word scores that a task remembers; each costs ``ENTRY`` beyond its word.
MEMORY = 32 << 20
ENTRY = 120
SLICE_BYTES = 2 << 20

_STEPS = [(b, c) for b, c in combinations(range(1, SPAN), 2)]
_JUNK = re.compile(r"[\W\d_]+")


def words_of(text: str) -> list[str]:
    return [w.decode() for w in text.lower().encode().split()]


def forms(word: str) -> list[str]:
    """The strings compared for a word: with its marks, and its letters alone.

    Long words are cut into overlapping strings, so nothing of them is left out.
    """
    trimmed = word.strip(".,;:!?\"'()[]{}<>|*#$%&-_")
    letters = _JUNK.sub("", word)
    out = []
    for form in dict.fromkeys((trimmed, letters)):
        if len(form) >= 3:
            marked = f"^{form}$"
            last = max(len(marked) - LENGTH, 0)
            out += [marked[a : a + LENGTH] for a in [*range(0, last, LENGTH // 2), last]]
    return out


def _matrix(strings: list[str]) -> np.ndarray:
    """Code points, one row per string, 0 after its end."""
    wide = max(map(len, strings), default=1)
    packed = np.array(strings, dtype=f"<U{wide}")
    return packed.view(np.uint32).reshape(len(strings), wide)


def _triples(codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """For each pair of steps, the three characters at every place, and the span."""
    wide = codes.shape[1]
    for b, c in _STEPS:
        if c < wide:
            yield codes[:, : wide - c], codes[:, b : wide - c + b], codes[:, c:], c + 1


def feature_map(string: str) -> dict[str, float]:
    out: dict[str, float] = defaultdict(float)
    for a in range(len(string)):
        for b, c in _STEPS:
            if a + c < len(string):
                out[string[a] + string[a + b] + string[a + c]] += DECAY ** (c + 1)
    return dict(out)


def kernel(a: str, b: str) -> float:
    """Normalised kernel of two strings, by explicit features."""
    x, y = feature_map(a), feature_map(b)
    norm = sum(v * v for v in x.values()) * sum(v * v for v in y.values())
    return sum(v * y[k] for k, v in x.items() if k in y) / norm**0.5 if norm else 0.0


def self_kernels(codes: np.ndarray) -> np.ndarray:
    """Kernel of each row with itself."""
    rows = len(codes)
    keys, spans = [], []
    for x, y, z, span in _triples(codes):
        key = (x.astype(np.int64) << 42) | (y.astype(np.int64) << 21) | z
        # Places past the end of a string get a key of weight 0.
        keys.append(np.where(z > 0, key, -1))
        spans.append(np.full(z.shape[1], span))
    if not keys:
        return np.zeros(rows)
    spans = np.concatenate(spans)
    flat = np.concatenate(keys, axis=1)
    order = np.argsort(flat, axis=1)
    flat = np.take_along_axis(flat, order, axis=1)
    weight = DECAY ** spans[order].astype(np.float64)
    weight[flat < 0] = 0.0
    start = np.ones(flat.shape, bool)
    start[:, 1:] = flat[:, 1:] != flat[:, :-1]
    sums = np.add.reduceat(weight.ravel(), np.flatnonzero(start.ravel()))
    row = np.repeat(np.arange(rows), start.sum(axis=1))
    return np.bincount(row, sums * sums, minlength=rows)


@dataclass
class Scorer:
    """A weighted sum of normalised kernels to landmarks, as tables over subsequences."""

    alphabet: np.ndarray  # code point to place in the tables, 0 for strangers
    tables: np.ndarray  # (columns, letters**3)
    letters: int

    @classmethod
    def of(cls, landmarks: list[str], weights: np.ndarray) -> "Scorer":
        """``weights``: one row per landmark, one column per output."""
        chars = sorted({c for s in landmarks for c in s})
        alphabet = np.zeros(max(map(ord, chars), default=0) + 2, np.int64)
        for place, char in enumerate(chars, 1):
            alphabet[ord(char)] = place
        letters = len(chars) + 1
        tables = np.zeros((weights.shape[1], letters**3))
        for string, row in zip(landmarks, weights):
            features = feature_map(string)
            norm = sum(v * v for v in features.values()) ** 0.5
            for triple, value in features.items():
                x, y, z = (alphabet[ord(c)] for c in triple)
                tables[:, (x * letters + y) * letters + z] += row * value / norm
        return cls(alphabet, tables, letters)

    def __call__(self, strings: list[str], block: int = 4096) -> np.ndarray:
        """(strings, columns)"""
        out = np.zeros((len(strings), len(self.tables)))
        order = sorted(range(len(strings)), key=lambda i: len(strings[i]))
        for a in range(0, len(order), block):
            chosen = order[a : a + block]
            codes = _matrix([strings[i] for i in chosen])
            norm = np.sqrt(self_kernels(codes))
            norm[norm == 0] = 1.0
            known = self.alphabet[np.minimum(codes, len(self.alphabet) - 1)]
            total = np.zeros((len(chosen), len(self.tables)))
            for x, y, z, span in _triples(known):
                at = np.where((x > 0) & (y > 0) & (z > 0), (x * self.letters + y) * self.letters + z, 0)
                for column, values in enumerate(self.tables):
                    total[:, column] += values[at].sum(axis=1) * DECAY**span
            out[chosen] = total / norm[:, None]
        return out


@dataclass
class Model:
    scorer: Scorer | None
    bias: float
    curve: np.ndarray  # of the document's features, intercept last
    share: float

    def word_scores(self, words: list[str]) -> np.ndarray:
        """The machine's value of each word: that of its worst form."""
        strings, owner = [], []
        for i, word in enumerate(words):
            for form in forms(word):
                strings.append(form)
                owner.append(i)
        out = np.full(len(words), self.bias)
        if strings:
            np.maximum.at(out, np.array(owner), self.scorer(strings)[:, 0] + self.bias)
        return out

    def probabilities(self, features: np.ndarray) -> np.ndarray:
        if self.scorer is None:
            return np.full(len(features), self.share)
        value = features @ self.curve[:-1] + self.curve[-1]
        return 1 / (1 + np.exp(-np.clip(value, -500, 500)))


def _joined_singles(words: np.ndarray, single: np.ndarray, ends: np.ndarray) -> list[tuple[int, str]]:
    """Runs of three or more one-letter words of a text, read as one word: (place, word)."""
    flag = single.astype(np.int8)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flag, [0]])))
    cuts = set(ends.tolist())
    out = []
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        start = a
        for i in range(a + 1, b + 1):
            if i == b or i in cuts:
                if i - start >= 3:
                    out.append((start, "".join(words[start:i])))
                start = i
    return out


def document_features(texts: pa.Array, score, singles: bool = True) -> np.ndarray:
    """Per text: its TOP worst sentences, how many sentences are suspicious, all by ``score``.

    ``score`` takes a list of distinct words. A sentence ends with . ! or ?
    """
    lowered = pc.ascii_lower(pc.fill_null(texts, ""))
    lists = pc.ascii_split_whitespace(lowered)
    flat = pc.list_flatten(lists)
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(texts)), counts)
    coded = flat.dictionary_encode()
    words = coded.dictionary.to_pylist()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    none = score([])[1]
    features = np.tile(np.array([none] * TOP + [0.0]), (len(texts), 1))
    if not len(code):
        return features
    value = score(words)[0][code]
    short = np.array([len(w) == 1 and w.isalpha() for w in words])[code]
    if short.any():
        names = np.array(words, dtype=object)[code]
        runs = _joined_singles(names, short, np.cumsum(counts))
        if runs:
            worth = score([w for _, w in runs])[0]
            np.maximum.at(value, np.array([a for a, _ in runs]), worth)
    closes = np.array([w[-1:] in ".!?" for w in words])[code]
    fresh = np.concatenate([[True], closes[:-1] | (owner[1:] != owner[:-1])])
    starts = np.flatnonzero(fresh)
    worst = np.maximum.reduceat(value, starts)
    of = owner[starts]
    order = np.lexsort((-worst, of))
    worst, of = worst[order], of[order]
    place = np.arange(len(of)) - np.searchsorted(of, of)
    top = place < TOP
    features[of[top], place[top]] = worst[top]
    features[:, TOP] = np.log1p(np.bincount(of, worst > 0, minlength=len(texts)))
    return features


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float) -> np.ndarray:
    """Linear machine with squared hinge loss, by Newton steps; intercept last, unpenalised."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(50):
        margin = 1 - y * (x @ w)
        active = margin > 0
        a, wa = x[active], weight[active]
        step = np.linalg.solve(
            (a * wa[:, None]).T @ a + np.diag(ridge), ridge * w - a.T @ (wa * y[active] * margin[active])
        )
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    return w


def _curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-2) -> np.ndarray:
    """Logistic regression by Newton steps; intercept last."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = weight * np.maximum(p * (1 - p), 1e-9)
        step = np.linalg.solve((x * h[:, None]).T @ x + np.diag(ridge), x.T @ (weight * (p - y)) + ridge * w)
        size = np.abs(step).max()
        w -= step * min(1.0, 5.0 / max(size, 1e-12))
        if size < 1e-8:
            break
    return w


def _evidence(t: np.ndarray, c: np.ndarray, toxic: int, clean: int) -> np.ndarray:
    """Log-likelihood ratio of a word's document counts, signed by its direction."""
    n = toxic + clean

    def term(k, total, share):
        share = np.clip(share, 1e-12, 1 - 1e-12)
        return k * np.log(share) + (total - k) * np.log(1 - share)

    both = (t + c) / n
    g = 2 * (term(t, toxic, t / toxic) + term(c, clean, c / clean)
             - term(t, toxic, both) - term(c, clean, both))
    return np.where(t / toxic > c / clean, g, -g)


def fit(texts: list[str], labels: np.ndarray, share: float) -> Model:
    """A model from a sample of texts with labels; ``share``: toxic ones among all labels."""
    toxic, clean = int(labels.sum()), int(len(labels) - labels.sum())
    if not toxic or not clean:
        return Model(None, 0.0, np.zeros(1), share)
    units = [list(dict.fromkeys(f for w in set(words_of(t)) for f in forms(w))) for t in texts]
    seen = (Counter(), Counter())
    for label, own in zip(labels, units):
        seen[int(label)].update(own)
    names = sorted(seen[1])
    g = dict(zip(names, _evidence(
        np.array([seen[1][n] for n in names]), np.array([seen[0][n] for n in names]), toxic, clean
    )))

    def spread(candidates: list[str], most: int) -> list[str]:
        chosen: list[str] = []
        for name in candidates:
            if len(chosen) == most:
                break
            if all(kernel(name, other) < 0.8 for other in chosen):
                chosen.append(name)
        return chosen

    ranked = sorted((n for n in names if g[n] >= MIN_EVIDENCE), key=lambda n: (-g[n], n))
    if not ranked:
        ranked = sorted(names, key=lambda n: (-g[n], n))[: LANDMARKS[0]]
    common = sorted(seen[0], key=lambda n: (-seen[0][n], n))[:400]
    landmarks = spread(ranked[:400], LANDMARKS[0]) + spread(common, LANDMARKS[1])
    landmarks = list(dict.fromkeys(landmarks))
    own = np.array([[kernel(a, b) for b in landmarks] for a in landmarks])
    values, vectors = np.linalg.eigh(own)
    keep = values > 1e-6
    whiten = vectors[:, keep] / np.sqrt(values[keep])
    measure = Scorer.of(landmarks, np.eye(len(landmarks)))

    # Witness candidates of toxic documents, and counterexamples: words of clean documents
    # that look most like a suspicious landmark, and as many others in hash order.
    candidates = [sorted(u, key=lambda n: (-g.get(n, 0), n))[:20] for u, y in zip(units, labels) if y]
    pool = sorted(seen[0])
    near = Scorer.of(ranked[: LANDMARKS[0]], np.ones((len(ranked[: LANDMARKS[0]]), 1)))(pool)[:, 0]
    hard = [pool[i] for i in np.argsort(-near, kind="stable")[:4000]]
    other = sorted(pool, key=lambda n: (hash_of(n), n))[:4000]
    negative = list(dict.fromkeys([*hard, *other]))
    needed = list(dict.fromkeys([*negative, *(n for c in candidates for n in c)]))
    where = {n: i for i, n in enumerate(needed)}
    x = measure(needed) @ whiten
    xn = x[[where[n] for n in negative]]
    wn = np.array([min(seen[0][n], 20) for n in negative], float)
    picked = [[n for n in c if g[n] >= MIN_EVIDENCE and seen[0][n] * toxic * 3 < seen[1][n] * clean][:3]
              for c in candidates]
    machine = None
    for _ in range(TURNS):
        if machine is not None:
            picked = []
            for c in candidates:
                f = x[[where[n] for n in c]] @ machine[:-1] + machine[-1] if c else np.zeros(0)
                best = np.argsort(-f, kind="stable")[:2]
                picked.append([c[i] for i in best if f[i] > -0.5 and g[c[i]] > 2])
        positive = Counter(n for p in picked for n in p)
        if not positive:
            positive = Counter(n for c in candidates for n in c[:1])
        if not positive:
            return Model(None, 0.0, np.zeros(1), share)
        xp = x[[where[n] for n in positive]]
        wp = np.array([float(k) for k in positive.values()])
        machine = _machine(
            np.vstack([xp, xn]),
            np.concatenate([np.ones(len(xp)), -np.ones(len(xn))]),
            np.concatenate([wp / wp.sum(), 2 * wn / wn.sum()]) * 1000,
            1.0,
        )
    model = Model(
        Scorer.of(landmarks, (whiten @ machine[:-1])[:, None]), float(machine[-1]), np.zeros(1), share
    )
    seen_words = Memory(model)
    features = np.vstack([
        document_features(pa.array(texts[a : a + 500], pa.string()), seen_words)
        for a in range(0, len(texts), 500)
    ])
    weight = np.where(labels == 1, share / toxic, (1 - share) / clean) * len(texts)
    model.curve = _curve(features, labels.astype(float), weight)
    return model


def hash_of(name: str) -> int:
    """A fixed order without meaning (FNV-1a)."""
    value = 0xCBF29CE484222325
    for byte in name.encode():
        value = ((value ^ byte) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return value


class Memory:
    """Word scores that a task has worked out already; emptied when they exceed ``most`` bytes."""

    def __init__(self, model: Model, most: int = MEMORY):
        self.model, self.most, self.known, self.held = model, most, {}, 0

    def __call__(self, words: list[str]) -> tuple[np.ndarray, float]:
        known = self.known
        fresh = [w for w in dict.fromkeys(words) if w not in known]
        cost = sum(map(len, fresh)) + ENTRY * len(fresh)
        if self.held + cost > self.most:
            known.clear()
            fresh = list(dict.fromkeys(words))
            self.held, cost = 0, sum(map(len, fresh)) + ENTRY * len(fresh)
        self.held += cost
        known.update(zip(fresh, self.model.word_scores(fresh).tolist()))
        return np.array([known[w] for w in words]), self.model.bias


def train(
    docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id",
    text_col: str = "text", label_col: str = "toxic",
) -> Model:
    """A model from the labelled rows for which ``learn`` (over ``id_col``) holds."""
    marked = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & learn)
        .groupBy(id_col).agg(F.max(F.col(label_col).cast("int")).alias("_toxic"))
    )
    counts = {int(r[0]): r[1] for r in marked.groupBy("_toxic").count().collect()}
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.0
    texts = docs.select(id_col, text_col).where(
        F.col(text_col).isNotNull() & (F.octet_length(text_col) <= MAX_FIT_BYTES)
    )
    drawn = None
    for label, most in ((1, MAX_TOXIC), (0, MAX_CLEAN)):
        ids = (
            marked.where(F.col("_toxic") == label)
            .orderBy(F.xxhash64(F.lit("tox"), id_col), id_col).limit(most)
        )
        drawn = ids if drawn is None else drawn.unionByName(ids)
    # Of rows that repeat an id, the least text: one row an id comes to the driver.
    rows = (
        texts.join(F.broadcast(drawn), id_col).groupBy("_toxic", id_col)
        .agg(F.min(text_col).alias(text_col)).toPandas()
    )
    rows = rows.sort_values([id_col, text_col])
    return fit(rows[text_col].tolist(), rows["_toxic"].to_numpy(), share)


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the probability that a text is toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType(
        [*[f for f in docs.schema.fields if f.name.lower() != out.lower()],
         StructField(out, DoubleType(), True)]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Memory(shared.value)
        for part in small_slices(batches, text_col, SLICE_BYTES):
            texts = part.column(text_col)
            if shared.value.scorer is None:
                values = np.full(len(texts), shared.value.share)
            else:
                values = shared.value.probabilities(document_features(texts, memory))
            kept = [i for i, n in enumerate(part.schema.names) if n.lower() != out.lower()]
            yield pa.RecordBatch.from_arrays(
                [*[part.column(i) for i in kept], pa.array(values)],
                [*[part.schema.names[i] for i in kept], out],
            )
        del memory
        give_back()

    return docs.mapInArrow(run, schema)


def without_toxic(
    docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text"
) -> DataFrame:
    """The rows that score below ``threshold``."""
    name = free_name(docs.columns, "_toxicity")
    return score(docs, model, text_col, name).where(F.col(name) < threshold).drop(name)
