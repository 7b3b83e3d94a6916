"""Toxicity by a subsequence string kernel, Nyström landmarks and a linear SVM.

The kernel of two strings sums, over their common subsequences of three
characters spread over at most SPAN positions, DECAY to the power of both
spreads, over the root of what each string would have with itself if no
subsequence came twice in it: 1 for most equal strings. Gapped, lengthened and
misspelt words therefore stay near the word meant, and a stem near all its
forms. Subsequences with bounded spread are few enough to be listed, so the
kernel is an inner product of sparse vectors and needs no dynamic programme.

A unit is a word of a sentence without its marks, or single characters in a row
("i d i o t") joined, between < and >, so that beginnings and ends count. Landmarks are strings of labelled sentences: stretches
that toxic documents have more often, and clean ones less, than
chance explains it, and clean words that are likest to those. Kernel values to the
landmarks, whitened by the landmarks' own kernel matrix (Nyström), are the
features of a unit. A label is known of a document, not of a sentence, so the
SVM learns from the most suspicious sentences of each document. A text's score
is a logistic function of its TOP largest unit margins: one plain insult is
enough, and so are several words each of which clean texts have now and then.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold_of, read_table, stage, text_of

SPAN, DECAY, WIDTH = 6, 0.6, 24
#: Bounds of the training sample, in documents.
MOST_TOXIC, MOST_CLEAN = 1500, 6000
MOST_STRETCHES, MOST_LANDMARKS, CLEAN_LANDMARKS = 60_000, 96, 48
#: A stretch is a landmark if chance would give it so many toxic documents less often than this.
CHANCE = 1e-5
THRESHOLD = 0.5
CACHE_UNITS = 60_000
#: Largest margins of a text's units that its score rests on, and the margin below which a unit says nothing.
TOP, NOTHING = 4, -1.0
#: Rounds in which the SVM is fitted anew with the clean units that it got wrong.
MINING = 3
#: Units that a toxic document, a clean one, and a clean one in a round of mining give the SVM at most.
PER_TOXIC, PER_CLEAN, PER_MINED = 8, 4, 3
_PATTERNS = [(a, b) for a, b in combinations(range(1, SPAN), 2)]
_MARKS = re.compile(r"[\W_]+")
_SPELT = re.compile(r"(?<!\S)(?:\S[ \t]+){2,}\S(?!\S)")
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def sentences(text: str) -> list[str]:
    return [s for s in re.split(r"(?<=[.!?])\s+|\n+", text) if s.strip()]


def units_of(token: str) -> list[str]:
    """The strings that a token stands for: without marks; overlapping pieces of a very long one."""
    word = _MARKS.sub("", token)
    if len(word) <= 2:
        return []
    word = f"<{word}>"
    if len(word) <= WIDTH:
        return [word]
    return [word[i : i + WIDTH] for i in range(0, len(word) - WIDTH // 2, WIDTH // 2)]


def tokens(text: str) -> set[str]:
    low = text.lower()
    found = set(low.split())
    for m in _SPELT.finditer(low):
        found.add("".join(m[0].split()))
    return found


def _scale(length: int) -> float:
    """One over the root of the squared weights of all subsequences of a string of that length."""
    total = sum(max(0, length - b) * DECAY ** (2 * (b + 1)) for _, b in _PATTERNS)
    return 1 / np.sqrt(total) if total else 0.0


_SCALES = np.array([_scale(n) for n in range(WIDTH + 1)])


def _slices(units: list[str], rows: int = 4096):
    """Row numbers, codes and weights of the subsequences of units of one length, some units at a time."""
    sizes = np.fromiter(map(len, units), np.int64, len(units))
    for n in np.unique(sizes).tolist():
        every = np.flatnonzero(sizes == n)
        for at in range(0, len(every) if n > 2 else 0, rows):
            take = every[at : at + rows]
            chars = np.frombuffer("".join([units[i] for i in take.tolist()]).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(take), n).astype(np.uint64)
            codes, weights = [], []
            for a, b in _PATTERNS:
                if b < n:
                    code = (chars[:, : n - b] * _A + chars[:, a : n - b + a]) * _B + chars[:, b:]
                    codes.append((code ^ (code >> np.uint64(29))) * _A)
                    weights += [DECAY ** (b + 1) * _SCALES[n]] * (n - b)
            yield take, np.concatenate(codes, 1), np.array(weights, np.float32)


class Landmarks:
    """Kernel values of units to a fixed list of strings."""

    def __init__(self, strings: list[str]):
        self.strings = strings
        got = [(np.repeat(take, codes.shape[1]), codes.ravel(), np.tile(w, len(take))) for take, codes, w in _slices(strings)]
        row, code, value = map(np.concatenate, zip(*got))
        self.codes, at = np.unique(code, return_inverse=True)
        self.matrix = np.zeros((len(self.codes), len(strings)), np.float32)
        np.add.at(self.matrix, (at, row), value)
        self.seen = np.zeros(1 << 17, bool)  # a first look, which few codes of other words pass
        self.seen[self.codes >> np.uint64(47)] = True

    def _hits(self, units: list[str]):
        """Rows, places among the known codes, and weights of the subsequences that a landmark has."""
        for take, codes, w in _slices(units):
            r, col = np.nonzero(self.seen[codes >> np.uint64(47)])
            code = codes[r, col]
            place = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            hit = self.codes[place] == code
            yield take[r[hit]], place[hit], w[col[hit]]

    def kernel(self, units: list[str]) -> np.ndarray:
        out = np.zeros((len(units), len(self.strings)), np.float32)
        for row, place, w in self._hits(units):
            if len(row):
                cut = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                out[row[cut]] = np.add.reduceat(self.matrix[place] * w[:, None], cut, axis=0)
        return out

    def weighted(self, units: list[str], weights: np.ndarray) -> np.ndarray:
        """The kernel times a vector, without the kernel: each code counts with its own sum."""
        of_code, out = self.matrix.astype(np.float64) @ weights, np.zeros(len(units))
        for row, place, w in self._hits(units):
            out += np.bincount(row, of_code[place] * w, len(units))
        return out


class Model:
    """Nyström features, a linear SVM on them, and a logistic curve over the largest margin of a text."""

    def __init__(self, landmarks: Landmarks, positive: np.ndarray, negative: np.ndarray, rounds: int = 60, decay: float = 1e-4):
        self.landmarks = landmarks
        values, basis = np.linalg.eigh(landmarks.kernel(landmarks.strings).astype(np.float64))
        self.whiten = basis / np.sqrt(np.maximum(values, 0.05))
        x = np.r_[positive, negative] @ self.whiten
        x = np.c_[x, np.ones(len(x))]
        y = np.r_[np.ones(len(positive)), -np.ones(len(negative))]
        weight = np.where(y > 0, 0.4 / max(1, len(positive)), 0.6 / max(1, len(negative)))  # a clean text rejected costs more
        w = np.zeros(x.shape[1])
        for _ in range(rounds):  # Newton steps on the squared hinge loss: each solves for the rows inside the margin
            inside = y * (x @ w) < 1
            part, c = x[inside], weight[inside]
            new = np.linalg.solve((part.T * c) @ part + decay * np.eye(len(w)), part.T @ (c * y[inside]))
            if np.allclose(new, w):
                break
            w = 0.5 * (w + new)
        self.w = w
        self.curve = np.zeros(TOP + 1)
        self.forget()

    def forget(self) -> None:
        """Drops what is remembered of tokens, so that a worker carries nothing from one task to the next."""
        self.known: dict[str, tuple | None] = {}
        self.older: dict[str, tuple | None] = {}

    def fit_curve(self, tops: np.ndarray, toxic: np.ndarray) -> None:
        """Weights, none negative, that make the largest margins of documents a probability, with the classes as frequent as they are."""
        x, w = np.c_[tops - NOTHING, np.ones(len(tops))], np.zeros(TOP + 1)
        free = np.ones(TOP + 1, bool)
        for _ in range(200):  # damped Newton steps on the log loss, slightly regularised; a weight that falls below zero leaves
            p = 0.5 * (1 + np.tanh(0.5 * (x @ w)))
            part = x[:, free]
            h = (part.T * (p * (1 - p))) @ part + 1e-1 * np.eye(free.sum())
            w[free] -= np.clip(np.linalg.solve(h, part.T @ (p - toxic) + 1e-1 * w[free]), -0.5, 0.5)
            free[:-1] &= w[:-1] >= 0
            w[~free] = 0
        self.curve = w

    def margins(self, kernel: np.ndarray) -> np.ndarray:
        return (kernel.astype(np.float64) @ self.whiten) @ self.w[:-1] + self.w[-1]

    def probability(self, tops: np.ndarray) -> np.ndarray:
        return 0.5 * (1 + np.tanh(0.5 * ((tops - NOTHING) @ self.curve[:-1] + self.curve[-1])))

    def tops(self, texts: list[str]) -> np.ndarray:
        """Of each text the TOP largest margins of distinct units, NOTHING where there are fewer."""
        bags = [tokens(t) for t in texts]
        if len(self.known) > CACHE_UNITS:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        new = set().union(*bags).difference(known)
        for t in new & older.keys():
            known[t] = older[t]
        new = list(new.difference(known))
        units = [units_of(t) for t in new]
        flat = sorted({u for us in units for u in us})
        m = (self.landmarks.weighted(flat, self.whiten @ self.w[:-1]) + self.w[-1]).tolist() if flat else []
        got = dict(zip(flat, m))
        for t, us in zip(new, units):
            best = max(((got[u], u) for u in us), default=(NOTHING, ""))
            known[t] = best if best[0] > NOTHING else None
        out = np.full((len(texts), TOP), NOTHING)
        for i, bag in enumerate(bags):
            best = sorted({x for t in bag if (x := known[t]) is not None}, reverse=True)[:TOP]
            out[i, : len(best)] = [x for x, _ in best]
        return out

    def of_texts(self, texts: list[str]) -> list[float]:
        """Score of each text; without units, 0."""
        tops = self.tops(texts)
        return np.where(tops[:, 0] > NOTHING, self.probability(tops), 0.0).tolist()


def _bag(text: str) -> set[str]:
    return {u for t in tokens(text) for u in units_of(t)}


def _stretches(text: str) -> set[str]:
    return {u[i : i + n] for u in _bag(text) for n in range(5, 11) for i in range(len(u) - n + 1)}


def _count(df: DataFrame, wanted=None) -> DataFrame:
    """Rows (stretch, n): in how many texts it occurs."""

    counted = lambda c: pa.RecordBatch.from_arrays([pa.array(list(c.keys()), pa.string()), pa.array(list(c.values()), pa.int64())], ["s", "n"])

    def run(batches):
        for b in batches:
            c: Counter = Counter()
            for t in b.column("text").to_pylist():
                s = _stretches(t)
                c.update(s if wanted is None else s & wanted.value)
                if len(c) > 200_000:
                    yield counted(c)
                    c.clear()
            yield counted(c)

    return df.select("text").mapInArrow(run, "s string, n long").groupBy("s").agg(F.sum("n").alias("n"))


def _least(text: str, n: int = 24) -> list[int]:
    words = text.encode().split()
    runs = {b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))}
    return sorted(xxhash.xxh64_intdigest(r) >> 1 for r in runs)[:n]


def _unlike(sample: DataFrame) -> set:
    """Ids of the sample's texts, one of each set of near copies: texts that share half of the 24 least hashes of their four-word runs are one."""

    def run(batches):
        for b in batches:
            least = [_least(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(least, pa.list_(pa.int64()))], ["doc_id", "h"])

    met: dict[int, list] = {}
    stay = set()
    for r in sorted(sample.select("doc_id", "text").mapInArrow(run, f"doc_id {sample.schema['doc_id'].dataType.simpleString()}, h array<long>").collect()):  # bounded as the sample is
        alike = Counter(i for h in r.h for i in met.get(h, ()))
        if max(alike.values(), default=0) * 2 < len(r.h):
            stay.add(r.doc_id)
            for h in r.h:
                met.setdefault(h, []).append(r.doc_id)
    return stay


def _log_chance(hit: int, miss: int, share: float) -> float:
    """Logarithm of a bound on the chance that, of hit + miss documents, as many as hit are of a class of that share."""
    n, q = hit + miss, hit / (hit + miss)
    if q <= share:
        return 0.0
    return -n * (q * np.log(q / share) + ((1 - q) * np.log((1 - q) / (1 - share)) if q < 1 else 0.0))


def _choose(spark: SparkSession, toxic: DataFrame, clean: DataFrame) -> list[str]:
    """Stretches that occur in more toxic texts, and fewer clean ones, than chance gives; of like ones the longest of the most frequent."""
    n_toxic, n_clean = toxic.count(), clean.count()
    if not n_toxic or not n_clean:
        return []
    often = {r.s: r.n for r in _count(toxic).where(F.col("n") >= max(3, n_toxic // 50)).orderBy(F.desc("n"), "s").limit(MOST_STRETCHES).collect()}
    wanted = spark.sparkContext.broadcast(set(often))
    also = {r.s: r.n for r in _count(clean, wanted).collect()}
    share, least = n_toxic / (n_toxic + n_clean), np.log(CHANCE)
    wanted.destroy()
    odd = {s: n for s, n in often.items() if also.get(s, 0) * n_toxic <= 0.1 * n * n_clean and _log_chance(n, also.get(s, 0), share) < least}
    chosen: list[str] = []
    for s in sorted(odd, key=lambda s: (-odd[s], -len(s), s)):
        if any(_share_stretch(s, c) for c in chosen):
            continue
        while longer := [x for x in odd if len(x) == len(s) + 1 and s in x and odd[x] >= 0.85 * odd[s]]:
            s = max(longer, key=lambda x: (odd[x], x))
        chosen.append(s)
        if len(chosen) == MOST_LANDMARKS:
            break
    return chosen


def variants(word: str) -> list[str]:
    """The word with one character inserted, at each inner place: letters doubled, a digit, a letter."""
    return [word[:i] + c + word[i:] for i in range(1, len(word)) for c in (word[i], "0", "x")]


def _share_stretch(a: str, b: str, n: int = 3) -> bool:
    return any(a[i : i + n] in b for i in range(len(a) - n + 1))


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> Model | None:
    """Fits on a bounded sample of labelled documents of the training folds; None without a toxic one."""
    fit = labels.where(fold_of() != 0).select("doc_id", "toxic").where("toxic IS NOT NULL").dropDuplicates(["doc_id"])
    seeded = F.xxhash64(F.lit("toxicity"), "doc_id")
    ids = fit.where("toxic = 1").orderBy(seeded, "doc_id").limit(MOST_TOXIC).unionByName(fit.where("toxic = 0").orderBy(seeded, "doc_id").limit(MOST_CLEAN))
    # at most MOST_TOXIC + MOST_CLEAN ids: a proven bound
    sample = stage(spark, docs.select("doc_id", text_of().alias("text")).join(F.broadcast(ids), "doc_id").select("doc_id", "text", "toxic"), "toxic-sample")
    stay = spark.createDataFrame([(int(i),) for i in sorted(_unlike(sample))], "stay long")
    sample = stage(spark, sample.join(F.broadcast(stay), F.col("doc_id") == F.col("stay"), "left_semi"), "toxic-unlike")
    toxic, clean = sample.where("toxic = 1"), sample.where("toxic = 0")
    bad = _choose(spark, toxic, clean)
    if not bad:
        return None

    seen = spark.sparkContext.broadcast(Landmarks(bad))

    def close(batches):  # clean units that a landmark could be taken for
        for b in batches:
            c = Counter(u for t in b.column("text").to_pylist() for u in _bag(t))
            us = list(c)
            near = seen.value.kernel(us).max(axis=1) if us else []
            got = [(u, c[u], float(k)) for u, k in zip(us, near) if k >= 0.3]
            yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], t) for i, t in enumerate((pa.string(), pa.int64(), pa.float64()))], ["s", "n", "k"])

    usual = clean.select("text").mapInArrow(close, "s string, n long, k double").groupBy("s").agg(F.sum("n").alias("n"), F.max("k").alias("k"))
    usual = usual.orderBy(F.desc(F.log1p("n") * F.col("k") * F.col("k")), "s").limit(CLEAN_LANDMARKS)
    marks = Landmarks([*bad, *(r.s for r in usual.collect())])
    shared, n_bad = spark.sparkContext.broadcast(marks), len(bad)

    def examples(batches):  # kernel rows of each document's most suspicious sentences
        for b in batches:
            out, who = [], []
            for t, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
                bags = [sorted(_bag(s)) for s in sentences(t)]
                flat = sorted({u for bag in bags for u in bag})
                if not flat:
                    continue
                k = shared.value.kernel(flat)
                near = dict(zip(flat, k[:, :n_bad].max(axis=1).tolist()))
                tops = sorted({max(bag, key=lambda u: near[u]) for bag in bags if bag}, key=lambda u: (-near[u], u))
                # all that come near the worst of a toxic text are taken as meant; of a clean one those that come nearest
                for u in [u for u in tops if near[u] >= 0.8 * near[tops[0]]][:PER_TOXIC] if y else tops[:PER_CLEAN]:
                    out.append(k[flat.index(u)].tobytes())
                    who.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(who, pa.int32())], ["k", "y"])

    # bounded samples come as Arrow tables and are read in place: rows as Python objects would take several times the room
    rows = sample.select("text", "toxic").mapInArrow(examples, "k binary, y int").toArrow()
    k, y = _matrix(rows["k"], np.float32, len(marks.strings)), rows["y"].to_numpy()
    if not (y == 0).any():
        return None
    # the landmarks themselves and their forms with an inserted character count as seen in toxic sentences
    more = marks.kernel([f"<{v}>" for s in bad if len(w := s.strip("<>")) > 3 for v in (w, *variants(w))])
    positive, negative = np.r_[k[y == 1], more], k[y == 0]
    del rows, k
    for again in range(MINING + 1):
        model = Model(marks, positive, negative)
        fitted = spark.sparkContext.broadcast(model)

        def worst(batches, fitted=fitted):  # of each document the units of largest margin: what the next fit must refuse
            for b in batches:
                out = []
                for t in b.column("text").to_pylist():
                    bag = sorted(_bag(t))
                    k = fitted.value.landmarks.kernel(bag) if bag else np.zeros((1, len(fitted.value.landmarks.strings)), np.float32)
                    m = fitted.value.margins(k)
                    top = np.argsort(-m, kind="stable")[:TOP]
                    padded = np.full(TOP, NOTHING)
                    padded[: len(top)] = np.maximum(m[top], NOTHING)
                    out.append((k[top[:PER_MINED]].tobytes(), padded.tobytes()))
                yield pa.RecordBatch.from_arrays([*(pa.array([o[i] for o in out], pa.binary()) for i in (0, 1)), b.column("toxic").cast(pa.int32())], ["k", "m", "y"])

        got = sample.select("text", "toxic").mapInArrow(worst, "k binary, m binary, y int").toArrow()
        fitted.destroy()
        tops, toxic = _matrix(got["m"], np.float64, TOP), got["y"].to_numpy().astype(np.float64)
        wrong = got.filter(pa.array((toxic == 0) & (tops[:, 0] > NOTHING)))
        negative = np.r_[negative, _matrix(wrong["k"], np.float32, len(marks.strings))]
    for b in (seen, shared):
        b.destroy()
    model.fit_curve(tops, toxic)
    return model


def _matrix(column: pa.ChunkedArray, kind: type, width: int) -> np.ndarray:
    """The bytes of a binary column as rows of numbers, not copied but for the joining of its chunks."""
    if not len(column):
        return np.zeros((0, width), kind)
    whole = pa.concat_arrays(column.chunks)
    ends = np.frombuffer(whole.buffers()[1], np.int32)[whole.offset : whole.offset + len(whole) + 1]
    return np.frombuffer(whole.buffers()[2], kind, (ends[-1] - ends[0]) // np.dtype(kind).itemsize, int(ends[0])).reshape(-1, width)


def score(spark: SparkSession, docs: DataFrame, model: Model | None, column: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1; 0 for all where there is no model. One narrow pass, the model is some kB."""
    shared, names = spark.sparkContext.broadcast(model), docs.columns

    def run(batches):
        model = shared.value
        for b in batches:
            got, held, size = [], [], 0
            for i, t in enumerate(b.column("text")):
                held.append(t.as_py() or "")
                size += len(held[-1])
                if size > 500_000 or i == b.num_rows - 1:
                    got += model.of_texts(held) if model else [0.0] * len(held)
                    held, size = [], 0
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(got, pa.float64())], [*names, column])
        if model:
            model.forget()

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())]))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity and the prediction at 0.5.

    Null and empty texts score 0. Repeated rows are scored each. Without toxic
    labels every score is 0; an empty table gives no rows. Very long texts are a
    set of words each, scored in slices; extra columns are ignored.
    """
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    out = score(spark, docs.select("doc_id", "text"), train(spark, docs, labels))
    return out.select("doc_id", (fold_of() == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` less those scored at THRESHOLD or more; all columns as they are."""
    return score(spark, docs, train(spark, docs, labels), "__toxic").where(F.col("__toxic") < THRESHOLD).select(*docs.columns)
