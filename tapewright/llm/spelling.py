"""Spelling variants by a self-join of the vocabulary's trie with active-node sets.

The vocabulary is parted by prefix, so that a task holds subtrees of the trie.
A node's active set are the trie's nodes within one edit of it; a child's set
follows from its parent's alone, and a terminal node with an active terminal
node is a pair of words at distance one.

Two words of at least 2 * AFFIX code points that are one edit apart share their
first AFFIX code points or their last: the one pairs meet in the trie, the others in
the trie of reversed words. A subtree of more than MOST words is parted further,
by the same argument on what its words do not share: with m the shorter rest,
they share the first m // 2 code points of the rest or the last. Subtrees whose
words have a rest of at most two code points are bounded by the alphabet, so
this ends, and no word or pair is given up on the way.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import done_with, parts, read_table, stage, text_of

LETTERS = "A-Za-zÀ-ÿ"
#: Least code points of a word, shared code points that part the trie (at most half of the former), words of a subtree.
SHORTEST, AFFIX, MOST = 7, 3, 20_000
#: Distinct words that a task counts before it hands them on.
HELD = 100_000


def garbled(doc_id: int | None, word: str, one_in: int = 31) -> str:
    """The word, less a code point where ``one_in`` divides the hash of id and word."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
    return word if h % one_in else word[: h % len(word)] + word[h % len(word) + 1 :]


def vocabulary(docs: DataFrame, key: str = "doc_id", shortest: int = SHORTEST, least: int = 2) -> DataFrame:
    """(word, n) of the runs of letters, A-Z as a-z, as ``garbled`` leaves them. A null text has none."""
    runs = re.compile(f"[{LETTERS}]{{{shortest},}}")  # greedy, and a run starts where its first letter is: maximal runs

    def run(batches):
        seen: Counter = Counter()

        def given():
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
            seen.clear()
            return out

        for b in batches:
            for doc_id, text in zip(b.column("id").to_pylist(), b.column("t").to_pylist()):
                for word, n in Counter(runs.findall(text.encode().lower().decode())).items():  # bytes: only A-Z changes
                    w = garbled(doc_id, word)
                    if len(w) >= shortest:
                        seen[w] += n
                if len(seen) >= HELD:
                    yield given()
        if seen:
            yield given()

    words = docs.select(F.col(key).cast("long").alias("id"), text_of().alias("t")).where("t <> ''").mapInArrow(run, "word string, n long")
    return words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


class Trie:
    """A trie of words; nodes are numbered in order of insertion, the root is 0."""

    def __init__(self, words: list[str]):
        self.kids: list[dict[str, int]] = [{}]
        self.word = [-1]
        for k, w in enumerate(words):
            node = 0
            for x in w:
                nxt = self.kids[node].get(x)
                if nxt is None:
                    nxt = self.kids[node][x] = len(self.kids)
                    self.kids.append({})
                    self.word.append(-1)
                node = nxt
            self.word[node] = k

    def pairs(self) -> Iterator[tuple[int, int]]:
        """(i, j) for all words i, j at distance one, both ways.

        ``near`` are the nodes at distance one of a node p; p itself is at zero. Its child by x has at distance one: p (x inserted),
        p's other children (x replaced), its own children (a letter deleted), and the child by x of each node of ``near``.
        """
        kids, word = self.kids, self.word
        stack = [(0, list(kids[0].values()))]
        while stack:
            p, near = stack.pop()
            if word[p] >= 0:
                for q in near:
                    if word[q] >= 0:
                        yield word[p], word[q]
            mine = kids[p]
            for x, c in mine.items():
                found = {kids[q][x] for q in near if x in kids[q]}
                found.update(mine.values())
                found.update(kids[c].values())
                found.add(p)
                found.discard(c)
                stack.append((c, found))


def _joined(parted: DataFrame) -> DataFrame:
    """(word, other, other_n) of all near words that meet in a subtree of ``parted(key, a, b, back, word, n)``, rows of a key together."""

    def near(rows):
        a, b, back = rows[0][1:4]
        rests = [w[a : len(w) - b] for *_, w, _ in rows]
        for i, j in Trie([r[::-1] for r in rests] if back else rests).pairs():
            yield rows[i][4], rows[j][4], rows[j][5]

    def run(batches):
        key, rows = None, []

        def told():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.string(), pa.int64()))], ["word", "other", "other_n"])

        out: list = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != key:
                    if len(rows) > 1:
                        out += near(rows)
                    key, rows = row[0], []
                    if len(out) >= 10_000:
                        yield told()
                        out = []
                rows.append(row)
        if len(rows) > 1:
            out += near(rows)
        if out:
            yield told()

    return parted.select("key", "a", "b", "back", "word", "n").mapInArrow(run, "word string, other string, other_n long")


def _keyed(df: DataFrame) -> DataFrame:
    """Adds the subtree's key: what its words share at either end."""
    ends = F.concat_ws("\n", F.col("a").cast("string"), F.col("b").cast("string"), F.substring("word", F.lit(1), F.col("a")), F.right("word", F.col("b")))
    return df.withColumn("key", ends)


def near_words(spark: SparkSession, words: DataFrame, affix: int = AFFIX, most: int = MOST) -> DataFrame:
    """(word, other, other_n) for all pairs of ``words(word, n)``, distinct, that are one edit apart, both ways.

    Words have to have 2 * ``affix`` code points at least; a subtree has at most ``most`` words, or rests of at most two code points.
    """
    ends = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(back).alias("back")) for a, b, back in ((affix, 0, False), (0, affix, True))])
    left = words.select("word", "n", F.explode(ends).alias("e")).select("word", "n", "e.*")
    found, held, part = None, [], 0
    while left is not None:
        keyed = stage(spark, _keyed(left), f"spelling-{part}")
        sizes = stage(spark, keyed.groupBy("key").agg(F.count("*").alias("size"), F.max(F.length("word") - F.col("a") - F.col("b")).alias("rest")).where("size > 1"), f"spelling-sizes-{part}")
        held += [keyed, sizes]
        small = (F.col("size") <= most) | (F.col("rest") <= 2)
        fits = keyed.join(sizes.where(small).select("key"), "key").repartition(parts(spark), "key").sortWithinPartitions("key", "word")
        pairs = _joined(fits)
        found = pairs if found is None else found.unionByName(pairs)
        large = sizes.where(~small).select("key")
        if large.isEmpty():
            break
        rest = F.length("word") - F.col("a") - F.col("b")
        halves = F.array_distinct(F.array(F.floor(rest / 2).cast("int"), F.greatest(F.floor((rest - 1) / 2).cast("int"), F.lit(0))))
        more = keyed.join(large, "key").select("word", "n", "a", "b", F.explode(halves).alias("m"))
        both = F.array(F.struct((F.col("a") + F.col("m")).alias("a"), F.col("b").alias("b"), F.lit(False).alias("back")), F.struct(F.col("a").alias("a"), (F.col("b") + F.col("m")).alias("b"), F.lit(True).alias("back")))
        left = more.select("word", "n", F.explode(both).alias("e")).select("word", "n", "e.*").distinct()
        part += 1
    out = stage(spark, found.distinct(), "spelling-near")
    done_with(spark, *held)
    return out


def forms(spark: SparkSession, words: DataFrame, near: DataFrame, times: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of ``words(word, n)``: a word's form is its most frequent near word, if that is ``times`` as frequent."""
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("o"))
    known = words.join(best, "word", "left")
    own = -F.col("o.less") >= times * F.col("n")
    known = known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(own, F.col("o.other")).alias("form"), F.when(own, -F.col("o.less")).alias("form_n"))
    known = stage(spark, known, "spelling-known")
    # counts grow tenfold along a chain of forms: it ends, and after r rounds of doubling 2^r steps are behind
    chain = stage(spark, known.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "spelling-chain-0")
    part, moved = 0, True
    while moved:
        part += 1
        on = chain.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = stage(spark, chain.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), f"spelling-chain-{part}")
        moved = not step.where("moved").isEmpty()
        chain = step.select("word", "root")
    return known.join(chain, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents' vocabulary with its near words' number, its form and its root.

    Null and empty texts have no words; a null id counts as an empty one; repeated rows count each; an empty table gives
    no rows; extra columns are ignored. A very long run of letters is a word like any other.
    """
    words = stage(spark, vocabulary(read_table(spark, sf_dir, "documents")), "spelling-words")
    return forms(spark, words, near_words(spark, words))
