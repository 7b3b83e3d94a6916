"""Suffix-array dedup: removal of every byte under a string of SIZE bytes that also starts elsewhere.

Equal strings are brought together by content, never by sorting the corpus in
one place. Of each string of SIZE bytes the least hash of its GRAM-byte pieces
is its anchor, so equal strings have equal anchors at equal places. Consecutive
strings with one anchor are a run. Anchors that only one text has, at one
place, are dropped after an aggregation that combines on the map side, which
leaves a small part of a corpus. The runs around each other anchor are cut out
of the texts and put in order by prefix polynomial hashes: binary search over
them gives the common extension of two positions in a logarithmic number of
steps, a mergesort whose comparisons are such extensions sorts all strings
(suffixes) of one place, and equal neighbours are the repeats. Of two runs the
sort is one comparison to either side. Every repeat is compared on its bytes
before it counts.

Texts are known by 128 bits of their SHA-256; copies of a whole text need no
more than that, and are cut once.

A hot anchor (a passage that many documents share) is dealt out in chunks of
CHUNK runs. A chunk settles runs that are equal in it, and hands one of each on
to the next round, under two narrower anchors: the bytes common to the strings
that have the anchor in their first half, and to those that have it in their
second. So a group shrinks by CHUNK where runs are equal and is split where
they differ, until it is one chunk; no task ever holds more.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import done_with, read_table, stage, text_of

SIZE, GRAM = 200, 32
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that its powers never vanish
#: Runs of one anchor that a task holds at a time.
CHUNK = 2048
#: Bytes of runs whose sorts go together.
TOGETHER = 1_000_000
WIDEST = SIZE - GRAM  # the last place that an anchor can have in a string


_known: dict[int, np.ndarray] = {}


def powers(n: int, base: int = int(BASE)) -> np.ndarray:
    """base^0 .. base^n or more, modulo 2^64."""
    if base not in _known or len(_known[base]) <= n:
        out = np.full(max(1 << 16, 2 * n), base, np.uint64)
        out[0] = 1
        _known[base] = np.multiply.accumulate(out)
    return _known[base]


INVERSE = pow(int(BASE), -1, 1 << 64)


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Prefix polynomial hashes of bytes, modulo 2^64."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data))[: len(data)], out=out[1:])
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def runs(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """Anchor hash, anchor place, first and last start of each run of a text; None if it is too short."""
    n = len(raw)
    if n < SIZE:
        return None
    sums = prefix_sums(np.frombuffer(raw, np.uint8))
    grams = n - GRAM + 1
    h = _mix((sums[GRAM:] - sums[:-GRAM]) * powers(n, INVERSE)[:grams])
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(grams, dtype=np.uint64)  # the leftmost of equal ones is least
    w = SIZE - GRAM + 1
    padded = np.full(-(-grams // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:grams] = key
    block = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: n - SIZE + 1], ahead[w - 1 : w + n - SIZE])
    first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    at = (least[first] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return h[at], at, first, np.r_[first[1:], n - SIZE + 1] - 1


def _packed(raw: bytes) -> tuple[np.ndarray, np.ndarray] | None:
    """Anchor hash of each run, and its first start, number of further starts and anchor's place in one number."""
    got = runs(raw)
    if got is None:
        return None
    a, at, s, e = got
    return a.view(np.int64), s << 16 | e - s << 8 | at - s


def _each(batches, of):
    """Row numbers in the batch and columns of all runs of its texts."""
    for b in batches:
        take, cols = [], []
        for i, text in enumerate(b.column("__text")):
            if (got := _packed(text.as_py().encode())) is not None:
                take.append(np.full(len(got[0]), i))
                cols.append(got)
        if take:
            yield of(b, np.concatenate(take), *map(np.concatenate, zip(*cols)))


def anchors(docs: DataFrame) -> DataFrame:
    """Rows (a, n): anchors that have more than one place, a place in a copy of a text being the same; n counts copies too."""

    def of(b, take, a, where):
        u = b.column("u").to_numpy()[take].view(np.uint64)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(_mix(u ^ _mix(where.view(np.uint64))).view(np.int64))], ["a", "k"])

    places = docs.select("u", "__text").mapInArrow(lambda batches: _each(batches, of), "a long, k long")
    return places.groupBy("a").agg(F.count("*").alias("n"), F.min("k").alias("x"), F.max("k").alias("y")).where("x <> y").select("a", "n")


def all_runs(docs: DataFrame) -> DataFrame:
    """Rows (a, u, v, place): every run of every text."""

    def of(b, take, a, where):
        rows = pa.array(take)
        return pa.RecordBatch.from_arrays([pa.array(a), b.column("u").take(rows), b.column("v").take(rows), pa.array(where)], ["a", "u", "v", "place"])

    return docs.select("u", "v", "__text").mapInArrow(lambda batches: _each(batches, of), "a long, u long, v long, place long")


class Texts:
    """The bytes of some runs, one after the other, with prefix hashes over all of them."""

    def __init__(self, pieces: list[bytes]):
        self.data = np.frombuffer(b"".join(pieces), np.uint8)
        self.begin = np.cumsum([0, *map(len, pieces)])[:-1]
        self.sums, self.n = prefix_sums(self.data), len(self.data)
        self.pow = powers(self.n)

    def digest(self, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        return (self.sums[at + length] - self.sums[at]) * self.pow[self.n - at]

    def ahead(self, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of the common extension from x and y, up to most."""
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = self.digest(x, mid) == self.digest(y, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def back(self, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The same backwards from before x and y."""
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = self.digest(x - mid, mid) == self.digest(y - mid, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def same(self, x: np.ndarray, y: np.ndarray, length: int = SIZE) -> np.ndarray:
        """Whether the bytes themselves agree."""
        out = np.ones(len(x), bool)
        for at in range(0, len(x), 8192):
            i = np.arange(length)[None, :]
            out[at : at + 8192] = (self.data[x[at : at + 8192, None] + i] == self.data[y[at : at + 8192, None] + i]).all(axis=1)
        return out

    def less(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of strings of SIZE bytes: x before y, x equal to y."""
        n = self.ahead(x, y, np.full(len(x), SIZE))
        equal = n == SIZE
        n = np.minimum(n, SIZE - 1)
        return ~equal & (self.data[x + n] < self.data[y + n]), equal

    def merge_sort(self, at: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Positions ordered by bucket (given sorted), then by their next SIZE bytes.

        Bottom up; all merges of a level run together. The place of a string in
        a merge is its own rank plus its rank among the other half, which a
        binary search with extension comparisons finds.
        """
        at = at.copy()
        start = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        size = np.diff(np.r_[start, len(at)])
        begin, count = np.repeat(start, size), np.repeat(size, size)
        rank, width = np.arange(len(at)) - begin, 1
        while width < size.max():
            half = rank // width
            other = (half ^ 1) * width
            low = np.minimum(other, count)
            high = np.minimum(other + width, count)
            left, floor = half % 2 == 0, low.copy()
            while len(open_ := np.flatnonzero(low < high)):
                mid = (low[open_] + high[open_]) // 2
                before, equal = self.less(at[begin[open_] + mid], at[open_])
                up = before | (equal & ~left[open_])  # equal strings keep their order
                low[open_] = np.where(up, mid + 1, low[open_])
                high[open_] = np.where(up, high[open_], mid)
            place = begin + (half // 2) * 2 * width + (rank - half * width) + (low - floor)
            new = np.empty_like(at)
            new[place] = at
            at, width = new, 2 * width
        return at


def _windows_of(o: np.ndarray, lo: np.ndarray, hi: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last start, in a run, of strings that have the anchor at places lo to hi."""
    return np.maximum(0, o - hi), np.minimum(size - SIZE, o - lo)


def shared_strings(groups: list[tuple[int, int, list[tuple[bytes, int]]]]) -> list[list[tuple[int, int]]]:
    """Of many anchors' distinct runs, (lo, hi, [(bytes, anchor's place)]): per run the starts, as ranges, of strings that another run of its anchor has too."""
    flat = [(g, lo, hi, piece, o) for g, (lo, hi, rows) in enumerate(groups) for piece, o in rows]
    of, lo, hi, o = (np.array([f[i] for f in flat], np.int64) for i in (0, 1, 2, 4))
    t = Texts([f[3] for f in flat])
    first, last = _windows_of(o, lo, hi, np.diff(np.r_[t.begin, t.n]))
    found: list[list[tuple[int, int]]] = [[] for _ in flat]
    members = np.bincount(of, minlength=len(groups))
    # two runs: extended around the anchor, once to either side
    i = np.flatnonzero(np.r_[of[1:] == of[:-1], False] & (members[of] == 2))
    j = i + 1
    x, y = t.begin[i] + o[i], t.begin[j] + o[j]
    left = t.back(x, y, np.minimum(o[i] - first[i], o[j] - first[j]))
    right = t.ahead(x, y, np.minimum(last[i] + SIZE - o[i], last[j] + SIZE - o[j]))
    ok = (left + right >= SIZE) & (lo[i] <= left) & (SIZE - hi[i] <= right)
    ok[ok] = t.same((x - left)[ok], (y - left)[ok]) & t.same((x + right - SIZE)[ok], (y + right - SIZE)[ok])
    for a, b, before, upto in zip(i[ok].tolist(), j[ok].tolist(), left[ok].tolist(), (right - SIZE)[ok].tolist()):
        for q in (a, b):
            r = max(int(first[q]), int(o[q]) - before), min(int(last[q]), int(o[q]) + upto)
            if r[0] <= r[1]:
                found[q].append(r)
    # more: all strings of one anchor and place are sorted; equal neighbours are the repeats
    many = np.flatnonzero((members[of] > 2) & (first <= last))
    count = (last - first + 1)[many]
    run = np.repeat(many, count)
    start = np.repeat(first[many], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    bucket = of[run] * (WIDEST + 1) + o[run] - start
    order = np.argsort(bucket, kind="stable")
    size = np.bincount(bucket, minlength=1)
    order = order[size[bucket[order]] > 1]
    if len(order):
        at, bucket = (t.begin[run] + start)[order], bucket[order]
        at = t.merge_sort(at, bucket)
        pair = np.flatnonzero(bucket[1:] == bucket[:-1])
        pair = pair[t.ahead(at[pair], at[pair + 1], np.full(len(pair), SIZE)) == SIZE]
        pair = pair[t.same(at[pair], at[pair + 1])]
        hit = np.unique(np.r_[at[pair], at[pair + 1]])
        owner = np.searchsorted(t.begin, hit, "right") - 1
        cut = np.flatnonzero(np.r_[True, (hit[1:] != hit[:-1] + 1) | (owner[1:] != owner[:-1])]) if len(hit) else []
        for k, n in zip(cut, [*cut[1:], len(hit)]):
            q = owner[k]
            found[q].append((int(hit[k] - t.begin[q]), int(hit[n - 1] - t.begin[q])))
    return found


def narrower(a: int, lo: int, hi: int, piece: bytes, o: int):
    """The run under two anchors of half the places each: (a, lo, hi, bytes cut off, bytes, place). One place is left as it is."""
    mid = (lo + hi) // 2
    for x, y in ((lo, mid), (mid + 1, hi)) if lo < hi else ((lo, hi),):
        first, last = max(0, o - y), min(len(piece) - SIZE, o - x)
        if first <= last:
            context = piece[o - x : o - y + SIZE]  # what all strings with the anchor at places x to y have in common
            yield xxhash.xxh64_intdigest(context + struct.pack("<qhh", a, x, y)) - (1 << 63), x, y, first, piece[first : last + SIZE], o - first


_ROW = {"a": pa.int64(), "u": pa.int64(), "v": pa.int64(), "s": pa.int32(), "e": pa.int32(), "lo": pa.int16(), "hi": pa.int16(), "o": pa.int16(), "known": pa.bool_(), "piece": pa.binary()}
_SCHEMA = "a long, u long, v long, s int, e int, lo short, hi short, o short, known boolean, piece binary"


def _settle(batches):
    """Rows of runs sorted by (a, c): repeated strings, as rows without a piece, and the runs that a chunk of several hands on."""
    now, held, chunks = None, {}, 1
    waiting: list = []  # anchors whose sorts go together
    size, out = 0, []

    def repeated(owner, first, last):
        u, v, s, known = owner
        if not known:
            out.append((None, u, v, s + first, s + last + SIZE, None, None, None, None, None))

    def flush():
        nonlocal size
        if waiting:
            found = iter(shared_strings([w[:3] for w in waiting]))
            for _, _, rows, owners in waiting:
                for (_, _), owner, ranges in zip(rows, owners, found):
                    for x, y in ranges:
                        repeated(owner, x, y)
        waiting.clear()
        size = 0

    def close():
        nonlocal size
        if not held:
            return
        a, _, lo, hi = now
        for (piece, o), owners in held.items():
            if len(owners) > 1:  # the same bytes, compared as keys
                first, last = max(0, o - hi), min(len(piece) - SIZE, o - lo)
                for owner in owners if first <= last else ():
                    repeated(owner, first, last)
        if chunks > 1:
            for (piece, o), owners in held.items():
                u, v, s, known = owners[0]
                out.extend((k, u, v, s + cut, None, x, y, at, known or len(owners) > 1, p) for k, x, y, cut, p, at in narrower(a, lo, hi, piece, o))
        elif len(held) > 1 and any(len(x) == 1 and not x[0][3] for x in held.values()):
            waiting.append((lo, hi, list(held), [(*x[0][:3], x[0][3] or len(x) > 1) for x in held.values()]))
            size += sum(len(p) for p, _ in held)
            if size > TOGETHER:
                flush()

    def batch():
        made = pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(_ROW.values())], list(_ROW))
        out.clear()
        return made

    for b in batches:
        for a, c, k, u, v, s, lo, hi, o, known, piece in zip(*(b.column(x).to_pylist() for x in ("a", "c", "k", "u", "v", "s", "lo", "hi", "o", "known", "piece"))):
            if (a, c, lo, hi) != now:
                close()
                now, held, chunks = (a, c, lo, hi), {}, k
            held.setdefault((piece, o), []).append((u, v, s, known))
        yield batch()
    close()
    flush()
    yield batch()


def _pieces(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The runs that are wanted of each text, cut out of it; of copies that stand together the first is cut."""

    def run(batches):
        last = None
        for b in batches:
            out = []
            for u, v, text, want in zip(*(b.column(c) for c in ("u", "v", "__text", "want"))):
                u, v = u.as_py(), v.as_py()
                if (u, v) == last:
                    continue
                last, raw = (u, v), text.as_py().encode()
                for w in want.as_py():
                    s, more, o = w["place"] >> 16, w["place"] >> 8 & 255, w["place"] & 255
                    out.append((w["a"], u, v, s, None, 0, WIDEST, o, False, raw[s : s + more + SIZE], w["k"]))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate([*_ROW.values(), pa.int64()])], [*_ROW, "k"])

    return docs.join(wanted, ["u", "v"]).select("u", "v", "__text", "want").mapInArrow(run, _SCHEMA + ", k long")


def repeated_spans(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Rows (u, v, b, e): bytes b to e (exclusive) of the texts of ``docs(u, v, __text)`` are under a string that another text or place has."""
    # written before it is joined: a join whose sides are only dealt out can be split where an anchor is hot
    met = stage(spark, anchors(docs), "suffix-met")
    shared = stage(spark, all_runs(docs).join(met, "a"), "suffix-shared")
    most = met.agg(F.max("n")).first()[0] or 0
    done_with(spark, met)
    chunks = shared.withColumn("k", F.lit(1).cast("long"))
    if most > CHUNK:  # copies of a text are one run; only what is left is chunked
        hot = shared.where(F.col("n") > CHUNK).select("a", "u", "v", "place").distinct().groupBy("a").agg(F.ceil(F.count("*") / CHUNK).alias("k"))
        chunks = shared.join(stage(spark, hot, "suffix-hot"), "a", "left").withColumn("k", F.coalesce("k", F.lit(1)).cast("long"))
    wanted = chunks.groupBy("u", "v").agg(F.collect_set(F.struct("a", "k", "place")).alias("want"))  # bounded by one document
    rows, found = _pieces(docs, wanted), []
    for turn in range(100):
        dealt = rows.withColumn("c", F.pmod(F.xxhash64("u", "v", "s", F.lit(turn)), F.col("k")).cast("int"))
        out = stage(spark, dealt.repartition("a", "c").sortWithinPartitions("a", "c", "lo", "hi").mapInArrow(_settle, _SCHEMA), f"suffix-strings{turn}")
        found.append(out.where("piece IS NULL").select("u", "v", F.col("s").alias("b"), "e"))
        if turn == 0:
            done_with(spark, shared)
            if most <= CHUNK:
                break
        left = out.where("piece IS NOT NULL")
        counts = stage(spark, left.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).alias("k")), f"suffix-left{turn}")
        if counts.isEmpty():
            break
        rows = left.join(counts, "a")
    else:
        raise RuntimeError("an anchor's runs are still not settled")
    spans = found[0]
    for more in found[1:]:
        spans = spans.unionByName(more)
    return spans


def _identified(docs: DataFrame) -> DataFrame:
    """With the text, null as empty, and 128 bits of its SHA-256 in two numbers."""
    sha = F.sha2("__text", 256)
    half = lambda at: F.conv(F.substring(sha, at, 16), 16, -10).cast("long")
    return docs.withColumn("__text", text_of()).withColumns({"u": half(1), "v": half(17)})


def remove(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Rows (doc_id, kept binary, n_bytes, n_removed, n_spans): the bytes left of each text."""
    own = _identified(docs.select("doc_id", "text")).select("doc_id", "u", "v", "__text")
    spans = repeated_spans(spark, own.select("u", "v", "__text"))
    copies = own.groupBy("u", "v").agg(F.count("*").alias("n")).where("n > 1").select("u", "v", F.lit(0).alias("b"), F.lit(2**31 - 1).alias("e"))
    spans = spans.unionByName(copies).groupBy("u", "v").agg(F.flatten(F.collect_set(F.array("b", "e"))).alias("spans"))  # bounded by one document

    def run(batches):
        for b in batches:
            kept, sizes = [], []
            for text, s in zip(b.column("__text").to_pylist(), b.column("spans").to_pylist()):
                raw = text.encode()
                gone = 0
                k = 0
                if s and len(raw) >= SIZE:
                    edge = np.zeros(len(raw) + 1, np.int32)
                    np.add.at(edge, s[0::2], 1)
                    np.add.at(edge, np.minimum(s[1::2], len(raw)), -1)
                    under = np.cumsum(edge[:-1]) > 0
                    gone, k = int(under.sum()), int(under[0]) + int((under[1:] & ~under[:-1]).sum())
                    left = np.frombuffer(raw, np.uint8)[~under].tobytes()
                else:
                    left = raw
                kept.append(left)
                sizes.append((len(raw), gone, k))
            n, gone, k = zip(*sizes) if sizes else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(kept, pa.binary()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(k, pa.int64())], ["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return own.join(spans, ["u", "v"], "left").select("doc_id", "__text", "spans").mapInArrow(run, f"doc_id {kind}, kept binary, n_bytes long, n_removed long, n_spans long")


def op9_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: bytes, bytes removed, maximal runs removed, digest of what is left.

    Null texts are empty; texts under SIZE bytes lose nothing; repeated rows
    repeat each other, so both lose all; an empty table gives no rows. A very long
    text is one row of its runs; extra columns are ignored.
    """
    out = remove(spark, read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
