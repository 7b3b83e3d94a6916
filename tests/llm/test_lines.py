"""Line dedup against a plain loop over all runs."""

import random

from tapewright.llm import lines

SF = "/root/testdata/sf0.001"


def brute(docs, words=lines.WORDS):
    """Texts less every line that is in a run of at least ``words`` words which also starts at an earlier place."""
    worded = {k: [(i, x.rstrip(), len(x.split())) for i, x in enumerate(t.encode().split(b"\n")) if x.strip()] for k, t in docs}
    runs = {}
    for k, ls in worded.items():
        for a in range(len(ls)):
            held = 0
            for b in range(a, len(ls)):
                held += ls[b][2]
                if held >= words:
                    runs.setdefault(tuple(x for _, x, _ in ls[a : b + 1]), []).append((k, a, b))
    gone = {k: set() for k, _ in docs}
    for places in runs.values():
        first = min(places)
        for k, a, b in places:
            if (k, a) != first[:2]:
                gone[k] |= {i for i, _, _ in worded[k][a : b + 1]}
    for k, ls in worded.items():  # a line without a word goes if both its neighbours with words go
        for (i, _, _), (j, _, _) in zip(ls, ls[1:]):
            if {i, j} <= gone[k]:
                gone[k] |= set(range(i, j))
    return {k: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[k]) for k, t in docs}


def test_like_brute_force_on_a_table(spark):
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r.text for r in lines.dedup(spark, spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute(docs) and any(got[k] != t for k, t in docs)


def test_like_brute_force_on_few_short_lines(spark):
    """Lines of one to twelve words out of few, so that runs overlap, repeat inside a text and first stand in several places."""
    rng = random.Random(8)
    pool = [" ".join(f"w{rng.randrange(30)}" for _ in range(n)) for n in (1, 1, 2, 3, 3, 4, 5, 7, 9, 12)]
    docs = [(k, "\n".join(rng.choice([*pool, ""]) for _ in range(rng.randrange(14)))) for k in range(120)]
    got = {r.doc_id: r.text for r in lines.dedup(spark, spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute(docs)


def test_parts_first_seen_apart(spark):
    """The third text repeats the second beyond what the first has."""
    a, b, c = "one two three four five six", "seven eight nine ten eleven", "twelve thirteen fourteen"
    docs = [(1, f"{a}\n{b}\nother"), (2, f"{a}\n{b}\n{c}"), (3, f"new\n{b}\n{c}\nsix more words to be ten then\nend"), (4, f"{a}\n{b}\n{c}")]
    got = {r.doc_id: r.text for r in lines.dedup(spark, spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute(docs) and got[4] == ""


def test_fewer_positions_than_lines():
    text = "\n".join(f"line {i} of three" for i in range(200))
    assert len(lines.selected(text)) < 150
    assert lines.selected("") == lines.selected("\n \n") == []
