"""The mixed corpus gives each row what the mix takes of that row."""

from pyspark.sql import functions as F

from tapewright.llm import mixture


def test_null_and_repeated_ids_keep_their_words(spark):
    words = lambda p, n: " ".join(f"{p}{i}" for i in range(n))
    rows = [(None, words("n", 30), "s1"), (1, words("a", 100), "s1"), (1, words("b", 10), "s1"), (None, words("m", 20), "s2"), (2, words("c", 50), "s2"), (3, words("e", 40), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    tagged = docs.withColumn("tag", F.substring("text", 1, 1))
    want = {r.tag: r.taken for r in mixture.mix(spark, tagged, carry=("tag",)).collect() if r.taken}
    got: dict = {}
    for r in mixture.resample(spark, docs).collect():
        got[r.text[0]] = got.get(r.text[0], 0) + len(r.text.split())
    assert got == want and {"n", "m"} & set(got) and sum(want.values()) == sum(got.values())
