"""Exact dedup by content sort against a plain grouping."""

import hashlib
import random
import re

import duckdb

from tapewright.llm import content_sort


def _plain(docs):
    groups = {}
    for i, t in docs:
        groups.setdefault(re.sub("[\x20\x09-\x0d]+", " ", t or ""), []).append(i)
    out = []
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(t.encode()).hexdigest()
        ids.sort(key=lambda i: (i is None, i))
        out += [(i or -1, keep or -1, len(ids), n == 0, sha) for n, i in enumerate(ids)]
    return sorted(out)


def _got(df):
    return sorted((r.doc_id or -1, r.keep_id or -1, r.group_size, r.kept, r.text_sha256) for r in df.collect())


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert sorted(map(tuple, content_sort.op13_content_sort(spark, sf).collect())) == sorted(duckdb.sql(content_sort.ORACLE_SQL).fetchall())


def test_hot_groups_and_common_beginnings(spark):
    """A third of the rows are copies, a third begin alike, over one to 97 ranges; nulls, ties and repeated rows."""
    rng = random.Random(2)
    docs = [(i + 1, rng.choice(["the same  text\n", "the same text ", "the\tsame text "])) for i in range(400)]
    docs += [(1000 + i, "a beginning that is long enough to fill the whole of a key " + str(rng.randrange(150))) for i in range(400)]
    docs += [(2000 + i, " ".join(rng.choice("abc") for _ in range(4))) for i in range(300)]
    docs += [(None, "only without an id"), (None, "only without an id"), (None, "the same text "), (7, "the same text "), (9000, None), (9001, ""), (9002, " "), (9003, "\n")]
    rng.shuffle(docs)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, p int, __norm string").repartition(5)
    for ranges in (1, 7, 97):
        assert _got(content_sort.groups(spark, df, ranges=ranges)) == _plain(docs), ranges
    assert content_sort.groups(spark, df.limit(0)).collect() == []


def test_main_path_is_native(spark):
    plan = content_sort.op13_content_sort(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|FlatMapGroups", plan)
