"""prj_scrub: every document has a row, and all eight rules run."""

import re

import duckdb

from tapewright.plans import text_queries

IDS = "ybl|okaxis|okhdfcbank|okicici|oksbi|paytm|upi|ibl|axl|apl"
RULES = [
    (r"https?://t\.me/(?:\+|joinchat/)\S+", "t.me/+[link removed]", re.I),
    (r"https?://(?:wa\.me|api\.whatsapp\.com)\S*", "wa.me/[number removed]", re.I),
    (r"https?://chat\.whatsapp\.com/\S+", "chat.whatsapp.com/[link removed]", re.I),
    (r"https?://\S+", "[link removed]", re.I),
    (r"\bwww\.\S+", "[link removed]", re.I),
    (rf"\b[\w.-]{{3,}}@({IDS})\b", r"[id removed]@\1", re.I),
    (r"@[A-Za-z][A-Za-z0-9_]{3,}", "@[handle removed]", 0),
    (r"(?:\+?91[\s-]?)?[6-9]\d{4}[\s-]?\d{5}\b", "[number removed]", 0),
]


def brute(text):
    for pattern, to, flags in RULES:
        text = text and re.sub(pattern, to, text, flags=flags | re.ASCII)
    return text


def test_every_document_is_scrubbed(spark):
    sf = "/root/testdata/sf0.01"
    want = {i: brute(t) for i, t in duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()}
    got = {r.doc_id: r.t for r in text_queries.prj_scrub(spark, sf).collect()}
    assert got == want and len(got) == 1000
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert set(con.sql(text_queries.SQL["prj_scrub"]).fetchall()) == set(got.items())


def test_each_rule_runs_in_the_query(spark, tmp_path):
    texts = ["join https://t.me/+AbC now", "https://WA.me/9198 hi", "https://chat.whatsapp.com/xyz", "see https://a.b/c", "www.a.b", "pay some.one@okaxis now", "ask @handle_1", "call +91 98765 43210", None, "whatsapp"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.t for r in text_queries.prj_scrub(spark, str(tmp_path)).collect()}
    assert [got[i] for i in range(10)] == ["join t.me/+[link removed] now", "wa.me/[number removed] hi", "chat.whatsapp.com/[link removed]", "see [link removed]", "[link removed]", "pay [id removed]@[handle removed] now", "ask @[handle removed]", "call [number removed]", None, "whatsapp"]
