"""Very long texts: token counts, chat formatting and WARC records of several megabytes."""

import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from attestary.llm import chat, token_counts, warc

public_tokenizers = pytest.importorskip("public_tokenizers")


def test_token_counts_of_long_texts_add_up(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    text = lambda n: "some würdiger text, 12 times. " * n
    df = spark.createDataFrame([(n, text(n)) for n in (1, 2, 100_000)] + [(7, "x" * 3_000_000)], "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_pretokens, r.n_tokens) for r in token_counts.token_counts(df, path).collect()}
    for k in range(3):
        assert got[100_000][k] == got[1][k] + 99_999 * (got[2][k] - got[1][k])
    assert got[7][:2] == (3_000_000, 1) and 0 < got[7][2] <= 3_000_000


def test_a_long_turn_comes_back(spark):
    said = "### User: </turn> \\ é " * 150_000
    rows = spark.createDataFrame([(1, 0, "user", said), (1, 1, "assistant", said), (1, 2, "assistant", "short")], "conv_id long, turn long, role string, text string")
    back = chat.read_conversations(chat.format_conversations(rows)).select(F.transform("turns", lambda t: F.sha2(t["text"].cast("binary"), 256)).alias("t"), F.length("loss_text").alias("n")).first()
    own = hashlib.sha256(said.encode()).hexdigest()
    assert back.t == [own, own, hashlib.sha256(b"short").hexdigest()] and back.n == len(said) + 5


def test_a_long_record_comes_back(spark):
    html = "<p>long é page</p>" * 1_200_000
    pages = spark.createDataFrame([(1, "u", html), (2, "u", html), (3, "u", None)], "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.read_archives(warc.write_archives(pages)).drop("payload").collect()}
    digest = base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()
    assert {k: (r.payload_bytes, r.payload_digest, r.record_type, r.valid) for k, r in got.items() if k < 3} == {
        1: (len(html.encode()), digest, "revisit", True), 2: (len(html.encode()), digest, "response", True)}
    assert got[1].refers_to == 2 and got[3].payload_bytes == 0
