"""The training-data operators against brute force, exact round trips and held-out accuracy, on small fixtures."""

import base64
import hashlib
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestary.llm import ann, chat, compression_quality, decontamination, packing, simhash, suffix_dedup, token_counts, toxicity, warc
from attestary.llm.components import connected_components
from attestary.llm.queries import QUERIES

public_tokenizers = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


def docs(spark, *texts, extra=False):
    """Ids count from 1; the last rows: a null text, an empty one, a null id, and a row twice."""
    rows = [(i, t) for i, t in enumerate(texts, 1)] + [(901, None), (902, ""), (None, "no id here at all"), (903, "twice the same row"), (903, "twice the same row")]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({"uid": F.lit("clash"), "key": F.lit(1), "hash": F.lit(2), "score": F.lit(None).cast("double")}) if extra else df


def corpus(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def brute_repeats(texts, length):
    """By text (spans count, removed, rest) with windows counted over all texts."""
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for b in raw:
        for p in range(len(b) - length + 1):
            seen[b[p : p + length]] = seen.get(b[p : p + length], 0) + 1
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(b), int(gone.sum()), runs, np.frombuffer(b, np.uint8)[~gone].tobytes()))
    return out


# ---- token counts


def test_token_counts(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    pieces = token_counts.read_vocabulary(path)

    def brute(word):
        b = word.encode()
        best = [(0.0, 0)] + [(-math.inf, 0)] * len(b)
        for e in range(1, len(b) + 1):
            best[e] = max((best[s][0] + pieces[b[s:e]], best[s][1] - 1) for s in range(e) if b[s:e] in pieces)
        return -best[-1][1]

    df = docs(spark, "The trie shares the theory of thesés", "a" * 300, "\U0001f642 x\ty", extra=True)
    got = token_counts.token_counts(df, path).collect()
    for r, d in zip(got, df.collect()):
        words = token_counts._SPLIT(d.text or "")
        assert "".join(words) == (d.text or "")
        assert (r.n_pretokens, r.n_tokens) == (len(words), sum(map(brute, words)))
    small = token_counts.token_counts(df, path, most=40).collect()  # a trie that starts anew all the time
    assert [r.n_tokens for r in small] == [r.n_tokens for r in got]
    assert token_counts.token_counts(df.limit(0), path).count() == 0


# ---- toxicity


def test_toxicity_chain_on_held_out_rows(spark):
    rng = np.random.default_rng(1)
    plain = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(600):
        words, bad = list(rng.choice(plain, 30)), i % 3 == 0
        if bad:
            words[5] = ["idiot", "scum", "pathetic", "verachtlich"][i // 3 % 4]
        rows.append((i, " ".join(words), int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = df.where("doc_id % 5 <> 0").select("doc_id", "toxic").unionByName(spark.createDataFrame([(None, 1), (7, None), (8, 5)], "doc_id long, toxic int"))
    got = toxicity.toxicity(df, labels).join(df.select("doc_id", "toxic"), "doc_id").where("doc_id % 5 = 0")
    assert got.where("is_toxic = (toxic = 1)").count() >= 0.97 * got.count()
    assert {c for c in got.columns if c.startswith("p_")} == {"p_insult", "p_degradation", "p_contempt", "p_unlisted", "p_toxic"}
    kept = toxicity.without_toxic(docs(spark, "you idiot", "w1 w2 w3", extra=True), labels.join(df.drop("toxic"), "doc_id", "left").select("doc_id", "toxic"))
    assert kept.columns[0] == "doc_id"


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.toxicity(docs(spark, "x"), none).where("is_toxic").count() == 0
    assert toxicity.toxicity(docs(spark, "x").limit(0), none).count() == 0


# ---- decontamination


def test_decontamination(spark):
    item = "In total Bob buys 12 apples at 3 dollars. How many dollars has Bob paid to Carol for the 12 apples?"
    other = item.replace("Bob", "Tom").replace("12", "15").replace("3", "4").replace("Carol", "Eve")
    broken = other.replace("the 15", "the 19")
    d = docs(spark, f"before. {item} after", f"So then. {other} yes", f"So. {broken}", "In total the apples are fine today", item.upper(), extra=True)
    bench = spark.createDataFrame([(5, item), (6, item), (7, other), (8, "too short"), (9, None), (None, "")], "item_id long, text string")
    got = {r.doc_id: r for r in decontamination.contaminated(d, bench).collect()}
    assert set(got) == {1, 2}
    assert got[1].exact and not got[2].exact and got[1].item_id == 5 and got[1].item_ids == [5, 6, 7]
    assert {r.doc_id for r in decontamination.without_benchmark(d, bench).collect()} == {3, 4, 5, 901, 902, 903, None}
    assert decontamination.contaminated(d, bench.limit(0)).count() == 0


def test_decontamination_compares_each_pattern_of_values(spark):
    one, two = "There are 2 cats and 2 dogs near the old barn today", "There are 3 cats and 5 dogs near the old barn today"
    apart, same = "Give me 3 apples and 5 pears from the lower shelf now", "Give me 4 apples and 4 pears from the lower shelf now"
    long = "We saw 7 boats " + " ".join(f"word{chr(97 + i)}" for i in range(60)) + " and 7 boats again"
    bench = spark.createDataFrame([(1, one), (2, two), (3, apart), (4, long)], "item_id long, text string")
    d = docs(spark, one, two, same, long.replace("and 7 boats", "and 8 boats"), same.replace("4 pears", "6 geese"))
    got = {(r.doc_id, r.item_id): r for r in decontamination.contaminated(d, bench).collect()}
    assert set(got) == {(1, 1), (2, 1), (3, 3), (4, 4)}
    assert got[2, 1].item_ids == [1, 2] and not got[2, 1].exact and got[2, 1].containment == 1
    assert not got[3, 3].exact and 0.8 <= got[4, 4].containment < 1


def test_decontamination_whatever_stops_and_capitals(spark):
    item = "Natalia sold clips to 48 friends in April. Natalia then sold half as many in May. How many did Natalia sell?"
    lines = "The shop is open.\nEach day 30 people come in.\nThen half of them leave.\nHow many people are still there?"
    bench = spark.createDataFrame([(1, item), (2, lines), (3, "Who Wrote The Great Gatsby Novel And When")], "item_id long, text string")
    d = docs(spark, item.replace("Natalia", "Anna"), item.replace(". ", " "), lines.replace(".\n", " ").replace("?", ""), lines.lower(), item.lower(),
             "Our Friends From The Old Green House Are Here", item.replace("sold", "took").replace("many", "few"))
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(d, bench).collect()}
    assert got == {(1, 1), (2, 1), (3, 2), (4, 2), (5, 1)}


def test_decontamination_finds_all_verbatim_items(spark):
    d, b = corpus(spark), spark.read.parquet(f"{SF}/benchmark.parquet")
    want = {(r.doc_id, r.item_id) for r in b.join(d, d.text.contains(b.text)).collect()}
    got = {(r.doc_id, i) for r in decontamination.contaminated(d, b).collect() for i in r.item_ids}
    assert want <= got and len(got) <= len(want) + 1


# ---- packing


def test_packing_holds_every_id_once(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    texts = ["café it's  12'30 x\x00y", "İstanbul Σας naïve ﬁne éa", "<|endoftext|> a<|b", "日本語 \U0001f642", "word " * 5000]
    df = docs(spark, *texts, extra=True)
    for capacity, grain in ((2048, 64), (16, 2)):
        got = [r for r in packing.pack(df, path, capacity, grain).collect() if r.doc_id is not None]
        for d in df.where("doc_id < 903").collect():
            ids = np.array([*tok.encode(d.text or "", add_special_tokens=False).ids, 1], "<u4")
            mine = sorted((r for r in got if r.doc_id == d.doc_id), key=lambda r: r.start)
            assert b"".join(bytes(r.ids) for r in mine) == ids.tobytes()
            assert all(r.doc_tokens == len(ids) for r in mine)
        by = {}
        for r in packing.pack(df, path, capacity, grain).collect():
            by.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for parts in by.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= capacity


def test_packing_pads_little(spark):
    out = packing.pack(corpus(spark), public_tokenizers.path("word_bpe_49k.json")).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    n = np.array([r.n for r in out])
    assert np.where(n & (n - 1), 2048 - n, 0).sum() < 0.01 * n.sum()


# ---- chat


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "\\### Assistant: </turn> ok"), (1, 1, "assistant", "\\e\\h ### x</turn>"), (1, 2, "assistant", None), (1, 3, "us:er\n", "a\n### b"),
            (2, None, None, None), (None, 1, "assistant", "y"), (3, 1, "user", "tie b"), (3, 1, "user", "tie a"), (3, 1, "user", "tie a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    f = chat.format_conversations(df)
    back = {r.conv_id: r for r in chat.read_conversations(f).collect()}
    turns = lambda c: [(t.role, t.text) for t in back[c].turns]
    assert turns(1) == [(r, t or "") for _, _, r, t in rows[:4]]
    assert turns(2) == [("", "")] and turns(3) == [("user", "tie a"), ("user", "tie a"), ("user", "tie b")]
    assert back[1].loss_text == "\\e\\h ### x</turn>" and back[2].loss_text == "" and back[None].loss_text == "y"
    for r in f.collect():
        assert sum(m.chars for m in r["mask"]) == len(r.formatted)
    assert chat.format_conversations(df.limit(0)).count() == 0


# ---- WARC


def test_warc_round_trip(spark):
    rows = [(1, "http://a\r\nb", "xx"), (2, None, "xx"), (3, "u", "yé"), (4, "u", None), (None, "u", "xx"), (5, "v", ""), (2, "again", "xx"), (6, "w", "z" * 200_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("last", F.lit("clash"))
    for least in (0, 3):
        got = warc.read_archives(warc.write_archives(df, least_bytes=least, most_bytes=300)).collect()
        assert len(got) == len(rows) and all(r.valid for r in got)
        for r in got:
            html = next((h or "").encode() for i, _, h in rows if i == r.page_id)
            assert (r.payload_bytes, r.payload_digest) == (len(html), base64.b32encode(hashlib.sha1(html).digest()).decode())
            assert (r.payload is None) == (r.record_type == "revisit") and (r.payload is None or bytes(r.payload) == html)
        kinds = sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in got)
        if least:
            assert all(k[1] == "response" for k in kinds)
        else:
            assert kinds == [(0, "revisit", 2), (1, "revisit", 2), (2, "response", 0), (2, "response", 0), (3, "response", 0), (4, "revisit", 5), (5, "response", 0), (6, "response", 0)]
    assert warc.read_archives(warc.write_archives(df.limit(0))).count() == 0


def test_warc_reader_rejects_damage():
    import io

    whole = zlib.compressobj(6, zlib.DEFLATED, 31)
    data = whole.compress(warc.record(1, "u", b"payload", None)) + whole.flush()
    assert [warc.read_record(m)["payload"] for m in warc.members(io.BytesIO(data * 3))] == [b"payload"] * 3
    with pytest.raises(ValueError):
        list(warc.read_record(m) for m in warc.members(io.BytesIO(data[:-12])))
    bad = warc.record(1, "u", b"payload", None).replace(b"\r\n\r\npayload", b"\r\n\r\npaylaod")
    assert not warc.read_record(iter([bad]))["valid"]
    with pytest.raises(ValueError):
        warc.read_record(iter([bad[:-6]]))


# ---- SimHash


def brute_components(ids, prints, distance):
    parent = list(range(len(ids)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= distance):
            parent[find(i)] = find(int(j))
    least = {}
    for i in range(len(ids)):
        least[find(i)] = min(least.get(find(i), 10**18), ids[i])
    return {ids[i]: least[find(i)] for i in range(len(ids))}


def test_simhash_equals_brute_force(spark):
    d = corpus(spark)
    got = {r.doc_id: r for r in simhash.near_duplicates(d).collect()}
    rows = d.collect()
    prints = np.array([simhash.fingerprint((r.text or "").encode()) for r in rows], np.uint64)
    want = brute_components([r.doc_id for r in rows], prints, 4)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(got[r.doc_id].fp % 2**64 == int(p) for r, p in zip(rows, prints))


@pytest.mark.parametrize("block", [8192, 40])
def test_simhash_links_of_clusters(spark, block):
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 2**63, 12, dtype=np.uint64)
    prints = [s for s in seeds]
    for s in seeds[:4]:
        x = s
        for _ in range(60):  # chains: neighbours are near, ends are not
            x = x ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, 3, replace=False)))
            prints.append(x)
    prints = np.unique(np.array(prints))
    df = spark.createDataFrame([(int(p.view(np.int64)),) for p in prints], "fp long")
    roots = {r.node: r.root for r in connected_components(simhash.links(df, 4, most_in_block=block)).collect()}
    want = brute_components(list(range(len(prints))), prints, 4)
    group = lambda i: roots.get(int(prints[i].view(np.int64)), int(prints[i].view(np.int64)))
    for i in range(len(prints)):
        for j in range(i):
            assert (group(i) == group(j)) == (want[i] == want[j])


def test_simhash_thresholds_keep_the_pigeonhole_sum():
    ones, corr = np.full(64, 0.5), np.eye(64)
    for n in (10, 10**5, 10**9, 10**12):
        groups, t = simhash.plan(n, ones, corr, 4)
        assert sum(t) == 4 - len(groups) + 1 and sorted(b for g in groups for b in g) == list(range(64))


def test_simhash_edge_cases(spark):
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs(spark, "a b c d e f", "A  b\tc d e f", extra=True)).collect()}
    assert got[1] == got[2] == 1 and got[901] == got[902] == 901 and got[903] == 903
    kept = simhash.deduplicated(docs(spark, "a b c d e f", "a b c d e f", extra=True))
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 901, 903]
    assert simhash.near_duplicates(docs(spark).limit(0)).count() == 0


def test_components_of_a_long_path(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(5, 5), (None, 3)], "a long, b long")
    assert {(r.node, r.root) for r in connected_components(e).collect()} == {(i, 0) for i in range(301)}


# ---- nearest neighbours


def test_ann_recall_and_edges(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((1500, 24))
    base[1000:1020] = base[0]  # copies: ties
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)]
    rows += [(5000, None), (5050, [0.0] * 24), (5100, [float("nan")] + [1.0] * 23), (5150, [None] + [1.0] * 23), (5200, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = df.where("vec_id % 50 = 0")
    for block in (32_768, 400):
        got = {}
        for r in ann.nearest(df, asked, 5, block_rows=block, query_rows=7).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert set(got) == set(range(0, 1500, 50))
        hits = 0
        for q, found in got.items():
            s = ann.cosine(base, base[q])
            order = [int(i) for i in np.lexsort((np.arange(len(s)), -s)) if i != q][:5]
            hits += len(set(order) & {v for v, _ in found})
            assert all(abs(score - s[v]) < 1e-12 for v, score in found)
        assert hits >= 0.9 * 5 * len(got)
        assert [v for v, _ in got[0]] == [1000, 1001, 1002, 1003, 1004]
    assert ann.nearest(df.limit(0), asked).count() == 0


def test_ann_repeated_ids_take_one_place(spark):
    rng = np.random.default_rng(6)
    base = rng.standard_normal((300, 16))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)]
    rows += [(7, [float(x) for x in base[0] + 0.01 * (j + 1) * rng.standard_normal(16)]) for j in range(10)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    scores = {}
    for i, v in rows[1:]:
        scores[i] = max(scores.get(i, -2.0), float(ann.cosine(np.array([v]), base[0])[0]))
    want = sorted(scores, key=lambda i: (-scores[i], i))[:5]
    for block in (32_768, 60):
        got = ann.nearest(df, df.where("vec_id = 0"), 5, least=0.01, width=4.0, block_rows=block).orderBy("rank").collect()
        assert [r.vec_id for r in got] == want and want[0] == 7
        assert all(abs(r.score - scores[r.vec_id]) < 1e-12 for r in got)


# ---- suffix arrays


def test_suffix_levels_against_counting():
    rng = np.random.default_rng(2)
    for _ in range(10):
        family, places = suffix_dedup.SuffixLevels(20), []
        family.CHUNK = int(rng.integers(3, 60))
        common = rng.integers(97, 99, 300).astype(np.uint8)
        for _ in range(8):
            s = int(rng.integers(0, 100))
            data = np.concatenate([rng.integers(97, 101, int(rng.integers(20, 200))).astype(np.uint8), common[s : s + 60]])
            places.append(family.add(data, np.arange(len(data) - 19)))
        places = np.concatenate(places)
        words = [family.pool[p : p + 20].tobytes() for p in places]
        count = {w: words.count(w) for w in set(words)}
        assert family.seen[places].tolist() == [count[w] > 1 for w in words]
        assert len(family.levels) <= math.log2(len(places)) + 1


def test_repeats_equal_brute_force(spark):
    d = corpus(spark)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(d).collect()}
    rows = d.collect()
    assert got == dict(zip([r.doc_id for r in rows], brute_repeats([r.text for r in rows], 200)))


def test_repeats_in_odd_texts(spark):
    rng = np.random.default_rng(7)
    word = lambda n: "".join(rng.choice(list("abé "), n))
    share, periodic = word(230), "xyz" * 200
    texts = [word(100) + share + word(50), share + word(300), periodic, word(400) + periodic[5:300], "a" * 199, "b" * 201, "c" * 1000, word(90) + share[10:225]]
    df = docs(spark, *texts, extra=True)
    rows = df.collect()
    for hot in (2000, 1):  # with 1, all shared keys are split again
        spans = suffix_dedup.repeated_spans(df.select(F.xxhash64("doc_id", suffix_dedup.utf8("text")).alias("uid"), suffix_dedup.utf8("text").alias("text")), hot=hot)
        removed = {r.uid: sorted({b for s in r.spans for b in range(s.lo, s.hi)}) for r in spans.collect()}
        want = brute_repeats([r.text for r in rows], 200)
        ids = [r[0] for r in df.select(F.xxhash64("doc_id", suffix_dedup.utf8("text"))).collect()]
        assert [len(removed.get(i, [])) for i in ids] == [w[1] for w in want]
    got = suffix_dedup.remove_repeats(df).collect()
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == sorted(brute_repeats([r.text for r in rows], 200))
    kept = {r.doc_id: r.text for r in suffix_dedup.without_repeats(df).collect()}
    assert kept[5] == "a" * 199 and 7 not in kept and 901 in kept and kept[901] is None
    assert suffix_dedup.remove_repeats(df.limit(0)).count() == 0


# ---- quality


def test_quality_on_held_out_rows(spark):
    d, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = compression_quality.quality_scores(d, labels)
    for r in got.limit(20).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    out = got.where("held_out").join(labels, "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in out]) > 0.85
    assert got.count() == d.count()


def test_quality_edges(spark):
    labels = spark.createDataFrame([(1, 1), (2, None), (3, 7), (None, 0)], "doc_id long, quality int")
    got = compression_quality.quality_scores(docs(spark, "good text", "x", extra=True), labels).collect()
    assert len(got) == 7 and all(0 <= r.score <= 1 for r in got)
    assert compression_quality.quality_scores(docs(spark).limit(0), labels.limit(0)).count() == 0


def test_quality_learns_from_whole_texts(spark):
    rng = np.random.default_rng(9)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, 7)) for _ in range(600)]
    text = lambda lo, hi, size: " ".join(words[i] for i in rng.integers(lo, hi, size // 8))
    same = text(0, 200, 101_000)
    rows = [(i, f"{same} {text(200, 400, 40_000) if i % 2 else text(400, 600, 40_000)}", i % 2) for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = compression_quality.train(d, d.select("doc_id", "quality"))
    asked = spark.createDataFrame([(text(200, 400, 4000),), (text(400, 600, 4000),)], "text string")
    good, bad = (r.s for r in asked.select(compression_quality.score_column(F.col("text"), model).alias("s")).collect())
    assert good > 0.8 and bad < 0.2


# ---- queries


@pytest.mark.parametrize("name", ["op1_token_counts", "op2_toxicity", "op4_packing", "op6_warc", "op8_ann"])
def test_queries_cover_their_tables(spark, name):
    out = QUERIES[name](spark, SF)
    if name == "op8_ann":
        assert out.select("query_id").distinct().count() == spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id % 50 = 0").count()
    else:
        key = "page_id" if name == "op6_warc" else "doc_id"
        table = "pages" if name == "op6_warc" else "documents"
        assert out.select(key).distinct().count() == spark.read.parquet(f"{SF}/{table}.parquet").count()
