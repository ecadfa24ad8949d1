"""More of the training-data operators: plain loops beside them, hot groups, rows that share an id, odd inputs of every stage."""

import math
import re

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from attestary.llm import ann, compression_quality, decontamination, packing, simhash, suffix_dedup, toxicity, warc
from attestary.llm.common import scratch

from .test_llm import brute_repeats, docs

public_tokenizers = pytest.importorskip("public_tokenizers")


# ---- toxicity


def mixed(n=900, seed=4):
    """Toxic if a text has words of one of two kinds but not of both, in two languages."""
    rng = np.random.default_rng(seed)
    plain, kinds = [f"w{i}" for i in range(120)], (["grobal", "üblach", "schuft"], ["tonto", "ñiño", "vileza"])
    rows = []
    for i in range(n):
        has = [rng.random() < 0.4 for _ in kinds]
        words = [*rng.choice(plain, 25), *[str(rng.choice(k)) for k, own in zip(kinds, has) if own for _ in range(2)]]
        rows.append((" ".join(words), int(has[0] != has[1])))
    return rows


def test_kinds_come_from_the_texts_and_links_add_to_the_verdict():
    rows = mixed()
    train, held = rows[:600], rows[600:]
    right = lambda model: np.mean([(p[-1] >= 0.5) == y for p, (_, y) in zip(toxicity.probabilities([t for t, _ in held], model), held)])
    chain, alone = toxicity.fit(train, 2), toxicity.fit(train, {})
    assert chain.names == ["kind_1", "kind_2", "toxic"]
    links = chain.weights[-1][len(chain.vocabulary) : -1]
    assert np.abs(links).max() > 0.5 and right(chain) > right(alone) + 0.03
    by_kind = [np.mean([p[k] for p, (t, y) in zip(toxicity.probabilities([t for t, _ in held], chain), held) if y and word in t]) for k in (0, 1) for word in ("schuft", "tonto")]
    assert abs(by_kind[0] - by_kind[1]) > 0.3 and (by_kind[0] - by_kind[1]) * (by_kind[2] - by_kind[3]) < 0


def test_probabilities_equal_a_plain_loop():
    model = toxicity.fit(mixed(300), 3)
    texts = ["", "grobal w1 W2 schuft", "tonto " * 3000 + "w7", None, "w1 w1 w1"]
    for text, got in zip(texts, toxicity.probabilities(texts, model)):
        has = {f for w in set(re.findall(r"\w+", (text or "").lower())) for f in [w, *("^" + w[:n] for n in (4, 5, 6) if len(w) >= n)]}
        earlier = []
        for w, p in zip(model.weights, got):
            z = w[-1] + sum(w[i] for f, i in model.vocabulary.items() if f in has) + sum(a * b for a, b in zip(w[len(model.vocabulary) : -1], earlier))
            earlier.append(1 / (1 + math.exp(-z)))
            assert abs(earlier[-1] - p) < 1e-9


def test_toxicity_of_odd_rows(spark):
    rows = [(i, t, y) for i, (t, y) in enumerate(mixed(200))]
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(0, 1), (None, 1), (3, 9)], "doc_id long, toxic int")
    known = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    odd = docs(spark, "schuft " * 20_000, extra=True).withColumns({"toxic": F.lit("clash"), "p_toxic": F.lit(1)})
    every = known.withColumns({c: F.lit(None) for c in odd.columns[2:]}).unionByName(odd)
    got = toxicity.toxicity(every, labels, categories=2)
    assert got.count() == every.count() and got.where("doc_id = 903").count() == 2
    kept = toxicity.without_toxic(every, labels, categories=2)
    offset = {r.p_toxic for r in got.where("doc_id in (901, 902)").collect()}  # both have no words
    assert kept.columns == every.columns and len(offset) == 1 and kept.where("doc_id in (901, 902)").count() == (2 if offset.pop() < 0.5 else 0)
    assert toxicity.without_toxic(every.limit(0), labels).count() == 0


# ---- decontamination


def test_values_agree_over_words_that_were_put_in(spark):
    item = "A boy has 12 marbles in his bag and gives his sister some of the 12 marbles before lunch"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    good = item.replace("12", "15")
    bad = "A boy has 15 marbles in his bag and then gives his sister some of the 99 marbles before lunch"
    d = docs(spark, good, bad, bad.replace("and then", "and"), good.replace("and gives", "and then gives"), extra=True)
    got = {r.doc_id: r.containment for r in decontamination.contaminated(d, bench, least=0.6).collect()}
    assert got[1] == 1.0 and 2 not in got and 3 not in got and 0.6 <= got[4] < 1


def test_no_copy_hides_another(spark):
    item = "A boy has 12 marbles in his bag and gives his sister some of the 12 marbles before lunch"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    bad = item.replace("has 12", "has 15").replace("the 12", "the 99")
    other = item.replace("12", "40")
    put_in = other.replace("and gives", "and then also gives")
    worn = item.replace("lunch", "supper")
    texts = [f"{bad} {item}", f"{item} {bad}", f"{bad} {bad} {other} {bad}", f"{bad}. So {put_in}. {bad}", f"{put_in} {bad}", f"{bad} {bad} {bad}", f"{bad} {worn}", f"{worn} {bad}", f"{bad} {bad.replace('99', '98')}"]
    got = {r.doc_id: (r.containment, r.exact) for r in decontamination.contaminated(docs(spark, *texts), bench).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 7, 8}
    assert got[1] == got[2] == (1.0, True) and got[3] == (1.0, False) and got[7] == got[8] and 0.8 <= got[7][0] < 1


def test_readings_equal_brute_force():
    """Every set of diagonals: none counts more than the best reading where one copy is whole, and each reading is such a set."""
    rng = np.random.default_rng(12)
    for _ in range(300):
        of, n = int(rng.integers(4, 12)), int(rng.integers(1, 6))
        slots = {i: f"v{rng.integers(3)}" for i in range(of) if rng.random() < 0.6}
        lines = []
        for diagonal in sorted(rng.choice(60, n, replace=False).tolist()):
            value = {v: f"{v}" if rng.random() < 0.5 else f"x{rng.integers(2)}" for v in set(slots.values())}
            windows = [(i, [(slots[i], value[slots[i]] if rng.random() < 0.8 else "y")] if i in slots else []) for i in range(of) if rng.random() < 0.9]
            lines.append((diagonal, windows))

        def counted(chosen):
            item, doc, kept = set(), set(), []
            for diagonal, windows in chosen:
                new = [w for w in windows if w[0] not in item and w[0] + diagonal not in doc]
                item |= {w[0] for w in new}
                doc |= {w[0] + diagonal for w in new}
                kept += new
            seen = {}
            for _, pairs in kept:
                for a, b in pairs:
                    seen.setdefault(a, set()).add(b)
            return sum(all(len(seen[a]) == 1 for a, _ in pairs) for _, pairs in kept)

        near = [sorted(lines, key=lambda x: (abs(x[0] - seed), x[0]))[:k] for seed, _ in lines for k in range(1, n + 1)]
        got = decontamination.best_reading(lines, of)[0]
        assert got == max(map(counted, near)) and got >= max(counted([x]) for x in lines)


def test_planted_copies_are_found_whatever_stands_around(spark):
    """Random items with repeated values; each document has broken copies, and every second one a consistent copy too."""
    rng = np.random.default_rng(13)
    word = lambda: "".join(rng.choice(list("bcdfglmnprst"), 4))
    items, texts, want = [], [], set()
    for k in range(6):
        words = [word() for _ in range(26)]
        for at in (2, 9, 16, 23):
            words[at] = "{}"
        items.append(" ".join(words).format(*["7"] * 4))
        for j in range(8):
            broken = [" ".join(words).format(*rng.permutation([21, 22, 23, 24])) for _ in range(int(rng.integers(0, 4)))]
            parts = [*broken]
            if j % 2:
                good = " ".join(words).format(*[str(rng.integers(30, 90))] * 4).split()
                if j % 4 == 1:
                    good[13:13] = [word()]
                parts.insert(int(rng.integers(0, len(parts) + 1)), " ".join(good))
                want.add((len(texts) + 1, k))
            texts.append(" ".join([word(), *parts, word()]))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs(spark, *texts), bench, least=0.75).collect()}
    assert got == want


def test_short_items_and_bare_windows(spark):
    bench = spark.createDataFrame([(1, "Grave Wine Harbor"), (2, "12 30 45 60 75 90"), (3, "5 km"), (4, "...")], "item_id long, text string")
    d = docs(spark, "the grave wine HARBOR lay still", "the grave wine and harbor", "so 12 30 45 60 75 90 it goes", "so 13 31 46 61 76 91 it goes", "it is 5 km away", "it is 6 km away", "x " * 30_000)
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(d, bench).collect()}
    assert got == {(1, 1), (3, 2), (5, 3)}


def test_containment_equals_a_plain_loop(spark):
    rng = np.random.default_rng(11)
    words = [f"{a}{b}" for a in "bcdfg" for b in ("ale", "ine", "our")]
    text = lambda n: " ".join(rng.choice(words, n))
    items = [text(30) for _ in range(4)]
    texts = []
    for k in range(12):
        part = items[k % 4].split()
        for p in rng.choice(30, k // 4 * 2, replace=False):
            part[p] = "changed"
        texts.append(f"{text(10)} {' '.join(part)} {text(10)}")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.containment for r in decontamination.contaminated(docs(spark, *texts), bench, least=0.5).collect()}

    def brute(item, doc):  # the best single diagonal, and what other ones add
        a, b = item.split(), doc.split()
        hits = {}
        for i in range(len(a) - 4):
            for j in range(len(b) - 4):
                if a[i : i + 5] == b[j : j + 5]:
                    hits.setdefault(j - i, []).append(i)
        at, used = set(), set()
        for shift, places in sorted(hits.items(), key=lambda x: (-len(x[1]), x[0])):
            free = [i for i in places if i not in used and i + shift not in at]
            used |= set(free)
            at |= {i + shift for i in free}
        return len(used) / (len(a) - 4)

    want = {(d, i): c for d, t in enumerate(texts, 1) for i, item in enumerate(items) if (c := brute(item, t)) >= 0.5}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


# ---- rows that share an id


def test_rows_with_one_id_are_judged_by_their_own_text(spark):
    rows = [(1, "the same words in this row again"), (2, "the same words in this row again"), (2, "quite another text that stands for itself here"),
            (3, "this row holds Some Benchmark Item Of Seven Words"), (3, "this one is clean and it stays as it is"), (None, "no id but clean text of its own"), (None, "the same words in this row again")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row_name", F.lit("clash"))
    kept = simhash.deduplicated(d)
    assert sorted((r.doc_id or 0, r.text[:12]) for r in kept.collect()) == [(0, "no id but cl"), (1, "the same wor"), (2, "quite anothe"), (3, "this one is "), (3, "this row hol")]
    assert kept.columns == d.columns
    bench = spark.createDataFrame([(1, "some benchmark item of seven words")], "item_id long, text string")
    clean = decontamination.without_benchmark(d, bench)
    assert clean.count() == 6 and clean.where("doc_id = 3").count() == 1 and clean.columns == d.columns


# ---- suffix arrays


def test_hottest_keys_are_counted_by_window(spark):
    rng = np.random.default_rng(5)
    word = lambda n: "".join(rng.choice(list("abcé "), n))
    share = word(260)
    texts = [word(60) + share + word(60) for _ in range(8)] + [word(70) + share[30:238] + word(5), word(500), "q" * 700]
    df = docs(spark, *texts, extra=True)
    want = brute_repeats([r.text for r in df.collect()], 200)
    base = df.select(F.monotonically_increasing_id().alias("uid"), suffix_dedup.utf8("text").alias("text")).collect()
    base = spark.createDataFrame([(r.uid, r.text) for r in base], "uid long, text binary")
    for hot, hottest in ((2000, 20_000), (1, 1), (1, 3), (0, 0)):
        removed = {r.uid: {b for s in r.spans for b in range(s.lo, s.hi)} for r in suffix_dedup.repeated_spans(base, hot=hot, hottest=hottest).collect()}
        assert [len(removed.get(r.uid, ())) for r in base.orderBy("uid").collect()] == [w[1] for w in want]


@pytest.mark.parametrize("size", [256, 1000])
def test_long_texts_are_worked_on_in_stretches(size, monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(size)
    text = rng.choice(np.frombuffer(b"ab c", np.uint8), 5000)
    text[3000:3600] = text[900:1500]
    batch = pa.RecordBatch.from_arrays([pa.array([7, 8]), pa.array([text.tobytes(), b"x" * 30], pa.binary())], names=["uid", "text"])
    whole = {p: k for b in suffix_dedup._runs(200, 64)([batch]) for u, s, n, k in zip(*[b.column(c).to_pylist() for c in ("uid", "start", "n", "key")]) for p in range(s, s + n) if u == 7}
    monkeypatch.setattr(suffix_dedup, "_SLICE", size)
    cut = [(p, k) for b in suffix_dedup._runs(200, 64)([batch]) for s, n, k in zip(*[b.column(c).to_pylist() for c in ("start", "n", "key")]) for p in range(s, s + n)]
    assert len(cut) == 4801 and dict(cut) == whole


def test_a_text_above_16_mb(spark):
    rng = np.random.default_rng(16)
    text = rng.integers(97, 123, 17 << 20).astype(np.uint8)
    text[5_000_000:5_001_000] = text[100:1100]
    text[(1 << 19) - 150 : (1 << 19) + 150] = text[9_000_000:9_000_300]
    d = spark.createDataFrame([(1, text.tobytes().decode()), (2, text[16_000_000:16_000_250].tobytes().decode()), (3, None)], "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(d).drop("kept").collect()}
    assert got == {1: (17 << 20, 2 * 1000 + 2 * 300 + 250, 5), 2: (250, 250, 1), 3: (0, 0, 0)}


def test_shards_are_never_parted(spark, monkeypatch):
    rng = np.random.default_rng(6)
    share = "".join(rng.choice(list("abc "), 900))
    texts = ["".join(rng.choice(list("abc "), 300)) + share[i * 20 : i * 20 + 400] for i in range(20)]
    import pyarrow as pa

    index = suffix_dedup._index(200)
    raw = [t.encode() for t in texts]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([1] * 20), pa.array(sorted(i % 3 for i in range(20))), pa.array(range(20)), pa.array([0] * 20), pa.array([False] * 20), pa.array(raw, pa.binary())],
        names=["key", "shard", "kind", "first", "repeated", "text"],
    )
    rows = lambda: sorted(tuple(r.values()) for b in index([batch.slice(0, 7), batch.slice(7)]) for r in b.to_pylist())
    whole = {}
    for part in range(3):
        for i, r in zip([i for i in range(20) if sorted(k % 3 for k in range(20))[i] == part], brute_repeats([texts[i] for i in range(20) if sorted(k % 3 for k in range(20))[i] == part], 200)):
            whole[i] = r[1]
    monkeypatch.setattr(suffix_dedup, "_FAMILY", 3000)
    got = {}
    for _, kind, lo, hi in rows():
        got.setdefault(kind, set()).update(range(lo, hi + 199))
    assert {i: len(s) for i, s in got.items()} == {i: n for i, n in whole.items() if n}


# ---- nearest neighbours


def test_ann_prunes_and_finds_on_the_given_embeddings(spark):
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = ann.nearest(v, v.where("vec_id % 50 = 0"), 5, block_rows=1200).collect()
    rows = v.collect()
    x, ids = np.array([r.embedding for r in rows], float), np.array([r.vec_id for r in rows])
    found, work = {}, {}
    for r in got:
        found.setdefault(r.query_id, set()).add(r.vec_id)
        work[r.query_id] = r.verified
    hits = 0
    for q in found:
        s = ann.cosine(x, x[ids == q][0])
        hits += len(found[q] & {int(ids[i]) for i in np.lexsort((ids, -s)) if ids[i] != q} & set(ids[np.lexsort((ids, -s))][:6].tolist()))
    assert hits >= 0.9 * 5 * len(found)
    assert np.mean(list(work.values())) < 0.3 * len(rows)


def test_ann_of_odd_rows(spark):
    rows = [(50, [1.0, 0.0]), (51, [0.9, 0.1]), (51, [0.0, 1.0]), (52, [float("inf"), 1.0]), (53, [-1.0, 0.0]), (54, [float("-inf"), float("nan")]), (None, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"part": F.lit("x"), "block": F.lit("y"), "score": F.lit(0), "bound": F.lit(2)})
    for block in (8192, 1):
        got = ann.nearest(df, df.where("vec_id = 50"), 5, block_rows=block).orderBy("rank").collect()
        assert [(r.rank, r.vec_id) for r in got] == [(1, 51), (2, 53)]  # fewer candidates than asked for


# ---- quality


def test_sizes_and_scores_equal_a_plain_loop(spark):
    rng = np.random.default_rng(2)
    text = lambda a: " ".join(rng.choice([f"{a}{i}" for i in range(40)], 120)).encode()
    model = compression_quality.fit([(text("g"), 1) if i % 2 else (text("b"), 0) for i in range(80)])
    texts = ["", "g1 g2 g3 " * 400, "b1 b2 b3", "é" * 5000, None]
    sizes = []
    for t in texts:
        raw, total = (t or "").encode(), [0, 0]
        for k, d in enumerate((model.good, model.bad)):
            for lo in range(0, len(raw), 512):
                coder = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False)
                total[k] += len(coder.compress(raw[lo : lo + 512]))
        sizes.append((total[1] - total[0]) / sum(total) if raw else 0.0)
    df = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    got = [r.s for r in df.select(compression_quality.score_column(F.col("text"), model).alias("s")).collect()]
    assert all(abs(g - 1 / (1 + math.exp(-(model.slope * d + model.offset)))) < 1e-9 for g, d in zip(got, sizes))


# ---- stages and scratch


def test_stages_take_odd_and_empty_tables(spark, tmp_path):
    d = docs(spark, "plain words of a text that is here", "z" * 300_000, extra=True).withColumns({c: F.lit("x") for c in ("row", "raw", "spans", "template", "fp", "contaminated_id", "kept_id")})
    spark.createDataFrame([(1, 0, 1), (None, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "an item that nobody holds at all"), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for table in (d, d.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, str(tmp_path))
            n = out.count()
            assert out.columns == table.columns or name == "packing"
            assert (n == 0) == table.isEmpty(), name


def test_long_texts_are_packed_in_stretches(spark, monkeypatch):
    import pyarrow as pa

    words = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"), most=50)
    texts = ["word's, 12 café  x\t" * 40, "a" * 700, "", " \n ", "K × ÷ <|endoftext|> b", "naïve über-ß 3,5 <| k"]
    want = [words.whole.encode(t, add_special_tokens=False).ids for t in texts]
    for size in (1 << 21, 100):
        monkeypatch.setattr(packing, "_SLICE", size)
        assert [x.tolist() for x in words.ids(pa.array([t.encode() for t in texts], pa.binary()))] == want


def test_a_cluster_must_name_its_folder(spark, monkeypatch):
    class Session:
        conf = type("C", (), {"get": lambda self, k, d: None})()
        sparkContext = type("S", (), {"master": "spark://host:7077"})()

    with pytest.raises(ValueError):
        scratch(Session(), "x")


def test_archives_of_no_rows(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.write_archives(empty)).count() == 0
