"""Merkle manifest, hard negatives and SentencePiece: brute force, odd rows, several blocks."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from attestary.llm import hard_negatives, merkle, pieces

from .test_llm import docs

public_tokenizers = pytest.importorskip("public_tokenizers")


# ---- Merkle manifest


def digest(*nodes):
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def brute_tree(nodes):
    """(root, by leaf: [(sibling or None, stands left)])."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for path, i in zip(paths, at):
            path.append((level[i ^ 1] if i ^ 1 < len(level) else None, i % 2 == 1))
        level = [digest(*level[i : i + 2]) for i in range(0, len(level), 2)]
        at = [i // 2 for i in at]
    return level[0], paths


def brute_manifest(rows):
    """rows (doc_id, lang, leaf hex) -> sorted (lang, doc_id, leaf, subroot, root, proof)."""
    langs = sorted({r[1] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    by = [sorted((r for r in rows if r[1] == lang), key=lambda r: (r[0] is not None, r[0] or 0, r[2])) for lang in langs]
    trees = [brute_tree([r[2] for r in own]) for own in by]
    root, crown = brute_tree([t[0] for t in trees])
    out = []
    for own, (subroot, paths), upper in zip(by, trees, crown):
        for r, path in zip(own, paths):
            out.append((r[1] or "", r[0] or 0, r[2], subroot, root, digest(*[s for s, _ in path + upper if s])))
    return sorted(out)


@pytest.mark.parametrize("block", [2, 8, 4096])
def test_manifest_equals_plain_trees(spark, block):
    rng = random.Random(block)
    rows = [(rng.randint(1, 60), lang, hashlib.sha256(str(rng.randint(0, 90)).encode()).hexdigest()) for lang, n in (("en", 75), ("é", 1), ("de", 33), (None, 16), ("fr", 5)) for _ in range(n)]
    rows += [(None, "en", rows[0][2]), rows[3], rows[3]]
    df = spark.createDataFrame(rows, "doc_id long, lang string, leaf string").withColumn("leaf", F.unhex("leaf")).withColumns({"position": F.lit("mine"), "total": F.lit(None).cast("int"), "tree": F.col("doc_id")})
    out = merkle.checked(merkle.manifest(df, block=block))
    assert out.where("not verified or position <> 'mine' or not (tree <=> doc_id)").isEmpty()
    got = sorted((r.lang or "", r.doc_id or 0, *[bytes(r[c]).hex() for c in ("leaf", "subroot", "root", "proof")]) for r in out.collect())
    assert got == brute_manifest(rows)


def test_a_changed_leaf_is_not_verified(spark):
    d = docs(spark, "a", "b", "z" * 3_000_000, extra=True).withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.length("text")})
    own = lambda text: merkle.leaf(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    rows = d.select("doc_id", "lang", own(F.col("text")).alias("leaf"), own(F.when(F.col("doc_id") == 2, "B").otherwise(F.col("text"))).alias("seen"))
    out = merkle.checked(merkle.manifest(rows, block=2), "seen").collect()
    assert len(out) == d.count() and {r.doc_id for r in out if not r.verified} == {2}
    want = hashlib.sha256(b"1:1-2:en1:11:a").hexdigest()
    assert [bytes(r.leaf).hex() for r in out if r.doc_id == 1] == [want]


def test_manifest_of_no_rows_and_of_one(spark):
    one = spark.createDataFrame([(1, None, b"x" * 32)], "doc_id long, lang string, leaf binary")
    assert merkle.manifest(one.limit(0)).count() == 0
    r = merkle.checked(merkle.manifest(one)).first()
    assert r.root == r.subroot == r.leaf and r.witness == b"" and r.verified
    with pytest.raises(ValueError):
        merkle.manifest(one, block=6)


# ---- hard negatives


def test_strassen_is_exact():
    rng = np.random.default_rng(1)
    for n, k, m in ((1, 1, 1), (33, 64, 70), (97, 65, 40), (130, 33, 200), (64, 64, 64), (0, 5, 7), (40, 0, 40)):
        for most in (300, 1 << 29):
            a, b = rng.integers(-most, most, (n, k)), rng.integers(-most, most, (k, m))
            want = np.array([[sum(int(x) * int(y) for x, y in zip(row, col)) for col in b.T.tolist()] for row in a.tolist()], dtype=object).reshape(n, m)
            assert (hard_negatives.product(a, b).astype(object) == want).all()


def brute_negatives(rows, positives=5, negatives=3):
    ok = [(i, lab, [int(np.floor(256 * float(x))) for x in v]) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    least = {}
    for r in ok:
        least[r[0]] = min(least.get(r[0], r), r)
    ok, out = list(least.values()), []
    for a in (r for r in ok if r[0] % 50 == 0):
        scored = sorted((-sum(x * y for x, y in zip(a[2], r[2])), r[0], r[1]) for r in ok if r[0] != a[0] and len(r[2]) == len(a[2]))
        for s, p, _ in [x for x in scored if x[2] == a[1]][:positives]:
            inside = [x for x in scored if x[2] != a[1] and 50 * -s <= 100 * -x[0] <= 95 * -s][:negatives]
            out += [(a[0], p, k, x[1], -s, -x[0]) for k, x in enumerate(inside, 1)]
    return sorted(out)


def test_negatives_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    # few directions and values: many ties; one label holds most rows
    rows = [(int(i), int(rng.choice([0, 0, 0, 1, 2])), [float(x) for x in rng.choice([0.25, 0.5, -0.125, 1.0], 6)]) for i in range(420)]
    rows += [rows[7], (50, 0, [0.5] * 6), (100, 9, [0.1] * 6), (None, 1, [1.0] * 6), (500, None, [1.0] * 6), (550, 1, None), (600, 1, [1.0, None, 0.0]), (650, 1, [float("nan")] * 6),
             (700, 1, [float("inf")] * 6), (750, 1, [0.5, 0.5]), (751, 1, [0.5, 0.25]), (752, 0, [0.5, 0.2]), (800, 3, []), (850, 0, [-0.5] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumns({"v": F.lit("clash"), "block": F.lit(1), "positives": F.lit(2)})
    want = brute_negatives(rows)
    assert len(want) > 60
    for blocks in ({}, {"block_rows": 60, "anchor_rows": 3}):
        got = hard_negatives.hard_negatives(df, "vec_id % 50 = 0", **blocks)
        assert sorted(tuple(r) for r in got.collect()) == want
    assert hard_negatives.hard_negatives(df.limit(0), "vec_id % 50 = 0").count() == 0


# ---- SentencePiece


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces(public_tokenizers.path("piece_bpe_32k.model"), most=3000)


def odd_text(rng, known):
    kind = rng.random()
    if kind < 0.4:
        return "".join(rng.choice(known).replace("▁", " ") for _ in range(rng.randint(1, 12)))
    if kind < 0.6:
        return "".join(rng.choice("abcdeinrst  ▁\n\t\0é漢😀<0x0A>/s") for _ in range(rng.randint(0, 40)))
    if kind < 0.8:
        return "".join(rng.choice("aeinrst ") for _ in range(rng.randint(0, 60)))
    return "".join(chr(rng.choice([rng.randint(1, 0x2FFF), rng.randint(32, 126), rng.randint(0x10000, 0x1FFFF)])) for _ in range(rng.randint(0, 30)))


def test_ids_equal_the_librarys(model):
    rng = random.Random(13)
    known = list(model.cost)
    texts = ["", " ", "  ", "\n", "▁", " a", "a ", "a  b\n\n c", "a\n b \nc\n", "\na", *(odd_text(rng, known) for _ in range(8000))]
    for lo in range(0, len(texts), 500):
        for text, ids in zip(texts[lo:], model.ids(pa.array(texts[lo : lo + 500]))):
            assert ids.tolist() == model.library.encode(text), text


def test_every_prefix_has_one_last_token(model):
    """The table's premise: of the pieces that end at a place exactly one may follow the token before it."""
    text = "▁internationalisation"
    ids_of = {t: np.frombuffer(ids, "<i4").tolist() for t, ids in model.table({text[:n] for n in range(1, len(text) + 1)})}
    for n in range(1, len(text) + 1):
        ids = ids_of[text[:n]]
        fitting = [p for p, t in enumerate(model.text) if text[:n].endswith(t) and t in model.cost
                   and (model.compatible(ids_of[text[: n - len(t)]][-1], p) if len(t) < n else model.compatible(0, p))]
        assert fitting == [ids[-1]]


def test_long_texts_are_encoded_in_slices(model, monkeypatch):
    text = "two words▁ and  é漢\n\n so on  " * 40 + "x" * 300 + "  end"
    for size in (10, 64, 1000):
        monkeypatch.setattr(pieces, "_SLICE", size)
        assert [x.tolist() for x in model.ids(pa.array(["a b", text]))] == model.library.encode(["a b", text])


def test_encode_and_decode_rows(spark, model):
    path = public_tokenizers.path("piece_bpe_32k.model")
    long = "word après 漢字 " * 250_000
    d = docs(spark, long, "x" * 400_000, "two\n\nlines  and\tmore", "\0", extra=True).withColumn("ids", F.lit("clash"))
    encoded = pieces.encode(d, path)
    assert encoded.columns == ["doc_id", "ids"]
    out = pieces.decode(encoded.withColumn("decoded", F.lit("clash")), path).collect()
    want = sorted(((r.doc_id or 0, model.library.encode(r.text or "")) for r in d.collect()))
    assert sorted((r.doc_id or 0, r.ids) for r in out) == want
    assert all(r._decoded == model.library.decode(r.ids) and r.decoded == "clash" for r in out)
    assert [r.decoded for r in pieces.decode(spark.createDataFrame([(None,), ([],)], "ids array<int>"), path).collect()] == ["", ""]
    assert pieces.decode(pieces.encode(d.limit(0), path), path).count() == 0
