"""The registered queries of the training-data operators: each applies one operator, with its production parameters, to
its whole table and derives the digest columns from the operator's output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest
from .chat import format_conversations, read_conversations
from .common import table
from .compression_quality import quality_scores
from .decontamination import contaminated
from .hard_negatives import hard_negatives
from .merkle import checked, leaf, manifest
from .packing import pack
from .pieces import decode, encode
from .simhash import near_duplicates
from .suffix_dedup import remove_repeats
from .token_counts import token_counts
from .toxicity import toxicity
from .warc import read_archives, write_archives


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.tiktoken"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.5, categories=4)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=5, least=0.8)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack(table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), capacity=2048, end_id=1)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    extra = spark.sql("SELECT -7L AS conv_id, * FROM VALUES (0L, 'user'), (1L, 'assistant') AS v(turn, role)").withColumn("text", F.lit(said))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    back = read_conversations(format_conversations(turns))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = read_archives(write_archives(table(spark, sf_dir, "pages"), least_bytes=0))
    digest = F.when(F.col("valid"), F.col("payload_digest")).otherwise(F.raise_error(F.lit("a payload's digest is wrong")).cast("string"))
    return back.select("page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"), distance=4, shingle=4)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"), length=200)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("n_chars", F.col("n_chars").cast("long"))
    own = lambda n_chars: leaf(F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    rows = d.select("doc_id", "lang", own(F.col("n_chars")).alias("leaf"), F.when(tampered, own(F.col("n_chars") + 1)).alias("tampered"))
    out = checked(manifest(rows).withColumn("tampered", F.coalesce("tampered", "leaf")), "tampered")
    digest = lambda c: F.lower(F.hex(c))
    names = ("leaf", "subroot", "root", "proof", "folded_root")
    return out.select("doc_id", *[digest(c).alias("proof_sha256" if c == "proof" else c) for c in names], "verified")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", label), anchors="vec_id % 50 = 0", scale=256, positives=5, negatives=3, low=50, high=95)


def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = _vocabulary("piece_bpe_32k.model")
    out = decode(encode(table(spark, sf_dir, "documents"), model), model)
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        digest(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"),
        digest(F.col("decoded")).alias("decoded_sha256"),
    )


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_toxicity": op2_toxicity,
    "op3_decontamination": op3_decontamination,
    "op4_packing": op4_packing,
    "op5_chat_format": op5_chat_format,
    "op6_warc": op6_warc,
    "op7_simhash": op7_simhash,
    "op8_ann": op8_ann,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_compression_quality": op10_compression_quality,
    "op11_merkle": op11_merkle,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_pieces": op13_pieces,
}

ORACLE_SQL: dict[str, str] = {
    "op5_chat_format": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, v.turn, v.role, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(turn, role)
        ), e AS (
            SELECT *, length(replace(replace(replace(text, '\', '\e'), '### ', '\h'), '</turn>', '\c')) + 7 AS chars,
                   lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS DISTINCT FROM role AS opens
            FROM t
        )
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(chars + CASE WHEN opens THEN length(replace(replace(replace(replace(replace(role, '\', '\e'), '### ', '\h'), '</turn>', '\c'),
                   chr(10), '\n'), ':', '\d')) + 7 ELSE 0 END)::BIGINT AS formatted_chars
        FROM e GROUP BY conv_id""",
    "op11_merkle": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, lang, unnest([false, true]) AS raised, source, n_chars, text FROM documents
        ), h AS (
            SELECT doc_id, lang, raised, sha256(list_reduce(list_transform(
                [doc_id::VARCHAR, source, lang, (n_chars + raised::INT)::VARCHAR, text],
                lambda v: coalesce(strlen(v)::VARCHAR || ':' || v, '-')), lambda a, b: a || b)) AS node
            FROM d
        ), leaves AS (
            SELECT o.doc_id, o.lang, o.node, r.node AS tampered, row_number() OVER (PARTITION BY o.lang ORDER BY o.doc_id) - 1 AS place
            FROM h o JOIN h r ON o.doc_id = r.doc_id AND NOT o.raised AND r.raised
        ), trees AS (
            SELECT lang, 0 AS height, place, node, count(*) OVER (PARTITION BY lang) AS n FROM leaves
            UNION ALL
            SELECT lang, height + 1, place // 2, sha256(string_agg(node, '' ORDER BY place)), (any_value(n) + 1) // 2
            FROM trees WHERE n > 1 GROUP BY lang, height, place // 2
        ), subroots AS (
            SELECT lang, node, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place FROM trees WHERE n = 1
        ), crown AS (
            SELECT 0 AS height, place, node, count(*) OVER () AS n FROM subroots
            UNION ALL
            SELECT height + 1, place // 2, sha256(string_agg(node, '' ORDER BY place)), (any_value(n) + 1) // 2
            FROM crown WHERE n > 1 GROUP BY height, place // 2
        ), steps AS (
            SELECT l.doc_id, t.height, l.place // (1 << t.height) AS own, max(s.place) AS beside, max(s.node) AS node
            FROM leaves l JOIN trees t ON l.lang IS NOT DISTINCT FROM t.lang AND t.place = l.place // (1 << t.height) AND t.n > 1
            LEFT JOIN trees s ON s.lang IS NOT DISTINCT FROM t.lang AND s.height = t.height AND s.place = xor(t.place, 1)
            GROUP BY ALL
            UNION ALL
            SELECT l.doc_id, 1000 + t.height, r.place // (1 << t.height), s.place, s.node
            FROM leaves l JOIN subroots r ON l.lang IS NOT DISTINCT FROM r.lang
            JOIN crown t ON t.place = r.place // (1 << t.height) AND t.n > 1
            LEFT JOIN crown s ON s.height = t.height AND s.place = xor(t.place, 1)
        ), paths AS (
            SELECT doc_id, list(CASE WHEN node IS NULL THEN '=' WHEN beside < own THEN '<' || node ELSE '>' || node END ORDER BY height) AS path,
                   coalesce(string_agg(node, '' ORDER BY height), '') AS proof
            FROM steps GROUP BY doc_id
        ), crc AS (
            SELECT doc_id, xor(4294967295, list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT), lambda c, b:
                list_reduce(list_transform(range(9), lambda k: CASE WHEN k = 0 THEN xor(c, b) ELSE 0 END),
                    lambda x, y: xor(x >> 1, 3988292384 * (x & 1))), 4294967295)) AS crc
            FROM leaves
        ), folded AS (
            SELECT l.doc_id, l.lang, l.node, coalesce(p.proof, '') AS proof,
                   list_reduce(coalesce(p.path, []), lambda a, s: CASE s[1] WHEN '=' THEN sha256(a) WHEN '<' THEN sha256(s[2:] || a) ELSE sha256(a || s[2:]) END,
                               CASE WHEN c.crc % 7 = 0 THEN coalesce(l.tampered, l.node) ELSE l.node END) AS folded_root
            FROM leaves l JOIN crc c USING (doc_id) LEFT JOIN paths p USING (doc_id)
        )
        SELECT f.doc_id, f.node AS leaf, r.node AS subroot, (SELECT node FROM crown WHERE n = 1) AS root, sha256(f.proof) AS proof_sha256,
               f.folded_root, f.folded_root = (SELECT node FROM crown WHERE n = 1) AS verified
        FROM folded f JOIN subroots r ON f.lang IS NOT DISTINCT FROM r.lang""",
    "op12_hard_negatives": """
        WITH usable AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scores AS (
            SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
                   list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i]))::BIGINT AS score
            FROM usable a JOIN usable b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
        ), positives AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
        )
        SELECT p.anchor_id, p.positive_id, (row_number() OVER w)::INT AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
        FROM positives p JOIN scores s ON p.anchor_id = s.anchor_id AND NOT s.same
             AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
        WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)
        QUALIFY rank <= 3""",
}
