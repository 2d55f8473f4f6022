"""The registered queries of this package; each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from podium.llm import alignment, bpe, chat, decontam, embeddings, language, licenses, quality, secrets, simhash, suffixes, toxicity, trie
from podium.llm.common import read, remainder

#: The conversation that every run formats besides those of the table.
PROBE = "</s>[INST] ok [/INST]"


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PROBE).alias("text"),
    )
    return chat.digests(chat.read_back(chat.format_chats(turns.unionByName(probe))))


def op2_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def vocabulary(file: str = "byte_bpe_multi_50k.tiktoken") -> bpe.Vocabulary:
    import public_tokenizers

    return bpe.Vocabulary.load(public_tokenizers.path(file), public_tokenizers.PATTERN)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read(spark, sf_dir, "documents"), vocabulary())


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, remainder("doc_id", 3) != 1)
    held_out = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    return toxicity.score_toxicity(docs, model).withColumn("held_out", held_out)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal("fp").alias("fingerprint"), "component_id")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = language.fit(docs, remainder("doc_id", 4) != 2)
    held_out = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    return language.predict_language(docs, model).withColumn("held_out", held_out)


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(read(spark, sf_dir, "embeddings"))


def op9_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digests(read(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return quality.score_quality(docs, quality.fit(docs, labels))


def tokenizers() -> alignment.Tokenizers:
    import public_tokenizers as public

    files = [public.path(name) for name in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model")]
    return alignment.Tokenizers.load(files[0], files[1], public.PATTERN, files[2])


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.digests(read(spark, sf_dir, "documents"), tokenizers())


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(*trie.rebuilt(read(spark, sf_dir, "conversations")))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat": op1_chat,
    "op2_decontam": op2_decontam,
    "op3_bpe": op3_bpe,
    "op4_licenses": op4_licenses,
    "op5_toxicity": op5_toxicity,
    "op6_simhash": op6_simhash,
    "op7_language": op7_language,
    "op8_embeddings": op8_embeddings,
    "op9_suffixes": op9_suffixes,
    "op10_quality": op10_quality,
    "op11_alignment": op11_alignment,
    "op12_trie": op12_trie,
    "op13_secrets": op13_secrets,
}

# The template and its escapes, written out again.
OP1_SQL = r"""
WITH said AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), escaped AS (
    SELECT *,
        regexp_replace(regexp_replace(replace(text, '\', '\\'), '<(\||/?s>|</?SYS>>)', '<\\!\1', 'g'), '\[(/?INST\])', '[\\!\1', 'g') AS shown,
        regexp_replace(regexp_replace(replace(role, '\', '\\'), '<(\||/?s>|</?SYS>>)', '<\\!\1', 'g'), '\[(/?INST\])', '[\\!\1', 'g') AS named,
        row_number() OVER w AS place,
        lag(role) OVER w IS NOT DISTINCT FROM role AND row_number() OVER w > 1 AS goes_on
    FROM said
    WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id,
    count(*)::BIGINT AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(length(shown) + CASE WHEN goes_on THEN 8 ELSE length(named) + 23 END)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""

OP8_SQL = """
WITH RECURSIVE v AS (
    SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
        AND list_cosine_similarity(a.e, b.e) >= 0.9
), reach(a, b) AS (
    SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
)
SELECT e.vec_id,
    (SELECT count(*) FROM links l WHERE l.a = e.vec_id)::BIGINT AS n_links,
    least(e.vec_id, coalesce((SELECT min(r.b) FROM reach r WHERE r.a = e.vec_id), e.vec_id)) AS component_id,
    e.vec_id = least(e.vec_id, coalesce((SELECT min(r.b) FROM reach r WHERE r.a = e.vec_id), e.vec_id)) AS kept
FROM embeddings e
"""

# CRC-32 bit by bit for the 256 bytes, then byte by byte; subtrees by joining every node to the prefixes of its member.
OP12_SQL = """
WITH RECURSIVE bits(b, v, k) AS (
    SELECT range, range::BIGINT, 0 FROM range(256)
    UNION ALL SELECT b, CASE WHEN (v & 1) = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8
), crc(c, rest, v) AS (
    SELECT DISTINCT conv_id, conv_id::VARCHAR, 4294967295::BIGINT FROM conversations WHERE conv_id IS NOT NULL
    UNION ALL
    SELECT c, rest[2:], xor(crc.v >> 8, bits.v) FROM crc JOIN bits ON k = 8 AND b = xor(crc.v & 255, ascii(rest[1])) WHERE rest <> ''
), said AS (
    SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS pos
    FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
), plan AS (
    SELECT c, c - c % 5 AS base, CASE WHEN c % 5 = 0 THEN 0 ELSE xor(v, 4294967295) % 9 END AS h FROM crc WHERE rest = ''
), rebuilt AS (
    SELECT c, pos AS depth, role, text FROM plan JOIN said ON conv_id = base WHERE pos <= h
    UNION ALL
    SELECT c, pos - h + least(h, (SELECT count(*) FROM said s WHERE s.conv_id = base)), role, text
    FROM plan JOIN said ON conv_id = c WHERE pos > h
), keyed AS (
    SELECT c, depth, text, md5(string_agg(md5(role) || md5(text), '') OVER (PARTITION BY c ORDER BY depth)) AS node FROM rebuilt
    UNION ALL SELECT c, 0, '', '' FROM plan
), linked AS (
    SELECT *, lag(node) OVER (PARTITION BY c ORDER BY depth) AS parent, lead(node) OVER (PARTITION BY c ORDER BY depth) IS NULL AS ends
    FROM keyed
), nodes AS (
    SELECT node, min(depth) AS depth, min(parent) AS parent, min(c) AS c, count(*) AS n, (count(*) - 1) * max(strlen(text)) AS saved,
        sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256
    FROM linked GROUP BY node
), kids AS (
    SELECT parent AS node, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent
), subtrees AS (
    SELECT k.node, count(*) FILTER (u.node NOT IN (SELECT node FROM kids)) AS n_leaves, sum(u.saved) AS saved_tokens
    FROM nodes u JOIN keyed k ON k.c = u.c AND k.depth <= u.depth GROUP BY k.node
)
SELECT v.c::BIGINT AS conv_id, v.depth::BIGINT AS depth, p.c::BIGINT AS parent_conv_id, v.n::BIGINT AS n_convs,
    coalesce(n_children, 0)::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, v.ends_sha256
FROM nodes v LEFT JOIN nodes p ON p.node = v.parent LEFT JOIN kids ON kids.node = v.node JOIN subtrees s ON s.node = v.node
"""

#: The others learn, hash or tokenize in ways that SQL can't express; tests/llm holds them against brute force.
SQL: dict[str, str] = {"op1_chat": OP1_SQL, "op8_embeddings": OP8_SQL, "op12_trie": OP12_SQL}
