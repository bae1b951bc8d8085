"""The registered queries of this subpackage; ``oracle_sql`` holds those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import read_archives, write_pages

    read = read_archives(write_pages(_table(spark, sf_dir, "pages")), with_payload=False)
    number = "try_cast(nullif(regexp_extract({}, '^urn:page:(-?[0-9]+)$', 1), '') AS long)"
    whole = F.expr("CASE WHEN kind = 'gap' THEN CAST(raise_error('a gap in archives that were just written') AS boolean) ELSE kind = 'record' END")
    return read.where(whole).select(
        F.expr(number.format("record_id")).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.expr(number.format("refers_to")).alias("refers_to"),
    )


def op2_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .wavelet import document_index, write_shards

    return document_index(write_shards(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), end_id=0, added_tokens=True))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), end_id=1, capacity=4096, added_tokens=True)


def op4_hnsw_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hnsw import neighbours

    return neighbours(_table(spark, sf_dir, "embeddings"), every=100, k=10)


def op5_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import classify

    return classify(_table(spark, sf_dir, "documents"))


def op6_bottom_k_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sketch import with_edits

    return with_edits(_table(spark, sf_dir, "documents"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .setjoin import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import digest, scan

    return digest(scan(_table(spark, sf_dir, "documents")))


def op9_aho_corasick_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepiece import round_trips

    return round_trips(_table(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"))


def op10_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify

    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_jacobi_davidson_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whitened

    return whitened(_table(spark, sf_dir, "embeddings"))


def op12_simhash_bk_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op13_prefix_trie_contraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .trie import prefix_trie

    return prefix_trie(_table(spark, sf_dir, "conversations"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


#: A page's payload, its SHA-1 as bits, and these in fives as base32 letters.
OP1_SQL = """WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, strlen(payload) AS n, max(page_id) OVER (PARTITION BY payload) AS keeper,
array_to_string([lpad(bin(instr('0123456789abcdef', c) - 1), 4, '0') for c in string_split(sha1(payload), '')], '') AS bits FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * CAST(substr(bits, i, 1) AS INT) + 8 * CAST(substr(bits, i + 1, 1) AS INT)
+ 4 * CAST(substr(bits, i + 2, 1) AS INT) + 2 * CAST(substr(bits, i + 3, 1) AS INT) + CAST(substr(bits, i + 4, 1) AS INT), 1) for i in range(1, 161, 5)], '') AS payload_digest,
CASE WHEN page_id < keeper THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < keeper THEN keeper END AS refers_to FROM d"""


#: CRC-32 by bits, prefixes by chained hashes, subtree sums through each node's smallest member. Turns of equal number don't occur there.
OP13_SQL = """WITH RECURSIVE ids AS (SELECT DISTINCT conv_id AS c, [ascii(ch) for ch in string_split(CAST(conv_id AS VARCHAR), '')] AS codes FROM conversations WHERE conv_id IS NOT NULL),
crc AS (SELECT c, codes, 1 AS i, CAST(4294967295 AS BIGINT) AS r FROM ids UNION ALL SELECT c, codes, i + 1, list_reduce(list_prepend(xor(r, CAST(codes[i] AS BIGINT)), CAST(range(8) AS BIGINT[])), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, CAST(3988292384 AS BIGINT)) ELSE x // 2 END) FROM crc WHERE i <= len(codes)),
heads AS (SELECT c, xor(r, CAST(4294967295 AS BIGINT)) % 9 AS h, c - c % 5 AS b FROM crc WHERE i = len(codes) + 1),
own AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p, {'r': coalesce(role, ''), 't': coalesce(text, '')} AS w FROM conversations WHERE conv_id IS NOT NULL),
again AS (SELECT heads.c, p AS k, w FROM heads JOIN own ON own.c = heads.b WHERE p <= h UNION ALL SELECT heads.c, 1000000 + p, w FROM heads JOIN own ON own.c = heads.c WHERE p > h),
turns AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY k) AS d, w FROM again),
chains AS (SELECT c, 0 AS d, '' AS k, CAST(0 AS BIGINT) AS size FROM heads UNION ALL SELECT t.c, CAST(t.d AS INT), sha256(chains.k || chr(1) || strlen(t.w.r) || ':' || t.w.r || t.w.t), strlen(t.w.t) FROM chains JOIN turns t ON t.c = chains.c AND t.d = chains.d + 1),
lengths AS (SELECT c, max(d) AS n FROM chains GROUP BY 1),
nodes AS (SELECT d, k, min(c) AS conv, count(*) AS n_convs, max(size) AS size, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (d = n), '') AS ends FROM chains JOIN lengths USING (c) GROUP BY 1, 2),
place AS (SELECT c, d, conv FROM chains JOIN nodes USING (d, k)),
tree AS (SELECT x.*, p.conv AS parent FROM nodes x LEFT JOIN place p ON p.c = x.conv AND p.d = x.d - 1),
kids AS (SELECT parent AS conv, d - 1 AS d, count(*) AS n FROM tree WHERE d > 0 GROUP BY 1, 2),
whole AS (SELECT p.conv, p.d, count(*) FILTER (kids.n IS NULL) AS n_leaves, sum((x.n_convs - 1) * x.size) AS saved FROM nodes x JOIN place p ON p.c = x.conv AND p.d <= x.d LEFT JOIN kids ON kids.conv = x.conv AND kids.d = x.d GROUP BY 1, 2)
SELECT tree.conv AS conv_id, CAST(tree.d AS BIGINT) AS depth, tree.parent AS parent_conv_id, tree.n_convs, coalesce(kids.n, 0) AS n_children, whole.n_leaves, CAST(whole.saved AS BIGINT) AS saved_tokens, sha256(tree.ends) AS ends_sha256
FROM tree JOIN whole ON whole.conv = tree.conv AND whole.d = tree.d LEFT JOIN kids ON kids.conv = tree.conv AND kids.d = tree.d"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc_salvage": OP1_SQL, "op13_prefix_trie_contraction": OP13_SQL}
