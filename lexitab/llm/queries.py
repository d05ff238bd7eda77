"""One query for each operator of this subpackage, over the whole supplied tables, and SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexitab.llm import bpe, delta_lloyd, embedding_dedup, langid, license_scan, media, mixing, sharding, simhash, substring_dedup, token_alignment, token_files, url_filter

#: Fixed values of the contracts.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
BYTE_TOKENIZER, PIECE_TOKENIZER = "byte_bpe_50k.json", "piece_bpe_32k.model"
END_ID = 2
SHARDS = 24
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
#: Domains of the labelled table, and the shares of all tokens that the mixture shall have.
DOMAINS = ["good", "plain", "toxic"]
WEIGHTS = {"good": 0.8, "plain": 0.15, "toxic": 0.05}


def domain_of_labels():
    """The domain of a row of `labels`: toxic, else by quality; null if a label is null."""
    quality, toxic = F.col("quality"), F.col("toxic")
    return F.when(toxic == 1, "toxic").when(toxic.isNotNull() & (quality == 1), "good").when(toxic.isNotNull() & (quality == 0), "plain")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's domain posteriors, rate and number of copies."""
    documents = _read(spark, sf_dir, "documents")
    model = mixing.train_domains(documents, _read(spark, sf_dir, "labels"), domain_of_labels(), DOMAINS)
    return mixing.mix(documents, model, WEIGHTS)[0].drop("key")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded."""
    return bpe.encode_documents(_read(spark, sf_dir, "documents"), vocabulary=VOCABULARY)


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links and group."""
    return embedding_dedup.near_duplicate_vectors(_read(spark, sf_dir, "embeddings"), threshold=0.93)


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and group."""
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op5_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard, slot, and shard after one more shard."""
    return sharding.shard_records(_read(spark, sf_dir, "documents"), weights=[1.0] * SHARDS, grown=[1.0] * (SHARDS + 1))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict."""
    return url_filter.judge_urls(_read(spark, sf_dir, "pages"), RULES)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's licence notices and tags."""
    return license_scan.scan_documents(_read(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, from models that never saw the held-out fifth."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    documents = _read(spark, sf_dir, "documents")
    model = langid.train(documents.where(~held_out))
    found = langid.identify(documents.select("doc_id", held_out.alias("held_out"), "text"), model)
    return found.drop("text")


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as motion-JPEG and read back, with its timed clips as JSON."""
    return media.describe_documents(_read(spark, sf_dir, "documents")).withColumn("clips", F.to_json("clips"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages that an earlier one has, and what was cut."""
    documents = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.remove_repeats(documents, spans_column="cut_spans", words_column="cut_words")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's groups and links between the tokens of two vocabularies, with the links' corpus-wide counts."""
    return token_alignment.align_documents(_read(spark, sf_dir, "documents"), a=BYTE_TOKENIZER, b=PIECE_TOKENIZER)


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum, from files of coded ids."""
    return token_files.round_trip(_read(spark, sf_dir, "documents"), vocabulary=BYTE_TOKENIZER, end_id=END_ID)


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole vector's cluster after three rounds."""
    return delta_lloyd.cluster_vectors(_read(spark, sf_dir, "embeddings"), clusters=16, rounds=3)


QUERIES = {
    "op1_source_mixing": op1_source_mixing,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_simhash_dedup": op4_simhash_dedup,
    "op5_rendezvous_shards": op5_rendezvous_shards,
    "op6_url_filter": op6_url_filter,
    "op7_license_scan": op7_license_scan,
    "op8_language_id": op8_language_id,
    "op9_media_columns": op9_media_columns,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_token_alignment": op11_token_alignment,
    "op12_token_files": op12_token_files,
    "op13_centroid_clusters": op13_centroid_clusters,
}



def _lloyd_sql(rounds: int, clusters: int) -> str:
    """Plain rounds of Lloyd's method: every vector against every centroid."""
    parts = [
        """kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS k, v AS c FROM kept QUALIFY k < {clusters})",
    ]
    for n in range(rounds + 1):
        parts.append(f"""a{n} AS MATERIALIZED (SELECT r, min(struct_pack(d := d, k := k)) AS best FROM (
            SELECT r, k, CAST(list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM kept, c{n}) GROUP BY r)""")
        if n < rounds:
            parts.append(f"""m{n} AS (SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM (
                SELECT best.k AS k, i, sum(v[i]) AS s, count(*) AS n FROM kept JOIN a{n} USING (r), range(1, 65) AS dims(i) GROUP BY ALL) GROUP BY k)""")
            parts.append(f"c{n + 1} AS MATERIALIZED (SELECT k, coalesce(m{n}.c, c{n}.c) AS c FROM c{n} LEFT JOIN m{n} USING (k))")
    return f"""WITH {", ".join(parts)}
        SELECT vec_id, CAST(best.k AS INTEGER) AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.k) AS BIGINT) AS cluster_inertia,
            CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
        FROM kept JOIN a{rounds} USING (r) JOIN c{rounds} ON k = best.k"""


ORACLE_SQL = {
    "op13_centroid_clusters": _lloyd_sql(rounds=3, clusters=16),
    "op6_url_filter": """
        WITH parts AS (
            SELECT page_id,
                translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
            FROM pages
        ), rules(action, rule_host, rule_path) AS (
            VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
                ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
        ), judged AS (
            SELECT page_id, host, path, (
                SELECT max(struct_pack(n := length(rule_host || rule_path), h := length(rule_host), rule := rule_host || rule_path, action := action))
                FROM rules
                WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
            ) AS best
            FROM parts
        )
        SELECT page_id, host, path, best.rule AS rule, coalesce(best.action, 'allow') AS verdict FROM judged
    """,
}
