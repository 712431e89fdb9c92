"""The registered queries of the corpus operators, and the same results in SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetspectra.llm import alignment, decontam, exact, gam, langid, lexical, lm, mixing, pii, rules, sharding, simhash, suffix
from fleetspectra.llm.common import fold_of, shared_folder


#: A public vocabulary file; nothing of it is kept here.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"

#: The two vocabularies that are aligned.
ALIGNED = ("/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model")


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def op1_mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    mixed = mixing.mix(_read(spark, sf, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op2_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = _read(spark, sf, "documents")
    held_out = fold_of("doc_id", 5) == 0
    tables = gam.train(docs, _read(spark, sf, "labels"), ~held_out)
    scored = gam.score(docs, tables)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_find_pii(spark: SparkSession, sf: str) -> DataFrame:
    return pii.digest(pii.find_pii(_read(spark, sf, "documents")))


def op4_repeats(spark: SparkSession, sf: str) -> DataFrame:
    cut = suffix.remove_repeats(_read(spark, sf, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_simhash(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash.near_duplicates(_read(spark, sf, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    return decontam.find_leaks(_read(spark, sf, "documents"), _read(spark, sf, "benchmark"))


def op7_language(spark: SparkSession, sf: str) -> DataFrame:
    docs = _read(spark, sf, "documents")
    held_out = fold_of("doc_id", 4) == 2
    found = langid.identify(docs, langid.train(docs, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")


def op8_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    docs = _read(spark, sf, "documents")
    return rules.judge(docs, rules.train(docs, _read(spark, sf, "labels")))


def op9_shard(spark: SparkSession, sf: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/slot-maps-{uuid.uuid4().hex}"
    placed = sharding.shard_records(_read(spark, sf, "documents"), 40, folder)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "vslot", "map_version",
    )


def op10_language_model(spark: SparkSession, sf: str, vocabulary: str = VOCABULARY) -> DataFrame:
    docs = _read(spark, sf, "documents")
    held_out = fold_of("doc_id", 5) == 1
    scored = lm.score(docs, ~held_out, vocabulary)
    return scored.withColumn("held_out", held_out)


def op11_align_tokenizers(spark: SparkSession, sf: str, vocabularies: tuple[str, str] = ALIGNED) -> DataFrame:
    return alignment.score(_read(spark, sf, "documents"), *vocabularies)


def op12_exact_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    found = exact.exact_duplicates(_read(spark, sf, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op13_lexical_search(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.search(_read(spark, sf, "documents"), _read(spark, sf, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_quality": op2_quality,
    "op3_find_pii": op3_find_pii,
    "op4_repeats": op4_repeats,
    "op5_simhash": op5_simhash,
    "op6_decontaminate": op6_decontaminate,
    "op7_language": op7_language,
    "op8_quality_rules": op8_quality_rules,
    "op9_shard": op9_shard,
    "op10_language_model": op10_language_model,
    "op11_align_tokenizers": op11_align_tokenizers,
    "op12_exact_duplicates": op12_exact_duplicates,
    "op13_lexical_search": op13_lexical_search,
}

OP12 = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS content FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY content) AS group_size,
       row_number() OVER w = 1 AS kept, sha256(content) AS text_sha256
FROM d WINDOW w AS (PARTITION BY content ORDER BY n DESC, doc_id NULLS LAST)"""

TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

OP13 = f"""
WITH d AS (SELECT doc_id, {TERMS} AS terms FROM documents),
one AS (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM d),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM one GROUP BY ALL),
whole AS (SELECT count(*) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM d WHERE len(terms) > 0),
w AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM p, whole GROUP BY term, n_docs),
q AS (SELECT DISTINCT item_id, unnest({TERMS}) AS term FROM benchmark),
s AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN w USING (term), whole GROUP BY ALL),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 50"""

# Queries without plain SQL are compared with brute force on small tables, or by held-out accuracy, in tests/llm.
SQL: dict[str, str] = {"op12_exact_duplicates": OP12, "op13_lexical_search": OP13}
