"""The operators over the given tables: one thin query each, and SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import alignment, ann, chunked, language, licenses, mixing, nndescent, packing, periodic, rollups, simhash, toxicity, urlfilter
from tidewater.llm.common import WORD, id_remainder, table


def url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urlfilter.judge(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("p.page_id", "host", "path", "rule", "verdict")


def simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_print().alias("fingerprint"), "component_id")


def retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs, id_remainder("doc_id", 4) != 2)
    found = language.identify(docs.select("doc_id", "text"), model)
    held = F.coalesce(id_remainder("doc_id", 4) == 2, F.lit(False))
    return found.select("d.doc_id", "lang_pred", "score").select("doc_id", held.alias("held_out"), "lang_pred", "score")


def embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nndescent.near_duplicates(table(spark, sf_dir, "embeddings"))


def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), id_remainder("labelled", 5) != 0)
    held = F.coalesce(id_remainder("doc_id", 5) == 0, F.lit(False))
    found = toxicity.score(docs, model).select("d.doc_id", "score")
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mixed(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ann.search(rows.select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.corpus_rollup(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("d.doc_id", "s.n_words", "s.n_base", "s.first_word", "s.last_word", "s.base_labels", "s.labels", "s.score")


def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunked.bpe_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id"])
    ids = (F.octet_length("ids") / 4).cast("long").alias("n_tokens")
    return found.select("d.doc_id", ids, F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = alignment.alignment(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"])
    return found.select("d.doc_id", *found.columns[1:])


def with_planted_run(docs: DataFrame) -> DataFrame:
    """``doc_id, text``, where of each tenth document by crc32 the words from a place on repeat; a null id has none."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all("text", F.lit(f"({WORD})"), 1)
    n, g = F.size("w"), F.floor(F.col("h") / 10)
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    planted = F.expr("concat_ws(' ', transform(w, (x, i) -> if(i < a, x, w[cast(a + (i - a) % p as int)])))")
    marked = docs.select("doc_id", "text", h.alias("h")).withColumn("w", F.when((F.col("h") % 10 == 0) & F.col("text").rlike(WORD), words))
    marked = marked.withColumn("a", a).withColumn("p", p)
    return marked.select("doc_id", F.when(F.col("w").isNotNull(), planted).otherwise(F.col("text")).alias("text"))


def periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(with_planted_run(table(spark, sf_dir, "documents")), keep=["doc_id"])
    best = F.expr("aggregate(slice(runs, 2, greatest(size(runs), 1)), runs[0], (b, r) -> if(r.length * b.period > b.length * r.period, r, b))")
    listed = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    found = found.select("d.doc_id", F.size("runs").cast("long").alias("n_runs"), F.when(F.size("runs") > 0, best).alias("best"), listed.alias("listed"), "collapsed")
    return found.select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period", F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2("listed", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {
    "op1_url_filters": url_filters,
    "op2_simhash_dedup": simhash_dedup,
    "op3_packing": retrieval_packing,
    "op4_language_id": language_id,
    "op5_embedding_dedup": embedding_dedup,
    "op6_toxicity": toxicity_scores,
    "op7_source_mix": source_mix,
    "op8_ann": nearest_vectors,
    "op9_token_counts": token_counts,
    "op10_license_scan": license_scan,
    "op11_bpe_round_trip": bpe_round_trip,
    "op12_token_alignment": token_alignment,
    "op13_periodic_runs": periodic_runs,
}

ORACLES = {"op1_url_filters": urlfilter.ORACLE, "op7_source_mix": mixing.ORACLE}
