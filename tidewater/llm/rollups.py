"""Token counts kept as additive rollups.

Changes arrive as signed rows: an inserted document counts +1, a deleted one -1, and a revised count is the old one taken
back and the new one added. A batch is summed by key, written aside and renamed to its id, so a reader sees all of it or
none; an id that is known is not committed again, however often it is retried. Compaction folds batches into a base table and
names their ids in a manifest, whose rename is the one step that changes what readers see: ids stay known for ever, and a
crash before or after it leaves totals as they were.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import WORD, bound_batches, release
from tidewater.sources.shared import drop_path, new_path, written

KEYS = ("source", "lang", "tokenizer")
SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long"
MANIFEST = "id string, base string"

#: Tokenizer versions whose counts are regular expressions; any other version is a tokenizer's file.
TOKENIZERS = {"words-1": WORD, "pieces-2": r"[A-Za-z0-9\x80-￿]+|[^\x20\x09-\x0DA-Za-z0-9\x80-￿]"}
BPE = "word-bpe-49k"


def token_count(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")


def bpe_count(text: Column, path: str) -> Column:
    """Tokens of whole texts by the word-level BPE tokenizer in ``path``, special tokens not added; null has none."""

    @F.pandas_udf("long")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tidewater.llm.tokenize import WordBpe

        bpe = WordBpe(path)
        for texts in parts:
            texts, out = list(texts), []
            for at in range(0, len(texts), 256):
                out += [len(ids) // 4 for ids in bpe.encode(texts[at : at + 256])]
            yield pd.Series(out, dtype="int64")
        release()

    return count(text)


def signed(rows: DataFrame, tokenizer: str, tokens: str, sign: int) -> DataFrame:
    """Changes of one sign: every row adds or takes back a document and its tokens."""
    return rows.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(sign).cast("long").alias("docs"), (F.col(tokens) * sign).cast("long").alias("tokens"))


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _names(spark: SparkSession, path: str, prefix: str) -> list[str]:
    fs, target = _fs(spark, path)
    found = [f.getPath().getName() for f in fs.listStatus(target)] if fs.exists(target) else []
    return sorted(n for n in found if n.startswith(prefix))


def _rename(spark: SparkSession, source: str, target: str) -> bool:
    """Move a whole written table to its name in one step; false if the name is taken."""
    fs, end = _fs(spark, target)
    return not fs.exists(end) and fs.rename(_fs(spark, source)[1], end)


def _manifest(spark: SparkSession, path: str) -> tuple[int, DataFrame | None]:
    """Number and table of the last manifest: one row for each folded id, with the base table that holds it."""
    names = _names(spark, path, "manifest-")
    return (int(names[-1][9:]), spark.read.schema(MANIFEST).parquet(f"{path}/{names[-1]}")) if names else (0, None)


def _live(spark: SparkSession, path: str, manifest: DataFrame | None) -> list[str]:
    """Ids of batches that are not folded; folders of folded ones may still be there after a crash."""
    names = [n[6:] for n in _names(spark, path, "batch-")]
    folded = {r["id"] for r in manifest.where(F.col("id").isin(names)).collect()} if manifest is not None and names else set()
    return [n for n in names if n not in folded]


def known(spark: SparkSession, path: str, batch: str) -> bool:
    """Whether a batch of this id has been committed, folded or not."""
    manifest = _manifest(spark, path)[1]
    return f"batch-{batch}" in _names(spark, path, "batch-") or (manifest is not None and not manifest.where(F.col("id") == batch).isEmpty())


def commit(spark: SparkSession, path: str, batch: str, changes: DataFrame) -> bool:
    """Add the sums of a batch of signed changes under its id; a known id changes nothing and gives false."""
    if known(spark, path, batch):
        return False
    sums = changes.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")
    aside = f"{path}/aside-{uuid.uuid4().hex}"
    sums.write.parquet(aside)
    if _rename(spark, aside, f"{path}/batch-{batch}"):
        return True
    drop_path(spark, aside)  # the same batch came in between
    return False


def totals(spark: SparkSession, path: str) -> DataFrame:
    """``source, lang, tokenizer, docs, tokens`` over all committed batches, keys that have gone back to nothing left out."""
    manifest = _manifest(spark, path)[1]
    parts = [f"{path}/batch-{n}" for n in _live(spark, path, manifest)]
    if manifest is not None and (base := manifest.select("base").first()):
        parts.append(f"{path}/{base['base']}")
    rows = spark.read.schema(SCHEMA).parquet(*parts) if parts else spark.createDataFrame([], SCHEMA)
    sums = rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
    return sums.where("docs <> 0 or tokens <> 0")


def compact(spark: SparkSession, path: str) -> None:
    """Fold all live batches into a new base; their ids stay known. What a crash left behind goes with the next run."""
    number, manifest = _manifest(spark, path)
    live = _live(spark, path, manifest)
    if not live:
        return
    base, aside = f"base-{uuid.uuid4().hex}", f"{path}/aside-{uuid.uuid4().hex}"
    totals(spark, path).write.parquet(f"{path}/{base}")
    ids = spark.createDataFrame([(n,) for n in live], "id string")
    ids = ids if manifest is None else ids.unionByName(manifest.select("id"))
    ids.select("id", F.lit(base).alias("base")).coalesce(1).write.parquet(aside)
    if not _rename(spark, aside, f"{path}/manifest-{number + 1:09d}"):
        raise RuntimeError("another compaction came in between")
    gone = [f"batch-{n}" for n in live] + [n for n in _names(spark, path, "base-") if n != base] + [n for n in _names(spark, path, "manifest-") if n < f"manifest-{number + 1:09d}"]
    for name in gone:
        drop_path(spark, f"{path}/{name}")


def corpus_rollup(docs: DataFrame, tokenizer: str | None = None, revised: tuple[str, ...] = ("de", "es", "fr")) -> DataFrame:
    """The life of a corpus as three batches, one sent twice, one again after compaction: load, exact copies deleted, languages re-counted.

    ``load`` inserts each document under ``words-1``. ``dedup`` deletes all copies of a text but the one with the smallest id:
    all rows are taken back and one row per text put in again, so hot texts meet only in partial minima. ``recount``
    moves the remaining documents of ``revised`` languages to the tokenizer in the file ``tokenizer`` (version BPE), or to
    ``pieces-2`` without one. Null text counts no tokens and null texts are copies of each other; null source or language is
    a key of its own. Of copies with equal ids one stays. An empty table gives no totals; columns beside those named are not read.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    again_text = F.when(F.col("lang").isin(*revised), F.col("text"))
    second = bpe_count(again_text, tokenizer) if tokenizer else token_count(again_text, TOKENIZERS["pieces-2"])
    each = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", F.coalesce(F.md5("text"), F.lit("")).alias("digest"),
        token_count(F.col("text"), TOKENIZERS["words-1"]).alias("n1"), second.alias("n2"),
    )
    each = written(each, "counts")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "source", "lang", "n1", "n2")).alias("k")
    kept = written(each.groupBy("digest").agg(first).select("k.*"), "kept")
    again = kept.where(F.col("lang").isin(*revised))
    path = new_path(spark, "rollup")
    commit(spark, path, "load", signed(each, "words-1", "n1", 1))
    dedup = signed(each, "words-1", "n1", -1).unionByName(signed(kept, "words-1", "n1", 1))
    commit(spark, path, "dedup", dedup)
    commit(spark, path, "dedup", dedup)
    compact(spark, path)
    commit(spark, path, "recount", signed(again, "words-1", "n1", -1).unionByName(signed(again, BPE if tokenizer else "pieces-2", "n2", 1)))
    commit(spark, path, "dedup", dedup)
    return totals(spark, path)


#: The same counts with ``pieces-2`` in place of the tokenizer, for the tests.
PIECES_SQL = r"""
with k as (
  select source, lang, text from (
    select *, row_number() over (partition by coalesce(text, chr(0)) order by doc_id nulls last) as r from documents) where r = 1),
c as (
  select source, lang, case when lang in ('de', 'es', 'fr') then 'pieces-2' else 'words-1' end as tokenizer,
    case when lang in ('de', 'es', 'fr') then len(regexp_extract_all(text, '[A-Za-z0-9\x{80}-\x{FFFF}]+|[^\x20\x09-\x0DA-Za-z0-9\x{80}-\x{FFFF}]'))
      else len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) end as n
  from k)
select source, lang, tokenizer, count(*) as docs, cast(coalesce(sum(n), 0) as bigint) as tokens from c group by source, lang, tokenizer
"""
