"""A training corpus from raw documents: five stages, each by one operator of the llm subpackage.

Each stage takes all that its predecessor kept, and an empty table passes through as an empty table. Further columns stay.
Tables that a stage writes on its way are deleted before it returns, but for what its result reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helioquery.llm import common, decontam, jaccard_join, langid, mixing, sharding

SHARDS = 16


def _columns(out: DataFrame, docs: DataFrame) -> DataFrame:
    return out.select(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the decoder rejects: ``und`` (null texts and texts without a letter) and ambiguous ones.

    The code is learned from the texts and languages of ``docs``. Where no row has a language nothing can be decoded, and
    texts with a letter stay. Null languages, sources and ids stay as they are; repeated rows share a fate."""
    model = langid.fit(docs)
    if model is None:
        return langid.lettered(docs)
    names = [n for n in ("lang_pred", "score", "ambiguous") if n in docs.columns]
    aside = dict(zip(names, common.unused(docs.columns, *names), strict=True))
    out = langid.identify(docs.withColumnsRenamed(aside), model).filter("lang_pred <> 'und' AND NOT ambiguous")
    return out.drop("lang_pred", "score", "ambiguous").withColumnsRenamed({v: k for k, v in aside.items()}).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by five-word shingles with a similarity of 0.8 or more.

    The one with the least id stays (of rows with that id, the least hash of the text; of repeated rows, one). A null id stays only where no other
    is there. Null texts and texts without words are linked with nothing and all stay."""
    return _columns(jaccard_join.keep_one(docs, jaccard_join.jaccard_components(docs, 5, 4, 5)), docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten consecutive words of a benchmark item, or the whole of a shorter one.

    Null and empty texts have no words and stay; items without an id count; repeated rows share a fate."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    added = [n for n in ("n_words", "n_hit", "items", "spans") if n in docs.columns]
    aside = dict(zip(added, common.unused(docs.columns, *added), strict=True))
    out = decontam.decontaminate(docs.withColumnsRenamed(aside), benchmark, 10).filter("n_hit = 0")
    return out.drop("n_words", "n_hit", "items", "spans").withColumnsRenamed({v: k for k, v in aside.items()}).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents, so that sources come near their targets; of a document that the mix cuts, the nearer whole number counts.

    Null texts and texts without words have no size and go. Null sources are one source. Rows with equal ids (null ones too)
    come equally often: the mean of theirs, rounded."""

    def copies() -> DataFrame:
        sized = docs.select("doc_id", "source", mixing.words_size().alias("size"))
        counts = mixing.mixed_counts(sized).groupBy("doc_id").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"))
        return counts.select("doc_id", F.round(F.try_divide("taken", "size")).cast("int").alias("n")).filter("n > 0")

    some = common.outcome(copies, spark, "copies").hint("merge")  # as large as the ids: never broadcast
    own, n, copy = common.unused(docs.columns, "id", "copies", "copy")
    taken = docs.join(some.select(F.col("doc_id").alias(own), F.col("n").alias(n)), docs["doc_id"].eqNullSafe(F.col(own)))
    return _columns(taken.filter(F.length(F.trim(F.translate("text", "\t\n\x0b\x0c\r", "     "))) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n)))), docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns, with row_number, shard and slot (columns of these names are replaced).

    Rows are numbered by id (null first), then by hashes of all columns, so only rows that are equal are interchangeable."""
    docs = docs.drop("row_number", "shard", "slot")
    every = F.struct(*[docs[c] for c in docs.columns])
    return sharding.shard(docs, SHARDS, ["doc_id", F.xxhash64(every), F.xxhash64(F.lit(1), every)], seed=20)


STAGES = [(f.__name__, f) for f in (language_id, near_duplicates, decontamination, source_mix, shards)]

#: The model of the first stage is not SQL; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = common.fresh_path(spark, f"stage-{name}")
        made = stage(spark, docs, sf_dir)
        made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
        if last:
            common.delete(spark, last)
        last = path
    return docs
