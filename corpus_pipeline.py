"""Documents to deduplicated, decontaminated, tokenized training text in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thinmarket.llm import bpe, decontaminate, lines, neighbours, quality
from thinmarket.session import checkpoint_root


def as_articles(docs: DataFrame) -> DataFrame:
    return docs.withColumnsRenamed({"doc_id": "article_id", "text": "body", "lang": "language"})


def as_documents(articles: DataFrame) -> DataFrame:
    """The columns of documents, the length taken from the text as it is now."""
    return articles.select(F.col("article_id").alias("doc_id"), F.col("body").alias("text"), F.col("language").alias("lang"), "source", F.length("body").cast("long").alias("n_chars"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the policy keeps."""
    return as_documents(quality.keep_articles(as_articles(docs), "v2"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that stand earlier; one of which nothing is left goes."""
    out = lines.drop_repeated_lines(as_articles(docs))
    return as_documents(out.filter(~((F.col("n_removed_lines") > 0) & ~F.col("body").rlike(r"[^\x20\x09-\x0D]"))))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates; documents without words all stay."""
    return as_documents(neighbours.one_of_each(as_articles(docs)))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return as_documents(decontaminate.clean_articles(as_articles(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document that is left."""
    from thinmarket.llm.queries import tokenizer_path

    return bpe.encode_articles(as_articles(docs), tokenizer_path()).withColumnRenamed("article_id", "doc_id")


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("ngram_jaccard_join", ngram_jaccard_join), ("benchmark_decontamination", benchmark_decontamination), ("bpe_encoding", bpe_encoding)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table, each written as Parquet and read again as the next one's input."""
    import uuid

    base = f"{checkpoint_root(spark)}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{base}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
