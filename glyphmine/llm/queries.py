"""The registered queries of the training-data operators and the SQL that must agree with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glyphmine.llm import decontam, exact_dedup, langid, line_dedup, mixing, pii, simhash, token_codec, toxicity, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables of ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate group of every document."""
    return simhash.groups(table(spark, sf_dir, "documents"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page without the lines that are boilerplate on its site."""
    return line_dedup.drop_boilerplate(table(spark, sf_dir, "pages"))


def op2_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token ids as compressed blocks."""
    return token_codec.pack(table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The personal data in every document."""
    return pii.find(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document and its code length in each."""
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(langid.sample(docs)))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact copies of every document."""
    return exact_dedup.groups(table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the URL of every page is on the block list."""
    pages = table(spark, sf_dir, "pages")
    return url_filter.mark(pages, url_filter.blocked_keys(pages))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that every document has passages of."""
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(*toxicity.sample(docs, table(spark, sf_dir, "labels"))))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The copies of every document that bring the sources to their target weights."""
    return mixing.copies(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py over all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_token_blocks": op2_token_blocks,
    "op3_pii": op3_pii,
    "op4_language_id": op4_language_id,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_url_filter": op6_url_filter,
    "op7_decontamination": op7_decontamination,
    "op8_toxicity": op8_toxicity,
    "op9_mixing": op9_mixing,
    "op10_simhash": op10_simhash,
    "pipeline": pipeline,
}

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": line_dedup.boilerplate_sql(),
    "op5_exact_dedup": exact_dedup.GROUPS_SQL,
    "op6_url_filter": url_filter.mark_sql(),
}
