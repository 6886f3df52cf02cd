"""From raw documents to token blocks: five stages, each an operator of factgraph.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in the shared folder and
reads it back as the next stage's docs, so a lost executor never repeats an earlier stage.

1. language: documents whose language the byte network cannot tell (no text, no letter, no clear winner) go.
2. near_duplicates: of documents linked by five-word shingles at a Jaccard similarity of 0.8 the smallest doc_id stays.
3. decontamination: documents of which benchmark windows of 13 words cover a twentieth or more go.
4. mixing: sources are brought to 5, 2, 1 shares of 150 % of the words; a document comes as often as the mix takes it,
   so rows repeat, and documents of no word or beyond a source's target go.
5. token_blocks: the mix as token ids in segments; one row for each document as read back from the files.

Rows: null and empty texts go at stage 1; rows without a doc_id, and rows that share one, are documents of their own in
every stage but 2, which knows documents by their id and drops neither of two rows that share the smallest one of their
group, nor rows without one. Ties (equal sources, keys, similarities of exactly 0.8) fall as the operators say. Further
columns come through stages 1 to 4 unchanged, whatever their names; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factgraph.llm.common import Workspace, table
from factgraph.llm.decontaminate import clean_documents
from factgraph.llm.jaccard_join import one_of_each_group
from factgraph.llm.language import determined
from factgraph.llm.mixing import mixed_documents
from factgraph.llm.token_blocks import token_corpus


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs that have a language, by a network fitted on those of them that are labelled (outside the held-out fold)."""
    return determined(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs less those linked to a smaller doc_id; null doc_ids and each row of a repeated one stay."""
    return one_of_each_group(docs, Workspace(spark, "near-duplicates"), words=5, num=80, den=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs less the contaminated; documents without words and an empty benchmark contaminate nothing."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs as often as the mix takes them; documents without words go, a null source is a source."""
    return mixed_documents(docs, Workspace(spark, "mixing"))


def token_blocks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every row, a null text being empty."""
    import public_tokenizers

    return token_corpus(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_blocks", token_blocks),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    work = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = work.keep(stage(spark, docs, sf_dir), name)
        if i:
            work.drop(STAGES[i - 1][0])
    return docs


#: The language network and the tokenizer have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None
