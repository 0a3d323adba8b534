"""Operator 1: exact token counts.

Method: whole-token shortcut. Which vocabulary strings encode alone as one token is proven once for each worker; a
pre-token among them counts one without merging, and only the rest is merged (bpe.Pieces). One narrow pass over the
texts, no shuffle.

A null or empty text has 0 bytes and 0 tokens. A row is returned for every row given, whatever its id; columns beside
the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provlake.llm import bpe
from provlake.runtime import ship, bounded_batches


def token_counts(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str = "byte_bpe_50k.json",
    limit: int = 1024,
) -> DataFrame:
    """id, n_bytes, n_tokens and over_limit (more than `limit` tokens) of every row.

    tokenizer: a name of the public tokenizers, or the path of a tokenizers JSON file that every worker can open.
    """
    ship(df.sparkSession)
    bounded_batches(df.sparkSession)

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = bpe.pieces(tokenizer, as_bytes=False)
        for texts in batches:
            yield pd.Series(known.batch(["" if t is None else t for t in texts]), dtype="int64")

    text = F.coalesce(df[text_col], F.lit(""))
    out = df.select(df[id_col].alias(id_col), F.octet_length(text).cast("long").alias("n_bytes"), count(text).alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
