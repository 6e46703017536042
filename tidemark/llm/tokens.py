"""Sizes in tokens of a public tokenizer, whose file is a parameter."""

from __future__ import annotations

import base64
import functools

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.arrow import explode_texts

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published splitting pattern of this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def ranks_path(spark: SparkSession) -> str:
    return spark.conf.get("spark.tidemark.tokenizer", DEFAULT_RANKS)


@functools.lru_cache(2)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_token_counts(docs: DataFrame) -> DataFrame:
    """doc_id, source, tokens of every document; whole texts are read, null texts have 0 tokens."""
    path = ranks_path(docs.sparkSession)

    def make():
        encode = encoder(path).encode_ordinary
        return lambda doc, source, text: [(doc, source, len(encode(text)) if text else 0)]

    return explode_texts(docs.select("doc_id", "source", "text"), make, "doc_id bigint, source string, tokens int")
