"""Exact token-length histogram of a corpus.

Documents are encoded whole and only their lengths are kept. The histogram by length, with prefix and
suffix sums, answers totals, quantiles and truncated totals for every context limit at once.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .base import cut

# Fixed value: the splitting pattern that belongs to the byte-level vocabulary
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# Fixed value: the white space that the pattern's ``\s`` means; runs of it are long from so many on
LONG_GAP = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{256,}")


@dataclass(frozen=True)
class LengthSettings:
    ranks: str = "/opt/tokenizers/byte_bpe_50k.tiktoken"  # of a vocabulary that every machine has
    pattern: str = PATTERN
    block: int = 1024  # lengths whose sums are added up together


@lru_cache(maxsize=2)
def encoder(ranks: str, pattern: str):
    """The encoder of a rank file, loaded once per worker process."""
    import tiktoken

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def tokens_in(encoding, text: str) -> int:
    """The number of tokens of a whole text.

    The pattern tracks back over every character of a run of white space, which overflows its
    stack on long ones. Such a run is a piece by itself, but for its last character where
    something follows, so the text is cut there and the piece encoded without the pattern.
    """
    total = at = 0
    for gap in LONG_GAP.finditer(text):
        start, end = gap.span()
        end -= end < len(text)
        total += len(encoding.encode_ordinary(text[at:start])) + len(encoding._encode_single_piece(text[start:end]))
        at = end
    return total + len(encoding.encode_ordinary(text[at:]))


def token_counts(docs: DataFrame, settings: LengthSettings = LengthSettings()) -> DataFrame:
    """``(doc_id, n_tokens)``; null and empty texts have 0 tokens."""
    ranks, pattern = settings.ranks, settings.pattern

    @F.pandas_udf("bigint")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding = encoder(ranks, pattern)
        for batch in texts:
            yield pd.Series([tokens_in(encoding, t) if t else 0 for t in batch], dtype="int64")

    return docs.select("doc_id", count("text").alias("n_tokens"))


def length_histogram(counted: DataFrame, settings: LengthSettings = LengthSettings()) -> DataFrame:
    """One row per length that occurs: ``n_tokens, docs, docs_up_to, tokens_up_to, docs_over, truncated_total``.

    ``docs_up_to`` and ``tokens_up_to`` count documents of at most this length, ``docs_over`` those
    longer, and ``truncated_total`` is the corpus size if every document were cut at this length;
    for a limit between two lengths add ``docs_over`` times the difference to the lower row. The
    smallest length with ``docs_up_to >= q * total`` is the q-quantile. Rows are added up by blocks
    of lengths, then inside each block. An empty table gives no rows.
    """
    bars = cut(counted.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("docs"))).withColumn("block", F.floor(F.col("n_tokens") / settings.block))
    blocks = bars.groupBy("block").agg(F.sum("docs").alias("d"), F.sum(F.col("docs") * F.col("n_tokens")).alias("t"))
    order = Window.partitionBy(F.lit(0)).orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select(
        "block",
        F.coalesce(F.sum("d").over(before), F.lit(0)).alias("d0"),
        F.coalesce(F.sum("t").over(before), F.lit(0)).alias("t0"),
        F.sum("d").over(Window.partitionBy(F.lit(0))).alias("all_docs"),
    )
    inside = Window.partitionBy("block").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = bars.withColumn("d1", F.sum("docs").over(inside)).withColumn("t1", F.sum(F.col("docs") * F.col("n_tokens")).over(inside)).join(starts, "block")
    out = summed.select("n_tokens", "docs", (F.col("d0") + F.col("d1")).alias("docs_up_to"), (F.col("t0") + F.col("t1")).alias("tokens_up_to"), "all_docs")
    over = F.col("all_docs") - F.col("docs_up_to")
    return out.select("n_tokens", "docs", "docs_up_to", "tokens_up_to", over.alias("docs_over"), (F.col("tokens_up_to") + over * F.col("n_tokens")).alias("truncated_total"))
