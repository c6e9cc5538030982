"""Exact histogram of encoded lengths; suffix sums answer every context limit.

Nulls count as empty texts (length 0). Repeated rows count each; ties share one row of the histogram. An empty table gives no
rows. Special-token strings in a text are ordinary text. Very long texts are encoded whole, but for long runs of white space,
on which the encoder's pattern would overflow its stack: those are taken out and merged by themselves. Extra columns are dropped.
"""

from __future__ import annotations

import base64
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import id_text, settle

#: White space in runs that are encoded by themselves; it is what the encoder's pattern means by white space.
LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{4096,}")
#: How a pattern ends that takes all of a run of white space but its last character, if text follows, and all of it otherwise.
RUNS_APART = r"|\s+(?!\S)|\s+"
#: Lengths are summed in strips of so many, so that no window holds all of them.
STRIP = 1024


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def length(coder, pattern: str, text: str) -> int:
    """Tokens of a text.

    Where RUNS_APART ends the pattern, a run of white space is a piece of its own, without its last character
    if text follows: no piece reaches into it from the left, and the rest is encoded as if it began there.
    """
    if not pattern.endswith(RUNS_APART):
        return len(coder.encode_ordinary(text))
    n, at = 0, 0
    for m in LONG_SPACE.finditer(text):
        end = m.end() - (m.end() < len(text))
        n += len(coder.encode_ordinary(text[at : m.start()])) + len(coder._encode_single_piece(text[m.start() : end]))
        at = end
    return n + len(coder.encode_ordinary(text[at:]))


def _tally(path: str, pattern: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    coder, seen = encoder(path, pattern), Counter()
    for batch in batches:
        for text in batch.column(0):
            seen[length(coder, pattern, text.as_py() or "")] += 1
    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["n_tokens", "n_docs"])


def length_histogram(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(n_tokens, n_docs): how many texts have each encoded length. Each task sends one row for each of its lengths."""
    parts = id_text(docs).select("text").mapInArrow(lambda it: _tally(path, pattern, it), "n_tokens long, n_docs long")
    return parts.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def with_suffix_sums(histogram: DataFrame) -> DataFrame:
    """For each length what lies at or beyond it, and what a context limit of it keeps.

    docs_at_least and tokens_at_least are suffix sums; truncated_tokens is the sum of
    min(length, n_tokens); quantile is the share of texts of at most this length.
    """
    held = settle(histogram.withColumn("strip", F.floor(F.col("n_tokens") / STRIP)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs")), "lengths")
    over = "OVER (ORDER BY strip DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    strips = held.groupBy("strip").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t")).selectExpr("strip", f"sum(d) {over} - d AS d_after", f"sum(t) {over} - t AS t_after", "sum(d) OVER () AS docs", "sum(t) OVER () AS total")
    inside = "OVER (PARTITION BY strip ORDER BY n_tokens DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return held.join(strips, "strip").selectExpr("n_tokens", "n_docs", f"sum(n_docs) {inside} + d_after AS docs_at_least", f"sum(tokens) {inside} + t_after AS tokens_at_least", "docs", "total").selectExpr(
        "n_tokens", "n_docs", "docs_at_least", "tokens_at_least", "total - tokens_at_least + n_tokens * docs_at_least AS truncated_tokens", "(docs - docs_at_least + n_docs) / docs AS quantile", "docs AS total_docs", "total AS total_tokens"
    )


def limits(sums: DataFrame, *contexts: int) -> DataFrame:
    """For each context limit the texts and tokens beyond it and the tokens that it keeps, from the suffix sums alone."""
    asked = sums.sparkSession.createDataFrame([(c,) for c in contexts], "context long")
    first = asked.join(F.broadcast(sums.select("n_tokens")), F.col("n_tokens") > F.col("context"), "left").groupBy("context").agg(F.min("n_tokens").alias("n_tokens"))
    total = sums.agg(F.max("total_tokens").alias("all_tokens"))
    return first.join(sums, "n_tokens", "left").crossJoin(F.broadcast(total)).selectExpr(
        "context", "coalesce(docs_at_least, 0) AS docs_over", "coalesce(all_tokens, 0) - coalesce(tokens_at_least, 0) + context * coalesce(docs_at_least, 0) AS kept_tokens"
    )
