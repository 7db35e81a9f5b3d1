"""Frequency of every distinct term or n-gram: suffix array with common-prefix intervals.

Every chunk of whole records builds the suffix array of its tokens, sorted to the ends of the records, by prefix
doubling. The common-prefix array comes from the ranks the doubling leaves at each power of two. A run of neighbouring
suffixes whose common prefixes reach n tokens is an interval of depth n: its length is the number of occurrences of its
n-gram, for any n. The number of records is that length less the duplicates within records: for each two suffixes of one
record that follow each other in the array (with only other records between them) the length of their common prefix
tells in which intervals the later one repeats the earlier.

Records are never divided between chunks, so counts of chunks add up. Each chunk sends one row per distinct n-gram,
which is the aggregation before the shuffle: the most frequent terms reach the reducers once per chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempolex.llm.arrow import grouped_batches, plain, small_batches, token_codes

#: About a million tokens: three numbers of that size fit one 64-bit key, which sorts fastest.
CHUNK_BYTES = 6 << 20


def dense_ranks(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The place of each pair (high, low) among the distinct pairs in order, from 1."""
    total = len(high)
    bits = [int(x.max()).bit_length() for x in (high, low)] + [total.bit_length()]
    if sum(bits) > 63:
        return np.unique(high * (int(low.max()) + 1) + low, return_inverse=True)[1].astype(np.int64) + 1
    keys = np.sort((high << (bits[1] + bits[2])) | (low << bits[2]) | np.arange(total))
    pairs = keys >> bits[2]
    ranks = np.empty(total, np.int64)
    ranks[keys & ((1 << bits[2]) - 1)] = np.cumsum(np.r_[True, pairs[1:] != pairs[:-1]])
    return ranks


def suffix_array(codes: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(array, ranks): the suffixes in order, each to the end of its record, and their ranks by the first 1, 2, 4, ... tokens.

    left is the number of tokens from each place to the end of its record. Equal suffixes keep the order of their places.
    """
    ranks, step = [dense_ranks(codes, np.zeros_like(codes))], 1
    while True:
        ahead = np.zeros(len(codes), np.int64)
        ahead[: len(codes) - step] = ranks[-1][step:]
        ahead[left <= step] = 0
        finer = dense_ranks(ranks[-1], ahead)
        if finer.max() == ranks[-1].max():
            return np.argsort(finer, kind="stable"), ranks
        ranks.append(finer)
        step *= 2
        if step >= len(codes):
            return np.argsort(finer, kind="stable"), ranks


def common_prefixes(one: np.ndarray, two: np.ndarray, ranks: list[np.ndarray], left: np.ndarray) -> np.ndarray:
    """Tokens that the suffixes at one and two have in common from their beginnings, row by row."""
    equal = ranks[-1][one] == ranks[-1][two]  # no finer ranks exist: equal to the end
    at, to = one.astype(np.int32), two.astype(np.int32)
    for k in range(len(ranks) - 2, -1, -1):
        rank = np.r_[ranks[k], np.zeros(1 << len(ranks), np.int64)].astype(np.int32)
        step = (rank[at] == rank[to]).astype(np.int32) << k
        at, to = at + step, to + step
    shared = at - one  # beyond the end of a record only where both ended together
    return np.where(equal, left[one], np.minimum(shared, np.minimum(left[one], left[two])))


def interval_counts(codes: np.ndarray, lengths: np.ndarray, max_n: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each n up to max_n: (start position of one occurrence, occurrences, records) of every n-gram."""
    total = len(codes)
    if not total:
        return [(np.zeros(0, np.int64),) * 3 for _ in range(max_n)]
    record = np.repeat(np.arange(len(lengths)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(total)
    array, ranks = suffix_array(codes, left)
    prefix = np.r_[0, common_prefixes(array[:-1], array[1:], ranks, left)]  # with the suffix before
    # suffixes of one record that follow each other in the array
    by_record = np.argsort(record[array], kind="stable")
    same = record[array][by_record][1:] == record[array][by_record][:-1]
    first, again = by_record[:-1][same], by_record[1:][same]
    repeated = common_prefixes(array[first], array[again], ranks, left)
    out = []
    for n in range(1, max_n + 1):
        long = left[array] >= n
        interval = np.cumsum(prefix < n) - 1  # of each place of the array
        heads = np.flatnonzero((prefix < n) & long)
        occurrences = np.bincount(interval[long], minlength=int(interval[-1]) + 1)
        duplicates = np.bincount(interval[again[repeated >= n]], minlength=int(interval[-1]) + 1)
        out.append((array[heads], occurrences[interval[heads]], (occurrences - duplicates)[interval[heads]]))
    return out


def _counts_of_chunks(max_n: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in grouped_batches(batches, "joined", CHUNK_BYTES):
            codes, words, lengths = token_codes(plain(chunk.column("joined")))
            for n, (at, occurrences, records) in enumerate(interval_counts(codes, lengths, max_n), 1):
                if not len(at):
                    continue
                parts = [words.take(pa.array(codes[at + k])) for k in range(n)]
                term = parts[0] if n == 1 else pc.binary_join_element_wise(*parts, " ")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), n, np.int32)), term.cast(pa.string()), pa.array(occurrences.astype(np.int64)), pa.array(records.astype(np.int64))], schema=schema
                )

    return run


def ngram_counts(records: DataFrame, joined: str, max_n: int = 1) -> DataFrame:
    """(n, term, occurrences, records) of every n-gram of up to max_n tokens over all records.

    records has one row per record; joined is a column of single-space joined tokens. Null and empty texts hold
    nothing, n-grams never cross a record, other columns are ignored, an empty table gives no rows.
    """
    schema = pa.schema([("n", pa.int32()), ("term", pa.string()), ("occurrences", pa.int64()), ("records", pa.int64())])
    one = small_batches(records).select(F.coalesce(F.col(joined), F.lit("")).alias("joined"))
    return (
        one.mapInArrow(_counts_of_chunks(max_n, schema), "n int, term string, occurrences bigint, records bigint")
        .groupBy("n", "term")
        .agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    )


def mark_terms(counts: DataFrame, all_records: int, rare: int = 2, common: float = 0.3) -> DataFrame:
    """Adds mark: 'rare' in at most `rare` records, 'common' in more than the share `common` of all records, else ''."""
    mark = F.when(F.col("records") <= rare, "rare").when(F.col("records") > common * all_records, "common").otherwise("")
    return counts.withColumn("mark", mark)
