"""How distinctive a term is of a record: a two-Poisson mixture per term, fitted by expectation maximisation.

Each term has a histogram: in how many records it occurs 0, 1, 2, ... times. Two Poisson distributions are fitted to
it, one for records that are about the term (elite) and one for all others. The posterior probability of the elite
component scores each occurrence count, and the score weighs it by how few records hold the term. A score depends on
(term, count) only, so the records are joined with a table of the size of the vocabulary, not with each other; the
records of a chunk that hold a term equally often come to it as one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempolex.llm.arrow import grouped_batches, plain, small_batches, token_codes
from tempolex.session import materialise

CHUNK_BYTES = 24 << 20
#: A term is fitted until no parameter moves by more than this share of itself, or for so many rounds.
SETTLED, ROUNDS = 1e-6, 500


def fit_two_poisson(tf: np.ndarray, records: np.ndarray, absent: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(elite share, elite rate, other rate) of many terms at once; rows are terms, padded columns have 0 records.

    absent is the number of records without the term. The elite rate never falls below the other. Each term is fitted
    until its parameters settle; those that have leave the computation.
    """
    k = np.concatenate([np.zeros((len(tf), 1)), tf], axis=1)
    n = np.concatenate([absent.reshape(-1, 1), records], axis=1).astype(float)
    total, mass = n.sum(axis=1), (n * k).sum(axis=1)
    low = np.maximum(mass / np.maximum(total, 1) * 0.5, 1e-9)
    high = np.maximum(np.maximum((n * k * k).sum(axis=1) / np.maximum(mass, 1e-9), 1e-6), low * 1.0001)  # mean of the term's own records
    share = np.clip(n[:, 1:].sum(axis=1) / np.maximum(total, 1), 1e-6, 0.5)
    fitted = np.stack([share, high, low])
    moving = np.arange(len(tf))
    for _ in range(rounds):
        if not len(moving):
            break
        before = fitted[:, moving]
        p = posterior(k, *before)
        e = n * p
        o = n - e
        es, os = e.sum(axis=1), o.sum(axis=1)
        share = np.clip(es / np.maximum(es + os, 1), 1e-9, 1 - 1e-9)
        high = np.maximum((e * k).sum(axis=1) / np.maximum(es, 1e-12), 1e-9)
        low = np.maximum((o * k).sum(axis=1) / np.maximum(os, 1e-12), 1e-9)
        swap = high < low
        high[swap], low[swap], share[swap] = low[swap], high[swap], 1 - share[swap]
        after = np.stack([share, high, low])
        fitted[:, moving] = after
        still = (np.abs(after - before) > SETTLED * before).any(axis=0)
        moving, k, n = moving[still], k[still], n[still]
    return fitted[0], fitted[1], fitted[2]


def posterior(k: np.ndarray, share: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Probability that a record with k occurrences is elite."""
    log_odds = (np.log(share) - np.log1p(-share) - high + low)[:, None] + k * (np.log(high) - np.log(low))[:, None]
    return 1 / (1 + np.exp(-np.clip(log_odds, -500, 500)))


def _count_within(batches: Iterator[pa.RecordBatch], min_tf: int, min_chars: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """(term, tf, n, ids) of every chunk: how many of its records hold the term so often, and which, if that is worth scoring."""
    for chunk in grouped_batches(batches, "joined", CHUNK_BYTES):
        ids = plain(chunk.column("id"))
        codes, words, lengths = token_codes(plain(chunk.column("joined")))
        if not len(codes):
            continue
        row = np.repeat(np.arange(len(lengths)), lengths)
        pairs, tf = np.unique(row * len(words) + codes, return_counts=True)
        row, word = pairs // len(words), pairs % len(words)
        most = int(tf.max()) + 1
        cell = word * most + tf
        cells, n = np.unique(cell, return_counts=True)
        word, tf = cells // most, cells % most
        keep = (tf >= min_tf) & pc.greater_equal(pc.utf8_length(words), min_chars).to_numpy(zero_copy_only=False)[word]
        order = np.argsort(cell, kind="stable")
        held = ids.take(pa.array(row[order[np.repeat(keep, n)]]))
        offsets = pa.array(np.r_[0, np.cumsum(np.where(keep, n, 0))].astype(np.int32))
        yield pa.RecordBatch.from_arrays([words.take(pa.array(word)), pa.array(tf.astype(np.int32)), pa.array(n.astype(np.int64)), pa.ListArray.from_arrays(offsets, held)], schema=schema)


def _fit_batches(all_records: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            cells = plain(b.column(1))
            sizes = pc.list_value_length(cells).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = pc.list_flatten(cells)
            tf, n = (pc.struct_field(flat, i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            starts = np.cumsum(sizes) - sizes
            df, cf = np.add.reduceat(n, starts), np.add.reduceat(n * tf, starts)
            elite = np.zeros(len(tf))
            for width in np.unique(np.ceil(np.log2(np.maximum(sizes, 1)))):  # terms of like width share a padded block
                own = np.flatnonzero(np.ceil(np.log2(np.maximum(sizes, 1))) == width)
                at = np.arange(int(2**width))[None, :]
                real = at < sizes[own][:, None]
                index = np.where(real, starts[own][:, None] + at, 0)
                k, r = np.where(real, tf[index], 0), np.where(real, n[index], 0)
                share, high, low = fit_two_poisson(k, r, np.maximum(all_records - df[own], 0))
                elite[index[real]] = posterior(k.astype(float), share, high, low)[real]
            term = np.repeat(np.arange(b.num_rows), sizes)
            weight = np.log1p((all_records - df[term] + 0.5) / (df[term] + 0.5))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(term)), pa.array(tf.astype(np.int32)), pa.array(df[term]), pa.array(cf[term]), pa.array(elite), pa.array(elite * weight)], schema=schema
            )

    return run


def term_scores(records: DataFrame, record_id: str, joined: str, all_records: int, min_tf: int = 1, min_chars: int = 1, records_between: tuple[int, int] | None = None) -> DataFrame:
    """(record_id, term, tf, df, cf, elite, score) of the terms of every record. Every term of the collection is fitted.

    tf counts the term in the record, df the records that hold it, cf all its occurrences. Histograms cover
    every term of every record; min_tf and min_chars choose which (record, term) rows come out, records_between
    keeps, of the fitted terms, those held by that many records. records has one row per record_id, joined holds single-space joined tokens.
    Null and empty texts give no rows, as does an empty table; other columns are ignored.
    """
    schema = pa.schema([("term", pa.string()), ("tf", pa.int32()), ("n", pa.int64()), ("ids", pa.list_(pa.int64()))])
    counted = materialise(
        small_batches(records)
        .select(F.col(record_id).alias("id"), F.coalesce(F.col(joined), F.lit("")).alias("joined"))
        .mapInArrow(lambda it: _count_within(it, min_tf, min_chars, schema), "term string, tf int, n bigint, ids array<bigint>"),
        "term-counts",
    )
    # fitting costs far more than its bytes tell: as many tasks as the session asks for, however small the table
    tasks = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = counted.groupBy("term", "tf").agg(F.sum("n").alias("n")).repartition(tasks, "term")
    histograms = cells.groupBy("term").agg(F.collect_list(F.struct("tf", "n")).alias("cells"))
    fitted = pa.schema([("term", pa.string()), ("tf", pa.int32()), ("df", pa.int64()), ("cf", pa.int64()), ("elite", pa.float64()), ("score", pa.float64())])
    scores = histograms.select("term", "cells").mapInArrow(_fit_batches(all_records, fitted), "term string, tf int, df bigint, cf bigint, elite double, score double")
    if records_between:
        scores = scores.where(F.col("df").between(*records_between))
    rows = counted.where(F.size("ids") > 0).select("term", "tf", "ids")
    return rows.join(scores, ["term", "tf"]).select(F.explode("ids").alias(record_id), "term", "tf", "df", "cf", "elite", "score")
