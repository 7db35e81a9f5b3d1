"""Evaluation passages in training text: a generalised suffix automaton of the items, streamed over by the corpus.

The automaton accepts every run of consecutive tokens of every item. A document's tokens walk through it; the walk
keeps the length of the longest run that ends at each token. Where that reaches min_run, the state of the last
min_run tokens names all the items that contain them.

Up to BLOCK_TOKENS tokens of items make one automaton, which is broadcast: documents are read once and nothing is
shuffled. More items are divided into blocks, whose automata are built by the tasks that walk them. A document goes only
to blocks it may share a run with: of every min_run tokens in a row, in items and documents alike, the shorter run with
the least hash is kept, so two equal stretches keep the same one. What items keep is held in a bitmap that documents are
tested with before anything is shuffled. The documents of a block are dealt to several tasks by their number.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempolex.functions.keys import INVISIBLE, token_text
from tempolex.llm.arrow import plain, small_batches, split_tokens, token_codes
from tempolex.session import materialise, shuffles_released

#: Tokens of items that one automaton may hold about; larger item sets are walked in several blocks.
BLOCK_TOKENS = 400_000
#: Documents that one build of a block's automaton serves at most, about.
DOCS_PER_BUILD = 200_000
#: Bits of the bitmap for each kept run, within bounds (the upper one is 32 MB).
BITS_PER_RUN, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 28


class SuffixAutomaton:
    """Of several token sequences. Names: for each state holding runs of min_run tokens, the items that contain them."""

    def __init__(self, items: list[tuple[int, list[str]]], min_run: int):
        self.min_run = min_run
        self.words = sorted({w for _, tokens in items for w in tokens})
        code = {w: i for i, w in enumerate(self.words)}
        self.width = max(1, len(self.words))
        self.next: dict[int, int] = {}
        self._out: dict[int, list[int]] = {}
        self.link, self.length = [-1], [0]
        owners: dict[int, set[int]] = {}
        for item, tokens in items:
            last = 0
            for w in tokens:
                last = self._extend(last, code[w])
            state = 0
            for w in tokens:  # every prefix ends in the state of its own position
                state = self.next[state * self.width + code[w]]
                owners.setdefault(state, set()).add(item)
        for state in sorted(range(len(self.link)), key=self.length.__getitem__, reverse=True):
            up = self.link[state]
            if up > 0 and self.length[up] >= min_run and state in owners:
                owners.setdefault(up, set()).update(owners[state])
        self.items_of: list[tuple[int, ...]] = [()] * len(self.link)
        for state in sorted(range(len(self.link)), key=self.length.__getitem__):
            if self.length[state] >= min_run:
                up = self.link[state]
                # the shortest state that still holds min_run tokens speaks for all longer ones
                self.items_of[state] = self.items_of[up] if self.length[up] >= min_run else tuple(sorted(owners.get(state, ())))

    def _new(self, length: int, link: int) -> int:
        self.length.append(length)
        self.link.append(link)
        return len(self.link) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """The state of the run that reaches q through p, made its own where q also holds longer runs."""
        if self.length[p] + 1 == self.length[q]:
            return q
        clone = self._new(self.length[p] + 1, self.link[q])
        for x in self._out.get(q, ()):
            self._set(clone, x, self.next[q * self.width + x])
        while p != -1 and self.next.get(p * self.width + c) == q:
            self._set(p, c, clone)
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _set(self, state: int, c: int, to: int) -> None:
        key = state * self.width + c
        if key not in self.next:
            self._out.setdefault(state, []).append(c)
        self.next[key] = to

    def _extend(self, last: int, c: int) -> int:
        q = self.next.get(last * self.width + c)
        if q is not None:
            return self._split(last, q, c)
        cur = self._new(self.length[last] + 1, 0)
        p = last
        while p != -1 and p * self.width + c not in self.next:
            self._set(p, c, cur)
            p = self.link[p]
        if p != -1:
            self.link[cur] = self._split(p, self.next[p * self.width + c], c)
        return cur

    def walk(self, codes: list[int], offset: int, found: dict[int, list[list[int]]]) -> None:
        """Adds to found[item] the spans [first, last] of tokens (from offset) that item shares with the walk."""
        nxt, link, length, width, least = self.next, self.link, self.length, self.width, self.min_run
        state = run = 0
        for at, c in enumerate(codes):
            to = nxt.get(state * width + c)
            while to is None and state:
                state = link[state]
                run = length[state]
                to = nxt.get(state * width + c)
            if to is None:
                run = 0
                continue
            state, run = to, run + 1
            if run >= least:
                end = offset + at
                for item in self.items_of[state]:
                    spans = found.setdefault(item, [])
                    if spans and spans[-1][1] == end - 1:
                        spans[-1][1] = end
                    else:
                        spans.append([end - least + 1, end])


def matches(ids: pa.Array, joined: pa.Array, automaton: SuffixAutomaton, words: pa.Array, schema: pa.Schema) -> pa.RecordBatch | None:
    """Rows of the documents that share a run with items of the automaton."""
    least = automaton.min_run
    tokens, lengths = split_tokens(joined)
    codes = pc.fill_null(pc.index_in(tokens, value_set=words), -1).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    row = np.repeat(np.arange(len(lengths)), lengths)
    # only stretches of at least min_run known tokens within one document can hold a match
    known = codes >= 0
    breaks = np.flatnonzero(np.r_[True, ~(known[1:] & known[:-1] & (row[1:] == row[:-1]))]) if len(codes) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[breaks, len(codes)])
    out: list[list] = [[], [], [], [], [], []]
    docs: dict[int, dict[int, list[list[int]]]] = {}
    for at, size in zip(breaks[sizes >= least].tolist(), sizes[sizes >= least].tolist()):
        r = int(row[at])
        automaton.walk(codes[at : at + size].tolist(), at - int(ends[r] - lengths[r]), docs.setdefault(r, {}))
    for r, found in docs.items():
        for item, spans in found.items():
            out[0].append(r)
            out[1].append(item)
            out[2].append(max(e - s + 1 for s, e in spans))
            out[3].append(sum(e - s + 1 for s, e in spans))
            out[4].append(int(lengths[r]))
            out[5].append([x for span in spans for x in span])
    if out[0]:
        return pa.RecordBatch.from_arrays([ids.take(pa.array(out[0])), *[pa.array(o, f.type) for o, f in zip(out[1:], list(schema)[1:])]], schema=schema)


def _match(batches: Iterator[pa.RecordBatch], shared, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    automaton: SuffixAutomaton = shared.value
    words = pa.array(automaton.words, pa.string())
    for b in batches:
        found = matches(b.column(0), plain(b.column(1)), automaton, words, schema) if b.num_rows and automaton.words else None
        if found is not None:
            yield found


def least_runs(joined: pa.Array, min_run: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the runs that min_run tokens in a row keep: of the shorter runs among them the one with the least hash."""
    short = max(1, min_run // 2 + 1)
    codes, words, lengths = token_codes(joined)
    word = pd.util.hash_array(np.array(words.to_pylist(), object), categorize=False) if len(words) else np.zeros(0, np.uint64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(codes))
    if len(codes) < min_run:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.zeros(len(codes) - short + 1, np.uint64)
    for k in range(short):
        h = (h ^ word[codes[k : k + len(h)]]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    least = h[: len(codes) - min_run + 1].copy()
    for k in range(1, min_run - short + 1):
        np.minimum(least, h[k : k + len(least)], out=least)
    at = np.flatnonzero(left[: len(least)] >= min_run)
    pairs = np.unique(np.stack([row[at].astype(np.uint64), least[at]]), axis=1) if len(at) else np.zeros((2, 0), np.uint64)
    return pairs[0].astype(np.int64), pairs[1].view(np.int64)


def _runs_kept(batches: Iterator[pa.RecordBatch], min_run: int, bitmap=None) -> Iterator[pa.RecordBatch]:
    """(id, h) of texts; with a bitmap only of hashes it holds."""
    for b in batches:
        row, h = least_runs(plain(b.column(1)), min_run)
        if bitmap is not None:
            bits = np.frombuffer(bitmap.value, np.uint8)
            place = h.view(np.uint64) % np.uint64(8 * len(bits))
            held = (bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
            row, h = row[held], h[held]
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(np.ascontiguousarray(h))], names=["id", "h"])


def _pieces(batches: Iterator[pa.RecordBatch], blocks: int, most: int, overlap: int) -> Iterator[pa.RecordBatch]:
    """(block, i, t, cut): items in pieces of at most `most` tokens that overlap, dealt to blocks."""
    for b in batches:
        rows = []
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            tokens = t.split()
            for n, at in enumerate(range(0, max(1, len(tokens) - overlap), most - overlap)):
                rows.append((zlib.crc32(f"{i}:{n}".encode()) % blocks, i, " ".join(tokens[at : at + most]), len(tokens) > most))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.int64(), pa.string(), pa.bool_()))], names=["block", "i", "t", "cut"])


def _walk_blocks(batches: Iterator[pa.RecordBatch], min_run: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows come by (block, salt), the items of each (kind 0) before its documents (kind 1)."""
    place, items, automaton, words = None, [], None, None
    for b in batches:
        keys = np.stack([b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)])
        heads = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)]) if b.num_rows else []
        for a, z in zip(heads, [*heads[1:], b.num_rows]):
            block, salt, kind = keys[:, a].tolist()
            if (block, salt) != place:
                place, items, automaton = (block, salt), [], None
            part = b.slice(a, z - a)
            if kind == 0:
                items += [(i, t.split()) for i, t in zip(part.column(3).to_pylist(), part.column(4).to_pylist())]
                continue
            if automaton is None:
                automaton = SuffixAutomaton(items, min_run)
                words = pa.array(automaton.words, pa.string())
            found = matches(part.column(3), plain(part.column(4)), automaton, words, schema)
            if found is not None:
                yield found


def _merged(batches: Iterator[pa.RecordBatch], min_run: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Spans of the pieces of an item joined where they overlap as far as the pieces do, so that all runs of a span are the item's."""
    for b in batches:
        rows = []
        for d, i, n, spans in zip(*(c.to_pylist() for c in b.columns)):
            whole: list[list[int]] = []
            for s, e in sorted(zip(spans[::2], spans[1::2])):
                if whole and s <= whole[-1][1] - min_run + 2:
                    whole[-1][1] = max(whole[-1][1], e)
                else:
                    whole.append([s, e])
            rows.append((d, i, max(e - s + 1 for s, e in whole), sum(e - s + 1 for s, e in whole), n, [x for w in whole for x in w]))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


_OUT = "d bigint, i bigint, longest bigint, leaked bigint, tokens bigint, spans array<bigint>"


def _in_blocks(source: DataFrame, held: DataFrame, min_run: int, block_tokens: int, total: int, schema: pa.Schema) -> DataFrame:
    """leaked_items where the items are too many for one automaton."""
    spark = source.sparkSession
    most = max(block_tokens // 4, 2 * min_run)
    pieces = materialise(held.mapInArrow(partial(_pieces, blocks=-(-total // block_tokens), most=most, overlap=min_run - 1), "block int, i bigint, t string, cut boolean"), "items")
    item_runs = materialise(pieces.select(F.col("block").cast("bigint"), "t").mapInArrow(partial(_runs_kept, min_run=min_run), "id bigint, h bigint").distinct().withColumnRenamed("id", "block"), "item-runs")
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_PER_RUN * item_runs.count()).bit_length()))
    place = F.pmod("h", F.lit(bits))  # bits is a power of two, so signed and unsigned hashes agree
    bitmap = bytearray(bits // 8)
    with shuffles_released(spark):
        for r in item_runs.select(place.alias("p")).groupBy(F.floor(F.col("p") / 32768).alias("k")).agg(F.bitmap_construct_agg(F.col("p") % 32768).alias("m")).collect():  # at most bits / 32768 rows of 4 KB
            bitmap[r.k * 4096 : r.k * 4096 + len(r.m)] = r.m
    shared = spark.sparkContext.broadcast(bytes(bitmap))
    doc_runs = source.mapInArrow(partial(_runs_kept, min_run=min_run, bitmap=shared), "id bigint, h bigint").withColumnRenamed("id", "d").distinct()
    meets = materialise(doc_runs.join(item_runs, "h").select("d", "block").distinct(), "meets")
    shares = meets.groupBy("block").agg(F.ceil(F.count("*") / DOCS_PER_BUILD).cast("int").alias("salts"))
    dealt_items = pieces.join(shares, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), F.col("i").alias("id"), "t")
    dealt_docs = source.join(meets, "d").join(shares, "block").select("block", F.pmod(F.xxhash64("d"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("kind"), F.col("d").alias("id"), "t")
    ordered = dealt_items.unionByName(dealt_docs).repartition("block", "salt").sortWithinPartitions("block", "salt", "kind")
    found = ordered.mapInArrow(partial(_walk_blocks, min_run=min_run, schema=schema), _OUT)
    cut = pieces.where("cut").select("i").distinct().withColumn("cut", F.lit(True))
    marked = materialise(found.join(cut, "i", "left"), "leaks")
    parts = marked.where("cut").groupBy("d", "i").agg(F.max("tokens").alias("tokens"), F.flatten(F.collect_list("spans")).alias("spans"))
    names = [f.name for f in schema]
    return marked.where("cut is null").select(*names).unionByName(parts.mapInArrow(partial(_merged, min_run=min_run, schema=schema), _OUT).toDF(*names))


def leaked_items(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, min_run: int = 13, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(doc_id, item_id, longest_run, leaked_tokens, doc_tokens, spans): every item of which a document holds min_run tokens in a row.

    spans lists first and last token of each stretch of the document that lies wholly in the item. Null and empty
    texts and items shorter than min_run match nothing; empty tables give no rows. A row comes for each row of documents
    and each item id. Items of more than a quarter of block_tokens are walked in overlapping pieces whose spans are
    joined; rows of documents that share an id share the row of such an item.
    """
    schema = pa.schema([("d", pa.int64()), ("i", pa.int64()), ("longest", pa.int64()), ("leaked", pa.int64()), ("tokens", pa.int64()), ("spans", pa.list_(pa.int64()))])
    source = small_batches(docs).select(F.col(doc_id).cast("bigint").alias("d"), token_text(F.col(text)).alias("t"))
    held = items.select(F.col(item_id).cast("bigint").alias("i"), token_text(F.col(item_text)).alias("t")).where("t <> ''")
    total = held.agg(F.sum(F.length("t") - F.length(F.replace("t", F.lit(" "), F.lit(""))) + 1)).first()[0] or 0
    if total <= block_tokens:
        automaton = SuffixAutomaton([(r.i, r.t.split()) for r in held.collect()], min_run)  # at most block_tokens tokens
        shared = docs.sparkSession.sparkContext.broadcast(automaton)
        out = source.mapInArrow(partial(_match, shared=shared, schema=schema), _OUT)
    else:
        out = _in_blocks(source, held, min_run, block_tokens, total, schema)
    names = (doc_id, item_id if item_id != doc_id else f"item_{item_id}", "longest_run", "leaked_tokens", "doc_tokens", "spans")
    return out.toDF(*names)


_TOKEN = regex.compile(r"[\p{L}\p{N}]+")


def token_offsets(text: str) -> list[tuple[int, int]]:
    """Character spans of the tokens of a text as it stands, the invisible characters within them included."""
    places = [i for i, ch in enumerate(text) if ch not in INVISIBLE]
    bare, back = [], []
    for i in places:
        low = text[i].lower()
        bare.append(low)
        back.extend([i] * len(low))
    return [(back[m.start()], back[m.end() - 1] + 1) for m in _TOKEN.finditer("".join(bare))]


def cut_spans(text: str, spans: list[int]) -> str:
    """The text without the given token spans; overlapping spans are cut once."""
    places, out, done = token_offsets(text), [], 0
    for first, last in sorted(zip(spans[::2], spans[1::2])):
        if last >= len(places):
            continue
        a, z = places[first][0], places[last][1]
        if a > done:
            out.append(text[done:a])
        done = max(done, z)
    return "".join([*out, text[done:]])


def without_leaks(docs: DataFrame, doc_id: str, text: str, leaks: DataFrame, max_coverage: float = 0.5) -> DataFrame:
    """(doc_id, coverage, action, kept_text) of the documents with leaks.

    Leaked spans are removed; where they cover more than max_coverage of the tokens the document is dropped
    (kept_text is null). Spans of several items that overlap count once.
    """
    spans = leaks.groupBy(doc_id).agg(F.flatten(F.collect_list("spans")).alias("spans"), F.max("doc_tokens").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts, marked, n = (c.to_pylist() for c in b.columns)
            share, action, kept = [], [], []
            for t, s, total in zip(texts, marked, n):
                covered = len(set().union(*(range(x, y + 1) for x, y in zip(s[::2], s[1::2]))))
                share.append(covered / total)
                drop = covered > max_coverage * total
                action.append("drop" if drop else "cut")
                kept.append(None if drop else cut_spans(t, s))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(share, pa.float64()), pa.array(action, pa.string()), pa.array(kept, pa.string())], names=[doc_id, "coverage", "action", "kept_text"])

    return docs.select(doc_id, text).join(spans, doc_id).select(doc_id, text, "spans", "n").mapInArrow(run, f"{doc_id} bigint, coverage double, action string, kept_text string")
