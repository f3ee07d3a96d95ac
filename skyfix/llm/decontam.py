"""Benchmark decontamination by a prefix-filtered join of word windows.

Every benchmark item gives windows of `window` consecutive words (one shorter window where it has fewer). The words of a
window are ordered by how rarely the documents use them, counted over all documents. A window that occurs in a document
has every word in common with it, so the prefix that must be joined is the one rarest word: document words are looked up
among these only. A match fixes where the window would have to begin (positional bound); it must begin and end inside the
document (length bound), and the words there are compared with the window exactly.

The benchmark is held by executors in blocks of at most `block_bytes` of item text, as arrays of numbers (about 40 bytes a window, a window a word). One block is
the usual case; with more, each block is two passes over the documents, one to count words and one to join, and a row's hits are united afterwards.

Defined results: null or wordless texts have no words, no hits and are clean; an item without words has no window; an
item with a null id is ignored; rows that repeat an item id are one item. Documents keep their rows, null or repeated
ids included; columns besides id and text are never read. Without documents the result is empty, without items all is clean.
"""

from __future__ import annotations

import collections
import dataclasses
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfix.llm.common import map_slices
from skyfix.llm.wordhash import mix, spread

#: Bytes that are no part of a word become spaces; A-Z become a-z. Bytes from 128 on are parts of non-ASCII characters.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isdigit() or 97 <= b <= 122 else 32 for b in range(256))
BLOCK_BYTES = 16 << 20


def words_of(data: bytes) -> list[bytes]:
    return data.translate(WORD_BYTES).split()


def _hash(ids: np.ndarray, starts: np.ndarray, n: int, seed: int) -> np.ndarray:
    h = np.full(len(starts), np.uint64(seed))
    for i in range(n):
        h = mix(h ^ (ids[starts + i].astype(np.uint64) + np.uint64(1)))
    return h


def _equal(x: np.ndarray, a: np.ndarray, y: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    out = np.ones(len(a), bool)
    for i in range(n):
        out &= x[a + i] == y[b + i]
    return out


@dataclasses.dataclass
class Windows:
    """The different windows of one length: hashes in order (no two alike), a place of each in the items' words, and the items that have it."""

    n: int
    seed: int
    hashes: np.ndarray
    places: np.ndarray
    first_item: np.ndarray
    items: np.ndarray


class Index:
    """A block of items as numbers: about 40 bytes a window. Words are numbered, so that windows are compared word by word as numbers."""

    def __init__(self, items: list[tuple[int, bytes]], window: int):
        self.names = [i for i, _ in items]
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary.setdefault
        lists = [np.array([number(w, len(self.vocabulary)) for w in words_of(text)], np.int32) for _, text in items]
        sizes = np.array([len(x) for x in lists], np.int64)
        self.words = np.concatenate([*lists, np.zeros(0, np.int32)])
        begin = np.cumsum(sizes) - sizes
        self.windows = []
        for n in np.unique(np.minimum(sizes, window)).tolist():
            if n:
                own = np.flatnonzero(np.minimum(sizes, window) == n)
                count = sizes[own] - n + 1
                self.windows.append(self._different(n, spread(count, begin[own]), np.repeat(own, count)))

    def _different(self, n: int, starts: np.ndarray, item: np.ndarray) -> Windows:
        seed = n
        while True:
            h = _hash(self.words, starts, n, seed)
            order = np.argsort(h, kind="stable")
            new = np.ones(len(h), bool)
            new[1:] = h[order[1:]] != h[order[:-1]]
            again = np.flatnonzero(~new)
            if _equal(self.words, starts[order[again]], self.words, starts[order[again - 1]], n).all():
                break
            seed += 1 << 20  # two different windows clash: other hashes
        which = np.cumsum(new) - 1
        pairs = np.unique(which * len(self.names) + item[order])
        return Windows(n, seed, h[order[new]], starts[order[new]], np.searchsorted(pairs // len(self.names), np.arange(int(new.sum()) + 1)), (pairs % len(self.names)).astype(np.int32))

    def order_by_rarity(self, counts: dict[bytes, int]) -> None:
        """The prefix of every window, its rarest word: where it stands in windows, by word (rare words only)."""
        words = sorted(self.vocabulary, key=lambda w: (counts.get(w, 0), w))
        rank = np.empty(len(words), np.int64)
        rank[[self.vocabulary[w] for w in words]] = np.arange(len(words))
        found = [np.zeros((0, 3), np.int64)]
        for x in self.windows:
            best, at = rank[self.words[x.places]], np.zeros(len(x.places), np.int64)
            for i in range(1, x.n):
                r = rank[self.words[x.places + i]]
                at[r < best], best = i, np.minimum(r, best)
            found.append(np.unique(np.stack([self.words[x.places + at], at, np.full(len(at), x.n)], axis=1), axis=0))
        entries = np.concatenate(found)
        entries = entries[np.argsort(entries[:, 0], kind="stable")]
        self.offsets, self.lengths = entries[:, 1], entries[:, 2]
        self.first = np.searchsorted(entries[:, 0], np.arange(len(words) + 1))

    def find(self, ids: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first word, length, index in self.windows, window) of every window that occurs in documents' words (-1: not in the vocabulary); begin, end: of each word's document."""
        known = np.flatnonzero(ids >= 0)
        count = self.first[ids[known] + 1] - self.first[ids[known]]
        at, entry = np.repeat(known, count), spread(count, self.first[ids[known]])
        start, length = at - self.offsets[entry], self.lengths[entry]
        inside = (start >= begin[at]) & (start + length <= end[at])  # positional and length bounds
        start, length = start[inside], length[inside]
        out = []
        for k, x in enumerate(self.windows):
            a = np.unique(start[length == x.n])
            if len(a):
                h = _hash(ids, a, x.n, x.seed)
                w = np.minimum(np.searchsorted(x.hashes, h), len(x.hashes) - 1)
                ok = x.hashes[w] == h
                a, w = a[ok], w[ok]
                ok = _equal(ids, a, self.words, x.places[w], x.n)
                a, w = a[ok], w[ok]
                out.append((a, np.full(len(a), x.n), np.full(len(a), k), w))
        return tuple(np.concatenate(c) for c in zip(*out)) if out else tuple(np.zeros(0, np.int64) for _ in range(4))


def item_blocks(benchmark: DataFrame, item_column: str, text_column: str, block_bytes: int) -> Iterator[list[tuple[int, bytes]]]:
    """The items in blocks of bounded text, one block on the driver at a time; at least one, if empty."""
    rows = benchmark.select(F.col(item_column), F.coalesce(F.col(text_column), F.lit("")).cast("binary")).where(F.col(item_column).isNotNull())
    block, held = [], 0
    for item, text in rows.toLocalIterator():
        if held and held + len(text) > block_bytes:
            yield block
            block, held = [], 0
        block.append((item, bytes(text)))
        held += len(text)
    yield block


def word_counts(documents: DataFrame, vocabulary: set[bytes], text_column: str) -> dict[bytes, int]:
    """How often the documents use each of these words; what comes back is bounded by the vocabulary."""

    def make():
        known = vocabulary.__contains__

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            n: collections.Counter[bytes] = collections.Counter()
            for data in batch.column(0).to_pylist():
                if data:
                    n.update(filter(known, words_of(data)))
            return pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], names=["word", "n"])

        return each

    counted = map_slices(documents.select(F.col(text_column).cast("binary").alias("text")), make, "word binary, n long")
    return {bytes(w): n for w, n in counted.groupBy("word").agg(F.sum("n")).collect()}


def _pass(documents: DataFrame, items: list[tuple[int, bytes]], window: int, kind: str) -> DataFrame:
    """One block of items against all documents: doc_id, text_sha, n_words, starts, ends (of merged hit runs), items."""
    index = Index(items, window)
    index.order_by_rarity(word_counts(documents, set(index.vocabulary), "text") if index.vocabulary else {})
    shared = documents.sparkSession.sparkContext.broadcast(index)

    def make():
        index = shared.value
        number = index.vocabulary.get

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            data = batch.column(1).to_pylist()
            lists = [np.array([number(w, -1) for w in words_of(t)] if t else [], np.int32) for t in data]
            ns = np.array([len(x) for x in lists], np.int64)
            ends = np.cumsum(ns)
            owner = np.repeat(np.arange(len(ns)), ns)
            ids = np.concatenate([*lists, np.zeros(0, np.int32)])
            a, n, kind_of, w = index.find(ids, (ends - ns)[owner], ends[owner])
            starts, stops, found = [[] for _ in data], [[] for _ in data], [[] for _ in data]
            order = np.lexsort((n, a))
            for i, at, to, k, x in zip(*(v.tolist() for v in (owner[a[order]], a[order], (a + n)[order], kind_of[order], w[order]))):
                shift = int(ends[i] - ns[i])
                if stops[i] and at - shift <= stops[i][-1]:
                    stops[i][-1] = max(stops[i][-1], to - shift)
                else:
                    starts[i].append(at - shift)
                    stops[i].append(to - shift)
                found[i].append((k, x))
            items = []
            for own in found:
                held = [index.windows[k].items[index.windows[k].first_item[x] : index.windows[k].first_item[x + 1]] for k, x in set(own)]
                items.append(sorted({index.names[j] for j in np.unique(np.concatenate(held)).tolist()}) if held else [])
            shas = [hashlib.sha256(t).digest() if t is not None else None for t in data]
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(shas, pa.binary()), pa.array(ns, pa.int64()), pa.array(starts, pa.list_(pa.int64())), pa.array(stops, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.int64()))],
                names=["doc_id", "text_sha", "n_words", "starts", "ends", "items"],
            )

        return each

    return map_slices(documents, make, f"doc_id {kind}, text_sha binary, n_words long, starts array<long>, ends array<long>, items array<long>")


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = 13, share: tuple[int, int] = (1, 20), id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated (hit words are at least this share), hit runs [starts, ends), item_ids."""
    docs = documents.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("binary").alias("text"))
    kind = dict(docs.dtypes)["doc_id"]
    passes = [_pass(docs, b, window, kind) for b in item_blocks(benchmark, item_column, item_text, block_bytes)]
    hits = passes[0]
    if len(passes) > 1:  # a row's hits of every block, united; equal rows are counted and given back
        rows = hits
        for p in passes[1:]:
            rows = rows.unionByName(p)
        pairs = F.expr("transform(flatten(collect_list(arrays_zip(starts, ends))), x -> named_struct('a', x.starts, 'b', x.ends))")
        rows = rows.groupBy("doc_id", "text_sha").agg(F.first("n_words").alias("n_words"), F.array_sort(pairs).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.count(F.lit(1)).alias("copies"))
        joined = F.expr(
            "aggregate(runs, cast(array() as array<struct<a: bigint, b: bigint>>), (acc, r) -> if(size(acc) > 0 and r.a <= element_at(acc, -1).b,"
            " concat(slice(acc, 1, size(acc) - 1), array(named_struct('a', element_at(acc, -1).a, 'b', greatest(element_at(acc, -1).b, r.b)))), concat(acc, array(r))))"
        )
        rows = rows.withColumn("runs", joined).withColumn("copy", F.explode(F.sequence(F.lit(1), (F.col("copies") / len(passes)).cast("int"))))
        hits = rows.select("doc_id", "text_sha", "n_words", F.expr("transform(runs, r -> r.a)").alias("starts"), F.expr("transform(runs, r -> r.b)").alias("ends"), "items")
    n_hit = F.expr("aggregate(zip_with(starts, ends, (a, b) -> b - a), 0L, (s, x) -> s + x)")
    listed = F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",")
    return (
        hits.withColumn("n_hit", n_hit)
        .withColumn("n_items", F.size("items").cast("long"))
        .withColumn("items_sha256", F.sha2(listed.cast("binary"), 256))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (share[1] * F.col("n_hit") >= share[0] * F.col("n_words")))
        .select(F.col("doc_id").alias(id_column), "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "starts", "ends", F.col("items").alias("item_ids"))
    )
