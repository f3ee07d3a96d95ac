"""Repeated passages by a sparse suffix array: suffixes at minimisers, sorted by their words, compared with neighbours, extended to both sides.

Of a text's suffixes only those at minimisers stay: the places whose k-gram of words has the smallest hash of all k-grams in some window of
`min_words` words. Content alone selects them, so a passage of min_words words or more has the same ones wherever it stands. A suffix owns the
windows that it is the minimiser of: some words to its left and the rest to its right.

1. Heads. Copies of a text are one text (texts.py). Suffixes whose first k words no other text has end here.
2. Suffixes. The others are rows: the words to the right, up to min_words, and those to the left that a window of theirs can reach. They
   are dealt to ranges of their words and sorted; equal ones are dealt further by text, so that no task depends on how often a passage occurs.
3. Neighbours. In a segment of sorted suffixes each is compared with the one before, word by word, which gives how many words they share. For every reach to the
   left, the suffixes that share enough to the right are a run of neighbours, and are told apart by the words to the left, one word a step: those that still agree match
   in one window of min_words words, across all suffixes of the run. (The nearest neighbour alone isn't enough: the one that agrees furthest to the right may differ at once to the left.)
4. Borders. Runs that touch a segment's border may go on in the next one. Their windows are settled over all segments, by a 128-bit digest of the words.
5. Matching windows that follow or overlap each other are united, which gives the longest runs of repeated words.

A window's first holder is the document of smallest id. Words in windows that the document holds first are `kept`; words in windows that a document of smaller id
holds are not. A word can be in windows of both kinds (a passage from elsewhere within a longer one that stands here first): see `whole`.

Defined results: words are split at ASCII white space and A-Z count as a-z; null, empty or shorter texts have no passages; repeated rows are documents of
their own (both are holders of the smallest id); a row without an id is never first if one with an id has the window, and is reported without one. A window that
occurs in one document only, however often, is no match. Other columns are never read. Empty input, empty output.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfix.llm import wordhash
from skyfix.llm.common import MOST_SENT, bound_batches, discard, fresh, slices, written
from skyfix.llm.texts import SLICE, bytes_column, firsts, list_column, narrowed, own_keys, text_table

MIN_WORDS, K = 50, 8
NO_ID = (1 << 63) - 1
#: Suffixes that are compared at once.
SEGMENT = 1 << 14


def minimisers(w: wordhash.Words, min_words: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, place, k-gram) of every window of min_words words of every text: its first word and its minimiser (the leftmost of equal ones)."""
    windows = wordhash.spread(np.maximum(w.counts - min_words + 1, 0), w.first)
    if not len(windows):
        return windows, windows, np.zeros(0, np.uint64)
    grams = wordhash.runs(w.hashes, k)
    view = np.lib.stride_tricks.sliding_window_view(grams, min_words - k + 1)
    places = np.concatenate([view[a : a + (1 << 16)].argmin(axis=1) for a in range(0, len(view), 1 << 16)])[windows] + windows
    return windows, places, grams[places]


def _heads(min_words: int, k: int):
    """extract of texts.text_table: words of each text, and the different k-grams at its minimisers."""

    def extract(w: wordhash.Words):
        _, places, grams = minimisers(w, min_words, k)
        new = np.flatnonzero(np.diff(places, prepend=-1))
        owner, grams = np.searchsorted(w.first + w.counts, places[new], side="right"), grams[new]
        order = np.lexsort((grams, owner))
        owner, grams = owner[order], grams[order]
        once = np.ones(len(owner), bool)  # a line that a text repeats is one head
        once[1:] = (owner[1:] != owner[:-1]) | (grams[1:] != grams[:-1])
        return w.counts, np.bincount(owner[once], minlength=len(w.counts)), grams[once]

    return extract


def _suffixes(texts: DataFrame, each: DataFrame, min_words: int, k: int) -> DataFrame:
    """Suffixes of different texts whose head another text has: row, id (NO_ID: none), many (whether the text has copies), place, reach to the left (least, most), right, left."""
    entries = own_keys(texts, each)
    shared = entries.groupBy("key").agg(F.min("row").alias("lo"), F.max("row").alias("hi")).where("lo < hi")
    heads = entries.join(shared, "key").groupBy("row").agg(F.collect_set("key").alias("heads"))  # bounded by the text
    chosen = heads.join(each, "row").select("row", F.coalesce("id", F.lit(NO_ID)).alias("id"), (F.col("copies") > 1).alias("many"), "heads")
    rows = texts.select("row", "words").join(chosen, "row").select("row", "words", "id", "many", "heads")

    def run(batches):
        for batch in batches:
            for piece in slices(batch, "words", SLICE):
                w = wordhash.Words(piece.column(1).to_pylist())
                windows, places, grams = minimisers(w, min_words, k)
                new = np.flatnonzero(np.diff(places, prepend=-1))
                least, most = places[new] - np.append(windows[new[1:] - 1], windows[-1:]), places[new] - windows[new]
                place, gram = places[new], grams[new]
                owner = np.searchsorted(w.first + w.counts, place, side="right")
                lists = piece.column(4)
                keep = np.zeros(len(place), bool)
                for i in range(piece.num_rows):
                    a, b = np.searchsorted(owner, [i, i + 1])
                    keep[a:b] = np.isin(gram[a:b].view(np.int64), lists[i].values.to_numpy())
                place, owner, least, most = place[keep], owner[keep], least[keep], most[keep]
                end = np.minimum(place + min_words, (w.first + w.counts)[owner]) - 1
                begin = place - most
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0).take(pa.array(owner)), piece.column(2).take(pa.array(owner)), piece.column(3).take(pa.array(owner)), *(pa.array(x.astype(np.int32)) for x in (place - w.first[owner], least, most)), bytes_column(w.flat, w.starts[place], w.ends[end] + 1), bytes_column(w.flat, w.starts[begin], w.starts[place])],
                    names=["row", "id", "many", "place", "least", "most", "right", "left"],
                )

    bound_batches(texts.sparkSession)
    return written(rows.mapInArrow(run, "row long, id long, many boolean, place int, least int, most int, right binary, left binary"), "suffix-rows")


def _matches(table: pa.Table, min_words: int) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], list[tuple[np.ndarray, int, np.ndarray, np.ndarray]]]:
    """Of a segment of sorted suffixes: the matching windows (suffix, reach, whether held first); and those that a border leaves open, as (suffixes, reach, first place, size) of each window's holders."""
    right, left = table.column("right").to_pylist(), table.column("left").to_pylist()
    row, id_, many = (table.column(c).to_numpy(zero_copy_only=False) for c in ("row", "id", "many"))
    least, most = (table.column(c).to_numpy() for c in ("least", "most"))
    n = len(row)
    w = wordhash.Words([*right, *left])
    ids, size = w.ids(), w.counts
    top = int(ids.max(initial=0)) + 2
    ahead, behind = np.full((n, min_words), -1, np.int32), np.full((n, int(most.max(initial=0)) + 1), -1, np.int32)
    cut = int(size[:n].sum())
    ahead[np.repeat(np.arange(n), size[:n]), wordhash.spread(size[:n])] = ids[:cut]
    behind[np.repeat(np.arange(n), size[n:]), np.repeat(size[n:], size[n:]) - 1 - wordhash.spread(size[n:])] = ids[cut:]
    common = np.zeros(n, np.int64)
    if n > 1:
        common[1:] = np.logical_and.accumulate((ahead[1:] == ahead[:-1]) & (ahead[1:] >= 0), axis=1).sum(axis=1)
    same = np.zeros(n, np.int64)  # suffixes that agree in the last `reach` words to the left have the same number
    hits, open_ = [], []
    for reach in range(int(most.max(initial=-1)) + 1):
        if reach:
            same = np.unique(same * top + behind[:, reach - 1] + 1, return_inverse=True)[1]
        own = np.flatnonzero((least <= reach) & (reach <= most))
        if not len(own):
            continue
        run = np.cumsum(common < min_words - reach)
        window = run[own] * (n + 1) + same[own]
        order = np.argsort(window, kind="stable")
        own, window = own[order], window[order]
        at = np.flatnonzero(np.diff(window, prepend=-1))
        size_of = np.diff(at, append=len(own))
        border = (run[own[at]] == run[0]) | (run[own[at]] == run[-1])
        open_.append((own, reach, at[border], size_of[border]))
        some = np.minimum.reduceat(row[own], at) < np.maximum.reduceat(row[own], at)
        hit = np.repeat((some | np.logical_or.reduceat(many[own], at)) & ~border, size_of)
        first = id_[own] == np.repeat(np.minimum.reduceat(id_[own], at), size_of)
        hits.append((own[hit], np.full(int(hit.sum()), reach), first[hit]))
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*hits)) if hits else (none, none, none.astype(bool)), open_


def _compared(suffixes: DataFrame, min_words: int, segment: int) -> DataFrame:
    """Written rows of two kinds: matching windows of a text (row; hits, firsts: lists of window starts), and windows left open, once a segment (x and y: digest;
    lo, hi, first, copied: smallest and largest row and smallest id of the holders, and whether one has copies; rows, hits, ids: the holders, with the window's start)."""

    def segments(batches):
        held, size = [], 0
        for batch in batches:
            while size + batch.num_rows >= segment:
                held.append(batch.slice(0, segment - size))
                batch = batch.slice(segment - size)
                yield pa.Table.from_batches(held)
                held, size = [], 0
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
        if held:
            yield pa.Table.from_batches(held)

    def run(batches):
        for table in segments(batches):
            (i, reach, first), open_ = _matches(table, min_words)
            row, place, id_, many = (table.column(c).to_numpy(zero_copy_only=False) for c in ("row", "place", "id", "many"))
            yield _by_row(row[i], (place[i] - reach).astype(np.int32), first, WINDOW_NAMES, WINDOW_KINDS)
            right, left = table.column("right"), table.column("left")
            for own, far, at, size in open_:
                if len(at):
                    digests = np.frombuffer(b"".join(_window_digest(left[j].as_py(), right[j].as_py(), far, min_words) for j in own[at].tolist()), "<i8").reshape(-1, 2)
                    every = own[wordhash.spread(size, at)]
                    bounds = np.cumsum(size) - size
                    columns = {"x": np.ascontiguousarray(digests[:, 0]), "y": np.ascontiguousarray(digests[:, 1]), "lo": np.minimum.reduceat(row[every], bounds), "hi": np.maximum.reduceat(row[every], bounds), "first": np.minimum.reduceat(id_[every], bounds), "copied": np.logical_or.reduceat(many[every], bounds)}
                    columns |= {"rows": list_column(row[every], size, pa.int64()), "hits": list_column((place[every] - far).astype(np.int32), size, pa.int32()), "ids": list_column(id_[every], size, pa.int64())}
                    yield pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns and isinstance(columns[c], np.ndarray) else columns.get(c, pa.nulls(len(at), k)) for c, k in zip(WINDOW_NAMES, WINDOW_KINDS)], names=WINDOW_NAMES)

    bound_batches(suffixes.sparkSession)
    dealt = suffixes.repartitionByRange("right", "row").sortWithinPartitions("right", "row")
    return written(dealt.mapInArrow(run, "row long, hits array<int>, firsts array<int>, x long, y long, lo long, hi long, first long, copied boolean, rows array<long>, ids array<long>"), "suffix-windows")


WINDOW_NAMES = ["row", "hits", "firsts", "x", "y", "lo", "hi", "first", "copied", "rows", "ids"]
WINDOW_KINDS = [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), *[pa.int64()] * 5, pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64())]


def _by_row(row: np.ndarray, starts: np.ndarray, first: np.ndarray, names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    """One row for each different row: hits, its starts, and firsts, those that are marked; other columns are null."""
    order = np.argsort(row, kind="stable")
    row, starts, first = row[order], starts[order], first[order]
    which, count = np.unique(row, return_counts=True)
    kept = np.bincount(np.repeat(np.arange(len(which)), count)[first], minlength=len(which))
    columns = {"row": pa.array(which, pa.int64()), "hits": list_column(starts, count, pa.int32()), "firsts": list_column(starts[first], kept, pa.int32())}
    return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(len(which), k)) for c, k in zip(names, kinds)], names=names)


def _settled(windows: DataFrame) -> DataFrame:
    """(row, hits, firsts) of the windows left open, by what all segments hold."""
    open_ = windows.where("x is not null")
    counts = open_.groupBy("x", "y").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("first").alias("least"), F.max("copied").alias("copied")).where("lo < hi or copied")
    found = open_.select("x", "y", "rows", "hits", "ids").join(counts.select("x", "y", "least"), ["x", "y"]).select("rows", "hits", "ids", "least")

    def run(batches):
        for batch in batches:
            sizes = np.diff(batch.column(0).offsets.to_numpy())
            row, starts, ids = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in (0, 1, 2))
            yield _by_row(row, starts, ids == np.repeat(batch.column(3).to_numpy(), sizes), WINDOW_NAMES[:3], WINDOW_KINDS[:3])

    return found.mapInArrow(run, "row long, hits array<int>, firsts array<int>")


def _window_digest(left: bytes, right: bytes, reach: int, min_words: int) -> bytes:
    before = left.rsplit(b" ", reach + 1)[-reach - 1 : -1]
    after = right.split(b" ", min_words - reach)[: min_words - reach]
    return hashlib.blake2b(b" ".join([*before, *after]), digest_size=16).digest()


def _ranges(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Words covered by the windows of these starts."""
    edge = np.bincount(starts, minlength=n + 1)[: n + 1] - np.bincount(starts + size, minlength=n + 1)[: n + 1]
    return np.cumsum(edge)[:n] > 0


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.diff(mask.astype(np.int8), prepend=0, append=0)
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))


def repeats(documents: DataFrame, min_words: int = MIN_WORDS, k: int = K, id_column: str = "doc_id", text_column: str = "text", whole: bool = False, segment: int = SEGMENT) -> DataFrame:
    """Passages that other documents hold too: id, digest (SHA-256 of the text), start and end in words, n_words, kept.

    whole: rows not kept have all words of windows that a document of smaller id holds, those within kept rows too."""
    docs = documents.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("binary").alias("text"))
    texts = text_table(docs.withColumn("tag", F.unhex(F.sha2("text", 256))), _heads(min_words, k), "suffix-texts")
    each = written(firsts(texts.where(F.col("n") >= min_words)), "suffix-firsts")
    suffixes = _suffixes(texts, each, min_words, k)
    texts = narrowed(texts, "suffix-ids")
    windows = _compared(suffixes, min_words, segment)
    discard(suffixes)

    found = windows.where("x is null").select("row", "hits", "firsts").unionByName(_settled(windows))
    found = found.groupBy("row").agg(F.flatten(F.collect_list("hits")).alias("hits"), F.flatten(F.collect_list("firsts")).alias("firsts"))  # bounded by the text
    found = found.join(each.select("row", "copies"), "row").join(texts.select("row", "n"), "row").select("row", "n", "copies", "hits", "firsts")

    def run(batches):
        for batch in batches:
            spans = []
            for i in range(batch.num_rows):
                n = batch.column(1)[i].as_py()
                hits, first = (batch.column(c)[i].values.to_numpy() for c in (3, 4))
                others = np.setdiff1d(hits, first)
                if batch.column(2)[i].as_py() > 1:  # copies hold every window
                    first = np.setdiff1d(np.arange(n - min_words + 1), others)
                kept, lost = _ranges(first, min_words, n), _ranges(others, min_words, n)
                spans.append([{"start": a, "end": b, "kept": flag} for mask, flag in ((kept, True), (lost if whole else lost & ~kept, False)) for a, b in _runs(mask)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kept", pa.bool_())])))], names=["row", "spans"])

    spans = written(found.mapInArrow(run, "row long, spans array<struct<start: long, end: long, kept: boolean>>"), "suffix-spans")
    about = each.join(spans, "row", "left").where("copies > 1 or spans is not null").select("a", "b", F.col("id").alias("first"), "copies", "spans")
    rows = texts.where(F.col("n") >= min_words).select("id", "tag", "a", "b", "n").join(about, ["a", "b"])
    own = F.col("id").eqNullSafe(F.col("first"))
    all_ = F.when(F.col("copies") > 1, F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n").alias("end"), own.alias("kept"))))
    rows = rows.select("id", "tag", F.explode(F.when(own & F.col("spans").isNotNull(), F.col("spans")).otherwise(all_)).alias("x"))
    out = rows.select(F.col("id").alias(id_column), F.col("tag").alias("digest"), F.col("x.start").alias("start_word"), F.col("x.end").alias("end_word"), (F.col("x.end") - F.col("x.start")).alias("n_words"), F.col("x.kept").alias("kept"))
    out = written(out, "suffix-repeats")
    discard(texts, each, windows, spans)
    return out


def without_repeats(documents: DataFrame, min_words: int = MIN_WORDS, k: int = K) -> DataFrame:
    """The documents table without the words of windows that a document of smaller id holds; n_chars follows. A document of which nothing is left goes."""
    key, digest, cuts = (fresh(documents, n) for n in ("_key", "_digest", "_spans"))
    spans = repeats(documents, min_words, k, whole=True).where("not kept").groupBy(F.coalesce("doc_id", F.lit(NO_ID)).alias(key), F.col("digest").alias(digest)).agg(F.sort_array(F.collect_set(F.struct("start_word", "end_word"))).alias(cuts))
    spans = written(spans, "suffix-cuts")
    if (spans.agg(F.sum(F.size(cuts))).first()[0] or 0) <= MOST_SENT:  # then no text has to move
        spans = F.broadcast(spans)
    rows = documents.withColumns({key: F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), digest: F.unhex(F.sha2(F.col("text").cast("binary"), 256))}).join(spans, [key, digest], "left").drop(key, digest)
    kinds = documents.schema
    names = kinds.names

    def run(batches):
        for batch in batches:
            texts, spans = batch.column(names.index("text")).to_pylist(), batch.column(len(names)).to_pylist()
            keep = np.ones(batch.num_rows, bool)
            lengths = batch.column(names.index("n_chars")).to_pylist() if "n_chars" in names else None
            for i, own in enumerate(spans):
                if not own:
                    continue
                data = texts[i].encode()
                starts = wordhash.Words([data]).starts
                out, at = [], 0
                for s in own:
                    out.append(data[at : int(starts[s["start_word"]])])
                    at = int(starts[s["end_word"]]) if s["end_word"] < len(starts) else len(data)
                text = b"".join([*out, data[at:]])
                keep[i] = bool(text.split())
                texts[i] = text.decode()
                if lengths is not None:
                    lengths[i] = len(texts[i])
            columns = [batch.column(j) for j in range(len(names))]
            columns[names.index("text")] = pa.array(texts, columns[names.index("text")].type)
            if lengths is not None:
                columns[names.index("n_chars")] = pa.array(lengths, columns[names.index("n_chars")].type)
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep))

    return rows.select(*names, cuts).mapInArrow(run, kinds)
