"""Similarity join of documents on sets of word 5-grams: a blocked, masked sparse product of the document by n-gram incidence matrix.

A row of the matrix is a different text (texts.py); copies are no further rows. Pairs are discarded by size-derived bounds before their overlaps are accumulated:

1. Probe. Sets that link share at least ceil(t n) of n n-grams, so of the (1 - t) n + t' entries of lowest hash at least t'. A set with fewer there
   that any other text holds can link with nothing. Most texts end here, for about a third of the entries.
2. Columns. Whole rows of the rest are counted by column; rows whose entries held elsewhere are fewer than ceil(t n) go, and each row keeps
   as its prefix the (1 - t) n + 1 rarest n-grams, of which linked sets share one.
3. Mask. A column of the prefixes ties its pivot (one of its members; in the first round the one with the smallest share of n-grams of its own, as the text that others were made from has, then any) to
   the members in other components, which is linear in the column, less those whose sizes differ too much or that have too few n-grams left from the column on. The pivot has met
   all of its column then and leaves it, so no round repeats a pair of a column.
4. Product. Pivots are dealt to blocks of bounded text, and the members that the mask ties to a block go there once, in slices. A block task
   multiplies the slice of the matrix with the block's pivots, pivot by pivot: a member's overlap is the sum of the pivot's indicator over the member's
   columns. Entries of the masked pairs are computed only, and kept if the overlap reaches the bound of their sizes.
5. Links join components; columns within one component have nothing left to tell. Rounds of pivots (`rounds` at least, `most_rounds` at most) go on while the columns left
   have many more pairs than entries and each round at least halves the pairs; then the mask is all those across components, within the bounds and those of a parity bitmap: a bit for each of
   `PARITIES` classes of n-grams tells whether a set has an odd number of them, and every bit in which two sets differ stands for at least one n-gram that only one of them has.

The block task compares words, not hashes (wordhash.identities); a hash that clashes can only let more through to it. So no link between different
sets is lost, and none is made that the words don't bear out; only links that don't change a component aren't listed.

Defined results: null, empty and white-space texts have no n-grams and link with nothing; a text of fewer words than n is one n-gram.
Rows keep their number, and repeated rows link like any equal sets; rows without an id have the component of the ids they are linked with, or null.
Other columns are never read. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfix.llm import wordhash
from skyfix.llm.common import bound_batches, discard, slices, written
from skyfix.llm.components import components
from skyfix.llm.texts import SLICE, firsts, held_by_several, list_column, narrowed, own_keys, text_table

WIDTH = 5
#: What a set must share in its probe, as a share of the whole set: more makes probes longer and rows fewer.
PROBE_SHARED = 0.1
#: Bytes of text of the pivots of one block, and of the members that one task multiplies with it.
BLOCK_BYTES, MEMBER_BYTES = 1 << 20, 16 << 20
#: Rounds of pivots go on while the columns still open have more pairs than this many times their entries.
PAIRS = 4
#: Bits of a set's parity bitmap (a multiple of 64): they tell sets apart that are up to about as large.
PARITIES = 1024


def shingles(w: wordhash.Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, first word, size by text) of the distinct n-grams of every text, in order of keys; keys may clash, but the n-grams differ by their words."""
    size = np.where(w.counts >= n, w.counts - n + 1, np.minimum(w.counts, 1))
    places = wordhash.spread(size, w.first)
    owner = np.repeat(np.arange(len(size)), size)
    every = wordhash.runs(w.hashes, n)
    keys = np.empty(len(places), np.uint64)
    whole = (w.counts >= n)[owner]
    keys[whole] = every[places[whole]]
    for c in range(1, n):
        own = w.counts[owner] == c
        if own.any():
            keys[own] = wordhash.runs(w.hashes, c)[places[own]]
    order = np.lexsort((keys, owner))
    keys, places, owner = keys[order], places[order], owner[order]
    again = np.zeros(len(keys), bool)
    again[1:] = (keys[1:] == keys[:-1]) & (owner[1:] == owner[:-1])
    at = np.flatnonzero(again)
    if len(at):
        differ = np.zeros(len(at), bool)
        for i in range(n):
            longer = w.counts[owner[at]] > i
            differ[longer] |= w.differ(places[at[longer]] + i, places[at[longer] - 1] + i)
        clash = np.cumsum(~again)
        for g in np.unique(clash[at[differ]]).tolist():  # clashing hashes: all n-grams of this hash by their words
            seen: set = set()
            for x in range(*np.searchsorted(clash, [g, g + 1]).tolist()):
                gram = tuple(w.word(int(places[x]) + k) for k in range(min(n, int(w.counts[owner[x]]))))
                again[x] = gram in seen
                seen.add(gram)
    keep = ~again
    return keys[keep], places[keep], np.bincount(owner[keep], minlength=len(size))


def _need(n, percent: int):
    """The least overlap of a set of n with any set it links with."""
    return -(-n * percent // 100)


def _probe(n: int, percent: int):
    """extract of texts.text_table: sizes of the sets, and their entries of lowest hash."""

    def extract(w: wordhash.Words):
        keys, _, size = shingles(w, n)
        take = np.minimum(size, size - _need(size, percent) + np.maximum(1, (size * PROBE_SHARED).astype(np.int64)))
        return size, take, keys[wordhash.spread(take, np.cumsum(size) - size)]

    return extract


def _survivors(texts: DataFrame, each: DataFrame) -> DataFrame:
    """Rows of different texts that share enough of their probe."""
    found = held_by_several(own_keys(texts, each)).groupBy("row").agg(F.count(F.lit(1)).alias("found")).join(texts.select("row", "n"), "row")
    return written(found.where(F.col("found") >= F.greatest(F.lit(1), (F.col("n") * PROBE_SHARED).cast("long"))).select("row"), "ngram-survivors")


def parities(keys: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A bitmap for each set, as 64-bit numbers: bit i is set if an odd number of its n-grams have a key of class i."""
    owner = np.repeat(np.arange(len(size)), size)
    odd = np.zeros((len(size), PARITIES), np.uint8)
    place, times = np.unique(owner * PARITIES + (keys & np.uint64(PARITIES - 1)).astype(np.int64), return_counts=True)
    odd.ravel()[place] = times & 1
    return np.packbits(odd, axis=1, bitorder="little").view("<i8")


def _columns(rows: DataFrame, n: int) -> DataFrame:
    """(row, n, keys, parity) of whole rows of the matrix."""

    def run(batches):
        for batch in batches:
            for piece in slices(batch, "words", SLICE):
                keys, _, size = shingles(wordhash.Words(piece.column(1).to_pylist()), n)
                bits = parities(keys, size)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(size, pa.int64()), list_column(keys.astype(np.int64), size, pa.int64()), list_column(bits.ravel(), np.full(len(size), bits.shape[1]), pa.int64())], names=["row", "n", "keys", "parity"])

    bound_batches(rows.sparkSession)
    return written(rows.select("row", "words").mapInArrow(run, "row long, n long, keys array<long>, parity array<long>"), "ngram-columns")


def _prefixes(columns: DataFrame, percent: int) -> DataFrame:
    """(token, d, n, own, pos) of the rarest n-grams of rows that can link; own: how many of the row's n-grams none else holds, pos: how many come before this one."""
    held = held_by_several(columns.select("row", F.explode("keys").alias("key")))
    # a row's entries that others hold, by rarity; those that none holds come before them
    list_ = F.sort_array(F.collect_list(F.struct("holders", "key"))).alias("held")
    rows = held.groupBy("row").agg(list_).join(columns.select("row", "n"), "row").withColumn("shared", F.size("held")).withColumn("need", F.expr(f"-floor(-n * {percent} / 100)"))
    rows = rows.where("shared >= need").withColumn("held", F.expr("slice(held, 1, greatest(0, cast(shared - need + 1 as int)))"))
    out = rows.select(F.col("row").alias("d"), "n", "shared", F.posexplode("held").alias("rank", "x")).select(F.col("x.key").alias("token"), "d", "n", (F.col("n") - F.col("shared")).alias("own"), (F.col("n") - F.col("shared") + F.col("rank")).alias("pos"))
    return written(out, "ngram-prefixes")


def _overlaps(w: wordhash.Words, n: int, pivots: int, mask: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The masked product of a block: texts 0 to pivots - 1 are its pivots, the others members; mask[m]: the pivots of member m.

    Gives member, pivot, overlap and size of the union for every masked pair; n-grams are told apart by their words."""
    keys, places, size = shingles(w, n)
    words = np.concatenate([w.ids(), np.full(n, -1)])
    owner = np.repeat(np.arange(len(size)), size)
    length = np.minimum(n, w.counts[owner])

    def gram(i):
        return tuple(words[places[i] : places[i] + length[i]].tolist())

    def differ(i, j):
        out = length[i] != length[j]
        for k in range(n):
            out |= (words[places[i] + k] != words[places[j] + k]) & (length[i] > k)
        return out

    column = wordhash.identities(keys, differ, gram)
    first = np.cumsum(size) - size
    tied = np.fromiter((p for own in mask for p in own), np.int64)
    member = np.repeat(np.arange(len(mask)), [len(own) for own in mask])
    order = np.argsort(tied, kind="stable")
    tied, member = tied[order], member[order]
    overlap = np.zeros(len(tied), np.int64)
    indicator = np.zeros(int(column.max(initial=-1)) + 1, bool)
    bounds = np.searchsorted(tied, np.arange(pivots + 1))
    for p, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        if a == b:
            continue
        own = column[first[p] : first[p] + size[p]]
        indicator[own] = True
        rows = member[a:b] + pivots
        hits = indicator[column[wordhash.spread(size[rows], first[rows])]]
        overlap[a:b] = np.add.reduceat(hits, np.cumsum(size[rows]) - size[rows], dtype=np.int64)
        indicator[own] = False
    return member, tied, overlap, size[member + pivots] + size[tied] - overlap


def _linked(mask: DataFrame, rows: DataFrame, n: int, percent: int) -> DataFrame:
    """Of the pairs (member, pivot) of the mask those that link: overlaps accumulated block by block."""
    texts = rows.select("row", "words", F.length("words").alias("bytes"))
    at = "ngram-mask"
    mask = written(mask.distinct(), at)
    if mask.isEmpty():
        mask_ = mask.select(F.col("member").alias("u"), F.col("pivot").alias("v"))
        mask_._written_at = mask._written_at
        return mask_
    pivots = mask.select(F.col("pivot").alias("row")).distinct().join(texts, "row")
    blocks = max(1, int((pivots.agg(F.sum("bytes")).first()[0] or 0) // BLOCK_BYTES))
    block = F.pmod(F.xxhash64("pivot"), F.lit(blocks))
    tied = mask.groupBy(F.col("member").alias("row"), block.alias("block")).agg(F.collect_list("pivot").alias("pivots"))  # bounded by the member's prefix
    members = tied.join(texts, "row")
    # a block with many members is dealt to several tasks
    deals = members.groupBy("block").agg(F.ceil(F.sum("bytes") / MEMBER_BYTES).cast("int").alias("deals"))
    members = members.join(deals, "block").select("block", F.pmod(F.xxhash64("row"), F.col("deals")).cast("int").alias("deal"), F.lit(1).alias("kind"), "row", "words", "pivots")
    block_rows = pivots.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks))).join(deals, "block")
    block_rows = block_rows.select("block", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"), F.lit(0).alias("kind"), "row", "words", F.array().cast("array<long>").alias("pivots"))

    def run(batches):
        now, held, held_rows = None, [], {}
        for batch in batches:
            for piece in slices(batch, "words", SLICE):
                start, heads = 0, list(zip(*(piece.column(i).to_pylist() for i in (0, 1, 2))))
                while start < len(heads):
                    stop = start + 1
                    while stop < len(heads) and heads[stop] == heads[start]:
                        stop += 1
                    part = piece.slice(start, stop - start)
                    ids, words = part.column(3).to_pylist(), part.column(4).to_pylist()
                    if heads[start][:2] != now:
                        now, held, held_rows = heads[start][:2], [], {}
                    if heads[start][2] == 0:
                        for i, t in zip(ids, words):
                            held_rows[i] = len(held)
                            held.append(t)
                    else:
                        m, p, overlap, union = _overlaps(wordhash.Words([*held, *words]), n, len(held), [[held_rows[x] for x in own] for own in part.column(5).to_pylist()])
                        ok = 100 * overlap >= percent * union
                        if ok.any():
                            back = np.fromiter(held_rows, np.int64, len(held_rows))
                            yield pa.RecordBatch.from_arrays([pa.array(np.array(ids, np.int64)[m[ok]]), pa.array(back[p[ok]])], names=["u", "v"])
                    start = stop

    dealt = block_rows.unionByName(members).repartition("block", "deal").sortWithinPartitions("block", "deal", "kind")
    out = written(dealt.mapInArrow(run, "u long, v long"), "ngram-links")
    discard(mask)
    return out


def _labelled(posts: DataFrame, stars: DataFrame | None) -> DataFrame:
    """Postings with their components, without columns that lie in one."""
    if stars is None:
        return posts.withColumn("label", F.col("d"))
    rows = posts.join(stars.select(F.col("u").alias("d"), F.col("v").alias("root")), "d", "left").withColumn("label", F.coalesce("root", "d")).drop("root")
    several = rows.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("token")
    return rows.join(several, "token", "left_semi")


def _fitting(percent: int):
    """Whether the sizes allow a link, and so many n-grams from this one on (if it is the first the two rows share, they share no more)."""
    most = "least(n - pos, pivot.n - pivot.pos)"
    return F.expr(f"100 * least(n, pivot.n) >= {percent} * greatest(n, pivot.n) and 100 * {most} >= {percent} * (n + pivot.n - {most})")


def _leads(open_: DataFrame, step: int) -> DataFrame:
    """(token, pivot, held) of the columns still open: first the member with the smallest share of n-grams of its own, then any, another one for each column and round; and how many members a column has."""
    draw = [F.xxhash64("d", "token", F.lit(step)), F.col("d")]
    order = F.struct((F.col("own") * 64 / F.col("n")).cast("int"), *draw) if step == 0 else F.struct(*draw)
    return written(open_.groupBy("token").agg(F.min_by(F.struct("d", "label", "n", "pos"), order).alias("pivot"), F.count(F.lit(1)).cast("double").alias("held")), "ngram-leads")


def _mask(open_: DataFrame, leads: DataFrame, percent: int) -> DataFrame:
    """(member, pivot): the pivot's pairs of each column."""
    pairs = open_.join(leads, "token").where("label <> pivot.label")
    return pairs.where(_fitting(percent)).select(F.col("d").alias("member"), F.col("pivot.d").alias("pivot"))


def _whole_mask(open_: DataFrame, columns: DataFrame, percent: int) -> DataFrame:
    """(member, pivot): every pair across components of a column that sizes, positions and parities allow."""
    rows = open_.join(columns.select(F.col("row").alias("d"), "parity"), "d")
    pairs = rows.join(rows.select("token", F.struct("d", "label", "n", "pos", "parity").alias("pivot")), "token").where("pivot.label < label")
    apart = " + ".join(f"bit_count(parity[{i}] ^ pivot.parity[{i}])" for i in range(PARITIES // 64))
    return pairs.where(_fitting(percent)).where(f"{100 + percent} * ({apart}) <= {100 - percent} * (n + pivot.n)").select(F.col("d").alias("member"), F.col("pivot.d").alias("pivot"))


def similar(documents: DataFrame, n: int = WIDTH, percent: int = 75, id_column: str = "doc_id", text_column: str = "text", rounds: int = 1, most_rounds: int = 8, tagged: bool = False) -> DataFrame:
    """Per document: id, n_shingles, component_id (the smallest id reachable by links of at least this percentage of overlap to union).

    tagged: also digest (SHA-256 of the text) and leads: true for one row of each component (of smallest id) and for rows without n-grams."""
    docs = documents.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("binary").alias("text"))
    if tagged:
        docs = docs.withColumn("tag", F.unhex(F.sha2("text", 256)))
    texts = text_table(docs, _probe(n, percent), "ngram-texts")
    each = written(firsts(texts), "ngram-firsts")
    alive = _survivors(texts, each)
    rows = written(texts.join(alive, "row", "left_semi").select("row", "words"), "ngram-rows")
    texts = narrowed(texts, "ngram-ids")
    columns = _columns(rows, n)
    posts = _prefixes(columns, percent)
    discard(alive)
    stars, step, last, before = None, 0, False, float("inf")
    while not last:
        open_ = written(_labelled(posts, stars), "ngram-open")
        discard(posts)
        leads = _leads(open_, step)
        entries, pairs = leads.agg(F.coalesce(F.sum("held"), F.lit(0.0)), F.coalesce(F.sum(F.col("held") * (F.col("held") - 1) / 2), F.lit(0.0))).first()
        last = not entries or step >= most_rounds or (step >= rounds and (pairs <= PAIRS * entries or 2 * pairs > before))
        if last:
            edges = _linked(_whole_mask(open_, columns, percent), rows, n, percent)
        else:
            edges = _linked(_mask(open_, leads, percent), rows, n, percent)
            posts = written(open_.drop("label").join(leads.select("token", F.col("pivot.d").alias("met")), "token").where("d <> met").drop("met"), "ngram-prefixes")
        if stars is None or not (last and edges.isEmpty()):
            old, stars = stars, components(edges if stars is None else edges.select("u", "v").unionByName(stars))
            discard(*[old] if old is not None else [])
        discard(edges, open_, leads)
        step, before = step + 1, pairs
    discard(columns)
    # a component's smallest id, over the ids of its texts
    root = each.join(stars.select(F.col("u").alias("row"), F.col("v").alias("up")), "row", "left").withColumn("root", F.coalesce("up", "row"))
    heads = root.where("up is not null").select("root").distinct()
    tied = root.join(heads, "root", "left_semi")
    least = tied.groupBy("root").agg(F.min("id").alias("component"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))["row"].alias("leader"))
    alone = root.join(heads, "root", "left_anti").where("copies > 1").select("a", "b", F.col("id").alias("component"), F.col("row").alias("leader"))
    moved = written(tied.join(least, "root").select("a", "b", "component", "leader").unionByName(alone), "ngram-moved")  # texts of one row that stay alone aren't among them
    out = texts.select("row", "id", "tag", "n", "a", "b").join(moved, ["a", "b"], "left")
    more = [F.col("tag").alias("digest"), F.coalesce(F.col("row") == F.col("leader"), F.lit(True)).alias("leads")] if tagged else []
    out = out.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"), *more)
    out = written(out, "ngram-components")
    discard(texts, each, rows, stars, moved)
    return out
