"""Language identification by a linear-chain conditional random field over words.

Words are runs of letters of the lower-cased text. A word's potentials sum the weights of its affixes (one to three characters), its
character bigrams and trigrams, and its entry in the lexicon of frequent training words; learned transitions join neighbouring words.
Exact forward-backward gives every word's label probabilities, so that code-switched text is labelled word by word; a
document's language is the one with the highest mean probability over its words, which is the score.

Training maximises the likelihood of code-switched sequences: fragments of a few words of documents of any language, dealt
in random order (of a fixed seed), each word labelled with its document's language. The documents are a bounded sample: those of lowest hash of their id, at most
`per_language` of each language and about `sample` in all, and at most `window` characters of each. Every language is learned, or the `max_languages` most frequent if that is given;
with more languages the buckets of features get fewer, so that all weights stay below a fixed number.

Inference is vectorised: documents are cut into blocks whose transfer matrices are multiplied in lockstep, messages pass
from block to block, and then again in lockstep inside all blocks. The result is that of one pass over each document.

Defined results: `und` and 0.0 for null text, text without a letter, or without any training row. Equal texts get equal
results; null or repeated ids keep their rows; null ids and languages aren't learned from. Columns besides id, text (and lang, in fit) are never read.
"""

from __future__ import annotations

import dataclasses
import functools
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyfix.llm.common import appended, crc_mod, discard, written

PER_LANGUAGE, WINDOW = 800, 2000
BUCKETS, LEXICON, BLOCK, SLICE = 1 << 18, 1 << 16, 64, 1 << 20
#: Entries of all blocks' transfer matrices at once: with many languages or a very long text blocks grow instead.
PRODUCTS = 1 << 24
#: Documents of the sample over all languages, each of which gives at least one, and weights of n-grams and affixes over all languages.
SAMPLE, WEIGHTS = 3200, 1 << 24
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MULTIPLIER
    return h ^ (h >> np.uint64(29))


class Words:
    """The words of some texts: codes of all characters, word bounds, and how many words each text has."""

    def __init__(self, texts: list[str | None]):
        low = [(t or "").lower() for t in texts]
        self.codes = np.frombuffer("\n".join([*low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters()[self.codes]
        edge = np.diff(letter.astype(np.int8), prepend=0)
        self.starts = np.flatnonzero(edge == 1)
        self.ends = np.flatnonzero(edge == -1)  # every text ends in a line break, so every word ends
        text_ends = np.cumsum(np.fromiter(map(len, low), np.int64, len(low)) + 1)
        self.per_text = np.diff(np.searchsorted(self.starts, text_ends), prepend=0) if len(low) else np.zeros(0, np.int64)

    def _hashed(self, salt: int, parts: list[np.ndarray]) -> np.ndarray:
        h = np.full(parts[0].shape, np.uint64(salt))
        for p in parts:
            h = (h + p.astype(np.uint64)) * MULTIPLIER
        return (_mix(h) >> np.uint64(46)).astype(np.int64)  # 18 bits

    def affixes(self):
        """Buckets of each word's affixes, an array for each kind; shorter words use what they have."""
        c, last = self.codes, self.ends - 1
        for k in range(3):
            yield self._hashed(11 + k, [c[np.minimum(self.starts + i, last)] for i in range(k + 1)])
            yield self._hashed(21 + k, [c[np.maximum(last - i, self.starts)] for i in range(k + 1)])

    def ngrams(self):
        """(buckets, first place of each word in them) of bigrams and trigrams; a word of one letter is padded with what follows it."""
        c = np.concatenate([self.codes, np.zeros(3, np.uint32)])
        sizes = self.ends - self.starts
        for n in (2, 3):
            count = np.maximum(sizes - n + 1, 1)
            first = np.cumsum(count) - count
            at = np.arange(int(count.sum())) + np.repeat(self.starts - first, count)
            yield self._hashed(30 + n, [c[at + i] for i in range(n)]), first


@dataclasses.dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    weights: np.ndarray  # buckets, then entries of the lexicon; a column for each language
    transitions: np.ndarray  # exp of the learned transitions
    lexicon: np.ndarray  # hash of the word in each slot (0: none)
    entries: np.ndarray  # its row in weights
    buckets: int = BUCKETS  # a power of two


#: Without any training row: no language.
UNTRAINED = Model((), np.zeros((0, 0), np.float32), np.ones((0, 0)), np.zeros(LEXICON, np.uint64), np.zeros(LEXICON, np.int64))


def word_keys(words: Words) -> np.ndarray:
    """A 64-bit hash of each word: its length and up to 12 letters from either end."""
    c, last = words.codes, words.ends - 1
    h = (words.ends - words.starts).astype(np.uint64) * MULTIPLIER
    for i in range(12):
        h = _mix(h + c[np.minimum(words.starts + i, last)].astype(np.uint64) * np.uint64(2 * i + 3))
        h = _mix(h + c[np.maximum(last - i, words.starts)].astype(np.uint64) * np.uint64(2 * i + 41))
    return np.maximum(h, np.uint64(1))


def _slot(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(48)).astype(np.int64)


def emissions(words: Words, m: Model) -> np.ndarray:
    """Summed weights of each word's features, a column for each language."""
    w = m.weights
    out = np.zeros((len(words.starts), len(m.languages)), np.float32)
    if not len(out):
        return out
    for b in words.affixes():
        out += w[b & (m.buckets - 1)]
    for b, first in words.ngrams():
        out += np.add.reduceat(w[b & (m.buckets - 1)], first, axis=0)
    keys = word_keys(words)
    slot = _slot(keys)
    hit = m.lexicon[slot] == keys
    out[hit] += w[m.entries[slot[hit]]]
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / x.reshape(len(x), -1).sum(axis=1).reshape(-1, *[1] * (x.ndim - 1))


def posteriors(scores: np.ndarray, a: np.ndarray, lengths: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Label probabilities of every word (exact forward-backward), for sequences of these lengths one after the other."""
    k = scores.shape[1]
    block = max(block, -(-len(scores) * k * k // PRODUCTS))
    e = np.exp(scores.astype(np.float64) - scores.max(axis=1, keepdims=True, initial=-np.inf)) + 1e-300
    lengths = lengths[lengths > 0]
    if not len(lengths):
        return np.zeros((0, k))
    blocks = -(-lengths // block)
    seq = np.repeat(np.arange(len(lengths)), blocks)
    level = np.arange(len(seq)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    begin = np.repeat(np.cumsum(lengths) - lengths, blocks) + level * block
    size = np.minimum(lengths[seq] - level * block, block)
    order = np.argsort(-size, kind="stable")  # lanes with more words first: those still going are always the first ones
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    begin, size = begin[order], size[order]
    going = [int(np.searchsorted(-size, -s, side="left")) for s in range(int(size[0]))]  # lanes with more than s words
    n = len(size)
    enter, leave = np.full((n, k), 1 / k), np.full((n, k), 1 / k)
    begins = level[order] == 0  # lanes where a sequence begins: every label is as likely there, and no transition leads to it
    if blocks.max() > 1:
        product = np.broadcast_to(np.eye(k), (n, k, k)).copy()
        for s, g in enumerate(going):
            moved = (product[:g].reshape(-1, k) @ a).reshape(g, k, k)
            if s == 0:
                moved[begins] = product[begins]
            product[:g] = _unit(moved * e[begin[:g] + s][:, None, :])
        by_level = np.argsort(level, kind="stable")
        bounds = np.searchsorted(level[by_level], np.arange(int(blocks.max()) + 1))
        for b in range(1, int(blocks.max())):
            here = by_level[bounds[b] : bounds[b + 1]]
            now, before = place[here], place[here - 1]
            enter[now] = _unit(np.einsum("ni,nij->nj", enter[before], product[before]))
        for b in range(int(blocks.max()) - 1, 0, -1):
            here = by_level[bounds[b] : bounds[b + 1]]
            now, before = place[here], place[here - 1]
            leave[before] = _unit(np.einsum("nij,nj->ni", product[now], leave[now]))
    out = np.empty((len(e), k))
    message = enter
    for s, g in enumerate(going):
        at = begin[:g] + s
        moved = message[:g] @ a
        if s == 0:
            moved[begins] = enter[begins]
        message[:g] = _unit(moved * e[at])
        out[at] = message[:g]
    message = leave
    back = a.T
    for s in range(len(going) - 1, -1, -1):
        g = going[s]
        at = begin[:g] + s
        out[at] *= message[:g]
        message[:g] = _unit((message[:g] * e[at]) @ back)
    return _unit(out)


def _lanes_gradient(scores: np.ndarray, labels: np.ndarray, a: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the negative log-likelihood, by scores and by transitions, for sequences of one length.

    The first word has scores alone, in the gold path as in the sum over all paths."""
    k = scores.shape[1]
    n = len(scores) // length
    e = np.exp(scores - scores.max(axis=1, keepdims=True)).reshape(n, length, k)
    y = labels.reshape(n, length)
    forward, backward = np.empty((length, n, k)), np.ones((length, n, k))
    forward[0] = m = _unit(e[:, 0])
    for s in range(1, length):
        forward[s] = m = _unit((m @ a) * e[:, s])
    for s in range(length - 1, 0, -1):
        backward[s - 1] = _unit((backward[s] * e[:, s]) @ a.T)
    gamma = forward * backward
    gamma /= gamma.sum(axis=2, keepdims=True)
    by_score = gamma.transpose(1, 0, 2).reshape(-1, k).copy()
    by_score[np.arange(len(labels)), labels] -= 1
    pair = np.zeros((k, k))
    for s in range(1, length):
        x = forward[s - 1][:, :, None] * a * (e[:, s] * backward[s])[:, None, :]
        pair += _unit(x).sum(axis=0)
    np.add.at(pair, (y[:, :-1].ravel(), y[:, 1:].ravel()), -1)
    return by_score, pair


def train(rows: list[tuple[str, str]], seed: int = 13, length: int = 48, batch: int = 256, epochs: int = 3, rate: float = 0.25) -> Model:
    """A model from (text, language) rows, by Adagrad on dealt fragments."""
    languages = tuple(sorted({lang for _, lang in rows}))
    k = len(languages)
    buckets = BUCKETS
    while buckets * k > WEIGHTS and buckets > 1 << 10:
        buckets >>= 1
    words = Words([t for t, _ in rows])
    if not len(words.starts):
        return UNTRAINED
    place = {lang: i for i, lang in enumerate(languages)}
    label = np.repeat(np.array([place[lang] for _, lang in rows]), words.per_text)
    rng = np.random.default_rng(seed)
    keys = word_keys(words)
    found, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    lexicon, entries = np.zeros(LEXICON, np.uint64), np.zeros(LEXICON, np.int64)
    frequent = np.flatnonzero(counts >= 5)
    frequent = frequent[np.argsort(counts[frequent], kind="stable")]  # where slots clash, the more frequent word stays
    lexicon[_slot(found[frequent])] = found[frequent]
    entries[_slot(found[frequent])] = buckets + np.arange(len(frequent))
    # features of every training word: affixes and lexicon as columns, n-grams as one flat list and its bounds
    slot = _slot(keys)
    affix = np.stack([*((b & (buckets - 1)).astype(np.int32) for b in words.affixes()), np.where(lexicon[slot] == keys, entries[slot], buckets + len(frequent)).astype(np.int32)], axis=1)
    grams = [((b & (buckets - 1)).astype(np.int32), first.astype(np.int32), np.diff(first, append=len(b)).astype(np.int32)) for b, first in words.ngrams()]
    weights = np.zeros((buckets + len(frequent) + 1, k), np.float32)
    t = np.zeros((k, k))
    seen_w, seen_t = np.full(weights.shape, 1e-2, np.float32), np.full(t.shape, 1e-2)
    for _ in range(epochs):
        # fragments of 3 to 24 words that don't cross documents, in random order
        cut = np.zeros(len(label), bool)
        at = np.cumsum(rng.integers(3, 25, size=len(label) // 3 + 2))
        cut[at[at < len(label)]] = True
        cut[np.cumsum(words.per_text[words.per_text > 0])[:-1]] = True
        cut[0] = True
        begin = np.flatnonzero(cut)
        sizes = np.diff(begin, append=len(label))
        deal = rng.permutation(len(begin))
        first = np.cumsum(sizes[deal]) - sizes[deal]
        order = np.arange(len(label)) + np.repeat(begin[deal] - first, sizes[deal])
        use = len(order) // length * length
        if not use:
            order, use = np.resize(order, length), length
        for a0 in range(0, use, batch * length):
            own = order[a0 : min(a0 + batch * length, use)]
            lists, whose = [affix[own].ravel()], [np.repeat(np.arange(len(own)), affix.shape[1])]
            scores = weights[affix[own]].sum(axis=1, dtype=np.float64)
            for b, f, c in grams:
                n = c[own].astype(np.int64)
                start = np.cumsum(n) - n
                lists.append(b[np.arange(int(n.sum())) + np.repeat(f[own] - start, n)])
                whose.append(np.repeat(np.arange(len(own)), n))
                scores += np.add.reduceat(weights[lists[-1]], start, axis=0)
            idx, who = np.concatenate(lists), np.concatenate(whose)
            by_score, by_pair = _lanes_gradient(scores, label[own], np.exp(t), length)
            by_feature = np.argsort(idx, kind="stable")
            used, first = np.unique(idx[by_feature], return_index=True)
            g = np.add.reduceat((by_score / len(own) * batch).astype(np.float32)[who[by_feature]], first, axis=0)
            seen_w[used] += g * g
            weights[used] -= rate * g / np.sqrt(seen_w[used])
            g = by_pair / len(own) * batch
            seen_t += g * g
            t -= rate * g / np.sqrt(seen_t)
    weights[-1] = 0
    return Model(languages, weights, np.exp(t), lexicon, entries, buckets)


def fit(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", held_out: tuple[int, int] = (4, 2), per_language: int = PER_LANGUAGE, window: int = WINDOW, sample: int = SAMPLE, max_languages: int | None = None) -> Model:
    """Learns from rows whose crc32 of the id, modulo held_out[0], isn't held_out[1].

    At most per_language texts of a language and about `sample` of all (but one of each language): those of lowest hash of id and text, each once however often its row is repeated."""
    known = documents.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), F.col(lang_column).alias("lang"))
    known = known.where(F.col("id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_mod("id", held_out[0]) != held_out[1]))
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    if max_languages is not None:
        counts = counts.orderBy(F.desc("n"), "lang").limit(max_languages)
        known = known.join(F.broadcast(counts.select("lang")), "lang", "left_semi")
    each = max(1, min(per_language, sample // max(1, counts.count())))
    known = known.withColumn("draw", F.shiftrightunsigned(F.xxhash64("id", "text"), 1))
    # draws are counted by their leading zeros, and only those of as many as are needed are ranked: about twice `each` rows of a language meet, whatever it has
    own = written(known.select("lang", "id", "draw").distinct().withColumn("level", 63 - F.ceil(F.log2(F.col("draw") + 1)).cast("int")), "langid-draws")
    upto = F.sum("n").over(Window.partitionBy("lang").orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, -1))
    levels = own.groupBy("lang", "level").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(upto, F.lit(0))).where(F.col("before") < each).groupBy("lang").agg(F.min("level").alias("least"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "id"))
    chosen = own.join(F.broadcast(levels), "lang").where("level >= least").withColumn("rank", rank).where(F.col("rank") <= each).select("lang", "id", "draw")
    spare = F.greatest(F.length("text") - window, F.lit(0))
    part = F.lit(1) + F.pmod(F.xxhash64("id", F.lit(1)), spare + 1)
    rows = known.select("lang", "id", "draw", F.substring("text", part.cast("int"), F.lit(window)).alias("text"))
    rows = rows.join(F.broadcast(chosen), ["lang", "id", "draw"]).groupBy("lang", "id", "draw").agg(F.min("text").alias("text"))
    rows = sorted(rows.collect(), key=lambda r: (r["draw"], r["id"], r["lang"]))
    discard(own)
    return train([(r["text"], r["lang"]) for r in rows]) if rows else UNTRAINED


def label_words(text: str, model: Model) -> list[tuple[str, str, float]]:
    """Every word of a text with its most probable language: for code-switched text."""
    w = Words([text])
    p = posteriors(emissions(w, model), model.transitions, w.per_text)
    low = text.lower()
    return [(low[a:b], model.languages[int(x.argmax())], float(x.max())) for a, b, x in zip(w.starts.tolist(), w.ends.tolist(), p)]


def _judge(m: Model):
    """A function that gives of texts the best language and its score."""
    names = [*m.languages, "und"]

    def each(texts: pa.Array) -> list[pa.Array]:
        n, k = len(texts), len(m.languages)
        best, score = np.full(n, k), np.zeros(n)
        if k:
            w = Words(texts.to_pylist())
            p = posteriors(emissions(w, m), m.transitions, w.per_text)
            has = np.flatnonzero(w.per_text)
            if len(has):
                first = (np.cumsum(w.per_text) - w.per_text)[has]
                mean = np.add.reduceat(p, first, axis=0) / w.per_text[has][:, None]
                best[has], score[has] = mean.argmax(axis=1), np.clip(mean.max(axis=1), 0, 1)
        return [pa.array([names[i] for i in best]), pa.array(score)]

    return each


def judged(documents: DataFrame, model: Model, text_column: str = "text", label: str = "lang_pred", score: str = "score") -> DataFrame:
    """All columns of documents, and the label and score of each text."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # its weights are bounded, see WEIGHTS
    size = max(1 << 16, (4 * SLICE) // max(4, len(model.languages)))
    return appended(documents, text_column, lambda: _judge(shared.value), T.StructType().add(label, "string").add(score, "double"), size)


def predict(documents: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text", held_out: tuple[int, int] | None = (4, 2)) -> DataFrame:
    """Per document: id, held_out (false without a fold), lang_pred, score."""
    fold = crc_mod("id", held_out[0]) == held_out[1] if held_out else F.lit(False)
    source = documents.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).withColumn("held_out", fold)
    return judged(source, model).select(F.col("id").alias(id_column), "held_out", "lang_pred", "score")
