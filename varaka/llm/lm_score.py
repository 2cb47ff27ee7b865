"""Language-model scores from a weighted backoff automaton.

Counting: words, bigrams and trigrams of all training texts are counted by
64-bit keys (words are equal when their hashes are, see ``text``), whatever their number and however rare they are; none is left out.
Nothing of the model is gathered in one place: documents are packed into blocks
of bounded size, and blocks ask (``blocks.Exchange``) for the counts of their
own n-grams: first of words and bigrams, then of the trigrams both of whose
bigrams were seen in training (no other can be seen).

Model: hierarchical Dirichlet smoothing over add-one word probabilities,

    p(w | context) = (n(context w) + K * p(w | shorter context)) / (n(context) + K)

written as an automaton.  A state is a context (none, a word, two words); an arc
carries log10 of its smoothed probability; the failure arc to the shorter
context carries log10 of the mass left over, K / (n(context) + K).  Every word
but the end is followed by one token, so n(context) is the sum over its arcs and
the probabilities of each state sum to one.  A block builds the states and
arcs its texts can reach and walks each text once from left to right, in lanes
of many texts at a time, adding up the arcs taken; lanes of one long text begin
with the two words before them.

Defined cases: a null or word-less text is its end token alone; without
training tokens N and V are 0 and every token has probability 1 (log 0); rows
that repeat a doc_id are each learned from and each give a row; a null doc_id
has no remainder: it is scored, never learned from, and not held out; other
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varaka.llm.blocks import Answers, Exchange, asked, blocks_of, distinct, unpacked_rows
from varaka.llm.stage import Tables
from varaka.llm.text import Words, mix, words

#: weight of the shorter context beside the counts of a word's and of two words' context
K1, K2 = 300.0, 3.0
LANE = 256
BLOCK_BYTES = 2_000_000
#: n-grams of so many bytes of text meet in a bucket
BUCKET_BYTES = 6_000_000
END = np.uint64(0xE4D0F7E47E4D0F7E)
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def tokens(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes with an end after each document, offsets)."""
    at = w.offsets + np.arange(len(w.offsets))
    out = np.full(at[-1], END)
    keep = np.ones(len(out), bool)
    keep[at[1:] - 1] = False
    out[keep] = w.hashes
    return out, at


def _key(order: int, *hashes: np.ndarray) -> np.ndarray:
    """Keys of n-grams; the two lowest bits hold the order."""
    key = hashes[0]
    for h in hashes[1:]:
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + h)
    return (key & ~np.uint64(3)) | np.uint64(order)


class Grams:
    """The n-grams of a block: distinct sorted ``keys`` of words and bigrams, and for every token the places of those that begin with it (-1: none).

    ``n`` is how often the block's own training texts have each key.  ``trigrams`` adds those of trigrams.
    """

    def __init__(self, rows: pa.Table):
        hashes, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for w in words(rows.column("text")):
            part, at = tokens(w)
            hashes.append(part)
            sizes.append(np.diff(at))
        self.hashes, sizes = np.concatenate(hashes), np.concatenate(sizes)
        self.at = np.append(0, sizes.cumsum())
        self.doc = np.repeat(np.arange(len(sizes)), sizes)
        self.learn = ~(np.asarray(rows.column("held_out")) | np.asarray(rows.column("doc_id").is_null()))[self.doc]
        h, self.two = self.hashes, np.flatnonzero(self.doc[1:] == self.doc[:-1])
        self.keys, place = distinct(np.concatenate([_key(1, h), _key(2, h[self.two], h[self.two + 1])]))
        self.order = (self.keys & np.uint64(3)).astype(np.int64)
        self.one, self.pair = place[: len(h)], np.full(len(h), -1)
        self.pair[self.two] = place[len(h) :]
        self.n = np.bincount(place, np.concatenate([self.learn, self.learn[self.two]]), len(self.keys)).astype(np.int64)
        # the words of a bigram
        self.first, self.second = np.full(len(self.keys), -1), np.full(len(self.keys), -1)
        self.first[self.pair[self.two]], self.second[self.pair[self.two]] = self.one[self.two], self.one[self.two + 1]

    def trigrams(self, n: np.ndarray) -> None:
        """Keys, counts and bigrams of the trigrams whose bigrams have counts; ``n``: the counts of words and bigrams."""
        known = np.append(n, 0)[self.pair] > 0  # place -1: none
        three = np.flatnonzero(known[:-2] & known[1:-1] & (self.doc[2:] == self.doc[:-2]))
        h = self.hashes
        self.keys3, place = distinct(_key(3, h[three], h[three + 1], h[three + 2]))
        self.n3 = np.bincount(place, self.learn[three], len(self.keys3)).astype(np.int64)
        self.head, self.tail = np.zeros(len(self.keys3), np.int64), np.zeros(len(self.keys3), np.int64)
        self.head[place], self.tail[place] = self.pair[three], self.pair[three + 1]


def _ask_words(buckets: int):
    def run(block: int, data: bytes, _marks: bytes, _: Answers) -> pa.Table:
        g = Grams(unpacked_rows(data))
        return asked(block, g.keys, g.n[None], buckets)

    return run


def _ask_trigrams(buckets: int):
    def run(block: int, data: bytes, _marks: bytes, answers: Answers) -> pa.Table:
        g = Grams(unpacked_rows(data))
        g.trigrams(answers.step(0))
        return asked(block, g.keys3, g.n3[None], buckets)

    return run


def _counts(_: int, keys: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """The sums over all blocks; facts: training tokens, and different ones."""
    found, place = distinct(keys)
    n = np.bincount(place, numbers[0], len(found)).astype(np.int64)
    known = n[found & np.uint64(3) == np.uint64(1)]
    return n[place], [int(known.sum()), int((known > 0).sum())]


@dataclass
class Automaton:
    """States 0 (no context), 1..U (a word), U+1.. (two words); arcs sorted by state << 32 | word."""

    unigram: np.ndarray
    fail: np.ndarray
    fail_weight: np.ndarray
    arcs: np.ndarray
    arc_weight: np.ndarray
    arc_to: np.ndarray


def assemble(p1: np.ndarray, n1: np.ndarray, first: np.ndarray, second: np.ndarray, n2: np.ndarray, head: np.ndarray, third: np.ndarray, n3: np.ndarray, tail: np.ndarray) -> Automaton:
    """States and arcs.

    ``p1``, ``n1``: probability and count by word (0: none).  ``first``, ``second``, ``n2``: words and counts of the bigrams.
    ``head``, ``third``, ``n3``, ``tail``: the trigrams' first bigram, last word, count and last bigram.
    """
    u = len(p1) - 1
    p2 = (n2 + K1 * p1[second]) / (n1[first] + K1)
    p3 = (n3 + K2 * p2[tail]) / (n2[head] + K2)
    arcs = np.concatenate([(first << 32) | second, ((u + 1 + head) << 32) | third])
    weight = np.log10(np.concatenate([p2, p3]))
    to = np.concatenate([u + 1 + np.arange(len(first)), u + 1 + tail])
    order = np.argsort(arcs)
    fail = np.concatenate([np.zeros(u + 1, np.int64), second])
    fail_weight = np.log10(np.concatenate([[1.0], K1 / (n1[1:] + K1), K2 / (n2 + K2)]))
    return Automaton(np.log10(np.maximum(p1, 1e-300)), fail, fail_weight, arcs[order], weight[order], to[order])


def of_block(g: Grams, n: np.ndarray, n3: np.ndarray, below: int) -> tuple[Automaton, np.ndarray]:
    """The states and arcs that a block's texts can reach, and the tokens' word numbers; ``n``, ``n3``: the counts of its keys."""
    one, two, three = np.flatnonzero(g.order == 1), np.flatnonzero((g.order == 2) & (n > 0)), np.flatnonzero(n3 > 0)
    number = np.zeros(len(g.keys), np.int64)
    number[one] = 1 + np.arange(len(one))
    number[two] = np.arange(len(two))
    p1 = np.append(0, (n[one] + 1) / below)
    last = number[g.second[g.tail[three]]]
    a = assemble(p1, np.append(0, n[one]), number[g.first[two]], number[g.second[two]], n[two], number[g.head[three]], last, n3[three], number[g.tail[three]])
    return a, number[g.one]


def walk(a: Automaton, ids: np.ndarray, root: np.ndarray, at: np.ndarray) -> np.ndarray:
    """log10 probability of each document (tokens ``ids`` cut at ``at``; ``root``: the tokens' weight without context)."""
    sizes = np.diff(at)
    lanes_of = np.maximum(1, -(-sizes // LANE))
    doc = np.repeat(np.arange(len(sizes)), lanes_of)
    piece = np.arange(len(doc)) - np.repeat(np.append(0, lanes_of.cumsum()[:-1]), lanes_of)
    begin = at[:-1][doc] + piece * LANE
    end = np.minimum(begin + LANE, at[1:][doc])
    order = np.argsort(begin - end, kind="stable")  # longest lanes first
    doc, piece, begin, end = doc[order], piece[order], begin[order], end[order]
    state, total = np.zeros(len(doc), np.int64), np.zeros(len(doc))
    for back in (2, 1):
        go = piece > 0
        if go.any():
            state[go], _ = _step(a, state[go], ids[begin[go] - back], root[begin[go] - back])
    length = end - begin
    for k in range(int(length.max(initial=0))):
        n = int(np.searchsorted(-length, -k, "left"))
        pos = begin[:n] + k
        state[:n], gained = _step(a, state[:n], ids[pos], root[pos])
        total[:n] += gained
    return np.bincount(doc, total, len(sizes))


def _step(a: Automaton, state: np.ndarray, word: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Next states and weights gained; a state without a fitting arc fails to the shorter context."""
    gained, out = np.zeros(len(state)), word.copy()
    open_ = np.arange(len(state))
    state = state.copy()
    while len(open_):
        s = state[open_]
        at_root = s == 0
        gained[open_[at_root]] += root[open_[at_root]]
        open_ = open_[~at_root]
        if not len(open_):
            break
        s, w = state[open_], word[open_]
        key = (s << 32) | w
        at = np.minimum(np.searchsorted(a.arcs, key), max(len(a.arcs) - 1, 0))
        hit = (a.arcs[at] == key) & (w > 0) if len(a.arcs) else np.zeros(len(s), bool)
        taken = open_[hit]
        gained[taken] += a.arc_weight[at[hit]]
        out[taken] = a.arc_to[at[hit]]
        open_, s = open_[~hit], s[~hit]
        gained[open_] += a.fail_weight[s]
        state[open_] = a.fail[s]
    return out, gained


def _score(below: int):
    names = [c.split()[0] for c in SCORES.split(", ")]
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def run(_: int, data: bytes, _marks: bytes, answers: Answers) -> pa.Table:
        rows = unpacked_rows(data)
        g, n = Grams(rows), answers.step(0)
        g.trigrams(n)
        a, ids = of_block(g, n, answers.step(1), below)
        root, seen = a.unigram[ids], (n[g.one] > 0).astype(np.int64)
        total = lambda x: np.add.reduceat(x, g.at[:-1])
        columns = [rows.column("doc_id"), rows.column("held_out"), np.diff(g.at), total(seen), total(root), walk(a, ids, root, g.at)]
        return pa.table(columns, names=names).cast(pa.schema(list(zip(names, kinds, strict=True))))

    return run


def scores(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row."""
    t = Tables(docs.sparkSession, "lm")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    blocks = blocks_of(t, rows, BLOCK_BYTES)
    e = Exchange(t, blocks, BUCKET_BYTES)
    facts = e.ask(_ask_words(e.buckets), _counts)
    total, different = facts or [0, 0]
    e.ask(_ask_trigrams(e.buckets), _counts)
    return e.map(_score(total + different + 1), SCORES).withColumn("train_tokens", F.lit(total).cast("long"))
