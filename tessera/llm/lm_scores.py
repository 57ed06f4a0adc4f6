"""Language-model scores from a weighted backoff automaton.

Training counts tokens over all training documents (each document's words,
lower-cased A-Z, then one end, which also stands before the first word). The
model has three orders, whatever the corpus holds:

* order 1 covers every token: P(w) = (c+1) / (N+V+1); unseen words share the +1;
* orders 2 and 3 keep every n-gram that occurs twice or more.

A kept n-gram has the probability (c - D) / c(context) plus the context's share
times the next shorter context's probability; the context's share is the mass that
its kept n-grams leave over. (Absolute discounting, interpolated; probabilities of
all words, the unseen one among them, add up to 1 after each context.)

As an automaton: a state stands for a context, with arcs for its kept n-grams and one
failure arc, weighted with the log of its share, to the context less its first word.
An arc leads to the longest kept context that ends in its word. Texts are read from
left to right, once: a token is looked for among the arcs of the state that the tokens
before it led to; where there is none, failure arcs are followed to shorter contexts and
their weights added; the arc's weight is added and its state carried on. All texts of
a block are read abreast, long ones in stretches that start in the state their place has.

The automaton grows with the corpus, so no task holds it. Blocks of documents ask
for the counts of their distinct pairs; then for the counts of those triples whose pairs
are both kept; then for the shares of their kept pairs, and for the counts and shares of
their words. Each block thus gets the part of the automaton that its texts run through,
and its states, arcs and failure arcs are arrays.
Of the blocks that have a kept n-gram one is told to add it to its context's share.
Keys are 64-bit hashes.

Defined results: null or empty text is the end token alone; repeated rows are
scored each; a null doc_id's crc32 counts as 0; an empty table gives no rows;
with no training document N is 0 and every token is unseen.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import QUESTIONS, answered, dealt, for_blocks, forget, gathered, in_blocks, opened, parts_of, questions, squeezed
from .common import cut, drop, keep_docs
from .jaccard_join import mix

#: The end token: no word has a space in it.
END = b" "
#: Occurrences from which on a pair or triple is kept, and what is taken off its count.
LEAST, DISCOUNT = 2, 0.75
#: Tokens of a text that are read in one stretch.
STRETCH = 1024
#: Its blocks are this part of others: what a worker holds of one besides its texts is some 25 bytes for each character.
PART_OF_BLOCK = 0.6
#: Kinds of questions: pairs, words as contexts, triples, pairs as contexts.
PAIRS, WORDS, TRIPLES, CONTEXTS = 1, 2, 3, 4


def tokens(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased, then the end."""
    out = text.encode().lower().split()
    out.append(END)
    return out


def held_out(doc_id: Column, parts: int = 7, part: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % parts == part


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The key of the n-gram of context a and last word b."""
    return mix(mix(a * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)) + b)


def packed(rows: list[tuple]) -> tuple:
    """data of a block's rows (doc_id, text, out), its tokens and training tokens."""
    import xxhash

    own: dict[bytes, int] = defaultdict(count().__next__)  # one text's words at a time are held, its numbers in four bytes each
    numbers = [np.fromiter(map(own.__getitem__, tokens(text)), np.uint32) for _, text, _ in rows]
    lens = np.array([len(w) for w in numbers])
    keys = np.fromiter(map(xxhash.xxh3_64_intdigest, own), np.uint64, len(own))
    vocabulary, place = np.unique(keys, return_inverse=True)
    ids = place.astype(np.uint32)[np.concatenate(numbers)]
    train = np.array([not out for *_, out in rows])
    doc = np.array([d or 0 for d, *_ in rows], np.int64)
    end = place[own[END]]
    data = squeezed(vocabulary, ids, lens, train.astype(np.uint8), doc, np.array([d is not None for d, *_ in rows]).astype(np.uint8), np.array([end]))
    return data, int(lens.sum()), int(lens[train].sum())


class Block:
    """A block's tokens with the pairs that end in them: `pair` has each token's, pv and pw the words of the distinct ones."""

    def __init__(self, data: bytes):
        self.vocabulary, ids, self.lens, train, self.doc, self.named, (end,) = opened(data)
        self.ids = ids.astype(np.int32)  # numbers of words, pairs and triples of a block take four bytes
        self.begin = np.concatenate([[0], np.cumsum(self.lens)[:-1]])
        before = np.concatenate([np.array([end], np.int32), self.ids[:-1]])
        before[self.begin] = end
        self.trained = np.repeat(train, self.lens)
        self.inner = np.ones(len(self.ids), bool)
        self.inner[self.begin] = False
        self.distinct, pair = np.unique(before * np.int64(len(self.vocabulary)) + self.ids, return_inverse=True)
        self.pair = pair.astype(np.int32)
        self.pv, self.pw = np.divmod(self.distinct, len(self.vocabulary))
        self.end = end
        self.pair_key = joined(self.vocabulary[self.pv], self.vocabulary[self.pw])
        self.order = np.argsort(self.pair_key)

    def in_place(self, values: np.ndarray, order: np.ndarray) -> np.ndarray:
        out = np.empty_like(values)
        out[order] = values
        return out

    def pairs(self, got: dict) -> None:
        """Take the answers about pairs: c2 (0: not kept), and whether to add them to their contexts."""
        c = self.in_place(gathered(got[PAIRS])[0], self.order)
        self.c2, self.mine2 = np.abs(c), c < 0
        self.kept2 = self.c2 > 0
        at = np.flatnonzero(self.inner)
        self.at3 = at[self.kept2[self.pair[at - 1]] & self.kept2[self.pair[at]]]
        code, triple = np.unique(self.pair[self.at3 - 1] * np.int64(len(self.vocabulary)) + self.ids[self.at3], return_inverse=True)
        self.triple = triple.astype(np.int32)
        self.context3, last = np.divmod(code, len(self.vocabulary))
        self.triple_pair = np.searchsorted(self.distinct, self.pw[self.context3] * len(self.vocabulary) + last)
        self.triple_key = joined(self.pair_key[self.context3], self.vocabulary[last])
        self.order3 = np.argsort(self.triple_key)
        # kept pairs that can be contexts, in order of their keys
        self.states = self.order[self.kept2[self.order] & (self.pw[self.order] != self.end)]

    def triples(self, got: dict) -> None:
        c = self.in_place(gathered(got[TRIPLES])[0], self.order3) if len(self.order3) else np.empty(0, np.int64)
        self.c3, self.mine3 = np.abs(c), c < 0


class Automaton:
    """The part of the model that a block's texts run through.

    State 0 is the empty context, 1 + w that of word w, then come those of the kept pairs. arcs: state * words + word of
    each arc but those of state 0, in order, with weight and next state; fails and back: where failure arcs lead, and their weights.
    """

    def __init__(self, x: Block, p1: np.ndarray, some: np.ndarray, share2: np.ndarray, share3: np.ndarray):
        m, own = len(x.vocabulary), len(x.states)
        self.words, self.base = m, np.log10(p1)
        self.after = x.pw + 1  # the state that a pair leads to
        self.after[x.states] = m + 1 + np.arange(own)
        self.back = np.log10(np.concatenate([[1.0], share2, share3]))
        self.fails = np.concatenate([np.zeros(m + 1, np.int64), x.pw[x.states] + 1])
        pair = np.flatnonzero(x.kept2)
        p2 = np.where(x.kept2, (x.c2 - DISCOUNT) / some[x.pv], 0) + share2[x.pv] * p1[x.pw]
        triple = np.flatnonzero(x.c3 > 0)
        state = self.after[x.context3[triple]]
        last = x.triple_pair[triple]  # the pair that a triple ends with
        p3 = (x.c3[triple] - DISCOUNT) / x.c2[x.context3[triple]] + share3[state - m - 1] * p2[last]
        arcs = np.concatenate([(x.pv[pair] + 1) * m + x.pw[pair], state * m + x.pw[last]])
        order = np.argsort(arcs)
        self.arcs = arcs[order]
        self.weights = np.log10(np.concatenate([p2[pair], p3])[order])
        self.to = np.concatenate([self.after[pair], self.after[last]])[order]

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states that tokens lead to from states, and the weights on the way."""
        weight, to = self.base[word], word.astype(np.int64) + 1
        fell, at, now = np.zeros(len(word)), np.arange(len(word)), state
        while len(at):
            code = now * np.int64(self.words) + word[at]
            k = np.minimum(np.searchsorted(self.arcs, code), max(0, len(self.arcs) - 1))
            hit = self.arcs[k] == code if len(self.arcs) else np.zeros(len(at), bool)
            weight[at[hit]], to[at[hit]] = self.weights[k[hit]], self.to[k[hit]]
            at, now = at[~hit], now[~hit]
            fell[at] += self.back[now]
            now = self.fails[now]
            at, now = at[now > 0], now[now > 0]
        return weight + fell, to

    def read(self, x: Block) -> np.ndarray:
        """The sums of weights over each text of the block."""
        cuts = -(-x.lens // STRETCH)
        of = np.repeat(np.arange(len(x.lens)), cuts)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        begin = x.begin[of] + nth * STRETCH
        size = np.minimum(x.lens[of] - nth * STRETCH, STRETCH)
        order = np.argsort(-size, kind="stable")
        begin, size, of = begin[order], size[order], of[order]
        first = begin == x.begin[of]
        state = np.where(first, x.end + 1, self.after[x.pair[begin - 1]])
        sums = np.zeros(len(of))
        for t in range(int(size[0]) if len(size) else 0):
            n = int(np.searchsorted(-size, -t))  # stretches of more than t tokens
            weight, state = self.step(state[:n], x.ids[begin[:n] + t])
            sums[:n] += weight
        return np.bincount(of, sums, len(x.lens))


def counted(data: list[bytes]) -> tuple[list[bytes], int]:
    """For each asker's keys their count over all askers, 0 below LEAST, negative for the first asker of a key."""
    asked = [opened(d) for d in data]
    keys, c = (np.concatenate(x) for x in zip(*asked, strict=True))
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.r_[True, ordered[1:] != ordered[:-1]]
    total = np.add.reduceat(c[order].astype(np.int64), np.flatnonzero(new))
    total[total < LEAST] = 0
    each = total[np.cumsum(new) - 1]
    each[new] *= -1
    out = np.empty_like(each)
    out[order] = each
    ends = np.cumsum([len(k) for k, _ in asked])
    return [squeezed(x) for x in np.split(out, ends[:-1])], 0


def summed(data: list[bytes]) -> tuple[list[bytes], int]:
    """For each asker's keys the sums of their values over all askers; the number of keys whose first sum isn't 0."""
    asked = [opened(d) for d in data]
    keys, *values = (np.concatenate(x) for x in zip(*asked, strict=True))
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.r_[True, ordered[1:] != ordered[:-1]]
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(new) - 1
    totals = [np.add.reduceat(v[order].astype(np.int64), np.flatnonzero(new)) for v in values]
    ends = np.cumsum([len(a[0]) for a in asked])
    return [squeezed(*(t[p] for t in totals)) for p in np.split(place, ends[:-1])], int((totals[0] > 0).sum())


def whole(weights: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    return np.bincount(at, weights, size).astype(np.int64)


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every text."""
    rows = keep_docs(docs).withColumn("out", held_out(F.col("doc_id")))

    blocks = in_blocks(rows, packed, "data binary, n long, trained long", ["data", "n", "trained"], PART_OF_BLOCK)
    size, total, count = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("trained"), F.lit(0)), F.count("*")).first()
    parts = parts_of(size, count)

    def ask_pairs(b: int, got: dict, data: bytes):
        x = Block(data)
        c = whole(x.trained, x.pair, len(x.distinct))
        yield questions(b, PAIRS, dealt(x.pair_key[x.order], parts, c[x.order]))

    def ask_words(b: int, got: dict, data: bytes):
        x = Block(data)
        x.pairs(got)
        m = len(x.vocabulary)
        own = np.flatnonzero(x.mine2)
        yield questions(b, WORDS, dealt(x.vocabulary, parts, whole(x.trained, x.ids, m), whole(x.c2[own], x.pv[own], m), np.bincount(x.pv[own], minlength=m)))

    def ask_triples(b: int, got: dict, data: bytes):
        x = Block(data)
        x.pairs(got)
        c = whole(x.trained[x.at3], x.triple, len(x.triple_key))
        yield questions(b, TRIPLES, dealt(x.triple_key[x.order3], parts, c[x.order3]))

    def ask_contexts(b: int, got: dict, data: bytes):
        x = Block(data)
        x.pairs(got)
        x.triples(got)
        own, n = np.flatnonzero(x.mine3), len(x.distinct)
        yield questions(b, CONTEXTS, dealt(x.pair_key[x.states], parts, whole(x.c3[own], x.context3[own], n)[x.states], np.bincount(x.context3[own], minlength=n)[x.states]))

    pairs = answered(for_blocks(blocks, "data", [], ask_pairs, QUESTIONS), parts, {PAIRS: counted})
    triples = answered(for_blocks(blocks, "data", [pairs], ask_triples, QUESTIONS), parts, {TRIPLES: counted})
    contexts = answered(for_blocks(blocks, "data", [pairs, triples], ask_contexts, QUESTIONS), parts, {CONTEXTS: summed})
    words = answered(for_blocks(blocks, "data", [pairs], ask_words, QUESTIONS), parts, {WORDS: summed})
    distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def read(b: int, got: dict, data: bytes):
        x = Block(data)
        x.pairs(got)
        x.triples(got)
        c, s, k = gathered(got[WORDS])
        p1 = (c + 1) / (total + distinct + 1)
        base, some = np.log10(p1), np.maximum(c, 1)
        share2, share3 = 1 - (s - DISCOUNT * k) / some, np.empty(0)
        if len(x.states):
            s, k = gathered(got[CONTEXTS])
            share3 = 1 - (s - DISCOUNT * k) / x.c2[x.states]
        out = Automaton(x, p1, some, share2, share3).read(x)
        add = lambda v: np.add.reduceat(v, x.begin)
        yield pa.RecordBatch.from_arrays(
            [pa.array(x.doc, pa.int64(), mask=x.named == 0), pa.array(x.trained[x.begin] == 0), pa.array(x.lens), pa.array(add((c > 0)[x.ids].astype(np.int64))), pa.array(add(base[x.ids])), pa.array(out)],
            names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
        )

    done = cut(for_blocks(blocks, "data", [pairs, triples, words, contexts], read, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"))
    drop(pairs, triples, contexts, words)
    forget(blocks)
    return done.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
