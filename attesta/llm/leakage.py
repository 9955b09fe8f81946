"""Evaluation texts inside training text, found through a stored, distributed positional inverted index.

The index is partitioned by document: each block of documents holds its terms and the sorted positions of each term
(the postings), where its documents begin, and its tokens in order. It is written once and searched as often as
there are items. A search takes the evaluation items, a bounded number at a time, to every block. For every phrase of three
successive terms of an item the list of its rarest term, adjusted by the term's offset, is intersected with the lists
of the other two, which gives exact phrase matches without reading the text. In each stretch of an item the rarest phrases
that the block holds vote for places; matches of one item that lie near each other in text and item (proximity) mark a place,
and only at marked places are tokens read and compared word by word.

Whatever reproduces enough words there is told from habitual wording by the whole corpus: every block also counts
the documents that hold each phrase of the items, and a phrase weighs the less the more documents hold it that don't
reproduce the item. These counts are summed before any pair is settled.

Texts are split into words; letter case and accents don't count.
"""

from __future__ import annotations

import difflib
import re
import unicodedata
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.session import materialize, shared_dir

#: Words of an item that a text must reproduce.
LEAST_WORDS = 30
#: Items searched for at once; more are searched for in turns over a stored index.
ITEMS_AT_ONCE = 5_000
#: Successive terms intersected for one lookup, and how many lookups in each stretch of an item are made.
PHRASE, STRETCH, RAREST = 3, 6, 3
#: Lookups that must hit, and how far apart, in words, hits of one passage may lie.
LEAST_HITS, LEAST_CHAIN, NEAR, DRIFT = 8, 2, 16, 8
#: Words that must be equal, less those that aren't, along the diagonals of one chain, or of two, before words are compared for imperfect copying.
LEAST_ESTIMATE, LEAST_OF_TWO, UNEQUAL = 9, 16, 2
#: Words of the item that must stand beside a neighbour on some diagonal before words are compared.
LEAST_IN_RUNS = 18
#: Words that differ between the reproduced stretches of one passage, and the fewest words of a passage.
GAP, LEAST_PASSAGE = 3, 8
#: Share of the documents, and documents beside it, from which on a phrase is habit and weighs nothing.
HABIT_SHARE, HABIT_LEAST = 0.03, 10
#: Least evidence of a copy, and for each word of either of two passages, and the words looked at around a place.
LEAST_EVIDENCE, LEAST_EACH, AROUND = 3.0, 0.08, 45
#: Tokens of a block, and the distance between documents in it.
BLOCK, BETWEEN = 1 << 20, 64

INDEX_SCHEMA = "docs binary, starts binary, lengths binary, terms binary, counts binary, gaps binary, tokens binary"
_INDEX = pa.schema([(n.split()[0], pa.binary()) for n in INDEX_SCHEMA.split(", ")])
_WORD = re.compile(r"\w+")


def _plain(term: str) -> str:
    """Without accents; ligatures are written out."""
    if term.isascii():
        return term
    term = "".join(c for c in unicodedata.normalize("NFKD", term) if not unicodedata.combining(c))
    return term.replace("ß", "ss").replace("œ", "oe").replace("æ", "ae").replace("ø", "o")


def words_of(text: str | None) -> list[str]:
    return [_plain(w) for w in _WORD.findall(text.lower())] if text else []


# -- the index


def _index_block(docs: list[int], tokens: list[list[str]]) -> pa.RecordBatch:
    lengths = np.array([len(t) for t in tokens], np.int32)
    starts = np.concatenate([[0], np.cumsum(lengths + BETWEEN)[:-1]]).astype(np.int32)
    flat = [w for t in tokens for w in t]
    codes, raw = pd.factorize(np.array(flat, dtype=object)) if flat else (np.zeros(0, np.int64), np.array([], object))
    plain, terms = pd.factorize(np.array([_plain(t) for t in raw], dtype=object)) if len(raw) else (np.zeros(0, np.int64), np.array([], object))
    ids = plain[codes] if len(flat) else codes
    where = np.arange(len(flat)) + np.repeat(np.arange(len(lengths)) * BETWEEN, lengths)
    order = np.argsort(ids, kind="stable")
    counts = np.bincount(ids, minlength=len(terms)).astype(np.int32)
    gaps = np.diff(where[order], prepend=0).astype(np.int32)  # small numbers are stored small
    parts = [np.array(docs, np.int64).tobytes(), starts.tobytes(), lengths.tobytes(), "\n".join(terms).encode("utf-8", "replace"), counts.tobytes(), gaps.tobytes(), ids.astype(np.int32).tobytes()]
    return pa.RecordBatch.from_arrays([pa.array([p], pa.binary()) for p in parts], schema=_INDEX)


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs: list[int] = []
    tokens: list[list[str]] = []
    size = 0
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = _WORD.findall(text.lower())
            docs.append(doc)
            tokens.append(found)
            size += len(found) + BETWEEN
            if size >= BLOCK:
                yield _index_block(docs, tokens)
                docs, tokens, size = [], [], 0
    if docs:
        yield _index_block(docs, tokens)


def build_index(documents: DataFrame) -> DataFrame:
    """The positional index, one row per block of documents. Null texts and ids aren't in it; nothing is shuffled."""
    rows = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(_build, INDEX_SCHEMA)


@dataclass
class Block:
    """An index block in memory."""

    docs: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    terms: list[str]
    firsts: np.ndarray
    postings: np.ndarray  # positions, by term and then in order
    tokens: np.ndarray  # terms in order, document by document without what lies between
    shifts: np.ndarray  # position less place in ``tokens``, by document

    @classmethod
    def of(cls, row: dict) -> Block:
        read = lambda n, t=np.int32: np.frombuffer(row[n], t)
        terms = row["terms"].decode()
        shifts = np.arange(len(read("starts"))) * BETWEEN
        return cls(read("docs", np.int64), read("starts"), read("lengths"), terms.split("\n") if terms else [], np.concatenate([[0], np.cumsum(read("counts"))]), np.cumsum(read("gaps"), dtype=np.int64), read("tokens"), shifts)

    def text(self, document: int, low: int, high: int) -> list[str]:
        """The terms at positions of one document."""
        return [self.terms[t] for t in self.at(document, low, high)]

    def at(self, document: int, low: int, high: int) -> np.ndarray:
        start, end = int(self.starts[document]), int(self.starts[document] + self.lengths[document])
        shift = int(self.shifts[document])
        return self.tokens[max(low, start) - shift : max(min(high, end), start) - shift]

    def matches(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of a phrase, its position) of every exact match of phrases (n, PHRASE) of terms, -1 for a term that isn't here.

        The rarest term's list, adjusted by its offset, is intersected with the others', the rarer first.
        """
        count = np.diff(self.firsts)
        frequency = np.where(phrases >= 0, count[phrases], 0)
        present = np.flatnonzero((frequency > 0).all(1))
        order = np.argsort(frequency[present], axis=1, kind="stable")
        which, positions = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k, offsets in zip(present.tolist(), order.tolist()):
            at = None
            for offset in offsets:
                term = phrases[k, offset]
                listed = self.postings[self.firsts[term] : self.firsts[term + 1]]
                if at is None:
                    at = listed - offset
                else:
                    wanted = at + offset
                    slot = listed.searchsorted(wanted)
                    slot[slot == len(listed)] = 0
                    at = at[listed[slot] == wanted]
                    if not len(at):
                        break
            if len(at):
                which.append(np.full(len(at), k))
                positions.append(at)
        return np.concatenate(which), np.concatenate(positions)


# -- the search


@dataclass
class Items:
    """Evaluation items, and their phrases by key over the items' own vocabulary."""

    ids: np.ndarray
    tokens: list[list[str]]
    vocabulary: dict[str, int]
    phrases: np.ndarray  # (n, PHRASE) terms of the vocabulary, distinct
    phrase_of: np.ndarray  # index into phrases of each occurrence
    item: np.ndarray
    offset: np.ndarray
    codes: list[np.ndarray]

    @classmethod
    def of(cls, rows: Sequence[tuple[int, str]]) -> Items:
        tokens = [words_of(text) for _, text in rows]
        vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for t in tokens for w in t))}
        found, item, offset = [np.zeros((0, PHRASE), np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        codes = [np.array([vocabulary[w] for w in t], np.int64) for t in tokens]
        for i, c in enumerate(codes):
            if len(c) >= PHRASE:
                found.append(np.lib.stride_tricks.sliding_window_view(c, PHRASE))
                item.append(np.full(len(c) - PHRASE + 1, i))
                offset.append(np.arange(len(c) - PHRASE + 1))
        distinct, phrase_of = np.unique(np.concatenate(found), axis=0, return_inverse=True)
        return cls(np.array([i for i, _ in rows], np.int64), tokens, vocabulary, distinct, phrase_of.ravel(), np.concatenate(item), np.concatenate(offset), codes)


def candidates(block: Block, items: Items, holders: np.ndarray) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """(document, item, marked places) of every pair with enough hits near each other.

    The number of the block's documents that hold each phrase of the items is added to ``holders``.
    """
    if not len(block.postings) or not len(items.phrases):
        return []
    term_of = {t: i for i, t in enumerate(block.terms)}
    ours = np.array([term_of.get(w, -1) for w in items.vocabulary], np.int64)
    slot, at = block.matches(ours[items.phrases])
    order = np.lexsort((at, slot))
    slot, at = slot[order], at[order]
    inside = np.searchsorted(block.starts, at, "right")
    fresh = np.ones(len(at), bool)  # positions of a phrase are in order, so a document's stand together
    fresh[1:] = (slot[1:] != slot[:-1]) | (inside[1:] != inside[:-1])
    holders += np.bincount(slot[fresh], minlength=len(holders))
    counts = np.bincount(slot, minlength=len(items.phrases))
    firsts = np.concatenate([[0], np.cumsum(counts)])

    # In each stretch of an item only the rarest phrases are looked up, so that common wording costs little.
    frequency = counts[items.phrase_of]
    stretch = items.item * 100_000_000 + items.offset // STRETCH
    present = np.flatnonzero(frequency)  # those that the block doesn't hold take no place
    rank = present[np.lexsort((frequency[present], stretch[present]))]
    place = np.arange(len(rank)) - np.searchsorted(stretch[rank], stretch[rank])
    chosen = rank[place < RAREST]

    # Positions of the chosen phrases, with the diagonal (position less offset) they vote for.
    n = frequency[chosen]
    ends = np.cumsum(n)
    which = np.repeat(np.arange(len(chosen)), n)
    position = at[firsts[items.phrase_of[chosen]][which] + np.arange(len(which)) - (ends - n)[which]]
    item, offset = items.item[chosen][which], items.offset[chosen][which]
    document = np.searchsorted(block.starts, position, "right") - 1
    pair = item * (len(block.docs) + 1) + document
    if not len(pair):
        return []

    # A pair needs enough hits in all before anything is looked at more closely.
    _, back, total = np.unique(pair, return_inverse=True, return_counts=True)
    keep = total[back] >= LEAST_HITS
    pair, position, offset = pair[keep], position[keep], offset[keep]
    diagonal = position - offset
    marked: dict[int, list[tuple[int, int]]] = {}
    for shift in (0, DRIFT):  # both ways of cutting the diagonals into bands, so that no passage is cut by each
        band = (diagonal + shift) // (2 * DRIFT)
        order = np.lexsort((position, band, pair))
        p, b, x, o = pair[order], band[order], position[order], offset[order]
        if not len(p):
            break
        broken = (p[1:] != p[:-1]) | (b[1:] != b[:-1]) | (x[1:] - x[:-1] > NEAR)
        first = np.concatenate([[0], np.flatnonzero(broken) + 1])
        chain = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(p))))
        again = np.lexsort((o, chain))
        fresh = np.ones(len(p), bool)
        fresh[1:] = (chain[again][1:] != chain[again][:-1]) | (o[again][1:] != o[again][:-1])
        hits = np.bincount(chain[again], weights=fresh, minlength=len(first)).astype(int)
        low, high = x[first], x[np.append(first[1:], len(p)) - 1]
        least, most = np.minimum.reduceat(x - o, first), np.maximum.reduceat(x - o, first)
        some = np.flatnonzero(hits >= LEAST_CHAIN)
        best: dict[int, list[int]] = {}
        for c in some:
            best.setdefault(int(p[first[c]]), []).append(int(c))
        for key, chains in best.items():
            top = sorted((hits[c] for c in chains), reverse=True)[:2]
            if sum(top) < LEAST_HITS:
                continue
            codes, document = ours[items.codes[key // (len(block.docs) + 1)]], key % (len(block.docs) + 1)
            equals = [_equal(codes, block, document, int(least[c]), int(most[c])) for c in chains]
            estimates = sorted((_estimate(e) for e in equals), reverse=True)
            if (estimates[0] >= LEAST_ESTIMATE or sum(estimates[:2]) >= LEAST_OF_TWO) and _in_runs(equals) >= LEAST_IN_RUNS:
                marked.setdefault(key, []).extend((int(low[c]), int(high[c])) for c in chains)
    return [(key % (len(block.docs) + 1), key // (len(block.docs) + 1), places) for key, places in marked.items()]


def _equal(codes: np.ndarray, block: Block, document: int, least: int, most: int) -> np.ndarray:
    """(diagonals, words of the item) Which words stand in the document along the diagonals of a chain."""
    start, shift = int(block.starts[document]), int(block.shifts[document])
    position = np.arange(least - 2, most + 3)[:, None] + np.arange(len(codes))
    inside = (position >= start) & (position < start + int(block.lengths[document]))
    return inside & (block.tokens[np.where(inside, position - shift, 0)] == codes)


def _estimate(equal: np.ndarray) -> int:
    """The best stretch of the item: words that are equal there less those that aren't."""
    total = np.concatenate([[0], np.cumsum(np.where(equal.any(0), 1, -UNEQUAL))])
    return int((total - np.minimum.accumulate(total)).max())


def _in_runs(equals: list[np.ndarray]) -> int:
    """Words of the item that are equal together with a neighbour on some diagonal."""
    out = np.zeros(equals[0].shape[1], bool)
    for equal in equals:
        both = (equal[:, 1:] & equal[:, :-1]).any(0)
        out[1:] |= both
        out[:-1] |= both
    return int(out.sum())


def _regions(places: list[tuple[int, int]], low: int, high: int, around: int) -> list[tuple[int, int]]:
    """Stretches of a document about the marked places, merged where they meet."""
    out: list[list[int]] = []
    for a, b in sorted(places):
        a, b = max(low, a - around), min(high, b + around)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _reproduced(item: list[str], text: list[str]) -> list[int]:
    """Which words of a short stretch of the item the text gives, if imperfectly: split, joined or misspelled."""
    if not item or not text:
        return []
    a, b = "".join(item), "".join(text)
    if a == b or len(b) <= 2 * len(a) + 2 and difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() >= 0.75:
        return list(range(len(item)))
    left = list(text)
    given = []
    for i, w in enumerate(item):
        at = next((k for k, x in enumerate(left) if len(w) > 3 and difflib.SequenceMatcher(None, w, x, autojunk=False).ratio() >= 0.75), None)
        if at is not None:
            given.append(i)
            left = left[at + 1 :]
    return given


def _most_words(blocks: list[difflib.Match]) -> int:
    """What two passages would reproduce at most, if whatever may be an imperfect copy were one."""
    out: list[int] = []
    for k, b in enumerate(blocks):
        gap, other = (b.a - blocks[k - 1].a - blocks[k - 1].size, b.b - blocks[k - 1].b - blocks[k - 1].size) if k else (99, 99)
        lone = min(gap, other) == 0
        if gap <= (GAP if lone else max(8, GAP)) and other <= (2 * GAP if lone else 12 + 2 * GAP):
            out[-1] += b.size + gap
        else:
            out.append(b.size)
    return sum(sorted(out, reverse=True)[:2])


def passages(item: list[str], text: list[str]) -> tuple[list[tuple[int, int, int]], np.ndarray]:
    """(start in item, end in item, words reproduced) of each passage that runs on, apart from imperfect copying; and which words of the item are reproduced.

    Passages come in the item's and the text's order and don't overlap; shorter ones than LEAST_PASSAGE are left out.
    """
    blocks = [b for b in difflib.SequenceMatcher(None, item, text, autojunk=False).get_matching_blocks() if b.size]
    given = np.zeros(len(item), bool)
    if _most_words(blocks) < LEAST_WORDS:
        return [], given
    out: list[list[int]] = []
    last = None
    for b in blocks:
        given[b.a : b.a + b.size] = True
        if last is not None:
            start = last.a + last.size
            gap_item, gap_text = item[start : b.a], text[last.b + last.size : b.b]
            again = _reproduced(gap_item, gap_text) if gap_item and len(gap_item) <= 8 and len(gap_text) <= 12 else []
            if len(gap_item) - len(again) <= GAP and len(gap_text) - len(again) <= 2 * GAP:
                given[[start + k for k in again]] = True
                out[-1][1] = b.a + b.size
                out[-1][2] += len(again) + b.size
                last = b
                continue
        out.append([b.a, b.a + b.size, b.size])
        last = b
    return [tuple(p) for p in out if p[2] >= LEAST_PASSAGE], given


def evidence(found: list[tuple[int, int, int]], given: np.ndarray, weights: np.ndarray) -> list[float]:
    """What speaks for each passage being a copy: the weights of the item's phrases it gives less those of the words it loses.

    Habitual wording agrees in formulas, which weigh little, and differs in what is filled into them; in a copy,
    however imperfect, what is rare agrees too. ``weights`` has one for each phrase of the item; a word weighs what the
    least telling phrase about it does.
    """
    whole = np.lib.stride_tricks.sliding_window_view(given, PHRASE).all(1)
    padded = np.pad(weights, PHRASE - 1, constant_values=np.inf)
    word = np.lib.stride_tricks.sliding_window_view(padded, PHRASE).min(1)
    return [float(weights[a : b - PHRASE + 1][whole[a : b - PHRASE + 1]].sum() - word[a:b][~given[a:b]].sum()) for a, b, _ in found]


def enough_words(found: list[tuple[int, int, int]]) -> bool:
    """Whether one or two passages reproduce LEAST_WORDS."""
    return sum(sorted((p[2] for p in found), reverse=True)[:2]) >= LEAST_WORDS


def reproduces(found: list[tuple[int, int, int]], values: list[float]) -> bool:
    """Whether one or two passages reproduce LEAST_WORDS and aren't habit; each of two must tell enough for its length."""
    rows = [(p[2], v) for p, v in zip(found, values)]
    if any(w >= LEAST_WORDS and v >= LEAST_EVIDENCE for w, v in rows):
        return True
    telling = [(w, v) for w, v in rows if v >= LEAST_EACH * w]
    return any(w + x >= LEAST_WORDS and v + y >= LEAST_EVIDENCE for k, (w, v) in enumerate(telling) for x, y in telling[k + 1 :])


def weight(holders: np.ndarray, documents: int) -> np.ndarray:
    """1 for a phrase that no document holds by habit, less for each doubling of those that do, 0 where they are many."""
    most = HABIT_SHARE * documents + HABIT_LEAST
    return np.maximum(0.0, np.log(most / (holders + 1.0)) / np.log(most))


#: Rows with a document are pairs that reproduce enough words; the others tell how many documents hold a phrase (-1: how many there are).
_FOUND = pa.schema([("doc_id", pa.int64()), ("item", pa.int32()), ("passages", pa.binary()), ("given", pa.binary()), ("held", pa.list_(pa.int32())), ("phrase", pa.int32()), ("documents", pa.int64())])
_FOUND_SCHEMA = "doc_id long, item int, passages binary, given binary, held array<int>, phrase int, documents long"


def _search(batches: Iterator[pa.RecordBatch], items: Items) -> Iterator[pa.RecordBatch]:
    holders, documents = np.zeros(len(items.phrases), np.int64), 0
    first = np.concatenate([[0], np.cumsum([max(0, len(t) - PHRASE + 1) for t in items.tokens])])
    for batch in batches:
        for row in batch.to_pylist():
            block = Block.of(row)
            documents += len(block.docs)
            found = []
            for document, item, places in candidates(block, items, holders):
                low = int(block.starts[document])
                text: list[str] = []
                for a, b in _regions(places, low, low + int(block.lengths[document]), AROUND):
                    text += [*block.text(document, a, b), "\0"]
                ran, given = passages(items.tokens[item], text)
                if enough_words(ran):
                    there, words = set(zip(*(text[k:] for k in range(PHRASE)))), items.tokens[item]
                    held = {int(items.phrase_of[first[item] + k]) for k in range(len(words) - PHRASE + 1) if tuple(words[k : k + PHRASE]) in there}
                    found.append({"doc_id": int(block.docs[document]), "item": int(item), "passages": np.array(ran, np.int32).tobytes(), "given": given.tobytes(), "held": sorted(held)})
            yield pa.RecordBatch.from_pylist(found, _FOUND)
    some = np.flatnonzero(holders)
    columns = {"phrase": np.append(some, -1).astype(np.int32), "documents": np.append(holders[some], documents)}
    yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(len(some) + 1, f.type) for f in _FOUND], schema=_FOUND)


def _settle(batches: Iterator[pa.RecordBatch], weights: list[np.ndarray], ids: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            ran = [tuple(p) for p in np.frombuffer(row["passages"], np.int32).reshape(-1, 3).tolist()]
            if reproduces(ran, evidence(ran, np.frombuffer(row["given"], bool), weights[row["item"]])):
                out.append((row["doc_id"], int(ids[row["item"]])))
        columns = list(zip(*out)) or [(), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id"])


def search(index: DataFrame, items: Sequence[tuple[int, str]]) -> DataFrame:
    """``doc_id`` and ``item_id`` of each indexed document that reproduces an item; the items are what one broadcast holds."""
    context = index.sparkSession.sparkContext
    known = Items.of(items)
    held = context.broadcast(known)
    found = materialize(index.mapInArrow(lambda batches: _search(batches, held.value), _FOUND_SCHEMA), "pairs")
    pairs = found.where("doc_id is not null")

    # What reaches the driver is as large as the items, however many documents there are. Documents that reproduce an
    # item don't count for the habit of its phrases, so a leak stays one however often it occurs.
    total = found.where("doc_id is null").groupBy("phrase").agg(F.sum("documents").alias("n")).toArrow()
    own = pairs.select("item", F.explode("held").alias("phrase")).groupBy("item", "phrase").agg(F.count("*").alias("n")).toArrow()
    holders = np.zeros(len(known.phrases) + 1, np.int64)
    holders[total["phrase"].to_numpy()] = total["n"].to_numpy()  # the last one has the number of documents
    width = len(known.phrases) + 1
    keys = own["item"].to_numpy().astype(np.int64) * width + own["phrase"].to_numpy()
    order = np.argsort(keys)
    keys, less = np.append(keys[order], np.iinfo(np.int64).max), np.append(own["n"].to_numpy()[order], 0)
    wanted = known.item * width + known.phrase_of
    slot = np.searchsorted(keys, wanted)
    apart = holders[known.phrase_of] - np.where(keys[slot] == wanted, less[slot], 0)
    each = np.split(weight(apart, int(holders[-1])), np.searchsorted(known.item, np.arange(1, len(known.ids))))
    weights = context.broadcast((each, known.ids))
    return pairs.select("item", "doc_id", "passages", "given").mapInArrow(lambda batches: _settle(batches, *weights.value), "doc_id long, item_id long")


def leaked(documents: DataFrame, eval_items: DataFrame) -> DataFrame:
    """``doc_id`` and ``item_id`` of each document whose text reproduces at least 30 words of an item's text.

    The words must come in the item's order, as one or two passages that run on apart from imperfect copying:
    lost, added, split, joined or misspelled words, interjections, other case, accents or line breaks. Wording that
    many other documents share is no evidence of a copy.

    - Every document is indexed and every item is searched for in every block. Items are taken about ITEMS_AT_ONCE at a
      time, so what is broadcast is bounded; for more of them the stored index is searched in turns. Pairs
      that reproduce enough words are stored until the phrases have been counted over all documents.
    - Null or empty texts and null ids give no rows; items of fewer than 30 words can't leak. Repeated rows of
      either table give a pair once. Texts of any length are taken whole. Empty tables give no rows; further
      columns don't matter.
    """
    return search_all(write_index(documents), eval_items)


def write_index(documents: DataFrame, path: str | None = None) -> DataFrame:
    """The index of :func:`build_index`, stored in a folder, or where stages are kept; it can be read again by its path as parquet."""
    index = build_index(documents)
    if path is None:
        return materialize(index, "index", compression="zstd")
    index.write.option("compression", "zstd").parquet(path)
    return documents.sparkSession.read.schema(index.schema).parquet(path)


def search_all(index: DataFrame, eval_items: DataFrame) -> DataFrame:
    """``doc_id`` and ``item_id`` as of :func:`leaked`, out of a stored index."""
    rows = eval_items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text").distinct()
    turns = -(-rows.count() // ITEMS_AT_ONCE) or 1
    turn = F.pmod(F.xxhash64("item_id", "text"), F.lit(turns))
    # Each turn's items come to the driver alone, and its pairs are stored before the next.
    held = lambda k: [(r[0], r[1]) for r in rows.where(turn == k).collect()]
    if turns == 1:
        return search(index, held(0)).distinct()
    path = f"{shared_dir(index.sparkSession)}/leaked-{uuid.uuid4().hex}"
    for k in range(turns):
        search(index, held(k)).write.mode("append").parquet(path)
    return index.sparkSession.read.schema("doc_id long, item_id long").parquet(path).distinct()
