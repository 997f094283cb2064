"""Operator 9, BPE encoding and decoding over a minimal acyclic transducer.

1. A pass over all texts counts their words (map-side per block, one
   shuffle), and the most frequent ones, at most ``MOST_WORDS``, go to the
   driver, a bounded list.  A word is a lower-case piece of plain ASCII, or a
   run without ASCII white space, as the text spells it, if it holds others.
2. They are compiled into a minimal acyclic automaton: words in sorted order,
   states with equal suffixes shared, and integer outputs on the arcs that add
   up to a word's number; the number points at the word's token ids.  Its arcs
   lie in one array (a state's arc for byte b in slot ``base[state] + b``).  The
   automaton is a flat file, shipped with ``SparkContext.addFile`` and
   memory-mapped by every worker, which reads it in place.
3. Encoding is one narrow stage: all words of a block of texts walk the
   automaton together, a byte a step; a word that it does not hold is
   normalised and merged exactly, pair of lowest rank first, as the
   vocabulary's merge list says.

A word's ids are those of the pieces that the vocabulary's own pre-tokenizer
makes of the normalised word (NFC, other white space to blanks, lower case), so
ids equal those of the ``tokenizers`` library, special tokens in a text
included; decoding joins the tokens' strings with blanks, as a vocabulary
without a decoder does.

Defined results: null text counts as empty and has no ids; a null doc_id stays
null; a text of any length is encoded whole; repeated rows are each returned;
an empty table gives an empty result (and an empty lexicon); further columns
are ignored.
"""

from __future__ import annotations

import hashlib
import json
import mmap
import os
import re
import tempfile
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm.shared import blocks, bounded_batches, documents, materialise, texts_of
from postmill.llm.tokens import _byte_of_symbol

#: Words that the lexicon holds at most, and bytes that each has at most
#: (longer ones are merged).
MOST_WORDS, MOST_BYTES = 250_000, 48


#: Unicode White_Space, which the vocabulary file's ``\\s`` means; Python's own
#: splitting adds U+001C to U+001F.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_ODD, _BLANKS = re.compile("[\x1c-\x1f]"), re.compile(f"[{WHITE}]+")


def chunks_of(text: str) -> list[str]:
    """The text's stretches without white space."""
    if _ODD.search(text):
        return [c for c in _BLANKS.split(text) if c]
    return text.split()


#: ASCII pieces of a lower-case word, as ``PIECES`` makes them of a word
#: without what ``_UNEVEN`` finds: marks, apostrophes, special tokens.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PIECE, _UNEVEN = re.compile(rb"[a-z]+|[0-9]|[^a-z0-9]+"), re.compile(rb"[\x1c-\x1f\x80-\xff'<]")


def entries(word: bytes) -> list[bytes]:
    """What the lexicon is asked for a word of a text: its lower-case pieces
    if it is plain ASCII, else the word itself."""
    return [word] if _UNEVEN.search(word) else _PIECE.findall(word.lower())


class WordBpe:
    """The parts of a word-end BPE file that encoding needs."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.symbol = {b: c for c, b in _byte_of_symbol().items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(_BLANKS.search(t) for t in self.special):
            raise ValueError("a special token of this vocabulary holds white space")
        self.strings = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        if pattern != PIECES:
            raise ValueError("the words of this vocabulary are cut by another pattern")
        self.pieces = regex.compile(pattern.replace(r"\s", WHITE))
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def normal(self, text: str) -> str:
        """NFC and lower case, character by character (no final-sigma rule)."""
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)

    def encode(self, text: str) -> list[int]:
        """Ids of a text, piece by piece."""
        ids: list[int] = []
        for part in self.cut.split(text) if any(t in text for t in self.special) else [text]:
            if part in self.special:
                ids.append(self.special[part])
            else:
                for chunk in chunks_of(part):
                    for piece in self.pieces.findall(self.normal(chunk)):
                        ids += self.merge(piece)
        return ids

    def merge(self, word: str) -> list[int]:
        """Ids of one piece: its bytes' symbols, merged by falling priority."""
        parts = [self.symbol[b] for b in word.encode("utf-8", "surrogatepass")]
        if not parts:
            return []
        parts[-1] += self.end
        rank, none = self.rank.get, len(self.rank)
        ranks = [rank(pair, none) for pair in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)  # the leftmost of the lowest rank
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((parts[i - 1], parts[i]), none)
            if i < len(ranks):
                ranks[i] = rank((parts[i], parts[i + 1]), none)
        return [self.vocab[p] for p in parts]


class Merger:
    """Merges many pieces together: a row of symbols for each, in each
    round the leftmost pair of lowest rank of every row."""

    ROWS, WIDE = 4096, 256  # rows of a round; bytes of a piece

    def __init__(self, bpe: WordBpe):
        self.none = len(bpe.rank)
        pairs = sorted((bpe.vocab[a] << 32 | bpe.vocab[b], rank, bpe.vocab[a + b]) for (a, b), rank in bpe.rank.items())
        self.pair, rank, made = (np.array(x, np.int64) for x in zip(*pairs, (1 << 62, 0, 0)))
        self.rank = rank.astype(np.int32)
        self.made = np.zeros(self.none + 1, np.int64)
        self.made[rank[:-1]] = made[:-1]
        self.inner = np.array([bpe.vocab[bpe.symbol[b]] for b in range(256)], np.int64)
        self.last = np.array([bpe.vocab[bpe.symbol[b] + bpe.end] for b in range(256)], np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; ``none`` for pairs that never merge, such as
        those with -1, which stands after a row's end."""
        key = left << 32 | right
        at = np.searchsorted(self.pair, key)
        return np.where((self.pair[np.minimum(at, self.none)] == key) & (right >= 0), self.rank[np.minimum(at, self.none)], self.none).astype(np.int32)

    def merge(self, raw: np.ndarray, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces raw[at : at + length], normalised and not empty,
        one after another, and how many each has."""
        order, count, rows = np.argsort(length, kind="stable"), np.zeros(len(at), np.int64), []
        for first in range(0, len(order), self.ROWS):
            part = order[first : first + self.ROWS]
            ids = self._rows(raw, at[part], length[part])
            count[part] = (ids >= 0).sum(1)
            rows.append(ids[ids >= 0])
        flat = np.concatenate(rows) if rows else np.empty(0, np.int32)
        out, to = np.empty(len(flat), np.int32), np.cumsum(count) - count
        out[_runs(to[order], count[order])] = flat
        return out, count

    def _rows(self, raw: np.ndarray, start: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """A row of ids for each piece, filled up with -1."""
        n, width = len(sizes), int(sizes.max()) + 1
        at = np.arange(width)
        symbols = raw[np.minimum(start[:, None] + at, len(raw) - 1)]
        ids = np.where(at < sizes[:, None] - 1, self.inner[symbols], np.where(at == sizes[:, None] - 1, self.last[symbols], -1))
        rank = np.full((n, width), self.none, np.int32)
        rank[:, :-1] = self.ranks(ids[:, :-1], ids[:, 1:])
        done, live = np.full((n, width), -1, np.int32), np.arange(n)
        while True:
            best = rank.argmin(1)
            lowest = rank[np.arange(len(rank)), best]
            on = lowest < self.none
            done[live[~on], : ids.shape[1]] = ids[~on]
            rows = np.flatnonzero(on)
            if not len(rows):
                return done
            # the pair becomes one symbol, what follows moves up, the last column goes
            live, best, lowest, at = live[rows], best[rows], lowest[rows], at[:-1]
            shift = at + (at > best[:, None])
            ids, rank = ids[rows[:, None], shift], rank[rows[:, None], shift]
            row = np.arange(len(rows))
            ids[row, best] = self.made[lowest]
            after = np.minimum(best + 1, len(at) - 1)
            rank[row, best] = np.where(after > best, self.ranks(ids[row, best], ids[row, after]), self.none)
            inner = best > 0
            row, best = row[inner], best[inner]
            rank[row, best - 1] = self.ranks(ids[row, best - 1], ids[row, best])


def compile_lexicon(words: dict[bytes, list[int]]) -> bytes:
    """A minimal acyclic automaton over ``words`` as a flat file.

    States are built from the leaves of the sorted word list upwards and
    shared where their arcs and finality agree.  An arc's output is the number
    of accepted words that precede it in its state, so the outputs along a
    word sum to its rank among the sorted words.
    """
    order = sorted(words)
    known: dict[tuple, int] = {}
    counts: list[int] = []
    shapes: list[tuple] = []

    def state(final: bool, arcs: tuple) -> int:
        key = (final, arcs)
        if key not in known:
            known[key] = len(shapes)
            shapes.append(key)
            counts.append(int(final) + sum(counts[to] for _, to in arcs))
        return known[key]

    # open states along the current word: (final, finished arcs)
    path: list[list] = [[False, []]]
    last = b""

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            final, arcs = path.pop()
            path[-1][1].append((last[len(path) - 1], state(final, tuple(arcs))))

    for word in order:
        same = 0
        while same < min(len(last), len(word)) and last[same] == word[same]:
            same += 1
        close(same)
        path.extend([False, []] for _ in word[same:])
        path[len(word)][0] = True
        last = word
    close(0)
    root = state(path[0][0], tuple(path[0][1]))

    base, slots = _placed([[label for label, _ in arcs] for _, arcs in shapes])
    check, target, output = np.full(slots, -1, np.int32), np.zeros(slots, np.int32), np.zeros(slots, np.int32)
    for i, (final, arcs) in enumerate(shapes):
        before = int(final)
        for label, to in arcs:
            slot = base[i] + label
            check[slot], target[slot], output[slot] = i, to, before
            before += counts[to]
    ids = [words[w] for w in order]
    at = np.zeros(len(ids) + 1, np.int32)
    at[1:] = np.cumsum([len(x) for x in ids]) if ids else 0
    flat = np.array([x for one in ids for x in one], np.int32)
    head = np.array([root, len(shapes), slots, len(ids), len(flat)], np.int32)
    final = np.array([f for f, _ in shapes], np.int32)
    return b"".join(x.tobytes() for x in (head, np.array(base, np.int32), final, check, target, output, at, flat))


def _placed(labels: list[list[int]]) -> tuple[list[int], int]:
    """A base for each state so that no two arcs share a slot: the states with
    most arcs first, each at the first place that fits; and the slots needed."""
    free = np.ones(2 * sum(map(len, labels)) + 1024, bool)
    base, low, end = [0] * len(labels), 0, 0
    for i in sorted(range(len(labels)), key=lambda i: -len(labels[i])):
        own = labels[i]
        if len(own) < 2:
            break
        start = low
        while True:
            if len(free) < start + 2048:
                free = np.append(free, np.ones(len(free), bool))
            fits = free[start : start + 512].copy()
            for label in own[1:]:
                fits &= free[start + label - own[0] : start + label - own[0] + 512]
            found = int(fits.argmax())
            if fits[found]:
                break
            start += 512
        if start > low + 1024:
            low += 512  # crowded; what is free there is left to the single arcs
        at = start + found
        for label in own:
            free[at + label - own[0]] = False
        base[i] = at - own[0] + 256  # never below 0
        end = max(end, at + own[-1] - own[0])
    single = [i for i, own in enumerate(labels) if len(own) == 1]
    free = np.append(free, np.ones(len(single), bool))
    for i, at in zip(single, np.flatnonzero(free)[: len(single)].tolist()):
        base[i] = at - labels[i][0] + 256
        end = max(end, at)
    return base, end + 256 + 257


class Lexicon:
    """A compiled lexicon over a buffer, such as a memory-mapped file; its
    arrays are views of it."""

    def __init__(self, buffer):
        self.root, states, slots, self.words, ids = np.frombuffer(buffer, np.int32, 5).tolist()
        views, at = [], 20
        for n in (states, states, slots, slots, slots, self.words + 1, ids):
            views.append(np.frombuffer(buffer, np.int32, n, at))
            at += 4 * n
        self.base, self.final, self.check, self.target, self.output, self.start, self.ids = views

    def find_all(self, raw: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The numbers of the words raw[at : at + length], -1 where the lexicon
        does not hold one."""
        out = np.full(len(at), -1, np.int32)
        word = np.flatnonzero(length <= MOST_BYTES)
        pos, left = at[word], length[word].astype(np.int32)
        state, number = np.full(len(word), self.root, np.int32), np.zeros(len(word), np.int32)
        while len(word):
            done = left == 0
            if done.any():
                held = done & (self.final[state] > 0)
                out[word[held]] = number[held]
                on = ~done
                word, pos, left, state, number = word[on], pos[on], left[on], state[on], number[on]
                if not len(word):
                    break
            slot = self.base[state] + raw[pos]
            on = self.check[slot] == state
            slot, word, pos, left, number = slot[on], word[on], pos[on] + 1, left[on] - 1, number[on]
            state, number = self.target[slot], number + self.output[slot]
        return out

    def find(self, word: bytes) -> list[int] | None:
        """The word's ids, or None where the lexicon does not hold it."""
        n = int(self.find_all(np.frombuffer(word + b"\0", np.uint8), np.zeros(1, np.int64), np.array([len(word)]))[0])
        return None if n < 0 else self.ids[self.start[n] : self.start[n + 1]].tolist()


def _runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of each run, one run after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


#: Kinds of bytes: 0 white space, 1 letter, 2 digit, 3 other, 4 uneven.
_KIND = np.full(256, 3, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[65:91] = _KIND[97:123] = 1
_KIND[48:58] = 2
_KIND[28:32] = _KIND[128:] = _KIND[[39, 60]] = 4
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def entries_of(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``entries`` of all words of the texts in ``raw``: their bytes (lower
    case where plain) and each entry's start and length there."""
    kind = _KIND[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[ends], edge[0] = True, True
    before = np.append(np.uint8(0), kind[:-1])[: len(raw)]
    begins = (kind > 0) & ((before == 0) | edge[:-1])  # of words
    at = np.flatnonzero(begins)
    uneven = np.zeros(len(at), bool)
    if len(at):
        uneven[np.searchsorted(at, np.flatnonzero(kind == 4), "right") - 1] = True
    within = np.repeat(uneven, np.diff(np.append(at, len(raw))))  # from the first word on
    within = np.append(np.zeros(int(at[0]) if len(at) else len(raw), bool), within)
    starts = begins | ((kind > 0) & ~within & ((kind != before) | (kind == 2)))
    stops = (kind == 0) | starts
    at = np.flatnonzero(starts)
    stop = np.append(np.flatnonzero(stops | edge[:-1]), len(raw))
    length = stop[np.searchsorted(stop, at, "right")] - at if len(at) else at
    return np.where(within, raw, _LOWER[raw]), at, length


class Encoder:
    """Texts to ids with a lexicon; what a worker holds."""

    def __init__(self, vocabulary: str, lexicon: Lexicon):
        self.bpe, self.lexicon = WordBpe(vocabulary), lexicon
        self.merger, self.special = Merger(self.bpe), [t.encode() for t in self.bpe.special]
        self.strings = [self.bpe.strings.get(i, "") for i in range(max(self.bpe.strings) + 1)]

    def merged(self, raw: np.ndarray, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the entries raw[at : at + length] that the lexicon does not
        hold, one after another, and how many each has."""
        odd = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(_KIND[raw] == 4, out=odd[1:])
        own = np.flatnonzero((odd[at + length] > odd[at]) | (length > self.merger.WIDE))
        plain = np.ones(len(at), bool)
        plain[own] = False
        some, count = np.flatnonzero(plain), np.zeros(len(at), np.int64)
        ids, count[some] = self.merger.merge(raw, at[some], length[some])
        # the others are normalised and cut first
        pieces, of, exact = [], [], {}
        for i, a, n in zip(own.tolist(), at[own].tolist(), length[own].tolist()):
            word = raw[a : a + n].tobytes()
            text = word.decode("utf-8", "surrogatepass")
            cut = [] if b"<" in word and any(t in word for t in self.special) else [x.encode("utf-8", "surrogatepass") for c in chunks_of(text) for x in self.bpe.pieces.findall(self.bpe.normal(c))]
            if cut and max(map(len, cut)) <= self.merger.WIDE:
                pieces += cut
                of += [i] * len(cut)
            else:
                exact[i] = self.bpe.encode(text)
        sizes, of = np.array([len(x) for x in pieces], np.int64), np.array(of, np.int64)
        more, each = self.merger.merge(np.frombuffer(b"".join(pieces) or b"\0", np.uint8), np.cumsum(sizes) - sizes, sizes)
        np.add.at(count, of, each)
        for i, found in exact.items():
            count[i] = len(found)
        to = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.int32)
        out[_runs(to[some], count[some])] = ids
        if len(of):
            first = np.unique(of)  # pieces of an entry follow each other
            out[_runs(to[first], count[first])] = more
        for i, found in exact.items():
            out[to[i] : to[i] + len(found)] = found
        return out, count

    def texts(self, raw: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        """Ids of each text of ``raw``, UTF-8 bytes of which text i ends
        before ends[i]."""
        raw, at, length = entries_of(raw, ends)
        number = self.lexicon.find_all(raw, at, length)
        held, start, known = number >= 0, self.lexicon.start, self.lexicon.ids
        more, each = self.merged(raw, at[~held], length[~held])
        count = np.empty(len(at), np.int64)
        count[held], count[~held] = start[number[held] + 1] - start[number[held]], each
        to = np.cumsum(count) - count
        ids = np.empty(int(count.sum()), "<u4")
        ids[_runs(to[held], count[held])] = known[_runs(start[number[held]], count[held])]
        ids[_runs(to[~held], each)] = more
        edges = np.append(to, len(ids))[np.searchsorted(at, np.append(0, ends))]
        return [ids[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]

    def decode(self, ids: np.ndarray) -> str:
        return " ".join(map(self.strings.__getitem__, ids.tolist()))


def bytes_of(batch: pa.RecordBatch, name: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a batch's texts in a row (null as empty) and where
    each ends."""
    texts = pc.fill_null(batch.column(name).cast(pa.large_string()), "")
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.empty(0, np.uint8)
    return raw, at[1:] - at[0]


def frequent_words(docs: DataFrame, most: int = MOST_WORDS) -> list[bytes]:
    """The most frequent words of all texts: those above the smallest count
    that leaves at most ``most`` of them; where already the highest counts have
    more words, an even share of these by hash."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()

        def flush() -> pa.RecordBatch:
            found: Counter = Counter()
            for word, n in words.items():
                for entry in entries(word):
                    found[entry] += n
            words.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

        for block in blocks(batches):
            for t in texts_of(block):
                words.update(t.encode("utf-8", "surrogatepass").split())
            if len(words) > 500_000:
                yield flush()
        yield flush()

    counts = bounded_batches(docs).select("text").mapInArrow(counted, "word binary, n long").where(F.octet_length("word") <= MOST_BYTES).groupBy("word").agg(F.sum("n").alias("n"))
    counts = materialise(counts, "word-counts")
    # a histogram of counts in 64 steps per doubling (some thousand rows at
    # most) tells from which count on the words are few enough to collect
    step = F.floor(F.log2("n") * 64).cast("int")
    histogram = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words")).collect()
    least, total, share = None, 0, 1
    for r in sorted(histogram, key=lambda r: -r.step):
        total += r.words
        if total > most:
            if least is None:
                least, share = r.step, -(-2 * total // max(most, 1))
            break
        least = r.step
    if least is None:
        return []
    return [bytes(r.word) for r in counts.where((step >= least) & (F.pmod(F.xxhash64("word"), F.lit(share)) == 0)).select("word").collect()]


@lru_cache(maxsize=1)
def _word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


@lru_cache(maxsize=1)
def _encoder(vocabulary: str, name: str) -> Encoder:
    with open(SparkFiles.get(name), "rb") as f:
        return Encoder(vocabulary, Lexicon(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)))


def ship_lexicon(spark: SparkSession, words: list[bytes], vocabulary: str) -> str:
    """Compile ``words`` and send the file to all executors, late ones
    included; its name there."""
    bpe = _word_bpe(vocabulary)
    folder = tempfile.mkdtemp(prefix="postmill-")  # of the driver, which serves it
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    with open(os.path.join(folder, name), "wb") as f:
        f.write(compile_lexicon({w: bpe.encode(w.decode("utf-8", "surrogatepass")) for w in words}))
    spark.sparkContext.addFile(os.path.join(folder, name))
    return name


def encode(docs: DataFrame, vocabulary: str, most_words: int = MOST_WORDS, outputs: bool = True, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit), ids_sha256,
    decoded, decoded_sha256; ``outputs=False`` leaves ids and decoded null."""
    rows = bounded_batches(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    name = ship_lexicon(docs.sparkSession, frequent_words(rows, most_words), vocabulary)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary, name)
        for block in blocks(batches):
            found = encoder.texts(*bytes_of(block))
            ids = [i.tobytes() for i in found]
            decoded = [encoder.decode(i) for i in found]
            yield pa.RecordBatch.from_arrays(
                [
                    block.column("doc_id"),
                    pa.array([len(i) for i in found], pa.int64()),
                    pa.array(ids if outputs else [None] * len(ids), pa.binary()),
                    pa.array([hashlib.sha256(i).hexdigest() for i in ids]),
                    pa.array(decoded if outputs else [None] * len(ids), pa.string()),
                    pa.array([hashlib.sha256(d.encode("utf-8", "surrogatepass")).hexdigest() for d in decoded]),
                ],
                ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded", "decoded_sha256"],
            )

    return rows.mapInArrow(encoded, "doc_id long, n_tokens long, ids binary, ids_sha256 string, decoded string, decoded_sha256 string")


def op9_bpe_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), outputs=False).drop("ids", "decoded")
