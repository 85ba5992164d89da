"""Byte-level BPE: encoding and decoding by batched merge rounds in numpy."""

import heapq
import json
import re
import unicodedata
from hashlib import sha256
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from skein.llm.common import ragged, text_slices

#: Fixed by the vocabulary: how the tokenizer cuts text before it merges bytes.
CUTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Texts without a UTF-8 byte from 0xC9 on hold only code points below 0x240; for these the classes are spelt out, which is faster.
LATIN_LEAD = 0xC9
NONE = np.int64(1) << 40
SHIFT = np.int64(21)


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in vocabulary files: itself if it prints in Latin-1, else the next free one from 256."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def latin_cuts() -> re.Pattern:
    kinds: dict[str, list[str]] = {"L": [], "N": [], "space": []}
    for c in map(chr, range(0x240)):
        kind = "space" if regex.match(r"\p{White_Space}", c) else unicodedata.category(c)[0]
        if kind in kinds:
            kinds[kind].append(c)
    letter, number, space = ("".join(map(re.escape, kinds[k])) for k in ("L", "N", "space"))
    return re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


LATIN_CUTS = latin_cuts()


class Numbered(dict):
    """Numbers words as they are first looked up, and lists them in `new`."""

    def __init__(self):
        self.new: list = []

    def __missing__(self, word) -> int:
        self.new.append(word)
        self[word] = n = len(self)
        return n


class Runs:
    """Runs of numbers in one growing flat array."""

    def __init__(self, kind):
        self.flat, self.n, self.start, self.len, self.rows = np.zeros(1 << 16, kind), 0, np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), 0

    def add(self, flat: np.ndarray, lens: np.ndarray) -> None:
        while self.n + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.rows + len(lens) > len(self.start):
            self.start, self.len = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.len))
        self.flat[self.n : self.n + len(flat)] = flat
        self.start[self.rows : self.rows + len(lens)] = self.n + np.cumsum(lens) - lens
        self.len[self.rows : self.rows + len(lens)] = lens
        self.n, self.rows = self.n + len(flat), self.rows + len(lens)

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lens = self.len[rows]
        return self.flat[ragged(self.start[rows], lens)], lens


class Bpe:
    """A vocabulary and its merges, read from a tokenizers JSON file."""

    #: Words remembered between batches; beyond it the memory is emptied. Longer words have rounds of their own.
    REMEMBER, LONG = 400_000, 2_000

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        back = {c: b for b, c in letters.items()}
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.byte_id = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        pairs = [x.split(" ") if isinstance(x, str) else x for x in spec["model"]["merges"]]
        keys = np.array([(vocab[a] << int(SHIFT)) + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)  # by rank
        self.pairs = [(vocab[a], vocab[b]) for a, b in pairs]
        size = max(*vocab.values(), *self.special.values(), 0) + 1
        shown = [b""] * size
        for token, i in vocab.items():
            shown[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            shown[i] = token.encode()
        self.shown, self.decimal = Runs(np.uint8), Runs(np.uint8)
        for runs, items in ((self.shown, shown), (self.decimal, [b"%d," % i for i in range(size)])):
            runs.add(np.frombuffer(b"".join(items), np.uint8), np.array([len(x) for x in items], np.int64))
        self.cuts = regex.compile(CUTS)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.forget()

    def forget(self) -> None:
        self.known, self.words = Numbered(), Runs(np.int64)
        for content, i in self.special.items():
            self.known[(content,)] = self.words.rows
            self.words.add(np.array([i]), np.array([1]))

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << SHIFT) + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE) if len(self.keys) else np.full(len(key), NONE)

    def merge(self, symbols: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge rounds over many words at once: each round merges, in every word, all pairs of its lowest rank."""
        ids, done_at, done = np.arange(len(lens)), [], []
        sym, size = symbols, lens.astype(np.int64)
        rank = np.full(len(sym), NONE)
        if len(sym) > 1:
            rank[:-1] = self.ranks_of(sym[:-1], sym[1:])
        rank[np.cumsum(size) - 1] = NONE  # a word's last symbol begins no pair
        while len(sym):
            starts = np.cumsum(size) - size
            best = np.minimum.reduceat(rank, starts)
            still = best < NONE
            if not still.all():
                ended, stays = ~still, np.repeat(still, size)
                done.append(sym[~stays])
                done_at.append(np.stack([ids[ended], size[ended]]))
                sym, rank, size, ids, best = sym[stays], rank[stays], size[still], ids[still], best[still]
                if not len(sym):
                    break
            word = np.repeat(np.arange(len(size)), size)
            at = np.flatnonzero(rank == best[word])
            if len(at) > len(size):  # of overlapping pairs, as in "aaa", every other one from the left
                order = np.arange(len(at))
                new = np.ones(len(at), bool)
                new[1:] = at[1:] != at[:-1] + 1
                at = at[(order - np.maximum.accumulate(np.where(new, order, 0))) % 2 == 0]
            sym[at] = self.made[rank[at]]
            size = size - np.bincount(word[at], minlength=len(size))
            stays = np.ones(len(sym), bool)
            stays[at + 1] = False
            sym, rank = sym[stays], rank[stays]
            at = at - np.arange(len(at))  # where the merged symbols are now; only pairs beside them have other ranks
            ends = np.cumsum(size) - 1
            rank[at] = self.ranks_of(sym[at], sym[np.minimum(at + 1, len(sym) - 1)])
            left = at[at > 0] - 1
            rank[left] = self.ranks_of(sym[left], sym[left + 1])
            rank[ends] = NONE
        if not done:
            return symbols, lens
        which, sizes = np.concatenate(done_at, axis=1)
        flat, starts = np.concatenate(done), np.cumsum(sizes) - sizes
        order = np.argsort(which, kind="stable")
        return flat[ragged(starts[order], sizes[order])], sizes[order]

    def merge_long(self, symbols: np.ndarray) -> np.ndarray:
        """The same rounds for one very long word: over a linked list of its symbols, so a round costs no more than what it merges."""
        n, sym = len(symbols), np.append(symbols, -1)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        at_rank: dict[int, list] = {}
        waiting: list[int] = []

        def wait(ranks: np.ndarray, at: np.ndarray) -> None:
            good = np.flatnonzero(ranks < NONE)
            good = good[np.argsort(ranks[good], kind="stable")]
            ranks, at = ranks[good], at[good]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            for r, places in zip(ranks[np.concatenate([[0], cuts])].tolist() if len(ranks) else [], np.split(at, cuts)):
                if r not in at_rank:
                    at_rank[r] = []
                    heapq.heappush(waiting, r)
                at_rank[r].append(places)

        wait(self.ranks_of(symbols[:-1], symbols[1:]), np.arange(n - 1))
        while waiting:
            r = heapq.heappop(waiting)
            a, b = self.pairs[r]
            at = np.unique(np.concatenate(at_rank.pop(r)))
            at = at[sym[at] == a]
            at = at[sym[after[at]] == b]  # the end and merged places hold -1
            if a == b and len(at) > 1:  # of overlapping pairs every other one from the left
                order, new = np.arange(len(at)), np.ones(len(at), bool)
                new[1:] = after[at[:-1]] != at[1:]
                at = at[(order - np.maximum.accumulate(np.where(new, order, 0))) % 2 == 0]
            gone = after[at]
            sym[at], sym[gone] = self.made[r], -1
            after[at] = after[gone]
            before[after[at]] = at
            inner = at[after[at] < n]
            outer = before[at]
            outer = outer[outer >= 0]
            wait(self.ranks_of(sym[inner], sym[after[inner]]), inner)
            wait(self.ranks_of(sym[outer], sym[after[outer]]), outer)
        return sym[:n][sym[:n] >= 0]

    def learn(self, words: list[str]) -> None:
        """Encode words that were not met before; their numbers follow in this order."""
        raw = [w.encode() for w in words]
        lens = np.array([len(x) for x in raw], np.int64)
        flat = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        short = lens <= self.LONG
        if short.all():
            self.words.add(*self.merge(flat, lens))
            return
        starts = np.cumsum(lens) - lens
        sym, sizes = self.merge(flat[ragged(starts[short], lens[short])], lens[short])
        ids = iter(np.split(sym, np.cumsum(sizes)[:-1]))
        every = [next(ids) if s else self.merge_long(flat[a : a + n]) for s, a, n in zip(short, starts, lens)]
        self.words.add(np.concatenate(every), np.array([len(x) for x in every]))

    def pieces(self, text: str):
        """The words that the text is cut into; a special token's string is a tuple."""
        if self.specials is not None and self.specials.search(text):
            for k, part in enumerate(self.specials.split(text)):
                if k % 2:
                    yield (part,)
                elif part:
                    yield from (m[0] for m in self.cuts.finditer(part))
        else:
            yield from (m[0] for m in self.cuts.finditer(text))

    def cut(self, text: str) -> list:
        if self.specials is not None and "<" in text:
            return list(self.pieces(text))
        return (LATIN_CUTS if len(text) and np.frombuffer(text.encode(), np.uint8).max() < LATIN_LEAD else self.cuts).findall(text)

    def encode_words(self, words: list) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all the words, flat, and how many each word has."""
        if len(self.known) > self.REMEMBER:
            self.forget()
        rows = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        if self.known.new:
            self.learn(self.known.new)
            self.known.new = []
        return self.words.take(rows)

    def encode(self, text: str) -> list[int]:
        return self.encode_words(self.cut(text))[0].tolist()

    def decode(self, ids) -> str:
        """Bytes that are not UTF-8 become U+FFFD."""
        return self.shown.take(np.asarray(ids, np.int64))[0].tobytes().decode("utf-8", "replace")


#: Texts of more characters are encoded a part at a time.
PART = 1 << 20


def digests(bpe: Bpe, texts: list[str]):
    """(ids, sha256 of the ids, sha256 of the decoded text) of each text."""
    short = [t for t in texts if len(t) <= PART]
    cut = [bpe.cut(t) for t in short]
    ids, sizes = bpe.encode_words([w for words in cut for w in words])
    word_ends = np.cumsum([len(words) for words in cut], dtype=np.int64)
    total = lambda lens, ends: np.concatenate([[0], np.cumsum(lens)])[np.concatenate([[0], ends])]
    at = total(sizes, word_ends)
    digits, n = bpe.decimal.take(ids)
    digits, digits_at = digits.tobytes(), total(n, at[1:])
    shown, n = bpe.shown.take(ids)
    shown, shown_at = shown.tobytes(), total(n, at[1:])
    k = 0
    for t in texts:
        if len(t) > PART:
            yield long_digests(bpe, t)
            continue
        listed = digits[digits_at[k] : max(digits_at[k], digits_at[k + 1] - 1)]
        decoded = shown[shown_at[k] : shown_at[k + 1]].decode("utf-8", "replace")
        yield ids[at[k] : at[k + 1]], sha256(listed).hexdigest(), sha256(decoded.encode()).hexdigest()
        k += 1


def long_digests(bpe: Bpe, text: str) -> tuple[np.ndarray, str, str]:
    words, every, listed, decoded = bpe.pieces(text), [], sha256(), sha256()
    while part := list(islice(words, PART // 8)):
        ids, _ = bpe.encode_words(part)
        listed.update((b"," if every else b"") + bpe.decimal.take(ids)[0].tobytes()[:-1])
        decoded.update(bpe.shown.take(ids)[0].tobytes().decode("utf-8", "replace").encode())
        every.append(ids.astype(np.int32))
    return np.concatenate(every), listed.hexdigest(), decoded.hexdigest()


_loaded: dict[str, Bpe] = {}


def loaded(path: str) -> Bpe:
    """One vocabulary for each Python worker and path."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), with `ids` if asked for: encode each whole text, decode the ids again, and digest both.

    A null text is empty: no tokens, and the digests of the empty string. Each row is on its own, so ties,
    repeated rows and other columns change nothing; an empty table gives no rows; a null doc_id stays null. A special token's string in a text is that token.
    The vocabulary's path must be there on every executor. Rows of any length take bounded memory besides the text and its ids.
    """
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if keep_ids else [])]

    def run(batches):
        bpe = loaded(path)
        for part in text_slices(batches):
            ids, listed, decoded = zip(*digests(bpe, [t or "" for t in part.column(1).to_pylist()]))
            sizes = np.array([len(x) for x in ids], np.int64)
            columns = [part.column(0), pa.array(sizes), pa.array(listed), pa.array(decoded)]
            if keep_ids:
                ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if keep_ids else "")
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, schema)
