"""Exact BPE encoding and decoding by dynamic programming over prefixes.

For byte pair encoding with ranked merges, every prefix of a word has one encoding, and so one last token. The
encoder walks a word once through a suffix automaton of the vocabulary: its state at each position is the longest
suffix that occurs in any token, and the whole tokens on the state's chain of suffix links are those that end there; of
these, the last token of the prefix is the one that is compatible with the last token of the shorter prefix before it. Two tokens are compatible if no merge across their border would come before those that made
them, which undoing their merges one by one decides. Back-pointers from the word's end give the ids.

``word_bpe_49k`` marks a word's end in its last symbol ("x</w>"), so tokens with that mark are matched against
the word with an end sign, all others against proper prefixes.

Defined results: null texts are empty, with no ids; special tokens' own strings in a text get their ids, as the
tokenizers library does it; repeated rows and null ids are rows like others; an empty table gives an empty one; texts
are read whole however long, a part between blanks at a time; columns other than id and text are not read.
"""

from __future__ import annotations

import gc
import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.vocabularies import chunks, vocabulary
from foliant.sources.tables import table

#: Letters of texts whose new words are worked out at once.
AT_ONCE = 1 << 21
#: Chunks that a worker's memo may hold before it starts anew; bounds memory, not results.
MEMO_ENTRIES = 600_000
END = "\n"  # never a symbol: byte-level symbols are printable


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    out = dict(zip(shown, map(chr, shown), strict=True)) | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [out[b] for b in range(256)]


class SuffixAutomaton:
    """The minimal automaton of all substrings of the keys: transitions, suffix links, and the length of each state's
    longest string. A key is the longest string of its state, since nothing precedes it where it is inserted."""

    def __init__(self, keys: dict[str, int]):
        step, link, length, value = [{}], [-1], [0], {}
        for key, v in keys.items():
            last = 0
            for c in key:
                q = step[last].get(c)
                if q is None:
                    new, p = len(step), last
                    step.append({})
                    length.append(length[last] + 1)
                    link.append(0)
                    while p >= 0 and (q := step[p].get(c)) is None:
                        step[p][c] = new
                        p = link[p]
                    if p >= 0:
                        link[new] = q if length[q] == length[p] + 1 else self._split(step, link, length, p, c, q)
                    last = new
                else:
                    last = q if length[q] == length[last] + 1 else self._split(step, link, length, last, c, q)
            value[last] = v
        self.step, self.link, self.length = step, link, length
        # For each state the keys on its chain, itself included, the longest first: their lengths and values.
        self.ends = [()] * len(step)
        for state in sorted(range(1, len(step)), key=length.__getitem__):
            above = self.ends[link[state]]
            self.ends[state] = ((length[state], value[state]), *above) if state in value else above

    @staticmethod
    def _split(step: list, link: list, length: list, p: int, c: str, q: int) -> int:
        """A state for the strings of *q* up to the one that *p* and *c* make; what leads to these leads to it."""
        new = len(step)
        step.append(dict(step[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = new
        while p >= 0 and step[p].get(c) == q:
            step[p][c] = new
            p = link[p]
        return new


class PrefixEncoder:
    """Encoder and decoder for a ``tokenizers`` BPE file whose words end in a suffix."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        self.tokens = {i: t for t, i in vocab.items()} | {x["id"]: x["content"] for x in spec["added_tokens"]}
        self.decimal = {i: str(i) for i in self.tokens}
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words, self.blank = regex.compile(pattern), regex.compile(r"\s+")
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.symbols = byte_symbols()
        # Ranks: symbols come before all merges, merges in their order.
        self.merged, self.parts, self.rank = {}, {}, {}
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            t = vocab[a + b]
            self.merged[vocab[a], vocab[b]] = t
            self.parts[t] = (vocab[a], vocab[b])
            self.rank[t] = r + 1
        sound = {}
        for t in vocab.values():  # parts come before what is made of them
            if t not in self.rank:
                sound[t] = True
        for t in sorted(self.rank, key=self.rank.get):
            a, b = self.parts[t]
            sound[t] = sound[a] and sound[b] and self._settled(a, b, self.rank[t])
        self.automaton = SuffixAutomaton({t[: -len(suffix)] + END if t.endswith(suffix) else t: i for t, i in vocab.items() if t not in self.special and sound[i]})
        self.stable: dict[int, bool] = {}
        self.memo: dict[str, tuple[int, str, str] | None] = {}

    def _settled(self, a: int, b: int, limit: float = float("inf")) -> bool:
        """Whether the border between adjacent tokens *a* and *b* outlives all merges of a rank below *limit*."""
        rank, parts, merged = self.rank, self.parts, self.merged
        while True:
            c = merged.get((a, b))
            if c is not None and rank[c] < limit:
                return False
            ra, rb = rank.get(a, 0), rank.get(b, 0)
            if not ra and not rb:
                return True
            if ra > rb:  # the left token was made last
                limit, a = ra, parts[a][1]
            else:  # equal merges go from left to right, so one across the border would come first
                limit, b = rb + 1, parts[b][0]

    def words_ids(self, words: Iterable[str]) -> Iterator[tuple[str, list[int]]]:
        """Each pre-token and its ids. In sorted order a word goes on where it parts from the one before, since what was
        found for their common prefixes holds for both."""
        stable, automaton = self.stable, self.automaton
        step, link, length, ends = automaton.step, automaton.link, automaton.length, automaton.ends
        symbols, settled = self.symbols, self._settled
        coded = sorted((w if w.isascii() and w.isprintable() and " " not in w else "".join([symbols[b] for b in w.encode("utf-8")]), w) for w in words)
        room = max((len(s) for s, _ in coded), default=0) + 2
        last, back, states, sizes = [-1] * room, [0] * room, [0] * room, [0] * room  # by length of the prefix
        before = ""
        for s, word in coded:
            i = 0
            for x, y in zip(s, before, strict=False):
                if x != y:
                    break
                i += 1
            before, state, size = s, states[i], sizes[i]
            for c in s[i:] + END:
                i += 1
                while (to := step[state].get(c)) is None and state:
                    state = link[state]
                    size = length[state]
                state, size = (0, 0) if to is None else (to, size + 1)  # a symbol that no token has is left out
                states[i], sizes[i], last[i] = state, size, -1
                for long, token in ends[state if size == length[state] else link[state]]:
                    start = i - long
                    if start:
                        p = last[start]
                        key = p << 20 | token
                        ok = stable.get(key)
                        if ok is None:
                            if len(stable) > 2_000_000:
                                stable.clear()
                            ok = stable[key] = p >= 0 and settled(p, token)
                        if not ok:
                            continue
                    last[i], back[i] = token, start
                    break
            ids = []
            while i > 0:
                ids.append(last[i])
                i = back[i]
            yield word, ids[::-1]

    def _pieces(self, chunk: str) -> list[str | int]:
        """The pre-tokens of a chunk, and the ids of special tokens in it."""
        if "<" not in chunk:
            return self.words.findall(self._lower(chunk))
        out = []
        for piece in self.cut.split(chunk):
            out += (self.special[piece],) if piece in self.special else self.words.findall(self._lower(piece))
        return out

    def _lower(self, piece: str) -> str:
        if piece.isascii():
            return piece.lower()
        piece = unicodedata.normalize("NFC", piece)
        if not piece.isprintable():  # no blank but the space is
            piece = self.blank.sub(" ", piece)
        # Letter by letter where it matters: a final sigma is an inner one here.
        return "".join([c.lower() for c in piece]) if "\u03a3" in piece else piece.lower()

    def _entry(self, ids: list[int]) -> tuple[int, str, str]:
        decimal = self.decimal
        return len(ids), " ".join([decimal[i] for i in ids]), self.decode(ids)

    def learn(self, parts: Iterable[str]) -> dict[str, tuple[int, str, str] | None]:
        """The memo with all of *parts* in it, chunks each of which has a number of ids, the ids in decimal, and their
        decoded text; None if there are no ids."""
        memo = self.memo
        new = {c for c in parts if c not in memo}
        if len(memo) + len(new) > MEMO_ENTRIES:
            memo.clear()
            new = set(parts)
        pieces = {c: self._pieces(c) for c in new}
        of = {w: self._entry(ids) for w, ids in self.words_ids({w for found in pieces.values() for w in found if w.__class__ is str})}
        for c, found in pieces.items():
            if len(found) == 1 and found[0] in of:
                memo[c] = of[found[0]]
            else:
                whole = [of[w] if w.__class__ is str else self._entry([w]) for w in found]
                memo[c] = (sum([x[0] for x in whole]), " ".join([x[1] for x in whole]), " ".join([x[2] for x in whole])) if whole else None
        return memo

    def encode(self, text: str) -> list[int]:
        parts = chunks(text)
        memo = self.learn(parts)
        return [int(x) for c in parts if (got := memo[c]) for x in got[1].split(" ")]

    def decode(self, ids: list[int]) -> str:
        """As the library does it for a file without a decoder: the tokens with spaces between them."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in ids])


@lru_cache(maxsize=2)
def encoder(path: str) -> PrefixEncoder:
    """One encoder for each worker process and file."""
    return PrefixEncoder(path)


def _texts(column: pa.Array) -> Iterator[list[str]]:
    """The texts in runs of about AT_ONCE letters; nulls are empty."""
    some, size = [], 0
    for text in column:
        some.append(text.as_py() or "")
        size += len(some[-1])
        if size > AT_ONCE:
            yield some
            some, size = [], 0
    if some:
        yield some


def encoded(docs: DataFrame, name: str = "word_bpe_49k.json", directory: str | None = None) -> DataFrame:
    """One row a document: number and digest of its ids, digest of what they decode to; map-only."""

    def run(batches):
        from foliant.llm.prefix_bpe import encoder

        known = encoder(vocabulary(name, directory))
        gc.disable()  # nothing here refers to itself, and the collector would walk the memo again and again
        try:
            for batch in batches:
                counts, ids, texts = [], [], []
                for some in _texts(batch.column(1)):
                    divided = [chunks(text) for text in some]
                    memo = known.learn({c for parts in divided for c in parts})
                    for parts in divided:
                        found = list(filter(None, map(memo.__getitem__, parts)))
                        counts.append(sum([p[0] for p in found]))
                        ids.append(hashlib.sha256(" ".join([p[1] for p in found]).encode()).hexdigest())
                        texts.append(hashlib.sha256(" ".join([p[2] for p in found]).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        finally:
            gc.enable()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded."""
    return encoded(table(spark, sf_dir, "documents"))


QUERIES = {"op9_prefix_bpe": op9_prefix_bpe}
