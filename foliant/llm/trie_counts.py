"""Token counts under a unigram model, with one forward pass for each shared prefix.

A text's pre-tokens are its parts between blanks, each with the mark U+2581 before it. A unigram model gives each
piece of a vocabulary a cost (here the logarithm of its place in the vocabulary, in whole millionths; pieces of
unknown letters are their UTF-8 bytes), and a pre-token is cut where the sum of costs is least, then where the
pieces are fewest. Both are one whole number, so sums and ties are exact.

The distinct pre-tokens of a batch are put in a trie, which sorting them lays out: a node's forward score depends
on its prefix alone, so it is worked out once and the words below it go on from there; the scores at ends of words
are kept in a memo of bounded size. Map-only.

Defined results: null and empty texts have no pre-tokens, no tokens and cost 0; repeated rows have equal results; null ids
are rows like others; an empty table gives an empty one; texts are read whole however long; columns other than id and text
are not read.
"""

from __future__ import annotations

import math
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.vocabularies import MEMO_ENTRIES, chunks, vocabulary
from foliant.sources.tables import table

MARK = "▁"
SHIFT = 40  # a score is cost << SHIFT | pieces


class UnigramTrie(dict):
    """Forward scores at the ends of the pre-tokens seen so far, by pre-token without its mark."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        places = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        self.pieces = {model.id_to_piece(i): self.price(k) for k, i in enumerate(places)}
        self.byte = self.price(len(places))
        self.longest = max(map(len, self.pieces))

    @staticmethod
    def price(place: int) -> int:
        return round(1e6 * math.log(place + 2)) << SHIFT | 1

    def learn(self, found) -> None:
        """Scores the distinct pre-tokens that are not known yet, in the trie's order."""
        new = [c for c in found if c not in self]
        if len(self) + len(new) > 2 * MEMO_ENTRIES:
            self.clear()
            new = list(found)
        pieces, longest, before, best = self.pieces, self.longest, "", [0]
        for c in sorted(new):
            w = MARK + c
            same, most = 0, min(len(w), len(before))
            while same < most and w[same] == before[same]:
                same += 1
            del best[same + 1 :]  # the path from the root to where both words part
            for end in range(same + 1, len(w) + 1):
                letter = w[end - 1]
                least = best[end - 1] + (pieces.get(letter) or self.byte * len(letter.encode("utf-8", "surrogatepass")))
                for start in range(max(0, end - longest), end - 1):
                    cost = pieces.get(w[start:end])
                    if cost is not None and best[start] + cost < least:
                        least = best[start] + cost
                best.append(least)
            self[c] = best[-1]
            before = w


@lru_cache(maxsize=2)
def trie(path: str) -> UnigramTrie:
    return UnigramTrie(path)


def token_counts(docs: DataFrame, name: str = "piece_bpe_32k.model", directory: str | None = None) -> DataFrame:
    """doc_id, n_pretokens, n_tokens and cost_micronats of each document."""

    def run(batches):
        from foliant.llm.trie_counts import SHIFT, trie

        known = trie(vocabulary(name, directory))
        for batch in batches:
            n, total = [], []
            for at in range(0, batch.num_rows, 512):
                split = [chunks(x or "") for x in batch.column(1).slice(at, 512).to_pylist()]
                known.learn(set().union(*split))
                n += map(len, split)
                total += [sum(map(known.__getitem__, c)) for c in split]
            cols = [pa.array(n, pa.int64()), pa.array([t & (1 << SHIFT) - 1 for t in total], pa.int64()), pa.array([t >> SHIFT for t in total], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", "n_pretokens", "n_tokens", "cost_micronats"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long, cost_micronats long")


def op7_trie_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document."""
    return token_counts(table(spark, sf_dir, "documents"))


QUERIES = {"op7_trie_counts": op7_trie_counts}
