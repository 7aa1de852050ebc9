"""Packing, token counts and BPE against the libraries and brute force."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from foliant.llm import differencing_pack, prefix_bpe, trie_counts
from tests.llm.data import awkward, prose

LIBRARY = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
ODD = ["a", "th", "ing", "e", "'s", "'LL", "12", "²", "é", "é", " ̈", "Σ", "ΑΣ", "İ", "漢", "한", "😀", " ", "\n", "\t", "\r", "\x0b", "\x1c", "\x85", "\xa0", "　", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "!", "...", ".", ",", "Th", "\x00", "_", "ß"]
TEXTS = {0: None, 1: "", 2: "Hello, world. It's <|endoftext|>fine", 3: prose(3, 9000), 4: prose(4, 50), 5: prose(4, 50), 6: " \n\t ", 7: "x" * 5000, 8: prose(8, 700), None: "no id"}


def odd(n: int, seed: int = 1) -> list[str]:
    g = random.Random(seed)
    return ["".join(g.choices(ODD, k=g.randint(0, 14))) for _ in range(n)]


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_prefix_encoder_equals_the_library():
    encoder = prefix_bpe.encoder(public_tokenizers.path("word_bpe_49k.json"))
    for text in [*odd(3000), *[prose(i, 40) for i in range(40)], "a" * 300, "abab" * 50]:
        assert encoder.encode(text) == ids(text), text
        assert encoder.decode(ids(text)) == LIBRARY.decode(ids(text), skip_special_tokens=False)


def test_encoded_rows(spark):
    texts = TEXTS | {100 + i: t for i, t in enumerate(odd(60, 2))}
    got = {r["doc_id"]: r for r in prefix_bpe.encoded(awkward(spark, [*texts.items(), (4, texts[4])])).collect()}
    assert len(got) == len(texts)
    for i, t in texts.items():
        want = ids(t)
        assert got[i]["n_tokens"] == len(want)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(LIBRARY.decode(want, skip_special_tokens=False).encode()).hexdigest()
    assert prefix_bpe.encoded(awkward(spark, {})).count() == 0


def test_unit_ids_equal_the_library():
    import pyarrow as pa

    units = differencing_pack.UnitIds(public_tokenizers.path("word_bpe_49k.json"), entries=500)
    texts = [*odd(3000, 5), None, "", prose(1, 3000)]
    seen = 0
    for at, end, data, offsets in differencing_pack.pieces(pa.array([None if t is None else t.encode() for t in texts], pa.binary()), 4000):
        flat, bounds = units.encode(data, offsets)
        for k in range(end - at):
            assert flat[bounds[k] : bounds[k + 1]].tolist() == ids(texts[at + k]), texts[at + k]
            seen += 1
    assert seen == len(texts)


def check_packing(rows, texts, capacity):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for i, t in texts.items():
        want, at = [*ids(t), 1], 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(want)) and r["length"] > 0
            assert r["ids_crc32"] == zlib.crc32(np.array(want[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(want)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return len(by_sequence)


def test_packed_rows(spark):
    texts = TEXTS | {100 + i: prose(i, 30 + 37 * (i % 40)) for i in range(400)}
    docs = awkward(spark, texts)
    rows = differencing_pack.packed(docs.coalesce(2)).collect()
    count = check_packing(rows, texts, 2048)
    total = sum(r["length"] for r in rows)
    assert total / (count * 2048) > 0.95
    assert differencing_pack.packed(awkward(spark, {})).count() == 0
    twice = differencing_pack.packed(awkward(spark, [(4, TEXTS[4])] * 2)).collect()
    assert len(twice) == 2 and len({(r["sequence_id"], r["offset"]) for r in twice}) == 2


def test_differencing_parts():
    g = random.Random(3)
    sizes = np.array([g.randint(1, 512) for _ in range(500)])
    part = differencing_pack.windows(sizes, 2048)
    load = np.bincount(part, sizes)
    assert load.max() <= 2048 and load.min() > 0.9 * load.max()
    assert len(load) <= 1 + np.ceil(sizes.sum() / 2048) * 1.02
    classic = np.array([8, 7, 6, 5, 4])
    assert sorted(np.bincount(differencing_pack.differencing(classic, 2), classic)) == [14, 16]
    assert differencing_pack.windows(np.zeros(0, np.int64)).tolist() == []


def brute_cost(model, word):
    best = [0]
    for end in range(1, len(word) + 1):
        choices = []
        for start in range(end):
            piece = word[start:end]
            if piece in model.pieces:
                choices.append(best[start] + model.pieces[piece])
            elif end - start == 1:
                choices.append(best[start] + model.byte * len(piece.encode()))
        best.append(min(choices))
    return best[-1]


def test_trie_counts(spark):
    model = trie_counts.UnigramTrie(public_tokenizers.path("piece_bpe_32k.model"))
    texts = {k: v for k, v in TEXTS.items() if k is not None} | {100 + i: t for i, t in enumerate(odd(80, 9))}
    got = {r["doc_id"]: r for r in trie_counts.token_counts(awkward(spark, [*texts.items(), (4, texts[4])])).collect()}
    for i, t in texts.items():
        parts = [p for p in (t or "").replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") if p]
        if max(map(len, parts), default=0) > 200:
            continue
        total = sum(brute_cost(model, trie_counts.MARK + p) for p in parts)
        mask = (1 << trie_counts.SHIFT) - 1
        assert (got[i]["n_pretokens"], got[i]["n_tokens"], got[i]["cost_micronats"]) == (len(parts), total & mask, total >> trie_counts.SHIFT)
    assert got[7]["n_tokens"] > 0
    assert trie_counts.token_counts(awkward(spark, {})).count() == 0


def test_suffix_automaton_names_all_keys_that_end_at_a_place():
    import random

    from foliant.llm.prefix_bpe import SuffixAutomaton

    g = random.Random(3)
    keys = {"".join(g.choices("abc", k=g.randint(1, 6))): i for i in range(150)}
    a = SuffixAutomaton(keys)
    for _ in range(50):
        text, state, size = "".join(g.choices("abcd", k=30)), 0, 0
        for i, c in enumerate(text, 1):
            while (to := a.step[state].get(c)) is None and state:
                state = a.link[state]
                size = a.length[state]
            state, size = (to, size + 1) if to is not None else (0, 0)
            got = a.ends[state if size == a.length[state] else a.link[state]] if state else ()
            assert list(got) == sorted(((len(k), v) for k, v in keys.items() if text[:i].endswith(k)), reverse=True)
