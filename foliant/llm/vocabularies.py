"""Where the public vocabulary files lie, and splitting a text where no token can cross.

The files' directory is a parameter everywhere (``None``: the installed ``public_tokenizers`` package); none of
them is copied.
"""

from __future__ import annotations

import ctypes
import os
import sys

import pyarrow as pa

_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None
#: Entries that a worker's memo of encoded chunks may hold before it starts anew; bounds memory, not results.
MEMO_ENTRIES = 300_000


def vocabulary(name: str, directory: str | None = None) -> str:
    """The path of a vocabulary file on the machine that asks."""
    if directory:
        return os.path.join(directory, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def chunks(text: str) -> list[str]:
    """The non-empty parts between spaces, line feeds, carriage returns and tabs."""
    return list(filter(None, text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")))


class Memo(dict):
    """Results of *make* by argument; starts anew once it holds MEMO_ENTRIES."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, key):
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        out = self[key] = self.make(key)
        return out


def release_memos() -> None:
    """Empties what token operators keep in this worker between tasks, and gives freed memory back, before another
    operator needs it."""
    for module, cache in (("differencing_pack", "unit_ids"), ("prefix_bpe", "encoder"), ("trie_counts", "trie")):
        loaded = sys.modules.get(f"foliant.llm.{module}")
        if loaded is not None:
            getattr(loaded, cache).cache_clear()
    trim()


def trim() -> None:
    """Gives memory back that this worker has freed, in earlier tasks of other operators too."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)
