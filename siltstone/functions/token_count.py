"""Token counts as a length function: a tiktoken encoding that is loaded once in each worker.

The named vocabularies of tiktoken need its cache or a network; the default is
the public offline rank file, whose counts differ.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

_loaded: dict = {}


def encoding(name: str = "byte_bpe_50k"):
    """A tiktoken encoding by name: an offline rank file of public_tokenizers, else one that tiktoken knows."""
    if name not in _loaded:
        import tiktoken

        try:
            import base64

            import public_tokenizers

            with open(public_tokenizers.path(f"{name}.tiktoken"), encoding="ascii") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
            _loaded[name] = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        except (ImportError, OSError, KeyError, ValueError):
            _loaded[name] = tiktoken.get_encoding(name)
    return _loaded[name]


#: Characters up to which a word's count is kept, and how many counts a worker keeps, about: the first, as words that recur come early.
SHORT, KEPT = 24, 100_000
#: These counts by encoding; they outlive a task, as Spark uses a worker again.
_counts: dict[str, dict[str, int]] = {}


class TokenLength:
    """A picklable length function. Strings of special tokens count as ordinary text."""

    def __init__(self, name: str = "byte_bpe_50k"):
        self.name = name
        self._known = _counts.setdefault(name, {})

    def __getstate__(self):
        return {"name": self.name}

    def __setstate__(self, state):
        self.__init__(**state)

    def __call__(self, text: str) -> int:
        return self.many([text])[0]

    def many(self, texts: list[str], most: int | None = None) -> list[int]:
        """Counts of all texts; of one with more than `most` tokens, if given, some number above that."""
        return [self._count(t, most) for t in texts]

    def _count(self, text: str, most: int | None) -> int:
        """The known words' counts, and that of the text without them.

        Encodings break between a character that is not white space and a space
        behind it, so a word, with the space before it, counts by itself if
        both it and what stands before that space end so. A text in which some
        part ends otherwise is encoded whole.
        """
        encode, known, parts = encoding(self.name).encode_ordinary, self._known, text.split(" ")
        if len(parts) < 3:
            return len(encode(text))
        if most is not None and len(parts) > most + 1 and all(p and not p[-1].isspace() for p in parts[: most + 1]):
            return most + 1
        first, *words, last = parts
        counts = list(map(known.get, words))
        new = [w for w, n in zip(words, counts, strict=True) if n is None]
        if not first or first[-1].isspace() or any(not w or w[-1].isspace() for w in new):
            return len(encode(text))
        if len(known) < KEPT:
            for w in set(new):
                if len(w) <= SHORT:
                    known[w] = len(encode(" " + w))
        return sum(filter(None, counts)) + len(encode(" ".join([first, *new, last])))


def token_length(text, name: str = "byte_bpe_50k"):
    count = TokenLength(name)

    @F.pandas_udf("int")
    def lengths(texts: pd.Series) -> pd.Series:
        counts = iter(count.many(texts.dropna().tolist()))
        return pd.Series([next(counts) if there else pd.NA for there in texts.notna()], texts.index, "Int32")

    return lengths(text)
