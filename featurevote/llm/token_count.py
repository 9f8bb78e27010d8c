"""Counts of byte-pair tokens by a heap and a linked list, with no ids made.

The symbols of a piece form a doubly linked list, its adjacent pairs a heap by merge rank and place.
The lowest pair is popped and joined until no pair can be; the count is the number of initial symbols
minus the number of merges.
"""

from __future__ import annotations

import functools
import heapq
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from featurevote.llm.bpe import byte_characters, special_pattern
from featurevote.llm.common import map_texts

# Entries that a worker keeps at most of each memo; a full one starts anew.
MEMO_CUTS = 600_000
MEMO_PIECES = 200_000


class WordBpeCounter:
    """A vocabulary with word ends, lower case and white space dropped, from a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        pre = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        if (
            steps != ["NFC", "Replace", "Lowercase"]
            or [p["type"] for p in pre] != ["Split", "ByteLevel"]
            or (pre[0]["behavior"], pre[0]["invert"], pre[1]["use_regex"]) != ("Removed", True, False)
            or not model["end_of_word_suffix"]
        ):
            raise ValueError("needs a BPE file with word ends, lower case and dropped white space")
        self.pattern = regex.compile(pre[0]["pattern"]["Regex"])
        self.special = special_pattern(spec["added_tokens"])
        ids, end = model["vocab"], model["end_of_word_suffix"]
        chars = byte_characters()
        self.inner = [ids[c] for c in chars]
        self.final = [ids[c + end] for c in chars]
        self.size = 1 + max(ids.values())
        self.merges = {
            ids[a] * self.size + ids[b]: (rank, ids[a + b]) for rank, (a, b) in enumerate(model["merges"])
        }
        self.pieces: dict[str, int] = {}
        self.cuts: dict[str, int] = {}

    def count_piece(self, piece: str) -> int:
        raw = piece.encode("utf-8")
        symbols = [*map(self.inner.__getitem__, raw[:-1]), self.final[raw[-1]]]
        left = len(symbols)
        after, before = list(range(1, left + 1)), list(range(-1, left - 1))
        merges, size, stop = self.merges, self.size, left
        heap = []
        for k in range(left - 1):
            found = merges.get(symbols[k] * size + symbols[k + 1])
            if found:
                heap.append((found[0], k, found[1]))
        heapq.heapify(heap)
        while heap:
            rank, k, joined = heapq.heappop(heap)
            right = after[k]
            if symbols[k] < 0 or right >= stop:
                continue
            if merges.get(symbols[k] * size + symbols[right], (-1,))[0] != rank:
                continue
            symbols[k], symbols[right] = joined, -1
            after[k] = beyond = after[right]
            left -= 1
            if beyond < stop:
                before[beyond] = k
                found = merges.get(joined * size + symbols[beyond])
                if found:
                    heapq.heappush(heap, (found[0], k, found[1]))
            if (prior := before[k]) >= 0:
                found = merges.get(symbols[prior] * size + joined)
                if found:
                    heapq.heappush(heap, (found[0], prior, found[1]))
        return left

    def count_cut(self, cut: str) -> int:
        """Tokens of a text without the spaces around it. Specials count once, also in raw spelling only."""
        if self.special is not None and self.special.search(cut):
            parts = self.special.split(cut)
            return len(parts) // 2 + sum(map(self._count_plain, parts[::2]))
        return self._count_plain(cut)

    def _count_plain(self, text: str) -> int:
        # Lower case goes by single characters, so a final sigma is not special.
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        memo, total = self.pieces, 0
        for piece in self.pattern.findall(text):
            got = memo.get(piece)
            if got is None:
                if len(memo) >= MEMO_PIECES:
                    memo.clear()
                got = memo[piece] = self.count_piece(piece)
            total += got
        return total

    def count(self, text: str | None) -> int:
        """White space is dropped, so spaces and line ends cut a text, and cuts repeat."""
        if not text:
            return 0
        cuts = text.replace("\n", " ").split(" ")
        memo = self.cuts
        got = list(map(memo.get, cuts))
        if None in got:
            for k, n in enumerate(got):
                if n is None:
                    if len(memo) >= MEMO_CUTS:
                        memo.clear()
                    got[k] = memo[cuts[k]] = self.count_cut(cuts[k])
        return sum(got)


@functools.lru_cache(maxsize=2)
def counter(path: str) -> WordBpeCounter:
    return WordBpeCounter(path)


def count_tokens(
    docs: DataFrame, tokenizer: str, limit: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of each whole text, for a tokenizer file that all workers can read.

    Counts are those of the tokenizers library without added special tokens. A missing or empty text
    has 0 bytes and 0 tokens. Rows are independent: repeated ids and texts give repeated rows, an empty
    table an empty one; other columns of the input, whatever their names, are left behind.
    """

    def start():
        words = counter(tokenizer)

        def work(texts):
            sizes = [len(t.encode("utf-8")) if t else 0 for t in texts]
            return [pa.array(sizes, pa.int64()), pa.array(np.fromiter(map(words.count, texts), np.int64, len(texts)))]

        return work

    fields = [StructField("n_bytes", LongType()), StructField("n_tokens", LongType())]
    counted = map_texts(docs, id_col, text_col, fields, start)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
