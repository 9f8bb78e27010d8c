"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

Every prefix of a piece of text has exactly one encoding, so exactly one last token. A suffix-matching
automaton over all tokens gives, for each prefix, the tokens it ends with, from the longest down. Of these, the last
token is the one that is compatible with the last token of what remains before it: no merge would
ever join something across their border. Back-pointers from the end then give the exact ids, with
no merge ever carried out on the text.

Texts are cut into pieces by the pattern of the tokenizer first; pieces repeat, so each worker keeps
memos of them, bounded in bytes. Decoding needs the tokens' bytes only, so its workers hold no automaton.
"""

from __future__ import annotations

import functools
import json
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from featurevote.llm.common import byte_level_pieces, map_texts, packed_lists

# Bytes that a worker keeps at most in the memo of pieces, and entries in those of pairs and of
# steps along failure links; a full memo starts anew. What is longer than LONG is not kept.
# Smaller memos take more time, as invented words come back: see the README for both figures.
MEMO_BYTES = 144 << 20
ENTRY_BYTES = 200
MEMO_PAIRS = 200_000
MEMO_STEPS = 100_000
LONG = 64
NEVER = 1 << 60


def byte_characters() -> list[str]:
    """The character that stands for each byte in vocabulary files: itself if it is visible, else
    the next one from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b if b in visible else next(hidden)) for b in range(256)]


def special_pattern(added: list[dict]) -> regex.Pattern | None:
    """Matches the strings that become one added token wherever they stand in a text."""
    for token in added:
        if any(token[flag] for flag in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"added token {token['content']} has options that are not supported")
    found = sorted((t["content"] for t in added), key=len, reverse=True)
    return regex.compile("(" + "|".join(map(regex.escape, found)) + ")") if found else None


class ByteBpe:
    """A byte-level vocabulary with merges, from a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"]:
            raise ValueError("needs a byte-level BPE file without normalizer and prefix space")
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        vocab = {t: bytes(byte_of[c] for c in t) for t in model["vocab"]}
        ids = model["vocab"]
        self.size = 1 + max([*ids.values(), *(t["id"] for t in spec["added_tokens"])])
        self.bytes_of = [b""] * self.size
        for token, raw in vocab.items():
            self.bytes_of[ids[token]] = raw
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, number in self.specials.items():
            self.bytes_of[number] = token.encode()
        self.special = special_pattern(spec["added_tokens"])
        self.rank = [-1] * self.size
        self.left, self.right = [0] * self.size, [0] * self.size
        self.pair_rank: dict[int, int] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            whole, a, b = ids[a + b], ids[a], ids[b]
            self.pair_rank[a * self.size + b] = rank
            if self.rank[whole] < 0:
                self.rank[whole], self.left[whole], self.right[whole] = rank, a, b
        usable = [ids[t] for t, raw in vocab.items() if len(raw) == 1 or self._reachable(ids[t])]
        self._build_automaton(usable)
        self.pairs: dict[int, bool] = {}
        self.cuts: dict[str, bytes] = {}
        self.held = 0

    def _build_automaton(self, tokens: list[int]) -> None:
        """States are the prefixes of tokens; `longest` has the longest token that a state ends with,
        `shorter` the next shorter token that a token ends with."""
        self.step: dict[int, int] = {}
        self.far: dict[int, int] = {}
        own, parents = [-1], []
        node_of = {}
        for token in tokens:
            node = 0
            for byte in self.bytes_of[token]:
                key = node << 8 | byte
                after = self.step.get(key)
                if after is None:
                    after = self.step[key] = len(own)
                    own.append(-1)
                    parents.append(key)
                node = after
            own[node], node_of[token] = token, node
        depth = [0] * len(own)
        for k, key in enumerate(parents, 1):
            depth[k] = depth[key >> 8] + 1
        self.fail, self.longest = [0] * len(own), own
        for k in sorted(range(1, len(own)), key=depth.__getitem__):
            key = parents[k - 1]
            if key >> 8:
                self.fail[k] = self._fail_of(key)
            if own[k] < 0:
                own[k] = own[self.fail[k]]
        self.length = list(map(len, self.bytes_of))
        self.shorter = [-1] * self.size
        for token, node in node_of.items():
            self.shorter[token] = own[self.fail[node]]

    def _fail_of(self, key: int) -> int:
        """The failure link of the state that `key`, a state and a byte, leads to; shorter ones are known."""
        state, byte = self.fail[key >> 8], key & 255
        after = self.step.get(state << 8 | byte)
        while after is None and state:
            state = self.fail[state]
            after = self.step.get(state << 8 | byte)
        return after or 0

    def _next(self, state: int, byte: int) -> int:
        """Where a byte leads that does not go on from a state: along the failure links."""
        key, after = state << 8 | byte, None
        while after is None and state:
            state = self.fail[state]
            after = self.step.get(state << 8 | byte)
        if len(self.far) >= MEMO_STEPS:
            self.far.clear()
        after = self.far[key] = after or 0
        return after

    def _reachable(self, token: int) -> bool:
        """Whether the merges turn a token's own bytes into that token: undone step by step, no
        border of its parts may be crossed before the merge that joins them."""
        todo = [token]
        while todo:
            t = todo.pop()
            if self.rank[t] >= 0:
                a, b = self.left[t], self.right[t]
                if not self._compatible(a, b, self.rank[t]):
                    return False
                todo += (a, b)
        return True

    def _compatible(self, a: int, b: int, until: int = NEVER) -> bool:
        """Whether no merge of a rank below `until` joins the end of token `a` with the start of `b`.

        Walks back in time: the later formed of the two edge symbols is undone again and again. At
        each state, a merge of the edge symbols would have come first if its rank is lower than the
        next merge at either edge (on a tie the place further left comes first).
        """
        next_a = next_b = until
        rank, size, pair_rank = self.rank, self.size, self.pair_rank
        while True:
            joined = pair_rank.get(a * size + b)
            if joined is not None and joined < next_a and joined <= next_b and joined < until:
                return False
            if rank[a] > rank[b]:
                next_a, a = rank[a], self.right[a]
            elif rank[b] >= 0:
                next_b, b = rank[b], self.left[b]
            else:
                return True

    def encode_piece(self, piece: str) -> list[int]:
        raw = piece.encode("utf-8")
        last = [0] * (len(raw) + 1)
        pairs, size, longest, length = self.pairs, self.size, self.longest, self.length
        step, far = self.step, self.far
        state = 0
        for end, byte in enumerate(raw, 1):
            key = state << 8 | byte
            after = step.get(key)
            if after is None:
                after = far.get(key)
            state = self._next(state, byte) if after is None else after
            token = longest[state]
            while begin := end - length[token]:
                pair = last[begin] * size + token
                fits = pairs.get(pair)
                if fits is None:
                    if len(pairs) >= MEMO_PAIRS:
                        pairs.clear()
                    fits = pairs[pair] = self._compatible(last[begin], token)
                if fits:
                    break
                token = self.shorter[token]
            last[end] = token
        ids, at = [], len(raw)
        while at:
            ids.append(last[at])
            at -= length[last[at]]
        ids.reverse()
        return ids

    def encode(self, text: str | None) -> bytes:
        """The ids as packed 32-bit integers."""
        if not text:
            return b""
        if self.special is not None and self.special.search(text):
            parts = enumerate(self.special.split(text))
            return b"".join(np.int32(self.specials[p]).tobytes() if k % 2 else self._encode(p) for k, p in parts)
        return self._encode(text)

    def _encode(self, text: str) -> bytes:
        """Pieces are looked up, and only new ones are encoded. A memo of whole words with the marks
        around them would hold each word several times and meet new ones twice as often."""
        pieces = byte_level_pieces(text)
        got = list(map(self.cuts.get, pieces))
        if None in got:
            new = {p for p, ids in zip(pieces, got, strict=True) if ids is None}
            fresh = {p: array("i", self.encode_piece(p)).tobytes() for p in new}
            got = [fresh[p] if ids is None else ids for p, ids in zip(pieces, got, strict=True)]
            for piece, ids in fresh.items():
                self._keep(piece, ids)
        return b"".join(got)

    def _keep(self, piece: str, ids: bytes) -> None:
        if len(piece) > LONG:
            return
        if self.held >= MEMO_BYTES:
            self.cuts.clear()
            self.held = 0
        self.cuts[piece] = ids
        self.held += len(piece) + len(ids) + ENTRY_BYTES


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> ByteBpe:
    return ByteBpe(path)


@functools.lru_cache(maxsize=2)
def token_bytes(path: str) -> list[bytes]:
    """The bytes of each token by its id, added tokens included."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    byte_of = {c: b for b, c in enumerate(byte_characters())}
    raw = {i: bytes(byte_of[c] for c in t) for t, i in spec["model"]["vocab"].items()}
    raw.update({t["id"]: t["content"].encode() for t in spec["added_tokens"]})
    return [raw.get(i, b"") for i in range(1 + max(raw))]


def decoded(ids: np.ndarray, raw: list[bytes]) -> str:
    return b"".join(map(raw.__getitem__, ids.tolist())).decode("utf-8", errors="replace")


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of each document's whole text, for a tokenizer file that all workers can read.

    Ids are those of the tokenizers library without added special tokens; special strings that stand
    in a text become their own id. A missing or empty text has no ids. Rows are independent: repeated
    ids and texts give repeated rows, an empty table gives an empty one, and other columns of the
    input, whatever their names, are left behind.
    """

    def start():
        bpe = vocabulary(tokenizer)
        return lambda texts: [packed_lists([bpe.encode(t) for t in texts])]

    return map_texts(docs, id_col, text_col, [StructField("ids", ArrayType(IntegerType(), False))], start)


def decode(
    tokens: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids", keep_ids: bool = True
) -> DataFrame:
    """(id, ids, text) of token ids; missing ids give an empty text, ids outside the vocabulary fail."""
    slim = tokens.select(id_col, F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids"))
    schema = StructType([*slim.schema.fields, StructField("text", StringType())])

    def run(batches):
        raw = token_bytes(tokenizer)
        for batch in batches:
            column = batch.column(1)
            ends, flat = np.asarray(column.offsets), np.asarray(column.values)
            # One document after the other, as ids take ten times the space once they are Python's.
            texts = [decoded(flat[a:b], raw) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema.names)

    out = slim.mapInArrow(run, schema)
    return out if keep_ids else out.drop("ids")


def tokens_of(text: Column, tokenizer: str) -> Column:
    """(ids, round_trip) of a text column, for rows whose other columns stay where they are: the ids of
    :func:`encode`, and whether decoding them gives the text again, a missing text being an empty one."""
    kind = StructType([StructField("ids", ArrayType(IntegerType(), False)), StructField("round_trip", BooleanType())])

    @F.arrow_udf(kind)
    def run(texts: pa.Array) -> pa.Array:
        bpe, raw = vocabulary(tokenizer), token_bytes(tokenizer)
        rows, same = [], []
        for scalar in texts:
            own = scalar.as_py() or ""
            rows.append(bpe.encode(own))
            same.append(decoded(np.frombuffer(rows[-1], dtype=np.int32), raw) == own)
        return pa.StructArray.from_arrays([packed_lists(rows), pa.array(same, pa.bool_())], ["ids", "round_trip"])

    return run(text.cast("string"))
