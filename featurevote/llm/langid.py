"""Language of a text from unigram piece models, summed over all segmentations.

Each language has a probability for every piece of one fixed public vocabulary. The probability of a
word is the sum over all ways to cut it into pieces, found by a forward pass; pieces never reach over
white space, so a text's probability is the product over its words. The piece probabilities are fitted
by expectation-maximisation on word counts, each round one Spark job.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain, groupby, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from featurevote.llm.common import map_texts, slices, written

SAMPLE_DOCS = 300
ROUNDS = 3
SMOOTHING = 0.05
UNKNOWN = 1e-9
# Bytes of words that a worker keeps at most; a full memo starts anew.
MEMO_BYTES = 64 << 20
ENTRY_BYTES = 200
BLOCK_CHARS = 1 << 20
# Words of one length that take the forward pass together; longer or fewer ones take it one by one.
TOGETHER, FEW_WORDS, LONG_WORD = 4096, 32, 64
WORD_START = "▁"


def vocabulary_pieces(path: str) -> list[str]:
    """The pieces of a sentencepiece model that stand for text."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    usable = (i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return [model.id_to_piece(i) for i in usable]


def _lattice(word: str, known, longest: int) -> list[list[tuple[int, str | None]]]:
    """For each end in the marked word, the pieces that end there with their start; a single character
    that is no piece is an unknown one."""
    marked = WORD_START + word
    ends = []
    for end in range(1, len(marked) + 1):
        cuts = [(b, marked[b:end]) for b in range(max(0, end - longest), end) if marked[b:end] in known]
        if not cuts or cuts[-1][0] != end - 1:
            cuts.append((end - 1, None))
        ends.append(cuts)
    return ends


def expected_pieces(word: str, chances: dict[str, float], longest: int) -> dict[str, float]:
    """How often each piece occurs in a word on average over its segmentations (forward and backward)."""
    ends = _lattice(word, chances, longest)
    forward = [1.0]
    for cuts in ends:
        forward.append(sum(forward[b] * (UNKNOWN if p is None else chances[p]) for b, p in cuts))
    backward = [0.0] * len(forward)
    backward[-1] = 1.0
    for end in range(len(ends), 0, -1):
        for b, p in ends[end - 1]:
            backward[b] += backward[end] * (UNKNOWN if p is None else chances[p])
    if forward[-1] < 1e-250:
        return _expected_by_logs(ends, chances)
    found: dict[str, float] = {}
    for end, cuts in enumerate(ends, 1):
        for b, p in cuts:
            if p is not None:
                found[p] = found.get(p, 0.0) + forward[b] * chances[p] * backward[end] / forward[-1]
    return found


def _log_sum(logs: list[float]) -> float:
    top = max(logs)
    return top + math.log(sum(math.exp(x - top) for x in logs))


def _expected_by_logs(ends: list[list[tuple[int, str | None]]], chances: dict[str, float]) -> dict[str, float]:
    """The same for words too improbable for floating point, as those of many unknown characters."""
    log = {p: math.log(UNKNOWN if p is None else chances[p]) for cuts in ends for _, p in cuts}
    forward = [0.0]
    for cuts in ends:
        forward.append(_log_sum([forward[b] + log[p] for b, p in cuts]))
    onward: list[list[float]] = [[] for _ in forward]
    backward = [0.0] * len(forward)
    for end in range(len(ends), 0, -1):
        if end < len(ends):
            backward[end] = _log_sum(onward[end]) if onward[end] else -math.inf
        for b, p in ends[end - 1]:
            onward[b].append(backward[end] + log[p])
    found: dict[str, float] = {}
    for end, cuts in enumerate(ends, 1):
        for b, p in cuts:
            if p is not None:
                found[p] = found.get(p, 0.0) + math.exp(forward[b] + log[p] + backward[end] - forward[-1])
    return found


class LanguageModel:
    """Piece probabilities by language; `rows` has one tuple for each piece."""

    def __init__(self, languages: list[str], rows: dict[str, tuple[float, ...]]):
        self.languages, self.rows = languages, rows
        self.longest = max(map(len, rows), default=1)
        # Row 0 stands for no piece, row 1 for an unknown character.
        count = len(languages)
        self.table = np.array([[0.0] * count, [UNKNOWN] * count, *rows.values()])
        # Row 0 also stands for what only begins a piece; nothing else needs to be looked up any further.
        self.place = {p[:k]: 0 for p in rows for k in range(1, len(p))}
        self.place.update({p: k for k, p in enumerate(rows, 2)})

    def word(self, word: str) -> list[float]:
        """Log probability of a word in each language."""
        marked, rows, longest = WORD_START + word, self.rows, self.longest
        count = len(self.languages)
        sums, offset = [[1.0] * count], 0.0
        for end in range(1, len(marked) + 1):
            total = [0.0] * count
            for b in range(max(0, end - longest), end):
                row = rows.get(marked[b:end])
                if row is not None:
                    total = [t + x * y for t, x, y in zip(total, sums[b], row, strict=True)]
                elif b == end - 1:
                    total = [t + x * UNKNOWN for t, x in zip(total, sums[b], strict=True)]
            sums.append(total)
            if max(total) < 1e-120:
                offset -= 120 * math.log(10)
                for b in range(max(0, end + 1 - longest), end + 1):
                    sums[b] = [x * 1e120 for x in sums[b]]
        return [math.log(max(x, 1e-300)) + offset for x in sums[-1]]

    def words(self, words: list[str]) -> np.ndarray:
        """The same for many words of one length, all of them one character further at a time."""
        marked = [WORD_START + w for w in words]
        size, find = len(marked[0]), self.place.get
        sums = np.zeros((size + 1, len(words), len(self.languages)))
        sums[0] = 1.0
        offset = np.zeros((len(words), 1))
        for start in range(size):
            # All pieces that end here have been added, so the sums of this place are whole.
            low = np.flatnonzero(sums[start].max(axis=1) < 1e-120)
            if len(low):
                offset[low] -= 120 * math.log(10)
                sums[start:, low] *= 1e120
            here, active = sums[start], np.arange(len(words))
            for end in range(start + 1, min(size, start + self.longest) + 1):
                parts = [marked[k][start:end] for k in active.tolist()]
                places = np.fromiter(map(find, parts, repeat(-1)), np.int64, len(parts))
                if end == start + 1:
                    sums[end] += here * self.table[np.where(places > 1, places, 1)]
                else:
                    hit = places > 1
                    sums[end, active[hit]] += here[active[hit]] * self.table[places[hit]]
                active = active[places >= 0]
                if not len(active):
                    break
        return np.log(np.maximum(sums[-1], 1e-300)) + offset


class Scorer:
    """A model with a bounded memo of words. Texts are judged in blocks, so that many new words meet the
    forward pass together."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self.places: dict[str, int] = {}
        self.held = 0
        self.known = np.zeros((1024, len(model.languages)))

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float]]:
        found: list[tuple[str, float]] = []
        start, held = 0, 0
        for k, text in enumerate(texts, 1):
            held += len(text or "")
            if held >= BLOCK_CHARS or k == len(texts):
                found += self._judge(texts[start:k])
                start, held = k, 0
        return found

    def _judge(self, texts: list[str | None]) -> list[tuple[str, float]]:
        languages = self.model.languages
        split = [t.split() if t and languages and any(map(str.isalpha, t)) else [] for t in texts]
        words = set(chain.from_iterable(split))
        new = words.difference(self.places)
        if self.held >= MEMO_BYTES:
            self.places, self.known, self.held, new = {}, self.known[:1024], 0, words
        self.held += sum(map(len, new)) + ENTRY_BYTES * len(new)
        self._learn(list(new))
        found = []
        for text in split:
            if not text:
                found.append(("und", 0.0))
                continue
            total = self.known[list(map(self.places.__getitem__, text))].sum(axis=0)
            chances = np.exp(total - total.max())
            best = int(np.argmax(total))
            found.append((languages[best], float(chances[best] / chances.sum())))
        return found

    def _learn(self, words: list[str]) -> None:
        first = len(self.places)
        room = first + len(words) - len(self.known)
        if room > 0:
            more = np.zeros((max(room, len(self.known)), self.known.shape[1]))
            self.known = np.concatenate([self.known, more])
        words.sort(key=len)
        for length, group in groupby(words, key=len):
            alike = list(group)
            for k in range(0, len(alike), TOGETHER):
                part = alike[k : k + TOGETHER]
                if length > LONG_WORD or len(part) < FEW_WORDS:
                    rows = list(map(self.model.word, part))
                else:
                    rows = self.model.words(part)
                self.known[first : first + len(part)] = rows
                self.places.update(zip(part, range(first, first + len(part)), strict=True))
                first += len(part)


def train(
    labelled: DataFrame,
    vocabulary: str,
    key_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    sample_docs: int = SAMPLE_DOCS,
    rounds: int = ROUNDS,
) -> LanguageModel:
    """Fit piece probabilities to about `sample_docs` whole documents of each language, drawn by a hash
    of key and text; rows without text or language are left out. No labelled rows give an empty model.

    Driver and workers hold one number for each piece and language.
    """
    rows = labelled.select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.xxhash64(key_col, text_col).alias("draw")
    ).where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], {})
    share = F.lit(0.0)
    for lang in languages:
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, sample_docs / sizes[lang]))).otherwise(share)
    drawn = rows.where(F.pmod("draw", F.lit(1 << 20)) < share * (1 << 20))
    words = drawn.select("lang", F.explode(F.split("text", r"\s+")).alias("word")).where("word <> ''")
    counts = written(words.groupBy("lang", "word").agg(F.count("*").alias("n")))

    pieces = vocabulary_pieces(vocabulary)
    longest = max(map(len, pieces))
    chances = {lang: dict.fromkeys(pieces, 1.0 / len(pieces)) for lang in languages}
    for _ in range(rounds):
        sums = counts.mapInArrow(_expectation(chances, longest), "lang string, piece string, n double")
        found = sums.groupBy("lang", "piece").agg(F.sum("n").alias("n")).collect()
        updated = {lang: dict.fromkeys(pieces, SMOOTHING) for lang in languages}
        for r in found:
            updated[r["lang"]][r["piece"]] += r["n"]
        for lang, own in updated.items():
            total = sum(own.values())
            chances[lang] = {p: n / total for p, n in own.items()}
    return LanguageModel(languages, {p: tuple(chances[lang][p] for lang in languages) for p in pieces})


def _expectation(chances: dict[str, dict[str, float]], longest: int):
    def run(batches):
        sums: dict[tuple[str, str], float] = {}
        for batch in batches:
            for lang, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for piece, share in expected_pieces(word, chances[lang], longest).items():
                    sums[lang, piece] = sums.get((lang, piece), 0.0) + n * share
        keys = list(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(sums.values()), pa.float64())],
            names=["lang", "piece", "n"],
        )

    return run


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every whole text; the score is the posterior probability of the
    language with equal priors. `und` with score 0 for a missing text, one without a letter, and an empty
    model; ties go to the first language in order. Repeated rows are judged alike, an empty table
    gives no rows, and other columns are left behind.
    """
    start = _starter(docs.sparkSession, model)

    def begin():
        scorer = start()

        def work(texts):
            found = scorer(texts)
            return [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]

        return work

    return map_texts(docs, id_col, text_col, JUDGEMENT, begin)


JUDGEMENT = [StructField("lang_pred", StringType()), StructField("score", DoubleType())]


def _starter(spark: SparkSession, model: LanguageModel):
    shared = spark.sparkContext.broadcast((model.languages, model.rows))
    return lambda: Scorer(LanguageModel(*shared.value))


def judgement(spark: SparkSession, text: Column, model: LanguageModel) -> Column:
    """(lang_pred, score) of a text column as :func:`predict` gives them, for rows whose other columns stay
    where they are."""
    start = _starter(spark, model)

    @F.arrow_udf(StructType(JUDGEMENT))
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = start()
        for texts in batches:
            found = [f for part in slices(pa.record_batch([texts], ["text"]), 0) for f in scorer(part.column(0).to_pylist())]
            columns = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.StructArray.from_arrays(columns, ["lang_pred", "score"])

    return judge(text.cast("string"))
