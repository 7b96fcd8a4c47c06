"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.
A word's likelihood is the sum over all its segmentations into pieces, which a
forward pass adds up; a text's likelihood is the product over its words. The
probabilities are fitted by expectation maximisation to word counts of a
bounded sample of labelled rows.

A word is a run of letters, lower-cased, with the vocabulary's word mark before
it; a run of over 32 letters counts as several words. Within a batch each
distinct word is scored once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineseek.llm.tokens import portions, slices
from lineseek.llm.work import tidy

MARK = "▁"
LONGEST_PIECE, LONGEST_WORD = 10, 32
SAMPLE_PER_LANGUAGE, EM_ROUNDS = 300, 4
UNKNOWN = 1e-7  # probability of a letter outside the vocabulary, in any language
SMOOTHING = 0.05
CACHED_WORDS = 150_000
UNDETERMINED = "und"
BASE, MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
TABLE_BITS = 18


def default_pieces() -> list[str]:
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    found = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    plain = {p for p in found if p.replace(MARK, "").isalpha() and p == p.lower() and MARK not in p[1:]}
    return sorted(p for p in plain | {MARK} if len(p) <= LONGEST_PIECE)


class PieceTable:
    """Numbers of pieces, found by the hash of their letters; 0 is no piece."""

    def __init__(self, pieces: list[str]):
        self.size = len(pieces) + 1
        self.keys = np.zeros((1 << TABLE_BITS) + 64, np.uint64)
        self.numbers = np.zeros(len(self.keys), np.int32)
        self.reach = 1
        for number, piece in enumerate(pieces, 1):
            key = np.uint64(0)
            with np.errstate(over="ignore"):
                for letter in piece:
                    key = key * BASE + np.uint64(ord(letter) + 1)
                slot = home = int((key * MIX) >> np.uint64(64 - TABLE_BITS))
            while self.numbers[slot]:
                slot += 1
            self.keys[slot], self.numbers[slot] = key, number
            self.reach = max(self.reach, slot - home + 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        home = ((keys * MIX) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        found = np.where(self.keys[home] == keys, self.numbers[home], 0)
        for ahead in range(1, self.reach):
            missing = np.flatnonzero(found == 0)
            slot = home.flat[missing] + ahead
            found.flat[missing] = np.where(self.keys[slot] == keys.flat[missing], self.numbers[slot], 0)
        return found

    def spans(self, words: np.ndarray) -> list[np.ndarray]:
        """``words``: code points, a row per word of one length. At i of the
        result: the piece numbers of all spans of i + 1 letters, by start."""
        keys, found = np.zeros(words.shape, np.uint64), []
        letters = words.astype(np.uint64) + np.uint64(1)
        for size in range(1, min(LONGEST_PIECE, words.shape[1]) + 1):
            starts = words.shape[1] - size + 1
            keys = keys[:, :starts] * BASE + letters[:, size - 1 :]
            found.append(self.find(keys))
        return found


def by_length(words: list[str], most: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of words of one length, and their code points with the mark in front."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for size in np.unique(sizes):
        for places in np.array_split(np.flatnonzero(sizes == size), -(-int((sizes == size).sum()) // most)):
            text = "".join(MARK + words[i] for i in places)
            yield places, np.frombuffer(text.encode("utf-32-le"), np.uint32).reshape(len(places), size + 1)


def forward(spans: list[np.ndarray], probabilities: np.ndarray) -> np.ndarray:
    """Likelihood up to every letter, summed over segmentations: (words, letters + 1, languages)."""
    words, letters = spans[0].shape
    upto = np.zeros((words, letters + 1, probabilities.shape[1]))
    upto[:, 0] = 1.0
    for end in range(1, letters + 1):
        for size in range(1, min(end, len(spans)) + 1):
            number = spans[size - 1][:, end - size]
            chance = probabilities[number]
            if size == 1:
                chance = np.where((number == 0)[:, None], UNKNOWN, chance)
            upto[:, end] += upto[:, end - size] * chance
    return upto


def expected_counts(spans: list[np.ndarray], probabilities: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Expected uses of each piece: ``probabilities`` (pieces), ``weights`` per word."""
    ahead = forward(spans, probabilities[:, None])[:, :, 0]
    words, letters = spans[0].shape
    after = np.zeros((words, letters + 1))
    after[:, letters] = 1.0
    for start in range(letters - 1, -1, -1):
        for size in range(1, min(letters - start, len(spans)) + 1):
            number = spans[size - 1][:, start]
            chance = np.where((number == 0) & (size == 1), UNKNOWN, probabilities[number])
            after[:, start] += chance * after[:, start + size]
    scale = weights / ahead[:, letters]
    counts = np.zeros(len(probabilities))
    for size, numbers in enumerate(spans, 1):
        used = ahead[:, : letters - size + 1] * probabilities[numbers] * after[:, size:] * scale[:, None]
        counts += np.bincount(numbers.ravel(), used.ravel(), len(probabilities))
    counts[0] = 0
    return counts


@dataclass(frozen=True)
class LanguageModel:
    pieces: list[str]
    languages: list[str]
    probabilities: np.ndarray  # (pieces + 1, languages); row 0 is no piece

    def word_scores(self, table: PieceTable, words: list[str]) -> np.ndarray:
        """Log likelihood of each word in each language."""
        scores = np.zeros((len(words), len(self.languages)))
        for places, letters in by_length(words):
            scores[places] = np.log(forward(table.spans(letters), self.probabilities)[:, -1])
        return scores


def letter_runs(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}{1,%d}" % LONGEST_WORD), F.lit(0))


def sample_words(labelled: DataFrame, *, per_language: int) -> DataFrame:
    """``lang, word, count`` of the sample: all words of the ``per_language`` rows of
    each language with the smallest hash of their id.

    What is sent to all tasks is a count and the ``per_language`` sampled ids of each
    language, less than the model's own column of probabilities for it.
    """
    # by its language's count, a row whose hash is too large to be chosen is left out before anything is ordered
    counts = labelled.groupBy(F.col("lang").alias("counted")).count()
    wanted = F.least(F.lit(1.0), F.lit(2.0 * per_language + 50) / F.col("count"))
    place_of = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    near = labelled.select("id", "lang").join(F.broadcast(counts), F.col("lang") == F.col("counted")).where(place_of < wanted)
    order = [F.pmod(F.xxhash64("id"), F.lit(1 << 30)), F.col("id")]
    place = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    chosen = near.select("id", "lang").distinct().withColumn("place", place).where(F.col("place") <= per_language)
    texts = labelled.join(F.broadcast(chosen.select("id", "lang")), ["id", "lang"], "left_semi")
    return texts.select("lang", F.explode(letter_runs(F.col("text"))).alias("word")).groupBy("lang", "word").count()


def fit(
    labelled: DataFrame,
    *,
    pieces: list[str] | None = None,
    per_language: int = SAMPLE_PER_LANGUAGE,
    rounds: int = EM_ROUNDS,
) -> LanguageModel:
    """Fit on ``labelled`` (id, lang, text), of which a bounded sample is used:
    at most ``per_language`` rows of each language, with all their words. The order in
    which words are added up is fixed, so the same rows give the same model."""
    pieces = pieces or default_pieces()
    table = PieceTable(pieces)
    rows = sorted(sample_words(labelled, per_language=per_language).collect())
    languages = sorted({row["lang"] for row in rows})
    probabilities = np.zeros((table.size, len(languages)))
    for column, language in enumerate(languages):
        mine = [row for row in rows if row["lang"] == language]
        words, weights = [row["word"] for row in mine], np.array([row["count"] for row in mine], float)
        groups = [(table.spans(letters), weights[places]) for places, letters in by_length(words)]
        current = np.full(table.size, 1.0 / (table.size - 1))
        current[0] = 0.0  # what is no piece has no probability, from the first round on
        for _ in range(rounds):
            counts = sum(expected_counts(spans, current, held) for spans, held in groups) + SMOOTHING
            counts[0] = 0.0
            current = counts / counts.sum()
            current[0] = 0.0
        probabilities[:, column] = current
    return LanguageModel(pieces, languages, probabilities)


class Scorer:
    """Predictions for batches of texts; words scored before are remembered, up to a bound."""

    def __init__(self, model: LanguageModel):
        self.model, self.table = model, PieceTable(model.pieces)
        self.names = pa.array([*model.languages, UNDETERMINED])
        self.known: dict[str, int] = {}
        self.scores = np.zeros((0, len(model.languages)))

    def _places(self, words: list[str]) -> np.ndarray:
        missing = [word for word in words if word not in self.known]
        if len(self.known) + len(missing) > CACHED_WORDS:
            self.known, self.scores, missing = {}, self.scores[:0], words
        self.known.update(zip(missing, range(len(self.known), len(self.known) + len(missing)), strict=True))
        fresh = self.model.word_scores(self.table, missing)
        fresh[[place for place, word in enumerate(missing) if not word]] = 0.0
        self.scores = np.concatenate([self.scores, fresh])
        return np.fromiter((self.known[word] for word in words), np.int64, len(words))

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lowered = pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\p{L}]+", " ")
        lowered = pc.replace_substring_regex(lowered, r"(\p{L}{%d})" % LONGEST_WORD, r"\1 ")
        words = pc.ascii_split_whitespace(lowered)
        bounds = words.offsets.to_numpy().astype(np.int64)
        bounds -= bounds[0]
        coded = words.flatten().dictionary_encode()
        listed, use = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        places = self._places(listed)
        each = self.scores[places][use]
        letters = np.array([bool(word) for word in listed], bool)[use]
        upto = np.concatenate([np.zeros((1, each.shape[1])), np.cumsum(each, axis=0)])
        held = np.concatenate([[0], np.cumsum(letters)])
        none = held[bounds[1:]] == held[bounds[:-1]]
        if not self.model.languages:
            return np.zeros(len(texts), np.int64), np.zeros(len(texts))
        total = upto[bounds[1:]] - upto[bounds[:-1]]
        chance = 1.0 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        best = np.where(none, len(self.model.languages), total.argmax(axis=1))
        return best, np.where(none, 0.0, chance)

    def __call__(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The language of each text, and its posterior probability under equal priors."""
        found = [self._slice(part) for part in slices(texts.fill_null(""))]
        best = np.concatenate([np.zeros(0, np.int64), *(best for best, _ in found)])
        return self.names.take(pa.array(best)), np.concatenate([np.zeros(0), *(chance for _, chance in found)])


def predict(
    documents: DataFrame, model: LanguageModel, *, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id_col, lang_pred, score`` for every row.

    ``score`` is the posterior probability of ``lang_pred`` under equal priors.
    Ties go to the alphabetically first language. Null texts and texts without
    a letter, and all texts if no language was learned, get ``und`` and 0.
    Whole texts are scored, whatever their length. Repeated rows are scored
    each. Other columns don't matter. An empty table gives no rows.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in portions(batches, 1):
            names, chances = scorer(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), names, pa.array(chances)], ["id", "lang_pred", "score"])

    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double"
    return rows.mapInArrow(tidy(score), schema).withColumnRenamed("id", id_col)


def keep_identified(
    documents: DataFrame, model: LanguageModel, *, text_col: str = "text", least_score: float = 0.5
) -> DataFrame:
    """The rows of ``documents`` with a language and a score of at least
    ``least_score``, all columns as they were. No row is moved."""

    documents_columns = documents.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        column = documents_columns.index(text_col)
        for batch in portions(batches, column):
            names, chances = scorer(batch.column(column))
            known = pc.not_equal(names, UNDETERMINED).to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(known & (chances >= least_score)))

    return documents.mapInArrow(tidy(keep), documents.schema)


def fold(identity: Column) -> Column:
    """crc32 of the id's text mod 5; null for a null id."""
    return F.pmod(F.crc32(identity.cast("string").cast("binary")), F.lit(5))


def fit_labelled(
    documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **bounds
) -> LanguageModel:
    """:func:`fit` on the rows with a label outside fold 0; a null id is in no fold and not learned from."""
    rows = documents.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    return fit(rows.where((fold(F.col("id")) != 0) & F.col("lang").isNotNull()), **bounds)


def identify_held_out(
    documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **bounds
) -> DataFrame:
    """``id_col, held_out, lang_pred, score``: learned from labelled rows outside
    fold 0, predicted for all. A null id is not held out."""
    model = fit_labelled(documents, id_col=id_col, text_col=text_col, lang_col=lang_col, **bounds)
    held_out = F.coalesce(fold(F.col(id_col)) == 0, F.lit(False))
    return predict(documents, model, id_col=id_col, text_col=text_col).select(
        id_col, held_out.alias("held_out"), "lang_pred", "score"
    )
