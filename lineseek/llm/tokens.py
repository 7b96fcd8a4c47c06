"""Token ids by a public tokenizer of the ``tokenizers`` library, word by word.

The tokenizer drops white space and never merges across it, so a text's ids are
its words' ids in order. Within a batch each distinct word is encoded once and
its ids are copied with NumPy; a bounded cache keeps them between batches.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lineseek.llm.work import release

LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"  # one run of these is one word to the tokenizer, whatever stands around it
CACHED_WORDS = 250_000
SLICE_BYTES = 2 << 20
WORDS_PER_CALL = 2000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """``texts`` in runs of about ``limit`` bytes; a longer text stands alone."""
    sizes = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
    groups = np.cumsum(sizes) // limit
    bounds = np.flatnonzero(np.diff(groups, prepend=-1))
    for start, end in zip(bounds, [*bounds[1:], len(texts)], strict=True):
        yield texts.slice(start, end - start)


def portions(batches: Iterator[pa.RecordBatch], column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in batches of about ``limit`` bytes of text in ``column``."""
    for batch in batches:
        done = 0
        for texts in slices(batch.column(column), limit):
            yield batch.slice(done, len(texts))
            done += len(texts)


class WordEncoder:
    """``encode`` gives what ``Tokenizer.encode(text, add_special_tokens=False)`` gives."""

    def __init__(self, path: str, cached_words: int | None = None):
        self.cached_words = CACHED_WORDS if cached_words is None else cached_words
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[place for word, place in vocabulary.items() if word.endswith("</w>")]] = True
        self._forget()
        del vocabulary
        release()  # reading the tokenizer's file leaves 60 MB behind

    def _forget(self) -> None:
        self.places: dict[str, int] = {}
        self.starts, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.met_again = np.zeros(0, bool)

    def _forget_rare(self) -> None:
        """Keep the words met again since they were noted, unless they fill half of the cache."""
        kept = np.flatnonzero(self.met_again)
        if len(kept) > self.cached_words // 2:
            return self._forget()
        words, numbers = list(self.places), np.fromiter(self.places.values(), np.int64, len(self.places))
        lengths = self.lengths[kept]
        upto = np.cumsum(lengths) - lengths
        self.ids = self.ids[np.repeat(self.starts[kept] - upto, lengths) + np.arange(int(lengths.sum()))]
        self.starts, self.lengths, self.met_again = upto, lengths, np.zeros(len(kept), bool)
        left = np.flatnonzero(np.isin(numbers, kept, assume_unique=True))
        moved = np.searchsorted(kept, numbers[left])
        self.places = {words[i]: place for i, place in zip(left.tolist(), moved.tolist(), strict=True)}
        return None

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and where each text begins among them (one bound more than texts)."""
        ids, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for part in slices(texts.fill_null("")):
            part_ids, part_counts = self._encode_slice(part)
            ids.append(part_ids)
            counts.append(part_counts)
        return np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int64)

    def _encode_slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        # the tokenizer lower-cases anyway, except within the names of special tokens
        texts = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        # full stops and commas after a word are words of their own; setting them apart leaves fewer distinct words
        texts = pc.replace_substring_regex(texts, rf"([{LETTERS}])([.,]+)([ \t\n\r\f\v]|$)", r"\1 \2\3")
        words = pc.ascii_split_whitespace(texts)
        bounds = words.offsets.to_numpy().astype(np.int64)
        coded = words.flatten().dictionary_encode()
        place = self._find(coded.dictionary)[coded.indices.to_numpy()]
        lengths, starts = self.lengths[place], self.starts[place]
        upto = np.concatenate([[0], np.cumsum(lengths)])
        source = np.repeat(starts - upto[:-1], lengths)
        source += np.arange(upto[-1])
        bounds = bounds - bounds[0]
        return self.ids[source], np.diff(upto[bounds])

    def _find(self, words: pa.Array) -> np.ndarray:
        listed = words.to_pylist()
        places = np.fromiter(map(self.places.get, listed, repeat(-1)), np.int64, len(listed))
        missing = np.flatnonzero(places < 0)
        if len(missing):
            if len(self.places) + len(missing) > self.cached_words:
                self._forget_rare()
                places = np.fromiter(map(self.places.get, listed, repeat(-1)), np.int64, len(listed))
                missing = np.flatnonzero(places < 0)
            self.met_again[places[places >= 0]] = True
            fresh = [listed[i] for i in missing]
            order, lengths, ids = self._encode_words(fresh)
            places[missing[order]] = np.arange(len(self.lengths), len(self.lengths) + len(order))
            self.places.update(zip(fresh, places[missing].tolist(), strict=True))
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.ids = np.concatenate([self.ids, ids])
            self.met_again = np.concatenate([self.met_again, np.zeros(len(lengths), bool)])
        return places

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """An order of ``words``, their numbers of ids and their ids in that order.

        Words of letters are encoded many at a time and told apart by their last ids.
        """
        plain = pc.match_substring_regex(pa.array(words, pa.string()), rf"^[{LETTERS}]+$").to_numpy(zero_copy_only=False)
        places, alone = np.flatnonzero(plain), list(np.flatnonzero(~plain))
        groups = [places[i : i + WORDS_PER_CALL] for i in range(0, len(places), WORDS_PER_CALL)]
        order, lengths, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        joined = [" ".join([words[i] for i in group]) for group in groups]
        for group, coded in zip(groups, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False), strict=True):
            found = np.array(coded.ids, np.uint32)
            ends = np.flatnonzero(self.ends_word[found]) + 1
            if len(ends) == len(group):
                order.append(group)
                lengths.append(np.diff(ends, prepend=0))
                ids.append(found)
            else:
                alone.extend(group)
        singles = self.tokenizer.encode_batch_fast([words[i] for i in alone], add_special_tokens=False)
        found = [coded.ids for coded in singles]
        order.append(np.array(alone, np.int64))
        lengths.append(np.fromiter(map(len, found), np.int64, len(found)))
        ids.append(np.fromiter(chain.from_iterable(found), np.uint32))
        return np.concatenate(order), np.concatenate(lengths), np.concatenate(ids)


_encoder: tuple[str, WordEncoder] | None = None


def shared_encoder(path: str, cached_words: int = CACHED_WORDS) -> WordEncoder:
    """The encoder of this worker process: it and its words serve all tasks that use ``path``.
    A word takes some 200 bytes."""
    global _encoder
    if _encoder is None or _encoder[0] != path:
        _encoder = path, WordEncoder(path)
    _encoder[1].cached_words = cached_words
    return _encoder[1]


def drop_shared_encoder() -> None:
    """Its memory goes back, for stages after this one that need theirs."""
    global _encoder
    _encoder = None


def with_end(ids: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with ``end_id`` after each text."""
    ends = bounds[1:] + np.arange(len(bounds) - 1)
    out = np.full(len(ids) + len(ends), end_id, np.uint32)
    mine = np.ones(len(out), bool)
    mine[ends] = False
    out[mine] = ids
    return out, np.concatenate([[0], ends + 1])


def id_lists(ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32)))
