"""Word-wise encoding, token files and packing against the tokenizer itself."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from lineseek.llm import packing, queries, tokens
from lineseek.llm.packing import best_fit_decreasing, knapsack, pack_documents, plan_sequences
from lineseek.llm.token_files import token_digests, token_index, write_token_files
from lineseek.llm.tokens import WordEncoder, default_tokenizer, slices
from lineseek.llm.work import new_path

SCHEMA = "doc_id bigint, text string, part int, ids string, length int, id int, start int"

ODD = [
    None, "", " \n\t ", "it's they're WE'LL don't x'd", "a,b. c., d.. e.,\nf.", "2024-01-02 3,000.50 №5", "<|endoftext|>",
    "x<|startoftext|>y <|ENDOFTEXT|> <|endoftext|>.", "ÀÉÎ çñß ŸĲ İstanbul ΣΑΣ ΟΔΥΣΣΕΥΣ", "é ä. ñ,", "日本語 テスト 한국어 العربية",
    "emoji 👩‍👩‍👧 ok", "a b c​d", "word." * 50, "w" * 3000, "...,,, .. ,", "ab. cd", "x.\r\ny,\x0bz,\x0c",
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(default_tokenizer())


def encoded(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize(("cached", "size"), [(700_000, 8 << 20), (40, 200)])
def test_word_encoder(tokenizer, words, monkeypatch, cached, size):
    monkeypatch.setattr(tokens, "CACHED_WORDS", cached)
    monkeypatch.setattr(tokens, "slices", lambda texts: slices(texts, size))
    encoder = WordEncoder(default_tokenizer())
    texts = ODD + [" ".join(words(n)) for n in (1, 50, 400)] + ODD
    for _ in range(2):
        ids, bounds = encoder.encode(pa.array(texts, pa.string()))
        for text, start, end in zip(texts, bounds[:-1], bounds[1:]):
            assert list(ids[start:end]) == encoded(tokenizer, text), text


def table(spark, words):
    rows = [(i, text) for i, text in enumerate(ODD)] + [(100 - i, " ".join(words(3000 * (i % 3) + i))) for i in range(12)]
    rows += [(7, "again"), (None, "no id"), (500, "same"), (500, "same")]
    return rows, spark.createDataFrame([(*row, 1, "x", 2, 3, 4) for row in rows], SCHEMA)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files(spark, tokenizer, words):
    rows, df = table(spark, words)
    path = new_path(spark, "tokens")
    write_token_files(df, path, partitions=4)
    got = token_digests(spark, path).collect()
    want = Counter((doc_id, len(ids) + 1, crc([*ids, 1])) for doc_id, ids in ((d, encoded(tokenizer, t)) for d, t in rows))
    assert Counter((row.doc_id, row.n_tokens, row.ids_crc32) for row in got) == want
    got.sort(key=lambda row: row.start)
    assert [row.start for row in got] == list(np.cumsum([0] + [row.n_tokens for row in got[:-1]]))
    ids = [row.doc_id for row in got]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    assert sorted(token_index(spark, path).collect(), key=str) == sorted(((r.doc_id, r.start, r.n_tokens) for r in got), key=str)


def test_token_file_format(spark, words):
    path = new_path(spark, "tokens")
    write_token_files(table(spark, words)[1], path, partitions=1)
    files = [row[0] for row in spark.read.format("binaryFile").load(path + "/*.parquet").select("path").collect()]
    column = {}
    for name in files:
        group = pq.ParquetFile(name.removeprefix("file:")).metadata.row_group(0)
        column |= {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
    assert "DELTA_BINARY_PACKED" in column["doc_id"].encodings
    assert any("DICTIONARY" in encoding for encoding in column["ids.list.element"].encodings)
    assert column["doc_id"].has_offset_index and column["doc_id"].has_column_index


def test_no_rows(spark):
    df = spark.createDataFrame([], SCHEMA)
    path = new_path(spark, "tokens")
    write_token_files(df, path)
    assert token_digests(spark, path).collect() == [] == pack_documents(df).collect()


@pytest.mark.parametrize("capacity", [2048, 16])
def test_packing(spark, tokenizer, words, capacity):
    rows, df = table(spark, words)
    got = pack_documents(df.repartition(3), capacity=capacity, with_ids=True).collect()
    want = Counter()
    for doc_id, text in rows:
        ids = [*encoded(tokenizer, text), 0]
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            want[doc_id, piece, start, len(part), crc(part)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert all(crc(r.ids) == r.ids_crc32 for r in got)
    held = defaultdict(list)
    for row in got:
        held[row.sequence_id].append((row.offset, row.length))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(held) <= -(-sum(row.length for row in got) // capacity) + 2


def test_plans_use_everything_and_waste_little(rng):
    for n in (0, 1, 30, 5000):
        lengths = Counter(min(100, 1 + int(rng.expovariate(0.04))) for _ in range(n))
        plan = plan_sequences(lengths, 100)
        used = Counter()
        for config, many in plan.items():
            assert sum(k * c for k, c in config) <= 100
            for k, c in config:
                used[k] += c * many
        assert used == lengths
        least = -(-sum(k * c for k, c in lengths.items()) // 100)
        assert sum(plan.values()) <= least + max(1, least // 100)


def test_knapsack_is_optimal(rng):
    lengths = np.array([3, 5, 8, 13])
    values = np.array([1.0, 2.1, 3.0, 5.6])
    best, _ = knapsack(values, lengths, 30)

    def brute(room):
        return max([0.0, *(v + brute(room - k) for k, v in zip(lengths, values) if k <= room)])

    assert np.allclose(best, [brute(room) for room in range(31)])


def test_best_fit_takes_the_fullest():
    assert best_fit_decreasing(Counter({7: 1, 6: 1, 3: 1, 4: 1}), 10) == Counter({((7, 1), (3, 1)): 1, ((6, 1), (4, 1)): 1})
    assert packing.SEQUENCE_TOKENS == 2048


def test_packing_leaves_no_encoder_in_its_worker(monkeypatch):
    """A worker lives on and serves other stages, which need the memory."""
    taken = {}

    class Rows:
        schema = {"id": type("Field", (), {"dataType": type("Kind", (), {"simpleString": lambda self: "bigint"})()})()}

        def select(self, *columns):
            return self

        def mapInArrow(self, stage, schema):
            taken["stage"] = stage
            return self

        def withColumnRenamed(self, old, new):
            return self

    monkeypatch.setattr(packing.F, "col", lambda name: type("Column", (), {"alias": lambda self, other: self})())
    packing.token_pieces(Rows())
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["some words"])], ["id", "text"])
    assert [b.num_rows for b in taken["stage"](iter([batch]))] == [1]
    assert tokens._encoder is None


def test_packing_query_keeps_its_workers_encoder(spark, monkeypatch):
    """The query has its workers' memory to itself; the rows are those of an encoder given back."""
    rows = spark.createDataFrame([(i, "some words and more") for i in range(8)], "doc_id bigint, text string").coalesce(1)
    monkeypatch.setattr(queries, "table", lambda *_: rows)
    stages, pieces = [], packing.token_pieces

    def watched(documents, **options):
        stages.append(options.get("keep_encoder"))
        return pieces(documents, **options)

    monkeypatch.setattr(packing, "token_pieces", watched)
    kept = queries.op5_best_fit_packing(spark, "").collect()
    assert stages == [True]
    assert sorted(kept) == sorted(packing.pack_documents(rows).collect())
