import importlib
import random

import pytest
from brute import Corpus, words
from pyspark.sql import functions as F

from lineseek import build_index, index_tables, search, search_index, session
from lineseek.operators import pair_scan
from lineseek.operators.ranking import result_view, title_match
from lineseek.plans.build import save_index
from lineseek.sources import index as store

search_plan = importlib.import_module("lineseek.plans.search")
DIM = 6
WORDS = "alpha beta gamma delta the and of omega sigma_1 42 kappa lambda mu nu".split()
rng = random.Random(11)


def vec(dim=DIM):
    return [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(dim)]


def text(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


DOCS = [
    (i, "" if i % 9 == 0 else text(rng.randint(1, 5)).title(), text(rng.randint(1, 30)), vec(), vec()) for i in range(60)
]
DOCS[7] = (7, "Twin", "twin text alpha", [1.0] * DIM, [0.5] * DIM)
DOCS[31] = (31, "Twin", "twin text alpha", [1.0] * DIM, [0.5] * DIM)  # equal scores: lower id first
DOCS[12] = (12, "zero", "zero vector", [0.0] * DIM, [0.0] * DIM)
DOCS[13] = (13, "...", "!!!", vec(), vec())  # no words at all
QUERIES = [
    (0, "alpha beta gamma", vec()),
    (1, "Twin text", [1.0] * DIM),
    (2, "", vec()),
    (3, "the of and", vec()),
    (4, "nothing matches here", [0.0] * DIM),
    (5, "omega " * 3, vec()),
    (6, "sigma_1 42 kappa", None),
]
CORPUS = Corpus(DOCS)


def tables(spark):
    documents = spark.createDataFrame(
        [(d[0], d[1], d[2], "{}") for d in DOCS], "id bigint, title string, content string, original_entry string"
    ).repartition(3)
    schema = "id bigint, vec array<float>"
    return (
        documents,
        spark.createDataFrame([(d[0], d[3]) for d in DOCS], schema),
        spark.createDataFrame([(d[0], d[4]) for d in DOCS], schema),
    )


@pytest.fixture(scope="module")
def index(spark):
    return index_tables(*tables(spark), dim=DIM)


def asked(spark, rows=QUERIES):
    return spark.createDataFrame(rows, "query_id bigint, query string, query_vec array<float>")


def ranked(results):
    found = {}
    for r in results.select("query_id", "rank", "id", "score").collect():
        found.setdefault(r.query_id, []).append((r.rank or 0, r.id, r.score))
    return {q: [(i, pytest.approx(s, abs=2e-6)) for _, i, s in sorted(rows)] for q, rows in found.items()}


def expected(**options):
    want = {q: CORPUS.search(query, v or [], **options) for q, query, v in QUERIES}
    return {q: rows for q, rows in want.items() if rows}


@pytest.mark.parametrize(
    "options",
    [
        dict(),
        dict(limit=3, threshold=0.0),
        dict(limit=60, threshold=None),
        dict(limit=2000, threshold=None),
        dict(limit=5, threshold=None, scoring="bm25"),
        dict(limit=4, threshold=-1.0, semantic_weight=0.0),
        dict(limit=4, threshold=None, semantic_weight=1.0, title_weight=0.0),
        dict(limit=4, threshold=None, semantic_weight=1.6, title_weight=-0.4),
        dict(limit=1, threshold=0.2, title_weight=2.0),
    ],
)
def test_search_equals_brute_force(spark, index, options):
    names = {"semantic_weight": "w", "title_weight": "tw"}
    got = ranked(search(index, asked(spark), decimals=6, **options))
    want = expected(**{names.get(k, k): v for k, v in options.items()})
    assert {q: [i for i, _ in rows] for q, rows in got.items()} == {q: [i for i, _ in rows] for q, rows in want.items()}
    assert {q: [s for _, s in rows] for q, rows in want.items()} == {q: [s for _, s in rows] for q, rows in got.items()}


@pytest.mark.parametrize("strong, per_scan, cells", [(1, 4096, 1_000_000), (14, 2, 10), (200_000, 3, 50)])
def test_bounds_never_change_results(spark, index, monkeypatch, strong, per_scan, cells):
    """Few strong hits, several scans and tiny batches give the same rows."""
    monkeypatch.setattr(search_plan, "STRONG_HITS", strong)
    monkeypatch.setattr(pair_scan, "QUERIES_PER_SCAN", per_scan)
    monkeypatch.setattr(pair_scan, "CELLS", cells)
    monkeypatch.setattr(search_plan, "PAIRS_PER_TASK", cells)
    got = ranked(search(index, asked(spark), limit=4, threshold=None, decimals=6))
    want = expected(limit=4, threshold=None)
    assert {q: [i for i, _ in rows] for q, rows in got.items()} == {q: [i for i, _ in rows] for q, rows in want.items()}


def test_threshold_is_inclusive_and_unlimited_results_are_unranked(spark, index):
    third = CORPUS.search(QUERIES[0][1], QUERIES[0][2], threshold=None)[2][1]
    rows = search(index, asked(spark, QUERIES[:1]), threshold=third, limit=None, decimals=6).collect()
    want = CORPUS.search(QUERIES[0][1], QUERIES[0][2], threshold=third, limit=None)
    assert sorted(r.id for r in rows) == sorted(i for i, _ in want)
    assert {r["rank"] for r in rows} == {None}
    assert min(r.score for r in rows) == pytest.approx(third)


def test_ties_go_to_the_lower_id(spark, index):
    top = ranked(search(index, asked(spark, QUERIES[1:2]), limit=2, decimals=6))[1]
    assert [i for i, _ in top] == [7, 31]


def test_limits(spark, index):
    assert search(index, asked(spark), limit=0, threshold=None).count() == 0
    with pytest.raises(ValueError):
        search(index, asked(spark), limit=-1)
    with pytest.raises(ValueError):
        search(index, asked(spark), scoring="other").count()


def test_one_query_equals_its_batch_row(spark, index, setting):
    batch = ranked(search(index, asked(spark), threshold=0.1, decimals=6))
    setting("spark.sql.shuffle.partitions", "2")
    for row in QUERIES[:2]:
        assert ranked(search(index, asked(spark, [row]), threshold=0.1, decimals=6))[row[0]] == [
            (i, s.expected) for i, s in batch[row[0]]
        ]


def test_synonyms_widen_the_keyword_part(spark, index):
    table = spark.createDataFrame(
        [("alpha", 1, "omega"), ("alpha", 2, "kappa mu"), ("alpha", 3, "alpha"), ("alpha", 4, "nu"), ("mu", 1, "nu")],
        "token string, synset_rank int, synonym string",
    )
    got = ranked(search(index, asked(spark, [(0, "Alpha mu", QUERIES[0][2])]), threshold=None, decimals=6, synonyms=table))
    want = CORPUS.search("Alpha mu", QUERIES[0][2], threshold=None, extra=["omega", "kappa", "mu"])
    assert [i for i, _ in got[0]] == [i for i, _ in want]


def test_title_boost_off_keeps_the_text_match(spark):
    documents, content, title = tables(spark)
    plain = index_tables(documents, content, title, title_boost=False, dim=DIM)
    rows = search(plain, asked(spark), limit=5, threshold=None, decimals=6)
    assert {r[0] for r in rows.select("title_relevance").collect()} == {0.0}
    without = Corpus([(*d[:4], None) for d in DOCS])
    assert [i for i, _ in ranked(rows)[0]] == [i for i, _ in without.search(*QUERIES[0][1:], limit=5, threshold=None)]


@pytest.mark.parametrize("few", [200_000, 0])
def test_stored_index_gives_the_same_results(spark, index, tmp_path, monkeypatch, few):
    """Many term buckets and id blocks, documents fetched by broadcast and by join."""
    monkeypatch.setattr(store, "DOCS_PER_TERM_BUCKET", 10)
    monkeypatch.setattr(store, "DOCS_PER_ID_BLOCK", 7)
    monkeypatch.setattr(session, "BROADCAST_ROWS", few)
    documents, content, title = tables(spark)
    folder = save_index(documents, str(tmp_path / "index"), content_vectors=content, title_vectors=title, dim=DIM)
    for scoring in ("tfidf", "bm25"):
        options = dict(limit=6, threshold=None, decimals=6, scoring=scoring)
        stored = search_index(spark, asked(spark), folder, **options)
        assert ranked(stored) == {
            q: [(i, s.expected) for i, s in rows] for q, rows in ranked(search(index, asked(spark), **options)).items()
        }
    by_id = {d[0]: d[2] for d in DOCS}
    assert all(by_id[r.id] == r.content for r in stored.collect())


def test_build_from_lines_and_search_text(spark, tmp_path):
    lines = ['{"title":"Red fox","content":"a fox runs","n":1}', "{bad", '{"content":"slow snails"}', '{"title":"x"}']
    (tmp_path / "in.jsonl").write_text("\n".join(lines))
    folder = build_index(spark, str(tmp_path / "in.jsonl"), str(tmp_path / "index"), model="m", title_boost=False)
    build_index(spark, str(tmp_path / "in.jsonl"), folder, model="m")  # overwrites
    meta = store.read_metadata(spark, folder).first()
    assert (meta.source_file, meta.model, meta.title_boost, meta.entry_count) == ("in.jsonl", "m", True, 2)
    assert (meta.content_field, meta.title_field) == ("content", "title") and meta.created_at is not None
    rows = search_index(spark, "Red fox", folder, threshold=0.3).collect()
    assert [(r.query_id, r["rank"], r.id, r.title) for r in rows] == [(0, 1, 0, "Red fox")]
    assert rows[0].score == pytest.approx(0.3 + 0.15)  # best keyword score and an equal title
    assert rows[0].relevance == rows[0].score
    assert '"n":1' in rows[0].original_entry.toJson().replace(" ", "")


def test_missing_index(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="Index not found in"):
        search_index(spark, "q", str(tmp_path / "none"))
    documents, content, title = tables(spark)
    folder = save_index(documents, str(tmp_path / "index"), content_vectors=content, title_vectors=title, dim=DIM)
    build = next((tmp_path / "index").glob("build-*"))
    (build / "postings").rename(build / "moved")
    with pytest.raises(FileNotFoundError, match="Index not found in"):
        search_index(spark, "q", folder)


def test_title_match_definition(spark):
    pairs = [("Kitten", "sitting", 4 / 7), ("same", "SAME", 1.0), ("q", "", 0.0), ("", "t", 0.0), ("é", "e", 0.0)]
    df = spark.createDataFrame([p[:2] for p in pairs], "q string, t string")
    got = [r[0] for r in df.select(title_match(F.col("q"), F.col("t"))).collect()]
    assert got == pytest.approx([p[2] for p in pairs])


def test_view(spark):
    df = spark.createDataFrame(
        [(0, 1, "", "x" * 201, 1.23456, 1.23456), (0, 2, "T", "y" * 200, -0.5, -0.5)],
        "query_id int, rank int, title string, content string, score double, relevance double",
    )
    assert [tuple(r) for r in result_view(df).orderBy("rank").collect()] == [
        (0, 1, "Untitled", "1.2346", "123.46%", "x" * 200 + "..."),
        (0, 2, "T", "-0.5000", "-50.00%", "y" * 200),
    ]


def test_embed_function_supplies_all_vectors(spark, tmp_path):
    """One vector per text: how often it says alpha and beta."""

    def embed(texts):
        count = lambda word: F.regexp_count("text", F.lit(word)).cast("float")
        return texts.select("id", F.array(count("alpha"), count("beta")).alias("vec"))

    documents, _, _ = tables(spark)
    folder = save_index(documents, str(tmp_path / "index"), embed=embed)
    rows = search_index(
        spark, spark.createDataFrame([(0, "alpha alpha beta")], "query_id bigint, query string"), folder,
        embed=embed, threshold=None, limit=5, decimals=6,
    )

    def counts(t):
        return [float(words(t).count("alpha")), float(words(t).count("beta"))]

    plain = Corpus([(d[0], d[1], d[2], counts(d[2]), counts(d[1])) for d in DOCS])
    want = plain.search("alpha alpha beta", [2.0, 1.0], threshold=None, limit=5)
    assert [i for i, _ in ranked(rows)[0]] == [i for i, _ in want]


@pytest.mark.parametrize("kind", ["int", "bigint", "string"])
def test_query_ids_of_any_type(spark, index, kind):
    plain = ranked(search(index, asked(spark), limit=3, decimals=6))
    typed = asked(spark).withColumn("query_id", F.col("query_id").cast(kind))
    got = ranked(search(index, typed, limit=3, decimals=6))
    assert {str(q): rows for q, rows in got.items()} == {str(q): rows for q, rows in plain.items()}


def test_input_without_documents_gives_an_empty_index(spark, tmp_path):
    (tmp_path / "bad.jsonl").write_text('{"title":"x"}\nnot json\n')
    index_dir = build_index(spark, str(tmp_path / "bad.jsonl"), str(tmp_path / "index"), dim=DIM)
    assert search_index(spark, "x", index_dir, threshold=None).collect() == []


def test_a_failed_rebuild_leaves_the_index_as_it_was(spark, tmp_path):
    lines, target = tmp_path / "a.jsonl", str(tmp_path / "index")
    lines.write_text('{"title":"first","content":"alpha beta"}\n')
    build_index(spark, str(lines), target, dim=DIM)
    lines.write_text('{"title":"second","content":"gamma delta"}\n{"title":"third","content":"gamma"}\n')

    def broken(texts):
        raise RuntimeError("no model")

    with pytest.raises(RuntimeError):
        build_index(spark, str(lines), target, dim=DIM, embed=broken)
    assert [row.title for row in search_index(spark, "alpha", target, threshold=None).collect()] == ["first"]
    assert len(list((tmp_path / "index").glob("build-*"))) == 1
    build_index(spark, str(lines), target, dim=DIM)
    assert len(search_index(spark, "gamma", target, threshold=None).collect()) == 2
    assert len(list((tmp_path / "index").glob("build-*"))) == 2  # replaced, but searches may still read it
    store.remove_old_builds(spark, target, grace_seconds=0)
    assert len(list((tmp_path / "index").glob("build-*"))) == 1
    assert store.read_metadata(spark, target).first().entry_count == 2


def test_a_build_leaves_no_scratch_tables(spark, tmp_path, monkeypatch):
    shared = tmp_path / "shared"
    shared.mkdir()
    monkeypatch.setattr(session, "shared_dir", lambda spark: f"file://{shared}")
    (tmp_path / "a.jsonl").write_text('{"title":"first","content":"alpha beta"}\n')
    lemmas = spark.createDataFrame([("alpha", "alph")], "token string, lemma string")
    build_index(spark, str(tmp_path / "a.jsonl"), str(tmp_path / "index"), dim=DIM, lemmas=lemmas)
    assert list(shared.iterdir()) == []
    with pytest.raises(RuntimeError), session.scratch_run(spark):
        session.materialise(spark.range(3), "rows")
        raise RuntimeError
    assert list(shared.iterdir()) == []


def test_a_rebuild_leaves_earlier_searches_alone(spark, tmp_path):
    """A search described before a rebuild gives the earlier build's rows, until old builds are removed."""
    documents, content, title = tables(spark)
    folder = save_index(documents, str(tmp_path / "index"), content_vectors=content, title_vectors=title, dim=DIM)
    earlier = search_index(spark, asked(spark), folder, threshold=None, limit=3, decimals=6)
    first = store.load_index(spark, folder)
    save_index(documents.where("id < 5"), folder, content_vectors=content, title_vectors=title, dim=DIM)
    assert {q: [i for i, _ in rows] for q, rows in ranked(earlier).items()} == {
        q: [i for i, _ in rows] for q, rows in expected(threshold=None, limit=3).items()
    }
    assert first.entries.count() == len(DOCS) and store.load_index(spark, folder).entries.count() == 5
    assert store.remove_old_builds(spark, folder) == []  # replaced a moment ago
    assert store.remove_old_builds(spark, folder, keep=2, grace_seconds=0) == []
    assert len(store.remove_old_builds(spark, folder, grace_seconds=0)) == 1
    assert store.load_index(spark, folder).entries.count() == 5
    with pytest.raises(ValueError, match="in force"):
        store.remove_old_builds(spark, folder, keep=0)
