import itertools
import json
import re

import pytest
from pyspark.sql import functions as F

from lineseek.sources.jsonl import (
    dataset_size,
    entries_of,
    extract_documents,
    read_documents,
    rejected_lines,
    scan_lines,
)

BAD = [
    '{"a":1} x', "1,2", "1],[2", "1}", '1,"w":2', "NaN", "{'a':1}", '{"a":1}{"b":2}', '{"a":1},null',
    '{"a":1}]', '{"a":1} ] , {"b":2}', "01", '{"a":tru}', '{"a":1', "1,null",
]
GOOD = ["null", "5", '"ab"', '[7,"q"]', '{"a":1,"a":2}', '  {"a":1}  ', '{"a":[{"b":1}]}', '{"a":"}]"}', "[]", "{}"]


def test_strictness(lines_of):
    accepted = {r.pos for r in entries_of(lines_of(BAD + GOOD)).select("pos").collect()}
    assert accepted == set(range(len(BAD), len(BAD) + len(GOOD)))


def test_last_duplicate_key_wins(spark, lines_of):
    before = spark.conf.get("spark.sql.variant.allowDuplicateKeys")
    value = entries_of(lines_of(['{"a":1,"a":2}'])).select(F.to_json("entry")).first()[0]
    assert json.loads(value) == {"a": 2}
    assert spark.conf.get("spark.sql.variant.allowDuplicateKeys") == before


CONTENT_CASES = [
    ('{"content":"kept"}', None),
    ('{"title":"t"}', "no_content"),
    ('{"content":null}', "no_content"),
    ('{"content":""}', "no_content"),
    ('{"content":0}', "no_content"),
    ('{"content":0.0}', "no_content"),
    ('{"content":false}', "no_content"),
    ('{"content":5}', "not_string"),
    ('{"content":true}', "not_string"),
    ('{"content":["x"]}', "not_string"),
    ('{"content":[]}', "not_string"),
    ('{"content":{}}', "not_string"),
    ('{"content":"c","title":7}', "not_string"),
    ('{"content":"c","title":["t"]}', "not_string"),
    ('{"content":"c","title":null}', None),
    ('{"content":"c","title":0}', None),
    ('{"content":"c","title":false}', None),
    ('{"content":"  ","title":"t"}', None),
    ("null", "bad_entry"),
    ("5", "no_content"),
    ('"content"', "no_content"),
    ('["content"]', "no_content"),
    ("{bad", "bad_json"),
]


def test_extraction_rules(lines_of):
    lines = lines_of([line for line, _ in CONTENT_CASES])
    rejected = {r.pos: r.reason for r in rejected_lines(lines).collect()}
    kept = {r.pos: r for r in extract_documents(lines).collect()}
    for pos, (line, reason) in enumerate(CONTENT_CASES):
        assert rejected.get(pos) == reason, line
        assert (pos in kept) == (reason is None), line
    assert kept[0].title == "" and kept[15].title == "" and kept[17].title == "t"


def test_other_field_names(lines_of):
    lines = lines_of(['{"the body":"b","head.line":"h"}'])
    row = extract_documents(lines, "the body", "head.line").first()
    assert (row.content, row.title) == ("b", "h")


def write(folder, name, lines, end="\n"):
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(end.join(lines).encode() + end.encode())


@pytest.mark.parametrize("split", ["134217728", "300"])
def test_ids_are_dense_in_file_order(spark, setting, tmp_path, split):
    """Also when files are split and several splits share a task."""
    setting("spark.sql.files.maxPartitionBytes", split)
    setting("spark.sql.files.openCostInBytes", "100")
    expected = []
    for part, count in (("a.jsonl", 40), ("b.jsonl", 3), ("c.jsonl", 150)):
        lines = []
        for i in range(count):
            if i % 3 == 1:
                lines += ["", "   ", "{broken", '{"title":"no content"}']
            lines.append(json.dumps({"content": f"{part} {i}", "title": "t" * (i % 50)}))
            expected.append(f"{part} {i}")
        write(tmp_path / "in", part, lines)
    rows = read_documents(spark, str(tmp_path / "in")).select("id", "content").collect()
    assert [r.content for r in sorted(rows)] == expected
    assert sorted(r.id for r in rows) == list(range(len(expected)))


def test_numbering_moves_no_contents(spark, setting, tmp_path):
    setting("spark.sql.autoBroadcastJoinThreshold", "-1")
    setting("spark.sql.adaptive.enabled", "false")
    setting("spark.sql.files.maxPartitionBytes", "300")
    write(tmp_path / "in", "a.jsonl", [json.dumps({"content": f"c {i}", "n": i}) for i in range(200)])
    documents = read_documents(spark, str(tmp_path / "in"))
    plan = documents._jdf.queryExecution().executedPlan().treeString().splitlines()
    assert any("Exchange" in line for line in plan) and any("content#" in line for line in plan)
    for at, line in enumerate(plan):
        if "Exchange" in line:
            depth = line.index("Exchange")
            below = itertools.takewhile(lambda x: re.search(r"[A-Za-z*]", x).start() > depth, plan[at + 1 :])
            assert not any("content#" in x for x in below), "\n".join(plan)
    assert [r.content for r in documents.orderBy("id").collect()] == [f"c {i}" for i in range(200)]
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("lineseek")]


def test_no_documents(spark, tmp_path):
    write(tmp_path / "in", "a.jsonl", ["{broken", ""])
    assert read_documents(spark, str(tmp_path / "in")).collect() == []


def test_carriage_returns_and_blank_lines(spark, tmp_path):
    write(tmp_path / "in", "x.jsonl", ['{"a":1}', "", " \t ", '{"a":2}'], end="\r\n")
    assert scan_lines(spark, str(tmp_path / "in")).count() == 2
    assert entries_of(scan_lines(spark, str(tmp_path / "in"))).count() == 2


@pytest.mark.parametrize(
    "size, text", [(0, "0.00 B"), (1023, "1023.00 B"), (1024, "1.00 KB"), (6677, "6.52 KB"), (1024**2 + 5243, "1.01 MB")]
)
def test_dataset_size(spark, tmp_path, size, text):
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "x.jsonl").write_bytes(b"x" * size)
    assert tuple(dataset_size(spark, str(tmp_path / "f")).first()) == (size, text)
