import json
import math
import random
import struct
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lineseek import analyze
from lineseek.functions.numbers import format_size, number_text_length, to_fixed
from lineseek.operators import profile as profiling
from lineseek.operators.profile import profile_entries
from lineseek.plans.analyze import leading_entries
from lineseek.sources.jsonl import entries_of


def profile(lines_df, **options):
    table, total = profile_entries(entries_of(lines_df), **options)
    return {r.field: tuple(r)[1:] for r in table.collect()}, total


def test_sample_collection(spark, tmp_path):
    """A small collection of the usual shape, with figures worked out by hand."""
    rows = [
        {"title": "ab" * (i + 1), "content": "x" * (100 + i), "tags": ["p", "q", "r"], "date": f"2023-01-{i + 10}"}
        for i in range(10)
    ]
    path = tmp_path / "sample.jsonl"
    path.write_text("\n".join(json.dumps(r) for r in rows) + "\n")
    found = analyze(spark, str(path))
    assert {r.field: tuple(r)[1:] for r in found.fields.collect()} == {
        "title": ("string", 100, 11, 10),
        "content": ("string", 100, 105, 0),  # 104.5 rounds up; all are long
        "tags": ("array_of_string", 100, 3, 0),
        "date": ("string", 100, 10, 10),
    }
    summary = found.summary.first()
    assert summary.total_entries == 10
    assert summary.file_size == f"{path.stat().st_size / 1024:.2f} KB"
    assert summary.sample_time is not None


@pytest.mark.parametrize(
    "values, expected",
    [
        (['"a"', "null"], ("mixed", 1)),
        (["[]", '["x"]'], ("mixed", 1)),
        (["[[1]]"], ("array_of_array_of_number", 1)),
        (["[null]"], ("array_of_null", 1)),
        (['[1,"x"]'], ("array_of_number", 2)),
        (["[]"], ("empty_array", 0)),
        (["[[]]"], ("array_of_empty_array", 1)),
        (["[[[[[[[[[[true]]]]]]]]]]"], ("array_of_" * 10 + "boolean", 1)),
        (['[{"a":[1]}]'], ("array_of_object", 1)),
        (['["[x"]'], ("array_of_string", 1)),
        (['{"a":1,"b":null}'], ("object", 2)),
        (["{}"], ("object", 0)),
        (["true"], ("boolean", 4)),
        (["false"], ("boolean", 5)),
        (["null"], ("null", 0)),
        (['"😀a"'], ("string", 3)),
        (["1.0"], ("number", 1)),
        (["1.50"], ("number", 3)),
        (["1e3"], ("number", 4)),
        (["-0.0"], ("number", 1)),
        (["1e21"], ("number", 5)),
        (["1e-7"], ("number", 4)),
        (["-12.5"], ("number", 5)),
        (["123456789012345678901234567890"], ("number", 22)),
        (["2e23"], ("number", 5)),
        (["5e-324"], ("number", 6)),
        (["[1e400]"], ("array_of_number", 1)),
        (['[[-1e400,"a"],1]'], ("array_of_array_of_number", 2)),
        (['["Infinity"]'], ("array_of_string", 1)),
        (['[[["-Infinity"]]]'], ("array_of_array_of_array_of_string", 1)),
    ],
)
def test_types_and_lengths(lines_of, values, expected):
    fields, _ = profile(lines_of(['{"f":%s}' % v for v in values]))
    assert fields["f"][0] == expected[0]
    assert fields["f"][2] == expected[1]


def simulate(values):
    """Distinct tracking step by step: stop at the first short string that
    arrives while the set is full."""
    seen = None
    for value in values:
        short = isinstance(value, str) and len(value) < 100
        if seen is None:
            seen = {value} if short else set()
        elif short and seen != "stopped":
            if len(seen) < 1000:
                seen.add(value)
            else:
                seen = "stopped"
    return None if seen == "stopped" else len(seen)


rng = random.Random(7)
DISTINCT_CASES = {
    "below": [f"v{i}" for i in range(999)],
    "at": [f"v{i}" for i in range(1000)],
    "at_repeat": [f"v{i}" for i in range(1000)] + ["v0"],
    "at_early_repeat": ["v0"] + [f"v{i}" for i in range(1000)],
    "at_long_after": [f"v{i}" for i in range(1000)] + ["x" * 100, 5],
    "above": [f"v{i}" for i in range(1001)],
    "long": ["x" * 99, "x" * 100, "y" * 100],
    "numbers": list(range(50)),
    "random": [f"v{rng.randrange(1100)}" for _ in range(3000)],
}


def test_capped_distinct_counts(lines_of):
    length = max(map(len, DISTINCT_CASES.values()))
    lines = [
        json.dumps({name: values[i] for name, values in DISTINCT_CASES.items() if i < len(values)})
        for i in range(length)
    ]
    fields, total = profile(lines_of(lines).repartition(4))
    assert total == length
    for name, values in DISTINCT_CASES.items():
        assert fields[name][3] == simulate(values), name


def test_totals_count_entries_without_fields(lines_of):
    lines = ["null", "5", '"abc"', "{}", "[]", '{"a":1}', '["x","y"]', "{bad"]
    fields, total = profile(lines_of(lines))
    assert total == 7
    assert fields == {"a": ("number", 14, 1, 0), "0": ("string", 14, 1, 1), "1": ("string", 14, 1, 1)}


def test_field_filter_keeps_totals(lines_of):
    lines = ['{"a":1,"b":"x"}', '{"b":"y"}', '{"c":1}', '{"constructor":1}']
    fields, total = profile(lines_of(lines), fields=["a", "b"])
    assert total == 4
    assert fields == {"a": ("number", 25, 1, 0), "b": ("string", 50, 1, 2)}


def test_sample_is_a_prefix(lines_of):
    lines = ["{bad"] + ['{"a":"%d"}' % i for i in range(40)] + ['{"late":1}'] * 10
    fields, total = profile(lines_of(lines).repartition(3), sample_size=20)
    assert total == 20
    assert fields == {"a": ("string", 100, 2, 20)}
    assert profile(lines_of(lines), sample_size=0)[1] == 50
    assert profile(lines_of(lines), sample_size=500)[1] == 50


def test_sample_opens_leading_files_only(spark, tmp_path):
    for i in range(12):
        lines = ["{bad"] + ['{"file":"f%d","n":%d}' % (i, k) for k in range(5)]
        (tmp_path / f"part {i:02d}.jsonl").write_text("\n".join(lines))
    assert len(leading_entries(spark, str(tmp_path), 5).select("pos.file").distinct().collect()) == 1
    assert len(leading_entries(spark, str(tmp_path), 6).select("pos.file").distinct().collect()) == 8
    assert len(leading_entries(spark, str(tmp_path), 41).select("pos.file").distinct().collect()) == 12
    for size, files in ((5, 1), (7, 2), (60, 12), (500, 12)):
        found = analyze(spark, str(tmp_path), sample_size=size)
        assert found.summary.first().total_entries == min(size, 60)
        assert {r.field: r.unique_values for r in found.fields.collect()} == {"file": files, "n": 0}


def test_negative_sample_is_an_error(lines_of):
    with pytest.raises(ValueError):
        profile(lines_of(['{"a":1}']), sample_size=-1)


def test_result_does_not_depend_on_partitions(lines_of, setting):
    lines = [json.dumps({"a": i % 7, "b": str(i), "c": [i] if i % 2 else None}) for i in range(300)]
    first = profile(lines_of(lines))
    setting("spark.sql.shuffle.partitions", "3")
    assert profile(lines_of(lines).repartition(7)) == first


# value: its text in ECMAScript
NUMBERS = {
    0.0: "0", 100.0: "100", 6.55: "6.55", -0.001: "-0.001", 0.0001: "0.0001", 1e20: "100000000000000000000",
    1e21: "1e+21", -1.5e22: "-1.5e+22", 1e-6: "0.000001", 1.5e-6: "0.0000015", 1e-7: "1e-7", 1.5e-7: "1.5e-7",
    123456789.125: "123456789.125", 1.25e300: "1.25e+300", 12345678901234567890.0: "12345678901234567000",
    9007199254740993.0: "9007199254740992", 1e7: "10000000", 12345678.5: "12345678.5", 0.000123: "0.000123",
}


def test_number_text_length(spark):
    df = spark.createDataFrame([(x,) for x in NUMBERS], "x double")
    for x, n in df.select("x", number_text_length(F.col("x"))).collect():
        assert n == len(NUMBERS[x]), x


def spelt(x):
    """ECMAScript's text of a positive finite double, from Python's shortest digits."""
    sign, digits, exponent = Decimal(repr(x)).normalize().as_tuple()
    figures, point = "".join(map(str, digits)), len(digits) + exponent
    if len(figures) <= point <= 21:
        return figures + "0" * (point - len(figures))
    if 0 < point <= 21:
        return figures[:point] + "." + figures[point:]
    if -6 < point <= 0:
        return "0." + "0" * -point + figures
    tail = f"e{'+' if point > 0 else '-'}{abs(point - 1)}"
    return figures[0] + ("." + figures[1:] if figures[1:] else "") + tail


def test_number_text_is_the_shortest(spark):
    """Doubles of any bits, subnormal ones, and those that Java prints with a digit too many."""
    rng = random.Random(5)
    bits = [rng.getrandbits(63) for _ in range(6000)] + [rng.getrandbits(rng.randint(1, 52)) for _ in range(3000)]
    bits += [1, 2, 3, (1 << 52) - 1, 1 << 52, (0x7FF << 52) - 1]
    values = [struct.unpack("<d", struct.pack("<Q", b))[0] for b in bits]
    values += [float(f"{rng.randint(1, 99)}e{rng.randint(-320, 300)}") for _ in range(4000)]
    values += [rng.randint(1, 10**9) / 10 ** rng.randint(0, 12) for _ in range(3000)]
    values += [rng.random() * 10 ** rng.randint(-4, 8) for _ in range(3000)]
    values += [2e23, 2e-44, 8.41e21, 9.999999999999999e22, 9007199254740993.0, 1.1e-320]
    values = [x for x in values if math.isfinite(x) and x > 0]
    df = spark.createDataFrame([(x,) for x in values], "x double")
    for x, n in df.select("x", number_text_length(F.col("x"))).collect():
        assert n == len(spelt(x)), (x, spelt(x))


def test_to_fixed_rounds_the_binary_value(spark):
    cases = {1.005: "1.00", 2.675: "2.67", 1.255: "1.25", 0.125: "0.13", 10.0: "10.00", -1.005: "-1.00", 8.345: "8.35",
             0.004: "0.00", 99.999: "100.00"}
    df = spark.createDataFrame([(x,) for x in cases], "x double")
    assert {x: t for x, t in df.select("x", to_fixed(F.col("x"), 2)).collect()} == cases


def test_format_size_caps_at_terabytes(spark):
    df = spark.createDataFrame([(3 * 1024**5,), (1024**3 - 1,)], "b bigint")
    assert [r[0] for r in df.select(format_size(F.col("b"))).collect()] == ["3072.00 TB", "1024.00 MB"]
