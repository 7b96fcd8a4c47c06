"""Personal data against the rules as plain regular expressions, and what the trees add."""

import hashlib
import random
import re

import numpy as np
import pytest

from lineseek.llm.boosting import calibrated_threshold, fit
from lineseek.llm.pii import base_spans, find_personal_data, luhn, redact
from lineseek.llm.queries import op13_pii

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(number):
    total = 0
    for place, digit in enumerate(reversed(number)):
        value = int(digit) * (2 if place % 2 else 1)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def brute(text):
    found = []
    for order, (kind, rule) in enumerate(RULES.items()):
        for m in re.finditer(rule, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": lambda: True,
                "ip": lambda: all(int(part) <= 255 for part in m.group().split(".")),
                "card": lambda: 14 <= len(digits) <= 19 and plain_luhn(digits),
                "phone": lambda: 10 <= len(digits) <= 15,
            }[kind]()
            if good:
                found.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return [span for _, _, span in sorted(found)]


def card(rng):
    digits = "4" + "".join(rng.choices("0123456789", k=14))
    return next(digits + d for d in "0123456789" if plain_luhn(digits + d))


def phone(rng):
    return f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(0, 9999):04d}"


def test_luhn(rng):
    for _ in range(300):
        number = "".join(rng.choices("0123456789", k=rng.randint(2, 20)))
        assert luhn(number) == plain_luhn(number)


def test_base_spans_of_odd_texts():
    rng = random.Random(3)
    alphabet = ["@", ".", "+", "-", " ", "(", ")", "1", "23", "456", "a", "Zé", "_", "%", "\n", "1.2.3.4", "a@b.c", "4" * 15, "255", "300"]
    for _ in range(4000):
        text = "".join(rng.choices(alphabet, k=rng.randint(0, 40)))
        assert [f"{('email', 'ip', 'card', 'phone')[k]}:{s}:{e}" for k, s, e in base_spans(text)] == brute(text), text


def test_long_texts_take_linear_time(spark):
    texts = ["a" * 300_000, "1" * 300_000, "a@" * 150_000, "1." * 150_000, "+1" * 150_000, "+1" + "(" * 300_000, "12 " * 100_000]
    rows = [(i, text) for i, text in enumerate(texts)]
    got = find_personal_data(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone) for r in got if r.doc_id != 3} == dict.fromkeys((0, 1, 2, 4, 5, 6), (0,) * 4)
    assert next(r.n_ip for r in got if r.doc_id == 3) == 37_500


def test_query_equals_the_rules(spark, data):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = op13_pii(spark, data).collect()
    assert len(got) == len(rows)
    for row in got:
        want = brute(rows[row.doc_id])
        assert row.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(s.startswith(k) for s in want) for k in RULES]
        assert set(want) <= set(filter(None, row.spans.split(",")))


@pytest.fixture
def planted(rng, words):
    """Documents that teach, documents with neighbours the rules miss, and clean ones."""
    rows, missed = [], {}
    for i in range(400):
        near = " ".join(words(4))
        number = card(rng)
        wrong = number[:-1] + str((int(number[-1]) + 3) % 10)
        what = rng.choice([phone(rng), number, wrong, "10.0.0.%d" % rng.randint(1, 255), "12.%d" % i, f"x{i}@y.org"])
        rows.append((i, f"{near} {what} {near}"))
    for i in range(400, 440):
        first, second = phone(rng), card(rng)
        rows.append((i, f"{' '.join(words(3))} {first} {second} and"))
        at = rows[-1][1].index(first)
        missed[i] = {f"phone:{at}:{at + len(first)}", f"card:{at + len(first) + 1}:{at + len(first) + 17}"}
    clean = [(i, f"In {i} there were {' '.join(words(30))} and 4.0. of 1234 5678 pages") for i in range(440, 500)]
    return rows, missed, clean


def test_neighbours_are_added_and_clean_texts_left_alone(spark, planted):
    rows, missed, clean = planted
    df = spark.createDataFrame([(*r, 1) for r in rows + clean], "doc_id bigint, text string, spans int")
    got = {r.doc_id: r for r in find_personal_data(df).collect()}
    assert all(brute(rows[i][1]) == [] for i in missed)
    caught = sum(len(spans & set(got[i].spans.split(","))) for i, spans in missed.items())
    assert caught >= 0.9 * 2 * len(missed)
    assert all(got[i].spans == "" for i, _ in clean)
    wrong = [i for i, _ in rows[:400] if got[i].spans != ",".join(brute(rows[i][1]))]
    assert wrong == []
    again = {r.doc_id: r.spans for r in find_personal_data(df.repartition(5)).collect()}
    assert again == {i: r.spans for i, r in got.items()}
    i = min(missed)
    assert redact(rows[i][1], got[i].spans).endswith("[phone] [card] and")


def test_odd_rows(spark):
    rows = [(None, "a@b.cd"), (7, None), (7, ""), (7, "a@b.cd"), (7, "a@b.cd")]
    got = find_personal_data(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((str(r.doc_id), r.n_email, r.spans) for r in got) == [
        ("7", 0, ""), ("7", 0, ""), ("7", 1, "email:0:6"), ("7", 1, "email:0:6"), ("None", 1, "email:0:6"),
    ]
    assert find_personal_data(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_boosting_learns_an_interaction():
    rng = np.random.default_rng(0)
    rows = rng.normal(size=(3000, 4))
    labels = ((rows[:, 0] > 0) != (rows[:, 2] > 0.5)).astype(float)
    model = fit(rows[:2000], labels[:2000])
    chances = model.probability(rows[2000:])
    assert ((chances > 0.5) == labels[2000:]).mean() > 0.95
    bound = calibrated_threshold(chances, labels[2000:], 0.98)
    assert labels[2000:][chances >= bound].mean() >= 0.98
    assert fit(rows, np.ones(3000)) is None
    assert calibrated_threshold(np.array([0.9]), np.array([0.0]), 0.9) == float("inf")
