from collections import defaultdict

import pytest

from lineseek.llm import chat
from lineseek.llm.chat import maximal_conversations

SCHEMA = "conv_id bigint, turn bigint, role string, text string, place int, chunk string, conv string, n_turns int"


def brute(rows):
    turns = defaultdict(set)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].add((turn is not None, turn or 0, role or "", text or ""))
    talks = {conv: [x[2:] for x in sorted(held)] for conv, held in turns.items()}
    out = set()
    for conv, talk in talks.items():
        if any(len(other) > len(talk) and other[: len(talk)] == talk for other in talks.values()):
            continue
        equal = [c for c, other in talks.items() if other == talk]
        if conv == min(equal):
            start = 0
            for place, (role, text) in enumerate(talk, 1):
                rendered = f"<|im_start|>{role}\n{text}<|im_end|>\n"
                out.add((conv, place, len(talk), role, start, len(rendered), rendered, len(equal)))
                start += len(rendered)
    return out


def rows_of(rng):
    rows = []
    for conv in range(40):
        base = rng.randrange(4)
        length = rng.randint(1, 6)
        for turn in range(length):
            changed = conv % 7 == 0 and turn == length - 1
            rows.append((conv, turn * (1 + base), "user" if turn % 2 == 0 else "assistant", f"talk {base} {turn}{'!' * changed}"))
    rows += [(100, turn, "user", f"long {turn}") for turn in range(70)] + [(101, turn, "user", f"long {turn}") for turn in range(69)]
    rows += [(102, 0, None, None), (103, None, "", ""), (104, 0, "user", "a"), (104, 0, "user", "a"), (104, 0, "user", "b")]
    rows += [(105, 0, "user", "a"), (None, 0, "user", "lost"), (106, 0, "user", "long text " * 20_000), (107, -5, "é", "ü")]
    rows += [(108, 0, "user", "xy"), (109, 0, "userx", "y")]
    return rows


@pytest.mark.parametrize("chunk", [1024, 3])
def test_against_brute_force(spark, rng, monkeypatch, chunk):
    monkeypatch.setattr(chat, "TURNS_PER_CHUNK", chunk)
    rows = rows_of(rng)
    df = spark.createDataFrame([(*row, 1, "c", "v", 2) for row in rows], SCHEMA).repartition(3)
    got = [tuple(row) for row in maximal_conversations(df).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_no_rows(spark):
    assert maximal_conversations(spark.createDataFrame([], SCHEMA)).collect() == []
