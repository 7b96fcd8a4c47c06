"""Personal data: overlapping candidates, boosted trees, calibrated thresholds.

Fixed rules give the *base* spans of four kinds. They read greedily and don't
try again, so a telephone number with a card number after it is neither. To
find what they miss, generators propose every run of digit groups, every quad
and every text around an ``@`` that could be one (far more than are). The base
spans teach: a candidate that is one is right; one that breaks its kind's
rule, or overlaps a base span, is wrong. Trees boosted on all of
these judge the rest by their form and context, and a threshold per kind,
calibrated on documents held out, decides.

All positions count code points; every scan is linear in the text, whatever it
holds. Documents are read once: what stays is a small row per document.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineseek.llm.boosting import Boosted, fit_counted
from lineseek.llm.tokens import portions
from lineseek.llm.work import materialise, tidy

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
#: Limits of the rules.
OCTET, CARD_DIGITS, PHONE_DIGITS = 255, (14, 19), (10, 15)

HELD_OUT = 4  # one document of so many calibrates
PRECISION = 0.99
LEAST_GROUP = 3  # digits of each group of a proposed card number
REACH = 24  # code points of context searched for telling words
FEATURES = 26

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
QUAD = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
DIGITS_JOINED = re.compile(r"[0-9](?:[ -]?[0-9])+")
INTERNATIONAL = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
GROUP = re.compile(r"[0-9]+")
AT_SIGN = re.compile(r"@|[ ]?(?:\[at\]|\(at\))[ ]?", re.IGNORECASE)
DOT_WORD = re.compile(r"[ ]?(?:\[dot\]|\(dot\))[ ]?", re.IGNORECASE)
WHOLE_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
BESIDE_AT = frozenset("[]()<>,;:\"'|@") | frozenset(chr(c) for c in (9, 10, 11, 12, 13, 32))
PERSONAL = re.compile(r"tel|phone|call|fax|mobil|card|visa|mail|contact|reach|address", re.IGNORECASE)
TECHNICAL = re.compile(r"version|page|isbn|order|serial|sha|hash|key|build|id[ :=#]", re.IGNORECASE)
HINT = r"[0-9@]|[\[(][aA][tT][\])]"

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    doubled = (sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(doubled)) % 10 == 0


def only_digits(text: str) -> str:
    return "".join(GROUP.findall(text))


def small_parts(text: str) -> bool:
    """At most 255 each; leading zeros don't count."""
    return all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= OCTET for part in text.split("."))


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the address rule: the run before an ``@`` is read backwards, each code point once."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done
        else:
            done = max(done, at)
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """Spans by the fixed rules, by start, then kind."""
    found = [(EMAIL, *span) for span in emails(text)]
    found += [(IP, *m.span()) for m in QUAD.finditer(text) if small_parts(m.group())]
    for m in DIGITS_JOINED.finditer(text):
        if m.end() - m.start() >= CARD_DIGITS[0]:
            digits = only_digits(m.group())
            if CARD_DIGITS[0] <= len(digits) <= CARD_DIGITS[1] and luhn(digits):
                found.append((CARD, *m.span()))
    for m in INTERNATIONAL.finditer(text):
        if PHONE_DIGITS[0] <= len(only_digits(m.group())) <= PHONE_DIGITS[1]:
            found.append((PHONE, *m.span()))
    return sorted(found, key=lambda span: (span[1], span[0], span[2]))


def _number_candidates(text: str) -> Iterator[Span]:
    """Runs of whole digit groups: quads, what follows a ``+``, and card numbers in
    groups of three digits or more. Not more than 19 groups each."""
    groups = [m.span() for m in GROUP.finditer(text)]
    joints = [text[a[1] : b[0]] if b[0] - a[1] <= 3 else None for a, b in zip(groups, groups[1:], strict=False)]
    for i, (start, _) in enumerate(groups):
        digits, card, phone, quad = 0, True, start > 0 and text[start - 1] == "+", True
        for j in range(i, min(i + CARD_DIGITS[1], len(groups))):
            if j > i:
                joint = joints[j - 1]
                if joint is None:
                    break
                card = card and joint in (" ", "-")
                quad = quad and joint == "." and j <= i + 3
                phone = phone and all(c in " ().-" for c in joint)
            held = groups[j][1] - groups[j][0]
            card = card and held >= LEAST_GROUP
            digits += held
            if digits > CARD_DIGITS[1] or not (card or quad or phone):
                break
            end = groups[j][1]
            if card and digits >= CARD_DIGITS[0] - 2:
                yield CARD, start, end
            if phone and PHONE_DIGITS[0] - 3 <= digits <= PHONE_DIGITS[1]:
                yield PHONE, start - 1, end
            if quad and j == i + 3:
                yield IP, start, end


def _email_candidates(text: str) -> Iterator[Span]:
    """The text around an ``@`` or its spelt-out form, up to white space or a bracket."""
    done = 0
    for m in AT_SIGN.finditer(text):
        start, end = m.start(), m.end()
        while start > done and text[start - 1] not in BESIDE_AT:
            start -= 1
        done = end
        while end < len(text):
            spelt = DOT_WORD.match(text, end)
            if spelt:
                end = spelt.end()
            elif text[end] in BESIDE_AT:
                break
            else:
                end += 1
        while end > done and not text[end - 1].isalnum():
            end -= 1
        if start < m.start() and end > m.end():
            yield EMAIL, start, end


def candidates(text: str) -> list[Span]:
    return sorted({*_number_candidates(text), *_email_candidates(text)}, key=lambda span: (span[1], span[0], span[2]))


def plain(kind: int, text: str) -> str:
    """A candidate's text, an address with its signs instead of words."""
    return DOT_WORD.sub(".", AT_SIGN.sub("@", text)) if kind == EMAIL else text


def obeys(kind: int, text: str) -> bool:
    """Whether the text of a candidate, taken alone, meets its kind's rule."""
    if kind == EMAIL:
        return WHOLE_EMAIL.fullmatch(text) is not None
    if kind == IP:
        return small_parts(text)
    digits = only_digits(text)
    if kind == CARD:
        return CARD_DIGITS[0] <= len(digits) <= CARD_DIGITS[1] and luhn(digits)
    return text[0] == "+" and PHONE_DIGITS[0] <= len(digits) <= PHONE_DIGITS[1]


def _class(text: str, place: int) -> int:
    if not 0 <= place < len(text):
        return 0
    c = text[place]
    return 1 if c.isspace() else 2 if c.isalpha() else 3 if c.isdigit() else 4


def features(text: str, span: Span) -> list[float]:
    """Form first, then context."""
    kind, start, end = span
    own = plain(kind, text[start:end])
    digits = only_digits(own)
    groups = [len(g) for g in GROUP.findall(own)] or [0]
    local, _, host = own.partition("@") if kind == EMAIL else ("", "", "")
    labels = host.split(".")
    parts = [int(p) for p in own.split(".") if p.isascii() and p.isdigit() and len(p) < 9] if kind == IP else []
    before = text[max(0, start - REACH) : start]
    form = [
        len(own), len(digits), len(groups), groups[0], groups[-1], max(groups), min(groups),
        float(kind != EMAIL and len(digits) > 1 and luhn(digits)),
        int(digits[0]) if digits else -1, float(own[0] == "+"),
        own.count(" "), own.count("-"), own.count("."), own.count("(") + own.count(")"),
        len(local), len(labels), len(labels[-1]), float(labels[-1].isalpha()), float(WHOLE_EMAIL.fullmatch(own) is not None),
        max(parts, default=0),
    ]
    around = [
        _class(text, start - 1), _class(text, start - 2), _class(text, end), _class(text, end + 1),
        float(PERSONAL.search(before) is not None), float(TECHNICAL.search(before) is not None),
    ]
    return [float(x) for x in form + around]


def judge(text: str) -> tuple[list[Span], list[tuple[Span, int | None, list[float]]]]:
    """Base spans, and each candidate with its label: 1 is a base span, 0 breaks
    its rule or overlaps a base span, none is for the trees to say."""
    base = base_spans(text)
    known = set(base)
    covered = _merged(base)
    judged = []
    for span in candidates(text):
        if span in known:
            label = 1
        elif _overlaps(covered, span[1], span[2]) or not obeys(span[0], plain(span[0], text[span[1] : span[2]])):
            label = 0
        else:
            label = None
        judged.append((span, label, features(text, span)))
    return base, judged


def _merged(spans: list[Span]) -> tuple[list[int], list[int]]:
    starts: list[int] = []
    ends: list[int] = []
    for _, start, end in spans:
        if ends and start < ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return starts, ends


def _overlaps(covered: tuple[list[int], list[int]], start: int, end: int) -> bool:
    i = bisect_left(covered[0], end) - 1
    return i >= 0 and covered[1][i] > start


SPAN_TYPE = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
CANDIDATE_TYPE = pa.list_(
    pa.struct(
        [("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("label", pa.int32()),
         ("features", pa.list_(pa.float64()))]
    )
)
JUDGED = (
    "doc_id {id_type}, base array<struct<kind: int, start: bigint, end: bigint>>, "
    "candidates array<struct<kind: int, start: bigint, end: bigint, label: int, features: array<double>>>"
)


@tidy
def _judge_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in portions(batches, 1):
        texts = batch.column(1).fill_null("")
        found, proposed = [[] for _ in range(len(texts))], [[] for _ in range(len(texts))]
        for i in np.flatnonzero(pc.match_substring_regex(texts, HINT).to_numpy(zero_copy_only=False)):
            base, judged = judge(texts[int(i)].as_py())
            found[i] = [{"kind": k, "start": s, "end": e} for k, s, e in base]
            proposed[i] = [
                {"kind": k, "start": s, "end": e, "label": label, "features": row} for (k, s, e), label, row in judged
            ]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(found, SPAN_TYPE), pa.array(proposed, CANDIDATE_TYPE)],
            ["doc_id", "base", "candidates"],
        )


def fit_models(judged: DataFrame) -> list[tuple[Boosted | None, float]]:
    """A model and a threshold per kind, from all candidates with a label.

    One document of ``HELD_OUT``, by the hash of its id, calibrates. Candidates alike in
    their features are one row with its number.
    """
    each = judged.select("doc_id", F.explode("candidates").alias("c")).where("c.label IS NOT NULL")
    held_out = F.coalesce(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(HELD_OUT)) == 0, F.lit(False))
    each = each.select("c.kind", "c.label", held_out.alias("held_out"), "c.features")
    alike = materialise(each.groupBy("kind", "label", "held_out", "features").agg(F.count("*").alias("n")), "pii-labels")
    found = fit_counted(alike, FEATURES, PRECISION)
    models: list[tuple[Boosted | None, float]] = []
    for kind in range(len(KINDS)):
        model, bound = found.get(kind, (None, float("inf")))
        models.append((model, max(bound, 0.5)))
    return models


def add_spans(
    base: list[Span], proposed: list[tuple[float, int, int, int]]
) -> list[Span]:
    """``base`` plus the likeliest candidates ``(chance, kind, start, end)`` that overlap
    nothing chosen before; ties go to the earlier, then shorter, then the kind listed first."""
    starts: list[int] = []
    ends: list[int] = []
    added = []
    for _, kind, start, end in sorted(proposed, key=lambda c: (-c[0], c[2], c[3], c[1])):
        at = bisect_left(starts, end)
        if at and ends[at - 1] > start:
            continue
        starts.insert(at, start)
        ends.insert(at, end)
        added.append((kind, start, end))
    return sorted([*base, *added], key=lambda span: (span[1], span[0], span[2]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for kind, start, end in spans)


def _redact_batches(models: list[tuple[Boosted | None, float]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base = [[(s["kind"], s["start"], s["end"]) for s in row] for row in batch.column(1).to_pylist()]
            accepted: list[list[tuple[float, int, int, int]]] = [[] for _ in base]
            lists = batch.column(2)
            owner = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).fill_null(0).to_numpy())
            flat = lists.flatten()
            open_ = np.flatnonzero(flat.field("label").is_null().to_numpy(zero_copy_only=False))
            kinds, starts, ends = (flat.field(n).to_numpy(zero_copy_only=False)[open_] for n in ("kind", "start", "end"))
            wanted = flat.take(pa.array(open_)).field("features")
            values = wanted.flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)
            for kind, (model, bound) in enumerate(models):
                mine = np.flatnonzero(kinds == kind)
                if model is None or not len(mine):
                    continue
                chances = model.probability(values[mine])
                for i, chance in zip(mine[chances >= bound], chances[chances >= bound], strict=True):
                    accepted[owner[open_[i]]].append((float(chance), kind, int(starts[i]), int(ends[i])))
            spans = [add_spans(own, more) if more else own for own, more in zip(base, accepted, strict=True)]
            counts = [pa.array([sum(s[0] == k for s in row) for row in base], pa.int64()) for k in range(len(KINDS))]
            digests = [hashlib.sha256(written(row).encode()).hexdigest() for row in base]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, pa.array(digests, pa.string()), pa.array([written(r) for r in spans], pa.string()),
                 pa.array([len(r) - len(b) for r, b in zip(spans, base, strict=True)], pa.int64())],
                ["doc_id", *(f"n_{name}" for name in KINDS), "base_sha256", "spans", "n_added"],
            )

    return run


def find_personal_data(
    documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id_col``, ``n_email, n_ip, n_card, n_phone`` (base spans), ``base_sha256``, ``spans``, ``n_added`` for every row.

    ``spans`` lists base and added spans as ``kind:start:end``, by start, then
    kind, joined by commas; ``base_sha256`` is the digest of the base ones written
    that way. Null and empty texts have none. Repeated rows, also of one id,
    are judged each for itself; null ids are kept. Where a kind has
    only right or only wrong candidates, nothing is added. Other columns don't
    matter. An empty table gives no rows. A document is one task's work; no row
    moves but the features of candidates with a label.
    """
    rows = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    judged = materialise(rows.mapInArrow(_judge_batches, JUDGED.format(id_type=id_type)), "pii")
    models = fit_models(judged)
    schema = f"doc_id {id_type}, " + ", ".join(f"n_{name} bigint" for name in KINDS)
    found = judged.mapInArrow(_redact_batches(models), f"{schema}, base_sha256 string, spans string, n_added bigint")
    return found.withColumnRenamed("doc_id", id_col)


def redact(text: str | None, spans: str) -> str | None:
    """``text`` with each span of ``spans`` replaced by its kind in brackets; of overlapping ones the first counts."""
    if not text or not spans:
        return text
    out, done = [], 0
    for kind, start, end in (span.split(":") for span in spans.split(",")):
        if int(start) >= done:
            out += [text[done : int(start)], f"[{kind}]"]
            done = int(end)
    return "".join(out) + text[done:]
