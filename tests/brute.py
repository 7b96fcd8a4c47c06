"""Plain Python versions of the scores, for small collections."""

from __future__ import annotations

import math
import re
from collections import Counter

from lineseek.functions.text import ENGLISH_STOPWORDS


def words(text):
    return [w for w in re.findall("[a-z0-9_]+", text.lower()) if w not in ENGLISH_STOPWORDS]


def cosine(a, b):
    if a is None or b is None:
        return 0.0
    n = min(len(a), len(b))
    a, b = a[:n], b[:n]
    norms = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b)) / norms if norms else 0.0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def title_match(query, title):
    q, t = query.lower(), title.lower()
    longer = max(len(q), len(t))
    return (longer - distance(q, t)) / longer if t else 0.0


class Corpus:
    """``docs``: (id, title, content, content_vec, title_vec)."""

    def __init__(self, docs):
        self.docs = docs
        self.tf = {d[0]: Counter(words(d[2]) + words(d[1]) * 3) for d in docs}
        self.df = Counter(term for counts in self.tf.values() for term in counts)
        self.n = len(docs)
        self.average = sum(sum(c.values()) for c in self.tf.values()) / self.n

    def tfidf(self, terms, doc_id):
        return sum(
            self.tf[doc_id][t] * (1 + math.log(self.n / (1 + self.df[t]))) for t in terms if t in self.tf[doc_id]
        )

    def bm25(self, terms, doc_id):
        total, length = 0.0, sum(self.tf[doc_id].values())
        for t in terms:
            tf, df = self.tf[doc_id][t], self.df[t]
            if tf:
                idf = math.log(1 + (self.n - df + 0.5) / (df + 0.5))
                total += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / self.average))
        return total

    def search(self, query, vec, limit=10, threshold=0.5, w=0.7, tw=0.3, scoring="tfidf", extra=(), decimals=6):
        terms = set(words(query)) | set(extra)
        score = self.tfidf if scoring == "tfidf" else self.bm25
        keyword = {d[0]: score(terms, d[0]) for d in self.docs}
        best = max(keyword.values()) or 1
        found = []
        for doc_id, title, _, content_vec, title_vec in self.docs:
            total = (
                cosine(vec, content_vec) * w
                + keyword[doc_id] / best * (1 - w)
                + (cosine(vec, title_vec) + title_match(query, title)) / 2 * tw
            )
            found.append((-round(total, decimals), doc_id))
        found = [(d, -s) for s, d in sorted(found) if threshold is None or -s >= threshold]
        return found if limit is None else found[:limit]
