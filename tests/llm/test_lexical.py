import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from fleetspectra.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_terms(text):
    return TERM.findall((text or "").translate(FOLD))


def plain(docs, items, k):
    """(id, text) rows of both -> (item, rank, doc, score), every document scored."""
    counts = [(doc_id, Counter(plain_terms(text))) for doc_id, text in docs]
    n_docs = sum(1 for _, c in counts if c)
    n_terms = sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item_id, text in items:
        scored = []
        for doc_id, c in counts:
            n = sum(c.values())
            score = 0
            for t in set(plain_terms(text)) & c.keys():
                m = 100 - 50 + (50 * n * n_docs) // n_terms
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0))
        out += [(item_id, rank, None if s[1] else s[2], -s[0]) for rank, s in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def run(docs, items, **options):
    found = lexical.search(docs, items, **options)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in found.collect()), key=str)


def made(n, seed=3):
    """Documents of Zipf-like words, a third of them copies of one text."""
    dice = random.Random(seed)
    words = [f"{'wÖé'[i % 3]}{i}" for i in range(300)]
    draw = lambda size: " ".join(words[min(299, int(dice.paretovariate(0.7)) - 1)] for _ in range(size))
    rows = [(i, draw(dice.randint(0, 60)).title()) for i in range(n)]
    return rows + [(n + i, "the same-old w3 Ö4 text") for i in range(n // 2)], [(i, draw(dice.randint(1, 25))) for i in range(12)]


@pytest.mark.parametrize("options", [{}, {"segment_postings": 300, "leaf": 1}, {"block_terms": 20, "segment_postings": 3000, "leaf": 20}])
def test_equal_to_scoring_every_document(spark, options):
    docs, items = made(400)
    items += [(50, "the same old text"), (51, ""), (52, None), (53, "nowhere")]
    got = run(
        spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5), spark.createDataFrame(items, "item_id int, text string"), k=10, **options
    )
    assert got == plain(docs, items, 10)


def test_ties_repeats_nulls_and_other_columns(spark, odd, none):
    items = spark.createDataFrame([(1, "lorem ipsum eleven"), (1, "zwei ÖäÜ 12"), (None, "dolor")], "item_id int, text string")
    docs, asked = [(r.doc_id, r.text) for r in odd.collect()], [(r.item_id, r.text) for r in items.collect()]
    assert run(odd, items, k=3) == plain(docs, asked, 3)
    assert run(none, items) == [] and run(odd, items.where("false")) == []


def test_range_maxima_are_those_of_the_lists():
    dice = np.random.default_rng(5)
    term, doc = np.divmod(np.flatnonzero(dice.random(40 * 97) < 0.4), 97)
    segment = lexical.Segment(97, 40, term, doc, dice.integers(1, 50, len(doc)))
    for t in range(40):
        a, b = segment.edges[t], segment.edges[t + 1]
        lo = dice.integers(a, b + 1, 30)
        hi = np.minimum(b, lo + dice.integers(0, 40, 30))
        value, place = segment.greatest(lo, hi)
        for x, y, v, p in zip(lo, hi, value, place):
            assert v == segment.impacts[x:y].max(initial=0) and (p == -1) == (x == y) and (p < 0 or segment.impacts[p] == v and x <= p < y)
