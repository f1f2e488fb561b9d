"""The filter audit beside a plain run of every order."""

import collections
import itertools
import re

import numpy as np
import pytest

from larkspur.llm import interactions
from tests.llm import fixtures

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture()
def rows():
    extra = [(3000, "# tag & more", "en", None, 0), (3001, "# tag & more", "en", "", 0), (3002, "THE END OF IT", "en", "s1", 0),
             (3003, "same same same same same", "en", "s2", 0), (None, "# tag & more", "en", "s2", 0)]
    return fixtures.documents() + extra


LABELS = [(3, 1, 0), (3, 0, 1), (3, 1, None), (2001, 1, 0), (2002, None, None), (3000, 0, 1), (None, 1, 1), (3003, 1, 1), (999999, 1, 1)]


def plain(rows, labels):
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    parts = collections.defaultdict(list)
    for i, t, _, source, _ in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
                 "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and t in first and first[t] < i}
        parts[source or ""].append(({k for k, v in fails.items() if v}, i in good, i in toxic))
    out = set()
    for part, docs in parts.items():
        shapley = collections.Counter()
        lines = []
        for order in itertools.permutations("ABCDE"):
            left = docs
            for k, f in enumerate(order):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                shapley[f] += len(gone)
                lines.append((part, "".join(order), k + 1, len(left), len(gone), sum(f in d[0] for d in docs) - len(gone), sum(d[0] == {f} for d in docs),
                              sum(d[1] for d in gone), sum(d[2] for d in gone), f))
        out |= {(*x[:-1], shapley[x[-1]]) for x in lines}
    return out


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


@pytest.mark.parametrize("block", [7, interactions.BLOCK])
def test_audit_equals_a_run_of_every_order(spark, rows, block):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    flagged = interactions.flagged(fixtures.frame(spark, rows), labels)
    got = interactions.audit(flagged, block=block).select(*COLUMNS).collect()
    want = plain(rows, LABELS)
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert all(any(x[i] for x in want) for i in range(3, 10))


def test_empty_tables(spark, rows):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert interactions.audit(interactions.flagged(fixtures.frame(spark, []), none)).count() == 0
    got = interactions.audit(interactions.flagged(fixtures.frame(spark, rows), none))
    assert got.where("good_lost + toxic_lost > 0").count() == 0 and got.count() == 600 * 4


def test_galloping_search_and_merge():
    rng = np.random.default_rng(3)
    for top in (1, 3, 50, 3000):
        for _ in range(60):
            a, b = (np.unique(rng.integers(0, top, rng.integers(0, 900))) for _ in range(2))
            assert (interactions.gallop(a, b) == np.searchsorted(a, b)).all()
            both, fresh = interactions.merge(a, b)
            assert (both == np.union1d(a, b)).all() and (fresh == np.setdiff1d(b, a)).all()
