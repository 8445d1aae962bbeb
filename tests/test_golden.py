"""A published bank of eleven models: statistics and neighbours of its 55 pair scores."""

import pytest

from spanforge.operators import similarity

# Family of each model in bank order, and (model, model, score) in order of score.
FAMILIES = "qqqqqqqllll"
PAIRS = [
    (7, 9, 0.832502), (5, 6, 0.717328), (0, 4, 0.667976), (4, 9, 0.584402), (4, 7, 0.580022), (0, 9, 0.575258), (8, 10, 0.574846), (0, 7, 0.570634),
    (3, 5, 0.532546), (1, 3, 0.526348), (3, 10, 0.525398), (3, 6, 0.52247), (6, 10, 0.520016), (5, 10, 0.517436), (1, 5, 0.514), (1, 10, 0.512658),
    (1, 6, 0.508284), (1, 8, 0.442822), (6, 8, 0.424358), (3, 8, 0.423156), (5, 8, 0.419428), (2, 6, 0.375648), (3, 4, 0.36326), (0, 3, 0.361782),
    (0, 1, 0.35516), (7, 10, 0.354516), (9, 10, 0.354382), (0, 5, 0.34552), (1, 4, 0.344694), (4, 5, 0.340982), (3, 9, 0.340196), (3, 7, 0.33985),
    (0, 6, 0.334426), (0, 10, 0.33368), (2, 8, 0.332732), (4, 10, 0.329758), (4, 6, 0.329338), (5, 7, 0.328534), (5, 9, 0.32826), (2, 10, 0.32811),
    (1, 7, 0.325624), (1, 9, 0.325414), (2, 5, 0.319308), (6, 9, 0.318978), (6, 7, 0.318708), (2, 3, 0.313256), (1, 2, 0.312912), (7, 8, 0.310348),
    (8, 9, 0.30935), (0, 8, 0.298958), (4, 8, 0.29696), (0, 2, 0.251856), (2, 4, 0.25087), (2, 7, 0.246866), (2, 9, 0.246266),
]


@pytest.fixture(scope="module")
def pairs(spark):
    rows = [(f"m{a:02}", FAMILIES[a], a, f"m{b:02}", FAMILIES[b], b, s, s, 500_000) for a, b, s in PAIRS]
    return spark.createDataFrame(rows, "model_a string, family_a string, ord_a int, model_b string, family_b string, ord_b int, score double, bcs double, common_probe_count bigint")


def test_bank_statistics(pairs):
    r = similarity.bank_statistics(pairs).first()
    assert (r["mean"], r["std"], r.p95, r.p99, r["max"]) == (pytest.approx(0.397660071, abs=1e-9), pytest.approx(0.107960034, abs=1e-9), 0.580022, 0.584402, 0.584402)
    assert (r.n_cross_pairs, r.n_models) == (28, 11)


def test_seven_of_eleven_pass_the_bank_rule(pairs):
    rows = similarity.bank_summary(pairs).collect()
    assert len(rows) == 11 and sum(r.same_source for r in rows) == 7
    best = max(rows, key=lambda r: (r.top1_score, r.margin))
    assert (best.top1_score, best.margin) == (0.832502, pytest.approx(0.25248))


def test_neighbours_are_complete(pairs):
    near = similarity.neighbours(pairs, None).collect()
    assert len(near) == 110 and max(r.rank for r in near) == 10


def test_verdict_on_the_closest_pair(pairs):
    a, b, _ = PAIRS[0]
    r = similarity.decide(pairs, f"m{b:02}").first()
    assert r.label == "same_source" and r.same_source_of == f"m{a:02}"
