import hashlib
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanforge import api
from spanforge.operators import features, generator, lineage, observations, probes, ranking, similarity, vocabulary

OBS = "model_name string, family string, ord int, probe_id string, category string, seq bigint, output_text string, error string"


def obs(spark, rows):
    """rows: (model, probe, seq, text, error)."""
    ords = {}
    return spark.createDataFrame([(m, "f" + m[0], ords.setdefault(m, len(ords)), p, "c", s, t, e) for m, p, s, t, e in rows], OBS)


def test_surface_rates(spark):
    r = features.surface(obs(spark, [("a", str(i), i, t, None) for i, t in enumerate([" the", "你", "\n", ""])])).first()
    assert (r.leading_space_rate, r.leading_newline_rate, r.empty_rate) == (0.25, 0.25, 0.25)
    assert r.bytes_per_char == pytest.approx((1 + 3 + 1) / 3)


def test_transitions_are_conditional(spark):
    rows = obs(spark, [("a", "1", 1, "x", None), ("a", "2", 2, "你", None), ("a", "3", 3, "y", None)])
    got = {(r.category, r.token_type): r.share for r in features.transitions(rows, spark.createDataFrame([("1", "k"), ("2", "k")], "probe_id string, category string")).collect()}
    assert got == {("k", "latin"): 0.5, ("k", "cjk"): 0.5, ("unknown", "latin"): 1.0}


def test_first_valid_result_wins(spark):
    rows = obs(spark, [("a", "1", 1, "bad", "e"), ("a", "1", 3, "late", None), ("a", "1", 2, "first", None)])
    assert observations.first_results(rows, "output_text").first().output_text == "first"


def test_pair_scores(spark):
    same = [("a", "1", 1, "x", None), ("b", "1", 1, "y", None), ("a", "2", 2, " x", None), ("b", "2", 2, "xx", None), ("a", "3", 3, "q", None)]
    r = similarity.pair_scores(obs(spark, same)).first()
    assert (r.common_probe_count, r.bcs, r.char_length_match_rate, r.token_type_match_rate) == (2, 0.5, 1.0, 0.5)
    s = similarity.soft_pair_scores(obs(spark, same)).first()
    assert s.score == pytest.approx(0.60 * 0.5 + 0.07 + 0.07 + 0.16 * 0.5 + 0.07 * 0.5 + 0.03)


def test_soft_weights():
    assert sum(similarity.soft_weights({"other": 1.0}).values()) == pytest.approx(1) and similarity.soft_weights({"other": 1.0})["exact"] == pytest.approx(0.3)
    assert similarity.soft_weights({k: 0 for k in similarity.SOFT_WEIGHTS}) == similarity.SOFT_WEIGHTS


def test_bootstrap_exact_near_closed(spark):
    rows = [(m, str(i), i, "x" if m == "a" or i % 3 else "yy", None) for i in range(300) for m in "ab"]
    o = obs(spark, rows)
    a, b = similarity.bootstrap_exact(o).first(), similarity.bootstrap_closed(similarity.pair_scores(o)).first()
    assert a.bootstrap_mean == pytest.approx(b.bootstrap_mean, abs=0.01) and a.bootstrap_std == pytest.approx(b.bootstrap_std, rel=0.3)


def test_stability(spark):
    rows = [("a", "1", i, t, None) for i, t in enumerate(["the", "the", "a"])] + [("a", "2", 9, "x", None)]
    assert similarity.stability(obs(spark, rows)).first().stability_variance == 1.0
    assert similarity.stability_modal(obs(spark, rows)).first().stability_modal == pytest.approx(1 / 3)


def pairs(spark, rows):
    ords = {m: i for i, m in enumerate(dict.fromkeys(x for r in rows for x in r[:2]))}
    return spark.createDataFrame([(a, a[0], ords[a], b, b[0], ords[b], s, s, 1000) for a, b, s in rows], "model_a string, family_a string, ord_a int, model_b string, family_b string, ord_b int, score double, bcs double, common_probe_count bigint")


def test_bank_statistics_use_index_percentile(spark):
    p = pairs(spark, [(f"a{i}", f"b{i}", i / 100) for i in range(30)] + [("a0", "a1", 1.0)])
    r = similarity.bank_statistics(p).first()
    assert (r.n_cross_pairs, r.p95, r.p99, r.max, r.n_models) == (30, 0.28, 0.29, 0.29, 60)


def test_neighbour_ties_keep_bank_order(spark):
    p = pairs(spark, [("a", "b", 0.5), ("a", "c", 0.5), ("b", "c", 0.1)])
    assert [r.neighbour for r in similarity.neighbours(p).where("model = 'a'").orderBy("rank").collect()] == ["b", "c"]


def test_decision(spark):
    low = [(f"x{i}", f"y{j}", 0.2 + 0.01 * i) for i in range(3) for j in range(3)]
    r = similarity.decide(pairs(spark, [("t", "x0", 0.9), ("t", "x1", 0.6), ("t", "y0", 0.2), *low]), "t").first()
    assert (r.label, r.same_source_of, r.evidence_for, r.confidence) == ("same_source", "x0", 5, 0.9)
    r = similarity.decide(pairs(spark, [("t", "x0", 0.21), ("t", "y1", 0.21), ("t", "z0", 0.2), *low]), "t", 0.5).first()
    assert r.label == "not_same_source" and r.evidence_against == 5 and r.confidence == 0.95


def test_summary_rule(spark):
    got = {r.model: r.same_source for r in similarity.bank_summary(pairs(spark, [("a", "b", 0.6), ("a", "c", 0.55), ("b", "c", 0.2)])).collect()}
    assert got == {"a": False, "b": True, "c": True}


def test_vocabulary_pairs(spark):
    rows = [("a", str(i), i, t, None) for i, t in enumerate("xxxxy")] + [("b", str(i), i, t, None) for i, t in enumerate("xz")]
    r = vocabulary.pairs(obs(spark, rows)).first()
    assert (r.jaccard, r.coverage_a_to_b, r.weighted_jaccard, r.rare_token_jaccard) == (pytest.approx(1 / 3), 0.5, pytest.approx(1 / 6), 0.0)
    with pytest.raises(ValueError):
        vocabulary.pairs(obs(spark, rows), {"jaccard": 0.0})


def test_pending_counts(spark):
    required = spark.createDataFrame([("1", 2), ("2", 1), ("3", 3)], "probe_id string, required int")
    got = observations.pending(required, obs(spark, [("a", "1", 1, "", None), ("a", "2", 1, "", None), ("a", "3", 1, "", "e")]), "a")
    assert sorted((r.probe_id, r.attempt) for r in got.collect()) == [("1", 1), ("3", 1), ("3", 2), ("3", 3)]


def test_merge_first_wins(spark):
    a, b = (spark.createDataFrame(x, "probe_id string, seq bigint, v string") for x in ([("1", 5, "a5"), ("1", 2, "a2")], [("1", 0, "b0"), ("2", 1, "b1")]))
    assert sorted((r.probe_id, r.v) for r in observations.merge(a, b).collect()) == [("1", "a2"), ("2", "b1")]


def test_lineage(spark):
    vocab = [(m, t, i) for m in ("A", "B") for i, t in enumerate("abc")] + [("C", t, i) for i, t in enumerate("xyz")]
    enc = [(m, s, [1]) for m in "AB" for s in "12"] + [("C", s, [2]) for s in "12"]
    meta = spark.createDataFrame([("A", "Fam", 0, "chat", 20, "s"), ("B", "Fam", 1, "base", 10, "s"), ("C", "Fam", 2, "base", 1, "s")], "name string, family string, ord int, role string, preferred_rank int, special_tokens string")
    out = api.tokenizer_baselines(spark.createDataFrame(vocab, "model string, token string, id int"), spark.createDataFrame(enc, "model string, sample string, ids array<int>"), meta)
    labels = {(r.model_a, r.model_b): r.equivalence_label for r in out["pairs"].collect()}
    assert labels == {("A", "B"): "hard_equivalent", ("A", "C"): "distinct", ("B", "C"): "distinct"}
    assert sorted((r.baseline_id, r.representative, r.members) for r in out["registry"].collect()) == [("fam__primary", "B", 2), ("fam__variant_01", "C", 1)]
    assert {r.lineage: r["mean"] for r in out["metrics"].collect()} == {"A": 1.0, "C": 1.0}
    assert lineage.invalid_entries(spark.createDataFrame([("x", "f", "i", "hf", "", "", "base")], "name string, family string, model_id string, source string, local_dir string, encoding string, role string")).first().problem == "no local_dir"


def test_spans_have_true_offsets(spark):
    text = "Die Bundesregierung hat gestern eine Entscheidung-über Donaudampfschiffe getroffen. Zweiter Satz mit Wörterbuchern!\n\nAbsatz zwei, Überraschungen."
    de = probes.LANGUAGES["de"]
    rows = probes.spans(probes.fragments(spark.createDataFrame([(text,)], "text string"), de), de).collect()
    assert len(rows) >= 12 and all(r.fragment[r.offset : r.offset + len(r.span)] == r.span for r in rows)
    got = probes.candidates(spark.createDataFrame([(text,)], "text string"), de).collect()
    assert got and all(r.probe_text.endswith(r.prefix) and 4 <= len(r.probe_text) <= 140 for r in got)
    assert {len(r.probe_text.split()) for r in got} <= set(range(1, 8))


def test_chinese_windows(spark):
    zh = probes.LANGUAGES["zh"]
    rows = probes.spans(spark.createDataFrame([("中" * 40,)], "fragment string"), zh).orderBy("offset").collect()
    assert [r.offset for r in rows] == [0, 8, 16, 24, 32] and [len(r.span) for r in rows] == [16, 16, 16, 16, 8]


def test_allocation_and_draw(spark):
    assert probes.allocate(100, {"a": 1, "b": 1, "c": 1}) == {"a": 34, "b": 33, "c": 33}
    pool = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z")], "category string, text string")
    rows = probes.draw(pool, 20, {"a": 1.0, "b": 1.0}, 7).collect()
    assert len(rows) == 20 and len({r.probe_id for r in rows}) == 20


def test_normalize(spark):
    df = spark.createDataFrame([("ﬁ a​b\x07c \t x ",)], "t string")
    assert df.select(probes.normalize(F.col("t"))).first()[0] == "fi ab c x"


def test_api(spark):
    rows = [(m, str(i), i, "x" if (i + k) % 4 else "yy", None) for i in range(40) for k, m in enumerate(("a1", "a2", "b1", "b2"))]
    bank = obs(spark, rows)
    out = api.compare_bank(bank)
    assert out["pairs"].count() == 6 and out["summary"].count() == 4
    assert api.detect(bank, "a1").count() == 1 and api.detect(bank, "a1", method="soft").count() == 1
    dead = spark.createDataFrame([("z", "f", 9)], "model_name string, family string, ord int")
    with pytest.raises(ValueError):
        api.build_bank(obs(spark, [("z", "1", 1, "", "e")]), dead)


def test_generated_probes(spark):
    draw = lambda n, *parts: int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16) % n
    want = set()
    for k, n in probes.allocate(300, generator.WEIGHTS).items():
        texts = generator.TEMPLATES[k]
        for i in range(n):
            text, ratio = texts[draw(len(texts), k, i, "text", 42)], generator.RATIOS[draw(4, k, i, "ratio", 42)]
            if k == generator.PARTIAL:
                ratio = 0.0
            else:
                text = text[: max(1, int(len(text) * ratio))]
            want.add((f"{k}_{hashlib.md5(f'{k}|{i}|42'.encode()).hexdigest()[:12]}", text, k, ratio, generator.LANGUAGE.get(k, "mixed")))
    rows = generator.generate(spark, 300).collect()
    assert len(rows) == 300 and {tuple(r) for r in rows} == want
    with pytest.raises(ValueError):
        generator.generate(spark, 10, {"poetry": 1.0})


def test_numbers_in_blocks(spark):
    rows = spark.createDataFrame([(i % 3, i % 7, str(i)) for i in range(200)] + [(None, 1, "x"), (None, 2, "y")], "g int, n int, t string")
    got = {(r.g, r.t): r.k for r in ranking.numbered(rows, ["g"], [F.col("n")], [F.col("t")], "k").collect()}
    for g in (0, 1, 2, None):
        mine = sorted(((r.n, r.t) for r in rows.collect() if r.g == g))
        assert [got[g, t] for _, t in mine] == list(range(1, len(mine) + 1))


def test_exact_bootstrap_by_force(spark):
    rng = np.random.RandomState(1)
    hits = rng.rand(50) < 0.6
    o = obs(spark, [(m, f"{i:03}", i, "x" if m == "a" or hits[i] else "yy", None) for i in range(50) for m in "ab"])
    r = similarity.bootstrap_exact(o, target="b").first()
    draws = np.random.RandomState(42)
    means = [hits[draws.choice(50, 40, replace=True)].mean() for _ in range(100)]
    assert (r.bootstrap_mean, r.bootstrap_std) == (pytest.approx(np.mean(means)), pytest.approx(np.std(means)))
    assert api.detect(o, "b").count() == 1


def test_chains_of_tokenizers_are_one_lineage(spark):
    rows = [("a", "b", "near_equivalent"), ("b", "c", "hard_equivalent"), ("a", "c", "distinct"), ("c", "d", "distinct")]
    pairs_ = spark.createDataFrame([(a, b, True, label) for a, b, label in rows], "model_a string, model_b string, same_family boolean, equivalence_label string")
    meta = spark.createDataFrame([(x, "f") for x in "dcba"], "name string, family string")
    assert {r.name: r.lineage for r in lineage.components(pairs_, meta).collect()} == {"a": "a", "b": "a", "c": "a", "d": "d"}


def test_context_is_linear_and_exact(spark):
    """Contexts by definition, on odd white space, and a fragment of a megabyte in seconds."""
    de = probes.LANGUAGES["de"]
    rng = random.Random(2)
    texts = ["".join(rng.choice(["Wort", "bau-teil", " ", "  ", "\t", "\u2003", "1", ",", "é", "\u3000", "x’y"]) for _ in range(rng.randint(1, 120))) for _ in range(80)]
    rows = probes.spans(spark.createDataFrame([(t.strip(" \t"),) for t in texts], "fragment string"), de).collect()
    for r in rows:
        words = list(re.finditer(r"\S+", r.fragment[: r.offset]))
        start = words[-6].start() if len(words) > 6 else 0
        assert r.fragment[r.offset : r.offset + len(r.span)] == r.span and r.context == r.fragment[start : r.offset]
    want = sum(len(re.findall(r"[a-zA-Zé]+(?:[’'-][a-zA-Zé]+)*", t)) for t in texts)
    assert len(rows) == want
    began = time.time()
    assert probes.spans(spark.createDataFrame([("Wort-bau kommt, " * 60_000,)], "fragment string"), de).count() == 120_000 and time.time() - began < 20


def test_spans_of_pieces_and_long_words(spark):
    """Fragments cut in pieces, in words, and words cut again, by definition; and short spans left out."""
    de = probes.LANGUAGES["de"]
    rng = random.Random(3)
    some = lambda n, words: "".join(rng.choice(words) + rng.choice([" ", " ", "  ", " "]) for _ in range(n)) + "end"
    plain = " ".join(rng.choice(["Wort", "Bau-teil", "12,", "über", "l’Europe", "Überraschungen"]) for _ in range(400))
    texts = [plain, some(300, ["Wort", "x-y", "1.5"]), some(60, ["a,bé;" * 30, "Wort"]), "word " * 7 + "ab,cdefghij." * 300 + " end", "a" * 3000 + " b", "x-" * 700 + "y z"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, fragment string")
    want = set()
    for i, t in enumerate(texts):
        for m in re.finditer("[a-zA-Zéü\xdc]+(?:[’'-][a-zA-Zéü\xdc]+)*", t):
            words = list(re.finditer(r"\S+", t[: m.start()]))
            want.add((i, m[0], m.start(), t[words[-6].start() if len(words) > 6 else 0 : m.start()]))
    got = [(r.i, r.span, r.offset, r.context) for r in probes.spans(rows, de).collect()]
    assert len(got) == len(want) and set(got) == want
    assert {(r.i, r.span, r.offset, r.context) for r in probes.spans(rows, de, 8).collect()} == {x for x in want if len(x[1]) >= 8}


def test_classes_hold_what_scripts_hold(spark):
    from spanforge.functions import text as T

    chars = spark.range(1, 0x30000).where("id not between 55296 and 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c")).where("c <> ''")  # U+FEFF is read as a mark of byte order
    for script in ("Latin", "Arabic", "Han"):
        assert chars.where(F.col("c").rlike(rf"[{T.script_class(script)}]") != F.col("c").rlike(rf"\p{{Is{script}}}")).count() == 0
    assert chars.where(F.col("c").rlike(rf"[{probes._letters('Latin')}]") != F.col("c").rlike(r"[\p{IsLatin}\p{M}]")).count() == 0
    assert chars.where((T.strip(F.col("c")) == "") != F.col("c").rlike(rf"\A{T.WS}\z")).count() == 0
