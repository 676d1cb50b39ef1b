"""Mixes: quotas, caps, overlapping sources, sources that can't be met."""

import pytest

from waymark.llm import mixing
from waymark.llm.mixing import allocate, best_total, mix_sources

DOCS = "doc_id bigint, text string, source string, uses int, pattern string"
MIX = "source string, target_share double, max_repeats int, tokens int"


def docs(spark, spec, extra=()):
    rows = [(s * 1000 + i, f"{name} document number {i} about maps " * 4, name, 0, "x") for s, (name, n) in enumerate(spec) for i in range(n)]
    return spark.createDataFrame(rows + list(extra), DOCS)


def result(spark, d, mix, total=None):
    chosen, told = mix_sources(d, spark.createDataFrame([(*m, 0) for m in mix], MIX), total)
    c, t = chosen.collect(), {r.source: r for r in told.collect()}
    caps = {m[0]: m[2] for m in mix}
    assert len({(r.doc_id, r.source) for r in c}) == len(c)
    for r in c:
        assert 1 <= r.uses <= caps[r.source]
    for s, r in t.items():
        assert r.tokens == sum(x.n_tokens * x.uses for x in c if x.source == s)
    return c, t


def test_targets_are_met(spark):
    d = docs(spark, [("a", 300), ("b", 60), ("other", 50), (None, 5)])
    c, t = result(spark, d, [("a", 0.5, 1), ("b", 0.5, 3)])
    assert t["a"].met and t["b"].met and t["b"].most_uses == 3 and abs(t["a"].actual_share - 0.5) < 0.02
    again, _ = result(spark, d, [("a", 0.5, 1), ("b", 0.5, 3)])
    assert sorted(map(tuple, again)) == sorted(map(tuple, c))


def test_repeats_are_even_and_late(spark):
    c, _ = result(spark, docs(spark, [("a", 200), ("b", 100)]), [("a", 0.5, 1), ("b", 0.5, 4)])
    uses = {r.uses for r in c if r.source == "b"}
    assert uses <= {2} or max(uses) - min(uses) <= 1


def test_target_that_cannot_be_met(spark):
    _, t = result(spark, docs(spark, [("a", 300), ("b", 10)]), [("a", 0.5, 1), ("b", 0.4, 2), ("none", 0.1, 3)], "corpus")
    assert not t["b"].met and t["b"].most_uses == 2 and t["b"].n_docs == 10 and not t["none"].met and t["none"].tokens == 0


def test_copies_are_one_document(spark):
    text = "the same text in two sources again and again"
    d = docs(spark, [("a", 40), ("b", 2)], [(9001, text, "a", 0, ""), (9002, text, "b", 0, ""), (9003, text, "b", 0, ""), (9004, None, "a", 0, ""), (9005, "", "b", 0, "")])
    c, _ = result(spark, d, [("a", 0.9, 1), ("b", 0.1, 1)])
    assert sum(r.uses for r in c if r.doc_id in (9001, 9002, 9003)) <= 1 and not {9004, 9005} & {r.doc_id for r in c}


def test_flow_routes_overlap_to_the_poor_source():
    patterns = {"ab": (["a", "b"], 100), "a": (["a"], 100)}
    got = allocate(patterns, {"a": 100, "b": 100}, {"a": 1, "b": 1})
    assert sum(b - a for *_, a, b in got) == 200 and ("ab", 1, "b", 0, 100) in got
    assert best_total(patterns, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 1}) == 201  # quotas are rounded down
    assert best_total({}, {"a": 1.0}, {"a": 1}) == 0


@pytest.mark.parametrize("mix", [[], [("a", None, 1)], [("a", 1.0, 0)], [(None, 1.0, 1)]])
def test_empty_and_void(spark, mix):
    d = docs(spark, [("a", 3)])
    c, _ = result(spark, d, mix)
    assert c == []
    c, t = result(spark, d.limit(0), [("a", 1.0, 1)])
    assert c == [] and t["a"].tokens == 0


def test_long_texts_do_not_spoil_the_shares(spark):
    """One text as long as a third of its source's quota: what it leaves open is filled with shorter ones."""
    long = [(7000 + i, f"{i} very long report about cameras and maps " * 90, "b", 0, "") for i in range(3)]
    d = docs(spark, [("a", 400), ("b", 60)], long)
    for seed in (1, 2, 3):
        chosen, told = mix_sources(d, spark.createDataFrame([("a", 0.7, 1, 0), ("b", 0.3, 2, 0)], MIX), 8000, seed=seed)
        for r in told.collect():
            assert abs(r.tokens - r.target_tokens) <= 0.02 * r.target_tokens, (seed, r)


def test_many_patterns_keep_whole_results(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_PATTERNS", 2)
    shared = [(8000 + 10 * i + j, f"text {i} that several sources have " * 3, s, 0, "") for i in range(40) for j, s in enumerate("abcd") if (i >> j) & 1]
    d = docs(spark, [("a", 50), ("b", 50), ("c", 50), ("d", 50)], shared)
    c, t = result(spark, d, [(s, 0.25, 2) for s in "abcd"])
    assert all(abs(r.tokens - r.target_tokens) <= 0.02 * r.target_tokens for r in t.values())


def test_buckets_of_a_large_pattern(spark, monkeypatch):
    """Prefix sums over buckets and groups of buckets give the same choice as one bucket."""
    d = docs(spark, [("a", 500), ("b", 300)])
    mix = [("a", 0.5, 1), ("b", 0.5, 2)]
    want, _ = result(spark, d, mix)
    monkeypatch.setattr(mixing, "TEXTS_OF_BUCKET", 8)
    got, _ = result(spark, d, mix)
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_a_text_counts_for_all_its_sources_however_many_patterns(spark, monkeypatch):
    """More combinations than are broadcast: what every source has and gets is the same."""
    shared = [(8000 + 10 * i + j, f"text {i} that several sources have " * 3, s, 0, "") for i in range(40) for j, s in enumerate("abcd") if (i >> j) & 1]
    d = docs(spark, [("a", 20), ("b", 20), ("c", 5)], shared)
    mix = [(s, 0.25, 2) for s in "abcd"]
    want = result(spark, d, mix)
    monkeypatch.setattr(mixing, "MOST_PATTERNS", 2)
    got = result(spark, d, mix)
    assert got[1] == want[1] and sorted(map(tuple, got[0])) == sorted(map(tuple, want[0]))
    assert got[1]["d"].available_tokens == sum(r.n_tokens for r in mixing._units(d, spark.createDataFrame([(*m, 0) for m in mix], MIX), mixing.TOKENIZERS, "byte_bpe_50k", 11).filter("pattern like '%\"d\"%'").collect())


def test_flow_over_ten_thousand_patterns():
    """14 sources in 10,000 combinations: quotas are met as far as a cut allows, within seconds."""
    names = [chr(97 + i) for i in range(14)]
    patterns = {f"{n:05}": ([s for i, s in enumerate(names) if n >> i & 1], 1 + n % 97) for n in range(1, 10_001)}
    repeats = {s: 1 + i % 3 for i, s in enumerate(names)}
    shares = dict.fromkeys(names, 1 / 14)
    total = best_total(patterns, shares, repeats)
    got = allocate(patterns, {s: int(total / 14) for s in names}, repeats)
    assert sum(b - a for *_, a, b in got) == 14 * int(total / 14)
    assert all(r <= repeats[s] and s in patterns[p][0] and 0 <= a < b <= patterns[p][1] for p, r, s, a, b in got)
