import pytest

from loomspan.llm import mixing, queries


def docs(spark, rows):
    return spark.createDataFrame(rows, "id long, source string, tokens long")


def targets(spark, rows):
    return spark.createDataFrame(rows, "source string, weight double, max_repeats int")


def check(spark, rows, aims, total=None, tolerance=0.02):
    d, t = docs(spark, rows), targets(spark, aims)
    chosen = mixing.mix(d, t, "id", "source", "tokens", total=total).collect()
    sizes = {i: (s.strip().lower() if s else None, n) for i, s, n in rows}
    assert len({r.id for r in chosen}) == len(chosen)
    caps = {s.strip().lower(): m for s, _, m in aims}
    used: dict = {}
    for r in chosen:
        assert 1 <= r.repeats <= caps[sizes[r.id][0]]
        used[r.source] = used.get(r.source, 0) + r.repeats * sizes[r.id][1]
    return chosen, used


def test_shares_and_caps(spark):
    rows = [(i, " A " if i % 2 else "a", 5 + i % 90) for i in range(4000)] + [(i, "B", 50) for i in range(5000, 5100)] + [(9000, None, 10), (9001, "none", 10), (9002, "a", 0)]
    chosen, used = check(spark, rows, [("a", 0.6, 1), ("b", 0.2, 3), ("gone", 0.2, 9)], total=60_000)
    assert used["b"] == 15_000
    assert abs(used["a"] - 45_000) <= 50
    assert {r.id for r in chosen}.isdisjoint({9000, 9001, 9002})


def test_a_scarce_source_does_not_bound_the_mix(spark):
    """By default the total is the size of the sources; what a source at its limit can't give, the others do by weight."""
    rows = [(i, "a", 10) for i in range(3000)] + [(i, "b", 10) for i in range(3000, 5000)] + [(9000, "c", 20)]
    _, used = check(spark, rows, [("a", 0.4, 2), ("b", 0.2, 4), ("c", 0.4, 3)])
    assert used["c"] == 60
    assert abs(used["a"] - (50_020 - 60) * 2 / 3) <= 5 and abs(used["b"] - (50_020 - 60) / 3) <= 5


def level(total, most, weights):
    """Brute force: the level at which all shares, cut at their limits, sum to the total."""
    low, high = 0.0, 1e12
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(m, mid * w) for m, w in zip(most, weights)) < total else (low, mid)
    return [min(m, low * w) for m, w in zip(most, weights)]


@pytest.mark.parametrize("total", [None, 1, 100, 5_000, 60_000, 10**9])
def test_plan_against_brute_force(spark, total):
    sizes = [("a", 900), ("b", 40), ("c", 7000), ("d", 300), ("e", 0)]
    aims = [("a", 0.3, 2), ("b", 0.2, 5), ("c", 0.1, 1), ("d", 0.25, 1), ("e", 0.1, 3), ("f", 0.05, 3)]
    got = {r.source: r.budget for r in mixing.plan(spark.createDataFrame(sizes, "source string, tokens long"), targets(spark, aims), total).collect()}
    most = [dict(sizes).get(s, 0) * m for s, _, m in aims]
    want = level(min(8240 if total is None else total, sum(most)), most, [w for _, w, _ in aims])
    assert got == pytest.approx(dict(zip((s for s, _, _ in aims), want)), rel=1e-6, abs=1e-6)


def test_whole_copies_are_certain(spark):
    rows = [(i, "a", 10) for i in range(1000)] + [(i, "b", 10) for i in range(1000, 1100)]
    chosen, used = check(spark, rows, [("a", 0.5, 1), ("b", 0.5, 10)], total=5000)
    assert used == {"a": 2500, "b": 2500}
    repeats = sorted(r.repeats for r in chosen if r.source == "b")
    assert repeats == [2] * 50 + [3] * 50


def test_a_total_beyond_the_caps_is_cut(spark):
    chosen, used = check(spark, [(1, "a", 10), (2, "b", 10)], [("a", 0.5, 2), ("b", 0.5, 1)], total=1000)
    assert used == {"a": 20, "b": 10}


def test_sample_is_stable(spark):
    rows, aims = [(i, "a", 1 + i % 7) for i in range(3000)], targets(spark, [("a", 1.0, 1)])
    picks = [{r.id for r in mixing.mix(docs(spark, rows).repartition(seed + 1), aims, "id", "source", "tokens", total=6000, seed=seed).collect()} for seed in range(2)]
    again = {r.id for r in mixing.mix(docs(spark, rows[::-1]), aims, "id", "source", "tokens", total=6000, seed=0).collect()}
    assert again == picks[0] != picks[1]


def test_inclusion_frequencies_are_in_proportion_to_size(spark):
    """The same sizes in 150 sources are 150 draws. The largest documents are certain, the others come as often as their size asks."""
    sizes = [1, 2, 3, 4, 5, 8] * 40 + [60, 70]
    rows = [(1000 * s + i, f"s{s}", t) for s in range(150) for i, t in enumerate(sizes)]
    aims = [(f"s{s}", 1 / 150, 1) for s in range(150)]
    chosen, used = check(spark, rows, aims, total=150 * 400)
    assert all(abs(n - 400) <= 4 for n in used.values())
    rate = (400 - 130) / sum(t * t for t in sizes if t < 60)
    for t in sorted(set(sizes)):
        drawn = sum(1 for r in chosen if r.tokens == t) / (150 * sizes.count(t))
        assert abs(drawn - min(1, rate * t)) < 0.02, t


@pytest.mark.parametrize("aims", [[], [("a", 0.0, 1)], [(None, 1.0, 1)], [("b", 1.0, 1)]])
def test_nothing_to_mix(spark, aims):
    assert mixing.mix(docs(spark, [(1, "a", 10)]), targets(spark, aims), "id", "source", "tokens").count() == 0


def test_queries(spark, small, empty_folder, dirty_folder):
    rows = {r.source: r for r in queries.p9_shares(spark, small).collect()}
    assert sum(r.actual_share for r in rows.values()) == pytest.approx(1)
    assert all(r.max_used <= r.max_repeats for r in rows.values())
    assert {tuple(r) for r in queries.p9_mix(spark, dirty_folder).collect()} == {tuple(r) for r in queries.p9_mix(spark, small).collect()}
    assert queries.p9_mix(spark, empty_folder).count() == 0
    queries.p9_shares(spark, empty_folder).collect()
