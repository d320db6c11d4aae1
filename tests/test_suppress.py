"""Suppression: the known scenarios, and any cells against a plain loop."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from veilstream.operators.suppress import as_json, presented, release_global, suppress, suppress_single

SCHEMA = "p int, parent_users long, family string, wiki string, namespace int, events long, users long"


def looped(parent: int, children: list[int], k: int) -> list[tuple]:
    """What must come out, by repeated removal."""
    cells = sorted((u, f"f{i:02d}") for i, u in enumerate(children))
    hidden, shown = [c for c in cells if c[0] < k], [c for c in cells if c[0] >= k]
    total = sum(u for u, _ in hidden) + max(0, parent - sum(children))
    while 0 < total < k and shown:
        total += shown[0][0]
        hidden.append(shown.pop(0))
    out = [("Visible", f, 3 * u, u) for u, f in shown]
    if hidden and total >= k:
        out.append(("Other", None, 3 * sum(u for u, _ in hidden), total))
    return sorted(out, key=repr)


def released(spark, cases: list[tuple[int, list[int]]], k: int) -> dict[int, list[tuple]]:
    rows = [(p, parent, f"f{i:02d}", "*", -1, 3 * u, u) for p, (parent, children) in enumerate(cases) for i, u in enumerate(children)]
    out: dict[int, list[tuple]] = {p: [] for p in range(len(cases))}
    for r in suppress(spark.createDataFrame(rows, SCHEMA), ["p"], k).collect():
        out[r["p"]].append((r["kind"], r["family"], r["events"], r["users"]))
    return {p: sorted(v, key=repr) for p, v in out.items()}


SCENARIOS = [
    (61, [50, 6, 5], [("Other", None, 33, 11), ("Visible", "f00", 150, 50)]),
    (50, [45, 5], [("Other", None, 150, 50)]),
    (60, [55], [("Other", None, 165, 60)]),
    (50, [20, 30], [("Visible", "f00", 60, 20), ("Visible", "f01", 90, 30)]),
    (3, [3], []),
    (30, [12, 12, 6], [("Other", None, 54, 18), ("Visible", "f01", 36, 12)]),
    (10, [20, 4], [("Other", None, 72, 24)]),
    (0, [0, 0], []),
    (80, [30, 30], [("Visible", "f00", 90, 30), ("Visible", "f01", 90, 30)]),
]


@pytest.mark.parametrize("parent,children,want", SCENARIOS)
def test_scenarios(spark, parent, children, want):
    assert released(spark, [(parent, children)], 10)[0] == sorted(want, key=repr)


cases = st.lists(st.tuples(st.integers(0, 19), st.lists(st.integers(0, 79), min_size=1, max_size=11)), min_size=1, max_size=40)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(cases, st.integers(1, 29))
def test_equals_the_loop_and_releases_no_small_count(spark, some, k):
    some = [(sum(children) + residual, children) for residual, children in some]
    got = released(spark, some, k)
    for p, (parent, children) in enumerate(some):
        assert got[p] == looped(parent, children, k)
        assert all(users >= k for *_, users in got[p])


def test_single_and_global(spark):
    cells = spark.createDataFrame([("w1", 0, "*", "*", -1, 9, 4), ("w2", 0, "*", "*", -1, 30, 10)], "window_start string, level int, family string, wiki string, namespace int, events long, users long")
    assert [r["window_start"] for r in suppress_single(cells, 10).collect()] == ["w2"]
    assert [r["window_start"] for r in release_global(cells, 10).collect()] == ["w2"]
    assert {(r["window_start"], r["kind"], r["users"]) for r in release_global(cells, 10, strict=False).collect()} == {("w1", "Other", 4), ("w2", "Visible", 10)}


def test_json_and_order(spark):
    rows = suppress(spark.createDataFrame([(0, 61, "a", "*", -1, 150, 50), (0, 61, "b", "*", -1, 18, 6), (0, 61, "c", "*", -1, 15, 5), (0, 61, "d", "*", -1, 60, 20)], SCHEMA), ["p"], 10)
    assert [r["value"] for r in as_json(presented(rows)).collect()] == [
        '{"kind":"Visible","family":"d","wiki":"*","namespace":-1,"events":60,"users":20}',
        '{"kind":"Visible","family":"a","wiki":"*","namespace":-1,"events":150,"users":50}',
        '{"kind":"Other","events":33,"users":11}',
    ]


def test_plan_forms_no_pairs(spark):
    rows = spark.createDataFrame([(0, 61, "a", "*", -1, 150, 50)], SCHEMA)
    plan = suppress(rows, ["p"], 10)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
