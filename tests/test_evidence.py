"""The fold against hand-made cases and against a plain model on random evidence."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from chronofold import schemas as S
from chronofold.operators import evidence as E
from chronofold.operators import lifecycle as L
from chronofold.plans import summary as Y
from pyspark.sql import functions as F

T0 = datetime(2024, 1, 1)
OBS = "url_id string, observer string, observation_time timestamp, status string, content_digest string, content_length bigint"
CAP = "url_id string, archive string, capture_time timestamp, status string, digest string, content_length bigint"


def frames(spark, obs, cap, years=None):
    return spark.createDataFrame(obs, OBS), spark.createDataFrame(cap, CAP), E.established_table(spark, years or {})


def state(spark, obs, cap, years=None, threshold=2, changes=True):
    o, c, e = frames(spark, [("u", *x) for x in obs], [("u", *x) for x in cap], years)
    urls = L.with_risks(L.per_url(E.per_witness(E.evidence(o, c, e), changes), threshold, changes))
    return urls.first()


def at(s):
    return T0 + timedelta(seconds=s)


def live(s, status=S.ALIVE, digest="", n=0):
    return ("live_web", at(s), status, digest, n)


def cap(a, s, status="200", digest="", n=0):
    return (a, at(s), status, digest, n)


def test_ties_take_the_smaller_status(spark):
    assert state(spark, [live(0, S.GONE), live(0)], []).state == "S0"


def test_204_is_terminal_for_captures_only(spark):
    r = state(spark, [], [cap("a", 0, "204"), cap("b", 0, "404")])
    assert (r.state, r.n_inaccessible, r.preserved, r.capture_gap) == ("S3", 2, True, False)


@pytest.mark.parametrize(("last", "want"), [(40, "S2"), (50, "S1"), (0, "S0")])
def test_changes(spark, last, want):
    r = state(spark, [live(0, digest="a", n=100), live(1, digest="b", n=last)], [])
    assert (r.state, r.survival) == (want, "changed")
    assert state(spark, [live(0, digest="a", n=100), live(1, digest="b", n=last)], [], changes=False).state == "S0"


def test_archive_decides_where_live_is_stable(spark):
    r = state(spark, [live(0, digest="a"), live(1, digest="a")], [cap("x", 0, digest="p", n=10), cap("x", 1, digest="q", n=9)])
    assert (r.state, r.trajectory) == ("S1", "edited")


def test_pre_established_captures_are_no_witness(spark):
    caps = [cap("a", 0, "404"), cap("b", 0, "404")]
    assert state(spark, [], caps, {"a": 2025}).state == "S4"
    assert state(spark, [], caps, {"a": 2024}).state == "S3"


def test_dead_without_captures(spark):
    r = state(spark, [live(0, S.GONE), ("probe", at(0), S.GONE, "", 0)], [])
    assert (r.state, r.capture_gap, r.preservation_gap) == ("S3", True, True)


def test_single_capture(spark):
    r = state(spark, [], [cap("a", 0)])
    assert (r.state, r.survival, r.evidential_uncertainty) == ("S4", "unknown", True)


def test_transitions_and_events(spark):
    o, c, e = frames(spark, [], [("u", *cap("a", i, digest=d)) for i, d in enumerate("ABA")])
    got = {r.event_type: r for r in L.events(E.per_witness(E.evidence(o, c, e))).collect()}
    assert got["content_changed"].evidence_count == 2 and got["content_changed"].archive == "a"
    assert "content_stable" not in got and got["state_S4"].confidence == 0.5


def plain(obs, caps, years, threshold):
    """One URL's state, by lists."""
    fold = {}
    for o, t, s, *_ in obs:
        fold.setdefault(("o", o), []).append((t, s))
    for a, t, s, *_ in caps:
        if a not in years or t.year >= years[a]:
            fold.setdefault(("c", a), []).append((t, s))
    last = {k: min(s for t, s in v if t == max(t for t, _ in v)) for k, v in fold.items()}
    alive = any(k[0] == "o" and s == S.ALIVE for k, s in last.items())
    dead = {k[1] for k, s in last.items() if (s == S.GONE if k[0] == "o" else s.isdigit() and int(s) in S.TERMINAL_CODES)}
    series = {}
    for kind, rows in (("o", obs), ("c", caps)):
        for w, t, _, d, n in rows:
            if d and (kind == "c" or w == S.LIVE):
                series.setdefault((kind != "o", w), []).append((t, d, n))
    long = {k: v for k, v in series.items() if len(v) >= 2}
    changed = any(len({d for _, d, _ in v}) > 1 for v in long.values())
    survival = "changed" if changed else "stable" if long else "unknown"
    path = None
    for k in sorted(series):
        v = series[k]
        lengths = sorted((t, n) for t, _, n in v if n and n > 0)
        if path is None and len({d for _, d, _ in v}) > 1 and len(lengths) >= 2:
            a, b = lengths[0][1], lengths[-1][1]
            path = "replaced" if min(a, b) / max(a, b) < 0.5 else "edited"
    s = ("S1" if path == "edited" else "S2" if path == "replaced" else "S0") if alive and changed else "S0" if alive else "S3" if len(dead) >= threshold else "S4"
    steps = sum(x[1] != y[1] for v in series.values() for x, y in zip(sorted((t, d) for t, d, _ in v), sorted((t, d) for t, d, _ in v)[1:]))
    return s, survival, len(dead), steps


def test_random_evidence_against_the_model(spark):
    rng = random.Random(5)
    years, obs, caps = {"a1": 2024, "a2": 2025}, [], []
    for u in range(150):
        for _ in range(rng.randint(0, 6)):
            obs.append((f"u{u}", rng.choice(["live_web", "p", "a1"]), T0 + timedelta(days=rng.randint(0, 3)), rng.choice([S.ALIVE, S.GONE, S.RESTRICTED]), rng.choice(["", "d1", "d2"]), rng.choice([0, 10, 19, 30])))
        for _ in range(rng.randint(0, 6)):
            caps.append((f"u{u}", rng.choice(["a1", "a2", "a3"]), T0 + timedelta(days=rng.randint(-400, 400)), rng.choice(["200", "404", "204", "-", ""]), rng.choice(["", "d1", "d2"]), rng.choice([0, 10, 19, 30])))
    o, c, e = frames(spark, obs, caps, years)
    w = E.per_witness(E.evidence(o, c, e)).cache()
    got = {r.url_id: r for r in L.per_url(w).collect()}
    steps = {r[0]: r[1] for r in w.groupBy("url_id").agg(F.sum("n_tr")).collect()}
    for u in {x[0] for x in obs + caps}:
        want = plain([x[1:] for x in obs if x[0] == u], [x[1:] for x in caps if x[0] == u], years, 2)
        assert (got[u].state, got[u].survival, got[u].n_inaccessible, steps[u]) == want, u
    events = L.events(w)
    changed = {r[0] for r in events.where("event_type = 'content_changed'").collect()}
    assert changed == {u for u, n in steps.items() if n}
    shuffled = E.per_witness(E.evidence(o.orderBy(F.rand(1)), c.orderBy(F.rand(2)), e))
    assert sorted(L.per_url(shuffled).collect()) == sorted(L.per_url(w).collect())


def test_null_rows(spark):
    o, c, e = frames(spark, [("u", None, None, None, None, None)], [("u", None, None, None, None, None)])
    r = L.per_url(E.per_witness(E.evidence(o, c, e))).first()
    assert (r.state, r.evidence_count, r.event_start) == ("S4", 2, None)


def test_url_without_evidence(spark):
    o, c, e = frames(spark, [], [])
    urls = spark.createDataFrame([("u", "x")], "url_id string, original_url string").selectExpr("*", *(f"null {n}" for n in ("domain", "tld", "url_type", "entry_cohort", "first_observed")))
    r = Y.summary(urls, c, o, L.events(E.per_witness(E.evidence(o, c, e))), e).first()
    assert (r.current_state, r.n_captures, r.n_observations, r.content_survival, r.capture_gap) == (None, None, 0, "unknown", False)


def test_plan_has_no_python_and_few_exchanges(spark):
    o, c, e = frames(spark, [("u", *live(0))], [("u", *cap("a", 0))], {"a": 2020})
    plan = L.per_url(E.per_witness(E.evidence(o, c, e)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "BroadcastHashJoin" in plan and plan.count("Exchange hashpartitioning") == 2
