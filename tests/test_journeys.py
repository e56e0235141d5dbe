"""The contract of journeys, by hand-worked cases."""

from cohortlens.operators import journeys

NODES, LINKS = "journey string, node string, place int, size long", "journey string, source string, target string, n long"
PUBLIC = [("applied", 1, 100), ("going_accepted", 2, 60), ("not_accepted_reason_unknown", 3, 40), ("on_site", 4, 50)]
FLOWS = [("applied", "going_accepted", 60), ("applied", "not_accepted_reason_unknown", 40), ("going_accepted", "on_site", 50)]


def problems(spark, nodes, links, k=5, real=False):
    found = journeys.violations(spark.createDataFrame([("j", *n) for n in nodes], NODES), spark.createDataFrame([("j", *x) for x in links], LINKS), k, real)
    return sorted((r["at"], r.problem) for r in found.collect()) if not any(r["at"] is None for r in found.collect()) else [(r["at"], r.problem) for r in found.collect()]


def sized(**sizes):
    return [(n, p, sizes.get(n, s)) for n, p, s in PUBLIC]


def flows(**values):
    return [(a, b, values.get(b, n)) for a, b, n in FLOWS]


def test_a_sound_journey_and_what_may_be_withheld(spark):
    assert problems(spark, PUBLIC, FLOWS, real=True) == problems(spark, PUBLIC, []) == []
    both = {"going_accepted": None, "not_accepted_reason_unknown": None}
    assert problems(spark, sized(**both), flows(**both), real=True) == []
    # Nothing is exposed where the whole is withheld.
    assert problems(spark, sized(applied=None, going_accepted=None), flows(going_accepted=None)) == []


def test_withheld_parts_must_not_follow(spark):
    single = [("applied", "single withheld part")]
    assert problems(spark, sized(going_accepted=None), FLOWS) == single  # among nodes
    assert problems(spark, PUBLIC, flows(going_accepted=None)) == single  # among links
    assert problems(spark, sized(applied=43, going_accepted=None), [])[1:] == [("applied", "small withheld remainder")]
    three = [("a", 1, 20), ("b", 2, 9), ("c", 3, 9), ("d", 4, 9)]
    hidden = [("a", "b", None), ("a", "c", None), ("a", "d", 9)]
    assert problems(spark, three, hidden) == []
    assert problems(spark, [("a", 1, 13), *three[1:]], hidden) == [("a", "small withheld remainder"), ("a->d", "small nested remainder")]
    assert problems(spark, [("a", 1, 9), *three[1:]], hidden) == []  # a remainder of zero
    # One link alone may be withheld, if its remainder is not small.
    assert problems(spark, three, [("a", "b", None)]) == []
    assert problems(spark, [("a", 1, 4), ("b", 2, None)], [("a", "b", None)]) == [("a", "small withheld remainder")]
    # Where both are there, the first kind of acceptance is the part.
    assert problems(spark, [*sized(), ("accepted", 5, None)], []) == []


def test_flows(spark):
    nodes = [("a", 1, 20), ("b", 2, 10), ("c", 3, 10)]
    assert problems(spark, nodes, [("a", "b", 11), ("x", "a", 1), ("b", "b", 1)]) == [("a->b", "more than an end"), ("b", "incoming above the node"), ("b->b", "link to itself"), ("x->a", "unknown node")]
    assert problems(spark, nodes, [("c", "b", 1)]) == [("c->b", "not forward")]
    assert problems(spark, nodes, [("a", "c", 8), ("b", "c", 8)]) == [("c", "incoming above the node")]
    assert problems(spark, [("a", 1, 12), ("b", 2, 10), ("c", 3, 4)], [("a", "b", 10), ("a", "c", 4)]) == [("a", "outgoing above the node"), ("a->b", "small nested remainder")]
    assert problems(spark, [("a", 1, 20), ("b", 1, 9), ("a", 3, 20)], [("a", "b", 1), ("a", "b", 1)])[:3] == [("1", "doubled place"), ("a", "doubled node"), ("a->b", "doubled link")]


def test_real_journeys(spark):
    assert problems(spark, sized(going_accepted=50), flows(going_accepted=50), real=True) == [("applied", "parts don't add up")]
    assert problems(spark, PUBLIC, flows(on_site=45), real=True) == [("going_accepted->on_site", "not its target's count")]
    assert problems(spark, PUBLIC, FLOWS[:2], real=True) == [(None, "open topology")]
    assert problems(spark, [*PUBLIC, ("extra", 9, 1)], FLOWS, real=True) == [(None, "open topology")]
    operator = [("approved", 1, 90), ("checked_in", 2, 80), ("team_path", 3, 60), ("solo_path", 4, 20)]
    paths = [("approved", "checked_in", 80), ("checked_in", "team_path", 60), ("checked_in", "solo_path", 20)]
    assert problems(spark, operator, paths, real=True) == []
    assert problems(spark, [*operator[:3], ("solo_path", 4, 10)], [*paths[:2], ("checked_in", "solo_path", 10)], real=True) == [("checked_in", "parts don't add up")]


def test_empty_tables_nulls_and_extra_columns(spark):
    assert problems(spark, [], []) == []
    assert problems(spark, [], [("a", "b", 1), (None, "b", None)]) == [("?->b", "unknown node"), ("a->b", "unknown node")]
    nodes = spark.createDataFrame([(None, "a", 1, 4, "x"), (None, "b", 2, 9, "y")], NODES + ", at string")
    links = spark.createDataFrame([(None, "a", "b", 5, 1)], LINKS + ", problem int")
    assert sorted((r.journey, r["at"], r.problem) for r in journeys.violations(nodes, links, 5).collect()) == [(None, "a", "outgoing above the node"), (None, "a->b", "more than an end")]
