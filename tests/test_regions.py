"""Region queries against a scan by hand of a seeded journal; pages; identities."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kronika.operators import query
from kronika.plans.region import Region

# Namespaces beside look-alikes of each other, one with the separator at its end, and no scope at all.
ENTITIES = ["shop", "shop:7", "shop:7:till", "shop:70", "shopping:7", "depot", "depot:", "Depot:1"]
SCOPES = ["open", "open:late", "closed", None]
KINDS = [0x1ABC, 0x1ABD, 0x2ABC, 0xE000, 0xEFFF]


def journal_rows():
    """250 rows; several lanes share a clock, sequences have holes."""
    rng = random.Random("regions")
    at, rows = 0, []
    for n in range(250):
        at += rng.choice([1, 1, 1, 2, 9])
        rows.append((at, rng.choice(ENTITIES), rng.choice(SCOPES), rng.choice(KINDS), n // 8, rng.randint(0, 3)))
    return rows


ROWS = journal_rows()


@pytest.fixture(scope="module")
def journal(spark):
    schema = "global_sequence long, entity string, scope string, kind int, clock int, dag_lane int"
    rows = spark.createDataFrame(ROWS, schema).repartition(3).cache()
    yield rows
    rows.unpersist()


def by_hand(where):
    out = []
    for at, entity, scope, kind, clock, lane in ROWS:
        checks = [
            where.entity is None or entity == where.entity or entity[: len(where.entity) + 1] == f"{where.entity}:",
            where.scope is None or scope == where.scope,
            where.kind is None or kind == where.kind,
            where.category is None or f"{kind:04x}"[0] == f"{where.category:x}",
            where.clock is None or clock in range(where.clock[0], where.clock[1] + 1),
            where.lane is None or lane == where.lane,
        ]
        if all(checks):
            out.append(at)
    return out


facts = st.sampled_from([{}, {"any_kind": True}, *({"kind": k} for k in KINDS), *({"category": c} for c in (1, 2, 5, 14))])
wheres = st.builds(
    lambda fact, **rest: Region(**rest, **fact),
    facts,
    entity=st.sampled_from([None, *ENTITIES, "sho", "nobody"]),
    scope=st.sampled_from([None, "open", "closed", "ope"]),
    clock=st.sampled_from([None, (0, 0), (4, 19), (30, 99)]),
    lane=st.sampled_from([None, 0, 3, 7]),
)


@settings(max_examples=25, deadline=None)
@given(where=wheres)
def test_regions_against_a_scan_by_hand(journal, where):
    got = query.region(journal, where).select("global_sequence").collect()
    assert sorted(r[0] for r in got) == by_hand(where)


@pytest.mark.parametrize("where", [Region(entity="shop"), Region(entity="depot"), Region(scope="open"), Region(category=14), Region(lane=2, clock=(5, 5))])
def test_look_alikes(journal, where):
    want = by_hand(where)
    assert want and sorted(r[0] for r in query.region(journal, where).select("global_sequence").collect()) == want


@pytest.mark.parametrize("limit", [1000, 41])
def test_pages_make_up_the_query(journal, limit):
    where = Region(entity="shop", any_kind=True)
    got, after = [], None
    while page := [r[0] for r in query.page(journal, where, after, limit).select("global_sequence").collect()]:
        got, after = got + page, page[-1]
    assert got == by_hand(where)
    assert query.page(journal, where, after, limit).isEmpty()


def test_live_regions_ignore_clocks(journal):
    late = Region(clock=(10_000, 10_001))
    assert journal.where(late.predicate(live=True)).count() == len(ROWS) and journal.where(late.predicate()).isEmpty()


@settings(max_examples=200, deadline=None)
@given(st.sets(wheres, max_size=12))
def test_identities_differ(some):
    assert len({r.identity() for r in some}) == len(some)


def test_identities_are_delimited():
    assert Region(entity="x|scope=1:y").identity() != Region(entity="x", scope="y").identity() != Region(entity="xscope", scope="y").identity()


@pytest.mark.parametrize("bad", [{"clock": (9, 8)}, {"category": -1}, {"category": 99}, {"any_kind": True, "kind": 1}])
def test_bad_regions(bad):
    with pytest.raises(ValueError):
        Region(**bad)
