import random

import pytest

from tablecensus.operators.upkeep import reached_after_change, steps_changed

STEPS, IDS = "fqn string, neighbour string", "project_id string, dataset_id string, table_id string"


def search(steps, roots):
    found, frontier = set(roots), set(roots)
    while frontier:
        frontier = {t for s, t in steps if s in frontier} - found
        found |= frontier
    return found


@pytest.fixture
def after_change(spark):
    def run(before, now, roots, more=()):
        def frame(rows, schema):
            return spark.createDataFrame(sorted(rows, key=str), schema)

        def ids(names):
            return frame([tuple(n.split(".")) for n in names], IDS)

        was, is_now = frame(before, STEPS), frame(now, STEPS)
        added, removed = steps_changed(was, is_now)
        out = reached_after_change(ids(search(before, roots)), ids([*roots, *more]), is_now, added, removed, steps_together=4)
        rows = [".".join(r) for r in out.collect()]
        assert len(rows) == len(set(rows))
        return set(rows)

    return run


def step(a, b):
    return f"p.d.t{a}", f"p.d.t{b}"


CASES = {
    "a cycle cut off stays away": ([(0, 1), (1, 2), (2, 3), (3, 1)], [(1, 2), (2, 3), (3, 1)]),
    "another way leads back": ([(0, 1), (1, 2), (0, 3), (3, 2), (2, 4)], [(0, 1), (0, 3), (3, 2), (2, 4)]),
    "into a cycle by another table": ([(0, 1), (1, 2), (2, 1), (0, 2)], [(1, 2), (2, 1), (0, 2)]),
    "added behind added": ([(0, 1), (5, 6)], [(0, 1), (1, 5), (5, 6)]),
    "removed and added": ([(0, 1), (1, 2), (2, 3)], [(0, 1), (2, 3), (0, 3), (3, 4)]),
    "a step to the root goes": ([(0, 1), (1, 0), (0, 2)], [(0, 1), (0, 2)]),
    "not reached before or after": ([(0, 1), (7, 8)], [(0, 1), (8, 7)]),
    "nothing left": ([(0, 1), (1, 2)], [(9, 9)]),
    "nothing changed": ([(0, 1), (0, 0)], [(0, 1), (0, 0)]),
}


@pytest.mark.parametrize("case", CASES)
def test_cases(after_change, case):
    before, now = ([step(*s) for s in steps] for steps in CASES[case])
    assert after_change(before, now, ["p.d.t0"]) == search(now, ["p.d.t0"])


def test_repeated_steps_and_a_new_root(after_change):
    before = [step(0, 1), step(0, 1), step(1, 2), step(8, 9)]
    now = [step(0, 1), step(1, 2), step(8, 9)]
    assert after_change(before, now, ["p.d.t0"], ["p.d.t8"]) == search(now, ["p.d.t0", "p.d.t8"])


@pytest.mark.parametrize("seed", range(3))
def test_random_changes_equal_a_full_search(after_change, seed):
    draw = random.Random(seed)
    pairs = {step(draw.randrange(60), draw.randrange(60)) for _ in range(90)}
    now = {p for p in pairs if draw.random() < 0.85} | {step(draw.randrange(60), draw.randrange(60)) for _ in range(8)}
    roots = ["p.d.t0", "p.d.t1"]
    assert after_change(pairs, now, roots) == search(now, roots)
