"""Pointer doubling against a plain walk: long chains, cycles, tails of cycles, missing targets, a name many point to."""

import random

from pairloom.operators import chains, resolution


def walk(table, name):
    seen, at, steps = set(), name, 0
    while at in table and table[at] is not None:
        if at in seen:
            return (None, None, "cycle")
        seen.add(at)
        at, steps = table[at], steps + 1
    return (at, steps, "ended" if at in table else "missing")


def test_chains_equal_a_walk(spark):
    rng = random.Random(6)
    table = {f"c{i}": f"c{i + 1}" if i < 300 else None for i in range(301)}
    table |= {f"r{i}": f"r{(i + 1) % 7}" for i in range(7)} | {f"t{i}": f"t{i + 1}" if i < 9 else "r3" for i in range(10)} | {"self": "self", "gone": "nowhere", "to_gone": "gone"}
    table |= {f"h{i}": "c250" for i in range(100)} | {f"x{i}": (f"x{rng.randrange(400)}" if rng.random() < 0.8 else None) for i in range(400)}
    nodes = spark.createDataFrame(list(table.items()), "name string, next string")
    got = {r.name: (r.end, r.steps, r.state) for r in chains.follow_chains(nodes).collect()}
    assert got == {name: walk(table, name) for name in table}
    assert chains.follow_chains(nodes.limit(0)).count() == 0


def test_constants_follow_bounded_aliases(spark):
    rows = [("a0", "v", None)] + [(f"a{i}", None, f"a{i - 1}") for i in range(1, 12)] + [("l1", None, "l2"), ("l2", None, "l1"), ("none", None, None), ("m", None, "zzz"), ("both", "w", "l1")]
    got = {r.name: (r.value, r.hops, r.state) for r in resolution.constant_strings(spark.createDataFrame(rows, "name string, literal string, alias string")).collect()}
    assert got["a0"] == ("v", 0, "resolved") and got["a8"] == ("v", 8, "resolved") and got["a9"] == (None, 9, "depth_limit")
    assert got["l1"] == got["l2"] == (None, None, "cycle") and got["none"] == (None, 0, "unresolved") and got["m"] == (None, 1, "unresolved")
    assert got["both"] == ("w", 0, "resolved")
