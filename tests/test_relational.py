import random

import pytest

from lumenfold.operators import groups
from lumenfold.operators import relational as R


def nodes(spark, rows):
    return spark.createDataFrame(rows, "id string, parent_id string, slug string")


def test_paths_of_any_depth(spark):
    rng = random.Random(3)
    rows = [("n0", None, "r0"), ("other", None, "o")] + [(f"n{i}", f"n{i - 1}", f"s{i}") for i in range(1, 41)]
    rows += [(f"m{i}", f"n{rng.randrange(41)}" if i < 5 else f"m{rng.randrange(i)}", f"t{i}") for i in range(60)]
    rng.shuffle(rows)
    up, slug = {r[0]: r[1] for r in rows}, {r[0]: r[2] for r in rows}
    want = {}
    for i in up:
        parts, at = [], i
        while at:
            parts.append(slug[at])
            at = up[at]
        want[i] = (".".join(reversed(parts)), len(parts) - 1)
    got = {r["id"]: (r["path"], r["depth"]) for r in R.path_table(nodes(spark, rows)).collect()}
    assert got == want and max(d for _, d in got.values()) >= 40


def test_cycles_and_missing_parents_are_told(spark):
    rows = [("a", None, "a"), ("b", "a", "b"), ("x", "z", "x"), ("y", "x", "y"), ("z", "y", "z"), ("below", "y", "w"), ("orphan", "nobody", "o"), ("child", "orphan", "c"), ("self", "self", "s")]
    with pytest.raises(ValueError, match="7 nodes"):
        R.path_table(nodes(spark, rows))
    got = {r["id"]: (r["path"], r["depth"]) for r in R.path_table(nodes(spark, rows), faults="keep").collect()}
    assert got == {"a": ("a", 0), "b": ("a.b", 1)} | dict.fromkeys(("x", "y", "z", "below", "orphan", "child", "self"), (None, None))
    with pytest.raises(ValueError):
        R.path_table(nodes(spark, rows), faults="drop")
    assert R.path_table(nodes(spark, [])).count() == 0


@pytest.mark.parametrize("room", [1 << 18, 40])
@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_components(spark, monkeypatch, room, kind):
    """Long chains, stars, cycles, repeated edges and self-loops; in one task and in rounds."""
    monkeypatch.setattr(groups, "TASK_EDGES", room)
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(0, 150)] + [(1000, i) for i in range(1001, 1080)] + [(2000 + i, 2000 + (i + 1) % 50) for i in range(50)]
    edges += [(rng.randrange(3000, 3400), rng.randrange(3000, 3400)) for _ in range(180)] + [(7, 7), (5000, 5000)] + edges[:20]
    rng.shuffle(edges)
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for x, y in edges:
        a, b = sorted((top(x), top(y)))
        root[b] = a
    want = {x: top(x) for e in edges if e[0] != e[1] for x in e}
    name = (lambda x: x) if kind == "bigint" else (lambda x: f"{x:06}")
    df = spark.createDataFrame([(name(a), name(b)) for a, b in edges], f"a {kind}, b {kind}").repartition(5)
    got = groups.connected_components(df).collect()
    assert len(got) == len(want) and {r["id"]: r["component"] for r in got} == {name(k): name(v) for k, v in want.items()}


def test_components_of_nothing(spark):
    empty = spark.createDataFrame([(1, 1), (None, 2)], "a long, b long")
    assert groups.connected_components(empty).collect() == []
