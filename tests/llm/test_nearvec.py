import numpy as np

from lumenfold.llm import nearvec


def brute(rows, threshold=0.93):
    usable = [(k, l, np.array(v, float)) for k, (i, v, l) in enumerate(rows) if l is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {k: set() for k in range(len(rows))}
    for a, la, x in usable:
        for b, lb, y in usable:
            if a < b and la == lb and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                links[a].add(b)
                links[b].add(a)
    out = []
    for k, (i, _, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for m in links[todo.pop()] - seen:
                seen.add(m)
                todo.append(m)
        ids = [rows[m][0] for m in seen if rows[m][0] is not None]
        component = min(ids) if ids else None
        out.append((i, len(links[k]), component, i == component))
    return sorted(out, key=repr)


def cases():
    rng = np.random.default_rng(1)
    rows = []
    for i in range(150):
        v = rng.normal(size=8).astype(np.float32)
        for j in range(int(rng.integers(1, 4))):
            rows.append((len(rows) + 5, [float(x) for x in (v + rng.normal(size=8) * 0.12).astype(np.float32)], int(i % 3)))
    rows += [(900 + i, rows[i][1], rows[i][2]) for i in range(20)]
    rows += [(1000, None, 1), (1001, [0.0] * 8, 1), (1002, [float("nan")] * 8, 1), (1003, [None] + [1.0] * 7, 1), (1004, [1.0] * 8, None), (1005, [], 1), (1006, [1.0, 2.0], 1), (1007, [2.0, 4.0], 1), (None, [2.0, 4.0], 1), (1008, [float("inf")] * 8, 1)]
    rows.append(rows[0])
    return rows


def test_against_brute_force(spark):
    rows = cases()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, v string, n int")
    for block, tile in ((4096, 1024), (64, 16), (16, 16)):
        got = sorted((tuple(r) for r in nearvec.near_vectors(df, block=block, tile=tile).select("vec_id", "n_links", "component_id", "kept").collect()), key=repr)
        assert got == brute(rows)
    assert nearvec.near_vectors(df.where("false")).collect() == []


def test_bounds_hold():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 16)) * rng.exponential(size=(200, 1))
    unit, q, scale, about, rest = nearvec.quantised(x)
    product = (q.astype(float) @ q.astype(float).T) * np.outer(scale, scale)
    bound = np.outer(rest, about) + np.outer(about + rest, rest)
    assert (np.abs(unit @ unit.T - product) <= bound + 1e-12).all()


def test_codes_judge_pairs_or_leave_them_open():
    """Proven links and refused pairs are right, and every pair near the threshold is left open and settled in doubles."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(20, 24))
    x = np.repeat(base, 12, 0) + rng.normal(size=(240, 24)) * rng.uniform(0.1, 0.4, (240, 1))
    unit, *codes = nearvec.quantised(x)
    want = unit @ unit.T >= 0.93
    np.fill_diagonal(want, False)
    sure, unclear = nearvec.judged(tuple(codes), tuple(codes), 0.93, True)
    assert unclear.any() and sure.any() and not (sure & ~want).any() and not (want & ~sure & ~unclear).any()
    assert ((sure | nearvec.exact_links(unit, unit, unclear, 0.93)) == want).all()
