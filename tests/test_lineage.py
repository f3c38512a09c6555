import random

import pytest

from agentlake.operators.lineage import roots, tree


def test_deep_chain_and_cycle(spark):
    n = 300
    df = spark.createDataFrame([(i, i - 1 if i else None) for i in range(n)] + [(1000, None)], "id long, parent long")
    got = {r["id"]: (r["root_id"], r["depth"]) for r in roots(df, "id", "parent").collect()}
    assert got == {i: (0, i) for i in range(n)} | {1000: (1000, 0)}
    with pytest.raises(ValueError, match="cycle"):
        roots(spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, None)], "id long, parent long"), "id", "parent")


def plain_tree(rows):
    parent, value = {i: p for i, p, _ in rows}, {i: v for i, _, v in rows}
    paths = {}
    for i in parent:
        path, at = [i], parent[i]
        while at is not None:
            path.append(at)
            at = parent.get(at)
        paths[i] = path[::-1]
    below = {i: [j for j, p in paths.items() if i in p] for i in parent}
    return {i: (p[0], len(p) - 1, p, len(below[i]), sum(value[j] for j in below[i])) for i, p in paths.items()}


def test_paths_and_subtree_sums(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.randrange(max(0, i - 6), i) if i % 17 else None, rnd.randrange(100)) for i in range(1, 150)]
    rows += [(1000 + i, 1000 + i - 1 if i else None, 1) for i in range(130)]  # a chain
    rows += [(2000, None, 5), *[(2001 + i, 2000, 1) for i in range(40)], (3000, 9999, 7), (3001, 3000, 2)]  # a star; a parent without a row
    rows = [(i, p if p else None, v) for i, p, v in rows]
    got = tree(spark.createDataFrame(rows, "id long, parent long, v long"), "id", "parent", ["v"]).collect()
    assert {r["id"]: (r["root_id"], r["depth"], r["path"], r["subtree_nodes"], r["subtree_v"]) for r in got} == plain_tree(rows)


def test_tree_cycle(spark):
    for rows in ([(1, 2), (2, 3), (3, 1), (4, None)], [(1, 1)], [(1, 2), (2, 1), (5, 1)]):
        with pytest.raises(ValueError, match="cycle"):
            tree(spark.createDataFrame(rows, "id long, parent long"), "id", "parent", [])
