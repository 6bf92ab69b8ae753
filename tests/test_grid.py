"""Connected components and rays on grids against plain loops."""

import random

import pytest

from sightline.operators import grid as G


def flood(cells):
    left, out = set(cells), []
    while left:
        todo, blob = [left.pop()], set()
        while todo:
            x, y = todo.pop()
            blob.add((x, y))
            near = {(x + i, y + j) for i in (-1, 0, 1) for j in (-1, 0, 1)} & left
            left -= near
            todo += near
        out.append(blob)
    return out


def spiral(n):
    """One long winding blob, for which names must travel far."""
    cells, x, y, dx, dy, seen = [], 0, 0, 1, 0, set()
    for size in [n, *[s for k in range(n - 1, 1, -2) for s in (k, k)]]:
        for _ in range(size):
            cells.append((x, y))
            seen.add((x, y))
            x, y = x + dx, y + dy
        x, y = x - dx, y - dy
        dx, dy = -dy, dx
        x, y = x + dx, y + dy
    return cells


@pytest.mark.parametrize("share", [0.25, 0.45])
def test_components_equal_flood_fill(spark, share):
    r = random.Random(share)
    grids = {1: [(x, y) for x in range(25) for y in range(20) if r.random() < share], 2: spiral(13), 3: [(0, 0), (1, 1), (3, 3), (3, 2)], 4: [(5, 5)] * 3}
    cells = spark.createDataFrame([(k, x, y) for k, c in grids.items() for x, y in c], "k int, gx int, gy int")
    got = {}
    for c in G.components(cells, ["k"]).collect():
        got.setdefault((c.k, tuple(c.blob)), set()).add((c.gx, c.gy))
    assert sorted((k, sorted(b)) for (k, _), b in got.items()) == sorted((k, sorted(b)) for k, c in grids.items() for b in flood(c))
    top = {r.k: r for r in G.largest_blobs(cells, ["k"], 25, 20).collect()}
    assert (top[3].cells, top[3].x, top[3].y) == (2, 0.5 / 25, 0.5 / 20)  # of two equally large ones the first
    assert top[1].cells == max(len(b) for b in flood(grids[1])) and top[4].area == 1 / 500
    assert G.components(cells.limit(0), ["k"]).count() == 0


def test_ways_out_equal_walks(spark):
    r = random.Random(4)
    w, h = 17, 14
    grids = {1: {(x, y): r.random() < 0.7 for x in range(w) for y in range(h)}, 2: {(x, y): True for x in range(w) for y in range(h)}, 3: {(x, y): False for x in range(w) for y in range(h)}}

    def ways(grid, x, y):
        out = []
        for name, (dx, dy) in (("vänster", (-1, 0)), ("höger", (1, 0)), ("uppåt", (0, -1)), ("nedåt", (0, 1))):
            seen = [grid[x + dx * i, y + dy * i] for i in range(0, 40, 2) if (x + dx * i, y + dy * i) in grid]
            if len(seen) > 5 and sum(seen) / len(seen) > 0.65:
                out.append(name)
        return out

    cells = spark.createDataFrame([(k, x, y, o) for k, g in grids.items() for (x, y), o in g.items()], "k int, gx int, gy int, open boolean")
    got = {(c.k, c.gx, c.gy): c.ways for c in G.ways_out(cells, ["k"]).collect()}
    assert got == {(k, x, y): ways(g, x, y) for k, g in grids.items() for x, y in g}
    assert not any(v for (k, _, _), v in got.items() if k == 3) and got[2, 16, 0] == ["vänster", "nedåt"]
