"""Zone outlines against points tested one by one."""

import math
import random

from tidewright.operators import outline


def rings(spark, rows):
    return outline.outlines(spark.createDataFrame(rows, "group long, x double, y double")).collect()


def around(points, x, y):
    inside = False
    for a, b in zip(points, points[1:], strict=False):
        if (a.y > y) != (b.y > y) and x < a.x + (y - a.y) / (b.y - a.y) * (b.x - a.x):
            inside = not inside
    return inside


def test_outlines_of_zones(spark):
    # Group 2 is two circles as far apart as the golden layers' places (1548.7 m, in a direction of our own).
    # Group 3 is a ring of circles around a hole, group 4 two circles side by side along a shared side.
    lean = math.pi / 64 + math.pi / 2
    r = random.Random(3)
    groups = {
        2: [(0.0, 0.0), (1548.7 * math.cos(0.79), 1548.7 * math.sin(0.79))],
        3: [(5000 * math.cos(a * math.pi / 7), 5000 * math.sin(a * math.pi / 7)) for a in range(14)],
        4: [(0.0, 0.0), (1000 * math.cos(lean), 1000 * math.sin(lean))],
        5: [(r.uniform(0, 9000), r.uniform(0, 9000)) for _ in range(25)],
        6: [(7.0, 8.0)],
    }
    rows = [(g, x, y) for g, spots in groups.items() for x, y in spots]
    found = rings(spark, [*rows, *rows[:3], (6, None, 1.0), (6, float("nan"), 1.0), (None, 1.0, 1.0)])
    by = {g: [f.points for f in sorted(found, key=lambda f: f.ring) if f.group == g] for g in groups}
    assert {f.group for f in found} == set(groups)
    assert len(by[6][0]) == 65 and len(by[2]) == 1 and len(by[4]) == 1
    assert len(by[2][0]) == 81
    assert [f.area > 0 for f in sorted(found, key=lambda f: f.ring) if f.group == 3] == [True, False]
    inner = 2500 * math.cos(math.pi / 64)
    for g, spots in groups.items():
        judged = 0
        for _ in range(400):
            x, y = r.uniform(-8000, 12000), r.uniform(-8000, 12000)
            d = min(math.dist((x, y), s) for s in spots)
            if not inner - 1 < d < 2501:  # between them, corners and sides differ
                judged += 1
                assert (sum(around(p, x, y) for p in by[g]) % 2 == 1) == (d < 2500), (g, x, y)
        assert judged > 300
    assert rings(spark, []) == []
