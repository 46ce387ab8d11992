"""Page layout where a page has many blocks and boxes."""

import random

from plumaria.operators import layout as Y

BOX = "doc long, page int, x0 double, y0 double, x1 double, y1 double"


def joined(df):
    """Rows that the largest join of df puts out."""
    df.collect()
    nodes, most = [df._jdf.queryExecution().executedPlan()], 0
    while nodes:
        node = nodes.pop()
        if hasattr(node, "executedPlan") and "AdaptiveSparkPlan" in node.nodeName():
            nodes.append(node.executedPlan())
        if "QueryStage" in node.nodeName():
            nodes.append(node.plan())
        if "Join" in node.nodeName():
            most = max(most, node.metrics().apply("numOutputRows").value())
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    return most


def test_inside_tables_equals_every_pair_without_making_them(spark):
    rng, far = random.Random(3), float("inf")
    boxes = [(rng.randrange(2), 1, x, y, x + rng.choice((0, 3, 30, -1)), y + rng.choice((0, 2, 40))) for x, y in ((rng.uniform(-3000, 3000), rng.uniform(-3000, 3000)) for _ in range(600))]
    boxes += [(1, 1, -far, 10.0, far, 11.0), (0, 1, 2900.0, None, 2999.0, 9.0), (0, 1, 1e15, 1e15, 2e15, 2e15)]
    points = [(rng.randrange(3), 1, b, rng.uniform(-3000, 3000), rng.uniform(-3000, 3000)) for b in range(3000)] + [(b[0], 1, 3000 + k, b[2], b[3]) for k, b in enumerate(boxes) if b[3] is not None and abs(b[2]) < 1e13]
    points += [(1, 1, 9000, 2e14, 10.5), (0, 1, 9001, 1.5e15, 1.5e15), (0, 1, 9002, None, 1.0), (None, 1, 9003, 0.0, 0.0)]
    blocks = spark.createDataFrame([(*p, *p[3:]) for p in points], BOX.replace("x0", "block long, x0", 1))
    tables = spark.createDataFrame([tuple(float(c) if i > 1 and c is not None else c for i, c in enumerate(b)) for b in boxes], BOX)
    inside = lambda p, b: None not in (*p, *b) and p[0] == b[0] and b[2] <= p[3] <= b[4] and b[3] <= p[4] <= b[5]
    want = sorted(p[2] for p in points if not any(inside(p, b) for b in boxes))
    left = Y.inside_tables(blocks, tables)
    assert sorted(r["block"] for r in left.collect()) == want
    assert len(want) < len(points) - 400
    assert joined(left) < 20 * len(points)  # every block with every box of its page is 300 a block
