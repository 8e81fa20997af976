"""The grid cut: each pair of segments comes up in one cell, so that pairs are not moved to be told apart."""

from roomwright.operators import kernel, noding

LINES = [(float(k), 0.0, float(k), 9.0) for k in range(12)] + [(-1.0, float(k), 12.0, float(k) + k % 2 / 2) for k in range(1, 9)] + [(0.0, 0.0, 11.0, 9.0), (0.0, 0.0, 5.0, 0.0), (2.0, 0.0, 9.0, 0.0)]


def test_edges_are_those_of_the_plain_form_with_fewer_distinct_steps(spark):
    made = noding.node_edges(spark.createDataFrame([(1, *v) for v in LINES], "drawing_id long, sx double, sy double, ex double, ey double"))
    assert sorted(tuple(round(v, 7) for v in r[1:]) for r in made.collect()) == sorted(tuple(round(v, 7) for v in e) for e in kernel.node(LINES))
    # one more when pairs are told apart
    assert made._jdf.queryExecution().analyzed().toString().count("Deduplicate") == 7
