import math

from trackframe.operators import fits


def test_groups_without_a_step_do_not_stop_the_others(spark):
    # Eight tubes of a wide detector, nearly on a line; their equations become singular once the damping is below rounding.
    rings, event = 7692, 31
    turn = [2 * math.pi * (event % 6 + (event + k // 4 + 0.5) / rings) / 6 for k in range(8)]
    far = [(1, (16 + k) * math.cos(t), (16 + k) * math.sin(t)) for k, t in enumerate(turn)]
    near = [(2, 7 * math.cos(k), 7 * math.sin(k)) for k in range(8)]
    points = spark.createDataFrame(far + near, "g long, x double, y double")
    found = {r.g: r for r in fits.geometric_circle(points, ["g"]).collect()}
    assert found[2].code == 0 and abs(found[2].r - 7) < 1e-9
    assert found[1].r > 1e4 and found[1].sigma < 1e-3 and found[1].code in (0, 1, 2)
