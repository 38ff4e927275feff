"""The five gates of a freeze: each fails by itself, and on missing numbers."""

from pvlens.operators import calibration


def gates(spark, spearman=0.97, tops=(9, 18), shifts=(0.2, -0.3), wider=0.6, narrower=0.5, own=0.3, extremes=4, inputs=("a", "b")):
    pairs = spark.createDataFrame([(spearman, *tops), (0.99, 10, 20)], "spearman double, top_10_overlap long, top_20_overlap long")
    seeds = spark.createDataFrame(list(enumerate(shifts)), "seed int, shift double")
    variants = spark.createDataFrame([("core", wider), ("compact", narrower), ("no_time", own)], "variant string, shift double")
    top = spark.createDataFrame([(extremes,)], "n int")
    return calibration.freeze_criteria(pairs, seeds, variants, top, inputs, ("a", "b"), 0.9, {10: 0.8, 20: 0.8}, 5).first().asDict()


def test_each_gate(spark):
    assert all(gates(spark).values())
    for change, name in (
        ({"spearman": 0.8}, "ranks_agree"), ({"tops": (9, 11)}, "ranks_agree"), ({"shifts": (0.2, -0.7)}, "shift_below_wider"), ({"shifts": (0.2, None)}, "shift_below_wider"), ({"wider": None}, "shift_below_wider"),
        ({"extremes": 6}, "extremes_do_not_fill_top"), ({"inputs": ("a",)}, "inputs_complete"), ({"inputs": ("a", "b", "b")}, "inputs_complete"), ({"narrower": 0.2}, "narrower_no_better"),
    ):
        got = gates(spark, **change)
        assert not got["freeze"] and [k for k, v in got.items() if not v] == [name, "freeze"]
