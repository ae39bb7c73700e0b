import pytest

from sparkloom import ml


def test_linear(spark):
    rows = [(1.0 + 2 * x - 3 * z, [float(x), float(z)]) for x in range(6) for z in range(4)]
    m = ml.train_linear(spark.createDataFrame(rows, "label double, features array<double>"))
    assert abs(m.intercept - 1) < 1e-6 and abs(m.weights[0] - 2) < 1e-6 and abs(m.weights[1] + 3) < 1e-6
    assert abs(m.predict([4, 1]) - 6) < 1e-5
    with pytest.raises(ValueError):
        m.predict([1.0])


def test_linear_with_correlated_features(spark):
    rows = [(4.0 + 3 * x - 2 * (0.25 * x + i % 3), [float(x), 0.25 * x + i % 3]) for i, x in enumerate(range(12))]
    m = ml.train_linear(spark.createDataFrame(rows, "label double, features array<double>"))
    assert abs(m.intercept - 4) < 1e-6 and abs(m.weights[0] - 3) < 1e-6 and abs(m.weights[1] + 2) < 1e-6


@pytest.mark.parametrize("rows", [[], [(1.0, [1.0]), (2.0, [1.0, 2.0])], [(1.0, [5.0]), (2.0, [5.0])]])
def test_bad_input(spark, rows):
    with pytest.raises(ValueError):
        ml.train_linear(spark.createDataFrame(rows, "label double, features array<double>"))


def test_logistic(spark):
    rows = [(float(x + z >= 6), [float(x), float(z)]) for x in range(6) for z in range(6)]
    m = ml.train_logistic(spark.createDataFrame(rows, "label double, features array<double>"), l2=0.01)
    assert m.predict([0, 0]) == 0 and m.predict([5, 5]) == 1 and m.probability([0, 0]) < 0.5 < m.probability([5, 5])
    with pytest.raises(ValueError):
        ml.train_logistic(spark.createDataFrame([(2.0, [1.0]), (0.0, [2.0])], "label double, features array<double>"))


def test_parse(spark):
    lines = spark.createDataFrame([("1 2 3",), ("",), (" 0  4 5 ",)], "value string")
    assert [tuple(r) for r in ml.parse_labeled(lines).collect()] == [(1.0, [2.0, 3.0]), (0.0, [4.0, 5.0])]
    with pytest.raises(Exception, match="needs a label"):
        ml.parse_labeled(spark.createDataFrame([("1",)], "value string")).collect()
