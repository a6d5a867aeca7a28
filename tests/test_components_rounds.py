import pytest

from tidemark.operators import graph


def test_unfinished_components_raise(spark):
    """Never nodes in parts of their component without a sign."""
    chain = spark.createDataFrame([(f"c{i:02}", f"c{i + 1:02}") for i in range(30)], "source string, target string")
    with pytest.raises(RuntimeError, match="still move"):
        graph.components(chain, most_rounds=1)
    assert {r.component for r in graph.components(chain).collect()} == {"c00"}
