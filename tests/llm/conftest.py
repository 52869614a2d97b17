import pytest


@pytest.fixture
def docs(spark):
    """Rows with what every operator must bear: nulls, empty and long texts, repeats, a clashing extra column."""

    def make(texts, first=0, ids=None):
        rows = [(ids[k] if ids else first + k, t, "component_id", "h") for k, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, component_id string, h string")

    return make
