"""Names for SQL users: ``SELECT * FROM html_nodes(html)`` and ``LATERAL html_nodes(p.html)``."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from pagequarry.operators.nodes import parse


@udtf(returnType="id int, parent int, last int, depth int, nth int, kind string, tag string, attrs map<string,string>, text string")
class HtmlNodes:
    """The nodes of one document; none for a null one."""

    def eval(self, html: str) -> Iterator[tuple]:
        tree = parse(html or "")
        columns = (getattr(tree, c) for c in ("parent", "last", "depth", "nth", "kind", "tag", "attrs", "text"))
        for k, node in enumerate(zip(*columns)):
            yield (k, *node)


def register(spark: SparkSession) -> None:
    spark.udtf.register("html_nodes", HtmlNodes)
