"""The queries that SQL can express against their DuckDB oracles, on the given tables and on a table with links between pages."""

import pytest

from limnos.llm import queries
from oracle import TABLES, compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    assert compare(spark, queries.QUERIES[name], queries.ORACLES[name], SF) > 0


def test_linked_pages(spark, tmp_path):
    import shutil

    for t in TABLES:
        if t != "pages":
            shutil.copy(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet")
    link = "<link rel=\"canonical\" href='{}'>"
    urls = [f"https://h{i}.org/a/{i}" for i in range(30)] + ["https://x.net/es/1", "https://www.example.com/en/1"]
    rows = [(i, u, link.format(urls[(i * 7) % 32]) if i % 3 else (link.format("../b") if i % 2 else '<meta http-equiv=refresh content="1;url=/a/3">')) for i, u in enumerate(urls)]
    rows += [(200, "https://h90.org/", link.format("https://h91.org/") + link.format("https://x.net/es/7"))]
    rows += [(100, None, None), (101, "none", link.format("https://x.net/es/1")), (102, "https://h1.org/a/1#z", "")]
    import pandas as pd

    pd.DataFrame(rows, columns=["page_id", "url", "html"]).to_parquet(tmp_path / "pages.parquet")
    assert compare(spark, queries.QUERIES["op2_redirect_equivalence"], queries.ORACLES["op2_redirect_equivalence"], str(tmp_path)) == len(rows)
