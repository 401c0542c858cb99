"""Spots about equally far from several pieces, as the SQL has them to the last bit."""

from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from limnos.plans import registry
from oracle import TABLES, compare


def test_equally_far_pieces_are_those_of_the_sql(spark, tmp_path):
    for t in TABLES:
        if t != "embeddings":
            (tmp_path / f"{t}.parquet").symlink_to(Path("/root/testdata/sf0.001") / f"{t}.parquet")
    # All pieces run alike, so pieces on one line, or on either side, are equally far but for the last bits.
    e = np.random.default_rng(3).uniform(0, 0.003, (1500, 3)).astype(np.float32)
    schema = pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32())), ("label", pa.int32())])
    pq.write_table(pa.table([np.arange(1500), list(e), np.arange(1500) % 10], schema=schema), tmp_path / "embeddings.parquet")
    assert compare(spark, registry.QUERIES["plan_price_spots"], registry.ORACLES["plan_price_spots"], str(tmp_path)) == 750
