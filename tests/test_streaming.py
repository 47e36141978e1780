"""The row-wise operators give the same scores on a stream as in batch."""

import os
import tempfile

from lodestar.plans import context as ctx
from lodestar.streaming import scoring as st

SMALL = "/root/testdata/sf0.001"


def test_stream_matches_batch(spark):
    out = tempfile.mkdtemp(prefix="stream-")
    st.run_to_parquet(st.scored_order_stream(spark, SMALL).select("case_id", "prediction", "margin"),
                      os.path.join(out, "data"), os.path.join(out, "ckpt"))
    streamed = {r["case_id"]: (r["prediction"], round(r["margin"], 9))
                for r in spark.read.parquet(os.path.join(out, "data")).collect()}
    batch = {r["case_id"]: (r["prediction"], round(r["margin"], 9))
             for r in ctx.scored_cases(spark, SMALL).collect()}
    assert streamed == batch
