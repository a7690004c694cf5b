"""%.9g without Python on the executors: doubles next to and at ties of all sizes."""

import math
import random
import struct

from pyspark.sql import functions as F

from tallyframe.functions import text
from tallyframe.plans import cycles


def doubles() -> list[float]:
    rng = random.Random(7)
    out = [0.0, -0.0, math.nan, math.inf, -math.inf, 5e-324, -5e-324, 2.2250738585072009e-308, 2.2250738585072014e-308, 2.0**53, 2.0**63, -(2.0**63), 2.0**63 - 1024, 1.7976931348623157e308]
    for _ in range(4000):
        out.append(float(rng.randint(10**8, 10**9 - 1) * 10 + 5) * 2.0 ** rng.randint(-12, 30))  # whole and broken, exact ties among them
        near = float(f"{rng.randint(10**8, 10**9 - 1)}5e{rng.randint(-332, 298)}")
        out += [near, math.nextafter(near, 0), -math.nextafter(near, math.inf)]
        out.append(float(rng.randint(10**8, 10**9 - 1) * 10**k + 5 * 10 ** (k - 1)) if (k := rng.randint(1, 12)) else 0.0)
        out.append(struct.unpack("<d", struct.pack("<q", rng.getrandbits(rng.randint(1, 52))))[0])  # subnormal
        out.append(struct.unpack("<d", struct.pack("<Q", rng.getrandbits(64)))[0])
    return out


def test_all_sizes_without_python(spark):
    values = doubles()
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", text.score_text(F.col("v")).alias("t"))
    assert "Python" not in df._jdf.queryExecution().optimizedPlan().toString()
    got = {r.i: r.t for r in df.collect()}
    wrong = [(v, got[i], "%.9g" % v) for i, v in enumerate(values) if got[i] != "%.9g" % v]
    assert not wrong, (len(wrong), wrong[:5])


def test_the_query_needs_no_python(spark, tmp_path):
    spark.createDataFrame([(1, 3.5), (2, None), (3, -151234.4575)], "event_id long, value double").write.parquet(str(tmp_path / "events.parquet"))
    df = cycles.score_texts(spark, str(tmp_path))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in df.orderBy("event_id").collect()][1] == (2, None, None, None)
