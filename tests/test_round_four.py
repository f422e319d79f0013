"""The keep-last stream over groups of keys."""

from __future__ import annotations

from hourmark.streaming import streams
from test_round_three import _at, _files


def test_keep_last_stream_holds_an_entry_per_group_and_every_key(spark, tmp_path):
    """State entries do not grow with the keys; far corrections, ties, nulls and rows without a stamp come out as the batch rule has them."""
    folder = str(tmp_path)
    first = [(k, _at(k % 50), k, "a") for k in range(2000)]
    odd = [(5, _at(300), 77, None), (5, _at(300), None, "z"), (6, None, 1, "x"), (None, _at(2), 7, "n"), (None, _at(3), None, "m"), (7, _at(7), 7, "b")]
    _files(spark, folder, [first + odd, [(9999, _at(2000), 1, "end")]], "k bigint, t timestamp, v bigint, s string")
    source = streams.read_parquet_stream(spark, f"{folder}/in", f"{folder}/in/f000.parquet", "*.parquet", files_per_batch=1)
    query = streams.run_to_parquet(streams.keep_last_stream(source, ["k"], "t", "30 minutes", 1800), f"{folder}/out", f"{folder}/state")
    assert 0 < max(o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"]) <= streams.BUCKETS
    got = {r["k"]: (r["t"].replace(tzinfo=None), r["v"], r["s"]) for r in spark.read.parquet(f"{folder}/out").collect()}
    want = {k: (t.replace(tzinfo=None), v, s) for k, t, v, s in first}
    at = lambda m: _at(m).replace(tzinfo=None)
    want |= {5: (at(300), 77, None), None: (at(3), None, "m"), 7: (at(7), 7, "b")}
    assert got == want
