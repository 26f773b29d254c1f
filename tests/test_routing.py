"""Routing parses every message once and reads its source once."""

from __future__ import annotations

from tickloom.catalog import load_all
from tickloom.operators import lookup as L, normalize as N

SF_DIR = "/root/testdata/sf0.001"


def test_events_are_parsed_once_in_one_frame(spark):
    messages = spark.createDataFrame([('{"e":"aggTrade","s":"AUSDT"}',)], "value string")
    plan = N.routed(N.unwrap_envelopes(messages))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 5 and plan.count("LogicalRDD") <= 1
    assert load_all()["routed_events"].run(spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 5


def test_events_of_each_kind_and_broken_ones(spark):
    k = '"k":{"t":1,"T":2,"i":"1m","o":"1","h":"2","l":"0.5","c":"1.5","v":"3","q":"4","n":5,"x":true}'
    texts = ['{"stream":"ausdt@aggTrade","data":{"e":"aggTrade","E":9,"s":"AUSDT","a":7,"p":"1.5","q":"2","T":8,"m":false}}',
             '{"e":"aggTrade","E":9,"s":"AUSDT","a":7,"p":"much","q":"2","T":8,"m":false}', '{"e":"aggTrade","E":9,"s":"AEUR","a":7,"p":"1","q":"2","T":8,"m":true}',
             '{"e":"kline","E":10,"s":"BUSDT",%s}' % k, '{"e":"kline","E":10,"s":"BUSDT","k":{"t":1}}', '{"e":"kline","E":10,"s":"BUSDT"}',
             '{"stream":"cusdt@depth20","data":{"lastUpdateId":3,"bids":[["1","2"]],"asks":[]}}', '{"e":"depthUpdate","E":11,"s":"cusdt","u":4,"b":[],"a":[["3","1"]]}',
             '{"e":"depthUpdate","E":"soon","s":"CUSDT","u":4}', '{"e":"other","s":"AUSDT"}', 'no json', None, '[]', '"aggTrade"']
    messages = spark.createDataFrame([(t,) for t in texts], "value string")
    unwrapped = N.unwrap_envelopes(messages)
    rows = N.routed(unwrapped).collect()
    assert sorted((r["topic"], r["symbol"]) for r in rows) == [("depth", "CUSDT"), ("depth", "CUSDT"), ("kline", "BUSDT"), ("trade", "AUSDT")]
    for r in rows:
        assert [t for t in ("trade", "kline", "depth") if r[t] is not None] == [r["topic"]]
    routes = N.route_events(unwrapped)
    (trade,), (kline,) = routes["trade"].collect(), routes["kline"].collect()
    assert (trade["price"], trade["agg_trade_id"], trade["is_buyer_maker"]) == (1.5, 7, False)
    assert (kline["kline_start"], kline["interval"], kline["close"], kline["is_closed"]) == (1, "1m", 1.5, True)
    books = {r["last_update_id"]: r for r in routes["depth"].collect()}
    assert [tuple(x) for x in books[3]["bids"]] == [(1.0, 2.0)] and [tuple(x) for x in books[4]["asks"]] == [(3.0, 1.0)] and books[4]["event_time"] == 11


def test_metadata_do_not_shuffle_the_pairs(spark):
    pairs = spark.range(100).selectExpr("concat('A', id % 3, 'USDT') AS symbol")
    meta = spark.createDataFrame([("A1", "One")], "base string, name string")
    out = L.with_metadata(pairs, meta)
    assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()
    assert sorted({(r["symbol"], r["name"]) for r in out.collect()}, key=str) == [("A0USDT", None), ("A1USDT", "One"), ("A2USDT", None)]
