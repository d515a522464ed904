"""Queries over key-value logs made from orders, line items and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import kv as K
from ..operators.scripts import Scripts
from .common import table



def _orders(spark, d):
    """Key: customer, field: status, member: priority, seq: order key."""
    o = table(spark, d, "orders")
    return o.select(F.col("o_custkey").alias("key"), F.col("o_orderstatus").alias("field"), F.col("o_orderpriority").alias("member"), F.col("o_totalprice").alias("score"), F.expr("cast(round(o_totalprice * 100) as bigint)").alias("cents"), F.col("o_orderkey").alias("seq"))


def hash_last_write(spark, d):
    return K.last_write(_orders(spark, d), ["key", "field"], "cents")


def hash_getall(spark, d):
    """HGETALL, HKEYS and HLEN of each hash: fields in order, joined."""
    state = hash_last_write(spark, d)
    pairs = F.array_sort(F.collect_list(F.struct("field", "cents")))
    return state.groupBy("key").agg(F.count(F.lit(1)).alias("length"), F.array_join(F.transform(pairs, lambda p: F.concat(p["field"], F.lit("="), p["cents"].cast("string"))), ",").alias("pairs"))


def hash_hmget(spark, d):
    """Requested fields of every customer in order, misses null."""
    want = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.posexplode(F.array(F.lit("F"), F.lit("O"), F.lit("X"))).alias("ord", "field"))
    return K.lookup(hash_last_write(spark, d), want, ["key", "field"]).select("key", "ord", "field", F.col("cents").cast("string").alias("value"))


def hash_del(spark, d):
    """HDEL: an order of priority 5-LOW deletes the field."""
    log = _orders(spark, d).withColumn("cents", F.when(F.col("member") != "5-LOW", F.col("cents")))
    return log.groupBy("key", "field").agg(F.max_by(F.struct("cents"), "seq").alias("v")).filter("v.cents is not null").select("key", "field", "v.cents")


def hash_incr(spark, d):
    """HINCRBY over fields that an urgent order sets (HSET) first: the last HSET's value and the increments after it."""
    log = _orders(spark, d).select("key", "field", "seq", F.when(F.col("member") == "1-URGENT", "set").otherwise("incr").alias("op"), F.col("cents").alias("delta"))
    return K.counters(log, ["key", "field"])


def counter_replay(spark, d):
    """Priority 1-URGENT sets the counter to the order's cents, others add to it."""
    log = _orders(spark, d).select("key", "seq", F.when(F.col("member") == "1-URGENT", "set").otherwise("incr").alias("op"), F.col("cents").alias("delta"))
    return K.counters(log, ["key"])


def _sets(spark, d, first: str, second: str):
    """SET commands: urgent orders carry one flag, low ones the other, the rest none."""
    flag = F.when(F.col("member") == "1-URGENT", first).when(F.col("member") == "5-LOW", second).otherwise("")
    return _orders(spark, d).select("key", "seq", F.col("cents").alias("value"), flag.alias("flag"))


def string_set_nx(spark, d):
    return K.set_if(_sets(spark, d, "nx", "nx"))


def string_set_xx(spark, d):
    return K.set_if(_sets(spark, d, "xx", "xx"))


def string_set_mixed(spark, d):
    return K.set_if(_sets(spark, d, "nx", "xx"))


def string_set_expiry(spark, d):
    """SET with NX, XX, EX and PX in one log; an order key is a second. What is left of each key at its last command, and the time it has."""
    m = F.col("member")
    log = _orders(spark, d).select(
        "key", "seq", (F.col("seq") * 1000).alias("at"), F.col("cents").alias("value"),
        F.when(m.isin("2-HIGH", "5-LOW"), "nx").when(m == "3-MEDIUM", "xx").otherwise("").alias("flag"),
        F.when(m == "4-NOT SPECIFIED", 2_000_000).when(m == "5-LOW", 900_000).cast("bigint").alias("ttl"),
    )
    return K.set_replay(log).withColumn("value", F.col("value").cast("bigint"))


def string_getset(spark, d):
    """GETSET: the value that each write replaces, null for the first."""
    from pyspark.sql import Window

    return _orders(spark, d).select("key", "seq", F.lag("cents").over(Window.partitionBy("key").orderBy("seq")).alias("old"))


def string_getdel(spark, d):
    """GETDEL at every low order: the value taken, null where nothing was set since the last one."""
    from pyspark.sql import Window

    o = _orders(spark, d).withColumn("takes", F.col("member") == "5-LOW")
    before = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    last = F.max_by(F.struct("takes", "cents"), "seq").over(before)
    return o.withColumn("v", last).filter("takes").select("key", "seq", F.when(~F.col("v.takes"), F.col("v.cents")).alias("value"))


def string_append(spark, d):
    return K.appended(_orders(spark, d).select("key", "seq", F.concat("field", F.substring("member", 1, 1)).alias("value")))


def _lists(spark, d):
    log = _orders(spark, d)
    return K.list_state(log.select("key", "seq", F.when(F.col("field") == "F", "l").otherwise("r").alias("side"), F.col("cents").alias("value")))


def list_state(spark, d):
    return _lists(spark, d)


def list_range(spark, d):
    return K.index_range(_lists(spark, d), 1, 3)


def list_trim(spark, d):
    return K.index_range(_lists(spark, d), -4, -2)


def list_index(spark, d):
    return K.index_range(_lists(spark, d), -1, -1).select("key", "value")


def list_replay(spark, d):
    """Mixed commands: pushes from both sides, a pop for every urgent order, removals for every low one."""
    o = _orders(spark, d)
    op = F.when(F.col("member") == "1-URGENT", "lpop").when(F.col("member") == "5-LOW", "rem").when(F.col("field") == "F", "lpush").otherwise("rpush")
    return K.replay_lists(o.select("key", "seq", op.alias("op"), F.lit(1).alias("arg"), F.col("field").alias("value")))


def list_mixed(spark, d):
    """All list commands in one log: pushes, pops, LSET, LREM of both ends, LTRIM and LINSERT, by the order's priority and status."""
    m, f = F.col("member"), F.col("field")
    op = F.when(f == "P", F.when(m == "1-URGENT", "set").when(m == "2-HIGH", "rpop").when(m == "3-MEDIUM", "trim").otherwise("before"))
    op = F.coalesce(op, F.when(m == "5-LOW", "rem").when(f == "F", "lpush").otherwise("rpush"))
    arg = F.when(op == "set", -1).when(op == "rem", F.when(f == "F", -1).otherwise(0)).otherwise(0)
    o = _orders(spark, d)
    return K.replay_lists(o.select("key", "seq", op.alias("op"), arg.alias("arg"), F.lit(-2).alias("stop"), F.lit("O").alias("pivot"), F.when(op == "rem", "O").when(op.isin("set", "before"), m).otherwise(f).alias("value")))


def stream_rev_range(spark, d):
    """XREVRANGE: the newest two entries of each user before a time, newest first."""
    from pyspark.sql import Window

    e = table(spark, d, "events").filter("ts < timestamp_ntz'2024-01-20'")
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return e.withColumn("place", F.row_number().over(w)).filter("place <= 2").select("user_id", "event_id", "place")


def stream_range(spark, d):
    """Entries of each user between two times, oldest first, three at most."""
    e = table(spark, d, "events").filter("ts >= timestamp_ntz'2024-01-10' and ts < timestamp_ntz'2024-01-20'")
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.withColumn("place", F.row_number().over(w)).filter("place <= 3").select("user_id", "event_id", "place")


def stream_maxlen(spark, d):
    return K.newest(table(spark, d, "events"), 5, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


def stream_delete(spark, d):
    """XDEL of all signups, then the length of each stream."""
    e = table(spark, d, "events")
    gone = e.filter("event_type = 'signup'").select("event_id")
    return e.join(gone, "event_id", "left_anti").groupBy("user_id").agg(F.count(F.lit(1)).alias("length"))


def _tags(spark, d):
    """Tag sets: the customers that ordered with a priority."""
    return _orders(spark, d).select(F.col("member").alias("key"), F.col("key").alias("member")).distinct()


def set_intersect(spark, d):
    return K.in_all(_tags(spark, d), ["1-URGENT", "2-HIGH", "5-LOW"])


def set_union(spark, d):
    t = _tags(spark, d)
    return t.filter("key = '1-URGENT'").select("member").unionByName(t.filter("key = '2-HIGH'").select("member")).distinct()


def set_difference(spark, d):
    t = _tags(spark, d)
    return t.filter("key = '1-URGENT'").select("member").join(t.filter("key = '2-HIGH'").select("member"), "member", "left_anti")


def set_cardinality(spark, d):
    return _tags(spark, d).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def _tag_log(spark, d):
    """SADD by every order, SREM by every low one: tags are statuses, members the priorities."""
    o = _orders(spark, d)
    return o.select("key", F.col("field").alias("member"), "seq", F.when(F.col("member") == "5-LOW", "rem").otherwise("add").alias("op"))


def set_remove(spark, d):
    return K.set_members(_tag_log(spark, d))


def set_scan(spark, d):
    """SSCAN with a pattern: members of each tag in pages of 100."""
    t = _tags(spark, d).withColumn("member", F.col("member").cast("string"))
    return K.pages(K.scan(t, "member", "*[1-4]"), "key", ["member"], 100).select("key", "member", "page")


def set_random(spark, d):
    """SRANDMEMBER with count 3."""
    return K.drawn(_tags(spark, d), 3).select("key", "member")


def set_pop(spark, d):
    """SPOP with count 3, then the size of what is left."""
    t = _tags(spark, d)
    return t.join(K.drawn(t, 3, "pop").select("key", "member"), ["key", "member"], "left_anti").groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def set_is_member(spark, d):
    """SMISMEMBER: 1 or 0 for each customer asked."""
    want = table(spark, d, "customer").select(F.col("c_custkey").alias("member"), F.lit("1-URGENT").alias("key"))
    hit = _tags(spark, d).withColumn("hit", F.lit(1))
    return K.lookup(hit, want, ["key", "member"]).select("member", F.coalesce("hit", F.lit(0)).alias("found"))


def _zset(spark, d):
    """Each customer's order keys scored by price."""
    o = _orders(spark, d)
    return o.select("key", F.col("seq").alias("member"), F.col("cents").alias("score"), "seq")


def zset_rank(spark, d):
    return K.zset_ranks(K.zset(_zset(spark, d))).select("key", "member", "score", "rank", "rev_rank")


def zset_range_by_score(spark, d):
    return K.zset(_zset(spark, d)).filter(F.col("score").between(5_000_000, 15_000_000)).select("key", "member", "score")


def zset_count(spark, d):
    return zset_range_by_score(spark, d).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def zset_incr(spark, d):
    return _orders(spark, d).groupBy("key", "member").agg(F.sum("cents").alias("score"))


def zset_top_k(spark, d):
    return K.top(K.zset(_zset(spark, d)), 3).select("key", "member", "score", "place")


def zset_pop_min(spark, d):
    return K.zset_ranks(K.zset(_zset(spark, d))).filter("rank = 0").select("key", "member", "score")


def zset_pop_max(spark, d):
    return K.zset_ranks(K.zset(_zset(spark, d))).filter("rev_rank = 0").select("key", "member", "score")


def zset_range_open(spark, d):
    """ZRANGEBYSCORE (5000000 +inf LIMIT 1 2"""
    return K.by_score(K.zset(_zset(spark, d)), low=5_000_000, open_low=True, offset=1, count=2).select("key", "member", "score")


def zset_range_index(spark, d):
    """ZRANGE 1 -2"""
    return K.by_rank(K.zset(_zset(spark, d)), 1, -2).select("key", "member", "score", "pos")


def zset_rev_range_index(spark, d):
    """ZREVRANGE -3 -1"""
    return K.by_rank(K.zset(_zset(spark, d)), -3, -1, reverse=True).select("key", "member", "score", "pos")


def zset_remove(spark, d):
    """ZREM by every low order of the member, here the order's status; the last command counts."""
    log = _orders(spark, d).select("key", F.col("field").alias("member"), "seq", F.when(F.col("member") != "5-LOW", F.col("cents")).alias("score"))
    return log.groupBy("key", "member").agg(F.max_by(F.struct("score"), "seq").alias("v")).filter("v.score is not null").select("key", "member", "v.score")


def zset_scan(spark, d):
    """ZSCAN with a pattern: members with scores, in pages of 3."""
    z = K.zset(_zset(spark, d)).withColumn("member", F.col("member").cast("string"))
    return K.pages(K.scan(z, "member", "*[02468]"), "key", ["member"], 3).select("key", "member", "score", "page")


def zset_by_lex(spark, d):
    """ZRANGEBYLEX [2 (4 of priorities as members with one score."""
    t = _orders(spark, d).select("key", "member").distinct()
    return t.filter("member >= '2' and member < '4'")


def zset_scores(spark, d):
    """ZMSCORE of two members each customer may have: null for misses."""
    z = _orders(spark, d).groupBy("key", F.col("field").alias("member")).agg(F.max("cents").alias("score"))
    want = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.explode(F.array(F.lit("O"), F.lit("Q"))).alias("member"))
    return K.lookup(z, want, ["key", "member"]).select("key", "member", F.col("score").cast("string").alias("score"))


def zset_remove_by_score(spark, d):
    return K.zset(_zset(spark, d)).filter(~F.col("score").between(0, 10_000_000)).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def key_scan_glob(spark, d):
    c = table(spark, d, "customer").select(F.concat(F.lit("cust:"), F.col("c_mktsegment"), F.lit(":"), F.col("c_custkey").cast("string")).alias("key"))
    return K.scan(c, "key", "cust:[A-M]*:?[02468]*")


def _keyspace(spark, d):
    o, e = _orders(spark, d), table(spark, d, "events")
    return o.select(F.concat(F.lit("h:"), F.col("key").cast("string")).alias("key"), F.lit("hash").alias("type")).unionByName(e.select(F.concat(F.lit("s:"), F.col("user_id").cast("string")).alias("key"), F.lit("stream").alias("type"))).distinct()


def key_type(spark, d):
    """TYPE of each customer's hash: none if there is no such key."""
    want = table(spark, d, "customer").select(F.concat(F.lit("h:"), F.col("c_custkey").cast("string")).alias("key"))
    return K.lookup(_keyspace(spark, d), want, ["key"]).select("key", F.coalesce("type", F.lit("none")).alias("type"))


def flush_db(spark, d):
    """FLUSHDB at the dearest order of each database (status): what was written after it."""
    log = _orders(spark, d)
    dearest = log.groupBy("field").agg(F.max_by("seq", F.struct("cents", "seq")).alias("seq"))
    return K.last_write(K.since_flush(log, dearest, ["field"]), ["field", "key"], "cents")


def flush_all(spark, d):
    """FLUSHALL at the dearest order of all."""
    log = _orders(spark, d)
    return K.last_write(K.since_flush(log, log.select(F.max_by("seq", F.struct("cents", "seq")).alias("seq")), []), ["field", "key"], "cents")


def expire_family(spark, d):
    """EXPIRE, PEXPIRE, EXPIREAT, PERSIST and SET by event type, in order; PTTL of each user at the end of January 25."""
    at = F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts) * 1000")
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), F.struct("ts", "event_id").alias("seq"), "event_type", at.alias("at"))
    kinds = {"click": ("expire", F.lit(432_000)), "view": ("pexpire", F.lit(259_200_500)), "signup": ("expireat", F.lit(1_706_300_000)), "purchase": ("persist", F.lit(0))}
    op, arg = F.lit("set"), F.lit(0)
    for kind, (name, value) in kinds.items():
        op, arg = F.when(F.col("event_type") == kind, name).otherwise(op), F.when(F.col("event_type") == kind, value).otherwise(arg)
    state = K.expiries(e.select("key", "seq", "at", op.alias("op"), arg.cast("bigint").alias("arg")))
    return state.select(F.col("key").alias("user_id"), K.ttl(F.col("expires"), 1_706_227_200_000).alias("pttl"))


def hash_field_expire(spark, d):
    """HEXPIREAT of two fields of each customer at January 25: the codes."""
    fields = hash_last_write(spark, d)
    want = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.explode(F.array(F.lit("F"), F.lit("P"))).alias("field"), F.lit(1_706_227_200).alias("at"), (F.lit(1_706_227_200) + (F.col("c_custkey") % 3) - 1).alias("until"))
    return K.field_expiry_codes(want, fields).select("key", "field", "code")


def hash_setnx(spark, d):
    """HSETNX: the first write of a field stays. HSTRLEN of what it holds."""
    first = _orders(spark, d).groupBy("key", "field").agg(F.min_by("cents", "seq").alias("cents"))
    return first.select("key", "field", "cents", F.length(F.col("cents").cast("string")).alias("length"))


def hash_slots(spark, d):
    """Slots of keys with and without a tag in braces."""
    c = table(spark, d, "customer")
    tagged = F.concat(F.lit("{"), F.col("c_mktsegment"), F.lit("}:"), F.col("c_custkey").cast("string"))
    return c.select("c_custkey", K.hash_slot(tagged).cast("bigint").alias("tagged"), K.hash_slot(F.col("c_name")).cast("bigint").alias("plain"))


def db_size(spark, d):
    return _keyspace(spark, d).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def ttl_expiry(spark, d):
    """Each user's last event sets an expiry of 5 days, purchases take it off; at the end of January 25 what is left, in seconds."""
    e = table(spark, d, "events")
    at = F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    last = e.select("user_id", "event_id", "event_type", at.alias("at")).groupBy("user_id").agg(F.max_by(F.struct("event_type", "at"), F.struct("at", "event_id")).alias("v"))
    expires = F.when(F.col("v.event_type") != "purchase", F.col("v.at") + 5 * 86400)
    return last.select("user_id", K.ttl(expires, 1706227200).alias("ttl"))


def hash_field_ttl(spark, d):
    """Expiry per field: a user's event type lives three days from its last event."""
    e = table(spark, d, "events").select("user_id", "event_type", F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").alias("at"))
    last = e.groupBy("user_id", "event_type").agg((F.max("at") + 3 * 86400).alias("expires"))
    return last.select("user_id", "event_type", K.ttl(F.col("expires"), 1706227200).alias("ttl"))


def bitmap_count_pos(spark, d):
    """Days of the month a user was active: count, first set bit, first clear bit from 0."""
    e = table(spark, d, "events").select("user_id", (F.dayofmonth("ts") - 1).cast("int").alias("bit")).distinct()
    word = F.expr("bit_or(shiftleft(cast(1 as bigint), bit))").alias("word")
    m = e.groupBy("user_id").agg(word)
    clear = F.bit_count((F.col("word")).bitwiseAND(F.bitwise_not(F.col("word") + 1)))
    return m.select("user_id", F.bit_count("word").cast("bigint").alias("n"), F.bit_count((F.col("word").bitwiseAND(-F.col("word"))) - 1).cast("bigint").alias("first_set"), clear.cast("bigint").alias("first_clear"))


def _places(spark, d):
    s = table(spark, d, "supplier")
    return s.select(F.col("s_suppkey").alias("member"), ((F.col("s_suppkey") * 37) % 360 - 180.0).alias("lon"), ((F.col("s_suppkey") * 53) % 170 - 85.0).alias("lat"))


def geo_distance(spark, d):
    return _places(spark, d).select("member", *[F.round(geo.distance(F.col("lon"), F.col("lat"), F.lit(13.5), F.lit(52.5), u), 3).alias(u) for u in ("m", "km", "mi", "ft")])


def geo_positions(spark, d):
    """GEOPOS of every supplier and a member that isn't there: nulls."""
    want = table(spark, d, "supplier").select(F.explode(F.array(F.col("s_suppkey"), -F.col("s_suppkey"))).alias("member"))
    return K.lookup(_places(spark, d), want, ["member"]).select("member", "lon", "lat")


def geo_radius(spark, d):
    """Members within 5000 km of a point, nearest first, ten at most."""
    near = _places(spark, d).select("member", F.round(geo.distance(F.col("lon"), F.col("lat"), F.lit(13.5), F.lit(52.5), "km"), 3).alias("km"))
    return near.filter("km <= 5000").orderBy("km", "member").limit(10)


def batch_hash_fields(spark, d):
    """A request table of (key, field) read at once: every customer's O field and a missing one."""
    want = table(spark, d, "customer").select(F.col("c_custkey").alias("key")).withColumn("field", F.explode(F.array(F.lit("O"), F.lit("nope"))))
    return K.lookup(hash_last_write(spark, d), want, ["key", "field"]).select("key", "field", F.col("cents").cast("string").alias("value"))


def hash_scan(spark, d):
    """HSCAN: the fields of every hash that match a pattern, in pages of 500 by key and field."""
    from pyspark.sql import Window

    found = K.scan(hash_last_write(spark, d), "field", "[FP]")
    bucket = F.floor(F.col("key") / 100)
    w = Window.partitionBy("bucket").orderBy("key", "field")
    return found.withColumn("bucket", bucket).select("key", "field", "bucket", F.floor((F.row_number().over(w) - 1) / 500).alias("page"))


def key_exists(spark, d):
    """EXISTS of every customer's list of orders."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("key"))
    hit = _orders(spark, d).select("key").distinct().withColumn("hit", F.lit(1))
    return c.join(hit, "key", "left").select("key", F.coalesce("hit", F.lit(0)).alias("found"))


def string_ranges(spark, d):
    """GETRANGE 2 5 and STRLEN of part names."""
    p = table(spark, d, "part")
    return p.select("p_partkey", F.substring("p_name", 3, 4).alias("part"), F.length("p_name").alias("length"))


def flush(spark, d):
    """DEL of every key whose last order is low priority, then the size of the keyspace."""
    last = _orders(spark, d).groupBy("key").agg(F.max_by("member", "seq").alias("member"))
    return last.groupBy((F.col("member") == "5-LOW").alias("deleted")).agg(F.count(F.lit(1)).alias("n"))


def group_commit(spark, d):
    """Commit groups (new behaviour): all writes of an order date are seen together; the last group wins per field."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderstatus").alias("field"), F.to_date("o_orderdate").alias("grp"), F.expr("cast(round(o_totalprice * 100) as bigint)").alias("cents"))
    sums = o.groupBy("key", "field", "grp").agg(F.sum("cents").alias("cents"))
    return sums.groupBy("key", "field").agg(F.max_by("cents", "grp").alias("cents"))


def script_eval(spark, d):
    """A script loaded once and run by its digest: for each hash the last dear order."""
    scripts = Scripts(spark)
    digest = scripts.load("SELECT key, max_by(cents, seq) AS cents, count(*) AS n FROM {log} WHERE cents > :least GROUP BY key")
    return scripts.evalsha(digest, {"least": 10_000_000}, log=_orders(spark, d))


LOG = "WITH log AS (SELECT o_custkey AS key, o_orderstatus AS field, o_orderpriority AS member, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, o_orderkey AS seq FROM orders)"
LAST = f"{LOG}, state AS (SELECT key, field, arg_max(cents, seq) AS cents FROM log GROUP BY 1, 2)"
LISTS = f"{LOG}, l AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY CASE WHEN field = 'F' THEN 0 ELSE 1 END, CASE WHEN field = 'F' THEN -seq ELSE seq END) - 1 AS pos, cents AS value, count(*) OVER (PARTITION BY key) AS n FROM log)"
TAGS = f"{LOG}, t AS (SELECT DISTINCT member AS key, key AS member FROM log)"
RANKS = f"{LOG}, z AS (SELECT key, seq AS member, cents AS score FROM log), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score, member) - 1 AS rank, row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC) - 1 AS rev_rank FROM z)"
PLACES = "WITH p AS (SELECT s_suppkey AS member, (s_suppkey * 37) % 360 - 180.0::DOUBLE AS lon, (s_suppkey * 53) % 170 - 85.0::DOUBLE AS lat FROM supplier), g AS (SELECT member, 2.0::DOUBLE * 6372797.560856::DOUBLE * asin(sqrt(pow(sin((radians(52.5) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(52.5)) * pow(sin((radians(13.5) - radians(lon)) / 2), 2))) AS m FROM p)"

#: One command's effect on a list, for a recursive query over each key's commands in order.
LIST_SQL = """
WITH RECURSIVE {log}, c AS (SELECT key, {columns}, row_number() OVER (PARTITION BY key ORDER BY seq) AS i FROM log),
s AS (
  SELECT DISTINCT key, CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS v FROM c
  UNION ALL
  SELECT s.key, c.i, CASE c.op
      WHEN 'lpush' THEN list_prepend(c.x, s.v) WHEN 'rpush' THEN list_append(s.v, c.x)
      WHEN 'lpop' THEN s.v[2:] WHEN 'rpop' THEN s.v[:greatest(len(s.v) - 1, 0)]
      WHEN 'set' THEN CASE WHEN len(s.v) = 0 THEN s.v ELSE list_append(s.v[:len(s.v) - 1], c.x) END
      WHEN 'rem1' THEN CASE WHEN list_contains(s.v, c.x) THEN s.v[:list_position(s.v, c.x) - 1] || s.v[list_position(s.v, c.x) + 1:] ELSE s.v END
      WHEN 'remlast' THEN CASE WHEN list_contains(s.v, c.x) THEN s.v[:len(s.v) - list_position(list_reverse(s.v), c.x)] || s.v[len(s.v) - list_position(list_reverse(s.v), c.x) + 2:] ELSE s.v END
      WHEN 'remall' THEN list_filter(s.v, lambda y: y <> c.x)
      WHEN 'trim' THEN s.v[:greatest(len(s.v) - 1, 0)]
      WHEN 'before' THEN CASE WHEN list_contains(s.v, 'O') THEN s.v[:list_position(s.v, 'O') - 1] || [c.x] || s.v[list_position(s.v, 'O'):] ELSE s.v END
      ELSE s.v END
  FROM s JOIN c ON c.key = s.key AND c.i = s.i + 1),
l AS (SELECT key, arg_max(v, i) AS v FROM s GROUP BY 1)
SELECT key, CAST(p - 1 AS BIGINT) AS pos, v[p] AS value FROM (SELECT key, v, unnest(range(1, len(v) + 1)) AS p FROM l)
"""
PLAIN = LOG.removeprefix("WITH ")
LIST_REPLAY = LIST_SQL.format(log=PLAIN, columns="CASE WHEN member = '1-URGENT' THEN 'lpop' WHEN member = '5-LOW' THEN 'rem1' WHEN field = 'F' THEN 'lpush' ELSE 'rpush' END AS op, field AS x")
LIST_MIXED = LIST_SQL.format(
    log=PLAIN,
    columns="""CASE WHEN field = 'P' AND member = '1-URGENT' THEN 'set' WHEN field = 'P' AND member = '2-HIGH' THEN 'rpop' WHEN field = 'P' AND member = '3-MEDIUM' THEN 'trim' WHEN field = 'P' THEN 'before'
    WHEN member = '5-LOW' AND field = 'F' THEN 'remlast' WHEN member = '5-LOW' THEN 'remall' WHEN field = 'F' THEN 'lpush' ELSE 'rpush' END AS op,
    CASE WHEN field = 'P' THEN member WHEN member = '5-LOW' THEN 'O' ELSE field END AS x""",
)
SETS = (
    LOG
    + """, c AS (SELECT *, CASE member WHEN '1-URGENT' THEN '{first}' WHEN '5-LOW' THEN '{second}' ELSE '' END AS flag FROM log),
    f AS (SELECT key, min(seq) AS s FROM c WHERE flag <> 'xx' GROUP BY 1)
    SELECT key, arg_max(cents, seq) AS value FROM c JOIN f USING (key) WHERE seq = s OR (seq > s AND flag <> 'nx') GROUP BY 1"""
)
SET_EXPIRY = f"""
WITH RECURSIVE {PLAIN}, c AS (
  SELECT key, seq * 1000 AS ms, cents, member, CASE member WHEN '4-NOT SPECIFIED' THEN 2000000 WHEN '5-LOW' THEN 900000 END AS ttl, row_number() OVER (PARTITION BY key ORDER BY seq) AS i FROM log),
s AS (
  SELECT DISTINCT key, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS value, CAST(NULL AS BIGINT) AS expires FROM c
  UNION ALL
  SELECT key, i, CASE WHEN takes THEN cents WHEN alive THEN value END, CASE WHEN takes THEN ms + ttl WHEN alive THEN expires END
  FROM (SELECT *, CASE WHEN member IN ('2-HIGH', '5-LOW') THEN NOT alive WHEN member = '3-MEDIUM' THEN alive ELSE TRUE END AS takes
        FROM (SELECT c.*, s.value, s.expires, s.value IS NOT NULL AND (s.expires IS NULL OR s.expires > c.ms) AS alive FROM s JOIN c ON c.key = s.key AND c.i = s.i + 1)))
SELECT key, value, expires FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY i DESC) AS last FROM s) WHERE last = 1
"""
#: CRC16 bit by bit, where the engine uses a table of bytes.
CRC = "list_reduce(list_prepend(0, list_transform(range(octet_length(encode({c}))), lambda i: CAST(('0x' || substr(hex(encode({c})), 2 * i + 1, 2)) AS INTEGER))), lambda x, b: list_reduce(list_prepend(xor(x, b * 256), [0, 0, 0, 0, 0, 0, 0, 0]), lambda y, z: CASE WHEN y >= 32768 THEN xor((y * 2) & 65535, 4129) ELSE y * 2 END)) % 16384"
HASH_SLOTS = f"SELECT c_custkey, CAST({CRC.format(c='c_mktsegment')} AS BIGINT) AS tagged, CAST({CRC.format(c='c_name')} AS BIGINT) AS plain FROM customer"

QUERIES = {
    "hash_last_write": (hash_last_write, f"{LAST} SELECT * FROM state"),
    "hash_getall": (hash_getall, f"{LAST} SELECT key, count(*) AS length, string_agg(field || '=' || cents, ',' ORDER BY field) AS pairs FROM state GROUP BY 1"),
    "hash_hmget": (hash_hmget, f"{LAST} SELECT c_custkey AS key, CAST(w.ord AS INTEGER) AS ord, w.field, CAST(s.cents AS VARCHAR) AS value FROM customer CROSS JOIN (VALUES (0, 'F'), (1, 'O'), (2, 'X')) w(ord, field) LEFT JOIN state s ON s.key = c_custkey AND s.field = w.field"),
    "hash_del": (hash_del, f"{LOG}, n AS (SELECT *, row_number() OVER (PARTITION BY key, field ORDER BY seq DESC) AS i FROM log) SELECT key, field, cents FROM n WHERE i = 1 AND member <> '5-LOW'"),
    "hash_hincrby": (
        hash_incr,
        f"{LOG}, b AS (SELECT key, field, max(CASE WHEN member = '1-URGENT' THEN seq END) AS s FROM log GROUP BY 1, 2) SELECT key, field, CAST(sum(cents) FILTER (WHERE s IS NULL OR seq >= s) AS BIGINT) AS value FROM log JOIN b USING (key, field) GROUP BY 1, 2",
    ),
    "counter_replay": (
        counter_replay,
        f"{LOG}, b AS (SELECT key, max(CASE WHEN member = '1-URGENT' THEN seq END) AS s FROM log GROUP BY 1) SELECT key, CAST(sum(cents) FILTER (WHERE s IS NULL OR seq >= s) AS BIGINT) AS value FROM log JOIN b USING (key) GROUP BY 1",
    ),
    "string_set_nx": (string_set_nx, SETS.format(first="nx", second="nx")),
    "string_set_xx": (string_set_xx, SETS.format(first="xx", second="xx")),
    "string_set_mixed": (string_set_mixed, SETS.format(first="nx", second="xx")),
    "string_set_expiry": (string_set_expiry, SET_EXPIRY),
    "string_getset": (string_getset, f"{LOG} SELECT key, seq, lag(cents) OVER (PARTITION BY key ORDER BY seq) AS old FROM log"),
    "string_getdel": (
        string_getdel,
        f"{LOG}, l AS (SELECT *, lag(member) OVER w AS m0, lag(cents) OVER w AS c0 FROM log WINDOW w AS (PARTITION BY key ORDER BY seq)) SELECT key, seq, CASE WHEN m0 <> '5-LOW' THEN c0 END AS value FROM l WHERE member = '5-LOW'",
    ),
    "string_append": (string_append, f"{LOG}, a AS (SELECT key, string_agg(field || substr(member, 1, 1), '' ORDER BY seq) AS value FROM log GROUP BY 1) SELECT key, value, CAST(length(value) AS INTEGER) AS length FROM a"),
    "list_state": (list_state, f"{LISTS} SELECT key, pos, value FROM l"),
    "list_range": (list_range, f"{LISTS} SELECT key, pos, value FROM l WHERE pos BETWEEN 1 AND 3"),
    "list_trim": (list_trim, f"{LISTS} SELECT key, pos, value FROM l WHERE pos BETWEEN greatest(n - 4, 0) AND n - 2"),
    "list_index": (list_index, f"{LISTS} SELECT key, value FROM l WHERE pos = n - 1"),
    "list_replay": (list_replay, LIST_REPLAY),
    "list_mixed": (list_mixed, LIST_MIXED),
    "stream_rev_range": (stream_rev_range, "SELECT user_id, event_id, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events WHERE ts < TIMESTAMP '2024-01-20') WHERE place <= 2"),
    "set_remove": (set_remove, f"{LOG}, l AS (SELECT key, field, arg_max(member, seq) AS last FROM log GROUP BY 1, 2) SELECT key, field AS member FROM l WHERE last <> '5-LOW'"),
    "set_scan": (set_scan, f"{TAGS}, m AS (SELECT key, CAST(member AS VARCHAR) AS member FROM t) SELECT key, member, (row_number() OVER (PARTITION BY key ORDER BY member) - 1) // 100 AS page FROM m WHERE regexp_full_match(member, '.*[1-4]')"),
    "set_random": (set_random, f"{TAGS} SELECT key, member FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY md5('0:' || member), member) AS i FROM t) WHERE i <= 3"),
    "set_pop": (set_pop, f"{TAGS} SELECT key, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY md5('pop:' || member), member) AS i FROM t) WHERE i > 3 GROUP BY 1"),
    "set_is_member": (set_is_member, f"{TAGS} SELECT c_custkey AS member, CASE WHEN c_custkey IN (SELECT member FROM t WHERE key = '1-URGENT') THEN 1 ELSE 0 END AS found FROM customer"),
    "zset_pop_max": (zset_pop_max, f"{RANKS} SELECT key, member, score FROM r WHERE rev_rank = 0"),
    "zset_range_open": (zset_range_open, f"{RANKS}, o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score, member) AS i FROM r WHERE score > 5000000) SELECT key, member, score FROM o WHERE i IN (2, 3)"),
    "zset_range_index": (zset_range_index, f"{RANKS} SELECT key, member, score, rank AS pos FROM r WHERE rank >= 1 AND rev_rank >= 1"),
    "zset_rev_range_index": (zset_rev_range_index, f"{RANKS} SELECT key, member, score, rev_rank AS pos FROM r WHERE rank < 3"),
    "zset_remove": (zset_remove, f"{LOG}, l AS (SELECT key, field AS member, arg_max(member, seq) AS last, arg_max(cents, seq) AS score FROM log GROUP BY 1, 2) SELECT key, member, score FROM l WHERE last <> '5-LOW'"),
    "zset_scan": (zset_scan, f"{RANKS}, m AS (SELECT key, CAST(member AS VARCHAR) AS member, score FROM r) SELECT key, member, score, (row_number() OVER (PARTITION BY key ORDER BY member) - 1) // 3 AS page FROM m WHERE regexp_full_match(member, '.*[02468]')"),
    "zset_by_lex": (zset_by_lex, f"{LOG} SELECT DISTINCT key, member FROM log WHERE member IN ('2-HIGH', '3-MEDIUM')"),
    "zset_scores": (zset_scores, f"{LOG}, z AS (SELECT key, field, max(cents) AS score FROM log GROUP BY 1, 2) SELECT c_custkey AS key, w.member, CAST(score AS VARCHAR) AS score FROM customer CROSS JOIN (VALUES ('O'), ('Q')) w(member) LEFT JOIN z ON z.key = c_custkey AND z.field = w.member"),
    "key_type": (key_type, "SELECT 'h:' || c_custkey AS key, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'hash' ELSE 'none' END AS type FROM customer"),
    "flush_db": (flush_db, f"{LOG}, f AS (SELECT field, arg_max(seq, (cents, seq)) AS cut FROM log GROUP BY 1) SELECT field, key, arg_max(cents, seq) AS cents FROM log JOIN f USING (field) WHERE seq > cut GROUP BY 1, 2"),
    "flush_all": (flush_all, f"{LOG} SELECT field, key, arg_max(cents, seq) AS cents FROM log WHERE seq > (SELECT arg_max(seq, (cents, seq)) FROM log) GROUP BY 1, 2"),
    "expire_family": (
        expire_family,
        """WITH l AS (SELECT user_id, event_type, CAST(floor(epoch(ts)) AS BIGINT) * 1000 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS i FROM events),
        x AS (SELECT user_id, CASE event_type WHEN 'click' THEN ms + 432000000 WHEN 'view' THEN ms + 259200500 WHEN 'signup' THEN 1706300000000 END AS x FROM l WHERE i = 1)
        SELECT user_id, CAST(CASE WHEN x IS NULL THEN -1 WHEN x <= 1706227200000 THEN -2 ELSE x - 1706227200000 END AS BIGINT) AS pttl FROM x""",
    ),
    "hash_field_expire": (
        hash_field_expire,
        f"{LAST} SELECT c_custkey AS key, w.field, CASE WHEN s.cents IS NULL THEN -2 WHEN c_custkey % 3 = 2 THEN 1 ELSE 2 END AS code FROM customer CROSS JOIN (VALUES ('F'), ('P')) w(field) LEFT JOIN state s ON s.key = c_custkey AND s.field = w.field",
    ),
    "hash_setnx": (hash_setnx, f"{LOG}, m AS (SELECT key, field, arg_min(cents, seq) AS cents FROM log GROUP BY 1, 2) SELECT *, CAST(length(CAST(cents AS VARCHAR)) AS INTEGER) AS length FROM m"),
    "hash_slots": (hash_slots, HASH_SLOTS),
    "script_eval": (script_eval, f"{LOG} SELECT key, arg_max(cents, seq) AS cents, count(*) AS n FROM log WHERE cents > 10000000 GROUP BY 1"),
    "geo_positions": (geo_positions, f"{PLACES} SELECT w.m * s_suppkey AS member, lon, lat FROM supplier CROSS JOIN (VALUES (1), (-1)) w(m) LEFT JOIN p ON p.member = w.m * s_suppkey"),
    "stream_range": (stream_range, "SELECT user_id, event_id, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20') WHERE place <= 3"),
    "stream_maxlen": (stream_maxlen, "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS i FROM events) WHERE i <= 5"),
    "stream_delete": (stream_delete, "SELECT user_id, count(*) AS length FROM events WHERE event_type <> 'signup' GROUP BY 1"),
    "set_intersect_tags": (set_intersect, f"{TAGS} SELECT member FROM t WHERE key IN ('1-URGENT', '2-HIGH', '5-LOW') GROUP BY 1 HAVING count(*) = 3"),
    "set_union": (set_union, f"{TAGS} SELECT DISTINCT member FROM t WHERE key IN ('1-URGENT', '2-HIGH')"),
    "set_difference": (set_difference, f"{TAGS} SELECT member FROM t WHERE key = '1-URGENT' EXCEPT SELECT member FROM t WHERE key = '2-HIGH'"),
    "set_cardinality": (set_cardinality, f"{TAGS} SELECT key, count(*) AS n FROM t GROUP BY 1"),
    "zset_rank": (zset_rank, f"{RANKS} SELECT * FROM r"),
    "zset_range_by_score": (zset_range_by_score, f"{RANKS} SELECT key, member, score FROM r WHERE score BETWEEN 5000000 AND 15000000"),
    "zset_count": (zset_count, f"{RANKS} SELECT key, count(*) AS n FROM r WHERE score BETWEEN 5000000 AND 15000000 GROUP BY 1"),
    "zset_incr": (zset_incr, f"{LOG} SELECT key, member, CAST(sum(cents) AS BIGINT) AS score FROM log GROUP BY 1, 2"),
    "zset_top_k": (zset_top_k, f"{RANKS} SELECT key, member, score, rev_rank + 1 AS place FROM r WHERE rev_rank < 3"),
    "zset_pop_min": (zset_pop_min, f"{RANKS} SELECT key, member, score FROM r WHERE rank = 0"),
    "zset_remove_by_score": (zset_remove_by_score, f"{RANKS} SELECT key, count(*) AS n FROM r WHERE NOT score BETWEEN 0 AND 10000000 GROUP BY 1"),
    "key_scan_glob": (key_scan_glob, "SELECT 'cust:' || c_mktsegment || ':' || c_custkey AS key FROM customer WHERE regexp_full_match('cust:' || c_mktsegment || ':' || c_custkey, 'cust:[A-M].*:.[02468].*')"),
    "db_size": (db_size, "SELECT 'hash' AS type, count(DISTINCT o_custkey) AS n FROM orders UNION ALL SELECT 'stream', count(DISTINCT user_id) FROM events"),
    "ttl_expiry": (
        ttl_expiry,
        "WITH l AS (SELECT user_id, event_type, CAST(floor(epoch(ts)) AS BIGINT) + 432000 AS x, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)) DESC, event_id DESC) AS i FROM events) SELECT user_id, CAST(CASE WHEN event_type = 'purchase' THEN -1 WHEN x <= 1706227200 THEN -2 ELSE x - 1706227200 END AS BIGINT) AS ttl FROM l WHERE i = 1",
    ),
    "hash_field_ttl": (hash_field_ttl, "WITH l AS (SELECT user_id, event_type, max(CAST(floor(epoch(ts)) AS BIGINT)) + 259200 AS x FROM events GROUP BY 1, 2) SELECT user_id, event_type, CAST(CASE WHEN x <= 1706227200 THEN -2 ELSE x - 1706227200 END AS BIGINT) AS ttl FROM l"),
    "bitmap_count_pos": (
        bitmap_count_pos,
        "WITH b AS (SELECT DISTINCT user_id, day(ts) - 1 AS bit FROM events), c AS (SELECT user_id, list(bit) AS bits FROM b GROUP BY 1) SELECT user_id, CAST(len(bits) AS BIGINT) AS n, CAST(list_min(bits) AS BIGINT) AS first_set, CAST(list_min(list_filter(range(64), lambda x: NOT list_contains(bits, x))) AS BIGINT) AS first_clear FROM c",
    ),
    "geo_distance": (geo_distance, f"{PLACES} SELECT member, round(m, 3) AS m, round(m / 1000.0, 3) AS km, round(m / 1609.34, 3) AS mi, round(m / 0.3048, 3) AS ft FROM g"),
    "geo_radius": (geo_radius, f"{PLACES} SELECT member, round(m / 1000.0, 3) AS km FROM g WHERE round(m / 1000.0, 3) <= 5000 ORDER BY 2, 1 LIMIT 10"),
    "multi_hash_fields": (batch_hash_fields, f"{LAST} SELECT c_custkey AS key, w.field, CAST(s.cents AS VARCHAR) AS value FROM customer CROSS JOIN (VALUES ('O'), ('nope')) w(field) LEFT JOIN state s ON s.key = c_custkey AND s.field = w.field"),
    "hash_scan": (hash_scan, f"{LAST}, f AS (SELECT key, field, key // 100 AS bucket FROM state WHERE field IN ('F', 'P')) SELECT key, field, bucket, (row_number() OVER (PARTITION BY bucket ORDER BY key, field) - 1) // 500 AS page FROM f"),
    "key_exists": (key_exists, "SELECT c_custkey AS key, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 1 ELSE 0 END AS found FROM customer"),
    "string_ranges": (string_ranges, "SELECT p_partkey, substr(p_name, 3, 4) AS part, CAST(length(p_name) AS INTEGER) AS length FROM part"),
    "delete_keys": (flush, f"{LOG}, l AS (SELECT key, arg_max(member, seq) = '5-LOW' AS deleted FROM log GROUP BY 1) SELECT deleted, count(*) AS n FROM l GROUP BY 1"),
    "group_commit": (group_commit, "WITH s AS (SELECT o_custkey AS key, o_orderstatus AS field, CAST(o_orderdate AS DATE) AS grp, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM orders GROUP BY 1, 2, 3) SELECT key, field, arg_max(cents, grp) AS cents FROM s GROUP BY 1, 2"),
}
