"""Key-value collections as logs: state is a query over ordered commands.

A log has seq (order), key and, by command, field, member, value, score or delta. Last writes are ``max_by``,
which Spark combines before the shuffle, so a hot key costs no more than its distinct fields.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def glob_regex(pattern: str) -> str:
    """A glob (``*``, ``?``, classes, backslash) as a regular expression for the whole key."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        elif c == "[" and "]" in pattern[i + 1 :]:
            end = pattern.index("]", i + 1)
            body = pattern[i + 1 : end]
            out.append("[" + body.replace("\\", "\\\\") + "]")
            i = end
        else:
            out.append({"*": ".*", "?": "."}.get(c) or re.escape(c))
        i += 1
    return "(?s)^" + "".join(out) + "$"


def scan(rows: DataFrame, column: str, pattern: str) -> DataFrame:
    return rows.filter(F.col(column).rlike(glob_regex(pattern)))


def last_write(log: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """State after all writes: the last value by seq; a null value is a deletion."""
    return log.groupBy(*by).agg(F.max_by(value, "seq").alias(value)).filter(F.col(value).isNotNull())


def set_if(log: DataFrame) -> DataFrame:
    """SET replay without expiry: flag "" always writes, "nx" only where the key is absent, "xx" only where it is present.

    A key is present from its first plain or NX write on, so no fold is needed: the last write that took effect wins."""
    creates = F.when(F.col("flag") != "xx", F.col("seq"))
    first = log.groupBy("key").agg(F.min(creates).alias("first")).filter("first is not null")
    took = (F.col("seq") == F.col("first")) | ((F.col("seq") > F.col("first")) & (F.col("flag") != "nx"))
    return log.join(first, "key").filter(took).groupBy("key").agg(F.max_by("value", "seq").alias("value"))


def ordered_log(log: DataFrame, *columns: str) -> DataFrame:
    """(key, log array<struct>): each key's commands by seq, for folds in the JVM. A key's fold runs in one task; keys are many."""
    return log.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("seq", *columns))).alias("log"))


def set_replay(log: DataFrame) -> DataFrame:
    """(key, value, expires) after SET with flags and expiry: (seq, key, at, flag, value, ttl). A write without ttl clears the expiry;
    a key is absent from its expiry on. NX and XX depend on that, so it is a fold in order. ``value`` is null for absent keys at the last command's time."""
    state = F.struct(F.lit(None).cast("string").alias("value"), F.lit(None).cast("bigint").alias("expires"))

    def step(s: Column, c: Column) -> Column:
        alive = s["value"].isNotNull() & (s["expires"].isNull() | (s["expires"] > c["at"]))
        takes = (c["flag"] == "") | ((c["flag"] == "nx") & ~alive) | ((c["flag"] == "xx") & alive)
        new = F.struct(c["value"].cast("string").alias("value"), (c["at"] + c["ttl"]).alias("expires"))
        return F.when(takes, new).when(alive, s).otherwise(state)

    folded = ordered_log(log, "at", "flag", "value", "ttl").select("key", F.aggregate("log", state, step).alias("s"))
    return folded.select("key", "s.value", "s.expires")


def counters(log: DataFrame, by: list[str]) -> DataFrame:
    """Last SET (op "set") plus the deltas after it (op "incr"), from 0 where none was set. One pass: sums up to each row need no join."""
    w = Window.partitionBy(*by).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    upto = log.withColumn("total", F.sum(F.when(F.col("op") == "incr", F.col("delta")).otherwise(0)).over(w))
    out = upto.groupBy(*by).agg(
        F.max_by("total", "seq").alias("total"),
        F.max_by(F.when(F.col("op") == "set", F.struct("delta", "total")), F.when(F.col("op") == "set", F.col("seq"))).alias("base"),
    )
    return out.select(*by, (F.col("total") - F.coalesce(F.col("base.total"), F.lit(0)) + F.coalesce(F.col("base.delta"), F.lit(0))).alias("value"))


def appended(log: DataFrame) -> DataFrame:
    """APPEND: the values of a key one after another, and their length."""
    out = log.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "value"))), lambda s: s["value"]), "").alias("value"))
    return out.withColumn("length", F.length("value"))


def lookup(state: DataFrame, requests: DataFrame, on: list[str]) -> DataFrame:
    """Values in the order of the requests; misses are null."""
    return requests.join(state, on, "left")


def list_state(pushes: DataFrame) -> DataFrame:
    """(key, pos, value) of lists that are only pushed to, side "l" or "r": left pushes come in reverse."""
    place = F.when(F.col("side") == "l", -F.col("seq")).otherwise(F.col("seq"))
    w = Window.partitionBy("key").orderBy(F.when(F.col("side") == "l", 0).otherwise(1), place)
    return pushes.select("key", (F.row_number().over(w) - 1).alias("pos"), "value")


def index_range(state: DataFrame, start: int, stop: int) -> DataFrame:
    """Positions start..stop of each key, both included; negative ones count from the end."""
    n = F.count(F.lit(1)).over(Window.partitionBy("key"))
    resolve = lambda i: F.lit(i) if i >= 0 else n + i
    out = state.withColumns({"_a": F.greatest(resolve(start), F.lit(0)), "_b": resolve(stop)})
    return out.filter(F.col("pos").between(F.col("_a"), F.col("_b"))).drop("_a", "_b")


def fold_list(items: list, op: str, arg, value) -> list:
    """One list command. rem: arg > 0 from the head, < 0 from the tail, 0 all; trim and set take positions."""
    if op == "rpush":
        return [*items, value]
    if op == "lpush":
        return [value, *items]
    if op == "rpop":
        return items[:-1]
    if op == "lpop":
        return items[1:]
    if op == "set":
        if -len(items) <= arg < len(items):
            items = list(items)
            items[int(arg)] = value
        return items
    if op == "rem":
        left, out = (abs(int(arg)) or len(items)), []
        for x in items if arg >= 0 else items[::-1]:
            if x == value and left:
                left -= 1
            else:
                out.append(x)
        return out if arg >= 0 else out[::-1]
    if op == "trim":
        a, b = arg
        n = len(items)
        a, b = max(0, a + n if a < 0 else a), (b + n if b < 0 else b)
        return items[a : b + 1]
    raise ValueError(f"unknown list command {op}")


def _removed(items: Column, value: Column, n: Column) -> Column:
    """LREM: ``n`` matches from the head, -n from the tail, all for 0."""
    at = F.filter(F.sequence(F.lit(1), F.size(items)), lambda i: F.get(items, i - 1) == value)
    gone = F.when(n > 0, F.slice(at, 1, n)).when(n < 0, F.slice(F.reverse(at), 1, -n)).otherwise(at)
    return F.when(F.size(items) == 0, items).otherwise(F.filter(items, lambda x, i: ~F.array_contains(gone, i + 1)))


def _trimmed(items: Column, start: Column, stop: Column) -> Column:
    n = F.size(items)
    a = F.greatest(F.when(start < 0, start + n).otherwise(start), F.lit(0))
    b = F.least(F.when(stop < 0, stop + n).otherwise(stop), n - 1)
    return F.when(b < a, F.slice(items, 1, 0)).otherwise(F.slice(items, a + 1, F.greatest(b - a + 1, F.lit(0))))


def replay_lists(log: DataFrame) -> DataFrame:
    """(key, pos, value) after mixed list commands (seq, key, op, arg, value, optionally stop, pivot).

    lpush, rpush, lpop, rpop; set and rem with arg; trim from arg to stop; before and after insert value at the first pivot.
    Mixed commands depend on order, so each key is a fold, in the JVM: no key is a Python call or frame of its own."""
    more = {c: F.lit(None).cast(t) for c, t in (("stop", "int"), ("pivot", "string")) if c not in log.columns}
    plain = log.withColumns(more).withColumns({"arg": F.col("arg").cast("int"), "stop": F.col("stop").cast("int"), "value": F.col("value").cast("string")})

    def step(items: Column, c: Column) -> Column:
        one, op, n = F.array(c["value"]), c["op"], F.size(items)
        at = F.when(c["arg"] < 0, c["arg"] + n).otherwise(c["arg"])
        found = F.array_position(items, c["pivot"]).cast("int")
        cut = F.when(op == "before", found - 1).otherwise(found)
        return (
            F.when(op == "rpush", F.concat(items, one))
            .when(op == "lpush", F.concat(one, items))
            .when(op == "rpop", F.slice(items, 1, F.greatest(n - 1, F.lit(0))))
            .when(op == "lpop", F.slice(items, 2, F.greatest(n - 1, F.lit(0))))
            .when(op == "set", F.transform(items, lambda x, i: F.when(i == at, c["value"]).otherwise(x)))
            .when(op == "rem", _removed(items, c["value"], c["arg"]))
            .when(op == "trim", _trimmed(items, c["arg"], c["stop"]))
            .when(op.isin("before", "after") & (found > 0), F.concat(F.slice(items, 1, cut), one, F.slice(items, cut + 1, n)))
            .otherwise(items)
        )

    folded = ordered_log(plain, "op", "arg", "stop", "pivot", "value").select("key", F.aggregate("log", F.array().cast("array<string>"), step).alias("items"))
    return folded.select("key", F.posexplode("items").alias("pos", "value")).withColumn("pos", F.col("pos").cast("bigint"))


def set_members(log: DataFrame) -> DataFrame:
    """(key, member) after SADD and SREM: the last command of each member counts (op "add" or "rem")."""
    return log.groupBy("key", "member").agg(F.max_by("op", "seq").alias("op")).filter("op = 'add'").select("key", "member")


def drawn(members: DataFrame, n: int, seed: str = "0") -> DataFrame:
    """``n`` members of each set at random, SRANDMEMBER or what SPOP takes: the least by a hash of seed and member, so a run repeats.

    The row_number filter becomes a group limit before the shuffle."""
    lot = F.md5(F.concat(F.lit(seed), F.lit(":"), F.col("member").cast("string")))
    w = Window.partitionBy("key").orderBy("lot", "member")
    return members.withColumn("lot", lot).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n).drop("lot")


def pages(rows: DataFrame, key: str, order: list[str], size: int) -> DataFrame:
    """A page number for each row of a key, ``size`` rows a page: SSCAN, ZSCAN, HSCAN. Complete: each row once."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("page", F.floor((F.row_number().over(w) - 1) / size))


def by_score(state: DataFrame, low: float | None = None, high: float | None = None, open_low: bool = False, open_high: bool = False, offset: int = 0, count: int | None = None) -> DataFrame:
    """ZRANGEBYSCORE: scores from ``low`` to ``high`` (None: no bound; open ones exclude it), by (score, member), with LIMIT offset count of each key."""
    out, score = state, F.col("score")
    if low is not None:
        out = out.filter(score > low if open_low else score >= low)
    if high is not None:
        out = out.filter(score < high if open_high else score <= high)
    if not offset and count is None:
        return out
    place = F.row_number().over(Window.partitionBy("key").orderBy("score", "member")) - 1
    last = F.lit(True) if count is None else F.col("place") < offset + count
    return out.withColumn("place", place).filter((F.col("place") >= offset) & last).drop("place")


def by_rank(state: DataFrame, start: int, stop: int, reverse: bool = False) -> DataFrame:
    """ZRANGE or ZREVRANGE: positions start..stop by (score, member), both included, negative ones from the end."""
    order = [F.desc("score"), F.desc("member")] if reverse else ["score", "member"]
    return index_range(state.withColumn("pos", F.row_number().over(Window.partitionBy("key").orderBy(*order)) - 1), start, stop)


def expiries(log: DataFrame) -> DataFrame:
    """(key, expires) after SET, EXPIRE, PEXPIRE, EXPIREAT and PERSIST (seq, key, op, at, arg), in milliseconds: the last command decides.

    SET and PERSIST clear the expiry. A command on a key that has expired would find it missing; callers give commands on living keys."""
    arg = F.col("arg").cast("bigint")
    new = F.when(F.col("op") == "expire", F.col("at") + arg * 1000).when(F.col("op") == "pexpire", F.col("at") + arg).when(F.col("op") == "expireat", arg * 1000)
    return log.withColumn("_new", new).groupBy("key").agg(F.max_by(F.struct("_new"), "seq").alias("v")).select("key", F.col("v._new").alias("expires"))


def field_expiry_codes(requests: DataFrame, fields: DataFrame) -> DataFrame:
    """HEXPIRE's code for each request (key, field, at, until) against fields (key, field): -2 without the field, 2 if the time has passed (the field goes), else 1."""
    known = fields.select("key", "field", F.lit(1).alias("_known"))
    code = F.when(F.col("_known").isNull(), -2).when(F.col("until") <= F.col("at"), 2).otherwise(1)
    return requests.join(known, ["key", "field"], "left").withColumn("code", code).drop("_known")


def since_flush(log: DataFrame, flushes: DataFrame, by: list[str]) -> DataFrame:
    """The commands that a flush (seq, and ``by`` for one database) has left: those after the last one. One small row a database is joined."""
    last = flushes.groupBy(*by).agg(F.max("seq").alias("_last")) if by else flushes.agg(F.max("seq").alias("_last")).withColumn("_one", F.lit(1))
    out = log.join(last, by, "left") if by else log.withColumn("_one", F.lit(1)).join(last, "_one", "left").drop("_one")
    return out.filter(F.col("_last").isNull() | (F.col("seq") > F.col("_last"))).drop("_last")


def crc16_table() -> list[int]:
    """CRC-16/XMODEM (polynomial 0x1021) of each byte."""
    out = []
    for b in range(256):
        x = b << 8
        for _ in range(8):
            x = (x << 1) ^ (0x1021 if x & 0x8000 else 0)
        out.append(x & 0xFFFF)
    return out


def hash_slot(key: Column) -> Column:
    """The cluster slot of a key, 0 to 16383: CRC16 of what the first {...} that isn't empty holds, else of the whole key; an empty key has slot 0."""
    tag = F.regexp_extract(key, r"(?s)^[^{]*\{([^}]+)\}", 1)
    table = F.array(*map(F.lit, crc16_table()))
    text = F.when(tag != "", tag).otherwise(F.coalesce(key, F.lit("")))
    code = F.hex(F.encode(text, "UTF-8"))
    bytes_ = F.when(F.length(code) == 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(code) - 1, F.lit(1)), F.lit(2)), lambda i: F.conv(F.substring(code, i, F.lit(2)), 16, 10).cast("int")))

    def step(crc: Column, b: Column) -> Column:
        at = F.shiftright(crc, 8).bitwiseXOR(b).bitwiseAND(F.lit(255))
        return F.shiftleft(crc, 8).bitwiseAND(F.lit(0xFFFF)).bitwiseXOR(F.get(table, at))

    return F.aggregate(bytes_, F.lit(0), step) % 16384


def zset(log: DataFrame) -> DataFrame:
    """(key, member, score) after ZADD; a null score removes the member."""
    return last_write(log, ["key", "member"], "score")


def zset_ranks(state: DataFrame) -> DataFrame:
    """0-based ranks by (score, member) and from the end."""
    up = Window.partitionBy("key").orderBy("score", "member")
    down = Window.partitionBy("key").orderBy(F.desc("score"), F.desc("member"))
    return state.withColumns({"rank": F.row_number().over(up) - 1, "rev_rank": F.row_number().over(down) - 1})


def top(state: DataFrame, n: int, by: str = "score", key: str = "key", tie: str = "member") -> DataFrame:
    """The n highest of each key; the row_number filter becomes a group limit before the shuffle."""
    w = Window.partitionBy(key).orderBy(F.desc(by), F.desc(tie))
    return state.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def newest(log: DataFrame, n: int, key: str, order: list[str]) -> DataFrame:
    """MAXLEN: the last n entries of each stream."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return log.withColumn("age", F.row_number().over(w)).filter(F.col("age") <= n).drop("age")


def ttl(expires_at: Column, now: int) -> Column:
    """Time left: -1 without expiry, -2 once it has passed."""
    return F.when(expires_at.isNull(), -1).when(expires_at <= now, -2).otherwise(expires_at - now).cast("bigint")


def in_all(members: DataFrame, sets: list, key: str = "key", member: str = "member") -> DataFrame:
    """Members of every one of the sets: one aggregate whatever their number."""
    return members.filter(F.col(key).isin(sets)).groupBy(member).agg(F.count_distinct(key).alias("_n")).filter(F.col("_n") == len(sets)).drop("_n")
