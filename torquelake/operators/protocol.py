"""Diagnostic transport and services as column expressions over hex strings and BINARY."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from torquelake.functions import dims

FRAME, PAD, MAX_LENGTH = 8, "AA", 4095
POSITIVE, NEGATIVE = 0x40, 0x7F
NOT_SUPPORTED, BAD_SUBFUNCTION, OUT_OF_RANGE = 0x11, 0x12, 0x31


def code_to_hex(code: Column) -> Column:
    """Three bytes of a trouble code as hex; NULL for an invalid code or a first digit over 3."""
    c = F.upper(code)
    system = F.instr(F.lit("PCBU"), F.substring(c, 1, 1)) - 1
    first = F.conv(F.substring(c, 2, 1), 16, 10).cast("int")
    ok = c.rlike("^[PCBU][0-3][0-9A-F]{3}$")
    return F.when(ok, F.concat(F.hex(system.cast("long") * 4 + first), F.substring(c, 3, 3), F.lit("00")))


def hex_to_code(h: Column) -> Column:
    top = F.conv(F.substring(h, 1, 1), 16, 10).cast("int")
    return F.concat(F.substring(F.lit("PCBU"), F.floor(top / 4).cast("int") + 1, F.lit(1)), (top % 4).cast("string"), F.upper(F.substring(h, 2, 3)))


def status_bits(status: Column) -> Column:
    """Names of the set bits, ascending."""
    each = F.array(*[F.when(status.bitwiseAND(bit) != 0, name) for bit, name in dims.STATUS_BITS.items()])
    return F.array_compact(each)


def frame_count(length: Column) -> Column:
    """Frames of a payload of ``length`` bytes; NULL over 4095 bytes."""
    return F.when(length <= 7, 1).when(length <= MAX_LENGTH, 1 + F.ceil((length - 6) / 7)).cast("long")


def encode_frames(h: Column) -> Column:
    """Transport frames (hex of 8 bytes) of a payload given as hex; NULL over 4095 bytes."""
    n = F.floor(F.length(h) / 2).cast("int")
    pad = lambda x: F.rpad(x, 2 * FRAME, "A")
    single = F.array(pad(F.concat(F.lpad(F.hex(n), 2, "0"), h)))
    first = F.array(F.concat(F.hex(n.cast("long") + 0x1000), F.substring(h, 1, 12)))
    rest = F.transform(F.sequence(F.lit(1), F.ceil((n - 6) / 7).cast("int")), lambda i: pad(F.concat(F.lit("2"), F.hex((i % 16).cast("long")), F.substr(h, 13 + (i - 1) * 14, F.lit(14)))))
    return F.when(n <= 7, single).when(n <= MAX_LENGTH, F.concat(first, rest))


def flow_control(status: int = 0, block: int = 0, gap: int = 0) -> str:
    return f"{0x30 | status:02X}{block:02X}{gap:02X}".ljust(2 * FRAME, "A")


def reassemble(frames: DataFrame, key: str, order: str, frame: str = "frame") -> DataFrame:
    """Messages of each ``key``: payload hex, or the error: no first frame, bad sequence, unknown type, too short.

    A message starts at a single or first frame; the window is per conversation, as the protocol's
    state is; flow-control frames are ignored. The first fault of a message is its error. Frames after a
    whole message belong to none: one more row with its number says so.
    """
    kind = F.substring(frame, 1, 1)
    w = Window.partitionBy(key).orderBy(order)
    f = frames.where(kind != "3").withColumn("_k", kind).withColumn("_msg", F.sum(F.when(F.col("_k").isin("0", "1"), 1).otherwise(0)).over(w))
    inner = Window.partitionBy(key, "_msg").orderBy(order)
    f = f.withColumn("_n", F.row_number().over(inner) - 1)
    seq = F.conv(F.substring(frame, 2, 1), 16, 10).cast("int")
    bad = F.when(~F.col("_k").isin("0", "1", "2"), "unknown frame type").when((F.col("_k") == "2") & (F.col("_msg") == 0), "no first frame").when((F.col("_k") == "2") & (seq != F.col("_n") % 16), "bad sequence")
    size = F.when(F.col("_k") == "0", F.conv(F.substring(frame, 2, 1), 16, 10)).when(F.col("_k") == "1", F.conv(F.substring(frame, 2, 3), 16, 10)).cast("int")
    body = F.when(F.col("_k") == "0", F.substring(frame, 3, 14)).when(F.col("_k") == "1", F.substring(frame, 5, 12)).otherwise(F.substring(frame, 3, 14))
    f = f.select(key, order, "_msg", "_n", bad.alias("_bad"), size.alias("_size"), body.alias("_body"))
    f = f.withColumn("_full", F.sum(F.length("_body")).over(inner) >= 2 * F.first("_size").over(inner))
    g = f.groupBy(key, "_msg").agg(
        F.max("_size").alias("size"), F.max("_n").alias("last"), F.min(F.when(F.col("_full"), F.col("_n"))).alias("full"), F.min(F.when(F.col("_bad").isNotNull(), F.struct("_n", "_bad"))).alias("bad"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_body"))), lambda x: x["_body"]), "").alias("_all"),
    )
    whole = F.col("full").isNotNull() & F.coalesce(F.col("bad._n") > F.col("full"), F.lit(True))
    none = F.lit(None).cast("string")
    main = F.struct(F.when(whole, F.substr("_all", F.lit(1), 2 * F.col("size"))).alias("payload"), F.when(~whole, F.coalesce("bad._bad", F.lit("incomplete"))).alias("error"))
    stray = F.struct(none.alias("payload"), F.lit("no first frame").alias("error"))
    found = F.when(whole & (F.col("last") > F.col("full")), F.array(main, stray)).otherwise(F.array(main))
    return g.select(key, F.col("_msg").alias("message"), F.inline(found))


def negative(sid: Column, nrc: int) -> Column:
    return F.concat(F.lit("7F"), F.lpad(F.hex(sid.cast("long")), 2, "0"), F.lit(f"{nrc:02X}"))


def demo_ecu(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Data identifiers and stored faults of the demonstration unit."""
    # Fixed values.
    dids = spark.createDataFrame([("F190", b"WAUZZZ8V1JA123456".hex().upper()), ("F18C", b"ECU-GM-2019-0472".hex().upper()), ("F195", "0104")], "did string, value string")
    faults = [
        (0, "P0301", 0x09, [("F40C", 617), ("F405", 92), ("F40D", 0)], 4),
        (1, "P0401", 0x08, [("F40C", 1850), ("F405", 88), ("F40D", 45)], 2),
        (2, "P2002", 0x0C, [("F40C", 2400), ("F405", 95), ("F40D", 70)], 1),
    ]
    return dids, spark.createDataFrame(faults, "pos int, code string, status int, freeze_frame array<struct<did:string,value:int>>, occurrences int")


def respond(requests: DataFrame, dids: DataFrame, faults: DataFrame, payload: str = "payload") -> DataFrame:
    """``requests`` (hex payloads) with their response, from snapshots of one unit's identifiers and faults.

    Both tables describe one unit, so each becomes one row that is broadcast.
    """
    h = F.upper(F.col(payload))
    sid = F.conv(F.substring(h, 1, 2), 16, 10).cast("int")
    sub, n = F.substring(h, 3, 2), F.floor(F.length(h) / 2)
    short = lambda v: F.upper(F.lpad(F.hex(v.cast("long").bitwiseAND(0xFFFF)), 4, "0"))
    frozen = F.array_join(F.transform("freeze_frame", lambda x: F.concat(x["did"], short(x["value"]))), "")
    status = F.lpad(F.hex(F.col("status").cast("long")), 2, "0")
    table = faults.agg(
        F.count("*").alias("_n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.concat(code_to_hex(F.col("code")), status).alias("r")))), lambda x: x["r"]), "").alias("_all"),
        F.map_from_entries(F.collect_list(F.struct("code", F.concat(status, F.lit("01"), frozen).alias("r")))).alias("_frozen"),
    )
    values = dids.agg(F.map_from_entries(F.collect_list(F.struct("did", "value"))).alias("_dids"))
    r = requests.join(F.broadcast(table)).join(F.broadcast(values))
    value, frozen_of = F.try_element_at("_dids", F.substring(h, 3, 4)), F.try_element_at("_frozen", hex_to_code(F.substring(h, 5, 6)))
    session = F.when(n < 2, negative(sid, BAD_SUBFUNCTION)).otherwise(F.concat(F.lit("50"), sub, F.lit("003201F4")))
    read_did = F.when((n < 3) | value.isNull(), negative(sid, OUT_OF_RANGE)).otherwise(F.concat(F.lit("62"), F.substring(h, 3, 4), value))
    read_dtc = (
        F.when(n < 2, negative(sid, BAD_SUBFUNCTION)).when(sub == "01", F.concat(F.lit("5901FF01"), F.lpad(F.hex("_n"), 4, "0"))).when(sub == "02", F.concat(F.lit("5902FF"), F.col("_all")))
        .when(sub == "04", F.when((n < 5) | frozen_of.isNull(), negative(sid, OUT_OF_RANGE)).otherwise(F.concat(F.lit("5904"), F.substring(h, 5, 6), frozen_of)))
        .otherwise(negative(sid, BAD_SUBFUNCTION))
    )
    out = F.when(n == 0, negative(F.lit(0), OUT_OF_RANGE)).when(sid == 0x10, session).when(sid == 0x22, read_did).when(sid == 0x19, read_dtc).when(sid == 0x14, F.concat(F.lit("54"), F.lpad(F.hex("_n"), 2, "0"))).otherwise(negative(sid, NOT_SUPPORTED))
    return r.withColumn("response", out).drop("_n", "_all", "_frozen", "_dids")


def parse_codes(h: Column) -> Column:
    """Array of (code, status) of a read-by-mask response; a short tail is ignored."""
    n = F.floor((F.length(h) - 6) / 8).cast("int")
    at = lambda i: F.substr(h, 7 + (i - 1) * 8, F.lit(8))
    return F.when(n < 1, F.array().cast("array<struct<code:string,status:int>>")).otherwise(
        F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(hex_to_code(at(i)).alias("code"), F.conv(F.substring(at(i), 7, 2), 16, 10).cast("int").alias("status")))
    )


def parse_freeze_frame(h: Column) -> Column:
    """Array of (name, value, unit) of a freeze-frame response: pairs of identifier and signed value after seven bytes."""
    n = F.floor((F.length(h) - 14) / 8).cast("int")
    names = {f"{k:04X}": v[0] for k, v in dims.FREEZE_DIDS.items()}
    units = {f"{k:04X}": v[1] for k, v in dims.FREEZE_DIDS.items()}

    def one(i: Column) -> Column:
        did = F.upper(F.substr(h, 15 + (i - 1) * 8, F.lit(4)))
        raw = F.conv(F.substr(h, 19 + (i - 1) * 8, F.lit(4)), 16, 10).cast("int")
        return F.struct(F.coalesce(dims.lookup(names, did), F.concat(F.lit("DID_"), did)).alias("name"), F.when(raw > 32767, raw - 65536).otherwise(raw).alias("value"), dims.lookup(units, did, "").alias("unit"))

    return F.when(n < 1, F.array().cast("array<struct<name:string,value:int,unit:string>>")).otherwise(F.transform(F.sequence(F.lit(1), n), one))


def full_scan(spark: SparkSession) -> DataFrame:
    """Session, identification, codes, interpretation and freeze frames of the demonstration unit, through the service layer."""
    from torquelake.operators.codes import interpret

    dids, faults = demo_ecu(spark)
    requests = spark.createDataFrame([("1003",), ("22F190",), ("1902FF",)], "payload string")
    answers = respond(requests, dids, faults)
    codes = answers.where("payload = '1902FF'").select(F.posexplode(parse_codes(F.col("response"))).alias("pos", "c")).select("pos", "c.code", "c.status")
    asked = codes.withColumn("payload", F.concat(F.lit("1904"), code_to_hex(F.col("code"))))
    frozen = respond(asked, dids, faults).withColumn("freeze_frame", parse_freeze_frame(F.col("response")))
    vin = answers.where("payload = '22F190'").select(F.decode(F.unhex(F.substring("response", 7, 200)), "US-ASCII").alias("vin"))
    return interpret(frozen.withColumn("status_bits", status_bits(F.col("status")))).join(F.broadcast(vin)).drop("payload", "response")
