"""Queries on trouble codes, vehicle numbers and the diagnostic protocol."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from torquelake.functions import dims
from torquelake.operators import codes, protocol, vin
from torquelake.plans.proxy import table

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


_KNOWN = list(dims.KNOWN_CODES)
_CODES_SQL = f"""codes AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 17 = 0 THEN 'XY' || p_partkey WHEN p_partkey % 3 = 0 THEN [{', '.join(repr(c) for c in _KNOWN)}][p_partkey % {len(_KNOWN)} + 1]
  ELSE substr('PCBU', CAST(p_partkey % 4 AS INTEGER) + 1, 1) || (p_partkey // 4) % 4 || lower(printf('%03X', (p_partkey * 37) % 4096)) END AS code FROM part)"""


def _codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    built = F.concat(F.substring(F.lit("PCBU"), (k % 4).cast("int") + 1, F.lit(1)), (F.floor(k / 4) % 4).cast("string"), F.lower(F.lpad(F.hex((k * 37) % 4096), 3, "0")))
    known = F.get(F.array(*map(F.lit, _KNOWN)), (k % len(_KNOWN)).cast("int"))
    return table(spark, sf_dir, "part").select(k.alias("k"), F.when(k % 17 == 0, F.concat(F.lit("XY"), k)).when(k % 3 == 0, known).otherwise(built).alias("code"))


_VALID = "upper(code) SIMILAR TO '[PCBU][0-9A-F]{4}'"
_pairs = lambda d: [(k, *v) for k, v in d.items()]
_INTERP = f"""{_CODES_SQL}, {dims.sql_values('sys', 'c, en, fr', _pairs(dims.SYSTEMS))}, {dims.sql_values('typ', 'c, en, fr', _pairs(dims.CODE_TYPES))}, {dims.sql_values('sub', 'c, en, fr', _pairs(dims.SUBSYSTEMS))},
  {dims.sql_values('known', 'code, en, fr, causes, sev', [(k, a, b, '; '.join(c), s) for k, (a, b, c, s) in dims.KNOWN_CODES.items()])},
  {dims.sql_values('sevs', 'key, en, fr', _pairs(dims.SEVERITIES))}, {dims.sql_values('ord', 'key, o, w', [(k, v, dims.SEVERITY_WEIGHT[k]) for k, v in dims.SEVERITY_ORDER.items()])},
  i AS (SELECT c.k, c.code, upper(c.code) SIMILAR TO '[PCBU][0-9A-F]{{4}}' AS valid, sys.en AS system_en, coalesce(typ.en, 'Unknown') AS type_en, CASE WHEN upper(c.code)[1] = 'P' THEN sub.en END AS subsystem_en, sys.fr AS system_fr,
      CASE WHEN upper(c.code)[1] = 'P' THEN sub.fr END AS subsystem_fr, known.en AS known_en, known.fr AS known_fr, known.causes, coalesce(known.sev, 'unknown') AS severity_key
    FROM codes c LEFT JOIN sys ON upper(c.code)[1] = sys.c LEFT JOIN typ ON c.code[2] = typ.c LEFT JOIN sub ON upper(c.code)[3] = sub.c LEFT JOIN known ON upper(c.code) = known.code),
  full_ AS (SELECT k, code, valid, valid AND known_en IS NOT NULL AS in_database, coalesce(known_en, coalesce(subsystem_en, system_en) || ' fault') AS description_en,
      coalesce(known_fr, 'Defaut ' || coalesce(subsystem_fr, system_fr)) AS description_fr, coalesce(causes, 'Non repertorie - consulter la documentation technique') AS causes, severity_key,
      system_en, type_en, subsystem_en FROM i)"""


@query("dtc_validate", f"WITH {_CODES_SQL} SELECT k, code, {_VALID} AS valid FROM codes")
def dtc_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _codes(spark, sf_dir).withColumn("valid", codes.is_valid(F.col("code")))


@query("dtc_structure", f"WITH {_INTERP} SELECT k, system_en, type_en, subsystem_en FROM full_ WHERE valid")
def dtc_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.structure(_codes(spark, sf_dir).where(codes.is_valid(F.col("code")))).select("k", "system_en", "type_en", "subsystem_en")


@query("dtc_interpret", f"WITH {_INTERP} SELECT k, in_database, description_en, description_fr, causes, severity_key FROM full_ WHERE valid")
def dtc_interpret(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = codes.interpret(_codes(spark, sf_dir)).where("valid")
    return i.select("k", "in_database", "description_en", "description_fr", F.array_join("likely_causes_fr", "; ").alias("causes"), "severity_key")


@query("dtc_scan", f"""WITH {_INTERP} SELECT count(*) AS total, count(*) FILTER (valid) AS valid, count(*) FILTER (NOT valid) AS invalid, count(*) FILTER (valid AND in_database) AS in_database,
  min_by(severity_key, o) FILTER (valid) AS highest_severity FROM full_ JOIN ord ON severity_key = ord.key""")
def dtc_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.scan_summary(codes.interpret(_codes(spark, sf_dir)))


@query("dtc_rejected", f"WITH {_INTERP} SELECT code, count(*) AS times, min(k) AS first_at FROM full_ WHERE NOT coalesce(valid, false) GROUP BY code")
def dtc_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.rejected(codes.interpret(_codes(spark, sf_dir)), "k")


_VERDICT = """CASE WHEN c > 0 THEN 'Immediate action required' WHEN score < 70 THEN 'Repairs recommended' ELSE 'Minor faults to monitor' END AS verdict_en, c > 0 OR score < 70 AS action_required"""


@query("health_score", f"""WITH {_INTERP}, s AS (SELECT k // 4 AS vehicle, count(*) AS n_faults, CAST(greatest(0, 100 - 12 * sum(w)) AS BIGINT) AS score, count(*) FILTER (severity_key = 'high') AS c,
  count(*) FILTER (severity_key = 'medium') AS m FROM full_ JOIN ord ON severity_key = ord.key WHERE valid GROUP BY 1)
  SELECT vehicle, n_faults, score, c AS critical_count, m AS medium_count, {_VERDICT} FROM s""")
def health_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = codes.interpret(_codes(spark, sf_dir)).where("valid").withColumn("vehicle", F.floor(F.col("k") / 4))
    return codes.health_score(i, ["vehicle"])


_EFFORT = "CASE " + " ".join(f"WHEN t LIKE '%{w}%' THEN '{e[0]}'" for w, e in dims.EFFORT.items()) + " ELSE 'a evaluer' END AS effort, CASE " + " ".join(f"WHEN t LIKE '%{w}%' THEN {e[1]}::DOUBLE" for w, e in dims.EFFORT.items()) + " END AS hours_min"


@query("effort_lookup", f"WITH {_INTERP} SELECT k, {_EFFORT} FROM (SELECT k, lower(description_fr || ' ' || replace(causes, '; ', ' ')) AS t FROM full_ WHERE valid)")
def effort_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = codes.interpret(_codes(spark, sf_dir)).where("valid").withColumn("e", codes.effort(F.col("description_fr"), F.col("likely_causes_fr")))
    return i.select("k", "e.effort", "e.hours_min")


@query("repair_plan", f"""WITH {_INTERP} SELECT k // 4 AS vehicle, CAST(row_number() OVER (PARTITION BY k // 4 ORDER BY o, k) AS INTEGER) AS priority, code, description_fr AS action_fr,
  array_to_string(string_split(causes, '; ')[1:3], '; ') AS first_checks FROM full_ JOIN ord ON severity_key = ord.key WHERE valid""")
def repair_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = codes.interpret(_codes(spark, sf_dir)).where("valid").withColumn("vehicle", F.floor(F.col("k") / 4))
    p = codes.repair_plan(i, "k", ["vehicle"])
    return p.select("vehicle", "priority", "code", "action_fr", F.array_join("first_checks_fr", "; ").alias("first_checks"))


_PREFIXES = [*dims.WMI, "ZZZ", "1GX", "JTD"]
_VINS_SQL = f"""vins AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 13 = 0 THEN 'IOQ' || c_custkey ELSE
  rpad([{', '.join(repr(p) for p in _PREFIXES)}][c_custkey % {len(_PREFIXES)} + 1], 9, '8') || substr('ABCDEFGHJKLMNPRSTVWXY', CAST(c_custkey % 21 AS INTEGER) + 1, 1) || lpad(c_custkey::VARCHAR, 7, '0') END AS vin FROM customer)"""


def _vins(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    prefix = F.rpad(F.get(F.array(*map(F.lit, _PREFIXES)), (k % len(_PREFIXES)).cast("int")), 9, "8")
    good = F.concat(prefix, F.substring(F.lit("ABCDEFGHJKLMNPRSTVWXY"), (k % 21).cast("int") + 1, F.lit(1)), F.lpad(k.cast("string"), 7, "0"))
    return table(spark, sf_dir, "customer").select(k.alias("k"), F.when(k % 13 == 0, F.concat(F.lit("IOQ"), k)).otherwise(good).alias("vin"))


_VIN_OK = "upper(trim(vin)) SIMILAR TO '[A-HJ-NPR-Z0-9]{17}'"
_WMI_SQL = dims.sql_values("wmi", "w, m, c", _pairs(dims.WMI))


@query("vin_validate", f"WITH {_VINS_SQL} SELECT k, {_VIN_OK} AS valid FROM vins")
def vin_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vins(spark, sf_dir).select("k", vin.is_valid(F.col("vin")).alias("valid"))


@query("wmi_prefix", f"""WITH {_VINS_SQL}, {_WMI_SQL} SELECT k, coalesce(a.m, b.m, 'Unknown') AS manufacturer, coalesce(a.c, b.c, 'Unknown') AS country
  FROM vins LEFT JOIN wmi a ON vin[1:3] = a.w LEFT JOIN wmi b ON vin[1:2] = b.w""")
def wmi_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vin.with_manufacturer(_vins(spark, sf_dir)).select("k", "manufacturer", "country")


@query("vin_decode", f"""WITH {_VINS_SQL}, {_WMI_SQL}, {dims.sql_values('yr', 'c, y', list(dims.YEARS.items()))} SELECT k, {_VIN_OK} AS valid,
  CASE WHEN {_VIN_OK} THEN coalesce(a.m, b.m, 'Unknown') END AS manufacturer, CASE WHEN {_VIN_OK} THEN y END AS "year"
  FROM vins LEFT JOIN wmi a ON vin[1:3] = a.w LEFT JOIN wmi b ON vin[1:2] = b.w LEFT JOIN yr ON vin[10] = yr.c""")
def vin_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vin.decode(_vins(spark, sf_dir)).select("k", "valid", "manufacturer", "year")


@query("dtc_roundtrip_bytes", f"""WITH {_CODES_SQL} SELECT k, code, printf('%04X', (instr('PCBU', upper(code)[1]) - 1) * 16384 + ('0x' || upper(code)[2:5])::INTEGER) || '00' AS bytes, upper(code) AS back FROM codes WHERE {_VALID}""")
def dtc_roundtrip_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _codes(spark, sf_dir).where(codes.is_valid(F.col("code"))).withColumn("bytes", protocol.code_to_hex(F.col("code")))
    return c.withColumn("back", protocol.hex_to_code(F.col("bytes")))


@query("status_bits", f"""SELECT p_partkey AS k, concat_ws(',', {', '.join(f"CASE WHEN (p_partkey % 256) & {b} <> 0 THEN '{n}' END" for b, n in dims.STATUS_BITS.items())}) AS bits FROM part""")
def status_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.array_join(protocol.status_bits((F.col("p_partkey") % 256).cast("int")), ",").alias("bits"))


_PAYLOADS_SQL = """payloads AS (SELECT conv_id * 1000 + turn AS msg, hex(encode("text")) AS h FROM conversations)"""


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("msg"), F.hex(F.encode("text", "UTF-8")).alias("h"))


@query("isotp_encode", f"""WITH {_PAYLOADS_SQL}, l AS (SELECT msg, h, length(h) // 2 AS n FROM payloads),
  f AS (SELECT msg, h, n, unnest(CASE WHEN n <= 7 THEN [0] WHEN n <= 4095 THEN range(1 + CAST(ceil((n - 6) / 7.0) AS BIGINT)) ELSE [NULL] END) AS idx FROM l)
  SELECT msg, CAST(idx AS INTEGER) AS idx, CASE WHEN idx IS NULL THEN NULL WHEN n <= 7 THEN rpad(printf('%02X', n) || h, 16, 'A') WHEN idx = 0 THEN printf('%04X', 4096 + n) || h[1:12]
    ELSE rpad('2' || printf('%X', idx % 16) || substr(h, 13 + (idx - 1) * 14, 14), 16, 'A') END AS frame FROM f""")
def isotp_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _payloads(spark, sf_dir).select("msg", F.posexplode_outer(protocol.encode_frames(F.col("h"))).alias("idx", "frame"))


@query("isotp_frame_count", f"WITH {_PAYLOADS_SQL} SELECT msg, CASE WHEN length(h) // 2 <= 7 THEN 1 WHEN length(h) // 2 <= 4095 THEN 1 + CAST(ceil((length(h) // 2 - 6) / 7.0) AS BIGINT) END AS n_frames FROM payloads")
def isotp_frame_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _payloads(spark, sf_dir).select("msg", protocol.frame_count(F.length("h") / 2).alias("n_frames"))


@query("isotp_reassemble", f"WITH {_PAYLOADS_SQL} SELECT msg, CASE WHEN length(h) // 2 <= 4095 THEN h END AS payload FROM payloads")
def isotp_reassemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = isotp_encode(spark, sf_dir)
    return protocol.reassemble(f, "msg", "idx").select("msg", "payload").unionByName(f.where("frame IS NULL").select("msg", F.lit(None).cast("string").alias("payload")))


_REQUESTS = ["1003", "10", "22F190", "22F1", "22AAAA", "1901FF", "1902FF", "1904030100", "1904999900", "1977", "14FFFFFF", "3E00", ""]
_ANSWERS = [
    "5003003201F4", "7F1012", "62F190" + b"WAUZZZ8V1JA123456".hex().upper(), "7F2231", "7F2231", "5901FF010003", "5902FF030100090401000820" + "02000C", "5904030100" + "0901" + "F40C0269F405005CF40D0000",
    "7F1931", "7F1912", "5403", "7F3E11", "7F0031",
]


@query("uds_dispatch", f"WITH {dims.sql_values('r', 'i, payload, response', [(i, q, a) for i, (q, a) in enumerate(zip(_REQUESTS, _ANSWERS, strict=True))])} SELECT o_orderkey AS k, payload, response FROM orders JOIN r ON o_orderkey % {len(_REQUESTS)} = i")
def uds_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    r = table(spark, sf_dir, "orders").select(k.alias("k"), F.get(F.array(*map(F.lit, _REQUESTS)), (k % len(_REQUESTS)).cast("int")).alias("payload"))
    return protocol.respond(r, *protocol.demo_ecu(spark)).select("k", "payload", "response")


@query("read_codes_parse", """SELECT o_orderkey AS k, substr('PCBU', CAST(o_orderkey % 65536 // 16384 AS INTEGER) + 1, 1) || (o_orderkey % 16384 // 4096) || printf('%03X', o_orderkey % 4096) AS code, CAST(o_orderkey % 256 AS INTEGER) AS status FROM orders""")
def read_codes_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    body = F.concat(F.lit("5902FF"), F.lpad(F.hex(k % 65536), 4, "0"), F.lit("00"), F.lpad(F.hex(k % 256), 2, "0"), F.lit("AB"))
    return table(spark, sf_dir, "orders").select(k.alias("k"), F.explode(protocol.parse_codes(body)).alias("c")).select("k", "c.code", "c.status")


@query("freeze_frame_parse", """SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN 'engine_rpm' WHEN 1 THEN 'coolant_temp' ELSE 'DID_0ABC' END AS name,
  CAST(CASE WHEN o_orderkey * 7 % 65536 > 32767 THEN o_orderkey * 7 % 65536 - 65536 ELSE o_orderkey * 7 % 65536 END AS INTEGER) AS "value", CASE o_orderkey % 3 WHEN 0 THEN 'rpm' WHEN 1 THEN 'degC' ELSE '' END AS unit FROM orders""")
def freeze_frame_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    did = F.get(F.array(F.lit("F40C"), F.lit("F405"), F.lit("0ABC")), (k % 3).cast("int"))
    body = F.concat(F.lit("59040301000901"), did, F.lpad(F.hex(k * 7 % 65536), 4, "0"))
    return table(spark, sf_dir, "orders").select(k.alias("k"), F.explode(protocol.parse_freeze_frame(body)).alias("z")).select("k", "z.name", "z.value", "z.unit")


_SCAN = [("P0301", 9, "high", "testFailed,confirmedDTC", "engine_rpm=617 coolant_temp=92 vehicle_speed=0"), ("P0401", 8, "medium", "confirmedDTC", "engine_rpm=1850 coolant_temp=88 vehicle_speed=45"), ("P2002", 12, "medium", "pendingDTC,confirmedDTC", "engine_rpm=2400 coolant_temp=95 vehicle_speed=70")]


@query("uds_full_scan", f"WITH {dims.sql_values('s', 'code, status, severity_key, bits, frozen', _SCAN)} SELECT *, 'WAUZZZ8V1JA123456' AS vin FROM s")
def uds_full_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = protocol.full_scan(spark)
    frozen = F.array_join(F.transform("freeze_frame", lambda x: F.concat_ws("=", x["name"], x["value"].cast("string"))), " ")
    return s.select("code", "status", "severity_key", F.array_join("status_bits", ",").alias("bits"), frozen.alias("frozen"), "vin")
