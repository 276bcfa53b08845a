"""Queries that decode time-server packets given as literals; the SQL gives the values that their makers published for them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import chrony

# Packets and what they say.
PACKETS = {
    "unauthorized": "06020000003900010002000000000000a3a8c8400000000000000000",
    "sources": "06020000000e00020000000000000000393ab123000000000000000000000012",
    "sourcedata": "06020000000f000300000000000000000c83bf7300000000000000002401db00311020c0face00000048000000020000000a000200040000000000ff000006a9e6c5eef3e6d14fbeeabb923b",
    "sourcestats": "060200000022000600000000000000005995d8fa0000000000000000bf8be5e92401db00311020c0face000000480000000200000000000c0000000500001a27e4948499ed34e009f6c06494df18b476eab9c0a1",
    "tracking": "06020000002100050000000000000000000000020000000000000000e625c66e2401db0031102132face0000008e00000002000000030000000000006138e18136948dd5df192db7df4283f5e2ebca120539e111eb7b3e5df4b07512eae75b0cf0881d4e16821f69",
    "serverstats": "060200000036000e0000000000000000030716ff000000000000000000000000001003cd000000000000000000000000",
    "serverstats2": "06020000003600160000000000000000030716ff000000000000000000000000001003cd000000000000000000000000210000ff0000000000000000",
    "serverstats3": "06020000003600180000000000000000000000010000000000000000000000010000000200000003000000040000000500000006000000070000000800000009ffffffff0000000b",
    "ntpdata": "06020000003900100000000000000000e9b280db00000000000000002401db00231c2812face0000017b0000000200002401db00eef011203520000020080f0600020000007b000404020ae8e4800000e480000023e10b3600000000613a39f0066ae1f8f3507973fca17d6ed4b681b7e6d1b93d0104b6ad43fd4b4b0000112f0000112c0000112cffffffffffffffffffffffffffffffff",
    "activity": "06020000002c000c0000000000000000a7a8738300000000000000000000000400000000000000000000000000000000",
}
EXPECTED = {
    "sources": {"command": 14, "reply": 2, "sequence": 960147747, "n_sources": 18},
    "sourcedata": {"command": 15, "reply": 3, "sequence": 209960819, "ip": "2401:db00:3110:20c0:face:0:48:0", "poll": 10, "stratum": 2, "state": 4, "mode": 0, "flags": 0, "reachability": 255, "since_sample": 1705, "orig_latest_meas": 4.719099888461642e-05, "latest_meas": 4.990374873159453e-05, "latest_meas_err": 0.00017888184811454266},
    "sourcestats": {"command": 34, "reply": 6, "sequence": 1502992634, "ref_id": 3213616617, "ip": "2401:db00:3110:20c0:face:0:48:0", "n_samples": 12, "n_runs": 5, "span_seconds": 6695, "standard_deviation": 1.770472044881899e-05, "resid_freq_ppm": -0.00038742992910556495, "skew_ppm": 0.0117427296936512, "estimated_offset": -3.44656518791453e-06, "estimated_offset_err": 0.0001771473471308127},
    "tracking": {"command": 33, "reply": 5, "sequence": 2, "ref_id": 3861235310, "ip": "2401:db00:3110:2132:face:0:8e:0", "stratum": 3, "leap_status": 0, "ref_time_sec": 1631117697, "ref_time_nsec": 915705301, "current_correction": -3.4395072816550964e-06, "last_offset": -2.823539716700907e-06, "rms_offset": 1.405413968313951e-05, "freq_ppm": -1.5478190183639526, "resid_freq_ppm": -0.00012660636275541037, "skew_ppm": 0.005385049618780613, "root_delay": 0.00022063794312998652, "root_dispersion": 0.0010384710039943457, "last_update_interval": 520.4907836914062},
    "serverstats": {"command": 54, "reply": 14, "sequence": 50796287, "ntp_hits": 0, "cmd_hits": 1049549, "ntp_drops": 0, "cmd_drops": 0, "log_drops": 0},
    "serverstats2": {"command": 54, "reply": 22, "sequence": 50796287, "ntp_hits": 0, "nke_hits": 1049549, "cmd_hits": 0, "ntp_drops": 0, "nke_drops": 0, "cmd_drops": 553648383, "log_drops": 0, "ntp_auth_hits": 0},
    "serverstats3": {"command": 54, "reply": 24, "sequence": 1, "ntp_hits": 1, "nke_hits": 2, "cmd_hits": 3, "ntp_drops": 4, "nke_drops": 5, "cmd_drops": 6, "log_drops": 7, "ntp_auth_hits": 8, "ntp_interleaved_hits": 9, "ntp_timestamps": 4294967295, "ntp_span_seconds": 11},
    "ntpdata": {"command": 57, "reply": 16, "sequence": 3920789723, "remote_ip": "2401:db00:231c:2812:face:0:17b:0", "local_ip": "2401:db00:eef0:1120:3520:0:2008:f06", "remote_port": 123, "leap": 0, "version": 4, "mode": 4, "stratum": 2, "poll": 10, "precision": -24, "root_delay": 1.52587890625e-05, "root_dispersion": 1.52587890625e-05, "ref_id": 601951030, "ref_time_sec": 1631205872, "ref_time_nsec": 107667960, "offset": -0.0026783079374581575, "peer_delay": 0.07885251939296722, "peer_dispersion": 8.49863042162724e-08, "response_time": 5.000199962523766e-05, "jitter_asymmetry": -0.49079379439353943, "flags": 17405, "tx_tss_char": 75, "rx_tss_char": 75, "total_tx_count": 4399, "total_rx_count": 4396, "total_valid_count": 4396},
    "activity": {"command": 44, "reply": 12, "sequence": 2812834691, "online": 4, "offline": 0, "burst_online": 0, "burst_offline": 0, "unresolved": 0},
}


def packets(spark):
    return spark.createDataFrame([(n, x) for n, x in PACKETS.items()], "name string, digits string").select("name", F.unhex("digits").alias("raw"))


def _decoded(reply):
    return lambda spark, d: chrony.decode(packets(spark), reply)


def chrony_dead_letters(spark, d):
    return chrony.dead_letters(packets(spark)).select("name", "problem")


def chrony_float(spark, d):
    rows = spark.createDataFrame([(0,), (17091950,), (-90077357,)], "bits bigint")
    return rows.select("bits", F.round(chrony.chrony_float(F.col("bits")), 6).alias("value"))


def chrony_flags(spark, d):
    rows = spark.createDataFrame([(255,), (65535,)], "flags int")
    return rows.select("flags", F.array_join(chrony.failed_tests(F.col("flags")), ",").alias("failed"))


def refid_text(spark, d):
    rows = spark.createDataFrame([(0,), (1196446464,), (2139029761,)], "ref_id bigint")
    return rows.select("ref_id", chrony.ref_id_hex(F.col("ref_id")).alias("as_hex"), chrony.ref_id_text(F.col("ref_id")).alias("as_text"))


def enum_names(spark, d):
    rows = spark.createDataFrame([(1,), (2,), (10,)], "code int")
    c = F.col("code")
    return rows.select("code", chrony.state_name(c).alias("state"), chrony.mode_name(c).alias("mode"), chrony.status_name(c).alias("status"), chrony.packet_type_name(c).alias("packet_type"))


QUERIES = {f"chrony_decode_{r}": _decoded(r) for r in EXPECTED} | {f.__name__: f for f in (chrony_dead_letters, chrony_float, chrony_flags, refid_text, enum_names)}


#: Types of numbers are those of the decoder; DuckDB needs them told for literals.
def _literal(name: str, v) -> str:
    if isinstance(v, str):
        return f"'{v}' as {name}"
    return f"cast({v!r} as {'double' if isinstance(v, float) else 'bigint'}) as {name}"


def _rows(columns: str, *values: str) -> str:
    return f"select * from (values {', '.join(values)}) t({columns})"


ORACLE_SQL = {f"chrony_decode_{r}": "select " + ", ".join(_literal(k, v) for k, v in e.items()) for r, e in EXPECTED.items()} | {
    "chrony_dead_letters": "select 'unauthorized' as name, 'status UNAUTH (2)' as problem",
    "chrony_float": _rows("bits, value", "(0, 0.0::double)", "(17091950, -0.490620::double)", "(-90077357, 0.039436::double)"),
    "chrony_flags": _rows("flags, failed", "(255, 'tst_delay_dev_ration,tst_sync_loop')", "(65535, '')"),
    "refid_text": _rows("ref_id, as_hex, as_text", "(0, '00000000', '')", "(1196446464, '47505300', 'GPS')", "(2139029761, '7F7F0101', '')"),
    "enum_names": _rows("code, state, mode, status, packet_type", "(1, 'unreach', 'peer', 'FAILED', 'request')", "(2, 'falseticker', 'reference clock', 'UNAUTH', 'reply')", "(10, 'unknown (10)', 'unknown (10)', 'NOHOSTACCESS', 'unknown (10)')"),
}
