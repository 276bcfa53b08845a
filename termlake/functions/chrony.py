"""Time-server monitoring packets: replies decoded from BINARY by slices of their hexadecimal digits, and requests made."""

from __future__ import annotations

import ipaddress
import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the protocol.
VERSION, HEAD_BYTES, REQUEST_DATA = 6, 28, 396
PACKET_TYPES = {1: "request", 2: "reply"}
COMMANDS = {"sources": 14, "sourcedata": 15, "tracking": 33, "sourcestats": 34, "activity": 44, "serverstats": 54, "ntpdata": 57}
STATUS = ["SUCCESS", "FAILED", "UNAUTH", "INVALID", "NOSUCHSOURCE", "INVALIDTS", "NOTENABLED", "BADSUBNET", "ACCESSALLOWED", "ACCESSDENIED", "NOHOSTACCESS", "SOURCEALREADYKNOWN", "TOOMANYSOURCES", "NORTC", "BADRTCFILE", "INACTIVE", "BADSAMPLE", "INVALIDAF", "BADPKTVERSION", "BADPKTLENGTH"]
STATES = ["sync", "unreach", "falseticker", "jittery", "candidate", "outlier"]
MODES = ["client", "peer", "reference clock"]
SOURCE_FLAGS = {"noselect": 1, "prefer": 2, "trust": 4, "require": 8}
NTP_TESTS, NTP_INTERLEAVED, NTP_AUTHENTICATED = 0x3FF, 0x4000, 0x8000
TEST_NAMES = ["pkt_dup", "pkt_bogus", "pkt_invalid", "pkt_auth", "pkt_stratum", "pkt_header", "tst_max_delay", "tst_delay_ratio", "tst_delay_dev_ration", "tst_sync_loop"]
#: Fields of each reply's body in order; a kind is a width with a sign, or float (32 bits), ip (20 bytes), time (12 bytes).
_FLOATS = lambda *names: [(n, "float") for n in names]
_COUNTS = lambda *names: [(n, "u32") for n in names]
REPLIES: dict[str, tuple[int, list[tuple[str, str]]]] = {
    "sources": (2, _COUNTS("n_sources")),
    "sourcedata": (3, [("ip", "ip"), ("poll", "i16"), ("stratum", "u16"), ("state", "u16"), ("mode", "u16"), ("flags", "u16"), ("reachability", "u16"), ("since_sample", "u32"), *_FLOATS("orig_latest_meas", "latest_meas", "latest_meas_err")]),
    "tracking": (5, [("ref_id", "u32"), ("ip", "ip"), ("stratum", "u16"), ("leap_status", "u16"), ("ref_time", "time"), *_FLOATS("current_correction", "last_offset", "rms_offset", "freq_ppm", "resid_freq_ppm", "skew_ppm", "root_delay", "root_dispersion", "last_update_interval")]),
    "sourcestats": (6, [("ref_id", "u32"), ("ip", "ip"), *_COUNTS("n_samples", "n_runs", "span_seconds"), *_FLOATS("standard_deviation", "resid_freq_ppm", "skew_ppm", "estimated_offset", "estimated_offset_err")]),
    "activity": (12, [(n, "i32") for n in ("online", "offline", "burst_online", "burst_offline", "unresolved")]),
    "serverstats": (14, _COUNTS("ntp_hits", "cmd_hits", "ntp_drops", "cmd_drops", "log_drops")),
    "ntpdata": (16, [("remote_ip", "ip"), ("local_ip", "ip"), ("remote_port", "u16"), ("leap", "u8"), ("version", "u8"), ("mode", "u8"), ("stratum", "u8"), ("poll", "i8"), ("precision", "i8"), *_FLOATS("root_delay", "root_dispersion"), ("ref_id", "u32"), ("ref_time", "time"), *_FLOATS("offset", "peer_delay", "peer_dispersion", "response_time", "jitter_asymmetry"), ("flags", "u16"), ("tx_tss_char", "u8"), ("rx_tss_char", "u8"), *_COUNTS("total_tx_count", "total_rx_count", "total_valid_count")]),
    "serverstats2": (22, _COUNTS("ntp_hits", "nke_hits", "cmd_hits", "ntp_drops", "nke_drops", "cmd_drops", "log_drops", "ntp_auth_hits")),
    "serverstats3": (24, _COUNTS("ntp_hits", "nke_hits", "cmd_hits", "ntp_drops", "nke_drops", "cmd_drops", "log_drops", "ntp_auth_hits", "ntp_interleaved_hits", "ntp_timestamps", "ntp_span_seconds")),
}
_WIDTH = {"u8": 1, "i8": 1, "u16": 2, "i16": 2, "u32": 4, "i32": 4, "float": 4, "ip": 20, "time": 12}


def _slice(digits: Column, at: int, n: int) -> Column:
    return F.substring(digits, 2 * at + 1, 2 * n)


def _number(digits: Column, at: int, n: int, sign: bool = False) -> Column:
    value = F.conv(_slice(digits, at, n), 16, 10).cast("bigint")
    return F.when(value >= 1 << (8 * n - 1), value - (1 << 8 * n)).otherwise(value) if sign else value


def chrony_float(bits: Column) -> Column:
    """Number of a 7-bit signed exponent and a 25-bit signed coefficient, given as an unsigned or signed 32-bit number."""
    u = bits.cast("bigint").bitwiseAND(0xFFFFFFFF)
    exp, coef = F.shiftright(u, 25), u.bitwiseAND((1 << 25) - 1)
    exp = F.when(exp >= 64, exp - 128).otherwise(exp) - 25
    coef = F.when(coef >= 1 << 24, coef - (1 << 25)).otherwise(coef)
    return coef.cast("double") * F.pow(F.lit(2.0), exp.cast("double"))


def _shortened(full: Column) -> Column:
    """Eight groups between colons with the first of the longest runs of zero groups left out."""
    out = None
    for n in range(8, 1, -1):
        zeros = ":0" * n + ":"
        place = F.instr(full, zeros)
        short = F.concat(F.substring(full, F.lit(1), place - 1), F.lit("::"), F.substring(full, place + len(zeros), F.lit(99)))
        out = F.when(place > 0, short) if out is None else out.when(place > 0, short)
    return F.regexp_replace(out.otherwise(full), "^:(?!:)|(?<!:):$", "")


def _ip(digits: Column, at: int) -> Column:
    """Address text in its usual short form. The text is bound once: the short forms name it many times."""
    v4 = F.concat_ws(".", *[_number(digits, at + i, 1).cast("string") for i in range(4)])
    groups = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.lower(F.regexp_replace(F.substring(digits, i * 4 + 2 * at + 1, F.lit(4)), "^0{1,3}", "")))
    full = F.concat(F.lit(":"), F.array_join(groups, ":"), F.lit(":"))
    v6 = F.transform(F.array(full), _shortened)[0]
    return F.when(_number(digits, at + 16, 2) == 1, v4).otherwise(v6)


def _time(digits: Column, at: int, name: str) -> list[Column]:
    high = _number(digits, at, 4)
    sec = F.shiftleft(F.when(high == 0x7FFFFFFF, 0).otherwise(high), 32).bitwiseOR(_number(digits, at + 4, 4))
    return [sec.alias(f"{name}_sec"), _number(digits, at + 8, 4).cast("int").alias(f"{name}_nsec")]


def _fields(digits: Column, reply: str) -> list[Column]:
    out, at = [], HEAD_BYTES
    for name, kind in REPLIES[reply][1]:
        if kind == "ip":
            out.append(_ip(digits, at).alias(name))
        elif kind == "time":
            out += _time(digits, at, name)
        elif kind == "float":
            out.append(chrony_float(_number(digits, at, 4)).alias(name))
        else:
            value = _number(digits, at, _WIDTH[kind], kind[0] == "i")
            out.append((value if kind == "u32" else value.cast("int")).alias(name))
        at += _WIDTH[kind]
    return out


def reply_bytes(reply: str) -> int:
    return HEAD_BYTES + sum(_WIDTH[k] for _, k in REPLIES[reply][1])


def head(raw: Column) -> Column:
    """struct<version, packet_type, command, reply, status, sequence>; null for fewer bytes than a head has."""
    d = F.hex(raw)
    fields = F.struct(_number(d, 0, 1).cast("int").alias("version"), _number(d, 1, 1).cast("int").alias("packet_type"), _number(d, 4, 2).cast("int").alias("command"), _number(d, 6, 2).cast("int").alias("reply"), _number(d, 8, 2).cast("int").alias("status"), _number(d, 16, 4).alias("sequence"))
    return F.when(F.octet_length(raw) >= HEAD_BYTES, fields)


def problem(raw: Column) -> Column:
    """Why a packet can't be decoded; null if it can."""
    h = head(raw)
    sizes = F.lit(None).cast("int")
    for name, (code, _) in REPLIES.items():
        sizes = F.when(h["reply"] == code, reply_bytes(name)).otherwise(sizes)
    return (
        F.when(raw.isNull() | (F.octet_length(raw) < HEAD_BYTES), F.lit("packet cut short"))
        .when(h["status"] != 0, F.concat(F.lit("status "), status_name(h["status"]), F.lit(" ("), h["status"].cast("string"), F.lit(")")))
        .when(sizes.isNull(), F.concat(F.lit("reply type not implemented: "), h["reply"].cast("string")))
        .when(F.octet_length(raw) < sizes, F.lit("packet cut short"))
    )


def decode(df: DataFrame, reply: str, raw: str = "raw") -> DataFrame:
    """command, reply, sequence and the body's fields of the good packets of one kind of reply."""
    good = df.where(problem(F.col(raw)).isNull() & (head(F.col(raw))["reply"] == REPLIES[reply][0]))
    h = head(F.col(raw))
    return good.select(h["command"].alias("command"), h["reply"].alias("reply"), h["sequence"].alias("sequence"), *_fields(F.hex(raw), reply))


def dead_letters(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Packets that can't be decoded, with the reason."""
    return df.withColumn("problem", problem(F.col(raw))).where("problem is not null")


def _named(code: Column, names: list[str], other: str) -> Column:
    return F.when((code >= 0) & (code < len(names)), F.element_at(F.array(*[F.lit(n) for n in names]), F.least(F.greatest(code, F.lit(0)), F.lit(len(names) - 1)).cast("int") + 1)).otherwise(F.concat(F.lit(f"{other} ("), code.cast("string"), F.lit(")")))


def status_name(code: Column) -> Column:
    return _named(code, STATUS, "UNKNOWN")


def state_name(code: Column) -> Column:
    return _named(code, STATES, "unknown")


def mode_name(code: Column) -> Column:
    return _named(code, MODES, "unknown")


def packet_type_name(code: Column) -> Column:
    return F.when(code == 1, "request").when(code == 2, "reply").otherwise(F.concat(F.lit("unknown ("), code.cast("string"), F.lit(")")))


def ref_id_hex(ref_id: Column) -> Column:
    return F.lpad(F.hex(ref_id), 8, "0")


def ref_id_text(ref_id: Column) -> Column:
    """The four bytes as characters; those that can't be printed are left out."""
    return F.regexp_replace(F.decode(F.unhex(ref_id_hex(ref_id)), "ISO-8859-1"), "[^\\x20-\\x7E\\u00A1-\\u00AC\\u00AE-\\u00FF]", "")


def failed_tests(flags: Column) -> Column:
    """Names of the tests whose bit is not set, in order of their bits."""
    tests = F.array(*[F.struct(F.lit(1 << i).alias("mask"), F.lit(n).alias("name")) for i, n in enumerate(TEST_NAMES)])
    return F.transform(F.filter(tests, lambda t: flags.bitwiseAND(t["mask"]) == 0), lambda t: t["name"])


def ip_bytes(address: str) -> bytes:
    """An address as 16 bytes (IPv4: four and zeros), family and padding."""
    ip = ipaddress.ip_address(address)
    mapped = getattr(ip, "ipv4_mapped", None)
    ip = mapped or ip
    return ip.packed.ljust(16, b"\0") + struct.pack(">HH", 1 if ip.version == 4 else 2, 0)


def request(command: str, sequence: int = 1, index: int | None = None, address: str | None = None) -> bytes:
    """A request packet; sourcedata and sourcestats take an index, ntpdata an address."""
    body = b""
    if command in ("sourcedata", "sourcestats"):
        body = struct.pack(">ii", index or 0, 0)
    elif command == "ntpdata":
        body = ip_bytes(address or "::") + struct.pack(">i", 0)
    padding = REQUEST_DATA - {"sourcedata": 4, "sourcestats": 4, "ntpdata": 16}.get(command, 0)
    return struct.pack(">BBBBHHIII", VERSION, 1, 0, 0, COMMANDS[command], 0, sequence, 0, 0) + body + bytes(padding)


def request_bytes(command: str, sequence: Column, index: Column | None = None) -> Column:
    """BINARY request packets of one kind, for columns of sequence numbers and source indexes (sourcedata and sourcestats)."""
    plain = request(command)
    first = F.lit(plain[:8].hex())
    number = F.lpad(F.hex(sequence.cast("bigint")), 8, "0")
    rest = plain[12:].hex()
    if index is None or command not in ("sourcedata", "sourcestats"):
        return F.unhex(F.concat(first, number, F.lit(rest)))
    return F.unhex(F.concat(first, number, F.lit(rest[:16]), F.lpad(F.hex(index.cast("bigint")), 8, "0"), F.lit(rest[24:])))


#: Fixed values, in nanoseconds: half of a channel's margin, that an estimated error may reach; drift between clocks that is an error.
MOST_ERROR_NS, MOST_DRIFT_NS = 4_100_000, 1_000_000


def clock_problems(tracking: DataFrame, stats: DataFrame, drift_ns: Column | int = 0) -> DataFrame:
    """ref_id, ip, error_ns, problem for each tracking reply: what is wrong with the clock, null where all is well.

    `tracking` and `stats` are decoded replies; the source of a tracking reply is the one of its reference id. `drift_ns` is how far the
    wall clock lies from the monotonic one. An error over half a margin comes before a drift; the newest statistics (by sequence) count.
    """
    newest = stats.groupBy("ref_id").agg(F.max_by(F.struct("ip", "estimated_offset_err"), "sequence").alias("s"))
    drift = F.lit(drift_ns) if isinstance(drift_ns, int) else drift_ns
    rows = tracking.select("ref_id", drift.alias("_drift")).join(newest, "ref_id", "left")
    error = F.floor(F.col("s.estimated_offset_err") * 1e9).cast("bigint")
    problem = (
        F.when(F.col("s").isNull(), F.lit("no statistics of the source"))
        .when(error > MOST_ERROR_NS, F.lit("estimated error too large"))
        .when(F.abs("_drift") >= MOST_DRIFT_NS, F.lit("wall clock and monotonic clock differ"))
    )
    return rows.select("ref_id", F.col("s.ip").alias("ip"), error.alias("error_ns"), problem.alias("problem"))
