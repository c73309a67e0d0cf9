"""Column types of the records that cross the package's borders."""

from pyspark.sql import types as T

PACKET = T.StructType([
    T.StructField("packet_id", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("ts_us", T.LongType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("dst_ip", T.StringType()),
    T.StructField("src_port", T.IntegerType()),
    T.StructField("dst_port", T.IntegerType()),
    T.StructField("protocol", T.IntegerType()),
    T.StructField("length", T.LongType()),
    T.StructField("flags", T.IntegerType()),
    T.StructField("payload", T.StringType()),
])

ALERT = T.StructType([
    T.StructField("alert_id", T.StringType()),
    T.StructField("ts_us", T.LongType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("dst_ip", T.StringType()),
    T.StructField("dst_port", T.IntegerType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("severity", T.StringType()),
    T.StructField("shap_explanation", T.StringType()),
    T.StructField("rule", T.StringType()),
    T.StructField("detectors", T.StringType()),
])

AUDIT = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("ts_us", T.LongType()),
    T.StructField("event", T.StringType()),
    T.StructField("ip", T.StringType()),
    T.StructField("success", T.BooleanType()),
    T.StructField("detail", T.StringType()),
])

_int, _str, _long = T.IntegerType(), T.StringType(), T.LongType()

DECODED = T.StructType([
    T.StructField("record", _long),
    T.StructField("ts_us", _long),
    T.StructField("length", _long),
    T.StructField("eth", T.StructType([
        T.StructField("src", _str), T.StructField("dst", _str), T.StructField("ethertype", _int)])),
    T.StructField("ip", T.StructType([
        T.StructField("src", _str), T.StructField("dst", _str), T.StructField("proto", _int),
        T.StructField("ttl", _int), T.StructField("length", _int)])),
    T.StructField("tcp", T.StructType([
        T.StructField("sport", _int), T.StructField("dport", _int), T.StructField("seq", _long),
        T.StructField("ack", _long), T.StructField("window", _int), T.StructField("flags", _int)])),
    T.StructField("udp", T.StructType([
        T.StructField("sport", _int), T.StructField("dport", _int), T.StructField("length", _int)])),
    T.StructField("dns", T.StructType([
        T.StructField("qname", _str), T.StructField("qtype", _int), T.StructField("is_response", T.BooleanType()),
        T.StructField("answers", T.ArrayType(_str))])),
    T.StructField("payload", T.BinaryType()),
])
