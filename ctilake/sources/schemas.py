"""Explicit schemas of the record kinds; sources disagree on keys, so nothing is inferred."""

from pyspark.sql import types as T

_s = T.StringType()


def _struct(text: str) -> T.StructType:
    kinds = {"s": _s, "i": T.IntegerType(), "l": T.LongType(), "d": T.DoubleType(), "t": T.TimestampType(), "a": T.ArrayType(_s)}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (x.split(":") for x in text.split())])


FORUM_POST = _struct("id:s unified_id:s text:s timestamp:s forum_id:s author_hash:s")
EV_PAIR = _struct("exploit_text:s vulnerability_text:s cve_id:s timestamp:s label:i")
RAW_POST = _struct("id:s forum_id:s thread_url:s thread_title:s section:s post_index:i post_id:s thread_id:s body:s text:s timestamp:s scraped_at:s author_hash:s reply_count:i view_count:l tags:a cve_refs:a")
CVE_INDEX = _struct("exploit_id:s post_id:s cve_id:s cves:a exploit_text:s title:s published:s source:s")
VULNERABILITY = _struct("cve_id:s description:s published:s cvss:d")
TASK2 = _struct("id:s text:s label:s source:s timestamp:s")
