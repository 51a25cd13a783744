"""Streaming queries and their batch equivalents."""

from ctilake.streaming.events import events_daily_stream, events_daily_window, fetched_by_day, first_texts_stream

QUERIES = {"events_daily_window": events_daily_window, "events_daily_stream": events_daily_stream, "first_texts_stream": first_texts_stream, "fetched_by_day": fetched_by_day}
_sql = "select ts::date as day, event_type, count(*) as n, sum(round(value * 100)::bigint)::bigint as cents from events group by 1, 2"
SQL = {
    "events_daily_window": _sql, "events_daily_stream": _sql,
    "first_texts_stream": r"select distinct sha256(trim(regexp_replace(lower(text), '[ \t\n\r\f\x0B]+', ' ', 'g'))) as fp from forum_posts where text is not null",
}
