"""The streaming aggregations run as batches over the events table, and the stream itself in tests."""

from __future__ import annotations

from .base import Book

book = Book()
QUERIES, SQL = book.QUERIES, book.SQL


@book.query
def windowed_events(d):
    """Events and mean value per type and hour."""
    return "select date_trunc('hour', ts) as start, event_type, count(*) as n, round(avg(value), 5) as mean_value from events group by 1, 2"


@book.query
def user_sessions(d):
    """Sessions per user: gaps of more than thirty minutes divide them."""
    micros = "unix_micros(cast(ts as timestamp))" if d.name == "spark" else "epoch_us(ts)"
    return f"""with e as (select user_id, {micros} as t from events), g as (select user_id, t, case when t - lag(t) over (partition by user_id order by t) <= 1800000000 then 0 else 1 end as fresh from e)
        select user_id, cast(sum(fresh) as bigint) as sessions, count(*) as events from g group by user_id"""
