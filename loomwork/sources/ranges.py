"""A data source whose partitions are date ranges; a callable fetches the rows of each."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import date, timedelta

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition


class Span(InputPartition):
    def __init__(self, start: date, end: date):
        self.start, self.end = start, end


def spans(start: str, end: str, days: int) -> list[Span]:
    """Stretches of so many days from start to end (half open), both ISO dates."""
    at, last, found = date.fromisoformat(start), date.fromisoformat(end), []
    while at < last:
        found.append(Span(at, min(last, at + timedelta(days=days))))
        at = found[-1].end
    return found


def date_ranges(name_: str, schema_: str, fetch: Callable[[date, date, dict], Iterator[tuple]]) -> type[DataSource]:
    """A source class to register: options start, end (half open) and days; ``fetch(start, end, options)`` yields rows."""

    class Ranges(DataSource):
        @classmethod
        def name(cls):
            return name_

        def schema(self):
            return schema_

        def reader(self, schema):
            options = dict(self.options)

            class Reader(DataSourceReader):
                def partitions(self):
                    return spans(options["start"], options["end"], int(options.get("days", 7)))

                def read(self, partition):
                    yield from fetch(partition.start, partition.end, options) if partition else ()

            return Reader()

        def streamReader(self, schema):
            options = dict(self.options)

            class StreamReader(DataSourceStreamReader):
                """The offset is the date up to which all was read; ``end`` says how far the reports go by now."""

                def initialOffset(self):
                    return {"upto": options["start"]}

                def latestOffset(self):
                    return {"upto": max(options["start"], options["end"])}

                def partitions(self, start, end):
                    return spans(start["upto"], end["upto"], int(options.get("days", 7)))

                def read(self, partition):
                    yield from fetch(partition.start, partition.end, options)

                def commit(self, end):
                    pass

            return StreamReader()

    return Ranges
