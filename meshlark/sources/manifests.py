"""Manifest texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hls(durations: Column, prefix: Column) -> Column:
    """A media playlist over whole seconds: header, an entry for each segment, end mark."""
    entry = lambda d, i: F.concat(F.lit("#EXTINF:"), d.cast("string"), F.lit(".0000,\n"), prefix, F.lit("_"), i.cast("string"), F.lit(".m4s"))
    head = F.concat(F.lit("#EXTM3U\n#EXT-X-VERSION:6\n#EXT-X-TARGETDURATION:"), F.array_max(durations).cast("string"))
    return F.concat_ws("\n", head, F.array_join(F.transform(durations, entry), "\n"), F.lit("#EXT-X-ENDLIST"))


def dash(durations: Column) -> Column:
    """A static presentation description over whole seconds: its length and the timeline in milliseconds."""
    total = F.aggregate(durations, F.lit(0).cast("bigint"), lambda s, d: s + d)
    head = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<MPD type="static" mediaPresentationDuration="PT'), total.cast("string"), F.lit('S">\n  <SegmentTimeline>'))
    entries = F.array_join(F.transform(durations, lambda d: F.concat(F.lit('    <S d="'), (d * 1000).cast("string"), F.lit('"/>'))), "\n")
    return F.concat_ws("\n", head, entries, F.lit("  </SegmentTimeline>\n</MPD>"))
