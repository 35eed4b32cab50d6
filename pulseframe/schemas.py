"""The canonical tables: measurements, events, groups."""

from __future__ import annotations

#: One measurement: the key it is grouped by, when, in which order of arrival, its scalar, whether it counts as lost.
MEASUREMENT = "stream string, time timestamp, seq long, value double, is_lossy boolean"
EVENT = "event_type string, stream string, severity int, time timestamp, detection_latency long, description string, tags map<string,string>"
GROUP = f"start_time timestamp, end_time timestamp, events array<struct<{', '.join(x.replace(' ', ':', 1) for x in EVENT.split(', '))}>>, uid string"
EVENT_COLUMNS = tuple(x.split()[0] for x in EVENT.split(", "))
