"""Hand-made raw leg rows in the fetcher's CSV schema (FIXTURES.md section 2)."""

from __future__ import annotations

RAW_FIELDS = (
    "l_number", "distance", "duration", "end_location", "html_instructions", "start_location",
    "steps", "travel_mode", "transit_details", "origin", "destination", "actual_departure",
    "actual_arrival", "total_time", "request_time", "depart_time", "arrival_time",
    "transit_routing_preference", "source_filename", "source_run", "source_apik",
    "source_start_index", "source_end_index", "source_coverage",
)

DETAILS = (
    "{'arrival_stop': {'location': {'lat': 40.7, 'lng': -73.9}, 'name': 'Canal St'}, "
    "'arrival_time': {'text': '8:40\\u202fAM', 'time_zone': 'America/New_York', 'value': 1}, "
    "'departure_stop': {'location': {'lat': 40.6, 'lng': -73.9}, 'name': 'Avenue J'}, "
    "'departure_time': {'text': '8:10\\u202fAM', 'time_zone': 'America/New_York', 'value': 1}, "
    "'headsign': 'X', 'line': {'agencies': [{'name': 'MTA New York City Transit', 'phone': '1', "
    "'url': 'u'}], 'color': '#fccc0a', 'name': 'Q Train', 'short_name': 'Q', "
    "'text_color': '#000000', 'vehicle': {'icon': 'i', 'name': 'Subway', 'type': 'SUBWAY'}}, "
    "'num_stops': 9}"
)


def raw_row(**overrides) -> dict:
    row = {
        "l_number": "0",
        "distance": "{'text': '1 km', 'value': 1200}",
        "duration": "{'text': '5 mins', 'value': 300}",
        "end_location": "{'lat': 40.71, 'lng': -73.95}",
        "html_instructions": "Subway towards X",
        "start_location": "{'lat': 40.61, 'lng': -73.96}",
        "steps": None,
        "travel_mode": "TRANSIT",
        "transit_details": DETAILS,
        "origin": "360470001001",
        "destination": "190001",
        "actual_departure": "8:05 AM",
        "actual_arrival": "8:50 AM",
        "total_time": "45.0",
        "request_time": "01/10/2023 12:00:00 EST",
        "depart_time": None,
        "arrival_time": "01/12/2023 09:00:00 EST",
        "transit_routing_preference": "standard",
        "source_filename": "morning_k1_0-63.csv",
        "source_run": "morning",
        "source_apik": "k1",
        "source_start_index": "0",
        "source_end_index": "63",
        "source_coverage": "63",
    }
    row.update(overrides)
    return row


def raw_frame(spark, rows):
    schema = ", ".join(f"{c} string" for c in RAW_FIELDS)
    return spark.createDataFrame([tuple(r[c] for c in RAW_FIELDS) for r in rows], schema)
