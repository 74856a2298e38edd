"""Schemas of the tables that operators take and return, as DDL."""

SIGNAL = "series_id string, channel int, t bigint, value double"
MODES = "series_id string, mode int, role string, channel int, t bigint, value double"
MODE_ATTR = "series_id string, mode int, t bigint, inst_freq double, inst_amp double"
SPECTRUM = "series_id string, bin int, freq double, re double, im double, power double"
GRID = "image_id string, channel int, y int, x int, value double"
