"""Schemas of the engine's tables, as DDL."""

BOUNDARY = "struct<enum: array<struct<caption: string, value: string>>, year: string, month: string, day: string, shown: array<string>, left_out: array<string>>"
RANGE = f"struct<raw: string, open: boolean, break_after: string, start: {BOUNDARY}, end: {BOUNDARY}>"
WARNINGS = "array<struct<kind: string, text: string>>"
PARSED = f"struct<raw: string, success: boolean, needs_review: boolean, belongs_in: string, skipped: array<string>, warnings: {WARNINGS}, attention: array<string>, ranges: array<{RANGE}>>"
SUBFIELDS = "array<struct<code: string, value: string>>"
FIELD = f"struct<tag: string, ind1: string, ind2: string, subfields: {SUBFIELDS}>"
RECORD_FIELDS = f"array<struct<pos: int, tag: string, ind1: string, ind2: string, data: string, subfields: {SUBFIELDS}>>"
RECORDS = f"file string, record_index bigint, leader string, fields {RECORD_FIELDS}, unreadable boolean"
STATEMENTS = "record_index bigint, field_index int, text string"
CONVERTED = f"link string, conformed boolean, held boolean, flagged boolean, belongs_in string, switch string, field_853 {FIELD}, fields_863 array<{FIELD}>, warnings {WARNINGS}, attention array<string>, left_out array<string>"
#: Settings of one record over those of the run; null is not set.
SETTINGS = "struct<frequency: string, per_higher: string, continuity: string, captions: array<struct<level: int, caption: string>>>"
