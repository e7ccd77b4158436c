"""The text functions for SQL: `register` makes them temporary SQL functions of a session.

They are written in SQL, so Catalyst sees through them as through the column functions they equal: `text_lines`, `text_words`,
`text_sentences`, `text_markers`, `text_chunks` (text, most words), `text_hard_chunks` (longer sentences cut), `text_sections` (an array) and the
table function `section_rows`, for use with LATERAL.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from quillspark.functions.text import LINE_ENDS, SENTENCES_AND_CLAUSES
from quillspark.profiles import RUSSIAN, Profile

SECTION = "STRUCT<number: STRING, title: STRING, text: STRING>"


def _raw(pattern: str) -> str:
    if "'" in pattern:
        raise ValueError(f"a pattern for SQL holds a quote: {pattern}")
    return f"r'{pattern}'"


def _chunks(cut: bool) -> str:
    """A fold over the sentences; `s` is the state, x a sentence. A function of SQL cannot take a lambda's variable, so words are spelt out."""
    words = r"filter(split(x, r'(?U)\s+'), w -> w <> '')"
    flush = "CASE WHEN s.n > 0 THEN concat(s.done, array(s.now)) ELSE s.done END"
    slices = f"transform(sequence(0, CAST(floor((size({words}) - 1) / most) AS INT)), k -> array_join(slice({words}, k * most + 1, most), ' '))"
    longer = f"named_struct('done', s.done, 'now', concat(s.now, ' ', x), 'n', s.n + size({words}))"
    fresh = f"named_struct('done', {flush}, 'now', x, 'n', size({words}))"
    hard = f"WHEN size({words}) > most THEN named_struct('done', concat({flush}, {slices}), 'now', '', 'n', 0) " if cut else ""
    step = f"CASE {hard}WHEN s.n > 0 AND s.n + size({words}) <= most THEN {longer} ELSE {fresh} END"
    state = "STRUCT<done: ARRAY<STRING>, now: STRING, n: INT>"
    return f"aggregate(text_sentences(t), CAST(named_struct('done', array(), 'now', '', 'n', 0) AS {state}), (s, x) -> CAST({step} AS {state}), s -> {flush})"


def statements(profile: Profile = RUSSIAN) -> list[str]:
    """What `register` runs, in order."""
    marks = ", ".join(f"CASE WHEN t RLIKE {_raw('(?iuU)' + p)} THEN '{name}' END" for name, p in profile.markers.items()) or "CAST(NULL AS STRING)"
    heading, begin = _raw(profile.heading), r"(?:^|\n)H"
    marked = f"array_join(transform(text_lines(t), x -> concat(CASE WHEN x RLIKE {heading} THEN 'H' ELSE 'T' END, x)), '\\n')"
    parts = f"split({marked}, {_raw(begin)})"
    head = "substring_index(p, '\\n', 1)"
    made = f"named_struct('number', regexp_extract({head}, {heading}, 1), 'title', regexp_extract({head}, {heading}, 2), 'text', regexp_replace(substr(p, length({head}) + 2), r'(^|\\n)T', '$1'))"
    whole = "array(named_struct('number', CAST(NULL AS STRING), 'title', CAST(NULL AS STRING), 'text', array_join(text_lines(t), '\\n')))"
    sections = f"CASE WHEN coalesce(size(text_lines(t)), 0) <= 0 THEN CAST(array() AS ARRAY<{SECTION}>) WHEN {marked} RLIKE {_raw(begin)} THEN transform(slice({parts}, 2, greatest(size({parts}) - 1, 0)), p -> {made}) ELSE {whole} END"
    trim = r"r'(?U)^\s+|\s+$'"
    strings = "ARRAY<STRING>"
    bodies = [
        ("text_words(t STRING)", strings, r"filter(split(t, r'(?U)\s+'), w -> w <> '')"),
        ("text_lines(t STRING)", strings, rf"filter(transform(split(replace(t, ' ', ' '), {_raw(LINE_ENDS)}), x -> regexp_replace(regexp_replace(x, r'[ \t]+', ' '), {trim}, '')), x -> x <> '')"),
        ("text_sentences(t STRING)", strings, f"filter(transform(split(t, {_raw(SENTENCES_AND_CLAUSES)}), s -> regexp_replace(s, {trim}, '')), s -> s <> '')"),
        ("text_markers(t STRING)", strings, f"array_compact(array({marks}))"),
        ("text_chunks(t STRING, most INT)", strings, _chunks(False)),
        ("text_hard_chunks(t STRING, most INT)", strings, _chunks(True)),
        ("text_sections(t STRING)", f"ARRAY<{SECTION}>", sections),
    ]
    out = [f"CREATE OR REPLACE TEMPORARY FUNCTION {name} RETURNS {kind} RETURN {body}" for name, kind, body in bodies]
    rows = "SELECT pos + 1, s.number, s.title, s.text FROM (SELECT posexplode(a) AS (pos, s) FROM (SELECT text_sections(t) AS a))"
    return [*out, f"CREATE OR REPLACE TEMPORARY FUNCTION section_rows(t STRING) RETURNS TABLE(ordinal INT, number STRING, title STRING, text STRING) RETURN {rows}"]


def register(spark: SparkSession, profile: Profile = RUSSIAN) -> None:
    """Makes the functions known to the session's SQL; their patterns are those of the profile."""
    for statement in statements(profile):
        spark.sql(statement)
