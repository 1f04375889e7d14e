"""SQL for the queries that SQL can express, for DuckDB over the test tables."""

from __future__ import annotations

_PAIRS = """
WITH turns AS (
  SELECT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL
), last AS (
  SELECT conv_id, max(turn) AS last_turn, arg_max(coalesce(text, ''), turn) AS reply
  FROM turns WHERE role = 'assistant' AND turn IS NOT NULL GROUP BY conv_id
), paired AS (
  SELECT a.conv_id, a.last_turn, b.reply AS other FROM last a JOIN last b ON b.conv_id = a.conv_id + 1
), numbered AS (
  SELECT t.conv_id, t.turn, t.role, t.text, p.last_turn, p.other,
    row_number() OVER (PARTITION BY t.conv_id ORDER BY t.turn) AS place
  FROM turns t JOIN paired p ON t.conv_id = p.conv_id AND t.turn <= p.last_turn
), both_sides AS (
  SELECT conv_id, place, coalesce(role, '') AS role, coalesce(text, '') AS text,
    turn = last_turn AND text IS DISTINCT FROM other AS differs, turn = last_turn AS final, other
  FROM numbered
), shared AS (
  SELECT conv_id, coalesce(min(place) FILTER (WHERE differs) - 1, max(place)) AS common FROM both_sides GROUP BY conv_id
), rendered AS (
  SELECT b.conv_id, place, common, final AND place > common AS swapped,
    '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS shown,
    '<|' || role || '|>' || chr(10) || other || '<|end|>' || chr(10) AS shown_other,
    length('<|' || role || '|>') + 1 AS opening, role = 'assistant' AS trained
  FROM both_sides b JOIN shared s USING (conv_id)
)
SELECT conv_id, any_value(common) AS common_turns,
  coalesce(string_agg(shown, '' ORDER BY place) FILTER (WHERE place <= common), '') AS prompt,
  coalesce(string_agg(shown, '' ORDER BY place) FILTER (WHERE place > common), '') AS chosen,
  coalesce(string_agg(shown_other, '' ORDER BY place) FILTER (WHERE swapped), '') AS rejected,
  coalesce(string_agg(opening || '-' || (length(shown) - 1), ',' ORDER BY place) FILTER (WHERE place > common), '') AS chosen_spans,
  coalesce(string_agg(opening || '-' || (length(shown_other) - 1), ',' ORDER BY place) FILTER (WHERE swapped), '') AS rejected_spans
FROM rendered GROUP BY conv_id
"""

ORACLE: dict[str, str] = {"op3_preference_format": _PAIRS}
