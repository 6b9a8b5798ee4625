"""SQL building blocks for checking queries in DuckDB."""

from __future__ import annotations

from inkwell.operators import detect
from inkwell.sources.notes import NOTES_SQL


def duck(pattern: str) -> str:
    """A pattern of the detection rules in DuckDB's dialect, as a literal."""
    return pattern.replace("(?iu)", "(?i)").replace("{1,2048}", "+").replace(r"\x{85}\p{Z}", r"\x{85}\pZ").replace("'", "''")


def spans(source: str, pattern: str, text: str = "text", key: str = "doc_id") -> str:
    """(key, value, start) of all matches, from a table."""
    return f"""SELECT {key}, u.v AS value, u.s AS start FROM (SELECT {key}, unnest(list_transform(range(1, len(ms) + 1), lambda i: {{'v': ms[i], 's': (list_sum(list_transform(gs[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda g: length(g))), 0))::INT}})) AS u
FROM (SELECT {key}, regexp_extract_all({text}, '{pattern}') AS ms, string_split_regex({text}, '{pattern}') AS gs FROM {source}) WHERE len(ms) > 0)"""


_DIGIT = "substr(d, {}, 1)::INT"
_NHS = "(SELECT NOT regexp_matches(d, '^(0+|1+|2+|3+|4+|5+|6+|7+|8+|9+)$') AND (11 - (" + " + ".join(f"substr(d, {i + 1}, 1)::INT * {10 - i}" for i in range(9)) + ") % 11) % 11 = substr(d, 10, 1)::INT)"


def _rule(number: int, rule: detect.Rule, source: str) -> str:
    p = duck(rule.pattern)
    value = f"regexp_extract(value, '{p}', 1)" if rule.tail else "rtrim(value, '.,;)!?')" if rule.category == "URL" else "value"
    start = f"start + length(value) - length({value})" if rule.tail else "start"
    keep = ""
    if rule.category == "NHS_NUMBER" and not rule.tail:
        keep = f"WHERE {_NHS}"
    if rule.category == "NI_NUMBER":
        keep = "WHERE upper(substr(phrase, 1, 2)) NOT IN (" + ", ".join(f"'{x}'" for x in detect.NI_DENIED) + ")"
    return f"""SELECT doc_id, {number} AS rule, category, start, start + length(phrase) AS "end", phrase, {rule.confidence}::DOUBLE AS confidence FROM
(SELECT *, regexp_replace(phrase, '[^0-9]', '', 'g') AS d FROM (SELECT doc_id, '{rule.category}' AS category, ({start})::INT AS start, {value} AS phrase FROM ({spans(source, p)}))) {keep}"""


def evidence_of(source: str = "notes", mark: str = "") -> str:
    """Tables that end in ``evidence``, from the texts of ``source``; ``mark``
    ends their names."""
    plain = "\nUNION ALL ".join(_rule(i, r, source) for i, r in enumerate(detect.RULES))
    return f"""plain{mark} AS ({plain}),
context{mark} AS ({_rule(90, detect.NHS_CONTEXT, source)}),
found{mark} AS (SELECT * FROM plain{mark} UNION ALL SELECT c.* FROM context{mark} c WHERE NOT EXISTS (SELECT 1 FROM plain{mark} p WHERE p.doc_id = c.doc_id AND p.category = c.category AND p.start = c.start AND p."end" = c."end") UNION ALL {_rule(91, detect.ADDRESS_LEAD, source)}),
evidence{mark} AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY rule, start) - 1)::BIGINT AS seq, category, start, "end", phrase, confidence, 'rules' AS stage FROM found{mark})"""


#: Notes and their evidence.
EVIDENCE_SQL = f"""{NOTES_SQL},
{evidence_of()}"""

#: Merged items of the table ``pool`` (evidence of all stages), then labels.
ITEMS_SQL = """reach AS (SELECT *, max("end") OVER (PARTITION BY doc_id ORDER BY start, "end", seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM pool),
isl AS (SELECT *, sum(CASE WHEN r IS NULL OR start >= r THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY start, "end", seq ROWS UNBOUNDED PRECEDING)::BIGINT AS item FROM reach),
items AS (SELECT doc_id, item, min(start) AS start, max("end") AS "end", arg_min(category, {'a': stage <> 'rules', 'b': start, 'c': "end", 'd': seq}) AS category, array_to_string(list_sort(list(DISTINCT stage)), ',') AS stages, max(confidence) AS confidence, count(*) AS n_evidence FROM isl GROUP BY doc_id, item),
phrased AS (SELECT i.*, substr(n.text, i.start + 1, i."end" - i.start) AS phrase FROM items i JOIN notes n USING (doc_id)),
grouped AS (SELECT *, min(item) OVER (PARTITION BY doc_id, category, phrase) AS grp, min(start) OVER (PARTITION BY doc_id, category, phrase) AS first_at FROM phrased),
labelled AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id, category ORDER BY first_at)::INT AS number, '[' || category || '_' || dense_rank() OVER (PARTITION BY doc_id, category ORDER BY first_at) || ']' AS replacement FROM grouped)"""

#: Decisions by group number, and the rendered text.
DECIDED_SQL = """decided AS (SELECT *, CASE grp % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'accept' WHEN 2 THEN 'keep' WHEN 3 THEN 'remove' ELSE 'edit' END AS decision, CASE WHEN grp % 5 = 4 THEN '[EDITED_' || grp || ']' ELSE replacement END AS shown FROM labelled),
outs AS (SELECT *, CASE decision WHEN 'keep' THEN phrase WHEN 'remove' THEN '' ELSE shown END AS out FROM decided),
cut AS (SELECT o.*, substr(n.text, coalesce(lag(o."end") OVER w, 0) + 1, o.start - coalesce(lag(o."end") OVER w, 0)) AS gap, n.text FROM outs o JOIN notes n USING (doc_id) WINDOW w AS (PARTITION BY o.doc_id ORDER BY o.start)),
shown_text AS (SELECT doc_id, string_agg(gap || out, '' ORDER BY start) || substr(any_value(text), max("end") + 1) AS output, count(*) FILTER (decision = 'pending') AS pending, count(*) FILTER (decision = 'keep') AS retained FROM cut GROUP BY doc_id)"""
