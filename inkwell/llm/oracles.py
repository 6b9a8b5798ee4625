"""DuckDB SQL for the queries of this subpackage that SQL can express.

The SentencePiece ids, the token files, the licence classifier and the
personal-data classifier can't be written in SQL; tests compare these with
plain Python versions, the libraries themselves, or held-out rows.
"""

from __future__ import annotations

from inkwell.plans.oracles import spans

from .mixing import Mix
from .quality import DELTA, GRID, RISK, SCORE

WORDS = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DOCS = "docs AS (SELECT *, coalesce(text, '') AS body FROM documents)"


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def _secrets() -> str:
    names = "|".join(_any_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + _any_case("api") + "_?" + _any_case("key")
    assign = rf"""({names})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
    rules = [
        ("assign", assign, f"length(regexp_extract(value, '{assign}', 2)) >= 8"),
        ("access", "AKIA[A-Z0-9]+", "length(value) >= 16"),
        ("hex", "[0-9a-f]+", "length(value) >= 32"),
        ("pem", "-----BEGIN (?:[A-Z]{1,12} ){0,3}PRIVATE KEY-----", "true"),
        ("github", "gh[oprsu]_[A-Za-z0-9]{36,255}", "NOT regexp_matches(before, '[A-Za-z0-9_]')"),
        ("slack", "xox[abprs]-[A-Za-z0-9-]{10,255}", "NOT regexp_matches(before, '[A-Za-z0-9]')"),
        ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "NOT regexp_matches(before, '[A-Za-z0-9_-]')"),
    ]
    found = "\nUNION ALL ".join(
        f"SELECT row_id, {i} AS ord, '{kind}' AS kind, start, start + length(value) AS stop FROM (SELECT s.*, CASE WHEN start > 0 THEN substr(d.body, start, 1) ELSE '' END AS before FROM ({spans('texts', pattern, 'body', 'row_id')}) s JOIN texts d USING (row_id)) WHERE {keep}"
        for i, (kind, pattern, keep) in enumerate(rules)
    )
    each = "kind || ':' || start || ':' || stop"
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in ("assign", "access", "hex"))
    return f"""WITH {DOCS}, texts AS (SELECT row_number() OVER () AS row_id, doc_id, body FROM docs), found AS ({found}),
per AS (SELECT row_id, {counts}, string_agg({each}, ',' ORDER BY start, ord) FILTER (ord < 3) AS base, string_agg({each}, ',' ORDER BY start, ord) AS spans FROM found GROUP BY row_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM texts LEFT JOIN per USING (row_id)"""


NEAR = f"""WITH RECURSIVE {DOCS}, w AS (SELECT doc_id, regexp_extract_all(translate(body, '{UPPER}', '{LOWER}'), '{WORDS}') AS ws FROM docs),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS s FROM w),
n AS (SELECT w.doc_id, count(sh.s) AS n FROM w LEFT JOIN sh USING (doc_id) GROUP BY 1),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y, c, p.n AS nx, q.n AS ny FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
reach(node, low) AS (SELECT doc_id, doc_id FROM n UNION SELECT l.y, r.low FROM reach r JOIN links l ON l.x = r.node),
comp AS (SELECT node, min(low) AS component_id FROM reach GROUP BY node),
same AS (SELECT x, min(y) AS twin FROM links WHERE c = nx AND c = ny GROUP BY x)
SELECT n.doc_id, n.n AS n_shingles, component_id, n.doc_id = component_id AS kept, least(n.doc_id, coalesce(twin, n.doc_id)) AS class_id FROM n JOIN comp ON node = n.doc_id LEFT JOIN same ON same.x = n.doc_id"""

TOP = """WITH ok AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, coalesce(list_sum(list_transform(range(1, least(len(q.v), len(c.v)) + 1), lambda i: q.v[i] * c.v[i])), 0)::BIGINT AS score FROM ok q JOIN ok c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""


def _quality() -> str:
    score = SCORE.replace(" div ", " // ")
    grid = ", ".join(f"({c})" for c in GRID)
    return rf"""WITH {DOCS}, d AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(lang, '') AS stratum, body, regexp_extract_all(body, '{WORDS}') AS ws, list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '{WORDS}')) AS ls FROM docs),
win AS (SELECT row_id, i, array_to_string(ws[i:i + 4], ' ') AS s FROM (SELECT row_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM d WHERE len(ws) > 5)),
rep AS (SELECT row_id, i FROM win QUALIFY count(*) OVER (PARTITION BY row_id, s) > 1),
cov AS (SELECT row_id, count(DISTINCT i + k) AS n FROM rep, range(0, 5) r(k) GROUP BY row_id),
meas AS (SELECT d.row_id, doc_id, stratum, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, length(regexp_replace(body, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines, length(regexp_replace(body, '[^A-Z]', '', 'g'))::BIGINT AS n_upper FROM d LEFT JOIN cov USING (row_id)),
m AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, {score} AS score FROM meas),
marks AS (SELECT doc_id, max(quality) = 1 AS good FROM labels GROUP BY doc_id HAVING max(quality) IS NOT NULL),
held AS (SELECT m.*, good FROM m JOIN marks USING (doc_id) WHERE NOT base_failed),
big AS (SELECT stratum, count(*) FILTER (good) AS n, count(*) FILTER (NOT good) AS n_bad FROM held GROUP BY stratum HAVING count(*) FILTER (good) >= ceil(ln({DELTA}) / ln(1 - {RISK}))),
tests AS (SELECT stratum, n, n_bad, cutoff, count(*) FILTER (good AND score >= cutoff) AS k, count(*) FILTER (NOT good AND score >= cutoff) AS bad FROM held JOIN big USING (stratum), (VALUES {grid}) g(cutoff) GROUP BY ALL),
fit AS (SELECT *, k <= n * {RISK} AND list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({RISK}) + (n - i) * ln(1 - {RISK})))) <= {DELTA} / (SELECT count(*) FROM big) AS ok FROM tests),
usable AS (SELECT * FROM (SELECT *, max(cutoff) FILTER (NOT ok) OVER (PARTITION BY stratum) AS worst FROM fit) WHERE cutoff > coalesce(worst, -1)),
cuts AS (SELECT stratum, max({{'gain': bad * n - k * n_bad, 'cutoff': cutoff}}).cutoff AS cutoff FROM usable WHERE bad * n > k * n_bad GROUP BY stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(score < cutoff, true) AS kept FROM m LEFT JOIN cuts USING (stratum)"""


def _urls(rules: list[tuple[str, str, str]]) -> str:
    values = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in rules)
    return f"""WITH rules AS (SELECT * FROM (VALUES {values}) AS t(v, h, p)), u AS (SELECT row_number() OVER () AS row_id, page_id, CASE WHEN contains(url, '://') THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT row_id, page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
b AS (SELECT row_id, arg_max({{'r': h || p, 'v': v}}, {{'a': length(h) + length(p), 'b': length(h), 'c': v = 'block'}}) AS x FROM s JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY row_id)
SELECT page_id, host, path, x.r AS rule, coalesce(x.v, 'allow') AS verdict FROM s LEFT JOIN b USING (row_id)"""


def _mix(mix: Mix) -> str:
    """Budgets level by level: of siblings by capacity for weight, one is full
    as long as what those before it leave would give it its capacity."""
    depth = len(mix.levels)
    cols = [f"l{i}" for i in range(depth)]
    levels = ", ".join(f"coalesce(({e})::VARCHAR, '') AS l{i}" for i, e in enumerate(mix.levels))
    cases = lambda i: "CASE " + " ".join(f"WHEN ({', '.join(cols[: i + 1])},) = ({', '.join(repr(x) for x in path)},) THEN {w}" for path, w in mix.weights.items() if len(path) == i + 1) + " WHEN false THEN 0 ELSE 1 END"
    parts = [
        f"docs AS (SELECT doc_id, {levels}, len(regexp_extract_all(coalesce(text, ''), '{WORDS}'))::HUGEINT AS tokens FROM documents)",
        f"leaf AS (SELECT {', '.join(cols)}, sum(tokens) AS supply, {mix.max_epochs} * sum(tokens) AS cap FROM docs GROUP BY ALL)",
        f"b0 AS (SELECT least(floor({mix.share} * sum(supply)), sum(cap))::HUGEINT AS budget FROM leaf)",
    ]
    for i in range(depth):
        own, up = ", ".join(cols[: i + 1]), ", ".join(cols[:i])
        by = f"PARTITION BY {up} " if i else ""
        join = f"JOIN b{i} USING ({up})" if i else "CROSS JOIN b0"
        parts += [
            f"k{i} AS (SELECT *, {cases(i)}::HUGEINT AS w FROM (SELECT {own}, sum(cap)::HUGEINT AS cap FROM leaf GROUP BY ALL) {join} WHERE cap > 0)",
            f"o{i} AS (SELECT *, coalesce(sum(cap) OVER (q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS before, sum(w) OVER (q ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::HUGEINT AS rest_w FROM k{i} WINDOW q AS ({by}ORDER BY cap::DOUBLE / w, l{i}))",
            f"f{i} AS (SELECT *, (budget - before) * w >= cap * rest_w AS fills FROM o{i})",
            f"a{i} AS (SELECT *, (budget - coalesce(sum(cap) FILTER (fills) OVER ({by}), 0))::HUGEINT AS left_over, (sum(w) FILTER (NOT fills) OVER ({by}))::HUGEINT AS open_w FROM f{i})",
            f"p{i} AS (SELECT *, CASE WHEN fills THEN cap ELSE left_over * w // open_w END AS base, CASE WHEN fills THEN 0 ELSE left_over * w % open_w END AS part FROM a{i})",
            f"r{i} AS (SELECT *, row_number() OVER ({by}ORDER BY fills, part DESC, l{i}) AS place, left_over - coalesce(sum(base) FILTER (NOT fills) OVER ({by}), 0) AS spare FROM p{i})",
            f"b{i + 1} AS (SELECT {own}, (base + CASE WHEN NOT fills AND place <= spare THEN 1 ELSE 0 END)::HUGEINT AS budget FROM r{i})",
        ]
    names = ", ".join(cols)
    parts += [
        f"plan AS (SELECT *, CASE WHEN supply > 0 THEN coalesce(budget, 0) // supply ELSE 0 END AS whole, CASE WHEN supply > 0 THEN coalesce(budget, 0) % supply ELSE 0 END AS rest FROM leaf LEFT JOIN b{depth} USING ({names}))",
        f"placed AS (SELECT d.*, whole, rest, sum(tokens) OVER (PARTITION BY {names} ORDER BY md5('{mix.seed}:' || whole || ':' || doc_id) RANGE UNBOUNDED PRECEDING) AS upto FROM docs d JOIN plan USING ({names}))",
        "taken AS (SELECT *, whole + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS copies FROM placed)",
    ]
    return f"WITH {', '.join(parts)} SELECT doc_id, unnest(range(0, copies::BIGINT)) AS epoch, concat_ws('/', {names}) AS leaf, tokens::BIGINT AS n_tokens FROM taken WHERE copies > 0"


#: Rows below which no answer is given, quantiles asked for, parts and distinct
#: values of a summary, as op12 has them.
_Q, _PARTS, _DISTINCT = 20, 100, 20


def _quantiles() -> str:
    bits = "list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)"
    crc = lambda s: f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({s}, ''), lambda ch: ascii(ch)::BIGINT)), lambda c, b: {bits}), 4294967295)"
    return f"""
WITH raw AS (
  SELECT 'value' AS stream, CAST(client_id AS VARCHAR) AS grp, CAST(click_id AS VARCHAR) AS id, value AS money
  FROM (SELECT click_id, max(client_id) AS client_id, max(value) AS value FROM clicks GROUP BY click_id)
  UNION ALL
  SELECT 'price', i.brand, coalesce(CAST(l.vendor_id AS VARCHAR), ''), i.price FROM sale_lines l JOIN items i ON l.item_id = i.item_id),
ids AS (SELECT id, CASE WHEN id = '' THEN 0 ELSE {crc("id")} % 16 END AS batch FROM (SELECT DISTINCT id FROM raw)),
part AS (
  SELECT r.stream, r.grp, CAST(d.batch AS INTEGER) AS batch, CAST(floor(100 * r.money + 0.5) AS BIGINT) + 1000 * d.batch AS x
  FROM raw r JOIN ids d ON r.id = d.id WHERE r.grp IS NOT NULL AND r.money IS NOT NULL AND isfinite(r.money)),
both_levels AS (SELECT * FROM part UNION ALL SELECT stream, grp, -1, x FROM part),
cells AS (SELECT stream, grp, batch, x, count(*) AS c FROM both_levels GROUP BY ALL),
ranked AS (
  SELECT stream, grp, batch, x, CAST(sum(c) OVER w - c AS BIGINT) AS below, CAST(sum(c) OVER w AS BIGINT) AS upto,
    row_number() OVER w AS dr, CAST(sum(c) OVER g AS BIGINT) AS n, count(*) OVER g AS d
  FROM cells WINDOW w AS (PARTITION BY stream, grp, batch ORDER BY x), g AS (PARTITION BY stream, grp, batch)),
cuts AS (
  SELECT * FROM ranked
  WHERE batch >= 0 AND (d <= {_PARTS + _DISTINCT}
    OR greatest(1, (({_PARTS} * upto) // n * n + {_PARTS - 1}) // {_PARTS}) > below
    OR (({_DISTINCT} * dr) // d > 0 AND (({_DISTINCT} * dr) // d * d + {_DISTINCT - 1}) // {_DISTINCT} = dr))),
steps AS (
  SELECT stream, grp, x, sum(d_lo) AS d_lo, sum(d_hi) AS d_hi FROM (
    SELECT stream, grp, x, upto - coalesce(lag(upto) OVER w, 0) AS d_lo, coalesce(lead(below) OVER w, n) - below AS d_hi
    FROM cuts WINDOW w AS (PARTITION BY stream, grp, batch ORDER BY x)) GROUP BY ALL),
points AS (
  SELECT stream, grp, batch, n, x, below AS below_hi, upto AS upto_lo FROM cuts
  UNION ALL
  SELECT stream, grp, -1, CAST(sum(d_lo) OVER (PARTITION BY stream, grp) AS BIGINT), x,
    CAST(sum(d_hi) OVER w - d_hi AS BIGINT), CAST(sum(d_lo) OVER w AS BIGINT)
  FROM steps WINDOW w AS (PARTITION BY stream, grp ORDER BY x)),
asked AS (
  SELECT stream, grp, batch, i, n, (i * n + {_Q - 1}) // {_Q} AS target, count(*) AS points,
    min({{'off': greatest(0, below_hi + 1 - (i * n + {_Q - 1}) // {_Q}, (i * n + {_Q - 1}) // {_Q} - upto_lo), 'x': x}}).x AS answer
  FROM points, (SELECT CAST(unnest(range(1, {_Q})) AS INTEGER) AS i) WHERE n >= {_Q} GROUP BY stream, grp, batch, i, n),
exact AS (
  SELECT a.*, e.x AS exact_x, r.below AS n_below, r.upto AS n_upto,
    greatest(0, r.below + 1 - a.target, a.target - r.upto) AS rank_error
  FROM asked a
  JOIN ranked e ON e.stream = a.stream AND e.grp = a.grp AND e.batch = a.batch AND e.below < a.target AND a.target <= e.upto
  JOIN ranked r ON r.stream = a.stream AND r.grp = a.grp AND r.batch = a.batch AND r.x = a.answer)
SELECT stream, grp, batch, i, CAST(n AS BIGINT) AS n, CAST(target AS BIGINT) AS target, exact_x, points, answer, n_below, n_upto,
  CAST(rank_error AS BIGINT) AS rank_error, 1000 * rank_error <= 10 * n AS within
FROM exact"""


COPIES = """
WITH named AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first(doc_id) OVER (w ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER w AS group_size,
  doc_id = first(doc_id) OVER (w ORDER BY n DESC, doc_id) AS kept, text_sha256
FROM named WINDOW w AS (PARTITION BY text_sha256)"""


def oracles(rules: list[tuple[str, str, str]], mix: Mix) -> dict[str, str]:
    return {"op1_secret_scan": _secrets(), "op2_near_duplicates": NEAR, "op6_topk_search": TOP, "op7_quality_rules": _quality(), "op9_url_filter": _urls(rules), "op10_source_mixing": _mix(mix), "op12_quantile_summaries": _quantiles(), "op13_exact_dedup": COPIES}
