"""The same results in plain SQL, for comparison with another engine on the same tables."""

from sparkfold.plans import catalog, examples, scripts, synthetic

#: Cleaning of a line: escapes out, white space at the end off, inner runs of blanks to one.
_ANSI = "regexp_replace({x}, '\\x1b(\\[[^@-~]*[@-~]?|\\][^\\x07\\x1b]*(\\x07|\\x1b\\\\)?|(?s:.))?', '', 'g')"


def _clean(x: str) -> str:
    y = f"regexp_replace({_ANSI.format(x=x)}, '[ \\t\\r]+$', '')"
    indent = f"regexp_extract({y}, '^[ \\t]*')"
    return f"concat({indent}, regexp_replace(substr({y}, length({indent}) + 1), '[ \\t]+', ' ', 'g'))"


_JSON = r"^[ \t\r\n]*\x{FEFF}?(\{[ \t\r\n]*[\"}]|\[[ \t\r\n]*([\]{\[\"]|(true|false|null|-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?)[ \t\r\n]*[,\]]))"


def _compactible(x: str) -> str:
    sample = f"substr({x}, 1, 512)"
    return f"(strlen({x}) > 4096 AND NOT regexp_matches({x}, '{_JSON}') AND length(regexp_replace({sample}, '[^\\x01-\\x08\\x0b\\x0c\\x0e-\\x1a\\x1c-\\x1f]', '', 'g')) * 10 <= length({sample}))"


_LINES = "SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS line_no FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents{where})"
_GENERIC = f"""
raw AS ({_LINES.format(where=" WHERE " + _compactible("text"))}),
c AS (SELECT doc_id, line_no, {_clean("line")} AS line FROM raw),
b AS (SELECT *, sum(CASE WHEN line = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS blanks FROM c),
t AS (SELECT doc_id, line_no, line, count(*) OVER (PARTITION BY doc_id, line) AS n, row_number() OVER (PARTITION BY doc_id, line ORDER BY line_no) AS nth,
      lag(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS was, blanks > coalesce(lag(blanks) OVER (PARTITION BY doc_id ORDER BY line_no), 0) AS fresh FROM b WHERE line <> ''),
h AS (SELECT *, lead(fresh) OVER (PARTITION BY doc_id ORDER BY line_no) AS next_blank FROM t WHERE was IS NULL OR was <> line),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS i FROM h WHERE n < 3 OR nth = 1),
compact AS (SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, line, CAST(n AS BIGINT) AS n, i > 1 AND coalesce(next_blank, false) AS blank_before FROM k)"""
_REPORT = f"""{_GENERIC},
shown AS (SELECT doc_id, CAST(sum(strlen(line) + 1 + CASE WHEN blank_before THEN 1 ELSE 0 END + CASE WHEN n > 1 THEN strlen(concat(' ×', CAST(n AS VARCHAR))) ELSE 0 END) AS BIGINT) AS d FROM compact GROUP BY doc_id),
report AS (SELECT r.doc_id, r.source, CAST(strlen(r.text) AS BIGINT) AS raw_bytes, CAST(coalesce(s.d, strlen(r.text)) AS BIGINT) AS displayed_bytes FROM documents r LEFT JOIN shown s ON s.doc_id = r.doc_id)"""


def _any(column: str, needles) -> str:
    return "(" + " OR ".join("contains({}, '{}')".format(column, n.replace("\t", "' || chr(9) || '")) for n in needles) + ")"


def _signals() -> str:
    from sparkfold.plans.guards import SIGNALS

    return "SELECT doc_id, " + ", ".join(f"{_any('text', v)} AS {k}" for k, v in SIGNALS.items()) + " FROM documents"


_FIRST = "coalesce(nullif(regexp_extract(body, '^\\n*([^\\n]*)', 1), ''), '')"
_ROUTE = f"""
WITH x AS (SELECT concat('d', CAST(doc_id AS VARCHAR)) AS id, text AS body FROM documents UNION ALL SELECT concat('p', CAST(page_id AS VARCHAR)), html FROM pages),
y AS (SELECT id, body, {_FIRST} AS f FROM x)
SELECT id, CASE WHEN strlen(body) >= 16777216 THEN 'passthrough' WHEN regexp_matches(f, '^[* ] [^ ]') AND length(f) >= 3 THEN 'git_branch'
  WHEN regexp_matches(f, '^[0-9A-Fa-f]{{7}} [^ ]+?@\\{{\\d+\\}}: ') THEN 'git_reflog' WHEN starts_with(f, 'diff --git ') THEN 'git_diff'
  WHEN contains(body, 'error TS') OR contains(body, 'Found 0 errors') OR (contains(body, 'Found ') AND contains(body, ' errors in ')) THEN 'tsc'
  WHEN starts_with(f, 'CONTAINER ID') OR (starts_with(f, 'NAME') AND contains(f, 'STATUS') AND (contains(f, 'READY') OR (contains(f, 'IMAGE') AND contains(f, 'SERVICE')))) THEN 'container'
  WHEN regexp_matches(body, '(?m)^[*<>]') THEN 'curl' WHEN {_compactible("body")} THEN 'generic' ELSE 'passthrough' END AS filter_name FROM y"""

_X = "concat('  ' || chr(27) || '[31m', event_type, chr(27) || '[0m ' || chr(9) || ' x  ', CAST(user_id AS VARCHAR), chr(27) || ']0;t' || chr(7) || chr(13))"
_B = "(event_id * user_id * 977)"


def _scaled(power: int, letter: str) -> str:
    t = f"({_B} // {1024**power // 10})"
    return f"concat(CAST({t} // 10 AS VARCHAR), '.', CAST({t} % 10 AS VARCHAR), '{letter}')"


_TEXT = f"""
SELECT event_id, regexp_replace({_X}, '\\x1b\\[[^@-~]*[@-~]?', '', 'g') AS no_csi, {_clean(_X)} AS cleaned, event_type AS trimmed, event_type AS untimed,
  CASE WHEN event_id % 2 = 0 THEN concat('''', event_type, ' it', '''\\''''', 's''') ELSE event_type END AS quoted,
  CASE WHEN {_B} >= 1099511627776 THEN {_scaled(4, "T")} WHEN {_B} >= 1073741824 THEN {_scaled(3, "G")} WHEN {_B} >= 1048576 THEN {_scaled(2, "M")} WHEN {_B} >= 1024 THEN {_scaled(1, "K")} ELSE CAST({_B} AS VARCHAR) END AS size,
  CASE WHEN length(CAST(event_id * 37 AS VARCHAR)) <= 2 THEN CAST(event_id * 37 AS VARCHAR) ELSE rpad(substr(CAST(event_id * 37 AS VARCHAR), 1, 2), CAST(length(CAST(event_id * 37 AS VARCHAR)) AS INTEGER), '0') END AS rounded,
  CASE WHEN event_id % 3 <> 0 THEN concat('v', CAST(user_id AS VARCHAR)) WHEN length(concat('v', CAST(user_id AS VARCHAR))) <= 4 THEN '****' ELSE concat(substr(concat('v', CAST(user_id AS VARCHAR)), 1, 2), '****', right(CAST(user_id AS VARCHAR), 2)) END AS masked,
  concat('/a/', event_type) AS folder, event_type AS name, sha256(event_type) AS sha, to_base64(encode(event_type)) AS b64 FROM events"""

_TIME = "'^\\d{4}-\\d{2}-\\d{2}( \\d{2}:\\d{2}:\\d{2})?[^ \\t]*[ \\t]*'"


def _rle(source: str, mark: str, line: str) -> str:
    return f"""
WITH s AS ({source}), m AS (SELECT capture_id, line_no, {line} AS line FROM s), k AS (SELECT *, {mark} AS mark FROM m),
i AS (SELECT *, CASE WHEN lag(mark) OVER w IS NULL OR lag(mark) OVER w <> mark OR lag(line) OVER w = '' THEN 1 ELSE 0 END AS new FROM k WINDOW w AS (PARTITION BY capture_id ORDER BY line_no)),
g AS (SELECT *, sum(new) OVER (PARTITION BY capture_id ORDER BY line_no) AS island FROM i)
SELECT capture_id, CAST(min(line_no) AS BIGINT) AS line_no, regexp_replace(arg_min(line, line_no), {_TIME}, '') AS line, CAST(count(*) AS BIGINT) AS n FROM g WHERE line <> '' GROUP BY capture_id, island"""


_COMPOSE = "concat(trim(split_part(line, '|', 1)), '| ', regexp_replace(trim(split_part(line, '|', 2)), " + _TIME + ", ''))"

_PREFIX_LAG = """
WITH s AS ({source}), p AS (SELECT capture_id, line_no, line, {value} AS v FROM s WHERE {where}), q AS (SELECT *, lag(v) OVER (PARTITION BY capture_id ORDER BY line_no) AS was FROM p)
SELECT capture_id, line_no, {out} AS line FROM q"""

_USAGE = f"u AS (SELECT row_id, source, command, list_filter(string_split(args, '|'), lambda x: x <> '') AS a FROM ({synthetic.INVOCATIONS}))"
_COVER = "CASE WHEN command IN ({}) THEN 'auto-wrap' WHEN {} THEN 'transparent-runner' WHEN command IN ({}) THEN 'wrapper-only' ELSE 'unlisted' END".format(
    ", ".join(f"'{c}'" for c in catalog.AUTO_WRAP),
    " OR ".join(f"array_to_string(list_concat([command], a), ' ') = '{r}' OR starts_with(array_to_string(list_concat([command], a), ' '), '{r} ')" for r in catalog.RUNNERS),
    ", ".join(f"'{c}'" for c in catalog.WRAPPER),
)



def _literal(x) -> str:
    return "CAST(NULL AS VARCHAR)" if x is None else str(x) if isinstance(x, (bool, int)) else "'" + x.replace("'", "''") + "'"


def _dealt(rows: tuple, select: str, where: str = "true") -> str:
    """The examples dealt to the orders; c0 is the command line, the others what is expected of it."""
    values = ", ".join(f"({k}, {', '.join(map(_literal, r))})" for k, r in enumerate(rows))
    names = ", ".join(f"c{k}" for k in range(len(rows[0])))
    return f"SELECT o_orderkey, {select} FROM orders JOIN (VALUES {values}) AS v(i, {names}) ON v.i = o_orderkey % {len(rows)} WHERE {where}"


_Q = "chr(39)"
_QUOTED = f"array_to_string(list_transform(string_split(c0, ' '), lambda x: CASE WHEN regexp_full_match(x, '[A-Za-z0-9_./:=,+@%-]+') THEN x ELSE concat({_Q}, replace(x, {_Q}, concat({_Q}, chr(92), {_Q}, {_Q})), {_Q}) END), ' ')"
_WRAPPED = f"CASE WHEN regexp_extract(string_split(c0, ' ')[1], '([^/]*)$', 1) IN ({', '.join(map(_literal, catalog.AUTO_WRAP))}) THEN 'short ' ELSE '' END"
_FAMILY = {"git": "git", "cargo": "test-tools", "jest": "test-tools", "go": "test-tools", "ls": "listing", "tree": "listing", "composer": "package", "mypy": "diagnostics", "prettier": "diagnostics", "gh": "infra"}
_CAPTURED = ", ".join(
    f"('{s}', '{_FAMILY[s.split('_')[0]]}', {any(x.name == s and x.odd for x in scripts.SCRIPTS)}, {'--output' in line or '--jq' in line})" for s, line in examples.CAPTURED
)

_EVENT_NO = "row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1"
_LIVE_LOGS = f"""
WITH l AS (SELECT user_id, {_EVENT_NO} AS line_no, {synthetic.LIVE_LOG_MARK} AS mark, epoch_ms(ts) AS ms FROM events),
p AS (SELECT *, lag(mark) OVER w AS was, lag(ms) OVER w AS before FROM l WINDOW w AS (PARTITION BY user_id ORDER BY line_no)),
i AS (SELECT *, sum(CASE WHEN was IS NULL OR was <> mark OR ms - before >= 1800000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY line_no) AS island FROM p)
SELECT user_id AS capture_id, CAST(min(line_no) AS BIGINT) AS line_no, concat(max(mark), CASE WHEN count(*) > 1 THEN concat(' ×', CAST(count(*) AS VARCHAR)) ELSE '' END) AS line FROM i WHERE mark <> '' GROUP BY user_id, island"""

ORACLES = {s.name: scripts.sql(s, True, False) for s in scripts.SCRIPTS} | {
    "generic_compact": f"WITH {_GENERIC} SELECT * FROM compact",
    "reduction_report": f"WITH {_REPORT} SELECT source, count(*) AS captures, CAST(sum(raw_bytes) AS BIGINT) AS raw_bytes, CAST(sum(displayed_bytes) AS BIGINT) AS displayed_bytes, CAST(sum(greatest(0, raw_bytes - displayed_bytes)) AS BIGINT) AS omitted_bytes, CAST(sum(greatest(0, raw_bytes - displayed_bytes)) * 100 // sum(raw_bytes) AS BIGINT) AS saved_percent FROM report GROUP BY source",
    "reduction_gate": f"WITH {_REPORT} SELECT doc_id, raw_bytes, displayed_bytes, (raw_bytes - displayed_bytes) * 100 >= raw_bytes * 10 AS passes FROM report",
    "pipe_signals": _signals(),
    "pipe_route": _ROUTE,
    "text_functions": _TEXT,
    "json_minify": """SELECT event_id, concat('{"id":', CAST(event_id AS VARCHAR), ',"t":"a \\" b","p":', replace(props, ' ', ''), '}', chr(10)) AS minified FROM events""",
    "docker_logs": _rle(synthetic.DOCKER_LOGS, f"regexp_replace(line, {_TIME}, '')", "line"),
    "compose_logs": _rle(synthetic.COMPOSE_LOGS, "line", _COMPOSE),
    "job_transitions": f"WITH s AS ({synthetic.JOBS}), t AS (SELECT *, lag(status) OVER (PARTITION BY capture_id, job ORDER BY line_no) AS was FROM s) SELECT capture_id, line_no, concat(job, ': ', CASE WHEN was IS NULL THEN status ELSE concat(was, '->', status) END) AS change FROM t WHERE was IS NULL OR was <> status",
    "grep_matches": f"""
WITH s AS ({synthetic.GREP}), p AS (SELECT *, split_part(line, ':', 1) AS path FROM s), g AS (SELECT capture_id FROM p GROUP BY capture_id HAVING count(*) >= 20 AND count(DISTINCT path) >= 2),
n AS (SELECT p.*, row_number() OVER (PARTITION BY p.capture_id, path ORDER BY line_no) AS nth, count(*) OVER (PARTITION BY p.capture_id, path) AS c FROM p JOIN g ON g.capture_id = p.capture_id),
o AS (SELECT capture_id, path, nth, line FROM n WHERE nth <= 3 UNION ALL SELECT capture_id, path, 4, concat(path, ': ... ', CAST(c - 3 AS VARCHAR), ' more matches') FROM n WHERE nth = 1 AND c > 3)
SELECT capture_id, CAST(row_number() OVER (PARTITION BY capture_id ORDER BY path, nth) AS BIGINT) AS ord, line FROM o
UNION ALL SELECT capture_id, CAST(line_no AS BIGINT), line FROM s WHERE capture_id NOT IN (SELECT capture_id FROM g)""",
    "find_paths": f"""
WITH s AS ({synthetic.FIND}), p AS (SELECT capture_id, line AS path, CASE WHEN contains(line, '/') THEN regexp_extract(line, '^(.*)/', 1) ELSE '.' END AS parent, regexp_extract(line, '([^/]*)$', 1) AS name FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY capture_id, parent ORDER BY path) AS i, count(*) OVER (PARTITION BY capture_id, parent) AS n FROM p),
g AS (SELECT capture_id, parent, max(n) AS n, max(CASE WHEN i = 1 THEN name END) AS a, max(CASE WHEN i = 2 THEN name END) AS b, max(CASE WHEN i = 3 THEN name END) AS c, max(CASE WHEN i = n THEN name END) AS z FROM r WHERE n >= 3 GROUP BY capture_id, parent)
SELECT capture_id, parent, CAST(0 AS BIGINT) AS ord, concat(parent, '/ (', CAST(n AS VARCHAR), ' entries: ', a, ', ', b, ', ', c, CASE WHEN n > 4 THEN concat('; ', CAST(n - 4 AS VARCHAR), ' omitted; last: ', z, '; --raw for all') WHEN n = 4 THEN concat('; last: ', z) ELSE '' END, ')') AS line FROM g
UNION ALL SELECT capture_id, parent, CAST(i AS BIGINT), path FROM r WHERE n < 3""",
    "du_top": f"""
WITH s AS ({synthetic.DU}), p AS (SELECT capture_id, line_no, regexp_extract(line, '^(\\d+)', 1) AS num, regexp_extract(line, '^\\d+([KM]?)', 1) AS unit, split_part(line, chr(9), 2) AS path FROM s),
b AS (SELECT *, CASE WHEN unit = 'M' THEN 10 * CAST(num AS BIGINT) * 104857 + 10 * CAST(num AS BIGINT) * 6 // 10 ELSE 10 * CAST(num AS BIGINT) * 102 + 10 * CAST(num AS BIGINT) * 4 // 10 END AS bytes FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY bytes DESC, line_no) AS i FROM b),
e AS (SELECT capture_id, min(path) AS lo, max(path) AS hi, count(*) AS c FROM r WHERE i <= 10 GROUP BY capture_id),
f AS (SELECT capture_id, CASE WHEN c > 1 THEN regexp_extract(list_max(list_filter(list_transform(range(0, length(lo) + 1), lambda k: substr(lo, 1, k)), lambda x: starts_with(hi, x))), '^(.*/)', 1) ELSE '' END AS pre FROM e),
g AS (SELECT capture_id, CASE WHEN length(pre) > 2 THEN pre ELSE '' END AS pre FROM f),
z AS (SELECT capture_id, CAST(sum(bytes) AS BIGINT) AS t, count(*) AS n FROM r WHERE i > 10 GROUP BY capture_id),
o AS (SELECT capture_id, 0 AS i, pre AS line FROM g WHERE pre <> ''
  UNION ALL SELECT r.capture_id, i, concat(CASE WHEN length(num) <= 2 THEN num ELSE rpad(substr(num, 1, 2), CAST(length(num) AS INTEGER), '0') END, unit, chr(9), substr(path, length(pre) + 1)) FROM r JOIN g ON g.capture_id = r.capture_id WHERE i <= 10
  UNION ALL SELECT capture_id, 11, concat(CASE WHEN t >= 1099511627776 THEN concat(CAST(t // 109951162777 // 10 AS VARCHAR), '.', CAST(t // 109951162777 % 10 AS VARCHAR), 'T') WHEN t >= 1073741824 THEN concat(CAST(t // 107374182 // 10 AS VARCHAR), '.', CAST(t // 107374182 % 10 AS VARCHAR), 'G') WHEN t >= 1048576 THEN concat(CAST(t // 104857 // 10 AS VARCHAR), '.', CAST(t // 104857 % 10 AS VARCHAR), 'M') ELSE concat(CAST(t // 102 // 10 AS VARCHAR), '.', CAST(t // 102 % 10 AS VARCHAR), 'K') END, chr(9), '(+', CAST(n AS VARCHAR), ')') FROM z)
SELECT capture_id, CAST(row_number() OVER (PARTITION BY capture_id ORDER BY i) - 1 AS BIGINT) AS line_no, line FROM o""",
    "rg_matches": _PREFIX_LAG.format(source=synthetic.GREP, value="split_part(line, ':', 1)", where="true", out="CASE WHEN was = v THEN substr(line, length(v) + 1) ELSE line END"),
    "rg_files": _PREFIX_LAG.format(source=synthetic.FIND, value="regexp_extract(line, '^(.*/)', 1)", where="true", out="CASE WHEN was <> '' AND starts_with(line, was) AND length(line) > length(was) THEN concat(':', substr(line, length(was) + 1)) ELSE line END"),
    "file_slice": """
WITH l AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS line_no, len(l) > 8 AND NOT odd AS long, len(l) AS n FROM
  (SELECT doc_id, string_split(CASE WHEN right(text, 1) = chr(10) THEN left(text, length(text) - 1) ELSE text END, chr(10)) AS l, regexp_matches(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]') AS odd FROM documents WHERE text <> ''))
SELECT doc_id, CAST(CASE WHEN long AND line_no >= n - 3 THEN line_no - n + 8 ELSE line_no END AS INTEGER) AS line_no, line FROM l WHERE NOT long OR line_no < 4 OR line_no >= n - 3
UNION ALL SELECT doc_id, 4, concat('... ', CAST(n - 7 AS VARCHAR), ' lines omitted ...') FROM l WHERE long AND line_no = 4""",
    "git_status_short": _PREFIX_LAG.format(source=synthetic.STATUS_SHORT, value="CASE WHEN starts_with(line, 'R') THEN '' ELSE regexp_extract(line, '^(.*/)', 1) END", where="true", out="CASE WHEN was <> '' AND was = v THEN concat(substr(line, 1, 3), substr(line, length(v) + 1)) ELSE line END"),
    "git_reflog": _PREFIX_LAG.format(source=synthetic.REFLOG, value="regexp_extract(line, '^([0-9a-f]{7}) [^ ]+@', 1)", where="true",
        out="CASE WHEN v = '' THEN line ELSE concat(CASE WHEN was = v THEN '~' ELSE v END, ' ', CASE WHEN contains(line, ' HEAD@') THEN '' ELSE 'main' END, '@', regexp_extract(line, '@\\{(\\d+)\\}', 1), ' ', regexp_extract(line, '\\}: (.*)$', 1)) END"),
    "git_branches": f"""
WITH s AS ({synthetic.BRANCHES}), b AS (SELECT capture_id, line_no, line, replace(substr(line, 3), 'remotes/origin/', '') AS name, contains(line, 'remotes/') AS far FROM s)
SELECT capture_id, line_no, CASE WHEN NOT far AND EXISTS (SELECT 1 FROM b r WHERE r.far AND r.capture_id = b.capture_id AND r.name = b.name) THEN concat(line, ' =o') ELSE line END AS line FROM b
WHERE NOT far OR NOT EXISTS (SELECT 1 FROM b l WHERE NOT l.far AND l.capture_id = b.capture_id AND l.name = b.name)""",
    "tsc_errors": f"""
WITH s AS ({synthetic.TSC}), l AS (SELECT * FROM s WHERE line <> ''), d AS (SELECT capture_id, line_no, split_part(line, ' - error ', 1) AS place, split_part(line, ' - error ', 2) AS rest FROM l WHERE contains(line, ' - error TS')),
e AS (SELECT *, split_part(rest, ': ', 1) AS code, substr(rest, length(split_part(rest, ': ', 1)) + 3) AS message FROM d),
w AS (SELECT *, count(*) OVER p AS n, min(line_no) OVER p AS first, row_number() OVER (PARTITION BY capture_id, code ORDER BY line_no) AS nth, min(substr(message, 1, 40)) OVER p = max(substr(message, 1, 40)) OVER p AS alike FROM e WINDOW p AS (PARTITION BY capture_id, code)),
g AS (SELECT capture_id, code, n, first, max(CASE WHEN nth = 1 THEN place END) AS a, max(CASE WHEN nth = 2 THEN place END) AS b, max(CASE WHEN nth = 3 THEN place END) AS c, max(CASE WHEN nth = 1 THEN message END) AS m FROM w WHERE n >= 3 AND alike GROUP BY capture_id, code, n, first)
SELECT capture_id, CAST(first AS BIGINT) AS ord, CAST(0 AS BIGINT) AS sub, concat(code, ' x', CAST(n AS VARCHAR), ': ', a, ', ', b, ', ', c, CASE WHEN n > 3 THEN concat(', ... (', CAST(n - 3 AS VARCHAR), ' more)') ELSE '' END) AS line FROM g
UNION ALL SELECT capture_id, first, 1, m FROM g
UNION ALL SELECT capture_id, first, line_no, concat(place, ' ', rest) FROM w WHERE n < 3 OR NOT alike
UNION ALL SELECT capture_id, 1099511627776, line_no, line FROM l WHERE NOT contains(line, ' - error TS') AND capture_id >= 0
UNION ALL SELECT -1, 0, 0, 'no type errors'""",
    "kubectl_pods": f"""
WITH s AS ({synthetic.KUBECTL}), f AS (SELECT capture_id, line_no, trim(substr(line, 1, 20)) AS name, substr(line, 21, 3) AS ready, split_part(trim(substr(line, 29)), ' ', 1) AS status FROM s WHERE line_no > 0),
h AS (SELECT *, status = 'Running' AND ready = '1/1' AS well FROM f), g AS (SELECT capture_id, count(*) AS n, sum(CASE WHEN well THEN 1 ELSE 0 END) AS up FROM h GROUP BY capture_id)
SELECT h.capture_id, CAST(0 AS BIGINT) AS line_no, concat('k', CAST(max(n) AS VARCHAR), CASE WHEN max(up) = 0 THEN 'n' WHEN max(up) = max(n) THEN 'r' ELSE 'm' END,
  string_agg(concat(' ', name, CASE WHEN up = n THEN '' ELSE concat('(', ready, CASE WHEN well THEN '' ELSE concat(',', status) END, ')') END), '' ORDER BY line_no)) AS line FROM h JOIN g ON g.capture_id = h.capture_id GROUP BY h.capture_id
UNION ALL SELECT DISTINCT capture_id, 0, 'k0n' FROM s WHERE capture_id NOT IN (SELECT capture_id FROM g)""",
    "gh_checks": f"""
WITH s AS ({synthetic.CHECKS}), t AS (SELECT *, split_part(line, chr(9), 2) AS state FROM s), bad AS (SELECT DISTINCT capture_id FROM t WHERE state = 'strange'), ok AS (SELECT * FROM t WHERE capture_id NOT IN (SELECT capture_id FROM bad)),
c AS (SELECT capture_id, state, count(*) AS n, min(line_no) AS first FROM ok GROUP BY capture_id, state)
SELECT capture_id, CAST(-1 AS BIGINT) AS ord, concat(CAST(sum(n) AS VARCHAR), ' checks: ', string_agg(concat(CAST(n AS VARCHAR), ' ', state), ', ' ORDER BY first)) AS line FROM c GROUP BY capture_id
UNION ALL SELECT capture_id, line_no, line FROM ok WHERE state <> 'pass' UNION ALL SELECT capture_id, line_no, line FROM t WHERE capture_id IN (SELECT capture_id FROM bad)""",
    "pip_table": f"WITH s AS ({synthetic.PIP}), t AS (SELECT capture_id, line_no, trim(regexp_replace(line, '[ \\t]+', ' ', 'g')) AS line FROM s) SELECT * FROM t WHERE line <> '' AND NOT starts_with(line, 'Package ') AND NOT starts_with(line, '---')",
    "columnar_rows": f"""
WITH s AS ({synthetic.COLUMNS}), f AS (SELECT capture_id, line_no, line, CASE WHEN contains(line, '  ') THEN line END AS v, regexp_extract(line, '^root  (\\d)', 1) AS b, regexp_extract(line, '(zone \\d)', 1) AS c, regexp_extract(line, '(x\\d)$', 1) AS d FROM s),
w AS (SELECT *, lag(v) OVER p AS pv, lag(b) OVER p AS pb, lag(c) OVER p AS pc, lag(d) OVER p AS pd FROM f WINDOW p AS (PARTITION BY capture_id ORDER BY line_no)),
i AS (SELECT *, sum(CASE WHEN v IS NOT NULL AND pv IS NOT NULL AND v = pv THEN 0 ELSE 1 END) OVER (PARTITION BY capture_id ORDER BY line_no) AS island,
  CASE WHEN v IS NULL THEN line ELSE concat(CASE WHEN pv IS NOT NULL THEN '~' ELSE 'root' END, ' ', CASE WHEN pv IS NOT NULL AND pb = b THEN '~' ELSE b END, ' ', CASE WHEN pv IS NOT NULL AND pc = c THEN '~' ELSE c END, ' ', CASE WHEN pv IS NOT NULL AND pd = d THEN '~' ELSE concat('cmd ', d) END) END AS out FROM w)
SELECT capture_id, min(line_no) AS line_no, arg_min(out, line_no) AS line, CAST(count(*) - 1 AS BIGINT) AS repeats FROM i GROUP BY capture_id, island""",
    "usage_commands": f"WITH {_USAGE}, c AS (SELECT command, {_COVER} AS cover FROM u) SELECT command, count(*) AS n, CASE WHEN min(cover) = max(cover) THEN min(cover) ELSE 'mixed' END AS coverage FROM c GROUP BY command",
    "usage_git": f"""WITH u AS (SELECT * FROM ({synthetic.INVOCATIONS}) WHERE command = 'git'), s AS (SELECT CASE args WHEN '-C|repo|status' THEN 'status' WHEN 'log|-3' THEN 'log' WHEN '--no-pager|bisect' THEN 'bisect' END AS subcommand FROM u)
SELECT subcommand, count(*) AS n, CASE WHEN subcommand IN ({", ".join(f"'{c}'" for c in catalog.GIT_SUBCOMMANDS)}) THEN 'catalogued' ELSE 'unlisted' END AS coverage FROM s WHERE subcommand IS NOT NULL GROUP BY subcommand""",
    "usage_effective": f"SELECT CASE WHEN args = 'run|pytest|-q' THEN 'pytest' ELSE command END AS command, CASE WHEN args = 'run|pytest|-q' THEN 'uv run' ELSE '' END AS chain, count(*) AS n FROM ({synthetic.INVOCATIONS}) GROUP BY 1, 2",
    "usage_sources": f"SELECT source, count(*) AS n FROM ({synthetic.INVOCATIONS}) GROUP BY source",
    "plugin_routes": f"SELECT row_id, CASE WHEN command = 'git' THEN 'team' WHEN command = 'uv' THEN 'uv' ELSE 'tests' END AS plugin, CASE WHEN command = 'git' THEN 'project' ELSE 'user' END AS scope FROM ({synthetic.INVOCATIONS}) WHERE command IN ('git', 'uv', 'pytest')",
    "catalog_audit": "SELECT command, gap FROM (VALUES ('poetry', 'not catalogued'), ('npx', 'not catalogued')) AS t(command, gap)",
    "parity_check": """
WITH x AS (SELECT doc_id AS case_id, text AS body FROM documents), y AS (SELECT case_id, CASE WHEN case_id % 5 = 0 THEN replace(body, 'e', 'E') ELSE body END AS body FROM x)
SELECT coalesce(x.case_id, y.case_id) AS case_id, CASE WHEN y.body IS NULL THEN 'only in baseline' WHEN x.body IS NULL THEN 'only in candidate' WHEN x.body = y.body THEN 'equal' ELSE 'differs' END AS verdict,
  CASE WHEN x.body <> y.body THEN CAST(strpos(x.body, 'e') AS BIGINT) END AS first_difference FROM x FULL OUTER JOIN y ON x.case_id = y.case_id""",
    "guard_fall_open": """
WITH c AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE o_orderpriority END AS o, CASE WHEN o_orderkey % 4 = 0 THEN 'warn' ELSE '' END AS e FROM orders),
r AS (SELECT *, k % 7 = 0 OR k % 11 = 0 OR (k % 3 <> 0 AND k % 2 = 0 AND o <> substr(o, 1, 3)) AS raw FROM c)
SELECT k AS capture_id, CASE WHEN raw THEN 'passthrough' ELSE 'short' END AS filter_name, CASE WHEN raw THEN 'ByteExact' WHEN k % 2 = 0 THEN 'PotentiallyLossy' ELSE 'FactComplete' END AS evidence,
  CASE WHEN o = '' AND e = '' THEN concat('(CMD exited ', CAST(k % 3 AS VARCHAR), ' with no output)') WHEN raw THEN o ELSE substr(o, 1, 3) END AS shown_stdout, e AS shown_stderr FROM r""",
    "tool_lines": f"""
WITH s AS ({synthetic.TOOL_LINES}), k(tool, kept) AS (VALUES ('ctest', ['1/2 Test #1: a .... 50%', 'x.cs(1,2): error CS0103: gone']), ('cmake', ['-- Configuring done', '[ 50%] Building', 'x.cs(1,2): error CS0103: gone', '    3 Warning(s)']), ('swift', ['Executed 4 tests']),
  ('uv', ['Resolved 12 packages', '+ left==1', '-- Configuring done']), ('dotnet', ['x.cs(1,2): error CS0103: gone', '    3 Warning(s)']), ('plan', ['Plan: 1 to add', '# a.b will be created'])),
c AS (SELECT DISTINCT capture_id FROM s),
j AS (SELECT c.capture_id, k.tool, string_agg(concat(s.line, chr(10)), '' ORDER BY s.line_no) AS b FROM c CROSS JOIN k LEFT JOIN s ON s.capture_id = c.capture_id AND list_contains(k.kept, s.line) GROUP BY c.capture_id, k.tool)
SELECT capture_id, tool, coalesce(b, CASE tool WHEN 'swift' THEN concat('ok', chr(10)) WHEN 'plan' THEN concat('plan ok', chr(10)) ELSE '' END) AS body FROM j""",
    "buildkit_steps": f"""
WITH s AS ({synthetic.BUILDKIT}), g AS (SELECT capture_id, count(DISTINCT CASE WHEN line LIKE '%DONE%' THEN split_part(line, ' ', 1) END) AS n, arg_max(replace(replace(line, '#9 naming to ', ''), ' done', ''), line_no) FILTER (WHERE line LIKE '%naming%') AS image, bool_and(starts_with(line, '#')) AS ok FROM s GROUP BY capture_id)
SELECT capture_id, concat('BuildKit: ', CAST(n AS VARCHAR), ' steps completed', CASE WHEN image IS NULL THEN '' ELSE concat(chr(10), 'image: ', image) END) AS line FROM g WHERE ok AND n > 0""",
    "live_transitions": """
WITH s AS (SELECT user_id % 25 AS capture_id, event_id AS line_no, concat('job-', CAST(event_id % 4 AS VARCHAR)) AS job, CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'purchase' THEN 'passed' ELSE 'running' END AS status FROM events),
t AS (SELECT *, lag(status) OVER (PARTITION BY capture_id, job ORDER BY line_no) AS was FROM s)
SELECT capture_id, line_no, concat(job, ': ', CASE WHEN was IS NULL THEN status ELSE concat(was, '->', status) END) AS change FROM t WHERE was IS NULL OR was <> status""",
    "docker_ps": """
WITH s AS (SELECT s_nationkey AS k, s_suppkey AS i, (s_suppkey + s_nationkey) % 3 <> 0 AS up FROM supplier)
SELECT k AS capture_id, CAST(0 AS BIGINT) AS line_no, concat('d', CAST(count(*) AS VARCHAR), CASE WHEN sum(CASE WHEN up THEN 1 ELSE 0 END) = 0 THEN 'none' WHEN bool_and(up) THEN 'up' ELSE 'm' END, string_agg(concat(' web-', CAST(i AS VARCHAR)), '' ORDER BY i)) AS line FROM s GROUP BY k
UNION ALL SELECT n, 0, 'd0none' FROM (SELECT n_nationkey AS n FROM nation UNION ALL SELECT -1) WHERE n NOT IN (SELECT k FROM s)""",
    "shell_chains": """
SELECT event_id, CAST(CASE event_id % 5 WHEN 0 THEN 3 WHEN 1 THEN 3 WHEN 3 THEN 2 WHEN 4 THEN 1 END AS BIGINT) AS n,
  CASE event_id % 5 WHEN 0 THEN concat('run ', event_type, '  /  echo "a;b"  /  cat') WHEN 1 THEN concat('run ', event_type, ' 2>&1 /  ls  / ') WHEN 3 THEN concat('run ', event_type, '  /  true') WHEN 4 THEN concat('run ', event_type) END AS parts FROM events""",
    "docker_images": """
WITH s AS (SELECT s_nationkey AS k, s_suppkey AS i, s_suppkey % 5 = 0 AS bare, row_number() OVER (PARTITION BY s_nationkey, s_suppkey % 5 = 0 ORDER BY s_suppkey) AS r FROM supplier),
g AS (SELECT k, count(*) AS n, sum(CASE WHEN bare THEN 1 ELSE 0 END) AS d, string_agg(CASE WHEN NOT bare AND r <= 8 THEN concat(' r', CAST(i AS VARCHAR), ':1.0(', CAST(i % 9 AS VARCHAR), 'MB)') END, '' ORDER BY i) AS s FROM s GROUP BY k)
SELECT k AS capture_id, CAST(0 AS BIGINT) AS line_no, concat('images ', CAST(n AS VARCHAR), ':', s, CASE WHEN d > 0 THEN concat(' dangling x', CAST(d AS VARCHAR)) ELSE '' END, CASE WHEN n - d > 8 THEN concat(' (+', CAST(n - d - 8 AS VARCHAR), ')') ELSE '' END) AS line FROM g
UNION ALL SELECT n, 0, 'images 0' FROM (SELECT n_nationkey AS n FROM nation UNION ALL SELECT -1) WHERE n NOT IN (SELECT k FROM s)""",
    "grid_rows": "WITH x AS (SELECT *, row_number() OVER w - 1 AS i, min(n_nationkey) OVER (PARTITION BY n_regionkey) AS lo, max(n_nationkey) OVER (PARTITION BY n_regionkey) AS hi FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey)) SELECT n_regionkey AS capture_id, CAST(i AS BIGINT) AS line_no, concat(CAST(n_nationkey AS VARCHAR), chr(9), n_name) AS line FROM x WHERE n_nationkey NOT IN (lo, hi) AND n_regionkey NOT IN (SELECT n_regionkey FROM x WHERE n_regionkey = 3 AND n_nationkey NOT IN (lo, hi) AND n_nationkey % 2 = 0) AND n_regionkey IN (SELECT n_regionkey FROM nation GROUP BY 1 HAVING count(*) >= 4)",
    "command_policy": _dealt(examples.LINES, "c2 AS asked"),
    "command_forms": _dealt(examples.LINES, "c1 AS form"),
    "command_streams": _dealt(examples.LINES, "c3 AS decision"),
    "runner_commands": _dealt(examples.RUNS, "c1 AS command, c2 AS chain"),
    "command_words": _dealt(examples.TEXTS, "c1 AS words, c2 AS read_only"),
    "command_programs": f"""SELECT o_orderkey, CAST(unnest(range(len(p))) AS BIGINT) AS ord, unnest(p) AS program FROM ({_dealt(examples.TEXTS, "string_split(c3, '/') AS p", "c3 IS NOT NULL")})""",
    "command_rewrites": _dealt(examples.LINES, f"concat({_WRAPPED}, {_QUOTED}) AS rewritten"),
    "session_commands": "SELECT event_id, concat('run ', event_type) AS command FROM events WHERE event_id % 4 < 3",
    "session_database": "SELECT conv_id, turn, concat('echo ', CAST(conv_id AS VARCHAR), ' ', CAST(length(text) AS VARCHAR)) AS command FROM conversations WHERE role = 'user'",
    "plugin_forms": "SELECT o_orderkey, CASE WHEN o_orderkey % 8 < 2 THEN 'ok' ELSE concat('order ', CAST(o_orderkey AS VARCHAR), ' of a long text') END AS out_stdout, CASE o_orderkey % 8 WHEN 0 THEN 'good' WHEN 1 THEN 'facts' END AS plugin_id, CASE o_orderkey % 8 WHEN 0 THEN 'PotentiallyLossy' WHEN 1 THEN 'FactComplete' ELSE 'ByteExact' END AS evidence FROM orders",
    "plugin_dispositions": """
WITH k AS (SELECT o_orderkey, o_orderkey % 5 AS p, o_orderkey % 3 <> 0 AS matched FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'core-route' WHEN matched AND o_orderkey % 2 = 0 AND p = 2 THEN 'repo-unapproved' WHEN p = 3 THEN 'invalid-config' WHEN p = 4 THEN 'ambiguous' WHEN NOT matched THEN 'no-match'
  WHEN o_orderkey % 13 = 0 THEN 'invalid-config' WHEN o_orderkey % 17 = 0 THEN 'untrusted' WHEN o_orderkey % 4 = 0 AND o_orderkey % 7 = 0 THEN 'integrity-mismatch' ELSE 'active' END AS disposition FROM k""",
    "routed_captures": f"""
WITH v(script, family, odd, blocked) AS (VALUES {_CAPTURED}), c AS (SELECT DISTINCT o_custkey AS k FROM orders)
SELECT script, CASE WHEN blocked OR (odd AND k % 7 = 3) THEN 'passthrough' ELSE family END AS filter_name, count(*) AS captures FROM v CROSS JOIN c GROUP BY 1, 2""",
    "live_lines": f"""
WITH l AS (SELECT user_id, {_EVENT_NO} AS line_no, {synthetic.LIVE_LINE} AS line, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id AS capture_id, CAST(line_no AS BIGINT) AS line_no, line FROM l WHERE line_no + 1 < n OR user_id % 3 = 0""",
    "live_logs": _LIVE_LOGS,
    "live_types": f"""
WITH l AS (SELECT user_id, {_EVENT_NO} AS line_no, event_id, event_type AS t FROM events),
s AS (SELECT *, coalesce(last_value(CASE t WHEN 'view' THEN true WHEN 'error' THEN false WHEN 'click' THEN false END IGNORE NULLS) OVER w, false) AS clean,
  coalesce(last_value(CASE t WHEN 'error' THEN true WHEN 'view' THEN false WHEN 'click' THEN false END IGNORE NULLS) OVER w, false) AS detail
  FROM l WINDOW w AS (PARTITION BY user_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT user_id AS capture_id, CAST(line_no AS BIGINT) AS line_no, CASE t WHEN 'error' THEN concat('src/f', CAST(event_id AS VARCHAR), '.ts:1:1 TS2: x') WHEN 'view' THEN 'clean (0 errors)' WHEN 'click' THEN 'Found 1 error. Watching for file changes.'
  WHEN 'signup' THEN '' ELSE 'File change detected. Starting incremental compilation...' END AS line FROM s WHERE t IN ('error', 'click') OR (t = 'view' AND NOT clean) OR (t NOT IN ('error', 'click', 'view') AND detail)""",
    "live_frames": f"""
WITH l AS (SELECT user_id, {_EVENT_NO} AS k, event_type AS t FROM events), d AS (SELECT *, lag(t) OVER (PARTITION BY user_id ORDER BY k) AS was FROM l)
SELECT user_id AS capture_id, CAST(2 * k + 1 AS BIGINT) AS line_no, unnest(CASE WHEN t = 'view' THEN ['all tests passed'] ELSE [concat('FAIL t-', t), 'Tests: 1 failed'] END) AS line FROM d WHERE was IS NULL OR was <> t""",
    "live_bytes": f"""SELECT (SELECT CAST(sum(strlen({synthetic.LIVE_LOG})) AS BIGINT) FROM events) AS bytes_in, (SELECT CAST(sum(strlen(line)) AS BIGINT) FROM ({_LIVE_LOGS})) AS bytes_shown""",
    "registered_captures": "\nUNION ALL ".join(
        f"SELECT CAST({k} AS BIGINT) AS case_no, capture_id, line_no, line FROM ({scripts.sql(next(x for x in scripts.SCRIPTS if x.name == name), shown, False)})" for k, (name, _, _, shown) in enumerate(examples.REGISTERED)
    ),
    "usage_effective_records": f"""
WITH u AS (SELECT CASE WHEN args = 'run|pytest|-q' THEN 'pytest' ELSE command END AS command, CASE WHEN args = 'run|pytest|-q' THEN 'uv run' ELSE '' END AS chain, command AS typed, args FROM ({synthetic.INVOCATIONS})),
r AS (SELECT *, CASE WHEN chain <> '' THEN 'transparent-runner' WHEN command IN ('git', 'pytest', 'cargo') THEN 'auto-wrap' WHEN command = 'node' THEN 'wrapper-only' ELSE 'unlisted' END AS route, CASE WHEN command IN ('git', 'pytest', 'cargo', 'node') THEN 'catalogued-route' ELSE 'not-catalogued' END AS compaction,
  command = 'pytest' OR (command = 'git' AND args IN ('log|-3')) OR (command = 'cargo' AND args = 'build') AS taken FROM u)
SELECT command, count(*) AS n, CASE WHEN min(route) = max(route) THEN min(route) ELSE 'mixed' END AS routing_coverage, CASE WHEN min(compaction) = max(compaction) THEN min(compaction) ELSE 'mixed' END AS compaction_coverage,
  CAST(sum(CASE WHEN taken THEN 1 ELSE 0 END) AS BIGINT) AS dispatchable, CASE WHEN max(chain) = '' THEN '' ELSE concat('uv run x', CAST(sum(CASE WHEN chain <> '' THEN 1 ELSE 0 END) AS VARCHAR)) END AS chains FROM r GROUP BY command""",
    "usage_chains": f"SELECT 'uv run' AS chain, count(*) AS n, count(*) AS dispatchable FROM ({synthetic.INVOCATIONS}) WHERE args = 'run|pytest|-q' HAVING count(*) > 0",
    "usage_totals": f"""WITH t AS (SELECT source, CASE WHEN command = 'nano' THEN 1 ELSE 0 END AS x FROM ({synthetic.INVOCATIONS}))
SELECT concat('{{"n":', CAST(count(*) AS VARCHAR), CASE WHEN source IS NULL THEN '' ELSE concat(',"source":"', source, '"') END, ',"unlisted":', CAST(sum(x) AS VARCHAR), '}}') AS json FROM t GROUP BY ROLLUP (source)""",
    "text_places": """
WITH x AS (SELECT *, concat('C:/src/', event_type, '.rs:', CAST(event_id AS VARCHAR), CASE WHEN event_id % 2 = 0 THEN ':7' ELSE '' END, ': error: 3 files') AS line FROM events)
SELECT event_id, CAST(3 AS BIGINT) AS first_s, CAST(length(line) - 1 AS BIGINT) AS last_s, concat('rest ', chr(27), '[1mof', chr(27), '[0m ', chr(27), 'it') AS after, concat(event_type, chr(10), CAST(user_id AS VARCHAR), chr(10), 'rest of it') AS stripped, concat('C:/src/', event_type, '.rs') AS path,
  concat(CAST(event_id AS VARCHAR), CASE WHEN event_id % 2 = 0 THEN ':7' ELSE '' END) AS place, CAST(event_id AS VARCHAR) AS number, '3' AS files, starts_with(CAST(event_id AS VARCHAR), '1') AS is_on, event_id % 2 = 0 AS is_off FROM x""",
}
