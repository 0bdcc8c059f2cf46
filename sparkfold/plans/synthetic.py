"""Captures built from the tables, in SQL that Spark and other engines read alike: (capture_id, line_no, line).

No table holds command output, so these stand in for it: each gives the lines that a command would have printed about
rows of the tables. Numbers are whole and text is ASCII, so that every engine builds the same bytes.
"""

DOCKER_LOGS = """
SELECT user_id % 40 AS capture_id, CAST(row_number() OVER (PARTITION BY user_id % 40 ORDER BY event_id) - 1 AS BIGINT) AS line_no,
       CASE WHEN event_id % 17 = 0 THEN '' ELSE concat('2024-01-0', cast(1 + event_id % 9 AS VARCHAR(9)), 'T10:00:00.', cast(event_id % 1000 AS VARCHAR(9)), 'Z ', CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END, ' ', event_type) END AS line
FROM events"""

COMPOSE_LOGS = """
SELECT user_id % 40 AS capture_id, CAST(row_number() OVER (PARTITION BY user_id % 40 ORDER BY event_id) - 1 AS BIGINT) AS line_no,
       concat('web-', cast(event_id % 2 AS VARCHAR(9)), '   | 2024-01-01 10:00:0', cast(event_id % 10 AS VARCHAR(9)), ' ', event_type) AS line
FROM events"""

GREP = """
SELECT doc_id % 25 AS capture_id, CAST(row_number() OVER (PARTITION BY doc_id % 25 ORDER BY doc_id) - 1 AS BIGINT) AS line_no,
       concat(lang, '/', source, '.txt:', cast(doc_id AS VARCHAR(20)), ':n', cast(n_chars AS VARCHAR(20))) AS line
FROM documents"""

FIND = """
SELECT p_size % 10 AS capture_id, CAST(row_number() OVER (PARTITION BY p_size % 10 ORDER BY p_partkey) - 1 AS BIGINT) AS line_no,
       CASE WHEN p_partkey % 29 = 0 THEN concat('top', cast(p_partkey AS VARCHAR(20))) ELSE concat('./', replace(p_brand, '#', ''), '/', replace(p_type, ' ', '_'), '/p', cast(p_partkey AS VARCHAR(20)), '.txt') END AS line
FROM part"""

DU = """
SELECT CAST(floor(doc_id / 40) AS BIGINT) AS capture_id, CAST(row_number() OVER (PARTITION BY floor(doc_id / 40) ORDER BY doc_id) - 1 AS BIGINT) AS line_no,
       concat(cast(n_chars AS VARCHAR(20)), CASE WHEN doc_id % 3 = 0 THEN 'K' WHEN doc_id % 3 = 1 THEN '' ELSE 'M' END, chr(9), '/data/', source, '/', lang, cast(doc_id AS VARCHAR(20))) AS line
FROM documents"""

STATUS_SHORT = """
SELECT p_size % 10 AS capture_id, CAST(row_number() OVER (PARTITION BY p_size % 10 ORDER BY p_brand, p_partkey) - 1 AS BIGINT) AS line_no,
       concat(CASE WHEN p_partkey % 31 = 0 THEN 'R ' WHEN p_partkey % 4 = 0 THEN '??' ELSE ' M' END, ' ', replace(p_brand, '#', ''), '/p', cast(p_partkey AS VARCHAR(20)), '.rs') AS line
FROM part"""

REFLOG = """
SELECT o_custkey % 20 AS capture_id, CAST(row_number() OVER (PARTITION BY o_custkey % 20 ORDER BY o_orderkey) - 1 AS BIGINT) AS line_no,
       CASE WHEN o_orderkey % 41 = 0 THEN 'not a reflog line' ELSE concat(substr(md5(cast((o_orderkey - o_orderkey % 64) AS VARCHAR(20))), 1, 7), CASE WHEN o_orderkey % 5 = 0 THEN ' main@{' ELSE ' HEAD@{' END, cast(o_orderkey % 100 AS VARCHAR(20)), '}: commit: order ', cast(o_orderkey AS VARCHAR(20))) END AS line
FROM orders"""

BRANCHES = """
SELECT s_suppkey % 5 AS capture_id, CAST(row_number() OVER (PARTITION BY s_suppkey % 5 ORDER BY s_suppkey) - 1 AS BIGINT) AS line_no,
       concat(CASE WHEN s_suppkey % 50 = 1 THEN '* ' ELSE '  ' END, CASE WHEN s_suppkey % 3 = 0 THEN 'remotes/origin/' ELSE '' END, 'b', cast((s_suppkey - s_suppkey % 3) AS VARCHAR(20)), CASE WHEN s_suppkey % 3 = 2 THEN 'x' ELSE '' END) AS line
FROM supplier"""

_TSC_LINE = """CASE WHEN l_orderkey % 97 = 0 THEN 'error TS18003 no inputs' WHEN l_orderkey % 89 = 0 THEN '' ELSE
       concat('src/f', cast(l_partkey AS VARCHAR(20)), '.ts:', cast(l_linenumber AS VARCHAR(9)), ':1 - error TS', cast((2000 + l_suppkey % 7 * 10 + l_linenumber) AS VARCHAR(9)), ': Cannot find name flag ', CASE WHEN l_linenumber = 2 THEN l_returnflag ELSE 'X' END, ' in this scope of the module') END"""

TSC = f"""
SELECT l_suppkey % 20 AS capture_id, CAST(row_number() OVER (PARTITION BY l_suppkey % 20 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS BIGINT) AS line_no,
       {_TSC_LINE} AS line
FROM lineitem
UNION ALL SELECT -1, 0, 'Starting compilation' FROM region WHERE r_regionkey = 0"""

#: The same lines with the columns whose order numbers them, so that no window has to.
TSC_ROWS = f"""
SELECT l_suppkey % 20 AS capture_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
       {_TSC_LINE} AS line
FROM lineitem
UNION ALL SELECT -1, 0, 0, 0, 0, 0, 'Starting compilation' FROM region WHERE r_regionkey = 0"""

KUBECTL = """
SELECT n_nationkey AS capture_id, CAST(0 AS BIGINT) AS line_no, concat(rpad('NAME', 20, ' '), 'READY   STATUS    RESTARTS   AGE') AS line FROM (SELECT n_nationkey FROM nation UNION ALL SELECT -1) AS n
UNION ALL SELECT s_nationkey AS capture_id, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS BIGINT) AS line_no,
       concat(rpad(concat('pod-', cast(s_suppkey AS VARCHAR(20))), 20, ' '), CASE WHEN s_suppkey % 7 = 0 THEN '0/1' ELSE '1/1' END, '     ', CASE WHEN s_suppkey % 11 = 0 THEN 'Pending' ELSE 'Running' END, '   0          5d') AS line
FROM supplier"""

CHECKS = """
SELECT o_custkey % 30 AS capture_id, CAST(row_number() OVER (PARTITION BY o_custkey % 30 ORDER BY o_orderkey) - 1 AS BIGINT) AS line_no,
       concat('job-', cast(o_orderkey AS VARCHAR(20)), chr(9), CASE WHEN o_custkey % 30 = 7 AND o_orderkey % 50 = 1 THEN 'strange' WHEN o_orderstatus = 'F' THEN 'pass' WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'fail' END, chr(9), '1m', chr(9), 'https://ci/', cast(o_orderkey AS VARCHAR(20))) AS line
FROM orders"""

PIP = """
SELECT p_size % 10 AS capture_id, p_partkey AS line_no,
       CASE WHEN p_partkey % 50 = 0 THEN 'Package    Version' WHEN p_partkey % 50 = 1 THEN '---------- -------' WHEN p_partkey % 50 = 2 THEN '  ' ELSE concat(replace(p_brand, '#', '-'), '      1.', cast(p_size AS VARCHAR(9)), chr(9), '  ') END AS line
FROM part"""

COLUMNS = """
SELECT s_nationkey AS capture_id, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS BIGINT) AS line_no,
       CASE WHEN s_suppkey % 13 = 0 THEN 'one line' ELSE concat('root  ', cast(s_suppkey % 3 AS VARCHAR(9)), '   zone ', cast(s_nationkey % 4 AS VARCHAR(9)), '  cmd /usr/bin/x', cast(s_suppkey % 2 AS VARCHAR(9))) END AS line
FROM supplier"""

JOBS = """
SELECT user_id % 25 AS capture_id, CAST(row_number() OVER (PARTITION BY user_id % 25 ORDER BY event_id) - 1 AS BIGINT) AS line_no,
       concat('job-', cast(event_id % 4 AS VARCHAR(9))) AS job, CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'purchase' THEN 'passed' ELSE 'running' END AS status
FROM events"""

INVOCATIONS = """
SELECT event_id AS row_id, concat('src', cast(user_id % 3 AS VARCHAR(9))) AS source,
       CASE event_type WHEN 'view' THEN 'git' WHEN 'click' THEN (CASE WHEN event_id % 3 = 0 THEN 'uv' ELSE 'pytest' END) WHEN 'signup' THEN 'nano' WHEN 'purchase' THEN 'node' ELSE 'cargo' END AS command,
       CASE event_type WHEN 'view' THEN (CASE event_id % 4 WHEN 0 THEN '-C|repo|status' WHEN 1 THEN 'log|-3' WHEN 2 THEN '--no-pager|bisect' ELSE '' END) WHEN 'click' THEN (CASE WHEN event_id % 3 = 0 THEN 'run|pytest|-q' ELSE '-q' END) ELSE 'build' END AS args
FROM events"""

_TOOL_LINE = """CASE l_partkey % 12 WHEN 0 THEN 'Plan: 1 to add' WHEN 1 THEN '-- Configuring done' WHEN 2 THEN '[ 50%] Building' WHEN 3 THEN 'x.cs(1,2): error CS0103: gone' WHEN 4 THEN '    3 Warning(s)' WHEN 5 THEN 'Resolved 12 packages' WHEN 6 THEN '+ left==1'
         WHEN 7 THEN 'Executed 4 tests' WHEN 8 THEN '# a.b will be created' WHEN 9 THEN '1/2 Test #1: a .... 50%' WHEN 10 THEN '' ELSE concat('chatter ', CAST(l_linenumber AS VARCHAR(9))) END"""

TOOL_LINES = f"""
SELECT l_suppkey % 25 AS capture_id, CAST(row_number() OVER (PARTITION BY l_suppkey % 25 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS BIGINT) AS line_no,
       {_TOOL_LINE} AS line
FROM lineitem"""

#: The same lines with the order that numbers them, so that no window has to.
TOOL_ROWS = f"""
SELECT l_suppkey % 25 AS capture_id, struct(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS at,
       {_TOOL_LINE} AS line
FROM lineitem"""

BUILDKIT = """
SELECT s_nationkey AS capture_id, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS BIGINT) AS line_no,
       CASE WHEN s_nationkey = 5 THEN 'plain' WHEN s_suppkey % 4 = 0 THEN concat('#', CAST(s_suppkey % 8 AS VARCHAR(9)), ' DONE 0.1s') WHEN s_suppkey % 4 = 1 THEN concat('#9 naming to img', CAST(s_suppkey AS VARCHAR(9)), ' done') ELSE '#3 RUN x' END AS line
FROM supplier"""

DOCKER_PS = """
SELECT n_nationkey AS capture_id, CAST(0 AS BIGINT) AS line_no, 'CONTAINER ID   IMAGE   STATUS       NAMES' AS line FROM (SELECT n_nationkey FROM nation UNION ALL SELECT -1) AS n
UNION ALL SELECT s_nationkey, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS BIGINT), concat('abcdef012345   img     ', CASE WHEN (s_suppkey + s_nationkey) % 3 = 0 THEN 'Exited (0)   ' ELSE 'Up 2 hours   ' END, 'web-', CAST(s_suppkey AS VARCHAR(20))) FROM supplier"""

CHAINS = """
SELECT event_id, concat('run ', event_type, CASE event_id % 5 WHEN 0 THEN ' && echo "a;b" | cat' WHEN 1 THEN ' 2>&1; ls &' WHEN 2 THEN ' "open' WHEN 3 THEN ' || true' ELSE '' END) AS command FROM events"""

DOCKER_IMAGES = """
SELECT n_nationkey AS capture_id, CAST(0 AS BIGINT) AS line_no, 'REPOSITORY   TAG      IMAGE ID   SIZE' AS line FROM (SELECT n_nationkey FROM nation UNION ALL SELECT -1) AS n
UNION ALL SELECT s_nationkey, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS BIGINT), concat(rpad(CASE WHEN s_suppkey % 5 = 0 THEN '<none>' ELSE concat('r', CAST(s_suppkey AS VARCHAR(20))) END, 13, ' '), '1.0      abcdef     ', CAST(s_suppkey % 9 AS VARCHAR(9)), 'MB') FROM supplier"""

GRID = """
SELECT n_regionkey AS capture_id, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS BIGINT) AS line_no,
       CASE WHEN n_nationkey IN (SELECT min(n_nationkey) FROM nation GROUP BY n_regionkey) OR n_nationkey IN (SELECT max(n_nationkey) FROM nation GROUP BY n_regionkey) THEN '+----+-------+' WHEN n_regionkey = 3 AND n_nationkey % 2 = 0 THEN 'oops'
            ELSE concat('| ', CAST(n_nationkey AS VARCHAR(9)), '  | ', n_name, ' |') END AS line
FROM nation"""

#: What followed commands print about an event: a line, a log line, a line of a type check, a frame of a test runner.
LIVE_LINE = "concat('é', event_type, ' ', CAST(event_id AS VARCHAR(20)), CASE WHEN event_id % 5 = 0 THEN chr(13) ELSE '' END)"
LIVE_LOG_MARK = "CASE WHEN event_id % 23 = 0 THEN '' WHEN event_type IN ('view', 'click') THEN 'busy' ELSE event_type END"
LIVE_LOG = f"concat(CASE WHEN event_id % 23 = 0 THEN '' ELSE concat('2024-01-01 10:00:1', CAST(event_id % 10 AS VARCHAR(20)), ' ', {LIVE_LOG_MARK}) END, chr(10))"
LIVE_TYPES = (
    "concat(CASE event_type WHEN 'error' THEN concat('src/f', CAST(event_id AS VARCHAR(20)), '.ts:1:1 - error TS2: x') WHEN 'view' THEN 'Found 0 errors. Watching for file changes.' "
    "WHEN 'click' THEN 'Found 1 error. Watching for file changes.' WHEN 'signup' THEN '' ELSE 'File change detected. Starting incremental compilation...' END, chr(10))"
)
LIVE_FRAMES = "concat(chr(27), '[2J', CASE WHEN event_type = 'view' THEN concat('PASS x', chr(10), 'Tests: 2 passed') ELSE concat('FAIL t-', event_type, chr(10), 'Tests: 1 failed') END, chr(10))"
