"""SQL text shared by the oracle queries: the canonical views in ANSI-style SQL."""

KT1 = """
WITH RECURSIVE ev AS (
  SELECT event_id AS seq, 'u' || user_id AS learner_id, user_id AS user_no,
         row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS source_row,
         epoch_us(ts) // 1000 AS ts_ms,
         date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS solving_id,
         'q' || regexp_extract(props, '"k": ([0-9]+)', 1) AS item_id,
         CASE event_type WHEN 'click' THEN 'a' WHEN 'view' THEN 'b' WHEN 'purchase' THEN 'c'
              WHEN 'signup' THEN 'd' ELSE '' END AS user_answer
  FROM events),
kc AS (
  SELECT p_partkey, p_type, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS BIGINT) AS x, CAST(p_size AS BIGINT) AS y
  FROM part WHERE p_partkey % 10 <> 9),
cat AS (
  SELECT 'q' || p_partkey AS item_id, p_partkey AS item_no,
         CASE WHEN p_type = 'SMALL' THEN CAST([] AS BIGINT[]) WHEN p_type = 'ECONOMY' THEN [x, y, x] ELSE [x, y] END AS kc_ids,
         ['a', 'b', 'c', 'd'][p_partkey % 4 + 1] AS correct_answer
  FROM kc),
marked AS (
  SELECT ev.*, cat.kc_ids, cat.correct_answer, cat.item_no,
         CASE WHEN user_answer = '' THEN 'user_answer_empty'
              WHEN cat.item_id IS NULL THEN 'missing_metadata' END AS drop_reason
  FROM ev LEFT JOIN cat USING (item_id)),
canon AS (
  SELECT seq, learner_id || ':' || source_row AS interaction_id, learner_id, item_id, item_no,
         CAST(CASE WHEN user_answer = correct_answer THEN 1 ELSE 0 END AS BIGINT) AS correct, kc_ids,
         row_number() OVER (PARTITION BY learner_id ORDER BY seq) - 1 AS ord, ts_ms,
         learner_id || '|' || solving_id AS bundle_id, source_row, solving_id, user_no
  FROM marked WHERE drop_reason IS NULL),
contig AS (
  SELECT row_number() OVER (ORDER BY user_no, seq) - 1 AS seq, interaction_id, learner_id, item_id, item_no, correct,
         kc_ids, ord, ts_ms, bundle_id, source_row, solving_id, user_no
  FROM canon),
dense AS (
  SELECT row_number() OVER (ORDER BY seq) - 1 AS seq, interaction_id, learner_id, item_id, correct, kc_ids, ord, ts_ms,
         bundle_id, solving_id
  FROM canon),
brank AS (
  SELECT learner_id, solving_id, dense_rank() OVER (PARTITION BY learner_id ORDER BY solving_id) - 1 AS rk,
         count(*) OVER (PARTITION BY learner_id) AS n, first_seq, rows_in
  FROM (SELECT learner_id, solving_id, min(seq) AS first_seq, count(*) AS rows_in FROM contig GROUP BY ALL)),
cuts AS (
  SELECT *, CAST(greatest(1, round_even(n * 0.7e0, 0)) AS BIGINT) AS nt,
         CAST(greatest(1, round_even(n * 0.1e0, 0)) AS BIGINT) AS nv0 FROM brank),
labels AS (
  SELECT *, CASE WHEN rk < nt THEN 'train'
                 WHEN rk < nt + CASE WHEN nt + nv0 >= n THEN greatest(0, n - nt - 1) ELSE nv0 END THEN 'valid'
                 ELSE 'test' END AS split FROM cuts),
splitrows AS (
  SELECT contig.*, labels.split FROM contig JOIN labels USING (learner_id, solving_id))
"""

TUTOR = """
WITH tr AS (
  SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS source_row,
         o_custkey AS student_id, l_partkey AS problem_id, CASE WHEN p_type = 'PROMO' THEN '' ELSE p_brand END AS skill_id,
         CAST(CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS BIGINT) AS correct,
         CAST(epoch(o_orderdate) AS BIGINT) AS ts, CASE WHEN l_linenumber > 6 THEN 2 ELSE 1 END AS attempt
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
te AS (
  SELECT *, row_number() OVER (ORDER BY student_id, ts, source_row) - 1 AS seq
  FROM tr WHERE attempt = 1 AND skill_id <> ''),
tn AS (
  SELECT *, row_number() OVER (PARTITION BY student_id ORDER BY seq) - 1 AS rk, count(*) OVER (PARTITION BY student_id) AS n FROM te),
tc AS (
  SELECT *, CAST(greatest(1, round_even(n * 0.7e0, 0)) AS BIGINT) AS nt,
         CAST(greatest(1, round_even(n * 0.1e0, 0)) AS BIGINT) AS nv0 FROM tn),
nom AS (
  SELECT *, CASE WHEN rk < nt THEN 'train'
                 WHEN rk < nt + CASE WHEN nt + nv0 >= n THEN greatest(0, n - nt - 1) ELSE nv0 END THEN 'valid'
                 ELSE 'test' END AS nominal FROM tc),
cross_ AS (
  SELECT *, bool_or(nominal = 'train') OVER (PARTITION BY student_id, ts)
            AND bool_or(nominal = 'valid') OVER (PARTITION BY student_id, ts) AS crossing FROM nom),
closed AS (
  SELECT *, CASE WHEN crossing AND nominal = 'train' THEN 'valid' ELSE nominal END AS split,
         crossing AND nominal = 'train' AS promoted FROM cross_),
fitted AS (SELECT * FROM closed WHERE split IN ('train', 'valid')),
vlearn AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS idx FROM (SELECT DISTINCT CAST(student_id AS VARCHAR) AS id FROM fitted)),
vitem AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS idx FROM (SELECT DISTINCT CAST(problem_id AS VARCHAR) AS id FROM fitted)),
vskill AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS idx FROM (SELECT DISTINCT skill_id AS id FROM fitted)),
enc AS (
  SELECT closed.*, a.idx AS student_idx, b.idx AS problem_idx, c.idx AS skill_idx,
         split IN ('train', 'valid') OR (a.idx IS NOT NULL AND b.idx IS NOT NULL AND c.idx IS NOT NULL) AS metric_mask
  FROM closed LEFT JOIN vlearn a ON a.id = CAST(student_id AS VARCHAR)
  LEFT JOIN vitem b ON b.id = CAST(problem_id AS VARCHAR) LEFT JOIN vskill c ON c.id = skill_id)
"""

DAMAGED = KT1 + """, bad AS (
  SELECT seq,
    CASE WHEN seq % 997 = 8 THEN learner_id || ':0' WHEN seq % 997 = 14 THEN ' ' ELSE interaction_id END AS interaction_id,
    CASE WHEN seq % 997 = 1 THEN ' ' ELSE learner_id END AS learner_id,
    CASE WHEN seq % 997 = 2 THEN '' ELSE item_id END AS item_id,
    CASE WHEN seq % 997 = 3 THEN 2 ELSE correct END AS correct,
    CASE WHEN seq % 997 = 5 THEN list_append(kc_ids, -7) ELSE kc_ids END AS kc_ids,
    CASE WHEN seq % 997 = 4 THEN -1 WHEN seq % 997 = 9 THEN 0 ELSE ord END AS ord,
    CASE WHEN seq % 997 = 6 THEN 'NaN'::DOUBLE WHEN seq % 997 = 12 THEN ts_ms - 1e9 ELSE ts_ms::DOUBLE END AS ts,
    CASE WHEN seq % 997 = 10 THEN 'u0|0' WHEN seq % 997 = 11 THEN learner_id || '|0' WHEN seq % 997 = 15 THEN '' ELSE bundle_id END AS bundle_id,
    CASE WHEN seq % 997 = 7 THEN ' ' WHEN seq % 997 = 13 THEN 'valid' ELSE 'train' END AS split
  FROM canon)
"""

SIGMOID = "(1.0e0 / (1.0e0 + exp(-({0}))))"


def issue(code: str, where: str, key: str = "NULL") -> str:
    """Row-local issue rows of the damaged view."""
    return DAMAGED + f"SELECT '{code}' AS code, learner_id, CAST({key} AS VARCHAR) AS key, interaction_id FROM bad WHERE {where}"


def number(expr: str, digits: int = 7) -> str:
    return f"round({expr}, {digits}) + 0.0e0"
