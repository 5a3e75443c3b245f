"""The registered queries as SQL over the same parquet tables, for DuckDB.

Written from the meaning of each operator, not from its Spark plan.
"""

# Derived tables, as common table expressions in order of their dependencies.
_CTES = {
    "fx_tables": """
SELECT p_partkey AS k, 'project-' || substr('abcde', CAST(p_partkey % 5 AS INT) + 1, 1) AS table_catalog,
 CASE p_type WHEN 'PROMO' THEN 'test_promo' WHEN 'SMALL' THEN 'testing' WHEN 'LARGE' THEN 'audit_log' WHEN 'MEDIUM' THEN 'test' ELSE lower(p_type) END AS table_schema,
 'part_' || CAST(p_partkey AS VARCHAR) AS table_name,
 CASE p_size % 6 WHEN 0 THEN 'BASE TABLE' WHEN 1 THEN 'VIEW' WHEN 2 THEN 'EXTERNAL' WHEN 3 THEN 'CLONE' WHEN 4 THEN 'SNAPSHOT' ELSE 'MATERIALIZED VIEW' END AS table_type
FROM part""",
    "ids": """
SELECT k, table_catalog AS project_id, table_schema AS dataset_id, table_name AS table_id,
 table_catalog || '.' || table_schema || '.' || table_name AS fqn, table_type
FROM fx_tables""",
    "listed": """
SELECT * FROM ids WHERE dataset_id NOT IN ('audit_log') AND dataset_id NOT LIKE 'test_%'""",
    "job_log": """
SELECT project_id, dataset_id, table_id, l_suppkey AS user_id, CAST(l_shipdate AS DATE) AS dt
FROM lineitem JOIN ids ON k = l_partkey""",
    "usage_daily": """
SELECT project_id, dataset_id, table_id, dt, count(*) AS job_count, count(DISTINCT user_id) AS unique_user
FROM job_log GROUP BY ALL""",
    "counts": """
SELECT project_id, dataset_id, table_id, CAST(sum(job_count) AS BIGINT) AS job_count, CAST(sum(unique_user) AS BIGINT) AS unique_user
FROM usage_daily WHERE dt >= DATE '2001-08-01' - INTERVAL 90 DAY GROUP BY ALL""",
    "analyzed": """
SELECT project_id, dataset_id, table_id, table_type, coalesce(job_count, 0) AS job_count, coalesce(unique_user, 0) AS unique_user
FROM listed LEFT JOIN counts USING (project_id, dataset_id, table_id)""",
    "owners": """
SELECT project_id, dataset_id, table_id, s_name AS data_owner
FROM ids JOIN supplier ON s_suppkey = k WHERE k % 3 = 0""",
    "fx_ends": """
SELECT CAST((k - 1 - (k - 1) % 2) / 2 AS BIGINT) AS sk, k AS tk, 'tree' AS kind FROM fx_tables WHERE k >= 1
UNION ALL SELECT CAST((k - 1 - (k - 1) % 2) / 2 AS BIGINT), k, 'tree' FROM fx_tables WHERE k >= 1 AND k % 7 = 0
UNION ALL SELECT k, k, 'self' FROM fx_tables WHERE k % 97 = 5
UNION ALL SELECT k, CAST((k - 1 - (k - 1) % 2) / 2 AS BIGINT), 'back' FROM fx_tables WHERE k % 101 = 50
UNION ALL SELECT k, k, 'ext' FROM fx_tables WHERE k % 13 = 1
UNION ALL SELECT k, k, 'extsrc' FROM fx_tables WHERE k % 19 = 2""",
    "fx_named": """
SELECT s.project_id AS sp, t.project_id AS tp, tk,
 CASE WHEN kind = 'extsrc' THEN 'spanner:inst.db.s' WHEN sk % 17 = 16 THEN 'bigquery:sharded:' || s.fqn ELSE 'bigquery:' || s.fqn END AS source_fqn,
 CASE WHEN kind = 'ext' AND tk % 3 = 0 THEN 'spanner:inst.db.t' WHEN kind = 'ext' AND tk % 3 = 1 THEN 'bigquery:p.d' WHEN kind = 'ext' THEN 'bigquery:x.com:p.d.t.c'
  WHEN tk % 11 = 0 THEN 'bigquery:sharded:' || t.fqn ELSE 'bigquery:' || t.fqn END AS target_fqn,
 CASE WHEN tk % 29 = 28 THEN 'eu' ELSE 'us' END AS link_location
FROM fx_ends JOIN ids s ON s.k = sk JOIN ids t ON t.k = tk""",
    "links": """
SELECT sp AS link_project, link_location, source_fqn, target_fqn FROM fx_named
UNION ALL SELECT tp, link_location, source_fqn, target_fqn FROM fx_named WHERE tp <> sp AND tk % 10 <> 0""",
    # each end: its text after the prefix as written, and the plain id it names if any
    "ends": """
SELECT link_project, link_location, source_fqn, target_fqn,
 CASE WHEN starts_with(source_fqn, 'bigquery:') THEN substr(source_fqn, 10) END AS source_path,
 CASE WHEN starts_with(target_fqn, 'bigquery:') THEN substr(target_fqn, 10) END AS target_path,
 CASE WHEN starts_with(source_path, 'sharded:') THEN substr(source_path, 9) ELSE source_path END AS source_plain,
 CASE WHEN starts_with(target_path, 'sharded:') THEN substr(target_path, 9) ELSE target_path END AS target_plain,
 CASE WHEN length(source_plain) - length(replace(source_plain, '.', '')) = 2 THEN source_plain END AS source_id,
 CASE WHEN length(target_plain) - length(replace(target_plain, '.', '')) = 2 THEN target_plain END AS target_id
FROM links""",
    "down": """
SELECT source_path AS own, target_id AS far FROM ends
WHERE link_location = 'us' AND split_part(source_path, '.', 1) = link_project AND target_id IS NOT NULL""",
    "up": """
SELECT target_path AS own, source_id AS far FROM ends
WHERE link_location = 'us' AND split_part(target_path, '.', 1) = link_project AND source_id IS NOT NULL""",
    "down_normalized": """
SELECT source_plain AS own, target_id AS far FROM ends
WHERE link_location = 'us' AND split_part(source_plain, '.', 1) = link_project AND target_id IS NOT NULL""",
    "up_normalized": """
SELECT target_plain AS own, source_id AS far FROM ends
WHERE link_location = 'us' AND split_part(target_plain, '.', 1) = link_project AND source_id IS NOT NULL""",
}

_FENCE = "('project-a', 'project-b', 'project-c')"
_FENCED = f"WHERE split_part(far, '.', 1) IN {_FENCE}"
_IDS = "project_id, dataset_id, table_id"
_OWN_IDS = (
    "split_part(own, '.', 1) AS project_id, split_part(own, '.', 2) AS dataset_id,"
    " split_part(own, '.', 3) AS table_id"
)
_CHECKED = "project_id IN ('project-a', 'project-b')"


def _sql(body: str, **more: str) -> str:
    ctes = {**_CTES, **more}
    defined = ",\n".join(f"{name} AS ({text})" for name, text in ctes.items())
    return f"WITH RECURSIVE {defined}\n{body}"


def _leaves(source: str, fenced: str = "", extra: str = "") -> str:
    """Rows of ``source`` (ids with fqn) that are the own end of no link."""
    return f"""
SELECT {_IDS}, fqn, coalesce(n, 0) AS upstream_count{extra}
FROM {source} LEFT JOIN (SELECT own, count(*) AS n FROM up GROUP BY own) u ON u.own = fqn
WHERE fqn NOT IN (SELECT own FROM down {fenced})"""


def _reach(roots: str, down: str = "down", fenced: str = "") -> str:
    return f"""
SELECT fqn AS id FROM ids WHERE k IN ({roots})
UNION SELECT far FROM reached JOIN (SELECT DISTINCT own, far FROM {down} {fenced}) d ON d.own = reached.id"""


def _root_leaves(down: str = "down", up: str = "up", fenced: str = "") -> str:
    return f"""
SELECT split_part(id, '.', 1) AS project_id, split_part(id, '.', 2) AS dataset_id, split_part(id, '.', 3) AS table_id,
 id AS fqn, coalesce(n, 0) AS upstream_count
FROM reached LEFT JOIN (SELECT own, count(*) AS n FROM {up} GROUP BY own) u ON u.own = id
WHERE id NOT IN (SELECT own FROM {down} {fenced})"""


_ANALYZED_AB = f"SELECT * FROM analyzed WHERE {_CHECKED}"
_LISTED_AB = f"(SELECT * FROM listed WHERE {_CHECKED})"
_NEIGHBOURS = f"""
SELECT {_OWN_IDS}, direction, split_part(far, '.', 1) AS neighbour_project_id, split_part(far, '.', 2) AS neighbour_dataset_id,
 split_part(far, '.', 3) AS neighbour_table_id, count(*) AS link_count
FROM (SELECT own, far, 'upstream' AS direction FROM up UNION ALL SELECT own, far, 'downstream' FROM down)
GROUP BY ALL"""
_EVENT_LOG = """
SELECT 'app' AS project_id, 'events' AS dataset_id, event_type AS table_id, user_id, CAST(ts + INTERVAL 9 HOURS AS DATE) AS dt
FROM events"""
_REASON = """CASE WHEN {end}_fqn IS NULL THEN '{end}_missing'
  WHEN NOT starts_with({end}_fqn, 'bigquery:') THEN '{end}_other_system'
  WHEN {end}_id IS NULL THEN '{end}_not_three_parts' END"""

# look-backs, and the last day where there is one
_WINDOWS = """
(VALUES (90, DATE '9999-12-31'), (7, DATE '9999-12-31'), (400, DATE '9999-12-31'), (60, DATE '2001-08-01' - INTERVAL 30 DAY)) w(days_back, last_day)
WHERE dt >= DATE '2001-08-01' - to_days(days_back) AND dt <= last_day"""

ORACLES: dict[str, str] = {
    "list_tables": _sql(f"SELECT {_IDS}, table_type FROM listed WHERE {_CHECKED}"),
    "list_tables_full_outer": _sql(
        f"""
SELECT * FROM (SELECT {_IDS}, table_type FROM listed WHERE project_id = 'project-a') a
FULL OUTER JOIN (SELECT {_IDS}, table_type FROM listed WHERE project_id = 'project-b') b USING ({_IDS}, table_type)
FULL OUTER JOIN (SELECT {_IDS}, table_type FROM listed WHERE project_id = 'project-a') c USING ({_IDS}, table_type)"""
    ),
    "list_tables_repeated": _sql(
        f"""
SELECT * FROM (SELECT {_IDS}, table_type FROM listed WHERE project_id = 'project-a'
 UNION ALL SELECT {_IDS}, table_type FROM listed WHERE project_id = 'project-a' AND k % 3 = 0) a
FULL OUTER JOIN (SELECT {_IDS}, table_type FROM listed WHERE {_CHECKED}
 UNION ALL SELECT {_IDS}, table_type FROM listed WHERE {_CHECKED} AND k % 5 = 0) b USING ({_IDS}, table_type)"""
    ),
    "table_type_flags": _sql(
        f"""
SELECT {_IDS}, table_type = 'BASE TABLE' AS is_base_table, table_type = 'VIEW' AS is_view,
 table_type = 'EXTERNAL' AS is_external, table_type = 'CLONE' AS is_clone,
 table_type = 'SNAPSHOT' AS is_snapshot, table_type = 'MATERIALIZED VIEW' AS is_materialized_view
FROM listed"""
    ),
    "table_type_quarantine": _sql(
        f"""
SELECT {_IDS}, CASE WHEN k % 17 = 3 THEN lower(table_type) WHEN k % 23 = 4 THEN NULL ELSE table_type END AS table_type,
 NOT (k % 17 = 3 OR k % 23 = 4) AS valid
FROM ids WHERE dataset_id NOT LIKE 'test_%'"""
    ),
    "dedup_tables": _sql(
        f"""
SELECT {_IDS}, min(CASE l_suppkey % 6 WHEN 0 THEN 'BASE TABLE' WHEN 1 THEN 'VIEW' WHEN 2 THEN 'EXTERNAL'
 WHEN 3 THEN 'CLONE' WHEN 4 THEN 'SNAPSHOT' ELSE 'MATERIALIZED VIEW' END) AS table_type
FROM lineitem JOIN ids ON k = l_partkey GROUP BY {_IDS}"""
    ),
    "parse_table_ids": _sql(
        """
SELECT target_fqn AS text,
 CASE WHEN n = 2 THEN split_part(target_fqn, '.', 1) END AS project_id,
 CASE WHEN n = 2 THEN split_part(target_fqn, '.', 2) END AS dataset_id,
 CASE WHEN n = 2 THEN split_part(target_fqn, '.', 3) END AS table_id,
 CASE WHEN n = 2 THEN target_fqn END AS fqn,
 CASE WHEN n = 2 THEN 'bigquery:' || target_fqn END AS uri
FROM (SELECT target_fqn, length(target_fqn) - length(replace(target_fqn, '.', '')) AS n FROM links)"""
    ),
    "normalize_links": _sql(
        "SELECT link_project, link_location, source_id AS src, target_id AS dst FROM ends"
        " WHERE source_id IS NOT NULL AND target_id IS NOT NULL"
    ),
    "rejected_links": _sql(
        f"""
SELECT link_project, link_location, source_fqn, target_fqn,
 coalesce({_REASON.format(end="source")}, {_REASON.format(end="target")}) AS reason
FROM ends WHERE source_id IS NULL OR target_id IS NULL"""
    ),
    "daily_usage_rollup": _sql("SELECT * FROM usage_daily"),
    "daily_usage_rollup_tokyo": """
SELECT CAST(ts + INTERVAL 9 HOURS AS DATE) AS dt, event_type, count(*) AS job_count, count(DISTINCT user_id) AS unique_user
FROM events GROUP BY 1, 2""",
    "daily_usage_streamed": """
SELECT CAST(ts + INTERVAL 9 HOURS AS DATE) AS dt, event_type, count(*) AS job_count, count(DISTINCT user_id) AS unique_user
FROM events GROUP BY 1, 2""",
    "reference_counts": _sql("SELECT * FROM counts"),
    "analyzed_tables": _sql(_ANALYZED_AB),
    "unused_tables": _sql(f"{_ANALYZED_AB} AND job_count <= 0"),
    "unused_tables_threshold": _sql(f"{_ANALYZED_AB} AND job_count <= 5"),
    "unique_users_exact": _sql(
        f"""
SELECT {_IDS}, count(DISTINCT user_id) AS unique_user_exact FROM job_log
WHERE dt >= DATE '2001-08-01' - INTERVAL 90 DAY GROUP BY {_IDS}"""
    ),
    "unique_users_approx": _sql(
        f"""
SELECT {_IDS}, count(DISTINCT user_id) AS unique_user_exact, true AS close FROM job_log
WHERE dt >= DATE '2001-08-01' - INTERVAL 90 DAY GROUP BY {_IDS}"""
    ),
    "reference_counts_stored": f"""
SELECT {_IDS}, CAST(sum(jobs) AS BIGINT) AS job_count, CAST(sum(users) AS BIGINT) AS unique_user
FROM (SELECT {_IDS}, dt, count(*) AS jobs, count(DISTINCT user_id) AS users FROM ({_EVENT_LOG}) GROUP BY ALL)
WHERE dt >= DATE '2024-01-23' GROUP BY ALL""",
    "unique_users_stored": f"""
SELECT {_IDS}, count(DISTINCT user_id) AS unique_user_exact, true AS close
FROM ({_EVENT_LOG}) WHERE dt >= DATE '2024-01-23' GROUP BY ALL""",
    "reference_counts_any_window": _sql(
        f"""
SELECT {_IDS}, days_back, CAST(sum(job_count) AS BIGINT) AS job_count, CAST(sum(unique_user) AS BIGINT) AS unique_user
FROM usage_daily, {_WINDOWS} GROUP BY {_IDS}, days_back"""
    ),
    "unique_users_any_window": _sql(
        f"""
SELECT {_IDS}, days_back, count(DISTINCT user_id) AS unique_user_exact
FROM job_log, {_WINDOWS} GROUP BY {_IDS}, days_back"""
    ),
    "downstream_edges": _sql(f"SELECT own AS fqn, far AS neighbour FROM down {_FENCED}"),
    "upstream_edges": _sql("SELECT own AS fqn, far AS neighbour FROM up"),
    "upstream_counts": _sql(
        f"SELECT {_OWN_IDS}, count(*) AS upstream_count FROM up GROUP BY own"
    ),
    "table_lineage": _sql(
        f"""
SELECT {_IDS}, coalesce(u.n, 0) AS upstream_count, coalesce(d.n, 0) AS downstream_count,
 coalesce(d.n, 0) = 0 AS is_leaf, coalesce(u.n, 0) > 0 AS has_upstream, coalesce(d.n, 0) > 0 AS has_downstream
FROM ids LEFT JOIN (SELECT own, count(*) AS n FROM up GROUP BY own) u ON u.own = fqn
LEFT JOIN (SELECT own, count(*) AS n FROM down GROUP BY own) d ON d.own = fqn"""
    ),
    "table_neighbours": _sql(_NEIGHBOURS),
    "table_neighbours_looked_up": _sql(_NEIGHBOURS),
    "table_neighbour_pages": _sql(
        f"""
SELECT {_IDS}, direction, CAST(0 AS BIGINT) AS page,
 string_agg(neighbour_project_id || '.' || neighbour_dataset_id || '.' || neighbour_table_id || ' x' || CAST(link_count AS VARCHAR), ', '
  ORDER BY neighbour_project_id, neighbour_dataset_id, neighbour_table_id) AS neighbours
FROM ({_NEIGHBOURS}) GROUP BY ALL"""
    ),
    "table_neighbour_pages_small": _sql(
        f"""
SELECT {_IDS}, direction, neighbour_project_id, neighbour_dataset_id, neighbour_table_id, link_count
FROM ids CROSS JOIN (VALUES ('upstream'), ('downstream')) d(direction) LEFT JOIN ({_NEIGHBOURS}) USING ({_IDS}, direction)"""
    ),
    "table_neighbour_pages_dense": _sql(
        f"""
SELECT {_IDS}, direction, coalesce(page, 0) AS page, coalesce(neighbours, '') AS neighbours
FROM ids CROSS JOIN (VALUES ('upstream'), ('downstream')) d(direction) LEFT JOIN (
 SELECT {_IDS}, direction, page, string_agg(name, ', ' ORDER BY place) AS neighbours
 FROM (SELECT *, neighbour_project_id || '.' || neighbour_dataset_id || '.' || neighbour_table_id AS name,
   row_number() OVER (PARTITION BY {_IDS}, direction ORDER BY neighbour_project_id, neighbour_dataset_id, neighbour_table_id) - 1 AS place,
   place // 2 AS page FROM ({_NEIGHBOURS}))
 GROUP BY {_IDS}, direction, page) USING ({_IDS}, direction)"""
    ),
    "leaf_tables": _sql(_leaves("listed")),
    "leaf_tables_fenced": _sql(_leaves("listed", _FENCED)),
    "leaf_dependencies": _sql(
        f"SELECT {_IDS}, upstream_count > 0 AS has_dependencies FROM ({_leaves('listed')})"
    ),
    "leaf_tables_duplicates": _sql(_leaves("lineitem JOIN ids ON k = l_partkey")),
    "leaf_from_roots": _sql(_root_leaves(), reached=_reach("0")),
    "leaf_from_roots_fenced": _sql(
        _root_leaves(fenced=_FENCED), reached=_reach("1, 2", fenced=_FENCED)
    ),
    "leaf_from_roots_normalized": _sql(
        _root_leaves("down_normalized", "up_normalized"),
        reached=_reach("0", "down_normalized"),
    ),
    "leaf_from_roots_hub": _sql(
        _root_leaves("down_hub", "up_hub"),
        fed="""
SELECT h.project_id AS hub_project, h.fqn AS hub, f.project_id AS fed_project, f.fqn AS fed
FROM ids h JOIN ids f ON h.k = 0 AND f.k % 3 = 1""",
        down_hub="SELECT own, far FROM down UNION ALL SELECT hub, fed FROM fed",
        # a link is found from its target only if recorded in the target's project
        up_hub="SELECT own, far FROM up UNION ALL SELECT fed, hub FROM fed WHERE fed_project = hub_project",
        reached=_reach("0", "down_hub"),
    ),
    # the fixed bound on the depth only stops the recursion going round a cycle
    "reachable_tables": _sql(
        """
SELECT split_part(id, '.', 1) AS project_id, split_part(id, '.', 2) AS dataset_id, split_part(id, '.', 3) AS table_id,
 min(depth) AS depth
FROM deep GROUP BY id""",
        deep="""
SELECT fqn AS id, 0 AS depth FROM ids WHERE k = 0
UNION SELECT far, depth + 1 FROM deep JOIN (SELECT DISTINCT own, far FROM down) d ON d.own = deep.id WHERE depth < 40""",
    ),
    "reachable_after_change": _sql(
        """
SELECT split_part(id, '.', 1) AS project_id, split_part(id, '.', 2) AS dataset_id, split_part(id, '.', 3) AS table_id
FROM reached""",
        down_changed="""
SELECT own, far FROM down WHERE CAST(regexp_extract(far, '_([0-9]+)$', 1) AS BIGINT) % 40 <> 3
UNION ALL SELECT r.fqn, f.fqn FROM ids r JOIN ids f ON r.k = 0 AND f.k % 80 = 3""",
        reached=_reach("0", "down_changed"),
    ),
    "lifecycle_report": _sql(
        f"""
SELECT {_IDS}, l.table_type, a.job_count, a.unique_user, o.data_owner, a.job_count IS NOT NULL AS is_checked,
 o.data_owner IS NOT NULL AS is_candidate, a.job_count <= 0 AS is_unused,
 CASE WHEN o.data_owner IS NOT NULL THEN 'candidate' WHEN a.job_count IS NOT NULL THEN 'checked' ELSE 'discovered' END AS stage
FROM listed l LEFT JOIN ({_ANALYZED_AB}) a USING ({_IDS}) LEFT JOIN owners o USING ({_IDS})"""
    ),
    "lifecycle_history": _sql(
        f"""
SELECT {_IDS}, stage, data_owner, min(d) AS valid_from, max(until) AS valid_to
FROM (
 SELECT *, sum(begins) OVER (PARTITION BY {_IDS} ORDER BY d) AS part,
  CASE WHEN ends THEN CAST(d + INTERVAL 1 MONTH AS DATE) END AS until
 FROM (
  SELECT *, CASE WHEN lag(d) OVER w = d - INTERVAL 1 MONTH AND lag(stage) OVER w = stage
    AND lag(data_owner) OVER w IS NOT DISTINCT FROM data_owner THEN 0 ELSE 1 END AS begins,
   d < DATE '2001-08-01' AND (lead(d) OVER w = d + INTERVAL 1 MONTH AND lead(stage) OVER w = stage
    AND lead(data_owner) OVER w IS NOT DISTINCT FROM data_owner) IS NOT TRUE AS ends
  FROM (
   SELECT {_IDS}, DATE '2001-06-01' AS d, 'discovered' AS stage, NULL::VARCHAR AS data_owner FROM listed
   UNION ALL
   SELECT {_IDS}, DATE '2001-07-01', CASE WHEN a.job_count IS NULL THEN 'discovered' ELSE 'checked' END, NULL
   FROM listed l LEFT JOIN ({_ANALYZED_AB}) a USING ({_IDS}) WHERE l.table_type <> 'CLONE'
   UNION ALL
   SELECT {_IDS}, DATE '2001-08-01', CASE WHEN o.data_owner IS NOT NULL THEN 'candidate'
    WHEN a.job_count IS NOT NULL THEN 'checked' ELSE 'discovered' END, o.data_owner
   FROM listed l LEFT JOIN ({_ANALYZED_AB}) a USING ({_IDS}) LEFT JOIN owners o USING ({_IDS}) WHERE l.table_type <> 'VIEW')
  WINDOW w AS (PARTITION BY {_IDS} ORDER BY d)))
GROUP BY {_IDS}, part, stage, data_owner"""
    ),
    "flattened_lifecycle": _sql(
        f"""
SELECT {_IDS}, l.table_type, a.job_count, a.unique_user
FROM listed l LEFT JOIN ({_ANALYZED_AB}) a USING ({_IDS})"""
    ),
    "unused_leaf_tables": _sql(
        f"""
SELECT {_IDS}, a.table_type, job_count, unique_user, upstream_count
FROM ({_ANALYZED_AB} AND job_count <= 0) a JOIN ({_leaves(_LISTED_AB)}) USING ({_IDS})"""
    ),
    "usage_summary": _sql(
        """
SELECT project_id, dataset_id, table_type, count(*) AS tables, count(*) FILTER (WHERE job_count <= 0) AS unused_tables,
 CAST(sum(job_count) AS BIGINT) AS jobs, CAST(count(*) FILTER (WHERE job_count <= 0) AS DOUBLE) / count(*) AS unused_share
FROM analyzed GROUP BY project_id, dataset_id, table_type"""
    ),
    "usage_summary_levels": _sql(
        """
SELECT project_id, dataset_id, table_type, CAST(3 - bit_count(grouping_id(project_id, dataset_id, table_type)) AS INT) AS level,
 count(*) AS tables, count(*) FILTER (WHERE job_count <= 0) AS unused_tables, CAST(sum(job_count) AS BIGINT) AS jobs,
 CAST(count(*) FILTER (WHERE job_count <= 0) AS DOUBLE) / count(*) AS unused_share
FROM analyzed GROUP BY ROLLUP (project_id, dataset_id, table_type)"""
    ),
    "export_roundtrip_csv": _sql(_ANALYZED_AB),
    "export_roundtrip_json": _sql(_ANALYZED_AB),
    "export_project_leaves_csv": _sql(_leaves(_LISTED_AB, _FENCED)),
    "export_root_leaves_json": _sql(
        _root_leaves(fenced=_FENCED), reached=_reach("1, 2", fenced=_FENCED)
    ),
    "export_totals": _sql(
        f"""
SELECT 'reference_counts' AS export, count(*) AS total_tables, count(*) AS exported_tables FROM analyzed WHERE {_CHECKED}
UNION ALL SELECT 'project_leaves', (SELECT count(*) FROM listed WHERE {_CHECKED}), (SELECT count(*) FROM ({_leaves(_LISTED_AB, _FENCED)}))
UNION ALL SELECT 'root_leaves', (SELECT count(*) FROM ids WHERE k IN (1, 2)), (SELECT count(*) FROM ({_root_leaves(fenced=_FENCED)}))""",
        reached=_reach("1, 2", fenced=_FENCED),
    ),
    "export_stored_inputs": _sql(
        f"""
SELECT 'counts' AS export, {_IDS}, job_count AS number FROM analyzed WHERE {_CHECKED}
UNION ALL SELECT 'project', {_IDS}, upstream_count FROM ({_leaves(_LISTED_AB, _FENCED)})
UNION ALL SELECT 'root', {_IDS}, upstream_count FROM ({_root_leaves(fenced=_FENCED)})""",
        reached=_reach("1, 2", fenced=_FENCED),
    ),
    "export_overwritten": _sql(_leaves(_LISTED_AB)),
}
