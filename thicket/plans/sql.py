"""DuckDB SQL of the catalog's queries, over the same derived forest."""

from __future__ import annotations

from thicket.sources.derived import FOREST_SQL

_U64 = """CASE WHEN regexp_full_match({c}, '\\+?[0-9]+') AND TRY_CAST(regexp_replace({c}, '^\\+', '') AS HUGEINT) <= 18446744073709551615 THEN TRY_CAST(regexp_replace({c}, '^\\+', '') AS HUGEINT) END"""


def u64(c: str) -> str:
    return _U64.format(c=c)


def canon(c: str) -> str:
    t = f"split_part(trim({c}), '#', 1)"
    rest = f"substr({t}, instr({t}, '://') + 3)"
    return f"CASE WHEN instr({t}, '://') = 0 THEN {t} ELSE lower(substr({t}, 1, instr({t}, '://') - 1)) || '://' || lower(regexp_extract({rest}, '^[^/?]*')) || substr({rest}, length(regexp_extract({rest}, '^[^/?]*')) + 1) END"


#: Of the derived forest: nodes with path and parent; merged folders; entries left; folders kept; siblings.
NODES = f"""{FOREST_SQL},
nodes AS (SELECT *, root_key || coalesce('/' || p1, '') || coalesce('/' || p2, '') || coalesce('/' || p3, '') AS path,
    CASE depth WHEN 1 THEN root_key WHEN 2 THEN root_key || '/' || p1 WHEN 3 THEN root_key || '/' || p1 || '/' || p2 END AS parent_id, coalesce(p3, p2, p1, 0) AS child_pos,
    row_number() OVER (ORDER BY root_key, coalesce(p1, -1), depth > 1, CASE WHEN depth = 3 THEN p2 ELSE -1 END, -coalesce(p3, p2, p1, 0)) AS position FROM forest)"""

MERGED = f"""{NODES},
eligible AS (SELECT *, lower(trim(nfc_normalize(name))) AS key, {u64('id')} AS num FROM nodes WHERE type = 'folder' AND depth > 0 AND name IS NOT NULL),
folder_rank AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY depth, coalesce({u64('date_added')}, 18446744073709551615), num IS NULL, num, CASE WHEN num IS NULL THEN id END NULLS FIRST, position) AS rn FROM eligible),
fate AS (SELECT *, first_value(path) OVER (PARTITION BY key ORDER BY rn) AS winner, count(*) OVER (PARTITION BY key) AS group_size, sum(visit_count) OVER (PARTITION BY key) AS visits,
    first_value(date_modified) OVER (PARTITION BY key ORDER BY coalesce({u64('date_modified')}, 0) DESC, rn) AS modified FROM folder_rank),
merged AS (SELECT n.root_key, n.depth, n.type, n.name, n.url, n.id, n.date_added, CASE WHEN f.path IS NULL THEN n.date_modified ELSE f.modified END AS date_modified, n.date_last_used,
    CAST(CASE WHEN f.path IS NULL THEN n.visit_count ELSE f.visits END AS BIGINT) AS visit_count, n.path, n.child_pos, n.position, coalesce(p.winner, n.parent_id) AS new_parent, coalesce(p.rn, 0) AS parent_rank
    FROM nodes n LEFT JOIN fate f ON n.path = f.path LEFT JOIN fate p ON n.parent_id = p.path WHERE f.path IS NULL OR f.winner = n.path)"""

DEDUPED = f"""{MERGED},
ranked AS (SELECT *, {canon('url')} AS canon, {u64('id')} AS num FROM merged WHERE type = 'url' AND url IS NOT NULL),
entries AS (SELECT *, row_number() OVER (PARTITION BY new_parent, canon ORDER BY coalesce(visit_count, 0) DESC, coalesce({u64('date_last_used')}, 0) DESC, coalesce({u64('date_added')}, 0),
    CASE WHEN num IS NOT NULL THEN 0 WHEN id IS NOT NULL THEN 1 ELSE 2 END, num, CASE WHEN num IS NULL THEN id END, parent_rank, child_pos) AS place, count(*) OVER (PARTITION BY new_parent, canon) AS n FROM ranked),
deduped AS (SELECT * FROM merged WHERE path NOT IN (SELECT path FROM entries WHERE place > 1))"""

KEPT = f"""{DEDUPED},
up AS (SELECT new_parent AS path FROM deduped WHERE type <> 'folder' UNION SELECT path FROM deduped WHERE new_parent IS NULL UNION SELECT d.new_parent FROM up JOIN deduped d ON d.path = up.path WHERE d.new_parent IS NOT NULL),
keep AS (SELECT DISTINCT path FROM up WHERE path IS NOT NULL),
final AS (SELECT * FROM deduped WHERE type <> 'folder' OR path IN (SELECT path FROM keep)),
ordered AS (SELECT *, row_number() OVER (PARTITION BY new_parent ORDER BY CASE type WHEN 'folder' THEN 0 WHEN 'url' THEN 1 ELSE 2 END,
    CASE type WHEN 'folder' THEN lower(trim(coalesce(name, ''))) WHEN 'url' THEN {canon("coalesce(url, '')")} ELSE type END,
    CASE WHEN type IN ('folder', 'url') THEN coalesce(id, '') ELSE coalesce(name, '') END, parent_rank, child_pos, path) - 1 AS place FROM final)"""

IDENTITY = f"""{NODES},
ident AS (SELECT path, parent_id, coalesce(id, 'path:' || path) AS key FROM nodes WHERE type = 'folder'),
edges AS (SELECT DISTINCT p.key AS src, c.key AS dst FROM ident c JOIN ident p ON c.parent_id = p.path)"""

COPY = "'copy ' || copy || '/100%'"

#: The whole log; its payloads are compact JSON with fields in a fixed order.
LOG = f"""{KEPT},
ident AS (SELECT path, parent_id, coalesce(id, 'path:' || path) AS key FROM nodes WHERE type = 'folder'),
edges AS (SELECT DISTINCT p.key AS src, c.key AS dst FROM ident c JOIN ident p ON c.parent_id = p.path),
gone AS (SELECT path, position FROM deduped WHERE type = 'folder' AND path NOT IN (SELECT path FROM keep)),
names AS (SELECT name, count(*) AS n FROM final WHERE type = 'folder' AND name IS NOT NULL GROUP BY name),
counted AS (SELECT (SELECT count(*) FROM nodes WHERE type = 'folder') AS a, (SELECT count(*) FROM nodes WHERE type = 'url') AS b, (SELECT count(*) FROM fate WHERE winner <> path) AS c, (SELECT count(*) FROM entries WHERE place > 1) AS d, (SELECT count(*) FROM gone) AS e),
log AS (SELECT stage, 0 AS place, '' AS name, 0 AS second, 'phase_started' AS type, '{{"type":"phase_started","name":"' || phase || '"}}' AS payload FROM (VALUES (0.0, 'parse_and_index'), (10, 'scc'), (20, 'folder_merge_iteration_1'), (30, 'per_folder_url_dedup'), (40, 'prune_empty'), (50, 'rebuild_check'), (60, 'final_rebuild')) p(stage, phase)
  UNION ALL SELECT stage, 0, '', 0, 'phase_finished', '{{"type":"phase_finished","name":"' || phase || '"}}' FROM (VALUES (9.0, 'parse_and_index'), (19, 'scc'), (39, 'per_folder_url_dedup'), (49, 'prune_empty'), (53, 'folder_merge_iteration_1_complete'), (69, 'final_rebuild')) p(stage, phase)
  UNION ALL SELECT 11, 0, '', 0, 'scc_computed', '{{"type":"scc_computed","nodes":' || (SELECT count(DISTINCT key) FROM ident) || ',"edges":' || (SELECT count(*) FROM edges) || ',"components":' || (SELECT count(DISTINCT key) FROM ident) || ',"cyclic_components":0}}'
  UNION ALL SELECT 21, 0, key, 0, 'folder_merge_planned', '{{"type":"folder_merge_planned","normalized_name":"' || key || '","group_size":' || count(*) || '}}' FROM fate GROUP BY key HAVING count(*) > 1
  UNION ALL SELECT 21, 0, key, 1, 'folder_merged', '{{"type":"folder_merged","normalized_name":"' || key || '","winner_path":"' || min(winner) || '","losers":["' || string_agg(path, '","' ORDER BY rn) FILTER (rn > 1) || '"]}}' FROM fate GROUP BY key HAVING count(*) > 1
  UNION ALL SELECT 31, f.position, e.canon, 0, 'url_deduped', '{{"type":"url_deduped","folder_path":"' || f.path || '","canonical_url":"' || e.canon || '","removed":' || (e.n - 1) || '}}' FROM entries e JOIN nodes f ON e.new_parent = f.path WHERE e.place = 1 AND e.n > 1
  UNION ALL SELECT 41, position, '', 0, 'folder_pruned', '{{"type":"folder_pruned","folder_path":"' || path || '"}}' FROM gone
  UNION ALL SELECT 52, 0, '', 0, 'folder_counts', '{{"type":"folder_counts","counts":{{' || string_agg('"' || name || '":' || n, ',' ORDER BY name) || '}}}}' FROM names
  UNION ALL SELECT 70, 0, '', 0, 'finished', '{{"type":"finished","stats":{{"folders_seen":' || a || ',"urls_seen":' || b || ',"folders_merged":' || c || ',"urls_deduped":' || d || ',"folders_pruned":' || e || '}}}}' FROM counted)"""

SQUARES = """vertices AS (SELECT c_custkey AS key FROM customer), total AS (SELECT count(*) AS n FROM customer),
edges AS (SELECT c_custkey AS src, c_custkey * c_custkey % n AS dst FROM customer CROSS JOIN total),
reach AS (SELECT src, dst FROM edges UNION SELECT r.src, e.dst FROM reach r JOIN edges e ON r.dst = e.src),
labels AS (SELECT v.key, least(v.key, coalesce(min(r.dst), v.key)) AS component FROM vertices v LEFT JOIN (SELECT a.src, a.dst FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src) r ON r.src = v.key GROUP BY v.key),
scc AS (SELECT key, component, count(*) OVER (PARTITION BY component) AS component_size,
    count(*) OVER (PARTITION BY component) > 1 OR EXISTS (SELECT 1 FROM edges e WHERE e.src = labels.key AND e.dst = labels.key) AS is_cyclic FROM labels)"""

ODD_NUMBERS = """odd AS (SELECT page_id, CASE page_id % 9 WHEN 0 THEN CAST(page_id AS STRING) WHEN 1 THEN '+' || CAST(page_id AS STRING) WHEN 2 THEN '000' || CAST(page_id AS STRING) WHEN 3 THEN ' 5' WHEN 4 THEN '1e3'
    WHEN 5 THEN '99999999999999999999' WHEN 6 THEN '18446744073709551615' WHEN 7 THEN '-3' ELSE '' END AS s FROM pages)"""


def _with(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes} {select}"


def oracle_sql() -> dict[str, str]:
    stats = """SELECT (SELECT count(*) FROM nodes WHERE type = 'folder') AS folders_seen, (SELECT count(*) FROM nodes WHERE type = 'url') AS urls_seen,
    (SELECT count(*) FROM fate WHERE winner <> path) AS folders_merged, (SELECT count(*) FROM entries WHERE place > 1) AS urls_deduped,
    (SELECT count(*) FROM deduped WHERE type = 'folder' AND path NOT IN (SELECT path FROM keep)) AS folders_pruned"""
    return {
        "canonical_url": f"SELECT page_id, v, canon FROM (SELECT page_id, 0 AS v, {canon('url')} AS canon FROM pages UNION ALL SELECT page_id, 1 AS v, {canon(chr(39) + ' ' + chr(39) + ' || upper(url) || ' + chr(39) + '#a#b ' + chr(39))} AS canon FROM pages) q",
        "u64_parse": f"WITH {ODD_NUMBERS} SELECT page_id, s, CAST({u64('s')} AS STRING) AS n FROM odd",
        "folder_key": _with(MERGED, "SELECT path, key FROM eligible"),
        "input_counts": _with(NODES, "SELECT count(*) FILTER (type = 'folder') AS folders_seen, count(*) FILTER (type = 'url') AS urls_seen FROM nodes"),
        "flatten_nodes": _with(NODES, "SELECT path, parent_id, root_key, depth, child_pos, type, name, url, id, date_added, date_modified, date_last_used, visit_count FROM nodes"),
        "arena_order": _with(NODES, "SELECT path, CAST(position AS INT) AS position FROM nodes"),
        "folder_winner": _with(MERGED, "SELECT key, path AS winner FROM fate WHERE rn = 1"),
        "folder_merge_map": _with(MERGED, "SELECT path, new_parent FROM merged"),
        "folder_merge_attrs": _with(MERGED, "SELECT key, winner AS winner_path, group_size, CAST(visits AS BIGINT) AS visits, modified FROM fate WHERE rn = 1"),
        "merged_from": _with(MERGED, "SELECT path AS merged_from, winner AS merged_into FROM fate WHERE winner <> path"),
        "merge_events": _with(MERGED, "SELECT key AS normalized_name, group_size, winner AS winner_path, string_agg(path, ',' ORDER BY rn) FILTER (rn > 1) AS losers FROM fate WHERE group_size > 1 GROUP BY key, group_size, winner"),
        "url_dedup": _with(DEDUPED, "SELECT new_parent, canon, path AS winner FROM entries WHERE place = 1"),
        "url_dedup_counts": _with(DEDUPED, "SELECT new_parent, canon, n - 1 AS removed FROM entries WHERE place = 1 AND n > 1"),
        "prune_keep": _with(KEPT, "SELECT path FROM keep"),
        "prune_removed": _with(KEPT, "SELECT path FROM deduped WHERE type = 'folder' AND path NOT IN (SELECT path FROM keep)"),
        "sibling_order": _with(KEPT, "SELECT path, new_parent, CAST(place AS INT) AS position FROM ordered"),
        "folder_registry": _with(KEPT, "SELECT name, count(*) AS n FROM final WHERE type = 'folder' AND name IS NOT NULL GROUP BY name"),
        "all_unique": _with(KEPT, "SELECT max(n) <= 1 AS all_unique FROM (SELECT count(*) AS n FROM final WHERE type = 'folder' AND name IS NOT NULL GROUP BY name) q"),
        "viol_global_unique": _with(NODES, "SELECT lower(trim(name)) AS detail, min(path) AS path FROM nodes WHERE type = 'folder' AND name IS NOT NULL GROUP BY lower(trim(name)) HAVING count(*) > 1"),
        "viol_empty": _with(NODES, "SELECT path FROM nodes n WHERE type = 'folder' AND depth > 0 AND NOT EXISTS (SELECT 1 FROM nodes c WHERE c.parent_id = n.path AND (c.depth < 3 OR c.p2 % 2 = 0))"),
        "viol_folders_only": _with(f"{NODES}, seen AS (SELECT * FROM nodes WHERE depth = 0 OR p1 % 2 = 0)", f"""SELECT 'folder_name_not_unique' AS rule, min(path) AS path, lower(trim(name)) AS detail FROM seen WHERE type = 'folder' AND name IS NOT NULL GROUP BY 3 HAVING count(*) > 1
            UNION ALL SELECT 'duplicate_child_folder', parent_id, lower(trim(name)) FROM seen WHERE type = 'folder' AND depth > 0 GROUP BY 2, 3 HAVING count(*) > 1
            UNION ALL SELECT 'duplicate_url', parent_id, {canon('url')} FROM seen WHERE type = 'url' GROUP BY 2, 3 HAVING count(*) > 1
            UNION ALL SELECT 'empty_folder', path, NULL FROM seen n WHERE type = 'folder' AND depth > 0 AND NOT EXISTS (SELECT 1 FROM seen c WHERE c.parent_id = n.path)"""),
        "viol_dup_child": _with(MERGED, "SELECT root_key AS path, lower(trim(name)) AS detail FROM nodes WHERE type = 'folder' AND depth = 2 GROUP BY root_key, lower(trim(name)) HAVING count(*) > 1"),
        "viol_dup_url": _with(NODES, f"SELECT parent_id AS path, {canon('url')} AS detail FROM nodes WHERE type = 'url' GROUP BY 1, 2 HAVING count(*) > 1"),
        "violations_left": _with(KEPT, "SELECT 'folder_name_not_unique' AS rule, lower(trim(name)) AS detail FROM (SELECT name FROM final WHERE type = 'folder' AND name IS NOT NULL UNION ALL SELECT ' Building' FROM region) q GROUP BY lower(trim(name)) HAVING count(*) > 1"),
        "identity_vertices": _with(IDENTITY, "SELECT DISTINCT key FROM ident"),
        "identity_edges": _with(IDENTITY, "SELECT src, dst FROM edges"),
        "identity_scc": _with(IDENTITY, "SELECT (SELECT count(DISTINCT key) FROM ident) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT count(DISTINCT key) FROM ident) AS components, CAST(0 AS BIGINT) AS cyclic_components"),
        "scc_labels": _with(SQUARES, "SELECT key, component, component_size, is_cyclic FROM scc"),
        "scc_summary": _with(SQUARES, "SELECT (SELECT count(*) FROM vertices) AS nodes, (SELECT count(*) FROM (SELECT DISTINCT src, dst FROM edges) q) AS edges, count(DISTINCT component) AS components, count(DISTINCT component) FILTER (is_cyclic) AS cyclic_components FROM scc"),
        "stats": _with(KEPT, stats),
        "event_counts": _with(KEPT, """SELECT 'folder_merge_planned' AS type, count(DISTINCT key) FILTER (group_size > 1) AS n FROM fate UNION ALL SELECT 'folder_merged', count(DISTINCT key) FILTER (group_size > 1) FROM fate
            UNION ALL SELECT 'url_deduped', count(*) FROM entries WHERE place = 1 AND n > 1 UNION ALL SELECT 'folder_pruned', count(*) FROM deduped WHERE type = 'folder' AND path NOT IN (SELECT path FROM keep)
            UNION ALL SELECT 'phase_started', 7 UNION ALL SELECT 'phase_finished', 6 UNION ALL SELECT 'scc_computed', 1 UNION ALL SELECT 'folder_counts', 1 UNION ALL SELECT 'finished', 1"""),
        "event_log": _with(LOG, "SELECT CAST(row_number() OVER (ORDER BY stage, place, name, second) AS INT) AS seq, type, payload FROM log"),
        "prune_order": _with(f"{NODES}, own AS (SELECT * FROM nodes WHERE depth < 3 OR (p1 + 2 * p2) % 6 = 0), full_pairs AS (SELECT DISTINCT root_key, p1, p2 FROM own WHERE depth = 3)", """SELECT CAST(row_number() OVER (ORDER BY root_key, p1, coalesce(p2, 1000)) AS INT) AS seq, path FROM own o WHERE depth IN (1, 2)
            AND NOT EXISTS (SELECT 1 FROM full_pairs f WHERE f.root_key = o.root_key AND f.p1 = o.p1 AND (o.depth = 1 OR f.p2 = o.p2))"""),
        "registry_report": _with(f"{KEPT}, names AS (SELECT name, count(*) AS n FROM final WHERE type = 'folder' AND name IS NOT NULL GROUP BY name)", """SELECT CAST(row_number() OVER (ORDER BY last, key) AS INT) AS place, line FROM (
            SELECT 0 AS last, name AS key, rpad(name, CAST(greatest(length(name), 12) AS INT), ' ') || ' | ' || n AS line FROM names UNION ALL SELECT 1, '', 'all unique: ' || CASE WHEN max(n) <= 1 THEN 'true' ELSE 'false' END FROM names) q"""),
        "json_flatten": _with(NODES, f"SELECT {COPY} AS doc_id, path, parent_id, root_key, depth, child_pos, type, name, url, id, date_added, date_modified, date_last_used, visit_count FROM nodes CROSS JOIN range(3) r(copy)"),
        "json_schema_errors": """SELECT 'page ' || page_id AS doc_id, CASE page_id % 8 WHEN 1 THEN 0 WHEN 7 THEN 0 ELSE 3 END AS place, CASE page_id % 8 WHEN 1 THEN '' WHEN 7 THEN '' ELSE 'bar/1' END AS path,
            CASE page_id % 8 WHEN 1 THEN 'version' WHEN 2 THEN 'visit_count' WHEN 3 THEN 'date_added' WHEN 4 THEN 'guid' WHEN 5 THEN 'source' ELSE 'not JSON' END AS error FROM pages WHERE page_id % 8 NOT IN (0, 6)""",
        "document_round_trip": _with(f"{KEPT}, down AS (SELECT path, root_key AS now FROM ordered WHERE new_parent IS NULL UNION ALL SELECT o.path, down.now || '/' || o.place FROM ordered o JOIN down ON o.new_parent = down.path)",
            f"SELECT {COPY} AS doc_id, now AS path, type, name, url, id, date_added, date_modified, date_last_used, visit_count FROM ordered JOIN down USING (path) CROSS JOIN range(3) r(copy)"),
        "normalized_nodes": _with(KEPT, "SELECT path, new_parent, CAST(place AS INT) AS position, type, name, url, id, date_added, date_modified, date_last_used, visit_count FROM ordered"),
    }
