"""Independent SQL for each query, over the given tables alone.

``BASE`` derives postings, Silver and Gold from the tables in one chain of common table
expressions; each query adds its own last step.
"""

from __future__ import annotations

from harness.catalog import NULLABLE_NUMBERS

ADJECTIVES = "('blue'), ('cold'), ('hot'), ('large'), ('new'), ('old'), ('red'), ('small')"
NOUNS = "('anvil'), ('bolt'), ('gear'), ('gizmo'), ('plate'), ('ring'), ('rod'), ('widget')"


def half_width(text: str) -> str:
    full = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    half = "".join(chr(c) for c in range(0x21, 0x7F)).replace("'", "''")
    return f"translate({text}, '{full}', '{half}')"


def norm(text: str) -> str:
    return (
        rf"lower(trim(regexp_replace({half_width(text)}, "
        rf"'[\x{{0000}}-\x{{0020}}\x{{00A0}}\x{{3000}}]+', ' ', 'g')))"
    )


SALARY = r"^([0-9.]+)-([0-9.]+)(千|万|元)/(月|年|天)(·([0-9]+)薪)?$"


def salary_group(n: int) -> str:
    return f"regexp_extract(salary_text, '{SALARY}', {n})"


def monthly(n: int) -> str:
    """Whole yuan a month in whole numbers: millionths of the amount times the unit, divided and floored."""
    yuan = (
        f"(CAST(CAST({salary_group(n)} AS DECIMAL(18, 6)) * 1000000 AS BIGINT) * CASE {salary_group(3)} "
        "WHEN '千' THEN 1000 WHEN '万' THEN 10000 ELSE 1 END)"
    )
    return (
        f"CASE WHEN regexp_matches(salary_text, '{SALARY}') THEN CAST(CASE {salary_group(4)} "
        f"WHEN '月' THEN {yuan} // 1000000 WHEN '年' THEN {yuan} // 12000000 ELSE {yuan} * 2175 // 100000000 END AS BIGINT) END"
    )


SALARY_MONTHS = (
    f"CASE WHEN regexp_matches(salary_text, '{SALARY}') "
    f"THEN coalesce(CAST(nullif({salary_group(6)}, '') AS INTEGER), 12) END"
)
ROLE_OF = (
    "CASE WHEN lower(raw_title) LIKE '%urgent%' THEN 'urgent' WHEN lower(raw_title) LIKE '%high%' THEN 'priority' "
    "WHEN lower(raw_title) LIKE '%specified%' THEN 'open' WHEN lower(raw_title) LIKE '%medium%' THEN 'standard' "
    "ELSE 'other' END"
)
CITY_OF = "upper(regexp_replace(trim(raw_city), '(市|-x)$', ''))"
# The seven requirement texts, by what they say.
EDUCATION_OF = (
    "CASE WHEN req_text LIKE '%学历不限%' THEN '不限' WHEN req_text LIKE '%大专%' THEN '大专' "
    "WHEN req_text LIKE '%本科%' THEN '本科' WHEN req_text LIKE '%硕士%' THEN '硕士' "
    "WHEN req_text LIKE '%博士%' THEN '博士' END"
)
EDUCATION_RANK_OF = (
    "CAST(CASE WHEN req_text LIKE '%学历不限%' THEN 0 WHEN req_text LIKE '%大专%' THEN 2 "
    "WHEN req_text LIKE '%本科%' THEN 3 WHEN req_text LIKE '%硕士%' THEN 4 WHEN req_text LIKE '%博士%' THEN 5 END AS INTEGER)"
)
EXP_MIN_OF = (
    "CAST(CASE WHEN req_text LIKE '%3-5年%' THEN 3 WHEN req_text LIKE '%5-10年%' THEN 5 "
    "WHEN req_text LIKE '%1年以上%' THEN 1 WHEN req_text LIKE '%应届%' OR req_text LIKE '%经验不限%' THEN 0 END AS INTEGER)"
)
EXP_MAX_OF = (
    "CAST(CASE WHEN req_text LIKE '%3-5年%' THEN 5 WHEN req_text LIKE '%5-10年%' THEN 10 "
    "WHEN req_text LIKE '%应届%' THEN 0 END AS INTEGER)"
)

BASE = f"""WITH described AS (
  SELECT l_orderkey AS k, string_agg(DISTINCT p_name, '；' ORDER BY p_name) AS description
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey
), posting_once AS (
  SELECT o_orderkey AS ok, CASE o_orderstatus WHEN 'F' THEN 'src_a' WHEN 'O' THEN 'src_b' WHEN 'P' THEN 'src_c' END AS source,
    source || ':' || CAST(o_orderkey - CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'P' THEN 2 ELSE 0 END AS VARCHAR) AS record_id,
    o_orderpriority AS raw_title,
    CASE WHEN o_orderkey % 2 = 0 THEN n_name || '市' ELSE ' ' || lower(n_name) || '-x' END AS raw_city,
    c_name AS company, c_mktsegment AS major,
    CASE o_orderkey % 6
      WHEN 0 THEN CAST(5 + o_custkey % 20 AS VARCHAR) || '-' || CAST(6 + o_custkey % 20 + o_orderkey % 5 AS VARCHAR) || '千/月'
      WHEN 1 THEN '8.12-16.08千/月·' || CAST(12 + o_custkey % 4 AS VARCHAR) || '薪'
      WHEN 2 THEN CAST(10 + o_custkey % 20 AS VARCHAR) || '-' || CAST(12 + o_custkey % 20 AS VARCHAR) || '万/年'
      WHEN 3 THEN '200-300元/天' WHEN 4 THEN '面议' END AS salary_text,
    CASE o_orderkey % 7 WHEN 0 THEN '大专 经验不限' WHEN 1 THEN '本科及以上，3-5年经验' WHEN 2 THEN '硕士 1年以上'
      WHEN 3 THEN '学历不限 5-10年' WHEN 4 THEN '博士' WHEN 5 THEN '在校/应届 本科' WHEN 6 THEN '' END AS req_text,
    description, CAST(o_orderdate AS DATE) AS posted_on
  FROM orders LEFT JOIN described ON k = o_orderkey LEFT JOIN customer ON c_custkey = o_custkey
    LEFT JOIN nation ON n_nationkey = c_nationkey
), posting_raw AS (
  SELECT * EXCLUDE (ok) FROM posting_once
  UNION ALL
  SELECT source, record_id || '-d', ' ' || lower(raw_title), raw_city, upper(company), major, salary_text, req_text,
    description, posted_on
  FROM posting_once WHERE ok % 43 = 0
), bronze AS (
  SELECT *, 'batch-1' AS batch_id, md5(concat_ws(chr(31), coalesce({norm('raw_title')}, ''), coalesce({norm('raw_city')}, ''),
    coalesce({norm('company')}, ''), coalesce({norm('salary_text')}, ''), coalesce({norm('description')}, ''),
    coalesce(CAST(posted_on AS VARCHAR), ''))) AS fingerprint
  FROM posting_raw
), valid AS (
  SELECT * FROM bronze WHERE trim(raw_title) <> '' AND trim(company) <> ''
), survivor AS (
  SELECT * FROM valid
  QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY source, record_id) = 1
), skill_alias AS (
  SELECT a || ' ' || n AS alias, CASE WHEN a IN ('new', 'old') THEN n ELSE a || ' ' || n END AS skill
  FROM (VALUES {ADJECTIVES}) AS adjective(a), (VALUES {NOUNS}) AS noun(n)
), raw_skill AS (
  SELECT DISTINCT record_id, skill
  FROM (SELECT record_id, unnest(string_split(description, '；')) AS alias FROM posting_raw) JOIN skill_alias USING (alias)
), skill_list AS (
  SELECT record_id, string_agg(skill, ',' ORDER BY skill) AS skills FROM raw_skill GROUP BY record_id
), refined AS (
  SELECT v.record_id, source, trim(raw_title) AS title, {ROLE_OF} AS role, {CITY_OF} AS city, company, major,
    {monthly(1)} AS salary_min, {monthly(2)} AS salary_max, {EDUCATION_OF} AS education, {EDUCATION_RANK_OF} AS education_rank,
    {EXP_MIN_OF} AS exp_min_years, {EXP_MAX_OF} AS exp_max_years, coalesce(skills, '') AS skills,
    coalesce(description, '') <> '' AS has_description, posted_on,
    CAST(year(posted_on) * 100 + month(posted_on) AS INTEGER) AS posted_month, fingerprint
  FROM valid v LEFT JOIN skill_list s ON s.record_id = v.record_id
), posting AS (
  SELECT r.* FROM refined r SEMI JOIN survivor USING (record_id)
), posting_text AS (
  SELECT record_id, raw_title, description, salary_text, req_text FROM survivor
), job_skill AS (
  SELECT record_id, skill FROM raw_skill SEMI JOIN survivor USING (record_id)
), asked AS (
  SELECT p.*, skill FROM posting p JOIN job_skill USING (record_id)
), total AS (
  SELECT CAST(count(*) AS DOUBLE) AS n FROM posting
), skill_freq AS (
  SELECT skill, postings, CAST(postings AS DOUBLE) / n AS share, dense_rank() OVER (ORDER BY postings DESC) AS rank
  FROM (SELECT skill, count(*) AS postings FROM job_skill GROUP BY skill), total
), city_salary AS (
  SELECT city, count(*) AS n, min(salary_min) AS salary_min, max(salary_max) AS salary_max,
    CAST(sum(CAST((salary_min + salary_max) / 2e0 AS DECIMAL(18, 2))) AS DOUBLE) / count(*) AS mean_mid,
    quantile_cont((salary_min + salary_max) / 2e0, 0.5) AS median_mid
  FROM posting WHERE salary_min IS NOT NULL GROUP BY city
), role_demand AS (
  SELECT role, count(*) AS postings, count(DISTINCT company) AS companies, count(DISTINCT city) AS cities,
    CAST(count(*) AS DOUBLE) / any_value(n) AS share
  FROM posting, total GROUP BY role
), nodes AS (
  SELECT 'JobPosting' AS kind, record_id AS id, title AS name FROM posting
  UNION ALL SELECT DISTINCT 'JobRole', md5('JobRole|' || role), role FROM posting
  UNION ALL SELECT DISTINCT 'Skill', md5('Skill|' || skill), skill FROM job_skill
  UNION ALL SELECT DISTINCT 'City', md5('City|' || city), city FROM posting
  UNION ALL SELECT DISTINCT 'Company', md5('Company|' || company), company FROM posting
  UNION ALL SELECT DISTINCT 'Major', md5('Major|' || major), major FROM posting
), edges AS (
  SELECT 'BELONGS_TO_ROLE' AS kind, record_id AS src_id, md5('JobRole|' || role) AS dst_id FROM posting
  UNION ALL SELECT 'LOCATED_IN', record_id, md5('City|' || city) FROM posting
  UNION ALL SELECT 'POSTED_BY', record_id, md5('Company|' || company) FROM posting
  UNION ALL SELECT 'REQUIRES', record_id, md5('Skill|' || skill) FROM job_skill
  UNION ALL SELECT 'RELATED_TO_MAJOR', record_id, md5('Major|' || major) FROM posting
  UNION ALL SELECT DISTINCT 'ROLE_REQUIRES_SKILL', md5('JobRole|' || role), md5('Skill|' || skill) FROM asked
), monthly_role AS (
  SELECT role, year(posted_on) * 12 + month(posted_on) - 1 AS m, count(*) AS postings FROM posting GROUP BY ALL
), monthly_skill AS (
  SELECT skill, year(posted_on) * 12 + month(posted_on) - 1 AS m, count(*) AS postings FROM asked GROUP BY ALL
), every_role AS (
  SELECT role, m, coalesce(postings, 0) AS postings
  FROM (SELECT role, unnest(range(min(m), max(m) + 1)) AS m FROM monthly_role GROUP BY role) LEFT JOIN monthly_role USING (role, m)
), every_skill AS (
  SELECT skill, m, coalesce(postings, 0) AS postings
  FROM (SELECT skill, unnest(range(min(m), max(m) + 1)) AS m FROM monthly_skill GROUP BY skill) LEFT JOIN monthly_skill USING (skill, m)
), pair AS (
  SELECT a.skill AS skill_a, b.skill AS skill_b, count(*) AS postings
  FROM job_skill a JOIN job_skill b ON a.record_id = b.record_id AND a.skill < b.skill GROUP BY ALL
), neighbour AS (
  SELECT skill_a AS skill, skill_b AS other, postings FROM pair
  UNION ALL SELECT skill_b, skill_a, postings FROM pair
)
"""

RAW = "record_id, source, raw_title, raw_city, company, major, salary_text, req_text, description"
RAW_ALL = f"SELECT {RAW}, CAST(posted_on AS VARCHAR) AS posted_on FROM posting_raw"
MONTH_NAME = "printf('%04d-%02d', m // 12, m % 12 + 1)"
COVERAGE = """CAST(sum(before) AS BIGINT) AS rows_before, CAST(sum(after) AS BIGINT) AS rows_after,
  CAST(sum(before) - sum(after) AS BIGINT) AS rows_removed,
  round(100 * CAST(sum(skill) AS DOUBLE) / sum(after), 1) AS skill_pct,
  round(100 * CAST(sum(salary) AS DOUBLE) / sum(after), 1) AS salary_pct,
  round(100 * CAST(sum(text) AS DOUBLE) / sum(after), 1) AS description_pct"""
COVERED = """(SELECT v.source, 1 AS before, CAST(p.record_id IS NOT NULL AS INTEGER) AS after,
    CAST(coalesce(p.skills, '') <> '' AS INTEGER) AS skill, CAST(p.salary_min IS NOT NULL AS INTEGER) AS salary,
    CAST(coalesce(p.has_description, false) AS INTEGER) AS text
  FROM valid v LEFT JOIN posting p USING (record_id))"""


def top(keys: str, name: str, n: int) -> str:
    """The ``n`` most frequent names for each of the keys."""
    return (
        f"SELECT * FROM (SELECT {keys}, {name}, count(*) AS postings FROM asked GROUP BY ALL) "
        f"QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY postings DESC, {name}) <= {n}"
    )


def nodes_of(kind: str) -> str:
    return f"SELECT id, name FROM nodes WHERE kind = '{kind}'"


def edges_of(kind: str) -> str:
    return f"SELECT src_id, dst_id FROM edges WHERE kind = '{kind}'"


def completeness() -> str:
    columns = [*RAW.split(", "), "posted_on"]
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS rows, count(*) - count({c}) AS nulls, "
        f"CAST(count(*) FILTER (trim(CAST({c} AS VARCHAR)) = '') AS BIGINT) AS blanks, "
        f"count(DISTINCT {c}) AS distinct_values FROM posting_raw"
        for c in columns
    )


def pagerank(steps: int) -> str:
    parts = [
        "links AS (SELECT skill, other, CAST(postings AS DOUBLE) / sum(postings) OVER (PARTITION BY skill) AS weight FROM neighbour)",
        "rank_0 AS (SELECT DISTINCT skill, 1e0 / (SELECT count(DISTINCT skill) FROM neighbour) AS rank FROM neighbour)",
    ]
    for i in range(1, steps + 1):
        parts.append(
            f"rank_{i} AS (SELECT other AS skill, 0.15e0 / (SELECT count(*) FROM rank_0) + 0.85e0 * sum(rank * weight) AS rank "
            f"FROM links JOIN rank_{i - 1} USING (skill) GROUP BY other)"
        )
    return ", " + ", ".join(parts) + f" SELECT skill, round(rank, 9) AS rank FROM rank_{steps}"


MAX_ITEMS = 8  # more skills than any posting of the given tables has


def rules(min_support: float, min_confidence: float) -> str:
    """Rules out of the counts of all sets of skills that some posting holds."""
    steps = [", set1 AS (SELECT record_id, [skill] AS items, skill AS last FROM job_skill)"]
    for k in range(1, MAX_ITEMS):
        steps.append(f"set{k + 1} AS (SELECT record_id, list_append(items, skill) AS items, skill AS last FROM set{k} JOIN job_skill USING (record_id) WHERE skill > last)")
    every = " UNION ALL ".join(f"SELECT items FROM set{k}" for k in range(1, MAX_ITEMS + 1))
    steps.append(f"frequent AS (SELECT items, count(*) AS postings FROM ({every}) GROUP BY items HAVING count(*) >= ceil({min_support} * (SELECT n FROM total)))")
    steps.append("split AS (SELECT items, postings, unnest(items) AS consequent FROM frequent WHERE len(items) > 1)")
    steps.append("rule AS (SELECT list_filter(items, lambda x: x <> consequent) AS antecedent, consequent, postings FROM split)")
    return ", ".join(steps) + f"""
        SELECT array_to_string(antecedent, ',') AS antecedent, consequent, round(CAST(r.postings AS DOUBLE) / a.postings, 9) AS confidence,
          round(CAST(r.postings AS DOUBLE) / a.postings / (b.postings / n), 9) AS lift, round(r.postings / n, 9) AS support
        FROM rule r JOIN frequent a ON a.items = antecedent JOIN skill_freq b ON b.skill = consequent, total
        WHERE CAST(r.postings AS DOUBLE) / a.postings >= {min_confidence}"""


def forecast(source: str, key: str) -> str:
    """Least squares with zeros put in for the months that lack postings."""
    return f"""SELECT {key} AS name, CAST(h AS BIGINT) AS months_ahead,
      greatest(0e0, (y - slope * x) / n + slope * (n - 1 + h)) AS expected_postings
    FROM (
      SELECT {key}, y, n, n * (n - 1) / 2 AS x,
        (n * xy - (n * (n - 1) / 2) * y) / (n * ((n - 1) * n * (2 * n - 1) / 6) - (n * (n - 1) / 2) * (n * (n - 1) / 2)) AS slope
      FROM (
        SELECT {key}, CAST(sum(postings) AS BIGINT) AS y, CAST(sum((m - lo) * postings) AS BIGINT) AS xy,
          CAST(any_value(hi - lo + 1) AS DOUBLE) AS n
        FROM {source}, (SELECT min(m) AS lo, max(m) AS hi FROM {source}) GROUP BY {key}
      )
    ), (VALUES (1), (2), (3)) AS ahead(h)"""


def heat(size: int, starts: str) -> str:
    return f"""SELECT CAST(w AS VARCHAR) AS window_start, CAST(w + INTERVAL {size} DAY AS VARCHAR) AS window_end,
      event_type AS raw_title, count(*) AS postings
    FROM (SELECT event_type, unnest({starts}) AS w FROM events) GROUP BY ALL"""


# Two-day windows that slide by one day start on every day.
GRAPH_ROWS = """SELECT 'JobPosting' AS kind, record_id AS src_id, title AS dst_id, role, city, CAST(posted_on AS VARCHAR) AS posted_on,
    CAST(NULL AS DOUBLE) AS postings FROM posting
  UNION ALL SELECT kind, id, name, NULL, NULL, NULL, NULL FROM nodes WHERE kind <> 'JobPosting'
  UNION ALL SELECT kind, src_id, dst_id, NULL, NULL, NULL, NULL FROM edges WHERE kind <> 'ROLE_REQUIRES_SKILL'
  UNION ALL SELECT 'ROLE_REQUIRES_SKILL', md5('JobRole|' || role), md5('Skill|' || skill), NULL, NULL, NULL, count(*) FROM asked GROUP BY role, skill"""
GOLD_MEASURES = ("postings", "share", "rank", "n", "salary_min", "salary_max", "mean_mid", "median_mid", "companies", "cities")


def gold_rows(table: str, key: str, skill: str, own: str) -> str:
    measures = ", ".join(f"CAST({m if m in own.split() else 'NULL'} AS DOUBLE) AS {m}" for m in GOLD_MEASURES)
    return f"SELECT '{table}' AS table_name, {key} AS key, CAST({skill} AS VARCHAR) AS skill, {measures} FROM {table}"


ALL_GOLD = " UNION ALL ".join(
    [
        gold_rows("job_skill", "record_id", "skill", ""),
        gold_rows("skill_freq", "skill", "NULL", "postings share rank"),
        gold_rows("city_salary", "city", "NULL", "n salary_min salary_max mean_mid median_mid"),
        gold_rows("role_demand", "role", "NULL", "postings share companies cities"),
    ]
)
EVENT_DAY = "date_trunc('day', ts)"
FROM_BASE = {
    "read_source": f"SELECT * REPLACE (split_part(record_id, ':', 2) AS record_id) FROM ({RAW_ALL})",
    "file_census": "SELECT source, CAST(2 AS BIGINT) AS files, count(*) AS rows FROM posting_raw GROUP BY source",
    "fuse_sources": RAW_ALL,
    "unified_csv_roundtrip": RAW_ALL,
    "layer_roundtrip": RAW_ALL,
    "warehouse_roundtrip": """SELECT posted_month, source, count(*) AS postings, count(salary_min) AS with_salary
        FROM posting GROUP BY ALL""",
    "warehouse_views": """SELECT role, d.postings, d.share, count(*) AS skills, max(s.postings) AS top_skill_postings
        FROM role_demand d JOIN (SELECT role, skill, count(*) AS postings FROM asked GROUP BY ALL) s USING (role) GROUP BY ALL""",
    "jdbc_roundtrip": """SELECT 'job_skill' AS table_name, record_id || ':' || skill AS name, CAST(1 AS BIGINT) AS postings FROM job_skill
        UNION ALL SELECT 'skill_freq', skill, postings FROM skill_freq
        UNION ALL SELECT 'city_salary', city, n FROM city_salary
        UNION ALL SELECT 'role_demand', role, postings FROM role_demand""",
    "graph_export_roundtrip": f"SELECT * FROM ({GRAPH_ROWS})",
    "graph_merge": f"SELECT *, CAST(0 AS BIGINT) AS second_load FROM ({GRAPH_ROWS})",
    "dangling_edges": """, part AS (SELECT * FROM posting WHERE source = 'src_a'), part_node AS (
          SELECT record_id AS id FROM part UNION ALL SELECT md5('JobRole|' || role) FROM part
          UNION ALL SELECT md5('City|' || city) FROM part UNION ALL SELECT md5('Company|' || company) FROM part
          UNION ALL SELECT md5('Major|' || major) FROM part
          UNION ALL SELECT md5('Skill|' || skill) FROM asked WHERE source = 'src_a')
        SELECT kind, 'src_id' AS missing_end, src_id, dst_id FROM edges WHERE src_id NOT IN (SELECT id FROM part_node)
        UNION ALL SELECT kind, 'dst_id', src_id, dst_id FROM edges WHERE dst_id NOT IN (SELECT id FROM part_node)""",
    "run_summary": f"SELECT (SELECT count(*) FROM posting_raw) AS rows_collected, CAST(6 AS BIGINT) AS files, {COVERAGE} FROM {COVERED}",
    "valid_rows": "SELECT record_id, source, raw_title, company FROM valid",
    "standardize_role": f"SELECT record_id, raw_title, {ROLE_OF} AS role FROM posting_raw",
    "standardize_city": f"SELECT record_id, raw_city, {CITY_OF} AS city FROM posting_raw",
    "parse_salary": f"""SELECT record_id, salary_text, {monthly(1)} AS salary_min, {monthly(2)} AS salary_max,
        {SALARY_MONTHS} AS salary_months FROM posting_raw""",
    "extract_education": f"""SELECT record_id, req_text, {EDUCATION_OF} AS education, {EDUCATION_RANK_OF} AS education_rank
        FROM posting_raw""",
    "extract_experience": f"""SELECT record_id, req_text, {EXP_MIN_OF} AS exp_min_years, {EXP_MAX_OF} AS exp_max_years
        FROM posting_raw""",
    "extract_skills_phrase": "SELECT record_id, coalesce(skills, '') AS skills FROM posting_raw LEFT JOIN skill_list USING (record_id)",
    "lineage": "SELECT record_id, source, batch_id, source AS source_folder FROM bronze",
    "fingerprint": "SELECT record_id, fingerprint FROM bronze",
    "dedup": f"SELECT {RAW}, CAST(posted_on AS VARCHAR) AS posted_on, fingerprint FROM survivor",
    "dedup_audit": """SELECT v.source, count(*) AS rows_before, count(s.record_id) AS rows_after,
        count(*) - count(s.record_id) AS rows_removed
        FROM valid v LEFT JOIN survivor s USING (record_id) GROUP BY GROUPING SETS ((v.source), ())""",
    "postings_with_skill": "SELECT record_id, role, city, skill FROM asked",
    "posting_with_text": """SELECT record_id, role, raw_title, description, req_text
        FROM posting LEFT JOIN posting_text USING (record_id)""",
    "having_any_skill": "SELECT DISTINCT record_id, role, city FROM asked WHERE skill IN ('rod', 'bolt', 'blue gizmo')",
    "having_all_skills": """SELECT record_id, role, city FROM asked WHERE skill IN ('rod', 'bolt')
        GROUP BY ALL HAVING count(DISTINCT skill) = 2""",
    "postings_without_skill": "SELECT record_id, source, role, city FROM posting ANTI JOIN job_skill USING (record_id)",
    "upsert": """SELECT record_id, source, role, salary_min, CASE WHEN source = 'src_a' THEN salary_max ELSE salary_max + 1000 END AS salary_max
        FROM posting""",
    "bronze": f"SELECT {RAW}, CAST(posted_on AS VARCHAR) AS posted_on, batch_id, fingerprint, source AS source_folder FROM bronze",
    "silver_posting": "SELECT * REPLACE (CAST(posted_on AS VARCHAR) AS posted_on) FROM posting",
    "silver_two_batches": "SELECT * REPLACE (CAST(posted_on AS VARCHAR) AS posted_on) FROM posting",
    "silver_text": "SELECT * FROM posting_text",
    "gold_job_skill": "SELECT * FROM job_skill",
    "gold_skill_freq": "SELECT * FROM skill_freq",
    "gold_city_salary": "SELECT * FROM city_salary",
    "gold_role_demand": "SELECT * FROM role_demand",
    "gold_refresh": ALL_GOLD,
    "quality_report": f"SELECT source, CAST(if(source IS NULL, 6, 2) AS BIGINT) AS files, {COVERAGE} FROM {COVERED} GROUP BY GROUPING SETS ((source), ())",
    "completeness": completeness(),
    "nodes_job_posting": "SELECT record_id AS id, title AS name, role, city, CAST(posted_on AS VARCHAR) AS posted_on FROM posting",
    "nodes_job_role": nodes_of("JobRole"),
    "nodes_skill": nodes_of("Skill"),
    "nodes_city": nodes_of("City"),
    "nodes_company": nodes_of("Company"),
    "nodes_major": nodes_of("Major"),
    "rel_belongs_to_role": edges_of("BELONGS_TO_ROLE"),
    "rel_located_in": edges_of("LOCATED_IN"),
    "rel_posted_by": edges_of("POSTED_BY"),
    "rel_requires": edges_of("REQUIRES"),
    "rel_related_to_major": edges_of("RELATED_TO_MAJOR"),
    "rel_role_requires_skill": f"""SELECT md5('JobRole|' || role) AS src_id, md5('Skill|' || skill) AS dst_id, postings
        FROM ({top('role', 'skill', 10)}) WHERE postings >= 30""",
    "node_counts": "SELECT kind, count(*) AS n FROM nodes GROUP BY kind",
    "edge_counts": "SELECT kind, count(*) AS n FROM edges GROUP BY kind",
    "overview": """SELECT 'nodes' AS section, kind AS name, CAST(count(*) AS DOUBLE) AS value FROM nodes GROUP BY kind
        UNION ALL SELECT 'edges', kind, CAST(count(*) AS DOUBLE) FROM edges GROUP BY kind
        UNION ALL SELECT 'hot_roles', role, CAST(postings AS DOUBLE)
          FROM (SELECT role, postings FROM role_demand ORDER BY postings DESC, role LIMIT 10)
        UNION ALL SELECT 'hot_skills', skill, CAST(postings AS DOUBLE)
          FROM (SELECT skill, postings FROM skill_freq ORDER BY postings DESC, skill LIMIT 10)""",
    "job_roles": "SELECT role, postings FROM role_demand",
    "role_detail": """, own AS (SELECT * FROM posting WHERE role = 'priority')
        SELECT 'summary' AS section, 'postings' AS name, CAST(count(*) AS DOUBLE) AS value FROM own
        UNION ALL SELECT 'summary', 'companies', CAST(count(DISTINCT company) AS DOUBLE) FROM own
        UNION ALL SELECT 'summary', 'cities', CAST(count(DISTINCT city) AS DOUBLE) FROM own
        UNION ALL SELECT 'summary', 'salary_min', CAST(min(salary_min) AS DOUBLE) FROM own
        UNION ALL SELECT 'summary', 'salary_max', CAST(max(salary_max) AS DOUBLE) FROM own
        UNION ALL SELECT 'summary', 'salary_mean',
          CAST(sum(CAST((salary_min + salary_max) / 2e0 AS DECIMAL(18, 2))) AS DOUBLE) / count(salary_min) FROM own
        UNION ALL SELECT 'skills', skill, CAST(n AS DOUBLE) FROM (
          SELECT skill, count(*) AS n FROM asked WHERE role = 'priority' GROUP BY skill)""",
    "job_postings": """SELECT record_id, title, role, city, company, major, salary_min, salary_max, CAST(posted_on AS VARCHAR) AS posted_on
        FROM posting WHERE role = 'priority' AND major = 'MACHINERY'
          AND record_id IN (SELECT record_id FROM job_skill WHERE skill = 'rod')
        ORDER BY posting.posted_on DESC, record_id LIMIT 20 OFFSET 20""",
    "job_posting_detail": """SELECT p.* EXCLUDE (fingerprint) REPLACE (CAST(posted_on AS VARCHAR) AS posted_on),
        raw_title, description, salary_text, req_text
        FROM posting p JOIN posting_text t USING (record_id) WHERE record_id = 'src_c:998'""",
    "skills": "SELECT skill, postings FROM skill_freq",
    "cities": "SELECT city, count(*) AS postings FROM posting GROUP BY city",
    "majors": "SELECT major, count(*) AS postings FROM posting GROUP BY major",
    "role_skills": top("role", "skill", 3),
    "skill_roles": "SELECT skill, role, count(*) AS postings FROM asked GROUP BY ALL",
    "city_skills": top("city", "skill", 5),
    "role_cities": """SELECT role, city, count(*) AS postings,
        CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY role) AS share FROM posting GROUP BY role, city""",
    "role_city_skills": "SELECT role, city, skill, count(*) AS postings FROM asked GROUP BY ALL",
    "major_roles": "SELECT major, role, count(*) AS postings FROM posting GROUP BY ALL",
    "role_subgraph": """SELECT 'JobRole' AS src_kind, 'priority' AS src, rel, dst_kind, dst, weight FROM (
          SELECT 'ROLE_REQUIRES_SKILL' AS rel, 'Skill' AS dst_kind, skill AS dst, count(*) AS weight FROM asked WHERE role = 'priority' GROUP BY skill
          UNION ALL SELECT 'LOCATED_IN', 'City', city, count(*) FROM posting WHERE role = 'priority' GROUP BY city
          UNION ALL SELECT 'RELATED_TO_MAJOR', 'Major', major, count(*) FROM posting WHERE role = 'priority' GROUP BY major)""",
    "skill_graph": """SELECT 'JobRole' AS src_kind, role AS src, 'ROLE_REQUIRES_SKILL' AS rel, 'Skill' AS dst_kind, 'rod' AS dst, count(*) AS weight
          FROM asked WHERE skill = 'rod' GROUP BY role
        UNION ALL SELECT 'Major', major, 'RELATED_TO_ROLE', 'JobRole', role, count(*) FROM asked WHERE skill = 'rod' GROUP BY major, role""",
    "search": """SELECT kind, id, name, CAST(match AS BIGINT) AS match FROM (
          SELECT *, CASE WHEN lower(name) = 'an' THEN 0 WHEN lower(name) LIKE 'an%' THEN 1 WHEN lower(name) LIKE '%an%' THEN 2 END AS match FROM nodes)
        WHERE match IS NOT NULL""",
    "role_trend": f"""SELECT role, {MONTH_NAME} AS month, postings, CAST(prior AS BIGINT) AS prior_postings, CAST(postings - prior AS BIGINT) AS change
        FROM (SELECT a.*, CASE WHEN a.m > min(a.m) OVER (PARTITION BY a.role) THEN coalesce(b.postings, 0) END AS prior
          FROM every_role a LEFT JOIN every_role b ON b.role = a.role AND b.m = a.m - 1)""",
    "skill_trend": f"""SELECT a.skill, {MONTH_NAME.replace('m //', 'a.m //').replace('m %', 'a.m %')} AS month, a.postings, CAST(sum(b.postings) AS BIGINT) AS postings_3m
        FROM every_skill a JOIN every_skill b ON b.skill = a.skill AND b.m BETWEEN a.m - 2 AND a.m GROUP BY ALL""",
    "city_comparison": """SELECT city, count(*) AS postings, count(DISTINCT role) AS roles, count(DISTINCT company) AS companies,
        CAST(sum(CAST((salary_min + salary_max) / 2e0 AS DECIMAL(18, 2))) AS DOUBLE) / nullif(count(salary_min), 0) AS mean_mid
        FROM posting GROUP BY city""",
    "city_role_matrix": """SELECT city, role, count(*) AS postings,
        CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY city) AS share FROM posting GROUP BY city, role""",
    "city_skill_diff": """SELECT skill, postings_a, postings_b, postings_a - postings_b AS difference FROM (
        SELECT skill, count(*) FILTER (city = 'NATION_3') AS postings_a, count(*) FILTER (city = 'NATION_7') AS postings_b
        FROM asked WHERE city IN ('NATION_3', 'NATION_7') GROUP BY skill)""",
    "city_distribution": """SELECT city, count(*) AS postings, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () AS share
        FROM posting GROUP BY city""",
    "stream_clean": "SELECT * REPLACE (CAST(posted_on AS VARCHAR) AS posted_on) FROM refined",
    "stream_dedup": "SELECT DISTINCT fingerprint FROM bronze",
    "skill_cooccurrence": """SELECT skill_a, skill_b, p.postings,
        CAST(p.postings AS DOUBLE) / (a.postings + b.postings - p.postings) AS jaccard,
        CAST(p.postings AS DOUBLE) * (SELECT count(*) FROM posting) / (CAST(a.postings AS DOUBLE) * b.postings) AS lift
        FROM pair p JOIN skill_freq a ON a.skill = skill_a JOIN skill_freq b ON b.skill = skill_b""",
    "skill_rules": rules(0.004, 0.05),
    "core_skills": """SELECT skill, count(*) AS degree, CAST(sum(postings) AS BIGINT) AS weighted_degree
        FROM neighbour GROUP BY skill""",
    "skill_pagerank": pagerank(6),
    "role_similarity": """, vec AS (SELECT role, skill, count(*) AS n FROM asked GROUP BY ALL),
        size AS (SELECT role, count(*) AS k, CAST(sum(n * n) AS DOUBLE) AS q FROM vec GROUP BY role)
        SELECT role_a, role_b, shared_skills, CAST(shared_skills AS DOUBLE) / (a.k + b.k - shared_skills) AS jaccard,
          dot / sqrt(a.q * b.q) AS cosine
        FROM (SELECT x.role AS role_a, y.role AS role_b, count(*) AS shared_skills, CAST(sum(x.n * y.n) AS DOUBLE) AS dot
          FROM vec x JOIN vec y ON x.skill = y.skill AND x.role < y.role GROUP BY ALL)
        JOIN size a ON a.role = role_a JOIN size b ON b.role = role_b""",
    "recommend_skills": """, own AS (SELECT skill, count(*) AS role_postings FROM asked
          WHERE role = 'priority' AND skill NOT IN ('rod', 'red plate') GROUP BY skill)
        SELECT skill, role_postings, s AS share, s / f.share AS lift, s * (s / f.share) AS score
        FROM (SELECT *, CAST(role_postings AS DOUBLE) / (SELECT count(*) FROM posting WHERE role = 'priority') AS s FROM own)
        JOIN skill_freq f USING (skill)""",
    "demand_forecast": forecast("monthly_role", "role") + " UNION ALL " + forecast("monthly_skill", "skill"),
}

FROM_TABLES = {
    "normalize_text": f"SELECT doc_id, {norm('text')} AS text, {norm('source')} AS source FROM documents",
    "extract_skills_token": rf"""WITH word AS (
          SELECT DISTINCT doc_id, unnest(regexp_extract_all({norm('text')}, '[\p{{Latin}}0-9+#]+(\.[\p{{Latin}}0-9+#]+)*')) AS alias
          FROM documents
        ), hit AS (
          SELECT DISTINCT doc_id, CASE WHEN alias IN ('le', 'la') THEN 'les' ELSE alias END AS skill FROM word
          WHERE alias IN ('the', 'and', 'that', 'que', 'les', 'der', 'und', 'los', 'with', 'en', 'le', 'la')
        )
        SELECT doc_id, coalesce(string_agg(skill, ',' ORDER BY skill), '') AS skills
        FROM documents LEFT JOIN hit USING (doc_id) GROUP BY doc_id""",
    "extract_skills_dictionary": rf"""WITH alias(skill, body) AS (
          VALUES ('apache license', 'apache license'), ('cc by-nc', 'cc by-nc'), ('4.0', '4\.0'), ('and/or', 'and/or'), ('que', 'que'), ('los', 'los')
        ), hit AS (
          SELECT doc_id, skill FROM documents, alias WHERE regexp_matches({norm('text')},
            '(^|[^.\p{{Latin}}0-9+#]|(^|[^\p{{Latin}}0-9+#])\.)(' || body || ')($|[^.\p{{Latin}}0-9+#]|\.($|[^\p{{Latin}}0-9+#]))')
        )
        SELECT doc_id, coalesce(string_agg(skill, ',' ORDER BY skill), '') AS skills
        FROM documents LEFT JOIN hit USING (doc_id) GROUP BY doc_id""",
    "stream_source": """SELECT CAST(event_id AS VARCHAR) AS record_id, CAST(ts AS VARCHAR) AS posted_at,
        'company-' || user_id AS company, event_type AS raw_title, json_extract_string(props, '$.k') AS skill FROM events""",
    "stream_heat_tumbling": heat(1, f"[{EVENT_DAY}]"),
    "stream_heat_sliding": heat(2, f"[{EVENT_DAY}, {EVENT_DAY} - INTERVAL 1 DAY]"),
    "stream_upsert": """SELECT CAST(event_id AS VARCHAR) AS record_id, CAST(ts AS VARCHAR) AS posted_at,
        'company-' || user_id AS company, event_type AS raw_title, json_extract_string(props, '$.k') AS skill
        FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, CAST(event_id AS VARCHAR) DESC) = 1""",
}

# Whole numbers that may be NULL are compared as DOUBLE.
for _name, _columns in NULLABLE_NUMBERS.items():
    _casts = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in _columns)
    FROM_BASE[_name] = f"SELECT * REPLACE ({_casts}) FROM ({FROM_BASE[_name]})"

ORACLE_SQL = {name: BASE + sql for name, sql in FROM_BASE.items()} | FROM_TABLES
