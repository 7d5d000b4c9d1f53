"""DuckDB text of the role views, used as common table expressions by the oracle queries."""

from __future__ import annotations

_VIEWS = {
    "patients_v": """
SELECT c_custkey AS subject_id,
       CASE c_custkey % 7 WHEN 0 THEN 'U' WHEN 1 THEN 'M' WHEN 3 THEN 'M' WHEN 5 THEN 'M' ELSE 'F' END AS gender,
       CAST(20 + c_custkey % 60 AS INT) AS anchor_age,
       CAST(1990 + c_custkey % 5 AS VARCHAR) AS anchor_year,
       CASE WHEN c_custkey % 13 = 0 THEN '2001-12-31' ELSE '' END AS dod,
       c_mktsegment AS insurance, c_nationkey AS nation
FROM customer""",
    "admissions_v": """
SELECT CASE WHEN o_orderkey % 97 = 5 THEN -o_orderkey ELSE o_orderkey END AS hadm_id, o_custkey AS subject_id, o_orderdate AS admittime,
       ((o_orderdate + to_days(CAST((o_orderkey % 30 - 1) AS INTEGER)))
          + to_hours(CAST((o_orderkey % 24) AS BIGINT))) AS dischtime,
       CASE WHEN o_orderkey % 3 = 0 THEN NULL
            ELSE (o_orderdate + to_hours(CAST((-(o_orderkey % 12)) AS BIGINT))) END AS edregtime,
       CASE WHEN o_orderkey % 3 = 0 THEN NULL
            ELSE (o_orderdate + to_hours(CAST((o_orderkey % 10 - 1 - o_orderkey % 12) AS BIGINT))) END AS edouttime,
       CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS hospital_expire_flag,
       CASE o_orderkey % 12 WHEN 0 THEN 'WHITE' WHEN 1 THEN 'WHITE - OTHER EUROPEAN'
            WHEN 2 THEN 'BLACK/AFRICAN AMERICAN' WHEN 3 THEN 'ASIAN - CHINESE'
            WHEN 4 THEN 'HISPANIC/LATINO - DOMINICAN' WHEN 5 THEN 'CAUCASIAN' WHEN 6 THEN '' WHEN 7 THEN NULL
            WHEN 8 THEN 'UNABLE TO OBTAIN' WHEN 9 THEN 'PORTUGUESE' WHEN 10 THEN 'white' ELSE 'Another' END AS race,
       o_orderpriority AS admission_type,
       CASE o_orderkey % 4 WHEN 0 THEN 'English' WHEN 1 THEN 'english' WHEN 2 THEN '' ELSE 'Spanish' END AS language,
       CASE WHEN o_orderkey % 11 = 0 THEN '2001-11-30 08:30:00' ELSE '' END AS deathtime,
       CASE o_orderkey % 4 WHEN 0 THEN '1999' WHEN 1 THEN ' 1999-03-04 ' WHEN 2 THEN '1999-03-04 05:06:07'
            ELSE 'bad' END AS raw_time,
       o_totalprice AS cost
FROM orders""",
    "diagnoses_v": """
SELECT o_custkey AS subject_id, l_orderkey AS hadm_id, l_linenumber AS seq_num,
       CASE WHEN l_linestatus = 'F' THEN 'N' || CAST(p_size AS VARCHAR)
            ELSE '''' || substr(p_type, 1, 3) || '.' || CAST(p_size AS VARCHAR) || '''' END AS icd_code,
       CASE WHEN l_linestatus = 'F' THEN '9' ELSE '10' END AS icd_version
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    "gem_v": """
SELECT DISTINCT CASE WHEN p_size <= 45 AND p_type IN ('ECONOMY', 'SMALL', 'LARGE') THEN 'N' ELSE 'X' END
         || CAST(p_size AS VARCHAR) AS icd9cm,
       substr(p_type, 1, 3) || CAST(p_size AS VARCHAR) AS icd10cm, '1' AS approximate,
       CASE WHEN p_size % 10 = 0 THEN '1' ELSE '0' END AS no_map,
       CASE WHEN p_size % 7 = 0 THEN '1' ELSE '0' END AS combination
FROM part""",
    "ccs_v": """
SELECT DISTINCT '''' || CASE WHEN p_size % 17 = 0 THEN 'X' ELSE '' END || substr(p_type, 1, 3) || CAST(p_size AS VARCHAR) || '''' AS icd_code,
       '''C' || CAST(p_size % 20 AS VARCHAR) || '''' AS ccs_code,
       'group ' || CAST(p_size % 20 AS VARCHAR) AS ccs_description
FROM part""",
    "scored_v": """
SELECT l.doc_id, l.quality AS y,
       CAST((l.doc_id * 7919) % 100 AS DOUBLE) / 200
         + CASE WHEN l.quality = 1 THEN CAST(0.3 AS DOUBLE) ELSE CAST(0.2 AS DOUBLE) END AS score,
       d.lang AS grp
FROM labels l JOIN documents d ON l.doc_id = d.doc_id""",
    "predicted_v": """
SELECT l_orderkey, l_linenumber, l_extendedprice AS y, l_quantity * p_retailprice AS pred, l_returnflag AS grp
FROM lineitem JOIN part ON l_partkey = p_partkey""",
    # derived tables shared by several oracle queries
    "harmonised_v": """
SELECT subject_id, hadm_id, seq_num, icd_code, icd_version FROM diagnoses_v WHERE icd_version = '10'
UNION ALL
SELECT d.subject_id, d.hadm_id, d.seq_num, g.icd10cm AS icd_code, '10' AS icd_version
FROM diagnoses_v d LEFT JOIN gem_v g ON d.icd_code = g.icd9cm
WHERE d.icd_version = '9' AND g.no_map = '0' AND g.combination = '0'""",
    "grouped_v": """
SELECT h.subject_id, h.hadm_id, h.seq_num, h.icd_code,
       coalesce(c.ccs_code, 'Unknown_CCS') AS ccs_code, c.ccs_description
FROM harmonised_v h
LEFT JOIN ccs_v c ON trim(replace(replace(h.icd_code, '.', ''), '''', ''))
                   = trim(replace(replace(c.icd_code, '.', ''), '''', ''))""",
    "stays_v": """
SELECT *, CASE WHEN los_raw < 0 THEN 0.0 ELSE los_raw END AS "LoS",
          CASE WHEN er_raw < 0 THEN NULL ELSE er_raw END AS "ER_LoS",
          CAST(row_number() OVER w AS BIGINT) AS admission_no,
          date_diff('microsecond', lag(dischtime) OVER w, admittime) / 86400000000.0 AS days_since_discharge
FROM (SELECT a.*, date_diff('microsecond', admittime, dischtime) / CAST(86400000000.0 AS DOUBLE) AS los_raw,
             date_diff('microsecond', edregtime, edouttime) / CAST(86400000000.0 AS DOUBLE) AS er_raw,
             CAST(year(admittime) AS INT) - CAST(anchor_year AS INT) + anchor_age AS age
      FROM admissions_v a LEFT JOIN patients_v p ON a.subject_id = p.subject_id)
WINDOW w AS (PARTITION BY subject_id ORDER BY admittime ASC NULLS LAST, hadm_id)""",
}

_NEEDS = {
    "harmonised_v": ("diagnoses_v", "gem_v"),
    "grouped_v": ("harmonised_v", "ccs_v"),
    "stays_v": ("admissions_v", "patients_v"),
}


def with_views(*names: str, recursive: bool = False) -> str:
    """``WITH a AS (...), b AS (...)`` for the named views and what they read."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, ()):
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    body = ",\n".join(f"{name} AS ({_VIEWS[name]})" for name in ordered)
    return f"WITH {'RECURSIVE ' if recursive else ''}{body}\n"
