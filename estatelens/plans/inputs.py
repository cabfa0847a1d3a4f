"""Inputs of the library's operators made from the driver's tables, in SQL that Spark and DuckDB both read."""

#: A line's id as the SQL of the inputs has it: within order 5,764,607 it outgrows 64 bits, and the SQL fails by overflow.
LINE_ID = "((l_orderkey * 8 + l_linenumber) * 20000 + l_partkey % 20000) * 10000000 + CAST(round(l_extendedprice * 100) AS BIGINT) % 10000000"
_REST = "(l_partkey % 20000 * 10000000 + CAST(round(l_extendedprice * 100) AS BIGINT) % 10000000)"
_KEY = "(shiftleft(l_orderkey, 3) + l_linenumber)"
_LOW = (1 << 26) - 1
#: The key times 48,828,125 in its low 52 bits, from two halves of the key, so that no step outgrows 64 bits whatever the key.
_PRODUCT = f"(({_KEY} & {_LOW}) * 48828125 + shiftleft(((shiftright({_KEY}, 26) & {_LOW}) * 48828125) & {_LOW}, 26))"
#: The same id for Spark, of which the low 64 bits are kept where it doesn't fit: 2 * 10^11 is 48,828,125 * 2^12, and shifts don't overflow.
WIDE_LINE_ID = f"(shiftleft({_PRODUCT} + shiftright({_REST}, 12), 12) | ({_REST} & 4095))"

INPUTS = {
    "objects": """
        SELECT 1 AS assessment_id, s_suppkey AS id, s_name AS object_name, 'SUPPLIER' AS object_type FROM supplier
        UNION ALL SELECT 1, s_suppkey + 1000000, s_name, 'CUSTOMER' FROM supplier WHERE s_suppkey % 10 = 0
        UNION ALL SELECT 1, s_suppkey + 2000000, s_name, 'SUPPLIER' FROM supplier WHERE s_suppkey % 25 = 0""",
    "records": f"""
        SELECT 1 AS assessment_id, {LINE_ID} AS id, l_orderkey % 20 AS dataset_id, l_orderkey AS order_id, l_linenumber AS line,
               CASE WHEN l_linenumber = 7 THEN NULL WHEN l_quantity < 3 THEN '  ' WHEN l_linenumber = 6 THEN concat('Part#', CAST(l_partkey AS VARCHAR(20)))
                    ELSE concat(' supplier#', lpad(CAST(l_suppkey AS VARCHAR(20)), 9, '0'), ' ') END AS object_name,
               CASE WHEN l_returnflag = 'R' THEN 'supplier' WHEN l_returnflag = 'A' THEN 'report' ELSE '' END AS object_type,
               CASE WHEN l_linestatus = 'O' THEN 'USAGE_SIGNAL' WHEN l_linenumber = 1 THEN 'SOURCE_CODE' WHEN l_linenumber = 2 THEN 'OTHER' ELSE 'PROCESS_KPI' END AS capability,
               CASE WHEN l_returnflag = 'R' THEN 'Unused' WHEN l_returnflag = 'A' THEN 'Normally Used' ELSE NULL END AS usage_level
        FROM lineitem""",
    "parts": """
        SELECT CAST(1 + p_partkey % 3 AS INT) AS assessment_id, p_partkey AS id,
               CASE WHEN p_partkey % 4 = 0 THEN concat('Z', p_name, CAST(p_partkey AS VARCHAR(20))) WHEN p_partkey % 4 = 1 THEN concat('y', p_name) WHEN p_partkey % 4 = 2 THEN concat('/', p_name) ELSE p_name END AS object_name,
               p_type AS object_type, CAST(p_size % 5 AS BIGINT) AS source_file_id,
               CASE WHEN p_size % 6 = 0 THEN NULL ELSE CAST(substring(p_brand, 7, 2) AS BIGINT) END AS application_id
        FROM part""",
    "apps": """
        SELECT DISTINCT CAST(substring(p_brand, 7, 2) AS BIGINT) AS id, CAST(1 AS INT) AS assessment_id, p_brand AS name, CAST(NULL AS VARCHAR(20)) AS domain, concat('parts of ', p_brand) AS description,
               CASE WHEN CAST(substring(p_brand, 7, 2) AS BIGINT) % 7 = 0 THEN 'MERGED' ELSE 'CANDIDATE' END AS status FROM part""",
    "assessments": """
        SELECT DISTINCT CAST(substring(p_brand, 7, 2) AS BIGINT) AS application_id, CASE WHEN CAST(substring(p_brand, 7, 2) AS BIGINT) % 5 = 0 THEN NULL WHEN CAST(substring(p_brand, 7, 2) AS BIGINT) % 3 = 0 THEN 'REMEDIAR' ELSE 'MODERNIZAR' END AS recommendation,
               CASE WHEN CAST(substring(p_brand, 7, 2) AS BIGINT) % 4 = 0 THEN 'HIGH' WHEN CAST(substring(p_brand, 7, 2) AS BIGINT) % 4 = 1 THEN 'CRITICAL' ELSE 'LOW' END AS technical_risk FROM part""",
    "files": "SELECT CAST(p_size % 5 AS BIGINT) AS id, CAST(1 + p_size % 5 % 3 AS BIGINT) AS scan_id, max(p_type) AS category FROM part GROUP BY 1, 2",
    "scans": """
        SELECT o_orderkey AS id, CAST(o_custkey % 50 AS INT) AS assessment_id, CASE WHEN o_orderstatus = 'P' THEN 'FAILED' ELSE 'COMPLETED' END AS status,
               CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE o_orderdate END AS completed_at FROM orders""",
    "findings": """
        SELECT CAST(1 AS INT) AS assessment_id, event_id AS id, CASE WHEN ts < TIMESTAMP '2024-01-15 00:00:00' THEN 1 ELSE 2 END AS run_id, event_type AS check_title,
               CASE WHEN event_id % 11 = 0 THEN NULL ELSE concat('value ', CAST(user_id AS VARCHAR(20))) END AS check_message, concat('OBJ', CAST(user_id AS VARCHAR(20))) AS object_name,
               CASE WHEN event_id % 5 IN (0, 4) THEN NULL ELSE CAST(event_id % 5 AS INT) END AS priority, CASE WHEN user_id % 9 = 0 THEN NULL ELSE user_id END AS target_id,
               CASE WHEN event_id % 3 = 0 THEN 'A' WHEN event_id % 3 = 1 THEN 'T' ELSE 'F' END AS change_category, concat('REF', CAST(user_id % 13 AS VARCHAR(20))) AS referenced_object_name,
               event_id AS source_row_number FROM events""",
    "runs": "SELECT 1 AS id, CAST(1 AS INT) AS assessment_id, TIMESTAMP '2024-01-15 00:00:00' AS imported_at UNION ALL SELECT 2, 1, TIMESTAMP '2024-02-15 00:00:00'",
    "edges": "SELECT p_partkey AS src, p_partkey + 1 AS dst FROM part WHERE p_partkey % 7 <> 6 AND p_partkey + 1 IN (SELECT p_partkey FROM part)",
    "rules": """
        SELECT CAST(1 AS INT) AS assessment_id, conv_id * 100 + turn AS id, conv_id AS sap_object_id, role AS rule_type, CASE WHEN turn % 2 = 0 THEN concat('  ', text) ELSE concat(text, ' ') END AS condition,
               CAST('stop' AS VARCHAR(10)) AS action, CASE WHEN conv_id % 17 = 0 THEN 'MERGED' ELSE 'CANDIDATE' END AS status, conv_id % 5 = 0 AS user_validated, CAST(NULL AS BIGINT) AS consolidated_into_id, CAST(turn AS DOUBLE) / 10 AS confidence
        FROM conversations WHERE text IS NOT NULL
        UNION ALL
        SELECT CAST(1 AS INT), conv_id * 100 + 50 + turn, conv_id + 1000000, role, translate(replace(text, ' ', '  '), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), 'STOP ', 'CANDIDATE', conv_id % 4 = 0, CAST(NULL AS BIGINT), CAST(0.5 AS DOUBLE)
        FROM conversations WHERE text IS NOT NULL AND (conv_id + turn) % 3 = 0""",
    "sources": """
        SELECT p_partkey AS id, CASE WHEN p_partkey % 4 < 3 THEN concat('src/', p_partkey, '.abap') WHEN p_partkey % 8 = 3 THEN concat('src/t', p_partkey, '.tabl') ELSE concat('src/d', p_partkey, '.doma') END AS rel_path,
               CASE WHEN p_partkey % 4 = 0 THEN concat('* head', chr(10), 'CLASS zcl_', p_partkey, ' DEFINITION INHERITING FROM zcl_base', p_size, '.', chr(10), '  METHODS: run_', p_size, ', x.', chr(10), '  methods stop_', p_partkey % 7, '.', chr(10), 'ENDCLASS.', chr(10),
                                                       repeat(concat('  CALL FUNCTION ', chr(39), 'Z_F', p_partkey % 50, chr(39), '.', chr(10)), CAST(1 + p_size % 3 AS INT)), 'INCLUDE zinc_', p_size, '.')
                    WHEN p_partkey % 4 = 1 THEN concat('FUNCTION z_f', p_partkey % 50, '.', chr(10), '*"  IMPORTING', chr(10), '*"     VALUE(IV_', p_size, ') TYPE  STRING', chr(10), '*"  EXPORTING', chr(10), '*"     VALUE(EV_', p_partkey % 9, ') TYPE i', chr(10), 'ENDFUNCTION.')
                    WHEN p_partkey % 4 = 2 THEN concat('* c', chr(10), 'REPORT zrep_', p_partkey, '.', chr(10), 'TABLES: mara, t', p_size, '.', chr(10), 'so_m', p_size, ' p_date so_m', p_size, '.', chr(10), repeat(concat('call function ', chr(39), 'z_f', p_partkey % 50, chr(39), '.', chr(10)), CAST(p_size % 3 AS INT)), '* end')
                    WHEN p_partkey % 8 = 3 THEN concat('DDIC Table Definition: ZT_', p_partkey, chr(10), 'Table Type: TRANSP', chr(10), 'Delivery Class: A', chr(10), 'Fields:', chr(10), '  MANDT CLNT 3 Client', chr(10), '  F', p_size, ' CHAR 10 The ', p_brand)
                    ELSE concat('DDIC Domain: ZD_', p_partkey, chr(10), 'Data Type: CHAR', chr(10), 'Length: ', p_size, chr(10), 'Fixed Values:', chr(10), '  OP Open', chr(10), '  C', p_size, ' Closed ', p_brand) END AS content,
               p_size, p_brand
        FROM part""",
    "cited": "SELECT l_orderkey AS id, (l_linenumber * 100000 + l_partkey) * 10000 + l_suppkey AS pos, concat('EVD-', CAST(l_suppkey % 30 AS VARCHAR(20))) AS ref_id, l_suppkey % 30 < 20 AS known, l_returnflag FROM lineitem",
}


def with_inputs(*names: str) -> str:
    """WITH clause for DuckDB."""
    return "WITH " + ", ".join(f"{n} AS ({INPUTS[n]})" for n in names)
