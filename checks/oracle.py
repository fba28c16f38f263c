"""The same queries in SQL over the driver's tables, written for DuckDB and independent of the Spark code."""

from __future__ import annotations

import re

VIEWS = {
    "v_account": """
        SELECT c_custkey AS account_id, c_name AS account_name,
               CASE WHEN c_custkey % 13 = 0 THEN '' ELSE 'CL-' || CAST(c_custkey AS VARCHAR) END AS platform_client_id,
               CAST(c_acctbal AS DECIMAL(18,2)) AS mrr, CAST(c_acctbal * 10 AS DECIMAL(18,2)) AS tpv,
               n_name AS account_owner
        FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""",
    "v_feedback_fact": """
        SELECT 'CSI-' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS insight_id, doc_id,
               CASE WHEN doc_id % 17 = 0 THEN NULL ELSE doc_id % 150 END AS account_id,
               CASE WHEN doc_id % 7 = 0 THEN 'Other' ELSE 'Client_Feedback' END AS record_type,
               TIMESTAMP '2025-10-01 00:00:00' + to_hours(CAST(doc_id AS INT)) AS created_at,
               CASE WHEN doc_id % 31 = 0 THEN NULL ELSE source END AS subcategory,
               CASE WHEN doc_id % 29 = 0 THEN NULL WHEN doc_id % 23 = 0 THEN '  ' ELSE text END AS feedback,
               'user' || CAST(doc_id % 11 AS VARCHAR) AS created_by
        FROM documents""",
    "v_feedback": """
        SELECT f.insight_id, f.doc_id, f.created_at, f.subcategory, f.feedback, f.created_by, f.record_type,
               CASE WHEN a.account_id IS NULL THEN '' ELSE a.account_name END AS account_name,
               CASE WHEN a.account_id IS NULL THEN '' ELSE a.account_owner END AS account_owner,
               CASE WHEN a.account_id IS NULL THEN '' ELSE a.platform_client_id END AS platform_client_id,
               COALESCE(a.mrr, CAST(0 AS DECIMAL(18,2))) AS mrr, COALESCE(a.tpv, CAST(0 AS DECIMAL(18,2))) AS tpv
        FROM v_feedback_fact f LEFT JOIN v_account a ON f.account_id = a.account_id""",
    "v_scope": """
        SELECT * FROM v_feedback
        WHERE record_type = 'Client_Feedback'
          AND created_at BETWEEN TIMESTAMP '2025-10-02 00:00:00' AND (SELECT last FROM v_window)
          AND subcategory IN ('src1', 'src2', 'src3', 'src5', 'src8', 'src13')
          AND account_owner IN (SELECT n_name FROM nation WHERE CAST(substr(n_name, 8) AS INT) BETWEEN 2 AND 19)""",
    "v_window": """
        SELECT TIMESTAMP '2025-10-01 23:59:59' + to_days(CAST(max(doc_id) * 3 // 96 AS INT)) AS last FROM documents""",
    "v_mention": """
        SELECT p_name AS feature, o_custkey AS account_id, l_suppkey AS supplier_id, l_orderkey, l_linenumber,
               'req ' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR) AS sample
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    "v_account_mention": """
        SELECT m.feature, a.account_name, a.platform_client_id, a.mrr, m.sample, m.account_id, m.l_orderkey, m.l_linenumber
        FROM v_mention m JOIN v_account a ON m.account_id = a.account_id""",
    "v_once": """
        SELECT feature, account_name, platform_client_id, max(mrr) AS mrr FROM v_account_mention GROUP BY ALL""",
    "v_rollup": """
        SELECT feature, CAST(sum(mrr) AS DECIMAL(18,2)) AS total_mrr, count(*) AS account_count
        FROM v_once GROUP BY feature""",
    "v_rank": """
        SELECT row_number() OVER (ORDER BY total_mrr DESC, feature) AS rank, feature, total_mrr, account_count
        FROM v_rollup""",
    "v_labels": """
        SELECT feature, string_agg(label, ', ' ORDER BY label) AS accounts FROM v_labelled GROUP BY ALL""",
    "v_labelled": """
        SELECT *, CASE WHEN platform_client_id <> '' THEN account_name || ' (' || platform_client_id || ')'
                       ELSE account_name END AS label FROM v_once""",
    "v_samples": """
        SELECT feature, string_agg(sample, ' | ' ORDER BY sample) AS samples
        FROM (SELECT feature, sample, row_number() OVER (PARTITION BY feature ORDER BY sample) AS n
              FROM (SELECT DISTINCT feature, sample FROM v_account_mention))
        WHERE n <= 3 GROUP BY feature""",
    "v_insight": """
        SELECT feature, account_count || CASE WHEN account_count = 1 THEN ' account with $' ELSE ' accounts with $' END
               || format('{:,.2f}', CAST(total_mrr AS DOUBLE)) || ' of monthly recurring revenue asked for this. Place '
               || rank || ' by revenue, priority '
               || CASE WHEN rank <= 3 THEN 'high' WHEN rank <= 10 THEN 'medium' ELSE 'low' END || '.' AS ai_insight
        FROM v_rank""",
    "v_run_feature": """
        WITH m AS (SELECT DISTINCT supplier_id, feature, account_id, CAST(c_acctbal AS DECIMAL(18,2)) AS mrr
                   FROM v_mention JOIN customer ON account_id = c_custkey),
             a AS (SELECT supplier_id + 1 AS run_id, feature,
                          CAST(sum(mrr) AS DECIMAL(18,2)) AS total_mrr, count(*) AS account_count
                   FROM m GROUP BY supplier_id, feature)
        SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY total_mrr DESC, feature) AS rank,
               feature, total_mrr, account_count,
               'one ' || feature || ' | two' AS sample_feedbacks, 'about ' || feature AS ai_insight
        FROM a""",
    "v_run": """
        SELECT id, TIMESTAMP '2025-11-01 00:00:00' + to_days(CAST(id % 1000 AS INT)) AS created_at,
               '2025-10-01' AS start_date, '2025-12-30' AS end_date,
               CASE WHEN s_name IS NULL THEN NULL
                    WHEN id % 3 = 0 THEN '{"subcategories":["src1","' || s_name || '"],"account_owners":[],"mrr_filter":"No filter","min_mrr":0.0,"top_n":0}'
                    WHEN id % 3 = 1 THEN '{"subcategories":[],"account_owners":["' || s_name || '"],"mrr_filter":"Minimum MRR","min_mrr":' || s_acctbal || ',"top_n":0}'
                    ELSE '{"subcategories":null,"account_owners":[],"mrr_filter":"Top N accounts","min_mrr":0.0,"top_n":' || id || '}' END AS filters,
               id * 40 AS total_feedbacks,
               CASE WHEN s_name IS NOT NULL THEN id * 3 END AS unique_accounts,
               CAST(id * 1000.5 AS DECIMAL(18,2)) AS total_mrr
        FROM (SELECT s_suppkey + 1 AS id, s_name, s_acctbal FROM supplier
              UNION ALL SELECT CAST(n_nationkey + 1000001 AS BIGINT), NULL, NULL FROM nation)""",
    "v_filters": """
        SELECT id, COALESCE(array_to_string(CAST(filters->'$.subcategories' AS VARCHAR[]), ','), '') AS subcategories,
               COALESCE(array_to_string(CAST(filters->'$.account_owners' AS VARCHAR[]), ','), '') AS account_owners,
               COALESCE(filters->>'$.mrr_filter', 'No filter') AS mrr_filter,
               COALESCE(CAST(filters->>'$.min_mrr' AS DOUBLE), 0) AS min_mrr,
               COALESCE(CAST(filters->>'$.top_n' AS INT), 0) AS top_n
        FROM v_run""",
    "v_tags": """
        SELECT id, concat_ws(',', NULLIF(subcategories, ''), NULLIF(account_owners, ''),
                   CASE WHEN mrr_filter = 'Minimum MRR' AND min_mrr <> 0 THEN 'MRR >= $' || format('{:,.0f}', min_mrr)
                        WHEN mrr_filter = 'Top N accounts' AND top_n <> 0 THEN 'Top ' || top_n || ' accounts' END) AS tags
        FROM v_filters""",
    "v_words": r"""
        SELECT insight_id, account_name, platform_client_id, mrr, feedback,
               list_filter(regexp_split_to_array(lower(feedback), '[^\p{L}\p{M}\p{N}_]+'), lambda w: w <> '') AS words
        FROM v_feedback WHERE feedback IS NOT NULL AND trim(feedback, E' \t\n\r') <> ''""",
    "v_phrase": r"""
        SELECT 'item ' || item_id AS feature,
               list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{M}\p{N}_]+'), lambda w: w <> '') AS words
        FROM benchmark""",
    "v_found": """
        SELECT DISTINCT insight_id, feature, account_name, platform_client_id, mrr, substr(feedback, 1, 200) AS sample FROM v_found_text""",
    "v_found_text": """
        SELECT DISTINCT insight_id, feature, account_name, platform_client_id, mrr, feedback
        FROM v_words w JOIN v_phrase p
          ON contains(' ' || array_to_string(w.words, ' ') || ' ', ' ' || array_to_string(p.words, ' ') || ' ')""",
    # what a row of the form table says about its payload
    "v_form": """
        SELECT l_orderkey * 10 + l_linenumber AS chunk_id,
               CASE WHEN l_linenumber = 1 THEN 10 + l_orderkey % 5 ELSE l_linenumber END AS form,
               feature, account_name, platform_client_id, mrr, sample FROM v_account_mention""",
    "v_text": r"""
        SELECT insight_id, created_at, account_name, platform_client_id, mrr, feedback
        FROM v_feedback WHERE feedback IS NOT NULL AND trim(feedback, E' \t\n\r') <> ''""",
    # sentences with their places, then windows of at most 500 characters, one sentence after the other
    "v_part": r"""
        WITH RECURSIVE piece AS (
            SELECT insight_id, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS nth
            FROM (SELECT insight_id, regexp_extract_all(feedback, '(?s).*?(?:[.!?…][ \t\r\n]+|[\r\n]+)|.+') AS pieces FROM v_text)),
        placed AS (
            SELECT insight_id, nth, length(rtrim(piece, E' \t\r\n')) AS size,
                   sum(length(piece)) OVER (PARTITION BY insight_id ORDER BY nth) - length(piece) AS place FROM piece),
        sentence AS (
            SELECT insight_id, row_number() OVER (PARTITION BY insight_id ORDER BY nth) AS i, CAST(place AS BIGINT) AS place, CAST(place AS BIGINT) + size AS stop,
                   size, (size + 299) // 400 - 1 AS cuts
            FROM placed WHERE size > 0),
        fold AS (
            SELECT insight_id, i, CASE WHEN size > 500 THEN place + cuts * 400 ELSE place END AS start, stop,
                   CASE WHEN size > 500 THEN place + cuts * 400 ELSE place END AS last,
                   CASE WHEN size > 500 THEN list_transform(range(cuts), lambda k: [place + k * 400, place + k * 400 + 500]) ELSE [] END AS done
            FROM sentence WHERE i = 1
            UNION ALL
            SELECT s.insight_id, s.i,
                   CASE WHEN s.stop - f.start <= 500 THEN f.start WHEN size > 500 THEN place + cuts * 400 WHEN s.stop - f.last <= 500 THEN f.last ELSE place END,
                   s.stop,
                   CASE WHEN s.stop - f.start <= 500 THEN place WHEN size > 500 THEN place + cuts * 400 ELSE place END,
                   CASE WHEN s.stop - f.start <= 500 THEN [] WHEN size <= 500 THEN [[f.start, f.stop]]
                        ELSE list_concat([[f.start, f.stop]], list_transform(range(cuts), lambda k: [place + k * 400, place + k * 400 + 500])) END
            FROM fold f JOIN sentence s ON s.insight_id = f.insight_id AND s.i = f.i + 1)
        SELECT insight_id, w[1] AS start, w[2] AS stop, row_number() OVER (PARTITION BY insight_id ORDER BY w[1]) AS part
        FROM (SELECT insight_id, unnest(done) AS w FROM fold
              UNION ALL SELECT insight_id, [start, stop] FROM fold
              QUALIFY i = max(i) OVER (PARTITION BY insight_id))""",
    "v_line": """
        SELECT insight_id, created_at, account_name, platform_client_id, part,
               account_name || ' | ' || platform_client_id || ' | $' || format('{:,.2f}', CAST(mrr AS DOUBLE))
               || ' | ' || substr(feedback, start + 1, stop - start) AS line
        FROM v_text JOIN v_part USING (insight_id)""",
    # texts in order into chunks of 250 lines, 2000 texts by themselves
    "v_pack": """
        WITH RECURSIVE text AS (
            SELECT insight_id, row_number() OVER (ORDER BY created_at DESC, insight_id) - 1 AS n, count(*) AS lines
            FROM v_line GROUP BY insight_id, created_at),
        pack AS (
            SELECT n // 2000 AS block, n % 2000 AS i, insight_id, CAST(0 AS BIGINT) AS first, (lines - 1) // 250 AS chunk, lines - (lines - 1) // 250 * 250 AS used
            FROM text WHERE n % 2000 = 0
            UNION ALL
            SELECT block, t.n % 2000, t.insight_id, CASE WHEN used + lines <= 250 THEN chunk ELSE chunk + 1 END,
                   CASE WHEN used + lines <= 250 THEN chunk ELSE chunk + 1 + (lines - 1) // 250 END,
                   CASE WHEN used + lines <= 250 THEN used + lines ELSE lines - (lines - 1) // 250 * 250 END
            FROM pack p JOIN text t ON t.n // 2000 = p.block AND t.n % 2000 = p.i + 1)
        SELECT insight_id, first + before AS first
        FROM pack JOIN (SELECT block, coalesce(sum(max(chunk) + 1) OVER (ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
                        FROM pack GROUP BY block) USING (block)""",
    "v_chunk": """
        SELECT l.*, CAST(first + (part - 1) // 250 AS BIGINT) AS chunk_id FROM v_line l JOIN v_pack USING (insight_id)""",
    "v_call": """
        SELECT chunk_id, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY created_at DESC, insight_id, part) AS lines
        FROM v_chunk GROUP BY chunk_id""",
}

# Likeness by brute force: all pairs of word sets that share a word, with their counts.
_LIKE = r"""
    {p}_feature AS (
        SELECT feature, count(DISTINCT account_name || chr(31) || platform_client_id) AS support
        FROM ({mentions}) GROUP BY feature),
    {p}_keyed AS (
        SELECT feature, support, words, CASE WHEN len(words) > 0 THEN 'words ' || array_to_string(words, ' ')
                                      ELSE 'text ' || feature END AS set_key
        FROM (SELECT *, list_sort(list_distinct(list_filter(
                  regexp_split_to_array(lower(feature), '[^\p{{L}}\p{{M}}\p{{N}}_]+'), lambda w: w <> ''))) AS words FROM {p}_feature)),
    {p}_set AS (
        SELECT *, row_number() OVER (ORDER BY support DESC, feature) AS place
        FROM (SELECT *, row_number() OVER (PARTITION BY set_key ORDER BY support DESC, feature) AS n FROM {p}_keyed)
        WHERE n = 1),
    {p}_token AS (SELECT place, len(words) AS size, unnest(words) AS word FROM {p}_set),
    {p}_pair AS (
        SELECT b.place, a.place AS other, count(*) AS shared, any_value(a.size) + any_value(b.size) AS sizes
        FROM {p}_token a JOIN {p}_token b ON a.word = b.word AND a.place < b.place GROUP BY ALL),
    {p}_alike AS (SELECT place, other FROM {p}_pair WHERE 5 * shared >= 4 * (sizes - shared)),
    {p}_leader AS (SELECT place, min(other) AS leader FROM {p}_alike GROUP BY place),
    {p}_turn AS (SELECT place, row_number() OVER (ORDER BY place) AS turn FROM {p}_leader),
    -- one after the other: into the first before it that is alike and not merged
    {p}_greedy AS (
        SELECT 0::BIGINT AS turn, 0::BIGINT AS place, NULL::BIGINT AS head, []::BIGINT[] AS merged
        UNION ALL
        SELECT turn, place, head, CASE WHEN head IS NULL THEN merged ELSE list_append(merged, place) END
        FROM (SELECT t.turn, t.place, min(a.other) FILTER (NOT list_contains(g.merged, a.other)) AS head, any_value(g.merged) AS merged
              FROM {p}_greedy g JOIN {p}_turn t ON t.turn = g.turn + 1 JOIN {p}_alike a ON a.place = t.place GROUP BY t.turn, t.place)),
    {p}_name AS (
        SELECT k.feature, COALESCE(h.feature, s.feature) AS merged
        FROM {p}_keyed k JOIN {p}_set s ON k.set_key = s.set_key
        LEFT JOIN {p}_greedy l ON s.place = l.place
        LEFT JOIN {p}_set h ON l.head = h.place)"""

_TEXTS = "SELECT feedback AS feature, account_name, platform_client_id FROM v_words"
_FOUND = "SELECT feature, account_name, platform_client_id FROM f_asked"
_SENTENCES = r"regexp_split_to_array(feedback, '[.!?…]\s+|[\r\n]+')"
_HAS = r"regexp_matches(s, '(^|[^\p{{L}}\p{{M}}\p{{N}}_])({})($|[^\p{{L}}\p{{M}}\p{{N}}_])', 'i')"
_ASKS = f"len(list_filter({_SENTENCES}, lambda s: {_HAS.format('is the|une|und|los')} AND NOT {_HAS.format('on the|la')})) > 0"
_ASKED = f"""f_asked AS (
    SELECT DISTINCT 'topic ' || CAST(substr(feature, 6) AS INT) // 10 AS feature, account_name, platform_client_id, mrr, feedback
    FROM v_found_text WHERE {_ASKS}),"""


def _like(prefix: str, mentions: str) -> str:
    return _LIKE.format(p=prefix, mentions=mentions).strip()


_RUN_COLUMNS = "run_id, rank, feature, total_mrr, account_count, sample_feedbacks, ai_insight"
_PARSED_FILTERS = (
    """CASE WHEN filters IS NULL THEN '{"subcategories":[],"account_owners":[],"mrr_filter":"No filter","min_mrr":0.0,"top_n":0,"keyword":""}' """
    """ELSE replace(replace(filters, ':null', ':[]'), '}', ',"keyword":""}') END"""
)

# (CTEs beyond the views, SELECT)
_CARD_PARTS = """
    n AS (SELECT run_id, count(*) AS feature_count FROM {features} GROUP BY run_id),
    top AS (SELECT run_id, string_agg('#' || rank || ' ' || feature || ' $' || format('{{:,.2f}}', CAST(total_mrr AS DOUBLE))
                   || ' ' || account_count || ' accounts', '; ' ORDER BY rank) AS top_features
            FROM {features} WHERE rank <= 3 GROUP BY run_id)"""
_CARDS = """
        SELECT id, strftime(created_at, '%Y-%m-%d') AS run_date, start_date || ' to ' || end_date AS period, total_feedbacks,
               COALESCE(CAST(unique_accounts AS VARCHAR), '-') AS unique_accounts,
               '$' || format('{{:,.0f}}', CAST(total_mrr AS DOUBLE)) AS mrr_in_scope, tags,
               COALESCE(feature_count, 0) AS feature_count, COALESCE(top_features, '') AS top_features,
               greatest(COALESCE(feature_count, 0) - 3, 0) AS more_features
        FROM {runs} JOIN v_tags USING (id) LEFT JOIN n ON id = n.run_id LEFT JOIN top ON id = top.run_id"""
_SCOPE_TOP = """top AS (SELECT account_name FROM v_scope GROUP BY account_name
        ORDER BY max(mrr) DESC, account_name LIMIT 25)"""
_SCOPE = r"""
        SELECT insight_id, account_name, mrr, created_at{more} FROM v_scope
        WHERE account_name IN (SELECT account_name FROM top)
          AND regexp_matches(COALESCE(feedback, ''), '(^|[^\p{{L}}\p{{M}}\p{{N}}_])la($|[^\p{{L}}\p{{M}}\p{{N}}_])', 'i')"""

_QUERIES: dict[str, tuple[str, str]] = {
    "feedback_scan": ("", """
        SELECT account_owner, platform_client_id, account_name, mrr, tpv, insight_id, created_at, subcategory, feedback, created_by
        FROM v_scope"""),
    "feedback_scan_lists": ("", """
        SELECT account_owner, platform_client_id, account_name, mrr, tpv, insight_id, created_at, subcategory, feedback, created_by
        FROM v_scope"""),
    "flatten": ("", """
        SELECT CASE WHEN a.account_id IS NULL OR doc_id % 3 = 0 THEN '' ELSE account_owner END AS account_owner,
               CASE WHEN a.account_id IS NULL THEN '' WHEN doc_id % 5 = 0 THEN NULL ELSE platform_client_id END AS platform_client_id,
               CASE WHEN a.account_id IS NULL THEN '' ELSE account_name END AS account_name,
               CASE WHEN a.account_id IS NULL OR doc_id % 19 = 0 THEN CAST(0 AS DECIMAL(18,2)) ELSE mrr END AS mrr,
               COALESCE(tpv, CAST(0 AS DECIMAL(18,2))) AS tpv, insight_id,
               CASE WHEN doc_id % 37 = 0 THEN NULL ELSE created_at END AS created_at, subcategory, feedback,
               CASE WHEN doc_id % 11 = 0 THEN '' ELSE created_by END AS created_by, record_type
        FROM v_feedback_fact f LEFT JOIN v_account a ON f.account_id = a.account_id"""),
    "lookup_account": ("", "SELECT insight_id, account_name, account_owner, platform_client_id, mrr, tpv FROM v_feedback"),
    "lookup_creator": ("", """
        SELECT insight_id, COALESCE(s_name, '') AS created_by FROM v_feedback_fact LEFT JOIN supplier ON s_suppkey = doc_id % 11"""),
    "numeric_coerce": ("", """
        SELECT l_orderkey, l_linenumber, CAST(CASE l_linenumber WHEN 1 THEN q WHEN 2 THEN q * 100 WHEN 7 THEN q ELSE 0 END AS DOUBLE) AS value
        FROM (SELECT *, CAST(trunc(l_quantity) AS INT) AS q FROM lineitem)"""),
    "timestamp_coerce": ("", """
        SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F', 'O') THEN CAST(o_orderdate AS TIMESTAMP) END AS value FROM orders"""),
    "strip_nul": ("", "SELECT doc_id, text FROM documents"),
    "truncate_text": ("", "SELECT doc_id, substr(text, 1, 500) AS text FROM documents"),
    "sample_truncate": ("", "SELECT doc_id, substr(text, 1, 200) AS sample FROM documents"),
    "account_label": ("", """
        SELECT account_id, account_name || CASE WHEN platform_client_id = '' THEN '' ELSE ' (' || platform_client_id || ')' END AS label
        FROM v_account"""),
    "prompt_lines": ("", "SELECT insight_id, CAST(part AS INT) AS part, line FROM v_line"),
    "sample_split": ("", r"""
        SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, '|'), lambda x: trim(x, E' \t\n\r')),
               lambda x: x <> '')[1:3], '~') AS samples FROM documents"""),
    "money_format": ("", """
        SELECT c_custkey, format('{:,.2f}', c_acctbal) AS exact, format('{:,.0f}', c_acctbal) AS whole FROM customer"""),
    "insight_text": ("", "SELECT feature, ai_insight FROM v_insight"),
    "record_type": ("", "SELECT insight_id, record_type FROM v_feedback WHERE record_type = 'Client_Feedback'"),
    "date_range": ("", """
        SELECT insight_id, created_at FROM v_feedback
        WHERE created_at >= TIMESTAMP '2025-10-02 00:00:00' AND created_at <= (SELECT last FROM v_window)"""),
    "among_owners": ("", """
        SELECT insight_id, account_owner FROM v_feedback WHERE account_owner IN (SELECT n_name FROM nation WHERE n_nationkey % 3 = 0)"""),
    "in_subcategory": ("", """
        SELECT insight_id, subcategory FROM v_feedback WHERE record_type = 'Client_Feedback'
          AND subcategory IN ('src1', 'src2', 'src3', 'src5', 'src8', 'src13')"""),
    "in_owner": ("", """
        SELECT insight_id, account_owner FROM v_feedback WHERE record_type = 'Client_Feedback'
          AND account_owner IN (SELECT n_name FROM nation WHERE CAST(substr(n_name, 8) AS INT) BETWEEN 2 AND 19)"""),
    "conjunction": ("", "SELECT insight_id FROM v_scope"),
    "min_mrr": ("", "SELECT insight_id, account_name, mrr FROM v_feedback WHERE mrr >= 1000"),
    "top_n_accounts": ("""top AS (SELECT account_name FROM v_feedback GROUP BY account_name
        ORDER BY max(mrr) DESC, account_name LIMIT 10)""", """
        SELECT insight_id, account_name, mrr FROM v_feedback WHERE account_name IN (SELECT account_name FROM top)"""),
    "keyword_word": ("", r"""
        SELECT insight_id FROM v_feedback
        WHERE regexp_matches(COALESCE(feedback, ''), '(^|[^\p{L}\p{M}\p{N}_])ou($|[^\p{L}\p{M}\p{N}_])', 'i')"""),
    "nonblank": ("", r"SELECT insight_id FROM v_feedback WHERE trim(COALESCE(feedback, ''), E' \t\n\r') <> ''"),
    "scope": (_SCOPE_TOP, _SCOPE.format(more="")),
    "scope_totals": ("", """
        SELECT count(*) AS total_feedbacks, count(DISTINCT account_name) AS unique_accounts,
               CAST(sum(mrr) AS DECIMAL(18,2)) AS total_mrr
        FROM v_feedback WHERE record_type = 'Client_Feedback'"""),
    "filter_options": ("", """
        SELECT DISTINCT 'subcategory' AS kind, subcategory AS value FROM v_feedback
        WHERE record_type = 'Client_Feedback' AND subcategory IS NOT NULL
        UNION ALL SELECT DISTINCT 'account_owner', account_owner FROM v_feedback
        WHERE record_type = 'Client_Feedback' AND account_owner <> ''"""),
    "actionable": ("", f"SELECT insight_id FROM v_feedback WHERE {_ASKS}"),
    "actionable_default": ("", r"""
        SELECT insight_id FROM v_feedback_fact
        WHERE doc_id % 4 IN (0, 2) OR regexp_matches(COALESCE(feedback, ''), '(^|[^\p{L}\p{M}\p{N}_])(need|needs|want|wants|would like|would love|wish|add|allow|enable|support for|integrate|integration|feature|request|requests|should be able|necesita|necesitan|necesitamos|quiere|quieren|queremos|agregar|permitir|integrar|solicita|solicitan|solicitamos|funcionalidad)($|[^\p{L}\p{M}\p{N}_])', 'i')"""),
    "cue_scores": ("", r"""
        SELECT insight_id, 0.25::DOUBLE + coalesce(list_sum(list_transform(buckets, lambda b: ((b * 37) % 101 - 50) / 64.0::DOUBLE)), 0) AS score
        FROM (SELECT insight_id, list_distinct(list_transform(
                         list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])),
                         lambda run: CAST('0x' || md5(run)[1:7] AS BIGINT) % 1024)) AS buckets
              FROM (SELECT insight_id, list_filter(regexp_split_to_array(lower(COALESCE(feedback, '')), '[^\p{L}\p{M}\p{N}_]+'), lambda w: w <> '') AS words
                    FROM v_feedback))"""),
    "feature_accounts": ("", "SELECT feature, account_name, platform_client_id, mrr, label FROM v_labelled"),
    "account_labels": ("", "SELECT feature, accounts FROM v_labels"),
    "feature_rollup": ("", "SELECT feature, total_mrr, account_count FROM v_rollup"),
    "feature_samples": ("", "SELECT feature, samples FROM v_samples"),
    "feature_rank": ("", "SELECT rank, feature, total_mrr, account_count FROM v_rank"),
    "ranked_features": ("", """
        SELECT rank, feature, total_mrr, account_count, samples AS sample_feedbacks, ai_insight
        FROM v_rank JOIN v_samples USING (feature) JOIN v_insight USING (feature)"""),
    "payload_parse": ("", """
        SELECT chunk_id, CASE WHEN form IN (5, 7) THEN 'failed' ELSE 'ok' END AS status,
               CAST(CASE WHEN form IN (4, 5, 7) THEN 0 ELSE 1 END AS INT) AS feature_count,
               CASE WHEN form IN (2, 3) OR form >= 10 THEN feature WHEN form = 6 THEN 'Unknown' END AS first_feature
        FROM v_form"""),
    "payload_explode": ("", """
        SELECT chunk_id, feature, account_name, CASE WHEN form = 13 THEN '' ELSE platform_client_id END AS platform_client_id,
               CASE WHEN form IN (12, 13) THEN CAST(0 AS DECIMAL(18,2)) ELSE mrr END AS mrr, CAST(NULL AS VARCHAR) AS sample,
               CASE WHEN form = 14 THEN 'because ' || feature END AS insight
        FROM v_form WHERE form IN (2, 3) OR form >= 10
        UNION ALL SELECT chunk_id, feature, NULL, NULL, NULL, sample, CASE WHEN form = 14 THEN 'because ' || feature END
        FROM v_form WHERE form IN (2, 3) OR form >= 10
        UNION ALL SELECT chunk_id, 'Unknown', account_name, '', CAST(0 AS DECIMAL(18,2)), NULL, NULL FROM v_form WHERE form = 6"""),
    "payload_defaults": ("", """
        SELECT chunk_id, CASE WHEN form = 6 THEN 'Unknown' ELSE feature END AS feature, CAST(0 AS DOUBLE) AS total_mrr,
               CAST(1 AS BIGINT) AS account_count, CASE WHEN form = 14 THEN 'because ' || feature ELSE '' END AS insight
        FROM v_form WHERE form IN (2, 3, 6) OR form >= 10"""),
    "chunk_status": ("", """
        SELECT status, count(*) AS chunks, CAST(sum(skipped) AS BIGINT) AS skipped, CAST(sum(count(*)) OVER () AS BIGINT) AS total_chunks,
               CAST(floor(100 * count(*) / sum(count(*)) OVER ()) AS INT) AS percent
        FROM (SELECT CASE WHEN form IN (5, 7) THEN 'failed' ELSE 'ok' END AS status, CASE WHEN form = 13 THEN 2 ELSE 0 END AS skipped
              FROM v_form) GROUP BY status"""),
    "chunk_assign": ("", """
        SELECT insight_id, CAST((row_number() OVER (ORDER BY created_at DESC, insight_id) - 1) // 250 AS BIGINT) AS chunk_id
        FROM v_feedback"""),
    "extract_mentions": ("", "SELECT insight_id, feature, account_name, platform_client_id, mrr, sample FROM v_found"),
    "extract_late_phrase": ("", """
        SELECT 'late' AS feature, 'found' AS account_name, count(*) AS texts FROM v_feedback HAVING count(*) > 0"""),
    "chunk_lines": ("", "SELECT chunk_id, n_lines, md5(lines) AS lines FROM v_call"),
    "call_ledger": ("", """
        SELECT chunk_id, 'ok' AS status, length(lines) || ' characters' AS feature,
               CAST(CASE WHEN length(lines) % 3 = 0 THEN 2 ELSE 1 END AS BIGINT) AS calls FROM v_call"""),
    "call_lanes": ("", """
        SELECT chunk_id, CAST(chunk_id % 3 AS INT) AS lane, chunk_id // 6 AS wave FROM v_call"""),
    "call_progress": ("", """
        SELECT CAST(step AS INT) AS step, CAST(floor(100 * least(total, 6 * step) / total) AS INT) AS percent
        FROM (SELECT total, unnest(range((total + 5) // 6 + 1)) AS step FROM (SELECT count(*) AS total FROM v_call) WHERE total > 0)"""),
    "extract_plugin": ("", r"""
        SELECT c.chunk_id, 'listed' AS feature, l.account_name, l.platform_client_id
        FROM (SELECT DISTINCT chunk_id FROM v_chunk) c
        LEFT JOIN (SELECT DISTINCT chunk_id, account_name, platform_client_id FROM v_chunk WHERE platform_client_id <> '') l
          ON c.chunk_id = l.chunk_id"""),
    "normalize_phrase": ("", """
        SELECT canonical AS feature, account_name, sample
        FROM v_account_mention JOIN (
            SELECT p_name, min(p_name) OVER (PARTITION BY string_split(p_name, ' ')[-1]) AS canonical
            FROM (SELECT DISTINCT p_name FROM part)) ON feature = p_name"""),
    "similar_pairs": (_like("t", _TEXTS), """
        SELECT md5(s.feature) AS feature, md5(h.feature) AS similar_to
        FROM t_leader l JOIN t_set s ON l.place = s.place JOIN t_set h ON l.leader = h.place"""),
    "merge_features": (_like("t", _TEXTS), """
        SELECT md5(merged) AS feature, account_name, mrr, substr(feedback, 1, 200) AS sample
        FROM v_words JOIN t_name ON feedback = t_name.feature"""),
    "analyze": (_ASKED + _like("f", _FOUND) + """,
    m AS (SELECT merged AS feature, account_name, platform_client_id, mrr, feedback FROM f_asked JOIN f_name USING (feature)),
    once AS (SELECT feature, account_name, platform_client_id, max(mrr) AS mrr FROM m GROUP BY ALL),
    r AS (SELECT feature, CAST(sum(mrr) AS DECIMAL(18,2)) AS total_mrr, count(*) AS account_count FROM once GROUP BY feature),
    s AS (SELECT feature, string_agg(sample, ' | ' ORDER BY sample) AS sample_feedbacks
          FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY sample) AS n
                FROM (SELECT feature, substr(feedback, 1, 200) AS sample FROM (SELECT DISTINCT feature, feedback FROM m))) WHERE n <= 3 GROUP BY feature),
    k AS (SELECT *, row_number() OVER (ORDER BY total_mrr DESC, feature) AS rank FROM r)""", """
        SELECT rank, feature, total_mrr, account_count, sample_feedbacks,
               account_count || CASE WHEN account_count = 1 THEN ' account with $' ELSE ' accounts with $' END
               || format('{:,.2f}', CAST(total_mrr AS DOUBLE)) || ' of monthly recurring revenue asked for this. Place '
               || rank || ' by revenue, priority '
               || CASE WHEN rank <= 3 THEN 'high' WHEN rank <= 10 THEN 'medium' ELSE 'low' END || '.' AS ai_insight
        FROM k JOIN s USING (feature)"""),
    "run_header": ("", """
        SELECT CAST(1 AS BIGINT) AS id, TIMESTAMP '2025-12-01 00:00:00' AS created_at,
               CAST(NULL AS VARCHAR) AS start_date, CAST(NULL AS VARCHAR) AS end_date,
               '{"subcategories":["src1","src2","src3","src5","src8","src13"],"account_owners":['
               || (SELECT string_agg('"NATION_' || n || '"', ',' ORDER BY n) FROM range(2, 20) r(n))
               || '],"mrr_filter":"No filter","min_mrr":0.0,"top_n":0,"keyword":""}' AS filters,
               count(*) AS total_feedbacks, count(DISTINCT account_name) AS unique_accounts,
               CAST(COALESCE(sum(mrr), 0) AS DECIMAL(18,2)) AS total_mrr
        FROM v_feedback WHERE record_type = 'Client_Feedback'"""),
    "filters_json": ("", f"SELECT id, {_PARSED_FILTERS} AS filters FROM v_run"),
    "filters_parse": ("", "SELECT id, subcategories, account_owners, mrr_filter, min_mrr, top_n FROM v_filters"),
    "filter_tags": ("", "SELECT id, tags FROM v_tags"),
    "history_runs": ("", """
        SELECT id, created_at, start_date, end_date, filters, total_feedbacks,
               CAST(unique_accounts AS VARCHAR) AS unique_accounts, total_mrr FROM v_run"""),
    "run_features": ("", f"SELECT {_RUN_COLUMNS} FROM v_run_feature WHERE run_id = 7"),
    "save_roundtrip": ("", """
        SELECT run_id, rank, feature, total_mrr, account_count, samples AS sample_feedbacks,
               CASE WHEN run_id = 1 THEN account_count ELSE 0 END AS saved_accounts
        FROM v_rank JOIN v_samples USING (feature), (SELECT unnest([1, 3])::BIGINT AS run_id)"""),
    "cascade_delete": ("", """
        SELECT h.id, COALESCE(f.features, 0) AS features FROM (SELECT id FROM v_run WHERE COALESCE(filters, '') NOT LIKE '%Top N%') h
        LEFT JOIN (SELECT run_id, count(*) AS features FROM v_run_feature GROUP BY run_id) f ON h.id = f.run_id"""),
    "history_cards": (_CARD_PARTS.format(features="v_run_feature"), _CARDS.format(runs="v_run")),
    "history_saved_cards": (_CARD_PARTS.format(
        features="(SELECT * FROM v_run_feature WHERE rank <= 2 OR run_id % 3 <> 2 OR run_id % 10 = 0)"
    ), _CARDS.format(runs="(SELECT * FROM v_run WHERE id % 5 <> 0 OR id % 10 = 0)")),
    "scope_cached": (_SCOPE_TOP, _SCOPE.format(more=", 1 AS times_made")),
    "history_top3": ("", "SELECT run_id, rank, feature, total_mrr, account_count FROM v_run_feature WHERE rank <= 3"),
    "history_detail": ("", f"SELECT created_at, {_RUN_COLUMNS} FROM v_run_feature JOIN (SELECT id, created_at FROM v_run) ON run_id = id"),
    "csv_roundtrip": ("", """
        SELECT insight_id AS "CS Insight ID", created_at AS "Date", subcategory AS "Subcategory", feedback AS "Feedback",
               created_by AS "Created By", NULLIF(account_name, '') AS "Account Name", NULLIF(account_owner, '') AS "Account Owner",
               NULLIF(platform_client_id, '') AS "Platform Client ID", mrr AS "Real MRR Last Month", tpv AS "Last Invoiced TPV"
        FROM v_feedback"""),
    "csv_accounts": ("", """
        SELECT feature AS "Feature", account_name AS "Account Name", NULLIF(platform_client_id, '') AS "Platform Client ID",
               mrr AS "Real MRR Last Month" FROM v_once"""),
    "csv_features": ("", """
        SELECT feature AS "Feature", total_mrr AS "Total MRR", account_count AS "Account Count", accounts AS "Accounts",
               samples AS "Sample Feedbacks", ai_insight AS "AI Insight"
        FROM v_rank JOIN v_labels USING (feature) JOIN v_samples USING (feature) JOIN v_insight USING (feature)"""),
}


def _needed(text: str, seen: list[str]) -> None:
    """Views named in ``text``, each after those it needs itself."""
    for name in re.findall(r"\bv_\w+", text):
        if name in VIEWS and name not in seen:
            _needed(VIEWS[name], seen)
            seen.append(name)


def oracle_sql() -> dict[str, str]:
    out = {}
    for key, (ctes, select) in _QUERIES.items():
        views: list[str] = []
        _needed(ctes + select, views)
        parts = [f"{name} AS ({VIEWS[name].strip()})" for name in views] + ([ctes.strip()] if ctes else [])
        out[key] = (f"WITH RECURSIVE {',\n'.join(parts)}\n" if parts else "") + select.strip()
    return out
