"""The same results in DuckDB SQL, written from the semantics and not from the Spark code.

"""

from __future__ import annotations

from echolens import schemas as S

AS_OF, LATER = "TIMESTAMP '2024-03-01 00:00:00'", "TIMESTAMP '2024-04-01 00:00:00'"
AS_OF_ISO, LATER_ISO = "2024-03-01T00:00:00.000Z", "2024-04-01T00:00:00.000Z"


def iso(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%dT%H:%M:%S.%gZ')"


CTES = {
    "raw": """
        SELECT 'r' || CAST(doc_id AS VARCHAR) AS id, doc_id AS n, source AS app_id, c.country AS country_code,
          s.sort_method, s.sort_ord, c.country_ord, CAST(doc_id % 10 + 1 AS INT) AS page, doc_id AS pos,
          CASE WHEN doc_id % 11 = 0 OR doc_id % 13 = 0 THEN 'Anonymous' ELSE 'user' || CAST(doc_id % 97 AS VARCHAR) END AS user_name,
          CASE WHEN doc_id % 7 = 0 THEN 'Unknown' ELSE '1.' || CAST(doc_id % 5 AS VARCHAR) END AS version,
          CAST(doc_id % 5 + 1 AS INT) AS score, substring(text, 1, 40) AS title, text,
          TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' HOUR * CAST(doc_id AS INT) AS date,
          CASE WHEN doc_id % 19 = 0 THEN NULL ELSE CAST(doc_id % 17 + s.sort_ord AS INT) END AS votes
        FROM documents
        JOIN (SELECT 'recent' AS sort_method, 0 AS sort_ord UNION ALL SELECT 'helpful', 1) s
          ON s.sort_ord = 0 OR doc_id % 3 = 0
        JOIN (SELECT 'en' AS l, 'us' AS country, 0 AS country_ord UNION ALL SELECT 'en', 'gb', 1
              UNION ALL SELECT 'fr', 'fr', 2 UNION ALL SELECT 'de', 'de', 3 UNION ALL SELECT 'es', 'es', 4
              UNION ALL SELECT DISTINCT lang, lang, 5 FROM documents WHERE lang NOT IN ('en', 'fr', 'de', 'es')) c
          ON c.l = lang AND (c.country <> 'gb' OR doc_id % 4 = 0)""",
    "reviews": """
        SELECT id, n, app_id, user_name, version, score, title, text, date, COALESCE(votes, 0) AS helpful_votes,
          upper(country_code) AS country, date_trunc('day', date) AS created_at
        FROM raw QUALIFY row_number() OVER (PARTITION BY app_id, id ORDER BY sort_ord DESC, country_ord DESC, page DESC, pos DESC) = 1""",
    "l": """
        SELECT 'r' || CAST(doc_id AS VARCHAR) AS review_id, doc_id AS ord,
          CASE WHEN doc_id % 29 = 0 THEN NULL ELSE 'theme_' || CAST(CASE WHEN toxic = 1 OR quality = 0 THEN doc_id % 5 ELSE doc_id % 15 END AS VARCHAR) END AS theme,
          CASE WHEN doc_id % 31 = 0 THEN 'mixed' WHEN toxic = 1 OR quality = 0 THEN 'negative' WHEN doc_id % 9 = 0 THEN 'neutral' ELSE 'positive' END AS sentiment,
          CASE WHEN doc_id % 23 = 0 THEN NULL ELSE CAST((doc_id * 7) % 5 + 1 AS INT) END AS severity,
          CASE WHEN doc_id % 6 = 0 THEN 'Y' ELSE 'N' END AS feature_request,
          CAST((doc_id * 37) % 101 AS DOUBLE) / 100 AS confidence
        FROM labels""",
    "a": """
        SELECT ord, review_id, COALESCE(theme, 'Unknown Theme') AS theme,
          CASE WHEN sentiment IN ('positive', 'negative') THEN sentiment ELSE 'neutral' END AS tone, sentiment,
          COALESCE(severity, 1) AS severity, feature_request FROM l""",
    "t": """
        SELECT theme, count(*) AS mentions, count(*) FILTER (tone = 'positive') AS positive,
          count(*) FILTER (tone = 'negative') AS negative, count(*) FILTER (tone = 'neutral') AS neutral,
          count(*) FILTER (feature_request = 'Y') AS requests, min(ord) AS first_ord,
          min(ord) FILTER (feature_request = 'Y') AS first_request_ord,
          COALESCE(floor(CAST(sum(severity) FILTER (tone = 'negative') AS DOUBLE) / count(*) FILTER (tone = 'negative') * 100 + 0.5) / 100, 0) AS average_severity
        FROM a GROUP BY theme""",
    "f": """
        SELECT *, mentions / (SELECT sum(mentions) FROM t) >= 0.05 AS sig, positive / mentions AS pr, negative / mentions AS nr FROM t""",
    "o": """
        SELECT sum(positive) / sum(mentions) AS pr, sum(negative) / sum(mentions) AS nr, sum(requests) AS requests, sum(mentions) AS n FROM t""",
    "swot_raw": """
        SELECT 'strengths' AS category, 0 AS sec, first_ord AS place, 'High user satisfaction with ''' || theme || ''' (' || CAST(CAST(floor(pr * 100 + 0.5) AS BIGINT) AS VARCHAR) || '% Positive of ' || mentions || ' mentions).' AS message FROM f WHERE sig AND pr >= 0.65
        UNION ALL SELECT 'weaknesses', 0, first_ord, 'Significant user dissatisfaction with ''' || theme || ''' (' || CAST(CAST(floor(nr * 100 + 0.5) AS BIGINT) AS VARCHAR) || '% Negative of ' || mentions || ' mentions, Avg Severity: ' || printf('%.2f', average_severity) || ').' FROM f WHERE sig AND nr >= 0.30
        UNION ALL SELECT 'threats', 0, first_ord, 'High severity issues reported for ''' || theme || ''' (Avg Severity: ' || printf('%.2f', average_severity) || ') could lead to user churn.' FROM f WHERE sig AND nr >= 0.30 AND average_severity >= 3.5
        UNION ALL SELECT 'strengths', 1, 0, 'Generally positive sentiment across reviews (' || CAST(CAST(floor(pr * 100 + 0.5) AS BIGINT) AS VARCHAR) || '% Positive of processed).' FROM o WHERE pr > 0.6
        UNION ALL SELECT 'weaknesses', 1, 0, 'Notable overall negative sentiment across reviews (' || CAST(CAST(floor(nr * 100 + 0.5) AS BIGINT) AS VARCHAR) || '% Negative of processed).' FROM o WHERE nr > 0.3
        UNION ALL SELECT 'opportunities', 0, 0, CASE WHEN requests > 0 THEN 'Active user suggestions for features (' || CAST(CAST(requests AS BIGINT) AS VARCHAR) || ' requests identified, ~' || printf('%.1f', floor(requests / n * 100 * 10 + 0.5) / 10) || '% of processed reviews).' ELSE 'Limited explicit feature requests identified in this dataset.' END FROM o WHERE n > 0
        UNION ALL SELECT 'opportunities', 1, 0, 'Top themes associated with feature requests: ' || string_agg(theme || ' (' || requests || ')', ', ' ORDER BY requests DESC, first_request_ord) || '.' FROM (SELECT * FROM t WHERE requests > 0 ORDER BY requests DESC, first_request_ord LIMIT 5) HAVING count(*) > 0
        UNION ALL SELECT 'opportunities', 2, first_ord, CASE WHEN average_severity >= 3.5 THEN 'Opportunity to improve user retention by addressing high-severity issues in ''' || theme || '''.' ELSE 'Opportunity to improve user satisfaction by addressing issues related to ''' || theme || '''.' END FROM f WHERE sig AND nr >= 0.30""",
    "s": "SELECT category, CAST(row_number() OVER (PARTITION BY category ORDER BY sec, place) AS INT) AS ord, message FROM swot_raw",
    "sections": """
        SELECT * FROM (VALUES (0, 'strengths', '(No significant strengths identified based on current thresholds)'),
          (1, 'weaknesses', '(No significant weaknesses identified based on current thresholds)'),
          (2, 'opportunities', '(No specific opportunities identified from requests or weaknesses)'),
          (3, 'threats', '(No significant threats identified based on high severity or other factors)')) v(section, category, placeholder)""",
    "sl": """
        SELECT 'L' || CAST(ord AS VARCHAR) AS id, ord AS n, review_id, COALESCE(theme, 'General Feedback') AS theme,
          CASE WHEN sentiment = 'mixed' THEN 'neutral' ELSE sentiment END AS sentiment, COALESCE(severity, 1) AS severity,
          feature_request = 'Y' AS feature_request, 'quote ' || CAST(ord AS VARCHAR) AS direct_quote, confidence, 'm1' AS model_version
        FROM l""",
    "apps": "SELECT DISTINCT source AS app_id, CAST(substring(source, 4) AS INT) AS n FROM documents",
    "app_rows": """
        SELECT app_id AS id, CASE WHEN n % 2 = 0 AND n % 3 <> 0 THEN 'App ' || app_id ELSE 'Unknown App' END AS title,
          CASE WHEN n % 2 = 0 AND n % 4 <> 0 THEN 'About ' || app_id END AS description,
          CASE WHEN n % 2 = 0 THEN '1.0' END AS version, CAST(NULL AS VARCHAR) AS developer,
          CASE WHEN n % 2 = 0 THEN 'Finance' END AS category FROM apps""",
    "j": """
        SELECT event_id AS id,
          CASE event_type WHEN 'click' THEN 'scrape_reviews' WHEN 'view' THEN 'label_reviews' WHEN 'purchase' THEN 'process_results'
            WHEN 'signup' THEN 'cleanup_data' ELSE 'export_data' END AS type,
          CASE event_id % 20 WHEN 0 THEN 'failed' WHEN 1 THEN 'waiting' WHEN 2 THEN 'active' WHEN 3 THEN 'delayed' ELSE 'completed' END AS status,
          ts AS created_at, CAST(CAST(floor(event_id / 20) AS BIGINT) % 3 + 1 AS INT) AS attempts,
          CASE WHEN event_id % 20 = 0 THEN CASE CAST(floor(event_id / 20) AS BIGINT) % 3 WHEN 0 THEN 'Network timeout' WHEN 1 THEN 'Rate limit' ELSE NULL END END AS failure_reason
        FROM events""",
    "d": """
        SELECT 'dlq_' || CAST(id AS VARCHAR) AS id, id AS n, CAST(id AS VARCHAR) AS original_job_id, type, failure_reason, created_at AS failed_at,
          attempts, row_number() OVER (PARTITION BY type ORDER BY created_at DESC, 'dlq_' || CAST(id AS VARCHAR) DESC) AS position
        FROM j WHERE status = 'failed'""",
    "types": """
        SELECT * FROM (VALUES (0, 'scrape_reviews'), (1, 'label_reviews'), (2, 'process_results'), (3, 'cleanup_data'), (4, 'export_data')) v(type_ord, type)""",
    "q": """
        SELECT ty.type_ord, ty.type, count(*) FILTER (status = 'waiting') AS waiting, count(*) FILTER (status = 'active') AS active,
          count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed,
          count(*) FILTER (status = 'delayed') AS delayed
        FROM types ty LEFT JOIN j ON j.type = ty.type GROUP BY ty.type_ord, ty.type""",
    "dt": "SELECT ty.type, count(d.id) AS total, min(failed_at) AS oldest, max(failed_at) AS newest FROM types ty LEFT JOIN d ON d.type = ty.type GROUP BY ty.type",
    # Model answers as the query makes them, already in their cleaned form.
    "e": """
        SELECT doc_id, doc_id // 10 AS batch_no, 'r' || CAST(doc_id AS VARCHAR) AS review_id,
          CASE WHEN doc_id % 10 = 0 THEN 'General Feedback' ELSE 'theme_' || CAST(doc_id % 7 AS VARCHAR) END AS theme,
          CASE doc_id % 4 WHEN 1 THEN 'positive' WHEN 2 THEN 'negative' ELSE 'neutral' END AS sentiment,
          CAST(greatest(1, least(5, doc_id % 9 - 2)) AS INT) AS severity, doc_id % 3 = 0 AS feature_request,
          substring(text, 1, 100) AS direct_quote,
          CASE WHEN doc_id % 5 = 0 OR doc_id % 150 = 0 THEN 0.5 ELSE least(1.0, CAST(doc_id % 150 AS DOUBLE) / 100) END AS confidence,
          'm1' AS model_version, (doc_id // 10) % 8 IN (1, 2, 3, 4) AS failed
        FROM documents""",
    # The offline labeler's rules.
    "k0": """
        SELECT doc_id, 'r' || CAST(doc_id AS VARCHAR) AS review_id, text, lower(text) AS lo FROM documents""",
    "k1": """
        SELECT *, CAST(contains(lo, 'the') AS INT) + CAST(contains(lo, 'les') AS INT) + CAST(contains(lo, 'und') AS INT) AS pos,
          CAST(contains(lo, 'er') AS INT) + CAST(contains(lo, 'ou') AS INT) + CAST(contains(lo, 'ent') AS INT) AS neg FROM k0""",
    "k": """
        SELECT doc_id, review_id, CASE WHEN contains(lo, 'tionre') THEN 'Performance' WHEN contains(lo, 'ingen') OR contains(lo, 'ungen') THEN 'Pricing'
            WHEN contains(lo, 'ciónes') OR contains(lo, 'erle') THEN 'Features' ELSE 'General Feedback' END AS theme,
          CASE WHEN pos > neg THEN 'positive' WHEN pos < neg THEN 'negative' ELSE 'neutral' END AS sentiment,
          CASE WHEN pos < neg THEN 1 + neg ELSE 1 END AS severity, contains(lo, 'tha') OR contains(lo, 'que') AS feature_request,
          substring(regexp_extract(text, '^[^.\\n]*'), 1, 100) AS direct_quote, CAST(CASE WHEN pos = neg THEN 0.6 ELSE 0.9 END AS DOUBLE) AS confidence FROM k1""",
    "numbered": "SELECT 'r' || CAST(doc_id AS VARCHAR) AS id, doc_id, text, row_number() OVER (ORDER BY doc_id) - 1 AS p FROM documents",
    "pj": """
        SELECT id AS n, CASE WHEN id % 50 = 49 THEN 'other_type' ELSE type END AS type, created_at FROM j""",
    "pe": """
        SELECT n, type, CASE type
          WHEN 'other_type' THEN 'type: unknown'
          WHEN 'scrape_reviews' THEN concat_ws('; ', CASE WHEN n % 9 = 0 THEN 'appId: empty' END, CASE WHEN n % 8 = 1 THEN 'countries: item' END,
            CASE WHEN n % 5 = 0 AND n % 13 NOT BETWEEN 1 AND 10 THEN 'pages: range' END)
          WHEN 'label_reviews' THEN concat_ws('; ', CASE WHEN n % 7 = 0 THEN 'reviewIds: empty' END,
            CASE WHEN n % 3 = 0 AND n % 120 NOT BETWEEN 1 AND 100 THEN 'batchSize: range' END)
          WHEN 'process_results' THEN CASE WHEN n % 6 = 0 THEN 'resultType: enum' ELSE '' END
          WHEN 'cleanup_data' THEN CASE WHEN n % 2 = 0 AND n % 40 = 0 THEN 'olderThanDays: range' ELSE '' END
          ELSE concat_ws('; ', CASE WHEN n % 6 = 0 THEN 'dateRange: startDate' END, CASE WHEN n % 11 = 0 THEN 'priority: range' END) END AS errors
        FROM pj""",
    "pages": """
        SELECT app_id, country_code, sort_method, page, count(*) AS n_reviews, page = 8 AND sort_method = 'helpful' AS failed
        FROM raw GROUP BY app_id, country_code, sort_method, page""",
    "lp": """
        SELECT doc_id // 100 AS block, lang, CAST((doc_id // 10) % 10 + 1 AS INT) AS page, count(*) AS n_reviews,
          (doc_id // 10) % 10 + 1 = 9 AND (doc_id // 100) % 3 = 0 AS failed
        FROM documents GROUP BY ALL""",
    "lstop": """
        SELECT x.block, x.lang, COALESCE(min(x.p) FILTER (g.page IS NULL), 11) AS stop
        FROM (SELECT DISTINCT block, lang, p FROM lp, (SELECT unnest(range(1, 11)) AS p)) x
        LEFT JOIN (SELECT * FROM lp WHERE NOT failed) g ON g.block = x.block AND g.lang = x.lang AND g.page = x.p
        GROUP BY x.block, x.lang""",
    "landed": """
        SELECT doc_id, 'r' || CAST(doc_id AS VARCHAR) AS id, 'app' || CAST(doc_id // 100 AS VARCHAR) AS app_id,
          CASE WHEN doc_id % 13 = 0 THEN 'Anonymous' ELSE 'user' || CAST(doc_id % 97 AS VARCHAR) END AS user_name,
          CASE WHEN doc_id % 12 <> 11 THEN CAST(doc_id % 6 AS INT) END AS score, substring(text, 1, 40) AS title, text,
          TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' HOUR * CAST(doc_id AS INT) AS date,
          CAST(doc_id % 17 AS INT) AS helpful_votes, upper(documents.lang) AS country
        FROM documents JOIN lstop ON lstop.block = doc_id // 100 AND lstop.lang = documents.lang AND (doc_id // 10) % 10 + 1 < lstop.stop""",
    "fr": """
        SELECT id, n, upper(CASE WHEN n % 18 = 7 THEN 'usa' ELSE country END) AS country,
          CASE WHEN n % 16 = 5 THEN -1 WHEN n % 16 = 6 THEN 0 ELSE helpful_votes END AS helpful_votes FROM reviews""",
}
NEEDS = {
    "reviews": ["raw"], "a": ["l"], "t": ["a"], "f": ["t"], "o": ["t"], "swot_raw": ["f", "o"], "s": ["swot_raw"], "sl": ["l"],
    "app_rows": ["apps"], "d": ["j"], "q": ["types", "j"], "dt": ["types", "d"], "k1": ["k0"], "k": ["k1"], "pj": ["j"],
    "pe": ["pj"], "pages": ["raw"], "lstop": ["lp"], "landed": ["lstop"], "fr": ["reviews"],
}
ORACLES: dict[str, str] = {}


def oracle(name: str, needs: str, sql: str) -> None:
    order: list[str] = []

    def visit(cte: str) -> None:
        for other in NEEDS.get(cte, []):
            visit(other)
        if cte not in order:
            order.append(cte)

    for cte in needs.split():
        visit(cte)
    head = "WITH " + ",\n".join(f"{cte} AS ({CTES[cte]})" for cte in order) + "\n" if order else ""
    ORACLES[name] = head + sql


# --- insights ------------------------------------------------------------------------------------------------

oracle("theme_insights", "f", """
    SELECT theme, mentions, positive, negative, neutral, requests, average_severity, sig AS is_significant,
      sig AND pr >= 0.65 AS is_strength, sig AND nr >= 0.30 AS is_weakness,
      sig AND nr >= 0.30 AND average_severity >= 3.5 AS is_threat FROM f""")
oracle("overall_sentiment", "a", """
    SELECT count(*) FILTER (tone = 'positive') AS positive, count(*) FILTER (tone = 'negative') AS negative,
      count(*) FILTER (tone = 'neutral') AS neutral FROM a""")
oracle("avg_severity", "t", "SELECT theme, negative AS severity_count, average_severity FROM t")
oracle("feature_requests_by_theme", "t", "SELECT theme, requests, first_request_ord FROM t WHERE requests > 0")
oracle("feature_request_quotes", "a", """
    SELECT ord, theme, 'quote of ' || review_id AS quote, review_id FROM a WHERE feature_request = 'Y' ORDER BY ord LIMIT 50""")
oracle("top_request_themes", "t", """
    SELECT theme, requests, first_request_ord FROM t WHERE requests > 0 ORDER BY requests DESC, first_request_ord LIMIT 5""")
oracle("insight_totals", "l", """
    SELECT count(*) AS total_reviews, count(*) FILTER (ord % 17 = 0) AS skipped_reviews,
      count(*) FILTER (ord % 17 <> 0) AS processed_reviews,
      count(*) FILTER (ord % 17 <> 0 AND feature_request = 'Y') AS feature_requests FROM l""")
oracle("normalize_analyses", "l", """
    SELECT ord, ord % 17 = 0 AS skipped,
      CASE WHEN ord % 17 = 0 THEN 'Unknown Theme' ELSE COALESCE(theme, 'Unknown Theme') END AS theme,
      CASE WHEN ord % 17 = 0 THEN 'neutral' ELSE sentiment END AS sentiment,
      CAST(CASE WHEN ord % 17 = 0 THEN 1 ELSE COALESCE(severity, 1) END AS DOUBLE) AS severity,
      CASE WHEN ord % 17 = 0 THEN 'N' ELSE feature_request END AS feature_request,
      CASE WHEN ord % 17 <> 0 THEN review_id END AS review_id FROM l""")
oracle("labels_to_analyses", "sl", """
    SELECT review_id, theme, sentiment, severity, CASE WHEN feature_request THEN 'Y' ELSE 'N' END AS feature_request, direct_quote FROM sl""")
oracle("swot", "s", "SELECT category, ord, message FROM s")
oracle("swot_report", "s sections", """
    SELECT section, category, COALESCE(ord, 0) AS ord, COALESCE(message, placeholder) AS line FROM sections LEFT JOIN s USING (category)""")
oracle("swot_json", "s", """
    SELECT CAST(to_json({'strengths': COALESCE(list(message ORDER BY ord) FILTER (category = 'strengths'), []),
      'weaknesses': COALESCE(list(message ORDER BY ord) FILTER (category = 'weaknesses'), []),
      'opportunities': COALESCE(list(message ORDER BY ord) FILTER (category = 'opportunities'), []),
      'threats': COALESCE(list(message ORDER BY ord) FILTER (category = 'threats'), [])}) AS VARCHAR) AS swot FROM s""")
oracle("insights_json", "t a l", """
    SELECT theme, mentions AS count, positive, negative, neutral, average_severity AS "averageSeverity", requests,
      (SELECT count(*) FROM l) AS total, 0 AS skipped,
      (SELECT count(*) FILTER (tone = 'positive') FROM a) AS all_positive,
      least(50, (SELECT count(*) FILTER (feature_request = 'Y') FROM a))::INT AS quotes,
      (SELECT arg_min('quote of ' || review_id, ord) FILTER (feature_request = 'Y') FROM a) AS first_quote FROM t""")
oracle("avg_confidence", "sl", """
    SELECT theme, floor(CAST(sum(CAST(confidence AS DECIMAL(18, 4))) AS DOUBLE) / count(*) * 100 + 0.5) / 100 AS average_confidence FROM sl GROUP BY theme""")
oracle("sentiment_breakdown", "sl", """
    SELECT theme, count(*) FILTER (sentiment = 'positive') AS positive, count(*) FILTER (sentiment = 'neutral') AS neutral,
      count(*) FILTER (sentiment = 'negative') AS negative FROM sl GROUP BY theme""")

# --- collect -------------------------------------------------------------------------------------------------

oracle("crawl_jobs", "apps", """
    SELECT app_id, 'us' AS countries, 5 AS pages, 'recent' AS sort_methods, 500 AS throttle_ms, 5 AS priority, 3 AS retry_attempts, 0 AS delay FROM apps""")
oracle("crawl_plan", "apps", """
    SELECT app_id, sort_ord, sort_method, country_ord, country_code, CAST(page AS INT) AS page FROM apps
    CROSS JOIN (VALUES (0, 'recent'), (1, 'helpful')) s(sort_ord, sort_method)
    CROSS JOIN (VALUES (0, 'us'), (1, 'gb'), (2, 'fr'), (3, 'de'), (4, 'es')) c(country_ord, country_code)
    CROSS JOIN (SELECT unnest(range(1, 11)) AS page) p""")
oracle("crawl_early_stop", "pages", """
    SELECT app_id, country_code, sort_method, page, n_reviews FROM pages p
    WHERE NOT EXISTS (SELECT 1 FROM (SELECT unnest(range(1, 11)) AS x) w WHERE w.x <= p.page AND NOT EXISTS (
      SELECT 1 FROM pages g WHERE g.app_id = p.app_id AND g.country_code = p.country_code AND g.sort_method = p.sort_method AND g.page = w.x AND NOT g.failed))""")
oracle("collect_landed_pages", "landed", f"""
    SELECT id, app_id, user_name, 'Unknown' AS version, score, title, text, {iso("date")} AS date, helpful_votes, country
    FROM landed WHERE score IS NULL OR score BETWEEN 1 AND 5""")
oracle("quarantine_landed_pages", "landed", "SELECT id, app_id, score, 'score: range' AS errors FROM landed WHERE score = 0")
oracle("landed_pages_json", "lp", """
    SELECT 'app' || CAST(block AS VARCHAR) AS app_id, lang AS country_code, page, CAST(n_reviews AS INT) AS n_reviews,
      CASE WHEN failed THEN 'timeout' END AS error FROM lp""")
oracle("landed_page_reviews", "", """
    SELECT 'app' || CAST(doc_id // 100 AS VARCHAR) AS app_id, lang AS country_code, CAST((doc_id // 10) % 10 + 1 AS INT) AS page,
      CAST(row_number() OVER (PARTITION BY doc_id // 10, lang ORDER BY doc_id) - 1 AS INT) AS pos, 'r' || doc_id AS id,
      CASE WHEN doc_id % 13 = 0 THEN '' ELSE 'user' || CAST(doc_id % 97 AS VARCHAR) END AS user_name,
      CASE WHEN doc_id % 12 <> 11 THEN CAST(doc_id % 6 AS INT) END AS score, substring(text, 1, 40) AS title, text,
      CASE WHEN doc_id % 7 = 0 THEN 'not a url' END AS url, CAST(doc_id % 17 AS INT) AS helpful_votes
    FROM documents""")
oracle("early_stop_long_lists", "", """
    SELECT source AS app_id, page FROM (
      SELECT source, page, row_number() OVER (PARTITION BY source ORDER BY page) AS place
      FROM (SELECT DISTINCT source, doc_id // 20 + 1 AS page FROM documents)) WHERE page = place""")
oracle("dedup_reviews", "raw", """
    SELECT x.id, x.app_id, x.country_code, x.sort_method, x.page, x.pos, x.score, x.title, x.text, x.votes AS helpful_votes,
      y.sort_ord AS first_seen_sort_ord, y.country_ord AS first_seen_country_ord
    FROM (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY app_id, id ORDER BY sort_ord DESC, country_ord DESC, page DESC, pos DESC) = 1) x
    JOIN (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY app_id, id ORDER BY sort_ord, country_ord, page, pos) = 1) y
      ON x.id = y.id AND x.app_id = y.app_id""")
oracle("crawl_summary", "reviews app_rows", """
    SELECT a.id AS app_id, a.title AS app_title, COALESCE(n, 0) AS reviews_scraped, 5 AS countries_processed, 2 AS sort_methods_used, true AS success,
      'Successfully scraped ' || COALESCE(n, 0) || ' unique reviews for app ' || a.id AS message
    FROM app_rows a LEFT JOIN (SELECT app_id, count(*) AS n FROM reviews GROUP BY app_id) r ON r.app_id = a.id""")
oracle("crawl_results", "reviews app_rows", """
    SELECT a.id AS app_id, n % 3 <> 0 AS success, CASE WHEN n % 3 <> 0 THEN a.title END AS app_title,
      CASE WHEN n % 3 <> 0 THEN 5::BIGINT END AS countries_processed, CASE WHEN n % 3 <> 0 THEN 2::BIGINT END AS sort_methods_used,
      CASE WHEN n % 3 <> 0 THEN 'Successfully scraped ' || COALESCE(k, 0) || ' unique reviews for app ' || a.id END AS message,
      CASE WHEN n % 3 = 0 THEN 'timeout of ' || a.id END AS error, n * 250 AS processing_time, CASE WHEN n % 3 <> 0 THEN COALESCE(k, 0) ELSE 0 END AS items_processed
    FROM (SELECT *, CAST(substring(id, 4) AS BIGINT) AS n FROM app_rows) a LEFT JOIN (SELECT app_id, count(*) AS k FROM reviews GROUP BY app_id) r ON r.app_id = a.id""")
oracle("normalize_reviews", "raw", f"""
    SELECT id, sort_ord, user_name, version, score, title, text, COALESCE(votes, 0) AS helpful_votes, upper(country_code) AS country, {iso("date")} AS date FROM raw""")
oracle("normalize_apps", "app_rows", "SELECT * FROM app_rows")
oracle("model_columns", "reviews", f"""
    SELECT id, user_name AS "userName", version, score, title, text, {iso("date")} AS date, helpful_votes AS "helpfulVotes", country FROM reviews""")

_SPACE = "[\\t\\n\\v\\f\\r \\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]"


def _sanitized(text: str) -> str:
    return f"COALESCE(NULLIF(regexp_replace(regexp_replace({text}, '[\\\\/:*?\"<>|]', '', 'g'), '{_SPACE}+', '_', 'g'), ''), 'app')"


oracle("sanitize_names", "", f"""
    SELECT doc_id, {_sanitized(f"regexp_replace(text, '^{_SPACE}+|{_SPACE}+$', '', 'g')")} AS name,
      {_sanitized("'  ' || text || ' \"x\" '")} AS legacy_name FROM documents""")
oracle("validate_reviews", "fr", """
    SELECT id, country, helpful_votes, concat_ws('; ', CASE WHEN n % 20 = 8 THEN 'title: required' END, CASE WHEN n % 14 = 3 THEN 'score: range' END,
      CASE WHEN n % 15 = 4 THEN 'url: format' END, CASE WHEN n % 16 = 5 THEN 'helpful_votes: range' END, CASE WHEN n % 18 = 7 THEN 'country: length' END) AS errors FROM fr""")
oracle("stored_constraints", "sl reviews apps", """
    SELECT * FROM (
      SELECT 'labels' AS table_name, id, concat_ws('; ', CASE WHEN n % 12 = 2 THEN 'confidence: range' END,
        CASE WHEN count(*) OVER (PARTITION BY id) > 1 THEN 'id: duplicate' END) AS errors
      FROM (SELECT n, 'L' || CAST(CASE WHEN n % 25 = 1 THEN n - 1 ELSE n END AS VARCHAR) AS id FROM sl)
      UNION ALL
      SELECT 'reviews', id, concat_ws('; ', CASE WHEN n % 17 = 3 THEN 'app_id: required' END, CASE WHEN n % 19 = 4 THEN 'country: required' END,
        CASE WHEN n % 14 = 3 THEN 'score: range' END, CASE WHEN count(*) OVER (PARTITION BY id) > 1 THEN 'id: duplicate' END)
      FROM (SELECT n, 'r' || CAST(CASE WHEN n % 26 = 1 THEN n - 1 ELSE n END AS VARCHAR) AS id FROM reviews)
      UNION ALL
      SELECT 'apps', CASE WHEN n % 5 <> 2 THEN app_id END, concat_ws('; ', CASE WHEN n % 5 = 2 THEN 'id: required' END,
        CASE WHEN n % 3 = 1 THEN 'title: required' END) FROM apps)
    WHERE errors <> ''""")
oracle("validate_jobs", "pe", "SELECT n AS id, type, errors FROM pe WHERE errors <> ''")
oracle("accepted_job_defaults", "pe", """
    SELECT n AS id, type, CAST(CASE WHEN type = 'scrape_reviews' THEN CASE WHEN n % 5 = 0 THEN n % 13 ELSE 5 END END AS INT) AS pages,
      CASE WHEN type = 'scrape_reviews' THEN 500 END AS throttle_ms,
      CAST(CASE WHEN type = 'label_reviews' THEN CASE WHEN n % 3 = 0 THEN n % 120 ELSE 20 END END AS INT) AS batch_size,
      CAST(CASE WHEN type = 'cleanup_data' THEN CASE WHEN n % 2 = 0 THEN n % 40 ELSE 30 END END AS INT) AS older_than_days,
      5 AS priority, 3 AS retry_attempts, CASE WHEN type = 'label_reviews' THEN 'gpt-4.1-mini' END AS model,
      CASE WHEN type = 'export_data' THEN 'csv' END AS format, CASE WHEN type = 'process_results' THEN 'database' END AS output_format
    FROM pe WHERE errors = ''""")
oracle("validate_job_results", "j", """
    SELECT id, errors FROM (SELECT id, concat_ws('; ', CASE WHEN id % 10 = 0 THEN 'success: required' END,
      CASE WHEN id % 6 = 0 AND id % 4 <> 0 THEN 'processingTime: integer' END, CASE WHEN id % 4 = 0 AND id < 40 THEN 'itemsProcessed: range' END) AS errors FROM j)
    WHERE errors <> ''""")

# --- merge and joins -----------------------------------------------------------------------------------------

oracle("upsert_reviews", "reviews", f"""
    SELECT id, CASE WHEN n % 3 <> 0 THEN app_id ELSE 'other_' || app_id END AS app_id, CASE WHEN n % 3 <> 0 THEN user_name ELSE 'someone' END AS user_name,
      CASE WHEN n % 6 <> 1 THEN CAST(score % 5 + 1 AS INT) ELSE score END AS score, CASE WHEN n % 6 <> 1 THEN 'new ' || title ELSE title END AS title, text,
      CASE WHEN n % 6 <> 1 THEN helpful_votes + 100 ELSE helpful_votes END AS helpful_votes, country,
      CASE WHEN n % 3 <> 0 THEN {iso("created_at")} ELSE '{AS_OF_ISO}' END AS created_at,
      CASE WHEN n % 6 <> 1 THEN '{AS_OF_ISO}' ELSE {iso("created_at")} END AS updated_at FROM reviews""")
ORACLES["upsert_touched_buckets"] = ORACLES["upsert_reviews"]
oracle("theme_insights_incremental", "l", f"""
    SELECT theme, count(*) AS mentions, count(*) FILTER (sentiment = 'positive') AS positive, count(*) FILTER (sentiment = 'negative') AS negative,
      count(*) FILTER (sentiment NOT IN ('positive', 'negative')) AS neutral,
      CAST(COALESCE(sum(severity) FILTER (sentiment = 'negative'), 0) AS DOUBLE) AS severity_sum,
      count(*) FILTER (sentiment = 'negative') AS severity_count, count(*) FILTER (asks) AS requests,
      {iso("min(made)")} AS first_ord, {iso("min(made) FILTER (asks)")} AS first_request_ord
    FROM (SELECT CASE WHEN ord % 5 = 0 THEN 'theme_' || CAST(ord % 4 AS VARCHAR) ELSE COALESCE(theme, 'none') END AS theme,
        CASE WHEN ord % 5 = 0 THEN 'negative' ELSE sentiment END AS sentiment, COALESCE(severity, 1) AS severity,
        CASE WHEN ord % 5 = 0 THEN ord % 2 = 0 ELSE feature_request = 'Y' END AS asks,
        CASE WHEN ord % 3 = 0 THEN {LATER} ELSE {AS_OF} END AS made FROM l)
    GROUP BY theme""")
oracle("upsert_labels", "sl", f"""
    SELECT CASE WHEN n % 2 = 0 THEN id ELSE 'label_' || sha256(review_id) END AS id, review_id, 'Relabeled' AS theme, sentiment, severity, feature_request,
      direct_quote, confidence, 'm2' AS model_version, CASE WHEN n % 2 = 0 THEN '{AS_OF_ISO}' ELSE '{LATER_ISO}' END AS created_at, '{LATER_ISO}' AS updated_at FROM sl""")
oracle("ensure_apps", "app_rows", f"""
    SELECT id, CASE WHEN k THEN 'Unknown App' ELSE title END AS title, CASE WHEN NOT k THEN description END AS description,
      CASE WHEN NOT k THEN version END AS version, developer, CASE WHEN NOT k THEN category END AS category,
      CASE WHEN k THEN '{AS_OF_ISO}' ELSE '{LATER_ISO}' END AS created_at, CASE WHEN k THEN '{AS_OF_ISO}' ELSE '{LATER_ISO}' END AS updated_at
    FROM (SELECT *, id LIKE '%1' OR id LIKE '%2' AS k FROM app_rows)""")
oracle("reviews_to_store_across_apps", "reviews", """
    SELECT id, app_id, user_name, country, 1 AS score, title, text, helpful_votes FROM reviews""")
oracle("unlabeled_reviews", "reviews l", f"""
    SELECT id, app_id, score, text, {iso("created_at")} AS created_at FROM reviews WHERE id NOT IN (SELECT review_id FROM l) ORDER BY reviews.created_at DESC, id LIMIT 100""")
oracle("unlabeled_backlog", "reviews l", "SELECT id, app_id, score, text FROM reviews WHERE id NOT IN (SELECT review_id FROM l)")
oracle("resume_skip", "reviews sl", """
    SELECT r.id, app_id FROM reviews r LEFT JOIN (SELECT * FROM sl WHERE sentiment = 'negative') x ON x.review_id = r.id WHERE x.review_id IS NULL""")
oracle("fetch_by_ids", "reviews sl", f"""
    SELECT id, text, {iso("created_at")} AS created_at FROM reviews WHERE id IN (SELECT review_id FROM sl WHERE feature_request)""")
oracle("enrich_reviews", "reviews sl", """
    SELECT r.id, r.app_id, theme, sentiment, severity, feature_request, direct_quote FROM reviews r LEFT JOIN sl ON sl.review_id = r.id""")
oracle("orphan_labels", "reviews sl", "SELECT review_id, theme FROM sl WHERE review_id NOT IN (SELECT id FROM reviews WHERE country = 'US')")
oracle("cascade_delete", "reviews sl", "SELECT review_id, theme FROM sl WHERE review_id NOT IN (SELECT id FROM reviews WHERE score = 1)")

# --- labeling ------------------------------------------------------------------------------------------------

oracle("label_batches", "numbered", "SELECT id, doc_id AS ord, p // 20 AS batch_no, CAST(p % 20 + 1 AS INT) AS position FROM numbered")
oracle("label_batches_by_app", "", """
    SELECT id, app_id, ord, p // 7 AS batch_no, CAST(p % 7 + 1 AS INT) AS position FROM (
      SELECT 'r' || CAST(doc_id AS VARCHAR) AS id, source AS app_id, doc_id AS ord, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) - 1 AS p FROM documents)""")
oracle("label_jobs", "numbered", """
    SELECT p // 20 AS batch_no, string_agg(id, ',' ORDER BY p) AS review_ids, 20 AS batch_size, 'gpt-4o-mini' AS model, 2 AS retry_attempts FROM numbered GROUP BY p // 20""")
oracle("label_requests_untexted", "numbered", """
    SELECT p // 20 AS batch_no, count(*)::INT AS n, 'Analyze these app reviews:' || chr(10) || chr(10) ||
      string_agg((p % 20 + 1) || '. ID: ' || id || chr(10) || 'Text: "' || CASE WHEN p % 4 = 1 THEN 'null' ELSE text END || '"' || chr(10) || '---', chr(10) ORDER BY p) AS user_prompt
    FROM numbered GROUP BY p // 20""")
oracle("label_requests", "numbered", """
    SELECT p // 20 AS batch_no, string_agg(id, ',' ORDER BY p) AS review_ids, 'Analyze these app reviews:' || chr(10) || chr(10) ||
      string_agg((p % 20 + 1) || '. ID: ' || id || chr(10) || 'Text: "' || text || '"' || chr(10) || '---', chr(10) ORDER BY p) AS user_prompt
    FROM numbered GROUP BY p // 20""")
_LABEL = "review_id, theme, sentiment, severity, feature_request, direct_quote, confidence, model_version"
_FALLBACK = "review_id, 'General Feedback' AS theme, 'neutral' AS sentiment, 1 AS severity, false AS feature_request, '' AS direct_quote, 0.0::DOUBLE AS confidence, 'm1' AS model_version"
oracle("clean_labels", "e", f"SELECT {_LABEL} FROM e")
oracle("parse_responses", "e", f"SELECT batch_no, {_LABEL} FROM e WHERE NOT failed")
oracle("failed_responses", "e", "SELECT batch_no, CAST(count(*) AS INT) AS reviews FROM e WHERE failed GROUP BY batch_no")
oracle("fallback_labels", "e", f"SELECT batch_no, {_FALLBACK} FROM e WHERE failed")
oracle("labels_from_responses", "e", f"SELECT {_LABEL} FROM e WHERE NOT failed UNION ALL SELECT {_FALLBACK} FROM e WHERE failed")
oracle("label_reviews", "k", "SELECT review_id, theme, sentiment, severity, feature_request, direct_quote, confidence, 'm1' AS model_version FROM k")
oracle("label_backlog_labels", "sl k", f"""
    SELECT id, review_id, theme, sentiment, severity, feature_request, direct_quote, confidence, model_version, '{AS_OF_ISO}' AS created_at, '{AS_OF_ISO}' AS updated_at FROM sl
    UNION ALL SELECT 'label_' || sha256(review_id), review_id, theme, sentiment, severity, feature_request, direct_quote, confidence, 'm2', '{LATER_ISO}', '{LATER_ISO}'
    FROM k WHERE review_id NOT IN (SELECT review_id FROM sl)""")
oracle("label_reviews_strict", "k", "SELECT review_id, CASE WHEN theme = 'Pricing' THEN 'General Feedback' ELSE theme END AS theme FROM k")
oracle("label_backlog_limited", "reviews sl k", """
    SELECT review_id, theme, sentiment, severity FROM k WHERE review_id IN (
      SELECT id FROM reviews WHERE id NOT IN (SELECT review_id FROM sl) ORDER BY created_at DESC, id LIMIT 100)""")
oracle("label_backlog_summary", "sl k", """
    SELECT true AS success, 'Successfully labeled ' || count(*) || ' previously unlabeled reviews' AS message, count(*) AS items_processed,
      floor(CAST(sum(CAST(confidence AS DECIMAL(18, 4))) AS DOUBLE) / count(*) * 100 + 0.5) / 100 AS average_confidence, count(*) FILTER (sentiment = 'positive') AS positive,
      count(*) FILTER (sentiment = 'neutral') AS neutral, count(*) FILTER (sentiment = 'negative') AS negative
    FROM k WHERE review_id NOT IN (SELECT review_id FROM sl)""")
oracle("label_job_summary", "e sl", """
    SELECT e.batch_no AS job_id, count(sl.id) > 0 AS success, CASE WHEN count(sl.id) > 0 THEN 'Successfully labeled ' || count(sl.id) || ' reviews' END AS message,
      CASE WHEN count(sl.id) = 0 THEN 'No reviews found for provided IDs: ' || string_agg(e.review_id, ', ' ORDER BY doc_id) FILTER (doc_id % 10 < 5) || '...' END AS error,
      CASE WHEN count(sl.id) = 0 THEN string_agg(e.review_id, ',' ORDER BY doc_id) END AS failed_review_ids, count(sl.id) AS items_processed,
      floor(CAST(sum(CAST(sl.confidence AS DECIMAL(18, 4))) AS DOUBLE) / count(sl.id) * 100 + 0.5) / 100 AS average_confidence,
      CASE WHEN count(sl.id) > 0 THEN count(*) FILTER (sl.sentiment = 'positive') END AS positive,
      CASE WHEN count(sl.id) > 0 THEN count(*) FILTER (sl.sentiment = 'neutral') END AS neutral,
      CASE WHEN count(sl.id) > 0 THEN count(*) FILTER (sl.sentiment = 'negative') END AS negative
    FROM e LEFT JOIN sl ON sl.review_id = e.review_id GROUP BY e.batch_no""")

_SUMMARY = ORACLES["label_job_summary"].partition("SELECT e.batch_no")
ORACLES["label_job_results"] = f"""{_SUMMARY[0].rstrip()}, summary AS ({"".join(_SUMMARY[1:])}),
  ids AS (SELECT batch_no, string_agg(review_id, ',' ORDER BY doc_id) AS all_ids FROM e GROUP BY batch_no)
SELECT job_id, success AND NOT gone AS success, CASE WHEN NOT gone THEN message END AS message,
  CASE WHEN gone THEN 'Rate limit' ELSE error END AS error, CASE WHEN gone THEN all_ids ELSE failed_review_ids END AS failed_review_ids,
  CASE WHEN gone THEN 0 ELSE items_processed END AS items_processed, CASE WHEN NOT gone THEN average_confidence END AS average_confidence,
  CASE WHEN NOT gone THEN positive END AS positive, CASE WHEN NOT gone THEN neutral END AS neutral, CASE WHEN NOT gone THEN negative END AS negative,
  CAST(job_id * 17 % 1000 AS BIGINT) AS processing_time
FROM (SELECT *, job_id % 13 = 5 AS gone FROM summary) s JOIN ids ON ids.batch_no = s.job_id"""

# --- jobs and dead letters -----------------------------------------------------------------------------------

oracle("queue_stats", "q", "SELECT type, type_ord, waiting, active, completed, failed, delayed FROM q")
oracle("result_stats", "types j", """
    SELECT ty.type, count(j.id) AS completed, count(*) FILTER (id % 7 <> 0 AND id % 3 <> 0) AS succeeded,
      count(*) FILTER (id % 7 = 0 OR id % 3 = 0) AS reported_failures
    FROM types ty LEFT JOIN j ON j.type = ty.type AND j.status = 'completed' GROUP BY ty.type""")
oracle("queue_health", "q dt", """
    SELECT q.type, waiting, active, completed, failed, delayed, total AS dlq_total, CASE WHEN failed > 10 THEN 'degraded' ELSE 'healthy' END AS status,
      CAST(sum(active) OVER () AS BIGINT) AS total_active, CAST(sum(waiting) OVER () AS BIGINT) AS total_waiting, CAST(sum(failed) OVER () AS BIGINT) AS total_failed,
      CAST(sum(total) OVER () AS BIGINT) AS total_dlq,
      CASE WHEN sum(total) OVER () > 50 THEN 'unhealthy' WHEN sum(failed) OVER () > 20 THEN 'degraded' ELSE 'healthy' END AS overall_status FROM q JOIN dt ON dt.type = q.type""")
oracle("queue_metrics", "q dt", """
    SELECT q.type, waiting AS jobs_waiting, active AS jobs_active, completed AS jobs_completed, failed AS jobs_failed, delayed AS jobs_delayed, total AS dlq_total,
      CAST(sum(completed) OVER () AS BIGINT) AS total_jobs_processed, CAST(sum(failed) OVER () AS BIGINT) AS total_jobs_failed,
      CAST(sum(active) OVER () AS BIGINT) AS total_active_jobs FROM q JOIN dt ON dt.type = q.type""")
oracle("processing_stats", "q", f"""
    SELECT type, completed + failed AS jobs_per_minute, 0 AS average_processing_time,
      CASE WHEN completed + failed > 0 THEN floor(completed / (completed + failed) * 100 + 0.5) / 100 ELSE 1.0 END AS success_rate,
      CAST(sum(active) OVER () AS BIGINT) AS total_active_workers, CAST(floor(sum(waiting) OVER () / 5 + 0.5) AS BIGINT) AS average_queue_depth,
      (SELECT {iso("min(created_at)")} FROM j WHERE status = 'waiting') AS oldest_waiting_job FROM q""")
oracle("oldest_waiting", "j", f"SELECT {iso('min(created_at)')} AS oldest_waiting FROM j WHERE status = 'waiting'")
oracle("recent_jobs", "j", f"""
    SELECT type, CAST(position AS INT) AS position, id, status, {iso("created_at")} AS created_at FROM (
      SELECT *, row_number() OVER (PARTITION BY type ORDER BY created_at DESC, id DESC) AS position FROM (
        SELECT * FROM j WHERE status IN ('active', 'completed', 'failed')
        QUALIFY row_number() OVER (PARTITION BY type, status ORDER BY created_at DESC, id DESC) <= 5)) WHERE position <= 10""")
oracle("keep_last_finished", "j", """
    SELECT id, type, status FROM j QUALIFY status NOT IN ('completed', 'failed')
      OR row_number() OVER (PARTITION BY type, status ORDER BY created_at DESC, id DESC) <= CASE status WHEN 'completed' THEN 50 ELSE 100 END""")
_OLD = f"status IN ('completed', 'failed') AND created_at <= {AS_OF} - INTERVAL 1 DAY"
_REMOVED = f"SELECT id, type, status FROM j WHERE {_OLD} QUALIFY row_number() OVER (PARTITION BY type, status ORDER BY created_at, id) <= 100"
oracle("keep_last_5000", "j", """
    SELECT id, NULLIF(type, 'export_data') AS type, status FROM j QUALIFY status NOT IN ('completed', 'failed')
      OR row_number() OVER (PARTITION BY type, status ORDER BY created_at DESC, id DESC) <= 5000""")
oracle("queue_details", "q dt d j", """
    SELECT q.type, q.failed, dt.total AS dlq_total, r.rate_limited, least(5, dt.total)::INT AS failures, CAST(n.position AS INT) AS position, n.id, n.status
    FROM q JOIN dt ON dt.type = q.type
    LEFT JOIN (SELECT type, nullif(count(*) FILTER (failure_reason = 'Rate limit'), 0) AS rate_limited FROM d GROUP BY type) r ON r.type = q.type
    LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY type ORDER BY created_at DESC, id DESC) AS position FROM (
      SELECT * FROM j WHERE status IN ('active', 'completed', 'failed')
      QUALIFY row_number() OVER (PARTITION BY type, status ORDER BY created_at DESC, id DESC) <= 5)) n ON n.type = q.type AND n.position <= 10""")
oracle("cleanup_failed_jobs", "j", f"SELECT id, type, status FROM j WHERE status = 'failed' AND created_at < {AS_OF} - INTERVAL 10 DAY")
oracle("clean_queue", "j", f"SELECT id, type, status FROM j WHERE id NOT IN (SELECT id FROM ({_REMOVED}))")
oracle("clean_queue_removed", "j", _REMOVED)
oracle("job_options", "j", """
    SELECT id, CAST(CASE WHEN id % 4 <> 0 AND id % 3 <> 0 THEN id % 3 WHEN id % 11 <> 0 THEN id % 11 ELSE 5 END AS INT) AS resolved_priority,
      CAST(CASE WHEN id % 5 = 0 THEN id % 1000 ELSE 0 END AS INT) AS resolved_delay, CAST(CASE WHEN id % 6 <> 0 THEN id % 6 ELSE 3 END AS INT) AS resolved_attempts FROM j""")
oracle("to_dead_letters", "d", f"""
    SELECT id, original_job_id, type AS original_job_type, failure_reason, attempts AS attempts_made, {iso("failed_at")} AS failed_at FROM d""")
oracle("dlq_stats", "dt", f"SELECT type, total, {iso('oldest')} AS oldest_failure, {iso('newest')} AS newest_failure FROM dt")
oracle("dlq_reasons", "d", "SELECT type, COALESCE(failure_reason, 'Unknown') AS failure_reason, count(*) AS jobs FROM d GROUP BY 1, 2")
oracle("dlq_overview", "dt d", f"""
    SELECT dt.type, total, CAST(position AS INT) AS position, d.id, CASE WHEN d.id IS NOT NULL THEN COALESCE(failure_reason, 'Unknown') END AS failure_reason, {iso("failed_at")} AS failed_at
    FROM dt LEFT JOIN d ON d.type = dt.type AND position <= 5""")
oracle("recent_dead_letters", "d", "SELECT type AS original_job_type, CAST(position AS INT) AS position, id FROM d WHERE position <= 5")
oracle("dead_letter_page", "d", "SELECT type AS original_job_type, CAST(position AS INT) AS position, id FROM d WHERE position BETWEEN 11 AND 30")
oracle("dead_letter_long_page", "d", "SELECT type AS original_job_type, position, id FROM d WHERE position BETWEEN 6 AND 2000")
oracle("dead_letter_untyped", "d", """
    SELECT original_job_type, position, id FROM (
      SELECT NULLIF(type, 'export_data') AS original_job_type, id, row_number() OVER (PARTITION BY type ORDER BY failed_at DESC, id DESC) AS position FROM d)""")
oracle("dead_letter_all", "d", "SELECT type AS original_job_type, position, id FROM d")
_RETRY = "SELECT * FROM d WHERE type = 'label_reviews' AND failure_reason = 'Rate limit' ORDER BY failed_at DESC, id DESC LIMIT "
oracle("dlq_retry_by_reason", "d", f"SELECT 'retry_' || original_job_id AS id, type, 5 AS priority, 0 AS delay, 3 AS max_attempts FROM ({_RETRY} 10)")
oracle("dlq_retry_remaining", "d", f"SELECT id, type AS original_job_type FROM d WHERE id NOT IN (SELECT id FROM ({_RETRY} 3))")
oracle("dlq_retry_one", "d", """
    SELECT 'retried' AS half, 'retry_' || original_job_id AS id, type, 'waiting' AS status, 5 AS priority, 0 AS delay, 0 AS attempts, 3 AS max_attempts
    FROM d WHERE id IN ('dlq_20', 'dlq_60')
    UNION ALL SELECT 'remaining', id, type, 'waiting', NULL, NULL, NULL, NULL FROM d WHERE id NOT IN ('dlq_20', 'dlq_60')""")
oracle("dlq_retry_published", "d", f"""
    , rest AS (SELECT * FROM d WHERE id NOT IN ('dlq_20', 'dlq_60')),
      picked AS (SELECT id FROM ({_RETRY.replace("FROM d ", "FROM rest ")} 3) UNION ALL SELECT id FROM d WHERE id IN ('dlq_20', 'dlq_60'))
    SELECT 'retried' AS half, 'retry_' || original_job_id AS id, type FROM d WHERE id IN (SELECT id FROM picked)
    UNION ALL SELECT 'remaining', id, type FROM d WHERE id NOT IN (SELECT id FROM picked)""")
oracle("dlq_clean", "d", f"""
    SELECT id, CASE WHEN n % 40 = 0 THEN 'failed' ELSE 'waiting' END AS status FROM d WHERE NOT (n % 40 = 0 AND failed_at <= {AS_OF} - INTERVAL 30 DAY)""")
oracle("cleanup_dry_run", "reviews", f"SELECT id, app_id FROM reviews WHERE date < {AS_OF} - INTERVAL 30 DAY")
oracle("cleanup_reviews", "reviews", f"SELECT id, app_id FROM reviews WHERE date >= {AS_OF} - INTERVAL 30 DAY")

# --- sinks, logs, health, SQL --------------------------------------------------------------------------------

oracle("export_reviews", "reviews sl", f"""
    SELECT r.id, {iso("date")} AS date, score, text, theme, sentiment, severity FROM reviews r LEFT JOIN sl ON sl.review_id = r.id WHERE r.app_id = 'src3' AND date <= {AS_OF}""")
oracle("reviews_csv", "reviews", f"""
    SELECT id, country, user_name, score AS rating, title, text, {iso("date")} AS date, CAST(NULL AS VARCHAR) AS url, helpful_votes AS votes FROM reviews""")
ORACLES["reviews_csv_large"] = ORACLES["reviews_csv"]
oracle("reviews_csv_by_app", "reviews app_rows", """
    SELECT replace(a.title, ' ', '_') AS app, count(*) AS n, count(DISTINCT r.id) AS ids FROM reviews r JOIN app_rows a ON a.id = r.app_id GROUP BY 1""")
oracle("export_job", "reviews", """
    SELECT id, score, text, CAST(helpful_votes AS INT) AS helpful_votes FROM reviews
    WHERE app_id = 'src3' AND date BETWEEN TIMESTAMP '2024-01-03 00:00:00' AND TIMESTAMP '2024-03-01 00:00:00'""")
oracle("labeled_reviews_csv", "reviews sl", """
    SELECT r.id, country, theme, sentiment, severity, CAST(feature_request AS VARCHAR) AS feature_request FROM reviews r LEFT JOIN sl ON sl.review_id = r.id""")
oracle("stored_tables", "reviews sl", """
    SELECT app_id, sentiment, count(*) AS n, CAST(sum(score) AS BIGINT) AS total_score FROM reviews r JOIN sl ON sl.review_id = r.id GROUP BY app_id, sentiment""")
oracle("bucketed_tables", "reviews sl", """
    SELECT theme, count(*) AS n, CAST(sum(score) AS BIGINT) AS total_score FROM reviews r LEFT JOIN sl ON sl.review_id = r.id GROUP BY theme""")
oracle("analyses_json_lines", "t", "SELECT theme, mentions, negative, average_severity, first_ord FROM t")
ORACLES["analyses_json_document"] = ORACLES["analyses_json_lines"]
_BUILT_IN = ", ".join(f"({at}, '{t['name']}', '{t['description']}')" for at, t in enumerate(S.DEFAULT_TAXONOMY["themes"]))
oracle("taxonomy_document", "", f"""
    SELECT 'whole' AS document, CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS INT) AS ord, n_name AS name, r_name AS description
    FROM nation JOIN region ON r_regionkey = n_regionkey
    UNION ALL SELECT document, ord, name, description FROM (VALUES ('cut off'), ('missing')) d(document), (VALUES {_BUILT_IN}) t(ord, name, description)""")
oracle("result_output", "sl", """
    SELECT fmt, theme, count(*) AS n FROM sl, (VALUES ('csv'), ('json'), ('database')) v(fmt) GROUP BY fmt, theme""")
oracle("result_by_type", "reviews sl", """
    SELECT id, score, CAST(NULL AS VARCHAR) AS theme, 'scraped_reviews' AS result_type FROM reviews
    UNION ALL SELECT r.id, score, theme, 'labeled_reviews' FROM reviews r JOIN sl ON sl.review_id = r.id AND severity > 2
    UNION ALL SELECT r.id, score, theme, 'exported_data' FROM reviews r LEFT JOIN sl ON sl.review_id = r.id AND severity > 2""")
oracle("health_rollup", "", """
    SELECT 'service' || CAST(user_id % 50 AS VARCHAR) AS service, count(*) AS check_count,
      CASE WHEN bool_or(event_type = 'error' AND (value > 60 OR event_id % 997 = 0)) THEN 'unhealthy'
        WHEN bool_or(event_id % 997 <> 0 AND value > 40 AND value <= 60) THEN 'degraded' ELSE 'healthy' END AS status
    FROM events GROUP BY user_id % 50""")
oracle("redact_logs", "", "SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN 'user' ELSE 'operation,user' END AS members FROM events")
oracle("sample_logs", "", """
    SELECT event_id AS id, CASE event_type WHEN 'view' THEN 'debug' WHEN 'error' THEN 'error' ELSE 'info' END AS level FROM events
    WHERE event_type <> 'view' OR CAST('0x' || substring(md5(CAST(event_id AS VARCHAR)), 1, 8) AS BIGINT) % 10000 < 1000""")
oracle("sample_logs_levels", "", "SELECT CASE event_type WHEN 'error' THEN 'error' ELSE 'info' END AS level, count(*) AS n FROM events WHERE event_type <> 'view' GROUP BY 1")
oracle("parameterized_query", "reviews", "SELECT country, count(*) AS n FROM reviews WHERE score >= 3 AND country <> 'GB' GROUP BY country")
oracle("first_row", "j", "SELECT id, type FROM j WHERE status = 'failed' ORDER BY created_at DESC, id LIMIT 1")
oracle("exists_and_count", "j", "SELECT count(*) AS count, count(*) > 0 AS \"exists\" FROM j WHERE status = 'failed'")

# --- streaming -----------------------------------------------------------------------------------------------

oracle("stream_ingest", "landed", f"""
    SELECT id, app_id, user_name, score, title, text, {iso("date")} AS date, helpful_votes, country, '{AS_OF_ISO}' AS updated_at
    FROM landed WHERE score IS NULL OR score BETWEEN 1 AND 5""")
oracle("stream_label_unmatched", "", "SELECT 'ghost' || substring(id, 2) AS review_id FROM (SELECT 'r' || doc_id AS id, doc_id FROM documents) WHERE doc_id % 10 = 3")
oracle("stream_ingest_raw", "reviews", f"SELECT id, app_id, user_name, score, title, text, helpful_votes, country, '{AS_OF_ISO}' AS updated_at FROM reviews")
oracle("stream_label", "k", "SELECT review_id, theme, sentiment, severity, feature_request, direct_quote, confidence FROM k")
oracle("stream_dedup", "reviews", f"SELECT id, {iso('date')} AS date FROM reviews")
oracle("stream_queue_status", "j", "SELECT type, status, count(*) AS n FROM j GROUP BY type, status")
oracle("stream_job_states", "", """
    SELECT type, status, count(*) AS jobs FROM (
      SELECT event_id // 4 AS job, CASE (event_id // 4) % 3 WHEN 0 THEN 'scrape_reviews' WHEN 1 THEN 'label_reviews' ELSE 'export_data' END AS type,
        CASE (event_id * 7 + user_id) % 5 WHEN 0 THEN 'waiting' WHEN 1 THEN 'active' WHEN 2 THEN 'completed' WHEN 3 THEN 'failed' ELSE 'delayed' END AS status
      FROM events QUALIFY row_number() OVER (PARTITION BY event_id // 4 ORDER BY (event_id * 13) % 4 DESC) = 1)
    GROUP BY type, status""")
oracle("stream_queue_activity", "j", """
    SELECT type, count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'waiting') AS waiting,
      count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed
    FROM j WHERE type <> 'label_reviews' GROUP BY type HAVING count(*) FILTER (status IN ('active', 'waiting')) > 0""")
oracle("stream_quarantine", "j", """
    SELECT CASE WHEN id % 5 = 0 THEN 'dead letter' ELSE 'accepted' END AS half, CAST(id AS VARCHAR) AS id, type,
      CASE WHEN id % 5 = 0 THEN CASE type WHEN 'label_reviews' THEN 'reviewIds: required'
        WHEN 'process_results' THEN 'sourceJobId: required; resultType: required' WHEN 'cleanup_data' THEN 'targetType: required' ELSE 'appId: required' END
      END AS failure_reason
    FROM j""")
