"""Equivalent DuckDB SQL for every SQL-checkable query of the catalogue.

Built from shared CTEs that restate the test-data mapping (see
``tastemap.sources.testdata``) independently of the Spark code.  Integer
results are cast to the Spark types (INTEGER for positions/ranks/lengths,
BIGINT for counts); floating results are rounded to 6 places.
"""

from __future__ import annotations

from tastemap.config import DEFAULT_PARAMS as P
from tastemap.config import DEFAULT_STOP_WORDS, STOP_WORDS
from tastemap.plans import catalogue as C

BUCKET_SQL = ("CASE WHEN hour(ts) < 6 THEN '凌晨' WHEN hour(ts) < 12 THEN '上午' "
              "WHEN hour(ts) < 18 THEN '下午' ELSE '晚上' END")
CUSTOM_STOP_SQL = ", ".join(f"'{w}'" for w in STOP_WORDS)
STOP_SQL = ", ".join("'" + w.replace("'", "''") + "'" for w in DEFAULT_STOP_WORDS)
T = repr(float(P.min_similarity))
RATIO = repr(float(P.cf_blend_ratio))
MORNING = "'上午'"


def tok_ws(x):
    return f"list_filter(string_split(coalesce({x}, ''), ' '), lambda t: t <> '')"


def tok_gap(x):
    return (f"list_filter(regexp_split_to_array(lower(coalesce({x}, '')), '\\s+'), "
            f"lambda t: length(t) >= 1)")


def tok_match(x):
    return f"regexp_extract_all(lower(coalesce({x}, '')), '\\p{{L}}+')"


# CTEs in dependency order; each query names the ones it needs.
CTES: dict[str, str] = {
    "sizes": """SELECT (SELECT count(*) FROM documents) AS nd,
        (SELECT count(*) FROM documents) // 100 AS g,
        (SELECT count(*) FROM embeddings) AS nv""",
    "ev": """SELECT e.event_id, e.ts, e.user_id, e.event_type,
        100 * (((e.user_id % s.g) + s.g) % s.g)
          + CAST(json_extract_string(e.props, '$.k') AS BIGINT) AS doc_id,
        CASE e.event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2
             WHEN 'signup' THEN 3 WHEN 'purchase' THEN 4 END AS behaviour
        FROM events e CROSS JOIN sizes s""",
    "ulog": f"""SELECT event_id, ts, user_id, doc_id, behaviour,
        CAST(CASE behaviour WHEN 1 THEN 0.2 WHEN 2 THEN 0.2 WHEN 3 THEN 0.3
             WHEN 4 THEN 0.3 END AS DOUBLE) AS weight,
        {BUCKET_SQL} AS bucket
        FROM ev WHERE behaviour IS NOT NULL AND ts IS NOT NULL AND doc_id IS NOT NULL""",
    "vec": """SELECT e.vec_id, r.k, CAST(e.embedding[r.k + 1] AS DOUBLE) AS x
        FROM embeddings e JOIN (SELECT unnest(range((SELECT max(len(embedding)) FROM embeddings))) AS k) r
          ON r.k < len(e.embedding)""",
    "dvec": """SELECT d.doc_id, v.k, v.x FROM documents d CROSS JOIN sizes s
        JOIN vec v ON v.vec_id = ((d.doc_id % s.nv) + s.nv) % s.nv""",
    "bvec": """SELECT b.item_id AS doc_id, v.k, v.x FROM benchmark b CROSS JOIN sizes s
        JOIN vec v ON v.vec_id = ((b.item_id % s.nv) + s.nv) % s.nv""",
    "tsum": """SELECT l.user_id, l.bucket, dv.k, sum(l.weight * dv.x) AS s
        FROM ulog l JOIN dvec dv ON dv.doc_id = l.doc_id GROUP BY ALL""",
    "tcnt": "SELECT user_id, bucket, count(*) AS c FROM ulog GROUP BY ALL",
    "prof": """SELECT t.user_id, t.bucket, t.k, t.s / c.c AS x
        FROM tsum t JOIN tcnt c USING (user_id, bucket)""",
    "mprof": f"SELECT user_id, k, x FROM prof WHERE bucket = {MORNING}",
    "pn": "SELECT user_id, sqrt(sum(x * x)) AS nrm FROM mprof GROUP BY ALL",
    "an": "SELECT doc_id, sqrt(sum(x * x)) AS nrm FROM bvec GROUP BY ALL",
    "dots": """SELECT p.user_id, a.doc_id, sum(p.x * a.x) AS d
        FROM mprof p JOIN bvec a USING (k) GROUP BY ALL""",
    "cos": """SELECT d.user_id, d.doc_id, d.d / (pn.nrm * an.nrm) AS sim
        FROM dots d JOIN pn USING (user_id) JOIN an USING (doc_id)
        WHERE pn.nrm > 0 AND an.nrm > 0""",
    "content": f"SELECT user_id, doc_id, sim FROM cos WHERE sim > {T}",
    "tok": f"SELECT doc_id, UNNEST({tok_ws('text')}) AS term FROM documents",
    "tf": "SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL",
    "idf": """SELECT term, count(*) AS df,
        ln(CAST((SELECT count(*) FROM documents) + 1 AS DOUBLE) / CAST(count(*) + 1 AS DOUBLE)) AS idf
        FROM tf GROUP BY ALL""",
    "tfidf": "SELECT tf.doc_id, tf.term, tf.tf * idf.idf AS weight FROM tf JOIN idf USING (term)",
    "kws": f"""SELECT doc_id, term, weight,
        CAST(row_number() OVER (PARTITION BY doc_id ORDER BY round(weight, 6) DESC, term)
             AS INTEGER) AS rk
        FROM tfidf QUALIFY rk <= {P.keywords_per_doc}""",
    "u": """SELECT item_id AS doc_id, text AS words, true AS is_new FROM benchmark
        UNION ALL SELECT doc_id, text AS words, false AS is_new FROM documents""",
    "utf": f"""SELECT doc_id, is_new, term, count(*) AS tf FROM
        (SELECT doc_id, is_new, UNNEST({tok_ws('words')}) AS term FROM u) GROUP BY ALL""",
    "uidf": """SELECT term,
        ln(CAST((SELECT count(*) FROM u) + 1 AS DOUBLE) / CAST(count(*) + 1 AS DOUBLE)) AS idf
        FROM utf GROUP BY ALL""",
    "nkw": f"""SELECT doc_id, term, weight,
        CAST(row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term) AS INTEGER) AS rk
        FROM (SELECT doc_id, term, round(tf * idf, 6) AS weight
              FROM utf JOIN uidf USING (term) WHERE is_new)
        QUALIFY rk <= {P.keywords_per_doc}""",
    "kpre": "SELECT user_id, bucket, doc_id, max(weight) AS bw FROM ulog GROUP BY ALL",
    "kd": f"""SELECT user_id, bucket, term, weight FROM
        (SELECT p.user_id, p.bucket, k.term, max(k.weight * p.bw) AS weight
         FROM kpre p JOIN kws k USING (doc_id) GROUP BY ALL)
        QUALIFY row_number() OVER (PARTITION BY user_id, bucket ORDER BY weight DESC, term)
            <= {P.keywords_per_update}""",
    "mterms": f"SELECT user_id, term FROM kd WHERE bucket = {MORNING}",
    "jac": """SELECT sh.user_id, sh.doc_id, sh.shared,
        sh.shared / (nl.n + nr.n - sh.shared) AS sim
        FROM (SELECT m.user_id, n.doc_id, count(*) AS shared
              FROM mterms m JOIN nkw n USING (term) GROUP BY ALL) sh
        JOIN (SELECT user_id, count(*) AS n FROM mterms GROUP BY ALL) nl USING (user_id)
        JOIN (SELECT doc_id, count(*) AS n FROM nkw GROUP BY ALL) nr USING (doc_id)""",
    "cfl": "SELECT user_id, doc_id, round(sum(weight), 6) AS score FROM ulog GROUP BY ALL",
    "vt": f"SELECT doc_id, UNNEST({tok_gap('text')}) AS term FROM documents",
    "vocab": f"""SELECT CAST(row_number() OVER (ORDER BY n DESC, term) - 1 AS INTEGER) AS idx, term, n
        FROM (SELECT term, count(*) AS n FROM vt WHERE term NOT IN ({STOP_SQL})
              GROUP BY ALL ORDER BY n DESC, term LIMIT {P.vocab_size})""",
    "cv": "SELECT vt.doc_id, v.idx, count(*) AS tf FROM vt JOIN vocab v USING (term) GROUP BY ALL",
    "lines": """SELECT e.event_id, '[' || concat_ws(',', strftime(e.ts, '%Y-%m-%d %H:%M:%S'),
            CAST(e.doc_id AS VARCHAR), coalesce(d.source, ''), CAST(e.doc_id AS VARCHAR),
            coalesce(CAST(e.behaviour AS VARCHAR), e.event_type), CAST(e.user_id AS VARCHAR)) || ']'
          AS value
        FROM ev e LEFT JOIN documents d ON d.doc_id = e.doc_id""",
    "parsed": """SELECT len(p) AS n, try_strptime(p[1], '%Y-%m-%d %H:%M:%S') AS ts,
        p[2] AS doc_id, p[3] AS doc_type, p[4] AS rowkey, TRY_CAST(p[5] AS INTEGER) AS behaviour,
        p[6] AS user_id
        FROM (SELECT string_split(regexp_replace(value, '[\\[\\]]', '', 'g'), ',') AS p FROM lines)""",
    "good": """SELECT ts, doc_id, doc_type, rowkey, behaviour, user_id FROM parsed
        WHERE n >= 6 AND ts IS NOT NULL AND behaviour IN (1, 2, 3, 4)
          AND user_id IS NOT NULL AND user_id <> '' AND rowkey IS NOT NULL AND rowkey <> ''""",
    "queue": """SELECT b.item_id AS doc_id, 'benchmark' AS doc_type,
        CAST(b.item_id AS VARCHAR) AS rowkey, b.item_id % 3 = 0 AS has_read FROM benchmark b""",
    "faulty": r"""SELECT CASE event_id % 7
            WHEN 1 THEN regexp_replace(value, '(,[^,]*){2}$', '')
            WHEN 2 THEN regexp_replace(value, '^(\[[0-9-]+) [0-9]+', '\1 25')
            WHEN 3 THEN regexp_replace(value, '[^,]*$', ']')
            WHEN 4 THEN regexp_replace(value, '[^,]*(,[^,]*,[^,]*)$', '\1') ELSE value END AS value
        FROM lines""",
    "fparsed": """SELECT line, len(p) AS n, try_strptime(p[1], '%Y-%m-%d %H:%M:%S') AS ts,
        p[4] AS rowkey, TRY_CAST(p[5] AS INTEGER) AS behaviour, p[6] AS user_id
        FROM (SELECT line, string_split(line, ',') AS p
              FROM (SELECT regexp_replace(value, '[\\[\\]]', '', 'g') AS line FROM faulty))""",
}
ORDER = list(CTES)


def _deps(names: set[str]) -> list[str]:
    return [n for n in ORDER if n in names]


def sql(needs: str, final: str) -> str:
    names = set(needs.split())
    parts = [f"{n} AS (\n  {CTES[n]}\n)" for n in _deps(names)]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + final


BASE = "sizes ev ulog"
TOPIC = BASE + " vec dvec tsum tcnt prof"
COS = TOPIC + " mprof bvec pn an dots cos"
TEXT = "tok tf idf tfidf"
KW = BASE + " " + TEXT + " kws kpre kd"
NEW = "u utf uidf nkw"


def _kw_for(half: str) -> dict:
    """kd restricted to one half of the log."""
    return CTES["kd"].replace("FROM kpre p", f"FROM (SELECT * FROM kpre_{half}) p")


def _merge(existing: str, threshold: str) -> str:
    kpre_old = ("SELECT user_id, bucket, doc_id, max(weight) AS bw FROM ulog "
                "WHERE ts < TIMESTAMP '2024-01-16' GROUP BY ALL")
    kpre_new = ("SELECT user_id, bucket, doc_id, max(weight) AS bw FROM ulog "
                "WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY ALL")
    thr = ("median(weight)" if threshold == "median"
           else "CASE WHEN count(*) >= 2 THEN max(weight) ELSE 0.0 END")
    both = "o.weight + n.weight" if existing == "add" else "o.weight"
    head = sql(KW, "")
    head = head.rstrip("\n")
    extra = f""",
kpre_old AS (
  {kpre_old}
),
kpre_new AS (
  {kpre_new}
),
kd_old AS (
  {_kw_for('old')}
),
kd_new AS (
  {_kw_for('new')}
),
old AS (SELECT user_id, bucket, term, weight FROM kd_old WHERE weight > 0),
thr AS (SELECT user_id, bucket, CAST({thr} AS DOUBLE) AS thr FROM old GROUP BY ALL),
nw AS (SELECT kn.user_id, kn.bucket, kn.term, kn.weight, thr.thr
       FROM kd_new kn LEFT JOIN thr USING (user_id, bucket)),
j AS (SELECT coalesce(o.user_id, n.user_id) AS user_id, coalesce(o.bucket, n.bucket) AS bucket,
             coalesce(o.term, n.term) AS term,
             CASE WHEN o.weight IS NOT NULL AND n.weight IS NOT NULL THEN {both}
                  WHEN o.weight IS NULL THEN
                      CASE WHEN n.weight > coalesce(n.thr, 0.0) THEN n.weight END
                  ELSE o.weight END AS weight
      FROM old o FULL OUTER JOIN nw n
        ON o.user_id = n.user_id AND o.bucket = n.bucket AND o.term = n.term)
SELECT user_id, bucket, term, round(weight, 6) AS weight FROM j WHERE weight IS NOT NULL"""
    return head + extra


SCORE_SINGLE = sql(COS + " content", "SELECT user_id, doc_id, round(sim, 6) AS sim FROM content")


def hybrid(threshold, sigma, beta):
    return sql(COS + " " + KW + " mterms " + NEW + " jac", f"""
        , users AS (SELECT DISTINCT user_id FROM tcnt WHERE bucket = {MORNING})
        , allp AS (SELECT u.user_id, b.item_id AS doc_id FROM users u CROSS JOIN benchmark b)
        , st AS (SELECT a.user_id, a.doc_id,
                 CASE WHEN pn.nrm > 0 AND an.nrm > 0 THEN coalesce(dots.d, 0) / (pn.nrm * an.nrm)
                      ELSE 0.0 END AS sim_t
                 FROM allp a LEFT JOIN dots USING (user_id, doc_id) LEFT JOIN pn USING (user_id)
                 LEFT JOIN an USING (doc_id))
        , sc AS (SELECT st.user_id, st.doc_id, st.sim_t, coalesce(jac.sim, 0.0) AS sim_k
                 FROM st LEFT JOIN jac USING (user_id, doc_id))
        , sc2 AS (SELECT *, (sim_t * CAST({sigma} AS DOUBLE) + sim_k * CAST({beta} AS DOUBLE))
                            / CAST({(sigma * sigma + beta * beta) ** 0.5} AS DOUBLE) AS score FROM sc)
        SELECT user_id, doc_id, round(sim_t, 6) AS sim_t, round(sim_k, 6) AS sim_k,
            round(score, 6) AS score FROM sc2 WHERE score > {threshold}""")


ORACLE: dict[str, str] = {
    "parse_log": sql(BASE + " lines parsed good",
                     "SELECT ts, doc_id, doc_type, rowkey, behaviour, user_id FROM good"),
    "quarantine": sql("sizes ev", """SELECT event_id, reason FROM (
        SELECT event_id, CASE WHEN ts IS NULL THEN 'bad_timestamp'
             WHEN behaviour IS NULL THEN 'unknown_behaviour'
             WHEN doc_id IS NULL THEN 'no_article' END AS reason FROM ev)
        WHERE reason IS NOT NULL"""),
    "parse_quarantine": sql(BASE + " lines faulty fparsed", """SELECT line, reason FROM (
        SELECT line, CASE WHEN n < 6 THEN 'short_line' WHEN ts IS NULL THEN 'bad_timestamp'
            WHEN behaviour IS NULL OR behaviour NOT IN (1, 2, 3, 4) THEN 'unknown_behaviour'
            WHEN user_id IS NULL OR user_id = '' THEN 'no_user'
            WHEN rowkey IS NULL OR rowkey = '' THEN 'no_rowkey' END AS reason FROM fparsed)
        WHERE reason IS NOT NULL"""),
    "attach_words": sql(BASE, """SELECT event_id, k AS rowkey,
        CAST(length(coalesce(d.text, '')) AS INTEGER) AS n_chars, md5(coalesce(d.text, '')) AS words_md5
        FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'gone-' ELSE '' END || 'news'
                || lpad(left(CAST(doc_id AS VARCHAR), 4), 4, '0') AS k FROM ulog) l
        LEFT JOIN documents d ON 'news' || lpad(left(CAST(d.doc_id AS VARCHAR), 4), 4, '0') = l.k"""),
    "text_corpus": """SELECT words, count(*) AS n FROM (
        SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS words FROM documents) GROUP BY words""",
    "news_scan_limit": f"""SELECT doc_id AS rowkey, CAST(length(text) AS INTEGER) AS n_chars
        FROM documents ORDER BY doc_id LIMIT {C.SCAN_LIMIT}""",
    "kv_scan_filter": f"""SELECT doc_id AS rowkey, n_chars FROM documents
        WHERE n_chars >= {C.LONG_DOC_CHARS}""",
    "text_lines": """SELECT doc_id, CAST(UNNEST(range(len(arr))) AS INTEGER) AS line_no,
        UNNEST(arr) AS line
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS arr FROM documents)""",
    "attach_text": sql(BASE, """SELECT l.event_id, l.doc_id AS rowkey,
        CAST(coalesce(length(d.text), 0) AS INTEGER) AS n_chars
        FROM ulog l LEFT JOIN documents d ON d.doc_id = l.doc_id"""),
    "stopwords_antijoin": f"""SELECT doc_id, term, count(*) AS tf FROM
        (SELECT doc_id, UNNEST({tok_gap('text')}) AS term FROM documents)
        WHERE term NOT IN ({CUSTOM_STOP_SQL}) GROUP BY ALL""",
    "time_bucket": f"""SELECT user_id, {BUCKET_SQL} AS bucket, count(*) AS n
        FROM events WHERE ts IS NOT NULL GROUP BY ALL""",
    "behaviour_weight": sql(BASE, "SELECT event_id, behaviour AS code, weight FROM ulog"),
    "distinct_users": sql(BASE, "SELECT DISTINCT user_id FROM ulog"),
    "user_events": sql(BASE, """SELECT event_id, ts, doc_id, behaviour FROM ulog
        WHERE user_id = (SELECT user_id FROM ulog GROUP BY user_id
                         ORDER BY count(*) DESC, user_id LIMIT 1)"""),
    "ratings": sql(BASE, """SELECT user_id, doc_id, round(sum(weight), 6) AS rating
        FROM ulog GROUP BY ALL"""),
    "item_dictionary": sql(BASE + " lines parsed good", """SELECT
        'r' || CAST(CAST(doc_id AS BIGINT) // 10 AS VARCHAR) AS rowkey,
        first(doc_id ORDER BY ts DESC, doc_id DESC) AS doc_id, max(ts) AS last_ts
        FROM good GROUP BY 1"""),
    "word_count_topk": f"""SELECT term, count(*) AS n FROM
        (SELECT UNNEST({tok_ws('text')}) AS term FROM documents)
        GROUP BY ALL ORDER BY n DESC, term LIMIT {C.WORD_TOPK}""",
    "token_regex_gap": f"""SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens,
        CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct, md5(array_to_string(t, ' ')) AS tokens_md5
        FROM (SELECT doc_id, {tok_gap('text')} AS t FROM documents) WHERE len(t) > 0""",
    "token_regex_match": f"""SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens,
        CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct, md5(array_to_string(t, ' ')) AS tokens_md5
        FROM (SELECT doc_id, {tok_match('text')} AS t FROM documents) WHERE len(t) > 0""",
    "vocabulary": sql("vt vocab", "SELECT idx, term, n FROM vocab"),
    "count_vectors": sql("vt vocab cv", "SELECT doc_id, idx, tf FROM cv"),
    "corpus_stats": sql("vt vocab cv", """SELECT (SELECT count(*) FROM documents) AS n_docs,
        CAST(coalesce(sum(tf), 0) AS BIGINT) AS n_tokens, count(*) AS n_distinct_entries FROM cv"""),
    "tf": sql("tok tf", "SELECT doc_id, term, tf FROM tf"),
    "idf": sql("tok tf idf", "SELECT term, df, round(idf, 6) AS idf FROM idf"),
    "tfidf": sql(TEXT, "SELECT doc_id, term, round(weight, 6) AS weight FROM tfidf"),
    "tfidf_range": sql(TEXT, """SELECT round(min(weight), 6) AS min_w,
        round(max(weight), 6) AS max_w FROM tfidf"""),
    "keywords_self": sql(TEXT + " kws",
                         "SELECT doc_id, term, round(weight, 6) AS weight, rk FROM kws"),
    "keywords_incremental": sql(TEXT + " kws",
                                "SELECT doc_id, term, round(weight, 6) AS weight, rk FROM kws"),
    "keywords_new_vs_corpus": sql(NEW, "SELECT doc_id, term, weight, rk FROM nkw"),
    "keywords_user_scope": sql(BASE + " tok tf", f"""
        , rc AS (SELECT user_id, doc_id, count(*) AS r FROM ulog GROUP BY ALL)
        , mu AS (SELECT user_id, sum(r) AS m_u FROM rc GROUP BY ALL)
        , dfc AS (SELECT term, count(*) AS df_c FROM tf GROUP BY ALL)
        , ut AS (SELECT rc.user_id, rc.doc_id, rc.r, tf.term, tf.tf FROM rc JOIN tf USING (doc_id))
        , dfu AS (SELECT user_id, term, sum(r) AS df_u FROM ut GROUP BY ALL)
        , w AS (SELECT ut.user_id, ut.doc_id, ut.term,
              round(ut.tf * ln(CAST(s.nd + mu.m_u + 1 AS DOUBLE)
                               / CAST(dfc.df_c + dfu.df_u + 1 AS DOUBLE)), 6) AS weight
              FROM ut JOIN dfu USING (user_id, term) JOIN dfc USING (term)
              JOIN mu USING (user_id) CROSS JOIN sizes s)
        SELECT user_id, doc_id, term, weight,
            CAST(row_number() OVER (PARTITION BY user_id, doc_id ORDER BY weight DESC, term)
                 AS INTEGER) AS rk
        FROM w QUALIFY rk <= {P.keywords_per_doc}"""),
    "topic_delta": sql(TOPIC, """SELECT t.user_id, t.bucket, CAST(t.k AS INTEGER) AS k,
        round(t.s, 6) AS topic_sum, c.c AS cnt FROM tsum t JOIN tcnt c USING (user_id, bucket)"""),
    "topic_merge": sql(TOPIC, """SELECT p.user_id, p.bucket, CAST(p.k AS INTEGER) AS k,
        round(p.x, 6) AS topic, c.c AS cnt FROM prof p JOIN tcnt c USING (user_id, bucket)"""),
    "keyword_delta": sql(KW, "SELECT user_id, bucket, term, round(weight, 6) AS weight FROM kd"),
    "keyword_merge_add": _merge("add", "median"),
    "keyword_merge_keep": _merge("keep", "max"),
    "profile_nested": sql(KW + " vec dvec tsum tcnt", """
        , ub AS (SELECT user_id, bucket FROM tcnt UNION SELECT user_id, bucket FROM kd)
        , nk AS (SELECT user_id, bucket, count(*) AS nk FROM kd GROUP BY ALL)
        SELECT ub.user_id, CAST(count(*) AS INTEGER) AS n_buckets,
            CAST(coalesce(sum(nk.nk), 0) AS INTEGER) AS n_keywords,
            CAST(coalesce(sum(tcnt.c), 0) AS BIGINT) AS news_cnt
        FROM ub LEFT JOIN tcnt USING (user_id, bucket) LEFT JOIN nk USING (user_id, bucket)
        GROUP BY ub.user_id"""),
    "profile_contents": sql(KW + " vec dvec tsum tcnt", """
        , ub AS (SELECT user_id, bucket FROM tcnt UNION SELECT user_id, bucket FROM kd)
        SELECT ub.user_id, ub.bucket, CAST(coalesce(tcnt.c, 0) AS BIGINT) AS news_cnt, kd.term,
            round(kd.weight, 6) AS weight
        FROM ub LEFT JOIN tcnt USING (user_id, bucket) LEFT JOIN kd USING (user_id, bucket)"""),
    "profiles_saved": sql(KW + " vec dvec tsum tcnt prof", f"""
        , nk AS (SELECT user_id, bucket, count(*) AS n FROM kd GROUP BY ALL)
        SELECT p.user_id, CAST(p.k AS INTEGER) AS k, round(p.x, 6) AS topic,
            CAST(coalesce(nk.n, 0) AS INTEGER) AS n_keywords
        FROM prof p LEFT JOIN nk USING (user_id, bucket) WHERE p.bucket = {MORNING}"""),
    "read_profiles": sql(KW + " vec dvec tsum tcnt prof", f"""
        , ids AS (SELECT DISTINCT user_id FROM ulog)
        , users AS (SELECT user_id FROM ids UNION ALL SELECT user_id + 1000000000 FROM ids)
        , np AS (SELECT user_id, count(*) AS n FROM prof WHERE bucket = {MORNING} GROUP BY ALL)
        , nc AS (SELECT user_id, c FROM tcnt WHERE bucket = {MORNING})
        , nk AS (SELECT user_id, count(*) AS n, sum(weight) AS w FROM kd WHERE bucket = {MORNING} GROUP BY ALL)
        SELECT u.user_id, CAST(coalesce(np.n, 0) AS INTEGER) AS n_topics,
            CAST(coalesce(nc.c, 0) AS BIGINT) AS news_cnt, CAST(coalesce(nk.n, 0) AS INTEGER) AS n_keywords,
            round(coalesce(nk.w, 0.0), 5) AS weights
        FROM users u LEFT JOIN np USING (user_id) LEFT JOIN nc USING (user_id) LEFT JOIN nk USING (user_id)"""),
    "profile_bucket": sql(KW + " vec dvec tsum tcnt prof", f"""
        , nk AS (SELECT user_id, bucket, count(*) AS n FROM kd GROUP BY ALL)
        SELECT p.user_id, CAST(p.k AS INTEGER) AS k, round(p.x, 6) AS topic,
            CAST(coalesce(nk.n, 0) AS INTEGER) AS n_keywords
        FROM prof p LEFT JOIN nk USING (user_id, bucket) WHERE p.bucket = {MORNING}"""),
    "cosine_pairs": sql(TOPIC + " mprof pn", f"""
        , pairs AS (SELECT DISTINCT user_id, doc_id FROM ulog
                    WHERE user_id IN (SELECT user_id FROM tcnt WHERE bucket = {MORNING}))
        , dn AS (SELECT doc_id, sqrt(sum(x * x)) AS nrm FROM dvec GROUP BY ALL)
        , pd AS (SELECT pr.user_id, pr.doc_id, sum(m.x * dv.x) AS d
                 FROM pairs pr JOIN mprof m USING (user_id)
                 JOIN dvec dv ON dv.doc_id = pr.doc_id AND dv.k = m.k GROUP BY ALL)
        SELECT pr.user_id, pr.doc_id,
            round(CASE WHEN pn.nrm > 0 AND dn.nrm > 0 THEN coalesce(pd.d, 0) / (pn.nrm * dn.nrm)
                  ELSE 0.0 END, 6) AS sim
        FROM pairs pr LEFT JOIN pd USING (user_id, doc_id) LEFT JOIN pn USING (user_id)
        LEFT JOIN dn USING (doc_id)"""),
    "jaccard_pairs": sql(KW + " mterms " + NEW + " jac",
                         "SELECT user_id, doc_id, shared, round(sim, 6) AS sim FROM jac"),
    "score_single": SCORE_SINGLE,
    "score_hybrid": hybrid(P.min_similarity, P.topic_weight, P.keyword_weight),
    "score_hybrid_floor": hybrid(P.min_similarity, P.topic_weight, P.keyword_weight),
    "score_hybrid_keywords": hybrid(*C.KEYWORD_LED),
    "blend": sql(COS + " content cfl", f"""
        , cs AS (SELECT user_id, doc_id, round(sim, 6) AS score FROM content)
        , q AS (SELECT user_id, count(*) AS n,
                CASE WHEN count(*) > 5 THEN CAST(floor(count(*) * CAST({RATIO} AS DOUBLE)) AS INTEGER)
                     ELSE 1 END AS q FROM cs GROUP BY ALL)
        , cr AS (SELECT user_id, doc_id, 'content' AS source,
                 CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, doc_id) AS INTEGER)
                   AS rk FROM cs)
        , fr AS (SELECT f.user_id, f.doc_id, q.n, q.q,
                 row_number() OVER (PARTITION BY f.user_id ORDER BY f.score DESC, f.doc_id) AS r
                 FROM cfl f JOIN q USING (user_id))
        SELECT user_id, doc_id, source, rk FROM cr
        UNION ALL
        SELECT user_id, doc_id, 'cf' AS source, CAST(r + n AS INTEGER) AS rk FROM fr WHERE r <= q"""),
    "top_topics": sql("vec", f"""SELECT vec_id, CAST(k AS INTEGER) AS k,
        round(CASE WHEN rn <= {C.TOP_TOPICS} THEN x ELSE 0.0 END, 6) AS weight
        FROM (SELECT vec_id, k, x, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, k) AS rn
              FROM vec)"""),
    "queue_unread": sql(BASE + " queue",
                        "SELECT doc_id, doc_type, rowkey FROM queue WHERE NOT has_read"),
    "queue_mark_read": sql(BASE + " queue", """
        , done AS (SELECT DISTINCT doc_id, 'benchmark' AS doc_type FROM ulog WHERE behaviour = 4)
        SELECT q.doc_id, q.doc_type, q.rowkey, (q.has_read OR d.doc_id IS NOT NULL) AS has_read
        FROM queue q LEFT JOIN done d ON d.doc_id = q.doc_id AND d.doc_type = q.doc_type"""),
    "recs_append": sql(COS + " content cfl", """
        SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(doc_id AS VARCHAR) AS doc_id,
            count(*) AS n_sources FROM (
            SELECT DISTINCT user_id, doc_id, source FROM (
                SELECT user_id, doc_id, 'content' AS source FROM content
                UNION ALL SELECT user_id, doc_id, 'cf' AS source FROM cfl))
        GROUP BY ALL"""),
    "lda_topics": sql("vt vocab", f"""SELECT d.doc_id, {P.n_topics} AS n_topics, true AS valid,
            CAST(CASE WHEN k.doc_id IS NULL THEN 0 ELSE 1 END AS DOUBLE) AS total
        FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM vt JOIN vocab USING (term)) k
          ON k.doc_id = d.doc_id"""),
    "lda_online": sql("vt vocab", f"""SELECT d.doc_id, {P.n_topics} AS n_topics, true AS valid,
            CAST(CASE WHEN k.doc_id IS NULL THEN 0 ELSE 1 END AS DOUBLE) AS total
        FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM vt JOIN vocab USING (term)) k
          ON k.doc_id = d.doc_id"""),
    "lda_describe": sql("vt vocab", f"""SELECT CAST(unnest(range({P.n_topics})) AS INTEGER) AS topic,
        (SELECT least(10, count(*)) FROM vocab) AS n_terms, (SELECT least(10, count(*)) FROM vocab) AS n_known,
        true AS positive"""),
    "top_inner_product": sql(TOPIC + " mprof", f"""SELECT user_id, vec_id, CAST(rk AS INTEGER) AS rk,
        round(score, 6) AS score FROM (
          SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, vec_id) AS rk FROM (
            SELECT p.user_id, v.vec_id, sum(p.x * v.x) AS score FROM mprof p JOIN vec v ON v.k = p.k
            GROUP BY p.user_id, v.vec_id)) WHERE rk <= {C.TOP_VECTORS}"""),
    "topic_neighbours": sql(TOPIC + " mprof", f"""SELECT user_id, vec_id, round(dp / (nu * nv), 6) AS sim FROM (
          SELECT p.user_id, v.vec_id, sum(p.x * v.x) AS dp FROM mprof p JOIN vec v ON v.k = p.k
          GROUP BY p.user_id, v.vec_id)
        JOIN (SELECT user_id, sqrt(sum(x * x)) AS nu FROM mprof GROUP BY user_id) USING (user_id)
        JOIN (SELECT vec_id, sqrt(sum(x * x)) AS nv FROM vec GROUP BY vec_id) USING (vec_id)
        WHERE dp / (nu * nv) > {C.NEIGHBOUR_COSINE}"""),
    "cf_recommend": sql(BASE, f"""SELECT user_id, n AS n_items, n AS n_known, CAST(n AS INTEGER) AS last_rank
        FROM (SELECT DISTINCT user_id, (SELECT least({P.cf_items}, count(DISTINCT doc_id)) FROM ulog) AS n
              FROM ulog)"""),
    "cf_text_ids": sql(BASE, f"""SELECT user_id, n AS n_items, CAST(n AS INTEGER) AS last_rank
        FROM (SELECT DISTINCT 'u' || CAST(user_id AS VARCHAR) AS user_id,
                (SELECT least({P.cf_items}, count(DISTINCT doc_id)) FROM ulog) AS n FROM ulog)"""),
    "stream_recommend": SCORE_SINGLE,
    "in_zone": """SELECT event_id,
        strftime(ts, '%H:%M:%S') BETWEEN '06:00:00' AND '11:59:59' AS in_zone
        FROM events WHERE ts IS NOT NULL""",
    "pad_vectors": f"""SELECT vec_id, CAST(k AS INTEGER) AS k,
        round(CASE WHEN k < len(embedding) THEN CAST(embedding[k + 1] AS DOUBLE) ELSE 0.0 END, 6) AS x
        FROM (SELECT vec_id, embedding, UNNEST(range(greatest(len(embedding), {C.PAD_TO}))) AS k
              FROM embeddings)""",
    "topic_unscale": sql(TOPIC, """SELECT p.user_id, p.bucket, CAST(p.k AS INTEGER) AS k,
        round(p.x * c.c, 6) AS topic_sum FROM prof p JOIN tcnt c USING (user_id, bucket)"""),
    "user_dictionary_text": sql(BASE, """SELECT count(DISTINCT user_id) AS n_users,
        count(DISTINCT user_id) AS n_idx, 0 AS lo, CAST(count(DISTINCT user_id) - 1 AS INTEGER) AS hi FROM ulog"""),
    "user_dictionary": sql(BASE, """SELECT DISTINCT user_id, CAST(user_id AS INTEGER) AS user_idx
        FROM ulog"""),
}

# the same state, left by the jobs, the store and the stream
for name, same in (("job_topics", "topic_merge"), ("store_compact", "topic_merge"), ("stream_profiles", "topic_merge"),
                   ("job_keywords", "keyword_merge_add"), ("queue_store_mark", "queue_mark_read")):
    ORACLE[name] = ORACLE[same]
ORACLE["job_vocabulary"] = f"SELECT idx, term FROM ({ORACLE['vocabulary']})"
ORACLE["job_cf"] = sql(BASE, f"""SELECT DISTINCT user_id, (SELECT least({P.cf_items}, count(DISTINCT doc_id))
    FROM ulog) AS n_items, 0 AS batch_id FROM ulog WHERE bucket = {MORNING}""")
ORACLE["vocabulary_heavy"] = ORACLE["vocabulary"]
ORACLE["term_similarities"] = sql("vt vocab cv", f"""
    , norm AS (SELECT idx, sqrt(sum(CAST(tf AS DOUBLE) * tf)) AS n FROM cv GROUP BY idx)
    , dots AS (SELECT a.idx AS idx_a, b.idx AS idx_b, sum(CAST(a.tf AS DOUBLE) * b.tf) AS dp
        FROM cv a JOIN cv b ON a.doc_id = b.doc_id AND a.idx < b.idx GROUP BY ALL)
    SELECT idx_a, idx_b, round(dp / (x.n * y.n), 6) AS sim FROM dots
    JOIN norm x ON x.idx = idx_a JOIN norm y ON y.idx = idx_b WHERE dp / (x.n * y.n) >= {C.TERM_COSINE} - 1e-9""")
ORACLE["id_runs"] = sql(BASE, """
    , runs AS (SELECT CAST(unnest(range(1, 4)) AS INTEGER) AS run)
    , n AS (SELECT run, count(DISTINCT user_id) AS n FROM runs JOIN ulog ON ((user_id % 4) + 4) % 4 < run GROUP BY run)
    SELECT run, n AS n_ids, n AS n_idx, CAST(n - 1 AS INTEGER) AS last,
        coalesce(lag(n) OVER (ORDER BY run), 0) AS n_kept FROM n""")
ORACLE["jaccard_near"] = sql(KW + " mterms " + NEW + " jac", f"""SELECT user_id, doc_id, shared, round(sim, 6) AS sim
    FROM jac WHERE sim >= {C.KEYWORD_JACCARD} - 1e-9""")
