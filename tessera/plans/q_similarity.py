"""Similar-incident queries (Q1-Q5).  Queries are the live events mapped to incidents."""

from __future__ import annotations


from tessera.functions import rules as R
from tessera.operators import live, similarity
from tessera.plans.q_live import LIVE_CTES, LIVE_ROWS_SQL, live_feed
from tessera.plans.registry import query


def doc_sql(p: str = "") -> str:
    parts = [f"CASE WHEN trim(CAST({p}{c} AS VARCHAR)) IS NOT NULL AND lower(trim(CAST({p}{c} AS VARCHAR))) "
             f"NOT IN ('', 'nan', 'unknown') THEN trim(CAST({p}{c} AS VARCHAR)) || ' ' || trim(CAST({p}{c} AS VARCHAR)) END"
             for c in R.DOC_COLUMNS]
    k = f"greatest(coalesce(CAST({p}nkill AS DOUBLE), 0.0), 0.0)"
    w = f"greatest(coalesce(CAST({p}nwound AS DOUBLE), 0.0), 0.0)"
    parts.append("CASE " + " ".join(f"WHEN {k} <= {c} THEN '{t}'" for c, t in R.FATALITY_BANDS)
                 + " ELSE 'high_fatalities' END")
    parts.append("CASE " + " ".join(f"WHEN {w} <= {c} THEN '{t}'" for c, t in R.INJURY_BANDS)
                 + " ELSE 'high_injuries' END")
    parts.append(f"CASE WHEN coalesce(CAST({p}success AS INT), 1) = 1 THEN 'attack_successful' ELSE 'attack_failed' END")
    return "concat_ws(' ', " + ", ".join(parts) + ")"


def _terms(src: str, key: str) -> str:
    return f"""SELECT {key}, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS term
  FROM (SELECT {key}, regexp_extract_all(lower(doc), '\\b\\w\\w+\\b') AS t FROM {src}) x"""


TFIDF_CTES = f"""{LIVE_CTES},
qrows AS ({LIVE_ROWS_SQL}),
inc AS (SELECT incident_id, {doc_sql()} AS doc FROM incidents),
trm AS ({_terms('inc', 'incident_id')}),
tc AS (SELECT incident_id, term, count(*) AS tf FROM trm GROUP BY incident_id, term),
nn AS (SELECT count(*) AS n FROM inc),
st AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM tc GROUP BY term),
voc AS (SELECT term, df, ln((n + 1) / (df + 1)) + 1 AS idf FROM st, nn WHERE df >= {R.VOCAB_MIN_DF}
  ORDER BY cf DESC, term LIMIT {R.VOCAB_MAX_FEATURES}),
dw AS (SELECT incident_id, term, (1 + ln(tf)) * idf AS w FROM tc JOIN voc USING (term)),
dn AS (SELECT incident_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY incident_id)) AS w FROM dw),
q AS (SELECT DISTINCT {doc_sql()} AS doc FROM qrows),
qt AS ({_terms('q', 'doc')}),
qtc AS (SELECT doc AS query_doc, term, count(*) AS tf FROM qt GROUP BY doc, term),
qw AS (SELECT query_doc, term, (1 + ln(tf)) * idf AS w FROM qtc JOIN voc USING (term)),
qn AS (SELECT query_doc, term, w / sqrt(sum(w * w) OVER (PARTITION BY query_doc)) AS w FROM qw)"""


def _queries(spark):
    return live.to_incident_rows(live_feed(spark))


@query("q1_pseudo_documents", oracle=f"SELECT incident_id, {doc_sql()} AS doc FROM incidents")
def q1_pseudo_documents(spark):
    inc = spark.table("incidents")
    return inc.select("incident_id", similarity.pseudo_document(inc).alias("doc"))


@query("q2_terms", oracle=f"""WITH inc AS (SELECT incident_id, {doc_sql()} AS doc FROM incidents),
trm AS ({_terms('inc', 'incident_id')})
SELECT incident_id, term, count(*) AS tf FROM trm GROUP BY incident_id, term""")
def q2_terms(spark):
    inc = spark.table("incidents")
    d = inc.select("incident_id", similarity.pseudo_document(inc).alias("doc"))
    return similarity.term_counts(d, "doc", ("incident_id",))


@query("q3_vocabulary", oracle=f"""WITH {TFIDF_CTES}
SELECT term, df, round_even(idf, 9) AS idf FROM voc""")
def q3_vocabulary(spark):
    docs = similarity.distinct_documents(spark.table("incidents"))
    v = similarity.vocabulary(docs, similarity.term_counts(docs))
    from tessera.functions.expr import round_even
    return v.withColumn("idf", round_even("idf", 9))


@query("q4_tfidf_weights", oracle=f"""WITH {TFIDF_CTES}
SELECT i.incident_id, dn.term, round_even(dn.w, 9) AS w FROM dn JOIN inc i USING (incident_id)""")
def q4_tfidf_weights(spark):
    from tessera.functions.expr import round_even
    inc = spark.table("incidents")
    docs = similarity.distinct_documents(inc)
    tc = similarity.term_counts(docs)
    vec = similarity.tfidf(tc, similarity.vocabulary(docs, tc))
    ids = inc.select("incident_id", similarity.doc_key(similarity.pseudo_document(inc)).alias("doc_id"))
    return ids.join(vec, "doc_id").select("incident_id", "term", round_even("w", 9).alias("w"))


@query("q5_similar_incidents", bench=True, oracle=f"""WITH {TFIDF_CTES},
sc AS (SELECT query_doc, incident_id, sum(qn.w * dn.w) AS score FROM qn JOIN dn USING (term)
  GROUP BY query_doc, incident_id),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_doc ORDER BY round_even(score, 9) DESC, incident_id DESC)
  AS rank FROM sc)
SELECT query_doc, rank, incident_id, round_even(score, 6) AS similarity_score,
  round_even(score * 100, 1) AS similarity_pct, i.iyear, i.country_txt, i.city, i.attacktype1_txt, i.gname, i.nkill
FROM rk JOIN incidents i USING (incident_id) WHERE rank <= 10""")
def q5_similar_incidents(spark):
    return similarity.similar_incidents(spark.table("incidents"), _queries(spark), 10,
                                        columns=["iyear", "country_txt", "city", "attacktype1_txt", "gname", "nkill"])
