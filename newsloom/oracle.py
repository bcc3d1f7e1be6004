"""The registered queries as plain SQL, to check their results with another engine.

Common parts are spelled once and put together here; nothing in this module is
used by the library.
"""

from __future__ import annotations

EARLIER, AS_OF = "TIMESTAMP '2024-01-01 00:00:00'", "TIMESTAMP '2024-01-16 00:00:00'"
# The letters of a usable summary; the default voices.
LETTERS = "a-záàảãạăắằẳẵặâấầẩẫậéèẻẽẹêếềểễệíìỉĩịóòỏõọôốồổỗộơớờởỡợúùủũụưứừửữựýỳỷỹỵđ"
VOICES = "('Doan', 'Giọng nữ miền Nam'), ('Binh', 'Giọng nam miền Bắc')"
SPACE = r"[\s\p{Z}\x0b\x85\x1c-\x1f]+"


def shown(time: str) -> str:
    return f"strftime({time}, '%Y-%m-%d %H:%M:%S')"


def clean(text: str) -> str:
    spaced = f"regexp_replace({text}, '{SPACE}', ' ', 'g')"
    unlinked = rf"regexp_replace({spaced}, 'https?://[^ ]+|www\.[^ ]+', '', 'g')"
    return f"trim(regexp_replace({unlinked}, ' +', ' ', 'g'))"


def split(cleaned: str) -> str:
    marked = rf"regexp_replace({cleaned}, '([.!?]) ', '\1' || chr(1), 'g')"
    return f"list_filter(string_split({marked}, chr(1)), lambda s: s <> '')"


def terms(sentence: str) -> str:
    return rf"regexp_extract_all(lower({sentence}), '[\p{{L}}\p{{N}}_]{{2,}}')"


def kept(n: str, ratio: float) -> str:
    return f"CASE WHEN {n} <= 2 THEN {n} ELSE greatest(1, trunc({n} * {ratio}::DOUBLE)) END"


def bucket(term: str, dim: int = 64, seed: str = "") -> str:
    return f"('0x' || substr(md5('{seed}' || {term}), 1, 8))::BIGINT % {dim}"


# --- the tables as articles, index, results and requests -----------------------------------

SPLIT_DOCS = f"""
cleaned AS (SELECT doc_id, text, lang, source, {clean('text')} AS c FROM documents),
split_docs AS (SELECT *, {split('c')} AS ss FROM cleaned),
sent AS (SELECT doc_id, len(ss) AS n, unnest(ss) AS sentence, generate_subscripts(ss, 1) - 1 AS idx FROM split_docs)
"""

ARTICLES = f"""{SPLIT_DOCS},
articles AS (SELECT doc_id AS id, CASE WHEN len(ss) >= 2 THEN ss[1] END AS title,
  CASE WHEN len(ss) >= 2 THEN ss[2] END AS description, nullif(source, 'src0') AS category,
  text AS content FROM split_docs)
"""

INDEX = """
idx AS (SELECT vec_id AS news_id, label::VARCHAR AS category, 'title ' || vec_id AS title,
  embedding::DOUBLE[] AS v FROM embeddings)
"""

RESULTS = f"""
results AS (SELECT doc_id AS news_id, CASE WHEN toxic = 1 THEN 1 ELSE 0 END AS n_audio,
  CASE WHEN quality = 1 THEN 'short ' || doc_id END AS summary_short, 'medium ' || doc_id AS summary_medium,
  CASE WHEN toxic = 0 THEN 'default ' || doc_id ELSE '' END AS summary_default,
  {EARLIER} AS created_at, {EARLIER} AS updated_at FROM labels)
"""
SHOWN_RESULTS = (
    "news_id, n_audio::BIGINT AS n_audio, summary_short, summary_medium, summary_default, "
    f"{shown('created_at')} AS created_at, {shown('updated_at')} AS updated_at"
)

LOG = """
log AS (SELECT event_id, user_id AS news_id, floor(value)::INT AS k,
  CASE WHEN event_type = 'click' THEN (event_id % 10)::VARCHAR END AS category_filter, ts FROM events)
"""
CACHE = f"""{LOG},
cache AS (SELECT news_id, k, coalesce(category_filter, 'all') AS category_key, max(ts) AS computed_at,
  max(ts) + INTERVAL 86400 SECOND AS expires_at FROM log WHERE ts <= {AS_OF} GROUP BY 1, 2, 3)
"""
KNOWN_IDS = "asked AS (SELECT DISTINCT user_id * 9 AS news_id FROM events)"


def top_k(join: str, k: int) -> str:
    return f"""WITH {INDEX},
pairs AS (SELECT a.news_id AS source_news_id, b.news_id, b.title, b.category, list_cosine_similarity(a.v, b.v) AS score
  FROM idx a JOIN idx b ON a.news_id <> b.news_id AND {join}),
ranks AS (SELECT *, row_number() OVER (PARTITION BY source_news_id ORDER BY round(score, 9) DESC, news_id) AS rank
  FROM pairs WHERE score >= 0.1)
SELECT source_news_id, rank, news_id, title, category, round(score, 4) AS similarity_score FROM ranks WHERE rank <= {k}"""


# --- sentence scores -----------------------------------------------------------------------

TFIDF = f"""
tok AS (SELECT doc_id, n, idx, unnest({terms('sentence')}) AS term FROM sent),
tf AS (SELECT doc_id, n, idx, term, count(*) AS tf FROM tok GROUP BY ALL),
df AS (SELECT doc_id, term, count(*) AS df FROM tf GROUP BY ALL),
raw AS (SELECT tf.*, df.df, ln((1 + n)::DOUBLE / (1 + df.df)::DOUBLE) + 1 AS idf,
  tf.tf * (ln((1 + n)::DOUBLE / (1 + df.df)::DOUBLE) + 1) AS w FROM tf JOIN df USING (doc_id, term))
"""


def hashed(dim: int = 64, seed: str = "") -> str:
    return f"""
tok AS (SELECT doc_id, n, idx, unnest({terms('sentence')}) AS t FROM sent),
raw AS (SELECT doc_id, n, idx, {bucket('t', dim, seed)} AS term, count(*) AS w FROM tok GROUP BY ALL)
"""


CENTRALITY = """
norms AS (SELECT doc_id, idx, sqrt(sum(w * w)) AS norm FROM raw GROUP BY ALL),
units AS (SELECT raw.*, w / norm AS u FROM raw JOIN norms USING (doc_id, idx)),
totals AS (SELECT doc_id, term, sum(u) AS total FROM units GROUP BY ALL),
sums AS (SELECT doc_id, idx, round(sum(u * total), 9) AS score FROM units JOIN totals USING (doc_id, term) GROUP BY ALL),
scored AS (SELECT sent.*, coalesce(score, 0) AS score FROM sent LEFT JOIN sums USING (doc_id, idx))
"""


def ranks(ties: str) -> str:
    return f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, idx {ties}) AS rank,
  max(score) OVER (PARTITION BY doc_id) AS best FROM scored)"""


def picked(ratio: float, name: str = "picked") -> str:
    k = kept("n", ratio)
    return f"""{name} AS (SELECT doc_id, string_agg(sentence, ' ' ORDER BY idx) AS summary FROM ranked
  WHERE CASE WHEN best = 0 THEN idx < {k} ELSE rank <= {k} END GROUP BY doc_id)"""


def summary(raw: str, ties: str, ratio: float = 0.3) -> str:
    return f"""WITH {SPLIT_DOCS}, {raw}, {CENTRALITY}, {ranks(ties)}, {picked(ratio)}
SELECT doc_id, coalesce(summary, '') AS summary FROM documents LEFT JOIN picked USING (doc_id)"""


def ranking(raw: str, ties: str) -> str:
    return f"""WITH {SPLIT_DOCS}, {raw}, {CENTRALITY}, {ranks(ties)}
SELECT doc_id, idx, round(score, 6) AS score, rank FROM ranked"""


def lead(ratio: float) -> str:
    return f"array_to_string(list_slice(ss, 1, CAST({kept('len(ss)', ratio)} AS BIGINT)), ' ')"


LEFT_OUT = f"""misses AS (SELECT d.doc_id AS news_id FROM documents d LEFT JOIN results r ON r.news_id = d.doc_id
  WHERE NOT (coalesce(summary_short <> '', false) AND coalesce(summary_default <> '', false) AND lang <> 'fr'))"""

LIST_COLUMNS = "id, title, description, category"


def compared() -> str:
    def part(name: str, raw: str, ties: str) -> str:
        return f"""(WITH {raw}, {CENTRALITY}, {ranks(ties)}, {picked(0.4)}
SELECT doc_id, '{name}' AS method, coalesce(summary, '') AS summary FROM documents LEFT JOIN picked USING (doc_id))"""

    return f"""WITH {SPLIT_DOCS},
made AS (SELECT doc_id, 'position' AS method, {lead(0.4)} AS summary FROM split_docs
  UNION ALL {part('tfidf', TFIDF, 'DESC')} UNION ALL {part('embedding', hashed(), 'ASC')})
SELECT method, count(*) AS n_docs, round(avg(length(summary)), 4) AS avg_summary_chars,
  round(avg(length(summary) / length(text)), 6) AS avg_compression
FROM made JOIN documents USING (doc_id) GROUP BY method"""


FILE_NAME = "'tts_20240116_000000_' || substr(md5(content), 1, 8) || '.wav'"


def indexed(union: str) -> str:
    return f"""WITH {ARTICLES},
texts AS (SELECT id, title, category, CASE WHEN description IS NULL OR description = '' THEN title ELSE title || ' ' || description END AS t
  FROM articles WHERE title IS NOT NULL AND title <> ''),
hits AS (SELECT id, b, count(*) AS n FROM (SELECT id, {bucket('x')} AS b FROM (SELECT id, unnest({terms('t')}) AS x FROM texts)) GROUP BY ALL),
vectors AS (SELECT id, string_agg(b || ':' || n, ',' ORDER BY b) AS vector FROM hits GROUP BY id)
{union}"""


ALL_INDEXED = indexed(f"""SELECT id AS news_id, coalesce(category, 'UNKNOWN') AS category, title, coalesce(vector, '') AS vector,
  {shown(f'CASE WHEN doc_id IS NULL THEN {AS_OF} ELSE {EARLIER} END')} AS created_at
FROM texts LEFT JOIN vectors USING (id) LEFT JOIN labels ON doc_id = id""")

TALLY = f"""WITH {ARTICLES}, statused AS (SELECT CASE WHEN doc_id IS NOT NULL THEN 'known' WHEN coalesce(title, '') = '' THEN 'untitled' WHEN length(category) > 50 THEN 'bad' ELSE 'new' END AS s
  FROM articles LEFT JOIN seeded ON doc_id = id)
SELECT count(*) FILTER (s = 'new') AS indexed, count(*) FILTER (s IN ('known', 'untitled')) AS skipped,
  count(*) FILTER (s = 'known') AS already_indexed, count(*) FILTER (s = 'untitled') AS no_title, count(*) FILTER (s = 'bad') AS invalid FROM statused"""
# Indexed before: the labelled documents with a title.
TALLY = TALLY.replace("statused AS", "seeded AS (SELECT doc_id FROM labels JOIN articles ON id = doc_id WHERE title <> ''), statused AS", 1)

HITS_SINCE = f"""WITH {CACHE}, {ARTICLES},
added AS (SELECT DISTINCT substr(category, 4) AS category FROM articles
  WHERE category IN ('src1', 'src2', 'src3') AND title <> '' AND id NOT IN (SELECT doc_id FROM labels)),
since AS (SELECT category FROM added UNION SELECT 'all' FROM added),
live AS (SELECT * FROM cache WHERE {AS_OF} < expires_at
  AND NOT (category_key IN (SELECT category FROM since) AND computed_at <= TIMESTAMP '2024-01-15 12:00:00'))
SELECT event_id, coalesce(category_filter, 'all') AS category_key, l.news_id IS NOT NULL AS hit
FROM log LEFT JOIN live l ON l.news_id = log.news_id AND l.k = log.k AND l.category_key = coalesce(log.category_filter, 'all')"""

ORACLE: dict[str, str] = {
    "list_articles": f"WITH {ARTICLES} SELECT {LIST_COLUMNS} FROM articles",
    "articles_in_category": f"WITH {ARTICLES} SELECT {LIST_COLUMNS} FROM articles WHERE category = 'src3'",
    "article_page": f"WITH {ARTICLES} SELECT {LIST_COLUMNS} FROM articles ORDER BY id LIMIT 75 OFFSET 150",
    "fetch_content": f"""WITH {ARTICLES}, {KNOWN_IDS}
SELECT news_id, title, content AS content_plain_text, CASE WHEN id IS NULL THEN 'not_found' ELSE 'ok' END AS status
FROM asked LEFT JOIN articles ON id = news_id""",
    "append_batches": f"""WITH {INDEX} SELECT news_id, category, title,
  array_to_string(list_transform(v, lambda x: round(x * 1e6)::BIGINT::VARCHAR), ',') AS vector FROM idx""",
    "upsert_results": f"""WITH {RESULTS},
new AS (SELECT doc_id AS news_id, CASE WHEN lang = 'en' THEN 'new ' || n_chars END AS short FROM documents)
SELECT news_id, coalesce(n_audio, 0)::BIGINT AS n_audio, coalesce(short, summary_short) AS summary_short, summary_medium, summary_default,
  {shown(f'coalesce(created_at, {AS_OF})')} AS created_at,
  {shown(f'CASE WHEN n.news_id IS NULL THEN updated_at ELSE {AS_OF} END')} AS updated_at
FROM results FULL JOIN new n USING (news_id)""",
    "merged_updates": """SELECT user_id AS news_id, 's' || max(event_id) FILTER (event_type = 'click') AS summary_short,
  'd' || max(event_id) FILTER (event_type <> 'click') AS summary_default FROM events GROUP BY user_id""",
    "published_results": f"""WITH {RESULTS},
new AS (SELECT doc_id AS news_id, CASE WHEN lang = 'en' THEN 'new ' || n_chars END AS short FROM documents)
SELECT news_id, coalesce(short, summary_short) AS summary_short, summary_medium, summary_default,
  {shown(f'coalesce(created_at, {AS_OF})')} AS created_at, {shown(f'CASE WHEN n.news_id IS NULL THEN updated_at ELSE {AS_OF} END')} AS updated_at,
  CASE WHEN n_audio = 1 THEN 'Binh|d|u/' || news_id || '|audio/Binh/' || news_id || '|' || news_id ELSE '' END AS audio_files
FROM results FULL JOIN new n USING (news_id) WHERE news_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'fr')""",
    "links_after_delete": """SELECT 'audio/Binh/' || doc_id AS s3_key FROM labels
WHERE toxic = 1 AND doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'fr')""",
    "delete_results": f"""WITH {RESULTS} SELECT {SHOWN_RESULTS} FROM results
WHERE news_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'fr')""",
    "deletion_report": """SELECT d.doc_id AS news_id, l.doc_id IS NOT NULL AS deleted
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE lang = 'fr'""",
    "one_per_key": """SELECT event_id, user_id, event_type, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) = 1""",
    "duplicate_counts": """SELECT count(*) AS n_rows, count(DISTINCT user_id) AS n_keys,
  count(*) - count(DISTINCT user_id) AS n_duplicates FROM events""",
    "row_constraints": """WITH planted AS (SELECT doc_id, n_chars % 7 AS f, source, n_chars, embedding
  FROM documents LEFT JOIN embeddings ON vec_id = doc_id)
SELECT doc_id, array_to_string(list_filter([
  CASE WHEN f = 0 THEN 'news_id_null' END, CASE WHEN f = 1 THEN 'category_null' END,
  CASE WHEN f <> 1 AND length(source) * (n_chars % 20) > 50 THEN 'category_too_long' END,
  CASE WHEN f = 2 THEN 'title_null' END, CASE WHEN embedding IS NULL THEN 'embedding_null' END,
  CASE WHEN f = 3 AND embedding IS NOT NULL THEN 'embedding_dim' END], lambda x: x IS NOT NULL), ',') AS violations FROM planted""",
    "result_defaults": f"""SELECT doc_id AS news_id, 0::BIGINT AS n_audio,
  {shown(f'CASE WHEN quality = 1 THEN {EARLIER} ELSE {AS_OF} END')} AS created_at, {shown(AS_OF)} AS updated_at FROM labels""",
    "titled_articles": f"WITH {ARTICLES} SELECT id, title FROM articles WHERE title IS NOT NULL AND title <> ''",
    "content_status": """SELECT doc_id AS id, CASE WHEN lang IN ('fr', 'de') OR text IS NULL OR text = '' THEN 'no_content' ELSE 'ok' END AS status
FROM documents""",
    "request_bounds": f"WITH {LOG} SELECT event_id, k, CASE WHEN k BETWEEN 1 AND 50 THEN 'ok' ELSE 'invalid' END AS status FROM log",
    "usable_summaries": f"""SELECT doc_id, regexp_matches(lower(text), '[{LETTERS}]') AS usable,
  regexp_matches(lower(regexp_replace(text, '[a-z]', '', 'g')), '[{LETTERS}]') AS usable_capitals,
  regexp_matches(regexp_replace(text, '[a-z]', '', 'g'), '[{LETTERS}]') AS usable_capitals_exact FROM documents""",
    "clean_text": f"SELECT doc_id, {clean('text')} AS cleaned FROM documents",
    "sentences": rf"""WITH parts AS (SELECT doc_id, list_filter(list_transform(
  string_split(regexp_replace(text, '([.!?]){SPACE}', '\1' || chr(1), 'g'), chr(1)),
  lambda s: regexp_replace(s, '^{SPACE}|{SPACE}$', '', 'g')), lambda s: s <> '') AS ss FROM documents)
SELECT doc_id, unnest(ss) AS sentence, generate_subscripts(ss, 1) - 1 AS idx FROM parts""",
    "embedding_inputs": f"""WITH {ARTICLES} SELECT id,
  CASE WHEN nullif(description, title) IS NULL OR description = '' THEN title ELSE title || ' ' || description END AS embedding_text FROM articles""",
    "lead_words": f"""WITH words AS (SELECT doc_id, text, regexp_split_to_array(regexp_replace(text, '^{SPACE}|{SPACE}$', '', 'g'), '{SPACE}') AS w FROM documents)
SELECT doc_id, CASE WHEN len(w) <= 150 THEN text ELSE array_to_string(w[1:150], ' ') || '...' END AS lead FROM words""",
    "printable_text": rf"""SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[^\x00-\x7F\x{{00C0}}-\x{{1EF9}}\s\p{{Z}}\x85]', '', 'g'),
  '{SPACE}', ' ', 'g')) AS printable FROM documents""",
    "default_categories": "SELECT doc_id AS id, CASE WHEN source = 'src0' OR source IS NULL OR source = '' THEN 'UNKNOWN' ELSE source END AS category FROM documents",
    "sentence_terms": f"WITH {SPLIT_DOCS} SELECT doc_id, idx, array_to_string({terms('sentence')}, ' ') AS terms FROM sent",
    "artifact_manifest": f"""WITH named AS (SELECT doc_id AS news_id, CASE WHEN lang = 'fr' THEN 'Binh' ELSE 'Doan' END AS voice_id,
  lang AS description, 'tts_20240116_000000_' || substr(md5(text), 1, 8) || '.wav' AS filename, text FROM documents)
SELECT news_id, voice_id, description, 'http://localhost:9000/news/audio/' || voice_id || '/' || filename AS url,
  'audio/' || voice_id || '/' || filename AS s3_key, filename, length(text) AS text_length,
  {shown(AS_OF)} AS generated_at, length(text) BETWEEN 1 AND 5000 AS fits_speech FROM named""",
    "cached_payloads": f"""WITH {CACHE} SELECT 'rec:' || news_id || ':' || k || ':' || category_key AS key, news_id + 1 AS news_id,
  'cached' AS title, category_key AS category, 0.5::DOUBLE AS similarity_score FROM cache""",
    "unit_vectors": """WITH long AS (SELECT vec_id AS news_id, unnest(embedding)::DOUBLE * 3 AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)
SELECT news_id, pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY news_id)), 6) AS x FROM long""",
    "pair_cosines": f"""WITH {INDEX} SELECT a.news_id AS left_id, b.news_id AS right_id,
  round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM idx a JOIN idx b ON b.news_id = a.news_id + 1""",
    "article_embeddings": indexed("SELECT id, coalesce(vector, '') AS vector FROM texts LEFT JOIN vectors USING (id)"),
    "sentence_embeddings": f"""WITH {SPLIT_DOCS}, {hashed()},
vectors AS (SELECT doc_id, idx, string_agg(term || ':' || w, ',' ORDER BY term) AS vector FROM raw GROUP BY ALL)
SELECT doc_id, idx, coalesce(vector, '') AS vector FROM sent LEFT JOIN vectors USING (doc_id, idx)""",
    "new_articles": f"WITH {ARTICLES} SELECT id, category FROM articles WHERE id NOT IN (SELECT doc_id FROM labels)",
    "known_articles": f"WITH {ARTICLES} SELECT id, category FROM articles WHERE id IN (SELECT doc_id FROM labels)",
    "request_sources": f"""WITH {LOG} SELECT event_id, news_id * 5 AS news_id,
  CASE WHEN k NOT BETWEEN 1 AND 50 THEN 'invalid' WHEN vec_id IS NULL THEN 'source_missing' ELSE 'ok' END AS status
FROM log LEFT JOIN embeddings ON vec_id = news_id * 5""",
    "article_categories": f"""WITH {KNOWN_IDS} SELECT news_id,
  CASE WHEN source IS NULL OR source IN ('src0', '') THEN 'UNKNOWN' ELSE source END AS category FROM asked LEFT JOIN documents ON doc_id = news_id""",
    "article_exists": f"WITH {KNOWN_IDS} SELECT news_id, doc_id IS NOT NULL AS present FROM asked LEFT JOIN documents ON doc_id = news_id",
    "summary_cache": f"""WITH {RESULTS} SELECT doc_id AS news_id,
  coalesce(summary_short <> '', false) AND coalesce(summary_default <> '', false) AND lang <> 'fr' AS generate_hit,
  coalesce(summary_short <> '', false) OR coalesce(summary_default <> '', false) AS read_hit
FROM documents LEFT JOIN results ON news_id = doc_id""",
    "audio_cache": f"WITH {RESULTS} SELECT doc_id AS news_id, coalesce(n_audio > 0, false) AS hit FROM documents LEFT JOIN results ON news_id = doc_id",
    "audio_work_list": f"""WITH {RESULTS}, voices(voice_id, description) AS (VALUES {VOICES}),
asked AS (SELECT doc_id + 100 AS news_id FROM documents),
found AS (SELECT a.news_id, text, CASE WHEN d.doc_id IS NULL THEN 'not_found' WHEN coalesce(text, '') = '' THEN 'no_content' ELSE 'ok' END AS status
  FROM asked a LEFT JOIN documents d ON d.doc_id = a.news_id LEFT JOIN results r ON r.news_id = a.news_id WHERE coalesce(n_audio, 0) = 0)
SELECT news_id, voice_id, description, status, coalesce(length(text), 0) AS n_chars FROM found LEFT JOIN voices ON status = 'ok'""",
    "missing_voices": f"""WITH voices(voice_id, description) AS (VALUES {VOICES})
SELECT d.doc_id AS news_id, voice_id FROM documents d, voices
WHERE NOT (voice_id = 'Binh' AND d.doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1))""",
    "similar_to_one": top_k("a.news_id = 7", 50).replace("SELECT source_news_id, rank", "SELECT rank"),
    "similar_to_one_in_category": top_k("a.news_id = 7 AND b.category = '3'", 50).replace("SELECT source_news_id, rank", "SELECT rank"),
    "top_k_all": top_k("true", 10),
    "top_k_all_by_lists": top_k("true", 10),
    "top_k_all_by_tree": top_k("true", 10),
    "top_k_approximate_all_lists": top_k("true", 10),
    "top_k_same_category": top_k("a.category = b.category", 50),
    "top_k_other_category": top_k("((a.category::INT + 3) % 10)::VARCHAR = b.category", 50),
    "position_ranking": f"""WITH {SPLIT_DOCS}, scored AS (SELECT *, round(1 - idx / n, 9) AS score FROM sent), {ranks('ASC')}
SELECT doc_id, idx, round(score, 6) AS score, rank FROM ranked""",
    "tfidf_ranking": ranking(TFIDF, "DESC"),
    "embedding_ranking": ranking(hashed(), "ASC"),
    "total_indexed": "SELECT count(*) AS total_embeddings FROM embeddings",
    "count_by_category": "SELECT label::VARCHAR AS category, count(*) AS n FROM embeddings GROUP BY label",
    "index_stats": """SELECT sum(n)::BIGINT AS total_embeddings, string_agg(label || '=' || n, ',' ORDER BY label::VARCHAR) AS by_category
FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label)""",
    "index_tally": f"""WITH {ARTICLES}, statused AS (SELECT CASE WHEN doc_id IS NOT NULL THEN 'known' WHEN coalesce(title, '') = '' THEN 'untitled' WHEN length(category) > 50 THEN 'bad' ELSE 'new' END AS s
  FROM articles LEFT JOIN labels ON doc_id = id)
SELECT count(*) FILTER (s = 'new') AS indexed, count(*) FILTER (s IN ('known', 'untitled')) AS skipped,
  count(*) FILTER (s = 'known') AS already_indexed, count(*) FILTER (s = 'untitled') AS no_title, count(*) FILTER (s = 'bad') AS invalid FROM statused""",
    "collected_audio": f"""WITH voices(voice_id, description) AS (VALUES {VOICES}),
made AS (SELECT doc_id AS news_id, voice_id, 'http://localhost:9000/news/audio/' || voice_id || '/tts_20240116_000000_' || substr(md5(text), 1, 8) || '.wav' AS url
  FROM labels JOIN documents USING (doc_id), voices WHERE toxic = 0 AND coalesce(text, '') <> '')
SELECT news_id, string_agg(voice_id || '|' || url, ',' ORDER BY voice_id) AS audio_files FROM made GROUP BY news_id""",
    "tfidf_weights": f"""WITH {SPLIT_DOCS}, {TFIDF},
norms AS (SELECT doc_id, idx, sqrt(sum(w * w)) AS norm FROM raw GROUP BY ALL)
SELECT doc_id, idx, count(*) AS n_terms, sum(tf)::BIGINT AS tf, sum(df)::BIGINT AS df, round(sum(idf), 6) AS idf, round(sum(w / norm), 6) AS weight
FROM raw JOIN norms USING (doc_id, idx) GROUP BY ALL""",
    "similarity_rows": f"""WITH {SPLIT_DOCS}, {TFIDF}, {CENTRALITY}, {ranks('DESC')},
best AS (SELECT doc_id, idx FROM ranked WHERE rank = 1)
SELECT a.doc_id, a.idx AS row_idx, b.idx, round(round(sum(a.u * b.u), 9), 6) AS similarity
FROM best JOIN units a USING (doc_id, idx) JOIN units b ON b.doc_id = a.doc_id AND b.term = a.term GROUP BY ALL""",
    "compared_methods": compared(),
    "position_summary": f"WITH {SPLIT_DOCS} SELECT doc_id, {lead(0.3)} AS summary FROM split_docs",
    "tfidf_summary": summary(TFIDF, "DESC"),
    "embedding_summary": summary(hashed(), "ASC"),
    "second_embedder_summary": summary(hashed(96, "b:"), "DESC"),
    "short_documents": f"WITH {SPLIT_DOCS} SELECT doc_id, c AS cleaned, c AS summary FROM split_docs WHERE len(ss) <= 2",
    "two_summaries": f"""WITH {RESULTS}, {LEFT_OUT}, {SPLIT_DOCS}, {hashed()}, {CENTRALITY}, {ranks('ASC')}, {picked(0.3)}
SELECT news_id, 'ok' AS status, {lead(0.2)} AS summary_short, coalesce(p.summary, '') AS summary_default,
  'position' AS short_method, 'embedding' AS default_method
FROM misses JOIN split_docs s ON s.doc_id = news_id LEFT JOIN picked p ON p.doc_id = news_id""",
    "stored_summaries": f"""WITH {RESULTS}, {LEFT_OUT}, {SPLIT_DOCS},
made AS (SELECT news_id, {lead(0.2)} AS short, {lead(0.3)} AS default_ FROM misses JOIN split_docs ON doc_id = news_id)
SELECT news_id, coalesce(n_audio, 0)::BIGINT AS n_audio, coalesce(short, summary_short) AS summary_short, summary_medium,
  coalesce(default_, summary_default) AS summary_default, {shown(f'coalesce(created_at, {AS_OF})')} AS created_at,
  {shown(f'CASE WHEN m.news_id IS NULL THEN updated_at ELSE {AS_OF} END')} AS updated_at
FROM results FULL JOIN made m USING (news_id)""",
    "index_snapshot": ALL_INDEXED,
    "index_from_stream": ALL_INDEXED,
    "index_from_stream_by_catalog": ALL_INDEXED,
    "stream_tally": TALLY,
    "cache_hits_after_batch": HITS_SINCE,
    "cache_hits_after_stream": HITS_SINCE,
    "cache_lookup": f"""WITH {CACHE}
SELECT event_id, coalesce(category_filter, 'all') AS category_key, c.news_id IS NOT NULL AS hit,
  CASE WHEN c.news_id IS NOT NULL THEN 1 ELSE 0 END::BIGINT AS n_items
FROM log l LEFT JOIN cache c ON c.news_id = l.news_id AND c.k = l.k AND c.category_key = coalesce(l.category_filter, 'all') AND {AS_OF} < c.expires_at""",
    "checked_articles": """SELECT CASE WHEN doc_id % 7 <> 0 THEN doc_id::VARCHAR END AS id, CASE WHEN doc_id % 7 <> 0 THEN text END AS content,
  CASE WHEN doc_id % 7 = 0 THEN '{"id":' || doc_id || ',"title":"cut' END AS record FROM documents""",
    "cache_refresh": f"""WITH {LOG}, {INDEX},
asked AS (SELECT DISTINCT news_id, k, category_filter FROM log WHERE k BETWEEN 1 AND 50 AND news_id % 5 <> 0),
sources AS (SELECT DISTINCT news_id FROM asked),
scores AS (SELECT s.news_id, b.news_id AS match_id, b.category, list_cosine_similarity(a.v, b.v) AS score
  FROM sources s JOIN idx a USING (news_id) JOIN idx b ON b.news_id <> s.news_id),
found AS (SELECT m.news_id, m.k, coalesce(m.category_filter, 'all') AS category_key, match_id, score
  FROM asked m JOIN scores s ON s.news_id = m.news_id AND (m.category_filter IS NULL OR m.category_filter = s.category)),
listed AS (SELECT DISTINCT news_id, k, category_key FROM found WHERE match_id % 5 <> 0),
ranks AS (SELECT *, row_number() OVER (PARTITION BY news_id, k, category_key ORDER BY round(score, 9) DESC, match_id) AS rank
  FROM found WHERE score >= 0.1),
lists AS (SELECT news_id, k, category_key, string_agg(match_id::VARCHAR, ',' ORDER BY rank) AS items FROM ranks WHERE rank <= k GROUP BY ALL)
SELECT news_id, k::BIGINT AS k, category_key, coalesce(items, '') AS items FROM listed LEFT JOIN lists USING (news_id, k, category_key)""",
    "cache_write_back": f"""WITH {CACHE}, {INDEX},
misses AS (SELECT DISTINCT l.news_id, l.k, l.category_filter FROM log l
  LEFT JOIN cache c ON c.news_id = l.news_id AND c.k = l.k AND c.category_key = coalesce(l.category_filter, 'all') AND {AS_OF} < c.expires_at
  WHERE c.news_id IS NULL AND l.k BETWEEN 1 AND 50),
sources AS (SELECT DISTINCT news_id FROM misses),
scores AS (SELECT s.news_id, b.news_id AS match_id, b.category, list_cosine_similarity(a.v, b.v) AS score
  FROM sources s JOIN idx a USING (news_id) JOIN idx b ON b.news_id <> s.news_id),
found AS (SELECT m.news_id, m.k, coalesce(m.category_filter, 'all') AS category_key, match_id, score
  FROM misses m JOIN scores s ON s.news_id = m.news_id AND (m.category_filter IS NULL OR m.category_filter = s.category)),
answered AS (SELECT DISTINCT news_id, k, category_key FROM found),
ranks AS (SELECT *, row_number() OVER (PARTITION BY news_id, k, category_key ORDER BY round(score, 9) DESC, match_id) AS rank
  FROM found WHERE score >= 0.1),
lists AS (SELECT news_id, k, category_key, string_agg(match_id::VARCHAR, ',' ORDER BY rank) AS items FROM ranks WHERE rank <= k GROUP BY ALL),
fresh AS (SELECT a.*, coalesce(items, '') AS items, {AS_OF} + INTERVAL 3600 SECOND AS expires_at FROM answered a LEFT JOIN lists USING (news_id, k, category_key))
SELECT news_id, k::BIGINT AS k, category_key, items, {shown('expires_at')} AS expires_at FROM fresh
UNION ALL
SELECT news_id, k::BIGINT, category_key, (news_id + 1)::VARCHAR, {shown('expires_at')} FROM cache ANTI JOIN fresh USING (news_id, k, category_key)""",
    "cache_invalidation": f"WITH {CACHE} SELECT news_id, k::BIGINT AS k, category_key FROM cache WHERE category_key NOT IN ('0', '1', '2', 'all')",
    "cache_after_indexing": f"""WITH {CACHE}, {ARTICLES}
SELECT news_id, k::BIGINT AS k, category_key FROM cache WHERE category_key <> 'all' AND category_key NOT IN
  (SELECT substr(category, 4) FROM articles WHERE category IN ('src1', 'src2', 'src3') AND title <> '' AND id NOT IN (SELECT doc_id FROM labels))""",
    "links_to_refresh": f"""WITH signed AS (SELECT user_id * 3 AS news_id, max(ts) FILTER (ts <= {AS_OF}) AS signed_at FROM events GROUP BY 1)
SELECT doc_id AS news_id, 'Binh' AS voice_id, 'audio/Binh/' || doc_id AS s3_key FROM labels LEFT JOIN signed ON news_id = doc_id
WHERE toxic = 1 AND NOT coalesce(signed_at + INTERVAL 86340 SECOND > {AS_OF}, false)""",
    "computed_once_stream": f"""WITH RECURSIVE r AS (SELECT user_id::VARCHAR AS key, ts FROM events),
c AS (SELECT key, min(ts) AS t FROM r GROUP BY key
  UNION ALL SELECT c.key, min(r.ts) AS t FROM c JOIN r ON r.key = c.key AND r.ts >= c.t + INTERVAL 3600 SECOND GROUP BY c.key)
SELECT c.key, {shown('c.t')} AS computed_at, {shown('c.t + INTERVAL 3600 SECOND')} AS expires_at, count(*) AS n_requests
FROM c JOIN r ON r.key = c.key AND r.ts >= c.t AND r.ts < c.t + INTERVAL 3600 SECOND GROUP BY ALL""",
    "computed_once_hot": f"""WITH RECURSIVE r AS (SELECT (event_id % 3)::VARCHAR AS key, ts FROM events),
c AS (SELECT key, min(ts) AS t FROM r GROUP BY key
  UNION ALL SELECT c.key, min(r.ts) AS t FROM c JOIN r ON r.key = c.key AND r.ts >= c.t + INTERVAL 3600 SECOND GROUP BY c.key)
SELECT c.key, {shown('c.t')} AS computed_at, {shown('c.t + INTERVAL 3600 SECOND')} AS expires_at, count(*) AS n_requests
FROM c JOIN r ON r.key = c.key AND r.ts >= c.t AND r.ts < c.t + INTERVAL 3600 SECOND GROUP BY ALL""",
}
