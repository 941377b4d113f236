"""DuckDB SQL of the queries over the processing flow, against the raw tables."""

from __future__ import annotations

from quern.operators.topics import STOPWORDS
from quern.plans.flows import LOOP
from quern.plans.oracles import _sentences, _strip, _tokens, _word_set, _words


def _long(c: str) -> str:
    return f"(length({_strip(c)}) >= 50 AND len({_words(_strip(c))}) >= 8)"


_CORPUS = """corpus AS (SELECT 'i' || conv_id AS interview_id, turn::VARCHAR AS question_id, CASE WHEN (conv_id * 8 + turn) % 13 = 0 THEN '  ' ELSE text END AS original_text FROM conversations),
routed AS (SELECT *, interview_id || '::' || question_id AS response_id, coalesce(trim(original_text), '') = '' AS blank FROM corpus)"""
_LANG = "CASE length(%s) %% 4 WHEN 0 THEN 'ca' WHEN 1 THEN 'es' WHEN 2 THEN 'en' END"
_TOLD = f"""{_CORPUS}, found AS (SELECT *, {_long('original_text')} AS long, CASE WHEN {_long('original_text')} THEN {_LANG % 'original_text'} END AS lang FROM routed WHERE NOT blank),
vote AS (SELECT interview_id, count(*) FILTER (lang = 'ca') AS votes_ca, count(*) FILTER (lang = 'es') AS votes_es FROM found GROUP BY 1),
primaries AS (SELECT *, CASE WHEN votes_ca >= votes_es THEN 'ca' ELSE 'es' END AS interview_primary_language, votes_ca + votes_es = 0 AS fallback_used, votes_ca = votes_es AND votes_ca > 0 AS tie_broken FROM vote),
told AS (SELECT f.*, CASE WHEN lang IN ('ca', 'es') THEN lang ELSE interview_primary_language END AS source_language,
  CASE WHEN NOT long THEN 'interview_fallback_short' WHEN lang IN ('ca', 'es') THEN 'direct' WHEN lang = 'en' THEN 'interview_fallback_unexpected_english' ELSE 'interview_fallback_detection_failed' END AS method
  FROM found f JOIN primaries USING (interview_id))"""
_CUT = """cut AS (SELECT response_id, interview_id, question_id, source_language, i, t, response_id || '::s' || printf('%03d', i) AS sentence_id
  FROM (SELECT response_id, interview_id, question_id, source_language, unnest(range(len(ss))) AS i, unnest(ss) AS t FROM (SELECT *, SENTENCES AS ss FROM told)))""".replace("SENTENCES", _sentences("original_text"))
_RUN = f"""{_TOLD}, {_CUT},
made AS (SELECT *, length(t) AS n, source_language = 'es' AS own FROM cut),
sent AS (SELECT *, CASE WHEN own THEN 'SOURCE_ES' WHEN n % 10 = 0 THEN 'FAILED' WHEN n % 5 = 0 THEN 'RETRY_OK' WHEN n % 7 = 0 AND n % 14 <> 0 THEN 'REPETITION_REPAIRED' ELSE 'FRESH_OK' END AS prov,
  CASE WHEN own THEN t WHEN n % 10 = 0 THEN NULL WHEN n % 5 <> 0 AND n % 14 = 0 THEN '{LOOP}' ELSE '» ' || t END AS text_es FROM made),
stat AS (SELECT *, CASE WHEN NOT own AND text_es = '{LOOP}' THEN 'FLAGGED' ELSE prov END AS status FROM sent),
resp AS (SELECT response_id, any_value(own) AS own, count(*) AS n, string_agg(text_es, ' ' ORDER BY i) FILTER (prov <> 'FAILED' AND text_es <> '') AS text_es,
  count(*) FILTER (status = 'FAILED') AS failed, count(*) FILTER (status = 'FLAGGED') AS flagged, max(sentence_id) AS last_sentence FROM stat GROUP BY 1),
resps AS (SELECT r.*, interview_id, question_id, source_language, method, CASE WHEN r.own THEN 'IDENTITY_COPY' WHEN r.n = 0 OR r.failed = r.n THEN 'WARNING_TRANSLATION_FAILED' WHEN r.failed > 0 THEN 'PARTIAL_TRANSLATION_FAILURE' ELSE 'TRANSLATED' END AS text_es_status
  FROM resp r JOIN told USING (response_id))"""
_CONVERSATION_SENTENCES = f"(SELECT conv_id, turn, unnest({_sentences('text')}) AS t FROM conversations)"
_MEMORY = f"""{_RUN}, kept AS (
  SELECT DISTINCT '1' AS generation_version, t, CASE WHEN n % 7 = 0 THEN '{LOOP}' ELSE '» ' || t END AS translated FROM sent WHERE NOT own AND n % 5 <> 0
  UNION SELECT DISTINCT '1-retry', t, '» ' || t FROM sent WHERE prov IN ('RETRY_OK', 'REPETITION_REPAIRED'))"""
_RATED = """rated AS (SELECT conv_id::VARCHAR AS interview_id, turn::VARCHAR AS question_id, text, length(text) AS n, least(length(left(text, 512)) % 8, 5)::DOUBLE AS score,
  CASE WHEN length(left(text, 512)) % 11 > 0 THEN CASE WHEN length(left(text, 512)) % 3 = 0 AND length(left(text, 512)) % 10 / 10.0 > 0.6 THEN 'CONFUSED' ELSE 'NOT_CONFUSED' END END AS status FROM conversations)"""
_TERMS = f"""terms AS (SELECT lang AS topic, word, count(*)::DOUBLE AS score FROM (SELECT lang, unnest({_word_set('text')}) AS word FROM documents) WHERE length(word) >= 4 GROUP BY 1, 2)"""
_ROLE_WINDOWS = f"""tok AS (SELECT row_number() OVER () AS d, role, {_tokens('text')} AS ts FROM conversations),
freq AS (SELECT role AS topic, w AS word, count(*) AS c FROM (SELECT role, unnest(ts) AS w FROM tok) GROUP BY 1, 2),
best AS (SELECT topic, word FROM freq QUALIFY row_number() OVER (PARTITION BY topic ORDER BY c DESC, word) <= 6),
win AS (SELECT row_number() OVER () AS k, list_distinct(ts[i + 1:i + 10]) AS ws FROM (SELECT ts, unnest(range(0, greatest(len(ts) - 10, 0) + 1)) AS i FROM tok)),
total AS (SELECT count(*) AS n FROM win), seen AS (SELECT k, w FROM (SELECT k, unnest(ws) AS w FROM win) WHERE w IN (SELECT word FROM best)),
single AS (SELECT w, count(*) AS c FROM seen GROUP BY 1), met AS (SELECT a.w AS w1, b.w AS w2, count(*) AS c12 FROM seen a JOIN seen b USING (k) GROUP BY 1, 2),
grid AS (SELECT x.topic, x.word AS a, y.word AS b, coalesce(c12, 0) / n::DOUBLE + 1e-12 AS p12, s1.c / n::DOUBLE AS p1, s2.c / n::DOUBLE AS p2
  FROM best x JOIN best y USING (topic) JOIN single s1 ON s1.w = x.word JOIN single s2 ON s2.w = y.word LEFT JOIN met ON w1 = x.word AND w2 = y.word, total),
npmi AS (SELECT topic, a, b, ln(p12 / (p1 * p2)) / -ln(p12) AS v FROM grid)"""


ORACLES = {
    "q50_routing": f"WITH {_CORPUS} SELECT CASE WHEN blank THEN 'EXCLUDED' ELSE 'OK' END AS status, CASE WHEN blank THEN 'empty_text' END AS exclusion_reason, count(*) AS n FROM routed GROUP BY 1, 2",
    "q51_language_vote": f"WITH {_TOLD} SELECT interview_id, votes_ca, votes_es, interview_primary_language, fallback_used, tie_broken FROM primaries",
    "q52_language_methods": f"WITH {_TOLD} SELECT method || ':' || source_language AS kind, count(*) AS n FROM told GROUP BY 1",
    "q53_language_counts": f"WITH {_TOLD} SELECT l AS language, count(interview_id) AS interviews FROM (VALUES ('ca'), ('es')) v(l) LEFT JOIN primaries ON interview_primary_language = l GROUP BY 1",
    "q54_sentences": f"WITH {_RUN} SELECT sentence_id, source_language, prov AS translation_provenance, status AS sentence_status, sha256(coalesce(text_es, '')) AS sha256, prov = 'REPETITION_REPAIRED' AS repaired FROM stat",
    "q55_responses": f"""
WITH {_RUN} SELECT response_id, 'OK' AS status, source_language, text_es_status, n::INT AS sentence_count, sha256(coalesce(text_es, '')) AS sha256, failed::INT AS failed, flagged::INT AS flagged, last_sentence, failed = 0 AS response_translation_complete FROM resps
UNION ALL SELECT response_id, 'EXCLUDED', NULL, NULL, NULL, sha256(''), NULL, NULL, NULL, NULL FROM routed WHERE blank""",
    "q56_gates": f"""
WITH {_RUN}, a AS (SELECT count(*) AS responses, count(*) FILTER (blank) AS excluded FROM routed),
b AS (SELECT count(*) AS sentences, count(*) FILTER (status = 'FLAGGED') AS flagged_sentences, count(*) FILTER (status = 'FAILED') AS failed_sentences, count(*) FILTER (prov = 'REPETITION_REPAIRED') AS repaired_sentences FROM stat),
c AS (SELECT count(*) FILTER (text_es_status = 'PARTIAL_TRANSLATION_FAILURE') AS partial_translation_failure, count(*) FILTER (text_es_status = 'WARNING_TRANSLATION_FAILED') AS warning_translation_failed FROM resps)
SELECT *, count(*) OVER () = 1 AS structurally_valid, failed_sentences = 0 AS complete, flagged_sentences = 0 AS output_valid, failed_sentences = 0 AND flagged_sentences = 0 AS valid, CASE WHEN flagged_sentences > 0 THEN 'FAIL' ELSE 'REVIEW' END AS sanity_status FROM a, b, c""",
    "q57_warnings": f"""
WITH {_RUN} SELECT 'input' AS stage, 'EXCLUDED' AS status, 'empty_text' AS reason, count(*) AS n FROM routed WHERE blank HAVING count(*) > 0
UNION ALL SELECT 'translation', 'WARNING', 'translation_failed', count(*) FROM resps WHERE text_es_status = 'WARNING_TRANSLATION_FAILED' HAVING count(*) > 0
UNION ALL SELECT 'translation', 'WARNING', 'partial_failure', count(*) FROM resps WHERE text_es_status = 'PARTIAL_TRANSLATION_FAILURE' HAVING count(*) > 0
UNION ALL SELECT 'quality', 'FLAGGED', 'degenerate_output', count(*) FROM stat WHERE status = 'FLAGGED' HAVING count(*) > 0
UNION ALL SELECT 'translation', 'FAILED', 'translation_failed', count(*) FROM stat WHERE status = 'FAILED' HAVING count(*) > 0
UNION ALL SELECT 'translation', 'REPAIRED', 'repetition_retry', count(*) FROM stat WHERE prov = 'REPETITION_REPAIRED' HAVING count(*) > 0
UNION ALL SELECT 'language', 'REVIEW', 'language_fallback', count(*) FROM told WHERE method NOT IN ('direct', 'interview_fallback_short') HAVING count(*) > 0""",
    "q58_bridge": f"""
WITH {_RUN} SELECT interview_id, question_id, count(text_es) FILTER (text_es <> '')::INT AS n, sha256(coalesce(string_agg(text_es, '|' ORDER BY i) FILTER (text_es <> ''), '')) AS sha256 FROM stat GROUP BY 1, 2""",
    "q59_second_run": f"""
WITH {_RUN} SELECT CASE WHEN prov = 'FRESH_OK' THEN 'CACHE_HIT' ELSE prov END AS translation_provenance, CASE WHEN status = 'FRESH_OK' THEN 'CACHE_HIT' ELSE status END AS sentence_status, count(*) AS n FROM stat GROUP BY 1, 2""",
    "q60_memory_rows": f"WITH {_MEMORY} SELECT 'marking' AS model, generation_version, 'ca' AS source_language, 'es' AS target_language, sha256(t) AS source_hash, sha256(translated) AS sha256, 'builtin' AS engine FROM kept",
    "q61_memory_coverage": f"""
WITH {_MEMORY}, f AS (SELECT c.t, EXISTS (SELECT 1 FROM kept WHERE generation_version = '1' AND kept.t = c.t) AS hit FROM {_CONVERSATION_SENTENCES} c)
SELECT count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, 0::BIGINT AS writes, (SELECT count(*) FROM kept) AS entries FROM f""",
    "q62_first_missing": f"""
WITH {_MEMORY}, f AS (SELECT conv_id || ':' || turn AS id, EXISTS (SELECT 1 FROM kept WHERE generation_version = '1' AND kept.t = c.text) AS hit FROM conversations c)
SELECT count(*) AS total, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, (SELECT string_agg(id, ' ' ORDER BY id) FROM (SELECT DISTINCT id FROM f WHERE NOT hit ORDER BY id LIMIT 50)) AS first_missing FROM f""",
    "q63_frozen_languages": f"""
WITH {_TOLD} SELECT 'conflict:es' AS kind, count(*) AS n FROM told WHERE question_id = '1' AND source_language <> 'es' HAVING count(*) > 0
UNION ALL SELECT 'missing_from_frozen_segmentation', count(*) FROM told WHERE question_id = '3' HAVING count(*) > 0""",
    "q64_frozen_problems": f"""
WITH {_TOLD} SELECT 'input_sha256' AS kind, 1::BIGINT AS n UNION ALL SELECT 'extra_response', count(*) FROM told WHERE question_id = '0'
UNION ALL SELECT 'changed_text', count(*) FROM told WHERE question_id = '1' UNION ALL SELECT 'missing_response', count(*) FROM told WHERE question_id = '2'""",
    "q65_manifest": f"WITH {_TOLD}, {_CUT} SELECT 2 AS schema_version, 'a' AS input_sha256, count(DISTINCT response_id) AS response_count, count(*) AS total_sentence_count FROM cut",
    "q66_reconstruction": f"WITH {_TOLD} SELECT response_id FROM told WHERE question_id = '1' AND lower({_sentences('original_text')}[1]) <> 'x'",
    "q67_sentence_ids": f"""
WITH {_TOLD}, {_CUT}, x AS (SELECT sentence_id AS id FROM cut WHERE ends_with(sentence_id, 's001'))
SELECT 'left' AS side, count(*) AS n, (SELECT string_agg(id, ' ' ORDER BY id) FROM (SELECT id FROM x ORDER BY id LIMIT 20)) AS first FROM x
UNION ALL SELECT 'right', count(*), (SELECT string_agg(id || 'x', ' ' ORDER BY id) FROM (SELECT id FROM x ORDER BY id LIMIT 20)) FROM x""",
    "q68_orphans": f"WITH {_RUN} SELECT count(*) AS n, min(sentence_id) AS first FROM stat WHERE response_id NOT IN (SELECT response_id FROM resps WHERE text_es_status = 'TRANSLATED')",
    "q69_key_sets": """
SELECT 'self' AS name, count(*) >= 0 AS equal FROM documents
UNION ALL SELECT 'labels', (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) + (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) = 0""",
    "q70_batches": """
SELECT conv_id, turn, (row_number() OVER w - 1) // 3 AS batch, row_number() OVER w AS finished, count(*) OVER (PARTITION BY conv_id) AS total FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
    "q71_group_questions": f"WITH {_CORPUS} SELECT question_id, sha256(string_agg(original_text, ' ' ORDER BY interview_id, original_text)) AS sha256, length(string_agg(original_text, ' ' ORDER BY interview_id))::INT AS chars FROM corpus GROUP BY 1",
    "q72_nested": f"WITH {_CORPUS} SELECT interview_id, question_id, sha256(original_text) AS sha256 FROM corpus WHERE question_id IN ('0', '2')",
    "q73_corpus_file": f"WITH {_CORPUS} SELECT interview_id, count(*) AS n, sum(length(original_text))::BIGINT AS chars FROM corpus GROUP BY 1",
    "q74_topic_documents": f"""
WITH {_RUN}, k AS (SELECT array_to_string(list_filter({_words("regexp_replace(text_es, '[^\\p{L}\\p{N}_\\s.,!?¡¿''’·-]', ' ', 'g')")}, lambda w: NOT regexp_full_match(w, '\\d+')), ' ') AS t FROM resps WHERE text_es IS NOT NULL),
m AS (SELECT array_to_string(list_filter({_words('t')}, lambda w: NOT regexp_full_match(w, '[.,!?¡¿\\-]+') AND NOT regexp_full_match(w, '\\d+')), ' ') AS t FROM k)
SELECT count(*) AS documents, sum(length(t))::BIGINT AS chars FROM m WHERE trim(t) <> ''""",
    "q75_stages": f"""
WITH {_RUN} SELECT 'input' AS stage, count(DISTINCT interview_id) AS interviews, count(*) AS responses, count(DISTINCT response_id) AS keys, count(*) FILTER (blank) AS empty FROM routed
UNION ALL SELECT 'responses', (SELECT count(DISTINCT interview_id) FROM routed), (SELECT count(*) FROM routed), (SELECT count(*) FROM routed), (SELECT count(*) FROM routed) - (SELECT count(*) FROM resps WHERE trim(coalesce(text_es, '')) <> '')
UNION ALL SELECT 'bridge', count(DISTINCT interview_id), count(*), count(*), 0 FROM resps""",
    "q100_model_batches": """
WITH c AS (SELECT *, conv_id // 64 AS lane, CASE WHEN length(text) % 3 = 0 THEN 'ca' ELSE 'en' END AS lang FROM conversations WHERE trim(text) <> ''),
p AS (SELECT *, (row_number() OVER (PARTITION BY lane, lang ORDER BY length(text), conv_id * 1000 + turn) - 1) // 3 AS b FROM c),
bad AS (SELECT lane, lang, b, bool_or(length(text) % 4 = 0) AS bad FROM p GROUP BY 1, 2, 3),
n AS (SELECT *, row_number() OVER w - 1 AS number, bad AND coalesce(lag(bad) OVER w, false) AND coalesce(lag(bad, 2) OVER w, false) AS third FROM bad WINDOW w AS (PARTITION BY lane ORDER BY lang, b)),
stop AS (SELECT lane, min(number) AS last FROM n WHERE third GROUP BY 1),
told AS (SELECT p.*, n.number, n.bad, coalesce(n.number > stop.last, false) AS late FROM p JOIN n USING (lane, lang, b) LEFT JOIN stop USING (lane))
SELECT conv_id, turn, CASE WHEN late THEN 'ABORTED' WHEN bad THEN 'FAILED' ELSE 'TRANSLATED' END AS model_status, CASE WHEN NOT late THEN number END::INT AS batch,
CASE WHEN late THEN 0 WHEN bad THEN 2 ELSE 1 END::INT AS attempts, CASE WHEN NOT late AND NOT bad THEN sha256('» ' || text) END AS sha256 FROM told""",
    "q76_run_assertions": """
WITH c AS (SELECT run, conv_id, conv_id || ':' || turn AS key, length(text) AS n, length(text) % 7 > 0 AS full_text, conv_id % 5 = 0 AND turn = 0 AS odd FROM conversations, range(0, 11) r(run)),
raw AS (SELECT run, key FROM c UNION ALL SELECT run, key FROM c WHERE run = 5 AND odd),
kept AS (SELECT * FROM c WHERE CASE WHEN run = 7 AND odd THEN NOT full_text ELSE full_text END),
docs AS (SELECT run, key, conv_id FROM kept UNION ALL SELECT run, key, conv_id FROM kept WHERE run = 4 AND odd UNION ALL SELECT run, conv_id || ':99', conv_id FROM c WHERE run = 6 AND odd),
per AS (SELECT run, count(*) AS n, count(DISTINCT key) AS keys, count(*) + (run = 3)::INT AS total, count(*) FILTER (run <> 2 OR conv_id % 4 > 0) AS assigned FROM docs GROUP BY run),
asked AS (SELECT * FROM c WHERE NOT (run = 8 AND odd)),
results AS (SELECT *, CASE WHEN run = 1 AND odd THEN 'UNKNOWN' WHEN n % 3 = 0 THEN 'CONFUSED' WHEN n % 3 = 1 THEN 'NOT_CONFUSED' END AS status FROM asked WHERE NOT (run = 9 AND odd)),
lost AS (SELECT run, key FROM c WHERE (run, key) NOT IN (SELECT (run, key) FROM docs)), blank AS (SELECT run, key FROM c WHERE NOT full_text),
faults AS (
SELECT run, 'sentiment_parts_make_the_whole' AS name FROM results GROUP BY run HAVING count(*) <> count(*) FILTER (status IN ('CONFUSED', 'NOT_CONFUSED') OR status IS NULL)
UNION ALL SELECT run, 'assigned_and_outliers_make_the_documents' FROM per WHERE assigned <> n
UNION ALL SELECT run, 'topic_input_counts_as_its_stats_say' FROM per WHERE total <> n
UNION ALL SELECT run, 'no_duplicate_keys_in_topic_input' FROM per WHERE keys <> n
UNION ALL SELECT run, 'no_repeated_questions_in_raw_transcripts' FROM raw GROUP BY run HAVING count(*) <> count(DISTINCT key)
UNION ALL SELECT run, 'full_responses_match_topic_input' FROM per JOIN (SELECT run, count(*) AS full_n FROM c WHERE full_text GROUP BY run) USING (run) WHERE keys <> full_n
UNION ALL SELECT run, 'topic_input_drops_exactly_the_empty_responses' FROM ((SELECT * FROM lost EXCEPT SELECT * FROM blank) UNION (SELECT * FROM blank EXCEPT SELECT * FROM lost))
UNION ALL SELECT run, 'no_responses_lost_before_sentiment' FROM (SELECT run, key FROM c EXCEPT SELECT run, key FROM asked)
UNION ALL SELECT run, 'no_responses_lost_by_sentiment' FROM (SELECT run, key FROM asked EXCEPT SELECT run, key FROM results)
UNION ALL SELECT run, 'copies_of_files_are_identical' FROM c WHERE n % 2 = 0 AND run = 10 AND odd),
names(name) AS (VALUES ('sentiment_parts_make_the_whole'), ('assigned_and_outliers_make_the_documents'), ('topic_input_counts_as_its_stats_say'), ('no_duplicate_keys_in_topic_input'), ('no_repeated_questions_in_raw_transcripts'),
('full_responses_match_topic_input'), ('topic_input_drops_exactly_the_empty_responses'), ('no_responses_lost_before_sentiment'), ('no_responses_lost_by_sentiment'), ('copies_of_files_are_identical'))
SELECT run::INT AS run, name, (run, name) NOT IN (SELECT (run, name) FROM faults) AS passed FROM (SELECT DISTINCT run FROM c), names""",
    "q77_sentiment": f"""
WITH {_RATED} SELECT CASE score WHEN 1 THEN 'VERY_NEGATIVE' WHEN 2 THEN 'NEGATIVE' WHEN 4 THEN 'POSITIVE' WHEN 5 THEN 'VERY_POSITIVE' ELSE 'NEUTRAL' END AS sentiment, score, status, count(*) AS n FROM rated GROUP BY 1, 2, 3""",
    "q78_sentiment_by_question": f"WITH {_RATED} SELECT question_id, round(avg(score), 6) AS score, round(100.0 * count(*) FILTER (status = 'CONFUSED') / count(*), 6)::DOUBLE AS confusion_percentage FROM rated GROUP BY 1",
    "q79_confusion": f"""
WITH {_RATED}, c AS (SELECT count(*) AS n_sentences, count(*) FILTER (status = 'CONFUSED') AS confused, count(*) FILTER (status = 'NOT_CONFUSED') AS not_confused, count(*) FILTER (status IS NULL) AS no_confusion_field FROM rated)
SELECT *, confused + not_confused + no_confusion_field = n_sentences AS partition_holds, round_even(100.0 * confused / n_sentences, 1)::DOUBLE AS confused_pct FROM c""",
    "q80_flat_results": f"WITH {_RATED} SELECT interview_id, question_id, 0 AS sentence_index, score FROM rated",
    "q81_clarity_totals": f"WITH {_RATED} SELECT count(*) FILTER (status = 'CONFUSED') AS confused, count(*) FILTER (status IS DISTINCT FROM 'CONFUSED') AS clear FROM rated",
    "q82_word_weights": f"""
WITH {_TERMS} SELECT topic, r::INT AS rank, word, score FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, word) AS r FROM (SELECT topic, lower(split_part(word, ' ', 1)) AS word, max(score) AS score FROM terms GROUP BY 1, 2)) WHERE r <= 5""",
    "q83_top_words": f"""
WITH {_TERMS}, b AS (SELECT topic, word, row_number() OVER (PARTITION BY topic ORDER BY score DESC, word) AS r FROM terms QUALIFY r <= 12)
SELECT topic, string_agg(replace(lower(trim(word)), ' ', '_'), ' ' ORDER BY r) AS words FROM b WHERE r <= 10 AND trim(word) <> '' GROUP BY 1""",
    "q84_topic_sizes": """
WITH t AS (SELECT ascii(lang), count(*) AS c FROM documents WHERE lang <> 'fr' GROUP BY 1), d AS (SELECT count(*) AS n, count(*) FILTER (lang = 'fr') AS o FROM documents)
SELECT count(*) AS n_topics, sum(c)::BIGINT AS assigned, sum(c)::BIGINT AS from_sizes, any_value(n) AS documents, 0::BIGINT AS outliers_implied, sum(c) = any_value(n) AS adds_up, round_even(100.0 * any_value(o) / any_value(n), 1)::DOUBLE AS outlier_percentage, median(c)::DOUBLE AS median_size FROM t, d""",
    "q85_window_coherence": f"WITH {_ROLE_WINDOWS} SELECT topic, round(avg(v), 6) AS c_npmi FROM npmi WHERE a < b GROUP BY 1",
    "q86_coherence_v": f"""
WITH {_ROLE_WINDOWS}, t AS (SELECT topic, b, sum(v) AS t FROM npmi GROUP BY 1, 2),
c AS (SELECT topic, a, sum(v * t) / sqrt(sum(v * v) * sum(t * t)) AS near FROM npmi JOIN t USING (topic, b) GROUP BY 1, 2) SELECT topic, round(avg(near), 6) AS c_v FROM c GROUP BY 1""",
    "q87_missing_transcripts": "SELECT DISTINCT doc_id AS interview_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "q88_spread": "SELECT round(avg(embedding[1]::DOUBLE), 6) AS mean, round(stddev_samp(embedding[1]::DOUBLE), 6) AS sd FROM embeddings",
    "q89_text_functions": f"""
WITH x AS (SELECT *, regexp_replace(text, '[^\\p{{L}}\\p{{N}}_\\s.,!?¡¿''’·-]', ' ', 'g') AS c FROM conversations)
SELECT conv_id, turn, sha256(array_to_string(list_filter({_words('c')}, lambda w: NOT regexp_full_match(w, '\\d+')), ' ')) AS kept_marks,
  sha256(array_to_string(list_filter({_words('text')}, lambda w: NOT regexp_full_match(w, '[.,!?¡¿\\-]+') AND NOT regexp_full_match(w, '\\d+')), ' ')) AS no_lone_marks,
  replace(lower({_strip('left(text, 30)')}), ' ', '_') AS term, left(text, 12) AS prefix, ceil(length(text) / 100.0)::INT AS pieces, substr(text, ((length(text) - 1) // 100) * 100 + 1) AS last_piece,
  len(regexp_extract_all(text, '\\p{{L}}+|[0-9]+'))::INT AS lexical, conv_id::INT AS stars, turn::INT AS topic, CASE WHEN len({_words('text')}) > 1 THEN {_words('text')}[1] || '_' || {_words('text')}[2] END AS bigram,
  printf('%02d:%02d:%02d', (length(text) * 7) // 3600, (length(text) * 7) % 3600 // 60, (length(text) * 7) % 60) AS clock,
  CASE least(turn, 5) WHEN 1 THEN 'VERY_NEGATIVE' WHEN 2 THEN 'NEGATIVE' WHEN 4 THEN 'POSITIVE' WHEN 5 THEN 'VERY_POSITIVE' ELSE 'NEUTRAL' END AS label FROM x""",
    "q90_language_checks": f"""
SELECT CASE WHEN {_long('text')} THEN 'ASSESSED' ELSE 'NOT_ASSESSED_SHORT_TEXT' END AS status, CASE WHEN {_long('text')} THEN coalesce({_LANG % 'text'} = 'es', false) END AS passed, CASE WHEN {_long('text')} THEN {_LANG % 'text'} END AS detected_language, count(*) AS n FROM conversations GROUP BY 1, 2, 3""",
    "q91_whole_responses": f"WITH {_TOLD} SELECT count(*) AS responses, count(*) FILTER (len(list_filter({_sentences('original_text')}, lambda x: len({_words('x')}) > 150)) > 0) AS hard_split, count(*) AS consistent FROM told WHERE source_language = 'ca'",
    "q92_cosine": "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "q93_evenly_spaced_all": "WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS p, count(*) OVER () AS n FROM documents) SELECT doc_id FROM p WHERE p IN (SELECT (i * p.n) // 50 FROM range(0, 50) t(i))",
    "q94_topic_order": """
WITH t AS (SELECT DISTINCT CASE WHEN conv_id % 5 > 0 THEN 'Topic ' ELSE 'Other ' END || conv_id AS topic, conv_id, conv_id % 5 > 0 AS named FROM conversations)
SELECT topic, row_number() OVER (ORDER BY CASE WHEN named THEN conv_id ELSE 1000000000 END, topic)::INT AS place FROM t""",
    "q95_word_list": f"""
WITH t AS (SELECT lang, unnest({_tokens('text')}) AS word FROM documents) SELECT lang, count(*) AS n, count(DISTINCT word) AS words FROM t WHERE word NOT IN (SELECT unnest({_tokens('text')}) FROM benchmark) GROUP BY 1""",
    "q97_tfidf": f"""
WITH d AS (SELECT doc_id, {_tokens("regexp_replace(array_to_string(list_filter(" + _words('text') + ", lambda w: NOT regexp_full_match(w, '[0-9]+')), ' '), '[^\\p{L}\\p{N}_\\s]', '', 'g')")} AS ts FROM documents WHERE trim(text) <> ''),
k AS (SELECT doc_id, list_filter(ts, lambda t: t NOT IN ({", ".join(f"'{w}'" for w in sorted(set(STOPWORDS)))})) AS ts FROM d),
t AS (SELECT doc_id, unnest(list_concat(ts, list_transform(range(1, len(ts)), lambda i: ts[i] || ' ' || ts[i + 1]))) AS term FROM k WHERE len(ts) > 0),
n AS (SELECT count(*) AS n FROM k WHERE len(ts) > 0), tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
w AS (SELECT doc_id, term, tf * (ln((1.0 + n)::DOUBLE / (1.0 + df)::DOUBLE) + 1.0) AS w FROM tf JOIN df USING (term), n WHERE df >= 2 AND df <= 0.85 * n)
SELECT doc_id, count(*) AS terms, round(max(w) / sqrt(sum(w * w)), 5) AS w, 1.0::DOUBLE AS length FROM w GROUP BY 1""",
    "q96_review_ids": f"WITH {_RUN} SELECT sentence_id AS id FROM stat WHERE NOT own AND text_es IS NOT NULL AND {_long('text_es')} AND coalesce({_LANG % 'text_es'} <> 'es', true)",
}
