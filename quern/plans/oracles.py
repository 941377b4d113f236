"""DuckDB SQL with the same rows as the registered queries, written against the raw tables."""

from __future__ import annotations

from quern.plans.queries import _FRAGMENTS, _TRANSCRIPT

_BLANKS = "' ' || chr(9) || chr(10) || chr(13)"


def _strip(c: str) -> str:
    return f"trim({c}, {_BLANKS})"


def _words(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, '\\s+'), lambda w: w <> '')"


def _bare(c: str) -> str:
    return f"regexp_replace(lower({c}), '^[.,!?]+|[.,!?]+$', '', 'g')"


def _word_set(c: str) -> str:
    return f"list_distinct(list_transform({_words(c)}, lambda w: {_bare('w')}))"


def _sentences(c: str) -> str:
    cut = f"""regexp_replace(regexp_replace({c}, '([.!?…]["''’”)]?)\\s', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g')"""
    return f"list_filter(list_transform(string_split({cut}, chr(1)), lambda x: {_strip('x')}), lambda x: x <> '')"


def _phrase(c: str) -> str:
    return f"trim(lower(regexp_replace({_strip(f'''regexp_replace({c}, '^-+', '')''')}, '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g')))"


def _tokens(c: str) -> str:
    return f"list_filter(regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[\\p{{L}}_]{{2,}}'))"


_LONG = f"(length({_strip('text')}) >= 50 AND len({_words(_strip('text'))}) >= 8)"
_TOPIC_WORDS = f"""topic_words AS (
  SELECT topic, list(word ORDER BY r) AS words FROM (
    SELECT lang AS topic, word, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, word) AS r
    FROM (SELECT lang, unnest({_word_set('text')}) AS word FROM documents) WHERE length(word) >= 4 GROUP BY lang, word) WHERE r <= 10 GROUP BY topic)"""
_SCORED = """scored AS (SELECT conv_id || ':' || turn AS key, text, 1 + (length(text) % 9) / 2.0 AS score,
  CASE WHEN length(text) % 7 > 0 THEN length(text) % 7 < 3 END AS confused FROM conversations)"""


def _matched(least: int) -> str:
    return f"""held AS (SELECT key, unnest({_word_set('text')}) AS word FROM scored),
wanted AS (SELECT DISTINCT topic, {_bare('word')} AS word FROM (SELECT topic, unnest(words) AS word FROM topic_words)),
matched AS (SELECT topic, key FROM held JOIN wanted USING (word) GROUP BY topic, key HAVING count(DISTINCT word) >= {least})"""


def _values(rows) -> str:
    quote = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows)


ORACLES = {
    "q01_responses": "SELECT source AS interview_id, count(*) AS responses, count(*) FILTER (coalesce(trim(text), '') = '') AS empty, count(DISTINCT text) AS distinct_texts FROM documents GROUP BY 1",
    "q02_long_enough": f"SELECT lang, {_LONG} AS long_enough, count(*) AS n FROM documents GROUP BY 1, 2",
    "q03_length_ratios": f"""
SELECT conv_id, turn, len({_words('text')})::INT AS source_tokens, len({_words('answer')})::INT AS target_tokens,
  round(length(answer) / nullif(length(text), 0)::DOUBLE, 6) AS char_ratio, round(len({_words('answer')}) / nullif(len({_words('text')}), 0)::DOUBLE, 6) AS token_ratio,
  coalesce(length(answer) / nullif(length(text), 0)::DOUBLE < 0.4 OR length(answer) / nullif(length(text), 0)::DOUBLE > 3.0, false) AS length_ratio_outlier
FROM (SELECT a.conv_id, a.turn, a.text, b.text AS answer FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)""",
    "q04_distribution": """
SELECT source, count(n_chars) AS n, round(avg(n_chars), 6) AS mean, round(median(n_chars), 6) AS median, round(coalesce(stddev_samp(n_chars), 0), 6) AS stdev,
  round(quantile_cont(n_chars::DOUBLE, 0.05), 6) AS p05, round(quantile_cont(n_chars::DOUBLE, 0.25), 6) AS p25, round(min(n_chars)::DOUBLE, 6) AS min, count(*) FILTER (n_chars < 200) AS n_below
FROM documents GROUP BY 1""",
    "q05_duplicate_texts": "SELECT sha256(text) AS sha256, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1",
    "q06_key_difference": """
SELECT 'left' AS side, count(*) AS n FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL))
UNION ALL SELECT 'right', count(*) FROM (SELECT DISTINCT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id IS NOT NULL))""",
    "q07_memory_coverage": """
WITH known AS (SELECT DISTINCT lang, text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)),
f AS (SELECT d.doc_id, k.text IS NOT NULL AS hit FROM documents d LEFT JOIN known k ON d.lang = k.lang AND d.text = k.text)
SELECT count(*) AS total, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, round(count(*) FILTER (hit) / count(*)::DOUBLE, 9) AS coverage FROM f""",
    "q08_language_vote": f"""
WITH v AS (SELECT source AS interview_id, lang, count(*) AS votes FROM documents WHERE {_LONG} GROUP BY 1, 2)
SELECT interview_id, first(lang ORDER BY votes DESC, lang) AS primary_language, sum(votes)::BIGINT AS considered FROM v GROUP BY 1""",
    "q09_repetition": f"""
WITH t AS (SELECT doc_id, {_words('text')} AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS ngram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t WHERE len(w) >= 18)),
c AS (SELECT doc_id, ngram, count(*) AS n, min(i) AS f FROM g GROUP BY doc_id, ngram)
SELECT doc_id, ngram, n::INT AS n FROM c WHERE n >= 6 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) = 1""",
    "q10_sentences": f"""
WITH s AS (SELECT source || '::' || doc_id AS rid, {_sentences('text')} AS ss FROM documents), e AS (SELECT rid, ss, unnest(range(0, len(ss))) AS i FROM s)
SELECT rid || '::s' || printf('%03d', i) AS sentence_id, i::INT AS sentence_index, sha256(ss[i + 1]) AS sha256, len({_words('ss[i + 1]')})::INT AS words FROM e""",
    "q11_continuations": f"""
WITH f(response_id, i, t) AS (VALUES {_values(_FRAGMENTS)}),
j AS (SELECT *, coalesce(regexp_matches(lag(t) OVER w, '(\\.\\.\\.|…)\\s*$') AND regexp_matches(regexp_replace(regexp_replace(t, '^[-–—]\\s*', ''), '^(\\.\\.\\.|…)\\s*', ''), '^[^\\p{{L}}\\d"''‘’“”(¿¡]*\\p{{Ll}}'), false) AS joins FROM f WINDOW w AS (PARTITION BY response_id ORDER BY i)),
k AS (SELECT *, sum((NOT joins)::INT) OVER (PARTITION BY response_id ORDER BY i) AS island FROM j),
p AS (SELECT *, row_number() OVER w AS place, count(*) OVER (PARTITION BY response_id, island) AS n FROM k WINDOW w AS (PARTITION BY response_id, island ORDER BY i)),
c AS (SELECT *, CASE WHEN place < n THEN rtrim(regexp_replace(t, '(\\.\\.\\.|…)\\s*$', '')) ELSE t END AS h FROM p)
SELECT response_id, (island - 1)::INT AS sentence_index, string_agg(CASE WHEN place > 1 THEN ltrim(regexp_replace(regexp_replace(h, '^[-–—]\\s*', ''), '^(\\.\\.\\.|…)\\s*', '')) ELSE h END, ' ' ORDER BY i) AS text_source, count(*)::INT AS fragments
FROM c GROUP BY response_id, island""",
    "q12_ordered_text": "SELECT conv_id, sha256(t) AS sha256, length(t)::INT AS chars FROM (SELECT conv_id, string_agg(text, ' ' ORDER BY turn, role, text) AS t FROM conversations GROUP BY 1)",
    "q13_recurring_phrases": f"""
WITH s AS (SELECT lang AS question_id, source AS interview_id, unnest({_sentences('text')}) AS t FROM documents),
p AS (SELECT question_id, interview_id, {_phrase('t')} AS phrase FROM s),
x AS (SELECT question_id, phrase, count(DISTINCT interview_id) AS n FROM p WHERE phrase <> '' AND len({_words('phrase')}) <= 4 GROUP BY 1, 2),
b AS (SELECT question_id, phrase, n FROM x QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY n DESC, phrase) = 1),
a AS (SELECT question_id, count(DISTINCT interview_id) AS m FROM p GROUP BY 1)
SELECT question_id, phrase, n AS n_with_phrase, m AS n_interviews, round_even(n / m::DOUBLE, 2) AS coverage FROM b JOIN a USING (question_id) WHERE n / m::DOUBLE >= 0.25 ORDER BY n / m::DOUBLE DESC, question_id LIMIT 30""",
    "q14_topic_scores": f"""
WITH {_TOPIC_WORDS}, {_SCORED}, {_matched(1)}, c AS (SELECT topic, round_even(score, 0)::INT AS score, count(*) AS n FROM matched JOIN scored USING (key) GROUP BY 1, 2)
SELECT topic, score, n, round(n * 100.0 / sum(n) OVER (PARTITION BY topic), 6)::DOUBLE AS percent FROM c""",
    "q15_topic_averages": f"""
WITH {_TOPIC_WORDS}, {_SCORED}, {_matched(2)}, j AS (SELECT topic, key, score, row_number() OVER (PARTITION BY topic ORDER BY key) AS r FROM matched JOIN scored USING (key)),
a AS (SELECT topic, avg(score) AS a, count(*) AS n, string_agg(key, ' ' ORDER BY key) FILTER (r <= 5) AS m FROM j GROUP BY 1)
SELECT topic, round_even(coalesce(a, 3.0), 2)::DOUBLE AS average_score, CASE WHEN coalesce(a, 3.0) > 3.5 THEN 'POSITIVE' WHEN coalesce(a, 3.0) < 2.5 THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS sentiment, coalesce(n, 0) AS sample_size, coalesce(m, '') AS matched
FROM topic_words LEFT JOIN a USING (topic)""",
    "q16_clarity_crosstab": f"""
WITH {_SCORED}, c AS (SELECT round_even(score, 0)::INT AS rating, count(*) FILTER (NOT coalesce(confused, false)) AS a, count(*) FILTER (coalesce(confused, false)) AS b FROM scored GROUP BY 1)
SELECT s.r::INT AS rating, round(coalesce(a / nullif(a + b, 0)::DOUBLE, 0), 9) AS clear, round(coalesce(b / nullif(a + b, 0)::DOUBLE, 0), 9) AS confused FROM range(1, 6) s(r) LEFT JOIN c ON c.rating = s.r""",
    "q17_topic_summary": f"""
WITH {_TOPIC_WORDS}, {_SCORED}, {_matched(1)}
SELECT topic, round(avg(score), 6)::DOUBLE AS mean_score, round(100.0 * count(*) FILTER (score >= 4) / count(*), 6)::DOUBLE AS percent_positive, round(100.0 * count(*) FILTER (confused) / count(*), 6)::DOUBLE AS percent_confused, count(*) AS n FROM matched JOIN scored USING (key) GROUP BY 1""",
    "q18_topic_similarity": f"""
WITH {_TOPIC_WORDS} SELECT a.topic AS left, b.topic AS right, round(len(list_intersect(a.words, b.words)) / len(list_distinct(a.words || b.words))::DOUBLE, 9) AS jaccard FROM topic_words a, topic_words b""",
    "q19_evenly_spaced": """
WITH p AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS p, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT source, doc_id FROM p WHERE n <= 7 OR p IN (SELECT (i * p.n) // 7 FROM range(0, 7) t(i))""",
    "q20_last_wins": "SELECT user_id, event_type, max(event_id) AS event_id, round(arg_max(value, event_id), 6) AS value FROM events GROUP BY 1, 2",
    "q21_failure_streaks": """
WITH m AS (SELECT user_id, event_type = 'error' AS bad, sum((event_type <> 'error')::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM events),
r AS (SELECT user_id, run, count(*) FILTER (bad) AS n FROM m GROUP BY 1, 2)
SELECT user_id, max(n) AS longest_streak, max(n) >= 3 AS aborts FROM r GROUP BY 1""",
    "q22_status_rollup": """
WITH s AS (SELECT source, lang <> 'es' AS required, coalesce(n_chars, 0) AS total, CASE WHEN toxic = 1 THEN n_chars ELSE coalesce(quality, 0) END AS failed, CASE WHEN quality IS NULL THEN n_chars ELSE 0 END AS hits FROM documents LEFT JOIN labels USING (doc_id))
SELECT source, CASE WHEN NOT required THEN 'IDENTITY_COPY' WHEN total = 0 OR failed = total THEN 'WARNING_TRANSLATION_FAILED' WHEN failed > 0 THEN 'PARTIAL_TRANSLATION_FAILURE' WHEN hits = total THEN 'CACHE_HIT' ELSE 'TRANSLATED' END AS text_es_status, count(*) AS n FROM s GROUP BY 1, 2""",
    "q23_tfidf_terms": f"""
WITH t AS (SELECT source, doc_id, unnest({_tokens('text')}) AS term FROM documents), n AS (SELECT count(*) AS n FROM documents),
tf AS (SELECT source, doc_id, term, count(*) AS tf FROM t GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
w AS (SELECT source AS topic, term AS word, round(sum(tf * (ln((1.0 + n)::DOUBLE / (1.0 + df)::DOUBLE) + 1.0)), 4) AS score FROM tf JOIN df USING (term), n WHERE df >= 2 AND df <= 0.85 * n GROUP BY 1, 2)
SELECT topic, r::INT AS rank, word, score FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, word) AS r FROM w) WHERE r <= 10""",
    "q101_trained_languages": """
WITH t AS (SELECT row_number() OVER () AS rn, doc_id, lang, trim(regexp_replace(lower(left(text, 500)), '[^\\p{L}]+', ' ', 'g')) AS p FROM documents),
u AS (SELECT *, ' ' || p || ' ' AS w FROM t WHERE p <> ''),
g AS (SELECT * FROM (SELECT rn, doc_id, lang, unnest(list_concat(list_transform(range(1, length(w) + 1), lambda i: w[i:i]), list_transform(range(1, length(w)), lambda i: w[i:i+1]), list_transform(range(1, length(w) - 1), lambda i: w[i:i+2]))) AS gram FROM u) WHERE gram <> ' '),
c AS (SELECT lang, gram, count(*) AS n FROM g WHERE lang IS NOT NULL AND doc_id % 3 <> 1 GROUP BY 1, 2),
v AS (SELECT DISTINCT gram FROM (SELECT gram, row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) AS r FROM c) WHERE r <= 400),
cells AS (SELECT l.lang, v.gram, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT lang FROM c) l CROSS JOIN v LEFT JOIN c USING (lang, gram)),
weights AS (SELECT lang, gram, ln((n + 1.0) / ((sum(n) OVER (PARTITION BY lang))::DOUBLE + (SELECT count(*) FROM v))) AS w FROM cells),
sums AS (SELECT rn, w.lang, sum(w.w) AS s FROM g JOIN weights w USING (gram) GROUP BY 1, 2),
best AS (SELECT rn, arg_max(lang, s) AS detected_lang, max(s) AS top FROM sums GROUP BY 1),
odds AS (SELECT rn, sum(exp(s - top)) AS o FROM sums JOIN best USING (rn) GROUP BY 1)
SELECT doc_id, detected_lang, coalesce(round(1.0 / o, 4), 0) AS confidence FROM t LEFT JOIN best USING (rn) LEFT JOIN odds USING (rn)""",
    "q24_nearest": """
SELECT vec_id, r::INT AS rank, round(c, 4) AS cosine FROM (
  SELECT a.vec_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS c, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) AS r
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0) WHERE r <= 5""",
    "q25_coherence": f"""
WITH {_TOPIC_WORDS}, d AS (SELECT row_number() OVER () AS i, {_word_set('text')} AS ws FROM documents), n AS (SELECT count(*) AS n FROM documents),
seen AS (SELECT i, word FROM (SELECT i, unnest(ws) AS word FROM d) WHERE word IN (SELECT unnest(words) FROM topic_words)),
c AS (SELECT word, count(*) AS c FROM seen GROUP BY 1), m AS (SELECT a.word AS w1, b.word AS w2, count(*) AS c12 FROM seen a JOIN seen b ON a.i = b.i AND a.word < b.word GROUP BY 1, 2),
p AS (SELECT DISTINCT x.topic, x.w AS w1, y.w AS w2 FROM (SELECT topic, unnest(words) AS w FROM topic_words) x JOIN (SELECT topic, unnest(words) AS w FROM topic_words) y ON x.topic = y.topic AND x.w < y.w),
v AS (SELECT p.topic, coalesce(c12, 0) / n::DOUBLE + 1e-12 AS p12, c1.c / n::DOUBLE AS p1, c2.c / n::DOUBLE AS p2 FROM p JOIN c c1 ON c1.word = w1 JOIN c c2 ON c2.word = w2 LEFT JOIN m USING (w1, w2), n)
SELECT topic, round(avg(ln(p12 / (p1 * p2)) / -ln(p12)), 6) AS c_npmi FROM v GROUP BY 1""",
    "q26_word_counts": f"""
WITH p AS (SELECT unnest({_tokens("regexp_replace(html, '<[^>]*>', ' ', 'g')")}) AS word FROM pages), b AS (SELECT unnest({_tokens('text')}) AS word FROM benchmark)
SELECT word, count(*) AS n FROM p WHERE word NOT IN (SELECT word FROM b) GROUP BY 1""",
    "q27_sessions": """
WITH e AS (SELECT user_id, epoch_us(ts) AS t, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) > 1800000000, true) AS fresh FROM events),
s AS (SELECT user_id, t, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY t) AS k FROM e)
SELECT user_id, min(t) AS begin_us, max(t) AS end_us, count(*) AS n FROM s GROUP BY user_id, k""",
    "q32_assertions": """
SELECT 'unique_doc_ids' AS name, count(*) = count(DISTINCT doc_id) AS passed FROM documents
UNION ALL SELECT 'labels_have_documents', count(*) = 0 FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'n_chars_is_length', coalesce(bool_and(length(text) = n_chars), true) FROM documents
UNION ALL SELECT 'turns_are_dense', bool_and(m - n <= 0) FROM (SELECT max(turn) AS m, count(*) AS n FROM conversations GROUP BY conv_id)""",
    "q33_transcripts": f"""
SELECT * FROM (VALUES ('t1', 0, '1.1', 'Sí, tenim una granja... -...de prova.'), ('t1', 1, '1.2a', 'No.'), ('t1', 2, '1.1', 'Una  altra')) v(interview_id, position, question_id, original_text) WHERE length({_values([(_TRANSCRIPT,)])}) > 0""",
    "q35_confusion_partition": f"""
WITH {_SCORED} SELECT count(*) AS n_sentences, count(*) FILTER (confused) AS confused, count(*) FILTER (NOT confused) AS not_confused, count(*) FILTER (confused IS NULL) AS no_confusion_field, count(*) FILTER (confused) + count(*) FILTER (NOT confused) + count(*) FILTER (confused IS NULL) = count(*) AS partition_holds, round_even(100.0 * count(*) FILTER (confused) / count(*), 1)::DOUBLE AS confused_pct FROM scored""",
    "q36_degenerate": f"""
WITH w AS (SELECT row_number() OVER () AS r, text, {_words('text')} AS w FROM conversations),
g AS (SELECT r, array_to_string(w[i:i + 2], ' ') AS t FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 18)),
b AS (SELECT r, max(n) AS n FROM (SELECT r, t, count(*) AS n FROM g GROUP BY 1, 2) GROUP BY 1),
x AS (SELECT {_strip('text')} = '' AS is_empty, {_strip('text')} = 'source' AS is_identical_to_source, coalesce(n >= 6, false) AS repetition_flag FROM w LEFT JOIN b USING (r))
SELECT is_empty, is_identical_to_source, repetition_flag, is_empty OR repetition_flag AS flagged, count(*) AS n FROM x GROUP BY ALL""",
    "q37_question_order": """
SELECT question_id, row_number() OVER (ORDER BY list_transform(list_filter(string_split(question_id, '.'), lambda p: regexp_full_match(p, '[0-9]+')), lambda p: p::INT), question_id)::INT AS place
FROM (VALUES ('2.10'), ('2.9'), ('1.3a'), ('1'), ('10.1'), ('1.3b')) v(question_id)""",
    "q38_score_histogram": f"""
WITH {_SCORED}, c AS (SELECT greatest(least(floor(score)::INT, 5), 1) AS bin, count(*) AS n FROM scored GROUP BY 1)
SELECT s.r::INT AS bin, coalesce(n, 0) AS n, round(coalesce(100.0 * n / (SELECT count(score) FROM scored), 0), 6)::DOUBLE AS percent FROM range(1, 6) s(r) LEFT JOIN c ON c.bin = s.r""",
    "q39_clean_text": f"""
WITH x AS (SELECT conv_id, turn, text, regexp_replace(regexp_replace(text, '\\[\\d{{2}}:\\d{{2}}:\\d{{2}}\\.\\d{{3}} --> \\d{{2}}:\\d{{2}}:\\d{{2}}\\.\\d{{3}}\\]', '', 'g'), '[^\\p{{L}}\\p{{N}}_\\s.,!?¡¿]', ' ', 'g') AS c FROM conversations)
SELECT conv_id, turn, sha256(array_to_string(list_filter({_words('c')}, lambda w: NOT regexp_full_match(w, '\\d+')), ' ')) AS clean,
  sha256(regexp_replace(array_to_string(list_filter({_words('text')}, lambda w: NOT regexp_full_match(w, '\\d+')), ' '), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g')) AS topic,
  sha256(regexp_replace(text, '[!-/:-@\\[-`{{-~¡¿]', '', 'g')) AS bare FROM x""",
    "q40_diversity": f"WITH {_TOPIC_WORDS} SELECT round(count(DISTINCT w) / count(*)::DOUBLE, 9) AS diversity FROM (SELECT unnest(words) AS w FROM topic_words)",
    "q41_document_continuations": f"""
WITH s AS (SELECT source || '::' || doc_id AS response_id, {_sentences('text')} AS l FROM documents),
f AS (SELECT response_id, unnest(range(len(l))) AS i, unnest(l) AS t FROM s),
j AS (SELECT *, coalesce(regexp_matches(lag(t) OVER w, '(\\.\\.\\.|…)\\s*$') AND regexp_matches(regexp_replace(regexp_replace(t, '^[-–—]\\s*', ''), '^(\\.\\.\\.|…)\\s*', ''), '^[^\\p{{L}}\\d"''‘’“”(¿¡]*\\p{{Ll}}'), false) AS joins FROM f WINDOW w AS (PARTITION BY response_id ORDER BY i)),
k AS (SELECT *, sum((NOT joins)::INT) OVER (PARTITION BY response_id ORDER BY i) AS island FROM j),
p AS (SELECT *, row_number() OVER w AS place, count(*) OVER (PARTITION BY response_id, island) AS n FROM k WINDOW w AS (PARTITION BY response_id, island ORDER BY i)),
c AS (SELECT *, CASE WHEN place < n THEN rtrim(regexp_replace(t, '(\\.\\.\\.|…)\\s*$', '')) ELSE t END AS h FROM p)
SELECT response_id, sentence_index, sha256(text_source) AS sha256, fragments FROM (
SELECT response_id, (island - 1)::INT AS sentence_index, string_agg(CASE WHEN place > 1 THEN ltrim(regexp_replace(regexp_replace(h, '^[-–—]\\s*', ''), '^(\\.\\.\\.|…)\\s*', '')) ELSE h END, ' ' ORDER BY i) AS text_source, count(*)::INT AS fragments
FROM c GROUP BY response_id, island)""",
    "q42_document_transcripts": f"""
WITH s AS (SELECT doc_id::VARCHAR AS interview_id, {_sentences('text')} AS l FROM documents),
f AS (SELECT interview_id, unnest(range(len(l)))::INT AS i, unnest(l) AS t FROM s)
SELECT interview_id, i AS position, (i + 1)::VARCHAR AS question_id, sha256({_strip("replace(regexp_replace('   ' || t, '\\[\\d{2}:\\d{2}:\\d{2}\\.\\d{3} --> \\d{2}:\\d{2}:\\d{2}\\.\\d{3}\\]', '', 'g'), '  ', ' ')")}) AS sha256 FROM f""",
    "q43_document_question_order": """
WITH v AS (SELECT DISTINCT (doc_id % 100)::VARCHAR || '.' || (n_chars % 25)::VARCHAR || CASE WHEN lang = 'en' THEN '' ELSE lang[1] END AS question_id FROM documents)
SELECT question_id, row_number() OVER (ORDER BY list_transform(list_filter(string_split(question_id, '.'), lambda p: regexp_full_match(p, '[0-9]+')), lambda p: p::INT), question_id)::INT AS place FROM v""",
    "q00_flagship": f"""
WITH s AS (SELECT source AS interview_id, doc_id, unnest({_sentences('text')}) AS t FROM documents),
c AS (SELECT interview_id, count(DISTINCT doc_id) AS responses, count(*) AS sentences FROM s GROUP BY 1),
p AS (SELECT DISTINCT interview_id, doc_id, {_phrase('t')} AS phrase FROM s),
x AS (SELECT interview_id, phrase, count(*) AS n FROM p WHERE phrase <> '' AND len({_words('phrase')}) <= 4 GROUP BY 1, 2),
b AS (SELECT interview_id, phrase, n FROM x QUALIFY row_number() OVER (PARTITION BY interview_id ORDER BY n DESC, phrase) = 1)
SELECT c.interview_id, responses, sentences, phrase, n AS n_with_phrase FROM c LEFT JOIN b USING (interview_id)""",
}

#: As q41, on documents with planted ellipses.
ORACLES["q102_planted_continuations"] = ORACLES["q41_document_continuations"].replace(
    " FROM documents)", " FROM (SELECT doc_id, source, CASE doc_id % 4 WHEN 0 THEN replace(lower(text), '. ', '... ') WHEN 2 THEN replace(lower(text), '. ', '… - ...') ELSE text END AS text FROM documents))", 1
)
