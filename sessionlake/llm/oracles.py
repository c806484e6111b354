"""DuckDB SQL for the corpus queries that SQL can express over whole tables."""

ORACLES: dict[str, str] = {}

ORACLES["op1_mix_sources"] = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('0:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))) AS key
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight,
         sum(source_size) OVER () AS total
  FROM sources),
levels AS (
  SELECT *, (total - 3 * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / (sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS own_level
  FROM weighed),
targets AS (
  SELECT source, source_size,
         least((max(CASE WHEN own_level * weight <= 3 * source_size THEN own_level END) OVER ()) * weight, (3 * source_size)::DOUBLE) AS target
  FROM levels),
placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.size, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * size
        + greatest(0, least(size, budget - CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * source_size - before)))::BIGINT AS taken
FROM placed
"""

ORACLES["op7_exact_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS vector
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.vector, c.vector)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.vector) = len(c.vector)
  WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s
QUALIFY rank <= 5
"""

ORACLES["op8_warc_round_trip"] = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
f AS (
  SELECT *, min(page_id) OVER (PARTITION BY hex) AS first_id FROM p)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(8), lambda i: list_aggregate(list_transform(range(4), lambda j:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, (i * 5 + 1)::INTEGER, 5))::BIGINT >> (15 - 5 * j)::INTEGER) & 31)::INTEGER + 1, 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest,
       CASE WHEN first_id IS NULL OR page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first_id IS NULL OR page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM f
"""

ORACLES["op10_chat_trees"] = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -1, t, CASE t WHEN 0 THEN 'user' ELSE 'assistant' END, '<|im_end|><|im_start|>assistant ok' FROM range(2) r(t))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('<|im_start|>') + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '<\n')) + 1
           + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + length('<|im_end|>') + 1)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""

ORACLES["op11_fill_in_middle"] = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents),
e AS (
  SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS a, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 90 THEN 'plain'
              WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM d),
f AS (
  SELECT *, substring(t, 1, least(a, b)) AS prefix, substring(t, least(a, b) + 1, greatest(a, b) - least(a, b)) AS middle, substring(t, greatest(a, b) + 1) AS suffix FROM e)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN least(a, b) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN greatest(a, b) - least(a, b) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM f
"""

_DISTANCE = "sqrt(greatest(0.0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2))"

ORACLES["op12_divergence_rules"] = rf"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS k, doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
windows AS (
  SELECT k, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c FROM (SELECT k, words, unnest(range(1, len(words) - 1)) AS i FROM d)),
again AS (
  SELECT k, i FROM windows QUALIFY count(*) OVER (PARTITION BY k, a, b, c) > 1),
repeated AS (
  SELECT k, count(DISTINCT i + j)::BIGINT AS n FROM again, range(3) r(j) GROUP BY k),
lines AS (
  SELECT k, (count(*) - count(DISTINCT line))::BIGINT AS n FROM (SELECT k, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY k),
base AS MATERIALIZED (
  SELECT d.k, doc_id, lang, t, words, len(words)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines, coalesce(repeated.n, 0) AS n_repeat_words,
         len(words) < 50 OR 100 * coalesce(repeated.n, 0) > 50 * len(words) AS base_failed, length(t) AS n_chars
  FROM d LEFT JOIN lines USING (k) LEFT JOIN repeated USING (k)),
classes AS MATERIALIZED (
  SELECT k, base_failed, lang, n_chars, c.number, n_chars - length(regexp_replace(t, c.pattern, '', 'g')) AS n
  FROM base, (VALUES (0, '[A-Z]'), (1, '[a-z]'), (2, '[0-9]'), (3, '[\x20\x09-\x0D]'), (4, '[.,;:?''"()-]'), (5, '[\x00-\x08\x0E-\x1F!#$%&*+/<=>@\[\\\]^_`{{|}}~\x7F]'), (6, '[^\x00-\x7F]')) c(number, pattern)
  WHERE n_chars > 0),
counted AS MATERIALIZED (
  SELECT k, base_failed, lang, n_words, rtrim(translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '.,;:?!') AS word, count(*) AS n
  FROM (SELECT k, base_failed, lang, n_words, unnest(words) AS w FROM base WHERE n_words >= 50) GROUP BY ALL),
docs AS (
  SELECT lang, count(*) AS n_docs FROM base WHERE NOT base_failed AND lang IS NOT NULL GROUP BY lang HAVING count(*) >= 30),
class_sums AS (
  SELECT lang, number, sum(1000000 * n // n_chars) AS amount FROM classes JOIN docs USING (lang) WHERE NOT base_failed GROUP BY lang, number),
class_refs AS (
  SELECT lang, number, amount::DOUBLE / sum(amount::DOUBLE) OVER (PARTITION BY lang) AS q FROM class_sums),
word_refs AS MATERIALIZED (
  SELECT lang, word, sum(1000000 * n // n_words)::DOUBLE / (1000000 * any_value(n_docs)) AS q FROM counted JOIN docs USING (lang) WHERE NOT base_failed GROUP BY lang, word
  QUALIFY row_number() OVER (PARTITION BY lang ORDER BY sum(1000000 * n // n_words) DESC, word) <= 64),
class_distances AS (
  SELECT k, lang, {_DISTANCE} AS d FROM (SELECT k, r.lang, n::DOUBLE / n_chars AS p, q FROM classes c JOIN class_refs r USING (number) WHERE n_chars >= 200) GROUP BY k, lang),
common AS (
  SELECT b.k, r.lang, coalesce(c.n, 0)::DOUBLE / b.n_words AS p, r.q
  FROM (SELECT k, n_words FROM base WHERE n_words >= 50) b CROSS JOIN word_refs r LEFT JOIN counted c ON c.k = b.k AND c.word = r.word),
bins AS (
  SELECT * FROM common UNION ALL SELECT k, lang, 1 - sum(p), 1 - sum(q) FROM common GROUP BY k, lang),
word_distances AS (
  SELECT k, lang, {_DISTANCE} AS d FROM bins GROUP BY k, lang),
near AS (
  SELECT k, min(d) AS d FROM class_distances GROUP BY k),
alike AS (
  SELECT k, min(d) AS d FROM word_distances GROUP BY k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND (coalesce(lang NOT IN (SELECT lang FROM docs), false) OR coalesce(near.d, 0) <= 0.25 AND coalesce(alike.d, 0) <= CASE WHEN n_words < 100 THEN 0.46 ELSE 0.40 END) AS kept
FROM base LEFT JOIN near USING (k) LEFT JOIN alike USING (k)
"""


def _vector_codes() -> str:
    """Six rounds and a last assignment, each as a step of its own."""
    steps = []
    for n in range(7):
        steps.append(f"""
pairs{n} AS (
  SELECT x.k, x.part, b.entry, list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM parts x JOIN books{n} b USING (part)),
found{n} AS MATERIALIZED (
  SELECT k, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM pairs{n} GROUP BY k, part)""")
        if n < 6:
            steps.append(f"""
sums{n} AS (
  SELECT part, entry, place, sum(x)::BIGINT AS s, count(*) AS n FROM (
    SELECT part, entry, unnest(range(1, len(v) + 1)) AS place, unnest(v) AS x FROM found{n} JOIN parts USING (k, part)) GROUP BY ALL),
means{n} AS (
  SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY place) AS v FROM sums{n} GROUP BY part, entry),
books{n + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM books{n} b LEFT JOIN means{n} m USING (part, entry))""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS k, vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 4096)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
parts AS MATERIALIZED (
  SELECT k, p AS part, v[p * (len(v) // 8) + 1 : (p + 1) * (len(v) // 8)] AS v FROM kept, range(8) r(p)),
books0 AS MATERIALIZED (
  SELECT part, k - 1 AS entry, v FROM parts WHERE k <= 16),{",".join(steps)},
coded AS (
  SELECT k, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM found6 GROUP BY k)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) FROM books6) AS codebooks_sha256
FROM coded JOIN kept USING (k)
"""


ORACLES["op13_vector_codes"] = _vector_codes()
