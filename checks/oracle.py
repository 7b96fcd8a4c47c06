"""The registered queries as DuckDB SQL over the same tables."""

from __future__ import annotations

# Spark ML's default English stopwords, kept here so that the SQL
# doesn't depend on the code it checks.
ENGLISH_STOPWORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his
himself she her hers herself it its itself they them their theirs themselves what
which who whom this that these those am is are was were be been being have has had
having do does did doing a an the and but if or because as until while of at by for
with about against between into through during before after above below to from up
down in out on off over under again further then once here there when where why how
all any both each few more most other some such no nor not only own same so than too
very s t can will just don should now i'll you'll he'll she'll we'll they'll i'd
you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've
you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't
didn't won't wouldn't shan't shouldn't mustn't can't couldn't cannot could here's
how's let's ought that's there's what's when's where's who's why's would
""".split()

STOP = ", ".join("'" + word.replace("'", "''") + "'" for word in ENGLISH_STOPWORDS)


def _tokens(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '[a-z0-9_]+')"


def _normal(text: str) -> str:
    return f"trim(regexp_replace(lower({text}), '[^a-z0-9_]+', ' ', 'g'))"


def _kept(text: str) -> str:
    return f"list_filter({_tokens(text)}, lambda t: t NOT IN ({STOP}))"


def _with(*parts: str) -> str:
    """Common table expressions; the last part may go on with its SELECT."""
    return "WITH " + ",\n".join(part.strip() for part in parts) + "\n"


CORPUS = f"""
corpus AS (
  SELECT doc_id AS id, text AS content, {_normal("regexp_extract(text, '^[^.\\n]*')")} AS title FROM documents)
"""
POSTINGS = f"""
words AS (
  SELECT id AS doc_id, unnest({_tokens("content")}) AS term, 1 AS weight FROM corpus
  UNION ALL
  SELECT id, unnest({_tokens("title")}), 3 FROM corpus),
tf AS (
  SELECT doc_id, term, CAST(sum(weight) AS BIGINT) AS tf FROM words WHERE term NOT IN ({STOP}) GROUP BY doc_id, term),
lengths AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS doc_len FROM tf GROUP BY doc_id),
corpus_size AS (SELECT count(*) AS n FROM corpus),
terms AS (
  SELECT term, count(*) AS df, 1 + ln(any_value(n)::DOUBLE / (1 + count(*))) AS idf
  FROM tf, corpus_size GROUP BY term)
"""
QUERY_TERMS = f"""
asked AS (SELECT item_id AS query_id, unnest({_kept("text")}) AS term FROM benchmark),
query_words AS (SELECT DISTINCT query_id, term FROM asked)
"""
VOCABULARY = f"vocabulary AS (SELECT DISTINCT unnest({_tokens('text')}) AS token FROM documents)"
EXPANSION = f"""
{VOCABULARY},
raw_tokens AS (SELECT DISTINCT item_id AS query_id, unnest({_tokens("text")}) AS token FROM benchmark),
expansion AS (
  SELECT DISTINCT r.query_id, s.synonym AS expansion
  FROM raw_tokens r JOIN vocabulary USING (token),
       LATERAL (SELECT unnest([r.token || 's', 'near ' || r.token]) AS synonym) s
  WHERE length(r.token) >= 3)
"""
EXPANDED_TERMS = f"""
asked AS (
  SELECT item_id AS query_id, unnest({_kept("text")}) AS term FROM benchmark
  UNION ALL
  SELECT query_id, unnest({_kept("expansion")}) FROM expansion
  UNION ALL
  SELECT item_id, '' FROM benchmark WHERE len({_kept("text")}) = 0),
query_words AS (SELECT DISTINCT query_id, term FROM asked)
"""
TFIDF = """
scores AS (
  SELECT query_id, doc_id, sum(tf * idf) AS score
  FROM query_words JOIN terms USING (term) JOIN tf USING (term) GROUP BY query_id, doc_id)
"""
BM25 = """
average AS (SELECT sum(coalesce(doc_len, 0))::DOUBLE / count(*) AS avgdl
            FROM corpus LEFT JOIN lengths ON id = doc_id),
scores AS (
  SELECT query_id, doc_id,
         sum(ln(1 + (n - df + 0.5) / (df + 0.5))
             * (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * doc_len / avgdl)))) AS score
  FROM query_words JOIN terms USING (term) JOIN tf USING (term) JOIN lengths USING (doc_id), corpus_size, average
  GROUP BY query_id, doc_id)
"""
RELEVANCE = """
relevance AS (
  SELECT query_id, doc_id, score / coalesce(nullif(max(score) OVER (PARTITION BY query_id), 0), 1) AS keyword
  FROM scores)
"""
# The titles are ASCII, so any character standing for the others of a query
# leaves the edit distance in characters; DuckDB would count their bytes.
ASCII_QUERY = r"regexp_replace(lower(query), '[^\x00-\x7F]', '#', 'g')"
TITLE_MATCH = f"""
CASE WHEN title = '' THEN 0.0::DOUBLE
     ELSE (greatest(length({ASCII_QUERY}), length(title)) - levenshtein({ASCII_QUERY}, title))::DOUBLE
          / greatest(length({ASCII_QUERY}), length(title)) END
"""
VECTORS = """
vectors AS (SELECT vec_id, embedding::DOUBLE[] AS vec FROM embeddings)
"""
HYBRID = f"""
query_texts AS (SELECT item_id AS query_id, text AS query, vec AS query_vec
                FROM benchmark LEFT JOIN vectors ON vec_id = item_id),
doc_vectors AS (SELECT id, title, content, c.vec AS content_vec, t.vec AS title_vec
                FROM corpus LEFT JOIN vectors c ON c.vec_id = id LEFT JOIN vectors t ON t.vec_id = id + 1),
parts AS (
  SELECT q.query_id, d.id, d.title, d.content,
         coalesce(list_cosine_similarity(query_vec, content_vec), 0) AS semantic,
         coalesce(list_cosine_similarity(query_vec, title_vec), 0) AS title_cos,
         coalesce(keyword, 0) AS keyword,
         {TITLE_MATCH} AS title_match
  FROM query_texts q CROSS JOIN doc_vectors d
  LEFT JOIN relevance r ON r.query_id = q.query_id AND r.doc_id = d.id),
scored AS (
  SELECT *, round(semantic * 0.7::DOUBLE + keyword * (1 - 0.7::DOUBLE)
                  + (title_cos + title_match) / 2 * 0.3::DOUBLE, 6) AS score
  FROM parts)
"""
HYBRID_ALL = (CORPUS, POSTINGS, QUERY_TERMS, TFIDF, RELEVANCE, VECTORS, HYBRID)
HYBRID_COLUMNS = """query_id, id, title, score, round(semantic, 6) AS semantic_similarity,
  round(keyword, 6) AS keyword_relevance, round(title_cos, 6) AS title_relevance"""


def _ranked(parts: tuple[str, ...], threshold: float | None) -> str:
    passed = "" if threshold is None else f"WHERE score >= {threshold}"
    return (
        _with(*parts)
        + f"""SELECT query_id, rank, id, score, score AS relevance FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank
  FROM scored {passed}) WHERE rank <= 10"""
    )


def _best_scores(scores: str) -> str:
    return (
        _with(CORPUS, POSTINGS, QUERY_TERMS, scores)
        + """SELECT query_id, rank, id, score FROM (
  SELECT query_id, doc_id AS id, round(score, 6) AS score,
         CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS INTEGER) AS rank
  FROM scores) WHERE rank <= 10"""
    )


PROFILE = """
values_seen AS (SELECT field, short, count(*) AS c, max(pos) AS last_pos
                FROM fields WHERE short IS NOT NULL GROUP BY field, short),
uniques AS (SELECT field, count(*) AS d, arg_max(c, last_pos) AS last_count FROM values_seen GROUP BY field)
SELECT f.field,
       CASE WHEN count(DISTINCT type) = 1 THEN min(type) ELSE 'mixed' END AS type,
       CAST(round(count(*)::DOUBLE / (SELECT count(*) FROM entries) * 100) AS BIGINT) AS coverage,
       CAST(round(sum(len)::DOUBLE / count(*)) AS BIGINT) AS avg_length,
       CAST(CASE WHEN coalesce(any_value(d), 0) < 1000 THEN coalesce(any_value(d), 0)
                 WHEN any_value(d) = 1000 AND any_value(last_count) = 1 THEN 1000 END AS BIGINT) AS unique_values
FROM fields f LEFT JOIN uniques u ON u.field = f.field GROUP BY f.field
"""
TYPED_FIELDS = r"""
fields AS (
  SELECT pos, 'any' AS field,
         CASE k WHEN 0 THEN 'null' WHEN 1 THEN 'string' WHEN 2 THEN 'number' WHEN 3 THEN 'boolean'
                WHEN 4 THEN 'empty_array' WHEN 5 THEN 'array_of_number' ELSE 'object' END AS type,
         CASE k WHEN 0 THEN 0 WHEN 1 THEN 4 WHEN 2 THEN length(CAST(pos AS VARCHAR)) WHEN 3 THEN 4
                WHEN 4 THEN 0 ELSE 2 END AS len,
         CASE k WHEN 1 THEN 'text' END AS short
  FROM (SELECT *, pos % 7 AS k FROM entries)
  UNION ALL SELECT pos, 'event', 'string', length(event_type), event_type FROM entries
  UNION ALL SELECT pos, 'value', 'number', length(regexp_replace(CAST(value AS VARCHAR), '\.0$', '')), NULL FROM entries
  UNION ALL SELECT pos, 'serial', 'string', length(CAST(pos AS VARCHAR)) + 1, 'n' || pos FROM entries
  UNION ALL SELECT pos, 'cycle', 'string', length(CAST(pos % 1000 AS VARCHAR)) + 1, 'c' || (pos % 1000) FROM entries
  UNION ALL SELECT pos, 'tags', 'array_of_array_of_string', 2, NULL FROM entries
  UNION ALL SELECT pos, 'flags', 'array_of_null', 2, NULL FROM entries
  UNION ALL SELECT pos, 'early', 'string', length(CAST(pos AS VARCHAR)) + 1, 'e' || pos FROM entries WHERE pos < 1000)
"""
EVENTS = "entries AS (SELECT event_id AS pos, * FROM events)"
DOCUMENT_FIELDS = """
fields AS (
  SELECT pos, 'doc_id' AS field, 'number' AS type, length(CAST(doc_id AS VARCHAR)) AS len, NULL AS short FROM entries
  UNION ALL SELECT pos, 'n_chars', 'number', length(CAST(n_chars AS VARCHAR)), NULL FROM entries
  UNION ALL SELECT pos, 'text', 'string', length(text), CASE WHEN length(text) < 100 THEN text END FROM entries
  UNION ALL SELECT pos, 'lang', 'string', length(lang), CASE WHEN length(lang) < 100 THEN lang END FROM entries
  UNION ALL SELECT pos, 'source', 'string', length(source), CASE WHEN length(source) < 100 THEN source END FROM entries)
"""
PROP_FIELDS = """
fields AS (SELECT pos, 'k' AS field, 'number' AS type, length(json_extract_string(props, '$.k')) AS len,
                  CAST(NULL AS VARCHAR) AS short FROM entries)
"""
LINES = """
lines AS (
  SELECT 2 * doc_id AS pos, CAST(json_object('title', source, 'content', text) AS VARCHAR) AS line FROM documents
  UNION ALL
  SELECT 2 * doc_id + 1, CASE doc_id % 10
    WHEN 0 THEN CAST(json_object('title', source, 'content', text) AS VARCHAR) || ' x'
    WHEN 1 THEN CAST(json_object('title', source) AS VARCHAR)
    WHEN 2 THEN CAST(json_object('content', n_chars) AS VARCHAR)
    WHEN 3 THEN 'null'
    ELSE CAST(json_object('title', 7, 'content', text) AS VARCHAR) END
  FROM documents WHERE doc_id % 10 < 5)
"""
LINE_FIELDS = """
entries AS (
  SELECT 2 * doc_id AS pos, 5 AS k, * FROM documents
  UNION ALL SELECT 2 * doc_id + 1, doc_id % 10, * FROM documents WHERE doc_id % 10 BETWEEN 1 AND 4),
fields AS (
  SELECT pos, 'title' AS field, 'string' AS type, length(source) AS len, source AS short
  FROM entries WHERE k IN (1, 5)
  UNION ALL SELECT pos, 'title', 'number', 1, NULL FROM entries WHERE k = 4
  UNION ALL SELECT pos, 'content', 'number', length(CAST(n_chars AS VARCHAR)), NULL FROM entries WHERE k = 2
  UNION ALL SELECT pos, 'content', 'string', length(text), CASE WHEN length(text) < 100 THEN text END
  FROM entries WHERE k >= 4)
"""
SIZE = """
  SELECT bytes, CASE WHEN bytes < 1024 THEN printf('%.2f B', bytes::DOUBLE)
                WHEN bytes < 1048576 THEN printf('%.2f KB', bytes / 1024.0::DOUBLE)
                WHEN bytes < 1073741824 THEN printf('%.2f MB', bytes / 1048576.0::DOUBLE)
                WHEN bytes < 1099511627776 THEN printf('%.2f GB', bytes / 1073741824.0::DOUBLE)
                ELSE printf('%.2f TB', bytes / 1099511627776.0::DOUBLE) END AS file_size
  FROM (SELECT CAST(sum(strlen(line) + 1) AS BIGINT) AS bytes FROM lines)
"""
LINE_CORPUS = """
corpus AS (
  SELECT row_number() OVER (ORDER BY doc_id) - 1 AS id, text AS content, source AS title
  FROM documents WHERE text <> '')
"""
NO_VECTORS = "vectors AS (SELECT vec_id, embedding::DOUBLE[] AS vec FROM embeddings WHERE false)"


def _lemma_of(term: str) -> str:
    return f"CASE WHEN {term} LIKE '%s' AND length({term}) >= 4 THEN left({term}, length({term}) - 1) ELSE {term} END"


LEMMA_POSTINGS = POSTINGS.replace(
    "SELECT doc_id, term, CAST(sum(weight)", f"SELECT doc_id, {_lemma_of('words.term')} AS term, CAST(sum(weight)"
).replace("GROUP BY doc_id, term),\nlengths", "GROUP BY ALL),\nlengths")
LEMMA_QUERY_TERMS = f"""
{VOCABULARY},
asked AS (SELECT item_id AS query_id, unnest({_kept("text")}) AS term FROM benchmark),
query_words AS (
  SELECT DISTINCT query_id,
         CASE WHEN term IN (SELECT token FROM vocabulary) THEN {_lemma_of("term")} ELSE term END AS term
  FROM asked)
"""
OTHER_WEIGHTS = HYBRID.replace("0.7::DOUBLE", "0.5::DOUBLE").replace("0.3::DOUBLE", "0.6::DOUBLE")
NO_TITLE_VECTORS = HYBRID.replace("t.vec AS title_vec", "NULL::DOUBLE[] AS title_vec")


def _listed(tokens: str) -> str:
    return (
        f"SELECT doc_id, CAST(len(l) AS INTEGER) AS n_tokens, array_to_string(l, ' ') AS tokens "
        f"FROM (SELECT doc_id, {tokens} AS l FROM documents)"
    )


_lemma = "CASE WHEN t LIKE '%s' AND length(t) >= 4 THEN left(t, length(t) - 1) ELSE t END"


def _word_space(dim: int = 16, window: int = 4, min_count: int = 5, rounds: int = 2) -> str:
    """Word vectors as rows ``word, j, v``: columns are made orthonormal one by one."""
    steps = [
        f"tokens AS MATERIALIZED (SELECT doc_id, {_kept('text')} AS w FROM documents)",
        f"""placed AS MATERIALIZED (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM tokens),
frequent AS MATERIALIZED (SELECT word FROM placed GROUP BY word HAVING count(*) >= {min_count}),
counts AS MATERIALIZED (
  SELECT word, context, count(*) AS n FROM (
    SELECT x.word, y.word AS context FROM placed x JOIN placed y
      ON x.doc_id = y.doc_id AND abs(x.place - y.place) BETWEEN 1 AND {window})
  WHERE word IN (FROM frequent) AND context IN (FROM frequent) GROUP BY ALL),
sums AS MATERIALIZED (SELECT word, sum(n)::DOUBLE AS n FROM counts GROUP BY word),
matrix AS MATERIALIZED (
  SELECT c.word, c.context, ln(c.n * (SELECT sum(n) FROM sums) / (s.n * t.n)) AS weight
  FROM counts c JOIN sums s ON s.word = c.word JOIN sums t ON t.word = c.context
  WHERE ln(c.n * (SELECT sum(n) FROM sums) / (s.n * t.n)) > 0),
basis_0 AS MATERIALIZED (
  SELECT word, j, CASE WHEN substr(md5(word || ':0'), CAST(j + 1 AS INTEGER), 1) < '8' THEN 1.0 ELSE -1.0 END::DOUBLE AS v
  FROM (SELECT DISTINCT word FROM matrix), range({dim}) r(j))""",
    ]
    product = "SELECT m.word, j, sum(weight * v) AS v FROM matrix m JOIN {} b ON b.word = m.context GROUP BY ALL"
    for step in range(1, rounds + 1):
        steps.append(f"y_{step} AS MATERIALIZED ({product.format(f'basis_{step - 1}')})")
        made = []
        for j in range(dim):
            name, own = f"q_{step}_{j}", f"(SELECT word, v FROM y_{step} WHERE j = {j})"
            if made:
                before = " UNION ALL ".join(f"SELECT word, {i} AS i, v FROM {q}" for i, q in enumerate(made))
                steps.append(f"""b_{step}_{j} AS MATERIALIZED ({before}),
d_{step}_{j} AS MATERIALIZED (SELECT i, sum(b.v * y.v) AS dot FROM b_{step}_{j} b JOIN {own} y USING (word) GROUP BY i),
l_{step}_{j} AS MATERIALIZED (
  SELECT y.word, any_value(y.v) - sum(b.v * d.dot) AS v
  FROM {own} y JOIN b_{step}_{j} b USING (word) JOIN d_{step}_{j} d USING (i) GROUP BY y.word)""")
                left = f"l_{step}_{j}"
            else:
                left = own
            steps.append(f"{name} AS MATERIALIZED (SELECT word, v / sqrt(sum(v * v) OVER ()) AS v FROM {left})")
            made.append(name)
        steps.append(
            f"basis_{step} AS MATERIALIZED ("
            + " UNION ALL ".join(f"SELECT word, {i} AS j, v FROM {q}" for i, q in enumerate(made)) + ")"
        )
    steps.append(f"""space AS MATERIALIZED (
  SELECT word, j, v::FLOAT::DOUBLE AS v FROM ({product.format(f'basis_{rounds}')}))""")
    return ",\n".join(steps)


ORACLE: dict[str, str] = {
    "normalise_text": f"SELECT doc_id, {_normal('text')} AS normalised FROM documents",
    "tokenise": _listed(_tokens("text")),
    "remove_stopwords": _listed(_kept("text")),
    "lemmatise": _listed(f"list_transform({_tokens('text')}, lambda t: {_lemma})"),
    "preprocess_text": f"SELECT doc_id, array_to_string({_kept('text')}, ' ') AS processed FROM documents",
    "term_counts": _with(CORPUS, POSTINGS) + "SELECT doc_id, term, tf, doc_len FROM tf JOIN lengths USING (doc_id)",
    "doc_freq_idf": _with(CORPUS, POSTINGS) + "SELECT term, df, round(idf, 6) AS idf FROM terms",
    "tfidf_scores": _with(CORPUS, POSTINGS, QUERY_TERMS, TFIDF)
    + "SELECT query_id, doc_id, round(score, 6) AS score FROM scores",
    "keyword_relevance": _with(CORPUS, POSTINGS, QUERY_TERMS, TFIDF, RELEVANCE)
    + "SELECT query_id, doc_id, round(keyword, 6) AS keyword_relevance FROM relevance",
    "bm25_scores": _with(CORPUS, POSTINGS, QUERY_TERMS, BM25)
    + "SELECT query_id, doc_id, round(score, 6) AS score FROM scores",
    "attach_vectors": _with(VECTORS)
    + """SELECT doc_id AS id, 64 AS content_dim, round(coalesce(list_sum(c.vec), 0), 6) AS content_sum,
                round(coalesce(list_sum(t.vec), 0), 6) AS title_sum
         FROM documents LEFT JOIN vectors c ON c.vec_id = doc_id LEFT JOIN vectors t ON t.vec_id = doc_id + 1""",
    "cosine_similarity": _with(VECTORS)
    + """SELECT doc_id AS id, round(coalesce(list_cosine_similarity(c.vec, t.vec), 0), 6) AS similarity
         FROM documents LEFT JOIN vectors c ON c.vec_id = doc_id LEFT JOIN vectors t ON t.vec_id = doc_id + 1""",
    "nearest_exact": _with(VECTORS)
    + """SELECT query_id, rank, id, similarity FROM (
           SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS INTEGER) AS rank
           FROM (SELECT item_id AS query_id, doc_id AS id,
                        round(coalesce(list_cosine_similarity(q.vec, d.vec), 0), 6) AS similarity
                 FROM benchmark LEFT JOIN vectors q ON q.vec_id = item_id
                 CROSS JOIN documents LEFT JOIN vectors d ON d.vec_id = doc_id))
         WHERE rank <= 10""",
    "expand_synonyms": _with(EXPANSION) + "SELECT query_id, expansion FROM expansion",
    "query_terms": _with(EXPANSION, EXPANDED_TERMS) + "SELECT query_id, term FROM query_words",
    "title_similarity": _with(CORPUS)
    + f"""SELECT query_id, CAST(rank AS INTEGER) AS rank, id, title_match FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY title_match DESC, id) AS rank
            FROM (SELECT query_id, id, round({TITLE_MATCH}, 6) AS title_match
                  FROM corpus CROSS JOIN (SELECT item_id AS query_id, text AS query FROM benchmark)))
          WHERE rank <= 10""",
    "hybrid_score": _with(*HYBRID_ALL)
    + """SELECT * FROM (
           SELECT query_id, count(*) AS pairs, round(sum(score), 3) AS total, round(min(score), 5) AS least,
                  round(max(score), 5) AS most, round(sum(semantic), 3) AS semantic, round(sum(keyword), 3) AS keyword,
                  round(sum(title_cos), 3) AS title, round(sum(title_match), 3) AS title_match
           FROM scored GROUP BY query_id)
         LEFT JOIN (
           SELECT query_id, id, title AS document_title, score, round(semantic, 6) AS semantic_similarity,
                  round(keyword, 6) AS keyword_relevance, round(title_cos, 6) AS title_relevance
           FROM scored WHERE score >= 0.25) USING (query_id)""",
    "hybrid_threshold": _with(*HYBRID_ALL) + f"SELECT {HYBRID_COLUMNS} FROM scored WHERE score >= 0.5",
    "hybrid_topk": _ranked(HYBRID_ALL, None),
    "search_view": _with(*HYBRID_ALL)
    + """SELECT query_id, rank, CASE WHEN title = '' THEN 'Untitled' ELSE title END AS title,
                printf('%.4f', score) AS score, printf('%.2f', score * 100) || '%' AS relevance,
                CASE WHEN length(content) > 200 THEN substring(content, 1, 200) || '...' ELSE content END AS snippet
         FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank
               FROM scored WHERE score >= 0.1) WHERE rank <= 10""",
    "bm25_search": _ranked((CORPUS, POSTINGS, QUERY_TERMS, BM25, RELEVANCE, VECTORS, HYBRID), 0.1),
    "expanded_search": _ranked(
        (CORPUS, POSTINGS, EXPANSION, EXPANDED_TERMS, TFIDF, RELEVANCE, VECTORS, HYBRID), 0.1
    ),
    "profile_documents": _with("entries AS (SELECT doc_id AS pos, * FROM documents)", DOCUMENT_FIELDS, PROFILE),
    "profile_props": _with(EVENTS, PROP_FIELDS, PROFILE),
    "profile_types": _with(EVENTS, TYPED_FIELDS, PROFILE),
    "profile_fields_filter": _with(
        EVENTS, TYPED_FIELDS.replace("fields AS", "all_fields AS"),
        "fields AS (SELECT * FROM all_fields WHERE field IN ('event', 'value', 'absent'))", PROFILE,
    ),
    "profile_sample": _with(
        "entries AS (SELECT event_id AS pos, * FROM events ORDER BY event_id LIMIT 500)", TYPED_FIELDS, PROFILE
    ),
    "jsonl_extract": """SELECT row_number() OVER (ORDER BY doc_id) - 1 AS id, source AS title, text AS content
                        FROM documents WHERE text <> ''""",
    "jsonl_rejects": """SELECT 2 * doc_id + 1 AS pos,
                               CASE doc_id % 10 WHEN 0 THEN 'bad_json' WHEN 1 THEN 'no_content'
                               WHEN 2 THEN 'not_string' WHEN 3 THEN 'bad_entry' ELSE 'not_string' END AS reason
                        FROM documents WHERE doc_id % 10 < 5
                        UNION ALL SELECT 2 * doc_id, 'no_content' FROM documents WHERE coalesce(text, '') = ''""",
    "dataset_size": _with(LINES) + SIZE,
    "analyze_files": _with(LINES, LINE_FIELDS)
    + f"""SELECT p.*, (SELECT count(*) FROM entries) AS total_entries, s.file_size
          FROM (WITH {PROFILE.strip()}) p, ({SIZE}) s""",
    "lines_to_search": _ranked((LINE_CORPUS, POSTINGS, QUERY_TERMS, TFIDF, RELEVANCE, NO_VECTORS, HYBRID), None),
    "search_no_title_boost": _ranked(
        (CORPUS, POSTINGS, QUERY_TERMS, TFIDF, RELEVANCE, VECTORS, NO_TITLE_VECTORS), None
    ),
    "search_weights": _ranked((CORPUS, POSTINGS, QUERY_TERMS, TFIDF, RELEVANCE, VECTORS, OTHER_WEIGHTS), None),
    "search_lemmas": _ranked(
        (CORPUS, LEMMA_POSTINGS, LEMMA_QUERY_TERMS, TFIDF, RELEVANCE, VECTORS, HYBRID), None
    ),
    "hashed_embed": f"""
      WITH words AS (SELECT doc_id AS id, md5(unnest({_kept("text")})) AS h FROM documents),
      slots AS (SELECT id, CAST('0x' || substr(h, 1, 6) AS BIGINT) % 64 AS slot,
                       sum(CASE WHEN substr(h, 7, 1) < '8' THEN 1 ELSE -1 END) AS v FROM words GROUP BY ALL)
      SELECT doc_id AS id, CAST(64 AS INTEGER) AS dim,
             round(coalesce(any_value(total), 0) / coalesce(nullif(any_value(norm), 0), 1), 3) AS weighted
      FROM documents LEFT JOIN (SELECT id, sum(v * (slot + 1))::DOUBLE AS total, sqrt(sum(v * v)::DOUBLE) AS norm
                                FROM slots GROUP BY id) ON id = doc_id GROUP BY doc_id""",
    "cooccurrence_embed": _with(_word_space()) + """,
      means AS (SELECT doc_id, j, sum(v) / count(*) AS v FROM placed JOIN space USING (word) GROUP BY ALL)
      SELECT doc_id AS id, round(coalesce(norm, 0), 5) AS norm FROM documents
      LEFT JOIN (SELECT doc_id, sqrt(sum(v * v)) AS norm FROM means GROUP BY doc_id) USING (doc_id)""",
    "cooccurrence_words": _with(_word_space()) + f""",
      asked AS (SELECT DISTINCT unnest({_kept("text")}) AS word FROM benchmark),
      norms AS MATERIALIZED (SELECT word, sqrt(sum(v * v)) AS norm FROM space GROUP BY word),
      pairs AS (
        SELECT x.word AS token, y.word, sum(x.v * y.v) AS dot
        FROM space x JOIN asked a ON a.word = x.word JOIN space y ON y.j = x.j AND y.word <> x.word GROUP BY ALL),
      scored AS (
        SELECT token, p.word, round(dot / (s.norm * t.norm), 6) AS similarity
        FROM pairs p JOIN norms s ON s.word = p.token JOIN norms t ON t.word = p.word)
      SELECT token, CAST(row_number() OVER (PARTITION BY token ORDER BY similarity DESC, word) AS INTEGER) AS rank,
             word, similarity FROM scored QUALIFY rank <= 3""",
    "keyword_topk": _best_scores(TFIDF),
    "bm25_topk": _best_scores(BM25),
    "index_roundtrip": _ranked(HYBRID_ALL, None),
    "index_metadata": _with(CORPUS, POSTINGS)
    + """SELECT 'documents.parquet' AS source_file, 'content' AS content_field, 'title' AS title_field,
                'stored vectors' AS model, true AS title_boost, (SELECT n FROM corpus_size) AS entry_count,
                round((SELECT sum(tf) FROM tf)::DOUBLE / (SELECT n FROM corpus_size), 6) AS avg_doc_len""",
}
