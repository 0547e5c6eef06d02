"""SQL twins of the registered queries, for a second engine over the same files."""

from lakeqa.functions import stem, templates as T
from lakeqa.functions.text import ENGLISH_STOP_WORDS, PUNCTUATION, PUNCTUATION_BUT_COMMA_AND_PERIOD
from lakeqa.functions.text import PIECE, TOKEN, WORD
from lakeqa.operators.costs import PRICES
from lakeqa.operators.evaluate import K_VALUES
from lakeqa.operators.report import ACCURACIES, COST, MODELS

ORACLE = {}

MODEL, OTHER_MODEL = MODELS


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def strings(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def words(text: str) -> str:
    return f"regexp_extract_all({text}, {lit(WORD)})"


def content_words(text: str) -> str:
    return f"list_filter({words(text)}, lambda w: NOT list_contains({strings(ENGLISH_STOP_WORDS)}, w))"


def tokens(text: str) -> str:
    return f"len(regexp_extract_all({text}, {lit(TOKEN)}))"


def first_tokens(text: str, n: str) -> str:
    return (
        f"CASE WHEN {tokens(text)} <= {n} THEN {text} "
        f"ELSE array_to_string(list_slice(regexp_extract_all({text}, {lit(PIECE)}), 1, greatest({n}, 0)), '') END"
    )


def six(expression: str, name: str) -> str:
    return f"round({expression}, 6) AS {name}"


def with_(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


# Inputs

CORPUS = """corpus AS (
  SELECT doc_id AS ord, CAST(doc_id AS VARCHAR) AS table_id, source AS table_name, text AS table_content
  FROM documents)"""

LAKE = """raw_lake AS (
  SELECT 'aitqa' AS dataset, doc_id AS ord, 'd' || doc_id AS table_id,
         source || ', "' || lang || '"' AS table_name,
         [['first'], ['second', 'part'], ['third', 'part', 'ignored level']] AS column_header,
         list_transform(string_split(text, chr(10)), lambda line, i:
           CASE WHEN (i - 1) % 2 = 0 THEN ['line', CAST(i AS VARCHAR)] ELSE [CAST(i AS VARCHAR)] END)
           AS row_header,
         list_transform(string_split(text, chr(10)), lambda line: string_split(line, '. ')) AS data
  FROM documents
  UNION ALL
  SELECT 'nqtables', o_orderkey, 'o' || o_orderkey, o_orderpriority,
         [['field'], ['value, as text']], CAST([] AS VARCHAR[][]),
         [['customer', CAST(o_custkey AS VARCHAR)], ['status', o_orderstatus],
          ['total price', CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR)],
          ['date', strftime(o_orderdate, '%Y-%m-%d')]] || coalesce(lines, [])
  FROM orders LEFT JOIN (
    SELECT l_orderkey, list(['line ' || l_linenumber, what] ORDER BY l_linenumber, what) AS lines
    FROM (SELECT *, CAST(CAST(l_quantity AS DECIMAL(12,2)) AS VARCHAR) || ' of part ' || l_partkey || ' ' || l_returnflag AS what
      FROM lineitem) GROUP BY l_orderkey) ON o_orderkey = l_orderkey)"""

PASSAGES = """passages AS (
  SELECT item_id AS query_ord, 'q' || item_id AS query_id, text AS query_text FROM benchmark)"""

GOLD = """gold AS (
  SELECT query_id, table_id, 1 AS rel FROM passages, corpus WHERE contains(table_content, query_text)),
asked_gold AS (
  SELECT query_ord, query_id, query_text, CAST(min(CAST(table_id AS BIGINT)) AS VARCHAR) AS table_id
  FROM passages JOIN gold USING (query_id) GROUP BY ALL)"""


def quoted(cell: str) -> str:
    return (
        f"CASE WHEN regexp_matches({cell}, '[\",\\r\\n]') "
        f"THEN '\"' || replace({cell}, '\"', '\"\"') || '\"' ELSE {cell} END"
    )


def csv_line(cells: str) -> str:
    return (
        f"CASE WHEN len({cells}) = 1 AND {cells}[1] = '' THEN '\"\"' ELSE "
        f"array_to_string(list_transform({cells}, lambda c: {quoted('c')}), ',') END || chr(13) || chr(10)"
    )


def header(path: str) -> str:
    return (
        f"CASE WHEN len({path}) > 1 THEN {path}[1] || ' ' || {path}[2] ELSE coalesce({path}[1], '') END"
    )


def lake_text(linearization: str, rows: str = "", cells: str = "c") -> list[str]:
    data = f"list_transform(data{rows}, lambda r: list_transform(r, lambda c: {cells}))"
    shaped = f"""lake AS (
  SELECT * REPLACE (row_header{rows} AS row_header, {data} AS data) FROM raw_lake)"""
    if linearization == "csv":
        content = f"""
    {csv_line('[table_id, table_name]')} ||
    CASE WHEN len(row_header) > 0 THEN
      {csv_line(f"list_concat([''], list_transform(column_header, lambda h: {header('h')}))")} ||
      array_to_string(list_transform(list_zip(row_header, data, true), lambda z:
        {csv_line(f"list_concat([{header('z[1]')}], z[2])")}), '')
    ELSE
      {csv_line(f"list_transform(column_header, lambda h: {header('h')})")} ||
      array_to_string(list_transform(data, lambda d: {csv_line('d')}), '')
    END"""
    else:
        content = """
    CASE WHEN dataset = 'aitqa' THEN
      CAST(to_json({'id': table_id, 'title': table_name, 'column_header': column_header,
                    'row_header': row_header, 'data': data}) AS VARCHAR)
    ELSE
      CAST(to_json({'id': table_id, 'title': table_name,
                    'columns': list_transform(column_header, lambda h: {'text': h[1]}),
                    'rows': list_transform(data, lambda r:
                      {'cells': list_transform(r, lambda c: {'text': c})})}) AS VARCHAR)
    END"""
    return [LAKE, shaped, f"lake_text AS (SELECT dataset, table_id, table_name, {content} AS table_content FROM lake)"]


ORACLE["tables_normalized"] = with_(LAKE, select="""
SELECT dataset, ord, table_id, table_name, CAST(to_json(column_header) AS VARCHAR) AS column_header,
       CAST(to_json(row_header) AS VARCHAR) AS row_header, CAST(to_json(data) AS VARCHAR) AS data
FROM raw_lake""")

ORACLE["header_flatten"] = with_(LAKE, select=f"""
SELECT table_id,
       array_to_string(list_transform(column_header, lambda h: {header('h')}), '|') AS columns,
       array_to_string(list_transform(row_header, lambda h: {header('h')}), '|') AS row_names
FROM raw_lake""")

for name, parts in {
    "linearize_csv": lake_text("csv"),
    "linearize_json": lake_text("json"),
    "row_limit": lake_text("csv", rows="[1:2]"),
    "cell_truncate": lake_text("csv", cells=first_tokens("c", "4")),
}.items():
    ORACLE[name] = with_(*parts, select="SELECT table_id, table_content FROM lake_text")

ORACLE["table_title"] = with_(LAKE, select="""
SELECT table_id, form, table_name AS title FROM raw_lake, (VALUES ('csv'), ('json')) AS forms(form)""")

ORACLE["questions_normalized"] = with_(PASSAGES, select="""
SELECT query_ord, query_id, query_text, 't' || query_id AS table_id, dataset,
       CAST(to_json(CASE WHEN dataset = 'aitqa' THEN [query_text] ELSE [query_text, query_id] END) AS VARCHAR)
         AS ground_truth
FROM passages, (VALUES ('aitqa'), ('nqtables')) AS forms(dataset)""")

ORACLE["sample_questions"] = with_(PASSAGES, select="""
SELECT * FROM passages ORDER BY md5(query_id || '-230032298'), query_id LIMIT 15""")

ORACLE["tokenize"] = with_(
    f"""listed AS (SELECT CAST(doc_id AS VARCHAR) AS table_id, {content_words('text')} AS w FROM documents)""",
    select="SELECT table_id, len(w) AS num_words, array_to_string(w, ' ') AS words FROM listed",
)


# The lexical index

def stems(terms: str) -> str:
    """The stemming rules over a relation of terms, as a chain of projections."""
    over_0, over_1 = lit(stem.MEASURE_OVER_0), lit(stem.MEASURE_OVER_1)

    def cut(word, n):
        return f"left({word}, len({word}) - {n})"

    def rules(table, measure):
        cases = " ".join(
            f"WHEN ends_with(w, {lit(s)}) THEN CASE WHEN regexp_matches({cut('w', len(s))}, {measure}) "
            f"THEN {cut('w', len(s))} || {lit(r)} ELSE w END"
            for s, r in table
        )
        return f"CASE {cases} ELSE w END"

    plural = " ".join(f"WHEN ends_with(w, {lit(s)}) THEN {cut('w', len(s))} || {lit(r)}" for s, r in stem.PLURALS)
    removed = " ".join(
        f"WHEN ends_with(w, {lit(s)}) THEN CASE WHEN regexp_matches({cut('w', len(s))}, {over_1}) "
        + (f"AND regexp_matches({cut('w', len(s))}, '[st]$') " if s == "ion" else "")
        + f"THEN {cut('w', len(s))} ELSE w END"
        for s in stem.REMOVED
    )
    irregular = " ".join(f"WHEN {lit(a)} THEN {lit(b)}" for a, b in stem.IRREGULAR.items())
    is_1, short, vowel = lit(stem.MEASURE_IS_1), lit(stem.SHORT), lit(stem.HAS_VOWEL)
    return f"""
s0 AS (SELECT term, lower(term) AS w FROM {terms}),
s1 AS (SELECT term, CASE WHEN ends_with(w, 'ies') AND len(w) = 4 THEN {cut('w', 1)} {plural} ELSE w END AS w FROM s0),
s2 AS (SELECT term, w,
  CASE WHEN ends_with(w, 'ied') THEN CASE WHEN len(w) = 4 THEN {cut('w', 1)} ELSE {cut('w', 2)} END
       WHEN ends_with(w, 'eed') THEN CASE WHEN regexp_matches({cut('w', 3)}, {over_0}) THEN {cut('w', 1)} ELSE w END
  END AS settled FROM s1),
s3 AS (SELECT term, coalesce(settled, w) AS w, CASE WHEN settled IS NOT NULL THEN NULL
  WHEN ends_with(w, 'ed') AND regexp_matches({cut('w', 2)}, {vowel}) THEN {cut('w', 2)}
  WHEN ends_with(w, 'ing') AND regexp_matches({cut('w', 3)}, {vowel}) THEN {cut('w', 3)} END AS rest FROM s2),
s4 AS (SELECT term, CASE WHEN rest IS NULL THEN w
  WHEN regexp_matches(rest, '(at|bl|iz)$') THEN rest || 'e'
  WHEN len(rest) >= 2 AND right(rest, 1) = left(right(rest, 2), 1) AND NOT regexp_matches(rest, '[aeiouy]$')
    THEN CASE WHEN regexp_matches(rest, '[lsz]$') THEN rest ELSE {cut('rest', 1)} END
  WHEN regexp_matches(rest, {is_1}) AND regexp_matches(rest, {short}) THEN rest || 'e' ELSE rest END AS w FROM s3),
s5 AS (SELECT term, CASE WHEN regexp_matches(w, '[^aeiouy]y$|[aeiou]yy$') AND len(w) > 2
  THEN {cut('w', 1)} || 'i' ELSE w END AS w FROM s4),
s6 AS (SELECT term, CASE WHEN ends_with(w, 'alli') AND regexp_matches({cut('w', 4)}, {over_0})
  THEN {cut('w', 2)} ELSE w END AS w FROM s5),
s7 AS (SELECT term, CASE WHEN ends_with(w, 'logi')
  THEN CASE WHEN regexp_matches({cut('w', 3)}, {over_0}) THEN {cut('w', 1)} ELSE w END
  ELSE {rules(stem.DOUBLE_SUFFIXES, over_0)} END AS w FROM s6),
s8 AS (SELECT term, {rules(stem.ENDINGS, over_0)} AS w FROM s7),
s9 AS (SELECT term, CASE {removed} ELSE w END AS w FROM s8),
s10 AS (SELECT term, CASE WHEN ends_with(w, 'e') AND (regexp_matches({cut('w', 1)}, {over_1})
  OR (regexp_matches({cut('w', 1)}, {is_1}) AND NOT regexp_matches({cut('w', 1)}, {short})))
  THEN {cut('w', 1)} ELSE w END AS w FROM s9),
s11 AS (SELECT term, CASE WHEN ends_with(w, 'll') AND regexp_matches({cut('w', 1)}, {over_1})
  THEN {cut('w', 1)} ELSE w END AS w FROM s10),
vocabulary AS (SELECT term, CASE term {irregular} ELSE
  CASE WHEN len(term) <= 2 THEN lower(term) ELSE w END END AS normal FROM s11)"""


def index(fields=("content",), stemmed=False, asked="passages", corpus=CORPUS) -> list[str]:
    columns = {"content": "table_content", "name": "table_name"}
    listed = " UNION ALL ".join(
        f"SELECT '{f}' AS field, ord, table_id, {content_words(columns[f])} AS w FROM corpus" for f in fields
    )
    ctes = [
        corpus,
        f"listed AS ({listed})",
        "raw_words AS (SELECT field, ord, table_id, len(w) AS doc_len, unnest(w) AS term FROM listed)",
        f"raw_asked AS (SELECT query_id, unnest({content_words('query_text')}) AS term FROM {asked})",
    ]
    if stemmed:
        ctes += [
            "terms AS (SELECT term FROM raw_words UNION SELECT term FROM raw_asked)",
            stems("terms"),
            "all_words AS (SELECT field, ord, table_id, doc_len, normal AS term FROM raw_words JOIN vocabulary USING (term))",
            "asked_words AS (SELECT query_id, normal AS term FROM raw_asked JOIN vocabulary USING (term))",
        ]
    else:
        ctes += ["all_words AS (FROM raw_words)", "asked_words AS (FROM raw_asked)"]
    return ctes + [
        """postings AS (
  SELECT field, term, ord, table_id, count(*) AS tf, doc_len FROM all_words GROUP BY ALL)""",
        """field_sizes AS (
  SELECT field, count(*) AS num_docs, avg(len(w)) AS avg_len FROM listed GROUP BY field)""",
        """plain_idf AS (
  SELECT field, term, count(*) AS df,
         ln(any_value(num_docs) - count(*) + 0.5) - ln(count(*) + 0.5) AS idf
  FROM postings JOIN field_sizes USING (field) GROUP BY field, term)""",
        """field_stats AS (
  SELECT field, num_docs, avg_len, avg_idf
  FROM field_sizes JOIN (SELECT field, avg(idf) AS avg_idf FROM plain_idf GROUP BY field) USING (field))""",
        """term_stats AS (
  SELECT field, term, df, CASE WHEN idf < 0 THEN 0.01 * avg_idf ELSE idf END AS idf
  FROM plain_idf JOIN field_stats USING (field))""",
    ]


def bm25(k: int, fields=("content",), stemmed=False, asked="passages", corpus=CORPUS) -> list[str]:
    return index(fields, stemmed, asked, corpus) + [
        f"""scored AS (
  SELECT query_id, ord, sum(qtf * idf * tf * 1.9 / (tf + 0.9 * (0.6 + 0.4 * doc_len / avg_len))) / {len(fields)} AS score
  FROM (SELECT query_id, term, count(*) AS qtf FROM asked_words GROUP BY ALL)
  JOIN postings USING (term) JOIN term_stats USING (field, term) JOIN field_stats USING (field)
  GROUP BY query_id, ord)""",
        f"""every_pair AS (
  SELECT a.query_id, c.table_id, coalesce(s.score, 0.0) AS score,
         row_number() OVER (PARTITION BY a.query_id ORDER BY round(coalesce(s.score, 0.0), 9) DESC, c.ord) AS rank
  FROM {asked} a CROSS JOIN corpus c LEFT JOIN scored s ON s.query_id = a.query_id AND s.ord = c.ord)""",
        f"bm25_hits AS (SELECT query_id, table_id, rank, score FROM every_pair WHERE rank <= {k})",
    ]


def hits(k: int = 100) -> list[str]:
    return [PASSAGES, *bm25(k), "hits0 AS (SELECT query_id, table_id, rank, 1.0 / rank AS score FROM bm25_hits)"]


ORACLE["vocab_normalize"] = with_(
    CORPUS,
    f"""terms AS (SELECT unnest({content_words('table_content')}) AS term FROM corpus
  UNION SELECT unnest({content_words('table_name')}) FROM corpus)""",
    stems("terms"),
    select="SELECT term, normal FROM vocabulary",
)
ORACLE["lexical_postings"] = with_(
    PASSAGES, *index(("content", "name")), select="SELECT field, term, ord, tf, doc_len FROM postings"
)
ORACLE["lexical_postings_stemmed"] = with_(
    PASSAGES, *index(("content", "name"), stemmed=True),
    select="SELECT field, term, ord, tf, doc_len FROM postings",
)
ORACLE["bm25_stats"] = with_(PASSAGES, *index(("content", "name")), select=f"""
SELECT field, term, df, {six('idf', 'idf')}, num_docs, {six('avg_len', 'avg_len')}, {six('avg_idf', 'avg_idf')}
FROM term_stats JOIN field_stats USING (field)""")
HITS = f"SELECT query_id, table_id, rank, {six('score', 'score')} FROM "
ORACLE["bm25_topk"] = with_(PASSAGES, *bm25(100), select=HITS + "bm25_hits")
ORACLE["bm25_stemmed"] = with_(PASSAGES, *bm25(100, stemmed=True), select=HITS + "bm25_hits")
ORACLE["bm25_two_field"] = with_(
    PASSAGES,
    "named AS (SELECT query_ord, query_id, 'src' || (query_ord % 20) || ' ' || query_text AS query_text FROM passages)",
    *bm25(100, ("content", "name"), asked="named"),
    select=HITS + "bm25_hits",
)

# Vectors

VECTORS = """means AS (
  SELECT label, pos, avg(CAST(value AS DOUBLE)) AS value
  FROM (SELECT label, unnest(embedding) AS value, unnest(range(len(embedding))) AS pos FROM embeddings)
  GROUP BY label, pos),
asked AS (SELECT label, list(value ORDER BY pos) AS vector FROM means GROUP BY label),
pairs AS (
  SELECT 'label ' || q.label AS query_id, t.vec_id AS ord, q.label AS label, t.label AS table_label,
         list_dot_product(q.vector, CAST(t.embedding AS DOUBLE[]))
           / sqrt(list_dot_product(q.vector, q.vector))
           / sqrt(list_dot_product(CAST(t.embedding AS DOUBLE[]), CAST(t.embedding AS DOUBLE[]))) AS score
  FROM asked q CROSS JOIN embeddings t),
dense AS (
  SELECT query_id, CAST(ord AS VARCHAR) AS table_id, label, table_label, score,
         row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, ord) AS rank FROM pairs)"""
ORACLE["dense_topk"] = with_(VECTORS, select=HITS + "dense WHERE rank <= 100")


def accuracies(best: str) -> str:
    return ", ".join(
        f"round(avg(CASE WHEN {best} <= {k} THEN 1.0 ELSE 0.0 END), 5) AS accuracy_at_{k}" for k in K_VALUES
    )


ORACLE["dense_accuracy"] = with_(
    VECTORS,
    "firsts AS (SELECT query_id, min(rank) FILTER (label = table_label AND rank <= 100) AS first_rank FROM dense GROUP BY query_id)",
    select=f"SELECT count(*) AS num_questions, {accuracies('first_rank')} FROM firsts",
)

# crc32 bit by bit, over the bytes of a word.
CRC32 = """xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(range(1, 2 * octet_length(encode(term)) + 1, 2), lambda i: ('0x' || hex(encode(term))[i : i + 1])::BIGINT)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))))"""
ORACLE["distinct_embed"] = with_(
    "texts AS (SELECT DISTINCT text FROM documents)",
    f"spoken AS (SELECT text, unnest({words('lower(text)')}) AS term FROM texts)",
    f"places AS (SELECT term, {CRC32} % 16 AS place FROM (SELECT DISTINCT term FROM spoken))",
    "counted AS (SELECT text, place, count(*) AS n FROM spoken JOIN places USING (term) GROUP BY text, place)",
    """rare AS (SELECT place, ln((1.0 + (SELECT count(*) FROM documents)) / (1 + count(*))) AS weight
  FROM counted JOIN documents USING (text) GROUP BY place)""",
    """grid AS (SELECT text, g.place, coalesce(n * weight, 0) AS value
  FROM texts CROSS JOIN (SELECT unnest(range(16)) AS place) g LEFT JOIN counted USING (text, place) LEFT JOIN rare USING (place))""",
    "lengths AS (SELECT text, sqrt(sum(value * value)) AS length FROM grid GROUP BY text)",
    select="""
SELECT md5(text) AS digest, string_agg(printf('%.5f', round(CASE WHEN length > 0 THEN (value / length)::FLOAT::DOUBLE ELSE 0 END, 5)), ' ' ORDER BY place) AS vector
FROM grid JOIN lengths USING (text) GROUP BY text""",
)

# Ranking stages

ORACLE["oracle_retrieve"] = with_(PASSAGES, CORPUS, GOLD, select="""
SELECT query_id, table_id, CAST(1 AS BIGINT) AS rank, CAST(1.0 AS DOUBLE) AS score FROM asked_gold""")
ORACLE["reciprocal_rank"] = with_(*hits(), select=HITS + "hits0")


def selection(source: str, focus: int, name: str) -> str:
    return f"""{name} AS (
  SELECT query_id, CASE WHEN CAST(query_id[2:] AS INT) % 7 = 0 THEN [] ELSE
    list(table_id) FILTER (CAST(table_id AS BIGINT) % 3 = 0) END AS selected
  FROM {source} WHERE rank <= {focus} GROUP BY query_id)"""


def zoomed(source: str, focus: int, number: int) -> list[str]:
    return [
        selection(source, focus, f"picked{number}"),
        f"""hits{number} AS (
  SELECT query_id, table_id, row_number() OVER (PARTITION BY query_id ORDER BY
      rank > {focus}, NOT (rank <= {focus} AND coalesce(list_contains(selected, table_id), false)), rank) AS rank, score
  FROM {source} JOIN picked{number} USING (query_id))""",
    ]


ORACLE["zoom_stage"] = with_(*hits(), *zoomed("hits0", 100, 1), select=HITS + "hits1")
TWO_STAGES = [*zoomed("hits0", 100, 1), *zoomed("hits1", 10, 2)]
ORACLE["zoom_two_stage"] = with_(*hits(), *TWO_STAGES, select=f"""
SELECT query_id, table_id, rank, {six('1.0 / rank', 'score')} FROM hits2""")
ORACLE["zoom_selection_sizes"] = with_(*hits(), selection("hits0", 100, "picked"), select="""
SELECT query_id, len(coalesce(selected, [])) AS num_selected FROM picked""")


def request(system: str, user: str, max_tokens: int) -> str:
    return f"""CAST(to_json({{'model': {lit(MODEL)}, 'messages': [
    {{'role': 'system', 'content': {lit(system)}}}, {{'role': 'user', 'content': {user}}}],
    'temperature': CAST(0.0 AS DOUBLE), 'max_tokens': {max_tokens}, 'seed': {T.MODEL_SEED}}}) AS VARCHAR)"""


def filled(template: str, **values: str) -> str:
    """Split at the variables and join with the values."""
    parts, rest = [], template
    while "{{" in rest:
        before, _, after = rest.partition("{{")
        name, _, rest = after.partition("}}")
        parts += [lit(before), values[name]]
    return " || ".join([*parts, lit(rest)])


ORACLE["zoom_requests"] = with_(
    *hits(),
    """blocks AS (
  SELECT query_id, string_agg('table_id: ' || table_id || chr(10) || chr(10) || table_content,
                              chr(10) || chr(10) || chr(10) ORDER BY rank) AS tables
  FROM hits0 JOIN corpus USING (table_id) WHERE rank <= 10 GROUP BY query_id)""",
    select=f"""
SELECT query_id, {request(T.ZOOM_SYSTEM, filled(T.ZOOM_PROMPT, next_focus_size=lit("3 tables (each shown with its first 5 rows)"), query='query_text', tables='tables'), T.ZOOM_TOKENS)} AS request
FROM passages JOIN blocks USING (query_id)""",
)
ORACLE["rerank_requests"] = with_(*hits(), select=f"""
SELECT table_id, {request(T.QUESTIONS_SYSTEM, filled(T.QUESTIONS_PROMPT['aitqa'], airline_name='table_name', table_id='table_id', table='table_content'), T.QUESTIONS_TOKENS)} AS request
FROM corpus WHERE table_id IN (SELECT table_id FROM hits0 WHERE rank <= 10)""")


TEXT_LINES = "list_filter(string_split(table_content, chr(10)), lambda l: l <> '')"
HAS_REPLY = f"ord % 5 <> 0 AND ord % 7 <> 0 AND len({TEXT_LINES}) > 0"


def generated(source: str, questions: str = TEXT_LINES, replied: str = HAS_REPLY) -> str:
    return f"""generated AS (
  SELECT query_id, table_id, {questions} AS questions
  FROM {source} JOIN corpus USING (table_id) WHERE rank <= 10 AND {replied})"""


ORACLE["parse_questions"] = with_(*hits(), generated("hits0"), select="""
SELECT query_id, table_id, CAST(to_json(questions) AS VARCHAR) AS questions FROM generated""")

LETTERS = "aeinorst"


def letters(text: str) -> str:
    return "[" + ", ".join(f"CAST(len({text}) - len(replace({text}, '{c}', '')) AS DOUBLE)" for c in LETTERS) + "]"


def similarity(source: str, asked: str = "passages", **replies: str) -> list[str]:
    return [
        generated(source, **replies),
        f"""compared AS (
  SELECT query_id, table_id, query_text, unnest(questions) AS text
  FROM generated JOIN {asked} USING (query_id))""",
        f"""vectors AS (
  SELECT query_id, table_id, {letters('query_text')} AS a, {letters('text')} AS b FROM compared)""",
        """similarities AS (
  SELECT query_id, table_id, max(CASE WHEN list_dot_product(a, a) > 0 AND list_dot_product(b, b) > 0
    THEN list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))) ELSE 0.0 END) AS score
  FROM vectors GROUP BY query_id, table_id)""",
    ]


def merged(source: str, **options: str) -> list[str]:
    return similarity(source, **options) + [
        f"""joined AS (
  SELECT h.query_id, h.table_id, h.rank, h.score AS old, s.score AS new
  FROM {source} h LEFT JOIN similarities s ON h.query_id = s.query_id AND h.table_id = s.table_id AND h.rank <= 10)""",
        """bounds AS (
  SELECT *, min(new) OVER q AS lowest, max(CASE WHEN new IS NULL THEN old END) OVER q AS highest
  FROM joined WINDOW q AS (PARTITION BY query_id))""",
        """rescored AS (
  SELECT query_id, table_id, rank, CASE WHEN lowest IS NULL THEN old
    ELSE coalesce(new, old * (lowest - 0.01) / highest) END AS score,
    CASE WHEN lowest IS NULL OR new IS NOT NULL THEN 0 WHEN rank <= 10 THEN 1 ELSE 2 END AS grp,
    lowest IS NULL AS unchanged FROM bounds)""",
        """reranked AS (
  SELECT query_id, table_id, score, row_number() OVER (PARTITION BY query_id
    ORDER BY CASE WHEN unchanged THEN 0.0 ELSE round(score, 9) END DESC, grp, rank) AS rank FROM rescored)""",
    ]


ORACLE["rerank_scores"] = with_(*hits(), *similarity("hits0"), select=f"""
SELECT query_id, table_id, {six('score', 'score')} FROM similarities""")
ORACLE["rerank_merge"] = with_(*hits(), *merged("hits0"), select=HITS + "reranked")
ORACLE["run_dedupe"] = with_(
    *hits(),
    """renamed AS (
  SELECT CAST(query_id[2:] AS BIGINT) AS query_ord, 'q' || (CAST(query_id[2:] AS BIGINT) // 2) AS query_id,
         CAST(CAST(table_id AS BIGINT) // 3 AS VARCHAR) AS table_id, rank, score FROM hits0)""",
    """kept AS (SELECT * FROM renamed QUALIFY query_ord = max(query_ord) OVER (PARTITION BY query_id))""",
    """once AS (SELECT query_id, table_id, arg_max(score, rank) AS score, min(rank) AS first_rank FROM kept GROUP BY ALL)""",
    select=f"""
SELECT query_id, table_id, {six('score', 'score')},
  row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, first_rank) AS rank FROM once""",
)

# Prompts and answers

ORACLE["template_fill"] = with_(CORPUS, select=f"""
SELECT table_id, {filled(T.QUESTIONS_PROMPT['aitqa'], airline_name='table_name', table_id="'{{table}}' || table_id", table='table_content')} AS prompt
FROM corpus""")
ORACLE["answer_prompt"] = with_(PASSAGES, select=" UNION ALL ".join(
    f"SELECT query_id, '{t}' AS template, '{d}' AS dataset, '{m}' AS mode, "
    + filled(T.answer_template(t, d, m), query="query_text", context="'Table 1: ' || query_id")
    + " AS prompt FROM passages"
    for t in T.TEMPLATES for d in ("aitqa", "nqtables") for m in T.MODES
))


def context(prefix: str = "", name: str = "contexts") -> str:
    return f"""{name} AS (
  SELECT query_id, string_agg({prefix}'Table ' || rank || ': ' || table_content, chr(10) ORDER BY rank) AS context
  FROM hits0 JOIN corpus USING (table_id) JOIN passages USING (query_id) WHERE rank <= 3 GROUP BY query_id)"""


ORACLE["context_assemble"] = with_(*hits(), context(), select="SELECT query_id, context FROM contexts")
ORACLE["context_assemble_repeated"] = with_(
    *hits(), context("'Query: ' || query_text || ' ' || "), select="SELECT query_id, context FROM contexts"
)
ORACLE["context_oracle"] = with_(PASSAGES, CORPUS, GOLD, select="""
SELECT query_id, 'Query: ' || query_text || ' Ground truth table : ' || table_content AS context
FROM asked_gold JOIN corpus USING (table_id)""")
ORACLE["context_budget"] = with_(
    *hits(),
    context(),
    f"""sized AS (
  SELECT query_id, context, {tokens('context')} AS context_tokens,
    greatest({1000 - T.ANSWER_TOKENS - T.BUFFER_TOKENS} - {tokens(lit(T.answer_template('QTTT', 'aitqa', 'open-book')))} - {tokens('query_text')}, 0) AS available_tokens
  FROM contexts JOIN passages USING (query_id))""",
    select=f"""
SELECT query_id, available_tokens, context_tokens, context_tokens > available_tokens AS was_cut,
  {first_tokens('context', 'available_tokens')} AS context FROM sized""",
)
ORACLE["parse_answer"] = with_(
    """said AS (
  SELECT event_id, CASE event_id % 8
    WHEN 0 THEN '{"answer": "' || event_type || '"}'
    WHEN 1 THEN '```json' || chr(10) || '{"answer": "' || event_type || '"}' || chr(10) || '```'
    WHEN 2 THEN replace(props, '"k"', '"answer"') WHEN 3 THEN props
    WHEN 4 THEN '{"answer": ' || event_type
    WHEN 5 THEN ' ' || chr(10) || '{"answer": "' || event_type || '"}' || chr(10) || ' '
    WHEN 6 THEN '{"answer": null}' ELSE event_type END AS content FROM events)""",
    r"""bare AS (SELECT event_id, trim(regexp_replace(regexp_replace(content, '^```json', ''), '```$', ''), ' ' || chr(10)) AS content FROM said)""",
    select="""
SELECT event_id, coalesce(CASE WHEN json_valid(content) THEN json_extract_string(content, '$.answer') END, '') AS answer
FROM bare""",
)
ORACLE["answers_closed"] = with_(PASSAGES, select=f"""
SELECT query_id, {request(T.ANSWER_SYSTEM, filled(T.CLOSED_BOOK['nqtables'], query='query_text'), T.ANSWER_TOKENS)} AS request,
  '' AS prediction FROM passages""")

# Requests, responses and money

TURNS = f"""turns AS (
  SELECT conv_id || '-' || turn AS request_id, conv_id, role, text,
    {request('Answer with one word.', 'text', 70)} AS request FROM conversations),
requests AS (SELECT *, sha256('openai-' || request) AS request_hash FROM turns),
responses AS (
  SELECT request_hash, arg_min(request_id, request_id) AS first_id, arg_min(role, request_id) AS first_role,
    arg_min(conv_id, request_id) AS first_conv, arg_min({tokens('text')}, request_id) AS words
  FROM requests WHERE role <> 'assistant' GROUP BY request_hash)"""
ORACLE["cache_lookup"] = with_(TURNS, select="""
SELECT request_id, request_hash, first_id IS NOT NULL AS is_known,
  CASE WHEN first_role <> 'system' THEN 're: ' || first_id END AS content
FROM requests LEFT JOIN responses USING (request_hash)""")
ORACLE["cache_misses"] = with_(TURNS, select="""
SELECT DISTINCT request_hash, request FROM requests
WHERE request_hash NOT IN (SELECT request_hash FROM responses)""")
ORACLE["complete_requests"] = with_(TURNS, select="""
SELECT request_id, CAST(len(text) AS VARCHAR) AS content FROM requests""")
SYSTEM_TOKENS = tokens(lit("Answer with one word."))
ORACLE["request_tokens"] = with_(TURNS, select=f"""
SELECT request_id, {SYSTEM_TOKENS} + {tokens('text')} + 20 AS input_tokens FROM requests""")


def price_list(mode: str) -> str:
    rows = ", ".join(f"({lit(m)}, {i}, {c}, {o})" for m, x, i, c, o, _, _ in PRICES if x == mode)
    return f"""prices AS (SELECT model, CAST(i AS DOUBLE) AS i, CAST(c AS DOUBLE) AS c, CAST(o AS DOUBLE) AS o
  FROM (VALUES {rows}) AS p(model, i, c, o))"""


def priced(cached: str) -> str:
    return f"""answered AS (
  SELECT request_id, CAST(conv_id % 3 AS VARCHAR) AS run_id, words,
    CASE WHEN first_conv % 2 = 0 THEN {lit(MODEL)} ELSE {lit(OTHER_MODEL)} END AS model
  FROM requests JOIN responses USING (request_hash) WHERE first_role <> 'system'),
costs AS (
  SELECT request_id, run_id, model, ({cached} * c + (3 * words - {cached}) * i + words * o) / 1000000 AS cost
  FROM answered JOIN prices USING (model))"""


ONE_COST = "SELECT request_id, model, round(cost, 9) AS cost FROM costs"
ORACLE["response_cost"] = with_(TURNS, price_list("default"), priced("words"), select=ONE_COST)
ORACLE["response_cost_batch"] = with_(TURNS, price_list("batch"), priced("0"), select=ONE_COST)
ORACLE["cost_per_query"] = with_(TURNS, price_list("default"), priced("0"), select="""
SELECT run_id, round(coalesce(total, 0.0), 9) AS total_cost, num_questions,
  round(coalesce(total, 0.0) / num_questions, 9) AS cost_per_question
FROM (SELECT CAST(conv_id % 3 AS VARCHAR) AS run_id, count(*) AS num_questions FROM requests GROUP BY 1)
LEFT JOIN (SELECT run_id, sum(cost) AS total FROM costs GROUP BY 1) USING (run_id)""")
ORACLE["cost_estimate"] = with_(TURNS, price_list("default"), select=f"""
SELECT request_hash, input_tokens, CAST(70 AS BIGINT) AS output_limit, input_tokens + 70 AS max_usage,
  round(input_tokens * i / 1000000 + 70 * o / 1000000, 9) AS max_cost
FROM (SELECT DISTINCT request_hash, {SYSTEM_TOKENS} + {tokens('text')} + 20 AS input_tokens FROM requests
      WHERE request_hash NOT IN (SELECT request_hash FROM responses)), prices WHERE model = {lit(MODEL)}""")

# Scores

ORACLE["topk_accuracy"] = with_(
    *hits(), GOLD, *zoomed("hits0", 100, 1),
    """runs AS (SELECT 'retrieved' AS run_id, query_id, table_id, rank FROM hits0
  UNION ALL SELECT 'zoomed', query_id, table_id, rank FROM hits1)""",
    """firsts AS (
  SELECT n.run_id, g.query_id, min(r.rank) AS first_rank
  FROM gold g CROSS JOIN (VALUES ('retrieved'), ('zoomed')) AS n(run_id)
  LEFT JOIN runs r ON r.run_id = n.run_id AND r.query_id = g.query_id AND r.table_id = g.table_id GROUP BY 1, 2)""",
    select=f"SELECT run_id, count(*) AS num_questions, {accuracies('first_rank')} FROM firsts GROUP BY run_id",
)


def translated(text: str, dropped: str) -> str:
    return f"translate({text}, {lit(dropped)}, '')"


def answer_form(text: str) -> str:
    bare = f"string_split_regex({translated(f'lower({text})', PUNCTUATION)}, '\\s+')"
    return f"array_to_string(list_filter({bare}, lambda w: w NOT IN ('', 'a', 'an', 'the')), ' ')"


def relaxed(text: str) -> str:
    return f"lower({translated(text, PUNCTUATION_BUT_COMMA_AND_PERIOD)})"


ORACLE["answer_normalize"] = with_(CORPUS, select=f"""
SELECT table_id, {answer_form('table_content')} AS answer FROM corpus""")
ANSWERS = f"""answers AS (
  SELECT CAST(doc_id AS VARCHAR) AS query_id, lang AS run_id, [text, source] AS ground_truth,
    CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN 'The ' || lower(text) || '!'
      WHEN 2 THEN replace(text, ',', ' ;') || ' and one more' ELSE lang || ' ' || source END AS prediction
  FROM documents)"""
SCORED = [
    ANSWERS,
    f"""forms AS (
  SELECT query_id, run_id, 0 AS n, {answer_form('prediction')} AS form FROM answers
  UNION ALL SELECT query_id, run_id, 1, {answer_form('ground_truth[1]')} FROM answers
  UNION ALL SELECT query_id, run_id, 2, {answer_form('ground_truth[2]')} FROM answers)""",
    """spelled AS (
  SELECT query_id, n, unnest(string_split(form, ' ')) AS token FROM forms WHERE form <> '')""",
    """counted AS (SELECT query_id, n, token, count(*) AS c FROM spelled GROUP BY ALL)""",
    """sizes AS (SELECT query_id, n, sum(c) AS c FROM counted GROUP BY ALL)""",
    """shared AS (
  SELECT t.query_id, t.n, sum(least(p.c, t.c)) AS c FROM counted t JOIN counted p
  ON p.query_id = t.query_id AND p.token = t.token AND p.n = 0 WHERE t.n > 0 GROUP BY ALL)""",
    """f1 AS (
  SELECT s.query_id, max(2.0 * s.c / (t.c + p.c)) AS f1 FROM shared s
  JOIN sizes t ON t.query_id = s.query_id AND t.n = s.n
  JOIN sizes p ON p.query_id = s.query_id AND p.n = 0 GROUP BY s.query_id)""",
    """exact AS (
  SELECT t.query_id, max(CASE WHEN t.form = p.form THEN 1.0 ELSE 0.0 END) AS exact FROM forms t
  JOIN forms p ON p.query_id = t.query_id AND p.n = 0 WHERE t.n > 0 GROUP BY t.query_id)""",
    f"""scores AS (
  SELECT query_id, run_id, CAST(exact AS DOUBLE) AS exact_match, CAST(coalesce(f1, 0.0) AS DOUBLE) AS f1_score,
    CASE WHEN contains({relaxed('prediction')}, {relaxed('ground_truth[1]')}) THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS relaxed_match
  FROM answers JOIN exact USING (query_id) LEFT JOIN f1 USING (query_id))""",
]
ORACLE["answer_scores"] = with_(*SCORED, select=f"""
SELECT query_id, exact_match, {six('f1_score', 'f1_score')}, relaxed_match FROM scores""")
ORACLE["answer_metrics"] = with_(*SCORED, select=f"""
SELECT run_id, count(*) AS num_questions, {six('avg(exact_match)', 'exact_match')},
  {six('avg(f1_score)', 'f1_score')}, {six('avg(relaxed_match)', 'relaxed_match')} FROM scores GROUP BY run_id""")
ORACLE["relaxed_match"] = with_(ANSWERS, select=f"""
SELECT query_id, contains({relaxed('prediction')}, {relaxed('ground_truth[1]')}) AS found FROM answers""")
ORACLE["split_easy_hard"] = """
WITH said AS (
  SELECT lang AS partition, source AS id, ['"' || source || '"', lang] AS answers, doc_id,
    CASE WHEN n_chars % 2 = 0 THEN text || ' "' || upper(source) || '"' || lang ELSE text END AS prediction
  FROM documents)
SELECT s.partition, s.id, CAST(to_json(s.answers) AS VARCHAR) AS answers, f.doc_id AS source_question,
  CASE WHEN contains(lower(prediction), lower(s.answers[1])) AND contains(lower(prediction), lower(s.answers[2]))
    THEN 'easy' ELSE 'hard' END AS difficulty,
  count(*) AS num_questions
FROM said s JOIN (SELECT partition, id, answers, min(doc_id) AS doc_id FROM said GROUP BY ALL) f
  ON f.partition = s.partition AND f.id = s.id AND f.answers = s.answers
GROUP BY ALL"""

# Runs and reports

OUTCOMES = f"""parts AS (
  SELECT *, CASE o_orderstatus WHEN 'F' THEN 'tqa' WHEN 'O' THEN 'retrieval' ELSE 'zoom' END AS exp,
    CASE WHEN o_orderpriority[1] < '3' THEN 'BM25Retriever' ELSE 'SBERTRetriever' END AS retriever,
    CASE WHEN o_custkey % 3 = 0 THEN 'RowBasedZoom' ELSE 'NoZoom' END AS zoom,
    CASE WHEN o_custkey % 2 = 0 THEN {lit(MODEL)} ELSE {lit(OTHER_MODEL)} END AS model,
    CASE WHEN o_orderpriority[1] = '1' THEN 100 ELSE 3 END AS num_context FROM orders),
outcomes AS (
  SELECT *, 'exp=' || exp || ' retriever=lib.retrieval.' || retriever || ' reranker=lib.reranking.NoReranker zoom=lib.zoom.'
    || zoom || ' generator=lib.generation.LLMGenerator model=' || model || ' num_context=' || num_context
    || ' linearization=Linearization.CSV template=Template.QTTT' AS config_name FROM parts),
runs AS (
  SELECT md5(config_name) AS run_id, config_name, exp, retriever, 'NoReranker' AS reranker, zoom, model, num_context,
    count(*) AS processed_queries_ctr, count(*) FILTER (o_totalprice > 400000) AS cutoff_context_ctr,
    {", ".join(f"avg(CASE WHEN CAST(floor(o_totalprice) AS BIGINT) % 120 < {k} THEN 1.0 ELSE 0.0 END) AS accuracy_at_{k}" for k in K_VALUES)},
    avg(CASE WHEN CAST(floor(o_totalprice * 100) AS BIGINT) % 7 > 3 THEN 1.0 ELSE 0.0 END) AS exact_match,
    avg(CASE WHEN CAST(floor(o_totalprice * 100) AS BIGINT) % 7 > 1 THEN 1.0 ELSE 0.0 END) AS relaxed_match,
    avg((CAST(floor(o_totalprice * 100) AS BIGINT) % 7) / 7) AS f1_score,
    sum(o_totalprice / 1e9) / count(*) AS total_llm_cost
  FROM outcomes GROUP BY ALL)"""
ORACLE["run_components"] = with_(OUTCOMES, select=" UNION ALL ".join(
    f"SELECT run_id, '{name}' AS component, {value} AS value FROM runs"
    for name, value in {
        "exp": "exp", "retriever": "retriever", "reranker": "reranker", "zoom": "zoom",
        "generator": "'LLMGenerator'", "model": "model", "num_context": "CAST(num_context AS VARCHAR)",
        "linearization": "'Linearization.CSV'", "template": "'Template.QTTT'",
    }.items()
))
ORACLE["run_counters"] = with_(OUTCOMES, select="""
SELECT run_id, cutoff_context_ctr, processed_queries_ctr FROM runs""")
ORACLE["run_record"] = with_(OUTCOMES, select=f"""
SELECT run_id, config_name, cutoff_context_ctr, processed_queries_ctr,
  {", ".join(six(f"accuracy_at_{k}", f"accuracy_at_{k}") for k in K_VALUES)},
  {", ".join(six(m, m) for m in ("exact_match", "relaxed_match", "f1_score", "total_llm_cost"))}
FROM runs""")


def two(expression: str, name: str) -> str:
    return f'round({expression}, 2) AS "{name}"'


FLAT = ", ".join(
    [two(f"accuracy_at_{a.split('@')[1]}", a) for a in ACCURACIES] + [two("total_llm_cost * 100", COST)]
)
ORACLE["report_flat"] = with_(OUTCOMES, select=f"""
SELECT retriever, reranker, zoom, 'Linearization.CSV' AS linearization, 'Template.QTTT' AS template, {FLAT}
FROM runs WHERE exp = 'retrieval'""")
ORACLE["report_zoom"] = with_(OUTCOMES, select=f"""
SELECT 'Template.QTTT' AS template,
  CASE WHEN zoom = 'RowBasedZoom' THEN '-1rows-> 10 -5rows-> 3' ELSE '' END AS next_focus_sizes, {FLAT}
FROM runs WHERE exp = 'zoom'""")
ORACLE["report_pivot"] = with_(OUTCOMES, select=f"""
SELECT retriever, reranker, zoom, CAST(num_context AS INT) AS num_context, {", ".join(
    f'max({value}) FILTER (model = {lit(m)}) AS "{metric}|{m}"'
    for metric, value in (("exact_match", "round(exact_match, 2)"), (COST, "round(total_llm_cost * 100, 2)"))
    for m in MODELS
)}
FROM runs WHERE exp = 'tqa' GROUP BY ALL""")

# Whole runs

ORACLE["ranked_accuracy"] = with_(
    *hits(), GOLD, *TWO_STAGES,
    "stage2 AS (SELECT query_id, table_id, rank, 1.0 / rank AS score FROM hits2)",
    *merged("stage2"),
    """firsts AS (
  SELECT query_id, min(rank) AS first_rank FROM gold LEFT JOIN reranked USING (query_id, table_id) GROUP BY query_id)""",
    select=f"SELECT count(*) AS num_questions, {accuracies('first_rank')} FROM firsts",
)

LINES = f"""corpus AS (
  SELECT doc_id AS ord, CAST(doc_id AS VARCHAR) AS table_id, source AS table_name, text,
    {csv_line('[CAST(doc_id AS VARCHAR), source]')} || {csv_line("['line']")} ||
    array_to_string(list_transform(string_split(text, chr(10)), lambda l: {csv_line('[l]')}), '') AS table_content
  FROM documents)"""


def picked(source: str, focus: int, name: str) -> str:
    return f"""{name} AS (
  SELECT query_id, table_id, row_number() OVER (PARTITION BY query_id ORDER BY
    rank > {focus}, NOT (rank <= {focus} AND CAST(table_id AS BIGINT) % 3 = 0), rank) AS rank FROM {source})"""


ASKED = """asked AS (
  SELECT 'q' || item_id AS query_id, b.text AS query_text, CAST(min(doc_id) AS VARCHAR) AS gold
  FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY ALL)"""
ORACLE["answered_run"] = with_(
    ASKED,
    *bm25(100, stemmed=True, asked="asked", corpus=LINES),
    picked("bm25_hits", 100, "picked1"),
    picked("picked1", 10, "picked2"),
    """answered AS (
  SELECT query_id, any_value(query_text) AS query_text, any_value(gold) AS gold, arg_min(table_id, rank) AS first_id,
    string_agg('Table ' || rank || ': ' || table_content, chr(10) ORDER BY rank) AS context
  FROM picked2 JOIN corpus USING (table_id) JOIN asked USING (query_id) WHERE rank <= 3 GROUP BY query_id)""",
    select=f"""
SELECT query_id, 'Table ' || first_id AS prediction,
  {tokens('context')} > {128000 - T.ANSWER_TOKENS - T.BUFFER_TOKENS} - {tokens(lit(T.answer_template('QTTT', 'nqtables', 'open-book')))} - {tokens('query_text')} AS was_cut,
  CASE WHEN first_id = gold THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS exact_match,
  CASE WHEN first_id = gold THEN CAST(1 AS DOUBLE) WHEN gold IS NULL THEN CAST(0 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS f1_score,
  CASE WHEN contains(first_id, gold) THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS relaxed_match
FROM answered""",
)

ORACLE["dense_passages"] = with_(
    PASSAGES,
    LINES,
    f"asked AS (SELECT query_id, {letters('query_text')} AS a FROM passages)",
    f"lake AS (SELECT ord, table_id, {letters('table_content')} AS b FROM corpus)",
    """pairs AS (
  SELECT query_id, ord, table_id, CASE WHEN list_dot_product(a, a) > 0 AND list_dot_product(b, b) > 0
    THEN list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))) ELSE 0.0 END AS score
  FROM asked CROSS JOIN lake)""",
    """best AS (
  SELECT query_id, table_id, score,
    row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, ord) AS rank FROM pairs)""",
    select=HITS + "best WHERE rank <= 100",
)

NUMBERED = LINES.replace("CAST(doc_id AS VARCHAR)", "CAST(doc_id % 100 AS VARCHAR)")
ORACLE["repeated_ids_run"] = with_(
    """asked AS (
  SELECT item_id AS query_ord, CAST(item_id AS VARCHAR) AS query_id, 'q' || item_id % 7 AS shown_id,
    CASE item_id WHEN 0 THEN 'the' WHEN 1 THEN 'to the' ELSE text END AS query_text FROM benchmark)""",
    *bm25(100, stemmed=True, asked="asked", corpus=NUMBERED),
    "shown AS (SELECT table_id, arg_max(table_content, ord) AS table_content FROM corpus GROUP BY table_id)",
    """answered AS (
  SELECT query_id, arg_min(table_id, rank) AS first_id,
    string_agg('Table ' || rank || ': ' || table_content, chr(10) ORDER BY rank) AS context
  FROM bm25_hits JOIN shown USING (table_id) WHERE rank <= 3 GROUP BY query_id)""",
    select=f"""
SELECT query_ord, shown_id AS query_id, 'Table ' || first_id AS prediction,
  {tokens('context')} > {128000 - T.ANSWER_TOKENS - T.BUFFER_TOKENS} - {tokens(lit(T.answer_template('QTTT', 'nqtables', 'open-book')))} - {tokens('query_text')} AS was_cut
FROM answered JOIN asked USING (query_id)""",
)

WHOLE_RUN = [
    ASKED,
    *bm25(100, stemmed=True, asked="asked", corpus=LINES),
    picked("bm25_hits", 100, "picked1"),
    picked("picked1", 10, "picked2"),
    "zoomed AS (SELECT query_id, table_id, rank, 1.0 / rank AS score FROM picked2)",
    *merged("zoomed", asked="asked", questions="string_split(text, chr(10))", replied="ord % 7 <> 0"),
]
ORACLE["pipeline_retrieval"] = with_(*WHOLE_RUN, select=f"""
SELECT query_id, table_id, rank, {six('1.0 / rank', 'score')} FROM reranked""")
ORACLE["pipeline_answers"] = with_(
    *WHOLE_RUN,
    """named AS (
  SELECT query_id, count(*) FILTER (focus = 100) AS shown1, count(*) FILTER (focus = 10) AS shown2,
    count(*) FILTER (focus = 100 AND chosen) AS named1, count(*) FILTER (focus = 10 AND chosen) AS named2
  FROM (SELECT query_id, 100 AS focus, CAST(table_id AS BIGINT) % 3 = 0 AS chosen FROM bm25_hits WHERE rank <= 100
    UNION ALL SELECT query_id, 10, CAST(table_id AS BIGINT) % 3 = 0 FROM picked1 WHERE rank <= 10) GROUP BY query_id)""",
    "heads AS (SELECT DISTINCT CAST(table_id AS BIGINT) % 7 = 0 AS failed, table_id FROM zoomed WHERE rank <= 10)",
    """answered AS (
  SELECT query_id, any_value(query_text) AS query_text, any_value(gold) AS gold, arg_min(table_id, rank) AS first_id,
    string_agg('Table ' || rank || ': ' || table_content, chr(10) ORDER BY rank) AS context
  FROM reranked JOIN corpus USING (table_id) JOIN asked USING (query_id) WHERE rank <= 3 GROUP BY query_id)""",
    f"""sums AS (SELECT
  (SELECT count(*) FROM answered) AS processed_queries_ctr,
  (SELECT count(*) FROM answered WHERE
    {tokens('context')} > {128000 - T.ANSWER_TOKENS - T.BUFFER_TOKENS} - {tokens(lit(T.answer_template('QTTT', 'nqtables', 'open-book')))} - {tokens('query_text')}) AS cutoff_context_ctr,
  (SELECT count(*) FILTER (named1 <> 10) + count(*) FILTER (named2 <> 3) FROM named) AS off_size_ctr,
  (SELECT count(*) FROM heads WHERE failed) AS failed_replies_ctr,
  (SELECT sum(shown1 + shown2) FROM named) + 1000 * (SELECT count(*) FROM heads WHERE NOT failed)
    + 3 * (SELECT count(*) FROM answered) AS prompt_tokens,
  (SELECT sum(named1 + named2) FROM named) + 10 * (SELECT count(*) FROM heads WHERE NOT failed)
    + (SELECT count(*) FROM answered) AS completion_tokens)""",
    "firsts AS (SELECT query_id, min(rank) AS first_rank FROM asked LEFT JOIN reranked r USING (query_id) WHERE gold IS NOT NULL AND r.table_id = gold GROUP BY query_id)",
    "judged AS (SELECT query_id, first_rank FROM asked LEFT JOIN firsts USING (query_id) WHERE gold IS NOT NULL)",
    f"accuracy AS (SELECT {accuracies('first_rank')} FROM judged)",
    """scores AS (
  SELECT avg(CASE WHEN first_id = gold THEN 1.0 ELSE 0.0 END) AS exact_match,
    avg(CASE WHEN first_id = gold THEN 1.0 WHEN gold IS NULL THEN 0.0 ELSE 0.5 END) AS f1_score,
    avg(CASE WHEN contains(first_id, gold) THEN 1.0 ELSE 0.0 END) AS relaxed_match FROM answered)""",
    select=f"""
SELECT 'exp=whole model={MODEL}' AS config_name, CAST(processed_queries_ctr AS BIGINT) AS processed_queries_ctr,
  CAST(cutoff_context_ctr AS BIGINT) AS cutoff_context_ctr, CAST(off_size_ctr AS BIGINT) AS off_size_ctr,
  CAST(failed_replies_ctr AS BIGINT) AS failed_replies_ctr, CAST(prompt_tokens AS BIGINT) AS prompt_tokens,
  CAST(completion_tokens AS BIGINT) AS completion_tokens,
  {", ".join(f"accuracy_at_{k}" for k in K_VALUES)},
  {", ".join(six(m, m) for m in ("exact_match", "relaxed_match", "f1_score"))},
  round((prompt_tokens * 0.15 + completion_tokens * 0.60) / 1e6 / processed_queries_ctr, 9) AS total_llm_cost
FROM sums, accuracy, scores""",
)

ORACLE["fetched_tables"] = with_(
    *hits(), select="""
SELECT table_id, md5(table_content) AS digest FROM corpus WHERE table_id IN (SELECT table_id FROM hits0 WHERE rank <= 3)"""
)

ORACLE["stored_index_topk"] = with_(
    PASSAGES, *bm25(100, ("content", "name"), stemmed=True), select=HITS + "bm25_hits"
)
ORACLE["bucketed_lookup"] = ORACLE["cache_lookup"]


def likeness(key: str, nation: str, balance: str) -> str:
    return f"[{nation} + 1.0::DOUBLE, CAST({balance} AS DOUBLE) / 1000, CAST({key} % 7 AS DOUBLE), CAST({key} % 11 AS DOUBLE)]"


ORACLE["dense_many_questions"] = with_(
    f"asked AS (SELECT 'c' || c_custkey AS query_id, {likeness('c_custkey', 'c_nationkey', 'c_acctbal')} AS a FROM customer)",
    f"lake AS (SELECT s_suppkey AS ord, 's' || s_suppkey AS table_id, {likeness('s_suppkey', 's_nationkey', 's_acctbal')} AS b FROM supplier)",
    """pairs AS (
  SELECT query_id, ord, table_id, list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))) AS score
  FROM asked CROSS JOIN lake)""",
    """best AS (
  SELECT query_id, table_id, score,
    row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, ord) AS rank FROM pairs)""",
    select=HITS + "best WHERE rank <= 10",
)

OTHERS = f"""parts AS (
  SELECT *, CASE o_orderstatus WHEN 'F' THEN 'metadata' WHEN 'O' THEN 'template' ELSE 'linear' END AS exp,
    o_orderpriority[1] < '3' AS first, CASE WHEN o_custkey % 2 = 0 THEN {lit(MODEL)} ELSE {lit(OTHER_MODEL)} END AS model FROM orders),
runs AS (
  SELECT exp, model, CASE WHEN exp = 'linear' AND first THEN 'Linearization.JSON' ELSE 'Linearization.CSV' END AS linearization,
    CASE WHEN exp = 'template' AND first THEN 'Template.TTTQ' ELSE 'Template.QTTT' END AS template,
    CASE WHEN exp = 'metadata' THEN CASE WHEN first THEN 'True' ELSE 'False' END END AS metadata,
    {", ".join(f"avg(CASE WHEN CAST(floor(o_totalprice) AS BIGINT) % 120 < {k} THEN 1.0 ELSE 0.0 END) AS accuracy_at_{k}" for k in K_VALUES)},
    avg(CASE WHEN CAST(floor(o_totalprice * 100) AS BIGINT) % 7 > 3 THEN 1.0 ELSE 0.0 END) AS exact_match,
    sum(o_totalprice / 1e9) / count(*) AS total_llm_cost
  FROM parts GROUP BY ALL)"""
ORACLE["report_file_retrieval"] = ORACLE["report_flat"]
ORACLE["report_file_zoom"] = ORACLE["report_zoom"]
ORACLE["report_file_tqa"] = ORACLE["report_pivot"]
ORACLE["report_file_metadata"] = with_(OTHERS, select=f"""
SELECT 'BM25Retriever' AS retriever, 'NoReranker' AS reranker, 'NoZoom' AS zoom, linearization, metadata, {FLAT}
FROM runs WHERE exp = 'metadata'""")
for layout, column in (("template", "template"), ("linear", "linearization")):
    ORACLE[f"report_file_{layout}"] = with_(OTHERS, select=f"""
SELECT {column}, {", ".join(f'max(round(exact_match, 2)) FILTER (model = {lit(m)}) AS "exact_match|{m}"' for m in MODELS)}
FROM runs WHERE exp = '{layout}' GROUP BY {column}""")

ORACLE["split_files"] = ORACLE["split_easy_hard"].replace("SELECT lang AS partition,", "SELECT 'test' AS partition,")
ORACLE["tables_from_files"] = f"""
SELECT dataset, row_number() OVER (PARTITION BY dataset ORDER BY ord) - 1 AS ord, table_id, table_name,
  {", ".join(f"md5({c}) AS {c}" for c in ("column_header", "row_header", "data"))}
FROM ({ORACLE["tables_normalized"]})"""
ORACLE["questions_from_files"] = """
SELECT row_number() OVER (ORDER BY event_id) - 1 AS query_ord, CAST(event_id AS VARCHAR) AS query_id, props AS query_text,
  event_type AS table_id, event_type || '|' || props AS ground_truth FROM events"""
