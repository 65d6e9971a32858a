"""Registered queries opN_<name> and, where SQL can express one, the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import ann, bpe, chat, edits, huffman, hyperminhash, licenses, mixing, spelling, structure, topk, toxicity, urls
from tablewright.llm.common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document and of their decoded text."""
    return bpe.round_trip(read_table(spark, sf_dir, "documents"))


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity by a model trained on the labels that are not held out."""
    docs = read_table(spark, sf_dir, "documents")
    scored = toxicity.scores(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query
def op8_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of two-word shingles are similar at 0.8 or more."""
    return hyperminhash.near_duplicates(read_table(spark, sf_dir, "documents"), width=2, percent=80)


ORACLES["op8_hyperminhash"] = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents),
shingles AS (
    SELECT DISTINCT doc_id, unnest(CASE
        WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || chr(10) || w[i + 1])
        ELSE w END) AS s
    FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
numbered AS (SELECT doc_id, s, n, count(*) OVER (PARTITION BY s) AS f FROM shingles JOIN sizes USING (doc_id)),
-- two sets that share four fifths of their union share one of the first n - ceil(0.8 n) + 1 shingles in any common order
ranked AS (SELECT doc_id, s, n, row_number() OVER (PARTITION BY doc_id ORDER BY f, s) AS r FROM numbered),
prefix AS (SELECT doc_id, s, n FROM ranked WHERE r <= n - (4 * n + 4) // 5 + 1),
candidates AS (
    SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM prefix x JOIN prefix y ON x.s = y.s AND x.doc_id < y.doc_id
        AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)),
both_in AS (
    SELECT a, b, count(*) AS c FROM candidates JOIN shingles x ON x.doc_id = a JOIN shingles y ON y.doc_id = b AND y.s = x.s GROUP BY a, b),
links AS (
    SELECT a, b FROM both_in JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(doc_id, other) AS (
    SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, ways.b FROM reach JOIN ways ON reach.other = ways.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id)
JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)
"""


@query
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    mixed = mixing.copies(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@query
def op2_huffman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the files of the encoded documents hold, read back."""
    folder = huffman.new_folder(spark)
    huffman.write_ids(read_table(spark, sf_dir, "documents"), folder, "word_bpe_49k.json", end_id=2)
    return huffman.read_ids(spark, folder, digest_only=True)


def _as_records(turns: DataFrame) -> DataFrame:
    """Conversations as JSON records (conv_id, record): objects of turns under either pair of names, or a prompt and its response."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    names = F.transform("turns", lambda x: x["role"])
    messages = F.struct(F.transform("turns", lambda x: F.struct(x["role"], x["text"].alias("content"))).alias("messages"))
    told = F.struct(F.transform("turns", lambda x: F.struct(x["role"].alias("from"), x["text"].alias("value"))).alias("conversations"))
    asked = F.struct(F.col("turns")[0]["text"].alias("prompt"), F.get("turns", F.lit(1))["text"].alias("response"), F.lit("en").alias("lang"))
    pair = names == F.array(F.lit("user"), F.lit("assistant"))
    # names that mean others in that layout
    plain = ~F.arrays_overlap(names, F.array(F.lit("human"), F.lit("gpt")))
    record = F.when(pair, F.to_json(asked)).when(plain & (F.col("conv_id") % 8 < 4), F.to_json(told)).otherwise(F.to_json(messages))
    return whole.select("conv_id", record.alias("record"))


@query
def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, from its rows or from JSON records, and one made of control strings, formatted and read back."""
    said = "</s>[INST] ok [/INST]"
    message = [F.struct(F.lit(role).alias("role"), F.lit(said).alias("content")) for role in ("user", "assistant")]
    extra = spark.range(1).select(F.lit(-7).alias("conv_id"), F.array(*message).alias("messages"))
    said_in = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    # three quarters as JSON records: whole conversations, and single turns
    share = F.coalesce(F.pmod(F.col("conv_id"), F.lit(4)), F.lit(0))
    single = said_in.where(share == 1).select("conv_id", F.to_json(F.struct("turn", "role", "text"), {"ignoreNullFields": "false"}).alias("record"))
    records = single.unionByName(_as_records(said_in.where(share > 1)))
    turns = chat.canonical(said_in.where(share == 0)).unionByName(chat.canonical_records(records)).unionByName(chat.canonical(extra))
    found = chat.read_back(chat.formatted(turns))
    told = F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n")))
    learned = F.array_join("loss_texts", "")
    return found.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(told, ""), 256).alias("turns_sha256"),
        F.length(learned).cast("bigint").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def _escaped_sql(value: str) -> str:
    value = f"replace({value}, '{chat.ESCAPE}', '{chat.ESCAPE * 2}')"
    for control in chat.CONTROLS:
        value = f"replace({value}, '{control}', '{control[0]}{chat.ESCAPE}{control[1:]}')"
    return value


ORACLES["op10_chat"] = f"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
whole AS (
    SELECT conv_id, count(*) AS n_turns,
        string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS told,
        coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS learned,
        sum(length({_escaped_sql("role")}) + length({_escaped_sql("text")}) + {len(chat.TURN_OPEN + chat.ROLE_CLOSE + chat.TURN_CLOSE)}) AS n
    FROM turns GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256,
    n::BIGINT AS formatted_chars
FROM whole
"""


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").alias("vector"))


@query
def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest integer inner products of every twentieth vector with all others."""
    rows = _vectors(spark, sf_dir)
    return topk.top_k(rows, rows.where("vec_id % 20 = 0"), k=20, scale=64.0)


ORACLES["op9_topk"] = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e)::BIGINT AS score
    FROM v q JOIN v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


@query
def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors found for every hundredth one."""
    rows = _vectors(spark, sf_dir)
    return ann.nearest(rows, rows.where("vec_id % 100 = 0"), k=10)


@query
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after three edits: a part of it moved, a part left out, a word put in."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    size = F.length(F.coalesce("text", F.lit("")))

    def draw(number: int, most: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(number), "doc_id"), most + 1)

    def change(number: int, gone: int, taken: int) -> Column:
        start = draw(number, size)
        piece = F.substring("text", (draw(number + 10, size) + 1).cast("int"), draw(number + 20, F.lit(taken)).cast("int"))
        return F.struct(start.alias("start"), (start + draw(number + 30, F.lit(gone))).alias("end"), piece.alias("replacement"))

    return edits.recounted(docs.withColumn("edits", F.array(change(1, 40, 40), change(2, 120, 0), change(3, 0, 9))))


def _drawn(text: str, spark_sql: bool) -> str:
    """A number from the md5 of a text, written for Spark or for DuckDB."""
    digits = f"substr(md5({text}), 1, 7)"
    return f"CAST(conv({digits}, 16, 10) AS BIGINT)" if spark_sql else f"('0x' || {digits})::BIGINT"


@query
def op6_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged by dated block and allow lists over hosts, domains and paths of the pages themselves."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("day", 18_000 + F.expr(_drawn("CAST(page_id AS STRING)", True)) % 1_000)
    named = pages.select(F.explode(urls.keys_of(urls.host_of(F.col("url")), urls.path_parts(F.col("url")))).alias("key")).distinct()
    lists = F.explode(F.array(F.lit("allow"), F.lit("block"))).alias("list")
    dated = named.select("key", lists).withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(5))))
    text = "concat_ws('|', list, key, CAST(place AS STRING))"
    dated = dated.where(F.expr(_drawn("concat_ws('|', list, key)", True)) % 3 == 0)
    entries = dated.select(
        "list",
        "key",
        (18_000 + F.expr(_drawn(text, True)) % 1_000).alias("day"),
        F.when(F.expr(_drawn(f"concat({text}, '!')", True)) % 2 == 0, "add").otherwise("remove").alias("action"),
    )
    return urls.judged(captures, entries)


ORACLES["op6_url_lists"] = f"""
WITH captures AS (
    SELECT page_id, 18000 + {_drawn("page_id::VARCHAR", False)} % 1000 AS day,
        nullif(regexp_replace(lower(regexp_extract(url, '^\\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:\\s]+)', 1)), '\\.$', ''), '') AS host,
        list_filter(string_split(regexp_extract(url, '^\\s*[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)', 1), '/'), lambda x: x <> '') AS parts
    FROM pages),
lookups AS (
    SELECT page_id, day, host, unnest(list_concat(
        list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.')),
        list_transform(range(1, len(parts) + 1), lambda i: host || '/' || array_to_string(parts[1:i], '/')))) AS key
    FROM captures WHERE host IS NOT NULL),
named AS (SELECT DISTINCT key FROM lookups),
dated AS (
    SELECT list, key, 18000 + {_drawn("concat_ws('|', list, key, place::VARCHAR)", False)} % 1000 AS day,
        CASE WHEN {_drawn("concat_ws('|', list, key, place::VARCHAR) || '!'", False)} % 2 = 0 THEN 'add' ELSE 'remove' END AS action
    FROM named, (VALUES ('allow'), ('block')) l(list), range(0, 6) p(place)
    WHERE {_drawn("concat_ws('|', list, key)", False)} % 3 = 0),
daily AS (SELECT list, key, day, max(action) AS action FROM dated GROUP BY list, key, day),
spans AS (SELECT list, key, action, day AS since, lead(day) OVER (PARTITION BY list, key ORDER BY day) AS until FROM daily),
active AS (
    SELECT page_id, l.key, s.list, row_number() OVER (PARTITION BY page_id ORDER BY length(l.key) DESC, s.list = 'allow' DESC, s.list DESC, l.key DESC) AS r,
        count(*) OVER (PARTITION BY page_id) AS n
    FROM lookups l JOIN spans s ON s.key = l.key AND s.action = 'add' AND since <= day AND (until IS NULL OR day < until))
SELECT c.page_id, host, day, coalesce(n, 0) AS n_active, CASE WHEN r IS NULL THEN '' ELSE list || ':' || key END AS decided_by,
    CASE WHEN list <> 'allow' THEN 'drop' ELSE 'keep' END AS verdict
FROM captures c LEFT JOIN active a ON a.page_id = c.page_id AND r = 1
"""


@query
def op13_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of license phrases and labels of license notices in every document."""
    return licenses.summary(licenses.scan(read_table(spark, sf_dir, "documents")))


def _notices_sql() -> str:
    rows = [(label, sorted(set(licenses.plain_words(notice)))) for label, notice in licenses.TEMPLATES]
    return ", ".join(f"('{label}', {words})" for label, words in rows)


def _phrases_sql() -> str:
    return ", ".join(f"('{label}', {phrase.split(' ')})" for phrase, label in licenses.PHRASES)


ORACLES["op13_license_scans"] = rf"""
WITH words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{licenses.WORD}') AS w
    FROM documents),
phrases(label, p) AS (VALUES {_phrases_sql()}),
notices(label, t) AS (VALUES {_notices_sql()}),
places AS (
    SELECT doc_id, label, unnest(list_filter(range(len(w)), lambda i: w[i + 1 : i + len(p)] = p)) AS start FROM words, phrases),
base AS (
    SELECT doc_id, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, list(label) AS labels FROM places GROUP BY doc_id),
blocks AS (
    SELECT doc_id, unnest(list_transform(range(greatest(len(w) - 1 - {licenses.SPAN}, 0) // {licenses.SPAN} + 1),
        lambda b: list_distinct(w[b * {licenses.SPAN} + 1 : (b + 2) * {licenses.SPAN}]))) AS b
    FROM words),
held AS (SELECT doc_id, label, len(list_intersect(b, t)) AS c, len(t) AS n FROM blocks, notices),
met AS (
    SELECT doc_id, list(label) AS labels, max(c / n) AS score FROM held WHERE 100 * c >= {licenses.PERCENT} * n GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
    coalesce(array_to_string(list_sort(list_distinct(base.labels)), ','), '') AS base_labels,
    coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(met.labels, [])))), ','), '') AS labels,
    CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(met.score, 0) END::DOUBLE AS score
FROM words LEFT JOIN base USING (doc_id) LEFT JOIN met USING (doc_id)
"""


#: crc32 of the bytes x, unsigned, in DuckDB
CRC32_SQL = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], x),
    lambda c, b: xor(c >> 8, list_reduce(list_concat([xor(c, b) & 255], range(8)), lambda t, k: CASE WHEN t & 1 = 1 THEN xor(t >> 1, 3988292384) ELSE t >> 1 END))))"""


@query
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their most frequent near word and the last of the chain of such words."""
    return spelling.variants(read_table(spark, sf_dir, "documents"))


ORACLES["op12_spelling_variants"] = f"""
WITH RECURSIVE runs AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run
    FROM documents),
counted AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 5 GROUP BY ALL),
keyed AS (SELECT run, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS h FROM counted),
bytes AS (SELECT run, n, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT) AS x FROM keyed),
drawn AS (SELECT run, n, {CRC32_SQL} AS h FROM bytes),
spelled AS (
    SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM drawn),
words AS (SELECT word, sum(n)::BIGINT AS n FROM spelled WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cut AS (
    SELECT word, n, p, substr(word, 1, p) || substr(word, p + 2) AS less FROM words, unnest(range(length(word))) u(p)),
near AS (
    SELECT x.word, y.word AS other, y.n FROM cut x JOIN cut y ON x.less = y.less AND x.p = y.p AND x.word <> y.word
    UNION SELECT x.less, x.word, x.n FROM cut x JOIN words y ON x.less = y.word
    UNION SELECT x.word, y.word, y.n FROM cut x JOIN words y ON x.less = y.word),
best AS (SELECT word, count(DISTINCT other) AS n_near, max(n) AS best_n FROM near GROUP BY word),
forms AS (
    SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN best_n >= 2 * w.n THEN best_n END AS form_n,
        CASE WHEN best_n >= 2 * w.n THEN (SELECT min(other) FROM near WHERE near.word = w.word AND near.n = b.best_n) END AS form
    FROM words w LEFT JOIN best b USING (word)),
walk(word, place, step) AS (
    SELECT word, word, 0 FROM forms UNION ALL SELECT walk.word, forms.form, step + 1 FROM walk JOIN forms ON forms.word = walk.place WHERE form IS NOT NULL),
roots AS (SELECT word, arg_max(place, step) AS root FROM walk GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)
"""


def _damaged(turns: DataFrame) -> DataFrame:
    """Conversations with rows dropped, emptied, cut, repeated and given to the user, by a draw from their place."""
    space = F.lit(" ")
    drawn = F.crc32(F.concat(*(F.coalesce(c, space) for c in (F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string"))))) % 20
    text = F.coalesce("text", space)
    text = F.when(drawn == 1, "").when(drawn == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    rows = turns.where(drawn != 0).select(
        "conv_id",
        "turn",
        F.when(drawn == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        text.alias("text"),
        F.explode(F.when(drawn == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return rows.drop("copy")


@query
def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of every damaged conversation, its cheapest edits and the digest of what they make."""
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = structure.report(_damaged(turns)).withColumnRenamed("conv_id", "_id")
    ids = turns.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    joined = ids.join(found, F.col("conv_id").eqNullSafe(F.col("_id")), "left")
    counts = (F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))
    return joined.select(
        "conv_id",
        *counts,
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


ORACLES["op11_structure_repair"] = f"""
WITH RECURSIVE keyed AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT) AS x
    FROM conversations),
drawn AS (SELECT conv_id, turn, role, text, {CRC32_SQL} % 20 AS h FROM keyed),
damaged AS (
    SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
        CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END))
    FROM drawn WHERE h <> 0),
placed AS (
    SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
        rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS solid,
        CASE WHEN role[1:1] IN ('s', 'u', 'a') THEN role[1:1] ELSE 'x' END AS initial
    FROM damaged),
judged AS (
    SELECT *, CASE WHEN solid = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
            WHEN solid[-1:] IN ('.', '!', '?') THEN '.' ELSE 't' END AS fault,
        coalesce(lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au'), false) AS illegal
    FROM placed),
faults AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
        count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (illegal) AS illegal, count(*) AS n
    FROM judged GROUP BY conv_id),
inserts(s, t, price, letters, made) AS (VALUES
    ('0', '0', 0, '', []::VARCHAR[]), ('S', 'S', 0, '', []), ('U', 'U', 0, '', []), ('A', 'A', 0, '', []),
    ('0', 'U', 5, 'I', ['user:']), ('S', 'U', 5, 'I', ['user:']), ('U', 'A', 5, 'I', ['assistant:']), ('A', 'U', 5, 'I', ['user:']),
    ('0', 'A', 10, 'II', ['user:', 'assistant:']), ('S', 'A', 10, 'II', ['user:', 'assistant:'])),
moves(initial, s, t, letter, price, role) AS (VALUES
    ('s', '0', 'S', 'K', 0, NULL), ('u', '0', 'U', 'K', 0, NULL), ('u', 'S', 'U', 'K', 0, NULL), ('u', 'A', 'U', 'K', 0, NULL), ('a', 'U', 'A', 'K', 0, NULL),
    ('*', '0', 'U', 'R', 1, 'user'), ('*', 'S', 'U', 'R', 1, 'user'), ('*', 'A', 'U', 'R', 1, 'user'), ('*', 'U', 'A', 'R', 1, 'assistant'),
    ('*', '0', '0', 'D', 2, NULL), ('*', 'S', 'S', 'D', 2, NULL), ('*', 'U', 'U', 'D', 2, NULL), ('*', 'A', 'A', 'D', 2, NULL)),
best(conv_id, i, s, way) AS (
    SELECT conv_id, 0::BIGINT, t, {{'cost': price, 'audit': letters, 'made': made}} FROM faults, inserts WHERE s = '0'
    UNION ALL
    SELECT b.conv_id, b.i + 1, e.t, min({{
        'cost': b.way.cost + m.price + e.price + CASE WHEN fault = 't' AND letter <> 'D' THEN 5 ELSE 0 END,
        'audit': b.way.audit || letter || e.letters,
        'made': list_concat(list_concat(b.way.made, CASE WHEN letter = 'D' THEN [] ELSE [coalesce(m.role, j.role) || ':' || text] END), e.made)}})
    FROM best b JOIN judged j ON j.conv_id IS NOT DISTINCT FROM b.conv_id AND j.i = b.i + 1
    JOIN moves m ON m.s = b.s AND m.initial IN ('*', j.initial) AND (letter = 'D' OR fault NOT IN ('b', 'd'))
    JOIN inserts e ON e.s = m.t
    GROUP BY b.conv_id, b.i, e.t),
done AS (
    SELECT b.conv_id, min(way) AS way FROM best b JOIN faults f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND b.i = f.n WHERE s IN ('0', 'A') GROUP BY b.conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
    coalesce(illegal, 0) AS illegal, coalesce(way.cost, 0)::BIGINT AS cost, coalesce(way.audit, '') AS audit,
    sha256(coalesce(array_to_string(way.made, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM c.conv_id
"""
