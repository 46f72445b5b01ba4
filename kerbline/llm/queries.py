"""One registered query per operator, over its whole table, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


SQL_AZ = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@register("op8_line_dedup", f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT doc_id, pos, line, {SQL_AZ.format("trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ')")} AS key FROM l),
c AS (SELECT key, max(doc_id) AS holder FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT k.*, c.key IS NOT NULL AND doc_id <> holder AS drop_it FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (drop_it) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT drop_it), '')) AS kept_sha256
FROM j GROUP BY doc_id""")
def op8(spark, sf_dir):
    from kerbline.llm.line_dedup import line_dedup
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def _sql_words(table_name: str, key: str) -> str:
    return f"SELECT {key}, regexp_extract_all({SQL_AZ.format('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {table_name}"


@register("op5_decontaminate", f"""
WITH b AS ({_sql_words("benchmark", "item_id")}), d AS ({_sql_words("documents", "doc_id")}),
bn AS (SELECT item_id, w, least(len(w), 13) AS n FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM bn)),
hits AS (SELECT doc_id, i, win.n, item_id FROM (SELECT doc_id, s.n, i, array_to_string(w[i:i + s.n - 1], ' ') AS g
         FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win)) s) x JOIN win ON x.n = win.n AND x.g = win.g),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, coalesce(len(w), 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(w), 0) AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)""")
def op5(spark, sf_dir):
    from kerbline.llm.decontaminate import decontaminate
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
                      ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


@register("op4_mix_sources")
def op4(spark, sf_dir):
    from kerbline.llm.mixing import mix_draws
    out = mix_draws(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["words"]).alias("taken"))


@register("op3_language_id")
def op3(spark, sf_dir):
    import public_tokenizers
    from kerbline.llm.language_id import held_out, identify
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = identify(docs, F.col("doc_id").isNotNull() & ~held_out(), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@register("op6_token_files")
def op6(spark, sf_dir):
    import public_tokenizers
    from kerbline.llm.common import new_folder
    from kerbline.llm.token_files import read_tokens, write_tokens
    path = new_folder(spark, "token_files")
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@register("op2_near_dedup", f"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all({SQL_AZ.format('text')}, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n u ON u.doc_id = a JOIN n v ON v.doc_id = b WHERE 100 * m >= 85 * (u.n + v.n - m)),
r(id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id)
SELECT id AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(c) AS component_id, id = min(c) AS kept FROM r LEFT JOIN n ON n.doc_id = id GROUP BY id""")
def op2(spark, sf_dir):
    from kerbline.llm.minhash import near_dedup
    return near_dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id", "kept")


@register("op10_embedding_join", """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
       AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= 0.9),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
r(id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id)
SELECT id AS vec_id, coalesce(any_value(n.n), 0) AS n_links, min(c) AS component_id, id = min(c) AS kept FROM r LEFT JOIN n ON n.a = r.id GROUP BY id""")
def op10(spark, sf_dir):
    from kerbline.llm.embedding_join import range_join
    return range_join(table(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


@register("op7_toxicity")
def op7(spark, sf_dir):
    from kerbline.llm.toxicity import toxicity
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")}
    return toxicity(docs, table(spark, sf_dir, "labels"), chain).select("doc_id", "p_low_quality", "p_toxic", "toxic")


@register("op9_pii")
def op9(spark, sf_dir):
    from kerbline.llm.pii import find_pii
    out = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("pii", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in ("email", "ip", "card", "phone")]
    return out.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans"))


@register("op1_suffix_dedup", """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS k FROM (SELECT doc_id, s, md5(substr(h, 2 * s + 1, 200)) AS g FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS s FROM d))),
f AS (SELECT doc_id, s, s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS gap FROM w WHERE k > 1),
i AS (SELECT doc_id, s, sum(CASE WHEN gap IS NULL OR gap > 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s) AS island FROM f),
r AS (SELECT doc_id, island, min(s) AS a, max(s) + 100 AS b FROM i GROUP BY ALL),
p AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS last FROM r),
c AS (SELECT p.doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS stop, string_agg(substr(h, 2 * last + 1, 2 * (a - last)), '' ORDER BY a) AS head FROM p JOIN d ON d.doc_id = p.doc_id GROUP BY p.doc_id)
SELECT d.doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(CASE WHEN stop IS NULL THEN h ELSE head || substr(h, 2 * stop + 1) END)) AS kept_sha256
FROM d LEFT JOIN c ON c.doc_id = d.doc_id""")
def op1(spark, sf_dir):
    from kerbline.llm.suffix_dedup import suffix_dedup
    out = suffix_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@register("op11_top_k", """
WITH v AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS q FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""")
def op11(spark, sf_dir):
    from kerbline.llm.bit_sliced import top_k
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


TERMS = "regexp_extract_all({}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"


@register("op12_ranked_search", f"""
WITH t AS (SELECT doc_id, unnest({TERMS.format(SQL_AZ.format("text"))}) AS term FROM documents),
d AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id), s AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM d),
f AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY doc_id, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(nn) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, s GROUP BY term),
q AS (SELECT DISTINCT item_id, unnest({TERMS.format(SQL_AZ.format("text"))}) AS term FROM benchmark),
r AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // ll)))) AS BIGINT) AS score
      FROM q JOIN f USING (term) JOIN w USING (term) JOIN d USING (doc_id), s GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0) WHERE rank <= 10""")
def op12(spark, sf_dir):
    from kerbline.llm.signatures import ranked_search
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _sql_repair() -> str:
    """The same dynamic programme over whole strings: one step of the recursion per row of a conversation."""
    crc = "xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(key) + 1), lambda i: CAST(ascii(substr(key, i, 1)) AS BIGINT))), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, j: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 20"

    def add(state: str, cost: str, edit: str, line: str | None = None) -> str:
        kept = f"{state}.r" if line is None else f"{state}.r || CASE WHEN {state}.r = '' THEN '' ELSE chr(10) END || {line}"
        return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{edit}', 'r': {kept}}}"

    def least(*options: str) -> str:
        return f"list_min([{', '.join(options)}])"

    def when(condition: str, option: str) -> str:
        return f"CASE WHEN {condition} THEN {option} END"

    def moved(i: str, name: str, *sources: str) -> list[str]:
        return [o for s in sources for o in (when(f"ini = '{i}' AND NOT gone", add(s, "more", "K", "role || ':' || text")), when("NOT gone", add(s, "more + 1", "R", f"'{name}:' || text")))]

    def closed(columns: str, source: str) -> str:
        u = least("u", *[add(s, "5", "I", "'user:'") for s in "nsa"])
        return f"SELECT {columns}, n, s, u, {least('a', add('u', '5', 'I', chr(39) + 'assistant:' + chr(39)))} AS a FROM (SELECT {columns}, n, s, {u} AS u, a FROM ({source}))"

    none = "CAST({'c': 1000000000, 'a': '', 'r': ''} AS STRUCT(c BIGINT, a VARCHAR, r VARCHAR))"
    start = closed("conv_id, pos", f"SELECT conv_id, CAST(0 AS BIGINT) AS pos, CAST({{'c': 0, 'a': '', 'r': ''}} AS STRUCT(c BIGINT, a VARCHAR, r VARCHAR)) AS n, {none} AS s, {none} AS u, {none} AS a FROM (SELECT DISTINCT conv_id FROM f)")
    step = closed("conv_id, pos", f"""SELECT f.conv_id, f.pos, {add('n', '2', 'D')} AS n, {least(add('s', '2', 'D'), when("ini = 's' AND NOT gone", add('n', 'more', 'K', "role || ':' || text")))} AS s,
        {least(add('u', '2', 'D'), *moved('u', 'user', 'n', 's', 'a'))} AS u, {least(add('a', '2', 'D'), *moved('a', 'assistant', 'u'))} AS a
        FROM v JOIN f ON f.conv_id IS NOT DISTINCT FROM v.conv_id AND f.pos = v.pos + 1""")
    space = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
    return f"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
d AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy
      FROM (SELECT *, {crc} AS kind FROM k) WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, substr(role, 1, 1) AS ini, trim(text, {space}) AS bare FROM d),
m AS (SELECT *, bare = '' AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again, coalesce(lag(ini) OVER (PARTITION BY conv_id ORDER BY pos) || ini NOT IN ('su', 'ua', 'au'), false) AS bad FROM o),
f AS (SELECT *, blank OR again AS gone, NOT blank AND NOT again AND right(bare, 1) NOT IN ('.', '!', '?') AS cut, CASE WHEN NOT blank AND NOT again AND right(bare, 1) NOT IN ('.', '!', '?') THEN 5 ELSE 0 END AS more FROM m),
v(conv_id, pos, n, s, u, a) AS ({start} UNION ALL {step}),
t AS (SELECT conv_id, count(*) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
             count(*) FILTER (cut) AS truncated, count(*) FILTER (bad) AS illegal FROM f GROUP BY conv_id),
e AS (SELECT v.conv_id, {least('n', 'a')} AS best FROM v JOIN t ON v.conv_id IS NOT DISTINCT FROM t.conv_id AND v.pos = t.rows)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(best.r, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN t ON c.conv_id IS NOT DISTINCT FROM t.conv_id LEFT JOIN e ON c.conv_id IS NOT DISTINCT FROM e.conv_id"""


@register("op13_repair_conversations", _sql_repair())
def op13(spark, sf_dir):
    from kerbline.llm.conversations import audited, damage, with_lost
    rows = table(spark, sf_dir, "conversations")
    return with_lost(audited(damage(rows)), rows)
