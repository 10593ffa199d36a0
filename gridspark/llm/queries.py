"""Registered queries of the operators and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op10_quality_classifier")
def op10(spark, sf_dir):
    """The documents that stay, with their scores."""
    from gridspark.llm.quality import classify

    docs = classify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), table(spark, sf_dir, "labels"))
    q = [F.round(f"quality_.{c}", 6).alias(c) for c in ("good", "toxic", "text_good", "text_toxic", "host_good", "host_toxic")]
    return docs.filter("quality_.keep").select("doc_id", "source", "lang", *q, F.col("quality_.keep").alias("keep"))


@query("op4_ngram_jaccard", r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
    SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM w, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS u(i) WHERE len(ws) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, m.m) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM r GROUP BY a) m USING (doc_id)
""")
def op4(spark, sf_dir):
    from gridspark.llm.ngram_join import classes

    return classes(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


@query("op6_substring_dedup")
def op6(spark, sf_dir):
    from gridspark.llm.spans import PASSAGES, dedup

    docs = dedup(table(spark, sf_dir, "documents").select("doc_id", "text", F.octet_length("text").cast("long").alias("n_bytes")), PASSAGES)
    return docs.select(
        "doc_id", F.coalesce("n_bytes", F.lit(0).cast("long")).alias("n_bytes"), F.col("cut_.n_removed").alias("n_removed"),
        F.size("cut_.spans").cast("long").alias("n_spans"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


@query("op2_benchmark_decontamination")
def op2(spark, sf_dir):
    from gridspark.llm.tiling import contaminated

    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_tokens", "n_tiles", "n_covered", F.round(F.col("n_covered") / F.col("n_tokens"), 6).alias("coverage"))


@query("op7_byte_level_bpe")
def op7(spark, sf_dir):
    import public_tokenizers

    from gridspark.llm.bpe import encode

    where = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    both = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), *where, decoded=True)
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op3_histogram_sharding")
def op3(spark, sf_dir):
    from gridspark.llm.sharding import shard

    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", size.alias("size"))
    # Size and digest are those of the texts that arrived in a shard.
    return shard(docs, "size").select(
        "doc_id", size.alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"), F.col("shard_").alias("shard"), F.col("slot_").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


@query("op1_chat_format", """
WITH c AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
    SELECT *, lag(role) OVER o IS DISTINCT FROM role AS opens,
        length(regexp_replace(regexp_replace(replace(text, '&', '&amp;'), '<(/?s>)', '&lt;\\1', 'g'), '\\[((/?INST|TURN)\\])', '&lsqb;\\1', 'g')) AS n_text,
        length(regexp_replace(regexp_replace(replace(role, '&', '&amp;'), '<(/?s>)', '&lt;\\1', 'g'), '\\[((/?INST|TURN)\\])', '&lsqb;\\1', 'g')) AS n_role
    FROM c WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(n_text + CASE WHEN opens THEN n_role + 20 ELSE 6 END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
""")
def op1(spark, sf_dir):
    from gridspark.llm.chat import format_chats, read_back, unescape

    extra = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    chats = format_chats(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra))
    back = chats.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"), unescape(F.array_join(F.transform(
        F.filter("pieces", lambda p: p["loss"]), lambda p: p["text"]), "")).alias("loss"))
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


def license_sql() -> str:
    """Phrases by list positions, notices by set intersection of every line."""
    from math import ceil

    from gridspark.llm.licenses import Settings, _split

    s = Settings()
    quoted = lambda v: "'" + v + "'"
    phrases = ", ".join(f"([{', '.join(map(quoted, p.split()))}], {quoted(label)})" for p, label in s.phrases)
    sets = [(label, sorted(set(_split(text)))) for label, text in s.notices]
    notices = ", ".join(f"({quoted(label)}, [{', '.join(map(quoted, w))}], {ceil(s.containment * len(w) - 1e-9)})" for label, w in sets)
    return rf"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM d),
ph(p, label) AS (VALUES {phrases}),
nt(label, need, least_) AS (VALUES {notices}),
b AS (SELECT doc_id, i - 1 AS pos, label FROM w, ph, unnest(range(1, len(ws) - len(p) + 2)) AS u(i)
      WHERE contains(t, p[1]) AND contains(t, p[len(p)]) AND ws[i:i + len(p) - 1] = p),
ln AS (SELECT doc_id, list_distinct(regexp_extract_all(x, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS ls FROM d, unnest(string_split(t, chr(10))) AS u(x)),
n AS (SELECT doc_id, label, len(list_intersect(ls, need)) / len(need) AS c FROM ln, nt WHERE len(ls) >= least_ AND len(list_intersect(ls, need)) >= least_),
bs AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY doc_id),
la AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM b UNION SELECT doc_id, label FROM n) GROUP BY doc_id),
sc AS (SELECT doc_id, max(c) AS c FROM n GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
    coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(c, 0.0::DOUBLE) END AS score
FROM w LEFT JOIN bs USING (doc_id) LEFT JOIN la USING (doc_id) LEFT JOIN sc USING (doc_id)
"""


@query("op5_license_scan", license_sql())
def op5(spark, sf_dir):
    from gridspark.llm.licenses import Settings, scan

    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), Settings(wrapped=True))
    at = F.transform("bases", lambda b: b["at"])
    return found.select(
        "doc_id", "n_words", F.size("bases").cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("bases", lambda b: b["label"]))), ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"), "score")


@query("op8_nearest_neighbours")
def op8(spark, sf_dir):
    from gridspark.llm.ann import search

    return search(table(spark, sf_dir, "embeddings"))


@query("op9_suffix_array_dedup", r"""
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS t, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
g AS (SELECT doc_id, i, t[2 * i + 1:2 * i + 100] AS x FROM d, unnest(range(0, n - 49)) AS u(i)),
f AS (SELECT x, min(doc_id) AS lo FROM g GROUP BY x HAVING min(doc_id) < max(doc_id)),
c AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM g JOIN f USING (x) WHERE lo < doc_id),
k AS (SELECT doc_id, i, sum(CASE WHEN i <= p + 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM c),
o AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS z FROM k GROUP BY doc_id, run),
q AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM o),
h AS (SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans, max(z) AS final, string_agg(t[2 * before + 1:2 * a], '' ORDER BY a) AS kept FROM q JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, d.n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
    sha256(unhex(coalesce(kept, '') || t[2 * coalesce(final, 0) + 1:])) AS kept_sha256
FROM d LEFT JOIN h USING (doc_id)
""")
def op9(spark, sf_dir):
    from gridspark.llm.suffix import dedup

    docs = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "cut_.n_bytes", "cut_.n_removed", "cut_.n_spans", F.sha2("cut_.kept", 256).alias("kept_sha256"))


def url_sql() -> str:
    """Rules by a correlated choice, masses by a recursion over the rounds."""
    from gridspark.llm.url_filter import LINK, LOWER, UPPER, Settings

    s = Settings()
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in s.rules)
    fold = lambda x: f"translate({x}, '{UPPER}', '{LOWER}')"
    link = LINK.replace("'", "''")
    return rf"""
WITH RECURSIVE ru(rh, rp, rv) AS (VALUES {rules}),
q AS (SELECT page_id, html, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, html, {fold("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM q),
f AS (SELECT host, path, arg_max(rh || rp, 1000 * length(rh || rp) + length(rh)) AS rule, arg_max(rv, 1000 * length(rh || rp) + length(rh)) AS rv
      FROM (SELECT DISTINCT host, path FROM h) AS x, ru WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY host, path),
seeds AS (SELECT host, sum(CASE WHEN rv = 'allow' THEN {s.unit} ELSE 0 END)::BIGINT AS t, sum(CASE WHEN rv = 'block' THEN {s.unit} ELSE 0 END)::BIGINT AS b
          FROM h JOIN f USING (host, path) WHERE host <> '' GROUP BY host),
li AS (SELECT host AS src, unnest(list_distinct(regexp_extract_all({fold("html")}, '{link}', 1))) AS dst FROM h),
found AS (SELECT src, dst, count(*) AS n FROM li WHERE src <> '' AND src <> dst GROUP BY src, dst),
hosts AS (SELECT host FROM h WHERE host <> '' UNION SELECT dst FROM found),
up(a) AS (SELECT host FROM hosts UNION SELECT substr(a, instr(a, '.') + 1) FROM up WHERE length(a) - length(replace(a, '.', '')) > 1),
ki AS (SELECT a, substr(a, instr(a, '.') + 1) AS b FROM up WHERE length(a) - length(replace(a, '.', '')) > 1),
e AS (SELECT src, dst, sum(n) AS n FROM (SELECT src, dst, n FROM found UNION ALL SELECT a, b, {s.kin} FROM ki UNION ALL SELECT b, a, {s.kin} FROM ki) GROUP BY src, dst),
gi AS (SELECT src, sum(n) AS n FROM e GROUP BY src), ta AS (SELECT dst, sum(n) AS n FROM e GROUP BY dst),
po AS (SELECT src, dst, max(tr) AS tr, max(di) AS di FROM (
           SELECT src, dst, e.n::DOUBLE / gi.n::DOUBLE AS tr, 0.0::DOUBLE AS di FROM e JOIN gi USING (src)
           UNION ALL SELECT dst, src, 0.0::DOUBLE, e.n::DOUBLE / ta.n::DOUBLE FROM e JOIN ta USING (dst)) GROUP BY src, dst),
r(k, host, t, b) AS (
    SELECT 0, host, t, b FROM seeds
    UNION ALL
    SELECT k + 1, host, t, b FROM (
        SELECT min(k) AS k, po.dst AS host, sum(floor(t * {s.damping}::DOUBLE * tr)::BIGINT)::BIGINT AS t, sum(floor(b * {s.damping}::DOUBLE * di)::BIGINT)::BIGINT AS b
        FROM r JOIN po ON r.host = po.src GROUP BY po.dst) WHERE k < {s.rounds} AND (t > 0 OR b > 0)),
mass AS (SELECT host, sum(t)::BIGINT AS trust, sum(b)::BIGINT AS distrust FROM r GROUP BY host)
SELECT page_id, host, path, rule, coalesce(rv, CASE WHEN distrust > {s.threshold}::DOUBLE * trust THEN 'block' ELSE 'allow' END) AS verdict,
    coalesce(trust, 0)::BIGINT AS trust, coalesce(distrust, 0)::BIGINT AS distrust
FROM h LEFT JOIN f USING (host, path) LEFT JOIN mass USING (host)
"""


@query("op11_url_filter", url_sql())
def op11(spark, sf_dir):
    from gridspark.llm.url_filter import judge

    return judge(table(spark, sf_dir, "pages"))


@query("op13_ranked_search", r"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM t),
i AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w
      FROM (SELECT DISTINCT item_id, text FROM benchmark)),
it AS (SELECT item_id, w, count(*) AS qtf FROM i GROUP BY item_id, w),
a AS (SELECT count(*)::BIGINT AS nn, sum(len(ws))::BIGINT AS ll FROM d WHERE len(ws) > 0),
p AS (SELECT row, doc_id, len(ws)::BIGINT AS n, unnest(ws) AS w FROM d),
tf AS (SELECT row, doc_id, n, w, count(*)::BIGINT AS tf FROM p WHERE w IN (SELECT w FROM it) GROUP BY row, doc_id, n, w),
df AS (SELECT w, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS wt FROM tf, a GROUP BY w, nn),
s AS (SELECT item_id, row, doc_id, sum(qtf * wt * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // ll))))::BIGINT AS score
      FROM it JOIN tf USING (w) JOIN df USING (w), a GROUP BY item_id, row, doc_id),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 10
""")
def op13(spark, sf_dir):
    from gridspark.llm.ranking import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def code_sql() -> str:
    """The rounds one after the other, distances as sums over components."""
    from gridspark.llm.codes import Settings

    s = Settings()
    near = """{a} (SELECT id, part, entry AS e, d FROM (
        SELECT x.id, x.part, entry, sum((x.v - b.c) * (x.v - b.c))::BIGINT AS d, row_number() OVER (PARTITION BY x.id, x.part ORDER BY sum((x.v - b.c) * (x.v - b.c)), entry) AS k
        FROM x JOIN {b} AS b USING (part, j) GROUP BY x.id, x.part, entry) WHERE k = 1)"""
    steps = []
    for k in range(s.rounds):
        steps.append(near.format(a=f"a{k} AS MATERIALIZED", b=f"b{k}"))
        steps.append(f"""b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, b.j, coalesce(m.c, b.c) AS c FROM b{k} AS b LEFT JOIN (
            SELECT x.part, e AS entry, j, floor(sum(v)::DOUBLE / count(*))::BIGINT AS c FROM x JOIN a{k} USING (id, part) GROUP BY x.part, e, j) AS m USING (part, entry, j))""")
    steps.append(near.format(a="a AS MATERIALIZED", b=f"b{s.rounds}"))
    return f"""
WITH r AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, label, embedding AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NOT NULL AND isfinite(y))) = len(embedding)),
y AS (SELECT id, unnest(v) AS f, unnest(range(len(v))) AS i, len(v) // {s.parts} AS w FROM r),
x AS MATERIALIZED (SELECT id, (i // w)::INT AS part, (i % w)::INT AS j, floor({s.scale} * f::DOUBLE)::BIGINT AS v FROM y),
b0 AS MATERIALIZED (SELECT part, entry, j, v AS c FROM x JOIN (SELECT id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM r ORDER BY vec_id LIMIT {s.entries}) USING (id)),
{", ".join(steps)},
h AS (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY part, entry, j)) AS codebooks_sha256 FROM b{s.rounds}),
o AS (SELECT id, string_agg(printf('%02x', e), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a GROUP BY id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM r JOIN o USING (id), h
"""


@query("op12_vector_codes", code_sql())
def op12(spark, sf_dir):
    from gridspark.llm.codes import compress

    found = compress(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "code", "error", "label_error", F.sha2(F.col("codebooks").cast("binary"), 256).alias("codebooks_sha256"))
