"""The queries of the training-data operators, with SQL equivalents where SQL can say them."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import chat, decontaminate, extract, fingerprint, language, near_dup, packing, passages, quality, resample, sharding, spelling, token_output
from .common import Scratch, table
from .encode import tokenizer_path


def op1_token_output(spark, sf_dir):
    work = Scratch(spark, "op1")
    shards = work.save(token_output.encode_shards(table(spark, sf_dir, "documents"), tokenizer_path()), "shards")
    return token_output.read_back(shards)


def op2_packing(spark, sf_dir):
    work = Scratch(spark, "op2")
    return packing.pack(work.save(packing.cut(table(spark, sf_dir, "documents"), tokenizer_path()), "pieces"))


def op3_quality(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_decontaminate(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP4_SQL = r"""
WITH t AS (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
w AS (SELECT kind, id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM t),
s AS (SELECT DISTINCT kind, id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS s
      FROM (SELECT kind, id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT id, count(*) AS n FROM s WHERE kind = 'b' GROUP BY 1)
SELECT d.id AS doc_id, b.id AS item_id, n.n AS n_item_shingles, count(*) AS n_found, count(*) / n.n AS containment
FROM s b JOIN s d ON b.s = d.s AND b.kind = 'b' AND d.kind = 'd' JOIN n ON n.id = b.id
GROUP BY d.id, b.id, n.n HAVING 100 * count(*) >= 75 * n.n"""


def op5_near_dup(spark, sf_dir):
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END) AS s
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.k >= 75 * (x.n + y.n - p.k)),
r AS (SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id WHERE r.c < e.b)
SELECT d.doc_id, COALESCE(n.n, 0) AS n_shingles, m.c AS component_id, m.c = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(c) AS c FROM r GROUP BY 1) m ON m.id = d.doc_id"""


def op6_language(spark, sf_dir):
    return language.identify(table(spark, sf_dir, "documents"))


def op7_fingerprints(spark, sf_dir):
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op8_sharding(spark, sf_dir):
    """Writes the shards, and returns their rows read back; bytes are counted in the text that was read."""
    work = Scratch(spark, "op8")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("_row", F.monotonically_increasing_id())
    assigned = sharding.assign_shards(docs)
    sharding.write_shards(assigned, work.path("shards"), "_row")
    back = sharding.read_shards(spark, work.path("shards"), assigned.drop("_row").schema)
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    return back.select("doc_id", n_bytes, "shard_id", "shard_depth", "shard_bytes", "oversized")


OP8_SQL = f"""
WITH d AS (SELECT doc_id, CAST(COALESCE(octet_length(encode(text)), 0) AS BIGINT) AS n_bytes,
                  CAST('0x' || substr(md5(COALESCE(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM documents),
x AS (SELECT d.*, k.k AS depth, h >> (32 - k.k) AS p FROM d CROSS JOIN (SELECT unnest(range(0, 33)) AS k) k),
s AS (SELECT depth, p, sum(n_bytes) AS bytes, min(h) AS lo, max(h) AS hi FROM x GROUP BY ALL),
f AS (SELECT x.doc_id, x.h, x.n_bytes, min(s.depth) AS depth FROM x JOIN s USING (depth, p)
      WHERE s.bytes <= {sharding.LIMIT_BYTES} OR s.lo = s.hi GROUP BY ALL)
SELECT f.doc_id, f.n_bytes, 's' || substr(lpad(bin(f.h), 32, '0'), 1, f.depth) AS shard_id,
       CAST(f.depth AS INTEGER) AS shard_depth, CAST(s.bytes AS BIGINT) AS shard_bytes, s.bytes > {sharding.LIMIT_BYTES} AS oversized
FROM f JOIN s ON s.depth = f.depth AND s.p = f.h >> (32 - f.depth)"""


def op10_extract(spark, sf_dir):
    return extract.main_text(table(spark, sf_dir, "pages"))


def op9_chat(spark, sf_dir):
    said = "\\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    extra = spark.range(2).select(F.lit(-7).alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(said).alias("text"))
    extra = extra.select(*(F.col(f.name).cast(f.dataType) for f in rows.schema))
    work = Scratch(spark, "op9")
    written = work.save(chat.format_turns(rows.unionByName(extra)), "turns")
    examples = work.save(chat.examples(written), "examples")
    stream = written.select("conv_id", "seq", "start", "formatted")
    return chat.digest(chat.parse_turns(chat.with_examples(stream, examples)))


OP9_SQL = r"""
WITH c AS (SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, length('### ' || regexp_replace(role, '([\\#<:])', '\\\1', 'g') || ': ' || regexp_replace(text, '([\\#<])', '\\\1', 'g') || ' </turn>' || chr(10)) AS n FROM c),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
             COALESCE(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss, sum(n) AS f FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(f AS BIGINT) AS formatted_chars FROM g"""


def op11_spelling(spark, sf_dir):
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op12_passages(spark, sf_dir):
    left = passages.remove_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op13_resample(spark, sf_dir):
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _crc32(text: str) -> str:
    """SQL of the crc32 of a string's UTF-8 bytes; it needs the table ``crc(t)`` of :data:`CRC_TABLE` in its FROM clause."""
    hx = f"hex(encode({text}))"
    some = f"list_transform(range(0, length({hx}) // 2), lambda i: CAST('0x' || substr({hx}, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))"
    return f"xor(list_reduce([CAST(4294967295 AS BIGINT)] || {some}, lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1])), CAST(4294967295 AS BIGINT))"


CRC_TABLE = """crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END) AS c
       FROM (SELECT unnest(range(256)) AS i)))"""
_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11_SQL = rf"""
WITH RECURSIVE {CRC_TABLE},
r AS (SELECT doc_id, unnest(regexp_extract_all({_LOWERED}, '[a-z\x{{00C0}}-\x{{00FF}}]{{7,}}')) AS w FROM documents),
c AS (SELECT doc_id, w, count(*) AS k FROM r GROUP BY ALL),
h AS (SELECT w, k, {_crc32("COALESCE(CAST(doc_id AS VARCHAR), '') || ':' || w")} AS h FROM c, crc),
x AS (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, k FROM h),
v AS MATERIALIZED (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM x WHERE length(word) >= 7 GROUP BY 1 HAVING sum(k) >= 2),
d AS MATERIALIZED (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS (SELECT a.word AS a, b.word AS b FROM d a JOIN d b ON a.i = b.i AND a.d = b.d AND a.word <> b.word
      UNION SELECT d.word, v.word FROM d JOIN v ON d.d = v.word UNION SELECT v.word, d.word FROM d JOIN v ON d.d = v.word),
b AS (SELECT p.a AS word, count(*) AS n_near, min((-v.n, p.b)) AS best FROM p JOIN v ON v.word = p.b GROUP BY 1),
f AS MATERIALIZED (SELECT v.word, v.n, COALESCE(b.n_near, 0) AS n_near, CASE WHEN -b.best[1] >= 10 * v.n THEN b.best[2] END AS form, CASE WHEN -b.best[1] >= 10 * v.n THEN -b.best[1] END AS form_n
      FROM v LEFT JOIN b USING (word)),
t AS (SELECT word, form AS at FROM f WHERE form IS NOT NULL UNION ALL SELECT t.word, f.form FROM t JOIN f ON f.word = t.at WHERE f.form IS NOT NULL),
z AS (SELECT t.word, t.at FROM t JOIN f ON f.word = t.at WHERE f.form IS NULL)
SELECT f.word, f.form, COALESCE(z.at, f.word) AS root, f.n, f.n_near, f.form_n FROM f LEFT JOIN z USING (word)"""

OP12_SQL = r"""
WITH w AS (SELECT doc_id, COALESCE(list_filter(regexp_split_to_array(text, '[ 	
]+'), lambda x: x <> ''), []) AS w FROM documents),
h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS m FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) >= 50)),
g AS (SELECT h.doc_id, h.i FROM h JOIN (SELECT m, min(doc_id) AS first FROM h GROUP BY 1) f USING (m) WHERE f.first < h.doc_id),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM g),
p AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM w),
k AS (SELECT p.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY j) AS kept FROM p ANTI JOIN c ON p.doc_id = c.doc_id AND p.j = c.j GROUP BY 1)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(len(w.w) - COALESCE(k.n, 0) AS BIGINT) AS n_removed, sha256(COALESCE(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)"""

_OP13_WORDS = rf"regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP13_SQL = rf"""
WITH {CRC_TABLE},
d AS (SELECT doc_id, w, count(*) AS k FROM (SELECT doc_id, unnest({_OP13_WORDS}) AS w FROM documents) GROUP BY ALL),
b AS (SELECT w, count(*) AS k FROM (SELECT unnest({_OP13_WORDS}) AS w FROM benchmark) GROUP BY ALL),
v AS MATERIALIZED (SELECT w, {_crc32("w")} % 10000 AS bucket FROM (SELECT w FROM d UNION SELECT w FROM b), crc),
s AS (SELECT bucket, sum(k) AS s FROM d JOIN v USING (w) GROUP BY 1),
t AS (SELECT bucket, sum(k) AS t FROM b JOIN v USING (w) GROUP BY 1),
c AS (SELECT bucket, CAST(COALESCE(s, 0) AS DOUBLE) AS s, CAST(COALESCE(t, 0) AS DOUBLE) AS t FROM (SELECT unnest(range(10000)) AS bucket) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
g AS (SELECT bucket, CAST(floor(1000 * ln(((t + 1) * ((SELECT sum(s) FROM c) + 10000)) / ((s + 1) * ((SELECT sum(t) FROM c) + 10000)))) AS BIGINT) AS gain FROM c),
m AS (SELECT doc_id, CAST(sum(k) AS BIGINT) AS n, CAST(sum(k * gain) AS BIGINT) AS g FROM d JOIN v USING (w) JOIN g USING (bucket) GROUP BY 1),
x AS (SELECT doc_id, COALESCE(n, 0) AS n, CASE WHEN n > 0 THEN (g - ((g % n) + n) % n) // n ELSE 0 END
      + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score,
      CASE WHEN n > 0 THEN (g - ((g % n) + n) % n) // n ELSE 0 END AS weight FROM documents LEFT JOIN m USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM x WHERE n >= 20)
SELECT x.doc_id, CAST(x.n AS BIGINT) AS n_features, CAST(x.weight AS BIGINT) AS weight, CAST(x.score AS BIGINT) AS score, CASE WHEN r.rank <= r.n * 10 // 100 THEN r.rank END AS rank FROM x LEFT JOIN r USING (doc_id)"""


QUERIES = {
    "op1_token_output": op1_token_output,
    "op2_packing": op2_packing,
    "op3_quality": op3_quality,
    "op4_decontaminate": op4_decontaminate,
    "op5_near_dup": op5_near_dup,
    "op6_language": op6_language,
    "op7_fingerprints": op7_fingerprints,
    "op8_sharding": op8_sharding,
    "op9_chat": op9_chat,
    "op10_extract": op10_extract,
    "op11_spelling": op11_spelling,
    "op12_passages": op12_passages,
    "op13_resample": op13_resample,
}
ORACLES = {"op4_decontaminate": OP4_SQL, "op5_near_dup": OP5_SQL, "op8_sharding": OP8_SQL, "op9_chat": OP9_SQL, "op11_spelling": OP11_SQL, "op12_passages": OP12_SQL, "op13_resample": OP13_SQL}
