"""The registered queries of the corpus operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewatch.llm import chat, decontaminate, html, langid, lm, media, merkle, mixing, neardup, substring_dedup, suffix_dedup, toxicity, whitening
from framewatch.llm.common import bucket_of, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return put


CHAT_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
marks(mark) AS (VALUES ('<<SYS>>'), ('<</SYS>>'), ('[INST]'), ('[/INST]'), ('<s>'), ('</s>'), ('<<TURN>>'), ('<<IS>>'), ('<</TURN>>')),
sized AS (
  SELECT t.*, length(text) + (length(text) - length(replace(text, '\', '')))
    + (SELECT sum((length(t.text) - length(replace(t.text, mark, ''))) // length(mark)) FROM marks)
    + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7
      ELSE 23 + length(role) + (length(role) - length(replace(role, '\', '')))
        + (SELECT sum((length(t.role) - length(replace(t.role, mark, ''))) // length(mark)) FROM marks) END AS size
  FROM turns t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  CAST(sum(size) AS BIGINT) AS formatted_chars,
  regexp_full_match(string_agg(CASE role WHEN 'system' THEN 'S' WHEN 'user' THEN 'U' WHEN 'assistant' THEN 'A' ELSE 'X' END, '' ORDER BY turn NULLS FIRST, role, text), 'S?(UA)+') AS valid
FROM sized GROUP BY conv_id
"""


@query("op2_chat_format", CHAT_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats all conversations plus conversation -7, and reads turns and loss texts back from the output; valid says whether the roles came in order."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(probe).alias("text")) for i, r in enumerate(("user", "assistant"))))).alias("t")).select("t.*")
    out = chat.format_turns(turns.unionByName(extra))
    back = out.select(
        "conv_id",
        "valid",
        chat.read_turns(F.col("formatted")).alias("turns"),
        F.array_join(chat.loss_texts(F.col("formatted"), F.col("loss_spans")), "").alias("loss"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
        "valid",
    )


SUBSTRING_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i+12], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
m AS (SELECT k, min(doc_id) AS d FROM g GROUP BY k),
bad AS (SELECT DISTINCT doc_id, i + o AS p FROM g JOIN m USING (k), range(0, 13) t(o) WHERE m.d < g.doc_id),
x AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
r AS (SELECT x.doc_id, count(*) AS n, count(bad.p) AS gone, string_agg(CASE WHEN bad.p IS NULL THEN word END, ' ' ORDER BY x.p) AS kept
      FROM x LEFT JOIN bad ON x.doc_id = bad.doc_id AND x.p = bad.p GROUP BY x.doc_id)
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_words, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN r USING (doc_id)
"""


@query("op3_substring_dedup", SUBSTRING_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every whole text, less those in 13-word windows that a document with a smaller id has too."""
    return substring_dedup.digest(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op9_media_columns")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text stored as PNG, read back from the stored bytes, with digests and a cosine hash."""
    return media.features(media.store(table(spark, sf_dir, "documents").select("doc_id", "text")))


@query("op1_language_id")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text, learned from documents whose bucket of four is not 2."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", bucket_of("doc_id", 4) == 2)
    langs, p = langid.fit(docs.filter("not held_out"))
    return langid.predict(docs, langs, p, keys=("doc_id", "held_out"))


@query("op5_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score of every whole text, learned from labelled documents whose bucket of three is not 1."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", bucket_of("doc_id", 3) == 1)
    lexicon = toxicity.fit(toxicity.labelled_sample(docs.filter("not held_out"), table(spark, sf_dir, "labels")))
    scored = toxicity.score(docs, lexicon, ["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


@query("op4_html_extract")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html.extract(table(spark, sf_dir, "pages"))


@query("op8_decontaminate")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document and benchmark item of which the document holds a passage, with its edits and place in words."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


JACCARD_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))
  WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n, list_sort(list(g)) AS gs FROM s GROUP BY doc_id),
copies AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY gs) AS copy_of FROM n),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9),
r(doc_id, class_id) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.class_id FROM r JOIN l ON l.a = r.doc_id)
SELECT d.doc_id, (SELECT min(class_id) FROM r WHERE r.doc_id = d.doc_id) AS class_id, coalesce(copy_of, d.doc_id) AS copy_of, (SELECT count(*) FROM l WHERE l.a = d.doc_id) AS n_links
FROM documents d LEFT JOIN copies c ON c.doc_id = d.doc_id
"""


@query("op6_ngram_jaccard_join", JACCARD_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of near duplicates (five-word shingles, Jaccard 0.8) and its number of links."""
    return neardup.classes(table(spark, sf_dir, "documents"))


@query("op7_lm_score")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recurrent-network and unigram log10 probabilities of every whole text, learned from documents whose bucket of five is not 1."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", bucket_of("doc_id", 5) == 1)
    model, counted = lm.fit(docs.filter("not held_out"))
    return lm.score(docs, model, counted)


@query("op10_source_mixing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its expected domain posterior and the rate that brings all domains to their targets."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = mixing.fit(mixing.labelled_domains(docs, table(spark, sf_dir, "labels")))
    return mixing.mix_to_targets(docs, model, mixing.even_languages(model.domains), ["doc_id"])


MERKLE_SQL = r"""
WITH RECURSIVE bits AS (SELECT doc_id, source, lang, n_chars, text, coalesce(CAST(doc_id AS VARCHAR), '') AS id FROM documents),
crc AS (SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(id) + 1), lambda i: CAST(ascii(substr(id, i, 1)) AS BIGINT))),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [CAST(0 AS BIGINT) FOR k IN range(8)]), lambda x, z: xor(x >> 1, (x & 1) * CAST(3988292384 AS BIGINT)))), CAST(4294967295 AS BIGINT)) AS c FROM bits),
leaves AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, sha256(head || t) AS leaf, sha256(head || CASE WHEN c % 3 = 0 THEN translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE t END) AS other
  FROM (SELECT *, coalesce(strlen(id) || ':' || CAST(doc_id AS VARCHAR), '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
      || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-') AS head, coalesce(strlen(text) || ':' || text, '-') AS t FROM crc)),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM leaves),
low(level, tree, place, h) AS (SELECT 0, tree, place, leaf FROM placed
  UNION ALL (SELECT level + 1, tree, place // 8, sha256(string_agg(h, '' ORDER BY place)) FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM low) WHERE n > 1 GROUP BY level, tree, place // 8)),
tops AS (SELECT tree, max(level) AS top FROM low GROUP BY tree),
subs AS (SELECT low.tree, h, row_number() OVER (ORDER BY encode(low.tree)) - 1 AS place FROM low JOIN tops ON low.tree = tops.tree AND low.level = top),
high(level, place, h) AS (SELECT 0, place, h FROM subs
  UNION ALL (SELECT level + 1, place // 8, sha256(string_agg(h, '' ORDER BY place)) FROM (SELECT *, count(*) OVER () AS n FROM high) WHERE n > 1 GROUP BY level, place // 8)),
root AS (SELECT h FROM high WHERE level = (SELECT max(level) FROM high)),
runs AS (SELECT tree, level, place // 8 AS run, list(h ORDER BY place) AS hs FROM low GROUP BY ALL),
crown AS (SELECT level, place // 8 AS run, list(h ORDER BY place) AS hs FROM high GROUP BY ALL),
walk(doc_id, n, level, place, held, proof) AS (
  SELECT doc_id, (tree, place), 0, place, other, '' FROM placed
  UNION ALL SELECT w.doc_id, w.n, w.level + 1, w.place // 8, sha256(array_to_string(hs[:w.place % 8], '') || held || array_to_string(hs[w.place % 8 + 2:], '')),
    proof || array_to_string(hs[:w.place % 8], '') || array_to_string(hs[w.place % 8 + 2:], '')
  FROM walk w JOIN runs r ON r.tree = w.n[1] AND r.level = w.level AND r.run = w.place // 8 JOIN tops t ON t.tree = r.tree WHERE w.level < top),
ended AS (SELECT w.doc_id, w.n, subs.place, subs.h AS subroot, held, proof FROM walk w JOIN tops ON tops.tree = w.n[1] AND w.level = top JOIN subs ON subs.tree = tops.tree),
climb(doc_id, n, subroot, level, place, held, proof) AS (
  SELECT doc_id, n, subroot, 0, place, held, proof FROM ended
  UNION ALL SELECT c.doc_id, c.n, subroot, c.level + 1, c.place // 8, sha256(array_to_string(hs[:c.place % 8], '') || held || array_to_string(hs[c.place % 8 + 2:], '')),
    proof || array_to_string(hs[:c.place % 8], '') || array_to_string(hs[c.place % 8 + 2:], '')
  FROM climb c JOIN crown r ON r.level = c.level AND r.run = c.place // 8 WHERE c.level < (SELECT max(level) FROM high))
SELECT p.doc_id, p.leaf, c.subroot, root.h AS root, sha256(c.proof) AS proof_sha256, c.held AS folded_root, c.held = root.h AS verified
FROM climb c JOIN placed p ON c.n = (p.tree, p.place) CROSS JOIN root WHERE c.level = (SELECT max(level) FROM high)
"""


@query("op13_merkle_manifest", MERKLE_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaf, the roots and the proof of every document, and the root that a leaf of a changed text leads to."""
    docs = table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    other = F.when(bucket_of("doc_id", 3) == 0, merkle.leaf(*fields, merkle.lowered(F.col("text")))).otherwise(merkle.leaf(*fields, F.col("text")))
    leaves = docs.select("doc_id", "lang", merkle.leaf(*fields, F.col("text")).alias("leaf"), other.alias("other"))
    out = merkle.manifest(leaves, "lang", [F.col("doc_id")], "leaf")
    folded = merkle.fold(F.col("other"), F.col("path"))
    out = out.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("path")), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


@query("op11_embedding_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable embedding on the first four whitened components of the distinct ones."""
    rows = table(spark, sf_dir, "embeddings").filter(whitening.usable("embedding")).select("vec_id", whitening.scaled("embedding").alias("x"))
    return whitening.whiten(rows, whitening.fit(rows))


SUFFIX_SQL = r"""
WITH b AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
c AS (SELECT r, g, substr(x, 2 * g + 1, 2 * 1399) AS y FROM (SELECT r, x, unnest(range(0, greatest(length(x) // 2 - 399, 0), 1000)) AS g FROM b)),
w AS (SELECT r, g + o AS i, md5(substr(y, 2 * o + 1, 800)) AS k FROM (SELECT r, g, y, unnest(range(0, least(1000, length(y) // 2 - 399))) AS o FROM c)),
bad AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS p FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
runs AS (SELECT r, i, sum(CASE WHEN p IS NULL OR i > p + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS run FROM bad),
spans AS (SELECT r, run, min(i) AS s, max(i) + 400 AS e FROM runs GROUP BY r, run),
edges AS (SELECT r, s, e, lag(e, 1, 0) OVER (PARTITION BY r ORDER BY s) AS q, run = max(run) OVER (PARTITION BY r) AS last FROM spans),
cut AS (SELECT r, count(*) AS n, sum(e - s) AS gone, string_agg(substr(x, 2 * q + 1, 2 * (s - q)) || CASE WHEN last THEN substr(x, 2 * e + 1) ELSE '' END, '' ORDER BY s) AS kept FROM edges JOIN b USING (r) GROUP BY r)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM b LEFT JOIN cut USING (r)
"""


@query("op12_suffix_dedup", SUFFIX_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every whole text, less those in 400-byte strings that start anywhere else too."""
    out = suffix_dedup.cut(table(spark, sf_dir, "documents").select("doc_id", "text"))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
