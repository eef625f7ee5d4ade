"""The operators as queries over the supplied tables, with SQL where it can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codesift.llm import (
    embeddings, fill_middle, fingerprints, language, line_dedup, manifest, mixing, near_dedup, quality, rule_ledger, sentencepiece, sharding, toxicity,
)
from codesift.session import durable

#: Environment variable with the SentencePiece model; without it the installed public one.
MODEL_VARIABLE = "SENTENCEPIECE_MODEL"


def sentencepiece_model() -> str:
    if path := os.environ.get(MODEL_VARIABLE):
        return path
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learned from those whose crc32 of doc_id (none: of an empty text) is not 1 mod 3."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")) % 3 == 1
    model = language.fit(docs.where(~held_out).select("text", "lang"))
    found = docs.select("doc_id", held_out.alias("held_out"), language.predict(F.col("text"), model).alias("_p"))
    return found.select("doc_id", "held_out", "_p.lang_pred", "_p.score")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edits(table(spark, sf_dir, "documents"))


def op2_located_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removed, added and moved paragraphs; beside op2_fingerprints, whose columns are those of its SQL."""
    return fingerprints.locate_edits(table(spark, sf_dir, "documents"))


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("repeats")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned text of every document and how many of its lines went."""
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_deleted")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = sentencepiece.encode(table(spark, sf_dir, "documents"), sentencepiece_model())
    return digests(coded)


def digests(coded: DataFrame) -> DataFrame:
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of the chain over the labels' two categories, low quality and toxic, for every document."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    chain = {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1}
    return toxicity.classify(docs, toxicity.fit(docs, labels, chain))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.resample(docs, quality.fit(docs, table(spark, sf_dir, "labels")))[0]


def op11_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements, failure bits and the verdict of the latest policy for every document.

    Extra columns: fail_bits, policy, sole_rule (the one rule that rejects the document),
    regained (documents of the table that the policy would keep without that rule).
    """
    ledger = durable(rule_ledger.record(rule_ledger.measure(table(spark, sf_dir, "documents"))))
    policy = rule_ledger.POLICIES[-1]
    judged = rule_ledger.apply_policy(ledger, policy).withColumn("base_failed", rule_ledger.failed(rule_ledger.BASE) != 0)
    # One row per rule of the policy.
    regained = rule_ledger.ablations(ledger, (policy,)).select(F.col("rule").alias("sole_rule"), "regained")
    return judged.join(F.broadcast(regained), "sole_rule", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "fail_bits", "policy", "sole_rule", "regained",
    )


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proof of every document in the manifest, checked against a copy in which every seventh is tampered with."""
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    hit = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 7 == 0
    tampered = manifest.leaf_digest([F.col(c) + 1 if c == "n_chars" else F.col(c) for c in fields])
    leaves = table(spark, sf_dir, "documents").select(
        F.col("lang").alias("group"), F.col("doc_id").alias("key"), manifest.leaf_digest([F.col(c) for c in fields]).alias("digest"), F.when(hit, tampered).alias("tampered")
    )
    proofs = manifest.prove(leaves).withColumn("folded_root", manifest.fold(F.coalesce("tampered", "digest"), F.col("path")))
    return proofs.select(
        F.col("key").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root", manifest.proof_digest(F.col("path")).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    restored = fill_middle.restore(F.col("output"), F.col("form"))
    return cut.select(
        "doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language, op2_fingerprints, op3_minhash_dedup, op4_sharding, op5_mixing, op6_line_dedup,
        op7_sentencepiece, op8_embedding_dedup, op9_toxicity, op10_quality, op11_rule_ledger, op12_manifest, op13_fill_middle,
    )
}

#: Further results of the operators, without SQL.
MORE: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op2_located_edits": op2_located_edits}

#: A tree in SQL: sentence, paragraph, section and root digests of the text column ``t``.
_TREE = rf"""
    list_transform(flatten(list_transform(string_split(replace(replace(replace(p, '. ', '. ' || chr(10)), '! ', '! ' || chr(10)), '? ', '? ' || chr(10)), chr(10)),
     lambda s: CASE WHEN s = '' THEN [s] ELSE regexp_extract_all(s, '{fingerprints.CUT}') END)), lambda s: sha256(s))"""


def _tree_sql(text: str, name: str) -> str:
    leaves = f"list_transform(string_split({text}, chr(10)), lambda p: {_TREE.strip()})"
    return f"{leaves} AS {name}_leaves"


def _root_sql(name: str) -> str:
    paragraphs = f"list_transform({name}_leaves, lambda l: sha256(array_to_string(l, ',')))"
    joined = f"array_to_string({paragraphs}, ';')"
    for end in "0123":
        joined = f"replace({joined}, '{end};', '{end}|')"
    return f"sha256(array_to_string(list_transform(string_split({joined}, '|'), lambda s: sha256(s)), '/'))"


def _like_sql(a: str, b: str) -> str:
    x, y = f"flatten({a}_leaves)", f"flatten({b}_leaves)"
    return (
        f"CASE WHEN {_root_sql(a)} = {_root_sql(b)} THEN 1.0::DOUBLE ELSE "
        f"2.0::DOUBLE * len(list_intersect({x}, {y})) / (len(list_distinct({x})) + len(list_distinct({y}))) END"
    )


def _field_sql(value: str) -> str:
    return f"coalesce(strlen(({value})::VARCHAR) || ':' || ({value})::VARCHAR, '-')"


#: A leaf, the crc32 of a text, the next level of a list of nodes, and the side and sibling of position {pos}, in SQL.
_LEAF = f"sha256({' || '.join(_field_sql(c) for c in ('doc_id', 'source', 'lang', '{n_chars}', 'text'))})"
_CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({text}) + 1), lambda i: ascii(({text})[i])::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT)"""
_PAIRS = "list_transform(range(0, (len(l) + 1) // 2), lambda i: sha256(l[2 * i + 1] || coalesce(l[2 * i + 2], '')))"
_SIBLING = "CASE WHEN ({pos} >> k) & 1 = 1 THEN 'L' || l[({pos} >> k)] ELSE 'R' || coalesce(l[({pos} >> k) + 2], '') END"

ORACLES: dict[str, str] = {
    "op2_fingerprints": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, coalesce(lead(t) OVER w, first_value(t) OVER w) AS u FROM d WINDOW w AS (ORDER BY doc_id DESC)),
e AS (SELECT *, left(t, (length(t) - length(t) // 2)::BIGINT) || left(u, (length(t) // 2)::BIGINT) AS x FROM n),
l AS (SELECT *, {_tree_sql("t", "own")}, {_tree_sql("x", "edited")}, {_tree_sql("u", "next")} FROM e)
SELECT doc_id, length(t)::BIGINT AS n_chars, sha256(x) AS edited_sha256, {_root_sql("own")} AS fingerprint,
  {_root_sql("edited")} AS edited_fingerprint, {_like_sql("own", "edited")} AS near_edited, {_like_sql("own", "next")} AS near_next
FROM l""",
    "op5_mixing": r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
  md5('mix/' || doc_id::VARCHAR) AS ord FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS ss FROM d GROUP BY source),
r AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, 2.0::DOUBLE * ss AS cap FROM s),
o AS (SELECT *, sum(cap) OVER b - cap AS before, sum(w) OVER a AS open FROM r
  WINDOW b AS (ORDER BY cap / w, source NULLS LAST), a AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
v AS (SELECT *, ((SELECT sum(ss) FROM s)::DOUBLE * 1.5 - before) / open AS level FROM o),
f AS (SELECT max(level) AS level FROM v),
g AS (SELECT source, ss, least(cap, f.level * w) AS target FROM r, f),
h AS (SELECT *, floor(target / greatest(ss, 1))::BIGINT AS whole FROM g),
c AS (SELECT d.*, h.ss, h.target, h.whole, h.target - h.whole * h.ss AS rest,
  sum(size) OVER (PARTITION BY d.source ORDER BY ord) AS upto FROM d JOIN h ON d.source IS NOT DISTINCT FROM h.source)
SELECT doc_id, source, size, ss AS source_size, target,
  (size * (whole + CASE WHEN rest > 0 AND upto - size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM c""",
    "op6_line_dedup": r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
x AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS no FROM d),
y AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w FROM x),
z AS (SELECT *, row_number() OVER p AS i, sum(w) OVER p AS e FROM y WHERE w > 0 WINDOW p AS (PARTITION BY doc_id ORDER BY no)),
m AS (SELECT doc_id, list(line ORDER BY i) AS ls FROM z GROUP BY doc_id),
p AS (SELECT a.doc_id, a.i AS lo, min(b.i) AS hi FROM z a JOIN z b ON a.doc_id = b.doc_id AND b.i BETWEEN a.i AND a.i + 49 AND b.e - a.e + a.w >= 50 GROUP BY ALL
  UNION SELECT b.doc_id, max(a.i), b.i FROM z a JOIN z b ON a.doc_id = b.doc_id AND b.i BETWEEN a.i AND a.i + 49 AND b.e - a.e + a.w >= 50 GROUP BY b.doc_id, b.i),
q AS (SELECT p.*, row_number() OVER (PARTITION BY ls[lo:hi] ORDER BY p.doc_id, lo) AS k FROM p JOIN m USING (doc_id)),
g AS (SELECT DISTINCT z.doc_id, z.no FROM q JOIN z ON z.doc_id = q.doc_id AND z.i BETWEEN lo AND hi WHERE k > 1),
t AS (SELECT y.doc_id, string_agg(line, chr(10) ORDER BY y.no) FILTER (g.no IS NULL) AS kept, count(g.no) AS gone, count(*) AS n
  FROM y LEFT JOIN g ON g.doc_id = y.doc_id AND g.no = y.no GROUP BY y.doc_id)
SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE coalesce(kept, '') END AS text, coalesce(n, 0)::INTEGER AS n_lines, coalesce(gone, 0)::INTEGER AS n_deleted
FROM d LEFT JOIN t USING (doc_id)""",
    "op11_rule_ledger": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
b AS (SELECT r, doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
  list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: array_to_string(w[i:i+2], ' ')) AS g FROM d),
x AS (SELECT r, unnest(g) AS g, generate_subscripts(g, 1) AS i FROM b),
y AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM x),
z AS (SELECT r, count(DISTINCT i + k)::BIGINT AS n FROM y, (VALUES (0), (1), (2)) AS v(k) WHERE n > 1 GROUP BY r),
m AS (SELECT b.*, len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(z.n, 0) AS n_repeat_words FROM b LEFT JOIN z USING (r)),
f AS (SELECT *, (n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (10 * n_symbols > n_words)::INT + 8 * (2 * n_dup_lines > n_lines)::INT
  + 16 * (word_chars < 2 * n_words)::INT + 32 * (word_chars > 20 * n_words)::INT AS bits FROM m),
s AS (SELECT *, CASE bits WHEN 1 THEN 'few_words' WHEN 2 THEN 'repeated_words' WHEN 4 THEN 'symbols' WHEN 8 THEN 'repeated_lines' WHEN 16 THEN 'short_words' WHEN 32 THEN 'long_words' END AS sole_rule FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, bits & 3 <> 0 AS base_failed, bits = 0 AS kept, bits::BIGINT AS fail_bits,
  'clean@2' AS policy, sole_rule, CASE WHEN sole_rule IS NOT NULL THEN count(*) OVER (PARTITION BY sole_rule) END AS regained FROM s""",
    "op12_manifest": rf"""
WITH RECURSIVE d AS (SELECT *, {_LEAF.format(n_chars="n_chars")} AS leaf, {_LEAF.format(n_chars="n_chars + 1")} AS odd, {_CRC32.format(text="doc_id::VARCHAR")} % 7 = 0 AS hit,
  row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM documents),
lv(lang, k, l) AS (SELECT lang, 0, list(leaf ORDER BY pos) FROM d GROUP BY lang
  UNION ALL SELECT lang, k + 1, {_PAIRS} FROM lv WHERE len(l) > 1),
subs AS (SELECT lang, l[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM lv WHERE len(l) = 1),
tops(k, l) AS (SELECT 0, list(subroot ORDER BY tree) FROM subs UNION ALL SELECT k + 1, {_PAIRS} FROM tops WHERE len(l) > 1),
low AS (SELECT doc_id, leaf, list({_SIBLING.format(pos="pos")} ORDER BY k) AS path FROM d JOIN lv ON d.lang IS NOT DISTINCT FROM lv.lang WHERE len(l) > 1 GROUP BY doc_id, leaf),
high AS (SELECT lang, list({_SIBLING.format(pos="tree")} ORDER BY k) AS path FROM subs, tops WHERE len(l) > 1 GROUP BY lang),
p AS (SELECT d.*, subroot, (SELECT l[1] FROM tops WHERE len(l) = 1) AS root, list_concat(coalesce(low.path, []), coalesce(high.path, [])) AS path
  FROM d JOIN subs ON d.lang IS NOT DISTINCT FROM subs.lang LEFT JOIN low ON d.doc_id IS NOT DISTINCT FROM low.doc_id AND d.leaf = low.leaf LEFT JOIN high ON d.lang IS NOT DISTINCT FROM high.lang),
f AS (SELECT *, list_reduce(list_prepend(CASE WHEN hit THEN odd ELSE leaf END, path), lambda a, x: sha256(CASE x[1] WHEN 'L' THEN x[2:] || a ELSE a || x[2:] END)) AS folded FROM p)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda x: x[2:]), '')) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM f""",
    "op13_fill_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
n AS (SELECT *, length(t)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM n),
c AS (SELECT *, left(t, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM c""",
}
