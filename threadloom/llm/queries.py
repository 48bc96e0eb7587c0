"""The thin query of each operator, over whole tables, and SQL where it can say the same."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, line_dedup, merkle, minhash, mixing, pieces, quadratic, quality_rules, substring_dedup, suffix_tree, token_counts, toxicity, vector_codes
from .core import table


def _sha(column: str):
    return F.sha2(F.col(column).cast("binary"), 256)


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    fold = quadratic.fold(F.col("doc_id"), 4)
    model = toxicity.train(docs, labels, training=fold != 2)
    out = toxicity.score(docs, model)
    return out.select("doc_id", (F.coalesce(fold, F.lit(-1)) == 2).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "n_terms")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_plan(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    tokenizers = {"words": None, "byte_bpe_50k": (public_tokenizers.PATTERN, public_tokenizers.path("byte_bpe_50k.tiktoken"))}
    rollup = token_counts.TokenRollup(spark, tokenizers)
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    # First lines come in first, with the benchmark among them; then whole texts revise them and the benchmark goes.
    low = (docs.agg(F.min("doc_id")).first()[0] or 0) - 1
    stray = table(spark, sf_dir, "benchmark").select((F.lit(low) - F.col("item_id")).alias("doc_id"), F.lit("benchmark").alias("source"), F.lit("en").alias("lang"), "text")
    early = docs.withColumn("text", F.substring_index("text", "\n", 1)).union(stray)
    late = docs.withColumn("op", F.lit("revise")).union(stray.withColumn("op", F.lit("delete")))
    rollup.commit("first lines", early.withColumn("op", F.lit("insert")))
    for _ in range(2):  # sent twice, counted once
        rollup.commit("whole texts", late)
    return rollup.totals()


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"), hash_all=True)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = pieces.encode_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), as_text=True)
    return out.select("doc_id", "n_tokens", _sha("ids").alias("ids_sha256"), _sha("decoded").alias("decoded_sha256"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", _sha("text").alias("kept_sha256"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    fold = quadratic.fold(F.col("doc_id"), 3)
    out = quadratic.classify(docs, labels, training=fold != 1)
    return out.select("doc_id", (F.coalesce(fold, F.lit(-1)) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", _sha("text").alias("kept_sha256"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, merkle.leaf(*(lower if c == "text" else F.col(c) for c in merkle.FIELDS)))
    out = merkle.build(docs, claim=tampered).audit()
    return out.withColumnRenamed("id", "doc_id").withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", F.coalesce(quadratic.fold(F.col("doc_id"), 7), F.lit(-1)) == 2)
    model = suffix_tree.train(docs, training=~F.col("held_out"))
    out = suffix_tree.score(docs, model)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = vector_codes.compress(table(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6, scale=4096)
    return out.select(F.col("id").alias("vec_id"), "code", "error", "label_error", "codebooks_sha256")


QUERIES = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_mixing": op3_mixing,
    "op4_token_counts": op4_token_counts,
    "op5_quality_rules": op5_quality_rules,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_line_dedup": op10_line_dedup,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_suffix_tree": op12_suffix_tree,
    "op13_vector_codes": op13_vector_codes,
}

#: Shared by the SQL below: the white space of all contracts, and A-Z lower-cased.
_SPACE = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"



def _merkle_sql(depth: int = 8) -> str:
    """SQL of the manifest for trees of up to 8**depth leaves: a table for each level, then proofs and claims walked up."""
    H = lambda text: "concat(" + ", ".join(f"coalesce(strlen({c})::VARCHAR || ':' || {c}, '-')" for c in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)) + ")"
    crc = "xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, (a & 1) * 3988292384) END), 4294967295)"
    parts = [
        f"""c AS (SELECT doc_id, lang, sha256({H("text")}) AS leaf, CASE WHEN doc_id IS NOT NULL AND {crc} % 3 = 0 THEN sha256({H(_LOWER.format("text"))}) END AS claim FROM documents)""",
        "d AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM c)",
        "l0 AS (SELECT 0 AS g, lang, i, leaf AS h, count(*) OVER (PARTITION BY lang) AS n FROM d)",
        "w0 AS (SELECT doc_id, lang, i, leaf, coalesce(claim, leaf) AS f, '' AS s FROM d)",
    ]

    def up(k: int, key: str, to: str) -> list[str]:
        """One level: runs, and each row's siblings and fold; a tree of one node stays as it is."""
        a, b = f"l{k}", f"l{k + 1}"
        return [
            f"r{k} AS (SELECT {key}, i // 8 AS i, any_value(n) AS n, list(h ORDER BY i) AS hs FROM {a} GROUP BY {key}, i // 8)",
            f"{b} AS (SELECT {to}, i, CASE WHEN n = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h, (n + 7) // 8 AS n FROM r{k})",
            f"w{k + 1} AS (SELECT w.* REPLACE (w.i // 8 AS i, CASE WHEN r.n = 1 THEN w.f ELSE sha256(array_to_string(r.hs[1:(w.i % 8)], '') || w.f || array_to_string(r.hs[(w.i % 8 + 2):8], '')) END AS f, w.s || array_to_string(r.hs[1:(w.i % 8)], '') || array_to_string(r.hs[(w.i % 8 + 2):8], '') AS s) FROM w{k} w JOIN r{k} r ON r.i = w.i // 8" + (" AND r.lang IS NOT DISTINCT FROM w.lang)" if "lang" in key else ")"),
        ]

    for k in range(depth):
        parts += up(k, "g, lang", "g, lang")
    parts += [
        f"t AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM l{depth})",
        f"l{depth + 1} AS (SELECT 0 AS g, i, subroot AS h, n FROM t)",
        f"w{depth + 1} AS (SELECT w.* REPLACE (t.i AS i), t.subroot FROM w{depth} w JOIN t ON t.lang IS NOT DISTINCT FROM w.lang)",
    ]
    for k in range(depth + 1, depth + 4):
        parts += up(k, "g", "g")
    e = depth + 4
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, leaf, subroot, h AS root, sha256(s) AS proof_sha256, f AS folded_root, f = h AS verified FROM w{e} CROSS JOIN l{e}"


def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """SQL of the vector codes: a table of parts, one of entries for each round."""
    near = "SELECT rid, p, arg_min(e, d * 64 + e) AS e, min(d) AS d FROM (SELECT x.rid, x.p, b.e, list_sum(list_transform(list_zip(x.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM x JOIN b{k} b ON b.p = x.p) GROUP BY rid, p"
    out = [
        "v AS (SELECT vec_id, label, list_transform(embedding, lambda y: floor(4096 * y::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0)",
        "r AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY vec_id) AS rid FROM v)",
        f"x AS MATERIALIZED (SELECT rid, p, v[(p * len(v) // {parts} + 1):((p + 1) * len(v) // {parts})] AS x FROM r, range({parts}) t(p))",
        f"b0 AS MATERIALIZED (SELECT p, rid - 1 AS e, x FROM x WHERE rid <= {entries})",
    ]
    for k in range(rounds):
        out.append(f"a{k} AS MATERIALIZED ({near.format(k=k)})")
        out.append(f"u{k} AS (SELECT p, e, list(m ORDER BY j) AS x FROM (SELECT x.p, a.e, j, (sum(x.x[j])::BIGINT - ((sum(x.x[j])::BIGINT % count(*)) + count(*)) % count(*)) // count(*) AS m FROM x JOIN a{k} a ON a.rid = x.rid AND a.p = x.p, range(1, len(x.x) + 1) t(j) GROUP BY ALL) GROUP BY p, e)")
        out.append(f"b{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(u.x, b.x) AS x FROM b{k} b LEFT JOIN u{k} u ON u.p = b.p AND u.e = b.e)")
    out += [
        f"a AS MATERIALIZED ({near.format(k=rounds)})",
        "c AS (SELECT rid, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a GROUP BY rid)",
        f"s AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})",
    ]
    return "WITH " + ",\n".join(out) + "\nSELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM c JOIN r ON r.rid = c.rid CROSS JOIN s"


ORACLE_SQL = {
    "op1_minhash_dedup": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
sets AS (SELECT doc_id, md5(string_agg(g, chr(10) ORDER BY g)) AS d FROM s GROUP BY doc_id),
reps AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY d) AS rep FROM sets),
r AS (SELECT s.* FROM s JOIN reps ON s.doc_id = reps.doc_id AND reps.rep = reps.doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS x FROM r a JOIN r b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (
  SELECT a, b FROM pair JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * x >= 85 * (na.n + nb.n - x)
  UNION SELECT rep, doc_id FROM reps WHERE rep <> doc_id),
two AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT a AS node, a AS root FROM two UNION SELECT two.b, reach.root FROM reach JOIN two ON two.a = reach.node WHERE two.b > reach.root),
comp AS (SELECT node, min(root) AS root FROM reach GROUP BY node)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(comp.root, w.doc_id) AS component_id, coalesce(comp.root, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN comp ON comp.node = w.doc_id""",
    "op6_exact_dedup": r"""
WITH x AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS s, length(coalesce(text, '')) AS n FROM documents),
y AS (
  SELECT doc_id, first_value(doc_id) OVER (PARTITION BY s ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY s) AS group_size, s FROM x)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, s AS text_sha256 FROM y""",
    "op10_line_dedup": f"""
WITH x AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT *, {_LOWER.format(f"trim(l, {_SPACE})")} AS k FROM x),
c AS (SELECT k, min(doc_id) AS m FROM k WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1),
y AS (SELECT k.doc_id, l, i, c.m IS NOT NULL AND c.m <> k.doc_id AS gone FROM k LEFT JOIN c ON c.k = k.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM y GROUP BY doc_id""",
    "op8_substring_dedup": rf"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
x AS (SELECT doc_id, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS i FROM d),
s AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS i, w FROM d WHERE len(w) >= 35),
h AS (SELECT doc_id, i, array_to_string(w[i:i+34], ' ') AS g FROM s),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY g) > 1 AS twice FROM h),
c AS (
  SELECT x.doc_id, x.t, x.i, max(CASE WHEN r.twice THEN 1 ELSE 0 END) OVER (PARTITION BY x.doc_id ORDER BY x.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone
  FROM x LEFT JOIN r ON r.doc_id = x.doc_id AND r.i = x.i),
o AS (SELECT doc_id, sum(gone)::BIGINT AS n_removed, string_agg(t, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(o.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(o.kept, '')) AS kept_sha256
FROM d LEFT JOIN o ON o.doc_id = d.doc_id""",
    "op11_merkle_manifest": _merkle_sql(),
    "op13_vector_codes": _codes_sql(),
}
