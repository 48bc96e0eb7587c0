"""Queries over threads, similarity, retrieval and sets; each with its SQL."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..operators import graph, modelcall, retrieval, similarity, threads
from ..operators import sampling as S
from ..schemas import DIMENSIONS
from ..session import cut, table
from . import fixtures as X
from . import pipelines
from .text_queries import _tokens

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def _turns(spark: SparkSession, d: str) -> DataFrame:
    """Turns as messages: user is inbound, the parent is the turn before. Ids are structs, as numbers of long conversations meet."""
    rows = table(spark, d, "conversations").where("role in ('user', 'assistant')")
    key = lambda turn: F.struct("conv_id", turn.cast("long").alias("turn"))
    return rows.select(key(F.col("turn")).alias("id"), key(F.col("turn") - 1).alias("parent_id"), (F.col("role") == "user").alias("inbound"), "text", F.col("turn").alias("ts"), "conv_id", "role")


def _number(key: Column) -> Column:
    """The number that the SQL shows for a turn; for output only, never to join by."""
    return key["conv_id"] * 1000 + key["turn"]


_TURNS = "(SELECT conv_id * 1000 + turn AS id, conv_id * 1000 + turn - 1 AS parent_id, role = 'user' AS inbound, text, turn AS ts, conv_id, role FROM conversations WHERE role IN ('user', 'assistant'))"


@query(f"""SELECT c.id AS customer_id, s.id AS support_id, c.text AS customer_text, s.text AS support_text FROM {_TURNS} s JOIN {_TURNS} c ON s.parent_id = c.id
  WHERE NOT s.inbound AND c.inbound AND s.ts >= c.ts""")
def reply_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs = threads.reply_pairs(_turns(spark, d))
    return pairs.withColumns({c: _number(F.col(c)) for c in ("customer_id", "support_id")})


@query("""
SELECT a.conv_id, a.turn, coalesce(string_agg(b.text, ' | ' ORDER BY b.turn), '') AS context, count(b.turn) AS n FROM conversations a
  LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn < a.turn AND b.turn >= a.turn - 4 GROUP BY a.conv_id, a.turn""")
def prior_context_last4(spark: SparkSession, d: str) -> DataFrame:
    """A frame by turn numbers: no conversation is gathered in one row, and each turn holds four others at most."""
    before = Window.partitionBy("conv_id").orderBy(F.col("turn").cast("long")).rangeBetween(-4, -1)
    near = F.array_sort(F.collect_list(F.struct("turn", "text")).over(before))
    turns = table(spark, d, "conversations").withColumn("near", near)
    return turns.select("conv_id", "turn", F.array_join(F.transform("near", lambda x: x["text"]), " | ").alias("context"), F.size("near").cast("long").alias("n"))


#: Turns whose time is odd in every fifth conversation, whose parent is gone in every eleventh, with our own chains of negative ids.
_CHAINS = f"""(SELECT -id AS id, -parent AS parent, ts FROM {X.values_sql(X.CHAINS, X.CHAIN_COLUMNS)} UNION ALL
  SELECT conv_id * 1000 + turn, CASE WHEN turn > 0 THEN conv_id * 1000 + turn - 1 END, CASE WHEN conv_id % 5 = 0 AND turn % 4 = 1 THEN 0 ELSE turn END FROM conversations WHERE NOT (conv_id % 11 = 0 AND turn = 1))"""


@query(f"""
WITH RECURSIVE r AS (SELECT id::BIGINT AS id, parent::BIGINT AS parent, ts::BIGINT AS ts FROM {_CHAINS}),
w AS (
  SELECT id, parent AS nxt, ts AS child_ts, [id] AS seen, []::BIGINT[] AS path, NULL::VARCHAR AS stop FROM r
  UNION ALL
  SELECT w.id, CASE WHEN s.k IS NULL THEN p.parent ELSE w.nxt END, p.ts, list_append(w.seen, w.nxt), CASE WHEN s.k IS NULL THEN list_prepend(w.nxt, w.path) ELSE w.path END, s.k
  FROM w LEFT JOIN r p ON p.id = w.nxt,
    LATERAL (SELECT CASE WHEN list_contains(w.seen, w.nxt) THEN 'cycle' WHEN p.id IS NULL THEN 'missing' WHEN p.ts > w.child_ts THEN 'conflict' END AS k) s
  WHERE w.nxt IS NOT NULL AND w.stop IS NULL)
SELECT id, array_to_string(path, '>') AS path, coalesce(stop = 'missing', false) AS missing_parent, coalesce(stop = 'cycle', false) AS cycle, coalesce(stop = 'conflict', false) AS timestamp_conflict
FROM w WHERE stop IS NOT NULL OR nxt IS NULL""")
def ancestor_chain(spark: SparkSession, d: str) -> DataFrame:
    own = X.rows(spark, X.CHAINS, X.CHAIN_COLUMNS).selectExpr("-id as id", "-parent as parent", "ts")
    turns = table(spark, d, "conversations").where("not (conv_id % 11 = 0 and turn = 1)")
    at = F.col("conv_id") * 1000 + F.col("turn")
    late = (F.col("conv_id") % 5 == 0) & (F.col("turn") % 4 == 1)
    rows = own.union(turns.select(at, F.when(F.col("turn") > 0, at - 1), F.when(late, 0).otherwise(F.col("turn")).cast("long")))
    out = graph.ancestor_chains(rows, rows.select("id"))
    return out.select("id", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"), "missing_parent", "cycle", "timestamp_conflict")


@query(f"""
WITH RECURSIVE t AS (SELECT * FROM {_TURNS}),
w AS (SELECT id, parent_id AS nxt, 0::BIGINT AS depth FROM t UNION ALL SELECT w.id, p.parent_id, w.depth + 1 FROM w JOIN t p ON p.id = w.nxt)
SELECT id, max(depth) AS depth FROM w GROUP BY id""")
def thread_depth(spark: SparkSession, d: str) -> DataFrame:
    rows = _turns(spark, d).select("id", F.col("parent_id").alias("parent"), "ts")
    return graph.ancestor_depths(rows).select(_number(F.col("id")).alias("id"), "depth")


@query("""SELECT conv_id, turn FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations WHERE role = 'assistant') AND conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')""")
def brand_semi_discovery_anti(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations")
    own = turns.where("role = 'assistant'").select("conv_id").distinct()
    found = turns.where("role = 'system'").select("conv_id").distinct()
    return turns.join(own, "conv_id", "left_semi").join(found, "conv_id", "left_anti").select("conv_id", "turn")


@query("""SELECT conv_id, bool_or(role = 'assistant') AS own, bool_or(role = 'system') AS other FROM conversations WHERE role <> 'user' GROUP BY conv_id""")
def multi_brand_flag(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").where("role <> 'user'")
    return rows.groupBy("conv_id").agg(F.bool_or(F.col("role") == "assistant").alias("own"), F.bool_or(F.col("role") == "system").alias("other"))


_EIGHT = "list_transform(range(1, len({w}) - 6), lambda i: md5(array_to_string({w}[i:i+7], ' ')))"


@query(f"""WITH d AS (SELECT {_tokens('text')} AS w FROM documents), q AS (SELECT {_tokens('text')} AS w FROM benchmark)
SELECT DISTINCT unnest({_EIGHT.format(w='w')}) AS h FROM d WHERE len(w) >= 8 INTERSECT SELECT unnest({_EIGHT.format(w='w')}) FROM q WHERE len(w) >= 8""")
def leak_check_intersect(spark: SparkSession, d: str) -> DataFrame:
    """Passages of eight words that documents and the benchmark share."""

    def passages(name: str) -> DataFrame:
        words = cut(table(spark, d, name).select(T.tokens(F.col("text")).alias("w")).where(F.size("w") >= 8), "words")
        windows = F.transform(F.sequence(F.lit(1), F.size("w") - 7), lambda i: F.md5(F.array_join(F.slice("w", i, 8), " ")))
        return words.select(F.explode(windows).alias("h"))

    return passages("documents").intersect(passages("benchmark"))


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


def _gram_sql(name: str, source: str, key: str) -> str:
    return f"""{name}w AS (SELECT {key} AS id, {_tokens('text')} AS w FROM {source}),
{name} AS (SELECT DISTINCT id, unnest(CASE WHEN len(w) < 4 THEN ['short:' || array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')) END) AS g FROM {name}w),
{name}n AS (SELECT id, count(*) AS n FROM {name} GROUP BY id)"""


_PAIRS = f"""{_gram_sql('s', 'documents', 'doc_id')},
b AS (SELECT x.id AS a, y.id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.id < y.id GROUP BY x.id, y.id),
p AS (SELECT a, b, c FROM b JOIN sn na ON na.id = a JOIN sn nb ON nb.id = b WHERE c * 100 >= (na.n + nb.n - c) * 80)"""


_CLASS = """k AS (SELECT id, min(id) OVER (PARTITION BY m) AS class_id FROM (SELECT id, md5(string_agg(g, chr(10) ORDER BY g)) AS m FROM s GROUP BY id))"""


@query(f"WITH {_PAIRS}, {_CLASS} SELECT a, b, c AS common FROM p WHERE a IN (SELECT class_id FROM k) AND b IN (SELECT class_id FROM k)")
def near_dup_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs between classes of equal shingle sets, named by their smallest ids; near_dup_links has who is in which."""
    return similarity.similar_classes(_docs(spark, d)).pairs.select("a", "b", F.col("both").cast("long").alias("common"))


@query(f"""WITH {_PAIRS}, {_CLASS}, n AS (SELECT id, count(*) AS n FROM (SELECT a AS id FROM p UNION ALL SELECT b FROM p) GROUP BY id)
SELECT k.id AS doc_id, class_id, coalesce(n, 0) AS n_links FROM k LEFT JOIN n ON n.id = k.id""")
def near_dup_links(spark: SparkSession, d: str) -> DataFrame:
    """Each document's class, and how many other documents it is similar to."""
    return similarity.similar_classes(_docs(spark, d)).links().select(F.col("id").alias("doc_id"), "class_id", "n_links")


@query(f"""
WITH RECURSIVE {_PAIRS},
two AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
reach AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT two.b, reach.root FROM reach JOIN two ON two.a = reach.node)
SELECT node AS doc_id, min(root) AS component_id FROM reach GROUP BY node""")
def near_dup_components(spark: SparkSession, d: str) -> DataFrame:
    out = similarity.near_components(_docs(spark, d))
    return out.select(F.col("id").alias("doc_id"), "component_id")


_HITS = f"""{_gram_sql('s', 'documents', 'doc_id')}, {_gram_sql('q', 'benchmark', 'item_id')},
hit AS (SELECT DISTINCT x.id FROM (SELECT s.id, q.id AS qid, count(*) AS c FROM s JOIN q ON s.g = q.g GROUP BY s.id, q.id) x JOIN sn ON sn.id = x.id JOIN qn ON qn.id = x.qid WHERE c * 100 >= (sn.n + qn.n - c) * 80)"""


@query(f"""
WITH {_gram_sql('s', 'documents', 'doc_id')}, {_gram_sql('q', 'benchmark', 'item_id')},
hit AS (SELECT DISTINCT x.id FROM (SELECT s.id, q.id AS qid, count(*) AS c FROM s JOIN q ON s.g = q.g GROUP BY s.id, q.id) x JOIN sn ON sn.id = x.id JOIN qn ON qn.id = x.qid WHERE c * 100 >= (sn.n + qn.n - c) * 80)
SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT id FROM hit)""")
def benchmark_anti_join(spark: SparkSession, d: str) -> DataFrame:
    taken = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")
    return similarity.dissimilar(_docs(spark, d), taken).select(F.col("id").alias("doc_id"))


@query(f"WITH {_HITS} SELECT doc_id FROM documents WHERE (source, lang) NOT IN (SELECT (source, lang) FROM documents WHERE doc_id IN (SELECT id FROM hit))")
def benchmark_component_scrub(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.concat_ws("/", "source", "lang").alias("component"))
    return similarity.scrub_components(docs, table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")).select(F.col("id").alias("doc_id"))


@query(f"SELECT DISTINCT s.id AS doc_id FROM (SELECT 1) one, (WITH {_gram_sql('s', 'documents', 'doc_id')}, {_gram_sql('q', 'benchmark', 'item_id')} SELECT s.id FROM s JOIN q ON s.g = q.g) s")
def benchmark_overlap(spark: SparkSession, d: str) -> DataFrame:
    bench = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")
    return similarity.overlapping(_docs(spark, d), bench).select(F.col("id").alias("doc_id"))


def _greedy(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    return similarity.greedy_dedupe(docs, S.hash_rank(docs.select("id"), "id"))


_GREEDY = f"""{_PAIRS},
o AS (SELECT doc_id AS id, row_number() OVER (ORDER BY md5('42:' || doc_id::VARCHAR), doc_id) AS rank FROM documents),
two AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
e AS (SELECT x.rank AS rank, list(y.rank) AS earlier FROM two JOIN o x ON x.id = two.a JOIN o y ON y.id = two.b WHERE y.rank < x.rank GROUP BY x.rank),
w AS (SELECT rank, earlier, row_number() OVER (ORDER BY rank) AS k FROM e),
out AS (
  SELECT 0::BIGINT AS k, []::BIGINT[] AS gone
  UNION ALL SELECT out.k + 1, CASE WHEN len(list_filter(w.earlier, lambda r: NOT list_contains(out.gone, r))) > 0 THEN list_append(out.gone, w.rank) ELSE out.gone END FROM out JOIN w ON w.k = out.k + 1),
gone AS (SELECT unnest(gone) AS rank FROM (SELECT gone FROM out ORDER BY k DESC LIMIT 1)),
g AS (SELECT id, rank, rank NOT IN (SELECT rank FROM gone) AS accepted FROM o)"""


@query(f"WITH RECURSIVE {_GREEDY} SELECT id AS doc_id, rank, accepted FROM g")
def greedy_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return _greedy(spark, d).select(F.col("id").alias("doc_id"), "rank", "accepted")


def _passes_sql(plain: dict[str, int], hard: dict[str, int]) -> str:
    """The two passes over o (id, rank, reason) and two (a, b), as greedy selections of their own; ends in taken (id, rank, split, reason)."""
    n, more = sum(plain.values()), sum(hard.values())

    def greedy(name: str, nodes: str) -> str:
        return f"""{name}e AS (SELECT x.rank AS rank, list(y.rank) AS earlier FROM two JOIN {nodes} x ON x.id = two.a JOIN {nodes} y ON y.id = two.b WHERE y.rank < x.rank GROUP BY x.rank),
{name}w AS (SELECT rank, earlier, row_number() OVER (ORDER BY rank) AS k FROM {name}e),
{name}o AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS gone
  UNION ALL SELECT o.k + 1, CASE WHEN len(list_filter(w.earlier, lambda r: NOT list_contains(o.gone, r))) > 0 THEN list_append(o.gone, w.rank) ELSE o.gone END FROM {name}o o JOIN {name}w w ON w.k = o.k + 1),
{name}g AS (SELECT unnest(gone) AS rank FROM (SELECT gone FROM {name}o ORDER BY k DESC LIMIT 1)),
{name} AS (SELECT *, row_number() OVER (ORDER BY rank) AS n FROM {nodes} WHERE rank NOT IN (SELECT rank FROM {name}g))"""

    def named(quotas: dict[str, int]) -> str:
        out, upto = "CASE", 0
        for name, many in quotas.items():
            upto += many
            out += f" WHEN n <= {upto} THEN '{name}'"
        return out + " END"

    return f"""two AS (SELECT a, b FROM p UNION SELECT b, a FROM p), {greedy('f', 'o')}, ft AS (SELECT * FROM f WHERE n <= {n}),
left_ AS (SELECT id, rank, reason FROM o WHERE reason IS NOT NULL AND id NOT IN (SELECT id FROM ft) AND id NOT IN (SELECT two.b FROM two JOIN ft ON ft.id = two.a)), {greedy('h', 'left_')},
taken AS (SELECT id, rank, {named(plain)} AS split, NULL::VARCHAR AS reason FROM ft UNION ALL SELECT id, rank, {named(hard)}, reason FROM h WHERE n <= {more})"""


_HARD_DOC = "CASE WHEN n_chars % 5 = 0 THEN 'every fifth length' END"


@query(f"""WITH RECURSIVE {_PAIRS}, o AS (SELECT doc_id AS id, row_number() OVER (ORDER BY md5('42:' || doc_id::VARCHAR), doc_id) AS rank, {_HARD_DOC} AS reason FROM documents),
{_passes_sql(pipelines.PLAIN, pipelines.HARD)} SELECT id AS doc_id, rank, split, reason FROM taken""")
def quota_split(spark: SparkSession, d: str) -> DataFrame:
    """Plain quotas in rank order, then a second pass for rows with a reason; whatever tables have for them."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.when(F.col("n_chars") % 5 == 0, "every fifth length").alias("reason"))
    return similarity.two_passes(docs, S.hash_rank(docs.select("id"), "id"), pipelines.PLAIN, pipelines.HARD, strict=False).withColumnRenamed("id", "doc_id")


@query(f"""WITH RECURSIVE t AS (SELECT * FROM {_TURNS}),
r AS (SELECT *, id - row_number() OVER (ORDER BY id) AS run FROM t),
c AS (SELECT *, min(id) OVER (PARTITION BY conv_id, run) AS component_id FROM r),
own AS (SELECT DISTINCT component_id FROM c WHERE NOT inbound EXCEPT SELECT component_id FROM c WHERE NOT inbound AND conv_id % 7 = 0),
able AS (SELECT u.* FROM c u JOIN own USING (component_id) WHERE u.inbound AND EXISTS (SELECT 1 FROM c s WHERE NOT s.inbound AND s.parent_id = u.id AND s.component_id = u.component_id) AND len({_tokens('u.text')}) > 0),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY component_id ORDER BY md5('42:' || id::VARCHAR), id) AS k FROM able) WHERE k = 1),
o AS (SELECT id, text, component_id, row_number() OVER (ORDER BY md5('42:' || component_id::VARCHAR), component_id) AS rank,
  CASE WHEN regexp_matches(lower(text), '{R.CHALLENGE_SENSITIVE}') THEN 'security_privacy_or_sensitive_terms' WHEN len({_tokens('text')}) <= 3 AND id <> component_id THEN 'short_followup' WHEN regexp_matches(lower(text), '{R.CHALLENGE_REPEAT}') THEN 'repeated_issue_terms' END AS reason FROM one),
{_gram_sql('s', 'o', 'id')},
b AS (SELECT x.id AS a, y.id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.id < y.id GROUP BY x.id, y.id),
p AS (SELECT a, b, c FROM b JOIN sn na ON na.id = a JOIN sn nb ON nb.id = b WHERE c * 100 >= (na.n + nb.n - c) * 80),
{_passes_sql({'dev': 20, 'test_representative': 30}, {'test_challenge': 10})}
SELECT k.id AS tweet_id, o.component_id, k.split, k.reason AS challenge_reason, k.id - o.component_id AS n_before FROM taken k JOIN o ON o.id = k.id""")
def split_builder(spark: SparkSession, d: str) -> DataFrame:
    """Entry A over conversations as an archive: a turn answers the one before; every seventh conversation has another brand's replies."""
    turns = _turns(spark, d)
    id_, up = _number(F.col("id")), _number(F.col("parent_id"))
    known = turns.select(F.col("id").alias("parent_id")).withColumn("is_there", F.lit(True))
    rows = turns.join(known, "parent_id", "left").select(
        id_.cast("long").alias("tweet_id"), F.when(F.col("inbound"), "user").when(F.col("conv_id") % 7 == 0, "Other").otherwise("Brand").alias("author_id"), "inbound", F.timestamp_seconds("ts").alias("created_at"), "text",
        F.array().cast("array<bigint>").alias("response_ids"), F.when(F.col("is_there"), up.cast("long")).alias("parent_id"),
    )
    out = pipelines.build_splits(rows, "Brand", {"dev": 20, "test_representative": 30}, {"test_challenge": 10}, strict=False).examples
    return out.select("tweet_id", "component_id", "split", "challenge_reason", F.size("path").cast("long").alias("n_before"))


_TERMS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}\p{{M}}_]{{2,}}')"
_VECTORS = f"""
w AS (SELECT doc_id AS id, {_TERMS.format('text')} AS w FROM documents), qw AS (SELECT item_id AS id, {_TERMS.format('text')} AS w FROM benchmark),
t AS (SELECT id, unnest(list_concat(w, CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1]) ELSE []::VARCHAR[] END)) AS term FROM w),
qt AS (SELECT id, unnest(list_concat(w, CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1]) ELSE []::VARCHAR[] END)) AS term FROM qw),
tf AS (SELECT id, term, count(*) AS tf FROM t GROUP BY id, term), qtf AS (SELECT id, term, count(*) AS tf FROM qt GROUP BY id, term),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM documents))::DOUBLE / (1 + count(*))) + 1 AS idf FROM tf GROUP BY term),
raw AS (SELECT id, term, (1 + ln(tf)) * idf AS w FROM tf JOIN idf USING (term)), qraw AS (SELECT id, term, (1 + ln(tf)) * idf AS w FROM qtf JOIN idf USING (term)),
nrm AS (SELECT id, sqrt(sum(w * w)) AS n FROM raw GROUP BY id), qnrm AS (SELECT id, sqrt(sum(w * w)) AS n FROM qraw GROUP BY id)"""


@query(f"""
WITH {_VECTORS},
s AS (SELECT q.id AS query, r.id, sum(r.w / nrm.n * q.w / qnrm.n) AS sim FROM qraw q JOIN raw r USING (term) JOIN nrm ON nrm.id = r.id JOIN qnrm ON qnrm.id = q.id GROUP BY q.id, r.id)
SELECT query, id, round(sim, 6) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(sim, 9) DESC, id) AS rank FROM s WHERE sim > 0) WHERE rank <= 3""")
def tfidf_topk(spark: SparkSession, d: str) -> DataFrame:
    space = retrieval.TfIdf.fit(_docs(spark, d))
    out = space.top_k(table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text"))
    return out.select("query", "id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


@query("""
WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
n AS (SELECT id, v, sqrt(list_dot_product(v, v)) AS n FROM e),
s AS (SELECT q.id AS query, i.id, list_dot_product(q.v, i.v) / (q.n * i.n) AS sim FROM n q JOIN n i ON q.id <> i.id WHERE q.id % 50 = 0)
SELECT query, id, round(sim, 6) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(sim, 9) DESC, id) AS rank FROM s) WHERE rank <= 3""")
def cosine_topk_dense(spark: SparkSession, d: str) -> DataFrame:
    """Queries are the rows whose id is divisible by 50, held against all rows."""
    items = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    out = retrieval.dense_top_k(items.where("id % 50 = 0"), items)
    return out.select("query", "id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


@query(f"""
WITH u AS (SELECT id, [(conv_id * 1000 + k)::VARCHAR FOR k IN [ts - 1, ts + 1, ts + 7]] AS cited FROM {_TURNS} WHERE inbound),
c AS (SELECT id, unnest(cited) AS e, unnest([1, 2, 3]) AS pos FROM u)
SELECT u.id, coalesce(string_agg(h.id::VARCHAR || ':' || md5(h.text), ',' ORDER BY c.pos), '') AS evidence FROM u JOIN c ON c.id = u.id LEFT JOIN {_TURNS} h ON h.id::VARCHAR = c.e GROUP BY u.id""")
def evidence_resolve(spark: SparkSession, d: str) -> DataFrame:
    turns = _turns(spark, d)
    key = lambda k: F.concat_ws("/", "conv_id", F.col("ts") + k)
    cited = turns.where("inbound").select("id", F.array(*(key(k) for k in (-1, 1, 7))).alias("evidence_ids"))
    out = threads.resolve_evidence(cited, turns.select(key(0).alias("evidence_id"), "text"))
    number = lambda x: F.split_part(x, F.lit("/"), F.lit(1)).cast("long") * 1000 + F.split_part(x, F.lit("/"), F.lit(2)).cast("long")
    return out.select(_number(F.col("id")).alias("id"), F.array_join(F.transform("evidence", lambda e: F.concat(number(e["evidence_id"]).cast("string"), F.lit(":"), F.md5(e["text"]))), ",").alias("evidence"))


@query("""SELECT substr(sha256(s.system || ':' || conv_id::VARCHAR || 'salt'), 1, 12) AS rating_id, s.system, conv_id AS id FROM (SELECT DISTINCT conv_id FROM conversations) c, (VALUES ('trivial'), ('simple'), ('guarded')) AS s(system)""")
def blinded_packet(spark: SparkSession, d: str) -> DataFrame:
    inputs = table(spark, d, "conversations").select(F.col("conv_id").alias("id")).distinct()
    systems = spark.createDataFrame([("trivial",), ("simple",), ("guarded",)], "system string")
    return threads.blinded_packet(inputs, systems, "salt")[1]


_BLIND = "SELECT substr(sha256(s.system || ':' || conv_id::VARCHAR || 'salt'), 1, 12) AS rating_id, s.system, conv_id AS id FROM (SELECT DISTINCT conv_id FROM conversations) c, (VALUES ('trivial'), ('simple'), ('guarded')) AS s(system)"


@query(f"SELECT rating_id, system, id, ('0x' || substr(rating_id, 1, 2))::INTEGER % 3 AS correctness FROM ({_BLIND}) WHERE substr(rating_id, 3, 1) <> '0'")
def unblinded_ratings(spark: SparkSession, d: str) -> DataFrame:
    """Ratings that raters gave by surrogate ids, and the systems they are of; some items are unrated."""
    items, key = threads.blinded_packet(table(spark, d, "conversations").select(F.col("conv_id").alias("id")).distinct(), spark.createDataFrame([("trivial",), ("simple",), ("guarded",)], "system string"), "salt")
    rated = items.where(F.substring("rating_id", 3, 1) != "0").select("rating_id", (F.conv(F.substring("rating_id", 1, 2), 16, 10).cast("int") % 3).alias("correctness"))
    return threads.unblinded(rated, key).select("rating_id", "system", "id", "correctness")


@query("""
WITH a AS (SELECT DISTINCT conv_id AS id FROM conversations WHERE role = 'user'), g AS (SELECT conv_id + 1 AS id FROM conversations WHERE role = 'assistant'), t AS (SELECT id, count(*) AS n FROM g GROUP BY id)
SELECT coalesce(a.id, t.id) AS id, CASE WHEN a.id IS NULL THEN 'unknown' WHEN t.n IS NULL THEN 'missing' ELSE 'doubled' END AS problem FROM a FULL JOIN t ON a.id = t.id WHERE a.id IS NULL OR t.n IS NULL OR t.n > 1""")
def batch_exact_ids(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations")
    return threads.exact_ids(turns.where("role = 'user'").select(F.col("conv_id").alias("id")), turns.where("role = 'assistant'").select((F.col("conv_id") + 1).alias("id")))


@query("SELECT conv_id, turn FROM conversations WHERE (conv_id, turn) NOT IN (SELECT conv_id, turn FROM conversations WHERE role = 'assistant')")
def resume_remaining(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role")
    key = F.struct("conv_id", "turn").alias("key")
    return modelcall.remaining(turns.select("conv_id", "turn", key), turns.where("role = 'assistant'").select(key), "key").select("conv_id", "turn")


@query("""
WITH r AS (SELECT conv_id, turn, sha256('stub' || chr(10) || text) AS fingerprint FROM conversations WHERE role = 'user'), c AS (SELECT DISTINCT fingerprint FROM r WHERE conv_id < 50)
SELECT r.conv_id, r.turn, c.fingerprint IS NOT NULL AS hit FROM r LEFT JOIN c ON c.fingerprint = r.fingerprint""")
def cache_lookup(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.col("text").alias("body"))
    requests = modelcall.with_fingerprint(turns, "stub")
    cache = requests.where("conv_id < 50").select("fingerprint").distinct().withColumns({"parsed": F.lit("{}"), "metadata": F.lit("{}")})
    hits, misses = modelcall.cached(requests, cache)
    return hits.select("conv_id", "turn", F.lit(True).alias("hit")).union(misses.select("conv_id", "turn", F.lit(False).alias("hit")))


# ---- calls of a model -----------------------------------------------------------------------


def _asked(spark: SparkSession, d: str) -> DataFrame:
    turns = _turns(spark, d).where("inbound")
    return turns.select(_number(F.col("id")).cast("string").alias("id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("body"), "conv_id", F.col("ts").alias("turn"))


_ASKED = "(SELECT (conv_id * 1000 + turn)::VARCHAR AS id, sha256(coalesce(text, '')) AS body, conv_id, turn FROM conversations WHERE role = 'user')"
_REASON = "'stub ' || substr(sha256(body), 1, 8)"


@query(f"SELECT id, sha256('stub' || chr(10) || body) AS fingerprint, 'other_unclear' AS intent, 'escalate' AS route, {_REASON} AS reason, 'stub' AS model FROM {_ASKED}")
def model_call_stub(spark: SparkSession, d: str) -> DataFrame:
    """User turns through fingerprint, stub client and output contract; failed rows fall back to a hand-off."""
    requests = modelcall.with_fingerprint(_asked(spark, d).select("id", "body"), "stub")
    answers = modelcall.call_misses(requests, modelcall.offline_stub, ["stub"])
    out = requests.select("id", "fingerprint").join(answers.drop("id"), "fingerprint", "left").withColumn("p", modelcall.parsed_output("parsed"))
    return out.select("id", "fingerprint", F.coalesce("p.intent", F.lit("other_unclear")).alias("intent"), F.coalesce("p.route", F.lit("escalate")).alias("route"), F.coalesce("p.reason", F.lit("generation unavailable")).alias("reason"), "model")


@query(f"SELECT id, {_REASON} AS reason, 'escalate' AS route FROM {_ASKED}")
def batched_calls(spark: SparkSession, d: str) -> DataFrame:
    """Twenty turns to a request; each answer has to name exactly the ids that were asked."""
    answers = modelcall.call_batches(_asked(spark, d).select("id", "body"), modelcall.offline_batch_stub, ["stub"], 20)
    return answers.withColumn("p", modelcall.parsed_output("parsed")).select("id", "p.reason", "p.route")


@query(f"SELECT id, CASE WHEN turn = 0 THEN 'kept' ELSE {_REASON} END AS reason, turn > 0 AS recovered FROM {_ASKED}")
def recovered_run(spark: SparkSession, d: str) -> DataFrame:
    """First turns were answered by a run that broke off; the others are asked in batches of ten."""
    asked = _asked(spark, d)
    kept = F.to_json(F.struct(F.lit("other_unclear").alias("intent"), F.lit("escalate").alias("route"), F.lit("kept").alias("reason"), F.lit("").alias("draft"), F.array().cast("array<string>").alias("evidence_ids"), F.lit("handoff").alias("reply_kind")))
    accepted = asked.where("turn = 0").select("id", kept.alias("parsed"), F.lit("stub").alias("model"))
    packet = S.numbered(asked.select("id", "body"), "id", name="ord")
    out = modelcall.recover(packet, accepted, modelcall.offline_batch_stub, ["stub"])
    return out.withColumn("p", modelcall.parsed_output("parsed")).select("id", "p.reason", "recovered")


@query("""WITH n AS (SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) AS n FROM conversations)
SELECT conv_id, turn, (n - 1) // 20 AS page, ((n - 1) % 20 + 1)::INTEGER AS place, CASE WHEN n >= 100 THEN 'second' ELSE 'first' END AS model FROM n""")
def packet_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of twenty in packet order, and the client that each position is asked with."""
    paged = threads.pages(table(spark, d, "conversations").select("conv_id", "turn"), "conv_id", "turn")
    ordered = paged.withColumn("ord", F.col("page") * 20 + F.col("place"))
    return modelcall.by_position(ordered, 100, "first", "second").drop("ord")


@query(f"""WITH t AS (SELECT * FROM {_TURNS})
SELECT DISTINCT c.conv_id AS component_id, c.id FROM t c JOIN t s ON s.parent_id = c.id WHERE c.inbound AND NOT s.inbound AND len({_tokens('c.text')}) >= 4
  AND c.conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system') AND c.conv_id NOT IN (SELECT conv_id FROM conversations WHERE contains(text, '!'))""")
def fresh_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Answered user turns of four words or more; conversations with a system turn stand for used ones, those with an exclamation mark for mixed ones."""
    every = table(spark, d, "conversations").select(F.col("conv_id").alias("component_id"), "role", "text")
    rows = _turns(spark, d).withColumn("component_id", F.col("conv_id"))
    out = threads.fresh_candidates(rows, [every.where("role = 'system'")], every.where(F.contains("text", F.lit("!"))))
    return out.select("component_id", _number(F.col("id")).alias("id"))


_RUBRIC = "two for each of four"


@query(f"""WITH b AS (SELECT id, sha256('{{"rubric":"{_RUBRIC}","message":"' || body || '","draft":"' || id || '","route":"escalate","evidence":[]}}') AS h FROM {_ASKED})
SELECT id AS rating_id, {', '.join(f"(('0x' || substr(h, {2 * i + 1}, 2))::INTEGER % 3)::INTEGER AS {c}" for i, c in enumerate(DIMENSIONS))}, ('0x' || substr(h, 19, 2))::INTEGER % 16 = 0 AS critical_failure FROM b""")
def judge_run(spark: SparkSession, d: str) -> DataFrame:
    """A judge's scores of a draft for each user turn, fifteen to a request, from a stub that scores by hash."""
    items = _asked(spark, d).select(F.col("id").alias("rating_id"), F.col("body").alias("message"), F.col("id").alias("draft"), F.lit("escalate").alias("route"), F.array().cast("array<string>").alias("evidence"))

    def client(model: str, body: str) -> tuple[dict, dict]:
        return {"results": [{"id": x["id"], **modelcall.offline_judge(model, x["body"])[0]} for x in json.loads(body)["items"]]}, {"model": model}

    return modelcall.judge(items, client, ["stub"], _RUBRIC, batch=15).select("rating_id", *DIMENSIONS, "critical_failure")
