"""The library's operators over the driver's tables, each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kilnwork.functions import numeric as N
from kilnwork.functions import text as T
from kilnwork.model import Adjustment, Field, GraphSchema, Retrieval
from kilnwork.operators import checks, diff, graph, ingest, order, similarity, stats
from kilnwork.registry import ORACLES, QUERIES, query, table

# Similarity and differences: parts as cases, of one type as of one process.

PART_FIELDS = (Field("p_brand"), Field("p_size", True), Field("p_retailprice", True))
_NUM = "greatest(0, 1 - abs({a} - {b}) / greatest(abs({a}), abs({b}), 0.000001))"
_SCORE = f"""((CASE WHEN q.p_brand = r.p_brand THEN 1.0::DOUBLE ELSE 0 END) + {_NUM.format(a="q.p_size::DOUBLE", b="r.p_size::DOUBLE")} + {_NUM.format(a="q.p_retailprice", b="r.p_retailprice")}) / 3"""
_MATCHES = f"""m AS (SELECT q.p_partkey AS query_key, r.p_partkey AS part_key, q.p_brand AS qb, q.p_size AS qs, q.p_retailprice AS qp, r.p_brand AS rb, r.p_size AS rs, r.p_retailprice AS rp, round_even({_SCORE}, 6) AS s, round_even(0.8 * ({_SCORE}), 6) AS t
  FROM part q JOIN part r ON q.p_type = r.p_type WHERE q.p_partkey % 50 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_key ORDER BY t DESC, part_key) AS rn FROM m QUALIFY rn <= 5)"""


def _part_matches(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").withColumn("p_size", F.col("p_size").cast("double"))
    return similarity.similar_rows(part.where("p_partkey % 50 = 0"), part, "p_type", PART_FIELDS, "p_partkey", "p_partkey", 5)


@query(f"WITH {_MATCHES} SELECT query_key, part_key, s AS structured_score, t AS total_score, CAST(rn AS INTEGER) AS rank FROM k")
def part_similarity_topk(spark: SparkSession, d: str) -> DataFrame:
    return _part_matches(spark, d).select(F.col("q.p_partkey").alias("query_key"), F.col("r.p_partkey").alias("part_key"), "structured_score", "total_score", "rank")


@query(f"""WITH p AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 7 <> 0 THEN p_size END AS p_size, p_retailprice FROM part),
x AS (SELECT q.p_partkey AS k, CASE WHEN q.p_brand = r.p_brand THEN 1.0::DOUBLE ELSE 0 END AS b, {_NUM.format(a="q.p_size::DOUBLE", b="r.p_size::DOUBLE")} AS z, {_NUM.format(a="q.p_retailprice", b="r.p_retailprice")} AS c, q.p_size IS NOT NULL AND r.p_size IS NOT NULL AS has FROM p q JOIN p r ON r.p_partkey = q.p_partkey + 1)
SELECT k AS part_key, round_even(CASE WHEN has THEN (b + z + c) / 3 ELSE (b + c) / 2 END, 6) AS score FROM x""")
def missing_field_renorm(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").withColumn("p_size", F.when(F.col("p_partkey") % 7 != 0, F.col("p_size").cast("double")))
    nxt = p.select((F.col("p_partkey") - 1).alias("k"), F.struct("*").alias("r"))
    score, _ = similarity.structured_score(PART_FIELDS, lambda f: F.col(f), lambda f: F.col(f"r.{f}"))
    return p.join(nxt, F.col("p_partkey") == F.col("k")).select(F.col("p_partkey").alias("part_key"), F.bround(score, 6).alias("score"))


@query("""WITH s AS (SELECT q.vec_id AS query_id, r.vec_id AS row_id, round_even(greatest(0, least(1, list_cosine_similarity(q.embedding::DOUBLE[], r.embedding::DOUBLE[]))), 6) AS similarity
  FROM embeddings q JOIN embeddings r ON q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0)
SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, row_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 5""")
def embedding_cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return similarity.cosine_topk(e.where("vec_id % 50 = 0"), e, 5)


@query(f"""WITH s AS (SELECT q.vec_id AS query_id, r.vec_id AS row_id, {_NUM.format(a="q.vec_id::DOUBLE", b="r.vec_id::DOUBLE")} AS a, greatest(0, least(1, list_cosine_similarity(q.embedding::DOUBLE[], r.embedding::DOUBLE[]))) AS b
  FROM embeddings q JOIN embeddings r ON q.label = r.label WHERE q.vec_id % 50 = 0), t AS (SELECT query_id, row_id, round_even(0.8 * a + 0.2 * b, 6) AS total_score FROM s)
SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY total_score DESC, row_id) AS INTEGER) AS rank FROM t QUALIFY rank <= 5""")
def hybrid_score(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").withColumn("at", F.col("vec_id").cast("double"))
    m = similarity.similar_rows(e.where("vec_id % 50 = 0"), e, "label", (Field("at", True),), "vec_id", "vec_id", 5, Retrieval(), "embedding")
    return m.select(F.col("q.vec_id").alias("query_id"), F.col("r.vec_id").alias("row_id"), "total_score", "rank")


_PAIRS = "p AS (SELECT a.p_partkey AS part_key, a.p_brand AS ab, b.p_brand AS bb, a.p_size::DOUBLE AS az, b.p_size::DOUBLE AS bz, a.p_retailprice AS ap, b.p_retailprice AS bp FROM part a JOIN part b ON b.p_partkey = a.p_partkey - 1)"
_DIFFS = f"""{_PAIRS}, d AS (SELECT part_key, 0 AS ord, 'p_brand' AS field, CASE WHEN ab = bb THEN 'same' ELSE 'changed' END AS change FROM p
UNION ALL SELECT part_key, 1, 'p_size', CASE WHEN abs(az - bz) <= 1e-9 THEN 'same' WHEN az > bz THEN 'increase' ELSE 'decrease' END FROM p
UNION ALL SELECT part_key, 2, 'p_retailprice', CASE WHEN abs(ap - bp) <= 1e-9 THEN 'same' WHEN ap > bp THEN 'increase' ELSE 'decrease' END FROM p)"""


def _part_diffs(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").withColumn("p_size", F.col("p_size").cast("double"))
    before = p.select((F.col("p_partkey") + 1).alias("k"), F.struct("*").alias("b"))
    both = p.join(before, F.col("p_partkey") == F.col("k"))
    return both.select(F.col("p_partkey").alias("part_key"), diff.diff_rows(PART_FIELDS, lambda f: F.col(f), lambda f: F.col(f"b.{f}")).alias("diffs"))


@query(f"WITH {_DIFFS} SELECT part_key, ord, field, change, field || '_' || change AS code FROM d")
def row_diff_codes(spark: SparkSession, d: str) -> DataFrame:
    return _part_diffs(spark, d).select("part_key", F.explode("diffs").alias("x")).select("part_key", "x.ord", "x.field", "x.change", "x.code")


@query(f"WITH {_DIFFS} SELECT part_key, coalesce(string_agg(field || '_' || change, ',' ORDER BY ord) FILTER (WHERE change IN ('increase', 'decrease')), '') AS codes, count(*) FILTER (WHERE change = 'changed') AS n_gaps FROM d GROUP BY part_key")
def derive_conditions(spark: SparkSession, d: str) -> DataFrame:
    return _part_diffs(spark, d).select("part_key", F.array_join(diff.condition_codes(F.col("diffs")), ",").alias("codes"), F.size(diff.gaps(F.col("diffs"))).cast("long").alias("n_gaps"))


@query(f"""WITH {_MATCHES}, c AS (SELECT *, concat_ws(',', CASE WHEN abs(qp - rp) > 1e-9 THEN CASE WHEN qp > rp THEN 'p_retailprice_increase' ELSE 'p_retailprice_decrease' END END, CASE WHEN abs(qs - rs) > 1e-9 THEN CASE WHEN qs > rs THEN 'p_size_increase' ELSE 'p_size_decrease' END END) AS sig,
  row_number() OVER (PARTITION BY query_key, rb, rs, rp ORDER BY rn) AS r1 FROM k QUALIFY r1 = 1),
g AS (SELECT *, row_number() OVER (PARTITION BY query_key, sig ORDER BY rn) > 1 AS seen FROM c)
SELECT query_key, part_key, sig, CAST(row_number() OVER (PARTITION BY query_key ORDER BY seen, rn) AS INTEGER) AS base_rank FROM g QUALIFY base_rank <= 3""")
def diverse_bases(spark: SparkSession, d: str) -> DataFrame:
    m = _part_matches(spark, d)
    codes = diff.condition_codes(diff.diff_rows(PART_FIELDS, lambda f: F.col(f"q.{f}"), lambda f: F.col(f"r.{f}")))
    m = m.select(F.col("q.p_partkey").alias("query_key"), "r", "rank", F.array_join(diff.signature(codes), ",").alias("sig"))
    b = similarity.diverse_bases(m, ["query_key"], ["r.p_brand", "r.p_size", "r.p_retailprice"], "sig", [F.col("rank")], 3)
    return b.select("query_key", F.col("r.p_partkey").alias("part_key"), "sig", "base_rank")


@query("SELECT p_partkey AS part_key, concat_ws(', ', 'brand=' || p_brand, 'size=' || CASE WHEN p_partkey % 7 <> 0 THEN p_size END) AS line FROM part")
def requirement_text(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").withColumn("p_size", F.when(F.col("p_partkey") % 7 != 0, F.col("p_size")))
    return p.select(F.col("p_partkey").alias("part_key"), similarity.requirement_text({"p_brand": "brand=", "p_size": "size="}, ", ").alias("line"))


# Paths: suppliers act on nations, nations on nations of their region and on the region.


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s, n, r = (table(spark, d, t) for t in ("supplier", "nation", "region"))
    sid, nid, rid = (lambda c, p=p: F.concat(F.lit(p), F.col(c).cast("string")) for p in ("s", "n", "r"))
    node = lambda df, i, label, key: df.select(i.alias("id"), F.lit(label).alias("label"), F.col(key).alias("key"))
    ids = s.select("s_suppkey").withColumn("key", F.concat(F.lit("s"), "s_suppkey"))
    nodes = order.union_all([node(ids, sid("s_suppkey"), "Parameter", "key"), node(n, nid("n_nationkey"), "Mechanism", "n_name"), node(r, rid("r_regionkey"), "Quality", "r_name")])
    edge = lambda df, kind, a, b, c: df.select(F.concat_ws("-", a, b).alias("id"), F.lit(kind).alias("type"), a.alias("src"), b.alias("dst"), c.alias("confidence"), F.array(F.concat(F.lit("ref:"), a), F.lit("ref:all")).alias("source_refs"))
    to = n.select(F.col("n_nationkey").alias("k2"), F.col("n_regionkey").alias("r2"))
    near = n.join(to, (F.col("n_regionkey") == F.col("r2")) & (F.col("n_nationkey") != F.col("k2")))
    edges = [
        edge(s, "AFFECTS", sid("s_suppkey"), nid("s_nationkey"), 0.5 + (F.col("s_suppkey") % 50) / 100),
        edge(near, "DETERMINES", nid("n_nationkey"), nid("k2"), F.lit(0.7)),
        edge(n, "AFFECTS", nid("n_nationkey"), rid("n_regionkey"), F.lit(None).cast("double")),
    ]
    return nodes, order.union_all(edges)


_HOPS = """h0 AS (SELECT 's' || s_suppkey AS start, r_name AS finish, 's' || s_suppkey || '>' || a.n_name || '>' || r_name AS path, 0 AS hops FROM supplier JOIN nation a ON s_nationkey = a.n_nationkey JOIN region ON a.n_regionkey = r_regionkey),
h1 AS (SELECT 's' || s_suppkey AS start, r_name AS finish, 's' || s_suppkey || '>' || a.n_name || '>' || b.n_name || '>' || r_name AS path, 1 AS hops FROM supplier JOIN nation a ON s_nationkey = a.n_nationkey JOIN nation b ON b.n_regionkey = a.n_regionkey AND b.n_nationkey <> a.n_nationkey JOIN region ON b.n_regionkey = r_regionkey),
h2 AS (SELECT 's' || s_suppkey AS start, r_name AS finish, 's' || s_suppkey || '>' || a.n_name || '>' || b.n_name || '>' || c.n_name || '>' || r_name AS path, 2 AS hops FROM supplier JOIN nation a ON s_nationkey = a.n_nationkey JOIN nation b ON b.n_regionkey = a.n_regionkey AND b.n_nationkey <> a.n_nationkey JOIN nation c ON c.n_regionkey = b.n_regionkey AND c.n_nationkey <> b.n_nationkey JOIN region ON c.n_regionkey = r_regionkey)"""


@query(f"WITH {_HOPS} SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2")
def path_tails(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _graph(spark, d)
    return graph.tails(edges, nodes).select("start", "finish", F.array_join("node_keys", ">").alias("path"), "hops")


_PRIORITIES = "pr AS (SELECT o_orderpriority AS code, row_number() OVER (ORDER BY o_orderpriority) - 1 AS ord FROM (SELECT DISTINCT o_orderpriority FROM orders))"


def _rules(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Each priority suggests the suppliers whose key has its number as remainder by five."""
    codes = table(spark, d, "orders").select(F.col("o_orderpriority").alias("code")).distinct()
    codes = codes.withColumn("ord", F.row_number().over(W.orderBy("code")) - 1)  # five rows
    s = table(spark, d, "supplier").withColumn("ord", (F.col("s_suppkey") % 5).cast("int"))
    met = codes.join(s, "ord")
    rule_rows = met.select(F.concat_ws("-", "code", "s_suppkey").alias("id"), F.col("code").alias("condition_code"), F.concat(F.lit("s"), "s_suppkey").alias("parameter_code"), F.lit("increase").alias("target_change"), F.lit(0.9).alias("confidence"), F.lit(None).cast("string").alias("condition_text"), F.lit(None).cast("string").alias("provenance_type"), F.array(F.concat(F.lit("rule:"), "code"), F.lit("ref:all")).alias("source_refs"))
    return codes, rule_rows


@query(f"""WITH {_PRIORITIES}, {_HOPS}, t AS (SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2),
f AS (SELECT code, pr.ord, start, hops, code || '>' || path AS path, 'rule:' || code || ',ref:all,ref:' || start AS refs FROM pr JOIN supplier ON s_suppkey % 5 = pr.ord JOIN t ON start = 's' || s_suppkey),
k AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY hops, string_split(path, '>')) AS n FROM f QUALIFY n <= 5)
SELECT 'p' || lpad(CAST(row_number() OVER (ORDER BY ord, n) - 1 AS VARCHAR), 3, '0') AS path_id, code AS difference_code, hops, path FROM k""")
def reasoning_paths(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _graph(spark, d)
    codes, rule_rows = _rules(spark, d)
    p = graph.reasoning_paths(codes.withColumn("requirement_id", F.lit("r")), rule_rows, graph.tails(edges, nodes), 5)
    return p.select("path_id", "difference_code", "hops", F.array_join("node_keys", ">").alias("path"))


@query(f"""WITH {_PRIORITIES} SELECT code AS condition_code, 's' || s_suppkey AS parameter_code, code || '>s' || s_suppkey || '>' || n_name || '>' || r_name AS path,
round_even((0.9 + (0.5 + (s_suppkey % 50) / 100)) / 2, 4) AS confidence, 'rule:' || code || ',ref:all,ref:s' || s_suppkey || ',ref:n' || n_nationkey AS refs
FROM pr JOIN supplier ON s_suppkey % 5 = pr.ord JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def knowledge_path_conf(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _graph(spark, d)
    k = graph.knowledge_paths(_rules(spark, d)[1], graph.distinct_chains(graph.chains(edges, nodes, 0)))
    return k.select(F.element_at("node_codes", 1).alias("condition_code"), "parameter_code", F.array_join("node_codes", ">").alias("path"), "confidence", F.array_join("source_refs", ",").alias("refs"))


@query("SELECT l_suppkey AS supp_key, l_orderkey AS order_key, l_linenumber AS line_number, l_discount AS score FROM (SELECT *, max(l_discount) OVER (PARTITION BY l_suppkey) AS best FROM lineitem) WHERE l_discount >= best - 1e-9")
def argmax_ties(spark: SparkSession, d: str) -> DataFrame:
    return stats.argmax_ties(table(spark, d, "lineitem"), ["l_suppkey"], "l_discount").select(F.col("l_suppkey").alias("supp_key"), F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line_number"), F.col("l_discount").alias("score"))


@query("SELECT ref, n FROM (SELECT l_orderkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS ref FROM lineitem GROUP BY l_orderkey) JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) USING (l_orderkey)")
def merge_refs(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.array("l_returnflag"))).alias("a"), F.count(F.lit(1)).alias("n"))
    return g.select(F.array_join(N.ordered_union(F.col("a")), ",").alias("ref"), "n")


# Statistics.

_FLAGS = ["l_returnflag", "l_linestatus"]


@query("""SELECT o_custkey AS cust_key, count(DISTINCT c) AS n_changes, CASE WHEN count(DISTINCT c) = 1 AND min(c) IN ('increase', 'decrease') THEN min(c) END AS direction, count(DISTINCT c) > 1 AS conflict
FROM (SELECT o_custkey, CASE o_orderstatus WHEN 'O' THEN 'increase' WHEN 'F' THEN 'decrease' ELSE '?' END AS c FROM orders) GROUP BY 1""")
def direction_conflict(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("change", F.when(F.col("o_orderstatus") == "O", "increase").when(F.col("o_orderstatus") == "F", "decrease"))
    return stats.directions(o, ["o_custkey"], "change").withColumnRenamed("o_custkey", "cust_key")


@query("""WITH s AS (SELECT l_returnflag, l_linestatus, l_quantity AS v, sum(l_linenumber) AS w FROM lineitem GROUP BY ALL), c AS (SELECT *, sum(w) OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY v) AS c, sum(w) OVER (PARTITION BY l_returnflag, l_linestatus) AS t FROM s)
SELECT l_returnflag, l_linestatus, min(v) AS weighted_median FROM c WHERE c >= t / 2 GROUP BY ALL""")
def weighted_median(spark: SparkSession, d: str) -> DataFrame:
    return stats.weighted_median(table(spark, d, "lineitem"), _FLAGS, "l_quantity", "l_linenumber")


@query("""WITH m AS (SELECT l_returnflag, l_linestatus, list_sort(list(l_quantity)) AS v FROM lineitem GROUP BY ALL), k AS (SELECT *, v[len(v) // 2 + 1] AS med FROM m),
a AS (SELECT *, list_sort(list_transform(v, lambda x: abs(x - med))) AS dv FROM k) SELECT l_returnflag, l_linestatus, least(1.0, dv[len(dv) // 2 + 1] / greatest(abs(med), 1e-9)) AS dispersion FROM a""")
def mad_dispersion(spark: SparkSession, d: str) -> DataFrame:
    return stats.mad_dispersion(table(spark, d, "lineitem"), _FLAGS, "l_quantity")


@query("SELECT l_returnflag, l_linestatus, round_even(quantile_cont(l_extendedprice, 0.33), 6) AS q33, round_even(quantile_cont(l_extendedprice, 0.67), 6) AS q67 FROM lineitem GROUP BY ALL")
def quantile_lin(spark: SparkSession, d: str) -> DataFrame:
    q = stats.quantiles(table(spark, d, "lineitem"), _FLAGS, "l_extendedprice", {"q33": 0.33, "q67": 0.67})
    return q.select(*_FLAGS, F.bround("q33", 6).alias("q33"), F.bround("q67", 6).alias("q67"))


@query("""WITH q AS (SELECT l_returnflag, l_linestatus, quantile_cont(l_quantity, 0.33) AS a, quantile_cont(l_quantity, 0.67) AS b FROM lineitem GROUP BY ALL)
SELECT l_returnflag, l_linestatus, CASE WHEN l_quantity <= a THEN 'small' WHEN l_quantity <= b THEN 'medium' ELSE 'large' END AS label, CASE WHEN greatest(1, round_even(l_quantity / 10.0, 0)) <= 1 THEN 'small' WHEN greatest(1, round_even(l_quantity / 10.0, 0)) <= 3 THEN 'medium' ELSE 'large' END AS by_steps, count(*) AS n
FROM lineitem JOIN q USING (l_returnflag, l_linestatus) GROUP BY ALL""")
def magnitude_labels(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    q = stats.quantiles(li, _FLAGS, "l_quantity", {"a": 0.33, "b": 0.67})
    j = li.join(q, _FLAGS)
    label = lambda n: N.magnitude_label(F.col("l_quantity"), F.lit(10.0), F.lit(n), F.col("a"), F.col("b"))
    return j.select(*_FLAGS, label(3).alias("label"), label(2).alias("by_steps")).groupBy(*_FLAGS, "label", "by_steps").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, l_extendedprice - 30000 AS raw, CASE l_linenumber % 3 WHEN 0 THEN 25.0::DOUBLE WHEN 1 THEN 0.5 ELSE 7.0 END AS step FROM lineitem)
SELECT l_orderkey AS order_key, l_linenumber AS line_number, CASE WHEN raw = 0 THEN 0 ELSE round_even(sign(raw) * greatest(1, round_even(abs(raw) / step, 0)) * step, 1) END AS quantized FROM s""")
def quantize_step(spark: SparkSession, d: str) -> DataFrame:
    step = F.when(F.col("l_linenumber") % 3 == 0, 25.0).when(F.col("l_linenumber") % 3 == 1, 0.5).otherwise(7.0)
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line_number"), N.quantize(F.col("l_extendedprice") - 30000, step).alias("quantized"))


@query("""SELECT CASE WHEN l_quantity < lo OR l_quantity > hi THEN false ELSE true END AS ok, lo IS NOT NULL OR hi IS NOT NULL AS verified, count(*) AS n
FROM (SELECT l_quantity, CASE WHEN l_linenumber > 1 THEN 10.0 END AS lo, CASE WHEN l_linenumber > 2 THEN 40.0 END AS hi FROM lineitem) GROUP BY ALL""")
def range_check(spark: SparkSession, d: str) -> DataFrame:
    c = N.range_check(F.col("l_quantity"), F.when(F.col("l_linenumber") > 1, 10.0), F.when(F.col("l_linenumber") > 2, 40.0))
    return table(spark, d, "lineitem").select(c.alias("c")).groupBy(F.col("c.ok").alias("ok"), F.col("c.verified").alias("verified")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT (l_linenumber > 1) AND (l_returnflag = 'A' OR l_returnflag = 'N') AS blocked, count(*) AS n FROM lineitem GROUP BY 1")
def voltage_mode_block(spark: SparkSession, d: str) -> DataFrame:
    rule = F.when(F.col("l_linenumber") > 1, "rule")
    mode = F.when(F.col("l_returnflag") == "A", "unified").when(F.col("l_returnflag") != "N", "separate")
    return table(spark, d, "lineitem").groupBy(N.voltage_blocked(rule, mode).alias("blocked")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_MATCHES}, p AS (SELECT b.query_key, b.rp AS base, s.part_key AS sk, s.rp - b.rp AS delta, s.t AS w, s.rb = b.rb AS same FROM k b JOIN k s ON b.query_key = s.query_key AND s.part_key <> b.part_key WHERE b.rn = 1),
u AS (SELECT *, max(CASE WHEN delta > 0 THEN same::INT END) OVER (PARTITION BY query_key) AS anysame FROM p), v AS (SELECT * FROM u WHERE delta > 0 AND (anysame = 0 OR same))
SELECT p.query_key, (SELECT count(*) FROM v WHERE v.query_key = p.query_key) AS n_valid, count(*) FILTER (WHERE delta <= 0) AS n_filtered FROM p GROUP BY 1""")
def case_deltas(spark: SparkSession, d: str) -> DataFrame:
    m = _part_matches(spark, d).select(F.col("q.p_partkey").alias("query_key"), "r", "rank", "total_score")
    base = m.where("rank = 1").select("query_key", F.col("r").alias("b"))
    s = m.where("rank > 1").join(base, "query_key")
    pairs = s.select("query_key", F.lit("increase").alias("direction"), F.col("b.p_retailprice").alias("base_value"), F.col("r.p_retailprice").alias("support_value"), F.col("total_score").alias("weight"), (F.col("r.p_brand") == F.col("b.p_brand")).alias("same_material"), F.col("r.p_partkey").cast("string").alias("support_id"), F.col("rank").alias("support_rank"))
    return stats.delta_estimates(pairs, ["query_key"]).select("query_key", "n_valid", "n_filtered")


@query("""WITH v AS (SELECT o_custkey AS g, o_orderkey AS m, o_orderpriority AS i, o_totalprice AS x FROM orders), n AS (SELECT g, count(DISTINCT m) AS n FROM v GROUP BY g),
c AS (SELECT a.g, a.m, avg(greatest(0, 1 - abs(a.x - b.x) / greatest(abs(a.x), abs(b.x), 1e-9))) AS c FROM v a JOIN v b ON a.g = b.g AND a.i = b.i AND a.m <> b.m GROUP BY ALL)
SELECT v.g AS cust_key, v.m AS order_key, round_even(coalesce(c, 0) * least(1, (n - 1) / 2.0), 4) AS consensus FROM v JOIN n ON v.g = n.g LEFT JOIN c ON v.g = c.g AND v.m = c.m""")
def pairwise_consensus(spark: SparkSession, d: str) -> DataFrame:
    c = stats.pairwise_consensus(table(spark, d, "orders"), "o_custkey", "o_orderkey", "o_orderpriority", "o_totalprice")
    return c.select(F.col("o_custkey").alias("cust_key"), F.col("o_orderkey").alias("order_key"), "consensus")


@query("SELECT l_orderkey AS order_key, l_linenumber AS line_number, round_even(least(1, 0.3 * l_discount + 0.25 * l_tax + 0.15 * (l_quantity / 50) + 0.15 * (l_linenumber / 7) + 0.15), 4) AS confidence FROM lineitem")
def confidence(spark: SparkSession, d: str) -> DataFrame:
    scores = {"similarity": F.col("l_discount"), "knowledge": F.col("l_tax"), "case_support": F.col("l_quantity") / 50, "consensus": F.col("l_linenumber") / 7, "equipment": F.lit(1.0)}
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line_number"), N.weighted_confidence(scores, Adjustment().weights).alias("confidence"))


@query("""SELECT l_linenumber AS n_valid, l_returnflag = 'R' AS fallback, round_even(CASE WHEN l_returnflag = 'R' THEN 0.25 ELSE least(1, l_linenumber / 3.0) * (1 - coalesce(CASE WHEN l_linenumber > 1 THEN l_discount END, 0.5)) END * CASE WHEN l_linenumber < 3 THEN 0.8 ELSE 1 END, 4) AS support FROM lineitem""")
def support_score(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber")
    s = N.support_score(F.col("l_returnflag") == "R", n, F.when(n > 1, F.col("l_discount")), n < 3, Adjustment())
    return table(spark, d, "lineitem").select(n.alias("n_valid"), (F.col("l_returnflag") == "R").alias("fallback"), s.alias("support"))


# Ingest.


@query("""SELECT c_custkey AS parameter_code, coalesce(CASE WHEN c_acctbal > 5000 THEN c_acctbal END, CASE WHEN c_acctbal > 0 THEN 1.0 END) AS step, CASE WHEN c_acctbal > 5000 THEN 'manual' ELSE 'project_default' END AS source_type FROM customer WHERE c_acctbal > 0""")
def priority_step(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    rows = c.select(F.lit("welding_current").alias("parameter_code"), F.col("c_custkey").alias("key"), F.when(F.col("c_acctbal") > 5000, F.col("c_acctbal")).alias("adjustment_step"), F.when(F.col("c_acctbal") > 0, 1.0).alias("default_step"), F.lit("A").alias("unit"), F.array(F.col("c_custkey").cast("string")).alias("source_refs"))
    s = ingest.priority_steps(rows, ["welding_current"])
    return s.select(F.element_at("source_refs", 1).cast("long").alias("parameter_code"), "step", "source_type")


_NEW = "n AS (SELECT CASE WHEN c_custkey % 11 = 0 THEN c_custkey + 10000000 ELSE c_custkey END AS k, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS bal FROM customer)"


def _merged(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"))
    new = c.select(F.when(F.col("k") % 11 == 0, F.col("k") + 10_000_000).otherwise(F.col("k")).alias("k"), "name", F.when(F.col("k") % 3 == 0, F.col("bal") + 1).otherwise(F.col("bal")).alias("bal"))
    return ingest.upsert(c, new, ["k"])


@query(f"WITH {_NEW} SELECT coalesce(n.k, c_custkey) AS k, coalesce(n.bal, c_acctbal) AS bal, CASE WHEN n.k IS NULL THEN 'kept' WHEN c_custkey IS NULL THEN 'created' WHEN n.bal = c_acctbal AND n.name = c_name THEN 'skipped' ELSE 'updated' END AS action FROM customer FULL JOIN n ON n.k = c_custkey")
def upsert_classify(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, d).select("k", "bal", "action")


@query(f"WITH {_NEW} SELECT CASE WHEN c_custkey IS NULL THEN 'created' WHEN n.bal = c_acctbal AND n.name = c_name THEN 'skipped' ELSE 'updated' END AS action, count(*) AS n FROM n LEFT JOIN customer ON n.k = c_custkey GROUP BY 1")
def import_counts(spark: SparkSession, d: str) -> DataFrame:
    return ingest.import_counts(_merged(spark, d))


@query("SELECT l_partkey AS part_key, l_suppkey AS supp_key, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def dup_keys(spark: SparkSession, d: str) -> DataFrame:
    return ingest.duplicate_keys(table(spark, d, "lineitem").select(F.col("l_partkey").alias("part_key"), F.col("l_suppkey").alias("supp_key")), ["part_key", "supp_key"])


@query("""WITH m AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS r FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0))
SELECT count(*) AS n_missing, (SELECT string_agg(r, ',' ORDER BY r) FROM (SELECT r FROM m ORDER BY r LIMIT 20)) AS first_missing FROM m""")
def ref_integrity(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.array(F.col("o_custkey").cast("string")).alias("refs"))
    out = ingest.missing_refs(o, "refs", table(spark, d, "customer").where("c_acctbal >= 0"), "c_custkey")
    return out.select("n_missing", F.array_join("first_missing", ",").alias("first_missing"))


@query("SELECT p_partkey AS part_key FROM part WHERE NOT starts_with(p_name, 'a') AND NOT starts_with(p_brand, 'Brand#1')")
def delete_by_prefix(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").withColumn("refs", F.array("p_brand"))
    return ingest.without_prefix(p, "p_name", "a", "refs", "Brand#1").select(F.col("p_partkey").alias("part_key"))


@query("SELECT c_custkey AS row_key, rule FROM (SELECT c_custkey, unnest(CASE WHEN c_acctbal < 0 AND c_mktsegment = 'MACHINERY' THEN ['balance', 'segment'] WHEN c_acctbal < 0 THEN ['balance'] WHEN c_mktsegment = 'MACHINERY' THEN ['segment'] ELSE [] END) AS rule FROM customer)")
def row_invariants(spark: SparkSession, d: str) -> DataFrame:
    from kilnwork.model import violations

    return violations(table(spark, d, "customer"), {"balance": F.col("c_acctbal") >= 0, "segment": F.col("c_mktsegment") != "MACHINERY"}, "c_custkey")


@query("""WITH n AS (SELECT 'k' || n_nationkey % 20 AS id, n_nationkey AS ord, CASE WHEN n_nationkey % 6 = 5 THEN 'Other' ELSE 'Mechanism' END AS label, CASE WHEN n_nationkey % 7 <> 3 THEN 'c' || n_nationkey % 23 END AS key, CASE WHEN n_nationkey % 4 = 0 THEN 'sea' ELSE 'arc' END AS layer FROM nation),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord) AS i, row_number() OVER (PARTITION BY label, key ORDER BY ord) AS j FROM n)
SELECT ord, id, 'unknown_label' AS error FROM r WHERE label = 'Other' UNION ALL SELECT ord, id, 'duplicate_id' FROM r WHERE i > 1 UNION ALL SELECT ord, id, 'missing_key' FROM r WHERE key IS NULL
UNION ALL SELECT ord, id, 'bad_layer' FROM r WHERE label = 'Mechanism' AND layer = 'sea' UNION ALL SELECT ord, id, 'duplicate_key' FROM r WHERE j > 1 AND i = 1""")
def validate_nodes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    n = table(spark, d, "nation").select(F.concat(F.lit("k"), k % 20).alias("id"), k.alias("ord"), F.when(k % 6 == 5, "Other").otherwise("Mechanism").alias("label"), F.when(k % 7 != 3, F.concat(F.lit("c"), k % 23)).alias("key"), F.col("n_name").alias("name"), F.col("n_name").alias("definition"), F.when(k % 4 == 0, "sea").otherwise("arc").alias("layer"), F.array("n_name").alias("source_refs"))
    return ingest.validate_nodes(n)


@query("""WITH e AS (SELECT o_orderkey AS ord, 'e' || o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN 'LINKS' ELSE 'LIMITS' END AS type, 'c' || o_custkey AS src, o_orderpriority AS dst FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY src, type, dst ORDER BY ord) AS j, dst NOT LIKE '5%' AS known, substr(src, 2)::BIGINT % 9 = 0 AS odd FROM e)
SELECT ord, id, 'unknown_type' AS error FROM r WHERE type = 'LINKS' UNION ALL SELECT ord, id, 'missing_endpoint' FROM r WHERE type <> 'LINKS' AND NOT known
UNION ALL SELECT ord, id, 'forbidden_pair' FROM r WHERE type <> 'LINKS' AND known AND odd UNION ALL SELECT ord, id, 'duplicate_edge' FROM r WHERE j > 1""")
def validate_edges(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    e = o.select(F.col("o_orderkey").alias("ord"), F.concat(F.lit("e"), "o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "P", "LINKS").otherwise("LIMITS").alias("type"), F.concat(F.lit("c"), "o_custkey").alias("src"), F.col("o_orderpriority").alias("dst"))
    c = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.when(F.col("c_custkey") % 9 == 0, "Quality").otherwise("Equipment").alias("label"))
    p = o.select(F.col("o_orderpriority").alias("id")).distinct().where("id not like '5%'").withColumn("label", F.lit("Parameter"))
    return ingest.validate_edges(e, c.unionByName(p), GraphSchema())


# Order.

_EV = "e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)"


def _events(spark: SparkSession, d: str) -> DataFrame:
    return order.numbered(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "p").withColumn("p", F.col("p").cast("long"))


@query(f"WITH {_EV}, l AS (SELECT user_id, p, event_type AS kind, lag(event_type) OVER (PARTITION BY user_id ORDER BY p) AS before FROM e) SELECT * FROM l WHERE before <> kind")
def class_transitions(spark: SparkSession, d: str) -> DataFrame:
    return order.class_transitions(_events(spark, d), ["user_id"], ["p"], "event_type").select("user_id", "p", F.col("event_type").alias("kind"), "before")


_NUMS = f"{_EV}, x AS (SELECT user_id, p, CASE WHEN event_id % 3 = 0 THEN p + (event_id % 9 = 0)::INT END AS n FROM e)"


def _numbers(spark: SparkSession, d: str) -> DataFrame:
    number = F.when(F.col("event_id") % 3 == 0, F.col("p") + (F.col("event_id") % 9 == 0).cast("int"))
    return _events(spark, d).select("user_id", "p", number.alias("n"))


@query(f"""WITH {_NUMS}, y AS (SELECT *, last_value(n IGNORE NULLS) OVER b AS n0, last_value(CASE WHEN n IS NOT NULL THEN p END IGNORE NULLS) OVER b AS p0, first_value(n IGNORE NULLS) OVER a AS n1, first_value(CASE WHEN n IS NOT NULL THEN p END IGNORE NULLS) OVER a AS p1 FROM x
WINDOW b AS (PARTITION BY user_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY user_id ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT user_id, p, coalesce(n, CASE WHEN n1 - n0 = p1 - p0 THEN n0 + p - p0 END) AS filled FROM y""")
def gap_fill_linear(spark: SparkSession, d: str) -> DataFrame:
    return order.linear_gap_fill(_numbers(spark, d), ["user_id"], "p", "n").select("user_id", "p", F.col("filled").cast("long").alias("filled"))


@query(f"WITH {_NUMS}, y AS (SELECT *, min(p) OVER (PARTITION BY user_id, n) AS f FROM x WHERE n IS NOT NULL) SELECT user_id, p, f AS first_at FROM y WHERE p > f")
def dup_numbers(spark: SparkSession, d: str) -> DataFrame:
    return order.duplicate_numbers(_numbers(spark, d), ["user_id"], "p", "n").select("user_id", "p", "first_at")


@query(f"WITH {_EV}, l AS (SELECT user_id, p, value, lag(value) OVER (PARTITION BY user_id ORDER BY p) AS b FROM e) SELECT user_id, min(p) AS at, arg_min(b, p) AS before, arg_min(value, p) AS after FROM l WHERE value < b GROUP BY 1")
def regressions(spark: SparkSession, d: str) -> DataFrame:
    return order.first_regression(_events(spark, d), ["user_id"], "p", "value")


@query("""WITH g AS (SELECT user_id, event_id, value, coalesce((value - lag(value) OVER w > 5)::INT, 0) AS far FROM events WINDOW w AS (PARTITION BY user_id ORDER BY value, event_id))
SELECT user_id, event_id, CAST(sum(far) OVER (PARTITION BY user_id ORDER BY value, event_id) AS INTEGER) AS cluster FROM g""")
def cluster_1d(spark: SparkSession, d: str) -> DataFrame:
    return order.cluster_1d(table(spark, d, "events"), ["user_id"], "value", "event_id", 5).select("user_id", "event_id", "cluster")


@query("""SELECT conv_id, turn, 'conv' || lpad(CAST(conv_id AS VARCHAR), 6, '0') || ':' || role || lpad(CAST(row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS VARCHAR), 2, '0') AS ref FROM conversations""")
def reading_order_ids(spark: SparkSession, d: str) -> DataFrame:
    c = order.numbered(table(spark, d, "conversations"), ["conv_id", "role"], ["turn"], "n")
    return c.select("conv_id", "turn", F.concat(F.lit("conv"), F.lpad(F.col("conv_id").cast("string"), 6, "0"), F.lit(":"), "role", F.lpad(F.col("n").cast("string"), 2, "0")).alias("ref"))


_LEVELS = "c AS (SELECT conv_id, turn, CAST(1 + length(text) % 6 AS INTEGER) AS level, role, text FROM conversations)"


def _leveled(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").withColumn("level", (1 + F.length("text") % 6).cast("int"))


@query(f"WITH {_LEVELS} SELECT a.conv_id, a.turn, a.level, max(b.turn) AS parent_at FROM c a LEFT JOIN c b ON a.conv_id = b.conv_id AND b.turn < a.turn AND b.level < a.level GROUP BY ALL")
def prev_smaller_parent(spark: SparkSession, d: str) -> DataFrame:
    return order.parents(_leveled(spark, d), ["conv_id"], "turn", "level").select("conv_id", "turn", "level", "parent_at")


@query(f"WITH {_LEVELS} SELECT a.conv_id, a.turn, a.level, min(b.turn) AS next_at FROM c a LEFT JOIN c b ON a.conv_id = b.conv_id AND b.turn > a.turn AND b.level <= a.level GROUP BY ALL")
def next_smaller_end(spark: SparkSession, d: str) -> DataFrame:
    return order.ends(_leveled(spark, d), ["conv_id"], "turn", "level").select("conv_id", "turn", "level", "next_at")


@query(f"""WITH RECURSIVE {_LEVELS}, pa AS (SELECT a.conv_id, a.turn, a.level, max(b.turn) AS up FROM c a LEFT JOIN c b ON a.conv_id = b.conv_id AND b.turn < a.turn AND b.level < a.level GROUP BY ALL),
r AS (SELECT conv_id, turn, up, CAST(turn AS VARCHAR) AS path FROM pa UNION ALL SELECT r.conv_id, r.turn, pa.up, CAST(pa.turn AS VARCHAR) || '>' || r.path FROM r JOIN pa ON pa.conv_id = r.conv_id AND pa.turn = r.up)
SELECT conv_id, turn, path FROM r WHERE up IS NULL""")
def heading_path(spark: SparkSession, d: str) -> DataFrame:
    p = order.parents(_leveled(spark, d), ["conv_id"], "turn", "level").withColumn("t", F.col("turn").cast("string"))
    return order.ancestor_titles(p, ["conv_id"], "turn", "t").select("conv_id", "turn", F.array_join("path", ">").alias("path"))


@query(f"WITH {_LEVELS}, pa AS (SELECT a.conv_id, a.turn, a.level, max(b.turn) AS up FROM c a JOIN c b ON a.conv_id = b.conv_id AND b.turn < a.turn AND b.level < a.level GROUP BY ALL) SELECT pa.conv_id, pa.turn, pa.level, c.level AS parent_level FROM pa JOIN c ON c.conv_id = pa.conv_id AND c.turn = pa.up WHERE pa.level > c.level + 1")
def level_jump(spark: SparkSession, d: str) -> DataFrame:
    p = order.parents(_leveled(spark, d), ["conv_id"], "turn", "level")
    return order.level_jumps(p, ["conv_id"], "turn", "level").select("conv_id", "turn", "level", "parent_level")


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM conversations")
def bind_section(spark: SparkSession, d: str) -> DataFrame:
    return order.bind_last(table(spark, d, "conversations"), ["conv_id"], "turn", F.when(F.col("role") == "user", F.col("turn")), "section").select("conv_id", "turn", "section")


@query("""WITH i AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM conversations)
SELECT conv_id, CAST(island AS INTEGER) AS island, md5(string_agg(coalesce(text, ''), '' ORDER BY turn)) AS text_md5, count(*) AS n_members FROM i GROUP BY ALL""")
def text_fusion(spark: SparkSession, d: str) -> DataFrame:
    i = order.islands(table(spark, d, "conversations"), ["conv_id"], "turn", F.col("role") == "user")
    return order.fuse(i, ["conv_id", "island"], "turn", "text").select("conv_id", "island", F.md5("text").alias("text_md5"), "n_members")


@query("SELECT conv_id, turn, role, row_number() OVER (ORDER BY conv_id, turn, role, text) AS item_no FROM conversations")
def item_ids(spark: SparkSession, d: str) -> DataFrame:
    return order.running_numbers(table(spark, d, "conversations"), ["conv_id"], ["turn", "role", "text"], "item_no").select("conv_id", "turn", "role", "item_no")


# Text.


@query()
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "documents").select("doc_id", T.clean_text(F.coalesce("text", F.lit("")), F.lit("paragraph")).alias("c"))
    return c.select("doc_id", F.md5("c.text").alias("text_md5"), F.array_join("c.rules", ",").alias("rules"))


# Audit and checks.


@query("SELECT lang AS value, count(*) AS n FROM documents GROUP BY 1")
def audit_types(spark: SparkSession, d: str) -> DataFrame:
    return checks.histogram(table(spark, d, "documents"), "lang")


@query("WITH p AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) SELECT source, count(*) AS pages, CAST(sum(n) AS BIGINT) AS blocks, min(n) AS least, max(n) AS most, round_even(avg(n), 4) AS mean FROM p GROUP BY 1")
def audit_summary(spark: SparkSession, d: str) -> DataFrame:
    s = checks.page_summary(table(spark, d, "documents").withColumn("page", F.coalesce(*[F.when(F.col("lang") == x, F.lit(i)) for i, x in enumerate(("en", "de", "fr", "es"))])), ["source"], "page")
    return s.drop("continuous")


@query("SELECT lang, count(*) AS n, count(*) FILTER (WHERE coalesce(text, '') = '') AS n_empty, count(*) FILTER (WHERE length(text) BETWEEN 1 AND 99) AS n_short FROM (SELECT lang, trim(text) AS text FROM documents) GROUP BY 1")
def audit_text(spark: SparkSession, d: str) -> DataFrame:
    return checks.text_audit(table(spark, d, "documents"), [], "lang", "text", 100)


@query("WITH f AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY lang, substr(text, 1, 80)) AS first_at FROM documents) SELECT doc_id, first_at FROM f WHERE doc_id <> first_at")
def dup_blocks(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").withColumn("head", F.substring("text", 1, 80))
    return checks.duplicate_blocks(t, ["lang", "head"], "doc_id").select("doc_id", "first_at")


@query("SELECT lang, count(*) AS n, array_to_string(list_sort(list(doc_id))[1:20], ',') AS sample FROM documents WHERE n_chars < 500 GROUP BY 1")
def audit_samples(spark: SparkSession, d: str) -> DataFrame:
    s = checks.sampled(table(spark, d, "documents"), ["lang"], F.col("n_chars") < 500, "doc_id")
    return s.select("lang", "n", F.array_join(F.transform("sample", lambda x: x.cast("string")), ",").alias("sample"))


@query("SELECT o_custkey AS cust_key, o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 1")
def chk_unique(spark: SparkSession, d: str) -> DataFrame:
    return checks.not_unique(table(spark, d, "orders").select(F.col("o_custkey").alias("cust_key"), F.col("o_orderpriority").alias("priority")), ["cust_key", "priority"])


@query("SELECT vec_id FROM embeddings WHERE vec_id * 2 NOT IN (SELECT vec_id FROM embeddings) AND vec_id % 3 <> 0")
def chk_orphans(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", F.when(F.col("vec_id") % 3 != 0, F.col("vec_id") * 2).alias("up"))
    return checks.orphans(e, "vec_id", "up").select("vec_id")


@query("""WITH a AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations), b AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations WHERE role <> 'system')
SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, min(coalesce(a.place, b.place)) AS place FROM a FULL JOIN b ON a.conv_id = b.conv_id AND a.place = b.place WHERE a.role IS DISTINCT FROM b.role GROUP BY 1""")
def chk_traversal(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    return checks.first_difference(c, c.where("role <> 'system'"), ["conv_id"], "turn", "role").select("conv_id", F.col("place").cast("long").alias("place"))


@query("SELECT doc_id, lang, CASE WHEN n < 0 THEN 'right' ELSE 'left' END AS side FROM (SELECT doc_id, lang, sum(s) AS n FROM (SELECT doc_id, lang, 1 AS s FROM documents UNION ALL SELECT doc_id, CASE WHEN n_chars > 5000 THEN 'xx' ELSE lang END, -1 FROM documents) GROUP BY ALL) WHERE n <> 0")
def except_both_ways(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    return checks.both_ways(a.select("doc_id", "lang"), a.select("doc_id", F.when(F.col("n_chars") > 5000, "xx").otherwise(F.col("lang")).alias("lang")))


_SECTIONS = f"{_LEVELS}, x AS (SELECT a.conv_id, a.turn, min(b.turn) AS next_at FROM c a LEFT JOIN c b ON a.conv_id = b.conv_id AND b.turn > a.turn AND b.level <= a.level GROUP BY ALL)"


@query(f"WITH {_SECTIONS} SELECT conv_id, turn FROM x WHERE next_at IS DISTINCT FROM turn + 1")
def chk_ranges(spark: SparkSession, d: str) -> DataFrame:
    claimed = _leveled(spark, d).withColumn("claimed", F.col("turn") + 1)
    return checks.wrong_ends(claimed, ["conv_id"], "turn", "level", "claimed").select("conv_id", "turn")


@query("""WITH l AS (SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN CAST(turn AS VARCHAR) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM conversations)
SELECT conv_id, turn FROM l WHERE s <> CAST(turn AS VARCHAR)""")
def chk_binding(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").withColumn("bound", F.col("turn").cast("string"))
    secs = c.where("role = 'user'").select("conv_id", "turn", F.col("bound").alias("section_id"))
    return checks.wrong_bindings(c.select("conv_id", "turn", "bound"), secs, ["conv_id"], "turn", "bound").select("conv_id", "turn")


@query("SELECT vec_id FROM embeddings WHERE vec_id % 7 IN (1, 2)")
def chk_cycles(spark: SparkSession, d: str) -> DataFrame:
    """Of seven in a row, the second and third point at each other, and the others nowhere."""
    e = table(spark, d, "embeddings").select("vec_id", F.when(F.col("vec_id") % 7 == 1, F.col("vec_id") + 1).when(F.col("vec_id") % 7 == 2, F.col("vec_id") - 1).alias("up"))
    last = e.agg(F.max("vec_id")).first()[0]
    e = e.withColumn("up", F.when(F.col("up") > last, F.col("vec_id")).otherwise(F.col("up")))
    return checks.cycles(e, "vec_id", "up")


@query("""WITH r AS (SELECT conv_id, min(turn) AS a, max(turn) AS z FROM conversations GROUP BY 1) SELECT conv_id, turn AS at FROM conversations JOIN r USING (conv_id) WHERE role = 'user' AND turn > a AND turn < z""")
def chk_fusion_boundary(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    runs = order.fuse(c, ["conv_id"], "turn", "text")
    return checks.boundary_inside(runs, c.where("role = 'user'").select("conv_id", F.col("turn").alias("at")), ["conv_id"]).select("conv_id", "at")


@query("SELECT lang AS origin, CAST(100 AS BIGINT) AS expected, count(*) AS found FROM documents WHERE lang IN ('de', 'fr') GROUP BY 1 HAVING count(*) <> 100 UNION ALL SELECT 'xx', 1, 0")
def chk_assets(spark: SparkSession, d: str) -> DataFrame:
    return checks.asset_counts(table(spark, d, "documents").withColumnRenamed("lang", "origin"), {"de": 100, "fr": 100, "xx": 1})


@query("""SELECT l_orderkey AS order_key, l_linenumber AS line_number, CASE WHEN l_quantity < l_linenumber * 3 THEN 'malformed' ELSE 'out_of_bounds' END AS problem FROM lineitem WHERE l_quantity < l_linenumber * 3 OR l_extendedprice / 50 > 1050""")
def oob_bbox(spark: SparkSession, d: str) -> DataFrame:
    box = F.array((F.col("l_linenumber") * 3).cast("double"), F.lit(0.0), F.col("l_quantity"), F.col("l_extendedprice") / 50)
    return checks.bad_boxes(table(spark, d, "lineitem").withColumn("bbox", box)).select(F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line_number"), "problem")


@query("SELECT l_orderkey AS order_key, l_linenumber AS line_number, greatest(0, l_quantity - (l_linenumber * 5 + 2), l_linenumber * 5 - (l_quantity + 4)) AS gap FROM lineitem")
def vertical_gap(spark: SparkSession, d: str) -> DataFrame:
    from kilnwork.operators import document

    a = F.array(F.lit(0.0), (F.col("l_linenumber") * 5).cast("double"), F.lit(1.0), (F.col("l_linenumber") * 5 + 2).cast("double"))
    b = F.array(F.lit(0.0), F.col("l_quantity"), F.lit(1.0), F.col("l_quantity") + 4)
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line_number"), document.vertical_gap(a, b).alias("gap"))


@query("""WITH l AS (SELECT conv_id, turn, role = 'user' AS h, 1 + length(text) % 2 AS v, lead(role = 'user') OVER w AS h2, lead(1 + length(text) % 2) OVER w AS v2, lead(turn) OVER w AS t2 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, coalesce(h AND h2 AND v = 1 AND v2 = 1 AND t2 * 30 - (turn * 30 + 10) < 40, false) AS merged FROM l""")
def crossline_merge(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    return order.crossline(c, ["conv_id"], ["turn"], F.col("role") == "user", 1 + F.length("text") % 2, F.col("turn") * 30, F.col("turn") * 30 + 10).select("conv_id", "turn", "merged")


@query("SELECT CAST(conv_id AS VARCHAR) AS doc_id, CAST(turn // 3 AS INTEGER) AS pdf_page, 'arabic' AS kind, max(turn) AS number FROM conversations GROUP BY ALL")
def page_anchor(spark: SparkSession, d: str) -> DataFrame:
    from kilnwork.operators import document

    y = (F.col("turn") % 3 * 10).cast("double")
    b = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("doc_id"), F.floor(F.col("turn") / 3).cast("int").alias("pdf_page"), (F.col("turn") % 3).cast("int").alias("original_index"), F.lit("page_number").alias("block_type"), F.col("turn").cast("string").alias("raw_text"), F.array(F.lit(0.0), y, F.lit(1.0), y + 1).alias("bbox"))
    return document.page_anchors(b).select("doc_id", "pdf_page", "kind", "number")


@query("SELECT l_partkey AS part_key, arg_min(l_suppkey, (l_suppkey, l_orderkey, l_linenumber)) AS supp_key FROM lineitem GROUP BY 1")
def limits_first(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(F.col("l_partkey").alias("parameter_code"), F.col("l_suppkey").alias("equipment_id"), F.struct("l_orderkey", "l_linenumber").alias("edge_id"))
    return graph.first_limits(li).select(F.col("parameter_code").alias("part_key"), F.col("equipment_id").alias("supp_key"))


@query("SELECT c_custkey AS row_key, c_name AS ref FROM customer WHERE c_custkey % 4 = 0")
def ref_format_check(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").withColumn("refs", F.array(F.when(F.col("c_custkey") % 4 == 0, F.col("c_name")).otherwise(F.concat(F.lit("c:"), "c_name"))))
    return ingest.bad_refs(c, "refs", "c_custkey")


@query("SELECT p_partkey AS part_key, trim(p_name) AS name, p_brand AS brand FROM part")
def normalize_props(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("part_key"), F.concat(F.lit("  "), "p_name", F.lit(" ")).alias("name"), F.array(F.concat(F.lit(" "), "p_brand")).alias("brand"))
    return ingest.trimmed(p).withColumn("brand", F.element_at("brand", 1))


@query("SELECT l_orderkey AS order_key, string_agg(flag, ',' ORDER BY flag) FILTER (WHERE flag <> 'N') AS chosen, bool_or(flag = 'N') AS unknown FROM (SELECT DISTINCT l_orderkey, l_returnflag AS flag FROM lineitem) GROUP BY 1")
def filter_valid_ids(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_returnflag")).alias("chosen"))
    good, bad = graph.valid_ids(F.col("chosen"), F.array(F.lit("A"), F.lit("R")))
    return g.select(F.col("l_orderkey").alias("order_key"), F.when(F.size(good) > 0, F.array_join(good, ",")).alias("chosen"), (F.size(bad) > 0).alias("unknown"))


# Flows.


@query()
def recommendation_flow(spark: SparkSession, d: str) -> DataFrame:
    """Parts as cases: size as thickness, price as current."""
    from kilnwork.model import REQUIREMENT
    from kilnwork.plans.recommend import recommend

    p = table(spark, d, "part")
    shared = [F.col("p_type").alias("process"), F.col("p_brand").alias("material"), F.col("p_size").cast("double").alias("thickness_mm"), F.lit("butt").alias("joint_type"), F.lit("flat").alias("position"), F.lit(1.0).alias("wire_diameter_mm"), F.lit("gas").alias("shielding_gas")]
    cases = p.select(F.col("p_partkey").cast("string").alias("case_id"), *shared, F.col("p_retailprice").alias("welding_current_a"), (F.col("p_retailprice") / 100).alias("welding_voltage_v"), F.lit(None).cast("double").alias("welding_speed_mm_s"))
    needs = p.where("p_partkey % 50 = 0").select(F.col("p_partkey").cast("string").alias("requirement_id"), *shared, F.lit(None).cast("string").alias("control_mode")).withColumn("thickness_mm", F.col("thickness_mm") + 3)
    assert set(needs.columns) <= {x.split()[0] for x in REQUIREMENT.split(", ")}
    rel = "array<struct<id:string,confidence:double,source_refs:array<string>>>"
    rules = spark.createDataFrame([("r1", "thickness_increase", "welding_current", "increase", 0.8, None, None, ["a:1"]), ("r2", "thickness_increase", "arc_voltage", "increase", 0.7, None, None, ["a:2"])], "id string, condition_code string, parameter_code string, target_change string, confidence double, condition_text string, provenance_type string, source_refs array<string>")
    chains = spark.createDataFrame([("welding_current", ["welding_current", "heat", "depth"], [("c1", 0.9, ["b:1"]), ("c2", 0.8, ["b:2"])])], f"start string, node_keys array<string>, rels {rel}")
    limits = spark.createDataFrame([("e1", "w", "welding_current", 5.0, None, "A", 0.0, 5000.0, None, None, ["l:1"]), ("e2", "w", "arc_voltage", None, 0.2, "V", None, None, "text", None, ["l:2"])], "edge_id string, equipment_id string, parameter_code string, adjustment_step double, default_step double, unit string, min_value double, max_value double, range_rule string, unified_mode_rule string, source_refs array<string>")
    proposals, _ = recommend(needs, cases, rules, chains, limits)
    return proposals.select("requirement_id", "proposal_id", "base_case_id", "valid", "similarity", "knowledge", "case_support", "consensus", "equipment", "confidence", "rank", "low_confidence")


@query()
def document_flow(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as documents: a page for each ten turns, users' turns as titles, the others as paragraphs."""
    from kilnwork.plans.document import prepare

    c = table(spark, d, "conversations")
    fragments = F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("content")))
    y = (F.col("turn") % 10 * 50).cast("double")
    box = F.array(F.lit(0.0), y, F.lit(500.0), y + 40)
    block = F.when(F.col("role") == "user", F.to_json(F.struct(F.lit("title").alias("type"), box.alias("bbox"), F.struct(fragments.alias("title_content")).alias("content")))).otherwise(F.to_json(F.struct(F.lit("paragraph").alias("type"), box.alias("bbox"), F.struct(fragments.alias("paragraph_content")).alias("content"))))
    raw = c.select(F.col("conv_id").cast("string").alias("doc_id"), F.floor(F.col("turn") / 10).cast("int").alias("pdf_page"), (F.col("turn") % 10).cast("int").alias("original_index"), block.alias("block"))
    return prepare(raw).items.select("doc_id", "section_id", "item_order", "item_type", "item_id", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


from kilnwork import more_queries, retrieval_queries  # noqa: E402,F401  add their queries to the same tables

__all__ = ["ORACLES", "QUERIES"]
