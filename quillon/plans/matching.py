"""Matching and chemistry queries: parts as compounds, orders as reactions of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import chemistry, names
from quillon.operators import biochem, genomes, matching
from quillon.plans import table

def formula():
    """Part sizes as formulas: carbon by size, hydrogen by key, oxygen where the key is even."""
    return F.concat(F.lit("C"), F.col("p_size"), F.when(F.col("p_partkey") % 4 != 0, F.concat(F.lit("H"), F.col("p_partkey") % 7 + 1)).otherwise(""), F.when(F.col("p_partkey") % 2 == 0, "O2").otherwise("N"))


_SQL_FORMULA = "'C' || p_size || CASE WHEN p_partkey % 4 <> 0 THEN 'H' || (p_partkey % 7 + 1) ELSE '' END || CASE WHEN p_partkey % 2 = 0 THEN 'O2' ELSE 'N' END"


def compounds(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.array("p_brand").alias("names"), F.create_map(F.lit("kind"), F.array("p_type")).alias("annotation"), formula().alias("formula"), (F.col("p_partkey") % 3 - 1).cast("int").alias("charge"), (F.col("p_retailprice") - 1000).cast("string").alias("deltag"), F.lit("2").alias("error"))


def stoichiometry(spark, sf_dir):
    """Lines of orders, merged, as compounds of reactions: even line numbers are products."""
    line = table(spark, sf_dir, "lineitem")
    side = F.when(F.col("l_linenumber") % 2 == 0, F.lit(1.0)).otherwise(-1.0)
    comp = F.when(F.col("l_suppkey") % 3 == 0, "e").when(F.col("l_suppkey") % 3 == 1, "p").otherwise("c")
    return line.groupBy(F.col("l_orderkey").alias("reaction_id"), F.col("l_partkey").cast("string").alias("compound_id"), comp.alias("compartment")).agg(F.sum(side * F.floor(F.col("l_quantity") / 10 + 1)).alias("coefficient")).where("coefficient <> 0")


_STOICH = """s AS (SELECT l_orderkey AS reaction_id, CAST(l_partkey AS VARCHAR) AS compound_id, CASE l_suppkey % 3 WHEN 0 THEN 'e' WHEN 1 THEN 'p' ELSE 'c' END AS compartment,
sum((CASE WHEN l_linenumber % 2 = 0 THEN 1.0 ELSE -1.0 END) * CAST(floor(l_quantity / 10 + 1) AS DOUBLE)) AS coefficient FROM lineitem GROUP BY ALL HAVING sum((CASE WHEN l_linenumber % 2 = 0 THEN 1.0 ELSE -1.0 END) * CAST(floor(l_quantity / 10 + 1) AS DOUBLE)) <> 0)"""
_COMPOUNDS = f"c AS (SELECT CAST(p_partkey AS VARCHAR) AS id, {_SQL_FORMULA} AS formula, p_size, CASE WHEN p_partkey % 4 <> 0 THEN p_partkey % 7 + 1 END AS h, CAST(p_partkey % 3 - 1 AS INTEGER) AS charge, p_retailprice - 1000 AS g, p_partkey % 2 = 0 AS even FROM part)"
_ELEMENTS = "el AS (SELECT id, 'C' AS element, p_size AS n FROM c UNION ALL SELECT id, 'H', h FROM c WHERE h IS NOT NULL UNION ALL SELECT id, CASE WHEN even THEN 'O' ELSE 'N' END, CASE WHEN even THEN 2 ELSE 1 END FROM c)"
_STD = "regexp_replace(lower({}), '[^a-z0-9]', '', 'g')"


def scored(spark, sf_dir):
    """A search: its queries are the parts whose key 50 divides, its candidates all parts. Every fourth part has no hydrogen."""
    own = compounds(spark, sf_dir)
    queries = table(spark, sf_dir, "part").where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("query_id"), F.array("p_name", "p_brand").alias("identifiers"), F.array().cast("array<string>").alias("structures"), formula().alias("formula"))
    return matching.compounds(queries, matching.aliases(own), None, own.select(F.col("id").alias("entity_id"), "formula"))


_SCORED = f"""WITH al AS (SELECT CAST(p_partkey AS VARCHAR) AS entity_id, unnest([CAST(p_partkey AS VARCHAR), {_STD.format('p_name')}, {_STD.format('p_brand')}, {_STD.format('p_type')}]) AS a FROM part),
q AS (SELECT p_partkey AS query_id, unnest([{_STD.format('p_name')}, {_STD.format('p_brand')}]) AS a FROM part WHERE p_partkey % 50 = 0), {_COMPOUNDS},
ev AS (SELECT query_id, entity_id, 10 AS score FROM q JOIN al USING (a) UNION ALL
SELECT CAST(x.id AS BIGINT), y.id, CASE WHEN x.h = y.h THEN 4 ELSE 2 END FROM c x JOIN c y ON x.p_size = y.p_size AND x.even = y.even WHERE CAST(x.id AS BIGINT) % 50 = 0)
SELECT query_id, entity_id, CAST(sum(score) AS BIGINT) AS score FROM ev GROUP BY 1, 2"""


#: Example names, each with the variants that the rules give.
NAMED = {
    "L-Alanine": "L-Alanine",
    "DL-Lactic acid": "Lactate|D-Lactate|L-Lactate|DL-Lactate|Lactic acid|D-Lactic acid|L-Lactic acid|DL-Lactic acid",
    "Sodium acetate trihydrate": "acetate|acetic acid|Sodium acetate trihydrate",
    "Calcium chloride hemihydrate": "chloride|Calcium chloride hemihydrate",
    "Citric acid trisodium salt": "Citrate|Citric acid|Citric acid trisodium salt",
    "Zinc sulfate": "Zinc sulfate|Zinc sulfic acid",
    "Nitrous acid": "Nitrite|Nitrous acid",
    "Glycine hydrochloride": "Glycine|Glycine hydrochloride",
}


def named_compound():
    """Each part as one of the examples."""
    return F.element_at(F.array(*map(F.lit, NAMED)), (F.col("p_partkey") % len(NAMED) + 1).cast("int"))


def fallback(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_totalprice") > 300_000).alias("in_template"))
    return matching.preferred(o, "o_custkey", "in_template")


def translated(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("term"))
    a = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("term"), F.col("l_partkey").alias("reaction"))
    return matching.translated(o, a, table(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").alias("reaction"))).groupBy("term").agg(F.count("*").alias("n"), F.min("reaction").alias("low"))


def by_function(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    mapping = p.where("p_partkey % 2 = 0").select(F.md5(F.col("p_partkey").cast("string")).alias("function_hash"), F.col("p_name").alias("function_description"), F.concat(F.lit("rxn"), F.col("p_partkey")).alias("reaction_id"), F.col("p_retailprice").alias("score"))
    functions = p.where("p_partkey % 5 = 0").select(F.md5(F.col("p_partkey").cast("string")).alias("function_hash"), F.upper("p_name").alias("description"))
    gone = p.where("p_partkey % 3 = 0").select(F.concat(F.lit("rxn"), F.col("p_partkey")).alias("id"))
    return matching.function_reactions(functions, mapping, gone).groupBy("function_hash").agg(F.count("*").alias("n"), F.max("reaction_id").alias("last"))


def reaction_hits(spark, sf_dir):
    """A search: its queries are the reactions whose key 50 divides, its candidates all reactions. Names and EC numbers are given by keys."""
    summary = biochem.net(stoichiometry(spark, sf_dir))
    s = summary.select("reaction_id", F.col("base").alias("compound"), F.col("total").alias("coefficient"), "transport")
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("reaction_id")).distinct()
    asked = F.col("reaction_id") % 50 == 0
    named = line.where(asked).select(F.col("reaction_id").alias("query_id"), F.explode(F.array(F.col("reaction_id") + 1, F.col("reaction_id") + 2, F.col("reaction_id") + 3)).alias("entity_id"), F.lit(2).alias("n"))
    named = named.join(line.withColumnRenamed("reaction_id", "entity_id"), "entity_id")
    ec = lambda k: F.concat_ws(".", F.lit("1"), (k % 4999).cast("string"), F.lit("1"), (k % 3).cast("string"))
    ecs = line.where(asked).select(F.col("reaction_id").alias("query_id"), ec(F.col("reaction_id")).alias("ec"))
    theirs = line.where(~asked).select(F.col("reaction_id").alias("entity_id"), ec(F.col("reaction_id")).alias("ec"))
    proton = lambda key: table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias(key), (F.col("o_custkey") % 3 - 1).cast("double").alias("protons"))
    own = s.withColumnRenamed("reaction_id", "entity_id")
    return matching.reactions(s.where(asked).withColumnRenamed("reaction_id", "query_id"), own, named, ecs, theirs, protons=proton("query_id"), reference_protons=proton("entity_id")).select("query_id", "entity_id", F.round("score", 6).alias("score"))


_REACTIONS = f"""WITH {_STOICH}, nt AS (SELECT reaction_id AS r, compound_id AS c, sum(coefficient) AS k, CASE WHEN count(*) > 1 THEN arg_min(coefficient, CASE compartment WHEN 'e' THEN 1 WHEN 'p' THEN 2 ELSE 4 END) END AS t FROM s GROUP BY 1, 2),
sz AS (SELECT r, count(*) AS n, count(t) AS moved, max(abs(k)) < 1e-9 AS pure FROM nt GROUP BY 1), li AS (SELECT DISTINCT l_orderkey AS r FROM lineitem),
named AS (SELECT q.r AS q, e.r AS e FROM li q JOIN li e ON e.r IN (q.r + 1, q.r + 2, q.r + 3) WHERE q.r % 50 = 0),
ec AS (SELECT r, r % 4999 AS a, r % 3 AS b FROM li), full_ AS (SELECT x.r AS q, y.r AS e FROM ec x JOIN ec y ON x.a = y.a AND x.b = y.b WHERE x.r % 50 = 0 AND y.r % 50 <> 0),
near AS (SELECT x.r AS q, y.r AS e FROM ec x JOIN ec y ON x.a = y.a WHERE x.r % 50 = 0 AND y.r % 50 <> 0 AND (x.a, x.b) NOT IN (SELECT (a, b) FROM ec WHERE r % 50 <> 0)),
told AS (SELECT q, e, CAST(sum(v) AS DOUBLE) AS told FROM (SELECT DISTINCT q, e, 10 AS v FROM named UNION ALL SELECT DISTINCT q, e, 8 FROM full_ UNION ALL SELECT DISTINCT q, e, 6 FROM near) GROUP BY 1, 2),
m AS (SELECT a.r AS q, b.r AS e, count(*) FILTER (a.k = -b.k) AS v, count(*) FILTER (a.k = b.k) AS p, count(*) FILTER (a.t = -b.t) AS tv, count(*) FILTER (a.t = b.t) AS tp FROM nt a JOIN nt b USING (c) WHERE a.r % 50 = 0 GROUP BY 1, 2),
j AS (SELECT coalesce(told.q, m.q) AS q, coalesce(told.e, m.e) AS e, coalesce(told, 0) AS told, told.q IS NOT NULL AS named, coalesce(v, 0) AS v, coalesce(p, 0) AS p, coalesce(tv, 0) AS tv, coalesce(tp, 0) AS tp FROM told FULL JOIN (SELECT * FROM m WHERE v + p + tv + tp > 0) m ON told.q = m.q AND told.e = m.e),
w AS (SELECT j.*, x.n, x.moved, x.pure, CASE WHEN x.n <= 2 THEN 0 ELSE 1 END AS miss, y.n AS n2, o1.o_custkey % 3 - 1 AS h, o2.o_custkey % 3 - 1 AS h2 FROM j LEFT JOIN sz x ON x.r = j.q LEFT JOIN sz y ON y.r = j.e LEFT JOIN orders o1 ON o1.o_orderkey = j.q LEFT JOIN orders o2 ON o2.o_orderkey = j.e),
a AS (SELECT *, coalesce(v > 0 AND (named OR (v >= n - miss AND n = n2)), false) AS e1 FROM w), b AS (SELECT *, coalesce(tv > 0 AND tv = moved AND (named OR e1 OR pure), false) AS t1 FROM a),
c2 AS (SELECT *, coalesce(p > 0 AND (named OR e1 OR t1 OR (p >= n - miss AND n = n2)), false) AS e2 FROM b), d AS (SELECT *, coalesce(tp > 0 AND tp = moved AND (named OR e1 OR t1 OR e2 OR pure), false) AS t2 FROM c2)
SELECT q AS query_id, e AS entity_id, round(told + CASE WHEN e1 THEN 20.0::DOUBLE * v / n ELSE 0 END + CASE WHEN t1 THEN 10 * tv ELSE 0 END + CASE WHEN (named OR e1 OR t1) AND -h = h2 THEN 2 ELSE 0 END
+ CASE WHEN e2 THEN 20.0::DOUBLE * p / n ELSE 0 END + CASE WHEN t2 THEN 10 * tp ELSE 0 END + CASE WHEN (named OR e1 OR t1 OR e2 OR t2) AND h = h2 THEN 2 ELSE 0 END, 6) AS score FROM d WHERE named OR e1 OR t1 OR e2 OR t2"""


def balance(spark, sf_dir):
    return biochem.balance(stoichiometry(spark, sf_dir), compounds(spark, sf_dir))


def energies(spark, sf_dir):
    out = biochem.energies(stoichiometry(spark, sf_dir), compounds(spark, sf_dir).where("id % 5 <> 0"))
    return out.select("reaction_id", F.round("deltag", 3).alias("deltag"), F.round("error", 3).alias("error"), F.array_join("missing", ",").alias("missing"))


def transfers(spark, sf_dir):
    pairs = spark.createDataFrame([("e", "p"), ("e", "c"), ("p", "c")], "first string, second string")
    return biochem.ion_transfer(stoichiometry(spark, sf_dir), compounds(spark, sf_dir).select("id", "charge"), pairs)


def stoich_diff(spark, sf_dir):
    n = lambda flag: table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == flag).groupBy(F.col("l_partkey").alias("compound_id")).agg(F.max("l_quantity").alias("coefficient"))
    return biochem.stoichiometry_diff(n("R").where("compound_id % 6 <> 0"), n("A").where("compound_id % 7 <> 0"))


def genes(spark, sf_dir):
    """hits between orders of one customer, adjusted by the parts that both have."""
    o = table(spark, sf_dir, "orders")
    hits = o.select("o_custkey", F.col("o_orderkey").alias("query_id")).join(o.select("o_custkey", F.col("o_orderkey").alias("entity_id")), "o_custkey").where("query_id < entity_id").select("query_id", "entity_id", F.lit(10).alias("score"))
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_partkey") % 40).alias("gene"))
    return matching.gene_adjusted(hits, line.withColumnRenamed("l_orderkey", "query_id"), line.withColumnRenamed("l_orderkey", "entity_id"))


_GENES = """WITH o AS (SELECT * FROM orders), g AS (SELECT DISTINCT l_orderkey AS k, l_partkey % 40 AS gene FROM lineitem), n AS (SELECT k, count(*) AS n FROM g GROUP BY 1),
h AS (SELECT a.o_orderkey AS q, b.o_orderkey AS e FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey), sh AS (SELECT q, e, count(*) AS s FROM h JOIN g x ON x.k = q JOIN g y ON y.k = e AND y.gene = x.gene GROUP BY 1, 2)
SELECT h.q AS query_id, h.e AS entity_id, 10 + 10 * coalesce(s, 0) - 5 * (coalesce(a.n, 0) - coalesce(s, 0)) - 5 * (coalesce(b.n, 0) - coalesce(s, 0)) AS score, coalesce(s, 0) AS gene_matches
FROM h LEFT JOIN sh USING (q, e) LEFT JOIN n a ON a.k = h.q LEFT JOIN n b ON b.k = h.e"""


def resolved(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    wanted = table(spark, sf_dir, "supplier").select("s_name").union(c.select("c_name").limit(0)).withColumnRenamed("s_name", "name").union(c.where("c_custkey % 9 = 0").select("c_mktsegment")).distinct()
    features = table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_name").alias("id"))
    return matching.resolved(wanted, features, c.select(F.col("c_mktsegment").alias("alias"), F.col("c_name").alias("id")))


def best_hits(spark, sf_dir):
    f = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("feature_id"))
    o = table(spark, sf_dir, "orders").where("o_orderkey % 3 <> 0").select(F.col("o_custkey").alias("feature_id"), F.col("o_orderkey").alias("hit_id"), F.col("o_totalprice").alias("score"))
    a = table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("feature_id"), F.col("o_orderkey").alias("hit_id"), (1 / F.col("o_totalprice")).alias("evalue"))
    return matching.best_hits(f, o, a).select("feature_id", "n_hits", "best_hit", "score")


def comparison(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    part = lambda flag, k: line.where(F.col("l_returnflag") == flag).where(F.col("l_partkey") % k != 0).select(F.col("l_partkey").alias("reaction"))
    return matching.model_comparison(part("R", 5), part("A", 4))


def records(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    g = line.select(F.col("l_orderkey").alias("gene"), F.col("l_partkey").cast("string").alias("reaction"))
    m = table(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").cast("string").alias("reaction"), F.concat(F.lit("ms"), F.col("p_size")).alias("ms_reaction"))
    sp = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("reaction"), F.col("p_brand").alias("compound"))
    return matching.annotation_records(g, m, sp)


def by_alias(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    f = c.select(F.col("c_custkey").alias("id"), F.array(F.struct(F.lit("seg").alias("source"), F.col("c_mktsegment").alias("value"))).alias("aliases"), F.md5("c_name").alias("md5"), F.lit(None).cast("string").alias("protein_md5"))
    return genomes.alias_index(f).select("alias", F.size("ids").alias("n"), F.element_at("ids", 1).alias("first"))


QUERIES = {
    "alias_match_score": scored,
    "reaction_match_score": reaction_hits,
    "gene_adjusted_score": genes,
    "semi_with_fallback": fallback,
    "anti_filter_translate": translated,
    "function_reactions": by_function,
    "feature_alias_resolution": resolved,
    "best_hits_for_features": best_hits,
    "model_comparison": comparison,
    "annotation_records": records,
    "alias_index": by_alias,
    "match_count_frequency": lambda s, d: matching.match_counts(table(s, d, "orders").select(F.col("o_custkey").alias("query_id"))),
    "perfect_match": lambda s, d: matching.perfect(table(s, d, "orders").select(F.col("o_custkey").alias("query_id"), (F.col("o_orderkey") % 3).alias("mismatches"), (F.col("o_orderkey") % 5).alias("agreements"), F.col("o_totalprice").alias("score"), (F.col("o_orderstatus") == "F").alias("in_template"), F.col("o_orderkey").alias("entity_id"))).select("query_id", "entity_id"),
    "prefix_match": lambda s, d: matching.prefix_matched(table(s, d, "customer").select(F.col("c_name").alias("name"), F.col("c_name").alias("inchikey")), table(s, d, "customer").where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("at"), F.col("c_name").alias("inchikey"), F.col("c_mktsegment").alias("value"))).select("name", "value"),
    "element_topk": lambda s, d: biochem.common_elements(compounds(s, d).select(F.concat("formula", F.lit("Cl2C")).alias("formula")), 4),
    "element_counts": lambda s, d: biochem.element_counts(compounds(s, d)),
    "compounds_by_charge": lambda s, d: biochem.by_charge(compounds(s, d)),
    "reaction_balance": balance,
    "reaction_energy": energies,
    "net_stoichiometry": lambda s, d: biochem.net(stoichiometry(s, d)),
    "pure_transport": lambda s, d: biochem.pure_transport(biochem.net(stoichiometry(s, d))),
    "ion_transfer": transfers,
    "remove_periplasm": lambda s, d: biochem.without_periplasm(stoichiometry(s, d)),
    "stoich_diff": stoich_diff,
    "reaction_direction": lambda s, d: table(s, d, "supplier").select("s_suppkey", chemistry.direction(F.col("s_acctbal") - 6000, F.col("s_acctbal") - 2000).alias("direction")),
    "role_search_key": lambda s, d: table(s, d, "documents").select("doc_id", names.role_key(F.substring("text", 1, 1 << 30)).alias("k")).select("doc_id", F.md5("k").alias("key_md5")),
    "identifier_standard": lambda s, d: table(s, d, "part").select("p_partkey", names.standard(F.concat("p_brand", F.lit("_DASH_"), "p_name")).alias("std")),
    "function_split_explode": lambda s, d: table(s, d, "part").select("p_partkey", F.explode(names.functions_of(F.concat("p_name", F.lit(" / "), "p_brand", F.lit("; "), "p_type"))).alias("function")),
    "compound_name_variants": lambda s, d: table(s, d, "part").select("p_partkey", F.array_join(names.name_variants(named_compound()), "|").alias("variants")),
    "known_energy": lambda s, d: table(s, d, "supplier").select("s_suppkey", chemistry.known_energy(F.when(F.col("s_suppkey") % 3 == 0, "10000000").when(F.col("s_suppkey") % 3 == 1, "-10000000").otherwise(F.col("s_acctbal").cast("string"))).alias("energy")),
    "ec_prefix": lambda s, d: table(s, d, "part").select("p_partkey", names.ec_prefix(F.concat_ws(".", F.col("p_size") % 6, F.col("p_size") % 11, F.col("p_partkey") % 13, F.col("p_partkey"))).alias("prefix")),
}

ORACLES = {
    "alias_match_score": _SCORED,
    "reaction_match_score": _REACTIONS,
    "gene_adjusted_score": _GENES,
    "semi_with_fallback": "SELECT o_custkey, o_orderkey, t AS in_template FROM (SELECT o_custkey, o_orderkey, o_totalprice > 300000 AS t, max(o_totalprice) OVER (PARTITION BY o_custkey) > 300000 AS a FROM orders) WHERE t OR NOT a",
    "anti_filter_translate": "SELECT l_orderkey AS term, count(*) AS n, min(l_partkey) AS low FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 25) GROUP BY 1",
    "function_reactions": "WITH m AS (SELECT p_partkey AS k, md5(CAST(p_partkey AS VARCHAR)) AS h, regexp_replace(lower(p_name), '\\s', '', 'g') AS d FROM part WHERE p_partkey % 2 = 0), f AS (SELECT md5(CAST(p_partkey AS VARCHAR)) AS h, regexp_replace(lower(p_name), '\\s', '', 'g') AS d FROM part WHERE p_partkey % 5 = 0), r AS (SELECT f.h, m.k FROM f JOIN m USING (h) UNION ALL SELECT f.h, m.k FROM f JOIN m USING (d) WHERE f.h NOT IN (SELECT h FROM m)) SELECT h AS function_hash, count(*) AS n, max('rxn' || k) AS last FROM r WHERE k % 3 <> 0 GROUP BY 1",
    "feature_alias_resolution": "WITH w AS (SELECT s_name AS name FROM supplier UNION SELECT c_mktsegment FROM customer WHERE c_custkey % 9 = 0), a AS (SELECT c_mktsegment AS name, min(c_name) AS i FROM customer GROUP BY 1) SELECT w.name, coalesce(s_name, i) AS feature_id, s_name IS NOT NULL OR i IS NOT NULL AS found FROM w LEFT JOIN (SELECT s_name FROM supplier WHERE s_suppkey % 2 = 0) ON s_name = w.name LEFT JOIN a USING (name)",
    "best_hits_for_features": "WITH h AS (SELECT * FROM orders WHERE o_orderkey % 3 <> 0), n AS (SELECT o_custkey, count(*) AS n_hits FROM h GROUP BY 1), b AS (SELECT o_custkey, arg_min(o_orderkey, (1 / o_totalprice, o_orderkey)) AS best_hit FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1) SELECT c_custkey AS feature_id, n_hits, best_hit, h.o_totalprice AS score FROM customer LEFT JOIN n ON n.o_custkey = c_custkey LEFT JOIN b ON b.o_custkey = c_custkey LEFT JOIN h ON h.o_custkey = c_custkey AND h.o_orderkey = best_hit",
    "model_comparison": "WITH a AS (SELECT DISTINCT l_partkey AS r FROM lineitem WHERE l_returnflag = 'R' AND l_partkey % 5 <> 0), b AS (SELECT DISTINCT l_partkey AS r FROM lineitem WHERE l_returnflag = 'A' AND l_partkey % 4 <> 0) SELECT coalesce(a.r, b.r) AS reaction, CASE WHEN a.r IS NULL THEN 'OtherOnly' WHEN b.r IS NULL THEN 'ModelOnly' ELSE 'Both' END AS status FROM a FULL JOIN b ON a.r = b.r",
    "annotation_records": "WITH g AS (SELECT l_orderkey AS gene, l_partkey AS r FROM lineitem) SELECT DISTINCT gene, 'reaction' AS namespace, CASE WHEN r % 2 = 0 THEN 'ms' || p_size ELSE CAST(r AS VARCHAR) END AS id FROM g LEFT JOIN part ON p_partkey = r UNION SELECT DISTINCT gene, 'compound', p_brand FROM g JOIN part ON p_partkey = r",
    "alias_index": "SELECT alias, CAST(count(DISTINCT id) AS INTEGER) AS n, min(id) AS first FROM (SELECT c_mktsegment AS alias, c_custkey AS id FROM customer UNION ALL SELECT md5(c_name), c_custkey FROM customer) GROUP BY 1",
    "match_count_frequency": "SELECT n AS match_count, count(*) AS n_rows FROM (SELECT count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) GROUP BY 1",
    "perfect_match": "SELECT query_id, entity_id FROM (SELECT o_custkey AS query_id, o_orderkey AS entity_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 3, o_orderkey % 5 DESC, o_totalprice DESC, (o_orderstatus = 'F') DESC, o_orderkey) AS n FROM orders) WHERE n = 1",
    "prefix_match": "WITH e AS (SELECT c_name[:length(c_name) - 2] AS p, arg_min(c_mktsegment, c_custkey) AS value FROM customer WHERE c_custkey % 4 = 0 GROUP BY 1) SELECT c_name AS name, value FROM customer LEFT JOIN e ON p = c_name[:length(c_name) - 2]",
    "element_topk": f"SELECT element, count(*) AS n FROM (SELECT unnest(regexp_extract_all({_SQL_FORMULA} || 'Cl2C', '[A-Z][a-z]?')) AS element FROM part) GROUP BY 1 ORDER BY n DESC, element LIMIT 4",
    "element_counts": f"WITH {_COMPOUNDS}, {_ELEMENTS} SELECT id, element, CAST(n AS BIGINT) AS n FROM el",
    "compounds_by_charge": "SELECT CAST(p_partkey % 3 - 1 AS INTEGER) AS charge, count(*) AS n FROM part GROUP BY 1",
    "reaction_balance": f"WITH {_STOICH}, {_COMPOUNDS}, {_ELEMENTS} SELECT reaction_id, element AS kind, CAST(sum(coefficient * n) AS DOUBLE) AS amount FROM s JOIN el ON id = compound_id GROUP BY 1, 2 HAVING sum(coefficient * n) <> 0 UNION ALL SELECT reaction_id, 'charge', sum(coefficient * charge) FROM s JOIN c ON id = compound_id GROUP BY 1 HAVING sum(coefficient * charge) <> 0",
    "reaction_energy": f"WITH {_STOICH}, {_COMPOUNDS}, k AS (SELECT * FROM c WHERE CAST(id AS BIGINT) % 5 <> 0) SELECT reaction_id, round(sum(coefficient * g), 3) AS deltag, round(sqrt(sum(CASE WHEN g IS NOT NULL THEN coefficient * coefficient * 4 END)), 3) AS error, coalesce(string_agg(DISTINCT CASE WHEN g IS NULL THEN compound_id END, ',' ORDER BY CASE WHEN g IS NULL THEN compound_id END), '') AS missing FROM s LEFT JOIN k ON id = compound_id GROUP BY 1",
    "net_stoichiometry": f"WITH {_STOICH} SELECT reaction_id, compound_id AS base, sum(coefficient) AS total, CASE WHEN count(*) > 1 THEN arg_min(coefficient, CASE compartment WHEN 'e' THEN 1 WHEN 'p' THEN 2 ELSE 4 END) END AS transport FROM s GROUP BY 1, 2",
    "pure_transport": f"WITH {_STOICH} SELECT reaction_id, max(abs(t)) < 1e-9 AS pure_transport FROM (SELECT reaction_id, compound_id, sum(coefficient) AS t FROM s GROUP BY 1, 2) GROUP BY 1",
    "ion_transfer": f"WITH {_STOICH}, {_COMPOUNDS} SELECT a.reaction_id, a.compartment AS first, b.compartment AS second, sum(-least(abs(a.coefficient), abs(b.coefficient)) * charge * sign(b.coefficient)) AS charge_moved FROM s a JOIN s b ON a.reaction_id = b.reaction_id AND a.compound_id = b.compound_id AND a.coefficient * b.coefficient < 0 JOIN c ON id = a.compound_id WHERE (a.compartment, b.compartment) IN (('e', 'p'), ('e', 'c'), ('p', 'c')) GROUP BY 1, 2, 3",
    "remove_periplasm": f"WITH {_STOICH} SELECT reaction_id, compound_id, CASE WHEN compartment = 'p' THEN 'e' ELSE compartment END AS compartment, sum(coefficient) AS coefficient FROM s GROUP BY 1, 2, 3 HAVING sum(coefficient) <> 0",
    "stoich_diff": "WITH a AS (SELECT l_partkey AS k, max(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'R' AND l_partkey % 6 <> 0 GROUP BY 1), b AS (SELECT l_partkey AS k, max(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'A' AND l_partkey % 7 <> 0 GROUP BY 1) SELECT coalesce(a.k, b.k) AS compound_id, CASE WHEN b.q IS NULL THEN 'only_in_a' WHEN a.q IS NULL THEN 'only_in_b' ELSE 'differs' END AS kind, a.q AS a, b.q AS b FROM a FULL JOIN b ON a.k = b.k WHERE a.q IS NULL OR b.q IS NULL OR abs(a.q - b.q) > 1e-8 + 1e-5 * abs(b.q)",
    "reaction_direction": "SELECT s_suppkey, CASE WHEN lo < 0 AND hi > 0 THEN 'reversible' WHEN hi > 0 THEN 'forward' WHEN lo < 0 THEN 'reverse' ELSE 'blocked' END AS direction FROM (SELECT s_suppkey, s_acctbal - 6000 AS lo, s_acctbal - 2000 AS hi FROM supplier)",
    "role_search_key": r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '\s', '', 'g'), '[\d\-]+\.[\d\-]+\.[\d\-]+\.[\d\-]*\d', '', 'g'), '#.*$', ''), '\(ec:?\)', '', 'g'), '[()\[\],-]', '', 'g')) AS key_md5 FROM documents",
    "identifier_standard": "SELECT p_partkey, regexp_replace(lower(p_brand || p_name), '[^a-z0-9]', '', 'g') AS std FROM part",
    "function_split_explode": "SELECT p_partkey, unnest([p_name, p_brand, p_type]) AS function FROM part",
    "compound_name_variants": f"SELECT p_partkey, ({list(NAMED.values())})[p_partkey % {len(NAMED)} + 1] AS variants FROM part",
    "known_energy": "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 2 THEN CAST(s_acctbal AS DOUBLE) END AS energy FROM supplier",
    "ec_prefix": "SELECT p_partkey, (p_size % 6) || '.' || (p_size % 11) || '.' || (p_partkey % 13) AS prefix FROM part",
}
