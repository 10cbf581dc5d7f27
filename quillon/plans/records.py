"""Queries of names, references, features, ontology terms, model matches and files written from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import chemistry, names
from quillon.operators import biochem, catalog, genomes, matching
from quillon.plans import table
from quillon.plans.matching import _STOICH, compounds, stoichiometry
from quillon.sources import files, sinks

#: Lineages and labels to be told apart.
LINEAGES = ["d__Bacteria;p__Pseudomonadota;g__Escherichia;s__", "d__Archaea;p__X", "Eukaryota;Fungi;s__Y z", "d__Bacteria;g__;s__"]
LABELS = ["Growth - yes", "poor — late", "none", "odd"]


def part(spark, sf_dir):
    return table(spark, sf_dir, "part")


def at(items, key):
    return F.element_at(F.array(*map(F.lit, items)), (F.col(key) % len(items) + 1).cast("int"))


def proteins(spark, sf_dir):
    """Customers as features of their segment's genome; every fifth has no protein."""
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_mktsegment").alias("genome_id"), F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 5 != 0, F.upper("c_name")).alias("protein_translation"), F.when(F.col("c_custkey") % 2 == 0, "CDS").otherwise("gene").alias("type"))


def terms(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    return line.select(F.col("l_partkey").alias("gene"), F.col("l_returnflag").alias("ontology"), F.concat(F.lit("T:"), F.col("l_suppkey") % 50).alias("term"))


_TERMS = "t AS (SELECT DISTINCT l_partkey AS gene, l_returnflag AS ontology, 'T:' || (l_suppkey % 50) AS term FROM lineitem)"


def by_md5(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    known = c.where("c_custkey % 3 <> 0").select(F.md5("c_name").alias("md5"), F.when(F.col("c_custkey") % 2 == 0, "NA").otherwise("AA").alias("kind"), F.col("c_name").alias("sequence"))
    return genomes.sequences_of(c.select(F.col("c_custkey").alias("id"), F.md5("c_name").alias("na_md5"), F.md5("c_name").alias("aa_md5")), known).select("id", "dna", "protein")


def merged(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_orderstatus").alias("value"))
    new = o.where("event_id % 3 = 0").withColumn("value", F.lit("new"))
    return genomes.merged_events(o.where("event_id % 2 = 0"), new)


def hashed(last):
    def run(spark, sf_dir):
        line = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("namespace"), F.concat(F.lit("a"), F.col("l_suppkey")).alias("alias"), F.col("l_partkey").alias("id")).agg(F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"))
        return genomes.alias_hash(line, last).select("namespace", "alias", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))

    return run


_FIRST_SEEN = "r AS (SELECT l_returnflag AS namespace, 'a' || l_suppkey AS alias, l_partkey AS id, min(l_orderkey * 10 + l_linenumber) AS seen FROM lineitem GROUP BY 1, 2, 3)"


def upgraded(spark, sf_dir):
    f = part(spark, sf_dir).select("p_partkey", F.array(F.concat(F.lit("kegg:"), "p_brand"), F.concat(F.lit("box"), "p_size")).alias("aliases"), F.concat("p_type", F.lit(" / "), "p_brand").alias("function"))
    u = genomes.upgraded_aliases(f)
    return u.select("p_partkey", F.array_join(F.transform("aliases", lambda a: F.concat(a["source"], F.lit("="), a["value"])), "|").alias("aliases"), F.array_join("functions", "|").alias("functions"))


def annotated(spark, sf_dir):
    """Parts as features; as in SQL, null where an ontology has no terms."""
    f = part(spark, sf_dir).select(F.col("p_partkey").alias("id"), F.lit(10).alias("start"), F.col("p_size").alias("length"))
    out = genomes.annotation_table(f, terms(spark, sf_dir), ["A", "N", "R"])
    return out.select("id", "end", *[F.nullif(F.col(f"`Annotation:{o}`"), F.lit("")).alias(f"terms_{o.lower()}") for o in "ANR"])


def gene_status(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("reaction"), F.concat(F.when(F.col("l_suppkey") % 11 == 0, "mRNA").otherwise("g"), F.col("l_suppkey") % 7).alias("gene"), "l_returnflag")
    return matching.gene_status(line.where("l_returnflag = 'R'"), line.where("l_returnflag = 'A'"))


_STATUS = """l AS (SELECT DISTINCT l_partkey AS reaction, CASE WHEN l_suppkey % 11 = 0 THEN 'mRNA' ELSE 'g' END || (l_suppkey % 7) AS gene, l_returnflag AS f FROM lineitem),
j AS (SELECT coalesce(a.reaction, b.reaction) AS reaction, a.gene IS NOT NULL AS x, b.gene IS NOT NULL AS y FROM (SELECT * FROM l WHERE f = 'R') a FULL JOIN (SELECT * FROM l WHERE f = 'A' AND NOT starts_with(gene, 'mRNA')) b ON a.reaction = b.reaction AND a.gene = b.gene),
k AS (SELECT reaction, bool_or(x AND y) AS m, bool_or(x AND NOT y) AS x, bool_or(y AND NOT x) AS y FROM j GROUP BY 1)"""


def renamed(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    ids = c.select(F.concat(F.lit("i"), F.col("c_custkey")).alias("id"), F.col("c_custkey").alias("at"))
    mapping = c.where("c_custkey % 2 = 0").select(F.concat(F.lit("i"), F.col("c_custkey")).alias("id"), F.when(F.col("c_custkey") % 10 == 0, F.concat(F.lit("i"), F.col("c_custkey") + 1)).otherwise(F.concat(F.lit("n"), F.floor(F.col("c_custkey") / 6))).alias("new_id"))
    return matching.renamed(ids, mapping, ids)


def structure_keys(spark, sf_dir):
    p = part(spark, sf_dir).select(F.col("p_partkey").cast("string").alias("id"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).alias("inchi"), F.col("p_brand").alias("smiles"), F.concat_ws("-", "p_size", "p_type", "p_brand").alias("inchikey"))
    return matching.structures(p)


def fasta_read(spark, sf_dir):
    """Documents' sources as records, written and read again; of records of one name one stays, here all are equal."""
    path = sinks.shared_path(spark, "fasta")
    c = table(spark, sf_dir, "customer").select(F.col("c_name").alias("id"), F.repeat(F.translate(F.md5("c_name"), "0123456789abcdef", "ACGTACGTACGTACGT"), 4).alias("sequence"))
    sinks.fasta(c, path)
    return files.fasta(spark, path).select("id", "sequence")


def text_file(spark, label, lines):
    path = sinks.shared_path(spark, label)
    lines.write.text(path)
    return path


def filters_read(spark, sf_dir):
    p = part(spark, sf_dir).select("p_brand", "p_name", "p_partkey")
    path = sinks.shared_path(spark, "filters")
    sinks.tsv(p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("reason")), path)
    return files.filter_list(spark, path)


def mapping_read(spark, sf_dir):
    path = sinks.shared_path(spark, "mapping")
    part(spark, sf_dir).select(F.col("p_type").alias("function_description"), F.col("p_partkey").alias("reaction_id")).write.parquet(path)
    return files.reaction_mapping(spark, path).select("reaction_id", "key")


def clusters_read(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    path = text_file(spark, "clusters", c.select(F.when(F.col("c_custkey") % 7 == 0, F.col("c_name")).otherwise(F.concat_ws("\t", "c_mktsegment", "c_name")).alias("value")))
    return files.cluster_pairs(spark, path).select("representative", "member")


def loci_read(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    line = F.concat_ws("\t", "s_name", F.lit("src"), F.when(F.col("s_suppkey") % 3 == 0, "gene").otherwise("CDS"), F.col("s_suppkey").cast("string"), (F.col("s_suppkey") + 90).cast("string"), F.lit("."), F.when(F.col("s_suppkey") % 2 == 0, "+").otherwise("-"), F.lit("0"), F.concat(F.lit("ID=x;locus_tag=L"), F.col("s_suppkey")))
    return files.gff_loci(spark, text_file(spark, "loci", s.select(line.alias("value"))))


def vectors_read(spark, sf_dir):
    path = sinks.shared_path(spark, "vectors")
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("v"), F.col("c_nationkey")).alias("vector_id"), F.col("c_custkey").cast("string").alias("entity_id"), F.lit("x").alias("column"), F.col("c_acctbal").alias("value"))
    sinks.vectors(c, path)
    return files.vectors(spark, path, "v7").select("entity_id", "value")


def media_read(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    as_json = F.concat(F.lit('{"cpd'), F.col("s_suppkey"), F.lit('": {"concentration": 0.5, "minimum": -'), F.col("s_nationkey"), F.lit(', "maximum": 7}}'))
    as_lines = F.concat(F.lit("cpd"), F.col("s_suppkey"), F.lit("\tn\t0.25\t-5\t"), F.col("s_nationkey"))
    return files.media(s.select(F.col("s_suppkey").alias("media_id"), F.when(F.col("s_suppkey") % 2 == 0, as_json).otherwise(as_lines).alias("raw")))


def listed(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("type"), F.concat(F.lit("n"), F.col("o_custkey")).alias("name"), F.col("o_orderkey").alias("at"))
    return files.latest_objects(o, "2-HIGH").select("name", "at")


def target_features(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("genome_id"))
    f = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("genome_id"), "s_name")
    return files.targets(n.where("genome_id < 10"), n.where("genome_id between 5 and 30"), f).groupBy("genome_id").agg(F.count("s_name").alias("n"))


def genes_called(spark, sf_dir):
    """Synthetic ids lead back to the records that they stand for, each to one."""
    p = part(spark, sf_dir).select(F.concat(F.lit("p"), F.col("p_partkey")).alias("id"), F.md5("p_name").alias("sequence"))
    records, ids = sinks.gene_calls(p)
    return records.join(ids, records.id == ids.gene).select("original", "sequence")


def blobs(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.md5(F.col("o_custkey").cast("string")).alias("content_hash"))
    return catalog.changed_blobs(o.where("id % 2 = 0"), o.where("id % 2 = 1"))


def registered(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("value"))
    once = o.groupBy("key").agg(F.min("value").alias("value"))
    return catalog.registered(once.where("key % 3 = 0"), o, "key")


QUERIES = {
    "list_parts": lambda s, d: part(s, d).select("p_partkey", F.array_join(names.parts_of(F.concat(F.lit("EC:1.1; "), "p_brand", F.lit(","), "p_type")), "|").alias("parts")),
    "term_tagged": lambda s, d: part(s, d).select("p_partkey", names.tagged(F.when(F.col("p_partkey") % 2 == 0, "ec").otherwise("ms"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("RXN:"), F.col("p_partkey"))).otherwise(F.col("p_brand")), {"MS": "MSRXN", "RXN": "MSRXN"}).alias("term")),
    "exchange_ids": lambda s, d: table(s, d, "supplier").select("s_suppkey", names.exchange(F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("EX_c"), F.col("s_suppkey"), F.lit("_e0"))).otherwise(F.concat(F.lit("c"), F.col("s_suppkey"), F.lit("[e0]")))).alias("exchange")),
    "refs_made": lambda s, d: table(s, d, "orders").select("o_orderkey", names.ref(F.col("o_custkey"), F.col("o_orderkey"), F.lit(1)).alias("ref"), names.is_ref(names.ref(F.col("o_custkey"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey").cast("string")).otherwise(F.lit("x")))).alias("valid"), names.without_version(names.ref(F.col("o_custkey"), F.col("o_orderkey"), F.lit(2))).alias("bare")),
    "shown_values": lambda s, d: table(s, d, "documents").select("doc_id", names.shown(F.col("text")).alias("shown")),
    "taxonomy_names": lambda s, d: part(s, d).select("p_partkey", names.domain(at(LINEAGES, "p_partkey")).alias("domain"), names.scientific_name(at(LINEAGES, "p_partkey")).alias("name")),
    "labels_known": lambda s, d: part(s, d).select("p_partkey", names.label(at(LABELS, "p_partkey"), {"growth": "grows"}, ["grows", "poor", "none"]).alias("label")),
    "compartment_letters": lambda s, d: part(s, d).select("p_partkey", names.compartment(at(["Cytosol", "periplasm", "Golgi", "z", "environment"], "p_partkey")).alias("letter")),
    "reaction_numbers": lambda s, d: part(s, d).select("p_partkey", names.reaction_id(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("a_rxn"), F.col("p_partkey"), F.lit("_c0"))).otherwise("none"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("see rxn"), F.col("p_size"))).otherwise("")).alias("reaction")),
    "event_ids": lambda s, d: table(s, d, "orders").select("o_orderkey", names.event_id(F.lit("m"), F.lit("1.0"), F.col("o_orderstatus"), F.col("o_custkey").cast("string")).alias("event")),
    "directions_combined": lambda s, d: part(s, d).select("p_partkey", chemistry.combined_directions(at(["forward", "reverse", "blocked"], "p_partkey"), at(["reversible", "odd"], "p_size")).alias("signals")),
    "proton_repair": lambda s, d: part(s, d).select("p_partkey", chemistry.proton_repair((F.col("p_partkey") % 4 - 1).cast("double"), (F.col("p_size") % 4 - 1).cast("double"), (F.col("p_partkey") % 2).cast("double")).alias("r")).select("p_partkey", "r.fixable", "r.protons"),
    "reaction_diffusion": lambda s, d: biochem.diffusion(stoichiometry(s, d)),
    "reaction_equation": lambda s, d: biochem.equation(stoichiometry(s, d).withColumn("reversible", F.col("reaction_id") % 2 == 0)),
    "protein_digest": lambda s, d: genomes.protein_digest(proteins(s, d)),
    "proteins_of": lambda s, d: genomes.proteins(proteins(s, d)),
    "coding_clones": lambda s, d: genomes.coding_clones(proteins(s, d).withColumn("id", F.col("id").cast("string"))).select("id", "type"),
    "features_normalised": lambda s, d: genomes.normalised(proteins(s, d).withColumn("id", F.floor(F.col("id") / 3))).groupBy("id", "kind").agg(F.count("*").alias("n")),
    "features_by_md5": by_md5,
    "features_all": lambda s, d: genomes.all_features(*[proteins(s, d).where(f"id % 4 = {k}").select("id") for k in range(4)]),
    "ontology_events": lambda s, d: genomes.events(terms(s, d)).select("ontology", F.explode("genes").alias("gene", "terms")).select("ontology", "gene", F.array_join("terms", ",").alias("terms")),
    "events_merged": merged,
    "alias_hash_all": hashed(False),
    "alias_hash_last": hashed(True),
    "aliases_upgraded": upgraded,
    "annotation_columns": annotated,
    "gene_status": gene_status,
    "strong_matches": lambda s, d: matching.strong(part(s, d).select(F.col("p_partkey").alias("query_id"), F.array(F.lit("formula"), F.when(F.col("p_partkey") % 2 == 0, "name").otherwise("formula")).alias("evidence"))).select("query_id", "strong"),
    "gene_reactions": lambda s, d: matching.gene_reactions(table(s, d, "lineitem").select(F.col("l_partkey").alias("gene"), (F.col("l_suppkey") % 10).alias("reaction"))).select("gene", F.array_join(F.col("reactions").cast("array<string>"), ",").alias("reactions")),
    "exchange_reactions": lambda s, d: matching.exchanges(table(s, d, "orders").select(F.concat(F.when(F.col("o_orderkey") % 2 == 0, "EX_c").otherwise("rxn"), F.col("o_custkey"), F.when(F.col("o_orderkey") % 4 == 0, "_e0").otherwise("[e0]")).alias("id"), F.col("o_orderkey").alias("at"))),
    "info_attached": lambda s, d: matching.attached(table(s, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey"), table(s, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), "c_name"), "k"),
    "ids_renamed": renamed,
    "structure_keys": structure_keys,
    "alias_types": lambda s, d: matching.aliases(compounds(s, d)).groupBy("alias_type").agg(F.count("*").alias("n"), F.countDistinct("entity_id").alias("entities")),
    "fasta_read": fasta_read,
    "filters_read": filters_read,
    "reaction_mapping_read": mapping_read,
    "clusters_read": clusters_read,
    "loci_read": loci_read,
    "vectors_read": vectors_read,
    "media_read": media_read,
    "objects_listed": listed,
    "target_features": target_features,
    "genes_called": genes_called,
    "blobs_changed": blobs,
    "objects_registered": registered,
    "log_appended": lambda s, d: catalog.appended(table(s, d, "region"), table(s, d, "nation").select(F.col("n_nationkey").alias("r_regionkey"), F.col("n_name").alias("r_name"))).select("r_regionkey", "r_name"),
    "rows_as_json": lambda s, d: sinks.json_records(table(s, d, "nation").select("n_nationkey", "n_name")),
}

_LABELLED = "CASE p_partkey % 4 WHEN 0 THEN 'grows' WHEN 1 THEN 'poor' WHEN 2 THEN 'none' ELSE 'Unknown' END"
ORACLES = {
    "list_parts": "SELECT p_partkey, array_to_string(list_transform(list_filter(regexp_split_to_array('EC:1.1; ' || p_brand || ',' || p_type, '[;,\\s]+'), lambda x: x <> ''), lambda x: regexp_replace(x, '^EC:', '')), '|') AS parts FROM part",
    "term_tagged": "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'EC:' ELSE 'MSRXN:' END || CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey AS VARCHAR) ELSE p_brand END AS term FROM part",
    "exchange_ids": "SELECT s_suppkey, 'EX_c' || s_suppkey || '_e0' AS exchange FROM supplier",
    "refs_made": "SELECT o_orderkey, o_custkey || '/' || o_orderkey || '/1' AS ref, o_orderkey % 2 = 0 AS valid, o_custkey || '/' || o_orderkey AS bare FROM orders",
    "shown_values": "SELECT doc_id, CASE WHEN length(text) > 80 THEN substring(text, 1, 80) || '... (' || (length(text) - 80) || ' more)' ELSE text END AS shown FROM documents",
    "taxonomy_names": "SELECT p_partkey, CASE p_partkey % 4 WHEN 1 THEN 'Archaea' WHEN 2 THEN 'Eukaryota' ELSE 'Bacteria' END AS domain, (['Escherichia', 'X', 'Y z', 'Bacteria'])[p_partkey % 4 + 1] AS name FROM part",
    "labels_known": f"SELECT p_partkey, {_LABELLED} AS label FROM part",
    "compartment_letters": "SELECT p_partkey, (['c', 'p', 'g', 'z', 'e'])[p_partkey % 5 + 1] AS letter FROM part",
    "reaction_numbers": "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'rxn' || p_partkey WHEN p_partkey % 3 = 0 THEN 'rxn' || p_size END AS reaction FROM part",
    "event_ids": "SELECT o_orderkey, 'm:1.0:' || o_orderstatus || ':' || o_custkey AS event FROM orders",
    "directions_combined": "SELECT p_partkey, (['>', '<', '0'])[p_partkey % 3 + 1] || '|' || (['=', '?'])[p_size % 2 + 1] AS signals FROM part",
    "proton_repair": "SELECT p_partkey, ok AS fixable, CASE WHEN ok THEN -h ELSE 0.0 END AS protons FROM (SELECT p_partkey, CAST(p_size % 4 - 1 AS DOUBLE) AS h, p_partkey % 2 = 0 AND p_partkey % 4 = p_size % 4 AND p_partkey % 4 <> 1 AS ok FROM part)",
    "reaction_diffusion": f"WITH {_STOICH} SELECT reaction_id, count(*) = 2 AND count(DISTINCT compound_id) = 1 AND count(DISTINCT compartment) = 2 AND min(coefficient) = -1 AND max(coefficient) = 1 AS diffusion FROM s GROUP BY 1",
    "reaction_equation": f"WITH {_STOICH}, x AS (SELECT reaction_id, coefficient < 0 AS l, CASE WHEN abs(coefficient) = 1 THEN '' ELSE CAST(abs(coefficient) AS BIGINT) || ' ' END || compound_id || '[' || compartment || ']' AS t FROM s) SELECT reaction_id, coalesce(string_agg(t, ' + ' ORDER BY t) FILTER (l), '') || CASE WHEN reaction_id % 2 = 0 THEN ' <=> ' ELSE ' => ' END || coalesce(string_agg(t, ' + ' ORDER BY t) FILTER (NOT l), '') AS equation FROM x GROUP BY 1",
    "protein_digest": "SELECT c_mktsegment AS genome_id, md5(string_agg(md5(upper(c_name)), ';' ORDER BY md5(upper(c_name)))) AS md5 FROM customer WHERE c_custkey % 5 <> 0 GROUP BY 1",
    "proteins_of": "SELECT c_custkey AS id, upper(c_name) AS protein_translation FROM customer WHERE c_custkey % 5 <> 0",
    "coding_clones": "SELECT c_custkey || '_CDS_1' AS id, 'CDS' AS type FROM customer WHERE c_custkey % 5 <> 0",
    "features_normalised": "WITH k AS (SELECT c_custkey // 3 AS id, CASE WHEN c_custkey % 5 = 0 THEN 2 WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END AS o FROM customer) SELECT id, (['gene', 'cds', 'noncoding'])[max(o) + 1] AS kind, CAST(1 AS BIGINT) AS n FROM k GROUP BY id",
    "features_by_md5": "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 2 = 0 THEN c_name END AS dna, CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 2 = 1 THEN c_name END AS protein FROM customer",
    "features_all": "SELECT c_custkey AS id, (['gene', 'cds', 'mrna', 'noncoding'])[c_custkey % 4 + 1] AS kind FROM customer",
    "ontology_events": f"WITH {_TERMS} SELECT ontology, gene, string_agg(term, ',' ORDER BY term) AS terms FROM t GROUP BY 1, 2",
    "events_merged": "SELECT o_orderkey AS event_id, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE o_orderstatus END AS value FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0",
    "alias_hash_all": f"WITH {_FIRST_SEEN} SELECT namespace, alias, string_agg(id, ',' ORDER BY seen, id) AS ids FROM r GROUP BY 1, 2",
    "alias_hash_last": f"WITH {_FIRST_SEEN} SELECT namespace, alias, CAST(arg_max(id, seen) AS VARCHAR) AS ids FROM r GROUP BY 1, 2",
    "aliases_upgraded": "SELECT p_partkey, 'kegg=' || p_brand || '|Unknown=box' || p_size AS aliases, p_type || '|' || p_brand AS functions FROM part",
    "annotation_columns": f"WITH {_TERMS} SELECT p_partkey AS id, 10 + p_size AS \"end\", {', '.join(f'''(SELECT string_agg(term, ';' ORDER BY term) FROM t WHERE gene = p_partkey AND ontology = '{o}') AS terms_{o.lower()}''' for o in 'ANR')} FROM part",
    "gene_status": f"WITH {_STATUS} SELECT r.reaction, CASE WHEN x AND y THEN 'ExtraBoth' WHEN x AND m THEN 'ExtraModel' WHEN x THEN 'ModelOnly' WHEN y AND m THEN 'ExtraMS' WHEN y THEN 'MSOnly' WHEN m THEN 'Match' ELSE 'NoGene' END AS gene_status FROM (SELECT DISTINCT reaction FROM l WHERE f = 'R') r LEFT JOIN k ON k.reaction = r.reaction",
    "strong_matches": "SELECT p_partkey AS query_id, p_partkey % 2 = 0 AS strong FROM part",
    "gene_reactions": "SELECT gene, string_agg(r, ',' ORDER BY r) AS reactions FROM (SELECT DISTINCT l_partkey AS gene, l_suppkey % 10 AS r FROM lineitem) GROUP BY 1",
    "exchange_reactions": "SELECT 'EX_c' || o_custkey || '_e0' AS exchange, arg_max('EX_c' || o_custkey || CASE WHEN o_orderkey % 4 = 0 THEN '_e0' ELSE '[e0]' END, o_orderkey) AS id FROM orders WHERE o_orderkey % 2 = 0 GROUP BY o_custkey",
    "info_attached": "SELECT o_custkey AS k, o_orderkey, c_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 2 = 0",
    "ids_renamed": "WITH m AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 10 = 0 THEN 'i' || (c_custkey + 1) ELSE 'n' || (c_custkey // 6) END AS new_id FROM customer WHERE c_custkey % 2 = 0), f AS (SELECT new_id, min(k) AS k FROM m WHERE new_id NOT IN (SELECT 'i' || c_custkey FROM customer) GROUP BY 1) SELECT 'i' || c_custkey AS id, coalesce(new_id, 'i' || c_custkey) AS new_id, new_id IS NOT NULL AS renamed FROM customer LEFT JOIN f ON k = c_custkey",
    "structure_keys": "WITH k AS (SELECT CAST(p_partkey AS VARCHAR) AS entity_id, CASE WHEN p_partkey % 3 = 0 THEN p_name END AS i, p_brand AS s, p_size || '-' || p_type || '-' || p_brand AS k FROM part) SELECT DISTINCT entity_id, key FROM (SELECT entity_id, unnest([i, s, k, split_part(k, '-', 1), split_part(k, '-', 1) || '-' || split_part(k, '-', 2)]) AS key FROM k) WHERE key <> ''",
    "alias_types": r"""WITH e AS (SELECT CAST(p_partkey AS VARCHAR) AS id, unnest([{'t': 'id', 'o': 0, 'a': CAST(p_partkey AS VARCHAR)}, {'t': 'name', 'o': 1, 'a': p_name}, {'t': 'synonym', 'o': 2, 'a': p_brand}, {'t': 'kind', 'o': 3, 'a': p_type}]) AS x FROM part),
n AS (SELECT id, x.t AS t, x.o AS o, regexp_replace(lower(x.a), '[^a-z0-9]', '', 'g') AS a FROM e), f AS (SELECT a, arg_min(t, (o, id)) AS t FROM n GROUP BY 1) SELECT f.t AS alias_type, count(*) AS n, count(DISTINCT id) AS entities FROM n JOIN f USING (a) GROUP BY 1""",
    "fasta_read": "SELECT c_name AS id, repeat(translate(md5(c_name), '0123456789abcdef', 'ACGTACGTACGTACGT'), 4) AS sequence FROM customer",
    "filters_read": "SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS reason FROM part",
    "reaction_mapping_read": "SELECT p_partkey AS reaction_id, regexp_replace(lower(p_type), '[\\s(),-]|\\[|\\]', '', 'g') AS key FROM part",
    "clusters_read": "SELECT c_mktsegment AS representative, c_name AS member FROM customer WHERE c_custkey % 7 <> 0",
    "loci_read": "SELECT 'L' || s_suppkey AS locus_tag, s_name AS contig, s_suppkey AS start, CASE WHEN s_suppkey % 2 = 0 THEN '+' ELSE '-' END AS strand FROM supplier WHERE s_suppkey % 3 <> 0",
    "vectors_read": "SELECT CAST(c_custkey AS VARCHAR) AS entity_id, c_acctbal AS value FROM customer WHERE c_nationkey = 7",
    "media_read": "SELECT s_suppkey AS media_id, 'cpd' || s_suppkey AS compound, CASE WHEN s_suppkey % 2 = 0 THEN 0.5 ELSE 0.25 END AS concentration, CASE WHEN s_suppkey % 2 = 0 THEN -s_nationkey ELSE -5.0 END AS minimum, CASE WHEN s_suppkey % 2 = 0 THEN 7.0 ELSE s_nationkey END AS maximum FROM supplier",
    "objects_listed": "SELECT 'n' || o_custkey AS name, max(o_orderkey) AS at FROM orders WHERE o_orderpriority = '2-HIGH' GROUP BY 1",
    "target_features": "WITH i AS (SELECT n_nationkey AS g FROM nation WHERE n_nationkey < 10 UNION ALL SELECT n_nationkey FROM nation WHERE n_nationkey BETWEEN 5 AND 30) SELECT g AS genome_id, count(s_name) AS n FROM i LEFT JOIN supplier ON s_nationkey = g GROUP BY 1",
    "genes_called": "SELECT 'p' || p_partkey AS original, md5(p_name) AS sequence FROM part",
    "blobs_changed": "SELECT o_orderkey AS id, md5(CAST(o_custkey AS VARCHAR)) AS content_hash FROM orders WHERE o_orderkey % 2 = 1 AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0)",
    "objects_registered": "SELECT o_custkey AS key, CASE WHEN o_custkey % 3 = 0 THEN min(o_orderkey) ELSE max(o_orderkey) END AS value FROM orders GROUP BY 1",
    "log_appended": "SELECT r_regionkey, r_name FROM region UNION ALL SELECT n_nationkey, n_name FROM nation",
    "rows_as_json": "SELECT '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}' AS value FROM nation",
}
