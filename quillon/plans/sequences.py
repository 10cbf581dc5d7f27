"""Sequence and genome queries, on DNA that the bytes of whole texts spell, or digests of names."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import chemistry, names, sequences
from quillon.operators import genomes
from quillon.plans import table
from quillon.sources import sinks

#: Hexadecimal digits as bases.
HEX, BASES = "0123456789abcdef", "ACGTACGTACGTACGT"


def dna(column):
    return F.translate(F.md5(column), HEX, BASES)


def spelt(column):
    """DNA as long as two bases a byte."""
    return F.translate(F.hex(column), HEX.upper(), BASES)


_SPELT = f"translate(hex(encode(text)), '{HEX.upper()}', '{BASES}')"


def contigs(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("genome_id"), F.concat(F.lit("c"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("contig_id"), F.concat(spelt("text"), F.when(F.col("doc_id") % 3 == 0, "NN").otherwise("")).alias("sequence"))


_CONTIGS = f"ct AS (SELECT source AS genome_id, 'c' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS contig_id, {_SPELT} || CASE WHEN doc_id % 3 = 0 THEN 'NN' ELSE '' END AS sequence FROM documents)"
_CODONS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in sequences.CODONS.items()) + "}"


def features(spark, sf_dir):
    """Orders as features on their customer's contig, the strand by parity; every third protein is the true one."""
    o = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", dna("c_name").alias("sequence"))
    cut = F.substring("sequence", 3, 12)
    protein = F.when(F.col("c_custkey") % 3 == 0, sequences.translate(cut)).when(F.col("c_custkey") % 3 == 1, sequences.translate(sequences.reverse_complement(cut))).otherwise("MKV")
    f = o.select(F.col("c_mktsegment").alias("genome_id"), F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 8 == 0, F.lit(-1)).otherwise(F.col("c_custkey")).alias("contig_id"), F.lit(3).alias("start"), F.lit(14).alias("end"), F.lit("+").alias("strand"), protein.alias("sequence"))
    c = o.select(F.col("c_mktsegment").alias("genome_id"), F.col("c_custkey").alias("contig_id"), "sequence")
    t = o.select(F.col("c_mktsegment").alias("genome_id"), F.lower("c_mktsegment").alias("taxonomy")).distinct()
    return genomes.placed_features(f, c, t)


def _sql_translate(s):
    return f"list_aggregate(list_transform(range(1, length({s}) - 1, 3), lambda i: {_CODONS}[{s}[i:i+2]]), 'string_agg', '')"


_RC = "reverse(translate({}, 'ACGT', 'TGCA'))"
_CUT = f"translate(md5(c_name), '{HEX}', '{BASES}')[3:14]"
_PLACED = f"""p AS (SELECT c_mktsegment AS genome_id, c_custkey AS id, c_custkey % 8 <> 0 AS there, {_CUT} AS plus, {_RC.format(_CUT)} AS minus FROM customer),
q AS (SELECT *, {_sql_translate('plus')} AS tp, {_sql_translate('minus')} AS tm, CASE id % 3 WHEN 0 THEN {_sql_translate('plus')} WHEN 1 THEN {_sql_translate('minus')} ELSE 'MKV' END AS pr FROM p),
v AS (SELECT *, length(rtrim(tp, '*')) = length(rtrim(pr, '*')) AND rtrim(tp, '*')[2:] = rtrim(pr, '*')[2:] AS a, length(rtrim(tm, '*')) = length(rtrim(pr, '*')) AND rtrim(tm, '*')[2:] = rtrim(pr, '*')[2:] AS b FROM q)"""


def synthetic(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    f = p.select(F.col("p_brand").alias("genome_id"), F.col("p_partkey").cast("string").alias("id"), F.col("p_partkey").alias("at"), F.split("p_type", " ").alias("functions"))
    return genomes.synthetic(f).select("function", "genome_id", "id", F.round("probability", 6).alias("probability"))


def validation(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    g = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("genome_id"), F.when(F.col("n_nationkey") % 4 == 0, "").otherwise(F.col("n_name")).alias("scientific_name"), F.lit("Bacteria").alias("domain"), (F.col("n_nationkey") / 20).alias("gc_content"))
    loc = F.array(F.struct((F.col("c_custkey") % 30).cast("string").alias("contig"), (F.col("c_custkey") % 50).alias("start"), F.when(F.col("c_custkey") % 41 == 0, "?").otherwise("+").alias("strand"), F.lit(9).alias("length")))
    f = c.select(F.col("c_nationkey").alias("genome_id"), (F.col("c_custkey") % 997).cast("string").alias("id"), loc.alias("location"))
    k = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("genome_id"), F.explode(F.sequence(F.lit(0), F.lit(27)).cast("array<string>")).alias("contig_id"))
    return genomes.validated(g, f, k).groupBy("genome_id", "message").agg(F.count("*").alias("n"))


_VALID = """f AS (SELECT c_nationkey AS genome_id, CAST(c_custkey % 997 AS VARCHAR) AS id, c_custkey % 30 AS contig, c_custkey % 50 AS start, c_custkey % 41 = 0 AS odd FROM customer),
m AS (SELECT n_nationkey AS genome_id, 'missing scientific_name' AS message FROM nation WHERE n_nationkey % 4 = 0 UNION ALL SELECT n_nationkey, 'gc_content out of range' FROM nation WHERE n_nationkey > 20
UNION ALL SELECT genome_id, 'repeated feature ' || id FROM f GROUP BY genome_id, id HAVING count(*) > 1 UNION ALL SELECT genome_id, 'bad location of ' || id FROM f WHERE start < 1 OR odd UNION ALL SELECT genome_id, 'unknown contig of ' || id FROM f WHERE contig > 27)"""


def digest(spark, sf_dir):
    return genomes.genome_digest(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("genome_id"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0").alias("contig_id"), dna("s_name").alias("sequence"))).select("genome_id", "md5", F.round("gc", 6).alias("gc"))


def placed_ids(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.concat("c_name", F.lit("[e0]"))).when(F.col("c_custkey") % 3 == 1, F.concat("c_name", F.lit("_p1"))).otherwise(F.upper("c_mktsegment")).alias("x"))
    return c.select("c_custkey", names.place(F.col("x")).alias("p")).select("c_custkey", "p.base", "p.compartment", "p.index")


QUERIES = {
    "seq_revcomp": lambda s, d: table(s, d, "documents").select("doc_id", sequences.reverse_complement(spelt("text")).alias("rc")),
    "seq_translate": lambda s, d: table(s, d, "documents").select("doc_id", sequences.translate(F.concat(spelt("text"), F.lit("N"))).alias("protein")),
    "seq_gc": lambda s, d: table(s, d, "documents").select("doc_id", F.round(sequences.gc_fraction(spelt("text")), 6).alias("gc")),
    "contig_stats": lambda s, d: genomes.contig_stats(contigs(s, d)).select("contig_id", "length", F.round("gc", 6).alias("gc"), "md5"),
    "assembly_stats": lambda s, d: genomes.assembly_stats(contigs(s, d)).select("genome_id", "n_contigs", "size", "n_a", "n_c", "n_g", "n_t", "n_n", "md5", F.round("gc", 6).alias("gc")),
    "genome_digest": digest,
    "feature_placement": lambda s, d: features(s, d).select("id", "taxonomy", "cds.sequence", F.col("cds.strand").alias("placed_strand"), "cds.verified"),
    "placement_counts": lambda s, d: genomes.placement_counts(features(s, d)),
    "feature_counts": lambda s, d: genomes.feature_counts(table(s, d, "events").select(F.col("user_id").alias("genome_id"), F.col("event_type").alias("type"))),
    "synthetic_genome": synthetic,
    "genome_validation": validation,
    "fasta_wrap": lambda s, d: sinks.fasta_lines(table(s, d, "supplier").select(F.col("s_name").alias("id"), F.concat(dna("s_name"), dna(F.col("s_suppkey").cast("string")), F.repeat(F.lit("ACGT"), 12)).alias("sequence"))),
    "id_parse": placed_ids,
    "alphabet_guard": lambda s, d: table(s, d, "documents").select("doc_id", sequences.off_alphabet(F.concat(spelt("text"), F.repeat(F.lit("X"), (F.col("doc_id") % 9).cast("int"))), "ACGT").alias("off")),
    "accession_extract": lambda s, d: table(s, d, "part").select("p_partkey", sequences.accession(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("x GCF_"), F.lpad(F.col("p_partkey").cast("string"), 9, "0"), F.lit(".1 y"))).otherwise(F.col("p_name"))).alias("accession")),
    "fold_colours": lambda s, d: table(s, d, "supplier").select("s_suppkey", chemistry.fold_colour(F.when(F.col("s_suppkey") % 2 == 0, F.lit(4.0)).when(F.col("s_suppkey") % 3 == 0, F.lit(0.1)).otherwise(1.0)).alias("colour")),
}

ORACLES = {
    "seq_revcomp": f"SELECT doc_id, {_RC.format(f'''{_SPELT}''')} AS rc FROM documents",
    "seq_translate": f"WITH t AS (SELECT doc_id, {_SPELT} || 'N' AS s FROM documents) SELECT doc_id, list_aggregate(list_transform(range(1, length(s) - 1, 3), lambda i: coalesce({_CODONS}[s[i:i+2]], 'X')), 'string_agg', '') AS protein FROM t",
    "seq_gc": f"WITH t AS (SELECT doc_id, {_SPELT} AS s FROM documents) SELECT doc_id, round(length(regexp_replace(s, '[AT]', '', 'g')) / greatest(length(s), 1)::DOUBLE, 6) AS gc FROM t",
    "contig_stats": f"WITH {_CONTIGS} SELECT contig_id, CAST(length(sequence) AS INTEGER) AS length, round(length(regexp_replace(sequence, '[^GC]', '', 'g')) / CAST(length(sequence) AS DOUBLE), 6) AS gc, md5(sequence) AS md5 FROM ct",
    "assembly_stats": f"WITH {_CONTIGS} SELECT genome_id, count(*) AS n_contigs, CAST(sum(length(sequence)) AS BIGINT) AS size, "
    + ", ".join(f"CAST(sum(length(regexp_replace(sequence, '[^{b}]', '', 'g'))) AS BIGINT) AS n_{b.lower()}" for b in "ACGTN")
    + ", md5(string_agg(md5(sequence), ',' ORDER BY md5(sequence))) AS md5, round(sum(length(regexp_replace(sequence, '[^GC]', '', 'g'))) / CAST(sum(length(sequence)) AS DOUBLE), 6) AS gc FROM ct GROUP BY 1",
    "genome_digest": f"WITH t AS (SELECT s_nationkey AS genome_id, string_agg(translate(md5(s_name), '{HEX}', '{BASES}'), '' ORDER BY s_suppkey) AS w FROM supplier GROUP BY 1) SELECT genome_id, md5(w) AS md5, round(length(regexp_replace(w, '[AT]', '', 'g')) / CAST(length(w) AS DOUBLE), 6) AS gc FROM t",
    "feature_placement": f"WITH {_PLACED} SELECT id, lower(genome_id) AS taxonomy, CASE WHEN there THEN CASE WHEN b AND NOT a THEN minus ELSE plus END END AS sequence, CASE WHEN there THEN CASE WHEN b AND NOT a THEN '-' ELSE '+' END END AS placed_strand, CASE WHEN there THEN a OR b END AS verified FROM v",
    "placement_counts": f"WITH {_PLACED} SELECT genome_id, count(*) AS n_features, count(*) FILTER (NOT there) AS n_no_contig, count(*) FILTER (there AND (a OR b)) AS n_verified, count(*) FILTER (there AND b AND NOT a) AS n_flipped, count(*) FILTER (there AND NOT (a OR b)) AS n_trusted, count(*) FILTER (pr = '') AS n_no_protein FROM v GROUP BY 1",
    "feature_counts": "SELECT user_id AS genome_id, event_type AS type, count(*) AS n FROM events GROUP BY 1, 2",
    "synthetic_genome": "WITH e AS (SELECT p_brand AS g, p_partkey AS pos, unnest(string_split(p_type, ' ')) AS function FROM part) SELECT function, arg_min(g, pos) AS genome_id, CAST(min(pos) AS VARCHAR) AS id, round(count(DISTINCT g) / (SELECT CAST(count(DISTINCT p_brand) AS DOUBLE) FROM part), 6) AS probability FROM e GROUP BY 1",
    "genome_validation": f"WITH {_VALID} SELECT genome_id, message, count(*) AS n FROM m GROUP BY 1, 2",
    "fasta_wrap": f"WITH t AS (SELECT s_name, translate(md5(s_name), '{HEX}', '{BASES}') || translate(md5(CAST(s_suppkey AS VARCHAR)), '{HEX}', '{BASES}') || repeat('ACGT', 12) AS s FROM supplier) SELECT '>' || s_name || chr(10) || s[1:80] || chr(10) || s[81:] AS value FROM t",
    "id_parse": "SELECT c_custkey, CASE WHEN c_custkey % 3 < 2 THEN c_name ELSE upper(c_mktsegment) END AS base, CASE c_custkey % 3 WHEN 0 THEN 'e' WHEN 1 THEN 'p' ELSE 'c' END AS compartment, CASE c_custkey % 3 WHEN 1 THEN '1' ELSE '0' END AS index FROM customer",
    "alphabet_guard": f"SELECT doc_id, doc_id % 9 > 0.1 * (length({_SPELT}) + doc_id % 9) AS off FROM documents",
    "accession_extract": "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'GCF_' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') || '.1' END AS accession FROM part",
    "fold_colours": "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN '#FF0000' WHEN s_suppkey % 3 = 0 THEN '#0000FF' ELSE '#FFFFFF' END AS colour FROM supplier",
}
