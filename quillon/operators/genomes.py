"""Genomes, contigs and features: statistics, validation, aliases and synthetic genomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import sequences


def contig_stats(contigs: DataFrame) -> DataFrame:
    """Per contig: length, GC of its length, md5."""
    s = F.col("sequence")
    return contigs.select("genome_id", "contig_id", F.length(s).alias("length"), sequences.gc_of_length(s).alias("gc"), F.md5(F.upper(s)).alias("md5"))


def assembly_stats(contigs: DataFrame) -> DataFrame:
    """Per genome: contigs, size, base counts, GC of the length, and the md5 of the sorted contig md5s joined by commas."""
    s = F.col("sequence")
    counts = [F.sum(sequences.base_count(s, b)).alias(f"n_{b.lower()}") for b in "ACGTN"]
    out = contigs.groupBy("genome_id").agg(F.count("*").alias("n_contigs"), F.sum(F.length(s)).alias("size"), *counts, F.md5(F.array_join(F.array_sort(F.collect_list(F.md5(F.upper(s)))), ",")).alias("md5"))
    return out.withColumn("gc", F.when(F.col("size") > 0, (F.col("n_g") + F.col("n_c")) / F.nullif(F.col("size"), F.lit(0))).otherwise(0.0))


def genome_digest(contigs: DataFrame, upper: bool = True) -> DataFrame:
    """Per genome: md5 and GC (of A, C, G, T) of its contigs, joined in order of their ids."""
    s = F.upper("sequence") if upper else F.col("sequence")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("contig_id", s.alias("s")))), lambda x: x["s"]), "")
    return contigs.groupBy("genome_id").agg(whole.alias("whole")).select("genome_id", F.md5("whole").alias("md5"), sequences.gc_fraction(F.col("whole")).alias("gc"))


def protein_digest(features: DataFrame) -> DataFrame:
    """Per genome the md5 of its sorted protein md5s, joined by semicolons."""
    own = features.where(F.length("protein_translation") > 0)
    return own.groupBy("genome_id").agg(F.md5(F.array_join(F.array_sort(F.collect_list(F.md5("protein_translation"))), ";")).alias("md5"))


def feature_counts(features: DataFrame) -> DataFrame:
    return features.groupBy("genome_id", "type").agg(F.count("*").alias("n"))


def all_features(genes: DataFrame, cdss: DataFrame, mrnas: DataFrame, others: DataFrame) -> DataFrame:
    """The four feature tables as one, with their kind."""
    out = None
    for kind, df in (("gene", genes), ("cds", cdss), ("mrna", mrnas), ("noncoding", others)):
        one = df.withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def proteins(features: DataFrame) -> DataFrame:
    return features.where(F.length("protein_translation") > 0).select("id", "protein_translation")


def normalised(features: DataFrame) -> DataFrame:
    """Features with a kind: those without a protein are noncoding; of one id the last kind of gene, cds, noncoding stays."""
    kind = F.when(F.coalesce(F.length("protein_translation"), F.lit(0)) == 0, "noncoding").when(F.col("type") == "CDS", "cds").otherwise("gene")
    order = F.element_at(F.create_map(F.lit("gene"), F.lit(0), F.lit("cds"), F.lit(1), F.lit("noncoding"), F.lit(2)), kind)
    rank = F.row_number().over(Window.partitionBy("id").orderBy(order.desc()))
    return features.withColumn("kind", kind).withColumn("_n", rank).where("_n = 1").drop("_n")


def aliases(features: DataFrame) -> DataFrame:
    """(alias, id): every alias of a feature, md5s among them."""
    named = F.transform("aliases", lambda a: a["value"])
    extra = F.filter(F.array("md5", "protein_md5"), lambda x: x.isNotNull())
    return features.select(F.explode(F.array_distinct(F.concat(named, extra))).alias("alias"), "id")


def alias_index(features: DataFrame) -> DataFrame:
    """Per alias its features, sorted."""
    return aliases(features).groupBy("alias").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def coding_clones(features: DataFrame) -> DataFrame:
    """CDS features of genes with a protein."""
    return features.where(F.length("protein_translation") > 0).withColumn("id", F.concat("id", F.lit("_CDS_1"))).withColumn("type", F.lit("CDS"))


def validated(genomes: DataFrame, features: DataFrame, contigs: DataFrame) -> DataFrame:
    """(genome_id, message) of what is wrong: missing fields, ranges, repeated ids, bad locations, unknown contigs."""
    say = lambda df, text: df.select("genome_id", text.alias("message"))
    out = []
    for field in ("scientific_name", "domain"):
        out.append(say(genomes.where(F.coalesce(F.trim(field), F.lit("")) == ""), F.lit(f"missing {field}")))
    out.append(say(genomes.where(~F.coalesce(F.col("gc_content").between(0, 1), F.lit(False))), F.lit("gc_content out of range")))
    repeated = features.groupBy("genome_id", "id").count().where("count > 1")
    out.append(say(repeated, F.concat(F.lit("repeated feature "), F.col("id"))))
    places = features.select("genome_id", "id", F.explode("location").alias("l"))
    out.append(say(places.where("l.start < 1 or l.length < 1 or l.strand not in ('+', '-')"), F.concat(F.lit("bad location of "), F.col("id"))))
    known = contigs.select("genome_id", F.col("contig_id").alias("contig"))
    unknown = places.select("genome_id", "id", F.col("l.contig").alias("contig")).join(known, ["genome_id", "contig"], "left_anti")
    out.append(say(unknown, F.concat(F.lit("unknown contig of "), F.col("id"))))
    all_ = out[0]
    for one in out[1:]:
        all_ = all_.unionByName(one)
    return all_


def placed_features(features: DataFrame, contigs: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Features with their coding sequence, verified strand and taxonomy; features of unknown contigs have null sequences."""
    joined = features.join(contigs.select("genome_id", "contig_id", F.col("sequence").alias("contig")), ["genome_id", "contig_id"], "left").join(taxonomy, "genome_id", "left")
    cds = sequences.coding_sequence(F.col("contig"), F.col("start"), F.col("end"), F.col("strand"), F.col("sequence"))
    return joined.withColumn("cds", F.when(F.col("contig").isNotNull(), cds)).drop("contig")


def placement_counts(placed: DataFrame) -> DataFrame:
    """Per genome: features, those without a contig, verified, flipped, of trusted strand, without a protein."""
    there, ok = F.col("cds").isNotNull(), F.coalesce(F.col("cds.verified"), F.lit(False))
    return placed.groupBy("genome_id").agg(
        F.count("*").alias("n_features"), F.count_if(~there).alias("n_no_contig"), F.count_if(ok).alias("n_verified"), F.count_if(ok & (F.col("cds.strand") != F.col("strand"))).alias("n_flipped"),
        F.count_if(there & ~ok).alias("n_trusted"), F.count_if(F.coalesce(F.length("sequence"), F.lit(0)) == 0).alias("n_no_protein"),
    )


def synthetic(features: DataFrame, order: str = "at") -> DataFrame:
    """One feature per distinct function: the first that has it, and the share of genomes that do."""
    from quillon.operators.ranking import best

    each = features.select("genome_id", "id", order, F.explode("functions").alias("function"))
    total = features.select(F.countDistinct("genome_id").alias("n_genomes"))
    share = each.groupBy("function").agg(F.countDistinct("genome_id").alias("n"))
    first = best(each, ["function"], [F.asc(order), F.asc("genome_id"), F.asc("id")])
    return first.join(share, "function").join(F.broadcast(total)).select("function", "genome_id", "id", (F.col("n") / F.col("n_genomes")).alias("probability"))  # total is one row


def sequences_of(features: DataFrame, by_md5: DataFrame) -> DataFrame:
    """Features with the DNA and protein of their md5s: by_md5(md5, kind, sequence) of kinds NA and AA."""
    wide = by_md5.groupBy("md5").agg(F.max(F.when(F.col("kind") == "NA", F.col("sequence"))).alias("dna"), F.max(F.when(F.col("kind") == "AA", F.col("sequence"))).alias("protein"))
    return features.join(wide.select(F.col("md5").alias("na_md5"), "dna"), "na_md5", "left").join(wide.select(F.col("md5").alias("aa_md5"), "protein"), "aa_md5", "left")


def events(terms: DataFrame) -> DataFrame:
    """One row per ontology with its genes and their terms: terms(gene, ontology, term)."""
    genes = terms.groupBy("ontology", "gene").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    return genes.groupBy("ontology").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("gene", "terms")))).alias("genes"))


def merged_events(old: DataFrame, new: DataFrame, overwrite: bool = True) -> DataFrame:
    """Events of both by event_id; new ones win if overwrite, else old ones."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rank = F.row_number().over(Window.partitionBy("event_id").orderBy(F.desc("_new") if overwrite else F.asc("_new")))
    return both.withColumn("_n", rank).where("_n = 1").drop("_n", "_new")


def alias_hash(rows: DataFrame, last_wins: bool = False) -> DataFrame:
    """(namespace, alias, ids) of rows(namespace, alias, id, at): all ids in order, or the last one only."""
    if last_wins:
        return rows.groupBy("namespace", "alias").agg(F.array(F.max_by("id", "at")).alias("ids"))
    return rows.groupBy("namespace", "alias").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("at", "id"))), lambda x: x["id"])).alias("ids"))


def upgraded_aliases(features: DataFrame) -> DataFrame:
    """Aliases "source:value" as (source, value), plain ones of source Unknown; functions as a list."""
    pair = lambda a: F.when(a.contains(":"), F.struct(F.substring_index(a, ":", 1).alias("source"), F.regexp_replace(a, "^[^:]*:", "").alias("value"))).otherwise(F.struct(F.lit("Unknown").alias("source"), a.alias("value")))
    return features.withColumn("aliases", F.transform("aliases", pair)).withColumn("functions", F.split("function", r"\s*;\s+|\s+[@/]\s+"))


def annotation_table(features: DataFrame, terms: DataFrame, ontologies: list[str]) -> DataFrame:
    """Features with one column of terms per ontology, empty where there are none, and an end one past their last base."""
    wide = terms.groupBy(F.col("gene").alias("id")).pivot("ontology", ontologies).agg(F.array_join(F.array_sort(F.collect_set("term")), ";"))
    renamed = wide.select("id", *[F.col(f"`{o}`").alias(f"Annotation:{o}") for o in ontologies])
    joined = features.withColumn("end", F.col("start") + F.col("length")).join(renamed, "id", "left")
    return joined.withColumns({f"Annotation:{o}": F.coalesce(F.col(f"`Annotation:{o}`"), F.lit("")) for o in ontologies})
