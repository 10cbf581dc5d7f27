"""Nested JSON records: protein entries, structure entries, job payloads, object metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_XREF = "array<struct<database:string,id:string,properties:array<struct<key:string,value:string>>>>"
PROTEIN = (
    "references array<struct<citation:struct<title:string,journal:string,publicationDate:string,citationCrossReferences:array<struct<database:string,id:string>>>>>, "
    "comments array<struct<commentType:string,reaction:struct<reactionCrossReference:struct<id:string>>>>, "
    f"uniProtKBCrossReferences {_XREF}"
)
STRUCTURE = (
    "rcsb_id string, rcsb_primary_citation struct<pdbx_database_id_PubMed:string,title:string,journal_abbrev:string,year:string,rcsb_authors:array<string>>, exptl array<struct<method:string>>, "
    "polymer_entities array<struct<rcsb_id:string,entity_poly:struct<pdbx_strand_id:string>,rcsb_entity_source_organism:array<struct<ncbi_taxonomy_id:string,ncbi_scientific_name:string>>,"
    "rcsb_polymer_entity_container_identifiers:struct<reference_sequence_identifiers:array<struct<database_accession:string>>>,rcsb_polymer_entity:struct<rcsb_ec_lineage:array<struct<id:string>>>,"
    "uniprots:array<struct<rcsb_uniprot_protein:struct<name:struct<value:string>,ec:array<string>>>>>>, "
    "nonpolymer_entities array<struct<nonpolymer_comp:struct<rcsb_chem_comp_synonyms:array<struct<provenance_source:string,name:string>>,rcsb_chem_comp_descriptor:struct<InChI:string,InChIKey:string,SMILES:string>>>>"
)


def _first(array: Column, keep) -> Column:
    return F.try_element_at(F.filter(array, keep), F.lit(1))


def _listed(array: Column, kind: str) -> Column:
    return F.coalesce(array, F.array().cast(kind))


def proteins(df: DataFrame, raw: str = "raw") -> DataFrame:
    """df with its protein entries parsed as `entry`."""
    return df.withColumn("entry", F.from_json(raw, PROTEIN))


def publications(entries: DataFrame) -> DataFrame:
    """(id, title, journal, year, pubmed_id, doi) of each entry's references; of several ids of one kind the last counts."""
    c = F.col("c")
    xref = lambda db: F.element_at(F.filter(_listed(c["citationCrossReferences"], "array<struct<database:string,id:string>>"), lambda x: x["database"] == db), -1)["id"]
    some = lambda db: F.when(F.exists(_listed(c["citationCrossReferences"], "array<struct<database:string,id:string>>"), lambda x: x["database"] == db), xref(db))
    each = entries.select("id", F.explode("entry.references").alias("r")).select("id", F.col("r.citation").alias("c"))
    text = lambda name: F.coalesce(c[name], F.lit(""))
    return each.select("id", text("title").alias("title"), text("journal").alias("journal"), text("publicationDate").alias("year"), some("PubMed").alias("pubmed_id"), some("DOI").alias("doi"))


def rhea_ids(entries: DataFrame) -> DataFrame:
    """Distinct catalysed reactions of each entry, in order."""
    found = F.transform(F.filter("entry.comments", lambda x: x["commentType"] == "CATALYTIC ACTIVITY"), lambda x: x["reaction"]["reactionCrossReference"]["id"])
    return entries.select("id", F.array_distinct(F.filter(found, lambda x: x.isNotNull() & (x != ""))).alias("rhea_ids"))


def structure_refs(entries: DataFrame) -> DataFrame:
    """(id, pdb_id, properties) of each entry's structures."""
    found = F.filter("entry.uniProtKBCrossReferences", lambda x: x["database"] == "PDB")
    pairs = F.filter(_listed(F.col("x.properties"), "array<struct<key:string,value:string>>"), lambda p: (F.coalesce(p["key"], F.lit("")) != "") & (F.coalesce(p["value"], F.lit("")) != ""))
    return entries.select("id", F.explode(found).alias("x")).select("id", F.col("x.id").alias("pdb_id"), F.map_from_entries(pairs).alias("properties"))


def structures(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Structure entries flattened: (entry_id, reference, methods, polymers, ligands)."""
    e = F.from_json(raw, STRUCTURE)
    c = F.col("e.rcsb_primary_citation")
    reference = F.when(c.isNotNull(), F.array(c["pdbx_database_id_PubMed"], F.coalesce(c["title"], F.lit("")), F.coalesce(c["journal_abbrev"], F.lit("NA")), F.coalesce(F.try_element_at(c["rcsb_authors"], F.lit(1)), F.lit("")), F.coalesce(c["year"], F.lit("NA"))))
    methods = F.filter(F.transform("e.exptl", lambda x: x["method"]), lambda m: m.isNotNull() & (m != ""))
    return df.select(e.alias("e")).select(F.col("e.rcsb_id").alias("entry_id"), reference.alias("reference"), methods.alias("methods"), F.col("e.polymer_entities").alias("polymers"), F.col("e.nonpolymer_entities").alias("ligands"))


def polymers(parsed: DataFrame) -> DataFrame:
    """(entry_id, protein_id, strands, taxonomy, accessions, ecs, names, protein_ecs), one row per polymer."""
    p = F.col("p")
    proteins_ = F.filter(F.transform(p["uniprots"], lambda u: u["rcsb_uniprot_protein"]), lambda u: u.isNotNull())
    some = lambda array: F.filter(array, lambda x: x.isNotNull() & (x != ""))
    none = F.array().cast("array<string>")
    return parsed.select("entry_id", F.explode("polymers").alias("p")).select(
        "entry_id",
        p["rcsb_id"].alias("protein_id"),
        F.split(p["entity_poly"]["pdbx_strand_id"], ",").alias("strands"),
        F.coalesce(F.transform(p["rcsb_entity_source_organism"], lambda o: o["ncbi_scientific_name"]), none).alias("taxonomy"),
        F.coalesce(F.transform(p["rcsb_polymer_entity_container_identifiers"]["reference_sequence_identifiers"], lambda r: r["database_accession"]), none).alias("accessions"),
        F.coalesce(F.array_distinct(some(F.transform(p["rcsb_polymer_entity"]["rcsb_ec_lineage"], lambda x: x["id"]))), none).alias("ecs"),
        F.coalesce(some(F.transform(proteins_, lambda u: u["name"]["value"])), none).alias("names"),
        F.coalesce(F.flatten(F.filter(F.transform(proteins_, lambda u: u["ec"]), lambda x: x.isNotNull())), none).alias("protein_ecs"),
    )


def ligands(parsed: DataFrame) -> DataFrame:
    """(entry_id, name, inchi, inchikey, smiles), the name from the reference synonyms."""
    d = F.col("l.nonpolymer_comp.rcsb_chem_comp_descriptor")
    name = _first(F.col("l.nonpolymer_comp.rcsb_chem_comp_synonyms"), lambda x: x["provenance_source"] == "PDB Reference Data")["name"]
    return parsed.select("entry_id", F.explode("ligands").alias("l")).where("l.nonpolymer_comp is not null").select("entry_id", F.coalesce(name, F.lit("")).alias("name"), d["InChI"].alias("inchi"), d["InChIKey"].alias("inchikey"), d["SMILES"].alias("smiles"))


def ec_sources(polymer_table: DataFrame) -> DataFrame:
    """(protein_id, ec, source): complete EC numbers of structures and of their proteins, and which of the two say so."""
    own = polymer_table.select("protein_id", F.explode("ecs").alias("ec"), F.lit("RCSB").alias("source")).where(F.size(F.split("ec", "[.]")) == 4)
    theirs = polymer_table.select("protein_id", F.explode("protein_ecs").alias("ec"), F.lit("UniProt").alias("source"))
    return own.union(theirs).distinct().groupBy("protein_id", "ec").agg(F.array_join(F.array_sort(F.collect_list("source")), ";").alias("source"))


def job_states(df: DataFrame, raw: str = "raw") -> DataFrame:
    """(job_id, status) of payloads that are a list of jobs, or an object by job id."""
    job = "struct<job_id:string,status:string>"
    listed = F.from_json(raw, f"array<{job}>")
    keyed = F.transform(F.map_entries(F.from_json(raw, f"map<string,{job}>")), lambda e: F.struct(F.coalesce(e["value"]["job_id"], e["key"]).alias("job_id"), e["value"]["status"].alias("status")))
    return df.select(F.explode(F.when(F.trim(raw).startswith("["), listed).otherwise(keyed)).alias("j")).select("j.*")


def references(raw: Column) -> Column:
    """Object references (three numbers) among the values of a JSON text of any depth, each once, first seen first."""
    return F.array_distinct(F.regexp_extract_all(raw, F.lit(r'"([0-9]+/[0-9]+/[0-9]+)"(?!\s*:)'), 1))


def bounded_list(names: Column, budget: int = 843) -> Column:
    """A JSON list of names within a budget of bytes; what doesn't fit is counted in a last "+N more"."""
    quoted = lambda xs: F.concat(F.lit("["), F.array_join(F.transform(xs, lambda x: F.concat(F.lit('"'), F.regexp_replace(x, r'(["\\])', r"\\$1"), F.lit('"'))), ", "), F.lit("]"))
    more = lambda n: F.concat(F.lit("+"), n.cast("string"), F.lit(" more"))
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(-1).alias("left"), F.lit(0).alias("seen"))

    def step(acc, name):
        left = F.size(names) - acc["seen"]
        full = F.octet_length(quoted(F.concat(acc["kept"], F.array(name, more(left))))) > budget
        stop = (acc["left"] >= 0) | full
        return F.struct(
            F.when(stop, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(name))).alias("kept"), F.when(acc["left"] >= 0, acc["left"]).when(full, left).otherwise(F.lit(-1)).alias("left"), (acc["seen"] + 1).alias("seen")
        )

    return F.aggregate(names, start, step, lambda acc: quoted(F.when(acc["left"] >= 0, F.concat(acc["kept"], F.array(more(acc["left"])))).otherwise(acc["kept"])))


def narrative_meta(cells: DataFrame, used: DataFrame) -> DataFrame:
    """Per narrative: cells, text cells, distinct objects used, and a bounded list of these."""
    counted = cells.groupBy("narrative_id").agg(F.count("*").alias("cell_count"), F.count_if(F.col("cell_type") == "markdown").alias("markdown_count"))
    deps = used.groupBy("narrative_id").agg(F.array_sort(F.collect_set("ref")).alias("refs"))
    joined = counted.join(deps, "narrative_id", "left").withColumn("refs", F.coalesce("refs", F.array().cast("array<string>")))
    return joined.select("narrative_id", "cell_count", "markdown_count", F.size("refs").alias("data_object_count"), bounded_list(F.col("refs")).alias("data_dependencies"))
