"""Readers of vector, sequence, annotation, cluster, distance and medium files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import names


def vectors(spark: SparkSession, path: str, vector_id: str | None = None) -> DataFrame:
    out = spark.read.parquet(path)
    return out.where(F.col("vector_id") == vector_id) if vector_id is not None else out


def csv_vectors(spark: SparkSession, path: str, vector_id: str, columns: list[str] | None = None) -> DataFrame:
    """A csv file's numbers in long form; the first column names the entity."""
    from quillon.operators.vectors import from_wide

    df = spark.read.csv(path, header=True)
    return from_wide(df, vector_id, df.columns[0], columns)


def excel_vectors(spark: SparkSession, path: str, vector_id: str, sheet: int | str = 0, columns: list[str] | None = None) -> DataFrame:
    """As csv_vectors, of a sheet; sheets are small by format and are read on the driver."""
    import pandas as pd

    from quillon.operators.vectors import from_wide

    df = spark.createDataFrame(pd.read_excel(path, sheet_name=sheet))
    return from_wide(df, vector_id, df.columns[0], columns)


def matrix(spark: SparkSession, path: str) -> DataFrame:
    """An expression matrix by its file's ending: xls, xlsx, json, tsv."""
    ending = path.rsplit(".", 1)[-1].lower()
    if ending in ("xls", "xlsx"):
        import pandas as pd

        return spark.createDataFrame(pd.read_excel(path))
    if ending == "json":
        return spark.read.json(path, multiLine=True)
    if ending == "tsv":
        return spark.read.csv(path, sep="\t", header=True, inferSchema=True)
    raise ValueError(f"no reader for {path}")


def reaction_mapping(spark: SparkSession, path: str, view: str = "reaction_mapping") -> DataFrame:
    """A function-to-reaction table with its lookup key, also as a view; reading again replaces it."""
    df = spark.read.parquet(path).withColumn("key", names.role_key(F.col("function_description")))
    df.createOrReplaceTempView(view)
    return df


def filter_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, schema="id string, reason string")


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(id, sequence): the first word of a header names a record; of records of one name the last stays."""
    text = spark.read.text(path, lineSep="\n>").select(F.regexp_replace("value", "^>", "").alias("value"), F.monotonically_increasing_id().alias("at")).where(F.trim("value") != "")
    cut = F.split("value", "\r?\n", 2)
    parsed = text.select("at", F.regexp_extract(cut[0], r"^(\S+)", 1).alias("id"), F.regexp_replace(F.coalesce(F.try_element_at(cut, F.lit(2)), F.lit("")), r"\s", "").alias("sequence"))
    named = parsed.withColumn("id", F.when(F.col("id") != "", F.col("id")).otherwise(F.raise_error(F.lit("a sequence has no id"))))
    return named.groupBy("id").agg(F.max_by("sequence", "at").alias("sequence"))


#: The feature types that are read.
GFF_TYPES = ("gene", "CDS", "mRNA", "rRNA", "tRNA", "ncRNA")


def _gff_lines(spark: SparkSession, path: str, columns: int) -> DataFrame:
    parts = F.split("value", "\t")
    lines = spark.read.text(path).withColumn("at", F.monotonically_increasing_id()).where("trim(value) <> '' and not startswith(value, '#')").withColumn("p", parts).where(F.size("p") >= columns)
    pairs = F.filter(F.split(F.coalesce(F.try_element_at("p", F.lit(9)), F.lit("")), ";"), lambda x: x.contains("="))
    keys = F.transform(pairs, lambda x: F.trim(F.substring_index(x, "=", 1)))
    unique = F.filter(F.transform(pairs, lambda x, i: F.when(F.array_position(keys, F.trim(F.substring_index(x, "=", 1))) == i + 1, x)), lambda x: x.isNotNull())
    attributes = F.map_from_entries(F.transform(unique, lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)), F.trim(F.regexp_replace(x, "^[^=]*=", "")))))
    p = lambda i: F.col("p")[i]
    return lines.select("at", p(0).alias("contig"), p(2).alias("type"), p(3).try_cast("long").alias("start"), p(4).try_cast("long").alias("end"), p(6).alias("strand"), attributes.alias("attributes"))


def gff(spark: SparkSession, path: str, contigs: DataFrame) -> DataFrame:
    """Features on known contigs: id, type, place and parent.

    The id is ID, else locus_tag, else Name, else a running number per type; repeats get _2, _3, ...; a parent counts
    only if it is a gene of an earlier line."""
    from quillon.operators.ranking import running

    a = lambda k: F.nullif(F.try_element_at("attributes", F.lit(k)), F.lit(""))
    lines = _gff_lines(spark, path, 8).where(F.col("type").isin(*GFF_TYPES)).join(contigs.select(F.col("id").alias("contig")).distinct(), "contig", "left_semi")
    named = running(lines, ["type"], "at", "_n").withColumn("raw", F.coalesce(a("ID"), a("locus_tag"), a("Name"), F.concat_ws("_", "type", F.col("_n").cast("string")))).drop("_n")
    n = F.col("_n")
    unique = running(named, ["raw"], "at", "_n").withColumn("id", F.when(n > 1, F.concat_ws("_", "raw", n.cast("string"))).otherwise(F.col("raw"))).drop("_n").withColumn("wanted", a("Parent"))
    genes = unique.where("type = 'gene'").select(F.col("raw").alias("wanted"), F.col("at").alias("gene_at"), F.col("id").alias("gene"))
    earlier = unique.select("at", "wanted").join(genes, "wanted").where("gene_at < at").groupBy("at").agg(F.max_by("gene", "gene_at").alias("parent"))
    return unique.join(earlier, "at", "left").select("id", "type", "contig", "start", "end", "strand", "parent", "attributes", "at")


def gff_loci(spark: SparkSession, path: str) -> DataFrame:
    """(locus_tag, contig, start, strand) of CDS lines; of lines of one tag the last stays."""
    lines = _gff_lines(spark, path, 9).where("type = 'CDS'").withColumn("locus_tag", F.try_element_at("attributes", F.lit("locus_tag"))).where("locus_tag is not null")
    return lines.groupBy("locus_tag").agg(F.max_by(F.struct("contig", "start", "strand"), "at").alias("x")).select("locus_tag", "x.*")


PROKKA = ("locus_tag", "ftype", "length_bp", "gene", "EC_number", "COG", "product")


def prokka(spark: SparkSession, path: str) -> DataFrame:
    """A feature table; short rows are padded, a bad length is 0."""
    p = F.split("value", "\t")
    lines = spark.read.text(path).withColumn("at", F.monotonically_increasing_id()).where("trim(value) <> '' and not startswith(value, 'locus_tag\t')")
    cells = [F.coalesce(F.try_element_at(p, F.lit(i + 1)), F.lit("")).alias(c) for i, c in enumerate(PROKKA)]
    return lines.select("at", *cells).withColumn("length_bp", F.coalesce(F.col("length_bp").try_cast("int"), F.lit(0)))


def longest_cds(table: DataFrame, loci: DataFrame) -> DataFrame:
    """Per contig its longest CDS, the one of smaller start among equals, with terms."""
    from quillon.operators.ranking import best

    joined = table.where("ftype = 'CDS'").join(loci, "locus_tag")
    kept = best(joined, ["contig"], [F.desc("length_bp"), F.asc("start"), F.asc("locus_tag")])
    return kept.withColumn("ecs", names.parts_of(F.col("EC_number"))).withColumn("cogs", names.parts_of(F.col("COG")))


def dram(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """(gene_id, namespace, id, description) from a table whose header says which databases it has: *_id, *_EC, *_description.

    Only the header is looked at first; rows of unknown queries are dropped if `known(gene_id)` is given."""
    df = spark.read.csv(path, sep="\t", header=True)
    found = [c for c in df.columns if (c.endswith("_id") or c.endswith("_EC")) and c not in ("query_id",)]
    cells = []
    for c in found:
        db, kind = c.rsplit("_", 1)
        text = f"{db}_description"
        cells.append(F.struct(F.lit("EC" if kind == "EC" else db).alias("namespace"), F.col(f"`{c}`").alias("raw"), (F.col(f"`{text}`") if text in df.columns else F.lit(None).cast("string")).alias("description")))
    each = df.select(F.col("query_id").alias("gene_id"), F.explode(F.array(*cells)).alias("x")).where("x.raw is not null and trim(x.raw) <> ''")
    terms = each.select("gene_id", "x.namespace", F.explode(names.parts_of(F.col("x.raw"))).alias("id"), "x.description").distinct()
    return terms.join(known.select("gene_id").distinct(), "gene_id", "left_semi") if known is not None else terms


def transport_scores(spark: SparkSession, path: str) -> DataFrame:
    """(gene, tc, evalue) from blocks of a >gene line and `TC - Evalue: x` lines."""
    block = spark.read.text(path, lineSep=">").where("trim(value) <> ''").select(F.split("value", "\r?\n").alias("lines"))
    each = block.select(F.trim(F.col("lines")[0]).alias("gene"), F.explode(F.slice("lines", 2, 1 << 20)).alias("line"))
    shape = r"^\s*(\S+)\s+-\s+Evalue:\s*(\S+)"
    return each.where(F.col("line").rlike(shape)).select("gene", F.regexp_extract("line", shape, 1).alias("tc"), F.regexp_extract("line", shape, 2).alias("evalue"))


def reaction_references(spark: SparkSession, path: str) -> DataFrame:
    """(rxn_id, ms_rxn): bracketed lists apart, # lines skipped, an empty list as null."""
    p = F.split("value", "\t")
    lines = spark.read.text(path).where("trim(value) <> '' and not startswith(value, '#')")
    listed = F.filter(F.split(F.regexp_replace(F.coalesce(F.try_element_at(p, F.lit(2)), F.lit("")), r"[\[\]]", ""), r"\s*;\s*"), lambda x: F.trim(x) != "")
    return lines.select(F.trim(p[0]).alias("rxn_id"), F.explode_outer(F.when(F.size(listed) > 0, listed)).alias("ms_rxn"))


def sbml(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """Elements of one tag of an XML model (species, reaction, ...), attributes as _name columns."""
    return spark.read.format("xml").option("rowTag", tag).load(path)


def cluster_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(representative, member, at); lines of fewer than two cells are skipped."""
    p = F.split("value", "\t")
    return spark.read.text(path).withColumn("at", F.monotonically_increasing_id()).where(F.size(p) >= 2).select(p[0].alias("representative"), p[1].alias("member"), "at")


def distances(spark: SparkSession, path: str, least: float = 0.0, k: int | None = None) -> DataFrame:
    """Genome distances as (query, reference, ani, af_ref, af_query, rank): percent as fractions, names without folders and endings."""
    from quillon.operators.ranking import hits

    p = F.split("value", "\t")
    stem = lambda c: F.regexp_replace(F.regexp_extract(c, r"([^/]+)$", 1), r"\.[^.]*$", "")
    lines = spark.read.text(path).where(F.size(p) >= 5).where(p[2].try_cast("double").isNotNull())
    rows = lines.select(stem(p[0]).alias("reference"), stem(p[1]).alias("query"), *[(p[i].try_cast("double") / 100).alias(n) for i, n in ((2, "ani"), (3, "af_ref"), (4, "af_query"))])
    return hits(rows, least, k)


def alignments(spark: SparkSession, path: str) -> DataFrame:
    """First description and first pair of each hit of an aligner's JSON report: (query, hit_id, title, evalue, identity, bit_score)."""
    report = "BlastOutput2 array<struct<report:struct<results:struct<search:struct<query_title:string,hits:array<struct<description:array<struct<id:string,accession:string,title:string>>,hsps:array<struct<evalue:double,identity:int,align_len:int,bit_score:double>>>>>>>>>"
    search = spark.read.schema(report).json(path, multiLine=True).select(F.explode("BlastOutput2").alias("b")).select("b.report.results.search.*")
    hit = search.select(F.col("query_title").alias("query"), F.explode("hits").alias("h")).where(F.size("h.hsps") > 0)
    d, s = F.col("h.description")[0], F.col("h.hsps")[0]
    return hit.select("query", F.coalesce(d["accession"], d["id"]).alias("hit_id"), d["title"].alias("title"), s["evalue"].alias("evalue"), (s["identity"] / F.nullif(s["align_len"], F.lit(0))).alias("identity"), s["bit_score"].alias("bit_score"))


def media(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Compounds of medium texts(media_id, raw): a JSON object of {id: {concentration, minimum, maximum}}, else lines of five or more cells.

    Blank cells are 0.001, -100 and 100; a text that is neither is an error."""
    parsed = F.from_json(raw, "map<string,struct<concentration:double,minimum:double,maximum:double>>", {"mode": "PERMISSIVE"})
    is_json = F.trim(raw).startswith("{")
    cells = F.filter(F.transform(F.split(raw, "\r?\n"), lambda line: F.split(line, "\t")), lambda p: (F.size(p) >= 5) & (F.lower(p[0]) != "id"))
    bound = lambda c, default: F.coalesce(c.try_cast("double"), F.lit(default))
    from_lines = F.transform(cells, lambda p: F.struct(F.trim(p[0]).alias("compound"), bound(p[2], 0.001).alias("concentration"), bound(p[3], -100.0).alias("minimum"), bound(p[4], 100.0).alias("maximum")))
    from_object = F.transform(F.map_entries(parsed), lambda e: F.struct(e["key"].alias("compound"), bound(e["value"]["concentration"], 0.001).alias("concentration"), bound(e["value"]["minimum"], -100.0).alias("minimum"), bound(e["value"]["maximum"], 100.0).alias("maximum")))
    found = F.when(is_json, from_object).otherwise(from_lines)
    checked = F.when(F.coalesce(F.size(found), F.lit(0)) > 0, found).otherwise(F.raise_error(F.lit("a medium has no compounds")))
    return df.select("media_id", F.explode(checked).alias("x")).select("media_id", "x.*")


def local_genome(features: DataFrame, contigs: DataFrame, metadata: DataFrame) -> DataFrame:
    """Genomes of local files: GC from metadata (percent), else from contigs by length, else 0.5, and the number of features."""
    s = F.col("sequence")
    own = contigs.groupBy("genome_id").agg((F.sum(F.length(F.regexp_replace(F.upper(s), "[^GC]", ""))) / F.nullif(F.sum(F.length(s)), F.lit(0))).alias("measured"))
    n = features.groupBy("genome_id").agg(F.count("*").alias("n_features"))
    ids = features.select("genome_id").union(contigs.select("genome_id")).union(metadata.select("genome_id")).distinct()
    joined = ids.join(metadata.select("genome_id", "gc_content"), "genome_id", "left").join(own, "genome_id", "left").join(n, "genome_id", "left")
    return joined.select("genome_id", F.coalesce(F.col("gc_content") / 100, "measured", F.lit(0.5)).alias("gc"), F.coalesce("n_features", F.lit(0)).alias("n_features"))


def latest_objects(listing: DataFrame, kind: str | None = None) -> DataFrame:
    """A listing's objects by name, the latest of each, of one type if given: listing(name, type, at, ...)."""
    from quillon.operators.catalog import latest

    rows = listing.where(F.col("type") == kind) if kind is not None else listing
    return latest(rows, ["name"], ["at"])


def targets(first: DataFrame, second: DataFrame, features: DataFrame) -> DataFrame:
    """Genome ids of two tables (one of both counts twice) with their features."""
    ids = first.select("genome_id").distinct().unionByName(second.select("genome_id").distinct())
    return ids.join(features, "genome_id", "left")
