"""Readers and writers on small files."""

import json

import pytest
from pyspark.sql import functions as F

from quillon.sources import files, lake, sinks


def put(path, text):
    path.write_text(text)
    return str(path)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_fasta_last_wins_and_names_need_a_word(spark, tmp_path):
    at = put(tmp_path / "x.fa", ">a first\nACG\nT\n>b\nGG\n\n>a again\nTTT\n")
    assert rows(files.fasta(spark, at), "id", "sequence") == [("a", "TTT"), ("b", "GG")]
    with pytest.raises(Exception, match="no id"):
        files.fasta(spark, put(tmp_path / "y.fa", ">\nACG\n")).collect()


def test_fasta_round_trip(spark, tmp_path):
    records = spark.createDataFrame([("x", "ACGT" * 50), ("y", "A"), ("z", "C" * 160)], "id string, sequence string")
    sinks.fasta(records, str(tmp_path / "out"))
    text = "\n".join(r[0] for r in spark.read.text(str(tmp_path / "out"), wholetext=True).collect())
    assert max(map(len, text.split("\n"))) <= 80
    assert rows(files.fasta(spark, str(tmp_path / "out")), "id", "sequence") == rows(records, "id", "sequence")


def test_gff_ids_parents_and_skips(spark, tmp_path):
    lines = [
        "# c", "c1\ts\tCDS\t1\t9\t.\t+\t0\tID=x;Parent=g1", "c1\ts\tgene\t1\t9\t.\t+\t.\tID=g1", "c1\ts\tCDS\t1\t9\t.\t-\t0\tID=x;Parent=g1", "c1\ts\tgene\t1\t9\t.\t+\t.\tlocus_tag=t;Name=n",
        "c1\ts\tgene\t1\t9\t.\t+\t.\t", "c9\ts\tgene\t1\t9\t.\t+\t.\tID=q", "c1\ts\tregion\t1\t9\t.\t+\t.\tID=r", "short\tline",
    ]
    found = files.gff(spark, put(tmp_path / "x.gff", "\n".join(lines)), spark.createDataFrame([("c1",)], "id string"))
    got = {r["id"]: r["parent"] for r in found.collect()}
    assert got == {"x": None, "x_2": "g1", "g1": None, "t": None, "gene_3": None}


def test_prokka_longest(spark, tmp_path):
    tsv = "locus_tag\tftype\tlength_bp\tgene\tEC_number\tCOG\tproduct\na\tCDS\t450\t\t1.3.5.1;1.3.5.4\tCOG1053,COG0479\tp\nb\tCDS\t750\t\t\t\tq\nc\trRNA\tbad\nd\tCDS\t\n"
    gff = "\n".join(f"g{i}\ts\tCDS\t{s}\t9\t.\t+\t0\tlocus_tag={t}" for i, s, t in ((2, 1, "a"), (2, 5, "b"), (3, 1, "d")))
    table = files.prokka(spark, put(tmp_path / "p.tsv", tsv))
    assert rows(table, "locus_tag", "length_bp") == [("a", 450), ("b", 750), ("c", 0), ("d", 0)]
    kept = files.longest_cds(table, files.gff_loci(spark, put(tmp_path / "p.gff", gff)))
    assert rows(kept, "contig", "locus_tag") == [("g2", "b"), ("g3", "d")]
    assert table.where("locus_tag = 'a'").select(files.names.parts_of(F.col("EC_number"))).first()[0] == ["1.3.5.1", "1.3.5.4"]


def test_dram_follows_the_header(spark, tmp_path):
    tsv = "query_id\tkegg_id\tkegg_EC\tkegg_description\tdbcan_id\nq1\tK1\tEC:1.8.98.5; EC:1.8.98.6\tthing\t\nq2\t\t\t\tGH1\nq9\tK2\t\t\t\n"
    known = spark.createDataFrame([("q1",), ("q2",)], "gene_id string")
    assert rows(files.dram(spark, put(tmp_path / "d.tsv", tsv), known), "gene_id", "namespace", "id") == [("q1", "EC", "1.8.98.5"), ("q1", "EC", "1.8.98.6"), ("q1", "kegg", "K1"), ("q2", "dbcan", "GH1")]


def test_transport_blocks_and_references(spark, tmp_path):
    text = ">g1\n2.A.1 - Evalue: 1e-5\t[x]\n2.A.2 - Evalue: 0.1\n>g2\nnothing\n"
    assert rows(files.transport_scores(spark, put(tmp_path / "s.txt", text)), "gene", "tc", "evalue") == [("g1", "2.A.1", "1e-5"), ("g1", "2.A.2", "0.1")]
    refs = files.reaction_references(spark, put(tmp_path / "r.txt", "# c\nr1\t[rxn1;rxn2]\nr2\t[]\n"))
    assert sorted(map(tuple, refs.collect()), key=str) == [("r1", "rxn1"), ("r1", "rxn2"), ("r2", None)]


def test_sbml(spark, tmp_path):
    xml = "<sbml><model><listOfSpecies><species id='M_cpd00001_c0' compartment='c0'/><species id='M_x_e0' compartment='e0'/></listOfSpecies></model></sbml>"
    assert rows(files.sbml(spark, put(tmp_path / "m.xml", xml), "species"), "_id") == [("M_cpd00001_c0",), ("M_x_e0",)]


def test_clusters_and_distances(spark, tmp_path):
    assert rows(files.cluster_pairs(spark, put(tmp_path / "c.tsv", "a\ta\na\tb\nodd\n")), "representative", "member") == [("a", "a"), ("a", "b")]
    text = "ref\tquery\tANI\tAFr\tAFq\n/x/r1.fa\t/y/q.fna\t99.0\t90\t80\n/x/r2.fa\t/y/q.fna\t95\t90\t80\n/x/r3.fa\t/y/q.fna\t50\t1\t1\nshort\n"
    assert rows(files.distances(spark, put(tmp_path / "d.tsv", text), 0.9, 1), "query", "reference", "ani", "rank") == [("q", "r1", 0.99, 1)]


def test_alignments_take_first_pairs(spark, tmp_path):
    hit = {"description": [{"id": "i1", "accession": "A1", "title": "t"}, {"id": "i2"}], "hsps": [{"evalue": 0.5, "identity": 5, "align_len": 10, "bit_score": 3.0}, {"evalue": 0.1}]}
    doc = {"BlastOutput2": [{"report": {"results": {"search": {"query_title": "q", "hits": [hit, {"description": [{"id": "n"}], "hsps": []}]}}}}]}
    assert rows(files.alignments(spark, put(tmp_path / "b.json", json.dumps(doc))), "query", "hit_id", "evalue", "identity") == [("q", "A1", 0.5, 0.5)]


def test_media(spark):
    df = spark.createDataFrame([("j", '{"cpd1": {"minimum": -5}}'), ("t", "id\tname\tconc\tmin\tmax\ncpd2\tx\t\t\t7\nshort\tline")], "media_id string, raw string")
    assert rows(files.media(df), "media_id", "compound", "concentration", "minimum", "maximum") == [("j", "cpd1", 0.001, -5.0, 100.0), ("t", "cpd2", 0.001, -100.0, 7.0)]
    with pytest.raises(Exception, match="no compounds"):
        files.media(spark.createDataFrame([("e", "nothing")], "media_id string, raw string")).collect()


def test_vectors_csv_and_hash(spark, tmp_path):
    at = put(tmp_path / "v.csv", "gene,rep1,rep2\ng1,2,6\ng2,4,8\n")
    long = files.csv_vectors(spark, at, "v")
    assert rows(long, "entity_id", "column", "value") == [("g1", "rep1", 2.0), ("g1", "rep2", 6.0), ("g2", "rep1", 4.0), ("g2", "rep2", 8.0)]
    one = sinks.vectors(long, str(tmp_path / "out")).first()
    from quillon.operators.vectors import content_hash

    assert content_hash(long.orderBy(F.desc("value"))).first()["content_hash"] == one["content_hash"]
    assert content_hash(long.withColumn("value", F.col("value") + 1)).first()["content_hash"] != one["content_hash"]


def test_matrix_and_local_genome(spark, tmp_path):
    assert files.matrix(spark, put(tmp_path / "m.tsv", "g\ta\nx\t1\n")).first()["a"] == 1
    with pytest.raises(ValueError):
        files.matrix(spark, "x.bin")
    f = spark.createDataFrame([("g1",), ("g1",)], "genome_id string")
    c = spark.createDataFrame([("g2", "GGCA")], "genome_id string, sequence string")
    m = spark.createDataFrame([("g3", 40.0)], "genome_id string, gc_content double")
    assert rows(files.local_genome(f, c, m), "genome_id", "gc", "n_features") == [("g1", 0.5, 2), ("g2", 0.75, 0), ("g3", 0.4, 0)]


def test_lake_envelope_pages_and_browse(spark):
    spark.range(25).createOrReplaceTempView("numbers")
    good = lake.query(spark, "SELECT id FROM numbers ORDER BY id", 3, 5)
    assert good["success"] and [r["id"] for r in good["data"]] == [5, 6, 7] and good["row_count"] == 3
    bad = lake.query(spark, "SELECT nothing FROM nowhere")
    assert not bad["success"] and bad["data"] == [] and bad["error"]
    pages = lake.paginate(spark, "SELECT id FROM numbers ORDER BY id", 10)
    assert pages["pages_fetched"] == 3 and pages["row_count"] == 25
    assert lake.paginate(spark, "SELECT id FROM numbers ORDER BY id", 10, 2)["row_count"] == 20
    got = rows(lake.paged(spark.table("numbers"), ["id"], 10), "id", "page")
    assert got == [(i, i // 10) for i in range(25)]
    many = spark.range(400_000).select((F.col("id") * 7919 % 400_009).alias("id"), F.rand(3).alias("other"))
    pages = lake.paged(many, ["id"], 1000).groupBy("page").agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high")).orderBy("page").collect()
    assert [r["page"] for r in pages] == list(range(400)) and {r["n"] for r in pages} == {1000}
    assert all(a["high"] < b["low"] for a, b in zip(pages, pages[1:]))
    spark.sql("CREATE DATABASE IF NOT EXISTS shelf")
    spark.range(3).write.mode("overwrite").saveAsTable("shelf.t")
    assert lake.alive(spark) and lake.schema(spark, "shelf", True)["shelf"]["t"] == [{"name": "id", "type": "bigint"}]
    assert lake.schema(spark)["shelf"] == ["t"]
    spark.sql("DROP DATABASE shelf CASCADE")


def test_gene_calls_number_without_gaps(spark):
    records, ids = sinks.gene_calls(spark.createDataFrame([(f"p{i}", "M") for i in range(40)], "id string, sequence string"))
    assert sorted(int(r["id"][2:]) for r in records.collect()) == list(range(1, 41)) and ids.count() == 40


def test_mapping_reload_replaces(spark, tmp_path):
    cols = "function_hash string, function_description string, reaction_id string, score double"
    for k in (1, 2):
        spark.createDataFrame([(f"h{k}", "Some Role (EC 1.1.1.1)", "rxn1", 0.5)], cols).write.mode("overwrite").parquet(str(tmp_path / f"m{k}"))
        files.reaction_mapping(spark, str(tmp_path / f"m{k}"))
    assert [r["function_hash"] for r in spark.table("reaction_mapping").collect()] == ["h2"]


def test_ensured_makes_once(spark, tmp_path):
    made = []
    for _ in range(2):
        df = sinks.ensured(spark, str(tmp_path / "t"), lambda s: (made.append(1), s.range(2))[1])
    assert df.count() == 2 and made == [1]
