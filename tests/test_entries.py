"""Nested records and the small rules around them."""

import json

from pyspark.sql import functions as F

from quillon.functions import chemistry
from quillon.operators import catalog, entries, matching


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_protein_entries(spark):
    entry = {
        "references": [{"citation": {"title": "t", "publicationDate": "2001", "citationCrossReferences": [{"database": "PubMed", "id": "1"}, {"database": "DOI", "id": "d"}]}}, {"citation": {}}],
        "comments": [{"commentType": "CATALYTIC ACTIVITY", "reaction": {"reactionCrossReference": {"id": "R2"}}}, {"commentType": "OTHER"}, {"commentType": "CATALYTIC ACTIVITY", "reaction": {"reactionCrossReference": {"id": "R1"}}}, {"commentType": "CATALYTIC ACTIVITY", "reaction": {"reactionCrossReference": {"id": "R2"}}}],
        "uniProtKBCrossReferences": [{"database": "PDB", "id": "1ABC", "properties": [{"key": "Method", "value": "X-ray"}, {"key": "", "value": "x"}]}, {"database": "GO", "id": "g"}],
    }
    df = entries.proteins(spark.createDataFrame([("p", json.dumps(entry)), ("q", "{}")], "id string, raw string"))
    assert rows(entries.publications(df), "title", "journal", "year", "pubmed_id", "doi") == [("", "", "", None, None), ("t", "", "2001", "1", "d")]
    assert rows(entries.rhea_ids(df).where("id = 'p'"), "rhea_ids") == [(["R2", "R1"],)]
    assert rows(entries.structure_refs(df), "id", "pdb_id", "properties") == [("p", "1ABC", {"Method": "X-ray"})]


def test_structure_entries(spark):
    entry = {
        "rcsb_id": "1ABC", "rcsb_primary_citation": {"title": "t", "year": 1999, "rcsb_authors": ["A", "B"]}, "exptl": [{"method": "X-RAY"}, {}],
        "polymer_entities": [{"rcsb_id": "1ABC_1", "entity_poly": {"pdbx_strand_id": "A,B"}, "rcsb_polymer_entity": {"rcsb_ec_lineage": [{"id": "1"}, {"id": "1.1.1.1"}, {"id": "1.1.1.1"}]}, "uniprots": [{"rcsb_uniprot_protein": {"name": {"value": "n"}, "ec": ["1.1.1.1", "2.2.2.2"]}}]}],
        "nonpolymer_entities": [{"nonpolymer_comp": {"rcsb_chem_comp_synonyms": [{"provenance_source": "x", "name": "no"}, {"provenance_source": "PDB Reference Data", "name": "yes"}], "rcsb_chem_comp_descriptor": {"InChIKey": "AB-CD-E"}}}, {}],
    }
    parsed = entries.structures(spark.createDataFrame([(json.dumps(entry),)], "raw string"))
    assert rows(parsed, "entry_id", "reference", "methods") == [("1ABC", [None, "t", "NA", "A", "1999"], ["X-RAY"])]
    polymer = entries.polymers(parsed)
    assert rows(polymer, "strands", "ecs", "names", "taxonomy") == [(["A", "B"], ["1", "1.1.1.1"], ["n"], [])]
    assert rows(entries.ec_sources(polymer), "ec", "source") == [("1.1.1.1", "RCSB;UniProt"), ("2.2.2.2", "UniProt")]
    assert rows(entries.ligands(parsed), "name", "inchikey") == [("yes", "AB-CD-E")]


def test_job_payloads_and_references(spark):
    df = spark.createDataFrame([('[{"job_id": "a", "status": "running"}]',), ('{"b": {"status": "done"}, "c": {"job_id": "d"}}',)], "raw string")
    assert rows(entries.job_states(df), "job_id", "status") == [("a", "running"), ("b", "done"), ("d", None)]
    raw = json.dumps({"x": ["1/2/3", {"y": "4/5/6", "7/8/9": 1}], "z": "1/2/3", "n": "1/2"})
    assert spark.range(1).select(entries.references(F.lit(raw))).first()[0] == ["1/2/3", "4/5/6"]


def bounded(deps, budget):
    chosen = []
    for i, name in enumerate(deps):
        if len(json.dumps([*chosen, name, f"+{len(deps) - i} more"]).encode()) > budget:
            return json.dumps([*chosen, f"+{len(deps) - i} more"])
        chosen.append(name)
    return json.dumps(chosen)


def test_bounded_lists(spark):
    for n in (0, 1, 5, 80):
        deps = sorted(f"{i}/{i}/1" for i in range(n))
        got = spark.createDataFrame([(deps,)], "d array<string>").select(entries.bounded_list(F.col("d"), 120)).first()[0]
        assert got == bounded(deps, 120)
    cells = spark.createDataFrame([("n", "markdown"), ("n", "code")], "narrative_id string, cell_type string")
    used = spark.createDataFrame([("n", "2/1/1"), ("n", "1/1/1"), ("n", "1/1/1")], "narrative_id string, ref string")
    assert rows(entries.narrative_meta(cells, used), "cell_count", "markdown_count", "data_object_count", "data_dependencies") == [(2, 1, 2, '["1/1/1", "2/1/1"]')]


def test_gene_status_and_maps(spark):
    pairs = lambda *x: spark.createDataFrame(x, "reaction string, gene string")
    model = pairs(("a", "1"), ("a", "2"), ("b", "1"), ("c", "1"), ("d", "1"), ("e", None), ("f", None), ("g", "1"))
    other = pairs(("a", "1"), ("b", "1"), ("c", "2"), ("f", "9"), ("f", "mRNA1"), ("g", "1"), ("g", "2"))
    assert dict(rows(matching.gene_status(model, other), "reaction", "gene_status")) == {"a": "ExtraModel", "b": "Match", "c": "ExtraBoth", "d": "ModelOnly", "e": "NoGene", "f": "MSOnly", "g": "ExtraMS"}
    assert dict(rows(matching.gene_reactions(other), "gene", "reactions"))["1"] == ["a", "b", "g"]
    e = spark.createDataFrame([("EX_x_e0", 1), ("EX_x[e0]", 2), ("r", 3)], "id string, at int")
    assert rows(matching.exchanges(e), "exchange", "id") == [("EX_x_e0", "EX_x[e0]")]
    c = spark.createDataFrame([("h2o", None, None), ("q", "H2O", 0), ("h", "H", 1), ("z", None, None)], "b string, f string, c int")
    assert rows(c.select("b", chemistry.is_water(F.col("b"), F.col("f"), F.col("c")).alias("w"), chemistry.is_proton(F.col("b"), F.col("f"), F.col("c")).alias("p")), "b", "w", "p") == [("h", False, True), ("h2o", True, False), ("q", True, False), ("z", False, False)]
    m = spark.createDataFrame([("q", "e", ["formula"]), ("q", "f", ["formula", "name"])], "query_id string, entity_id string, evidence array<string>")
    assert rows(matching.strong(m), "entity_id", "strong") == [("e", False), ("f", True)]
    r = spark.createDataFrame([("a", 1)], "name string, v int")
    assert rows(catalog.registered(r, spark.createDataFrame([("a", 2), ("b", 3)], "name string, v int"), "name"), "name", "v") == [("a", 1), ("b", 3)]
