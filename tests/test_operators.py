"""Operators and expressions on small tables."""

import math

import pytest
from pyspark.sql import functions as F

from quillon.functions import chemistry, names, sequences
from quillon.operators import biochem, catalog, genomes, ledger, matching, ranking, vectors


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_sequences(spark):
    s = F.lit
    assert one(spark, sequences.reverse_complement(s("ACGTNacgtn"))) == "nacgtNACGT"
    assert one(spark, sequences.translate(s("atgaaaTAAxx"))) == "MK*"
    assert one(spark, sequences.translate(s("ATGNNN"))) == "MX"
    assert one(spark, sequences.translate(s("AT"))) == ""
    assert one(spark, sequences.gc_fraction(s("GGcN"))) == 1.0 and one(spark, sequences.gc_fraction(s("NN"))) == 0.0
    assert one(spark, sequences.gc_of_length(s("GGcN"))) == 0.75
    assert one(spark, sequences.same_protein(s("MKV*"), s("LKV"))) and not one(spark, sequences.same_protein(s("MKV"), s("MKA")))


def test_log_ratio_edges(spark):
    f = lambda a, b, base=2: one(spark, chemistry.log_ratio(F.lit(a).cast("double"), F.lit(b).cast("double"), base))
    assert f(8, 2) == 2 and f(3, 2, None) == 1.5
    assert math.isnan(f(-1, 2)) and math.isnan(f(0, 2)) and math.isnan(f(0, 0, None)) and f(1, 0, None) == math.inf and f(1, 0) == math.inf and f(None, 1) is None


def test_names(spark):
    s = F.lit
    assert one(spark, names.standard(s("A_DASH_b C(1)"))) == "abc1"
    assert one(spark, names.role_key(s("Some Role (EC 1.1.1.1), x # note"))) == "somerolex"
    assert one(spark, names.functions_of(s("a / b; c @ d"))) == ["a", "b", "c", "d"]
    assert tuple(one(spark, names.place(s("cpd1_p2")))) == ("cpd1", "p", "2") and tuple(one(spark, names.place(s("x")))) == ("x", "c", "0")
    assert one(spark, names.exchange(s("cpd1_e0"))) == "EX_cpd1_e0"
    assert one(spark, names.scientific_name(s("d__Bacteria;g__Esc;s__"))) == "Esc" and one(spark, names.domain(s("d__Archaea;x"))) == "Archaea"
    assert one(spark, names.is_ref(s("12/3/4"))) and not one(spark, names.is_ref(s("12/x")))
    assert one(spark, names.tagged(s("ec"), s("1.1.1.1"))) == "EC:1.1.1.1" and one(spark, names.tagged(s("ms"), s("RXN:5"), {"MS": "MSRXN", "RXN": "MSRXN"})) == "MSRXN:5"
    assert "acetate" in one(spark, names.name_variants(s("acetic acid"))) or "acetate" in one(spark, names.name_variants(s("Sodium acetate")))
    assert one(spark, names.label(s("Growth - yes"), {"growth": "grows"}, ["grows"])) == "grows" and one(spark, names.label(s("odd"), {}, ["x"])) == "Unknown"
    assert one(spark, names.shown(s("x" * 90))) == "x" * 80 + "... (10 more)"


def test_formulas(spark):
    assert one(spark, chemistry.element_map(F.lit("C6H12O6C2"))) == {"C": 8, "H": 12, "O": 6}
    assert one(spark, chemistry.combined_directions(F.lit("forward"), F.lit(None).cast("string"), F.lit("reversible"))) == ">|?|="
    assert tuple(one(spark, chemistry.proton_repair(F.lit(2.0), F.lit(2.0), F.lit(0.0)))) == (True, -2.0)


def test_vector_rules(spark):
    v = spark.createDataFrame([("a", "g1", "r1", 2.0), ("a", "g1", "r2", 6.0), ("a", "g2", "r1", None), ("b", "g1", "r", 2.0), ("b", "g3", "r", 1.0)], "vector_id string, entity_id string, column string, value double")
    assert rows(vectors.aggregate(v, "sum", "s", ["a"]), "entity_id", "value") == [("g1", 8.0), ("g2", 0.0)]
    assert rows(vectors.aggregate(v, "mean", "s", ["a"]), "entity_id", "value") == [("g1", 4.0), ("g2", None)]
    assert rows(vectors.fold_change(v, "a", "b", "f", 2, "mean"), "entity_id", "column", "value") == [("g1", "log2_fold_change", 1.0)]
    with pytest.raises(Exception, match="needs a reduction"):
        vectors.fold_change(v, "a", "b", "f").collect()
    with pytest.raises(ValueError):
        vectors.fold_change(v, "a", "b", "f", 2, "sum")
    assert vectors.many(v, []).count() == 0


def test_upsert_keeps_and_replaces(spark):
    old = spark.createDataFrame([(1, "a", "t0"), (2, "b", "t0")], "id int, v string, made string")
    new = spark.createDataFrame([(2, None, "t1"), (3, "c", "t1")], "id int, v string, made string")
    assert rows(catalog.upsert(old, new, ["id"], ["made"]), "id", "v", "made") == [(1, "a", "t0"), (2, None, "t0"), (3, "c", "t1")]


def test_catalog_blobs(spark):
    objects = spark.createDataFrame([("x", "h1"), ("y", "h1"), ("z", "h2")], "id string, content_hash string")
    left, orphans = catalog.deleted(objects, spark.createDataFrame([("y",), ("z",)], "id string"))
    assert rows(left, "id") == [("x",)] and rows(orphans, "content_hash") == [("h2",)]
    assert rows(catalog.changed_blobs(objects, spark.createDataFrame([("n", "h2"), ("m", "h9")], "id string, content_hash string")), "id") == [("m",)]


def test_lineage_ends_on_cycles(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("a", "c")], "child_id string, parent_id string")
    assert catalog.lineage(edges).count() == 9


def test_margin_and_rank(spark):
    df = spark.createDataFrame([("q", "a", 0.9), ("q", "b", 0.75), ("p", "c", 0.5)], "q string, c string, s double")
    got = rows(ranking.margins(df, "q", "s", "c", 1), "q", "c", "top1_margin", "confidence_band")
    assert got == [("p", "c", None, "low"), ("q", "a", 0.15, "high")]


def test_transport_and_balance(spark):
    s = spark.createDataFrame([("r", "h", "e", -1.0), ("r", "h", "c", 1.0), ("t", "a", "c", -1.0), ("t", "b", "c", 1.0)], "reaction_id string, compound_id string, compartment string, coefficient double")
    charges = spark.createDataFrame([("h", 1)], "id string, charge int")
    pairs = spark.createDataFrame([("e", "c")], "first string, second string")
    assert rows(biochem.ion_transfer(s, charges, pairs), "reaction_id", "charge_moved") == [("r", -1.0)]
    assert rows(biochem.diffusion(s), "reaction_id", "diffusion") == [("r", True), ("t", False)]
    c = spark.createDataFrame([("h", "H", 1), ("a", "C2H4", 0)], "id string, formula string, charge int")
    assert rows(biochem.balance(s, c), "reaction_id", "kind", "amount") == [("t", "C", -2.0), ("t", "H", -4.0), ("t", "missing:b", 1.0)]
    assert dict(biochem.equation(s.withColumn("reversible", F.lit(False))).collect())["t"] == "a[c] => b[c]"


def test_matching_by_structures_and_variants(spark):
    e = spark.createDataFrame([("c1", "acetate", ["ethanoate"], {"kegg": ["C1"]}, "C2H3O2", "K-L-M")], "id string, name string, names array<string>, annotation map<string,array<string>>, formula string, inchikey string")
    table = matching.structures(e.withColumns({"inchi": F.lit("I"), "smiles": F.lit(None).cast("string")}))
    assert rows(table, "key") == [("I",), ("K",), ("K-L",), ("K-L-M",)]
    q = spark.createDataFrame([("q", ["Ethanoate"], ["K-L"], "H4C2O2")], "query_id string, identifiers array<string>, structures array<string>, formula string")
    hits = matching.compounds(q, matching.aliases(e), table, e.select(F.col("id").alias("entity_id"), "formula"))
    assert rows(hits, "entity_id", "score") == [("c1", 20)]
    named = spark.createDataFrame([("q", "Sodium acetate")], "query_id string, name string")
    assert rows(matching.variants(named, matching.aliases(e)), "entity_id", "score") == [("c1", 10)]


def test_formula_hits_need_hydrogen_on_both_sides(spark):
    f = spark.createDataFrame([("co2", "CO2"), ("ch2o2", "CH2O2")], "entity_id string, formula string")
    q = spark.createDataFrame([("a", [], [], "CO2"), ("b", [], [], "CH2O2")], "query_id string, identifiers array<string>, structures array<string>, formula string")
    none = spark.createDataFrame([], "entity_id string, alias_std string, alias_type string")
    assert rows(matching.compounds(q, none, None, f), "query_id", "entity_id", "score") == [("a", "ch2o2", 2), ("a", "co2", 2), ("b", "ch2o2", 4), ("b", "co2", 2)]


def test_reaction_evidence(spark):
    """Each direction adds what it finds; identifiers count once; only unknown EC numbers are tried by their first levels."""
    q = [("q", "a", -1.0, None), ("q", "b", 1.0, None), ("t", "x", 0.0, -1.0)]
    r = [("same", "a", -1.0, None), ("same", "b", 1.0, None), ("back", "a", 1.0, None), ("back", "b", -1.0, None), ("half", "a", -1.0, None), ("half", "c", 1.0, None), ("moves", "x", 0.0, 1.0)]
    stoich = spark.createDataFrame(q, "query_id string, compound string, coefficient double, transport double")
    reference = spark.createDataFrame(r, "entity_id string, compound string, coefficient double, transport double")
    named = spark.createDataFrame([("q", "half", 3)], "query_id string, entity_id string, n int")
    ecs = spark.createDataFrame([("q", "1.1.1.1"), ("t", "2.2.2.9")], "query_id string, ec string")
    theirs = spark.createDataFrame([("same", "1.1.1.1"), ("half", "1.1.1.2"), ("back", "2.2.2.2")], "entity_id string, ec string")
    protons = spark.createDataFrame([("q", 1.0)], "query_id string, protons double")
    held = spark.createDataFrame([("same", 1.0), ("back", -1.0)], "entity_id string, protons double")
    got = rows(matching.reactions(stoich, reference, named, ecs, theirs, protons=protons, reference_protons=held), "query_id", "entity_id", "score")
    # moves: a zero coefficient agrees in both directions, its one compound is moved back
    assert got == [("q", "back", 22.0), ("q", "half", 20.0), ("q", "same", 30.0), ("t", "back", 6.0), ("t", "moves", 50.0)]
    mapped = spark.createDataFrame([("a", "A"), ("b", "B")], "compound string, entity string")
    other = spark.createDataFrame([("r", "A", -1.0), ("r", "B", 1.0)], "entity_id string, compound string, coefficient double")
    assert rows(matching.reactions(stoich, other, named.where("false"), compound_hits=mapped), "query_id", "entity_id", "score") == [("q", "r", 20.0)]


def test_renaming_never_merges(spark):
    ids = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "id string, at int")
    mapping = spark.createDataFrame([("a", "m1"), ("b", "m1"), ("c", "b")], "id string, new_id string")
    assert rows(matching.renamed(ids, mapping, ids), "id", "new_id") == [("a", "m1"), ("b", "b"), ("c", "c")]


def test_namespace_fixpoint(spark):
    hits = spark.createDataFrame([("x", "A", True), ("y", "B", False), ("y", "C", False)], "compound string, entity string, strong boolean")
    eq = spark.createDataFrame([("r", "x", -1.0), ("r", "y", 1.0), ("s", "y", -1.0), ("s", "z", 1.0)], "reaction string, compound string, coefficient double")
    ref = spark.createDataFrame([("R", "A", -1.0), ("R", "B", 1.0), ("S", "B", -1.0), ("S", "D", 1.0)], "entity_reaction string, entity string, coefficient double")
    assert rows(matching.namespace_fixpoint(hits, eq, ref), "compound", "entity") == [("x", "A"), ("y", "B"), ("z", "D")]


def test_features(spark):
    f = spark.createDataFrame([("f", "gene", None, ["a:b", "c"], "x; y", "m1", None), ("f", "CDS", "MK", ["a:b"], "x", "m2", "p")], "id string, type string, protein_translation string, aliases array<string>, function string, md5 string, protein_md5 string")
    assert rows(genomes.normalised(f), "id", "kind") == [("f", "noncoding")]
    up = genomes.upgraded_aliases(f).where("type = 'gene'").first()
    assert [tuple(a) for a in up["aliases"]] == [("a", "b"), ("Unknown", "c")] and up["functions"] == ["x", "y"]
    assert rows(genomes.coding_clones(f), "id", "type") == [("f_CDS_1", "CDS")]
    t = spark.createDataFrame([("g", "EC", "1"), ("g", "EC", "2"), ("h", "EC", "1")], "gene string, ontology string, term string")
    assert genomes.events(t).first()["genes"] == {"g": ["1", "2"], "h": ["1"]}
    wide = genomes.annotation_table(spark.createDataFrame([("g", 5, 10)], "id string, start int, length int"), t, ["EC", "KO"]).first()
    assert wide["Annotation:EC"] == "1;2" and wide["Annotation:KO"] == "" and wide["end"] == 15
    a = spark.createDataFrame([("EC", "x", "1", 0), ("EC", "x", "2", 1)], "namespace string, alias string, id string, at int")
    assert genomes.alias_hash(a).first()["ids"] == ["1", "2"] and genomes.alias_hash(a, True).first()["ids"] == ["2"]


def test_pipeline_steps(spark):
    p = spark.createDataFrame([("a", 0, 2, "running"), ("b", 1, 2, "running"), ("c", 0, 2, "running"), ("d", 0, 2, "running")], "pipeline_id string, current_step int, total_steps int, status string")
    j = spark.createDataFrame([("a", 0, "completed"), ("b", 1, "completed"), ("c", 0, "error")], "pipeline_id string, step int, state string")
    assert rows(ledger.advanced(p, j), "pipeline_id", "current_step", "status", "submit_next") == [("a", 1, "running", True), ("b", 1, "completed", False), ("c", 0, "failed", False), ("d", 0, "running", False)]


def test_uncached_batches(spark):
    r = spark.createDataFrame([(f"k{i}",) for i in range(30)], "key string")
    got = matching.uncached(r, spark.createDataFrame([("k0",)], "key string"), "key", 3)
    assert got.count() == 29 and max(x["count"] for x in got.groupBy("batch").count().collect()) <= 3
