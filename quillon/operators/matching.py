"""Scored matching of names, formulas and reactions; translation by alias tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import chemistry, names

#: What each kind of evidence adds.
NAME_SCORE, STRUCTURE_SCORE, FORMULA_SCORE, HYDROGEN_SCORE = 10, 8, 2, 2
EC_SCORE, EC_PREFIX_SCORE, EQUATION_SCORE, TRANSPORT_SCORE, PROTON_SCORE = 8, 6, 20, 10, 2


def aliases(entities: DataFrame) -> DataFrame:
    """(entity_id, alias_std, alias_type) of entities(id, name, names, annotation); an alias that is held twice stays twice.

    The type of an alias is its first inserter's: id, then name, then synonyms, then annotations."""
    typed = F.concat(
        F.array(F.struct(F.lit("id").alias("type"), F.col("id").alias("alias"))),
        F.array(F.struct(F.lit("name").alias("type"), F.col("name").alias("alias"))),
        F.transform(F.coalesce("names", F.array().cast("array<string>")), lambda n: F.struct(F.lit("synonym").alias("type"), n.alias("alias"))),
        F.flatten(F.transform(F.map_entries(F.coalesce("annotation", F.create_map().cast("map<string,array<string>>"))), lambda e: F.transform(e["value"], lambda a: F.struct(e["key"].alias("type"), a.alias("alias"))))),
    )
    each = entities.repartition("id").select(F.col("id").alias("entity_id"), F.posexplode(typed).alias("at", "x")).select("entity_id", "at", names.standard(F.col("x.alias")).alias("alias_std"), F.col("x.type").alias("type")).where("alias_std <> ''")
    first = each.groupBy("alias_std").agg(F.min_by("type", F.struct("at", "entity_id")).alias("alias_type"))
    return each.join(first, "alias_std").select("entity_id", "alias_std", "alias_type")


def structures(entities: DataFrame) -> DataFrame:
    """(entity_id, key) of structure strings(id, inchi, smiles, inchikey): whole ones and a key's first and first two blocks."""
    blocks = F.split("inchikey", "-")
    keys = F.array("inchi", "smiles", "inchikey", blocks[0], F.concat_ws("-", blocks[0], F.try_element_at(blocks, F.lit(2))))
    return entities.select(F.col("id").alias("entity_id"), F.explode(F.array_distinct(keys)).alias("key")).where("key is not null and key <> ''")


def _classes(evidence: DataFrame, key: str) -> DataFrame:
    """(key, told, shape): rows of one id with their evidence by aliases and structures, and by formulas, as hashes; null where none."""
    each = evidence.groupBy(key, "kind", "value", "h").agg(F.count("*").alias("n"))
    item = F.struct("kind", "value", "h", "n")
    lists = each.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("kind") != "formula", item))).alias("a"), F.array_sort(F.collect_list(F.when(F.col("kind") == "formula", item))).alias("b"))
    sign = lambda c: F.when(F.size(c) > 0, F.md5(F.to_json(c)))
    return lists.select(key, sign("a").alias("told"), sign("b").alias("shape"), F.concat("a", "b").alias("items"))


def _class_scores(mine: DataFrame, theirs: DataFrame, name: str) -> DataFrame:
    """(name_q, name_e, score) of the classes of ids that share evidence."""
    def items(df, side):
        once = df.where(F.col(name).isNotNull()).groupBy(F.col(name).alias(f"{name}_{side}")).agg(F.first("items").alias("items"))
        kept = F.col("i.kind") == "formula" if name == "shape" else F.col("i.kind") != "formula"
        return once.select(f"{name}_{side}", F.explode("items").alias("i")).where(kept).select(f"{name}_{side}", "i.kind", "i.value", F.col("i.h").alias(f"h_{side}"), F.col("i.n").alias(f"n_{side}"))

    worth = F.when(F.col("kind") == "name", NAME_SCORE).when(F.col("kind") == "structure", STRUCTURE_SCORE).when(F.col("h_q") == F.col("h_e"), FORMULA_SCORE + HYDROGEN_SCORE).otherwise(FORMULA_SCORE)
    return items(mine, "q").join(items(theirs, "e"), ["kind", "value"]).groupBy(f"{name}_q", f"{name}_e").agg(F.sum(worth * F.col("n_q") * F.col("n_e")).alias("score"))


#: Pairs of classes that may be broadcast; more go through a shuffled join.
BROADCAST_CLASSES = 500_000


def compounds(queries: DataFrame, alias_table: DataFrame, structure_table: DataFrame | None = None, formulas: DataFrame | None = None) -> DataFrame:
    """Scored hits (query_id, entity_id, score) of queries(query_id, identifiers, structures, formula).

    A formula counts if all elements but hydrogen agree, and more if both have hydrogen, as much of it. Ids of equal evidence
    are one class: scores are summed up for pairs of classes, and hits are listed from these without a shuffle of their own."""
    from quillon.sources.sinks import stored

    part = lambda df, key, kind, value, h=None: df.select(key, F.lit(kind).alias("kind"), value.alias("value"), (F.lit(None).cast("long") if h is None else h.cast("long")).alias("h"))
    asked = queries.select("query_id", F.explode("identifiers").alias("q")).select("query_id", names.standard(F.col("q")).alias("alias_std"))
    mine, theirs = part(asked, "query_id", "name", F.col("alias_std")), part(alias_table, "entity_id", "name", F.col("alias_std"))
    if structure_table is not None:
        mine = mine.union(part(queries.select("query_id", F.explode("structures").alias("key")), "query_id", "structure", F.col("key")))
        theirs = theirs.union(part(structure_table, "entity_id", "structure", F.col("key")))
    if formulas is not None:
        shape = lambda df, key: df.select(key, F.map_filter(chemistry.element_map(F.col("formula")), lambda e, n: e != "H").alias("m"), F.try_element_at(chemistry.element_map(F.col("formula")), F.lit("H")).alias("h")).select(key, F.to_json(F.array_sort(F.map_entries("m"))).alias("heavy"), "h").where("heavy <> '[]'")
        mine = mine.union(part(shape(queries, "query_id"), "query_id", "formula", F.col("heavy"), F.col("h")))
        theirs = theirs.union(part(shape(formulas.repartition("entity_id"), "entity_id"), "entity_id", "formula", F.col("heavy"), F.col("h")))
    mine = stored(_classes(mine, "query_id"))
    met = mine.select(F.explode("items").alias("i")).select("i.kind", "i.value").distinct()
    theirs = stored(_classes(theirs.join(met, ["kind", "value"], "left_semi"), "entity_id"))
    told, shapes = (stored(_class_scores(mine, theirs, name)) for name in ("told", "shape"))
    held = lambda df: F.broadcast(df) if df.count() <= BROADCAST_CLASSES else df
    q, e = (df.select(key, F.col("told").alias(f"told_{side}"), F.col("shape").alias(f"shape_{side}")) for df, key, side in ((mine, "query_id", "q"), (theirs, "entity_id", "e")))
    both = told.join(q, "told_q").join(e, "told_e").join(held(shapes.withColumnRenamed("score", "more")), ["shape_q", "shape_e"], "left")
    alone = shapes.join(q, "shape_q").join(e, "shape_e").join(held(told), ["told_q", "told_e"], "left_anti")
    return both.select("query_id", "entity_id", (F.col("score") + F.coalesce("more", F.lit(0))).alias("score")).union(alone.select("query_id", "entity_id", "score"))


def variants(queries: DataFrame, alias_table: DataFrame) -> DataFrame:
    """Hits of all name variants of queries(query_id, name): the best score per hit and the first variant that reached it."""
    each = queries.select("query_id", F.posexplode(names.name_variants(F.col("name"))).alias("at", "variant")).withColumn("alias_std", names.standard(F.col("variant")))
    scored = each.join(alias_table, "alias_std").groupBy("query_id", "entity_id", "at", "variant").agg((F.count("*") * NAME_SCORE).alias("score"))
    return scored.groupBy("query_id", "entity_id").agg(F.max("score").alias("score"), F.max_by("variant", F.struct("score", -F.col("at"))).alias("variant"))


def reactions(
    stoich: DataFrame, reference: DataFrame, identified: DataFrame, ecs: DataFrame | None = None, reference_ecs: DataFrame | None = None,
    missing: int = 1, compound_hits: DataFrame | None = None, protons: DataFrame | None = None, reference_protons: DataFrame | None = None,
) -> DataFrame:
    """Scored hits (query_id, entity_id, score, fraction) of reactions.

    stoich(query_id, compound, coefficient[, transport]) and reference(entity_id, compound, coefficient[, transport]) are
    net equations, with a compound's coefficient in the outermost compartment where it is moved; identified(query_id,
    entity_id, n) are matched identifiers, which count once. An EC number that no reaction has is tried by its first three
    levels. compound_hits(compound, entity) says which reference compounds a query's may be; without it, equal ids are.

    Both directions are tried, the reverse one first, and each adds what it finds. An equation counts if the hit is known
    by now or if all but `missing` compounds (none for two or fewer) agree and both have as many compounds; a transport, if
    all moved compounds agree and the hit is known by now or the query only moves compounds; equal protons
    (protons(query_id, protons), reference_protons(entity_id, protons)), if the hit is known by now."""
    key, zero = ["query_id", "entity_id"], F.lit(0.0)
    base = identified.select(*key, F.lit(float(NAME_SCORE)).alias("score")).distinct()
    if ecs is not None and reference_ecs is not None:
        whole = ecs.join(reference_ecs, "ec").select(*key, F.lit(float(EC_SCORE)).alias("score")).distinct()
        cut = lambda df, name: df.select(name, names.ec_prefix(F.col("ec")).alias("prefix")).distinct()
        unknown = ecs.join(reference_ecs.select("ec"), "ec", "left_anti")
        near = cut(unknown, "query_id").join(cut(reference_ecs, "entity_id"), "prefix").select(*key).distinct().join(whole, key, "left_anti").withColumn("score", F.lit(float(EC_PREFIX_SCORE)))
        base = base.union(whole).union(near)
    told = base.groupBy(*key).agg(F.sum("score").alias("told"))
    with_transport = lambda df: df if "transport" in df.columns else df.withColumn("transport", F.lit(None).cast("double"))
    mine, theirs = with_transport(stoich), with_transport(reference)
    sizes = lambda df, name, moved, n: df.groupBy(name).agg(F.countDistinct("compound").alias(n), F.countDistinct(F.when(F.col("transport").isNotNull(), F.col("compound"))).alias(moved))
    mapped = mine.withColumn("entity", F.col("compound")) if compound_hits is None else mine.join(compound_hits.select("compound", "entity").distinct(), "compound")
    met = mapped.join(theirs.select("entity_id", F.col("compound").alias("entity"), F.col("coefficient").alias("other"), F.col("transport").alias("moved")), "entity")
    same = lambda condition, name: F.countDistinct(F.when(condition, F.col("compound"))).alias(name)
    counts = met.groupBy(*key).agg(
        same(F.col("coefficient") == -F.col("other"), "back"), same(F.col("coefficient") == F.col("other"), "ahead"), same(F.col("transport") == -F.col("moved"), "moved_back"), same(F.col("transport") == F.col("moved"), "moved_ahead")
    )
    counts = counts.where("back > 0 or ahead > 0 or moved_back > 0 or moved_ahead > 0")
    pure = mine.groupBy("query_id").agg((F.max(F.abs("coefficient")) < 1e-9).alias("pure"))
    joined = told.join(counts, key, "full").join(sizes(mine, "query_id", "t", "n").join(pure, "query_id"), "query_id", "left").join(sizes(theirs, "entity_id", "t2", "n2").drop("t2"), "entity_id", "left")
    if protons is not None and reference_protons is not None:
        joined = joined.join(protons.select("query_id", F.col("protons").alias("p")), "query_id", "left").join(reference_protons.select("entity_id", F.col("protons").alias("p2")), "entity_id", "left")
    else:
        joined = joined.withColumns({"p": F.lit(None).cast("double"), "p2": F.lit(None).cast("double")})
    may_miss = F.when(F.col("n") <= 2, 0).otherwise(missing)
    joined = joined.withColumns({"score": F.coalesce("told", zero), "known": F.col("told").isNotNull(), "fraction": F.lit(None).cast("double")})
    for sign, agree, moved in ((-1, "back", "moved_back"), (1, "ahead", "moved_ahead")):
        counted = (F.col(agree) > 0) & (F.col("known") | ((F.col(agree) >= F.col("n") - may_miss) & (F.col("n") == F.col("n2"))))
        joined = joined.withColumn("ok", F.coalesce(counted, F.lit(False))).withColumn("part", F.col(agree) / F.col("n"))
        joined = joined.withColumns({"score": F.col("score") + F.when(F.col("ok"), EQUATION_SCORE * F.col("part")).otherwise(zero), "fraction": F.greatest("fraction", F.when(F.col("ok"), F.col("part"))), "known": F.col("known") | F.col("ok")})
        joined = joined.withColumn("ok", F.coalesce((F.col(moved) > 0) & (F.col(moved) == F.col("t")) & (F.col("known") | F.col("pure")), F.lit(False)))
        joined = joined.withColumns({"score": F.col("score") + F.when(F.col("ok"), TRANSPORT_SCORE * F.col(moved)).otherwise(zero), "known": F.col("known") | F.col("ok")})
        joined = joined.withColumn("score", F.col("score") + F.when(F.col("known") & (F.col("p") * sign == F.col("p2")), F.lit(float(PROTON_SCORE))).otherwise(zero))
    return joined.where("known").select(*key, "score", "fraction")


def preferred(hits: DataFrame, key: str, flag: str) -> DataFrame:
    """Of each key the flagged rows, or all where none is flagged."""
    any_ = F.max(F.col(flag).cast("int")).over(Window.partitionBy(key)) == 1
    return hits.withColumn("_any", any_).where(F.col(flag) | ~F.col("_any")).drop("_any")


def gene_adjusted(hits: DataFrame, own: DataFrame, theirs: DataFrame) -> DataFrame:
    """Scores of hits(query_id, entity_id, score) with genes: 10 for each shared one, less 5 for each that one side alone has."""
    mine, other = own.distinct(), theirs.distinct()
    shared = hits.select("query_id", "entity_id").join(mine, "query_id").join(other, ["entity_id", "gene"]).groupBy("query_id", "entity_id").agg(F.count("*").alias("shared"))
    count = lambda df, key, name: df.groupBy(key).agg(F.count("*").alias(name))
    joined = hits.join(shared, ["query_id", "entity_id"], "left").join(count(mine, "query_id", "a"), "query_id", "left").join(count(other, "entity_id", "b"), "entity_id", "left")
    s, a, b = (F.coalesce(F.col(c), F.lit(0)) for c in ("shared", "a", "b"))
    return joined.select("query_id", "entity_id", (F.col("score") + 10 * s - 5 * (a - s) - 5 * (b - s)).alias("score"), s.alias("gene_matches"))


def perfect(matches: DataFrame) -> DataFrame:
    """Per query the match with fewest mismatches, most agreements, highest score, template members first."""
    from quillon.operators.ranking import best

    return best(matches, ["query_id"], [F.asc("mismatches"), F.desc("agreements"), F.desc("score"), F.desc("in_template"), F.asc("entity_id")])


def match_counts(matches: DataFrame) -> DataFrame:
    """How many match rows belong to queries of each number of matches."""
    n = F.count("*").over(Window.partitionBy("query_id"))
    return matches.withColumn("match_count", n).groupBy("match_count").agg(F.count("*").alias("n_rows"))


def translated(terms: DataFrame, alias_table: DataFrame, filtered: DataFrame | None = None) -> DataFrame:
    """(term, reaction) by alias_table(term, reaction), without the filtered reactions."""
    out = terms.select("term").join(alias_table, "term")
    return out.join(filtered.select("reaction").distinct(), "reaction", "left_anti").select("term", "reaction") if filtered is not None else out.select("term", "reaction")


def function_reactions(functions: DataFrame, mapping: DataFrame, filtered: DataFrame | None = None) -> DataFrame:
    """Reactions of functions(function_hash, description): by hash, else by the description's lookup key."""
    keyed = mapping.withColumn("key", names.role_key(F.col("function_description")))
    by_hash = functions.join(keyed.select("function_hash", "reaction_id", "score"), "function_hash").select("function_hash", "description", "reaction_id", "score")
    rest = functions.join(mapping.select("function_hash").distinct(), "function_hash", "left_anti").withColumn("key", names.role_key(F.col("description")))
    by_key = rest.join(keyed.select("key", "reaction_id", "score"), "key").select("function_hash", "description", "reaction_id", "score")
    out = by_hash.unionByName(by_key)
    return out.join(filtered.select(F.col("id").alias("reaction_id")).distinct(), "reaction_id", "left_anti").select("function_hash", "description", "reaction_id", "score") if filtered is not None else out


def resolved(wanted: DataFrame, features: DataFrame, alias_table: DataFrame) -> DataFrame:
    """wanted(name) as features: by id, else by alias, else found false."""
    exact = features.select(F.col("id").alias("name"), F.col("id").alias("by_id")).distinct()
    alias = alias_table.groupBy(F.col("alias").alias("name")).agg(F.min("id").alias("by_alias"))
    joined = wanted.join(exact, "name", "left").join(alias, "name", "left")
    return joined.select("name", F.coalesce("by_id", "by_alias").alias("feature_id"), (F.col("by_id").isNotNull() | F.col("by_alias").isNotNull()).alias("found"))


def structure_hits(hits: DataFrame, metadata: DataFrame, proteins: DataFrame) -> DataFrame:
    """hits(query_id, hit_id, evalue) with their structure's metadata (by the id before _) and protein; others go."""
    keyed = hits.withColumn("entry_id", F.substring_index("hit_id", "_", 1))
    return keyed.join(metadata, "entry_id").join(proteins.withColumnRenamed("protein_id", "hit_id"), "hit_id")


def best_hits(features: DataFrame, hits: DataFrame, aligned: DataFrame) -> DataFrame:
    """Every feature with its number of embedding hits, best aligned hit and that hit's embedding score, null without any."""
    n = hits.groupBy("feature_id").agg(F.count("*").alias("n_hits"))
    best = aligned.groupBy("feature_id").agg(F.min_by("hit_id", F.struct("evalue", "hit_id")).alias("best_hit"), F.min("evalue").alias("evalue"))
    scores = hits.select("feature_id", F.col("hit_id").alias("best_hit"), "score").groupBy("feature_id", "best_hit").agg(F.max("score").alias("score"))
    return features.select("feature_id").join(n, "feature_id", "left").join(best, "feature_id", "left").join(scores, ["feature_id", "best_hit"], "left").select("feature_id", "n_hits", "best_hit", "evalue", "score")


def prefix_matched(keys: DataFrame, entries: DataFrame) -> DataFrame:
    """keys(name, inchikey) with the first entry(at, inchikey, value) that shares all but the last two characters: an equality of prefixes."""
    cut = lambda c: F.expr(f"substring({c}, 1, greatest(length({c}) - 2, 0))")
    first = entries.groupBy(cut("inchikey").alias("prefix")).agg(F.min_by("value", "at").alias("value"))
    return keys.withColumn("prefix", cut("inchikey")).join(first, "prefix", "left").select("name", "inchikey", "value")


def annotation_records(gene_reactions: DataFrame, mapping: DataFrame, species: DataFrame) -> DataFrame:
    """Distinct (gene, namespace, id) terms of genes: mapped reactions (their own id where unmapped) and compounds."""
    joined = gene_reactions.join(mapping, "reaction", "left")
    rxn = joined.select("gene", F.lit("reaction").alias("namespace"), F.coalesce("ms_reaction", "reaction").alias("id"))
    cpd = joined.join(species, "reaction").select("gene", F.lit("compound").alias("namespace"), F.col("compound").alias("id"))
    return rxn.union(cpd).where("id is not null").distinct()


def model_comparison(model: DataFrame, other: DataFrame) -> DataFrame:
    """Reactions of two models with status Both, ModelOnly or OtherOnly."""
    joined = model.select("reaction").distinct().withColumn("a", F.lit(1)).join(other.select("reaction").distinct().withColumn("b", F.lit(1)), "reaction", "full")
    return joined.select("reaction", F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), "Both").when(F.col("b").isNull(), "ModelOnly").otherwise("OtherOnly").alias("status"))


def gene_status(model: DataFrame, other: DataFrame) -> DataFrame:
    """Per reaction of a model how its genes compare with those of its match: (reaction, gene) on both sides; messenger genes of the match don't count."""
    mine, theirs = model.select("reaction", "gene").distinct().withColumn("a", F.lit(1)), other.where("not startswith(gene, 'mRNA')").select("reaction", "gene").distinct().withColumn("b", F.lit(1))
    counted = mine.join(theirs, ["reaction", "gene"], "full").where("gene is not null").groupBy("reaction").agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("m"), F.count_if(F.col("b").isNull()).alias("x"), F.count_if(F.col("a").isNull()).alias("y"))
    m, x, y = (F.coalesce(F.col(c), F.lit(0)) > 0 for c in "mxy")
    status = F.when(x & y, "ExtraBoth").when(x & m, "ExtraModel").when(x, "ModelOnly").when(y & m, "ExtraMS").when(y, "MSOnly").when(m, "Match").otherwise("NoGene")
    return model.select("reaction").distinct().join(counted, "reaction", "left").select("reaction", status.alias("gene_status"))


def strong(matches: DataFrame) -> DataFrame:
    """Compound matches with whether more than a formula speaks for them: matches(query_id, entity_id, evidence)."""
    return matches.withColumn("strong", F.exists("evidence", lambda e: e != "formula"))


def gene_reactions(rules: DataFrame) -> DataFrame:
    """Reactions of each gene: rules(reaction, gene)."""
    return rules.groupBy("gene").agg(F.array_sort(F.collect_set("reaction")).alias("reactions"))


def exchanges(reactions_: DataFrame) -> DataFrame:
    """Exchange reactions by standard id; of several of one id the last counts: reactions(id, at)."""
    return reactions_.where("startswith(id, 'EX_')").groupBy(names.exchange(F.col("id")).alias("exchange")).agg(F.max_by("id", "at").alias("id"))


def attached(ids: DataFrame, info: DataFrame, key: str) -> DataFrame:
    """ids with what is known of them, null where nothing is."""
    return ids.join(info, key, "left")


def uncached(requests: DataFrame, cache: DataFrame, key: str, batch: int = 10) -> DataFrame:
    """Requests that the cache lacks, with batch numbers; batches are cut per hash bucket, so numbering needs no global sort."""
    rest = requests.join(cache.select(key).distinct(), key, "left_anti")
    bucket = F.pmod(F.xxhash64(key), F.lit(256))
    n = F.row_number().over(Window.partitionBy(bucket).orderBy(key)) - 1
    return rest.withColumn("batch", F.concat_ws("-", bucket.cast("string"), F.floor(n / batch).cast("string")))


def renamed(ids: DataFrame, mapping: DataFrame, existing: DataFrame) -> DataFrame:
    """ids(id, at) under new names by mapping(id, new_id): the first of those that share a new name gets it, unless it exists."""
    free = mapping.join(existing.select(F.col("id").alias("new_id")), "new_id", "left_anti").join(ids.select("id", "at"), "id")
    rank = F.row_number().over(Window.partitionBy("new_id").orderBy("at"))
    first = free.withColumn("_n", rank).where("_n = 1").select("id", "new_id")
    return ids.join(first, "id", "left").select("id", F.coalesce("new_id", "id").alias("new_id"), F.col("new_id").isNotNull().alias("renamed"))


def namespace_fixpoint(compound_hits: DataFrame, equations: DataFrame, reference: DataFrame, passes: int | None = None) -> DataFrame:
    """Compound translations (compound, entity) to a fixpoint.

    A start are compounds with one strong hit. In each pass reactions all of whose compounds but one are translated are
    matched to reference reactions; the last compound then takes what the match leaves over, unless another takes the same
    one: then none does. Passes end when one adds nothing, or after `passes` if that is given. equations(reaction, compound, coefficient), reference(entity_reaction, entity, coefficient)."""
    from quillon.sources.sinks import stored

    strong = compound_hits.where("strong").groupBy("compound").agg(F.count("*").alias("n"), F.first("entity").alias("entity")).where("n = 1").select("compound", "entity")
    known = stored(strong)
    size = reference.groupBy("entity_reaction").agg(F.count("*").alias("n_entity"))
    own = equations.groupBy("reaction").agg(F.count("*").alias("n"))
    done = 0
    while passes is None or done < passes:
        done += 1
        open_ = equations.join(known, "compound", "left").join(own, "reaction")
        matched = open_.where("entity is not null").join(reference, ["entity", "coefficient"]).groupBy("reaction", "entity_reaction", "n").agg(F.count("*").alias("same")).where("same = n - 1").join(size, "entity_reaction").where("n_entity = n")
        one = matched.groupBy("reaction").agg(F.count("*").alias("k"), F.first("entity_reaction").alias("entity_reaction")).where("k = 1")
        left = open_.where("entity is null").select("reaction", "compound", "coefficient").join(one.select("reaction", "entity_reaction"), "reaction").join(reference, ["entity_reaction", "coefficient"])
        fresh = left.join(known.select("entity"), "entity", "left_anti").groupBy("compound").agg(F.countDistinct("entity").alias("k"), F.first("entity").alias("entity")).where("k = 1").select("compound", "entity").join(known, "compound", "left_anti")
        alone = fresh.groupBy("entity").agg(F.count("*").alias("k")).where("k = 1").select("entity")
        fresh = stored(fresh.join(alone, "entity").select("compound", "entity"))
        if fresh.isEmpty():
            break
        known = stored(known.unionByName(fresh))
    return known
