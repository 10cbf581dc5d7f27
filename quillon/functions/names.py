"""Expressions over identifiers, names, roles and references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PUNCTUATION = r"[!-/:-@\[-`{-~\s]"


def standard(s: Column) -> Column:
    """An identifier for matching: marker words undone, then ASCII punctuation and white space deleted, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "_DASH_", "-"), "_COLON_", ":"), PUNCTUATION, ""))


#: Parts of compound names that don't tell compounds apart, in the order in which they go.
NAME_PARTS = (
    *[rf"(?iU)^{metal}\s+" for metal in ("Trisodium", "Disodium", "Sodium", "Tripotassium", "Dipotassium", "Potassium", "Calcium", "Magnesium", "Ammonium")],
    r"(?iU)\s+\w*hydrate\b",
    r"(?iU)\s+((mono|di|tri)?(sodium|potassium)\s+)?salt\b",
    r"(?iU)\s+(di)?hydrochloride\b",
    r"(?iU)\s+HCl\b",
    r"(?iU)\s+(mono|di|tri)basic\b",
)
#: How racemic names are written, and acids and their ions.
RACEMIC, FORMS = (r"(?i)D,L[-\s]?", r"(?i)DL[-\s]?"), ("L-", "D-", "")
IC_ACID, OUS_ACID, ATE = r"(?iU)ic\s+acid\b", r"(?iU)ous\s+acid\b", r"(?iU)ate\b"


def plain_name(s: Column) -> Column:
    """A compound name without metals in front, hydrates, salts, hydrochlorides and basicity."""
    out = F.trim(s)
    for part in NAME_PARTS:
        out = F.regexp_replace(out, part, "")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def name_variants(s: Column) -> Column:
    """The plain name, racemic ones also as either form and bare, acids also as ions and the other way round, and the name itself; shortest first, then by letters."""
    plain = plain_name(s)
    marks = (F.lower(plain).contains("d,l"), F.lower(plain).contains("dl-"))
    stereo = [F.when(mark, F.regexp_replace(plain, pattern, form)) for mark, pattern in zip(marks, RACEMIC) for form in FORMS]
    found = F.array_compact(F.array(plain, *stereo))
    acid = lambda v: F.when(v.rlike(IC_ACID), F.regexp_replace(v, IC_ACID, "ate")).when(v.rlike(ATE), F.regexp_replace(v, ATE, "ic acid"))
    found = F.concat(found, F.array_compact(F.transform(found, acid)))
    found = F.concat(found, F.array_compact(F.transform(found, lambda v: F.when(v.rlike(OUS_ACID), F.regexp_replace(v, OUS_ACID, "ite")))))
    kept = F.array_distinct(F.filter(F.concat(found, F.array(F.trim(s))), lambda x: x.isNotNull() & (x != "")))
    return F.transform(F.array_sort(F.transform(kept, lambda x: F.struct(F.length(x).alias("n"), x.alias("name")))), lambda x: x["name"])


def role_key(s: Column) -> Column:
    """A functional role for lookup: lower case, no white space, no EC numbers, nothing from # on, no brackets, commas, dashes."""
    out = F.regexp_replace(F.lower(s), r"\s", "")
    for part in (r"[\d\-]+\.[\d\-]+\.[\d\-]+\.[\d\-]*\d", "#.*$", r"\(ec:?\)", r"[()\[\],-]"):
        out = F.regexp_replace(out, part, "")
    return out


def functions_of(s: Column) -> Column:
    """The functions that one description lists."""
    return F.split(s, r"\s*;\s+|\s+[@/]\s+")


def parts_of(s: Column) -> Column:
    """A list separated by semicolons, commas or white space, without EC: marks and empties."""
    return F.transform(F.filter(F.split(s, r"[;,\s]+"), lambda x: x != ""), lambda x: F.regexp_replace(x, "(?i)^EC:", ""))


def tagged(tag: Column, term: Column, aliases: dict[str, str] | None = None) -> Column:
    """A term that begins with its ontology's tag, in upper case, other tags replaced."""
    table = F.create_map(*[F.lit(x) for pair in (aliases or {}).items() for x in pair]) if aliases else None
    up = F.upper(tag)
    clean = F.coalesce(F.try_element_at(table, up), up) if table is not None else up
    bare = F.when(F.upper(F.substring_index(term, ":", 1)).isin(*(aliases or {"": ""})) | (F.upper(F.substring_index(term, ":", 1)) == up), F.regexp_replace(term, "^[^:]*:", "")).otherwise(term)
    return F.concat(clean, F.lit(":"), bare)


def place(s: Column) -> Column:
    """(base, compartment, index) of an id such as x[c0] or x_c0; a bare id has compartment c and index 0."""
    shape = r"^(.+?)(?:\[([a-z])(\d*)\]|_([a-z])(\d*))$"
    letter = F.coalesce(F.nullif(F.regexp_extract(s, shape, 2), F.lit("")), F.nullif(F.regexp_extract(s, shape, 4), F.lit("")))
    index = F.concat(F.regexp_extract(s, shape, 3), F.regexp_extract(s, shape, 5))
    return F.struct(
        F.when(letter.isNull(), s).otherwise(F.regexp_extract(s, shape, 1)).alias("base"), F.coalesce(letter, F.lit("c")).alias("compartment"), F.coalesce(F.nullif(index, F.lit("")), F.lit("0")).alias("index")
    )


#: Compartment names and their letters.
COMPARTMENTS = {"cytosol": "c", "cytoplasm": "c", "extracellular": "e", "periplasm": "p", "mitochondria": "m", "mitochondrion": "m", "peroxisome": "x", "vacuole": "v", "nucleus": "n", "golgi": "g", "environment": "e"}


def compartment(s: Column) -> Column:
    """A compartment's letter, or the input where it is none of the known names."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in COMPARTMENTS.items() for x in pair]), F.lower(s)), s)


def exchange(s: Column) -> Column:
    """The id of a metabolite's exchange."""
    return F.concat(F.lit("EX_"), F.regexp_replace(F.regexp_replace(s, "^EX_", ""), r"(_e0?|\[e0?\])$", ""), F.lit("_e0"))


def reaction_id(s: Column, *more: Column) -> Column:
    """The first rxn number in an id, else in the further texts."""
    return F.coalesce(*[F.nullif(F.regexp_extract(x, r"rxn\d+", 0), F.lit("")) for x in (s, *more)])


def ec_prefix(s: Column) -> Column:
    """The first three levels of an EC number."""
    return F.array_join(F.slice(F.split(s, "[.]"), 1, 3), ".")


def ref(workspace: Column, obj: Column, version: Column | None = None) -> Column:
    return F.concat_ws("/", workspace.cast("string"), obj.cast("string"), *([version.cast("string")] if version is not None else []))


def is_ref(s: Column) -> Column:
    """workspace/object or workspace/object/version, in digits, or lists of these joined by semicolons."""
    return F.coalesce(s.rlike(r"^[0-9]+/[0-9]+(/[0-9]+)?(;[0-9]+/[0-9]+(/[0-9]+)?)*$"), F.lit(False))


def without_version(s: Column) -> Column:
    return F.substring_index(s, "/", 2)


def shown(s: Column, limit: int = 80) -> Column:
    """A value cut at `limit` characters, with what was cut noted."""
    return F.when(F.length(s) > limit, F.concat(F.substring(s, 1, limit), F.lit("... ("), (F.length(s) - limit).cast("string"), F.lit(" more)"))).otherwise(s)


def dot_escape(s: Column) -> Column:
    return F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def domain(taxonomy: Column) -> Column:
    """Archaea or Eukaryota by the first level of a lineage, else Bacteria."""
    first = F.lower(F.substring_index(taxonomy, ";", 1))
    return F.when(first.contains("archaea"), "Archaea").when(first.contains("eukaryot"), "Eukaryota").otherwise("Bacteria")


def scientific_name(taxonomy: Column) -> Column:
    """The last level of a lineage of x__name parts that has a name, or null."""
    names = F.filter(F.transform(F.split(taxonomy, ";"), lambda x: F.regexp_replace(F.trim(x), "^[a-z]__", "")), lambda x: x != "")
    return F.when(F.size(names) > 0, F.element_at(names, -1))


def event_id(method: Column, version: Column, ontology: Column, when: Column) -> Column:
    return F.concat_ws(":", method, version, ontology, when)


def label(s: Column, aliases: dict[str, str], known: list[str]) -> Column:
    """The label before a dash, by aliases, or Unknown if it isn't a known one."""
    first = F.lower(F.trim(F.split(s, r"\s*[-–—]\s*", 2)[0]))
    named = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair]), first), first) if aliases else first
    return F.when(named.isin(*known), named).otherwise("Unknown")
