"""Column functions of the annotation and scoring rules. All stay inside the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: Pfam families that bind DNA; the candidate and the role rules each have their own set
DNA_BINDING_CANDIDATE = ("PF00126", "PF00196", "PF00325", "PF00356", "PF00376", "PF00392", "PF00440", "PF01022", "PF01047", "PF01381", "PF03466", "PF04542", "PF04545", "PF12833")
DNA_BINDING_ROLE = ("PF00126", "PF00158", "PF00196", "PF00325", "PF00356", "PF00376", "PF00392", "PF00440", "PF01022", "PF01047", "PF01381", "PF02954", "PF04542", "PF04545", "PF12833")
# three-letter amino acids
RESIDUES = {"ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I", "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V"}
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}
# end of fixed values


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strings(values: Sequence[str]) -> Column:
    return F.lit(list(values)) if values else F.array().cast("array<string>")


def first_filled(*columns: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def position(index: Column | str) -> Column:
    i = col(index)
    return F.when(i < 0, "upstream").when(i > 0, "downstream").otherwise("internal")


def distance_nt(start: Column | str, stop: Column | str) -> Column:
    return F.least(F.abs(col(start)), F.abs(col(stop)))


def proximity(index: Column | str) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.abs(col(index)))


def only(values: Column, allowed: Sequence[str]) -> Column:
    """The members of an array that are allowed, in their order."""
    return F.filter(values, lambda x: x.isin(*allowed))


def all_in(required: Sequence[str], values: Column) -> Column:
    return F.size(F.array_except(strings(required), values)) == 0


def regulator_domain_score(pfams: Column, regulator_class: Column) -> Column:
    return (
        F.when(regulator_class == "none", 0.0)
        .when(F.arrays_overlap(pfams, strings(DNA_BINDING_CANDIDATE)), 1.0)
        .when(regulator_class.isin("two_component_rr", "two_component_hk", "sigma54_activator"), 0.75)
        .otherwise(0.25)
    )


def regulator_class(pfams: Column, rules: Sequence[Mapping]) -> Column:
    """The class of the best rule that holds: rules score 2 plus 0.5 for each optional family, built-in seeds score 1;
    earlier rules win ties. Written as one ``greatest`` over literal rules, so no join and no function call."""

    def choice(score: Column, priority: int, name: str) -> Column:
        return F.struct(score.cast("double").alias("score"), F.lit(priority).alias("priority"), F.lit(name).alias("class"))

    def any_of(*ids: str) -> Column:
        return F.arrays_overlap(pfams, strings(ids))

    options = [
        F.when(any_of("PF00072"), choice(F.lit(1.0), 10, "two_component_rr")),
        F.when(any_of("PF00512", "PF02518"), choice(F.lit(1.0), 9, "two_component_hk")),
        F.when(any_of("PF04542", "PF04545"), choice(F.lit(1.0), 8, "sigma")),
    ]
    for k, rule in enumerate(rules):
        extra = F.size(F.array_intersect(strings(rule.get("pfam_optional") or []), pfams))
        options.append(F.when(all_in(rule["pfam_required"], pfams), choice(2.0 + 0.5 * extra, 100 - k, rule["class"])))
    return F.coalesce(F.greatest(*options)["class"], F.lit("none"))


def regulator_class_of_text(product: Column) -> Column:
    p = F.lower(F.coalesce(product, F.lit("")))

    def has(*parts: str) -> Column:
        return reduce(lambda a, b: a | b, (p.contains(x) for x in parts))

    return (
        F.when(has("anti-sigma", "antisigma"), "anti_sigma")
        .when(has("sigma factor", "rna polymerase sigma"), "sigma")
        .when(has("response regulator"), "two_component_rr")
        .when(has("histidine kinase", "sensor kinase", "hybrid sensor"), "two_component_hk")
        .when(has("dna-binding transcriptional", "transcriptional regulator", "transcriptional repressor", "transcriptional activator"), "one_component")
        .otherwise("none")
    )


def evidence_terms(*values: Column) -> Column:
    """Lower-case set of whole strings; give single strings as one-element arrays."""
    return F.array_distinct(F.transform(F.concat(*(F.coalesce(v, F.array().cast("array<string>")) for v in values)), lambda x: F.lower(x)))


def rule_fires(rule: Mapping, pfams: Column, terms: Column, kingdom: Column) -> Column:
    holds = all_in(rule.get("if_pfam_all") or [], pfams)
    if rule.get("if_co_pfam_any"):
        holds &= F.arrays_overlap(pfams, strings(rule["if_co_pfam_any"]))
    if rule.get("if_motif_any"):
        holds &= F.arrays_overlap(terms, strings(sorted({m.lower() for m in rule["if_motif_any"]})))
    if rule.get("if_organism_kingdom") is not None:
        holds &= F.lower(F.coalesce(kingdom, F.lit(""))) == rule["if_organism_kingdom"].lower()
    return holds


def chemistries(pfams: Column, catalog: Sequence[Mapping], rules: Sequence[Mapping], domains: Column | None = None, terms: Column | None = None, kingdom: Column | None = None) -> Column:
    """Sorted distinct chemistries of sensors in the catalog, by Pfam id and by domain name, and of rules that fire."""
    by_pfam = {e["pfam_id"]: e for e in catalog}
    by_name = {e["domain"]: e for e in catalog}

    def looked_up(values: Column, entries: Mapping[str, Mapping]) -> Column:
        known = {k: e["chemistry"] for k, e in entries.items() if e["role"] == "sensor" and e["chemistry"] != "none"}
        if not known:
            return F.array().cast("array<string>")
        pairs = F.create_map(*(F.lit(x) for item in sorted(known.items()) for x in item))
        return F.array_compact(F.transform(values, lambda x: pairs[x]))

    empty = F.array().cast("array<string>")
    parts = [looked_up(pfams, by_pfam)]
    if domains is not None:
        parts.append(looked_up(domains, by_name))
    fired = [F.when(rule_fires(r, pfams, terms if terms is not None else empty, kingdom if kingdom is not None else F.lit("")), F.lit(r["chemistry"])) for r in rules]
    if fired:
        parts.append(F.array_compact(F.array(*fired)))
    return F.array_sort(F.array_distinct(F.concat(*parts)))


def sensor_role(is_anchor: Column, inferred_class: Column, evidence: Column, annotated: Column) -> Column:
    regulator = inferred_class != "none"
    return (
        F.when(is_anchor, "anchor")
        .when((inferred_class == "two_component_hk") & evidence, "sensor")
        .when(evidence & regulator, "both")
        .when(regulator, "regulator")
        .when(evidence, "sensor")
        .when(annotated, "accessory")
        .otherwise("none")
    )


def weighted_sum(weights: Mapping[str, float], components: Mapping[str, str], available: Sequence[str]) -> Column:
    """Sum of weight * component; null or absent components count as 0; a weighted unknown name is an error."""
    total = F.lit(0.0)
    for name, weight in weights.items():
        if name not in components:
            if weight:
                raise ValueError(f"no component for score weight {name}")
            continue
        if components[name] in available:
            total = total + F.coalesce(F.col(components[name]).cast("double"), F.lit(0.0)) * float(weight)
    return total


def enrichment_score(odds: Column, q: Column, cap: float, alpha: float = 0.05) -> Column:
    return F.when((q <= alpha) & (odds > 1.0), F.least(F.log2(odds), F.lit(float(cap)))).otherwise(0.0)


def intergenic_distance(a_start: Column, a_stop: Column, b_start: Column, b_stop: Column) -> Column:
    return F.when(a_stop <= b_start, b_start - a_stop).when(b_stop <= a_start, a_start - b_stop).otherwise(F.lit(0).cast("long"))


def distance_bin(distance: Column) -> Column:
    return F.when(distance <= 250, "near").when(distance <= 1000, "mid").otherwise("far")


def sorted_label(values: Column) -> Column:
    label = F.array_join(F.array_sort(F.filter(values, lambda x: x != "")), "+")
    return F.when(label == "", "none").otherwise(label)


def safe_identifier(value: Column, mark: str = "_") -> Column:
    return F.regexp_replace(value, r"[^\p{L}\p{N}]", mark)


def logit_score(score: Column, midpoint: float = 6.0, scale: float = 2.0) -> Column:
    return F.greatest(F.lit(0.001), F.least(F.lit(0.999), F.lit(1.0) / (F.lit(1.0) + F.exp(-(score - midpoint) / scale))))


def reverse_complement(sequence: Column) -> Column:
    return F.reverse(F.translate(F.upper(sequence), "ACGTRYSWKMBDHVN", "TGCAYRSWMKVHDBN"))


def position_identity(a: Column, b: Column) -> Column:
    """Share of equal letters at equal positions over the shorter of two sequences, ``*`` removed; 0 if one is empty."""
    x, y = F.replace(a, F.lit("*"), F.lit("")), F.replace(b, F.lit("*"), F.lit(""))
    n = F.least(F.length(x), F.length(y))
    same = F.size(F.filter(F.zip_with(F.split(x, ""), F.split(y, ""), lambda p, q: p == q), lambda z: z))
    return F.when(n > 0, same / n).otherwise(0.0)


def length_coverage(a: Column, b: Column) -> Column:
    x, y = F.length(F.replace(a, F.lit("*"), F.lit(""))), F.length(F.replace(b, F.lit("*"), F.lit("")))
    return F.when(F.least(x, y) > 0, F.least(x, y) / F.greatest(x, y)).otherwise(0.0)


def percent_decoded(value: Column) -> Column:
    """Percent-decoding that leaves ``+`` alone."""
    return F.url_decode(F.replace(value, F.lit("+"), F.lit("%2B")))


def attributes(raw: Column, pair: str = ";", assign: str = "=") -> Column:
    """key=value;... as a map; ``.`` is empty; later keys win; an item without ``=`` is an error."""
    items = F.filter(F.transform(F.split(raw, f"[{pair}]"), lambda x: F.trim(x)), lambda x: x != "")
    entries = F.transform(
        items,
        lambda x: F.when(
            F.instr(x, assign) > 0,
            F.struct(percent_decoded(F.substring_index(x, assign, 1)).alias("k"), percent_decoded(F.substr(x, F.instr(x, assign) + 1)).alias("v")),
        ).otherwise(F.struct(F.raise_error(F.concat(F.lit("attribute without value: "), x)).cast("string").alias("k"), F.lit("").alias("v"))),
    )
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["k"] == e["k"]))
    return F.when((raw == ".") | raw.isNull(), F.create_map().cast("map<string,string>")).otherwise(F.map_from_entries(last))


def list_cell(cell: Column) -> Column:
    """``a|b`` as an array; ``[]`` and nothing are empty."""
    parts = F.filter(F.transform(F.split(F.coalesce(cell, F.lit("")), r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.trim(F.coalesce(cell, F.lit(""))) == "[]", F.array().cast("array<string>")).otherwise(parts)


def fraction(value: Column) -> Column:
    """A threshold given as 0-1 or 0-100, as a fraction."""
    return F.when(value > 1, value / 100).otherwise(value)
