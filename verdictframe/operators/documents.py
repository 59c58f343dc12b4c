"""Model-card checks: sections, disclosures, claims, contradictions and verdicts.

A card never leaves its row: the text is split into sections with one regular
expression and everything after that is an array expression, so no step here
shuffles card bodies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import contains_any, first_case, let, reasons, strip
from .ordering import latest

MIN_BODY = 20
_LINE_ENDS = ("\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029")

# Bodies that hub templates leave behind (after normalisation).
PLACEHOLDERS = ("more information needed", "n a", "na", "tbd", "to be determined", "coming soon", "none", "not available")

# Required and bonus documentation sections with their heading aliases.
REQUIRED_SECTIONS = ("intended_use", "limitations", "training_data", "evaluation", "ethical_considerations")
BONUS_SECTIONS = ("architecture", "citation", "examples")
SECTION_ALIASES = {
    "intended_use": ("intended use", "use cases", "direct use", "intended uses"),
    "limitations": ("limitations", "limitation", "out of scope", "out-of-scope", "known limitations", "bias", "risks",
                    "bias risks and limitations"),
    "training_data": ("training data", "training dataset", "training datasets", "datasets", "dataset"),
    "evaluation": ("evaluation", "evaluation results", "results", "metrics", "benchmark", "benchmarks"),
    "ethical_considerations": ("ethical considerations", "bias and risks", "broader impacts", "ethics",
                               "ethical considerations and caveats"),
    "architecture": ("architecture", "model architecture", "model description"),
    "citation": ("citation", "bibtex", "how to cite", "citing"),
    "examples": ("examples", "example usage", "usage examples", "how to use"),
}

# Required and bonus safety disclosures with their heading aliases.
REQUIRED_DISCLOSURES = ("misuse_risks", "privacy", "security_warnings", "data_disclosure")
BONUS_DISCLOSURES = ("bias_and_fairness_risks", "human_oversight")
DISCLOSURE_ALIASES = {
    "misuse_risks": ("misuse and malicious use", "malicious use", "known risks of abuse", "out of scope harms", "dual-use",
                     "dual use", "misuse"),
    "privacy": ("data protection", "personal data", "privacy", "gdpr", "pii"),
    "security_warnings": ("security considerations", "do not deploy", "adversarial", "vulnerability", "security"),
    "data_disclosure": ("training dataset", "training data", "data sources", "data license", "collection process",
                        "trained on", "datasets"),
    "bias_and_fairness_risks": ("bias and fairness", "fairness risks", "demographic bias"),
    "human_oversight": ("human in the loop", "human oversight", "human review"),
}

# Phrases of the contradiction, claim and reproducibility checks.
OPEN_CLAIMS = ("fully open", "completely open", "unlimited commercial use", "unrestricted commercial",
               "free for any commercial", "open for any use")
PRODUCTION_CLAIMS = ("production ready", "production-ready", "ready for production", "state of the art for all",
                     "state-of-the-art for all", "suitable for all uses", "works for every use case")
RESTRICTIVE_LICENSES = ("cc-by-nc", "cc by-nc", "non-commercial", "noncommercial", "gpl", "agpl", "proprietary", "llama",
                        "other", "unknown")
IMPACT_PHRASES = {
    "production_ready": ("production ready", "production-ready", "ready for production"),
    "healthcare": ("healthcare", "medical", "clinical"),
    "finance": ("finance", "financial", "banking"),
    "legal": ("legal advice", "legal decision"),
    "autonomous_decision": ("autonomous decision", "fully autonomous"),
    "biometric": ("biometric", "biometrics"),
}
REPRO_SIGNALS = {
    "training_data": ("training data", "trained on", "pretrain", "fine-tun", "dataset"),
    "seed": ("random seed", "seed=", "seed:", "torch.manual_seed", "numpy.random.seed"),
    "evaluation": ("evaluation", "benchmark", "metrics", "accuracy", "f1"),
    "hyperparameters": ("hyperparameter", "learning rate", "batch size", "epochs"),
}


def normalize_heading(c: Column) -> Column:
    """Lower case, punctuation to blanks, single blanks."""
    plain = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\s]+", " ")
    return strip(F.regexp_replace(plain, r"\s+", " "))


def nontrivial(body: Column, stripped: bool = False) -> Column:
    """At least 20 characters and not, after normalisation, a template placeholder.

    The placeholder test anchors at the first word, so a long body is left at once.
    """
    gap = r"[^\p{L}\p{N}_]"
    options = "|".join(p.replace(" ", gap + "+") for p in PLACEHOLDERS)
    pattern = rf"(?i)^{gap}*(?:{options}){gap}*$"
    if stripped:
        return (F.length(body) >= MIN_BODY) & ~body.rlike(pattern)
    return let(strip(F.coalesce(body, F.lit(""))), lambda b: (F.length(b) >= MIN_BODY) & ~b.rlike(pattern))


def _unix_lines(plain: Column) -> Column:
    odd = contains_any(plain, _LINE_ENDS)  # rare, so the replacement pass is skipped for most cards
    return F.when(odd, F.regexp_replace(plain, "\r\n|[" + "".join(_LINE_ENDS) + "]", "\n")).otherwise(plain)


def sections(text: Column) -> Column:
    """array<struct<heading, body>>: lines of 1-3 '#' start a section, the first of equal headings wins."""
    head = r"#{1,3}[^\S\n][^\n]"

    def section(p: Column) -> Column:
        return let(F.substring_index(p, "\n", 1), lambda line: F.struct(
            strip(F.regexp_extract(line, r"^#{1,3}[^\S\n]+([^\n]*)", 1)).alias("heading"),
            strip(F.substr(p, F.length(line) + 2)).alias("body")))

    def parse(unix: Column) -> Column:
        # only first lines meet a regular expression once the text is cut
        cut = F.split(unix, rf"(?md)^(?={head})")
        return F.transform(F.filter(cut, lambda p: F.substring_index(p, "\n", 1).rlike(rf"^{head}")), section)

    def first_wins(all_: Column) -> Column:
        return let(F.transform(all_, lambda s: s["heading"]),
                   lambda names: F.filter(all_, lambda s, i: F.array_position(names, s["heading"]) == i + 1))

    parsed = let(F.coalesce(text, F.lit("")), lambda plain: parse(_unix_lines(plain)))
    return let(parsed, first_wins)


def split_sections(cards: DataFrame, key: str, text: str = "card_text") -> DataFrame:
    """One row per section in card order."""
    return cards.select(key, F.posexplode(sections(F.col(text))).alias("position", "s")).select(
        key, "position", F.col("s.heading").alias("heading"), F.col("s.body").alias("body"))


def match_alias(heading: Column, aliases: dict[str, tuple[str, ...]]) -> Column:
    """Key whose longest alias occurs in the normalised heading; the earlier key wins ties."""
    ranked = sorted(
        ((alias, key, i) for i, (key, names) in enumerate(aliases.items()) for alias in names),
        key=lambda t: (-len(t[0]), t[2]))
    return let(heading, lambda h: first_case(*[(h.contains(alias), key) for alias, key, _ in ranked]))


def present_sections(text: Column, aliases: dict[str, tuple[str, ...]], fallbacks: dict[str, list[tuple[str, Column]]]) -> Column:
    """array<struct<key, present, matched_heading>> over all keys, structured fields as fallback."""
    found = F.transform(
        F.filter(sections(text), lambda s: nontrivial(s["body"], stripped=True)),
        lambda s: F.struct(match_alias(normalize_heading(s["heading"]), aliases).alias("key"), s["heading"].alias("heading")))

    def first_of(hits: Column, key: str) -> Column:
        return F.get(F.filter(hits, lambda h: h["key"] == key), F.lit(0))["heading"]

    def rows(hits: Column) -> Column:
        out = []
        for key in aliases:
            own = first_of(hits, key)
            field = F.coalesce(*[F.when(cond, F.lit(f"card_data.{name}")) for name, cond in fallbacks.get(key, [])], F.lit(None).cast("string"))
            matched = F.coalesce(own, field)
            out.append(F.struct(F.lit(key).alias("key"), matched.isNotNull().alias("present"), matched.alias("matched_heading")))
        return F.array(*out)

    return let(found, rows)


def presence_rows(cards: DataFrame, key: str, aliases: dict, fallbacks: dict, text: str = "card_text") -> DataFrame:
    """(card, section key, present, matched heading), one row per card and key."""
    return cards.select(key, F.inline(present_sections(F.col(text), aliases, fallbacks)))


def _count_present(found: Column, keys: tuple[str, ...]) -> Column:
    return F.size(F.filter(found, lambda f: f["present"] & f["key"].isin(*keys)))


def _missing(found: Column, keys: tuple[str, ...]) -> Column:
    return F.transform(F.filter(found, lambda f: ~f["present"] & f["key"].isin(*keys)), lambda f: F.concat(F.lit("missing_"), f["key"]))


def families(text: Column, groups: dict[str, tuple[str, ...]]) -> Column:
    """Names of the phrase families with at least one phrase in the text."""
    return let(F.lower(text), lambda low: reasons(*[(contains_any(low, words), name) for name, words in groups.items()]))


def _license(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def contradiction_flags(text: Column, license_: Column, limitations_present: Column) -> Column:
    body = strip(F.coalesce(text, F.lit("")))
    lic = F.lower(_license(license_))
    restricted = F.coalesce(contains_any(lic, RESTRICTIVE_LICENSES), F.lit(True))
    flags = let(F.lower(body), lambda low: reasons(
        (contains_any(low, OPEN_CLAIMS) & restricted, "open_claim_vs_restrictive_license"),
        (contains_any(low, PRODUCTION_CLAIMS) & ~limitations_present, "no_limitations_but_production_claim")))
    return F.when(F.length(body) == 0, F.array(F.lit("empty_card"))).otherwise(flags)


def documentation_verdict(cards: DataFrame, key: str, fallbacks: dict, text: str = "card_text", license_: str = "license") -> DataFrame:
    """Documentation completeness and contradictions per card; an empty card abstains."""
    body = strip(F.coalesce(F.col(text), F.lit("")))
    src = cards.withColumn("_body", body).select(
        key, "_body", F.col(license_).alias("_lic"), present_sections(F.col("_body"), SECTION_ALIASES, fallbacks).alias("_found"))
    n = len(REQUIRED_SECTIONS)
    present = _count_present(F.col("_found"), REQUIRED_SECTIONS)
    limits = F.exists("_found", lambda f: f["present"] & (f["key"] == "limitations"))
    src = src.withColumn("sections_present", present).withColumn(
        "contradictions", contradiction_flags(F.col("_body"), F.col("_lic"), limits))
    empty = F.length("_body") == 0
    k = F.col("sections_present")
    risky = (F.size("contradictions") > 0) & ~empty
    ratio_ = F.round(k / F.lit(float(n)), 4)
    return src.select(
        key, F.length("_body").alias("card_chars"),
        F.when(empty, "INSUFFICIENT_EVIDENCE").otherwise("EVALUATED").alias("status"),
        F.when(empty, 0).otherwise(k).alias("sections_present"), F.when(empty, 0.0).otherwise(ratio_).alias("coverage_ratio"),
        first_case((empty, "not_scored"), (risky, "risk_detected"), (k < n, "disclosure_gap"), default="no_material_risk").alias("aspect_scoring"),
        F.when(risky, "E-DOC-CONTRADICTION").alias("risk"), F.when(~empty & (k < n), "E-DOC-INCOMPLETE").alias("gap"),
        F.when(empty, "G-EXP-CARD-EMPTY").alias("failed_gate"), "contradictions",
        F.when(empty, F.array(F.lit("empty_card"))).otherwise(F.concat(
            _missing(F.col("_found"), REQUIRED_SECTIONS), F.col("contradictions"),
            reasons((ratio_ < 0.6, "needs_human_review")))).alias("flags"))


def disclosure_verdict(cards: DataFrame, key: str, fallbacks: dict, text: str = "card_text") -> DataFrame:
    """Safety-disclosure completeness and high-impact phrases per card."""
    body = strip(F.coalesce(F.col(text), F.lit("")))
    src = cards.withColumn("_body", body).select(
        key, "_body", present_sections(F.col("_body"), DISCLOSURE_ALIASES, fallbacks).alias("_found"),
        families(F.col("_body"), IMPACT_PHRASES).alias("high_impact_claims"))
    n = len(REQUIRED_DISCLOSURES)
    src = src.withColumn("checks_present", _count_present(F.col("_found"), REQUIRED_DISCLOSURES))
    empty, k = F.length("_body") == 0, F.col("checks_present")
    ratio_ = F.round(k / F.lit(float(n)), 4)
    phrases = F.size("high_impact_claims") > 0
    return src.select(
        key, F.length("_body").alias("card_chars"),
        F.when(empty, "INSUFFICIENT_EVIDENCE").otherwise("EVALUATED").alias("status"),
        F.when(empty, 0).otherwise(k).alias("checks_present"), F.when(empty, 0.0).otherwise(ratio_).alias("coverage_ratio"),
        first_case((empty, "not_scored"), (k < n, "disclosure_gap"), default="no_material_risk").alias("aspect_scoring"),
        F.when(~empty & (k < n), "S-GOV-DISCLOSURE-GAP").alias("gap"), F.when(empty, "G-SAFE-CARD-EMPTY").alias("failed_gate"),
        "high_impact_claims",
        F.when(empty, F.array(F.lit("empty_card"))).otherwise(F.concat(
            _missing(F.col("_found"), REQUIRED_DISCLOSURES),
            reasons((phrases, "high_impact_deployment_claim"), (phrases & (ratio_ < 1.0), "high_impact_without_full_disclosure"),
                    ((ratio_ < 1.0) | phrases, "needs_human_review")))).alias("flags"))


def reproducibility(cards: DataFrame, key: str, text: str = "card_text", minimum: int = 2) -> DataFrame:
    """Reproducibility signal families; at least two pass."""
    fam = families(strip(F.coalesce(F.col(text), F.lit(""))), REPRO_SIGNALS)
    return cards.select(key, fam.alias("signal_groups")).withColumn("passes", F.size("signal_groups") >= minimum)


def refresh_sources(existing: DataFrame, fetched: DataFrame, model: str = "model", origin: str = "origin") -> DataFrame:
    """Documentation registry after a refresh: the automatic row of a fetched model is replaced, others stay."""
    stale = existing.join(fetched.select(model).distinct(), model, "left_semi").filter(F.col(origin) == "auto")
    kept = existing.join(stale.select(model, origin).distinct(), [model, origin], "left_anti")
    return kept.unionByName(latest(fetched, [model], ["retrieved_at"]))
