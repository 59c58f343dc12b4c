"""Rater agreement, plurality answers and comparison of evaluators.

Pairs are never materialised: pair counts follow from value counts, and squared
differences from sums.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import first_case, hash_rank, ratio, reasons, strip
from .ordering import hash_ranks

SEVERITY_TOLERANCE = 2
MIN_KAPPA_ITEMS = 8


def melt_form(form: DataFrame, ids: list[str], questions: list[str], rater: str, submitted: str, shared_code: str | None = None) -> DataFrame:
    """Wide answers to long rows; a shared rater code is numbered by submission order per item.

    The severity answer counts only through its leading digit.
    """
    src = form
    if shared_code is not None:
        order = W.partitionBy(*ids, rater).orderBy(submitted)  # the few answers of one item
        src = src.withColumn("_k", F.row_number().over(order)).withColumn(
            rater, F.when(F.col(rater) == shared_code, F.concat_ws("-", F.col(rater), F.col("_k").cast("string"))).otherwise(F.col(rater))).drop("_k")
    return src.unpivot([F.col(c) for c in (*ids, rater)], [F.col(q) for q in questions], "question", "answer").withColumn(
        "answer", F.upper(strip("answer")))


def leading_digit(c: Column) -> Column:
    return F.try_to_number(F.nullif(F.regexp_extract(c, r"^([0-9])", 1), F.lit("")), F.lit("9")).cast("int")


def counts(df: DataFrame, item: list[str], value: str) -> DataFrame:
    """Answers per item and category: the table every agreement measure starts from."""
    return df.filter(F.col(value).isNotNull()).groupBy(*item, F.col(value).alias("category")).agg(F.count("*").alias("c"))


def plurality(df: DataFrame, item: list[str], value: str) -> DataFrame:
    """Most frequent answer per item, ties spelled out, with its count and the number of answers."""
    per = counts(df, item, value)
    # categories are few; only the names tied at the top are gathered
    top = per.groupBy(*item).agg(F.max("c").alias("top_n"), F.sum("c").alias("n"))
    tied = per.join(top, item).filter(F.col("c") == F.col("top_n")).groupBy(*item).agg(
        F.array_sort(F.collect_set("category")).alias("_w"), F.first("top_n").alias("top_n"), F.first("n").alias("n"))
    name = F.when(F.size("_w") == 1, F.get("_w", F.lit(0))).otherwise(F.concat(F.lit("TIE("), F.array_join("_w", "/"), F.lit(")")))
    return tied.select(*item, name.alias("majority"), "top_n", "n")


def pair_agree(df: DataFrame, item: list[str], value: str) -> DataFrame:
    """Share of agreeing answer pairs per item."""
    return counts(df, item, value).groupBy(*item).agg(F.sum("c").alias("m"), F.sum(F.col("c") * (F.col("c") - 1)).alias("_a")).select(
        *item, "m", ratio(F.col("_a"), F.col("m") * (F.col("m") - 1)).alias("agreement"), (F.col("_a") == F.col("m") * (F.col("m") - 1)).alias("unanimous"))


def fleiss(df: DataFrame, by: list[str], item: list[str], value: str, min_items: int = 0, degenerate: float | None = None) -> DataFrame:
    """Fleiss' kappa over the complete items (those with the largest number of answers)."""
    per = counts(df, [*by, *item], value)
    sizes = per.groupBy(*by, *item).agg(F.sum("c").alias("k"), F.sum(F.col("c") * F.col("c")).alias("_sq"))
    full = sizes.groupBy(*by).agg(F.max("k").alias("k"))
    complete = sizes.join(full, [*by, "k"]) if by else sizes.join(F.broadcast(full), "k")
    k = F.col("k").cast("double")
    pbar = complete.groupBy(*by).agg(F.count("*").alias("n_items"), F.first("k").alias("n_raters"),
                                     F.avg((F.col("_sq") - k) / F.when(k > 1, k * (k - 1))).alias("_pbar"))
    shares = per.join(complete.select(*by, *item), [*by, *item]).groupBy(*by, "category").agg(F.sum("c").alias("_c"))
    pe = shares.groupBy(*by).agg((F.sum(F.col("_c").cast("double") * F.col("_c")) / (F.sum("_c").cast("double") * F.sum("_c"))).alias("_pe"))
    j = pbar.join(pe, by) if by else pbar.join(F.broadcast(pe))
    sure = F.abs(F.col("_pe") - 1.0) < 1e-12
    kappa = F.when(sure, F.lit(degenerate).cast("double")).otherwise((F.col("_pbar") - F.col("_pe")) / F.when(~sure, 1.0 - F.col("_pe")))
    return j.select(*by, "n_items", "n_raters", F.when((F.col("n_items") >= min_items) & (F.col("n_raters") > 1), kappa).alias("kappa"))


def cohen(pairs: DataFrame, by: list[str], a: str, b: str, min_items: int = MIN_KAPPA_ITEMS) -> DataFrame:
    """Cohen's kappa of two answer columns; NULL for few items or chance agreement of one."""
    cell = pairs.groupBy(*by, F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.count("*").alias("_n"))
    po = cell.groupBy(*by).agg(F.sum("_n").alias("n"), F.sum(F.when(F.col("_a") == F.col("_b"), F.col("_n")).otherwise(0)).alias("_same"))
    ma = cell.groupBy(*by, F.col("_a").alias("cat")).agg(F.sum("_n").alias("_na"))
    mb = cell.groupBy(*by, F.col("_b").alias("cat")).agg(F.sum("_n").alias("_nb"))
    pe = ma.join(mb, [*by, "cat"]).groupBy(*by).agg(F.sum(F.col("_na") * F.col("_nb")).alias("_e"))
    j = po.join(pe, by, "left") if by else po.join(F.broadcast(pe), how="left")
    p_o, p_e = F.col("_same") / F.col("n"), F.coalesce("_e", F.lit(0)) / (F.col("n") * F.col("n"))
    ok = (F.col("n") >= min_items) & (p_e != 1.0)
    return j.select(*by, "n", F.when(ok, F.round((p_o - p_e) / F.when(p_e != 1.0, 1.0 - p_e), 4)).alias("kappa"))


def rater_pairs(df: DataFrame, by: list[str], item: list[str], rater: str, value: str) -> DataFrame:
    """by, item, rater_a, rater_b, a, b: the answers of every two raters to an item, the smaller name first.

    Only the answers of one panel meet; summed cells of the pairs leave the map side, as :func:`cohen` groups them.
    """
    panel = df.groupBy(*by, *item).agg(F.array_sort(F.collect_list(F.struct(F.col(rater).alias("r"), F.col(value).alias("x")))).alias("_p"))
    two = F.flatten(F.transform("_p", lambda a, i: F.transform(F.slice("_p", i + 2, F.size("_p")), lambda b: F.struct(
        a["r"].alias("rater_a"), b["r"].alias("rater_b"), a["x"].alias("a"), b["x"].alias("b")))))
    return panel.select(*by, *item, F.inline(two))


def kripp_interval(df: DataFrame, by: list[str], item: list[str], value: str) -> DataFrame:
    """Krippendorff's alpha for interval data from sums only; items with fewer than two values drop out."""
    v = F.col(value).cast("double")
    unit = df.filter(v.isNotNull()).groupBy(*by, *item).agg(F.count("*").alias("m"), F.sum(v).alias("s"), F.sum(v * v).alias("q")).filter("m >= 2")
    within = 2.0 * (F.col("m") * F.col("q") - F.col("s") * F.col("s")) / (F.col("m") - 1)
    agg = unit.groupBy(*by).agg(F.count("*").alias("units"), F.sum("m").alias("n"), F.sum(within).alias("_w"), F.sum("s").alias("_s"), F.sum("q").alias("_q"))
    n = F.col("n").cast("double")
    do = F.col("_w") / n
    de = 2.0 * (n * F.col("_q") - F.col("_s") * F.col("_s")) / F.when(n > 1, n * (n - 1))
    return agg.select(*by, "units", "n", F.when(de > 0, 1.0 - do / F.when(de > 0, de)).alias("alpha"))


def closeness(df: DataFrame, by: list[str], item: list[str], value: str) -> DataFrame:
    """Pairs of severities that are equal, within one and within two steps, from value counts."""
    hist = counts(df, [*by, *item], value)
    # severity has nine values, so an item contributes at most nine rows to each side
    other = hist.select(*by, *item, (F.col("category")).alias("_v2"), F.col("c").alias("_c2"))
    j = hist.join(other, [*by, *item]).filter(F.col("category") <= F.col("_v2"))
    pairs = F.when(F.col("category") == F.col("_v2"), F.col("c") * (F.col("c") - 1) / 2).otherwise(F.col("c") * F.col("_c2"))
    gap = F.col("_v2") - F.col("category")
    agg = j.groupBy(*by).agg(F.sum(pairs).cast("bigint").alias("n_pairs"), *[
        F.sum(F.when(gap <= d, pairs).otherwise(0)).alias(f"_w{d}") for d in (0, 1, 2)])
    return agg.select(*by, "n_pairs", *[ratio(F.col(f"_w{d}"), F.col("n_pairs")).alias(n) for d, n in ((0, "exact"), (1, "within1"), (2, "within2"))])


def value_range(df: DataFrame, item: list[str], value: str) -> DataFrame:
    return df.filter(F.col(value).isNotNull()).groupBy(*item).agg(F.min(value).alias("low"), F.max(value).alias("high"))


def contradictions(risk: Column, severity: Column) -> Column:
    """Contradictions inside one answer."""
    return first_case(((risk == "YES") & severity.isNull(), "risk_without_severity"),
                      ((risk != "YES") & severity.isNotNull(), "severity_without_risk"))


def rater_qc(df: DataFrame, rater: str, text: str, inconsistency: Column, matches: Column) -> DataFrame:
    """Median and short texts, contradictions and matches per rater."""
    return df.groupBy(rater).agg(
        F.count("*").alias("n"), F.median(F.length(text)).alias("median_chars"), F.count_if(F.length(text) <= 10).alias("short_answers"),
        F.count(inconsistency).alias("contradictions"), F.count_if(matches).alias("matches"))


def vs_reference(answers: DataFrame, reference: DataFrame, item: list[str], min_severities: int = 3) -> DataFrame:
    """Plurality against a reference answer with every kind of disagreement.

    ``answers``: item + q1 (sufficient), q2 (risk), q3 (dimension), severity;
    ``reference``: item + ref_sufficient, ref_risk, ref_dimension, ref_severity.
    """
    parts = [plurality(answers, item, q).select(*item, F.col("majority").alias(q)) for q in ("q1", "q2", "q3")]
    counted = F.when(F.col("q2") == "YES", F.col("severity"))
    sev = answers.groupBy(*item).agg(F.count(counted).alias("_k"), F.median(counted).alias("_med"))
    j = reduce(lambda a, b: a.join(b, item), [*parts, sev, reference])
    med = F.when(F.col("_k") >= min_severities, F.col("_med"))
    both_yes = (F.col("q2") == "YES") & (F.col("ref_risk") == "YES")
    flags = reasons(
        ((F.col("q1") != F.col("ref_sufficient")) | ((F.col("q2") == "UNCERTAIN") != (F.col("ref_risk") == "UNCERTAIN")), "insufficient_evidence"),
        (((F.col("q2") == "YES") & (F.col("ref_risk") == "NO")) | ((F.col("q2") == "NO") & (F.col("ref_risk") == "YES")), "risk_no_risk"),
        (both_yes & (F.col("q3") != F.col("ref_dimension")), "classification"),
        (both_yes & (F.abs(med - F.col("ref_severity")) >= SEVERITY_TOLERANCE), "severity"))
    return j.select(*item, "q1", "q2", "q3", med.alias("median_severity"), flags.alias("disagreements"))


def leave_one_out(df: DataFrame, item: list[str], rater: str, value: str) -> DataFrame:
    """Items whose plurality changes when one rater is left out.

    Removing a rater lowers one category count by one, so the counts decide without
    recomputing the plurality for every rater.
    """
    per = counts(df, item, value)
    base = plurality(df, item, value).select(*item, "majority", "top_n")
    shape = per.join(base.select(*item, "top_n"), item).groupBy(*item).agg(
        F.count_if(F.col("c") == F.col("top_n")).alias("_tied"), F.count_if(F.col("c") == F.col("top_n") - 1).alias("_next"), F.max("top_n").alias("_t"))
    # a tie always changes (one of its members loses a vote); a single winner changes when it loses
    # a vote and meets a category that is one behind
    unstable = ((F.col("_tied") > 1) & (F.col("_t") > 0)) | ((F.col("_tied") == 1) & (F.col("_next") > 0))
    return base.join(shape, item).select(*item, "majority", unstable.alias("unstable"))


def themes(df: DataFrame, by: list[str], text: str, patterns: dict[str, str]) -> DataFrame:
    """Texts that match each named pattern and the number of matches."""
    aggs = []
    for name, rx in patterns.items():
        aggs += [F.count_if(F.col(text).rlike(rx)).alias(f"{name}_texts"), F.sum(F.regexp_count(text, F.lit(rx))).alias(f"{name}_matches")]
    return df.groupBy(*by).agg(*aggs)


def validate_reviews(reviews: DataFrame, id_pattern: str, dimensions: list[str]) -> DataFrame:
    """Review rows that break the form, with every error."""
    tri = ("YES", "NO", "UNCERTAIN")
    sev = F.col("severity")
    bad = lambda c: F.coalesce(~c, F.lit(True))
    errs = reasons(
        (bad(F.col("packet_id").rlike(id_pattern)), "packet_id"), (bad(F.col("risk_present").isin(*tri)), "risk_present"),
        (bad(F.col("dimension").isin(*dimensions)), "dimension"), (bad(F.col("evidence_sufficient").isin(*tri)), "evidence_sufficient"),
        (sev.isNotNull() & ~sev.between(1, 9), "severity_range"), ((F.col("risk_present") == "NO") & sev.isNotNull(), "severity_without_risk"),
        (F.coalesce(F.length(strip("rationale")), F.lit(0)) == 0, "rationale"))
    return reviews.withColumn("errors", errs).filter(F.size("errors") > 0)


def _gap2(a: Column, b: Column) -> Column:
    return F.coalesce(F.abs(a - b) >= SEVERITY_TOLERANCE, F.lit(False))


def categorize(pairs: DataFrame) -> DataFrame:
    """Category and layer of the first disagreement between two evaluators on a packet.

    Columns a_*/b_*: risk, dimension, sufficient, severity; ``b_failure``: none, missing or unparsed.
    """
    ra, rb, sa, sb = F.col("a_risk"), F.col("b_risk"), F.col("a_sufficient"), F.col("b_sufficient")
    abst = (ra == "UNCERTAIN") != (rb == "UNCERTAIN")
    suff = (sa != sb) & ((sa == "NO") | (sb == "NO"))
    other_dim = (ra == "YES") & (rb == "YES") & (F.col("a_dimension") != F.col("b_dimension"))
    sev = _gap2(F.col("a_severity"), F.col("b_severity"))
    fail = F.col("b_failure")
    return pairs.withColumn("category", first_case(
        (fail == "missing", "provider_infrastructure"), (fail == "unparsed", "parser_format"), (abst, "abstention_mismatch"), (suff, "insufficient_evidence"),
        (other_dim, "localization"), (ra != rb, "evidence_interpretation"), (sev, "severity"), default="agree")).withColumn("layer", first_case(
            (fail != "none", None), (abst | suff, "evidence"), ((ra != rb) | other_dim, "risk"), (sev, "score")))


def evaluator_pairs(reviews: DataFrame) -> DataFrame:
    """Two evaluators' answers side by side per packet (first < second by name)."""
    cols = {"risk": "risk_present", "dimension": "dimension", "sufficient": "evidence_sufficient", "severity": "severity", "failure": "failure"}
    side = lambda p: reviews.select("packet_id", F.col("evaluator").alias(f"{p}_evaluator"), *[F.col(c).alias(f"{p}_{n}") for n, c in cols.items()])
    # an evaluator answers a packet once, so a packet yields few pairs
    return side("a").join(side("b"), "packet_id").filter(F.col("a_evaluator") < F.col("b_evaluator"))


def pair_summary(reviews: DataFrame) -> DataFrame:
    """Agreement rates, severity closeness and kappa for every pair of evaluators."""
    by = ["a_evaluator", "b_evaluator"]
    cat = categorize(evaluator_pairs(reviews))
    good = (F.col("b_failure") == "none") & (F.col("a_failure") == "none")
    rate = lambda c: F.round(F.avg(F.when(good, c.cast("double"))), 4)
    both = good & F.col("a_severity").isNotNull() & F.col("b_severity").isNotNull()
    diff = F.abs(F.col("a_severity") - F.col("b_severity"))
    stats = cat.groupBy(*by).agg(
        F.count_if(good).alias("n_common"), rate(F.col("a_risk") == F.col("b_risk")).alias("risk_agreement"),
        rate(F.col("a_dimension") == F.col("b_dimension")).alias("dimension_agreement"), rate(F.col("a_sufficient") == F.col("b_sufficient")).alias("sufficiency_agreement"),
        F.count_if(both).alias("n_severity_pairs"), F.round(F.avg(F.when(both, (diff == 0).cast("double"))), 4).alias("severity_exact"),
        F.round(F.avg(F.when(both, (diff <= 1).cast("double"))), 4).alias("severity_within_1"), F.count_if(F.col("category") == "agree").alias("n_agree"))
    kappa = cohen(cat.filter(good), by, "a_risk", "b_risk").select(*by, F.col("kappa").alias("risk_kappa"))
    return stats.join(kappa, by, "left")


def verdicts(df: DataFrame, item: str, value: str = "verdict") -> DataFrame:
    """Plurality verdict per item, whether raters were split, and support."""
    return plurality(df, [item], value).select(
        item, "majority", "n", (F.col("top_n") < F.col("n")).alias("split"), (F.col("majority") == "SUPPORTED").alias("supported"))


def verdict_summary(per_item: DataFrame) -> DataFrame:
    return per_item.agg(
        F.count("*").alias("n_findings"), F.avg(F.col("supported").cast("double")).alias("supported_rate"),
        F.count_if(F.col("majority") == "NOT_SUPPORTED").alias("n_not_supported"), F.count_if("split").alias("n_split"))


def blind(models: DataFrame, model: str, seed: int) -> DataFrame:
    """Code names in seeded order."""
    names = models.select(model).distinct().withColumn("_h", hash_rank(seed, model))
    return hash_ranks(names, "_h", None, [model], "_r").select(model, F.format_string("Model %02d", F.col("_r")).alias("code"))


def modal(runs: DataFrame, by: list[str], cut: int = 5) -> DataFrame:
    """Modal answer over the valid repeat runs; a tie is UNCERTAIN; lower medians, ranges and spreads of the ratings."""
    ok = F.col("fallback") == 0
    yes = F.count_if(ok & (F.col("o") <= cut))
    no = F.count_if(ok & (F.col("o") > cut))
    val = lambda c: F.when(ok, F.col(c))
    aggs = [F.count_if(ok).alias("valid_runs"), F.count_if(~ok).alias("fallbacks"), F.sum("parse_failures").alias("parse_failures"), F.sum("output_truncated").alias("output_truncated"),
            yes.alias("_yes"), no.alias("_no"), F.count_distinct(F.when(ok, F.struct("o", "s", "d"))).alias("distinct_triples")]
    for c in ("o", "s", "d"):
        aggs += [F.expr(f"percentile_disc(0.5) within group (order by case when fallback = 0 then {c} end)").cast("int").alias(c),
                 (F.max(val(c)) - F.min(val(c))).alias(f"{c}_range"), F.round(F.stddev_pop(val(c)), 4).alias(f"{c}_sd")]
    return runs.groupBy(*by).agg(*aggs).withColumn("risk_present", first_case(
        (F.col("valid_runs") == 0, None), (F.col("_yes") == F.col("_no"), "UNCERTAIN"), (F.col("_yes") > F.col("_no"), "YES"), default="NO")).withColumn(
        "risk_agreement", ratio(F.greatest("_yes", "_no"), F.col("valid_runs"))).drop("_yes", "_no")


def compare_evaluators(base: DataFrame, other: DataFrame, key: list[str]) -> DataFrame:
    """Two evaluators' ratings per packet and dimension: category, distances, match of the triple.

    ``base``/``other``: key + dimension, risk_present, o, s, d; other also valid_runs, parse_failures.
    """
    b = base.select(*key, "dimension", F.col("risk_present").alias("_r"), *[F.col(c).alias(f"_{c}") for c in "osd"])
    j = b.join(other, [*key, "dimension"])
    # another dimension where the side that says NO here says YES, and the other side does not
    alt = b.join(other.select(*key, "dimension", F.col("risk_present").alias("_or")), [*key, "dimension"]).groupBy(*key).agg(
        F.array_sort(F.collect_set(F.when((F.col("_r") == "YES") & F.coalesce(F.col("_or") != "YES", F.lit(True)), F.col("dimension")))).alias("_only_base"),
        F.array_sort(F.collect_set(F.when((F.col("_or") == "YES") & (F.col("_r") != "YES"), F.col("dimension")))).alias("_only_other"))
    j = j.join(alt, key)
    ra, rb = F.col("_r"), F.col("risk_present")
    elsewhere = lambda c: F.size(F.array_except(F.col(c), F.array("dimension"))) > 0
    category = first_case(
        (rb.isNull() & (F.col("parse_failures") > 0), "parser_format_failure"), (rb.isNull(), "truncation_fallback"),
        ((ra == "UNCERTAIN") != (rb == "UNCERTAIN"), "insufficient_evidence"),
        ((ra == "NO") & (rb == "YES") & elsewhere("_only_base"), "localization"), ((ra == "YES") & (rb == "NO") & elsewhere("_only_other"), "localization"),
        (ra != rb, "evidence_interpretation"), (_gap2(F.col("_s"), F.col("s")), "severity"), default="agree")
    triple = F.when(F.col("_o").isNotNull() & F.col("o").isNotNull(), (F.col("_o") == F.col("o")) & (F.col("_s") == F.col("s")) & (F.col("_d") == F.col("d")))
    return j.select(*key, "dimension", ra.alias("base_risk"), rb.alias("other_risk"), category.alias("category"),
                    *[F.abs(F.col(f"_{c}") - F.col(c)).alias(f"{c}_diff") for c in "osd"], triple.alias("triple_match"))


def comparison_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rates over the answered pairs."""
    done = F.col("other_risk").isNotNull()
    definite = done & (F.col("base_risk") != "UNCERTAIN") & (F.col("other_risk") != "UNCERTAIN")
    rated = done & F.col("s_diff").isNotNull()
    rate = lambda cond, c: F.round(F.avg(F.when(cond, c.cast("double"))), 4)
    return rows.groupBy(*by).agg(
        F.count("*").alias("pairs"), F.count_if(done).alias("answered"), rate(done, F.col("base_risk") == F.col("other_risk")).alias("status_agreement"),
        F.count_if(definite).alias("definite"), rate(definite, F.col("base_risk") == F.col("other_risk")).alias("definite_agreement"),
        rate(rated, F.col("s_diff") == 0).alias("severity_exact"), rate(rated, F.col("s_diff") <= 1).alias("severity_within_1"),
        *[F.round(F.avg(F.when(rated, F.col(f"{c}_diff"))), 4).alias(f"{c}_mae") for c in "osd"], rate(rated, F.col("triple_match")).alias("triple_exact"))


def localization_overlap(base: DataFrame, other: DataFrame, key: list[str]) -> DataFrame:
    """Jaccard overlap of the dimensions each side reports as risky; packets without a full answer are left out."""
    b = base.select(*key, "dimension", (F.col("risk_present") == "YES").alias("_b"))
    o = other.select(*key, "dimension", F.col("risk_present").alias("_r"))
    agg = b.join(o, [*key, "dimension"]).groupBy(*key).agg(
        F.bool_or(F.col("_r").isNull()).alias("_open"), F.count_if(F.col("_b") & (F.col("_r") == "YES")).alias("_both"),
        F.count_if(F.col("_b") | (F.col("_r") == "YES")).alias("_any"))
    return agg.filter(~F.col("_open")).select(*key, (F.col("_both") == F.col("_any")).alias("exact"),
                                              F.round(F.coalesce(ratio(F.col("_both"), F.col("_any")), F.lit(1.0)), 4).alias("jaccard"))


def provider_means(runs: DataFrame) -> DataFrame:
    """Mean ratings per dimension and provider over the valid runs."""
    return runs.filter("fallback = 0").groupBy("dimension", "provider").agg(
        F.count("*").alias("n"), *[F.round(F.avg(c), 4).alias(f"{c}_mean") for c in "osd"])


def attempt_stats(attempts: DataFrame) -> DataFrame:
    """Attempts per provider and outcome (ok or error type)."""
    return attempts.groupBy("provider", F.coalesce(F.substring_index("error", ":", 1), F.lit("ok")).alias("outcome")).agg(
        F.count("*").alias("n"), F.avg("elapsed_s").alias("mean_s"))


def run_failures(attempts: DataFrame, by: list[str]) -> DataFrame:
    """Why a run has no answer: provider outage, parse failure or truncation."""
    err = F.col("error")
    trunc = F.coalesce(err.startswith("TruncatedError"), F.lit(False))
    agg = attempts.groupBy(*by).agg(F.count("*").alias("attempts"), F.bool_or(err.isNull()).alias("_text"), F.bool_or(trunc).alias("_trunc"),
                                    F.bool_or("parsed").alias("_parsed"))
    return agg.select(*by, "attempts", first_case(
        (F.col("_parsed"), "answered"), (~F.col("_text") & ~F.col("_trunc"), "provider_unavailable"), (F.col("_trunc") & ~F.col("_text"), "truncated"), default="parse_failure").alias("outcome"))


def stratify(runs: DataFrame, strata: dict[str, Column]) -> DataFrame:
    """Runs repeated per stratum, with those outside it turned into fallbacks (the strata are few and fixed)."""
    rows = runs.withColumn("_s", F.array(*[F.struct(F.lit(n).alias("stratum"), F.coalesce(c, F.lit(False)).alias("keep")) for n, c in strata.items()]))
    rows = rows.select(*runs.columns, F.explode("_s").alias("_s")).withColumn("stratum", F.col("_s.stratum"))
    return rows.withColumn("fallback", F.when(F.col("_s.keep"), F.col("fallback")).otherwise(1)).drop("_s")


def completion(runs: DataFrame, plan: DataFrame, first_round: DataFrame, key: list[str], packet: str, prompt: str = "prompt_hash") -> DataFrame:
    """Planned, valid, recovered and open runs, and packets with more than one prompt."""
    valid = runs.filter("fallback = 0").select(*dict.fromkeys([*key, packet]), prompt)
    ok = valid.select(*key).distinct()
    n_plan = plan.agg(F.count("*").alias("planned_runs"))
    n_valid = ok.join(plan.select(*key), key, "left_semi").agg(F.count("*").alias("valid_runs"))
    recovered = ok.join(first_round.select(*key), key, "left_anti").agg(F.count("*").alias("recovered_runs"))
    open_ = plan.join(ok, key, "left_anti").agg(F.count("*").alias("unresolved_runs"))
    prompts = valid.groupBy(packet).agg(F.count_distinct(prompt).alias("_p")).agg(F.count_if(F.col("_p") > 1).alias("packets_with_several_prompts"))
    return reduce(lambda a, b: a.join(F.broadcast(b)), [n_plan, n_valid, recovered, open_, prompts])  # one row each


def reference_answer(probes: DataFrame) -> DataFrame:
    """Sufficiency, risk and dimension implied by the evidence; a triggered risk outranks a failed gate."""
    aspect = F.col("aspect_scoring")
    suff = first_case(((F.col("probe_status") == "INSUFFICIENT_EVIDENCE") | (aspect == "not_scored"), "NO"),
                      ((aspect == "mapping_blocked") | (F.size("failed_gates") > 0), "UNCERTAIN"), default="YES")
    src = probes.withColumn("evidence_sufficient", suff)
    risk = first_case(((F.size("risks") > 0) | aspect.isin("risk_detected", "scored_risk"), "YES"), (F.col("evidence_sufficient") == "YES", "NO"), default="UNCERTAIN")
    return src.withColumn("risk_present", risk).withColumn("answer_dimension", first_case(
        (F.col("risk_present") == "YES", F.col("dimension")), (F.col("risk_present") == "NO", "NONE"), default="UNCERTAIN"))


def duplicate_raters(df: DataFrame, item: list[str], rater: str) -> DataFrame:
    """Rater codes used more than once on an item."""
    return df.groupBy(*item, rater).agg(F.count("*").alias("n")).filter("n > 1")


def match_count(majorities: DataFrame, expected: Column) -> DataFrame:
    """Items whose plurality equals the expected answer."""
    return majorities.agg(F.count("*").alias("items"), F.count_if(F.col("majority") == expected).alias("matches"))
