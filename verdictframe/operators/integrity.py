"""Identity, license, listing and artefact-hash checks."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import contains_any, first_case, let, reasons, strip
from ..sources.files import below, scan_files
from .documents import REPRO_SIGNALS, families

# License wording in a card, weight formats and the files a loader reads.
OPEN_LICENSE_HINTS = ("apache-2.0", "apache 2", "mit license", "bsd license", "open source", "permissive license",
                      "licensed under mit", "licensed under apache")
WEIGHT_INDEXES = {"safetensors": "model.safetensors.index.json", "pytorch_bin": "pytorch_model.bin.index.json"}
SINGLE_WEIGHTS = {"safetensors": "model.safetensors", "pytorch_bin": "pytorch_model.bin"}
WEIGHT_SUFFIX = r"\.(safetensors|bin|pt|pth|ckpt|h5|msgpack|gguf|onnx)$"
LOADER_FILES = ("config.json", "generation_config.json", "tokenizer.json", "tokenizer_config.json",
                "special_tokens_map.json", "added_tokens.json", "vocab.txt", "vocab.json", "merges.txt", "spiece.model",
                "sentencepiece.bpe.model", "tokenizer.model")


def fingerprint(files: Column) -> Column:
    """SHA-256 of the sorted names joined by newlines."""
    return F.concat(F.lit("sha256:"), F.sha2(F.array_join(F.array_sort(files), "\n"), 256))


def bare_hash(c: Column) -> Column:
    """Hash without its algorithm prefix; NULL when blank."""
    return F.nullif(F.regexp_replace(strip(c), "^sha256:", ""), F.lit(""))


def same_hash(a: Column, b: Column) -> Column:
    return bare_hash(a) == bare_hash(b)


def sha_like(revision: Column) -> Column:
    return F.coalesce(F.lower(revision).rlike("^[0-9a-f]{7,40}$"), F.lit(False))


def compare_hashes(ref: Column, local: Column) -> Column:
    r, x = bare_hash(ref), bare_hash(local)
    return first_case((r.isNull() | x.isNull(), "not_performed"), (r == x, "match"), default="diverge")


def compare_listings(files: Column, live: Column) -> Column:
    """'not_performed' when either listing is missing, else 'match' or 'drift'."""
    return first_case((live.isNull() | (F.size(files) == 0), "not_performed"), (fingerprint(files) == fingerprint(live), "match"),
                      default="drift")


def integrity_verdict(models: DataFrame, key: str) -> DataFrame:
    """All identity checks of a model in one row.

    Reads: model_ref, revision, files (array), live_files (array or NULL), card_text,
    license, reference_hash, local_hash.
    """
    files = F.coalesce(F.col("files"), F.array().cast("array<string>"))
    card, rev, lic = strip(F.coalesce("card_text", F.lit(""))), F.nullif(strip("revision"), F.lit("")), F.nullif(strip("license"), F.lit(""))
    src = models.select(key, "live_files", "reference_hash", "local_hash", files.alias("_files"), card.alias("_card"),
                        rev.alias("_rev"), lic.alias("_lic"), "model_ref")
    f, card, rev, lic = F.col("_files"), F.col("_card"), F.col("_rev"), F.col("_lic")
    has_files, has_card = F.size(f) > 0, F.length(card) > 0
    empty = rev.isNull() & ~has_files & ~has_card
    content_addressed = F.col("model_ref").rlike(r"^[/.]") & bare_hash(F.col("local_hash")).isNotNull()
    pinned = content_addressed | sha_like(rev)
    card_open = has_card & let(F.lower(card), lambda low: contains_any(low, OPEN_LICENSE_HINTS))
    license_file = F.exists(f, lambda x: F.lower(x).rlike(r"(^|/)license(\.[a-z0-9]+)?$"))
    repro = families(card, REPRO_SIGNALS)
    src = src.select(
        "*", pinned.alias("revision_pinned"), (has_files | content_addressed).alias("files_listed"), lic.isNotNull().alias("license_declared"),
        has_card.alias("card_present"), (F.size(repro) >= 2).alias("reproducibility_claims"), has_files.alias("listing_recorded"),
        compare_listings(f, F.col("live_files")).alias("listing_state"),
        compare_hashes(F.col("reference_hash"), F.col("local_hash")).alias("hash_state"), empty.alias("_empty"),
        card_open.alias("_card_open"), license_file.alias("_license_file"), content_addressed.alias("_ca"))
    checks = ["revision_pinned", "files_listed", "license_declared", "card_present", "reproducibility_claims", "listing_recorded"]
    passes = sum((F.col(c).cast("int") for c in checks), F.lit(0))
    risks = reasons((F.col("listing_state") == "drift", "I-INT-LISTING-DRIFT"), (F.col("hash_state") == "diverge", "I-INT-BYTES-DIVERGE"))
    gaps = reasons((~F.col("revision_pinned") & rev.isNotNull(), "I-INT-REV-UNPINNED"), (~F.col("files_listed"), "I-INT-MANIFEST-MISSING"),
                   (~F.col("license_declared"), "I-INT-LICENSE-UNDISCLOSED"))
    none = F.array().cast("array<string>")
    e = F.col("_empty")
    ref_missing, local_missing = bare_hash(F.col("reference_hash")).isNull(), bare_hash(F.col("local_hash")).isNull()
    return src.select(
        key, F.when(e, "INSUFFICIENT_EVIDENCE").otherwise("EVALUATED").alias("status"),
        *[F.when(~e, F.col(c)).alias(c) for c in checks],
        F.when(e, "not_performed").otherwise(F.col("listing_state")).alias("listing_state"),
        F.when(e, "not_performed").otherwise(F.col("hash_state")).alias("hash_state"),
        F.when(e, 0).otherwise(passes).alias("pass_count"), F.when(e, 0).otherwise(len(checks) - passes).alias("fail_count"),
        first_case((e, "not_scored"), (F.size(risks) > 0, "risk_detected"), (F.size(gaps) > 0, "disclosure_gap"),
                   default="no_material_risk").alias("aspect_scoring"),
        F.when(e, none).otherwise(risks).alias("risks"), F.when(e, none).otherwise(gaps).alias("gaps"),
        F.when(e, F.array(F.lit("G-INT-IDENTITY-EMPTY"))).otherwise(reasons(
            (F.col("listing_state") == "not_performed", "G-INT-LISTING-UNVERIFIED"), (ref_missing, "G-INT-HASH-REF-MISSING"),
            (local_missing, "G-INT-HASH-LOCAL-MISSING"), (ref_missing | local_missing, "I-INT-HASH-UNVERIFIED"))).alias("failed_gates"),
        F.when(e, F.array(F.lit("identity_empty"))).otherwise(reasons(
            (~F.col("revision_pinned") & rev.isNotNull(), "unpinned_revision"), (~F.col("revision_pinned") & rev.isNull(), "missing_revision"),
            (~F.col("files_listed"), "empty_file_list"),
            (lic.isNotNull() & F.col("_card_open") & F.lower(lic).contains("proprietary"), "license_card_mismatch"),
            (lic.isNull(), "missing_license"), (lic.isNull() & (F.col("_card_open") | F.col("_license_file")), "card_only_license"),
            (~has_card, "empty_card"), (~F.col("reproducibility_claims"), "thin_reproducibility"),
            (F.col("listing_state") == "drift", "files_listing_drift"))).alias("flags"))


# --- artefact sets -----------------------------------------------------------


def is_weight(name: Column) -> Column:
    return name.rlike(WEIGHT_SUFFIX) | name.isin(*WEIGHT_INDEXES.values())


def expected_files(observed: DataFrame, shards: DataFrame, by: list[str], name: str = "name") -> DataFrame:
    """Weight files the loader expects per set: the first format found decides.

    ``shards`` lists (set, index file, shard name) as read from the index files.
    """
    order = [(WEIGHT_INDEXES["safetensors"], 1), (WEIGHT_INDEXES["pytorch_bin"], 2), (SINGLE_WEIGHTS["safetensors"], 3), (SINGLE_WEIGHTS["pytorch_bin"], 4)]
    rank = first_case(*[(F.col(name) == f, i) for f, i in order])
    chosen = observed.withColumn("_r", rank).filter("_r is not null").groupBy(*by).agg(
        F.min_by(name, "_r").alias("primary"), F.min("_r").alias("_r"))
    primary = chosen.select(*by, F.col("primary").alias("name"), "primary", (F.col("_r") <= 2).alias("sharded"))
    rest = chosen.filter("_r <= 2").join(
        shards.select(*by, F.col("index_file").alias("primary"), F.col("shard").alias("name")), [*by, "primary"]).select(
        *by, "name", "primary", F.lit(True).alias("sharded"))
    return primary.unionByName(rest).distinct()


def verify_artifacts(observed: DataFrame, manifest: DataFrame, shards: DataFrame, by: list[str]) -> DataFrame:
    """State of every relevant file: match, changed, missing, unexpected, unattested or recorded.

    ``observed`` and ``manifest`` hold by + (name, sha256).
    """
    pinned = manifest.select(*by).distinct().withColumn("_pinned", F.lit(True))
    supported = expected_files(observed, shards, by)
    wanted = supported.select(*by, "name").withColumn("_expected", F.lit(True))
    formats = supported.groupBy(*by).agg(F.first("primary").alias("primary"), F.bool_or("sharded").alias("sharded"))
    man = manifest.select(*by, "name", F.col("sha256").alias("expected_sha256"))
    obs = observed.select(*by, "name", "sha256")
    both = obs.join(man, [*by, "name"], "full_outer").join(wanted, [*by, "name"], "full_outer").join(pinned, by, "left").join(formats, by)
    has_pin = F.coalesce("_pinned", F.lit(False))
    present = F.col("sha256").isNotNull()
    weight = is_weight(F.col("name"))
    in_scope = F.when(has_pin, F.col("expected_sha256").isNotNull()).otherwise(F.coalesce("_expected", F.lit(False)))
    relevant = in_scope | (present & (weight | F.col("name").isin(*LOADER_FILES)))
    state = first_case(
        (~present, "missing"),
        (F.col("expected_sha256").isNotNull() & (F.lower("expected_sha256") == F.col("sha256")), "match"),
        (F.col("expected_sha256").isNotNull(), "changed"), (has_pin & weight, "unexpected"), (has_pin, "unattested"), default="recorded")
    return both.filter(relevant).select(*by, "name", "sha256", "expected_sha256", state.alias("state"), "primary", "sharded", has_pin.alias("pinned"))


def artifact_status(observed: DataFrame, files: DataFrame, by: list[str]) -> DataFrame:
    """VERIFIED, MISMATCH, INCOMPLETE, UNPINNED or UNSUPPORTED per set."""
    per_set = files.groupBy(*by).agg(
        F.count("*").alias("n_files"), F.count_if(F.col("state").isin("changed", "unexpected")).alias("n_bad"),
        F.count_if(F.col("state") == "missing").alias("n_missing"), F.bool_or("pinned").alias("_p"), F.bool_or("sharded").alias("sharded"))
    return observed.select(*by).distinct().join(per_set, by, "left").select(
        *by, first_case((F.col("n_files").isNull(), "UNSUPPORTED"), (F.col("n_bad") > 0, "MISMATCH"), (F.col("n_missing") > 0, "INCOMPLETE"),
                        (F.col("_p"), "VERIFIED"), default="UNPINNED").alias("status"),
        F.coalesce("n_files", F.lit(0)).alias("n_files"), F.coalesce("n_bad", F.lit(0)).alias("n_bad"),
        F.coalesce("n_missing", F.lit(0)).alias("n_missing"), "sharded")


def build_manifest(spark: SparkSession, path: str, by_folder: bool = True) -> DataFrame:
    """(set, name, sha256) of every file below a folder; files are hashed in pieces by the tasks that get them.

    A set is the folder's path below ``path`` ('.' for files directly in it); without ``by_folder`` all files are one
    set and names keep their folders.
    """
    files = scan_files(spark, path)
    parts = F.split(below("path", path), "/")
    folder = F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")
    set_id = F.when(folder == "", ".").otherwise(folder) if by_folder else F.lit(".")
    return files.select(set_id.alias("set_id"), (F.element_at(parts, -1) if by_folder else below("path", path)).alias("name"),
                        "sha256", F.col("length").alias("bytes"))


def pick_manifest(candidates: DataFrame, by: list[str], priority: list[str], source: str = "source") -> DataFrame:
    """Rows of the most authoritative manifest per set (operator, then set, then legacy…)."""
    rank = first_case(*[(F.col(source) == s, i) for i, s in enumerate(priority)])
    ranked = candidates.withColumn("_r", rank).filter("_r is not null")
    best = ranked.groupBy(*by).agg(F.min("_r").alias("_r"))
    return ranked.join(best, [*by, "_r"]).drop("_r")


def set_digest(files: DataFrame, by: list[str]) -> DataFrame:
    """SHA-256 of the compact JSON map name -> hash in name order.

    A set is one model folder; only its names and hashes are gathered, never content.
    """
    pair = F.concat(F.lit('"'), F.col("name"), F.lit('":"'), F.col("sha256"), F.lit('"'))
    items = F.array_sort(F.collect_list(F.struct("name", pair.alias("p"))))
    return files.groupBy(*by).agg(items.alias("_i")).select(
        *by, F.size("_i").alias("n_files"),
        F.sha2(F.concat(F.lit("{"), F.array_join(F.transform("_i", lambda x: x["p"]), ","), F.lit("}")), 256).alias("set_sha256"))


def identity_inputs(files: DataFrame, by: list[str]) -> DataFrame:
    """Which hash identifies a set: the single weight file without a manifest, else the set digest."""
    compared = files.filter(F.col("sha256").isNotNull() & (~F.col("pinned") | F.col("state").isin("match", "changed", "unexpected")))
    digest = set_digest(compared, by).drop("n_files")
    primary = files.groupBy(*by).agg(
        F.max(F.when(F.col("name") == F.col("primary"), F.col("sha256"))).alias("_primary"),
        F.bool_or("pinned").alias("_p"), F.bool_or("sharded").alias("_s"))
    single = ~F.col("_p") & ~F.col("_s")
    return primary.join(digest, by, "left").select(
        *by, F.when(single, "primary_file").otherwise("artifact_set").alias("identity"),
        F.when(single, F.col("_primary")).otherwise(F.col("set_sha256")).alias("local_hash"))


def shard_compare(expected: DataFrame, observed: DataFrame, by: list[str]) -> DataFrame:
    """Per set: shards compared, shards that differ, overall verdict."""
    j = expected.select(*by, "name", F.col("sha256").alias("_e")).join(observed.select(*by, "name", F.col("sha256").alias("_o")), [*by, "name"])
    return j.groupBy(*by).agg(F.count("*").alias("n_compared"), F.count_if(~same_hash(F.col("_e"), F.col("_o"))).alias("n_changed")).withColumn(
        "status", F.when(F.col("n_changed") == 0, "VERIFIED").otherwise("MISMATCH"))


def verify_refs(stored: DataFrame, recorded: DataFrame, key: list[str]) -> DataFrame:
    """Recorded hash against the hash of the stored bytes; either side may be missing."""
    j = recorded.select(*key, F.col("sha256").alias("recorded")).join(stored.select(*key, F.col("sha256").alias("actual")), key, "full_outer")
    return j.withColumn("state", first_case((F.col("actual").isNull(), "missing_bytes"), (F.col("recorded").isNull(), "unrecorded"),
                                            (same_hash(F.col("recorded"), F.col("actual")), "match"), default="diverge"))


def duplicate_content(files: DataFrame, owner: str, sha: str = "sha256") -> DataFrame:
    """Identical bytes kept by more than one owner; copies collapse before the shuffle."""
    pairs = files.groupBy(sha, owner).agg(F.count("*").alias("_n"))
    return pairs.groupBy(sha).agg(F.count("*").alias("owners"), F.sum("_n").alias("files"), F.min(owner).alias("first_owner")).filter("owners > 1")
