"""Integrity queries (INT)."""

from pyspark.sql import functions as F

from ..operators import integrity as I
from ..streaming.operators import scratch
from .base import query
from .documents import _LOW, _SIG, any_sql

_ARR = lambda c: f"list_sort(string_split({c}, ';'))"
_FP = lambda c: f"'sha256:' || sha256(CASE WHEN {c} = '' THEN '' ELSE array_to_string({_ARR(c)}, chr(10)) END)"


def _listed(c):
    return F.filter(F.split(c, ";"), lambda x: x != "")


@query("int_01_fingerprint", f"SELECT card_id, {_FP('files')} AS fingerprint FROM v_cards", ("v_cards",))
def _(v):
    return v("v_cards").select("card_id", I.fingerprint(_listed("files")).alias("fingerprint"))


_IV = f""", m AS (SELECT *, {_LOW} AS low, nullif(trim(revision), '') AS rev, nullif(trim(license), '') AS lic, CASE WHEN files = '' THEN [] ELSE string_split(files, ';') END AS fl,
  regexp_replace(reference_hash, '^sha256:', '') AS rh, regexp_replace(local_hash, '^sha256:', '') AS lh FROM v_cards),
 n AS (SELECT *, rev IS NULL AND len(fl) = 0 AND length(low) = 0 AS empty, (model_ref LIKE '/%' OR model_ref LIKE '.%') AND lh IS NOT NULL AS ca, len(fl) > 0 AS has_files, length(low) > 0 AS has_card,
  length(low) > 0 AND {any_sql('low', I.OPEN_LICENSE_HINTS)} AS card_open, coalesce(list_bool_or(list_transform(fl, lambda x: regexp_matches(lower(x), '(^|/)license(\\.[a-z0-9]+)?$'))), false) AS lic_file,
  {_SIG} AS sig FROM m),
 o AS (SELECT *, ca OR coalesce(regexp_matches(lower(rev), '^[0-9a-f]{{7,40}}$'), false) AS revision_pinned, has_files OR ca AS files_listed, lic IS NOT NULL AS license_declared, has_card AS card_present, contains(sig, '|') AS reproducibility_claims,
  has_files AS listing_recorded, CASE WHEN live_files IS NULL OR NOT has_files THEN 'not_performed' WHEN {_FP('files')} = {_FP('live_files')} THEN 'match' ELSE 'drift' END AS ls,
  CASE WHEN rh IS NULL OR lh IS NULL THEN 'not_performed' WHEN rh = lh THEN 'match' ELSE 'diverge' END AS hs FROM n),
 p AS (SELECT *, revision_pinned::INT + files_listed::INT + license_declared::INT + card_present::INT + reproducibility_claims::INT + listing_recorded::INT AS pc,
  concat_ws('|', CASE WHEN ls = 'drift' THEN 'I-INT-LISTING-DRIFT' END, CASE WHEN hs = 'diverge' THEN 'I-INT-BYTES-DIVERGE' END) AS rk,
  concat_ws('|', CASE WHEN NOT revision_pinned AND rev IS NOT NULL THEN 'I-INT-REV-UNPINNED' END, CASE WHEN NOT files_listed THEN 'I-INT-MANIFEST-MISSING' END, CASE WHEN NOT license_declared THEN 'I-INT-LICENSE-UNDISCLOSED' END) AS gp FROM o)"""


@query("int_02_revision", _IV + " SELECT card_id, CASE WHEN NOT empty THEN revision_pinned END AS revision_pinned FROM p", ("v_cards",))
def _(v):
    return _verdict(v).select("card_id", "revision_pinned")


def _verdict(v):
    cards = v("v_cards").withColumn("files", _listed("files")).withColumn("live_files", F.split("live_files", ";"))
    return I.integrity_verdict(cards, "card_id")


@query("int_03_files", """SELECT card_id, files <> '' AS listed, CASE WHEN files = '' THEN 0 ELSE len(string_split(files, ';')) END::INT AS n_files, contains(files, 'config.json') AS has_config,
 regexp_matches(files, '(\\.safetensors|\\.bin)') AS has_weight FROM v_cards""", ("v_cards",))
def _(v):
    f = _listed("files")
    return v("v_cards").select(
        "card_id", (F.size(f) > 0).alias("listed"), F.size(f).alias("n_files"), F.exists(f, lambda x: x.endswith("config.json")).alias("has_config"),
        F.exists(f, I.is_weight).alias("has_weight"))


@query("int_04_license", _IV + " SELECT card_id, CASE WHEN NOT empty THEN license_declared END AS license_declared, card_open, lic_file FROM p", ("v_cards",))
def _(v):
    extra = v("v_cards").select("card_id", I.contains_any(F.lower("card_text"), I.OPEN_LICENSE_HINTS).alias("card_open"),
                                F.exists(_listed("files"), lambda x: F.lower(x).rlike(r"(^|/)license(\.[a-z0-9]+)?$")).alias("lic_file"))
    return _verdict(v).select("card_id", "license_declared").join(extra, "card_id")


@query("int_05_presence", _IV + " SELECT card_id, CASE WHEN NOT empty THEN card_present END AS card_present, CASE WHEN NOT empty THEN listing_recorded END AS listing_recorded FROM p", ("v_cards",))
def _(v):
    return _verdict(v).select("card_id", "card_present", "listing_recorded")


@query("int_06_listing_drift", f"""SELECT card_id, CASE WHEN live_files IS NULL OR files = '' THEN 'not_performed' WHEN {_FP('files')} = {_FP('live_files')} THEN 'match' ELSE 'drift' END AS state FROM v_cards""", ("v_cards",))
def _(v):
    return v("v_cards").select("card_id", I.compare_listings(_listed("files"), F.split("live_files", ";")).alias("state"))


@query("int_07_hash_compare", _IV + " SELECT card_id, hs AS state FROM o", ("v_cards",))
def _(v):
    return v("v_cards").select("card_id", I.compare_hashes(F.col("reference_hash"), F.col("local_hash")).alias("state"))


_CH = "revision_pinned files_listed license_declared card_present reproducibility_claims listing_recorded".split()


@query("int_08_integrity_verdict", _IV + f""" SELECT card_id, CASE WHEN empty THEN 'INSUFFICIENT_EVIDENCE' ELSE 'EVALUATED' END AS status, {", ".join(f"CASE WHEN NOT empty THEN {c} END AS {c}" for c in _CH)},
 CASE WHEN empty THEN 'not_performed' ELSE ls END AS listing_state, CASE WHEN empty THEN 'not_performed' ELSE hs END AS hash_state, CASE WHEN empty THEN 0 ELSE pc END AS pass_count, CASE WHEN empty THEN 0 ELSE 6 - pc END AS fail_count,
 CASE WHEN empty THEN 'not_scored' WHEN rk <> '' THEN 'risk_detected' WHEN gp <> '' THEN 'disclosure_gap' ELSE 'no_material_risk' END AS aspect_scoring, CASE WHEN empty THEN '' ELSE rk END AS risks, CASE WHEN empty THEN '' ELSE gp END AS gaps,
 CASE WHEN empty THEN 'G-INT-IDENTITY-EMPTY' ELSE concat_ws('|', CASE WHEN ls = 'not_performed' THEN 'G-INT-LISTING-UNVERIFIED' END, CASE WHEN rh IS NULL THEN 'G-INT-HASH-REF-MISSING' END, CASE WHEN lh IS NULL THEN 'G-INT-HASH-LOCAL-MISSING' END,
  CASE WHEN rh IS NULL OR lh IS NULL THEN 'I-INT-HASH-UNVERIFIED' END) END AS failed_gates,
 CASE WHEN empty THEN 'identity_empty' ELSE concat_ws('|', CASE WHEN NOT revision_pinned AND rev IS NOT NULL THEN 'unpinned_revision' END, CASE WHEN NOT revision_pinned AND rev IS NULL THEN 'missing_revision' END, CASE WHEN NOT files_listed THEN 'empty_file_list' END,
  CASE WHEN lic IS NOT NULL AND card_open AND contains(lower(lic), 'proprietary') THEN 'license_card_mismatch' END, CASE WHEN lic IS NULL THEN 'missing_license' END, CASE WHEN lic IS NULL AND (card_open OR lic_file) THEN 'card_only_license' END,
  CASE WHEN NOT has_card THEN 'empty_card' END, CASE WHEN NOT reproducibility_claims THEN 'thin_reproducibility' END, CASE WHEN ls = 'drift' THEN 'files_listing_drift' END) END AS flags FROM p""", ("v_cards",))
def _(v):
    return _verdict(v)


# --- artefact sets -----------------------------------------------------------

_SETS = """, ob AS (SELECT set_id, name, sha256(content) AS sha256 FROM v_files),
 mf AS (SELECT set_id, expected_name AS name, CASE WHEN set_id % 6 = 1 THEN upper(sha256(expected_content)) ELSE sha256(expected_content) END AS expected_sha256 FROM v_files WHERE expected_name IS NOT NULL
  UNION ALL SELECT set_id, 'merges.txt', sha256('gone') FROM v_files WHERE set_id % 10 = 9 AND expected_name = 'config.json'),
 sh AS (SELECT set_id, name AS index_file, unnest(CASE WHEN set_id % 8 = 0 THEN ['weights-00001-of-00002.safetensors', 'weights-00002-of-00002.safetensors'] ELSE ['weights-00001-of-00002.safetensors'] END) AS shard FROM v_files WHERE name = 'model.safetensors.index.json'),
 pf AS (SELECT set_id, name AS primary_name, name = 'model.safetensors.index.json' AS sharded FROM v_files WHERE name IN ('model.safetensors.index.json', 'model.safetensors')
  QUALIFY row_number() OVER (PARTITION BY set_id ORDER BY name = 'model.safetensors.index.json' DESC) = 1),
 ex AS (SELECT set_id, primary_name AS name, primary_name, sharded FROM pf UNION SELECT pf.set_id, shard, primary_name, true FROM pf JOIN sh ON sh.set_id = pf.set_id AND index_file = primary_name),
 pin AS (SELECT DISTINCT set_id FROM mf),
 allf AS (SELECT set_id, name FROM ob UNION SELECT set_id, name FROM mf UNION SELECT set_id, name FROM ex),
 st0 AS (SELECT a.set_id, a.name, ob.sha256, mf.expected_sha256, pf.primary_name, pf.sharded, pin.set_id IS NOT NULL AS pinned, ex.name IS NOT NULL AS wanted,
  regexp_matches(a.name, '\\.(safetensors|bin|pt|pth|ckpt|h5|msgpack|gguf|onnx)$') OR a.name IN ('model.safetensors.index.json', 'pytorch_model.bin.index.json') AS weight,
  a.name IN ('config.json', 'tokenizer.json', 'vocab.txt', 'merges.txt') AS loader
  FROM allf a JOIN pf USING (set_id) LEFT JOIN ob USING (set_id, name) LEFT JOIN mf USING (set_id, name) LEFT JOIN ex USING (set_id, name) LEFT JOIN pin USING (set_id)),
 st AS (SELECT *, CASE WHEN sha256 IS NULL THEN 'missing' WHEN lower(expected_sha256) = sha256 THEN 'match' WHEN expected_sha256 IS NOT NULL THEN 'changed' WHEN pinned AND weight THEN 'unexpected' WHEN pinned THEN 'unattested' ELSE 'recorded' END AS state
  FROM st0 WHERE CASE WHEN pinned THEN expected_sha256 IS NOT NULL ELSE wanted END OR (sha256 IS NOT NULL AND (weight OR loader)))"""


def _sets(v):
    f = v("v_files")
    observed = f.select("set_id", "name", F.sha2("content", 256).alias("sha256"))
    named = f.filter("expected_name is not null")
    manifest = named.select("set_id", F.col("expected_name").alias("name"), F.when(
        F.col("set_id") % 6 == 1, F.upper(F.sha2("expected_content", 256))).otherwise(F.sha2("expected_content", 256)).alias("sha256"))
    extra = named.filter((F.col("set_id") % 10 == 9) & (F.col("expected_name") == "config.json")).select(
        "set_id", F.lit("merges.txt").alias("name"), F.sha2(F.lit("gone"), 256).alias("sha256"))
    names = F.when(F.col("set_id") % 8 == 0, F.array(F.lit("weights-00001-of-00002.safetensors"), F.lit("weights-00002-of-00002.safetensors"))).otherwise(
        F.array(F.lit("weights-00001-of-00002.safetensors")))
    shards = f.filter(F.col("name") == "model.safetensors.index.json").select("set_id", F.col("name").alias("index_file"), F.explode(names).alias("shard"))
    return observed, manifest.unionByName(extra), shards


@query("int_09_artifact_files", _SETS + " SELECT set_id, name, sha256, expected_sha256, state, pinned FROM st", ("v_files",))
def _(v):
    return I.verify_artifacts(*_sets(v), ["set_id"]).select("set_id", "name", "sha256", "expected_sha256", "state", "pinned")


@query("int_09_artifact_status", _SETS + """, ag AS (SELECT set_id, count(*) AS n_files, count(*) FILTER (WHERE state IN ('changed', 'unexpected')) AS n_bad, count(*) FILTER (WHERE state = 'missing') AS n_missing, bool_or(pinned) AS p, bool_or(sharded) AS sharded FROM st GROUP BY 1)
SELECT s.set_id, CASE WHEN n_files IS NULL THEN 'UNSUPPORTED' WHEN n_bad > 0 THEN 'MISMATCH' WHEN n_missing > 0 THEN 'INCOMPLETE' WHEN p THEN 'VERIFIED' ELSE 'UNPINNED' END AS status, coalesce(n_files, 0) AS n_files, coalesce(n_bad, 0) AS n_bad, coalesce(n_missing, 0) AS n_missing, sharded
FROM (SELECT DISTINCT set_id FROM v_files) s LEFT JOIN ag USING (set_id)""", ("v_files",))
def _(v):
    observed, manifest, shards = _sets(v)
    return I.artifact_status(observed, I.verify_artifacts(observed, manifest, shards, ["set_id"]), ["set_id"])


@query("int_10_expected_files", _SETS + " SELECT set_id, name, sharded FROM ex", ("v_files",))
def _(v):
    observed, _, shards = _sets(v)
    return I.expected_files(observed, shards, ["set_id"]).select("set_id", "name", "sharded")


@query("int_11_build_manifest", """SELECT 'event_type=' || event_type AS set_id, CAST(sum(strlen(props) + 1) AS BIGINT) AS bytes,
 sha256(string_agg(props || chr(10), '' ORDER BY event_id)) AS sha256 FROM events GROUP BY 1""")
def _(v):
    # one file per event type, its lines in order of id, below a folder of the type's name
    folder = scratch(v.spark, "manifest")
    v("events").repartition("event_type").sortWithinPartitions("event_type", "event_id").select("event_type", F.col("props").alias("value")).write.partitionBy("event_type").text(folder)
    return I.build_manifest(v.spark, folder).filter(F.col("name").endswith(".txt")).select("set_id", "bytes", "sha256")


@query("int_11_pick_manifest", """, c AS (SELECT set_id, name, sha256(content) AS sha256, CASE WHEN doc_id % 3 = 0 THEN 'operator' WHEN doc_id % 3 = 1 THEN 'set' ELSE 'legacy' END AS source FROM v_files),
 r AS (SELECT *, CASE source WHEN 'operator' THEN 0 WHEN 'set' THEN 1 ELSE 2 END AS k FROM c)
SELECT set_id, name, sha256, source FROM r QUALIFY k = min(k) OVER (PARTITION BY set_id)""", ("v_files",))
def _(v):
    src = F.when(F.col("doc_id") % 3 == 0, "operator").when(F.col("doc_id") % 3 == 1, "set").otherwise("legacy")
    c = v("v_files").select("set_id", "name", F.sha2("content", 256).alias("sha256"), src.alias("source"))
    return I.pick_manifest(c, ["set_id"], ["operator", "set", "legacy"])


_DIG = "sha256('{' || string_agg('\"' || name || '\":\"' || sha256 || '\"', ',' ORDER BY name) || '}')"


@query("int_12_set_digest", f", f AS (SELECT set_id, name, sha256(content) AS sha256 FROM v_files) SELECT set_id, count(*)::INT AS n_files, {_DIG} AS set_sha256 FROM f GROUP BY 1", ("v_files",))
def _(v):
    return I.set_digest(v("v_files").select("set_id", "name", F.sha2("content", 256).alias("sha256")), ["set_id"])


@query("int_12_identity_inputs", _SETS + f""", cp AS (SELECT set_id, {_DIG} AS set_sha256 FROM st WHERE sha256 IS NOT NULL AND (NOT pinned OR state IN ('match', 'changed', 'unexpected')) GROUP BY 1),
 ag AS (SELECT set_id, max(CASE WHEN name = primary_name THEN sha256 END) AS pr, bool_or(pinned) AS p, bool_or(sharded) AS s FROM st GROUP BY 1)
SELECT set_id, CASE WHEN NOT p AND NOT s THEN 'primary_file' ELSE 'artifact_set' END AS identity, CASE WHEN NOT p AND NOT s THEN pr ELSE set_sha256 END AS local_hash FROM ag LEFT JOIN cp USING (set_id)""", ("v_files",))
def _(v):
    return I.identity_inputs(I.verify_artifacts(*_sets(v), ["set_id"]), ["set_id"])


@query("int_13_shard_compare", _SETS + """ SELECT set_id, count(*) AS n_compared, count(*) FILTER (WHERE ob.sha256 <> expected_sha256) AS n_changed, CASE WHEN count(*) FILTER (WHERE ob.sha256 <> expected_sha256) = 0 THEN 'VERIFIED' ELSE 'MISMATCH' END AS status
FROM ob JOIN mf USING (set_id, name) GROUP BY 1""", ("v_files",))
def _(v):
    observed, manifest, _ = _sets(v)
    return I.shard_compare(manifest, observed, ["set_id"])


@query("int_14_verify_refs", _SETS + """ SELECT set_id, name, expected_sha256 AS recorded, ob.sha256 AS actual, CASE WHEN ob.sha256 IS NULL THEN 'missing_bytes' WHEN expected_sha256 IS NULL THEN 'unrecorded' WHEN ob.sha256 = expected_sha256 THEN 'match' ELSE 'diverge' END AS state
FROM ob FULL JOIN mf USING (set_id, name)""", ("v_files",))
def _(v):
    observed, manifest, _ = _sets(v)
    return I.verify_refs(observed, manifest, ["set_id", "name"])


@query("int_15_duplicate_content", """WITH p AS (SELECT sha256(text) AS sha256, source, count(*) AS n FROM documents GROUP BY 1, 2)
SELECT sha256, count(*) AS owners, sum(n)::BIGINT AS files, min(source) AS first_owner FROM p GROUP BY 1 HAVING count(*) > 1""")
def _(v):
    return I.duplicate_content(v("documents").select(F.sha2("text", 256).alias("sha256"), "source"), "source")
